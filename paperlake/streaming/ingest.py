"""Bundles dropped into a folder, parsed as they come. A bundle is one file, so no state is kept between batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperlake.operators.tokens import parse_documents
from paperlake.sources import bundles

BINARY = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """A streaming table of new files under a path."""
    return spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(path)


def ingest(spark: SparkSession, path: str, out: str, checkpoint: str):
    """Start a query that appends the tokens of new papers to Parquet by type; a batch that is run again overwrites its own folder."""

    def batch(df: DataFrame, batch_id: int) -> None:
        papers = bundles.papers(bundles.decode(bundles.explode(df, path).filter("error IS NULL")))
        tokens = parse_documents(papers, "paper_id", "text", preprocess=True, files_col="files")
        tokens.write.mode("overwrite").partitionBy("type").parquet(f"{out}/batch={batch_id}")

    return stream_files(spark, path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_tokens(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", types: list[str] | None = None) -> DataFrame:
    """Tokens of a streaming table of documents: a document is one row, so the kernel needs no state and appends as rows come."""
    return parse_documents(documents, id_col, text_col, types=types)


def stream_counts(tokens: DataFrame, at_col: str, delay: str, window: str) -> DataFrame:
    """Tokens by type and window of event time; late rows within the delay are counted, state older than it is dropped."""
    from pyspark.sql import functions as F

    return tokens.withWatermark(at_col, delay).groupBy(F.window(at_col, window).alias("w"), "type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "type", "n")
