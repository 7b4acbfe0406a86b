"""What several corpus operators share: table access, reliable checkpoints, word splitting."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder that the session names. Where none is set, a folder of our own serves a local session; on a
    cluster it would be lost with its executor, so there it is an error."""
    context = df.sparkSession.sparkContext
    if not (context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")):
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="paperlake-"))
    return df.checkpoint(eager=True)


def n_words(text) -> F.Column:
    """Words of a text as a long; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns cast to the given types, and nothing else: clashing names in extra columns can't reach an operator."""
    return df.select(*[F.col(f"`{k}`").cast(v).alias(k) for k, v in columns.items()])


def whole(documents: DataFrame, **columns) -> DataFrame:
    """d, a struct of all the documents' columns, beside the given columns: whatever names the documents have, they can't meet an operator's own. ``select("d.*")`` gives them back."""
    return documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("d"), *[v.alias(k) for k, v in columns.items()])


def parts(df: DataFrame, at_least: int = 8) -> int:
    """Partitions for an explicit repartition: the session's shuffle width, which the cluster sizes to its data."""
    return max(at_least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def join_hot(many: DataFrame, one: DataFrame, key: str, counts: DataFrame, total: int, how: str = "inner") -> DataFrame:
    """many joined with one (a row a key) where a key may hold any share of many. counts: key, n (rows of many); total: all rows of many.

    Keys with more than an eighth of a partition's even share are, whatever the input, at most eight a partition: their rows of one are broadcast to many as it
    lies. All other rows meet by a shuffle. how: inner, or left for rows of many without a partner.
    """
    common = max(64, total // (8 * parts(many)))
    hot = checkpoint(counts.filter(F.col("n") > common).select(key).join(one, key, how))
    dealt = many.join(F.broadcast(hot.select(key)), key, "left_anti").join(one, key, how)
    return many.join(F.broadcast(hot), key).select(dealt.columns).unionByName(dealt)
