"""LaTeX written from the test tables by column expressions, so that answers read back from it can be held against the raw rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([%&$#_{}])", r"\\$1")


#: Blanks of every width, which SQL's trim takes off; and what else the kernel takes for white space, or LaTeX for a sign of its own, though it is text.
BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
ODD = BLANKS[1:] + "\x0b\x1c\x1d\x1e\x1f\x85\u2028\u2029~"


def literal(text: Column) -> Column:
    """Like escape, for any line: what would not be read back as it stands is written by its code point, and {} ends it."""
    plain = F.regexp_replace(text, r"([%&$#_{}\\])", r"\\$1")
    put = F.replace(plain, F.lit("\\\\"), F.lit("\\u005c{}"))
    for c in ODD:
        put = F.replace(put, F.lit(c), F.lit(f"\\u{ord(c):04x}{{}}"))
    return F.when(text.rlike(rf"[\\{ODD}]"), put).otherwise(plain)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, i (from 0), line, with blanks collapsed and trimmed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return docs.withColumn("line", F.trim(F.regexp_replace("line", r"[\t\n\f\r ]+", " "), F.lit(BLANKS)))


def write(rows: DataFrame, key: str, order: str, piece: Column, glue: str = "\n", before: str = "", after: str = "") -> DataFrame:
    """One text a key: pieces in order. Dealt by a number of partitions of our own choice: texts that pack well would be put together in a few tasks by their
    compressed size, but what follows, reading them, takes a second a megabyte."""
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = rows.repartition(width, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), piece.alias("p")))).alias("all"))
    body = F.array_join(F.transform("all", lambda x: x["p"]), glue)
    return grouped.select(key, F.concat(F.lit(before), body, F.lit(after)).alias("text"))


def tex(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


#: The same lines in the oracle's language.
LINES_SQL = r"l AS (SELECT doc_id, (k - 1)::BIGINT AS i, trim(regexp_replace(line, '\s+', ' ', 'g')) AS line FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, k))"
