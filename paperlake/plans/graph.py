"""Graphs in the token table: citations and references, resolved by joins; counts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cite_edges(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return tokens.filter("type = 'citation'").select(id_col, "token_id", F.explode("keys").alias("key"))


def ref_edges(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return tokens.filter("type = 'ref'").select(id_col, "token_id", F.explode("keys").alias("key"))


def labels(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, key, token_id, type of the token that owns the label; of a repeated key, the first."""
    rows = tokens.filter("labels is not null").select(id_col, F.explode("labels").alias("key"), "token_id", "type")
    return rows.groupBy(id_col, "key").agg(F.min_by("token_id", "token_id").alias("token_id"), F.min_by("type", "token_id").alias("type"))


def bib_entries(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, cite_key, token_id, format, text, fields; of a repeated key, the first entry."""
    w = Window.partitionBy(id_col, "cite_key").orderBy("token_id")
    return tokens.filter("type = 'bibitem'").withColumn("n", F.row_number().over(w)).filter("n = 1").select(id_col, "cite_key", "token_id", "format", "label", "text", "fields")


def resolve_citations(edges: DataFrame, entries: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Every citation key with whether its document has the entry. Equi-joins on (id, key): both sides are dealt by them."""
    known = entries.select(id_col, F.col("cite_key").alias("key"), F.lit(True).alias("found")).distinct()
    return edges.join(known, [id_col, "key"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def citations_in_place(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, token_id, key, found, as resolve_citations gives them, from one reading of the tokens: citations and entries are dealt by (id, key) together."""
    rows = tokens.filter("type IN ('citation', 'bibitem')")
    rows = rows.select(id_col, "token_id", (F.col("type") == "bibitem").alias("entry"), F.explode(F.when(F.col("type") == "bibitem", F.array("cite_key")).otherwise(F.col("keys"))).alias("key"))
    found = F.max("entry").over(Window.partitionBy(id_col, "key"))
    return rows.withColumn("found", found).filter("NOT entry").select(id_col, "token_id", "key", "found")


def references_in_place(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, token_id, key, target_id, target_type, as resolve_references gives them, from one reading of the tokens."""
    named = lambda keys, owns: F.transform(F.coalesce(keys, F.array().cast("array<string>")), lambda k: F.struct(k.alias("key"), F.lit(owns).alias("owns")))
    refs = F.when(F.col("type") == "ref", F.col("keys"))
    rows = tokens.filter("type = 'ref' OR labels IS NOT NULL").select(id_col, "token_id", "type", F.explode(F.concat(named(refs, False), named(F.col("labels"), True))).alias("n"))
    own = F.when(F.col("n.owns"), F.struct("token_id", "type"))
    target = F.min(own).over(Window.partitionBy(id_col, F.col("n.key")))
    return rows.withColumn("target", target).filter("NOT n.owns").select(id_col, "token_id", F.col("n.key").alias("key"), F.col("target.token_id").alias("target_id"), F.col("target.type").alias("target_type"))


def unresolved_citations(edges: DataFrame, entries: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return edges.join(entries.select(id_col, F.col("cite_key").alias("key")), [id_col, "key"], "left_anti")


def resolve_references(edges: DataFrame, owners: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return edges.join(owners.select(id_col, "key", F.col("token_id").alias("target_id"), F.col("type").alias("target_type")), [id_col, "key"], "left")


def type_histogram(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("type").agg(F.count("*").alias("n"))


def unknown_commands(tokens: DataFrame) -> DataFrame:
    return tokens.filter("type = 'command'").groupBy("command").agg(F.count("*").alias("n"))


def table_cells(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, table_id, row, col, rowspan, colspan, text of each cell."""
    cells = tokens.filter("slot = 'cell'")
    grouped = cells.groupBy(id_col, F.col("parent_id").alias("table_id"), "row", "col").agg(
        F.first("rowspan").alias("rowspan"), F.first("colspan").alias("colspan"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "").alias("text")
    )
    return grouped
