"""Numbering, hierarchy and merging as windows over the token table.

All windows are partitioned by document (and by what resets a counter), so one shuffle on the id serves them; a document's rows are bounded by its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPTO = (Window.unboundedPreceding, Window.currentRow)
BEFORE = (Window.unboundedPreceding, -1)
DEEPEST = 6


def _count(when: Column, keys: list[str], order: str) -> Column:
    return F.coalesce(F.sum(when.cast("long")).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(*UPTO)), F.lit(0))


def number_sections(sections: DataFrame, id_col: str = "doc_id", order: str = "pos", deepest: int = 5) -> DataFrame:
    """Adds numbering to rows (id, order, level, numbered) and appendix markers (level null, if there is a column appendix).

    Unnumbered sections neither count nor reset. After an appendix marker the first part is a letter and counts start anew. A section
    deeper than any before it counts under 0. Parts (level 0) are counted by themselves and reset nothing.
    """
    rows = sections if "appendix" in sections.columns else sections.withColumn("appendix", F.lit(False))
    rows = rows.withColumn("epoch", _count(F.col("appendix"), [id_col], order))
    keys = [id_col, "epoch"]
    for n in range(1, deepest + 1):
        rows = rows.withColumn(f"n{n}", _count((F.col("level") == n) & F.col("numbered"), keys, order))
        keys.append(f"n{n}")
    first = F.when(F.col("epoch") > 0, F.decode(F.unhex(F.hex(64 + F.col("n1"))), "US-ASCII")).otherwise(F.col("n1").cast("string"))
    parts = [first, *[F.when(F.col("level") >= n, F.col(f"n{n}").cast("string")) for n in range(2, deepest + 1)]]
    rows = rows.withColumn("n0", _count((F.col("level") == 0) & F.col("numbered"), [id_col], order))
    numbering = F.when(F.col("level") == 0, F.col("n0").cast("string")).when(F.col("level") <= deepest, F.concat_ws(".", *parts))
    return rows.withColumn("numbering", F.when(F.col("numbered"), numbering))


def section_parents(sections: DataFrame, id_col: str = "doc_id", order: str = "pos", deepest: int = DEEPEST) -> DataFrame:
    """Adds parent: the order of the nearest earlier section of a smaller level, which is what a stack gives."""
    w = Window.partitionBy(id_col).orderBy(order).rowsBetween(*BEFORE)
    last = {n: F.last(F.when(F.col("level") == n, F.col(order)), ignorenulls=True).over(w) for n in range(deepest)}
    rows = sections.withColumns({f"__l{n}": c for n, c in last.items()})
    parent = F.lit(None).cast("long")
    for n in range(1, deepest + 1):
        below = [F.col(f"__l{k}") for k in range(n)]
        parent = F.when(F.col("level") == n, F.greatest(*below) if len(below) > 1 else below[0]).otherwise(parent)
    return rows.withColumn("parent", parent.cast("long")).drop(*[f"__l{n}" for n in range(deepest)])


#: Token types that number_blocks looks at: all that the kernel needs to write for it.
BLOCKS = ["equation", "table", "figure", "algorithm", "math_env", "section"]


def number_blocks(tokens: DataFrame, id_col: str = "doc_id", order: str = "token_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """id, order, type, name, numbering, and the carried columns, for numbered equations, tables, figures and algorithms (document-wide), and theorems (by level-1 section).

    Equations in table cells, titles and placeholders are never numbered.
    """
    rows = tokens.filter((F.col("slot") == "content") & (F.col("type").isin(*BLOCKS)))
    rows = rows.select(id_col, order, "type", "name", "numbered", "level", *carry)
    top = (F.col("type") == "section") & (F.col("level") == 1)
    rows = rows.withColumn("seen", _count(top, [id_col], order)).withColumn("n1", _count(top & F.col("numbered"), [id_col], order))
    rows = rows.withColumn("k", _count(F.coalesce("numbered", F.lit(False)), [id_col, "type"], order)).withColumn("kt", _count(F.coalesce("numbered", F.lit(False)), [id_col, "type", "seen"], order))
    numbering = F.when(F.col("type") == "math_env", F.concat_ws(".", F.col("n1").cast("string"), F.col("kt").cast("string"))).otherwise(F.col("k").cast("string"))
    return rows.filter(F.col("numbered") & (F.col("type") != "section")).select(id_col, order, "type", "name", numbering.alias("numbering"), *carry)


#: Columns that merge_text reads.
MERGED = ["token_id", "parent_id", "slot", "slot_key", "row", "col", "ord", "type", "styles", "text"]
OPENING, CLOSING = r"[\s(\[{“‘]$", r"^[\s,.;:!?)\]}”’]"


def merge_text(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, parent_id, slot, slot_key, first (token id), styles, text: runs of neighbouring text tokens of equal styles, joined.

    A blank goes between two parts unless the first ends with, or the second begins with, white space or punctuation that binds to it.
    """
    place = ["parent_id", "slot", "slot_key", "row", "col"]
    w = Window.partitionBy(id_col, *place).orderBy("ord")
    rows = tokens.select(id_col, *place, "ord", "token_id", "type", "styles", "text")
    same = (F.lag("type").over(w) == "text") & F.col("styles").eqNullSafe(F.lag("styles").over(w))
    rows = rows.withColumn("starts", F.when(F.col("type") == "text", ~F.coalesce(same, F.lit(False))).otherwise(True))
    rows = rows.withColumn("run", F.sum(F.col("starts").cast("long")).over(w.rowsBetween(*UPTO)))
    gap = F.when(F.lag("text").over(w).rlike(OPENING) | F.col("text").rlike(CLOSING) | (F.col("text") == ""), "").otherwise(" ")
    rows = rows.withColumn("part", F.when(F.col("starts"), F.col("text")).otherwise(F.concat(gap, F.col("text"))))
    texts = rows.filter("type = 'text'").groupBy(id_col, *place, "run").agg(
        F.min("token_id").alias("first"), F.first("styles").alias("styles"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "part"))), lambda p: p["part"]), "").alias("text")
    )
    return texts.drop("run")


def list_depths(tokens: DataFrame, id_col: str = "doc_id", types: tuple[str, ...] = ("list",)) -> DataFrame:
    """id, token_id, type, depth for each list, and for tokens of the other types asked for: how many lists it lies in, itself included.

    An ancestor is a list that began before and whose last descendant is not before this token: lists still open, a running count of begins less ends. The
    tokens are read once.
    """
    event = lambda at, step: F.struct(F.col(at).alias("at"), F.lit(step).alias("step"))
    steps = F.when(F.col("type") == "list", F.array(event("token_id", 1), event("last_desc", -1))).otherwise(F.array(event("token_id", 0)))
    events = tokens.filter(F.col("type").isin("list", *types)).select(id_col, "token_id", "type", F.explode(steps).alias("e")).select(id_col, "token_id", "type", "e.at", "e.step")
    w = Window.partitionBy(id_col).orderBy("at", F.desc("step"), "token_id").rowsBetween(*UPTO)
    counted = events.withColumn("depth", F.sum("step").over(w).cast("long"))
    return counted.filter((F.col("step") >= 0) & F.col("type").isin(*types)).select(id_col, "token_id", "type", "depth")


def enclosing_section(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds section_id: the last section that began before a token (null before the first)."""
    w = Window.partitionBy(id_col).orderBy("token_id").rowsBetween(*UPTO)
    own = F.when((F.col("type") == "section") & (F.col("slot") == "content"), F.col("token_id"))
    return tokens.withColumn("section_id", F.last(own, ignorenulls=True).over(w))


def theorem_proofs(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, theorem, proof: the proof that directly follows a theorem among its siblings."""
    w = Window.partitionBy(id_col, "parent_id", "slot").orderBy("ord")
    rows = tokens.filter("slot = 'content'").withColumn("next_name", F.lead("name").over(w)).withColumn("next_type", F.lead("type").over(w)).withColumn("next_id", F.lead("token_id").over(w))
    return rows.filter("type = 'math_env' AND lower(name) <> 'proof' AND next_type = 'math_env' AND lower(next_name) = 'proof'").select(id_col, F.col("token_id").alias("theorem"), F.col("next_id").alias("proof"))
