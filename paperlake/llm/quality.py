"""Quality rules with adaptive thresholds from mergeable quantile sketches, in DataFrame operations only.

Text measures are computed per document, once, and kept as narrow rows. For each (lang, source) and measure a sketch of the documents that pass the base rules
is kept: counts in bins of an integer scale whose bins double every 32 steps (each bin at most 1/32 wide relative to its values). Such sketches merge by
adding counts, so they are built by a partial aggregation before the shuffle, a hot source is no single task's work, and the
result does not depend on the order of merging. From its sketches each group gets its own fences: the quartiles, and beyond them ``REACH`` times the spread between them.
The spread is no less than a bin is wide, so what the sketch can't tell apart is not fenced apart; and a measure that is nearly constant in a group, and so has no spread of its own, has that which
one occurrence (for repeated words, one window) makes in a document of the group's median length. A group of fewer than ``LEAST_ROWS`` documents takes the fences of its language's merged sketch, or, if that is too small as well, of all documents'.
A document fails if a measure lies beyond its group's fence.

Defined results: a null or empty text has no words and fails the base rules; null lang and source are groups of their own;
repeated rows count as rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, only, whole

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
#: Spreads beyond the quartiles at which a fence stands.
REACH = 6
#: Rows of a group below which its sketch is merged into a larger one.
LEAST_ROWS = 30
#: measure: (what is counted, in units of what, whether too little fails as well). Fences have these; the sketches also the two lengths.
FENCED = {"symbols": (1, "words", False), "dup_lines": (1, "lines", False), "repeats": (WINDOW, "words", False), "word_length": (1, "words", True)}


def measures(documents: DataFrame) -> DataFrame:
    """Base measures of whole texts: doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Words repeated in windows: the 5-word windows of a text are hashed to 64 bits (xxhash64 over the words) and sorted with their places;
    a window equal to a neighbour occurs twice or more, and its words, first occurrence included, are counted once each. Only texts with
    fewer distinct windows than windows take the sort.
    """
    docs = only(documents, doc_id="long", text="string", lang="string", source="string").withColumn("text", F.coalesce("text", F.lit("")))
    words = F.array_remove(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    docs = docs.select(
        "doc_id", "lang", "source", words.alias("words"), lines.alias("lines"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    docs = docs.withColumn("n_words", F.size("words").cast("long"))
    full = F.greatest(F.size("words") - WINDOW + 1, F.lit(0))
    grams = F.slice(F.transform(F.col("words"), lambda w, i: F.xxhash64(w, *[F.get(F.col("words"), i + k) for k in range(1, WINDOW)])), F.lit(1), full)
    docs = docs.withColumn("grams", grams)
    pairs = F.array_sort(F.transform(F.col("grams"), lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    docs = docs.withColumn("sorted", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), pairs))
    again = F.filter(
        F.transform(F.col("sorted"), lambda p, k: F.when(
            ((k > 0) & (F.get(F.col("sorted"), F.greatest(k - 1, F.lit(0)))["g"] == p["g"])) | F.coalesce(F.get(F.col("sorted"), k + 1)["g"] == p["g"], F.lit(False)), p["i"])),
        lambda i: i.isNotNull(),
    )
    docs = docs.withColumn("again", F.array_sort(again))
    covered = F.aggregate(F.transform(F.col("again"), lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("again"), k + 1) - i, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)
    found = docs.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    return checkpoint(found)  # narrow, read twice; and what is built on it can't be merged into the expressions above


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT)


def ratios() -> dict[str, F.Column]:
    """Measures in thousandths, integers so that every engine agrees."""
    per = lambda a, b: F.when(F.col(b) > 0, F.floor(F.col(a) * 1000 / F.col(b))).otherwise(0).cast("long")
    return {"symbols": per("n_symbols", "n_words"), "dup_lines": per("n_dup_lines", "n_lines"), "repeats": per("n_repeat_words", "n_words"), "word_length": per("word_chars", "n_words")}


def width_of(v) -> F.Column:
    """Width of the value's bin: values below 64 have bins of their own; above, there are 32 bins for every doubling."""
    return F.when(v < 64, 1).otherwise(F.pow(F.lit(2.0), F.length(F.bin(v)) - 6)).cast("long")


def bin_of(v) -> F.Column:
    """Lower edge of the value's bin."""
    return (F.floor(v / width_of(v)) * width_of(v)).cast("long")


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, measure, bin, n: one mergeable quantile sketch for each group and measure, of the documents that pass the base rules."""
    sketched = ratios() | {"words": F.col("n_words"), "lines": F.col("n_lines")}
    long = measured.filter(~base_failed()).select("lang", "source", F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), bin_of(v).alias("bin")) for k, v in sketched.items()])).alias("m"))
    return long.groupBy("lang", "source", F.col("m.measure").alias("measure"), F.col("m.bin").alias("bin")).agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, group: tuple[str, ...]) -> DataFrame:
    """The group's columns, rows, and a low and a high fence for each measure, read off the group's merged sketch."""
    merged = sketch.groupBy(*group, "measure", "bin").agg(F.sum("n").alias("n"))
    per = Window.partitionBy(*group, "measure")
    run = merged.withColumn("upto", F.sum("n").over(per.orderBy("bin"))).withColumn("rows", F.sum("n").over(per))
    quartile = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("rows") * k, F.col("bin"))).alias(f"q{k}")
    q = run.groupBy(*group, "measure").agg(F.first("rows").alias("rows"), *map(quartile, (1, 2, 3)))
    at = lambda c, k: F.max(F.when(F.col("measure") == k, F.col(c)))
    wide = q.groupBy(*group).agg(F.max("rows").alias("rows"), *[at(f"q{n}", k).alias(f"q{n}_{k}") for k in (*FENCED, "words", "lines") for n in (1, 2, 3)])
    out = []
    for k, (counted, unit, both) in FENCED.items():
        one = F.floor(F.lit(1000 * counted) / F.greatest(F.col(f"q2_{unit}"), F.lit(1)))
        q1, q3 = F.col(f"q1_{k}"), F.col(f"q3_{k}")
        reach = REACH * F.greatest(q3 - q1, one, width_of(q3))
        out += [(q3 + width_of(q3) - 1 + reach).alias(f"high_{k}")] + [(q1 - reach).alias(f"low_{k}")] * both
    return wide.select(*group, "rows", *out)


def limits(sketch: DataFrame) -> DataFrame:
    """f_lang, f_source and the fences of every group: its own, or those of the least merged sketch with rows enough."""
    own, lang = fences(sketch, ("lang", "source")), fences(sketch, ("lang",))
    every = fences(sketch, ()).first()  # some ten numbers
    names = [c for c in own.columns if c not in ("lang", "source", "rows")]
    lang = lang.select(*[F.col(c).alias(f"{c}_of_lang") for c in ("lang", "rows", *names)])
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("lang_of_lang")))
    best = [F.when(F.col("rows") >= LEAST_ROWS, F.col(c)).when(F.col("rows_of_lang") >= LEAST_ROWS, F.col(f"{c}_of_lang")).otherwise(F.lit(every[c])).alias(c) for c in names]
    return joined.select(F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), *best)


def judge(documents: DataFrame) -> DataFrame:
    """doc_id, the base measures, base_failed, kept (false if base_failed, else within all fences of its lang and source)."""
    measured = measures(documents)
    joined = measured.join(limits(sketches(measured)), F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    inside = F.lit(True)
    for k, v in ratios().items():
        inside = inside & (v <= F.col(f"high_{k}")) & (v >= F.col(f"low_{k}") if FENCED[k][2] else F.lit(True))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & inside).alias("kept"))


def keep(documents: DataFrame) -> DataFrame:
    """The documents that pass, with their columns (rows of one doc_id and text are judged alike)."""
    verdict = judge(documents).groupBy("doc_id").agg(F.bool_and("kept").alias("kept")).withColumnRenamed("doc_id", "judged")
    return whole(documents, doc_id=F.col("doc_id").cast("long")).join(verdict, F.col("doc_id").eqNullSafe(F.col("judged"))).filter("kept").select("d.*")


SQL = r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, lang, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
g AS (SELECT doc_id, i, words[i:i+4] AS gram FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 4)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n FROM twice, generate_series(0, 4) AS o(k) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*)::BIGINT AS n, (count(*) - count(DISTINCT line))::BIGINT AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, source, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
   (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
   coalesce(lines.dup, 0)::BIGINT AS n_dup_lines, coalesce(lines.n, 0)::BIGINT AS n_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
   FROM w LEFT JOIN lines ON w.doc_id IS NOT DISTINCT FROM lines.doc_id LEFT JOIN rep ON w.doc_id IS NOT DISTINCT FROM rep.doc_id),
r AS (SELECT *, CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words ELSE 0 END AS symbols, CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS dup_lines,
   CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END AS repeats, CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words ELSE 0 END AS word_length FROM m),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM r),
x AS (SELECT lang, source, unnest(['symbols', 'dup_lines', 'repeats', 'word_length', 'words', 'lines']) AS measure, unnest([symbols, dup_lines, repeats, word_length, n_words, n_lines]) AS v FROM b WHERE NOT base_failed),
k AS (SELECT lang, source, measure, CASE WHEN v < 64 THEN v ELSE (v // (1::BIGINT << (length(bin(v)) - 6)::INT)) * (1::BIGINT << (length(bin(v)) - 6)::INT) END AS bin FROM x),
levels AS (SELECT 0 AS level, * FROM k UNION ALL SELECT 1, lang, NULL, measure, bin FROM k UNION ALL SELECT 2, NULL, NULL, measure, bin FROM k),
q AS (SELECT level, lang, source, measure, count(*) AS n, quantile_disc(bin, 0.25) AS q1, quantile_disc(bin, 0.5) AS q2, quantile_disc(bin, 0.75) AS q3 FROM levels GROUP BY ALL),
u AS (SELECT a.level, a.lang, a.source, a.measure, a.n, a.q1, a.q3 + a.width - 1 AS q3, 6 * greatest(a.q3 - a.q1, a.width, (CASE WHEN a.measure = 'repeats' THEN 5000 ELSE 1000 END) // greatest(c.q2, 1)) AS reach
   FROM (SELECT *, CASE WHEN q3 < 64 THEN 1 ELSE 1::BIGINT << (length(bin(q3)) - 6)::INT END AS width FROM q) a JOIN q c ON a.level = c.level AND a.lang IS NOT DISTINCT FROM c.lang
   AND a.source IS NOT DISTINCT FROM c.source AND c.measure = CASE WHEN a.measure = 'dup_lines' THEN 'lines' ELSE 'words' END),
f AS (SELECT level, lang, source, max(n) AS n, max(q3 + reach) FILTER (measure = 'symbols') AS hs, max(q3 + reach) FILTER (measure = 'dup_lines') AS hd,
   max(q3 + reach) FILTER (measure = 'repeats') AS hr, max(q3 + reach) FILTER (measure = 'word_length') AS hw, max(q1 - reach) FILTER (measure = 'word_length') AS lw FROM u GROUP BY ALL),
best AS (SELECT b.*, level, hs, hd, hr, hw, lw, row_number() OVER (PARTITION BY b.doc_id, b.lang, b.source ORDER BY level) AS choice
  FROM b LEFT JOIN f ON (level = 2 OR b.lang IS NOT DISTINCT FROM f.lang AND (level = 1 OR b.source IS NOT DISTINCT FROM f.source)) AND (level = 2 OR f.n >= 30))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND symbols <= hs AND dup_lines <= hd AND repeats <= hr AND word_length <= hw AND word_length >= lw AS kept
FROM best WHERE choice = 1
"""
