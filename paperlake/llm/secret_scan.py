r"""Secret scans with an incremental blob ledger, in DataFrame operations only.

Every historical version of every path is a blob, addressed by the SHA-256 of its content. A ledger holds which (blob, rule, rule version)
have been scanned and what was found; only pairs that it lacks are scanned, each blob once however many versions hold it, and findings
are joined back to all paths. Giving the ledger that a scan returns to the next one makes scanning incremental; a changed rule (a new version) is scanned
over all blobs again, the others not. The query begins with an empty ledger, so it scans every blob once; its findings are read from the ledger that the scan leaves.

Content is shuffled only to bring a blob's copies together for the scan, and not at all if the ledger has every pair; all else works on addresses. A blob that very many versions hold is one row of the scan; its
findings go back to them by a broadcast of such blobs (``join_hot``), the others' by a shuffle.

Spans are code points, end exclusive. The engine's regex functions return texts, not places: a rule's matches and the gaps between them
alternate, so a match begins at the sum of the lengths before it, a running sum per (blob, rule).

Defined results: a null content is the empty blob, which has no findings; repeated rows are versions each; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, join_hot, only


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of pattern, less those whose group is shorter than least code points."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0


#: Runs that are matched only whole (hex, access) have their least length in the pattern: a shorter run fails from any start in it.
BASE = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", 1, r"[0-9a-f]{32,}"),
)
ADDED = (
    Rule("private_key", 1, r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{12,}\.[A-Za-z0-9_-]{12,}\.[A-Za-z0-9_-]{12,}"),
    Rule("service_token", 1, r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{16,}|sk_live_[A-Za-z0-9]{16,})"),
)
RULES = BASE + ADDED
LEDGER = "blob string, rule string, version int, spans array<struct<start:int,stop:int>>"


def addresses(versions: DataFrame) -> DataFrame:
    """path, blob for every version: narrow, kept, and read by everything that needs no content."""
    return checkpoint(_addressed(versions).select("path", "blob"))


def _addressed(versions: DataFrame) -> DataFrame:
    return versions.select(F.col("path").alias("path"), F.coalesce(F.col("content").cast("string"), F.lit("")).alias("content")).withColumn("blob", F.sha2("content", 256))


def scan_unseen(versions: DataFrame, paths: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """LEDGER rows of all pairs of a blob of these versions and a rule version that the ledger lacks: append them to it. paths: the versions' addresses."""
    every = F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules])
    todo = paths.select("blob").distinct()
    if ledger is None:
        todo = todo.withColumn("todo", every)
    else:
        seen = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "rule", "version")).alias("seen"))
        unseen = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
        todo = checkpoint(todo.join(seen, "blob", "left").select("blob", unseen.alias("todo")).filter(F.size("todo") > 0))
    ranks = F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for k, r in enumerate(rules)])
    new = todo.select("blob", F.explode(F.filter(ranks, lambda r: F.array_contains("todo", F.concat_ws(":", r["rule"], r["version"])))).alias("r")).select("blob", "r.*")
    none = F.array().cast("array<struct<start:int,stop:int>>")
    if ledger is not None and todo.isEmpty():
        return new.select("blob", "rule", "version", none.alias("spans"))
    blobs = _addressed(versions).groupBy("blob").agg(F.first("content").alias("content"))
    blobs = blobs.withColumn("todo", every) if ledger is None else blobs.join(todo, "blob")
    hits = F.array(*[_hits(k, r) for k, r in enumerate(rules)])
    scanned = blobs.select("blob", F.filter(hits, lambda h: h.isNotNull()).alias("hits"))
    one = scanned.select("blob", F.explode("hits").alias("h")).select("blob", "h.rank", F.posexplode(F.arrays_zip("h.gap", "h.own", "h.kept")).alias("n", "m"))
    before = Window.partitionBy("blob", "rank").orderBy("n")
    placed = one.select("blob", "rank", F.col("m.kept").alias("kept"), F.col("m.own").alias("own"), F.sum(F.col("m.gap") + F.col("m.own")).over(before).cast("int").alias("stop")).filter("kept")
    placed = placed.select("blob", "rank", (F.col("stop") - F.col("own")).alias("start"), "stop")
    found = placed.groupBy("blob", "rank").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    return new.join(found, ["blob", "rank"], "left").select("blob", "rule", "version", F.coalesce("spans", none).alias("spans"))


def findings(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """path, blob, and spans: an array of (start, rank of rule, stop) in that order, for every version, read from the ledger."""
    kinds = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(f"{r.kind}:{r.version}"), F.lit(k))])
    known = ledger.select("blob", kinds[F.concat_ws(":", "rule", "version")].alias("rank"), F.explode("spans").alias("s")).filter("rank is not null")
    per_blob = known.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct(F.col("s.start").alias("start"), "rank", F.col("s.stop").alias("stop")))).alias("spans"))
    empty = F.array().cast("array<struct<start:int,rank:int,stop:int>>")
    counts = paths.groupBy("blob").agg(F.count("*").alias("n"))
    return join_hot(paths, checkpoint(per_blob), "blob", counts, paths.count(), "left").select("path", "blob", F.coalesce("spans", empty).alias("spans"))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(findings of all versions (path, content), LEDGER rows that this scan added to the ledger so far)."""
    paths = addresses(versions)
    added = checkpoint(scan_unseen(versions, paths, ledger, rules))
    return findings(paths, added if ledger is None else ledger.unionByName(added), rules), added


def _hits(rank: int, rule: Rule) -> F.Column:
    """Of a blob that the rule is still to scan: rank, and for each match the length of the gap before it, its own, and whether it is long enough."""
    text, pattern = F.col("content"), F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x))
    own = F.regexp_extract_all(text, pattern, F.lit(0))
    judged = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    made = F.struct(
        F.lit(rank).alias("rank"), F.slice(gaps, F.lit(1), F.size(own)).alias("gap"), F.transform(own, lambda x: F.length(x)).alias("own"),
        F.transform(judged, lambda x: F.length(x) >= rule.least).alias("kept"),
    )
    return F.when(F.array_contains("todo", f"{rule.kind}:{rule.version}") & text.rlike(rule.pattern), made)


def counted(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: the findings of all documents, through a new ledger."""
    docs = only(documents, doc_id="long", text="string").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    found, _ = scan(docs, None, rules)
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    number = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long")
    return found.select(
        F.col("path").alias("doc_id"), *[number(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)],
        F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
    )


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
r(kind, rank, least, grp, pattern) AS (VALUES
  ('assign', 0, 8, 2, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  ('access', 1, 16, 0, 'AKIA[A-Z0-9]+'), ('hex', 2, 32, 0, '[0-9a-f]+'),
  ('private_key', 3, 0, 0, '-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----'),
  ('web_token', 4, 0, 0, 'eyJ[A-Za-z0-9_-]{12,}\.[A-Za-z0-9_-]{12,}\.[A-Za-z0-9_-]{12,}'),
  ('service_token', 5, 0, 0, '(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{16,}|sk_live_[A-Za-z0-9]{16,})')),
h AS (
  SELECT id, kind, rank, least, regexp_extract_all(text, pattern) AS own, CASE WHEN grp = 2 THEN regexp_extract_all(text, pattern, 2) ELSE regexp_extract_all(text, pattern) END AS judged, string_split_regex(text, pattern) AS gap
  FROM d, r),
one AS (SELECT id, kind, rank, least, unnest(own) AS own, unnest(judged) AS judged, unnest(gap[1:len(own)]) AS gap, unnest(generate_series(1, len(own))) AS n FROM h WHERE len(own) > 0),
placed AS (SELECT id, kind, rank, length(judged) >= least AS kept, length(own) AS size, (sum(length(gap) + length(own)) OVER (PARTITION BY id, rank ORDER BY n))::BIGINT AS stop FROM one),
s AS (SELECT id, rank, kind, stop - size AS start, kind || ':' || (stop - size) || ':' || stop AS span FROM placed WHERE kept),
g AS (SELECT id, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS k, count(*) FILTER (rank = 2) AS x,
  string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank) AS every FROM s GROUP BY id)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(k, 0)::BIGINT AS n_access, coalesce(x, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM d LEFT JOIN g USING (id)
"""
