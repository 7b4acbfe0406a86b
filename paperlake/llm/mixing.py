"""Mixing sources to target weights by weighted fair queueing.

Each document of a source gets a place in a seeded shuffle. A document is served in packets of ``PACKET`` words, and a packet's virtual finish time
is the source's running word count up to its end divided by the source's target. The queue of all packets of all sources is sorted by virtual
time and truncated where the total budget is used up, within a packet if need be; a source then has its target but for about a packet. A source that is
too small is read again (up to ``max_repeats`` times); what it then still lacks is shared among the others by weight.

How it scales. The running counts are two-level, so a source with a third of all rows is no single task's work: the shuffle key is cut into
4096 slices a source, slices are summed before the shuffle, and only rows of one (source, slice) are sorted together. The queue's place of truncation is found by range:
packets are summed in narrow ranges of virtual time before the shuffle, and only the range in which the budget ends is sorted packet by packet. ``mix`` shuffles whole documents twice:
into slices, and into ranges of virtual time. Targets are filled by rounds of one aggregation over a table of one row a source.

Defined results: a null text has size 0; a null source is a source of its own, last in order; documents of size 0 are
never taken; rows that repeat a doc_id are separate documents; an empty table gives an empty mix. Extra columns are ignored by ``plan`` and carried by ``mix``.
Reruns agree: the shuffle key is md5(seed:doc_id:text), equal keys are ordered by doc_id and size, and rows that agree in all of these are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, n_words, only, parts

WEIGHTS = (5, 2, 1)
BUDGET_PERCENT = 150
MAX_REPEATS = 2
SEED = 9
PACKET = 64
#: Ranges of virtual time before 1, and in each doubling after it.
RANGES = 4096


def ranked(sizes: DataFrame, weights=WEIGHTS) -> DataFrame:
    """home, source, source_size, rank (by code point, null last), weight: one row a source. Sources are ordered by range and counted by partition, as they may be many."""
    by = sizes.groupBy("home").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    dealt = checkpoint(by.repartitionByRange(parts(by), F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    firsts = dealt.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    numbered = dealt.withColumn("own", own).join(F.broadcast(firsts), "part").withColumn("rank", F.col("first") + F.col("own"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    return numbered.select("home", "source", "source_size", "rank", weight.alias("weight"))


def targets(sources: DataFrame, budget_percent: int = BUDGET_PERCENT, max_repeats: int = MAX_REPEATS) -> tuple[DataFrame, int]:
    """(sources with target, whole words that the mix takes). The budget is shared by weight; sources above max_repeats times their size stop there and the
    rest is shared again among the others, until none is above. A source that is full stays full, so each round is one aggregation."""
    most = F.col("source_size") * max_repeats
    total = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    budget, level = (total[0] or 0) * budget_percent / 100, None
    if total[1]:
        now = budget / total[1]
        while now != level:
            level = now
            full = F.lit(level) * F.col("weight") > most
            held, open_ = sources.agg(F.sum(F.when(full, most)), F.sum(F.when(~full, F.col("weight")))).first()
            now = (budget - (held or 0)) / open_ if open_ else float("inf")
    filled = F.least(most.cast("double"), F.lit(level) * F.col("weight")) if level is not None else F.lit(0.0)
    return sources.withColumn("target", filled), min(int(budget), (total[0] or 0) * max_repeats)


def _homes(documents: DataFrame, seed: int) -> DataFrame:
    """The documents' columns with __paperlake_home (a source's name, never null), __paperlake_size, and __paperlake_place and __paperlake_slice in the source's shuffle."""
    text, doc = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return documents.withColumns({
        "__paperlake_home": F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")), "__paperlake_size": n_words(F.col("text")), "__paperlake_place": F.md5(F.concat_ws(":", F.lit(str(seed)), doc, text)),
    }).withColumn("__paperlake_slice", F.substring("__paperlake_place", 1, 3))


class Queue:
    """The sources' targets and the place where the queue is truncated. ``slices``: a small table of offset, rank, target, source_size for each (home, slice);
    ``cut``: virtual time, rank, end and words taken of the packet in which the budget ends, None if nothing is taken."""

    def __init__(self, documents: DataFrame, weights, budget_percent: int, max_repeats: int, seed: int):
        self.repeats = max_repeats
        homes = _homes(only(documents, doc_id="long", source="string", text="string"), seed)
        self.rows = checkpoint(homes.select("doc_id", "source", F.col("__paperlake_home").alias("home"), F.col("__paperlake_size").alias("size"), F.col("__paperlake_place").alias("place"), F.col("__paperlake_slice").alias("slice")))
        sums = checkpoint(self.rows.groupBy("home", "slice").agg(F.first("source").alias("source"), F.sum("size").alias("size")))
        goals, budget = targets(ranked(sums, weights), budget_percent, max_repeats)
        before = Window.partitionBy("home").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sums.select("home", "slice", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
        self.slices = checkpoint(offsets.join(goals, "home").select("home", "slice", "offset", "rank", "target", "source_size"))
        self.placed = checkpoint(self.place(self.rows, "home", "slice", "place", "doc_id", "size"))
        self.cut = self._truncate(budget)

    def place(self, rows: DataFrame, home: str, slice_: str, place: str, doc_id: str, size: str) -> DataFrame:
        """The rows with rank, target, source_size, and end: the source's running count of words up to the row's end."""
        within = Window.partitionBy(home, slice_).orderBy(place, doc_id, size).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        run = rows.withColumn("__paperlake_run", F.sum(size).over(within))
        s = self.slices.select(F.col("home").alias("__paperlake_h"), F.col("slice").alias("__paperlake_s"), F.col("offset").alias("__paperlake_offset"), F.col("rank").alias("__paperlake_rank"), F.col("target").alias("__paperlake_target"), F.col("source_size").alias("__paperlake_source_size"))
        return run.join(s, (F.col(home) == F.col("__paperlake_h")) & (F.col(slice_) == F.col("__paperlake_s"))).withColumn("__paperlake_end", F.col("__paperlake_offset") + F.col("__paperlake_run")).drop("__paperlake_h", "__paperlake_s", "__paperlake_run", "__paperlake_offset")

    def _truncate(self, budget: int) -> tuple[float, int, int, int] | None:
        open_ = self.placed.filter("size > 0 AND __paperlake_target > 0")
        reading = open_.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(self.repeats - 1)))).withColumn("start", F.col("r") * F.col("__paperlake_source_size") + F.col("__paperlake_end") - F.col("size"))
        cutting = reading.withColumn("own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(PACKET).cast("long"))))
        n = F.least(F.lit(PACKET).cast("long"), F.col("size") - F.col("own"))
        packets = cutting.select(F.col("__paperlake_rank").alias("rank"), n.alias("n"), (F.col("start") + F.col("own") + n).alias("end"), "__paperlake_target").withColumn("finish", F.col("end") / F.col("__paperlake_target"))
        packets = packets.withColumn("range", F.when(F.col("finish") < 1, F.floor(F.col("finish") * RANGES)).otherwise(RANGES + F.floor(F.log2("finish") * RANGES)))
        upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most some thousands of ranges
        reached = packets.groupBy("range").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(upto)).filter(F.col("upto") >= budget).orderBy("range").first()
        if not reached or not budget:
            return None
        order = Window.orderBy("finish", "rank", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # packets of one range
        last = packets.filter(F.col("range") == reached.range).withColumn("upto", F.sum("n").over(order) + (reached.upto - reached.n)).filter(F.col("upto") >= budget).orderBy("finish", "rank", "end").first()
        return last.finish, last.rank, last.end, budget - (last.upto - last.n)

    def served(self, end, n) -> F.Column:
        """Words of a packet (n words up to the source's end-th) that lie before the truncation."""
        finish, rank, at, words = self.cut
        f, r = end / F.col("__paperlake_target"), F.col("__paperlake_rank")
        here = (f == finish) & (r == rank)
        return F.when((f < finish) | (f == finish) & (r < rank) | here & (end < at), n).when(here & (end == at), F.lit(words).cast("long")).otherwise(F.lit(0).cast("long"))

    def taken(self, size) -> F.Column:
        """Words of a placed row that the truncated queue holds. Only a document in service at the truncation is looked at packet by packet."""
        total = nothing = F.lit(0).cast("long")
        for r in range(self.repeats if self.cut else 0):
            total = total + F.when((size > 0) & (F.col("__paperlake_target") > 0), self._of_reading(r * F.col("__paperlake_source_size") + F.col("__paperlake_end") - size, size)).otherwise(nothing)
        return total

    def _of_reading(self, start, size) -> F.Column:
        step = F.lit(PACKET).cast("long")
        packet = lambda own: self.served(start + own + F.least(step, size - own), F.least(step, size - own))
        each = F.aggregate(F.sequence(F.lit(0).cast("long"), size - 1, step), F.lit(0).cast("long"), lambda a, own: a + packet(own))
        before, after = (start + size) / F.col("__paperlake_target") < self.cut[0], start / F.col("__paperlake_target") > self.cut[0]
        return F.when(before, size).when(after, F.lit(0).cast("long")).otherwise(each)


def plan(documents: DataFrame, weights=WEIGHTS, budget_percent: int = BUDGET_PERCENT, max_repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken (the words that the mix takes of it, repeats counted), virtual_finish (of its first reading)."""
    q = Queue(documents, weights, budget_percent, max_repeats, seed)
    finish = F.when(F.col("__paperlake_target") > 0, F.col("__paperlake_end") / F.col("__paperlake_target"))
    return q.placed.select("doc_id", "source", "size", F.col("__paperlake_source_size").alias("source_size"), F.col("__paperlake_target").alias("target"), q.taken(F.col("size")).alias("taken"), finish.alias("virtual_finish"))


def mix(documents: DataFrame, weights=WEIGHTS, budget_percent: int = BUDGET_PERCENT, max_repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """The documents of the mix, whole, in order of virtual finish time, with their own columns; repeats are rows. A document is in it once for each reading
    whose middle lies before the queue's truncation."""
    q = Queue(documents, weights, budget_percent, max_repeats, seed)
    if not q.cut:
        return documents.filter(F.lit(False))
    placed = q.place(_homes(documents, seed), "__paperlake_home", "__paperlake_slice", "__paperlake_place", "doc_id", "__paperlake_size")
    start = [r * F.col("__paperlake_source_size") + F.col("__paperlake_end") - F.col("__paperlake_size") for r in range(max_repeats)]
    times = F.array(*[F.when((F.col("__paperlake_size") > 0) & (F.col("__paperlake_target") > 0) & ((s + F.col("__paperlake_size") / 2) / F.col("__paperlake_target") < q.cut[0]), (s + F.col("__paperlake_size")) / F.col("__paperlake_target")) for s in start])
    read = placed.withColumn("__paperlake_finish", F.explode(F.array_compact(times)))
    # the sources' words are spread evenly over virtual time, so equal ranges of it hold equal shares
    n = parts(documents)
    ranges = read.repartitionById(n, F.least(F.lit(n - 1), F.floor(F.col("__paperlake_finish") / q.cut[0] * n)).cast("int"))
    return ranges.sortWithinPartitions("__paperlake_finish", "__paperlake_rank", "__paperlake_end").select(*[f"`{c}`" for c in documents.columns])


#: Written apart from the code above: the refill runs to its end by recursion, and all packets of all documents stand in one queue.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('9:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST))::BIGINT AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 1 THEN 5.0 WHEN 2 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, (SELECT sum(source_size) FROM s)::BIGINT * 150 / 100 AS budget FROM s),
refill AS (
  SELECT 0 AS round, max(budget)::DOUBLE / sum(weight) AS share FROM w
  UNION ALL
  SELECT f.round + 1, (SELECT (max(budget)::DOUBLE - coalesce(sum(2 * source_size) FILTER (f.share * weight > 2 * source_size), 0)) / sum(weight) FILTER (NOT f.share * weight > 2 * source_size) FROM w)
  FROM refill f WHERE EXISTS (SELECT 1 FROM w WHERE f.share * weight > 2 * source_size) AND f.round <= (SELECT count(*) FROM w)),
t AS (SELECT *, least(2.0 * source_size, (SELECT arg_max(share, round) FROM refill) * weight)::DOUBLE AS target FROM w),
o AS (SELECT row_number() OVER () AS id, d.doc_id, size, place, t.source_size, target, rank, floor(budget)::BIGINT AS budget,
  (sum(size) OVER (PARTITION BY rank ORDER BY place, d.doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
packets AS (SELECT id, rank, budget, least(64, size - own)::BIGINT AS n, (reading * source_size + start + own + least(64, size - own))::BIGINT AS fin, target
  FROM (SELECT *, unnest(generate_series(0, size - 1, 64)) AS own FROM o CROSS JOIN (VALUES (0), (1)) AS readings(reading) WHERE size > 0 AND target > 0)),
queue AS (SELECT id, n, budget, sum(n) OVER (ORDER BY fin::DOUBLE / target, rank, fin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM packets),
got AS (SELECT id, sum(greatest(least(n, budget - (upto - n)), 0))::BIGINT AS taken FROM queue GROUP BY id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM o LEFT JOIN got USING (id)
"""
