"""SpotSigs document fingerprints: chains of content words that follow common-word anchors.

Wherever an anchor (a very common word) stands, it and the next ``CHAIN`` content words form a signature; a document's fingerprint is its set of
signatures, 64 bits each. Fingerprints are partitioned by set length (``length_class``): two sets as like as a threshold lie in the same partition or in neighbouring ones. Likeness is
the Jaccard ratio of two sets, pruned: sets of partitions further apart have likeness 0 without being compared, as do sets whose common part is found, while it is counted, to be too small.
``with_edits`` uses the threshold ``LEAST``; ``similar`` finds all similar pairs of classes of equal fingerprints at 0.8.

Defined results: a null or empty text has an empty fingerprint; a text without any anchor chain has its words as signatures, one without words
the whole text; two empty sets have likeness 1, an empty and another 0; equal texts have equal fingerprints; extra columns are ignored.
In ``with_edits`` documents are ordered by doc_id (nulls first), rows that repeat a doc_id by their text's hash, then text; the last one's next is the first; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, only, parts

#: Common words of English, German, French and Spanish: articles, conjunctions, prepositions, pronouns, auxiliaries.
ANCHORS = frozenset(
    "the a an and or of to in on for with by from at as is are was be been this that it not have has had he she they we you"
    " der die das und oder in im zu den dem des mit von auf für ist sind war ein eine einen nicht sich es auch"
    " le la les un une et ou de du des à en dans que qui est sont pour par sur avec au aux ne pas il elle"
    " el los las una y o del al con por para se su es son no lo como".split()
)
CHAIN = 2
#: Likeness below this is 0 in with_edits.
LEAST = 0.2
#: Signatures of the smaller set that are counted between two looks at the bound.
STRETCH = 64
MEMO = 300_000
_WORD = re.compile(r"\w+")
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


class Hashes(dict):
    """Word to hash; the lowest bit says whether it is an anchor."""

    def __init__(self, anchors: frozenset[str]):
        self.anchors = anchors

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word) & ~1 | (word in self.anchors)
        if len(self) < MEMO:
            self[word] = h
        return h


def signatures(text: str, known: Hashes, chain: int = CHAIN) -> np.ndarray:
    """Sorted distinct signatures of a whole text."""
    words = _WORD.findall(text.lower())
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    anchor = (h & np.uint64(1)).astype(bool)
    content = h[~anchor]
    place = np.flatnonzero(anchor)
    ahead = place - np.arange(len(place))  # content words before each anchor
    full = ahead + chain <= len(content)
    place, ahead = place[full], ahead[full]
    if len(place):
        s = h[place] * _MIX[0]
        for k in range(chain):
            s = (s ^ (s >> np.uint64(29)) ^ content[ahead + k]) * _MIX[1 + k % 2]
    elif len(words):
        s = h * _MIX[0]
    else:
        s = np.array([xxhash.xxh64_intdigest(text)] if text else [], np.uint64)
    return np.unique(s ^ (s >> np.uint64(32)))


def as_text(signature: np.ndarray) -> str:
    """Sixteen hex digits a signature, ascending."""
    return signature.astype(">u8").tobytes().hex()


def length_class(n: int, least: float = LEAST) -> int:
    """Partition of a set length: each is 1 / least times as long as the one before; -1 for the empty set."""
    k = -1
    while n > 0:
        n, k = int(n * least), k + 1
    return k


def likeness(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> float:
    """Jaccard ratio of two sorted sets, or 0 if it is below least. The smaller set is counted stretch by stretch; as soon as even all that is left of it
    can't make up for what was missed, the rest is not looked at."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(large):
        return 1.0
    if not len(small) or (least and abs(length_class(len(small), least) - length_class(len(large), least)) > 1) or len(small) < least * len(large):
        return 0.0
    both, total = 0, len(small) + len(large)
    for k in range(0, len(small), STRETCH):
        own = small[k : k + STRETCH]
        at = np.minimum(np.searchsorted(large, own), len(large) - 1)
        both += int(np.count_nonzero(large[at] == own))
        most = both + len(small) - k - len(own)
        if most < least * (total - most):
            return 0.0
    return both / (total - both)


def edited(text: str, following: str) -> str:
    """The last quarter of a text replaced by the first as many code points (or all) of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


FINGERPRINTED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures long, length_class int"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_signatures", pa.int64()), ("length_class", pa.int32())])


def followed(documents: DataFrame) -> DataFrame:
    """slot, ghost, doc_id, text, sorted in each partition: runs of the order in slots, each followed by a ghost: the row that comes next.

    Slots are cut at quantiles of doc_id; a doc_id (or null) that fills several slots' share by itself is cut further by the hash that orders its rows. Each
    slot's count and first row's key are fetched (some numbers a slot), texts are shuffled once.
    """
    rows = only(documents, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("h", F.xxhash64("text"))
    n = parts(rows)
    ids = rows.select(F.col("doc_id").cast("double").alias("at"))
    found = Counter(ids.stat.approxQuantile("at", [k / (4 * n) for k in range(1, 4 * n)], 1 / (16 * n)))
    cuts = sorted({*found, *(math.nextafter(at, math.inf) for at, times in found.items() if times > 1)})  # an id that is several quantiles gets a slot to itself
    cutter = Bucketizer(splits=[-float("inf"), *(cuts or [0.0]), float("inf")], inputCol="at", outputCol="cut", handleInvalid="keep")
    cut = lambda df: cutter.transform(df.withColumn("at", F.col("doc_id").cast("double"))).withColumn("slot", F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("cut")).cast("long")).drop("at", "cut")
    keyed = cut(rows.select("doc_id", "h"))
    counts = keyed.groupBy("slot").agg(F.count("*").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).collect()
    even = max(1, sum(r.n for r in counts) // (4 * n))
    heavy = {r.slot: -(-r.n // even) for r in counts if r.n > 4 * even and r.a == r.b}
    many = F.lit(1)
    for slot, k in heavy.items():
        many = F.when(F.col("slot") == slot, k).otherwise(many)
    sub = F.least(many - 1, F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * many)).cast("long")
    heads = sorted(keyed.withColumn("sub", sub).groupBy("slot", "sub").agg(F.min(F.struct("doc_id", "h")).alias("first")).collect(), key=lambda r: (r.slot, r.sub))
    to = [(r.slot, r.sub, k, r.first.doc_id, r.first.h, (k - 1) % len(heads), 1 if k else 2) for k, r in enumerate(heads)]
    heads_df = rows.sparkSession.createDataFrame(to, "h_slot long, h_sub long, g long, head long, head_h long, h_to long, h_ghost long")
    marked = cut(rows).withColumn("sub", sub).join(F.broadcast(heads_df), (F.col("slot") == F.col("h_slot")) & (F.col("sub") == F.col("h_sub")))
    own = F.struct(F.col("g").alias("slot"), F.lit(0).cast("long").alias("ghost"))
    is_head = F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("h") == F.col("head_h"))
    dealt = marked.withColumn("to", F.explode(F.when(is_head, F.array(own, F.struct(F.col("h_to").alias("slot"), F.col("h_ghost").alias("ghost")))).otherwise(F.array(own))))
    dealt = dealt.select("to.slot", "to.ghost", "doc_id", "text", "h")
    return dealt.repartition(n, "slot").sortWithinPartitions("slot", "ghost", "doc_id", "h", "text").select("slot", "ghost", "doc_id", "text")


def with_edits(documents: DataFrame, anchors: frozenset[str] = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """FINGERPRINTED: each document's fingerprint against its edited text's and the next document's."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes(anchors)
        out: list[list] = [[] for _ in _ARROW]

        def flush():
            b = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _ARROW, strict=True)], schema=_ARROW)
            for c in out:
                c.clear()
            return b

        at, previous = None, None
        for b in batches:
            for k in range(b.num_rows):
                slot, ghost, doc, text = (c[k].as_py() for c in b.columns)
                if slot != at:
                    at, previous = slot, None
                if ghost and previous is None:
                    continue
                own = signatures(text, known, chain)
                if previous is not None:
                    p_doc, p_text, p_own = previous
                    changed = edited(p_text, text)
                    other = signatures(changed, known, chain)
                    row = (p_doc, len(p_text), hashlib.sha256(changed.encode()).hexdigest(), as_text(p_own), as_text(other), likeness(p_own, other), likeness(p_own, own), len(p_own), length_class(len(p_own)))
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
                    if len(out[0]) == 256:
                        yield flush()
                previous = None if ghost else (doc, text, own)
        if out[0]:
            yield flush()

    return followed(documents).mapInArrow(make, FINGERPRINTED)


def signature_sets(documents: DataFrame, anchors: frozenset[str] = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """doc_id, tokens (array<long>, sorted) for each row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes(anchors)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                sets = [signatures(t or "", known, chain).view(np.int64) for t in part.column(1).to_pylist()]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), tokens], names=["doc_id", "tokens"])

    return only(documents, doc_id="long", text="string").mapInArrow(make, "doc_id long, tokens array<long>")


def similar(documents: DataFrame, over: int = 4, under: int = 5) -> tuple[DataFrame, DataFrame]:
    """(classes, pairs). classes: doc_id, class_id (least doc_id of those with an equal fingerprint). pairs: a, b, likeness of two classes with a
    likeness of over / under at least.

    Fingerprints are partitioned by set length, each partition over / under as long as the next, so that likes lie in the same partition or in neighbouring ones; within
    them, classes meet on the rarest signatures of each (as many as two likes must share one of), and length and place prune before sets are compared.
    """
    made = checkpoint(signature_sets(documents).withColumn("key", F.md5(F.array_join("tokens", ","))))
    sets = made.groupBy("key").agg(F.min("doc_id").alias("id"), F.first("tokens").alias("tokens")).filter(F.size("tokens") > 0).withColumn("n", F.size("tokens"))
    each = sets.select("id", "n", F.explode("tokens").alias("token"))
    seen = each.groupBy("token").count()
    place = F.row_number().over(Window.partitionBy("id").orderBy("count", "token"))
    prefix = each.join(seen.filter("count > 1"), "token").withColumn("place", place)  # a signature of one class leads to no other
    alone = each.join(seen.filter("count = 1"), "token", "left_semi").groupBy("id").agg(F.count("*").alias("rare"))
    prefix = prefix.join(alone, "id", "left").withColumn("place", F.col("place") + F.coalesce("rare", F.lit(0)) - 1)
    prefix = prefix.filter(F.col("place") < F.col("n") - F.ceil(F.col("n") * over / under) + 1)
    prefix = prefix.withColumn("part", F.floor(F.log(F.col("n")) / F.log(F.lit(under / over)) + F.lit(1e-9)))
    small = prefix.select("token", F.col("id").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    large = prefix.select("token", "part", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"))
    met = small.join(large, ["token", "part"]).filter("na < nb OR na = nb AND a < b")
    met = met.filter((F.col("na") * under >= F.col("nb") * over) & (F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) * (over + under) >= (F.col("na") + F.col("nb")) * over)).select("a", "b").distinct()
    side = lambda c: sets.select(F.col("id").alias(c), F.col("tokens").alias(f"t{c}"))
    both = met.join(side("a"), "a").join(side("b"), "b").withColumn("both", F.size(F.array_intersect("ta", "tb")))
    pairs = both.withColumn("likeness", F.col("both") / (F.size("ta") + F.size("tb") - F.col("both"))).filter((F.size("ta") + F.size("tb")) * over <= F.col("both") * (over + under))
    classes = made.join(made.groupBy("key").agg(F.min("doc_id").alias("class_id")), "key").select("doc_id", "class_id")
    return classes, pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness")
