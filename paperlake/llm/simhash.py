"""SimHash near-duplicates, compared bit-sliced.

Fingerprints: 64 bits from 4-word shingles. Equal fingerprints are one node. Two nodes within ``RADIUS`` bits agree exactly on at least one of
RADIUS + 1 bit blocks (on some combination of blocks where more are needed to keep buckets small), so each node goes to one bucket a block and only bucket
mates are compared: no link is lost. A bucket's fingerprints are stored as vertical bit planes, 64 to a word; a query is
compared with 64 at once by XOR of plane after plane into carry-save counters, and words in which every lane has passed the radius are
abandoned. A bucket larger than ``TILE`` is dealt to pairs of tiles. A task returns each node's least mate in reach (a
spanning forest), never the pairs.

Defined results: null and empty texts have fingerprint zero, which links like any other; texts are read whole; a document's component is the least
doc_id reachable (null only if no member has one); repeated rows are nodes of their own with the same result; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, join_hot, only, parts
from .components import connected

BITS = 64
RADIUS = 4
SHINGLE = 4
SEED = 42
TILE = 4096
#: (query, word of 64 lanes) pairs compared at a time.
AT_ONCE = 1 << 16


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """Of a text in UTF-8. bytes.lower() and bytes.split() know A-Z and the six ASCII spaces only, as wanted."""
    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    stops = np.cumsum(size)
    starts, ends = (stops - size)[:n].tolist(), (stops[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, n)
    count = np.zeros(BITS, np.int64)
    for k in range(0, n, 1 << 14):
        own = hashes[k : k + (1 << 14)]
        count += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * count > n).tolist())


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) for each row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1)
            found = np.fromiter((fingerprint(texts[i].as_py() or b"") for i in range(len(texts))), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64)), b.column(2)], names=["doc_id", "fp", "key"])

    rows = only(documents, doc_id="long", text="string").withColumn("key", F.xxhash64("text"))
    return rows.select("doc_id", F.col("text").cast("binary").alias("text"), "key").mapInArrow(make, "doc_id long, fp long, key long")


def block_masks(nodes: int, radius: int = RADIUS, tile: int = TILE) -> list[int]:
    """Bit masks of which two fingerprints within the radius share at least one exactly. More, longer keys for more nodes: with b blocks,
    any b - radius of them, b the least for which a bucket of chance mates stays below a tile."""
    for b in range(radius + 1, 2 * radius + 5):
        edges = [BITS * i // b for i in range(b + 1)]
        blocks = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(b)]
        masks = [sum(c) for c in combinations(blocks, b - radius)]
        if nodes >> min(m.bit_count() for m in masks) <= tile // 8:
            break
    return masks


def within(values: np.ndarray, bucket: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each value, the place of the first of its component; places of one bucket follow one another, and only they are compared."""
    n = len(values)
    parent = np.arange(n)
    edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
    size = np.diff(edge)
    words = -(-size // 64)
    # lane of each value: buckets begin at a word of their own
    first_word = np.cumsum(words) - words
    of = np.repeat(np.arange(len(size)), size)
    lane = np.arange(n) - edge[:-1][of] + 64 * first_word[of]
    at = np.full(64 * int(words.sum()), -1)
    at[lane] = np.arange(n)
    laid = np.zeros(len(at), np.uint64)
    laid[lane] = values
    # vertical bit planes: bit k of plane[p][w] is bit p of lane k of word w
    bits = np.unpackbits(laid.view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    plane = np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little").transpose(2, 0, 1)).view(np.uint64)[:, :, 0]
    used = np.packbits((at >= 0).reshape(-1, 64), axis=1, bitorder="little").view(np.uint64)[:, 0]
    each = words[of]
    start = np.cumsum(each) - each
    cuts = [0, *np.flatnonzero(np.diff(start // AT_ONCE)) + 1, n]
    for i, j in zip(cuts, cuts[1:], strict=False):
        query = np.repeat(np.arange(i, j), each[i:j])
        word = first_word[of[query]] + np.arange(len(query)) - np.repeat(np.cumsum(each[i:j]) - each[i:j], each[i:j])
        near = ~used[word]  # lanes without a value count as passed
        ones, twos, fours = (np.zeros(len(query), np.uint64) for _ in range(3))
        q = values[query]
        for p in range(BITS):
            differ = plane[p][word] ^ (np.uint64(0) - ((q >> np.uint64(p)) & np.uint64(1)))
            carry = ones & differ
            ones ^= differ
            carry2 = twos & carry
            twos ^= carry
            near |= fours & carry2  # eight or more
            fours ^= carry2
            near |= over(ones, twos, fours, radius)
            if p % 8 == 7 and p > 12:
                live = np.flatnonzero(~near)
                if 2 * len(live) < len(near):
                    query, word, near, ones, twos, fours, q = (x[live] for x in (query, word, near, ones, twos, fours, q))
        hit = ~near
        live = np.flatnonzero(hit)
        lanes = np.unpackbits(hit[live].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, bit = np.nonzero(lanes)
        union(parent, query[live[row]], at[64 * word[live[row]] + bit])
    return flat(parent)


def over(ones: np.ndarray, twos: np.ndarray, fours: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose three-bit count is above radius (0 to 6)."""
    above, equal = np.zeros_like(ones), np.full_like(ones, ~np.uint64(0))
    for bit, counter in ((4, fours), (2, twos), (1, ones)):
        if radius & bit:
            equal = equal & counter
        else:
            above |= equal & counter
            equal = equal & ~counter
    return above


def flat(parent: np.ndarray) -> np.ndarray:
    while not np.array_equal(up := parent[parent], parent):
        parent = up
    return parent


def union(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Join the classes of all pairs, in place; a class's root is its least place."""
    while len(u):
        parent[:] = flat(parent)
        a, b = parent[u], parent[v]
        open_ = a != b
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """u, v: a spanning forest of every bucket's links between the distinct fingerprints in column fp."""
    masks = block_masks(nodes.count(), radius, tile)
    rows = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks])).alias("block", "value"))
    rows = rows.withColumn("bucket", F.xxhash64("block", "value"))  # two buckets that fall together are compared together
    large = rows.groupBy("bucket").count().filter(F.col("count") > tile).select("bucket", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    tiled = rows.join(large, "bucket", "left").withColumn("tile", F.pmod(F.xxhash64("fp", F.lit(1)), F.coalesce("tiles", F.lit(1))).cast("int"))
    mates = F.when(F.col("tiles").isNull(), F.array(F.col("tile"))).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1))
    dealt = tiled.select("bucket", "tile", "fp", F.explode(mates).alias("mate")).select(F.xxhash64("bucket", F.least("tile", "mate"), F.greatest("tile", "mate")).alias("bucket"), "fp")
    dealt = dealt.repartition(parts(dealt), "bucket").sortWithinPartitions("bucket", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, fp in whole_buckets(batches):
            root = within(fp.view(np.uint64), bucket, radius)
            u = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[u]), pa.array(fp[root[u]])], names=["u", "v"])

    return dealt.mapInArrow(compare, "u long, v long").filter("u <> v").distinct()


def whole_buckets(batches: Iterator[pa.RecordBatch], most: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted rows (bucket, fp) in runs that never cut a bucket; buckets of one row are left out."""
    held_bucket, held_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in batches:
        held_bucket, held_fp = np.concatenate((held_bucket, b.column(0).to_numpy())), np.concatenate((held_fp, b.column(1).to_numpy()))
        if len(held_bucket) >= most and (cut := int(np.searchsorted(held_bucket, held_bucket[-1]))):
            yield from _shared(held_bucket[:cut], held_fp[:cut])
            held_bucket, held_fp = held_bucket[cut:], held_fp[cut:]
    yield from _shared(held_bucket, held_fp)


def _shared(bucket: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    same = bucket[1:] == bucket[:-1]
    keep = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(bucket) else np.zeros(0, bool)
    if keep.any():
        yield bucket[keep], fp[keep]


def components(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, key, root (a fingerprint that names the component), component_id for each row. Fingerprints of very many rows, and components of very many
    fingerprints, are joined by a broadcast of such ones (``join_hot``)."""
    made = checkpoint(fingerprints(documents))
    nodes = made.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    roots = connected(links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    nodes = checkpoint(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    of_root = nodes.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"), F.sum("n").alias("rows"))
    totals = of_root.agg(F.sum("n").alias("nodes"), F.sum("rows").alias("rows")).first()
    named = checkpoint(join_hot(nodes.select("fp", "root"), of_root.select("root", "component_id"), "root", of_root.select("root", "n"), totals.nodes or 0))
    return join_hot(made, named, "fp", nodes.select("fp", "n"), totals.rows or 0)


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id for each row."""
    return components(documents).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(documents: DataFrame) -> DataFrame:
    """One document of each component, with its columns: that of the least doc_id (of rows with the same doc_id, any one text)."""
    chosen = components(documents).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("m"))
    chosen = chosen.select(F.col("m.doc_id").alias("__paperlake_doc"), F.col("m.key").alias("__paperlake_key")).distinct()
    rows = documents.withColumn("__paperlake_text_key", F.xxhash64(F.col("text")))
    kept = rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("__paperlake_doc")) & (F.col("__paperlake_text_key") == F.col("__paperlake_key")), "left_semi")
    n = F.row_number().over(Window.partitionBy("doc_id", "__paperlake_text_key").orderBy(F.lit(0)))
    return kept.withColumn("__paperlake_n", n).filter("__paperlake_n = 1").select(*[f"`{c}`" for c in documents.columns])
