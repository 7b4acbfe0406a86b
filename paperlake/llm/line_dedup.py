"""Line dedup by an exact set-similarity join.

A line's tokens are the hashes of its 5-word shingles. A line is removed if an earlier line (by doc_id, then text key, then line number) has the same words or a Jaccard
ratio of at least 4/5 with it. Lines of the same words, however few, are found by their hash. For the rest, tokens are ordered by rarity, and lines meet where
their prefixes share a token and the length and positional filters allow the ratio; then the ratio is verified on whole token sets.

Rarity comes from a frequency sketch of fixed size (2^20 counters, summed over all lines): it only orders tokens, so its collisions cost
time, never results. Prefix entries travel in packed blocks, one a bucket of tokens, with as many buckets as keep each small. Runs of few lines give candidate pairs; of a
longer run (``RUN``) only membership is passed on, and its lines are verified where they meet, earliest mates first: no group emits its pairs.
A run longer than ``TILE`` is dealt to pairs of tiles, each of which meets in a task of its own; a token too frequent even to gather its entries (``WIDE``) is
dealt so before they meet. Whole token sets are made again, in the tasks that read the texts, of the lines that a filter of bounded size lets through. A line that very many documents hold is marked by a broadcast of such lines (at most eight a partition, by a count), the others by a shuffle.

Defined results: a line of one to four words has no shingle and goes only if an earlier line has the same
words. Lines without a word are kept, as are null and empty texts; documents that agree in doc_id and text
are one (their rows come out alike); a line's first occurrence stays unless it is near an earlier line, so a document may lose lines to itself; an
empty table gives an empty result; extra columns are carried by ``clean`` and ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, join_hot, only, parts

SHINGLE = 5
#: Least Jaccard ratio, as a fraction.
OVER, UNDER = 4, 5
COUNTERS = 1 << 20
CHUNK = 1 << 14
RUN = 32
TILE = 2048
WIDE = 1 << 22
MOST_BITS = 1 << 27
#: Prefix entries in a bucket, about, and bytes of text taken at a time.
BUCKET, BYTES_AT_ONCE = 400_000, 1_200_000
_ENTRY = np.dtype([("token", "<u8"), ("line", "<i8"), ("size", "<u2"), ("place", "<u2")])
#: As it travels: a bucket and half of a token's bits name it well enough; lines that meet by chance are told apart when their sets are compared.
_PACKED = np.dtype([("token", "<u4"), ("line", "<i8"), ("size", "<u2"), ("place", "<u2")])
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def _powers(n: int) -> np.ndarray:
    """Powers of an odd number, at least n of them; kept for the next call."""
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.multiply.accumulate(np.full(max(n, 256), np.uint64(0xD6E8FEB86659FD93)))
    return _POWERS


_POWERS = np.zeros(0, np.uint64)
#: A fixed random number for each byte, and which bytes are white space.
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


class Lines:
    """The lines with ``least`` words or more of a run of documents: doc (place in the run), number, hash, and all shingles with their line.

    Words are hashed by columns: a byte's number times a power of its place in the word, summed over the word.
    """

    def __init__(self, texts: list[bytes], least: int = SHINGLE):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        space, breaks = _SPACE[raw], np.flatnonzero(raw == 10)
        begins = ~space
        begins[1:] &= space[:-1]
        start = np.flatnonzero(begins)
        if len(start):
            length = np.diff(np.append(start, len(raw)))
            place = np.arange(start[0], len(raw)) - np.repeat(start, length)
            value = _BYTE[raw[start[0] :]] * _powers(int(length.max()))[place]
            value[space[start[0] :]] = 0
            h = mixed(np.add.reduceat(value, start - start[0]))
        else:
            h = np.zeros(0, np.uint64)
        line = np.searchsorted(breaks, start)  # of each word, counted over the run
        of = np.bincount(line, minlength=len(breaks))
        per = np.fromiter((t.count(b"\n") + 1 for t in texts), np.int64, len(texts))
        first = np.cumsum(per) - per
        kept = np.flatnonzero(of >= least)
        self.doc = np.searchsorted(first, kept, side="right") - 1
        self.number = kept - first[self.doc] if len(kept) else kept
        use = of[line] >= least
        h, size = h[use], of[kept]
        start = np.cumsum(size) - size
        place = np.arange(len(h)) - np.repeat(start, size)
        self.hash = np.add.reduceat(mixed(h + _ODD * place.astype(np.uint64)), start).view(np.int64) if len(h) else np.zeros(0, np.int64)
        line = np.repeat(np.arange(len(size)), size)
        n = max(0, len(h) - SHINGLE + 1)
        token = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            token = mixed(token + h[k : k + n] + _ODD)
        whole = line[:n] == line[SHINGLE - 1 :]
        self.token, self.line = token[whole], line[:n][whole]


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches whose second column holds about BYTES_AT_ONCE of text."""
    for b in batches:
        at, held, size = 0, [], 0
        for k in range(b.num_rows):
            text = b.column(1)[k].as_py() or b""
            held.append(text)
            size += len(text)
            if size > BYTES_AT_ONCE:
                yield b.slice(at, k + 1 - at), held
                at, held, size = k + 1, [], 0
        if held:
            yield b.slice(at), held


def _texts(documents: DataFrame) -> DataFrame:
    return only(documents, doc_id="long", text="string").select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("key"))


def survey(documents: DataFrame) -> DataFrame:
    """In one pass, a row for each line (doc_id, key, number, line) and, with a chunk number, rows of the frequency sketch (number: how many lines were seen)."""
    names = ["doc_id", "key", "number", "line", "chunk", "counts"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, lines = np.zeros(COUNTERS, np.int64), 0
        for b, texts in runs(batches):
            found = Lines(texts, 1)
            lines += len(found.hash)
            counts += np.bincount((found.token & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
            n = len(found.doc)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(found.doc)), b.column(2).take(pa.array(found.doc)), pa.array(found.number), pa.array(found.hash), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=names)
        if lines:
            n = COUNTERS // CHUNK
            blocks = pa.array([c.astype("<u4").tobytes() for c in counts.reshape(n, CHUNK)], pa.binary())
            numbers = pa.array([lines] + [0] * (n - 1))
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64())] * 2 + [numbers, pa.nulls(n, pa.int64()), pa.array(np.arange(n)), blocks], names=names)

    return _texts(documents).mapInArrow(make, "doc_id long, key long, number long, line long, chunk long, counts binary")


def frequencies(surveyed: DataFrame) -> tuple[np.ndarray, int, int]:
    """The sketch, summed: one byte a counter, its rank on a scale of quarter doublings (2^20 bytes whatever the input); and the numbers of tokens and of lines."""

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), "<u4").astype(np.int64) for x in t["counts"])
        level = np.minimum(255, np.round(4 * np.log2(1 + total))).astype(np.uint8)
        return pa.table({"chunk": t["chunk"][:1], "counts": pa.array([level.tobytes()], pa.binary()), "total": [int(total.sum())], "lines": [sum(t["number"].to_pylist())]})

    out, tokens, lines = np.zeros((COUNTERS // CHUNK, CHUNK), np.uint8), 0, 0
    for r in surveyed.filter("chunk is not null").select("chunk", "counts", "number").groupBy("chunk").applyInArrow(add, "chunk long, counts binary, total long, lines long").collect():
        out[r.chunk] = np.frombuffer(r.counts, np.uint8)
        tokens += r.total
        lines += r.lines
    return out.reshape(-1), tokens, lines


def ordered(token: np.ndarray, line: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of each line, rarest first, and their lines (ascending)."""
    rank = level[(token & np.uint64(COUNTERS - 1)).astype(np.int64)]
    # line, rank and half of the token in one number sort several times faster; should two tokens of a line agree in that half, all three are sorted in full
    short = (line.astype(np.uint64) << np.uint64(40)) | (rank.astype(np.uint64) << np.uint64(32)) | (token >> np.uint64(32))
    by = np.argsort(short)
    same = short[by[1:]] == short[by[:-1]]
    if (token[by[1:]] != token[by[:-1]])[same].any() or (len(line) and line.max() >= 1 << 24):
        by = np.lexsort((token, rank, line))
    token, line = token[by], line[by]
    new = np.concatenate(([True], (token[1:] != token[:-1]) | (line[1:] != line[:-1]))) if len(token) else np.zeros(0, bool)
    return token[new], line[new]


def fresh(found: Lines, seen: set[int]) -> np.ndarray:
    """Which lines are the first of their hash in a task; seen holds the hashes so far."""
    _, first = np.unique(found.hash, return_index=True)
    out = np.zeros(len(found.hash), bool)
    out[[k for k in first.tolist() if (h := int(found.hash[k])) not in seen and not seen.add(h)]] = True
    return out


def to_tile_pairs(token: np.ndarray, line: np.ndarray, tiles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token of a tile pair, place of its member) so that any two lines of a token meet in at least one of its tile pairs, and none holds over two tiles."""
    at = np.repeat(np.arange(len(token)), tiles)
    mate = (np.arange(len(at)) - np.repeat(np.cumsum(tiles) - tiles, tiles)).astype(np.uint64)
    own = mixed(line.view(np.uint64) + _ODD)[at] % tiles[at].astype(np.uint64)
    pair = np.minimum(own, mate) * tiles[at].astype(np.uint64) + np.maximum(own, mate)
    return mixed(token.view(np.uint64)[at] + mixed(pair + _ODD)), at


def prefix_entries(documents: DataFrame, level: np.ndarray, buckets: int, wide: int = WIDE) -> DataFrame:
    """bucket, entries: packed prefix entries of every line (of equal lines in a task, once)."""
    shared = documents.sparkSession.sparkContext.broadcast(level)
    tiles_of = np.ceil(2.0 ** (np.arange(256) / 4) / wide).astype(np.int64)  # by level; 1 but for very frequent tokens

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = set(), [], 0
        for _, texts in runs(batches):
            found = Lines(texts)
            own = fresh(found, seen)[found.line]
            token, line = ordered(found.token[own], found.line[own], shared.value)
            n = np.bincount(line, minlength=len(found.hash))
            place = np.arange(len(token)) - (np.cumsum(n) - n)[line]
            prefix = n - -(-OVER * n // UNDER) + 1
            use = place < prefix[line]
            e = np.zeros(int(use.sum()), _ENTRY)
            e["token"], e["line"] = token[use], found.hash[line[use]]
            e["size"], e["place"] = np.minimum(n[line[use]], 65535), np.minimum(place[use], 65535)
            tiles = tiles_of[shared.value[(e["token"] & np.uint64(COUNTERS - 1)).astype(np.int64)]]
            if len(e) and tiles.max() > 1:
                to, at = to_tile_pairs(e["token"], e["line"], tiles)
                e = e[at]
                e["token"] = to
            held.append(e)
            size += len(e)
            if size > BUCKET:
                yield from deal(held)
                held, size = [], 0
        yield from deal(held)

    def deal(held):
        e = np.concatenate(held) if held else np.zeros(0, _ENTRY)
        to = (mixed(e["token"]) % np.uint64(buckets)).astype(np.int64)
        packed = np.zeros(len(e), _PACKED)
        for name in ("line", "size", "place"):
            packed[name] = e[name]
        packed["token"] = (e["token"] >> np.uint64(32)).astype(np.uint32)
        e, edge = packed[np.argsort(to, kind="stable")], np.concatenate(([0], np.cumsum(np.bincount(to, minlength=buckets))))
        full = np.flatnonzero(np.diff(edge))
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array([e[edge[k] : edge[k + 1]].tobytes() for k in full], pa.binary())], names=["bucket", "entries"])

    return _texts(documents).mapInArrow(make, "bucket long, entries binary")


def meetings(e: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From a bucket's entries: candidate pairs (x, y) of short runs, and members (token, line) of long ones."""
    e = e[np.lexsort((e["line"], e["token"]))]
    if len(e):
        e = e[np.concatenate(([True], (e["token"][1:] != e["token"][:-1]) | (e["line"][1:] != e["line"][:-1])))]
    edge = np.flatnonzero(np.concatenate(([True], e["token"][1:] != e["token"][:-1], [True]))) if len(e) else np.zeros(1, np.int64)
    size = np.diff(edge)
    long = np.repeat(size > run, size)
    pairs = []
    for step in range(1, run):  # each entry with the step-th after it in its run
        start = edge[:-1][(size > step) & (size <= run)]
        many = size[(size > step) & (size <= run)] - step
        if not len(start):
            break
        a = np.repeat(start, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        x, y = e[a], e[a + step]
        nx, ny = x["size"].astype(np.int64), y["size"].astype(np.int64)
        reach = np.minimum(nx - x["place"], ny - y["place"])  # if this is their first common token
        ok = (UNDER * np.minimum(nx, ny) >= OVER * np.maximum(nx, ny)) & ((OVER + UNDER) * reach >= OVER * (nx + ny)) | (nx == 65535) | (ny == 65535)
        pairs.append(np.stack([x["line"][ok], y["line"][ok]]))
    p = np.unique(np.sort(np.concatenate(pairs, axis=1), axis=0), axis=1) if pairs else np.zeros((2, 0), np.int64)
    return p[0], p[1], e["token"][long].view(np.int64), e["line"][long]


def candidates(entries: DataFrame, run: int = RUN, tile: int = TILE) -> DataFrame:
    """x, y for candidate pairs; token, x for members of long runs (or of a tile pair of one)."""

    def meet(t: pa.Table) -> pa.Table:
        packed = np.concatenate([np.frombuffer(b.as_py(), _PACKED) for b in t["entries"]])
        e = np.zeros(len(packed), _ENTRY)
        for name in ("line", "size", "place"):
            e[name] = packed[name]
        e["token"] = mixed(packed["token"].astype(np.uint64) + mixed(np.full(1, t["bucket"][0].as_py(), np.uint64) + _ODD))
        x, y, token, line = meetings(e, run)
        _, of, size = np.unique(token, return_inverse=True, return_counts=True)
        tiles = -(-size // tile)[of] if len(token) else np.zeros(0, np.int64)
        if len(token) and tiles.max() > 1:
            to, at = to_tile_pairs(token, line, tiles)
            token, line = np.where(tiles[at] > 1, to.view(np.int64), token[at]), line[at]
        none = lambda n: pa.nulls(n, pa.int64())
        return pa.table({"token": pa.concat_arrays([none(len(x)), pa.array(token)]), "x": np.concatenate((x, line)), "y": pa.concat_arrays([pa.array(y), none(len(token))])})

    return entries.groupBy("bucket").applyInArrow(meet, "token long, x long, y long")


def places(line: np.ndarray, bits: int) -> np.ndarray:
    """The two places of each line's hash in a filter of so many bits (a power of two)."""
    h = line.view(np.uint64)
    return np.concatenate((h, h >> np.uint64(32))) & np.uint64(bits - 1)


def line_filter(wanted: DataFrame, n: int, most: int = MOST_BITS) -> np.ndarray:
    """A Bloom filter of the n lines wanted, as bytes: eight bits a line, at most MOST_BITS (16 MB). Fuller than that it lets more lines through, which costs time and loses none."""
    bits = min(most, 1 << max(10, (8 * n).bit_length()))
    chunk = min(bits // 8, CHUNK)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits, bool)
        for b in batches:
            held[places(b.column(0).to_numpy(), bits).astype(np.int64)] = True
        packed = np.packbits(held, bitorder="little").reshape(-1, chunk)
        full = np.flatnonzero(packed.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array([packed[k].tobytes() for k in full], pa.binary())], names=["chunk", "bits"])

    def either(t: pa.Table) -> pa.Table:
        out = np.bitwise_or.reduce([np.frombuffer(x.as_py(), np.uint8) for x in t["bits"]])
        return pa.table({"chunk": t["chunk"][:1], "bits": pa.array([out.tobytes()], pa.binary())})

    out = np.zeros((bits // 8 // chunk, chunk), np.uint8)
    for r in wanted.select("line").mapInArrow(mark, "chunk long, bits binary").groupBy("chunk").applyInArrow(either, "chunk long, bits binary").collect():
        out[r.chunk] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def token_sets(documents: DataFrame, passing: np.ndarray) -> DataFrame:
    """line, tokens for the lines that pass a filter, once a task, read again where the texts are: no text is shuffled."""
    shared = documents.sparkSession.sparkContext.broadcast(passing)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        bits = 8 * len(shared.value)
        for _, texts in runs(batches):
            found = Lines(texts)
            at = places(found.hash, bits).astype(np.int64)
            hit = (shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            n = len(found.hash)
            kept = (hit[:n] & hit[n:]).astype(bool)
            kept &= fresh(found, seen)
            own = kept[found.line]
            token, line = found.token[own], found.line[own]
            by = np.lexsort((token, line))
            line, token = line[by], token[by]
            new = np.concatenate(([True], (token[1:] != token[:-1]) | (line[1:] != line[:-1]))) if len(token) else np.zeros(0, bool)
            line, token = line[new], token[new]
            size = np.bincount(line, minlength=n)[kept]
            offset = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(found.hash[kept]), pa.ListArray.from_arrays(pa.array(offset), pa.array(token.view(np.int64)))], names=["line", "tokens"])

    return _texts(documents).mapInArrow(make, "line long, tokens array<long>")


def near_earlier(sets: list[np.ndarray]) -> list[int]:
    """Which of the sets, in order, has an earlier one within the ratio; earliest blocks are tried first."""
    flat, own = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(s) for s in sets])
    stop = np.cumsum(size)
    start, mark, out = stop - size, np.zeros(len(flat), np.int64), []
    for j in range(1, len(sets)):
        mine = own[start[j] : stop[j]]
        mark[mine] = 1
        for i in range(0, j, 512):
            k = min(j, i + 512)
            both = np.add.reduceat(mark[own[start[i] : stop[k - 1]]], start[i:k] - start[i])
            if ((OVER + UNDER) * both >= OVER * (size[i:k] + size[j])).any():
                out.append(j)
                break
        mark[mine] = 0
    return out


def removed_lines(documents: DataFrame, run: int = RUN, tile: int = TILE, wide: int = WIDE) -> DataFrame:
    """doc_id, key, number, near for every line to remove; near: not for an equal line alone."""
    surveyed = checkpoint(survey(documents))
    lines = surveyed.filter("chunk is null").select("doc_id", "key", "number", "line")
    place = F.struct(F.col("doc_id").isNotNull().alias("id"), "doc_id", "key", "number")
    first = lines.groupBy("line").agg(F.min(place).alias("first"))
    level, tokens, n_lines = frequencies(surveyed)
    buckets = max(4 * parts(documents), tokens // (4 * BUCKET))  # a prefix is about a fifth of a line's tokens
    met = checkpoint(candidates(prefix_entries(documents, level, buckets, wide), run, tile).distinct())
    pairs, members = met.filter("token is null").select("x", "y"), met.filter("token is not null").select("token", F.col("x").alias("line"))
    wanted = checkpoint(met.select(F.col("x").alias("line")).unionByName(met.filter("y is not null").select(F.col("y").alias("line"))).distinct())
    read = token_sets(documents, line_filter(wanted, wanted.count()))
    sets = checkpoint(read.join(wanted, "line", "left_semi").dropDuplicates(["line"]).join(first, "line"))
    side = lambda n: sets.select(F.col("line").alias(n), F.col("tokens").alias(f"t{n}"), F.col("first").alias(f"f{n}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y").filter(F.size(F.array_intersect("tx", "ty")) * (OVER + UNDER) >= OVER * (F.size("tx") + F.size("ty")))
    lost = both.select(F.when(F.col("fx") > F.col("fy"), F.col("x")).otherwise(F.col("y")).alias("line"))
    grouped = members.join(sets, "line").repartition(parts(members), "token").sortWithinPartitions("token", "first").select("token", "line", "tokens")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def done():
            own = [held[j][0] for j in near_earlier([s for _, s in held])] if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array(own, pa.int64())], names=["line"])

        for b in batches:
            for k in range(b.num_rows):
                token, line = b.column(0)[k].as_py(), b.column(1)[k].as_py()
                if token != at:
                    yield done()
                    at, held = token, []
                held.append((line, b.column(2)[k].values.to_numpy()))
        yield done()

    lost = checkpoint(lost.unionByName(grouped.mapInArrow(verify, "line long")).distinct()).withColumn("near", F.lit(True))
    judged = join_hot(lines, first.join(lost, "line", "left"), "line", lines.groupBy("line").agg(F.count("*").alias("n")), n_lines)
    return judged.filter(F.col("near").isNotNull() | (place != F.col("first"))).select("doc_id", "key", "number", F.coalesce("near", F.lit(False)).alias("near")).distinct()


def _per_document(documents: DataFrame) -> DataFrame:
    gone = removed_lines(documents)
    return gone.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list("number")).alias("removed"), F.count_if("near").alias("n_near")).withColumnsRenamed({"doc_id": "__paperlake_doc", "key": "__paperlake_key", "removed": "__paperlake_removed", "n_near": "__paperlake_near"})


def summary(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, n_near, removed (line numbers from 0, comma-joined) for each row."""
    rows = only(documents, doc_id="long", text="string").select("doc_id", F.xxhash64("text").alias("key"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"))
    out = rows.join(_per_document(documents), F.col("doc_id").eqNullSafe(F.col("__paperlake_doc")) & (F.col("key") == F.col("__paperlake_key")), "left")
    removed = F.coalesce("__paperlake_removed", F.array().cast("array<long>"))
    return out.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), F.coalesce("__paperlake_near", F.lit(0)).cast("long").alias("n_near"), F.array_join(removed.cast("array<string>"), ",").alias("removed"))


def clean(documents: DataFrame) -> DataFrame:
    """The documents without their removed lines, with their columns; those that lost every word are left out."""
    rows = documents.withColumn("__paperlake_text_key", F.xxhash64(F.col("text")))
    out = rows.join(_per_document(documents.select("doc_id", "text")), F.col("doc_id").eqNullSafe(F.col("__paperlake_doc")) & (F.col("__paperlake_text_key") == F.col("__paperlake_key")), "left")
    left = F.array_join(F.filter(F.split(F.col("text"), "\n"), lambda x, i: ~F.array_contains("__paperlake_removed", i.cast("long"))), "\n")
    out = out.withColumn("text", F.when(F.col("__paperlake_removed").isNull(), F.col("text")).otherwise(left))
    return out.filter(F.col("__paperlake_removed").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*[f"`{c}`" for c in documents.columns])


#: Every pair of different lines that share a shingle, counted by a join; for small tables.
SQL = r"""
WITH l AS (SELECT doc_id, k - 1 AS number, array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' ') AS words FROM documents, unnest(string_split(coalesce(text, ''), chr(10))) WITH ORDINALITY AS u(line, k)),
p AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, number) AS place FROM l WHERE words <> ''),
d AS (SELECT words, min(place) AS first FROM p GROUP BY words),
w AS (SELECT first, string_split(words, ' ') AS w FROM d),
s AS (SELECT DISTINCT first, array_to_string(w[i:i+4], ' ') AS gram FROM (SELECT first, w, unnest(generate_series(1, len(w) - 4)) AS i FROM w)),
n AS (SELECT first, count(*) AS n FROM s GROUP BY first),
met AS (SELECT a.first AS x, b.first AS y, count(*) AS both_have FROM s a JOIN s b ON a.gram = b.gram AND a.first < b.first GROUP BY ALL),
near AS (SELECT DISTINCT y AS first FROM met JOIN n nx ON nx.first = x JOIN n ny ON ny.first = y WHERE 5 * both_have >= 4 * (nx.n + ny.n - both_have)),
gone AS (SELECT p.doc_id, p.number, near.first IS NOT NULL AS near FROM p JOIN d USING (words) LEFT JOIN near ON near.first = d.first WHERE near.first IS NOT NULL OR p.place <> d.first),
g AS (SELECT doc_id, count(*) AS n, count(*) FILTER (near) AS near, string_agg(number, ',' ORDER BY number) AS removed FROM gone GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_lines FROM l GROUP BY doc_id)
SELECT t.doc_id, t.n_lines::BIGINT AS n_lines, coalesce(g.n, 0)::BIGINT AS n_removed, coalesce(g.near, 0)::BIGINT AS n_near, coalesce(g.removed, '') AS removed FROM t LEFT JOIN g ON t.doc_id IS NOT DISTINCT FROM g.doc_id
"""
