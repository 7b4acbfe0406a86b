"""Packing token sequences by best-fit decreasing.

Documents are tokenised and cut into full windows; what is left over of each (its tail) is packed into windows by best-fit
decreasing: tails go, longest first, to the open window with the least room that holds them, found in a segment tree over remaining
capacities. Tails are dealt at random to shards of about ``SHARD`` documents, each packed by itself: every task holds a bounded
number of small rows however large the input, and a shard of thousands of tails packs about as tightly as all of them together.

Token ids never leave the task that made them unless ``with_ids`` asks for them: a piece travels as its place, length and checksum.

Words repeat, so ids are looked up by word: the byte-level vocabulary's pre-tokeniser never joins what stands on either side of a single space or line feed
between two other characters, so a text split there has the ids of its parts one after another. Texts with any other white space (of whatever kind, or two beside each other, or at an end), and
texts with the end marker's own string, go to the tokenizers library whole. The lookup holds ``MEMO`` words at most.

Defined results: a null or empty text is the single end id; repeated rows are packed each for itself; an empty table gives no piece; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only

WINDOW = 2048
END_ID = 1
SHARD = 8192
MEMO = 150_000
#: What may follow a word's letters and still be looked up with them: characters that are neither letter, number nor space.
MARKS = ".,;:!?)\""
#: The byte-level vocabulary's public pre-tokeniser.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"
#: White space that isn't one blank or line feed between two other characters.
_ODD = re.compile(r"[^\S \n]|[ \n](?=[ \n])|\A[ \n]|[ \n]\Z")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, shard long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padded_length long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder(dict):
    """Text to little-endian 32-bit ids; as a dict, a word after a space to its ids.

    The tokenizers library encodes texts with its special token or with unusual white space. All other text goes through a table of merge ranks made from the same
    file's vocabulary, which gives the same ids several times faster (a byte-level vocabulary numbers its tokens in merge order; tests hold
    the two against each other).
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import tiktoken

        self.path = path
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = (b for b in range(256) if b not in set(printable))
        byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if token != SPECIAL}
        core = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.fast, self.single = core.encode_ordinary, core.encode_single_piece
        self.starts, self.tails, self.newline = {}, {}, self.plain("\n")

    @cached_property
    def tokenizer(self):
        """The library's own; made when the first text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def plain(self, text: str) -> bytes:
        return array("I", self.fast(text)).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.looked_up(word, " ", self)
        if len(self) < MEMO:
            self[word] = ids
        return ids

    def looked_up(self, word: str, before: str, known: dict) -> bytes:
        """The pre-tokeniser parts a word's letters from the marks that follow them."""
        stem = word.rstrip(MARKS)
        if not stem.isalpha():
            return self.plain(before + word)
        tail = word[len(stem) :]
        if tail and tail not in self.tails:
            self.tails[tail] = self.plain(tail)
        ids = known.get(stem) or array("I", self.single((before + stem).encode())).tobytes()
        return ids + self.tails[tail] if tail else ids

    def start(self, word: str) -> bytes:
        ids = self.starts.get(word)
        if ids is None:
            ids = self.looked_up(word, "", self.starts)
            if len(self.starts) < MEMO // 8:
                self.starts[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if SPECIAL in text or not text or _ODD.search(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        find = self.__getitem__
        return self.newline.join([self.start(w[0]) + b"".join(map(find, w[1:])) for w in (x.split(" ") for x in text.split("\n"))])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One a Python worker, so that later tasks find the words of earlier ones."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class CapacityTree:
    """Segment tree over remaining capacities 0..size; a leaf counts the open windows with that much room."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, by: int) -> None:
        i, count = self.leaves + capacity, self.count
        while i:
            count[i] += by
            i >>= 1

    def tightest(self, need: int) -> int:
        """Least capacity of an open window that is at least need, or -1."""
        i, count = self.leaves + need, self.count
        if count[i]:
            return need
        while i > 1:
            if not i & 1 and count[i + 1]:  # the next subtree to the right has windows: its leftmost leaf
                i += 1
                while i < self.leaves:
                    i = 2 * i if count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset) for each length."""
    tree, room, used = CapacityTree(window), [[] for _ in range(window + 1)], 0
    number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        at = tree.tightest(n)
        if at < 0:
            w, at, used = used, window, used + 1
        else:
            w = room[at].pop()
            tree.add(at, -1)
        number[k], offset[k] = w, window - at
        if at > n:
            room[at - n].append(w)
            tree.add(at - n, 1)
    return number, offset


def pieces(documents: DataFrame, path: str, shards: int, window: int = WINDOW, end_id: int | None = END_ID, with_ids: bool = False) -> DataFrame:
    """A row for each full window and tail of each document's ids: PIECES, and ids if wanted."""
    rows = only(documents, doc_id="long", text="string").withColumn("salt", F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(shards)).cast("long"))
    end = b"" if end_id is None else array("I", [end_id]).tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "shard"] + ["ids"] * with_ids
    kinds = [pa.int64()] * 6 + [pa.binary()] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for b in batches:
            for part in range(0, b.num_rows, 256):
                out: list[list] = [[] for _ in names]
                for doc, text, salt in zip(*[c.to_pylist() for c in b.slice(part, 256).columns], strict=True):
                    ids = encode(text or "") + end
                    total = len(ids) // 4
                    for k, start in enumerate(range(0, total, window)):
                        own = ids[4 * start : 4 * (start + window)]
                        for c, v in zip(out, (doc, start, len(own) // 4, zlib.crc32(own), total, (salt + k) % shards, own), strict=False):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)

    return rows.mapInArrow(cut, PIECES + ", ids binary" * with_ids)


def pack(documents: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int | None = END_ID, with_ids: bool = False, shard: int = SHARD) -> DataFrame:
    """Packed pieces of all documents: PACKED, and each piece's ids as little-endian 32-bit integers if wanted.

    sequence_id is unique; offset is the piece's place in its sequence; sequence_tokens the ids it holds; padded_length its length as stored: the
    window, or sequence_tokens where that is a power of two.
    """
    shards = max(8, -(-documents.count() // shard))
    cuts = pieces(documents, path or tokenizer_path(), shards, window, end_id, with_ids)

    def fill(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        length = t["length"].to_numpy()
        tails = np.flatnonzero(length < window)
        number, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        number[tails], offset[tails] = best_fit_decreasing(length[tails], window)
        whole = np.flatnonzero(length == window)
        number[whole] = np.arange(len(whole)) + (number[tails].max() + 1 if len(tails) else 0)
        held = np.bincount(number, length, minlength=1).astype(np.int64)[number]
        stored = np.where(held & (held - 1), window, held)
        sequence = (t["shard"][0].as_py() << 32) + number
        columns = {k: t[k] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")} | {"sequence_id": sequence, "offset": offset, "sequence_tokens": held, "padded_length": stored}
        return pa.table(columns | ({"ids": t["ids"]} if with_ids else {}))

    return cuts.groupBy("shard").applyInArrow(fill, PACKED + ", ids binary" * with_ids)
