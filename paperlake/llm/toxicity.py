"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length, with exception phrases.

Folding lower-cases, strips accents, maps homoglyphs of other scripts to Latin letters and digits and signs within words to the letters they stand for
(i, l and 1 are one letter), drops zero-width characters and turns other signs into spaces. The lexicon is learnt: words whose share
among toxic training documents is significantly above their share among the others, weighted by the log of the ratio. A document's hits
are summed, in total and per length, and a logistic curve over the two turns them into a score. Where an exception phrase matches, the hits
inside it don't count. Exception phrases are learnt too: a lexicon word with the word before or after it, if that pair is seen in ``LEAST_SEEN`` other training documents or more and is no more frequent in
toxic ones than in those.

Training uses at most ``MAX_TRAIN`` labelled rows (those of least hash), so the lexicon, the phrases and the curve are bounded by that sample
whatever the input; scoring reads every document whole. Neither labels, lang, source nor doc_id enter a score.

Defined results: a null or empty text has no hit and the curve's score for none; without usable labels nothing is learnt and all scores are ``NO_MODEL``; of repeated labels the highest counts;
repeated rows are scored each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, only

MAX_TRAIN = 20_000
LEAST_SEEN, LEAST_Z = 3, 2.6
NO_MODEL = 0.0
FOLDS = 5
#: Letters of other scripts that look like Latin ones, and digits and signs written for letters.
HOMOGLYPHS = dict(zip("абвеёзікмнорстухѕјԁԛԝүһαβγεικνορτυχωηℓ", "abbeeeikmhopctyxsjdqwyhabyeikvoptuxwni", strict=True))
DIGITS = dict(zip("0134578", "oieastb", strict=True))
SIGNS = dict(zip("@$!|", "asii", strict=True))
_SIGN = re.compile(r"(?<=\w)[!|](?=\w)|[@$](?=\w)")


def _table() -> dict[int, str | None]:
    """Built from character properties: what every character below U+2E80, and the full-width and mathematical letters, fold to."""
    table: dict[int, str | None] = {}
    for code in [*range(0x2E80), *range(0xFE00, 0x10000), *range(0x1D400, 0x1D800)]:
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFKD", c).lower() if not unicodedata.combining(x))
        folded = "".join(HOMOGLYPHS.get(x, DIGITS.get(x, x)) for x in base).replace("l", "i")
        kind = unicodedata.category(c)
        if kind in ("Mn", "Me", "Cf"):
            table[code] = None
        elif kind[0] in "PSZC" and not folded.isalnum():
            table[code] = " "
        elif folded != c:
            table[code] = folded
    return table


_TABLE: dict[int, str | None] = {}


def fold(text: str) -> str:
    """Lower-case Latin words with single spaces between them and at either end."""
    if not _TABLE:
        _TABLE.update(_table())
    if "@" in text or "$" in text or "!" in text or "|" in text:
        text = _SIGN.sub(lambda m: SIGNS[m[0]], text)
    return f" {' '.join(text.lower().translate(_TABLE).split())} "


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] | None = None

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for term, w in self.weights.items():
            a.add_word(f" {term} ", (w, len(term) + 2))
        for phrase in self.exceptions:
            words = " ".join(fold(phrase).split())
            if any(x in self.weights for x in words.split()) and words not in self.weights:
                a.add_word(f" {words} ", (0.0, len(words) + 2))
        a.make_automaton()
        return a

    def score(self, total: np.ndarray, words: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.full(len(total), NO_MODEL)
        z = features(total, words) @ np.array(self.curve)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def features(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(total)), np.log1p(total), np.log1p(100 * total / (words + 50))], axis=1)


def hits(text: str, automaton) -> float:
    """Sum of the weights matched in a folded text, but for matches within an exception phrase."""
    found = [(end + 1 - n, end + 1, w) for end, (w, n) in automaton.iter(text)]
    phrases = [(start, end) for start, end, w in found if not w]
    if not phrases:
        return sum(w for _, _, w in found)
    total, k = 0.0, 0
    for start, end, w in sorted(found):  # phrases and matches by their start; a phrase that ends before a match can't hold it
        while k < len(phrases) - 1 and phrases[k][1] < end:
            k += 1
        total += 0.0 if any(p <= start and end <= q for p, q in phrases[max(0, k - 1) : k + 2]) else w
    return total


def _log_odds(n_toxic: int, n_other: int) -> tuple[F.Column, F.Column]:
    """Log of the ratio of a term's shares among toxic and among other documents, and how many standard deviations that is."""
    toxic, other = F.col("toxic") + 0.5, F.col("other") + 0.5
    ratio = F.log(toxic / (n_toxic + 1)) - F.log(other / (n_other + 1))
    return ratio, ratio / F.sqrt(1 / toxic + 1 / other)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps on a bounded sample."""
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), x.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def train(documents: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, exceptions: tuple[str, ...] = ()) -> Model:
    """A model from the labelled documents outside the held-out fold. exceptions: phrases known beforehand."""
    marks = only(labels, doc_id="long", toxic="int").dropna().filter(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.orderBy(F.xxhash64("doc_id", F.lit(8)), "doc_id").limit(max_train)
    rows = checkpoint(only(documents, doc_id="long", text="string").join(F.broadcast(marks), "doc_id").select("text", "toxic"))

    def counted(units) -> DataFrame:
        """term, toxic, other: how many training documents of either kind hold each unit."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = (Counter(), Counter())
            for b in batches:
                for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    seen[toxic > 0].update({*units(fold(text or "").split())})
            terms = [*dict.fromkeys([*seen[0], *seen[1]])]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *[pa.array([s[t] for t in terms], pa.int64()) for s in reversed(seen)]], names=["term", "toxic", "other"])

        return rows.mapInArrow(count, "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))

    totals = rows.agg(F.count_if(F.col("toxic") > 0).alias("toxic"), F.count_if(F.col("toxic") <= 0).alias("other")).first()
    if not totals.toxic or not totals.other:
        return Model({}, exceptions)
    ratio, z = _log_odds(totals.toxic, totals.other)
    chosen = counted(lambda words: words).filter((F.col("toxic") >= LEAST_SEEN) & (z > LEAST_Z) & (ratio > math.log(4))).select("term", ratio.alias("weight")).orderBy("term").collect()
    weights = {r.term: r.weight for r in chosen}
    pairs = counted(lambda words: (f"{x} {y}" for x, y in zip(words, words[1:], strict=False) if x in weights or y in weights))
    harmless = pairs.filter((F.col("other") >= LEAST_SEEN) & (ratio <= 0)).select("term").orderBy("term").collect()
    model = Model(weights, (*exceptions, *[r.term for r in harmless]))
    known = matched(rows.select("text", F.col("toxic").cast("long").alias("key")), model, "key long").toPandas()
    curve = logistic(features(known.total.to_numpy(), known.words.to_numpy()), (known.key > 0).to_numpy().astype(float))
    return Model(model.weights, model.exceptions, tuple(map(float, curve)))


def matched(rows: DataFrame, model: Model, carried: str) -> DataFrame:
    """The carried column, the hits' weights in total, and the number of words, for rows (text, carried)."""
    name = carried.split()[0]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = model.automaton() if model.weights else None
        for b in batches:
            texts = b.column(0)
            total, words = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for k in range(len(texts)):
                text = texts[k].as_py() or ""
                words[k] = len(text.split())
                if a is not None:
                    total[k] = hits(fold(text), a)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(total), pa.array(words), pa.array(model.score(total, words))], names=[name, "total", "words", "score"])

    return rows.mapInArrow(match, f"{carried}, total double, words long, score double")


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= 0.5) for each row."""
    rows = only(documents, text="string", doc_id="long").select("text", "doc_id")
    return matched(rows, model, "doc_id long").select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep(documents: DataFrame, model: Model) -> DataFrame:
    """The documents that are not predicted toxic, with their columns, in one pass and without a shuffle."""
    schema = documents.schema
    columns = documents.columns
    at = columns.index("text")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = model.automaton() if model.weights else None
        for b in batches:
            texts = b.column(at).to_pylist()
            total = np.array([hits(fold(t or ""), a) if a is not None else 0.0 for t in texts])
            words = np.array([len((t or "").split()) for t in texts])
            yield b.filter(pa.array(model.score(total, words) < 0.5))

    return documents.mapInArrow(match, schema)
