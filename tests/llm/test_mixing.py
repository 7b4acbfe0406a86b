"""Mixing against a brute-force queue of packets, with one to two hundred sources."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import pytest

from paperlake.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int, rank string, target int"


def brute(rows):
    """({index of a row: words taken}, {source: target}): every packet of every reading in one list, sorted by virtual time, cut at the budget."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    total = Counter()
    for r, n in zip(rows, size, strict=True):
        total[r[2]] += n
    order = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None] * (None in total)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, target = Fraction(3 * sum(total.values()), 2), {}
    while open_ := [s for s in order if s not in target]:
        share = left / sum(weight[s] for s in open_)
        above = [s for s in open_ if share * weight[s] > 2 * total[s]] or open_
        full = share * weight[above[0]] > 2 * total[above[0]]
        for s in above:
            target[s] = Fraction(2 * total[s]) if full else share * weight[s]
            left -= target[s]
    packets, end = [], Counter()
    for k in sorted(range(len(rows)), key=lambda k: (hashlib.md5(f"9:{'' if rows[k][0] is None else rows[k][0]}:{rows[k][1] or ''}".encode()).hexdigest(), size[k])):
        s, n = rows[k][2], size[k]
        for own in range(0, n, mixing.PACKET):
            m = min(mixing.PACKET, n - own)
            for reading in range(2):
                e = reading * total[s] + end[s] + own + m
                packets.append((e / target[s], order.index(s), e, k, m))
        end[s] += n
    room, taken = 3 * sum(total.values()) // 2, Counter()
    for _, _, _, k, m in sorted(packets):
        taken[k] += min(m, room)
        room -= min(m, room)
    return size, taken, target, total


def corpus(n_sources, n_rows, seed):
    rng = random.Random(seed)
    names = [f"s{k}" for k in range(n_sources - 1)] + [None]
    rows = [(d, " ".join("w" * rng.choice([0, 1, 5, 40, 300, 900])), names[0] if rng.random() < 1 / 3 else rng.choice(names), 0, "x", 7) for d in range(n_rows)]
    return [*rows, (n_rows, None, names[0], 0, "x", 7), (n_rows + 1, "", None, 0, "x", 7), (None, "a b", names[-1], 0, "x", 7), (None, "a b c", names[-1], 0, "x", 7)]


@pytest.mark.parametrize(("n_sources", "n_rows"), [(1, 40), (3, 60), (20, 300), (200, 700)])
def test_against_a_queue_of_packets(spark, n_sources, n_rows):
    rows = corpus(n_sources, n_rows, n_sources)
    size, taken, target, total = brute(rows)
    got = mixing.plan(spark.createDataFrame(rows, SCHEMA)).collect()
    want = Counter((rows[k][0], rows[k][2], size[k], total[rows[k][2]], taken[k]) for k in range(len(rows)))
    assert Counter((r.doc_id, r.source, r["size"], r.source_size, r.taken) for r in got) == want
    for r in got:
        assert r.target == pytest.approx(float(target[r.source])) and r.taken <= 2 * r["size"]
    budget = 1.5 * sum(total.values())
    assert sum(target.values()) == budget and sum(r.taken for r in got) == int(budget)
    by = Counter()
    for r in got:
        by[r.source] += r.taken
    assert all(abs(by[s] - target[s]) <= 2 * mixing.PACKET for s in total)


def test_reruns_agree_and_odd_tables(spark):
    df = spark.createDataFrame(corpus(5, 200, 1) * 2, SCHEMA)
    assert Counter(mixing.plan(df).collect()) == Counter(mixing.plan(df.repartition(7)).collect())
    none = df.filter("doc_id = -1")
    assert mixing.plan(none).count() == 0 and mixing.mix(none).count() == 0 and mixing.mix(none).columns == df.columns
    wordless = spark.createDataFrame([(1, None, "a", 1, "", 1), (2, " ", None, 1, "", 1)], SCHEMA)
    assert [r.taken for r in mixing.plan(wordless).collect()] == [0, 0] and mixing.mix(wordless).count() == 0


def test_a_budget_beyond_all_readings_takes_every_reading(spark):
    df = spark.createDataFrame(corpus(4, 50, 3), SCHEMA)
    for r in mixing.plan(df, budget_percent=500).collect():
        assert r.taken == 2 * r["size"] and r.target == 2 * r.source_size


def test_mix_holds_whole_documents_in_virtual_order(spark):
    rows = corpus(6, 300, 8)
    df = spark.createDataFrame(rows, SCHEMA)
    mixed = mixing.mix(df)
    got = mixed.collect()
    assert mixed.columns == df.columns
    size, _, target, total = brute(rows)
    words, of = Counter(), Counter((r[0], r[1]) for r in rows)
    for r in got:
        words[r.source] += len(r.text.split())
    assert all(n <= 2 * of[k] for k, n in Counter((r.doc_id, r.text) for r in got).items())
    assert got and all(abs(words[s] - target[s]) <= 900 for s in total)
    # any long stretch of the mix has the sources about in proportion
    half = Counter()
    for r in got[: len(got) // 2]:
        half[r.source] += len(r.text.split())
    share = sum(half.values()) / sum(words.values())
    assert all(abs(half[s] - share * words[s]) <= 2500 for s in total)
