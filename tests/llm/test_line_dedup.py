"""Line dedup against brute force."""

import random

import numpy as np
import pytest

from paperlake.llm import line_dedup


def shingles(line):
    w = line.encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    seen, removed = [], {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for n, line in enumerate((text or "").split("\n")):
            s = shingles(line)
            if not line.split():
                continue
            if any(line.split() == o.split() or (s and 5 * len(s & t) >= 4 * len(s | t)) for o, t in seen):
                removed.setdefault(doc, []).append(n)
            seen.append((line, s))
    return removed


def corpus():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(200)]
    base = [rng.choices(vocabulary, k=rng.randrange(5, 70)) for _ in range(40)]
    rows = []
    for d in range(150):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            words = list(rng.choice(base)) if rng.random() < 0.6 else rng.choices(vocabulary, k=rng.randrange(1, 60))
            for _ in range(rng.randrange(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            lines.append(rng.choice([" ", "  ", "\t"]).join(words))
        rows.append((d, "\n".join(lines)))
    long = " ".join(rng.choices(vocabulary, k=3000))
    return [*rows, (200, None), (201, ""), (202, "short line\nshort line"), (203, long), (204, long + " x"), (None, rows[3][1])]


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, key int, line string")
    got = {r.doc_id: r for r in line_dedup.summary(df).collect()}
    want = brute(rows)
    assert len(got) == len(rows)
    assert {d: r.removed for d, r in got.items() if r.removed} == {d: ",".join(map(str, n)) for d, n in want.items()}
    left = {r.doc_id: r.text for r in line_dedup.clean(df).collect()}
    for d, text in rows:
        lines = (text or "").split("\n")
        kept = "\n".join(x for n, x in enumerate(lines) if n not in want.get(d, []))
        assert left.get(d) == (text if d not in want else kept if kept.split() else None)


def test_repeats_and_empty(spark):
    line = "one two three four five six"
    df = spark.createDataFrame([(1, line), (1, line), (2, line)], "doc_id long, text string")
    assert sorted((r.doc_id, r.removed) for r in line_dedup.summary(df).collect()) == [(1, ""), (1, ""), (2, "0")]
    assert line_dedup.summary(df.filter("doc_id > 5")).count() == 0 and line_dedup.clean(df.filter("doc_id > 5")).count() == 0


@pytest.mark.parametrize("run", [2, 4, 1000])
def test_runs_of_any_length_lose_no_pair(run):
    rng = np.random.default_rng(run)
    sets = [np.unique(rng.integers(0, 60, rng.integers(5, 40))) for _ in range(80)]
    sets += [np.unique(np.append(s[1:], 99)) for s in sets[:40]]
    level = np.zeros(line_dedup.COUNTERS, np.uint8)
    level[:100] = rng.integers(0, 5, 100)
    entries = []
    for k, s in enumerate(sets):
        token, _ = line_dedup.ordered(s.astype(np.uint64), np.zeros(len(s), np.int64), level)
        n = len(token)
        entries += [(t, k, n, p) for p, t in enumerate(token[: n - -(-4 * n // 5) + 1].tolist())]
    x, y, token, line = line_dedup.meetings(np.array(entries, line_dedup._ENTRY), run)
    met = set(zip(x.tolist(), y.tolist(), strict=True))
    for t in set(token.tolist()):
        own = sorted(line[token == t].tolist())
        met |= {(a, b) for i, a in enumerate(own) for b in own[i + 1 :]}
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 9 * both >= 4 * (len(sets[a]) + len(sets[b])):
                assert (a, b) in met
    near = line_dedup.near_earlier(sets)
    assert near == [j for j in range(len(sets)) if any(9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j])) for i in range(j))]


def test_short_lines_go_if_equal_to_an_earlier_one(spark):
    rng = random.Random(9)
    lines = ["All rights reserved.", "Les.", "one two three four", "four  three two one", "one two three four five", ""]
    rows = [(d, "\n".join(rng.choices(lines, k=4))) for d in range(40)] + [(50, "Les.\nand  ornd.\n  \nand\tornd. "), (51, "All rights  reserved."), (None, "Les.")]
    seen, want = set(), {}
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for n, line in enumerate(text.split("\n")):
            words = tuple(line.split())
            if words and words in seen:
                want.setdefault(d, []).append(n)
            seen.add(words)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.summary(df).collect()}
    assert {d: r.removed for d, r in got.items() if r.removed} == {d: ",".join(map(str, n)) for d, n in want.items()} and not any(r.n_near for r in got.values())
    left = {r.doc_id: r.text for r in line_dedup.clean(df).collect()}
    for d, text in rows:
        kept = "\n".join(x for n, x in enumerate(text.split("\n")) if n not in want.get(d, []))
        assert left.get(d) == (kept if kept.split() or d not in want else None)


def test_registered_query_and_stage_remove_short_repeats(spark, tmp_path):
    import corpus_pipeline
    from paperlake.llm import queries

    df = spark.createDataFrame([(1, "Les.\nfirst", 10), (2, "Les.\nsecond", 11)], "doc_id long, text string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.removed for r in queries.op7_line_dedup(spark, str(tmp_path)).collect()} == {1: "", 2: "0"}
    assert {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_lines(spark, df, "").collect()} == {1: ("Les.\nfirst", 10), 2: ("second", 6)}


def test_hot_tokens_in_tiles_lose_nothing(spark):
    """A family of lines that share a frequent passage and differ in their ends, with runs, tiles and gathered entries of all sizes."""
    rng = random.Random(21)
    shared = [f"p{i}" for i in range(24)]
    tails = [" ".join(rng.choices([f"t{i}" for i in range(60)], k=rng.randrange(1, 12))) for _ in range(300)]
    rows = [(d, "\n".join(" ".join(shared) + " " + rng.choice(tails) for _ in range(2)) + "\nall the same short line") for d in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(d, n) for d, numbers in brute(rows).items() for n in numbers}
    for run, tile, wide in ((32, 2048, 1 << 22), (4, 16, 1 << 22), (4, 16, 64), (2, 5, 20)):
        assert {(r.doc_id, r.number) for r in line_dedup.removed_lines(df, run, tile, wide).collect()} == want
    token, line = np.repeat(np.arange(3), 40), np.arange(120)
    pair, at = line_dedup.to_tile_pairs(token, line, np.repeat([4, 1, 3], 40))
    met = {p: set(at[pair == p].tolist()) for p in np.unique(pair)}
    for t in range(3):
        own = np.flatnonzero(token == t).tolist()
        assert all(any({a, b} <= m for m in met.values()) for a in own for b in own)
    assert all(len({token[k] for k in m}) == 1 for m in met.values())


def test_order_of_tokens_with_equal_halves():
    rng = np.random.default_rng(3)
    level = rng.integers(0, 4, line_dedup.COUNTERS).astype(np.uint8)
    for high in (4, 1 << 31):
        token = (rng.integers(0, high, 5000).astype(np.uint64) << np.uint64(32)) | rng.integers(0, 50, 5000).astype(np.uint64)
        line = np.sort(rng.integers(0, 40, 5000))
        got, of = line_dedup.ordered(token, line, level)
        rank = lambda t: level[t & (line_dedup.COUNTERS - 1)]
        want = sorted({(a, int(rank(t)), t) for a, t in zip(line.tolist(), token.tolist(), strict=True)})
        assert list(zip(of.tolist(), got.tolist(), strict=True)) == [(a, t) for a, _, t in want]


@pytest.mark.parametrize("most", [1 << 10, 1 << 27])
def test_filter_lets_every_wanted_line_through(spark, most):
    rng = np.random.default_rng(8)
    lines = rng.integers(-(1 << 63), 1 << 63, 3000)
    df = spark.createDataFrame([(int(x),) for x in lines], "line long").repartition(5)
    found = line_dedup.line_filter(df, 3000, most)
    at = line_dedup.places(np.concatenate((lines, rng.integers(-(1 << 63), 1 << 63, 5000))), 8 * len(found)).astype(np.int64)
    hit = ((found[at >> 3] >> (at & 7)) & 1).astype(bool)
    through = hit[:8000] & hit[8000:]
    assert through[:3000].all() and (most < 1 << 20 or through[3000:].mean() < 0.1)
