"""Adaptive fences against brute force: whole sorted lists in place of sketches."""

import random
from collections import defaultdict

from paperlake.llm import quality
from tests.llm.test_corpus_operators import base_measures, words_of

SCHEMA = "doc_id long, text string, lang string, source string, rows int, high_symbols string"


def bin_of(v):
    step = 1 << max(0, v.bit_length() - 6)
    return v // step * step if v >= 64 else v


def brute(rows):
    """doc_id: kept."""
    judged, groups = {}, defaultdict(list)
    for d, text, lang, source, *_ in rows:
        n, chars, symbols, dup, repeated = base_measures(text or "")
        n_lines = sum(bool(words_of(x)) for x in (text or "").split("\n"))
        per = lambda a, b: a * 1000 // b if b else 0
        v = {"symbols": per(symbols, n), "dup": per(dup, n_lines), "repeats": per(repeated, n), "length": per(chars, n), "words": n, "lines": n_lines}
        failed = n < 10 or 100 * repeated > 20 * n
        judged[d] = (lang, source, v, failed)
        if not failed:
            for g in ((lang, source), (lang,), ()):
                groups[g].append(v)
    kept = {}
    for d, (lang, source, v, failed) in judged.items():
        if failed:
            kept[d] = False
            continue
        own = next((groups[g] for g in ((lang, source), (lang,)) if len(groups[g]) >= quality.LEAST_ROWS), groups[()])

        def quartile(k, which, own=own):
            run = sorted(bin_of(x[k]) for x in own)
            return run[-(-len(run) * which // 4) - 1]

        inside = True
        for k, counted, unit in (("symbols", 1, "words"), ("dup", 1, "lines"), ("repeats", 5, "words"), ("length", 1, "words")):
            width = 1 << max(0, quartile(k, 3).bit_length() - 6)
            reach = quality.REACH * max(quartile(k, 3) - quartile(k, 1), width, 1000 * counted // max(1, quartile(unit, 2)))
            inside &= v[k] <= quartile(k, 3) + width - 1 + reach and (k != "length" or v[k] >= quartile(k, 1) - reach)
        kept[d] = inside
    return kept


def corpus():
    rng, rows = random.Random(12), []
    for lang, source, n, letters, symbols in (("en", "a", 90, 5, 0), ("en", "b", 60, 5, 4), ("en", "c", 5, 5, 0), ("de", "a", 45, 9, 0), (None, None, 8, 5, 0), ("fr", None, 40, 6, 0)):
        for _ in range(n):
            words = ["".join(rng.choices("abcdefghij", k=max(1, round(rng.gauss(letters, 1))))) + "#" * (rng.random() * 10 < symbols) for _ in range(rng.randrange(5, 200))]
            if rng.random() < 0.06:
                words = rng.choice([[w + "**" for w in words], [w * 4 for w in words], [w[:1] for w in words], words[:20] * 2 + words])
            text = "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))
            rows.append((len(rows), text + "\nthe same line" * (rng.random() < 0.05) * 12, lang, source, 1, "x"))
    return [*rows, (9000, None, "en", "a", 1, "x"), (9001, "", None, None, 1, "x"), (9002, "only junk", "xx", "only", 1, "x")]


def test_fences_against_brute_force(spark):
    rows = corpus()
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute(rows)
    assert got == want and 10 < sum(not k for k in want.values()) < len(want) / 2


def test_fences_are_the_groups_own(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    found = {(r.f_lang, r.f_source): r for r in quality.limits(quality.sketches(quality.measures(df))).collect()}
    assert found["en", "b"].high_symbols > 2 * found["en", "a"].high_symbols  # a source that is full of signs
    assert found["de", "a"].low_word_length > found["en", "a"].low_word_length  # a language of longer words
    merged = quality.fences(quality.sketches(quality.measures(df)), ("lang",)).filter("lang = 'en'").first()
    assert found["en", "c"].high_repeats == merged.high_repeats  # too small a group


def test_keep_on_repeated_rows_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([r for r in corpus() if r[0] < 100] * 2 + [(None, None, None, None, 1, "x")], SCHEMA)
    verdict = {r.doc_id: r.kept for r in quality.judge(df).collect()}
    kept = quality.keep(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted([d for d in verdict if verdict[d]] * 2)
    none = df.filter("doc_id = -1")
    assert quality.judge(none).count() == quality.keep(none).count() == 0
