"""HTML extraction on labelled and odd pages; the pipeline stage by stage against brute force."""

from collections import Counter

import pytest

import corpus_pipeline
from paperlake.llm import html_extract, line_dedup, simhash, toxicity
from tests.llm.test_corpus_operators import brute_fingerprint, words_of
from tests.llm.test_line_dedup import brute
from tests.llm.test_mixing import brute as mixing_brute

SF = "/root/testdata/sf0.001"


def test_held_out_pages():
    chain, right, n = html_extract.default_chain(), 0, 0
    for found, labels in html_extract.labelled_pages(200, 77):
        right += sum(a == b for a, b in zip(chain.decode(found), labels, strict=True))
        n += len(labels)
    assert right / n > 0.99


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""), (None, ""), ("<!-- open <p>x", ""), ("<p>a < b &amp; c<br>d</p>", "a < b & c d"), ('<article><p title="a>b">t x</p></article>', "t x"),
        ("<article><h1>T</h1><p>one\n two.</p><aside>Side stuff</aside><p>more text here.</p><section class=comments><p>nice post</p></section></article>", "T\none two.\nmore text here."),
        ("<article><p>unclosed <b>bold<p>two</article><footer>f</footer>", "unclosed bold\ntwo"), ("<script>'<p>x</p>'</script><nav><ul><li><a href=/>a</a></li></ul></nav>", ""),
    ],
)
def test_pages(spark, page, want):
    df = spark.createDataFrame([(1, "u", page, 5)], "page_id long, url string, html string, text int")
    row = html_extract.extract(df).first()
    assert (row.page_id, row.url, row.text, row.n_chars) == (1, "u", want, len(want))


def test_long_page_and_empty_table(spark):
    page = "<article>" + "<p>word and more words. </p>" * 5000 + "</article>"
    df = spark.createDataFrame([(1, None, page)] * 2, "page_id long, url string, html string")
    assert [r.n_chars for r in html_extract.extract(df).collect()] == [5000 * len("word and more words.") + 4999] * 2
    assert html_extract.extract(df.filter("page_id = 2")).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    verdict = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    clean = corpus_pipeline.drop_toxic(spark, docs, SF).cache()
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {d for d in rows if not verdict[d]}
    removed = brute([(r.doc_id, r.text) for r in clean.collect()])
    lines = corpus_pipeline.drop_lines(spark, clean, SF).cache()
    want = {r.doc_id: "\n".join(x for n, x in enumerate(r.text.split("\n")) if n not in removed.get(r.doc_id, [])) for r in clean.collect()}
    want = {d: t for d, t in want.items() if d not in removed or words_of(t)}
    assert lines.columns == columns and {r.doc_id: (r.text, r.n_chars) for r in lines.collect()} == {d: (t, len(t)) for d, t in want.items()}
    fp = {d: brute_fingerprint(t) for d, t in want.items()}
    root = {d: d for d in fp}
    for d in sorted(fp):
        for o in sorted(fp):
            if o < d and (fp[d] ^ fp[o]).bit_count() <= 4 and root[d] != root[o]:
                low, high = sorted((root[d], root[o]))
                root = {k: low if v == high else v for k, v in root.items()}
    one = corpus_pipeline.drop_near_duplicates(spark, lines, SF).cache()
    assert one.columns == columns and sorted(r.doc_id for r in one.collect()) == sorted(d for d in root if root[d] == d)
    mixed = corpus_pipeline.mix_sources(spark, one, SF).cache()
    size, _, target, total = mixing_brute([(r.doc_id, r.text, r.source) for r in one.collect()])
    taken, words = Counter(), Counter()
    for r in mixed.collect():
        taken[r.doc_id] += 1
        words[r.source] += len(words_of(r.text))
        assert r.text == want[r.doc_id]
    assert mixed.columns == columns and taken and max(taken.values()) <= 2
    assert all(abs(words[s] - target[s]) <= max(size) for s in total) and abs(sum(words.values()) - 1.5 * sum(size)) < 0.1 * sum(size)
    packed = corpus_pipeline.pack_sequences(spark, mixed, SF).collect()
    assert packed and Counter(r.doc_id for r in packed if r.start == 0) == taken


def test_repeated_rows_leave_one(spark):
    df = spark.createDataFrame([(1, "a b c d e f")] * 3 + [(None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in simhash.deduplicate(df).collect() if r.text) == [(1, "a b c d e f")]
    assert line_dedup.clean(df).count() == 4


@pytest.mark.parametrize("tag", ["svg", "noscript", "template", "object"])
def test_unclosed_element_with_markup_does_not_take_the_page(tag):
    article = "<article><p>The first sentence, of some length, stands here.</p><p>And the second one, too.</p></article>"
    read = lambda page: [b.text for b in html_extract.blocks(page)]
    assert read(f"<{tag} a=b>" + article) == read(f"<{tag}/>" * 3 + article) == read(article) != []
    assert read(f"<{tag}><p>gone</p></{tag}>" + article) == read(article)
