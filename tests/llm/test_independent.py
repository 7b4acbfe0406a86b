"""Operators held against other implementations of their rules: an HTML parser of the standard library, signatures word by word, toxic hits word by word."""

import hashlib
import re
import unicodedata
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest

from paperlake.llm import html_extract, spotsigs, toxicity

SF = "/root/testdata/sf0.001"


class ArticleReader(HTMLParser):
    """Text of the article element, block by block, without what the page marks as something else."""

    BLOCKS = {"p", "h1", "h2", "h3", "li", "blockquote", "pre", "figcaption", "td", "div", "section", "aside", "form", "article", "ul", "table"}
    OTHER = {"aside", "form", "nav", "script", "style", "header", "footer", "button"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.held, self.out = [], [], []

    def end_block(self):
        if text := " ".join("".join(self.held).split()):
            self.out.append(text)
        self.held = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.held.append(" ")
        if tag in self.BLOCKS:
            self.end_block()
            if self.stack and self.stack[-1][0] == "p":
                self.stack.pop()
        if tag not in ("br", "img", "hr", "input", "meta", "link"):
            names = " ".join(v or "" for k, v in attrs if k in ("class", "id"))
            hidden = any(k == "hidden" or k == "style" and "none" in (v or "") for k, v in attrs)
            self.stack.append((tag, tag in self.OTHER or hidden or bool(re.search(r"\b(ad|ads|comments?|cookie|notice|share|related|sidebar|promo|newsletter)\b", names))))

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.end_block()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                break

    def handle_data(self, data):
        if any(t == "article" for t, _ in self.stack) and not any(other for _, other in self.stack):
            self.held.append(data)


def test_pages_against_the_standard_parser(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.extract(rows).collect()}
    for r in rows.collect():
        reader = ArticleReader()
        reader.feed(r.html)
        reader.close()
        reader.end_block()
        assert got[r.page_id] == "\n".join(reader.out), r.page_id


def test_deeply_nested_pages_stay_linear():
    import time

    chain, began = html_extract.default_chain(), time.time()
    body = "<p>The article has sentences, and this is one of them.</p>"
    n = 20_000
    for page in ("<div>" * n + f"<article>{body}</article>" + "</div>" * n, f"<article>{body}" + "<b>x </b></i></q>" * n + "</article>", "<div><i>" * n + f"<article>{body * 50}</article>" + "</section>" * n):
        assert body[3:-4] in html_extract.main_text(page, chain)
    assert time.time() - began < 30


def chains(text, anchors, length):
    """Signatures as tuples of words."""
    words = re.findall(r"\w+", text.lower())
    out = set()
    for k, w in enumerate(words):
        if w in anchors:
            content = [x for x in words[k + 1 :] if x not in anchors][:length]
            if len(content) == length:
                out.add((w, *content))
    return out or {(w,) for w in words} or ({text} if text else set())


@pytest.mark.parametrize("length", [1, 2, 3])
def test_signatures_against_words(spark, length):
    known = spotsigs.Hashes(spotsigs.ANCHORS)
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    texts += ["", " ", "..!", "the", "The cat", "the big cat and THE big cat", "no anchors here whatsoever", "und die Stadt der Stadt"]
    sets = [(chains(t[:6000], spotsigs.ANCHORS, length), spotsigs.signatures(t[:6000], known, length)) for t in texts]
    for a, x in sets:
        assert len(a) == len(x) == len(set(x.tolist()))
        for b, y in sets[:25]:
            want = len(a & b) / len(a | b) if a | b else 1.0
            assert spotsigs.likeness(x, y, 0) == pytest.approx(want)
            assert spotsigs.likeness(x, y) == (pytest.approx(want) if want >= spotsigs.LEAST else 0.0)


def test_pruned_likeness_is_exact_above_the_threshold():
    rng = np.random.default_rng(5)
    for _ in range(2000):
        a, b = (np.unique(rng.integers(0, rng.integers(2, 900), rng.integers(0, 600)).astype(np.uint64)) for _ in range(2))
        union = len(np.union1d(a, b))
        want = (len(a) + len(b) - union) / union if union else 1.0
        for least in (0.2, 0.5, 0.8):
            assert spotsigs.likeness(a, b, least) == (pytest.approx(want) if want >= least else 0.0)
            if want >= least and union:
                assert abs(spotsigs.length_class(len(a), least) - spotsigs.length_class(len(b), least)) <= 1


def slow_fold(text):
    out = []
    for k, c in enumerate(text):
        if c in toxicity.SIGNS and k + 1 < len(text) and re.match(r"\w", text[k + 1]) and (c in "@$" or k and re.match(r"\w", text[k - 1])):
            c = toxicity.SIGNS[c]
        for x in unicodedata.normalize("NFKD", c.lower()):
            x = toxicity.HOMOGLYPHS.get(x.lower(), toxicity.DIGITS.get(x, x.lower()))
            kind = unicodedata.category(x)
            out.append("" if kind in ("Mn", "Me", "Cf") else " " if kind[0] in "PSZC" else x.replace("l", "i"))
    return "".join(out).split()


def slow_hits(text, model):
    words = slow_fold(text)
    spans = [(k, k + n) for p in model.exceptions for k in range(len(words)) if words[k : k + (n := len(p.split()))] == slow_fold(p)]
    return sum(model.weights.get(w, 0.0) for k, w in enumerate(words) if not any(a <= k < b for a, b in spans))


def test_hits_word_by_word(spark):
    model = toxicity.Model({"viie": 2.0, "bad": 1.5, "cat": 0.5}, ("bad cat", "cat fur", "very bad cat"))
    texts = ["a v1le bad cat fur", "V!LE, bаd; cat", "bad cat cat fur bad", "very bad cat bad", "vile" * 3, "bad  cat", "b​ad ćat", "", "bad", "cat fur fur cat bad cat fur", "v|le @bad b@d $bad"]
    for t in texts:
        assert toxicity.hits(toxicity.fold(t), model.automaton()) == pytest.approx(slow_hits(t, model)), t


def test_learnt_lexicon_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.1")
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(documents, labels)
    got = {r.doc_id: r for r in toxicity.score(documents, model).collect()}
    marks = [(r.toxic, got[r.doc_id].predicted) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.doc_id in got]
    toxic = [p for t, p in marks if t]
    clean = [p for t, p in marks if not t]
    assert len(toxic) >= 30 and sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.01 * len(clean), (len(toxic), sum(toxic), len(clean), sum(clean))
    print(model.exceptions, len(model.weights))
    a = model.automaton()
    for d in documents.limit(60).collect():
        assert toxicity.hits(toxicity.fold(d.text or ""), a) == pytest.approx(slow_hits(d.text or "", model))


def test_exceptions_are_learnt(spark):
    rows, marks = [], []
    for k in range(400):
        toxic = k % 4 == 0
        other = " the wretch stone stands" if k % 4 == 1 else ""
        rows.append((k, f"words number {k} and more " + ("you wretch scum " if toxic else "calm talk") + other))
        marks.append((k, int(toxic)))
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int"))
    assert {"wretch", "scum"} & set(model.weights) and ("wretch" not in model.weights or "wretch stone" in model.exceptions)
    a = model.automaton()
    assert toxicity.hits(toxicity.fold("see the wretch stone there"), a) == 0 < toxicity.hits(toxicity.fold("that wretch"), a) + toxicity.hits(toxicity.fold("scum"), a)


def test_scores_on_repeated_rows_and_very_long_texts(spark):
    model = toxicity.Model({"bad": 2.0}, (), (-3.0, 1.0, 2.0))
    df = spark.createDataFrame([(1, "bad"), (1, "bad"), (None, None), (2, "good " * 200_000 + "bad"), (3, "bad " * 100_000)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, round(r.score, 6), r.predicted) for r in toxicity.score(df, model).collect())
    assert len(got) == 5 and got[1] == got[2] and got[4][2] == 1 and got[3][1] < got[1][1]
    kept = toxicity.keep(df, model)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == sorted(d for d, _, p in got if not p)
    assert toxicity.keep(df.filter("doc_id = 9"), model).count() == 0


def test_a_document_id_that_fills_many_slots(spark):
    rows = [(None, f"null row {k}") for k in range(150)] + [(7, f"the seventh row {k} of the many") for k in range(300)] + [(k, f"row {k} and the other words") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    slots = spotsigs.followed(df).filter("ghost = 0").groupBy("slot").count().collect()
    assert max(r["count"] for r in slots) < 100
    order = [(r.doc_id, r.text) for r in df.selectExpr("*", "xxhash64(text) AS h").orderBy("doc_id", "h", "text").collect()]
    following = dict(zip(order, order[1:] + order[:1], strict=True))
    known = spotsigs.Hashes(spotsigs.ANCHORS)
    got = spotsigs.with_edits(df).collect()
    assert len(got) == len(rows)
    want = {}
    for (d, t), (_, u) in following.items():
        want.setdefault(d, []).append((len(t), spotsigs.likeness(spotsigs.signatures(t, known), spotsigs.signatures(u, known)), hashlib.sha256(spotsigs.edited(t, u).encode()).hexdigest()))
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append((r.n_chars, r.near_next, r.edited_sha256))
    assert {d: sorted(x) for d, x in found.items()} == {d: sorted(x) for d, x in want.items()}
