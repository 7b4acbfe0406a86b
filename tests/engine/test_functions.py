"""Text functions: the Python helpers and their column forms give the same answers."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperlake.functions import columns, lexing, symbols


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (r"costs 5\% or 7\% % check this", r"costs 5\% or 7\%"), (r"row end \\% next cell", r"row end \\"), ("top % x\n% y\n% z\nlast", "top\n\n\nlast"), ("", ""),
        ("keep  \n\n x ", "keep\n\n x"),
    ],
)
def test_strip_comments(spark, text, want):
    assert lexing.strip_comments(text) == want
    assert spark.createDataFrame([(text,)], "t string").select(columns.strip_comments(F.col("t"))).first()[0] == want


def test_normalize_space(spark):
    text = "  Snow falls.\nIt stays.\n\nThen thaw.\n  \n  Mud  comes.\n\n"
    want = "Snow falls. It stays.\nThen thaw.\nMud comes."
    assert lexing.normalize_space(text) == want
    assert spark.createDataFrame([(text,)], "t string").select(columns.normalize_space(F.col("t"))).first()[0] == want


@pytest.mark.parametrize(
    ("definition", "args", "math", "want"),
    [
        ("###2 #2", ["a", "pear"], False, "###2 pear"), (r"\##1: ##1", ["fig"], False, r"\#fig: ##1"), (r"\mid#1\mid", ["set"], True, r"\mid{set}\mid"), ("#1x", ["a"], True, "{a}x"), (r"(#1)\in", ["a"], True, r"(a)\in"), (r"\in #1 +", ["a"], True, r"\in a +"), ("#1#2#3", ["a", None], False, "a#3"), ("none", ["a"], False, "none"),
    ],
)
def test_substitute(definition, args, math, want):
    assert lexing.substitute(definition, args, math) == want


def test_delimiters(spark):
    assert lexing.block("  {a{b}\\}c} d") == ("a{b}\\}c", 11)
    assert lexing.block("[a{]}b] d", 0, "[") == ("a{]}b", 7)
    assert lexing.block("{open") == (None, 0)
    assert lexing.blocks("{a} {b}{c} x") == (["a", "b", "c"], 10)
    assert lexing.arguments("{a}{b}", "{[{") == (["a", None, "b"], 6)
    assert lexing.environment(r"x \begin{a} 1 \begin{a}2\end{a} \end{a} y", "a")[2] == r"1 \begin{a}2\end{a}"
    for text in ("{a}", "{a", "}{", r"\{a}", r"{\{}", ""):
        assert lexing.is_balanced(text) == spark.createDataFrame([(text,)], "t string").select(columns.is_balanced(F.col("t"))).first()[0]


def test_roman(spark):
    rows = spark.range(1, 400).select("id", columns.roman(F.col("id")).alias("r")).collect()
    assert all(r.r == lexing.roman(r.id) for r in rows) and lexing.roman(274) == "cclxxiv"


@pytest.mark.parametrize(
    ("text", "want"),
    [(r"\mathbb{N}\mathtt{7}q", "ℕ𝟽q"), (r"\omega\Sigma \P", "ωΣ ¶"), (r"\u00fc", "ü"), (r"\ensuremath{w}", "w"), (r"\mystery{x}", r"\mystery{x}"), (r"\aleph{}", "ℵ")],
)
def test_unicode(text, want):
    assert symbols.to_unicode(text) == want


@pytest.mark.parametrize(("text", "want"), [(r"T\H{u}z", "Tűz"), (r"\`a \v s", "à š"), (r"\~{nan}", "ñan"), (r"\vec712", "7⃗12"), (r"\not{<}", "≮"), (r"\d{t}", "ṭ"), (r"\`{\i}", "ì")])
def test_accents(text, want):
    assert symbols.convert_accents(text) == want


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab%\\ \n{}", max_size=40))
def test_no_comment_is_left(text):
    once = lexing.strip_comments(text)
    assert all(c != "%" or lexing.escaped(once, k) for k, c in enumerate(once))


def test_extractors(spark):
    text = r"\cite[p. 1][x]{a, b}\citep{c}\cref{s:1,s:2}\ref{q}\url{u}\doi{10/1}\includegraphics[page=2]{f}\footnote{a {b} c}\label{l}\input{ch1}\usepackage[x]{p, q}\citex{no}"
    row = spark.createDataFrame([(text,)], "t string").select(
        columns.cite_keys(F.col("t")).alias("c"), columns.ref_keys(F.col("t")).alias("r"), columns.urls(F.col("t")).alias("u"), columns.graphics(F.col("t")).alias("g"), columns.footnotes(F.col("t")).alias("f"),
        columns.labels(F.col("t")).alias("l"), columns.includes(F.col("t")).alias("i"), columns.packages(F.col("t")).alias("p"),
    ).first()
    assert (row.c, row.r, row.u, row.g, row.f) == (["a", "b", "c"], ["s:1", "s:2", "q"], ["u", "https://doi.org/10/1"], ["f"], ["a {b} c"])
    assert (row.l, row.i, row.p) == (["l"], ["ch1"], ["p", "q"])


def test_nested_patterns_pairs_and_substitution():
    assert lexing.nested("a <b <c> d> e", "<", ">")[2] == "b <c> d" and lexing.nested("a < b", "<", ">") is None and lexing.nested("((x)) (y)", r"\(", r"\)", 5) == (6, 9, "y")
    assert lexing.pairs_as_environments(r"\p \q x\endq\endp \endr \q") == r"\begin{p} \begin{q} x\end{q}\end{p} \endr \q"
    assert lexing.pairs_as_environments(r"\\q \endq") == r"\\q \endq"
    table = [(r"b+", "<b>"), (r"a(.)", r"\1-"), (r"\d", lambda m: str(int(m[0]) + 1))]
    assert lexing.substitute_patterns("bb ax a7 9", table) == "<b> x- 7- 10" and lexing.substitute_patterns("x", []) == "x"


def test_flattened_tokens():
    from paperlake.plans.document import flattened

    made, held = flattened([{"type": "text", "content": "a "}, {"type": "equation", "content": "x"}, {"type": "text", "content": " b"}, {"type": "ref", "content": ["k"]}])
    assert made == "a `|REF_0|` b`|REF_1|`" and [t["type"] for t in held.values()] == ["equation", "ref"]
