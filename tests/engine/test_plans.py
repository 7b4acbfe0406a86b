"""Structure, graphs, documents, bundles and streams."""

import gzip
import io
import json
import random
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from paperlake.operators.tokens import definitions, errors, parse_documents, register_sql
from paperlake.plans import document, graph, structure
from paperlake.sources import bundles
from paperlake.streaming import ingest

PAPER = r"""
\title{T} \author{A \and B}
\begin{document}
\section{One}\label{s:1} Text \textbf{b} \textbf{c}. \begin{equation}x\end{equation}
\begin{theorem}[t] a\end{theorem}\begin{proof}p\end{proof}
\subsection*{Starred} \paragraph{P} para \subsection{Two} \cite{k, z} \ref{s:1}\ref{none}
\begin{tabular}{c} $$q$$ & \begin{equation}in cell\end{equation}\end{tabular}
\begin{itemize}\item \begin{enumerate}\item x\end{enumerate}\end{itemize}
\begin{figure}\caption{c}\end{figure}
\appendix \section{App} \subsection{Sub}
\begin{thebibliography}{9}\bibitem{k} K \bibitem{k} again\end{thebibliography}
\end{document}
"""


@pytest.fixture(scope="module")
def tokens(spark):
    return parse_documents(spark.createDataFrame([(1, PAPER), (2, None), (3, "")], "doc_id long, text string")).cache()


def test_document_tree():
    tree, _ = document.to_tree(PAPER)
    doc = tree[-1]
    numbered = []

    def walk(x):
        for t in x:
            if isinstance(t, dict):
                if "numbering" in t:
                    numbered.append((t["type"], t["numbering"]))
                walk(t.get("content") or [] if isinstance(t.get("content"), list) else [])

    walk(doc["content"])
    assert numbered == [("section", "1"), ("equation", "1"), ("math_env", "1.1"), ("section", "1.1"), ("figure", "1"), ("section", "A"), ("section", "A.1")]
    assert [t["type"] for t in doc["content"]] == ["section", "appendix"]
    assert doc["content"][0]["content"][1] == {"type": "text", "content": "b c", "styles": ["bold"]}
    made = json.loads(document.to_json(r"\definecolor{c}{RGB}{1,2,3} x"))
    assert made == {"tokens": [{"type": "text", "content": "x"}], "color_map": {"c": {"format": "RGB", "value": "1,2,3"}}}


def test_windows_number_as_the_tree_does(spark):
    rng, rows = random.Random(1), []
    for doc in range(60):
        for pos in range(rng.randrange(1, 25)):
            rows.append((doc, pos, rng.choice([1, 1, 2, 2, 3]), rng.random() < 0.8, rng.random() < 0.05))
    df = spark.createDataFrame(rows, "doc_id long, pos long, level long, numbered boolean, appendix boolean")
    sections = df.withColumn("level", F.expr("if(appendix, null, level)")).withColumn("numbered", F.expr("numbered and not appendix"))
    got = {(r.doc_id, r.pos): r.numbering for r in structure.number_sections(sections).collect()}
    parents = {(r.doc_id, r.pos): r.parent for r in structure.section_parents(df).collect()}
    for doc in range(60):
        tree, stack = document.Tree(), []
        for d, pos, level, numbered, appendix in rows:
            if d != doc:
                continue
            if appendix:
                tree.appendix, tree.section = True, {}
                assert got[d, pos] is None
            else:
                assert got[d, pos] == tree.number({"level": level, "numbered": numbered})
            while stack and stack[-1][1] >= level:
                stack.pop()
            assert parents[d, pos] == (stack[-1][0] if stack else None)
            stack.append((pos, level))


def test_blocks_lists_and_merging(tokens):
    assert sorted((r.type, r.numbering) for r in structure.number_blocks(tokens).collect()) == [("equation", "1"), ("figure", "1"), ("math_env", "1.1")]
    assert sorted(r.depth for r in structure.list_depths(tokens).collect()) == [1, 2]
    assert any(r.text == "b c" and r.styles == ["bold"] for r in structure.merge_text(tokens).collect())
    assert structure.theorem_proofs(tokens).count() == 1
    assert structure.enclosing_section(tokens).filter("type = 'citation' AND section_id IS NOT NULL").count() == 1


def test_graphs(tokens):
    cites = graph.resolve_citations(graph.cite_edges(tokens), graph.bib_entries(tokens)).collect()
    assert sorted((r.key, r.found) for r in cites) == [("k", True), ("z", False)]
    assert [r.key for r in graph.unresolved_citations(graph.cite_edges(tokens), graph.bib_entries(tokens)).collect()] == ["z"]
    refs = graph.resolve_references(graph.ref_edges(tokens), graph.labels(tokens)).collect()
    assert sorted((r.key, r.target_type) for r in refs) == [("none", None), ("s:1", "section")]
    assert sorted((r.key, r.found) for r in graph.citations_in_place(tokens).collect()) == [("k", True), ("z", False)]
    assert sorted((r.key, r.target_type) for r in graph.references_in_place(tokens).collect()) == [("none", None), ("s:1", "section")]
    assert graph.table_cells(tokens).count() == 2
    assert {r.type for r in graph.type_histogram(tokens).collect()} >= {"section", "tabular", "bibitem"}


def test_errors_definitions_and_types(spark):
    df = spark.createDataFrame([("a", r"\newcommand{\x}[1][d]{y#1}\newtheorem{t}{Th}\definecolor{c}{rgb}{1} \begin{q} \unk"), ("b", r"\ifthenelse{a}")], "paper string, body string")
    made = parse_documents(df, "paper", "body")
    assert sorted((r.paper, r.stage) for r in errors(made, "paper").collect()) == [("a", "environment"), ("b", "parse")]
    assert sorted((r.kind, r.name, r.n_args, r.defaults) for r in definitions(df, "paper", "body").collect()) == [("color", "c", 0, []), ("newcommand", "x", 1, ["d"]), ("theorem", "t", 0, [])]
    assert [r.command for r in graph.unknown_commands(made).collect()] == ["\\unk"]
    assert {r.type for r in parse_documents(df, "paper", "body", types=["command"]).collect()} == {"command", "error"}
    assert parse_documents(df.filter("paper = 'z'"), "paper", "body").count() == 0


def test_sql_functions(spark):
    register_sql(spark)
    row = spark.sql(r"SELECT latex_strip_comments('a % b') AS s, latex_to_text(r'\textbf{x} $y$ \cite{k}') AS t, latex_to_json('x') AS j").first()
    assert (row.s, row.t, json.loads(row.j)["tokens"]) == ("a", "x y", [{"type": "text", "content": "x"}])
    spark.createDataFrame([(1, r"\section{A} b")], "id long, body string").createOrReplaceTempView("latex_docs")
    assert [r.type for r in spark.sql("SELECT id, t.type FROM latex_docs, LATERAL latex_tokens(body) t ORDER BY t.token_id").collect()] == ["section", "text", "text"]


MAIN = "\\documentclass{article}\\begin{document}\\input{sec/one} caf\u00e9\\bibliography{refs}\\end{document}"
FILES = {"main.tex": MAIN, "sec/one.tex": "\\section{One}\\cite{k}", "refs.bbl": "\\bibitem{k} Key", "unused.tex": "no"}


def archives(folder):
    with zipfile.ZipFile(folder / "p1.zip", "w") as z:
        for n, t in FILES.items():
            z.writestr(n, t)
        z.writestr("../evil.tex", "x")
    with tarfile.open(folder / "p2.tar.gz", "w:gz") as t:
        for n, x in FILES.items():
            raw = x.encode("cp1252")
            info = tarfile.TarInfo(n)
            info.size = len(raw)
            t.addfile(info, io.BytesIO(raw))
    (folder / "p3.gz").write_bytes(gzip.compress(MAIN.replace("\\input{sec/one}", "").encode("latin-1")))
    (folder / "bad.tar.gz").write_bytes(b"Invalid content")
    (folder / "notmain.gz").write_bytes(gzip.compress(b"prose"))
    (folder / "p4").mkdir()
    for n, x in FILES.items():
        (folder / "p4" / n).parent.mkdir(exist_ok=True)
        (folder / "p4" / n).write_text(x)
    (folder / "p5.tex").write_text(MAIN.replace("\\input{sec/one}", "").replace("\\bibliography{refs}", ""))


def test_bundles(spark, tmp_path):
    archives(tmp_path)
    files = bundles.read(spark, str(tmp_path)).cache()
    assert sorted((r.paper_id, r.error[:11]) for r in files.filter("error IS NOT NULL").collect()) == [("bad.tar.gz", "BadGzipFile"), ("notmain.gz", "not a main "), ("p1.zip", "unsafe name")]
    good = bundles.decode(files.filter("error IS NULL")).cache()
    assert {(r.paper_id, r.encoding) for r in good.filter("rel_path LIKE '%main.tex' OR rel_path LIKE 'p3%'").collect()} == {("p1.zip", "utf-8"), ("p2.tar.gz", "cp1252"), ("p3.gz", "cp1252"), ("p4", "utf-8")}
    papers = bundles.papers(good)
    assert {(r.paper_id, r.main_path) for r in papers.collect()} == {("p1.zip", "main.tex"), ("p2.tar.gz", "main.tex"), ("p3.gz", "p3.tex"), ("p4", "main.tex"), ("p5.tex", "p5.tex")}
    tokens = parse_documents(papers, "paper_id", "text", True, files_col="files")
    counted = {(r.paper_id, r.type): r["count"] for r in tokens.groupBy("paper_id", "type").count().collect()}
    for p in ("p1.zip", "p2.tar.gz", "p4"):
        assert counted[p, "section"] == counted[p, "bibitem"] == counted[p, "citation"] == 1
    assert tokens.filter("text LIKE '%café%'").select("paper_id").distinct().count() == 5
    assert sorted((r.rel_path, r.target) for r in bundles.include_edges(good.filter("paper_id = 'p4'")).collect()) == [("main.tex", "sec/one.tex")]
    assert sorted((r.rel_path, r.depth) for r in bundles.reachable(good.filter("paper_id = 'p4'")).collect()) == [("main.tex", 0), ("sec/one.tex", 1)]
    out = str(tmp_path / "json")
    bundles.write_json(document.documents_json(papers, "paper_id", "text", True, "files"), out)
    assert spark.read.json(out).count() == 5


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    archives(tmp_path / "in")
    out = str(tmp_path / "out")
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest(spark, str(tmp_path / "in"), out, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert spark.read.parquet(out).filter("type = 'section'").count() == 3


def test_tree_options_and_parts():
    tree, _ = document.to_tree(r"\begin{lemma}a\end{lemma}\begin{proof}p\end{proof} x $y$ z", merge_proofs=True, math_as_text=True)
    assert tree[0]["proof"]["content"] == [{"type": "text", "content": "p"}] and tree[1] == {"type": "text", "content": "x <math>y</math> z"}
    tree, _ = document.to_tree(r"\part{P}\section{S}\subsubsubsection{D}\part{Q}")
    assert [t["numbering"] for t in tree] == ["1", "2"] and tree[0]["content"][0]["numbering"] == "1" and tree[0]["content"][0]["content"][0]["numbering"] == "1.0.0.1"


def test_registered_command():
    from paperlake.operators import kernel

    kernel.register("shout", lambda p, source, name, out, frame: p.put(out, {"type": "shout", "content": source.block()}, frame), ("shout",))
    try:
        assert document.to_tree(r"\shout{x}")[0] == [{"type": "shout", "content": "x"}]
    finally:
        kernel.HANDLERS.pop("shout")
        kernel.TOKEN_TYPES.discard("shout")


def test_preamble(spark):
    from paperlake.functions import columns, lexing

    tex = "junk\n\\documentclass[a]{b}\n\\usepackage{p}\n\\newcommand{\\x}{\n y}\nprose\n\\makeatletter\n\\z\n\\makeatother\n\\begin{document}\\def\\no{}"
    assert lexing.preamble(tex) == "\\usepackage{p}\n\\newcommand{\\x}{\n y}\n\\makeatletter\n\\z\n\\makeatother"
    got = spark.createDataFrame([(tex,)], "t string").select(columns.preamble(F.col("t"))).first()[0]
    assert got.strip().startswith("\\usepackage{p}") and got.strip().endswith("\\makeatother")
    assert lexing.comment_on_line("a % b\nc", 4) and not lexing.comment_on_line("a % b\nc", 7) and not lexing.comment_on_line(r"a \% b", 5)


def test_report_of_errors(spark, tmp_path):
    from paperlake.sources import logs

    df = spark.createDataFrame([("a", r"\ifthenelse{x}"), ("b", r"\ifthenelse{x}"), ("c", "fine")], "paper string, body string")
    found = errors(parse_documents(df, "paper", "body"), "paper")
    to = logs.logger("paperlake.test", "INFO", f"{tmp_path}/log.txt")
    assert logs.logger("paperlake.test", "INFO", f"{tmp_path}/log.txt") is to and len(to.handlers) == 2
    assert logs.report(found, to) == 2 and "(2 times)" in open(f"{tmp_path}/log.txt", encoding="utf-8").read()
    with pytest.raises(ValueError):
        logs.report(found, to, strict=True)
    assert logs.report(found.filter("stage = 'none'"), to, strict=True) == 0


@pytest.mark.parametrize("kind", ["bigint", "int", "string", "double", "date", "decimal(20,2)", "binary"])
def test_ids_of_any_type(spark, kind):
    from pyspark.sql import functions as F

    value = "20200102" if kind != "date" else "2020-01-02"
    df = spark.createDataFrame([(value, "x")], "k string, text string").select(F.col("k").cast(kind).alias("k"), "text")
    made = parse_documents(df, "k")
    assert made.schema["k"].dataType == df.schema["k"].dataType and made.first().k == df.first().k
    assert document.documents_json(df, "k").first().k == df.first().k


def test_archives_that_are_too_large_are_reported(spark, monkeypatch):
    import gzip

    monkeypatch.setattr(bundles, "MOST_BYTES", 1000)
    assert list(bundles.unpack("a.gz", gzip.compress(b"\\documentclass{x}" + b"a" * 2000))) == [("a.gz", None, "too large")]
    ((name, text, error),) = bundles.unpack("b.gz", gzip.compress(b"\\documentclass{x}"))
    assert (name, error) == ("b.tex", None) and text == b"\\documentclass{x}"


def test_includes_of_any_depth(spark):
    n = 60
    rows = [("p", "main.tex", r"\documentclass{x}\input{f0}\input{f3}")] + [("p", f"f{k}.tex", rf"\input{{f{k + 1}}}\input{{main}}") for k in range(n)] + [("q", "main.tex", r"\documentclass{x}")]
    got = {(r.paper_id, r.rel_path): r.depth for r in bundles.reachable(spark.createDataFrame(rows, "paper_id string, rel_path string, text string")).collect()}
    assert got["p", "main.tex"] == got["q", "main.tex"] == 0 and got["p", f"f{n - 1}.tex"] == n - 3 and len(got) == n + 2


def test_wide_encodings(spark):
    rows = [(e, ("\ufeff" if mark else "") + "né", e, mark) for e, mark in (("utf-16", False), ("utf-16-be", True), ("utf-16-le", True), ("utf-32", False), ("utf-8", True), ("utf-8", False), ("cp1252", False))]
    df = spark.createDataFrame([(t.encode(e),) for _, t, e, _ in rows], "content binary")
    assert [r.text for r in bundles.decode(df).collect()] == ["né"] * len(rows)
