"""The kernel: text to tokens, one case an operator."""

import pytest

from paperlake.operators import bibliography
from paperlake.operators.kernel import Parser
from paperlake.operators.tokens import flatten, rows_of


def parse(text, files=None, preprocess=False):
    return Parser(files).document(text, preprocess)


def text(content, *styles):
    return {"type": "text", "content": content} | ({"styles": list(styles)} if styles else {})


def brief(tokens):
    """Types with their text, for long results."""
    return [(t["type"], t["content"] if isinstance(t.get("content"), str) else brief(t.get("content") or []) if all(isinstance(x, dict) for x in t.get("content") or []) else t["content"]) for t in tokens]


CASES = [
    # macros
    (r"\newcommand{\root}[2][n]{#2_{#1}} $\root[k]{a}$ $\root{b}$", [{"type": "equation", "content": "a_{k}"}, {"type": "equation", "content": "b_{n}"}]),
    (r"\newcommand\span[2]{from #1 to #2.} \span{Oslo} \span", [text("from Oslo to . from to .")]),
    (r"\newcommand{\nrm}[1]{\Vert#1\Vert} $\nrm{u}$", [{"type": "equation", "content": r"\Vert{u}\Vert"}]),
    (r"\newcommand{\pre}[1]{#1x} $\pre{y}$", [{"type": "equation", "content": "{y}x"}]),
    (r"\def\mood{\@ifstar{glad}{sad}}\mood; \mood*", [text("sad; glad")]),
    (r"\def\trip<#1>to<#2>{#2 after #1}\trip<Rome>to<Bern>", [text("Bern after Rome")]),
    (r"\def\clock#1:#2{#1h#2} \clock12:30", [text("12h30")]),
    (r"\def\tea{green}\let\cup=\tea\def\tea{black}\tea/\cup", [text("black/green")]),
    (r"\def\n{7}\edef\frozen{\n}\def\n{8}\frozen\n", [text("78")]),
    (r"\newcommand{\who}{Ann}\renewcommand{\who}{Bo}\who", [text("Bo")]),
    (r"\newcommand{\maker}[1]{\newcommand{\made}[1]{#1 of ##1}}\maker{king}\made{hearts}", [text("king of hearts")]),
    (r"\DeclarePairedDelimiter{\floor}{<}{>} $\floor*{z}$", [{"type": "equation", "content": "<z>"}]),
    (r"\newcommand{\scr}{\mathcal L} $y^\scr$", [{"type": "equation", "content": r"y^{\mathcal L}"}]), (r"\newcommand{\ab}{a+b} $x_\ab c 2\ab$", [{"type": "equation", "content": "x_{a+b} c 2{a+b}"}]),
    (r"\newcommand{\scr}{\mathcal L}\newcommand{\al}{\alpha} $\frac\scr 2=\scr\al^2$", [{"type": "equation", "content": r"\frac{\mathcal L} 2=\mathcal L\alpha^2"}]),
    (r"\@namedef{river}{Elbe}\river", [text("Elbe")]), (r"\newlength{\gap}\setlength{\gap}{1em}left\gap right", [text("left right")]), (r"\newtoks\box@t \box@t{abc}rest", [text("rest")]),
    (r"\newcommand{\hail}[1]{Ave #1}\csname hail\endcsname{Eva}", [text("Ave Eva")]), (r"\newcommand{\kind}{ail}\def\hail{H}\csname h\kind\endcsname", [text("H")]), (r"\newcommand{\q}{z} $\csname q\endcsname+1$", [{"type": "equation", "content": "z+1"}]),
    (r"\newenvironment{framed}[2][top]{\begin{center}#1/#2}{\end{center}}\begin{framed}{low}body\end{framed}", [{"type": "group", "name": "center", "content": [text("top/low body")]}]),
    (r"\define@key{house}{door}{#1 door}\setkeys{house}{door=Red}", [text("Red door")]),
    (r"\newcommand{\again}{\again}\again", [{"type": "command", "command": r"\again"}]),
    # conditionals
    (r"\if{wet} rain \elseif{dry} sun \else snow \fi end", [text("rain end")]), (r"\iffalse night \else day \fi", [text("day")]), (r"\ifwhat", [{"type": "command", "command": r"\ifwhat"}]),
    (r"\newif\iflong@v \long@vtrue\iflong@v full\else short\fi", [text("full")]), (r"\ifthenelse{t}{yes}{no}", [text("yes")]), (r"\IfFileExists{z}{has}{lacks} \@ifundefined{v}{un}{de}", [text("has un")]), (r"\ifnum 3>2 more\else less\fi", [text("more")]),
    (r"\forloop{i}{1}{9}{x}after\foreach \c in {r,g}{\c}", [text("after")]),
    # text and styles
    (r"\textbf{loud} \textit{\emph{soft}}", [text("loud ", "bold"), text("soft", "italic")]), (r"\textsc NATO", [text("N", "small-caps"), text("ATO")]), (r"\textit{  }next", [text("next")]),
    (r"\textcolor[HTML]{00AA11}{leaf}", [text("leaf", "color={HTML:00AA11}")]), (r"{\color{teal}sea}+{\color{sand}shore}", [text("sea", "color=teal"), text("+"), text("shore", "color=sand")]),
    (r"{\it lean} up", [text("lean", "italic"), text(" up")]), (r"\nicefrac{half}{whole}", [text("half / whole")]), (r"\romannumeral 49", [text("xlix")]), (r"\num[round-precision=1]{2.65}", [text("2.7")]),
    (r"K\"onigsberg \beta{} \% \& \#9", [text("Königsberg β % & #9")]), (r"\texorpdfstring{$E$}{E}\citetext{f}", [text("Ef")]), (r"up\\down", [text("up\ndown")]), (r"one~two\quad three\,four\!s", [text("one two three fours")]),
    (r"\mbox{in} \raisebox{3pt}[2pt][1pt]{up} \hbox to 2in{on} \colorbox{red}{by}", [text("in up on by")]), (r"\newsavebox{\crate}\sbox{\crate}{kept}\usebox{\crate}", [text("kept")]),
    (r"\strange{arg} rest", [{"type": "command", "command": r"\strange"}, text("arg rest")]), (r"$\leqslant$ \leqslant{} \gtrsim{} \bigstar \CYRB", [{"type": "equation", "content": r"\leqslant"}, text(" ⩽ ≳ ★ Б")]),
    # dropped layout
    (r"\usepackage[utf8]{inputenc}\maketitle\raggedright\vskip 4pt minus 2pt\hypersetup{k}\setcounter{page}{3}\addcontentsline{toc}{sec}{T}\pagestyle{plain}\noindent text", [text("text")]),
    (r"\titlespacing{s}{1}{2}{3}\DeclareFontShape{p}{q}{r}{s}{t}{u}\titleformat{v}{w}{x}{y}{z}kept", [text("kept")]),
    (r"\Hy@raisedlink{anchor}\startcontents[part]\contentspage\penalty-50 \clubpenalty=9 \wd2 \rule{1pt}{2pt}\cmidrule(r){2-3}plain", [text("plain")]), (r"wide 2.5\baselineskip tall", [text("wide tall")]),
    # math
    (r"$a^b$ then \(c_d\)", [{"type": "equation", "content": "a^b"}, text(" then "), {"type": "equation", "content": "c_d"}]), (r"$$p$$\[q\]", [{"type": "equation", "content": "p", "display": "block"}, {"type": "equation", "content": "q", "display": "block"}]),
    (r"\begin{align}u &= v\end{align}", [{"type": "equation", "content": "u &= v", "display": "block", "numbered": True, "align": True}]), (r"\begin{equation*}E\label{m}\label{n}\end{equation*}", [{"type": "equation", "content": "E", "display": "block", "labels": ["m", "n"]}]),
    (r"$$ { $$n+m$$ } $$", [{"type": "equation", "content": "{ $$n+m$$ }", "display": "block"}]), (r"\ensuremath{\pi}", [{"type": "equation", "content": r"\pi"}]), ("$k^3", [text("$k^3")]),
    (r"$$\cases p \\ \matrix q \endmatrix \endcases$$", [{"type": "equation", "content": r"\begin{cases} p \\ \begin{matrix} q \end{matrix} \end{cases}", "display": "block"}]),
    (r"\begin{equation*} s \eqref{w} \end{equation*}", [{"type": "equation", "content": "s ___PLACEHOLDER_0___", "display": "block", "placeholders": {"___PLACEHOLDER_0___": [{"type": "ref", "content": ["w"]}]}}]),
    # content commands
    (r"\subsection*{Tools}", [{"type": "section", "level": 2, "numbered": False, "title": [text("Tools")]}]), (r"\SECTION{Aims}\label{aim}", [{"type": "section", "level": 1, "numbered": True, "title": [text("Aims")], "labels": ["aim"]}]),
    (r"\footnotemark\footnotemark[4]", [{"type": "footnote", "content": [text("*")]}, {"type": "footnote", "content": [text("4")]}]), (r"\cref{one,two}", [{"type": "ref", "content": ["one", "two"]}]),
    (r"\cite[ch. 3][fig. 5]{knuth}", [{"type": "citation", "content": ["knuth"], "title": [text("ch. 3, fig. 5")]}]), (r"\defcitealias{euler}{Book E}\citetalias{euler, gauss}", [{"type": "citation", "content": ["euler"], "title": [text("Book E")]}, {"type": "citation", "content": ["gauss"]}]),
    (r"\includepdf[pages={2,4-6}]{scan}", [{"type": "includepdf", "content": "scan", "pages": "2,4-6"}]), (r"\href{site}{name}\doi{10.5/z}", [{"type": "url", "content": "site", "title": [text("name")]}, {"type": "url", "content": "https://doi.org/10.5/z"}]),
    (r"\hyperref[goal]{there}", [{"type": "ref", "title": [text("there")], "content": ["goal"]}]), (r"\author{Ida Moe \And Per Li}", [{"type": "author", "content": [[text("Ida Moe")], [text("Per Li")]]}]), (r"\verb!x{y!", [{"type": "code", "content": "x{y", "display": "inline"}]),
    # environments
    (r"\newtheorem{rule}{Law}\begin{rule}holds\end{rule}", [{"type": "environment", "name": "Law", "content": [text("holds")]}]), (r"\begin{comment}hidden\end{comment}shown", [text("shown")]),
    (r"\begin{lemma}[$L$] body\end{lemma}", [{"type": "math_env", "name": "lemma", "numbered": True, "title": [{"type": "equation", "content": "L"}], "content": [text("body")]}]),
    (r"\begin{verbatim}\raw{&}\end{verbatim}", [{"type": "code", "content": r"\raw{&}", "display": "block"}]), (r"\begin{picture}\line\end{picture}", [{"type": "diagram", "name": "picture", "content": r"\begin{picture}\line\end{picture}"}]),
    (r"\begingroup within\endgroup", [{"type": "group", "content": [text("within")]}]), (r"\subfloat[left]{part}", [{"type": "group", "content": [{"type": "caption", "content": [text("left")]}, text("part")]}]),
]


@pytest.mark.parametrize(("source", "want"), CASES)
def test_case(source, want):
    assert parse(source) == want


def test_label_after_caption_belongs_to_the_caption():
    (t,) = parse(r"\begin{algorithm}\caption{A}\label{alg}\end{algorithm}")
    assert "labels" not in t and t["content"][0]["labels"] == ["alg"]


def test_tabular():
    (t,) = parse(r"\begin{tabular}{|l|r|} \hline iron & \textit{zinc} & 9 \\ \hline \multicolumn{2}{|c|}{metals} & \\ & salt \& tin & \hline \end{tabular}")
    assert t["content"] == [["iron", [text("zinc", "italic")], "9"], [{"content": "metals", "rowspan": 1, "colspan": 2}, None], [None, "salt & tin", None]]
    (t,) = parse(r"\begin{tabular}{cc} & \\ x & y \\ w & \makecell{u \\ v} \\ & \end{tabular}")
    assert t["content"] == [["x", "y"], ["w", "u\nv"]]


def test_lists():
    (t,) = parse(r"\begin{itemize}\item[x] one \begin{enumerate}\item a\end{enumerate}\item two\end{itemize}")
    assert brief(t["content"]) == [("item", [("text", "one"), ("list", [("item", [("text", "a")])])]), ("item", [("text", "two")])] and t["content"][0]["title"] == [text("x")]
    p = Parser()
    p.document(r"\begin{itemize} stray \item a\end{itemize}")
    assert p.errors == [("list", "text before the first item")]


def test_preprocess_and_files():
    files = {"local.sty": r"\newcommand{\shade}{dark}", "chapter.tex": "\\section{Two}\n$n$", "refs.bib": "@book{k, title={T}}"}
    assert brief(parse(r"\input{chapter} more", files)) == [("section", []), ("equation", "n"), ("text", " more")]
    assert parse("before \\documentclass{book}\\usepackage{local} ``so'' `it' \\shade goes", files, True) == [text("\"so\" 'it' goes")]
    kept = "\\begin{algorithmic}``as''  is\\end{algorithmic}\\verb|`v'|"
    assert Parser().expand_text("``q''  " + kept) == '"q" ' + kept
    (t,) = parse(r"\bibliography{refs}", files)
    assert t["content"] == [{"type": "bibitem", "format": "bibtex", "cite_key": "k", "content": "@book{k,\n\ttitle={T}\n}", "fields": {"title": "T"}}]
    assert parse(r"\def\bal{\begin{gather}}\def\eal{\end{gather}} \bal 3=2+1 \eal")[0]["content"] == "3=2+1"
    assert Parser().expand_text(r"\def\bal{\begin{gather}}\newcommand{\arg}[1]{<#1>}\newif\ifbig \bal \arg{x} \ifbig yes\else no\fi $\bal$").strip() == r"\newcommand{\arg}[1]{<#1>} \begin{gather} \arg{x} yes $\bal$"
    assert Parser({"a.tex": r"\input{a}"}).document("") == [] and rows_of(r"\input{a}", files={"a.tex": r"\input{a}"})[-1]["type"] == "error"


def test_bibliographies():
    assert bibliography.parse("@misc{z9, title={On {Z}}, author=\"Noor and Sol\"}")[0]["fields"] == {"title": "On {Z}", "author": "Noor and Sol"}
    assert bibliography.parse("@article{nokey}") == []
    (e,) = bibliography.parse(r"\begin{bibdiv}\bib{k}{article}{author={A, B}, author={C, D}, title={T}}\end{bibdiv}")
    assert e["fields"] == {"author": "A, B and C, D", "title": "T"}
    items = bibliography.parse(r"\bibitem[L]{a} One, \newblock two \bibitem{b} \bysame, three")
    assert [(i["cite_key"], i["content"]) for i in items] == [("a", "One, two"), ("b", "One, three")] and items[0]["label"] == "L"
    compiled = r"\entry{k}{article}{}\name{author}{1}{}{{{hash=x}{family={Doe},familyi={D},given={Jo},giveni={J\bibinitperiod}}}}\field{journaltitle}{J}\field{year}{2020}\verb{eprint}\verb 12.3\endverb\endentry"
    (e,) = bibliography.parse(compiled)
    assert e["fields"] == {"author": "Doe, J.", "journal": "J", "year": "2020", "eprint": "12.3"}


def test_rows_and_errors():
    rows = flatten(parse(r"\section{A \textbf{b}} $x$ \begin{figure}\caption{c}\end{figure}"))
    assert [(r["token_id"], r["parent_id"], r["slot"], r["type"], r["last_desc"]) for r in rows] == [
        (0, None, "content", "section", 2), (1, 0, "title", "text", 1), (2, 0, "title", "text", 2), (3, None, "content", "equation", 3), (4, None, "content", "figure", 6), (5, 4, "content", "caption", 6), (6, 5, "content", "text", 6),
    ]
    assert rows_of("{" * 400 + "}" * 400)[-1]["text"] == "nesting is too deep"
    assert rows_of(None) == [] and rows_of("") == []
    assert [r["type"] for r in rows_of(r"\begin{nothing} x")] == ["text", "error"]


def test_long_texts_stay_linear():
    import time

    unit = r"\newcommand{\a}[1]{<#1>} \a{word} $x$ \textbf{b} \begin{itemize}\item c\end{itemize} "
    began = time.time()
    n = len(Parser().document(unit * 3000))
    assert n > 3000 and time.time() - began < 60


def test_any_number_of_macro_uses():
    define = "\\newcommand{\\a}[1]{<\\b{#1}>}\\newcommand{\\b}[1]{(#1)}"
    body = "\\a{word}\\par\n" * 12_000
    document = "\\begin{document}" + body + "\\end{document}"
    for text, files in [
        (define + body, None), (define + document, None), (define + "{" + body + "}", None), (define + r"\input{x}", {"x.tex": body}), (define + r"\newenvironment{y}{begin text}{" + "end text " * 9 + r"}\begin{y}" + document + r"\end{y}", None),
        (define + r"\def\bd{\begin{document}}\def\ed{\end{document}}\bd " + body + r"\ed", None), (define + r"\begin{itemize}\item " + body + r"\end{itemize}", None), (define + r"\footnote{\textbf{" + body.replace(r"\par", "") + "}}", None),
        (define + r"\begin{tabular}{l}" + body.replace(r"\par", "") + r"\end{tabular}", None), (define + r"\newcommand{\c}[1]{\textbf{\a{#1}}}" + body.replace(r"\a", r"\c"), None),
    ]:
        rows = rows_of(text, files=files)
        assert not [r for r in rows if r["type"] == "error"]
        assert sum((r["text"] or "").count("<(word)>") for r in rows) == 12_000
    (t,) = parse(define + "$" + "\\a{x} " * 12_000 + "$")
    assert t["content"].count("<(x)>") == 12_000


def test_endless_definitions_stop_and_keep_what_was_read():
    for define, use in [
        (r"\def\a{\a}", r"\a"), (r"\def\a{x\a}", r"\a"), (r"\def\a{\a x}", r"\a"), (r"\def\a{\a\a}", r"\a z"), (r"\def\a#1{\a}", r"\a{b} c"), (r"\def\a{\b}\def\b{\a}", "$\\a$"), (r"\newenvironment{e}{\begin{e}\end{e}}{}", r"\begin{e}\end{e}"),
        ("".join(rf"\def\{x}{{{{\{y}}}{{\{y}}}}}" for x, y in zip("abcdefghijklmnopqrstuvw", "bcdefghijklmnopqrstuvwx")), r"\a"),
        ("".join(rf"\def\m{x}{{\footnote{{$\m{y}\m{y}$}}}}" for x, y in zip("abcdefghijklmnopqrstuvw", "bcdefghijklmnopqrstuvwx")), r"$\ma$"),
    ]:
        rows = rows_of(r"\section{S} before " + define + "\\begin{abstract} inside " + use + "\\end{abstract} after")
        assert rows[-1]["type"] == "error" and sum(r["type"] == "error" for r in rows) == 1, define
        texts = [r["text"] or "" for r in rows[:-1]]
        assert rows[0]["type"] == "section" and any("before" in t for t in texts) and any("inside" in t for t in texts) and not any("after" in t for t in texts), define
        assert any(r["type"] == "abstract" for r in rows)


def test_definitions_of_style_files_behind_conditions():
    from paperlake.operators.kernel import Parser

    files = {"a.sty": r"\newif\ifnew@f{\ifnew@f\newcommand{\in}{I}\else\newcommand{\out}{O}\fi}\AtBeginDocument{\newcommand{\late}{L}\IfFileExists{b.sty}{\RequirePackage{b}}{}}", "b.sty": r"\usepackage{a}\@ifundefined{k}{\def\never{N}}{}\def\more{M}"}
    p = Parser(files, expand_styles=True)
    assert p.document(r"\documentclass{x}\usepackage{a}\in\late", True) == [text("IL")] and "out" not in p.macros and "never" not in p.macros
    p.style("b.sty")
    assert p.macros["more"].from_style


def test_names_that_definitions_may_not_take():
    for name in ("section", "cite", "textbf", "bfseries", "Large", "caption", "subparagraph", "thanks"):
        p = Parser()
        p.document(rf"\renewcommand{{\{name}}}{{no}}")
        assert name not in p.macros
    p = Parser()
    p.document(r"\renewcommand{\underline}[1]{[#1]}")
    assert "underline" in p.macros


def test_every_symbol_is_a_character():
    from paperlake.functions import symbols

    table = symbols.symbols()
    assert len(table) > 1200 and all(v and ("\\" not in v or k == "textbackslash") for k, v in table.items())
    assert [symbols.ding(k) for k in (33, 52, 172, 181, 212, 213, 254)] == list("✁✔①⑩➔→➾") and symbols.ding(240) is symbols.ding(12) is None
    assert symbols.to_unicode(r"\mathbf{\Gamma x}\mathsfsl{k}\ding{51}\cyrya") == "𝚪 𝐱𝘬✓я"
