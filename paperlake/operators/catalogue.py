"""Which command means what. The names and their results define the language that is read."""

from __future__ import annotations

TOKEN_TYPES = set(
    "document title section paragraph abstract appendix command text quote group environment math_env figure subfigure table tabular caption includegraphics includepdf diagram list item"
    " equation code algorithm algorithmic citation ref url footnote bibliography bibitem author email affiliation keywords address".split()
)
#: Text commands and the style that they add; None: no style.
STYLES = {
    "textbf": "bold", "textit": "italic", "textsl": "italic", "emph": "italic", "textsc": "small-caps", "textsf": "sans-serif", "texttt": "monospace", "textrm": "normal", "textup": "normal", "textnormal": "normal",
    "texttiny": "xx-small", "textscriptsize": "x-small", "textfootnotesize": "small", "textsmall": "small", "textlarge": "large", "textlarger": "x-large", "texthuge": "xx-large", "textsuperscript": "superscript", "textsubscript": "subscript",
    "underline": "underline", "uline": "underline", "overline": "overline", "sout": "line-through", "uppercase": "uppercase", "lowercase": "lowercase", "text": None, "natexlab": None, "textmd": None, "textnumero": None,
}
#: Old font switches: in force to the end of their group or the next one.
FONT_SWITCHES = {
    "tt": "monospace", "ttfamily": "monospace", "bf": "bold", "bfseries": "bold", "bold": "bold", "it": "italic", "itshape": "italic", "sl": "italic", "slshape": "italic", "em": "italic", "sc": "small-caps", "scshape": "small-caps",
    "sf": "sans-serif", "sffamily": "sans-serif", "rm": "normal", "rmfamily": "normal", "upshape": "normal", "mdseries": "normal", "normalfont": "normal",
}
SIZE_SWITCHES = {
    "tiny": "xx-small", "scriptsize": "x-small", "footnotesize": "small", "small": "small", "normalsize": None, "large": "large", "Large": "x-large", "LARGE": "x-large", "huge": "xx-large", "Huge": "xx-large", "smaller": "small", "larger": "large",
}
ENVIRONMENTS = {
    "document": "document", "abstract": "abstract", "thebibliography": "bibliography", "appendix": "appendix", "appendices": "appendix", "table": "table", "subtable": "table", "subsubtable": "table", "figure": "figure",
    "wrapfigure": "figure", "subfigure": "subfigure", "subfloat": "subfigure", "algorithm": "algorithm", "algorithmic": "algorithmic", "quote": "quote", "quotation": "quote", "itemize": "list", "enumerate": "list", "description": "list", "list": "list",
} | dict.fromkeys("group center flushleft flushright minipage adjustbox spacing small subequations".split(), "group")
NUMBERED_THEOREMS = frozenset("theorem lemma proposition corollary definition conjecture axiom example exercise remark observation".split())
THEOREMS = NUMBERED_THEOREMS | frozenset("proof notation solution note claim".split())
EQUATIONS = frozenset("equation align aligned gather multline eqnarray flalign alignat dmath displaymath math".split())
TABLES = frozenset("tabular longtable tabularx tabulary".split())
DIAGRAMS = frozenset("tikzpicture picture pgfpicture".split())
VERBATIM = frozenset("verbatim lstlisting Verbatim".split())
#: Arguments after \begin{name}.
ENVIRONMENT_ARGS = {
    "thebibliography": "{", "minipage": "[[[{", "list": "{{", "adjustwidth": "{{", "spacing": "{", "multicols": "{", "table": "[", "figure": "[", "subfigure": "[{", "subtable": "[{", "wrapfigure": "[{[{", "adjustbox": "{", "CJK": "{{", "algorithm": "[", "algorithmic": "[",
}
CITES = frozenset("cite citep citet cites citealt citealp citeauthor citenum citeyear citeyearpar citefullauthor".split())
REFS = frozenset("ref autoref eqref pageref".split())
#: Boxes: arguments before the content.
BOXES = {
    "fbox": "", "hbox": "", "vbox": "", "mbox": "", "parbox": "[[[{", "makebox": "[[", "framebox": "[[", "raisebox": "{[[", "colorbox": "[{", "fcolorbox": "[{{", "scalebox": "{[", "pbox": "[{", "resizebox": "{{", "rotatebox": "[{", "adjustbox": "{",
    "fancyhead": "[", "fancyfoot": "[", "fancyheadoffset": "[", "rhead": "", "chead": "", "lhead": "",
}
#: Layout commands that are dropped, by their arguments.
DROPPED = {
    "": "maketitle makeatletter makeatother tableofcontents listoffigures listoftables @title today centering raggedright raggedleft noindent par clearpage cleardoublepage hfill vfill break sloppy fussy flushbottom raggedbottom flushleft flushright flushtop smallskip medskip bigskip"
    " hline toprule midrule bottomrule endhead endfoot endfirsthead endlastfoot ignorespaces relax global null FloatBarrier phantomsection linenumbers nolinenumbers linesnumbered frontmatter mainmatter backmatter nonumber notag"
    " newblock protect hfil vfil selectfont boldmath unboldmath mathversion normalcolor allowbreak nobreak allowdisplaybreaks samepage filbreak goodbreak smallbreak medbreak bigbreak unskip lastskip leavevmode expandafter noexpand endcsname arraycolsep hss vss strut tracing dotfill hrulefill fill"
    " hrule morecmidrules centerline colrule noalign @empty obeylines strutbox linewidth textwidth columnwidth textheight paperwidth paperheight hsize vsize labelwidth leftmargin rightmargin balance onecolumngrid twocolumngrid limits nolimits unvbox stackMath printindex"
    " contentspage thepage c@page the showthe string escapechar footins repeat @tempboxa @plus @minus hdashline z@ p@",
    "{": "date subjclass pagestyle thispagestyle urlstyle theoremstyle bibliographystyle setcitestyle hypersetup lstset pagecolor usetikzlibrary usepgflibrary usepgfplotslibrary pgfplotsset tcbset tcbuselibrary mathtoolset graphicspath cline cdashline nocite pagenumbering arabic Roman roman"
    " Alph alph fnsymbol value refstepcounter hyphenation pacs typeout pdfinfo setdefaultlanguage enlargethispage contentsline titlelabel curraddr linespread DeclareGraphicsExtensions labelsep fboxsep Xhline",
    "[{": "captionsetup setlist documentclass usepackage RequirePackage LoadClass documentstyle bookmark setmainfont setsansfont setmonofont setmathfont newmdenv rowcolor columncolor cellcolor geometry titleline ExecuteBibliographyOptions",
    "[": "printbibliography ProcessOptions addlinespace startcontents",
    "{{": "addtocontents addtocounter numberwithin counterwithin counterwithout @addtoreset PassOptionsToPackage PassOptionsToClass fontsize DeclareOption renewbibmacro rule",
    "{{{": "addcontentsline specialrule AddEnumerateCounter DeclareFontFamily", "{{{{": "usefont", "[{{": "pdfbookmark belowpdfbookmark currentpdfbookmark", "[{{{": "printcontents", "{[": "NeedsTeXFormat ProvidesClass ProvidesPackage",
    "{{{{{": "DeclareSymbolFont titleformat", "{{{{{{": "DeclareFontShape SetMathAlphabet titlecontents", "{{[": "newpagestyle renewpagestyle", "{{{{[": "titlespacing",
}
DROP = {name: spec for spec, names in DROPPED.items() for name in names.split()}
#: Lengths assigned or skipped in TeX's own way: the command and the dimension after it.
DIMENSIONED = frozenset("vskip hskip kern mkern raise lower hoffset voffset topmargin oddsidemargin evensidemargin baselineskip lineskip parskip parindent tabcolsep itemsep parsep topsep partopsep abovedisplayskip belowdisplayskip hangindent emergencystretch abovedisplayshortskip belowdisplayshortskip abovecaptionskip belowcaptionskip footskip headheight headsep footnotesep marginparsep marginparwidth itemindent vfuzz hfuzz arrayrulewidth heavyrulewidth overfullrule".split())
#: Whole numbers assigned in the same way; they take no unit.
INTEGERS = frozenset("penalty tolerance clubpenalty widowpenalty interfootnotelinepenalty pdfoutput pdfsuppresswarningpagegroup tracinglostchars".split())
#: Commands for white space and the text that they leave.
SPACES = {"quad": " ", "qquad": " ", "xspace": " ", "space": " ", ",": " ", ";": " ", ":": " ", " ": " ", "!": "", "/": "", ">": " ", "thinspace": " ", "enspace": " ", "indent": "\t", "newline": "\n", "linebreak": "\n", "pagebreak": "\n", "newpage": "\n", "nopagebreak": "\n", "nolinebreak": "\n"}
#: User macros may not take these names.
PROTECTED = frozenset(
    "newcommand begin end section subsection subsubsection paragraph subparagraph newline maketitle title author and thanks date part chapter abstract table figure cite citep citet caption captionof bibitem url ref appendix appendices \\ text"
    " textbf textit textsl textsc textsf texttt textrm textup textmd textnormal emph texttiny textscriptsize textfootnotesize textsmall textlarge texthuge boldmath unboldmath mathversion document documentclass def let renewcommand verb".split()
) | FONT_SWITCHES.keys() | SIZE_SWITCHES.keys()
CONDITIONS = frozenset("if ifx ifnum ifdim ifcat ifcase iftrue iffalse ifdefined ifundefined ifcsname ifodd ifmmode ifvmode ifhmode ifpdf ifeof ifvoid".split())
#: Skipped with their arguments.
SKIPPED = {"newcolumntype": "{[[{", "newtheoremstyle": "{{{{{{{{{", "newtoks": "", "newcount": "", "newdimen": "", "newskip": "", "newmuskip": "", "newfam": "", "newboolean": "{", "newlength": "{", "setlength": "{{", "addtolength": "{{", "settoheight": "{{", "settodepth": "{{", "settowidth": "{{",
           "newcounter": "{[", "stepcounter": "{", "setcounter": "{{", "newsavebox": "{", "newbox": "", "forloop": "{{{{", "newbool": "{", "providebool": "{", "setbool": "{{", "booltrue": "{", "boolfalse": "{", "setboolean": "{{", "crefname": "{{{", "Crefname": "{{{", "DeclareMathSizes": "{{{{"}
#: Files that define and hold no prose, by ending: they are not preprocessed.
DEFINING = frozenset("pgf tikz sty cls def clo fd cfg ist".split())
