"""Native column expressions for the regular part of LaTeX text: they run in the JVM, without Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CITE = r"\\(?:citep|citet|cites|citealt|citealp|citeauthor|citenum|citeyearpar|citeyear|citefullauthor|cite)\*?\s*(?:\[[^\]]*\]\s*){0,2}\{([^{}]*+)\}"
REF = r"\\(?:autoref|eqref|pageref|cref|Cref|ref)\*?\s*\{([^{}]*+)\}"
LABEL = r"\\label\s*\{([^{}]*+)\}"
SECTION = r"\\((?:sub)*+section|part|chapter)(\*?)\s*(?:\[[^\]]*\]\s*)?\{((?:[^{}]|\{[^{}]*+\})*+)\}"
INCLUDE = r"\\(?:input|include)\s*\{([^{}]*+)\}"
PACKAGE = r"\\(?:usepackage|RequirePackage)\s*(?:\[[^\]]*\]\s*)?\{([^{}]*+)\}"
BIBITEM = r"\\bibitem\s*(?:\[[^\]]*\]\s*)?\{([^{}]*+)\}((?:(?!\\bibitem|\\end\s*\{thebibliography\})[\s\S])*+)"
URL = r"\\(?:url|path)\s*\{([^{}]*+)\}"
DOI = r"\\doi\s*\{([^{}]*+)\}"
GRAPHICS = r"\\includegraphics\s*(?:\[[^\]]*\]\s*)?\{([^{}]*+)\}"
FOOTNOTE = r"\\footnote(?:text)?\s*(?:\[[^\]]*\]\s*)?\{((?:[^{}]|\{[^{}]*+\})*+)\}"
BIB_FIELD = r"(\w+)\s*=\s*(?:\{((?:[^{}]|\{[^{}]*+\})*+)\}|\"([^\"]*+)\")"


#: Comments, trailing blanks, and the last line break: what to replace by what, in this order.
COMMENT_RULES = ((r"(?m)(?<!\\)((?:\\\\)*+)%.*$", "$1"), (r"(?m)[ \t]+$", ""), (r"\n$", ""))


def strip_comments(text: Column) -> Column:
    """Comments and trailing blanks go, line structure stays."""
    for pattern, put in COMMENT_RULES:
        text = F.regexp_replace(text, pattern, put)
    return text


def normalize_space(text: Column) -> Column:
    """Blank lines become one line break; single line breaks and runs of blanks one blank."""
    text = F.regexp_replace(F.regexp_replace(text, r"[^\S\n]+", " "), r" ?\n ?", "\n")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\n{2,}", "\u0001"), r"\n", " "), "\u0001", "\n")
    return F.regexp_replace(text, r"^[ \n]+|[ \n]+$", "")


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\\\\(?:\[[^\]]*\])?|\\newline(?![a-zA-Z])", " "), r"\s+", " "))


def quotes(text: Column) -> Column:
    """TeX double and single quotes as plain ones."""
    return F.regexp_replace(F.regexp_replace(text, r"``([\s\S]*?)''", '"$1"'), r"`([\s\S]*?)'", "'$1'")


def keys(found: Column) -> Column:
    """Comma-separated keys of each match, trimmed, in order."""
    return F.filter(F.transform(F.flatten(F.transform(found, lambda x: F.split(x, ","))), lambda k: F.trim(k)), lambda k: k != "")


def cite_keys(text: Column) -> Column:
    return keys(F.regexp_extract_all(text, F.lit(CITE), F.lit(1)))


def ref_keys(text: Column) -> Column:
    return keys(F.regexp_extract_all(text, F.lit(REF), F.lit(1)))


def labels(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(LABEL), F.lit(1)), lambda x: F.trim(x))


def includes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(INCLUDE), F.lit(1)), lambda x: F.trim(x))


def packages(text: Column) -> Column:
    return keys(F.regexp_extract_all(text, F.lit(PACKAGE), F.lit(1)))


def urls(text: Column) -> Column:
    return F.concat(F.regexp_extract_all(text, F.lit(URL), F.lit(1)), F.transform(F.regexp_extract_all(text, F.lit(DOI), F.lit(1)), lambda d: F.concat(F.lit("https://doi.org/"), d)))


def graphics(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(GRAPHICS), F.lit(1))


def footnotes(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(FOOTNOTE), F.lit(1))


def has_parameters(text: Column) -> Column:
    return text.rlike(r"(?<!\\)#\d")


def is_balanced(text: Column, opening: str = "{", closing: str = "}") -> Column:
    """Whether delimiters match, escaped ones left out: a fold over the delimiters."""
    found = F.regexp_extract_all(text, F.lit(r"\\[\s\S]|[" + "".join(f"\\{c}" for c in (opening, closing)) + "]"), F.lit(0))
    depth = F.aggregate(found, F.lit(0), lambda a, c: F.when(a < 0, a).otherwise(a + F.when(c == opening, 1).when(c == closing, -1).otherwise(0)))
    return depth == 0


def is_main_file(text: Column) -> Column:
    stripped = strip_comments(text)
    return stripped.contains("\\documentclass") | stripped.contains("\\begin{document}")


def preamble(text: Column) -> Column:
    """What stands between the class and the document; null without a class."""
    found = F.regexp_extract(strip_comments(text), r"\\documentclass\s*(?:\[[^\]]*\]\s*)?\{[^{}]*\}([\s\S]*?)(?:\\begin\{document\}|$(?![\s\S]))", 1)
    return F.when(strip_comments(text).contains("\\documentclass"), F.trim(found))


def roman(n: Column) -> Column:
    """Lower-case roman numeral of a positive integer below 4000."""
    ones, tens, hundreds = ("i", "v", "x"), ("x", "l", "c"), ("c", "d", "m")

    def digit(d, unit, five, ten):
        shapes = ["", unit, unit * 2, unit * 3, unit + five, five, five + unit, five + unit * 2, five + unit * 3, unit + ten]
        return F.element_at(F.array(*map(F.lit, shapes)), (d + 1).cast("int"))

    return F.concat(F.repeat(F.lit("m"), (n / 1000).cast("int")), digit(F.floor(n / 100) % 10, *hundreds), digit(F.floor(n / 10) % 10, *tens), digit(n % 10, *ones))


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, pos, level, numbered, title: a row for each sectioning command, in order."""
    every = [F.regexp_extract_all(F.col(text_col), F.lit(SECTION), F.lit(g)) for g in (1, 2, 3)]
    rows = docs.select(id_col, F.posexplode(F.arrays_zip(*[a.alias(n) for a, n in zip(every, ("cmd", "star", "title"), strict=True)])).alias("pos", "s"))
    level = F.when(F.col("s.cmd") == "part", 0).when(F.col("s.cmd") == "chapter", 1).otherwise(F.floor((F.length("s.cmd") - 7) / 3) + 1)
    return rows.select(id_col, F.col("pos").cast("long").alias("pos"), level.cast("long").alias("level"), (F.col("s.star") == "").alias("numbered"), F.col("s.title").alias("title"))


def bibitems(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, pos, cite_key, content: a row for each bibliography item."""
    every = [F.regexp_extract_all(F.col(text_col), F.lit(BIBITEM), F.lit(g)) for g in (1, 2)]
    rows = docs.select(id_col, F.posexplode(F.arrays_zip(*[a.alias(n) for a, n in zip(every, ("k", "c"), strict=True)])).alias("pos", "b"))
    return rows.select(id_col, F.col("pos").cast("long").alias("pos"), F.trim("b.k").alias("cite_key"), F.trim(F.regexp_replace(F.regexp_replace("b.c", r"\\newblock\s*", ""), r"\s+", " ")).alias("content"))
