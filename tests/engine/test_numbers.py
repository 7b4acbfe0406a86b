"""Where a number ends: a whole number takes no unit, so words that begin like one stay."""

import duckdb
import pytest
from pyspark.sql import types as T

from paperlake.operators.kernel import Parser
from paperlake.queries import ORACLE_SQL, QUERIES

STARTS = ["in all", "in", "iné", "inter alia", "pt", "em que", "ems", "ex ante", "cm 3", "mmé", "bp", "pc", "dd", "cc", "sp", "mu", "fil", "fille", "true love", "true pt", "plus 3 a", "minus -2pt", "by 4", "4 a", "-5", "= 6", "< 7", ".5", ",5", "4pt", "0in"]


def read(text):
    return [t["content"] for t in Parser().document(text)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents whose lines begin with units and other words that a dimension could take; the last has all of them."""
    at = str(tmp_path_factory.mktemp("numbers"))
    rows = [(k, f"{x} one\nb\n{x}") for k, x in enumerate(STARTS)] + [(len(STARTS), "\n".join(STARTS))]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/documents.parquet")
    return at


def differing(spark, tables, name):
    got = {tuple(r) for r in QUERIES[name](spark, tables).collect()}
    with duckdb.connect() as sql:
        sql.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tables}/documents.parquet/*.parquet')")
        want = set(sql.execute(ORACLE_SQL[name]).fetchall())
    assert len(want) == len(STARTS) + 1
    return sorted(want ^ got)


def test_if_nested_on_lines_that_begin_with_a_unit(spark, tables):
    assert differing(spark, tables, "if_nested") == []


def test_nested_conditions_keep_the_first_word():
    assert read(r"\newif\ifdraft \ifdraft\ifnum 1<2 inland\else no\fi\fi") == ["inland"]
    assert read(r"\ifnum\x<20 pt\else no\fi \ifdim 1pt<2in deep\else no\fi") == ["pt deep"]


def test_typed_conditions_on_lines_that_begin_with_a_unit(spark, tables):
    assert differing(spark, tables, "typed_conditions") == []


def test_comparisons_end_after_one_number():
    assert read(r"\ifnum 1<2 true love\else no\fi") == ["true love"]
    assert read(r"\ifnum\x>-12 mm wide\else no\fi") == ["mm wide"]
    assert read(r"\ifnum 3=\y interior\else no\fi") == ["interior"]
    assert read("\\ifnum 1<2\ninner\\else no\\fi") == ["inner"]


def test_layout_dates_on_lines_that_begin_with_a_unit(spark, tables):
    assert differing(spark, tables, "layout_dates") == []


def test_whole_parameters_take_no_unit():
    assert read(r"a \pdfoutput=1 in b \tracinglostchars=0 inès c") == ["a in b inès c"]
    assert read(r"\pdfsuppresswarningpagegroup=1\textbf{x} plus 3") == ["x", " plus 3"]
    assert read(r"\tracinglostchars\z@ true \pdfoutput = -1  mm") == ["true mm"]


def test_layout_skips_on_lines_that_begin_with_a_unit(spark, tables):
    assert differing(spark, tables, "layout_skips") == []


def test_penalties_take_no_unit():
    assert read(r"a \penalty-100 in b \clubpenalty=10000 em c") == ["a in b em c"]
    assert read(r"\tolerance 500 plus 3 \widowpenalty\@M ex \interfootnotelinepenalty=500 minus 2") == ["plus 3 ex minus 2"]
    assert read(r"\penalty10000\emph{kept}") == ["kept"]


def test_macro_registers_on_lines_that_begin_with_a_unit(spark, tables):
    assert differing(spark, tables, "macro_registers") == []


def test_counts_take_no_unit_and_lengths_do():
    assert read(r"\newcount\ct \newlength{\ln} a \ct=3 in b \ln=2in c \ct -4 exès d") == ["a in b c exès d"]
    assert read(r"\newcount\ct \advance\ct by 1 in a \multiply\ct by 2 em b \advance\ct3 pt c \advance\x by 2pt d") == ["in a em b pt c d"]
    assert read(r"\advance\count0 by -1 mm a \divide\x 2 cm b \advance\tolerance by 5 sp c") == ["mm a cm b sp c"]
