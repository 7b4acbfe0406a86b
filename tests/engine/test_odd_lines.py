"""Lines that hold LaTeX's own signs, or white space that is no blank, are read back whole."""

import duckdb
import pytest
from pyspark.sql import types as T

from paperlake.operators.kernel import Parser
from paperlake.plans.synth import ODD
from paperlake.queries import ORACLE_SQL, QUERIES

SIGNS = [*ODD, "\\", "\\\\", "\\%", "%\\", "\\{", "}\\", "\\fi", "\\else", "\\begin{a}", "\\u00e9", "~~", "^^M", "\\\\%\\", "\x0c", "\r", "\t", "\xa0 \xa0", " \x0b \x0b", "\u2028\u2029", "\ufeff", "\u200b", "`", "''", "--", "[", "]", "$x$", "<", "\x00"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A document for each place of each sign: alone, at the begin, the end and in the middle of a line, with and without blanks, before letters that could lengthen a code point."""
    at = str(tmp_path_factory.mktemp("odd_lines"))
    places = ["{}", "{} tail", "{}tail", "{}2e", "head {}", "head{}", "head {} tail", "head{}cab", "head{} tail", "head {}tail", "first\n{}\nlast\n{} 7"]
    rows = list(enumerate(p.format(*[x] * p.count("{}")) for x in SIGNS for p in places))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    spark.createDataFrame([*rows, (-1, None), (-2, ""), (-3, " \n\t\n")], schema).coalesce(1).write.parquet(f"{at}/documents.parquet")
    return at


def test_typed_conditions_on_lines_with_odd_signs(spark, tables):
    got = {tuple(r) for r in QUERIES["typed_conditions"](spark, tables).collect()}
    with duckdb.connect() as sql:
        sql.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tables}/documents.parquet/*.parquet')")
        want = set(sql.execute(ORACLE_SQL["typed_conditions"]).fetchall())
    assert len(want) > 10 * len(SIGNS)
    assert sorted(want ^ got) == []


def test_a_blank_after_white_space_by_code_point_stays():
    assert [t["content"] for t in Parser().document(r"a\u00a0{} b\u2028{} \ifnum 1<2 c\u000b{}\else no\fi d \u005c{}e")] == ["a\xa0 b\u2028 c\x0b d \\e"]
