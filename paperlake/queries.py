"""The engine's queries over the test tables, each with the same answer computed from the raw rows in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperlake.functions import columns
from paperlake.functions import symbols as SYMBOLS
from paperlake.operators.kernel import is_command
from paperlake.operators.tokens import parse_documents
from paperlake.plans import document, graph, structure
from paperlake.plans.synth import LINES_SQL, escape, lines, literal, table, tex, write
from paperlake.sources import bundles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def with_lines(sql: str) -> str:
    return f"WITH {LINES_SQL} {sql}"


# -- native text functions --------------------------------------------------------------------------------------


@query("SELECT doc_id, md5(string_agg(rtrim(regexp_replace(line, '([%&$#_{}])', '\\\\\\1', 'g')), chr(10) ORDER BY k)) AS digest FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, k) GROUP BY doc_id")
def strip_comments(spark, d):
    raw = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    made = write(raw, "doc_id", "i", tex(escape(F.col("line")), " % a note"))
    return made.select("doc_id", F.md5(columns.strip_comments(F.col("text"))).alias("digest"))


@query(with_lines("SELECT doc_id, md5(trim(string_agg(line || CASE WHEN i % 3 = 2 THEN chr(10) ELSE ' ' END, '' ORDER BY i), ' ' || chr(10))) AS digest FROM l WHERE line <> '' GROUP BY doc_id"))
def normalize_space(spark, d):
    made = write(lines(spark, d).filter("line <> ''"), "doc_id", "i", tex("  ", F.col("line"), F.when(F.col("i") % 3 == 2, "\n \n\n").otherwise("  \n")), "")
    return made.select("doc_id", F.md5(columns.normalize_space(F.col("text"))).alias("digest"))


@query(with_lines("SELECT doc_id, md5(string_agg(line, ' ' ORDER BY i)) AS digest FROM l WHERE line <> '' GROUP BY doc_id"))
def one_line(spark, d):
    made = write(lines(spark, d).filter("line <> ''"), "doc_id", "i", F.col("line"), r" \\[2pt] ")
    return made.select("doc_id", F.md5(columns.one_line(F.col("text"))).alias("digest"))


@query(with_lines("SELECT doc_id, md5(string_agg('\"' || line || '\" ''' || line || '''', ' ' ORDER BY i)) AS digest FROM l WHERE NOT contains(line, '''') GROUP BY doc_id"))
def quotes(spark, d):
    made = write(lines(spark, d).filter(~F.col("line").contains("'")), "doc_id", "i", tex("``", F.col("line"), "'' `", F.col("line"), "'"), " ")
    return made.select("doc_id", F.md5(columns.quotes(F.col("text"))).alias("digest"))


@query(with_lines("SELECT doc_id, count(*)::BIGINT AS n, sum(CASE WHEN i % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_balanced FROM l GROUP BY doc_id"))
def balance(spark, d):
    made = lines(spark, d).withColumn("tex", tex("{a {b} \\{ ", F.when(F.col("i") % 2 == 0, "}").otherwise("")))
    return made.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(columns.is_balanced(F.col("tex")).cast("long")).alias("n_balanced"))


@query("SELECT n, CASE n // 100 % 10 WHEN 1 THEN 'c' WHEN 2 THEN 'cc' WHEN 3 THEN 'ccc' WHEN 4 THEN 'cd' ELSE '' END || ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][(n // 10 % 10 + 1)::INT] || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][(n % 10 + 1)::INT] AS numeral FROM (SELECT DISTINCT p_partkey % 499 + 1 AS n FROM part)")
def roman_numerals(spark, d):
    return table(spark, d, "part").select((F.col("p_partkey") % 499 + 1).alias("n")).distinct().withColumn("numeral", columns.roman(F.col("n")))


# -- sections ---------------------------------------------------------------------------------------------------

_SECTIONS_SQL = ", s AS (SELECT doc_id, i AS pos, i % 3 + 1 AS level, i % 7 <> 0 AS numbered, line FROM l)"


def sectioned(spark, d, appendix: bool = False):
    head = tex(F.when(F.col("i") % 10 == 9, "\\appendix\n").otherwise("")) if appendix else F.lit("")
    star = F.when(F.col("i") % 7 == 0, "*").otherwise("")
    command = tex("\\", F.repeat(F.lit("sub"), (F.col("i") % 3).cast("int")), "section", star, "{T", F.col("i").cast("string"), "}\n")
    return write(lines(spark, d), "doc_id", "i", tex(head, command, escape(F.col("line"))))


@query(with_lines(_SECTIONS_SQL + """, a AS (SELECT *, sum((level = 1 AND numbered)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS n1 FROM s),
b AS (SELECT *, sum((level = 2 AND numbered)::INT) OVER (PARTITION BY doc_id, n1 ORDER BY pos) AS n2 FROM a), c AS (SELECT *, sum((level = 3 AND numbered)::INT) OVER (PARTITION BY doc_id, n1, n2 ORDER BY pos) AS n3 FROM b)
SELECT doc_id, pos::BIGINT AS pos, level::BIGINT AS level, 'T' || pos AS title, CASE WHEN numbered THEN n1 || CASE WHEN level > 1 THEN '.' || n2 ELSE '' END || CASE WHEN level > 2 THEN '.' || n3 ELSE '' END END AS numbering FROM c"""))
def section_numbering(spark, d):
    found = columns.sections(sectioned(spark, d))
    return structure.number_sections(found).select("doc_id", "pos", "level", "title", "numbering")


@query(with_lines(_SECTIONS_SQL + " SELECT doc_id, pos::BIGINT AS pos, (SELECT coalesce(max(p.pos), -1) FROM s p WHERE p.doc_id = s.doc_id AND p.pos < s.pos AND p.level < s.level)::BIGINT AS parent FROM s"))
def section_tree(spark, d):
    return structure.section_parents(columns.sections(sectioned(spark, d))).select("doc_id", "pos", F.coalesce("parent", F.lit(-1)).alias("parent"))


@query(with_lines(_SECTIONS_SQL + """, e AS (SELECT *, sum((pos % 10 = 9)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS epoch FROM s), a AS (SELECT *, sum((level = 1 AND numbered)::INT) OVER (PARTITION BY doc_id, epoch ORDER BY pos) AS n1 FROM e),
b AS (SELECT *, sum((level = 2 AND numbered)::INT) OVER (PARTITION BY doc_id, epoch, n1 ORDER BY pos) AS n2 FROM a), c AS (SELECT *, sum((level = 3 AND numbered)::INT) OVER (PARTITION BY doc_id, epoch, n1, n2 ORDER BY pos) AS n3 FROM b)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos))::BIGINT AS k, (CASE WHEN epoch > 0 THEN chr((64 + n1)::INT) ELSE n1::VARCHAR END) || CASE WHEN level > 1 THEN '.' || n2 ELSE '' END || CASE WHEN level > 2 THEN '.' || n3 ELSE '' END AS numbering FROM c WHERE numbered"""))
def appendix_numbering(spark, d):
    tokens = parse_documents(sectioned(spark, d, True), types=["section", "appendix"]).filter("type IN ('section', 'appendix')")
    rows = tokens.select("doc_id", F.col("token_id").alias("pos"), "level", F.coalesce("numbered", F.lit(False)).alias("numbered"), (F.col("type") == "appendix").alias("appendix"))
    found = structure.number_sections(rows).filter("numbered")
    return found.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")).cast("long").alias("k"), "numbering")


@query(with_lines("SELECT doc_id, i, CASE WHEN i % 3 = 0 THEN 'section' ELSE 'text' END AS kind, max(CASE WHEN i % 3 = 0 THEN i END) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS of FROM l WHERE line <> '' QUALIFY kind = 'text'"))
def enclosing_sections(spark, d):
    rows = lines(spark, d).filter("line <> ''")
    made = write(rows, "doc_id", "i", F.when(F.col("i") % 3 == 0, tex("\\section{S", F.col("i").cast("string"), "}")).otherwise(tex("\\url{", F.col("i").cast("string"), "}")))
    tokens = structure.enclosing_section(parse_documents(made))
    titles = tokens.filter("slot = 'title'").select("doc_id", F.col("parent_id").alias("section_id"), F.substring("text", 2, 9).cast("long").alias("of"))
    return tokens.filter("type = 'url'").join(titles, ["doc_id", "section_id"], "left").select("doc_id", F.col("text").cast("long").alias("i"), F.lit("text").alias("kind"), "of")


# -- math and theorems --------------------------------------------------------------------------------------------


@query(with_lines("SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i))::VARCHAR AS numbering, 'x_{' || i || '}' AS text FROM l WHERE i % 2 = 0"))
def equation_numbers(spark, d):
    piece = F.when(F.col("i") % 2 == 0, tex("\\begin{equation}\nx_{", F.col("i").cast("string"), "}\n\\end{equation}")).otherwise(tex("$y$ \\begin{equation*} z \\end{equation*} \\[ w \\]"))
    tokens = parse_documents(write(lines(spark, d), "doc_id", "i", piece), types=structure.BLOCKS)
    return structure.number_blocks(tokens, carry=("text",)).select("doc_id", "numbering", "text")


@query(with_lines(", s AS (SELECT *, sum((i % 4 = 0)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS n1 FROM l) SELECT doc_id, CASE WHEN i % 2 = 0 THEN 'lemma' ELSE 'theorem' END AS name, n1 || '.' || row_number() OVER (PARTITION BY doc_id, n1 ORDER BY i) AS numbering FROM s WHERE i % 4 <> 0 AND line <> ''"))
def theorem_numbers(spark, d):
    name = F.when(F.col("i") % 2 == 0, "lemma").otherwise("theorem")
    made = F.when(F.col("i") % 4 == 0, tex("\\section{S}")).when(F.col("line") == "", "").otherwise(tex("\\begin{", name, "}", escape(F.col("line")), "\\end{", name, "} \\begin{theorem*}x\\end{theorem*} \\begin{proof}p\\end{proof}"))
    return structure.number_blocks(parse_documents(write(lines(spark, d), "doc_id", "i", made), types=structure.BLOCKS)).select("doc_id", "name", "numbering")


@query(with_lines("SELECT doc_id, count(*)::BIGINT AS n FROM l WHERE i % 2 = 0 AND line <> '' GROUP BY doc_id"))
def theorem_proofs(spark, d):
    made = tex("\\begin{theorem}", escape(F.col("line")), "\\end{theorem}", F.when(F.col("i") % 2 == 0, "\n\\begin{proof}p\\end{proof}").otherwise(" between "))
    tokens = parse_documents(write(lines(spark, d).filter("line <> ''"), "doc_id", "i", made))
    return structure.theorem_proofs(tokens).groupBy("doc_id").agg(F.count("*").alias("n"))


# -- macros -------------------------------------------------------------------------------------------------------


def texts(made: DataFrame) -> DataFrame:
    """doc_id and the digest of all text, merged."""
    rows = structure.merge_text(parse_documents(made, columns=structure.MERGED))
    joined = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "text"))), lambda x: F.trim(x["text"])), " ").alias("t"))
    return joined.select("doc_id", F.md5("t").alias("digest"))


@query(with_lines("SELECT doc_id, md5(string_agg('x' || i || '-' || line || ' d-' || line, ' ' ORDER BY i)) AS digest FROM l WHERE line <> '' GROUP BY doc_id"))
def macro_expand(spark, d):
    made = write(lines(spark, d).filter("line <> ''"), "doc_id", "i", tex("\\w[x", F.col("i").cast("string"), "]{", escape(F.col("line")), "} \\w{", escape(F.col("line")), "}"), "\n", "\\newcommand{\\w}[2][d]{#1-#2}\n")
    return texts(made)


@query(with_lines("SELECT doc_id, md5(string_agg('(' || line || '|' || i || ')', ' ' ORDER BY i)) AS digest FROM l WHERE line <> '' GROUP BY doc_id"))
def macro_delimited(spark, d):
    made = write(lines(spark, d).filter("line <> ''"), "doc_id", "i", tex("\\pair<{", escape(F.col("line")), "}:", F.col("i").cast("string"), ">"), "\n", "\\def\\pair<#1:#2>{(#1|#2)}\n")
    return texts(made)


@query(with_lines("SELECT doc_id, md5(string_agg(line || ' old new', ' ' ORDER BY i)) AS digest FROM l WHERE line <> '' GROUP BY doc_id"))
def macro_let_snapshot(spark, d):
    made = write(lines(spark, d).filter("line <> ''"), "doc_id", "i", tex(escape(F.col("line")), " \\kept{} \\now"), "\n", "\\def\\now{old}\\let\\kept=\\now\\renewcommand{\\now}{new}\n")
    return texts(made)


@query(with_lines("SELECT doc_id, md5(string_agg(CASE WHEN i % 2 = 0 THEN line ELSE 'no' END, ' ' ORDER BY i)) AS digest FROM l WHERE line <> '' GROUP BY doc_id"))
def conditional_branches(spark, d):
    body = escape(F.col("line"))
    made = F.when(F.col("i") % 2 == 0, tex("\\ifdraft ", body, " \\ifx\\a\\b \\else x\\fi\\else no\\fi")).otherwise(tex("\\iffalse ", body, "\\else no\\fi"))
    return texts(write(lines(spark, d).filter("line <> ''"), "doc_id", "i", made, "\n", "\\newif\\ifdraft \\drafttrue\n"))


@query(with_lines("SELECT doc_id, md5(string_agg('<' || line || '>', ' ' ORDER BY i)) AS digest FROM l WHERE line <> '' GROUP BY doc_id"))
def user_environments(spark, d):
    made = write(lines(spark, d).filter("line <> ''"), "doc_id", "i", tex("\\begin{mark}{", escape(F.col("line")), "}\\end{mark}"), "\n", "\\newenvironment{mark}[1]{<#1}{>}\n")
    rows = structure.merge_text(parse_documents(made, types=["text"]))
    joined = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "text"))), lambda x: x["text"]), " ").alias("t"))
    return joined.select("doc_id", F.md5(F.regexp_replace("t", r"\s+>", ">")).alias("digest"))


@query(with_lines("SELECT doc_id, count(*)::BIGINT AS n FROM l GROUP BY doc_id"))
def math_macros(spark, d):
    made = write(lines(spark, d), "doc_id", "i", tex("$\\pow[5]{", F.col("i").cast("string"), "}$"), "\n", "\\newcommand{\\pow}[2][2]{#2^{#1}}\n")
    tokens = parse_documents(made, types=["equation"])
    return tokens.filter(F.col("text").rlike(r"^\d+\^\{5\}$")).groupBy("doc_id").agg(F.count("*").alias("n"))


# -- citations, references, bibliographies -----------------------------------------------------------------------------


def cited(spark, d):
    docs = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 50).alias("paper"))
    piece = tex("\\cite[p. 1]{d", F.col("doc_id").cast("string"), ", d", (F.col("doc_id") + 1).cast("string"), "} ")
    items = F.when(F.col("doc_id") % 2 == 0, tex("\\bibitem[L]{d", F.col("doc_id").cast("string"), "} Author, \\newblock Title ", F.col("doc_id").cast("string"), " "))
    body = write(docs, "paper", "doc_id", piece, "\n").withColumnRenamed("text", "body")
    bib = write(docs.filter("doc_id % 2 = 0"), "paper", "doc_id", items, "\n", "\\begin{thebibliography}{9}\n", "\\end{thebibliography}").withColumnRenamed("text", "bib")
    return body.join(bib, "paper", "left").select(F.col("paper").alias("doc_id"), F.concat("body", F.coalesce("bib", F.lit(""))).alias("text"))


_CITED = "WITH c AS (SELECT doc_id % 50 AS doc_id, 'd' || (doc_id + k) AS key FROM documents, generate_series(0, 1) AS g(k)), b AS (SELECT doc_id % 50 AS doc_id, 'd' || doc_id AS cite_key, doc_id AS n FROM documents WHERE doc_id % 2 = 0)"


@query(_CITED + " SELECT doc_id, key, count(*)::BIGINT AS n FROM c GROUP BY ALL")
def cite_extract(spark, d):
    return cited(spark, d).select("doc_id", F.explode(columns.cite_keys(F.col("text"))).alias("key")).groupBy("doc_id", "key").agg(F.count("*").alias("n"))


@query(_CITED + " SELECT c.doc_id, key, count(*)::BIGINT AS n, bool_or(b.cite_key IS NOT NULL) AS found FROM c LEFT JOIN b ON c.doc_id = b.doc_id AND c.key = b.cite_key GROUP BY ALL")
def cite_resolution(spark, d):
    tokens = parse_documents(cited(spark, d), types=["citation", "bibitem"])
    return graph.citations_in_place(tokens).groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.bool_or("found").alias("found"))


@query(_CITED + " SELECT doc_id, count(*)::BIGINT AS n FROM c WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = c.doc_id AND b.cite_key = c.key) GROUP BY doc_id")
def cite_unresolved(spark, d):
    made = cited(spark, d)
    edges = made.select("doc_id", F.explode(columns.cite_keys(F.col("text"))).alias("key"))
    return graph.unresolved_citations(edges, columns.bibitems(made)).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(_CITED + " SELECT doc_id, cite_key, 'Author, Title ' || n AS content FROM b")
def bibitems(spark, d):
    return columns.bibitems(cited(spark, d)).select("doc_id", "cite_key", "content")


@query(_CITED + " SELECT key, count(*)::BIGINT AS n FROM c GROUP BY key ORDER BY n DESC, key LIMIT 10")
def top_cited(spark, d):
    edges = cited(spark, d).select(F.explode(columns.cite_keys(F.col("text"))).alias("key"))
    return edges.groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(10)


@query(with_lines("SELECT doc_id, 's:' || (i // 2) AS key, 'section' AS target_type, count(*)::BIGINT AS n FROM l WHERE i // 2 * 2 IN (SELECT 1) OR true GROUP BY ALL"))
def ref_labels(spark, d):
    j = F.floor(F.col("i") / 2).cast("string")
    made = tex(F.when(F.col("i") % 2 == 0, tex("\\section{A} \\label{s:", j, "} ")).otherwise(""), "\\ref{s:", j, "}")
    tokens = parse_documents(write(lines(spark, d), "doc_id", "i", made), types=["ref", "section"])
    return graph.references_in_place(tokens).groupBy("doc_id", "key", "target_type").agg(F.count("*").alias("n"))


def entries(spark, d):
    """Parts as a bibliography in 20 files of one document each; every key occurs twice."""
    parts = table(spark, d, "part").withColumn("k", F.floor(F.col("p_partkey") / 2)).withColumn("doc_id", F.col("k") % 20)
    entry = tex("@Book{p", F.col("k").cast("string"), ",\n title = {", F.col("p_name"), "}, note = \"", F.col("p_brand"), "\",\n number={", F.col("p_size").cast("string"), "}}\n")
    made = write(parts, "doc_id", "p_partkey", entry, "")
    files = made.select("doc_id", F.lit("\\bibliography{refs}").alias("text"), F.create_map(F.lit("refs.bib"), F.col("text")).alias("files"))
    return graph.bib_entries(parse_documents(files, files_col="files", types=["bibitem"]))


_PARTS = "WITH f AS (SELECT p_partkey // 2 AS k, p_name, p_brand, p_size, row_number() OVER (PARTITION BY p_partkey // 2 ORDER BY p_partkey) AS n FROM part)"


@query(_PARTS + " SELECT k % 20 AS doc_id, 'p' || k AS cite_key, p_name AS title, p_brand AS note, p_size::VARCHAR AS number FROM f WHERE n = 1")
def bibtex_fields(spark, d):
    return entries(spark, d).select("doc_id", "cite_key", *[F.col("fields")[f].alias(f) for f in ("title", "note", "number")])


@query(_PARTS + " SELECT 'p' || k AS cite_key, md5('@book{p' || k || ',' || chr(10) || chr(9) || 'title={' || p_name || '},' || chr(10) || chr(9) || 'note={' || p_brand || '},' || chr(10) || chr(9) || 'number={' || p_size || '}' || chr(10) || '}') AS digest FROM f WHERE n = 1")
def bib_canonical(spark, d):
    return entries(spark, d).select("cite_key", F.md5("text").alias("digest"))


# -- tables, lists, styles ------------------------------------------------------------------------------------------


@query("WITH n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS row FROM nation) SELECT n_regionkey::BIGINT AS doc_id, row::BIGINT AS row, c::BIGINT AS col, CASE c WHEN 0 THEN n_nationkey::VARCHAR WHEN 1 THEN n_name ELSE NULL END AS text FROM n, generate_series(0, 2) AS g(c)")
def table_cells(spark, d):
    rows = table(spark, d, "nation").withColumn("doc_id", F.col("n_regionkey").cast("long"))
    made = write(rows, "doc_id", "n_nationkey", tex(F.col("n_nationkey").cast("string"), " & ", F.col("n_name"), " & "), " \\\\ \\hline\n", "\\begin{tabular}[t]{|c|c|c|}\\hline ", "\\end{tabular}")
    cells = parse_documents(made).filter("slot = 'cell'")
    return cells.select("doc_id", "row", "col", "text")


@query("SELECT p_partkey % 40 AS doc_id, (2 * count(*))::BIGINT AS colspans, sum(p_size % 3 + 1)::BIGINT AS rowspans FROM part GROUP BY 1")
def table_spans(spark, d):
    rows = table(spark, d, "part").withColumn("doc_id", F.col("p_partkey") % 40)
    piece = tex("\\multicolumn{2}{|c|}{", F.col("p_name"), "} & \\multirow{", (F.col("p_size") % 3 + 1).cast("string"), "}{*}{", F.col("p_brand"), "} ")
    made = write(rows, "doc_id", "p_partkey", piece, "\\\\\n", "\\begin{tabular}{ccc}", "\\end{tabular}")
    cells = parse_documents(made).filter("slot = 'cell'")
    return cells.groupBy("doc_id").agg(F.sum(F.when(F.col("col") == 0, F.col("colspan"))).alias("colspans"), F.sum(F.when(F.col("col") == 1, F.col("rowspan"))).alias("rowspans"))


@query("SELECT o_custkey AS doc_id, count(DISTINCT o_orderkey)::BIGINT AS outer_items, count(*)::BIGINT AS inner_items, count(DISTINCT o_orderkey)::BIGINT AS lists_2 FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def list_depth(spark, d):
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    rows = table(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("doc_id", F.col("o_custkey"))
    piece = tex("\\item order \\begin{enumerate}", F.repeat(F.lit("\\item[a] line "), F.col("n").cast("int")), "\\end{enumerate}")
    tokens = parse_documents(write(rows, "doc_id", "o_orderkey", piece, "\n", "\\begin{itemize}", "\\end{itemize}"), types=["list", "item"], columns=["token_id", "type", "last_desc"])
    found = structure.list_depths(tokens, types=("list", "item"))
    item, of = F.col("type") == "item", F.col("depth")
    return found.groupBy("doc_id").agg(F.count_if(item & (of == 1)).alias("outer_items"), F.count_if(item & (of == 2)).alias("inner_items"), F.count_if(~item & (of == 2)).alias("lists_2"))


@query(with_lines("SELECT doc_id, md5(string_agg(line || '/' || CASE WHEN i % 2 = 0 THEN 'bold' ELSE 'italic,bold' END, ' ' ORDER BY i)) AS digest FROM l WHERE line <> '' GROUP BY doc_id"))
def style_runs(spark, d):
    body = escape(F.col("line"))
    made = F.when(F.col("i") % 2 == 0, tex("\\textbf{", body, "}")).otherwise(tex("\\textit{\\textbf{", body, "}}"))
    merged = structure.merge_text(parse_documents(write(lines(spark, d).filter("line <> ''"), "doc_id", "i", tex(made, "\\url{x}")), types=["text", "url"], columns=structure.MERGED)).filter("text <> 'x'")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("first", F.concat(F.trim("text"), F.lit("/"), F.array_join("styles", ",")).alias("p")))), lambda x: x["p"])
    return merged.groupBy("doc_id").agg(F.md5(F.array_join(parts, " ")).alias("digest"))


@query(with_lines("SELECT doc_id, md5(string_agg(line, ' ' ORDER BY i)) AS digest FROM l WHERE line <> '' GROUP BY doc_id"))
def text_merge(spark, d):
    return texts(write(lines(spark, d).filter("line <> ''"), "doc_id", "i", F.when(F.col("i") % 2 == 0, escape(F.col("line"))).otherwise(tex("{", escape(F.col("line")), "} \\centering % no"))))


# -- content commands -----------------------------------------------------------------------------------------------


@query("SELECT doc_id, text FROM (SELECT doc_id, 'http://' || source || '/' || doc_id AS text FROM documents UNION ALL SELECT doc_id, 'https://doi.org/10.1/' || doc_id FROM documents)")
def urls_doi(spark, d):
    docs = table(spark, d, "documents").select("doc_id", tex("\\url{http://", F.col("source"), "/", F.col("doc_id").cast("string"), "} and \\doi{10.1/", F.col("doc_id").cast("string"), "}").alias("text"))
    return docs.select("doc_id", F.explode(columns.urls(F.col("text"))).alias("text"))


@query("SELECT doc_id, 'f' || doc_id || '.pdf' AS text, doc_id % 9 + 1 AS page, '1-3' AS pages FROM documents")
def graphics(spark, d):
    k = F.col("doc_id").cast("string")
    docs = table(spark, d, "documents").select("doc_id", tex("\\includegraphics[width=2cm,page=", (F.col("doc_id") % 9 + 1).cast("string"), "]{f", k, ".pdf} \\includepdf[pages={1-3}]{g.pdf}").alias("text"))
    tokens = parse_documents(docs, types=["includegraphics", "includepdf"])
    return tokens.groupBy("doc_id").agg(F.max(F.when(F.col("type") == "includegraphics", F.col("text"))).alias("text"), F.max("page").alias("page"), F.max("pages").alias("pages"))


@query(with_lines("SELECT doc_id, count(*)::BIGINT AS notes, sum(length(line))::BIGINT AS chars FROM l WHERE line <> '' GROUP BY doc_id"))
def footnotes(spark, d):
    made = write(lines(spark, d).filter("line <> ''"), "doc_id", "i", tex("word\\footnote{", escape(F.col("line")), "} "), "")
    tokens = parse_documents(made)
    inside = tokens.filter("type = 'footnote'").select("doc_id", F.col("token_id").alias("parent_id")).join(tokens.select("doc_id", "parent_id", "text"), ["doc_id", "parent_id"])
    return inside.groupBy("doc_id").agg(F.count("*").alias("notes"), F.sum(F.length("text")).alias("chars"))


@query("SELECT o_orderkey AS doc_id, 'C' || o_custkey AS first, o_orderpriority AS second FROM orders")
def authors(spark, d):
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), tex("\\author{C", F.col("o_custkey").cast("string"), " \\and ", F.col("o_orderpriority"), "}").alias("text"))
    rows = parse_documents(docs).filter("slot = 'author'")
    return rows.groupBy("doc_id").agg(F.max(F.when(F.col("slot_key") == "0", F.col("text"))).alias("first"), F.max(F.when(F.col("slot_key") == "1", F.col("text"))).alias("second"))


@query(with_lines("SELECT doc_id, count(*)::BIGINT AS n, md5(string_agg(replace(line, '%', ''), chr(10) ORDER BY i)) AS digest FROM l WHERE line NOT IN ('', '%') GROUP BY doc_id"))
def code_blocks(spark, d):
    line = F.regexp_replace("line", "%", "")
    piece = F.when(F.col("i") % 2 == 0, tex("\\begin{verbatim}\n", line, "\n\\end{verbatim}")).otherwise(tex("\\begin{lstlisting}[language=x]\n", line, "\n\\end{lstlisting}"))
    tokens = parse_documents(write(lines(spark, d).filter("line NOT IN ('', '%')"), "doc_id", "i", piece), types=["code"])
    parts = F.transform(F.array_sort(F.collect_list(F.struct("token_id", "text"))), lambda x: x["text"])
    return tokens.groupBy("doc_id").agg(F.count("*").alias("n"), F.md5(F.array_join(parts, "\n")).alias("digest"))


@query("SELECT p_partkey AS doc_id, ((p_size * 1000 + p_partkey % 1000)::DECIMAL(18, 3) / 1000)::DECIMAL(18, 3)::DECIMAL(18, 2)::VARCHAR AS text FROM part")
def rounded_numbers(spark, d):
    value = ((F.col("p_size") * 1000 + F.col("p_partkey") % 1000).cast("decimal(18,0)") / 1000).cast("decimal(18,3)").cast("string")
    docs = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), tex("\\num[round-precision=2]{", value, "}").alias("text"))
    return parse_documents(docs, types=["text"]).select("doc_id", "text")


@query("SELECT i AS doc_id, nfc_normalize(chr(97 + (i % 26)::INT) || chr([769, 768, 776, 770, 771][(i // 26 % 5 + 1)::INT])) AS text FROM (SELECT DISTINCT p_partkey % 130 AS i FROM part)")
def accents(spark, d):
    names = F.array(*map(F.lit, ["'", "`", '"', "^", "~"]))
    letter = F.element_at(F.array(*[F.lit(chr(97 + k)) for k in range(26)]), (F.col("i") % 26 + 1).cast("int"))
    rows = table(spark, d, "part").select((F.col("p_partkey") % 130).alias("i")).distinct()
    docs = rows.select(F.col("i").alias("doc_id"), tex("\\", F.element_at(names, (F.floor(F.col("i") / 26) % 5 + 1).cast("int")), "{", letter, "}").alias("text"))
    return parse_documents(docs, types=["text"]).select("doc_id", "text")


@query("SELECT 'alpha' AS symbol, 'α' AS text UNION ALL SELECT 'Omega', 'Ω' UNION ALL SELECT 'infty', '∞' UNION ALL SELECT 'S', '§' UNION ALL SELECT 'mathbb', 'ℝ'")
def symbols(spark, d):
    rows = spark.createDataFrame([("alpha", r"\alpha"), ("Omega", r"\Omega{}"), ("infty", r"\infty"), ("S", r"\S"), ("mathbb", r"\mathbb{R}")], "symbol string, text string")
    return parse_documents(rows, "symbol", types=["text"]).select("symbol", "text")


# -- counts over all tokens ----------------------------------------------------------------------------------------


def mixed(spark, d):
    """A section, an equation, a citation, a list item and an unknown command for each line of a kind."""
    kinds = ["\\section{A}", "\\begin{equation}x\\end{equation}", "\\cite{k}", "\\begin{itemize}\\item a\\end{itemize}", "\\unknownA ", "\\unknownB{x} "]
    piece = F.element_at(F.array(*map(F.lit, kinds)), (F.col("i") % 6 + 1).cast("int"))
    return parse_documents(write(lines(spark, d), "doc_id", "i", piece))


@query(with_lines("SELECT ['section', 'equation', 'citation', 'item', 'command', 'command'][(i % 6 + 1)::INT] AS type, count(*)::BIGINT AS n FROM l GROUP BY 1"))
def token_histogram(spark, d):
    return graph.type_histogram(mixed(spark, d)).filter("type IN ('section', 'equation', 'citation', 'item', 'command')")


@query(with_lines("SELECT chr(92) || CASE WHEN i % 6 = 4 THEN 'unknownA' ELSE 'unknownB' END AS command, count(*)::BIGINT AS n FROM l WHERE i % 6 >= 4 GROUP BY 1"))
def unknown_commands(spark, d):
    return graph.unknown_commands(mixed(spark, d))


@query(with_lines(", k AS (SELECT doc_id % 10 AS shelf, ['section', 'equation', 'citation', 'item'][(i % 6 + 1)::INT] AS type FROM l WHERE i % 6 < 4) SELECT coalesce(shelf, -1)::BIGINT AS shelf, coalesce(type, 'all') AS type, count(*)::BIGINT AS n FROM k GROUP BY ROLLUP (k.shelf, k.type)"))
def type_rollup(spark, d):
    rows = mixed(spark, d).filter("type IN ('section', 'equation', 'citation', 'item')").withColumn("shelf", F.col("doc_id") % 10)
    return rows.rollup("shelf", "type").agg(F.count("*").alias("n")).select(F.coalesce("shelf", F.lit(-1)).alias("shelf"), F.coalesce("type", F.lit("all")).alias("type"), "n")


@query(with_lines("SELECT quality::BIGINT AS quality, count(*)::BIGINT AS sections FROM l JOIN labels USING (doc_id) WHERE i % 6 = 0 GROUP BY 1"))
def quality_join(spark, d):
    marks = table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"))
    return mixed(spark, d).filter("type = 'section'").join(marks, "doc_id").groupBy("quality").agg(F.count("*").alias("sections"))


@query(with_lines("SELECT doc_id, count(*)::BIGINT AS top_sections FROM l WHERE i % 3 = 0 GROUP BY doc_id"))
def document_json(spark, d):
    made = document.documents_json(sectioned(spark, d))
    found = made.select("doc_id", F.explode(F.from_json("json", "tokens array<struct<type:string,level:int>>").getField("tokens")).alias("t")).filter("t.type = 'section' AND t.level = 1")
    return found.groupBy("doc_id").agg(F.count("*").alias("top_sections"))


# -- files ------------------------------------------------------------------------------------------------------------


@query("SELECT conv_id AS paper_id, md5(string_agg(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def include_graph(spark, d):
    """Each conversation as a paper whose files include one another in turn."""
    rows = table(spark, d, "conversations")
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    body = tex(escape(F.col("text")), F.when(F.col("turn") < last, tex("\n\\input{t", (F.col("turn") + 1).cast("string"), "}\n")).otherwise(""))
    files = rows.select(F.col("conv_id").alias("paper_id"), F.when(F.col("turn") == 0, "main.tex").otherwise(tex("t", F.col("turn").cast("string"), ".tex")).alias("rel_path"), F.when(F.col("turn") == 0, tex("\\documentclass{x}\\begin{document}", body, "\\end{document}")).otherwise(body).alias("text"))
    papers = bundles.papers(files)
    tokens = parse_documents(papers, "paper_id", "text", preprocess=False, types=["text"], files_col="files").withColumnRenamed("paper_id", "doc_id")
    rows = structure.merge_text(tokens)
    joined = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "text"))), lambda x: F.trim(x["text"])), " ").alias("t"))
    return joined.select(F.col("doc_id").alias("paper_id"), F.md5(F.regexp_replace("t", r"\s+", " ")).alias("digest"))


@query("SELECT conv_id AS paper_id, 'main.tex' AS rel_path FROM conversations GROUP BY conv_id")
def main_files(spark, d):
    rows = table(spark, d, "conversations")
    files = rows.select(F.col("conv_id").alias("paper_id"), F.when(F.col("turn") == 0, "main.tex").otherwise(tex("a", F.col("turn").cast("string"), ".tex")).alias("rel_path"), F.when(F.col("turn") == 0, tex("\\begin{document}", F.col("text"))).otherwise(tex("% \\documentclass{x}\n", F.col("text"))).alias("text"))
    return bundles.main_files(files).select("paper_id", "rel_path")


# -- one command a line, read back as text ----------------------------------------------------------------------------


def read_back(name: str, piece: Callable[[F.Column, F.Column], F.Column], sql: str, before: str = "", quote: Callable[[F.Column], F.Column] = escape) -> None:
    """A query that writes a command around every line and must read the SQL expression's text."""

    def run(spark, d):
        made = write(lines(spark, d).filter("line <> ''"), "doc_id", "i", piece(quote(F.col("line")), F.col("i").cast("string")), "\n", before)
        return texts(made)

    run.__name__ = name
    query(with_lines(f"SELECT doc_id, md5(string_agg({sql}, ' ' ORDER BY i)) AS digest FROM l WHERE line <> '' GROUP BY doc_id"))(run)


read_back("boxes", lambda x, i: tex("\\fbox{", x, "} \\raisebox{1pt}[2pt]{r} \\hbox to 3in{", i, "}"), "line || ' r ' || i")
read_back("saved_boxes", lambda x, i: tex("\\sbox{\\bx}{", x, "}\\usebox{\\bx}"), "line", "\\newsavebox{\\bx}\n")
read_back("font_switches", lambda x, i: tex("{\\bf ", x, "} \\textsc{", i, "} {\\large b}"), "line || ' ' || i || ' b'")
read_back("colors", lambda x, i: tex("\\textcolor[HTML]{FF0000}{", x, "} {\\color{red}", i, "}"), "line || ' ' || i")
read_back("fractions", lambda x, i: tex("\\nicefrac{", x, "} {", i, "}"), "line || ' / ' || i")
read_back("pdf_strings", lambda x, i: tex("\\texorpdfstring{$x$}{", x, "}\\citetext{ ", i, "}"), "line || ' ' || i")
read_back("dropped_layout", lambda x, i: tex("\\noindent\\vskip 3pt plus 1pt\\hypersetup{a=b}\\addcontentsline{a}{b}{c}\\setlength{\\parskip}{1pt}\\pagestyle{p}", x, " \\protect\\cite{q}\\maketitle"), "line")
read_back("key_values", lambda x, i: tex("\\setkeys{f}{k={", x, "}, j=", i, "}"), "'<' || line || '>' || i", "\\makeatletter\\define@key{f}{k}{<#1>}\\define@key{f}{j}{#1}\\makeatother\n")
read_back("starred_macros", lambda x, i: tex("\\cmd ", x, " \\cmd*"), "'plain ' || line || ' star'", "\\makeatletter\\def\\cmd{\\@ifstar{star}{plain }}\\makeatother\n")
read_back("edef_snapshot", lambda x, i: tex("\\b{} ", x), "'1 ' || line", "\\def\\a{1}\\edef\\b{\\a}\\def\\a{2}\n")
read_back("groups", lambda x, i: tex("{a {", x, "} \\begingroup b\\endgroup}"), "'a ' || line || ' b'")
read_back("layout_environments", lambda x, i: tex("\\begin{minipage}[t]{2cm}", x, "\\end{minipage}\\begin{quote}q\\end{quote}\\begin{unheard}[o]u\\end{unheard}"), "line || ' q u'")
read_back("loops_and_comments", lambda x, i: tex("\\foreach \\k in {1,2}{no}\\forloop{a}{b}{c}{d}\\begin{comment}", x, "\\end{comment}", x), "line")
read_back("unicode_escapes", lambda x, i: tex(x, " \\u00e9\\alpha{}"), "line || ' éα'")
read_back("line_breaks", lambda x, i: tex("\\mbox{", x, "}\\\\[2pt] next"), "line || chr(10) || 'next'")
read_back("typed_conditions", lambda x, i: tex("\\ifnum 1<2 ", x, "\\else no\\fi \\ifthenelse{c}{", i, "}{no} \\@ifundefined{z}{t}{no}"), "line || ' ' || i || ' t'", quote=literal)


# layout that goes
read_back("layout_contents", lambda x, i: tex("\\tableofcontents\\startcontents[a]\\contentspage\\printcontents[a]{b}{c}{d}\\addtocontents{toc}{\\x}\\titlecontents{a}{b}{c}{d}{e}{f}", x, "\\listoftables\\phantomsection"), "line")
read_back("layout_pages", lambda x, i: tex("\\enlargethispage{2cm}\\pagecolor{red}\\samepage\\allowdisplaybreaks\\clearpage\\flushtop\\filbreak\\goodbreak\\raggedright ", x, "\\pagenumbering{roman}\\balance"), "line")
read_back("layout_skips", lambda x, i: tex("\\bigskip\\medskip\\lastskip\\vskip 3pt plus 1pt minus 2pt\\abovedisplayshortskip 4pt \\penalty-100 \\clubpenalty=10000 \\interfootnotelinepenalty=500 ", x), "line")
read_back("layout_styles", lambda x, i: tex("\\pagestyle{p}\\thispagestyle{q}\\theoremstyle{r}\\bibliographystyle{s}\\setcitestyle{t}\\renewpagestyle{u}{v}\\lstset{a=b}\\setlist[c]{d}\\captionsetup[e]{f=g}", x), "line")
read_back("layout_margins", lambda x, i: tex("\\topmargin=2cm \\oddsidemargin 1in \\footskip=1cm \\marginparwidth 2pt \\itemindent=1em \\vfuzz2pt \\hoffset=-1in \\parindent 0pt ", x), "line")
read_back("layout_line_skip", lambda x, i: tex("\\lineskip 2pt \\baselineskip=12pt ", x, " 1.5\\baselineskip{}"), "line")
read_back("layout_rules", lambda x, i: tex("\\hline\\toprule\\midrule\\cmidrule(lr){1-2}\\cline{1-2}\\specialrule{a}{b}{c}\\rule{1cm}{2cm}\\hrule\\morecmidrules\\Xhline{2pt}\\cdashline{1-2}\\addlinespace[2pt]", x, "\\hrulefill"), "line")
read_back("layout_options", lambda x, i: tex("\\ProcessOptions\\PassOptionsToPackage{a}{b}\\ExecuteBibliographyOptions{c}\\DeclareOption{d}{e}\\DeclareGraphicsExtensions{f}\\NeedsTeXFormat{g}[h]\\ProvidesPackage{i}[j]", x), "line")
read_back("layout_fonts", lambda x, i: tex("\\DeclareFontShape{a}{b}{c}{d}{e}{f}\\DeclareFontFamily{a}{b}{c}\\DeclareSymbolFont{a}{b}{c}{d}{e}\\SetMathAlphabet{a}{b}{c}{d}{e}{f}\\textfont\\a=\\b \\setmathfont{F}\\fontsize{1}{2}\\selectfont ", x), "line")
read_back("layout_counters", lambda x, i: tex("\\setcounter{a}{1}\\stepcounter{a}\\addtocounter{a}{2}\\numberwithin{a}{b}\\counterwithin{a}{b}\\refstepcounter{a}\\newcounter{b}[a]\\makeatletter\\@addtoreset{a}{b}\\c@page\\makeatother\\arabic{a}\\roman{a}\\value{a}", x), "line")
read_back("layout_setup", lambda x, i: tex("\\hypersetup{a=b}\\geometry{c}\\mathtoolset{d}\\tcbset{e}\\usetikzlibrary{f}\\pgfplotsset{g}\\graphicspath{{h/}}\\hyphenation{a-b}\\newmdenv[a]{b}\\linespread{1.2}", x), "line")
read_back("layout_registers", lambda x, i: tex("\\wd0 \\ht\\bx=2pt \\dp1 \\advance\\x by 2pt \\showthe\\unskip\\makeatletter\\Hy@raisedlink{q}\\@empty\\p@\\z@\\makeatother\\global\\relax ", x), "line")
read_back("layout_dates", lambda x, i: tex("\\date{2020}\\subjclass{c}\\pacs{d}\\typeout{e}\\pdfinfo{f}\\pdfoutput=1 \\setdefaultlanguage{g}\\tracinglostchars=0 ", x, "\\today"), "line")
read_back("layout_boxes_raised", lambda x, i: tex("\\raise 2pt\\hbox{", x, "} \\lower1ex\\hbox{", i, "}"), "line || ' ' || i")
read_back("phantoms", lambda x, i: tex(x, "\\hspace{1cm}", i, "\\kern 2pt b"), "line || ' ' || i || 'b'")
# macros
read_back("macro_renewal", lambda x, i: tex("\\renewcommand{\\v}{v", i, "}\\v{} \\out{", x, "}"), "'v' || i || ' [v' || i || ' ' || line || ']'", "\\newcommand{\\v}{a}\\newcommand{\\out}[1]{[\\v{} #1]}\n")
read_back("macro_provided", lambda x, i: tex("\\robust{", x, "} \\op "), "'<' || line || '>'", "\\providecommand{\\robust}[1]{<#1>}\\DeclareMathOperator{\\op}{op}\n")
read_back("macro_csname_use", lambda x, i: tex("\\csname greet\\endcsname{", x, "} \\csname g\\kind\\endcsname{", i, "}"), "'Hi ' || line || '! Hi ' || i || '!'", "\\newcommand{\\greet}[1]{Hi #1!}\\newcommand{\\kind}{reet}\n")
read_back("macro_named", lambda x, i: tex("\\nm{} ", x), "'N ' || line", "\\makeatletter\\@namedef{nm}{N}\\makeatother\n")
read_back("macro_nested_parameters", lambda x, i: tex("\\outer{", i, "}\\inner{", x, "}"), "i || '-' || line", "\\newcommand{\\outer}[1]{\\renewcommand{\\inner}[1]{#1-##1}}\\newcommand{\\inner}[1]{}\n")
read_back("macro_protected_names", lambda x, i: tex("\\textbf{", x, "} \\caption{c}"), "line || ' c'", "\\renewcommand{\\textbf}[1]{no}\\newcommand{\\caption}{no}\n")
read_back("macro_registers", lambda x, i: tex("\\ln=2pt \\tk{a}\\ct=3 ", x), "line", "\\newlength{\\ln}\\newtoks\\tk\\newcount\\ct\\setlength{\\ln}{1pt}\n")
read_back("macro_fonts", lambda x, i: tex("\\big ", x), "line", "\\font\\big=cmr10 at 12pt\n")
read_back("macro_theorem_titles", lambda x, i: tex("\\begin{claimx}[", i, "]", x, "\\end{claimx}"), "i || ' ' || line", "\\newtheorem{claimx}{Claim}\n")
read_back("macro_spaces", lambda x, i: tex("\\a ", x, "\\a{} ", i), "'A ' || line || 'A ' || i", "\\def\\a{A}\n")
read_back("macro_optional", lambda x, i: tex("\\m{", x, "} \\m[", i, "]{b}"), "'d:' || line || ' ' || i || ':b'", "\\newcommand{\\m}[2][d]{#1:#2}\n")
read_back("macro_missing_arguments", lambda x, i: tex("\\two{", x, "} / \\two"), "'(' || line || ',) / (,)'", "\\newcommand{\\two}[2]{(#1,#2)}\n")
# conditionals
read_back("if_else_or", lambda x, i: tex("\\iffalse no\\else ", x, "\\fi \\iftrue ", i, "\\else no\\fi"), "line || ' ' || i")
read_back("if_files", lambda x, i: tex("\\IfFileExists{f}{", x, "}{no} \\ifdim 1pt<2pt d\\else no\\fi"), "line || ' d'")
read_back("if_nested", lambda x, i: tex("\\ifdraft\\ifnum 1<2 ", x, "\\else no\\fi\\else\\ifx\\a\\b no\\fi no\\fi"), "line", "\\newif\\ifdraft\n")
read_back("if_bools", lambda x, i: tex("\\ifbool{b}{", x, "}{no} \\setbool{b}{true}", i), "line || ' ' || i", "\\newbool{b}\n")
# text
read_back("style_names", lambda x, i: tex("\\textsf{a} \\texttt{b} \\textsl{c} \\textup{d} \\textmd{e} \\underline{", x, "} \\uppercase{f} \\textsuperscript{g}"), "'a b c d e ' || line || ' f g'")
read_back("escapes", lambda x, i: tex("\\# \\$ \\% \\& \\_ \\{ \\} \\textbackslash{} ", x), "'# $ % & _ { } \\ ' || line")
read_back("spaces", lambda x, i: tex("a\\quad b\\,c\\;d~e\\ f\\thinspace g\\!h ", x), "'a b c d e f gh ' || line")
read_back("accents_in_words", lambda x, i: tex("Erd\\H{o}s G\\\"odel na\\\"{\\i}ve \\c{c}a \\v{s} \\r{a} ", x), "'Erdős Gödel naïve ça š å ' || line")
read_back("cyrillic_and_dings", lambda x, i: tex("\\CYRZH\\cyra{} \\textonehalf{} \\textsection{} ", x), "'Жа ½ § ' || line")
read_back("alphabets", lambda x, i: tex("\\mathbb{R} \\mathfrak{g} \\mathsfbf{A} \\mathbit{x} ", x), "'ℝ 𝔤 𝗔 𝒙 ' || line")
read_back("unknown_stay_readable", lambda x, i: tex("\\unheard{", x, "} ", i), "line || ' ' || i")
read_back("pair_environments", lambda x, i: tex("\\center ", x, "\\endcenter\\quote ", i, "\\endquote"), "line || ' ' || i")
read_back("one_column", lambda x, i: tex("\\twocolumn[", x, "]\\onecolumn ", i), "line || ' ' || i")
read_back("special_boxes", lambda x, i: tex("\\parbox[t]{2cm}{", x, "} \\makebox[1cm][l]{m} \\framebox[1cm]{f} \\colorbox{red}{c} \\fcolorbox{a}{b}{d} \\scalebox{2}[3]{s} \\rotatebox{90}{r} \\resizebox{1cm}{!}{z}"), "line || ' m f c d s r z'")
read_back("deferred_boxes", lambda x, i: tex("\\savebox{\\bx}[1cm][l]{", x, "}\\setbox1=\\hbox{", i, "}\\usebox{\\bx} \\box1 \\copy1"), "line || ' ' || i || ' ' || i", "\\newsavebox{\\bx}\n")
read_back("multicolumns", lambda x, i: tex("\\begin{multicols}{2}", x, "\\end{multicols}\\begin{spacing}{1.2}", i, "\\end{spacing}\\begin{adjustwidth}{a}{b}c\\end{adjustwidth}"), "line || ' ' || i || ' c'")


def tokens_back(name: str, piece: Callable[[F.Column, F.Column], F.Column], pick: Callable[[], F.Column], sql: str, types: list[str], before: str = "", **how) -> None:
    """Like read_back, for tokens of some types: what pick makes of each, in order."""

    def run(spark, d):
        made = write(lines(spark, d).filter("line <> ''"), "doc_id", "i", piece(escape(F.col("line")), F.col("i").cast("string")), "\n", before)
        found = parse_documents(made, types=types, **how).filter(F.col("type").isin(*types)).select("doc_id", "token_id", pick().alias("p"))
        return found.groupBy("doc_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("token_id", "p"))), lambda x: x["p"]), " ")).alias("digest"))

    run.__name__ = name
    query(with_lines(f"SELECT doc_id, md5(string_agg({sql}, ' ' ORDER BY i)) AS digest FROM l WHERE line <> '' GROUP BY doc_id"))(run)


def fields(*names: str) -> Callable[[], F.Column]:
    return lambda: F.concat_ws("|", *[F.array_join(n, ",") if n in ("keys", "labels", "styles") else F.col(n).cast("string") for n in names])


tokens_back("equation_forms", lambda x, i: tex("$a_{", i, "}$ \\(b\\) $$c$$ \\[d\\] \\begin{displaymath}e\\end{displaymath}\\begin{gather*}f\\end{gather*}\\begin{multline}g\\end{multline}"), fields("text", "display", "numbered"), "'a_{' || i || '} b c|block d|block e|block f|block g|block|true'", ["equation"])
tokens_back("equation_labels", lambda x, i: tex("\\begin{align}x &= y \\label{a", i, "}\\\\ z \\label{b}\\end{align}"), fields("labels", "align"), "'a' || i || ',b|true'", ["equation"])
tokens_back("equation_argument_braces", lambda x, i: tex("$\\n{", i, "} \\b{", i, "}$"), fields("text"), "'\\Vert{' || i || '}\\Vert x{' || i || '}y'", ["equation"], "\\newcommand{\\n}[1]{\\Vert#1\\Vert}\\newcommand{\\b}[1]{x#1y}\n")
tokens_back("equation_pairs", lambda x, i: tex("$$\\cases a_{", i, "} \\array b\\endarray\\endcases$$"), fields("text"), "'\\begin{cases} a_{' || i || '} \\begin{array} b\\end{array}\\end{cases}'", ["equation"])
tokens_back("equation_placeholders", lambda x, i: tex("$x \\eqref{e", i, "} \\cite{c}$"), fields("text"), "'x ___PLACEHOLDER_0___ ___PLACEHOLDER_1___'", ["equation"])
tokens_back("paired_delimiters", lambda x, i: tex("$\\norm*{", i, "}$"), fields("text"), "'|' || i || '|'", ["equation"], "\\DeclarePairedDelimiter{\\norm}{|}{|}\n")
tokens_back("math_alphabets", lambda x, i: tex("$\\mathbfx{", i, "}$"), fields("text"), "i::VARCHAR", ["equation"], "\\DeclareMathAlphabet{\\mathbfx}{OT1}{cmr}{b}{n}\n")
tokens_back("parts_and_chapters", lambda x, i: tex("\\part{P}\\chapter*{C}\\SECTION{", i, "}\\label{s", i, "}"), fields("level", "numbered", "labels"), "'0|true 1|false 1|true|s' || i", ["section"])
tokens_back("captions", lambda x, i: tex("\\begin{table}\\caption*{a}\\captionof{figure}{b}\\end{table}"), fields("type"), "'caption caption'", ["caption"])
tokens_back("graphics_options", lambda x, i: tex("\\includegraphics[width=1cm]{g", i, ".png}\\begin{overpic}[o]{h", i, "}\\end{overpic}"), fields("text"), "'g' || i || '.png h' || i", ["includegraphics"])
tokens_back("pdf_pages", lambda x, i: tex("\\includepdf[pages={1,", i, "}]{f.pdf}"), fields("text", "pages"), "'f.pdf|1,' || i", ["includepdf"])
tokens_back("reference_forms", lambda x, i: tex("\\ref{a", i, "}\\autoref{b}\\cref{c,d}\\eqref{e}\\pageref{f}\\hyperref[g]{t}"), fields("keys"), "'a' || i || ' b c,d e f g'", ["ref"])
tokens_back("citation_forms", lambda x, i: tex("\\citep[see][p. 2]{a", i, "}\\citet*{b}\\citeauthor{c}\\citeyear{d}\\citealp{e, f}"), fields("keys"), "'a' || i || ' b c d e,f'", ["citation"])
tokens_back("links", lambda x, i: tex("\\href{u", i, "}{t}\\url{v}\\doi{10.1/w}\\path{p}"), fields("text"), "'u' || i || ' v https://doi.org/10.1/w p'", ["url"])
tokens_back("verbatim_inline", lambda x, i: tex("\\verb|$\\a{| \\verb*+b", i, "+"), fields("text", "display"), "'$\\a{|inline b' || i || '|inline'", ["code"])
tokens_back("diagrams", lambda x, i: tex("\\begin{tikzpicture}\\draw (", i, ");\\end{tikzpicture}\\begin{picture}(1,2)\\end{picture}"), fields("name", "text"), "'tikzpicture|\\begin{tikzpicture}\\draw (' || i || ');\\end{tikzpicture} picture|\\begin{picture}(1,2)\\end{picture}'", ["diagram"])
tokens_back("algorithms", lambda x, i: tex("\\begin{algorithm}[h]\\caption{c}\\begin{algorithmic}[1]\\State s", i, "\\end{algorithmic}\\end{algorithm}"), fields("type", "numbered"), "'algorithm|true algorithmic'", ["algorithm", "algorithmic"])
tokens_back("theorem_names", lambda x, i: tex("\\begin{mythm}[T", i, "]a\\end{mythm}\\begin{proof}b\\end{proof}\\begin{lemma*}c\\end{lemma*}"), fields("name", "numbered"), "'lemma|true proof lemma'", ["math_env"], "\\newtheorem{mythm}{Lemma}\n")
tokens_back("list_kinds", lambda x, i: tex("\\begin{description}\\item[t", i, "] a\\end{description}\\begin{enumerate}\\item b\\end{enumerate}\\list{x}{y}\\item c\\endlist"), fields("name"), "'description enumerate list'", ["list"])
tokens_back("nested_figures", lambda x, i: tex("\\begin{figure*}\\begin{subfigure}[b]{2cm}\\includegraphics{a}\\end{subfigure}\\subfloat[c]{d}\\end{figure*}\\begin{wrapfigure}{r}{2cm}x\\end{wrapfigure}"), fields("type", "numbered"), "'figure|true subfigure figure|true'", ["figure", "subfigure"])
tokens_back("affiliations", lambda x, i: tex("\\affil[1]{A", i, "}\\email{b@c}\\address{D}\\keywords{k}"), fields("type"), "'affiliation email address keywords'", ["affiliation", "email", "address", "keywords"])
tokens_back("appendix_switch", lambda x, i: tex("\\appendix\\section{A", i, "}"), fields("type"), "'appendix section'", ["appendix", "section"])
tokens_back("unclosed_conditions", lambda x, i: tex("\\ifnever{", i, "}\\iftrue a\\fi"), fields("command"), "'\\ifnever'", ["command"])
tokens_back("quotations", lambda x, i: tex("\\begin{quotation}", x, "\\end{quotation}\\begin{quote}q\\end{quote}"), fields("type"), "'quote quote'", ["quote"])
tokens_back("bibliography_items", lambda x, i: tex("\\begin{thebibliography}{9}\\bibitem[L", i, "]{k", i, "} A, \\newblock B\\end{thebibliography}"), fields("cite_key", "label", "format"), "'k' || i || '|L' || i || '|bibitem'", ["bibitem"])
tokens_back("notes", lambda x, i: tex("a\\footnote{b", i, "}\\thanks{c}\\footnotemark[3]"), fields("type"), "'footnote footnote footnote'", ["footnote"])


def preprocessed(name: str, piece: Callable[[F.Column, F.Column], F.Column], sql: str, before: str = "") -> None:
    """A query that reads back text as a file is read: definitions first replaced in the text."""

    def run(spark, d):
        made = write(lines(spark, d).filter("line <> ''"), "doc_id", "i", piece(escape(F.col("line")), F.col("i").cast("string")), "\n", "junk\\documentclass{article}\n" + before)
        rows = structure.merge_text(parse_documents(made, preprocess=True, columns=structure.MERGED))
        joined = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "text"))), lambda x: F.trim(x["text"])), " ").alias("t"))
        return joined.select("doc_id", F.md5("t").alias("digest"))

    run.__name__ = name
    query(with_lines(f"SELECT doc_id, md5(string_agg({sql}, ' ' ORDER BY i)) AS digest FROM l WHERE line <> '' GROUP BY doc_id"))(run)


preprocessed("expand_definitions", lambda x, i: tex("\\bq ", x, "\\eq \\two{", i, "}"), "line || ' 2' || i", "\\def\\bq{\\begin{quote}}\\def\\eq{\\end{quote}}\\newcommand{\\two}[1]{2#1}\n")
preprocessed("expand_conditions", lambda x, i: tex("\\ifdraft ", x, "\\else no\\fi \\makeatletter\\@ifundefined{z}{no}{no}\\makeatother ", i), "line || ' ' || i", "\\newif\\ifdraft\n")
preprocessed("expand_additions", lambda x, i: tex("\\addto\\captions{\\renewcommand{\\nm}{N", i, "}}\\nm{} ", x), "'N' || i || ' ' || line", "\\newcommand{\\nm}{a}\n")


@query(with_lines("SELECT doc_id, count(*)::BIGINT AS n, sum(i)::BIGINT AS total FROM l WHERE line <> '' GROUP BY doc_id"))
def style_files(spark, d):
    """Definitions of a package that a paper brings along: in conditions, in groups, behind \\AtBeginDocument, and in a package of its own."""
    made = write(lines(spark, d).filter("line <> ''"), "doc_id", "i", tex("\\num{\\one{", F.col("i").cast("string"), "}}\\two\\three\\four"), "", "\\documentclass{own}\\usepackage{p}\n")
    style = "\\RequirePackage{q}{\\newcommand{\\one}[1]{#1}}\\newif\\ifx@y\\ifx@y\\newcommand{\\two}{A}\\else\\newcommand{\\three}{no}\\fi\\AtBeginDocument{\\newcommand{\\four}{B}}"
    files = F.create_map(F.lit("p.sty"), F.lit(style), F.lit("q.sty"), F.lit("\\usepackage{p}\\def\\five{C}"), F.lit("own.cls"), F.lit("\\LoadClass{article}\\IfFileExists{p.sty}{\\def\\three{D}}{}"))
    tokens = parse_documents(made.withColumn("files", files), preprocess=True, files_col="files", types=["text"], expand_styles=True)
    numbers = F.filter(F.split(F.regexp_replace("text", r"\D+", " "), " "), lambda x: x != "")
    return tokens.groupBy("doc_id").agg(F.sum(F.size(numbers)).cast("long").alias("n"), F.sum(F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))).alias("total"))


@query(with_lines("SELECT doc_id, count(*)::BIGINT AS n FROM l GROUP BY doc_id"))
def errors_kept(spark, d):
    """A document that breaks off gives the tokens read before it, and a row that says why."""
    from paperlake.operators.tokens import errors

    made = write(lines(spark, d), "doc_id", "i", tex("\\url{", F.col("i").cast("string"), "}"), "", "", "\\ifthenelse{a}\\url{never}")
    tokens = parse_documents(made, types=["url"])
    said = errors(tokens).filter("message LIKE '%three blocks%'").select("doc_id").distinct()
    return tokens.filter("type = 'url'").join(said, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT conv_id AS paper_id, (max(turn) + 1)::BIGINT AS files, max(turn)::BIGINT AS deepest FROM conversations GROUP BY conv_id")
def include_depth(spark, d):
    rows = table(spark, d, "conversations")
    files = rows.select(F.col("conv_id").alias("paper_id"), F.when(F.col("turn") == 0, "main.tex").otherwise(tex("t", F.col("turn").cast("string"), ".tex")).alias("rel_path"), F.when(F.col("turn") == 0, "\\documentclass{x}\\input{t1}\\input{main}").otherwise(tex("\\include{t", (F.col("turn") + 1).cast("string"), "}")).alias("text"))
    return bundles.reachable(files).groupBy("paper_id").agg(F.count("*").alias("files"), F.max("depth").alias("deepest"))


@query("SELECT conv_id AS paper_id, md5(text) AS digest FROM conversations WHERE turn = 0")
def single_files(spark, d):
    """Main files as single compressed files, and what is not a paper reported."""
    import gzip

    rows = table(spark, d, "conversations").filter("turn = 0")
    packed = rows.select(F.concat(F.lit("/c"), F.col("conv_id").cast("string"), F.lit(".gz")).alias("path"), F.udf(lambda t: gzip.compress(("\\documentclass{x}" + t).encode()), "binary")("text").alias("content"))
    files = bundles.decode(bundles.explode(packed).filter("error IS NULL"))
    return files.select(F.regexp_extract("paper_id", r"(\d+)", 1).cast("long").alias("paper_id"), F.md5(F.substring("text", 18, 1 << 30)).alias("digest"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def wide_encodings(spark, d):
    docs = table(spark, d, "documents")
    content = F.when(F.col("doc_id") % 3 == 0, F.encode("text", "UTF-16")).when(F.col("doc_id") % 3 == 1, F.encode(F.concat(F.lit("\ufeff"), "text"), "UTF-16LE")).otherwise(F.encode(F.concat(F.lit("\ufeff"), "text"), "UTF-8"))
    return bundles.decode(docs.select("doc_id", content.alias("content"))).select("doc_id", F.md5("text").alias("digest"))


@query("SELECT p_partkey AS doc_id, 'fig.' || p_size || '/figs.' AS body FROM part")
def reference_names(spark, d):
    from paperlake.operators import tokens

    docs = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), tex("\\crefname{figure}{fig.", F.col("p_size").cast("string"), "}{figs.}x").alias("text"))
    return tokens.definitions(docs).filter("kind = 'crefname'").select("doc_id", "body")


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT doc_id % 500 FROM documents INTERSECT SELECT DISTINCT p_partkey FROM part))::BIGINT AS resolved, (SELECT count(*) FROM (SELECT DISTINCT doc_id % 500 FROM documents EXCEPT SELECT DISTINCT p_partkey FROM part))::BIGINT AS missing, (SELECT count(*) FROM (SELECT DISTINCT doc_id % 500 FROM documents UNION SELECT DISTINCT p_partkey FROM part))::BIGINT AS known")
def key_sets(spark, d):
    """Keys that are cited and keys that have an entry, as sets."""
    cited = table(spark, d, "documents").select("doc_id", tex("\\cite{", (F.col("doc_id") % 500).cast("string"), "}").alias("text"))
    cites = graph.cite_edges(parse_documents(cited)).select("key").distinct()
    items = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), tex("\\begin{thebibliography}{1}\\bibitem{", F.col("p_partkey").cast("string"), "} x\\end{thebibliography}").alias("text"))
    entries = graph.bib_entries(parse_documents(items)).select(F.col("cite_key").alias("key")).distinct()
    counted = lambda df, name: df.agg(F.count("*").alias(name)).withColumn("k", F.lit(1))
    both = counted(cites.intersect(entries), "resolved").join(counted(cites.subtract(entries), "missing"), "k").join(counted(cites.union(entries).distinct(), "known"), "k")
    return both.drop("k")


@query(with_lines("SELECT doc_id, i // 3 AS k, string_agg('x' || i, ' ' ORDER BY i) AS body FROM l GROUP BY ALL"))
def json_round_trip(spark, d):
    """Documents written as JSON lines' text and read back by a schema: the texts below every top section."""
    piece = tex(F.when(F.col("i") % 3 == 0, "\\section{S}\n").otherwise(""), "x", F.col("i").cast("string"))
    made = document.documents_json(write(lines(spark, d), "doc_id", "i", piece))
    schema = "tokens array<struct<type:string,content:array<struct<type:string,content:string>>>>"
    found = made.select("doc_id", F.posexplode(F.from_json("json", schema).getField("tokens")).alias("k", "t")).filter("t.type = 'section'")
    return found.select("doc_id", F.col("k").cast("long").alias("k"), F.regexp_replace(F.array_join(F.transform("t.content", lambda c: c["content"]), " "), r"\s+", " ").alias("body"))


@query(with_lines("SELECT doc_id, count(*)::BIGINT AS n, sum(i)::BIGINT AS total FROM l GROUP BY doc_id"))
def streamed_tokens(spark, d):
    """Documents read as a stream, in micro-batches until all are read; their tokens are as those of a batch."""
    import uuid

    from paperlake.streaming import ingest

    docs = spark.readStream.schema(table(spark, d, "documents").schema).parquet(f"{d}/documents.parque[t]")
    words = F.array_join(F.transform(F.sequence(F.lit(0), F.size(F.split("text", "\n")) - 1), lambda k: F.concat(F.lit("\\url{"), k.cast("string"), F.lit("}"))), " ")
    tokens = ingest.stream_tokens(docs.select("doc_id", words.alias("text")), types=["url"])
    counted = tokens.filter("type = 'url'").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("text").cast("long")).alias("total"))
    name = f"streamed_{uuid.uuid4().hex}"
    counted.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def _symbols_sql() -> str:
    from html.entities import html5, name2codepoint

    kept = {k[:-1]: v for k, v in html5.items() if k.endswith(";") and k[:-1].isalpha() and len(k) > 6 and k[:-1] not in name2codepoint}
    kept = {k: v for k, v in kept.items() if k in SYMBOL_NAMES}
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in kept.items()) + ") AS t(symbol, text)"


#: Names of the symbol table whose characters are letters, signs or arrows by themselves: none that text treats as space, markup or a command of its own.
SYMBOL_NAMES = frozenset(k for k, v in SYMBOLS.entities().items() if len(k) > 5 and not v.isspace() and v.isprintable() and not v.isascii() and not is_command(k) and SYMBOLS.symbols()[k] == v)


@query(_symbols_sql())
def symbol_table(spark, d):
    """Every mathematical symbol that has a command, read by the kernel."""
    rows = spark.createDataFrame([(k, f"\\{k}{{}}") for k in sorted(SYMBOL_NAMES)], "symbol string, text string")
    return parse_documents(rows, "symbol", types=["text"]).select("symbol", "text")


# -- more structure ------------------------------------------------------------------------------------------------------


@query(with_lines("SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i))::VARCHAR AS numbering, 'f:' || i AS key, 'caption' AS owner FROM l WHERE line <> ''"))
def figure_labels(spark, d):
    """A label after a caption belongs to the caption; the figure has the number."""
    i = F.col("i").cast("string")
    made = write(lines(spark, d).filter("line <> ''"), "doc_id", "i", tex("\\begin{figure}[h]\\includegraphics{x}\\caption[s]{", escape(F.col("line")), "}\\label{f:", i, "}\\end{figure}"))
    tokens = parse_documents(made)
    owners = graph.labels(tokens).withColumnsRenamed({"token_id": "caption", "type": "owner"})
    parent = tokens.select("doc_id", F.col("token_id").alias("caption"), F.col("parent_id").alias("token_id"))
    return structure.number_blocks(tokens).join(owners.join(parent, ["doc_id", "caption"]), ["doc_id", "token_id"]).select("doc_id", "numbering", "key", "owner")


@query(with_lines("SELECT doc_id, i AS k, line AS title FROM l WHERE line <> ''"))
def citation_aliases(spark, d):
    i = F.col("i").cast("string")
    made = write(lines(spark, d).filter("line <> ''"), "doc_id", "i", tex("\\defcitealias{k", i, "}{", escape(F.col("line")), "}\\citetalias{k", i, "}"))
    tokens = parse_documents(made)
    titles = tokens.filter("slot = 'title'").select("doc_id", F.col("parent_id").alias("token_id"), F.col("text").alias("title"))
    return graph.cite_edges(tokens).join(titles, ["doc_id", "token_id"]).select("doc_id", F.substring("key", 2, 9).cast("long").alias("k"), "title")


@query(with_lines("SELECT doc_id, count(*)::BIGINT AS paragraphs, sum(i % 3 + 1)::BIGINT AS levels FROM l WHERE line <> '' GROUP BY doc_id"))
def paragraphs(spark, d):
    piece = tex("\\", F.repeat(F.lit("sub"), (F.col("i") % 3).cast("int")), "paragraph{", escape(F.col("line")), "} x")
    tokens = parse_documents(write(lines(spark, d).filter("line <> ''"), "doc_id", "i", piece), types=["paragraph"])
    return tokens.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.sum("level").alias("levels"))


@query("SELECT p_partkey % 20 AS doc_id, 'b' || p_partkey AS cite_key, p_name AS title, p_brand || ' and ' || p_type AS author FROM part")
def amsrefs_fields(spark, d):
    piece = tex("\\bib{b", F.col("p_partkey").cast("string"), "}{book}{title={", F.col("p_name"), "}, author={", F.col("p_brand"), "}, author={", F.col("p_type"), "}}")
    made = write(table(spark, d, "part").withColumn("doc_id", F.col("p_partkey") % 20), "doc_id", "p_partkey", piece, "\n", "\\begin{bibdiv}\n", "\\end{bibdiv}")
    files = made.select("doc_id", F.lit("\\bibliography{refs}").alias("text"), F.create_map(F.lit("refs.bbl"), F.col("text")).alias("files"))
    return graph.bib_entries(parse_documents(files, files_col="files", types=["bibitem"])).select("doc_id", "cite_key", *[F.col("fields")[f].alias(f) for f in ("title", "author")])


@query("SELECT 'c' || p_partkey AS cite_key, p_brand || ', J.' AS author, p_name AS journal FROM part")
def compiled_bibliography(spark, d):
    k = F.col("p_partkey").cast("string")
    piece = tex("\\entry{c", k, "}{article}{}\\name{author}{1}{}{{{hash=1}{family={", F.col("p_brand"), "},familyi={X},given={Jo},giveni={J\\bibinitperiod}}}}\\field{journaltitle}{", F.col("p_name"), "}\\endentry")
    made = write(table(spark, d, "part").withColumn("doc_id", F.col("p_partkey") % 20), "doc_id", "p_partkey", piece)
    files = made.select("doc_id", F.lit("\\bibliography{refs}").alias("text"), F.create_map(F.lit("refs.bbl"), F.col("text")).alias("files"))
    return graph.bib_entries(parse_documents(files, files_col="files", types=["bibitem"])).select("cite_key", *[F.col("fields")[f].alias(f) for f in ("author", "journal")])


@query("SELECT p_partkey AS doc_id, 'newcommand' AS kind, 'mac' AS name, (p_size % 3)::BIGINT AS n_args FROM part UNION ALL SELECT p_partkey, 'theorem', 'thm', 0 FROM part")
def definitions(spark, d):
    from paperlake.operators import tokens

    docs = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), tex("\\newcommand{\\mac}[", (F.col("p_size") % 3).cast("string"), "]{x}\\newtheorem{thm}{T}").alias("text"))
    return tokens.definitions(docs).select("doc_id", "kind", "name", "n_args")


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def encodings(spark, d):
    docs = table(spark, d, "documents")
    content = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode("text", "ISO-8859-1"))
    return bundles.decode(docs.select("doc_id", content.alias("content"))).select("doc_id", F.md5("text").alias("digest"))


@query("SELECT conv_id AS paper_id, turn, md5(text) AS digest FROM conversations")
def archives(spark, d):
    """Conversations zipped, a file a turn, and unpacked again."""
    import io
    import zipfile

    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "text")).alias("turns"))

    def zipped(turns) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for t in turns:
                z.writestr(f"t{t['turn']}.tex", t["text"])
        return out.getvalue()

    packed = rows.select(F.concat(F.lit("/c"), F.col("conv_id").cast("string"), F.lit(".zip")).alias("path"), F.udf(zipped, "binary")("turns").alias("content"))
    files = bundles.decode(bundles.explode(packed))
    number = lambda c: F.regexp_extract(c, r"(\d+)", 1).cast("long")
    return files.select(number("paper_id").alias("paper_id"), number("rel_path").alias("turn"), F.md5("text").alias("digest"))
