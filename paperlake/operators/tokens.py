"""The token table: a document's token tree as rows, made in one Arrow pass per document.

A row's token_id is its place in preorder, parent_id the row it lies in, slot the part of the parent (content, title, cell, author,
placeholder), slot_key the author's number or the placeholder's name, ord its place in the slot, last_desc the last id below it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .catalogue import TOKEN_TYPES
from .kernel import Parser

COLUMNS = [
    ("token_id", pa.int64()), ("parent_id", pa.int64()), ("slot", pa.string()), ("slot_key", pa.string()), ("ord", pa.int64()), ("depth", pa.int64()), ("type", pa.string()), ("name", pa.string()), ("command", pa.string()),
    ("text", pa.string()), ("display", pa.string()), ("align", pa.bool_()), ("level", pa.int64()), ("numbered", pa.bool_()), ("styles", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("keys", pa.list_(pa.string())),
    ("page", pa.int64()), ("pages", pa.string()), ("row", pa.int64()), ("col", pa.int64()), ("rowspan", pa.int64()), ("colspan", pa.int64()), ("format", pa.string()), ("cite_key", pa.string()), ("label", pa.string()),
    ("fields", pa.map_(pa.string(), pa.string())), ("column_spec", pa.string()), ("last_desc", pa.int64()),
]
NAMES = [n for n, _ in COLUMNS]
_SPARK = {pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean", pa.list_(pa.string()): "array<string>", pa.map_(pa.string(), pa.string()): "map<string,string>"}
TOKENS = ", ".join(f"`{n}` {_SPARK[t]}" for n, t in COLUMNS)
_PLAIN = ("name", "command", "display", "align", "level", "numbered", "styles", "labels", "page", "pages", "format", "cite_key", "label", "fields", "column_spec")


def flatten(tree: list[dict]) -> list[dict]:
    """Rows of a token tree, in preorder. Types outside the catalogue are left out."""
    rows: list[dict] = []

    def put(t: dict, parent: int | None, slot: str, place: int, depth: int, **own) -> None:
        row = dict.fromkeys(NAMES) | {k: t[k] for k in _PLAIN if k in t} | own
        row |= {"token_id": len(rows), "parent_id": parent, "slot": slot, "ord": place, "depth": depth, "type": t["type"]}
        me = row["token_id"]
        rows.append(row)
        title = t.get("title")
        if isinstance(title, str):
            below([{"type": "text", "content": title}], me, "title", depth + 1)
        elif title:
            below(title, me, "title", depth + 1)
        content = t.get("content")
        if t["type"] in ("citation", "ref"):
            row["keys"] = content
        elif t["type"] == "tabular":
            cells(content, me, depth + 1)
        elif t["type"] == "author":
            for k, person in enumerate(content):
                below(person, me, "author", depth + 1, slot_key=str(k))
        elif isinstance(content, str):
            row["text"] = content
        elif content:
            below(content, me, "content", depth + 1)
        for key, tokens in (t.get("placeholders") or {}).items():
            below(tokens, me, "placeholder", depth + 1, slot_key=key)
        row["last_desc"] = len(rows) - 1

    def below(tokens: list[dict], parent: int | None, slot: str, depth: int, **own) -> None:
        for k, t in enumerate(x for x in tokens if x["type"] in TOKEN_TYPES):
            put(t, parent, slot, k, depth, **own)

    def cells(found: list[list], parent: int, depth: int) -> None:
        for r, line in enumerate(found):
            for c, cell in enumerate(line):
                spans = {"rowspan": cell["rowspan"], "colspan": cell["colspan"]} if isinstance(cell, dict) else {"rowspan": 1, "colspan": 1}
                value = cell["content"] if isinstance(cell, dict) else cell
                if value is None or isinstance(value, str):
                    value = [{"type": "text", "content": value}]
                for k, t in enumerate(value):
                    put(t, parent, "cell", k, depth, row=r, col=c, **spans)

    below(tree, None, "content", 0)
    return rows


def parse_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", preprocess: bool = False, types: list[str] | None = None, files_col: str | None = None, expand_styles: bool = False, columns: list[str] | None = None) -> DataFrame:
    """TOKENS rows, led by the id, of every document; types keeps only rows of those types, columns only those columns (the rest never leaves the kernel). files_col: a map of further texts by path;
    expand_styles: whether definitions of style files among them keep their bodies.

    Documents are read one at a time and rows written in batches, so memory holds one document. A document that cannot be read to its end gives the rows
    read before and one of type error with the reason as its text; null and empty texts give no row.
    """
    id_type = documents.schema[id_col].dataType.simpleString()
    arrow_id = to_arrow_type(documents.schema[id_col].dataType)
    chosen_columns = [(n, t) for n, t in COLUMNS if columns is None or n in columns]
    schema = pa.schema([(id_col, arrow_id), *chosen_columns])
    wanted = set(types) | {"error"} if types else None
    chosen = documents.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), *([F.col(f"`{files_col}`")] if files_col else []))

    def batch(ids: list, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, arrow_id), *[pa.array([r[n] for r in rows], t) for n, t in chosen_columns]], schema=schema)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held = [], []
        for b in batches:
            for k in range(b.num_rows):
                doc, text = b.column(0)[k].as_py(), b.column(1)[k].as_py()
                rows = rows_of(text, preprocess, dict(b.column(2)[k].as_py() or {}) if files_col else None, expand_styles)
                if wanted is not None:
                    rows = [r for r in rows if r["type"] in wanted]
                ids += [doc] * len(rows)
                held += rows
                if len(held) >= 5000:
                    yield batch(ids, held)
                    ids, held = [], []
        if held:
            yield batch(ids, held)

    return chosen.mapInArrow(make, ", ".join([f"`{id_col}` {id_type}", *[f"`{n}` {_SPARK[t]}" for n, t in chosen_columns]]))


def rows_of(text: str | None, preprocess: bool = False, files: dict[str, str] | None = None, expand_styles: bool = False) -> list[dict]:
    if not text:
        return []
    parser = Parser(files, expand_styles)
    try:
        rows = flatten(parser.document(text, preprocess))
    except (ValueError, RecursionError) as e:
        parser.errors.append(("parse", str(e)))
        try:
            rows = flatten(parser.tokens)
        except RecursionError:
            rows = []
    for stage, message in parser.errors:
        n = len(rows)
        rows.append(dict.fromkeys(NAMES) | {"token_id": n, "slot": "error", "type": "error", "name": stage, "text": message, "depth": 0, "ord": 0, "last_desc": n})
    return rows


def errors(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, stage, message of everything that went wrong."""
    return tokens.filter("type = 'error'").select(id_col, F.col("name").alias("stage"), F.col("text").alias("message"))


def definitions(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, kind, name, n_args, defaults, body, math_only: the macros and environments in force at a document's end, and its colours."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p = Parser()
                try:
                    p.document(text or "")
                except (ValueError, RecursionError):
                    continue
                found = [(m.kind, m.name, m.n_args, m.defaults, m.body, m.math_only) for m in [*p.macros.values(), *p.environments.values()]]
                found += [("theorem", n, 0, [], t, False) for n, t in p.titles.items()] + [("color", n, 0, [], f"{c['format']}:{c['value']}", False) for n, c in p.colors.items()]
                found += [("crefname", n, 0, [], f"{one}/{many}", False) for n, (one, many) in p.reference_names.items()]
                for f in found:
                    for c, v in zip(out, (doc, *f), strict=True):
                        c.append(v)
            kinds = [b.schema.field(0).type, pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=[id_col, "kind", "name", "n_args", "defaults", "body", "math_only"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(id_col, text_col).mapInArrow(make, f"`{id_col}` {kind}, kind string, name string, n_args long, defaults array<string>, body string, math_only boolean")


def register_sql(spark) -> None:
    """SQL functions latex_strip_comments (native), latex_to_text, latex_to_json, and the table function latex_tokens for LATERAL use."""
    from pyspark.sql.functions import udf, udtf

    from paperlake.functions import columns
    from paperlake.plans import document

    body = "x"
    for pattern, put in columns.COMMENT_RULES:
        body = f"regexp_replace({body}, r'{pattern}', '{put}')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION latex_strip_comments(x STRING) RETURNS STRING RETURN {body}")
    spark.udf.register("latex_to_text", udf(lambda x: None if x is None else document.plain_text(Parser().document(x)), "string", useArrow=True))
    spark.udf.register("latex_to_json", udf(lambda x: None if x is None else document.to_json(x), "string", useArrow=True))
    short = T.StructType([T.StructField(n, {"long": T.LongType(), "string": T.StringType()}[_SPARK[t]]) for n, t in COLUMNS if _SPARK[t] in ("long", "string")])

    class LatexTokens:
        def eval(self, text: str):
            for row in rows_of(text):
                yield tuple(row[f.name] for f in short)

    spark.udtf.register("latex_tokens", udtf(LatexTokens, returnType=short))
