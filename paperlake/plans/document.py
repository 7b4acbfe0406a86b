"""Documents at the edge: the numbered tree of one document, as nested dicts, JSON or plain text."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlake.operators.catalogue import TOKEN_TYPES
from paperlake.operators.kernel import Parser, inline

_OPEN, _CLOSE = re.compile(r"[\s(\[{“‘]$"), re.compile(r"^[\s,.;:!?)\]}”’]")
#: Keys of a token that go into JSON (others are working columns).
_KEPT = ("type", "title", "content", "styles", "labels", "level", "numbering", "display", "align", "name", "page", "pages", "command", "format", "cite_key", "label", "fields", "depth", "placeholders", "proof")
_NAMED = ("environment", "math_env", "list", "diagram")


class Tree:
    """Merges text, numbers and nests the flat tokens of one document."""

    def __init__(self, merge_proofs: bool = False, math_as_text: bool = False):
        self.merge_proofs, self.math_as_text = merge_proofs, math_as_text
        self.parts = 0
        self.section: dict[int, int] = {}
        self.counts: dict[str, int] = {}
        self.theorem = 0
        self.appendix = False

    def build(self, tokens: list[dict]) -> list[dict]:
        if self.math_as_text:
            tokens = rendered(tokens)
        return self.nest(merged(tokens), 0, False)

    def number(self, t: dict) -> str | None:
        level = t["level"]
        if level == 1:
            self.theorem = 0
        if not t.get("numbered"):
            return None
        if level < 1:
            self.parts += 1
            return str(self.parts)
        self.section[level] = self.section.get(level, 0) + 1
        for deeper in [k for k in self.section if k > level]:
            self.section[deeper] = 0
        first = self.section.get(1, 0)
        return ".".join([chr(64 + first) if self.appendix else str(first), *[str(self.section.get(k, 0)) for k in range(2, level + 1)]])

    def nest(self, tokens: list[dict], lists: int, inside: bool) -> list[dict]:
        root: list[dict] = []
        top = root
        sections: list[dict] = []
        paragraphs: list[dict] = []
        for t in tokens:
            if t["type"] not in TOKEN_TYPES:
                continue
            t = dict(t)
            kind = t["type"]
            if kind == "appendix":
                self.appendix, self.section, sections, paragraphs = True, {}, [], []
                t["content"] = self.nest(t.get("content") or [], lists, inside)
                root.append(t)
                if not t["content"]:
                    top = t["content"]
                else:
                    self.appendix = False
                continue
            if kind in ("section", "paragraph"):
                if kind == "section" and (n := self.number(t)):
                    t["numbering"] = n
                t["content"] = []
                stack = sections if kind == "section" else paragraphs
                while stack and stack[-1]["level"] >= t["level"]:
                    stack.pop()
                if kind == "section":
                    paragraphs.clear()
                    parent = sections[-1]["content"] if sections else top
                else:
                    parent = sections[-1]["content"] if sections else paragraphs[-1]["content"] if paragraphs else top
                parent.append(t)
                stack.append(t)
                continue
            into = paragraphs[-1]["content"] if paragraphs else sections[-1]["content"] if sections else top
            if self.merge_proofs and kind == "math_env" and t["name"] == "proof" and into and into[-1]["type"] == "math_env" and into[-1]["name"] != "proof":
                into[-1]["proof"] = t | {"content": self.nest(t["content"], lists, True)}
                continue
            if t.get("numbered"):
                if kind == "math_env":
                    self.theorem += 1
                    t["numbering"] = f"{self.section.get(1, 0)}.{self.theorem}"
                else:
                    self.counts[kind] = self.counts.get(kind, 0) + 1
                    t["numbering"] = str(self.counts[kind])
            if kind == "list":
                t["depth"] = lists + 1
            content = t.get("content")
            if isinstance(content, list) and kind not in ("citation", "ref", "tabular", "author"):
                t["content"] = self.nest(content, lists + (kind == "list"), True)
            if kind == "bibliography":
                t["content"] = [c for c in t["content"] if c["type"] == "bibitem"]
                top.append(t)
                sections, paragraphs = [], []
                continue
            into.append(t)
        return root


def merged(tokens: list[dict]) -> list[dict]:
    """Neighbouring texts of equal styles joined, with a blank between inline neighbours where neither binds to the other."""
    out: list[dict] = []
    for t in tokens:
        t = dict(t)
        if isinstance(t.get("content"), list) and t["type"] not in ("citation", "ref", "tabular", "author"):
            t["content"] = merged(t["content"])
        last = out[-1] if out else None
        if t["type"] == "text" and last is not None and inline(last):
            before, text = last.get("content"), t["content"]
            bound = _CLOSE.match(text) or not text or (last["type"] == "text" and _OPEN.search(before))
            if last["type"] == "text" and last.get("styles") == t.get("styles"):
                out[-1] = last | {"content": before + ("" if bound else " ") + text}
                continue
        out.append(t)
    return out


def rendered(tokens: list[dict]) -> list[dict]:
    """Inline equations as text between math tags."""
    out = []
    for t in tokens:
        if t["type"] == "equation" and t.get("display") != "block":
            t = {"type": "text", "content": f"<math>{t['content']}</math>"}
        elif isinstance(t.get("content"), list) and t["type"] not in ("citation", "ref", "tabular", "author"):
            t = t | {"content": rendered(t["content"])}
        out.append(t)
    return out


def clean(t):
    """A token for JSON: only its public keys, nothing null but empty cells."""
    if isinstance(t, list):
        return [clean(x) for x in t]
    if not isinstance(t, dict) or "type" not in t:
        return {k: clean(v) for k, v in t.items()} if isinstance(t, dict) else t
    keep = {k: t[k] for k in _KEPT if t.get(k) is not None and not (k == "name" and t["type"] not in _NAMED)}
    return {k: clean(v) for k, v in keep.items()}


def to_tree(text: str, preprocess: bool = False, files: dict[str, str] | None = None, **options: bool) -> tuple[list[dict], dict]:
    """The numbered tree and the colour map. options: merge_proofs (a proof becomes part of the theorem before it), math_as_text."""
    parser = Parser(files)
    return clean(Tree(**options).build(parser.document(text, preprocess))), parser.colors


def to_json(text: str, preprocess: bool = False, files: dict[str, str] | None = None) -> str:
    try:
        tokens, colors = to_tree(text, preprocess, files)
    except (ValueError, RecursionError) as e:
        return json.dumps({"tokens": [], "color_map": {}, "error": str(e)}, ensure_ascii=False)
    return json.dumps({"tokens": tokens, "color_map": colors}, ensure_ascii=False)


def plain_text(tokens: list[dict]) -> str:
    """All text of a token list, in order, blank-joined."""
    out: list[str] = []

    def walk(x) -> None:
        if isinstance(x, str):
            out.append(x)
        elif isinstance(x, list):
            for y in x:
                walk(y)
        elif isinstance(x, dict):
            if x.get("type") in ("citation", "ref", "url", "includegraphics", "includepdf", "diagram"):
                walk(x.get("title"))
            else:
                walk(x.get("title"))
                walk(x.get("content"))

    walk(tokens)
    return re.sub(r"\s+", " ", " ".join(out)).strip()


def documents_json(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", preprocess: bool = False, files_col: str | None = None) -> DataFrame:
    """id, json: one numbered document tree a row, made in one Arrow pass where its text is: no shuffle, one document in memory at a time. A null text has no JSON."""
    chosen = documents.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), *([F.col(f"`{files_col}`")] if files_col else []))
    kind = documents.schema[id_col].dataType

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                text = b.column(1)[k].as_py()
                files = dict(b.column(2)[k].as_py() or {}) if files_col else None
                made = None if text is None else to_json(text, preprocess, files)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), pa.array([made], pa.string())], names=[id_col, "json"])

    return chosen.mapInArrow(make, T.StructType([T.StructField(id_col, kind), T.StructField("json", T.StringType())]))


def flattened(tokens: list[dict]) -> tuple[str, dict[str, dict]]:
    """A token list as one text, and what stands behind its marks: every token that isn't plain text is written as `|REF_n|`, numbered in order."""
    parts, held = [], {}
    for t in tokens:
        if t.get("type") == "text" and isinstance(t.get("content"), str) and not t.get("styles"):
            parts.append(t["content"])
        else:
            key = f"REF_{len(held)}"
            held[key] = t
            parts.append(f"`|{key}|`")
    return "".join(parts), held
