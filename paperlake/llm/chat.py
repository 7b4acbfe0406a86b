r"""Chat formatting with prefix-target expansion.

Every assistant turn becomes an example: all preceding turns as context, that reply alone trainable. Turns are written as

    <turn>### role: text</turn>\n

Inside role and text a backslash goes before each backslash, ``<turn>``, ``</turn>`` and ``###`` (in a role also before ``:``), so no control
string of a text can be taken for the template's own, and dropping those backslashes gives the text back.
Turns after the last reply can be in no example; a conversation that ends so (or has no reply) gets one more row without a target,
so that nothing of it is lost.

The examples of a conversation are made one at a time from its running text, so memory holds one conversation's text and one example.

Defined results: null role and text are empty; turns are ordered by turn (nulls first), then role, then text, repeated rows included;
a null conv_id is a conversation of its own; an empty table gives no example; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import only, parts

OPEN, MARK, CLOSE = "<turn>", "### ", "</turn>\n"
EXAMPLES = "conv_id long, example long, n_context long, formatted string, loss_start long, loss_end long"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"
TRAINABLE = "assistant"
#: The conversation that holds the template's own control strings.
HARD = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]
_CONTROL = re.compile(r"\\|(?=</?turn>)|(?=###)")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<turn>### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] else "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turn_text(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its text lies in it."""
    head = OPEN + MARK + escape(role).replace(":", "\\:") + ": "
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text; it must be one run of turns."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}: {formatted[at : at + 80]!r}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def expand(turns: Iterable[tuple[str, str]]) -> Iterator[tuple[int, int, str, int, int]]:
    """(target's place, turns of context, formatted, loss_start, loss_end) for each example of one conversation."""
    stream, length, open_turns, n = [], 0, False, -1
    for n, (role, text) in enumerate(turns):
        piece, start, end = turn_text(role, text)
        stream.append(piece)
        open_turns = role != TRAINABLE
        if not open_turns:
            stream = ["".join(stream)]
            yield n, n, stream[0], length + start, length + end
        length += len(piece)
    if open_turns:
        yield n + 1, n + 1, "".join(stream), length, length


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns], strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, weigh: int | None = None, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 100 + (len(r[weigh]) if weigh is not None else 0)
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _runs(rows: Iterator[tuple]) -> Iterator[tuple[int | None, list[tuple]]]:
    key, held = None, []
    for r in rows:
        if held and r[0] != key:
            yield key, held
            held = []
        key = r[0]
        held.append(r)
    if held:
        yield key, held


_EXAMPLE_ARROW = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("n_context", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
_DIGEST_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_examples", pa.int64())])


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example (place of its target turn), n_context, formatted, loss_start, loss_end (code points of formatted)."""
    rows = only(conversations, conv_id="long", turn="long", role="string", text="string").withColumns({c: F.coalesce(c, F.lit("")) for c in ("role", "text")})
    rows = rows.repartition(parts(rows), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def make(batches):
        found = ((key, *e) for key, run in _runs(_rows(batches)) for e in expand((r[2], r[3]) for r in run))
        return _batches(found, _EXAMPLE_ARROW, 3)

    return rows.mapInArrow(make, EXAMPLES)


def read_back(formatted: DataFrame) -> DataFrame:
    """One row a conversation, from examples() alone (its rows follow one another there, in order): DIGESTS."""

    def digest(batches):
        def one(key, turns_of, total, n, loss, chars):
            h, turns = hashlib.sha256(), read_turns(turns_of)
            for role, text in turns:
                h.update(f"{role}\n{text}\n".encode())
            return key, len(turns), h.hexdigest(), chars, loss.hexdigest(), total, n

        def found():
            key, last, total, n, loss, chars = None, None, 0, 0, hashlib.sha256(), 0
            for conv, _, _, text, start, end in _rows(batches):
                if last is not None and conv != key:
                    yield one(key, last, total, n, loss, chars)
                    total, n, loss, chars = 0, 0, hashlib.sha256(), 0
                said = unescape(text[start:end])
                loss.update(said.encode())
                key, last, total, n, chars = conv, text, total + len(text), n + 1, chars + len(said)
            if last is not None:
                yield one(key, last, total, n, loss, chars)

        return _batches(found(), _DIGEST_ARROW)

    return formatted.mapInArrow(digest, DIGESTS)


def with_hard_case(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    rows = only(conversations, conv_id="long", turn="long", role="string", text="string")
    return rows.unionByName(spark.createDataFrame([Row(*r) for r in HARD], rows.schema))


#: The lengths of the template's parts and of its escapes (a backslash, a turn mark, and each place where three signs begin) are counted, not written.
SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
m AS (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS n_turns,
  length(role) + length(text) + len(regexp_extract_all(role || chr(0) || text, '\\|</?turn>')) + len(regexp_extract_all(role, ':'))
    + length(array_to_string(regexp_extract_all(role || chr(0) || text, '#{3,}'), '')) - 2 * len(regexp_extract_all(role || chr(0) || text, '#{3,}')) + length('<turn>### : </turn>') + 1 AS written
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
p AS (SELECT *, sum(written) OVER (PARTITION BY conv_id ORDER BY n) AS upto FROM m)
SELECT conv_id, max(n_turns)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (coalesce(sum(upto) FILTER (role = 'assistant'), 0) + coalesce(sum(upto) FILTER (n = n_turns AND role <> 'assistant'), 0))::BIGINT AS formatted_chars,
  count(*) FILTER (role = 'assistant' OR n = n_turns) AS n_examples
FROM p GROUP BY conv_id
"""
