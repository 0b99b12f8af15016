"""Chat formatting: conversations of typed parts become marked text with a loss mask.

Every turn is written `<turn>role`, a line end, its body and `</turn>`, a line end. A visitor flattens
the body's parts in order: text as it is with control strings escaped, attachments as a placeholder
`<part kind=n>` with the reference and the expanded token count recorded beside. A backslash and the
`<` of a control string get a backslash in front inside texts, so reading back is exact.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read_table

OPEN, CLOSE = "<turn>", "</turn>\n"
_CONTROL = re.compile(r"\\|<(?=/?turn>|part )")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<turn>((?:[^\\\n]+|\\.)*)\n((?:[^\\<]+|\\.|<(?!/turn>))*)</turn>\n", re.S)
PART_TYPE = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Patch side in pixels, tokens a second, tokens a page.
PATCH, PER_SECOND, PER_PAGE = 28, 25, 256


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\\n")


class PartVisitor:
    """Flattens the parts of a conversation's turns; numbers attachments in order."""

    def __init__(self, text_tokens: Callable[[str], int] = lambda t: len(t.split())):
        self.text_tokens, self.attachments, self.tokens = text_tokens, [], 0

    def visit(self, turn, part: dict) -> str:
        kind = part.get("kind") or "text"
        return getattr(self, f"visit_{kind}", self.visit_other)(turn, part)

    def visit_text(self, turn, part) -> str:
        text = part.get("text") or ""
        self.tokens += self.text_tokens(text)
        return escape(text)

    def _attach(self, turn, kind: str, part: dict, tokens: int) -> str:
        self.tokens += tokens
        self.attachments.append({"turn": turn, "number": len(self.attachments), "kind": kind, "ref": part.get("ref"), "tokens": tokens})
        return f"<part {re.sub(r'[^a-z]', '', kind)}={len(self.attachments) - 1}>"

    def visit_image(self, turn, part) -> str:
        return self._attach(turn, "image", part, math.ceil((part.get("width") or 0) / PATCH) * math.ceil((part.get("height") or 0) / PATCH))

    def visit_audio(self, turn, part) -> str:
        return self._attach(turn, "audio", part, math.ceil((part.get("seconds") or 0) * PER_SECOND))

    def visit_document(self, turn, part) -> str:
        return self._attach(turn, "document", part, (part.get("pages") or 0) * PER_PAGE)

    def visit_other(self, turn, part) -> str:
        return self._attach(turn, part["kind"].lower(), part, 0)


class Conversation:
    """The output of one conversation, turn by turn."""

    def __init__(self, loss_roles: frozenset[str]):
        self.loss_roles, self.visitor, self.pieces, self.at, self.spans, self.turns = loss_roles, PartVisitor(), [], 0, [], 0

    def add(self, turn, role: str, parts: list[dict]) -> None:
        head, body = f"{OPEN}{escape_role(role)}\n", "".join(self.visitor.visit(turn, p) for p in parts)
        if role in self.loss_roles:
            self.spans.append((self.at + len(head), self.at + len(head) + len(body)))
        self.pieces += head, body, CLOSE
        self.at += len(head) + len(body) + len(CLOSE)
        self.turns += 1

    def row(self, conv) -> dict:
        return {
            "conv_id": conv, "n_turns": self.turns, "formatted": "".join(self.pieces), "loss_spans": [{"start": a, "end": b} for a, b in self.spans],
            "attachments": self.visitor.attachments, "n_tokens": self.visitor.tokens,
        }


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation; attachments stay as placeholders."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def format_conversations(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    parts_col: str | None = None,
    loss_roles: frozenset[str] = frozenset({"assistant"}),
) -> DataFrame:
    """One row a conversation: conv_id, n_turns, formatted, loss_spans, attachments, n_tokens.

    Turns are ordered by turn, role and text (ties and repeated rows all stay); nulls come first and
    are empty texts and roles. `parts_col` (array of PART_TYPE) replaces the text where it isn't null.
    Rows of the null conversation form one. `loss_spans` are code-point ranges of the bodies under
    `loss_roles`. No rows: no conversations. Rows are dealt out by conversation and streamed in order:
    a task holds the conversation it is writing, as that is one row of the result.
    """
    kind = rows.schema[conv_col].dataType.simpleString()
    parts = F.col(parts_col).cast(f"array<{PART_TYPE}>") if parts_col else F.lit(None).cast(f"array<{PART_TYPE}>")
    asked = rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"), parts.alias("parts"),
    )
    asked = asked.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    out = (
        f"conv_id {kind}, n_turns long, formatted string, loss_spans array<struct<start:long,end:long>>, "
        "attachments array<struct<turn:long,number:long,kind:string,ref:string,tokens:long>>, n_tokens long"
    )
    arrow = pa.schema([
        ("conv_id", _arrow_type(rows.schema[conv_col].dataType)), ("n_turns", pa.int64()), ("formatted", pa.string()),
        ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("attachments", pa.list_(pa.struct([("turn", pa.int64()), ("number", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))),
        ("n_tokens", pa.int64()),
    ])

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, conv, ready, held = None, None, [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if now is None or row["conv"] != conv:
                    if now is not None:
                        ready.append(now.row(conv))
                        held += now.at
                    now, conv = Conversation(loss_roles), row["conv"]
                    if len(ready) >= 1000 or held > 16_000_000:
                        yield pa.RecordBatch.from_pylist(ready, arrow)
                        ready, held = [], 0
                now.add(row["turn"], row["role"], row["parts"] if row["parts"] is not None else [{"kind": "text", "text": row["text"]}])
        if now is not None:
            ready.append(now.row(conv))
            yield pa.RecordBatch.from_pylist(ready, arrow)

    return asked.mapInArrow(formatted, out).withColumnRenamed("conv_id", conv_col)


def _arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader of the formatted rows finds in them, as digests."""

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns_hash, loss_chars, loss_hash, chars, n = [], [], [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns, loss = read_back(text), "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                n.append(len(turns))
                turns_hash.append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
                loss_chars.append(len(loss))
                loss_hash.append(hashlib.sha256(loss.encode()).hexdigest())
                chars.append(len(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(turns_hash, pa.string()), pa.array(loss_chars, pa.int64()), pa.array(loss_hash, pa.string()), pa.array(chars, pa.int64())],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(
        digested, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = r"\### Assistant: </turn> ok"
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text")
    )
    return digests(format_conversations(rows.unionByName(added)))


QUERIES = {"op9_chat_format": op9_chat_format}
ORACLES = {
    "op9_chat_format": r"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
               replace(replace(replace(replace(coalesce(text, ''), '\', '\\'), '</turn>', '\</turn>'), '<turn>', '\<turn>'), '<part ', '\<part ') AS body
        FROM (SELECT conv_id, turn, role, text FROM conversations
              UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
    )
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(length(role) + length(body) + 15) AS BIGINT) AS formatted_chars
    FROM turns GROUP BY conv_id"""
}
