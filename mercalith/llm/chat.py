"""Chat formatting: layouts recognised by their field paths, turned into canonical turns, written
as marked-up text with a loss mask, and read back.

A layout's fingerprint is a hash of the sorted set of its field paths (`messages[].role`,
`prompt`, ...), restricted to the paths that some known layout uses, so further columns do not
matter.  The fingerprint selects a declarative mapping.  Tables are recognised by their schema once,
JSON records one by one.

The template writes a turn as

    ### role: text </turn>\\n

with role and text escaped: a backslash goes before every backslash, `#`, `<` and, in roles, `:`.
Marks therefore hold a `#` or `<` without a backslash and escaped text never does, so reading back
is exact whatever a text says.  One row is written for each turn, with the part of it that the loss
covers (the text of assistant turns, as code point offsets); a conversation is its rows in order,
and nothing ever holds more than one turn at a time.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercalith.llm.common import stored

LEARNED = "assistant"
TURN = "conv_id bigint, turn bigint, role string, text string"
PIECES = TURN.replace(", role string, text string", "") + ", formatted string, loss_start bigint, loss_end bigint"


@dataclass(frozen=True)
class Layout:
    """How to get turns from one layout: a list with its fields, or (role, field) in order."""

    name: str
    paths: frozenset[str]
    rows: str | None = None  # "table" if a row is a turn, else the field with the list of turns
    role: str = ""
    text: str = ""
    turns: tuple[tuple[str, str], ...] = ()


LAYOUTS = (
    Layout("turn rows", frozenset(("conv_id", "turn", "role", "text")), "table", "role", "text"),
    Layout("messages", frozenset(("messages[].role", "messages[].content")), "messages", "role", "content"),
    Layout("conversations", frozenset(("conversations[].from", "conversations[].value")), "conversations", "from", "value"),
    Layout("dialogue", frozenset(("dialogue[].speaker", "dialogue[].text")), "dialogue", "speaker", "text"),
    Layout(
        "instruction with input", frozenset(("instruction", "input", "output")),
        turns=(("user", "instruction"), ("user", "input"), ("assistant", "output")),
    ),
    Layout("instruction", frozenset(("instruction", "output")), turns=(("user", "instruction"), ("assistant", "output"))),
    Layout(
        "system prompt", frozenset(("system", "prompt", "response")),
        turns=(("system", "system"), ("user", "prompt"), ("assistant", "response")),
    ),
    Layout("prompt and response", frozenset(("prompt", "response")), turns=(("user", "prompt"), ("assistant", "response"))),
    Layout("prompt and completion", frozenset(("prompt", "completion")), turns=(("user", "prompt"), ("assistant", "completion"))),
    Layout("question", frozenset(("question", "answer")), turns=(("user", "question"), ("assistant", "answer"))),
)
# what other layouts call the three roles
ROLES = {"human": "user", "user": "user", "gpt": "assistant", "bot": "assistant", "assistant": "assistant", "model": "assistant", "system": "system"}
_USED = frozenset().union(*(x.paths for x in LAYOUTS))


def fingerprint(paths: frozenset[str] | set[str]) -> str:
    """Of the paths that known layouts use."""
    return hashlib.sha256("\n".join(sorted(_USED & paths)).encode()).hexdigest()


BY_FINGERPRINT = {fingerprint(x.paths): x for x in LAYOUTS}


def paths_of(value: object, at: str = "") -> set[str]:
    """The nested field paths of a JSON value or of a Spark type given as JSON."""
    if isinstance(value, dict):
        out: set[str] = set()
        for k, v in value.items():
            out |= paths_of(v, f"{at}.{k}" if at else str(k))
        return out
    if isinstance(value, list):
        found = set().union(*(paths_of(v, at + "[]") for v in value)) if value else set()
        return found or {at + "[]"}
    return {at}


def _schema_value(kind: dict | str) -> object:
    if isinstance(kind, dict) and kind.get("type") == "struct":
        return {f["name"]: _schema_value(f["type"]) for f in kind["fields"]}
    if isinstance(kind, dict) and kind.get("type") == "array":
        return [_schema_value(kind["elementType"])]
    return ""


def layout_of(paths: set[str]) -> Layout | None:
    """The layout with this fingerprint, or else the one that uses most of the paths given."""
    exact = BY_FINGERPRINT.get(fingerprint(paths))
    if exact:
        return exact
    # a text may be given as a list of parts
    whole = paths | {re.sub(r"\[\](\.\w+)?$", "", x) for x in paths}
    # an empty conversation has no fields below it
    whole |= {y for x in paths if x.endswith("[]") for z in LAYOUTS for y in z.paths if y.startswith(x + ".")}
    fitting = [x for x in LAYOUTS if x.paths <= whole]
    return max(fitting, key=lambda x: len(x.paths), default=None)


def table_turns(rows: DataFrame) -> DataFrame:
    """Canonical turns (conv_id, turn, role, text) of a table whose layout its schema tells.

    Layouts of one row per conversation need an id column `conv_id`.  NULL texts become empty,
    empty optional parts (an instruction without input) are no turn of their own.
    """
    layout = layout_of(paths_of(_schema_value(json.loads(rows.schema.json()))))
    if layout is None:
        raise ValueError(f"no known layout has the fields {rows.columns}")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    if layout.rows == "table":
        return rows.select(
            F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"),
            F.coalesce(F.col(layout.role).cast("string"), F.lit("")).alias("role"), text(F.col(layout.text)).alias("text"),
        )
    key = F.col("conv_id").cast("bigint").alias("conv_id")
    roles = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    if layout.rows:
        # a conversation without turns keeps its place by one turn without role and text
        item = rows.select(key, F.posexplode_outer(layout.rows).alias("turn", "m")).withColumn("turn", F.coalesce("turn", F.lit(0)))
        role = F.coalesce(F.col("m").getField(layout.role), F.lit(""))
        named = F.coalesce(F.element_at(roles, F.lower(role)), role)
        return item.select("conv_id", F.col("turn").cast("bigint"), named.alias("role"), text(F.col("m").getField(layout.text)).alias("text"))
    parts = F.array(*[F.struct(F.lit(r).alias("role"), text(F.col(f)).alias("text")) for r, f in layout.turns])
    used = F.filter(parts, lambda x, i: (x["text"] != "") | (x["role"] == LEARNED))
    item = rows.select(key, F.posexplode(used).alias("turn", "m"))
    return item.select("conv_id", F.col("turn").cast("bigint"), "m.role", "m.text")


def json_turns(records: DataFrame, column: str = "record") -> DataFrame:
    """Canonical turns of (conv_id, JSON text) records, each recognised by its own field paths.

    Records that are no JSON object or have no known layout give one turn of role `unknown` with
    the record as text, and so do items of a conversation that are no turn, at their place; a conversation without
    items is one turn without role and text.  Texts given as parts are joined, parts that are no text as
    JSON.  Nothing is lost silently.
    """

    def turns(record: str | None) -> list[tuple[str, str]]:
        try:
            value = json.loads(record or "")
        except ValueError:
            value = None
        layout = layout_of(paths_of(value)) if isinstance(value, dict) else None
        if layout is None or layout.rows == "table":
            return [("unknown", record or "")]
        if layout.rows:
            items = value[layout.rows]
            if not isinstance(items, list):
                return [("unknown", record or "")]
            return [_item_turn(x, layout) for x in items] or [("", "")]
        pairs = [(r, _as_text(value.get(f))) for r, f in layout.turns]
        return [(r, t) for r, t in pairs if t or r == LEARNED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (key, n, role, text)
                for key, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for n, (role, text) in enumerate(turns(record))
            ]
            columns = list(zip(*rows)) or [[], [], [], []]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv_id", "turn", "role", "text"]
            )

    return records.select(F.col("conv_id").cast("bigint"), F.col(column).cast("string")).mapInArrow(run, TURN)


def _item_turn(item: object, layout: Layout) -> tuple[str, str]:
    if not isinstance(item, dict) or not {layout.role, layout.text} & item.keys():
        return "unknown", _as_text(item)
    role = _as_text(item.get(layout.role))
    return ROLES.get(role.lower(), role), _as_text(item.get(layout.text))


def _as_text(value: object) -> str:
    if isinstance(value, list):
        return "".join(
            x if isinstance(x, str) else x["text"] if isinstance(x, dict) and isinstance(x.get("text"), str) else _as_text(x) for x in value
        )
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def formatted(turns: DataFrame) -> DataFrame:
    """One formatted piece for each turn, with the code points [loss_start, loss_end) of the loss."""
    escape = lambda c, chars: F.regexp_replace(c, f"([{chars}])", r"\\$1")
    head = F.concat(F.lit("### "), escape(F.coalesce("role", F.lit("")), r"\\\\#<:"), F.lit(": "))
    body = escape(F.coalesce("text", F.lit("")), r"\\\\#<")
    learned = F.col("role") == LEARNED
    return turns.withColumns({"_head": head, "_body": body}).select(
        "conv_id", "turn", F.concat("_head", "_body", F.lit(" </turn>\n")).alias("formatted"),
        F.when(learned, F.length("_head")).cast("bigint").alias("loss_start"),
        F.when(learned, F.length("_head") + F.length("_body")).cast("bigint").alias("loss_end"),
    )


_PIECE = re.compile(r"### ((?:[^\\#<:]|\\.)*): ((?:[^\\#<]|\\.)*) </turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def read_piece(piece: str) -> tuple[str, str]:
    """(role, text) of one formatted turn."""
    m = _PIECE.fullmatch(piece)
    if m is None:
        raise ValueError(f"not a formatted turn: {piece[:80]!r}")
    return _ESCAPED.sub(r"\1", m[1]), _ESCAPED.sub(r"\1", m[2])


DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def digests(pieces: DataFrame) -> DataFrame:
    """Read formatted pieces back: per conversation what its turns and its loss say.

    Conversations are hashed turn by turn from rows in order, so one of any length needs the memory
    of one turn.  Turns of the same number are ordered by their formatted text; rows with a NULL
    conv_id are one conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None

        def row(s: list) -> pa.RecordBatch:
            key, n, turns, loss_chars, loss, chars = s
            values = (key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = [x.split(" ")[0] for x in DIGEST.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

        ready: list[pa.RecordBatch] = []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end")]
            for key, piece, start, end in zip(*columns):
                if state is None or state[0] != key:
                    if state is not None:
                        ready.append(row(state))
                    state = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_piece(piece)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    said = _ESCAPED.sub(r"\1", piece[start:end])
                    state[3] += len(said)
                    state[4].update(said.encode())
                state[5] += len(piece)
            if ready:
                yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
                ready = []
        if state is not None:
            yield row(state)

    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return ordered.mapInArrow(run, DIGEST)


def format_and_read(turns: DataFrame) -> DataFrame:
    """Write formatted conversations to the shared folder and return what reading them back says."""
    return digests(stored(formatted(turns), "chat"))
