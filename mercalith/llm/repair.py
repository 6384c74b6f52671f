"""Conversation structure repair: cheapest edits, and of these the least audit string.

A conversation's rows in order of turn are edited so that the initials of the roles read
`(s?(ua)+)?`.  Keep costs 0, Rerole to user or assistant 2, Delete 3, Insert of an empty user or
assistant row 2; a truncated row that stays adds 1, blank and duplicate rows have to go.  A node is a
place between rows with one of four states (nothing yet, after s, after u, after a), an arc an edit;
the letter of an arc is the edit's initial.

1. Rows are range-sorted by (conversation, turn, role, text), so that one conversation may lie in many
   tasks, and numbered.  A segment is the rows of a conversation in one block of SEGMENT numbers.
2. The cost DP of a segment gives its least costs from every state to every state.  These 4 x 4 tables
   are folded from the back, one small row for each segment, into the cost to go at each segment's end.
3. With these, a segment's nodes and optimal arcs (those that lie on a cheapest way to the end) are
   known.  Prefix doubling ranks them: first by the least letter that leaves a node, then by the least
   audit of 2, 4, 8 ... letters, from the rank of a node and the rank of the node where its least
   audit of half that length ends.  The arcs of one node have different letters, so that end is one
   node, its doubled pointer; a way that ends ranks before all that go on.  The doubled pointers
   then spell the least audit from each of the four states in which the segment may be entered.
4. A fold from the front tells in which state each segment is entered.  Its audit applied to its rows
   gives the repaired conversation.

Nothing but a fold row of about 1/SEGMENT of the rows, with a byte or a few for each row, meets in one
task per conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercalith.llm.common import stored

SEGMENT_BITS = 12
GROUP_CELLS = 40_000
LETTERS = np.frombuffer(b"DIKR", np.uint8)
ROLES = {2: "user", 3: "assistant"}  # the state that a row of this role leads to

_NEXT = np.array([2, 2, 3, 2])  # the state after a user or assistant row, whichever may follow
_FAR = 1 << 40
_END = np.array([0, 4, 2, 0])  # cost to go after the last row: what is missing is inserted


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of `conversations` with faults put in by crc32(conv_id:turn) % 20.

    NULLs read as one space, in the key of the checksum too; conv_id and turn themselves stay NULL.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    chance = F.crc32(F.concat_ws(":", text_of("conv_id"), text_of("turn"))) % 20
    text = (
        F.when(chance == 1, F.lit("")).when(chance == 2, F.regexp_replace(text_of("text"), "[.!?]", "")).otherwise(text_of("text"))
    )
    role = F.when(chance == 4, F.lit("user")).otherwise(text_of("role"))
    copies = F.when(chance == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), chance.alias("chance"), copies.alias("copies"))
        .filter("chance <> 0")
        .withColumn("copy", F.explode("copies"))
        .select("conv_id", "turn", "role", "text")
    )


def _numbered(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, digest, place), stored: `place` numbers all rows in their order.

    Rows that are equal in all of it are alike, so their order does not matter.
    """
    some = rows.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    ).withColumn("digest", F.unhex(F.sha2("text", 256)))
    keys = ["conv", "turn", "role", "digest"]
    return stored(
        some.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id()), "turns"
    )


def _coded(numbered: DataFrame) -> DataFrame:
    """(conv, turn, place, fault, code): the first fault of each row, and a letter that holds what the DP needs."""
    bare = F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))
    kind = F.when(bare == "", "blank").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")
    narrow = numbered.select("conv", "turn", "place", "role", "digest", kind.alias("kind"))
    first = (
        narrow.groupBy("conv", "role", "digest").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1")
    )
    told = narrow.alias("r").join(
        first.alias("f"),
        F.expr("r.conv <=> f.conv AND r.role = f.role AND r.digest = f.digest"),
        "left",
    )
    fault = F.when(F.col("kind") == "blank", "blank").when(F.col("place") > F.col("first"), "duplicate").otherwise(F.col("kind"))
    rows = told.select("r.conv", "turn", "place", F.substring("r.role", 1, 1).alias("initial"), fault.alias("fault"))
    number = (
        F.when(F.col("fault").isin("blank", "duplicate"), 1).when(F.col("fault") == "truncated", 2).otherwise(0)
        + F.when(F.col("initial") == "s", 4).when(F.col("initial") == "u", 8).when(F.col("initial") == "a", 12).otherwise(0)
    )
    return rows.select("conv", "turn", "place", "fault", F.char(number + 65).alias("code"))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code of each row, rows), as a table filled up to the longest."""
    lengths = np.array([len(t) for t in texts])
    flat = np.frombuffer("".join(texts).encode(), np.uint8).astype(np.int64) - 65
    table = np.zeros((len(texts), lengths.max()), dtype=np.int64)
    table[np.arange(table.shape[1]) < lengths[:, None]] = flat
    return table, lengths


def _row_arcs(code: np.ndarray):
    """For some rows: (must go, added cost if it stays, state after keeping it in each state or -1)."""
    gone, more, who = code % 4 == 1, (code % 4 == 2).astype(np.int64), code // 4
    keep = np.full((*code.shape, 4), -1)
    keep[..., 0] = np.where(who == 1, 1, np.where(who == 2, 2, -1))
    keep[..., 1] = keep[..., 3] = np.where(who == 2, 2, -1)
    keep[..., 2] = np.where(who == 3, 3, -1)
    keep[gone] = -1
    return gone, more, keep


def costs_to_go(table: np.ndarray, lengths: np.ndarray, end: np.ndarray) -> np.ndarray:
    """[segment, place, state]: the least cost from there on, given it (`end`) after the last row."""
    n, longest = table.shape
    out = np.zeros((n, longest + 1, 4), dtype=np.int64)
    for at in range(longest, -1, -1):
        if at < longest:
            after = out[:, at + 1]
            gone, more, keep = _row_arcs(table[:, at])
            rerole = np.where(gone, _FAR, 2 + more)[:, None] + after[:, _NEXT]
            stay = np.where(keep >= 0, more[:, None] + np.take_along_axis(after, np.maximum(keep, 0), 1), _FAR)
            now = np.minimum(np.minimum(3 + after, rerole), stay)
            u, a = now[:, 2].copy(), now[:, 3].copy()
            now[:, 2], now[:, 3] = np.minimum(u, 2 + a), np.minimum(a, 2 + u)
            now[:, 0] = np.minimum(now[:, 0], 2 + now[:, 2])
            now[:, 1] = np.minimum(now[:, 1], 2 + now[:, 2])
            out[:, at] = np.minimum(now, _FAR)
        last = lengths == at
        out[last, at] = end[last]
    return out


def _optimal_arcs(table: np.ndarray, lengths: np.ndarray, go: np.ndarray, last: np.ndarray):
    """(is an optimal arc, target node), both [node, letter]; a node is (segment * places + place) * 4 + state."""
    n, longest = table.shape
    places = longest + 1
    node = np.arange(n * places * 4).reshape(n, places, 4)
    ok = np.zeros((n, places, 4, 4), dtype=bool)
    target = np.repeat(node[..., None], 4, axis=3)
    inside = np.arange(longest) < lengths[:, None]
    gone, more, keep = _row_arcs(table)
    here, after = go[:, :-1], go[:, 1:]
    state = np.arange(4)

    def row_arc(letter: int, to: np.ndarray, cost: np.ndarray, allowed: np.ndarray) -> None:
        ok[:, :-1, :, letter] = allowed & inside[..., None] & (cost + np.take_along_axis(after, to, 2) == here)
        target[:, :-1, :, letter] = node[:, 1:, :1] + to

    shape = here.shape
    row_arc(0, np.broadcast_to(state, shape), np.full(shape, 3), np.ones(shape, dtype=bool))
    row_arc(2, np.maximum(keep, 0), np.broadcast_to(more[..., None], shape), keep >= 0)
    row_arc(3, np.broadcast_to(_NEXT, shape), np.broadcast_to(2 + more[..., None], shape), np.broadcast_to(~gone[..., None], shape))
    # inserts stand before a row, or after the last row of the conversation
    before = np.arange(places) < (lengths + last)[:, None]
    ok[..., 1] = before[..., None] & (2 + go[..., _NEXT] == go)
    target[..., 1] = node[..., :1] + _NEXT
    return ok.reshape(-1, 4), target.reshape(-1, 4)


def _dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1]


def least_audits(table: np.ndarray, lengths: np.ndarray, go: np.ndarray, last: np.ndarray) -> tuple[list[list[str]], np.ndarray]:
    """([segment][state]: the least audit from its start, [segment, state]: the state where it ends)."""
    ok, target = _optimal_arcs(table, lengths, go, last)
    n, places = len(table), table.shape[1] + 1
    nodes = np.arange(len(ok))
    ends = ~ok.any(axis=1)
    # audits of one letter: 0 for a way that has ended, letters in ASCII order
    arc = np.where(ok, np.arange(1, 5), 9).min(axis=1)
    letter = np.where(ends, 0, arc)
    pointer = np.where(ends, nodes, target[nodes, np.where(ends, 0, arc - 1)])
    rank = _dense(letter)
    start = (np.arange(n)[:, None] * places * 4 + np.arange(4)).ravel()
    path = start[:, None]
    while not ends[path[:, -1]].all():
        path = np.concatenate([path, pointer[path]], axis=1)
        # the rank of an audit of twice the length, and where it ends
        rank = _dense(rank * (int(rank.max()) + 1) + rank[pointer])
        # among optimal arcs of the same letter the rank of what follows decides
        pointer = pointer[pointer]
    spelled = np.concatenate([[0], LETTERS])[letter[path]].astype(np.uint8)
    audits = [bytes(x).rstrip(b"\0").decode() for x in spelled]
    return [audits[4 * i : 4 * i + 4] for i in range(n)], (path[:, -1] % 4).reshape(n, 4)


def _groups(texts: list[str]) -> Iterator[list[int]]:
    """Segments of about the same length, so many that their nodes fit into small arrays."""
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    group: list[int] = []
    for i in order:
        if group and ((len(group) + 1) * (len(texts[i]) + 1) > GROUP_CELLS or len(texts[i]) > 2 * len(texts[group[0]]) + 4):
            yield group
            group = []
        group.append(i)
    if group:
        yield group


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds `table`: the least cost from each state at a segment's start to each state at its end."""
    unit = np.where(np.eye(4, dtype=bool), 0, _FAR)
    for batch in batches:
        texts = batch.column("codes").to_pylist()
        found: list = [None] * len(texts)
        for group in _groups(texts):
            codes, lengths = _codes([texts[i] for i in group])
            go = costs_to_go(np.repeat(codes, 4, 0), np.repeat(lengths, 4), np.tile(unit, (len(group), 1)))[:, 0]
            for i, x in zip(group, go.reshape(len(group), 4, 4).transpose(0, 2, 1).reshape(len(group), 16).tolist()):
                found[i] = x
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(found, pa.list_(pa.int64()))], names=[*batch.schema.names, "table"]
        )


def _from_the_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, seg, codes, last, go) from segments in falling order: the cost to go at each one's end."""
    conv, go = object(), []
    for batch in batches:
        lasts, gos = [], []
        for c, table in zip(batch.column("conv").to_pylist(), batch.column("table").to_pylist()):
            lasts.append(c != conv)
            if c != conv:
                conv, go = c, _END.tolist()
            gos.append(go)
            go = [min(table[4 * s + t] + go[t] for t in range(4)) for s in range(4)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), batch.column("seg"), batch.column("codes"), pa.array(lasts, pa.bool_()), pa.array(gos, pa.list_(pa.int64()))],
            names=["conv", "seg", "codes", "last", "go"],
        )


_LEGAL = np.zeros((4, 4), dtype=bool)
_LEGAL[1, 2] = _LEGAL[2, 3] = _LEGAL[3, 2] = True


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, seg, cost, illegal, edge, audits, exits) of each segment, for entry in each state."""
    for batch in batches:
        texts = batch.column("codes").to_pylist()
        last = np.array(batch.column("last").to_pylist(), dtype=bool)
        end = np.array(batch.column("go").to_pylist(), dtype=np.int64).reshape(-1, 4)
        n = len(texts)
        cost, illegal, edge, audits, exits = [0] * n, [0] * n, [None] * n, [None] * n, [None] * n
        for group in _groups(texts):
            codes, lengths = _codes([texts[i] for i in group])
            go = costs_to_go(codes, lengths, end[group])
            found, out = least_audits(codes, lengths, go, last[group])
            who = codes // 4
            wrong = ~_LEGAL[who[:, :-1], who[:, 1:]] & (np.arange(1, codes.shape[1]) < lengths[:, None])
            for k, i in enumerate(group):
                cost[i], illegal[i] = int(go[k, 0, 0]), int(wrong[k].sum())
                edge[i] = [int(who[k, 0]), int(who[k, lengths[k] - 1])]
                audits[i], exits[i] = found[k], out[k].tolist()
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), batch.column("seg"), pa.array(cost, pa.int64()), pa.array(illegal, pa.int64()),
             pa.array(edge, pa.list_(pa.int32())), pa.array(audits, pa.list_(pa.string())), pa.array(exits, pa.list_(pa.int32()))],
            names=["conv", "seg", "cost", "illegal", "edge", "audits", "exits"],
        )


def _from_the_front(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, seg, entry, audit, cost, illegal) from segments in rising order; cost at a conversation's first."""
    conv, state, before = object(), 0, 0
    for batch in batches:
        rows = []
        for c, cost, illegal, edge, audits, exits in zip(*(batch.column(x).to_pylist() for x in ("conv", "cost", "illegal", "edge", "audits", "exits"))):
            if c != conv:
                conv, state = c, 0
            else:
                cost, illegal = 0, illegal + (not _LEGAL[before, edge[0]])
            rows.append((state, audits[state], cost, int(illegal)))
            state, before = exits[state], edge[1]
        columns = list(zip(*rows)) or [()] * 4
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), batch.column("seg"), *(pa.array(x, k) for x, k in zip(columns, kinds))],
            names=["conv", "seg", "entry", "audit", "cost", "illegal"],
        )


def _edits(coded: DataFrame) -> DataFrame:
    """(conv, seg, entry, audit, cost, illegal) of every segment, stored."""
    kind = coded.schema["conv"].dataType.simpleString()
    own = f"conv {kind}, seg bigint"
    seg = F.shiftright("place", SEGMENT_BITS).alias("seg")
    listed = coded.groupBy("conv", seg).agg(F.sort_array(F.collect_list(F.struct("place", "code"))).alias("rows"))
    codes = listed.select("conv", "seg", F.array_join(F.col("rows.code"), "").alias("codes"))
    tables = codes.mapInArrow(_tables, f"{own}, codes string, table array<bigint>")
    back = tables.repartition("conv").sortWithinPartitions("conv", F.desc("seg"))
    togo = back.mapInArrow(_from_the_back, f"{own}, codes string, last boolean, go array<bigint>")
    ways = togo.repartition("conv", "seg").mapInArrow(
        _ways, f"{own}, cost bigint, illegal bigint, edge array<int>, audits array<string>, exits array<int>"
    )
    front = ways.repartition("conv").sortWithinPartitions("conv", "seg")
    return stored(front.mapInArrow(_from_the_front, f"{own}, entry int, audit string, cost bigint, illegal bigint"), "edits")


def _scripted(numbered: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits and rows in one table: each segment's edits, then its rows, when sorted by (conv, seg, place)."""
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    script = edits.select("conv", "seg", F.lit(-1).cast("bigint").alias("place"), "entry", "audit", none("string", "role"), none("string", "text"))
    rows = numbered.select(
        "conv", F.shiftright("place", SEGMENT_BITS).alias("seg"), "place", none("int", "entry"), none("string", "audit"), "role", "text"
    )
    return script.union(rows)


class _Script:
    """Walks through a segment's edits as its rows come by."""

    def __init__(self, entry: int, audit: str):
        self.state, self.audit, self.at = entry, audit, 0

    def _role(self) -> str:
        self.state = int(_NEXT[self.state])
        return ROLES[self.state]

    def inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield "I", self._role(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            yield edit, self._role(), text
        elif edit == "K":
            self.state = {"s": 1, "u": 2, "a": 3}[role[0]]
            yield edit, role, text


def _scripts(batch: pa.RecordBatch):
    return zip(*(batch.column(c).to_pylist() for c in ("conv", "seg", "place", "entry", "audit", "role", "text")))


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, place, part, edit, role, text) of the rows of repaired conversations."""
    script, last = None, (None, 0)
    for batch in batches:
        out = []
        for conv, _, place, entry, audit, role, text in _scripts(batch):
            if place < 0:
                if script:
                    out += [(last[0], last[1] + 1, i, *x) for i, x in enumerate(script.inserts())]
                script = _Script(entry, audit)
            else:
                out += [(conv, place, i, *x) for i, x in enumerate(script.row(role, text))]
                last = conv, place
        yield _repaired_batch(out, batch.schema.field("conv").type)
        kind = batch.schema.field("conv").type
    if script:
        yield _repaired_batch([(last[0], last[1] + 1, i, *x) for i, x in enumerate(script.inserts())], kind)


def _repaired_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]
    columns = list(zip(*rows)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=["conv", "place", "part", "edit", "role", "text"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, audit, repaired_sha256): conversations stream through, none is held."""
    conv, script, audit, sha, some = object(), None, [], None, False
    kind = None

    def add(edits: Iterator[tuple[str, str, str]]) -> None:
        nonlocal some
        for _, role, text in edits:
            sha.update(f"{chr(10) if some else ''}{role}:{text}".encode())
            some = True

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 3
        return pa.RecordBatch.from_arrays(
            [pa.array(x, k) for x, k in zip(columns, (kind, pa.string(), pa.string()))], names=["conv", "audit", "repaired_sha256"]
        )

    for batch in batches:
        kind, out = batch.schema.field("conv").type, []
        for c, _, place, entry, piece, role, text in _scripts(batch):
            if place < 0:
                if script:
                    add(script.inserts())
                if sha is None or c != conv:
                    if sha is not None:
                        out.append((conv, "".join(audit), sha.hexdigest()))
                    conv, audit, sha, some = c, [], hashlib.sha256(), False
                script = _Script(entry, piece)
                audit.append(piece)
            else:
                add(script.row(role, text))
        yield batch_of(out)
    if script:
        add(script.inserts())
        yield batch_of([(conv, "".join(audit), sha.hexdigest())])


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, place, part, edit, role, text): every conversation of `rows` as repaired.

    `rows` is (conv_id, turn, role, text), in each conversation ordered by turn, NULL first, then by
    role and text.  (place, part) orders the rows of a conversation.  A NULL role or text reads as one space; a
    NULL conv_id is a conversation of its own; a role whose first character is not s, u or a, or that
    is empty, cannot be kept.  Repeated rows are duplicates and go.  An empty table gives none.
    """
    numbered = _numbered(rows)
    edits = _edits(_coded(numbered))
    kind = numbered.schema["conv"].dataType.simpleString()
    # segments, not conversations: a long one is spread over tasks
    dealt = _scripted(numbered, edits).repartition("conv", "seg").sortWithinPartitions("conv", "seg", "place")
    found = dealt.mapInArrow(_repaired, f"conv {kind}, place bigint, part int, edit string, role string, text string")
    return found.withColumnRenamed("conv", "conv_id")


def report(rows: DataFrame, original: DataFrame) -> DataFrame:
    """One row for each conv_id of `original`: its faults in `rows`, cost, audit and digest of its repair.

    gaps, blank, duplicate, truncated and illegal count faults (see `repaired` for the order of rows and
    for NULLs); a conversation without rows has zeros, an empty audit and the digest of no text.
    The digest of one conversation reads its rows one after the other, as any digest does; they stream
    through one task and are not held.
    """
    numbered = _numbered(rows)
    coded = stored(_coded(numbered), "coded")
    edits = _edits(coded)
    count = lambda fault: F.count_if(F.col("fault") == fault)
    faults = coded.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("bigint").alias("gaps"),
        *[count(x).cast("bigint").alias(x) for x in ("blank", "duplicate", "truncated")],
    )
    totals = edits.groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    kind = numbered.schema["conv"].dataType.simpleString()
    stream = _scripted(numbered, edits).repartition("conv").sortWithinPartitions("conv", "seg", "place")
    digests = stream.mapInArrow(_digests, f"conv {kind}, audit string, repaired_sha256 string")
    out = original.select("conv_id").distinct()
    for part in (faults, totals, digests):
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col("conv")), "left").drop("conv")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return out.select(
        "conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
