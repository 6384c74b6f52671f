"""Near-duplicate vectors by cosine, through small-world graphs over shards.

Vectors are compared only with vectors of the same label.  Equal vectors are one node with a count,
so copies cost nothing.  The nodes of a label are dealt into shards of bounded size; each shard gets
a hierarchical navigable small-world graph, stored as one row.  Every shard is queried with the
vectors of every shard of its label (each pair of shards is one row of work, both directions at
once).  A query's beam is widened while everything in it is still above the threshold, and the width
that all queries start with is doubled until an audit of the shard passes: a fixed set of its nodes
is compared with the whole shard, and nearly all true links must be found.  Every link is verified
by its cosine in double precision.

A task counts links and joins them into components on the spot; it hands on one count for each node
and at most one link for each node, never the list of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercalith.llm.common import stored
from mercalith.llm.components import components
from mercalith.llm.perfect_hash import mix

THRESHOLD = 0.98
SHARD_ROWS = 8192
NEIGHBOURS = 12
BUILD_BEAM = 48
SEARCH_BEAM = 24
AUDIT_NODES = 64
AUDIT_RECALL = 0.98
BLOCK = 128
STEP = 4
QUERIES = 65_536


class SmallWorld:
    """A hierarchical small-world graph over unit vectors, searched by inner product.

    Levels are drawn from a hash of the node's number, so the same vectors give the same graph.
    `links[level][node]` are the neighbours of a node, padded with -1.  Nodes are inserted in blocks and
    queries are answered in blocks, all in step by array operations.
    """

    def __init__(self, vectors: np.ndarray, links: list[np.ndarray] | None = None, entry: int = 0):
        self.vectors = np.ascontiguousarray(vectors, dtype=np.float32)
        self.entry = entry
        self.links = links or []

    @classmethod
    def build(cls, vectors: np.ndarray, neighbours: int = NEIGHBOURS, beam: int = BUILD_BEAM) -> SmallWorld:
        n = len(vectors)
        unit = mix(np.arange(n, dtype=np.uint64), 31).astype(np.float64) / 2.0**64
        level = np.minimum((-np.log(np.maximum(unit, 1e-18)) / np.log(neighbours)).astype(int), 6)
        graph = cls(vectors)
        graph.entry = int(level.argmax()) if n else 0
        for k in range(int(level.max(initial=0)) + 1):
            graph.links.append(np.full((n, neighbours * (2 if k == 0 else 1)), -1, dtype=np.int32))
            members = np.flatnonzero(level >= k)
            for at in range(0, len(members), BLOCK):
                graph._insert(members, at, min(at + BLOCK, len(members)), k, beam)
        return graph

    def _insert(self, members: np.ndarray, begin: int, end: int, k: int, beam: int) -> None:
        """Link a block of a level's members to the nearest of those before them, and these back.

        A shard is bounded, so the block meets all earlier members in one matrix product, which finds
        what the widest beam would.
        """
        block = members[begin:end]
        similar = self.vectors[block] @ self.vectors[members[:end]].T
        later = np.arange(end) >= np.arange(begin, end)[:, None]
        similar[later] = -2
        width = min(beam, end)
        top = np.argpartition(-similar, width - 1, axis=1)[:, :width]
        value = np.take_along_axis(similar, top, 1)
        order = np.argsort(-value, axis=1, kind="stable")
        top, value = np.take_along_axis(top, order, 1), np.take_along_axis(value, order, 1)
        found = np.where(value > -2, members[top], -1)
        links = self.links[k]
        chosen = self._diverse(found, value, links.shape[1])
        links[block, : chosen.shape[1]] = chosen
        # the way back
        source, target = np.repeat(block, chosen.shape[1]), chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        self._connect(target, source, k)

    def _diverse(self, found: np.ndarray, value: np.ndarray, most: int) -> np.ndarray:
        """Of each row of nodes, nearest first, those nearer to the row's own node than to any chosen before;
        then the nearest of the others, as far as half the room allows.  -1 is no node."""
        vectors = self.vectors[found]
        near = vectors @ vectors.transpose(0, 2, 1)
        n, width = found.shape
        chosen = np.zeros((n, width), dtype=bool)
        closest = np.full((n, width), -3.0, dtype=np.float32)  # to a chosen node
        for j in range(width):
            take = (found[:, j] >= 0) & (value[:, j] > closest[:, j]) & (chosen.sum(axis=1) < most)
            chosen[:, j] = take
            closest[take] = np.maximum(closest[take], near[take, j])
        room = np.maximum(0, most // 2 - chosen.sum(axis=1))
        others = ~chosen & (found >= 0)
        chosen |= others & (np.cumsum(others, axis=1) <= room[:, None])
        order = np.argsort(~chosen, axis=1, kind="stable")[:, :most]
        return np.where(np.take_along_axis(chosen, order, 1), np.take_along_axis(found, order, 1), -1).astype(np.int32)

    def _connect(self, target: np.ndarray, source: np.ndarray, k: int) -> None:
        """Add links from each target to its sources; where there is no room the diverse ones stay."""
        links = self.links[k]
        most = links.shape[1]
        order = np.lexsort((source, target))
        target, source = target[order], source[order]
        node, begin, many = np.unique(target, return_index=True, return_counts=True)
        have = (links[node] >= 0).sum(axis=1)
        fits = have + many <= most
        place = np.arange(len(target)) - np.repeat(begin, many) + np.repeat(have, many)
        each = np.repeat(fits, many)
        links[target[each], place[each]] = source[each]
        full = np.flatnonzero(~fits)
        # lists of about the same length together
        for some in np.array_split(full[np.argsort(many[full])], max(1, len(full) // 64)) if len(full) else ():
            width = most + int(many[some].max())
            lists = np.full((len(some), width), -1, dtype=np.int64)
            lists[:, :most] = links[node[some]]
            for row, i in enumerate(some):
                lists[row, most : most + many[i]] = source[begin[i] : begin[i] + many[i]]
            value = np.einsum("ij,ikj->ik", self.vectors[node[some]], self.vectors[lists])
            value[lists < 0] = -2
            best = np.argsort(-value, axis=1, kind="stable")[:, : 2 * most]
            lists, value = np.take_along_axis(lists, best, 1), np.take_along_axis(value, best, 1)
            links[node[some]] = -1
            kept = self._diverse(lists, value, most)
            links[node[some], : kept.shape[1]] = kept

    def _walk(self, queries: np.ndarray, start: np.ndarray, beam: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities) of the `beam` nearest that best-first walks find, nearest first; -1 pads.

        All queries walk in step: in each, the best STEP nodes of the beam that were not looked at give their
        neighbours.
        """
        links, n = self.links[k], len(self.vectors)
        q = np.arange(len(queries))[:, None]
        seen = np.zeros((len(queries), n + 1), dtype=bool)  # the last column takes the padding
        nodes = np.full((len(queries), beam), -1, dtype=np.int64)
        value = np.full((len(queries), beam), -2, dtype=np.float32)
        opened = np.ones((len(queries), beam), dtype=bool)
        start = start[:, :beam]
        width = start.shape[1]
        nodes[:, :width] = start
        value[:, :width] = np.where(start >= 0, np.einsum("ij,ikj->ik", queries, self.vectors[start]), -2)
        opened[:, :width] = start < 0
        seen[q, start] = True
        active = np.arange(len(queries))
        while len(active):
            rows = active[:, None]
            waits = np.where(opened[active], -3, value[active])
            pick = np.argpartition(-waits, min(STEP, beam) - 1, axis=1)[:, :STEP]
            picked = np.where(np.take_along_axis(waits, pick, 1) > -2, nodes[rows, pick], -1)
            opened[rows, pick] = True
            near = np.where(picked[:, :, None] >= 0, links[picked], -1).reshape(len(active), -1)
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[seen[rows, near]] = -1
            seen[rows, near] = True
            similar = np.where(near >= 0, np.einsum("ij,ikj->ik", queries[active], self.vectors[near]), -2)
            all_nodes = np.concatenate([nodes[active], near], axis=1)
            all_value = np.concatenate([value[active], similar], axis=1)
            all_opened = np.concatenate([opened[active], near < 0], axis=1)
            keep = np.argpartition(-all_value, beam - 1, axis=1)[:, :beam]
            nodes[active] = np.take_along_axis(all_nodes, keep, 1)
            value[active] = np.take_along_axis(all_value, keep, 1)
            opened[active] = np.take_along_axis(all_opened, keep, 1)
            active = active[~opened[active].all(axis=1)]
        order = np.argsort(-value, axis=1, kind="stable")
        nodes, value = np.take_along_axis(nodes, order, 1), np.take_along_axis(value, order, 1)
        return np.where(value > -2, nodes, -1), value

    def above(self, queries: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of what is found at or above the threshold; beams widen while they are full of it.

        A beam as wide as a quarter of the graph meets every node, which is one matrix product.
        """
        pairs: list[np.ndarray] = []
        n = len(self.vectors)
        for at in range(0, len(queries), BLOCK):
            block = queries[at : at + BLOCK]
            left, width = np.arange(len(block)), beam
            start = np.full((len(block), 1), self.entry)
            for k in range(len(self.links) - 1, 0, -1):
                start = self._walk(block, start, 1, k)[0]
            while len(left):
                if 4 * width >= n:
                    row, node = np.nonzero(block[left] @ self.vectors.T >= threshold)
                    pairs.append(np.stack([at + left[row], node]))
                    break
                nodes, value = self._walk(block[left], start, width, 0)
                full = value[:, -1] >= threshold
                row, place = np.nonzero((value >= threshold) & ~full[:, None])
                pairs.append(np.stack([at + left[row], nodes[row, place]]))
                left, start, width = left[full], nodes[full], 4 * width
        found = np.concatenate(pairs, axis=1) if pairs else np.empty((2, 0), np.int64)
        return found[0], found[1]


def audited_beam(
    graph: SmallWorld, threshold: float, queries: np.ndarray | None = None, beam: int = SEARCH_BEAM, nodes: int = AUDIT_NODES
) -> int:
    """The least beam (doubling from `beam`) whose recall over fixed queries passes.

    Without `queries` they are nodes of the graph: half spread evenly over the shard, half over those that have
    a near neighbour in the graph, as only they can show a missing link.  The width at which every node is
    met needs no audit.
    """
    n = len(graph.vectors)
    pick = lambda x, m: x[np.linspace(0, len(x) - 1, min(len(x), m)).astype(int)]
    if queries is None:
        near = np.zeros(n, dtype=bool)
        for j in range(graph.links[0].shape[1]):
            other = graph.links[0][:, j]
            near |= (other >= 0) & (np.einsum("ij,ij->i", graph.vectors, graph.vectors[other]) >= threshold)
        some = np.unique(np.concatenate([pick(np.arange(n), nodes // 2), pick(np.flatnonzero(near), nodes // 2)]))
        asked = graph.vectors[some]
    else:
        asked = queries[pick(np.arange(len(queries)), nodes)]
    truth = int((asked @ graph.vectors.T >= threshold).sum())
    while 4 * beam < n:
        found = graph.above(asked, threshold, beam)
        if len(found[0]) >= AUDIT_RECALL * truth:
            break
        beam *= 2
    return beam


SHARD = "shard int, n bigint, dims int, nodes binary, copies binary, vectors binary, graph binary, levels int, entry int, beam int"
_LOOSE = 1e-4  # searches compare in single precision, links are verified in double


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _build(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """One row for each shard, from rows sorted by (label, dims, shard, node)."""
    held: list[tuple] = []
    now = None
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}

    def shard(key: tuple, rows: list[tuple], label: pa.DataType) -> pa.RecordBatch:
        nodes, copies = np.array([r[0] for r in rows], dtype="<i8"), np.array([r[1] for r in rows], dtype="<i8")
        raw = np.stack([r[2] for r in rows]).astype("<f8")
        graph = SmallWorld.build(_unit(raw))
        row = {
            "label": key[0], "shard": key[1], "n": len(rows), "dims": key[2], "nodes": nodes.tobytes(), "copies": copies.tobytes(), "vectors": raw.tobytes(),
            "graph": b"".join(x.tobytes() for x in graph.links), "levels": len(graph.links), "entry": graph.entry,
            "beam": audited_beam(graph, threshold - _LOOSE),
        }
        schema = pa.schema([("label", label), *((n, kinds[t]) for n, t in (x.split(" ") for x in SHARD.split(", ")))])
        return pa.RecordBatch.from_pylist([row], schema)

    for batch in batches:
        label = batch.schema.field("label").type
        columns = [batch.column(c).to_pylist() for c in ("label", "shard", "dims", "node", "copies")]
        for *key, node, copies, vector in zip(*columns, batch.column("embedding")):
            if tuple(key) != now:
                if held:
                    yield shard(now, held, label)
                now, held = tuple(key), []
            held.append((node, copies, vector.values.to_numpy(zero_copy_only=False)))
    if held:
        yield shard(now, held, label)


def _open(row: dict, prefix: str) -> tuple[np.ndarray, np.ndarray, SmallWorld, int]:
    """(node numbers, unit vectors in double precision, graph, beam) of a stored shard."""
    n = row[f"{prefix}n"]
    unit = _unit(np.frombuffer(row[f"{prefix}vectors"], "<f8").reshape(n, -1))
    flat = np.frombuffer(row[f"{prefix}graph"], "<i4")
    links, at = [], 0
    for k in range(row[f"{prefix}levels"]):
        width = NEIGHBOURS * (2 if k == 0 else 1)
        links.append(flat[at : at + n * width].reshape(n, width))
        at += n * width
    return np.frombuffer(row[f"{prefix}nodes"], "<i8"), unit, SmallWorld(unit, links, row[f"{prefix}entry"]), row[f"{prefix}beam"]


def _pairs(a, b, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Verified links between two shards as (row in a, row in b); within one shard row a < row b."""
    found: list[np.ndarray] = []

    def ask(queries: np.ndarray, graph: SmallWorld, beam: int, target: np.ndarray, turn: bool) -> None:
        short = queries.astype(np.float32)
        if not same:  # the shard was audited with nodes of its own
            beam = audited_beam(graph, threshold - _LOOSE, short, beam)
        for at in range(0, len(queries), QUERIES):
            me, near = graph.above(short[at : at + QUERIES], threshold - _LOOSE, beam)
            me = me + at
            for i in range(0, len(me), QUERIES):
                x, y = me[i : i + QUERIES], near[i : i + QUERIES]
                true = np.einsum("ij,ij->i", queries[x], target[y]) >= threshold
                found.append(np.stack([y[true], x[true]] if turn else [x[true], y[true]], axis=1))

    ask(a[1], b[2], b[3], b[1], False)
    if not same:
        ask(b[1], a[2], a[3], a[1], True)
    pairs = np.concatenate(found) if found else np.empty((0, 2), np.int64)
    if same:
        pairs = np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1)
    code = np.unique(pairs[:, 0] * len(b[0]) + pairs[:, 1])
    return code // len(b[0]), code % len(b[0])


def _forest(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """At most one link for each node that connect what all the links connect."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(left.tolist(), right.tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((min(x, y), max(x, y)))
    return out


def _search(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                same = row["a_shard"] == row["b_shard"]
                a = _open(row, "a_")
                b = a if same else _open(row, "b_")
                left, right = _pairs(a, b, same, threshold)
                copies_a = np.frombuffer(row["a_copies"], "<i8")
                copies_b = copies_a if same else np.frombuffer(row["b_copies"], "<i8")
                node = np.concatenate([a[0][left], b[0][right]])
                links = np.concatenate([copies_b[right], copies_a[left]])
                distinct, where = np.unique(node, return_inverse=True)
                total = np.bincount(where, weights=links, minlength=len(distinct)).astype(np.int64)
                edges = _forest(a[0][left], b[0][right])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([distinct, np.array([x for x, _ in edges], dtype=np.int64)])),
                        pa.array([*total.tolist(), *[None] * len(edges)], pa.int64()),
                        pa.array([*[None] * len(distinct), *[y for _, y in edges]], pa.int64()),
                    ],
                    names=["node", "n", "other"],
                )

    return run


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label).

    Rows are linked if their labels are equal and not NULL and their cosine is at least
    `threshold`.  NULL embeddings and labels, zero vectors and vectors with NULL or non-finite parts
    link with nothing; vectors of different length never link.  Equal vectors link with each other.
    A NULL vec_id is a row of its own that counts for others but names no component.  Repeated rows
    stay and count one by one.  An empty table gives an empty result; other columns are ignored.
    """
    spark = rows.sparkSession
    given = rows.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.coalesce(
        F.col("label").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0), F.lit(False)
    )
    nodes = stored(
        given.filter(usable).groupBy("label", "embedding")
        .agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
        .withColumn("node", F.monotonically_increasing_id()).withColumn("dims", F.size("embedding")),
        "vector-nodes",
    )
    sizes = nodes.groupBy("label", "dims").agg(F.ceil(F.count("*") / shard_rows).alias("shards"))
    # a task for each shard, as good as hashing deals them
    shards = sizes.agg(F.sum("shards")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * int(shards))
    key = ["label", "dims", "shard"]
    kind = given.schema["label"].dataType.simpleString()
    dealt = nodes.join(sizes, ["label", "dims"]).withColumn("shard", F.pmod(F.xxhash64("node"), "shards").cast("int"))
    graphs = stored(
        dealt.select(*key, "node", "copies", "embedding").repartition(tasks, *key).sortWithinPartitions(*key, "node")
        .mapInArrow(lambda batches: _build(batches, threshold), f"label {kind}, {SHARD}"),
        "vector-graphs",
    )
    a, b = (graphs.select(*[F.col(c).alias(f"{x}_{c}") for c in graphs.columns]) for x in "ab")
    # the list of shard pairs is made of keys alone
    names = graphs.select("label", "dims", F.col("shard").alias("left"))
    pairs = names.join(names.withColumnRenamed("left", "right"), ["label", "dims"]).filter("left <= right")
    work = pairs.join(a, F.expr("label = a_label AND dims = a_dims AND left = a_shard")).join(
        b, F.expr("label = b_label AND dims = b_dims AND right = b_shard")
    )
    columns = [f"{x}_{c}" for x in "ab" for c in ("shard", "n", "nodes", "copies", "vectors", "graph", "levels", "entry", "beam")]
    spread = work.repartition(tasks, "label", "dims", "left", "right").select(*columns)
    found = stored(spread.mapInArrow(_search(threshold), "node bigint, n bigint, other bigint"), "vector-links")
    counts = found.filter("n IS NOT NULL").groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(found.filter("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    placed = (
        nodes.join(counts, "node", "left").join(roots, "node", "left")
        .select("label", "embedding", "first", F.coalesce("root", "node").alias("root"),
                (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    named = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = stored(placed.join(named, "root").select("label", "embedding", "n_links", "component_id"), "vector-classes")
    joined = given.filter(usable).join(classes, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = given.filter(~usable).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
