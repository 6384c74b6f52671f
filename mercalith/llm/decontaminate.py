"""Benchmark decontamination: a broadcast hash set of test n-grams over training token windows.

Words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z became a-z: digits, letters a-z and every
character beyond ASCII.  A window is WINDOW consecutive words of one test item; an item with fewer
words, but not none, is one window.

The hash of every window of the items goes into a hash set that every task holds; the windows of the
training texts, hashed for a whole Arrow batch at once, are looked up in a bit table first and in the
sorted hashes where their bit is set.  Each hit is then verified word by word against the item, so a
collision of hashes marks nothing.  Equal windows of many items are one entry with the list of items.

The broadcast is bounded: items are dealt into blocks of at most BLOCK_BYTES of text (long items as
overlapping parts).  One block is the usual case and takes one scan of the documents without any
shuffle.  Where there are more, the documents go through the blocks one after the other; what has been
found travels beside the text in a dataset written between two blocks.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercalith.llm.common import stored
from mercalith.llm.word_hashes import gram_hashes, slices, word_hashes

WINDOW = 10
BLOCK_BYTES = 4_000_000
PART_WORDS = 4096

# every byte as it is compared: a-z for A-Z, a space for what separates words
_PLAIN = np.full(256, 32, dtype=np.uint8)
_PLAIN[48:58] = np.arange(48, 58)
_PLAIN[65:91] = np.arange(97, 123)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)

_numbers = itertools.count()


def plain(texts: pa.Array) -> pa.Array:
    """Texts of the same length in bytes with words in a-z and spaces between them."""
    _, offsets, data = texts.buffers()
    begin = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[begin[0] : begin[-1]] if data else np.empty(0, np.uint8)
    moved = pa.py_buffer((begin - begin[0]).tobytes())
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, moved, pa.py_buffer(_PLAIN[raw])])


def _parts(items: DataFrame, window: int) -> DataFrame:
    """(item, part): the words of an item in parts of PART_WORDS that overlap by window - 1 words."""
    text = F.translate(
        F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    # DISTINCT: a repeated row adds nothing
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), text.alias("t")).distinct()
    rows = rows.withColumn("w", F.expr(r"regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', 0)"))
    step = PART_WORDS - window + 1
    starts = F.expr(f"sequence(0L, greatest(size(w) - {window}, 0), {step}L)")
    rows = rows.filter("size(w) > 0").select("item", "w", F.explode(starts).alias("at"))
    return rows.select("item", F.array_join(F.slice("w", F.col("at").cast("int") + 1, PART_WORDS), " ").alias("part"))


def _blocks(items: DataFrame, window: int, block_bytes: int) -> tuple[DataFrame, int]:
    """(item, part, block) and the number of blocks, of at most `block_bytes`, or of one part that is larger alone."""
    parts = stored(_parts(items, window), "test-items")
    size = F.sum(F.octet_length("part") + 1)
    total = parts.agg(size).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    while True:
        dealt = parts.withColumn("block", F.pmod(F.xxhash64("item", "part"), F.lit(n)).cast("int"))
        worst = dealt.groupBy("block").agg(size.alias("size"), F.count("*").alias("n")).filter("n > 1").agg(F.max("size")).first()[0]
        if (worst or 0) <= block_bytes:
            return dealt, n
        n *= 2


@dataclass
class Windows:
    """The windows of some items, by length: sorted hashes, and for each where its words are."""

    items: list[str]
    words: list[bytes] = field(default_factory=list)
    sizes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)
    owners: dict[tuple[int, int], list[int]] = field(default_factory=dict)

    @staticmethod
    def of(parts: list[tuple[str, str]], window: int) -> Windows:
        items = sorted({item for item, _ in parts})
        number = {item: i for i, item in enumerate(items)}
        out = Windows(items)
        known: dict[int, dict[tuple[bytes, ...], int]] = {}
        for item, text in sorted(parts):
            words = text.encode().split(b" ")
            size = min(window, len(words))
            place = known.setdefault(size, {})
            base = len(out.words)
            out.words += words
            for i in range(len(words) - size + 1):
                at = place.setdefault(tuple(words[i : i + size]), base + i)
                owner = out.owners.setdefault((size, at), [])
                if not owner or owner[-1] != number[item]:
                    owner.append(number[item])
        for size, place in known.items():
            at = np.fromiter(place.values(), np.int64, len(place))
            joined = pa.array([b" ".join(k) for k in place], pa.large_binary())
            hashes, bounds = word_hashes(joined)
            found = gram_hashes(hashes, size)[bounds[:-1]]
            order = np.argsort(found, kind="stable")
            bits = max(16, int(16 * len(place)).bit_length())
            table = np.zeros(1 << bits, dtype=bool)
            table[found >> np.uint64(64 - bits)] = True
            out.sizes[size] = found[order], at[order], table
        return out

    def candidates(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(word number, place of the window among the items' words) where hashes meet."""
        grams = gram_hashes(hashes, size)
        sorted_, at, table = self.sizes[size]
        maybe = np.flatnonzero(table[grams >> np.uint64(64 - (len(table) - 1).bit_length())])
        low = np.searchsorted(sorted_, grams[maybe], "left")
        many = np.searchsorted(sorted_, grams[maybe], "right") - low
        row = np.repeat(np.arange(len(maybe)), many)
        each = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        return maybe[row], at[low[row] + each]


@lru_cache(maxsize=1)
def _windows(key: int, block, window: int) -> Windows:
    return Windows.of(block.value, window)


def _verified(index: Windows, size: int, words: list[bytes], at: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which candidates of one text hold, word by word; runs along both sides are compared at once."""
    out = np.zeros(len(at), dtype=bool)
    order = np.lexsort((at, place - at))
    at, place = at[order], place[order]
    breaks = np.flatnonzero((np.diff(at) != 1) | (np.diff(place) != 1)) + 1
    for i, j in zip([0, *breaks.tolist()], [*breaks.tolist(), len(at)]):
        a, p, n = int(at[i]), int(place[i]), j - i + size - 1
        if words[a : a + n] == index.words[p : p + n]:
            out[order[i:j]] = True
        else:
            for k in range(i, j):
                a, p = int(at[k]), int(place[k])
                out[order[k]] = words[a : a + size] == index.words[p : p + size]
    return out


def _spans(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _joined(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that cover what either list covers."""
    out: list[tuple[int, int]] = []
    for start, end in sorted([*a, *b]):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


_FOUND = "_n_words bigint, _spans array<struct<start:bigint,end:bigint>>, _items array<string>"


def _scan(key: int, block, window: int, names: list[str], before: bool, with_text: bool):
    """Adds (_n_words, _spans, _items) of one block to the rows, joined to those of blocks before."""
    kept = [c for c in names if with_text or c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _windows(key, block, window)
        for batch in batches:
            for first, part in slices(batch.column("text")):
                rows = batch.slice(first, len(part))
                low = plain(part)
                hashes, bounds = word_hashes(low)
                spans: list[list[tuple[int, int]]] = [[] for _ in range(len(part))]
                items: list[set[str]] = [set() for _ in range(len(part))]
                for size in index.sizes:
                    at, place = index.candidates(hashes, size)
                    text = np.searchsorted(bounds, at, "right") - 1
                    inside = at + size <= bounds[text + 1]
                    at, place, text = at[inside], place[inside], text[inside]
                    for t in np.unique(text).tolist():
                        mine = slice(*np.searchsorted(text, [t, t + 1]))
                        words = low[t].as_py().split()
                        here, there = at[mine] - bounds[t], place[mine]
                        good = _verified(index, size, words, here, there)
                        change = np.zeros(len(words) + 1, dtype=np.int64)
                        np.add.at(change, here[good], 1)
                        np.add.at(change, here[good] + size, -1)
                        spans[t] = _joined(spans[t], _spans(np.cumsum(change[:-1]) > 0))
                        for p in np.unique(there[good]).tolist():
                            items[t].update(index.items[i] for i in index.owners[size, p])
                if before:
                    for t, (s, i) in enumerate(zip(rows.column("_spans").to_pylist(), rows.column("_items").to_pylist())):
                        spans[t] = _joined(spans[t], [(x["start"], x["end"]) for x in s])
                        items[t].update(i)
                pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])
                made = [
                    pa.array(np.diff(bounds).astype(np.int64)),
                    pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pair)),
                    pa.array([sorted(i) for i in items], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in kept), *made], names=[*kept, "_n_words", "_spans", "_items"]
                )

    return run


def contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, with_text: bool = False, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """All rows and columns of `docs` with `_n_words`, `_spans` and `_items`; `text` on request.

    `_spans` are the runs of hit words (start, end), counted from 0, end excluded: every word that
    lies inside an occurrence of a window of `items` (item_id, text).  `_items` are the ids, as text
    and sorted by code point, of the items with such a window; rows of one item_id are one item, rows
    with a NULL id are one item whose name is empty.  NULL and empty texts have no words and no hits; an
    item without words protects nothing; an empty table of items leaves all clean.  Rows are
    judged one by one, so repeated ids and ties need no rule, and a text is read whole in one task.
    """
    sc = docs.sparkSession.sparkContext
    dealt, blocks = _blocks(items, window, block_bytes)
    now = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    kinds = {f.name: f.dataType.simpleString() for f in now.schema}
    for i in range(blocks):
        # one block at a time is on the driver; its size is known before it is fetched
        block = sc.broadcast([tuple(r) for r in dealt.filter(F.col("block") == i).select("item", "part").collect()])
        last = i == blocks - 1
        keep = with_text or not last
        schema = ", ".join([*(f"`{c}` {k}" for c, k in kinds.items() if keep or c != "text"), _FOUND])
        now = now.mapInArrow(_scan(next(_numbers), block, window, list(kinds), i > 0, keep), schema)
        if not last:
            now = stored(now, "hits")
            block.unpersist()
    return now


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, item_ids, contaminated) of every row of `docs`."""
    found = contamination(docs.select("doc_id", "text"), items, window)
    hit = F.aggregate("_spans", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    return found.select(
        "doc_id", F.col("_n_words").alias("n_words"), hit.alias("n_hit"),
        F.size("_items").cast("bigint").alias("n_items"), F.col("_items").alias("item_ids"),
        (F.size("_spans") > 0).alias("contaminated"),
    )


def _cut(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column("text"), batch.column("_spans").to_pylist()):
                raw = text.as_py()
                if spans:
                    data = raw.encode()
                    inside = np.concatenate([[0], (_PLAIN[np.frombuffer(data, np.uint8)] != 32).astype(np.int8), [0]])
                    edge = np.flatnonzero(np.diff(inside))
                    begin, end = edge[::2], edge[1::2]
                    at, left = 0, []
                    for s in spans:
                        left.append(data[at : begin[s["start"]]])
                        at = int(end[s["end"] - 1])
                    raw = b"".join([*left, data[at:]]).decode()
                texts.append(raw)
            new = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([new if c == "text" else batch.column(c) for c in names], names=names)

    return run


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, spans: bool = False) -> DataFrame:
    """`docs` without the documents that hold a window of `items`, or (`spans`) without those words.

    Columns stay.  With `spans`, what lies between the first and the last character of each run of
    hit words is cut from the text, the rest stays as it is, and `n_chars`, if there, is counted anew.
    """
    inner = {c: f"_c{i}" for i, c in enumerate(docs.columns) if c != "text"}
    plainly = docs.select("text", *[F.col(f"`{c}`").alias(n) for c, n in inner.items()], F.col("text").isNull().alias("_none"))
    found = contamination(plainly, items, window, with_text=True)
    if not spans:
        found = found.filter(F.size("_spans") == 0)
        return found.select(*[
            F.when(~F.col("_none"), F.col("text")).alias(c) if c == "text" else F.col(inner[c]).alias(c) for c in docs.columns
        ])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    cut = found.mapInArrow(_cut(found.columns), schema)
    hit = F.size("_spans") > 0
    out = []
    for c in docs.columns:
        value = F.col(inner.get(c, c))
        if c == "text":
            value = F.when(~F.col("_none"), F.col("text"))
        elif c == "n_chars":
            value = F.when(hit, F.length("text").cast(docs.schema[c].dataType)).otherwise(value)
        out.append(value.alias(c))
    return cut.select(*out)


