"""Repeated passages across documents, by suffix subtrees over prefix partitions.

The repeats looked for are windows of WINDOW words whose sequence also starts in a document with a
smaller id.  A window is the front of a suffix of its document, and equal windows are leaves below one
internal node of depth WINDOW or more in the tree of all suffixes.

1. Suffixes that cannot share such a node are left out.  Every window is filed under one of the runs
   of PREFIX words in it, the one of smallest hash (the leftmost of equals), so that equal windows are
   filed under the same run; about a quarter of all runs are chosen.  Runs that occur in one
   document only are dropped, and with them the suffixes that start in their windows.
2. What is left of a document are stretches of consecutive suffixes.  Of equal stretches, as copies of a
   document have them, only the smallest document's goes on; the others repeat it.
   The suffixes left are then split by their prefix.  A prefix has PREFIX words; where more than GROUP_ROWS
   suffixes are expected below it, it is lengthened, at last to the whole window.  Which prefixes
   these are is read from a sample of documents (SAMPLE_DOCS); it decides where suffixes meet, not
   what is found.  Within a task equal windows are answered at once, and only those of the smallest
   document go on, so a passage that very many documents share sends one leaf for each task.
3. The suffixes of each prefix arrive in order, as the leaves of its subtree.  The common prefix with the
   leaf before tells where nodes begin: leaves that share WINDOW words are below one node of that depth or
   more, whose first leaf is of the smallest document; the others repeat it.  No group is held in memory.
4. How deep a node is shows in the suffixes that start one word later: as long as these repeat the next
   place of the same document, the common prefix goes on (a suffix shares at most one word less than the
   one before it).  Such chains are the maximal repeats, and their words are what is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercalith.llm.common import release_memory, stored
from mercalith.llm.perfect_hash import mix
from mercalith.llm.word_hashes import gram_hashes, slices, word_hashes

WINDOW = 13
PREFIX = 7
GROUP_ROWS = 200_000
TASK_ROWS = 100_000
SLICE_BYTES = 1_000_000
BATCH_TEXTS = 1000
STRETCH = 4096
SAMPLE_DOCS = 2000
# bytes of a word's hash that order the leaves; equal windows agree in these of each word and in 64 bits of the whole
_PART = 1


def _anchors(hashes: np.ndarray, bounds: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, ...]:
    """(word number, hash, text, mask) of the chosen runs; bit o: the window o words before it."""
    places = window - prefix + 1
    grams = gram_hashes(hashes, prefix) >> np.uint64(16)  # 48 bits; equal ones are told apart later
    if len(grams) < places:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    first = np.lib.stride_tricks.sliding_window_view(grams, places).argmin(axis=1)
    # windows that lie in one text
    valid = np.zeros(len(first) + 1, dtype=np.int64)
    begin, end = bounds[:-1], bounds[1:] - window + 1
    some = end > begin
    np.add.at(valid, begin[some], 1)
    np.add.at(valid, end[some], -1)
    starts = np.flatnonzero(np.cumsum(valid)[:-1] > 0)
    offset = first[starts]
    at = starts + offset
    chosen, row = np.unique(at, return_inverse=True)
    mask = np.zeros(len(chosen), dtype=np.int64)
    np.bitwise_or.at(mask, row, 1 << offset)
    text = np.searchsorted(bounds, chosen, "right") - 1
    return chosen, grams[chosen].view(np.int64), text, mask


def _batch(columns: dict[str, np.ndarray | pa.Array]) -> pa.RecordBatch:
    arrays = [x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def _same_as_before(*columns: np.ndarray) -> np.ndarray:
    """Whether each row equals the one before it in all columns."""
    out = np.zeros(len(columns[0]), dtype=bool)
    out[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in columns])
    return out


def _probes(window: int, prefix: int):
    """(anchor, doc, known): one row for each chosen run of a task, or more.

    A run found in two documents of the task is known to repeat: all its documents are told so
    (`known`), and one row goes on to meet the other tasks.
    """

    def flush(anchor: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((doc, anchor))
        anchor, doc = anchor[order], doc[order]
        new = ~_same_as_before(anchor, doc)
        anchor, doc = anchor[new], doc[new]
        first = ~_same_as_before(anchor)
        size = np.diff(np.append(np.flatnonzero(first), len(anchor)))
        several = np.repeat(size, size) > 1
        known = np.flatnonzero(several)
        return _batch(
            {
                "doc": np.concatenate([doc[first], doc[known]]),
                "anchor": np.concatenate([anchor[first], anchor[known]]),
                "known": np.repeat([False, True], [first.sum(), len(known)]),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, docs, held = [], [], 0
        for batch in batches:
            ids = np.asarray(batch.column("doc_id"))
            for at, part in slices(batch.column("text"), SLICE_BYTES):
                _, anchor, text, _ = _anchors(*word_hashes(part), window, prefix)
                anchors.append(anchor)
                docs.append(ids[at + text])
                held += len(anchor)
                if held >= TASK_ROWS:
                    yield flush(np.concatenate(anchors), np.concatenate(docs))
                    anchors, docs, held = [], [], 0
                    release_memory()
        if held:
            yield flush(np.concatenate(anchors), np.concatenate(docs))

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, anchor) of the runs that two documents have, from sorted probes."""
    # of the last run: its smallest and largest document so far, and the one that waits for an answer
    last, low, high, waits = None, 0, 0, np.empty(0, np.int64)
    for batch in batches:
        known = np.asarray(batch.column("known"))
        docs, anchors = np.asarray(batch.column("doc")), np.asarray(batch.column("anchor"))
        yield _batch({"doc": docs[known], "anchor": anchors[known]})
        key, doc = anchors[~known], docs[~known]
        if not len(key):
            continue
        head = np.flatnonzero(~_same_as_before(key))
        size = np.diff(np.append(head, len(key)))
        lows, highs = np.minimum.reduceat(doc, head), np.maximum.reduceat(doc, head)
        if key[0] == last:
            lows[0], highs[0] = min(low, lows[0]), max(high, highs[0])
            if lows[0] < highs[0]:
                yield _batch({"doc": waits, "anchor": np.full(len(waits), last, np.int64)})
                waits = waits[:0]
        else:
            waits = waits[:0]
        repeated = np.repeat(lows < highs, size)
        yield _batch({"doc": doc[repeated], "anchor": key[repeated]})
        if not repeated[-1]:
            waits = doc[-1:].copy()  # all of them are this one
        elif key[-1] != key[0] or key[0] != last:
            waits = waits[:0]
        last, low, high = int(key[-1]), int(lows[-1]), int(highs[-1])


def _fold(words: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each row of word hashes."""
    h = np.zeros(len(words), dtype=np.uint64)
    for j in range(words.shape[1]):
        h = mix(h ^ words[:, j], seed)
    return h


def _asked_windows(batches: Iterator[pa.RecordBatch], window: int, prefix: int):
    """(docs, sigs, first word of each text, text of each window, its first word, the run it is filed under, all
    word hashes), some texts at a time: the windows whose run the document was told to repeat."""
    for batch in batches:
        docs, sigs = np.asarray(batch.column("doc_id")), np.asarray(batch.column("sig"))
        lists = batch.column("anchors")
        wanted = np.asarray(lists.flatten())
        owner = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
        for first, part in packed_slices(batch.column("text")):
            hashes, bounds = word_hashes(part)
            at, anchor, text, mask = _anchors(hashes, bounds, window, prefix)
            mine = (owner >= first) & (owner < first + len(part))
            asked = np.unique(mix(wanted[mine].view(np.uint64), 9) ^ owner[mine].astype(np.uint64))
            have = mix(anchor.view(np.uint64), 9) ^ (first + text).astype(np.uint64)
            keep = np.isin(have, asked)
            row, offset = np.nonzero(mask[keep, None] >> np.arange(window - prefix + 1) & 1)
            start = at[keep][row] - offset
            order = np.argsort(start)
            start, filed = start[order], anchor[keep][row][order]
            text = np.searchsorted(bounds, start, "right") - 1
            yield docs[first : first + len(part)], sigs[first : first + len(part)], bounds, text, start, filed, hashes


def _prefixes(window: int, prefix: int) -> list[int]:
    """The lengths a prefix may have."""
    return sorted({prefix, (prefix + window) // 2, window})


def _sampled_prefixes(window: int, prefix: int):
    """(length, key, whole): the prefixes of every suffix, each length but the longest, with its window; and as
    length 0 the places where stretches meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, text, start, filed, hashes in _asked_windows(batches, window, prefix):
            if len(start):
                head = _stretch_heads(text, start)
                low = np.minimum.reduceat(filed, head)
                yield _batch({"length": np.zeros(len(head), np.int32), "key": low, "whole": hashes[start[head]].view(np.int64)})
            for i in range(0, len(start), TASK_ROWS):
                words = hashes[start[i : i + TASK_ROWS, None] + np.arange(window)]
                whole = _fold(words, window).view(np.int64)
                for n in _prefixes(window, prefix)[:-1]:
                    key = _fold(words[:, :n], n).view(np.int64)
                    yield _batch({"length": np.full(len(key), n, np.int32), "key": key, "whole": whole})

    return run


def _stretch_heads(text: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Where stretches of consecutive windows of one text begin; long ones are cut alike, counted from their start."""
    new = np.append(True, (np.diff(start) != 1) | (np.diff(text) != 0))
    begin = np.maximum.accumulate(np.where(new, np.arange(len(start)), 0))
    return np.flatnonzero((np.arange(len(start)) - begin) % STRETCH == 0)


def _stretches(window: int, prefix: int, frequent):
    """Stretches of consecutive suffixes (key, high, low, doc, sig, at, words) and, as `done`, repeats found in the task.

    `words` holds the hashes of the words from the first suffix to the end of the last one's window.  Equal
    stretches, as copies of a document have them, are answered at once; the smallest document's go on.  They meet
    by the smallest run they are filed under, which near copies mostly share too, or by their digest where
    very many share that.
    """

    def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows.sort(key=lambda r: (r[0], r[1], r[2], r[3]))
        go, done, first = [], [], None
        for r in rows:
            if first is None or r[0] != first[0]:
                first = r
            (go if r[1] == first[1] else done).append((r, first))
        if done:
            columns = np.array([(r[1], r[2], r[3], f[1], f[2], f[3], len(r[4]) // 8) for r, f in done], dtype=np.int64).T
            yield _entry_batch(*columns[:3], columns[6], first=columns[3:6])
        digests = np.frombuffer(b"".join(r[0] for r, _ in go), np.int64).reshape(-1, 2)
        doc, sig, at, size = np.array([(*r[1:4], len(r[4]) // 8) for r, _ in go], dtype=np.int64).T
        words = pa.array([r[4] for r, _ in go], pa.binary())
        key = np.array([r[5] for r, _ in go], dtype=np.int64)
        key = np.where(np.isin(key, frequent.value.get(0, ())), digests[:, 0], key)
        yield _entry_batch(doc, sig, at, size, key=key, high=digests[:, 0], low=digests[:, 1], words=words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for docs, sigs, bounds, text, start, filed, hashes in _asked_windows(batches, window, prefix):
            if not len(start):
                continue
            head = _stretch_heads(text, start)
            lowest = np.minimum.reduceat(filed, head).tolist()
            for i, j, low in zip(head.tolist(), [*head[1:].tolist(), len(start)], lowest):
                t, words = int(text[i]), hashes[start[i] : start[j - 1] + window].tobytes()
                digest = hashlib.blake2b(words, digest_size=16).digest()
                rows.append((digest, int(docs[t]), int(sigs[t]), int(start[i] - bounds[t]), words, low))
                held += j - i
                if held >= TASK_ROWS:
                    yield from flush(rows)
                    rows, held = [], 0
                    release_memory()
        if rows:
            yield from flush(rows)

    return run


_ENTRY = (
    "key bigint, done boolean, doc bigint, sig bigint, at int, length int, first_doc bigint, first_sig bigint, first_at int, "
    "high bigint, low bigint, words binary"
)


def _entries(window: int, prefix: int, frequent):
    """Suffixes (key, doc, sig, at, high, words) of stretches sorted by (done, key, high, low, doc); `done` rows pass through.

    Of equal stretches all but the smallest document's are done, and of equal windows that the task holds.
    """
    lengths = _prefixes(window, prefix)

    def flush(doc, sig, at, words) -> Iterator[pa.RecordBatch]:
        high = _fold(words, window).view(np.int64)
        order = np.lexsort((at, doc, high))
        high, doc, sig, at, words = (x[order] for x in (high, doc, sig, at, words))
        same = _same_as_before(high)
        same[1:] &= (words[1:] == words[:-1]).all(axis=1)
        head = np.flatnonzero(~same)
        group = np.repeat(head, np.diff(np.append(head, len(doc))))
        again = doc > doc[group]
        if again.any():
            firsts = group[again]
            found = _chains(doc[again], sig[again], at[again], doc[firsts], sig[firsts], at[firsts], np.full(len(firsts), window))
            yield _entry_batch(*found[:3], found[6], first=found[3:6])
        go = ~again
        words = words[go]
        key = _fold(words[:, : lengths[0]], lengths[0]).view(np.int64)
        for n, longer in zip(lengths, lengths[1:]):
            crowded = np.isin(key, frequent.value.get(n, ()))
            key[crowded] = _fold(words[crowded, :longer], longer).view(np.int64)
        # the leading bytes of each word's hash, in the order of bytes
        data = np.ascontiguousarray(words.astype(">u8").view(np.uint8).reshape(len(words), window, 8)[:, :, :_PART])
        offsets = pa.py_buffer((np.arange(len(words) + 1) * window * _PART).astype(np.int32).tobytes())
        binary = pa.BinaryArray.from_buffers(pa.binary(), len(words), [None, offsets, pa.py_buffer(data.tobytes())])
        yield _entry_batch(doc[go], sig[go], at[go], window, key=(key.view(np.uint64) >> np.uint64(48)).view(np.int64), high=high[go], words=binary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None
        parts, held = [], 0
        for batch in batches:
            done = np.asarray(batch.column("done"))
            if done.any():
                yield batch.filter(pa.array(done))
                batch = batch.filter(pa.array(~done))
            again = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("high", "low", "doc", "sig", "at")), batch.column("words"))
            for high, low, doc, sig, at, words in rows:
                if first is None or (high, low) != first[:2]:
                    first = high, low, doc, sig, at
                hashes = np.frombuffer(words.as_buffer(), np.uint64)
                if doc != first[2]:
                    again.append((doc, sig, at, *first[2:], len(hashes)))
                    continue
                n = len(hashes) - window + 1
                parts.append((np.full(n, doc), np.full(n, sig), at + np.arange(n), np.lib.stride_tricks.sliding_window_view(hashes, window)))
                held += n
                if held >= TASK_ROWS:
                    yield from flush(*(np.concatenate(x) for x in zip(*parts)))
                    parts, held = [], 0
                    release_memory()
            if again:
                columns = np.array(again, dtype=np.int64).T
                yield _entry_batch(*columns[:3], columns[6], first=columns[3:6])
            release_memory()
        if held:
            yield from flush(*(np.concatenate(x) for x in zip(*parts)))

    return run


def _entry_batch(doc, sig, at, length, *, key=None, high=None, low=None, words=None, first=None) -> pa.RecordBatch:
    n = len(doc)
    column = lambda x, kind: pa.nulls(n, kind) if x is None else pa.array(x).cast(kind)
    first_doc, first_sig, first_at = (None, None, None) if first is None else first
    return pa.RecordBatch.from_arrays(
        [column(key, pa.int64()), pa.array(np.full(n, first is not None)), column(doc, pa.int64()), column(sig, pa.int64()),
         column(at, pa.int32()), column(np.broadcast_to(length, n), pa.int32()), column(first_doc, pa.int64()), column(first_sig, pa.int64()),
         column(first_at, pa.int32()), column(high, pa.int64()), column(low, pa.int64()), pa.nulls(n, pa.binary()) if words is None else words],
        names=["key", "done", *_PASSAGE, "high", "low", "words"],
    )


def _chains(doc, sig, at, first_doc, first_sig, first_at, length) -> tuple[np.ndarray, ...]:
    """Repeats joined where one goes on as the other: both sides move on by the same number of words."""
    order = np.lexsort((at, at - first_at, first_sig, first_doc, sig, doc))
    doc, sig, at, first_doc, first_sig, first_at, length = (x[order] for x in (doc, sig, at, first_doc, first_sig, first_at, length))
    on = _same_as_before(doc, sig, first_doc, first_sig, at - first_at)
    on[1:] &= at[1:] <= at[:-1] + length[:-1]
    head = np.flatnonzero(~on)
    end = np.maximum.reduceat(at + length, head) if len(head) else head
    return doc[head], sig[head], at[head], first_doc[head], first_sig[head], first_at[head], end - at[head]


_PASSAGE = ["doc", "sig", "at", "length", "first_doc", "first_sig", "first_at"]
_REPEAT = "doc bigint, sig bigint, at int, length int, first_doc bigint, first_sig bigint, first_at int"


def _subtrees(window: int):
    """Repeats (_PASSAGE) from leaves in order, and those that are done."""
    size = window * _PART

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, first = None, None  # the last leaf, and the first leaf of its node
        for batch in batches:
            done = np.asarray(batch.column("done"))
            if done.any():
                yield batch.select(_PASSAGE).filter(pa.array(done))
                batch = batch.filter(pa.array(~done))
            n = len(batch)
            if not n:
                continue
            high, doc, sig, at = (np.asarray(batch.column(c)) for c in ("high", "doc", "sig", "at"))
            binary = batch.column("words")
            begin = int(np.frombuffer(binary.buffers()[1], np.int32, 1, 4 * binary.offset)[0])
            words = np.frombuffer(binary.buffers()[2], np.uint8, n * size, begin).reshape(n, window, _PART)
            # the length of the common prefix with the leaf before
            unlike = np.ones((n, window + 1), dtype=bool)
            unlike[1:, :window] = (words[1:] != words[:-1]).any(axis=2)
            if before is not None:
                unlike[0, :window] = (words[0] != before[1]).any(axis=1)
            common = unlike.argmax(axis=1)
            whole = common == window
            whole[1:] &= high[1:] == high[:-1]
            whole[0] &= before is not None and high[0] == before[0]
            # leaves below one node of depth `window` or more
            head = np.flatnonzero(~whole)
            node = np.cumsum(~whole) - 1
            firsts = [np.where(node < 0, first[i] if first else 0, x[head[node]] if len(head) else 0) for i, x in enumerate((doc, sig, at))]
            again = doc > firsts[0]
            if again.any():
                found = _chains(*(x[again] for x in (doc, sig, at, *firsts)), np.full(int(again.sum()), window))
                yield _repeat_batch(*found)
            before = int(high[-1]), words[-1].copy()
            first = [int(x[-1]) for x in firsts]
            release_memory()

    return run


def _repeat_batch(doc, sig, at, first_doc, first_sig, first_at, length) -> pa.RecordBatch:
    wide, narrow = (lambda x: pa.array(x, pa.int64())), (lambda x: pa.array(x.astype(np.int32), pa.int32()))
    return pa.RecordBatch.from_arrays(
        [wide(doc), wide(sig), narrow(at), narrow(length), wide(first_doc), wide(first_sig), narrow(first_at)], names=_PASSAGE
    )


def packed(docs: DataFrame) -> DataFrame:
    """`docs` with `text` as compressed bytes, to travel through a shuffle by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in (whole.slice(at, BATCH_TEXTS) for whole in batches for at in range(0, len(whole), BATCH_TEXTS)):
            texts = pc.fill_null(batch.column("text"), "").cast(pa.binary())
            small = pa.array([pack.compress(x.as_py()) for x in texts], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [small if c == "text" else batch.column(c) for c in batch.schema.names], names=batch.schema.names
            )
            release_memory()

    schema = ", ".join(
        f"`{f.name}` {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema
    )
    return docs.mapInArrow(run, schema)


def packed_slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) for parts of packed texts of about SLICE_BYTES, or one longer text."""
    unpack = zstandard.ZstdDecompressor()
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append(unpack.decompress(text.as_py()))
        size += len(held[-1])
        if size >= SLICE_BYTES:
            yield first, pa.array(held, pa.large_binary())
            first, held, size = i + 1, [], 0
    if held:
        yield first, pa.array(held, pa.large_binary())


def _frequent(sample: DataFrame, window: int, prefix: int, least: int) -> dict[int, np.ndarray]:
    """By length, the keys of the prefixes that at least `least` suffixes of the sample start with."""
    keys = sample.mapInArrow(_sampled_prefixes(window, prefix), "length int, key bigint, whole bigint")
    found: dict[int, list[int]] = {}
    counted = keys.distinct().groupBy("length", "key").agg(F.count("*").alias("n"))
    for r in counted.filter(F.col("n") >= least).collect():
        found.setdefault(r["length"], []).append(r["key"])
    return {n: np.array(sorted(x), dtype=np.int64) for n, x in found.items()}


def repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc, sig, at, length, first_doc, first_sig, first_at): passages of (doc_id, sig, text) that start in a smaller doc_id too.

    `at` counts words from 0; the passages found cover every window that repeats.  doc_id must not be
    NULL; `sig` tells rows of the same doc_id apart.
    """
    spark = docs.sparkSession
    probes = docs.select("doc_id", "text").mapInArrow(_probes(window, prefix), "doc bigint, anchor bigint, known boolean")
    # rows that need no answer are dealt by document, so that no run gathers them
    place = F.when(F.col("known"), F.xxhash64("doc")).otherwise(F.col("anchor"))
    answers = probes.repartition(place).sortWithinPartitions("known", "anchor").mapInArrow(_answers, "doc bigint, anchor bigint")
    # no more entries than the document has words
    asked = stored(answers.groupBy("doc").agg(F.collect_set("anchor").alias("anchors")), "asked")

    def told(some: DataFrame) -> DataFrame:
        wanted = asked.select(F.col("doc").alias("asked"), "anchors")
        carried = packed(some)
        return carried.join(wanted, carried["doc_id"] == wanted["asked"]).select("doc_id", "sig", "text", "anchors")

    size = asked.agg(F.count("*").alias("docs"), F.sum(F.size("anchors")).alias("runs")).first()
    frequent: dict[int, np.ndarray] = {}
    if (size["runs"] or 0) * (window - prefix + 1) > group_rows:
        share = max(1, size["docs"] // SAMPLE_DOCS)
        sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0) if share > 1 else docs
        frequent = _frequent(told(sample), window, prefix, max(group_rows // share, 16 if share > 1 else 1))
    # done rows are dealt by document, all others by what has to meet
    def met(rows: DataFrame) -> DataFrame:
        return rows.repartition(F.when(F.col("done"), F.xxhash64("doc")).otherwise(F.xxhash64("key")))

    plan = spark.sparkContext.broadcast(frequent)
    stretches = met(told(docs).mapInArrow(_stretches(window, prefix, plan), _ENTRY)).sortWithinPartitions("done", "key", "high", "low", "doc")
    entries = stretches.mapInArrow(_entries(window, prefix, plan), _ENTRY).drop("low")
    leaves = met(entries).sortWithinPartitions("done", "words", "high", "doc", "at")
    return stored(leaves.mapInArrow(_subtrees(window), _REPEAT), "repeats")


def _maximal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        passages = batch.column("passages")
        owner = np.repeat(np.arange(len(passages)), np.diff(np.asarray(passages.offsets)))
        flat = passages.flatten()
        at, first_doc, first_sig, first_at, length = (np.asarray(flat.field(c)) for c in ("at", "first_doc", "first_sig", "first_at", "length"))
        doc, sig = (np.asarray(batch.column(c))[owner] for c in ("doc", "sig"))
        yield _repeat_batch(*_chains(doc, sig, at, first_doc, first_sig, first_at, length))


def maximal_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, first_doc, first_start): every passage of `window` words or more that a document
    shares with one of smaller doc_id, each as long as both go on alike.

    A window is told against the first document that has it; where that changes, a passage ends and the
    next begins, possibly before its end.  Rows and NULLs are taken as `remove_repeats` says.
    """
    found = repeats(_rows(docs).filter("doc_id IS NOT NULL").select("doc_id", "sig", "text"), window)
    # window by window: what a task found repeats a leaf that the tree may have told to repeat in turn
    step = found.select("*", F.explode(F.expr(f"sequence(0, length - {window})")).alias("i"))
    each = step.select("doc", "sig", (F.col("at") + F.col("i")).alias("at"), "first_doc", "first_sig", (F.col("first_at") + F.col("i")).alias("first_at"))
    on = each.select(*[F.col(a).alias(b) for a, b in (("doc", "d"), ("sig", "s"), ("at", "a"), ("first_doc", "fd"), ("first_sig", "fs"), ("first_at", "fa"))])
    # of a leaf told several times the smallest
    on = on.groupBy("d", "s", "a").agg(F.min(F.struct("fd", "fs", "fa")).alias("f"))
    told = each.join(on, F.expr("first_doc = d AND first_sig = s AND first_at = a"), "left")
    best = F.min(F.struct(*[F.coalesce(f"f.{a}", b).alias(b) for a, b in (("fd", "first_doc"), ("fs", "first_sig"), ("fa", "first_at"))])).alias("p")
    firsts = told.groupBy("doc", "sig", "at").agg(best).select("doc", "sig", "at", F.lit(window).alias("length"), "p.*")
    listed = firsts.groupBy("doc", "sig").agg(F.collect_list(F.struct("at", "length", "first_doc", "first_sig", "first_at")).alias("passages"))
    return listed.mapInArrow(_maximal, _REPEAT).select(
        F.col("doc").alias("doc_id"), F.col("at").alias("start"), "length", "first_doc", F.col("first_at").alias("first_start")
    )


def _cut(others: list[str], as_is: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in (whole.slice(at, BATCH_TEXTS) for whole in batches for at in range(0, len(whole), BATCH_TEXTS)):
            total, removed, kept = [], [], []
            for text, passages in zip(batch.column("text"), batch.column("passages")):
                whole = unpack.decompress(text.as_py())
                words = whole.split()
                total.append(len(words))
                if not (passages.is_valid and len(passages)):
                    removed.append(0)
                    kept.append(whole if as_is else b" ".join(words))
                    continue
                begin, length = (np.asarray(passages.values.field(c)) for c in ("at", "length"))
                change = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(change, begin, 1)
                np.add.at(change, begin + length, -1)
                stay = np.flatnonzero(np.cumsum(change[:-1]) == 0)
                removed.append(len(words) - len(stay))
                kept.append(b" ".join([words[i] for i in stay.tolist()]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in others), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())],
                names=[*others, "n_words", "n_removed", "kept_text"],
            )
            release_memory()

    return run


def _rows(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, *keep, sig); `sig` tells rows of a repeated doc_id apart by their text, elsewhere it is 0."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *keep)
    # a written table, so its size is known; mostly it has no row
    twice = stored(rows.groupBy(F.col("doc_id").alias("twice")).agg(F.count("*").alias("n")).filter("n > 1").select("twice"), "repeated-ids")
    told = rows.join(twice, F.col("doc_id") == F.col("twice"), "left")
    return told.select(*rows.columns, F.when(F.col("twice").isNull(), F.lit(0).cast("bigint")).otherwise(F.xxhash64("text")).alias("sig"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = (), as_is: bool = False) -> DataFrame:
    """(doc_id, *keep, n_words, n_removed, kept_text) of every row of `docs`.

    Each word that lies in a window of `window` words whose sequence also starts in a document of
    smaller doc_id goes; windows are judged on the input.  kept_text is the words that stay, joined
    by one space (with `as_is`, the text itself where no word goes).  NULL text has no words.  A row with a
    NULL doc_id has no place in the order: it loses nothing and nothing is lost to it.  Rows with the same
    doc_id are judged one by one and never against each other.  An empty table gives an empty result.
    """
    rows = _rows(docs, keep)
    named = rows.filter("doc_id IS NOT NULL")
    found = repeats(named.select("doc_id", "sig", "text"), window)
    listed = found.groupBy(F.col("doc").alias("_doc"), F.col("sig").alias("_sig")).agg(F.collect_set(F.struct("at", "length")).alias("passages"))
    carried = packed(named)
    judged = carried.join(listed, (carried["doc_id"] == listed["_doc"]) & (carried["sig"] == listed["_sig"]), "left").select(*rows.columns, "passages")
    unnamed = packed(rows.filter("doc_id IS NULL")).withColumn("passages", F.lit(None).cast("array<struct<at:int,length:int>>"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    others = ["doc_id", *keep]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in others), "n_words bigint", "n_removed bigint", "kept_text string"])
    return judged.union(unnamed).mapInArrow(_cut(others, as_is), schema)


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """All rows of `docs` with their columns; `text` without its repeats, `n_chars` its new length.

    Texts that lose nothing stay as they are; one that loses all becomes empty.
    """
    inner = {c: f"_c{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    plain = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(n) for c, n in inner.items()])
    cut = remove_repeats(plain, window, tuple(inner.values()), as_is=True)
    changed = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("bigint")}
    return cut.select(*[changed.get(c, F.col(inner.get(c, c))).alias(c) for c in docs.columns])
