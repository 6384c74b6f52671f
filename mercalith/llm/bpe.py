"""Byte-pair encoding by a segment tree over the ranks of adjacent pairs, and decoding.

The leaves of the tree are the pairs of neighbouring symbols in order; a leaf holds
`rank * 2**32 + position`, or NONE if the vocabulary has no such merge, an inner node the smaller
of its two children.  The root is therefore the leftmost pair of lowest rank.  One merge changes at
most three leaves (the pair itself and its two neighbours), each a point update of logarithmic
cost, and merging ends when the root is NONE.

Short pieces are merged many at a time: pieces with the same number of leaves form one array of
trees and every step takes the root merge of each of them.  Pieces of more than LONG_BYTES bytes
are merged one by one by the same tree, so a text of one endless word costs n log n.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercalith.llm.common import ids_bytes, tokenizer_file
from mercalith.llm.pieces import PieceEncoder, pack

VOCABULARY = "byte_bpe_50k.json"
LONG_BYTES = 64
NONE = np.int64(2**62)
_POSITION = np.int64(2**32 - 1)
BATCH_PIECES = 1 << 14
# this operator runs beside others in one worker, so it remembers less than it could
CACHE_ENTRIES = 250_000
GROUP_BYTES = 4_000_000
ROWS_AT_ONCE = 512


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary file.

    Printable Latin-1 bytes stand for themselves; the others take the code points from 256 on in
    order.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """Merges and tokens of a byte-level BPE file."""

    def __init__(self, name: str = VOCABULARY):
        with open(tokenizer_file(name), encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        letter = byte_letters()
        byte_of = {c: b for b, c in letter.items()}
        self.byte_id = np.array([ids[letter[b]] for b in range(256)], dtype=np.int64)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes: dict[int, bytes] = {
            i: bytes(byte_of[c] for c in token) for token, i in ids.items()
        }
        self.token_bytes |= {i: s.encode() for s, i in self.specials.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        self._table()

    def _table(self) -> None:
        """An open-addressed hash table of the merges, so whole arrays of pairs are looked up."""
        slots = 1 << (len(self.merges) * 4 - 1).bit_length()
        self.shift = np.uint64(64 - slots.bit_length() + 1)
        pairs = np.array([(a << 32) | b for a, b in self.merges], dtype=np.int64)
        values = np.array(list(self.merges.values()), dtype=np.int64).reshape(-1, 2)
        self.keys = np.full(slots, -1, dtype=np.int64)
        self.ranks = np.full(slots, -1, dtype=np.int64)
        self.merged = np.zeros(slots, dtype=np.int64)
        self.mask = slots - 1
        self.probes = 1
        for pair, at, (rank, new) in zip(pairs.tolist(), self._slot(pairs).tolist(), values.tolist()):
            probe = 1
            while self.keys[at] >= 0:
                at, probe = (at + 1) & self.mask, probe + 1
            self.keys[at], self.ranks[at], self.merged[at] = pair, rank, new
            self.probes = max(self.probes, probe)

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The table slot of each pair's merge, -1 where there is none (or a symbol is missing)."""
        pairs = (left << 32) | right
        at = self._slot(pairs)
        found = np.full(len(pairs), -1, dtype=np.int64)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        for _ in range(self.probes):
            here = self.keys[at[open_]]
            hit = here == pairs[open_]
            found[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit & (here >= 0)]
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self.mask
        return found


def merge_long(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """The symbols after all merges of one piece, by a segment tree over its pairs."""
    n = len(symbols)
    if n < 2:
        return symbols
    none = int(NONE)
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [none] * (2 * size)
    for i in range(n - 1):
        m = merges.get((symbols[i], symbols[i + 1]))
        if m:
            tree[size + i] = (m[0] << 32) | i
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def update(i: int) -> None:
        value = none
        if after[i] < n:
            m = merges.get((symbols[i], symbols[after[i]]))
            if m:
                value = (m[0] << 32) | i
        k = size + i
        tree[k] = value
        while k > 1:
            k >>= 1
            low = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == low:
                break
            tree[k] = low

    while tree[1] != none:
        i = tree[1] & 0xFFFFFFFF
        j = after[i]
        symbols[i] = merges[(symbols[i], symbols[j])][1]
        symbols[j] = -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        if j < n - 1:
            k = size + j
            if tree[k] != none:
                tree[k] = none
                while k > 1:
                    k >>= 1
                    tree[k] = min(tree[2 * k], tree[2 * k + 1])
        update(i)
        if before[i] >= 0:
            update(before[i])
    return [s for s in symbols if s >= 0]


def merge_short(symbols: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Merge every row of `symbols` (rows of equal width, -1 beyond a piece's end) to its end."""
    count, width = symbols.shape
    size = 1 << max(0, (width - 2).bit_length())
    # one flat array of `count` trees; the root of tree t is at t * 2 * size + 1
    tree = np.full((count, 2 * size), NONE, dtype=np.int64)
    base = np.arange(count, dtype=np.int64) * (2 * size)
    found = vocabulary.find(symbols[:, :-1].ravel(), symbols[:, 1:].ravel())
    where = np.tile(np.arange(width - 1, dtype=np.int64), count)
    leaf = np.where(found >= 0, (vocabulary.ranks[found] << 32) | where, NONE)
    tree[:, size : size + width - 1] = leaf.reshape(count, width - 1)
    for k in range(size - 1, 0, -1):
        np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
    flat = tree.ravel()
    line = np.arange(count, dtype=np.int64) * width
    # neighbours that are still there; `width` and -1 stand for none
    after = np.tile(np.arange(1, width + 1, dtype=np.int64), count)
    before = np.tile(np.arange(-1, width - 1, dtype=np.int64), count)
    cell = symbols.ravel()

    def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        k = size + at
        flat[base[rows] + k] = value
        while size > 1:
            k = k >> 1
            b = base[rows]
            flat[b + k] = np.minimum(flat[b + 2 * k], flat[b + 2 * k + 1])
            if k[0] == 1:
                break

    def pair(rows: np.ndarray, at: np.ndarray) -> None:
        then = after[line[rows] + at]
        there = then < width
        right = np.full(len(rows), -1, dtype=np.int64)
        right[there] = cell[line[rows[there]] + then[there]]
        slot = vocabulary.find(cell[line[rows] + at], right)
        put(rows, at, np.where(slot >= 0, (vocabulary.ranks[slot] << 32) | at, NONE))

    rows = np.flatnonzero(flat[base + 1] != NONE)
    while len(rows):
        i = flat[base[rows] + 1] & _POSITION
        j = after[line[rows] + i]
        left, right = line[rows] + i, line[rows] + j
        slot = vocabulary.find(cell[left], cell[right])
        cell[left] = vocabulary.merged[slot]
        cell[right] = -1
        after[left] = after[right]
        more = after[left] < width
        before[line[rows[more]] + after[left[more]]] = i[more]
        gone = j < width - 1
        if gone.any():
            put(rows[gone], j[gone], np.full(int(gone.sum()), NONE))
        pair(rows, i)
        prev = before[left]
        has = prev >= 0
        if has.any():
            pair(rows[has], prev[has])
        rows = rows[flat[base[rows] + 1] != NONE]
    return cell.reshape(count, width)


def encode_pieces(tokens: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pre-tokens joined, and where those of each one start (and the last one ends)."""
    length = np.fromiter(map(len, tokens), np.int64, len(tokens))
    start = np.concatenate([[0], np.cumsum(length)])
    symbol = vocabulary.byte_id[np.frombuffer(b"".join(tokens), dtype=np.uint8)]
    # every pre-token is merged in its own place; -1 marks the places that merging frees
    for i in np.flatnonzero(length > LONG_BYTES):
        merged = merge_long(symbol[start[i] : start[i + 1]].tolist(), vocabulary.merges)
        symbol[start[i] : start[i + 1]] = -1
        symbol[start[i] : start[i] + len(merged)] = merged
    # widths of 2, 3, 5, 9, .. symbols have trees of 1, 2, 4, 8, .. leaves
    low, width = 1, 2
    while low < LONG_BYTES:
        chosen = np.flatnonzero((length > low) & (length <= min(width, LONG_BYTES)))
        for part in range(0, len(chosen), BATCH_PIECES):
            some = chosen[part : part + BATCH_PIECES]
            inside = np.arange(width) < length[some][:, None]
            place = (start[some][:, None] + np.arange(width))[inside]
            rows = np.full(inside.shape, -1, dtype=np.int64)
            rows[inside] = symbol[place]
            symbol[place] = merge_short(rows, vocabulary)[inside]
        low, width = width, 2 * width - 1
    keep = symbol >= 0
    return symbol[keep].astype("<u4"), np.concatenate([[0], np.cumsum(keep)])[start]


class Bpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, name: str = VOCABULARY):
        import regex

        self.vocabulary = Vocabulary(name)
        # how the vocabulary splits text before merging: a fixed pattern
        self.split = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
            r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
        )
        self.pieces = PieceEncoder(self._encode_many, self.vocabulary.specials, CACHE_ENTRIES, GROUP_BYTES)
        size = max(self.vocabulary.token_bytes) + 1
        self.token = [self.vocabulary.token_bytes.get(i, b"") for i in range(size)]

    def _encode_many(self, pieces: list[str]) -> list[bytes]:
        parts = [self.split.findall(x) for x in pieces]
        tokens = [t.encode() for p in parts for t in p]
        ids, ends = encode_pieces(tokens, self.vocabulary)
        return pack(ids, ends[np.cumsum([0, *map(len, parts)])])

    def encode_texts(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text as an array of unsigned 32-bit integers; NULL is empty."""
        return self.pieces.encode_texts(texts)

    def decode(self, ids: np.ndarray) -> str:
        """Special tokens are kept, unknown ids skipped; what is no UTF-8 becomes U+FFFD."""
        if len(ids) and int(ids.max()) >= len(self.token):
            ids = ids[ids < len(self.token)]
        return b"".join(map(self.token.__getitem__, ids.tolist())).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def bpe(name: str = VOCABULARY) -> Bpe:
    """One instance per worker process; its cache lives as long as the worker."""
    return Bpe(name)


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """Encode `text` and decode it again: doc_id, n_tokens, ids_sha256 and decoded_sha256.

    With `with_ids` also token_ids array<int>.

    NULL text counts as empty; an empty text has no ids.  Rows are independent: repeated rows,
    NULL ids and further columns (also ones named like the new ones) change nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(vocabulary)
        for batch in batches:
            for at in range(0, len(batch), ROWS_AT_ONCE):
                yield encode(coder, batch.slice(at, ROWS_AT_ONCE))
            pa.default_memory_pool().release_unused()

    def encode(coder: Bpe, batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, lists = [], []
        for ids in coder.encode_texts(batch.column("text")):
            decoded = coder.decode(ids).encode("utf-8")
            packed = ids_bytes(ids)
            if with_ids:
                lists.append(ids.astype(np.int32))
            rows.append((len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded).hexdigest()))
        n, a, b = zip(*rows)
        columns = {
            "doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()),
            "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string()),
        }
        if with_ids:
            columns["token_ids"] = pa.array(lists, pa.list_(pa.int32()))
        return pa.RecordBatch.from_pydict(columns)

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += ", token_ids array<int>" if with_ids else ""
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, schema)
