"""Token ids of documents in binary shards with a keyed index, written and read back by Spark.

A store is a dataset of shards in key order.  One shard is one row: the raw ids of its documents
one after the other (`payload`, little-endian, 16 bits an id where the vocabulary allows it), where
each document begins (`begins`), and an index by which a key is found in constant time: a minimal
perfect hash (`levels`, `bits`) gives the key's slot, the slot holds a fingerprint of the key (to
refuse keys that are not there) and the number of its first document and how many there are.
`keys` lists the keys in order; only a scan of the whole store reads that column.

Shards are made in one pass behind a range exchange of the documents; numbers that depend on what
comes before (`start`) are sums over partitions, of which there are a bounded number.  Everything
goes through Spark's own writer, so a store can live wherever Spark can write and a lost executor
leaves no half-written shard.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mercalith.llm.common import ids_bytes, scratch_path, tokenizer_file
from mercalith.llm.perfect_hash import MinimalPerfectHash, fingerprint
from mercalith.llm.pieces import WHITE, PieceEncoder, pack

SHARD_IDS = 1_000_000
BATCH_PIECES = 8192
LINE_PIECES = 512
BATCH_LINES = 16
END_ID = 2
WANTED_KEYS = 50_000

# white space behind a piece's first character, and white space as its first but for the space
_INSIDE = re.compile(f"[{WHITE}]").search

SCHEMA = (
    "part int, seq int, first_key bigint, last_key bigint, n_docs bigint, n_null_keys bigint, "
    "n_ids bigint, local_start bigint, width int, keys binary, levels binary, bits binary, "
    "fingerprints binary, slot_doc binary, slot_copies binary, begins binary, payload binary"
)


@lru_cache(maxsize=2)
def library_encoder(name: str) -> PieceEncoder:
    """Encodes with the tokenizers library, each distinct piece of text once."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file(name))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    specials = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}

    (line_end,) = tokenizer.encode("\n", add_special_tokens=False).ids

    def encode_lines(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many each piece has) of pieces without white space but for a first space.

        They are handed over as lines: the pre-tokenizer keeps a line end apart from what stands around it.
        """
        lines = ["\n".join(pieces[at : at + LINE_PIECES]) for at in range(0, len(pieces), LINE_PIECES)]
        found = []
        for at in range(0, len(lines), BATCH_LINES):  # the library's results are large objects
            for e in tokenizer.encode_batch_fast(lines[at : at + BATCH_LINES], add_special_tokens=False):
                found += [np.array(e.ids, dtype=np.uint32), np.array([line_end], dtype=np.uint32)]
        ids = np.concatenate(found)
        ends = np.flatnonzero(ids == line_end)
        return ids[ids != line_end], np.diff(ends, prepend=-1) - 1

    def encode_many(pieces: list[str]) -> list[bytes]:
        inside = [_INSIDE(x, 1) is not None or x in (" ", "") for x in pieces]
        plain = [x for x, odd in zip(pieces, inside) if not odd]
        flat, lengths = encode_lines(plain) if plain else (np.empty(0, np.uint32), np.empty(0, np.int64))
        packed = iter(pack(flat, np.concatenate([[0], np.cumsum(lengths)])))
        odd = [x for x, is_odd in zip(pieces, inside) if is_odd]
        alone: list[bytes] = []
        for at in range(0, len(odd), BATCH_PIECES):
            batch = tokenizer.encode_batch_fast(odd[at : at + BATCH_PIECES], add_special_tokens=False)
            alone += [ids_bytes(e.ids) for e in batch]
        others = iter(alone)
        return [next(others) if is_odd else next(packed) for is_odd in inside]

    encoder = PieceEncoder(encode_many, specials)
    encoder.vocabulary_size = tokenizer.get_vocab_size(with_added_tokens=True)
    return encoder


class _Shard:
    """Documents gathered for one shard."""

    def __init__(self):
        self.keys: list[int | None] = []
        self.ids: list[np.ndarray] = []
        self.total = 0

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.ids.append(ids)
        self.total += len(ids)

    def row(self, part: int, seq: int, start: int, width: int) -> dict:
        null = sum(k is None for k in self.keys)  # NULL keys come first
        keys = np.array(self.keys[null:], dtype=np.int64)
        distinct, first, copies = np.unique(keys, return_index=True, return_counts=True)
        index = MinimalPerfectHash.build(distinct.view(np.uint64))
        slot = index.lookup(distinct.view(np.uint64))
        fingerprints = np.zeros(len(distinct), "<u4")
        slot_doc, slot_copies = np.zeros(len(distinct), "<i8"), np.zeros(len(distinct), "<i8")
        fingerprints[slot] = fingerprint(distinct.view(np.uint64))
        slot_doc[slot], slot_copies[slot] = first + null, copies
        begins = np.concatenate([[0], np.cumsum([len(x) for x in self.ids])]).astype("<i8")
        return {
            "part": part, "seq": seq,
            "first_key": int(keys[0]) if len(keys) else None,
            "last_key": int(keys[-1]) if len(keys) else None,
            "n_docs": len(self.keys), "n_null_keys": null, "n_ids": self.total,
            "local_start": start, "width": width, "keys": keys.astype("<i8").tobytes(),
            "levels": index.sizes.tobytes(), "bits": index.bits.tobytes(),
            "fingerprints": fingerprints.tobytes(), "slot_doc": slot_doc.tobytes(),
            "slot_copies": slot_copies.tobytes(), "begins": begins.tobytes(),
            "payload": np.concatenate(self.ids).astype(f"<u{width}").tobytes(),
        }


_ARROW = pa.schema(
    [
        (n, {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}[t])
        for n, t in (x.split(" ") for x in SCHEMA.split(", "))
    ]
)


def write_store(docs: DataFrame, path: str, vocabulary: str = "byte_bpe_50k.json", end_id: int = END_ID) -> str:
    """Encode `text` of (doc_id, text) and write a store in ascending doc_id order; NULL is empty.

    Every document is followed by `end_id`.  A NULL doc_id comes first and is found by scans only;
    documents with the same doc_id stand together, ordered by a hash of their text.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(vocabulary)
        width = 2 if max(encoder.vocabulary_size, end_id) <= 1 << 16 else 4
        part, seq, start, shard = TaskContext.get().partitionId(), 0, 0, _Shard()
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for key, ids in zip(keys, encoder.encode_texts(batch.column("text"))):
                shard.add(key, np.concatenate([ids, end]))
                if shard.total >= SHARD_IDS:
                    yield pa.RecordBatch.from_pylist([shard.row(part, seq, start, width)], _ARROW)
                    start, seq, shard = start + shard.total, seq + 1, _Shard()
        if shard.keys:
            yield pa.RecordBatch.from_pylist([shard.row(part, seq, start, width)], _ARROW)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the last two columns split a key that very many rows share
    tie = [F.xxhash64("text"), F.monotonically_increasing_id()]
    ordered = (
        rows.withColumn("tie", tie[0]).withColumn("row", tie[1])
        .repartitionByRange("doc_id", "tie", "row")
        .sortWithinPartitions("doc_id", "tie", "row")
        .select("doc_id", "text")
    )
    ordered.mapInArrow(shards, SCHEMA).write.parquet(path)
    return path


def _starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, part_start): ids in all earlier partitions.  One row per partition of the writer."""
    totals = read_shards(spark, path).groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


class _Reader:
    """One shard opened for reading."""

    def __init__(self, row: dict):
        self.payload = np.frombuffer(row["payload"], f"<u{row['width']}")
        self.begins = np.frombuffer(row["begins"], "<i8")
        self.index = MinimalPerfectHash(np.frombuffer(row["levels"], "<i8"), np.frombuffer(row["bits"], "<u8"))
        self.fingerprints = np.frombuffer(row["fingerprints"], "<u4")
        self.slot_doc = np.frombuffer(row["slot_doc"], "<i8")
        self.slot_copies = np.frombuffer(row["slot_copies"], "<i8")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first document of each key and how many it has (0: not here)."""
        slot = self.index.lookup(keys.view(np.uint64))
        here = slot >= 0
        here[here] = self.fingerprints[slot[here]] == fingerprint(keys[here].view(np.uint64))
        first, copies = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        first[here], copies[here] = self.slot_doc[slot[here]], self.slot_copies[slot[here]]
        return first, copies

    def ids(self, doc: int) -> np.ndarray:
        return self.payload[self.begins[doc] : self.begins[doc + 1]]


def scan_store(spark: SparkSession, path: str) -> DataFrame:
    """Every document by its key through the index: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = _Reader(row)
                keys = np.unique(np.frombuffer(row["keys"], "<i8"))
                first, copies = shard.find(keys)
                doc_ids: list[int | None] = [None] * row["n_null_keys"]
                numbers = list(range(row["n_null_keys"]))
                for key, a, n in zip(keys.tolist(), first.tolist(), copies.tolist()):
                    doc_ids += [key] * n
                    numbers += range(a, a + n)
                start = row["part_start"] + row["local_start"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()),
                        pa.array([start + int(shard.begins[d]) for d in numbers], pa.int64()),
                        pa.array([int(shard.begins[d + 1] - shard.begins[d]) for d in numbers], pa.int64()),
                        pa.array([zlib.crc32(ids_bytes(shard.ids(d))) for d in numbers], pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # one row per partition of the writer: a bounded table
    shards = read_shards(spark, path).join(F.broadcast(_starts(spark, path)), "part")
    return shards.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """(doc_id, copy, token_ids) for the non-NULL `doc_id` of `keys` that are in the store.

    A key goes to the writer partitions whose range holds it (their bounds are a table of bounded
    size), from there to the shard, and is found by the shard's index without reading its keys.  Keys
    that are not there cost a look at one shard each; a shard is asked for WANTED_KEYS at a time.
    """
    bounds = (
        read_shards(spark, path).groupBy("part")
        .agg(F.min("first_key").alias("low"), F.max("last_key").alias("high"))
        .filter("low IS NOT NULL").orderBy("part").collect()
    )
    low, high = np.array([r.low for r in bounds]), np.array([r.high for r in bounds])
    parts = np.array([r.part for r in bounds])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.asarray(batch.column("doc_id"))
            begin, end = np.searchsorted(high, key, "left"), np.searchsorted(low, key, "right")
            n = np.maximum(end - begin, 0)
            at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(key, n), pa.int64()), pa.array(parts[at] if len(at) else [], pa.int32())],
                names=["doc_id", "part"],
            )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard, wanted = _Reader(row), np.array(row["wanted"], dtype=np.int64)
                first, copies = shard.find(wanted)
                got = [
                    (k, c, shard.ids(a + c).astype(np.int32))
                    for k, a, n in zip(wanted.tolist(), first.tolist(), copies.tolist())
                    for c in range(n)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[0] for x in got], pa.int64()),
                        pa.array([x[1] for x in got], pa.int32()),
                        pa.array([x[2] for x in got], pa.list_(pa.int32())),
                    ],
                    names=["doc_id", "copy", "token_ids"],
                )

    asked = keys.select(F.col("doc_id").cast("bigint")).filter("doc_id IS NOT NULL").distinct()
    ranges = read_shards(spark, path).select("part", "seq", "first_key", "last_key")
    per_shard = (
        asked.mapInArrow(places, "doc_id bigint, part int").join(ranges, "part")
        .filter("doc_id BETWEEN first_key AND last_key")
    )
    # lists of about WANTED_KEYS, however many keys are asked for in the range of one shard
    asked_of = per_shard.groupBy("part", "seq").agg(F.ceil(F.count("*") / WANTED_KEYS).alias("lists"))
    group = F.pmod(F.xxhash64("doc_id"), F.col("lists"))
    per_shard = (
        per_shard.join(asked_of, ["part", "seq"]).groupBy("part", "seq", group.alias("list"))
        .agg(F.collect_list("doc_id").alias("wanted")).drop("list")
    )
    return (
        read_shards(spark, path).drop("keys").join(per_shard, ["part", "seq"])
        .mapInArrow(find, "doc_id bigint, copy int, token_ids array<int>")
    )


def store_digest(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """Write a store of `docs` in the shared folder and read every document back from it."""
    spark = docs.sparkSession
    return scan_store(spark, write_store(docs, scratch_path(spark, "tokens"), vocabulary))
