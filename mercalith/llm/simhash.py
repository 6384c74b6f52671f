"""SimHash near-duplicates: fingerprints, Golay-code keys, verified links, components.

Fingerprints of 64 bits that differ in at most two bits are linked.  A fingerprint is cut into three
segments (22, 21 and 21 bits).  Two errors over three segments leave, for some segment i, no error
in i and at most one in the segment after it (cyclically): with errors (e1, e2, e3), e3 = 0 and
e1 <= 1, or e1 = 0 and e2 <= 1, or e2 = 0 and e3 <= 1 holds whenever their sum is at most 2.  So a
key is one segment as it is together with a fuzzy key of the next one that survives one error.

The fuzzy keys come from the perfect binary Golay code of length 23, where every word is within
three bits of exactly one codeword.  A word gets the index of its codeword; if it lies at distance
three, it also gets the five codewords that its neighbours would be decoded to.  Two words that
differ in one bit then share an index: either both decode to the same codeword, or each of them
lies at distance three from its own and has the other's among its five.

Only distinct fingerprints are compared, so copies cost nothing.  Keys that few fingerprints share
are joined and every pair is verified.  The members of a frequent key, where a join would form all
pairs, are compared in another exact way: two fingerprints differ in at most two bits exactly if
some word is within one bit of both, so every member is listed under itself and its 64 neighbours,
and each such list is linked to its smallest member.  No pair is lost and no list of pairs formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercalith.llm.common import stored
from mercalith.llm.components import components

SHINGLE = 3
MAX_BITS = 2
SEED = 42
FREQUENT_KEY = 24
_BATCH_TEXTS = 256

# generator polynomial of the Golay code of length 23 (a fixed value): x^11+x^9+x^7+x^6+x^5+x+1
GOLAY = 0b101011100011
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # (shift, width), most significant first


def _remainder(word: np.ndarray) -> np.ndarray:
    """The syndrome (remainder by the generator) of 23-bit words."""
    rest = word.copy()
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GOLAY << (bit - 11)), rest)
    return rest


def _error_patterns() -> np.ndarray:
    """For each syndrome the only word of at most three bits that has it."""
    bits = [1 << i for i in range(23)]
    words = [0, *bits]
    words += [a | b for i, a in enumerate(bits) for b in bits[:i]]
    words += [a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j]]
    table = np.zeros(2048, dtype=np.int64)
    errors = np.array(words, dtype=np.int64)
    table[_remainder(errors)] = errors
    return table


_ERRORS = _error_patterns()


def codeword(word: np.ndarray) -> np.ndarray:
    """The codeword within three bits of each 23-bit word, as its 12 message bits."""
    return (word ^ _ERRORS[_remainder(word)]) >> 11


def golay_keys(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, keys): one or six codeword indices for each 23-bit word."""
    own = codeword(word)
    far = np.flatnonzero(np.bitwise_count(_ERRORS[_remainder(word)]) == 3)
    around = codeword(word[far][:, None] ^ (1 << np.arange(23)))
    around.sort(axis=1)
    new = np.ones(around.shape, dtype=bool)
    new[:, 1:] = around[:, 1:] != around[:, :-1]
    new &= around != own[far][:, None]
    rows = np.concatenate([np.arange(len(word)), np.repeat(far, new.sum(axis=1))])
    return rows, np.concatenate([own, around[new]])


def segment_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, keys) of 64-bit fingerprints: one exact segment, its number and a key of the next."""
    bits = prints.view(np.uint64)
    rows, keys = [], []
    for i, (shift, width) in enumerate(SEGMENTS):
        exact = (bits >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64)
        after, wide = SEGMENTS[(i + 1) % 3]
        near = (bits >> np.uint64(after) & np.uint64((1 << wide) - 1)).astype(np.int64)
        row, key = golay_keys(near)
        rows.append(row)
        keys.append(((exact[row] << 12 | key) << 2) | i)
    return np.concatenate(rows), np.concatenate(keys)


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """The fingerprint of one text, unsigned."""
    import xxhash

    found = text.encode("utf-8").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    n = len(found)
    if n < size:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in found])
        begins = [0, *ends[:-1].tolist()]
        digest = xxhash.xxh64_intdigest
        last = (ends[size - 1 :] - 1).tolist()
        hashes = [digest(joined[a:b], SEED) for a, b in zip(begins, last)]
    h = np.array(hashes, dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65536):  # bounded memory for very long texts
        part = h[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, fp bigint): the 64-bit fingerprint of every text; NULL and blank texts have 0.

    Letters A-Z are lowered, words are `[^\\x20\\x09-\\x0D]+`, shingles of `size` words count with
    repeats (fewer words: all of them form the one shingle); a bit is set if it is set in more than
    half of the shingles' XXH64 hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), _BATCH_TEXTS):
                part = batch.slice(at, _BATCH_TEXTS)
                texts = pc.fill_null(part.column("text"), "").to_pylist()
                prints = np.array([fingerprint(x, size) for x in texts], dtype=np.uint64)
                names = ["doc_id", *keep]
                yield pa.RecordBatch.from_arrays(
                    [*map(part.column, names), pa.array(prints.view(np.int64))], names=[*names, "fp"]
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in ("doc_id", *keep)]
    return rows.mapInArrow(run, ", ".join([*kinds, "fp bigint"]))


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = np.asarray(batch.column("fp"))
        rows, keys = segment_keys(fp)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows])], names=["key", "fp"])


def _midpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flips = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])
    for batch in batches:
        fp = np.asarray(batch.column("fp")).view(np.uint64)
        words = (fp[:, None] ^ flips).ravel().view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(words), pa.array(np.repeat(fp.view(np.int64), 65))], names=["word", "fp"]
        )


def links(prints: DataFrame, frequent: int = FREQUENT_KEY) -> DataFrame:
    """(a, b): links that connect exactly the distinct `fp` within two bits of each other.

    Every linked pair is in the result or connected through fingerprints that are linked.
    `frequent` decides only which of two exact ways is taken.
    """
    keys = prints.mapInArrow(_key_rows, "key bigint, fp bigint")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = stored(keys.join(shared, "key"), "simhash-members")
    few = members.filter(F.col("n") <= frequent).select("key", "fp")
    pairs = (
        few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), "key")
        .filter("a < b AND bit_count(a ^ b) <= 2").select("a", "b").distinct()
    )
    crowded = members.filter(F.col("n") > frequent).select("fp").distinct()
    around = crowded.mapInArrow(_midpoints, "word bigint, fp bigint")
    # a word and those within one bit of it: at most 65 rows
    centre = around.groupBy("word").agg(F.collect_list("fp").alias("near")).filter("size(near) > 1")
    stars = centre.select(F.array_min("near").alias("a"), F.explode("near").alias("b")).filter("a < b")
    return pairs.union(stars.distinct())


def _classes(docs: DataFrame, size: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row, and (fp, root, component_id) of every fingerprint."""
    if max_bits != MAX_BITS:
        raise ValueError("the keys are made for a distance of two bits")
    prints = stored(fingerprints(docs, size), "simhash-fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(distinct.select("fp")))
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    named = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints, stored(placed.join(named, "root").select("fp", "root", "component_id"), "simhash-classes")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint string, component_id) of every document.

    component_id is the smallest doc_id that links lead to, the document's own included.  Rows
    whose doc_id is NULL keep their fingerprint and join components, but name none (component_id is
    NULL where there is no other member).  Repeated rows stay; an empty table gives none; other
    columns are ignored.
    """
    prints, classes = _classes(docs, size, max_bits)
    return prints.join(classes, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def deduplicated(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of `docs` for each component, whole: the one of the smallest doc_id.

    Where several rows have that doc_id, or none of the component's rows has one, the row that
    stays is the smallest by a hash of its text.
    """
    prints, classes = _classes(docs, size, max_bits)
    whole = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"),
    )
    ids = prints.groupBy("doc_id").agg(F.count("*").alias("n"))
    once = ids.filter("n = 1 AND doc_id IS NOT NULL").select("doc_id")
    keepers = prints.join(classes, "fp").filter("doc_id = component_id").select("doc_id").join(once, "doc_id")
    plain = whole.join(keepers, "doc_id").select("_row.*")
    # rows whose id does not name them; written, so that Spark knows how few they are
    vague = stored(ids.filter("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("_id")), "simhash-vague")
    others = whole.join(vague, whole["doc_id"].eqNullSafe(vague["_id"]), "left_semi")
    chosen = (
        fingerprints(others, size, ("_row",)).join(classes, "fp").filter("component_id IS NULL OR doc_id = component_id")
        .groupBy("root").agg(F.min_by("_row", F.xxhash64("_row.text")).alias("_row")).select("_row.*")
    )
    return plain.union(chosen)
