"""Jaro-Winkler similarity: the one function Spark has no built-in for.

Scores run inside Arrow batches, vectorised over all pairs of a batch.  `may_exceed` is a
Catalyst-only upper bound used to keep hopeless pairs from crossing into Python at all.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ship this module's code with the tasks, so executors need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the measure.
PREFIX_WEIGHT = 0.1
PREFIX_LENGTH = 4
BOOST_ABOVE = 0.7
_CELLS = 1 << 20


def _padded(values: pa.Array, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the chosen rows as a zero-padded matrix, and their lengths."""
    blob = values.cast(pa.large_binary())
    offsets = np.frombuffer(blob.buffers()[1], dtype=np.int64)[blob.offset : blob.offset + len(blob) + 1]
    data = np.frombuffer(blob.buffers()[2] or b"\0", dtype=np.uint8)
    start = offsets[rows]
    size = offsets[rows + 1] - start
    span = np.arange(max(int(size.max(initial=0)), 1))
    inside = span < size[:, None]
    matrix = np.where(inside, data[np.where(inside, start[:, None] + span, 0)], 0)
    return np.ascontiguousarray(matrix.astype(np.uint8).T), size


def _score(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Scores of all pairs at once; matrices hold one byte position per row, one pair per column."""
    wide_a, wide_b, n = len(a), len(b), a.shape[1]
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    widest = int(reach.max(initial=0))
    within = [reach >= d for d in range(widest + 1)]
    free = [lb > j for j in range(wide_b)]
    taken = [np.zeros(n, dtype=bool) for _ in range(wide_b)]
    seq_a = np.zeros((min(wide_a, wide_b) + 1, n), dtype=np.uint8)
    seq_b = np.zeros_like(seq_a)
    everyone = np.arange(n)
    matches = np.zeros(n, dtype=np.int64)
    for i in range(wide_a):
        open_ = la > i
        for j in range(max(0, i - widest), min(wide_b, i + widest + 1)):
            hit = (a[i] == b[j]) & free[j] & open_ & within[abs(i - j)]
            free[j] &= ~hit
            taken[j] |= hit
            open_ &= ~hit
        done = (la > i) & ~open_
        seq_a[matches[done], everyone[done]] = a[i][done]
        matches += done
    filled = np.zeros(n, dtype=np.int64)
    for j in range(wide_b):
        seq_b[filled[taken[j]], everyone[taken[j]]] = b[j][taken[j]]
        filled += taken[j]
    crossed = (seq_a != seq_b).sum(axis=0) // 2
    m = np.maximum(matches, 1)
    jaro = (m / np.maximum(la, 1) + m / np.maximum(lb, 1) + (m - crossed) / m) / 3
    jaro = np.where(matches == 0, 0.0, jaro)
    prefix, running = np.zeros(n), np.minimum(la, lb) > 0
    for k in range(min(PREFIX_LENGTH, wide_a, wide_b)):
        running = running & (a[k] == b[k]) & (np.minimum(la, lb) > k)
        prefix += running
    boosted = jaro + PREFIX_WEIGHT * prefix * (1 - jaro)
    return np.where(jaro > BOOST_ABOVE, boosted, jaro)


def score_pairs(left: pa.Array, right: pa.Array) -> pa.Array:
    """Jaro-Winkler over UTF-8 bytes per row; NULL where either side is NULL."""
    valid = left.is_valid().to_numpy(zero_copy_only=False) & right.is_valid().to_numpy(
        zero_copy_only=False
    )
    out = np.zeros(len(left), dtype=np.float64)
    rows = np.flatnonzero(valid)
    if len(rows):
        sizes = np.maximum(
            np.asarray(pc.binary_length(left).fill_null(0)),
            np.asarray(pc.binary_length(right).fill_null(0)),
        )
        # pairs of similar length share a block, so padding stays small
        rows = rows[np.argsort(sizes[rows], kind="stable")]
        while len(rows):
            take = len(rows)
            while take > 1 and take * int(sizes[rows[take - 1]]) > _CELLS:
                take = max(take // 2, 1)
            block, rows = rows[:take], rows[take:]
            a, la = _padded(left, block)
            b, lb = _padded(right, block)
            out[block] = _score(a, la, b, lb)
    return pa.array(out, mask=~valid)


@F.arrow_udf(T.DoubleType())
def jaro_winkler(left: pa.Array, right: pa.Array) -> pa.Array:
    return score_pairs(left, right)


def _once(left: pa.Array, right: pa.Array) -> pa.Array:
    return score_pairs(left, right)


# The same function, kept from being copied into a pushed-down filter and so run twice.
jaro_winkler_once = F.arrow_udf(_once, T.DoubleType()).asNondeterministic()


def may_exceed(a: str, b: str, threshold: float) -> str:
    """False only for pairs whose similarity provably is not above `threshold`.

    At most as many bytes match as the shorter text has, so Jaro is at most (2 + short/long)/3;
    the prefix boost is zero when the first bytes differ.
    """
    full_boost = PREFIX_WEIGHT * PREFIX_LENGTH
    boosted = (threshold - full_boost) / (1 - full_boost)
    slack = 1e-9
    no_prefix = f"(ascii({a}) <> ascii({b}) AND least(ascii({a}), ascii({b})) < 128)"
    la, lb = f"octet_length({a})", f"octet_length({b})"
    return (
        f"(least({la}, {lb}) > greatest({la}, {lb}) * CASE WHEN {no_prefix} "
        f"THEN {3 * threshold - 2 - slack}D ELSE {3 * boosted - 2 - slack}D END)"
    )


def register_sql_functions(spark: SparkSession) -> None:
    """Make the functions user rules may call available in SQL text."""
    spark.udf.register("jaro_winkler_similarity", jaro_winkler)
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION regexp_matches(x STRING, p STRING) "
        "RETURNS BOOLEAN RETURN x RLIKE p"
    )
