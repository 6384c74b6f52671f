"""Which target a column's values belong to, from values seen before: a dictionary's or earlier targets'.

Every column has a signature: for each of HASHES seeds the smallest hash of its values, an aggregate
that combines map-side and needs no distinct pass.  Two sets agree in a signature's place with a
probability that is their Jaccard similarity.  Signatures are cut into bands; only columns that agree in a
whole band are compared, and what they share is then counted exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercalith.functions.normalize import key_text, literal, quoted
from mercalith.session import stored

HASHES, BAND = 64, 2
MIN_SIMILARITY = 0.5


def column_values(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, value): all values as trimmed lower-case text, columns of simple types only."""
    parts = []
    for name, df in tables.items():
        simple = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
        rows = ", ".join(f"{literal(c)}, {key_text(c)}" for c in simple)
        if simple:
            parts.append(df.selectExpr(f"{literal(name)} AS table_name", f"stack({len(simple)}, {rows}) AS (column_name, value)").where("value <> ''"))
    return reduce(DataFrame.unionByName, parts)


def signatures(values: DataFrame, keys: list[str]) -> DataFrame:
    """`keys` and `signature`, the smallest hash of the values for each seed."""
    least = ", ".join(f"min(xxhash64(value, {seed}))" for seed in range(HASHES))
    return values.groupBy(*keys).agg(F.expr(f"array({least})").alias("signature"))


def _bands(signed: DataFrame) -> DataFrame:
    bands = ", ".join(f"struct({b} AS band, xxhash64(slice(signature, {b * BAND + 1}, {BAND})) AS agreed)" for b in range(HASHES // BAND))
    return signed.selectExpr("*", f"inline(array({bands}))")


def value_evidence(tables: dict[str, DataFrame], known: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """(table_name, column_name, target, similarity): columns whose set of values is like a target's.

    `known` has rows (target, value), from a dictionary or an earlier target (`target_values`).  similarity is
    the exact Jaccard similarity, at least `min_similarity`; pairs below about 0.5 may be missed by the bands, at
    0.7 one in 10 ** 9 is.
    """
    mine = column_values(tables)
    seen = known.selectExpr("target", f"{key_text('value')} AS value").where("value <> ''")
    left = _bands(signatures(mine, ["table_name", "column_name"])).drop("signature")
    right = _bands(signatures(seen, ["target"])).drop("signature")
    # as many rows as columns that agree in a band
    pairs = stored(left.join(right, ["band", "agreed"]).select("table_name", "column_name", "target").distinct(), "column-pairs")
    own = mine.join(F.broadcast(pairs.select("table_name", "column_name").distinct()), ["table_name", "column_name"]).distinct()
    theirs = seen.join(F.broadcast(pairs.select("target").distinct()), "target").distinct()
    own, theirs = stored(own, "values"), stored(theirs, "known-values")
    shared = (
        own.join(pairs, ["table_name", "column_name"]).join(theirs, ["target", "value"])
        .groupBy("table_name", "column_name", "target").agg(F.count("*").alias("both"))
    )
    sizes = own.groupBy("table_name", "column_name").agg(F.count("*").alias("n"))
    known_sizes = theirs.groupBy("target").agg(F.count("*").alias("m"))
    return (
        shared.join(sizes, ["table_name", "column_name"]).join(known_sizes, "target")
        .selectExpr("table_name", "column_name", "target", "round(both / CAST(n + m - both AS DOUBLE), 4) AS similarity")
        .where(F.col("similarity") >= min_similarity)
    )


def target_values(target: DataFrame, names: list[str]) -> DataFrame:
    """(target, value) of the columns `names` of a target that was built before."""
    rows = ", ".join(f"{literal(c)}, CAST({quoted(c)} AS STRING)" for c in names)
    return target.selectExpr(f"stack({len(names)}, {rows}) AS (target, value)").where("value IS NOT NULL")
