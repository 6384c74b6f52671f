"""The profile as states that are written once for each part of a table and merged.

A state holds, for one column of one part, the counts, the smallest and largest value, a distinct sketch
of fixed width and the first values in row order.  All of these merge, so a report over a table is an
aggregate over a few rows for each part, and a new part is the only thing read when it arrives.
Figures that a sketch can only estimate are marked as such; `profile.column_stats` counts exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercalith.functions.normalize import is_whitespace, literal, quoted
from mercalith.operators.profile import CONSTANT_MIN_ROWS, HIGH_NULL_PCT, SAMPLES, canonical

SKETCH_BITS = 14
_SHOWN = 200  # characters of a value kept as smallest, largest or sample


def column_states(df: DataFrame, table: str, part: str, order_by: list[str], samples: int = SAMPLES) -> DataFrame:
    """One row for each column of one part of a table; one scan, and a few rows from each task."""
    fields = df.schema.fields
    keyed = df.selectExpr("*", f"to_json(struct({', '.join(map(quoted, order_by))})) AS _key_text", f"struct({', '.join(map(quoted, order_by))}) AS _key")
    cells = []
    for i, f in enumerate(fields):
        kind, value = canonical(f.name, f.dataType)
        shown = f"left(CAST({quoted(f.name)} AS STRING), {_SHOWN})"
        number = f"CAST({value} AS DOUBLE)" if kind in ("bigint", "double") else "CAST(NULL AS DOUBLE)"
        blank = is_whitespace(quoted(f.name)) if isinstance(f.dataType, T.StringType) else "false"
        empty = f"{value} IS NULL" if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else f"{quoted(f.name)} IS NULL"
        text = f"CASE WHEN NOT ({empty}) THEN CAST({value} AS STRING) END"
        cells.append(f"struct({i} AS column_no, {shown} AS shown, {text} AS value, {number} AS number, {blank} AS blank, {empty} AS missing)")
    rows = keyed.selectExpr("_key", f"inline(array({', '.join(cells)}))")
    counted = rows.groupBy("column_no").agg(
        F.count("*").alias("row_count"),
        F.count_if("missing").alias("null_count"),
        F.count_if("blank").alias("blank_count"),
        F.expr("min(IF(missing, NULL, left(value, 200)))").alias("low"),
        F.expr("max(IF(missing, NULL, left(value, 200)))").alias("high"),
        F.min("number").alias("low_number"),
        F.max("number").alias("high_number"),
        # two columns of 64 bits tell a constant column exactly
        F.expr("min(xxhash64(value)) FILTER (WHERE NOT missing)").alias("low_hash"),
        F.expr("max(xxhash64(value)) FILTER (WHERE NOT missing)").alias("high_hash"),
        F.expr(f"hll_sketch_agg(value, {SKETCH_BITS}) FILTER (WHERE NOT missing)").alias("sketch"),
    )
    rank = "row_number() OVER (PARTITION BY column_no ORDER BY _key, shown) AS _rank"
    first = rows.where("NOT missing").selectExpr("column_no", "_key", "shown", rank).where(f"_rank <= {samples}")
    # samples of several parts merge by the order of the rows they come from
    listed = first.groupBy("column_no").agg(F.expr("array_sort(collect_list(struct(_key AS key, shown)))").alias("first"))
    named = df.sparkSession.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(fields)], "column_no int, column_name string, data_type string")
    joined = named.join(counted, "column_no", "left").join(listed, "column_no", "left")
    keys = "transform(first, x -> struct(to_json(x.key) AS key, x.shown AS shown))"
    return joined.selectExpr(
        f"{literal(table)} AS table_name", f"{literal(part)} AS part", "column_no", "column_name", "data_type",
        *[f"coalesce({c}, 0L) AS {c}" for c in ("row_count", "null_count", "blank_count")],
        "low", "high", "low_number", "high_number", "low_hash", "high_hash", "sketch", f"coalesce({keys}, array()) AS samples",
    )


def merged_profile(states: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """The report of every (table_name, column_name) over all parts in `states`.

    Of a part written twice the rows count twice: parts are replaced by filtering `states`.
    `distinct_estimate` comes from sketches (about 1% off); `is_constant` is exact.
    """
    sums = [F.sum(c).alias(c) for c in ("row_count", "null_count", "blank_count")]
    merged = states.groupBy("table_name", "column_no", "column_name", "data_type").agg(
        *sums,
        F.min("low").alias("low"), F.max("high").alias("high"), F.min("low_number").alias("low_number"), F.max("high_number").alias("high_number"),
        F.min("low_hash").alias("_low"), F.max("high_hash").alias("_high"),
        F.expr("coalesce(hll_sketch_estimate(hll_union_agg(sketch)), 0L)").alias("distinct_estimate"),
        # a few values for each part
        F.expr(f"slice(array_sort(flatten(collect_list(transform(samples, x -> struct(length(x.key) AS l, x.key AS key, x.shown AS shown))))), 1, {samples})").alias("_s"),
        F.count_distinct("part").alias("parts"),
    )
    constant = f"coalesce(_low = _high, false) AND row_count > {CONSTANT_MIN_ROWS} AND null_count < row_count"
    issues = [
        f"CASE WHEN null_pct > {HIGH_NULL_PCT} THEN concat('High null rate: ', null_pct, '%') END",
        "CASE WHEN null_pct = 100 THEN 'Column is entirely null' END",
        "CASE WHEN is_constant THEN 'Only 1 distinct value (constant column)' END",
        "CASE WHEN blank_count > 0 THEN concat(blank_count, ' values are blank/whitespace-only') END",
    ]
    return (
        merged.selectExpr(
            "*", "CASE WHEN row_count = 0 THEN 0D ELSE round(null_count * 100D / row_count, 2) END AS null_pct", f"{constant} AS is_constant"
        )
        .selectExpr("*", f"array_compact(array({', '.join(issues)})) AS issues", "transform(_s, x -> x.shown) AS sample_values")
        .drop("_low", "_high", "_s")
    )


class StateStore:
    """States in a dataset with a folder for each table and part, so that a part can be added or replaced alone."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, df: DataFrame, table: str, part: str, order_by: list[str]) -> None:
        """Profile one part; only its rows are read."""
        states = column_states(df, table, part, order_by)
        states.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/table_name={table}/part={part}")

    def states(self) -> DataFrame:
        return self.spark.read.option("recursiveFileLookup", "true").parquet(self.path)

    def report(self) -> DataFrame:
        return merged_profile(self.states())
