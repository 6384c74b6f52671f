"""Processor and acquirer constants, found in the source tables by column name and content."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercalith.functions.normalize import WHITESPACE, literal, quoted, text

# Field, column-name pattern (searched, case-insensitive), numeric or not.
FIELDS = (
    ("processor_name", r"processor.?name|proc.?name|cib.?name", False),
    ("processor_bin_cib", r"processor.?bin.?cib|processor.?cib|cib$|cib.?id|proc.?cib", True),
    ("acquirer_name", r"acquirer.?name|acq.?name|bid.?name", False),
    ("acquirer_bid", r"acquirer.?bid|bid$|bid.?id|acq.?bid|business.?id", True),
    ("acquirer_bin", r"acquirer.?bin|bin$|bin.?id|acq.?bin|acquiring.?bin", True),
)
REFERENCE_TABLE = r"bin|cib|bid|master|processor|acquirer|reference|ref"
MAX_OPTIONS = 50


@dataclass(frozen=True)
class Source:
    field: str
    numeric: bool
    priority: int
    table: str
    column: str


def _search(pattern: str, name: str) -> bool:
    return re.search(pattern, name, re.IGNORECASE) is not None


def _sources(
    tables: dict[str, DataFrame], ids_from_reference: bool, first_column_only: bool
) -> list[Source]:
    """Columns whose name fits a field, in order of preference."""
    reference = [t for t in tables if _search(REFERENCE_TABLE, t)]
    others = [t for t in tables if t not in reference]
    found = []
    for name, pattern, numeric in FIELDS:
        ordered = others + reference if numeric and not ids_from_reference else reference + others
        priority = 0
        for table in ordered:
            fitting = [c for c in tables[table].columns if _search(pattern, c)]
            for column in fitting[:1] if first_column_only else fitting:
                found.append(Source(name, numeric, priority, table, column))
                priority += 1
    return found


def _stripped(column: str) -> str:
    return f"trim(BOTH {literal(WHITESPACE)} FROM {text(column)})"


def detect(tables: dict[str, DataFrame]) -> DataFrame:
    """field, value, source_table, source_column: the most frequent value of the preferred
    column that holds any, the smallest winning a tie; ids are cut to whole numbers.

    Values are counted per column first, so a column with one value everywhere or with only
    distinct values is equally harmless.
    """
    sources = _sources(tables, ids_from_reference=True, first_column_only=False)
    spark = next(iter(tables.values())).sparkSession
    if not sources:
        return spark.createDataFrame(
            [], "field string, value string, source_table string, source_column string"
        )
    parts = []
    for name, df in tables.items():
        mine = [(i, s) for i, s in enumerate(sources) if s.table == name]
        if mine:
            rows = ", ".join(f"{i}, {_stripped(s.column)}" for i, s in mine)
            parts.append(df.selectExpr(f"stack({len(mine)}, {rows}) AS (source, value)"))
    counts = (
        reduce(DataFrame.unionByName, parts)
        .where("value <> ''")
        .groupBy("source", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    listed = spark.createDataFrame(
        [(i, s.field, s.numeric, s.priority, s.table, s.column) for i, s in enumerate(sources)],
        "source int, field string, numeric boolean, priority int, source_table string, "
        "source_column string",
    )
    modes = counts.groupBy("source").agg(F.min(F.struct(-F.col("n"), F.col("value"))).alias("m"))
    best = (
        modes.join(F.broadcast(listed), "source")
        .groupBy("field")
        .agg(
            F.min(
                F.struct("priority", "numeric", "source_table", "source_column", "m.value")
            ).alias("b")
        )
    )
    whole = "CAST(try_cast(try_cast(b.value AS DOUBLE) AS BIGINT) AS STRING)"
    return best.selectExpr(
        "field",
        f"CASE WHEN b.numeric THEN coalesce({whole}, b.value) ELSE b.value END AS value",
        "b.source_table",
        "b.source_column",
    )


def resolve(detected: DataFrame, chosen: dict | None = None) -> DataFrame:
    """field, value for all five fields: the user's value, else the detected one, else NULL.
    0 and '' count as not given."""
    chosen = {k: str(v) for k, v in (chosen or {}).items() if v}
    spark = detected.sparkSession
    wanted = spark.createDataFrame(
        [(name, chosen.get(name)) for name, _, _ in FIELDS], "field string, chosen string"
    )
    return wanted.join(detected, "field", "left").selectExpr(
        "field", "coalesce(chosen, nullif(nullif(value, ''), '0')) AS value"
    )


def options(
    tables: dict[str, DataFrame], order_by: dict[str, list[str]], limit: int | None = MAX_OPTIONS
) -> DataFrame:
    """field, position, value, source_table, source_column: up to `limit` values to choose from
    (None: all), the first to appear in the table, listed numbers first."""
    parts = []
    for s in _sources(tables, ids_from_reference=False, first_column_only=True):
        keys = [f"{quoted(c)} AS _o{i}" for i, c in enumerate(order_by[s.table])]
        order = ", ".join(f"_o{i}" for i in range(len(keys)))
        first = (
            tables[s.table]
            .selectExpr(f"{_stripped(s.column)} AS value", *keys)
            .where("value <> '' AND lower(value) <> 'nan'")
            .groupBy("value")
            .agg(F.expr(f"min(struct({order}))").alias("seen"))
        )
        if limit is not None:
            first = first.orderBy("seen").limit(limit)
        parts.append(
            first.selectExpr(
                f"'{s.field}' AS field",
                f"{s.priority} AS priority",
                f"{literal(s.table)} AS source_table",
                f"{literal(s.column)} AS source_column",
                "value",
            )
        )
    if not parts:
        spark = next(iter(tables.values())).sparkSession
        return spark.createDataFrame(
            [], "field string, position int, value string, source_table string, source_column string"
        )
    found = reduce(DataFrame.unionByName, parts)
    best = found.groupBy("field").agg(F.min("priority").alias("priority"))
    listing = "row_number() OVER (PARTITION BY field ORDER BY try_cast(value AS DOUBLE) ASC NULLS LAST, value)"
    # at most `limit` rows per field and source reach the ranking
    return found.join(best, ["field", "priority"]).selectExpr(
        "field", f"{listing} AS position", "value", "source_table", "source_column"
    )
