"""Find keys and joins between tables from the data itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercalith.functions.normalize import quoted
from mercalith.operators.inclusion import MIN_OVERLAP_PCT, inclusions


def key_columns(stats: DataFrame) -> DataFrame:
    """Columns that identify a row on their own: no NULL and every value different."""
    return stats.where("row_count > 0 AND null_count = 0 AND distinct_count = row_count").select(
        "table_name", "column_name", "data_type", "row_count"
    )


def discover_joins(tables: dict[str, DataFrame], min_overlap_pct: float = MIN_OVERLAP_PCT) -> DataFrame:
    """Foreign keys between columns of the same name but for a prefix: how many distinct values of the
    one column are values of the other, and the join type that keeps every referencing row.

    `inclusion.inclusions` finds those of unrelated names too.
    """
    found = inclusions(tables, min_overlap_pct, same_name=True, drop_implied=False)
    return found.drop("family", "same_name")


def table_roles(stats: DataFrame, joins: DataFrame) -> DataFrame:
    """Role of each table in the join graph, and which one is the main table (most rows)."""
    tables = stats.groupBy("table_name").agg(
        F.max("row_count").alias("row_count"),
        F.min("table_no").alias("table_no"),
        F.count(F.lit(1)).alias("columns"),
    )
    outgoing = joins.groupBy(F.col("left_table").alias("table_name")).agg(
        F.count_distinct("left_key").alias("outgoing")
    )
    incoming = joins.groupBy(F.col("right_table").alias("table_name")).agg(
        F.count_distinct("left_table", "left_key").alias("incoming")
    )
    graph = (
        tables.join(outgoing, "table_name", "left")
        .join(incoming, "table_name", "left")
        .na.fill(0, ["outgoing", "incoming"])
    )
    role = """CASE WHEN outgoing >= 2 AND outgoing = columns THEN 'bridge'
                   WHEN outgoing > 0 AND incoming = 0 THEN 'fact'
                   WHEN outgoing > 0 THEN 'dimension'
                   WHEN incoming > 0 THEN 'reference'
                   ELSE 'standalone' END"""
    main = graph.orderBy(F.desc("row_count"), "table_no").limit(1)
    return graph.join(main.selectExpr("table_name", "true AS is_main"), "table_name", "left").selectExpr(
        "table_name",
        "row_count",
        "outgoing",
        "incoming",
        f"{role} AS role",
        "coalesce(is_main, false) AS is_main",
    )


def composite_key_check(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: do the columns together identify a row?"""
    named = ", ".join(quoted(k) for k in keys)
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .selectExpr("n", f"({' OR '.join(f'{quoted(k)} IS NULL' for k in keys)}) AS has_null")
        .selectExpr(
            "sum(n) AS row_count",
            "count(*) AS distinct_count",
            "coalesce(max(n) = 1 AND NOT bool_or(has_null), false) AS is_key",
        )
        .withColumn("key", F.lit(named.replace("`", "")))
    )


def fingerprints(catalogue: DataFrame) -> DataFrame:
    """SHA-256 per feed over its table and column names, independent of their order.

    `catalogue` has a row per (feed, table_name, column_name); repeated rows count once.
    """
    names = catalogue.groupBy("feed", "table_name", "column_name").agg(F.lit(1))
    per_table = names.groupBy("feed", "table_name").agg(
        F.expr("table_name || ':' || array_join(array_sort(collect_list(column_name)), ',')").alias(
            "line"
        )
    )
    return per_table.groupBy("feed").agg(
        F.expr(
            "sha2(array_join(transform(array_sort(collect_list(struct(table_name, line))), "
            "x -> x.line), '|'), 256)"
        ).alias("fingerprint")
    )


def catalogue_of(spark: SparkSession, feed: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The catalogue rows of one set of loaded tables."""
    rows = [(feed, name, c) for name, df in tables.items() for c in df.columns]
    return spark.createDataFrame(rows, "feed string, table_name string, column_name string")


def match_templates(fingerprinted: DataFrame, templates: DataFrame) -> DataFrame:
    """Every feed with the stored template of the same fingerprint, if there is one."""
    return fingerprinted.join(templates, "fingerprint", "left").withColumn(
        "matched", F.col("name").isNotNull()
    )
