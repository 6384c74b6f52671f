"""Column statistics, quality issues and table scores for any set of tables.

All tables are unpivoted to (table, column, value) and counted per value, once: NULLs,
distinct values and blanks of every column all follow from those counts.  Frequent values
collapse before the shuffle, so a constant column costs next to nothing and no column is ever
gathered in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercalith.functions.normalize import is_whitespace, literal, quoted
from mercalith.session import stored

# Longer values are counted by their digest, so texts of any size make small shuffle keys.
_RAW_LENGTH = 64
SAMPLES = 5
# Rows of a table that are looked at first for samples.
FIRST_ROWS = 64

# Thresholds of the five issues and the score's weight per issue.
HIGH_NULL_PCT, CONSTANT_MIN_ROWS, UNIQUE_MIN_ROWS, ISSUE_PENALTY = 50, 10, 100, 5


def canonical(name: str, data_type: T.DataType) -> tuple[str, str]:
    """Kind of key (bigint, double or string) and SQL text of the value as such a key.

    Equal values give equal keys.  Numbers and times stay numbers, which keeps the shuffle
    small and the counting inside generated code.
    """
    c = quoted(name)
    if isinstance(data_type, T.IntegralType):
        return "bigint", f"CAST({c} AS BIGINT)"
    if isinstance(data_type, T.BooleanType):
        return "bigint", f"CAST(CAST({c} AS INT) AS BIGINT)"
    if isinstance(data_type, T.DateType):
        return "bigint", f"CAST(unix_date({c}) AS BIGINT)"
    if isinstance(data_type, T.TimestampType):
        return "bigint", f"unix_micros({c})"
    if isinstance(data_type, T.TimestampNTZType):
        return "bigint", f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})"
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return "double", f"CAST(CASE WHEN NOT isnan({c}) THEN {c} END AS DOUBLE)"
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        return "string", f"to_json({_ordered(c, data_type)})"
    if isinstance(data_type, T.BinaryType):
        return "string", f"hex({c})"
    return "string", f"CAST({c} AS STRING)"


def _ordered(expression: str, data_type: T.DataType) -> str:
    """A map as its entries in order of their keys, so that equal maps are written alike."""
    if isinstance(data_type, T.MapType):
        return f"array_sort(map_entries({expression}), (a, b) -> CASE WHEN a.key < b.key THEN -1 WHEN a.key > b.key THEN 1 ELSE 0 END)"
    return expression


def _cells(tables: dict[str, DataFrame], kind: str) -> DataFrame | None:
    """table_no, column_no, value, blank: the unpivoted columns of one kind of key."""
    parts = []
    for table_no, df in enumerate(tables.values()):
        rows = []
        for column_no, field in enumerate(df.schema.fields):
            its_kind, value = canonical(field.name, field.dataType)
            textual = isinstance(field.dataType, T.StringType)
            blank = is_whitespace(quoted(field.name)) if textual else "false"
            if its_kind == kind:
                rows.append(f"{column_no}, {value}, {blank}")
        if rows:
            stack = f"stack({len(rows)}, {', '.join(rows)}) AS (column_no, value, blank)"
            parts.append(df.selectExpr(f"{table_no} AS table_no", stack))
    return reduce(DataFrame.unionByName, parts) if parts else None


def counted_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """table_no, column_no and the counts of every column that has rows.

    Values are counted first, with map-side combine; the per-column figures are sums over
    those counts.
    """
    parts = []
    for kind in ("bigint", "double", "string"):
        cells = _cells(tables, kind)
        if cells is None:
            continue
        if kind == "string":
            digest = f"IF(length(value) > {_RAW_LENGTH}, '#' || sha2(value, 256), value)"
            cells = cells.selectExpr("table_no", "column_no", f"{digest} AS value", "blank")
        counts = cells.groupBy("table_no", "column_no", "value").agg(
            F.expr("count(*) AS n"), F.expr("bool_or(blank) AS blank")
        )
        parts.append(
            counts.groupBy("table_no", "column_no").agg(
                F.expr("sum(n) AS row_count"),
                F.expr("sum(IF(value IS NULL, n, 0)) AS null_count"),
                F.expr("count(value) AS distinct_count"),
                F.expr("sum(IF(blank, n, 0)) AS blank_count"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def columns_frame(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """One row per column of every table, from the schemas alone."""
    rows = [
        (t, c, name, field.name, field.dataType.simpleString())
        for t, (name, df) in enumerate(tables.items())
        for c, field in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(
        rows,
        "table_no int, column_no int, table_name string, column_name string, data_type string",
    )


def column_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per (table, column): counts, null share and the list of issues."""
    spark = next(iter(tables.values())).sparkSession
    counted = counted_columns(tables)
    zero = [
        f"coalesce({c}, 0L) AS {c}"
        for c in ("row_count", "null_count", "distinct_count", "blank_count")
    ]
    # the column list has one row per column of the schemas, whatever the data size
    listed = columns_frame(spark, tables)
    return (
        listed.join(counted, ["table_no", "column_no"], "left")
        .selectExpr("table_no", "column_no", "table_name", "column_name", "data_type", *zero)
        .selectExpr(
            "*", "CASE WHEN row_count = 0 THEN 0D ELSE round(null_count * 100D / row_count, 2) END AS null_pct"
        )
        .selectExpr("*", f"{_issues()} AS issues")
    )


# The issues' texts, each with the figure it rests on.
_ISSUES = (
    ("null_pct", f"CASE WHEN null_pct > {HIGH_NULL_PCT} THEN concat('High null rate: ', null_pct, '%') END"),
    ("null_pct", "CASE WHEN null_pct = 100 THEN 'Column is entirely null' END"),
    (
        "distinct_count",
        f"CASE WHEN distinct_count = 1 AND row_count > {CONSTANT_MIN_ROWS} THEN 'Only 1 distinct value (constant column)' END",
    ),
    (
        "distinct_count",
        f"CASE WHEN distinct_count = row_count AND row_count > {UNIQUE_MIN_ROWS} THEN 'All values unique (potential PK)' END",
    ),
    ("blank_count", "CASE WHEN blank_count > 0 THEN concat(blank_count, ' values are blank/whitespace-only') END"),
)


def _issues() -> str:
    return f"array_compact(array({', '.join(text for _, text in _ISSUES)}))"


def approximate_stats(df: DataFrame) -> DataFrame:
    """column_name, row_count, null_count, distinct_count in one pass with no value shuffle;
    distinct counts are estimates.  For tables too wide to count exactly."""
    fields = df.schema.fields
    keys = [
        canonical(f.name, f.dataType)[1] if isinstance(f.dataType, T.MapType) else quoted(f.name) for f in fields
    ]
    one = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(quoted(f.name)).alias(f"_n{i}") for i, f in enumerate(fields)],
        *[F.approx_count_distinct(F.expr(k)).alias(f"_d{i}") for i, k in enumerate(keys)],
    )
    rows = ", ".join(f"{literal(f.name)}, _rows - _n{i}, _d{i}" for i, f in enumerate(fields))
    return one.selectExpr(
        "_rows AS row_count",
        f"stack({len(fields)}, {rows}) AS (column_name, null_count, distinct_count)",
    )


def fill_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, column_name, data_type, row_count, null_count, null_pct, blank_count and the issues
    that follow from them.  One scan and one row per task for each table: no value is shuffled."""
    parts = []
    for table_no, (name, df) in enumerate(tables.items()):
        fields, counts, rows = df.schema.fields, [], []
        for i, f in enumerate(fields):
            value = canonical(f.name, f.dataType)[1] if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else quoted(f.name)
            blank = is_whitespace(quoted(f.name)) if isinstance(f.dataType, T.StringType) else "false"
            counts += [f"count_if({value} IS NULL) AS _n{i}", f"count_if({blank}) AS _b{i}"]
            rows.append(f"{i}, {literal(f.name)}, {literal(f.dataType.simpleString())}, _n{i}, _b{i}")
        parts.append(
            df.selectExpr("count(*) AS row_count", *counts).selectExpr(
                f"{table_no} AS table_no", f"{literal(name)} AS table_name", "row_count",
                f"stack({len(fields)}, {', '.join(rows)}) AS (column_no, column_name, data_type, null_count, blank_count)",
            )
        )
    share = "CASE WHEN row_count = 0 THEN 0D ELSE round(null_count * 100D / row_count, 2) END AS null_pct"
    known = [text for stat, text in _ISSUES if stat != "distinct_count"]
    return (
        reduce(DataFrame.unionByName, parts)
        .selectExpr("*", share)
        .selectExpr("*", f"array_compact(array({', '.join(known)})) AS issues")
    )


def table_scores(stats: DataFrame) -> DataFrame:
    """100 less the mean null share and 5 per issue, never below 0."""
    return stats.groupBy("table_name").agg(
        F.max("row_count").alias("row_count"),
        F.expr(
            f"round(greatest(0D, 100D - avg(null_pct) - {ISSUE_PENALTY} * sum(size(issues))), 1)"
        ).alias("overall_score"),
    )


def sample_values(
    tables: dict[str, DataFrame], order_by: dict[str, list[str]], k: int = SAMPLES
) -> DataFrame:
    """table_name, column_name, sample_values: the first `k` non-null values as text.

    A table's first rows, found by one top-k of whole rows, settle every column that has `k` values among
    them.  The others, which are sparse there or of a smaller table, each get a top-k of their own; a task holds those rows or
    values and sorts or shuffles no others.
    """
    n = max(FIRST_ROWS, 4 * k)
    found = reduce(
        DataFrame.unionByName, [_first_values(t, name, df, order_by[name], k, n) for t, (name, df) in enumerate(tables.items())]
    )
    names = list(tables)
    rest: dict[str, list[str]] = {}
    # at most a row for each column
    for r in found.where("NOT settled").select("table_no", "column_no").orderBy("table_no", "column_no").collect():
        rest.setdefault(names[r.table_no], []).append(tables[names[r.table_no]].columns[r.column_no])
    parts = [found.where("settled").select("table_name", "column_name", "sample_values")]
    for name, columns in rest.items():
        parts += [_top_values(name, tables[name], c, order_by[name], k) for c in columns]
    return reduce(DataFrame.unionByName, parts)


def _first_values(table_no: int, name: str, df: DataFrame, order_by: list[str], k: int, n: int) -> DataFrame:
    """table_no, column_no, table_name, column_name, sample_values, settled: the first values of every column
    among the first `n` rows, and whether no later row can add to them.

    Of `n` rows only those before the key of the last count, as others of that key may have been cut off.
    """
    columns = df.columns
    texts = ", ".join(f"CAST({quoted(c)} AS STRING)" for c in columns)
    key = f"struct({', '.join(f'{quoted(c)} AS _o{i}' for i, c in enumerate(order_by))})"
    first = df.orderBy(*[F.col(quoted(c)) for c in order_by]).limit(n).selectExpr(f"{key} AS key", f"array({texts}) AS texts")
    named = f"array({', '.join(literal(c) for c in columns)})"
    values = "array_sort(filter(transform(rows, r -> struct(r.key AS key, r.texts[column_no] AS value)), x -> x.value IS NOT NULL))"
    return (
        first.selectExpr("array_sort(collect_list(key)) AS keys", "collect_list(struct(key, texts)) AS all_rows")
        .selectExpr(f"size(keys) = {n} AS full", "all_rows", "element_at(keys, -1) AS last")
        .selectExpr("full", "filter(all_rows, r -> r.key < last) AS rows")
        .selectExpr("full", "rows", f"explode(sequence(0, {len(columns) - 1})) AS column_no")
        .selectExpr("full", "column_no", f"transform(slice({values}, 1, {k}), x -> x.value) AS sample_values")
        .selectExpr(
            f"{table_no} AS table_no", "column_no", f"{literal(name)} AS table_name", f"{named}[column_no] AS column_name",
            "sample_values", f"full AND size(sample_values) = {k} AS settled",
        )
    )


def _top_values(name: str, df: DataFrame, column: str, order_by: list[str], k: int) -> DataFrame:
    """`sample_values` of one column, from its keys and that column only."""
    keys = [f"{quoted(c)} AS _o{i}" for i, c in enumerate(order_by)]
    order = [f"_o{i}" for i in range(len(keys))] + ["value"]
    c = quoted(column)
    cells = df.where(f"{c} IS NOT NULL").selectExpr(*keys, f"CAST({c} AS STRING) AS value")
    # k rows; without a value one row with an empty list
    listed = f"transform(array_sort(collect_list(struct({', '.join(order)}))), x -> x.value) AS sample_values"
    return cells.where("value IS NOT NULL").orderBy(*order).limit(k).selectExpr(listed).selectExpr(
        f"{literal(name)} AS table_name", f"{literal(column)} AS column_name", "sample_values"
    )


def quality_report(
    tables: dict[str, DataFrame],
    order_by: dict[str, list[str]],
    k: int = SAMPLES,
    unread: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Everything known per (table, column), with the table's score repeated on its columns.

    Columns in `unread` order a table's samples but are no part of the report.
    """
    unread = unread or {}
    # statistics feed the rows and the scores; as many rows as there are columns
    stats = stored(column_stats({n: df.drop(*unread.get(n, ())) for n, df in tables.items()}), "column-stats")
    samples = sample_values(tables, order_by, k)
    return (
        stats.join(samples, ["table_name", "column_name"], "left")
        .join(table_scores(stats).drop("row_count"), "table_name")
        .drop("table_no")
    )


def first_rows(df: DataFrame, order_by: list[str], n: int = 5) -> DataFrame:
    """The first rows as text, a missing value shown as the word NULL."""
    return (
        df.orderBy(*order_by)
        .limit(n)
        .selectExpr(*[f"coalesce(CAST({quoted(c)} AS STRING), 'NULL') AS {quoted(c)}" for c in df.columns])
    )


def null_analysis(df: DataFrame, columns: list[str]) -> DataFrame:
    """The statistics of one table in one wide row."""
    stats = column_stats({"t": df.select(*columns)})
    wide = [F.max("row_count").alias("total_rows")]
    for c in columns:
        for stat in ("null_count", "null_pct", "distinct_count"):
            out = f"{c}_distinct" if stat == "distinct_count" else f"{c}_{stat}"
            wide.append(F.expr(f"max(CASE WHEN column_name = '{c}' THEN {stat} END)").alias(out))
    return stats.agg(*wide)


# Fixed value: how the target writes dates.
DATE_FORMAT = "yyyyMMdd"


def type_check(
    df: DataFrame, column: str, expected: str, limit: int = 10, date_format: str | None = None
) -> DataFrame:
    """The first `limit` values that are no integer / no date, with their stored type."""
    c = quoted(column)
    if expected == "integer":
        cast = f"try_cast({c} AS INT)"
    elif expected == "date":
        cast = f"try_to_date({c}, '{date_format}')" if date_format else f"try_cast({c} AS DATE)"
    else:
        raise ValueError(f"No check for type {expected}")
    bad = df.where(f"{c} IS NOT NULL AND {cast} IS NULL")
    return bad.selectExpr(c, f"typeof({c}) AS actual_type").orderBy(c).limit(limit)


def uniqueness_check(df: DataFrame, keys: list[str], limit: int = 10) -> DataFrame:
    """The `limit` most repeated key values; none means the key is unique."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("dup_count"))
        .where("dup_count > 1")
        .orderBy(F.desc("dup_count"), *keys)
        .limit(limit)
    )
