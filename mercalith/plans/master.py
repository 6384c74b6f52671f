"""Build the 31-column master table from source tables, a mapping and a join plan.

The mapping and the plan are data a reviewer can edit; this module turns them into one lazy
DataFrame.  Which join is broadcast, shuffled or split is left to Spark.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercalith.functions.normalize import cast_value, literal, quoted
from mercalith.spec import ROW_ID, SPARK_TYPES, TARGET_COLUMNS, TARGET_NAMES

# Derivations every build may use, over named source columns.
MERCHANT_ID = "CASE WHEN {aggregator} IS NOT NULL THEN {sub_merchant} ELSE {own} END"
TRANSACTION_NAME = "CASE WHEN {aggregator} IS NOT NULL THEN concat_ws(' - ', {aggregator}, {dba}) END"


def derived_merchant_id(aggregator: str, sub_merchant: str, own: str) -> str:
    """SQL text: the sub-merchant id for rows of an aggregator, else the acquirer's own id."""
    return MERCHANT_ID.format(aggregator=aggregator, sub_merchant=sub_merchant, own=own)


def derived_transaction_name(aggregator: str, dba: str) -> str:
    """SQL text: 'aggregator - name' for rows of an aggregator, NULL for direct merchants."""
    return TRANSACTION_NAME.format(aggregator=aggregator, dba=dba)


def join_sources(
    tables: dict[str, DataFrame], main: str, plan: Iterable[dict]
) -> DataFrame:
    """Fold the plan's joins onto `main`.  Columns stay addressable as table.column.

    A CROSS entry is allowed for a reference table of one row, whose values become constants;
    anything else would multiply the rows.
    """
    joined = tables[main].alias(main)
    for step in plan:
        kind = step["join_type"].upper()
        left, right = step["left_table"], step["right_table"]
        if kind == "CROSS":
            joined = _with_constants(joined, tables[right], right)
            continue
        if kind not in ("INNER", "LEFT"):
            raise ValueError(f"Unknown join type {kind}")
        pairs = zip(step["left_key"].split(","), step["right_key"].split(","), strict=True)
        on = " AND ".join(
            f"{quoted(left)}.{quoted(a.strip())} = {quoted(right)}.{quoted(b.strip())}"
            for a, b in pairs
        )
        joined = joined.join(tables[right].alias(right), F.expr(on), kind.lower())
    return joined


def _with_constants(joined: DataFrame, reference: DataFrame, name: str) -> DataFrame:
    rows = reference.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{name} must hold exactly one row for a CROSS join")
    values = [F.lit(rows[0][c]).cast(reference.schema[c].dataType).alias(c) for c in reference.columns]
    return joined.select("*", F.struct(*values).alias(name))


def build_target(
    tables: dict[str, DataFrame],
    mapping: DataFrame | Iterable[dict],
    plan: Iterable[dict],
    main: str,
    key: str,
    constants: dict[str, str | int | None] | None = None,
    distinct: bool = True,
    feed: str | None = None,
) -> DataFrame:
    """`row_id` and the 31 columns in order, each cast to its type.

    Dates may be written yyyyMMdd and numbers with decimals (rounded); `lost_values` counts what no
    cast can save.  A mapping row gives a source column or, if derived, SQL text over table.column names.
    A mapping of several feeds needs `feed`; a target mapped twice is refused.  `constants` set target columns outright.  Unmapped columns are NULL.  `key` is a column of
    `main` that identifies its rows; of rows alike in all 31 columns the smallest key stays.
    """
    chosen = chosen_columns(mapping, feed)
    for name, value in (constants or {}).items():
        chosen[name] = "NULL" if value is None else literal(str(value))
    columns = [
        f"{cast_value(chosen.get(c.name, 'NULL'), SPARK_TYPES[c.type])} AS {c.name}" for c in TARGET_COLUMNS
    ]
    joined = join_sources(tables, main, plan)
    built = joined.selectExpr(f"CAST({quoted(main)}.{quoted(key)} AS BIGINT) AS {ROW_ID}", *columns)
    return distinct_rows(built) if distinct else built


def chosen_columns(mapping: DataFrame | Iterable[dict], feed: str | None = None) -> dict[str, str]:
    """SQL text per mapped target column, of one feed."""
    if isinstance(mapping, DataFrame):
        if feed is not None:
            mapping = mapping.where(F.col("feed") == feed)
        # one row for each target, and one more to notice that there are too many
        mapping = [row.asDict() for row in mapping.limit(len(TARGET_COLUMNS) + 1).collect()]
    elif feed is not None:
        mapping = [m for m in mapping if m.get("feed") == feed]
    chosen: dict[str, str] = {}
    for m in mapping:
        if m["target"] in chosen:
            raise ValueError(f"{m['target']} is mapped twice; several feeds need `feed`")
        chosen[m["target"]] = _expression(m)
    return chosen


def lost_values(
    tables: dict[str, DataFrame], mapping: DataFrame | Iterable[dict], plan: Iterable[dict], main: str, feed: str | None = None
) -> DataFrame:
    """column_name, lost: per mapped column how many values that are not blank its type cannot hold."""
    chosen = {t: e for t, e in chosen_columns(mapping, feed).items() if e != "NULL"}
    types = {c.name: SPARK_TYPES[c.type] for c in TARGET_COLUMNS}
    names = [n for n in TARGET_NAMES if n in chosen]
    counts = [
        f"count_if(trim(CAST({chosen[n]} AS STRING)) <> '' AND {cast_value(chosen[n], types[n])} IS NULL) AS {quoted(n)}"
        for n in names
    ]
    one = join_sources(tables, main, plan).selectExpr(*counts)
    listed = ", ".join(f"'{n}', {quoted(n)}" for n in names)
    return one.selectExpr(f"stack({len(names)}, {listed}) AS (column_name, lost)")


def distinct_rows(target: DataFrame) -> DataFrame:
    """No two rows alike in the 31 columns; copies collapse before the shuffle."""
    return (
        target.groupBy(*TARGET_NAMES)
        .agg(F.min(ROW_ID).alias(ROW_ID))
        .select(ROW_ID, *TARGET_NAMES)
    )


def _expression(m: dict) -> str:
    if m.get("source_column"):
        return f"{quoted(m['source_table'])}.{quoted(m['source_column'])}"
    if m.get("is_derived") and m.get("derivation_logic"):
        return f"({m['derivation_logic']})"
    return "NULL"


def run_user_sql(tables: dict[str, DataFrame], sql: str) -> DataFrame:
    """Reviewer-written SQL over the source tables by name."""
    for name, df in tables.items():
        df.createOrReplaceTempView(quoted(name))
    return next(iter(tables.values())).sparkSession.sql(sql)
