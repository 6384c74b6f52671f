"""What type the values of text columns have, in one pass and without shuffling a value.

The types form a lattice: every boolean, integer or date is text, every integer a number, every date could
be a moment.  Each value gets the types that admit it as bits; the AND over a column leaves the types that
admit all its values, and the narrowest of these is the column's.  Beside it stands how many values each
type refuses, so one bad value among millions shows as an exception, not as a text column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercalith.functions.normalize import is_whitespace, literal, quoted

# The types from narrow to wide, and the form of their values.  A number with leading
# zeros is a code and stays text.
TYPES = (
    ("boolean", "lower({v}) IN ('true', 'false')"),
    ("integer", "{v} RLIKE '^[+-]?(0|[1-9][0-9]{{0,17}})$'"),
    ("number", "{v} RLIKE '^[+-]?(0|[1-9][0-9]*)([.][0-9]+)?([eE][+-]?[0-9]{{1,3}})?$'"),
    ("date", "{v} RLIKE '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$' AND try_cast({v} AS DATE) IS NOT NULL"),
    (
        "timestamp",
        "{v} RLIKE '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([ T][0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}}([.][0-9]{{1,6}})?)?)?$' "
        "AND try_cast({v} AS TIMESTAMP_NTZ) IS NOT NULL",
    ),
)


def inferred_types(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, column_name, data_type, inferred_type, filled and refused_<type> of every column.

    Text columns are judged by their values, trimmed; empty and blank ones are left out, and a column without any
    other is `string`.  Columns of other types keep theirs; `refused_*` is 0 there.
    """
    parts = []
    for table_no, (name, df) in enumerate(tables.items()):
        fields = df.schema.fields
        figures, rows = ["count(*) AS row_count"], []
        for i, f in enumerate(fields):
            if isinstance(f.dataType, T.StringType):
                figures += _figures(i, f.name)
                told = [f"_t{i}", f"_n{i}", *[f"_n{i} - _c{i}_{k}" for k in range(len(TYPES))]]
            else:
                figures.append(f"count({quoted(f.name)}) AS _n{i}")
                told = [literal(f.dataType.simpleString()), f"_n{i}", *["0L"] * len(TYPES)]
            rows.append(", ".join([str(i), literal(f.name), literal(f.dataType.simpleString()), *told]))
        named = ", ".join(["column_no", "column_name", "data_type", "inferred_type", "filled", *[f"refused_{t}" for t, _ in TYPES]])
        one = df.selectExpr(*figures)
        bits = {f"_t{i}": _narrowest(f"_b{i}") for i, f in enumerate(fields) if isinstance(f.dataType, T.StringType)}
        one = one.selectExpr("*", *[f"{sql} AS {c}" for c, sql in bits.items()])
        parts.append(one.selectExpr(f"{table_no} AS table_no", f"{literal(name)} AS table_name", f"stack({len(fields)}, {', '.join(rows)}) AS ({named})"))
    return reduce(DataFrame.unionByName, parts)


def _figures(i: int, name: str) -> list[str]:
    c = quoted(name)
    v = f"trim({c})"
    filled = f"{c} IS NOT NULL AND NOT ({is_whitespace(c)})"
    tests = [f"coalesce({t.format(v=v)}, false)" for _, t in TYPES]
    mask = " + ".join(f"IF({t}, {1 << k}, 0)" for k, t in enumerate(tests))
    counts = [f"count_if({filled} AND {t}) AS _c{i}_{k}" for k, t in enumerate(tests)]
    return [f"count_if({filled}) AS _n{i}", f"bit_and(IF({filled}, {mask}, NULL)) AS _b{i}", *counts]


def _narrowest(bits: str) -> str:
    cases = " ".join(f"WHEN {bits} & {1 << k} <> 0 THEN '{t}'" for k, (t, _) in enumerate(TYPES))
    return f"CASE {cases} ELSE 'string' END"


def typed(df: DataFrame, found: DataFrame, table: str) -> DataFrame:
    """`df` with its text columns cast to the types that `inferred_types` found for `table`; blanks become NULL."""
    casts = {"boolean": "BOOLEAN", "integer": "BIGINT", "number": "DOUBLE", "date": "DATE", "timestamp": "TIMESTAMP_NTZ"}
    known = {r["column_name"]: r["inferred_type"] for r in found.where(F.col("table_name") == table).collect()}  # one row per column
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.selectExpr(*[
        f"try_cast(trim({quoted(c)}) AS {casts[known[c]]}) AS {quoted(c)}" if c in text and known.get(c) in casts else quoted(c)
        for c in df.columns
    ])
