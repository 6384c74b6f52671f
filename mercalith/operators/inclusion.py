"""Joins found from values alone: which columns hold only values of some key column.

One narrow pass per table gives row and NULL counts and the smallest and largest value of every column.
A pair (column, key) stays a candidate if both are of one family of types, their ranges meet and the
key could be one: no NULL, and not more rows than its range has whole numbers.

One pass over the values of the columns left over answers all pairs at once.  Every column is a bit; each
value is met once with the bits of the columns that hold it, in words of 63 bits, by a hash aggregate
that combines map-side.  Values with the same bits are then counted, so what follows has a row for each
set of columns that occurs, not for each value: distinct values of a column, whether it is a key, and the
values two columns share are sums over those rows.
"""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercalith.functions.normalize import quoted
from mercalith.operators.profile import column_stats
from mercalith.session import stored

MIN_OVERLAP_PCT = 50.0
WORD_BITS = 63
# longer texts meet by their digest; ranges are those of the first characters
_TEXT = 64

SCHEMA = (
    "left_table string, left_key string, right_table string, right_key string, family string, "
    "join_type string, distinct_values bigint, matched_values bigint, overlap_pct double, same_name boolean"
)


@dataclass(frozen=True)
class Column:
    number: int
    table: str
    name: str
    family: str
    kind: str
    value: str
    rows: int = 0
    filled: int = 0
    low: object = None
    high: object = None

    @property
    def may_be_key(self) -> bool:
        if not self.rows or self.filled < self.rows:
            return False
        return self.kind != "bigint" or self.high - self.low + 1 >= self.rows


def stem(column: str) -> str:
    """A column name without its one- or two-letter table prefix."""
    return re.sub(r"^[a-z]{1,2}_", "", column.lower())


def typed_value(name: str, data_type: T.DataType) -> tuple[str, str, str] | None:
    """(family, kind of value, SQL text of the value): equal values of a family are equal as such.

    None for types that are no keys: booleans, binary and nested ones.
    """
    c = quoted(name)
    if isinstance(data_type, T.IntegralType):
        return "integral", "bigint", f"CAST({c} AS BIGINT)"
    if isinstance(data_type, T.DateType):
        return "date", "bigint", f"CAST(unix_date({c}) AS BIGINT)"
    if isinstance(data_type, T.TimestampType):
        return "timestamp", "bigint", f"unix_micros({c})"
    if isinstance(data_type, T.TimestampNTZType):
        return "timestamp_ntz", "bigint", f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})"
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return "fraction", "double", f"CAST(CASE WHEN NOT isnan({c}) THEN {c} END AS DOUBLE)"
    if isinstance(data_type, T.DecimalType):
        if data_type.scale <= 18 and data_type.precision - data_type.scale <= 20:
            return "decimal", "decimal(38,18)", f"CAST({c} AS DECIMAL(38,18))"
        return f"decimal({data_type.precision},{data_type.scale})", "string", f"CAST({c} AS STRING)"
    if isinstance(data_type, T.StringType):
        return "string", "string", f"CAST({c} AS STRING)"
    return None


def described(tables: dict[str, DataFrame]) -> list[Column]:
    """Every column that could be a key or refer to one, with its counts and range; one row of the
    catalogue's size is fetched for each table."""
    found: list[Column] = []
    for table, df in tables.items():
        mine = []
        for f in df.schema.fields:
            typed = typed_value(f.name, f.dataType)
            if typed:
                mine.append((f.name, *typed))
        if not mine:
            continue
        figures = ["count(*) AS n"]
        for i, (_, _, kind, value) in enumerate(mine):
            ranged = f"left({value}, {_TEXT})" if kind == "string" else value
            figures += [f"count({value}) AS c{i}", f"min({ranged}) AS l{i}", f"max({ranged}) AS h{i}"]
        r = df.selectExpr(*figures).first()
        found += [
            Column(len(found) + i, table, name, family, kind, value, r["n"], r[f"c{i}"], r[f"l{i}"], r[f"h{i}"])
            for i, (name, family, kind, value) in enumerate(mine)
        ]
    return found


def candidate_pairs(columns: list[Column], min_overlap_pct: float, same_name: bool) -> list[tuple[Column, Column]]:
    """(referring column, possible key) worth testing."""
    found = []
    for key in columns:
        if not key.may_be_key:
            continue
        for c in columns:
            if c.table == key.table or c.family != key.family or not c.filled or (same_name and stem(c.name) != stem(key.name)):
                continue
            inside = key.low <= c.low and c.high <= key.high
            meet = key.low <= c.high and c.low <= key.high
            if inside if min_overlap_pct >= 100 else meet:
                found.append((c, key))
    return found


def _held_by(tables: dict[str, DataFrame], columns: list[Column]) -> DataFrame | None:
    """(columns, n): for columns of one kind of value, how many values exactly these columns hold."""
    if not columns:
        return None
    bit = {c: i for i, c in enumerate(columns)}
    words = -(-len(columns) // WORD_BITS)
    parts = []
    for table, df in tables.items():
        mine = [c for c in columns if c.table == table]
        if mine:
            rows = ", ".join(f"{bit[c]}, {c.value}" for c in mine)
            parts.append(df.selectExpr(f"stack({len(mine)}, {rows}) AS (bit, value)").where("value IS NOT NULL"))
    cells = reduce(DataFrame.unionByName, parts)
    if columns[0].kind == "string":
        cells = cells.selectExpr("bit", f"IF(length(value) > {_TEXT}, '#' || sha2(value, 256), value) AS value")
    held = cells.groupBy("value").agg(
        *[F.expr(f"bit_or(IF(bit div {WORD_BITS} = {w}, shiftleft(1L, bit % {WORD_BITS}), 0L))").alias(f"w{w}") for w in range(words)]
    )
    names = [f"w{w}" for w in range(words)]
    counted = held.groupBy(*names).agg(F.count("*").alias("n"))
    numbers = ", ".join(str(c.number) for c in columns)
    listed = (
        f"transform(filter(sequence(0, {len(columns) - 1}), "
        f"b -> shiftright(array({', '.join(names)})[b div {WORD_BITS}], b % {WORD_BITS}) & 1L = 1L), b -> array({numbers})[b])"
    )
    return counted.selectExpr(f"{listed} AS columns", "n")


def shared_values(tables: dict[str, DataFrame], pairs: list[tuple[Column, Column]]) -> DataFrame:
    """(a, b, n): the number of values that columns a and b share, for keys b, and for a = b of all columns of `pairs`."""
    spark = next(iter(tables.values())).sparkSession
    used = sorted({c for p in pairs for c in p}, key=lambda c: c.number)
    keys = sorted({key.number for _, key in pairs})
    parts = [_held_by(tables, [c for c in used if c.kind == kind]) for kind in sorted({c.kind for c in used})]
    if not parts:
        return spark.createDataFrame([], "a int, b int, n bigint")
    held = reduce(DataFrame.unionByName, parts).selectExpr("columns", "n", "explode(columns) AS a")
    wanted = f"filter(columns, c -> c = a OR array_contains(array({', '.join(map(str, keys))}), c))"
    return held.selectExpr("a", f"explode({wanted}) AS b", "n").groupBy("a", "b").agg(F.sum("n").alias("n"))


def inclusions(
    tables: dict[str, DataFrame],
    min_overlap_pct: float = MIN_OVERLAP_PCT,
    same_name: bool = False,
    drop_implied: bool = True,
) -> DataFrame:
    """Foreign keys by inclusion of values, whatever the columns are called (see SCHEMA).

    The right side is a key of its table, no NULL and every value different, with no fewer values than the left.  `overlap_pct` is the share of
    the left column's values that are values of the key; INNER keeps every left row.  `same_name` keeps only
    pairs of the same name but for a prefix.  With `drop_implied` a whole inclusion goes that two others
    imply: a in b and b in c, where c has more values than b.  Empty tables and columns without a value refer to nothing.
    """
    spark = next(iter(tables.values())).sparkSession
    columns = described(tables)
    pairs = candidate_pairs(columns, min_overlap_pct, same_name)
    if not pairs:
        return spark.createDataFrame([], SCHEMA)
    # as many rows as pairs of columns
    shared = stored(shared_values(tables, pairs), "shared-values")
    named = _pairs_frame(spark, pairs)
    own = shared.where("a = b").select(F.col("a").alias("own"), F.col("n").alias("values"))
    both = (
        named.join(own.select(F.col("own").alias("a"), F.col("values").alias("distinct_values")), "a")
        .join(own.select(F.col("own").alias("b"), F.col("values").alias("key_values")), "b")
        .where("key_values = key_rows AND distinct_values <= key_values")
        .join(shared.withColumnRenamed("n", "matched_values"), ["a", "b"])
        .withColumn("overlap_pct", F.expr("round(matched_values * 100D / distinct_values, 2)"))
        .where(F.col("overlap_pct") >= min_overlap_pct)
    )
    if drop_implied:
        both = stored(both, "inclusions")
        whole = both.where("matched_values = distinct_values").select("a", "b", "distinct_values", "key_values")
        on = whole.selectExpr("a AS middle", "b AS c", "distinct_values AS middle_values", "key_values AS c_values")
        implied = whole.join(on, F.col("b") == F.col("middle")).where("a <> c AND c_values > middle_values").selectExpr("a", "c AS b").distinct()
        both = both.join(implied, ["a", "b"], "left_anti")
    return both.selectExpr(
        "left_table", "left_key", "right_table", "right_key", "family",
        "CASE WHEN matched_values = distinct_values AND left_nulls = 0 THEN 'INNER' ELSE 'LEFT' END AS join_type",
        "distinct_values", "matched_values", "overlap_pct", "same_name",
    )


def _pairs_frame(spark: SparkSession, pairs: list[tuple[Column, Column]]) -> DataFrame:
    return spark.createDataFrame(
        [
            (c.number, k.number, c.table, c.name, k.table, k.name, c.family, c.rows - c.filled, k.rows, stem(c.name) == stem(k.name))
            for c, k in pairs
        ],
        "a int, b int, left_table string, left_key string, right_table string, right_key string, family string, "
        "left_nulls bigint, key_rows bigint, same_name boolean",
    )


# ---- composite keys --------------------------------------------------------------------------

SLICES = 64
PARALLEL_TABLES = 4


def composite_keys(df: DataFrame, max_columns: int | None = None, name: str = "t", distinct: dict[str, int] | None = None) -> DataFrame:
    """(table_name, key_columns, n_columns): the minimal sets of two or more columns without NULL that identify a row.

    Level by level: sets of k columns none of whose parts is a key, each with a product of distinct counts
    that reaches the number of rows.  All sets of a level are tested together, twice: on the rows whose
    hash of one column of the set falls into one of SLICES slices (equal rows of a set fall into the same), which refutes
    nearly all, and the ones left over on all rows.  `distinct` may bring the distinct counts of the columns, else
    they are counted.  Without `max_columns` the search goes on until no set is left; it stops at once where whole
    rows repeat, as then no set of columns is a key.
    """
    spark = df.sparkSession
    schema = "table_name string, key_columns string, n_columns int"
    typed = [f.name for f in df.schema.fields if typed_value(f.name, f.dataType) or isinstance(f.dataType, T.BooleanType)]
    if not typed:
        return spark.createDataFrame([], schema)
    counts = df.selectExpr("count(*) AS n", *[f"count({quoted(c)}) AS c{i}" for i, c in enumerate(typed)]).first()
    rows = counts["n"]
    full = [c for i, c in enumerate(typed) if counts[f"c{i}"] == rows]
    if not rows or not full:
        return spark.createDataFrame([], schema)
    narrow = stored(df.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(full)]), "key-columns")
    at = range(len(full))
    if distinct is None:
        counted = column_stats({"t": narrow}).select("column_name", "distinct_count").collect()  # one row per column
        distinct = {full[int(r["column_name"][1:])]: r["distinct_count"] for r in counted}
    sizes = [distinct[c] for c in full]
    keys: list[tuple[int, ...]] = [(i,) for i in at if sizes[i] == rows]
    rest = [i for i in at if sizes[i] < rows]
    found = []
    last = min(len(rest), max_columns or len(rest))
    # the sets of one level are refuted by themselves, so whole rows need no test before it
    if len(rest) > 1 and (last == 2 or not _refuted(narrow, [tuple(rest)], None)):
        level = 2
        while level <= last:
            sets = []
            for s in combinations(rest, level):
                product = reduce(lambda a, b: a * b, (sizes[i] for i in s))
                if product >= rows and not any(set(k) <= set(s) for k in keys):
                    sets.append(s)
            if not sets and not any(not any(set(k) <= set(s) for k in keys) for s in combinations(rest, level)):
                break
            for part in (SLICES, None):
                gone = _refuted(narrow, sets, part, sizes)
                sets = [s for i, s in enumerate(sets) if i not in gone]
            keys += sets
            found += sets
            level += 1
    listed = [(name, ", ".join(full[i] for i in s), len(s)) for s in found]
    return spark.createDataFrame(listed, schema)


def _refuted(narrow: DataFrame, sets: list[tuple[int, ...]], slices: int | None, sizes: list[int] | None = None) -> set[int]:
    """The numbers of the sets that repeat, in a slice of the rows or in all; one aggregate for all sets.

    A slice is that of the set's column with the most values (`sizes`; else its first): rows equal in the set are
    equal there, and a row is hashed once for each column, and as a whole set in the slice only.
    """
    if not sets:
        return set()
    # 128 bits: of two hashes with different seeds, as the second starts from the first
    entry = lambda i, cols: f"named_struct('s', {i}, 'h', xxhash64({cols}), 'g', xxhash64('#', {cols}))"
    entries = [entry(i, ", ".join(f"c{j}" for j in s)) for i, s in enumerate(sets)]
    if slices:
        by = [max(s, key=lambda j: sizes[j]) if sizes else s[0] for s in sets]
        inside = [f"pmod(xxhash64(c{j}), {slices}) = 0 AS in{j}" for j in sorted(set(by))]
        kept = ", ".join(f"CASE WHEN in{j} THEN {e} END" for j, e in zip(by, entries))
        some = narrow.selectExpr("*", *inside).where(" OR ".join(f"in{j}" for j in sorted(set(by))))
        each = some.selectExpr(f"inline(array_compact(array({kept})))")
    else:
        each = narrow.selectExpr(f"inline(array({', '.join(entries)}))")
    twice = each.groupBy("s", "h", "g").agg(F.count("*").alias("n")).where("n > 1")
    return {r["s"] for r in twice.select("s").distinct().collect()}


def table_composite_keys(tables: dict[str, DataFrame], max_columns: int | None = None) -> DataFrame:
    """`composite_keys` of several tables, which are searched side by side, so a small one fills idle cores."""
    spark = next(iter(tables.values())).sparkSession
    search = inheritable_thread_target(spark)(lambda name, df: composite_keys(df, max_columns, name))
    with ThreadPoolExecutor(max_workers=PARALLEL_TABLES) as pool:
        found = list(pool.map(search, tables, tables.values()))
    return reduce(DataFrame.unionByName, found)


