"""Reading, profiling, discovery, mapping and master-table queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mercalith.operators import discovery, inclusion, mapping, profile, reference_values
from mercalith.plans import master
from mercalith.session import scratch_path, stored
from mercalith.sources.files import ingest, pick_largest, read_csv, table_stats
from mercalith.spec import TARGET_COLUMNS
from workload.oracle import over_target
from workload.registry import query
from workload.target_view import TABLES, table, target

# Columns of the given tables, as name:type.
SCHEMAS = {
    "region": "r_regionkey:int r_name:string",
    "nation": "n_nationkey:int n_name:string n_regionkey:int",
    "customer": "c_custkey:bigint c_name:string c_nationkey:int c_acctbal:double c_mktsegment:string",
    "supplier": "s_suppkey:bigint s_name:string s_nationkey:int s_acctbal:double",
    "part": "p_partkey:bigint p_name:string p_brand:string p_type:string p_size:int p_retailprice:double",
    "orders": "o_orderkey:bigint o_custkey:bigint o_orderstatus:string o_totalprice:double "
    "o_orderdate:timestamp_ntz o_orderpriority:string",
    "lineitem": "l_orderkey:bigint l_partkey:bigint l_suppkey:bigint l_linenumber:int "
    "l_quantity:double l_extendedprice:double l_discount:double l_tax:double "
    "l_returnflag:string l_linestatus:string l_shipdate:timestamp_ntz",
    "events": "event_id:bigint ts:timestamp_ntz user_id:bigint event_type:string value:double props:string",
    "documents": "doc_id:bigint text:string lang:string source:string n_chars:bigint",
    "embeddings": "vec_id:bigint embedding:array<float> label:int",
    "pages": "page_id:bigint url:string html:string",
    "benchmark": "item_id:bigint text:string",
    "labels": "doc_id:bigint quality:int toxic:int",
    "conversations": "conv_id:bigint turn:bigint role:string text:string",
}
TPCH = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
ALL = tuple(SCHEMAS)


def _columns(name: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in SCHEMAS[name].split()]


def _tables(spark, sf_dir, names) -> dict:
    return {n: table(spark, sf_dir, n) for n in names}


def _register_views(spark, sf_dir, *names) -> None:
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


# ---- sources ---------------------------------------------------------------------------------

_CSV_ROWS = """
SELECT lpad(CAST(c_custkey AS STRING), 8, '0') AS code,
       c_name || CASE WHEN c_custkey % 5 = 0 THEN chr(10) ELSE ', "' END || c_mktsegment || '"' AS label,
       CASE WHEN c_custkey % 7 = 0 THEN 'NA' WHEN c_custkey % 11 = 0 THEN NULL
            ELSE c_mktsegment END AS segment
FROM customer"""


@query(
    "scan_csv",
    "SELECT code, label, segment, nullif(segment, 'NA') AS segment_or_null "
    f"FROM ({_CSV_ROWS})",
)
def scan_csv(spark, sf_dir):
    _register_views(spark, sf_dir, "customer")
    path = scratch_path(spark, "csv")
    spark.sql(_CSV_ROWS).write.option("header", True).option("escape", '"').csv(path)
    literal_words = read_csv(spark, path, multi_line=True)
    as_null = read_csv(spark, path, pandas_nulls=True, multi_line=True).selectExpr("code", "segment AS segment_or_null")
    return literal_words.join(as_null, "code").select("code", "label", "segment", "segment_or_null")


@query(
    "ingest_files",
    "SELECT 'customers' AS table_name, count(*) AS row_count, 3::BIGINT AS column_count FROM customer "
    "UNION ALL SELECT 'orders', count(*), 6 FROM orders "
    "UNION ALL SELECT 'regions', count(*), 2 FROM region",
)
def ingest_files(spark, sf_dir):
    _register_views(spark, sf_dir, "customer")
    root = scratch_path(spark, "ingest")
    spark.sql(_CSV_ROWS).write.option("header", True).option("escape", '"').csv(f"{root}/customers.csv")
    table(spark, sf_dir, "region").write.json(f"{root}/regions.json")
    loaded = ingest(
        spark, [f"{root}/customers.csv", f"{sf_dir}/orders.parquet", f"{root}/regions.json"], multi_line=True
    )
    return table_stats(loaded).drop("load_order")


_SIZES = _union(
    f"SELECT '{t}' AS table_name, {i}::BIGINT AS load_order, count(*) AS row_count, "
    f"{len(_columns(t))}::BIGINT AS column_count FROM {t}"
    for i, t in enumerate(ALL)
)


@query("table_stats", _SIZES)
def table_stats_query(spark, sf_dir):
    return table_stats({n: table(spark, sf_dir, n) for n in ALL})


@query("pick_largest", f"SELECT * FROM ({_SIZES}) ORDER BY row_count DESC, load_order LIMIT 1")
def pick_largest_query(spark, sf_dir):
    return pick_largest({n: table(spark, sf_dir, n) for n in ALL})


# ---- profile ---------------------------------------------------------------------------------


def _stats_sql(names, source=None) -> str:
    """One row per column with the raw statistics, counted column by column."""
    parts = []
    for t in names:
        for i, (c, kind) in enumerate(_columns(t)):
            blank = f"count(*) FILTER (WHERE regexp_full_match({c}, '\\s*'))" if kind == "string" else "0"
            parts.append(
                f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{kind}' AS data_type, "
                f"count(*) AS row_count, count(*) - count({c}) AS null_count, "
                f"count(DISTINCT {c}) AS distinct_count, {blank} AS blank_count FROM {t}"
            )
    return _union(parts)


_PCT = "CASE WHEN row_count = 0 THEN 0.0 ELSE round(100.0 * null_count / row_count, 2) END"
_TARGET_TYPES = {"integer": "int", "string": "string", "date": "date"}


def _target_stats_sql() -> str:
    parts = []
    for c in TARGET_COLUMNS:
        blank = f"count(*) FILTER (WHERE regexp_full_match({c.name}, '\\s*'))" if c.type == "string" else "0"
        parts.append(
            f"SELECT 'target' AS table_name, '{c.name}' AS column_name, "
            f"'{_TARGET_TYPES[c.type]}' AS data_type, "
            f"count(*) AS row_count, count(*) - count({c.name}) AS null_count, "
            f"count(DISTINCT {c.name}) AS distinct_count, {blank} AS blank_count FROM target"
        )
    return over_target(f"SELECT *, {_PCT}::DOUBLE AS null_pct FROM ({_union(parts)})")


def _register_stat(name: str, columns: str, where: str = "true", spark_where: str | None = None, values: bool = False):
    @query(name, f"SELECT table_name, column_name, {columns} FROM ({_target_stats_sql()}) WHERE {where}")
    def run(spark, sf_dir):
        rows = {"target": target(spark, sf_dir).drop("row_id")}
        stats = (profile.column_stats(rows) if values else profile.fill_stats(rows)).where(spark_where or where)
        return stats.selectExpr("table_name", "column_name", *columns.split(", "))


_register_stat("null_count", "row_count, null_count")
_register_stat("null_pct", "null_pct")
_register_stat(
    "issue_high_null", "null_pct", "null_pct > 50",
    "exists(issues, x -> startswith(x, 'High null rate: '))",
)
_register_stat(
    "issue_all_null", "null_count", "row_count > 0 AND null_count = row_count",
    "array_contains(issues, 'Column is entirely null')",
)
_register_stat(
    "issue_constant", "distinct_count", "distinct_count = 1 AND row_count > 10",
    "array_contains(issues, 'Only 1 distinct value (constant column)')", values=True,
)


@query(
    "distinct_count",
    f"SELECT table_name, column_name, row_count, distinct_count FROM ({_stats_sql(ALL)})",
)
def distinct_count(spark, sf_dir):
    stats = profile.column_stats(_tables(spark, sf_dir, ALL))
    return stats.select("table_name", "column_name", "row_count", "distinct_count")


@query(
    "data_type",
    f"SELECT table_name, column_name, data_type, row_count - null_count AS filled FROM ({_stats_sql(ALL)})",
)
def data_type(spark, sf_dir):
    stats = profile.fill_stats(_tables(spark, sf_dir, ALL))
    return stats.selectExpr("table_name", "column_name", "data_type", "row_count - null_count AS filled")


@query(
    "issue_unique",
    f"SELECT table_name, column_name FROM ({_stats_sql(ALL)}) "
    "WHERE distinct_count = row_count AND row_count > 100",
)
def issue_unique(spark, sf_dir):
    stats = profile.column_stats(_tables(spark, sf_dir, ALL))
    return stats.where("array_contains(issues, 'All values unique (potential PK)')").select(
        "table_name", "column_name"
    )


@query(
    "issue_blank",
    "SELECT 'notes' AS table_name, 'note' AS column_name, "
    "count(*) FILTER (WHERE o_orderkey % 50 < 2) || ' values are blank/whitespace-only' AS issue "
    "FROM orders",
)
def issue_blank(spark, sf_dir):
    notes = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        "CASE o_orderkey % 50 WHEN 0 THEN '' WHEN 1 THEN ' \\t\\u00a0\\n' ELSE o_orderpriority END AS note",
    )
    return (
        profile.fill_stats({"notes": notes})
        .selectExpr("table_name", "column_name", "explode(issues) AS issue")
        .where("issue LIKE '%blank%'")
    )


_ORDER = {
    "region": ["r_regionkey"],
    "nation": ["n_nationkey"],
    "customer": ["c_custkey"],
    "supplier": ["s_suppkey"],
    "part": ["p_partkey"],
    "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber"],
    "events": ["event_id"],
    "documents": ["doc_id"],
    "embeddings": ["vec_id"],
    "pages": ["page_id"],
    "benchmark": ["item_id"],
    "labels": ["doc_id"],
    "conversations": ["conv_id", "turn"],
    "target": ["row_id"],
    "merchants": ["merchant_no"],
    "owners": ["owner_no"],
}
# engines write lists of floats differently
_UNSHOWN = ("embedding",)


def _samples_sql(names, k: int) -> str:
    parts = []
    for t in names:
        keys = ", ".join(_ORDER[t])
        columns = [c.name for c in TARGET_COLUMNS] if t == "target" else [c for c, _ in _columns(t)]
        for c in columns:
            value = "''" if c in _UNSHOWN else f"CAST({c} AS VARCHAR)"
            parts.append(
                f"SELECT '{t}' AS table_name, '{c}' AS column_name, coalesce(string_agg(v, ' | ' ORDER BY o, v), '') AS samples "
                f"FROM (SELECT row({keys}) AS o, {value} AS v FROM {t} WHERE {c} IS NOT NULL ORDER BY {keys}, v LIMIT {k})"
            )
    return _union(parts)


_SHOWN_SAMPLES = (
    f"IF(column_name IN ({', '.join(map(repr, _UNSHOWN))}), array_join(transform(sample_values, x -> ''), ' | '), "
    "array_join(sample_values, ' | ')) AS samples"
)


@query("sample_values", _samples_sql(ALL, 5))
def sample_values(spark, sf_dir):
    found = profile.sample_values(_tables(spark, sf_dir, ALL), _ORDER)
    return found.selectExpr("table_name", "column_name", _SHOWN_SAMPLES)


@query(
    "schema_summary",
    f"SELECT s.table_name, s.column_name, data_type, row_count, null_count, distinct_count, samples "
    f"FROM ({_stats_sql(ALL)}) s JOIN ({_samples_sql(ALL, 3)}) "
    "USING (table_name, column_name)",
)
def schema_summary(spark, sf_dir):
    report = profile.quality_report(_tables(spark, sf_dir, ALL), _ORDER, k=3)
    return report.selectExpr(
        "table_name", "column_name", "data_type", "row_count", "null_count", "distinct_count", _SHOWN_SAMPLES
    )


@query(
    "schema_first_rows",
    over_target(
        "SELECT CAST(row_id AS VARCHAR) AS row_id, coalesce(AggregatorID, 'NULL') AS AggregatorID, "
        "coalesce(CAID, 'NULL') AS CAID, coalesce(CAST(MCC2 AS VARCHAR), 'NULL') AS MCC2 "
        "FROM target ORDER BY target.row_id LIMIT 5"
    ),
)
def schema_first_rows(spark, sf_dir):
    rows = profile.first_rows(target(spark, sf_dir), ["row_id"])
    return rows.select("row_id", "AggregatorID", "CAID", "MCC2")


_ISSUES_N = (
    "(CASE WHEN null_pct > 50 THEN 1 ELSE 0 END + CASE WHEN null_pct = 100 THEN 1 ELSE 0 END + "
    "CASE WHEN distinct_count = 1 AND row_count > 10 THEN 1 ELSE 0 END + "
    "CASE WHEN distinct_count = row_count AND row_count > 100 THEN 1 ELSE 0 END + "
    "CASE WHEN blank_count > 0 THEN 1 ELSE 0 END)"
)


@query(
    "table_score",
    "SELECT table_name, max(row_count) AS row_count, round(greatest(0.0, "
    f"100 - avg(null_pct) - 5 * sum({_ISSUES_N})), 1)::DOUBLE AS overall_score "
    f"FROM (SELECT *, {_PCT} AS null_pct FROM ({_stats_sql(ALL)}) "
    f"UNION ALL SELECT * FROM ({_target_stats_sql()})) GROUP BY table_name",
)
def table_score(spark, sf_dir):
    tables = {**_tables(spark, sf_dir, ALL), "target": target(spark, sf_dir).drop("row_id")}
    return profile.table_scores(profile.column_stats(tables))


_ISSUE_TEXTS = (
    "list_filter([CASE WHEN null_pct > 50 THEN 'High null rate: ' || CAST(null_pct AS VARCHAR) || '%' END, "
    "CASE WHEN null_pct = 100 THEN 'Column is entirely null' END, "
    "CASE WHEN distinct_count = 1 AND row_count > 10 THEN 'Only 1 distinct value (constant column)' END, "
    "CASE WHEN distinct_count = row_count AND row_count > 100 THEN 'All values unique (potential PK)' END, "
    "CASE WHEN blank_count > 0 THEN blank_count || ' values are blank/whitespace-only' END], lambda x: x IS NOT NULL)"
)


@query(
    "quality_report",
    f"WITH s AS (SELECT *, {_PCT}::DOUBLE AS null_pct FROM ({_stats_sql(ALL)}) UNION ALL SELECT * FROM ({_target_stats_sql()})), "
    f"r AS (SELECT *, {_ISSUE_TEXTS} AS texts FROM s), "
    f"v AS ({_samples_sql(ALL, 5)} UNION ALL SELECT * FROM ({over_target(_samples_sql(('target',), 5))})) "
    "SELECT table_name, column_name, data_type, row_count, null_count, null_pct, distinct_count, array_to_string(texts, '; ') AS issues, samples, "
    "round(greatest(0.0, 100 - avg(null_pct) OVER t - 5 * sum(len(texts)) OVER t), 1)::DOUBLE AS overall_score "
    "FROM r JOIN v USING (table_name, column_name) WINDOW t AS (PARTITION BY table_name)",
)
def quality_report(spark, sf_dir):
    tables = {**_tables(spark, sf_dir, ALL), "target": target(spark, sf_dir)}
    report = profile.quality_report(tables, _ORDER, unread={"target": ["row_id"]})
    return report.selectExpr(
        "table_name", "column_name", "data_type", "row_count", "null_count", "null_pct", "distinct_count",
        "array_join(issues, '; ') AS issues", _SHOWN_SAMPLES, "overall_score",
    )


_WIDE = ("CAID", "BASEIIName", "PostalCode", "BusinessRegistrationID")


@query(
    "null_analysis_sql",
    over_target(
        "SELECT count(*) AS total_rows, "
        + ", ".join(
            f"count(*) - count({c}) AS {c}_null_count, "
            f"round(100.0 * (count(*) - count({c})) / count(*), 2) AS {c}_null_pct, "
            f"count(DISTINCT {c}) AS {c}_distinct"
            for c in _WIDE
        )
        + " FROM target"
    ),
)
def null_analysis_sql(spark, sf_dir):
    return profile.null_analysis(target(spark, sf_dir), list(_WIDE))


@query(
    "type_check_integer",
    "SELECT value, 'string' AS actual_type FROM (SELECT CASE WHEN o_orderkey % 3 = 0 "
    "THEN 'x' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END AS value FROM orders) "
    "WHERE TRY_CAST(value AS INTEGER) IS NULL ORDER BY value LIMIT 10",
)
def type_check_integer(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr(
        "CASE WHEN o_orderkey % 3 = 0 THEN 'x' || o_orderkey ELSE CAST(o_orderkey AS STRING) END AS value"
    )
    return profile.type_check(rows, "value", "integer")


@query(
    "type_check_date",
    "SELECT value, 'string' AS actual_type FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 "
    "THEN 'day ' || o_orderkey ELSE strftime(o_orderdate, '%Y%m%d') END AS value FROM orders) "
    "WHERE o_orderkey % 3 = 0 ORDER BY value LIMIT 10",
)
def type_check_date(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr(
        "CASE WHEN o_orderkey % 3 = 0 THEN 'day ' || o_orderkey "
        "ELSE date_format(o_orderdate, 'yyyyMMdd') END AS value"
    )
    return profile.type_check(rows, "value", "date", date_format=profile.DATE_FORMAT)


@query(
    "uniqueness_check",
    "SELECT l_orderkey, l_linenumber, count(*) AS dup_count FROM lineitem GROUP BY ALL "
    "HAVING count(*) > 1 ORDER BY dup_count DESC, l_orderkey, l_linenumber LIMIT 10",
)
def uniqueness_check(spark, sf_dir):
    return profile.uniqueness_check(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


# ---- keys, joins, fingerprints ---------------------------------------------------------------

_KEYED = TPCH + ("events", "documents", "labels", "conversations")
_JOINS = (
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("labels", "doc_id", "documents", "doc_id"),
)


@query(
    "discover_keys",
    f"SELECT table_name, column_name, data_type, row_count FROM ({_stats_sql(_KEYED)}) "
    "WHERE distinct_count = row_count AND null_count = 0 AND row_count > 0",
)
def discover_keys(spark, sf_dir):
    return discovery.key_columns(profile.column_stats(_tables(spark, sf_dir, _KEYED)))


@query(
    "discover_joins",
    "SELECT *, CASE WHEN matched_values = distinct_values THEN 'INNER' ELSE 'LEFT' END AS join_type, "
    "round(100.0 * matched_values / distinct_values, 2) AS overlap_pct FROM ("
    + _union(
        f"SELECT '{ft}' AS left_table, '{fc}' AS left_key, '{pt}' AS right_table, "
        f"'{pc}' AS right_key, count(DISTINCT f.{fc}) AS distinct_values, "
        f"count(DISTINCT p.{pc}) AS matched_values FROM {ft} f LEFT JOIN {pt} p ON f.{fc} = p.{pc}"
        for ft, fc, pt, pc in _JOINS
    )
    + ")",
)
def discover_joins(spark, sf_dir):
    return discovery.discover_joins(_tables(spark, sf_dir, _KEYED))


_FAMILIES = {"int": "integral", "bigint": "integral", "double": "fraction"} | {
    k: k for k in ("string", "date", "timestamp_ntz", "timestamp")
}


def _inclusions_sql(overlap: float) -> str:
    """Every pair of columns of one family, by the distinct values of both; keys by their own counts."""
    columns = [(t, c, _FAMILIES[kind]) for t in ALL for c, kind in _columns(t) if kind in _FAMILIES]
    columns += [("target", "row_id", "integral")] + [("target", c.name, _FAMILIES[_TARGET_TYPES[c.type]]) for c in TARGET_COLUMNS]
    values = ", ".join(f"d{i} AS MATERIALIZED (SELECT DISTINCT {c} AS v FROM {t} WHERE {c} IS NOT NULL)" for i, (t, c, _) in enumerate(columns))
    facts = _union(
        f"SELECT {i} AS no, '{t}' AS t, '{c}' AS c, '{f}' AS family, count(*) AS n, count({c}) AS filled, "
        f"(SELECT count(*) FROM d{i}) AS distinct_values FROM {t}" for i, (t, c, f) in enumerate(columns)
    )
    shared = _union(
        f"SELECT {i} AS a, {j} AS b, (SELECT count(*) FROM d{i} SEMI JOIN d{j} USING (v)) AS matched_values"
        for i, (t, _, f) in enumerate(columns) for j, (u, _, g) in enumerate(columns) if t != u and f == g
    )
    stem = lambda c: f"regexp_replace(lower({c}), '^[a-z]{{1,2}}_', '')"
    return over_target(
        f"""SELECT left_table, left_key, right_table, right_key, family, join_type, distinct_values, matched_values, overlap_pct, same_name
        FROM (
        WITH {values}, facts AS ({facts}), shared AS ({shared}),
        held AS (
          SELECT a, b, x.t AS left_table, x.c AS left_key, y.t AS right_table, y.c AS right_key, x.family,
                 CASE WHEN matched_values = x.distinct_values AND x.filled = x.n THEN 'INNER' ELSE 'LEFT' END AS join_type,
                 x.distinct_values, y.distinct_values AS key_values, matched_values,
                 round(100.0 * matched_values / x.distinct_values, 2)::DOUBLE AS overlap_pct,
                 {stem("x.c")} = {stem("y.c")} AS same_name
          FROM shared JOIN facts x ON x.no = a JOIN facts y ON y.no = b
          WHERE y.n > 0 AND y.distinct_values = y.n AND x.filled > 0 AND x.distinct_values <= y.distinct_values AND matched_values * 100.0 / x.distinct_values >= {overlap}),
        whole AS (SELECT * FROM held WHERE matched_values = distinct_values)
        SELECT * FROM held h WHERE NOT EXISTS (
          SELECT 1 FROM whole p JOIN whole q ON p.b = q.a WHERE p.a = h.a AND q.b = h.b AND q.key_values > q.distinct_values))"""
    )


@query("discover_joins_by_content", _inclusions_sql(90))
def discover_joins_by_content(spark, sf_dir):
    tables = _tables(spark, sf_dir, ALL) | {"target": target(spark, sf_dir)}
    return inclusion.inclusions(tables, 90)


def _composite_sql() -> str:
    """All pairs of columns of all tables, each by its own count of distinct pairs."""
    parts, singles = [], []
    for t in ALL:
        names = [c for c, kind in _columns(t) if kind != "array<float>"]
        alone = ", ".join(f"count(DISTINCT {c}) AS {c}_d, count({c}) AS {c}_n" for c in names)
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                parts.append(
                    f"SELECT '{t}' AS table_name, '{a}, {b}' AS key_columns, 2 AS n_columns FROM s_{t} WHERE n > 0 "
                    f"AND {a}_n = n AND {b}_n = n AND {a}_d < n AND {b}_d < n "
                    f"AND (SELECT count(*) FROM (SELECT DISTINCT {a}, {b} FROM {t})) = n"
                )
        singles.append(f"s_{t} AS MATERIALIZED (SELECT count(*) AS n, {alone} FROM {t})")
    return f"WITH {', '.join(singles)} {_union(parts)}"


@query("discover_composite_keys", _composite_sql())
def discover_composite_keys(spark, sf_dir):
    return inclusion.table_composite_keys(_tables(spark, sf_dir, ALL), max_columns=2)


_ROLES = {
    "region": "reference", "nation": "dimension", "customer": "dimension", "part": "reference",
    "supplier": "dimension", "orders": "dimension", "lineitem": "fact",
}


@query(
    "table_roles",
    "SELECT *, row_count = max(row_count) OVER () AS is_main FROM ("
    + _union(
        f"SELECT '{t}' AS table_name, count(*) AS row_count, "
        f"{sum(j[0] == t for j in _JOINS)}::BIGINT AS outgoing, "
        f"{sum(j[2] == t for j in _JOINS)}::BIGINT AS incoming, '{role}' AS role FROM {t}"
        for t, role in _ROLES.items()
    )
    + ")",
)
def table_roles(spark, sf_dir):
    tables = _tables(spark, sf_dir, TPCH)
    # both are read several times
    stats = stored(profile.column_stats(tables), "stats")
    return discovery.table_roles(stats, stored(discovery.discover_joins(tables), "joins"))


@query(
    "composite_key_check",
    "SELECT count(*) AS row_count, (SELECT count(*) FROM (SELECT DISTINCT conv_id, turn FROM conversations)) "
    "AS distinct_count, count(*) = (SELECT count(*) FROM (SELECT DISTINCT conv_id, turn FROM conversations)) "
    "AS is_key, 'conv_id, turn' AS key FROM conversations",
)
def composite_key_check(spark, sf_dir):
    return discovery.composite_key_check(table(spark, sf_dir, "conversations"), ["conv_id", "turn"])


_CATALOGUE = """
SELECT 'feed-' || CAST(user_id AS STRING) AS feed, event_type AS table_name,
       'c' || CAST(event_id % 6 AS STRING) AS column_name FROM events"""
_PRINTS = f"""
SELECT feed, sha256(string_agg(line, '|' ORDER BY table_name)) AS fingerprint FROM (
  SELECT feed, table_name, table_name || ':' || string_agg(DISTINCT column_name, ',' ORDER BY column_name) AS line
  FROM ({_CATALOGUE}) GROUP BY feed, table_name) GROUP BY feed"""


@query("schema_fingerprint", _PRINTS)
def schema_fingerprint(spark, sf_dir):
    _register_views(spark, sf_dir, "events")
    return discovery.fingerprints(spark.sql(_CATALOGUE))


@query(
    "match_template",
    f"WITH p AS ({_PRINTS}), t AS (SELECT fingerprint, 'from ' || min(feed) AS name FROM p "
    "WHERE feed LIKE '%3' GROUP BY fingerprint) "
    "SELECT feed, p.fingerprint, name, name IS NOT NULL AS matched FROM p LEFT JOIN t USING (fingerprint)",
)
def match_template(spark, sf_dir):
    _register_views(spark, sf_dir, "events")
    prints = discovery.fingerprints(spark.sql(_CATALOGUE))
    templates = (
        prints.where("feed LIKE '%3'").groupBy("fingerprint").agg(F.expr("'from ' || min(feed) AS name"))
    )
    return discovery.match_templates(prints, templates)


# ---- mappings --------------------------------------------------------------------------------

_NAMED = ", ".join(
    f"({i}, '{name}')" for i, name in enumerate([c.name for c in TARGET_COLUMNS] + ["Extra1", "Extra2"])
)
_MAPPINGS = f"""
SELECT 'feed-' || CAST(o_custkey % 40 AS STRING) AS feed, s.target AS target,
       'source' || CAST(o_custkey % 3 AS STRING) AS source_table,
       CASE WHEN o_orderkey % 5 < 3 THEN 'col' || CAST(o_orderkey % 9 AS STRING)
            WHEN o_orderkey % 5 = 3 THEN '' END AS source_column,
       (o_orderkey % 100) / 100.0 AS confidence, o_orderkey % 25 = 4 AS is_derived
FROM orders JOIN (VALUES {_NAMED}) AS s(i, target) ON (o_orderkey * 7 + o_custkey) % 61 = s.i"""
_SPEC = "spec(pos, target, need) AS (VALUES " + ", ".join(
    f"({i}, '{c.name}', '{c.need}')" for i, c in enumerate(TARGET_COLUMNS)
) + ")"


def _mappings(spark, sf_dir):
    _register_views(spark, sf_dir, "orders")
    return spark.sql(_MAPPINGS).withColumn("confidence", F.col("confidence").cast("double"))


def _missing_sql(condition: str, need: str) -> str:
    return (
        f"coalesce((SELECT string_agg(s.target, ',' ORDER BY s.pos) FROM spec s WHERE s.need IN ({need}) "
        f"AND NOT EXISTS (SELECT 1 FROM m WHERE m.feed = f.feed AND m.target = s.target AND {condition})), '')"
    )


_IS_MAPPED = "(m.source_column <> '' OR m.is_derived)"
_FEEDS = f"WITH m AS ({_MAPPINGS}), {_SPEC}, f AS (SELECT DISTINCT feed FROM m) "


@query(
    "completeness",
    _FEEDS + "SELECT feed, 31::BIGINT AS total_columns, mapped_columns, "
    "round(100.0 * mapped_columns / 31, 1) AS coverage_pct, "
    f"{_missing_sql(_IS_MAPPED, repr('required'))} AS missing_required, "
    f"{_missing_sql(_IS_MAPPED, repr('submerchant'))} AS missing_submerchant_required, "
    f"{_missing_sql(_IS_MAPPED, repr('optional'))} AS missing_optional "
    "FROM (SELECT feed, count(DISTINCT CASE WHEN source_column <> '' OR is_derived THEN target END) "
    "AS mapped_columns FROM m GROUP BY feed) f",
)
def completeness(spark, sf_dir):
    lists = ("missing_required", "missing_submerchant_required", "missing_optional")
    return mapping.completeness(_mappings(spark, sf_dir)).withColumns(
        {c: F.array_join(c, ",") for c in lists}
    )


@query(
    "mapping_coverage",
    _FEEDS + "SELECT f.feed, s.target, s.need, EXISTS (SELECT 1 FROM m WHERE m.feed = f.feed "
    f"AND m.target = s.target AND {_IS_MAPPED}) AS mapped FROM f, spec s",
)
def mapping_coverage(spark, sf_dir):
    return mapping.coverage(_mappings(spark, sf_dir))


@query(
    "unmapped",
    _FEEDS + f"SELECT feed, {_missing_sql('true', repr('required'))} AS unmapped_required, "
    f"{_missing_sql('true', repr('submerchant') + ', ' + repr('optional'))} AS unmapped_optional FROM f",
)
def unmapped(spark, sf_dir):
    lists = ("unmapped_required", "unmapped_optional")
    return mapping.unmapped(_mappings(spark, sf_dir)).withColumns(
        {c: F.array_join(c, ",") for c in lists}
    )


@query(
    "low_confidence",
    f"SELECT feed, target, source_table, source_column, CAST(confidence AS DOUBLE) AS confidence "
    f"FROM ({_MAPPINGS}) WHERE source_column <> '' AND confidence < 0.7",
)
def low_confidence(spark, sf_dir):
    return mapping.low_confidence(_mappings(spark, sf_dir)).select(
        "feed", "target", "source_table", "source_column", "confidence"
    )


@query(
    "rank_candidates",
    f"""WITH spec(pos, target, kind) AS (VALUES {", ".join(f"({i}, '{c.name}', '{c.type}')" for i, c in enumerate(TARGET_COLUMNS))}),
    s AS (SELECT table_name, column_name, data_type, {_PCT} AS null_pct,
            lower(regexp_replace(regexp_replace(column_name, '^[A-Za-z]{{1,2}}_', ''), '[^A-Za-z0-9]', '', 'g')) AS src
          FROM ({_stats_sql(ALL)})),
    c AS (SELECT target, table_name AS source_table, column_name AS source_column, round(
            0.4 * (1.0 - levenshtein(src, lower(target)) / greatest(length(src), length(target))::DOUBLE)
            + 0.1 * CASE WHEN (kind = 'integer' AND data_type IN ('int', 'bigint')) OR (kind = 'string' AND data_type = 'string')
                           OR (kind = 'date' AND data_type = 'timestamp_ntz') THEN 1 ELSE 0 END
            + 0.1 * (1.0 - null_pct / 100.0), 4)::DOUBLE AS confidence
          FROM s, spec)
    SELECT *, row_number() OVER (PARTITION BY target ORDER BY confidence DESC, source_table, source_column)::BIGINT AS rank
    FROM c QUALIFY rank <= 5""",
)
def rank_candidates(spark, sf_dir):
    ranked = mapping.rank_candidates(profile.column_stats(_tables(spark, sf_dir, ALL)))
    return ranked.selectExpr(
        "target", "CAST(rank AS BIGINT) AS rank", "source_table", "source_column", "confidence"
    )


# ---- master table ----------------------------------------------------------------------------

# Raw tables of one acquirer, cut from the given ones.
RAW = {
    "merchants": """
SELECT o_orderkey AS merchant_no, 'SUB' || CAST(o_orderkey AS STRING) AS sub_merchant_id,
       'MID' || CAST(o_orderkey AS STRING) AS assigned_id, 'CA' || CAST(o_orderkey AS STRING) AS acceptor,
       o_custkey AS owner_no, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey % 150 END AS aggregator_no,
       'Shop ' || CAST(o_orderkey % 500 AS STRING) AS trading_name, o_orderdate AS signed_on,
       5000 + o_custkey % 100 AS mcc FROM orders""",
    "owners": """
SELECT c_custkey AS owner_no, c_name AS legal_name, c_nationkey AS country_no,
       c_mktsegment AS segment FROM customer""",
    "aggregators": "SELECT s_suppkey AS aggregator_no, s_name AS aggregator_name FROM supplier",
    "countries": "SELECT n_nationkey AS country_no, n_name AS country_name FROM nation",
}
_RAW_CTES = "WITH " + ", ".join(f"{n} AS ({sql})" for n, sql in RAW.items()) + " "
_RAW_JOIN = (
    "FROM merchants m LEFT JOIN owners o ON m.owner_no = o.owner_no "
    "LEFT JOIN aggregators a ON m.aggregator_no = a.aggregator_no "
    "LEFT JOIN countries c ON o.country_no = c.country_no "
)
PLAN = [
    {"left_table": "merchants", "right_table": "owners", "join_type": "LEFT", "left_key": "owner_no", "right_key": "owner_no"},
    {"left_table": "merchants", "right_table": "aggregators", "join_type": "LEFT", "left_key": "aggregator_no", "right_key": "aggregator_no"},
    {"left_table": "owners", "right_table": "countries", "join_type": "LEFT", "left_key": "country_no", "right_key": "country_no"},
]


def _direct(**columns) -> list[dict]:
    return [
        {"target": t, "source_table": c.split(".")[0], "source_column": c.split(".")[1]}
        for t, c in columns.items()
    ]


DIRECT = _direct(
    CAID="merchants.acceptor", DBAName="merchants.trading_name", LegalName="owners.legal_name",
    LocationCountry="owners.country_no", MCC1="merchants.mcc", DateSigned="merchants.signed_on",
    AggregatorName="aggregators.aggregator_name", City="countries.country_name",
    AggregatorID="merchants.aggregator_no",
)
DERIVED = [
    {
        "target": "AcquirerMerchantID",
        "is_derived": True,
        "derivation_logic": master.derived_merchant_id(
            "aggregators.aggregator_name", "merchants.sub_merchant_id", "merchants.assigned_id"
        ),
    },
    {
        "target": "BASEIIName",
        "is_derived": True,
        "derivation_logic": master.derived_transaction_name(
            "aggregators.aggregator_name", "merchants.trading_name"
        ),
    },
]
CONSTANTS = {
    "ProcessorBINCIB": 400123, "ProcessorName": "Proc", "AcquirerBID": 500123,
    "AcquirerName": "Bank", "AcquirerBIN": None,
}


def _raw(spark, sf_dir) -> dict:
    _register_views(spark, sf_dir, "orders", "customer", "supplier", "nation")
    return {name: spark.sql(sql) for name, sql in RAW.items()}


def _built(spark, sf_dir, mapped, constants=None, plan=PLAN, distinct=False):
    return master.build_target(
        _raw(spark, sf_dir), mapped, plan, "merchants", "merchant_no", constants, distinct
    )


@query(
    "map_direct",
    _RAW_CTES + "SELECT merchant_no AS row_id, acceptor AS CAID, trading_name AS DBAName, "
    f"legal_name AS LegalName, CAST(mcc AS INTEGER) AS MCC1 {_RAW_JOIN}",
)
def map_direct(spark, sf_dir):
    return _built(spark, sf_dir, DIRECT).select("row_id", "CAID", "DBAName", "LegalName", "MCC1")


@query(
    "map_derived_mid",
    _RAW_CTES + "SELECT merchant_no AS row_id, CASE WHEN aggregator_name IS NULL THEN assigned_id "
    f"ELSE sub_merchant_id END AS AcquirerMerchantID {_RAW_JOIN}",
)
def map_derived_mid(spark, sf_dir):
    return _built(spark, sf_dir, DERIVED).select("row_id", "AcquirerMerchantID")


@query(
    "map_derived_baseii",
    _RAW_CTES + f"SELECT merchant_no AS row_id, aggregator_name || ' - ' || trading_name AS BASEIIName {_RAW_JOIN}",
)
def map_derived_baseii(spark, sf_dir):
    return _built(spark, sf_dir, DERIVED).select("row_id", "BASEIIName")


@query(
    "map_constants",
    _RAW_CTES + "SELECT merchant_no AS row_id, 400123 AS ProcessorBINCIB, 'Proc' AS ProcessorName, "
    "500123 AS AcquirerBID, 'Bank' AS AcquirerName, country_no AS LocationCountry, "
    f"CAST(mcc AS INTEGER) AS MCC1 FROM merchants m LEFT JOIN owners o ON m.owner_no = o.owner_no",
)
def map_constants(spark, sf_dir):
    return _built(spark, sf_dir, DIRECT, CONSTANTS).select(
        "row_id", "ProcessorBINCIB", "ProcessorName", "AcquirerBID", "AcquirerName", "LocationCountry", "MCC1"
    )


@query(
    "enrich_left_join",
    _RAW_CTES + f"SELECT merchant_no, legal_name, aggregator_name, country_name {_RAW_JOIN}",
)
def enrich_left_join(spark, sf_dir):
    return master.join_sources(_raw(spark, sf_dir), "merchants", PLAN).selectExpr(
        "merchants.merchant_no", "owners.legal_name", "aggregators.aggregator_name", "countries.country_name"
    )


@query(
    "dedupe_output",
    _RAW_CTES + "SELECT min(merchant_no) AS row_id, trading_name AS DBAName, CAST(mcc AS INTEGER) AS MCC1 "
    "FROM merchants GROUP BY ALL",
)
def dedupe_output(spark, sf_dir):
    mapped = [m for m in DIRECT if m["target"] in ("DBAName", "MCC1")]
    return _built(spark, sf_dir, mapped, plan=[], distinct=True).select("row_id", "DBAName", "MCC1")


@query(
    "build_target",
    _RAW_CTES + "SELECT merchant_no AS row_id, CASE WHEN aggregator_name IS NULL THEN assigned_id "
    "ELSE sub_merchant_id END AS AcquirerMerchantID, CAST(m.aggregator_no AS VARCHAR) AS AggregatorID, "
    "aggregator_name AS AggregatorName, acceptor AS CAID, trading_name AS DBAName, legal_name AS LegalName, "
    "strftime(signed_on, '%Y-%m-%d') AS DateSigned, aggregator_name || ' - ' || trading_name AS BASEIIName, "
    f"country_name AS City, CAST(mcc AS INTEGER) AS MCC1, 'Bank' AS AcquirerName {_RAW_JOIN}",
)
def build_target(spark, sf_dir):
    built = _built(spark, sf_dir, DIRECT + DERIVED, CONSTANTS, distinct=True)
    return built.selectExpr(
        "row_id", "AcquirerMerchantID", "AggregatorID", "AggregatorName", "CAID", "DBAName", "LegalName",
        "CAST(DateSigned AS STRING) AS DateSigned", "BASEIIName", "City", "MCC1", "AcquirerName",
    )


_USER_SQL = (
    "SELECT m.acceptor AS CAID, upper(o.legal_name) AS LegalName, count(*) AS merchants "
    "FROM merchants m LEFT JOIN owners o ON m.owner_no = o.owner_no GROUP BY m.acceptor, upper(o.legal_name)"
)


@query("run_user_sql", _RAW_CTES + _USER_SQL)
def run_user_sql(spark, sf_dir):
    return master.run_user_sql(_raw(spark, sf_dir), _USER_SQL)


# ---- reference values ------------------------------------------------------------------------

_REFERENCE = {
    "transactions": """
SELECT o_orderkey AS tx, CAST(400000 + o_custkey % 7 AS STRING) || '.0' AS acq_bin,
       CASE WHEN o_orderkey % 2 = 0 THEN ' ' || CAST(500 + o_custkey % 9 AS STRING) END AS bid_id,
       CAST(NULL AS STRING) AS processor_name
FROM orders""",
    "acquirer_master": """
SELECT c_custkey AS id, '  ' AS cib_name, 'Processor ' || CAST(c_nationkey % 4 AS STRING) AS proc_name,
       'Bank ' || CAST(c_custkey % 90 AS STRING) AS acq_name, c_nationkey AS cib_id
FROM customer""",
}
_REF_ORDER = {"transactions": ["tx"], "acquirer_master": ["id"]}
_REF_CTES = "WITH " + ", ".join(f"{n} AS ({sql})" for n, sql in _REFERENCE.items()) + " "


def _reference(spark, sf_dir) -> dict:
    _register_views(spark, sf_dir, "orders", "customer")
    return {name: spark.sql(sql) for name, sql in _REFERENCE.items()}


def _mode_sql(field: str, table_name: str, column: str, numeric: bool) -> str:
    value = f"trim(CAST({column} AS VARCHAR))"
    shown = "CAST(CAST(trunc(CAST(value AS DOUBLE)) AS BIGINT) AS VARCHAR)" if numeric else "value"
    return (
        f"SELECT '{field}' AS field, {shown} AS value, '{table_name}' AS source_table, "
        f"'{column}' AS source_column FROM (SELECT {value} AS value, count(*) AS n FROM {table_name} "
        f"WHERE {value} <> '' GROUP BY 1 ORDER BY n DESC, value LIMIT 1)"
    )


@query(
    "detect_reference_values",
    _REF_CTES + _union([
        _mode_sql("processor_name", "acquirer_master", "proc_name", False),
        _mode_sql("processor_bin_cib", "acquirer_master", "cib_id", True),
        _mode_sql("acquirer_name", "acquirer_master", "acq_name", False),
        _mode_sql("acquirer_bid", "transactions", "bid_id", True),
        _mode_sql("acquirer_bin", "transactions", "acq_bin", True),
    ]),
)
def detect_reference_values(spark, sf_dir):
    return reference_values.detect(_reference(spark, sf_dir))


def _options_sql(field: str, table_name: str, column: str) -> str:
    value, key = f"trim(CAST({column} AS VARCHAR))", _REF_ORDER[table_name][0]
    return (
        f"SELECT '{field}' AS field, row_number() OVER (ORDER BY TRY_CAST(value AS DOUBLE) NULLS LAST, value)"
        f"::BIGINT AS position, value, '{table_name}' AS source_table, '{column}' AS source_column FROM ("
        f"SELECT {value} AS value, min({key}) AS seen FROM {table_name} WHERE {value} <> '' "
        "GROUP BY 1 ORDER BY seen LIMIT 50)"
    )


@query(
    "reference_value_options",
    _REF_CTES + _union([
        _options_sql("processor_bin_cib", "acquirer_master", "cib_id"),
        _options_sql("acquirer_name", "acquirer_master", "acq_name"),
        _options_sql("acquirer_bid", "transactions", "bid_id"),
        _options_sql("acquirer_bin", "transactions", "acq_bin"),
    ]),
)
def reference_value_options(spark, sf_dir):
    found = reference_values.options(_reference(spark, sf_dir), _REF_ORDER)
    return found.withColumn("position", F.col("position").cast("bigint"))
