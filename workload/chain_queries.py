"""Chains of operators over the given tables: typed input, templates, evidence, publishing and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercalith.operators import content, inferred, mapping, profile, profile_states, reference_values
from mercalith.plans import feeds, master
from mercalith.plans import remediation as fix
from mercalith.plans.checker import check, effective_rules, run_rule
from mercalith.session import scratch_path, stored
from mercalith.sources.files import read_csv
from mercalith.sources.pages import read_page, write_pages
from mercalith.sources.sinks import export_report, latest_report
from mercalith.spec import RULES, TARGET_COLUMNS
from workload.oracle import RULE_SQL, over_forms, over_hits
from workload.registry import query
from workload.remediation_queries import _GENERIC, _SQL, _pairs_sql, _stub_sql
from workload.rule_queries import found
from workload.source_queries import (
    ALL,
    DIRECT,
    _PCT,
    _RAW_CTES,
    _RAW_JOIN,
    _REF_CTES,
    _built,
    _mode_sql,
    _raw,
    _reference,
    _register_views,
    _stats_sql,
    _tables,
    _union,
)
from workload.target_view import table, target

# ---- types of text input ---------------------------------------------------------------------

_CSV = {
    "shops": """
SELECT CAST(o_orderkey AS STRING) AS id, lpad(CAST(o_orderkey AS STRING), 9, '0') AS code,
       CASE WHEN o_orderkey % 1000 = 7 THEN 'n/a' ELSE CAST(o_custkey AS STRING) || '.5' END AS amount,
       CAST(CAST(o_orderdate AS DATE) AS STRING) AS day, CAST(CAST(o_orderdate AS DATE) AS STRING) || ' 10:20:30' AS moment,
       CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'False' END AS open, CASE WHEN o_orderkey % 3 = 0 THEN '' END AS nothing
FROM orders""",
    "owners": """
SELECT ' ' || CAST(c_custkey AS STRING) || ' ' AS id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN '12' ELSE '1e3' END AS mixed,
       CASE WHEN c_custkey % 50 = 0 THEN '2024-02-30' ELSE '2024-02-01' END AS day FROM customer""",
    "places": "SELECT CAST(n_nationkey AS STRING) AS id, CAST(-n_nationkey AS STRING) AS below, n_name AS name FROM nation",
}
_FORMS = {
    "boolean": "lower(v) IN ('true', 'false')",
    "integer": "regexp_full_match(v, '[+-]?(0|[1-9][0-9]{0,17})')",
    "number": "regexp_full_match(v, '[+-]?(0|[1-9][0-9]*)([.][0-9]+)?([eE][+-]?[0-9]{1,3})?')",
    "date": "regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND TRY_CAST(v AS DATE) IS NOT NULL",
    "timestamp": "regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?)?') "
    "AND TRY_CAST(v AS TIMESTAMP) IS NOT NULL",
}
_CSV_COLUMNS = {"shops": "id code amount day moment open nothing", "owners": "id name mixed day", "places": "id below name"}


def _types_sql() -> str:
    refused = ", ".join(f"count(*) FILTER (WHERE NOT ({t})) AS refused_{k}" for k, t in _FORMS.items())
    cells = _union(f"SELECT '{t}' AS table_name, '{c}' AS column_name, trim({c}) AS v FROM {t}" for t, cs in _CSV_COLUMNS.items() for c in cs.split())
    narrowest = "CASE WHEN filled = 0 THEN 'string' " + " ".join(f"WHEN refused_{k} = 0 THEN '{k}'" for k in _FORMS) + " ELSE 'string' END"
    return (
        f"WITH {', '.join(f'{t} AS ({sql})' for t, sql in _CSV.items())}, cells AS ({cells}) "
        f"SELECT *, {narrowest} AS inferred_type FROM (SELECT table_name, column_name, count(*) AS filled, {refused} FROM cells "
        "WHERE v <> '' GROUP BY ALL UNION ALL SELECT 'shops', 'nothing', 0, 0, 0, 0, 0, 0)"
    )


@query("inferred_type", _types_sql())
def inferred_type(spark, sf_dir):
    _register_views(spark, sf_dir, "orders", "customer", "nation")
    tables = {}
    for name, sql in _CSV.items():
        path = scratch_path(spark, name)
        spark.sql(sql).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
        tables[name] = read_csv(spark, path)
    return inferred.inferred_types(tables).drop("table_no", "column_no", "data_type", "row_count")


# Text input of a target: numbers with decimals, dates in two forms, values that no type holds.
_TEXT_RAW = """
SELECT o_orderkey AS merchant_no, CASE o_orderkey % 4 WHEN 0 THEN '5411.0' WHEN 1 THEN ' 5812 ' WHEN 2 THEN 'none' ELSE '' END AS mcc,
       CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y%m%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'soon' END AS signed_on,
       CASE WHEN o_orderkey % 5 = 0 THEN '12.5' ELSE '700' END AS country FROM orders"""
_TEXT_MAP = [
    {"target": t, "source_table": "merchants", "source_column": c}
    for t, c in {"MCC1": "mcc", "DateSigned": "signed_on", "LocationCountry": "country"}.items()
]


def _text_raw(spark, sf_dir) -> dict:
    _register_views(spark, sf_dir, "orders")
    sql = _TEXT_RAW.replace("strftime(o_orderdate, '%Y%m%d')", "date_format(o_orderdate, 'yyyyMMdd')")
    return {"merchants": spark.sql(sql.replace("strftime(o_orderdate, '%Y-%m-%d')", "date_format(o_orderdate, 'yyyy-MM-dd')"))}


@query(
    "map_text_casts",
    f"SELECT merchant_no AS row_id, CASE merchant_no % 4 WHEN 0 THEN 5411 WHEN 1 THEN 5812 END AS MCC1, "
    "CASE WHEN merchant_no % 3 < 2 THEN signed_day END AS DateSigned, CASE WHEN merchant_no % 5 = 0 THEN 13 ELSE 700 END AS LocationCountry "
    "FROM (SELECT o_orderkey AS merchant_no, strftime(o_orderdate, '%Y-%m-%d') AS signed_day FROM orders)",
)
def map_text_casts(spark, sf_dir):
    built = master.build_target(_text_raw(spark, sf_dir), _TEXT_MAP, [], "merchants", "merchant_no", distinct=False)
    return built.selectExpr("row_id", "MCC1", "CAST(DateSigned AS STRING) AS DateSigned", "LocationCountry")


@query(
    "lost_values",
    "SELECT 'MCC1' AS column_name, count(*) FILTER (WHERE o_orderkey % 4 = 2) AS lost FROM orders UNION ALL "
    "SELECT 'DateSigned', count(*) FILTER (WHERE o_orderkey % 3 = 2) FROM orders UNION ALL SELECT 'LocationCountry', 0",
)
def lost_values(spark, sf_dir):
    return master.lost_values(_text_raw(spark, sf_dir), _TEXT_MAP, [], "merchants")


# ---- constants from the data, down to the target -----------------------------------------------

_FIELD_COLUMNS = {
    "processor_name": "ProcessorName", "processor_bin_cib": "ProcessorBINCIB", "acquirer_name": "AcquirerName",
    "acquirer_bid": "AcquirerBID", "acquirer_bin": "AcquirerBIN",
}


@query(
    "resolve_constants",
    _REF_CTES + "SELECT DISTINCT 'Chosen' AS ProcessorName, "
    + ", ".join(
        f"(SELECT CAST(value AS INTEGER) FROM ({_mode_sql(f, t, c, True)})) AS {_FIELD_COLUMNS[f]}"
        for f, t, c in (("processor_bin_cib", "acquirer_master", "cib_id"), ("acquirer_bid", "transactions", "bid_id"))
    )
    + f", (SELECT value FROM ({_mode_sql('acquirer_name', 'acquirer_master', 'acq_name', False)})) AS AcquirerName, 777 AS AcquirerBIN, "
    "(SELECT count(*) FROM orders) AS rows",
)
def resolve_constants(spark, sf_dir):
    detected = reference_values.detect(_reference(spark, sf_dir))
    # the user's choice stands before what was found; 0 and '' are none; five rows
    chosen = {"processor_name": "Chosen", "acquirer_bin": 777, "acquirer_bid": 0, "acquirer_name": ""}
    values = {_FIELD_COLUMNS[r["field"]]: r["value"] for r in reference_values.resolve(detected, chosen).collect()}
    built = _built(spark, sf_dir, DIRECT, values)
    return built.groupBy(*_FIELD_COLUMNS.values()).agg(F.count("*").alias("rows"))


# ---- ranking by dictionary and values ----------------------------------------------------------

_DICTIONARY = [
    ("part", "p_type", "free text: City of the plant"), ("orders", "o_orderstatus", "holds the MCC 1 code"),
    ("customer", "c_mktsegment", "Legal name, sort of"), ("customer", "c_mktsegment", "Legal-Name again"),
]


@query(
    "rank_by_dictionary",
    f"""WITH spec(pos, target, kind) AS (VALUES {", ".join(f"({i}, '{c.name}', '{c.type}')" for i, c in enumerate(TARGET_COLUMNS))}),
    d(table_name, column_name, names) AS (VALUES ('part', 'p_type', ['City']), ('orders', 'o_orderstatus', ['MCC1']), ('customer', 'c_mktsegment', ['LegalName'])),
    s AS (SELECT table_name, column_name, data_type, {_PCT} AS null_pct, coalesce(names, []) AS names,
            lower(regexp_replace(regexp_replace(column_name, '^[A-Za-z]{{1,2}}_', ''), '[^A-Za-z0-9]', '', 'g')) AS src
          FROM ({_stats_sql(ALL)}) LEFT JOIN d USING (table_name, column_name)),
    c AS (SELECT target, table_name AS source_table, column_name AS source_column, round(
            0.4 * CASE WHEN list_contains(names, target) THEN 1 ELSE 0 END
            + 0.4 * (1.0 - levenshtein(src, lower(target)) / greatest(length(src), length(target))::DOUBLE)
            + 0.1 * CASE WHEN (kind = 'integer' AND data_type IN ('int', 'bigint')) OR (kind = 'string' AND data_type = 'string')
                           OR (kind = 'date' AND data_type = 'timestamp_ntz') THEN 1 ELSE 0 END
            + 0.1 * (1.0 - null_pct / 100.0), 4)::DOUBLE AS confidence
          FROM s, spec),
    r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY confidence DESC, source_table, source_column) AS rank FROM c QUALIFY rank <= 5)
    SELECT target, max(source_table) FILTER (rank = 1) AS source_table, max(source_column) FILTER (rank = 1) AS source_column,
           max(confidence) FILTER (rank = 1) AS confidence,
           string_agg(source_table || '.' || source_column, ', ' ORDER BY rank) FILTER (rank > 1) AS alternatives
    FROM r GROUP BY target""",
)
def rank_by_dictionary(spark, sf_dir):
    dictionary = spark.createDataFrame(_DICTIONARY, "source_table string, column_name string, description string")
    ranked = mapping.rank_candidates(profile.column_stats(_tables(spark, sf_dir, ALL)), dictionary)
    others = "array_join(transform(alternatives, x -> x.source_table || '.' || x.source_column), ', ') AS alternatives"
    return mapping.as_mappings(ranked, "all").selectExpr("target", "source_table", "source_column", "confidence", others)


_KNOWN = ("CAID", "DBAName", "LegalName", "City", "AggregatorName", "MCC1", "LocationCountry")


def _known(spark, sf_dir):
    """An earlier target, without a tenth of its rows, for the raw tables to be matched with."""
    return content.target_values(_built(spark, sf_dir, DIRECT).where("row_id % 10 <> 0"), list(_KNOWN))


def _evidence_sql() -> str:
    earlier = {"CAID": "acceptor", "DBAName": "trading_name", "LegalName": "legal_name", "City": "country_name", "AggregatorName": "aggregator_name",
               "MCC1": "mcc", "LocationCountry": "o.country_no"}
    raw = {"merchants": "merchant_no sub_merchant_id assigned_id acceptor owner_no aggregator_no trading_name signed_on mcc",
           "owners": "owner_no legal_name country_no segment", "aggregators": "aggregator_no aggregator_name",
           "countries": "country_no country_name"}
    mine = _union(f"SELECT DISTINCT '{t}' AS table_name, '{c}' AS column_name, lower(trim(CAST({c} AS VARCHAR))) AS v FROM {t}" for t, cs in raw.items() for c in cs.split())
    known = _union(f"SELECT DISTINCT '{t}' AS target, lower(trim(CAST({c} AS VARCHAR))) AS v {_RAW_JOIN} WHERE m.merchant_no % 10 <> 0" for t, c in earlier.items())
    return (
        _RAW_CTES.rstrip() + f", mine AS (SELECT * FROM ({mine}) WHERE v <> ''), known AS (SELECT * FROM ({known}) WHERE v <> ''), "
        "n AS (SELECT table_name, column_name, count(*) AS n FROM mine GROUP BY ALL), m AS (SELECT target, count(*) AS m FROM known GROUP BY ALL) "
        "SELECT table_name, column_name, target, similarity FROM (SELECT table_name, column_name, target, "
        "round(both_have / (n + m - both_have)::DOUBLE, 4) AS similarity FROM (SELECT table_name, column_name, target, count(*) AS both_have "
        "FROM mine JOIN known USING (v) GROUP BY ALL) JOIN n USING (table_name, column_name) JOIN m USING (target)) WHERE similarity >= 0.7"
    )


@query("value_evidence", _evidence_sql())
def value_evidence(spark, sf_dir):
    return content.value_evidence(_raw(spark, sf_dir), _known(spark, sf_dir), 0.7)


# ---- templates over many feeds -----------------------------------------------------------------

# Layout A is mapped, layout B comes under other names and by SQL, layout C has no template.
_FEED_OF = "'feed-' || CAST(o_orderkey % 150 AS STRING)"
_LAYOUTS = {
    "a": {
        "merchants": f"SELECT {_FEED_OF} AS feed, o_orderkey AS no, 'CA' || CAST(o_custkey % 50 AS STRING) AS acceptor, o_custkey AS owner, "
        "'Shop ' || CAST(o_orderkey % 40 AS STRING) AS shop, CAST(5000 + o_custkey % 100 AS STRING) || '.0' AS mcc FROM orders WHERE o_orderkey % 150 < 70",
        "owners": f"SELECT DISTINCT {_FEED_OF} AS feed, o_custkey AS owner, 'Owner ' || CAST(o_custkey AS STRING) || ' in ' || CAST(o_orderkey % 150 AS STRING) AS name "
        "FROM orders WHERE o_orderkey % 150 < 70",
    },
    "b": {
        "outlets": f"SELECT {_FEED_OF} AS feed, o_orderkey AS outlet, 'CA' || CAST(o_custkey % 50 AS STRING) AS caid, "
        "'M' || CAST(o_orderkey % 7 AS STRING) AS mid, '12 Main Street' AS street FROM orders WHERE o_orderkey % 150 >= 70 AND o_orderkey % 150 < 120",
    },
    "c": {"unknown": f"SELECT {_FEED_OF} AS feed, o_orderkey AS x FROM orders WHERE o_orderkey % 150 >= 120"},
}
_OUTLETS = "SELECT feed, outlet AS row_id, upper(caid) AS CAID, mid AS AcquirerMerchantID, street AS Street FROM {outlets}"


def _feeds(spark, sf_dir) -> feeds.FeedTargets:
    _register_views(spark, sf_dir, "orders")
    sets = [{name: spark.sql(sql) for name, sql in tables.items()} for tables in _LAYOUTS.values()]
    a, b, _ = map(feeds.fingerprint_of, sets)
    mapped = [(t, "merchants", c, False, None) for t, c in (("CAID", "acceptor"), ("DBAName", "shop"), ("MCC1", "mcc"))]
    mapped += [("LegalName", "owners", "name", False, None), ("City", None, None, True, "concat('feed ', merchants.feed)")]
    joins = [("merchants", "owners", "LEFT", "owner", "owner")]
    templates = spark.createDataFrame(
        [
            (a, "mapped", "merchants", "no", mapped, joins, ["V10", "V11", "V7"], None),
            (b, "by sql", None, None, None, None, None, _OUTLETS),
            ("0" * 64, "of nobody", None, None, None, None, None, None),
        ],
        feeds.TEMPLATE_SCHEMA,
    )
    return feeds.apply_templates(sets, templates)


def _feed_ctes() -> str:
    return "WITH " + ", ".join(f"{n} AS ({sql})" for tables in _LAYOUTS.values() for n, sql in tables.items()) + " "


@query(
    "apply_template",
    _feed_ctes() + "SELECT m.feed, min(no) AS row_id, 'mapped' AS template, acceptor AS CAID, shop AS DBAName, name AS LegalName, "
    "'feed ' || m.feed AS City, CAST(CAST(mcc AS DOUBLE) AS INTEGER) AS MCC1, NULL AS Street "
    "FROM merchants m LEFT JOIN owners o ON m.feed = o.feed AND m.owner = o.owner GROUP BY ALL "
    "UNION ALL SELECT feed, outlet, 'by sql', upper(caid), NULL, NULL, NULL, NULL, street FROM outlets",
)
def apply_template(spark, sf_dir):
    built = _feeds(spark, sf_dir).target
    return built.select("feed", "row_id", "template", "CAID", "DBAName", "LegalName", "City", "MCC1", "Street")


@query("unmatched_feeds", _feed_ctes() + "SELECT DISTINCT feed FROM unknown")
def unmatched_feeds(spark, sf_dir):
    return _feeds(spark, sf_dir).unmatched


@query(
    "check_feeds",
    _feed_ctes() + ", t AS (SELECT feed, outlet AS row_id, upper(caid) AS CAID, mid FROM outlets), "
    "c AS (SELECT feed, CAID, count(DISTINCT mid) AS mids FROM t GROUP BY ALL) "
    "SELECT feed, row_id, 'V11' AS rule_id FROM t JOIN c USING (feed, CAID) WHERE mids > 1",
)
def check_feeds(spark, sf_dir):
    # layout A has no MIDs, so none of its chosen rules fires; layout B runs all rules
    return feeds.check_feeds(_feeds(spark, sf_dir))


# ---- incremental profile -----------------------------------------------------------------------


@query(
    "profile_increment",
    _union(
        f"SELECT '{c}' AS column_name, 5::BIGINT AS parts, count(*) AS row_count, count(*) - count({v}) AS null_count, "
        f"min({v})::DOUBLE AS low_number, max({v})::DOUBLE AS high_number, count(DISTINCT {v}) = 1 AND count(*) > 10 AS is_constant, "
        f"(SELECT string_agg(x, ' | ' ORDER BY k) FROM (SELECT CAST({v} AS VARCHAR) AS x, o_orderkey AS k FROM orders WHERE {v} IS NOT NULL ORDER BY k LIMIT 5)) AS samples, "
        f"true AS estimate_is_close FROM orders"
        for c, v in {"o_orderkey": "o_orderkey", "o_custkey": "o_custkey", "none": "CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END", "one": "CAST(7 AS BIGINT)"}.items()
    ),
)
def profile_increment(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey", "CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS none", "7L AS one")
    store = profile_states.StateStore(spark, scratch_path(spark, "states"))
    for part in range(4):
        store.add(rows.where(f"o_orderkey % 5 = {part}"), "orders", str(part), ["o_orderkey"])
    store.report().count()
    store.add(rows.where("o_orderkey % 5 = 4"), "orders", "4", ["o_orderkey"])  # reads the new part only
    exact = profile.column_stats({"orders": rows}).selectExpr("column_name AS c", "distinct_count AS d")
    return (
        store.report().join(exact, F.col("column_name") == F.col("c"))
        .selectExpr(
            "column_name", "parts", "row_count", "null_count", "low_number", "high_number", "is_constant",
            "array_join(sample_values, ' | ') AS samples", "abs(distinct_estimate - d) <= 0.05 * d AS estimate_is_close",
        )
    )


# ---- plans, publishing and pages ---------------------------------------------------------------


def _plans_sql() -> str:
    fixes = {r: sql for r, sql in _SQL.items()}
    for r, column in _GENERIC.items():
        fixes[r] = _stub_sql(r, column, strat="web_research" if r == "V10" else "manual_review")
    parts = []
    for r, sql in fixes.items():
        words = {"auto_fix": "auto-fixable", "web_research": "need web research", "manual_review": "need manual review"}
        texts = ", ".join(f"CASE WHEN count(*) FILTER (strategy = '{s}') > 0 THEN count(*) FILTER (strategy = '{s}') || ' {w}' END" for s, w in words.items())
        parts.append(
            f"SELECT '{r}' AS rule_id, (SELECT count(*) FROM g WHERE {RULE_SQL[r]}) AS total_affected, "
            f"(SELECT count(*) FROM g WHERE {RULE_SQL[r]}) || CASE WHEN count(*) = 0 THEN ' violations found' ELSE ' violations: ' || "
            f"concat_ws(', ', {texts}) END AS summary FROM (WITH {_pairs_sql(r)} {sql})"
        )
    return over_forms(" UNION ALL ".join(parts))


@query("plan_summary_all", _plans_sql())
def plan_summary_all(spark, sf_dir):
    rows = target(spark, sf_dir)
    rules = {r.id: r for r in effective_rules()}
    # the columns that proposals read, of every hit
    hits = {r: stored(run_rule(rows, rules[r]).select(*fix.columns_read(rules[r])), "hits") for r in RULES}
    known = stored(fix.first_rows_of_ids(rows, hits.values()), "first-rows")
    fixes, totals = [], []
    for rule_id, found_rows in hits.items():
        fixes.append(fix.propose_fixes(rows, rules[rule_id], hits=found_rows, known=known).select("rule_id", "strategy"))
        totals.append(found_rows.agg(F.count("*").alias("total_affected")).selectExpr(f"'{rule_id}' AS rule_id", "total_affected"))
    plan = fix.plan_summary(reduce(DataFrame.unionByName, fixes), reduce(DataFrame.unionByName, totals))
    return plan.select("rule_id", "total_affected", "summary")


_MAPPED = ", ".join(f"('{m['target']}', '{m['source_table']}.{m['source_column']}')" for m in DIRECT)


@query(
    "report_sections",
    over_hits(
        "SELECT 'violation_summary' AS section, rule_id AS name, count(*) || ' rows, ' || count(DISTINCT grp) || ' groups' AS content FROM hits GROUP BY rule_id "
        "UNION ALL SELECT 'violations', rule_id, count(*) || ' rows, ' || sum(row_id) FROM hits GROUP BY rule_id "
        "UNION ALL SELECT 'target', Violations || ' violations', count(*) || ' rows, ' || count(CAID) FROM stamps GROUP BY Violations "
        f"UNION ALL SELECT 'schema_mapping', a, b FROM (VALUES {_MAPPED}) AS v(a, b) "
        "UNION ALL SELECT 'data_quality', column_name, row_count || ' rows, ' || distinct_count || ' values' "
        f"FROM ({_stats_sql(('nation', 'supplier'))})",
        "pairs AS (SELECT rule_id, CAID, AcquirerMerchantID FROM hits GROUP BY ALL), "
        "per_pair AS (SELECT CAID, AcquirerMerchantID, count(*) AS v FROM pairs GROUP BY ALL), "
        "stamps AS (SELECT t.CAID, coalesce(v, 0) AS Violations FROM target t LEFT JOIN per_pair p "
        "ON t.CAID IS NOT DISTINCT FROM p.CAID AND t.AcquirerMerchantID IS NOT DISTINCT FROM p.AcquirerMerchantID)",
    ),
)
def report_sections(spark, sf_dir):
    path = scratch_path(spark, "published")
    result = found(spark, sf_dir)
    export_report(check(result.target, ["V4"]), path)  # an earlier report, which the next one replaces
    mapped = spark.createDataFrame([(m["target"], f"{m['source_table']}.{m['source_column']}") for m in DIRECT], "target string, source string")
    quality = profile.column_stats(_tables(spark, sf_dir, ("nation", "supplier")))
    export_report(result, path, mapped, quality)
    at = {name: spark.read.parquet(place) for name, place in latest_report(spark, path).items()}
    full = at["violations"].withColumn("rule_id", F.col("rule_id").cast("string"))
    parts = [
        at["violation_summary"].selectExpr("'violation_summary' AS section", "rule_id AS name", "affected_rows || ' rows, ' || groups || ' groups' AS content"),
        full.groupBy("rule_id").agg(F.expr("count(*) || ' rows, ' || sum(row_id)").alias("content")).selectExpr("'violations' AS section", "rule_id AS name", "content"),
        at["target"].groupBy("Violations").agg(F.expr("count(*) || ' rows, ' || count(CAID)").alias("content"))
        .selectExpr("'target' AS section", "Violations || ' violations' AS name", "content"),
        at["schema_mapping"].selectExpr("'schema_mapping' AS section", "target AS name", "source AS content"),
        at["data_quality"].selectExpr("'data_quality' AS section", "column_name AS name", "row_count || ' rows, ' || distinct_count || ' values' AS content"),
    ]
    return reduce(DataFrame.unionByName, parts)


_PAGED = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query(
    "page_directory",
    _union(
        f"SELECT {p} AS page, * FROM (SELECT {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in _PAGED.split(', '))} "
        f"FROM (SELECT {_PAGED} FROM lineitem ORDER BY {_PAGED} LIMIT 50 OFFSET {50 * (p - 1)}))"
        for p in (1, 2, 61, 100)
    ),
)
def page_directory(spark, sf_dir):
    # orders have several lines, and some lines are there twice
    rows = table(spark, sf_dir, "lineitem").select(*_PAGED.split(", "))
    path = write_pages(rows, scratch_path(spark, "pages"), _PAGED.split(", "), rows_per_file=1500)
    pages = [read_page(spark, path, p).select(F.lit(p).alias("page"), *_PAGED.split(", ")) for p in (1, 2, 61, 100)]
    return reduce(DataFrame.unionByName, pages)
