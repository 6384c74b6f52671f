"""Rules, rule runner and violation reports over the shared target."""

from __future__ import annotations

from pyspark.sql import functions as F

from mercalith.functions.normalize import norm_id, norm_text
from mercalith.operators.rules import rule_rows
from mercalith.plans.checker import (
    Violations,
    check,
    default_selection,
    effective_rules,
    run_rule_sql,
    trial_rule,
)
from mercalith.sources.sinks import export_report, export_target, page, violation_page
from mercalith.session import scratch_path
from mercalith.spec import OFF_BY_DEFAULT, RULES, TARGET_NAMES
from workload.oracle import FIRST_NAME, RULE_SQL, over_forms, over_hits, over_target
from workload.registry import query
from workload.target_view import target

_NAMES = {
    "V1": "v1_acquirer_name",
    "V2": "v2_street_city",
    "V3": "v3_multi_address",
    "V4": "v4_invalid_address",
    "V5": "v5_baseii_invalid",
    "V6": "v6_ids_copied",
    "V7": "v7_invalid_caid",
    "V8": "v8_shared_address",
    "V9": "v9_invalid_tax_id",
    "V10": "v10_multi_name",
    "V11": "v11_caid_multi_mid",
    "V12": "v12_baseii_copied",
    "V13": "v13_shared_tax_id",
}


def _register_rule(rule_id: str, name: str) -> None:
    shown = ["row_id", *dict.fromkeys(["CAID", "AcquirerMerchantID", *RULES[rule_id].columns])]
    extra = ["violated_column"] if rule_id == "V1" else []
    first = f", {FIRST_NAME} AS violated_column" if rule_id == "V1" else ""
    sql = over_forms(
        f"SELECT {', '.join(shown)}, '{rule_id}' AS violation_id{first} "
        f"FROM g WHERE {RULE_SQL[rule_id]}"
    )

    @query(name, sql)
    def run(spark, sf_dir):
        return rule_rows(target(spark, sf_dir), rule_id).select(*shown, "violation_id", *extra)


for _rule_id, _name in _NAMES.items():
    _register_rule(_rule_id, _name)


@query(
    "norm_id",
    over_target(
        "SELECT row_id, upper(replace(CAID, ' ', '')) AS caid, "
        "upper(replace(AcquirerMerchantID, ' ', '')) AS mid FROM target"
    ),
)
def norm_id_query(spark, sf_dir):
    return target(spark, sf_dir).selectExpr(
        "row_id", f"{norm_id('CAID')} AS caid", f"{norm_id('AcquirerMerchantID')} AS mid"
    )


@query(
    "norm_text",
    over_target(
        "SELECT row_id, upper(trim(DBAName)) AS dba, upper(trim(Street)) AS street FROM target"
    ),
)
def norm_text_query(spark, sf_dir):
    return target(spark, sf_dir).selectExpr(
        "row_id", f"{norm_text('DBAName')} AS dba", f"{norm_text('Street')} AS street"
    )


_runs: dict[tuple[str, str], Violations] = {}


def found(spark, sf_dir, *more):
    """Rules run once and written; every report is an aggregate of that frame.

    The run of all rules is kept for the application, as the target is."""
    if more:
        return check(target(spark, sf_dir), *more).store()
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _runs:
        _runs[key] = check(target(spark, sf_dir)).store()
    return _runs[key]


@query("run_rules", over_hits("SELECT row_id, rule_id, violated_column FROM hits"))
def run_rules(spark, sf_dir):
    # always a run of its own, which later reports read
    _runs.pop((spark.sparkContext.applicationId, sf_dir), None)
    return found(spark, sf_dir).long.select("row_id", "rule_id", "violated_column")


_PER_AGGREGATOR = (
    "SELECT AggregatorID, count(*) AS merchants FROM {view} "
    "WHERE AggregatorID IS NOT NULL GROUP BY AggregatorID"
)
_GROUPED = [{"id": "V14", "name": "Merchants", "sql": _PER_AGGREGATOR.format(view="merchant_target")}]
_GROUPED_SQL = _PER_AGGREGATOR.format(view="target")


@query("user_rule_export", over_target(_GROUPED_SQL))
def user_rule_export(spark, sf_dir):
    places = export_report(check(target(spark, sf_dir), ["V14"], _GROUPED), scratch_path(spark, "report"))
    return spark.read.parquet(places["violations V14"])


@query(
    "user_rule_samples",
    over_target(
        "SELECT 'V14' AS rule_id, row_number() OVER (ORDER BY AggregatorID) AS rank, AggregatorID "
        f"FROM ({_GROUPED_SQL}) ORDER BY AggregatorID LIMIT 10"
    ),
)
def user_rule_samples(spark, sf_dir):
    samples = found(spark, sf_dir, ["V14"], _GROUPED).samples()
    return samples.selectExpr("rule_id", "CAST(rank AS BIGINT) AS rank", "AggregatorID")


@query(
    "user_rule_page",
    over_target(
        f"SELECT AggregatorID, CAST(merchants AS VARCHAR) AS merchants FROM ({_GROUPED_SQL}) "
        "ORDER BY AggregatorID LIMIT 3 OFFSET 3"
    ),
)
def user_rule_page(spark, sf_dir):
    return violation_page(found(spark, sf_dir, ["V14"], _GROUPED), "V14", number=2, size=3)


_CUSTOM = (
    "SELECT * FROM {view} WHERE jaro_winkler_similarity(lower(City), 'nation_1') > 0.9 "
    "AND regexp_matches(Street, '^[0-9]+ M')"
)


@query(
    "custom_rule_sql",
    over_target("SELECT row_id, City, Street FROM (" + _CUSTOM.format(view="target") + ")"),
)
def custom_rule_sql(spark, sf_dir):
    hits = run_rule_sql(target(spark, sf_dir), _CUSTOM.format(view="merchant_target"))
    return hits.select("row_id", "City", "Street")


@query(
    "test_rule",
    over_target(
        "SELECT 'success' AS status, count(*) FILTER (WHERE MCC1 > 5050) AS total_rows_flagged, "
        "count(*) AS total_target_rows FROM target "
        "UNION ALL SELECT 'error', 0, count(*) FROM target"
    ),
)
def test_rule(spark, sf_dir):
    rows = target(spark, sf_dir)
    tried = [
        trial_rule(rows, "SELECT * FROM merchant_target WHERE MCC1 > 5050"),
        trial_rule(rows, "SELECT missing_column FROM merchant_target"),
    ]
    return spark.createDataFrame(
        [(t["status"], t["total_rows_flagged"], t["total_target_rows"]) for t in tried],
        "status string, total_rows_flagged bigint, total_target_rows bigint",
    )


@query(
    "select_rules",
    over_hits(
        "SELECT rule_id, count(*) AS rows FROM hits WHERE rule_id NOT IN "
        f"({', '.join(repr(r) for r in OFF_BY_DEFAULT)}) GROUP BY rule_id"
    ),
)
def select_rules(spark, sf_dir):
    chosen = default_selection(effective_rules())
    return found(spark, sf_dir, chosen).counts().select("rule_id", "rows")


_OVERRIDES = [
    {"id": "V2", "enabled": False},
    {"id": "V7", "name": "Bad CAID", "sql": "SELECT * FROM merchant_target WHERE CAID IS NULL"},
    {"id": "V14", "name": "High MCC", "sql": "SELECT * FROM merchant_target WHERE MCC1 > 5090"},
    {"id": "V15", "name": "Broken", "sql": "SELECT * FROM merchant_target WHERE no_column = 1"},
]


@query(
    "rule_error_isolation",
    over_hits(
        "SELECT rule_id, count(*) AS affected_rows FROM hits WHERE rule_id IN ('V4', 'V9') "
        "GROUP BY rule_id "
        "UNION ALL SELECT 'V7', count(*) FROM target WHERE CAID IS NULL "
        "UNION ALL SELECT 'V14', count(*) FROM target WHERE MCC1 > 5090 "
        "UNION ALL SELECT 'V15', -1"
    ),
)
def rule_error_isolation(spark, sf_dir):
    chosen = ["V2", "V4", "V7", "V9", "V14", "V15"]
    return (
        found(spark, sf_dir, chosen, _OVERRIDES)
        .summary()
        .select("rule_id", "affected_rows")
    )


# ---- reports ---------------------------------------------------------------------------------


@query("rule_counts", over_hits("SELECT rule_id, count(*) AS rows FROM hits GROUP BY rule_id"))
def rule_counts(spark, sf_dir):
    return found(spark, sf_dir).counts().select("rule_id", "rows")


@query(
    "rule_group_counts",
    over_hits("SELECT rule_id, count(DISTINCT grp) AS groups FROM hits GROUP BY rule_id"),
)
def rule_group_counts(spark, sf_dir):
    return found(spark, sf_dir).counts().select("rule_id", "groups")


@query(
    "rule_samples",
    over_hits(
        "SELECT rule_id, CAST(rank AS BIGINT) AS rank, s.row_id, coalesce(t.CAID, '') AS CAID, "
        "coalesce(t.BASEIIName, '') AS BASEIIName, coalesce(t.Street, '') AS Street "
        "FROM (SELECT rule_id, row_id, row_number() OVER (PARTITION BY rule_id ORDER BY row_id) "
        "AS rank FROM hits) s JOIN target t ON s.row_id = t.row_id WHERE rank <= 10"
    ),
)
def rule_samples(spark, sf_dir):
    return (
        found(spark, sf_dir)
        .samples()
        .selectExpr("rule_id", "CAST(rank AS BIGINT) AS rank", "row_id", "CAID", "BASEIIName", "Street")
    )


@query(
    "total_violations",
    over_hits(
        "SELECT count(*) AS total_violations, 13::BIGINT AS rules_executed, "
        "13::BIGINT AS rules_available FROM hits"
    ),
)
def total_violations(spark, sf_dir):
    return found(spark, sf_dir).totals()


@query(
    "rows_affected",
    over_hits(
        "SELECT count(*) AS total_rows_affected "
        "FROM (SELECT DISTINCT CAID, AcquirerMerchantID FROM hits)"
    ),
)
def rows_affected(spark, sf_dir):
    return found(spark, sf_dir).rows_affected()


_STAMPS = (
    "stamps AS (SELECT t.*, coalesce(p.v, 0) AS Violations FROM target t LEFT JOIN "
    "(SELECT CAID, AcquirerMerchantID, count(DISTINCT rule_id) AS v FROM hits GROUP BY ALL) p "
    "ON t.CAID IS NOT DISTINCT FROM p.CAID "
    "AND t.AcquirerMerchantID IS NOT DISTINCT FROM p.AcquirerMerchantID)"
)


@query("stamp_violations", over_hits("SELECT row_id, Violations FROM stamps", _STAMPS))
def stamp_violations(spark, sf_dir):
    return found(spark, sf_dir).stamped().select("row_id", "Violations")


@query(
    "clean_summary",
    over_hits(
        "SELECT count(*) AS total_rows, count(*) FILTER (WHERE Violations > 0) AS violated_rows, "
        "count(*) FILTER (WHERE Violations = 0) AS clean_rows, "
        "round(100.0 * count(*) FILTER (WHERE Violations > 0) / count(*), 2) AS violated_pct, "
        "round(100.0 * count(*) FILTER (WHERE Violations = 0) / count(*), 2) AS clean_pct "
        "FROM stamps",
        _STAMPS,
    ),
)
def clean_summary(spark, sf_dir):
    return found(spark, sf_dir).clean_summary()


_RULE_ROWS = "info(rule_id, rule_name, affected_columns) AS (VALUES " + ", ".join(
    f"('{r.id}', '{r.name}', '{', '.join(r.columns)}')" for r in RULES.values()
) + ")"


@query(
    "violation_summary",
    over_hits(
        "SELECT rule_id, rule_name, affected_columns, count(*) AS affected_rows, "
        "count(DISTINCT grp) AS groups FROM hits JOIN info USING (rule_id) GROUP BY ALL",
        _RULE_ROWS,
    ),
)
def violation_summary(spark, sf_dir):
    return (
        found(spark, sf_dir)
        .summary()
        .select("rule_id", "rule_name", "affected_columns", "affected_rows", "groups")
    )


@query(
    "filter_rules",
    over_hits(
        "SELECT rule_id, count(*) AS affected_rows FROM hits WHERE rule_id = 'V8' GROUP BY rule_id"
    ),
)
def filter_rules(spark, sf_dir):
    summary = found(spark, sf_dir, ["V4", "V8"]).summary()
    shown = summary.where((F.col("affected_rows") > 0) & (F.col("rule_id") == "V8"))
    return shown.select("rule_id", "affected_rows")


# ---- sinks and pages -------------------------------------------------------------------------


@query(
    "export_target",
    over_hits("SELECT CAID, AcquirerMerchantID, DBAName, Violations FROM stamps", _STAMPS),
)
def export_target_query(spark, sf_dir):
    path = scratch_path(spark, "export")
    export_target(found(spark, sf_dir).stamped(), path)
    return spark.read.parquet(path).select("CAID", "AcquirerMerchantID", "DBAName", "Violations")


@query(
    "export_report",
    over_hits(
        "SELECT 'target' AS section, count(*) AS rows FROM target "
        "UNION ALL SELECT 'violation_summary', count(DISTINCT rule_id) FROM hits "
        "UNION ALL SELECT 'violations ' || rule_id, count(*) FROM hits GROUP BY rule_id"
    ),
)
def export_report_query(spark, sf_dir):
    places = export_report(check(target(spark, sf_dir)), scratch_path(spark, "report"))
    sizes = [
        spark.read.parquet(places[s]).agg(F.count(F.lit(1)).alias("rows")).selectExpr(f"'{s}' AS section", "rows")
        for s in ("target", "violation_summary")
    ]
    by_rule = spark.read.parquet(places["violations"]).groupBy("rule_id").count()
    return sizes[0].unionByName(sizes[1]).unionByName(
        by_rule.selectExpr("'violations ' || rule_id AS section", "count AS rows")
    )


_AS_TEXT = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in TARGET_NAMES)


@query(
    "preview_page",
    over_target(f"SELECT row_id, {_AS_TEXT} FROM target ORDER BY row_id LIMIT 50 OFFSET 50"),
)
def preview_page(spark, sf_dir):
    return page(target(spark, sf_dir), number=2)


@query(
    "violation_rows_page",
    over_forms(
        f"SELECT row_id, {_AS_TEXT}, 'V4' AS violation_id FROM g WHERE {RULE_SQL['V4']} "
        "ORDER BY row_id LIMIT 25 OFFSET 25"
    ),
)
def violation_rows_page(spark, sf_dir):
    return violation_page(check(target(spark, sf_dir), ["V4"]), "V4", number=2, size=25)
