"""Proposed, applied and re-checked corrections over the shared target."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercalith.plans import remediation as fix
from mercalith.plans.checker import effective_rules, run_rule
from workload.oracle import FORMS, HITS, RULE_SQL, SPREADS, over_forms, over_hits, over_target
from workload.registry import query
from workload.rule_queries import found
from workload.target_view import table, target

_RULES = {r.id: r for r in effective_rules()}
_SHOWN = (
    "fix_id, rule_id, source_row_id, row_id, `column` AS column_name, old_value, new_value, "
    "confidence, strategy, needs_confirmation"
)


def _shown(fixes):
    return fixes.selectExpr(*_SHOWN.split(", "))


# The first target row with the identifiers of row h (NULL identifiers left out).
_LOCATED = (
    "(SELECT min(t.row_id) FROM target t WHERE (h.CAID IS NULL OR t.CAID = h.CAID) "
    "AND (h.AcquirerMerchantID IS NULL OR t.AcquirerMerchantID = h.AcquirerMerchantID))"
)


def _pairs_sql(rule_id: str) -> str:
    """CTEs h (violating rows) and l (h with the located row), found by pair lookups."""
    return (
        f"h AS (SELECT * FROM g WHERE {RULE_SQL[rule_id]}), "
        "by_pair AS (SELECT CAID, AcquirerMerchantID, min(row_id) AS r FROM target GROUP BY ALL), "
        "by_mid AS (SELECT AcquirerMerchantID, min(row_id) AS r FROM target GROUP BY ALL), "
        "l AS (SELECT h.*, coalesce(a.r, b.r) AS located FROM h "
        "LEFT JOIN by_pair a ON h.CAID = a.CAID AND h.AcquirerMerchantID = a.AcquirerMerchantID "
        "LEFT JOIN by_mid b ON h.CAID IS NULL AND h.AcquirerMerchantID = b.AcquirerMerchantID)"
    )


def _fix_sql(rule_id: str, column: str, when: str, old: str, new: str, conf: str, strat: str, ask: str) -> str:
    return (
        f"SELECT '{rule_id}:' || row_id || ':{column}' AS fix_id, '{rule_id}' AS rule_id, "
        f"row_id AS source_row_id, located AS row_id, '{column}' AS column_name, "
        f"{old} AS old_value, {new} AS new_value, CAST({conf} AS DOUBLE) AS confidence, "
        f"'{strat}' AS strategy, {ask} AS needs_confirmation FROM l WHERE {when}"
    )


def _stub_sql(rule_id: str, column: str, when: str = "true", strat: str = "web_research") -> str:
    return _fix_sql(
        rule_id, column, when, f"CAST({column} AS VARCHAR)", "CAST(NULL AS VARCHAR)", "0.0", strat, "true"
    )


_SQL = {
    "V1": " UNION ALL ".join(
        _fix_sql("V1", c, f"lower(trim({c})) = acq AND acq <> ''", f"trim({c})", "''", "0.95", "web_research", "true")
        for c in ("DBAName", "LegalName", "BASEIIName")
    ),
    "V2": _stub_sql("V2", "Street"),
    "V4": _stub_sql("V4", "Street"),
    "V5": _fix_sql(
        "V5", "BASEIIName", "agg <> ''", "coalesce(BASEIIName, '')",
        "CASE WHEN coalesce(trim(DBAName), '') = '' THEN agg ELSE agg || ' * ' || trim(DBAName) END",
        "0.9", "auto_fix", "false",
    ),
    "V9": _stub_sql("V9", "BusinessRegistrationID"),
    "V12": _stub_sql("V12", "DBAName", "base = dba") + " UNION ALL " + _stub_sql("V12", "LegalName", "base = legal"),
}


def _register(rule_id: str) -> None:
    @query(f"fix_{rule_id.lower()}", over_forms(_SQL[rule_id], _pairs_sql(rule_id)))
    def run(spark, sf_dir):
        return _shown(fix.propose_fixes(target(spark, sf_dir), _RULES[rule_id], max_fixes=None))


for _rule_id in _SQL:
    _register(_rule_id)


# Every rule without a plan of its own, and one rule of a user.
_GENERIC = {"V3": "AcquirerMerchantID", "V6": "ProcessorBINCIB", "V7": "CAID", "V8": "Street", "V10": "AcquirerMerchantID",
            "V11": "AcquirerMerchantID", "V13": "AggregatorID"}
_USER = {"id": "U1", "name": "Odd MCC", "columns": ["MCC1"], "sql": "SELECT * FROM merchant_target WHERE MCC1 % 2 = 1"}


def _generic_sql() -> str:
    parts = []
    for rule_id, column in _GENERIC.items():
        strategy = "web_research" if rule_id == "V10" else "manual_review"
        select = _stub_sql(rule_id, column, strat=strategy)
        parts.append(f"SELECT * FROM (WITH {_pairs_sql(rule_id)} {select})")
    hits = _pairs_sql("V7").replace(RULE_SQL["V7"], "MCC1 % 2 = 1")
    parts.append(f"SELECT * FROM (WITH {hits} {_stub_sql('U1', 'MCC1', strat='manual_review')})")
    return over_forms(" UNION ALL ".join(parts))


@query("fix_generic", _generic_sql())
def fix_generic(spark, sf_dir):
    rows = target(spark, sf_dir)
    rules = [*[_RULES[r] for r in _GENERIC], *[r for r in effective_rules([_USER]) if r.id == "U1"]]
    return _shown(reduce(DataFrame.unionByName, [fix.propose_fixes(rows, r) for r in rules]))


@query(
    "cap_fixes",
    over_forms(
        f"SELECT * FROM ({_SQL['V5']}) ORDER BY source_row_id LIMIT 500", _pairs_sql("V5")
    ),
)
def cap_fixes(spark, sf_dir):
    return _shown(fix.propose_fixes(target(spark, sf_dir), _RULES["V5"], max_fixes=500))


# Identifiers shared by several rows, some of them missing.
_COARSE = """
SELECT o_orderkey AS row_id,
       CASE WHEN o_orderkey % 7 <> 0 THEN 'CA' || CAST(o_custkey % 40 AS STRING) END AS CAID,
       CASE WHEN o_orderkey % 11 <> 0 THEN 'M' || CAST(o_custkey % 60 AS STRING) END AS AcquirerMerchantID
FROM orders"""


@query(
    "locate_row",
    f"""WITH target AS ({_COARSE}), both_ids AS (
          SELECT CAID, AcquirerMerchantID, min(row_id) AS r FROM target GROUP BY ALL),
        one AS (SELECT CAID, min(r) AS r FROM both_ids GROUP BY CAID),
        two AS (SELECT AcquirerMerchantID, min(r) AS r FROM both_ids GROUP BY AcquirerMerchantID)
        SELECT h.row_id, h.CAID, h.AcquirerMerchantID, coalesce(b.r, one.r, two.r) AS located
        FROM target h
        LEFT JOIN both_ids b ON h.CAID = b.CAID AND h.AcquirerMerchantID = b.AcquirerMerchantID
        LEFT JOIN one ON h.AcquirerMerchantID IS NULL AND h.CAID = one.CAID
        LEFT JOIN two ON h.CAID IS NULL AND h.AcquirerMerchantID = two.AcquirerMerchantID
        WHERE coalesce(h.CAID, h.AcquirerMerchantID) IS NOT NULL""",
)
def locate_row(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    rows = spark.sql(_COARSE)
    return fix.locate_rows(rows, rows)


@query(
    "plan_summary",
    over_forms(
        f"SELECT 'V5' AS rule_id, count(*) AS total_affected, "
        "count(*) || ' violations: ' || count(*) || ' auto-fixable' AS summary FROM g "
        f"WHERE {RULE_SQL['V5']} "
        "UNION ALL SELECT 'V2', count(*), "
        "count(*) || ' violations: ' || count(*) || ' need web research' FROM g "
        f"WHERE {RULE_SQL['V2']}"
    ),
)
def plan_summary(spark, sf_dir):
    rows = target(spark, sf_dir)
    fixes, totals = [], []
    for rule_id in ("V2", "V5"):
        hits = run_rule(rows, _RULES[rule_id])
        fixes.append(fix.propose_fixes(rows, _RULES[rule_id], max_fixes=None, hits=hits))
        totals.append(
            hits.agg(F.count(F.lit(1)).alias("total_affected")).selectExpr(
                f"'{rule_id}' AS rule_id", "total_affected"
            )
        )
    plan = fix.plan_summary(fixes[0].unionByName(fixes[1]), totals[0].unionByName(totals[1]))
    return plan.select("rule_id", "total_affected", "summary")


_V5_NEW = "agg || ' * ' || trim(DBAName)"


@query(
    "apply_fixes",
    over_forms(
        f"SELECT row_id, DBAName, CASE WHEN {RULE_SQL['V5']} THEN {_V5_NEW} ELSE BASEIIName END "
        "AS BASEIIName FROM g"
    ),
)
def apply_fixes(spark, sf_dir):
    rows = target(spark, sf_dir)
    fixes = fix.propose_fixes(rows, _RULES["V5"], mode="exact", max_fixes=None)
    return fix.apply_fixes(rows, fixes).select("row_id", "DBAName", "BASEIIName")


# Corrections of the wrong type beside good ones.
_TYPED = """
SELECT o_orderkey AS row_id, o_orderkey AS source_row_id, 0 AS column_no,
       CASE o_orderkey % 3 WHEN 0 THEN 'MCC1' WHEN 1 THEN 'DateSigned' ELSE 'City' END AS {column},
       CASE o_orderkey % 12 WHEN 0 THEN 'abc' WHEN 1 THEN '20240131' WHEN 3 THEN '5411.0' WHEN 4 THEN '2024-02-30'
            WHEN 6 THEN '' WHEN 7 THEN '2023-12-05' ELSE 'found' END AS new_value
FROM orders"""


@query(
    "apply_fixes_rejected",
    over_target(
        "SELECT t.row_id, CASE t.row_id % 12 WHEN 3 THEN 5411 WHEN 6 THEN NULL ELSE MCC1 END AS MCC1, "
        "CAST(CASE t.row_id % 12 WHEN 1 THEN DATE '2024-01-31' WHEN 7 THEN DATE '2023-12-05' ELSE DateSigned END AS VARCHAR) AS DateSigned, "
        "CASE WHEN t.row_id % 3 = 2 THEN 'found' ELSE City END AS City, "
        "t.row_id % 12 IN (0, 9, 4, 10) AS rejected FROM target t"
    ),
)
def apply_fixes_rejected(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    fixes = spark.sql(_TYPED.format(column="`column`"))
    rows = target(spark, sf_dir)
    refused = fix.rejected_fixes(rows, fixes).select("row_id", F.lit(True).alias("rejected"))
    return (
        fix.apply_fixes(rows, fixes)
        .join(refused, "row_id", "left")
        .selectExpr("row_id", "MCC1", "CAST(DateSigned AS STRING) AS DateSigned", "City", "coalesce(rejected, false) AS rejected")
    )


@query(
    "reverify",
    over_forms(
        "SELECT 'V5' AS rule_id, count(*) AS previous_violation_count, "
        "count(*) FILTER (WHERE fixed IN (acq, dba, legal)) AS new_violation_count, "
        "count(*) FILTER (WHERE fixed NOT IN (acq, dba, legal)) AS delta "
        f"FROM (SELECT *, lower({_V5_NEW}) AS fixed FROM g WHERE {RULE_SQL['V5']})"
    ),
)
def reverify(spark, sf_dir):
    rows = target(spark, sf_dir)
    fixes = fix.propose_fixes(rows, _RULES["V5"], mode="exact", max_fixes=None)
    return fix.reverify(_RULES["V5"], rows, fix.apply_fixes(rows, fixes))


# Fixes of many columns: keys that rows share afterwards, keys they leave, refused values, unknown columns.
_MANY = """
SELECT o_orderkey AS row_id, o_orderkey AS source_row_id, 0 AS column_no,
       CASE o_orderkey % 40 WHEN 0 THEN 'CAID' WHEN 5 THEN 'AcquirerMerchantID' WHEN 10 THEN 'DBAName' WHEN 13 THEN 'DBAName'
            WHEN 15 THEN 'Street' WHEN 20 THEN 'BusinessRegistrationID' WHEN 24 THEN 'AggregatorID' WHEN 28 THEN 'BASEIIName'
            WHEN 30 THEN 'MCC1' WHEN 31 THEN 'Nowhere' WHEN 33 THEN 'CAID' ELSE 'AcquirerBIN' END AS {column},
       CASE o_orderkey % 40 WHEN 0 THEN 'CA' || CAST(o_orderkey - 10 AS STRING) WHEN 5 THEN 'M' || CAST(o_orderkey - 5 AS STRING)
            WHEN 10 THEN 'Bank of ASIA' WHEN 13 THEN '' WHEN 15 THEN 'PO Box 1' WHEN 20 THEN 'TAX-SHARED-1' WHEN 24 THEN 'AGG3'
            WHEN 28 THEN 'Shop ' || CAST(o_orderkey AS STRING) WHEN 30 THEN 'abc' WHEN 31 THEN 'x' WHEN 33 THEN '' ELSE '400001' END AS new_value
FROM orders WHERE o_orderkey % 40 IN (0, 5, 10, 13, 15, 20, 24, 28, 30, 31, 33, 37)"""

_FIXED_COLUMNS = ("CAID", "AcquirerMerchantID", "DBAName", "Street", "BusinessRegistrationID", "AggregatorID", "BASEIIName")


def _renamed(sql: str) -> str:
    """The forms, spreads and hits again, over the fixed target."""
    for name in ("target", "n", "g", "hits"):
        sql = re.sub(rf"\b{name}\b(?= AS \()|(?<=FROM ){name}\b", f"{name}2", sql)
    return sql


def _delta_sql() -> str:
    fixed = ", ".join(f"CASE WHEN f.col = '{c}' THEN f.new_value ELSE t.{c} END AS {c}" for c in _FIXED_COLUMNS)
    bin_ = "CASE WHEN f.col = 'AcquirerBIN' THEN CAST(f.new_value AS BIGINT) ELSE t.AcquirerBIN END AS AcquirerBIN"
    listed = ", ".join(f"('{r}')" for r in RULE_SQL)
    return over_hits(
        f"""SELECT rule_id, coalesce(a.n, 0) AS previous_violation_count, coalesce(b.n, 0) AS new_violation_count,
               coalesce(a.n, 0) - coalesce(b.n, 0) AS delta, (SELECT count(*) FROM hits2) AS total_violations,
               (SELECT count(*) FROM f WHERE col NOT IN ('MCC1', 'Nowhere')) AS rows_modified
        FROM (VALUES {listed}) r(rule_id)
        LEFT JOIN (SELECT rule_id, count(*) AS n FROM hits GROUP BY 1) a USING (rule_id)
        LEFT JOIN (SELECT rule_id, count(*) AS n FROM hits2 GROUP BY 1) b USING (rule_id)""",
        f"f AS ({_MANY.format(column='col')})",
        f"target2 AS (SELECT t.* REPLACE ({fixed}, {bin_}) FROM target t LEFT JOIN f ON f.row_id = t.row_id)",
        _renamed(FORMS), _renamed(SPREADS), _renamed(HITS),
    )


@query("reverify_delta", _delta_sql())
def reverify_delta(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    counts = found(spark, sf_dir).counts().select("rule_id", "rows")
    return fix.reverify_delta(target(spark, sf_dir), spark.sql(_MANY.format(column="`column`")), counts)


_SUGGESTED = """
SELECT CAST(floor(event_id / 3) AS BIGINT) AS row_id, event_id AS position,
       CASE event_id % 4 WHEN 0 THEN 'Street' WHEN 1 THEN 'City' WHEN 2 THEN 'Street'
            ELSE 'NoSuchColumn' END AS {column},
       CASE WHEN event_id % 10 <> 0 THEN 'found ' || CAST(user_id AS STRING) END AS value
FROM events"""


@query(
    "apply_external_fixes",
    over_target(
        "SELECT t.row_id, coalesce(a.v, t.Street) AS Street, coalesce(b.v, t.City) AS City, "
        "coalesce(c.n, 0) AS columns_modified FROM target t "
        "LEFT JOIN (SELECT row_id, arg_max(value, position) AS v FROM s WHERE col = 'Street' GROUP BY row_id) a ON t.row_id = a.row_id "
        "LEFT JOIN (SELECT row_id, arg_max(value, position) AS v FROM s WHERE col = 'City' GROUP BY row_id) b ON t.row_id = b.row_id "
        "LEFT JOIN (SELECT row_id, count(*) AS n FROM s GROUP BY row_id) c ON t.row_id = c.row_id",
        f"s AS (SELECT * FROM ({_SUGGESTED.format(column='col')}) "
        "WHERE value IS NOT NULL AND col <> 'NoSuchColumn')",
    ),
)
def apply_external_fixes(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    suggested = spark.sql(_SUGGESTED.format(column="`column`"))
    rows = target(spark, sf_dir)
    counts = fix.columns_modified(rows, suggested)
    return (
        fix.apply_suggestions(rows, suggested)
        .join(counts, "row_id", "left")
        .selectExpr("row_id", "Street", "City", "coalesce(columns_modified, 0L) AS columns_modified")
    )


# Numbers with gaps and repeats: some merchants start at query 4 and result 9.
_FINDINGS = """
SELECT 'merchant ' || CAST(user_id % 50 AS STRING) AS merchant_name,
       (event_id % 5 + 1) * (user_id % 3 + 1) + user_id % 4 AS query_no,
       (event_id % 77) % 7 + user_id % 9 AS result_no,
       CAST(event_id AS STRING) AS source, event_type AS title
FROM events"""


@query(
    "findings_topk",
    f"""WITH f AS ({_FINDINGS}),
        first AS (SELECT merchant_name, list_sort(list_distinct(list(query_no)))[1:3] AS qs FROM f GROUP BY 1),
        early AS (SELECT f.*, (SELECT count(*) FROM f b WHERE b.merchant_name = f.merchant_name
                              AND b.query_no = f.query_no
                              AND (b.result_no, b.source) < (f.result_no, f.source)) AS before
                 FROM f JOIN first USING (merchant_name) WHERE list_contains(qs, query_no))
        SELECT merchant_name, query_no, result_no, source, title,
               CAST(row_number() OVER w AS BIGINT) AS finding_no
        FROM early WHERE before < 5
        WINDOW w AS (PARTITION BY merchant_name ORDER BY query_no, result_no, source)
        QUALIFY row_number() OVER w < 11""",
)
def findings_topk(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    return fix.top_findings(spark.sql(_FINDINGS)).withColumn(
        "finding_no", F.col("finding_no").cast("bigint")
    )
