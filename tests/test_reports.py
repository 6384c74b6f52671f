from conftest import ids

from mercalith.plans.checker import check, effective_rules, trial_rule
from mercalith.plans import remediation as fix
from mercalith.sources.sinks import page
from workload.target_view import target

SF_DIR = "/root/testdata/sf0.001"


def test_counts_add_up(spark):
    found = check(target(spark, SF_DIR)).store()
    counts = {r.rule_id: r.rows for r in found.counts().collect()}
    assert sum(counts.values()) == found.long.count()
    summary = found.clean_summary().collect()[0]
    assert summary.clean_rows + summary.violated_rows == summary.total_rows
    # figures of the fixture description
    assert counts == {
        "V1": 36, "V2": 9, "V3": 138, "V4": 30, "V5": 90, "V6": 30, "V7": 14, "V8": 105,
        "V9": 20, "V10": 292, "V11": 300, "V12": 36, "V13": 59,
    }


def test_null_keys_are_counted_and_stamped(make):
    rows = {
        1: {"CAID": None, "AcquirerMerchantID": None, "Street": "1 Main Street", "City": "Rome"},
        2: {"CAID": None, "AcquirerMerchantID": None, "Street": "x", "City": "Rome"},
        3: {"CAID": "abc", "AcquirerMerchantID": "m", "Street": "x", "City": "Rome"},
        4: {"CAID": "abc", "AcquirerMerchantID": "m", "Street": "1 Main Street", "City": "Rome"},
        5: {"CAID": "abc", "AcquirerMerchantID": None, "Street": "1 Main Street", "City": "Rome"},
    }
    found = check(make(rows), ["V4", "V7"])
    assert found.rows_affected().collect()[0].total_rows_affected == 2
    stamps = {r.row_id: r.Violations for r in found.stamped().collect()}
    assert stamps == {1: 2, 2: 2, 3: 1, 4: 1, 5: 0}


def test_groups_count_null_key_parts(make):
    place = {"Street": "1 Main", "City": "Rome", "PostalCode": "1"}
    rows = {
        1: {"CAID": "abc", "AcquirerMerchantID": "a", "DBAName": "x", **place},
        2: {"CAID": "abc", "AcquirerMerchantID": None, "DBAName": "y", **place},
        3: {"CAID": "ABC", "AcquirerMerchantID": "b", **place},
    }
    counts = {r.rule_id: (r.rows, r.groups) for r in check(make(rows)).counts().collect()}
    assert counts["V11"] == (3, 2)
    assert counts["V8"] == (3, 1)


def test_stamped_target_can_be_checked_again(make):
    rows = make({1: {"CAID": "--", "AcquirerMerchantID": "m"}})
    once = check(rows, ["V7"]).stamped()
    again = check(once, ["V7"]).stamped()
    assert once.columns == again.columns and again.collect()[0].Violations == 1


def test_rule_overlay():
    rules = effective_rules(
        [
            {"id": "V2", "enabled": False, "name": None},
            {"id": "V3", "name": "Renamed", "sql": None},
            {"id": "V20", "sql": "SELECT 1"},
            {"id": "V14", "sql": "SELECT 1", "columns": ["City"]},
            {"id": "extra", "sql": "SELECT 1"},
            {"id": "V15", "sql": ""},
        ]
    )
    assert [r.id for r in rules][:2] == ["V1", "V3"]
    assert [r.id for r in rules][-4:] == ["V13", "V14", "V20", "extra"]
    assert rules[1].name == "Renamed"


def test_failing_user_rules_do_not_stop_the_others(make):
    rows = make({1: {"CAID": "--", "City": "Rome"}})
    overrides = [
        {"id": "V14", "sql": "SELECT nothing FROM merchant_target"},
        {"id": "V15", "sql": "SELECT *, CAST(City AS INT) AS n FROM merchant_target"},
        {"id": "V16", "sql": "SELECT City FROM merchant_target"},
    ]
    found = check(rows, ["V7", "V14", "V15", "V16"], overrides)
    counts = {r.rule_id: r.affected_rows for r in found.summary().collect()}
    assert counts == {"V7": 1, "V14": -1, "V15": -1, "V16": 1}
    assert found.stamped().collect()[0].Violations == 1


def test_trial_rule(make):
    rows = make({i: {"CAID": "x", "MCC1": i} for i in range(30)})
    good = trial_rule(rows, "SELECT * FROM merchant_target WHERE MCC1 >= 10")
    assert (good["status"], good["total_rows_flagged"], good["total_target_rows"]) == ("success", 20, 30)
    assert len(good["sample_rows"]) == 10 and good["sample_rows"][0]["City"] == ""
    bad = trial_rule(rows, "SELEC")
    assert bad["status"] == "error" and bad["total_rows_flagged"] == 0 and bad["error"]


def test_pages(spark):
    rows = target(spark, SF_DIR)
    second = [r.row_id for r in page(rows, 2, 20).collect()]
    first = [r.row_id for r in page(rows, 1, 20).collect()]
    keyed = [r.row_id for r in page(rows, size=20, after=first[-1]).collect()]
    assert second == keyed and first == sorted(first) and not set(first) & set(second)


# ---- remediation -----------------------------------------------------------------------------


def test_fixes_go_to_the_first_row_with_the_identifiers(make):
    rows = make(
        {
            1: {"CAID": "a", "AcquirerMerchantID": "m"},
            2: {"CAID": "a", "AcquirerMerchantID": "m"},
            3: {"CAID": None, "AcquirerMerchantID": "m"},
            4: {"CAID": "a", "AcquirerMerchantID": None},
            5: {"CAID": None, "AcquirerMerchantID": None},
            6: {"CAID": "b", "AcquirerMerchantID": "n"},
        }
    )
    got = {r.row_id: r.located for r in fix.locate_rows(rows, rows).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 6: 6}
    exact = {r.row_id: r.located for r in fix.locate_rows(rows, rows, "exact").collect()}
    assert exact == {i: i for i in range(1, 7)}


def test_apply_fixes(spark, make):
    rows = make({1: {"DBAName": "x", "City": None, "MCC1": 1}, 2: {"DBAName": "y"}})
    schema = (
        "source_row_id bigint, column_no int, row_id bigint, `column` string, new_value string"
    )
    fixes = spark.createDataFrame(
        [
            (1, 0, 1, "DBAName", "first"),
            (2, 0, 1, "DBAName", ""),
            (1, 1, 1, "City", None),
            (1, 2, 1, "MCC1", "7"),
            (1, 3, 1, "Missing", "z"),
            (9, 0, 99, "DBAName", "nowhere"),
        ],
        schema,
    )
    after = {r.row_id: r for r in fix.apply_fixes(rows, fixes).collect()}
    assert (after[1].DBAName, after[1].City, after[1].MCC1) == ("", None, 7)
    assert after[2].DBAName == "y" and len(after) == 2
    # the fix of a column that the target lacks changes nothing
    assert fix.rows_modified(rows, fixes).collect()[0].rows_modified == 3
    same = fix.apply_fixes(rows, fixes.where("false"))
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, rows.collect()))


def test_fixing_v5(make):
    base = {"AggregatorName": " Agg ", "AcquirerName": "Bank", "LegalName": "Ltd", "CAID": "c", "AcquirerMerchantID": "m"}
    rows = make({1: {**base, "DBAName": " Shop "}, 2: {**base, "DBAName": None, "CAID": "d"}})
    rule = next(r for r in effective_rules() if r.id == "V5")
    fixes = fix.propose_fixes(rows, rule)
    assert {r.row_id: r.new_value for r in fixes.collect()} == {1: "Agg * Shop", 2: "Agg"}
    after = fix.apply_fixes(rows, fixes)
    checked = fix.reverify(rule, rows, after).collect()[0]
    assert (checked.previous_violation_count, checked.new_violation_count, checked.delta) == (2, 0, 2)
    assert ids(after) == {1, 2}


def test_fix_limits(make):
    rows = make({i: {"CAID": "-" * (i % 2 + 1), "AcquirerMerchantID": f"m{i}", "AggregatorName": "a"} for i in range(700)})
    rules = {r.id: r for r in effective_rules()}
    assert fix.propose_fixes(rows, rules["V7"]).count() == 700
    assert fix.propose_fixes(rows, rules["V5"]).count() == 700
    for rule_id in ("V5", "V7"):
        first = fix.propose_fixes(rows, rules[rule_id], max_fixes=300)
        assert sorted(r.source_row_id for r in first.collect()) == list(range(300))


def test_values_of_the_wrong_type_leave_the_cell_alone(spark, make):
    rows = make({1: {"MCC1": 5034, "City": "Rome"}, 2: {"MCC1": 1}})
    fixes = spark.createDataFrame(
        [(1, 0, 1, "MCC1", "abc"), (1, 1, 1, "DateSigned", "20240131"), (2, 0, 2, "MCC1", "5411.0"), (2, 1, 2, "City", "x")],
        "source_row_id bigint, column_no int, row_id bigint, `column` string, new_value string",
    )
    after = {r.row_id: r for r in fix.apply_fixes(rows, fixes).collect()}
    assert after[1].MCC1 == 5034 and str(after[1].DateSigned) == "2024-01-31"
    assert (after[2].MCC1, after[2].City) == (5411, "x")
    assert [(r.row_id, r.column) for r in fix.rejected_fixes(rows, fixes).collect()] == [(1, "MCC1")]
    assert fix.rows_modified(rows, fixes).first().rows_modified == 3


def test_findings_are_ranked_not_filtered(spark):
    schema = "merchant_name string, query_no int, result_no int, source string"
    gaps = [("a", q, r, f"{q}{r}") for q in (2, 4, 6, 8) for r in (7, 8, 9)]
    same = [("b", 1, 1, f"s{i:02}") for i in range(30)]
    got = fix.top_findings(spark.createDataFrame(gaps + same, schema)).collect()
    assert [(r.query_no, r.result_no) for r in sorted(got, key=lambda r: r.finding_no) if r.merchant_name == "a"] == [
        (q, r) for q in (2, 4, 6) for r in (7, 8, 9)
    ]
    assert sorted(r.source for r in got if r.merchant_name == "b") == [f"s{i:02}" for i in range(5)]


def test_a_delta_gives_the_figures_of_a_full_run(spark):
    rows = target(spark, SF_DIR)
    fixes = spark.sql(
        """SELECT id AS row_id, id AS source_row_id, n AS column_no, c AS `column`, v AS new_value FROM (
        SELECT id * 3 AS id, inline(array(
          struct(0 AS n, 'CAID' AS c, concat('CA', id * 3 - id * 3 % 7) AS v),
          struct(1 AS n, 'CAID' AS c, IF(id % 9 = 0, NULL, concat('CA', id % 50)) AS v),
          struct(2 AS n, IF(id % 2 = 0, 'AggregatorID', 'Street') AS c, IF(id % 4 = 0, 'AGG1', 'PO Box 7') AS v),
          struct(3 AS n, 'MCC1' AS c, 'abc' AS v), struct(4 AS n, 'Nowhere' AS c, 'x' AS v))) FROM range(1, 300))"""
    )
    counts = check(rows).store().counts().select("rule_id", "rows")
    got = {r.rule_id: r for r in fix.reverify_delta(rows, fixes, counts).collect()}
    after = check(fix.apply_fixes(rows, fixes)).store().counts().collect()
    full = {r.rule_id: r.rows for r in after}
    assert {r: x.new_violation_count for r, x in got.items() if x.new_violation_count} == full
    assert {x.total_violations for x in got.values()} == {sum(full.values())}
    known = fixes.where("`column` NOT IN ('MCC1', 'Nowhere') AND new_value IS NOT NULL").join(rows, "row_id", "left_semi").count()
    assert {x.rows_modified for x in got.values()} == {known} and len(got) == 13
    assert all(x.delta == x.previous_violation_count - x.new_violation_count for x in got.values())
    one = fix.reverify_delta(rows, fixes, counts, ["V11"]).collect()
    assert [(r.rule_id, r.new_violation_count) for r in one] == [("V11", full["V11"])]
    none = fix.reverify_delta(rows, fixes.limit(0), counts).collect()
    assert all(r.delta == 0 and r.rows_modified == 0 for r in none)


def test_refused_values_are_no_modifications(make, spark):
    rows = make({1: {"MCC1": 5411, "City": "Rome"}})
    said = spark.createDataFrame([(1, "MCC1", "abc", 0), (1, "City", "Oslo", 1), (1, "Nowhere", "x", 2)], "row_id bigint, `column` string, value string, position int")
    assert [r.columns_modified for r in fix.columns_modified(rows, said).collect()] == [1]
    fixes = said.selectExpr("row_id", "`column`", "value AS new_value")
    assert fix.rows_modified(rows, fixes).first().rows_modified == 1
