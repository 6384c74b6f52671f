"""Boundary rows per rule, and the skew handling of group rules."""

import pytest
from conftest import ids

from mercalith.operators.rules import GROUP_RULES, ROW_RULES, row_rule_hits, rule_rows
from mercalith.plans.checker import check


def broken(make, rule_id, rows, **kw):
    return ids(rule_rows(make(rows, **kw), rule_id))


def test_v1(make):
    bank = {"AcquirerName": "Bank of Africa"}
    rows = {
        1: {**bank, "DBAName": "Bank of Africa"},
        2: {**bank, "DBAName": "  bank OF africa "},
        3: {**bank, "DBAName": "bank of africas"},
        4: {**bank, "DBAName": "Grocer"},
        5: {"AcquirerName": " ", "DBAName": ""},
        6: {**bank},
        7: {"DBAName": "Bank of Africa"},
        8: {**bank, "DBAName": "Grocer", "LegalName": "BANK OF AFRICA"},
        9: {**bank, "DBAName": "Grocer", "LegalName": "x", "BASEIIName": "bank of africa"},
        10: {"AcquirerName": "Bänk öf", "DBAName": "bänk öf"},
        11: {**bank, "DBAName": "bank of afric", "LegalName": "Bank of Africa"},
        12: {**bank, "DBAName": " bank of africa "},
    }
    got = {r.row_id: r.violated_column for r in rule_rows(make(rows), "V1").collect()}
    assert got == {
        1: "DBAName", 2: "DBAName", 3: "DBAName", 5: "DBAName", 8: "LegalName",
        9: "BASEIIName", 10: "DBAName", 11: "DBAName", 12: "DBAName",
    }


def test_v2(make):
    rows = {
        1: {"Street": " PARIS", "City": "paris"},
        2: {"Street": "12, Paris", "City": "paris"},
        3: {"Street": "12 Ulm", "City": "ulm"},
        4: {"Street": "Paris"},
        5: {"Street": "", "City": " "},
        6: {"Street": "1 Main", "City": "Paris"},
    }
    assert broken(make, "V2", rows) == {1, 2, 5}


def test_v3_and_v10(make):
    base = {"CAID": "CA 1", "DBAName": "Shop", "LegalName": "Shop Ltd"}
    place = {"Street": "1 Main", "City": "Rome", "PostalCode": "1"}
    rows = {
        1: {**base, **place, "AcquirerMerchantID": "MID 1"},
        2: {**base, **place, "AcquirerMerchantID": "mid1", "Street": "2 Main"},
        3: {**base, "CAID": "x", **place, "AcquirerMerchantID": "m2"},
        4: {**base, "CAID": "X", **place, "AcquirerMerchantID": "m2"},
        5: {**base, **place, "AcquirerMerchantID": "m3"},
        6: {**base, **place, "AcquirerMerchantID": "m3", "PostalCode": None},
        7: {**base, **place, "CAID": " ", "AcquirerMerchantID": "m4"},
        8: {**base, **place, "CAID": "", "AcquirerMerchantID": "m4", "City": "Oslo", "LegalName": "z"},
        9: {**base, **place},
        10: {**base, **place, "City": "Oslo", "DBAName": "Other"},
        11: {**base, "CAID": "c9", "AcquirerMerchantID": "m9"},
        12: {**base, "CAID": "c9", "AcquirerMerchantID": "m9", "LegalName": "Else"},
    }
    assert broken(make, "V3", rows) == {1, 2}
    assert broken(make, "V10", rows) == {11, 12}


def test_v4(make):
    good = {"Street": "1 Main Street", "City": "Rome"}
    rows = {
        i: {**good, **change}
        for i, change in enumerate(
            [
                {"Street": "P.O. Box 1"}, {"Street": "the p o box"}, {"Street": "abcd"},
                {"Street": "abcde"}, {"Street": "aaaaaa"}, {"Street": "TEST my Address"},
                {"Street": "tbd"}, {"City": "."}, {"City": "N/A"}, {"City": "X"},
                {"Street": None}, {"City": None}, {},
            ]
        )
    }
    assert broken(make, "V4", rows) == {0, 1, 2, 4, 5, 6, 7, 8, 9}


def test_v5_and_v12(make):
    base = {"AggregatorName": "Agg", "AcquirerName": "Bank", "DBAName": "Shop", "LegalName": "Ltd"}
    rows = {
        1: {**base, "AggregatorName": " "},
        2: {**base},
        3: {**base, "BASEIIName": "  "},
        4: {**base, "BASEIIName": " SHOP"},
        5: {**base, "BASEIIName": "ltd"},
        6: {**base, "BASEIIName": "bank"},
        7: {**base, "BASEIIName": "Agg - Shop"},
        8: {**base, "AggregatorName": None, "BASEIIName": "shop"},
    }
    assert broken(make, "V5", rows) == {2, 3, 4, 5, 6}
    assert broken(make, "V12", rows) == {4, 5, 8}


def test_v6(make):
    ints = {
        1: {"ProcessorBINCIB": 5, "AcquirerBID": 5, "AcquirerBIN": 6},
        2: {"ProcessorBINCIB": 0, "AcquirerBID": 0, "AcquirerBIN": 6},
        3: {"ProcessorBINCIB": 4, "AcquirerBID": 5, "AcquirerBIN": 5},
        4: {"ProcessorBINCIB": 6, "AcquirerBID": 5, "AcquirerBIN": 6},
        5: {"ProcessorBINCIB": 6},
    }
    assert broken(make, "V6", ints) == {1, 3, 4}
    texts = {
        1: {"ProcessorBINCIB": "12.5", "AcquirerBID": "13", "AcquirerBIN": "x"},
        2: {"ProcessorBINCIB": "1e3", "AcquirerBID": "1000"},
        3: {"ProcessorBINCIB": "abc", "AcquirerBID": "abc"},
        4: {"ProcessorBINCIB": "-12.5", "AcquirerBIN": " -13 "},
    }
    columns = ("ProcessorBINCIB", "AcquirerBID", "AcquirerBIN")
    assert broken(make, "V6", texts, text=columns) == {1, 2, 4}


def test_v7(make):
    values = [None, "", "ab", "abc", "a" * 15, "a" * 16, "---", "-a-", "  ab  "]
    rows = {i: {"CAID": v} for i, v in enumerate(values)}
    assert broken(make, "V7", rows) == {0, 1, 2, 5, 6, 8}


def test_v8(make):
    place = {"Street": "1 Main", "City": "Rome", "PostalCode": "1"}
    rows = {
        1: {**place, "AcquirerMerchantID": "M 1"},
        2: {**place, "AcquirerMerchantID": "m1"},
        3: {**place, "Street": "2 Main", "AcquirerMerchantID": "a"},
        4: {**place, "Street": "2 MAIN ", "AcquirerMerchantID": "b"},
        5: {**place, "PostalCode": " ", "AcquirerMerchantID": "a"},
        6: {**place, "PostalCode": "", "AcquirerMerchantID": "b"},
        7: {**place, "PostalCode": None, "AcquirerMerchantID": "a"},
        8: {**place, "PostalCode": None, "AcquirerMerchantID": "b"},
        9: {**place, "Street": "2 main"},
    }
    assert broken(make, "V8", rows) == {3, 4, 9}


def test_v9(make):
    values = [None, "", "00", "n/a", "1111", "12", "##-##", "GB123", "none", "TBD "]
    rows = {i: {"BusinessRegistrationID": v} for i, v in enumerate(values)}
    assert broken(make, "V9", rows) == {2, 3, 4, 5, 6, 8, 9}


def test_v11(make):
    pairs = [("ca 1", "a"), ("CA1", "b"), (None, "a"), (None, "b"), (" ", "a"), ("", "b"),
             ("c2", "m 1"), ("C2", "M1"), ("c3", "a"), ("c3", None)]
    rows = {i: {"CAID": c, "AcquirerMerchantID": m} for i, (c, m) in enumerate(pairs)}
    assert broken(make, "V11", rows) == {0, 1}


def test_v13(make):
    pairs = [("A", "t1"), ("a ", "T1"), ("A", None), ("A", " "), ("B", "t2"), ("C", "t3"),
             ("C", "t4"), ("D", None), ("D", ""), (None, "t5"), (None, "t5"), (" ", "t6"), ("", "t6")]
    rows = {i: {"AggregatorID": a, "BusinessRegistrationID": t} for i, (a, t) in enumerate(pairs)}
    assert broken(make, "V13", rows) == {0, 1, 2, 3}


@pytest.mark.parametrize("rule_id", list(GROUP_RULES))
def test_hot_groups_are_spread_without_changing_the_result(spark, tmp_path, rule_id):
    """A third of all rows share one key; result equals a plain recount."""
    target = spark.range(3000).selectExpr(
        "id AS row_id",
        "CASE WHEN id % 3 = 0 THEN 'HOT' ELSE 'c' || id % 700 END AS CAID",
        "CASE WHEN id % 3 = 0 THEN 'M' || id % 2 ELSE 'm' || id % 350 END AS AcquirerMerchantID",
        "CASE WHEN id % 3 = 0 THEN 'Shop' ELSE 'd' || id % 1400 END AS DBAName",
        "'L' || id % 5 AS LegalName",
        "CASE WHEN id % 3 = 0 THEN 'Hot St' || id % 2 ELSE 's' || id % 90 END AS Street",
        "'Rome' AS City",
        "'1' AS PostalCode",
        "CASE WHEN id % 3 = 0 THEN 'AGG' ELSE 'a' || id % 40 END AS AggregatorID",
        "CASE WHEN id % 3 = 0 THEN 'TAX' ELSE 't' || id % 80 END AS BusinessRegistrationID",
    )
    target.write.parquet(str(tmp_path / "t"))
    target = spark.read.parquet(str(tmp_path / "t"))
    usual = ids(rule_rows(target, rule_id))
    # every partition counts as skewed, so adaptive execution splits the join
    split = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1024",
    }
    before = {k: spark.conf.get(k, None) for k in split}
    for k, v in split.items():
        spark.conf.set(k, v)
    try:
        found = [r.row_id for r in rule_rows(target, rule_id).collect()]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(usual) >= 1000
    assert sorted(found) == sorted(usual)


@pytest.mark.parametrize("rule_id", list(GROUP_RULES))
def test_a_group_rule_is_one_hash_aggregate(spark, rule_id):
    from workload.target_view import target

    rows = rule_rows(target(spark, "/root/testdata/sf0.001"), rule_id)
    text = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "SortAggregate" not in text
    assert text.count("HashAggregate") == 2 and text.count("FileScan") == 2


def test_all_rules_read_the_target_a_bounded_number_of_times(spark):
    from workload.target_view import target

    plan = check(target(spark, "/root/testdata/sf0.001")).long._jdf.queryExecution().executedPlan().toString()
    text = plan.split("== Initial Plan ==")[-1]
    # the states of the nested rules, written before, take one more scan and aggregate
    assert text.count("FileScan") <= 10 and text.count("HashAggregate") <= 8 and "SortAggregate" not in text


def test_all_row_rules_share_one_scan(make):
    plan = row_rule_hits(make({1: {"City": "x"}}), list(ROW_RULES), ["row_id"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Python" not in text and "Join" not in text


def test_only_the_similarity_rule_uses_python(spark, tmp_path):
    from workload.target_view import target

    rows = target(spark, "/root/testdata/sf0.001")
    for rule_id in [*ROW_RULES, *GROUP_RULES]:
        text = rule_rows(rows, rule_id)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in text, rule_id
        assert "CartesianProduct" not in text and "NestedLoop" not in text, rule_id
    text = check(rows).long._jdf.queryExecution().executedPlan().toString()
    assert text.split("== Initial Plan ==")[-1].count("ArrowEvalPython") == 1
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_nested_rules_find_the_same_rows_together_and_alone(spark):
    import random

    draw = random.Random(5)
    pick = lambda *some: draw.choice(some)
    rows = [
        (
            i, pick("M1", "m 1", "M2", "M3", None, ""), pick("C1", "c1 ", "C2", "C3", "", None, "C4"),
            pick("Shop", "shop ", "Store", None), pick("Ltd", "LTD", "Inc", None), pick("1 Main", "2 Main", None), "Rome", pick("1", "2"),
        )
        for i in range(400)
    ]
    names = "AcquirerMerchantID CAID DBAName LegalName Street City PostalCode".split()
    from mercalith.spec import TARGET_NAMES

    df = spark.createDataFrame(rows, "row_id bigint, " + ", ".join(f"{n} string" for n in names))
    df = df.selectExpr("row_id", *[n if n in names else f"CAST(NULL AS STRING) AS {n}" for n in TARGET_NAMES])
    together = {(r.row_id, r.rule_id, tuple(r.group_key)) for r in check(df, ["V3", "V10", "V11"]).long.collect()}
    alone = {(r.row_id, r.rule_id, tuple(r.group_key)) for rule in ("V3", "V10", "V11") for r in check(df, [rule]).long.collect()}
    assert together == alone and {x[1] for x in together} == {"V3", "V10", "V11"}
    two = {(r.row_id, r.rule_id) for r in check(df, ["V10", "V11"]).long.collect()}
    assert two == {x[:2] for x in alone if x[1] != "V3"}


def test_rows_without_a_group_leave_before_the_join(spark):
    from mercalith.operators import groups

    rows = spark.range(20000).selectExpr("id AS row_id", "IF(id % 100 = 0, NULL, CAST(id AS STRING)) AS k", "'x' AS l")
    flagged = spark.sql("SELECT * FROM VALUES ('7', 'x'), (NULL, 'x'), ('8', 'y') AS v(k, l)")
    left = groups._with_a_group(rows, flagged, ("k", "l"))
    assert left.columns == rows.columns
    assert 201 <= left.count() < 230  # those of a group, and few by chance
    assert ids(groups.join_groups(rows, flagged, ("k", "l"), few=True)) == {7}
    null_safe = groups.join_groups(rows, flagged, ("k", "l"), null_safe=True, few=True)
    assert ids(null_safe) == {7, *range(0, 20000, 100)}
