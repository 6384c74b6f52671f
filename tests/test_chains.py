"""Types of text input, templates over feeds, value evidence, profile states, publishing and page directories."""

import pytest
from pyspark.sql import functions as F

from mercalith.operators import content, discovery, inferred, mapping, profile_states
from mercalith.plans import feeds
from mercalith.plans import remediation as fix
from mercalith.plans.checker import check, effective_rules, run_rule
from mercalith.sources import pages, sinks
from workload.target_view import target

SF_DIR = "/root/testdata/sf0.001"


def test_types_form_a_lattice(spark):
    df = spark.sql(
        """SELECT * FROM VALUES
        ('1', '1', '01', '2024-01-31', '2024-01-31', 'TRUE', ' 7 ', '', CAST(NULL AS STRING), '1', 5),
        ('-2', '2.5', '2', '2024-02-01', '2024-01-31 10:00', 'false', '8', '  ', NULL, 'x', 6),
        ('+3', '1e3', '3', '2023-12-31', '2024-01-31T10:00:01.5', 'true', '9', NULL, NULL, '3', 7)
        AS v(i, n, code, d, t, b, padded, blank, none, mixed, own)"""
    )
    got = {r.column_name: r for r in inferred.inferred_types({"t": df}).collect()}
    assert {c: r.inferred_type for c, r in got.items()} == {
        "i": "integer", "n": "number", "code": "string", "d": "date", "t": "timestamp", "b": "boolean", "padded": "integer",
        "blank": "string", "none": "string", "mixed": "string", "own": "int",
    }
    assert got["mixed"].refused_integer == 1 and got["code"].refused_integer == 1 and got["blank"].filled == 0
    as_typed = inferred.typed(df, inferred.inferred_types({"t": df}), "t")
    kinds = dict(as_typed.dtypes)
    assert (kinds["i"], kinds["n"], kinds["d"], kinds["b"], kinds["code"], kinds["padded"]) == ("bigint", "double", "date", "boolean", "string", "bigint")
    assert [r.padded for r in as_typed.orderBy("own").collect()] == [7, 8, 9]
    plan = inferred.inferred_types({"t": df})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange SinglePartition") <= 1 and "hashpartitioning" not in plan


def _template(fingerprint, name, **more):
    row = {"fingerprint": fingerprint, "name": name, "main": None, "key": None, "mapping": None, "join_plan": None, "rules": None, "sql": None}
    return tuple((row | more).values())


def test_templates_keep_feeds_apart(spark):
    shops = spark.createDataFrame(
        [("f1", 1, "A", 7), ("f1", 2, "A", 8), ("f2", 1, "A", 7), ("f2", 1, "A", 7), ("f3", 5, "B", 9)], "feed string, no int, ca string, owner int"
    )
    owners = spark.createDataFrame([("f1", 7, "One"), ("f2", 7, "Two"), ("f2", 8, "Other")], "feed string, owner int, name string")
    other = spark.createDataFrame([("g", 1)], "feed string, z int")
    tables = {"shops": shops, "owners": owners}
    print_ = feeds.fingerprint_of(tables)
    catalogue = discovery.catalogue_of(spark, "x", {n: t.drop("feed") for n, t in tables.items()})
    assert discovery.fingerprints(catalogue).first().fingerprint == print_
    mapped = [("CAID", "shops", "ca", False, None), ("LegalName", "owners", "name", False, None)]
    templates = spark.createDataFrame(
        [_template(print_, "t", main="shops", key="no", mapping=mapped, join_plan=[("shops", "owners", "LEFT", "owner", "owner")], rules=["V7"])],
        feeds.TEMPLATE_SCHEMA,
    )
    found = feeds.apply_templates([tables, {"o": other}], templates)
    rows = sorted((r.feed, r.row_id, r.CAID, r.LegalName or "") for r in found.target.collect())
    assert rows == [("f1", 1, "A", "One"), ("f1", 2, "A", ""), ("f2", 1, "A", "Two"), ("f3", 5, "B", "")]
    assert [r.feed for r in found.unmatched.collect()] == ["g"]
    assert {(r.feed, r.template, tuple(r.rules)) for r in found.choice.collect()} == {(f, "t", ("V7",)) for f in ("f1", "f2", "f3")}
    # one plan for all feeds
    plan = found.target._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1
    assert {(r.feed, r.rule_id) for r in feeds.check_feeds(found).collect()} == {(f, "V7") for f in ("f1", "f2", "f3")}
    with pytest.raises(ValueError, match="must return feed"):
        bad = spark.createDataFrame([_template(print_, "t", sql="SELECT no AS row_id FROM {shops}")], feeds.TEMPLATE_SCHEMA)
        feeds.apply_templates([tables], bad)


def test_group_rules_do_not_cross_feeds(spark):
    rows = [("f1", 1, "C1", "M1"), ("f2", 1, "C1", "M2"), ("f3", 1, "C1", "M1"), ("f3", 2, "c 1", "M2"), ("f4", 1, "", "M1"), ("f4", 2, "", "M2")]
    tables = {"t": spark.createDataFrame(rows, "feed string, no int, ca string, mid string")}
    mapped = [("CAID", "t", "ca", False, None), ("AcquirerMerchantID", "t", "mid", False, None)]
    template = _template(feeds.fingerprint_of(tables), "t", main="t", key="no", mapping=mapped, rules=["V11"])
    found = feeds.apply_templates([tables], spark.createDataFrame([template], feeds.TEMPLATE_SCHEMA))
    assert {(r.feed, r.row_id) for r in feeds.check_feeds(found).collect()} == {("f3", 1), ("f3", 2)}


def test_values_tell_the_target(spark):
    tables = {"raw": spark.range(200).selectExpr("concat(' Shop ', id) AS x", "id % 7 AS y", "concat('other', id) AS z", "array(id) AS a")}
    known = spark.range(10, 210).selectExpr("'DBAName' AS target", "concat('SHOP ', id) AS value").union(spark.sql("SELECT 'City', NULL"))
    got = content.value_evidence(tables, known)
    assert [(r.column_name, r.target, r.similarity) for r in got.collect()] == [("x", "DBAName", round(190 / 210, 4))]
    stats = spark.createDataFrame([("raw", c, "string", 0.0) for c in "xz"], "table_name string, column_name string, data_type string, null_pct double")
    best = mapping.rank_candidates(stats, evidence=got).where("target = 'DBAName' AND rank = 1").first()
    assert (best.source_column, best.reasoning) == ("x", "values known for the column")
    assert content.value_evidence(tables, known.limit(0)).count() == 0


def test_profile_states_merge(spark, tmp_path):
    rows = spark.range(100).selectExpr("id AS k", "IF(id % 4 = 0, NULL, id % 5) AS v", "IF(id < 50, ' ', 'same') AS s", "DATE'2020-01-01' + CAST(id AS INT) AS d", "map(id, 1) AS m")
    store = profile_states.StateStore(spark, str(tmp_path / "states"))
    for part in range(4):
        store.add(rows.where(f"k % 4 = {part}"), "t", str(part), ["k"])
    got = {r.column_name: r for r in store.report().collect()}
    assert got["k"].row_count == 100 and got["v"].null_count == 25 and got["s"].blank_count == 50 and got["k"].parts == 4
    assert got["v"].sample_values == ["1", "2", "3", "0", "1"] and got["k"].sample_values == ["0", "1", "2", "3", "4"]
    assert (got["k"].low_number, got["k"].high_number) == (0.0, 99.0)
    assert abs(got["k"].distinct_estimate - 100) <= 3 and got["v"].distinct_estimate == 5
    assert not got["v"].is_constant and got["m"].row_count == 100
    store.add(rows.where("k % 4 = 3").withColumn("v", F.lit(9).cast("bigint")), "t", "3", ["k"])  # a part is replaced
    assert {r.column_name: r.high_number for r in store.report().collect()}["v"] == 9.0
    one = profile_states.merged_profile(profile_states.column_states(spark.range(20).selectExpr("id", "1 AS c"), "o", "p", ["id"]))
    assert {r.column_name: r.is_constant for r in one.collect()} == {"id": False, "c": True}


def test_pages_open_few_files(spark, tmp_path):
    rows = spark.range(10_000).selectExpr("id % 3000 AS row_id", "CAST(id AS STRING) AS name", "IF(id % 2 = 0, id, NULL) AS half", "map(id, id) AS m")
    path = pages.write_pages(rows, str(tmp_path / "pages"), rows_per_file=700)
    want = [(r.row_id, r.name) for r in rows.selectExpr("*", "to_json(struct(name)) AS j").orderBy("row_id", "j").collect()]
    got = []
    for n in (1, 2, 14, 15, 100, 199, 200):
        assert len(pages.files_of_page(spark, path, n)) <= 2
        page = pages.read_page(spark, path, n).collect()
        assert [(int(r.row_id), r.name) for r in page] == want[(n - 1) * 50 : n * 50]
        got += page
    assert {r.half for r in got if int(r.name) % 2} == {""}
    assert pages.read_page(spark, path, 201).count() == 0 and pages.total_rows(spark, path) == 10_000
    assert pages.read_page(spark, pages.write_pages(rows.limit(0), str(tmp_path / "none"))).count() == 0


def test_pages_need_few_ranges_and_list_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pages, "ROWS_PER_RANGE", 4000)
    rows = spark.range(10_000).selectExpr("id % 3000 AS row_id", "CAST(id AS STRING) AS name")
    path = pages.write_pages(rows, str(tmp_path / "pages"), rows_per_file=100)
    written = spark.read.parquet(f"{path}/rows")
    assert written.selectExpr("shiftright(_place, 33) AS r").distinct().count() <= 3  # not one range for each file
    sizes = [r.n for r in spark.read.parquet(f"{path}/directory").collect()]
    assert len(sizes) >= 100 and max(sizes) <= 100 and sum(sizes) == 10_000
    want = [(r.row_id, r.name) for r in rows.selectExpr("*", "to_json(struct(name)) AS j").orderBy("row_id", "j").collect()]
    for n in (1, 70, 81, 200):
        page = pages.read_page(spark, path, n)
        assert len(page.inputFiles()) <= 3
        assert [(int(r.row_id), r.name) for r in page.collect()] == want[(n - 1) * 50 : n * 50]


def test_one_lookup_serves_several_rules(spark):
    """Fixes from a shared lookup and narrow hits are those that every rule finds by itself."""
    rows = target(spark, SF_DIR)
    rules = {r.id: r for r in effective_rules() if r.id in ("V1", "V5", "V7", "V10", "V12")}
    hits = {r: run_rule(rows, rule).select(*fix.columns_read(rule)) for r, rule in rules.items()}
    known = fix.first_rows_of_ids(rows, hits.values()).cache()
    ids = {(r._caid, r._mid) for h in hits.values() for r in h.selectExpr(*fix._IDS).collect()}
    assert {(r._caid, r._mid) for r in known.collect()} == ids - {(None, None)}
    for r, rule in rules.items():
        alone = fix.propose_fixes(rows, rule)
        shared = fix.propose_fixes(rows, rule, hits=hits[r], known=known)
        assert shared.count() and shared.exceptAll(alone).count() == alone.exceptAll(shared).count() == 0


def test_pages_after_a_row_lose_no_tie(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, 'a'), (1, 'b'), (1, 'c'), (2, NULL), (3, 'x') AS v(row_id, n)")
    first = sinks.page(rows, size=2).collect()
    second = sinks.page(rows, size=2, after=first[-1]).collect()
    third = sinks.page(rows, size=2, after=second[-1].asDict()).collect()
    assert [(r.row_id, r.n) for r in [*first, *second, *third]] == [(1, "a"), (1, "b"), (1, "c"), (2, ""), (3, "x")]


def test_half_a_report_is_never_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "report")
    assert sinks.latest_report(spark, path) == {}
    result = check(target(spark, SF_DIR), ["V4", "V7"]).store()
    first = sinks.export_report(result, path)
    assert sinks.latest_report(spark, path) == first

    with monkeypatch.context() as m:
        m.setattr(type(result), "stamped", lambda self: self.target.selectExpr("raise_error('lost on the way') AS x"))
        with pytest.raises(Exception, match="lost on the way"):
            sinks.export_report(result, path)
    assert sinks.latest_report(spark, path) == first
    assert spark.read.parquet(first["violation_summary"]).count() == 2
    second = sinks.export_report(result, path, mapping=spark.range(3))
    assert sinks.latest_report(spark, path) == second and "schema_mapping" in second
