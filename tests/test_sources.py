import pytest

from mercalith.operators import discovery, mapping, profile, reference_values
from mercalith.plans import master
from mercalith.sources.files import ingest, pick_largest, read_csv


def test_csv_keeps_text(spark, tmp_path):
    file = tmp_path / "raw.csv"
    file.write_text('code,name,note\n00123,"A, B",NA\n7,,n/a\n')
    rows = [tuple(r) for r in read_csv(spark, str(file)).collect()]
    assert rows == [("00123", "A, B", "NA"), ("7", None, "n/a")]
    nulls = [tuple(r) for r in read_csv(spark, str(file), pandas_nulls=True).collect()]
    assert nulls == [("00123", "A, B", None), ("7", None, None)]


def test_ingest_refuses_what_it_cannot_name_or_read(spark, tmp_path):
    file = tmp_path / "a.csv"
    file.write_text("x\n1\n")
    assert list(ingest(spark, [str(file)])) == ["a"]
    with pytest.raises(ValueError, match="Unsupported"):
        ingest(spark, ["a.txt"])
    with pytest.raises(ValueError, match="Two files"):
        ingest(spark, [str(file), str(file)])


def test_first_of_equal_tables_is_picked(spark):
    tables = {"b": spark.range(3), "a": spark.range(3), "c": spark.range(1)}
    assert pick_largest(tables).collect()[0].table_name == "b"


def test_profile_thresholds(spark):
    def issues(df, column):
        found = profile.column_stats({"t": df}).where(f"column_name = '{column}'").collect()[0]
        return found.issues

    def constant(n):
        return spark.range(n).selectExpr("'a' AS c")

    assert issues(constant(10), "c") == []
    assert issues(constant(11), "c") == ["Only 1 distinct value (constant column)"]
    assert issues(spark.range(100).toDF("c"), "c") == []
    assert issues(spark.range(101).toDF("c"), "c") == ["All values unique (potential PK)"]
    half = spark.range(10).selectExpr("CASE WHEN id < 5 THEN id % 2 END AS c")
    assert issues(half, "c") == []
    empty = spark.range(10).selectExpr("CAST(NULL AS STRING) AS c")
    assert issues(empty, "c") == ["High null rate: 100.0%", "Column is entirely null"]
    blank = spark.sql("SELECT * FROM VALUES ('\\t'), ('  '), ('x'), ('y') AS v(c)")
    assert issues(blank, "c") == ["2 values are blank/whitespace-only"]


def test_profile_values(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (CAST('NaN' AS DOUBLE), repeat('x', 500), array(1), true, DATE'2020-01-01'), "
        "(0.0D, repeat('x', 500), array(1), false, DATE'2020-01-02'), "
        "(-0.0D, repeat('x', 499) || 'y', array(2), NULL, NULL) AS v(d, s, a, b, t)"
    )
    got = {
        r.column_name: (r.null_count, r.distinct_count)
        for r in profile.column_stats({"t": df}).collect()
    }
    assert got == {"d": (1, 1), "s": (0, 2), "a": (0, 2), "b": (1, 2), "t": (1, 2)}
    near = profile.approximate_stats(df.drop("d")).collect()
    assert {r.column_name: (r.null_count, r.distinct_count) for r in near}["s"] == (0, 2)


def test_profile_of_an_empty_table(spark):
    tables = {"none": spark.range(0).toDF("c")}
    stats = profile.column_stats(tables)
    row = stats.collect()[0]
    assert (row.row_count, row.null_pct, list(row.issues)) == (0, 0.0, [])
    assert profile.table_scores(stats).collect()[0].overall_score == 100.0


def test_samples_skip_nulls_and_follow_the_order(spark):
    df = spark.range(20).selectExpr("20 - id AS k", "CASE WHEN id % 2 = 0 THEN 'v' || id END AS v")
    got = profile.sample_values({"t": df}, {"t": ["k"]}, k=3).where("column_name = 'v'").collect()[0]
    assert list(got.sample_values) == ["v18", "v16", "v14"]


def test_samples_sort_no_whole_column(spark):
    df = spark.sql("SELECT * FROM VALUES (2, 'b', null), (1, 'z', null), (null, 'q', null), (1, 'a', null) AS v(k, v, none)")
    found = profile.sample_values({"t": df}, {"t": ["k"]}, k=3)
    got = {r.column_name: list(r.sample_values) for r in found.collect()}
    assert got == {"k": ["1", "1", "2"], "v": ["q", "a", "z"], "none": []}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" in plan and "Window" not in plan


def test_composite_key(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 1), (1, 2), (2, 1) AS v(a, b)")
    assert discovery.composite_key_check(df, ["a", "b"]).collect()[0].is_key
    assert not discovery.composite_key_check(df, ["a"]).collect()[0].is_key


def test_partial_overlap_needs_a_left_join(spark):
    tables = {
        "orders": spark.range(20).selectExpr("id AS o_id", "id % 10 AS o_shopkey"),
        "shops": spark.range(8).selectExpr("id AS s_shopkey", "'n' || id AS s_name"),
        "zones": spark.range(20).selectExpr("id AS z_shopkey", "id AS z"),
    }
    got = {
        (r.left_table, r.right_table): (r.join_type, r.overlap_pct)
        for r in discovery.discover_joins(tables).collect()
    }
    assert got == {("orders", "zones"): ("INNER", 100.0), ("shops", "zones"): ("INNER", 100.0)}
    tables["shops"] = tables["shops"].union(spark.range(90, 97).selectExpr("id", "'n'"))
    got = {
        (r.left_table, r.right_table): (r.join_type, r.overlap_pct)
        for r in discovery.discover_joins(tables).collect()
    }
    assert got[("orders", "shops")] == ("LEFT", 80.0)


def test_fingerprint_ignores_order(spark):
    one = {"b": spark.range(1).selectExpr("1 AS y", "2 AS x"), "a": spark.range(1)}
    two = {"a": spark.range(1), "b": spark.range(1).selectExpr("1 AS x", "2 AS y")}
    other = {"a": spark.range(1)}
    rows = discovery.catalogue_of(spark, "1", one)
    for feed, tables in (("2", two), ("3", other)):
        rows = rows.unionByName(discovery.catalogue_of(spark, feed, tables))
    prints = {r.feed: r.fingerprint for r in discovery.fingerprints(rows).collect()}
    import hashlib

    assert prints["1"] == prints["2"] == hashlib.sha256(b"a:id|b:x,y").hexdigest()
    assert prints["3"] != prints["1"]


def test_dictionary_text_beats_names(spark):
    stats = profile.column_stats(
        {"t": spark.range(3).selectExpr("'x' AS col7", "'a' AS city_code", "1 AS n")}
    )
    dictionary = spark.createDataFrame(
        [("col7", "the city of the shop", "t", "string")],
        "column_name string, description string, source_table string, data_type string",
    )
    ranked = mapping.rank_candidates(stats, dictionary)
    best = ranked.where("target = 'City' AND rank = 1").collect()[0]
    assert best.source_column == "col7"
    row = mapping.as_mappings(ranked, "f").where("target = 'City'").collect()[0]
    assert row.source_column == "col7" and len(row.alternatives) == 2


def test_cross_join_takes_one_row_only(spark):
    tables = {"m": spark.range(3).selectExpr("id", "'n' AS name"), "ref": spark.sql("SELECT 7 AS bid")}
    plan = [{"left_table": "m", "right_table": "ref", "join_type": "CROSS", "left_key": "", "right_key": ""}]
    mapped = [
        {"target": "AcquirerBID", "source_table": "ref", "source_column": "bid"},
        {"target": "DBAName", "source_table": "m", "source_column": "name"},
    ]
    built = master.build_target(tables, mapped, plan, "m", "id", distinct=False)
    assert [r.AcquirerBID for r in built.collect()] == [7, 7, 7]
    assert len(built.columns) == 32
    # alike in all 31 columns: the smallest key stays
    assert [r.row_id for r in master.distinct_rows(built).collect()] == [0]
    tables["ref"] = spark.range(2)
    with pytest.raises(ValueError, match="exactly one row"):
        master.build_target(tables, mapped, plan, "m", "id")


def test_reference_values(spark):
    tables = {
        "tx": spark.range(10).selectExpr("id", "'9' AS acq_bin"),
        "bin_ref": spark.range(10).selectExpr(
            "id", "' ' AS proc_name", "CASE WHEN id % 2 = 0 THEN 'b' ELSE 'a' END AS cib_name",
            "CAST(12.7 AS STRING) AS acq_bin",
        ),
    }
    detected = reference_values.detect(tables)
    got = {r.field: (r.value, r.source_table, r.source_column) for r in detected.collect()}
    assert got == {
        "processor_name": ("a", "bin_ref", "cib_name"),
        "acquirer_bin": ("12", "bin_ref", "acq_bin"),
    }
    resolved = {
        r.field: r.value
        for r in reference_values.resolve(detected, {"acquirer_bid": 5, "acquirer_bin": 0}).collect()
    }
    assert resolved == {
        "processor_name": "a", "processor_bin_cib": None, "acquirer_name": None,
        "acquirer_bid": "5", "acquirer_bin": "12",
    }
    order = {"tx": ["id"], "bin_ref": ["id"]}
    options = reference_values.options(tables, order).orderBy("field", "position").collect()
    # the names' first matching column is blank, so its table offers nothing
    assert [(r.field, r.value, r.source_table) for r in options] == [("acquirer_bin", "9", "tx")]


def test_options_take_the_first_seen_and_list_numbers_first(spark):
    df = spark.sql("SELECT * FROM VALUES (1,'b'),(2,'10'),(3,'9'),(4,'b'),(5,'a'),(6,'zz') AS v(i, bid)")
    found = reference_values.options({"t": df}, {"t": ["i"]}, limit=4).orderBy("position").collect()
    assert [r.value for r in found] == ["9", "10", "a", "b"]


def test_csv_line_ends_and_field_counts(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text('a;b\n1;"x\ny"\n2;""\n')
    options = {"multi_line": True, "delimiter": ";"}
    assert sorted(map(tuple, read_csv(spark, str(good), **options).collect()), key=str) == [("1", "x\ny"), ("2", None)]
    bad = tmp_path / "bad.csv"
    bad.write_text("a,b\n1,x\n2,z,extra\n3\n")
    with pytest.raises(Exception):
        read_csv(spark, str(bad)).collect()
    kept = {r.a: r._rejected for r in read_csv(spark, str(bad), on_bad_row="keep").collect()}
    assert kept == {"1": None, "2": "2,z,extra", "3": "3"}


def test_maps_that_are_equal_count_once(spark):
    df = spark.sql("SELECT map('a', 1, 'b', 2) AS m UNION ALL SELECT map('b', 2, 'a', 1)")
    assert profile.column_stats({"t": df}).first().distinct_count == 1
    assert [(r.column_name, r.distinct_count) for r in profile.approximate_stats(df).collect()] == [("m", 1)]


def test_fill_figures_need_no_value_shuffle(spark):
    df = spark.createDataFrame([("x", 1.0), (" \t", float("nan")), (None, None)], "a string, b double")
    got = {r.column_name: (r.row_count, r.null_count, r.blank_count) for r in profile.fill_stats({"t": df}).collect()}
    full = {r.column_name: (r.row_count, r.null_count, r.blank_count) for r in profile.column_stats({"t": df}).collect()}
    assert got == full == {"a": (3, 1, 1), "b": (3, 2, 0)}
    text = profile.fill_stats({"t": df})._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in text


def test_reference_values_without_numbers_or_columns(spark):
    from mercalith.operators.reference_values import detect, options

    odd = {"bins": spark.createDataFrame([("NaN",), ("1e30",), ("NaN",)], "acquirer_bin string")}
    assert [r.value for r in detect(odd).collect()] == ["NaN"]
    none = {"t": spark.createDataFrame([(1,)], "x int")}
    assert options(none, {"t": ["x"]}).count() == 0


def test_samples_of_dense_columns_share_one_search(spark):
    """Ties at the cut, sparse and empty columns get what a search of their own finds."""
    wide = [f"'{i}-' || id AS c{i}" for i in range(12)]
    df = spark.range(500).selectExpr(
        "id div 50 AS k", "id", *wide, "IF(id >= 300, 's' || (999 - id), NULL) AS sparse", "CAST(NULL AS INT) AS none"
    )
    for order in (["id"], ["k"], ["sparse", "id"]):
        found = profile.sample_values({"t": df}, {"t": order}, k=3)
        alone = [profile._top_values("t", df, c, order, 3) for c in df.columns]
        got = {r.column_name: list(r.sample_values) for r in found.collect()}
        assert got == {r.column_name: list(r.sample_values) for a in alone for r in a.collect()} and len(got) == 16
    found = profile.sample_values({"t": df}, {"t": ["id"]}, k=3)
    assert found._jdf.queryExecution().executedPlan().toString().count("TakeOrdered") < 10
