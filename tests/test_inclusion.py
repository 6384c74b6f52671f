"""Joins and composite keys found from the data alone."""

from decimal import Decimal
from itertools import combinations

import numpy as np
import pytest

from mercalith.operators import inclusion
from mercalith.operators.inclusion import composite_keys, inclusions


def pairs(found):
    return {(r.left_table, r.left_key, r.right_table, r.right_key): (r.join_type, r.overlap_pct) for r in found.collect()}


def test_names_do_not_matter(spark):
    z = spark.sql("SELECT * FROM VALUES ('a', 1), ('b', 2), ('c', 1) AS v(code, kind)")
    w = spark.sql("SELECT * FROM VALUES ('a'), ('a'), ('b'), (NULL) AS v(nation_ref)")
    x = spark.sql("SELECT * FROM VALUES ('a', 'a'), ('q', 'c') AS v(half, whole)")
    got = pairs(inclusions({"z": z, "w": w, "x": x}, 50))
    assert got == {
        ("w", "nation_ref", "z", "code"): ("LEFT", 100.0),
        ("x", "half", "z", "code"): ("LEFT", 50.0),
        ("x", "whole", "z", "code"): ("INNER", 100.0),
        ("w", "nation_ref", "x", "half"): ("LEFT", 50.0),
        ("w", "nation_ref", "x", "whole"): ("LEFT", 50.0),
    }
    assert not [p for p in pairs(inclusions({"z": z, "w": w, "x": x}, 100)) if p[1] == "half"]
    assert pairs(inclusions({"z": z, "w": w}, 50, same_name=True)) == {}


def test_types_meet_within_their_family(spark):
    long = "x" * 100
    a = spark.createDataFrame(
        [(1, Decimal("1.50"), 1.5, long, True), (2, Decimal("2.00"), float("nan"), long + "y", False)],
        "i int, d decimal(9,2), f float, s string, b boolean",
    ).selectExpr("*", "date_add(DATE'2020-01-01', i) AS day", "timestamp_ntz'2020-01-01 00:00:01' + make_interval(0,0,0,i) AS t", "array(i) AS r")
    b = spark.createDataFrame(
        [(1, Decimal("1.500"), 1.5, long), (2, Decimal("2.000"), 2.5, long + "y"), (3, Decimal("9.000"), 0.5, long + "z")],
        "k bigint, m decimal(20,3), g double, u string",
    ).selectExpr("*", "date_add(DATE'2020-01-01', CAST(k AS INT)) AS at", "timestamp_ntz'2020-01-01 00:00:01' + make_interval(0,0,0,CAST(k AS INT)) AS when")
    got = pairs(inclusions({"a": a, "b": b}, 100))
    right = {(p[1], p[3]) for p in got if p[2] == "b"}
    assert right == {("i", "k"), ("d", "m"), ("f", "g"), ("s", "u"), ("day", "at"), ("t", "when")}
    assert got["a", "f", "b", "g"] == ("LEFT", 100.0)  # NaN counts as no value


def test_implied_joins_go_and_equal_sets_stay(spark):
    at = {n: spark.range(n).selectExpr(f"id AS {c}") for n, c in ((5, "few"), (50, "some"), (500, "all"))}
    tables = {"f": at[5].union(at[5]), "s": at[50], "t": at[500], "u": at[500].toDF("twin")}
    got = set(pairs(inclusions(tables, 100)))
    assert ("f", "few", "s", "some") in got and ("s", "some", "t", "all") in got and ("s", "some", "u", "twin") in got
    assert ("f", "few", "t", "all") not in got and ("f", "few", "u", "twin") not in got
    assert ("t", "all", "u", "twin") in got and ("u", "twin", "t", "all") in got
    assert ("f", "few", "t", "all") in set(pairs(inclusions(tables, 100, drop_implied=False)))


def test_more_columns_than_a_word_has_bits(spark):
    wide = spark.range(20).selectExpr(*[f"id % 7 + {i} AS c{i}" for i in range(150)])
    key = spark.range(100).toDF("k")
    got = pairs(inclusions({"wide": wide, "key": key}, 100))
    assert {p[1] for p in got} == {f"c{i}" for i in range(94)}  # the largest value is i + 6


def test_empty_tables_refer_to_nothing(spark):
    none = spark.createDataFrame([], "a int, b string")
    nulls = spark.sql("SELECT CAST(NULL AS INT) AS a, CAST(NULL AS STRING) AS b")
    assert inclusions({"n": none, "m": nulls, "k": spark.range(3)}, 0).count() == 0
    assert composite_keys(none).count() == 0 and composite_keys(nulls).count() == 0


def plain_keys(rows, names, most):
    keys = [s for s in combinations(range(len(names)), 1) if len({r[s[0]] for r in rows}) == len(rows)]
    out = set()
    for size in range(2, most + 1):
        new = [
            s for s in combinations(range(len(names)), size)
            if not any(set(k) <= set(s) for k in keys) and len({tuple(r[i] for i in s) for r in rows}) == len(rows)
        ]
        keys += new
        out |= {", ".join(names[i] for i in s) for s in new}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_composite_keys_equal_a_plain_search(spark, seed):
    rng = np.random.default_rng(seed)
    names = list("pqrstu")
    rows = list({tuple(int(rng.integers(0, k)) for k in (2, 3, 4, 6, 9)) for _ in range(40)})
    rows = [(*r, 100 + i if seed == 2 else i // 2) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names))
    assert {r.key_columns for r in composite_keys(df).collect()} == plain_keys(rows, names, 6)
    assert {r.key_columns for r in composite_keys(df, 3).collect()} == plain_keys(rows, names, 3)


def test_composite_keys_need_filled_columns_and_unlike_rows(spark):
    df = spark.range(100).selectExpr("id div 10 AS a", "id % 10 AS b", "IF(id = 5, NULL, id % 10) AS c")
    found = composite_keys(df, name="t").collect()
    assert [(r.table_name, r.key_columns, r.n_columns) for r in found] == [("t", "a, b", 2)]
    assert composite_keys(df.union(df.limit(1))).count() == 0


def test_slices_only_refute(spark):
    """Rows that repeat fall into one slice, whichever it is."""
    df = spark.range(2000).selectExpr("id % 40 AS a", "id div 40 AS b", "id % 50 AS c")
    narrow = df.toDF("c0", "c1", "c2")
    assert inclusion._refuted(narrow, [(0, 1), (0, 2), (1, 2)], None) == {1}
    assert inclusion._refuted(narrow, [(0, 1), (1, 2)], 64) == set()
    few = narrow.where("c0 < 3").union(narrow.where("c0 = 1 AND c1 = 1"))
    assert inclusion._refuted(few, [(0, 1)], None) == {0}


def test_a_row_is_hashed_as_a_set_in_its_slice_only(spark):
    narrow = spark.range(4000).selectExpr("id % 3 AS c0", "id div 2 AS c1", "id % 2000 AS c2")
    # rows of a set meet in the slice of the column with the most values
    assert inclusion._refuted(narrow, [(0, 1), (1, 2), (0, 2)], 64, [3, 2000, 2000]) == set()
    twice = narrow.union(narrow)
    assert inclusion._refuted(twice, [(0, 1), (1, 2), (0, 2)], 64, [3, 2000, 2000]) == {0, 1, 2}


def test_tables_are_searched_side_by_side_in_order(spark):
    from mercalith.operators.inclusion import table_composite_keys

    grid = spark.range(100).selectExpr("id div 10 AS a", "id % 10 AS b", "'x' AS c")
    tables = {f"t{i}": grid for i in range(6)} | {"none": grid.limit(0), "twice": grid.union(grid)}
    found = [(r.table_name, r.key_columns) for r in table_composite_keys(tables, 2).collect()]
    assert found == [(f"t{i}", "a, b") for i in range(6)]
