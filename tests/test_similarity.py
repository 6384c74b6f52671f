import random

import duckdb
import pyarrow as pa

from mercalith.functions.similarity import jaro_winkler, may_exceed, score_pairs


def _pairs(n: int, seed: int):
    rng = random.Random(seed)

    def word():
        return "".join(rng.choice("abcde éß") for _ in range(rng.randint(0, 16)))

    left = [word() for _ in range(n)]
    right = [v[: rng.randint(0, len(v))] + word()[:4] if rng.random() < 0.6 else word() for v in left]
    return left, right


def test_scores_equal_the_database_function():
    left, right = _pairs(20_000, 1)
    left[3], right[4] = None, None
    db = duckdb.connect()
    db.register("t", pa.table({"i": range(len(left)), "a": left, "b": right}))
    expected = [
        r[0] for r in db.execute("SELECT jaro_winkler_similarity(a, b) FROM t ORDER BY i").fetchall()
    ]
    got = score_pairs(pa.array(left), pa.array(right)).to_pylist()
    for e, g in zip(expected, got):
        assert (e is None and g is None) or abs(e - g) < 1e-9


def test_sliced_and_long_input():
    left = pa.array(["skip", "a" * 5000, "martha"]).slice(1)
    right = pa.array(["skip", "a" * 4999 + "b", "marhta"]).slice(1)
    long, short = score_pairs(left, right).to_pylist()
    assert abs(long - (1 - (1 - (4999 / 5000 * 2 + 1) / 3) * 0.6)) < 1e-9
    assert abs(short - 0.9611111111) < 1e-9


def test_the_prune_never_loses_a_pair(spark):
    left, right = _pairs(20_000, 2)
    df = spark.createDataFrame(list(zip(left, right)), "a string, b string")
    scored = df.select("*", jaro_winkler("a", "b").alias("s")).selectExpr(
        "s", f"{may_exceed('a', 'b', 0.85)} AS kept"
    )
    assert scored.where("s > 0.85").count() > 500
    assert scored.where("s > 0.85 AND NOT coalesce(kept, false)").count() == 0
    assert scored.where("NOT kept").count() > 1000
