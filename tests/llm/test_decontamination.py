"""Benchmark decontamination against brute force, with every awkward case."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mercalith.llm import decontaminate
from mercalith.llm.decontaminate import contamination, report

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_answer(text, items, window=10):
    w = words(text)
    hit, ids = set(), set()
    for item, t in items:
        v = words(t)
        k = min(window, len(v))
        for i in range(len(v) - k + 1 if k else 0):
            for j in range(len(w) - k + 1):
                if w[j : j + k] == v[i : i + k]:
                    hit |= set(range(j, j + k))
                    ids.add("" if item is None else str(item))
    return len(w), len(hit), sorted(ids)


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(11)
    pool = [f"w{i}" for i in range(30)] + ["the", "Éa", "ÀB", "x9", "9"]
    items = [(i, " ".join(rng.choice(pool, int(rng.integers(11, 40))))) for i in range(30)]
    items += [(40, "one two three"), (41, "Solo"), (42, ""), (43, None), (44, "... !!"), (None, "no id here at all")]
    items += [(3, items[4][1]), (3, items[4][1]), (45, items[4][1]), (46, "a a a a a a a a a a a a"), (100, "b b b b b b b b b b")]
    docs = [(i, t) for i, t in enumerate(["", None, "  ", "...", "ONE, two--three! solo", "one two", "a " * 40, "b b b b b b b b b"])]
    for i in range(60):
        body = rng.choice(pool, int(rng.integers(0, 80))).tolist()
        for _ in range(int(rng.integers(0, 3))):
            item = items[int(rng.integers(0, 30))][1].split()
            a = int(rng.integers(0, len(item) - 8))
            at = int(rng.integers(0, len(body) + 1))
            body[at:at] = [x.upper() + "," if x.isascii() else x for x in item[a : a + int(rng.integers(8, 25))]]
        docs.append((100 + i, " ".join(body) if i % 3 else "-\n".join(body)))
    long = rng.choice(pool, 60_000).tolist()
    docs += [(900, " ".join(long[:30_000] + items[7][1].split() + long[30_000:])), (None, items[2][1]), (105, items[3][1]), (105, "clean")]
    docs.append(docs[-1])
    d = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], SCHEMA).repartition(4)
    return d, spark.createDataFrame(items, "item_id bigint, text string"), docs, items


@pytest.mark.parametrize("block_bytes", [500, 4_000_000])
def test_hits_equal_brute_force(tables, block_bytes, monkeypatch):
    docs, items, rows, given = tables
    monkeypatch.setattr(contamination, "__defaults__", (10, False, block_bytes))
    clash = docs.select("*", *[F.lit("x").alias(c) for c in ("n_words", "n_hit", "items", "item_id", "word")])
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated, r.n_items) for r in report(clash, items).collect()), key=repr)
    want = []
    for i, t in rows:
        n, hit, ids = plain_answer(t, given) if i != 900 else (0, 0, [])
        want.append((i, n, hit, ids, hit > 0, len(ids)))
    assert [g for g in got if g[0] != 900] == sorted((w for w in want if w[0] != 900), key=repr)
    (long,) = (g for g in got if g[0] == 900)
    assert long[1] == 60_000 + len(words(given[7][1])) and "7" in long[3] and long[2] >= len(words(given[7][1]))


def test_long_items_are_cut_into_parts_that_lose_no_window(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PART_WORDS", 16)
    item = [f"q{i}" for i in range(100)]
    items = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    docs = spark.createDataFrame([(i, " ".join(["z", *item[i : i + 10], "z"])) for i in range(91)], "doc_id bigint, text string")
    assert {(r.n_hit, r.n_items) for r in report(docs, items).collect()} == {(10, 1)}


def test_hashes_that_meet_mark_nothing(spark, tables, monkeypatch):
    docs, items, rows, given = tables
    weak = lambda h, size: np.zeros(max(0, len(h) - size + 1), np.uint64)
    from mercalith.llm.decontaminate import Windows

    index = Windows.of([("1", "c d e f g h i j k l")], 10)
    monkeypatch.setattr(decontaminate, "gram_hashes", weak)
    crowded = Windows.of([("1", "c d e f g h i j k l"), ("2", "m n o p q r s t u v")], 10)
    at, place = crowded.candidates(np.arange(30, dtype=np.uint64), 10)
    text = [b"y"] * 5 + b"c d e f g h i j k l".split() + [b"y"] * 15
    good = decontaminate._verified(crowded, 10, text, at, place)
    assert sorted(set(at[good].tolist())) == [5] and index.owners == {(10, 0): [0]}


def test_documents_and_spans_are_removed(spark, tables):
    docs, items, rows, given = tables
    dirty = collect = [i for i, t in rows if i != 900 and plain_answer(t, given)[1]]
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert not {r.doc_id for r in kept.collect()} & set(dirty) - {105} and len(collect) > 10
    assert {r.doc_id: r.text for r in kept.collect()}[1] is None
    small = spark.createDataFrame(
        [(1, "Keep this, one TWO  three; and that!", 1), (2, "solo", 9), (3, None, None)], "doc_id bigint, text string, n_chars bigint"
    )
    cut = {r.doc_id: (r.text, r.n_chars) for r in decontaminate.decontaminate(small, items, spans=True).collect()}
    assert cut == {1: ("Keep this, ; and that!", 22), 2: ("", 0), 3: (None, None)}


def test_empty_tables(spark, tables):
    docs, items, rows, _ = tables
    assert report(docs.limit(0), items).count() == 0
    none = report(docs, items.limit(0))
    assert none.count() == len(rows) and none.filter("contaminated OR n_items > 0").count() == 0
