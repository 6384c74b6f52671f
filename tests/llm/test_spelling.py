"""Spelling variants against brute force, with every awkward case."""

import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mercalith.llm import spelling
from mercalith.llm.spelling import Tree, grouped, letters, near_words, one_inserted, one_replaced, points, variants

SCHEMA = "doc_id bigint, text string"
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counted(docs, damage=199):
    out = collections.Counter()
    for doc, text in docs:
        for run in RUN.findall(text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(v):
    out = {}
    for w, n in v.items():
        near = [x for x in v if abs(len(x) - len(w)) <= 1 and one_edit(w, x)]
        best = min(near, key=lambda x: (-v[x], x)) if near else None
        form = best if near and v[best] >= 5 * n else None
        out[w] = (form, n, len(near), v[form] if form else None)
    full = {}
    for w, (form, *rest) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        full[w] = (form, root, *rest)
    return full


def crowd(seed, n):
    """Words in dense families: many near each other, anagrams, accents, capitals beyond A-Z, counts in steps of five."""
    rng = np.random.default_rng(seed)
    alphabet = list("abcdeéÉñ÷ÿß")
    base = ["".join(rng.choice(alphabet, int(rng.integers(6, 12)))) for _ in range(n // 20)] + ["aaaaaa" * 60, "abcdef", "fedcba"]
    words = {}
    for w in base:
        words[w] = int(rng.choice([5, 6, 30, 150, 800]))
        for _ in range(20):
            x, i = list(w), int(rng.integers(len(w)))
            kind = rng.integers(4)
            if kind == 0:
                x[i] = str(rng.choice(alphabet))
            elif kind == 1:
                x.insert(i, str(rng.choice(alphabet)))
            elif kind == 2:
                del x[i]
            else:
                rng.shuffle(x)
            words["".join(x)] = int(rng.choice([4, 5, 6, 26, 130]))
    return words


@pytest.mark.parametrize(("sample", "cell", "leaf"), [(4096, 16_384, 24), (64, 20, 3), (200, 100, 1)])
def test_near_words_equal_brute_force(spark, monkeypatch, sample, cell, leaf):
    monkeypatch.setattr(spelling, "LEAF_WORDS", leaf)
    monkeypatch.setattr(spelling, "SLICE_PAIRS", 100 if leaf == 3 else 20_000)
    v = {w: n for w, n in crowd(1, 900).items() if len(w) >= 6}
    got = near_words(spark.createDataFrame(list(v.items()), "word string, n bigint").repartition(3), sample, cell)
    want = {}
    for w, (_, _, _, count, _) in plain_variants(v).items():
        if count:
            best = min((x for x in v if abs(len(x) - len(w)) <= 1 and one_edit(w, x)), key=lambda x: (-v[x], x))
            want[w] = (count, v[best], best)
    assert {r.word: (r.n_near, r.best_n, r.best) for r in got.collect()} == want


def test_variants_equal_brute_force(spark):
    words = crowd(2, 500) | {"zebraaa": 300, "zebraab": 40, "zebracb": 6}
    flat = [w for w, n in words.items() for _ in range(min(n, 300))]
    rng = np.random.default_rng(3)
    rng.shuffle(flat)
    docs = [(i - 5, " ".join(flat[i * 60 : i * 60 + 60])) for i in range(len(flat) // 60 + 1)]
    docs += [(None, "abcdefg, ABCDEFG abcdefg1abcdefg_abcdefg ÀBCDEFG" * 3), (0, None), (0, ""), (0, docs[3][1]), (0, docs[3][1])]
    table = spark.createDataFrame(docs, SCHEMA).repartition(4).withColumn("n", F.lit("x")).withColumn("word", F.lit(1))
    for damage in (199, 3):
        want = plain_variants(counted(docs, damage))
        got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants(table, damage).collect()}
        assert got == want
        assert damage == 3 or want["zebracb"][:2] == ("zebraab", "zebraaa")
    groups = {r.root: (r.n, {x.word: x.n for x in r.words}) for r in grouped(table).collect()}
    undamaged = plain_variants(counted(docs, 0))
    assert {w for g in groups.values() for w in g[1]} == set(undamaged)
    for root, (n, members) in groups.items():
        assert n == sum(members.values()) and all(undamaged[w][1] == root for w in members)


def test_searches_enter_every_near_leaf():
    rng = np.random.default_rng(4)
    at = points(rng.integers(97, 103, (3000, 9)).astype(np.uint8))
    tree = Tree.build(at, 8)
    home = np.empty(len(at), dtype=int)
    for leaf in range(len(tree.bounds) - 1):
        home[tree.order[tree.bounds[leaf] : tree.bounds[leaf + 1]]] = leaf
    assert tree.search(at, 0, 0)[1].tolist() == home[tree.search(at, 0, 0)[0]].tolist()
    for rise, fall in ((1, 1), (1, 0)):
        query, leaf = tree.search(at, rise, fall)
        found = set(zip(query.tolist(), leaf.tolist()))
        assert len(found) == len(query)  # no leaf twice
        for q in range(0, 3000, 50):
            move = at.astype(int) - at[q].astype(int)
            near = (np.maximum(move, 0).sum(1) <= rise) & (np.maximum(-move, 0).sum(1) <= fall)
            assert {(q, home[p]) for p in np.flatnonzero(near)} <= found
    assert len(leaf) < 3000 * (len(tree.bounds) - 1) / 4  # boxes are pruned


def test_letter_order():
    a = letters([b"abcdef", b"abcdef", b"abcdef"], 6)
    assert one_replaced(a, letters([b"abcdef", b"abxdef", b"bacdef"], 6)).tolist() == [False, True, False]
    assert one_inserted(a, letters([b"abcdeff", b"xabcdef", b"abdcefg"], 7)).tolist() == [True, True, False]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert variants(none).count() == 0 and grouped(none).count() == 0
    assert variants(spark.createDataFrame([(1, None), (None, " 12 ")], SCHEMA)).count() == 0
