"""Conversation repair against a plain search over all edits, with every awkward case."""

import hashlib
import itertools
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from mercalith.llm import repair
from mercalith.llm.repair import damaged, repaired, report

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
SPACES = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        h = zlib.crc32(key.encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        role = "user" if h == 4 else role
        out += [(conv, turn, role, text)] * (2 if h == 3 else 1)
    return out


def plain_report(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha256) of one conversation's rows."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
    if not rows:
        return 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()
    faults, seen = [], set()
    for _, _, role, text in rows:
        bare = text.strip(SPACES)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))

    def follows(so_far, role):
        """so_far is the last role's initial or nothing."""
        return (so_far + role[:1]) in ("s", "u", "su", "ua", "au")

    import sys

    sys.setrecursionlimit(100_000)

    @lru_cache(maxsize=None)
    def best(i, before, inserts):
        """(cost, audit, roles) of the cheapest rest; at most 3 inserts in a row are of use."""
        found = []
        if i == len(rows) and before in ("", "a"):
            found.append((0, "", ()))
        if inserts < 3:
            for role in ("user", "assistant"):
                if follows(before, role):
                    c, a, t = best(i, role[0], inserts + 1)
                    found.append((c + 2, "I" + a, (f"{role}:", t)))
        if i < len(rows):
            role, text = rows[i][2:]
            more = faults[i] == "truncated"
            c, a, t = best(i + 1, before, 0)
            found.append((c + 3, "D" + a, t))
            if faults[i] not in ("blank", "duplicate"):
                if role[:1] and follows(before, role):
                    c, a, t = best(i + 1, role[0], 0)
                    found.append((c + more, "K" + a, (f"{role}:{text}", t)))
                for new in ("user", "assistant"):
                    if follows(before, new):
                        c, a, t = best(i + 1, new[0], 0)
                        found.append((c + 2 + more, "R" + a, (f"{new}:{text}", t)))
        return min(found, key=lambda x: x[:2]) if found else (10**9, "", ())

    cost, audit, chain = best(0, "", 0)
    texts = []
    while chain:
        texts.append(chain[0])
        chain = chain[1]
    count = faults.count
    sha = hashlib.sha256("\n".join(texts).encode()).hexdigest()
    return gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, sha


def conversations(n, longest, seed):
    rng = np.random.default_rng(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "u", "s", "admin", "user", "assistant", "assistant", "user"]
    texts = ["Hi.", "ok", "", " \n", None, "Yes!", "What?  ", "no end", "é。", "A. b", "x.\x1c", "...", "Long " * 50 + "."]
    rows = []
    for c in range(n):
        for t in range(int(rng.integers(0, longest))):
            role = roles[int(rng.integers(len(roles)))] if rng.random() < 0.4 else ("user", "assistant")[t % 2]
            text = texts[int(rng.integers(len(texts)))] if rng.random() < 0.3 else f"Turn {t} of {c}{'.' if rng.random() < 0.8 else ''}"
            turn = None if rng.random() < 0.05 else int(t + (rng.random() < 0.1) - (rng.random() < 0.1))
            rows.append((c if c != 5 else None, turn, role, text))
    return rows


def check(spark, rows):
    got = report(damaged(table := spark.createDataFrame(rows, SCHEMA).repartition(5)), table.withColumn("cost", F.lit(1)))
    by = {}
    for r in damage(rows):
        by.setdefault(r[0], []).append(r)
    want = {c: plain_report(by.get(c, [])) for c in {r[0] for r in rows}}
    found = {r[0]: tuple(r)[1:] for r in got.collect()}
    assert found == want
    return want


def test_reports_equal_a_plain_search(spark):
    want = check(spark, conversations(400, 12, 1))
    assert {c for w in want.values() for c in w[6]} == set("DIKR")
    assert any(w[6] == "" for w in want.values())


@pytest.mark.parametrize("bits", [0, 1, 3])
def test_conversations_over_many_segments(spark, monkeypatch, bits):
    monkeypatch.setattr(repair, "SEGMENT_BITS", bits)
    rows = conversations(25, 14, 2)
    rows += [(77, t, ("user", "assistant")[t % 3 == 1], f"Part {t // 2}.") for t in range(300)]
    check(spark, rows)


def test_small_groups_of_segments_agree(spark, monkeypatch):
    monkeypatch.setattr(repair, "GROUP_CELLS", 8)
    check(spark, conversations(60, 9, 3))


def test_all_short_sequences():
    """Every sequence of up to four kinds of rows: costs and audits against enumeration of all edits."""
    end = np.array([[0, 4, 2, 0]])
    for n in range(1, 5):
        for kinds in itertools.product([(0, 1), (0, 2), (2, 3), (1, 2), (0, 0)], repeat=n):
            codes = np.array([[f + 4 * w for f, w in kinds]])
            go = repair.costs_to_go(codes, np.array([n]), end)
            (audits,), _ = repair.least_audits(codes, np.array([n]), go, np.array([True]))
            rows = [
                (0, i, {0: "x", 1: "sys", 2: "user", 3: "assistant"}[w], {0: f"{i}.", 1: " ", 2: f"{i}"}[f]) for i, (f, w) in enumerate(kinds)
            ]
            assert (go[0, 0, 0], audits[0]) == plain_report(rows)[5:7]


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi"), (1, 2, "user", "Hi"), (2, 0, "system", "Be kind."), (None, 0, "tool", "x.")]
    rows += [(3, 0, "user", "A."), (3, 1, "assistant", "B."), (3, 2, "tool", "C."), (3, 3, "assistant", "D.")]
    rows += [(4, 0, "system", "S."), (4, 1, "user", "Q.")]
    got = repaired(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "place", "part").collect()
    assert [(r.conv_id, r.edit, r.role, r.text) for r in got] == [
        (1, "I", "user", ""), (1, "K", "assistant", "Hello."),
        (3, "K", "user", "A."), (3, "K", "assistant", "B."), (3, "R", "user", "C."), (3, "K", "assistant", "D."),
        (4, "K", "system", "S."), (4, "K", "user", "Q."), (4, "I", "assistant", ""),
    ]


def test_other_key_types_and_empty_tables(spark):
    rows = spark.createDataFrame([("a", 1, "user", "Hi."), ("b", None, None, None)], "conv_id string, turn int, role string, text string")
    assert {r.conv_id: r.audit for r in report(rows, rows).collect()} == {"a": "KI", "b": "D"}
    assert report(rows.limit(0), rows).filter("cost = 0 AND audit = ''").count() == 2
    assert report(rows.limit(0), rows.limit(0)).count() == 0 and repaired(rows.limit(0)).count() == 0
