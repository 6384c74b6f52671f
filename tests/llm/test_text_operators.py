"""Operators on texts against brute force, on small tables with every awkward case."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from mercalith.llm import bpe as bpe_module
from mercalith.llm.bpe import bpe, encode_documents, merge_long
from mercalith.llm.common import tokenizer_file
from mercalith.llm.language import Model, identify, pieces
from mercalith.llm.mixing import mix, mixed_documents
from mercalith.llm.perfect_hash import MinimalPerfectHash
from mercalith.llm.quality import accepted, exact_percentiles, quality
from mercalith.llm.simhash import deduplicated, near_duplicates
from mercalith.llm.substrings import remove_repeats, without_repeats
from mercalith.llm.token_store import lookup, scan_store, store_digest, write_store

WORD = re.compile(r"[^ \t-\r]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"w{i * 7919 % 5003}" for i in range(30_000))
ODD = [
    "", "  ", "a  b", " \n x", "x \n", "trailing ", "it's we'll  <|endoftext|> a<|endoftext|>", "\x1c\x1d a\x1cb",
    "a　b  c", "héllo wörld 123abc 4567", "x" * 700, "ab" * 900, "\n\n\n", "\t\ta", "!!!!!!" * 40, "é �",
    "١٢٣ ²³", "'S 'T I'Ve", " " * 100 + "x" + " " * 77, "one", "one two", LONG, "😀😀 emoji",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(ODD)]
    rows += [(100, None, None, None, None), (None, "no id at all", "en", None, 1), (None, None, None, None, None)]
    rows += [(7, ODD[9], "en", "s1", 5), (7, ODD[9], "en", "s1", 5), (-3, LONG, "de", "s0", 9)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))


def clash(df):
    """The same rows with further columns that are named like results."""
    from pyspark.sql import functions as F

    names = "n_tokens kept size taken component_id fingerprint n_words score held_out start row tie copy words".split()
    return df.select("*", *[F.lit("x").alias(n) for n in names])


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_merging_short_and_long_pieces_agrees(library):
    v = bpe().vocabulary
    for text in ("hello", "internationalization", "aaaaaaaaaaaaaaaaaaaaa", "zzxxyyzz", "e"):
        start = v.byte_id[np.frombuffer(text.encode(), np.uint8)].tolist()
        want = library.encode(text, add_special_tokens=False).ids
        assert merge_long(list(start), v.merges) == want
        ids, _ = bpe_module.encode_pieces([text.encode()], v)
        assert ids.tolist() == want


def test_bpe_equals_the_library(docs, library):
    for key, n, ids, decoded in encode_documents(clash(docs)).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"
    ).collect():
        texts = {r.text or "" for r in docs.collect() if r.doc_id == key}
        want = set()
        for t in texts:
            e = library.encode(t, add_special_tokens=False).ids
            back = library.decode(e, skip_special_tokens=False)
            want.add((len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
        assert (n, ids, decoded) in want
    assert encode_documents(docs).count() == docs.count()
    for r in encode_documents(docs.filter("doc_id BETWEEN 8 AND 22"), with_ids=True).collect():
        assert bpe().decode(np.array(r.token_ids, "<u4")) == ODD[r.doc_id]


def test_piece_cache_may_overflow(monkeypatch, library):
    monkeypatch.setattr(bpe_module, "CACHE_ENTRIES", 3)
    coder = bpe_module.Bpe()
    texts = ["a b c d e f g", "g f e d c b a zz", LONG[:5000]]
    got = [x.tolist() for x in coder.encode_texts(pa.array(texts))]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 1000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
    found = MinimalPerfectHash.build(keys)
    again = MinimalPerfectHash(found.sizes, found.bits)
    assert sorted(again.lookup(keys).tolist()) == list(range(n))


def test_token_store(spark, docs, library, tmp_path):
    want, at = [], 0
    given = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    for r in given:
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    path = write_store(clash(docs), f"{tmp_path}/store")
    got = sorted(scan_store(spark, path).collect(), key=lambda r: r.start)
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] == [w[0] for w in want]
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == collections.Counter(want)
    asked = spark.createDataFrame([(3,), (7,), (-3,), (3,), (555,), (None,)], "doc_id bigint")
    found = lookup(spark, path, asked).collect()
    assert collections.Counter(r.doc_id for r in found) == {3: 1, 7: 3, -3: 1}
    for r in found:
        texts = [x.text or "" for x in given if x.doc_id == r.doc_id]
        assert r.token_ids in [library.encode(t, add_special_tokens=False).ids + [2] for t in texts]


def test_lookup_of_keys_that_are_not_there(spark, tmp_path, monkeypatch):
    from mercalith.llm import token_store

    monkeypatch.setattr(token_store, "WANTED_KEYS", 7)
    given = spark.range(0, 400, 2).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    path = write_store(given, f"{tmp_path}/store")
    got = {r.doc_id for r in lookup(spark, path, spark.range(-100, 600).toDF("doc_id")).collect()}
    assert got == set(range(0, 400, 2))


def repeat_words(w):
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    return len({j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)})


def test_quality_counts_and_verdicts(spark, docs, empty):
    rng = np.random.default_rng(2)
    good = [" ".join(rng.choice(["the", "of", "river", "stone", "light", "house"], 60)) for _ in range(60)]
    junk = [" ".join(x.upper() + "!!" for x in t.split()) for t in good[:20]]
    loop = "a b c d e f g h " * 5 + "z"
    texts = [*good, *junk, loop, "x\nx\n \n\nx y\nx"]
    more = spark.createDataFrame([(1000 + i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    labels = spark.createDataFrame([(1000 + i, 1 if i < 30 else 0, 0) for i in range(30)] + [(None, 1, 0)], "doc_id bigint, quality int, toxic int")
    both = docs.union(more)
    got = quality(clash(both), labels).collect()
    assert len(got) == both.count()
    for r in got:
        t = r.text or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeat_words(w))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id for r in got if r.kept}
    failed = {r.doc_id for r in got if r.base_failed}
    assert set(range(1000, 1060)) - failed <= kept
    assert not kept & set(range(1060, 1080))
    assert accepted(both, labels).columns == both.columns
    assert quality(empty, labels).count() == 0
    assert quality(more, labels.limit(0)).filter("NOT base_failed AND NOT kept").count() == 0


def plain_verdicts(texts, trusted):
    """(score, good) of each text by dictionaries: counts of hashed n-grams, log ratios, their mean, the threshold."""
    import math

    import regex
    import xxhash

    from mercalith.llm.quality import BINS, LOW_END

    cut = regex.compile(r"[\x20\x09-\x0D]+|(?<=[\p{L}\p{N}])(?=[^\p{L}\p{N}\x20\x09-\x0D])", regex.V1)
    of_long = lambda x, seed: xxhash.xxh64_intdigest(x.to_bytes(8, "little"), seed)

    def bins(text):
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in cut.split((text or "").strip(" \t\n\x0b\x0c\r"))]
        signed = lambda x: x - 2**64 if x >= 2**63 else x
        pairs = [of_long(y, of_long(x, 42)) for x, y in zip(h, h[1:])]
        return [signed(x) % BINS for x in [*h, *pairs]]

    corpus, good = collections.Counter(range(BINS)), collections.Counter(range(BINS))
    for i, t in texts:
        corpus.update(bins(t))
        if i in trusted:
            good.update(bins(t))
    n, m = sum(corpus.values()), sum(good.values())
    score = lambda t: sum(math.log(good[b] / m) - math.log(corpus[b] / n) for b in bins(t)) / len(bins(t))
    scores = [score(t) for _, t in texts]
    low, middle = np.percentile([s for s, (i, _) in zip(scores, texts) if i in trusted], [100 * LOW_END, 50])
    return scores, 2 * low - middle


def test_the_verdict_is_the_plain_likelihood_ratio(spark):
    rng = np.random.default_rng(12)
    pool = ["the", "of", "river.", "stone,", "light", "house", "and", "in"]
    texts = [" ".join(rng.choice(pool, 40)) for _ in range(60)] + [" ".join(rng.choice([f"z{i}!" for i in range(50)], 40)) for _ in range(30)]
    texts += [texts[0], texts[0], texts[70], texts[70], "", None, " \n ", "one", "(a) b--c"]
    rows = [*enumerate(texts), (3, "repeated id of a trusted one"), (None, "no id")]
    more = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    trusted = set(range(20))
    labels = spark.createDataFrame([(i, 1, 0) for i in trusted] + [(5, 1, 0), (40, 0, 1)], "doc_id bigint, quality int, toxic int")
    want, threshold = plain_verdicts(rows, trusted)
    got = quality(more.repartition(3), labels).collect()
    plain = sorted((repr((i, t)), s, s >= threshold) for (i, t), s in zip(rows, want))
    found = sorted((repr((r.doc_id, r.text)), r.score, r.kept, r.base_failed) for r in got)
    assert len(plain) == len(found)
    for (a, s, good), (b, t, kept, failed) in zip(plain, found):
        assert a == b and abs(s - t) < 1e-9
        assert abs(s - threshold) < 1e-9 or kept == (good and not failed)


def test_a_score_at_the_threshold_is_kept(spark):
    """All texts alike: every score is the threshold."""
    text = " ".join(f"w{i}" for i in range(40))
    more = spark.createDataFrame([(i, text, "en", "s", 1) for i in range(9)], SCHEMA)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert {r.kept for r in quality(more, labels).collect()} == {True}


def test_every_trusted_document_counts(spark):
    """All documents are trusted, so both models are the same and every score is exactly 0."""
    more = spark.range(20_100).selectExpr("id AS doc_id", "concat('word', id, ' and word', id % 97) AS text")
    labels = more.selectExpr("doc_id", "1 AS quality")
    assert quality(more, labels).where("score <> 0").count() == 0


def test_exact_percentiles(spark):
    rng = np.random.default_rng(5)
    for values in (rng.normal(size=1001), rng.integers(0, 4, 500).astype(float), np.array([2.5]), np.array([1.0, 4.0])):
        frame = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(7)
        assert np.allclose(exact_percentiles(frame, [0.002, 0.5, 1.0]), np.percentile(values, [0.2, 50, 100]), rtol=1e-12, atol=0)
    assert exact_percentiles(spark.createDataFrame([], "v double"), [0.5]) is None


def fingerprint(text):
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = WORD.findall(low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in ([" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_links(spark, docs, empty):
    rng = np.random.default_rng(3)
    base = [rng.choice([f"v{i}" for i in range(900)], 300).tolist() for _ in range(12)]
    texts = []
    for b in base:  # chains of copies with one more word changed each
        for k in range(40):
            b = list(b)
            b[int(rng.integers(300))] = f"n{k}"
            texts.append(" ".join(b))
    more = spark.createDataFrame([(5000 - i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    both = docs.union(more)
    got = near_duplicates(clash(both))
    assert got.count() == both.count()
    table = got.toPandas()
    given = both.toPandas()
    named = given[given.doc_id.notna()]
    prints = {int(i): set() for i in named.doc_id}
    for i, t in zip(named.doc_id, named.text):
        prints[int(i)].add(fingerprint(t or ""))
    fps = sorted({fingerprint(t or "") for t in given.text})
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    first = {}
    for i, fs in prints.items():
        for f in fs:
            first[root(f)] = min(first.get(root(f), i), i)
    for r in table.itertuples():
        f = int(r.fingerprint, 16)
        want = first.get(root(f))
        assert (want is None and np.isnan(r.component_id)) or r.component_id == want
    kept = deduplicated(both)
    assert kept.columns == both.columns
    assert kept.count() == len({root(f) for f in fps})
    assert near_duplicates(empty).count() == 0


def test_crowded_keys_lose_no_link(spark):
    from mercalith.llm.components import components
    from mercalith.llm.simhash import links

    rng = np.random.default_rng(4)
    centre = int(rng.integers(2**62))
    near = {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (300, 2))} | {centre}
    prints = spark.createDataFrame([(x,) for x in near], "fp bigint")
    roots = components(links(prints, frequent=4))
    assert roots.select("root").distinct().count() == 1 and roots.count() == len(near)


def removed(texts):
    """{id: (n words, n removed, kept)} by brute force; ids are unique."""
    w = {i: WORD.findall(t or "") for i, t in texts.items()}
    first = {}
    for i, x in w.items():
        for k in range(len(x) - 12):
            key = tuple(x[k : k + 13])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, x in w.items():
        gone = {j for k in range(len(x) - 12) if first[tuple(x[k : k + 13])] < i for j in range(k, k + 13)}
        out[i] = (len(x), len(gone), " ".join(v for j, v in enumerate(x) if j not in gone))
    return out


@pytest.mark.parametrize("group_rows", [3, 200_000])
def test_substrings(spark, docs, empty, monkeypatch, group_rows):
    from mercalith.llm import substrings

    monkeypatch.setattr(substrings.repeats, "__defaults__", (13, 7, group_rows))
    rng = np.random.default_rng(5)
    words = [f"t{i}" for i in range(40)] + ["the", "of"] * 10
    passage = rng.choice(words, 70).tolist()
    texts = {i: ODD[i] for i in range(len(ODD)) if i != 7}
    for i in range(60, 160):
        x = rng.choice(words, int(rng.integers(0, 90))).tolist()
        if i % 3 == 0:
            a = int(rng.integers(0, 50))
            x[len(x) // 2 : len(x) // 2] = passage[a : a + int(rng.integers(10, 40))]
        texts[i] = " ".join(x) if i % 7 else "\n".join(x)
    texts[200] = texts[90]
    texts[201] = None
    texts[202] = " ".join(passage * 3)
    given = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts.items()], SCHEMA).repartition(4)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(clash(given)).collect()}
    assert got == removed(texts)
    again = {r.doc_id: r for r in without_repeats(given).collect()}
    assert len(again) == len(texts) and again[70].text in (texts[70], got[70][2])
    both = remove_repeats(docs)
    assert both.count() == docs.count()
    assert {r.n_removed for r in both.filter("doc_id IS NULL").collect()} == {0}
    assert remove_repeats(empty).count() == 0


@pytest.mark.parametrize("group_rows", [3, 200_000])
def test_repeated_ids_of_different_texts(spark, monkeypatch, group_rows):
    from mercalith.llm import substrings

    monkeypatch.setattr(substrings.repeats, "__defaults__", (13, 7, group_rows))
    a = " ".join(f"a{i}" for i in range(40))
    b = " ".join(f"b{i}" for i in range(40))
    given = [(1, a), (2, a + " x " + b), (2, "y " + b), (2, "short"), (3, b), (3, None), (3, a), (2, a + " x " + b), (None, a), (5, "z " + a[:60])]
    rng = np.random.default_rng(8)
    given += [(int(rng.integers(6, 20)), " ".join(rng.choice([f"c{i}" for i in range(3)], 30))) for _ in range(30)]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(
        spark.createDataFrame(given, "doc_id bigint, text string").repartition(3)).collect() if r.doc_id is not None)
    first = {}
    for i, t in given:
        w = WORD.findall(t or "")
        for k in range(len(w) - 12 if i is not None else 0):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, i), i)
    want = []
    for i, t in given:
        if i is None:
            continue
        w = WORD.findall(t or "")
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        want.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    assert got == sorted(want)


def test_maximal_repeats(spark):
    from mercalith.llm.substrings import maximal_repeats

    a = [f"a{i}" for i in range(100)]
    b = [f"b{i}" for i in range(30)]
    given = [(1, a), (2, ["x"] + a[10:60] + ["y"] + a[70:83]), (3, b + a[:12]), (4, a[5:60] + ["q"] + b), (5, ["q"] + b)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in given], "doc_id bigint, text string").repartition(3)
    got = {tuple(r) for r in maximal_repeats(docs).collect()}
    assert got == {(2, 1, 50, 1, 10), (2, 52, 13, 1, 70), (4, 0, 55, 1, 5), (4, 56, 30, 3, 0), (5, 1, 30, 3, 0), (5, 0, 13, 4, 55)}


def test_answers_over_batches():
    """A run's documents may come in any number of batches."""
    from mercalith.llm.substrings import _answers

    rng = np.random.default_rng(9)
    for _ in range(300):
        anchors = np.sort(rng.integers(0, 4, 12))
        docs = rng.integers(0, 3, 12)
        cuts = [0, *np.sort(rng.integers(0, 13, 4)).tolist(), 12]
        batches = [
            pa.RecordBatch.from_arrays([pa.array(docs[a:b]), pa.array(anchors[a:b]), pa.array(np.zeros(b - a, dtype=bool))], names=["doc", "anchor", "known"])
            for a, b in zip(cuts, cuts[1:])
        ]
        got = [(x["anchor"], x["doc"]) for out in _answers(iter(batches)) for x in out.to_pylist()]
        several = {a for a in anchors if len(set(docs[anchors == a])) > 1}
        assert set(got) == {(a, d) for a, d in zip(anchors, docs) if a in several}


def targets(size, weight, most=3):
    """Excess reshared by weight until no target is above its limit."""
    total, full = sum(size.values()), set()
    while True:
        left = total - sum(most * size[s] for s in full)
        open_ = sum(weight[s] for s in size if s not in full)
        level = left / open_ if open_ else 0
        over = {s for s in size if s not in full and level * weight[s] > most * size[s]}
        if not over:
            return {s: most * size[s] if s in full else level * weight[s] for s in size}
        full |= over


def test_mixing(spark, docs, empty):
    rng = np.random.default_rng(6)
    more = [(2000 + i, "w " * int(rng.integers(1, 60)), "en", "abcdefg"[min(6, int(rng.geometric(0.5)))], 1) for i in range(700)]
    both = docs.union(spark.createDataFrame(more, SCHEMA))
    got = mix(clash(both)).toPandas()
    assert len(got) == both.count()
    size = got.groupby("source", dropna=False)["size"].sum()
    names = sorted((s for s in size.index if isinstance(s, str))) + [s for s in size.index if not isinstance(s, str)]
    total = {str(s): int(size[s]) for s in names}
    want = targets(total, {str(s): i % 3 + 1 for i, s in enumerate(names)})
    for s, some in got.groupby("source", dropna=False):
        assert np.allclose(some.target, want[str(s)])
        assert (some.source_size == total[str(s)]).all()
        assert abs(some.taken.sum() - want[str(s)]) <= some["size"].max()
        assert (some.taken <= 3 * some["size"]).all()
    again = mix(both.repartition(3)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(repr, again[key].values.tolist())) == sorted(map(repr, got[key].values.tolist()))
    assert mixed_documents(both).columns == both.columns
    taken = sum(len(WORD.findall(r.text or "")) for r in mixed_documents(both).collect())
    assert taken == got.taken.sum()
    assert mix(empty).count() == 0


def test_rows_without_an_id_are_spread(spark):
    from mercalith.llm import mixing

    rows = spark.range(6000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "concat_ws(' ', id, id % 7) AS text", "IF(id % 3 = 0, 'a', 'b') AS source")
    sized = mixing._sized(rows, [])
    assert sized.selectExpr("count(DISTINCT substring(_key, 1, 2)) AS n").first().n == 256
    got = mix(rows).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    for r in got:
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 2


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(7)
    model = Model.equal(2)
    model.p = rng.random(model.p.shape)
    known = pieces()

    def total(word, k):
        if not word:
            return 1.0
        out = 0.0
        for j in range(1, len(word) + 1):
            p = known.get(word[:j], 0 if j == 1 else None)
            if p is not None:
                out += model.p[p, k] * total(word[j:], k)
        return out

    words = [" the", " international", "x", " ꙮb", " naïve"]
    got = np.exp(model.log_probabilities(words))
    assert np.allclose(got, [[total(w, k) for k in range(2)] for w in words])
    # a word's expected uses add up to its length
    counts = model.expected(words, np.ones((len(words), 2)))
    lengths = np.zeros(len(model.p))
    lengths[list(known.values())] = [len(x) for x in known]
    lengths[0] = 1
    assert np.allclose(lengths @ counts, sum(map(len, words)))


def test_long_words_are_summed_whole(monkeypatch):
    """Words beyond each limit, against the sum over all segmentations by recursion."""
    from functools import lru_cache

    from mercalith.llm import language

    rng = np.random.default_rng(17)
    model = Model.equal(2)
    model.p = rng.random(model.p.shape) * 0.2
    known = pieces()
    assert all(p == p.lower() for p in known) and any(len(p) > 12 for p in known)

    def total(word, k):
        @lru_cache(None)
        def rest(i):
            if i == len(word):
                return 1.0
            out = 0.0
            for j in range(i + 1, min(len(word), i + model.longest) + 1):
                p = known.get(word[i:j], 0 if j == i + 1 else None)
                out += 0 if p is None else model.p[p, k] * rest(j)
            return out

        return rest(0)

    words = [" " + w for w in ("internationalization" * 3, "theandthing" * 9, "ꙮ" * 40, "हिन्दीभाषा" * 6, "abc", "x" * 33)]
    want = np.log([[total(w, k) for k in range(2)] for w in words])
    weights = rng.random((len(words), 2))
    plain = model.expected([words[4]], weights[4:5])
    results = []
    for short, stepwise, stretch in ((31, 256, 1024), (31, 35, 16), (5, 6, 7), (1, 2, 64)):
        monkeypatch.setattr(language, "SHORT", short)
        monkeypatch.setattr(language, "STEPWISE", stepwise)
        monkeypatch.setattr(language, "STRETCH", stretch)
        assert np.allclose(model.log_probabilities(words), want)
        results.append(model.expected(words, weights))
        assert np.allclose(model.expected([words[4]], weights[4:5]), plain)
    for r in results[1:]:
        assert np.allclose(r, results[0])
    # every character of a word is in one piece
    lengths = np.zeros(len(model.p))
    lengths[list(known.values())] = [len(x) for x in known]
    lengths[0] = 1
    assert np.allclose(lengths @ results[0], np.array(list(map(len, words))) @ weights)
    assert np.isfinite(Model.equal(2).log_probabilities([" " + "ꙮ" * 50_000])).all()


def test_words_keep_their_marks_and_ties_go_to_the_first(spark):
    from mercalith.llm.language import _coded

    words, index, owner = _coded(pa.array(["हिन्दी भाषा", "a\u0301b ̈ \u0301", "", "ab"], pa.large_string()))
    assert [words[i] for i in index] == [" हिन्दी", " भाषा", " a\u0301b", " ab"] and owner.tolist() == [0, 0, 1, 3]
    rows = [(i, "same words here", lang) for i, lang in enumerate("ba" * 10)] + [(100, "same words", None), (101, "\u0301", None)]
    got = {r.doc_id: (r.lang_pred, round(r.score, 6)) for r in identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").where("doc_id < 16 OR doc_id > 50")).collect()}
    learnt = [lang for i, _, lang in rows[:16] if zlib.crc32(str(i).encode()) % 4 != 2]
    if learnt.count("a") == learnt.count("b"):
        assert got[100] == ("a", 0.5)
    assert got[100][0] in "ab" and got[101] == ("und", 0.0)


def test_language(spark, docs, empty):
    sample = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify(clash(sample)).join(sample.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == h for i, h in zip(got.doc_id, got.held_out))
    odd = identify(docs.union(sample.filter("doc_id >= 800"))).toPandas()
    assert len(odd) == docs.count() + sample.filter("doc_id >= 800").count()
    assert ((odd.score >= 0) & (odd.score <= 1)).all()
    none = odd[odd.doc_id.isin([0, 1, 12, 100, 16])]
    assert set(none.lang_pred) == {"und"}
    assert identify(empty).count() == 0
    unlabelled = docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    assert {r.lang_pred for r in identify(unlabelled).collect()} == {"und"}


def test_store_digest_of_nothing(empty):
    assert store_digest(empty).count() == 0
    assert encode_documents(empty).count() == 0


def test_trust_is_a_flag_of_every_row_and_both_counts_come_from_one_pass(spark):
    from mercalith.llm.quality import BINS, bin_counts, with_trust

    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "a, c"), (None, "d"), (70, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (70, 1), (None, 1)], "doc_id bigint, quality int")
    known = with_trust(rows, labels)
    assert sorted(tuple(r) for r in known.na.fill("").collect()) == [("", True), ("a b", True), ("a b", True), ("a, c", False), ("d", False)]
    t, n = bin_counts(known)
    # unigrams and bigrams: a b, a b, one empty word; besides a , c and d
    assert (sum(t) - BINS, sum(n) - BINS) == (7, 7 + 5 + 1)
    assert all(a <= b for a, b in zip(t, n))
