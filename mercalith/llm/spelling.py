"""Spelling variants: k-d trees over letter counts, box-pruned range searches, letter order verified.

A word is a point: how often it holds each letter.  One replaced letter lowers one count by one and
raises another by one (L1 distance two), one inserted letter raises one count by one (distance one).  So
the near words of a word of length L lie within that distance among the words of length L (replaced) and
of length L + 1 (inserted); each such length pair is one set of range searches, and the pair (L, L - 1)
needs none, as the shorter word's search tells both.

A k-d tree splits points by one letter's count at a time: at most t on the left, more on the right.  The
box of a subtree is what the splits above it leave; a search enters it only while the box is near
enough, that is, as long as at most one count has to rise and at most one (none, for inserted letters) to
fall.  No letter is crossed twice on a way down, so the distance to the box is the sum of the crossings.

The tree of a length has two parts.  The upper levels are planned from a bounded sample of its words
(SAMPLE_WORDS, by hash) and cut the space into cells; every word is filed in its one cell and sent as a
query to all cells its search enters.  The lower levels are built where the cell's words meet, down to
leaves of LEAF_WORDS.  What is found in a leaf is compared letter by letter.  Memory is a cell's points
and a slice of queries; queries stream through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercalith.llm.common import stored

LEAST_LETTERS = 6
LEAST_COUNT = 5
TIMES = 5
DAMAGE = 199
SAMPLE_WORDS = 4096
CELL_WORDS = 16_384
LEAF_WORDS = 24
SLICE_PAIRS = 20_000
SLICE_QUERIES = 4096

# a-z and U+00C0 to U+00FF, the letters of a lower-cased run, as columns of a point
_COLUMN = np.zeros(256, dtype=np.int64)
_COLUMN[97:123] = np.arange(26)
_COLUMN[192:256] = np.arange(26, 90)
LETTERS = 90

REPLACED, INSERTED = 1, 2


def words(docs: DataFrame, damage: int = DAMAGE) -> DataFrame:
    """(word, n): the words of `docs` (doc_id, text) that are long and frequent enough, with all their uses.

    A run is a maximal `[A-Za-z\\u00C0-\\u00FF]+` with A-Z lower-cased; where `damage` divides the crc32 of
    `<doc_id>:<run>` (a NULL doc_id reads as nothing), it loses one letter.  With 0 none is damaged.
    """
    runs = F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(r"[A-Za-zÀ-ÿ]+"), F.lit(0)))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    # lower() is fast, but would change U+00C0 to U+00DE too
    low = F.when(F.col("run").rlike(r"[À-Þ]"), F.translate("run", upper, lower)).otherwise(F.lower("run"))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), runs.alias("run"))
    rows = rows.select("doc", low.alias("run"))
    # a run of five letters can only get shorter
    rows = rows.filter(F.length("run") >= LEAST_LETTERS)
    word = F.col("run")
    if damage:
        rows = rows.select("run", F.crc32(F.concat("doc", F.lit(":"), "run")).alias("h"))
        at = (F.col("h") % F.length("run")).cast("int")
        shorter = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
        word = F.when(F.col("h") % damage == 0, shorter).otherwise(F.col("run"))
    counted = rows.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter((F.length("word") >= LEAST_LETTERS) & (F.col("n") >= LEAST_COUNT))


def letters(some: list[bytes], length: int) -> np.ndarray:
    """Words of one length, as bytes in Latin-1, one row for each."""
    return np.frombuffer(b"".join(some), np.uint8).reshape(-1, length)


def points(chars: np.ndarray) -> np.ndarray:
    """Counts of each letter, at most 255: two counts that are one apart stay at most one apart."""
    n = len(chars)
    flat = (np.arange(n)[:, None] * LETTERS + _COLUMN[chars]).ravel()
    return np.minimum(np.bincount(flat, minlength=n * LETTERS), 255).astype(np.uint8).reshape(n, LETTERS)


@dataclass
class Tree:
    """A k-d tree: a letter (-1 at leaves), a count and two children for each node; leaves are numbered."""

    letter: np.ndarray
    count: np.ndarray
    child: np.ndarray  # [node, 0 or 1]
    leaf: np.ndarray  # number of the leaf or -1
    order: np.ndarray  # points by leaf
    bounds: np.ndarray  # where each leaf begins in `order`, and the end

    @staticmethod
    def build(at: np.ndarray, leaf_size: int, most_levels: int = 64) -> Tree:
        letter, count, child, leaf, order, bounds = [], [], [], [], [], [0]

        def node(rows: np.ndarray, level: int) -> int:
            me = len(letter)
            letter.append(-1), count.append(0), child.append([0, 0]), leaf.append(-1)
            cut = _cut(at[rows]) if len(rows) > leaf_size and level < most_levels else None
            if cut is None:
                leaf[me] = len(bounds) - 1
                order.append(rows)
                bounds.append(bounds[-1] + len(rows))
            else:
                letter[me], count[me] = cut
                low = at[rows, cut[0]] <= cut[1]
                child[me] = [node(rows[low], level + 1), node(rows[~low], level + 1)]
            return me

        node(np.arange(len(at)), 0)
        return Tree(*(np.array(x) for x in (letter, count, child, leaf)), np.concatenate(order), np.array(bounds))

    def search(self, at: np.ndarray, rise: int, fall: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) for every leaf whose box is near: `rise` counts may rise by one, `fall` fall by one."""
        query = np.arange(len(at))
        node = np.zeros(len(at), dtype=np.int64)
        up, down = np.full(len(at), rise, dtype=np.int8), np.full(len(at), fall, dtype=np.int8)
        queries, leaves = [], []
        while len(query):
            end = self.letter[node] < 0
            queries.append(query[end])
            leaves.append(self.leaf[node[end]])
            query, node, up, down = query[~end], node[~end], up[~end], down[~end]
            v, t = at[query, self.letter[node]].astype(np.int64), self.count[node]
            right = v > t
            own = self.child[node, right.astype(np.int64)]
            other = self.child[node, (~right).astype(np.int64)]
            cross = np.flatnonzero(np.where(right, (v == t + 1) & (down > 0), (v == t) & (up > 0)))
            r = right[cross]
            query = np.concatenate([query, query[cross]])
            node = np.concatenate([own, other[cross]])
            up, down = np.concatenate([up, up[cross] - ~r]), np.concatenate([down, down[cross] - r])
        return np.concatenate(queries), np.concatenate(leaves)


def _cut(at: np.ndarray) -> tuple[int, int] | None:
    """The letter and count that split points most evenly; None if all points are one."""
    low = np.stack([(at <= t).sum(axis=0) for t in range(4)])
    even = np.minimum(low, len(at) - low)
    t, letter = divmod(int(even.argmax()), at.shape[1])
    if even[t, letter]:
        return letter, t
    spread = at.max(axis=0).astype(np.int64) - at.min(axis=0)
    letter = int(spread.argmax())
    if not spread[letter]:
        return None
    middle = int(np.median(at[:, letter]))
    return letter, middle if (at[:, letter] > middle).any() else middle - 1


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of letters differ at exactly one place."""
    return (a != b).sum(axis=1) == 1


def one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether the longer row is the shorter with one letter put in."""
    n = short.shape[1]
    same_front = np.cumprod(short == long[:, :n], axis=1).sum(axis=1)
    same_back = np.cumprod((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return same_front + same_back >= n


def _plans(spark, vocabulary: DataFrame, sample_words: int, cell_words: int) -> dict[int, Tree]:
    """The upper levels of the tree of each length that has too many words for one cell."""
    size = F.length("word").alias("len")
    sizes = {r["len"]: r["n"] for r in vocabulary.groupBy(size).agg(F.count("*").alias("n")).filter(F.col("n") > cell_words).collect()}
    if not sizes:
        return {}
    # a row for each length with a cell's worth of words and more
    table = spark.createDataFrame(sorted(sizes.items()), "len int, many bigint")
    chosen = vocabulary.select("word", size).join(F.broadcast(table), "len")
    chosen = chosen.filter(F.pmod(F.xxhash64("word"), F.col("many")) < sample_words)
    by: dict[int, list[bytes]] = {}
    for r in chosen.select("word").collect():
        by.setdefault(len(r.word), []).append(r.word.encode("latin-1"))
    return {
        n: Tree.build(points(letters(sorted(some), n)), 8, max(1, math.ceil(math.log2(sizes[n] / cell_words)))) for n, some in by.items()
    }


_DEALT = "len int, cell int, kind int, word string, n bigint"


def _deal(plans):
    """(len, cell, kind, word, n): each word once as a point (kind 0), and in every cell its searches enter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = plans.value
        for batch in batches:
            text = [x.encode("latin-1") for x in batch.column("word").to_pylist()]
            length = np.array([len(x) for x in text], dtype=np.int64)
            rows, lens, cells, kinds = [], [], [], []
            for n in np.unique(length).tolist():
                mine = np.flatnonzero(length == n)
                at = points(letters([text[i] for i in mine], n))
                for kind, where, rise, fall in ((0, n, 0, 0), (REPLACED, n, 1, 1), (INSERTED, n + 1, 1, 0)):
                    if where in trees:
                        row, cell = trees[where].search(at, rise, fall)
                    else:
                        row, cell = np.arange(len(mine)), np.zeros(len(mine), dtype=np.int64)
                    rows.append(mine[row])
                    cells.append(cell)
                    lens.append(np.full(len(row), where))
                    kinds.append(np.full(len(row), kind))
            if rows:
                row = pa.array(np.concatenate(rows))
                made = [pa.array(np.concatenate(x), pa.int32()) for x in (lens, cells, kinds)]
                yield pa.RecordBatch.from_arrays(
                    [*made, batch.column("word").take(row), batch.column("n").take(row)], names=["len", "cell", "kind", "word", "n"]
                )

    return run


def _best(word: np.ndarray, near: np.ndarray, near_n: np.ndarray, near_order: np.ndarray):
    """For each word its near words' number, and of them the one of largest n, the first by code points if equal."""
    order = np.lexsort((near_order, -near_n, word))
    word, near = word[order], near[order]
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.empty(0, np.int64)
    return word[first], np.diff(np.append(first, len(word))), near[first]


class _Cell:
    """The points of one cell in a tree of their own."""

    def __init__(self, length: int, some: list[bytes], n: np.ndarray):
        order = sorted(range(len(some)), key=some.__getitem__)  # code point order, as Latin-1 keeps it
        self.length, self.words = length, np.array([some[i] for i in order], dtype=object)
        self.n = n[order]
        self.chars = letters([some[i] for i in order], length)
        self.tree = Tree.build(points(self.chars), LEAF_WORDS)

    def pairs(self, chars: np.ndarray, kind: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, point) of all near pairs, some at a time."""
        query, leaf = self.tree.search(points(chars), 1, 1 if kind == REPLACED else 0)
        verify = one_replaced if kind == REPLACED else one_inserted
        for a in range(0, len(query), SLICE_PAIRS):
            q, x = query[a : a + SLICE_PAIRS], leaf[a : a + SLICE_PAIRS]
            begin, many = self.tree.bounds[x], self.tree.bounds[x + 1] - self.tree.bounds[x]
            row = np.repeat(np.arange(len(q)), many)
            each = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            point = self.tree.order[begin[row] + each]
            good = verify(chars[q[row]], self.chars[point])
            yield q[row[good]], point[good]


_NEAR = "word string, n_near bigint, best_n bigint, best string"


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n_near, best_n, best) from rows sorted by (len, cell, kind), partly summed up."""
    key, cell, held_words, held_n = None, None, [], []

    def rows(word, count, best, best_n) -> pa.RecordBatch:
        text = lambda x: pa.array([w.decode("latin-1") for w in x], pa.string())
        return pa.RecordBatch.from_arrays(
            [text(word), pa.array(count, pa.int64()), pa.array(best_n, pa.int64()), text(best)], names=["word", "n_near", "best_n", "best"]
        )

    def answer(length: int, kind: int, some: list[bytes], n: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = sorted(range(len(some)), key=some.__getitem__)
        some, n = np.array([some[i] for i in order], dtype=object), n[order]
        found = list(cell.pairs(letters(some.tolist(), length - (kind == INSERTED)), kind))
        q, p = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2
        word, count, best = _best(q, p, cell.n[p], p)
        yield rows(some[word], count, cell.words[best], cell.n[best])
        if kind == INSERTED:
            word, count, best = _best(p, q, n[q], q)
            yield rows(cell.words[word], count, some[best], n[best])

    for batch in batches:
        lens, cells, kinds = (np.asarray(batch.column(c)).astype(np.int64) for c in ("len", "cell", "kind"))
        n = np.asarray(batch.column("n"))
        text = [x.encode("latin-1") for x in batch.column("word").to_pylist()]
        change = np.flatnonzero(np.diff(lens) | np.diff(cells) | np.diff(kinds)) + 1
        for a, b in zip([0, *change.tolist()], [*change.tolist(), len(text)]):
            if a == b:
                continue
            if (here := (int(lens[a]), int(cells[a]))) != key:
                key, cell, held_words, held_n = here, None, [], []
            if kinds[a] == 0:
                held_words += text[a:b]
                held_n.append(n[a:b])
                continue
            if not held_words:
                continue  # a search in a cell without words
            if cell is None:
                cell = _Cell(key[0], held_words, np.concatenate(held_n))
            for i in range(a, b, SLICE_QUERIES):
                j = min(b, i + SLICE_QUERIES)
                yield from answer(key[0], int(kinds[a]), text[i:j], n[i:j])


def near_words(vocabulary: DataFrame, sample_words: int = SAMPLE_WORDS, cell_words: int = CELL_WORDS) -> DataFrame:
    """(word, n_near, best_n, best) of the words of `vocabulary` (word, n) that have a near word."""
    spark = vocabulary.sparkSession
    plans = _plans(spark, vocabulary, sample_words, cell_words)
    dealt = vocabulary.mapInArrow(_deal(spark.sparkContext.broadcast(plans)), _DEALT)
    # little data and much work: a task for a few cells each
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * sum(len(t.bounds) - 1 for t in plans.values()))
    met = dealt.repartition(tasks, "len", "cell").sortWithinPartitions("len", "cell", "kind").mapInArrow(_near, _NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best"))).alias("b")
    summed = met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return summed.select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best"))


def _roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, root) by pointer doubling: each form has at least TIMES the uses, so chains are short."""
    now = stored(forms.select("word", F.col("form").alias("root")), "forms")
    longest = max(1, math.ceil(math.log(max(most, 2), TIMES)))
    for _ in range(math.ceil(math.log2(longest))):
        on = now.select(F.col("word").alias("step"), F.col("root").alias("further"))
        joined = now.join(on, F.col("root") == F.col("step"), "left")
        now = stored(joined.select("word", F.coalesce("further", "root").alias("root")), "forms")
    return now


def variants(docs: DataFrame, damage: int = DAMAGE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of `docs` (doc_id, text).

    Two words are near if they differ by one inserted, deleted or replaced letter.  The form is the near
    word of largest n, the smallest in code point order of equals, if that is TIMES the word's n or more;
    the root is where the forms lead.  NULL and empty texts have no words; repeated rows count as often
    as they are there; a word may be as long as a text.  An empty table gives none.
    """
    vocabulary = stored(words(docs, damage), "words")
    near = near_words(vocabulary).withColumnRenamed("word", "w")
    told = vocabulary.join(near, F.col("word") == F.col("w"), "left")
    is_form = F.col("best_n") >= TIMES * F.col("n")
    formed = stored(
        told.select(
            "word", "n", F.when(is_form, F.col("best")).alias("form"), F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(is_form, F.col("best_n")).alias("form_n"),
        ),
        "variants",
    )
    most = formed.agg(F.max("n")).first()[0] or 1
    roots = _roots(formed.filter("form IS NOT NULL"), most).withColumnRenamed("word", "w")
    out = formed.join(roots, F.col("word") == F.col("w"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def grouped(docs: DataFrame, damage: int = 0) -> DataFrame:
    """(root, n, words): the groups of spelling variants with all their uses, without any damage.

    `words` lists (word, n) of the group, most frequent first; a root's variants are words within a few
    letters of it, so a list stays short.
    """
    found = variants(docs, damage)
    listed = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("word").alias("word"))))
    some = found.groupBy("root").agg(F.sum("n").alias("n"), listed.alias("l"))
    return some.select("root", "n", F.transform("l", lambda x: F.struct(x["word"], (-x["m"]).alias("n"))).alias("words"))
