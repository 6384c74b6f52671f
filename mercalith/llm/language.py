"""Language identification by unigram pieces, summed over all segmentations.

For each language a probability is learned for every piece of a fixed public vocabulary.  The
probability of a word is the sum, over all ways to cut it into pieces, of the product of the pieces'
probabilities (a forward algorithm); a text's is the product over its words.  Words are runs of
letters and the marks on them, lower case, with a space before the first, so that pieces that begin a
word are pieces of their own.  Words may be of any length: up to SHORT characters the sums are taken
as they are, many words at once; beyond that in logarithms, and beyond STEPWISE characters stretch by
stretch, carrying only as many sums along as the longest piece has characters.

Learning is the same sum with a backward pass: every word adds to each piece the share of its
segmentations that use it (one step of expectation maximisation, from equal probabilities; more steps
are a parameter).  Each task adds up its own words, so what is shuffled is at most a row for each
piece, language and task, and what reaches the driver is the model: pieces times languages.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import category

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercalith.llm.common import tokenizer_file
from mercalith.llm.perfect_hash import mix
from mercalith.llm.word_hashes import slices

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
SHORT = 31  # a letter's smallest probability to this power is still a number
STEPWISE = 256
STRETCH = 1024
MAX_LANGUAGES = 2000
ITERATIONS = 1
ADDED = 0.1  # added to every expected count
STRANGE = 1e-9  # probability of a letter that is no piece
GROUP_BYTES = 4_000_000
CACHE_WORDS = 400_000
UNKNOWN = "und"


@lru_cache(maxsize=2)
def pieces(name: str = VOCABULARY) -> dict[str, int]:
    """The vocabulary's pieces of letters and marks, lower case, that can stand in a word, numbered from 1."""
    found: dict[str, int] = {}
    with open(tokenizer_file(name), "rb") as f:
        for line in f:
            try:
                text = base64.b64decode(line.split()[0]).decode()
            except UnicodeDecodeError:
                continue
            body = text[1:] if text.startswith(" ") else text
            if body and body == body.lower() and all(category(c)[0] in "LM" for c in body):
                found.setdefault(text, len(found) + 1)
    return found


class PieceTable:
    """Finds pieces among all substrings of many words at once, by a rolling hash of characters."""

    def __init__(self, numbers: dict[str, int]):
        slots = 1 << max(4, (len(numbers) * 16).bit_length())
        self.mask = slots - 1
        self.keys = np.zeros(slots, dtype=np.uint64)
        self.values = np.full(slots, -1, dtype=np.int64)
        self.probes = 1
        words = list(numbers)
        keys = np.zeros(len(words), dtype=np.uint64)
        for n, rows in _by_length(words):
            keys[rows] = self.hashes(_characters([words[r] for r in rows]))[:, n]
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces have one hash")
        places = (mix(keys, 1) & np.uint64(self.mask)).tolist()
        for key, at, word in zip(keys, places, words):
            probe = 1
            while self.values[at] >= 0:
                at, probe = (at + 1) & self.mask, probe + 1
            self.keys[at], self.values[at] = key, numbers[word]
            self.probes = max(self.probes, probe)

    @staticmethod
    def hashes(characters: np.ndarray) -> np.ndarray:
        """h[:, j]: hash of each word's first j characters."""
        code = mix(characters.astype(np.uint64), 2)
        out = np.zeros((len(code), code.shape[1] + 1), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for j in range(code.shape[1]):
                out[:, j + 1] = out[:, j] * _STEP + code[:, j]
        return out

    def find(self, h: np.ndarray, i: int, j: int, power: np.uint64) -> np.ndarray:
        """The piece that each word's characters i to j are, -1 if none."""
        with np.errstate(over="ignore"):
            return self.numbers(h[:, j] - h[:, i] * power)

    def numbers(self, key: np.ndarray) -> np.ndarray:
        """The piece of each hash, -1 if there is none."""
        at = (mix(key, 1) & np.uint64(self.mask)).astype(np.int64)
        out = np.where(self.keys[at] == key, self.values[at], -1)
        open_ = np.flatnonzero((out < 0) & (self.values[at] >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self.mask
            here = at[open_]
            hit = (self.keys[here] == key[open_]) & (self.values[here] >= 0)
            out[open_[hit]] = self.values[here[hit]]
            open_ = open_[~hit & (self.values[here] >= 0)]
        return out


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _characters(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row for each."""
    return np.array(words).view(np.uint32).reshape(len(words), -1)


@lru_cache(maxsize=2)
def piece_table(name: str = VOCABULARY) -> PieceTable:
    return PieceTable(pieces(name))


class Model:
    """Piece probabilities: row 0 is for letters that are no piece, one column for each language."""

    def __init__(self, probabilities: np.ndarray, name: str = VOCABULARY):
        self.pieces = pieces(name)
        self.table = piece_table(name)
        self.longest = max(map(len, self.pieces), default=1)
        self.p = probabilities

    @classmethod
    def equal(cls, languages: int, name: str = VOCABULARY) -> Model:
        n = len(pieces(name))
        p = np.full((n + 1, languages), 1.0 / max(n, 1))
        p[0] = STRANGE
        return cls(p, name)

    @classmethod
    def learned(cls, counts: np.ndarray, name: str = VOCABULARY) -> Model:
        p = counts + ADDED
        p[1:] /= p[1:].sum(axis=0)
        p[0] = STRANGE
        return cls(p, name)

    def _lattice(self, words: list[str], n: int) -> dict[tuple[int, int], np.ndarray]:
        """The piece from i to j of every word of `n` characters, -1 if there is none."""
        out: dict[tuple[int, int], np.ndarray] = {}
        h = self.table.hashes(_characters(words))
        powers = np.cumprod(np.full(n + 1, _STEP, dtype=np.uint64), dtype=np.uint64)
        for i in range(n):
            for j in range(i + 1, min(n, i + self.longest) + 1):
                ids = self.table.find(h, i, j, powers[j - i - 1])
                if j == i + 1:
                    ids = np.maximum(ids, 0)  # a letter that is no piece
                if j == i + 1 or (ids >= 0).any():
                    out[i, j] = ids
        return out

    def _forward(self, lattice: dict[tuple[int, int], np.ndarray], count: int, n: int) -> np.ndarray:
        """a[i]: the probability of each word's first i characters."""
        a = np.zeros((n + 1, count, self.p.shape[1]))
        a[0] = 1.0
        for (i, j), ids in lattice.items():
            on = ids >= 0
            if on.all():
                a[j] += a[i] * self.p[ids]
            else:
                a[j][on] += a[i][on] * self.p[ids[on]]
        return a

    def _forward_logs(self, lattice: dict[tuple[int, int], np.ndarray], count: int, n: int) -> np.ndarray:
        """`_forward` in logarithms."""
        logs = np.log(self.p)
        a = np.full((n + 1, count, self.p.shape[1]), -np.inf)
        a[0] = 0.0
        for (i, j), ids in lattice.items():
            on = ids >= 0
            a[j][on] = np.logaddexp(a[j][on], a[i][on] + logs[ids[on]])
        return a

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """log P(word) for each word and language."""
        out = np.zeros((len(words), self.p.shape[1]))
        for n, rows in _by_length(words):
            some = [words[r] for r in rows]
            if n > STEPWISE:
                out[rows] = [_LongWord(self, w).log_probability() for w in some]
            elif n > SHORT:
                out[rows] = self._forward_logs(self._lattice(some, n), len(rows), n)[n]
            else:
                out[rows] = np.log(self._forward(self._lattice(some, n), len(rows), n)[n])
        return out

    def expected(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        """Expected uses of every piece, from words and how often each language has them."""
        out = np.zeros_like(self.p)
        for n, rows in _by_length(words):
            if n > STEPWISE:
                for r in rows:
                    _LongWord(self, words[r]).add_expected(out, weights[r])
                continue
            lattice = self._lattice([words[r] for r in rows], n)
            if n > SHORT:
                self._add_expected_logs(out, lattice, weights[rows], n)
                continue
            a = self._forward(lattice, len(rows), n)
            b = np.zeros_like(a)
            b[n] = 1.0
            share = weights[rows] / a[n]
            for (i, j), ids in reversed(lattice.items()):
                on = np.flatnonzero(ids >= 0)
                p = self.p[ids[on]] * b[j][on]
                b[i][on] += p
                used = a[i][on] * p * share[on]
                for k in range(out.shape[1]):
                    out[:, k] += np.bincount(ids[on], used[:, k], minlength=len(out))
        return out

    def _add_expected_logs(self, out: np.ndarray, lattice: dict[tuple[int, int], np.ndarray], weights: np.ndarray, n: int) -> None:
        logs = np.log(self.p)
        a = self._forward_logs(lattice, len(weights), n)
        b = np.full_like(a, -np.inf)
        b[n] = 0.0
        for (i, j), ids in reversed(lattice.items()):
            on = np.flatnonzero(ids >= 0)
            p = logs[ids[on]] + b[j][on]
            b[i][on] = np.logaddexp(b[i][on], p)
            used = np.exp(a[i][on] + p - a[n][on]) * weights[on]
            for k in range(out.shape[1]):
                out[:, k] += np.bincount(ids[on], used[:, k], minlength=len(out))


class _LongWord:
    """The sums over a word of any length, stretch by stretch and in logarithms.

    a[j] of a stretch needs a of the `longest` characters before it only.  The backward pass goes through the
    stretches from the last to the first and takes each one's forward sums again from where it began.
    """

    def __init__(self, model: Model, word: str):
        self.model, self.n = model, len(word)
        self.codes = np.frombuffer(word.encode("utf-32-le"), np.uint32)
        self.logs = np.log(model.p)

    def _pieces(self, begin: int, end: int) -> np.ndarray:
        """ids[j - begin, l - 1]: the piece of l characters that ends before j, -1 if there is none."""
        longest, table = self.model.longest, self.model.table
        low = max(0, begin - longest)
        h = table.hashes(self.codes[None, low:end])[0]
        ids = np.full((end - begin + 1, longest), -1, dtype=np.int64)
        power = np.uint64(1)
        for size in range(1, longest + 1):
            with np.errstate(over="ignore"):
                power = power * _STEP
                first = max(begin, low + size)
                if first > end:
                    break
                j = np.arange(first, end + 1)
                ids[j - begin, size - 1] = table.numbers(h[j - low] - h[j - low - size] * power)
        if begin or end:
            j = np.arange(max(begin, 1), end + 1)
            ids[j - begin, 0] = np.maximum(ids[j - begin, 0], 0)  # a letter that is no piece
        return ids

    def _stretch(self, begin: int, end: int, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a[begin - longest .. end], pieces) from the sums of the `longest` characters up to `begin`."""
        longest = self.model.longest
        ids = self._pieces(begin, end)
        a = np.concatenate([before, np.full((end - begin, before.shape[1]), -np.inf)])
        for j in range(1, end - begin + 1):
            on = np.flatnonzero(ids[j] >= 0)
            terms = a[longest + j - 1 - on] + self.logs[ids[j, on]]
            most = terms.max(axis=0)
            a[longest + j] = most + np.log(np.exp(terms - most).sum(axis=0))
        return a, ids

    def _walk(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(begin, end, sums before) of every stretch, and at last the sums at the word's end as (n, n, sums)."""
        before = np.full((self.model.longest + 1, self.logs.shape[1]), -np.inf)
        before[-1] = 0.0
        for begin in range(0, self.n, STRETCH):
            end = min(self.n, begin + STRETCH)
            yield begin, end, before
            before = self._stretch(begin, end, before)[0][-self.model.longest - 1 :]
        yield self.n, self.n, before

    def log_probability(self) -> np.ndarray:
        *_, (_, _, last) = self._walk()
        return last[-1]

    def add_expected(self, out: np.ndarray, weights: np.ndarray) -> None:
        longest = self.model.longest
        stretches = list(self._walk())
        whole = stretches[-1][2][-1]
        ahead = np.full((longest, self.logs.shape[1]), -np.inf)  # b of what lies before a stretch's end, so far
        b_end = np.zeros(self.logs.shape[1])
        for begin, end, before in reversed(stretches[:-1]):
            a, ids = self._stretch(begin, end, before)
            b = np.full_like(a, -np.inf)
            b[-1] = b_end
            # pieces of later stretches that begin in this one or before it
            b[-longest - 1 : -1] = np.logaddexp(b[-longest - 1 : -1], ahead)
            for j in range(end - begin, 0, -1):
                on = np.flatnonzero(ids[j] >= 0)
                start = longest + j - 1 - on
                p = self.logs[ids[j, on]] + b[longest + j]
                b[start] = np.logaddexp(b[start], p)
                used = np.exp(a[start] + p - whole) * weights
                np.add.at(out, ids[j, on], used)
            ahead, b_end = b[:longest], b[longest]


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    length = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(length):
        rows = np.flatnonzero(length == n)
        step = max(1, 20_000 * SHORT // max(SHORT, int(n)))
        for at in range(0, len(rows), step):
            yield int(n), rows[at : at + step]


def _coded(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, number of the word at each place, which text each place is in)."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts), r"[^\p{L}\p{M}]+")
    flat = lists.flatten()
    owner = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
    coded = pc.dictionary_encode(flat)
    index = np.asarray(coded.indices).astype(np.int64)
    # a mark without any letter is no word
    words = np.asarray(pc.match_substring_regex(coded.dictionary, r"\p{L}"))
    if not words.all():
        keep = words[index]
        owner, index = owner[keep], (np.cumsum(words) - 1)[index[keep]]
    listed = coded.dictionary.filter(pa.array(words)).to_pylist()
    return [" " + w for w in listed], index, owner


def _key(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def learn(docs: DataFrame, iterations: int = ITERATIONS, vocabulary: str = VOCABULARY) -> tuple[list[str], Model]:
    """Languages (by code point) and their model, from all rows of (text, lang) with a lang."""
    known = docs.filter("lang IS NOT NULL").select("text", "lang")
    languages = sorted(r.lang for r in known.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"lang has more than {MAX_LANGUAGES} values; a model has a column for each")
    number = {x: i for i, x in enumerate(languages)}
    model = Model.equal(len(languages), vocabulary)
    sent = docs.sparkSession.sparkContext

    for step in range(iterations if languages else 0):
        shared = sent.broadcast(model.p if step else None)  # pieces times languages

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            now = Model(shared.value, vocabulary) if shared.value is not None else Model.equal(len(languages), vocabulary)
            total = np.zeros_like(now.p)
            for batch in batches:
                lang = np.array([number[x] for x in batch.column("lang").to_pylist()], dtype=np.int64)
                for at, part in slices(batch.column("text"), GROUP_BYTES):
                    words, index, owner = _coded(part)
                    code = np.bincount(index * len(languages) + lang[at + owner], minlength=len(words) * len(languages))
                    total += now.expected(words, code.reshape(-1, len(languages)).astype(float))
            piece, language = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(piece, pa.int64()), pa.array(language, pa.int64()), pa.array(total[piece, language])],
                names=["piece", "language", "n"],
            )

        sums = known.mapInArrow(count, "piece bigint, language bigint, n double").groupBy("piece", "language")
        counts = np.zeros_like(model.p)
        # added as decimals, so that the model does not depend on the order of tasks
        for row in sums.agg(F.sum(F.col("n").cast("decimal(30,6)")).cast("double").alias("n")).collect():
            counts[row.piece, row.language] = row.n
        model = Model.learned(counts, vocabulary)
        shared.unpersist()
    return languages, model


def identify(docs: DataFrame, iterations: int = ITERATIONS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of (doc_id, text, lang).

    Learned from rows with a lang whose crc32(doc_id as text) mod 4 is not 2 (held_out is whether it
    is; a NULL doc_id counts as the empty text).  A prediction uses the text only.  The score is the
    probability of the predicted language given the text, all languages equally likely before; of
    equal ones the first by code point is taken.  NULL texts, texts without a letter and every text
    if there is nothing to learn from are `und` with score 0.  Repeated rows and other columns
    change nothing.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"), (_key() % 4 == 2).alias("held_out"),
    )
    languages, model = learn(rows.filter("NOT held_out"), iterations, vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(model.p.astype(np.float64))  # pieces times languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Model(shared.value, vocabulary)
        known: dict[str, int] = {}
        table = np.empty((CACHE_WORDS, len(languages)))
        for batch in batches:
            names: list[str] = []
            scores: list[float] = []
            for _, part in slices(batch.column("text"), GROUP_BYTES):
                words, index, owner = _coded(part)
                if not languages:
                    names += [UNKNOWN] * len(part)
                    scores += [0.0] * len(part)
                    continue
                new = [w for w in words if w not in known]
                if len(known) + len(new) > CACHE_WORDS:
                    known.clear()
                    new = words[:CACHE_WORDS]
                if new:
                    at = np.arange(len(known), len(known) + len(new))
                    table[at] = now.log_probabilities(new)
                    known.update(zip(new, at.tolist()))
                place = np.array([known.get(w, -1) for w in words], dtype=np.int64)
                logs = table[place]
                more = np.flatnonzero(place < 0)
                if len(more):
                    logs[more] = now.log_probabilities([words[i] for i in more])
                total = np.stack(
                    [np.bincount(owner, logs[index, k], minlength=len(part)) for k in range(len(languages))], axis=1
                )
                letters = np.bincount(owner, minlength=len(part)) > 0
                best = total.argmax(axis=1)
                odds = np.exp(total - total.max(axis=1, keepdims=True))
                sure = odds.max(axis=1) / odds.sum(axis=1)
                names += [languages[b] if some else UNKNOWN for b, some in zip(best, letters)]
                scores += np.where(letters, sure, 0.0).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return rows.select("doc_id", "held_out", "text").mapInArrow(
        run, "doc_id bigint, held_out boolean, lang_pred string, score double"
    )
