"""Quality rules in Spark SQL functions only: base counts and a hashed n-gram likelihood ratio.

Texts are cut into words and the signs that follow them, unigrams and bigrams of these hashed into
a fixed number of bins.  Two multinomials over the bins are fitted: one to trusted documents, one
to the whole corpus.  A document's score is the mean over its n-grams of log(trusted / corpus); it
is kept if the score reaches a threshold that lies as far below the low end of the trusted
documents' scores as their median lies above it.  The same document gets the same verdict in every
run.

Trusted are all documents labelled good, the corpus all documents; nothing is sampled.  One count for
each bin, the sizes of the ranges of scores and the threshold go through the driver.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercalith.llm.common import SPACES, stored, words

BINS = 1 << 14
LOW_END = 0.002
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8


def let(value: Column, body) -> Column:
    """body(value) with `value` computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _hashes(text: Column) -> Column:
    """Hashes of the words of a text and of the signs that follow them."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    # what follows is looked at first, as it rules out nearly all places
    cut = r"[\x20\x09-\x0D]+|(?=[^\p{L}\p{N}\x20\x09-\x0D])(?<=[\p{L}\p{N}])"
    return F.transform(F.split(trimmed, cut), lambda x: F.xxhash64(x))


def _bigrams(h: Column) -> Column:
    """Hashes of the neighbours in an array of hashes."""
    return F.transform(F.slice(h, 2, F.size(h)), lambda x, i: F.xxhash64(F.get(h, i), x))


def _bin(x: Column, bins: int) -> Column:
    """The bin of a hash; `bins` is a power of two."""
    return x.bitwiseAND(F.lit(bins - 1).cast("long")).cast("int")


def repeat_words(found: Column, window: int = WINDOW) -> Column:
    """How many of the words lie in a window of words that occurs at least twice in the text."""

    def covered(h: Column) -> Column:
        """Words covered by the windows whose hash is not alone in `h` (window i starts at i)."""
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        twice = let(
            ordered,
            lambda o: F.filter(
                o,
                lambda x, i: (x["h"] == F.get(o, i - 1)["h"]).eqNullSafe(F.lit(True))
                | (x["h"] == F.get(o, i + 1)["h"]).eqNullSafe(F.lit(True)),
            ),
        )
        begins = F.array_sort(F.transform(twice, lambda x: x["at"]))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        total = F.aggregate(
            begins,
            start,
            lambda a, x: F.struct(
                (x + window).alias("end"),
                (a["n"] + window - F.greatest(F.lit(0), a["end"] - x)).alias("n"),
            ),
        )
        return total["n"]

    def of(w: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(1), F.size(w) - (window - 1)),
            lambda i: F.xxhash64(F.slice(w, i, window)),
        )
        return let(
            windows,
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)),
        )

    return F.when(F.size(found) <= window, 0).otherwise(
        let(F.transform(found, lambda x: F.xxhash64(x)), of)
    )


def base_counts(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = docs.select(
        "doc_id",
        "text",
        *keep,
        let(
            words(F.col("text")),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                repeat_words(w).cast("long").alias("n_repeat_words"),
            ),
        ).alias("w"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    return counted.select(
        "doc_id", "text", *keep, "w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words"
    ).withColumn("base_failed", failed)


def bin_counts(docs: DataFrame, bins: int = BINS) -> tuple[list[int], list[int]]:
    """How often each bin occurs in the `trusted` texts and in all, with one added to each count."""
    t, n = [1] * bins, [1] * bins
    grams = let(_hashes(F.col("text")), lambda h: F.concat(h, _bigrams(h)))
    counted = docs.select("trusted", F.explode(grams).alias("gram")).groupBy(_bin(F.col("gram"), bins).alias("bin"))
    for row in counted.agg(F.count_if("trusted").alias("t"), F.count("*").alias("n")).collect():  # one row for each bin
        t[row.bin] += row.t
        n[row.bin] += row.n
    return t, n


def log_ratios(docs: DataFrame, bins: int = BINS) -> list[float]:
    """log(trusted / corpus) for each bin, from all rows; one pass counts both."""
    t, n = bin_counts(docs, bins)
    sum_t, sum_n = sum(t), sum(n)
    return [math.log(a / sum_t) - math.log(b / sum_n) for a, b in zip(t, n)]


def score(text: Column, ratios: list[float]) -> Column:
    """The mean log ratio over a text's n-grams; NULL and blank texts score as one empty word."""
    weights = F.from_json(F.lit(json.dumps(ratios)), "array<double>")

    def total(h: Column, begin: Column) -> Column:
        return F.aggregate(h, begin, lambda a, x: a + F.get(weights, _bin(x, len(ratios))))

    return let(_hashes(text), lambda h: total(_bigrams(h), total(h, F.lit(0.0))) / (2 * F.size(h) - 1))


def exact_percentiles(values: DataFrame, shares: list[float]) -> list[float] | None:
    """Percentiles of the only column, interpolated as `percentile` does; None without a value.

    The distinct values are written once in ranges; the sizes of the ranges tell which of them hold the
    wanted places, and only those are ranked, so no task or driver holds more than a range.
    """
    found = values.toDF("v").groupBy("v").agg(F.count("*").alias("n"))
    # NULL leaves behind the written ranges: a filter before them would compute every value twice
    ranged = stored(found.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "scores").where("v IS NOT NULL")
    # a row for each range
    sizes = sorted(tuple(r) for r in ranged.groupBy("part").agg(F.sum("n")).collect())
    total = sum(n for _, n in sizes)
    if not total:
        return None
    places = [share * (total - 1) for share in shares]
    wanted = sorted({f(at) for at in places for f in (math.floor, math.ceil)})
    before, begin = {}, 0
    for part, n in sizes:
        if any(begin <= at < begin + n for at in wanted):
            before[part] = begin
        begin += n
    upto = Window.partitionBy("part").orderBy("v")
    # a row for each range that is read
    begins = values.sparkSession.createDataFrame(list(before.items()), "part int, begin bigint")
    ranked = ranged.where(F.col("part").isin(list(before))).withColumn("end", F.sum("n").over(upto)).join(F.broadcast(begins), "part")
    holds = " OR ".join(f"(begin + end - n <= {at} AND {at} < begin + end)" for at in wanted)
    rows = ranked.where(holds).selectExpr("v", "begin + end - n AS first", "begin + end AS behind").collect()  # two for each share
    value = {at: r.v for at in wanted for r in rows if r.first <= at < r.behind}

    def between(at: float) -> float:
        low, high = math.floor(at), math.ceil(at)
        return value[low] if value[low] == value[high] else (high - at) * value[low] + (at - low) * value[high]

    return [between(at) for at in places]


def with_trust(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, trusted) of all rows of `docs`: whether their id is labelled good.

    The ids are packed 64 to a row and written first, so Spark knows their size and, while they are small,
    brings them to the texts instead of shuffling those.
    """
    word, bit = "shiftright(doc_id, 6) AS _word", "CAST(doc_id & 63 AS INT)"
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").selectExpr(word, f"shiftleft(1L, {bit}) AS bit")
    packed = stored(good.groupBy("_word").agg(F.expr("bit_or(bit) AS _bits")), "trusted-ids")
    return docs.selectExpr("*", word).join(packed, "_word", "left").selectExpr("text", f"coalesce(getbit(_bits, {bit}) = 1, false) AS trusted")


def quality(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, *keep, base counts, base_failed, score, kept) of every row of `docs`.

    NULL text counts as empty and fails the base rules; NULL ids are judged like any other row and
    are never trusted; repeated rows stay.  Without labelled rows every ratio is flat and the base
    rules alone decide.  An empty table gives an empty result.  Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    known_rows = with_trust(rows, known)
    ratios = log_ratios(known_rows)
    # as far below the low end of the trusted scores as their middle is above it
    found = exact_percentiles(known_rows.where("trusted").select(score(F.col("text"), ratios)), [LOW_END, 0.5])
    threshold = None if found is None else 2 * found[0] - found[1]
    judged = base_counts(rows, keep).withColumn("score", score(F.col("text"), ratios))
    good = F.lit(True) if threshold is None else F.col("score") >= F.lit(threshold)
    return judged.withColumn("kept", ~F.col("base_failed") & good)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are kept, with all their columns."""
    whole = docs.select("doc_id", "text", F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"))
    return quality(whole, labels, ("_row",)).filter("kept").select("_row.*")
