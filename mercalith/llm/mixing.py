"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts.

Sizes are summed by source; the targets are the whole corpus's size shared by weight, no source
above three times its own size, the rest shared again by weight.  Within a source documents stand
in the order of a hash of their id and text.  A source is read through whole times while its target allows,
then once more up to the cut: a document belongs to that last reading if at least half of it lies
before the cut.  The sum before each document is found without putting a source into one task: the
range of the hash is divided into slices, as many as the source's rows ask for; sizes are summed by
slice, the slices' sums are added up within each source, and only the documents of one slice are
sorted together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mercalith.llm.common import SPACES, stored

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
ROWS_PER_SLICE = 2_000
SEED = "mix"


def size_of(text):
    """The number of words of a text; 0 for NULL."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", 0).otherwise(F.regexp_count(trimmed, F.lit(r"[\x20\x09-\x0D]+")) + 1).cast("bigint")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, n_docs, target) for (source, size); one row for each source.

    Sources by code point, NULL last, take the weights in turn.  Sharing the excess of full sources
    again until none is above its limit gives every source min(limit, level * weight) for one
    level; sources fill up in the order of limit / weight, so the level follows from sums over
    the sources in that order.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weighted = totals.select("*", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double").alias("weight"))
    limits = weighted.withColumn("limit", most * F.col("source_size"))
    filling = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    everyone = Window.partitionBy()
    full = F.coalesce(F.sum("limit").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    # the level if exactly the sources before this one were full; it is right for the first source
    # that is not full at it, and falls from there on
    level = (F.sum("source_size").over(everyone) - full) / left
    tried = limits.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))
    final = tried.withColumn("final", F.max(fits).over(everyone))
    target = F.when(F.col("final").isNull(), F.col("limit").cast("double")).otherwise(
        F.least(F.col("limit").cast("double"), F.col("final") * F.col("weight"))
    )
    return final.select("source", "source_size", "n_docs", target.alias("target"))


def _sized(docs: DataFrame, kept: list[str]) -> DataFrame:
    """`kept` columns of every row with its source, size and place in the hash order.

    The order is that of a hash of id and text, so that rows without an id or with one id are spread too.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(text))
    return docs.select(*kept, F.col("source").cast("string").alias("_source"), size_of(text).alias("_size"), F.md5(own).alias("_key"))


def _taken(sized: DataFrame, narrow: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """All columns of `sized` with source_size, target and times (0 to `most`).

    `narrow` is the same rows without their texts, as a written table: it is read for the sources' sums and
    for the slices'.
    """
    unit = F.conv(F.substring("_key", 1, 12), 16, 10).cast("double") / float(16**12)
    plain = narrow.select(F.col("_source").alias("source"), F.col("_size").alias("size"))
    # a row for each source, read by all that follows
    targets = stored(source_targets(plain, weights, most), "source-targets").withColumnRenamed("source", "_of")
    slices = (F.floor(F.col("n_docs") / ROWS_PER_SLICE) + 1).cast("bigint")

    # one row for each source on the right; the hot source's rows stay where they were read if
    # that side is small, and are split by adaptive execution if not
    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(targets, F.col("_source").eqNullSafe(F.col("_of"))).select(
            *rows.columns, "source_size", "target", F.floor(unit * slices).alias("_slice")
        )

    by_slice = placed(narrow).groupBy("_source", "_slice").agg(F.sum("_size").alias("n"))
    earlier = Window.partitionBy("_source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_slice.select(
        F.col("_source").alias("_s"), F.col("_slice").alias("_at"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"),
    )
    inside = Window.partitionBy("_source", "_slice").orderBy("_key")
    before = F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    summed = placed(sized).withColumn("_inner", F.coalesce(before, F.lit(0)))
    same = F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_slice") == F.col("_at"))
    whole = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0))
    rest = F.col("target") - whole * F.col("source_size")
    last = (F.col("_before") + F.col("_inner") + F.col("_size") / 2 <= rest).cast("bigint")
    return summed.join(offsets, same).withColumn("_times", F.least(F.lit(most), whole + last))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row of `docs`.

    NULL text has size 0 and is never taken for more than 0 words; NULL sources form one source;
    NULL ids are ordered like any other id; equal rows stand together and count one by one.  An
    empty table gives an empty result.  Other columns are ignored.  Runs agree: the order depends
    on doc_id and text only.  The texts are read once.
    """
    narrow = stored(_sized(docs, ["doc_id"]), "sized")
    return _taken(narrow, narrow, weights, most).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("_source").alias("source"),
        F.col("_size").alias("size"), "source_size", "target",
        (F.col("_times") * F.col("_size")).cast("bigint").alias("taken"),
    )


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """The rows of `docs` as often as the mix takes them, with all their columns; texts are whole.

    Rows that a cut leaves out go.  See `mix` for the cases; texts without a word are taken as
    often as their place in the order says.
    """
    names = [c for c in docs.columns if c not in ("doc_id", "text", "source")]
    inner = {c: f"_c{i}" for i, c in enumerate(names)}
    plain = docs.select("doc_id", "text", "source", *[F.col(f"`{c}`").alias(n) for c, n in inner.items()])
    taken = _taken(_sized(plain, plain.columns), stored(_sized(plain, []), "sized"), weights, most)
    back = [F.col(inner.get(c, c)).alias(c) for c in docs.columns]
    return taken.filter("_times > 0").withColumn(
        "_copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))
    ).select(*back)
