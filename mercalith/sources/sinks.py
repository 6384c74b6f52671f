"""Datasets and pages for readers outside Spark."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercalith.functions.normalize import quoted
from mercalith.plans.checker import RESULT_COLUMNS, Violations, blank_null
from mercalith.spec import ROW_ID, TARGET_NAMES

PAGE_SIZE = 50


def export_target(stamped: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The 31 target columns and `Violations` as one dataset."""
    writer = stamped.select(*TARGET_NAMES, "Violations").write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def export_report(
    violations: Violations,
    path: str,
    mapping: DataFrame | None = None,
    quality: DataFrame | None = None,
) -> dict[str, str]:
    """Publish the report sections below `path`; returns section name -> location.

    A report is written whole into a folder of its own and then named in the manifest, so a reader of
    `latest_report` never sees half of one, and a run that fails leaves the former one as it is.

    The violating rows of the built-in rules are one dataset partitioned by rule, so a reader of
    one rule opens that rule's files only.  The rows of a user rule are a dataset of their own,
    section `violations <rule id>`, with the columns its SQL returned.
    """
    violations = violations.store()
    spark = violations.spark
    version = uuid.uuid4().hex
    sections = {
        "violation_summary": violations.summary(),
        "target": violations.stamped(),
    }
    if mapping is not None:
        sections["schema_mapping"] = mapping
    if quality is not None:
        sections["data_quality"] = quality
    places = {}
    for name, frame in sections.items():
        places[name] = f"{path}/{version}/{name}"
        public(frame).write.parquet(places[name])
    places["violations"] = f"{path}/{version}/violations"
    built_in = violations.long.where(~F.col("rule_id").isin(*violations.own))
    full_rows = public(violations.target).join(
        built_in.select(ROW_ID, "rule_id", "violated_column"), ROW_ID
    )
    full_rows.write.partitionBy("rule_id").parquet(places["violations"])
    for i, (rule_id, rows) in enumerate(violations.own.items()):
        places[f"violations {rule_id}"] = f"{path}/{version}/user_rule_{i}"
        rows.write.parquet(places[f"violations {rule_id}"])
    # the last step: one small file, there or not there
    entry = spark.createDataFrame([(version, list(places.items()))], "version string, sections array<struct<name: string, place: string>>")
    entry.withColumn("published", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{path}/{MANIFEST}")
    return places


MANIFEST = "manifest"


def latest_report(spark: SparkSession, path: str) -> dict[str, str]:
    """Section name -> location of the newest report published below `path`; empty if there is none."""
    try:
        published = spark.read.parquet(f"{path}/{MANIFEST}")
    except AnalysisException:  # nothing has been published yet
        return {}
    newest = published.orderBy(F.desc("published"), F.desc("version")).limit(1).collect()
    return {s["name"]: s["place"] for r in newest for s in r["sections"]}


def public(df: DataFrame) -> DataFrame:
    """Without helper columns, whose names start with an underscore."""
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def page(
    df: DataFrame, number: int = 1, size: int = PAGE_SIZE, order_by: str | None = ROW_ID, after=None
) -> DataFrame:
    """Page `number` (from 1) in `order_by` order, as text with NULL shown as ''.

    Rows of one key are ordered by all their columns as text.  With `after`, the key of the last row of
    the page before, the page starts behind that key: only `size` rows are ever ranked, but rows that share
    the key are passed over, so `after` may also be that whole row (as a dict or Row of this function).
    Without `order_by` the order is that of all columns as text.  `pages.write_pages` is the way to
    open any page of a large table.
    """
    shown = df.select(*[F.col(c) if c == order_by else blank_null(c) for c in df.columns])
    ties = [quoted(c) for c in df.columns if c != order_by]
    order = [*([quoted(order_by)] if order_by is not None else []), *ties]
    if after is None:
        return shown.orderBy(*order).offset((number - 1) * size).limit(size)
    if hasattr(after, "asDict"):
        after = after.asDict()
    if not isinstance(after, dict):
        return shown.where(F.col(quoted(order_by)) > after).orderBy(*order).limit(size)
    values = [*([order_by] if order_by else []), *[c for c in df.columns if c != order_by]]
    row = F.struct(*[F.col(quoted(c)) for c in values])
    last = F.struct(*[F.lit(after[c]).cast(shown.schema[c].dataType).alias(c) for c in values])
    return shown.where(row > last).orderBy(*order).limit(size)


def violation_page(violations: Violations, rule_id: str, number: int = 1, size: int = PAGE_SIZE):
    """A page of the full rows of one rule; a user rule's are those its SQL returned.

    The rows of a built-in rule are looked up by what the run has found (`violations.store()` keeps that).
    """
    if rule_id in violations.own:
        rows = violations.own[rule_id]
        return page(rows, number, size, ROW_ID if ROW_ID in rows.columns else None)
    target = violations.target.drop(*RESULT_COLUMNS)
    found = violations.long.where(F.col("rule_id") == rule_id).where(F.col(ROW_ID).isNotNull())
    # the page is cut from the row numbers; full rows are fetched for one page only
    ids = found.select(ROW_ID, F.col("rule_id").alias("violation_id"), "violated_column").orderBy(ROW_ID)
    some = ids.offset((number - 1) * size).limit(size)
    hits = target.join(F.broadcast(some), ROW_ID)
    hits = hits if rule_id == "V1" else hits.drop("violated_column")
    return page(public(hits), 1, size)
