"""Stored templates applied to many feeds at once.

Feeds that have the same tables and columns have the same fingerprint and lie in the same tables, told apart
by a column `feed`.  A template is stored under a fingerprint and brings the mapping, the join plan, the
rules to run or a SQL text.  Each template is compiled once, whatever the number of its feeds; all joins
and groups of the plan are within a feed.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercalith.functions.normalize import cast_value, quoted, trimmed
from mercalith.operators.rules import GROUP_RULES, ROW_RULES, acquirer_name_hits, row_rule_hits, rows_in_flagged_groups
from mercalith.plans.master import chosen_columns, join_sources
from mercalith.session import stored
from mercalith.spec import ROW_ID, SPARK_TYPES, TARGET_COLUMNS, TARGET_NAMES

FEED = "feed"

TEMPLATE_SCHEMA = (
    "fingerprint string, name string, main string, key string, "
    "mapping array<struct<target: string, source_table: string, source_column: string, is_derived: boolean, derivation_logic: string>>, "
    "join_plan array<struct<left_table: string, right_table: string, join_type: string, left_key: string, right_key: string>>, "
    "rules array<string>, sql string"
)


@dataclass
class FeedTargets:
    """`target`: feed, template, row_id and the 31 columns.  `choice`: feed, template, rules (NULL: all).
    `unmatched`: feeds without a template."""

    target: DataFrame
    choice: DataFrame
    unmatched: DataFrame


def fingerprint_of(tables: dict[str, DataFrame]) -> str:
    """The fingerprint that `discovery.fingerprints` gives each feed in these tables."""
    lines = [f"{name}:{','.join(sorted(c for c in df.columns if c != FEED))}" for name, df in sorted(tables.items())]
    return hashlib.sha256("|".join(lines).encode()).hexdigest()


def _within_feed(plan: list) -> list[dict]:
    return [p.asDict() | {"left_key": f"{FEED},{p['left_key']}", "right_key": f"{FEED},{p['right_key']}"} for p in plan]


def _mapped(tables: dict[str, DataFrame], template) -> DataFrame:
    chosen = chosen_columns([m.asDict() for m in template["mapping"]])
    columns = [f"{cast_value(chosen.get(c.name, 'NULL'), SPARK_TYPES[c.type])} AS {c.name}" for c in TARGET_COLUMNS]
    main = template["main"]
    joined = join_sources(tables, main, _within_feed(template["join_plan"] or []))
    built = joined.selectExpr(f"{quoted(main)}.{FEED} AS {FEED}", f"CAST({quoted(main)}.{quoted(template['key'])} AS BIGINT) AS {ROW_ID}", *columns)
    # no two rows of a feed alike in the 31 columns
    return built.groupBy(FEED, *TARGET_NAMES).agg(F.min(ROW_ID).alias(ROW_ID)).select(FEED, ROW_ID, *TARGET_NAMES)


def _by_sql(tables: dict[str, DataFrame], template, sql: str) -> DataFrame:
    """A reviewer's SQL over the tables of all its feeds; it has to return `feed` and may leave target columns out."""
    spark = next(iter(tables.values())).sparkSession
    rows = spark.sql(sql, **tables)
    has = set(rows.columns)
    if FEED not in has or ROW_ID not in has:
        raise ValueError(f"the SQL of template {template['name']} must return {FEED} and {ROW_ID}")
    columns = [f"{cast_value(quoted(c.name) if c.name in has else 'NULL', SPARK_TYPES[c.type])} AS {c.name}" for c in TARGET_COLUMNS]
    return rows.selectExpr(FEED, f"CAST({ROW_ID} AS BIGINT) AS {ROW_ID}", *columns)


def apply_templates(table_sets: list[dict[str, DataFrame]], templates: DataFrame) -> FeedTargets:
    """Build the targets of all feeds whose fingerprint has a template.

    `table_sets` has one set of tables for each layout, every table with a column `feed`; `templates` is laid out
    as TEMPLATE_SCHEMA.  SQL names its tables in braces, as {merchants}.  A feed is known by the rows of any of its tables.
    """
    spark = templates.sparkSession
    prints = [fingerprint_of(s) for s in table_sets]
    # at most one row for each layout given
    known = {t["fingerprint"]: t for t in templates.where(F.col("fingerprint").isin(prints)).orderBy("name").collect()}
    targets, choices, unmatched = [], [], []
    for fingerprint, tables in zip(prints, table_sets):
        feeds = reduce(DataFrame.union, [df.select(FEED) for df in tables.values()]).distinct()
        template = known.get(fingerprint)
        if template is None:
            unmatched.append(feeds)
            continue
        built = _by_sql(tables, template, template["sql"]) if template["sql"] else _mapped(tables, template)
        targets.append(built.withColumn("template", F.lit(template["name"])))
        rules = F.lit(None).cast("array<string>") if template["rules"] is None else F.array(*map(F.lit, template["rules"])).cast("array<string>")
        choices.append(feeds.select(FEED, F.lit(template["name"]).alias("template"), rules.alias("rules")))
    own = ", ".join(f"{c.name} {SPARK_TYPES[c.type].simpleString()}" for c in TARGET_COLUMNS)
    kind = table_sets[0][next(iter(table_sets[0]))].schema[FEED].dataType.simpleString() if table_sets else "string"
    empty = lambda schema: spark.createDataFrame([], schema)
    union = lambda parts, schema: reduce(DataFrame.unionByName, parts, empty(schema))
    return FeedTargets(
        union(targets, f"{FEED} {kind}, {ROW_ID} bigint, {own}, template string"),
        union(choices, f"{FEED} {kind}, template string, rules array<string>"),
        union(unmatched, f"{FEED} {kind}").distinct(),
    )


# Of each group rule one key that tells feeds apart once the feed stands before it.
_KEY = {"V3": "CAID", "V8": "Street", "V10": "CAID", "V11": "CAID", "V13": "AggregatorID"}


def check_feeds(found: FeedTargets) -> DataFrame:
    """(feed, row_id, rule_id): the built-in rules each feed's template chose, every group within its feed."""
    target = stored(found.target, "feed-targets")
    keep = [FEED, ROW_ID]
    parts = [row_rule_hits(target, list(ROW_RULES), keep), acquirer_name_hits(target, keep).select(*keep, F.lit("V1").alias("rule_id"))]
    for rule_id in GROUP_RULES:
        key = quoted(_KEY[rule_id])
        # an empty key stays what it is
        filled = f"replace({key}, ' ', '')" if _KEY[rule_id] == "CAID" else trimmed(_KEY[rule_id])
        apart = F.expr(f"CASE WHEN {filled} <> '' THEN concat(CAST({FEED} AS STRING), '\\u0001', {key}) ELSE {key} END")
        hits = rows_in_flagged_groups(target.withColumn(_KEY[rule_id], apart), rule_id, keep)
        parts.append(hits.select(*keep, F.lit(rule_id).alias("rule_id")))
    hits = reduce(DataFrame.unionByName, parts)
    chosen = found.choice.select(FEED, "rules")
    return hits.join(chosen, FEED).where("rules IS NULL OR array_contains(rules, rule_id)").drop("rules")
