"""Run the effective rules over a target table and report on the result.

Everything is derived from one long frame with a row per (target row, rule):

    row_id, rule_id, violated_column, group_key array<string>, pair struct<caid, mid>

`group_key` is NULL for rules where every row is its own group; `pair` is NULL only if a user
rule did not return both identifier columns.
"""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercalith.functions.normalize import literal, quoted
from mercalith.functions.similarity import register_sql_functions
from mercalith.operators.groups import join_groups
from mercalith.operators.rules import (
    GROUP_RULES,
    NESTED,
    ROW_RULES,
    acquirer_name_hits,
    nested_flags,
    nested_hits,
    nested_states,
    row_rule_hits,
    rows_in_flagged_groups,
    rule_rows,
)
from mercalith.session import scratch_path, stored
from mercalith.spec import OFF_BY_DEFAULT, ROW_ID, RULES

TARGET_VIEW = "merchant_target"
CAID, MID = "CAID", "AcquirerMerchantID"
RESULT_COLUMNS = ("Violations", "violation_id", "violated_column")
SAMPLE_ROWS = 10
PARALLEL_JOBS = 8
MAX_OVERRIDES = 10_000


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    description: str
    columns: tuple[str, ...]
    sql: str | None = None


def effective_rules(overrides: DataFrame | Iterable[dict] | None = None) -> list[Rule]:
    """Built-in rules overlaid by a configuration table (id, name, description, columns, sql,
    enabled); a NULL field leaves the built-in value.  Ids unknown to the registry are user
    rules and need SQL."""
    if isinstance(overrides, DataFrame):
        rows = overrides.limit(MAX_OVERRIDES + 1).collect()
        if len(rows) > MAX_OVERRIDES:
            raise ValueError(f"more than {MAX_OVERRIDES} rule overrides")
        overrides = [row.asDict() for row in rows]
    edits = {o["id"]: {k: v for k, v in o.items() if v is not None} for o in overrides or ()}
    chosen = []
    for rule_id in [*RULES, *[i for i in edits if i not in RULES]]:
        edit, base = edits.get(rule_id, {}), RULES.get(rule_id)
        sql = edit.get("sql") or None
        if not edit.get("enabled", True) or (base is None and sql is None):
            continue
        chosen.append(
            Rule(
                rule_id,
                edit.get("name", base.name if base else rule_id),
                edit.get("description", base.description if base else ""),
                tuple(edit.get("columns", base.columns if base else ())),
                sql,
            )
        )
    return sorted(chosen, key=lambda r: (_number(r.id), r.id))


def _number(rule_id: str) -> int:
    return int(rule_id[1:]) if rule_id[1:].isdigit() else 999


def default_selection(rules: Iterable[Rule]) -> list[str]:
    return [r.id for r in rules if r.id not in OFF_BY_DEFAULT]


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [(i, r.id, r.name, r.description, ", ".join(r.columns)) for i, r in enumerate(rules)]
    return spark.createDataFrame(
        rows,
        "position int, rule_id string, rule_name string, description string, "
        "affected_columns string",
    )


def run_rule(target: DataFrame, rule: Rule, view: str = TARGET_VIEW) -> DataFrame:
    """The full rows a rule returns: by its SQL if it has any, else by the built-in plan."""
    if rule.sql is None:
        return rule_rows(target, rule.id)
    return run_rule_sql(target, rule.sql, view)


def run_rule_sql(target: DataFrame, sql: str, view: str = TARGET_VIEW) -> DataFrame:
    spark = target.sparkSession
    register_sql_functions(spark)
    target.drop(*RESULT_COLUMNS).createOrReplaceTempView(view)
    return spark.sql(sql)


@dataclass
class Violations:
    target: DataFrame
    rules: list[Rule]
    parts: list[DataFrame]
    available: int
    errors: dict[str, str] = field(default_factory=dict)
    # the written rows of each user rule, as its SQL returned them
    own: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def long(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)

    @property
    def spark(self) -> SparkSession:
        return self.target.sparkSession

    def counts(self) -> DataFrame:
        """rule_id, rows, groups for rules that fired.

        Rows collapse per group before anything is shuffled; NULL key parts count like values.
        """
        per_group = self.long.groupBy("rule_id", "group_key").agg(F.count(F.lit(1)).alias("n"))
        groups = F.when(F.col("group_key").isNull(), F.col("n")).otherwise(F.lit(1))
        return per_group.groupBy("rule_id").agg(
            F.sum("n").alias("rows"), F.sum(groups).alias("groups")
        )

    def summary(self) -> DataFrame:
        """One row per rule that fired or failed; a failed rule shows -1 rows and its error."""
        failed = self.spark.createDataFrame(
            list(self.errors.items()), "rule_id string, error string"
        )
        found = self.counts().withColumn("error", F.lit(None).cast("string"))
        broken = failed.select(
            "rule_id",
            F.lit(-1).cast("bigint").alias("rows"),
            F.lit(0).cast("bigint").alias("groups"),
            "error",
        )
        description = F.when(F.col("error").isNull(), F.col("description")).otherwise(
            F.concat(F.lit("Error running check: "), F.col("error"))
        )
        return (
            found.unionByName(broken)
            .join(F.broadcast(rules_frame(self.spark, self.rules)), "rule_id")
            .select(
                "rule_id",
                "rule_name",
                description.alias("description"),
                F.col("rows").alias("affected_rows"),
                "groups",
                "affected_columns",
                "position",
            )
        )

    def samples(self, n: int = SAMPLE_ROWS) -> DataFrame:
        """The first `n` target rows per rule, as text with NULL shown as ''.

        At most `n` rows per rule survive the ranking, so the picked list is safe to broadcast.
        A user rule that returns no row_id shows its own first rows, in the order of all their
        columns as text; target columns it does not return are ''.
        """
        first = Window.partitionBy("rule_id").orderBy(ROW_ID)
        picked = (
            self.long.where(F.col(ROW_ID).isNotNull())
            .select("rule_id", ROW_ID)
            .withColumn("rank", F.row_number().over(first))
            .where(F.col("rank") <= n)
        )
        columns = [c for c in self.target.columns if c != ROW_ID and c not in RESULT_COLUMNS]
        shown = self.target.join(F.broadcast(picked), ROW_ID).select(
            "rule_id", "rank", ROW_ID, *[blank_null(c) for c in columns]
        )
        apart = [
            _own_sample(rule_id, rows, columns, n)
            for rule_id, rows in self.own.items()
            if ROW_ID not in rows.columns
        ]
        return reduce(DataFrame.unionByName, [shown, *apart])

    def rows_affected(self) -> DataFrame:
        """Distinct identifier pairs over all rules, one row."""
        pairs = self.long.where(F.col("pair").isNotNull()).groupBy("pair").agg(F.lit(1))
        return pairs.agg(F.count(F.lit(1)).alias("total_rows_affected"))

    def stamped(self) -> DataFrame:
        """The target with `Violations`: how many rules returned the row's identifier pair.

        Rows sharing a pair share the count, and NULL identifiers match NULL identifiers.
        """
        numbers = {r.id: i for i, r in enumerate(self.rules)}
        words = [_rule_bits(numbers, w) for w in range(len(numbers) // 63 + 1)]
        per_pair = (
            self.long.where(F.col("pair").isNotNull())
            .groupBy(F.col("pair.caid").alias("_caid"), F.col("pair.mid").alias("_mid"))
            .agg(
                # one bit per rule, in words of 63
                *[F.bit_or(F.expr(bits)).alias(f"_w{i}") for i, bits in enumerate(words)],
            )
            .selectExpr("_caid", "_mid", " + ".join(f"bit_count(_w{i})" for i in range(len(words))) + " AS Violations")
            .withColumn("Violations", F.col("Violations").cast("bigint"))
        )
        rows = self.target.drop(*RESULT_COLUMNS).selectExpr(
            "*", f"CAST({CAID} AS STRING) AS _caid", f"CAST({MID} AS STRING) AS _mid"
        )
        joined = join_groups(
            rows, per_pair, ("_caid", "_mid"), "LEFT", ("Violations",), null_safe=True
        )
        return joined.withColumn("Violations", F.expr("coalesce(Violations, 0L)")).drop(
            "_caid", "_mid"
        )

    def clean_summary(self) -> DataFrame:
        return clean_summary(self.stamped())

    def totals(self) -> DataFrame:
        """One row: violations over all rules, and rules run and available."""
        return self.counts().agg(
            F.coalesce(F.sum("rows"), F.lit(0)).alias("total_violations"),
            F.lit(len(self.rules)).cast("bigint").alias("rules_executed"),
            F.lit(self.available).cast("bigint").alias("rules_available"),
        )

    def store(self) -> Violations:
        """The same result with the long frame written once to the shared folder.

        The parts are independent jobs and run side by side, so a small one fills the cores
        the tail of a large one leaves idle.
        """
        root = scratch_path(self.spark, "violations")
        paths = [f"{root}/part{i}" for i in range(len(self.parts))]
        write = inheritable_thread_target(self.spark)(lambda df, path: df.write.parquet(path))
        with ThreadPoolExecutor(max_workers=min(len(paths), PARALLEL_JOBS)) as pool:
            list(pool.map(write, self.parts, paths))
        written = self.spark.read.schema(self.parts[0].schema).parquet(*paths)
        return Violations(self.target, self.rules, [written], self.available, self.errors, self.own)


def _storable(rows: DataFrame) -> DataFrame:
    """What a user rule returned, as a dataset can hold it: repeated names are numbered, columns
    without a type (only NULL) are text."""
    names: list[str] = []
    taken = {c.lower() for c in rows.columns}
    for c in rows.columns:
        name, i = c, 0
        if c.lower() in {x.lower() for x in names}:
            while name.lower() in taken:
                i += 1
                name = f"{c}_{i}"
        taken.add(name.lower())
        names.append(name)
    renamed = rows.toDF(*names)
    untyped = {f.name for f in renamed.schema if isinstance(f.dataType, T.NullType)}
    return renamed.select(
        *[F.col(quoted(c)).cast("string").alias(c) if c in untyped else F.col(quoted(c)) for c in names]
    )


def _own_sample(rule_id: str, rows: DataFrame, columns: list[str], n: int) -> DataFrame:
    order = [F.col(quoted(c)).cast("string") for c in rows.columns]
    # a top-k: only its n rows are ranked
    top = rows.orderBy(*order).limit(n).withColumn("_rank", F.row_number().over(Window.orderBy(*order)))
    return top.select(
        F.lit(rule_id).alias("rule_id"),
        F.col("_rank").alias("rank"),
        F.lit(None).cast("bigint").alias(ROW_ID),
        *[blank_null(c) if c in rows.columns else F.lit("").alias(c) for c in columns],
    )


def _rule_bits(numbers: dict[str, int], word: int) -> str:
    """SQL text: the bit of `rule_id` in one word of 63 rules, 0 for rules of other words."""
    mine = [(r, i - 63 * word) for r, i in numbers.items() if i // 63 == word]
    tests = " ".join(f"WHEN {literal(r)} THEN {1 << i}L" for r, i in mine)
    return f"CASE rule_id {tests} ELSE 0L END" if mine else "0L"


def clean_summary(stamped: DataFrame) -> DataFrame:
    total, violated = F.count(F.lit(1)), F.count_if(F.col("Violations") > 0)
    share = lambda n: F.coalesce(F.round(F.try_divide(n * F.lit(100.0), total), 2), F.lit(0.0))
    return stamped.agg(
        total.alias("total_rows"),
        violated.alias("violated_rows"),
        (total - violated).alias("clean_rows"),
        share(violated).alias("violated_pct"),
        share(total - violated).alias("clean_pct"),
    )


def blank_null(name: str) -> Column:
    return F.coalesce(F.col(quoted(name)).cast("string"), F.lit("")).alias(name)


def check(
    target: DataFrame,
    rules: Iterable[str] | None = None,
    overrides: DataFrame | Iterable[dict] | None = None,
    view: str = TARGET_VIEW,
) -> Violations:
    """Check `target` (31 columns plus `row_id`) with the chosen rules, all by default.

    The row rules share one scan.  A group rule costs one aggregate and one narrow semi-join; those
    whose keys nest share one aggregate, which is written at once and rolled up, and one join.
    User SQL runs rule by rule, because a failing one must not take the others with it.
    """
    target = target.drop(*RESULT_COLUMNS)
    everything = effective_rules(overrides)
    wanted = None if rules is None else set(rules)
    chosen = [r for r in everything if wanted is None or r.id in wanted]
    parts, errors, own = [], {}, {}

    built_in = [r.id for r in chosen if r.sql is None]
    row_rules = [r for r in built_in if r in ROW_RULES]
    if row_rules:
        hits = row_rule_hits(target, row_rules, [ROW_ID, CAID, MID])
        parts.append(_long(hits, "rule_id"))
    nested = [r for r in built_in if r in NESTED]
    if len(nested) > 1:
        keep = list(dict.fromkeys([ROW_ID, CAID, MID, *(c for r in nested for c in RULES[r].group_by)]))
        flags = nested_flags(stored(nested_states(target), "groups"))
        parts.append(_long_of_groups(nested_hits(target, nested, flags, keep), nested))
    for rule_id in built_in:
        if len(nested) > 1 and rule_id in nested:
            continue
        if rule_id == "V1":
            hits = acquirer_name_hits(target, [ROW_ID, CAID, MID])
            parts.append(_long(hits, f"'{rule_id}'"))
        elif rule_id in GROUP_RULES:
            keep = list(dict.fromkeys([ROW_ID, CAID, MID, *RULES[rule_id].group_by]))
            hits = rows_in_flagged_groups(target, rule_id, keep)
            parts.append(_long(hits, f"'{rule_id}'", RULES[rule_id].group_by))
    for rule in chosen:
        if rule.sql is None:
            continue
        group_by = RULES[rule.id].group_by if rule.id in RULES else ()
        try:
            # written at once and whole, so any error shows here
            rows = stored(_storable(run_rule_sql(target, rule.sql, view)), "rule")
            parts.append(_long(rows, literal(rule.id), group_by))
            own[rule.id] = rows
        except Exception as error:  # a user rule may fail in any way; record and go on
            errors[rule.id] = str(error).strip().split("\n")[0]

    if not parts:
        parts.append(_long(target.limit(0), "''"))
    return Violations(target, chosen, parts, len(everything), errors, own)


def _long(hits: DataFrame, rule_id: str, group_by: Iterable[str] = ()) -> DataFrame:
    """Bring what a rule returned into the long layout; `rule_id` is SQL text."""
    has = set(hits.columns)
    keys = [f"CAST({quoted(c)} AS STRING)" for c in group_by if c in has]
    pair = f"named_struct('caid', CAST({CAID} AS STRING), 'mid', CAST({MID} AS STRING))"
    return hits.selectExpr(
        f"CAST({ROW_ID if ROW_ID in has else 'NULL'} AS BIGINT) AS {ROW_ID}",
        f"{rule_id} AS rule_id",
        f"CAST({'violated_column' if 'violated_column' in has else 'NULL'} AS STRING)"
        " AS violated_column",
        f"CAST({'array(' + ', '.join(keys) + ')' if keys else 'NULL'} AS ARRAY<STRING>)"
        " AS group_key",
        f"CAST({pair if {CAID, MID} <= has else 'NULL'} AS STRUCT<caid: STRING, mid: STRING>)"
        " AS pair",
    )


def _long_of_groups(hits: DataFrame, rule_ids: list[str]) -> DataFrame:
    """`_long` of rows that carry their `rule_id`, each with the group columns of its rule."""
    keys = " ".join(
        f"WHEN '{r}' THEN array({', '.join(f'CAST({quoted(c)} AS STRING)' for c in RULES[r].group_by)})" for r in rule_ids
    )
    return hits.selectExpr(
        f"CAST({ROW_ID} AS BIGINT) AS {ROW_ID}",
        "rule_id",
        "CAST(NULL AS STRING) AS violated_column",
        f"CASE rule_id {keys} END AS group_key",
        f"named_struct('caid', CAST({CAID} AS STRING), 'mid', CAST({MID} AS STRING)) AS pair",
    )


def trial_rule(target: DataFrame, sql: str, view: str = TARGET_VIEW) -> dict:
    """Try a rule text: how many rows it flags, a few of them, or the error it raises."""
    result = {
        "status": "success",
        "error": None,
        "total_rows_flagged": 0,
        "total_target_rows": target.count(),
        "columns": [],
        "sample_rows": [],
    }
    try:
        hits = run_rule_sql(target, sql, view)
        # the digest reads every column, so an expression that fails on any row shows here
        digest = hits.selectExpr("xxhash64(*) AS d").agg(F.count("*").alias("n"), F.bit_xor("d"))
        result["total_rows_flagged"] = digest.first().n
        if result["total_rows_flagged"]:
            ordered = hits.orderBy(ROW_ID) if ROW_ID in hits.columns else hits
            sample = ordered.select(*[blank_null(c) for c in hits.columns]).limit(SAMPLE_ROWS)
            result["columns"] = hits.columns
            result["sample_rows"] = [row.asDict() for row in sample.collect()]
    except Exception as error:  # shown to the author of the rule instead of raised
        result.update(
            status="error",
            error=str(error).strip().split("\n")[0],
            total_rows_flagged=0,
            columns=[],
            sample_rows=[],
        )
    return result
