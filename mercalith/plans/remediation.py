"""Propose corrections as rows, apply them as a join, and check again.

fixes: fix_id, rule_id, source_row_id (the violating row), column_no (order within that row),
row_id (the row to change), column, old_value, new_value, reasoning, confidence, strategy,
needs_confirmation.  Fixes are ordered by (source_row_id, column_no).
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercalith.functions.normalize import WHITESPACE, cast_value, literal, quoted
from mercalith.operators.groups import join_groups
from mercalith.operators.rules import (
    GROUP_RULES,
    NAME_FIELDS,
    ROW_RULES,
    acquirer_name_hits,
    group_columns,
    group_inputs,
    row_rule_hits,
    rows_in_flagged_groups,
)
from mercalith.plans.checker import CAID, MID, Rule, run_rule
from mercalith.session import stored
from mercalith.spec import DEFAULT_STRATEGY, ROW_ID, RULES, SPARK_TYPES, TARGET_COLUMNS

_ORDER = ("source_row_id", "column_no")


_IDS = (f"CAST({CAID} AS STRING) AS _caid", f"CAST({MID} AS STRING) AS _mid")


def first_rows_of_ids(target: DataFrame, hits: Iterable[DataFrame] = ()) -> DataFrame:
    """_caid, _mid, located: the smallest row of every pair, and of every single identifier with the other one NULL.

    With `hits` only for the identifiers that occur there, so that one small lookup serves several rules.
    """
    known = target.sparkSession.sql(
        f"""
        SELECT key._caid, key._mid, min(located) AS located
        FROM (
          SELECT min({ROW_ID}) AS located, explode(array(
            named_struct('_caid', _caid, '_mid', _mid),
            named_struct('_caid', _caid, '_mid', CAST(NULL AS STRING)),
            named_struct('_caid', CAST(NULL AS STRING), '_mid', _mid))) AS key
          FROM {{ids}} GROUP BY _caid, _mid)
        WHERE key._caid IS NOT NULL OR key._mid IS NOT NULL
        GROUP BY key._caid, key._mid
        """,
        ids=target.selectExpr(*_IDS, ROW_ID),
    )
    asked = [h.selectExpr(*_IDS) for h in hits]
    if not asked:
        return known
    return join_groups(known, reduce(DataFrame.unionByName, asked).distinct(), ("_caid", "_mid"), null_safe=True)


def locate_rows(hits: DataFrame, target: DataFrame, mode: str = "first", known: DataFrame | None = None) -> DataFrame:
    """`hits` plus `located`, the target row a correction of the hit goes to.

    Mode `first` is the first target row with the same identifiers, compared as text; a NULL
    identifier is left out of the comparison and a hit with both NULL is dropped.  Mode
    `exact` is the violating row itself.

    One lookup table (`known`, or `first_rows_of_ids` of the target) answers all hits in one join.
    """
    if mode == "exact":
        return hits.withColumn("located", F.col(ROW_ID))
    known = first_rows_of_ids(target) if known is None else known
    rows = hits.selectExpr("*", *_IDS).where("_caid IS NOT NULL OR _mid IS NOT NULL")
    found = join_groups(rows, known, ("_caid", "_mid"), "INNER", ("located",), null_safe=True)
    return found.drop("_caid", "_mid")


def _strip(name: str) -> str:
    return f"trim(BOTH {literal(WHITESPACE)} FROM coalesce(CAST({name} AS STRING), ''))"


def _fix(
    number: int, column: str, when: str, old: str, new: str, why: str, confidence: float,
    strategy: str, confirm: bool,
) -> str:
    """SQL text of one proposal struct, NULL where `when` does not hold."""
    return (
        f"CASE WHEN {when} THEN named_struct('column_no', {number}, 'column', '{column}', "
        f"'old_value', {old}, 'new_value', {new}, 'reasoning', {why}, "
        f"'confidence', {confidence}D, 'strategy', '{strategy}', "
        f"'needs_confirmation', {str(confirm).lower()}) END"
    )


def _told(name: str) -> str:
    return f"coalesce(CAST({name} AS STRING), '')"


def _stub(number: int, column: str, when: str, why: str, strategy: str = "web_research") -> str:
    """A proposal without a value: somebody has to find one."""
    old = f"CAST({quoted(column)} AS STRING)"
    return _fix(number, column, when, old, "CAST(NULL AS STRING)", why, 0.0, strategy, True)


def _proposals(rule_id: str, columns: Iterable[str]) -> list[str]:
    dba = _told("DBAName")
    if rule_id == "V1":
        acquirer = _strip("AcquirerName")
        return [
            _fix(
                i, c, f"{_strip(c)} <> '' AND lower({_strip(c)}) = lower({acquirer})", _strip(c),
                "''",
                f"concat('''', {_strip(c)}, ''' is the acquirer''s name, not the merchant''s')",
                0.95, "web_research", True,
            )
            for i, c in enumerate(NAME_FIELDS)
        ]
    if rule_id == "V2":
        why = (
            f"concat('Street ''', {_told('Street')}, ''' repeats city ''', {_told('City')}, "
            f"''' for merchant ''', {dba}, '''; the real address has to be found')"
        )
        return [_stub(0, "Street", "true", why)]
    if rule_id == "V4":
        return [
            _stub(0, "Street", "true", f"concat('No valid address for merchant ''', {dba}, '''')")
        ]
    if rule_id == "V5":
        aggregator, name = _strip("AggregatorName"), _strip("DBAName")
        new = (
            f"CASE WHEN {name} = '' THEN {aggregator} "
            f"ELSE concat({aggregator}, ' * ', {name}) END"
        )
        return [
            _fix(
                0, "BASEIIName", f"{aggregator} <> ''", _told("BASEIIName"), new,
                "'Derived from the aggregator and merchant names'", 0.9, "auto_fix", False,
            )
        ]
    if rule_id == "V9":
        why = f"concat('Tax id ''', {_told('BusinessRegistrationID')}, ''' of ''', {dba}, ''' is no valid id')"
        return [_stub(0, "BusinessRegistrationID", "true", why)]
    if rule_id == "V12":
        base = f"lower({_strip('BASEIIName')})"
        return [
            _stub(
                i, c, f"{base} = lower({_strip(c)})",
                f"'{c} equals BASEIIName; the merchant''s own name is needed'",
            )
            for i, c in enumerate(("DBAName", "LegalName"))
        ]
    strategy = RULES[rule_id].strategy if rule_id in RULES else DEFAULT_STRATEGY
    need = "web research" if strategy == "web_research" else "manual review"
    first = next(iter(columns), "Unknown")
    return [_stub(0, first, "true", f"'Flagged by {rule_id}, needs {need}'", strategy)]


# The columns that the proposals of a rule with a plan of its own read.
_READ = {
    "V1": ("AcquirerName", *NAME_FIELDS),
    "V2": ("Street", "City", "DBAName"),
    "V4": ("Street", "DBAName"),
    "V5": ("AggregatorName", "DBAName", "BASEIIName"),
    "V9": ("BusinessRegistrationID", "DBAName"),
    "V12": ("BASEIIName", "DBAName", "LegalName"),
}


def columns_read(rule: Rule) -> list[str]:
    """The columns of a hit that `propose_fixes` needs for `rule`."""
    return list(dict.fromkeys([ROW_ID, CAID, MID, *_READ.get(rule.id, rule.columns[:1])]))


def propose_fixes(
    target: DataFrame,
    rule: Rule,
    mode: str = "first",
    max_fixes: int | None = None,
    hits: DataFrame | None = None,
    known: DataFrame | None = None,
) -> DataFrame:
    """The proposals for one rule, all of them unless `max_fixes` asks for the first so many.

    Where several rules are asked, `known` may be the stored `first_rows_of_ids` of all their hits.
    """
    hits = run_rule(target, rule) if hits is None else hits
    proposals = ", ".join(_proposals(rule.id, rule.columns))
    found = (
        locate_rows(hits, target, mode, known)
        .selectExpr(f"{ROW_ID} AS source_row_id", f"located AS {ROW_ID}", f"inline(array({proposals}))")
        .where("column_no IS NOT NULL")
        .selectExpr(
            f"concat_ws(':', '{rule.id}', source_row_id, `column`) AS fix_id",
            f"'{rule.id}' AS rule_id",
            "*",
        )
    )
    return found if max_fixes is None else cap_fixes(found, max_fixes)


def cap_fixes(fixes: DataFrame, limit: int) -> DataFrame:
    """The first `limit` fixes; a task keeps `limit` rows at most."""
    return fixes.orderBy(*_ORDER).limit(limit)


def plan_summary(fixes: DataFrame, total: DataFrame) -> DataFrame:
    """rule_id, total_affected, counts by strategy and one line of text.

    `total` has a row (rule_id, total_affected) per rule.
    """
    # fixed values: strategy and the words for it, in reading order
    worded = (
        ("auto_fix", "auto-fixable"),
        ("web_research", "need web research"),
        ("manual_review", "need manual review"),
    )
    counts = fixes.groupBy("rule_id").agg(
        *[F.expr(f"count_if(strategy = '{s}')").alias(s) for s, _ in worded]
    )
    parts = ", ".join(f"CASE WHEN {s} > 0 THEN concat({s}, ' {words}') END" for s, words in worded)
    text = f"concat_ws(', ', {parts})"
    return (
        total.join(counts, "rule_id", "left")
        .na.fill(0, [s for s, _ in worded])
        .selectExpr(
            "rule_id",
            "total_affected",
            *[s for s, _ in worded],
            f"CASE WHEN {text} = '' THEN concat(total_affected, ' violations found') "
            f"ELSE concat(total_affected, ' violations: ', {text}) END AS summary",
        )
    )


def _judged(target: DataFrame, fixes: DataFrame) -> DataFrame:
    """`fixes` with a value, whether their column is the target's and whether its type can hold it."""
    names = {c for c in target.columns if c != ROW_ID}
    types = {c.name: SPARK_TYPES[c.type] for c in TARGET_COLUMNS if c.name in names}
    # text columns take any value; '' empties a column of another type
    typed = {n: t for n, t in types.items() if not isinstance(t, T.StringType)}
    tests = " ".join(
        f"WHEN `column` = '{n}' THEN new_value = '' OR {cast_value('new_value', t)} IS NOT NULL" for n, t in typed.items()
    )
    listed = ", ".join(f"'{n}'" for n in sorted(names))
    fits = f"CASE {tests} ELSE true END" if tests else "true"
    return fixes.where("new_value IS NOT NULL").selectExpr("*", f"`column` IN ({listed}) AS _known", f"{fits} AS _fits")


def rejected_fixes(target: DataFrame, fixes: DataFrame) -> DataFrame:
    """The fixes whose value the column's type cannot hold; `apply_fixes` leaves those cells alone."""
    return _judged(target, fixes).where("_known AND NOT _fits").drop("_known", "_fits")


def apply_fixes(
    target: DataFrame, fixes: DataFrame, order: Iterable[str] = _ORDER
) -> DataFrame:
    """A new version of the target.  Fixes without a value do nothing, nor do those whose value
    the column's type cannot hold (`rejected_fixes`); of several fixes of one cell the last in
    `order` wins; '' is a value (NULL in a column that is no text), NULL is none."""
    order = list(order)
    columns = [c for c in target.columns if c != ROW_ID]
    last = (
        _judged(target, fixes)
        .where("_known AND _fits")
        .groupBy(ROW_ID, "column")
        .agg(F.expr(f"max_by(new_value, struct({', '.join(order)}))").alias("new_value"))
        .groupBy(ROW_ID)
        .agg(F.expr("map_from_entries(collect_list(struct(`column`, new_value)))").alias("_new"))
    )
    types = {c.name: SPARK_TYPES[c.type] for c in TARGET_COLUMNS}
    changed = []
    for c in columns:
        value = cast_value(f"_new['{c}']", types.get(c, T.StringType()))
        changed.append(
            f"CASE WHEN map_contains_key(_new, '{c}') THEN {value} ELSE {quoted(c)} END AS {quoted(c)}"
        )
    return target.join(last, ROW_ID, "left").selectExpr(ROW_ID, *changed)


def rows_modified(target: DataFrame, fixes: DataFrame) -> DataFrame:
    """One row: how many fixes had a known column, a value that fits and a row to go to, repeats included."""
    return (
        _judged(target, fixes)
        .where("_known AND _fits")
        .join(target.select(ROW_ID), ROW_ID, "left_semi")
        .agg(F.count(F.lit(1)).alias("rows_modified"))
    )


def reverify(rule: Rule, before: DataFrame, after: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """rule_id, counts on both versions and delta (positive: fewer violations).

    With `counts` (rule_id, rows) of an earlier check also `total_violations`, its total with this
    rule's new count in place of the old one.
    """
    counted = [
        run_rule(version, rule).agg(F.count(F.lit(1)).alias("n")).selectExpr(f"'{which}' AS w", "n")
        for which, version in (("old", before), ("new", after))
    ]
    found = (
        counted[0]
        .unionByName(counted[1])
        .agg(
            F.expr("sum(CASE WHEN w = 'old' THEN n END)").alias("previous_violation_count"),
            F.expr("sum(CASE WHEN w = 'new' THEN n END)").alias("new_violation_count"),
        )
        .selectExpr(
            f"'{rule.id}' AS rule_id",
            "*",
            "previous_violation_count - new_violation_count AS delta",
        )
    )
    if counts is None:
        return found
    # one row on either side
    others = counts.agg(F.expr(f"coalesce(sum(IF(rule_id <> '{rule.id}', rows, 0)), 0L)").alias("others")).selectExpr(
        f"'{rule.id}' AS rule_id", "others"
    )
    return found.join(others, "rule_id").selectExpr(
        *found.columns, "others + new_violation_count AS total_violations"
    )


def reverify_delta(
    target: DataFrame, fixes: DataFrame, counts: DataFrame, rules: Iterable[str] | None = None, order: Iterable[str] = _ORDER
) -> DataFrame:
    """The counts of built-in rules after `fixes`, from those before (`counts`: rule_id, rows), without a new run.

    Row rules are run on the changed rows alone, as they were and as they are.  For a group rule the keys that the
    changed rows had and have select the touched groups; only their rows are aggregated, in both
    versions, and the count moves by the difference.  One row for each rule: rule_id,
    previous_violation_count, new_violation_count, delta (positive: fewer), total_violations over all
    rules of `counts` after the fixes, and rows_modified, the number of fixes applied.
    """
    spark = target.sparkSession
    chosen = [r for r in RULES if rules is None or r in set(rules)]
    usable = _judged(target, fixes).where("_known AND _fits")
    touched = usable.select(ROW_ID).distinct()
    # three readers each
    old = stored(target.join(touched, ROW_ID, "left_semi"), "changed-old")
    new = stored(apply_fixes(old, fixes, order), "changed-new")
    parts = []

    def count(rows: DataFrame, sign: int, rule_id: str | None = None) -> None:
        named = rows.withColumn("rule_id", F.lit(rule_id)) if rule_id else rows
        parts.append(named.groupBy("rule_id").agg((F.count(F.lit(1)) * sign).alias("moved")))

    row_rules = [r for r in chosen if r in ROW_RULES]
    for version, sign in ((old, -1), (new, 1)):
        if row_rules:
            count(row_rule_hits(version, row_rules, [ROW_ID]), sign)
        if "V1" in chosen:
            count(acquirer_name_hits(version, [ROW_ID]), sign, "V1")
    for rule_id in (r for r in chosen if r in GROUP_RULES):
        before, after = _touched_groups(target, old, new, rule_id)
        count(rows_in_flagged_groups(before, rule_id, [ROW_ID]), -1, rule_id)
        count(rows_in_flagged_groups(after, rule_id, [ROW_ID]), 1, rule_id)
    moved = reduce(DataFrame.unionByName, parts).groupBy("rule_id").agg(F.sum("moved").alias("moved"))
    listed = spark.createDataFrame([(r,) for r in chosen], "rule_id string")
    # a row for each rule
    each = (
        counts.select("rule_id", "rows").join(listed, "rule_id", "full").join(moved, "rule_id", "left")
        .na.fill(0, ["rows", "moved"])
    )
    # one row each, joined by a constant
    totals = each.agg(F.sum(F.col("rows") + F.col("moved")).alias("total_violations")).withColumn("one", F.lit(1))
    applied = rows_modified(target, fixes).withColumn("one", F.lit(1))
    return (
        each.join(listed, "rule_id", "left_semi")
        .withColumn("one", F.lit(1))
        .join(totals, "one")
        .join(applied, "one")
        .selectExpr(
            "rule_id", "rows AS previous_violation_count", "rows + moved AS new_violation_count", "-moved AS delta",
            "total_violations", "rows_modified",
        )
    )


def _touched_groups(target: DataFrame, old: DataFrame, new: DataFrame, rule_id: str) -> tuple[DataFrame, DataFrame]:
    """All rows, before and after, of the groups that the changed rows left or joined."""
    rule = GROUP_RULES[rule_id]
    needed = list(dict.fromkeys([ROW_ID, *group_inputs(rule_id)]))
    keyed = lambda df: df.select(*needed).selectExpr("*", *group_columns(rule.keys))
    some = keyed(old).select(*rule.keys).unionByName(keyed(new).select(*rule.keys))
    keys = some.where(" AND ".join(f"{k} IS NOT NULL" for k in rule.keys)).distinct()
    within = lambda df: join_groups(keyed(df), keys, rule.keys, few=True).select(*needed)
    # read by the aggregate and by the join of either version
    before = stored(within(target), "touched")
    unchanged = before.join(old.select(ROW_ID), ROW_ID, "left_anti")
    return before, unchanged.unionByName(within(new))


def usable_suggestions(target: DataFrame, suggested: DataFrame) -> DataFrame:
    """Suggested values (row_id, column, value, position) that name a target column and hold a
    value, in the layout of fixes."""
    listed = ", ".join(f"'{c}'" for c in target.columns if c != ROW_ID)
    return suggested.where(f"value IS NOT NULL AND `column` IN ({listed})").selectExpr(
        ROW_ID, "`column`", "value AS new_value", "position"
    )


def apply_suggestions(target: DataFrame, suggested: DataFrame) -> DataFrame:
    return apply_fixes(target, usable_suggestions(target, suggested), ["position"])


def columns_modified(target: DataFrame, suggested: DataFrame) -> DataFrame:
    """row_id, columns_modified for every target row that takes a suggestion; values that the
    column's type refuses are none."""
    usable = _judged(target, usable_suggestions(target, suggested)).where("_known AND _fits").groupBy(ROW_ID).agg(
        F.count(F.lit(1)).alias("columns_modified")
    )
    return usable.join(target.select(ROW_ID), ROW_ID, "left_semi")


# How much of a search is kept.
MAX_QUERIES, MAX_RESULTS, MAX_FINDINGS = 3, 5, 10


def top_findings(findings: DataFrame) -> DataFrame:
    """At most 10 findings per merchant: the first 5 results of its first 3 queries, in order.

    Queries are ranked by their number and results by theirs, whatever the numbers are.  Each
    ranking keeps a bounded number of rows per group, which Spark cuts before it shuffles.
    """
    queries = "dense_rank() OVER (PARTITION BY merchant_name ORDER BY query_no)"
    results = "row_number() OVER (PARTITION BY merchant_name, query_no ORDER BY result_no, source)"
    place = "row_number() OVER (PARTITION BY merchant_name ORDER BY query_no, result_no, source)"
    return (
        findings.selectExpr("*", f"{results} AS _result").where(f"_result <= {MAX_RESULTS}")
        .selectExpr("*", f"{queries} AS _query").where(f"_query <= {MAX_QUERIES}")
        .drop("_result", "_query")
        .selectExpr("*", f"{place} AS finding_no").where(f"finding_no <= {MAX_FINDINGS}")
    )
