"""The thirteen built-in rules.

Row rules are predicates over one target row.  Group rules are declared as keys, a row filter
and the values compared inside a group; one shared plan evaluates them:

    groups = rows -> GROUP BY keys: count, min and max of each value's hash   map-side combine
    hits   = rows LEFT SEMI JOIN groups                                       one narrow shuffle

"More than one distinct value" is min <> max of a hash of 64 bits, so no distinct aggregate and no sort
is needed, and a group of any size is reduced before it is shuffled.  Only values of one group are compared.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercalith.functions.normalize import (
    fold,
    key_id,
    key_text,
    no_alphanumeric,
    quoted,
    single_repeated_char,
    text,
    trim,
    trimmed,
    whole_number,
)
from mercalith.functions.similarity import jaro_winkler_once, may_exceed
from mercalith.operators.groups import join_groups

# Fixed values used by the rules.
SIMILARITY_ABOVE = 0.85
NAME_FIELDS = ("DBAName", "LegalName", "BASEIIName")
STREET_NOISE = r"[0-9,.\-#]"
STREET_MARKERS = ("%p.o.%", "%po box%", "%p o box%", "%test%address%")
STREET_JUNK = ("xxx", "xxxx", "xxxxx", "na", "n/a", "none", "null", "tbd", ".")
CITY_JUNK = ("na", "n/a", "none", "null", "tbd", ".")
TAX_ID_JUNK = ("0", "00", "000", "NA", "N/A", "NONE", "NULL", "TBD")

# Normalised forms the row rules refer to: t_ trimmed, f_ trimmed and lower case, i_ number.
_TEXT = (
    "AcquirerName",
    "AggregatorName",
    "BASEIIName",
    "BusinessRegistrationID",
    "CAID",
    "City",
    "DBAName",
    "LegalName",
    "Street",
)
_IDS = ("ProcessorBINCIB", "AcquirerBID", "AcquirerBIN")


def _junk(words: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _like_any(markers: tuple[str, ...]) -> str:
    return " OR ".join(f"f_Street LIKE '{m}'" for m in markers)


ROW_RULES: dict[str, str] = {
    # street repeats the city, or does so once digits and punctuation are taken out
    "V2": """
        f_Street = f_City
        OR (length(t_City) > 3 AND length(bare_street) > 3 AND lower(bare_street) = f_City)""",
    "V4": f"""
        {_like_any(STREET_MARKERS)}
        OR length(t_Street) < 5 OR {single_repeated_char("t_Street")}
        OR f_Street IN {_junk(STREET_JUNK)}
        OR f_City IN {_junk(CITY_JUNK)} OR length(t_City) < 2""",
    "V5": """
        t_AggregatorName <> '' AND (
          coalesce(t_BASEIIName, '') = ''
          OR f_BASEIIName = f_AcquirerName
          OR f_BASEIIName = f_DBAName
          OR f_BASEIIName = f_LegalName)""",
    "V6": """
        (i_ProcessorBINCIB <> 0 AND i_ProcessorBINCIB IN (i_AcquirerBID, i_AcquirerBIN))
        OR (i_AcquirerBID <> 0 AND i_AcquirerBID = i_AcquirerBIN)""",
    "V7": f"""
        t_CAID IS NULL OR length(t_CAID) NOT BETWEEN 3 AND 15 OR {no_alphanumeric("t_CAID")}""",
    "V9": f"""
        t_BusinessRegistrationID <> '' AND (
          length(t_BusinessRegistrationID) < 3
          OR upper(t_BusinessRegistrationID) IN {_junk(TAX_ID_JUNK)}
          OR {no_alphanumeric("t_BusinessRegistrationID")}
          OR {single_repeated_char("t_BusinessRegistrationID")})""",
    "V12": "t_BASEIIName <> '' AND f_BASEIIName IN (f_DBAName, f_LegalName)",
}


def row_rule_hits(df: DataFrame, rule_ids: list[str], keep: list[str]) -> DataFrame:
    """`keep` columns plus `rule_id` for all given row rules, in one scan and no shuffle.

    Each normalised form is one projected column shared by all rules; a row is emitted once
    per rule it breaks.
    """
    kept = [quoted(c) for c in keep]
    once = df.selectExpr(
        *kept,
        *[f"{trimmed(c)} AS t_{c}" for c in _TEXT],
        *[f"{whole_number(c, df.schema[c].dataType)} AS i_{c}" for c in _IDS],
        trim(f"regexp_replace({text('Street')}, r'{STREET_NOISE}', '')") + " AS bare_street",
    ).selectExpr("*", *[f"lower(t_{c}) AS f_{c}" for c in _TEXT])
    fired = ", ".join(f"CASE WHEN {ROW_RULES[r]} THEN '{r}' END" for r in rule_ids)
    hits = once.selectExpr(*kept, f"explode(array({fired})) AS rule_id")
    return hits.where("rule_id IS NOT NULL")


@dataclass(frozen=True)
class GroupRule:
    """Rows agree on `keys`; the group is wrong if the `values` differ (or, with `differ`
    false, if more than one row shares the only value).  `nonempty` filters the rows."""

    keys: tuple[str, ...]
    values: tuple[str, ...]
    nonempty: tuple[str, ...]
    differ: bool = True


# Normalised columns a group rule may refer to.
GROUP_COLUMNS: dict[str, str] = {
    "_mid": key_id("AcquirerMerchantID"),
    "_caid": key_id("CAID"),
    "_dba": key_text("DBAName"),
    "_legal": key_text("LegalName"),
    "_street": key_text("Street"),
    "_city": key_text("City"),
    "_postal": key_text("PostalCode"),
    # NULL as soon as one part is NULL, so such an address counts as none
    "_address": " || '|' || ".join(key_text(c) for c in ("Street", "City", "PostalCode")),
    "_aggregator": key_text("AggregatorID"),
    "_tax": key_text("BusinessRegistrationID"),
}

GROUP_RULES: dict[str, GroupRule] = {
    "V3": GroupRule(("_mid", "_caid", "_dba"), ("_address",), ("_caid",)),
    "V8": GroupRule(("_street", "_city", "_postal"), ("_mid",), ("_street", "_city", "_postal")),
    "V10": GroupRule(("_mid", "_caid"), ("_dba", "_legal"), ("_caid",)),
    "V11": GroupRule(("_caid",), ("_mid",), ("_caid",)),
    "V13": GroupRule(("_aggregator",), ("_tax",), ("_aggregator", "_tax"), differ=False),
}


def group_columns(names: tuple[str, ...]) -> list[str]:
    return [f"{GROUP_COLUMNS[n]} AS {n}" for n in names]


# Target columns behind the normalised ones.
_INPUTS = {
    "_mid": ("AcquirerMerchantID",),
    "_caid": ("CAID",),
    "_dba": ("DBAName",),
    "_legal": ("LegalName",),
    "_street": ("Street",),
    "_city": ("City",),
    "_postal": ("PostalCode",),
    "_address": ("Street", "City", "PostalCode"),
    "_aggregator": ("AggregatorID",),
    "_tax": ("BusinessRegistrationID",),
}


def group_inputs(rule_id: str) -> list[str]:
    """The target columns that a group rule reads."""
    rule = GROUP_RULES[rule_id]
    return [c for name in (*rule.keys, *rule.values, *rule.nonempty) for c in _INPUTS[name]]


def _present(keys: tuple[str, ...], nonempty: tuple[str, ...]) -> str:
    """A NULL key can match nothing later, so such rows leave before any shuffle."""
    tests = [f"{k} IS NOT NULL" for k in keys if k not in nonempty]
    return " AND ".join([*tests, *[f"{c} <> ''" for c in nonempty]])


def _hash(value: str) -> str:
    """A 64-bit hash of a value, NULL for NULL.

    A second number from the same function would be as large in every shuffle and tell no more values apart:
    its further arguments only go on from the hash of the first.
    """
    return f"IF({value} IS NULL, NULL, xxhash64({value}))"


def flagged_groups(df: DataFrame, rule_id: str) -> DataFrame:
    """Keys of the groups that break the rule, with the number `n` of rows they hold."""
    rule = GROUP_RULES[rule_id]
    keys = ", ".join(rule.keys)
    forms = [_hash(v) for v in rule.values]
    names = [f"_h{i}" for i in range(len(forms))]
    if rule.differ:
        broken = " OR ".join(f"min({h}) <> max({h})" for h in names)
    else:
        broken = " AND ".join(["count(*) > 1", *[f"min({h}) = max({h})" for h in names]])
    return df.sparkSession.sql(
        f"""
        SELECT {keys}, count(*) AS n
        FROM (SELECT {keys}, {", ".join(f"{f} AS {n}" for f, n in zip(forms, names))}
              FROM (SELECT {", ".join(group_columns(rule.keys + rule.values))} FROM {{df}})
              WHERE {_present(rule.keys, rule.nonempty)})
        GROUP BY {keys}
        HAVING {broken}
        """,
        df=df,
    )


def rows_in_flagged_groups(df: DataFrame, rule_id: str, keep: list[str]) -> DataFrame:
    """The `keep` columns of every row that belongs to a group breaking the rule."""
    rule = GROUP_RULES[rule_id]
    # rows are filtered by key only: a rule may return rows it did not count
    on_keys = tuple(c for c in rule.nonempty if c in rule.keys)
    keyed = df.selectExpr(*[quoted(c) for c in keep], *group_columns(rule.keys)).where(
        _present(rule.keys, on_keys)
    )
    return join_groups(keyed, flagged_groups(df, rule_id), rule.keys).drop(*rule.keys)


# Group rules whose keys nest: the groups of the later ones are unions of groups of the first.
NESTED = ("V3", "V10", "V11")


def nested_states(df: DataFrame) -> DataFrame:
    """One row for each (_caid, _mid, _dba) with a CAID: the smallest and largest hashes of what the NESTED
    rules compare.  States merge by min and max, so the coarser groups are rolled up from these rows."""
    forms = {"_a": _hash("_address"), "_l": _hash("_legal")}
    ranges = ", ".join(f"min({n}) AS lo{n}, max({n}) AS hi{n}" for n in forms)
    return df.sparkSession.sql(
        f"""
        SELECT _caid, _mid, _dba, {ranges}
        FROM (SELECT _caid, _mid, _dba, {", ".join(f"{f} AS {n}" for n, f in forms.items())}
              FROM (SELECT {", ".join(group_columns(("_caid", "_mid", "_dba", "_address", "_legal")))} FROM {{df}})
              WHERE _caid <> '')
        GROUP BY _caid, _mid, _dba
        """,
        df=df,
    )


def nested_flags(states: DataFrame) -> DataFrame:
    """(_caid, _mid, _dba, _broken): the groups of `nested_states` that break a rule, and which rules.

    `states` is read three times, so it should be a written table.
    """
    differ = lambda names: " OR ".join(f"min(lo{n}) <> max(hi{n})" for n in names)
    hashed = lambda c: f"{_hash(c)} AS lo_k, {_hash(c)} AS hi_k"
    spark = states.sparkSession
    of_pair = spark.sql(
        f"""SELECT _caid, _mid, true AS _v10 FROM (SELECT *, {hashed("_dba")} FROM {{s}} WHERE _mid IS NOT NULL)
        GROUP BY _caid, _mid HAVING {differ(("_l", "_k"))}""", s=states,
    )
    of_caid = spark.sql(
        f"SELECT _caid, true AS _v11 FROM (SELECT _caid, {hashed('_mid')} FROM {{s}}) GROUP BY _caid HAVING {differ(('_k',))}", s=states
    )
    own = "_mid IS NOT NULL AND _dba IS NOT NULL AND lo_a <> hi_a"
    broken = f"array_compact(array(CASE WHEN {own} THEN 'V3' END, CASE WHEN _v10 THEN 'V10' END, CASE WHEN _v11 THEN 'V11' END))"
    return (
        states.join(of_pair, ["_caid", "_mid"], "left")
        .join(of_caid, "_caid", "left")
        .selectExpr("_caid", "_mid", "_dba", f"{broken} AS _broken")
        .where("size(_broken) > 0")
    )


def nested_hits(df: DataFrame, rule_ids: list[str], flags: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns plus `rule_id` for the NESTED rules among `rule_ids`: one scan and one join."""
    keyed = df.selectExpr(*[quoted(c) for c in keep], *group_columns(("_caid", "_mid", "_dba"))).where("_caid <> ''")
    found = join_groups(keyed, flags, ("_caid", "_mid", "_dba"), "INNER", ("_broken",), null_safe=True)
    asked = _junk(tuple(rule_ids))
    return found.selectExpr(*[quoted(c) for c in keep], f"explode(filter(_broken, r -> r IN {asked})) AS rule_id")


def acquirer_name_hits(df: DataFrame, keep: list[str]) -> DataFrame:
    """V1: `keep` columns plus `violated_column`, the first name field that shows the acquirer.

    Equality is decided inside Catalyst.  A name is handed to the similarity function only if
    no earlier field is equal already and its length leaves a score above the threshold
    possible; otherwise NULL is passed, which costs next to nothing.
    """
    kept = [quoted(c) for c in keep]
    names = df.selectExpr(
        *kept, f"{fold('AcquirerName')} AS _acq", *[f"{fold(c)} AS _{c}" for c in NAME_FIELDS]
    )
    equal = " ".join(f"WHEN _{c} = _acq THEN '{c}'" for c in NAME_FIELDS)
    open_ = names.selectExpr("*", f"CASE {equal} END AS _equal").selectExpr(
        *kept,
        "_acq",
        "_equal",
        *[
            f"CASE WHEN (_equal IS NULL OR _equal IN {_junk(NAME_FIELDS[i + 1:] or ('',))}) "
            f"AND {may_exceed(f'_{c}', '_acq', SIMILARITY_ABOVE)} THEN _{c} END AS _{c}"
            for i, c in enumerate(NAME_FIELDS)
        ],
    )
    scored = open_.select(
        *[F.expr(c) for c in [*kept, "_equal"]],
        *[jaro_winkler_once(F.col(f"_{c}"), F.col("_acq")).alias(f"_{c}") for c in NAME_FIELDS],
    )
    first = " ".join(
        f"WHEN _equal = '{c}' OR _{c} > {SIMILARITY_ABOVE}D THEN '{c}'" for c in NAME_FIELDS
    )
    hits = scored.selectExpr(*kept, f"CASE {first} END AS violated_column")
    return hits.where("violated_column IS NOT NULL")


def rule_rows(df: DataFrame, rule_id: str) -> DataFrame:
    """All columns of the rows breaking one built-in rule, plus `violation_id`."""
    df = df.drop("Violations", "violation_id", "violated_column")
    if rule_id in ROW_RULES:
        return row_rule_hits(df, [rule_id], df.columns).withColumnRenamed("rule_id", "violation_id")
    if rule_id == "V1":
        hits = acquirer_name_hits(df, df.columns)
    else:
        hits = rows_in_flagged_groups(df, rule_id, df.columns)
    return hits.withColumn("violation_id", F.lit(rule_id))
