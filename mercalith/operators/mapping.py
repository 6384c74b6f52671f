"""Column mappings as data: how complete they are, and which source column fits best."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercalith.functions.normalize import literal
from mercalith.spec import TARGET_COLUMNS, TARGET_NAMES

# Fixed values.
LOW_CONFIDENCE = 0.7
MAX_CANDIDATES = 5


def _names(*needs: str) -> str:
    chosen = [c.name for c in TARGET_COLUMNS if c.need in needs]
    return "array(" + ", ".join(f"'{n}'" for n in chosen) + ")"


def _per_feed(mappings: DataFrame, condition: str) -> DataFrame:
    """feed, names (number of distinct target names meeting the condition), known (those of
    the schema, at most 31).  Duplicates collapse before a feed is gathered, however many
    rows it has."""
    once = mappings.groupBy("feed", "target").agg(F.expr(f"bool_or({condition})").alias("ok"))
    in_spec = ", ".join(f"'{n}'" for n in TARGET_NAMES)
    return once.groupBy("feed").agg(
        F.expr("count_if(ok)").alias("names"),
        F.expr(f"collect_set(CASE WHEN ok AND target IN ({in_spec}) THEN target END)").alias(
            "known"
        ),
    )


_MAPPED = "coalesce(source_column, '') <> '' OR coalesce(is_derived, false)"


def completeness(mappings: DataFrame) -> DataFrame:
    """Per feed: columns mapped (a source or a derivation), share of 31, and what is missing."""
    return _per_feed(mappings, _MAPPED).selectExpr(
        "feed",
        f"{len(TARGET_NAMES)}L AS total_columns",
        "names AS mapped_columns",
        f"round(names * 100D / {len(TARGET_NAMES)}, 1) AS coverage_pct",
        f"array_except({_names('required')}, known) AS missing_required",
        f"array_except({_names('submerchant')}, known) AS missing_submerchant_required",
        f"array_except({_names('optional')}, known) AS missing_optional",
    )


def coverage(mappings: DataFrame) -> DataFrame:
    """Per feed and target column: is it mapped, and how much is it needed?"""
    spec = ", ".join(f"struct('{c.name}' AS target, '{c.need}' AS need)" for c in TARGET_COLUMNS)
    return _per_feed(mappings, _MAPPED).selectExpr("feed", "known", f"inline(array({spec}))").selectExpr(
        "feed", "target", "need", "array_contains(known, target) AS mapped"
    )


def unmapped(mappings: DataFrame) -> DataFrame:
    """Per feed: target columns without any mapping entry; sub-merchant ones count as optional."""
    return _per_feed(mappings, "true").selectExpr(
        "feed",
        f"array_except({_names('required')}, known) AS unmapped_required",
        f"array_except({_names('submerchant', 'optional')}, known) AS unmapped_optional",
    )


def low_confidence(mappings: DataFrame, below: float = LOW_CONFIDENCE) -> DataFrame:
    return mappings.where(f"coalesce(source_column, '') <> '' AND confidence < {below}D")


# Weights of the candidate score: dictionary text and known values first, then name, type and fill rate.
_WEIGHTS = {"dictionary": 0.4, "values": 0.4, "name": 0.4, "type": 0.1, "fill": 0.1}
_FAMILIES = {
    "integer": "('tinyint', 'smallint', 'int', 'bigint')",
    "string": "('string')",
    "date": "('date', 'timestamp', 'timestamp_ntz')",
}


def rank_candidates(
    stats: DataFrame, dictionary: DataFrame | None = None, keep: int = MAX_CANDIDATES, evidence: DataFrame | None = None
) -> DataFrame:
    """Up to `keep` source columns per target column, best first.

    `stats` is the profile (a row per source column); each row meets the 31 target columns.
    The score weighs whether a dictionary text names the target, how close the names are,
    whether the type fits and how few NULLs the column has, and, with `evidence`
    (`content.value_evidence`), how alike its values are to those known for the target.
    """
    spec = ", ".join(
        f"struct({i} AS position, '{c.name}' AS target, '{c.type}' AS type)"
        for i, c in enumerate(TARGET_COLUMNS)
    )
    columns = stats.select("table_name", "column_name", "data_type", "null_pct")
    if dictionary is None:
        described = columns.withColumn("description", F.lit(None).cast("string"))
    else:
        texts = dictionary.groupBy(
            F.col("source_table").alias("table_name"), "column_name"
        ).agg(F.min("description").alias("description"))
        described = columns.join(texts, ["table_name", "column_name"], "left")
    plain = "lower(regexp_replace({}, '[^A-Za-z0-9]', ''))"
    # the one- or two-letter prefix of a column name says nothing about its content
    source = plain.format("regexp_replace(column_name, '^[A-Za-z]{1,2}_', '')")
    type_fit = " ".join(
        f"WHEN type = '{t}' AND data_type IN {family} THEN 1D" for t, family in _FAMILIES.items()
    )
    each = described.selectExpr("*", f"inline(array({spec}))")
    if evidence is None:
        each = each.withColumn("value_score", F.lit(0.0))
    else:
        each = each.join(evidence, ["table_name", "column_name", "target"], "left").withColumn("value_score", F.coalesce("similarity", F.lit(0.0)))
    scored = (
        each
        .selectExpr("*", f"{source} AS _source", f"{plain.format('target')} AS _target")
        .selectExpr(
            "*",
            "1D - levenshtein(_source, _target) / CAST(greatest(length(_source), length(_target)) AS DOUBLE)"
            " AS name_score",
            f"CASE {type_fit} ELSE 0D END AS type_score",
            f"CASE WHEN contains({plain.format('description')}, _target) THEN 1D ELSE 0D END"
            " AS dictionary_score",
        )
        .selectExpr(
            "*",
            f"round({_WEIGHTS['dictionary']}D * dictionary_score + {_WEIGHTS['values']}D * value_score"
            f" + {_WEIGHTS['name']}D * name_score + {_WEIGHTS['type']}D * type_score"
            f" + {_WEIGHTS['fill']}D * (1D - null_pct / 100D), 4) AS confidence",
        )
    )
    rank = (
        "row_number() OVER (PARTITION BY target "
        "ORDER BY confidence DESC, table_name, column_name)"
    )
    return (
        scored.selectExpr(
            "position",
            "target",
            f"{rank} AS rank",
            "table_name AS source_table",
            "column_name AS source_column",
            "confidence",
            "CASE WHEN dictionary_score > 0 THEN 'dictionary text names the column' "
            "WHEN value_score > 0 THEN 'values known for the column' "
            "WHEN name_score >= 0.5 THEN 'similar name' ELSE 'closest available' END AS reasoning",
        )
        .where(f"rank <= {keep}")
    )


def as_mappings(ranked: DataFrame, feed: str) -> DataFrame:
    """Fold ranked candidates into mapping rows: the best one, the others as alternatives."""
    choice = (
        "struct(rank, source_table, source_column, confidence, reasoning, "
        "false AS is_derived, '' AS derivation_logic)"
    )
    return (
        ranked.groupBy("target")
        .agg(F.expr(f"array_sort(collect_list({choice}))").alias("choices"))
        .selectExpr(
            f"{literal(feed)} AS feed",
            "target",
            "choices[0].source_table AS source_table",
            "choices[0].source_column AS source_column",
            "choices[0].confidence AS confidence",
            "choices[0].reasoning AS reasoning",
            "false AS is_derived",
            "'' AS derivation_logic",
            "transform(slice(choices, 2, 4), x -> struct(x.source_table, x.source_column, "
            "x.confidence, x.reasoning, x.is_derived, x.derivation_logic)) AS alternatives",
        )
    )
