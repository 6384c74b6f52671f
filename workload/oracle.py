"""Building blocks of the checking SQL (DuckDB dialect)."""

from __future__ import annotations

from workload.target_view import TARGET_SQL

TARGET = f"target AS ({TARGET_SQL})"

# One column per normalised form; `n` is the target seen through them.
FORMS = """n AS (
  SELECT *,
    upper(replace(AcquirerMerchantID, ' ', '')) AS k_mid,
    upper(replace(CAID, ' ', '')) AS k_caid,
    upper(trim(DBAName)) AS k_dba, upper(trim(LegalName)) AS k_legal,
    upper(trim(Street)) AS k_street, upper(trim(City)) AS k_city, upper(trim(PostalCode)) AS k_post,
    upper(trim(AggregatorID)) AS k_agg, upper(trim(BusinessRegistrationID)) AS k_tax,
    lower(trim(AcquirerName)) AS acq, lower(trim(DBAName)) AS dba, lower(trim(LegalName)) AS legal,
    lower(trim(BASEIIName)) AS base, trim(AggregatorName) AS agg,
    lower(trim(Street)) AS s_low, lower(trim(City)) AS c_low,
    lower(trim(regexp_replace(Street, '[0-9,.\\-#]', '', 'g'))) AS bare
  FROM target)"""

# Group rules: how many different values does each row's group hold?
SPREADS = """g AS (
  SELECT *,
    count(DISTINCT k_street || '|' || k_city || '|' || k_post)
      OVER (PARTITION BY k_mid, k_caid, k_dba) AS addresses,
    count(DISTINCT k_mid) OVER (PARTITION BY k_street, k_city, k_post) AS address_mids,
    count(DISTINCT k_dba) OVER (PARTITION BY k_mid, k_caid) AS dbas,
    count(DISTINCT k_legal) OVER (PARTITION BY k_mid, k_caid) AS legals,
    count(DISTINCT k_mid) OVER (PARTITION BY k_caid) AS caid_mids,
    count(DISTINCT nullif(k_tax, '')) OVER (PARTITION BY k_agg) AS agg_taxes,
    count(nullif(k_tax, '')) OVER (PARTITION BY k_agg) AS agg_rows
  FROM n)"""

_NEAR = "({0} = acq OR jaro_winkler_similarity({0}, acq) > 0.85)"

RULE_SQL = {
    "V1": " OR ".join(_NEAR.format(c) for c in ("dba", "legal", "base")),
    "V2": "s_low = c_low OR (bare = c_low AND least(length(c_low), length(bare)) > 3)",
    "V3": "k_caid <> '' AND k_mid IS NOT NULL AND k_dba IS NOT NULL AND addresses > 1",
    "V4": """regexp_matches(s_low, 'p\\.o\\.|po box|p o box|test.*address') OR length(s_low) < 5
        OR regexp_matches(s_low, '^(x{3,5}|na|n/a|none|null|tbd|\\.)$')
        OR s_low = repeat(left(s_low, 1), length(s_low))
        OR c_low IN ('na', 'n/a', 'none', 'null', 'tbd', '.') OR length(c_low) < 2""",
    "V5": """agg <> '' AND (coalesce(base, '') = '' OR base = acq OR base = dba OR base = legal)""",
    "V6": """(ProcessorBINCIB = AcquirerBID AND AcquirerBID <> 0)
        OR (ProcessorBINCIB = AcquirerBIN AND AcquirerBIN <> 0)
        OR (AcquirerBID = AcquirerBIN AND AcquirerBIN <> 0)""",
    "V7": """CAID IS NULL OR length(trim(CAID)) NOT BETWEEN 3 AND 15
        OR NOT regexp_matches(CAID, '[a-zA-Z0-9]')""",
    "V8": "k_street <> '' AND k_city <> '' AND k_post <> '' AND address_mids > 1",
    "V9": """k_tax <> '' AND (length(k_tax) < 3 OR NOT regexp_matches(k_tax, '[A-Z0-9]')
        OR k_tax IN ('0', '00', '000', 'NA', 'N/A', 'NONE', 'NULL', 'TBD')
        OR trim(BusinessRegistrationID) = repeat(left(k_tax, 1), length(k_tax)))""",
    "V10": "k_caid <> '' AND k_mid IS NOT NULL AND greatest(dbas, legals) > 1",
    "V11": "k_caid <> '' AND caid_mids > 1",
    "V12": "base <> '' AND (base = dba OR base = legal)",
    "V13": "k_agg <> '' AND agg_taxes = 1 AND agg_rows > 1",
}

FIRST_NAME = "CASE " + " ".join(
    f"WHEN {_NEAR.format(c)} THEN '{name}'"
    for c, name in (("dba", "DBAName"), ("legal", "LegalName"), ("base", "BASEIIName"))
) + " END"

# Raw columns that make up a violation group.
GROUP_KEYS = {
    "V3": "CAID, AcquirerMerchantID, DBAName",
    "V8": "Street, City, PostalCode",
    "V10": "CAID, AcquirerMerchantID",
    "V11": "CAID",
    "V13": "AggregatorID",
}

HITS = "hits AS (" + " UNION ALL ".join(
    f"SELECT row_id, CAID, AcquirerMerchantID, '{r}' AS rule_id, "
    f"{FIRST_NAME if r == 'V1' else 'NULL'} AS violated_column, "
    f"CAST(row({GROUP_KEYS[r] if r in GROUP_KEYS else 'row_id'}) AS VARCHAR) AS grp "
    f"FROM g WHERE {condition}"
    for r, condition in RULE_SQL.items()
) + ")"


def over_target(body: str, *ctes: str) -> str:
    """`body` with the target and the given CTEs in front."""
    return "WITH " + ",\n".join([TARGET, *ctes]) + "\n" + body


def over_forms(body: str, *ctes: str) -> str:
    return over_target(body, FORMS, SPREADS, *ctes)


def over_hits(body: str, *ctes: str) -> str:
    return over_target(body, FORMS, SPREADS, HITS, *ctes)
