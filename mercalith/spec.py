"""The fixed 31-column target schema and the registry of built-in rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

ROW_ID = "row_id"


@dataclass(frozen=True)
class TargetColumn:
    """`need`: required, submerchant (required for sub-merchants only) or optional."""

    name: str
    type: str
    need: str


# The target columns in output order.
TARGET_COLUMNS = [
    TargetColumn("ProcessorBINCIB", "integer", "required"),
    TargetColumn("ProcessorName", "string", "required"),
    TargetColumn("LocationCountry", "integer", "required"),
    TargetColumn("AcquirerBID", "integer", "required"),
    TargetColumn("AcquirerName", "string", "required"),
    TargetColumn("AcquirerMerchantID", "string", "required"),
    TargetColumn("AcquirerBIN", "integer", "required"),
    TargetColumn("AggregatorID", "string", "submerchant"),
    TargetColumn("AggregatorName", "string", "submerchant"),
    TargetColumn("AggregatorType", "string", "submerchant"),
    TargetColumn("CAID", "string", "required"),
    TargetColumn("DBAName", "string", "required"),
    TargetColumn("LegalName", "string", "required"),
    TargetColumn("CorporateStatus", "integer", "required"),
    TargetColumn("CorporateName", "string", "optional"),
    TargetColumn("DateSigned", "date", "required"),
    TargetColumn("BASEIIName", "string", "submerchant"),
    TargetColumn("Street", "string", "required"),
    TargetColumn("City", "string", "required"),
    TargetColumn("StateProvinceCode", "string", "optional"),
    TargetColumn("PostalCode", "string", "required"),
    TargetColumn("MCC1", "integer", "required"),
    TargetColumn("MCC2", "integer", "optional"),
    TargetColumn("MCC3", "integer", "optional"),
    TargetColumn("MCC4", "integer", "optional"),
    TargetColumn("MCC5", "integer", "optional"),
    TargetColumn("MCC6", "integer", "optional"),
    TargetColumn("MCC7", "integer", "optional"),
    TargetColumn("MCC8", "integer", "optional"),
    TargetColumn("MCC9", "integer", "optional"),
    TargetColumn("BusinessRegistrationID", "string", "optional"),
]
TARGET_NAMES = [c.name for c in TARGET_COLUMNS]
SPARK_TYPES = {"integer": T.IntegerType(), "string": T.StringType(), "date": T.DateType()}
TARGET_SCHEMA = T.StructType([T.StructField(c.name, SPARK_TYPES[c.type]) for c in TARGET_COLUMNS])


@dataclass(frozen=True)
class RuleInfo:
    """`columns` are those a violation concerns, `strategy` how it is remedied, `group_by` the raw
    columns whose distinct values count as one violation group (empty: every row counts)."""

    id: str
    name: str
    description: str
    columns: tuple[str, ...]
    strategy: str
    group_by: tuple[str, ...] = ()


# Ids, names, columns, strategies and group columns.
_REGISTRY = (
    RuleInfo(
        "V1",
        "Acquirer Name in Merchant Fields",
        "A merchant name field shows the acquirer's own name",
        ("DBAName", "LegalName", "BASEIIName"),
        "auto_fix",
    ),
    RuleInfo(
        "V2",
        "Street and City Same",
        "The street repeats the city, wholly or once digits and signs are left out",
        ("Street", "City"),
        "web_research",
    ),
    RuleInfo(
        "V3",
        "Same MID/CAID/DBA Multiple Addresses",
        "One merchant (same MID, CAID and DBA name) stands at several addresses",
        ("AcquirerMerchantID", "CAID", "DBAName", "Street", "City"),
        "manual_review",
        ("CAID", "AcquirerMerchantID", "DBAName"),
    ),
    RuleInfo(
        "V4",
        "Invalid Address",
        "The address is a post box, a placeholder or too short to be one",
        ("Street", "City"),
        "web_research",
    ),
    RuleInfo(
        "V5",
        "Invalid BASEIIName",
        "A sub-merchant's BASEIIName is missing or only repeats another name",
        ("BASEIIName", "AggregatorName"),
        "auto_fix",
    ),
    RuleInfo(
        "V6",
        "CIB/BID/BIN Copied",
        "Two of the numbers that identify processor and acquirer are equal",
        ("ProcessorBINCIB", "AcquirerBID", "AcquirerBIN"),
        "manual_review",
    ),
    RuleInfo(
        "V7",
        "Invalid CAID",
        "The CAID is missing, too short, too long or without a letter or digit",
        ("CAID",),
        "manual_review",
    ),
    RuleInfo(
        "V8",
        "Same Address Different MIDs",
        "Several MIDs share one address",
        ("Street", "City", "PostalCode", "AcquirerMerchantID"),
        "manual_review",
        ("Street", "City", "PostalCode"),
    ),
    RuleInfo(
        "V9",
        "Invalid Business Registration ID",
        "The tax id is a placeholder or too short",
        ("BusinessRegistrationID",),
        "web_research",
    ),
    RuleInfo(
        "V10",
        "Same MID/CAID Different Names",
        "One MID and CAID carry several DBA or legal names",
        ("AcquirerMerchantID", "CAID", "DBAName", "LegalName"),
        "web_research",
        ("CAID", "AcquirerMerchantID"),
    ),
    RuleInfo(
        "V11",
        "Different MIDs Same CAID",
        "One CAID is used with several MIDs",
        ("AcquirerMerchantID", "CAID"),
        "manual_review",
        ("CAID",),
    ),
    RuleInfo(
        "V12",
        "BASEIIName Copied to DBA/Legal",
        "BASEIIName is a copy of the DBA or legal name",
        ("BASEIIName", "DBAName", "LegalName"),
        "auto_fix",
    ),
    RuleInfo(
        "V13",
        "Sub-merchants Same Tax ID",
        "All rows of an aggregator share a single tax id",
        ("AggregatorID", "BusinessRegistrationID"),
        "manual_review",
        ("AggregatorID",),
    ),
)
RULES = {rule.id: rule for rule in _REGISTRY}

# Rules a reviewer has to switch on explicitly.
OFF_BY_DEFAULT = ("V5", "V11", "V12")
DEFAULT_STRATEGY = "manual_review"
