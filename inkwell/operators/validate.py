"""A13 identifier validation and J14 dimension look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.identifiers import (
    cin_reason, gstin_reason, ifsc_bank, ifsc_reason, pan_reason, verhoeff_ok,
)
from inkwell.functions.places import normalise_authority, normalise_place
from inkwell.rules.signatures import TYPE_METADATA

# Registered bank prefixes.
BANK_CODES = [
    "SBIN", "HDFC", "ICIC", "UTIB", "PUNB", "BARB", "KKBK", "CNRB", "UBIN",
    "IOBA", "BKID", "IDIB", "CBIN", "MAHB", "PSIB", "UCOB", "INDB", "YESB",
    "IDFB", "BAND", "CSBK", "DCBL", "DLXB", "FDRL", "JSFB", "KVBL", "RBLN",
    "SIBL", "TMBL", "AUBL", "ESFB", "ESMF", "FINO", "NESF", "SURY", "UCBA",
    "AIRP", "IPOS", "PYTM", "JIOP", "KANG", "APBL", "AGCX", "ALLA", "ANDB",
    "BDBL", "CORP", "DBSX", "DEUT", "HSBC", "IBKL", "JAKA", "ORBC", "SCBL",
    "SYNB", "VIJB", "VIJY",
]

# The field each document type is checked on, and how.
TYPE_CHECKS: dict[str, tuple[str, str]] = {
    "pan": ("pan_number", "pan"),
    "aadhaar": ("raw_aadhaar", "aadhaar"),
    "cancelled_cheque": ("ifsc", "ifsc"),
    "bank_statement": ("ifsc", "ifsc"),
    "bank_passbook": ("ifsc", "ifsc"),
    "gst_certificate": ("gstin", "gstin"),
    "certificate_of_incorporation": ("cin", "cin"),
    "form_16": ("pan_number", "pan"),
    "iec_certificate": ("pan_number", "pan"),
}


def _reason(kind: Column, value: Column, bank_known: Column) -> Column:
    return (
        F.when(kind == "aadhaar", F.when(~verhoeff_ok(value), "invalid_aadhaar_checksum"))
        .when(kind == "pan", pan_reason(value))
        .when(kind == "ifsc", ifsc_reason(value, bank_known))
        .when(kind == "gstin", gstin_reason(value))
        .when(kind == "cin", cin_reason(value))
    )


def validate_identifiers(df: DataFrame, bank_codes: DataFrame | None = None, kind: str = "kind", value: str = "value") -> DataFrame:
    """Add ``valid`` and ``reason`` to (kind, value) rows.

    ``bank_codes`` (one column ``code``) replaces the built-in registry; it is
    joined, and the optimizer broadcasts it while it is small.
    """
    if bank_codes is None:
        known, rows = ifsc_bank(F.col(value)).isin(BANK_CODES), df
    else:
        codes = bank_codes.select(F.col("code").alias("_bank")).distinct().withColumn("_known", F.lit(True))
        rows = df.withColumn("_bank", F.when(F.col(kind) == "ifsc", ifsc_bank(F.col(value)))).join(codes, "_bank", "left")
        known = F.coalesce("_known", F.lit(False))
    out = rows.withColumn("reason", _reason(F.col(kind), F.col(value), known))
    out = out.withColumn("valid", F.col("reason").isNull())
    return out.drop("_bank", "_known")


def load_bank_codes(spark: SparkSession, path: str) -> DataFrame:
    """Registry from a JSON array of codes; an empty registry is an error."""
    raw = spark.read.text(path, wholetext=True)
    codes = raw.select(F.explode(F.from_json("value", "array<string>")).alias("code"))
    if codes.isEmpty():
        raise ValueError(f"{path} holds no bank codes")
    return codes


def validate_documents(fields: DataFrame, bank_codes: DataFrame | None = None) -> DataFrame:
    """Per document: the check of its type, and the reason if it failed."""
    wanted = F.create_map(*[F.lit(x) for t, (f, _) in TYPE_CHECKS.items() for x in (t, f)])
    how = F.create_map(*[F.lit(x) for t, (_, k) in TYPE_CHECKS.items() for x in (t, k)])
    # the raw number is preferred, the plain one stands in when it is absent
    stand_in = (F.col("doc_type") == "aadhaar") & (F.col("field") == "aadhaar_number")
    checked = fields.filter((F.try_element_at(wanted, F.col("doc_type")) == F.col("field")) | stand_in)
    picked = checked.groupBy("doc_id", "doc_type").agg(F.max_by("value", F.col("field") == "raw_aadhaar").alias("value"))
    digits = F.regexp_replace("value", r"\D", "")
    rows = picked.withColumn(
        "kind",
        F.when((F.col("doc_type") == "aadhaar") & (F.length(digits) != 12), F.lit(None)).otherwise(
            F.try_element_at(how, F.col("doc_type"))
        ),
    )
    out = validate_identifiers(rows, bank_codes)
    return out.select("doc_id", "doc_type", "kind", F.col("valid").alias("checksum_valid"), F.col("reason").alias("checksum_reason"))


def pass_rates(validated: DataFrame, by: list[str]) -> DataFrame:
    return validated.groupBy(*by).agg(
        F.count("*").alias("checked"), F.count_if("valid").alias("passed"),
        F.round(F.count_if("valid") / F.count("*"), 4).alias("pass_rate"),
    )


def with_type_metadata(df: DataFrame) -> DataFrame:
    """Display title and issuer; constants, so no join is needed."""
    title = F.create_map(*[F.lit(x) for t, (n, _) in TYPE_METADATA.items() for x in (t, n)])
    issuer = F.create_map(*[F.lit(x) for t, (_, i) in TYPE_METADATA.items() for x in (t, i)])
    fallback = F.initcap(F.replace("doc_type", F.lit("_"), F.lit(" ")))
    return df.withColumns({
        "document_type": F.coalesce(F.try_element_at(title, F.col("doc_type")), fallback),
        "issuer": F.try_element_at(issuer, F.col("doc_type")),
    })


def normalise_places(df: DataFrame, cols: list[str], authority: str | None = None, taluka: str | None = None) -> DataFrame:
    """Spelling repair of place columns, and of the issuing authority."""
    out = df.withColumns({c: normalise_place(F.col(c)) for c in cols})
    if authority:
        place = F.col(taluka) if taluka else F.lit(None).cast("string")
        out = out.withColumn(authority, normalise_authority(F.col(authority), place))
    return out
