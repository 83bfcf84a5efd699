"""Reconciling sources: J3 and J4 code payloads, J6 cheque lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.masking import mask_account
from inkwell.functions.text import let, matched, rx, strip

TRUST_REASON = "QR payload is cryptographically/digitally signed or higher trust"


def reconcile_qr(ocr_fields: DataFrame, qr_fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merged fields (payload wins) and the rows that disagreed."""
    qr = qr_fields.filter(F.col("field") != "raw_qr").select("doc_id", "field", F.col("value").alias("qr_value"))
    both = ocr_fields.select("doc_id", "field", F.col("value").alias("ocr_value")).join(qr, ["doc_id", "field"], "full_outer")
    differ = F.upper(strip(F.col("ocr_value"))) != F.upper(strip(F.col("qr_value")))
    merged = both.select(
        "doc_id", "field",
        F.when(F.col("ocr_value").isNull() | F.coalesce(differ, F.lit(False)), F.col("qr_value"))
        .otherwise(F.col("ocr_value")).alias("value"),
        F.when(F.col("ocr_value").isNull(), "qr_only").when(F.col("qr_value").isNull(), "ocr_only")
        .when(differ, "qr_preferred").otherwise("agree").alias("resolution"),
    )
    disagreements = both.filter(differ).select(
        "doc_id", "field", "ocr_value", "qr_value", F.lit("qr_preferred").alias("resolution"), F.lit(TRUST_REASON).alias("reason")
    )
    return merged, disagreements


def parse_qr(payloads: DataFrame) -> DataFrame:
    """Fields of decoded payload texts, by document type."""
    p = F.col("payload")

    def attr(name: str, ignore_case: bool = True) -> Column:
        return strip(matched(p, rf'{name}="?([^"\n>]+)"?', ignore_case=ignore_case))

    gender = matched(p, r'gender="?([MFmf]|Male|Female)"?', ignore_case=True)
    by_type = {
        "aadhaar": [
            ("aadhaar_number", matched(p, r'uid="?(\d{12})"?')), ("name", attr("name")), ("dob", attr("dob")),
            ("gender", F.when(gender.isNotNull(), F.when(F.upper(gender).startswith("M"), "Male").otherwise("Female"))),
        ],
        "udyam": [("udyam_registration_number", F.upper(matched(p, r"UDYAM-[A-Z]{2}-\d{2}-\d{7}", 0, ignore_case=True)))],
        "fssai": [("fssai_licence_number", matched(p, r"\b(\d{14})\b"))],
    }

    def rows(entries: list[tuple[str, Column]]) -> Column:
        return F.array(*[F.struct(F.lit(n).alias("field"), v.alias("value")) for n, v in entries])

    raw = rows([("raw_qr", p)])
    found = F.lit(None).cast("array<struct<field:string,value:string>>")
    for doc_type, entries in by_type.items():
        found = F.when(F.col("doc_type") == doc_type, rows(entries)).otherwise(found)
    both = F.filter(F.coalesce(F.concat(raw, found), raw), lambda r: r["value"].isNotNull())
    return payloads.select("doc_id", "doc_type", F.explode(both).alias("_r")).select("doc_id", "doc_type", "_r.*")


# Shapes on the magnetic line.
_CHEQUE = r"(?:[c⑆|:\"']|\b)(\d{6})(?:[c⑆|:\"']|\b)"
_CODE = r"(?:[a⑈d⑇|\s:\"']|^)(\d{9})(?:[a⑈d⑇|\s:\"']|$)"
_TRAN = r"\b(\d{2})\b(?:\s*[\"']?)$"
_RUN = r"\b(\d{6,18})\b"


def parse_micr(texts: DataFrame, text: str = "text") -> DataFrame:
    """Cheque number, nine-digit code, account and trailing code of a line."""

    def digits_at(line: Column, pattern: str) -> Column:
        """1-based position of the digits inside the first match, 0 if none."""
        start = F.regexp_instr(line, F.lit(rx(pattern)))
        whole = F.regexp_extract(line, rx(pattern), 0)
        return F.when(start > 0, start + F.regexp_instr(whole, F.lit(r"\d")) - 1).otherwise(0)

    def blank(line: Column, at: Column, width: int) -> Column:
        return F.when(
            at > 0, F.concat(line.substr(F.lit(1), at - 1), F.repeat(F.lit(" "), F.lit(width)), line.substr(at + width, F.length(line)))
        ).otherwise(line)

    staged = texts.withColumn("micr_line", strip(F.replace(F.col(text), F.lit("\n"), F.lit(" "))))
    line = F.col("micr_line")
    staged = staged.withColumns({"_chq_at": digits_at(line, _CHEQUE), "_code_at": digits_at(line, _CODE)})
    # digits already explained are blanked, the first free run is the account
    free = blank(blank(line, F.col("_chq_at"), 6), F.col("_code_at"), 9)
    staged = staged.withColumn("_free", free)
    after = F.when(
        F.col("_code_at") > 0, matched(F.col("_free").substr(F.col("_code_at") + 9, F.length("_free")), _RUN)
    )
    staged = staged.withColumns({
        "cheque_number": matched(line, _CHEQUE), "micr_code": matched(line, _CODE), "tran_code": matched(line, _TRAN),
        "account_number": F.coalesce(after, matched(F.col("_free"), _RUN)),
    })
    chq, code, acc = (F.col(c).isNotNull() for c in ("cheque_number", "micr_code", "account_number"))
    nothing = ~chq & ~code
    level = F.when(chq & code & acc, "high").when(chq & code, "medium").otherwise("low")
    return staged.withColumns({
        "micr_line": F.when(~nothing, line),
        "tran_code": F.when(~nothing, F.col("tran_code")),
        "account_number": F.when(~nothing, F.col("account_number")),
        "account_number_masked": F.when(~nothing, mask_account(F.col("account_number"))),
        "micr_confidence": level,
        "micr_confidence_score": F.when(nothing, 0.0).when(level == "high", 0.95).when(level == "medium", 0.70).otherwise(0.30),
    }).drop("_chq_at", "_code_at", "_free")


def reconcile_micr(texts: DataFrame, fields: DataFrame, text: str = "text") -> DataFrame:
    """The magnetic line against the page's cheque and account number."""
    wanted = ["cheque_number", "account_number_masked"]
    page = fields.filter(F.col("field").isin(wanted)).groupBy("doc_id").agg(
        *[F.max(F.when(F.col("field") == n, F.col("value"))).alias(f"page_{n}") for n in wanted]
    )
    out = parse_micr(texts, text).join(page, "doc_id", "left")

    def tail(c: str) -> Column:
        d = F.regexp_replace(c, r"\D", "")
        return F.when(F.length(d) >= 4, F.right(d, F.lit(4)))

    chq = F.when(
        strip(F.col("cheque_number")) != strip(F.col("page_cheque_number")),
        F.concat(
            F.lit("Cheque number mismatch: MICR line has '"), F.col("cheque_number"), F.lit("', full-page text has '"),
            F.col("page_cheque_number"), F.lit("'"),
        ),
    )
    acc = F.when(
        tail("account_number") != tail("page_account_number_masked"),
        F.concat(
            F.lit("Account number mismatch: MICR line ends with '"), tail("account_number"), F.lit("', full-page text ends with '"),
            tail("page_account_number_masked"), F.lit("'"),
        ),
    )
    out = out.withColumn("micr_disagreements", F.array_compact(F.array(chq, acc)))
    return out.withColumn("micr_match", F.size("micr_disagreements") == 0)
