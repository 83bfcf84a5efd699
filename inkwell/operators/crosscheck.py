"""J1/J2 applicant cross-check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.dates import normalise_date
from inkwell.functions.similarity import with_similarity
from inkwell.functions.text import strip

# Match threshold and fields that may stand in for a key.
THRESHOLD = 0.82
_NAMES = [
    "name", "employee_name", "raw_employee_name", "account_holder", "account_holder_name", "given_name",
    "lessee_name", "lessor_name", "owner_name", "raw_partner_names", "partner_names", "partner_names_masked",
    "legal_name", "company_name", "firm_name", "employer_name", "entity_name",
]
_PARTNERS = ["raw_partner_names", "partner_names", "partner_names_masked", "partner_name"]
_BIRTH = ["dob", "date_of_birth"]
_IDENTIFIERS = [
    "pan_number", "raw_aadhaar", "aadhaar_number", "passport_number", "epic_number", "licence_number",
    "udyam_registration_number", "fssai_licence_number", "gstin", "cin", "iec_number", "property_id", "tan_number",
]
ALIASES: dict[str, list[str]] = {
    **{k: _NAMES for k in ("name", "full_name", "employee_name", "applicant_name")},
    **{k: _PARTNERS for k in ("partner_name", "partner_names", "partners")},
    **{k: _BIRTH for k in _BIRTH},
    **{k: _IDENTIFIERS for k in ("identifier", "id_number")},
}


def resolve(fields: DataFrame, expected: DataFrame) -> DataFrame:
    """The extracted value each expected key is compared with, if any.

    Keys fan out to their few candidate names; the join on (document, name)
    is an ordinary equi-join, and the best candidate is pre-aggregated.
    """
    names = F.create_map(*[x for k, v in ALIASES.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in v]))])
    candidates = F.concat(
        F.array(F.col("key")), F.coalesce(F.try_element_at(names, F.col("key")), F.array().cast("array<string>"))
    )
    wanted = expected.select("doc_id", "key", F.posexplode(candidates).alias("_rank", "_name"))
    # sizes are estimated before the fan-out: without the hint a broadcast might hold all wanted names in every executor
    found = wanted.hint("merge").join(
        fields.select("doc_id", F.col("field").alias("_name"), "value", "values"), ["doc_id", "_name"]
    )
    # a direct hit counts even when blank, a stand-in must say something
    usable = F.col("_rank").eqNullSafe(0) & (F.col("value").isNotNull() | F.col("values").isNotNull())
    usable = usable | (F.coalesce(F.col("value"), F.lit("")) != "") | (F.size("values") > 0)
    best = found.filter(usable).groupBy("doc_id", "key").agg(
        F.min_by(F.struct("value", "values"), "_rank").alias("_b")
    )
    return expected.join(best, ["doc_id", "key"], "left").select(
        expected["*"], F.col("_b.value").alias("extracted"), F.col("_b.values").alias("extracted_values"),
        F.col("_b").isNotNull().alias("found"),
    )


def cross_check_verdicts(fields: DataFrame, expected: DataFrame) -> DataFrame:
    """The verdicts of ``cross_check`` without scores: only pairs that bounds leave open are compared in Python."""
    return cross_check(fields, expected, scores=False)


def cross_check(fields: DataFrame, expected: DataFrame, scores: bool = True) -> DataFrame:
    """Verdict per (document, key).

    ``fields``: doc_id, field, value, values (NULL unless list-valued).
    ``expected``: doc_id, key, value, and optionally values.
    ``scores``: whether the exact scores are wanted too.
    """
    if "values" not in fields.columns:
        fields = fields.withColumn("values", F.lit(None).cast("array<string>"))
    exp = expected.withColumnRenamed("value", "expected").filter(
        "expected IS NOT NULL" + (" OR values IS NOT NULL" if "values" in expected.columns else "")
    )
    exp = exp.withColumn("expected", strip(F.col("expected"))).withColumn(
        "expected_values", F.col("values") if "values" in expected.columns else F.lit(None).cast("array<string>")
    )
    exp = exp.select("doc_id", "key", "expected", "expected_values")
    rows = resolve(fields, exp).withColumns({
        "extracted": strip(F.col("extracted")),
        "is_list": F.col("expected_values").isNotNull() | F.col("extracted_values").isNotNull(),
    })
    is_date = F.contains("key", F.lit("dob")) | F.contains("key", F.lit("date"))
    want, got = normalise_date(F.col("expected")), normalise_date(F.col("extracted"))
    rows = rows.withColumns({"_want": F.when(is_date, want), "_got": F.when(is_date, got)})
    dated = F.col("_want").isNotNull() & F.col("_got").isNotNull()

    # one similarity table serves single values and list items alike
    single = rows.withColumns({
        "_exp_items": F.when(F.col("is_list"), F.coalesce("expected_values", F.array("expected")))
        .when(F.col("found") & ~dated, F.array("expected")),
        "_ext_items": F.when(F.col("is_list"), F.coalesce("extracted_values", F.array("extracted")))
        .when(F.col("found") & ~dated, F.array("extracted")),
    })
    items = (
        single.filter("size(_exp_items) > 0 AND size(_ext_items) > 0")
        .select("doc_id", "key", F.posexplode("_exp_items").alias("_i", "_e"), "_ext_items")
        .select("doc_id", "key", "_i", strip(F.col("_e")).alias("_e"), F.posexplode("_ext_items").alias("_j", "_x"))
        .withColumn("_x", strip(F.col("_x")))
    )
    scored = with_similarity(items, "_x", "_e", "_s", None if scores else THRESHOLD)
    # best extracted item of each expected item, earlier one on a tie
    best = scored.groupBy("doc_id", "key", "_i").agg(
        F.max("_s").alias("_s"), F.max_by("_x", F.struct(F.col("_s"), -F.col("_j"))).alias("_x")
    )
    verdict = best.groupBy("doc_id", "key").agg(
        F.avg("_s").alias("_avg"), F.every(F.col("_s") >= THRESHOLD).alias("_all"), F.count("*").alias("_n"),
        F.min_by("_x", "_i").alias("_first"),
    )
    out = single.join(verdict, ["doc_id", "key"], "left")
    empty_list = F.col("found") & F.col("is_list") & F.col("_avg").isNull()
    joined_list = F.array_join("extracted_values", ", ")
    extracted = (
        F.when(~F.col("found"), F.lit(None))
        .when(dated, F.col("_got"))
        .when(F.col("is_list") & (F.col("_n") == 1) & F.col("_all"), F.col("_first"))
        .when(F.col("extracted_values").isNotNull(), joined_list)
        .otherwise(F.col("extracted"))
    )
    judged = out.select(
        "doc_id", "key",
        F.when(dated & F.col("found"), F.col("_want"))
        .when(F.col("expected_values").isNotNull(), F.array_join("expected_values", ", ")).otherwise(F.col("expected")).alias("expected"),
        extracted.alias("extracted"),
        F.when(~F.col("found") | empty_list, F.lit(False)).when(dated, F.col("_want") == F.col("_got")).otherwise(F.col("_all")).alias("matched"),
        F.when(~F.col("found") | empty_list, F.lit(0.0)).when(dated, (F.col("_want") == F.col("_got")).cast("double"))
        .otherwise(F.round("_avg", 4)).alias("score"),
        F.when(~F.col("found"), "field_not_found_in_document").when(empty_list, "empty_list_in_field").alias("reason"),
    )
    return judged if scores else judged.drop("score")
