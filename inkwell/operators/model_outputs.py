"""P13 normalisation of raw model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import let, rx, strip
from inkwell.operators.classify import with_classification

_MAP = "map<string,string>"
_LEVELS = ["high", "medium", "low"]

# Texts that stand in for missing parts.
NO_TYPE = "Unknown Document"
UNKNOWN_EVIDENCE = [
    "No standard institutional headings or classification markers recognized",
    "Visible text lacks defining structural fields of supported document classes",
]
UNKNOWN_SUMMARY = (
    "This document could not be reliably classified into a recognized document type based on its visible content."
)


def json_block(raw: Column) -> Column:
    """The JSON part of an answer: fenced block, else outermost braces."""
    t = strip(F.coalesce(raw, F.lit("")))
    fence = rx(r"```(?:json)?\s*([\s\S]*?)\s*```", ignore_case=True)

    def cut(text: Column) -> Column:
        first = F.instr(text, "{")
        last = F.length(text) - F.instr(F.reverse(text), "}") + 1
        braces = (first > 0) & F.contains(text, F.lit("}")) & (last > first)
        return (
            F.when(text.rlike(fence), strip(F.regexp_extract(text, fence, 1)))
            .when(braces, text.substr(first, last - first + 1))
            .otherwise(text)
        )

    return let(t, cut)


def last_wins(entries: Column) -> Column:
    """Map of (k, v) entries; a repeated key keeps its last value."""
    later_has = lambda e, i: F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["k"] == e["k"])
    return F.map_from_entries(F.filter(entries, lambda e, i: ~later_has(e, i)))


def _object(text: Column) -> Column:
    """A JSON object as a map; a repeated key keeps its last value."""
    entries = F.map_entries(F.from_json(text, _MAP))
    return last_wins(F.transform(entries, lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"))))


def fold_pairs(fields: Column) -> Column:
    """``field_name_i`` / ``field_value_i`` pairs folded into one map."""
    keys = F.map_keys(fields)
    paired = F.exists(keys, lambda k: k.startswith("field_name_"))
    # pairs count up from 1 without a gap
    numbers = F.sequence(F.lit(1), F.greatest(F.size(keys), F.lit(1)))
    names = F.transform(numbers, lambda i: F.try_element_at(fields, F.concat(F.lit("field_name_"), i.cast("string"))))
    gap = F.array_position(F.transform(names, lambda n: n.isNull()), True)
    count = F.when(gap == 0, F.size(names)).otherwise(gap - 1).cast("int")
    entries = F.transform(
        F.slice(numbers, 1, F.greatest(count, F.lit(0))),
        lambda i: F.struct(
            strip(F.try_element_at(fields, F.concat(F.lit("field_name_"), i.cast("string")))).alias("k"),
            F.coalesce(F.try_element_at(fields, F.concat(F.lit("field_value_"), i.cast("string"))), F.lit("")).alias("v"),
        ),
    )
    named = F.filter(entries, lambda e: e["k"] != "")

    folded = let(named, last_wins)
    stripped = F.transform(F.map_entries(fields), lambda e: F.struct(strip(e["key"]).alias("k"), e["value"].alias("v")))
    trimmed = let(stripped, last_wins)
    return F.when(paired & (F.size(named) > 0), folded).otherwise(trimmed)


def normalise_model_outputs(raw: DataFrame, docs: DataFrame, rule_fields: DataFrame) -> DataFrame:
    """Canonical analysis per model answer.

    ``raw``: doc_id, raw.  ``docs``: doc_id, full_text.  ``rule_fields``: long
    form; a non-empty rule value wins over the model's.
    """
    answers = raw.select("doc_id", _object(json_block(F.col("raw"))).alias("_m"))
    part = lambda name: F.try_element_at(F.col("_m"), F.lit(name))
    staged = answers.join(docs.select("doc_id", "full_text"), "doc_id", "left").withColumns({
        "_summary": strip(F.coalesce(part("summary"), F.lit(""))),
        "_type": strip(F.coalesce(part("document_type"), F.lit(""))),
        "_conf": F.lower(strip(part("confidence"))),
        "_evidence": F.coalesce(
            F.from_json(F.coalesce(part("evidence"), part("reasoning")), "array<string>"),
            F.when(F.coalesce(part("evidence"), part("reasoning")).startswith("[") == F.lit(False),
                   F.array(F.coalesce(part("evidence"), part("reasoning")))),
        ),
        "_model_fields": _object(part("extracted_fields")),
    }).withColumn("_text", strip(F.concat(F.coalesce("full_text", F.lit("")), F.lit("\n"), F.col("_summary"))))
    staged = with_classification(staged, 0, "_text").withColumnsRenamed({
        "doc_type": "_dt", "document_type": "_title", "confidence": "_score", "confidence_level": "_level", "evidence": "_ev",
    })
    known = F.col("_dt") != "unknown"
    number = F.col("_conf").try_cast("double")
    worded = F.col("_conf").isin(_LEVELS)
    plain = F.col("_type")
    own_type = F.when(
        (plain == "") | F.lower(plain).contains("unknown") | (F.length(plain) > 35), NO_TYPE
    ).otherwise(F.initcap(plain))
    staged = staged.withColumn("document_type", F.when(known, F.col("_title")).otherwise(own_type))
    unknown = F.col("document_type") == NO_TYPE
    level = (
        F.when(known, F.when(worded, F.col("_conf")).otherwise(F.coalesce("_level", F.lit("high"))))
        .when(number.isNotNull(), F.when(number >= 0.85, "high").when(number >= 0.60, "medium").otherwise("low"))
        .when(worded, F.col("_conf"))
        .otherwise(F.when(unknown, "low").otherwise("medium"))
    )
    score = (
        F.when(known, F.col("_score")).when(number.isNotNull(), number)
        .when(worded, F.when(F.col("_conf") == "high", 0.95).when(F.col("_conf") == "medium", 0.80).otherwise(0.50))
        .when(~unknown, F.lit(0.70))
    )
    given = F.when(known, F.col("_ev")).otherwise(F.col("_evidence"))
    stand_in = F.when(unknown, F.array(*[F.lit(t) for t in UNKNOWN_EVIDENCE])).otherwise(
        F.array(
            F.concat(F.lit("Document structure matches "), F.col("document_type")),
            F.lit("Contains verified text tokens and layout features"),
        )
    )
    head = staged.select(
        "doc_id", "document_type", level.alias("confidence"), score.alias("confidence_score"),
        F.when(F.length("_summary") >= 10, F.col("_summary"))
        .when(unknown, UNKNOWN_SUMMARY)
        .otherwise(F.concat(F.lit("This document was analyzed and identified as a "), F.col("document_type"), F.lit("."))).alias("summary"),
        F.when(F.size(given) > 0, given).otherwise(stand_in).alias("evidence"),
        fold_pairs(F.coalesce("_model_fields", F.expr("CAST(map() AS MAP<STRING,STRING>)"))).alias("_model"),
    )
    # a document has few rule fields; of several values of one field the greatest is taken
    single = rule_fields.filter("value <> ''").groupBy("doc_id", "field").agg(F.max("value").alias("value"))
    rules = single.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_rules"))
    joined = head.join(rules, "doc_id", "left").withColumn(
        "_rules", F.coalesce("_rules", F.expr("CAST(map() AS MAP<STRING,STRING>)"))
    )
    useful = F.map_filter(
        F.col("_model"),
        lambda k, v: (strip(v) != "") & (F.lower(strip(v)) != "none") & ~F.map_contains_key(F.col("_rules"), k),
    )
    return joined.withColumn("extracted_fields", F.map_concat("_rules", useful)).drop("_rules", "_model")
