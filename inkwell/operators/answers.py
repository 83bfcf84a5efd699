"""Grounded answers: every user message is answered by the first rule that applies.

The rule is found from the message and its context alone, and written to the shared folder with the message; each rule's material (summary, key fields, mined dates and
amounts, looked-up values, lines) is then made only for the documents that some message asks it of, and joined once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import strip
from inkwell.operators import chat, mining, questions
from inkwell.rules import answers as say
from inkwell.rules.intents import INTENTS
from inkwell.rules.signatures import TYPE_METADATA
from inkwell.session import cut_lineage

_KEY = ["user_id", "document_id", "turn"]
_GUARDED = ["employee_name", "joining_date", "salary"]


def _literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _has_any(text: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in phrases])


def _filled(form: Column, value: Column) -> Column:
    """``form`` with its ``%s`` replaced; the value may hold any character."""
    return F.concat(F.substring_index(form, "%s", 1), value, F.substring_index(form, "%s", -1))


def _listed(rows: DataFrame, line: Column, order: list[str]) -> DataFrame:
    """The lines of each document in order, as one text.  Holds no more than one document's own finds."""
    got = rows.select("doc_id", F.struct(*order, line.alias("_line")).alias("_r")).groupBy("doc_id")
    return got.agg(F.array_join(F.transform(F.sort_array(F.collect_list("_r")), lambda r: r["_line"]), "\n").alias("listed"))


def _with_rules(messages: DataFrame, docs: DataFrame, facts: DataFrame) -> DataFrame:
    """User messages with their document's kind, guarded fields, intent and ``rule``."""
    rows = chat.followup_context(messages).join(docs, F.col("document_id") == F.col("doc_id"), "left").join(facts, "doc_id", "left")
    q, kind = F.lower(strip(F.coalesce("content", F.lit("")))), F.col("kind")
    follows = F.col("is_followup") & (F.col("last_answer").isNotNull() | F.col("last_question").isNotNull())
    asked = F.when(follows, F.coalesce("last_question", F.lit(""))).otherwise(F.coalesce("content", F.lit("")))
    rows = questions.detect_intents(rows.withColumns({"question": asked, "_follows": follows, "_q": F.lit(None).cast("string")}))
    employee = q.contains("employee") & q.contains("name")
    guards = [
        (employee & (F.col("employee_name").isNotNull() | ~F.lower(kind).contains("employment")), "employee_name"),
        ((q.contains("joining date") | q.contains("effective date")) & (F.col("joining_date").isNotNull() | kind.isin(say.NOT_EMPLOYMENT)), "joining_date"),
        (_has_any(q, say.SALARY_QUESTIONS) & (F.col("salary").isNotNull() | kind.isin(say.NOT_EMPLOYMENT)), "salary"),
    ]
    cases = [(_has_any(q, phrases), name) for name, phrases in say.ACTIONS] + [(F.col("_follows"), "follow_up")] + guards
    rule = F.when(F.col("intent").isNotNull(), "field").otherwise("search")
    for cond, name in reversed(cases):
        rule = F.when(cond, name).otherwise(rule)
    return rows.withColumn("rule", rule)


def answers(messages: DataFrame, docs: DataFrame, fields: DataFrame) -> DataFrame:
    """One row per user message: ``user_id``, ``document_id``, ``turn``, ``rule``, ``intent``, ``answer``.

    messages: user_id, document_id, turn, role, content.  docs: doc_id, doc_type, filename, full_text,
    verification_status, risk_score, signals (text; null: none known).  fields: doc_id, field, value.

    A message of a document that is not in ``docs`` is answered from nothing.  A follow-up without anything said
    before it is a message like any other.  Key fields beyond the preferred ones come by name.  Where no rule
    finds a field, lines of the document are searched; no remote model is asked.
    """
    kinds = _literal_map({t: name for t, (name, _) in TYPE_METADATA.items()})
    docs = docs.withColumn("kind", F.coalesce(F.try_element_at(kinds, F.col("doc_type")), F.col("doc_type")))
    facts = fields.filter(F.col("field").isin(_GUARDED)).groupBy("doc_id").agg(
        *[F.max(F.when(F.col("field") == n, F.col("value"))).alias(n) for n in _GUARDED]
    )
    rows = cut_lineage(_with_rules(messages, docs.drop("full_text"), facts))
    plain = docs.select("doc_id", "doc_type", "full_text")

    def asked(rule: str) -> DataFrame:
        return plain.join(rows.filter(F.col("rule") == rule).select("doc_id").distinct(), "doc_id", "left_semi")

    mark = F.concat(F.lit("• **"), F.col("label"), F.lit("**: "), F.col("value"), F.lit(" [Page 1]"))
    keys = asked("key_information")
    named = _listed(questions.key_fields(fields, keys.select("doc_id", "doc_type")), mark, ["rank", "field"])
    first = F.slice(F.filter(F.transform(F.split("full_text", "\n"), strip), lambda x: x != ""), 1, 4)
    lines = F.array_join(F.transform(first, lambda x: F.concat(F.lit("• "), x, F.lit(" [Page 1]"))), "\n")
    named = keys.join(named, "doc_id", "left").select("doc_id", F.lit("key_information").alias("rule"), F.coalesce("listed", lines).alias("listed"))
    day = F.concat(F.lit("**"), F.col("date_text"), F.lit("**"))
    dated = F.when(F.col("context").isNotNull(), F.concat(F.lit("• "), F.col("context"), F.lit(" — "), day, F.lit(" [Page 1]")))
    inside = F.when(F.col("line") != "", F.concat(F.lit(" ("), F.col("line"), F.lit(")"))).otherwise("")
    dated = F.coalesce(dated, F.concat(F.lit("• "), day, inside, F.lit(" [Page 1]")))
    money = F.concat(F.lit("• **"), F.col("amount_text"), F.lit("**"), inside, F.lit(" [Page 1]"))
    material = named.unionByName(
        _listed(mining.mine_dates(asked("dates")), dated, ["position"]).withColumn("rule", F.lit("dates"))
    ).unionByName(
        _listed(mining.mine_amounts(asked("amounts")), money, ["position"]).withColumn("rule", F.lit("amounts"))
    ).unionByName(
        questions.summaries(asked("summary"), fields).select("doc_id", F.lit("summary").alias("rule"), F.col("summary").alias("listed"))
    )
    wanted = rows.filter(F.col("rule").isin("field", "follow_up") & F.col("intent").isNotNull()).select("doc_id", "intent")
    values = questions.lookup_fields(wanted, fields, plain)
    searched = rows.filter("rule = 'search'").join(plain.select("doc_id", "full_text"), "doc_id").select(
        F.struct(*_KEY).alias("doc_id"), "full_text", "content"
    )
    hits = _listed(mining.line_search(searched, F.col("content")), F.concat(F.lit("- "), F.col("line")), ["position"])
    hits = hits.select("doc_id.*", F.col("listed").alias("hits"))
    full = rows.join(material, ["doc_id", "rule"], "left").join(values, ["doc_id", "intent"], "left").join(hits, _KEY, "left")
    return full.select(*_KEY, "rule", "intent", _answer().alias("answer"))


def _answer() -> Column:
    """The sentence of a row's rule."""
    listed, kind, value = F.col("listed"), F.col("kind"), F.col("value")
    file = F.coalesce("filename", F.lit("the document"))
    display = F.try_element_at(_literal_map({i.key: i.display for i in INTENTS}), F.col("intent"))
    signals = F.coalesce(F.nullif(F.col("signals"), F.lit("")), F.lit(say.REVIEW_DEFAULT))
    status = F.coalesce("verification_status", F.lit("verified"))
    genuine = (
        F.when((status == "review_required") | (F.coalesce("risk_score", F.lit(0)) >= 30), _filled(F.lit(say.REVIEW), signals))
        .when(status == "unsupported", say.UNSUPPORTED).otherwise(say.VERIFIED)
    )
    reply = F.lower(F.coalesce("last_answer", F.lit("")))
    lost = reply.contains("could not find")
    thing = F.regexp_extract(F.coalesce("last_answer", F.lit("")), r"(?i)could not find (?:an?|the)?\s*([^.]+?)\s*(?:in this document|because|\.)", 1)
    where = F.concat(F.lit(" directly from the verified "), display, F.lit(" section and structured content in this document."))
    why = (
        F.when(display.isNotNull() & (lost | reply.contains("not found") | reply.contains("could not confidently")), _filled(F.lit(say.SEARCHED), display))
        .when(display.isNotNull() & value.isNotNull(), F.concat(F.lit("I found the "), display, F.lit(" "), value, where))
        .when(display.isNotNull(), F.concat(F.lit("The "), display, F.lit(" was identified directly from the verified fields in this document.")))
        .when(lost, _filled(F.lit(say.SEARCHED), F.coalesce(F.nullif(thing, F.lit("")), F.lit("matching information"))))
        .otherwise(F.concat(F.lit("My previous answer was determined directly from the verified extracted fields and OCR text in this "), F.coalesce(kind, F.lit("Document")), F.lit(".")))
    )
    found = F.coalesce(F.try_element_at(_literal_map(say.FOUND), F.col("intent")), F.concat(F.lit("The "), display, F.lit(" is: **%s**.")))
    on_card = (F.col("intent") == "account_holder") & F.lower(kind).contains("pan")
    field = (
        F.when(F.col("source") == "prohibited", say.NOT_CONFIDENT)
        .when(value.isNotNull() & on_card, F.concat(F.lit("According to "), file, F.lit(", the individual named on this PAN card is: **"), value, F.lit("**.")))
        .when(value.isNotNull(), _filled(found, value))
        .otherwise(F.coalesce(F.try_element_at(_literal_map(say.MISSING), F.col("intent")), F.concat(F.lit("I could not find a "), display, F.lit(" in this document."))))
    )

    def guard(name: str, before: str, missing: str) -> Column:
        told = F.concat(F.lit("According to "), file, F.lit(f", {before}: **"), F.col(name), F.lit("**."))
        return F.coalesce(told, F.lit(missing))

    # kinds that never state a date of joining or a salary are refused even where a field says one
    never = F.coalesce(kind.isin(say.NOT_EMPLOYMENT), F.lit(False))
    no_date, no_salary = "I could not find a joining date in this document.", "I could not find salary information in this document."
    rule = F.col("rule")
    return (
        F.when(rule == "summary", F.when(listed.contains("[Page"), listed).otherwise(F.concat(F.coalesce(listed, F.lit("This document was analyzed and identified as a Document.")), F.lit(" [Page 1]"))))
        .when(rule == "authenticity", genuine)
        .when(rule == "key_information", F.concat_ws("\n", F.lit("Key Information Extracted from Document:"), F.concat(F.lit("**Document Type**: "), F.coalesce(kind, F.lit("Document")), F.lit(" [Page 1]")), F.nullif(listed, F.lit(""))))
        .when(rule == "dates", F.coalesce(F.concat(F.lit("Dates found in document:\n"), listed), F.lit(say.NO_DATES)))
        .when(rule == "amounts", F.coalesce(F.concat(F.lit("Numbers and financial figures found in document:\n"), listed), F.lit(say.NO_AMOUNTS)))
        .when(rule == "follow_up", why)
        .when(rule == "employee_name", guard("employee_name", "the employee named is", "I could not find an employee name in this document."))
        .when(rule == "joining_date", F.when(never, no_date).otherwise(guard("joining_date", "the effective/joining date is", no_date)))
        .when(rule == "salary", F.when(never, no_salary).otherwise(guard("salary", "the stated compensation is", no_salary)))
        .when(rule == "field", field)
        .otherwise(F.coalesce(F.concat(F.lit("Based on "), file, F.lit(":\n"), F.col("hits")), F.concat(F.lit("I could not find information regarding your query in "), file, F.lit("."))))
    )
