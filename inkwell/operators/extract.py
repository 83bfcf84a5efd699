"""E0 field extraction, P5 minimisation, A12 language coverage, W8, T4.

Rules are constants, so a document's candidates are one projection over its
text: only the branch of its own type is evaluated, and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from inkwell.functions.masking import mask_account, mask_address, mask_person, mask_uid
from inkwell.functions.patterns import match_sql, quote
from inkwell.functions.periods import YEAR_RANGE, financial_years, issue_date, valid_financial_year, years_before
from inkwell.functions.places import normalise_authority, normalise_place
from inkwell.functions.text import (
    ascii_digits, capitalise, clean_value, let, matched, non_empty_lines, rx, squeeze, strip,
)
from inkwell.rules import extraction as rules
from inkwell.rules.extraction import RULES, Rule
from inkwell.session import built_once, cut_lineage

NO_LINE_CONFIDENCE = 0.95
TEXT_LINE_CONFIDENCE = 0.96

_CANDIDATE = "struct<f:array<string>,mf:array<string>,mk:string,op:string,g:string,v:string,n:string,cf:double,cl:boolean>"
_OUTPUT = "array<struct<field:string,value:string,values:array<string>,needle:string,cf:double,cl:boolean>>"
_SOURCES = {"text": "_t", "digits": "_d", "upper": "_u", "unspaced": "_ns"}


def _strings(names: list[str]) -> str:
    return f"array({', '.join(quote(n) for n in names)})" if names else "CAST(array() AS ARRAY<STRING>)"


def _flags(rule: Rule) -> dict[str, bool]:
    return {"ignore_case": "i" in rule.flags, "multiline": "m" in rule.flags, "dotall": "s" in rule.flags}


def _unless(rule: Rule, siblings: list[Rule]) -> str | None:
    """Pattern whose presence switches the rule off."""
    first = {"no_dob": "dob", "no_employee_label": "employee_name"}.get(rule.guard)
    return next((r.pattern for r in siblings if r.field == first), None) if first else None


def _rule_sql(rule: Rule, siblings: list[Rule]) -> str:
    text = _SOURCES[rule.source]
    if rule.constant:
        value = f"CASE WHEN rlike({text}, {quote(rx(rule.pattern, **_flags(rule)))}) THEN {quote(rule.constant)} END"
    else:
        parts = [match_sql(text, rule.pattern, g, **_flags(rule)) for g in rule.groups]
        value = parts[0] if len(parts) == 1 else f"coalesce({', '.join(parts)})"
    off = _unless(rule, siblings)
    if off:
        value = f"CASE WHEN NOT rlike({text}, {quote(rx(off, ignore_case=True))}) THEN {value} END"
    return _candidate(
        [] if rule.drop else [rule.field, *rule.copies], value, rule.op, rule.guard,
        rule.masked[0].split(",") if rule.masked else [], rule.masked[1] if rule.masked else "", rule.confidence,
        match_sql(text, rule.line_pattern, 1, ignore_case=True) if rule.line_pattern else "CAST(NULL AS STRING)",
    )


def _candidate(fields: list[str], value: str, op: str = "clean", guard: str = "", masked: list[str] | None = None,
               mask: str = "", confidence: float | str | None = "line", needle: str = "CAST(NULL AS STRING)") -> str:
    fixed = f"CAST({confidence} AS DOUBLE)" if isinstance(confidence, float) else "CAST(NULL AS DOUBLE)"
    return (
        f"named_struct('f', {_strings(fields)}, 'mf', {_strings(masked or [])}, 'mk', {quote(mask)}, "
        f"'op', {quote(op)}, 'g', {quote(guard)}, 'v', {value}, 'n', {needle}, 'cf', {fixed}, 'cl', {str(confidence == 'line').lower()})"
    )


# ---------------------------------------------------------------- specials


def _first_of(pairs: list[tuple[str, str]], template: str) -> str:
    whens = " ".join(f"WHEN {template.format(p=p)} THEN {quote(v)}" for p, v in pairs)
    return f"CASE {whens} END"


def _shop_candidates() -> list[str]:
    def any_pattern(patterns: list[str]) -> str:
        return " OR ".join(f"rlike(_t, {quote(rx(p, ignore_case=True))})" for p in patterns)

    def by_state(value: str) -> str:
        return f"CASE _state {value} END"

    names = by_state(" ".join(f"WHEN '{c}' THEN {quote(n)}" for c, n, *_ in rules.STATE_TEMPLATES))
    issuers = by_state(" ".join(f"WHEN '{t[0]}' THEN {quote(t[3])}" for t in rules.STATE_TEMPLATES))
    verified = "CASE _state " + " ".join(f"WHEN '{t[0]}' THEN '{str(t[2]).lower()}'" for t in rules.STATE_TEMPLATES) + " ELSE 'false' END"
    numbers = by_state(
        " ".join(
            f"WHEN '{t[0]}' THEN coalesce({', '.join(match_sql('_t', p, 1, ignore_case=True) for p in t[5])})"
            for t in rules.STATE_TEMPLATES
        )
    )
    return [
        _candidate(["state"], "_state", confidence=0.98),
        _candidate(["state_name"], names, confidence=None),
        _candidate(["issuing_authority"], issuers, confidence=None),
        _candidate(["template_matched"], "IF(_state IS NULL, 'false', 'true')", confidence=1.0),
        _candidate(["template_verified"], verified, confidence=1.0),
        _candidate(["registration_number"], numbers),
        _candidate(["registration_number"], match_sql("_t", rules.SHOP_NUMBER, 1, ignore_case=True)),
    ]


def _state_sql() -> str:
    whens = " ".join(
        "WHEN " + " OR ".join(f"rlike(_t, {quote(rx(p, ignore_case=True))})" for p in t[4]) + f" THEN '{t[0]}'"
        for t in rules.STATE_TEMPLATES
    )
    return f"CASE WHEN doc_type <> 'shop_establishment' THEN NULL {whens} END"


# Statement period, account summary header and its columns.
_PERIOD = (
    r"(?:Transaction\s*Period|Statement\s*Period|Period)[\s:]*(?:\(\s*)?(?:From\s*[:]\s*)?([A-Za-z0-9\/\-\.]+)"
    r"\s*(?:to|-|To\s*[:])\s*([A-Za-z0-9\/\-\.]+)"
)
_SUMMARY = r"ACCOUNT\s*SUMMARY\s*\n\s*(.*?)\n\s*(.*?)(?:\n|$)"
_SUMMARY_COLUMNS = (
    r"\b(OPENING BALANCE|TOTAL WITHDRAWALS|WITHDRAWALS|TOTAL DEPOSITS|DEPOSITS|CLOSING BALANCE|"
    r"NO\. OF TRANSACTIONS|NO OF TRANSACTIONS)\b"
)


def summary_amount_sql(text: str, column: str) -> str:
    """Amount under one column of the account summary table."""
    summary = quote(rx(_SUMMARY, ignore_case=True))
    columns = f"regexp_extract_all(upper(regexp_extract({text}, {summary}, 1)), {quote(_SUMMARY_COLUMNS)}, 1)"
    amounts = f"regexp_extract_all(regexp_extract({text}, {summary}, 2), {quote(r'([0-9,]+[.]?[0-9]*)')}, 1)"
    return f"replace(get({amounts}, CAST(nullif(array_position({columns}, '{column}'), 0) AS INT) - 1), ',', '')"


def _statement_candidates() -> list[str]:
    start, end = match_sql("_t", _PERIOD, 1, ignore_case=True), match_sql("_t", _PERIOD, 2, ignore_case=True)
    banks = _first_of(rules.COMMON_BANKS, "contains(_u, '{p}')")
    return [
        _candidate(["bank_name"], banks, op="raw", confidence=0.95),
        _candidate(["statement_period"], f"IF({start} IS NULL, NULL, to_json(named_struct('from_date', {start}, 'to_date', {end})))",
                   op="raw", confidence=None),
        _candidate(["opening_balance"], summary_amount_sql("_t", "OPENING BALANCE"), confidence=None),
        _candidate(["closing_balance"], summary_amount_sql("_t", "CLOSING BALANCE")),
    ]


def _utility_candidates() -> list[str]:
    def present(words: str) -> str:
        return " OR ".join(f"contains(_du, {quote(w)})" for w in words.split("|"))

    whens = " ".join(f"WHEN {present(w)} THEN {quote(name)}" for w, name in rules.UTILITY_PROVIDERS)
    return [_candidate(["utility_provider"], f"CASE {whens} END", op="raw", confidence=None)]


_EXTRA = {
    "shop_establishment": _shop_candidates,
    "bank_statement": _statement_candidates,
    "utility_bill": _utility_candidates,
}


def _candidates_sql(extra_rules: dict[str, list[Rule]] | None) -> str:
    whens = []
    merged = {t: [*(extra_rules or {}).get(t, []), *RULES.get(t, [])] for t in {**RULES, **(extra_rules or {})}}
    for doc_type, type_rules in merged.items():
        parts = [_rule_sql(r, type_rules) for r in type_rules]
        parts += _EXTRA[doc_type]() if doc_type in _EXTRA else []
        whens.append(f"WHEN '{doc_type}' THEN array({', '.join(parts)})")
    return f"CASE doc_type {' '.join(whens)} END"


# ------------------------------------------------------------ value handling


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def _apply(op: Column, v: Column) -> Column:
    nothing = F.lit("")
    type_word = F.lower(F.regexp_extract(v, rx(rules._TYPE_WORDS, ignore_case=True), 1))
    act_word = F.lower(F.regexp_extract(v, rx(rules._ACT_WORDS, ignore_case=True), 1))
    first_line = strip(F.split(strip(v), "\n")[0])
    statement_prefix = rx(r"^(?:Statement\s+(?:of\s+)?|Account\s+Statement\s+(?:of\s+)?|Branch\s*Office\s*:?)\s*", ignore_case=True)
    passbook_tail = rx(r"\s*(?:SAVINGS\s+BANK\s+PASS\s*BOOK|PASS\s*BOOK|बचत\s*खाते\s*पासबुक|पासबुक).*", ignore_case=True)
    establishment_head = r"^[\s/]*(?:आ\s*(?:थापनेचे|स्थापनेचे)(?:\s*नाव)?|नाव)[\s:]*"
    employer_head = r"^[\s/]*(?:मालकाचे(?:\s*नाव)?|नाव)[\s:]*"

    def latin_part(c: Column) -> Column:
        return strip(F.split(strip(c), r"(?<=[a-zA-Z])\s+(?=[\u0900-\u097F])")[0])

    address = F.array_join(non_empty_lines(v), ", ")
    address = F.btrim(
        F.regexp_replace(address, rx(r"(?:,\s*|\s+)(?:6\.|Date\s*of\s*Liability).*$", ignore_case=True), ""), F.lit(" ,")
    )
    return (
        F.when(op.isin("clean", "raw"), v)
        .when(op == "date", F.translate(v, "-.", "//"))
        .when(op == "upper", F.upper(v))
        .when(op == "compact", F.regexp_replace(v, r"\s+", ""))
        .when(op == "compact_upper", F.upper(F.regexp_replace(v, r"\s+", "")))
        .when(op == "amount", F.replace(v, F.lit(","), nothing))
        .when(op == "amount_dot", F.rtrim(F.replace(v, F.lit(","), nothing), F.lit(".")))
        .when(op == "gender", F.coalesce(_lookup(rules.GENDERS, F.lower(v)), capitalise(v)))
        .when(op == "enterprise_type", _lookup(rules.ENTERPRISE_TYPES, type_word))
        .when(op == "activity", _lookup(rules.ACTIVITIES, act_word))
        .when(op == "integer", v.try_cast("int").cast("string"))
        .when(op == "digits", ascii_digits(v))
        .when(op == "squeeze", F.rtrim(strip(squeeze(v)), F.lit(",")))
        .when(op == "tilde", strip(F.regexp_replace(v, "~+", ", ")))
        .when(op == "address_lines", address)
        .when(op == "first_line", first_line)
        .when(op == "salary_line", F.ltrim(first_line, F.lit(",.")))
        .when(op == "bank_of_statement", F.regexp_replace(v, statement_prefix, ""))
        .when(op == "passbook_bank", strip(F.regexp_replace(F.split(strip(v), "\n")[0], passbook_tail, "")))
        .when(op == "establishment", latin_part(F.regexp_replace(v, establishment_head, "")))
        .when(op == "employer", latin_part(F.regexp_replace(v, employer_head, "")))
        .when(op == "issue_date", issue_date(v))
        .otherwise(v)
    )


def _label_norm(v: Column) -> Column:
    trimmed = F.btrim(F.regexp_replace(strip(v), r"^\d+[.)]\s*", ""), F.lit(" :,-"))
    return F.when(F.length(trimmed) >= 2, F.lower(strip(F.regexp_replace(trimmed, r"[^\p{L}\p{N}]+", " "))))


def _starts_with(norm: Column, prefixes: list[str]) -> Column:
    return norm.rlike("^(?:" + "|".join(p.replace(".", r"\.") for p in prefixes) + ")")


def valid_assessee(v: Column) -> Column:
    return let(
        _label_norm(v),
        lambda n: F.coalesce((n != "") & ~n.isin(rules.ITR_LABELS) & ~_starts_with(n, rules.ITR_PREFIXES), F.lit(False)),
    )


def valid_trade_name(v: Column) -> Column:
    label_only = "^(?:(?:" + "|".join(rules.TRADE_LABEL_WORDS) + ")(?: |$))+$"
    return let(
        _label_norm(v),
        lambda n: F.coalesce(
            (n != "") & ~n.isin(rules.TRADE_BLANKS) & ~n.rlike(label_only) & ~_starts_with(n, rules.TRADE_PREFIXES),
            F.lit(False),
        ),
    )


def _passes(guard: Column, v: Column) -> Column:
    verdict = F.when(guard == "itr_name", valid_assessee(v)).when(guard == "trade_name", valid_trade_name(v))
    for name, pattern in rules.REFUSE.items():
        verdict = verdict.when(guard == name, ~v.rlike(rx(pattern, ignore_case=True)))
    return F.coalesce(verdict, F.lit(True)) & (v != "")


def _masked(kind: Column, v: Column) -> Column:
    return (
        F.when(kind == "account", mask_account(v)).when(kind == "uid", mask_uid(v))
        .when(kind == "person", mask_person(v)).when(kind == "address", mask_address(v))
    )


def _outputs(c: Column) -> Column:
    """Long-form outputs of one accepted candidate."""
    has_mask = F.size(c["mf"]) > 0
    plain = F.transform(
        c["f"],
        lambda name: F.struct(
            name.alias("field"), c["value"].alias("value"), F.lit(None).cast("array<string>").alias("values"),
            c["needle"].alias("needle"), F.when(~has_mask, c["cf"]).alias("cf"), (c["cl"] & ~has_mask).alias("cl"),
        ),
    )
    hidden = F.transform(
        c["mf"],
        lambda name: F.struct(
            name.alias("field"), _masked(c["mk"], c["value"]).alias("value"),
            F.lit(None).cast("array<string>").alias("values"), c["needle"].alias("needle"), c["cf"].alias("cf"), c["cl"].alias("cl"),
        ),
    )
    return F.concat(plain, hidden)


def _output(field: str, value: Column, values: Column | None = None, needle: Column | None = None,
            fixed: float | None = None, line: bool = False) -> Column:
    return F.struct(
        F.lit(field).alias("field"), value.alias("value"),
        (values if values is not None else F.lit(None)).cast("array<string>").alias("values"),
        (needle if needle is not None else value).alias("needle"),
        F.lit(fixed).cast("double").alias("cf"), F.lit(line).alias("cl"),
    )


def _none() -> Column:
    return F.array().cast(_OUTPUT)


def plausible_name(line: Column) -> Column:
    """A line that could be a person's name on an unlabelled card."""
    words = F.filter(F.split(line, r"[\s.,:\-]+"), lambda w: w != "")
    compact = F.upper(F.regexp_replace(line, "[^A-Za-z]", ""))
    return (
        ~line.rlike(r"\d")
        & line.rlike(r"^[A-Za-z][A-Za-z\s.'-]{2,35}$")
        & ~compact.rlike("|".join(rules.STATUTORY_COMPACT))
        & F.size(words).between(1, 5)
        & ~F.arrays_overlap(F.transform(words, F.upper), F.array(*[F.lit(w) for w in rules.STATUTORY_WORDS]))
        & (F.length(clean_value(line)) >= 3)
        & ~clean_value(line).rlike(rx(rules.NOT_A_NAME, ignore_case=True))
    )


def _pan_positional(text: Column) -> Column:
    names = F.transform(F.filter(non_empty_lines(text), plausible_name), clean_value)
    return let(
        names,
        lambda n: F.array(
            _output("name", F.get(n, F.lit(0)), line=True), _output("father_name", F.get(n, F.lit(1)), line=True)
        ),
    )


def partner_names(text: Column) -> Column:
    """Distinct partner names in pattern-then-text order."""
    found = F.concat(
        *[F.regexp_extract_all(text, F.lit(rx(p, ignore_case=True)), F.lit(1)) for p in rules.PARTNER_PATTERNS]
    )
    cleaned = F.filter(
        F.transform(found, clean_value),
        lambda n: (F.length(n) > 2) & ~F.upper(n).rlike(r"^(?:PARTNERSHIP|DEED|FIRM|THE|PROFIT|CAPITAL)\b"),
    )
    return let(
        cleaned,
        lambda ns: F.filter(
            ns, lambda n, i: F.array_position(F.transform(ns, F.upper), F.upper(n)) == i + 1
        ),
    )


def _partners(text: Column) -> Column:
    def rows(names: Column) -> Column:
        masked = F.transform(names, mask_person)
        joined, hidden = F.array_join(names, ", "), F.array_join(masked, ", ")
        return F.when(
            F.size(names) > 0,
            F.array(
                _output("partner_names", joined, names, fixed=0.95), _output("raw_partner_names", joined, names, fixed=0.95),
                _output("partner_names_masked", hidden, masked, fixed=0.95),
            ),
        ).otherwise(_none())

    return let(partner_names(text), rows)


def _find(outputs: Column, field: str) -> Column:
    return F.get(F.filter(outputs, lambda o: o["field"] == field), F.lit(0))["value"]


def _passport_name(outputs: Column) -> Column:
    name = F.concat_ws(" ", _find(outputs, "given_name"), _find(outputs, "surname"))
    return F.when(_find(outputs, "given_name").isNotNull(), F.array(_output("name", name))).otherwise(_none())


# Income certificate patterns and stop words.
_INCOME_ROW = (
    r"\b([A-Za-z0-9०-९]\w{2,4}\s*[-/]\s*[A-Za-z0-9०-९]?\w{2,4})\b[ \t\n]*(?:Rs\.?|INR|रुपये)?\s*"
    r"([\d,]{4,10}(?:\.\d{2})?)[ \t]*([^\n\d]+)?"
)
_INCOME_BLOCK = (
    r"(?:उलनखालीलममाणे|खालीलप्रमाणे|खालील\s*माणे|वार्षिक\s*उत्पन्न)[^\n]*?\n(.*?)"
    r"(?=सदरचादाखला|सदरचा\s*दाखला|कारणासाठी|स्वाक्षरी|$)"
)
_NAME_STOPS = (
    r"[ \t,]*(?:या(?:ंना|ंस|ना|ंता|ंचे|ंचा|ंची|ंच्या|ंसाठी|स)|राहणार|रा\.|राहणारे|"
    r"तह्सील|तहसील|तालुका|ता\.|जिल्हा|िजल्हा|िजला|"
    r"शैक्षणिक|शीमिणक|शिक्षणासाठी|कारणासाठी|कारणासावी|कारणास्तव|कामासाठी|"
    r"देण्यात|देपयाता|येत\s*आहे|नाही|यांचा\s*मुलगा|यांची\s*मुलगी|$|\r?\n)"
)
_AMOUNT_WORDS = ["हजार", "लाख", "मात्र", "Only", "Thousand", "Lakh", "मान", "फक्त"]
_YEAR_TEXTS = [str(y) for y in range(2020, 2036)]


def _income_certificate(text: Column, digits: Column) -> Column:
    """Outputs of the one certificate type whose fields depend on each other."""

    def build(row: Column) -> Column:
        t, d, n, issued = row["t"], row["d"], row["n"], row["issued"]

        def plain(c: Column) -> Column:
            return F.replace(c, F.lit(","), F.lit(""))

        def not_year(c: Column) -> Column:
            return let(plain(c), lambda a: F.when(~a.isin(_YEAR_TEXTS), a))

        def big(found: Column) -> Column:
            return F.filter(
                F.transform(found, plain),
                lambda a: ~a.isin(_YEAR_TEXTS) & F.coalesce(a.try_cast("bigint") >= 5000, F.lit(False)),
            )

        row_re = F.lit(rx(_INCOME_ROW, ignore_case=True))
        row_amounts = F.regexp_extract_all(n, row_re, F.lit(2))
        row_words = strip(F.try_element_at(F.regexp_extract_all(n, row_re, F.lit(3)), F.lit(-1)))
        block = matched(n, _INCOME_BLOCK, dotall=True)
        income = F.coalesce(
            plain(F.try_element_at(row_amounts, F.lit(-1))),
            F.try_element_at(big(F.regexp_extract_all(block, F.lit(r"\b([\d,]{4,10})\b"), F.lit(1))), F.lit(-1)),
            not_year(matched(n, r"(?:Rs\.?|INR|रुपये|रु\.?)\s*([\d,]{4,10}(?:\.\d{2})?)", ignore_case=True)),
            not_year(
                matched(
                    n,
                    r"(?:Annual\s*Income|Total\s*Income|वार्षिक\s*उत्पन्न|एकूण\s*उत्पन्न)[^\n\d]{0,40}?(?:Rs\.?|INR|रुपये|रु\.?)?[\s:\.]*([\d,]{4,10}(?:\.\d{2})?)",
                    ignore_case=True,
                )
            ),
            F.get(big(F.regexp_extract_all(n, F.lit(r"\b([\d,]{4,10})\b"), F.lit(1))), F.lit(0)),
        )
        words = F.coalesce(
            F.when(row_words.rlike("|".join(_AMOUNT_WORDS)), row_words),
            strip(matched(t, r"(?:Rupees|रुपये|अक्षरी)[\s:]+([A-Za-z\u0900-\u097F\s]+?(?:Only|मात्र|मान|फक्त))\b", ignore_case=True)),
            strip(matched(t, r"([A-Za-z\u0900-\u097F\s]{2,30}?(?:हजार|लाख|Thousand|Lakh)[^\n]*?(?:मान|मात्र|फक्त|Only|\b))")),
        )
        years = F.coalesce(
            F.try_element_at(financial_years(d), F.lit(-1)),
            valid_financial_year(
                matched(d, r"(?:Financial\s*Year|Year|वर्ष|आर्थिक\s*वर्ष)[\s:]*" + YEAR_RANGE.strip(r"\b"), ignore_case=True)
            ),
            F.try_element_at(years_before(issued), F.lit(-1)),
            matched(t, r"([१२३४५0-9]\s*वर्षांसाठी|[१२३४५0-9]\s*वर्षासाठी)"),
        )
        number = F.coalesce(
            matched(
                t,
                r"(?:Certificate\s*(?:No\.?|Number)|Application\s*(?:No\.?|Number)|दाखला\s*(?:क्रमांक|क्र\.?|नं\.?)|प्रमाणपत्र\s*(?:क्रमांक|क्र\.?|नं\.?))[\s:]*([A-Za-z0-9\/-]{10,25})",
                ignore_case=True,
            ),
            matched(d, r"\b(\d{15,22})\b"),
        )
        english = strip(
            matched(
                t,
                r"(?:certify\s*that|Name\s*of\s*Applicant|Applicant\s*Name|Applicant)[\s:]*(?:Mr\.?|Mrs\.?|Ms\.?|Kumar|Kumari)?\s*([A-Za-z][A-Za-z\s\.\'-]{2,40}?)(?=[ \t]*(?:\r?\n|$|Address|Residing|Village|Taluka|District|Son|Daughter))",
                ignore_case=True,
            )
        )
        stop = f"(?={_NAME_STOPS})"
        marathi = strip(
            F.coalesce(
                matched(t, r"(?:यांचा\s*मुलगा|यांची\s*मुलगी|मुलगा|मुलगी|विनंतीवरून|विनंतीवरुन|दाखला)?\s*((?:कुमार|कुमारी)[A-Za-z\u0900-\u097F\s]{2,35}?)" + stop),
                matched(t, r"(?:यांचा\s*मुलगा|यांची\s*मुलगी|मुलगा|मुलगी)\s*((?:श्री\.?|श्रीमती|ञी\.?)[A-Za-z\u0900-\u097F\s]{2,35}?)" + stop),
                matched(
                    t,
                    r"(?:प्रमाणित\s*करण्यात\s*येते\s*की|अमािणतकरणयात|अमाणतकरणयात|दाखला\s*देण्यात\s*येतो\s*की)[^\n]*?(?:की[\.\s]*)?((?:श्री\.?|श्रीमती|कुमार|कुमारी|ञी\.?|शी\.)[A-Za-z\u0900-\u097F\s\.\'-]{2,35}?)" + stop,
                ),
            )
        )
        address = strip(
            matched(
                t,
                r"(?:राहणार\s*गाव|राहणार\s*मु\.|राहणार|रा\.|Residing\s*at|Village)[\s:]*([A-Za-z\u0900-\u097F\s,\.\'-]{2,50}?)"
                r"(?=[ \t,]*(?:तह्सील|तहसील|तहसिल|तालुका|ता\.|(?<=\s)ता(?=\s)|जिल्हा|िजल्हा|िजलहा|िजला|जि\.|Taluka|District|Tahsil|$|\n))",
                ignore_case=True,
            )
        )
        address = strip(F.regexp_replace(address, r"^(?:गाव|मु\.|मु|ग्राम)[\s:\.]*", ""))
        address = strip(F.regexp_replace(address, r"[\s,]+(?:तह्सील|तहसील|तालुका|जिल्हा|िजला).*$", ""))
        taluka = normalise_place(
            matched(
                t,
                r"(?:\b|(?<=[^A-Za-z\u0900-\u097F]))(?:तह्सील(?!दार)|तहसील(?!दार)|तहसिल(?!दार)|तालुका|ता\.|(?<=\s)ता(?=\s)|Taluka\b|Tahsil(?!dar)\b)[\s:\.]*([A-Za-z\u0900-\u097F]{2,20}?)(?=[ \t,]*(?:िजल्हा|जिल्हा|िजलहा|िजला|जि\.|District|,|$|\n))",
                ignore_case=True,
            )
        )
        district = normalise_place(
            matched(
                t,
                r"(?:\b|(?<=[^A-Za-z\u0900-\u097F]))(?:िजल्हा|जिल्हा|िजलहा|िजला|जि\.|District)[\s:\.]*([A-Za-z\u0900-\u097F]{2,20})",
                ignore_case=True,
            )
        )
        signer = r"(?:Digitally\s*signed\s*by[\s:]*([A-Za-z\s]+)|Tahsildar(?:[ \t]+([A-Za-z]+))?|Executive\s*Magistrate|Sub-Divisional\s*Officer)"
        authority = F.when(
            t.contains("तहसीलदार"), let(taluka, lambda place: normalise_authority(F.lit("तहसीलदार"), place))
        ).otherwise(
            F.regexp_replace(
                strip(F.coalesce(matched(t, signer, 1, ignore_case=True), matched(t, signer, 0, ignore_case=True))), r"[ \t]+", " "
            )
        )
        applicant = F.coalesce(F.nullif(english, F.lit("")), marathi)
        found = F.struct(
            number.alias("number"), income.alias("income"), words.alias("words"), years.alias("years"),
            applicant.alias("applicant"), F.when(F.nullif(english, F.lit("")).isNull(), marathi).alias("marathi"),
            address.alias("address"), taluka.alias("taluka"), district.alias("district"), authority.alias("authority"),
        )

        def rows(f: Column) -> Column:
            complete = f["number"].isNotNull() & f["applicant"].isNotNull() & f["income"].isNotNull()
            return F.array(
                _output("certificate_number", f["number"], line=True),
                _output("issue_date", issued, line=True),
                _output("annual_income", f["income"], line=True),
                _output("income_amount_words", f["words"]),
                _output("financial_year", f["years"], line=True),
                _output("applicant_name", f["applicant"], line=True),
                _output("applicant_name_marathi", f["marathi"]),
                _output("address", f["address"], line=True),
                _output("taluka", F.nullif(f["taluka"], F.lit("")), line=True),
                _output("district", F.nullif(f["district"], F.lit("")), line=True),
                _output("issuing_authority", F.nullif(f["authority"], F.lit("")), line=True),
                _output("document_type", F.lit("Income Certificate"), fixed=1.0),
                _output("needs_manual_review", F.when(complete, "false").otherwise("true")),
            )

        return let(found, rows)

    label = r"(?:Date(?:\s*of\s*Issue)?|Dated|दिनांक|तारीख)[\s:\.]*(\d{2,4}[-\/\.]\d{2}[-\/\.]\d{2,5})"
    any_date = r"\b(\d{2,4}[-\/\.]\d{2}[-\/\.]\d{2,5})\b"
    # the labelled date first, then every date in text order
    dates = F.concat(
        F.array(matched(digits, label, ignore_case=True)), F.regexp_extract_all(digits, F.lit(any_date), F.lit(1))
    )
    issued = F.get(F.array_compact(F.transform(dates, issue_date)), F.lit(0))
    misread = F.regexp_replace(digits, r"[yY][oO0]{1,2}[,.][oO0]{3}", "50,000")
    misread = F.regexp_replace(misread, r"[gG][oO0]{1,2}[,.][oO0]{3}", "40,000")
    row = F.struct(text.alias("t"), digits.alias("d"), misread.alias("n"), issued.alias("issued"))
    return F.transform(let(row, build), lambda o: o.withField("value", clean_value(o["value"])))


@built_once
def _value_columns() -> dict[str, Column]:
    """Columns that turn candidates into accepted, cleaned, scored fields."""

    def handled(c: Column) -> Column:
        value = F.when(c["op"] == "raw", c["v"]).otherwise(clean_value(_apply(c["op"], c["v"])))
        return c.withField("value", value)

    def with_needle(c: Column) -> Column:
        return c.withField("needle", F.coalesce(c["n"], F.when(c["op"] == "clean", c["value"]).otherwise(c["v"])))

    present = F.filter(F.col("_c"), lambda c: c["v"].isNotNull())
    accepted = F.filter(F.col("_v"), lambda c: F.coalesce(_passes(c["g"], c["value"]), F.lit(False)))
    more = (
        F.when(F.col("doc_type") == "pan", _pan_positional(F.col("_t")))
        .when(F.col("doc_type") == "partnership_deed", _partners(F.col("_t")))
        .when(F.col("doc_type") == "passport", _passport_name(F.col("_o")))
        .when(F.col("doc_type") == "income_certificate", _income_certificate(F.col("_t"), F.col("_d")))
        .otherwise(_none())
    )
    # first accepted value of a field wins
    first = F.filter(
        F.col("_o"),
        lambda o, i: F.array_position(F.transform(F.col("_o"), lambda x: x["field"]), o["field"]) == i + 1,
    )

    def scored(low: Column) -> Column:
        def confidence(o: Column) -> Column:
            seen = F.contains(low, F.lower(o["needle"])) & ~F.contains(o["needle"], F.lit("\n"))
            line = F.when(seen, TEXT_LINE_CONFIDENCE).otherwise(NO_LINE_CONFIDENCE)
            return o.withField("confidence", F.when(o["cl"], line).otherwise(o["cf"]))

        return F.transform(first, confidence)

    return {
        "values": F.transform(F.transform(present, handled), with_needle),
        "outputs": F.coalesce(F.flatten(F.transform(accepted, _outputs)), _none()),
        "complete": F.filter(F.concat("_o", more), lambda o: o["value"] != ""),
        "fields": let(F.lower("_t"), scored),
    }


def with_fields(docs: DataFrame, text: str = "full_text", extra_rules: dict[str, list[Rule]] | None = None) -> DataFrame:
    """Add ``fields``, the array of a document's extracted fields, to its row.

    ``docs`` carries doc_type and the text.  ``extra_rules`` go before the
    built-in rules of their type.
    """
    base = docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    base = base.withColumns({
        # spaced numbers and Devanagari digits matter to some types only
        "_d": F.when(
            F.col("doc_type").isin("aadhaar", "salary_slip", "utility_bill", "bank_passbook", "income_certificate"),
            ascii_digits(F.col("_t")),
        ),
        "_u": F.when(F.col("doc_type") == "bank_statement", F.upper("_t")),
        "_ns": F.when(F.col("doc_type") == "gst_certificate", F.regexp_replace("_t", r"[ \t]+", "")),
    }).withColumns({
        "_du": F.when(F.col("doc_type") == "utility_bill", F.upper("_d")),
        "_state": F.expr(_state_sql()),
    })
    base = base.withColumn("_c", F.expr(_candidates_sql(extra_rules)).cast(f"array<{_CANDIDATE}>"))

    made = _value_columns()
    base = base.withColumn("_v", made["values"]).withColumn("_o", made["outputs"])
    base = base.withColumn("_o", made["complete"])
    scratch = ["_t", "_d", "_u", "_ns", "_du", "_state", "_c", "_v", "_o"]
    return base.withColumn("fields", made["fields"]).drop(*scratch)


def _exploded(with_array: DataFrame, names: list[str]) -> DataFrame:
    # rebuilt inside the generator: pruning of nested columns would otherwise
    # push one copy of the whole extraction below it per kept column
    kept = F.transform("fields", lambda f: F.struct(*[f[n].alias(n) for n in names]))
    return with_array.select("doc_id", "doc_type", F.explode(kept).alias("_f")).select("doc_id", "doc_type", "_f.*")


def long_fields(with_array: DataFrame) -> DataFrame:
    """Long form of the ``fields`` column."""
    out = _exploded(with_array, ["field", "value", "values", "confidence"])
    return out.select("doc_id", "doc_type", "field", "value", "values", "confidence", F.lit("rule").alias("source"))


def extract_fields(docs: DataFrame, lines: DataFrame | None = None, text: str = "full_text",
                   extra_rules: dict[str, list[Rule]] | None = None) -> DataFrame:
    """Long-form fields of classified documents.

    ``lines`` (doc_id, page_num, line_no, text, confidence) gives line
    confidences; without it the text's own lines count as recognised at a
    fixed confidence.
    """
    wide = with_fields(docs.select("doc_id", "doc_type", text), text, extra_rules)
    if lines is None:
        return long_fields(wide)
    # the small field rows are used twice below; the texts are matched once
    out = cut_lineage(_exploded(wide, ["field", "value", "values", "needle", "cf", "cl"]))
    out = line_confidence(out, lines, only=F.col("cl"))
    out = out.withColumn("confidence", F.when(F.col("cl"), F.col("confidence")).otherwise(F.col("cf")))
    return out.select("doc_id", "doc_type", "field", "value", "values", "confidence", F.lit("rule").alias("source"))


def line_confidence(fields: DataFrame, lines: DataFrame, only: Column | None = None) -> DataFrame:
    """Confidence of the first line that contains the needle, else the default.

    Equi-join on the document, so a document with very many lines is split by
    the skew join; the minimum is pre-aggregated before the result shuffle.
    """
    wanted = fields.filter(only) if only is not None else fields
    hits = (
        wanted.select("doc_id", "field", F.lower("needle").alias("_n"))
        .join(lines.select("doc_id", "page_num", "line_no", F.lower("text").alias("_lt"), F.col("confidence").alias("_lc")), "doc_id")
        .filter(F.contains("_lt", F.col("_n")))
        .groupBy("doc_id", "field")
        .agg(F.min_by("_lc", F.struct("page_num", "line_no")).alias("_lc"))
    )
    out = fields.join(hits, ["doc_id", "field"], "left")
    return out.withColumn("confidence", F.coalesce(F.round("_lc", 4), F.lit(NO_LINE_CONFIDENCE))).drop("_lc")


def fill_rates(fields: DataFrame, docs: DataFrame) -> DataFrame:
    """Share of a type's documents that carry each field."""
    per_type = docs.groupBy("doc_type").agg(F.count("*").alias("docs"))
    filled = fields.groupBy("doc_type", "field").agg(F.count("*").alias("filled"))
    return filled.join(per_type, "doc_type").withColumn(
        "fill_rate", F.round(F.col("filled") / F.col("docs"), 4)
    )


def minimise_pii(fields: DataFrame) -> DataFrame:
    """P5: allow-listed fields of restricted types, no raw fields of the rest."""
    whens = " ".join(
        f"WHEN '{t}' THEN field IN ({', '.join(quote(f) for f in [*allowed, *rules.LANGUAGE_FIELDS])})"
        for t, allowed in rules.PII_ALLOWED.items()
    )
    rest = "NOT startswith(field, 'raw_') AND field <> 'partner_names'"
    return fields.filter(F.expr(f"CASE doc_type {whens} ELSE {rest} END"))


def language_coverage(docs: DataFrame, fields: DataFrame, text: str = "full_text") -> DataFrame:
    """Script flag and missing core fields per document."""
    core = F.create_map(
        *[x for t, names in rules.CORE_FIELDS.items() for x in (F.lit(t), F.array(*[F.lit(n) for n in names]))]
    )
    core_names = sorted({n for names in rules.CORE_FIELDS.values() for n in names})
    aliases = {n: n for n in core_names}
    aliases |= {f"raw_{n.removesuffix('_masked')}": n for n in core_names if n.endswith("_masked")}
    present = (
        fields.filter(F.col("field").isin(list(aliases)) & (F.col("value") != ""))
        # at most the core names: the set per document stays tiny
        .select("doc_id", _lookup(aliases, F.col("field")).alias("_name"))
        .groupBy("doc_id").agg(F.collect_set("_name").alias("_present"))
    )
    counted = docs.select("doc_id", "doc_type", F.regexp_count(F.col(text), F.lit("[\u0900-\u097F]")).alias("devanagari_chars"))
    out = counted.join(present, "doc_id", "left")
    has_script = F.col("devanagari_chars") >= 10
    missing = F.array_sort(F.array_except(core[F.col("doc_type")], F.coalesce("_present", F.array().cast("array<string>"))))
    out = out.withColumn("_missing", F.when(has_script, F.try_element_at(F.array(missing), F.lit(1))))
    gap = F.coalesce(F.size("_missing") > 0, F.lit(False))
    chars = F.col("devanagari_chars").cast("string")
    note = F.when(
        gap,
        F.concat(
            F.lit("Document contains Devanagari script text ("), chars,
            F.lit(" characters), but core field(s) could not be extracted: "), F.array_join("_missing", ", "),
            F.lit(". Manual review recommended."),
        ),
    ).when(
        F.col("_missing").isNotNull(),
        F.concat(F.lit("Devanagari script text detected ("), chars, F.lit(" characters); all core fields extracted successfully.")),
    )
    return out.select(
        "doc_id", "doc_type", "devanagari_chars",
        F.when(has_script, "en,devanagari").otherwise("en").alias("detected_languages"),
        gap.alias("partial_language_coverage"), gap.alias("language_review_required"), note.alias("language_coverage_notes"),
    )


def positional_names(lines: DataFrame) -> DataFrame:
    """First two plausible name lines of each document."""
    kept = lines.withColumn("_line", strip(F.col("text"))).filter(plausible_name(F.col("_line")))
    order = Window.partitionBy("doc_id").orderBy("page_num", "line_no")
    ranked = kept.withColumn("position", F.row_number().over(order)).filter("position <= 2")
    return ranked.select(
        "doc_id", "position", F.when(F.col("position") == 1, "name").otherwise("father_name").alias("field"),
        clean_value(F.col("_line")).alias("value"), F.round("confidence", 4).alias("confidence"),
    )


def financial_year_table(docs: DataFrame, text: str = "full_text", issued: str | None = None) -> DataFrame:
    """T4: valid years, the latest, and the years inferred when none is written."""
    years = docs.withColumn("_y", financial_years(ascii_digits(F.col(text))))
    inferred = years_before(F.col(issued)) if issued else F.lit(None).cast("array<string>")
    out = years.withColumn("_i", F.when(F.size("_y") == 0, inferred))
    return out.select(
        "doc_id", F.col("_y").alias("years"), F.coalesce(F.try_element_at("_y", F.lit(-1)), F.try_element_at("_i", F.lit(-1))).alias("latest"),
        (F.size("_y") == 0).alias("inferred"),
    )
