"""Personal data replaced by keyed surrogates of the same type, gender, script and format.

Detection finds e-mail addresses, phone numbers, IPv4 addresses, payment cards, IBANs, US social security
numbers and names after a form of address.  Every entity has a canonical value (digits of a number, lower-case
letters of a name), and its surrogate is made from a keyed digest of kind and canonical value alone, so all
mentions in all documents agree (coreference) and no table of replacements is needed in the texts' way.

Distinctness is checked on the table of distinct entities: a surrogate that two entities share, or that is
itself an entity of the corpus, is drawn again for all but one.  Only entities that had to draw again are
looked up when texts are rewritten; there are few, as surrogates come from large sets.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from inkwell.llm.common import free_name, written

#: Redrawn entities that are sent to the tasks whole; beyond that, they are joined to the texts that hold them.
SENT_WHOLE = 200_000
#: Draws of one entity before it counts as an error (the sets widen with each draw).
DRAWS = 64

_UP = r"[^\W\d_a-zß-öø-ÿа-яёα-ω]"
_NAME = rf"{_UP}[^\W\d_]+(?:[-'’]{_UP}[^\W\d_]+)?"
#: Forms of address by the gender they tell.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Signora", "Госпожа", "г-жа", "Κυρία"),
    "m": ("Mr", "Mister", "Herr", "Herrn", "Monsieur", "Señor", "Signor", "Господин", "г-н", "Κύριος"),
    "x": ("Dr", "Prof", "Professor"),
}
_GENDER = {t: g for g, titles in TITLES.items() for t in titles}
_PERSON = re.compile(
    rf"\b(?P<title>{'|'.join(sorted(map(re.escape, _GENDER), key=len, reverse=True))})\b\.?[  ]+(?P<name>{_NAME}(?:[  ]{_NAME}){{0,2}})"
)
#: What may not stand around a number: letters, or digits that go on after a point or hyphen.
_BEFORE, _AFTER = r"(?<![\w+])(?<!\d[.-])", r"(?!\w|[.-]\d)"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_PATTERNS = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![A-Za-z0-9-])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?= ?[A-Z0-9])")),  # where one may start, see _ibans
    ("card", re.compile(r"\d(?:[ -]?\d){12,}")),  # a run that may hold some, see _cards
    ("ssn", re.compile(rf"{_BEFORE}\d{{3}}-\d{{2}}-\d{{4}}{_AFTER}")),
    ("phone", re.compile(
        rf"{_BEFORE}(?:\+?1[ .-]?)?\(\d{{3}}\)[ .-]?\d{{3}}[ .-]?\d{{4}}{_AFTER}"
        rf"|{_BEFORE}(?:\+?1[ .-])?\d{{3}}[.-]\d{{3}}[.-]\d{{4}}{_AFTER}"
        rf"|{_BEFORE}\+\d{{1,3}}(?:[ .-]?\(?\d{{1,4}}\)?){{2,6}}{_AFTER}"
    )),
    ("ip", re.compile(rf"(?<!\w)(?<!\d\.){_OCTET}(?:\.{_OCTET}){{3}}(?![\w]|\.\d)")),
)
_DIGITS = re.compile(r"[0-9@]")
_GROUP = re.compile(r"\d+")
_CARD_END = re.compile(r"(?!\w|\.\d)")
_IBAN_RUN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}")
#: Lengths of the countries' IBANs.
_IBAN_LENGTHS = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}


@dataclass(frozen=True)
class Mention:
    start: int
    end: int
    kind: str
    value: str


def _luhn(digits: str) -> bool:
    doubled = (int(d) * 2 if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def _mod97(value: str) -> int:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _script(word: str) -> str:
    """First word of the Unicode name of the first letter: LATIN, CYRILLIC, GREEK, ..."""
    return unicodedata.name(next((c for c in word if c.isalpha()), "a"), "LATIN").split(" ")[0]


def _canonical(kind: str, text: str) -> str | None:
    """Canonical value of a match, or None where it is not of that kind."""
    if kind == "email":
        return text.lower()
    if kind == "ip":
        return ".".join(str(int(o)) for o in text.split("."))
    if kind == "iban":
        value = text.replace(" ", "")
        fits = len(value) == _IBAN_LENGTHS.get(value[:2], len(value)) and 15 <= len(value) <= 34
        return value if fits and _mod97(value) == 1 else None
    value = _digits(text)
    if kind == "card":
        return value if 13 <= len(value) <= 19 and _luhn(value) and len(set(value)) > 1 else None
    if kind == "phone":
        if text.lstrip().startswith("+"):
            return "+" + value if 8 <= len(value) <= 15 else None
        return "+" + (value if len(value) == 11 else "1" + value)
    return value


def _cards(text: str, run: re.Match, taken: set[int]) -> Iterator[tuple[int, int]]:
    """Cards in a run of digit groups: from the left, the longest row of whole groups with a right check digit."""
    groups = [g.span() for g in _GROUP.finditer(text, *run.span())]
    first = run.start()
    before = text[max(0, first - 2):first]
    apart = not before or not (before[-1] == "+" or before[-1] == "_" or before[-1].isalnum())
    apart = apart and not (len(before) == 2 and before[0].isdigit() and before[1] == ".")
    at = 0 if apart else 1
    while at < len(groups):
        ends, n = [], 0
        for last in range(at, len(groups)):
            n += groups[last][1] - groups[last][0]
            if n > 19:
                break
            if n >= 13:
                ends.append(last)
        start = groups[at][0]
        for last in reversed(ends):
            end = groups[last][1]
            whole = last + 1 < len(groups) or _CARD_END.match(text, end)
            if whole and start not in taken and end - 1 not in taken and _canonical("card", text[start:end]):
                yield start, end
                at = last
                break
        at += 1


def _ibans(text: str, start: re.Match) -> Iterator[tuple[int, int]]:
    """The IBAN that begins at a place: of the country's length, or the longest one that passes for other countries."""
    run = _IBAN_RUN.match(text, start.start())
    if not run:
        return
    for end in range(run.end(), run.start() + 14, -1):
        if text[end - 1] != " " and not (end < len(text) and text[end].isascii() and text[end].isalnum()):
            if _canonical("iban", text[run.start():end]):
                yield run.start(), end
                return


def _spans(text: str, kind: str, pattern: re.Pattern, taken: set[int]) -> Iterator[tuple[int, int]]:
    for m in pattern.finditer(text):
        if kind == "card":
            yield from _cards(text, m, taken)
        elif kind == "iban":
            yield from _ibans(text, m)
        else:
            yield m.span()


def mentions(text: str | None) -> list[Mention]:
    """Personal data in a text, left to right, not overlapping; ``end`` is exclusive, in code points."""
    found: list[Mention] = []
    if not text:
        return found
    taken: set[int] = set()
    if _DIGITS.search(text):
        for kind, pattern in _PATTERNS:
            if kind == "email" and "@" not in text:
                continue
            for start, end in _spans(text, kind, pattern, taken):
                value = _canonical(kind, text[start:end])
                if value and start not in taken and end - 1 not in taken:
                    taken.update(range(start, end))
                    found.append(Mention(start, end, kind, value))
    found += _names(text, taken)
    return sorted(found, key=lambda m: m.start)


def _names(text: str, taken: set[int]) -> list[Mention]:
    """Names after a form of address, and the same names elsewhere in the text."""
    roles: dict[str, str] = {}
    first = _PERSON.search(text)
    if not first:
        return []
    for m in _PERSON.finditer(text, first.start()):
        words = re.split("[  ]", m["name"])
        gender = _GENDER[m["title"]]
        for word in words[:-1]:
            if roles.get(word, "given-x") == "given-x":
                roles[word] = f"given-{gender}"
        family = "f" if _script(words[-1]) == "CYRILLIC" and words[-1][-1] in "аяАЯ" else "x"
        roles.setdefault(words[-1], f"family-{family}")
    names = sorted(roles, key=len, reverse=True)
    titles = {*_GENDER}
    again = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, names))})(?!\w)")
    return [
        Mention(m.start(), m.end(), f"{roles[m.group()]}-{_script(m.group()).lower()}", m.group().casefold())
        for m in again.finditer(text)
        if m.start() not in taken and m.group() not in titles
    ]


class Draw:
    """A stream of numbers from the key, the kind, the value and the number of the draw."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int):
        self.seed = f"{kind}\x00{value}\x00{attempt}".encode("utf-8", "surrogatepass")
        self.key, self.block, self.left = hashlib.sha256(key).digest(), 0, 0

    def below(self, n: int) -> int:
        if self.left < 1 << 64:
            made = hashlib.blake2b(self.seed + self.block.to_bytes(4, "big"), key=self.key, digest_size=64)
            self.left, self.block = int.from_bytes(made.digest(), "big"), self.block + 1
        self.left, x = divmod(self.left, n)
        return x

    def digits(self, n: int) -> str:
        return "".join(str(self.below(10)) for _ in range(n))


#: Syllables and endings of made-up names by script: (syllables, female end, male end, family end).
_SYLLABLES = {
    "latin": ("ba be bi bo da de di do fa fe fi ga ge ka ke ki la le li lo ma me mi mo na ne ni no ra re ri ro sa se si ta te ti to va ve vi".split(), "a", "n", "ler"),
    "cyrillic": ("ба бе бо ва ве ви да де ди до за зо ка ко ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се си та те ти то".split(), "а", "н", "ов"),
    "greek": ("βα βε γα γε δα δε δι κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο ρα ρε ρι ρο σα σε σι τα τε τι το".split(), "α", "ς", "ου"),
}


def surrogate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """Canonical value of the surrogate of an entity, at a number of draws already lost."""
    draw = Draw(key, kind, value, attempt)
    if kind == "email":
        local = value.rpartition("@")[0]
        made = "".join(
            "abcdefghijklmnopqrstuvwxyz"[draw.below(26)] if c.isalpha() else str(draw.below(10)) if c.isdigit() else c
            for c in local
        )
        site = Draw(key, "site", value.rpartition("@")[2], 0)
        return f"{made}{draw.digits(2 * attempt)}@mail{site.digits(6)}.example.org"
    if kind == "ip":
        if attempt < 4:  # the private range; then the reserved one
            return f"10.{draw.below(256)}.{draw.below(256)}.{draw.below(256)}"
        return f"{240 + draw.below(15)}.{draw.below(256)}.{draw.below(256)}.{draw.below(256)}"
    if kind == "card":
        made = value[0] + draw.digits(len(value) - 2)
        return next(made + str(d) for d in range(10) if _luhn(made + str(d)))
    if kind == "iban":
        body = "".join(str(draw.below(10)) if c.isdigit() else chr(65 + draw.below(26)) for c in value[4:])
        return f"{value[:2]}{98 - _mod97(value[:2] + '00' + body):02d}{body}"
    if kind == "ssn":  # 9xx: never given out
        return "9" + draw.digits(8)
    if kind == "phone":
        if value.startswith("+1") and len(value) == 12:
            return f"+1{2 + draw.below(8)}{draw.digits(2)}{2 + draw.below(8)}{draw.digits(6)}"
        return value[:3] + draw.digits(len(value) - 3)
    role, gender, script = kind.split("-", 2)
    if script not in _SYLLABLES:
        return "".join(_near_letter(c, draw) for c in value)
    syllables, female, male, family = _SYLLABLES[script]
    made = "".join(syllables[draw.below(len(syllables))] for _ in range(2 + (role == "family") + attempt))
    if role == "given":
        return made + {"f": female, "m": male}.get(gender, "")
    return made + family + (female if gender == "f" and script == "cyrillic" else "")


def _near_letter(letter: str, draw: Draw) -> str:
    """A letter of the same kind from the same 64 code points."""
    start = ord(letter) & ~63
    same = [chr(c) for c in range(start, start + 64) if unicodedata.category(chr(c)) == unicodedata.category(letter)]
    return same[draw.below(len(same))]


def _rendered(kind: str, value: str, text: str) -> str:
    """A surrogate in the format of the mention that it replaces."""
    if kind in ("email", "ip"):
        return value.upper() if kind == "email" and text.isupper() else value
    if kind in ("card", "ssn", "phone", "iban"):
        left = list(value.lstrip("+"))
        if kind == "phone" and sum(c.isdigit() for c in text) == len(left) - 1:
            left = left[1:]  # written without the country's digit
        fill = iter(left)
        return "".join(next(fill) if c.isalnum() else c for c in text)
    if text.isupper() and len(text) > 1:
        return value.upper()
    return value[:1].upper() + value[1:]


def rewrite(text: str | None, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str | None, int]:
    """The text with all its personal data replaced, and the number of replacements."""
    found = mentions(text)
    if not found:
        return text, 0
    out, at = [], 0
    for m in found:
        value = surrogate(key, m.kind, m.value, attempts.get((m.kind, m.value), 0))
        out += [text[at:m.start], _rendered(m.kind, value, text[m.start:m.end])]
        at = m.end
    return "".join([*out, text[at:]]), len(found)


def entities(docs: DataFrame) -> DataFrame:
    """Distinct entities of the column ``text``: ``kind``, ``value``."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            found = {(m.kind, m.value) for text in part["text"] for m in mentions(text)}
            yield pd.DataFrame(sorted(found), columns=["kind", "value"])

    return docs.select("text").where("text IS NOT NULL").mapInPandas(rows, "kind string, value string").distinct()


def _surrogates(key: bytes) -> Column:
    def made(kind: pd.Series, value: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(key, k, v, a) for k, v, a in zip(kind, value, attempt, strict=True)], dtype=object)

    return F.pandas_udf(made, "string")("kind", "value", "attempt")


def assign(found: DataFrame, key: str) -> DataFrame:
    """Surrogates of distinct entities, no two alike in a kind and none that is an entity itself.

    Returns ``kind``, ``value``, ``attempt``, ``surrogate``.  Of entities that drew the same, the one with the
    fewest draws keeps it, then the one that comes first by code point; the others draw again.
    """
    secret = key.encode()
    state = found.select("kind", "value", F.lit(0).alias("attempt"))
    state = written(state.withColumn("surrogate", _surrogates(secret)), "surrogates")
    real = state.select("kind", F.col("value").alias("surrogate"))
    for _ in range(DRAWS):
        shared = state.groupBy("kind", "surrogate").agg(
            F.count("*").alias("n"), F.min(F.struct("attempt", "value")).alias("keeper")
        )
        known = shared.join(real.withColumn("is_real", F.lit(True)), ["kind", "surrogate"], "left")
        clashes = known.where("n > 1 OR is_real").select("kind", "surrogate", "keeper", "is_real")
        losers = (
            state.join(clashes, ["kind", "surrogate"])
            .where("is_real OR value <> keeper.value")
            .select("kind", "value", (F.col("attempt") + 1).alias("attempt"))
        )
        losers = written(losers, "redrawn")
        if losers.isEmpty():
            return state
        again = losers.withColumn("surrogate", _surrogates(secret))
        kept = state.join(losers.select("kind", "value"), ["kind", "value"], "left_anti")
        state = written(kept.select("kind", "value", "attempt", "surrogate").union(again), "surrogates")
    raise RuntimeError(f"some entities shared their surrogates after {DRAWS} draws")


def _rewritten(docs: DataFrame, key: str, mark: str) -> DataFrame:
    """``docs`` with a struct column ``mark`` (``text``, ``n``)."""
    secret = key.encode()
    state = assign(entities(docs), key)
    redrawn = written(state.where("attempt > 0").select("kind", "value", "attempt"), "exceptions")
    shape = "text string, n long"
    if redrawn.count() <= SENT_WHOLE:
        attempts = {(r["kind"], r["value"]): r["attempt"] for r in redrawn.collect()}
        shared = docs.sparkSession.sparkContext.broadcast(attempts)

        def plain(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([rewrite(t, secret, shared.value) for t in texts], columns=["text", "n"])

        return docs.withColumn(mark, F.pandas_udf(plain, shape)("text"))

    # too many to send: look up those of each distinct text that holds some
    digest, list_of = free_name(docs, "inkwell_digest"), free_name(docs, "inkwell_redrawn")

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = {(d, m.kind, m.value) for d, t in zip(part["digest"], part["text"], strict=True) for m in mentions(t)}
            yield pd.DataFrame(sorted(rows), columns=["digest", "kind", "value"])

    hashed = docs.where("text IS NOT NULL").select(F.sha2("text", 256).alias("digest"), "text")
    held = hashed.mapInPandas(own, "digest string, kind string, value string").distinct().join(redrawn, ["kind", "value"])
    lists = held.groupBy(F.col("digest").alias(digest)).agg(F.collect_list(F.struct("kind", "value", "attempt")).alias(list_of))

    def looked_up(texts: pd.Series, lists: pd.Series) -> pd.DataFrame:
        made = []
        for text, some in zip(texts, lists, strict=True):
            attempts = {(r["kind"], r["value"]): r["attempt"] for r in (some if some is not None else ())}
            made.append(rewrite(text, secret, attempts))
        return pd.DataFrame(made, columns=["text", "n"])

    joined = docs.withColumn(digest, F.sha2("text", 256)).join(written(lists, "lookups"), digest, "left")
    return joined.withColumn(mark, F.pandas_udf(looked_up, shape)("text", list_of))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """The documents with all personal data in ``text`` replaced; all other columns stay as they are.

    key: secret of the surrogates; the same key gives the same surrogates for the same table, another key
    others.  Defined cases: null texts stay null, empty ones empty; texts without personal data are not
    touched; repeated rows get the same replacements; an empty table gives an empty table.
    """
    mark = free_name(docs, "inkwell_rewritten")
    done = _rewritten(docs, key, mark)
    return done.select(*(F.col(f"{mark}.text").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns))


def surrogate_texts(docs: DataFrame, key: str) -> DataFrame:
    """``doc_id``, ``text`` with surrogates, ``n_entities``: one row per document (see ``pseudonymise``)."""
    plain = docs.select("doc_id", "text")
    done = _rewritten(plain, key, "rewritten")
    return done.select(F.col("doc_id").cast("long"), F.col("rewritten.text"), F.col("rewritten.n").alias("n_entities"))
