"""Normalisation of names, codes and headers, as built-in column expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that do not tell one business from another, and stop words.
GENERIC_WORDS = (
    "LIMITED", "LTD", "NIGERIA", "NG", "GLOBAL", "SERVICES", "ENTERPRISES", "ENT", "INVESTMENT", "INVESTMENTS", "INV",
    "COMPANY", "CO", "CORPORATION", "CORP", "INC", "INCORPORATED", "GROUP", "HOLDINGS", "HOLDING", "PLC", "INTERNATIONAL", "INTL",
    "TECHNOLOGIES", "TECH", "SOLUTIONS", "SYSTEMS", "CONSULTING", "CONSULTANCY", "VENTURES", "PROPERTIES", "REALTY", "ESTATE",
    "PRODUCTS", "INDUSTRIES", "IND", "FZC", "LLC", "FZE", "DMCC", "NIG",
    "THE", "A", "AN", "AND", "OR", "FOR", "TO", "IN", "ON", "AT", "BY", "WITH", "OF", "IS", "IT", "AS", "BE", "THIS", "THAT",
)
#: Words dropped before two names are held against each other as one family's.
FAMILY_GENERICS = (
    "LTD", "LIMITED", "PLC", "INC", "LLC", "NIG", "NIGERIA", "NG", "CO", "COMPANY", "COMPANIES", "SERVICES", "SERVICE", "ENTERPRISE",
    "ENTERPRISES", "VENTURES", "VENTURE", "GROUP", "GLOBAL", "INTL", "INTERNATIONAL", "INVESTMENT", "INVESTMENTS", "HOLDING", "HOLDINGS",
    "AND", "&", "THE", "OF", "FOR", "STORE", "STORES", "BRANCH", "NNPC", "LTD.",
)
#: Abbreviations in names.
ABBREVIATIONS = {"INT'L": "INTERNATIONAL", "INTL": "INTERNATIONAL", "INT L": "INTERNATIONAL", "CO LTD": "COMPANY LIMITED", "BROS": "BROTHERS"}
#: Misspellings that recur in names.
TYPOS = {
    "MICROFINANACE": "MICROFINANCE", "MICROFINACE": "MICROFINANCE", "LIIMITED": "LIMITED", "INTERNMATIONAL": "INTERNATIONAL", "OLWADAMS": "OLUWADAMS", "ENTERPRIZE": "ENTERPRISE",
    "ENTERPRIZES": "ENTERPRISES", "SERVCIES": "SERVICES", "BUSINESSS": "BUSINESS", "COMPNAY": "COMPANY", "HOTELL": "HOTEL", "RESTURANT": "RESTAURANT", "NIGERAI": "NIGERIA",
}
#: Shorthand in requests.
SLANG = {
    "acct": "account", "accts": "accounts", "mgr": "manager", "deets": "details", "stmnt": "statement", "stmt": "statement", "numb": "number", "benef": "beneficiary", "addr": "address", "mob": "mobile",
    "tel": "telephone",
}


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip_space(c: Column | str) -> Column:
    """Without white space of any kind at either end; null is empty."""
    return F.regexp_replace(_text(c), r"(?U)^\s+|\s+$", "")


def squeeze(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_text(c), r"(?U)\s+", " "))


@cache
def _plain_letters() -> tuple[str, str]:
    """Latin letters with diacritics, and the letters below them."""
    pairs = [(chr(i), [c for c in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(c)]) for i in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(a, b[0]) for a, b in pairs if len(b) == 1 and b[0] != a]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_accents(c: Column | str) -> Column:
    """Letters without their diacritics; combining marks go."""
    return F.regexp_replace(F.translate(_text(c), *_plain_letters()), r"\p{M}", "")


def canonical(c: Column | str) -> Column:
    """The form in which names are compared: no accents, upper case, `&` as AND, abbreviations and known typos
    spelt out, apostrophes dropped, all else that is neither letter nor digit a single space. Null is empty."""
    out = F.replace(F.upper(strip_accents(c)), F.lit("&"), F.lit(" AND "))
    for short, full in (*ABBREVIATIONS.items(), *TYPOS.items()):
        out = F.regexp_replace(out, rf"\b{re.escape(short)}\b", full)
    out = F.regexp_replace(F.replace(out, F.lit("'"), F.lit("")), "[^A-Z0-9]+", " ")
    return F.trim(out)


def words(c: Column) -> Column:
    """Words of a canonical form; none for an empty one."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def _without(array: Column, dropped: tuple[str, ...]) -> Column:
    return F.filter(array, lambda w: ~w.isin(*dropped))


def tokens(c: Column | str) -> Column:
    """Distinctive words of a name: of three letters or more and not generic; if none is, all of three or more."""
    every = F.filter(words(canonical(c)), lambda w: F.length(w) >= 3)
    kept = _without(every, GENERIC_WORDS)
    return F.when(F.size(kept) > 0, kept).otherwise(every)


def bucket_key(c: Column | str) -> Column:
    """The canonical name without generic words."""
    return F.array_join(_without(words(canonical(c)), GENERIC_WORDS), " ")


def family_tokens(c: Column | str) -> Column:
    """Distinct words that tell a family of records, in order."""
    parts = F.filter(F.split(F.replace(F.upper(_text(c)), F.lit("&"), F.lit(" AND ")), "[^A-Z0-9]+"), lambda w: F.length(w) >= 2)
    return F.array_distinct(_without(parts, FAMILY_GENERICS))


def email(c: Column | str) -> Column:
    return F.lower(strip_space(c))


def phone(c: Column | str) -> Column:
    """Digits only, or empty if there are fewer than ten."""
    digits = F.regexp_replace(_text(c), r"\D", "")
    return F.when(F.length(digits) >= 10, digits).otherwise("")


def phone_key(c: Column | str) -> Column:
    """The last ten digits, which the international and the local form share; empty if there are fewer."""
    digits = phone(c)
    return F.when(digits != "", F.right(digits, F.lit(10))).otherwise("")


def code(c: Column | str) -> Column:
    return F.upper(strip_space(c))


def compact(c: Column | str) -> Column:
    return F.regexp_replace(F.upper(_text(c)), "[^A-Z0-9]", "")


def lookalike_key(c: Column | str) -> Column:
    """Codes that differ only in digits and the letters they are mistaken for share a key."""
    return F.translate(code(c), "01258", "OIZSB")


def name_key(c: Column | str) -> Column:
    return squeeze(F.upper(_text(c)))


def header_key(c: Column | str) -> Column:
    return squeeze(F.upper(F.replace(_text(c), F.lit(" "), F.lit(" "))))


def singular(c: Column | str) -> Column:
    c = _text(c)
    return F.when((F.length(c) > 3) & c.endswith("s") & ~c.endswith("ss"), F.substr(c, F.lit(1), F.length(c) - 1)).otherwise(c)


def spell_out(c: Column | str) -> Column:
    """A request in lower case with shorthand spelt out, longest shorthand first."""
    out = F.lower(_text(c))
    for short in sorted(SLANG, key=lambda s: (-len(s), s)):
        out = F.regexp_replace(out, rf"\b{short}\b", SLANG[short])
    return out


def source_file(c: Column | str) -> Column:
    """The file of a `file :: sheet` source."""
    return F.trim(F.split_part(_text(c), F.lit("::"), F.lit(1)))


def source_sheet(c: Column | str) -> Column:
    return F.trim(F.split_part(_text(c), F.lit("::"), F.lit(2)))


def slug(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_text(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def initials(c: Column | str) -> Column:
    """First letters of the first two words."""
    return F.upper(F.array_join(F.transform(F.slice(F.filter(F.split(squeeze(c), " "), lambda w: w != ""), 1, 2), lambda w: F.substring(w, 1, 1)), ""))


def shorten(c: Column | str, most: int) -> Column:
    c = _text(c)
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


def ngrams(array: Column, most: int = 3) -> Column:
    """Runs of 1 to ``most`` words, joined by a space, shorter ones first."""

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(array) - n + 1)
        return F.when(F.size(array) >= n, F.transform(starts, lambda i: F.array_join(F.slice(array, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return F.concat(*map(runs, range(1, most + 1)))


def trigrams(c: Column) -> Column:
    """Distinct runs of three characters."""
    return F.when(F.length(c) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substr(c, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def aliases(c: Column | str) -> Column:
    """Other spellings of a name: canonical, without generic words, the distinctive words, the first two, the first."""
    core, key = tokens(c), bucket_key(c)
    forms = [canonical(c), key, F.array_join(core, " "), F.when(F.size(core) >= 2, F.array_join(F.slice(core, 1, 2), " ")), F.when(F.length(F.get(core, F.lit(0))) >= 4, F.get(core, F.lit(0)))]
    return F.array_distinct(F.filter(F.array(*forms), lambda x: x.isNotNull() & (x != "") & (x != name_key(c))))


def any_of(columns: list[Column]) -> Column:
    return reduce(Column.__or__, columns)


def all_of(columns: list[Column]) -> Column:
    return reduce(Column.__and__, columns)
