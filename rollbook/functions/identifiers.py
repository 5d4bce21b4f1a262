"""Shapes of identifiers: checks, classification, masks, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollbook.functions.text import _text, any_of, code, compact, strip_space

#: The kinds of identifier by column of a record, best first.
COLUMN_KINDS = {
    "mxcode": "mxcode", "tid": "tid", "phone": "phone", "email": "email", "static_acc_no": "static", "account_number": "account", "bvn": "bvn", "merchant_id": "mid", "alias": "alias", "payable_code": "payable",
}
#: Shapes by which an unknown value is classified, most specific first, with the kinds they speak for. (?i): in any case.
SHAPES = (
    (r"(?i)Default[_-]?Payable[_-]?MX\d+", ("payable",)), (r"(?i)MX\d+_[A-Z_]+", ("payable",)), (r"(?i)MX\d{4,8}", ("mxcode",)), (r"2ISW[A-Z0-9]{11}", ("mid",)), (r"(?i)\d{4}[A-Z]\d{3}", ("tid",)),
    (r"(?i)2ISW[A-Z0-9]{4,6}", ("tid",)), (r"\d{8}", ("tid",)), (r"\d{12}", ("bvn",)), (r"\d{11}", ("bvn", "phone")), (r"(?:\+?234|0)[789]\d{9}", ("phone",)), (r"\d{10}", ("static", "account")),
    (r"\d{7}", ("payable",)), (r"\d{6}", ("alias",)), (r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", ("email",)),
)
#: What a value must look like to link records through its column.
PLAUSIBLE = {
    "tid": r"(?i)^(?:2ISW[A-Z0-9]{4,6}|\d{8}|\d{4}[A-Z]\d{3})$", "mxcode": r"(?i)^MX\d{4,8}$", "merchant_id": r"(?i)^2ISW[A-Z0-9]{11}$", "payable_code": r"(?i)^(?:\d{7}|Default[_-]?Payable[_-]?MX\d+|MX\d+_[A-Z_]+)$",
    "account_number": r"^\d{10}$", "phone": r"^(?:\+?234|0)[789]\d{9}$",
}
#: Weights of an account number's first nine digits; the tenth is the check digit.
NUBAN_WEIGHTS = (3, 7, 3, 3, 7, 3, 3, 7, 3)
#: Words of an address, and places that are known by name.
ADDRESS_WORDS = (
    "ROAD", "STREET", "AVENUE", "AVE", "BOULEVARD", "BLVD", "PLAZA", "MALL", "ESTATE", "WAY", "DRIVE", "LANE", "CLOSE", "CRESCENT", "BLOCK", "PLOT", "BUILDING", "JUNCTION", "GARDEN", "CENTER", "CENTRE", "PHASE",
    "EXPRESSWAY", "BYPASS", "VILLAGE", "QUARTERS", "GATE", "TERMINAL", "AIRPORT", "HOUSE", "SUITE", "FLOOR", "CIRCLE", "PARK", "GARDENS", "SQUARE", "VI", "GRA", "STATE",
)
LOCALITIES = (
    "ABUJA", "IKEJA", "LEKKI", "IKORODU", "SURULERE", "SANGOTEDO", "IKOYI", "YABA", "MARYLAND", "FESTAC", "AJAH", "OTA", "ONIRU", "ILUPEJU", "MAGODO", "ALIMOSHO", "EGBEDA", "AMUWO", "PALMGROOVE", "GBAGADA", "ILORIN", "KANO",
    "KADUNA", "HARCOURT", "ENUGU", "OWERRI", "JOS", "CALABAR", "UYO", "WARRI", "ASABA", "ONITSHA", "AWKA", "OSOGBO", "AKURE", "IBADAN", "ABEOKUTA", "BENIN", "UMUAHIA", "EFFURUN", "BARNAWA", "MAITAMA", "WUSE", "GWARINPA",
    "DUTSE", "UTAKO", "LUGBE", "IKOTA", "IKATE", "ELEGUSHI", "AJAO", "OGUDU", "CHEVRON", "AKOWONJO", "BARIGA", "AGUNGI", "FCT", "VICTORIA", "ISLAND", "TOWN", "BEACH", "LAGOS",
)
#: Beginnings that make a value a code.
CODE_PREFIXES = ("MX", "TID", "MID", "2ISW", "PTSP", "BVN", "PAY", "ACC")


def valid_account(account: Column | str) -> Column:
    """Whether the value has ten digits, other characters aside, of which the last is the check digit of the nine before."""
    digits = F.regexp_replace(_text(account), r"\D", "")
    total = sum((F.substring(digits, i + 1, 1).cast("int") * w for i, w in enumerate(NUBAN_WEIGHTS)), F.lit(0))
    return F.when(F.length(digits) == 10, F.substring(digits, 10, 1).cast("int") == (10 - total % 10) % 10).otherwise(False)


def valid_bvn(c: Column | str) -> Column:
    return strip_space(c).rlike(r"^2\d{10}$")


def plausible_tid(c: Column | str) -> Column:
    """Seven characters or more, six of them digits or more."""
    return (F.length(strip_space(c)) >= 7) & (F.regexp_count(_text(c), F.lit(r"\d")) >= 6)


def strict_tid(c: Column | str) -> Column:
    return code(c).rlike(r"^(2ISW[A-Z0-9]{4}|\d{8}|\d{4}[A-Z]\d{3})$")


def plausible(field: str, c: Column | str) -> Column:
    """Whether a value can link records through the field. Fields without a shape take any value of four characters."""
    value = strip_space(c)
    if field == "email":
        ok = value.contains("@") & F.element_at(F.split(value, "@"), -1).contains(".")
    else:
        ok = value.rlike(PLAUSIBLE[field]) if field in PLAUSIBLE else F.lit(True)
    return (F.length(value) >= 4) & ok


def shape_kinds(c: Column | str) -> Column:
    """The kinds that a value's shape speaks for, or none. Too long, too short, or without a digit and @: none."""
    value = code(c)
    ok = F.length(value).between(4, 64) & (value.rlike(r"\d") | value.contains("@"))
    out = F.when(~ok, F.array().cast("array<string>"))
    for shape, kinds in SHAPES:
        out = out.when(value.rlike(f"^(?:{shape})$"), F.array(*map(F.lit, kinds)))
    return out.otherwise(F.array().cast("array<string>"))


def code_like_name(c: Column | str) -> Column:
    """A name that is none: two characters or fewer, a number, or up to ten capitals and digits that start with a digit or, five or more, have no vowel."""
    value = strip_space(c)
    n, short = F.length(value), value.rlike("^[0-9A-Z]{1,10}$")
    return (n > 0) & ((n <= 2) | value.rlike(r"^[\d.]+$") | (short & (value.rlike(r"^\d") | ((n >= 5) & ~value.rlike("[AEIOU]")))))


def looks_like_code(c: Column | str) -> Column:
    """A query for a code, not a name: a code's beginning, or five or more characters with a digit among them (others than letters and digits aside)."""
    value = compact(c)
    return (F.length(value) >= 3) & (any_of([value.startswith(p) for p in CODE_PREFIXES]) | ((F.length(value) >= 5) & value.rlike(r"\d")))


def plausible_part(field: str, c: Column | str) -> Column:
    """Whether a value may match a field's in part: accounts and BVNs must be valid, codes long enough."""
    if field in ("account_number", "static_acc_no"):
        return valid_account(c)
    if field == "bvn":
        return valid_bvn(c)
    value = strip_space(c)
    return plausible_tid(c) if field == "tid" else F.length(value) >= (6 if field in ("merchant_id", "mxcode", "payable_code") else 1)


def real_name(c: Column | str) -> Column:
    return (F.regexp_count(_text(c), F.lit(r"\p{L}")) >= 3) & ~strip_space(c).rlike(r"^\d+(\.\d+)?$")


def address_like(c: Column | str) -> Column:
    """A road word and a place, two road words, or two places."""
    parts = F.split(F.regexp_replace(F.upper(_text(c)), "[^A-Z0-9]+", " "), " ")
    roads, places = (F.size(F.array_intersect(parts, F.array(*map(F.lit, words)))) for words in (ADDRESS_WORDS, LOCALITIES))
    return (roads >= 2) | ((roads >= 1) & (places >= 1)) | (places >= 2)


def _stars(n: Column) -> Column:
    return F.repeat(F.lit("*"), F.greatest(n, F.lit(0)))


def mask(c: Column | str) -> Column:
    """The first three and the last two characters, stars between; up to five only the first. Without a value, empty."""
    c = strip_space(c)
    n = F.length(c)
    return F.when(n == 0, "").when(n <= 5, F.concat(F.substring(c, 1, 1), _stars(F.greatest(n - 1, F.lit(1))))).otherwise(F.concat(F.substring(c, 1, 3), _stars(n - 5), F.right(c, F.lit(2))))


def mask_field(field: str, c: Column | str) -> Column:
    """By kind: BVNs, accounts and phones (these with their first two) keep the last four; e-mails two letters and the domain; others two or one at either end."""
    c = strip_space(c)
    n, tail = F.length(c), F.right(c, F.lit(4))
    out = F.when(n > 6, F.concat(F.substring(c, 1, 2), _stars(n - 4), F.right(c, F.lit(2)))).when(n > 2, F.concat(F.substring(c, 1, 1), _stars(n - 2), F.right(c, F.lit(1)))).otherwise("*")
    if field == "bvn":
        out = F.when(n >= 4, F.concat(F.lit("***-***-"), tail)).otherwise(out)
    elif field in ("account_number", "static_acc_no"):
        out = F.when(n >= 4, F.concat(_stars(n - 4), tail)).otherwise(out)
    elif field == "phone":
        out = F.when(n >= 4, F.concat(F.substring(c, 1, 2), _stars(n - 4), tail)).otherwise(out)
    elif field == "email":
        local = F.substring_index(c, "@", 1)
        domain = F.substr(c, F.length(local) + 1)
        shown = F.when(F.length(local) >= 2, F.concat(F.substring(local, 1, 2), _stars(F.length(local) - 2))).otherwise(_stars(F.length(local)))
        out = F.when(c.contains("@"), F.concat(shown, domain)).otherwise(out)
    return F.when(n == 0, "").otherwise(out)


def date_key(c: Column | str) -> Column:
    """A date in any of eight spellings as YYYY-MM-DD, else null; a month alone is its first day."""
    value = strip_space(c)
    shapes = ((r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"), (r"^[A-Za-z]{3} \d{4}$", "MMM yyyy"), (r"^[A-Za-z]{3,9} \d{4}$", "MMMM yyyy"), (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"), (r"^\d{1,2} [A-Za-z]{3,9} \d{4}$", "d MMMM yyyy"))
    tries = [F.when(value.rlike(shape), F.date_format(F.try_to_date(F.initcap(value), form), "yyyy-MM-dd")) for shape, form in shapes]
    return F.coalesce(F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), value), *tries)


def clean_date(c: Column | str) -> Column:
    """ISO date-times lose their time, dd/mm/yyyy becomes ISO, all else stays."""
    value = strip_space(c)
    return F.regexp_replace(F.regexp_replace(value, r"^(\d{4}-\d{2}-\d{2})[T ].*$", "$1"), r"^(\d{2})/(\d{2})/(\d{4})$", "$3-$2-$1")
