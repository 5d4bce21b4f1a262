"""What a build adds to records: quality scores with flags, and the events of each terminal's timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.identifiers import date_key
from rollbook.functions.text import all_of, header_key, name_key, source_file
from rollbook.operators.registry import value

#: What a record loses for each flag.
POINTS = {"missing_email": 20, "missing_phone": 20, "missing_account": 15, "missing_address": 10, "name_conflict": 15, "shared_identifier": 10}
#: The fields that name a terminal, strongest first, and those that should belong to one merchant.
IDENTITY = ("tid", "mxcode", "merchant_id", "account_number")
SHARED = ("phone", "email", "mxcode")
#: Keys of a change row's raw cells.
CHANGE_KEYS = (
    "OLD BANK ACC NO", "NEW BANK ACC NO", "OLD BANK CODE", "NEW BANK CODE", "OLD PHYSICAL ADDR", "NEW PHYSICAL ADDR", "OLD MERCHANT ACCOUNT NAME", "NEW MERCHANT ACCOUNT NAME", "OLD ACCOUNT NO", "NEW ACCOUNT NO", "NEW ALIAS",
    "OLD EMAIL", "NEW EMAIL", "OLD BANK ACC", "NEW BANK ACC",
)


def terminal_key(prefix: str = "") -> tuple[Column, Column]:
    """Field and value of the strongest identifier that a record has; both empty without one."""
    cells = [value(f"{prefix}{f}") for f in IDENTITY]
    field, key = F.lit(""), F.lit("")
    for f, c in reversed(list(zip(IDENTITY, cells, strict=True))):
        field, key = F.when(c != "", F.lit(f)).otherwise(field), F.when(c != "", c).otherwise(key)
    return field, key


def signature() -> Column:
    """All identifiers as one text; empty cells throughout where fewer than two are filled, which proves nothing."""
    cells = [value(f) for f in IDENTITY]
    filled = sum(((c != "").cast("int") for c in cells), F.lit(0))
    return F.when(filled >= 2, F.to_json(F.array(*cells))).otherwise("")


def quality(df: DataFrame) -> DataFrame:
    """df with quality_score (100 less the flags' points, 0 at least) and quality_flags, in the order of POINTS.

    A terminal is in conflict if its named records have more than one signature; all its records are flagged, and
    the phones, e-mails and codes on them count as shared wherever they occur. Names and values are grouped by
    combining aggregates, so a terminal with a third of all records costs no task more than its share.
    """
    field, key = terminal_key()
    keyed = df.withColumn("_field", field).withColumn("_key", key)
    named = keyed.where((F.col("_field") != "") & (name_key("merchant_name") != ""))
    conflicts = named.select("_field", "_key", signature().alias("_sig")).distinct().groupBy("_field", "_key").agg(F.count("*").alias("_n")).where("_n > 1").select("_field", "_key", F.lit(True).alias("_conflict"))
    keyed = keyed.join(conflicts, ["_field", "_key"], "left").withColumn("_conflict", F.coalesce("_conflict", F.lit(False)))
    cells = F.filter(F.array(*[F.struct(F.lit(f).alias("f"), value(f).alias("v")) for f in SHARED]), lambda x: x["v"] != "")
    smell = keyed.where("_conflict").select(F.inline(cells)).distinct()
    shared = keyed.select("id", F.inline(cells)).join(smell, ["f", "v"], "left_semi").select("id").distinct().withColumn("_shared", F.lit(True))
    keyed = keyed.join(shared, "id", "left")
    holds = {
        "missing_email": ~value("email").contains("@"), "missing_phone": value("phone") == "", "missing_account": value("account_number") == "", "missing_address": value("address") == "",
        "name_conflict": F.col("_conflict"), "shared_identifier": F.coalesce("_shared", F.lit(False)),
    }
    lost = sum((F.when(holds[f], n).otherwise(0) for f, n in POINTS.items()), F.lit(0))
    flags = F.filter(F.array(*[F.when(holds[f], F.lit(f)) for f in POINTS]), lambda x: x.isNotNull())
    return keyed.withColumn("quality_score", F.greatest(100 - lost, F.lit(0))).withColumn("quality_flags", flags).select(*df.columns, "quality_score", "quality_flags")


def _cells(raw: Column | str) -> Column:
    """Keys and values of a JSON object, in its order; none for anything else."""
    return F.coalesce(F.map_entries(F.from_json(raw, "map<string,string>")), F.array().cast("array<struct<key:string,value:string>>"))


def raw_value(raw: Column | str, *words: str, without: str | None = None) -> Column:
    """The first cell whose key has all the words in any case (and not ``without``), cleaned; empty if there is none."""
    fits = lambda x: all_of([F.lower(x["key"]).contains(w) for w in words] + ([~F.lower(x["key"]).contains(without)] if without else []))
    return value(F.get(F.filter(_cells(raw), fits), F.lit(0))["value"])


def change_pairs(raw: Column | str) -> list[Column]:
    """A column for each of CHANGE_KEYS: the cell under that header, white space and case aside, else empty."""
    by_header = F.transform(_cells(raw), lambda x: F.struct(header_key(x["key"]).alias("key"), F.coalesce(x["value"], F.lit("")).alias("value")))
    found = lambda k: F.filter(by_header, lambda x: x["key"] == k)
    return [F.coalesce(F.get(found(k), F.size(found(k)) - 1)["value"], F.lit("")).alias(k.lower().replace(" ", "_")) for k in CHANGE_KEYS]


def account_changes(df: DataFrame) -> DataFrame:
    """Records of change sheets whose raw cells hold an old or a new account: old, new, their banks, and the date asked for."""
    raw, field_key = "raw_data", terminal_key()
    date = F.coalesce(*[date_key(F.when(raw_value(raw, k) != "", raw_value(raw, k))) for k in ("month of request", "request date", "date of request", "date created")])
    rows = df.where(F.lower("sheet_name").contains("change")).select(
        "id", "sheet_name", field_key[0].alias("key_field"), field_key[1].alias("terminal_key"), raw_value(raw, "old bank acc").alias("old_account"), raw_value(raw, "new bank acc").alias("new_account"),
        raw_value(raw, "old bank", without="acc").alias("old_bank"), raw_value(raw, "new bank", without="acc").alias("new_bank"), date.alias("occurred_at"),
    )
    return rows.where("old_account <> '' or new_account <> ''")


def events(df: DataFrame) -> DataFrame:
    """The timeline of every terminal: terminal_key, key_field, event_type, value, source, n, occurred_at.

    first_seen and last_seen carry the least and greatest onboarding date, unknown without one, and the file of the
    terminal's first and last record; name_variant a name, its first file and how many records have it;
    account_change the old and the new account; n is 0 but for names. All by combining aggregates.
    """
    field, key = terminal_key()
    rows = df.select("id", field.alias("key_field"), key.alias("terminal_key"), date_key("onboarded_date").alias("_date"), source_file("sheet_name").alias("_file"), name_key("merchant_name").alias("_name")).where("key_field <> ''")
    by = ["terminal_key", "key_field"]
    seen = rows.groupBy(*by).agg(F.min("_date").alias("first"), F.max("_date").alias("last"), F.min_by("_file", "id").alias("first_file"), F.max_by("_file", "id").alias("last_file"))
    when = lambda which: F.struct(F.lit(f"{which}_seen").alias("event_type"), F.coalesce(which, F.lit("unknown")).alias("value"), F.col(f"{which}_file").alias("source"), F.lit(0).cast("bigint").alias("n"), F.col(which).alias("occurred_at"))
    dated = seen.select(*by, F.inline(F.array(when("first"), when("last"))))
    names = rows.where("_name <> ''").groupBy(*by, F.col("_name").alias("value")).agg(F.min_by("_file", "id").alias("source"), F.count("*").alias("n"))
    names = names.select(*by, F.lit("name_variant").alias("event_type"), "value", "source", "n", F.lit(None).cast("string").alias("occurred_at"))
    both = F.array_join(F.filter(F.array("old_account", "new_account"), lambda x: x != ""), " → ")
    changed = account_changes(df).where("key_field <> ''").select(*by, F.lit("account_change").alias("event_type"), both.alias("value"), F.col("sheet_name").alias("source"), F.lit(0).cast("bigint").alias("n"), "occurred_at")
    return dated.unionByName(names).unionByName(changed)


def timeline_of(found: DataFrame, key: str) -> DataFrame:
    """The events of one terminal, dated ones first, oldest first."""
    order = F.create_map(*[F.lit(x) for i, k in enumerate(("first_seen", "last_seen", "name_variant", "account_change")) for x in (k, i)])
    return found.where(F.col("terminal_key") == key).orderBy(F.col("occurred_at").asc_nulls_last(), order[F.col("event_type")], "value")


def keys_for(df: DataFrame, fragment: str, limit: int = 20) -> DataFrame:
    """(key_field, terminal_key) of records whose identifier has the fragment, then of those whose name has it."""
    part = fragment.strip().upper()
    cells = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(f).alias("key_field"), F.trim(F.coalesce(f, F.lit(""))).alias("terminal_key")) for i, f in enumerate(IDENTITY)])
    rows = df.select(F.contains(F.upper(F.trim("merchant_name")), F.lit(part)).alias("named"), F.inline(cells)).where("terminal_key <> ''")
    hits = rows.withColumn("own", F.upper("terminal_key").contains(part)).where(F.col("own") | F.col("named"))
    return hits.groupBy("rank", "key_field", "terminal_key").agg(F.max("own").alias("own")).orderBy(F.desc("own"), "rank", "terminal_key").limit(limit).select("key_field", "terminal_key")

