"""The registry record: which columns it has, what is missing in it, and its long form."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.identifiers import COLUMN_KINDS
from rollbook.functions.text import _text, any_of, code, lookalike_key, strip_space

#: Columns of a record, all text but id, row_number and the quality score.
COLUMNS = (
    "id", "sheet_name", "row_number", "merchant_name", "merchant_id", "mxcode", "payable_code", "tid", "terminal_serial", "slip_header", "email", "phone", "address", "contact_name", "contact_title",
    "account_name", "account_number", "bank", "state", "state_code", "bvn", "ptsp", "terminal_type", "deployment_status", "alias", "static_acc_no", "remarks", "raw_data", "imported_at", "onboarded_date",
    "merchant_category_code", "business_occupation_code", "terminal_owner_code", "settlement_type", "acquirer", "acquirer_id", "lga", "slip_footer", "tin", "mtn_serial", "sim9mobile_serial", "deployment_date", "bank_code",
)
#: Cells that mean nothing in enrichment, and in profiles.
NO_VALUE = ("", "y", "n", "n/a", "na", "-", "nil", "none", "null")
NOISE = ("", "y", "n", "n/a", "na", "-", "--", "nil", "null", "0", "1")

#: Bits in which keys are marked before an exact join. Of n keys, a share of about n in BITS of all other rows passes too.
BITS = 1 << 24


@dataclass(frozen=True)
class Spec:
    """Column roles of a table of records."""

    id: str = "id"
    name: str = "merchant_name"
    source: str = "sheet_name"
    names: tuple[str, ...] = ("merchant_name", "slip_header", "account_name")
    identifiers: tuple[str, ...] = ("tid", "mxcode", "merchant_id", "account_number")
    links: tuple[str, ...] = ("tid", "mxcode", "merchant_id", "payable_code", "account_number", "phone", "email")


SPEC = Spec()


def filled(c: Column | str) -> Column:
    """Neither null nor empty."""
    return _text(c) != ""


def value(c: Column | str, nothing: Sequence[str] = NO_VALUE) -> Column:
    """The cell without outer white space, or empty if it means nothing."""
    out = strip_space(c)
    return F.when(F.lower(out).isin(*nothing), "").otherwise(out)


def conform(df: DataFrame) -> DataFrame:
    """df with all columns of a record, missing ones empty, in order; other columns go."""
    have = {c.lower(): c for c in df.columns}
    types = {"id": "bigint", "row_number": "int"}
    return df.select(*[(F.col(f"`{have[c]}`") if c in have else F.lit("" if c not in types else None)).cast(types.get(c, "string")).alias(c) for c in COLUMNS])


def long_form(df: DataFrame, columns: Sequence[str], spec: Spec = SPEC) -> DataFrame:
    """(id, field, value): a row for each filled cell of the columns, in one pass and without an exchange."""
    cells = F.filter(F.array(*[F.struct(F.lit(c).alias("field"), code(c).alias("value")) for c in columns]), lambda x: x["value"] != "")
    return df.select(F.col(spec.id).alias("id"), F.inline(cells))


def identifiers(df: DataFrame, spec: Spec = SPEC) -> DataFrame:
    """Distinct (id, id_type, id_value) over the identifier columns that df has."""
    have = [c for c in COLUMN_KINDS if c in df.columns]
    kinds = F.create_map(*[F.lit(x) for c in have for x in (c, COLUMN_KINDS[c])])
    return long_form(df, have, spec).select("id", kinds[F.col("field")].alias("id_type"), F.col("value").alias("id_value")).distinct()


def first_by(df: DataFrame, key: Sequence[str], order: Sequence[Column | str], columns: Sequence[str]) -> DataFrame:
    """Of each key the columns of the row that comes first. One aggregation that combines before the exchange, no sort."""
    rank = F.struct(*[F.col(o).alias(f"o{i}") if isinstance(o, str) else o.alias(f"o{i}") for i, o in enumerate(order)])
    return df.groupBy(*key).agg(F.min_by(F.struct(*columns), rank).alias("_")).select(*key, "_.*")


def perhaps_in(df: DataFrame, keys: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of df whose columns agree with a row of keys, and few others: a filter before an exact join, so that little is exchanged for it.

    Keys are marked in BITS bits, of which words of 64 that hold a mark are broadcast: a quarter of a million at most.
    """
    place = F.pmod(F.xxhash64(*columns), F.lit(BITS))
    marks = keys.select(place.alias("_at")).groupBy(F.shiftright("_at", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_at & 63 as int))")).alias("_bits"))
    return df.withColumn("_at", place).join(F.broadcast(marks), F.expr("shiftright(_at, 6) = _word and shiftrightunsigned(_bits, cast(_at & 63 as int)) & 1L = 1L"), "left_semi").drop("_at")


def resolve(df: DataFrame, wanted: DataFrame, columns: Sequence[str], spec: Spec = SPEC, keep: Sequence[str] = ("id",)) -> DataFrame:
    """Each wanted value (column ``value``) with the first record that holds it in any of the columns.

    An exact match comes before one that differs only in look-alike characters, then the least id does. Values
    without a match are kept, with nulls. Adds matched_field and is_exact.
    """
    wanted = wanted.select(F.col("value")).distinct().withColumn("_code", code("value")).withColumn("_key", lookalike_key("value"))
    rest = [c for c in keep if c != spec.id]
    held = F.filter(F.array(*[F.struct(F.lit(c).alias("matched_field"), code(c).alias("_cell")) for c in columns]), lambda x: x["_cell"] != "")
    # Only records that hold a wanted key are kept, and they carry what is shown of them: no second join for it.
    cells = df.select(F.col(spec.id).alias("id"), *[F.col(c).alias(f"_keep_{c}") for c in rest], F.inline(held)).withColumn("_key", lookalike_key("_cell"))
    cells = perhaps_in(cells, wanted.where("_code <> ''"), ["_key"])
    hits = cells.join(wanted.where("_code <> ''"), "_key").withColumn("is_exact", F.col("_cell") == F.col("_code"))
    best = first_by(hits, ["value"], [~F.col("is_exact"), "id", "matched_field"], ["id", *[f"_keep_{c}" for c in rest], "matched_field", "is_exact"])
    shown = best.withColumnsRenamed({f"_keep_{c}": c for c in rest})
    return wanted.select("value").join(shown, "value", "left").select("value", *dict.fromkeys(["id", *rest]), "matched_field", "is_exact")


def linked(df: DataFrame, seeds: DataFrame, columns: Sequence[str], spec: Spec = SPEC) -> DataFrame:
    """Distinct (seed, id): records that share a value of one of the columns with a seed record (column ``id``)."""
    cells = long_form(df, columns, spec)
    own = seeds.select(F.col("id").alias("seed")).distinct().join(cells.withColumnRenamed("id", "seed"), "seed")
    return own.join(cells, ["field", "value"]).where("seed <> id").select("seed", "id").distinct()


def links(df: DataFrame, columns: Sequence[str], spec: Spec = SPEC) -> DataFrame:
    """(seed, field, value, n_linked) of every record: the values that others share with it, and how many others.

    Records of one (field, value) are linked with each other. Linear in rows, where the pairs grow with a group's square.
    """
    cells = long_form(df, columns, spec).select("id", "field", "value").distinct()
    shared = cells.groupBy("field", "value").agg(F.count("*").alias("n")).where("n > 1")
    return cells.join(shared, ["field", "value"]).select(F.col("id").alias("seed"), "field", "value", (F.col("n") - 1).alias("n_linked"))


def holds_any(columns: Sequence[str], values: Sequence[str]) -> Column:
    """Whether any of the columns holds one of a few values, in any case, outer spaces aside."""
    wanted = [v.strip().upper() for v in values]
    return any_of([code(c).isin(*wanted) for c in columns])
