"""Predicates and projections over records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.text import _text, all_of, any_of
from rollbook.operators.registry import COLUMNS, SPEC, Spec, filled

#: Columns that a caller may search.
SEARCHABLE = tuple(c for c in COLUMNS if c not in ("id", "row_number", "raw_data", "imported_at"))


def by_column(df: DataFrame, column: str, token: str, limit: int = 100, spec: Spec = SPEC) -> DataFrame:
    """Records whose column contains the token in any case, least ids first. Wildcards in the token are literal."""
    if column not in SEARCHABLE or column not in df.columns:
        raise ValueError(f"not a searchable column: {column}")
    return df.where(F.upper(_text(column)).contains(token.upper())).orderBy(spec.id).limit(limit)


def segment(columns: Sequence[str], phrase: str) -> Column:
    """Every one of the phrase's first four words is in one of the columns."""
    words = phrase.upper().split()[:4] or [""]
    return all_of([any_of([F.upper(_text(c)).contains(w) for c in columns]) for w in words])


def states(column: str, names: Sequence[str]) -> Column:
    return F.upper(F.trim(_text(column))).isin(*[n.upper() for n in names])


def has(*columns: str) -> Column:
    return all_of([filled(c) for c in columns])


def missing(*columns: str) -> Column:
    return all_of([~filled(c) for c in columns])


def segment_report(df: DataFrame, where: Column, columns: Sequence[str], limit: int = 1000) -> DataFrame:
    """The first rows of a segment by name and terminal, with how many there are in all."""
    rows = df.where(where)
    total = rows.agg(F.count("*").alias("total"))
    return rows.select(*columns).orderBy(*columns).limit(min(limit, 5000)).crossJoin(F.broadcast(total))


def export(df: DataFrame, headers: dict[str, Sequence[str]]) -> DataFrame:
    """Columns under the headers, each the first filled of its alternatives that df has; further columns follow."""
    used = {c for alternatives in headers.values() for c in alternatives}
    first = lambda cs: F.coalesce(*[F.when(filled(c), F.col(c).cast("string")) for c in cs if c in df.columns], F.lit(""))
    return df.select(*[first(cs).alias(h) for h, cs in headers.items()], *[c for c in df.columns if c not in used])


def repair_names(df: DataFrame) -> DataFrame:
    """Names that are numbers give way to the slip header, else the account name, if that has letters."""
    digits = F.col("merchant_name").rlike(r"^[0-9][0-9 .]*$")
    words = lambda c: F.when(_text(c).rlike("[A-Za-z]"), F.col(c))
    return df.withColumn("merchant_name", F.when(digits, F.coalesce(words("slip_header"), words("account_name"), F.col("merchant_name"))).otherwise(F.col("merchant_name")))


def repair_placeholders(df: DataFrame, prefix: str, unless: Sequence[str] = ()) -> DataFrame:
    """Names that start with the prefix, and with none of the others, give way to a filled contact name."""
    name = F.col("merchant_name")
    placeholder = name.startswith(prefix)
    for other in unless:
        placeholder &= ~name.startswith(other)
    return df.withColumn("merchant_name", F.when(placeholder & filled("contact_name"), F.col("contact_name")).otherwise(name))


def decode(df: DataFrame, code: str, target: str, names: DataFrame) -> DataFrame:
    """target, where empty, filled from the small table names (code, name)."""
    names = names.select(F.col("code").alias(code), F.col("name").alias("_name"))
    return df.join(names, code, "left").withColumn(target, F.when(filled(target), F.col(target)).otherwise(F.coalesce("_name", target))).drop("_name").select(*df.columns)
