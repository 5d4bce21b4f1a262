"""Counts and summaries over records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.text import _text, bucket_key, code, lookalike_key, name_key, tokens
from rollbook.operators.registry import NOISE, SPEC, Spec, filled, long_form, value


def count_of(condition: Column) -> Column:
    return F.count_if(condition)


def bucket_members(df: DataFrame, spec: Spec = SPEC) -> DataFrame:
    """(bucket_key, id): a row for each record with a distinctive name. Rows, not lists: a common name may be a third of them."""
    return df.select(bucket_key(spec.name).alias("bucket_key"), F.col(spec.id).alias("id")).where("bucket_key <> ''")


def buckets(df: DataFrame, spec: Spec = SPEC) -> DataFrame:
    """Per bucket_key how many records have it and the least id among them."""
    return bucket_members(df, spec).groupBy("bucket_key").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def duplicates(df: DataFrame, spec: Spec = SPEC, limit: int = 500) -> DataFrame:
    """Names of more than one record, most first: name, n, and the sources, sorted and cut at 200 characters."""
    grouped = df.where(filled(spec.name)).groupBy(F.upper(F.trim(spec.name)).alias("_key")).agg(
        F.max(spec.name).alias("name"), F.count("*").alias("n"), F.substring(F.array_join(F.sort_array(F.collect_set(spec.source)), ", "), 1, 200).alias("sources")
    )
    return grouped.where("n > 1").orderBy(F.desc("n"), "_key").limit(limit).drop("_key")


def top(df: DataFrame, field: str, limit: int = 20) -> DataFrame:
    """The most frequent values of a field; blank ones are (blank)."""
    blank = F.when(F.trim(_text(field)) == "", F.lit("(blank)")).otherwise(F.trim(_text(field)))
    return df.groupBy(blank.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(min(limit, 100))


def summary(df: DataFrame, coverage: Sequence[str], spec: Spec = SPEC) -> DataFrame:
    """(metric, n): all records, distinct names and states, and how many have each field. One pass."""
    stats = df.agg(
        F.count("*").alias("records"), F.count_distinct(F.when(filled(spec.name), name_key(spec.name))).alias("distinct_names"), F.count_distinct(F.when(filled("state"), F.upper("state"))).alias("states"),
        *[count_of(filled(c)).alias(f"with_{c}") for c in coverage],
    )
    return stats.unpivot([], stats.columns, "metric", "n")


def quality_report(df: DataFrame, checked: Sequence[str], spec: Spec = SPEC) -> DataFrame:
    """(section, item, n): records by source, missing cells, terminals held twice, codes with several names, orphans, code names."""
    base = df.withColumn("_tid", code("tid")).withColumn("_mx", code("mxcode")).withColumn("_name", name_key(spec.name))
    by_source = base.groupBy(F.lit("source").alias("section"), F.col(spec.source).alias("item")).agg(F.count("*").alias("n"))
    orphan = ~filled("tid") & ~filled("mxcode") & ~filled("email") & ~filled("phone") & ~filled("account_number")
    one = base.agg(*[count_of(~filled(c)).alias(c) for c in checked], count_of(orphan).alias("orphans"), count_of(F.col(spec.name).rlike(r"^[0-9]+(\.[0-9]+)?$")).alias("code_names"))
    missing = one.select(*checked).unpivot([], list(checked), "item", "n").select(F.lit("missing").alias("section"), "item", "n")
    odd = one.select("orphans", "code_names").unpivot([], ["orphans", "code_names"], "item", "n").select(F.lit("odd").alias("section"), "item", "n")
    twice = base.where("_tid <> ''").groupBy("_tid").agg(F.count("*").alias("k")).where("k > 1").agg(F.count("*").alias("n")).select(F.lit("shared").alias("section"), F.lit("tid").alias("item"), "n")
    several = base.where("_mx <> '' and _name <> ''").groupBy("_mx").agg(F.count_distinct("_name").alias("k")).where("k > 1").agg(F.count("*").alias("n")).select(F.lit("shared").alias("section"), F.lit("mxcode").alias("item"), "n")
    return by_source.unionByName(missing).unionByName(odd).unionByName(twice).unionByName(several)


def identity(df: DataFrame, fields: Sequence[str], spec: Spec = SPEC) -> DataFrame:
    """Per field and canonical value: how many records, distinct names and spellings."""
    cells = F.filter(F.array(*[F.struct(F.lit(c).alias("field"), value(c, NOISE).alias("raw")) for c in fields]), lambda x: x["raw"] != "")
    return df.select(name_key(spec.name).alias("name"), F.inline(cells)).groupBy("field", F.upper("raw").alias("value")).agg(
        F.count("*").alias("n"), F.count_distinct(F.when(F.col("name") != "", F.col("name"))).alias("names"), F.count_distinct("raw").alias("spellings")
    )


def token_weights(df: DataFrame, spec: Spec = SPEC) -> DataFrame:
    """Per distinctive word of a name: in how many records it is, and its rarity log1p(N / df)."""
    n = df.agg(F.count("*").alias("records"))
    seen = df.select(F.explode(F.array_distinct(tokens(spec.name))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return seen.crossJoin(F.broadcast(n)).select("token", "df", F.log1p(F.col("records") / F.col("df")).alias("idf"))


def membership(df: DataFrame, columns: dict[str, str], spec: Spec = SPEC) -> DataFrame:
    """Per value: the sorted kinds of the columns that hold it."""
    kinds = F.create_map(*[F.lit(x) for c, k in columns.items() for x in (c, k)])
    return long_form(df, list(columns), spec).groupBy("value").agg(F.sort_array(F.collect_set(kinds[F.col("field")])).alias("kinds"))


def shared_values(df: DataFrame, fields: Sequence[str], least: int = 3, spec: Spec = SPEC) -> DataFrame:
    """Values that at least so many records hold, by field."""
    return long_form(df, fields, spec).groupBy("field", "value").agg(F.count_distinct("id").alias("n")).where(F.col("n") >= least)


def most_common(df: DataFrame, key: Sequence[str], c: str) -> DataFrame:
    """Per key the most frequent value of a column and its count; ties go to the least value. Values of a key need not fit in memory."""
    counts = df.where(filled(c)).groupBy(*key, F.col(c).alias("value")).agg(F.count("*").alias("n"))
    return counts.groupBy(*key).agg(F.min_by(F.struct("value", "n"), F.struct(-F.col("n"), F.col("value"))).alias("_")).select(*key, "_.value", "_.n")


def lookalikes(df: DataFrame, column: str, spec: Spec = SPEC) -> DataFrame:
    """Look-alike keys that stand for more than one spelling in a column, with the spellings."""
    cells = df.where(filled(column)).select(code(column).alias("value")).distinct()
    return cells.groupBy(lookalike_key("value").alias("key")).agg(F.array_join(F.sort_array(F.collect_list("value")), ",").alias("spellings"), F.count("*").alias("n")).where("n > 1")


def first_last(df: DataFrame, key: str, order: Sequence[str], column: str) -> DataFrame:
    """Per key the column in the first and in the last row of an order, without a window."""
    rank = F.struct(*order)
    return df.groupBy(key).agg(F.min_by(column, rank).alias(f"first_{column}"), F.max_by(column, rank).alias(f"last_{column}"))


def winner(df: DataFrame, key: str, name: str, score: str) -> DataFrame:
    """Per key the best name, its score, the runner-up and the margin; ties go to the lesser name.

    Two combining aggregates, one for the best and one for the best of the rest: no key's rows are sorted in one task.
    """
    rank = F.struct((-F.col(score)).alias("s"), F.col(name).alias("n"))
    best = df.groupBy(key).agg(F.min(rank).alias("_best"))
    rest = df.join(best, key).where(F.col(name) != F.col("_best.n")).groupBy(key).agg(F.min(rank).alias("_next"))
    margin = -F.col("_best.s") - F.coalesce(-F.col("_next.s"), F.lit(0.0))
    return best.join(rest, key, "left").select(key, F.col("_best.n").alias("winner"), (-F.col("_best.s")).alias("score"), F.col("_next.n").alias("runner_up"), margin.alias("margin"))
