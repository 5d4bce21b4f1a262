"""What a new build must show before it is used: filled columns, sheets that came through, requests that find something."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.functions.text import _text


def content(df: DataFrame, filled: Mapping[str, int], sheets: Mapping[str, int] | None = None) -> DataFrame:
    """(check, name, n, least, ok): records with each column filled, and records of sheets whose name has a fragment, against the least there must be. One pass; a column that is missing has none."""
    counts = {("filled", c): (F.count_if(F.trim(_text(F.col(c).cast("string"))) != "") if c in df.columns else F.lit(0).cast("bigint")) for c in filled}
    counts |= {("sheet", s): F.count_if(F.contains(F.lower(_text("sheet_name")), F.lit(s.lower()))) for s in sheets or {}}
    least = {("filled", c): n for c, n in filled.items()} | {("sheet", s): n for s, n in (sheets or {}).items()}
    row = df.agg(F.count("*").alias("_all"), *[c.alias(f"_{i}") for i, c in enumerate(counts.values())])
    cells = F.array(*[F.struct(F.lit(k).alias("check"), F.lit(name).alias("name"), F.col(f"_{i}").cast("bigint").alias("n"), F.lit(least[k, name]).cast("bigint").alias("least")) for i, (k, name) in enumerate(counts)])
    return row.select(F.inline(cells)).withColumn("ok", F.col("n") >= F.col("least"))


def samples(queries: DataFrame, found: DataFrame, least: int = 1) -> DataFrame:
    """(check, name, n, least, ok): how many results (query, id) each sample request has."""
    n = found.groupBy("query").agg(F.count("*").alias("n"))
    rows = queries.select("query").distinct().join(n, "query", "left")
    return rows.select(F.lit("sample").alias("check"), F.col("query").alias("name"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.lit(least).cast("bigint").alias("least")).withColumn("ok", F.col("n") >= F.col("least"))


def passed(checks: DataFrame) -> DataFrame:
    """(passed, failed): whether all checks hold, and the names of those that do not, sorted."""
    return checks.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("passed"), F.array_sort(F.collect_list(F.when(~F.col("ok"), F.concat_ws(":", "check", "name")))).alias("failed"))
