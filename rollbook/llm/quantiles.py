"""Exact quantiles of many groups at once, found digit by digit.

Numbers that are not negative have the order of their 64 bits. A round counts, for each rank that is sought, the
values that share the bits found so far by their next eight; the eighth round ends at the value itself. Counts are
added up before they move, so a group as large as the table is spread like any other: what meets of it in a task is
at most 256 counts for each run of bits that a sought rank lies in. The table of values is read nine times.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

_DIGIT = 8


def bits(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values, none of which may be negative (a negative zero is zero)."""
    return (values.astype(np.float64) + 0.0).view(np.int64)


def quantiles(values: DataFrame, levels: Callable[[tuple], list[float]], least: int = 1) -> dict[tuple, list[float]]:
    """For each group of at least so many values its quantiles at levels(group), as numpy.quantile gives them.

    values: a column ``bits`` (see there); all its other columns, none null, name the group. The driver holds a few
    numbers for each group that is large enough.
    """
    by = [c for c in values.columns if c != "bits"]
    sizes = {tuple(r[c] for c in by): r["_n"] for r in values.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).collect()}
    spots = {key: [(n - 1) * q for q in levels(key)] for key, n in sizes.items()}
    found = {(*key, rank): (0, 0) for key, at in spots.items() for h in at for rank in {math.floor(h), math.ceil(h)}}
    for shift in range(64 - _DIGIT, -1, -_DIGIT):
        found = _refine(values, by, found, shift) if found else found
    value = {key: float(np.int64(start).view(np.float64)) for key, (start, _) in found.items()}
    return {key: [float(np.quantile([value[*key, math.floor(h)], value[*key, math.ceil(h)]], h - math.floor(h))) for h in at] for key, at in spots.items()}


def _refine(values: DataFrame, by: list[str], found: dict[tuple, tuple[int, int]], shift: int) -> dict[tuple, tuple[int, int]]:
    """found: by group and rank the leading bits of the value sought, and how many of the group are below all with these bits."""
    schema = StructType([values.schema[c] for c in by])
    for name in ("_rank", "_start", "_below"):
        schema = schema.add(name, LongType())
    sought = values.sparkSession.createDataFrame([(*key, *state) for key, state in found.items()], schema)
    known = shift + _DIGIT
    start = F.shiftright("bits", known) if known < 64 else F.lit(0).cast("long")
    counts = (
        values.withColumn("_start", start).join(F.broadcast(sought.select(*by, "_start").distinct()), [*by, "_start"])
        .groupBy(*by, "_start", F.shiftright("bits", shift).alias("_next")).agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy(*by, "_start").orderBy("_next").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    )
    hits = counts.join(F.broadcast(sought), [*by, "_start"]).withColumn("_below", F.col("_below") + F.col("_before")).where("_rank >= _below and _rank < _below + _n")
    return {(*(r[c] for c in by), r["_rank"]): (r["_next"], r["_below"]) for r in hits.select(*by, "_rank", "_next", "_below").collect()}
