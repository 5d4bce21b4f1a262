"""A second tier's decisions beside the first: what reviewers say of them, how the log stands, and the gates that follow.

Decisions: entry_id, ts, intent, confidence (0 to 100), margin, would_act. Reviews: entry_id, ts, correct, actual; the
latest of an entry counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.operators.learning import threshold

#: Edges of the bands of confidence and margin, the gates without evidence, their bounds, and the least evidence.
CONFIDENCE = (0, 20, 40, 60, 80, 101)
MARGIN = (0, 10, 20, 30, 40, 101)
GATE, GATE_BOUNDS = 65, (40, 90)
LEAD, LEAD_BOUNDS = 15, (0, 40)
ENOUGH, LEAST, TARGET = 20, 3, 0.8
#: Misses shown for an intent.
SHOWN = 5


def labelled(decisions: DataFrame, reviews: DataFrame) -> DataFrame:
    """decisions with correct and actual of their latest review; null without one."""
    latest = reviews.groupBy("entry_id").agg(F.max_by(F.struct(F.coalesce("correct", F.lit(False)).alias("correct"), "actual"), F.struct("ts", "correct", "actual")).alias("_r"))
    return decisions.join(latest, "entry_id", "left").select(*decisions.columns, F.col("_r.correct").alias("correct"), F.col("_r.actual").alias("actual"))


def review(entries: DataFrame, band: str = "all", limit: int = 100) -> DataFrame:
    """The newest ``limit`` entries of a band: all, would_act or would_not."""
    acts = F.coalesce("would_act", F.lit(False))
    rows = entries if band == "all" else entries.where(acts if band == "would_act" else ~acts)
    return rows.orderBy(F.col("ts").desc_nulls_last(), F.desc("entry_id")).limit(limit)


def precision(entries: DataFrame) -> DataFrame:
    """(intent, reviewed, correct, precision, missed_as): the reviewed decisions that would have acted; missed_as holds what the last SHOWN wrong ones should have been, oldest first."""
    acted = entries.where("would_act and correct is not null").withColumn("intent", F.coalesce("intent", F.lit("?")))
    counts = acted.groupBy("intent").agg(F.count("*").alias("reviewed"), F.count_if("correct").alias("correct"))
    wrong = acted.where("not correct and actual <> ''").withColumn("_n", F.row_number().over(Window.partitionBy("intent").orderBy(F.col("ts").desc_nulls_last(), F.desc("entry_id")))).where(F.col("_n") <= SHOWN)
    last = wrong.groupBy("intent").agg(F.sort_array(F.collect_list(F.struct((-F.col("_n")).alias("n"), "actual")))["actual"].alias("missed_as"))
    rows = counts.join(last, "intent", "left")
    return rows.select("intent", "reviewed", "correct", F.round(F.col("correct") / F.col("reviewed"), 3).alias("precision"), F.coalesce("missed_as", F.array().cast("array<string>")).alias("missed_as"))


def health(entries: DataFrame, today: Column) -> DataFrame:
    """(total, today, would_act, would_not, reviewed, last_ts) of the whole log; ``today`` is a date."""
    acts = F.coalesce("would_act", F.lit(False))
    return entries.agg(
        F.count("*").alias("total"), F.count_if(F.to_date("ts") == today).alias("today"), F.count_if(acts).alias("would_act"), F.count_if(~acts).alias("would_not"),
        F.count_if(F.col("correct").isNotNull()).alias("reviewed"), F.max("ts").alias("last_ts"),
    )


def _banded(rows: DataFrame, c: str, edges: tuple[int, ...], *by: str) -> DataFrame:
    """Per band of a value (band, top, n, rate); values outside the edges are left out."""
    cell = F.coalesce(F.col(c), F.lit(0))
    low, high = F.lit(None).cast("int"), F.lit(None).cast("int")
    for a, b in zip(edges, edges[1:], strict=False):
        low, high = F.when((cell >= a) & (cell < b), a).otherwise(low), F.when((cell >= a) & (cell < b), b).otherwise(high)
    rows = rows.withColumn("band", low).withColumn("top", high).where("band is not null")
    return rows.groupBy(*by, "band", "top").agg(F.count("*").alias("n"), (F.count_if("correct") / F.count("*")).alias("rate"))


def gates(entries: DataFrame) -> DataFrame:
    """(intent, samples, would_not_correct, precision, gate): the confidence from which an intent may act; null with fewer than ENOUGH reviewed decisions that would have.

    Bands of confidence are read from the top: one that holds lowers the gate to its floor, the first that misses the
    target raises it to its top. Right decisions that would not have acted, LEAST or more in a band below the gate,
    lower it to that band's floor, of several the highest.
    """
    told = entries.where("correct is not null").withColumn("intent", F.coalesce("intent", F.lit("?")))
    acted, passed = told.where("would_act"), told.where("not coalesce(would_act, false) and correct")
    counts = told.groupBy("intent").agg(F.count_if("would_act").alias("samples"), F.count_if(F.col("would_act") & F.col("correct")).alias("_right"), F.count_if(~F.coalesce("would_act", F.lit(False)) & F.col("correct")).alias("would_not_correct"))
    fitted = threshold(_banded(acted, "confidence", CONFIDENCE, "intent"), TARGET, LEAST, GATE, 0, GATE_BOUNDS[1], 0, "top", ("intent",)).select("intent", "threshold")
    below = _banded(passed, "confidence", CONFIDENCE, "intent").where(F.col("n") >= LEAST).join(fitted, "intent").where("band < threshold").groupBy("intent").agg(F.max("band").alias("_floor"))
    rows = counts.join(fitted, "intent", "left").join(below, "intent", "left")
    gate = F.greatest(F.lit(GATE_BOUNDS[0]), F.least("threshold", "_floor", F.lit(GATE_BOUNDS[1])))
    return rows.select("intent", "samples", "would_not_correct", F.round(F.try_divide("_right", "samples"), 3).alias("precision"), F.when(F.col("samples") >= ENOUGH, gate).cast("int").alias("gate"))


def lead(entries: DataFrame) -> DataFrame:
    """(threshold, n_decisions): the margin over the next intent from which the tier may act, one for all intents; LEAD with fewer than ENOUGH reviewed decisions."""
    return threshold(_banded(entries.where("correct is not null and would_act"), "margin", MARGIN), TARGET, LEAST, LEAD, *LEAD_BOUNDS, ENOUGH, "top")
