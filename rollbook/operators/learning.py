"""What logs of requests and decisions teach: acceptance by band, thresholds, rephrasings, phrases, exemplars."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions.similarity import cosine
from rollbook.functions.text import _text, ngrams


def bands(log: DataFrame, confidence: str, accepted: Column, width: int = 20) -> DataFrame:
    """Per band of confidence: how many decisions, how many accepted, and the share."""
    low = (F.floor(F.col(confidence) / width) * width).cast("int").alias("band")
    return log.groupBy(low).agg(F.count("*").alias("n"), F.sum(accepted.cast("long")).alias("accepted")).withColumn("rate", F.round(F.col("accepted") / F.col("n"), 6))


def threshold(found: DataFrame, target: float = 0.8, least: int = 3, default: float = 60, low: float = 20, high: float = 90, enough: int = 20, top: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """From the highest band (columns band, n, rate) downwards: bands that hold lower the threshold to their floor, the first that misses the target raises it to its top.

    Bands of fewer than ``least`` decisions say nothing; with fewer than ``enough`` in all the default stays. A band's
    top is the column ``top``, else the next band's floor 20 on. Columns threshold and n_decisions, per ``by`` if given.
    """
    edge = F.col(top) if top else F.col("band") + 20
    told = F.col("n") >= least
    missed = F.max(F.when(told & (F.col("rate") < target), F.struct(F.col("band").alias("band"), edge.alias("top"))))
    spread = found.groupBy(*by).agg(missed.alias("missed"), F.min(F.when(told, F.col("band"))).alias("floor"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_decisions"))
    fitted = F.when(F.col("missed").isNotNull(), F.least(F.col("missed.top"), F.lit(high))).otherwise(F.least(F.lit(default), F.coalesce("floor", F.lit(default))))
    kept = F.when(F.col("n_decisions") >= enough, fitted).otherwise(F.lit(default))
    return spread.select(*by, F.greatest(F.lit(low), F.least(F.lit(high), kept)).alias("threshold"), "n_decisions")


#: Edges of the bands of the gap between the two best scores.
GAPS = (0.0, 1.0, 2.0, 3.0, 4.0, 6.0)


def gap_bands(log: DataFrame, gap: str, accepted: Column) -> DataFrame:
    """Decisions by band of the gap at which they were asked; gaps beyond the last band are left out."""
    edges = list(zip(GAPS, GAPS[1:], strict=False))
    band, top = F.lit(None).cast("double"), F.lit(None).cast("double")
    for a, b in edges:
        band, top = F.when((F.col(gap) >= a) & (F.col(gap) < b), a).otherwise(band), F.when((F.col(gap) >= a) & (F.col(gap) < b), b).otherwise(top)
    rows = log.select(band.alias("band"), top.alias("top"), accepted.cast("long").alias("_ok")).where("band is not null")
    return rows.groupBy("band", "top").agg(F.count("*").alias("n"), F.sum("_ok").alias("accepted")).withColumn("rate", F.round(F.col("accepted") / F.col("n"), 6))


def gap_threshold(found: DataFrame, target: float = 0.8) -> DataFrame:
    return threshold(found, target, default=4.0, low=0.5, high=6.0, top="top")


def acceptance(log: DataFrame, by: str, accepted: Column) -> DataFrame:
    """Decisions and the share accepted, by intent, source or the like."""
    return log.groupBy(by).agg(F.count("*").alias("n"), F.sum(accepted.cast("long")).alias("accepted")).withColumn("rate", F.round(F.col("accepted") / F.col("n"), 6))


def rephrased(log: DataFrame, window: int = 1200) -> DataFrame:
    """(id, rephrased_by): requests without rows, and the first later one within the window (seconds) that shares an entity and has another text.

    log: id, ts (timestamp), text, rows, entities (array). Texts are compared without case and outer spaces. Requests
    are kept by entity and stretch of a window's length: of each stretch the next two hold all that a request needs (the
    first request after it, and the first with another text than that), so an entity that a third of all requests
    name meets in no task. No pairs are formed.
    """
    each = log.select("id", F.col("ts").cast("timestamp").alias("ts"), F.lower(F.trim(_text("text"))).alias("text"), F.coalesce("rows", F.lit(0)).alias("rows"), F.explode(F.array_distinct(F.filter("entities", lambda e: e.isNotNull() & (e != "")))).alias("entity"))
    each = each.withColumn("stretch", F.floor(F.unix_timestamp("ts") / window))
    key = ["entity", "stretch"]
    order = Window.partitionBy(*key).orderBy("ts", "id")
    # Runs of one text: the next run's first request is the next with another text.
    changed = (F.coalesce(F.lag("text").over(order) != F.col("text"), F.lit(True))).cast("int")
    runs = each.withColumn("run", F.sum(changed).over(order))
    me = F.struct("ts", "id", "text")
    firsts = runs.groupBy(*key, "run").agg(F.min(me).alias("first"))
    later = firsts.select(*key, (F.col("run") - 1).alias("run"), F.col("first").alias("inside"))
    ahead = firsts.where("run <= 2").groupBy(*key).agg(F.min(F.when(F.col("run") == 1, F.col("first"))).alias("one"), F.min(F.when(F.col("run") == 2, F.col("first"))).alias("two"))
    ahead = ahead.withColumn("stretch", F.col("stretch") - 1)
    failed = runs.where("rows <= 0").join(later, [*key, "run"], "left").join(ahead, key, "left")
    by = F.coalesce("inside", F.when(F.col("one.text") != F.col("text"), F.col("one")).otherwise(F.col("two")))
    near = failed.withColumn("by", by).where(F.col("by").isNotNull() & (F.unix_micros("by.ts") - F.unix_micros("ts") <= window * 1_000_000))
    return near.groupBy("id").agg(F.min(F.struct(F.col("by.ts").alias("ts"), F.col("by.id").alias("id"))).alias("_")).select("id", F.col("_.id").alias("rephrased_by"))


def outcomes(log: DataFrame, now: Column, window: int = 1200) -> DataFrame:
    """(outcome, n): accepted if a request had rows, rephrased, abandoned once the window has passed, else pending."""
    tagged = log.join(rephrased(log, window), "id", "left")
    old = F.unix_micros(now) - F.unix_micros(F.col("ts").cast("timestamp")) > window * 1_000_000
    outcome = F.when(F.col("rephrased_by").isNotNull(), "rephrased").when(F.coalesce("rows", F.lit(0)) > 0, "accepted").when(old, "abandoned").otherwise("pending")
    return tagged.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def review_precision(decisions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Per intent: reviewed decisions, how many were right, and the share; of several reviews of an entry the latest counts."""
    latest = reviews.groupBy("entry_id").agg(F.max_by("correct", "ts").alias("correct"))
    return decisions.join(latest, "entry_id").groupBy("intent").agg(F.count("*").alias("n"), F.count_if("correct").alias("right")).withColumn("precision", F.round(F.col("right") / F.col("n"), 6))


def without_parts(mined: DataFrame) -> DataFrame:
    """Phrases (gram, label, n) less those that are part of a longer one of their label with at least as many requests.

    Each phrase is joined with the shorter runs of words in it, which are few, so no pairs of phrases are formed. As a
    longer phrase never has more requests than its parts, only those with as many drop a part.
    """
    words = F.split("gram", " ")
    parts = mined.select("label", F.col("n").alias("_n"), F.size(words).alias("_w"), F.explode(F.array_distinct(ngrams(words, 3))).alias("gram"))
    covered = parts.where(F.size(F.split("gram", " ")) < F.col("_w")).groupBy("label", "gram").agg(F.max("_n").alias("_most"))
    return mined.join(covered, ["label", "gram"], "left").where("_most is null or _most < n").drop("_most")


def suggestions(mined: DataFrame, known: DataFrame, rejected: DataFrame) -> DataFrame:
    """Mined phrases that are neither known already (gram) nor rejected (gram, label)."""
    return mined.join(known, "gram", "left_anti").join(rejected, ["gram", "label"], "left_anti")


def intents(requests: DataFrame, text: str, patterns: Mapping[str, Mapping[str, float]], most: int = 2) -> DataFrame:
    """Every request with a score per intent that it matches: weight times matches, ``most`` at most, and a confidence to 100."""
    lowered = F.lower(_text(text))

    def score(words):
        total = F.lit(0.0)
        for pattern, weight in words.items():
            total = total + F.least(F.regexp_count(lowered, F.lit(pattern)), F.lit(most)) * F.lit(weight)
        return total

    cells = F.array(*[F.struct(F.lit(i).alias("intent"), score(words).alias("score")) for i, words in patterns.items()])
    scored = requests.select(*[c for c in requests.columns if c != text], F.inline(F.filter(cells, lambda x: x["score"] > 0)))
    return scored.withColumn("confidence", F.least(F.lit(100), F.floor(F.col("score") * 12)).cast("int"))


def phrases(requests: DataFrame, text: str, label: str, least: int, most_words: int = 3) -> DataFrame:
    """(gram, label, n): runs of one to three words by the label of the requests that have them, each request once."""
    words = F.filter(F.split(F.lower(_text(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = requests.select(F.col(label).alias("label"), words.alias("_words")).select("label", F.explode(F.array_distinct(ngrams(F.col("_words"), most_words))).alias("gram"))
    return grams.groupBy("gram", "label").agg(F.count("*").alias("n")).where(F.col("n") >= least)


#: Exemplars that vectors are held against in one pass, at most.
MOST_EXEMPLARS = 4096


def means(vectors: DataFrame) -> DataFrame:
    """(label, exemplar): the mean of all vectors (label, embedding) of each label."""
    each = vectors.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return each.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "v")))["v"].alias("exemplar"))


def best_exemplar(vectors: DataFrame, exemplars: DataFrame) -> DataFrame:
    """Per vector (vec_id, embedding): the intent of the likest exemplar (label, exemplar), similarity and margin to the next intent.

    Exemplars are a stated set of phrases, MOST_EXEMPLARS at most, which is checked. They travel to the vectors as one
    array, and each vector is ranked in its own row: vectors are neither multiplied nor exchanged."""
    rows = exemplars.limit(MOST_EXEMPLARS + 1).collect()
    if len(rows) > MOST_EXEMPLARS:
        raise ValueError(f"more than {MOST_EXEMPLARS} exemplars: search an index instead")
    held = vectors.sparkSession.createDataFrame([([(r["label"], [float(x) for x in r["exemplar"]]) for r in rows],)], "held array<struct<label:bigint,exemplar:array<double>>>")
    each = vectors.select("vec_id", "embedding").crossJoin(F.broadcast(held))
    scores = F.transform("held", lambda e: F.struct(F.round(cosine(F.col("embedding"), e["exemplar"]), 6).alias("s"), (-e["label"]).alias("minus")))
    ranked = each.select("vec_id", F.sort_array(scores, asc=False).alias("_r")).withColumn("_best", F.get("_r", F.lit(0)))
    second = F.get(F.filter("_r", lambda x: x["minus"] != F.col("_best.minus")), F.lit(0))
    return ranked.select("vec_id", (-F.col("_best.minus")).alias("label"), F.col("_best.s").alias("similarity"), F.round(F.col("_best.s") - F.coalesce(second["s"], F.lit(0.0)), 6).alias("margin"))
