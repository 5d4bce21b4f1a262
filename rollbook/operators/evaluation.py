"""How well requests are understood and names found: routing against a golden set, drift, remembered phrases, new wordings, fitted weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions.text import _text
from rollbook.sources.shared import forget, written

#: Identifiers and filler words that a remembered phrase goes without.
IDENTIFIER = r"(?i)\b(?:MX\d{4,8}\b|\d{4}[A-Z]\d{3}\b|(?:[+]?234|0)[789]\d{9}\b|[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b|\d{6,12}\b|2ISW[A-Z0-9]{4,}\b)"
FILLERS = (
    "a", "an", "and", "any", "all", "are", "about", "above", "also", "below", "can", "could", "do", "for", "from", "get", "give", "given", "help", "i", "in", "info", "into", "is", "it", "its", "kindly", "me", "my", "need", "of", "on", "or", "out", "please",
    "pls", "provide", "show", "some", "than", "the", "their", "them", "then", "there", "these", "they", "this", "those", "to", "use", "used", "want", "we", "what", "which", "with", "would", "you", "your",
)
#: Counts of changed outcomes, and points of recall lost, that warn and that are critical.
DRIFTED = (1, 5)
RECALL_LOST = (2.0, 5.0)
LEVELS = ("ok", "warning", "critical")
#: How many wordings a phrase gives, and their lengths in characters (least) and words (most).
MOST_WORDINGS = 6
WORDING = (4, 4)


def routing(expected: Column, found: Column, asks: Column) -> Column:
    """A golden request's outcome: miss without an intent (null or resolve), clarify if it is asked back, routed or misroute."""
    none = found.isNull() | (found == "resolve")
    return F.when(none, "miss").when(F.coalesce(asks, F.lit(False)), "clarify").when(found == expected, "routed").otherwise("misroute")


def routing_matrix(rows: DataFrame) -> DataFrame:
    """(intent, routed, clarify, misroute, miss, n): how the requests of each intent came out."""
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in ("routed", "clarify", "misroute", "miss")]
    return rows.groupBy("intent").agg(*counts, F.count("*").alias("n"))


def drift(now: DataFrame, before: DataFrame) -> DataFrame:
    """(request, was, now): requests (request, outcome) of both that come out otherwise than before; of a request's repeated rows the least outcome counts."""
    one = lambda df, name: df.groupBy("request").agg(F.min("outcome").alias(name))
    return one(now, "now").join(one(before, "was"), "request").where("now <> was").select("request", "was", "now")


def level(n: Column, edges: tuple[float, float] = DRIFTED) -> Column:
    """ok, warning or critical, by how much there is of something bad; ok for null."""
    return F.when(n >= edges[1], LEVELS[2]).when(n >= edges[0], LEVELS[1]).otherwise(LEVELS[0])


def overall(scans: DataFrame) -> DataFrame:
    """(status): the worst status of all scans, ok without any."""
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("status"))
    return scans.agg(F.coalesce(F.max_by("status", rank), F.lit(LEVELS[0])).alias("status"))


def phrase_key(c: Column | str, names: Column | None = None) -> Column:
    """What a request asks, whoever it is about: lower case, without identifiers, the names given (an array) and fillers."""
    low = F.regexp_replace(F.lower(_text(c)), IDENTIFIER, " ")
    if names is not None:
        held = F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda n: n.isNotNull() & (n != ""))
        low = F.aggregate(held, low, lambda acc, n: F.replace(acc, F.lower(n), F.lit(" ")))
    return F.array_join(F.filter(F.split(F.trim(low), r"\s+"), lambda w: (w != "") & ~w.isin(*FILLERS)), " ")


def preferences(picks: DataFrame) -> DataFrame:
    """(key, intent): of picks (id, ts, key, action, intent) the last one learnt for a key, unless it was forgotten after; empty keys and intents teach nothing."""
    rows = picks.where("key <> '' and (action = 'forget' or intent <> '')")
    last = rows.groupBy("key").agg(F.max_by(F.struct("action", "intent"), F.struct("ts", "id")).alias("_l"))
    return last.where("_l.action = 'learn'").select("key", F.col("_l.intent").alias("intent"))


def wordings(phrases: DataFrame, synonyms: DataFrame, live: DataFrame, stop: Sequence[str] = FILLERS, most: int = MOST_WORDINGS) -> DataFrame:
    """(id, intent, phrase, source_phrase, source_word, synonym, conflict): phrases (intent, phrase) with one word in place of a synonym (word, synonym).

    Left out are wordings too short or long (WORDING) and those that hold a phrase of their intent already in force
    (live: intent, phrase); one that another intent has in force is in conflict. A phrase gives the first ``most`` by
    place of the word, then by synonym; that is the feature, a proposal for review.
    """
    words = F.split(F.trim(F.lower("phrase")), r"\s+")
    each = phrases.select("intent", F.trim(F.lower("phrase")).alias("source_phrase"), words.alias("_w")).where("source_phrase <> ''").distinct()
    each = each.select("intent", "source_phrase", "_w", F.posexplode("_w").alias("_at", "source_word")).where(~F.col("source_word").isin(*stop))
    other = synonyms.select(F.lower("word").alias("source_word"), F.lower("synonym").alias("synonym")).where("synonym <> ''").distinct()
    made = each.join(other, "source_word").withColumn("phrase", F.array_join(F.transform("_w", lambda w, i: F.when(i == F.col("_at"), F.col("synonym")).otherwise(w)), " "))
    made = made.where((F.length("phrase") >= WORDING[0]) & (F.size(F.split("phrase", " ")) <= WORDING[1]) & (F.col("phrase") != F.col("source_phrase")))
    made = made.groupBy("intent", "source_phrase", "phrase").agg(F.min(F.struct("_at", "synonym", "source_word")).alias("_m")).select("intent", "source_phrase", "phrase", "_m.*")
    held = live.select("intent", F.lower("phrase").alias("_live")).distinct()
    w, n = F.split("phrase", " "), F.size(F.split("phrase", " "))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.array_join(F.slice(w, i, k), " "))))
    covered = made.select("intent", "phrase", F.explode(F.array_distinct(runs)).alias("_live")).join(held, ["intent", "_live"], "left_semi").select("intent", "phrase").distinct()
    clash = held.select(F.col("_live").alias("phrase"), F.col("intent").alias("_i"))
    clash = made.select("intent", "phrase").distinct().join(clash, "phrase").where("_i <> intent").select("intent", "phrase", F.lit(True).alias("conflict")).distinct()
    made = made.join(covered, ["intent", "phrase"], "left_anti").join(clash, ["intent", "phrase"], "left").withColumn("conflict", F.coalesce("conflict", F.lit(False)))
    made = made.withColumn("_n", F.row_number().over(Window.partitionBy("intent", "source_phrase").orderBy("_at", "synonym"))).where(F.col("_n") <= most)
    return made.select(F.sha1(F.concat_ws("|", "intent", "phrase")).alias("id"), "intent", "phrase", "source_phrase", "source_word", "synonym", "conflict")


def _plain(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(_text(c)), "[^a-z0-9]", "")


def affinity(emails: Column, names: Column, fields: Sequence[str] = ("merchant_name", "slip_header", "account_name")) -> Column:
    """How a record agrees with what a golden request wants: 2 by an e-mail, 1 by a name within one of its fields, else 0. Letters and digits only; it is right if not 0."""
    mail = _plain("email")
    by_mail = (mail != "") & F.exists(F.coalesce(emails, F.array().cast("array<string>")), lambda e: _plain(e) == mail)
    text = lambda n: _plain(n)
    by_name = F.exists(F.coalesce(names, F.array().cast("array<string>")), lambda n: (text(n) != "") & F.greatest(*[F.contains(_plain(f), text(n)) for f in fields], F.lit(False)))
    return F.when(by_mail, 2).when(by_name, 1).otherwise(0)


def _hits(evidence: DataFrame, candidates: Sequence[Mapping[str, float]], floor: float) -> list[int]:
    """Of how many queries the record that each candidate's weights put first is right; one pass for all candidates."""

    def score(weights: Mapping[str, float]) -> Column:
        signals = [(F.coalesce(F.col(f) >= floor, F.lit(False)), F.col(f).cast("double"), float(w)) for f, w in weights.items()]
        held = sum((F.when(on, F.lit(w)).otherwise(0.0) for on, _, w in signals), F.lit(0.0))
        return F.when(held > 0, F.round(sum((F.when(on, s * w).otherwise(0.0) for on, s, w in signals), F.lit(0.0)) / held, 9)).otherwise(0.0)

    firsts = evidence.groupBy("query").agg(*[F.max_by("correct", F.struct(score(w), -F.col("id"))).alias(f"_{i}") for i, w in enumerate(candidates)])
    row = firsts.agg(*[F.count_if(f"_{i}").alias(f"_{i}") for i in range(len(candidates))]).first()
    return list(row)


def fit_weights(evidence: DataFrame, weights: Mapping[str, int], factors: Sequence[float] = (0.5, 0.75, 1.25, 1.5, 2.0), floor: float = 30) -> tuple[dict[str, int], int]:
    """Weights that put a right record first for the most queries, and for how many.

    evidence: query, id, correct, and a score column for each field of ``weights``. One field is tried at a time, all
    its factors in one pass over the evidence; a round of fields that gains nothing ends it, so there are at most as
    many rounds as queries. Of equal gains the least weight is taken. A record's score is the weighted mean of its
    scores of ``floor`` or more; ties go to the smallest id.
    """
    table = written(evidence.select("query", "id", F.coalesce("correct", F.lit(False)).alias("correct"), *weights), "evidence")
    best, held = dict(weights), _hits(table, [weights], floor)[0]
    gained = True
    while gained:
        gained = False
        for field in weights:
            tries = [best | {field: max(0, int(best[field] * x))} for x in factors]
            tries = [t for t in tries if sum(t.values()) > 0]
            if not tries:
                continue
            most, least, i = max((n, -t[field], -i) for i, (n, t) in enumerate(zip(_hits(table, tries, floor), tries, strict=True)))
            if most > held:
                best, held, gained = tries[-i], most, True
    forget(table)
    return best, held
