"""Name search with explained scores, for lists of queries: candidates by joins, then each candidate's fields are scored.

Candidates are never all pairs: a record must share its bucket or a word with the query, or hold a word that is like
one of the query's (words are held against each other once, as a vocabulary, where they share a run of three letters),
or an identifier. Only candidates are scored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions import similarity as sim
from rollbook.functions.identifiers import code_like_name, looks_like_code, plausible_part
from rollbook.functions.text import _text, any_of, bucket_key, canonical, code, compact, email, lookalike_key, phone, phone_key, tokens, trigrams

#: What fields weigh, and which hold names.
WEIGHTS = {
    "merchant_name": 300, "slip_header": 40, "mxcode": 20, "payable_code": 10, "tid": 20, "account_name": 10, "email": 15, "phone": 10, "address": 15, "contact_name": 5, "terminal_serial": 5, "alias": 10,
}
NAMES = ("merchant_name", "slip_header", "account_name", "contact_name")
CODES = ("mxcode", "payable_code", "merchant_id", "tid", "account_number")
#: Least likeness of a matched word, least score that counts, boosts of fields, and where the kinds of match start.
LEAST_LIKE, SIGNAL, CODE_BOOST, KIND_BOOST = 0.60, 30.0, 8.0, 6.0
EXACT, HIGH, POSSIBLE = 95, 80, 50
#: Scores of a whole field, and the blends (of 100) of what its words say.
SAME, HAS_QUERY, IN_QUERY = 100.0, 90.0, 80.0
BLENDS = {"exact": {"exact": 70, "near": 15, "mean": 15}, "near": {"near": 50, "mean": 30, "whole": 20}, "whole": {"whole": 50, "edit": 30, "mean": 20}}
FAMILY_SCORE = 85.0


def field_measures(query: str, words: Sequence[str], value: str, own: Sequence[str], likeness: Sequence[float] | None) -> dict[str, float]:
    """What a field's words (own) say about the query's words: shares matched exactly and nearly, mean likeness, and both as whole strings."""
    best = [max((sim.ratio(w, o) for o in own), default=0.0) for w in words]
    distinct = set(words)
    near = sum(any(o != w and sim.ratio(w, o) >= LEAST_LIKE for o in own) for w in words)
    q, v = query[:80], value[:80]
    whole = max(sim.token_sort_ratio(q, v), sim.token_set_ratio(q, v), sim.partial_ratio(q, v) if 4 <= len(query) <= int(len(value) * 0.5) else 0.0)
    short = len(query) <= 15 and len(value) <= 15
    edit = max(sim.edit_similarity(query, value), sim.damerau_similarity(query, value)) if short else whole
    likeness = best if likeness is None else likeness
    return {"exact": len(distinct & set(own)) / len(distinct), "near": near / len(distinct), "mean": sum(likeness) / len(likeness), "whole": whole, "edit": edit}


def field_score(query: str, words: Sequence[str], value: str, own: Sequence[str], likeness: Sequence[float] | None = None) -> float:
    """0 to 100: how well a field answers a query (both upper case, trimmed)."""
    if value == query:
        return SAME
    if query in value:
        return HAS_QUERY
    if value in query:
        return IN_QUERY
    if not own or not words:
        return 0.0
    says = field_measures(query, words, value, own, likeness)
    blend = BLENDS["exact" if says["exact"] >= 0.5 else "near" if says["near"] >= 0.3 else "whole"]
    return round(min(100.0, sum(says[m] * n for m, n in blend.items())), 1)


def _upper(c: str) -> Column:
    return F.upper(F.trim(_text(c)))


def _fields(df: DataFrame) -> list[str]:
    return [f for f in WEIGHTS if f in df.columns]


def asked(queries: DataFrame) -> DataFrame:
    """Distinct queries that are not blank, with their words."""
    q = queries.select(F.trim(_text("query")).alias("query")).where("query <> ''").distinct()
    return q.select("query", _upper("query").alias("_q"), tokens("query").alias("_words"))


def likenesses(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, other): words and words of the vocabulary, both of one column, that are alike enough; pairs that share no run of three letters are not looked at."""
    grams = lambda t, c: t.select(F.col(c), F.explode(trigrams(F.col(c))).alias("_g"))
    pairs = grams(words.toDF("word"), "word").join(grams(vocabulary.toDF("other"), "other"), "_g").select("word", "other").distinct()
    return pairs.where(sim.udf("word_similarity")(F.col("word"), F.col("other")) >= LEAST_LIKE)


def candidates(df: DataFrame, q: DataFrame) -> DataFrame:
    """(query, id): records that share the bucket of a query or hold a word like one of its."""
    names = [c for c in NAMES if c in df.columns]
    held = df.select("id", F.explode(F.array_distinct(F.flatten(F.array(*[tokens(c) for c in names])))).alias("other"))
    wanted = q.select("query", F.explode(F.array_distinct("_words")).alias("word"))
    like = likenesses(wanted.select("word").distinct(), held.select("other").distinct()).union(wanted.select("word", "word").distinct()).distinct()
    by_word = wanted.join(like, "word").join(held, "other").select("query", "id")
    keys = df.select("id", bucket_key("merchant_name").alias("_k")).where("_k <> ''")
    by_bucket = q.select("query", bucket_key("query").alias("_k")).join(keys, "_k").select("query", "id")
    return by_word.union(by_bucket).distinct()


def runs(df: DataFrame, c: str, other: DataFrame, d: str) -> DataFrame:
    """df with the column _run: the distinct runs of c, c itself aside, that are as long as some value of ``other``'s d."""
    lengths = other.agg(F.array_sort(F.collect_set(F.length(d))).alias("_lengths"))
    of = lambda n: F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substr(c, i, n))
    shorter = F.filter("_lengths", lambda n: n < F.length(c))
    return df.crossJoin(F.broadcast(lengths)).withColumn("_run", F.explode(F.array_distinct(F.flatten(F.transform(shorter, of))))).drop("_lengths")


def _code_hits(df: DataFrame, q: DataFrame) -> DataFrame:
    """(query, id, order, hit, hit_score) of the code fields."""
    have = [c for c in CODES if c in df.columns]
    cells = df.select("id", F.inline(F.filter(F.array(*[F.struct(F.lit(i).alias("order"), F.lit(c).alias("hit"), compact(c).alias("cell")) for i, c in enumerate(have)]), lambda x: x["cell"] != "")))
    wanted = q.select("query", compact("query").alias("_c")).where(F.length("_c") >= 3)
    same = cells.withColumn("_k", lookalike_key("cell")).join(wanted.withColumn("_k", lookalike_key("_c")), "_k").select("query", "id", "order", "hit", F.when(F.col("cell") == F.col("_c"), 100.0).otherwise(98.0).alias("hit_score"))
    coded = wanted.where(looks_like_code("query"))
    values = cells.select("hit", "cell").where(F.length("cell") >= 3).distinct()
    has = runs(values, "cell", coded, "_c").join(coded, F.col("_run") == F.col("_c"))
    within = runs(coded, "_c", values, "cell").join(values, F.col("_run") == F.col("cell"))
    parts = has.select("query", "_c", "hit", "cell").union(within.select("query", "_c", "hit", "cell"))
    fits = any_of([(F.col("hit") == c) & (plausible_part(c, "_c") | plausible_part(c, "cell")) for c in have])
    part = parts.where(fits).select("query", "hit", "cell").join(cells, ["hit", "cell"]).select("query", "id", "order", "hit", F.lit(90.0).alias("hit_score"))
    return same.unionByName(part)


def identifier_hits(df: DataFrame, q: DataFrame) -> DataFrame:
    """(query, id, hit, hit_score): records whose identifier is the query (100), looks like it (98), or has it or is in it (90).

    Codes by their letters and digits; phones by their last ten digits; e-mails as they are. Parts count only for
    queries that look like a code, and for values plausible in their field. Of a record the best field counts.
    """
    hits = q.limit(0).select("query", F.lit(0).cast("bigint").alias("id"), F.lit(0).alias("order"), F.lit("").alias("hit"), F.lit(0.0).alias("hit_score"))
    if any(c in df.columns for c in CODES):
        hits = hits.unionByName(_code_hits(df, q))
    for i, (c, key) in enumerate((("phone", phone_key), ("email", email))):
        if c in df.columns:
            ok = F.length(phone("query")) >= 10 if c == "phone" else F.col("query").contains("@")
            own = df.select("id", key(c).alias("_k")).where("_k <> ''")
            hits = hits.unionByName(q.where(ok).select("query", key("query").alias("_k")).join(own, "_k").select("query", "id", F.lit(len(CODES) + i).alias("order"), F.lit(c).alias("hit"), F.lit(100.0).alias("hit_score")))
    return hits.groupBy("query", "id").agg(F.min_by(F.struct("hit", "hit_score"), F.struct(-F.col("hit_score"), "order")).alias("_")).select("query", "id", "_.*")


_SCORED = "likeness array<double>, scores array<double>"


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.select(["_q", "_words", "_values", "_own"]).to_pydict()
        likeness, scores = [], []
        for q, words, values, own in zip(*rows.values(), strict=True):
            like = [max((sim.word_similarity(w, o) for o in own[0]), default=0.0) for w in words]
            likeness.append(like)
            scores.append([0.0 if not v else field_score(q, words, v, o, like if i == 0 and words else None) for i, (v, o) in enumerate(zip(values, own, strict=True))])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(likeness, pa.list_(pa.float64())), pa.array(scores, pa.list_(pa.float64()))], names=[*batch.schema.names, "likeness", "scores"])


def scored(df: DataFrame, q: DataFrame, pairs: DataFrame, rarity: DataFrame | None = None, person_words: Sequence[str] = (), bank_words: Sequence[str] = ()) -> DataFrame:
    """The pairs (query, id, hit, hit_score; hit null without an identifier) with score, match_type, matched (words) and scores by field.

    rarity (token, idf) weighs words; a word without counts 1. person_words and bank_words are words by which queries
    for persons and banks are known.
    """
    fields = _fields(df)
    records = df.select("id", F.array(*[_upper(f) for f in fields]).alias("_values"), F.array(*[tokens(f) for f in fields]).alias("_own"), code_like_name("merchant_name").alias("_code"))
    rows = pairs.join(q, "query").join(records, "id")
    weights = F.transform("_words", lambda w: F.lit(1.0))
    if rarity is not None:
        words = q.select("query", F.posexplode("_words").alias("_p", "token")).join(rarity.select("token", "idf"), "token", "left")
        rows = rows.join(words.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("_p", F.coalesce("idf", F.lit(1.0)).alias("w")))).alias("_idf")), "query", "left")
        weights = F.coalesce(F.transform("_idf", lambda x: x["w"]), weights)
    rows = rows.withColumn("_weights", weights)
    rows = rows.mapInArrow(_score, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), _SCORED]))
    n = F.size("_words")
    matched = F.transform("likeness", lambda x: x >= LEAST_LIKE)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    covered = F.when(n > 0, total(F.zip_with(matched, "_weights", lambda m, w: F.when(m, w).otherwise(0.0))) / total(F.col("_weights"))).otherwise(0.0)
    rows = rows.withColumn("_cover", covered).withColumn("matched", F.filter("_words", lambda w, i: F.get(matched, i))).withColumn("_hits", F.size("matched"))
    bonus = F.when(F.col("hit").isNull() & (n > 1) & (F.col("_hits") > 0), F.least(F.greatest(F.col("_cover") * n - 1, F.lit(0.0)) * 0.10, F.lit(0.30))).otherwise(0.0)
    penalty = F.when(F.col("hit").isNull() & (n >= 3) & (F.col("_cover") < 0.5), 0.4 + 0.6 * F.col("_cover")).otherwise(1.0)
    own = {f: F.get("scores", F.lit(i)) * (penalty if f == "merchant_name" else 1.0) for i, f in enumerate(fields)}
    own = {f: F.when(F.col("hit") == f, F.col("hit_score")).otherwise(s) for f, s in own.items()}
    rows = rows.withColumn("_s", F.struct(*[s.alias(f) for f, s in own.items()]))
    score = {f: F.col("_s")[f] for f in fields}
    second = F.lit(False)
    if "slip_header" in fields or "account_name" in fields:
        strong = any_of([score[f] >= SIGNAL for f in ("slip_header", "account_name") if f in fields])
        second = F.col("hit").isNull() & strong & (F.col("_code") | ((n > 0) & (F.col("_hits") == 0)))
    person = (n <= 4) & F.arrays_overlap("_words", F.array(*map(F.lit, person_words))) if person_words else F.lit(False)
    bank = F.exists("_words", lambda t: any_of([t.contains(b) | F.lit(b).contains(t) for b in bank_words])) if bank_words else F.lit(False)
    weight = {}
    for f in fields:
        w = F.lit(float(WEIGHTS[f]))
        kind = person if f == "contact_name" else bank if f == "account_name" else None
        if kind is not None:
            w = F.when(F.col("hit").isNull() & kind, float(int(WEIGHTS[f] * KIND_BOOST))).otherwise(w)
        weight[f] = F.when(second, float(int(WEIGHTS[f] * CODE_BOOST))).otherwise(w) if f in ("slip_header", "account_name") else w
    add = lambda parts: sum(parts, F.lit(0.0))
    real = {f: score[f] >= SIGNAL for f in fields}
    on_signal = any_of([real[f] for f in NAMES if f in fields]) | F.col("hit").isNotNull() | second
    strong = add([F.when(real[f], score[f] * weight[f]).otherwise(0.0) for f in fields]) / F.nullif(add([F.when(real[f], weight[f]).otherwise(0.0) for f in fields]), F.lit(0.0))
    every = add([score[f] * weight[f] for f in fields]) / add(weight.values())
    base = F.round(F.least(F.when(on_signal, F.coalesce(strong, every)).otherwise(every) * (1 + bonus), F.lit(100.0)), 1)
    rows = rows.withColumn("_base", base)
    final = F.when(F.col("hit_score") >= 95, F.greatest("_base", F.lit(98.0))).when(F.col("hit_score") >= 85, F.greatest("_base", F.lit(90.0))).otherwise(F.col("_base"))
    kind = F.when(F.col("hit_score") >= 95, "Exact Match").when(F.col("hit_score") >= 85, "High Confidence").when(F.col("_base") >= EXACT, "Exact Match").when(F.col("_base") >= HIGH, "High Confidence").when(F.col("_base") >= POSSIBLE, "Possible Match").otherwise("Low Confidence")
    return rows.select("query", "id", final.alias("score"), kind.alias("match_type"), "matched", "hit", F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[F.round(score[f], 1) for f in fields])).alias("field_scores"))


def search(df: DataFrame, queries: DataFrame, limit: int = 50, min_score: float = 0.0, rarity: DataFrame | None = None, **words: Sequence[str]) -> DataFrame:
    """The ``limit`` best records of each query: best score first, then those with an e-mail address, then the least id.

    A record that is found both by name and by identifier has the better of the two scores. Adds place, from 1.
    """
    q = asked(queries)
    hits = identifier_hits(df, q)
    none = [F.lit(None).cast("string").alias("hit"), F.lit(None).cast("double").alias("hit_score")]
    found = scored(df, q, candidates(df, q).select("query", "id", *none).unionByName(hits), rarity, **words)
    best = found.groupBy("query", "id").agg(F.max_by(F.struct("score", "match_type", "matched", "hit", "field_scores"), F.struct("score", F.col("hit").isNull())).alias("_")).select("query", "id", "_.*").where(F.col("score") >= min_score)
    reach = df.select("id", (F.contains(_text("email"), F.lit("@")) if "email" in df.columns else F.lit(False)).alias("_mail"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("_mail"), "id")
    return best.join(reach, "id").withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).drop("_mail")


def with_family(df: DataFrame, found: DataFrame) -> DataFrame:
    """found, and the records that share the main code of a query's strong results (80 and up), or an e-mail on these, as Family Match.

    E-mails count from results under the main code, and from ones without a code from 85 on. Terminals that the
    family's results show already are left out, and each further one is there once.
    """
    rows = found.join(df.select("id", code("mxcode").alias("_mx"), email("email").alias("_mail"), code("tid").alias("_tid")), "id")
    strong = rows.where(F.col("score") >= HIGH)
    main = strong.where(F.col("_mx").startswith("MX")).groupBy("query", "_mx").agg(F.count("*").alias("_n"), F.min("place").alias("_p"))
    main = main.groupBy("query").agg(F.min_by("_mx", F.struct(-F.col("_n"), "_p")).alias("_main"))
    strong = strong.join(main, "query", "left")
    mails = strong.where(F.col("_mail").contains("@") & ((F.col("_mx") == F.col("_main")) | ((F.col("_mx") == "") & (F.col("score") >= FAMILY_SCORE)))).select("query", F.col("_mail").alias("_key")).distinct()
    keys = mails.union(main.select("query", "_main"))
    cells = lambda t, *more: t.select(*more, "id", "_tid", F.explode(F.filter(F.array("_mx", "_mail"), lambda x: x != "")).alias("_key"))
    shown = cells(rows, "query").join(keys, ["query", "_key"], "left_semi").where("_tid <> ''").select("query", "_tid").distinct()
    kin = cells(df.select("id", code("mxcode").alias("_mx"), email("email").alias("_mail"), code("tid").alias("_tid"))).join(keys, "_key").join(shown, ["query", "_tid"], "left_anti")
    kin = kin.groupBy("query", F.col("_tid")).agg(F.min("id").alias("id"), F.min_by("_key", "id").alias("_key"))
    kin = kin.join(found.select("query", "id"), ["query", "id"], "left_anti")
    more = kin.select("query", "id", F.lit(FAMILY_SCORE).alias("score"), F.lit("Family Match").alias("match_type"), F.array(F.concat(F.lit("family:"), "_key")).alias("matched"))
    return found.unionByName(more, allowMissingColumns=True)


def alias_targets(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """(query, target) by a table of aliases (position, alias, target), small by nature and joined, not collected.

    The canonical forms agree, else one is part of the other and four characters long or longer; the first in order counts.
    """
    q, a = queries.select("query", canonical("query").alias("_q")).distinct(), aliases.select("position", canonical("alias").alias("_a"), "target")
    same = (F.col("_q") == F.col("_a")).alias("_same")
    hits = q.join(a, (F.col("_q") == F.col("_a")) | ((F.length("_a") >= 4) & F.col("_q").contains(F.col("_a"))) | ((F.length("_q") >= 4) & F.col("_a").contains(F.col("_q")))).withColumn("_same", same)
    return hits.groupBy("query").agg(F.min_by("target", F.struct(~F.col("_same"), "position")).alias("target"))


def reconcile(df: DataFrame, queries: DataFrame, found: DataFrame) -> DataFrame:
    """A row per query: found if its best score reaches POSSIBLE, with the record, else the closest candidate's name; scores of ten."""
    best = found.where("place = 1")
    cells = df.select("id", *[_text(c).alias(c) for c in ("merchant_name", "tid", "mxcode", "email", "phone") if c in df.columns])
    rows = queries.select(F.trim(_text("query")).alias("query")).where("query <> ''").distinct().join(best, "query", "left").join(cells, "id", "left")
    ok = F.coalesce(F.col("score") >= POSSIBLE, F.lit(False))
    return rows.select("query", ok.alias("found"), F.round(F.coalesce("score", F.lit(0.0)) / 10, 1).alias("score"), F.coalesce("match_type", F.lit("Not Found")).alias("match_type"), *[F.coalesce(c, F.lit("")).alias(c) for c in cells.columns if c != "id"])


def quick_match(df: DataFrame, queries: DataFrame, found: DataFrame) -> DataFrame:
    """A row per identifier: matched if its best result was found by an identifier, at 85 or more."""
    rows = reconcile(df, queries, found).drop("found").join(found.where("place = 1").select("query", "hit", F.col("score").alias("_s")), "query", "left")
    return rows.withColumn("matched", F.coalesce(F.col("hit").isNotNull() & (F.col("_s") >= 85), F.lit(False))).drop("_s")


def reconcile_summary(rows: DataFrame) -> DataFrame:
    """(metric, n) of reconciled rows: all, found, not found, e-mails and contacts recovered, and the rate in per mille."""
    n = rows.agg(F.count("*").alias("total"), F.count_if("found").alias("found"), F.count_if(~F.col("found")).alias("not_found"), F.count_if(F.col("found") & (F.col("email") != "")).alias("emails"), F.count_if(F.col("found") & (F.col("phone") != "")).alias("contacts"))
    n = n.withColumn("rate_per_mille", F.coalesce(F.floor(1000 * F.try_divide("found", "total")), F.lit(0)))
    return n.unpivot([], n.columns, "metric", "n")


def recall(found: DataFrame, golden: DataFrame, depths: Sequence[int] = (1, 3)) -> DataFrame:
    """recall at depths, and the mean best score, over golden queries (query, id): the place of the first right record decides."""
    first = golden.select("query").distinct().join(found.join(golden, ["query", "id"]).groupBy("query").agg(F.min("place").alias("place")), "query", "left")
    top = found.where("place = 1").select("query", "score")
    rows = first.join(top, "query", "left")
    return rows.agg(*[F.round(F.avg(F.coalesce((F.col("place") <= k).cast("double"), F.lit(0.0))), 6).alias(f"recall_{k}") for k in depths], F.round(F.avg(F.coalesce("score", F.lit(0.0))), 6).alias("mean_score"))
