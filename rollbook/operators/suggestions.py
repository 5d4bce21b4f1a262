"""Help with requests that find nothing or too little: other wordings, words run together, beginnings with a typo, aliases of all names, results word by word."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions import similarity as sim
from rollbook.functions.text import GENERIC_WORDS, TYPOS, _text

#: The shortest part of a word run together, what a known part counts, and what two add.
PART, KNOWN, BOTH_KNOWN = 3, 50, 50
#: The shortest beginning that is compared, and the least likeness; least score of a hit; most suggestions.
TYPED, LIKE, HIT, MOST = 3, 0.72, 50, 6


def variants(queries: DataFrame, typos: dict[str, str] | None = None, generic: Sequence[str] = GENERIC_WORDS) -> DataFrame:
    """(query, place, variant): each query less one word, with one known misspelling put right, and without generic words; each once, in that order, never empty nor the query itself."""
    q = queries.select(F.trim(_text("query")).alias("query")).where("query <> ''").distinct()
    words = F.split("query", r"\s+")
    less = F.transform(words, lambda _, i: F.array_join(F.filter(words, lambda w, k: k != i), " "))
    low = F.lower("query")
    fixes = TYPOS if typos is None else typos
    right = F.array(*[F.when(low.contains(a.lower()), F.replace(low, F.lit(a.lower()), F.lit(b.lower()))) for a, b in fixes.items()]) if fixes else F.array().cast("array<string>")
    core = F.array_join(F.filter(words, lambda w: ~F.upper(w).isin(*generic)), " ")
    every = F.filter(F.concat(less, right, F.array(core)), lambda v: v.isNotNull() & (F.trim(v) != ""))
    rows = q.select("query", F.posexplode(every).alias("place", "variant")).where(F.lower("variant") != low)
    return rows.groupBy("query", F.lower("variant").alias("_v")).agg(F.min(F.struct("place", "variant")).alias("_m")).select("query", "_m.place", "_m.variant")


def did_you_mean(queries: DataFrame, search: Callable[[DataFrame], DataFrame], most: int = MOST, **wording) -> DataFrame:
    """(query, place, variant, id, score): for queries that find nothing at HIT or above, the first ``most`` variants that do, with their best record.

    ``search`` gives query, place, id and score for a table of queries; it runs once over the queries and once over the variants of those that fail.
    """
    asked = queries.select(F.trim(_text("query")).alias("query")).where("query <> ''").distinct()
    failed = asked.join(search(asked).where(F.col("score") >= HIT).select("query").distinct(), "query", "left_anti")
    tries = variants(failed, **wording)
    hits = search(tries.select(F.col("variant").alias("query")).distinct()).where((F.col("score") >= HIT) & (F.col("place") == 1)).select(F.col("query").alias("variant"), "id", "score")
    order = Window.partitionBy("query").orderBy("place")
    return tries.join(hits, "variant").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("query", "place", "variant", "id", "score")


def compounds(words: DataFrame, vocabulary: DataFrame, first: Sequence[str] = (), second: Sequence[str] = ()) -> DataFrame:
    """(word, prefix, suffix): words of seven letters or more cut in two where both parts are known or occur; the best cut of each.

    vocabulary: word, n (records that hold it). A known part (``first``, ``second``) counts 50, two of them 50 more,
    others as often as they occur; ties go to the shorter prefix. Every cut is a row, so it is two joins by word.
    """
    w = words.select(F.upper(F.trim(_text("word"))).alias("word")).where(F.length("word") >= 2 * PART + 1).distinct()
    cuts = w.select("word", F.explode(F.sequence(F.lit(PART), F.length("word") - PART)).alias("_at"))
    cuts = cuts.select("word", "_at", F.substr("word", F.lit(1), F.col("_at")).alias("prefix"), F.substr("word", F.col("_at") + 1, F.length("word")).alias("suffix"))
    n = vocabulary.groupBy(F.upper("word").alias("_w")).agg(F.sum("n").alias("_n"))
    known = lambda c, listed: F.col(c).isin(*listed) if listed else F.lit(False)
    for part, listed in (("prefix", first), ("suffix", second)):
        held = n.select(F.col("_w").alias(part), F.col("_n").alias(f"_{part}"))
        cuts = cuts.join(held, part, "left").withColumn(f"_{part}", F.when(known(part, listed), F.lit(KNOWN)).otherwise(F.col(f"_{part}"))).where(F.col(f"_{part}") > 0)
    score = F.col("_prefix") + F.col("_suffix") + F.when(known("prefix", first) & known("suffix", second), BOTH_KNOWN).otherwise(0)
    best = cuts.groupBy("word").agg(F.max_by(F.struct("prefix", "suffix"), F.struct(score, -F.col("_at"))).alias("_b"))
    return best.select("word", "_b.prefix", "_b.suffix")


def prefix_matches(keys: DataFrame, key: str, typed: DataFrame, limit: int = 8) -> DataFrame:
    """(typed, place, key): keys that begin nearly as typed (column typed), the likest first, then the shorter, then by letter.

    Beginnings are compared up to the shorter one's length, a swap of neighbours as one edit, and must share the first
    letter. A swap is two plain edits, so a built-in distance rules out most pairs before the Arrow kernel.
    """
    t = typed.select(F.upper(F.trim(_text("typed"))).alias("typed")).where(F.length("typed") >= TYPED).distinct().withColumn("_c", F.substr("typed", F.lit(1), F.lit(1)))
    k = keys.select(F.upper(F.trim(_text(key))).alias("key")).where("key <> ''").distinct().withColumn("_c", F.substr("key", F.lit(1), F.lit(1)))
    n = F.least(F.length("typed"), F.length("key"))
    rows = t.join(k, "_c").select("typed", "key", F.substr("typed", F.lit(1), n).alias("_a"), F.substr("key", F.lit(1), n).alias("_b"))
    rows = rows.where(F.levenshtein("_a", "_b") <= 2 * (1 - LIKE) * F.length("_a"))
    rows = rows.withColumn("_like", sim.udf("damerau_similarity")("_a", "_b")).where(F.col("_like") >= LIKE)
    order = Window.partitionBy("typed").orderBy(F.desc("_like"), F.length("key"), "key")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("typed", "place", "key")


def generated_aliases(c: Column | str, generic: Sequence[str] = GENERIC_WORDS) -> Column:
    """Shorter forms of a name, sorted: in capitals, without generic words, each other word of three letters or more, and with each generic word cut out wherever it stands, itself and without other generic words."""
    name = F.trim(_text(c))
    up = F.upper(name)
    words = F.filter(F.split(up, r"\s+"), lambda w: w != "")
    core = F.filter(words, lambda w: ~w.isin(*generic))
    cut = F.size(core) < F.size(words)
    long = lambda a: F.filter(a, lambda w: ~w.isin(*generic) & (F.length(w) >= PART))
    holes = F.filter(F.array(*map(F.lit, generic)), lambda g: F.contains(up, g))
    bare = F.filter(F.transform(holes, lambda g: F.trim(F.regexp_replace(up, F.concat(F.lit(r"\s*"), g, F.lit(r"\s*")), F.lit(" ")))), lambda s: (s != "") & (s != up))
    inner = F.transform(bare, lambda s: F.array_join(long(F.split(s, r"\s+")), " "))
    none = F.array().cast("array<string>")
    every = F.concat(F.array(name, up), F.when(cut, F.concat(F.array(F.array_join(core, " ")), long(core))).otherwise(none), bare, inner)
    return F.array_sort(F.array_distinct(F.filter(every, lambda a: a.isNotNull() & (a != ""))))


def all_aliases(df: DataFrame, name: str = "merchant_name") -> DataFrame:
    """(alias, target): the generated aliases of all distinct names, less the names themselves; an alias that several names have is there for each."""
    names = df.select(F.trim(_text(name)).alias("target")).where("target <> ''").distinct()
    return names.select(F.explode(generated_aliases("target")).alias("alias"), "target").where("alias <> target").distinct()


def by_word(found: DataFrame, limit: int = 20) -> DataFrame:
    """(query, place, name, overall, matched): names that a query's words found, by how many found them, then by mean score.

    found: query, word, name, score, the results of a search of each word by itself; of a word's rows with one name the best counts.
    """
    one = found.groupBy("query", "word", "name").agg(F.max("score").alias("score"))
    rows = one.groupBy("query", "name").agg(F.round(F.avg("score"), 1).alias("overall"), F.array_sort(F.collect_set("word")).alias("matched"))
    order = Window.partitionBy("query").orderBy(F.desc(F.size("matched")), F.desc("overall"), "name")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("query", "place", "name", "overall", "matched")


def described(fields: Sequence[str], separator: str = " | ") -> Column:
    """A record as one line of ``field: value`` for those that are not blank."""
    cells = [F.when(F.trim(_text(f)) != "", F.concat(F.lit(f"{f}: "), F.trim(_text(f)))) for f in fields]
    return F.array_join(F.filter(F.array(*cells), lambda x: x.isNotNull()), separator)
