"""Registered queries of suggestions and encoders, on names and requests read off the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.functions.text import GENERIC_WORDS
from rollbook.operators import encoder, gates, governance, requests, shadow, suggestions
from rollbook.plans.catalogue import _table, query
from rollbook.sources import journals

_LISTED = "[" + ", ".join(f"'{w}'" for w in GENERIC_WORDS) + "]"
_NAMED = "p_name || case p_partkey % 4 when 0 then ' Ltd' when 1 then ' Nigeria Limited' when 2 then '' else ' of ' || p_brand end"


@query(f"""WITH n AS (SELECT DISTINCT {_NAMED} AS t FROM part), w AS (SELECT t, upper(t) AS u, string_split(upper(t), ' ') AS ws FROM n), c AS (SELECT *, list_filter(ws, lambda x: NOT list_contains({_LISTED}, x)) AS core FROM w),
    g AS (SELECT t, u, trim(regexp_replace(u, '\\s*' || g || '\\s*', ' ', 'g')) AS s FROM (SELECT t, u, unnest({_LISTED}) AS g FROM w) WHERE contains(u, g)),
    a AS (SELECT t, u AS alias FROM c UNION SELECT t, array_to_string(core, ' ') FROM c WHERE len(core) < len(ws) UNION SELECT t, unnest(list_filter(core, lambda x: length(x) >= 3)) FROM c WHERE len(core) < len(ws) UNION SELECT t, s FROM g WHERE s <> u
    UNION SELECT t, array_to_string(list_filter(string_split(s, ' '), lambda x: NOT list_contains({_LISTED}, x) AND length(x) >= 3), ' ') FROM g WHERE s <> u) SELECT DISTINCT alias, t AS target FROM a WHERE alias <> '' AND alias <> t""")
def all_aliases(spark, d):
    return suggestions.all_aliases(_table(spark, d, "part").selectExpr(f"{_NAMED} as merchant_name"))


_TWO = "replace(p_name, ' ', '')"


@query(f"""WITH v AS (SELECT upper(w) AS w, count(*) AS n FROM (SELECT unnest(list_distinct(string_split(p_name, ' '))) AS w FROM part) GROUP BY 1), c AS (SELECT word, unnest(range(3, length(word) - 2)) AS cut FROM (SELECT DISTINCT upper({_TWO}) AS word FROM part) WHERE length(word) >= 7),
    k AS (SELECT word, cut, left(word, cut) AS prefix, substr(word, cut + 1) AS suffix FROM c), s AS (SELECT k.*, CASE WHEN prefix IN ('RED', 'BLUE') THEN 50 ELSE a.n END + CASE WHEN suffix IN ('BOLT') THEN 50 ELSE b.n END + CASE WHEN prefix IN ('RED', 'BLUE') AND suffix = 'BOLT' THEN 50 ELSE 0 END AS score
    FROM k LEFT JOIN v a ON a.w = prefix LEFT JOIN v b ON b.w = suffix) SELECT word, arg_max(prefix, (score, -cut)) AS prefix, arg_max(suffix, (score, -cut)) AS suffix FROM s WHERE score IS NOT NULL GROUP BY word""")
def compound_words(spark, d):
    """Part names run together, cut where both parts are words of part names."""
    words = _table(spark, d, "part").select(F.explode(F.array_distinct(F.split("p_name", " "))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return suggestions.compounds(_table(spark, d, "part").selectExpr(f"{_TWO} as word"), words, ("RED", "BLUE"), ("BOLT",))


@query("""WITH f AS (SELECT o_orderkey % 200 AS query, o_orderstatus AS word, o_orderpriority AS name, max((o_custkey % 100)::DOUBLE) AS score FROM orders GROUP BY ALL), n AS (SELECT query, name, round(avg(score), 1) AS overall, list_sort(list(DISTINCT word)) AS m FROM f GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY len(m) DESC, overall DESC, name)::INT AS place FROM n) SELECT query, place, name, overall, array_to_string(m, ',') AS matched FROM r WHERE place <= 3""")
def results_by_word(spark, d):
    found = _table(spark, d, "orders").selectExpr("o_orderkey % 200 as query", "o_orderstatus as word", "o_orderpriority as name", "cast(o_custkey % 100 as double) as score")
    return suggestions.by_word(found, 3).withColumn("matched", F.array_join("matched", ","))


@query("SELECT c_custkey, 'c_name: ' || c_name || CASE WHEN c_custkey % 2 = 0 THEN ' | segment: ' || c_mktsegment ELSE '' END || ' | key: ' || c_custkey AS line FROM customer")
def described_records(spark, d):
    rows = _table(spark, d, "customer").selectExpr("c_custkey", "c_name", "case when c_custkey % 2 = 0 then c_mktsegment else ' ' end as segment", "cast(c_custkey as string) as key")
    return rows.select("c_custkey", suggestions.described(["c_name", "segment", "key"]).alias("line"))


_STOP = "[" + ", ".join(f"'{w}'" for w in encoder.STOP) + "]"
_FEATURES = f"""w AS (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: length(x) >= 2 AND NOT list_contains({_STOP}, x))) AS w FROM conversations),
    f AS (SELECT conv_id, turn, unnest(list_concat(['w:' || w], CASE WHEN length(w) >= 3 THEN list_concat(list_transform(range(1, length(w)), lambda i: 'c2:' || substr(w, i, 2)), list_transform(range(1, length(w) - 1), lambda i: 'c3:' || substr(w, i, 3)), list_transform(range(1, length(w) - 2), lambda i: 'c4:' || substr(w, i, 4))) ELSE [] END)) AS f FROM w),
    h AS (SELECT conv_id, turn, ('0x' || substr(md5(f), 14, 3))::INT AS h FROM f), c AS (SELECT conv_id, turn, h % 1024 AS dim, sum(CASE WHEN (h >> 8) & 1 = 1 THEN 1 ELSE -1 END)::DOUBLE AS s FROM h GROUP BY ALL HAVING s <> 0)"""


@query(f"WITH {_FEATURES} SELECT conv_id * 1000 + turn AS id, dim, round(s / sqrt(sum(s * s) OVER (PARTITION BY conv_id, turn)), 6) AS weight FROM c")
def request_vectors(spark, d):
    rows = _table(spark, d, "conversations").selectExpr("conv_id * 1000 + turn as id", "text")
    return encoder.encode(rows, "id", "text").withColumn("weight", F.round("weight", 6))


@query("SELECT event_id AS id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def newest_entries(spark, d):
    return journals.newest(_table(spark, d, "events").selectExpr("event_id as id", "ts", "event_type"), 500)


@query("WITH t AS (SELECT DISTINCT trim(upper(left(p_name, 5))) AS typed FROM part) SELECT DISTINCT typed, upper(p_name) AS key FROM part JOIN t ON starts_with(upper(p_name), typed)")
def typed_beginnings(spark, d):
    """Names that are typed without a mistake are among those proposed for their first five letters."""
    parts = _table(spark, d, "part")
    found = suggestions.prefix_matches(parts, "p_name", parts.select(F.substring("p_name", 1, 5).alias("typed")), limit=1 << 30)
    return found.where(F.col("key").startswith(F.col("typed"))).select("typed", "key")


@query("""SELECT unnest(['filled', 'filled', 'filled', 'sheet']) AS "check", unnest(['c_name', 'c_mktsegment', 'gone', 'AUTO']) AS name, unnest([count(*), count(*), 0, count(*) FILTER (contains(lower(c_mktsegment), 'auto'))]) AS n, unnest([1, 10000000, 1, 1])::BIGINT AS least,
    unnest([count(*) >= 1, count(*) >= 10000000, false, count(*) FILTER (contains(lower(c_mktsegment), 'auto')) >= 1]) AS ok FROM customer""")
def build_gates(spark, d):
    return gates.content(_table(spark, d, "customer").withColumn("sheet_name", F.col("c_mktsegment")), {"c_name": 1, "c_mktsegment": 10_000_000, "gone": 1}, {"AUTO": 1})


_TIER = "SELECT event_id, ts, event_type AS intent, (value * 7)::INT % 101 AS confidence, (user_id * 3 % 50) AS margin, user_id % 5 > 0 AS would_act, CASE WHEN event_id % 10 > 0 THEN event_id % 9 > 0 OR value < 20 END AS correct FROM events"


def _tier(spark, d):
    """Events as decisions, nine of ten reviewed."""
    rows = _table(spark, d, "events").withColumn("confidence", F.pmod(F.round(F.col("value") * 7).cast("int"), F.lit(101)))
    rows = rows.selectExpr("event_id as entry_id", "ts", "event_type as intent", "confidence", "cast(user_id * 3 % 50 as double) as margin", "user_id % 5 > 0 as would_act", "value")
    reviews = rows.where("entry_id % 10 > 0").selectExpr("entry_id", "ts", "entry_id % 9 > 0 or value < 20 as correct", "concat('not ', intent) as actual")
    return shadow.labelled(rows.drop("value"), reviews)


@query(f"""WITH e AS (SELECT *, CASE WHEN confidence < 20 THEN 0 WHEN confidence < 40 THEN 20 WHEN confidence < 60 THEN 40 WHEN confidence < 80 THEN 60 ELSE 80 END AS band FROM ({_TIER}) WHERE correct IS NOT NULL),
    b AS (SELECT intent, band, CASE WHEN band = 80 THEN 101 ELSE band + 20 END AS top, count(*) AS n, count(*) FILTER (correct) / count(*) AS rate FROM e WHERE would_act GROUP BY ALL), m AS (SELECT intent, max_by(top, band) FILTER (n >= 3 AND rate < 0.8) AS missed, min(band) FILTER (n >= 3) AS low FROM b GROUP BY intent),
    g AS (SELECT intent, least(90, CASE WHEN missed IS NOT NULL THEN missed ELSE least(65, coalesce(low, 65)) END) AS g FROM m), p AS (SELECT intent, band FROM e WHERE NOT would_act AND correct GROUP BY ALL HAVING count(*) >= 3), f AS (SELECT intent, max(band) AS f FROM p JOIN g USING (intent) WHERE band < g GROUP BY intent)
    SELECT intent, count(*) FILTER (would_act) AS samples, count(*) FILTER (NOT would_act AND correct) AS would_not_correct, round(count(*) FILTER (would_act AND correct) / count(*) FILTER (would_act), 3) AS precision,
    CASE WHEN count(*) FILTER (would_act) >= 20 THEN greatest(40, least(any_value(g), coalesce(any_value(f), 90))) END::INT AS gate FROM e LEFT JOIN g USING (intent) LEFT JOIN f USING (intent) GROUP BY intent""")
def tier_gates(spark, d):
    return shadow.gates(_tier(spark, d))


@query(f"""WITH e AS ({_TIER}), w AS (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY ts DESC, event_id DESC) AS k FROM e WHERE would_act AND NOT correct)
    SELECT intent, count(*) AS reviewed, count(*) FILTER (correct) AS correct, round(count(*) FILTER (correct) / count(*), 3) AS precision, (SELECT count(*) FROM w WHERE w.intent = e.intent AND k <= 5)::INT AS shown FROM e WHERE would_act AND correct IS NOT NULL GROUP BY intent""")
def tier_precision(spark, d):
    return shadow.precision(_tier(spark, d)).withColumn("shown", F.size("missed_as")).drop("missed_as")


@query(f"SELECT count(*) AS total, count(*) FILTER (ts::DATE = DATE '2024-01-02') AS today, count(*) FILTER (would_act) AS would_act, count(*) FILTER (NOT would_act) AS would_not, count(correct) AS reviewed, max(ts) AS last_ts FROM ({_TIER})")
def tier_health(spark, d):
    return shadow.health(_tier(spark, d), F.lit("2024-01-02").cast("date"))


@query("""SELECT count(*) AS runs, count(*) FILTER (o_orderstatus = 'O') AS ok, count(*) FILTER (o_orderstatus = 'F') AS failed, max(o_orderdate) AS last_run_at, max(o_custkey)::BIGINT AS max_rows FROM orders""")
def ledger_stats(spark, d):
    status = F.when(F.col("o_orderstatus") == "O", "ok").when(F.col("o_orderstatus") == "F", "failed").otherwise("running")
    return governance.ledger_stats(_table(spark, d, "orders").select(status.alias("status"), F.col("o_orderdate").alias("finished_at"), F.col("o_custkey").alias("row_count")))


@query("""WITH whole AS (SELECT DISTINCT upper(p_name) AS r FROM part WHERE p_partkey % 50 = 0) SELECT DISTINCT upper(p_name) AS name, CASE WHEN upper(p_name) IN (FROM whole) THEN upper(p_name) ELSE upper(string_split(p_name, ' ')[1]) END AS root FROM part""")
def family_roots(spark, d):
    """Part names under their first words, and under some whole names, which are more specific."""
    parts = _table(spark, d, "part")
    roots = parts.where("p_partkey % 50 = 0").select(F.col("p_name").alias("root")).unionByName(parts.select(F.substring_index("p_name", " ", 1).alias("root")))
    return requests.family_roots(parts.select(F.col("p_name").alias("name")), roots)
