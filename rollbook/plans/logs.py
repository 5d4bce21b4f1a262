"""Registered queries over logs: requests, decisions, reviews, audit and governed assets, and requests' identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.operators import governance, learning, requests, search
from rollbook.plans.answers import _REG, full
from rollbook.plans.catalogue import _table, query

#: A request log, read off the events: who asked is the entity, the kind of event the text.
_LOG = "log AS (SELECT event_id AS id, ts, event_type AS text, CASE WHEN event_type IN ('error', 'view') THEN 0 ELSE 1 END AS rows, ['u' || user_id % 40, 'k' || json_extract(props, '$.k')::INT % 30] AS entities FROM events)"


def request_log(spark, d):
    return _table(spark, d, "events").selectExpr("event_id as id", "ts", "event_type as text", "case when event_type in ('error', 'view') then 0 else 1 end as rows", "array('u' || cast(user_id % 40 as string), 'k' || cast(cast(get_json_object(props, '$.k') as int) % 30 as string)) as entities")


_REPHRASED = f"""{_LOG}, e AS (SELECT * EXCLUDE (entities), unnest(entities) AS entity FROM log), p AS (SELECT a.id, b.id AS other, b.ts FROM e a JOIN e b ON a.entity = b.entity AND a.rows = 0 AND a.text <> b.text AND (b.ts, b.id) > (a.ts, a.id) AND b.ts <= a.ts + INTERVAL 20 MINUTE),
    r AS (SELECT id, arg_min(other, (ts, other)) AS rephrased_by FROM p GROUP BY id)"""


@query(f"WITH {_REPHRASED} SELECT * FROM r")
def rephrased(spark, d):
    return learning.rephrased(request_log(spark, d))


_NOW = "TIMESTAMP '2024-01-05 00:00:00'"


@query(f"""WITH {_REPHRASED} SELECT CASE WHEN r.id IS NOT NULL THEN 'rephrased' WHEN rows > 0 THEN 'accepted' WHEN ts < {_NOW} - INTERVAL 20 MINUTE THEN 'abandoned' ELSE 'pending' END AS outcome, count(*) AS n FROM log LEFT JOIN r USING (id) GROUP BY outcome""")
def request_outcomes(spark, d):
    return learning.outcomes(request_log(spark, d), F.expr(_NOW).cast("timestamp"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value >= 40) AS accepted, round(count(*) FILTER (value >= 40) / count(*), 6) AS rate FROM events GROUP BY event_type")
def acceptance_by_kind(spark, d):
    return learning.acceptance(_table(spark, d, "events"), "event_type", F.col("value") >= 40)


_GAPS = """g AS (SELECT CASE WHEN x < 1 THEN 0.0 WHEN x < 2 THEN 1.0 WHEN x < 3 THEN 2.0 WHEN x < 4 THEN 3.0 ELSE 4.0 END::DOUBLE AS band, CASE WHEN x < 1 THEN 1.0 WHEN x < 2 THEN 2.0 WHEN x < 3 THEN 3.0 WHEN x < 4 THEN 4.0 ELSE 6.0 END::DOUBLE AS top, ok
    FROM (SELECT value / 20 AS x, event_type <> 'error' AS ok FROM events) WHERE x >= 0 AND x < 6), b AS (SELECT band, top, count(*) AS n, count(*) FILTER (ok) AS accepted, round(count(*) FILTER (ok) / count(*), 6) AS rate FROM g GROUP BY ALL)"""


def _gaps(spark, d):
    return learning.gap_bands(_table(spark, d, "events").withColumn("gap", F.col("value") / 20), "gap", F.col("event_type") != "error")


@query(f"WITH {_GAPS} SELECT * FROM b")
def gap_bands(spark, d):
    return _gaps(spark, d)


@query(f"""WITH {_GAPS}, m AS (SELECT max_by(top, band) FILTER (n >= 3 AND rate < 0.8) AS missed, min(band) FILTER (n >= 3) AS low, coalesce(sum(n), 0)::BIGINT AS n_decisions FROM b)
    SELECT greatest(0.5, least(6.0, CASE WHEN n_decisions < 20 THEN 4.0 WHEN missed IS NOT NULL THEN missed ELSE least(4.0, low) END))::DOUBLE AS threshold, n_decisions FROM m""")
def gap_threshold(spark, d):
    return learning.gap_threshold(_gaps(spark, d))


@query("""WITH b AS (SELECT event_type, (floor(value / 20) * 20)::INT AS band, count(*) AS n, round(count(*) FILTER (user_id % 4 <> 0) / count(*), 6) AS rate FROM events GROUP BY ALL),
    m AS (SELECT event_type, max(band) FILTER (n >= 3 AND rate < 0.8) AS missed, min(band) FILTER (n >= 3) AS low, sum(n)::BIGINT AS n_decisions FROM b GROUP BY event_type)
    SELECT event_type, greatest(40, least(90, CASE WHEN n_decisions < 20 THEN 60 WHEN missed IS NOT NULL THEN missed + 20 ELSE least(60, low) END)) AS threshold, n_decisions FROM m""")
def intent_thresholds(spark, d):
    """A threshold for each intent (here: kind of event), none below 40."""
    rows = _table(spark, d, "events").groupBy("event_type", (F.floor(F.col("value") / 20) * 20).cast("int").alias("band")).agg(F.count("*").alias("n"), F.round(F.count_if(F.col("user_id") % 4 != 0) / F.count("*"), 6).alias("rate"))
    return learning.threshold(rows, low=40, by=("event_type",))


@query("""WITH l AS (SELECT doc_id, max_by(toxic = 0, quality) AS correct FROM labels GROUP BY doc_id) SELECT lang AS intent, count(*) AS n, count(*) FILTER (correct) AS "right", round(count(*) FILTER (correct) / count(*), 6) AS precision
    FROM documents JOIN l USING (doc_id) GROUP BY lang""")
def review_precision(spark, d):
    reviews = _table(spark, d, "labels").selectExpr("doc_id as entry_id", "quality as ts", "toxic = 0 as correct")
    return learning.review_precision(_table(spark, d, "documents").selectExpr("doc_id as entry_id", "lang as intent"), reviews)


_GRAMS = """w AS (SELECT role, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM conversations),
    g AS (SELECT role AS label, unnest(list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) AS gram FROM w),
    m AS (SELECT gram, label, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 5)"""


@query(f"""WITH {_GRAMS}, l AS (SELECT label, n AS most, ' ' || gram || ' ' AS whole, string_split(gram, ' ') AS s FROM m),
    parts AS (SELECT label, most, unnest(CASE len(s) WHEN 2 THEN [s[1], s[2]] WHEN 3 THEN [s[1], s[2], s[3], s[1] || ' ' || s[2], s[2] || ' ' || s[3]] ELSE [] END) AS gram FROM l),
    c AS (SELECT label, gram, max(most) AS most FROM parts GROUP BY ALL), kept AS (SELECT m.* FROM m LEFT JOIN c USING (label, gram) WHERE most IS NULL OR most < n)
    SELECT gram, label, n FROM kept WHERE gram NOT IN ('the', 'of') AND NOT (gram = 'a' AND label = 'user')""")
def phrase_suggestions(spark, d):
    mined = learning.without_parts(learning.phrases(_table(spark, d, "conversations"), "text", "role", 5))
    return learning.suggestions(mined, spark.createDataFrame([("the",), ("of",)], "gram string"), spark.createDataFrame([("a", "user")], "gram string, label string"))


@query("""SELECT event_type AS action, count(*) AS n, count(*) FILTER (ts >= TIMESTAMP '2024-01-02 00:00:00') AS last_day, max(ts) AS newest FROM events GROUP BY event_type""")
def audit_stats(spark, d):
    return governance.audit_stats(_table(spark, d, "events").withColumnRenamed("event_type", "action"), F.expr("TIMESTAMP '2024-01-03 00:00:00'").cast("timestamp"))


@query("SELECT event_id AS id, ts, user_id AS actor, event_type AS action FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100")
def audit_recent(spark, d):
    return governance.recent(_table(spark, d, "events").selectExpr("event_id as id", "ts", "user_id as actor", "event_type as action"), action="error")


_ASSETS = "e AS (SELECT 'a' || user_id % 50 AS asset, (user_id // 50)::INT AS version, CASE event_type WHEN 'view' THEN 'propose' WHEN 'click' THEN 'approve' WHEN 'error' THEN 'reject' WHEN 'purchase' THEN 'apply' ELSE 'note' END AS action, ts FROM events)"


@query(f"""WITH {_ASSETS}, p AS (SELECT asset, version, min(ts) AS p FROM e WHERE action = 'propose' GROUP BY ALL), j AS (SELECT asset, version, min(ts) AS jt, arg_min(action, (ts, action)) AS ja FROM e JOIN p USING (asset, version) WHERE action IN ('approve', 'reject') AND ts >= p GROUP BY ALL),
    a AS (SELECT asset, version, min(ts) AS dt FROM e JOIN j USING (asset, version) WHERE action = 'apply' AND ja = 'approve' AND ts >= jt GROUP BY ALL)
    SELECT asset, version, CASE WHEN dt IS NOT NULL THEN 'applied' WHEN ja = 'approve' THEN 'approved' WHEN ja = 'reject' THEN 'rejected' ELSE 'proposed' END AS state, coalesce(dt, jt, p) AS "at" FROM p LEFT JOIN j USING (asset, version) LEFT JOIN a USING (asset, version)""")
def asset_states(spark, d):
    rows = _table(spark, d, "events").selectExpr("'a' || cast(user_id % 50 as string) as asset", "cast(floor(user_id / 50) as int) as version", "case event_type when 'view' then 'propose' when 'click' then 'approve' when 'error' then 'reject' when 'purchase' then 'apply' else 'note' end as action", "ts")
    return governance.asset_states(rows)


_TYPED = "'please check (MX' || lpad(cast(s_suppkey as string), 5, '0') || '), TID-' || lpad(cast(s_suppkey as string), 8, '0') || '; c' || cast(s_suppkey as string) || '@example.com, or 0803' || lpad(cast(s_suppkey as string), 7, '0') || '.'"


@query(f"""SELECT s_suppkey, unnest(['MX' || lpad(cast(s_suppkey as string), 5, '0'), lpad(cast(s_suppkey as string), 8, '0'), 'c' || cast(s_suppkey as string) || '@example.com', '0803' || lpad(cast(s_suppkey as string), 7, '0'), '0803' || lpad(cast(s_suppkey as string), 7, '0')]) AS token,
    unnest(['mxcode', 'tid', 'email', 'bvn', 'phone']) AS kind FROM supplier""")
def parsed_requests(spark, d):
    return requests.parse(_table(spark, d, "supplier").selectExpr("s_suppkey", f"{_TYPED} as text"))


@query("""SELECT s_suppkey, lpad(cast(s_suppkey as string), 8, '0') AS id, s_name AS name FROM supplier""")
def named_lines(spark, d):
    return requests.named_lines(_table(spark, d, "supplier").selectExpr("s_suppkey", "'please get these\\n' || lpad(cast(s_suppkey as string), 8, '0') || '\\t' || s_name || '\\nno identifier here' as text"))


@query(f"""WITH {_REG}, q AS (SELECT DISTINCT lpad((s_suppkey * 2)::VARCHAR, 8, '0') AS query FROM supplier UNION SELECT replace(lpad((s_suppkey + 1000000)::VARCHAR, 10, '0'), '1', 'I') FROM supplier UNION SELECT 'C' || s_suppkey || '@Example.com' FROM supplier),
    k AS (SELECT query, regexp_replace(upper(query), '[^A-Z0-9]', '', 'g') AS c FROM q), cells AS (SELECT * FROM (SELECT id, unnest([0, 1, 2, 3, 4]) AS o, unnest(['mxcode', 'payable_code', 'merchant_id', 'tid', 'account_number']) AS hit, unnest([mxcode, payable_code, merchant_id, tid, account_number]) AS v FROM reg) WHERE coalesce(v, '') <> ''),
    vals AS (SELECT DISTINCT hit, v FROM cells), valid AS (SELECT *, CASE hit WHEN 'account_number' THEN false WHEN 'tid' THEN true ELSE true END AS ok FROM vals),
    same AS (SELECT query, id, o, hit, CASE WHEN v = c THEN 100.0 ELSE 98.0 END AS s FROM cells JOIN k ON translate(v, '01258', 'OIZSB') = translate(c, '01258', 'OIZSB')),
    mail AS (SELECT query, id, 6 AS o, 'email' AS hit, 100.0 AS s FROM reg JOIN q ON lower(query) = email) SELECT query, id, arg_min(hit, (-s, o)) AS hit, max(s)::DOUBLE AS hit_score FROM (FROM same UNION ALL FROM mail) GROUP BY query, id""")
def identifier_search(spark, d):
    """Hits on whole identifiers; those on parts are tested on a fixture."""
    s = _table(spark, d, "supplier")
    q = s.selectExpr("explode(array(lpad(cast(s_suppkey * 2 as string), 8, '0'), replace(lpad(cast(s_suppkey + 1000000 as string), 10, '0'), '1', 'I'), concat('C', s_suppkey, '@Example.com'))) as query").distinct()
    return search.identifier_hits(full(spark, d), q).where("hit_score > 90")


@query(None)
def name_search(spark, d):
    """The best records of three requests with typos, with their scores by field."""
    parts = _table(spark, d, "part").selectExpr("p_partkey as id", "p_name as merchant_name", "p_brand as alias")
    found = search.search(parts, spark.createDataFrame([("red widget",), ("widgit blu",), ("colt rod",)], "query string"))
    return found.select("query", "place", "id", "score", "match_type", F.array_join("matched", " ").alias("matched"))
