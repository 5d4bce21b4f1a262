"""Registered queries of the registry operators, each with the DuckDB SQL that gives the same rows.

The driver's tables hold no registry, so one is read off them: a record per order, with codes and contact fields
made of its keys. Parts are the names, events the log, documents the free text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.functions import identifiers as ids
from rollbook.functions import similarity, text
from rollbook.operators import aggregates, entities, filters, fulltext, learning, registry
from rollbook.sources.shared import written
from rollbook.streaming import windows

#: Columns of a record, in SQL that both engines read.
RECORD = {
    "id": "o_orderkey", "sheet_name": "o_orderpriority", "merchant_name": "c_name", "tid": "lpad(cast(o_custkey as string), 8, '0')",
    "mxcode": "'MX' || lpad(cast(o_orderkey % 7000 as string), 5, '0')", "email": "case when o_orderstatus = 'P' then '' else 'c' || cast(o_custkey as string) || '@example.com' end",
    "phone": "'0800' || lpad(cast(o_custkey as string), 7, '0')", "account_number": "case when o_orderkey % 10 = 0 then null else lpad(cast(o_orderkey % 9000 as string), 10, '0') end",
    "state": "n_name", "bank_code": "lpad(cast(n_nationkey as string), 3, '0')",
}
_RECORDS = f"records AS (SELECT {', '.join(f'{e} AS {c}' for c, e in RECORD.items())} FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"
PART = registry.Spec(id="p_partkey", name="p_name", source="p_brand", names=("p_name",), identifiers=(), links=())
INTENTS = {"question": {r"\?": 2.0, r" la ": 1.0}, "listing": {r"\n": 3.0, r" the ": 0.5}, "long": {r"[^ ]{12,}": 4.0}}
_GENERIC = ", ".join(f"'{w}'" for w in text.GENERIC_WORDS)


def _canonical(c: str) -> str:
    out = f"replace(upper(strip_accents(coalesce({c}, ''))), '&', ' AND ')"
    for short, full in (*text.ABBREVIATIONS.items(), *text.TYPOS.items()):
        out = f"regexp_replace({out}, '\\b{short.replace(chr(39), chr(39) * 2)}\\b', '{full}', 'g')"
    return f"trim(regexp_replace(replace({out}, '''', ''), '[^A-Z0-9]+', ' ', 'g'))"


_BUCKETS = f"members AS (SELECT * FROM (SELECT p_partkey AS id, array_to_string(list_filter(string_split({_canonical('p_name')}, ' '), lambda w: w NOT IN ({_GENERIC})), ' ') AS bucket_key FROM part) WHERE bucket_key <> '')"
_TERMS = "terms AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(strip_accents(coalesce(text, ''))), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS words FROM documents)"
_CELLS = """cells AS (SELECT id, field, trim(upper(value)) AS value FROM (
    SELECT id, unnest(['tid', 'mxcode', 'phone', 'email', 'account_number']) AS field, unnest([tid, mxcode, phone, email, account_number]) AS value FROM records) WHERE coalesce(value, '') <> '')"""

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL unless none can say it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def records(spark: SparkSession, d: str) -> DataFrame:
    """Small sides are left to the optimiser, which knows their sizes."""
    joined = _table(spark, d, "orders").join(_table(spark, d, "customer"), F.expr("o_custkey = c_custkey")).join(_table(spark, d, "nation"), F.expr("c_nationkey = n_nationkey"))
    return joined.selectExpr(*[f"{e} as {c}" for c, e in RECORD.items()])


@query(f"WITH {_RECORDS} SELECT coalesce(nullif(trim(state), ''), '(blank)') AS value, count(*) AS n FROM records GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def top_states(spark, d):
    return aggregates.top(records(spark, d), "state", 10)


@query(f"WITH {_RECORDS} SELECT id, merchant_name, tid FROM records WHERE contains(upper(merchant_name), '00042') ORDER BY id LIMIT 100")
def field_search(spark, d):
    return filters.by_column(records(spark, d), "merchant_name", "00042").select("id", "merchant_name", "tid")


@query("SELECT p_name, p_partkey, count(*) OVER () AS total FROM part WHERE contains(upper(p_name), 'RED') OR contains(upper(p_type), 'RED') ORDER BY p_name, p_partkey LIMIT 1000")
def segment(spark, d):
    return filters.segment_report(_table(spark, d, "part"), filters.segment(["p_name", "p_type"], "red"), ["p_name", "p_partkey"])


@query(f"WITH {_RECORDS} SELECT id, tid FROM records WHERE coalesce(email, '') = '' AND coalesce(account_number, '') = '' AND coalesce(phone, '') <> ''")
def coverage(spark, d):
    return records(spark, d).where(filters.missing("email", "account_number") & filters.has("phone")).select("id", "tid")


@query(f"WITH {_RECORDS} SELECT count(*) AS n FROM records WHERE upper(trim(state)) IN ('NATION_3', 'NATION_7')")
def count_segment(spark, d):
    return records(spark, d).where(filters.states("state", ["nation_3", "Nation_7"])).agg(F.count("*").alias("n"))


@query("""SELECT max(p_name) AS name, count(*) AS n, substr(array_to_string(list_sort(list(DISTINCT p_brand)), ', '), 1, 200) AS sources FROM part WHERE p_name <> ''
    GROUP BY upper(trim(p_name)) HAVING count(*) > 1 ORDER BY n DESC, upper(trim(any_value(p_name))) LIMIT 500""")
def duplicates(spark, d):
    return aggregates.duplicates(_table(spark, d, "part"), PART)


@query(f"""WITH {_RECORDS}, s AS (SELECT count(*) AS records, count(DISTINCT upper(merchant_name)) AS distinct_names, count(DISTINCT upper(state)) AS states,
    count(*) FILTER (coalesce(email, '') <> '') AS with_email, count(*) FILTER (coalesce(account_number, '') <> '') AS with_account_number FROM records)
    UNPIVOT s ON records, distinct_names, states, with_email, with_account_number INTO NAME metric VALUE n""")
def summary(spark, d):
    return aggregates.summary(records(spark, d), ["email", "account_number"])


@query(f"""WITH {_RECORDS}
    SELECT 'source' AS section, sheet_name AS item, count(*) AS n FROM records GROUP BY sheet_name
    UNION ALL SELECT 'missing', 'email', count(*) FILTER (coalesce(email, '') = '') FROM records
    UNION ALL SELECT 'missing', 'account_number', count(*) FILTER (coalesce(account_number, '') = '') FROM records
    UNION ALL SELECT 'odd', 'orphans', count(*) FILTER (tid = '' AND mxcode = '' AND email = '' AND phone = '' AND coalesce(account_number, '') = '') FROM records
    UNION ALL SELECT 'odd', 'code_names', count(*) FILTER (regexp_full_match(merchant_name, '[0-9]+(\\.[0-9]+)?')) FROM records
    UNION ALL SELECT 'shared', 'tid', count(*) FROM (SELECT tid FROM records GROUP BY tid HAVING count(*) > 1)
    UNION ALL SELECT 'shared', 'mxcode', count(*) FROM (SELECT mxcode FROM records GROUP BY mxcode HAVING count(DISTINCT upper(merchant_name)) > 1)""")
def quality_report(spark, d):
    return aggregates.quality_report(records(spark, d), ["email", "account_number"])


@query(f"""WITH {_RECORDS}, {_CELLS} SELECT field, value, count(*) AS n, count(DISTINCT upper(merchant_name)) AS names, count(DISTINCT CASE WHEN field = 'email' AND id % 2 = 0 THEN upper(value) WHEN field = 'email' THEN lower(value) ELSE value END) AS spellings
    FROM cells JOIN records USING (id) WHERE field IN ('tid', 'email') GROUP BY ALL""")
def identity(spark, d):
    spelt = records(spark, d).withColumn("email", F.expr("case when id % 2 = 0 then upper(email) else email end"))
    return aggregates.identity(spelt, ["tid", "email"])


@query(f"WITH {_BUCKETS} SELECT bucket_key, count(*) AS n, min(id) AS first_id FROM members GROUP BY bucket_key")
def name_buckets(spark, d):
    return aggregates.buckets(_table(spark, d, "part"), PART)


@query(f"WITH {_BUCKETS} SELECT DISTINCT bucket_key FROM members WHERE bucket_key LIKE 'RED%' ORDER BY length(bucket_key), bucket_key LIMIT 5")
def autocomplete(spark, d):
    return fulltext.autocomplete(aggregates.buckets(_table(spark, d, "part"), PART), "red", 5)


@query(f"""WITH w AS (SELECT p_partkey, list_filter(string_split({_canonical('p_name')}, ' '), lambda w: length(w) >= 3) AS every FROM part),
    k AS (SELECT p_partkey, every, list_filter(every, lambda w: w NOT IN ({_GENERIC})) AS kept FROM w),
    t AS (SELECT unnest(list_distinct(CASE WHEN len(kept) > 0 THEN kept ELSE every END)) AS token FROM k)
    SELECT token, count(*) AS df, round(ln(1 + (SELECT count(*) FROM part) / count(*)), 6) AS idf FROM t GROUP BY token""")
def token_weights(spark, d):
    return aggregates.token_weights(_table(spark, d, "part"), PART).withColumn("idf", F.round("idf", 6))


@query(f"WITH {_RECORDS}, {_CELLS} SELECT value, array_to_string(list_sort(list(DISTINCT field)), ',') AS kinds FROM cells WHERE field IN ('tid', 'phone', 'account_number') GROUP BY value")
def id_membership(spark, d):
    found = aggregates.membership(records(spark, d), {"tid": "tid", "phone": "phone", "account_number": "account_number"})
    return found.withColumn("kinds", F.array_join("kinds", ","))


@query(f"WITH {_RECORDS}, {_CELLS} SELECT field, value, count(DISTINCT id) AS n FROM cells GROUP BY field, value HAVING count(DISTINCT id) >= 3")
def shared_values(spark, d):
    return aggregates.shared_values(records(spark, d), ["tid", "mxcode", "phone", "email", "account_number"])


@query(f"""WITH {_RECORDS}, {_CELLS} SELECT DISTINCT id, CASE field WHEN 'account_number' THEN 'account' ELSE field END AS id_type, value AS id_value FROM cells""")
def identifiers(spark, d):
    return registry.identifiers(records(spark, d))


@query(f"""WITH {_RECORDS}, c AS (SELECT tid, mxcode AS value, count(*) AS n FROM records WHERE mxcode <> '' GROUP BY ALL)
    SELECT tid, arg_min(value, (-n, value)) AS value, max(n) AS n FROM c GROUP BY tid""")
def dominant_code(spark, d):
    return aggregates.most_common(records(spark, d), ["tid"], "mxcode")


@query("SELECT o_custkey, arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS first_o_orderstatus, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS last_o_orderstatus FROM orders GROUP BY o_custkey")
def first_and_last(spark, d):
    return aggregates.first_last(_table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderstatus")


@query(f"WITH {_RECORDS} SELECT tid, arg_min(id, (mxcode = '', id)) AS id, arg_min(mxcode, (mxcode = '', id)) AS mxcode FROM records GROUP BY tid")
def one_per_terminal(spark, d):
    return registry.first_by(records(spark, d), ["tid"], [F.col("mxcode") == "", "id"], ["id", "mxcode"])


@query("""WITH c AS (SELECT user_id, event_type, count(*)::DOUBLE AS s FROM events GROUP BY ALL),
    r AS (SELECT *, row_number() OVER w AS k, lead(event_type) OVER w AS runner_up, lead(s) OVER w AS t FROM c WINDOW w AS (PARTITION BY user_id ORDER BY s DESC, event_type))
    SELECT user_id, event_type AS winner, s AS score, runner_up, s - coalesce(t, 0) AS margin FROM r WHERE k = 1""")
def winner(spark, d):
    counted = _table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("s"))
    return aggregates.winner(counted, "user_id", "event_type", "s")


@query(f"""WITH {_RECORDS}, {_CELLS}, wanted AS (SELECT DISTINCT replace(lpad(c_custkey::VARCHAR, 8, '0'), '1', 'I') AS value FROM customer),
    hits AS (SELECT w.value, c.id, c.field, c.value = w.value AS same FROM cells c JOIN wanted w ON translate(c.value, '01258', 'OIZSB') = translate(w.value, '01258', 'OIZSB') WHERE field IN ('tid', 'mxcode')),
    best AS (SELECT value, arg_min(id, (NOT same, id, field)) AS id, arg_min(field, (NOT same, id, field)) AS matched_field, arg_min(same, (NOT same, id, field)) AS is_exact FROM hits GROUP BY value)
    SELECT value, id, merchant_name, matched_field, is_exact FROM wanted LEFT JOIN best USING (value) LEFT JOIN records USING (id)""")
def resolve_identifiers(spark, d):
    wanted = _table(spark, d, "customer").selectExpr("replace(lpad(cast(c_custkey as string), 8, '0'), '1', 'I') as value")
    return registry.resolve(records(spark, d), wanted, ["tid", "mxcode"], keep=("id", "merchant_name"))


@query(f"""WITH {_RECORDS}, wanted AS (SELECT DISTINCT lpad((s_suppkey * 7)::VARCHAR, 8, '0') AS value FROM supplier)
    SELECT value, CASE WHEN count(tid) > 0 THEN 'Yes' ELSE 'No' END AS found FROM wanted LEFT JOIN records ON tid = value GROUP BY value""")
def verify(spark, d):
    wanted = _table(spark, d, "supplier").selectExpr("lpad(cast(s_suppkey * 7 as string), 8, '0') as value")
    return registry.resolve(records(spark, d), wanted, ["tid"]).select("value", F.when(F.col("is_exact"), "Yes").otherwise("No").alias("found"))


@query(f"""WITH {_RECORDS}, {_CELLS}, g AS (SELECT field, value, count(DISTINCT id) AS n FROM cells WHERE field IN ('tid', 'mxcode') GROUP BY ALL HAVING count(DISTINCT id) > 1)
    SELECT DISTINCT id AS seed, field, value, n - 1 AS n_linked FROM cells JOIN g USING (field, value)""")
def related(spark, d):
    """Every record as a seed, by the values it shares."""
    return registry.links(records(spark, d), ["tid", "mxcode"])


_MISSPELT = "case when o_orderkey % 3 = 0 then replace(replace(tid, '0', 'O'), '1', 'I') when o_orderkey % 3 = 1 then replace(tid, '5', 'S') else tid end"


@query(f"""WITH {_RECORDS}, t AS (SELECT DISTINCT {_MISSPELT.replace('o_orderkey', 'id')} AS value FROM records) SELECT translate(value, '01258', 'OIZSB') AS key, string_agg(value, ',' ORDER BY value) AS spellings, count(*) AS n FROM t GROUP BY key HAVING count(*) > 1""")
def lookalikes(spark, d):
    return aggregates.lookalikes(records(spark, d).withColumn("tid", F.expr(_MISSPELT.replace("o_orderkey", "id"))), "tid")


@query(f"""WITH {_TERMS}, p AS (SELECT id, len(words) AS n_terms, unnest(words) AS term FROM terms), i AS (SELECT id, term, any_value(n_terms) AS n_terms, count(*) AS tf FROM p GROUP BY ALL),
    t AS (SELECT count(DISTINCT id) AS records, (SELECT avg(n) FROM (SELECT any_value(n_terms) AS n FROM i GROUP BY id)) AS mean FROM i),
    h AS (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM i WHERE term IN ('the', 'of'))
    SELECT id, round(sum(ln(1 + (records - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_terms / mean))), 6) AS score FROM h, t GROUP BY id HAVING count(*) = 2""")
def ranked_search(spark, d):
    return fulltext.ranked(_table(spark, d, "documents"), "doc_id", ["text"], ["the", "of"], 1 << 30).withColumn("score", F.round("score", 6))


@query(None)
def stemmed_search(spark, d):
    index = written(fulltext.postings(_table(spark, d, "documents"), "doc_id", ["text"]), "postings")  # read three times
    return fulltext.bm25(index, [fulltext.stem("licenses"), fulltext.stem("public")], 50)


@query("SELECT doc_id FROM documents WHERE contains(upper(text), 'LICENSE') ORDER BY doc_id LIMIT 200")
def substring_search(spark, d):
    return fulltext.substring_search(_table(spark, d, "documents"), ["text"], "the license", 200, "doc_id").select("doc_id")


@query("SELECT p_partkey AS id FROM part WHERE contains(upper(p_name), 'WIDGE')")
def gram_search(spark, d):
    return fulltext.gram_search(_table(spark, d, "part"), "p_partkey", ["p_name"], "widge")


@query(f"""WITH {_RECORDS} SELECT id, left(phone, 2) || repeat('*', length(phone) - 4) || right(phone, 4) AS phone, CASE WHEN email = '' THEN '' ELSE left(split_part(email, '@', 1), 2) || repeat('*', greatest(length(split_part(email, '@', 1)) - 2, 0)) || '@example.com' END AS email,
    left(tid, 2) || '****' || right(tid, 2) AS tid, left(tid, 3) || '***' || right(tid, 2) AS value FROM records""")
def masked(spark, d):
    return records(spark, d).select("id", *[ids.mask_field(c, c).alias(c) for c in ("phone", "email", "tid")], ids.mask("tid").alias("value"))


@query(f"""WITH {_RECORDS} SELECT id, CASE WHEN account_number IS NULL THEN false ELSE (list_sum(list_transform(range(1, 10), lambda i: substr(account_number, i, 1)::INT * [3, 7, 3][(i - 1) % 3 + 1])) + substr(account_number, 10, 1)::INT) % 10 = 0 END AS valid FROM records""")
def account_check(spark, d):
    return records(spark, d).select("id", ids.valid_account("account_number").alias("valid"))


_SHAPED = "case o_orderkey % 12 when 0 then 'mx' || lpad(cast(o_orderkey as string), 6, '0') when 1 then '2ISW' || lpad(cast(o_orderkey as string), 11, 'A') when 2 then '2ISW' || lpad(cast(o_orderkey % 10000 as string), 4, '0') when 3 then lpad(cast(o_orderkey as string), 8, '0') when 4 then lpad(cast(o_orderkey as string), 12, '0') when 5 then lpad(cast(o_orderkey as string), 11, '2') when 6 then '0803' || lpad(cast(o_orderkey as string), 7, '0') when 7 then lpad(cast(o_orderkey as string), 10, '1') when 8 then lpad(cast(o_orderkey as string), 7, '0') when 9 then lpad(cast(o_orderkey as string), 6, '0') when 10 then 'a' || cast(o_orderkey as string) || '@example.com' else 'plain words ' || cast(o_custkey as string) end"


@query(f"""SELECT o_orderkey, {_SHAPED} AS value, CASE o_orderkey % 12 WHEN 0 THEN 'mxcode' WHEN 1 THEN 'mid' WHEN 2 THEN 'tid' WHEN 3 THEN 'tid' WHEN 4 THEN 'bvn' WHEN 5 THEN 'bvn,phone' WHEN 6 THEN 'bvn,phone' WHEN 7 THEN 'static,account' WHEN 8 THEN 'payable' WHEN 9 THEN 'alias'
    WHEN 10 THEN 'email' ELSE '' END AS kinds FROM orders""")
def classified(spark, d):
    rows = _table(spark, d, "orders").selectExpr("o_orderkey", f"{_SHAPED} as value")
    return rows.withColumn("kinds", F.array_join(ids.shape_kinds("value"), ","))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def dates_read(spark, d):
    spelt = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "d MMMM yyyy"))
    return _table(spark, d, "orders").select("o_orderkey", ids.date_key(spelt).alias("day"))


@query("""WITH n AS (SELECT DISTINCT p_name FROM part) SELECT p_name, round(1 - levenshtein(p_name, 'red widget') / greatest(length(p_name), 10), 6) AS edit,
    round(1 - damerau_levenshtein(p_name, 'red widget') / greatest(length(p_name), 10), 6) AS swap FROM n""")
def name_similarity(spark, d):
    names = _table(spark, d, "part").select("p_name").distinct()
    return names.select("p_name", F.round(similarity.levenshtein_similarity(F.col("p_name"), F.lit("red widget")), 6).alias("edit"), F.round(similarity.udf("damerau_similarity")(F.col("p_name"), F.lit("red widget")), 6).alias("swap"))


@query(None)
def fuzzy_names(spark, d):
    """Distinct names by how alike they are to a request, by three measures."""
    names = _table(spark, d, "part").select("p_name").distinct()
    return names.select("p_name", *[F.round(similarity.udf(k)(F.col("p_name"), F.lit("widget rde")), 6).alias(k) for k in ("ratio", "token_set_ratio", "partial_ratio", "sound_similarity")])


@query("""WITH p AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), a AS (SELECT label, i, avg(v) AS v FROM p GROUP BY ALL),
    e AS (SELECT label, list(v ORDER BY i) AS x FROM a GROUP BY label),
    s AS (SELECT vec_id, e.label, max(round(list_dot_product(embedding::DOUBLE[], x) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(x, x)), 6)) AS s FROM embeddings, e GROUP BY ALL),
    r AS (SELECT *, row_number() OVER w AS k, lead(s) OVER w AS t FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY s DESC, label))
    SELECT vec_id, label, s AS similarity, round(s - coalesce(t, 0), 6) AS margin FROM r WHERE k = 1""")
def semantic_intent(spark, d):
    """Exemplars are the means of all vectors of each label, so one a label and none left out."""
    vectors = _table(spark, d, "embeddings")
    return learning.best_exemplar(vectors, learning.means(vectors))


@query("""WITH RECURSIVE l AS (SELECT DISTINCT doc_id AS id, unnest(string_split(text, chr(10))) AS value FROM documents), m AS (SELECT * FROM l WHERE length(value) >= 40),
    k AS (SELECT value, min(id) AS b FROM m GROUP BY value HAVING count(*) >= 2), e AS (SELECT DISTINCT id AS a, b FROM m JOIN k USING (value) WHERE id <> b),
    u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS id, a AS c FROM u UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.id WHERE r.c < u.b)
    SELECT id, least(id, min(c)) AS cluster_id FROM r GROUP BY id""")
def entity_clusters(spark, d):
    """Documents that share a line with any other, however many have it."""
    lines = _table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.explode(F.split("text", "\n")).alias("value")).where("length(value) >= 40").distinct()
    return entities.clusters(entities.stars(lines))


@query("SELECT user_id, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen, count(DISTINCT event_type) AS variants FROM events GROUP BY user_id")
def timeline(spark, d):
    return entities.timeline(_table(spark, d, "events"), "user_id", "ts", "event_type", "event_id")


@query("""SELECT user_id, event_id, ts, old, event_type AS new FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts NULLS LAST, event_id) AS old FROM events) WHERE old <> event_type""")
def change_history(spark, d):
    return entities.changes(_table(spark, d, "events"), "user_id", "ts", "event_type", "event_id")


_BANDS = "b AS (SELECT (floor(value / 20) * 20)::INT AS band, count(*) AS n, count(*) FILTER (event_type <> 'error') AS accepted FROM events GROUP BY band)"


@query(f"WITH {_BANDS} SELECT *, round(accepted / n, 6) AS rate FROM b")
def decision_bands(spark, d):
    return learning.bands(_table(spark, d, "events"), "value", F.col("event_type") != "error")


@query(f"""WITH {_BANDS}, r AS (SELECT *, round(accepted / n, 6) AS rate FROM b), m AS (SELECT max(band) FILTER (n >= 3 AND rate < 0.7) AS missed, min(band) FILTER (n >= 3) AS low, sum(n)::BIGINT AS n_decisions FROM r)
    SELECT greatest(20, least(90, CASE WHEN n_decisions < 20 THEN 60 WHEN missed IS NOT NULL THEN missed + 20 ELSE least(60, low) END)) AS threshold, n_decisions FROM m""")
def ask_threshold(spark, d):
    return learning.threshold(decision_bands(spark, d), target=0.7)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS highest FROM events GROUP BY ALL")
def telemetry_windows(spark, d):
    return windows.rolling(_table(spark, d, "events"), "ts", "event_type", "value")


def _intent_sql() -> str:
    score = lambda w: " + ".join(f"least(len(regexp_extract_all(lower(coalesce(text, '')), '{p}')), 2) * {x}" for p, x in w.items())
    each = " UNION ALL ".join(f"SELECT conv_id, turn, '{i}' AS intent, ({score(w)})::DOUBLE AS score FROM conversations" for i, w in INTENTS.items())
    return f"SELECT *, least(100, floor(score * 12))::INT AS confidence FROM ({each}) WHERE score > 0"


@query(_intent_sql())
def intent_scores(spark, d):
    return learning.intents(_table(spark, d, "conversations").select("conv_id", "turn", "text"), "text", INTENTS)


@query("""WITH w AS (SELECT role, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM conversations),
    g AS (SELECT role AS label, unnest(list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) AS gram FROM w)
    SELECT gram, label, count(*) AS n FROM g GROUP BY gram, label HAVING count(*) >= 5""")
def mined_phrases(spark, d):
    return learning.phrases(_table(spark, d, "conversations"), "text", "role", 5)
