"""Registered queries of planning and evaluation, on requests read off the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.operators import evaluation, governance, planning
from rollbook.plans.catalogue import _table, query

#: Patterns that the invented prose of conversations matches: by letters, not by words.
PATTERNS = {
    "static_account": {r"\bthst\w*": 3.0, r"\bwh\w*": 0.5}, "mxcode": {r"\bhe\w*": 1.5}, "account_name": {r"\band\b": 2.0, r"\bin\b": 1.0}, "email": {r"\bthe?\b": 1.0, r",": 1.0}, "phone": {r"\ban\w*": 1.0},
    "count": {r"\bst\w*": 1.0}, "change_details": {r"\bor\w*": 2.0}, "profile": {r"\bha\w*": 1.0}, "top": {r"\bthin\w*": 1.0}, "bank": {r"\bre\w*": 1.0}, "coverage": {r"\bit\w*": 1.0}, "address": {r"\.": 0.75},
}


def _score(words) -> str:
    return " + ".join(f"least(len(regexp_extract_all(low, '{p}')), 2) * {w}" for p, w in words.items())


def _ranked() -> str:
    """SQL of the ranked intents, a row each: a relation for every rule over the one before."""
    cells = " UNION ALL ".join(f"SELECT conv_id, turn, {i} AS place, '{name}' AS intent, ({_score(words)})::DOUBLE AS score FROM low" for i, (name, words) in enumerate(PATTERNS.items()))
    out = f"low AS (SELECT conv_id, turn, trim(regexp_replace(lower(regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', 'q', 'g')), '\\s+', ' ', 'g')) AS low FROM conversations), r0 AS (SELECT * FROM ({cells}) WHERE score > 0)"
    for n, (winners, losers, how) in enumerate([r for r in planning.SUBSUMED if r[2] != "if weak"]):
        listed = lambda names: ", ".join(f"'{x}'" for x in names)
        least = " AND w.score >= r.score" if how == "unless higher" else ""
        out += f", r{n + 1} AS (SELECT * FROM r{n} r WHERE NOT (intent IN ({listed(losers)}) AND EXISTS (SELECT 1 FROM r{n} w WHERE w.conv_id = r.conv_id AND w.turn = r.turn AND w.intent IN ({listed(winners)}){least})))"
    return out + f", ranked AS (SELECT * FROM r{n + 1})"


_RANKED = _ranked()


def _requests(spark, d):
    """Turns with a letter q for each character that is not ASCII: where words end beside one, regular expressions of the two engines differ."""
    rows = _table(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace("text", r"[^\x00-\x7F]", "q").alias("text"))
    return planning.ranked(rows, "text", PATTERNS).drop("text")


@query(f"WITH {_RANKED} SELECT low.conv_id, low.turn, coalesce(string_agg(intent || '=' || round(score * 100)::INT, ',' ORDER BY score DESC, place), 'resolve=0') AS intents FROM low LEFT JOIN ranked USING (conv_id, turn) GROUP BY ALL")
def ranked_intents(spark, d):
    shown = F.transform("intents", lambda x: F.concat(x["intent"], F.lit("="), F.round(x["score"] * 100).cast("int")))
    return _requests(spark, d).select("conv_id", "turn", F.array_join(shown, ",").alias("intents"))


_VERBS = " ".join(f"WHEN '{k}' THEN '{planning.STEPS[k][0]}'" for k in PATTERNS if k in planning.STEPS)


@query(f"""WITH {_RANKED}, s AS (SELECT conv_id, turn, intent, -score AS minus, place, 1 AS r, false AS synthesized FROM ranked UNION ALL SELECT conv_id, turn, 'mxcode', -score, place, 0, true FROM ranked WHERE intent = 'static_account' AND turn % 2 = 1)
    SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY minus, place, r)::INT AS place, CASE intent {_VERBS} END AS step, CASE WHEN intent = 'static_account' THEN 'resolve_mxcode' ELSE '' END AS requires, synthesized FROM s""")
def request_plans(spark, d):
    """Steps of requests, those of every other turn with a terminal's identifier, which spares a step."""
    steps = planning.plan(_requests(spark, d), F.when(F.col("turn") % 2 == 0, F.array(F.lit("tid"))), F.lit(True))
    return steps.select("conv_id", "turn", "place", "step", F.array_join("requires", ",").alias("requires"), "synthesized")


@query(f"""WITH {_RANKED}, open AS (SELECT low.conv_id, low.turn, k.* FROM low, (SELECT unnest({list(planning.CHAINABLE)}) AS intent, unnest(range({len(planning.CHAINABLE)})) AS o) k WHERE NOT EXISTS (SELECT 1 FROM ranked r WHERE r.conv_id = low.conv_id AND r.turn = low.turn AND r.intent = k.intent)),
    n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY o)::INT AS place FROM open) SELECT conv_id, turn, place, intent FROM n WHERE place <= 3""")
def proposed_steps(spark, d):
    return planning.next_steps(_requests(spark, d), F.array(F.lit("X"))).drop("prompt")


_TYPED = {"email": {r"\bemails?\b": 5.0}, "phone": {r"\bphones?\b": 5.0}, "bank": {r"\bbanks?\b": 5.0}}
_TID, _MX = "lpad(cast(s_suppkey * 3 + 10000000 as string), 8, '0')", "'MX' || lpad(cast(s_suppkey as string), 5, '0')"
_ASKS = f"case s_suppkey % 3 when 0 then 'get email for ' || {_TID} || ' and phone for ' || {_MX} when 1 then {_TID} || ', email and bank for ' || {_MX} else 'email for ' || {_TID} || '; ' || {_MX} || ' then the bank of ' || s_name end"


@query(f"""SELECT s_suppkey, unnest(CASE s_suppkey % 3 WHEN 0 THEN ['email', 'phone'] WHEN 1 THEN ['email', 'email', 'bank', 'bank'] ELSE ['email', 'email'] END) AS intent,
    unnest(CASE s_suppkey % 3 WHEN 1 THEN [{_TID}, {_MX}, {_TID}, {_MX}] ELSE [{_TID}, {_MX}] END) AS token, s_suppkey % 3 <> 1 AS scoped FROM supplier""")
def request_scopes(spark, d):
    return planning.scopes(_table(spark, d, "supplier").selectExpr("s_suppkey", f"{_ASKS} as text"), "s_suppkey", "text", _TYPED)


_FILTERED = "case s_suppkey % 4 when 0 then 'top ' || cast(s_suppkey % 60 as string) || ' stations in ' when 1 then 'which have no phone or email in ' when 2 then cast(s_suppkey as string) || ' rows with an address, ' else 'list missing locations of ' end || n_name"


@query("""SELECT s_suppkey, n_name AS state, CASE s_suppkey % 4 WHEN 2 THEN 'address' ELSE '' END AS has, CASE s_suppkey % 4 WHEN 1 THEN 'email,phone' WHEN 3 THEN 'address' ELSE '' END AS missing,
    CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey % 60 WHEN s_suppkey % 4 = 2 AND s_suppkey < 10000 THEN least(s_suppkey, 5000) ELSE -1 END::INT AS most_rows FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def request_parameters(spark, d):
    rows = _table(spark, d, "supplier").join(_table(spark, d, "nation"), F.expr("s_nationkey = n_nationkey")).selectExpr("s_suppkey", f"{_FILTERED} as text")
    names = [r[0] for r in _table(spark, d, "nation").select("n_name").collect()]
    state, has, missing, most = planning.parameters("text", {n: (n,) for n in names})
    return rows.select("s_suppkey", state, F.array_join(has, ",").alias("has"), F.array_join(missing, ",").alias("missing"), F.coalesce(most, F.lit(-1)).alias("most_rows"))


@query("""WITH e AS (SELECT *, CASE WHEN event_type = 'purchase' THEN 'e' || event_id END AS own FROM events), c AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old FROM e)
    SELECT event_id, CASE WHEN own IS NOT NULL THEN own WHEN event_type = 'view' THEN coalesce(old, '') ELSE '' END AS entities, own IS NULL AND event_type = 'view' AND old IS NOT NULL AS inherited FROM c""")
def request_context(spark, d):
    """Events as requests: purchases name something, views refer back to it."""
    rows = _table(spark, d, "events").selectExpr("event_id", "user_id", "ts", "case when event_type = 'purchase' then array('e' || cast(event_id as string)) else cast(array() as array<string>) end as entities", "case when event_type = 'view' then 'email of the above merchant' else event_type end as text")
    return planning.with_context(rows, "user_id", "ts", "event_id", "entities", "text").select("event_id", F.array_join("entities", ",").alias("entities"), "inherited")


_ROUTED = "CASE WHEN value < 20 THEN 'miss' WHEN value < 60 THEN 'clarify' WHEN user_id % 3 = 0 THEN 'misroute' ELSE 'routed' END"


def _outcomes(spark, d):
    found = F.when(F.col("value") < 20, "resolve").when(F.col("user_id") % 3 == 0, "other").otherwise(F.col("event_type"))
    return _table(spark, d, "events").select("event_id", F.col("event_type").alias("intent"), evaluation.routing(F.col("event_type"), found, F.col("value") < 60).alias("outcome"))


@query(f"WITH o AS (SELECT event_type AS intent, {_ROUTED} AS outcome FROM events) SELECT intent, count(*) FILTER (outcome = 'routed') AS routed, count(*) FILTER (outcome = 'clarify') AS clarify, count(*) FILTER (outcome = 'misroute') AS misroute, count(*) FILTER (outcome = 'miss') AS miss, count(*) AS n FROM o GROUP BY intent")
def routing_matrix(spark, d):
    return evaluation.routing_matrix(_outcomes(spark, d))


@query(f"SELECT event_id AS request, was, now FROM (SELECT event_id, {_ROUTED} AS now, CASE WHEN event_type = 'error' THEN 'miss' ELSE 'routed' END AS was FROM events) WHERE now <> was")
def routing_drift(spark, d):
    before = _table(spark, d, "events").select(F.col("event_id").alias("request"), F.when(F.col("event_type") == "error", "miss").otherwise("routed").alias("outcome"))
    return evaluation.drift(_outcomes(spark, d).withColumnRenamed("event_id", "request"), before)


@query("""WITH p AS (SELECT event_id AS id, ts, 'u' || user_id AS key, CASE WHEN event_type = 'error' THEN 'forget' ELSE 'learn' END AS action, event_type AS intent FROM events), l AS (SELECT key, arg_max({'a': action, 'i': intent}, (ts, id)) AS l FROM p GROUP BY key)
    SELECT key, l.i AS intent FROM l WHERE l.a = 'learn'""")
def remembered_picks(spark, d):
    picks = _table(spark, d, "events").selectExpr("event_id as id", "ts", "concat('u', user_id) as key", "case when event_type = 'error' then 'forget' else 'learn' end as action", "event_type as intent")
    return evaluation.preferences(picks)


_SYNONYMS = ["anchor", "bolt", "gear", "valve", "widget", "rod", "plate", "spring"]
_TWO = "lower(string_split(p_name, ' ')[1] || ' ' || string_split(p_name, ' ')[2])"


@query(f"""WITH ph AS (SELECT DISTINCT p_brand AS intent, {_TWO} AS phrase FROM part), syn AS (SELECT unnest({_SYNONYMS}) AS synonym), w AS (SELECT *, string_split(phrase, ' ')[1] AS a, string_split(phrase, ' ')[2] AS b FROM ph),
    m AS (SELECT intent, phrase AS source_phrase, a || ' ' || synonym AS phrase, b AS source_word, synonym FROM w, syn WHERE synonym <> b), f AS (SELECT m.* FROM m ANTI JOIN ph USING (intent, phrase)),
    n AS (SELECT *, row_number() OVER (PARTITION BY intent, source_phrase ORDER BY synonym) AS k FROM f WHERE length(phrase) >= 4)
    SELECT sha1(intent || '|' || phrase) AS id, intent, phrase, source_phrase, source_word, synonym, phrase IN (SELECT phrase FROM ph) AS conflict FROM n WHERE k <= 6""")
def new_wordings(spark, d):
    """First two words of part names by brand; any of eight words may stand for the second."""
    w = F.split(F.lower("p_name"), " ")
    phrases = _table(spark, d, "part").select(F.col("p_brand").alias("intent"), F.concat_ws(" ", F.get(w, F.lit(0)), F.get(w, F.lit(1))).alias("phrase")).distinct()
    words = phrases.select(F.get(F.split("phrase", " "), F.lit(1)).alias("word")).distinct()
    return evaluation.wordings(phrases, words.select("word", F.explode(F.array(*map(F.lit, _SYNONYMS))).alias("synonym")).where("word <> synonym"), phrases)


@query("SELECT c_custkey, c_name AS alias, lpad(c_custkey::VARCHAR, 10, '0') AS account_number, true AS closed FROM customer")
def cipher_round_trip(spark, d):
    """Customers' fields enciphered and opened again; closed tells that no cell was left in the clear."""
    rows = _table(spark, d, "customer").selectExpr("c_custkey", "c_name as alias", "lpad(cast(c_custkey as string), 10, '0') as account_number")
    key = F.lit("0123456789abcdef0123456789abcdef")
    shut = governance.enciphered(rows, key)
    closed = shut.withColumns({"alias_closed": F.col("alias"), "number_closed": F.col("account_number")})
    out = governance.deciphered(closed, key)
    return out.select("c_custkey", "alias", "account_number", ((F.col("alias_closed") != F.col("alias")) & (F.col("number_closed") != F.col("account_number"))).alias("closed"))
