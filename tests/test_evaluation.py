"""Routing, drift, remembered phrases, wordings, weights, ciphers, on cases worked out by hand or tried all."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from rollbook.operators import evaluation, governance


def test_routing_and_drift(spark):
    rows = [("a", "email", "email", False), ("b", "email", "phone", False), ("c", "email", None, None), ("d", "bank", "bank", True), ("e", "bank", "resolve", False)]
    df = spark.createDataFrame(rows, "request string, intent string, found string, asks boolean").withColumn("outcome", evaluation.routing(F.col("intent"), F.col("found"), F.col("asks")))
    assert {r["request"]: r["outcome"] for r in df.collect()} == {"a": "routed", "b": "misroute", "c": "miss", "d": "clarify", "e": "miss"}
    assert sorted(map(tuple, evaluation.routing_matrix(df).collect())) == [("bank", 0, 1, 0, 1, 2), ("email", 1, 0, 1, 1, 3)]
    before = spark.createDataFrame([("a", "routed"), ("b", "routed"), ("c", "miss"), ("z", "miss")], "request string, outcome string")
    assert list(map(tuple, evaluation.drift(df, before).collect())) == [("b", "routed", "misroute")]
    levels = spark.createDataFrame([(0,), (1,), (4,), (5,), (None,)], "n int").select("n", evaluation.level(F.col("n")).alias("status"))
    assert [r["status"] for r in levels.collect()] == ["ok", "warning", "warning", "critical", "ok"]
    assert [evaluation.overall(levels.where(c)).first()["status"] for c in ("true", "n < 5", "n = 0", "n > 9")] == ["critical", "warning", "ok", "ok"]


def test_preferences(spark):
    df = spark.createDataFrame([("Get account details for Medplus", ["medplus"]), ("the account details of MX12345 please", None), ("08031234567", []), (None, ["x"])], "text string, names array<string>")
    assert [r[0] for r in df.select(evaluation.phrase_key("text", F.col("names"))).collect()] == ["account details", "account details", "", ""]
    picks = [(1, 1, "a", "learn", "email"), (2, 2, "a", "learn", "phone"), (3, 1, "b", "learn", "bank"), (4, 3, "b", "forget", None), (5, 9, "", "learn", "bank"), (6, 1, "c", "forget", None), (7, 2, "c", "learn", "tid"), (8, 9, "c", "learn", "")]
    assert sorted(map(tuple, evaluation.preferences(spark.createDataFrame(picks, "id int, ts int, key string, action string, intent string")).collect())) == [("a", "phone"), ("c", "tid")]


def test_wordings(spark):
    phrases = spark.createDataFrame([("static", "static account"), ("static", "Static  Account"[0:6] + " account"), ("email", "the mail"), ("email", None), ("bank", "one two three four")], "intent string, phrase string")
    synonyms = spark.createDataFrame([("account", s) for s in "a b c d e f g h".split()] + [("static", "fixed"), ("static", "static"), ("mail", "post"), ("mail", "message text body"), ("four", "a b"), ("the", "a")], "word string, synonym string")
    live = spark.createDataFrame([("static", "static a"), ("other", "static b"), ("other", "fixed"), ("email", "post")], "intent string, phrase string")
    got = evaluation.wordings(phrases, synonyms, live).orderBy("intent", "phrase").collect()
    assert [(r["intent"], r["phrase"], r["source_word"], r["conflict"]) for r in got] == [
        ("email", "the message text body", "mail", False), ("static", "fixed account", "static", False), ("static", "static b", "account", True), *[("static", f"static {s}", "account", False) for s in "cdef"],
    ]


def test_affinity(spark):
    rows = [("A@x.com", "Red Sun", None, ["a@X.com"], []), ("", "The Red-Sun Ltd", "", [""], ["red sun"]), ("b@x.com", None, "RED SUN", ["a@x.com"], ["redsun", ""]), (None, "x", "y", None, None)]
    df = spark.createDataFrame(rows, "email string, merchant_name string, slip_header string, emails array<string>, names array<string>").withColumn("account_name", F.lit(""))
    assert [r[0] for r in df.select(evaluation.affinity(F.col("emails"), F.col("names"))).collect()] == [2, 1, 1, 0]


def first_right(rows, weights, floor=30):
    best = {}
    for q, i, ok, *scores in rows:
        on = [(s, w) for s, w in zip(scores, weights, strict=True) if s is not None and s >= floor]
        held = sum(w for _, w in on)
        key = (round(sum(s * w for s, w in on) / held, 9) if held else 0.0, -i)
        if q not in best or key > best[q][0]:
            best[q] = (key, ok)
    return sum(ok for _, ok in best.values())


def test_weights_are_fitted(spark):
    rng = random.Random(5)
    rows = []
    for q in range(12):
        right = rng.randrange(5)
        for i in range(5):
            rows.append((q, q * 10 + i, i == right, float(rng.randrange(20, 100)), float(90 if i == right else rng.randrange(20, 89)), None if i == 3 else float(rng.randrange(0, 100))))
    df = spark.createDataFrame(rows, "query int, id int, correct boolean, a double, b double, c double")
    start = {"a": 40, "b": 10, "c": 30}
    found, hits = evaluation.fit_weights(df, start)
    assert hits == first_right(rows, found.values()) > first_right(rows, start.values())
    # No single step from there gains.
    for i, field in enumerate(found):
        for x in (0.5, 0.75, 1.25, 1.5, 2.0):
            tried = dict(found) | {field: max(0, int(found[field] * x))}
            assert not sum(tried.values()) or first_right(rows, tried.values()) <= hits, (i, x)
    assert evaluation.fit_weights(df.limit(0), start) == (start, 0)


def test_ciphers(spark):
    df = spark.createDataFrame([(1, "0123456789", "a@x.com", "n"), (2, "", None, "m"), (3, "0123456789", "é", None)], "id int, account_number string, email string, name string")
    key = F.lit("0" * 32)
    closed = governance.enciphered(df, key)
    rows = {r["id"]: r for r in closed.collect()}
    assert rows[1]["account_number"] != rows[3]["account_number"] != "0123456789" and (rows[2]["account_number"], rows[2]["email"], rows[1]["name"]) == ("", None, "n")
    table = spark.createDataFrame(list(rows.values()), closed.schema)
    assert governance.deciphered(table, key).orderBy("id").collect() == df.orderBy("id").collect()
    assert governance.deciphered(table, F.lit("1" * 32)).where("id = 1").first()["email"] is None
    assert governance.seen_by(df, "admin") is df
    assert governance.seen_by(df, "viewer").where("id = 1").first()["account_number"] != "0123456789"
