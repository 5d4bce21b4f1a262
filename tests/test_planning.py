"""Requests to plans, on cases worked out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.operators import planning

PATTERNS = {
    "static_account": {r"\bstatic accounts?\b": 6.0}, "mxcode": {r"\bmx codes?\b": 5.0}, "email": {r"\be-?mails?\b": 5.0}, "phone": {r"\bphones?\b": 5.0}, "count": {r"\bhow many\b": 8.0, r"\bnumber of\b": 4.0},
    "change_details": {r"\bchange of\b": 6.0, r"\baccount details\b": 2.0}, "account_name": {r"\baccount name\b": 7.0}, "top": {r"\btop \d+\b": 6.0}, "bank": {r"\bbanks?\b": 4.0}, "profile": {r"\bdetails\b": 3.0},
}
KEYWORDS = {"email": ("email", "mail"), "phone": ("phone", "telephone"), "change_details": ("change history", "change"), "count": ("count",)}


def intents(spark, *texts, keywords=KEYWORDS):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return [[x["intent"] for x in r["intents"]] for r in planning.ranked(df, "text", PATTERNS, keywords).orderBy("id").collect()]


def test_ranking_and_subsumption(spark):
    assert intents(
        spark, "get the static account and mx code of X", "static account and account name", "number of phones", "how many phones", "top 10 banks", "static account and account details", "static account and change of account",
        "change of name and details", None, "", "emails emails emails and phone", "get the email but not the phone, and also the mx code",
    ) == [
        ["static_account"], ["account_name", "static_account"], ["phone"], ["count", "phone"], ["top"], ["static_account"], ["static_account", "change_details"],
        ["change_details"], ["resolve"], ["resolve"], ["email", "phone"], ["mxcode", "email"],
    ]


def test_negations(spark):
    texts = ["all but not the change history, and the email", "not an email please", "not available in the email file", "skip phones; skip emails", "without email", "excluding the account", f"except {'x' * 90} email", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    assert [r[0] for r in df.orderBy("id").select(planning.negated("text", KEYWORDS)).collect()] == [["change_details"], ["email"], [], ["email", "phone"], [], [], [], []]


def test_plans(spark):
    rows = [(1, "static account", [], True), (2, "static account", ["tid"], False), (3, "static account", [], False), (4, "email, phone", [], True), (5, "hello", [], True)]
    df = planning.ranked(spark.createDataFrame(rows, "id int, text string, kinds array<string>, named boolean"), "text", PATTERNS)
    got = {}
    for r in planning.plan(df, F.col("kinds"), F.col("named")).orderBy("id", "place").collect():
        got.setdefault(r["id"], []).append((r["place"], r["step"], r["requires"], r["synthesized"]))
    static = "fetch_static_account"
    assert got == {1: [(1, "resolve_mxcode", [], True), (2, static, ["resolve_mxcode"], False)], 2: [(1, static, ["resolve_mxcode"], False)], 3: [(1, static, ["resolve_mxcode"], False)], 4: [(1, "fetch_email", [], False), (2, "fetch_phone", [], False)]}


def test_steps_wait_for_what_they_require(spark):
    names = spark.createDataFrame([(1, [("c", 3.0, []), ("b", 2.0, []), ("a", 1.0, []), ("email", 0.5, [])])], "id int, intents array<struct<intent:string,score:double,matched:array<string>>>")
    order = lambda requires: [r["step"] for r in planning.plan(names, F.array(F.lit("tid")), F.lit(True), requires).orderBy("place").collect()]
    assert order({"c": ("b",), "b": ("a",)}) == ["run_a", "fetch_email", "run_b", "run_c"]
    assert order({"b": ("c",)}) == ["run_c", "run_b", "run_a", "fetch_email"]
    assert order({}) == ["run_c", "run_b", "run_a", "fetch_email"]
    assert order({"a": ("z",), "c": ("z",)}) == ["run_z", "run_c", "run_b", "run_a", "fetch_email"]


def test_what_steps_run_on(spark):
    steps = spark.createDataFrame([(1, "resolve_mxcode", []), (1, "fetch_static_account", ["resolve_mxcode"]), (2, "fetch_email", [])], "id int, step string, requires array<string>")
    given = spark.createDataFrame([(1, "name", "X"), (1, "mxcode", "mx1"), (2, "tid", "T")], "id int, kind string, value string")
    made = spark.createDataFrame([(1, "resolve_mxcode", "mxcode", "MX1"), (1, "resolve_mxcode", "mxcode", "MX2"), (1, "resolve_mxcode", "mxcode", ""), (2, "other", "tid", "U")], "id int, step string, kind string, value string")
    assert sorted(map(tuple, planning.step_inputs(steps, "id", given, made).collect())) == [
        (1, "fetch_static_account", "mxcode", "MX2", True), (1, "fetch_static_account", "mxcode", "mx1", False), (1, "fetch_static_account", "name", "X", False),
        (1, "resolve_mxcode", "mxcode", "mx1", False), (1, "resolve_mxcode", "name", "X", False), (2, "fetch_email", "tid", "T", False),
    ]


def test_next_steps(spark):
    df = planning.ranked(spark.createDataFrame([(1, "email", ["A", "B", "A"]), (2, "email", [])], "id int, text string, given array<string>"), "text", PATTERNS)
    assert [(r["place"], r["intent"], r["prompt"]) for r in planning.next_steps(df, F.col("given")).orderBy("id", "place").collect()] == [(1, "tid", "A\nB\nget the TIDs for these"), (2, "mxcode", "A\nB\nget the MX codes for these"), (3, "phone", "A\nB\nget the phone numbers for these")]


def test_scopes(spark):
    texts = ["get email for 2103O338 and phone for MX141692", "email for 2103A338 and 2103A340", "2103A338, email for MX141692", "email for 2103A338", "Rubels and Angels", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in planning.scopes(df, "id", "text", PATTERNS).collect():
        got.setdefault(r["id"], set()).add((r["intent"], r["token"], r["scoped"]))
    assert got == {
        0: {("email", "2103O338", True), ("phone", "MX141692", True)}, 1: {("email", "2103A338", True), ("email", "2103A340", True)},
        2: {("email", "2103A338", False), ("email", "MX141692", False)}, 3: {("email", "2103A338", False)},
    }


def test_parameters_and_pairs(spark):
    states = {"LAGOS": ("LAGOS", "LA"), "ANAMBRA": ("ANAMBRA", "AN")}
    texts = ["addresses of all stations in lagos with email", "which have no email or phone", "top 20 of an", "give 9999 rows in LA", "has an address but no phone number", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").orderBy("id")
    assert [tuple(r) for r in df.select(*planning.parameters("text", states, ("LA",))).collect()] == [
        ("LAGOS", ["email"], [], None), ("", [], ["email", "phone"], None), ("", [], [], 20), ("LAGOS", [], [], 5000), ("", ["address"], ["phone"], None), ("", [], [], None),
    ]
    pairs = spark.createDataFrame([(0, "compare Lagoon Waters vs Artee Industries"), (1, "MX141692 vs MX183639"), (2, "show me Red Sun against red sun"), (3, None)], "id int, text string").orderBy("id")
    assert [r[0] for r in pairs.select(planning.compared_pair("text")).collect()] == [["LAGOON WATERS", "ARTEE INDUSTRIES"], [], ["RED SUN"], []]


def test_context(spark):
    rows = [
        (1, "a", "2024-01-01 10:00:00", ["X"], "email of X"), (2, "a", "2024-01-01 10:01:00", [], "phone of the above merchant"), (3, "a", "2024-01-01 15:00:00", [], "and the previous one's bank"), (4, "a", "2024-01-01 15:01:00", [], "top 10"),
        (5, "b", "2024-01-01 10:00:00", None, "the above"), (6, None, "2024-01-01 10:00:00", ["Y"], "y"), (7, None, "2024-01-01 10:01:00", [], "the above"), (8, "a", "2024-01-02 00:00:00", ["Z"], "the above"), (9, "a", "2024-01-02 00:00:00", [], "as above"),
    ]
    df = spark.createDataFrame(rows, "id int, session string, ts string, entities array<string>, text string")
    got = {r["id"]: (r["entities"], r["inherited"]) for r in planning.with_context(df, "session", "ts", "id", "entities", "text").collect()}
    assert got == {1: (["X"], False), 2: (["X"], True), 3: (["X"], True), 4: ([], False), 5: (None, False), 6: (["Y"], False), 7: ([], False), 8: (["Z"], False), 9: (["Z"], True)}
