"""Rules of identifiers, masks, requests and families, held against cases worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rollbook.functions import identifiers as ids
from rollbook.operators import enrichment, entities, families, governance, learning, reports, requests


def column(spark, expression, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", expression.alias("out"))
    return [r["out"] for r in sorted(rows.collect())]


def test_account_check_digit(spark):
    # 1*3 + 0... : nine digits 100000000 weigh 3, so the check digit is 7; 000000000 weigh 0, so it is 0
    assert column(spark, ids.valid_account("v"), ["1000000007", "1000000006", "0000000000", "100-000-0007", "123", None]) == [True, False, True, True, False, False]


@pytest.mark.parametrize(("field", "value", "shown"), [
    ("bvn", "22212345678", "***-***-5678"), ("account_number", "0123456789", "******6789"), ("phone", "08031234567", "08*******4567"), ("email", "abcd@example.com", "ab**@example.com"), ("email", "a@example.com", "*@example.com"),
    ("tid", "2ISW1234", "2I****34"), ("tid", "abcd", "a**d"), ("tid", "ab", "*"), ("bvn", "123", "1*3"), ("email", "not mail", "no****il"), ("phone", "", ""), ("phone", None, ""),
])
def test_masked_fields(spark, field, value, shown):
    assert column(spark, ids.mask_field(field, "v"), [value]) == [shown]


def test_masked_values(spark):
    assert column(spark, ids.mask("v"), ["abcdefgh", "abcde", "a", "", None]) == ["abc***gh", "a****", "a*", "", ""]


def test_code_like_names(spark):
    names = ["4789.0", "AB", "2ISW1234", "XKCDQ", "XKCD", "BAKERY", "Bakery 12", "", "lower", "1A LONG NAME"]
    assert column(spark, ids.code_like_name("v"), names) == [True, True, True, True, False, False, False, False, False, False]


def test_addresses(spark):
    values = ["PLOT 5, BLOCK C, ADMIRALTY WAY", "MEDICAL PHARMACY", "12 OLD ROAD, LEKKI", "LEKKI LAGOS", "ONE ROAD", None]
    assert column(spark, ids.address_like("v"), values) == [True, False, True, True, False, False]


def test_enrichment_of_seven_records(spark):
    raw = '{"OLD BANK ACC NO": "1111111111", "NEW BANK ACC NO": "2222222222", "OLD BANK CODE": "057", "MONTH OF REQUEST": "12/03/2024"}'
    rows = [
        (1, "a.xlsx :: S", "WHOLE", "10000001", "MX10001", "M1", "1000000001", "w@example.com", "08000000001", "1 Road", "2024-01-05", None), (2, "a.xlsx :: S", "BARE", "", "", "", "", "", "", "", "", "not json"),
        (3, "a.xlsx :: S", "LEFT", "10000003", "MX10003", "", "1000000003", "s@example.com", "08000000003", "x", "", None), (4, "b.xlsx :: S", "RIGHT", "10000003", "MX10004", "", "1000000004", "s@example.com", "08000000003", "x", "", None),
        (5, "a.xlsx :: S", "ONE NAME", "10000005", "MX10005", "M5", "1000000005", "o@example.com", "08000000005", "x", "05/02/2024", None), (6, "b.xlsx :: S", "OTHER NAME", "10000005", "MX10005", "M5", "1000000005", "o@example.com", "08000000005", "x", "Mar 2024", None),
        (7, "c.xlsx :: Change sheet", "MOVED", "10000007", "", "", "2222222222", "m@example.com", "n/a", "x", "", raw),
    ]
    df = spark.createDataFrame(rows, "id bigint, sheet_name string, merchant_name string, tid string, mxcode string, merchant_id string, account_number string, email string, phone string, address string, onboarded_date string, raw_data string")
    scored = {r["id"]: (r["quality_score"], r["quality_flags"]) for r in enrichment.quality(df).collect()}
    assert scored[1] == (100, []) and scored[2] == (35, ["missing_email", "missing_phone", "missing_account", "missing_address"])
    assert scored[3] == scored[4] == (75, ["name_conflict", "shared_identifier"]) and scored[5] == scored[6] == (100, []) and scored[7] == (80, ["missing_phone"])
    events = {(r["terminal_key"], r["event_type"], r["value"], r["source"], r["n"], r["occurred_at"]) for r in enrichment.events(df).collect()}
    assert ("10000007", "account_change", "1111111111 → 2222222222", "c.xlsx :: Change sheet", 0, "2024-03-12") in events
    assert ("10000001", "first_seen", "2024-01-05", "a.xlsx", 0, "2024-01-05") in events and ("10000003", "last_seen", "unknown", "b.xlsx", 0, None) in events
    assert {e for e in events if e[0] == "10000005"} == {("10000005", "first_seen", "2024-02-05", "a.xlsx", 0, "2024-02-05"), ("10000005", "last_seen", "2024-03-01", "b.xlsx", 0, "2024-03-01"), ("10000005", "name_variant", "ONE NAME", "a.xlsx", 1, None), ("10000005", "name_variant", "OTHER NAME", "b.xlsx", 1, None)}
    assert [r["event_type"] for r in enrichment.timeline_of(enrichment.events(df), "10000007").collect()] == ["account_change", "first_seen", "last_seen", "name_variant"]
    assert {tuple(r) for r in enrichment.keys_for(df, "one na").collect()} == {("tid", "10000005"), ("mxcode", "MX10005"), ("merchant_id", "M5"), ("account_number", "1000000005")}
    pairs = df.where("id = 7").select(*enrichment.change_pairs("raw_data")).first()
    assert (pairs["old_bank_acc_no"], pairs["new_bank_acc_no"], pairs["old_bank_code"], pairs["new_email"]) == ("1111111111", "2222222222", "057", "")


FAMILY = [
    (1, "LAGOON WATERS LTD", "10000001", "MX10001", "", "1000000001", "08031000001"), (2, "Switch 15", "10000001", "MX10001", "", "1000000001", "08031000001"),  # one signature, other names
    (3, "JUST CHIPS", "10000003", "MX10003", "", "1000000003", "08031000003"), (4, "OLA ODU", "10000004", "MX10003", "", "1000000004", "08031000003"),  # an owner's code and phone
    (5, "JUST CHIPS TWO", "10000003", "MX10005", "", "1000000005", "08031000005"), (6, "CHIPS JUST", "10000006", "MX10005", "", "1000000006", ""),
]


def family_table(spark):
    return spark.createDataFrame(FAMILY, "id bigint, merchant_name string, tid string, mxcode string, merchant_id string, account_number string, phone string")


def test_values_that_prove_one_merchant(spark):
    df = family_table(spark)
    found = {(r["field"], r["value"]) for r in families.specific_values(df).collect()}
    assert ("tid", "10000001") in found and ("phone", "08031000001") in found  # by signature
    assert ("tid", "10000003") in found and ("mxcode", "MX10005") in found  # by a common word
    assert ("mxcode", "MX10003") not in found and ("phone", "08031000003") not in found
    assert ("tid", "10000001") not in {tuple(r) for r in families.specific_values(df, signatures=False).collect()}


def test_families_and_graphs(spark):
    df = family_table(spark)
    assert [r["id"] for r in families.seeds(df, "just chips").orderBy("id").collect()] == [3, 5]
    one = spark.createDataFrame([(3,)], "id bigint")
    assert sorted(r["id"] for r in families.family(df, one).collect()) == [3, 5]
    assert sorted(map(tuple, families.graph(df, one, depth=2).collect())) == [(3, 0), (5, 1), (6, 2)]
    held = {(r["field"], r["value"]): (r["n"], r["names"]) for r in families.profile(df, df.where("id in (1, 2)")).collect()}
    assert held["tid", "10000001"] == (2, 2)
    sides = {(r["field"], r["value"]): (r["in_left"], r["in_right"]) for r in families.shared_between(df, df.where("id = 3"), df.where("id = 4")).collect()}
    assert sides["mxcode", "MX10003"] == (True, True) and sides["tid", "10000003"] == (True, False)
    a, b = (F.struct(*[F.lit(x).alias(c) for x, c in zip(r[1:], df.columns[1:] , strict=True)], F.lit("").alias("payable_code")) for r in (FAMILY[2], FAMILY[3]))
    assert df.limit(1).select(families.same_family(a, b).alias("x")).first()["x"]  # an identifier in common


def test_name_status(spark):
    rows = spark.createDataFrame([("red sun", "SUN RED"), ("", "X"), ("a", ""), ("blue moon", "GREEN TREE CO")], "a string, b string")
    assert [r[0] for r in rows.select(reports.name_status(F.col("a"), F.col("b"))).collect()] == ["found", "no_name", "name_mismatch", "name_mismatch"]


def test_rephrasings(spark):
    rows = [
        (1, "2024-01-01 10:00:00", "find red sun", 0, ["a"]), (2, "2024-01-01 10:01:00", "Find red sun ", 0, ["a"]), (3, "2024-01-01 10:02:00", "red sun ltd", 1, ["a", "b"]), (4, "2024-01-01 10:03:00", "other", 0, ["c"]),
        (5, "2024-01-01 10:30:00", "again", 1, ["c"]), (6, "2024-01-01 10:19:59", "late", 0, ["d"]), (7, "2024-01-01 10:20:01", "late", 0, ["d"]), (8, "2024-01-01 10:20:02", "later", 1, ["d"]), (9, "2024-01-01 11:00:00", "x", 0, []), (10, "2024-01-01 11:00:00", None, 0, None),
    ]
    log = spark.createDataFrame(rows, "id int, ts string, text string, rows int, entities array<string>").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(map(tuple, learning.rephrased(log).collect())) == [(1, 3), (2, 3), (6, 8), (7, 8)]
    counts = {r["outcome"]: r["n"] for r in learning.outcomes(log, F.to_timestamp(F.lit("2024-01-01 11:10:00"))).collect()}
    assert counts == {"rephrased": 4, "accepted": 3, "abandoned": 1, "pending": 2}


@pytest.mark.parametrize(("bands", "want"), [
    ([(80, 10, 0.9), (60, 10, 0.9), (40, 10, 0.5), (20, 10, 1.0)], 60), ([(80, 10, 0.9), (40, 10, 0.9)], 40), ([(80, 10, 0.5)], 60), ([(80, 20, 0.5)], 90), ([(80, 18, 0.9), (60, 2, 0.1)], 60), ([(0, 30, 1.0)], 20), ([], 60),
])
def test_thresholds(spark, bands, want):
    rows = learning.threshold(spark.createDataFrame(bands, "band int, n bigint, rate double")).collect()
    assert [r["threshold"] for r in rows] == [want]


def test_phrases_without_their_parts(spark):
    mined = spark.createDataFrame([("red sun", "x", 5), ("red", "x", 5), ("sun", "x", 9), ("red", "y", 5), ("the red sun", "x", 4)], "gram string, label string, n bigint")
    assert sorted(map(tuple, learning.without_parts(mined).select("gram", "label", "n").collect())) == [("red", "y", 5), ("red sun", "x", 5), ("sun", "x", 9), ("the red sun", "x", 4)]


def test_request_parsing(spark):
    rows = spark.createDataFrame([(1, "(MX141692), mxcode-MX77826; '10000001': NO-LIMIT"), (2, None)], "i int, text string")
    assert rows.select(requests.identifier_tokens("text").alias("t")).first()["t"] == ["MX141692", "MX77826", "10000001", "NO-LIMIT"]
    held = spark.createDataFrame([("10000001", ["payable", "tid"])], "value string, kinds array<string>")
    assert sorted((r["token"], r["kind"]) for r in requests.parse(rows, held).collect()) == [("10000001", "payable"), ("10000001", "tid"), ("MX141692", "mxcode"), ("MX77826", "mxcode")]
    lines = spark.createDataFrame([(1, "10000001  RED SUN\nget 10000002 now\nRED SUN 10000003\n10000004")], "i int, text string")
    assert [(r["id"], r["name"]) for r in requests.named_lines(lines).collect()] == [("10000001", "RED SUN")]


def test_variants_and_queries(spark):
    assert column(spark, requests.variants("v"), ["a0", "O1", "xyq", None]) == [["A0", "AO"], ["01", "0I", "O1", "OI"], ["XYQ"], [""]]
    assert len(column(spark, requests.variants("v"), ["0" * 12])[0]) == 24
    assert column(spark, requests.fulltext_query("v"), ["red & sun", ""]) == ['"RED" AND "AND" AND "SUN"', ""]
    assert column(spark, requests.without_noise("v", ("get me",), ("get", "me", "all", "on")), ["get me all on medplus", "get me", "all seasons hotel", "get me all"]) == ["medplus", "get me", "all seasons hotel", "get me all"]


def test_assets_in_force(spark):
    rows = [("a", 1, "propose", 1), ("a", 1, "apply", 2), ("a", 1, "approve", 3), ("a", 1, "reject", 4), ("a", 2, "propose", 5), ("a", 2, "approve", 6), ("a", 2, "apply", 7), ("b", 1, "propose", 1), ("b", 1, "reject", 2), ("b", 1, "approve", 3), ("c", 1, "approve", 1)]
    states = governance.asset_states(spark.createDataFrame(rows, "asset string, version int, action string, ts int"))
    assert sorted(map(tuple, states.collect())) == [("a", 1, "approved", 3), ("a", 2, "applied", 7), ("b", 1, "rejected", 2)]
    assert [tuple(r) for r in governance.in_force(states).collect()] == [("a", 2)]


def test_freshness(spark):
    schema = "path string, mtime bigint, size bigint"
    now, then = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("c", 3, 3)], schema), spark.createDataFrame([("a", 1, 1), ("b", 1, 2), ("d", 4, 4)], schema)
    assert sorted(map(tuple, governance.freshness(now, then).collect())) == [("b", "changed"), ("c", "new"), ("d", "removed")]


def test_changes_over_stretches(spark):
    rows = [
        (1, "a", "2024-01-01 10:00:00", "x"), (2, "a", "2024-01-01 10:00:00", "x"), (3, "a", "2024-01-01 23:00:00", "y"), (4, "a", "2024-01-03 00:00:00", "y"), (5, "a", "2024-01-03 00:00:01", None), (6, "a", "2024-01-09 00:00:00", "z"),
        (7, "a", None, "w"), (8, "b", "2024-01-01 10:00:00", "q"), (9, None, "2024-01-01 10:00:00", "q"), (10, None, "2024-01-02 10:00:00", "r"), (11, "a", None, "w"), (12, "a", None, "v"),
    ]
    df = spark.createDataFrame(rows, "id int, k string, ts string, kind string").withColumn("ts", F.to_timestamp("ts"))
    got = sorted((r["id"], r["old"], r["new"]) for r in entities.changes(df, "k", "ts", "kind", "id").collect())
    assert got == [(3, "x", "y"), (7, "z", "w"), (10, "q", "r"), (12, "w", "v")]
