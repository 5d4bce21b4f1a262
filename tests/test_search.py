"""The record scorer and name search on a small registry, with scores worked out by hand or bounded by rules."""

from __future__ import annotations

import pytest

from rollbook.functions import similarity as sim
from rollbook.operators import search as s

ROWS = [
    (1, "POWERFOIL BAKERY", "", "POWERFOIL BAKERY", "20000001", "MX10001", "a@example.com", "08000000001", "1000000006"), (2, "POWERFOIL BAKERY LTD", "", "", "20000002", "MX10001", "", "", ""),
    (3, "FIELD AND OCEAN", "", "", "20000003", "MX10002", "b@example.com", "", ""), (4, "CRANE FIELD SCHOOL JEDDO", "", "", "2103O265", "MX10003", "", "", ""),
    (5, "4789.0", "GOLDEN SPOON KITCHEN", "", "20000005", "MX10004", "", "", ""), (6, "MORNING STAR PHARMACY", "", "", "20000006", "MX10001", "", "08000000006", ""),
    (7, "", "", "", "20000007", "", "a@example.com", "", ""),
]
SCHEMA = "id bigint, merchant_name string, slip_header string, account_name string, tid string, mxcode string, email string, phone string, account_number string"


@pytest.fixture(scope="module")
def registry(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def results(spark, registry, *queries, **options):
    found = s.search(registry, spark.createDataFrame([(q,) for q in queries], "query string"), **options)
    return [r.asDict() for r in found.orderBy("query", "place").collect()]


def test_field_scores():
    assert s.field_score("RED SUN", ["RED", "SUN"], "RED SUN", ["RED", "SUN"]) == 100
    assert s.field_score("RED SUN", ["RED", "SUN"], "THE RED SUN BAR", ["RED", "SUN", "BAR"]) == 90
    assert s.field_score("THE RED SUN BAR", ["RED", "SUN", "BAR"], "RED SUN", ["RED", "SUN"]) == 80
    # both words, in another order: 70 for exact, 0 near, 15 for a mean likeness of 1
    assert s.field_score("RED SUN", ["RED", "SUN"], "SUN RED", ["SUN", "RED"]) == 85
    # one of two: exact 0.5, none near, mean (1 + ratio(SUN, RED)) / 2 = 0.5
    assert s.field_score("RED SUN", ["RED", "SUN"], "RED OWL", ["RED", "OWL"]) == pytest.approx(35 + 15 * 0.5, abs=0.1)
    # one typo: near 1, mean 10/12, whole ratio 10/12
    assert s.field_score("ABCDEF", ["ABCDEF"], "ABXDEF", ["ABXDEF"]) == pytest.approx(50 + 50 * 10 / 12, abs=0.1)
    assert s.field_score("RED", ["RED"], "...", []) == 0


def test_word_similarities():
    assert sim.word_similarity("STAR", "STAR") == 1 and sim.word_similarity("PHILIP", "FILIP") >= 0.92
    assert sim.word_similarity("BAKE", "BAKERY") == pytest.approx(0.8 + 0.15)
    assert sim.word_similarity("ABCD", "ABDC") == 0.75


@pytest.mark.parametrize(("word", "key"), [("Thompson", "0MPSN"), ("Philip", "FLP"), ("knight", "NT"), ("school", "SKL"), ("church", "XRX"), ("judge", "JJ"), ("science", "SNS"), ("nation", "NXN"), ("Xavier", "SFR"), ("whale", "WL"), ("lamb", "LM"), ("queen", "KN"), ("", "")])
def test_sound_keys(word, key):
    assert sim.sound_key(word) == key


def test_exact_name_is_an_exact_match(spark, registry):
    top = results(spark, registry, "powerfoil bakery")
    assert (top[0]["id"], top[0]["match_type"], top[0]["score"] >= 95) == (1, "Exact Match", True)
    assert top[1]["id"] == 2 and top[1]["score"] >= 85
    assert top[0]["field_scores"]["merchant_name"] == 100 and top[0]["matched"] == ["POWERFOIL", "BAKERY"]


def test_a_shared_word_does_not_make_a_match(spark, registry):
    rows = {r["id"]: r for r in results(spark, registry, "crane field school jeddo")}
    assert rows[4]["score"] >= 90 and rows[3]["score"] < rows[4]["score"] and rows[3]["field_scores"]["merchant_name"] <= 60


def test_typos_find_their_record(spark, registry):
    top = results(spark, registry, "powerfiol bakry", "mornin star farmacy")
    assert [r["id"] for r in top if r["place"] == 1] == [6, 1] and all(r["score"] >= 60 for r in top if r["place"] == 1)


def test_code_names_give_way_to_the_slip(spark, registry):
    top = results(spark, registry, "golden spoon")[0]
    assert top["id"] == 5 and top["score"] >= 80


def test_identifiers_decide(spark, registry):
    rows = results(spark, registry, "20000003", "21030265", "+2348000000006", "B@example.com", "2000000", "12345 junk corp")
    top = {r["query"]: (r["id"], r["hit"], r["score"], r["match_type"]) for r in rows if r["place"] == 1}
    assert top["20000003"] == (3, "tid", 98.0, "Exact Match") and top["21030265"] == (4, "tid", 98.0, "Exact Match")
    assert top["+2348000000006"][:2] == (6, "phone") and top["B@example.com"][:2] == (3, "email")
    assert top["2000000"][1:] == ("tid", 90.0, "High Confidence")
    assert "12345 junk corp" not in top or top["12345 junk corp"][2] < 50


def test_rarity_limit_and_least_score(spark, registry):
    rarity = spark.createDataFrame([("FIELD", 0.1), ("CRANE", 5.0), ("SCHOOL", 5.0), ("JEDDO", 5.0)], "token string, idf double")
    plain, rare = (next(r["score"] for r in results(spark, registry, "crane field school jeddo", rarity=x) if r["id"] == 3) for x in (None, rarity))
    assert rare < plain
    assert len(results(spark, registry, "powerfoil bakery", limit=1)) == 1
    assert all(r["score"] >= 80 for r in results(spark, registry, "powerfoil bakery", min_score=80))


def test_person_and_bank_words_boost(spark, registry):
    base, boosted = (results(spark, registry, "powerfoil bakery", **o)[0]["score"] for o in ({}, {"bank_words": ["BAKERY"], "person_words": ["POWERFOIL"]}))
    assert base == boosted == 100


def test_family_of_the_best_results(spark, registry):
    queries = spark.createDataFrame([("powerfoil bakery",)], "query string")
    rows = s.with_family(registry, s.search(registry, queries, min_score=80)).where("match_type = 'Family Match'").collect()
    assert sorted((r["id"], r["score"], r["matched"][0]) for r in rows) == [(6, 85.0, "family:MX10001"), (7, 85.0, "family:a@example.com")]


def test_reconcile_and_quick_match(spark, registry):
    queries = spark.createDataFrame([("powerfoil bakery",), ("zzqx qqwv",), ("20000005",), (" ",), (None,)], "query string")
    found = s.search(registry, queries)
    rows = {r["query"]: r for r in s.reconcile(registry, queries, found).collect()}
    assert len(rows) == 3 and rows["powerfoil bakery"]["found"] and rows["powerfoil bakery"]["score"] == 10.0 and not rows["zzqx qqwv"]["found"]
    quick = {r["query"]: (r["matched"], r["hit"]) for r in s.quick_match(registry, queries, found).collect()}
    assert quick == {"powerfoil bakery": (False, None), "zzqx qqwv": (False, None), "20000005": (True, "tid")}
    assert {r["metric"]: r["n"] for r in s.reconcile_summary(s.reconcile(registry, queries, found)).collect()} == {"total": 3, "found": 2, "not_found": 1, "emails": 1, "contacts": 1, "rate_per_mille": 666}


def test_recall(spark, registry):
    queries = spark.createDataFrame([("powerfoil bakery", 2), ("golden spoon", 5), ("zzqx", 1)], "query string, id bigint")
    row = s.recall(s.search(registry, queries), queries).first()
    assert (row["recall_1"], row["recall_3"]) == (pytest.approx(1 / 3, abs=1e-6), pytest.approx(2 / 3, abs=1e-6))


def test_aliases(spark):
    queries = spark.createDataFrame([("E-Sorae",), ("the ikoyi branch",), ("nothing",), ("ab",)], "query string")
    aliases = spark.createDataFrame([(1, "ikoyi branch", "B"), (2, "e sorae", "A"), (3, "ikoyi", "C"), (4, "abcd", "D")], "position int, alias string, target string")
    assert sorted(map(tuple, s.alias_targets(queries, aliases).collect())) == [("E-Sorae", "A"), ("the ikoyi branch", "B")]
