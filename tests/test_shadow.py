"""Reviews of a second tier, gates, ledgers, families of names and requests that are asked back, on hand-worked cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rollbook.operators import governance, planning, requests, shadow

DECISIONS = "entry_id int, ts string, intent string, confidence int, margin double, would_act boolean"
REVIEWS = "entry_id int, ts string, correct boolean, actual string"


def scan(rows, edges, start, top):
    """The bands from the top, one by one."""
    gate = start
    for low, high in reversed(list(zip(edges, edges[1:], strict=False))):
        band = [ok for v, ok in rows if low <= (v or 0) < high]
        if len(band) < 3:
            continue
        if sum(band) / len(band) < 0.8:
            return min(high, top)
        gate = min(gate, low)
    return gate


def plain_gate(acted, passed):
    if len(acted) < 20:
        return None
    gate = scan(acted, shadow.CONFIDENCE, 65, 90)
    floors = [lo for lo, hi in zip(shadow.CONFIDENCE, shadow.CONFIDENCE[1:], strict=False) if lo < gate and sum(lo <= (v or 0) < hi for v in passed) >= 3]
    return max(40, min([gate, 90, *floors[-1:]]))


@pytest.mark.parametrize("seed", range(3))
def test_gates(spark, seed):
    rng = random.Random(seed)
    rows, reviews = [], []
    for i in range(400):
        intent, act, value = rng.choice(["a", "a", "b", "c", None]), rng.random() < 0.6, rng.choice([None, *range(101)])
        rows.append((i, f"2024-01-{1 + i % 28:02d}", intent if i % 50 else "rare", value, float(rng.randrange(0, 110)), act))
        if rng.random() < 0.8:
            reviews += [(i, "1", False, "x"), (i, "2", rng.random() < (0.95 if (value or 0) > 30 + 10 * seed else 0.5), None)]
    entries = shadow.labelled(spark.createDataFrame(rows, DECISIONS), spark.createDataFrame(reviews, REVIEWS))
    held = {i: ok for i, t, ok, _ in reviews if t == "2"}
    want = {}
    for intent in {r[2] or "?" for r in rows if r[0] in held}:
        mine = [(r, held[r[0]]) for r in rows if (r[2] or "?") == intent and r[0] in held]
        acted = [(r[3], ok) for r, ok in mine if r[5]]
        passed = [r[3] for r, ok in mine if not r[5] and ok]
        want[intent] = (len(acted), len(passed), plain_gate(acted, passed))
    assert {r["intent"]: (r["samples"], r["would_not_correct"], r["gate"]) for r in shadow.gates(entries).collect()} == want
    margins = [(r[4], held[r[0]]) for r in rows if r[5] and r[0] in held]
    assert shadow.lead(entries).first()["threshold"] == max(0, min(40, scan(margins, shadow.MARGIN, 15, 40)))
    assert shadow.lead(entries.limit(3)).first()["threshold"] == 15


def test_reviews(spark):
    rows = [(i, f"2024-01-01 00:00:{i:02d}", "a" if i < 9 else None, 70, 1.0, i % 5 > 0) for i in range(12)] + [(99, None, "b", None, None, None)]
    reviews = [(i, "1", False, f"m{i}") for i in range(11)] + [(1, "2", True, None), (2, "0", True, None), (500, "1", True, "")]
    entries = shadow.labelled(spark.createDataFrame(rows, DECISIONS), spark.createDataFrame(reviews, REVIEWS)).withColumn("ts", F.to_timestamp("ts"))
    assert sorted(map(tuple, shadow.precision(entries).collect())) == [("?", 1, 0, 0.0, ["m9"]), ("a", 7, 1, 0.143, ["m3", "m4", "m6", "m7", "m8"])]
    assert [r["entry_id"] for r in shadow.review(entries, "would_not", 3).collect()] == [10, 5, 0]
    assert [r["entry_id"] for r in shadow.review(entries, limit=2).collect()] == [11, 10] and shadow.review(entries, "would_act").count() == 9
    h = shadow.health(entries, F.lit("2024-01-01").cast("date")).first()
    assert (h["total"], h["today"], h["would_act"], h["would_not"], h["reviewed"]) == (13, 12, 9, 4, 11)
    assert shadow.health(entries.limit(0), F.current_date()).first()["total"] == 0


def test_ledger(spark):
    df = spark.createDataFrame([("ok", 1, 5), ("failed", 3, None), ("running", None, 9)], "status string, finished_at int, row_count int")
    assert tuple(governance.ledger_stats(df).first()) == (3, 1, 1, 3, 9) and tuple(governance.ledger_stats(df.limit(0)).first()) == (0, 0, 0, None, 0)


def test_family_roots(spark):
    roots = ["MEDPLUS", "SPAR", "JUST CHIPS", "BOKKU MART", "CASCADES", "CASCADES LUXE", "ADDIDE", "", None]
    names = ["medplus", "Medplus Pharmacy", "MEDPLUZ abuja", "SPARE PARTS", "SPAR", "Bokku Mart- Ilaje", "BOKKU MARTEL", "Cascades Luxe hotel", "CASCADE", "ADIDE x", "JUST CHIP", "MEDPL", None, "", "MEDPLUSS", "SPAR/A"]
    found = requests.family_roots(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(r,) for r in roots], "root string"))
    assert sorted(map(tuple, found.collect())) == sorted([
        ("MEDPLUS", "MEDPLUS"), ("MEDPLUS PHARMACY", "MEDPLUS"), ("MEDPLUZ ABUJA", "MEDPLUS"), ("SPAR", "SPAR"), ("BOKKU MART- ILAJE", "BOKKU MART"), ("CASCADES LUXE HOTEL", "CASCADES LUXE"), ("CASCADE", "CASCADES"), ("ADIDE X", "ADDIDE"),
        ("MEDPLUSS", "MEDPLUS"), ("SPAR/A", "SPAR"),
    ])


def test_requests_asked_back(spark):
    rows = [
        (1, [("change_details", 4.0, ["p"]), ("profile", 3.0, ["q"])], "account details"), (2, [("email", 4.0, ["p"]), ("phone", 3.0, ["q"])], "email and phone"), (3, [("email", 4.0, ["p"]), ("phone", 3.0, ["q"])], "email or phone details"),
        (4, [("profile", 3.0, ["p"])], "bank info"), (5, [("profile", 3.0, ["p"])], "info"), (6, [("change_details", 9.0, ["p"]), ("profile", 8.0, ["q"])], "change"), (7, [("resolve", 0.0, [])], "account"), (8, [("profile", 4.9, ["p"]), ("bank", 0.5, ["q"])], "x details"),
    ]
    df = spark.createDataFrame(rows, "id int, intents array<struct<intent:string,score:double,matched:array<string>>>, text string")
    got = {r["id"]: r["o"] for r in df.select("id", planning.options(F.col("text")).alias("o")).collect()}
    assert got == {1: ["change_details", "profile", "static_account"], 2: [], 3: ["email", "phone"], 4: ["profile", "static_account", "change_details"], 5: [], 6: [], 7: [], 8: []}
