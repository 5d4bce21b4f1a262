"""Suggestions, aliases, encoders and journals, on cases worked out by hand or by plain versions."""

from __future__ import annotations

import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from rollbook.functions import similarity
from rollbook.functions.text import GENERIC_WORDS
from rollbook.operators import encoder, suggestions
from rollbook.sources import journals


def test_variants_and_suggestions(spark):
    q = spark.createDataFrame([("red sun ltd",), (" red sun ltd ",), ("Hotell",), ("sun",), ("",), (None,)], "query string")
    got = {}
    for r in suggestions.variants(q).orderBy("query", "place").collect():
        got.setdefault(r["query"], []).append(r["variant"])
    assert got == {"red sun ltd": ["sun ltd", "red ltd", "red sun"], "Hotell": ["hotel"]}

    def search(queries):
        score = F.when(F.lower("query").isin("sun ltd", "hotel", "sun"), 60).when(F.lower("query") == "red sun", 50).otherwise(20)
        return queries.select("query", F.lit(1).alias("place"), F.length("query").alias("id"), score.alias("score"))

    assert sorted(map(tuple, suggestions.did_you_mean(q, search).collect())) == [("Hotell", 1, "hotel", 5, 60), ("red sun ltd", 1, "sun ltd", 7, 60), ("red sun ltd", 2, "red sun", 7, 50)]
    assert [r["variant"] for r in suggestions.did_you_mean(q, search, most=1).where("query = 'red sun ltd'").collect()] == ["sun ltd"]


def test_compounds(spark):
    vocabulary = spark.createDataFrame([("MONEY", 7), ("TRUST", 4), ("OIL", 900), ("POWERF", 1), ("NEYTRUST", 1), ("trust", 1)], "word string, n int")
    words = spark.createDataFrame([("moneytrust",), ("Powerfoil",), ("SHORT",), ("unknownword",), (None,)], "word string")
    assert sorted(map(tuple, suggestions.compounds(words, vocabulary, ("POWER",), ("FOIL",)).collect())) == [("MONEYTRUST", "MONEY", "TRUST"), ("POWERFOIL", "POWERF", "OIL")]
    fewer = vocabulary.where("word <> 'OIL'")
    assert sorted(map(tuple, suggestions.compounds(words, fewer, ("POWER",), ("FOIL",)).collect())) == [("MONEYTRUST", "MONEY", "TRUST"), ("POWERFOIL", "POWER", "FOIL")]


def test_beginnings_with_a_typo(spark):
    keys = ["MEDPLUS", "MEDPLUS PHARMACY", "KONGAPAY", "MEDICAL", "LAGOON WATERS", "", None, "EDPLUS", "MEDPLUS"]
    typed = ["medpluz", "MEDLPUS", "kongopay", "lagoon watr", "zzz", "me", None]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    t = spark.createDataFrame([(x,) for x in typed], "typed string")
    want = []
    for x in {(x or "").strip().upper() for x in typed}:
        near = []
        for k in {k for k in keys if k}:
            n = min(len(x), len(k))
            if len(x) >= 3 and k[0] == x[0] and similarity.damerau_similarity(x[:n], k[:n]) >= 0.72:
                near.append((-similarity.damerau_similarity(x[:n], k[:n]), len(k), k))
        want += [(x, i + 1, k) for i, (_, _, k) in enumerate(sorted(near))]
    assert sorted(map(tuple, suggestions.prefix_matches(df, "k", t).collect())) == sorted(want)
    assert ("MEDPLUZ", 1, "MEDPLUS") in want and ("LAGOON WATR", 1, "LAGOON WATERS") in want


def plain_aliases(name):
    """The rule in steps: whole words, then words as parts."""
    name = (name or "").strip()
    if not name:
        return set()
    up = name.upper()
    words = up.split()
    core = [w for w in words if w not in GENERIC_WORDS]
    out = {name, up}
    if len(core) < len(words):
        out |= {" ".join(core)} | {w for w in core if len(w) >= 3}
    for g in GENERIC_WORDS:
        s = re.sub(r"\s*" + re.escape(g) + r"\s*", " ", up).strip()
        if g in up and s and s != up:
            out |= {s, " ".join(w for w in s.split() if w not in GENERIC_WORDS and len(w) >= 3)}
    return out - {""}


def test_aliases(spark):
    names = ["Red Sun Nigeria Ltd", "LTD", "Lagoon", "the  blue of it", "Bo Co", None, "", "Andes"]
    df = spark.createDataFrame(list(enumerate(names)), "id int, merchant_name string")
    got = {r["id"]: set(r["a"]) for r in df.select("id", suggestions.generated_aliases("merchant_name").alias("a")).collect()}
    assert got == {i: plain_aliases(n) for i, n in enumerate(names)}
    pairs = set(map(tuple, suggestions.all_aliases(df).collect()))
    assert ("RED SUN", "Red Sun Nigeria Ltd") in pairs and not [p for p in pairs if p[0] == p[1]]


def test_by_word_and_lines(spark):
    rows = [("q", "red", "A", 80.0), ("q", "red", "A", 90.0), ("q", "sun", "A", 70.0), ("q", "sun", "B", 99.0), ("q", "red", "C", 99.0), ("r", "x", "B", 50.0)]
    found = spark.createDataFrame(rows, "query string, word string, name string, score double")
    assert [tuple(r) for r in suggestions.by_word(found).orderBy("query", "place").collect()] == [("q", 1, "A", 80.0, ["red", "sun"]), ("q", 2, "B", 99.0, ["sun"]), ("q", 3, "C", 99.0, ["red"]), ("r", 1, "B", 50.0, ["x"])]
    assert len(suggestions.by_word(found, 1).collect()) == 2
    line = spark.createDataFrame([(1, " a ", "", None)], "id int, x string, y string, z string").select(suggestions.described(["id", "x", "y", "z"]))
    assert line.first()[0] == "id: 1 | x: a"


def plain_vector(text):
    out = {}
    for w in re.findall("[a-z0-9]+", re.sub(r"\[[a-z_]+\]", " ", (text or "").lower())):
        if len(w) < 2 or w in encoder.STOP:
            continue
        for f in [f"w:{w}"] + [f"c{n}:{w[i : i + n]}" for n in (2, 3, 4) if len(w) >= 3 for i in range(len(w) - n + 1)]:
            h = int.from_bytes(hashlib.md5(f.encode()).digest()[:8], "big")
            out[h % 1024] = out.get(h % 1024, 0) + (1 if h >> 8 & 1 else -1)
    n = math.sqrt(sum(v * v for v in out.values()))
    return {k: v / n for k, v in out.items() if v}


def test_vectors(spark):
    texts = ["email addresses for [MERCHANT] and MX", "phone", "ab", "the a", "", None, "phone phone number 12"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    vectors = encoder.encode(df, "id", "text")
    got = {}
    for r in vectors.collect():
        got.setdefault(r["id"], {})[r["dim"]] = r["weight"]
    assert got == {i: pytest.approx(plain_vector(t)) for i, t in enumerate(texts) if plain_vector(t)}
    exemplars = spark.createDataFrame([(10, "email", "email address"), (11, "phone", "phone number"), (12, "phone", "telephone")], "id int, intent string, text string")
    held = encoder.encode(exemplars, "id", "text").join(exemplars.select("id", "intent"), "id")
    dot = lambda a, b: sum(v * plain_vector(b).get(k, 0) for k, v in plain_vector(a).items())
    for r in encoder.nearest(vectors, held).collect():
        t = texts[r["id"]]
        each = {}
        for _, intent, phrase in [tuple(x) for x in exemplars.collect()]:
            if set(plain_vector(t)) & set(plain_vector(phrase)):
                each[intent] = max(each.get(intent, -2), round(dot(t, phrase), 6))
        ranked = sorted(((-s, i) for i, s in each.items()))
        assert (r["intent"], r["similarity"]) == (ranked[0][1], pytest.approx(-ranked[0][0], abs=2e-6))
        assert r["margin"] == pytest.approx(-ranked[0][0] + (ranked[1][0] if len(ranked) > 1 else 0), abs=3e-6)


def test_masks(spark):
    rows = [("email of Red Sun, red sun.", ["RED SUN"]), ("tid 2103O338 and MX12345 now", None), ("a+b (c)", ["(c)", "", None]), (None, ["x"])]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, r struct<text:string,names:array<string>>").orderBy("id")
    assert [r[0] for r in df.select(encoder.masked(F.col("r.text"), F.col("r.names"))).collect()] == ["email of [MERCHANT] , [MERCHANT] .", "tid [ID] and [ID] now", "a+b (c)", ""]


def test_journals(spark, tmp_path):
    folder, schema = str(tmp_path / "log"), "id bigint, ts string, text string"
    journals.append(spark.createDataFrame([(1, "2024-01-01", "a"), (2, None, "é\n")], schema), folder)
    journals.append(spark.createDataFrame([(3, "2024-01-02", None)], schema), folder)
    (tmp_path / "log" / "damaged.json").write_text('{"id": 4, "ts": \n{"id": "x"}\n')
    assert sorted(tuple(r) for r in journals.read(spark, folder, schema).collect()) == [(1, "2024-01-01", "a"), (2, None, "é\n"), (3, "2024-01-02", None)]
    assert [r["id"] for r in journals.newest(journals.read(spark, folder, schema), 2).collect()] == [3, 1]
    run = journals.follow(spark, folder, schema).writeStream.format("memory").queryName("journal").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    run.awaitTermination(60)
    assert spark.table("journal").count() == 3
