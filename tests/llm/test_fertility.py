from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from rollbook.llm import fertility
from rollbook.llm.quantiles import quantiles
from rollbook.llm.tokens import default_vocabulary
from rollbook.llm.words import Words
from tests.llm import fixtures as fx

BYTE, PIECE = default_vocabulary("byte_bpe_50k.json"), default_vocabulary("piece_bpe_32k.model")


def plain_base(text):
    w = fx.words(text)
    runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    repeated = {i + k for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if fx.words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


def test_base_counts(spark):
    rows = [*fx.texts(), (40, "a # b\na # b\n<tag> & 100% $ |\n\n\na # b")]
    got = fertility.rules(fx.documents(spark, rows), fertility.Bands()).select("doc_id", *fertility.ADDED[:5], "base_failed", "kept", "rejected_by")
    want = []
    for i, t in rows:
        x = plain_base(t)
        failed = x[0] < 20 or 100 * x[4] > 30 * x[0]
        want.append((i, *x, failed, not failed, "base" if failed else None))
    assert fx.rows(got) == sorted(want, key=repr)


def test_fertility_measures():
    import sentencepiece

    tokenizer, pieces = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    texts = [t for _, t in fx.texts()] + ["🜚 rare 𐍈"]
    got = fertility.fertility(Words(pa.array(texts, pa.string())), BYTE, PIECE)
    for d, text in enumerate(texts):
        w = fx.words(text)
        ids = [i for x in w for i in tokenizer.encode(" " + x, add_special_tokens=False).ids]
        parts = [i for x in w for i in pieces.encode(x)]
        chars = sum(map(len, w))
        assert got["n_tokens"][d] == len(ids)
        assert got["chars_per_token"][d] == pytest.approx(chars / max(1, len(ids)))
        assert got["chars_per_piece"][d] == pytest.approx(chars / max(1, len(parts)))
        assert got["byte_share"][d] == pytest.approx(sum(pieces.is_byte(i) for i in parts) / max(1, len(parts)))
        assert got["entropy"][d] == pytest.approx(-sum(n / len(ids) * math.log2(n / len(ids)) for n in Counter(ids).values()) if ids else 0, abs=1e-9)


def test_bands_reject_noise_and_keep_prose(spark):
    good = [(i, fx.prose(i, 150)) for i in range(100, 240)]
    docs = fx.documents(spark, good + [(1, "@@## !!%% " * 60), (3, " ".join("ab"[i % 2] * 2 + str(i % 3) for i in range(150)))])
    bands = fertility.fit(docs, spark.createDataFrame([(i, 1) for i, _ in good] + [(None, 1), (100, 1)], "doc_id bigint, quality int"), most=1000)
    kept = {r["doc_id"] for r in fertility.keep(docs, bands).collect()}
    assert len(kept & {i for i, _ in good}) == len(good)
    assert 1 not in kept
    assert fertility.keep(docs, bands).columns == docs.columns


def test_script_where_the_language_is_unknown():
    assert fertility.script("привет мир".encode()) == "cyrillic"
    assert fertility.script("hello".encode()) == "latin"
    assert fertility.script("漢字".encode()) == "east"


def test_entropy_is_tested_where_a_doubling_has_no_band():
    x = {"chars_per_token": 4.0, "chars_per_piece": 4.0, "byte_share": 0.0}
    good = [("en", "latin", x | {"entropy": 6 + i / 100, "n_tokens": 300}) for i in range(60)] + [("de", "latin", x | {"entropy": 5 + i / 100, "n_tokens": 20}) for i in range(20)]
    bands = fertility.Bands.fit(good + [("en", "latin", x | {"entropy": 8.0, "n_tokens": 5000})] * 5)
    for language, n, entropy, verdict in (("en", 300, 3.0, "entropy"), ("en", 5000, 3.0, "entropy"), ("en", 5000, 8.0, None), ("en", 300, 6.2, None), ("de", 9000, 3.0, "entropy"), (None, 9000, 3.0, "entropy"), ("en", 40, 1.0, None), ("ru", 9000, 3.0, "entropy")):
        assert bands.verdict(language, "latin", x | {"entropy": entropy, "n_tokens": n}) == verdict
    assert bands.verdict("ru", "cyrillic", x | {"entropy": 3.0, "n_tokens": 9000}) is None


def test_bands_come_from_every_labelled_text(spark):
    """Against a fit of all measures in memory: repeated ids, groups of all sizes, more texts than any cap before."""
    r = random.Random(5)
    rows, texts = [], [fx.prose(i, 21 + i % 90) for i in range(120)]
    for i in range(6500):
        rows.append((i // 2 if i % 10 == 0 else i, r.choice(texts) + " " + r.choice(texts), r.choice(["en", "en", "de", None]) if i % 50 else "rare"))
    rows += [(None, texts[0], "en"), (3, None, "en"), (4, "short", "en"), (9000, texts[1], "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(5)
    good = spark.createDataFrame([(i,) for i in range(6500)] + [(None,), (7,), (7,)], "doc_id bigint")
    bands = fertility.fit(docs, good)
    taught = [x["measured"] for x in fertility.measure(docs).where("doc_id < 6500").collect() if not x["measured"]["base_failed"]]
    assert len(taught) > 6400
    want = fertility.Bands.fit([(x["language"], x["script"], x.asDict()) for x in taught])
    assert bands == want and {"lang:en", "lang:rare", "script:latin"} <= {g for g, _ in bands.ranges}
    assert fertility.fit(docs, good, most=6000) != bands


def test_measured_tables_are_judged_as_texts_are(spark):
    docs = fx.documents(spark).withColumnRenamed("source", "measured")
    bands = fertility.Bands({("lang:en", m): (0.5, 4.0) for m in fertility.MEASURES}, {("script:latin", 0): 3.0})
    measured = fertility.measure(docs)
    assert fx.rows(fertility.judged(measured, bands)) == fx.rows(fertility.rules(docs, bands))
    assert fx.rows(fertility.kept(measured, bands)) == fx.rows(fertility.keep(docs, bands))
    assert fertility.kept(measured, bands).columns == docs.columns


def test_quantiles_by_digits(spark):
    r = random.Random(3)
    groups = {"one": [2.5], "two": [0.0, 1e-300], "same": [0.25] * 500, "close": [1 + i * 2.0**-52 for i in range(300)], "wide": [r.random() * 10.0 ** r.randint(-9, 9) for _ in range(999)], "zeros": [-0.0] * 60 + [3.0] * 40}
    rows = [(g, i % 2, int(fertility.bits(np.array([x]))[0])) for g, v in groups.items() for i, x in enumerate(v)]
    got = quantiles(spark.createDataFrame(rows, "g string, part int, bits bigint").repartition(7), lambda key: [0.005, 0.5, 0.995, 1.0] if key[0] != "two" else [0.3], least=1)
    want = {}
    for g, v in groups.items():
        for part in (0, 1):
            if mine := v[part::2]:
                want[g, part] = np.quantile(mine, [0.3] if g == "two" else [0.005, 0.5, 0.995, 1.0]).tolist()
    assert got == want
    assert {k[0] for k in quantiles(spark.createDataFrame(rows, "g string, part int, bits bigint"), lambda _: [0.5], least=250)} == {"same", "wide"}


def test_empty_tables(spark):
    docs = fx.documents(spark, [])
    bands = fertility.fit(docs, spark.createDataFrame([], "doc_id bigint"))
    assert fertility.rules(docs, bands).collect() == [] == fertility.keep(docs, bands).collect()
