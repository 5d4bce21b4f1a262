from __future__ import annotations

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from rollbook.llm import tiling
from tests.llm import fixtures as fx

BENCHMARK = "item_id bigint, text string, doc_id string, coverage string"


def plain_tiles(text, item, least):
    """Greedy string tiling by comparing every pair of places."""
    free_t, free_i, tiles = [True] * len(text), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for i in range(len(text)):
            for j in range(len(item)):
                n = 0
                while i + n < len(text) and j + n < len(item) and text[i + n] == item[j + n] and free_t[i + n] and free_i[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return tiles
        tiles.append((i, j, n))
        free_t[i : i + n], free_i[j : j + n] = [False] * n, [False] * n


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fx.fold(text or ""))


def cases():
    r = random.Random(5)
    items = [(i, " ".join(r.choice("abcdefghij") + str(r.randint(0, 9)) for _ in range(r.choice([3, 5, 20, 30])))) for i in range(8)] + [(8, None), (9, ""), (None, "n1 n2 n3 n4 n5 n6"), (4, "again a1 b2 c3 d4 e5 f6")]
    docs = [(i, t) for i, t in fx.texts() if len(t or "") < 3000]
    for k, (_, t) in enumerate(items):
        w = (t or "").split()
        docs += [(100 + k, "Intro. " + (t or "").upper() + "! End"), (200 + k, " ".join(w[len(w) // 2 :] + ["gap"] + w[: len(w) // 2])), (300 + k, " ".join(w[: len(w) // 3])), (400 + k, " ".join(w[::2] + w))]
    return items, docs


@pytest.mark.parametrize("coverage", [0.5, 0.9])
def test_against_plain_tiling(spark, coverage):
    items, docs = cases()
    table = spark.createDataFrame([(i, t, "x", "y") for i, t in items], BENCHMARK)
    got = {(r["doc_id"], r["item_id"], r["covered_words"], r["item_words"]) for r in tiling.find_leaks(fx.documents(spark, docs), table, 5, coverage).collect()}
    want = set()
    for i, item in items:
        for d, text in docs:
            n = sum(t[2] for t in plain_tiles(split(text), split(item), 5))
            if len(split(item)) >= 5 and n >= coverage * len(split(item)):
                want.add((d, i, n, len(split(item))))
    assert got == want
    assert any(d and 200 <= d < 300 for d, *_ in got)
    left = {r["doc_id"] for r in tiling.drop_leaks(fx.documents(spark, docs), table, 5, coverage).collect()}
    assert left == {d for d, _ in docs} - {d for d, *_ in want}


def test_items_in_several_blocks(spark, monkeypatch):
    items, docs = cases()
    table = spark.createDataFrame([(i, t, "x", "y") for i, t in items], BENCHMARK)
    whole = fx.rows(tiling.find_leaks(fx.documents(spark, docs), table))
    monkeypatch.setattr(tiling, "BLOCK_BYTES", 100)
    assert fx.rows(tiling.find_leaks(fx.documents(spark, docs), table)) == whole


def test_empty_tables(spark):
    none = spark.createDataFrame([], BENCHMARK)
    docs = fx.documents(spark)
    assert tiling.find_leaks(docs, none).collect() == []
    assert tiling.drop_leaks(docs, none).count() == docs.count()
    assert tiling.find_leaks(fx.documents(spark, []), spark.createDataFrame([(1, fx.prose(1, 30), "", "")], BENCHMARK)).collect() == []


def test_tiles_of_few_words():
    """Sequences over two words, where matches overlap in every way."""
    r = random.Random(2)
    for _ in range(300):
        text, item = ([r.choice("ab" if r.random() < 0.9 else "abc") for _ in range(r.randint(0, 30))] for _ in range(2))
        number = lambda words: np.array([ord(w) * 0x9E3779B97F4A7C15 % 2**64 for w in words], np.uint64)
        least = r.choice([1, 2, 3, 5])
        assert tiling.tile(number(text), number(item), least) == plain_tiles(text, item, least)


def test_memory_is_linear_where_all_words_are_equal():
    """A text of a million equal words against an item of 200: listing the pairs of places would take gigabytes."""
    items = tiling.Items(["same " * 200, "same " * 150 + "other words end it"], 5)
    text = pa.array(["same " * 1_000_000])
    tracemalloc.start()
    found = list(items.leaks(text, 0.5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(d, i, sum(t[2] for t in tiles)) for d, i, tiles in found] == [(0, 0, 200), (0, 1, 150)]
    assert peak < 400 << 20
