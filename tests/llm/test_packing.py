from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from rollbook.llm import packing, tokens
from rollbook.llm.tokens import default_vocabulary
from tests.llm import fixtures as fx

PATH = default_vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    out = Tokenizer.from_file(PATH)
    out.encode_special_tokens = True
    return out


def test_ids_equal_the_librarys(tokenizer):
    import pyarrow as pa

    r = random.Random(3)
    texts = ["".join(r.choice(" \n\t\r'sèß漢   a1!?.  xß\x1c") for _ in range(r.randint(0, 30))) for _ in range(2000)]
    texts += [t for _, t in fx.texts()] + ["<|endoftext|> as text", "I'm he's\n\n ok "]
    ids, first = tokens.encode(pa.array(texts, pa.string()), PATH)
    for d, text in enumerate(texts):
        assert ids[first[d] : first[d + 1]].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_pieces_round_trip(spark, tokenizer):
    got = packing.pack(fx.documents(spark), capacity=64, keep_ids=True).collect()
    texts, places = defaultdict(list), defaultdict(list)
    for r in got:
        assert r["length"] == len(r["ids"]) <= 64
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        assert r["piece"] == 0 or r["length"] == 64
        texts[r["doc_id"]].append((r["piece"], r["start"], r["ids"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    want = [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID]) for i, t in fx.texts()]
    for i, ids in want:
        if sum(x == i for x, _ in want) == 1:
            assert [x for *_, p in sorted(texts[i]) for x in p] == ids
            assert [s for _, s, _ in sorted(texts[i])] == np.cumsum([0] + [len(p) for *_, p in sorted(texts[i])])[:-1].tolist()
    total = sum(len(ids) for _, ids in want)
    assert sum(r["length"] for r in got) == total
    assert len(places) <= -(-total // 64) + 1


def test_plan_uses_the_stock_and_fills_bins():
    r = random.Random(0)
    histogram = {n: r.randint(1, 400) for n in r.sample(range(1, 1025), 300)}
    bins = packing.plan(histogram)
    used = defaultdict(int)
    for times, lengths in bins:
        assert sum(lengths) <= packing.CAPACITY
        for length in lengths:
            used[length] += times
    assert used == histogram
    total = sum(k * v for k, v in histogram.items())
    n = sum(t for t, _ in bins)
    big = sum(v for k, v in histogram.items() if 2 * k > packing.CAPACITY)
    assert n <= 1.03 * max(-(-total // packing.CAPACITY), big)


def test_fullest_is_the_best_subset():
    r = random.Random(1)
    for _ in range(200):
        stock, room = np.zeros(41, np.int64), r.randint(0, 40)
        for _ in range(r.randint(0, 5)):
            stock[r.randint(1, 40)] += 1
        sums = {0}
        for n in np.repeat(np.arange(41), stock).tolist():
            sums |= {s + n for s in sums}
        chosen = packing.fullest(stock, room)
        assert sum(k * v for k, v in chosen.items()) == max(s for s in sums if s <= room)
        assert all(v <= stock[k] for k, v in chosen.items())


def test_empty_table(spark):
    assert packing.pack(fx.documents(spark, [])).collect() == []
