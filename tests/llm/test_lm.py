from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rollbook.llm import lm
from rollbook.llm.exchange import Keys, Route, pack, unpack
from tests.llm import fixtures as fx

TRAINED = "crc32(cast(doc_id as string)) % 10 != 0"


def plain(rows):
    grams = [Counter() for _ in range(3)]
    tokens = [[*fx.words(fx.fold(t or "")), None] for _, t in rows]
    held = [i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    for t, h in zip(tokens, held, strict=True):
        for k in range(3):
            if not h:
                grams[k].update(tuple(t[i : i + k + 1]) for i in range(len(t) - k))
    n, v = sum(grams[0].values()), len(grams[0])

    def probability(words):
        if len(words) == 1:
            return (grams[0][words] + 0.1) / (n + 0.1 * (v + 1))
        context = grams[len(words) - 2][words[:-1]]
        return (grams[len(words) - 1][words] + lm.BACKOFF_MASS * probability(words[1:])) / (context + lm.BACKOFF_MASS)

    out = []
    for (i, _), t, h in zip(rows, tokens, held, strict=True):
        base = sum(math.log10(probability((w,))) for w in t)
        score = sum(math.log10(probability(tuple(t[max(0, k - 2) : k + 1]))) for k in range(len(t)))
        out.append((i, h, len(t), sum(grams[0][w,] > 0 for w in t), n, base, score))
    return sorted(out, key=lambda r: (repr(r[0]), r[5]))


@pytest.mark.parametrize("route", [None, Route(6, 3, 2)])
def test_against_a_plain_model(spark, monkeypatch, route):
    monkeypatch.setattr("rollbook.llm.blocks.BLOCK_BYTES", 4096)
    monkeypatch.setattr(lm, "SHARD_BYTES", 8192)
    got = sorted((tuple(r) for r in lm.score(fx.documents(spark), TRAINED, route).collect()), key=lambda r: (repr(r[0]), r[5]))
    want = plain(fx.texts())
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


def automaton(trained, probes):
    texts = [*trained, *probes]
    grams = lm.Grams(pa.array(texts), np.arange(len(texts)) < len(trained))
    counts = [k.counts for k in grams.keys]
    return grams, lm.BackoffAutomaton(grams, counts, int(counts[0].sum()), int((counts[0] > 0).sum()))


@pytest.mark.parametrize("context", ["", "a ", "a b ", "b b ", "c a ", "never ", "never a ", "a never ", "b a b "])
def test_the_models_own_probabilities_sum_to_one(context):
    trained = ["a b c a b d", "b a b b", "c", "", "a b c"]
    probes = [context + w for w in ("a", "b", "c", "d", "unseen")] + [context.strip()]
    grams, model = automaton(trained, probes)
    weight, n = model.traverse(grams), len(context.split())
    assert sum(10 ** weight[grams.first[len(trained) + i] + n] for i in range(len(probes))) == pytest.approx(1)


def test_the_state_is_the_longest_trained_end_and_failures_lead_to_shorter_ones():
    grams, model = automaton(["a b c", "b d"], ["a b d x"])
    order = model.order_of[model.states(grams)]
    assert order[-5:].tolist() == [1, 2, 2, 0, 0]  # a; a b; b d; x was never trained; the end
    weight, m = model.traverse(grams)[-5:], lm.BACKOFF_MASS
    n, v = 7, 5
    p = lambda c: (c + 0.1) / (n + 0.1 * (v + 1))
    # after a b there is no d: fail to b, which has it
    assert weight[2] == pytest.approx(math.log10(m / (1 + m)) + math.log10((1 + m * p(1)) / (2 + m)))
    # x: from b d to d to the root
    assert weight[3] == pytest.approx(2 * math.log10(m / (1 + m)) + math.log10(p(0)))


def test_messages_grow_less_than_the_square():
    """Blocks and shards both grow with the input; over nodes the messages do so with its power 1.5."""
    sizes = [10**k for k in range(4, 8)]
    routes = [Route.between(n, n) for n in sizes]
    messages = [n * r.groups + r.groups * r.block_groups * (r.shards // r.groups) for n, r in zip(sizes, routes, strict=True)]
    assert all(b <= 33 * a for a, b in zip(messages, messages[1:], strict=False))
    assert Route.between(64, 20).groups == 1


def test_keys_come_back_from_their_message():
    r = np.random.default_rng(0)
    low = np.unique(r.integers(0, 2**63, 50).astype(np.uint64))
    for high in (None, r.integers(0, 2**63, len(low)).astype(np.uint64)):
        for counts in (r.integers(0, 9, len(low)), r.integers(0, 2**40, len(low))):
            (got,) = unpack(pack([Keys(low, counts, high)]))
            assert (got.low == low).all() and (got.counts == counts).all() and (high is None or (got.high == high).all())


def test_empty_table(spark):
    assert lm.score(fx.documents(spark, []), TRAINED).collect() == []
