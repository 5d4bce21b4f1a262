from __future__ import annotations

from collections import Counter

import pytest

from rollbook.llm import substrings
from rollbook.llm.exchange import Route
from tests.llm import fixtures as fx


def plain(rows, length):
    texts = [fx.words(t) for _, t in rows]
    runs = Counter(tuple(t[i : i + length]) for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc, _), t in zip(rows, texts, strict=True):
        gone = {i + k for i in range(len(t) - length + 1) if runs[tuple(t[i : i + length])] > 1 for k in range(length)}
        out.append((doc, len(t), len(gone), " ".join(w for i, w in enumerate(t) if i not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length", [35, 12, 4, 1])
def test_against_a_plain_version(spark, monkeypatch, length):
    monkeypatch.setattr("rollbook.llm.blocks.BLOCK_BYTES", 4096)
    monkeypatch.setattr(substrings, "SHARD_BYTES", 8192)
    assert fx.rows(substrings.remove_repeats(fx.documents(spark), length)) == plain(fx.texts(), length)


def test_over_nodes(spark, monkeypatch):
    monkeypatch.setattr("rollbook.llm.blocks.BLOCK_BYTES", 4096)
    assert fx.rows(substrings.remove_repeats(fx.documents(spark), 12, Route(6, 3, 2))) == plain(fx.texts(), 12)


@pytest.mark.parametrize("period", substrings.COVERS)
def test_covers_hold_for_every_shift(period):
    cover = set(substrings.COVERS[period])
    for i in range(period):
        assert any(d % period in cover and (d + i) % period in cover for d in range(period))


def test_empty_table(spark):
    assert substrings.remove_repeats(fx.documents(spark, [])).collect() == []
