from __future__ import annotations

import random

import pytest

from rollbook.llm import edits, tokens
from tests.llm import fixtures as fx

PATH = tokens.default_vocabulary("byte_bpe_50k.json")


def count(text: str) -> int:
    return len(tokens.byte_bpe(PATH)(text))


def tree_of(text: str) -> edits.TokenTree:
    return edits.TokenTree(edits.pre_tokens(text))


@pytest.mark.parametrize("seed", range(60))
def test_random_edits_count_as_a_full_encoding(seed, monkeypatch):
    monkeypatch.setattr(edits, "BUCKET", (2, 5, 64)[seed % 3])
    r = random.Random(seed)
    alphabet = ["a", "the", " ", "  ", "\n", "\n\n", "'s", "'", "l", "r", "ß", "é", "12", "!", ".", "\t", " x"] + (["\u00a0", "\u3000", "\x1c"] if seed % 4 == 0 else [])
    make = lambda n: "".join(r.choice(alphabet) for _ in range(n))
    text = make(r.randint(0, 80))
    tree = tree_of(text)
    assert tree.tokens == count(text)
    for _ in range(30):
        a, b = sorted((r.randint(0, len(text)), r.randint(0, len(text))))
        b = min(b, a + r.choice([0, 0, 1, 3, 50]))
        new = make(r.randint(0, 4))
        tree.edit(a, b, new)
        text = text[:a] + new + text[b:]
        assert tree.text() == text
        assert [p for b in tree.pieces for p in b] == edits.pre_tokens(text)
        assert tree.tokens == count(text)
        assert tree.chars == len(text)


def test_only_the_neighbourhood_is_encoded():
    text = fx.prose(9, 5000)
    tree = tree_of(text)
    tree.edit(len(text) // 2, len(text) // 2, "xyz ")
    assert 0 < tree.encoded < 200


@pytest.mark.parametrize("between", [" ", ",", "\n", " x ", "."])
def test_dense_edits_cost_a_constant_each(between):
    """Ten thousand numbers in a row, each replaced; and the other way round, from the front."""
    text = between.join(["1234567"] * 10_000)
    found = edits.edits_of(text, [edits.SCRUB[2]])
    assert len(found) == 10_000
    tree = tree_of(text)
    for edit in found:
        tree.edit(*edit)
    assert tree.encoded < 100 * len(found)
    assert max(map(len, tree.pieces)) < 2 * edits.BUCKET
    after = between.join(["<NUMBER>"] * 10_000)
    assert tree.text() == after and tree.tokens == count(after)
    tree = tree_of(text)
    for k in range(10_000):
        at = k * (8 + len(between))
        tree.edit(at, at + 7, "<NUMBER>")
    assert tree.encoded < 100 * len(found) and tree.text() == after and tree.tokens == count(after)


def test_rules_that_overlap():
    assert edits.edits_of("ab1234567cd 7654321", [(r"b12", "X"), (r"\d+", "Y"), (r"cd 7", "Z"), (r"c", "W")]) == [(12, 19, "Y"), (9, 10, "W"), (1, 4, "X")]


def test_recount(spark):
    rows = [*fx.texts(), (50, "write to a.b@mail.example.com or 10.0.0.12 or 08000000001, " + fx.prose(8, 80) + "c@d.example"), (51, "1234567"), (52, "1234567 " * 3000 + "x" * 9000)]
    got = fx.rows(edits.recount(fx.documents(spark, rows), keep_text=True).select("doc_id", "n_tokens", "n_edits", "n_tokens_after", "text"))
    want = []
    for i, t in rows:
        text = t or ""
        found = edits.edits_of(text, edits.SCRUB)
        for a, b, new in found:
            text = text[:a] + new + text[b:]
        want.append((i, count(t or ""), len(found), count(text), text))
    assert got == sorted(want, key=repr)
    assert {r[0]: r[2] for r in got}[50] == 4
    assert "text" not in edits.recount(fx.documents(spark, rows)).columns


def test_kept_trees_are_revised_again_and_again(spark):
    from pyspark.sql import functions as F

    kept, texts = edits.trees(fx.documents(spark)), {repr((i, t or "")): t or "" for i, t in fx.texts()}
    for new in ("first ", "second"):
        kept = edits.revise(kept.withColumn("edits", F.when(F.length("text") > 3, F.expr(f"array(named_struct('start', 1, 'end', 2, 'new', '{new}'), named_struct('start', 0, 'end', 0, 'new', 'x'))"))))
        texts = {k: "x" + t[:1] + new + t[2:] if len(t) > 3 else t for k, t in texts.items()}
    got = sorted((r["text"], r["n_tokens"], sum(r["leaf_tokens"]), sum(r["leaf_chars"])) for r in kept.collect())
    assert got == sorted((t, count(t), count(t), len(t)) for t in [texts[repr((i, t or ""))] for i, t in fx.texts()])


def test_empty(spark):
    assert edits.recount(fx.documents(spark, [])).collect() == []
    assert edits.trees(fx.documents(spark, [])).collect() == []
    tree = edits.TokenTree([])
    tree.edit(0, 0, "new text")
    assert tree.tokens == count("new text")
    tree.edit(0, 8, "")
    assert (tree.tokens, tree.chars, tree.text()) == (0, 0, "")
