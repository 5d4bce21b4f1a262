from __future__ import annotations

import random
from types import SimpleNamespace

import numpy as np
import pytest

from rollbook.llm import neardup
from rollbook.llm.exchange import Route
from rollbook.operators.entities import components
from tests.llm import fixtures as fx


def shingles(text, width):
    w = fx.words(fx.fold(text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def plain(rows, percent, width):
    sets = [shingles(t, width) for _, t in rows]
    forest = neardup.Forest(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                forest.join(i, j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            root = forest.find(i)
            least[root] = min(doc, least.get(root, doc))
    return sorted(((doc, len(sets[i]), least.get(forest.find(i))) for i, (doc, _) in enumerate(rows)), key=repr)


def variants(seed):
    r = random.Random(seed)
    rows = []
    for k in range(12):
        base = [r.choice("abcdefghijklmnop") + str(r.randint(0, 30)) for _ in range(r.choice([3, 6, 20, 60, 200]))]
        for _ in range(r.randint(1, 9)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                w[r.randrange(len(w))] = r.choice(["new", "x", "y"])
            if r.random() < 0.3:
                w = w[r.randint(0, len(w) // 8) :]
            rows.append((len(rows) * 7 % 101 + 1000 * k, " ".join(w)))
    return rows


@pytest.mark.parametrize(("percent", "width"), [(85, 4), (80, 5), (50, 2), (100, 3)])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, monkeypatch, percent, width, seed):
    monkeypatch.setattr("rollbook.llm.blocks.BLOCK_BYTES", 3000)
    monkeypatch.setattr(neardup, "SHARD_KEYS", 900)
    rows = variants(seed)
    assert fx.rows(neardup.join(fx.documents(spark, rows), percent, width)) == plain(rows, percent, width)


@pytest.mark.parametrize("most", [2, 5])
def test_groups_in_several_chunks(spark, monkeypatch, most):
    monkeypatch.setattr(neardup, "GROUP_SETS", most)
    monkeypatch.setattr(neardup, "SMALL", 1)
    rows = variants(3)
    assert fx.rows(neardup.join(fx.documents(spark, rows), 80, 4)) == plain(rows, 80, 4)


def test_only_parts_of_many(spark, monkeypatch):
    """Without the listing of pairs, and with all of it, the links are the same."""
    rows = variants(5)
    for small in (1, 30):
        monkeypatch.setattr(neardup, "SMALL", small)
        assert fx.rows(neardup.join(fx.documents(spark, rows), 80, 4)) == plain(rows, 80, 4)


def test_over_nodes(spark, monkeypatch):
    monkeypatch.setattr("rollbook.llm.blocks.BLOCK_BYTES", 3000)
    rows = variants(6)
    assert fx.rows(neardup.join(fx.documents(spark, rows), 80, 4, Route(6, 3, 2))) == plain(rows, 80, 4)


def test_awkward_rows(spark):
    rows = fx.texts()
    assert fx.rows(neardup.join(fx.documents(spark, rows), 85, 4)) == plain(rows, 85, 4)
    assert fx.rows(neardup.join(fx.documents(spark, []))) == []


def test_rows_in_are_rows_out(spark):
    a, b, c = (fx.prose(k, 80) for k in (41, 42, 43))
    rows = [(10, a), (25, a + " x"), (25, b + " x"), (11, b), (40, c), (25, a + " x")]
    assert fx.rows(neardup.join(fx.documents(spark, rows))) == plain(rows, 80, 5)
    assert len(plain(rows, 80, 5)) == 6


def test_keep_one_loses_no_text(spark):
    a, b, c, d = (fx.prose(k, 80) for k in (41, 42, 43, 44))
    rows = [(30, a), (25, a + " x"), (25, b + " x"), (31, b), (40, c), (25, d), (None, d), (None, c + " y"), (25, d), (None, a[:300]), (None, a[:300]), (5, None), (5, "")]
    kept = neardup.keep_one(fx.documents(spark, rows))
    assert kept.columns == fx.documents(spark, rows).columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(25, a + " x"), (25, b + " x"), (40, c), (25, d), (None, a[:300]), (5, None), (5, "")], key=repr)


def test_chance_meetings_do_not_chain(spark):
    """A chain of texts, each of which shares a passage with the next: links are none, and no group has them all."""
    rows = [(i, " ".join(f"p{i}w{k}" for k in range(25)) + " " + " ".join(f"p{i + 1}w{k}" for k in range(25))) for i in range(400)]
    found = neardup.Linked(fx.documents(spark, rows).select("doc_id", "text"), 80, 5)
    assert found.classes.where("root <> name").count() == 0
    assert found.classes.count() == 400


def test_a_common_passage_does_not_chain(spark, monkeypatch):
    """Unlike texts that share a passage agree in its parts, many at a time; only real near copies may meet as sets."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = " ".join(word() for _ in range(60))
    texts = [" ".join([*(word() for _ in range(rng.randrange(60, 80))), passage]) for _ in range(300)]
    texts += [f"{texts[0]} {word()}" for _ in range(20)]
    seen, real = [], neardup.written

    def spy(df, name, **options):
        out = real(df, name, **options)
        seen.extend([out.count()] if name == "sets" else [])
        return out

    monkeypatch.setattr(neardup, "written", spy)
    for most in (neardup.BUCKET_SETS, 7):
        monkeypatch.setattr(neardup, "BUCKET_SETS", most)
        found = neardup.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), percent=80, width=5)
        component = {r["doc_id"]: r["component_id"] for r in found.collect()}
        assert component == {i: 0 if i >= 300 else i for i in range(320)}
    assert seen == [21, 21]


def test_signatures_bound_the_overlap():
    r = np.random.default_rng(3)
    for _ in range(200):
        base = r.integers(0, 2**63, 400).astype(np.uint64)
        some = [np.unique(r.choice(base, r.integers(1, 400), replace=False)) for _ in range(2)]
        sets = SimpleNamespace(hashes=np.concatenate(some), text=np.repeat([0, 1], [len(x) for x in some]), n=np.array([len(x) for x in some]))
        x, y = (np.frombuffer(b, "<u8") for b in neardup.signatures(sets))
        assert len(np.intersect1d(*some)) <= neardup.most_common(x, y, len(some[0]), len(some[1])) <= min(map(len, some))


@pytest.mark.parametrize("percent", [50, 80, 85, 95, 100])
def test_schemes_bound_every_linked_pair(percent):
    threshold, schemes = neardup.Threshold(percent), []
    for scheme in threshold.schemes():
        if scheme[1] > 400:
            break
        schemes.append(scheme)
    r = random.Random(percent)
    for _ in range(5000):
        a = r.randint(1, 400)
        b = r.randint(a, min(400, a * 100 // percent))
        _, low, top, parts, keep = max(s for s in schemes if s[1] <= a)
        least = threshold.least_common(a + b)
        if least <= a:
            assert low <= a <= b <= top
            assert a + b - 2 * least < keep < parts
            assert threshold.linked(least, a, b) and not threshold.linked(least - 1, a, b)


def test_tree_finds_the_links_of_all_pairs():
    r = np.random.default_rng(0)
    for _ in range(20):
        base = np.unique(r.integers(0, 2**63, 80).astype(np.uint64))
        sets = [np.unique(np.concatenate([r.choice(base, r.integers(20, 80), replace=False), r.integers(0, 2**63, r.integers(0, 20)).astype(np.uint64)])) for _ in range(30)]
        threshold, plain_forest = neardup.Threshold(60), neardup.Forest(30)
        for i in range(30):
            for j in range(i):
                if threshold.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j])):
                    plain_forest.join(i, j)
        forest = neardup.SignatureTree(sets, threshold).connect()
        assert [forest.find(i) for i in range(30)] == [plain_forest.find(i) for i in range(30)]


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100 + r.randint(0, 30), 100 + r.randint(0, 30)) for _ in range(25)] + [(7, 7), (500, 499)]
    forest = neardup.Forest(600)
    for a, b in edges:
        forest.join(a, b)
    got = {tuple(x) for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {(v, forest.find(v)) for e in edges for v in e if forest.find(v) != v}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_linked_sets_share_a_part():
    rng = np.random.default_rng(7)
    for percent in (80, 85):
        threshold = neardup.Threshold(percent)
        for n in [*range(1, 120), 200, 333, 700]:
            for _ in range(4):
                pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
                same = next(k for k in range(1, n + 1) if threshold.linked(k, n, n))
                a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:same], pool[n : 2 * n - same]]))
                sets = SimpleNamespace(hashes=np.concatenate([a, b]), text=np.repeat([0, 1], n), n=np.array([n, n]), first=np.array([0, n, 2 * n]))
                keys, of = neardup.part_keys(sets, threshold)
                assert np.intersect1d(keys[of == 0], keys[of == 1]).size, (percent, n)


def test_blocks_of_bitmaps_find_all_links():
    rng = np.random.default_rng(11)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
        for _ in range(4):
            changed = base.copy()
            changed[: rng.integers(0, 9)] = rng.integers(0, 1 << 63, dtype=np.uint64)
            sets.append(np.unique(changed))
    threshold = neardup.Threshold(85)
    forest, plain = neardup.SignatureTree(sets, threshold).connect(), neardup.Forest(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            if threshold.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j])):
                plain.join(i, j)
    assert [forest.find(i) for i in range(len(sets))] == [plain.find(i) for i in range(len(sets))]
