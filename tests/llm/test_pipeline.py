from __future__ import annotations

import corpus_pipeline
from rollbook.llm import queries, secrets, tokens
from tests.llm import fixtures as fx
from tests.llm.test_neardup import shingles
from tests.llm.test_tiling import plain_tiles, split


def test_stages_keep_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(5), sf_dir).columns == docs.columns


def planted():
    """Documents of every awkward kind that pass the base rule: copies, near copies, unlike texts under one id, no ids, leaks, secrets."""
    base, other, item = fx.prose(71, 90), fx.prose(72, 120), " ".join(f"item{i}" for i in range(40))
    near = base.split(" ")
    near[40] = "changed"
    rows = [(1, base), (2, base), (3, " ".join(near)), (3, other), (4, other + " x"), (None, other), (None, fx.prose(73, 60)), (None, fx.prose(73, 60)), (5, fx.prose(74, 200) + " " + item), (6, fx.prose(75, 80) + " password: Zx9kkpQ2wv8Tq token=abcdefghijkl"), (6, fx.prose(76, 3000)), (7, "too short"), (8, None), (9, ""), (9, fx.prose(77, 70))]
    return rows, [(1, item), (2, "not there at all in any"), (None, None)]


def test_all_stages_against_plain_versions(spark, tmp_path):
    rows, items = planted()
    docs = fx.documents(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = docs
    out = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, str(tmp_path)).collect(), docs.schema)
        out.append(sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr))
    # Quality: with one labelled text there are no bands, so the base rule alone decides.
    repeated = lambda w: len({i + k for i in range(len(w) - 7) for k in range(8) if sum(w[j : j + 8] == w[i : i + 8] for j in range(len(w) - 7)) > 1})
    good = [(i, t) for i, t in rows if len(w := fx.words(t)) >= 20 and 100 * repeated(w[:400]) <= 30 * len(w)]
    assert out[0] == sorted(good, key=repr)
    # Near duplicates: of each component one row, the least id's; no text without a kept copy is missing.
    linked = plain_links(good)
    components = {}
    for k, root in enumerate(linked):
        components.setdefault(root, []).append(good[k])
    assert len(out[1]) == len(components)
    for members in components.values():
        mine = [m for m in members if m in out[1]]
        least = min((i for i, _ in members if i is not None), default=None)
        assert mine and mine[0][0] == least
    # Benchmark: by plain tiling.
    leaks = {(i, t) for i, t in out[1] for _, item in items if item and sum(x[2] for x in plain_tiles(split(t)[:400], split(item), 5)) >= 0.5 * len(split(item))}
    assert leaks and out[2] == [r for r in out[1] if r not in leaks]
    # Secrets: every text by itself.
    guesser = secrets.Guesser(secrets.dictionary(spark.createDataFrame(out[2], "doc_id bigint, text string")))
    assert out[3] == sorted([(i, secrets.mask(t, secrets.spans_of(t, guesser))) for i, t in out[2]], key=repr)
    assert any("<SECRET>" in t for _, t in out[3]) and not any("Zx9kkpQ2wv8Tq" in t for _, t in out[3])
    # Packing: all tokens and an end of each text, without gaps; and run() gives the same pieces.
    want = sorted((i, len(tokens.byte_bpe(tokens.default_vocabulary("byte_bpe_50k.json"))(t)) + 1) for i, t in out[3] if i is not None)
    for pieces in (corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).collect(), corpus_pipeline.run(spark, str(tmp_path)).collect()):
        bins = {}
        for r in pieces:
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for b in bins.values():
            at = 0
            for offset, length in sorted(b):
                assert offset == at
                at += length
            assert at <= 1024
        assert sorted((r["doc_id"], r["start"] + r["length"]) for r in pieces if r["doc_id"] is not None and not any(o["doc_id"] == r["doc_id"] and o["start"] == r["start"] + r["length"] for o in pieces)) == want


def plain_links(rows):
    """For each row the least place among rows that links of five-word shingles at 0.8 reach."""
    sets = [shingles(t, 5) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    return root


def test_pipeline_on_the_smallest_tables(spark, sf_dir):
    docs = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in out} <= docs
    assert len({(r["doc_id"], r["piece"]) for r in out}) == len(out) > 50


def test_every_query_is_registered():
    names = list(queries.QUERIES)
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.ORACLE_SQL) <= set(names)
