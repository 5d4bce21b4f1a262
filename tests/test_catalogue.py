"""Every registered query of the registry operators against DuckDB on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from rollbook.plans import answers, catalogue, help, logs, planner  # noqa: F401  (these register their queries)


def plain(v):
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) and v == v else None if v is None or v != v else str(v)


def rows(frame) -> list:
    return sorted((tuple(map(plain, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    assert rows(catalogue.QUERIES[name](spark, sf_dir).toPandas()) == rows(duck.execute(catalogue.ORACLE_SQL[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).columns


def test_clusters_link_on_lines_that_many_hold(spark, tmp_path):
    line = "a line of at least forty characters that many hold"
    spark.createDataFrame([(i, f"own {i}\n{line if i < 9 else 'x'}") for i in range(12)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, catalogue.QUERIES["entity_clusters"](spark, str(tmp_path)).collect())) == [(i, 0) for i in range(9)]


def test_every_record_is_a_seed(spark, sf_dir):
    wanted = catalogue.records(spark, sf_dir)
    pairs = {tuple(r) for r in catalogue.registry.linked(wanted, wanted, ["tid", "mxcode"]).collect()}
    groups = {}
    for r in catalogue.QUERIES["related"](spark, sf_dir).collect():
        groups.setdefault((r["field"], r["value"], r["n_linked"]), set()).add(r["seed"])
    assert pairs == {(a, b) for ids in groups.values() for a in ids for b in ids if a != b}
    assert all(len(ids) == n + 1 for (_, _, n), ids in groups.items())
    assert any(a % 500 and b % 500 for a, b in pairs)


def test_every_label_has_an_exemplar(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    labels = {r["label"] for r in vectors.select("label").distinct().collect()}
    assert {r["label"] for r in catalogue.learning.means(vectors).collect()} == labels
    seen = spark.createDataFrame([(i, i % 3, [float(i % 3 == k) for k in range(3)]) for i in range(60)], "vec_id bigint, label bigint, embedding array<float>")
    assert {(r["vec_id"], r["label"], r["similarity"]) for r in catalogue.learning.best_exemplar(seen, catalogue.learning.means(seen)).collect()} == {(i, i % 3, 1.0) for i in range(60)}


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["value", "n"]
