"""Entities: clusters over shared values, timelines and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.sources.shared import forget, written


#: Parts that the neighbours of a vertex are dealt into, so that a hub's do not meet in one task.
HUB_PARTS = 8


def stars(members: DataFrame) -> DataFrame:
    """Edges (a, b) from (value, id): every member of a value with its least one. Linear in rows, whatever a value's share.

    Values travel as 128-bit hashes, not as the text they are.
    """
    named = members.select(F.xxhash64("value").alias("v"), F.xxhash64(F.lit(1), "value").alias("w"), "id").distinct()
    least = named.groupBy("v", "w").agg(F.min("id").alias("b"))
    return named.join(least, ["v", "w"]).where("id <> b").select(F.col("id").alias("a"), "b").distinct()


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Large star: every larger neighbour is linked to the least of a vertex and its neighbours; small star: all that are not larger."""
    if larger:
        near = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    parts = least.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(HUB_PARTS - 1))))
    out = near.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(HUB_PARTS)).cast("int")).join(parts, ["a", "part"])
    if larger:
        return out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    return out.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, component): for every vertex of the edges (a, b) that is not the least of its component, the least.

    Alternating stars (Kiveris et al., 2014). Null ends and loops are left out. Each round is written to the shared
    folder, which ends its lineage, and the round before it is deleted; the driver sees a count and a sum of hashes.
    The rounds grow with the logarithm of the largest component.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == before or not now["n"]:
            return edges.select("a", F.col("b").alias("component"))
        before, old = now, edges
        edges = written(_star(_star(edges, True), False), "edges")
        forget(old)


def clusters(edges: DataFrame) -> DataFrame:
    """(id, cluster_id) of every node of the edges (a, b); cluster_id is the least id that links reach."""
    nodes = components(edges).toDF("id", "cluster_id")
    return nodes.unionByName(nodes.select(F.col("cluster_id").alias("id"), "cluster_id").distinct())


def timeline(events: DataFrame, key: str, at: str, kind: str, order: str) -> DataFrame:
    """Per key: how many events, the first and last time, and how many kinds."""
    return events.groupBy(key).agg(F.count("*").alias("n"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count_distinct(kind).alias("variants"))


def before(rows: DataFrame, key: str, at: str, order: str, cell: Column, name: str, stretch: int = 3600) -> DataFrame:
    """rows with the column ``name``: the last cell that is not null of the key's rows before, in order of time, then ``order``; rows without a time come last.

    A key is cut into stretches of so many seconds, each ordered by itself; what a stretch ends with travels to the
    next one as a row. So a key with a third of all rows is spread over its stretches, and what meets for a key is a
    row for each of them. Null keys count as one key.
    """
    rows = rows.withColumn("_cell", cell).withColumn("_part", F.coalesce(F.floor(F.unix_timestamp(F.col(at).cast("timestamp")) / stretch), F.lit(1 << 62)))
    near = Window.partitionBy(key, "_part").orderBy(F.col(at).asc_nulls_last(), order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_near", F.last("_cell", ignorenulls=True).over(near))
    end = F.max_by(F.when(F.col("_cell").isNotNull(), F.col("_cell")), F.when(F.col("_cell").isNotNull(), F.struct(at, order)))
    ends = rows.groupBy(F.col(key).alias("_k"), F.col("_part").alias("_p")).agg(end.alias("_end"))
    far = F.last("_end", ignorenulls=True).over(Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.withColumn("_far", far).drop("_end")
    out = rows.join(carried, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p")), "left")
    return out.withColumn(name, F.coalesce("_near", "_far")).drop("_cell", "_part", "_near", "_k", "_p", "_far")


def changes(events: DataFrame, key: str, at: str, kind: str, order: str) -> DataFrame:
    """Events whose kind differs from the key's event before: old and new kind. An event without a kind neither changes anything nor is changed from."""
    rows = before(events, key, at, order, F.struct(F.col(kind).alias("kind")), "_old")
    return rows.withColumn("old", F.col("_old.kind")).where(F.col("old") != F.col(kind)).select(key, order, F.col(at), "old", F.col(kind).alias("new"))


def risk(count: Column) -> Column:
    """A level by how many records share an identifier."""
    return F.when(count >= 10, "high").when(count >= 3, "medium").otherwise("low")
