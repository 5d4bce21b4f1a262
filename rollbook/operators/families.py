"""Families of records: which values prove that records are one merchant's, and what hangs together by them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.identifiers import plausible
from rollbook.functions.text import _text, code, email, family_tokens, name_key, phone
from rollbook.operators.entities import components
from rollbook.operators.registry import filled
from rollbook.sources.shared import written

#: Fields that link records, and those that still do beyond the first hop.
LINKS = ("email", "phone", "mxcode", "tid", "payable_code", "account_number", "merchant_id")
PRIMARY = ("mxcode", "tid", "payable_code", "account_number", "merchant_id")
IDENTITY = ("tid", "mxcode", "merchant_id", "account_number")


def _normal(field: str) -> Column:
    return {"email": email, "phone": phone}.get(field, code)(field)


def link_values(df: DataFrame, fields: tuple[str, ...] = LINKS) -> DataFrame:
    """(id, field, value): plausible values of linking fields, normalised; a row each."""
    have = [f for f in fields if f in df.columns]
    cells = F.filter(F.array(*[F.struct(F.lit(f).alias("field"), F.when(plausible(f, _normal(f)), _normal(f)).otherwise("").alias("value")) for f in have]), lambda x: x["value"] != "")
    return df.select("id", F.inline(cells))


def specific_values(df: DataFrame, signatures: bool = True) -> DataFrame:
    """(field, value) of the link values that belong to one merchant.

    Either all names that carry the value have a distinctive word in common, or, with ``signatures``, all of them
    hang together by records with equal identifiers (two or more filled). Names per value are counted by combining
    aggregates over distinct (value, name, word), so no value's records meet in one task.
    """
    links = link_values(df)
    named = df.where(F.trim(_text("merchant_name")) != "").select("id", F.upper(F.trim("merchant_name")).alias("_name"), family_tokens("merchant_name").alias("_core"), *[code(f).alias(f"_s{i}") for i, f in enumerate(IDENTITY)])
    rows = links.join(named, "id")
    names = rows.select("field", "value", "_name", "_core").distinct()
    count = names.groupBy("field", "value").agg(F.count("*").alias("names"))
    words = names.select("field", "value", F.explode("_core").alias("_w")).groupBy("field", "value", "_w").agg(F.count("*").alias("k")).groupBy("field", "value").agg(F.max("k").alias("k"))
    judged = links.select("field", "value").distinct().join(count, ["field", "value"], "left").join(words, ["field", "value"], "left")
    plain = (F.coalesce("names", F.lit(0)) <= 1) | (F.col("k") == F.col("names"))
    if not signatures:
        return judged.where(plain).select("field", "value")
    # Names of a value that share a signature are linked; the value is one merchant's if one component has all its names.
    judged = written(judged.select("field", "value", "names", F.coalesce(plain, F.lit(False)).alias("plain")), "judged")
    open_ = judged.where("not plain").select("field", "value", "names")
    cells = [F.col(f"_s{i}") for i in range(len(IDENTITY))]
    filled_cells = reduce(lambda a, b: a + b, [(c != "").cast("int") for c in cells])
    signed = rows.join(open_.select("field", "value"), ["field", "value"]).where(filled_cells >= 2).select("field", "value", "_name", F.to_json(F.array(*cells)).alias("_sig")).distinct()
    node = lambda c: F.xxhash64("field", "value", F.lit(c), c)
    edges = written(signed.select("field", "value", "_name", node("_name").alias("a"), node("_sig").alias("b")), "signatures")
    roots = components(edges.select("a", "b"))
    rooted = edges.select("field", "value", "_name", "a").distinct().join(roots, "a", "left").withColumn("component", F.coalesce("component", "a"))
    whole = rooted.groupBy("field", "value").agg(F.count_distinct("component").alias("parts"), F.count_distinct("_name").alias("held"))
    proven = open_.join(whole, ["field", "value"]).where("parts = 1 and held = names").select("field", "value")
    return judged.where("plain").select("field", "value").unionByName(proven)


def seeds(df: DataFrame, name: str, limit: int = 5) -> DataFrame:
    """The first records whose name has the text in it; if none has, by slip header, then by account name."""
    part = name.strip().upper()
    columns = [c for c in ("merchant_name", "slip_header", "account_name") if c in df.columns]
    rank = reduce(lambda out, ic: F.when(F.upper(_text(ic[1])).contains(part), ic[0]).otherwise(out), reversed(list(enumerate(columns))), F.lit(None).cast("int"))
    hits = df.select("id", rank.alias("_rank")).where("_rank is not null") if part else df.select("id", F.lit(0).alias("_rank")).limit(0)
    best = hits.agg(F.min("_rank").alias("_best"))
    return hits.join(F.broadcast(best), F.col("_rank") == F.col("_best")).orderBy("id").limit(limit).select("id")  # one row


def family(df: DataFrame, seed_ids: DataFrame, signatures: bool = True) -> DataFrame:
    """df's records that share a specific value with a seed, with the least such value as reason."""
    links = link_values(df).join(specific_values(df, signatures), ["field", "value"])
    keys = links.join(seed_ids.select("id").distinct(), "id").select("field", "value").distinct()
    members = links.join(keys, ["field", "value"]).groupBy("id").agg(F.min(F.concat_ws("=", "field", "value")).alias("reason"))
    return df.join(members, "id")


def graph(df: DataFrame, seed_ids: DataFrame, depth: int = 2, signatures: bool = True) -> DataFrame:
    """(id, depth): records by how many hops over specific values they are from a seed; the first hop takes all link fields, later ones the primary.

    Each hop is two joins over the long form, written, and never lists the pairs of a value.
    """
    links = written(link_values(df).join(specific_values(df, signatures), ["field", "value"]), "links")
    reached = written(seed_ids.select("id").distinct().withColumn("depth", F.lit(0)), "reached")
    for hop in range(1, depth + 1):
        usable = links if hop == 1 else links.where(F.col("field").isin(*PRIMARY))
        keys = reached.where(F.col("depth") == hop - 1).join(usable, "id").select("field", "value").distinct()
        new = usable.join(keys, ["field", "value"]).select("id").distinct().join(reached, "id", "left_anti").withColumn("depth", F.lit(hop))
        reached = written(reached.unionByName(new), "reached")
    return reached


def same_family(a: Column, b: Column) -> Column:
    """Whether two records (structs) are of one merchant: a distinctive word of the names, or a primary identifier, in common."""
    shared = F.size(F.array_intersect(family_tokens(a["merchant_name"]), family_tokens(b["merchant_name"]))) > 0
    return reduce(Column.__or__, [(code(a[f]) != "") & (code(a[f]) == code(b[f])) for f in PRIMARY], shared)


def profile(df: DataFrame, member_ids: DataFrame, fields: tuple[str, ...] = LINKS) -> DataFrame:
    """(field, value, n, names, forms): what a family's records hold, each value with how many records and names have it and its spellings."""
    rows = df.join(member_ids.select("id").distinct(), "id")
    have = [f for f in fields if f in df.columns]
    cells = F.filter(F.array(*[F.struct(F.lit(f).alias("field"), F.trim(_text(f)).alias("raw")) for f in have]), lambda x: x["raw"] != "")
    long = rows.select(name_key("merchant_name").alias("_name"), F.inline(cells))
    return long.groupBy("field", F.upper("raw").alias("value")).agg(F.count("*").alias("n"), F.count_distinct(F.when(filled("_name"), F.col("_name"))).alias("names"), F.count_distinct("raw").alias("forms"))


def shared_between(df: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(field, value, in_left, in_right) of two families' values: in common, or one's alone."""
    sides = [profile(df, ids).select("field", "value", F.lit(True).alias(f"in_{side}")) for side, ids in (("left", left), ("right", right))]
    return sides[0].join(sides[1], ["field", "value"], "full").select("field", "value", *[F.coalesce(f"in_{s}", F.lit(False)).alias(f"in_{s}") for s in ("left", "right")])
