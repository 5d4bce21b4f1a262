"""Texts as hashed features: words and their runs of two to four characters, signed, in so many dimensions, of length one. Rows (id, dim, weight), so vectors are joined and summed, never held whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.text import _text
from rollbook.operators.evaluation import IDENTIFIER

DIMENSIONS = 1024
#: Words that say nothing about what is wanted.
STOP = (
    "a", "an", "and", "any", "are", "as", "at", "be", "but", "by", "can", "could", "do", "does", "did", "for", "from", "get", "give", "has", "have", "how", "i", "in", "into", "is", "it", "its", "list", "me", "my", "of", "on", "or", "please", "pls", "plz",
    "show", "that", "the", "their", "them", "there", "these", "they", "this", "those", "to", "use", "want", "we", "what", "when", "where", "which", "who", "will", "with", "would", "you", "your",
)


def masked(c: Column | str, names: Column | None = None) -> Column:
    """A request with [MERCHANT] for each of the names given (an array, in any case) and [ID] for identifiers."""
    out = _text(c)
    if names is not None:
        held = F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda n: n.isNotNull() & (F.trim(n) != ""))
        whole = lambda n: F.concat(F.lit(r"(?i)\b\Q"), F.replace(n, F.lit(r"\E"), F.lit(" ")), F.lit(r"\E\b"))
        out = F.aggregate(held, out, lambda acc, n: F.regexp_replace(acc, whole(n), F.lit(" [MERCHANT] ")))
    return F.trim(F.regexp_replace(F.regexp_replace(out, IDENTIFIER, " [ID] "), r"\s+", " "))


def features(c: Column | str) -> Column:
    """The features of a text's words of two letters and digits or more, stop words and masks aside; each as often as it occurs."""
    words = F.filter(F.split(F.regexp_replace(F.lower(_text(c)), r"\[[a-z_]+\]", " "), "[^a-z0-9]+"), lambda w: (F.length(w) >= 2) & ~w.isin(*STOP))

    def runs(w: Column, n: int) -> Column:
        return F.when(F.length(w) >= max(n, 3), F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.concat(F.lit(f"c{n}:"), F.substr(w, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(words, lambda w: F.concat(F.array(F.concat(F.lit("w:"), w)), runs(w, 2), runs(w, 3), runs(w, 4))))


def encode(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, dim, weight): the vectors of all texts; one without features has no rows. Texts of one id make one vector.

    A feature's place is the first eight bytes of its MD5, as one number, modulo DIMENSIONS; the bit above the lowest
    eight is its sign. Counts are summed before vectors are scaled.
    """
    low = F.conv(F.substr(F.md5("_f"), F.lit(14), F.lit(3)), 16, 10).cast("int")
    each = df.select(F.col(id).alias("id"), F.explode(features(text)).alias("_f")).select("id", (low % DIMENSIONS).alias("dim"), F.when(F.shiftright(low, 8).bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(-1.0).alias("_s"))
    cells = each.groupBy("id", "dim").agg(F.sum("_s").alias("_w")).where("_w <> 0")
    norm = cells.groupBy("id").agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_n"))
    return cells.join(norm, "id").select("id", "dim", (F.col("_w") / F.col("_n")).alias("weight"))


def nearest(vectors: DataFrame, exemplars: DataFrame) -> DataFrame:
    """(id, intent, similarity, margin): the intent of the likest exemplar (vectors with a column intent), and by how much it leads the next intent.

    Both sides are rows; they meet by dimension and products are summed by pair, so a vector is only held against
    exemplars that share a dimension. Exemplars are a stated set of phrases; vectors without a shared dimension have no row.
    """
    other = exemplars.select(F.col("id").alias("_e"), "intent", "dim", F.col("weight").alias("_w"))
    dots = vectors.join(other, "dim").groupBy("id", "intent", "_e").agg(F.sum(F.col("weight") * F.col("_w")).alias("_s"))
    best = dots.groupBy("id", "intent").agg(F.round(F.max("_s"), 6).alias("_s"))
    ranked = best.groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.col("_s")).alias("m"), "intent"))).alias("_r"))
    second = F.coalesce(F.get("_r", F.lit(1))["m"], F.lit(0.0))
    first = F.get("_r", F.lit(0))
    return ranked.select("id", first["intent"].alias("intent"), (-first["m"]).alias("similarity"), F.round(second - first["m"], 6).alias("margin"))
