"""Requests as typed: the identifiers in them, names pasted beside, lists, and what is only wording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.identifiers import shape_kinds
from rollbook.functions.text import _text, canonical, code

#: Characters mistaken for each other, and words that a pasted name starts to be wording with.
LOOKALIKES = {"0": "O", "1": "I", "2": "Z", "5": "S", "8": "B", "O": "0", "I": "1", "Z": "2", "S": "5", "B": "8"}
INSTRUCTIONS = ("get", "give", "find", "show", "list", "send", "pull", "fetch", "need", "please", "provide", "check", "confirm", "what", "which", "who", "how")
_EDGES = ".,:;!?()[]{}'\""
_CLASS = "".join("\\" + c for c in _EDGES)


def identifier_tokens(c: Column | str) -> Column:
    """Pieces of a text between white space, commas and semicolons, without punctuation at either end; a label before a hyphen goes if a value follows."""
    pieces = F.filter(F.split(_text(c), r"[\s,;]+"), lambda w: w != "")
    bare = F.transform(pieces, lambda w: F.regexp_replace(F.regexp_replace(w, f"^[{_CLASS}]+", ""), f"[{_CLASS}]+$", ""))
    label = r"(?i)^(?:mx ?code|tid|terminal|mid|payable|alias|phone|email|account|acct|acc|static|bvn|id|no|code)[-:=](.+)$"

    def unlabelled(w: Column) -> Column:
        value = F.regexp_extract(w, label, 1)
        return F.when((F.length(value) >= 4) & (value.rlike(r"\d") | value.contains("@")), value).otherwise(w)

    return F.filter(F.transform(bare, unlabelled), lambda w: w != "")


def parse(requests: DataFrame, membership: DataFrame | None = None) -> DataFrame:
    """(request columns but text, token, kind): identifiers in each text. A value that the registry holds (value, kinds) has the kinds of its columns, else those of its shape."""
    rows = requests.withColumn("token", F.explode(F.array_distinct(identifier_tokens("text")))).withColumn("_shape", shape_kinds("token"))
    kinds = F.col("_shape")
    if membership is not None:
        rows = rows.join(membership.select(F.col("value").alias("_v"), F.col("kinds").alias("_held")), code("token") == F.col("_v"), "left")
        kinds = F.coalesce("_held", "_shape")
    return rows.select(*[c for c in requests.columns if c != "text"], "token", F.explode(kinds).alias("kind"))


def named_lines(requests: DataFrame) -> DataFrame:
    """(request columns but text, id, name): lines whose first piece is an identifier, with the words after it as the name; not lines with an instruction."""
    lines = requests.withColumn("_l", F.explode(F.split(_text("text"), r"\r?\n"))).withColumn("_l", F.trim(F.regexp_replace("_l", r"\s+", " ")))
    ask = r"(?i)\b(?:" + "|".join(INSTRUCTIONS) + r")\b"
    rows = lines.where(F.col("_l").contains(" ") & ~F.col("_l").rlike(ask)).withColumn("id", F.substring_index("_l", " ", 1))
    return rows.where(F.size(shape_kinds("id")) > 0).select(*[c for c in requests.columns if c != "text"], "id", F.trim(F.expr("substr(_l, length(id) + 1)")).alias("name"))


def list_lines(text: DataFrame) -> DataFrame:
    """Names of a pasted list or file (column value, a line each): trimmed, without blank lines and comments (# and //), in order without repeats of a line."""
    return text.select(F.trim(_text("value")).alias("value")).where("value <> '' and not startswith(value, '#') and not startswith(value, '//')").distinct()


def variants(c: Column | str, most: int = 24) -> Column:
    """A code's spellings with one or two characters swapped for those they are mistaken for, itself among them, sorted, ``most`` at most."""
    value = code(c)
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(value), F.lit(1))), lambda i: F.substr(value, i, F.lit(1)).isin(*LOOKALIKES))
    pairs = F.create_map(*[F.lit(x) for kv in LOOKALIKES.items() for x in kv])
    swap = lambda v, i: F.concat(F.substr(v, F.lit(1), i - 1), pairs[F.substr(v, i, F.lit(1))], F.substr(v, i + 1, F.length(v)))
    one = F.transform(places, lambda i: swap(value, i))
    two = F.flatten(F.transform(places, lambda i: F.transform(F.filter(places, lambda j: j > i), lambda j: swap(swap(value, i), j))))
    every = F.array_distinct(F.concat(F.array(value), one, F.when(F.size(one) + 1 < most, F.slice(two, 1, F.greatest(most - 1 - F.size(one), F.lit(0)))).otherwise(F.array().cast("array<string>"))))
    return F.slice(F.array_sort(every), 1, most)


def fulltext_query(c: Column | str) -> Column:
    """A text as a query for all its words, each quoted."""
    words = F.filter(F.split(canonical(c), " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " AND ")


def without_noise(c: Column | str, triggers: tuple[str, ...], noise: tuple[str, ...]) -> Column:
    """A request of three words or more that has a trigger, without the noise words; else, or if nothing would be left, as it is."""
    text = F.trim(_text(c))
    words = F.split(text, r"\s+")
    kept = F.filter(words, lambda w: ~F.lower(w).isin(*noise))
    asks = F.lit(False)
    for t in triggers:
        asks = asks | F.lower(text).contains(t)
    return F.when((F.size(words) >= 3) & asks & (F.size(kept) > 0), F.array_join(kept, " ")).otherwise(text)


#: What may follow a family's name within a longer one, and the shortest name that a typo is forgiven.
ROOT_ENDS, LEAST_ROOT = (" ", "-", "\u2013", "\u2014", "/", "&"), 5


def family_roots(names: DataFrame, roots: DataFrame) -> DataFrame:
    """(name, root): the families (column root) that names (column name) belong to, the most specific only.

    A name is a root's if it is the root or begins with it before a separator; else if its first word is one edit from
    a root of one word, both of five letters or more, of several the first in order. Both sides meet by the beginning
    of three letters for whole roots, and by words with one letter left out for typos, never as all pairs.
    """
    n = names.select(F.upper(F.trim(_text("name"))).alias("name")).where("name <> ''").distinct()
    r = roots.select(F.upper(F.trim(_text("root"))).alias("root")).where("root <> ''").distinct()
    head = lambda c: F.substr(c, F.lit(1), F.lit(3))
    after = F.substr("name", F.length("root") + 1, F.lit(1))
    whole = n.withColumn("_h", head("name")).join(r.withColumn("_h", head("root")), "_h").where(F.startswith("name", F.col("root")) & ((F.col("name") == F.col("root")) | after.isin(*ROOT_ENDS))).select("name", "root")
    # All whole roots of a name begin it, so the longest is the most specific; shorter ones stay only where no separator ends them within it.
    longest = whole.groupBy("name").agg(F.max_by("root", F.length("root")).alias("_l"))
    inside = (F.col("root") != F.col("_l")) & F.startswith("_l", F.col("root")) & F.substr("_l", F.length("root") + 1, F.lit(1)).isin(*ROOT_ENDS)
    exact = whole.join(longest, "name").where(~inside).select("name", "root")
    cuts = lambda c: F.array_distinct(F.concat(F.array(F.col(c)), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substr(c, F.lit(1), i - 1), F.substr(c, i + 1, F.length(c))))))
    rest = n.join(exact.select("name").distinct(), "name", "left_anti").withColumn("_w", F.substring_index("name", " ", 1)).where(F.length("_w") >= LEAST_ROOT)
    short = r.where(~F.contains("root", F.lit(" ")) & (F.length("root") >= LEAST_ROOT))
    near = rest.select("name", "_w", F.explode(cuts("_w")).alias("_c")).join(short.select("root", F.explode(cuts("root")).alias("_c")), "_c").where(F.levenshtein("_w", "root") <= 1)
    return exact.unionByName(near.groupBy("name").agg(F.min("root").alias("root")))
