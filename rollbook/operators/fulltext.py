"""Word and trigram indexes over text columns, and the searches on them."""

import re
from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.text import GENERIC_WORDS, _text, all_of, strip_accents, trigrams

K1, B = 1.2, 0.75
_VOWELLED = re.compile(r"[aeiou]|(?<!^)(?<![aeiou])y")
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate",
    "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """c for consonants and v for vowels, by Porter's rule for y."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _replace(word: str, table: dict[str, str], least: int) -> str:
    for end in sorted(table, key=len, reverse=True):
        if word.endswith(end):
            rest = word[: -len(end)]
            return rest + table[end] if _measure(rest) > least else word
    return word


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """Porter's stemmer (1980) on a lower-case word."""
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and "v" in _shape(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy":
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(word, _STEP2, 0), _STEP3, 0)
    for end in sorted(_STEP4, key=len, reverse=True):
        if word.endswith(end):
            rest = word[: -len(end)]
            if _measure(rest) > 1 and (end != "ion" or rest.endswith(("s", "t"))):
                word = rest
            break
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or (_measure(rest) == 1 and not (_shape(rest)[-3:] == "cvc" and rest[-1] not in "wxy")):
            word = rest
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def stem_udf(c: Column | str) -> Column:
    """Made on call: the declaration needs a session, which executors lack."""

    def run(words: pd.Series) -> pd.Series:
        return words.map(stem)

    return F.pandas_udf(run, "string")(c)


def terms_of(c: Column) -> Column:
    """Lower-case runs of letters and digits, accents off."""
    return F.filter(F.split(F.lower(strip_accents(c)), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def postings(df: DataFrame, id: str, columns: Sequence[str], stemmed: bool = True) -> DataFrame:
    """(id, term, tf, n_terms): how often each term is in a record, and how long the record is.

    Stems are made once for each distinct word, not for each occurrence."""
    words = df.select(F.col(id).alias("id"), terms_of(F.concat_ws(" ", *columns)).alias("words"))
    counted = words.select("id", F.size("words").alias("n_terms"), F.explode("words").alias("word")).groupBy("id", "word").agg(F.count("*").alias("tf"), F.first("n_terms").alias("n_terms"))
    if not stemmed:
        return counted.withColumnRenamed("word", "term")
    stems = counted.select("word").distinct().withColumn("term", stem_udf("word"))
    return counted.join(stems, "word").groupBy("id", "term").agg(F.sum("tf").alias("tf"), F.first("n_terms").alias("n_terms"))


def bm25(index: DataFrame, query: Sequence[str], limit: int) -> DataFrame:
    """(id, score): records that hold every term, best first; ties go to the lesser id."""
    terms = sorted(set(query))
    records = index.select("id", "n_terms").distinct().agg(F.count("*").alias("records"), F.avg("n_terms").alias("mean"))
    hits = index.where(F.col("term").isin(*terms))
    spread = hits.groupBy("term").agg(F.count("*").alias("df"))
    scored = hits.join(F.broadcast(spread), "term").crossJoin(F.broadcast(records))
    idf = F.log(1 + (F.col("records") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_terms") / F.col("mean")))
    return scored.groupBy("id").agg(F.sum(weight).alias("score"), F.count("*").alias("_n")).where(F.col("_n") == len(terms)).drop("_n").orderBy(F.desc("score"), "id").limit(limit)


def ranked(df: DataFrame, id: str, columns: Sequence[str], query: Sequence[str], limit: int) -> DataFrame:
    """(id, score) as bm25 of the postings of unstemmed terms gives them, without making all postings.

    Each record counts the query's few terms in its own row; only counts are aggregated over all records."""
    terms = sorted(set(query))
    words = df.select(F.col(id).alias("id"), terms_of(F.concat_ws(" ", *columns)).alias("_w"))
    rows = words.select("id", F.size("_w").alias("_n"), F.filter("_w", lambda w: w.isin(*terms)).alias("_h"))
    count = lambda t: F.size(F.filter("_h", lambda w: w == t))
    rows = rows.select("id", "_n", F.array(*[count(t) for t in terms]).alias("_tf"))
    spread = rows.where("_n > 0").agg(F.count("*").alias("records"), F.avg("_n").alias("mean"), *[F.count_if(F.get("_tf", F.lit(i)) > 0).alias(f"df{i}") for i in range(len(terms))])
    hits = rows.where(all_of([F.get("_tf", F.lit(i)) > 0 for i in range(len(terms))])).crossJoin(F.broadcast(spread))  # one row

    def weight(i: int) -> Column:
        tf, found = F.get("_tf", F.lit(i)), F.col(f"df{i}")
        idf = F.log(1 + (F.col("records") - found + 0.5) / (found + 0.5))
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_n") / F.col("mean")))

    return hits.select("id", sum((weight(i) for i in range(len(terms))), F.lit(0.0)).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def substring_search(df: DataFrame, columns: Sequence[str], query: str, limit: int, id: str = "id") -> DataFrame:
    """Records in which each of the query's distinctive words (three letters or more; ten at most) is part of a column."""
    words = [w for w in re.findall("[A-Z0-9]+", query.upper()) if len(w) >= 3 and w not in GENERIC_WORDS][:10]
    if not words:
        return df.limit(0)
    all_text = F.upper(F.concat_ws("\x01", *[_text(c) for c in columns]))
    return df.where(all_of([all_text.contains(w) for w in words])).orderBy(id).limit(limit)


def gram_index(df: DataFrame, id: str, columns: Sequence[str]) -> DataFrame:
    """(gram, id): which records hold each run of three characters, as candidates for substring search."""
    return df.select(F.col(id).alias("id"), F.explode(trigrams(F.upper(F.concat_ws("\x01", *[_text(c) for c in columns])))).alias("gram"))


def gram_candidates(index: DataFrame, word: str) -> DataFrame:
    """Ids that hold all runs of a word; the word itself is still to be checked."""
    grams = sorted({word.upper()[i : i + 3] for i in range(len(word) - 2)})
    return index.where(F.col("gram").isin(*grams)).groupBy("id").agg(F.count("*").alias("_n")).where(F.col("_n") == len(grams)).select("id")


def gram_search(df: DataFrame, id: str, columns: Sequence[str], word: str, index: DataFrame | None = None) -> DataFrame:
    """Ids of the records that hold a word of three letters or more: candidates by their runs, each then checked for the word itself.

    A written ``index`` (see gram_index) saves making one; candidates are joined back to the records for the check."""
    found = gram_candidates(gram_index(df, id, columns) if index is None else index, word)
    whole = F.upper(F.concat_ws("\x01", *[_text(c) for c in columns])).contains(word.upper())
    return df.where(whole).select(F.col(id).alias("id")).join(found, "id", "left_semi")


def autocomplete(keys: DataFrame, prefix: str, limit: int, key: str = "bucket_key") -> DataFrame:
    """Keys that start with the prefix, shortest first."""
    return keys.where(F.col(key).startswith(prefix.upper())).select(key).distinct().orderBy(F.length(key), key).limit(limit)
