"""A small table of documents with every awkward case, and plain versions of what the operators share."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, block bigint, shard string, kept string, n_words string, `group` string, task string, length string, head string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def fold(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    vocabulary = ["".join(r.choice(["an", "the", "or", "ßü", "É", "ti", "wh"]) for _ in range(r.randint(1, 3))) for _ in range(60)]
    return "".join(r.choice(vocabulary) + r.choice([" ", " ", " ", "  ", "\n", ". ", "\t"]) for _ in range(n))


def texts() -> list[tuple[int | None, str | None]]:
    base, other = prose(1, 120), prose(2, 300)
    parts = base.split(" ")
    near = " ".join(parts[:60] + ["CHANGED"] + parts[61:])
    return [
        (10, None), (11, ""), (12, " \n\t "), (13, base), (14, base), (15, near), (16, base.upper()), (17, other), (18, prose(3, 40) + other[200:900] + prose(4, 30)), (19, "one two three"), (20, "one two three"),
        (21, "one two  three four"), (22, "x" * 700 + " y"), (23, "wide space and more 　end"), (24, "Der " * 200), (25, prose(5, 5000)), (25, prose(6, 50)), (26, "漢字 " * 50), (27, "a"),
        (None, "no id here " * 12), (None, base), (-3, other), (28, "tail space "), (29, "\n\nlead\n\n\nlines \n x"), (30, prose(1, 119)),
    ]


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, "s", len(t or ""), 1, "x", "x", "x", "x", "x", "x", "x") for i, t in rows], SCHEMA).repartition(3)


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
