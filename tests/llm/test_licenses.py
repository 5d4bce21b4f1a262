from __future__ import annotations

import re

from rollbook.llm import licenses
from tests.llm import fixtures as fx

LINES = [
    "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License. MIT License", "Licensed under CC BY-NC 4.0.", "cc\nby", "released under the apache license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")", "no license here", "files documentation associated and software this of copy a obtaining person any to charge of free granted hereby is permission",
    "gnu general public license gnu general public license",
]


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fx.fold(text or ""))


def plain(text):
    words = split(text)
    places = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    found, best = plain_windows(text or "")
    labels = {label for _, label in places} | set(filter(None, found.split(",")))
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places})), ",".join(sorted(labels)), 1.0 if places else best


def test_against_every_line_and_template(spark):
    rows = [*fx.texts(), *((100 + i, t) for i, t in enumerate(LINES)), (200, fx.prose(4, 50) + "\n" + "\n".join(LINES) + "\n"), (201, "\n".join(LINES[:2]))]
    got = fx.rows(licenses.scan(fx.documents(spark, rows)).drop("lines"))
    assert got == sorted(((i, *plain(t)) for i, t in rows), key=repr)
    assert {r[6] for r in got} >= {"apache", "gpl", "mit", "cc-by,cc-by-nc"}


def test_lines_are_returned(spark):
    out = licenses.scan(fx.documents(spark, [(1, "x\n" + LINES[3] + "\ny\n" + LINES[3])])).first()
    assert out["lines"] == [LINES[3]]


def test_a_long_line_does_not_match_by_chance(spark):
    """A line of 20,000 words that holds every word of every template, far apart; and the same with one notice in it."""
    words = sorted({w for t, _ in licenses.TEMPLATES for w in t.split()})
    far = [f"filler{i}" for i in range(20_000)]
    far[:: 20_000 // len(words)] = (words * 2)[: len(far[:: 20_000 // len(words)])]
    whole = next(t for t, label in licenses.TEMPLATES if label == "zlib")
    rows = [(1, " ".join(far)), (2, " ".join(far[:9000]) + " " + whole + " " + " ".join(far[9000:]))]
    assert [(r["labels"], r["score"]) for r in licenses.scan(fx.documents(spark, rows)).orderBy("doc_id").collect()] == [("", 0.0), ("zlib", 1.0)]


def test_whole_licenses_are_found(spark):
    long = [(t, label) for t, label in licenses.NOTICES if len(t.split()) > 60]
    assert len(long) >= 4
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(fx.documents(spark, [(i, fx.prose(i, 200) + "\n\n" + wrapped(t, 12, "# ") + "\n" + fx.prose(i + 9, 200)) for i, (t, _) in enumerate(long)])).collect()}
    assert all(label in got[i].split(",") for i, (_, label) in enumerate(long))


def wrapped(text, width, mark=""):
    words = text.split()
    return "\n".join(mark + " ".join(words[i : i + width]) for i in range(0, len(words), width))


def plain_windows(text):
    """Labels and the largest share over all windows of twice a template's words."""
    words, best, labels = split(text), 0.0, set()
    for template, label in licenses.TEMPLATES:
        want, reach = set(template.split()), 2 * len(template.split())
        blocks = [words[i : i + reach] for i in range(len(words))]
        share = max((len(want & set(b)) / len(want) for b in blocks), default=0)
        if share >= licenses.CONTAINMENT:
            best = max(best, share)
            labels.add(label)
    return ",".join(sorted(labels)), best


def test_wrapped_notices(spark):
    notices = [wrapped(t, width, mark) for t, _ in licenses.TEMPLATES for width, mark in ((1, ""), (3, "# "), (5, " * "), (8, "dnl "))]
    notices = [n for n in notices if not any(p in " ".join(split(n)) for p, _ in licenses.PHRASES)]
    texts = [fx.prose(i, 40) + "\n" + n + "\n" + fx.prose(i + 1, 40) for i, n in enumerate(notices)]
    texts += ["\n".join(notices[i : i + 9]) for i in range(0, len(notices), 9)] + [notices[5] + "\n" + notices[5].replace("\n", " ") + "\n" + notices[5]]
    texts += ["\nfiller".join(t.split()) + "\n" for t, _ in licenses.TEMPLATES] + ["\n\nfiller more ".join(t.split()) for t, _ in licenses.TEMPLATES if not t.startswith("released")]
    texts += [t[:cut] for t in texts[::7] for cut in (len(t) // 3, len(t) // 2)]
    texts = [t for t in texts if not any(p in " ".join(split(t)) for p, _ in licenses.PHRASES)]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(fx.documents(spark, list(enumerate(texts)))).collect()}
    assert got == {i: plain_windows(t) for i, t in enumerate(texts)}
    assert all(got[i][1] >= licenses.CONTAINMENT for i in range(len(notices)) if got[i][0])
    assert sum(bool(got[i][0]) for i in range(len(notices))) > 0.8 * len(notices)


def test_lines_of_a_wrapped_notice_are_returned_together(spark):
    notice = "This Source Code Form is subject to the terms\nof the Mozilla Public License, v. 2.0."
    out = licenses.scan(fx.documents(spark, [(1, f"x\n{notice}\ny"), (2, notice.split("\n")[0]), (3, notice.split("\n")[1])])).orderBy("doc_id").collect()
    assert [(r["labels"], r["lines"]) for r in out] == [("mpl", [notice]), ("", []), ("", [])]


def test_empty_table(spark):
    assert licenses.scan(fx.documents(spark, [])).collect() == []
