from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest

from rollbook.llm import warc

PAGES = "page_id bigint, url string, html string, digest string, payload string, path string"


def cases():
    big = "é<p>" * 900_000
    same = "<html>" + "copy " * 40 + "</html>"
    return [(5, "http://a/x y%\n", same), (3, None, same), (9, "http://b", same), (1, "u", None), (2, "u", ""), (7, "u", "short"), (8, "u", "short"), (20, "u", big), (21, "u", big), (None, "u", same), (30, "u", "a\r\n\r\nWARC/1.1\r\n\r\n" * 20), (31, "u", "x" * 100), (32, "u", "x" * 100), (31, "u", "x" * 100)]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], PAGES).repartition(3)


def plain(rows):
    groups = defaultdict(list)
    for i, _, html in rows:
        groups[html or ""].append(i)
    out = []
    for i, url, html in rows:
        data = (html or "").encode()
        least = min(x for x in groups[html or ""] if x is not None)
        revisit = len(data) >= 100 and i != least
        out.append((i, url, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", least if revisit else None))
    return sorted(out, key=repr)


def test_archives_read_back(spark):
    table = pages(spark, cases())
    chunks = warc.read_chunks(warc.write_archives(table, warc.new_folder(table))).collect()
    records = defaultdict(list)
    for c in chunks:
        records[c["path"], c["record"]].append(c)
    got, contents = [], defaultdict(set)
    for own in records.values():
        own.sort(key=lambda c: c["chunk"])
        assert [c["chunk"] for c in own] == list(range(len(own))) and [c["last"] for c in own] == [False] * (len(own) - 1) + [True]
        assert all(len(c["data"]) <= warc.CHUNK_BYTES for c in own)
        last = own[-1]
        got.append((last["page_id"], last["url"], last["payload_bytes"], last["sha256"], last["record_type"], last["refers_to"]))
        so_far = hashlib.sha256()
        for c in own:
            so_far.update(c["data"])
            if c["record_type"] == "response":
                assert c["sha256"] == so_far.hexdigest()
        if last["record_type"] == "response":
            contents[last["page_id"]].add(b"".join(bytes(c["data"]) for c in own).decode())
    assert sorted(got, key=repr) == plain(cases())
    assert len(max(records.values(), key=len)) > 1
    for i, _, html in cases():
        if i in contents:
            assert contents[i] == {html or ""}


def test_damage_is_noticed(tmp_path):
    path = str(tmp_path / "x.warc.gz")
    with open(path, "wb") as out:
        warc.write_record(out, 1, "u", b"payload", "0" * 64, None, False)
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_records(path))


def test_empty_table(spark):
    table = pages(spark, [])
    assert warc.read_chunks(warc.write_archives(table, warc.new_folder(table))).collect() == []
