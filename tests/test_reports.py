"""Reports whose joins meet common words, codes and values: against plain versions, with bounds on what they hold."""

from __future__ import annotations

import random

from rollbook.operators import reports, search

SCHEMA = "id bigint, sheet_name string, merchant_name string, tid string, mxcode string, address string, email string, account_number string, raw_data string"


def _written(monkeypatch):
    seen, real = {}, reports.written

    def spy(df, name, **options):
        out = real(df, name, **options)
        seen[name] = [r.asDict() for r in out.collect()]
        return out

    monkeypatch.setattr(reports, "written", spy)
    return seen


def test_common_words_of_addresses(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, "s", "M", rng.choice(["", f"t{i % 40}"]), "", f"{rng.choice(['OAK', 'ELM', 'FIR'])} market {rng.choice(['north', 'south'])} road", "", "", None) for i in range(200)]
    asked = [f"{n} market building {w} road" for n in range(100, 130) for w in ("north", "oak", "elm south", "LEKKI")]
    seen = _written(monkeypatch)
    found = {(r["value"], r["id"], r["shared"], r["ratio"]) for r in reports.by_address(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(x,) for x in asked], "value string")).collect()}
    want = set()
    for v in asked:
        q = {w for w in v.upper().split() if len(w) >= 3 and w != "LEKKI"}
        best = {}
        for i, _, _, tid, _, address, *_ in rows:
            a = set(address.upper().split())
            shared, ratio = len(q & a), len(q & a) / len(q | a)
            if shared >= 2 and ratio >= 0.4:
                best[tid or i] = min(best.get(tid or i, (1,)), (-round(ratio, 6), -shared, i))
        want |= {(v, i, -n, -x) for x, n, i in sorted(best.values())[:4]}
    assert found == want
    assert len(seen["addresses"]) <= 4 * 6  # before, every record met every address that shares a word


def test_parts_of_identifiers(spark):
    """Digits share runs of three without end; a code meets only what it holds or is held by."""
    rows = [(i, "s", "M", "", f"MX{i:05d}", "", "", "", None) for i in range(300)]
    queries = [f"AMX{i:05d}B" for i in range(0, 300, 3)] + ["X00007", "MX00008"]
    df, q = spark.createDataFrame(rows, SCHEMA), search.asked(spark.createDataFrame([(x,) for x in queries], "query string"))
    found = {(r["query"], r["id"], r["hit_score"]) for r in search.identifier_hits(df, q).collect()}
    assert found == {(f"AMX{i:05d}B", i, 90.0) for i in range(0, 300, 3)} | {("X00007", 7, 90.0), ("MX00008", 8, 100.0)}
    values = df.select("mxcode")
    assert search.runs(values, "mxcode", q, "query").count() == 300 * 2  # runs of six, the only shorter length asked for


def test_former_names_are_distinct(spark):
    sheet = "Change-of-details sheet"
    new = '{"NEW MERCHANT ACCOUNT NAME": "Fresh", "OLD MERCHANT ACCOUNT NAME": "%s"}'
    rows = [
        (1, "a", "One", "t1", "MX1", "", "", "", None), (2, sheet, " One", "t1", "MX1", "", "", "", new % "Older"), (3, "Change b", "Two", "t1", "MX2", "", "", "", new % "Eldest"), (4, "b", "Two", "t9", "MX1", "", "", "", None),
        (5, "Change b", "One", "t7", "", "", "", "", new % "Other"), (6, "c", "Lone", "t8", "", "", "", "", None),
    ]
    found = [tuple(r) for r in reports.former_names(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("t1",), ("t8",), ("zz",)], "value string")).collect()]
    changed = {("t1", n, sheet) for n in ("One", "Two", "Fresh", "Older", "Eldest", "Other")}
    assert len(found) == len(set(found)) and set(found) == changed | {("t1", "One", "a"), ("t1", "Two", "b")}


def test_former_names_against_a_plain_version(spark):
    """Names that keys of one record share, on both sides of ``heavy``, in lists of two and in one."""
    sheet, rng = "Change-of-details sheet", random.Random(3)
    some = lambda xs: rng.choice(xs)
    new = '{"NEW MERCHANT ACCOUNT NAME": "%s", "OLD MERCHANT ACCOUNT NAME": "%s"}'
    rows = []
    for i in range(160):
        where, words = some([sheet, "Change b", "a", "b"]), ["One", "two ", "Three", "", "Four"]
        cells = (some(words), some(words + [f"N{i}"])) if "Change" in where else None
        rows.append((i, where, some(["One", " one", "Two", "", "Three"]), f"t{some('acdefghjkm')}" if i % 9 else "", f"mx{some('acde')}" if i % 7 else "", "", "", "", new % cells if cells else None, cells or ()))
    asked = [f"T{x}" for x in "acdefghjkmq"] + ["MXC"]
    key = lambda x: x.strip().upper()
    want = set()
    for v in asked:
        own = min((r for r in rows if v.upper() in (key(r[3]), key(r[4]))), default=None, key=lambda r: r[0])
        for r in rows if own else ():
            if "Change" in r[1] and any(key(own[c]) and key(own[c]) == key(r[c]) for c in (2, 3, 4)):
                want |= {(v, n.strip(), sheet) for n in (r[2], *r[9])}
            if key(own[4]) and key(own[4]) == key(r[4]):
                want.add((v, r[2].strip(), r[1]))
    df, w = spark.createDataFrame([r[:9] for r in rows], SCHEMA), spark.createDataFrame([(x,) for x in asked], "value string")
    for heavy, part in ((1, 2), (3, 500), (1000, 2)):
        found = [tuple(r) for r in reports.former_names(df, w, heavy, part).collect()]
        assert len(found) == len(set(found)) and set(found) == {x for x in want if x[1]}


def _exchanged(spark, run):
    """Rows that run writes for exchanges."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = lambda: {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (lambda all: [all.apply(i) for i in range(all.size())])(store.stageList(None, False, False, gateway.new_array(spark._jvm.double, 0), None))}
    before = stages()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for k, n in stages().items() if k not in before)


def test_former_names_exchange_no_pairs(spark):
    """Identifiers and names of one common name: the result has 300 times 301 rows, of which none is exchanged."""
    rows = [(i, "Change b", "Branch", f"t{i:04d}", f"MX{i:04d}", "", "", "", '{"NEW MERCHANT ACCOUNT NAME": "New %d"}' % i) for i in range(300)]
    df, w = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(r[3],) for r in rows], "value string")
    n = _exchanged(spark, lambda: [tuple(r) for r in reports.former_names(df, w).toLocalIterator()])
    assert n < 20_000
    assert reports.former_names(df, w).distinct().count() == 300 * 301 + 300


def test_only_wanted_cells_are_exchanged(spark):
    """Cells of records that hold no wanted value are left where they are, where wanted values are too many to be broadcast."""
    rows = [(i, "s", "M", f"t{i:05d}", f"MX{i:05d}", "", f"e{i}@x.org", "", None) for i in range(5000)]
    df, w = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(f"T{i:05d}",) for i in range(0, 5000, 10)], "value string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        n = _exchanged(spark, lambda: reports.profiles(df, w).write.format("noop").mode("overwrite").save())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert n < 6000


def test_linked_counts_with_heavy_values(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i if i else 1, "s", "M", f"t{rng.randrange(60)}", f"MX{rng.randrange(3)}", "", f"e{rng.randrange(20)}", rng.choice([None, "MX1", f"{rng.randrange(9)}"]), None) for i in range(150)]
    asked = [f"t{i}" for i in range(0, 70, 5)] + ["MX1"]
    cells = lambda r: {x.upper() for x in (r[3], r[4], r[6], r[7]) if x}
    want = {}
    for v in asked:
        hits = sorted((r for r in rows if v.upper() in cells(r)), key=lambda r: r[0])
        first = [r for r in hits if r[0] == hits[0][0]]
        want[v] = len({r[0] for r in rows if cells(r) & cells(first[0])}) if hits else 0
    for heavy in (1, 12, 1000):
        seen = _written(monkeypatch)
        got = {r["identifier"]: r["n"] for r in reports.linked_counts(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(x,) for x in asked], "value string"), heavy).collect()}
        assert got == want
        if heavy == 12:  # codes and mails of more records than that are counted, not listed
            assert not any(k.startswith("MX") for r in seen["held"] for k in r["few"])
