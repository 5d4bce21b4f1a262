"""Answers to lists of identifiers or names: one field, whole profiles, static accounts, changes, former names, comparisons.

``wanted`` is a table with the column value (what was asked for) and, where names were pasted beside, name. Every
report keeps what was not found, with the status not_found. Lists of any length are joined, not looped over.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions import similarity
from rollbook.functions.identifiers import LOCALITIES
from rollbook.functions.text import _text, code
from rollbook.operators.enrichment import CHANGE_KEYS, change_pairs
from rollbook.operators.registry import filled, first_by, perhaps_in, resolve
from rollbook.sources.shared import let_go, written

#: Columns that an identifier is looked up in.
RESOLVE = ("tid", "mxcode", "phone", "email", "account_number", "static_acc_no", "payable_code", "bvn", "merchant_id", "alias")
PROFILE = ("merchant_name", "tid", "mxcode", "phone", "email", "contact_name", "address", "account_name", "account_number", "state", "sheet_name")
#: The mark of sheets that manage static accounts, and fields that only raw cells hold.
STATIC_MARK = "static_account_terminal"
RAW_FIELDS = {"settlement_account": "DEALER ACCOUNT NO", "settlement_bank": "DEALER BANK NAME", "merchant_id": "MERCHANTID", "dealer_name": "DEALER NAME"}
SAME_NAME = 0.55
#: Records that hold a value, beyond which they are counted without being listed.
HEAVY = 1000
#: Names, and identifiers, that meet as one list.
PART = 500
#: Names that a task deals out: their dictionary fits a page of Parquet (1 MB), without which each row holds its name.
NAMES = 40_000


def _have(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def name_status(user: Column, registry: Column) -> Column:
    """found if the names agree by their sorted words, else name_mismatch; no_name if none was given."""
    alike = similarity.udf("token_sort_ratio")(F.upper(F.trim(user)), F.upper(F.trim(registry))) >= SAME_NAME
    return F.when(F.trim(user) == "", "no_name").when(F.trim(registry) == "", "name_mismatch").when(alike, "found").otherwise("name_mismatch")


def _resolved(df: DataFrame, wanted: DataFrame, keep: Sequence[str]) -> DataFrame:
    return resolve(df, wanted, _have(df, RESOLVE), keep=["id", *_have(df, keep)])


def field_report(df: DataFrame, wanted: DataFrame, field: str) -> DataFrame:
    """identifier, merchant, the field, tid, mxcode, sheet and status of each wanted identifier.

    Codes that a terminal's own static sheet holds (payable_code, alias) come from there before any other record.
    """
    found = _resolved(df, wanted, ["merchant_name", field, "tid", "mxcode", "sheet_name"])
    if field in ("payable_code", "alias"):
        own = df.where(F.lower("sheet_name").contains(STATIC_MARK) & filled(field)).select(code("tid").alias("_tid"), F.col(field).alias("_own"), "id")
        own = own.where("_tid <> ''").groupBy("_tid").agg(F.min_by("_own", "id").alias("_own"))
        found = found.join(own, code("value") == F.col("_tid"), "left").withColumn(field, F.coalesce("_own", field))
    names = wanted.select("value", *(["name"] if "name" in wanted.columns else [F.lit("").alias("name")])).dropDuplicates(["value"])
    found = found.join(names, "value")
    status = F.when(F.col("id").isNull(), "not_found").otherwise(name_status(_text("name"), _text("merchant_name")))
    return found.select(F.col("value").alias("identifier"), _text("merchant_name").alias("merchant"), _text(field).alias("answer"), _text("tid").alias("tid"), _text("mxcode").alias("mxcode"), _text("sheet_name").alias("sheet"), status.alias("status"))


def profiles(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """The first record of each wanted identifier, whole; empty cells and not_found without one."""
    found = _resolved(df, wanted, PROFILE)
    return found.select(F.col("value").alias("identifier"), *[_text(c).alias(c) for c in _have(df, PROFILE)], F.when(F.col("id").isNull(), "not_found").otherwise("found").alias("status"))


def raw_report(df: DataFrame, wanted: DataFrame, field: str) -> DataFrame:
    """A field that only the raw cells of records hold (see RAW_FIELDS), of each wanted identifier's record."""
    cells = F.from_json("raw_data", "map<string,string>")
    found = _resolved(df.withColumn("_cell", F.try_element_at(cells, F.lit(RAW_FIELDS[field]))), wanted, ["merchant_name", "_cell"])
    return found.select(F.col("value").alias("identifier"), _text("merchant_name").alias("merchant"), _text("_cell").alias("answer"), F.when(F.col("id").isNull(), "not_found").when(filled("_cell"), "found").otherwise("no_value").alias("status"))


def statics(df: DataFrame) -> DataFrame:
    """Records with a static account."""
    return df.where(F.trim(_text("static_acc_no")) != "")


def static_accounts(df: DataFrame, terminals: DataFrame) -> DataFrame:
    """Static accounts of terminals (value): of the terminal's own rows those of the static sheets, else all its own, else those of its code.

    identifier, mxcode, beneficiary, static_acc_no, payable_code, alias, status.
    """
    first = resolve(df, terminals, ["tid"], keep=("id", "mxcode", "merchant_name")).select("value", code("mxcode").alias("_mx"), F.col("merchant_name").alias("_merchant"), F.col("id").isNotNull().alias("_known"))
    rows = statics(df).select("id", code("tid").alias("_tid"), code("mxcode").alias("_code"), "merchant_name", "static_acc_no", "payable_code", "alias", F.lower("sheet_name").contains(STATIC_MARK).alias("_qtb"))
    own = first.join(rows, code("value") == F.col("_tid")).withColumn("_rank", F.when(F.col("_qtb"), 0).otherwise(1))
    best = own.groupBy("value").agg(F.min("_rank").alias("_rank"))
    own = own.join(best, ["value", "_rank"]).drop("_rank")
    rest = first.where("_known and _mx <> ''").join(best, "value", "left_anti").join(rows, F.col("_mx") == F.col("_code"))
    found = own.unionByName(rest)
    none = first.join(found.select("value").distinct(), "value", "left_anti")
    shown = found.select(F.col("value").alias("identifier"), F.col("_code").alias("mxcode"), F.col("merchant_name").alias("beneficiary"), "static_acc_no", "payable_code", "alias", F.lit("found").alias("status"))
    empty = [F.lit("").alias(c) for c in ("static_acc_no", "payable_code", "alias")]
    return shown.unionByName(none.select(F.col("value").alias("identifier"), _text("_mx").alias("mxcode"), _text("_merchant").alias("beneficiary"), *empty, F.when(F.col("_known"), "no_static_account").otherwise("not_found").alias("status"))).distinct()


def static_of_codes(df: DataFrame, codes: DataFrame) -> DataFrame:
    """Static accounts of merchant codes (value): identifier, beneficiary, static_acc_no and status; a row for each account, one without any."""
    asked = codes.select("value", code("value").alias("_c")).where("_c <> ''").distinct()
    rows = statics(df).select(code("mxcode").alias("_c"), F.col("merchant_name").alias("beneficiary"), "static_acc_no").distinct()
    known = df.select(code("mxcode").alias("_c")).join(asked.select("_c").distinct(), "_c", "left_semi").distinct().withColumn("_known", F.lit(True))
    out = asked.join(known, "_c", "left").join(rows, "_c", "left")
    status = F.when(F.col("static_acc_no").isNotNull(), "found").when(F.col("_known"), "no_static_account").otherwise("not_found")
    return out.select(F.col("value").alias("identifier"), _text("beneficiary").alias("beneficiary"), _text("static_acc_no").alias("static_acc_no"), status.alias("status"))


def by_account(df: DataFrame, accounts: DataFrame) -> DataFrame:
    """Static rows by either account number: value, id and the beneficiary; a row may answer by both, and is there once."""
    rows = statics(df)
    keys = F.array_distinct(F.filter(F.array(code("static_acc_no"), code("account_number")), lambda x: x != ""))
    return rows.select("id", F.col("merchant_name").alias("beneficiary"), "static_acc_no", F.explode(keys).alias("_key")).join(accounts.select("value").distinct(), F.col("_key") == code("value")).select("value", "id", "beneficiary", "static_acc_no")


def terminals_of(df: DataFrame, name: str) -> DataFrame:
    """Every terminal whose merchant or sheet has the name in it, once: its first record with a code, else its first."""
    part = name.strip().upper()
    rows = df.where((F.upper(F.trim(_text("merchant_name"))).contains(part) | F.upper(_text("sheet_name")).contains(part)) & (code("tid") != ""))
    order = F.struct((code("mxcode") == "").alias("none"), F.col("id").alias("at"))
    return rows.groupBy(code("tid").alias("tid")).agg(F.min_by(F.struct("id", "mxcode", "merchant_name", "address"), order).alias("_")).select("tid", "_.*")


def by_address(df: DataFrame, wanted: DataFrame, most: int = 4) -> DataFrame:
    """Records whose address shares two words or more with a wanted address, and two fifths of all; the ``most`` best of each, one a terminal.

    Places known by name and words of two letters do not count. Records with the same words answer alike, so of each
    set of words only the first ``most`` terminals can be among the best; wanted addresses with the same known words
    and as many others are asked once. The sets meet by their rarest words: two that agree in so much share one of
    those that are left when all but one of the words they must share are taken off, the most frequent first.
    """
    words = lambda c: F.array_sort(F.array_distinct(F.filter(F.split(F.regexp_replace(F.upper(_text(c)), "[^A-Z0-9]+", " "), " "), lambda w: w != "")))
    terminal = F.when(code("tid") != "", code("tid")).otherwise(F.concat(F.lit("#"), F.col("id").cast("string")))
    held = df.select("id", "tid", "merchant_name", "address", words("address").alias("_a"), terminal.alias("_t")).where(F.size("_a") >= 2)
    held = first_by(held, ["_a", "_t"], ["id"], ["id", "tid", "merchant_name", "address"])
    held = written(held.withColumn("_r", F.row_number().over(Window.partitionBy("_a").orderBy("id"))).where(F.col("_r") <= most).drop("_r"), "addresses")
    sets = held.select("_a").distinct()
    known = sets.select(F.explode("_a").alias("_w")).groupBy("_w").agg(F.count("*").alias("_n"))
    asked = wanted.select("value", F.filter(words("value"), lambda w: (F.length(w) >= 3) & ~w.isin(*LOCALITIES)).alias("_q")).where(F.size("_q") >= 2).distinct()
    asked = asked.select("value", F.size("_q").alias("_m"), F.explode("_q").alias("_w")).join(known, "_w").groupBy("value", "_m").agg(F.array_sort(F.collect_list(F.struct("_n", "_w"))).alias("_k"))
    asked = written(asked, "asked")
    must = lambda n: F.greatest(F.lit(2), F.ceil(n * 2 / 5)).cast("int")
    rarest = lambda k, n: F.slice(k, 1, F.greatest(F.size(k) - must(n) + 1, F.lit(0)))
    shapes = asked.select("_m", "_k").distinct()
    ranked = sets.select("_a", F.explode("_a").alias("_w")).join(known, "_w").groupBy("_a").agg(F.array_sort(F.collect_list(F.struct("_n", "_w"))).alias("_s"))
    mine = shapes.select("_m", "_k", F.explode(rarest(F.col("_k"), F.col("_m"))["_w"]).alias("_w"))
    pairs = mine.join(ranked.select("_a", F.explode(rarest(F.col("_s"), F.size("_a"))["_w"]).alias("_w")), "_w").select("_m", "_k", "_a").distinct()
    shared = F.size(F.array_intersect(F.col("_k")["_w"], F.col("_a"))).cast("bigint")
    pairs = pairs.withColumn("shared", shared).withColumn("_ratio", F.col("shared") / (F.col("_m") + F.size("_a") - F.col("shared"))).where("shared >= 2 and _ratio >= 0.4")
    near = pairs.withColumn("ratio", F.round("_ratio", 6)).join(held, "_a")
    order = [-F.col("ratio"), -F.col("shared"), F.col("id")]
    one = first_by(near, ["_m", "_k", "_t"], order, ["id", "tid", "merchant_name", "address", "shared", "ratio"])
    best = one.withColumn("_r", F.row_number().over(Window.partitionBy("_m", "_k").orderBy(*order))).where(F.col("_r") <= most)
    return asked.join(best, ["_m", "_k"]).select("value", "id", "tid", "merchant_name", "address", "shared", "ratio")


def change_details(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of change sheets that share the code, the terminal or the exact name with the record of a wanted identifier, with old and new cells."""
    found = _resolved(df, wanted, ["tid", "mxcode", "merchant_name"]).where("id is not null")
    handles = found.select("value", F.inline(F.array(*[F.struct(F.lit(c).alias("kind"), code(c).alias("key")) for c in ("mxcode", "tid", "merchant_name")]))).where("key <> ''").distinct()
    rows = df.where(F.col("sheet_name").contains("Change"))
    own = rows.select("id", F.inline(F.array(*[F.struct(F.lit(c).alias("kind"), code(c).alias("key")) for c in ("mxcode", "tid", "merchant_name")])))
    hits = handles.join(own, ["kind", "key"]).select("value", "id").distinct()
    labels = [k.lower().replace(" ", "_") for k in CHANGE_KEYS]
    changed = F.array_join(F.array(*labels), "") != ""
    return hits.join(rows.select("id", "merchant_name", "mxcode", "tid", *change_pairs("raw_data")), "id").withColumn("changed", changed).withColumnRenamed("value", "identifier")


def former_names(df: DataFrame, wanted: DataFrame, heavy: int = HEAVY, part: int = PART) -> DataFrame:
    """(identifier, variant, source): names on change sheets of the identifier's record, old and new account names there, and names under its code.

    The result grows with identifiers times names, of which nothing is exchanged: names meet identifiers as lists of
    about ``part``, and are told apart before that. A name counts by the first of code, terminal and name that has it;
    what an earlier one has too is taken off the lists, and found by the names that keys share, or for names that
    more than ``heavy`` keys have, by the keys.
    """
    sheet = "Change-of-details sheet"
    kinds = ("mxcode", "tid", "merchant_name")
    mx, tid, name = (code(c) for c in kinds)
    handle = F.array(*[F.struct(F.lit(c).alias("kind"), code(c).alias("key")) for c in kinds])
    # _mx and _tid of a key: the earlier ones of its record.
    earlier = lambda kind, key, m, t: F.struct(F.lit(kind).alias("kind"), key.alias("key"), m.alias("_mx"), t.alias("_tid"))
    none = F.lit("")
    long = F.array(earlier("mxcode", mx, none, none), earlier("tid", tid, mx, none), earlier("merchant_name", name, mx, tid))
    found = written(_resolved(df, wanted, kinds).where("id is not null").select("value", F.inline(long)).where("key <> ''"), "found")
    key, group = ["kind", "key"], ["kind", "key", "_mx", "_tid"]

    pairs = change_pairs("raw_data")
    old, new = (next(c for c, k in zip(pairs, CHANGE_KEYS, strict=True) if k == f"{x} MERCHANT ACCOUNT NAME") for x in ("OLD", "NEW"))
    changed = df.where(F.col("sheet_name").contains("Change")).select(handle.alias("_h"), F.explode(F.array(F.col("merchant_name"), old, new)).alias("variant"))
    changed = changed.select(F.inline("_h"), "variant", F.lit(sheet).alias("source"))
    siblings = df.select(F.lit("mxcode").alias("kind"), mx.alias("key"), F.col("merchant_name").alias("variant"), F.col("sheet_name").alias("source"))
    names = siblings.union(changed).withColumn("variant", F.trim(_text("variant"))).where("key <> '' and variant <> ''")
    names = written(perhaps_in(names, found, key).distinct(), "names")
    let_go(df.sparkSession)

    parts = names.groupBy(*key).agg(F.ceil(F.count("*") / part).alias("_n"))
    place = F.pmod(F.xxhash64("variant"), F.col("_n")).alias("_part")
    spread = max(df.sparkSession.sparkContext.defaultParallelism, -(-names.count() // NAMES))
    lists = names.join(parts, key).select(*key, place, "variant", "source").repartition(spread, *key, "_part").groupBy(*key, "_part").agg(F.collect_list(F.struct("variant", "source")).alias("_names"))

    on_sheet = names.where(F.col("source") == sheet).select(*key, "variant")
    mine, theirs = on_sheet.where("kind <> 'mxcode'"), on_sheet.where("kind <> 'merchant_name'").withColumnsRenamed({"kind": "_kind", "key": "_key"})
    before = F.array(*[F.struct(F.lit(k).alias("_kind"), F.col(c).alias("_key")) for k, c in (("mxcode", "_mx"), ("tid", "_tid"))])
    links = found.select(*group).distinct().select(*group, F.inline(before)).where("_key <> ''")
    common = theirs.groupBy("variant").count().where(F.col("count") > heavy).select("variant")
    both = mine.join(theirs.join(common, "variant", "left_anti"), "variant").join(links, [*key, "_kind", "_key"]).select(*group, "variant")
    rest = links.join(mine.join(common, "variant", "left_semi"), key).join(theirs.join(common, "variant", "left_semi"), ["_kind", "_key", "variant"], "left_semi").select(*group, "variant")
    gone = both.union(rest).join(parts, key).groupBy(*group, place).agg(F.collect_set("variant").alias("_gone"))

    many = found.groupBy(*group).agg(F.ceil(F.count("*") / part).alias("_m"))
    people = found.join(many, group).groupBy(*group, F.pmod(F.xxhash64("value"), F.col("_m")).alias("_few")).agg(F.collect_list("value").alias("_values"))
    people = people.join(parts, key).select(*group, "_values", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias("_part"))
    left = F.when(F.col("_gone").isNull(), F.col("_names")).otherwise(F.filter("_names", lambda x: ~F.array_contains("_gone", x["variant"])))
    out = people.join(gone, [*group, "_part"], "left").repartition(spread, *key, "_part").join(lists, [*key, "_part"]).select("_values", F.inline(left))
    return out.select(F.explode("_values").alias("identifier"), "variant", "source")


COMPARED = ("merchant_name", "tid", "mxcode", "phone", "email", "address", "account_name", "account_number", "bank", "state", "sheet_name")


def compare(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of identifiers (entity_a, entity_b) side by side: a row per field with both cells, and the identifiers that the two records share."""
    wanted = pairs.select(F.explode(F.array("entity_a", "entity_b")).alias("value"))
    fields = _have(df, COMPARED)
    handles = F.array_distinct(F.filter(F.array(*[code(c) for c in _have(df, RESOLVE)]), lambda x: x != ""))
    rows = df.withColumn("_handles", handles)
    found = resolve(rows, wanted, _have(df, RESOLVE), keep=["id", *fields, "_handles"])
    cells = F.array(*[F.struct(F.lit(c).alias("field"), _text(c).alias("cell")) for c in fields])
    sides = [found.select(F.col("value").alias(side), cells.alias(f"_{side}"), F.coalesce("_handles", F.array().cast("array<string>")).alias(f"_h{side}")) for side in ("entity_a", "entity_b")]
    both = pairs.distinct().join(sides[0], "entity_a").join(sides[1], "entity_b")
    shared = F.array_join(F.array_sort(F.array_intersect("_hentity_a", "_hentity_b")), ",")
    zipped = F.zip_with("_entity_a", "_entity_b", lambda a, b: F.struct(a["field"].alias("field"), a["cell"].alias("cell_a"), b["cell"].alias("cell_b")))
    return both.select("entity_a", "entity_b", shared.alias("shared"), F.inline(zipped))


def merge_steps(steps: Sequence[DataFrame], key: str = "identifier") -> DataFrame:
    """Tables of several steps as one, by identifier: of each column the first step's cell that is filled."""
    columns = list(dict.fromkeys(c for s in steps for c in s.columns if c != key))
    rows = [s.select(key, F.lit(i).alias("_step"), *[(F.col(c).cast("string") if c in s.columns else F.lit(None).cast("string")).alias(c) for c in columns]) for i, s in enumerate(steps)]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    return every.groupBy(key).agg(*[F.coalesce(F.min_by(c, F.when(filled(c), F.struct("_step", F.col(c)))), F.lit("")).alias(c) for c in columns])


def linked_counts(df: DataFrame, wanted: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """How many records share any identifier with the record of each wanted one, itself included; 0 without one.

    Records that hold a value of at most ``heavy`` records are listed. For values of more (a code of many
    terminals) records are counted by the set of such values that they hold, and those that hold any of an
    identifier's are found by inclusion and exclusion: no identifier is paired with a heavy value's records.
    """
    cells = lambda columns: F.array_distinct(F.filter(F.array(*[code(c) for c in columns]), lambda x: x != ""))
    columns = _have(df, RESOLVE)
    handles = written(_resolved(df, wanted, columns).where("id is not null").select("value", F.explode(cells(columns)).alias("key")), "handles")
    held = df.select("id", F.explode(cells(columns)).alias("key")).join(handles.select("key").distinct(), "key")
    counts = held.groupBy("key").agg((F.count("*") > heavy).alias("heavy"))
    held = held.join(counts, "key")
    many, few = F.array_sort(F.collect_set(F.when(F.col("heavy"), F.col("key")))), F.collect_set(F.when(~F.col("heavy"), F.col("key")))
    records = written(held.groupBy("id").agg(many.alias("many"), few.alias("few")), "held")
    heavies = records.select(F.explode("many").alias("key")).distinct().withColumn("heavy", F.lit(True))
    asked = written(handles.join(heavies, "key", "left").withColumn("heavy", F.coalesce("heavy", F.lit(False))).groupBy("value").agg(many.alias("own"), few.alias("light")), "asked")
    subsets = lambda t, c: t.withColumn("_m", F.explode(F.sequence(F.lit(1).cast("bigint"), (F.pow(F.lit(2), F.size(c)) - 1).cast("bigint")))).withColumn("_s", F.expr(f"filter({c}, (x, i) -> getbit(_m, i) = 1)"))
    held_by = subsets(records.where("size(many) > 0").groupBy("many").agg(F.count("*").alias("n")), "many").groupBy("_s").agg(F.sum("n").alias("n"))
    sign = F.when(F.size("_s") % 2 == 1, 1).otherwise(-1)
    by_many = subsets(asked.where("size(own) > 0").select("own").distinct(), "own").join(held_by, "_s").groupBy("own").agg(F.sum(F.col("n") * sign).alias("n_many"))
    listed = asked.select("value", "own", F.explode("light").alias("key")).join(records.select("id", "many", F.explode("few").alias("key")), "key")
    by_few = listed.where(~F.arrays_overlap("own", "many")).select("value", "id").distinct().groupBy("value").agg(F.count("*").alias("n_few"))
    out = wanted.select("value").distinct().join(asked.select("value", "own"), "value", "left").join(by_many, "own", "left").join(by_few, "value", "left")
    return out.select(F.col("value").alias("identifier"), (F.coalesce("n_many", F.lit(0)) + F.coalesce("n_few", F.lit(0))).cast("bigint").alias("n"))
