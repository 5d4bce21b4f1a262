"""From requests as typed to plans: ranked intents, what is excluded, clauses, steps in order, filters, context.

Everything is decided within a request's own row; only clauses and sessions need an exchange, by request and by
session. Texts may be null or empty: such a request has the one intent ``resolve`` and no steps.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions.identifiers import shape_kinds
from rollbook.functions.text import _text
from rollbook.operators.entities import before
from rollbook.operators.requests import INSTRUCTIONS, identifier_tokens

#: A step's verb and what it produces, by intent.
STEPS = {
    "static_account": ("fetch_static_account", ("static_acc_no", "beneficiary", "payable", "alias")), "tid": ("fetch_tid", ("tid",)), "mxcode": ("resolve_mxcode", ("mxcode",)), "email": ("fetch_email", ("email",)),
    "phone": ("fetch_phone", ("phone",)), "address": ("fetch_address", ("address",)), "bank": ("fetch_bank", ("bank",)), "account_name": ("fetch_account_name", ("account_name",)),
    "account_number": ("fetch_account_number", ("account_number",)), "payable": ("fetch_payable", ("payable_code",)), "alias": ("fetch_alias", ("alias",)), "contact": ("fetch_contact", ("contact_name",)),
    "onboarded": ("fetch_onboarded", ("onboarded_date",)), "state": ("fetch_state", ("state",)), "source": ("fetch_source", ("sheet_name",)), "beneficiary": ("fetch_beneficiary", ("beneficiary",)),
    "related": ("find_related", ("linked records",)), "formerly": ("find_formerly", ("name history",)), "compare": ("compare_merchants", ("comparison",)), "coverage": ("coverage_check", ("missing coverage",)),
    "top": ("rank_top", ("rankings",)), "verify": ("verify", ("found/not-found",)), "profile": ("build_profile", ("profile", "contacts", "addresses")), "change_details": ("fetch_change_details", ("old_account", "new_account")),
    "segment": ("collect_segment", ("requested fields",)), "count": ("count_records", ("count",)), "duplicates": ("find_duplicates", ("clusters",)), "summary": ("summarize", ("stats",)),
    "settlement_account": ("fetch_settlement_account", ("dealer_account_no",)), "settlement_bank": ("fetch_settlement_bank", ("dealer_bank_name",)), "merchant_id": ("fetch_merchant_id", ("merchant_id",)),
    "dealer_name": ("fetch_dealer_name", ("dealer_name",)),
}
#: Intents that need another's result, and the identifiers that spare it.
REQUIRES = {"static_account": ("mxcode",)}
SPARED = {("static_account", "mxcode"): ("tid", "mxcode", "static", "account")}
#: Intents that make others of a request redundant: always, unless those score higher, or if those matched weakly only.
SUBSUMED = (
    (("static_account",), ("mxcode", "payable", "alias", "beneficiary"), "always"),
    (("static_account",), ("account_name", "account_number"), "unless higher"),
    (("change_details",), ("profile",), "always"),
    (("top",), ("count", "bank", "account_name", "account_number", "payable", "alias", "contact", "onboarded", "state", "source", "beneficiary", "email", "phone", "mxcode", "address"), "always"),
    (("coverage",), ("email", "phone", "address"), "always"),
    (("email", "phone", "mxcode", "address", "static_account", "change_details"), ("count",), "unless higher"),
    (("static_account",), ("change_details",), "if weak"),
)
WEAK = (r"\baccount details\b", r"\bold account\b", r"\bnew account\b", r"\bold bank\b", r"\bnew bank\b", r"\bold address\b", r"\bnew address\b")
#: What excludes the intent named after it, within so many characters; the last two only the next word's.
NEGATIONS = ("but not", "except for", "except", "excluding", "exclude", "other than", "not the", "don't want", "do not want", "no need for", "skip", "leave out", "omit")
NEGATED_NOUNS = ("not a", "not an")
REACH = 80
#: Follow-up prompts, in the order they are proposed.
CHAINABLE = {
    "tid": "get the TIDs for these", "mxcode": "get the MX codes for these", "email": "get the emails for these", "phone": "get the phone numbers for these", "address": "get the addresses for these", "bank": "get the banks for these",
    "contact": "get the contact persons for these", "onboarded": "get the onboarded dates for these", "state": "get the states for these", "source": "get the source files for these", "payable": "get the payable codes for these",
    "alias": "get the aliases for these", "profile": "get the full profiles for these", "static_account": "get the static accounts and beneficiaries for these", "verify": "check if these are in the registry",
    "settlement_account": "get the settlement accounts for these", "settlement_bank": "get the settlement banks for these", "merchant_id": "get the merchant IDs for these", "dealer_name": "get the dealer names for these",
}
#: Wordings of filters on presence and absence, of limits, of references and between two sides.
PRESENT = {
    "email": (r"\bwith\s+(?:an\s+)?e[- ]?mail\b", r"\bhas\s+(?:an\s+)?e[- ]?mail\b", r"\be[- ]?mails?\s+(?:only|present)\b", r"\bthat\s+have\s+e[- ]?mail\b"),
    "phone": (r"\bwith\s+(?:a\s+)?phone\b", r"\bhas\s+(?:a\s+)?phone\b", r"\bwith\s+phone\s+number\b"), "address": (r"\bwith\s+(?:an\s+)?address\b", r"\bhas\s+(?:an\s+)?address\b"),
}
ABSENT = {"email": r"e[- ]?mails?", "phone": r"phone numbers?|phones?|telephones?|mobile numbers?", "address": r"addresses|address|locations?"}
LACKING = r"\b(?:without|with no|has no|have no|missing|lacking|no)\s+(?:an\s+|a\s+)?"
MOST_ROWS = 5000
REFERENCE = r"(?i)\b(?:the|this|that)\s+above(?:[- ](?:mentioned|named))?\b|\babove[- ](?:mentioned|named)\b|\b(?:per|as|see)\s+above\b|\b(?:merchant|merchants)\s+above\b|\bthe\s+(?:previous|prior|last)\b|\b(?:previous|prior|earlier|last)\s+(?:request|query|search|batch|list|merchant|merchants|one)\b"
CLAUSE = r"(?i)\b(?:and|then|also|plus)\b|[,;]"
SIDES = r"(?i)\b(?:vs\.?|versus|against|compared to|with|and|between)\b"

#: Intents that a request may be asked back about, vague ones among them, and the gap and confidence within which it is.
OFFERED = ("profile", "static_account", "change_details", "email", "phone", "address", "mxcode")
VAGUE = ("profile", "change_details")
GAP, SURE = 4.0, 60

_NONE = "array<struct<minus:double,place:int,intent:string,score:double,matched:array<string>>>"


def _lower(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(_text(c)), r"\s+", " "))


def _quoted(words: Iterable[str]) -> str:
    """Words as one pattern, the longest first; a backslash before each character that patterns know."""
    return "|".join("".join("\\" + ch if not ch.isalnum() and ch not in " _'" else ch for ch in w) for w in sorted(words, key=lambda w: (-len(w), w)))


def negated(c: Column | str, keywords: Mapping[str, tuple[str, ...]]) -> Column:
    """The intents that a text excludes: behind each negation the one whose keyword stands nearest, sorted.

    Where a marker repeats, what stands between counts for the first and what follows for the second; as a keyword
    beyond the second is in reach of it too, the set is that of all whole windows.
    """
    low = _lower(c)

    def nearest(window: Column) -> Column:
        found = F.array(*[F.struct(F.regexp_instr(window, F.lit(rf"\b(?:{_quoted(words)})s?\b")).alias("at"), F.lit(i).alias("i"), F.lit(name).alias("intent")) for i, (name, words) in enumerate(keywords.items())])
        return F.array_min(F.filter(found, lambda x: x["at"] > 0))["intent"]

    def noun(window: Column) -> Column:
        head = F.regexp_extract(window, r"^\s*(\S+)", 1)
        hits = F.array(*[F.when(head.rlike(_quoted(words)), F.lit(name)) for name, words in keywords.items()])
        return F.get(F.filter(hits, lambda x: x.isNotNull()), F.lit(0))

    windows = lambda marker: F.transform(F.slice(F.split(low, rf"\b{marker}\b"), 2, 1 << 20), lambda w: F.substr(w, F.lit(1), F.lit(REACH)))
    every = [F.transform(windows(m), nearest) for m in NEGATIONS] + [F.transform(windows(m), noun) for m in NEGATED_NOUNS]
    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.array(*every)), lambda x: x.isNotNull())))


def _apply(rule: tuple, ranked: Column) -> Column:
    """The ranked intents less those that a rule makes redundant."""
    winners, losers, how = rule
    best = F.array_max(F.transform(F.filter(ranked, lambda x: x["intent"].isin(*winners)), lambda x: x["score"]))

    def goes(x: Column) -> Column:
        if how == "unless higher":
            return F.coalesce(best >= x["score"], F.lit(False))
        if how == "if weak":
            return best.isNotNull() & F.forall(x["matched"], lambda m: m.isin(*WEAK))
        return best.isNotNull()

    return F.filter(ranked, lambda x: ~(x["intent"].isin(*losers) & goes(x)))


def ranked(requests: DataFrame, text: str, patterns: Mapping[str, Mapping[str, float]], keywords: Mapping[str, tuple[str, ...]] | None = None, most: int = 2) -> DataFrame:
    """requests with ``intents``: (intent, score, matched patterns), best first, then in the order of ``patterns``; excluded and redundant ones left out, resolve if none is left.

    A pattern counts ``most`` times at most. Each rule of SUBSUMED sees what the rules before it left.
    """
    low = _lower(text)
    out = F.lit(None).cast("array<string>") if keywords is None else negated(text, keywords)
    cells = []
    for place, (intent, words) in enumerate(patterns.items()):
        counts = {p: F.regexp_count(low, F.lit(p)) for p in words}
        score = sum((F.least(counts[p], F.lit(most)) * F.lit(float(w)) for p, w in words.items()), F.lit(0.0)).cast("double")
        matched = F.filter(F.array(*[F.when(counts[p] > 0, F.lit(p)) for p in words]), lambda m: m.isNotNull())
        cells.append(F.struct((-score).alias("minus"), F.lit(place).alias("place"), F.lit(intent).alias("intent"), score.alias("score"), matched.alias("matched")))
    every = F.array(*cells) if cells else F.array().cast(_NONE)
    rows = requests.withColumn("_out", out).withColumn("_r", F.array_sort(F.filter(every, lambda x: (x["score"] > 0) & ~F.coalesce(F.array_contains("_out", x["intent"]), F.lit(False)))))
    for rule in SUBSUMED:
        rows = rows.withColumn("_r", _apply(rule, F.col("_r")))
    kept = F.transform("_r", lambda x: F.struct(x["intent"].alias("intent"), x["score"].alias("score"), x["matched"].alias("matched")))
    none = F.array(F.struct(F.lit("resolve").alias("intent"), F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("matched")))
    return rows.withColumn("intents", F.when(F.size("_r") > 0, kept).otherwise(none)).drop("_r", "_out")


def plan(rows: DataFrame, kinds: Column, named: Column, requires: Mapping[str, tuple[str, ...]] = REQUIRES) -> DataFrame:
    """(columns of rows but intents, place, intent, step, requires, produces, synthesized): the steps of each request in an order that serves what they require.

    ``kinds`` are the kinds of identifiers in a request, ``named`` whether it names a record. A required step that is
    not asked for is put before the first that needs it, unless the identifiers spare it (SPARED) or there is nothing
    to feed it. Steps keep the order of the intents but for those that wait for a later one, which follow all others
    of their turn. ``requires`` must have no cycle.
    """
    names = F.filter(F.transform("intents", lambda x: x["intent"]), lambda i: i != "resolve")
    rows = rows.withColumn("_names", names).withColumn("_kinds", F.coalesce(kinds, F.array().cast("array<string>"))).withColumn("_fed", (F.size("_kinds") > 0) | F.coalesce(named, F.lit(False)))
    at = lambda i: F.array_position("_names", F.lit(i)).cast("int")
    turn: dict[str, Column] = {}
    for intent in TopologicalSorter({k: list(v) for k, v in requires.items()}).static_order():
        waits = [F.when(at(r) > 0, turn[r] + (at(r) > at(intent)).cast("int")).otherwise(0) for r in requires.get(intent, ())]
        turn[intent] = F.greatest(F.lit(0), *waits) if waits else F.lit(0)
    lookup = lambda table, i: F.create_map(*[x for k, v in table.items() for x in (F.lit(k), v)])[i] if table else F.lit(None)
    verb = {k: F.lit(v[0]) for k, v in STEPS.items()}
    verbs = lambda i: F.coalesce(lookup(verb, i), F.concat(F.lit("run_"), i))
    makes = {k: F.array(*map(F.lit, v[1])) for k, v in STEPS.items()}
    empty = F.array().cast("array<string>")
    needs = {k: F.array(*[F.lit(STEPS.get(r, (f"run_{r}",))[0]) for r in v]) for k, v in requires.items()}
    waiting = {k: turn[k] for k in requires}

    def step(turn_: Column, place: Column, rank: int, intent: Column, required: Column, made: bool) -> Column:
        return F.struct(
            turn_.cast("int").alias("turn"), place.cast("int").alias("at"), F.lit(rank).alias("rank"), intent.alias("intent"), verbs(intent).alias("step"), required.cast("array<string>").alias("requires"),
            F.coalesce(lookup(makes, intent), empty).alias("produces"), F.lit(made).alias("synthesized"),
        )

    asked = F.transform("_names", lambda i: step(F.coalesce(lookup(waiting, i), F.lit(0)), F.array_position("_names", i), 1, i, F.coalesce(lookup(needs, i), empty), False))
    added = []
    for r in dict.fromkeys(r for v in requires.values() for r in v):
        first = F.array_min(F.filter(F.array(*[F.when((at(i) > 0) & ~F.arrays_overlap("_kinds", F.array(*map(F.lit, SPARED.get((i, r), ("",))))), F.struct(waiting[i].alias("turn"), at(i).alias("at"))) for i, v in requires.items() if r in v]), lambda x: x.isNotNull()))
        added.append(F.when((at(r) == 0) & F.col("_fed") & first.isNotNull(), step(first["turn"], first["at"], 0, F.lit(r), empty, True)))
    steps = F.array_sort(F.concat(asked, F.filter(F.array(*added), lambda x: x.isNotNull()))) if added else F.array_sort(asked)
    keep = [c for c in rows.columns if c not in ("intents", "_names", "_kinds", "_fed")]
    return rows.select(*keep, F.posexplode(steps).alias("place", "_s")).select(*keep, (F.col("place") + 1).alias("place"), *[F.col(f"_s.{c}").alias(c) for c in ("intent", "step", "requires", "produces", "synthesized")])


def step_inputs(steps: DataFrame, key: str, given: DataFrame, produced: DataFrame) -> DataFrame:
    """(key, step, kind, value, chained): what each step of a plan runs on, its request's identifiers (key, kind, value) and what the steps it requires produced (key, step, kind, value).

    Values are compared without case; one that is given is not chained.
    """
    own = steps.select(key, "step").join(given.select(key, "kind", "value"), key).withColumn("chained", F.lit(False))
    needed = steps.select(key, "step", F.explode("requires").alias("_r"))
    fed = needed.join(produced.select(key, F.col("step").alias("_r"), "kind", "value"), [key, "_r"]).drop("_r").withColumn("chained", F.lit(True))
    rows = own.unionByName(fed).where("value is not null and value <> ''")
    best = F.min(F.struct("chained", "value"))
    return rows.groupBy(key, "step", "kind", F.upper("value").alias("_v")).agg(best.alias("_b")).select(key, "step", "kind", F.col("_b.value").alias("value"), F.col("_b.chained").alias("chained"))


def next_steps(rows: DataFrame, given: Column, most: int = 3) -> DataFrame:
    """(columns of rows but intents, place, intent, prompt): the first intents of CHAINABLE that were not asked for, with a prompt over the values given (an array); none without values."""
    held = F.array_distinct(F.filter(given, lambda v: v.isNotNull() & (v != "")))
    cells = F.array(*[F.when(~F.exists("intents", lambda x: x["intent"] == i), F.struct(F.lit(i).alias("intent"), F.lit(p).alias("ask"))) for i, p in CHAINABLE.items()])  # noqa: B023
    open_ = F.slice(F.filter(cells, lambda x: x.isNotNull()), 1, most)
    keep = [c for c in rows.columns if c != "intents"]
    out = rows.withColumn("_held", held).where(F.size("_held") > 0).select(*keep, "_held", F.posexplode(open_).alias("place", "_s"))
    return out.select(*keep, (F.col("place") + 1).alias("place"), F.col("_s.intent").alias("intent"), F.concat(F.array_join("_held", "\n"), F.lit("\n"), F.col("_s.ask")).alias("prompt"))


def options(low: Column, gap: float = GAP, sure: int = SURE) -> Column:
    """The intents that a request is asked back about, from its ranked ``intents`` and its text in lower case; none if it is plain.

    Asked is where the two best race: no more than ``gap`` apart and the best's confidence (12 to the point, 100 at
    most) below ``sure``; or where the only one is vague and as unsure. A best intent that is not vague and was matched
    is plain unless the text speaks of details. The three best race, then come the offers that scored, and with words
    for accounts the three kinds of account report. Fewer than two options are none.
    """
    scored = F.filter("intents", lambda x: x["intent"] != "resolve")
    names = F.transform(scored, lambda x: x["intent"])
    top, second = F.get(scored, F.lit(0)), F.get(scored, F.lit(1))
    vague = top["intent"].isin(*VAGUE)
    unsure = F.least(F.lit(100), F.floor(top["score"] * 12)) < sure
    plain = ~vague & ~low.rlike(r"\b(details?|info(?:rmation)?)\b") & (F.size(top["matched"]) > 0)
    race = (F.size(scored) >= 2) & (top["score"] - second["score"] <= gap) & unsure
    lone = (F.size(scored) == 1) & vague & unsure
    offered = F.filter(F.array(*map(F.lit, OFFERED)), lambda i: F.array_contains(names, i))
    trio = F.when(low.rlike(r"\b(account|acct|bank)\b"), F.array(*map(F.lit, OFFERED[:3]))).otherwise(F.array().cast("array<string>"))
    every = F.filter(F.array_distinct(F.concat(F.slice(names, 1, 3), offered, trio)), lambda i: i.isin(*OFFERED))
    asks = F.coalesce((race | lone) & ~plain, F.lit(False)) & (F.size(every) >= 2)
    return F.when(asks, every).otherwise(F.array().cast("array<string>"))


def clauses(c: Column | str) -> Column:
    """A text's clauses: what stands between conjunctions, commas and semicolons."""
    return F.filter(F.transform(F.split(_text(c), CLAUSE), lambda p: F.trim(p)), lambda p: p != "")


def _tokens(c: Column | str) -> Column:
    """The identifiers in a text, in capitals, each once."""
    return F.array_distinct(F.transform(F.filter(identifier_tokens(c), lambda w: F.size(shape_kinds(w)) > 0), lambda w: F.upper(w)))


def scopes(requests: DataFrame, key: str, text: str, patterns: Mapping[str, Mapping[str, float]], keywords: Mapping[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(key, intent, token, scoped): the identifiers that each intent of a request runs on.

    In a request of two identifiers or more each clause's go to the clause's best intent, and those of a clause with
    none to the intent before. Only if all identifiers find an intent so (scoped); else all go to all intents of the
    request. ``key`` names a request; a request's clauses meet in one task, requests are dealt by their key.
    """
    base = requests.select(key, F.col(text).alias("_text"), _tokens(text).alias("_all"))
    parts = base.select(key, "_all", F.posexplode(clauses("_text")).alias("_at", "_clause")).withColumn("_own", _tokens("_clause")).where(F.size("_own") > 0)
    best = F.get("intents", F.lit(0))["intent"]
    parts = ranked(parts, "_clause", patterns, keywords).withColumn("_i", F.when(best != "resolve", best)).drop("intents")
    parts = parts.withColumn("_i", F.last("_i", ignorenulls=True).over(Window.partitionBy(key).orderBy("_at"))).where("_i is not null")
    rows = parts.groupBy(key).agg(F.flatten(F.collect_set("_own")).alias("_found"), F.collect_set(F.struct(F.col("_i").alias("intent"), F.col("_own").alias("own"))).alias("_by"))
    held = ranked(base, "_text", patterns, keywords).join(rows, key, "left")
    fits = F.coalesce((F.size("_all") >= 2) & (F.size(F.array_except("_all", "_found")) == 0), F.lit(False))
    each = F.when(fits, F.col("_by")).otherwise(F.transform("intents", lambda x: F.struct(x["intent"].alias("intent"), F.col("_all").alias("own"))))
    return held.select(key, fits.alias("scoped"), F.inline(each)).select(key, "intent", F.explode("own").alias("token"), "scoped").distinct()


def parameters(c: Column | str, states: Mapping[str, tuple[str, ...]] | None = None, safe: tuple[str, ...] = ()) -> list[Column]:
    """Columns state, has, missing and most_rows of a request: the first state it names (by any spelling of four letters or more, or a ``safe`` one; else empty), fields to be there and to be empty, and a limit."""
    low = _lower(c)
    state = F.lit("")
    for name, spellings in reversed((states or {}).items()):
        known = [s.lower() for s in spellings if len(s) >= 4 or s in safe]
        state = F.when(low.rlike(rf"\b(?:{_quoted(known)})\b"), name).otherwise(state) if known else state
    some = "|".join(ABSENT.values())
    lacks = F.array(*[F.when(low.rlike(rf"{LACKING}(?:(?:{some})\s+or\s+(?:an\s+|a\s+)?)?(?:{p})\b"), F.lit(f)) for f, p in ABSENT.items()])
    has = F.array(*[F.when(low.rlike("|".join(p)), F.lit(f)) for f, p in PRESENT.items()])
    first = F.regexp_extract(low, r"\b(?:top|first|last)\s+(\d{1,4})\b", 1)
    second = F.regexp_extract(low, r"\b(\d{1,4})\s+(?:records?|results?|rows?|merchants?|entries)\b", 1)
    limit = F.least(F.when(first != "", first).when(second != "", second).cast("int"), F.lit(MOST_ROWS))
    given = lambda a: F.filter(a, lambda x: x.isNotNull())
    return [state.alias("state"), given(has).alias("has"), given(lacks).alias("missing"), F.when((first != "") | (second != ""), limit).alias("most_rows")]


def compared_pair(c: Column | str, stop: tuple[str, ...] = (*INSTRUCTIONS, "compare", "me", "the", "of", "for")) -> Column:
    """The two sides of a request to compare, in capitals, without identifiers and stop words; fewer if no more are left."""
    bare = F.array_join(F.filter(F.split(_text(c), r"\s+"), lambda w: F.size(F.filter(identifier_tokens(w), lambda t: F.size(shape_kinds(t)) > 0)) == 0), " ")
    words = lambda p: F.filter(F.split(F.upper(p), "[^A-Z0-9]+"), lambda w: (F.length(w) >= 2) & ~w.isin(*[s.upper() for s in stop]))
    sides = F.transform(F.split(bare, SIDES), lambda p: F.array_join(words(p), " "))
    return F.slice(F.array_distinct(F.filter(sides, lambda s: s != "")), 1, 2)


def refers(c: Column | str) -> Column:
    """Whether a request speaks of an earlier one's records."""
    return _text(c).rlike(REFERENCE)


def with_context(requests: DataFrame, session: str, at: str, order: str, entities: str, text: str, stretch: int = 3600) -> DataFrame:
    """requests with ``inherited``: whether entities (an array) were taken over from the session's last request that had any, which those do that have none and refer back.

    A session that holds a third of all requests is spread over its stretches (see ``entities.before``). Requests
    without a time come last; without a session they inherit nothing.
    """
    own = F.when(F.size(F.coalesce(entities, F.array().cast("array<string>"))) > 0, F.col(entities))
    rows = before(requests, session, at, order, F.when(F.col(session).isNotNull(), own), "_old", stretch)
    takes = own.isNull() & refers(text) & F.col("_old").isNotNull()
    return rows.withColumn("inherited", F.coalesce(takes, F.lit(False))).withColumn(entities, F.when(F.col("inherited"), F.col("_old")).otherwise(F.col(entities))).select(*requests.columns, "inherited")
