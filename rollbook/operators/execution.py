"""Running plans: the field steps of all requests by one look at the registry, then steps on what those produced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.functions.text import _text
from rollbook.operators import reports
from rollbook.operators.planning import step_inputs

#: The column that each field step answers with; steps that answer with a static account.
FIELDS = {
    "fetch_tid": "tid", "resolve_mxcode": "mxcode", "fetch_email": "email", "fetch_phone": "phone", "fetch_address": "address", "fetch_account_name": "account_name", "fetch_account_number": "account_number", "fetch_contact": "contact_name",
    "fetch_state": "state", "fetch_source": "sheet_name",
}
STATIC = "fetch_static_account"


def field_answers(df: DataFrame, inputs: DataFrame, key: str) -> DataFrame:
    """(key, step, identifier, answer, status, chained): what field steps say of each value they run on (key, step, kind, value, chained).

    The values of all requests are looked up once, together, whatever the steps; a value that is in a third of the
    requests is looked up once too. status is found, no_value or not_found. Steps of other kinds are left out.
    """
    rows = inputs.where(F.col("step").isin(*FIELDS)).select(key, "step", F.trim(_text("value")).alias("identifier"), "chained").where("identifier <> ''").distinct()
    held = reports.profiles(df, rows.select(F.col("identifier").alias("value")).distinct()).withColumnRenamed("status", "_status")
    cells = {s: F.col(f"_held.{c}") for s, c in FIELDS.items() if c in held.columns}
    packed = held.select("identifier", F.struct(*held.columns).alias("_held"))
    answer = F.lit("")
    for step, cell in cells.items():
        answer = F.when(F.col("step") == step, cell).otherwise(answer)
    out = rows.join(packed, "identifier", "left").withColumn("answer", F.trim(_text(answer)))
    status = F.when(F.coalesce("_held._status", F.lit("not_found")) == "not_found", "not_found").when(F.col("answer") == "", "no_value").otherwise("found")
    return out.select(key, "step", "identifier", "answer", status.alias("status"), "chained")


def run(df: DataFrame, steps: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """(key, step, identifier, answer, status, chained) of all plans: field steps on the identifiers given (key, kind, value), static accounts on those and on the codes that a step before them resolved.

    A code is handed on only from its own request. Names are no identifiers: search them first and give what they are
    found by. Requests without identifiers, and steps of other kinds, which are reports of their own, have no rows.
    """
    none = given.select(key, F.lit("").alias("step"), "kind", "value").limit(0)
    first = field_answers(df, step_inputs(steps, key, given, none), key)
    made = first.where("answer <> ''").select(key, "step", F.element_at(F.create_map(*[F.lit(x) for kv in FIELDS.items() for x in kv]), F.col("step")).alias("kind"), F.col("answer").alias("value"))
    second = step_inputs(steps.where(F.col("step") == STATIC), key, given, made).select(key, "step", "kind", F.trim(_text("value")).alias("identifier"), "chained")
    coded = second.where("kind = 'mxcode'").groupBy(key, "step", "identifier").agg(F.min("chained").alias("chained"))
    other = second.where("kind <> 'mxcode'").groupBy(key, "step", "identifier").agg(F.min("chained").alias("chained"))
    values = lambda rows: rows.select(F.col("identifier").alias("value")).distinct()
    sides = [(coded, reports.static_of_codes(df, values(coded))), (other, reports.static_accounts(df, values(other)))]
    for rows, found in sides:
        answers = found.select("identifier", F.col("static_acc_no").alias("answer"), "status").distinct()
        first = first.unionByName(rows.join(answers, "identifier").select(key, "step", "identifier", "answer", "status", "chained"))
    return first
