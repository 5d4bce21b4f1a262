"""Audit trails, ledgers of builds and governed assets, read off their event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.identifiers import mask_field

#: Fields that are kept enciphered, and masked for those who may only look.
SENSITIVE = ("bvn", "account_number", "static_acc_no", "phone", "email", "alias")

def recent(log: DataFrame, limit: int = 100, action: str | None = None, actor: str | None = None) -> DataFrame:
    """The newest entries (ts, id, action, actor), of one action or actor if given."""
    rows = log.where(F.col("action") == action) if action else log
    rows = rows.where(F.col("actor") == actor) if actor else rows
    return rows.orderBy(F.desc("ts"), F.desc("id")).limit(limit)


def audit_stats(log: DataFrame, now: Column) -> DataFrame:
    """Per action: how many entries, how many in the last 24 hours, and the newest time."""
    day = F.unix_micros(now) - F.unix_micros(F.col("ts").cast("timestamp")) <= 86_400_000_000
    return log.groupBy("action").agg(F.count("*").alias("n"), F.count_if(day).alias("last_day"), F.max("ts").alias("newest"))


def ledger_stats(runs: DataFrame) -> DataFrame:
    """(runs, ok, failed, last_run_at, max_rows) of all builds (status, finished_at, row_count)."""
    return runs.agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "failed").alias("failed"), F.max("finished_at").alias("last_run_at"), F.coalesce(F.max("row_count"), F.lit(0)).cast("bigint").alias("max_rows"))


def asset_states(events: DataFrame) -> DataFrame:
    """(asset, version, state, at): where each version of an asset is after its events (asset, version, action, ts).

    proposed, then approved or rejected by whichever comes first, then, only if approved, applied. Events out of that
    order change nothing: a step counts from the time of the one before it. Least times by combining aggregates.
    """
    key = ["asset", "version"]
    first = events.where("action = 'propose'").groupBy(*key).agg(F.min("ts").alias("_p"))
    judged = events.where(F.col("action").isin("approve", "reject")).join(first, key).where("ts >= _p")
    judged = judged.groupBy(*key).agg(F.min(F.struct("ts", "action")).alias("_j"))
    done = events.where("action = 'apply'").join(judged.where("_j.action = 'approve'"), key).where(F.col("ts") >= F.col("_j.ts")).groupBy(*key).agg(F.min("ts").alias("_d"))
    rows = first.join(judged, key, "left").join(done, key, "left")
    state = F.when(F.col("_d").isNotNull(), "applied").when(F.col("_j.action") == "approve", "approved").when(F.col("_j.action") == "reject", "rejected").otherwise("proposed")
    return rows.select(*key, state.alias("state"), F.coalesce("_d", "_j.ts", "_p").alias("at"))


def in_force(states: DataFrame) -> DataFrame:
    """Of each asset the applied version that was applied last."""
    return states.where("state = 'applied'").groupBy("asset").agg(F.max_by("version", F.struct("at", "version")).alias("version"))


def freshness(current: DataFrame, last_good: DataFrame) -> DataFrame:
    """(path, status): sources (path, mtime, size) that are new, changed or removed against the snapshot of the last good build."""
    a = current.select("path", F.struct("mtime", "size").alias("_now"))
    b = last_good.select("path", F.struct("mtime", "size").alias("_then"))
    status = F.when(F.col("_then").isNull(), "new").when(F.col("_now").isNull(), "removed").when(F.col("_now") != F.col("_then"), "changed")
    return a.join(b, "path", "full").select("path", status.alias("status")).where("status is not null")


def enciphered(df: DataFrame, key: Column, fields: tuple[str, ...] = SENSITIVE) -> DataFrame:
    """df with its sensitive fields under AES-GCM in base64; null and empty cells stay. The key (16, 24 or 32 bytes) comes from the caller and is never stored. Equal cells differ afterwards, so they no longer join."""
    held = [f for f in fields if f in df.columns]
    return df.withColumns({f: F.when(F.col(f) != "", F.base64(F.aes_encrypt(F.col(f), key, F.lit("GCM")))).otherwise(F.col(f)) for f in held})


def deciphered(df: DataFrame, key: Column, fields: tuple[str, ...] = SENSITIVE) -> DataFrame:
    """What ``enciphered`` was given. A cell under another key or tampered with is null."""
    held = [f for f in fields if f in df.columns]
    return df.withColumns({f: F.when(F.col(f) != "", F.try_aes_decrypt(F.unbase64(F.col(f)), key, F.lit("GCM")).cast("string")).otherwise(F.col(f)) for f in held})


def seen_by(df: DataFrame, role: str, fields: tuple[str, ...] = SENSITIVE) -> DataFrame:
    """df as a role sees it: viewers see sensitive fields masked, others all."""
    if role != "viewer":
        return df
    return df.withColumns({f: mask_field(f, F.col(f)) for f in fields if f in df.columns})
