"""Requests as they come in: which are asked again in other words, and which are given up."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rollbook.functions.text import _text

OUT = "entity string, id bigint, outcome string, rephrased_by bigint"
#: What an entity waits for: requests without rows, all of one text, and their times in microseconds.
STATE = "text string, ids array<bigint>, times array<bigint>"


def outcomes(requests: DataFrame, window: int = 1200, late: str = "20 minutes") -> DataFrame:
    """A row per entity and request without rows: rephrased by the first later one about the entity with another text within the window (seconds), or abandoned.

    requests: a stream of id, ts (timestamp), text, rows, entities (array); texts are compared without case and outer
    spaces. Requests of a batch are taken in order of time. An entity's waiting requests all have one text, the
    latest, as any other text answers them; they leave once the watermark passes their window, so state is bounded by
    what an entity is asked without success in a window. Requests without entity or time take no part.
    """
    entity = F.explode(F.array_distinct(F.filter("entities", lambda e: e.isNotNull() & (e != ""))))
    each = requests.withWatermark("ts", late).where("ts is not null").select("id", "ts", F.lower(F.trim(_text("text"))).alias("text"), F.coalesce("rows", F.lit(0)).alias("rows"), entity.alias("entity"))
    span = window * 1_000_000

    def step(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, ids, times = state.get if state.exists else (None, [], [])
        ids, times, out = list(ids), list(times), []

        def leave(until: int) -> None:
            """Gives up what has waited longer than the window."""
            gone = [t + span < until for t in times]
            out.extend((key[0], i, "abandoned", None) for i, g in zip(ids, gone, strict=True) if g)
            ids[:], times[:] = [i for i, g in zip(ids, gone, strict=True) if not g], [t for t, g in zip(times, gone, strict=True) if not g]

        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values(["ts", "id"])
            for i, t, words, n in zip(rows["id"], rows["ts"].astype("datetime64[us]").astype("int64"), rows["text"], rows["rows"], strict=True):
                leave(t)
                if words != text:
                    out.extend((key[0], j, "rephrased", i) for j in ids)
                    text, ids[:], times[:] = words, [], []
                if n <= 0:
                    ids.append(int(i))
                    times.append(int(t))
        mark = state.getCurrentWatermarkMs()
        leave(mark * 1000)
        if ids:
            state.update((text, ids, times))
            state.setTimeoutTimestamp(max(min(times) + span, mark * 1000) // 1000 + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["entity", "id", "outcome", "rephrased_by"]).astype({"id": "Int64", "rephrased_by": "Int64"})

    return each.groupBy("entity").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
