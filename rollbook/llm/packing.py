"""Packing of token sequences by minimum bin slack.

Only how many pieces there are of each length matters for the packing, so the driver packs the histogram (as
many entries as a sequence has tokens, however large the corpus). For each bin the longest piece left is
taken, and a subset-sum dynamic programme over bitsets finds the fullest combination of available lengths that
fits beside it. The combination is repeated while the stock lasts, then removed from it.

Each piece then finds its place by its rank among the pieces of its length: a task counts its own, and a small
table of counts by task and length turns that into a rank over all. No length's pieces meet in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollbook.sources.shared import written
from rollbook.llm.tokens import default_vocabulary, encode
from rollbook.llm.words import slices

CAPACITY = 1024
END_ID = 2


def fullest(stock: np.ndarray, room: int) -> dict[int, int]:
    """How many of each length (stock[length] there are) fill the room best. Longer pieces are tried first."""
    sums, steps = 1, []
    for length in np.flatnonzero(stock[: room + 1])[::-1].tolist():
        if length:
            left, size, before = min(int(stock[length]), room // length), 1, sums
            while left:
                take = min(size, left)
                sums |= sums << (length * take)
                left, size = left - take, size * 2
            sums &= (1 << (room + 1)) - 1
            steps.append((length, before))
            if sums >> room & 1:
                break
    at, chosen = sums.bit_length() - 1, {}
    for length, before in reversed(steps):
        n = 0
        while not before >> at & 1:
            at, n = at - length, n + 1
        if n:
            chosen[length] = n
    return chosen


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(how many bins, the lengths in each) until the stock is used up."""
    stock = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        stock[length] = n
    bins = []
    while stock.any():
        longest = int(np.flatnonzero(stock)[-1])
        stock[longest] -= 1
        chosen = fullest(stock, capacity - longest)
        stock[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(int(stock[length]) // n for length, n in chosen.items())
        for length, n in chosen.items():
            stock[length] -= n * times
        bins.append((times, [length for length in sorted(chosen, reverse=True) for _ in range(chosen[length])]))
    return bins


class Places:
    """Sequence and offset of the piece of any length and rank."""

    def __init__(self, bins: list[tuple[int, list[int]]]) -> None:
        runs: dict[int, list[tuple[int, int, int, int]]] = {}
        used: dict[int, int] = {}
        base = 0
        for times, lengths in bins:
            at = 0
            for length in dict.fromkeys(lengths):
                n = lengths.count(length)
                runs.setdefault(length, []).append((used.get(length, 0), n, base, at))
                used[length] = used.get(length, 0) + n * times
                at += n * length
            base += times
        self.runs = {length: np.array(r, np.int64).T for length, r in runs.items()}

    def __call__(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for length in np.unique(lengths).tolist():
            mine = np.flatnonzero(lengths == length)
            start, each, base, at = self.runs[length]
            i = np.searchsorted(start, ranks[mine], "right") - 1
            k = ranks[mine] - start[i]
            sequence[mine], offset[mine] = base[i] + k // each[i], at[i] + k % each[i] * length
        return sequence, offset


_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task bigint, local bigint"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """The pieces of every text with crc32 of their ids, the task that cut them and their rank by length in it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        task, seen = context.partitionId() if context else 0, np.zeros(capacity + 1, np.int64)
        for batch in slices(batches):
            ids, first = encode(batch["text"], path)
            ids = np.insert(ids.astype("<u4"), first[1:], END_ID)
            size = np.diff(first) + 1
            ends = np.cumsum(size)
            n = -(-size // capacity)
            of = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            head = (size - capacity * (n - 1))[of]
            start = np.where(piece > 0, head + capacity * (piece - 1), 0)
            length = np.where(piece > 0, capacity, head)
            at = (ends - size)[of] + start
            raw = [ids[a:b] for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            sorted_lengths = length[order]
            local = np.empty(len(length), np.int64)
            local[order] = np.arange(len(length)) - np.searchsorted(sorted_lengths, sorted_lengths) + seen[sorted_lengths]
            seen += np.bincount(length, minlength=capacity + 1)
            arrays = [batch["doc_id"].cast(pa.int64()).take(pa.array(of)), pa.array(piece.astype(np.int32)), *map(pa.array, (start, length, np.array([zlib.crc32(x.tobytes()) for x in raw], np.int64), np.full(len(of), task), local))]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(raw, pa.list_(pa.int32()))] * keep_ids, names=[x.split()[0] for x in _PIECES.split(", ")] + ["ids"] * keep_ids)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, _PIECES + ", ids array<int>" * keep_ids)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Every text's tokens and an end id, packed into few sequences of at most ``capacity`` tokens.

    docs needs doc_id and text; other columns are ignored. A text that is longer than a sequence is cut into
    full pieces, the first of which holds the remainder. Per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset, and with keep_ids the ids. A null text is empty: one piece, the end id alone. Null and
    repeated ids are kept, each row packed by itself; very long texts are cut whole. Combinations that fill a bin
    alike tie to the longer pieces, pieces of one length to the order of tasks and rows. An empty table gives no rows.
    """
    cut = written(pieces(docs, path or default_vocabulary("byte_bpe_50k.json"), capacity, keep_ids), "pieces")
    counts = written(cut.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    places = Places(plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity))
    before = counts.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    # Counts grow with the tasks, so they are never broadcast; a task's pieces of a length are bounded by the task.
    ranked = cut.join(before.hint("merge"), ["task", "length"]).withColumn("rank", F.col("local") + F.col("before")).drop("task", "local", "before")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sequence, offset = places(batch["length"].to_numpy(), batch["rank"].to_numpy())
                yield pa.RecordBatch.from_arrays([batch[c] for c in columns] + [pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    types = dict(ranked.dtypes)
    return ranked.mapInArrow(place, ", ".join([*(f"{c} {types[c]}" for c in columns), "sequence_id bigint, offset bigint"]))
