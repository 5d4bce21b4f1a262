"""Exact substring deduplication on words, anchored at a difference cover.

A difference cover of period p is a set D such that for any two positions i and j some shift d < p puts both
i + d and j + d at a position whose remainder is in D. Two equal runs of L words at i and j therefore share an
anchor: an equal window of L - p + 1 words that starts at a cover position in both. So only the windows at
cover positions (5 of 21 for L = 35) are hashed and exchanged in the first round. Where an anchor occurs
nowhere else no run can be shared; where it does, it is extended: the full runs around it are hashed to 128
bits and exchanged in the second round, which settles which of them occur again.

Both rounds are questions of blocks to shards (see ``exchange``); a run that a third of all texts share costs a
shard one entry per block.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.blocks import in_blocks
from rollbook.llm.exchange import ASKED, Keys, Route, ask, settle, tally_pairs, totals_of
from rollbook.llm.words import Words, covered, tally, window_starts, windows

#: Perfect difference sets by period.
COVERS = {1: (0,), 3: (0, 1), 7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14)}
#: Bytes of text whose keys a shard holds.
SHARD_BYTES = 32 << 20
#: An anchor has at least this share of the run's words.
LEAST_ANCHOR = 0.4


def cover(length: int) -> tuple[int, tuple[int, ...]]:
    """The sparsest cover that leaves anchors long enough to be telling."""
    period = max(p for p in COVERS if p == 1 or length - p + 1 >= LEAST_ANCHOR * length)
    return period, COVERS[period]


class Runs:
    """A block's words and the keys that it sends in either round."""

    def __init__(self, text: pa.ChunkedArray, length: int) -> None:
        self.words, self.length = Words(text), length
        self.hashes = self.words.hashes()

    def anchors(self) -> None:
        period, residues = cover(self.length)
        width = self.length - period + 1
        starts = window_starts(self.words, width)
        inside = starts - np.repeat(self.words.first[:-1], np.maximum(self.words.n - width + 1, 0))
        starts = starts[np.isin(inside % period, residues)]
        self.anchor_at = starts
        low, counts, self.place = tally(windows(self.hashes, width)[starts])
        self.keys = Keys(low, np.minimum(counts, 2))

    def extend(self, repeated: np.ndarray) -> None:
        """Runs around the anchors of which repeated (by distinct key) says that they occur again."""
        period, _ = cover(self.length)
        at = self.anchor_at[repeated[self.place]]
        n = len(self.words)
        near = np.zeros(n + 1, bool)
        if n:
            near[:n] = covered(at, period, n + period)[period - 1 : period - 1 + n] if period > 1 else covered(at, 1, n)
        starts = window_starts(self.words, self.length)
        self.run_at = starts[near[starts]]
        low, high = (windows(self.hashes, self.length, lane)[self.run_at] for lane in (0, 1))
        low, high, counts, self.run_place = tally_pairs(low, high)
        self.runs = Keys(low, np.minimum(counts, 2), high)


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])
def _cut(docs: pa.RecordBatch, runs: Runs, again: np.ndarray) -> pa.Table:
    """The texts without the words of runs of which again (by distinct run) says that they occur again."""
    words = runs.words
    gone = covered(runs.run_at[again[runs.run_place]], runs.length, len(words))
    lost = np.append(0, np.cumsum(gone))
    lost = lost[words.first[1:]] - lost[words.first[:-1]]
    texts = []
    for d in range(len(words.n)):
        parts = words.data[words.offsets[d] : words.offsets[d + 1]].tobytes().split()
        if lost[d]:
            parts = itertools.compress(parts, (~gone[words.first[d] : words.first[d + 1]]).tolist())
        texts.append(b" ".join(parts))
    return pa.Table.from_arrays([docs["doc_id"], pa.array(words.n), pa.array(lost), pa.array(texts, pa.binary()).cast(pa.string())], schema=_KEPT)


def remove_repeats(docs: DataFrame, length: int = 35, route: Route | None = None) -> DataFrame:
    """Texts without the words that lie in a run of ``length`` words which also starts anywhere else.

    docs needs doc_id and text; other columns are ignored. Per row: doc_id, n_words, n_removed and text, the
    words that stay joined by one space. All occurrences of a run are removed, the first included, and runs
    are judged on the input. A null text has no words; a null id stays null; repeated rows are copies of each
    other, so what they hold in runs goes from both; very long texts are taken whole. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = in_blocks(docs, "substrings")
    route = route or Route.between(blocks.n, max(1, -(-blocks.n_bytes // SHARD_BYTES)))
    edges = route.first

    def anchored(batch: pa.RecordBatch) -> Runs:
        runs = Runs(batch["text"], length)
        runs.anchors()
        return runs

    def extended(batch: pa.RecordBatch, told: pa.Table) -> Runs:
        runs = anchored(batch)
        runs.extend(totals_of(told, [runs.keys])[0] > 1)
        return runs

    def cut(block: int, batch: pa.RecordBatch, told: pa.Table) -> pa.Table:
        runs = extended(batch, told.filter(pa.compute.equal(told["round"], 1)))
        return _cut(batch, runs, totals_of(told.filter(pa.compute.equal(told["round"], 2)), [runs.runs])[0] > 1)

    first = settle(blocks.map(lambda block, batch: ask(block, [anchored(batch).keys], edges), ASKED), route, "anchors", most=2).select("shard", "block", "reply")
    second = settle(blocks.meet(first, lambda block, batch, told: ask(block, [extended(batch, told).runs], edges), ASKED), route, "runs", most=2).select("shard", "block", "reply")
    told = first.withColumn("round", F.lit(1)).unionByName(second.withColumn("round", F.lit(2)))
    return blocks.meet(told, cut, "doc_id bigint, n_words bigint, n_removed bigint, text string")
