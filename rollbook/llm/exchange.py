"""Questions of blocks to shards, and what comes back.

A block asks about the distinct keys that it holds, with its own count of each; the shard of a key adds the counts
of all blocks up and tells each block the totals that differ from its own. One message for each pair of block and
shard would make records grow with the square of the input, so beyond ``DIRECT`` of them the way goes over nodes:
a node stands between a group of blocks and a group of shards, about the root of either number, merges what its
blocks ask, asks the shards as if it were a block, and hands the totals down. Messages then grow with the power 1.5
of the input, and a node's memory not at all.
"""

from __future__ import annotations

import itertools
import math
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.blocks import PARTITIONS, give_back
from rollbook.llm.words import tally
from rollbook.sources.shared import written

#: Messages up to which blocks ask shards themselves.
DIRECT = 1 << 22


@dataclass(frozen=True)
class Route:
    """How many shards there are, in how many groups, and how many groups of blocks; one group of shards is none."""

    shards: int
    groups: int = 1
    block_groups: int = 1

    @classmethod
    def between(cls, blocks: int, shards: int) -> Route:
        if blocks * shards <= DIRECT:
            return cls(shards)
        groups = math.isqrt(shards) + 1
        return cls(groups * -(-shards // groups), groups, math.isqrt(blocks) + 1)

    @property
    def first(self) -> np.ndarray:
        """The edges between the parts of the key space that a block writes to."""
        return self._edges(self.shards if self.groups == 1 else self.groups)

    def second(self, group: int) -> tuple[int, np.ndarray]:
        """The first shard of a group, and the edges between its shards."""
        each = self.shards // self.groups
        return group * each, self._edges(self.shards)[group * each : (group + 1) * each - 1]

    @staticmethod
    def _edges(n: int) -> np.ndarray:
        return np.array([(i << 64) // n for i in range(1, n)], dtype=np.uint64)


@dataclass
class Keys:
    """Distinct keys, ascending, with counts. Keys of 128 bits have a second half, and ascend by both."""

    low: np.ndarray
    counts: np.ndarray
    high: np.ndarray | None = None

    def part(self, a: int, b: int) -> Keys:
        return Keys(self.low[a:b], self.counts[a:b], None if self.high is None else self.high[a:b])

    @staticmethod
    def merged(parts: list[Keys]) -> tuple[Keys, np.ndarray]:
        """All keys with the sums of their counts, and the place there of every key of the parts in turn."""
        low, counts = np.concatenate([p.low for p in parts]), np.concatenate([p.counts for p in parts])
        if parts[0].high is None:
            low, counts, place = tally(low, counts)
            return Keys(low, counts), place
        low, high, _, place = tally_pairs(low, np.concatenate([p.high for p in parts]))
        return Keys(low, np.bincount(place, counts, len(low)).astype(np.int64), high), place


def tally_pairs(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, how often each occurs, and each row's place among them."""
    order = np.lexsort((high, low))
    a, b = low[order], high[order]
    new = np.empty(len(a), bool)
    new[:1], new[1:] = True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(new)
    place = np.empty(len(a), np.int64)
    place[order] = np.cumsum(new) - 1
    return a[at], b[at], np.diff(np.append(at, len(a))), place


def planes(x: np.ndarray, size: int) -> bytes:
    """Numbers as planes of bytes: the high ones are all but empty, and compress away."""
    return x.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T.tobytes()


def unplanes(blob: bytes, size: int, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8, size * n).reshape(size, n).T).view(f"<u{size}").ravel()


def pack(kinds: list[Keys]) -> bytes:
    out = [struct.pack("<B?", len(kinds), kinds[0].high is not None)]
    for k in kinds:
        wide = 8 if len(k.counts) and int(k.counts.max()) >= 1 << 32 else 4
        out += [struct.pack("<QB", len(k.low), wide), planes(np.diff(k.low, prepend=np.uint64(0)), 8), planes(k.counts, wide)]
        out += [] if k.high is None else [k.high.astype("<u8").tobytes()]
    return zstandard.compress(b"".join(out), 1)


def unpack(blob: bytes) -> list[Keys]:
    raw = zstandard.decompress(blob)
    n, double = struct.unpack_from("<B?", raw)
    at, out = 2, []
    for _ in range(n):
        size, wide = struct.unpack_from("<QB", raw, at)
        view = memoryview(raw)[at + 9 :]
        low = np.cumsum(unplanes(view, 8, size), dtype=np.uint64)
        counts = unplanes(view[8 * size :], wide, size).astype(np.int64)
        at += 9 + (8 + wide) * size
        high = np.frombuffer(raw, "<u8", size, at) if double else None
        at += 8 * size if double else 0
        out.append(Keys(low, counts, high))
    return out


def _answer(own: np.ndarray, totals: np.ndarray) -> bytes:
    """The totals that differ from a block's own counts, by their place."""
    changed = totals != own
    return zstandard.compress(struct.pack("<Q", len(own)) + np.packbits(changed).tobytes() + planes(totals[changed], 8), 1)


def _read(blob: bytes, own: np.ndarray) -> np.ndarray:
    """The totals of the first keys of a block's own, as many as the answer speaks of."""
    raw = zstandard.decompress(blob)
    (n,) = struct.unpack_from("<Q", raw)
    bits = -(-n // 8)
    changed = np.unpackbits(np.frombuffer(raw, np.uint8, bits, 8), count=n).astype(bool)
    out = own[:n].copy()
    out[changed] = unplanes(memoryview(raw)[8 + bits :], 8, int(changed.sum())).astype(np.int64)
    return out


_ASKED = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("body", pa.binary())])
ASKED = "shard bigint, block bigint, body binary"
_TOLD = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("reply", pa.binary()), ("total", pa.int64()), ("positive", pa.int64())])
TOLD = "shard bigint, block bigint, reply binary, total bigint, positive bigint"


def ask(block: int, kinds: list[Keys], edges: np.ndarray, first: int = 0) -> pa.Table:
    """The messages of a block: its keys by the part of the key space between the edges."""
    cuts = [np.concatenate([[0], np.searchsorted(k.low, edges), [len(k.low)]]).tolist() for k in kinds]
    rows = []
    for s in range(len(edges) + 1):
        if any(c[s] < c[s + 1] for c in cuts):
            rows.append({"shard": first + s, "block": block, "body": pack([k.part(c[s], c[s + 1]) for k, c in zip(kinds, cuts, strict=True)])})
    return pa.Table.from_pylist(rows, _ASKED)


def _replies(asked: list[list[Keys]], totals: list[np.ndarray], places: list[np.ndarray]) -> list[bytes]:
    """The reply to each message: an answer for each kind, in one body."""
    at, out = [0] * len(totals), []
    for kinds in asked:
        parts = []
        for i, k in enumerate(kinds):
            parts.append(_answer(k.counts, totals[i][places[i][at[i] : at[i] + len(k.low)]]))
            at[i] += len(k.low)
        out.append(struct.pack(f"<B{len(parts)}Q", len(parts), *map(len, parts)) + b"".join(parts))
    return out


def _bodies(reply: bytes) -> list[bytes]:
    n = reply[0]
    sizes = struct.unpack_from(f"<{n}Q", reply, 1)
    ends = list(itertools.accumulate(sizes, initial=1 + 8 * n))
    return [reply[a:b] for a, b in itertools.pairwise(ends)]


def _settle(table: pa.Table, most: int) -> pa.Table:
    asked = [unpack(x.as_py()) for x in table["body"]]
    totals, places = [], []
    for kind in zip(*asked, strict=True):
        keys, place = Keys.merged(list(kind))
        totals.append(np.minimum(keys.counts, most) if most else keys.counts)
        places.append(place)
    n = len(asked)
    out = pa.Table.from_arrays([
        table["shard"].cast(pa.int64()), table["block"], pa.array(_replies(asked, totals, places), pa.binary()), pa.array([int(totals[0].sum())] + [0] * (n - 1)), pa.array([int((totals[0] > 0).sum())] + [0] * (n - 1)),
    ], schema=_TOLD)
    give_back()
    return out


def totals_of(told: pa.Table, kinds: list[Keys]) -> list[np.ndarray]:
    """The totals of a block's keys, kind by kind, from the replies it was told (by shard)."""
    replies = [_bodies(x) for x in told.sort_by("shard")["reply"].to_pylist()]
    out = []
    for i, k in enumerate(kinds):
        parts, at = [np.zeros(0, np.int64)], 0
        for r in replies:
            parts.append(_read(r[i], k.counts[at:]))
            at += len(parts[-1])
        out.append(np.concatenate(parts))
    return out


def by_shard(sent: DataFrame, shards: int) -> DataFrame:
    """sent with shard as an int, dealt by it: one shard to a partition while partitions last, else by hash."""
    sent = sent.withColumn("shard", F.col("shard").cast("int"))
    return sent.repartitionById(shards, "shard") if shards <= PARTITIONS else sent.repartition(PARTITIONS, "shard")


def settle(sent: DataFrame, route: Route, name: str, most: int = 0) -> DataFrame:
    """What the blocks that asked (columns of ASKED) are told (columns of TOLD), written.

    With ``most``, totals go only so far. total and positive, summed, are of the first kind of keys: the sum of the
    totals, and how many keys have one.
    """
    if route.groups == 1:
        return written(by_shard(sent, route.shards).groupBy("shard").applyInArrow(lambda t: _settle(t, most), TOLD), name)
    node = (F.col("shard") * route.block_groups + F.pmod(F.xxhash64("block"), F.lit(route.block_groups))).alias("node")
    sent = written(sent.select(node, "shard", "block", "body"), f"{name}-asked")

    def merge(table: pa.Table) -> tuple[list[list[Keys]], list[Keys], list[np.ndarray]]:
        asked = [unpack(x.as_py()) for x in table["body"]]
        found = [Keys.merged(list(kind)) for kind in zip(*asked, strict=True)]
        return asked, [k for k, _ in found], [p for _, p in found]

    def forward(table: pa.Table) -> pa.Table:
        first, edges = route.second(table["shard"][0].as_py())
        return ask(table["node"][0].as_py(), merge(table)[1], edges, first)

    def hand_down(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _TOLD.empty_table()
        asked, merged, places = merge(table)
        totals = totals_of(told, merged)
        nothing = [0] * table.num_rows
        counts = [pa.array([sum(told[c].to_pylist()), *nothing[1:]], pa.int64()) for c in ("total", "positive")]
        out = pa.Table.from_arrays([table["shard"], table["block"], pa.array(_replies(asked, totals, places), pa.binary()), *counts], schema=_TOLD)
        give_back()
        return out

    above = settle(sent.groupBy("node").applyInArrow(forward, ASKED), Route(route.shards), name, most).withColumnRenamed("block", "node")
    return written(sent.groupBy("node").cogroup(above.groupBy("node")).applyInArrow(hand_down, TOLD), name)
