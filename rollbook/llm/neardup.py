"""Exact Jaccard join of word-shingle sets, with signature trees.

1. Texts with equal sets are one class. The first row of a class speaks for it; no other goes on.
2. Routing. Two sets that reach the threshold differ in at most H shingles, a bound that follows from their
   sizes. Cut the space of shingle hashes into H + 1 + 2c parts: at least 2c + 1 parts then hold the same shingles
   of both. Put the parts in one order for all sets, richest first (equal parts are equally rich): by the prefix
   principle the first H + 1 parts of either have one in common, so each set drops its 2c poorest. Parts that hold
   one shingle or none, which unlike texts share by chance, are thus hardly ever kept. The bound is exact.
   Every class sends the hashes of its kept parts to shards; classes that agree in one are candidates.
3. Where up to SMALL classes agree in a part every pair of them is a candidate, and is held against the signatures
   of both (a bitmap of their shingles, two bits a shingle, and the size), which bound the overlap. Where more agree
   (copies with small changes, a common passage) they meet as a bucket: from each class its signature is held
   against those not yet reached, so near copies reach each other in a few steps and no list of pairs is kept.
   Buckets with the same members are one, and a bucket too large for one task is cut into chunks that meet in
   pairs. Only what passes joins a group, so neither chance meetings nor a common passage chain texts together.
4. A group's sets meet in a signature tree: leaves are single sets, a node keeps the union of their token
   bitmaps and the range of their sizes. A dual traversal skips pairs of nodes whose sizes or bitmaps rule out
   enough overlap, and pairs already connected; small nodes that are left meet as a block of bitmaps, and the
   pairs that this leaves are compared in full. A group too large for one task is cut into chunks, each a task.
   What these connect is spoken for by its least member; the speakers of a group meet next; and what then is
   still outside of the group's largest component meets all of the group, chunk by chunk. So a group of near
   copies that holds a third of all texts costs rows in proportion to it, and no pair goes unseen.

A class is named by its row's block and place there (see ``blocks``), so neither null nor repeated ids matter.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.blocks import Blocks, give_back, in_blocks
from rollbook.llm.exchange import Route, by_shard, planes, unplanes
from rollbook.llm.words import Words, mix, pack_sorted, sums, unpack_sorted, window_starts, windows
from rollbook.operators.entities import components
from rollbook.sources.shared import forget, let_go, written

#: Classes that agree in a part of which every pair is listed.
SMALL = 8
#: Classes of a bucket that one task holds against each other, at most twice as many.
BUCKET_SETS = 1 << 14
#: Keys of parts that a shard holds.
SHARD_KEYS = 2_000_000
#: Shingles that one task of step 4 holds.
GROUP_SHINGLES = 4 << 20
#: Sets of a chunk in step 4.
GROUP_SETS = 1024
BITMAP_BITS = 4096
#: Nodes of at most so many sets are compared as a block, all pairs of bitmaps at once.
BLOCK_SETS = 32
#: Sizes of a scheme: from g**k up to g**(k + 1); neighbours overlap by the threshold.
GROWTH = 1.15
_PART = np.uint64(0xC2B2AE3D27D4EB4F)


class Threshold:
    """Links are 100 * intersection >= percent * union."""

    def __init__(self, percent: int) -> None:
        self.percent = percent

    def linked(self, common: int, a: int, b: int) -> bool:
        return 100 * common >= self.percent * (a + b - common)

    def least_common(self, total: int) -> int:
        """The least intersection of two linked sets of total size together."""
        return -(-self.percent * total // (100 + self.percent))

    def schemes(self) -> Iterator[tuple[int, int, int, int, int]]:
        """(number, least size, largest size, parts, parts to keep), without end.

        Scheme k joins a set of base sizes [low, high) with one as large or larger, which is at most
        100 / percent times as large. The most that two may differ in repeats with period 100 + percent, and grows.
        """
        low = 1
        for k in itertools.count():
            high = max(low + 1, math.floor(low * GROWTH))
            top = (high - 1) * 100 // self.percent
            total = high - 1 + top
            most = max(t - 2 * self.least_common(t) for t in range(max(2, total - 100 - self.percent), total + 1))
            yield k, low, top, most + 1 + 2 * (most // 8 + 1), most + 1
            low = high

    def n_keys(self, sizes: np.ndarray) -> np.ndarray:
        """How many keys of parts a set of each size sends."""
        out = np.zeros(len(sizes), np.int64)
        for _, low, top, _, keep in self.schemes():
            if low > sizes.max(initial=0):
                return out
            out += np.where((sizes >= low) & (sizes <= top), keep, 0)


class Shingles:
    """Sets of distinct shingle hashes of a batch of texts: text d has hashes[first[d]:first[d + 1]], ascending."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray, width: int) -> None:
        words = Words(texts, fold=True)
        hashes = words.hashes()
        starts = window_starts(words, width)
        keys, text = windows(hashes, width)[starts], words.text_of_word()[starts]
        few = np.flatnonzero((words.n > 0) & (words.n < width))
        short = []
        for d in few.tolist():
            short.append(windows(hashes[words.first[d] : words.first[d + 1]], int(words.n[d]))[0])
        keys, text = np.concatenate([keys, np.array(short, np.uint64)]), np.concatenate([text, few])
        order = np.lexsort((keys, text))
        keys, text = keys[order], text[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
        self.hashes, self.text = keys[new], text[new]
        self.n = np.bincount(self.text, minlength=len(words.n))
        self.first = np.append(0, np.cumsum(self.n))

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits that name each set, whatever its order."""
        return tuple((sums(mix(self.hashes ^ np.uint64(salt)), self.first) + self.n.astype(np.uint64)).view(np.int64) for salt in (0x51, 0x9E3779B97F4A7C15))


def part_keys(sets: Shingles, threshold: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the kept parts of every set under each of its schemes, and the set of each."""
    keys, of = [], []
    by_size = np.argsort(sets.n, kind="stable")
    n = sets.n[by_size]
    first = np.append(0, np.cumsum(n))
    shingles = mix(sets.hashes[np.repeat(sets.first[by_size] - first[:-1], n) + np.arange(first[-1])] + _PART)
    for k, low, top, parts, keep in threshold.schemes():
        if low > (n[-1] if len(n) else 0):
            break
        mine = np.arange(*np.searchsorted(n, [low, top + 1]))
        if not len(mine):
            continue
        for some in np.array_split(mine, max(1, min(len(mine), len(mine) * parts >> 20))):  # bounds the table of parts
            here = shingles[first[some[0]] : first[some[-1] + 1]]
            cell = np.repeat(np.arange(len(some)) * parts, n[some]) + (here % np.uint64(parts)).astype(np.int64)
            content, count = np.zeros(len(some) * parts, np.uint64), np.bincount(cell, minlength=len(some) * parts)
            order = np.argsort(cell, kind="stable")
            edges = np.flatnonzero(np.diff(cell[order], prepend=-1))
            content[cell[order][edges]] = np.add.reduceat(mix(here[order] ^ _PART), edges)
            content = mix(content + mix(np.tile(np.arange(parts, dtype=np.uint64), len(some)) + np.uint64(k << 32)) + count.astype(np.uint64) * _PART)
            # Richest first, then by content: an order that equal parts share. Parts without a shingle come last.
            ranked = (np.uint64(255) - np.minimum(count, 255).astype(np.uint64)) << np.uint64(56) | content >> np.uint64(8)
            keys.append(mix(np.partition(ranked.reshape(-1, parts), keep - 1, axis=1)[:, :keep]).ravel())
            of.append(np.repeat(by_size[some], keep))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(of)


def signatures(sets: Shingles) -> list[bytes]:
    """A bitmap of every set, of a power of two of bits: two to four a shingle, 64 at least."""
    width = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(2 * sets.n, 1))).astype(np.int64))
    start = np.append(0, np.cumsum(width))
    flat = np.zeros(start[-1], np.uint8)
    flat[start[sets.text] + (mix(sets.hashes) & (width[sets.text] - 1).astype(np.uint64)).astype(np.int64)] = 1
    packed = np.packbits(flat).tobytes()
    return [packed[a // 8 : b // 8] for a, b in itertools.pairwise(start.tolist())]


def most_common(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> int:
    """The most shingles that two sets can share, by their signatures (words of 64 bits) and sizes."""
    if len(a) < len(b):
        a, b, n_a, n_b = b, a, n_b, n_a
    a = np.bitwise_or.reduce(a.reshape(-1, len(b)), axis=0)  # as if made of as many bits as b
    return int(np.bitwise_count(a & b).sum()) + min(n_a - int(np.bitwise_count(a).sum()), n_b - int(np.bitwise_count(b).sum()))


class Forest:
    """Union-find over 0..n-1; the root of a tree is its least member."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


class SignatureTree:
    """A binary tree over sets in an order that puts similar ones side by side."""

    def __init__(self, sets: list[np.ndarray], threshold: Threshold, known: list[int] | None = None) -> None:
        """known: sets with equal numbers there are known to be connected."""
        self.sets, self.threshold, self.forest = sets, threshold, Forest(len(sets))
        first: dict[int, int] = {}
        for i, k in enumerate(known or ()):
            self.forest.join(first.setdefault(k, i), i)
        self.order = sorted(range(len(sets)), key=lambda i: (int(mix(sets[i]).min()), len(sets[i]), i))
        bits = np.zeros((len(sets), BITMAP_BITS // 8), np.uint8)
        slack = []
        for row, i in enumerate(self.order):
            flat = np.zeros(BITMAP_BITS, bool)
            flat[(sets[i] >> np.uint64(40)) % np.uint64(BITMAP_BITS)] = True
            bits[row] = np.packbits(flat)
            slack.append(len(sets[i]) - int(flat.sum()))
        self.bits, self.slack, self.sizes = bits.view(np.uint64), np.array(slack, np.int64), np.array([len(sets[i]) for i in self.order], np.int64)
        #: nodes: (from, to, union of bitmaps, least size, largest size, most tokens that share a bit with another of the set, children)
        self.nodes = [(r, r + 1, bits[r].view(np.uint64), len(sets[i]), len(sets[i]), slack[r], None) for r, i in enumerate(self.order)]
        level = list(range(len(sets)))
        while len(level) > 1:
            above = []
            for a, b in itertools.zip_longest(level[::2], level[1::2]):
                if b is None:
                    above.append(a)
                    continue
                x, y = self.nodes[a], self.nodes[b]
                self.nodes.append((x[0], y[1], x[2] | y[2], min(x[3], y[3]), max(x[4], y[4]), max(x[5], y[5]), (a, b)))
                above.append(len(self.nodes) - 1)
            level = above
        self.root = level[0] if level else None
        self.whole = [c is None for *_, c in self.nodes]  # all members are known to be connected

    def _hopeless(self, x: tuple, y: tuple) -> bool:
        """Whether sizes or bitmaps keep every pair under the nodes below the threshold."""
        if x[4] < y[3]:
            if 100 * x[4] < self.threshold.percent * y[3]:
                return True
        elif y[4] < x[3] and 100 * y[4] < self.threshold.percent * x[3]:
            return True
        overlap = int(np.bitwise_count(x[2] & y[2]).sum()) + min(x[5], y[5])
        return overlap < self.threshold.least_common(x[3] + y[3])

    def _same(self, a: int, b: int) -> bool:
        return self.whole[a] and self.whole[b] and self.forest.find(self.order[self.nodes[a][0]]) == self.forest.find(self.order[self.nodes[b][0]])

    def _block(self, x: tuple, y: tuple) -> None:
        """Links between the sets under two nodes. Pairs that sizes or bitmaps rule out are dropped all at once."""
        a, b = slice(x[0], x[1]), slice(y[0], y[1])
        some, other = self.sizes[a, None], self.sizes[None, b]
        overlap = np.bitwise_count(self.bits[a, None] & self.bits[None, b]).sum(axis=2, dtype=np.int64) + np.minimum(self.slack[a, None], self.slack[None, b])
        near = (overlap >= self.threshold.least_common(some + other)) & (100 * np.minimum(some, other) >= self.threshold.percent * np.maximum(some, other))
        for r, q in np.argwhere(near).tolist():
            i, j = self.order[x[0] + r], self.order[y[0] + q]
            if self.forest.find(i) != self.forest.find(j):
                common = len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True))
                if self.threshold.linked(common, len(self.sets[i]), len(self.sets[j])):
                    self.forest.join(i, j)

    def _across(self, a: int, b: int) -> None:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            if self._same(a, b) or self._hopeless(self.nodes[a], self.nodes[b]):
                continue
            x, y = self.nodes[a], self.nodes[b]
            if x[1] - x[0] <= BLOCK_SETS and y[1] - y[0] <= BLOCK_SETS:
                self._block(x, y)
            elif y[6] is None or (x[6] is not None and x[1] - x[0] >= y[1] - y[0]):
                stack += [(c, b) for c in x[6]]
            else:
                stack += [(a, c) for c in y[6]]

    def connect(self) -> Forest:
        """All links between the sets, as a forest. Nodes come children first, so each pair of leaves meets once."""
        for n, node in enumerate(self.nodes):
            if node[6] is not None:
                a, b = node[6]
                self._across(a, b)
                self.whole[n] = self._same(a, b)
        return self.forest


_PARTS = pa.schema([("shard", pa.int64()), ("node", pa.int64()), ("keys", pa.binary()), ("names", pa.binary())])
_PARTS_DDL = "shard bigint, node bigint, keys binary, names binary"
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("small", pa.bool_())])
_PLACE = 20  # bits of a row's place in its block


def _dealt(keys: np.ndarray, names: np.ndarray, edges: np.ndarray, node: int, first: int = 0) -> pa.Table:
    """Messages of keys and the classes that hold them, by the part of the key space between the edges."""
    order = np.argsort(keys, kind="stable")
    keys, names = keys[order], names[order]
    cuts = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).tolist()
    return pa.Table.from_pylist([{"shard": first + s, "node": node, "keys": pack_sorted(keys[a:b]), "names": zstandard.compress(planes(names[a:b], 8), 1)} for s, (a, b) in enumerate(itertools.pairwise(cuts)) if a < b], _PARTS)


def _held(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All keys of messages, and the class of each."""
    keys = [unpack_sorted(x.as_py()) for x in table["keys"]]
    return np.concatenate(keys), np.concatenate([unplanes(zstandard.decompress(x.as_py()), 8, len(k)).astype(np.int64) for x, k in zip(table["names"], keys, strict=True)])


def _over_nodes(sent: DataFrame, route: Route) -> DataFrame:
    """What blocks sent to groups of shards, merged and sent on to the shards (see ``exchange``)."""
    node = (F.col("shard") * route.block_groups + F.pmod(F.xxhash64("node"), F.lit(route.block_groups))).alias("node")

    def forward(table: pa.Table) -> pa.Table:
        first, edges = route.second(table["shard"][0].as_py())
        return _dealt(*_held(table), edges, table["node"][0].as_py(), first)

    return sent.select("shard", node, "keys", "names").groupBy("node").applyInArrow(forward, _PARTS_DDL)


def _candidates(table: pa.Table) -> pa.Table:
    """What a shard's classes agree in: every pair (small) that agrees in a part of few, and the members b of each bucket a, of a part of many."""
    keys, names = _held(table)
    order = np.argsort(keys, kind="stable")
    keys, names = keys[order], names[order]
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    n = np.diff(np.append(start, len(keys)))
    del keys, order
    pairs = [np.zeros((0, 2), np.int64)]
    for m in range(2, SMALL + 1):
        at = start[n == m]
        pairs += [np.sort(np.stack([names[at + i], names[at + j]], axis=1), axis=1) for i in range(m) for j in range(i + 1, m)]
    pairs = np.unique(np.concatenate(pairs), axis=0)
    members, size = names[np.repeat(n > SMALL, n)], n[n > SMALL]
    # A bucket is called by its members, and counts once however many parts they agree in.
    first = np.append(0, np.cumsum(size))[:-1]
    bucket = np.add.reduceat(mix(members.astype(np.uint64)), first).view(np.int64) if len(size) else np.zeros(0, np.int64)
    once = np.zeros(len(size), bool)
    once[np.unique(bucket, return_index=True)[1]] = True
    members, bucket = members[np.repeat(once, size)], np.repeat(bucket[once], size[once])
    give_back()
    return pa.Table.from_arrays([pa.array(np.concatenate([pairs[:, 1], bucket])), pa.array(np.concatenate([pairs[:, 0], members])), pa.array(np.arange(len(pairs) + len(members)) < len(pairs))], schema=_EDGES)


def _reach(names: np.ndarray, sizes: np.ndarray, marks: list[np.ndarray], percent: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A forest over the classes of a bucket: ends of pairs whose signatures (words of 64 bits) leave enough overlap possible."""
    words = min(map(len, marks))
    bits = np.stack([np.bitwise_or.reduce(x.reshape(-1, words), axis=0) for x in marks])
    slack = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    ends, heads = [], []
    left, todo = np.arange(len(names)), []
    while len(left):
        if not todo:
            todo, left = [int(left[0])], left[1:]
            rest, n, free = bits[left], sizes[left], slack[left]
        p = todo.pop()
        overlap = np.bitwise_count(rest & bits[p]).sum(axis=1, dtype=np.int64) + np.minimum(free, slack[p])
        near = ((100 + percent) * overlap >= percent * (n + sizes[p])) & (100 * np.minimum(n, sizes[p]) >= percent * np.maximum(n, sizes[p]))
        if near.any():
            ends.append(names[left[near]])
            heads.append(np.full(len(ends[-1]), names[p]))
            todo += left[near].tolist()
            left, rest, n, free = left[~near], rest[~near], n[~near], free[~near]
    return ends, heads


def _reached(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The forests (a, b) of buckets (bucket, i, j, name, n_shingles, signature), whose rows follow each other."""

    def settled(table: pa.Table, cuts: list[int]) -> pa.RecordBatch:
        table = table.combine_chunks()
        names, sizes = table["name"].to_numpy(), table["n_shingles"].to_numpy()
        marks = [np.frombuffer(x.as_buffer(), "<u8") for x in table["signature"]]
        found = [_reach(names[a:b], sizes[a:b], marks[a:b], percent) for a, b in itertools.pairwise(cuts)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *itertools.chain.from_iterable(f[end] for f in found)])) for end in (0, 1)], names=["a", "b"])

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.stack([batch[c].to_numpy() for c in ("bucket", "i", "j")], axis=1)
        if not len(keys):
            continue
        new = (np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()
        if last is not None and (keys[0] != last).any():
            new = [0, *new]
        last = keys[-1]
        if not new:
            held.append(batch)
            continue
        before = sum(x.num_rows for x in held)
        whole = pa.Table.from_batches([*held, batch.slice(0, new[-1])])
        if whole.num_rows:
            yield settled(whole, sorted({0, *(before + x for x in new)}))
        held = [batch.slice(new[-1])]
    if held:
        whole = pa.Table.from_batches(held)
        yield settled(whole, [0, whole.num_rows])
    give_back()


_SET = "name bigint, group bigint, chunks bigint, set binary"


def _link_group(table: pa.Table, percent: int) -> pa.Table:
    """A forest of the links between the sets of a task of step 4. Sets with one root are known to be connected."""
    names = table["name"].to_numpy()
    order = np.argsort(names, kind="stable")
    blobs, known = table["set"], table["root"].to_numpy()[order].tolist()
    forest = SignatureTree([unpack_sorted(blobs[int(i)].as_py()) for i in order], Threshold(percent), known).connect()
    root = np.array([forest.find(i) for i in range(len(names))], np.int64)
    names = names[order]
    give_back()
    return pa.Table.from_arrays([pa.array(names), pa.array(names[root])], names=["a", "b"])


def _link(sets: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) among the sets (_SET) of each group, as a forest."""

    def within(tasks: DataFrame, *keys: str) -> DataFrame:
        # Dealt by all keys: a join may have left a whole group's tasks in one partition.
        return tasks.repartition("group", *keys).groupBy("group", *keys).applyInArrow(lambda t: _link_group(t, percent), "a bigint, b bigint").where("a <> b")

    def rooted(links: DataFrame) -> DataFrame:
        return large.drop("root").join(components(links).toDF("name", "root"), "name", "left").withColumn("root", F.coalesce("root", "name"))

    sets = written(sets.withColumn("chunk", F.pmod(F.xxhash64("name"), F.col("chunks"))).withColumn("root", F.col("name")), "sets")
    large = sets.where("chunks > 1")
    links = written(within(sets, "chunk"), "links")
    if large.isEmpty():
        return links
    # What speaks for the components of the chunks. Where even these are many they meet in pairs of chunks.
    speakers = rooted(links).where("root = name").drop("chunks", "chunk")
    chunks = speakers.groupBy("group").agg(F.ceil(F.count("*") / GROUP_SETS).alias("chunks"))
    speakers = speakers.join(chunks, "group").withColumn("mine", F.pmod(F.xxhash64("name", F.lit(1)), F.col("chunks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
    speakers = speakers.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
    links = written(links.union(within(speakers.select("name", "group", "set", "root", "i", "j"), "i", "j")), "links")
    # All but the largest component of a group meets the whole of it.
    members = written(rooted(links), "members")
    largest = members.groupBy("group", "root").agg(F.count("*").alias("n")).groupBy("group").agg(F.max_by("root", F.struct("n", -F.col("root"))).alias("largest"))
    members = members.join(largest, "group")
    outside = members.where("root <> largest")
    parts = outside.groupBy("group").agg(F.ceil(F.count("*") / GROUP_SETS).alias("parts"))
    outside = outside.join(parts, "group").withColumn("part", F.pmod(F.xxhash64("name", F.lit(2)), F.col("parts"))).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
    inside = members.join(parts, "group").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    columns = ["name", "group", "set", "root", "part", "chunk"]
    return written(links.union(within(outside.select(columns).union(inside.select(columns)).dropDuplicates(["group", "part", "chunk", "name"]), "part", "chunk")), "links")


class Linked:
    """The rows of docs in blocks, their classes, and the classes that links connect.

    rows: block, local, doc_id, n_shingles, low, high (the set's 128-bit name). classes: name, n_shingles, low,
    high, least_id, root (the least name that links reach). A set without shingles has no class.
    """

    def __init__(self, docs: DataFrame, percent: int, width: int, route: Route | None = None) -> None:
        threshold = Threshold(percent)

        def measure(batch: pa.RecordBatch) -> list[pa.Array]:
            sets = Shingles(batch["text"], width)
            return [batch["doc_id"].cast(pa.int64()), pa.array(sets.n), *map(pa.array, sets.digests()), pa.array(threshold.n_keys(sets.n)), pa.array(signatures(sets), pa.binary())]

        self.blocks: Blocks = in_blocks(docs, "jaccard", measure, "doc_id bigint, n_shingles bigint, low bigint, high bigint, n_keys bigint, signature binary")
        self.rows = self.blocks.rows
        name = F.shiftleft("block", _PLACE).bitwiseOR(F.col("local").cast("bigint")).alias("name")
        set_of = ["n_shingles", "low", "high"]
        classes = written(self.rows.where("n_shingles > 0").select(*set_of, "doc_id", "n_keys", name).groupBy(*set_of).agg(F.min("name").alias("name"), F.min("doc_id").alias("least_id"), F.first("n_keys").alias("n_keys")), "classes")
        total = classes.agg(F.coalesce(F.sum("n_keys"), F.lit(0)).alias("n")).first()["n"]
        route = route or Route.between(self.blocks.n, max(1, -(-total // SHARD_KEYS)))
        first_edges = route.first
        heads = classes.select(F.shiftright("name", _PLACE).alias("block"), F.col("name").bitwiseAND((1 << _PLACE) - 1).cast("int").alias("local"))

        def send(block: int, batch: pa.RecordBatch, mine: pa.Table) -> pa.Table:
            at = np.sort(mine["local"].to_numpy())
            keys, of = part_keys(Shingles(batch["text"].take(pa.array(at)), width), threshold)
            return _dealt(keys, at[of].astype(np.int64) | block << _PLACE, first_edges, block)

        sent = self.blocks.meet(heads, send, _PARTS_DDL, need=True)
        sent = sent if route.groups == 1 else _over_nodes(sent, route)
        edges = written(by_shard(sent, route.shards).groupBy("shard").applyInArrow(_candidates, "a bigint, b bigint, small boolean"), "candidates")
        let_go(docs.sparkSession)  # the keys of parts are the largest exchange
        marks = self.rows.where("n_shingles > 0").select(name, "n_shingles", "signature")
        passed = self._pass(edges.where("small").select("a", "b").distinct(), marks, threshold)
        grouped = components(passed.union(self._pass_buckets(edges.where("not small").select(F.col("a").alias("bucket"), F.col("b").alias("name")).distinct(), marks, percent))).toDF("name", "group")
        grouped = grouped.union(grouped.select("group", "group").distinct()).toDF("name", "group")
        let_go(docs.sparkSession)
        wanted = written(grouped.join(classes.select("name", "n_shingles"), "name"), "wanted")
        sizes = wanted.groupBy("group").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("total"))
        chunks = F.ceil(F.greatest(F.col("total") / GROUP_SHINGLES, F.col("members") / GROUP_SETS)).alias("chunks")
        wanted = wanted.join(sizes, "group").select("name", F.shiftright("name", _PLACE).alias("block"), "group", chunks)

        def shingle_sets(block: int, batch: pa.RecordBatch, mine: pa.Table) -> pa.Table:
            places = pa.array(mine["name"].to_numpy() & ((1 << _PLACE) - 1))
            sets = Shingles(batch["text"].take(places), width)
            blobs = [pack_sorted(sets.hashes[a:b]) for a, b in itertools.pairwise(sets.first.tolist())]
            return pa.table({"name": mine["name"], "group": mine["group"], "chunks": mine["chunks"], "set": pa.array(blobs, pa.binary())})

        links = _link(self.blocks.meet(wanted, shingle_sets, _SET, need=True), percent)
        forget(edges)
        # A class in several tasks can have several links.
        roots = components(links).toDF("name", "root")
        self.classes = classes.join(roots, "name", "left").select("name", *set_of, "least_id", F.coalesce("root", "name").alias("root"))

    @staticmethod
    def _pass_buckets(met: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
        """A forest (a, b) of the pairs that meet in a bucket (bucket, name) and whose signatures leave enough overlap possible."""
        chunks = met.groupBy("bucket").agg(F.ceil(F.count("*") / BUCKET_SETS).alias("chunks"))
        dealt = met.join(chunks, "bucket").withColumn("mine", F.pmod(F.xxhash64("name"), F.col("chunks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
        tasks = dealt.select("bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "name").join(marks, "name")
        tasks = tasks.select("bucket", "i", "j", "name", "n_shingles", "signature").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
        return tasks.mapInArrow(lambda batches: _reached(batches, percent), "a bigint, b bigint")

    @staticmethod
    def _pass(pairs: DataFrame, marks: DataFrame, threshold: Threshold) -> DataFrame:
        """The pairs (a, b) whose signatures leave enough overlap possible."""

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes = [batch[c].to_numpy() for c in ("n_a", "n_b")]
                ok = [
                    most_common(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8"), n, m) >= threshold.least_common(n + m)
                    for x, y, n, m in zip(batch["x"], batch["y"], *(s.tolist() for s in sizes), strict=True)
                ]
                yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

        for end, n, x in (("a", "n_a", "x"), ("b", "n_b", "y")):
            pairs = pairs.join(marks.toDF(end, n, x), end)
        near = pairs.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * threshold.percent)
        return near.mapInArrow(check, "a bigint, b bigint")


def join(docs: DataFrame, percent: int = 80, width: int = 5, route: Route | None = None) -> DataFrame:
    """Components of the texts under links of ``percent`` Jaccard similarity of their word shingles.

    docs needs doc_id and text; other columns are ignored. Words are runs without ASCII white space, A-Z
    lower-cased; a set has the distinct shingles of ``width`` words, and of a shorter text its words as one.
    A row for each row of docs: doc_id, n_shingles and component_id, the least doc_id that links of its text reach.
    The rows are what links connect, so different texts under one id are two, each with its own component. A text
    without words links with nothing and is its own component. A null id counts for nothing: such a row has the
    component of its text, null if no row with an id is in it. Very long texts are taken whole. An empty table
    gives no rows.
    """
    found = Linked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), percent, width, route)
    least = found.classes.groupBy("root").agg(F.min("least_id").alias("component"))
    classes = found.classes.join(least, "root").select("n_shingles", "low", "high", "component")
    rows = found.rows.select("doc_id", "n_shingles", "low", "high").join(classes, ["n_shingles", "low", "high"], "left")
    return rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """docs, all columns kept, with one row of each component of ``join``.

    It is the row with the least doc_id (rows without come last), of several with that id the one whose set's name
    is least, then the first in the table. So of repeated rows one stays, rows without an id are no exception, and
    of different texts under one id none goes for the id's sake. Rows without words are in no group and all stay.
    """
    found = Linked(docs, percent, width)
    rows = found.rows.join(found.classes.select("n_shingles", "low", "high", "root"), ["n_shingles", "low", "high"], "left")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "low", "high", "block", "local")
    first = rows.where("root is not null").groupBy("root").agg(F.min_by(F.struct("block", "local"), order).alias("_")).select("_.*")
    kept = first.unionByName(found.rows.where("n_shingles = 0").select("block", "local"))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return found.blocks.meet(kept, lambda _, batch, mine: pa.Table.from_batches([batch.take(pa.array(np.sort(mine["local"].to_numpy())))]), columns, need=True)
