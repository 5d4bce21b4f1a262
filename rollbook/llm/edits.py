"""Token counts that follow edits.

A text is kept as a segment tree over its pre-tokens, the units that a byte-level BPE never merges across: buckets of
pre-tokens are the leaves, and every node holds the characters and the tokens below it. An edit finds its place by
descending the sums and takes up the pre-token pattern a little before, as far back as the pattern can look ahead.
It goes on until it is past the edit and a cut of its own falls on one of the old cuts: from there on the text cuts
as before. Only what lies between is counted anew, and becomes pre-tokens of its own, so that later edits beside it
have no more to do than this one. A bucket that grows splits.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.tokens import byte_bpe, byte_store, chunks, default_vocabulary
from rollbook.llm.words import Words, hash_ranges, slices, sums

#: Production edits: what identifies a person or a machine is replaced. Classes are of ASCII.
SCRUB = ((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "<EMAIL>"), (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "<IP>"), (r"\d{7,}", "<NUMBER>"))
#: Pre-tokens of a bucket when it is made; at twice as many it splits.
BUCKET = 64
#: Characters beyond its end that a pre-token can depend on: those of a contraction that was not one.
AHEAD = 2


@cache
def _pattern() -> regex.Pattern:
    import public_tokenizers

    return regex.compile(public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}"))


@cache
def _counter(path: str):
    encode = byte_bpe(path)
    return lru_cache(maxsize=1 << 16)(lambda piece: len(encode(piece)))


def pre_tokens(text: str) -> list[str]:
    return [m.group() for m in _pattern().finditer(text)]


class TokenTree:
    """Token counts of one text under edits: characters and tokens of its pre-tokens, summed up a tree."""

    def __init__(self, pieces: Sequence[str], tokens: Sequence[int] | None = None, path: str | None = None) -> None:
        self.count = _counter(path or default_vocabulary("byte_bpe_50k.json"))
        self.encoded = 0
        tokens = [self.count(p) for p in pieces] if tokens is None else list(tokens)
        self.pieces = [list(pieces[i : i + BUCKET]) for i in range(0, len(pieces), BUCKET)] or [[]]
        self.counts = [tokens[i : i + BUCKET] for i in range(0, len(tokens), BUCKET)] or [[]]
        self._grow()

    def _grow(self) -> None:
        """The tree over the buckets."""
        self.size = 1 << max(0, len(self.pieces) - 1).bit_length()
        leaves = np.zeros((2, self.size), np.int64)
        leaves[0, : len(self.pieces)] = [sum(map(len, b)) for b in self.pieces]
        leaves[1, : len(self.counts)] = list(map(sum, self.counts))
        levels = [leaves]
        while levels[-1].shape[1] > 1:
            levels.append(levels[-1][:, ::2] + levels[-1][:, 1::2])
        tree = np.concatenate([np.zeros((2, 1), np.int64), *levels[::-1]], axis=1)
        self.n_chars, self.n_tokens = tree[0].tolist(), tree[1].tolist()

    @property
    def tokens(self) -> int:
        return self.n_tokens[1]

    @property
    def chars(self) -> int:
        return self.n_chars[1]

    def text(self) -> str:
        return "".join(p for b in self.pieces for p in b)

    def leaves(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of every pre-token: with the text, all there is to the tree."""
        return [len(p) for b in self.pieces for p in b], [c for b in self.counts for c in b]

    def _find(self, at: int) -> tuple[int, int, int]:
        """Bucket and place of the pre-token that holds character ``at``, and where it starts."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if start + self.n_chars[node] <= at:
                start += self.n_chars[node]
                node += 1
        bucket = node - self.size
        for i, piece in enumerate(self.pieces[bucket]):
            if start + len(piece) > at:
                return bucket, i, start
            start += len(piece)
        return bucket, len(self.pieces[bucket]), start

    def _sum_up(self, bucket: int, chars: int, tokens: int) -> None:
        node = bucket + self.size
        while node:
            self.n_chars[node] += chars
            self.n_tokens[node] += tokens
            node //= 2

    def _replace(self, bucket: int, a: int, b: int, pieces: list[str]) -> None:
        own, counts = self.pieces[bucket], self.counts[bucket]
        new = [self.count(p) for p in pieces]
        self._sum_up(bucket, sum(map(len, pieces)) - sum(map(len, own[a:b])), sum(new) - sum(counts[a:b]))
        own[a:b], counts[a:b] = pieces, new

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces characters start:end of the text as it is now."""
        bucket, place, left = self._find(max(0, min(start - 1 - AHEAD, self.chars - 1)))
        old: list[str] = []
        at, stop, i = left, bucket, place  # stop, i: the first pre-token not taken in yet
        need, step = end, 4
        while True:
            taken = 0
            while stop < len(self.pieces) and (at <= need or taken < step):
                if i == len(self.pieces[stop]):
                    stop, i = stop + 1, 0
                    continue
                piece = self.pieces[stop][i]
                old.append(piece)
                at, i, taken = at + len(piece), i + 1, taken + (at >= need)
            whole = "".join(old)
            text = whole[: start - left] + new + whole[end - left :]
            more, ends = len(text) - len(whole), [m.end() for m in _pattern().finditer(text)]
            # The first cut past the edit that was a cut before, and that the text beyond the end could not move.
            edge = start - left + len(new)
            done = at >= self.chars
            where, after = 0, {}
            for n_old, piece in enumerate(old, 1):
                where += len(piece)
                if where + more >= edge and where >= end - left:
                    after[where + more] = n_old
            k = next((k for k, e in enumerate(ends) if e in after and (done or e + AHEAD < len(text))), None)
            if k is not None:
                cut, kept = ends[k], after[ends[k]]
                break
            if done:
                cut, kept, k = len(text), len(old), len(ends) - 1
                break
            need, step = at, step * 2
        pieces, a = [], 0
        for e in ends[: k + 1]:
            pieces.append(text[a:e])
            a = e
        self.encoded += len(text[:cut].encode())
        self._put(bucket, place, kept, pieces)

    def _put(self, bucket: int, place: int, n_old: int, pieces: list[str]) -> None:
        """The n_old pre-tokens from a place on give way to others."""
        here = min(n_old, len(self.pieces[bucket]) - place)
        self._replace(bucket, place, place + here, pieces)
        left, other = n_old - here, bucket + 1
        emptied = False
        while left:
            some = min(left, len(self.pieces[other]))
            self._replace(other, 0, some, [])
            emptied |= not self.pieces[other]
            left, other = left - some, other + 1
        if len(self.pieces[bucket]) >= 2 * BUCKET:
            own, counts = self.pieces[bucket], self.counts[bucket]
            self.pieces[bucket : bucket + 1] = [own[i : i + BUCKET] for i in range(0, len(own), BUCKET)]
            self.counts[bucket : bucket + 1] = [counts[i : i + BUCKET] for i in range(0, len(counts), BUCKET)]
            self._grow()
        elif emptied and sum(map(bool, self.pieces)) * 2 < len(self.pieces):
            self.pieces, self.counts = [b for b in self.pieces if b] or [[]], [b for b in self.counts if b] or [[]]
            self._grow()


def edits_of(text: str, rules: Sequence[tuple[str, str]]) -> list[tuple[int, int, str]]:
    """Non-overlapping replacements, earlier rules first, in the order in which they can be applied: from the end."""
    found: list[tuple[int, int, str]] = []
    for pattern, new in rules:
        more, ends = [], [f[1] for f in found]
        for m in re.finditer(pattern, text, re.ASCII):
            k = bisect_left(ends, m.start() + 1)  # the first replacement that ends beyond the match's start
            if k == len(found) or found[k][0] >= m.end():
                more.append((m.start(), m.end(), new))
        found = sorted(found + more)
    return found[::-1]


_COUNTS = "doc_id bigint, n_tokens bigint, n_edits bigint, n_tokens_after bigint, bytes_encoded bigint, text string"


def recount(docs: DataFrame, rules: Sequence[tuple[str, str]] = SCRUB, path: str | None = None, keep_text: bool = False) -> DataFrame:
    """Token counts of every text before and after the edits that the rules (pattern, replacement) make.

    docs needs doc_id and text; other columns are ignored. Per row: doc_id, n_tokens, n_edits, n_tokens_after,
    bytes_encoded (what the edits had encoded again) and with keep_text the edited text. Of matches that overlap the
    earlier rule's counts, then the first. A null text is empty and has no tokens. Null and repeated ids give a row
    each; very long texts are taken whole, an edit costing what its neighbourhood does; an empty table gives no
    rows. No exchange.
    """
    path = path or default_vocabulary("byte_bpe_50k.json")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            store, words = byte_store(path), Words(batch["text"])
            starts, ends, first = chunks(words)
            sizes = store.sizes(store.rows(hash_ranges(words.data, starts, ends), words.data, starts, ends))
            before = sums(sizes, first)
            after, n, encoded, texts = before.copy(), np.zeros(len(before), np.int64), np.zeros(len(before), np.int64), []
            for d, text in enumerate(batch["text"].to_pylist()):
                edits = edits_of(text, rules)
                if edits:
                    tree = TokenTree(pre_tokens(text), path=path)
                    for edit in edits:
                        tree.edit(*edit)
                    after[d], n[d], encoded[d] = tree.tokens, len(edits), tree.encoded
                    text = tree.text() if keep_text else text
                if keep_text:
                    texts.append(text)
            columns = [batch["doc_id"], pa.array(before), pa.array(n), pa.array(after), pa.array(encoded)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(texts, pa.string())] * keep_text, names=names)

    names = [x.split()[0] for x in _COUNTS.split(", ")][: 5 + keep_text]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.mapInArrow(count, ", ".join(_COUNTS.split(", ")[: 5 + keep_text]))


_TREES = "doc_id bigint, text string, leaf_chars array<int>, leaf_tokens array<int>, n_tokens bigint"


def trees(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The tree of every text: doc_id, text, leaf_chars and leaf_tokens (of its pre-tokens), n_tokens; to be kept, and revised.

    docs needs doc_id and text; a null text is empty. Every row has its tree, whatever its id.
    """
    path = path or default_vocabulary("byte_bpe_50k.json")

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [TokenTree(pre_tokens(t), path=path) for t in batch["text"].to_pylist()]
            yield _kept(batch["doc_id"], made)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(plant, _TREES)


def _kept(ids: pa.Array, made: list[TokenTree]) -> pa.RecordBatch:
    leaves = [t.leaves() for t in made]
    arrays = [ids, pa.array([t.text() for t in made], pa.string()), *(pa.array([x[k] for x in leaves], pa.list_(pa.int32())) for k in (0, 1)), pa.array([t.tokens for t in made], pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in _TREES.split(", ")])


def revise(kept: DataFrame, path: str | None = None) -> DataFrame:
    """Kept trees after their edits: kept has the columns of ``trees`` and edits, an array of (start, end, new) per row.

    Edits are applied in order, each to the text as the ones before it left it (characters, from 0). Returns the
    columns of ``trees``, so that it can be kept and revised again; nothing but the edits' neighbourhoods is encoded.
    A row whose edits are null or empty stays as it is.
    """
    path = path or default_vocabulary("byte_bpe_50k.json")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = []
            for r in batch.to_pylist():
                edges = np.append(0, np.cumsum(r["leaf_chars"])).astype(int).tolist()
                tree = TokenTree([r["text"][a:b] for a, b in zip(edges, edges[1:], strict=False)], r["leaf_tokens"], path)
                for e in r["edits"] or ():
                    tree.edit(e["start"], e["end"], e["new"])
                made.append(tree)
            yield _kept(batch["doc_id"], made)

    return kept.mapInArrow(apply, _TREES)
