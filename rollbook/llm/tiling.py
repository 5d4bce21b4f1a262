"""Benchmark decontamination by greedy string tiling.

A benchmark item is matched against a text by tiles: the longest run of words that both share and that no
earlier tile has used, again and again, down to runs of ``least`` words. The share of the item's words that
tiles cover does not depend on their order, so passages that were shuffled are found as well.

Seeds, runs of ``least`` words found by their Karp-Rabin hashes, tell which items a text may hold at all and which
of its words matter. Tiling then runs Karp-Rabin at falling lengths over the words that no tile has used: the
longest length at which text and item still share a run is found by bisection, all its tiles are marked, and so
on. Pairs of places are never listed, so memory is linear in the text even where all words are equal. Items come
in blocks of bounded size, each sent to every task, so texts are read once for each block of the benchmark and
never move.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.words import NOT_ALNUM, Words, covered, slices, window_starts, windows

LEAST_RUN = 5
COVERAGE = 0.5
#: Bytes of benchmark text that are sent to every task at once.
BLOCK_BYTES = 8 << 20


def _free(used: np.ndarray, n: int) -> np.ndarray:
    """Places from which n words are unused."""
    total = np.append(0, np.cumsum(used))
    return np.flatnonzero(total[n:] == total[:-n])


def tile(text: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in text, place in item, words) of two sequences of word hashes.

    Ties go to the match that comes first in the text, then in the item.
    """
    in_text, in_item = np.zeros(len(text), bool), np.zeros(len(item), bool)
    tiles: list[tuple[int, int, int]] = []

    def shared(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of free runs of n words that the other has too, and their hashes: in the text, in the item."""
        at, to = _free(in_text, n), _free(in_item, n)
        a, b = windows(text, n)[at], windows(item, n)[to]
        known = np.unique(b)
        hit = known[np.minimum(np.searchsorted(known, a), len(known) - 1)] == a if len(known) else np.zeros(len(a), bool)
        return at[hit], a[hit], to, b

    longest = min(len(text), len(item))
    while longest >= least:
        low, high = least - 1, longest  # runs of low are shared or too short, none of more than high is
        while low < high:
            n = (low + high + 1) // 2
            low, high = (n, high) if len(shared(n)[0]) else (low, n - 1)
        if low < least:
            break
        longest = low
        at, a, to, b = shared(longest)
        order = np.argsort(b, kind="stable")
        places = dict(zip((known := np.unique(b)).tolist(), np.split(to[order], np.searchsorted(b[order], known)[1:]), strict=True))
        left = {k: 0 for k in np.unique(a).tolist()}  # how many of a hash's places in the item are passed
        after = 0
        for i, k in zip(at.tolist(), a.tolist(), strict=True):
            if i < after or k not in left:
                continue
            mine = places[k]
            while left[k] < len(mine) and in_item[mine[left[k]] : mine[left[k]] + longest].any():
                left[k] += 1
            if left[k] == len(mine):
                del left[k]
                if not left:
                    break
                continue
            j = int(mine[left[k]])
            tiles.append((i, j, longest))
            after = i + longest
            in_text[i:after] = in_item[j : j + longest] = True
        longest -= 1
    return tiles


class Items:
    """Words and seeds of a block of benchmark items. Items of fewer than ``least`` words have no seeds."""

    def __init__(self, texts: list[str | None], least: int) -> None:
        words = Words(pa.array(texts, pa.string()), fold=True, separators=NOT_ALNUM)
        starts = window_starts(words, least)
        self.hashes, self.first, self.least, self.n = words.hashes(), words.first, least, words.n
        keys = windows(self.hashes, least)[starts]
        order = np.argsort(keys, kind="stable")
        self.start, self.item = starts[order], words.text_of_word()[starts][order]
        self.keys, self.at = np.unique(keys[order], return_index=True)
        self.at = np.append(self.at, len(keys))

    def leaks(self, texts: pa.Array, coverage: float) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """(text, item, tiles) wherever tiles cover enough of the item."""
        if not len(self.keys):
            return
        words = Words(texts, fold=True, separators=NOT_ALNUM)
        starts, hashes = window_starts(words, self.least), words.hashes()
        keys = windows(hashes, self.least)[starts]
        seed = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[seed] == keys
        at, seed = starts[hit], seed[hit]
        text = words.text_of_word()[at]
        for d in np.unique(text).tolist():
            mine = slice(*np.searchsorted(text, [d, d + 1]))
            own = np.unique(seed[mine])
            n = np.diff(self.at)[own]
            which = np.repeat(self.at[own] - np.cumsum(n) + n, n) + np.arange(n.sum())  # every seed of an item is there once
            of, key = self.item[which], np.repeat(own, n)
            order = np.argsort(of, kind="stable")
            for item, some in zip((items := np.unique(of)).tolist(), np.split(order, np.searchsorted(of[order], items)[1:]), strict=True):
                a, b = self.first[item], self.first[item + 1]
                if covered(self.start[which[some]] - a, self.least, b - a).sum() < coverage * self.n[item]:
                    continue
                shared = at[mine][np.isin(seed[mine], key[some])] - words.first[d]
                place = np.flatnonzero(covered(shared, self.least, words.n[d]))
                # Of the text only words in seeds matter; where there is a gap a hash that no item has stands in it.
                gap = np.flatnonzero(np.diff(place) > 1) + 1
                short = np.insert(hashes[words.first[d] + place], gap, np.uint64(0))
                back = np.insert(place, gap, -1)
                tiles = [(int(back[i]), j, k) for i, j, k in tile(short, self.hashes[a:b], self.least)]
                if sum(t[2] for t in tiles) >= coverage * self.n[item]:
                    yield d, item, tiles


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items in blocks of about BLOCK_BYTES, one in the driver at a time."""
    size = benchmark.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    blocks = -(-size // BLOCK_BYTES)
    for k in range(blocks):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).select(F.col("item_id").cast("long"), "text").collect()
        yield [(r[0], r[1]) for r in rows]


_LEAKS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_words", pa.int64()), ("covered_words", pa.int64()), ("n_tiles", pa.int64()), ("longest_tile", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.list_(pa.list_(pa.int64())))])
_LEAKS_DDL = "doc_id bigint, item_id bigint, item_words bigint, covered_words bigint, n_tiles bigint, longest_tile bigint, coverage double, tiles array<array<bigint>>"


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST_RUN, coverage: float = COVERAGE) -> DataFrame:
    """Pairs of a text and a benchmark item of which tiles of ``least`` words and more cover at least ``coverage``.

    docs needs doc_id and text, benchmark item_id and text; other columns are ignored. Words are runs of ASCII
    letters and digits (A-Z lower-cased) and non-ASCII characters. Per pair: doc_id, item_id, item_words,
    covered_words, n_tiles, longest_tile, coverage and the tiles (place in text, place in item, words; in words
    from 0). Ties between tiles go to the text's first place, then the item's. Null and empty texts, and items of
    fewer than ``least`` words, match nothing. Very long texts are taken whole. Repeated rows, of either table, give
    a row each. Without items or texts there are no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def against(rows: list[tuple[int | None, str | None]]) -> DataFrame:
        ids, items = [r[0] for r in rows], Items([r[1] for r in rows], least)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                found = [
                    {"doc_id": batch["doc_id"][d].as_py(), "item_id": ids[i], "item_words": int(items.n[i]), "covered_words": (n := sum(t[2] for t in tiles)), "n_tiles": len(tiles), "longest_tile": max(t[2] for t in tiles), "coverage": n / int(items.n[i]), "tiles": [list(t) for t in sorted(tiles)]}
                    for d, i, tiles in items.leaks(batch["text"], coverage)
                ]
                if found:
                    yield pa.RecordBatch.from_pylist(found, _LEAKS)

        return docs.mapInArrow(search, _LEAKS_DDL)

    found = [against(rows) for rows in _blocks(benchmark)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], _LEAKS_DDL)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST_RUN, coverage: float = COVERAGE) -> DataFrame:
    """docs, all columns kept, without the rows that find_leaks pairs with any item.

    Rows are judged by their own text alone, so repeated rows fare alike and ids, null or not, do not matter; null and
    empty texts stay.
    """
    for rows in _blocks(benchmark):
        items = Items([r[1] for r in rows], least)

        def keep(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                kept = np.ones(batch.num_rows, bool)
                kept[[d for d, *_ in items.leaks(batch["text"], coverage)]] = False
                yield batch.filter(pa.array(kept))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
