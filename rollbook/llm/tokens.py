"""Token ids of whole texts by way of their distinct pre-tokens.

A byte-level BPE first cuts a text at its pre-token pattern and never merges across such a cut. Between words
the pattern's cuts depend on white space alone, so a text is cut here into *chunks* (a word with the space
before it, or a run of white space), and each distinct chunk is encoded once per worker and kept.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa

from rollbook.llm.words import Words, hash_ranges, tally

#: Distinct chunks that a worker keeps; beyond them it starts anew.
KEPT_CHUNKS = 1 << 19
#: White space beyond ASCII. Texts with any are encoded whole: there, cuts depend on more than the ASCII spaces.
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def default_vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@cache
def byte_bpe(path: str) -> Callable[[str], list[int]]:
    """Encoder of a byte-level BPE file of the tokenizers library; special tokens in a text are ordinary text.

    Where the vocabulary numbers its tokens in merge order, as such files do, the same merges run in tiktoken,
    which is several times as fast; else the library itself encodes.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    made = [vocabulary[a + b] for a, b in pairs]
    if made == sorted(set(made)):
        import tiktoken

        alphabet = _byte_alphabet()
        special = {x["content"] for x in spec.get("added_tokens", ())}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        import public_tokenizers

        return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


class ChunkStore:
    """Ids of the chunks met so far, found by 64-bit hash."""

    def __init__(self, encode: Callable[[str], list[int]]) -> None:
        self.encode = encode
        self._clear()

    def _clear(self) -> None:
        self.keys, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.at, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def rows(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each chunk data[start:end] its row here: its ids are ids[at[row]:at[row + 1]]."""
        distinct, _, place = tally(hashes)
        some = np.empty(len(distinct), np.int64)
        some[place] = np.arange(len(place))
        if len(self.keys) + len(distinct) > KEPT_CHUNKS:
            self._clear()
        spot = np.searchsorted(self.keys, distinct)
        known = spot < len(self.keys)
        known[known] = self.keys[spot[known]] == distinct[known]
        new = np.flatnonzero(~known)
        if len(new):
            made = [self.encode(data[starts[i] : ends[i]].tobytes().decode()) for i in some[new]]
            sizes = np.array([len(x) for x in made], np.int64)
            rows = len(self.at) - 1 + np.arange(len(new))
            self.ids = np.concatenate([self.ids, np.fromiter((i for x in made for i in x), np.uint32, int(sizes.sum()))])
            self.at = np.append(self.at, self.at[-1] + np.cumsum(sizes))
            keys = np.concatenate([self.keys, distinct[new]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.row = keys[order], np.concatenate([self.row, rows])[order]
            spot = np.searchsorted(self.keys, distinct)
        return self.row[spot][place]

    def sizes(self, rows: np.ndarray) -> np.ndarray:
        return self.at[rows + 1] - self.at[rows]

    def gather(self, rows: np.ndarray) -> np.ndarray:
        """The ids of the rows, one after another."""
        sizes = self.sizes(rows)
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.at[rows] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


@cache
def byte_store(path: str) -> ChunkStore:
    return ChunkStore(byte_bpe(path))


def chunks(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the chunks of all texts in order, and first[d]: the first chunk of text d."""
    data, offsets = words.data, words.offsets
    head = np.repeat(offsets[:-1], words.n)
    previous = np.empty(len(words), np.int64)
    previous[1:], previous[:1] = words.ends[:-1], 0
    previous = np.maximum(previous, head)  # where the white space before a word starts
    run = words.starts - previous
    spaced = (run > 0) & (data[np.maximum(words.starts - 1, 0)] == 0x20)
    rest = run > 1
    last = (run > 0) & ~spaced
    tail = offsets[:-1].copy()
    some = words.n > 0
    tail[some] = words.ends[words.first[1:][some] - 1]
    tailed = tail < offsets[1:]
    starts = [words.starts - spaced, previous[rest], words.starts[last] - 1, tail[tailed]]
    ends = [words.ends, words.starts[rest] - 1, words.starts[last], offsets[1:][tailed]]
    starts, ends = np.concatenate(starts), np.concatenate(ends)
    whole = [d for d in range(len(words.n)) if _WIDE_SPACE.search(data[offsets[d] : offsets[d + 1]])] if _WIDE_SPACE.search(data) else []
    if whole:
        ok = ~np.isin(np.searchsorted(offsets, starts, "right") - 1, whole)
        starts, ends = np.append(starts[ok], offsets[whole]), np.append(ends[ok], offsets[np.array(whole) + 1])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    return starts, ends, np.searchsorted(starts, offsets)


def encode(texts: pa.Array | pa.ChunkedArray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and first[d]: the first id of text d."""
    store = byte_store(path)
    words = Words(texts)
    starts, ends, first = chunks(words)
    rows = store.rows(hash_ranges(words.data, starts, ends), words.data, starts, ends)
    return store.gather(rows), np.append(0, np.cumsum(store.sizes(rows)))[first]
