"""Quality rules from tokeniser fertility.

Two public vocabularies read every word of a text (white space normalised to one space before each word): a
byte-level BPE and a piece BPE with byte fallback. Per text they give characters per token under either, the
share of byte-fallback tokens, and the entropy of the byte-level tokens. Prose of a language keeps to narrow
bands of these; symbol noise, tables, shouting, repetition and broken encodings do not.

A band belongs to a language, or to a script where the language is unknown, and comes from texts that are
known to be good, from all of them. Entropy also grows with length, so its band is per doubling of the token
count; a doubling with too few good texts takes the least entropy of the nearest shorter one, which holds for
longer texts as well. Bands need every good text's measures before any verdict, so ``measure`` is a step of its
own: its table, once written, serves both ``learn`` and the verdicts, and each text is tokenised once.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rollbook.llm.blocks import give_back
from rollbook.llm.quantiles import bits, quantiles
from rollbook.llm.tokens import ChunkStore, byte_bpe, default_vocabulary
from rollbook.llm.words import Words, covered, mix, slices, sums, tally, window_starts, windows
from rollbook.sources.shared import forget, written

#: Bytes of text that are judged at a time: the arrays of two vocabularies are a hundred times as large.
SLICE_BYTES = 1 << 20
#: A band needs this many texts.
LEAST_ROWS = 40
#: First bytes of UTF-8 characters, by script, for texts without a language: all that matters is that scripts differ.
_SCRIPTS = {"latin": (0x41, 0xCC), "greek": (0xCD, 0xCF), "cyrillic": (0xD0, 0xD4), "semitic": (0xD5, 0xDF), "indic": (0xE0, 0xE0), "other": (0xE1, 0xE2), "east": (0xE3, 0xED), "rest": (0xEE, 0xFF)}
Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
MEASURES = ("chars_per_token", "chars_per_piece", "byte_share")


def base_counts(words: Words) -> dict[str, np.ndarray]:
    data, first = words.data, words.first
    symbol = np.zeros(256, bool)
    symbol[list(b"#*$%&|<>")] = True
    hashes = words.hashes()
    starts = window_starts(words, 8)
    keys = mix(windows(hashes, 8)[starts] + words.text_of_word()[starts].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, counts, place = tally(keys)
    repeated = covered(starts[counts[place] > 1], 8, len(words))
    duplicates = []
    for d in range(len(words.n)):
        lines = [x for x in data[words.offsets[d] : words.offsets[d + 1]].tobytes().split(b"\n") if x.strip()]
        duplicates.append(len(lines) - len(set(lines)))
    return {
        "n_words": words.n, "word_chars": sums(words.inside & ((data & 0xC0) != 0x80), words.offsets), "n_symbols": sums(symbol[data], words.offsets),
        "n_dup_lines": np.array(duplicates, np.int64), "n_repeat_words": sums(repeated, first),
    }


@cache
def _stores(byte_path: str, piece_path: str) -> tuple[ChunkStore, ChunkStore, np.ndarray]:
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
    encode = byte_bpe(byte_path)
    return ChunkStore(lambda word: encode(" " + word)), ChunkStore(pieces.encode), np.array([pieces.is_byte(i) for i in range(pieces.get_piece_size())])


def fertility(words: Words, byte_path: str, piece_path: str) -> dict[str, np.ndarray]:
    """chars_per_token, chars_per_piece, byte_share, entropy (bits) and n_tokens of every text; 0 without words."""
    by_byte, by_piece, is_byte = _stores(byte_path, piece_path)
    hashes, first = words.hashes(), words.first
    at = np.append(0, np.cumsum((words.data & 0xC0) != 0x80))
    chars = sums(at[words.ends] - at[words.starts], first)
    rows = by_byte.rows(hashes, words.data, words.starts, words.ends)
    n_tokens = sums(by_byte.sizes(rows), first)
    ids = by_byte.gather(rows).astype(np.uint64)
    texts = np.repeat(np.arange(len(words.n), dtype=np.uint64), n_tokens)
    pairs, counts, _ = tally((texts << np.uint64(32)) | ids)
    text = (pairs >> np.uint64(32)).astype(np.int64)
    share = counts / np.maximum(n_tokens, 1)[text]
    entropy = np.bincount(text, -share * np.log2(share), len(words.n))
    rows = by_piece.rows(hashes, words.data, words.starts, words.ends)
    n_pieces = sums(by_piece.sizes(rows), first)
    in_row = np.add.reduceat(np.append(is_byte[by_piece.ids], False).astype(np.int64), by_piece.at[:-1]) * (np.diff(by_piece.at) > 0) if len(by_piece.ids) else np.zeros(len(by_piece.at) - 1, np.int64)
    n_bytes = sums(in_row[rows], first)
    return {"chars_per_token": chars / np.maximum(n_tokens, 1), "chars_per_piece": chars / np.maximum(n_pieces, 1), "byte_share": n_bytes / np.maximum(n_pieces, 1), "entropy": entropy, "n_tokens": n_tokens}


def script(data: bytes) -> str:
    """The script with most letters, by their first bytes."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    counts[0x80:0xC0] = 0
    return max(_SCRIPTS, key=lambda s: counts[_SCRIPTS[s][0] : _SCRIPTS[s][1] + 1].sum())


@dataclass
class Bands:
    """(low, high) by group and measure, and the least entropy by group and doubling of the token count."""

    ranges: dict[tuple[str, str], tuple[float, float]] = field(default_factory=dict)
    entropy: dict[tuple[str, int], float] = field(default_factory=dict)

    @classmethod
    def fit(cls, rows: list[tuple[str, str, dict[str, float]]], tail: float = 0.005, slack: float = 0.4) -> Bands:
        """rows: language, script and measures of good texts. A band spans all but the tails, and slack times that width more on either side."""
        values = defaultdict(list)
        for language, letters, x in rows:
            for group in (f"lang:{language}", f"script:{letters}"):
                for m in MEASURES:
                    values[group, m, -1].append(x[m])
                values[group, "entropy", int(math.log2(max(1, x["n_tokens"])))].append(x["entropy"])
        return cls.of({key: np.quantile(v, cls.levels(key[1], tail)) for key, v in values.items() if len(v) >= LEAST_ROWS}, slack)

    @staticmethod
    def levels(measure: str, tail: float = 0.005) -> list[float]:
        """The quantiles that the band of a measure is made of."""
        return [tail, 0.5] if measure == "entropy" else [tail, 1 - tail]

    @classmethod
    def of(cls, found: dict[tuple[str, str, int], Sequence[float]], slack: float = 0.4) -> Bands:
        """found: those quantiles by group, measure and doubling (of entropy, else -1)."""
        bands = cls()
        for (group, m, doubling), (low, high) in found.items():
            if m == "entropy":
                bands.entropy[group, doubling] = float(low - slack * (high - low))
            else:
                bands.ranges[group, m] = float(low - slack * (high - low)), float(high + max(slack * (high - low), 0.02))
        return bands

    def verdict(self, language: str | None, letters: str, x: dict[str, float]) -> str | None:
        """The measure that leaves its band, or None. Without a band for the language or the script nothing is rejected."""
        group = next((g for g in (f"lang:{language}", f"script:{letters}") if (g, MEASURES[0]) in self.ranges), "")
        for m in MEASURES:
            low, high = self.ranges.get((group, m), (-math.inf, math.inf))
            if not low <= x[m] <= high:
                return m
        return "entropy" if x["entropy"] < self.least_entropy(language, letters, x["n_tokens"]) else None

    def least_entropy(self, language: str | None, letters: str, n_tokens: float) -> float:
        """The bound of the nearest fitted doubling that is not longer, of the language, else of the script; without one -inf."""
        at = range(int(math.log2(max(1, n_tokens))), -1, -1)
        return next((self.entropy[g, k] for g in (f"lang:{language}", f"script:{letters}") for k in at if (g, k) in self.entropy), -math.inf)


_MEASURED = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, chars_per_token double, chars_per_piece double, byte_share double, entropy double, n_tokens bigint, base_failed boolean"
_ADDED = f"{_MEASURED}, kept boolean, rejected_by string"
ADDED = [x.split()[0] for x in _ADDED.split(", ")]
_GROUPS = "language string, script string"


def _paths(byte_path: str | None, piece_path: str | None) -> tuple[str, str]:
    return byte_path or default_vocabulary("byte_bpe_50k.json"), piece_path or default_vocabulary("piece_bpe_32k.model")


def _fields(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def _measures(batch: pa.RecordBatch, byte_path: str, piece_path: str) -> dict[str, pa.Array]:
    """The columns of _MEASURED and _GROUPS."""
    words = Words(batch["text"])
    x = base_counts(words) | fertility(words, byte_path, piece_path)
    x["base_failed"] = (x["n_words"] < 20) | (100 * x["n_repeat_words"] > 30 * x["n_words"])
    languages = batch["lang"].cast(pa.string()) if "lang" in batch.schema.names else pa.nulls(batch.num_rows, pa.string())
    scripts = [script(words.data[words.offsets[d] : words.offsets[d + 1]].tobytes()) for d in range(batch.num_rows)]
    return {c: pa.array(x[c]) for c in ADDED[:-2]} | {"language": languages, "script": pa.array(scripts, pa.string())}


def _rejected(x: dict[str, pa.Array], bands: Bands) -> pa.Array:
    """By what each text is rejected: base, or a measure; null if it is kept."""
    measures = [dict(zip((*MEASURES, "entropy", "n_tokens"), map(float, v), strict=True)) for v in zip(*(x[m].to_pylist() for m in (*MEASURES, "entropy", "n_tokens")), strict=True)]
    return pa.array(["base" if f else bands.verdict(a, b, m) for f, a, b, m in zip(x["base_failed"].to_pylist(), x["language"].to_pylist(), x["script"].to_pylist(), measures, strict=True)], pa.string())


def _free_name(docs: DataFrame) -> str:
    name, taken = "measured", {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _take(paths: tuple[str, str], name: str) -> Batches:
    """Adds the measures to a table's batches, as a struct of that name."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE_BYTES):
            x = _measures(batch, *paths)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(list(x.values()), list(x))], names=[*batch.schema.names, name])
            give_back()

    return take


def _judge(bands: Bands, own: list[str]) -> Batches:
    """The own columns of measured batches with all that ``rules`` adds."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unpack(batch)
            rejected = _rejected(x, bands)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in own), *(x[c] for c in ADDED[:-2]), rejected.is_null(), rejected], names=[*own, *ADDED])

    return judge


def _choose(bands: Bands) -> Batches:
    """Measured batches without their measures and without the rows that are rejected."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = _rejected(_unpack(batch), bands).is_null()
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]).filter(ok)

    return choose


def _judged_schema(fields: StructType) -> tuple[list[str], str]:
    own = StructType([f for f in fields if f.name.lower() not in ADDED])
    return own.names, ", ".join(x for x in (_fields(own), _ADDED) if x)


def rules(docs: DataFrame, bands: Bands, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """docs with the counts, the fertility measures, base_failed, kept and rejected_by (base, or a measure).

    docs needs text; lang chooses the band if it is there, else (or if null, or without a band) the script does.
    A null text has no words and fails the base rule. Rows keep their columns; those called as an added one are
    replaced. Repeated rows are judged alike; very long texts are measured whole; an empty table gives no rows. One
    pass, no exchange.
    """
    own, schema = _judged_schema(docs.schema)
    take, judge = _take(_paths(byte_path, piece_path), _free_name(docs)), _judge(bands, own)
    return docs.mapInArrow(lambda batches: judge(take(batches)), schema)


def keep(docs: DataFrame, bands: Bands, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """The rows of docs that ``rules`` keeps, with docs' own columns."""
    take, choose = _take(_paths(byte_path, piece_path), _free_name(docs)), _choose(bands)
    return docs.mapInArrow(lambda batches: choose(take(batches)), docs.schema)


def measure(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """docs with one more column, the last: a struct of all that ``rules`` adds but the verdict, with the language and the script."""
    name = _free_name(docs)
    return docs.mapInArrow(_take(_paths(byte_path, piece_path), name), f"{_fields(docs.schema)}, `{name}` struct<{_MEASURED}, {_GROUPS}>")


def judged(measured: DataFrame, bands: Bands) -> DataFrame:
    """The table that ``rules`` gives, from one that ``measure`` gave (texts may have been dropped since)."""
    own, schema = _judged_schema(measured.schema[:-1])
    return measured.mapInArrow(_judge(bands, own), schema)


def kept(measured: DataFrame, bands: Bands) -> DataFrame:
    """The table that ``keep`` gives, from one that ``measure`` gave."""
    return measured.mapInArrow(_choose(bands), measured.schema[:-1])


def _unpack(batch: pa.RecordBatch) -> dict[str, pa.Array]:
    struct = batch.column(batch.num_columns - 1)
    return dict(zip([f.name for f in struct.type], struct.flatten(), strict=True))


def learn(measured: DataFrame, good: DataFrame) -> Bands:
    """Bands from all rows of a table that ``measure`` gave whose doc_id is in good and that pass the base rule.

    Every such row counts, those that share an id as well; an id that good repeats counts once. Null ids and texts
    teach nothing. What moves is the measures, not the texts: they are written once as a small table, whose quantiles
    are found by counting (``quantiles``), so neither a task nor the driver holds the measures of a group. The driver
    holds the bands: a few numbers for each language, script and doubling that enough good texts have.
    """
    x = f"`{measured.columns[-1]}`"
    found = measured.where(f"doc_id is not null and not {x}.base_failed").select("doc_id", *(f"{x}.{c}" for c in ("language", "script", "n_tokens", *MEASURES, "entropy"))).join(good.select("doc_id"), "doc_id", "leftsemi")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doubling = np.frexp(np.maximum(1, batch["n_tokens"].to_numpy()))[1] - 1
            yield pa.RecordBatch.from_arrays([batch["language"], batch["script"], pa.array(doubling, pa.int32()), *(pa.array(bits(batch[m].to_numpy())) for m in (*MEASURES, "entropy"))], names=["language", "script", "doubling", *MEASURES, "entropy"])

    coded = written(found.mapInArrow(code, f"{_GROUPS}, doubling int, " + ", ".join(f"{m} bigint" for m in (*MEASURES, "entropy"))), "taught")
    groups = F.array(F.concat(F.lit("lang:"), F.coalesce("language", F.lit("None"))), F.concat(F.lit("script:"), "script"))
    items = [F.struct(F.lit(m).alias("measure"), (F.col("doubling") if m == "entropy" else F.lit(-1)).alias("doubling"), F.col(m).alias("bits")) for m in (*MEASURES, "entropy")]
    values = coded.select("*", F.explode(groups).alias("group")).select("group", F.explode(F.array(*items)).alias("_")).select("group", "_.*")
    out = Bands.of(quantiles(values, lambda key: Bands.levels(key[1]), least=LEAST_ROWS))
    forget(coded)
    return out


def fit(docs: DataFrame, good: DataFrame, most: int | None = None, byte_path: str | None = None, piece_path: str | None = None) -> Bands:
    """``learn`` on docs as they are: every text is measured, none is moved.

    All ids in good teach; a caller who wants a rough fit may have ``most`` of them, taken by hash, but no query does.
    """
    if most is not None:
        good = good.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    language = ["lang"] if "lang" in docs.columns else []
    return learn(measure(docs.select("doc_id", "text", *language), byte_path, piece_path).drop("text", *language), good)
