"""Secret scans: fixed patterns, and guess costs for whatever stands in a credential's place.

The guess cost of a value is the least number of guesses (log10) over all ways to cut it into spans, found by
dynamic programming over its positions: common words (by rank in a dictionary, with the usual substitutions),
word-like letters, dates, repeats, keyboard walks, and brute force for single characters. Every span of each kind
takes part. A value in a credential's context that is costly to guess is a secret, whatever its form; a cheap one
("password: required") is prose or a placeholder.

The dictionary has two parts: words that guessers' lists start with, then the words that are most frequent in all
the texts that are scanned, ranked by their count.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.words import Words, slices, tally
from rollbook.sources.shared import forget, written

KINDS = ("assign", "access", "hex", "guess")
#: log10 guesses from which a value counts as a secret.
LEAST_COST = 10.0
_ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_CONTEXT = re.compile(r"""(?ai:pass(?:word|wd|phrase|code)|pwd|secret|token|credential|bearer|authorization|(?:api|access|auth|private|client|encryption|signing|ssh)[ _-]?key)s?["']?\x20*(?:[:=]|=>|:=|\bis\b)\x20*["'`]?([^\s"'`,;<>(){}\[\]|]{6,})""")
#: A text without any of these (lower case) has no context.
_HINTS = ("passw", "passp", "passc", "pwd", "secret", "token", "credential", "bearer", "authorization", "key")
_KEYBOARD = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
#: Words that stand first in guessers' lists, most common first.
WORDS = (
    "password", "secret", "admin", "login", "welcome", "test", "user", "example", "default", "changeme", "change", "letmein", "dragon", "monkey", "master", "shadow", "root", "guest", "token",
    "key", "pass", "your", "here", "the", "none", "null", "true", "false", "required", "hidden", "value", "string", "my", "api", "access", "private", "public", "demo", "sample", "placeholder",
    "insert", "enter", "todo", "redacted", "xxxx", "foo", "bar", "baz", "love", "sunshine", "princess", "football", "baseball", "iloveyou", "summer", "winter", "spring", "autumn", "hello", "server",
    "database", "system", "service", "account", "name", "email", "company", "client", "config", "env", "environment", "process", "variable", "not", "and", "for", "new", "old", "data",
)
#: Words of the texts that the dictionary takes in, at most; their least and most bytes.
DICTIONARY, SHORTEST, LONGEST = 20_000, 3, 16
_NOT_LETTER = bytes(b for b in range(0x80) if not 0x61 <= b <= 0x7A)
_LEET = str.maketrans("013457@$!", "oieastasi")
_DATE = re.compile(r"(?:19|20)\d\d[-./]?(?:0[1-9]|1[0-2])[-./]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-./]?(?:0[1-9]|1[0-2])[-./]?(?:19|20)\d\d|(?:19|20)\d\d", re.ASCII)
_DATE_SIZES = (4, 8, 9, 10)
_CLASSES = ((re.compile(r"[0-9]"), 10), (re.compile(r"[a-z]"), 26), (re.compile(r"[A-Z]"), 26), (re.compile(r"[^0-9A-Za-z]"), 33))
#: log10 guesses for letters that alternate as words of a language do, whatever the word; so many vowels or consonants in a row are too many.
_WORDLIKE, _VOWELS, _MOST_VOWELS, _MOST_CONSONANTS = 6.0, frozenset("aeiouyáéíóúàèùâêôäöüåæø"), 3, 4
#: A walk's characters at most; a repeat's unit, and how often it occurs at least.
_LONGEST_WALK, _UNIT, _TIMES = 32, 4, 3
_WALKS = {row[i : i + 2] for row in _KEYBOARD for i in range(len(row) - 1)} | {row[i + 1] + row[i] for row in _KEYBOARD for i in range(len(row) - 1)}


def _capitals(span: str) -> float:
    return 0.0 if span == span.lower() else math.log10(2) if span in (span.upper(), span.capitalize()) else len(span) * math.log10(2)


class Guesser:
    """Guess costs under a dictionary: words, most common first."""

    def __init__(self, words: Sequence[str] = ()) -> None:
        self.rank = {w: math.log10(i + 2) for i, w in reversed(list(enumerate(dict.fromkeys([*WORDS, *words]))))}
        self.longest = max(map(len, self.rank))

    def cost(self, value: str, enough: float = math.inf) -> float:
        """log10 of the guesses that the cheapest segmentation of value takes; 0 for an empty one.

        Of a value that takes ``enough`` guesses only that much may be found out; so the time for one is linear.
        """
        n, low = len(value), value.lower()
        low = low if len(low) == n else value
        plain, rank = low.translate(_LEET), self.rank
        one = math.log10(sum(size for pattern, size in _CLASSES if pattern.search(value)) or 1)
        if not re.search("[^0-9a-f]", low) and re.search("[a-f]", low) and re.search("[0-9]", low):
            one = math.log10(16)
        cost = [0.0] * (n + 1)
        letters = vowels = consonants = walk = 0  # how many of the last characters are these
        streak = [0] * (_UNIT + 1)
        starts: list[dict[int, list[int]]] = [{} for _ in range(_UNIT + 1)]
        for j in range(1, n + 1):
            best, ch = cost[j - 1] + one, low[j - 1]
            for i in range(max(0, j - self.longest), j - 1):
                r = rank.get(low[i:j])
                if r is None:
                    r = rank.get(plain[i:j])
                    r = None if r is None else r + 0.5
                if r is not None:
                    best = min(best, cost[i] + r + _capitals(value[i:j]))
            if "0" <= ch <= "9":
                for size in _DATE_SIZES:
                    if size <= j and _DATE.fullmatch(value, j - size, j):
                        best = min(best, cost[j - size] + math.log10(120 * (365 if size > 4 else 1)))
            is_letter, is_vowel = ch.isalpha(), ch in _VOWELS
            letters, vowels, consonants = (letters + 1 if is_letter else 0), (vowels + 1 if is_vowel else 0), (consonants + 1 if is_letter and not is_vowel else 0)
            # Too long a run of vowels or consonants anywhere in a span bars it, so letters count from within such a run.
            letters = min(letters, _MOST_VOWELS if vowels > _MOST_VOWELS else letters, _MOST_CONSONANTS if consonants > _MOST_CONSONANTS else letters)
            for i in range(j - min(letters, LONGEST), j - SHORTEST + 1):
                span = value[i:j]
                if span in (span.lower(), span.upper(), span.capitalize()):
                    best = min(best, cost[i] + min(_WORDLIKE, (j - i) * math.log10(26)) + _capitals(span))
            walk = walk + 1 if low[j - 2 : j] in _WALKS and j > 1 else 1
            for i in range(j - min(walk, _LONGEST_WALK), j - 2):
                best = min(best, cost[i] + math.log10(47 * (j - i)) + _capitals(value[i:j]))
            for u in range(1, _UNIT + 1):
                streak[u] = streak[u] + 1 if j > u and ch == low[j - 1 - u] else 0
                if not streak[u]:
                    starts[u].clear()
                elif streak[u] >= (_TIMES - 1) * u:
                    # A start that an earlier one undercuts now is undercut for good: the longer a repeat, the less it matters.
                    kept: list[int] = []
                    least = math.inf
                    for i in [*starts[u].get(j % u, ()), j - _TIMES * u]:
                        c = cost[i] + u * one + math.log10((j - i) // u)
                        if c < least:
                            least = c
                            kept.append(i)
                    starts[u][j % u] = kept
                    best = min(best, least)
            cost[j] = best
            if j >= _LONGEST_WALK and best >= enough and min(cost[j - _LONGEST_WALK + 1 : j + 1]) >= enough and all(cost[i] + u * one >= enough for u in range(1, _UNIT + 1) for at in starts[u].values() for i in at):
                return enough
        return cost[n]


def guess_cost(value: str) -> float:
    """Under the guessers' words alone."""
    return Guesser().cost(value)


def dictionary(docs: DataFrame, most: int = DICTIONARY) -> list[str]:
    """The ``most`` most frequent words of all texts: runs of a-z (A-Z lower-cased) and non-ASCII characters of 3 to 16 bytes; ties by word.

    How many words there are by steps of their count (a few hundred numbers) tells from which count on words matter, so
    that hardly more than ``most`` are sorted and sent to the driver, however many tasks hold them.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(batch["text"], fold=True, separators=_NOT_LETTER)
            size = words.ends - words.starts
            at = np.flatnonzero((size >= SHORTEST) & (size <= LONGEST))
            _, n, place = tally(words.hashes()[at])
            some = np.empty(len(n), np.int64)
            some[place] = at
            yield pa.RecordBatch.from_arrays([pa.array([words.bytes_of(i) for i in some.tolist()], pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

    counted = written(docs.select("text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "dictionary")
    step = F.floor(F.log2("n") * 16)
    held, cut = 0, 0
    for r in counted.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect():
        held, cut = held + r["words"], r["step"]
        if held >= most:
            break
    out = [r["word"] for r in counted.where(step >= cut).orderBy(F.desc("n"), "word").limit(most).collect()]
    forget(counted)
    return out


def spans_of(text: str, guesser: Guesser | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then by kind as in KINDS. Matches of a kind do not overlap."""
    found, low = [], text.lower()
    if any(w in low for w in ("password", "passwd", "secret", "token", "api")):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    if any(w in low for w in _HINTS):
        for m in _CONTEXT.finditer(text):
            value = m[1].rstrip(".:!?")
            if (guesser or Guesser()).cost(value, LEAST_COST) >= LEAST_COST:
                found.append((m.start(1), m.start(1) + len(value), "guess"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def find_secrets(docs: DataFrame, words: Sequence[str] | None = None) -> DataFrame:
    """doc_id and secrets, an array of (start, end, kind) in code points, of every row.

    docs needs doc_id and text; other columns are ignored. Kinds: assign, access, hex (fixed patterns) and guess
    (a value in a credential's context that takes 10**LEAST_COST guesses). words is the dictionary after the
    guessers' own; without it that of all the texts. Spans that tie in their start go by kind. A null or empty text
    has none; null and repeated ids give a row each; an empty table gives no rows. Whole texts, values of any length.
    """
    guesser = Guesser(dictionary(docs) if words is None else words)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in slices(batches):
            found = [[{"start": a, "end": b, "kind": k} for a, b, k in spans_of(t, guesser)] if t else [] for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, kind)], names=["doc_id", "secrets"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(scan, f"doc_id {dict(docs.dtypes)['doc_id']}, secrets array<struct<start: bigint, end: bigint, kind: string>>")


def mask(text: str, found: list[tuple[int, int, str]], fill: str = "<SECRET>") -> str:
    """text with every run of overlapping spans replaced."""
    out, at = [], 0
    for start, end, _ in found:
        if start >= at:
            out += [text[at:start], fill]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, words: Sequence[str] | None = None) -> DataFrame:
    """docs, all rows and columns kept, with the secrets in text replaced by <SECRET>; n_chars, if there, follows.

    Each row is cleaned by its own text, so repeated rows stay alike; null and empty texts stay as they are. words as
    in ``find_secrets``.
    """
    guesser = Guesser(dictionary(docs) if words is None else words)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch["text"].to_pylist()
            found = [spans_of(t, guesser) if t else [] for t in texts]
            if not any(found):
                yield batch
                continue
            new = pa.array([mask(t, f) if f else t for t, f in zip(texts, found, strict=True)], batch["text"].type)
            columns = {c: new if c == "text" else batch[c] for c in batch.schema.names}
            if "n_chars" in columns:
                counts = [len(t) if f else n for t, f, n in zip(new.to_pylist(), found, batch["n_chars"].to_pylist(), strict=True)]
                columns["n_chars"] = pa.array(counts, batch["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.mapInArrow(clean, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """The counts and joined spans of the rows of find_secrets."""
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.filter("secrets", lambda s: s["kind"] == kind)
    *counts, guesses = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    base = joined(F.filter("secrets", lambda s: s["kind"] != "guess"))
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"), guesses)
