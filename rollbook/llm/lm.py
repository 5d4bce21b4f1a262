"""Language-model scoring with a weighted backoff automaton.

The model is of order three, each order smoothed with the one below it (Dirichlet weights), down to an additively
smoothed unigram:

    P(w)       = (c(w) + a) / (N + a (V + 1))
    P(w | v)   = (c(v w) + m P(w)) / (c(v) + m)
    P(w | u v) = (c(u v w) + m P(w | v)) / (c(u v) + m)

As an automaton: the root has an arc for every word, with weight log P(w). Every trained word v is a state, and so
is every trained pair u v. A state has an arc for each word that was trained after it, weighted with the smoothed
probability, and a failure arc of weight log(m / (c + m)), c being the state's count: from u v to v, from v to the
root. A word without an arc is read by way of the failure arcs, whose weights add up. Reading leads to the state of
the longest trained end of what was read: a pair, else a word, else the root.

No machine holds the whole automaton. Each block of texts gets just the states and arcs its own texts can
reach: blocks ask shards for the training counts of the distinct words, pairs and triples they hold (see
``exchange``). All counts cover the whole training set; nothing is pruned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.blocks import in_blocks
from rollbook.llm.exchange import ASKED, Keys, Route, ask, settle, totals_of
from rollbook.llm.words import Words, mix, sums, tally

#: Weight of the lower order in a state, in pseudo-counts.
BACKOFF_MASS = 4.0
ADD = 0.1
ORDER = 3
#: Bytes of text whose keys a shard holds.
SHARD_BYTES = 12 << 20
#: Bits of a pair's or triple's hash within its shard. A shard has a few million at any size of the input, so that
#: about one n-gram in a hundred million shares its count with another.
SHARD_BITS = 48
END = np.uint64(0x5EED0F7E97E9D0C5)
_ARC = np.uint64(0x9E3779B97F4A7C15)


class Grams:
    """Tokens of a block (words and an end for each text), and its distinct n-grams of each order, in order of hash.

    keys[k]: the distinct (k + 1)-grams with their training counts in the block; at[k]: the tokens that end one;
    of[k]: which of the distinct ones each of those ends. Of the hashes of pairs and triples the first ``bits`` count.
    """

    def __init__(self, text: pa.Array | pa.ChunkedArray, trained: np.ndarray, bits: int = 64) -> None:
        words = Words(text, fold=True)
        self.n = words.n + 1
        self.first = np.append(0, np.cumsum(self.n))
        self.tokens = np.empty(self.first[-1], np.uint64)
        self.is_end = np.zeros(len(self.tokens), bool)
        self.is_end[self.first[1:] - 1] = True
        self.tokens[~self.is_end], self.tokens[self.is_end] = words.hashes(), END
        weight = np.repeat(trained.astype(np.int64), self.n)
        place = np.arange(len(self.tokens)) - np.repeat(self.first[:-1], self.n)
        self.keys, self.at, self.of, gram = [], [], [], self.tokens
        for k in range(ORDER):
            at = np.flatnonzero(place >= k)
            if k:
                longer = np.zeros(len(gram), np.uint64)
                longer[1:] = mix(gram[:-1] * _ARC + self.tokens[1:] + np.uint64(k))
                gram = longer
            cut = np.uint64(64 - bits if k else 0)
            low, counts, of = tally(gram[at] >> cut << cut, weight[at])
            self.keys.append(Keys(low, counts))
            self.at.append(at)
            self.of.append(of)


class BackoffAutomaton:
    """The part of the automaton that a block's tokens can reach; weights are log10 probabilities.

    States are numbered: 0 the root, then the words, then the pairs of the block; those never trained are no states.
    ``arc[k]`` and ``trained[k]`` are by distinct (k + 1)-gram: the weight of the arc that reads its last word in the
    state of the words before, and whether there is one (the root reads every word).
    """

    def __init__(self, grams: Grams, counts: list[np.ndarray], tokens: int, vocabulary: int, add: float = ADD, mass: float = BACKOFF_MASS) -> None:
        self.trained = [c > 0 for c in counts]
        self.known = self.trained[0]
        n_states = 1 + sum(len(c) for c in counts[: ORDER - 1])
        first = np.append(1, 1 + np.cumsum([len(c) for c in counts[: ORDER - 1]]))
        self.order_of = np.zeros(n_states, np.int8)
        self.fail_to, self.fail_weight = np.zeros(n_states, np.int64), np.zeros(n_states)
        probability = [(counts[0] + add) / (tokens + add * (vocabulary + 1))]
        for k in range(1, ORDER):
            states = slice(first[k - 1], first[k])
            c = counts[k - 1]
            self.order_of[states] = k
            self.fail_weight[states] = np.log10(mass / (c + mass))
            if k > 1:  # without its first word; a trained pair's last word is trained
                shorter = np.zeros(len(c), np.int64)
                shorter[grams.of[k - 1]] = first[k - 2] + self._ending(grams, k - 2, grams.at[k - 1])
                self.fail_to[states] = shorter
            # c(h w) over the context h, the k words before, and the probability one order down
            context, lower = np.zeros(len(counts[k])), np.zeros(len(counts[k]))
            at = grams.at[k]
            context[grams.of[k]] = c[self._ending(grams, k - 1, at - 1)]
            lower[grams.of[k]] = probability[k - 1][self._ending(grams, k - 1, at)]
            probability.append((counts[k] + mass * lower) / (context + mass))
        self.arc = [np.log10(p) for p in probability]
        self._first = first

    @staticmethod
    def _ending(grams: Grams, k: int, at: np.ndarray) -> np.ndarray:
        """Which distinct (k + 1)-gram ends at each of the tokens; all must end one."""
        return grams.of[k][np.searchsorted(grams.at[k], at)]

    def states(self, grams: Grams) -> np.ndarray:
        """The state after each token: of the longest trained end of what its text has up to there. A text's end leads to the root."""
        after = np.zeros(len(grams.tokens), np.int64)
        for k in range(ORDER - 1):
            trained = self.trained[k][grams.of[k]]
            after[grams.at[k][trained]] = self._first[k] + grams.of[k][trained]
        after[grams.is_end] = 0
        return after

    def traverse(self, grams: Grams) -> np.ndarray:
        """log10 P of each token, read from left to right, all texts at once.

        A token starts in the state that the token before it led to. While that state has no arc for it the failure
        arc is followed and its weight added; then the arc is taken.
        """
        at = np.append(0, self.states(grams)[:-1])  # a text's first token starts in the root, where the text before ended
        weight = np.zeros(len(at))
        for k in range(ORDER - 1, 0, -1):
            here = np.flatnonzero(self.order_of[at] == k)
            gram = self._ending(grams, k, here)
            has = self.trained[k][gram]
            weight[here[has]] += self.arc[k][gram[has]]
            at[here[has]] = -1
            failed = here[~has]
            weight[failed] += self.fail_weight[at[failed]]
            at[failed] = self.fail_to[at[failed]]
        root = np.flatnonzero(at == 0)
        weight[root] += self.arc[0][grams.of[0][root]]
        return weight


_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score(docs: DataFrame, trained: str, route: Route | None = None) -> DataFrame:
    """Scores of every text under the model trained on the texts for which the SQL condition ``trained`` holds.

    docs needs doc_id and text; other columns are ignored. Per row: doc_id, held_out, n_tokens (words and the
    end), n_known (of them, those with a training count), train_tokens, base_score (unigram) and score (the
    automaton), both log10. A null text counts as empty: one end. A null id, or a condition that is null,
    trains nothing. Repeated rows count and are scored each; very long texts are taken whole. An empty table gives
    no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.expr(trained), F.lit(False)).alias("trained"))
    blocks = in_blocks(docs, "lm")
    route = route or Route.between(blocks.n, max(1, -(-blocks.n_bytes // SHARD_BYTES)))
    edges, bits = route.first, min(64, SHARD_BITS + route.shards.bit_length())
    sent = blocks.map(lambda block, batch: ask(block, Grams(batch["text"], batch["trained"].to_numpy(zero_copy_only=False), bits).keys, edges), ASKED)
    told = settle(sent, route, "counts")
    n = told.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("positive"), F.lit(0)).alias("vocabulary")).first()
    tokens, vocabulary = n["tokens"], n["vocabulary"]

    def read(block: int, batch: pa.RecordBatch, replies: pa.Table) -> pa.Table:
        is_trained = batch["trained"].to_numpy(zero_copy_only=False)
        grams = Grams(batch["text"], is_trained, bits)
        automaton = BackoffAutomaton(grams, totals_of(replies, grams.keys), tokens, vocabulary)
        base = automaton.arc[0][grams.of[0]]
        return pa.Table.from_arrays([
            batch["doc_id"], pa.array(~is_trained), pa.array(grams.n), pa.array(sums(automaton.known[grams.of[0]], grams.first)), pa.array(np.full(len(grams.n), tokens)),
            pa.array(sums(base, grams.first)), pa.array(sums(automaton.traverse(grams), grams.first)),
        ], schema=_SCORES)

    return blocks.meet(told.select("shard", "block", "reply"), read, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
