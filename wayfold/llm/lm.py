"""Language-model scores of whole texts by a weighted backoff automaton.

States are the n-gram contexts of the training texts. A state has an arc for each word that followed it in training,
with weight log10((c(hw) + mu * P(w | h')) / (c(h) + mu)), and a failure arc of weight log10(mu / (c(h) + mu)) to the
state of the shorter context h'. The state without context has arcs of weight log10((c(w) + 0.5) / (N + 0.5 * (V + 1))),
and one for all other words. This is Dirichlet smoothing: each state's weights are a proper distribution. A text is
traversed once from left to right: each word takes its arc, or failure arcs down to a state that has one, and leads to
the state of the longest context that training knows. Many texts, and stretches of long ones, are traversed side by side.

The automaton has as many arcs as the corpus has n-grams and may exceed any memory. Each part of the texts therefore
gets the counts of the n-grams that its own words make up (counts.py), builds the states, arcs and failure arcs that its
words can reach, and traverses them in a task.

Words: A-Z lower-cased, split at ASCII white space, then one end token. Nulls: a null text is empty, scored by its end
token alone; a null key stays; a null `learn` counts as False. Repeated rows count as often as they come. An empty
table gives no rows; with no training text, every count is 0. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.bytescan import column_bytes, mix, word_hashes
from wayfold.llm.counts import Grams, corpus_counts, parts

_END = np.uint64(0x1F3D5B79A2C4E680)
_BEGIN = np.uint64(0x7C6A5B4D3E2F1908)
_STEP = np.uint64(0xA0761D6478BD642F)
#: Words in an n-gram, and the weight of the shorter context by the length of the n-gram (2, 3, ...), chosen by held-out
#: log-probability a token at sf0.1: -3.78 with order 2 and 256, -3.53 with these, -3.45 with order 4 and (256, 8, 1).
ORDER = 3
MU = (256.0, 8.0)
#: Tokens of a text that one lane of the traversal reads.
STRETCH = 256
#: The states of no context and of a text's begin.
_ROOT, _START = 0, 1


@dataclass
class Ngrams:
    """The 1- to n-grams of a part of the texts; a text's first word has the begin before it, and no earlier context."""

    starts: np.ndarray
    place: np.ndarray
    #: by length - 1: sorted distinct hashes, a position where each ends, and the n-gram that ends at each position (-1: none)
    keys: list[np.ndarray]
    first: list[np.ndarray]
    at: list[np.ndarray]

    @classmethod
    def of(cls, part: pa.Table, order: int) -> Ngrams:
        hashes, starts = word_hashes(*column_bytes(part["text"]))
        tokens = np.insert(hashes, starts[1:], _END)
        starts = starts + np.arange(len(starts))
        place = np.arange(len(tokens)) - np.repeat(starts[:-1], np.diff(starts))
        found = cls(starts, place, [], [], [])
        rolled = tokens
        for n in range(1, order + 1):
            if n > 1:
                earlier = np.full(len(tokens), _BEGIN)
                earlier[n - 1 :] = tokens[: max(0, len(tokens) - n + 1)]
                earlier[place == n - 2] = _BEGIN
                rolled = mix(rolled * _STEP + mix(earlier + np.uint64(n)))
            there = np.flatnonzero(place >= n - 2)
            keys, first, which = np.unique(rolled[there], return_index=True, return_inverse=True)
            at = np.full(len(tokens), -1, dtype=np.int32)
            at[there] = which
            found.keys.append(keys)
            found.first.append(there[first].astype(np.int32))
            found.at.append(at)
        return found

    def counted(self, learn: pa.ChunkedArray) -> Grams:
        """What the texts to learn from add to each n-gram's count."""
        taken = np.repeat(pc.fill_null(learn, False).to_numpy(zero_copy_only=False).astype(bool), np.diff(self.starts))
        return {n: (keys, np.bincount(at[taken & (at >= 0)], minlength=len(keys))) for n, (keys, at) in enumerate(zip(self.keys, self.at, strict=True), 1)}


class Automaton:
    """States by number, with arcs (state, word) -> (state, weight) and a failure arc each but for the root."""

    def __init__(self, words: int, other: float, failure: tuple[np.ndarray, np.ndarray], arcs: tuple[np.ndarray, ...], begins: bool):
        source, word, to, weight = arcs
        key = source.astype(np.int64) * words + word
        order = np.argsort(key)
        self.words, self.other, self.begins = words, other, begins
        self.fail_to, self.fail_weight = failure
        self.arc, self.arc_to, self.arc_weight = key[order], to[order], weight[order]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states that words lead to, and the weights on the way."""
        to, weight = np.zeros(len(state), dtype=np.int64), np.zeros(len(state))
        waiting, at = np.arange(len(state)), state
        while len(waiting):
            place = np.searchsorted(self.arc, key := at * self.words + word[waiting])
            taken = self.arc[np.minimum(place, len(self.arc) - 1)] == key if len(self.arc) else np.zeros(len(key), dtype=bool)
            to[waiting[taken]] = self.arc_to[place[taken]]
            weight[waiting[taken]] += self.arc_weight[place[taken]]
            waiting, at = waiting[~taken], at[~taken]
            weight[waiting] += np.where(at == _ROOT, self.other, self.fail_weight[at])
            left = at != _ROOT
            waiting, at = waiting[left], self.fail_to[at[left]]
        return to, weight

    def traverse(self, word: np.ndarray, starts: np.ndarray, longest: int) -> np.ndarray:
        """The weight of each text. A stretch of a long text begins in the state to which the `longest` words before it lead."""
        stretches = -(-np.diff(starts) // STRETCH)
        text = np.repeat(np.arange(len(stretches)), stretches)
        number = np.arange(len(text)) - np.repeat(np.cumsum(stretches) - stretches, stretches)
        begin = starts[text] + number * STRETCH
        length = np.minimum(STRETCH, starts[text + 1] - begin)
        order = np.argsort(-length, kind="stable")
        text, number, begin, length = text[order], number[order], begin[order], length[order]
        state = np.where(number == 0, _START if self.begins else _ROOT, _ROOT)
        later = np.flatnonzero(number > 0)
        for back in range(longest, 0, -1):
            state[later] = self.step(state[later], word[begin[later] - back])[0]
        total = np.zeros(len(text))
        for k in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -k))  # the stretches that are longer than k
            state[:n], weight = self.step(state[:n], word[begin[:n] + k])
            total[:n] += weight
        return np.bincount(text, weights=total, minlength=len(stretches))


def build(grams: Ngrams, count: list[np.ndarray], every: int, distinct: int, mu: tuple[float, ...]) -> tuple[Automaton, np.ndarray]:
    """The automaton of a part's n-grams with these counts, and the weights of words without context."""
    order, words = len(count), grams.at[0]
    end = int(np.searchsorted(grams.keys[0], _END))
    begun = int(count[0][end]) if end < len(count[0]) and grams.keys[0][end] == _END else 0
    state_of, number = [], 2
    fail_to, fail_weight = [np.array([_ROOT, _ROOT])], [np.array([0.0, np.log10(mu[0] / (begun + mu[0])) if order > 1 else 0.0])]
    for n in range(1, order):
        first = grams.first[n - 1]
        seen = (count[n - 1] > 0) & (words[first] != end)
        states = np.where(seen, number + np.cumsum(seen) - 1, -1)
        number += int(seen.sum())
        shorter = state_of[n - 2][grams.at[n - 2][first[seen]]] if n > 1 else np.full(int(seen.sum()), _ROOT)
        state_of.append(states)
        fail_to.append(shorter)
        fail_weight.append(np.log10(mu[n - 1] / (count[n - 1][seen] + mu[n - 1])))
    weights = [np.log10((count[0] + 0.5) / (every + 0.5 * (distinct + 1)))]
    arcs = []
    for n in range(1, order + 1):
        first = grams.first[n - 1]
        if n > 1:
            before = np.maximum(first - 1, 0)
            opens = grams.place[first] == 0
            context = np.where(opens, -1, grams.at[n - 2][before])
            held = np.where(opens, begun, count[n - 2][context]) if len(first) else np.zeros(0)
            source = np.where(opens, _START, state_of[n - 2][context]) if len(first) else np.zeros(0, dtype=np.int64)
            less = weights[n - 2][grams.at[n - 2][first]]
            weights.append(np.log10((count[n - 1] + mu[n - 2] * 10.0**less) / (held + mu[n - 2])))
        else:
            source = np.full(len(first), _ROOT)
        seen = count[n - 1] > 0
        kept = state_of[min(n, order - 1) - 1][grams.at[min(n, order - 1) - 1][first]] if order > 1 else np.full(len(first), _ROOT)
        to = np.where(words[first] == end, _ROOT, kept)
        arcs.append((source[seen], words[first][seen], to[seen], weights[n - 1][seen]))
    other = float(np.log10(0.5 / (every + 0.5 * (distinct + 1))))
    columns = tuple(np.concatenate(c) for c in zip(*arcs, strict=True))
    return Automaton(max(1, len(grams.keys[0])), other, (np.concatenate(fail_to), np.concatenate(fail_weight)), columns, begun > 0 and order > 1), weights[0]


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", learn: str = "learn", order: int = ORDER, mu: tuple[float, ...] = MU) -> DataFrame:
    """Score all texts with a model of those where `learn` is true.

    Returns key, n_tokens, n_known (tokens seen in training), train_tokens, base_score (the state without context alone)
    and score, both log10 probabilities of the whole text. `mu` has a value for each length from 2 to `order`. docs must
    be a scan of files, or be as stable as one.
    """
    if len(mu) != order - 1:
        raise ValueError(f"order {order} needs {order - 1} values of mu")
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(learn).cast("boolean").alias("learn"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def grams_of(part: pa.Table) -> Grams:
        return Ngrams.of(part, order).counted(part["learn"])

    totals = corpus_counts(rows, grams_of, "lm", kinds=order)
    distinct, every = totals.sums.get(1, (0, 0))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, part in enumerate(parts(batches)):
            if not len(part):
                continue
            grams = Ngrams.of(part, order)
            found = totals.of_part(number, grams.counted(part["learn"]))
            count = [found[n] for n in range(1, order + 1)]
            automaton, base = build(grams, count, every, distinct, mu)
            words, starts = grams.at[0], grams.starts
            sums = [np.add.reduceat(x, starts[:-1]) for x in ((count[0] > 0)[words].astype(np.int64), base[words])]
            values = automaton.traverse(words, starts, order - 1)
            yield pa.RecordBatch.from_arrays(
                [part["key"].combine_chunks(), pa.array(np.diff(starts)), pa.array(sums[0]), pa.array(np.full(len(values), every)), pa.array(sums[1]), pa.array(values)],
                names=["key", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    scored = rows.mapInArrow(rate, f"key {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumnRenamed("key", key)
