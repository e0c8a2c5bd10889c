"""Toxicity by a weighted finite-state grammar over clauses.

A lexical transducer maps words to classes with a weight (insult, harm, intent, target, negation, reported speech).
Five small machines over classes follow a clause from left to right: insult; threat (an intent, then harm); target;
negation (in reach of the word it denies); reported speech (a reporting word before the insult). They are composed into
one deterministic machine, whose state at the clause's end says which pattern the clause matches. A text's score is
logistic in the weights of its matched clauses by pattern, so that a denied or quoted insult counts less than one aimed
at somebody, and a word alone decides nothing.

Seed words are listed below. Further insults, every word's reliability, and the patterns' weights are learned from a
bounded sample of labelled rows: LEARN_DOCS texts, chosen by a hash of the text. A learned insult must appear in many
different contexts, since copies of one text repeat all their words in the same ones.

A null or empty text matches nothing and gets the score of such texts. Rows with a null label are not learned from.
Repeated rows get equal scores; copies of a text are learned from once, as toxic if one of them is. Without labels the prior weights hold. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from wayfold.llm.shared import small_batches

OTHER, INSULT, HARM, INTENT, TARGET, NEGATION, REPORT, COMMA = CLASSES = range(8)
SEEDS = {
    INSULT: "idiot idiots idiotic moron morons stupid loser losers trash scum pathetic worthless disgusting clown clowns dumbass imbecile cretin bastard bastards asshole assholes bitch bitches garbage vermin "
    "idiotin dummkopf trottel arschloch abschaum widerlich versager vollidiot schwachkopf idiote imbécile crétin connard connasse ordure débile idiota imbécil estúpido estúpida escoria payaso patético asqueroso",
    HARM: "kill hurt destroy murder strangle stab töten umbringen vernichten tuer détruire frapper matar destruir golpear",
    INTENT: "will gonna going shall werde werden vais allons voy vamos",
    TARGET: "you your yours they them he she him her du dich dir ihr euch sie tu toi vous ils eux elle tú usted vosotros ellos ella",
    NEGATION: "not no never isn't aren't wasn't don't nicht kein keine nie pas jamais ni nunca jamás",
    REPORT: "said says called calls quoted wrote writes claims claimed sagte sagt nannte schrieb dit disait appelait écrit dijo dice llamó escribió",
}
#: Labelled texts that are learned from: the expected size of a hash sample.
LEARN_DOCS = 20_000
#: A learned insult: different neighbours, share of toxic texts among its texts, neighbours per text.
CONTEXTS, RELIABLE, SPREAD = 5, 0.8, 0.3
#: Power of a learned word's reliability in its weight: a doubtful word alone decides nothing.
SHARPNESS = 4
#: Words after a negation that it denies, up to a comma.
REACH = 3
PATTERNS = ("insult", "aimed insult", "threat", "aimed harm", "denied", "reported")
#: Prior weights of the patterns and of a text without any.
PRIOR, PRIOR_BIAS, PRIOR_STRENGTH = np.array([4.0, 5.0, 4.0, 4.0, 0.5, 0.5]), -3.0, 0.05
_CLAUSE_END = re.compile(r"[.;:!?\n]")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|,")


@dataclass(frozen=True)
class Machine:
    """A deterministic machine over word classes: (state, class) -> state; what is not listed stays."""

    start: object
    moves: dict[tuple[object, int], object]

    def step(self, state: object, symbol: int) -> object:
        return self.moves.get((state, symbol), state)


def _negation() -> Machine:
    """States: none, 1..REACH words left in reach, denied, and open once an insult stands undenied."""
    moves: dict[tuple[object, int], object] = {}
    for symbol in CLASSES:
        for left in range(1, REACH + 1):
            moves[left, symbol] = left - 1 or "none"
    for left in range(1, REACH + 1):
        moves[left, NEGATION] = REACH
        moves[left, INSULT] = moves[left, HARM] = "denied"
    moves["none", NEGATION] = REACH
    moves["none", INSULT] = moves["none", HARM] = "open"
    return Machine("none", moves)


MACHINES = {
    "insult": Machine("no", {("no", INSULT): "yes"}),
    "threat": Machine("no", {("no", INTENT): "intent", ("no", HARM): "harm", ("intent", HARM): "threat"}),
    "target": Machine("no", {("no", TARGET): "yes"}),
    "negation": _negation(),
    "report": Machine("no", {("no", REPORT): "reported", ("no", INSULT): "direct", ("no", HARM): "direct"}),
}


def pattern_of(state: dict[str, object]) -> int | None:
    """The pattern that a clause matches when it ends in this state."""
    insult, threat, aimed = state["insult"] == "yes", state["threat"] == "threat", state["target"] == "yes"
    harm = state["threat"] == "harm" and aimed
    if not (insult or threat or harm):
        return None
    if state["negation"] == "denied":
        return PATTERNS.index("denied")
    if state["report"] == "reported":
        return PATTERNS.index("reported")
    if insult:
        return PATTERNS.index("aimed insult" if aimed else "insult")
    return PATTERNS.index("threat" if threat else "aimed harm")


def compose(machines: dict[str, Machine]) -> tuple[list[list[tuple[int, float]]], list[int | None]]:
    """The product of the machines, as far as it can be reached: arcs[state][class] = (state, share of the word's weight
    that the arc bears), and each state's pattern. A path weighs as much as its heaviest arc."""
    start = tuple(m.start for m in machines.values())
    number, waiting, moves = {start: 0}, [start], []
    for state in waiting:
        row = []
        for symbol in CLASSES:
            to = tuple(m.step(s, symbol) for m, s in zip(machines.values(), state, strict=True))
            if to not in number:
                number[to] = len(number)
                waiting.append(to)
            row.append((number[to], 1.0 if symbol in (INSULT, HARM) else 0.0))
        moves.append(row)
    return moves, [pattern_of(dict(zip(machines, state, strict=True))) for state in waiting]


class Grammar:
    """The composed machine over a weighted lexicon {word: (class, weight)}."""

    def __init__(self, lexicon: dict[str, tuple[int, float]]):
        self.lexicon = {**lexicon, ",": (COMMA, 0.0)}
        self.arcs, self.pattern = compose(MACHINES)
        self.anchors = ahocorasick.Automaton()
        for word, (kind, _) in lexicon.items():
            if kind in (INSULT, HARM):
                self.anchors.add_word(word, len(word))
        self.anchors.make_automaton()

    def clauses(self, text: str) -> Iterator[str]:
        """The clauses that hold an insult or a word of harm; others match nothing."""
        done = 0
        for last, length in self.anchors.iter(text):
            first = last - length + 1
            if first < done or (first and text[first - 1].isalpha()) or (last + 1 < len(text) and text[last + 1].isalpha()):
                continue
            begin = done
            for mark in _CLAUSE_END.finditer(text, max(done, first - 2000), first):
                begin = mark.end()
            if begin == done and first - 2000 > done:
                begin = max((m.end() for m in _CLAUSE_END.finditer(text, done, first)), default=done)
            end = _CLAUSE_END.search(text, last + 1)
            done = end.end() if end else len(text)
            yield text[begin:done]

    def match(self, clause: str) -> tuple[int | None, float]:
        """The clause's pattern and the weight of its path."""
        state, weight = 0, 0.0
        for word in _WORD.findall(clause):
            kind, own = self.lexicon.get(word, (OTHER, 0.0))
            state, share = self.arcs[state][kind]
            weight = max(weight, share * own)
        return self.pattern[state], weight

    def features(self, text: str | None) -> np.ndarray:
        """Damped sums of clause weights by pattern."""
        sums = np.zeros(len(PATTERNS))
        if text:
            for clause in self.clauses(text.lower()):
                pattern, weight = self.match(clause)
                if pattern is not None:
                    sums[pattern] += weight
        return np.log2(1 + sums)


@dataclass
class ToxicityModel:
    lexicon: dict[str, tuple[int, float]]
    weights: np.ndarray
    bias: float


def _seed_lexicon() -> dict[str, tuple[int, float]]:
    return {word: (kind, 0.7) for kind, listed in SEEDS.items() for word in listed.split()}


def _logistic(features: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias with a Gaussian prior about PRIOR, by Newton's method; pattern weights are at least 0."""
    x = np.hstack([features, np.ones((len(features), 1))])
    centre = np.append(PRIOR, PRIOR_BIAS)
    strength = np.append(np.full(len(PRIOR), PRIOR_STRENGTH * 20), PRIOR_STRENGTH)
    theta = centre.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (p - labels) + strength * (theta - centre)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(strength), gradient)
        theta = theta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return np.maximum(theta[:-1], 0), float(theta[-1])


def _words(text: str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))


def _learned_insults(sample: DataFrame) -> list[tuple[str, int, int]]:
    """(word, toxic texts, other texts) of all words that mark toxic texts in many contexts: at most the sample's words."""
    occurrences = sample.select("id", "toxic", _words("text").alias("w")).select("id", "toxic", "w", F.posexplode("w").alias("k", "word"))
    around = F.xxhash64(F.expr("get(w, k - 1)"), F.expr("get(w, k + 1)"))
    toxic = occurrences.where("toxic = 1").select("id", "word", around.alias("around"))
    spread = toxic.groupBy("word").agg(F.count_distinct("around").alias("contexts"), F.count_distinct("id").alias("hits"))
    spread = spread.where((F.col("contexts") >= CONTEXTS) & (F.col("contexts") >= SPREAD * F.col("hits")))
    clean = occurrences.where("toxic = 0").groupBy("word").agg(F.count_distinct("id").alias("misses"))
    both = spread.join(clean, "word", "left").select("word", "hits", F.coalesce("misses", F.lit(0)).alias("misses"))
    sure = both.where(F.col("hits") >= RELIABLE * (F.col("hits") + F.col("misses")))
    return [(r["word"], r["hits"], r["misses"]) for r in sure.orderBy(F.desc("hits"), "word").collect()]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """Learn from a bounded hash sample of labels (key, label) and the texts of those documents."""
    marked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    total = marked.count()
    lexicon = _seed_lexicon()
    if not total:
        return ToxicityModel(lexicon, PRIOR, PRIOR_BIAS)
    share = int(min(1.0, LEARN_DOCS / total) * (1 << 30))
    chosen = marked.where(F.pmod(F.xxhash64("key", F.lit(3)), F.lit(1 << 30)) < share)
    # about LEARN_DOCS short rows, whatever the input: small enough to send to all executors
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "key")
    # copies of a text are one text, toxic if any of them is marked so
    sample = texts.groupBy("text").agg(F.max("toxic").alias("toxic")).withColumn("id", F.xxhash64("text"))
    for word, hits, misses in _learned_insults(sample):
        kind = lexicon.get(word, (INSULT, 0.0))[0]
        if kind in (INSULT, HARM):
            lexicon[word] = (kind, ((hits + 1) / (hits + misses + 1.5)) ** SHARPNESS)
    small_batches(docs.sparkSession)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon)
        for batch in batches:
            found = [grammar.features(t).tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(1)], names=["f", "toxic"])

    counted: dict[tuple, list[int]] = defaultdict(lambda: [0, 0])
    for r in sample.select("text", "toxic").mapInArrow(describe, "f array<double>, toxic int").collect():
        counted[tuple(r["f"])][min(max(r["toxic"], 0), 1)] += 1
    rows_of = sorted(itertools.chain.from_iterable([(f, y)] * n for f, pair in counted.items() for y, n in enumerate(pair)))
    weights, bias = _logistic(np.array([f for f, _ in rows_of]), np.array([y for _, y in rows_of], dtype=float))
    return ToxicityModel(lexicon, weights, bias)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """docs with score (0 to 1) and matched (clauses by pattern, damped); columns of docs with these names are replaced."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    docs = docs.drop(*(c for c in ("score", "matched") if c != text))
    place = docs.columns.index(text)
    schema = StructType([*docs.schema.fields]).add("score", "double").add("matched", ArrayType(DoubleType()))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        grammar = Grammar(model.lexicon)
        for batch in batches:
            found = np.array([grammar.features(t) for t in batch.column(place).to_pylist()]).reshape(-1, len(PATTERNS))
            value = 1 / (1 + np.exp(-np.clip(found @ model.weights + model.bias, -30, 30)))
            columns = [*batch.columns, pa.array(value), pa.array(list(found), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "score", "matched"])

    return docs.mapInArrow(rate, schema)
