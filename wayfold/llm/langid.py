"""Language identification with blended-spectrum string kernels.

A text's spectrum is the set of its character n-grams of 1 to LONGEST letters; what is not a letter separates words as
one blank. The kernel of two texts is the number of n-grams both have over the geometric mean of their numbers. Nystroem
features of a text are its kernels with a few landmark texts times the inverse root of the landmarks' own kernel matrix;
one-versus-rest kernel ridge regression on them gives a value per language. Only the landmarks' n-grams matter to a
kernel beside the size of the text's own spectrum, so they are the vocabulary, and no text is too long for it. Texts
are scored in batches: kernels with all landmarks times the regression weights.

The model is fitted on a bounded sample, chosen by a hash of the text: LANDMARKS texts a language (of at most
LANDMARK_CHARS characters where it has such) and TRAIN_TEXTS texts a language, or fewer where there are so many languages
that all of them would have more than ALL_LANDMARKS and ALL_TRAIN_TEXTS. A training text reaches the driver as its kernels
with the landmarks: about 40 megabytes in all, however large the corpus is and however many languages it has. Whole texts
are read at prediction and in training.

A null text, or one without a letter (str.isalpha), is `und` with score 0. Nulls: rows with a null language are not
learned from; a null key stays. Ties: of languages with equal values the first by name. Repeated rows get equal results;
copies of a text are one training text. With no training text, every text is `und`. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wayfold.llm.bytescan import mix
from wayfold.llm.shared import small_batches

UNKNOWN = "und"
LONGEST = 4
#: A language's landmark texts and training texts (expected numbers of a hash sample).
LANDMARKS, TRAIN_TEXTS = 16, 400
#: The same over all languages: the driver holds a matrix of so many numbers.
ALL_LANDMARKS, ALL_TRAIN_TEXTS = 512, 10_000
LANDMARK_CHARS = 4000
RIDGE = 1e-2
_BLOCK = 128
_NO_LETTERS = re.compile(r"[\W\d_]+")
_STEP = np.uint64(0x9FB21C651E98DF25)


def spectrum(text: str) -> np.ndarray:
    """The hashes of the text's distinct n-grams, sorted."""
    plain = " " + _NO_LETTERS.sub(" ", text).strip().lower() + " "
    codes = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    grams, rolled = [], codes
    for n in range(1, LONGEST + 1):
        if n > 1:
            rolled = rolled[:-1] * _STEP + codes[n - 1 :]
        grams.append(mix(rolled + np.uint64(n)))
    return np.unique(np.concatenate(grams))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class Landmarks:
    """Landmark texts by n-gram: for each n-gram of the vocabulary, the landmarks that have it."""

    def __init__(self, spectra: list[np.ndarray]):
        self.root = np.sqrt([len(s) for s in spectra])
        grams = np.concatenate(spectra) if spectra else np.zeros(0, dtype=np.uint64)
        order = np.argsort(grams, kind="stable")
        self.vocabulary, self.first = np.unique(grams[order], return_index=True)
        self.first = np.append(self.first, len(grams))
        self.owner = np.repeat(np.arange(len(spectra), dtype=np.int32), [len(s) for s in spectra])[order]

    def kernels(self, texts: list[str]) -> np.ndarray:
        """A row per text: its kernel with each landmark."""
        out = np.zeros((len(texts), len(self.root)))
        for row, text in zip(out, texts, strict=True):
            own = spectrum(text)
            at = np.minimum(np.searchsorted(self.vocabulary, own), len(self.vocabulary) - 1)
            at = at[self.vocabulary[at] == own]
            length = self.first[at + 1] - self.first[at]
            place = np.repeat(self.first[at] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
            row += np.bincount(self.owner[place], minlength=len(row)) / (self.root * np.sqrt(len(own)))
        return out


@dataclass
class KernelModel:
    languages: list[str]
    landmarks: Landmarks
    #: Landmarks x languages: inverse root and ridge weights multiplied out.
    weights: np.ndarray
    bias: np.ndarray

    def values(self, texts: list[str]) -> np.ndarray:
        """A regression value per text and language, about 1 for its own and -1 for others."""
        found = [self.landmarks.kernels(texts[k : k + _BLOCK]) @ self.weights + self.bias for k in range(0, len(texts), _BLOCK)]
        return np.concatenate(found) if found else np.zeros((0, len(self.languages)))


def _sampled(shares: dict[str, float], salt: int) -> Column:
    """Whether a row is in a hash sample with this share of its language's texts."""
    share = F.element_at(F.create_map(*(F.lit(x) for pair in shares.items() for x in pair)), F.col("lang"))
    return F.pmod(F.xxhash64("text", F.lit(salt)), F.lit(1 << 30)) < share * (1 << 30)


def fit(docs: DataFrame, learn: Column, lang: str = "lang", text: str = "text") -> KernelModel:
    """Fit on a bounded sample of the rows where `learn` holds."""
    rows = docs.where(learn).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang is not null and text rlike '\\\\p{L}'")
    texts, short = F.xxhash64("text"), F.length("text") <= LANDMARK_CHARS
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct(texts).alias("n"), F.approx_count_distinct(F.when(short, texts)).alias("short"))
    found = {r["lang"]: (r["n"], r["short"]) for r in sizes.collect()}  # one row a language
    if not found:
        return KernelModel([], Landmarks([]), np.zeros((0, 0)), np.zeros(0))
    small_batches(docs.sparkSession)
    languages = sorted(found)
    long_only = [x for x in languages if not found[x][1]]
    candidates = rows.where(short | F.col("lang").isin(long_only)) if long_only else rows.where(short)
    marks, texts_each = min(LANDMARKS, ALL_LANDMARKS / len(languages)), min(TRAIN_TEXTS, ALL_TRAIN_TEXTS / len(languages))
    near = candidates.where(_sampled({x: min(1.0, marks / (k or n)) for x, (n, k) in found.items()}, 1)).dropDuplicates(["lang", "text"])
    train = rows.where(_sampled({x: min(1.0, texts_each / n) for x, (n, _) in found.items()}, 2)).dropDuplicates(["lang", "text"])

    def spectra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [spectrum(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams, pa.binary())], names=["lang", "grams"])

    def described(sample: DataFrame) -> list[bytes]:
        return sorted({bytes(r["grams"]) for r in sample.mapInArrow(spectra, "lang string, grams binary").collect()})

    chosen = described(near) or described(candidates.orderBy(texts, "lang").limit(LANDMARKS))
    landmarks = Landmarks([np.frombuffer(x, dtype=np.uint64) for x in chosen])

    def kernels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = landmarks.kernels(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in k], pa.binary())], names=["lang", "k"])

    def learned(sample: DataFrame) -> list[tuple[str, bytes]]:
        return sorted((r["lang"], bytes(r["k"])) for r in sample.mapInArrow(kernels, "lang string, k binary").collect())

    sample = learned(train) or learned(candidates.orderBy(texts, "lang").limit(TRAIN_TEXTS))
    own = np.zeros((len(chosen), len(chosen)))
    for row, grams in zip(own, chosen, strict=True):
        one = np.frombuffer(grams, dtype=np.uint64)
        row += [len(np.intersect1d(one, np.frombuffer(x, dtype=np.uint64), assume_unique=True)) for x in chosen]
    own /= np.outer(landmarks.root, landmarks.root)
    values, vectors = np.linalg.eigh(own)
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = np.frombuffer(b"".join(k for _, k in sample)).reshape(len(sample), -1) @ root
    target = np.where(np.array([x for x, _ in sample])[:, None] == np.array(languages), 1.0, -1.0)
    # each language weighs the same, whatever its number of texts
    weight = 1 / np.maximum((target > 0).sum(axis=0), 1)[(target > 0).argmax(axis=1)]
    weight *= len(weight) / weight.sum()
    mean, aim = np.average(features, axis=0, weights=weight), np.average(target, axis=0, weights=weight)
    x, y = (features - mean) * np.sqrt(weight)[:, None], (target - aim) * np.sqrt(weight)[:, None]
    ridge = np.linalg.solve(x.T @ x + RIDGE * len(x) * np.eye(x.shape[1]) / x.shape[1], x.T @ y)
    return KernelModel(languages, landmarks, root @ ridge, aim - mean @ ridge)


def predict(docs: DataFrame, model: KernelModel, text: str = "text") -> DataFrame:
    """docs with lang_pred and score: the best language, and its share of the languages' values after a softmax.

    Columns of docs with these names are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    docs = docs.drop(*(c for c in ("lang_pred", "score") if c != text))
    place = docs.columns.index(text)
    schema = StructType([*docs.schema.fields]).add("lang_pred", "string").add("score", "double")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts = batch.column(place).to_pylist()
            known = [k for k, t in enumerate(texts) if model.languages and has_letter(t)]
            values = model.values([texts[k] for k in known])
            lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            shares = np.exp(4 * (values - values.max(axis=1, keepdims=True))) if known else values
            shares = shares / shares.sum(axis=1, keepdims=True) if known else shares
            for k, row in zip(known, shares, strict=True):
                best = int(row.argmax())
                lang[k], score[k] = model.languages[best], float(row[best])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(label, schema)
