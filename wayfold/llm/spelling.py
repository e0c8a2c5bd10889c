"""Spelling variants: words one inserted, deleted or replaced code point apart, found through rolling-hash deletions.

Prefix and suffix polynomial hashes give the hash of a word without its i-th code point for all i at once, as NumPy
integers: L + 1 numbers for a word of L code points, however long it is. Words that are equal without the code point at
one place differ by a replacement there; a word that equals another without one code point differs by an insertion or
deletion. Keys are dealt by their leading bits, sorted by Spark in each part, and streamed; only keys that several
words share go on. These are held against the words' strings: replacements are grouped by what is left and its place,
insertions joined on the shorter word, so equal hashes of unlike strings link nothing.

A replacement group has at most one word for each letter, and is never spread into pairs: each member takes the group's
size less one and the best of the others. A deletion meets one shorter word.

Words: maximal runs of ASCII letters and U+00C0 to U+00FF, A-Z lower-cased. Nulls: a null text has no words; a null
document id counts as empty text where words are altered. Repeated rows count each for itself. An empty table, or one
without such words, gives no rows. Other columns are ignored. Very long runs are words like others.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.shared import materialise, small_batches

RUN = re.compile("[a-zÀ-ÿ]+")
#: Words held in a task before their counts are handed on; code points hashed at a time.
HELD_WORDS, HELD_POINTS = 200_000, 1 << 21
#: Deletion keys for each part, and leading bits that deal them.
PART_KEYS, RADIX_BITS = 4_000_000, 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def altered(run: str, h: int, divisor: int) -> str:
    """The run, without its code point at h modulo its length if divisor divides h."""
    at = h % len(run)
    return run if h % divisor else run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, key: str, text: str, least_length: int, least_count: int, divisor: int | None) -> DataFrame:
    """(word, n) of words of at least least_length code points and least_count occurrences in all texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            docs_of, texts = batch.column(0).to_pylist(), pc.ascii_lower(batch.column(1))
            for doc, whole in zip(docs_of, texts):
                runs = Counter(m.group() for m in RUN.finditer(whole.as_py()))
                seed = zlib.crc32(f"{doc}:".encode())
                for run, n in runs.items():
                    if divisor:
                        run = altered(run, zlib.crc32(run.encode(), seed), divisor)
                    if len(run) >= least_length:
                        held[run] += n
                if len(held) >= HELD_WORDS:
                    yield _counts(held)
                    held.clear()
        yield _counts(held)

    small_batches(docs.sparkSession)
    given = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("doc"), F.col(f"`{text}`").alias("text")).where("text is not null")
    parts = given.mapInArrow(counted, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _counts(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])


def deletion_keys(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words of one length L, as rows of code points: hashes of each without each code point (rows x L), hashes of
    the words, and which deletions are the first of their outcome (a run of one letter gives one string)."""
    rows, length = points.shape
    powers = np.ones(length + 1, np.uint64)
    np.multiply.accumulate(np.full(length, _BASE), out=powers[1:])
    prefix, suffix = np.zeros((rows, length + 1), np.uint64), np.zeros((rows, length + 1), np.uint64)
    for i in range(length):
        prefix[:, i + 1] = prefix[:, i] * _BASE + points[:, i]
        suffix[:, length - 1 - i] = suffix[:, length - i] + points[:, length - 1 - i] * powers[i]
    without = prefix[:, :-1] * powers[length - 1 :: -1] + suffix[:, 1:]
    first = np.ones((rows, length), bool)
    first[:, 1:] = points[:, 1:] != points[:, :-1]
    return _mixed(without), _mixed(prefix[:, -1]), first


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spread over all bits, so that leading bits deal evenly."""
    h = (h ^ (h >> np.uint64(30))) * _MIX
    return h ^ (h >> np.uint64(31))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, at, first, id): at is the place left out, -1 for the whole word."""
    for batch in batches:
        ids, words = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        lengths = np.array([len(w) for w in words], np.int64)
        for length in np.unique(lengths):
            chosen = np.flatnonzero(lengths == length)
            step = max(1, HELD_POINTS // int(length))
            for begin in range(0, len(chosen), step):
                rows = chosen[begin : begin + step]
                points = np.frombuffer("".join(words[r] for r in rows).encode("utf-32-le"), np.uint32).reshape(len(rows), length).astype(np.uint64)
                without, own, first = deletion_keys(points)
                key = np.concatenate([without.ravel(), own]).view(np.int64)
                at = np.concatenate([np.tile(np.arange(length, dtype=np.int32), len(rows)), np.full(len(rows), -1, np.int32)])
                of = np.concatenate([np.repeat(ids[rows], length), ids[rows]])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(at), pa.array(np.concatenate([first.ravel(), np.ones(len(rows), bool)])), pa.array(of)], ["key", "at", "first", "id"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and place, those that share key and place with another (a replacement), and those of keys
    that are one word's own hash and another's without a code point. The last key of a batch waits for the next batch."""
    waiting: list[np.ndarray] | None = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        columns = columns if waiting is None else [np.concatenate([w, c]) for w, c in zip(waiting, columns)]
        if not len(columns[0]):
            continue
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        waiting = [c[cut:] for c in columns]
        if cut:
            yield _kept(*(c[:cut] for c in columns))
    if waiting is not None:
        yield _kept(*waiting)


def _kept(key: np.ndarray, at: np.ndarray, first: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    fresh = np.concatenate([[True], key[1:] != key[:-1]])
    apart = fresh | np.concatenate([[True], at[1:] != at[:-1]])
    place = np.cumsum(apart) - 1
    replaced = (at >= 0) & (np.bincount(place)[place] > 1)
    group = np.cumsum(fresh) - 1
    own, out = np.bincount(group, at < 0)[group] > 0, np.bincount(group, (at >= 0) & first)[group] > 0
    dropped = (at >= 0) & first & own
    keep = replaced | dropped | ((at < 0) & out)
    names = ["id", "at", "replaced", "dropped"]
    return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(at[keep]), pa.array(replaced[keep]), pa.array(dropped[keep])], names)


def near_words(words: DataFrame) -> DataFrame:
    """words: stored (word, n). Returns (word, n_near, best_n, best) of the words that have near ones: their number, and
    the near word of largest n, of equals the first in code-point order."""
    spark = words.sparkSession
    named = words.withColumn("id", F.xxhash64("word"))
    total = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PART_KEYS + 1)
    keys = named.select("id", "word").mapInArrow(_keys, "key long, at int, first boolean, id long")
    dealt = keys.repartition(parts, F.shiftrightunsigned("key", 64 - RADIX_BITS)).sortWithinPartitions("key", "at")
    shared = dealt.mapInArrow(_shared, "id long, at int, replaced boolean, dropped boolean").where("at >= 0")
    # two words may share an id: what is left of each is taken from its own string, and equal rows count once
    rest = F.concat(F.expr("substring(word, 1, at)"), F.expr("substring(word, at + 2)")).alias("rest")
    met, _ = materialise(shared.join(named, "id").where("at < length(word)").select("word", "n", "at", rest, "replaced", "dropped").distinct(), "deletions")

    group = met.where("replaced").groupBy("at", "rest").agg(F.array_sort(F.collect_set(F.struct((-F.col("n")).alias("down"), "word"))).alias("all"))
    member = group.where("size(all) > 1").select("all", F.explode("all").alias("m"))
    other = F.when(F.col("m.word") == F.col("all")[0]["word"], F.col("all")[1]).otherwise(F.col("all")[0])
    replaced = member.select(F.col("m.word").alias("word"), (F.size("all") - 1).cast("long").alias("near"), other.alias("best"))

    first = F.expr("at = 0 or substring(word, at, 1) != substring(word, at + 1, 1)")
    longer = met.where("dropped").where(first).select("word", "n", "rest")
    pairs = longer.alias("a").join(words.alias("b"), F.col("a.rest") == F.col("b.word")).select(F.struct((-F.col("a.n")).alias("down"), F.col("a.word").alias("word")).alias("a"), F.struct((-F.col("b.n")).alias("down"), F.col("b.word").alias("word")).alias("b"))
    pairs = pairs.distinct()
    one = F.lit(1).cast("long").alias("near")
    both = pairs.select(F.col("a.word").alias("word"), one, F.col("b").alias("best")).union(pairs.select(F.col("b.word").alias("word"), one, F.col("a").alias("best")))
    best = replaced.union(both).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    return best.select("word", "n_near", (-F.col("best.down")).alias("best_n"), F.col("best.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """forms: (word, form). Returns (word, root), the last form reached; the steps taken double in every round."""
    reached, _ = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved, _ = materialise(reached.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        reached = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return reached


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 5, least_count: int = 3, factor: int = 2, divisor: int | None = None) -> DataFrame:
    """(word, n, form, root, n_near, form_n): a word's form is its near word of largest n if that is factor times its own
    at least; root is where forms lead in the end, the word itself if it has none. factor is above 1, so forms end.

    divisor: plant misspellings, `altered` by the crc32 of `<doc>:<run>`; None leaves runs as they are."""
    words, _ = materialise(count_words(docs, key, text, least_length, least_count, divisor), "words")
    near, _ = materialise(near_words(words), "near")
    met = words.join(near, "word", "left").withColumn("has", F.coalesce(F.col("best_n") >= factor * F.col("n"), F.lit(False)))
    rows = met.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("has"), F.col("best")).alias("form"), F.when(F.col("has"), F.col("best_n")).alias("form_n"))
    rows, _ = materialise(rows, "forms")
    ends = roots(rows.where("form is not null").select("word", "form"))
    return rows.join(ends, "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")
