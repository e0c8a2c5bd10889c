"""Corpus counts brought back to parts: many parts and buckets, groups of partitions, passes over other rows."""

import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from wayfold.llm import counts
from wayfold.llm.bytescan import column_bytes, word_hashes


def words_of():
    def grams_of(part):  # not of the module, so that tasks get it by value
        hashes, _ = word_hashes(*column_bytes(part["text"]))
        keys, n = np.unique(hashes, return_counts=True)
        short, m = np.unique((hashes >> np.uint64(32)).astype(np.uint32), return_counts=True)
        return {1: (keys, n), 2: (short, m)}

    return grams_of


@pytest.fixture
def tiny_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "2")
    yield
    spark.conf.set(key, before)


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    """2,000 texts in 4 files; one word is in all of them."""
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(["the", *(f"w{w}" for w in rng.zipf(1.3, 20).clip(max=5000))])) for k in range(2000)]
    folder = f"file://{tmp_path_factory.mktemp('counted')}"
    spark.createDataFrame(rows, "id long, text string").repartition(4, "id").write.mode("overwrite").parquet(folder)
    return folder, Counter(w for _, t in rows for w in t.split())


@pytest.mark.parametrize(("buckets", "wide"), [(1, 1024), (7, 1), (7, 2), (10_000, 1024)])
def test_totals_against_a_counter(spark, texts, tiny_batches, buckets, wide):
    folder, want = texts
    grams_of = words_of()
    docs = spark.read.parquet(folder).select("id", "text")
    size = sum(len(r["text"]) for r in docs.collect())
    began = time.monotonic()
    totals = counts.corpus_counts(docs, grams_of, "test", kinds=2, part_bytes=1, bucket_bytes=-(-size // buckets), wide=wide)
    assert abs(totals.buckets - buckets) <= buckets // 20
    assert totals.sums[1] == (len(want), sum(want.values())) and totals.sums[2][1] == sum(want.values())

    def look_up(batches):
        for number, part in enumerate(counts.parts(batches, part_bytes=1)):
            grams = grams_of(part)
            found = totals.of_part(number, grams)
            words = sorted({w for t in part["text"].to_pylist() for w in t.split()})
            hashes = word_hashes(*column_bytes(pa.chunked_array([pa.array(words)])))[0]
            own = found[1][np.searchsorted(grams[1][0], hashes)]
            short = found[2][np.searchsorted(grams[2][0], (hashes >> np.uint64(32)).astype(np.uint32))]
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(words)), pa.array(words), pa.array(own), pa.array(short)], names=["part", "word", "n", "m"])

    rows = docs.mapInArrow(look_up, "part long, word string, n long, m long").collect()
    assert {r["word"]: r["n"] for r in rows} == dict(want) and all(r["n"] == r["m"] == want[r["word"]] for r in rows)
    assert max(r["part"] for r in rows) >= 200  # about 1,000 parts in all
    assert time.monotonic() - began < 120


def test_a_pass_over_other_rows_fails(spark, texts, tiny_batches):
    folder, _ = texts
    grams_of = words_of()
    docs = spark.read.parquet(folder).select("id", "text")
    totals = counts.corpus_counts(docs, grams_of, "test", kinds=2, part_bytes=1)

    def look_up(batches):
        for number, part in enumerate(counts.parts(batches, part_bytes=1)):
            totals.of_part(number, grams_of(part))
            yield pa.RecordBatch.from_arrays([pa.array([number])], names=["part"])

    assert docs.mapInArrow(look_up, "part long").count() >= 900
    with pytest.raises(Exception, match="different rows"):
        docs.where("id % 3 = 1").mapInArrow(look_up, "part long").collect()


@pytest.mark.parametrize("kind", [np.uint32, np.uint64])
def test_cuts(kind):
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, np.iinfo(kind).max, 5000, dtype=kind, endpoint=True))
    for buckets in (1, 3, 1000, 1_000_000):
        cuts = counts._cuts(keys, buckets)
        assert [b for b, _ in cuts] == sorted({b for b, _ in cuts}) and 0 <= cuts[0][0] and cuts[-1][0] < buckets
        assert np.array_equal(np.concatenate([keys[c] for _, c in cuts]), keys)
    assert counts._cuts(keys[:0], 9) == []
    began = time.monotonic()
    counts._cuts(keys, 1_000_000_000)
    assert time.monotonic() - began < 0.5
