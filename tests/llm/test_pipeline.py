"""The corpus pipeline's stages on small rows, and every numbered query at sf0.001."""

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from wayfold.llm import decontaminate, jaccard, media, toxicity
from wayfold.llm.encode import vocabulary_path
from wayfold.llm.queries import ORACLES, QUERIES
from wayfold.llm.shared import materialise

FOLDER = "/root/testdata/sf0.001"
TEN = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
LONG = "a quiet morning in the small town began with rain and the sound of old bells from a church on the far hill"
ROWS = [
    (1, LONG, "x"), (1, f"before {TEN} after it", "x"), (1, LONG, "x"), (2, LONG + " again", "y"), (2, "something else entirely stands in this second row", "y"), (None, LONG.upper(), None),
    (3, None, None), (4, "", ""), (5, "²½ 123 !!", "z"), (6, "you are a stupid idiot. you moron, you are worthless trash! i will kill you, you pathetic loser.", "z"), (7, f"{TEN}", "z"), (8, "word " * 30_000, "long"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents with clashing columns, and the other tables that stages read."""
    path = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame([(*r, "en", 0.25, f"k{n}", 7) for n, r in enumerate(ROWS)], "doc_id long, text string, source string, lang string, score double, key string, `row` int")
    docs.write.parquet(f"{path}/documents.parquet")
    docs.limit(0).write.parquet(f"{path}/none.parquet")
    spark.createDataFrame([(1, TEN), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(6, 1), (1, 0), (None, 1), (2, None)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def stage(spark, folder, name, rows=None, table="documents"):
    docs = spark.read.parquet(f"{folder}/{table}.parquet")
    docs = docs if rows is None else docs.where(rows)
    out = dict(corpus_pipeline.STAGES)[name](spark, materialise(docs, "in")[0], folder)
    assert out.columns == docs.columns or name == "best-fit packing"
    return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) if name != "best-fit packing" else out.collect()


def wanted(keep):
    return sorted(((r[0], r[1]) for n, r in enumerate(ROWS) if keep(n, r)), key=repr)


def test_language_stage(spark, folder):
    assert stage(spark, folder, "language identification") == wanted(lambda n, r: r[1] and any(map(str.isalpha, r[1])))


def test_toxicity_stage(spark, folder):
    assert stage(spark, folder, "toxicity") == wanted(lambda n, r: r[0] != 6)


def test_near_duplicate_stage(spark, folder):
    # rows 0, 2, 3 and 5 are one group, of which the null key is the least; empty texts are linked with nothing
    assert stage(spark, folder, "near duplicates") == wanted(lambda n, r: n not in (0, 2, 3))
    assert stage(spark, folder, "near duplicates", "doc_id is not null") == wanted(lambda n, r: n not in (2, 3, 5))


def test_decontamination_stage(spark, folder):
    assert stage(spark, folder, "benchmark decontamination") == wanted(lambda n, r: TEN not in (r[1] or ""))


def test_packing_stage(spark, folder):
    pieces = defaultdict(int)
    for r in stage(spark, folder, "best-fit packing"):
        pieces[r["doc_id"]] += r["length"]
    assert set(pieces) == {r[0] for r in ROWS} and pieces[3] == pieces[4] == 1 and pieces[8] == 30_001


def test_stages_of_an_empty_table(spark, folder):
    for name, _ in corpus_pipeline.STAGES:
        assert stage(spark, folder, name, table="none") == []


def test_run_against_the_stages_rules(spark, folder):
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in out} == {None, 2, 8} and len({(r["doc_id"], r["ids_crc32"]) for r in out if r["doc_id"] == 2}) == 1


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_numbered_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    assert got == sorted(found.fetchall(), key=repr)


@pytest.fixture(scope="module")
def documents():
    return {k: t or "" for k, t in duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()}


def test_media_query(spark, documents):
    for r in QUERIES["op1_media"](spark, FOLDER).collect():
        raw = documents[r["doc_id"]].encode()
        full = raw + b"\0" * (-len(raw) % 64 or (64 if not raw else 0))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        stored = media.to_png(raw)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())


@pytest.mark.parametrize("name, vocabulary", [("op5_best_fit_packing", "word_bpe_49k.json"), ("op10_token_ids", "byte_bpe_50k.json")])
def test_token_queries(spark, documents, name, vocabulary):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary_path(vocabulary))
    ids = {k: [*plain.encode(t, add_special_tokens=False).ids, 0] for k, t in sorted(documents.items())}

    def crc(part):
        return zlib.crc32(np.array(part, dtype="<u4").tobytes())

    rows = QUERIES[name](spark, FOLDER).collect()
    if name == "op10_token_ids":
        start, want = 0, []
        for k, x in ids.items():
            want.append((k, start, len(x), crc(x)))
            start += len(x)
        assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows) == want
        return
    want = [(k, n, s, len(x[s : s + 2048]), crc(x[s : s + 2048])) for k, x in ids.items() for n, s in enumerate(range(0, len(x), 2048))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in held.values():
        placed.sort()
        assert placed[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(placed, placed[1:], strict=False)) and sum(n for _, n in placed) <= 2048
    assert len(held) <= -(-sum(map(len, ids.values())) // 2048) + 1


def held_out(k, divisor, remainder):
    return zlib.crc32(str(k).encode()) % divisor == remainder


def test_language_query(spark, documents):
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{FOLDER}/documents.parquet'").fetchall())
    rows = QUERIES["op6_language_id"](spark, FOLDER).collect()
    assert all(r["held_out"] == held_out(r["doc_id"], 3, 1) for r in rows) and len(rows) == len(documents)
    assert all((r["lang_pred"] == "und") == (not any(map(str.isalpha, documents[r["doc_id"]]))) for r in rows)
    judged = [r for r in rows if r["held_out"] and lang[r["doc_id"]] and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in judged) >= 0.9 * len(judged)


def test_toxicity_query(spark, documents):
    toxic = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{FOLDER}/labels.parquet'").fetchall())
    rows = QUERIES["op4_toxicity"](spark, FOLDER).collect()
    assert len(rows) == len(documents) and all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    clean = [r for r in rows if r["held_out"] and toxic.get(r["doc_id"]) == 0]
    assert sum(r["predicted"] for r in clean) <= 0.1 * len(clean)


def test_language_model_query(spark, documents):
    rows = QUERIES["op8_lm_scoring"](spark, FOLDER).collect()
    tokens = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t)) + 1 for k, t in documents.items()}
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == tokens
    assert {r["train_tokens"] for r in rows} == {sum(n for k, n in tokens.items() if not held_out(k, 5, 1))}


def test_conflicting_labels_of_copies(spark):
    docs = spark.createDataFrame([(k, "you are a zorble person") for k in range(4)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(4)], "doc_id long, toxic int")
    models = [toxicity.fit(docs, labels.orderBy(o)) for o in ("doc_id", "toxic")]
    assert models[0].bias == models[1].bias and (models[0].weights == models[1].weights).all()


def test_proximity_matches(spark):
    docs, _ = materialise(spark.createDataFrame([(1, "aa x bb"), (2, "aa x x x x bb"), (3, "bb aa"), (4, None), (3, "bb aa")], "doc_id long, text string"), "docs")
    windows, _ = decontaminate.windows(spark.createDataFrame([(9, "aa bb")], "item_id long, text string"), 10)
    terms = spark.createDataFrame([("aa", 1), ("bb", 2)], "word string, term long")
    index = decontaminate.build_index(docs, terms)
    keys = {(r["k1"], r["k2"]): r["doc"] for r in decontaminate._keyed(docs, "doc_id", "text").collect()}
    found = {keys[r["k1"], r["k2"]] for r in decontaminate.proximity_matches(index, terms, windows, 2).collect()}
    assert found == {1, 3}


def test_equal_rows_are_dealt_to_several_groups(spark):
    from wayfold.llm import packing

    rows = spark.range(20_000).selectExpr("1L as doc_id", "0 as piece", "0L as start", "100L as length", "5L as ids_crc32")
    out = packing.pack(rows, capacity=2048)
    assert out.selectExpr("sequence_id >> 32 as g").distinct().count() == 3
    assert out.selectExpr("sequence_id").distinct().count() <= 20_000 // 20 + 3


def test_a_very_long_text_keeps_its_language(spark):
    from pyspark.sql import functions as F

    from wayfold.llm import langid

    rng = np.random.default_rng(3)
    letters = {"aa": "abcdefghij", "bb": "klmnopqrst"}

    def text(kind, n):
        return " ".join("".join(rng.choice(list(letters[kind]), 5)) for _ in range(n))

    train = [(k, text(kind, 40), kind) for k in range(30) for kind in letters]
    model = langid.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"), F.lit(True))
    odd = ["²", "½ ¾", "Ⅷ ①", "", None, "12 ."]
    mixed = [(1, text("aa", 20_000)), (2, text("bb", 20_000) + " abc"), *((10 + k, t) for k, t in enumerate(odd))]
    out = {r["doc_id"]: r["lang_pred"] for r in langid.predict(spark.createDataFrame(mixed, "doc_id long, text string"), model).collect()}
    assert (out[1], out[2]) == ("aa", "bb") and {out[10 + k] for k in range(len(odd))} == {"und"}


def test_near_duplicates_of_repeated_rows(spark):
    docs, _ = materialise(spark.createDataFrame([(4, LONG), (4, LONG), (3, LONG), (9, "")] + [(5, "one two")] * 3, "doc_id long, text string"), "docs")
    out = sorted((r["doc_id"], r["component_id"]) for r in jaccard.similar_components(docs).collect())
    assert out == [(3, 3), (4, 3), (4, 3), (5, 5), (5, 5), (5, 5), (9, 9)]
