"""Kernels against set intersections, held-out recall of toxicity, damaged media, chat records without a layout, equal hashes."""

import io
import re
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.llm import chat, langid, media, perfecthash, toxicity
from wayfold.llm.queries import op4_toxicity

FOLDER = "/root/testdata/sf0.1"


def grams(text):
    plain = " " + re.sub(r"[\W\d_]+", " ", text).strip().lower() + " "
    return {plain[i : i + n] for n in range(1, langid.LONGEST + 1) for i in range(len(plain) - n + 1)}


def test_kernels_against_set_intersections():
    texts = ["a small text", "A SMALL  text, 12", "ein kleiner Täxt", "x", "abab abab", "größe und 日本語 text " * 30]
    landmarks = langid.Landmarks([langid.spectrum(t) for t in texts[:4]])
    got = landmarks.kernels(texts)
    for row, t in zip(got, texts):
        own = grams(t)
        assert len(langid.spectrum(t)) == len(own)
        assert row == pytest.approx([len(own & grams(m)) / np.sqrt(len(own) * len(grams(m))) for m in texts[:4]])


def test_regression_against_a_plain_solve(spark):
    rows = [("en", f"the old house number {w} stands on a hill") for w in "abcdefghij"] + [("de", f"das alte Haus Nummer {w} steht auf dem Hügel") for w in "abcdefghij"]
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    model = langid.fit(docs, F.lit(True))
    values = model.values([t for _, t in rows])
    assert [model.languages[k] for k in values.argmax(axis=1)] == [lang for lang, _ in rows]
    # one ridge regression per language on the landmark features, solved by least squares with penalty rows
    k = model.landmarks.kernels([t for _, t in rows])
    span, _ = np.linalg.qr(np.hstack([model.weights]))
    assert np.allclose(values - model.bias, k @ model.weights) and span.shape[1] == 2
    assert np.abs(values[:, 0] + values[:, 1]).max() < 1e-6  # targets of two languages are opposite


def test_held_out_toxic_documents_are_found(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "toxic")
    rated = op4_toxicity(spark, FOLDER).where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    toxic = [r["predicted"] for r in rated if r["toxic"] == 1]
    clean = [r["predicted"] for r in rated if r["toxic"] == 0]
    assert len(toxic) >= 5 and sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_composed_grammar_against_its_machines():
    lexicon = toxicity._seed_lexicon()
    grammar = toxicity.Grammar(lexicon)
    words = ["idiot", "kill", "will", "you", "not", "said", "house", ",", "green", "trash"]
    rng = np.random.default_rng(3)
    for _ in range(3000):
        clause = [words[k] for k in rng.integers(0, len(words), rng.integers(1, 9))]
        state, heaviest = {name: m.start for name, m in toxicity.MACHINES.items()}, 0.0
        for w in clause:
            kind, weight = (toxicity.COMMA, 0.0) if w == "," else lexicon.get(w, (toxicity.OTHER, 0.0))
            state = {name: m.step(state[name], kind) for name, m in toxicity.MACHINES.items()}
            heaviest = max(heaviest, weight if kind in (toxicity.INSULT, toxicity.HARM) else 0.0)
        assert grammar.match(" ".join(clause)) == (toxicity.pattern_of(state), heaviest)
    kind = lambda text: toxicity.PATTERNS[grammar.match(text)[0]]
    assert kind("you are not an idiot") == "denied"
    assert kind("you are not nice, you idiot") == "aimed insult"


def test_learned_words_are_folded_as_texts_are(spark):
    rng = np.random.default_rng(4)
    pick = lambda: " ".join(f"w{chr(97 + k)}x" for k in rng.integers(0, 26, 6))
    rows = [(k, f"{pick()} ÉCUMARD {pick()}." if k % 2 else f"{pick()} maison {pick()}.") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")))
    assert model.lexicon["écumard"][0] == toxicity.INSULT
    texts = spark.createDataFrame([(1, "quel Écumard"), (2, "quel écumard"), (3, "quel jour")], "k int, text string")
    a, b, c = (r["score"] for r in toxicity.score(texts, model).orderBy("k").collect())
    assert a == b > c


def test_many_languages_share_the_sample(spark, monkeypatch):
    # five landmarks a language, as with a hundred languages and the bounds of the module
    monkeypatch.setattr(langid, "ALL_LANDMARKS", 150)
    monkeypatch.setattr(langid, "ALL_TRAIN_TEXTS", 900)
    rng = np.random.default_rng(6)
    stock = {f"l{k:02d}": ["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(12)] for k in range(30)}
    rows = [(lang, " ".join(rng.choice(words, 15))) for lang, words in stock.items() for _ in range(40)]
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(2)
    model = langid.fit(docs, F.lit(True))
    assert len(model.languages) == 30 and 75 <= len(model.landmarks.root) <= 300
    values = model.values([t for _, t in rows])
    assert np.mean([model.languages[k] == lang for k, (lang, _) in zip(values.argmax(axis=1), rows)]) > 0.9


def plain_png(body):
    """A reader of 8-bit grey PNG of its own: width, rows."""
    at, data = 8, b""
    while at < len(body):
        size = int.from_bytes(body[at : at + 4])
        kind, chunk = body[at + 4 : at + 8], body[at + 8 : at + 8 + size]
        width, height = (int.from_bytes(chunk[i : i + 4]) for i in (0, 4)) if kind == b"IHDR" else (width, height)
        data += chunk if kind == b"IDAT" else b""
        at += 12 + size
    raw = zlib.decompress(data)
    return b"".join(raw[k * (width + 1) + 1 : (k + 1) * (width + 1)] for k in range(height))


def test_media_by_a_reader_of_its_own_and_permissive_reading(spark, tmp_path):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["", "abc", "é" * 100, "x" * 9000, None])], "doc_id long, text string")
    _, folder = media.write_media(docs, "doc_id", "text")
    found = media.describe(media.read_media(spark, folder)).collect()
    assert len(found) == 5
    for r in found:
        body = plain_png(bytes(r["content"]))
        assert body == bytes(r["payload"]) and len(body) % 64 == 0
        said, mid = dict(x.split("=") for x in r["feature"].split(";")), [v - 128 for v in body]
        shares = [body.count(bytes([v])) / len(body) for v in set(body)]
        want = {
            "mean": sum(mid) / len(mid), "rms": (sum(v * v for v in mid) / len(mid)) ** 0.5, "peak": max(map(abs, mid)),
            "crossings": sum((a < 0) != (b < 0) for a, b in zip(mid, mid[1:])) / (len(mid) - 1), "entropy": -sum(x * np.log2(x) for x in shares),
        }
        assert {k: float(v) for k, v in said.items()} == pytest.approx(want, abs=2e-6)
    good = media.to_png(b"fine")
    foreign = media.to_png(b"other")[:20]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("00000000/1.png", good)
        z.writestr("00000001/2.png", foreign)
        z.writestr("00000002/3.png", b"no picture")
    (tmp_path / "whole.zip").write_bytes(packed.getvalue())
    (tmp_path / "cut.zip").write_bytes(packed.getvalue()[:-30])
    read = media.read_media(spark, f"file://{tmp_path}", mode="permissive", attempts="1", rangeBytes="64")
    rows = media.describe(read, permissive=True).collect()
    assert [r["error"] is None for r in sorted(rows, key=lambda r: (r["archive"], r["offset"] or 0))] == [False, True, False, False]
    assert [bytes(r["payload"])[:4] for r in rows if r["payload"]] == [b"fine"] and sum(r["member"] is None for r in rows) == 1
    with pytest.raises(Exception, match="zip"):
        media.read_media(spark, f"file://{tmp_path}", attempts="1").collect()
    with pytest.raises(Exception, match="PNG"):
        media.describe(read.where("member is not null")).collect()


def test_chats_without_a_layout_have_no_turn(spark):
    rows = [(1, '{"instruction":"do","input":"x","output":"done"}'), (1, '{"strange":1}'), (2, '{"strange":[1]}'), (3, None), (None, '{"instruction":"a","input":"","output":"b"}'), (4, '{"messages":[]}'), (5, '{"instruction":"%s","input":"","output":"ok"}' % ("long " * 50_000))]
    records = spark.createDataFrame(rows, "id long, j string").select("id", F.parse_json("j").alias("r"))
    turns = chat.canonical_turns(records, "id", "r")
    assert turns.where("layout is null").count() >= 3
    got = {r["id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.parse_chats(chat.format_chats(turns, "id")).collect()}
    assert set(got) == {1, None, 5} and got[1] == [("user", "do\n\nx"), ("assistant", "done")] and got[None] == [("user", "a"), ("assistant", "b")] and len(got[5][0][1]) == 250_000
    doubled = turns.where("id = 1").union(turns.where("id = 1"))
    (r,) = chat.parse_chats(chat.format_chats(doubled, "id")).collect()
    assert [t["role"] for t in r["turns"]] == ["user", "user", "assistant", "assistant"]
    assert chat.format_chats(turns.limit(0), "id").collect() == []


def test_equal_hashes_are_refused():
    with pytest.raises(ValueError, match="64-bit"):
        perfecthash.build(np.array([5, 9, 5], np.uint64))
