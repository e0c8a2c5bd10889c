"""Edge cases, brute force and round trips of the training-data operators, on rows written by hand."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from wayfold.llm import chat, decontaminate, jaccard, langid, lm, media, packing, perfecthash, tokenbin, toxicity, warc

BASE = "the quick brown fox jumps over the lazy dog while seven wizards brew a strong potion for the king of the hill near an old mill"
TEXTS = {
    1: BASE, 2: BASE, 3: BASE.upper(), 4: BASE + " extra", 5: "one two", 6: "One  two", 7: "", 8: None, 9: "123 456 !!", 10: "you are a stupid idiot. he said no.",
    11: " ".join(f"w{k % 977}" for k in range(6000)), 12: "ein schöner Tag und ich gehe nach Hause", 13: "  \t\n",
}


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """A stored table with a repeated row, a null key, and columns that have operators' own names."""
    rows = [(k, t, "en" if k != 12 else "de", 0.5, "x", k) for k, t in TEXTS.items()] + [(5, TEXTS[5], "en", 0.5, "x", 5), (None, "a row without a key", None, None, None, None)]
    path = str(tmp_path_factory.mktemp("docs") / "t")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string, key long").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "t")
    docs.limit(0).write.parquet(path)
    return spark.read.parquet(path)


def all_rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


@pytest.mark.parametrize("percent, size", [(85, 4), (80, 5)])
def test_near_duplicates_against_all_pairs(spark, docs, percent, size):
    sets = [(k, shingles(t, size)) for k, t in all_rows(docs)]
    root = list(range(len(sets)))
    for _ in sets:
        for a in range(len(sets)):
            for b in range(len(sets)):
                x, y = sets[a][1], sets[b][1]
                if x and y and 100 * len(x & y) >= percent * len(x | y):
                    root[a] = root[b] = min(root[a], root[b])
    least = defaultdict(list)
    for a, (k, _) in enumerate(sets):
        least[root[a]].append(k)
    want = sorted(((k, len(s), min((x for x in least[root[a]] if x is not None), default=None) if s else k) for a, (k, s) in enumerate(sets)), key=repr)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.similar_components(docs, percent, size).collect()), key=repr)
    assert got == want


def test_decontamination_against_a_loop(spark, docs):
    items = spark.createDataFrame([(1, BASE[:90]), (2, "one TWO"), (3, ""), (4, None), (10, " ".join(f"w{k}" for k in range(5, 25))), (1, BASE[:90])], "item_id long, text string")

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))

    cut = defaultdict(set)
    for r in items.collect():
        w = words(r["text"])
        for k in range(max(1, len(w) - 9) if w else 0):
            cut[tuple(w[k : k + 10])].add(str(r["item_id"]))
    want = []
    for k, t in all_rows(docs):
        w, hit, found = words(t), set(), set()
        for win, ids in cut.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    found |= ids
        want.append((k, len(w), len(hit), sorted(found)))
    got = [(r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in decontaminate.find_contamination(docs, items).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_decontamination_of_repeated_rows(spark):
    ten = " ".join(f"t{k}" for k in range(10))
    rows = [(1, f"a {ten} b"), (1, f"a {ten} b"), (1, f"a {ten} b"), (2, ten), (3, "x one two three y"), (3, "x one two three y"), (4, "t0 t1 t2")]
    items = spark.createDataFrame([(7, ten), (8, "one two three")], "item_id long, text string")
    found = decontaminate.find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), items)
    got = [(r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in found.collect()]
    assert sorted(got) == [(1, 12, 10, ["7"])] * 3 + [(2, 10, 10, ["7"])] + [(3, 5, 3, ["8"])] * 2 + [(4, 3, 0, [])]


@pytest.mark.parametrize("order, mu", [(3, lm.MU), (2, (5.0,)), (1, ()), (4, (3.0, 2.0, 1.0))])
def test_lm_against_a_loop(spark, docs, order, mu):
    rows = [(k, t, k is None or k % 2 == 0) for k, t in all_rows(docs)]

    def tokens(t):
        return [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), "</s>"]

    grams, contexts = Counter(), Counter()
    for _, t, learn in rows:
        w = ["<s>", *tokens(t)]
        for n in range(1, order + 1) if learn else ():
            for k in range(max(1, n - 1), len(w)):
                grams[tuple(w[k - n + 1 : k + 1])] += 1
                contexts[tuple(w[k - n + 1 : k])] += 1
    n, v = sum(c for g, c in grams.items() if len(g) == 1), sum(len(g) == 1 for g in grams)

    def chance(history, word):
        if not history:
            return (grams[(word,)] + 0.5) / (n + 0.5 * (v + 1))
        m = mu[len(history) - 1]
        return (grams[(*history, word)] + m * chance(history[1:], word)) / (contexts[history] + m)

    known = [g[0] for g in grams if len(g) == 1]
    for history in [(), *list(contexts)[:20]]:
        assert abs(sum(chance(history, x) for x in known) + chance(history, "a word never seen") - 1) < 1e-9
    want = []
    for k, t, _ in rows:
        w = ["<s>", *tokens(t)]
        base = sum(math.log10(chance((), x)) for x in w[1:])
        full = sum(math.log10(chance(tuple(w[max(0, i - order + 1) : i]), w[i])) for i in range(1, len(w)))
        want.append((k, len(w) - 1, sum(grams[(x,)] > 0 for x in w[1:]), n, round(base, 6), round(full, 6)))
    df = docs.select("doc_id", "text", F.expr("doc_id is null or doc_id % 2 = 0").alias("learn"))
    got = [(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in lm.score(df, order=order, mu=mu).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_lm_automaton_has_states_arcs_and_failure_arcs():
    part = pa.table({"text": pa.chunked_array([["a b c", "a b d"]]), "learn": pa.chunked_array([[True, True]])})
    grams = lm.Ngrams.of(part, 3)
    count = [added for _, added in grams.counted(part["learn"]).values()]
    machine, _ = lm.build(grams, count, 8, 5, (4.0, 2.0))
    assert len(machine.fail_to) == 2 + 4 + 4  # root, begin; a b c d; (begin a) (a b) (b c) (b d)
    assert machine.fail_to[0] == 0 and (machine.fail_to[1:] < np.arange(1, 10)).all()
    assert len(machine.arc) == 5 + 6 + 5  # words and the end; 2-grams; 3-grams
    state, weights = np.array([1]), 0.0
    for word in grams.at[0][:4]:
        state, weight = machine.step(state, np.array([word]))
        weights += weight[0]
    assert abs(weights - machine.traverse(grams.at[0], grams.starts, 2)[0]) < 1e-12


def test_packing(spark, docs):
    out = packing.pack(packing.token_pieces(docs, "word_bpe_49k.json", keeps_space=False, capacity=128), capacity=128).collect()
    by = defaultdict(list)
    for r in out:
        assert 0 < r["length"] <= 128
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in by.values():
        placed.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(placed, placed[1:], strict=False)) and placed[0][0] == 0 and sum(n for _, n in placed) <= 128
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 129, 300)
    free = []
    for x in sorted(lengths.tolist(), reverse=True):  # best fit by trying all bins
        fits = [k for k, room in enumerate(free) if room >= x]
        if fits:
            free[min(fits, key=lambda k: free[k])] -= x
        else:
            free.append(128 - x)
    sequence, _ = packing.best_fit_decreasing(lengths, 128)
    assert sequence.max() + 1 == len(free)


def test_token_shards_give_back_all_ids(spark, docs):
    from tokenizers import Tokenizer

    from wayfold.llm.encode import vocabulary_path

    plain = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    manifest, folder = tokenbin.write_shards(docs, "byte_bpe_50k.json")
    want, at = [], 0
    for k, t in sorted(all_rows(docs), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((k, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    got = [(r["key"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokenbin.read_shards(manifest, folder, "bigint").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    shard = tokenbin.Shard(folder, manifest.first()["shard"])
    assert shard.get("no such key") == []
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    assert sorted(perfecthash.lookup(perfecthash.build(keys), len(keys), keys).tolist()) == list(range(len(keys)))


@pytest.mark.parametrize("vocabulary, keeps_space", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_special_tokens_within_texts(vocabulary, keeps_space):
    from tokenizers import Tokenizer

    from wayfold.llm.encode import StretchEncoder, vocabulary_path

    texts = [BASE, "a <|endoftext|> b", "", None, "<|startoftext|><|endoftext|>", "<|ENDOFTEXT|> <|EndOfText|>", "It's <|endoftext|><|ENDOFTEXT|>x\n\n<|endoftext|>", "<|endoftext", "a <|startoftext|>b  c", BASE]
    plain = Tokenizer.from_file(vocabulary_path(vocabulary))
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    for column in (pa.array(texts), pa.array(["cut off", *texts])[1:], pa.chunked_array([texts[:4], texts[4:]])):
        ids, starts = StretchEncoder(vocabulary_path(vocabulary), keeps_space).encode(column)
        assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)] == want


def test_media_round_trip_and_damage(spark, docs, tmp_path):
    _, folder = media.write_media(docs, "doc_id", "text")
    back = media.describe(media.read_media(spark, folder, rangeBytes="1000")).select(media.member_key("member", "long").alias("k"), "payload", "n_bytes").collect()
    want = [(k, media.padded((t or "").encode()), len((t or "").encode())) for k, t in all_rows(docs)]
    assert sorted(((r["k"], bytes(r["payload"]), r["n_bytes"]) for r in back), key=repr) == sorted(want, key=repr)
    path = folder.removeprefix("file://")
    import os

    name = next(x for x in sorted(os.listdir(path)) if x.endswith(".zip"))
    raw = bytearray(open(f"{path}/{name}", "rb").read())
    raw[90] ^= 255
    (tmp_path / name).write_bytes(raw)
    bad = media.read_media(spark, f"file://{tmp_path}", mode="permissive", attempts="1").collect()
    assert sum(r["error"] is not None for r in bad) == 1 and any(r["content"] for r in bad)


def test_warc(spark, tmp_path):
    rows = [(3, "http://a/ü", "<p>x</p>"), (1, "u", "<p>x</p>"), (2, None, None), (4, "u", ""), (None, "v", "<p>x</p>"), (7, "l", "é" * 70_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    files, folder = warc.write_archives(pages, least=0)
    got = {r["record_id"]: r for r in warc.read_archives(files, folder).collect()}
    assert len(got) == 6
    assert {k.removeprefix("urn:page:"): (r["record_type"], r["refers_to"]) for k, r in got.items()} == {
        "1": ("response", None), "3": ("revisit", "urn:page:1"), "": ("revisit", "urn:page:1"), "2": ("response", None), "4": ("revisit", "urn:page:2"), "7": ("response", None)}
    assert bytes(got["urn:page:7"]["payload"]).decode() == "é" * 70_000 and got["urn:page:3"]["target_uri"] == "http://a/ü"
    one = files.first()["file"]
    whole = list(warc.read_archive(folder, one))
    assert [r["record_id"] for r in warc.read_archive(folder, one, whole[-1]["offset"])] == [whole[-1]["record_id"]]
    raw = open(f"{folder.removeprefix('file://')}/{one}", "rb").read()
    (tmp_path / one).write_bytes(raw[:-5])
    with pytest.raises((warc.ArchiveError, zstandard.ZstdError)):
        list(warc.read_archive(f"file://{tmp_path}", one))


def test_chat_layouts_and_control_strings(spark):
    odd = r"</s>[INST] ok \<|end|> <|turn|> [/INST]\\"
    rows = [(1, '{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"yo"}]}'), (2, '{"instruction":"do","input":"x","output":"done"}'), (3, '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}'), (4, '{"strange":1}'), (5, None)]
    turns = chat.canonical_turns(spark.createDataFrame(rows, "id long, j string").select("id", F.parse_json("j").alias("r")), "id", "r")
    found = defaultdict(list)
    for r in turns.orderBy("id", "place").collect():
        found[r["id"]].append((r["role"], r["text"]))
    assert found[1] == [("user", "hi"), ("assistant", "yo")] and found[2] == [("user", "do\n\nx"), ("assistant", "done")] and found[3] == [("user", "q"), ("assistant", "a")]
    assert found[4] == [(None, None)] and found[5] == [(None, None)]
    own = spark.createDataFrame([(1, 0, 0, "user", odd), (1, 1, 0, "assistant", odd), (1, 2, 0, "assistant", None)], "id long, number long, place int, role string, text string")
    (r,) = chat.parse_chats(chat.format_chats(own, "id")).withColumn("loss", chat.loss_text()).collect()
    assert [(t["role"], t["text"]) for t in r["turns"]] == [("user", odd), ("assistant", odd), ("assistant", "")] and r["loss"] == odd


def test_models_and_clashing_columns(spark, docs):
    model = langid.fit(docs, F.lit(True))
    out = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert out[8]["lang_pred"] == out[9]["lang_pred"] == out[7]["lang_pred"] == "und" and out[12]["lang_pred"] == "de" and out[1]["lang_pred"] == "en"
    labels = spark.createDataFrame([(1, 0), (10, 1), (4, 0), (99, 1), (5, None), (None, 1)], "doc_id long, toxic int")
    rated = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert rated[10] >= 0.5 and max(rated[k] for k in (1, 7, 8, 11, 13)) < 0.5
    denied = toxicity.Grammar(toxicity._seed_lexicon())
    names = [toxicity.PATTERNS[denied.match(c)[0]] for c in ("you are an idiot.", "you are not an idiot.", "he said you are an idiot.", "i will kill you.")]
    assert names == ["aimed insult", "denied", "reported", "threat"] and denied.match("a nice day")[0] is None


def test_empty_tables(spark, none):
    assert jaccard.similar_components(none).count() == 0
    assert decontaminate.find_contamination(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert lm.score(none.withColumn("learn", F.lit(True))).count() == 0
    assert packing.pack(packing.token_pieces(none, "word_bpe_49k.json", False, 64), 64).count() == 0
    manifest, folder = tokenbin.write_shards(none, "byte_bpe_50k.json")
    assert tokenbin.read_shards(manifest, folder, "bigint").count() == 0
    assert langid.predict(none, langid.fit(none, F.lit(True))).count() == 0
    assert toxicity.score(none, toxicity.fit(none, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0
    assert media.read_media(spark, media.write_media(none, "doc_id", "text")[1]).count() == 0
    files, folder = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read_archives(files, folder).count() == 0


def test_media_digest_is_stable():
    assert hashlib.sha256(media.to_png(b"abc")).hexdigest() == hashlib.sha256(media.to_png(b"abc")).hexdigest()


@pytest.mark.parametrize("block, large", [(7, 3), (7, 4000)])
def test_near_duplicates_of_large_families(spark, tmp_path, monkeypatch, block, large):
    """A group of near copies, chains of texts that drift apart, and a passage that different texts share."""
    monkeypatch.setattr(jaccard, "BLOCK_NODES", block)
    monkeypatch.setattr(jaccard, "LARGE_NODES", large)
    rng = np.random.default_rng(7)
    base = [f"b{k}" for k in range(60)]
    texts = []
    for k in range(90):  # near copies of one text, by 0 to 4 words
        own = list(base)
        for at in rng.integers(0, 60, k % 5):
            own[at] = f"e{rng.integers(0, 12)}"
        texts.append(" ".join(own))
    for c in range(3):  # chains: neighbours are similar, ends are not
        for k in range(20):
            texts.append(" ".join(f"c{c}x{j}" for j in range(2 * k, 2 * k + 60)))
    passage = " ".join(f"p{k}" for k in range(40))
    texts += [f"{passage} " + " ".join(f"q{rng.integers(0, 30)}" for _ in range(12)) for _ in range(40)]
    path = str(tmp_path / "t")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(path)
    sets = [shingles(t, 4) for t in texts]
    root = list(range(len(sets)))

    def first(x):
        while root[x] != x:
            x = root[x]
        return x

    for b in range(len(sets)):
        for a in range(b):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = first(a), first(b)
                root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_components(spark.read.parquet(path), 85, 4).collect()}
    assert got == {k: first(k) for k in range(len(texts))}
