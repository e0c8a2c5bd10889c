"""Spelling variants, the Merkle manifest and quality rules against brute force on rows written by hand."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayfold.llm import merkle, quality, spelling

WORDS = "colour color colours honor honour honoûr étés étées aabbaa aabaa abbaa walked talked balked walks wa lking Walking WALKING walkin naïve naive mississippi missisippi".split()


def lower(s):
    return s.translate({c: c + 32 for c in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """Rows with repeated ids and rows, null ids, texts and languages, and columns named like the operators' own."""
    rng = np.random.default_rng(5)
    rows = [(int(k), " ".join(rng.choice(WORDS, 40)) + " 12,ab", ["en", "fr", None][k % 3], "src", int(k) * 7, "w", 1) for k in range(60)]
    rows += [rows[3], rows[3], (3, "Other TEXT", "en", None, None, None, None), (None, "walked Walked walked " * 3, "en", "s", 1, "x", 2), (70, None, None, "s", 2, "x", 3), (71, "", "de", "s", 0, "x", 4), (72, "x" * 5000 + " " + "x" * 4999 + "y", "zz", "s", 9, "y", 5)]
    rows += [(80 + k, "x" * 5000 + " " + "x" * 4999 + "y " + "x" * 4999, "zz", "s", 9, "y", 5) for k in range(3)]
    path = str(tmp_path_factory.mktemp("docs") / "t")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, word string, path int").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def brute_variants(rows, divisor):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if divisor and h % divisor == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 5
    n = {w: c for w, c in n.items() if c >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
        return len(b) == len(a) + 1 and a[i:] == b[i + 1 :]

    by = {w: [v for v in n if near(w, v)] for w in n}
    best = {w: min(by[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: b if b and n[b] >= 2 * n[w] else None for w, b in best.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, n[w], form[w] or "", root(w), len(by[w]), n.get(form[w], 0)) for w in n)


@pytest.mark.parametrize("divisor", [None, 3, 97])
def test_variants(docs, divisor):
    got = spelling.variants(docs, divisor=divisor).collect()
    want = brute_variants([(r["doc_id"], r["text"]) for r in docs.collect()], divisor)
    assert sorted((r["word"], r["n"], r["form"] or "", r["root"], r["n_near"], r["form_n"] or 0) for r in got) == want and len(want) > 15


def test_variants_of_nothing(docs):
    assert spelling.variants(docs.limit(0)).collect() == spelling.variants(docs.where("text is null")).collect() == []


def test_deletion_keys_are_those_of_the_shorter_words():
    words = ["abcab", "aabbc", "aaaaa", "zèbre"]
    points = np.array([[ord(c) for c in w] for w in words], np.uint64)
    without, own, first = spelling.deletion_keys(points)
    for w, keys, key, firsts in zip(words, without, own, first):
        for i in range(5):
            rest = np.array([[ord(c) for c in w[:i] + w[i + 1 :]]], np.uint64)
            assert spelling.deletion_keys(rest)[1][0] == keys[i] and firsts[i] == (i == 0 or w[i] != w[i - 1])
        assert len(set(keys.tolist())) == len({w[:i] + w[i + 1 :] for i in range(5)}) and key not in keys


def test_equal_hashes_of_unlike_words_link_nothing(spark, monkeypatch):
    real = spelling._keys

    def colliding(batches):  # all keys and places equal: every word meets every other
        for b in real(batches):
            yield b.set_column(0, "key", pa.array(np.zeros(b.num_rows, np.int64)))

    monkeypatch.setattr(spelling, "_keys", colliding)
    words = spark.createDataFrame([("walked", 9), ("talked", 3), ("walks", 5), ("mississippi", 4), ("walkedx", 1)], "word string, n long")
    got = {r["word"]: (r["n_near"], r["best"]) for r in spelling.near_words(words).collect()}
    assert {w: v for w, v in got.items() if v[0]} == {"walked": (2, "talked"), "talked": (1, "walked"), "walkedx": (1, "walked")}


def brute_manifest(rows):
    """rows: (doc, lang, leaf, forged). Levels as lists of lists."""
    H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()

    def path(level, i):
        out = []
        while len(level) > 1:
            s = i // 8 * 8
            out.append((level[s:i], level[i + 1 : s + 8]))
            level, i = [H(*level[k : k + 8]) for k in range(0, len(level), 8)], i // 8
        return out, level[0]

    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in langs:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    subroots = [path([r[2] for r in groups[g]], 0)[1] for g in langs]
    for k, g in enumerate(langs):
        high, root = path(subroots, k)
        for i, r in enumerate(groups[g]):
            low, subroot = path([x[2] for x in groups[g]], i)
            node, sides = r[3] or r[2], ""
            for left, right in low + high:
                node, sides = H(*left, node, *right), sides + "".join(left + right)
            yield (r[0], r[2], subroot, root, H(sides), node)


def of_rows(found):
    out = found.select(F.col("row.doc_id").alias("d"), "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("p"), merkle.fold(F.coalesce("row.forged", "leaf"), F.col("path")).alias("f"))
    return sorted(map(tuple, out.collect()), key=repr)


def leaves(docs):
    forged = F.when(F.col("doc_id") % 3 == 0, merkle.leaf(F.col("doc_id"), F.lower("text")))
    return docs.select("*", merkle.leaf(F.col("doc_id"), F.col("source"), F.col("text")).alias("leaf"), forged.alias("forged"))


def test_manifest(docs):
    rows = leaves(docs)
    want = brute_manifest([(r["doc_id"], r["lang"], r["leaf"], r["forged"]) for r in rows.collect()])
    assert of_rows(merkle.manifest(rows, "lang", "doc_id")) == sorted(want, key=repr)
    first = rows.where("doc_id = 71").first()
    assert first["leaf"] == hashlib.sha256(b"2:711:s0:").hexdigest()
    assert rows.where("doc_id = 70").first()["leaf"] == hashlib.sha256(b"2:701:s-").hexdigest()


@pytest.mark.parametrize("n", [1, 8, 9, 512, 513, 4097])
def test_manifest_of_several_rounds(spark, n):
    rows = leaves(spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("T"), "id").alias("text"), F.lit("s").alias("source"), F.when(F.col("id") % 700 != 5, "en").alias("lang")))
    want = brute_manifest([(r["doc_id"], r["lang"], r["leaf"], r["forged"]) for r in rows.collect()])
    assert of_rows(merkle.manifest(rows, "lang", "doc_id")) == sorted(want, key=repr)


def test_manifest_of_nothing(docs):
    assert merkle.manifest(leaves(docs).limit(0), "lang", "doc_id").collect() == []


def brute_counts(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(grams)
    hit = {i + j for i, g in enumerate(grams) if seen[g] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit), len(lines), len(re.findall("[A-Z]", text)), len(re.findall("[!?=_~^]", text)), sum(a == b for a, b in zip(words, words[1:])))


def test_counts_of_texts():
    rng = np.random.default_rng(3)
    texts = ["", " \n\t", "a", "a b c d e f g h", "a b c d e f g h " * 2, "a " * 9, "x\x1cy z   w\x85", "L one\n\nL one\n L one\nL one ", "é# É! *b*", "one two three four five six seven eight nine\n" * 3 + "end"]
    texts += [" ".join(rng.choice(list("abc"), 60)) + "\n" + " ".join(rng.choice(list("ab"), 30)) for _ in range(40)] + ["word " * 30_000]
    for t in texts:
        assert quality.counts_of(t) == brute_counts(t), t[:50]


def test_binomial_bound():
    for n, k, p in [(1, 0, 0.5), (20, 3, 0.1), (300, 9, 0.05), (50, 50, 0.3)]:
        assert math.isclose(quality.chance_of_so_few(k, n, p), sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel_tol=1e-9)
    assert quality.certified([0, 0, 1, 40, 40], 400, 0.05, 0.01) == 2
    assert quality.certified([0], 10, 0.05, 0.01) == -1 and quality.certified([0, 9, 0], 100, 0.05, 0.01) == 0


def test_ladder():
    h = np.zeros(101, np.int64)
    h[[0, 3, 8]] = 990, 9, 1
    assert quality.ladder(h) == [32, 24, 16, 12, 10, 8, 8, 3]


@pytest.fixture(scope="module")
def rated(spark):
    """600 good English rows, 90 loud ones, 40 French rows of which too few are labelled, and odd ones."""
    base = "some words that make up a plain row of text number {0} and go on for more than twenty words so that it passes all the base rules {0}"
    rows = [(k, base.format(k), "en", 1) for k in range(600)] + [(600 + k, base.format(k).upper() + " !!!! $$$$", "en", 0) for k in range(90)] + [(700 + k, base.format(k), "fr", 1) for k in range(40)]
    rows += [(800, base.upper() + " !!!! $$$$", "fr", None), (801, base.upper() + " !!!! $$$$", None, None), (802, None, "en", None), (None, base, "en", None), (803, "short", "en", 1), (804, "a b c d e f g h i j " * 5, "en", None), (1, base.upper() + "$$$$", "en", None)]
    docs = spark.createDataFrame([r[:3] + ("n",) for r in rows], "doc_id long, text string, lang string, n_words string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows if r[3] is not None] + [(None, 1), (4, None)], "doc_id long, quality int")
    return docs, labels


def test_verdicts(rated):
    docs, labels = rated
    out = quality.judge(docs, labels, risk=0.05).collect()
    assert len(out) == docs.count()
    of = defaultdict(list)
    for r in out:
        of[r["row"]["doc_id"]].append((r["base_failed"], r["kept"]))
    loud = [of[k] for k in range(600, 690)]
    assert all(v == [(False, False)] for v in loud)  # rejected by a certified step
    assert sum(not v[-1][1] for k, v in of.items() if k is not None and 1 < k < 600) <= 600 * 0.05
    assert of[800] == [(False, True)] and of[801] == [(False, True)]  # strata without labels enough reject nothing
    assert of[802] == of[803] == of[804] == [(True, False)] and of[None] == [(False, True)]
    assert sorted(of[1]) == [(False, False), (False, True)]  # rows that share an id, each by its own text


def test_guarantee_holds_over_draws():
    """Over many draws of labels, the share in which the true rate of the chosen step exceeds the risk stays below error."""
    rng = np.random.default_rng(1)
    rates, risk, error, n, bad = [0.0, 0.02, 0.04, 0.055, 0.08], 0.05, 0.1, 400, 0
    for _ in range(400):
        u = rng.random(n)
        step = quality.certified([int((u < r).sum()) for r in rates], n, risk, error)
        bad += step >= 0 and rates[step] > risk
    assert bad / 400 <= error


def test_quality_of_nothing(rated):
    docs, labels = rated
    assert quality.judge(docs.limit(0), labels).collect() == []
    assert all(r["kept"] for r in quality.judge(docs.where("doc_id between 10 and 20"), labels.limit(0)).collect())
