"""The numbered queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import chat, decontaminate, jaccard, langid, lm, media, merkle, packing, quality, spelling, tokenbin, toxicity, warc


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _remainder(column: str, divisor: int) -> Column:
    """crc32 of a column as text, modulo a divisor."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def op1_media(spark: SparkSession, folder: str) -> DataFrame:
    """All texts as images in archives, read back by the data source."""
    docs = table(spark, folder, "documents")
    _, archives = media.write_media(docs, "doc_id", "text")
    found = media.describe(media.read_media(spark, archives))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.select(
        media.member_key("member", kind).alias("doc_id"),
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("content").cast("long").alias("media_bytes"),
        F.sha2("content", 256).alias("media_sha256"),
        "feature",
    )


def op2_chat(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, and one whose texts are control strings, formatted and read back."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-7).cast(turns.schema["conv_id"].dataType).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    records = turns.union(own).select("conv_id", F.to_variant_object(F.struct("turn", "role", "text")).alias("record"))
    formatted = chat.format_chats(chat.canonical_turns(records, "conv_id", "record"), "conv_id")
    back = chat.parse_chats(formatted).withColumn("loss", chat.loss_text())
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    """All pages as WARC records, read back from the archives."""
    pages = table(spark, folder, "pages")
    files, archives = warc.write_archives(pages, least=0)
    kind = pages.schema["page_id"].dataType.simpleString()
    records = warc.read_archives(files, archives, payloads=False)
    return records.select(
        warc.page_id("record_id", kind).alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", warc.page_id("refers_to", kind).alias("refers_to")
    )


def toxicity_model(spark: SparkSession, folder: str) -> toxicity.ToxicityModel:
    """Learned from the labelled documents that are not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text").where(F.coalesce(_remainder("doc_id", 5) != 0, F.lit(False)))
    return toxicity.fit(docs, table(spark, folder, "labels").where(F.coalesce(_remainder("doc_id", 5) != 0, F.lit(False))))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of all documents."""
    rated = toxicity.score(table(spark, folder, "documents").select("doc_id", "text"), toxicity_model(spark, folder))
    held_out = F.coalesce(_remainder("doc_id", 5) == 0, F.lit(False))
    return rated.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, packed into sequences of at most 2048 tokens."""
    pieces = packing.token_pieces(table(spark, folder, "documents"), "word_bpe_49k.json", keeps_space=False, capacity=2048)
    return packing.pack(pieces, capacity=2048)


def language_model(spark: SparkSession, folder: str) -> langid.KernelModel:
    """Learned from the documents that are not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return langid.fit(docs, F.coalesce(_remainder("doc_id", 3) != 1, F.lit(True)))


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of all documents, learned from those that are not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.coalesce(_remainder("doc_id", 3) == 1, F.lit(False))
    return langid.predict(docs, language_model(spark, folder)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of ten words that documents share with benchmark items."""
    found = decontaminate.find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), size=10)
    digest = F.sha2(F.concat_ws(",", "items"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """All documents under a model of those that are not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text", F.coalesce(_remainder("doc_id", 5) != 1, F.lit(True)).alias("learn"))
    held_out = F.coalesce(_remainder("doc_id", 5) == 1, F.lit(False))
    return lm.score(docs).withColumn("held_out", held_out)


def op9_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Components of all documents by 4-word shingles at a similarity of 0.85."""
    return jaccard.similar_components(table(spark, folder, "documents"), percent=85, size=4)


def op10_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    """All documents' ids, written as shards in doc_id order and read back through their index."""
    docs = table(spark, folder, "documents")
    manifest, shards = tokenbin.write_shards(docs, "byte_bpe_50k.json")
    found = tokenbin.read_shards(manifest, shards, docs.schema["doc_id"].dataType.simpleString())
    return found.withColumnRenamed("key", "doc_id")


def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all documents, with planted misspellings, their near words and forms."""
    return spelling.variants(table(spark, folder, "documents"), divisor=97)


def op12_merkle(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of all documents by language, with proofs, and what a third of tampered rows fold to."""
    docs = table(spark, folder, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = [F.translate("text", decontaminate.UPPER, decontaminate.LOWER) if f == "text" else F.col(f) for f in fields]
    forged = F.when(_remainder("doc_id", 3) == 0, merkle.leaf(*tampered))
    rows = docs.select("doc_id", "lang", merkle.leaf(*(F.col(f) for f in fields)).alias("leaf"), forged.alias("forged"))
    found = merkle.manifest(rows, "lang", "doc_id")
    folded = merkle.fold(F.coalesce("row.forged", "leaf"), F.col("path"))
    whole = found.select(F.col("row.doc_id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return whole.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of all documents by rules whose thresholds are certified per language."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    judged = quality.judge(docs, table(spark, folder, "labels"))
    return judged.select(F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media": op1_media,
    "op2_chat": op2_chat,
    "op3_warc": op3_warc,
    "op4_toxicity": op4_toxicity,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_language_id": op6_language_id,
    "op7_decontamination": op7_decontamination,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_token_ids": op10_token_ids,
    "op11_spelling": op11_spelling,
    "op12_merkle": op12_merkle,
    "op13_quality": op13_quality,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_TOKENS = f"regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+')"

#: Base-32 of a SHA-1 in hexadecimal: 5 hexadecimal digits are 4 of base 32.
_BASE32 = """array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + CAST(
  (CAST(('0x' || h[1 + 5 * (i // 4):5 + 5 * (i // 4)]) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT)]), '')"""

def _escaped(text: str) -> str:
    return rf"regexp_replace(replace({text}, '\', '\\'), '([<\[])(\||/?s>|/?INST\]|</?SYS>>)', '\1\\\2', 'g')"


#: The table of the reflected CRC-32, and the crc32 of a list of bytes by it.
_CRC_TABLE = "crc AS MATERIALIZED (SELECT list(list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384), i) ORDER BY i) AS t FROM range(256) r(i))"


def _crc32(data: str) -> str:
    return f"xor(list_reduce({data}, lambda a, b: xor(a >> 8, t[1 + xor(a & 255, b)]), CAST(4294967295 AS BIGINT)), 4294967295)"


def _bytes(text: str) -> str:
    """UTF-8 of a text of code points below 256."""
    return f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [194 + unicode(c) // 192, unicode(c) - unicode(c) // 192 * 64] END))"


def _leaf(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


def _tree(nodes: str, levels: str) -> str:
    """Levels of the trees of nodes (g, k, h), and each node's siblings before and after it."""
    return f"""
{levels}(level, g, k, h) AS (SELECT 0, g, k, h FROM {nodes} UNION ALL
  SELECT any_value(level) + 1, g, k // 8, sha256(string_agg(h, '' ORDER BY k)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {levels}) WHERE c > 1 GROUP BY g, k // 8),
{levels}_top AS (SELECT g, max(level) AS top, arg_max(h, level) AS h FROM {levels} GROUP BY g),
{levels}_near AS (SELECT a.g, a.level, a.k, coalesce(string_agg(b.h, '' ORDER BY b.k) FILTER (b.k < a.k), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.k) FILTER (b.k > a.k), '') AS r
  FROM {levels} a JOIN {levels} b ON a.g = b.g AND a.level = b.level AND a.k // 8 = b.k // 8 JOIN {levels}_top p ON p.g = a.g AND a.level < p.top GROUP BY ALL)"""


ORACLES: dict[str, str] = {
    "op11_spelling": f"""
WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all({_LOWER}, '[a-zÀ-ÿ]+')) AS w FROM documents),
c AS (SELECT d, w, count(*) AS n FROM r GROUP BY d, w),
k AS (SELECT w, n, {_crc32(_bytes("d || ':' || w"))} AS h FROM c, crc),
v AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, n FROM k),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM v WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
x AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
del AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM x),
pairs AS (SELECT a.word, b.word AS other, b.n AS m FROM del a JOIN del b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
          UNION SELECT a.word, b.word, b.n FROM del a JOIN words b ON a.rest = b.word
          UNION SELECT b.word, a.word, a.n FROM del a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m, min(other) FILTER (top) AS other
         FROM (SELECT *, m = max(m) OVER (PARTITION BY word) AS top FROM pairs) GROUP BY word),
f AS (SELECT word, n, n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM words LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.form, walk.root, coalesce(f.n_near, 0) AS n_near, f.form_n
FROM f JOIN walk ON walk.word = f.word JOIN f e ON e.word = walk.root AND e.form IS NULL""",
    "op12_merkle": f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT row_number() OVER () AS id, doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, {_leaf('text')} AS leaf,
      CASE WHEN {_crc32(_bytes('CAST(doc_id AS VARCHAR)'))} % 3 = 0 THEN {_leaf(_LOWER.replace("coalesce(text, '')", 'text'))} END AS forged FROM documents, crc),
l AS MATERIALIZED (SELECT *, leaf AS h, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k FROM d),
{_tree("l", "low")},
s AS (SELECT 0 AS g, g AS k, h FROM low_top),
{_tree("s", "high")},
walk(id, g, k, level, h, sides) AS (SELECT id, g, k, 0, coalesce(forged, leaf), '' FROM l UNION ALL
  SELECT id, w.g, w.k // 8, w.level + 1, sha256(n.l || w.h || n.r), sides || n.l || n.r FROM walk w JOIN low_near n ON n.g = w.g AND n.level = w.level AND n.k = w.k),
high_walk(id, k, level, h, sides) AS (SELECT id, w.g, 0, w.h, sides FROM walk w JOIN low_top t ON t.g = w.g AND t.top = w.level UNION ALL
  SELECT id, w.k // 8, w.level + 1, sha256(n.l || w.h || n.r), sides || n.l || n.r FROM high_walk w JOIN high_near n ON n.level = w.level AND n.k = w.k)
SELECT doc_id, leaf, t.h AS subroot, o.h AS root, sha256(sides) AS proof_sha256, w.h AS folded_root, w.h = o.h AS verified
FROM l JOIN low_top t ON t.g = l.g JOIN high_top o ON true JOIN high_walk w ON w.id = l.id AND w.level = o.top""",
    "op2_chat": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) t(i)),
g AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole,
      coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
      sum(length('<|turn|><|text|><|end|>') + length({_escaped('role')}) + length({_escaped('text')})) AS chars FROM c GROUP BY conv_id)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, sha256(whole) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g""",
    "op3_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (h)""",
    "op7_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS t, least(10, len(w)) AS n
        FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
grams AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS t
          FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
m AS (SELECT r, i, grams.n, item_id FROM grams JOIN win USING (t, n)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM m)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)""",
    "op9_ngram_jaccard": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM d),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT a AS doc_id, b AS r FROM links UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.r = links.a)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM s LEFT JOIN (SELECT doc_id, min(r) AS m FROM reach GROUP BY doc_id) USING (doc_id)""",
}
