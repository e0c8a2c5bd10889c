"""The corpus pipeline: language, toxicity, near duplicates, contamination, packing.

Each stage takes (spark, docs, folder), works on all rows of docs and returns what it keeps with the columns of
documents; the last returns packed pieces. run() writes every stage's result to the shared folder and reads it again.

A row is known by its doc_id and its text together: rows that share a doc_id are judged each by its own text. Rows that
are equal in both are copies of one document, of which the near-duplicate stage keeps one (any one, if further columns
differ). A null doc_id stays and is the least of a group. Null texts, empty ones and texts without a letter go in the
first stage; given to a later stage they stay, and are packed as their end id alone. An empty table gives no rows.
Further columns of documents are carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import decontaminate, jaccard, langid, packing, toxicity
from wayfold.llm.queries import language_model, table, toxicity_model
from wayfold.llm.shared import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
KEY = ["doc_hash", "text_hash"]


def _whole(docs: DataFrame) -> DataFrame:
    """All columns in one, so that no column of documents can clash with an operator's, and what operators read: the text
    and a key, which is doc_id and two hashes that stand for doc_id and text."""
    hashes = F.xxhash64("doc_id", "text").alias(KEY[0]), F.xxhash64("text", F.lit(1), "doc_id").alias(KEY[1])
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text", F.struct("doc_id", *hashes).alias("key"))


def keep_known_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop documents without a language: null texts and texts without a letter."""
    marked = langid.predict(_whole(docs).drop("key"), language_model(spark, folder))
    return marked.where(F.col("lang_pred") != langid.UNKNOWN).select("row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop documents whose score is 0.5 or more."""
    return toxicity.score(_whole(docs).drop("key"), toxicity_model(spark, folder)).where("score < 0.5").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keep one document of each component of near duplicates, that with the least doc_id; five words, 0.8."""
    found = jaccard.similar_components(_whole(docs).select("key", "text"), percent=80, size=5, key="key")
    kept = found.where("key <=> component_id").groupBy("key").agg(F.count("*").alias("copies"))
    kept, _ = materialise(kept.select("key.*", "copies").select(*KEY, "copies"), "kept")
    rows = _whole(docs).select("row", "key.*").select("row", *KEY).join(kept, KEY)
    # repeated rows share their key: one stays
    one = rows.where("copies > 1").groupBy(*KEY).agg(F.any_value("row").alias("row"))
    return rows.where("copies = 1").select("row.*").union(one.select("row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop documents that share a window of ten words with a benchmark item."""
    found = decontaminate.find_contamination(_whole(docs).select("key", "text"), table(spark, folder, "benchmark"), size=10, key="key")
    hit, _ = materialise(found.where("n_hit > 0").select("key.*").select(*KEY).distinct(), "hit")
    return _whole(docs).select("row", "key.*").join(hit, KEY, "left_anti").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens."""
    return packing.pack(packing.token_pieces(docs, "word_bpe_49k.json", keeps_space=False, capacity=2048), capacity=2048)


STAGES: list[tuple[str, Stage]] = [
    ("language identification", keep_known_language),
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: SQL can express neither the models of the first two stages nor the tokenizer of the last.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for name, stage in STAGES:
        docs, _ = materialise(stage(spark, docs, folder), name.replace(" ", "-"))
    return docs
