"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations alone.

The index holds a posting (term, document, position) for every occurrence of a benchmark term in the training
documents. Each benchmark window orders its terms from the rarest on. The postings of its two rarest terms, each moved
back by the term's offset in the window, are intersected first; what remains is held against the lists of the other
terms. A start that is in all lists is an exact phrase match. Within `slop`, a proximity match is a document that has
all the window's distinct terms from the rarest one's position - slop to its position + slop.

Words: A-Z lower-cased; by default runs of ASCII digits and letters and of all characters beyond ASCII. A window is
`size` consecutive words of an item; an item of fewer words, but not none, is one window. Nulls: a null text has no
words; documents and items with null ids are kept (a null item id is left out of items). Equal documents and equal
windows count each for itself. Empty tables give no matches. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.shared import materialise, release

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of a stored table that may be sent to all executors; a larger one is joined by a shuffle.
BROADCAST_BYTES = 32 << 20
SEEDS = 2


def words(text: str | Column, pattern: str = WORD) -> Column:
    column = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.translate(F.coalesce(column, F.lit("")), UPPER, LOWER), F.lit(pattern), F.lit(0))


def _sent(table: DataFrame) -> DataFrame:
    """Broadcast a table whose measured size is small; otherwise leave the join to a shuffle."""
    wide = [F.octet_length(c) for c, kind in table.dtypes if kind == "string"]
    row = sum(wide, F.lit(16 * len(table.columns)))
    size = table.agg(F.sum(row.cast("long"))).first()[0] or 0
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Two hashes name a document by its id and text, so that rows that share an id stay apart."""
    return docs.select(F.col(key).alias("doc"), F.col(text).alias("text"), F.xxhash64(key, text).alias("k1"), F.hash(key, text, F.lit(7)).alias("k2"))


def windows(items: DataFrame, size: int, key: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(window, terms, n) for each distinct window of the items, and (window, item)."""
    split = items.select(F.col(key).alias("item"), words(text).alias("w")).where("size(w) > 0")
    cut = split.select("item", F.explode(F.expr(f"transform(sequence(1, greatest(1, size(w) - {size - 1})), i -> slice(w, i, {size}))")).alias("terms"))
    named = cut.withColumn("window", F.sha2(F.concat_ws(" ", "terms"), 256)).withColumn("n", F.size("terms"))
    named, _ = materialise(named, "windows")
    return named.groupBy("window").agg(F.first("terms").alias("terms"), F.first("n").alias("n")), named.select("window", "item").distinct()


def build_index(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (k1, k2, term, pos) of the given terms (word, term) in all documents, stored in the shared folder."""
    occurrences = _keyed(docs, key, text).select("k1", "k2", F.posexplode(words("text")).alias("pos", "word"))
    postings = occurrences.join(_sent(terms), "word").select("k1", "k2", "term", "pos")
    return materialise(postings, "postings")[0]


def phrase_matches(index: DataFrame, terms: DataFrame, distinct_windows: DataFrame) -> DataFrame:
    """Exact matches (k1, k2, window, start, n)."""
    frequency, _ = materialise(index.groupBy("term").agg(F.count("*").alias("df")), "frequency")  # stored: a common term's part of the join can be split
    needed = distinct_windows.select("window", "n", F.posexplode("terms").alias("offset", "word")).join(_sent(terms), "word").join(_sent(frequency), "term")
    whole = Window.partitionBy("window")
    order = whole.orderBy("df", "offset")
    lists = needed.withColumn("found", F.count("*").over(whole)).where("found = n").withColumn("rank", F.row_number().over(order))
    lists, _ = materialise(lists.select("window", "n", "term", "offset", "rank"), "lists")

    def moved(rank: int) -> DataFrame:
        seeds = lists.where(F.col("rank") == rank).select("window", "n", "term", "offset")
        found = index.join(_sent(seeds), "term").select("k1", "k2", "window", "n", (F.col("pos") - F.col("offset")).alias("start"))
        return found.where("start >= 0")

    on = ["k1", "k2", "window", "start"]
    first = moved(1)
    met = first.where("n >= 2").join(moved(2).select(*on), on, "left_semi").union(first.where("n = 1").select(*on, "n"))
    # copies of a document share k1 and k2: each start once, as the lists of one copy
    starts, _ = materialise(met.select(*on, "n").distinct(), "starts")
    # the other lists, only of documents that are left
    rest = starts.where(F.col("n") > SEEDS).join(lists.where(F.col("rank") > SEEDS).select("window", "term", "offset"), "window")
    asked = rest.select(*on, "n", "term", (F.col("start") + F.col("offset")).alias("pos"))
    documents, _ = materialise(starts.where(F.col("n") > SEEDS).select("k1", "k2").distinct(), "documents")
    near = index.join(_sent(documents), ["k1", "k2"], "left_semi")
    held = asked.join(near, ["k1", "k2", "term", "pos"], "left_semi").groupBy(*on, "n").agg(F.count("*").alias("held"))
    matches = held.where(F.col("held") == F.col("n") - SEEDS).select(*on, "n").union(starts.where(F.col("n") <= SEEDS))
    return materialise(matches, "matches")[0]


def proximity_matches(index: DataFrame, terms: DataFrame, distinct_windows: DataFrame, slop: int) -> DataFrame:
    """Matches (k1, k2, window, pos): all distinct terms of the window within slop words of its rarest term at pos."""
    frequency = index.groupBy("term").agg(F.count("*").alias("df"))
    needed = distinct_windows.select("window", F.explode(F.array_distinct("terms")).alias("word")).join(terms, "word", "left").join(frequency, "term", "left")
    whole = Window.partitionBy("window")
    lists = needed.withColumn("n", F.count("*").over(whole)).withColumn("found", F.count("df").over(whole)).where("found = n")
    lists = lists.withColumn("rank", F.row_number().over(whole.orderBy("df", "term")))
    lists, _ = materialise(lists.select("window", "n", "term", "rank"), "lists")
    rarest = index.join(lists.where("rank = 1").select("window", "n", "term"), "term").select("k1", "k2", "window", "n", F.col("pos").alias("at"))
    asked = rarest.join(lists.where("rank > 1").select("window", "term"), "window")
    near = asked.join(index, ["k1", "k2", "term"]).where(F.abs(F.col("pos") - F.col("at")) <= slop)
    full = near.groupBy("k1", "k2", "window", "n", "at").agg(F.count_distinct("term").alias("held")).where("held = n - 1").drop("held")
    return full.union(rarest.where("n = 1")).select("k1", "k2", "window", F.col("at").alias("pos")).distinct()


def find_contamination(docs: DataFrame, items: DataFrame, size: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of docs: key, n_words, n_hit (words within any occurrence of a window), items (sorted ids as strings)."""
    distinct_windows, items_of = windows(items, size, item_key, item_text)
    distinct_windows, _ = materialise(distinct_windows, "windows")
    terms, _ = materialise(distinct_windows.select(F.explode("terms").alias("word")).distinct().withColumn("term", F.xxhash64("word")), "terms")
    matches = phrase_matches(build_index(docs, terms, key, text), terms, distinct_windows)
    release(docs.sparkSession)

    spans = matches.groupBy("k1", "k2", "start").agg(F.max("n").alias("n"))
    before = Window.partitionBy("k1", "k2").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max(F.col("start") + F.col("n")).over(before), F.lit(0))
    hit = spans.withColumn("new", F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest("start", reached)))
    hits = hit.groupBy("k1", "k2").agg(F.sum("new").alias("n_hit"))
    pairs = matches.select("k1", "k2", "window").distinct().join(_sent(items_of), "window").select("k1", "k2", F.col("item").cast("string").alias("item"))
    found = pairs.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item")).alias("items"))
    known = hits.join(found, ["k1", "k2"])
    counted = _keyed(docs, key, text).select("doc", "k1", "k2", F.size(words("text")).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    joined = counted.join(known, ["k1", "k2"], "left")
    return joined.select(F.col("doc").alias(key), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"))
