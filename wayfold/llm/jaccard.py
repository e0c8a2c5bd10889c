"""Exact near-duplicate join of word-shingle sets by prefixes under several global orders of shingles.

A document's set is its distinct SHINGLE-word shingles. Two sets with Jaccard similarity of at least t share a shingle
within their first |x| - ceil(t |x|) + 1 shingles under any one order of all shingles. Here every order puts shingles of
one document first and otherwise rarer ones before commoner ones, by three different scales and hashes; what few
documents share stands in the prefixes, and a passage that many documents share does not. A candidate pair must meet in
the prefixes of all orders, and fit in size, before its sets are compared.

Documents with equal sets are one node. Nodes that share tokens of their first prefixes, directly or through others, are
a family. A family is dealt to blocks of about BLOCK_NODES nodes and two blocks are compared by one task, where the
prefixes of all orders mask the pairs before sets are compared. In a family of more than LARGE_NODES nodes every token's
nodes first meet one of them (its head), each node the head with which it shares most tokens: one comparison a node and
round, however many near copies a group has. Only tokens that then still lie in several components make up families
again, and a block of one component is not compared with another block of it. So no link between different components
is lost; a group of near copies costs what its stragglers times its nodes cost, but F nodes of one family that are all
unlike each other are copied F / BLOCK_NODES times and compared in pairs.

Words: A-Z lower-cased, split at ASCII white space. A document with fewer words than a shingle has one shingle, all of
them; without words (or null) its set is empty and linked with nothing. Null keys are kept. Repeated rows are one node.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.bytescan import column_bytes, mix, word_hashes
from wayfold.llm.components import components
from wayfold.llm.counts import Grams, corpus_counts, parts
from wayfold.llm.shared import materialise, release

ORDERS = 3
#: Expected nodes in a block, and rows of several small blocks that share a task.
BLOCK_NODES, TASK_ROWS = 1000, 3000
#: Nodes of a family beyond which they are compared with heads first, and rounds of that.
LARGE_NODES, ROUNDS = 4000, 2
#: Rows of ids (of some 60 bytes each) that may be sent to all executors.
BROADCAST_ROWS = 200_000
_STEP = np.uint64(0xE7037ED1A0B428DB)
#: Bytes of a stored shingle hash.
_STORED = 6


def _shingles(part: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, and where each document's begin (rows + 1)."""
    hashes, starts = word_hashes(*column_bytes(part["text"]))
    n = len(hashes) - size + 1
    rolled = hashes
    if n > 0:
        rolled = hashes[:n]
        for k in range(1, size):
            rolled = mix(rolled * _STEP + hashes[k : k + n])
    sets, empty = [], np.zeros(0, dtype=np.uint64)
    for begin, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if end - begin >= size:
            own = np.sort(rolled[begin : end - size + 1])
            sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif end > begin:
            whole = hashes[begin : begin + 1]
            for k in range(begin + 1, end):
                whole = mix(whole * _STEP + hashes[k : k + 1])
            sets.append(mix(whole ^ np.uint64(end - begin)))
        else:
            sets.append(empty)
    upto = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else empty), upto


def _short(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(32)).astype(np.uint32)


def _ranks(shingles: np.ndarray, count: np.ndarray) -> Iterator[np.ndarray]:
    """The permutation that sorts shingles under each global order, all of more than one document."""
    bits = np.ceil(np.log2(count))
    for k, scale in enumerate((count, bits, bits // 2)):
        yield np.lexsort((mix(shingles + np.uint64(k + 1)), scale))


def _token(shingles: np.ndarray) -> np.ndarray:
    """Short names of shingles in prefixes; two with one name only make more candidates."""
    return _short(shingles).view(np.int32)


def _pack(shingles: np.ndarray) -> bytes:
    return np.sort(shingles & np.uint64((1 << 8 * _STORED) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_STORED].tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    raw = np.zeros((len(blob) // _STORED, 8), dtype=np.uint8)
    raw[:, :_STORED] = np.frombuffer(blob, dtype=np.uint8).reshape(-1, _STORED)
    return raw.view("<u8").ravel()


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of the sets at `left` with those at `right`, by products of presence matrices."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, which, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    used = count[which] > 1
    owner, column = owner[used], shared[which[used]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        part = slice(*np.searchsorted(column, [low, low + width]))
        present = np.zeros((len(sets), width), dtype=np.float32)
        present[owner[part], column[part] - low] = 1
        out += present[left] @ present[right].T
    return out


def _block_links(table: pa.Table, percent: int) -> list[tuple[int, int]]:
    """A spanning forest, each row linked with the first of its tree, of the similar pairs between two blocks (or in one)."""
    n = table["n_shingles"].to_numpy().astype(np.int64)
    second = table["second"].to_numpy(zero_copy_only=False)
    left, right = np.flatnonzero(~second), np.flatnonzero(second if second.any() else ~second)
    meet = 100 * np.minimum.outer(n[left], n[right]) >= percent * np.maximum.outer(n[left], n[right])
    meet &= True if second.any() else np.less.outer(left, right)
    for k in range(ORDERS):
        if not meet.any():
            return []
        lists = table[f"prefix_{k + 1}"].combine_chunks()
        values, upto = lists.values.to_numpy(), lists.offsets.to_numpy()
        meet &= _overlaps([values[b:e] for b, e in zip(upto[:-1], upto[1:], strict=True)], left, right) > 0
    if not meet.any():
        return []
    common = _overlaps([_unpack(x) for x in table["shared"].to_pylist()], left, right).astype(np.int64)
    similar = meet & (100 * common >= percent * (np.add.outer(n[left], n[right]) - common))
    root = list(range(len(n)))

    def first(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in np.argwhere(similar).tolist():
        x, y = first(int(left[a])), first(int(right[b]))
        root[max(x, y)] = min(x, y)
    return [(first(x), x) for x in range(len(n)) if first(x) != x]


def document_sets(docs: DataFrame, percent: int, size: int, key: str, text: str) -> DataFrame:
    """key, row (a number), node (digest of the set; null if empty), n_shingles; and for documents that share a prefix shingle with
    another: prefix_1..3 (their shared shingles, by order) and shared (the shingles of more than one document)."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def counted(sets: np.ndarray) -> Grams:
        keys, count = np.unique(_short(sets), return_counts=True)
        return {1: (keys, count)}

    totals = corpus_counts(rows, lambda part: counted(_shingles(part, size)[0]), "shingles")
    fields = [("key", None), ("row", pa.int64()), ("node", pa.binary()), ("n_shingles", pa.int64()), *((f"prefix_{k + 1}", pa.list_(pa.int32())) for k in range(ORDERS)), ("shared", pa.binary())]

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        assert context is not None
        done = context.partitionId() << 33
        for number, part in enumerate(parts(batches)):
            sets, upto = _shingles(part, size)
            grams = counted(sets)
            seen = totals.of_part(number, grams)[1]
            count = seen[np.searchsorted(grams[1][0], _short(sets))]
            own = np.concatenate([[0], np.cumsum(count == 1)])[upto]
            nodes, prefix, shared = [], [[] for _ in range(ORDERS)], []
            for row, (begin, end) in enumerate(zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)):
                n, shingles = end - begin, sets[begin:end]
                nodes.append(hashlib.blake2b(shingles.data, digest_size=16).digest() if n else None)
                room = n - -(-percent * n // 100) + 1 - int(own[row + 1] - own[row])
                if n == 0 or room <= 0 or own[row + 1] - own[row] == n:
                    for column in (*prefix, shared):
                        column.append(None)
                    continue
                several = count[begin:end] > 1
                shingles, many = shingles[several], count[begin:end][several]
                for column, rank in zip(prefix, _ranks(shingles, many), strict=True):
                    column.append(_token(shingles[rank[:room]]))
                shared.append(_pack(shingles))
            columns = [part["key"].combine_chunks(), pa.array(np.arange(done, done + len(nodes))), pa.array(nodes, pa.binary()), pa.array(np.diff(upto)), *(pa.array(p, pa.list_(pa.int32())) for p in prefix), pa.array(shared, pa.binary())]
            done += len(nodes)
            yield pa.RecordBatch.from_arrays(columns, names=[name for name, _ in fields])

    lists = ", ".join(f"prefix_{k + 1} array<int>" for k in range(ORDERS))
    found = rows.mapInArrow(prefixes, f"key {kind}, row long, node binary, n_shingles long, {lists}, shared binary")
    return materialise(found, "sets")[0]


def _sent(table: DataFrame, rows: int) -> DataFrame:
    """Broadcast a stored table of ids that has few rows; a longer one is joined by a shuffle."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def _families(postings: DataFrame) -> DataFrame:
    """(node, family): components of nodes that share a token, by each token's least node; postings: (node, token)."""
    heads = postings.groupBy("token").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1").select("token", "head")
    edges = postings.join(heads, "token").where("node != head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    return components(edges.distinct()).withColumnRenamed("component", "family")


def _links(nodes: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """(a, b, whole): links that connect what similar nodes of different parts of a family (placed: node, family, part)
    connect; `whole` if the family is one block and a its component's least node."""
    none = F.lit(bytearray(b""))
    sizes = placed.groupBy("family", "part").agg(F.count("*").alias("n"))
    # a part that fills blocks has its own, others share them
    owned = placed.join(sizes, ["family", "part"]).withColumn("owner", F.when(F.col("n") > BLOCK_NODES, F.col("part")).otherwise(none)).drop("n")
    owned, _ = materialise(owned, "owned")
    blocks, _ = materialise(owned.groupBy("family", "owner").agg(F.ceil(F.count("*") / BLOCK_NODES).cast("int").alias("blocks"), F.count("*").alias("rows")), "blocks")
    dealt = F.pmod(F.xxhash64(F.when(F.col("owner") == none, F.col("part")).otherwise(F.col("node"))), F.col("blocks")).cast("int")
    own_block, _ = materialise(owned.join(blocks.drop("rows"), ["family", "owner"]).select("node", "family", "owner", dealt.alias("number")), "dealt")
    numbered = blocks.select("family", "owner", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("number")).drop("blocks")
    one = blocks.groupBy("family").agg((F.sum("blocks") == 1).alias("whole"))
    a, b = numbered.alias("a"), numbered.alias("b")
    ordered = F.struct("a.owner", "a.number") <= F.struct("b.owner", "b.number")
    apart = (F.col("a.owner") != F.col("b.owner")) | (F.col("a.owner") == none)
    pairs = a.join(b, "family").where(ordered & apart).select("family", F.struct("a.owner", "a.number").alias("x"), F.struct("b.owner", "b.number").alias("y")).join(one, "family")
    pairs, _ = materialise(pairs.withColumn("pair", F.xxhash64("family", "x", "y")), "pairs")
    sides = pairs.select("family", "x.*", "pair", "whole", F.lit(False).alias("second")).union(pairs.where("x != y").select("family", "y.*", "pair", "whole", F.lit(True).alias("second")))
    copies, _ = materialise(own_block.join(sides, ["family", "owner", "number"]).select("node", "family", "pair", "whole", "second"), "copies")
    rows = copies.count()
    tasks = max(1, -(-rows // TASK_ROWS))
    sent = _sent(copies, rows).join(nodes, "node").withColumn("g", F.pmod(F.xxhash64("family", "pair"), F.lit(tasks)).cast("int"))

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("family", "ascending"), ("pair", "ascending"), ("second", "ascending"), ("node", "ascending")])
        names = list(zip(table["family"].to_pylist(), table["pair"].to_pylist(), strict=True))
        edges = [k for k in range(len(names)) if k == 0 or names[k] != names[k - 1]] + [len(names)]
        a, b, whole = [], [], []
        for begin, end in zip(edges[:-1], edges[1:], strict=True):
            own = table.slice(begin, end - begin)
            for x, y in _block_links(own, percent):
                a.append(own["node"][x].as_py())
                b.append(own["node"][y].as_py())
                whole.append(own["whole"][0].as_py())
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "whole": pa.array(whole, pa.bool_())})

    return materialise(sent.groupBy("g").applyInArrow(compare, "a binary, b binary, whole boolean"), "links")[0]


def _both(pairs: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """pairs (a, b) with these columns of both nodes, as a_... and b_..."""
    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in columns)), side)
    return pairs


def _similar(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar, stored."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for n, m, x, y in zip(*(batch[c].to_pylist() for c in ("a_n_shingles", "b_n_shingles", "a_shared", "b_shared")), strict=True):
                common = len(np.intersect1d(_unpack(x), _unpack(y), assume_unique=True))
                held.append(100 * common >= percent * (n + m - common))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(held, pa.bool_()))

    return materialise(_both(pairs, nodes, ["n_shingles", "shared"]).mapInArrow(compare, "a binary, b binary"), "links")[0]


def _head_links(nodes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of nodes of large families with heads, and (node, family, part) of what may have further links."""
    spark = nodes.sparkSession
    # the share of a node's shingles that no other document has: a good head has few
    own = 1 - F.octet_length("shared") / (_STORED * F.col("n_shingles"))
    lists, _ = materialise(nodes.select("node", F.col("node").alias("part"), own.alias("own"), F.explode("prefix_1").alias("token")), "postings")
    links: DataFrame | None = None
    for turn in range(ROUNDS):
        choice = F.struct(F.col("own") if turn == 0 else F.lit(0.0), F.xxhash64("node", F.lit(turn)), "node", "part")
        heads = lists.groupBy("token").agg(F.min(choice).alias("head"), F.count("*").alias("n")).where("n > 1")
        heads, _ = materialise(heads.select("token", F.col("head.node").alias("head"), F.col("head.part").alias("head_part")), "heads")
        met = lists.join(heads, "token").where("part != head_part").groupBy("node", "head").agg(F.count("*").alias("n"))
        tried = met.groupBy("node").agg(F.max(F.struct("n", "head")).alias("best")).select(F.col("best.head").alias("a"), F.col("node").alias("b"))
        found = _similar(materialise(tried, "tried")[0], nodes, percent)
        links = found if links is None else links.union(found)
        parts = components(links).withColumnRenamed("component", "part")
        marked, _ = materialise(lists.drop("part").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node")), "postings")
        # tokens of one component alone are done with
        mixed = marked.groupBy("token").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x != y").select("token")
        lists, _ = materialise(marked.join(materialise(mixed, "mixed")[0], "token", "left_semi"), "postings")
        release(spark)
    assert links is not None
    left = _families(lists).join(lists.select("node", "part").distinct(), "node")
    return links, materialise(left, "families")[0]


def similar_components(docs: DataFrame, percent: int = 80, size: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Connected components of documents whose shingle sets have a Jaccard similarity of at least percent / 100.

    Returns key, n_shingles and component_id, the least key in the document's component (its own if it is alone).
    docs must be a scan of files, or be as stable as one.
    """
    spark = docs.sparkSession
    documents = document_sets(docs, percent, size, key, text)
    kept = ["node", "n_shingles", *(f"prefix_{k + 1}" for k in range(ORDERS)), "shared"]
    candidates = documents.where("shared is not null")
    # one row for each node is chosen before any set is moved
    chosen, _ = materialise(candidates.groupBy("node").agg(F.min("row").alias("row")).select("row"), "chosen")
    nodes, _ = materialise(candidates.join(_sent(chosen, chosen.count()), "row", "left_semi").select(*kept), "nodes")
    release(spark)

    families = _families(nodes.select("node", F.explode("prefix_1").alias("token")))
    sizes = families.groupBy("family").agg(F.count("*").alias("n"))
    families, _ = materialise(families.join(sizes, "family"), "families")
    large = families.where(F.col("n") > LARGE_NODES).select("node")
    small = families.where(F.col("n") <= LARGE_NODES).select("node", "family", F.col("node").alias("part"))
    links = _links(nodes, small, percent)
    if not large.isEmpty():
        by_heads, left = _head_links(materialise(nodes.join(large, "node", "left_semi"), "large")[0], percent)
        links = links.union(by_heads.withColumn("whole", F.lit(False))).union(_links(nodes, left, percent).withColumn("whole", F.lit(False)))
    labels = links.where("whole").select(F.col("b").alias("node"), F.col("a").alias("part"))
    split = links.where("not whole")
    if not split.isEmpty():  # families of several blocks
        labels = labels.union(components(split).select("node", "component"))
    release(spark)

    placed = documents.select("key", "node", "n_shingles").join(materialise(labels, "labels")[0], "node", "left").withColumn("part", F.coalesce("part", "node"))
    least = placed.where("node is not null").groupBy("part").agg(F.min("key").alias("least"), F.count("*").alias("n")).where("n > 1")
    # stored, so that both sides of the join are plain shuffles and a part with many documents can be split
    least, _ = materialise(least, "least")
    result = placed.join(least.select("part", "least"), "part", "left")
    return result.select(F.col("key").alias(key), "n_shingles", F.coalesce("least", "key").alias("component_id"))
