"""Quality rules with risk-controlled thresholds.

A document is measured by shares (RULES), each in whole per cent, rounded up; larger is worse. It fails a base rule if it has few words
or repeats itself; beyond that, per stratum, a row of cutoffs decides: it is rejected if any share lies above its cutoff.

The cutoffs are chosen with labelled documents so that few good ones are rejected, with a guarantee:
- Labelled good documents that pass the base rules are dealt to a tuning half and a holdout half by their id.
- The tuning half gives a ladder of cutoffs for each stratum: beyond all its shares by MARGINS, then the least cutoffs
  that leave at most a share of TAILS of it above. Each step rejects all that the step before does.
- The holdout half tests the steps in their order. A step is certified if the exact binomial probability of so few false
  rejections, were their rate `risk`, is at most error / (number of strata): Bonferroni over strata, a fixed sequence
  within one, so testing ends at the first step that fails. The last certified step is used.
So with probability 1 - error, in every stratum at once, at most `risk` of good documents like the labelled ones are
rejected beyond the base rules. A stratum without labels enough has no certified step and rejects nothing more.

All labelled rows are used; what is counted is (stratum, rule, per cent), whose number does not grow with the rows.

Words are `[^\\x20\\x09-\\x0D]+`. Nulls: a null text is empty and fails the base rules; a null stratum is a stratum; labels
without an id or quality are ignored, and documents with a null id have none. Of several labels for one id, any bad one
counts. Rows with equal ids are each judged by their own text. Empty tables give no rows. All columns of the documents
are carried in the struct `row`, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.shared import materialise, small_batches

SPACES, SYMBOLS, MARKS = " \t\n\v\f\r", "#*$%&|<>", "!?=_~^"
UPPER = bytes(range(65, 91))
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_echo"]
#: Shares: what is counted, and of what.
RULES = {"repeats": ("n_repeat_words", "n_words"), "symbols": ("n_symbols", "word_chars"), "marks": ("n_marks", "word_chars"), "upper": ("n_upper", "word_chars"), "lines": ("n_dup_lines", "n_lines"), "echo": ("n_echo", "n_words")}
#: Steps of the ladder: hundredths added to the largest share of the tuning half, then shares of it left above, in millionths.
MARGINS, TAILS = (300, 200, 100, 50, 25, 0), (500, 1000)
WINDOW = 8


def covered(ids: np.ndarray, size: int) -> int:
    """Places within a window of `size` consecutive ids that occurs more than once. Windows are named exactly, by pairs
    of the names of windows half as long (size is a power of two)."""
    width, names = 1, ids
    while width < size:
        if len(names) <= width:
            return 0
        pair = names[:-width].astype(np.int64) * (int(names.max()) + 1) + names[width:]
        names = np.unique(pair, return_inverse=True)[1]
        width *= 2
    starts = np.flatnonzero(np.bincount(names)[names] > 1)
    edges = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + size, -1)
    return int((np.cumsum(edges) > 0).sum())


def counts_of(text: str) -> tuple[int, ...]:
    """COUNTS of one text. n_echo: words equal to the word before; n_lines: lines with a word; n_upper: A-Z."""
    raw = text.encode()
    words = raw.split()  # on bytes, exactly the six spaces
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    chars = len(text) - sum(text.count(c) for c in SPACES)
    echo = int((ids[1:] == ids[:-1]).sum())
    return len(words), chars, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), covered(ids, WINDOW), len(lines), len(raw) - len(raw.translate(None, UPPER)), sum(text.count(c) for c in MARKS), echo


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, *COUNTS) of all documents."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts_of(t.as_py() or "") for t in batch.column("text")]
            columns = [pa.array([f[i] for f in found], pa.int64()) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *columns], ["row", *COUNTS])

    small_batches(docs.sparkSession)
    carried = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text)).alias("row")
    given = docs.select(carried, F.col(f"`{text}`").alias("text"))
    kind = given.schema["row"].dataType.simpleString()
    return given.mapInArrow(measured, f"row {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def _ceiled(part: Column, whole: Column) -> Column:
    return F.coalesce(F.when(whole > 0, F.least(F.lit(100), F.floor((100 * part + whole - 1) / whole))), F.lit(0)).cast("int")


def shares() -> Column:
    """The shares of RULES, in whole per cent rounded up, at most 100."""
    return F.array(*(_ceiled(F.col(a), F.col(b)) for a, b in RULES.values()))


def base_failed(least_words: int, repeat_percent: int) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def ladder(histogram: np.ndarray) -> list[int]:
    """Cutoffs of one rule, from its tuning documents by per cent (101 counts): never rising."""
    top, total = int(np.flatnonzero(histogram).max()), int(histogram.sum())
    above = total - np.cumsum(histogram)
    out = [min(100, top + -(-top * m // 100)) for m in MARGINS]
    return out + [int(np.flatnonzero(above * 1_000_000 <= t * total)[0]) for t in TAILS]


def chance_of_so_few(k: int, n: int, rate: float) -> float:
    """P(X <= k) for X binomial of n and rate."""
    i = np.arange(min(k, n) + 1)
    logs = np.array([math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) for j in i.tolist()])
    return float(min(1.0, np.exp(logs + i * math.log(rate) + (n - i) * math.log1p(-rate)).sum()))


def certified(rejected: list[int], n: int, risk: float, error: float) -> int:
    """The last step, from -1 for none, before the first whose count of false rejections among n is not small enough."""
    for step, k in enumerate(rejected):
        if chance_of_so_few(k, n, risk) > error:
            return step - 1
    return len(rejected) - 1


def fit_cutoffs(measured: DataFrame, labels: DataFrame, key: str, stratum: str, risk: float, error: float, tune: Column, failed: Column) -> DataFrame:
    """(stratum, cutoffs, step, n_holdout, false_rejections, bound_met) per stratum; cutoffs is null where no step holds."""
    good = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("label_id")).agg(F.min("quality").alias("q")).where("q = 1")
    rows = measured.where(~failed).select(F.col(f"row.{key}").alias("label_id"), F.col(f"row.{stratum}").alias("stratum"), shares().alias("share"))
    known, _ = materialise(rows.join(good, "label_id").select("stratum", "share", tune.alias("tune")), "labelled")
    strata = measured.select(F.col(f"row.{stratum}").alias("stratum")).distinct().count()

    def stepped(frame: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((len(RULES), 101), np.int64)
        np.add.at(counts, (frame["rule"], frame["share"]), frame["n"])
        steps = np.array([ladder(c) for c in counts]).T
        return pd.DataFrame({"stratum": [frame["stratum"].iloc[0]], "steps": [steps.tolist()]})

    kind = known.schema["stratum"].dataType.simpleString()
    exploded = known.where("tune").select("stratum", F.posexplode("share").alias("rule", "share"))
    counted = exploded.groupBy("stratum", "rule", "share").agg(F.count("*").alias("n"))
    ladders = counted.groupBy("stratum").applyInPandas(stepped, f"stratum {kind}, steps array<array<int>>")
    ladders, _ = materialise(ladders, "ladders")

    # a holdout document's step is the first that rejects it; n steps if none does
    held = known.where("not tune").alias("k").join(_sent_rows(ladders).alias("l"), F.col("k.stratum").eqNullSafe(F.col("l.stratum")))
    first = F.size(F.filter("steps", lambda s: F.forall(F.arrays_zip(s.alias("c"), F.col("share").alias("v")), lambda p: p["v"] <= p["c"])))
    by_step = held.select("k.stratum", "steps", first.alias("first")).groupBy("stratum", "first").agg(F.count("*").alias("n"), F.any_value("steps").alias("steps"))

    def tested(frame: pd.DataFrame) -> pd.DataFrame:
        steps = frame["steps"].iloc[0]
        per = np.zeros(len(steps) + 1, np.int64)
        np.add.at(per, frame["first"], frame["n"])
        rejected, n = np.cumsum(per[:-1]).tolist(), int(per.sum())
        step = certified(rejected, n, risk, error / strata)
        cutoffs = [int(c) for c in steps[step]] if step >= 0 else None
        return pd.DataFrame({"stratum": [frame["stratum"].iloc[0]], "cutoffs": [cutoffs], "step": [step], "n_holdout": [n], "false_rejections": [rejected[step] if step >= 0 else 0]})

    return by_step.groupBy("stratum").applyInPandas(tested, f"stratum {kind}, cutoffs array<int>, step int, n_holdout long, false_rejections long")


def _sent_rows(table: DataFrame) -> DataFrame:
    """One row a stratum: broadcast if there are few."""
    return F.broadcast(table) if table.count() <= 10_000 else table


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", risk: float = 0.05, error: float = 0.05, least_words: int = 20, repeat_percent: int = 30) -> DataFrame:
    """(row, *COUNTS, base_failed, cutoffs, kept) of all documents."""
    measured, _ = materialise(measure(docs, text), "measured")
    failed = base_failed(least_words, repeat_percent)
    tune = F.crc32(F.col("label_id").cast("string").cast("binary")) % 2 == 0
    cutoffs, _ = materialise(fit_cutoffs(measured, labels, key, stratum, risk, error, tune, failed), "cutoffs")
    met = measured.alias("m").join(_sent_rows(cutoffs).alias("c"), F.col(f"m.row.{stratum}").eqNullSafe(F.col("c.stratum")), "left")
    above = F.exists(F.arrays_zip(shares().alias("v"), F.col("cutoffs").alias("c")), lambda p: p["v"] > p["c"])
    kept = ~failed & ~F.coalesce(above, F.lit(False))
    return met.select("row", *COUNTS, failed.alias("base_failed"), "cutoffs", kept.alias("kept"))
