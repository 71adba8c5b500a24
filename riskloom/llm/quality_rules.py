"""Quality rules: counts of each text, and an isolation forest on them.

Every whole text is counted once. One forest is grown in numpy on all of FOREST, statistics of words and symbols, by
splits that are random in the statistic and in the place, from a bounded seeded sample of labelled rows (``SAMPLE``)
that pass the base rules, of which the method shows each tree a few; a text's score is 2 ** (-mean path length / expected
length). Labels set the threshold only: the score that parts the good and bad rows best, of all labelled rows that pass
the base rules, and rejects at most ``LOSS`` of the good ones. Trees see
LEAF_ROWS rows each: few, so that bad texts, which are alike, do not hide one another. What the base rules judge, length
and repeats, is left to them.
The sample is taken and sorted by id and counts, so the forest does not depend on how
the tables are partitioned. Counting and scoring run on all rows inside tasks.

Defined cases: a null text has no words; without good and bad rows in the sample the
forest rejects no document, and with fewer than two rows nothing can be split and all scores are equal; scores equal to the threshold are kept; rows with an equal
id are counted each; long texts are counted whole; columns other than ``doc_id`` and ``text`` are ignored unless
named to ``text_counts``; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, small_slices, stored, table

SAMPLE = 8192  # labelled rows at most that the forest is grown from: its trees see TREES x LEAF_ROWS rows in all
TREES, LEAF_ROWS, SEED = 200, 32, 9
FOREST = ("long_words", "symbol_share", "symbols_a_word", "distinct_share")
LOSS = 0.002  # share of good sample rows that the threshold may reject
CELLS = 1024  # of scores, in which running sums are taken
WINDOW = 5
SYMBOLS = re.compile(r"[#*$%&|<>]")
GAPS = re.compile(r"[\x20\x09-\x0D]")
UPPER, DIGITS = (bytes(range(*x)) for x in ((65, 91), (48, 58)))
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(0xC2, 0xF5))  # a byte for each letter, and for each character beyond ASCII

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHAPES = ("long_words", "symbol_share", "dup_line_share", "repeat_share", "capital_share", "distinct_share", "digit_share", "stop_share")
SCHEMA = ", ".join([*(f"{c} long" for c in COUNTS), *(f"{c} double" for c in SHAPES)])
ARROW = pa.schema([*((c, pa.int64()) for c in COUNTS), *((c, pa.float64()) for c in SHAPES)])


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    key = w[:n].copy()
    for j in range(1, window):  # exact: windows are numbered step by step
        pair = key * len(ids) + w[j : j + n]
        key = np.unique(pair, return_inverse=True)[1].reshape(-1)
    again = np.bincount(key)[key] > 1
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, np.flatnonzero(again), 1)
    np.add.at(step, np.flatnonzero(again) + window, -1)
    return int((np.cumsum(step)[:-1] > 0).sum())


def counts(text: str | None) -> tuple:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text) - len(GAPS.findall(text))
    symbols = len(SYMBOLS.findall(text))
    lines = [x for x in text.split("\n") if GAPS.sub("", x)]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    n, c = max(1, len(words)), max(1, chars)
    of = lambda kind: len(raw) - len(raw.translate(None, kind))
    common = sum(v for _, v in Counter(words).most_common(10))
    return (len(words), chars, symbols, dup, repeat, chars / n, symbols / c, dup / max(1, len(lines)), repeat / n, of(UPPER) / max(1, of(LETTERS)), len(set(words)) / n, of(DIGITS) / c, common / n)


def _count(keep: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches):
            rows = [counts(t) for t in batch.column("text").to_pylist()]
            if rows:
                columns = [pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], names=[*keep, *ARROW.names])

    return run


def text_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """``doc_id``, the columns named, and the counts of each row's text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, "text")
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "text")
    return rows.mapInArrow(_count(["doc_id", *keep]), f"{schema}, {SCHEMA}")


def expected_path(n: np.ndarray | float) -> np.ndarray:
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Random axis splits, each of the columns that still varies as likely; a node is (feature, cut, left, right) or a leaf's path length."""

    def __init__(self, x: np.ndarray, trees: int = TREES, rows: int = LEAF_ROWS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.rows = min(rows, len(x))
        if not len(x):  # nothing to split: one leaf
            x, self.rows = np.zeros((1, x.shape[1])), 1
        self.depth = max(1, int(np.ceil(np.log2(max(2, self.rows)))))
        self.trees = [self._grow(x[rng.choice(len(x), self.rows, replace=False)], rng) for _ in range(trees)]

    def _grow(self, x: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        feature, cut, left, right, length = [], [], [], [], []
        todo = [(x, 0, -1, 0)]
        while todo:
            rows, depth, parent, side = todo.pop()
            at = len(feature)
            if parent >= 0:
                (left, right)[side][parent] = at
            low, high = rows.min(0), rows.max(0)
            open_ = np.flatnonzero(high > low)
            if depth >= self.depth or len(rows) <= 1 or not len(open_):
                feature.append(-1), cut.append(0.0), length.append(depth + float(expected_path(len(rows))))
            else:
                f = rng.choice(open_)
                c = rng.uniform(low[f], high[f])
                feature.append(int(f)), cut.append(c), length.append(0.0)
                go = rows[:, f] < c
                todo += [(rows[go], depth + 1, at, 0), (rows[~go], depth + 1, at, 1)]
            left.append(0), right.append(0)
        return tuple(map(np.array, (feature, cut, left, right, length)))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, left, right, length in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                at = np.where(f < 0, at, np.where(x[rows, f] < cut[at], left[at], right[at]))
            total += length[at]
        return 2.0 ** (-total / len(self.trees) / max(1e-9, float(expected_path(self.rows))))


def labelled_sample(rows: DataFrame, labels: DataFrame, label: str, most: int = SAMPLE) -> DataFrame:
    """At most ``most`` rows that have the label, in a seeded order of their ids, then of their counts."""
    order = F.md5(F.concat(F.lit("sample"), F.col("doc_id").cast("string")))
    picked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias(label))
    picked = picked.orderBy(order, "doc_id").limit(most)
    rows = rows.select("doc_id", *COUNTS, *SHAPES).join(F.broadcast(picked), "doc_id")  # at most ``most`` ids
    return rows.orderBy(order, "doc_id", *COUNTS, *SHAPES).limit(most)


def threshold(score: np.ndarray, good: np.ndarray, lose: int) -> float:
    """The cut that gains most bad rows and loses fewest good ones, losing ``lose`` of these at most; 2 rejects none."""
    order = np.argsort(-score, kind="stable")
    bad, lost = np.cumsum(~good[order]), np.cumsum(good[order])
    gain = bad / max(1, (~good).sum()) - lost / max(1, good.sum())
    edge = np.r_[score[order][:-1] > score[order][1:], True]
    gain[~edge | (lost > lose)] = -1
    if not len(gain) or gain.max() <= 0 or good.all() or not good.any():
        return 2.0
    at = int(np.argmax(gain))
    return float(score[order][at] + score[order][at + 1]) / 2 if at + 1 < len(order) else -1.0


def labelled_threshold(scored: DataFrame, labels: DataFrame, label: str, loss: float) -> float:
    """The same cut over all labelled rows: running sums by score, which the driver never sees but for the best."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("_label"))
    good = F.col("_label") == 1
    rows = scored.where(~F.col("base_failed")).join(known, "doc_id")
    per = stored(rows.groupBy("score").agg(F.count_if(~good).alias("bad"), F.count_if(good).alias("good")), "op9-scores")
    n_bad, n_good = per.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    if not n_bad or not n_good:
        return 2.0
    cell = F.floor(F.col("score") * CELLS)
    cells = per.groupBy(cell.alias("cell")).agg(F.sum("bad").alias("_bad"), F.sum("good").alias("_good"))
    over = W.orderBy(F.desc("cell"))  # CELLS rows at most
    above = cells.select("cell", (F.sum("_bad").over(over) - F.col("_bad")).alias("_bad"), (F.sum("_good").over(over) - F.col("_good")).alias("_good"))
    inside = W.partitionBy("cell").orderBy(F.desc("score"))
    run = per.withColumn("cell", cell).join(F.broadcast(above), "cell").select("score", (F.col("_bad") + F.sum("bad").over(inside)).alias("bad"), (F.col("_good") + F.sum("good").over(inside)).alias("lost"))
    gain = F.col("bad") / n_bad - F.col("lost") / n_good
    best = run.where(F.col("lost") <= math.ceil(loss * n_good)).select("score", gain.alias("gain")).orderBy(F.desc("gain"), F.desc("score")).first()
    if best is None or best["gain"] <= 0:
        return 2.0
    below = per.where(F.col("score") < best["score"]).agg(F.max("score")).first()[0]
    return -1.0 if below is None else (best["score"] + below) / 2


def statistics(counted: pd.DataFrame | pa.RecordBatch) -> np.ndarray:
    """The columns of FOREST."""
    of = lambda c: np.asarray(counted[c], float)
    return np.column_stack([of("n_symbols") / np.maximum(of("n_words"), 1) if c == "symbols_a_word" else of(c) for c in FOREST])


def judge(counted: DataFrame, labels: DataFrame, loss: float = LOSS) -> DataFrame:
    """Add ``score`` and ``kept``: the base rules, then the forest's verdict."""
    sample = labelled_sample(counted, labels, "quality").toPandas()
    base = (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))
    open_ = sample[~((sample["n_words"] < 10) | (100 * sample["n_repeat_words"] > 20 * sample["n_words"]))]
    forest = IsolationForest(statistics(open_).reshape(-1, len(FOREST)))
    counted = counted.select("doc_id", *COUNTS, *SHAPES)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.score(statistics(batch)))], names=[*batch.schema.names, "score"])

    out = stored(counted.mapInArrow(run, f"doc_id long, {SCHEMA}, score double").withColumn("base_failed", base), "op9-scored")
    limit = labelled_threshold(out, labels, "quality", loss)
    return out.withColumn("rejected", F.col("score") > limit).withColumn("kept", ~F.col("base_failed") & ~F.col("rejected"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = stored(text_counts(documents(spark, sf_dir)), "op9-counts")
    judged = judge(counted, table("labels")(spark, sf_dir))
    return judged.select("doc_id", *COUNTS, "base_failed", "kept", "score")
