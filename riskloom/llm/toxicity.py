"""Toxicity by non-negative positive-unlabelled learning.

A logistic model of the presence of hashed words and word beginnings is trained in numpy from confirmed toxic rows (P)
and unlabelled ones (U), any documents not held out, whose labels, if they have some, are not looked at: with the class
prior p, the share of toxic rows among the labels that may be read, the risk is
p E_P[loss(+)] + max(0, E_U[loss(-)] - p E_P[loss(-)]), and where the second part falls below
zero its gradient is turned round. Fitting reads at most ``MOST_P`` and ``MOST_U``
documents in a seeded order, never those held out; the cut is set on the same rows. Words are counted and
chosen on the executors; the driver gets the chosen words of the fitting rows only, in the order of their ids, so
a model does not depend on how the tables are partitioned. All rows are scored inside tasks, from their whole texts only.

Defined cases: a null or empty text scores as one without words; without any positive row, or
with positive rows only, every score is 0, and few positive rows may leave a model that
finds none; an id with several texts gives the one with the least hash to the fit; rows with
an equal id are scored each; equal texts score alike; a long text counts as the set of all its words;
other columns pass through ``score``, one that has the name of the score is replaced; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, small_slices, table

MOST_P, MOST_U = 3000, 6000
CELLS = 1 << 20
BEGINNINGS = (4, 5, 6)  # bytes
FEATURES = 1024
LEAST_Z = 5.0  # standard errors by which a word's share in P must part from that in U
WEAKER_Z = (3.0, 2.0)  # where no word reaches it
STEPS, RATE, LASSO, SEED = 1000, 0.03, 1.5e-3, 6
WORDS = re.compile(rb"[a-z0-9\x80-\xff]+")
Model = tuple[np.ndarray, np.ndarray, float]  # cells, weights, bias
NO_MODEL: Model = (np.empty(0, np.int64), np.empty(0), -50.0)


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def words(text: str | None) -> set[bytes]:
    return set(WORDS.findall(text.encode("utf-8", "surrogatepass").lower())) if text else set()


class Cells(dict):
    """Cells of a word and of its beginnings, kept while they are few; only those in ``only``, if given."""

    def __init__(self, only=None):
        super().__init__()
        self.only = only

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > 150_000:
            self.clear()
        parts = [word, *(b"^" + word[:n] for n in BEGINNINGS if len(word) >= n)]
        cells = (zlib.crc32(x) % CELLS for x in parts)
        value = self[word] = tuple(c for c in cells if self.only is None or c in self.only)
        return value

    def of(self, text: str | None) -> list[int]:
        return sorted({c for w in words(text) for c in self[w]})


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows of P, of U and of both together hold each cell."""
    known, found = Cells(), np.zeros((3, CELLS), np.int32)
    for batch in small_slices(batches):
        for text, positive, in_u in zip(*(batch.column(c).to_pylist() for c in ("text", "positive", "in_u")), strict=True):
            cells = known.of(text)
            found[0, cells] += positive
            found[1, cells] += in_u
            found[2, cells] += 1
    cells = np.flatnonzero(found[2])
    yield pa.RecordBatch.from_arrays([pa.array(cells), *(pa.array(x[cells].astype(np.int64)) for x in found)], names=["cell", "p", "u", "n"])


def _chosen(chosen: list[int]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Cells(frozenset(chosen))
        for batch in small_slices(batches):
            cells = [known.of(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "positive", "in_u")), pa.array(cells, pa.list_(pa.int32()))], names=["doc_id", "positive", "in_u", "cells"])

    return run


def sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """``doc_id, positive, in_u, text`` of the fitting rows, and the share of positive rows among all that may be read."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg((F.max("toxic") > 0).alias("positive"))
    counts = {r["positive"]: r["c"] for r in known.groupBy("positive").agg(F.count("*").alias("c")).collect()}
    prior = counts.get(True, 0) / max(1, sum(counts.values()))
    order = F.md5(F.concat(F.lit("pu"), F.col("doc_id").cast("string")))
    p = known.where("positive").orderBy(order, "doc_id").limit(MOST_P).withColumn("in_u", F.lit(False))
    every = docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id").distinct()
    u = every.orderBy(order, "doc_id").limit(MOST_U).select("doc_id", F.lit(False).alias("positive"), F.lit(True).alias("in_u"))
    picked = p.unionByName(u).groupBy("doc_id").agg(F.max("positive").alias("positive"), F.max("in_u").alias("in_u"))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # MOST_P + MOST_U ids at most
    one = rows.groupBy("doc_id", "positive", "in_u").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    return one.select("doc_id", "positive", "in_u", "t.text"), prior


def choose(rows: DataFrame, n: int, n_p: int, n_u: int) -> list[int]:
    """Cells whose share in P parts most from that in U."""
    p, u = F.col("p") / n_p, F.col("u") / n_u
    gain = F.abs(p - u) / F.sqrt((u * (1 - u) + 1e-3) / n_p)
    # few positive rows cannot hold a word as often as many rows would ask for
    least = max(min(3, n_p), min(n // 500, n_p // 5))
    sums = rows.mapInArrow(_counts, "cell long, p long, u long, n long").groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("p", "u", "n")))
    best = sums.where(F.col("n") >= least).select("cell", gain.alias("gain")).where(F.col("gain") > min(WEAKER_Z)).orderBy(F.desc("gain"), "cell").limit(FEATURES).collect()
    # a weaker word is better than none
    return next((found for z in (LEAST_Z, *WEAKER_Z) if (found := sorted(r["cell"] for r in best if r["gain"] > z))), [])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The model with the lowest non-negative risk."""
    scratch = Scratch(docs.sparkSession, "op6")
    rows, prior = sample(docs, labels)
    rows = scratch.put("sample", rows)
    n, n_p, n_u = rows.agg(F.count("*"), F.count_if("positive"), F.count_if("in_u")).first()
    if not n_p or n_p == n or not n_u:
        return NO_MODEL
    chosen = choose(rows, n, n_p, n_u)
    got = sorted(rows.select("doc_id", "positive", "in_u", "text").mapInArrow(_chosen(chosen), "doc_id long, positive boolean, in_u boolean, cells array<int>").collect())
    scratch.drop("sample")
    x = np.zeros((n, len(chosen)), np.float32)
    for i, r in enumerate(got):
        x[i, np.searchsorted(chosen, r["cells"])] = 1
    weights, bias = fit(x, np.array([r["positive"] for r in got]), np.array([r["in_u"] for r in got]), prior)
    return np.array(chosen, np.int64), weights, bias


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(w: np.ndarray, b: float, xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, float]:
    """(risk of P as positive, rest, gradient by weights, by bias); rest: U as negative less the part of P in it.

    The gradient is that of the sum of both parts, or, where the rest is below zero, of the rest turned round.
    """
    sp, su = sigmoid(xp @ w + b), sigmoid(xu @ w + b)
    first = -prior * np.log(np.maximum(sp, 1e-7)).mean()
    rest = -np.log1p(-np.minimum(su, 1 - 1e-7)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-7)).mean()
    gu = xu.T @ su / len(su) - prior * (xp.T @ sp) / len(sp), su.mean() - prior * sp.mean()
    if rest < 0:
        return float(first), float(rest), -gu[0], -gu[1]
    return float(first), float(rest), gu[0] - prior * (xp.T @ (1 - sp)) / len(sp), gu[1] - prior * (1 - sp).mean()


def fit(x: np.ndarray, positive: np.ndarray, in_u: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """(weights, bias) for rows of chosen cells."""
    rng = np.random.default_rng(SEED)
    w, b = np.zeros(x.shape[1], np.float32), np.float32(np.log(max(prior, 1e-4) / max(1 - prior, 1e-4)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    all_p, all_u = np.flatnonzero(positive), np.flatnonzero(in_u)
    for step in range(1, STEPS + 1):
        xp, xu = x[rng.choice(all_p, 256)], x[rng.choice(all_u, 512)]
        _, _, g, gb = risk(w, b, xp, xu, prior)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix, fix2 = 1 - 0.9**step, 1 - 0.999**step
        scale = RATE / (np.sqrt(v / fix2) + 1e-3)
        w = w - scale * (m / fix)
        w = np.sign(w) * np.maximum(0, np.abs(w) - scale * LASSO)  # words of a few copied texts do not pay for themselves
        b = b - RATE * (mb / fix) / (np.sqrt(vb / fix2) + 1e-8)
    # the cut at 0.5: midway of the gap that parts the fitting rows best, with P weighing the prior and U one
    z = x @ w + b
    order = np.argsort(-z, kind="stable")
    hit = np.cumsum(positive[order]) * (prior / positive.sum())
    f1 = 2 * hit / (np.cumsum(in_u[order]) / in_u.sum() + prior)
    f1[:-1][z[order][:-1] == z[order][1:]] = 0
    best = int(np.argmax(f1))
    after = z[order][best + 1] if best + 1 < len(z) else z[order][best] - 1
    return w.astype(float), float(b - (z[order][best] + after) / 2)


def score(docs: DataFrame, model: Model, name: str = "toxic_score") -> DataFrame:
    """Append the score to the columns of docs."""
    chosen, weights, bias = model
    weight = dict(zip(chosen.tolist(), weights.tolist(), strict=True))
    docs = docs.drop(name)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Cells(weight)
        for batch in small_slices(batches):
            z = [bias + sum(weight[c] for c in known.of(t)) for t in batch.column("text").to_pylist()]
            s = 1 / (1 + np.exp(-np.clip(np.array(z, float), -50, 50))) if weight else np.zeros(len(z))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], names=[*batch.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, `{name}` double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = score(docs, train(docs, table("labels")(spark, sf_dir)))
    out = scored.select("doc_id", held_out().alias("held_out"), F.col("toxic_score").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
