"""Quality by hierarchical empirical Bayes: the text's evidence with posteriors of host and path.

A logistic model of text counts, with steps at the sample's quantiles, gives each document a probability. Hosts, and paths inside
them, pool the probabilities of their documents: a host's posterior shrinks to the global
mean with a strength fitted to the spread between hosts, a path's to its host's with one
fitted to the spread between paths. A document's own probability is left out of the
posteriors that it meets. All pooling is grouped aggregation; only a few sums reach the driver.

The model is fitted on at most ``SAMPLE`` labelled rows in a seeded order, sorted by id and counts.

Defined cases: a null text counts as empty; long texts are counted whole; a null host or path is a site of its own; one
document alone at its site gets the parent's posterior; rows with an equal id are judged each, equal rows alike; null ids
are rows as any other; a score equal to ``LIMIT`` is kept; without labelled rows of both kinds
the evidence is 0.5; other columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, join_by_load, stored, table
from .quality_rules import SAMPLE, SHAPES, labelled_sample, text_counts

STEPS, RIDGE = 30, 1e-2
SHARES = (0.02, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.98)
LIMIT = 0.5


def knots(x: np.ndarray) -> list[np.ndarray]:
    """Places of each column's steps: the sample's quantiles."""
    return [np.unique(np.quantile(c, SHARES)) if len(c) else np.zeros(0) for c in np.clip(x, 0, 50).T]


def design(x: np.ndarray, n_words: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
    """Counts, their roots and steps at the places given."""
    size = np.log1p(n_words)[:, None]
    x = np.clip(x, 0, 50)
    return np.column_stack([np.ones(len(x)), size, x, np.sqrt(x), *(x[:, [i]] > cuts for i, cuts in enumerate(places))])


def fit_evidence(x: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    if good.all() or not good.any():
        return w
    scale = np.maximum(np.abs(x).max(0), 1e-9)
    x = x / scale
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (good - p) - RIDGE * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def strength(groups: DataFrame, n: str, total: str, mean: Column | float) -> float:
    """Beta prior size from the spread of group means around their parent's, by moments."""
    p, m = F.col(total) / F.col(n), mean if isinstance(mean, Column) else F.lit(mean)
    r = groups.where(F.col(n) > 1).agg(F.sum(F.col(n) * (p - m) ** 2), F.sum(m * (1 - m)), F.sum(F.col(n) * m * (1 - m)), F.count("*")).first()
    if not r[3] or not r[1]:
        return 10.0
    rho = (r[0] - r[1]) / max(1e-9, r[2] - r[1])  # variance between groups over m (1 - m)
    return float(np.clip(1 / max(rho, 1e-4) - 1, 2.0, 1e4))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """``doc_id, evidence, host_posterior, path_posterior, score, kept``."""
    sites = docs.select("doc_id", host.alias("host"), path.alias("path"), "text")
    counted = stored(text_counts(sites, "host", "path"), "op10-counts")
    sample = labelled_sample(counted, labels, "quality").toPandas()
    shapes = sample[list(SHAPES)].to_numpy(float).reshape(-1, len(SHAPES))
    places = knots(shapes)
    w = fit_evidence(design(shapes, sample["n_words"].to_numpy(float), places), (sample["quality"] == 1).to_numpy(float)) if len(sample) else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = design(np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in SHAPES]), batch.column("n_words").to_numpy(), places)
            z = np.zeros(len(x)) if w is None or not w.any() else np.clip(x @ w, -12, 12)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "host", "path")), pa.array(1 / (1 + np.exp(-z)))], names=["doc_id", "host", "path", "p"])

    kinds = dict(counted.dtypes)
    rows = stored(counted.mapInArrow(run, f"doc_id long, host {kinds['host']}, path {kinds['path']}, p double"), "op10-scored")

    paths = stored(rows.groupBy("host", "path").agg(F.count("*").alias("path_n"), F.sum("p").alias("path_sum")), "op10-paths")
    hosts = paths.groupBy("host").agg(F.sum("path_n").alias("host_n"), F.sum("path_sum").alias("host_sum"))
    everything = hosts.agg(F.sum("host_n"), F.sum("host_sum")).first()
    mean = float(np.clip((everything[1] or 0.5) / (everything[0] or 1), 1e-4, 1 - 1e-4))
    k_host = strength(hosts, "host_n", "host_sum", mean)
    hosts = hosts.withColumnRenamed("host", "h")
    nested = join_by_load(paths, hosts, F.col("host").eqNullSafe(F.col("h")), "host_n", everything[0] or 0).drop("h")
    k_path = strength(nested, "path_n", "path_sum", (F.col("host_sum") + k_host * mean) / (F.col("host_n") + k_host))
    sums = nested.withColumnsRenamed({"host": "h", "path": "q"})
    met = join_by_load(rows, sums, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")), "path_n", everything[0] or 0)
    own = F.col("p")
    at_host = (F.col("host_sum") - own + k_host * mean) / (F.col("host_n") - 1 + k_host)
    at_path = (F.col("path_sum") - own + k_path * F.col("host_posterior")) / (F.col("path_n") - 1 + k_path)
    logit = lambda c: F.log(F.greatest(c, F.lit(1e-6)) / F.greatest(1 - c, F.lit(1e-6)))
    z = logit(own) + logit(F.col("path_posterior")) - F.lit(float(np.log(mean / (1 - mean))))
    out = met.withColumn("host_posterior", at_host).withColumn("path_posterior", at_path).withColumn("score", 1 / (1 + F.exp(-z)))
    return out.select("doc_id", own.alias("evidence"), "host_posterior", "path_posterior", "score", (F.col("score") >= LIMIT).alias("kept"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources stand for hosts, languages within them for paths."""
    docs = documents(spark, sf_dir)
    return classify(docs, table("labels")(spark, sf_dir), F.col("source"), F.col("lang"))
