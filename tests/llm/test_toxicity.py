import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import toxicity


def plain_risk(w, b, xp, xu, prior):
    loss = lambda x, y: np.logaddexp(0, -y * (x @ w + b)).mean()
    return prior * loss(xp, 1), loss(xu, -1) - prior * loss(xp, -1)


@pytest.mark.parametrize("scale,prior,negative", [(0.3, 0.1, False), (1.0, 0.5, False), (3.0, 0.9, True)])
def test_risk_and_gradient_match_numpy(scale, prior, negative):
    rng = np.random.default_rng(2)
    xp, xu = (rng.random((40, 6)) < 0.5).astype(float), (rng.random((90, 6)) < 0.3).astype(float)
    w, b = scale * rng.normal(size=6), 0.4
    if negative:
        w, b = np.abs(w), -4.0  # P lies high and U low: the rest falls below zero
    first, rest, g, gb = toxicity.risk(w, b, xp, xu, prior)
    assert (first, rest) == pytest.approx(plain_risk(w, b, xp, xu, prior)) and (rest < 0) == negative
    aim = (lambda w, b: -plain_risk(w, b, xp, xu, prior)[1]) if negative else (lambda w, b: sum(plain_risk(w, b, xp, xu, prior)))
    e = 1e-6
    assert gb == pytest.approx((aim(w, b + e) - aim(w, b - e)) / 2 / e, abs=1e-6)
    for i, d in enumerate(np.eye(6) * e):
        assert g[i] == pytest.approx((aim(w + d, b) - aim(w - d, b)) / 2 / e, abs=1e-6)


def test_fit_lowers_the_risk_that_labels_would_give():
    """The corrected risk stands for that of full labels, which the fit never sees."""
    rng = np.random.default_rng(0)
    y = rng.random(6000) < 0.1
    x = np.column_stack([rng.random(6000) < np.where(y, 0.8, 0.05), rng.random(6000) < 0.5]).astype(np.float32)
    p, u = np.flatnonzero(y)[:150], np.arange(1000, 6000)
    rows = np.r_[p, u]
    w, b = toxicity.fit(x[rows], np.r_[np.ones(len(p), bool), np.zeros(len(u), bool)], np.r_[np.zeros(len(p), bool), np.ones(len(u), bool)], 0.1)
    told = x @ w + b >= 0
    assert w[0] > 5 * abs(w[1]) and (told == y).mean() > 0.92
    first, rest, *_ = toxicity.risk(w, b, x[p], x[u], 0.1)
    plain = np.logaddexp(0, -np.where(y, 1, -1) * (x @ w + b)).mean()
    assert first + rest == pytest.approx(plain, abs=0.03)


def test_unlabelled_documents_serve(spark):
    """U holds documents without labels, and none that is held out."""
    docs = spark.range(500).selectExpr("id AS doc_id", "'w' || (id % 50) AS text")
    labels = docs.where("doc_id < 100").selectExpr("doc_id", "int(doc_id % 10 = 0) AS toxic")
    rows, prior = toxicity.sample(docs, labels)
    got = rows.join(docs.select("doc_id", toxicity.held_out().alias("held")), "doc_id").toPandas()
    assert not got.held.any() and set(got[got.in_u].doc_id) == set(docs.where(~toxicity.held_out()).toPandas().doc_id)
    assert set(got[got.positive].doc_id) == {r["doc_id"] for r in labels.where((F.col("toxic") == 1) & ~toxicity.held_out()).collect()} and 0.05 < prior < 0.15
