import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import evaluate, resample


def plain_weights(units, replicates, seed):
    s = [int(hashlib.md5(f"{seed}|{u}".encode()).hexdigest()[:8], 16) % (resample.PRIME - 1) + 1 for u in units]
    return np.array([[sum(a * m % resample.PRIME >= t for t in resample.POISSON) for m in resample.multipliers(replicates)] for a in s], float)


def plain_metrics(y, p, w):
    """(roc_auc, pr_auc, brier, oe) of one replicate, or None."""
    np_, nn = (w * y).sum(), (w * (1 - y)).sum()
    if not np_ or not nn:
        return None
    tp = fp = area = ap = 0
    for t in sorted(set(p), reverse=True):
        a, b = (w * y)[p == t].sum(), (w * (1 - y))[p == t].sum()
        tp, fp = tp + a, fp + b
        area += b * (tp - 0.5 * a)
        ap += a * tp / (tp + fp) if tp + fp else 0
    return area / np_ / nn, ap / np_, (w * (y - p) ** 2).sum() / (np_ + nn), np_ / (w * p).sum()


def test_weights_are_poisson_and_those_of_plain_integers():
    units = [str(i) for i in range(300)]
    plain = plain_weights(units, 400, "s")
    seeds = np.array([int(hashlib.md5(f"s|{u}".encode()).hexdigest()[:8], 16) % (resample.PRIME - 1) + 1 for u in units])
    w = resample.weights(seeds, np.array(resample.multipliers(400), np.uint64))
    assert (w == plain).all()
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.04 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.2


@pytest.mark.parametrize("digits,rows_at_once,hot_levels", [(6, 128, 256), (1, 7, 256), (1, 16, 3)])
def test_replicates_equal_plain_numpy(spark, monkeypatch, digits, rows_at_once, hot_levels):
    """Continuous scores; few scores in small slices; levels summed before the shuffle, ranges that cut a key."""
    monkeypatch.setattr(resample, "ROWS", rows_at_once)
    monkeypatch.setattr(resample, "HOT_LEVELS", hot_levels)
    rng = np.random.default_rng(digits)
    n = 300
    key, unit, y = rng.integers(0, 3, n) % 2, rng.integers(0, 90, n), rng.integers(0, 2, n)
    p = np.round(rng.random(n), digits)
    df = spark.createDataFrame([(f"k{k}", str(u), int(b), float(a)) for k, u, b, a in zip(key, unit, y, p)] + [("k0", "1", None, 0.5), ("k0", "1", 1, None), (None, "7", 1, 0.25), (None, "8", 0, 0.25)], "k string, u string, y int, p double").repartition(3)
    got = {(r["k"], r["rep"]): r for r in resample.replicate_metrics(df, "u", 40, "t", ["k"]).collect()}
    w = plain_weights(unit, 40, "t")
    for k in (0, 1):
        m = key == k
        for rep in range(40):
            want = plain_metrics(y[m], p[m], w[m, rep])
            assert [got[f"k{k}", rep][c] for c in ("roc_auc", "pr_auc", "brier", "oe")] == pytest.approx(want, abs=2e-6)
    assert all(r["roc_auc"] == 0.5 for (k, _), r in got.items() if k is None) and 0 < sum(k is None for k, _ in got) < 40


def test_rows_do_not_grow_with_replicates(spark):
    """Neither shuffle of rows carries replicates: the plan deals seeds."""
    df = spark.range(2000).select(F.col("id").cast("string").alias("u"), (F.col("id") % 2).cast("int").alias("y"), (F.col("id") / 2000).alias("p"))
    plan = resample.replicate_metrics(df, "u", 500, "t")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan
    assert resample.replicate_metrics(df.limit(0), "u", 5, "t").count() == 0


def test_mean_difference_of_all_replicates(spark):
    rng = np.random.default_rng(4)
    unit, y, v = rng.integers(0, 50, 200), rng.integers(0, 2, 200), rng.normal(size=200)
    df = spark.createDataFrame([(str(u), int(b), float(a)) for u, b, a in zip(unit, y, v)] + [("1", 1, None)], "u string, y int, v double")
    row = evaluate.mean_difference(df, "u", "v", 200, "m").first()
    w = plain_weights(unit, 200, "m")
    d = [(w[y == 1, r] @ v[y == 1]) / w[y == 1, r].sum() - (w[y == 0, r] @ v[y == 0]) / w[y == 0, r].sum() for r in range(200)]
    assert row["diferenca"] == pytest.approx(v[y == 1].mean() - v[y == 0].mean(), abs=1e-5) and row["replicas"] == 200
    assert row["baixo"] == pytest.approx(np.quantile(d, 0.025), abs=1e-5) and row["alto"] == pytest.approx(np.quantile(d, 0.975), abs=1e-5)


def test_rows_of_usual_levels_are_not_dealt(spark, monkeypatch):
    """Of rounded scores the ranges hold a row a level, however many rows there are."""
    sizes, stored = {}, resample.io.stored
    monkeypatch.setattr(resample.io, "stored", lambda t, name: (out := stored(t, name), sizes.update({name: out.count()}))[0])
    df = spark.range(60000).select(F.col("id").cast("string").alias("u"), (F.col("id") % 3 % 2).cast("int").alias("y"), (F.col("id") % 200 / 200).alias("p"), (F.col("id") % 2).alias("k"))
    got = resample.replicate_metrics(df, "u", 30, "t", ["k"])
    assert sizes["ranges"] == 200 and got.count() == 60
