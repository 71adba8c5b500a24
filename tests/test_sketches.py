import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions import tails
from riskloom.operators import evaluate, models, profile


@pytest.mark.parametrize("x,k", [(0.5, 1), (3.84, 1), (12, 5), (30, 40), (200, 100), (0, 3)])
def test_chi_square_tail_is_its_integral(x, k):
    t = np.linspace(x, x + 60 * k + 400, 4_000_001)
    t[0] = max(t[0], 1e-9)
    y = np.exp((k / 2 - 1) * np.log(t) - t / 2 - k / 2 * math.log(2) - math.lgamma(k / 2))
    assert tails.chi2_tail(x, k) == pytest.approx(1.0 if x == 0 else float(np.trapezoid(y, t)), abs=1e-6)


@pytest.mark.parametrize("f,a,b", [(0.3, 1, 10), (2.5, 3, 20), (1, 7, 7), (6, 2, 1000), (40, 4, 50), (0, 2, 2)])
def test_f_tail_is_its_integral(f, a, b):
    u = np.linspace(0, 1, 2_000_001)[1:-1]  # u = x / (1 + x), so the tail is finite
    x = u / (1 - u)
    log = math.lgamma((a + b) / 2) - math.lgamma(a / 2) - math.lgamma(b / 2) + a / 2 * math.log(a / b) + (a / 2 - 1) * np.log(x) - (a + b) / 2 * np.log1p(a * x / b) - 2 * np.log1p(-u)
    y = np.where(x >= f, np.exp(log), 0)
    assert tails.f_tail(f, a, b) == pytest.approx(float(np.trapezoid(y, u)), abs=2e-3 if a == 1 else 1e-5)


def test_tests_of_association_match_numpy(spark):
    rng = np.random.default_rng(3)
    g, v, x = rng.integers(0, 3, 500), rng.integers(0, 4, 500), rng.normal(size=500)
    x = x + 0.3 * g
    df = spark.createDataFrame([(int(a), f"v{b}" if b else None, float(c)) for a, b, c in zip(g, v, x)] + [(1, "v1", None)], "g int, v string, x double").withColumn("one", F.lit("k"))
    got = {r["variavel"]: r for r in models.p_values(models.association_tests(df, "g", ["v", "one"], ["x"])).collect()}
    o = np.zeros((3, 4))
    np.add.at(o, (np.r_[g, 1], np.r_[v, 1]), 1)
    e = o.sum(1, keepdims=True) * o.sum(0) / o.sum()
    chi = ((o - e) ** 2 / e).sum()
    assert got["v"]["estatistica"] == pytest.approx(chi, abs=1e-3) and (got["v"]["gl1"], got["v"]["gl2"]) == (6, None)
    assert got["v"]["efeito"] == pytest.approx((chi / (501 * 2)) ** 0.5, abs=1e-5) and got["v"]["p_valor"] == pytest.approx(tails.chi2_tail(chi, 6), abs=1e-5)
    b = sum((g == k).sum() * (x[g == k].mean() - x.mean()) ** 2 for k in range(3))
    w = sum(((x[g == k] - x[g == k].mean()) ** 2).sum() for k in range(3))
    assert got["x"]["estatistica"] == pytest.approx(b / 2 / (w / 497), abs=1e-3) and (got["x"]["gl1"], got["x"]["gl2"]) == (2, 497)
    assert got["x"]["efeito"] == pytest.approx(b / (b + w), abs=1e-5) and 0 < got["x"]["p_valor"] < 0.05
    assert got["one"]["estatistica"] is None and got["one"]["p_valor"] is None


def test_sketches_of_parts_unite_to_that_of_the_whole(spark):
    df = spark.range(60_000).select((F.col("id") % 5).alias("ano"), F.col("id").cast("string").alias("many"), (F.col("id") % 37).alias("few"), F.when(F.col("id") % 2 == 0, F.col("id") % 11).alias("holes"))
    parts = profile.cardinality_sketches(df, ["many", "few", "holes"], ["ano"])
    got = {r["coluna"]: (r["distintos"], r["distintos_com_nulo"]) for r in profile.united_cardinality(parts).collect()}
    whole = {r["coluna"]: r["distintos"] for r in profile.united_cardinality(profile.cardinality_sketches(df, ["many", "few", "holes"])).collect()}
    assert got["few"] == (37, 37) and got["holes"] == (11, 12) and abs(got["many"][0] - 60_000) < 4 * 0.016 * 60_000
    assert whole["few"] == 37 and abs(whole["many"] - got["many"][0]) < 4 * 0.016 * 60_000
    assert len(profile.united_cardinality(parts, ["ano"]).collect()) == 15


def test_sketched_edges_keep_their_rank_bound(spark):
    rng = np.random.default_rng(8)
    p, y, k = rng.beta(1, 8, 30_000), rng.integers(0, 2, 30_000), rng.integers(0, 2, 30_000)
    df = spark.createDataFrame([(float(a), int(b), f"k{c}") for a, b, c in zip(p, y, k)] + [(None, 1, "k0")], "p double, y int, k string").repartition(6)
    per = evaluate.score_sketches(df, ["k"])
    for sketches, keys, of in ((per, ["k"], {"k0": p[k == 0], "k1": p[k == 1]}), (evaluate.merged_sketches(per), [], {None: p})):
        edges = {r["k"] if keys else None: r["inner"] for r in evaluate.sketch_edges(sketches, 10, keys).collect()}
        for key, values in of.items():
            ranks = [(values <= e).mean() for e in edges[key]]
            assert np.abs(np.array(ranks) - np.arange(1, 10) / 10).max() < 0.003
    curve = evaluate.row_reliability(df, evaluate.sketch_edges(per, 10, ["k"]), ["k"]).toPandas()
    assert len(curve) == 20 and curve.n.sum() == 30_000 and curve.n.between(1350, 1650).all()
