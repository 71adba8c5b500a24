import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import boosting, models
from riskloom.sources import io


def table(spark, n=600, seed=2):
    rng = np.random.default_rng(seed)
    x, k = np.where(rng.random(n) < 0.1, np.nan, rng.normal(2, 3, n)), rng.choice(["a", "b", "c"], n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.4 * np.nan_to_num(x, nan=2) - 1 + (k == "b"))))).astype(int)
    return spark.createDataFrame([(None if np.isnan(a) else float(a), str(b) if b != "c" else None, int(t), float(1 + t)) for a, b, t in zip(x, k, y)], "x double, k string, y int, w double")


def plain_logistic(f, y, w, reg, l1):
    """Proximal gradient on mean weighted log loss + reg * (l1 |b| + (1 - l1) / 2 b'b), the intercept free."""
    w = w / w.sum()
    f = np.column_stack([np.ones(len(f)), f])
    step = 1 / (0.25 * np.linalg.norm(f * np.sqrt(w)[:, None], 2) ** 2 + reg)
    b = np.zeros(f.shape[1])
    for _ in range(60_000):
        g = f.T @ (w * (1 / (1 + np.exp(-f @ b)) - y))
        g[1:] += reg * (1 - l1) * b[1:]
        new = b - step * g
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * reg * l1, 0)
        if np.abs(new - b).max() < 1e-11:
            break
        b = new
    return b


@pytest.mark.parametrize("c,l1,weight", [(1.0, 0.0, None), (0.01, 0.0, "w"), (0.02, 0.5, None), (0.02, 1.0, "w")])
def test_logistic_with_penalties_matches_numpy(spark, c, l1, weight):
    df = table(spark)
    model = models.fit(df, "lr", ["x"], ["k"], c=c, l1=l1, weight=weight)
    rows = model.transform(df.na.fill(models.MISSING, ["k"])).select("features", "y", "w", "probability").toPandas()
    f = np.array([v.toArray() for v in rows.features])
    b = plain_logistic(f, rows.y.to_numpy(), rows.w.to_numpy() if weight else np.ones(len(rows)), 1 / (c * len(rows)), l1)
    p = 1 / (1 + np.exp(-(b[0] + f @ b[1:])))
    assert np.abs(p - np.array([v[1] for v in rows.probability])).max() < 2e-3
    if l1 == 1.0:
        assert (np.abs(model.stages[-1].coefficients.toArray()) < 1e-6).sum() == (np.abs(b[1:]) < 1e-6).sum() > 0


def test_features_are_imputed_and_scaled(spark):
    df = table(spark)
    f = models.fit(df, "lr", ["x"], ["k"]).transform(df.na.fill(models.MISSING, ["k"])).select("x", "k", "features").toPandas()
    x = f.x.fillna(f.x.median())
    assert np.array([v[0] for v in f.features]) == pytest.approx((x / x.std()).to_numpy(), rel=0.02)
    assert all(v.toArray()[1:].sum() == 1 for v in f.features)


def test_leaves_of_a_tree_hold_their_share(spark):
    df = table(spark)
    scored = models.score(models.fit(df, "tree", ["x"], ["k"]), df, ["k"]).groupBy("p").agg(F.avg("y").alias("m"), F.count("*").alias("n")).collect()
    assert 2 < len(scored) <= 32 and all(r["p"] == pytest.approx(r["m"], abs=1e-6) and r["n"] >= 20 for r in scored)


def test_every_fit_is_guarded(spark):
    df = table(spark).withColumn("uti", F.lit(1.0)).withColumn("cluster", F.lit("c"))
    for fit in (lambda n, k: models.fit(df, "lr", n, k), lambda n, k: boosting.fit(df, n, k)):
        for n, k in ((["x", "uti"], ["k"]), (["x"], ["k", "cluster"]), (["x", "y"], ["k"]), (["x"], ["x"])):
            with pytest.raises(ValueError):
                fit(n, k)
    with pytest.raises(io.LeakageError):
        io.guard(["x", "evolucao"], [], ["x"], ["evolucao"])


def test_cells_of_many_rows_do_not_overflow(spark):
    """Counts whose products pass 64 bits, by weights that stand for rows."""
    rows = [("x", 0, 4e9), ("x", 1, 1e9), ("z", 0, 1e9), ("z", 1, 4e9)]
    df = spark.createDataFrame(rows, "k string, g int, w double")
    row = models.cramers_v(df, "g", ["k"], "w").first()
    assert row["v_cramer"] == 0.6 and row["qui2"] == 3.6e9
    few = spark.createDataFrame([(k, g) for k, g, w in rows for _ in range(int(w / 1e9))], "k string, g int")
    assert models.cramers_v(few, "g", ["k"]).first()["v_cramer"] == 0.6


def test_rows_alike_stand_for_all(spark):
    rows = spark.range(600).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 7 % 3).cast("string").alias("k"))
    one, _ = models.cluster_features(rows, ["a"], ["k"])
    alike, _ = models.cluster_features(rows, ["a"], ["k"], alike=True)
    assert alike.count() == 7 and alike.agg(F.sum("peso")).first()[0] == 600
    of = lambda df: {(r["a"], r["k"], tuple(r["weighted"].toArray().round(12))) for r in df.collect()}
    assert of(one) == of(alike)
    found = models.kmeans(alike, 3, "weighted", "peso")
    whole = one.join(found.select("a", "k", "cluster"), ["a", "k"])
    assert models.eta_squared(found, "cluster", ["a"], "peso").first() == models.eta_squared(whole, "cluster", ["a"]).first()
    assert models.cramers_v(found, "cluster", ["k"], "peso").first() == models.cramers_v(whole, "cluster", ["k"]).first()


def spied(monkeypatch):
    """Names of the tables that fits write, with their rows."""
    seen, stored = [], io.stored
    def spy(df, name):
        out = stored(df, name)
        seen.append((name, out.count()))
        return out
    monkeypatch.setattr(io, "stored", spy)
    return seen


def test_linear_fits_read_rows_alike_once(spark, monkeypatch):
    """50 copies of a table are fitted from its own rows, with the same optimum as one row each."""
    df = table(spark, 120)
    many = df.crossJoin(spark.range(50)).drop("id")
    seen = spied(monkeypatch)
    model = models.fit(many, "lr", ["x"], ["k"])
    assert [n for n, _ in seen] == ["alike"] and seen[0][1] <= 120
    rows = models.preprocessor(["x"], ["k"])
    filled = many.na.fill(models.MISSING, ["k"])
    plain = models.Pipeline(stages=[*rows, models.estimator("lr", 6000)]).fit(filled)
    assert np.allclose(model.stages[-1].coefficients.toArray(), plain.stages[-1].coefficients.toArray(), atol=1e-5)


def test_trees_read_features_written_once(spark, monkeypatch):
    """F19, F21."""
    df = table(spark, 300)
    seen = spied(monkeypatch)
    model = models.fit(df, "tree", ["x"], ["k"])
    assert seen == [("fit-features", 300)]
    filled = df.na.fill(models.MISSING, ["k"])
    plain = models.Pipeline(stages=[*models.preprocessor(["x"], ["k"], one_hot=False), models.estimator("tree", 300)]).fit(filled)
    assert model.stages[-1].toDebugString.split("\n")[1:] == plain.stages[-1].toDebugString.split("\n")[1:]


def test_calibrations_read_levels(spark, monkeypatch):
    """both fits read a row for each score and outcome, and give what all rows give."""
    df = spark.createDataFrame([(i % 10 / 10, int(i * 7 % 13 < 1 + i % 10)) for i in range(1000)], "p double, y int")
    seen = spied(monkeypatch)
    iso = {r["p"]: r["p_cal"] for r in models.isotonic_calibration(df, df.select("p").distinct()).collect()}
    models.sigmoid_calibration(df, df)
    assert [n for n, _ in seen] == ["score-levels"] * 2 and all(k <= 20 for _, k in seen)
    share = {r["p"]: r["m"] for r in df.groupBy("p").agg(F.avg("y").alias("m")).collect()}
    if sorted(share.values()) == [share[p] for p in sorted(share)]:
        assert all(abs(iso[p] - share[p]) < 1e-9 for p in share)


def test_the_parent_answer_is_asked_first():
    """F23."""
    from riskloom.functions import codes

    told = str(codes.fill_when_parent_denies(F.col("own"), F.col("parent")))
    assert told.index("parent") < told.index("own")


def test_linear_candidates_share_their_rows_and_one_reading(spark, monkeypatch):
    """The rows are prepared once for each set of columns; scores are those of fits one by one."""
    df = table(spark, 300, 6).withColumn("id", F.monotonically_increasing_id())
    seen, stored = [], io.stored
    monkeypatch.setattr(io, "stored", lambda t, name: (seen.append(name), stored(t, name))[1])
    sets = {f"{c:g} {l1:g} {w}": {"name": "lr", "c": c, "l1": l1, **({"weight": w} if w else {})} for c in (0.05, 1.0) for l1 in (0.0, 0.5) for w in (None, "w")}
    sets["few"] = {"name": "lr", "numeric": ["x"], "categorical": []}
    found = models.scored_sets(df, df, sets, ["x"], ["k"])
    assert seen == ["alike", "alike"] and found.columns == ["candidato", *df.columns, "p"]
    rows = {(r["candidato"], r["id"]): (r["k"], r["p"]) for r in found.collect()}
    assert len(rows) == 300 * len(sets)
    for name, o in sets.items():
        o, c = dict(o), sets[name].get("categorical", ["k"])
        o.pop("name"), o.pop("numeric", None), o.pop("categorical", None)
        one = models.score(models.fit(df, "lr", ["x"], c, **o), df, c).select("id", "k", "p").collect()
        assert all(rows[name, r["id"]][0] == r["k"] and rows[name, r["id"]][1] == pytest.approx(r["p"], abs=1e-6) for r in one)
