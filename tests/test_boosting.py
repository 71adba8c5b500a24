import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from riskloom.operators import boosting
from riskloom.operators.boosting import SCALE, Settings


def frame(spark, n, seed, parts=3):
    """Numbers with gaps, categories, and an outcome that depends on both and on what is missing."""
    rng = np.random.default_rng(seed)
    x = np.where(rng.random(n) < 0.15, np.nan, rng.integers(0, 12, n).astype(float))
    z = rng.normal(size=n).round(2)
    k = rng.choice(["a", "b", "c", "d", "e"], n)
    risk = 1.5 * (np.nan_to_num(x, nan=11) > 6) - 1.2 * np.isin(k, ["b", "d"]) + z - 0.4
    y = (rng.random(n) < 1 / (1 + np.exp(-risk))).astype(int)
    rows = [(i, None if np.isnan(a) else float(a), float(b), str(c) if c != "e" else None, int(t), bool(i % 5 == 0)) for i, (a, b, c, t) in enumerate(zip(x, z, k, y))]
    return spark.createDataFrame(rows, "id int, x double, z double, k string, y int, valid boolean").repartition(parts), rows


def plain_fit(bins, y, kinds, s, rounds, base, weight=(1.0, 1.0)):
    """Raw scores after some rounds: each leaf is searched from its rows, one split at a time."""
    raw = np.full(len(y), base)
    for _ in range(rounds):
        p, w = 1 / (1 + np.exp(-raw)), np.array(weight)[y]
        g, h = np.rint(w * (p - y) * SCALE), np.rint(w * p * (1 - p) * SCALE)

        def look(rows):
            hist = np.zeros((len(kinds), boosting.BINS, 3), np.int64)
            for c in range(len(kinds)):
                for b in set(bins[rows, c].tolist()):
                    at = rows[bins[rows, c] == b]
                    hist[c, b] = g[at].sum(), h[at].sum(), len(at)
            return boosting.best_split(hist, kinds, s)

        leaves = {0: (np.arange(len(y)), look(np.arange(len(y))))}
        made = 1
        while len(leaves) < s.leaves and any(b for _, b in leaves.values()):
            i = min((i for i, (_, b) in leaves.items() if b), key=lambda i: (-leaves[i][1].gain, i))
            rows, split = leaves.pop(i)
            left = split.goes[bins[rows, split.column]]
            leaves[made], leaves[made + 1] = ((r, look(r)) for r in (rows[left], rows[~left]))
            made += 2
        for rows, _ in leaves.values():
            raw[rows] += -s.rate * (g[rows].sum() / SCALE) / (h[rows].sum() / SCALE + s.l2)
    return raw


def plain_best(g, h, s):
    """The best cut of one column of ordered cells by trying each: (gain, cells on the left)."""
    part = lambda a, b: a.sum() ** 2 / (b.sum() + s.l2)
    return max((part(g[:i], h[:i]) + part(g[i:], h[i:]) - part(g, h), i) for i in range(1, len(g)))


def test_split_is_the_best_of_all_cuts():
    rng = np.random.default_rng(0)
    s = Settings(least=1, l2=0.5)
    hist = np.zeros((2, boosting.BINS, 3), np.int64)
    hist[:, 1:9, 0], hist[:, 1:9, 1], hist[:, 1:9, 2] = rng.integers(-9, 9, 8) * SCALE, rng.integers(1, 5, 8) * SCALE, 20
    g, h = hist[0, 1:9, 0] / SCALE, hist[0, 1:9, 1] / SCALE
    number = boosting.best_split(hist[:1], [True], s)
    gain, i = plain_best(g, h, s)
    assert number.gain == pytest.approx(gain) and number.goes[1 : i + 1].all() and not number.goes[i + 1 : 9].any()
    order = np.argsort(g / (h + boosting.SMOOTH), kind="stable")
    gain, i = plain_best(g[order], h[order], s)
    category = boosting.best_split(hist[:1], [False], s)
    assert category.gain == pytest.approx(gain) and set(np.flatnonzero(category.goes[1:9])) == set(order[:i]) and category.gain >= number.gain
    missing = hist[:1].copy()
    missing[0, 0] = hist[0, 8] * 3  # missing values like the last bin go to its side
    assert boosting.best_split(missing, [True], s).goes[0] == boosting.best_split(missing, [True], s).goes[8]
    assert boosting.best_split(hist[:1], [True], Settings(least=1000)) is None


@pytest.mark.parametrize("parts", [1, 5])
def test_trees_equal_a_plain_grower(spark, parts, monkeypatch):
    monkeypatch.setattr(boosting, "REFRESH", 2)
    df, _ = frame(spark, 400, 3, parts)
    settings = {"a": Settings(0.2, 3, 8, 10, 0.1), "b": Settings(0.1, 2, 4, 25, 1.0, True)}
    models = boosting.fit_many(df, settings, ["x", "z"], ["k"])
    scored = boosting.score(models, df).orderBy("id").toPandas()
    pdf = df.orderBy("id").toPandas()
    columns = models["a"].columns
    import pyarrow as pa
    bins = columns.bins(pa.RecordBatch.from_pandas(pdf[["x", "z", "k"]], preserve_index=False))
    y = pdf.y.to_numpy()
    for name, s in settings.items():
        weight = (len(y) / 2 / (y == 0).sum(), len(y) / 2 / (y == 1).sum()) if s.balanced else (1.0, 1.0)
        raw = plain_fit(bins, y, [True, True, False], s, s.rounds, models[name].base, weight)
        assert len(models[name].trees) == s.rounds
        assert scored[scored.candidato == name].p.to_numpy() == pytest.approx(1 / (1 + np.exp(-raw)), abs=1e-8)


def test_rounds_end_by_validation_rows_and_help(spark, monkeypatch):
    monkeypatch.setattr(boosting, "PATIENCE", 3)
    df, rows = frame(spark, 1500, 5)
    model = boosting.fit(df, ["x", "z"], ["k"], Settings(0.3, 60, 8, 20), valid="valid")
    assert 0 < len(model.trees) < 60 and min(model.losses) == model.losses[len(model.trees)] < model.losses[0] - 0.05
    held = boosting.score({"m": model}, df.where("valid")).toPandas()
    loss = -np.log(np.where(held.y == 1, held.p, 1 - held.p)).mean()
    assert loss == pytest.approx(model.losses[len(model.trees)], abs=1e-5)


def test_odd_tables(spark):
    df, _ = frame(spark, 60, 1)
    none = boosting.fit(df.limit(0), ["x"], ["k"])
    assert none.trees == [] and boosting.score({"m": none}, df.select("x", "k")).select("p").distinct().collect()[0][0] == 0.5
    one = boosting.fit(df.where("y = 1"), ["x"], ["k"])
    assert one.trees == []
    few = boosting.fit(df, ["x", "z"], ["k"], Settings(least=100))
    assert few.trees == [] and boosting.score({"m": few}, df).select("p").distinct().count() == 1
    new = spark.createDataFrame([(None, float("nan"), "unseen"), (1e300, -1e300, None)], "x double, z double, k string")
    fitted = boosting.fit(df, ["x", "z"], ["k"], Settings(0.1, 2, 4, 5))
    assert boosting.score({"m": fitted}, new).count() == 2


def test_rows_alike_are_one_with_their_number(spark, monkeypatch):
    """What the passes read does not grow with repeated rows, and the trees are those of all rows."""
    df, _ = frame(spark, 300, 8)
    sizes, stored = [], boosting.io.stored
    monkeypatch.setattr(boosting.io, "stored", lambda t, name: (out := stored(t, name), sizes.append((name, out.count())))[0])
    s = Settings(0.2, 3, 6, 40)
    one = boosting.fit(df.select("x", "k", "y"), ["x"], ["k"], s)
    many = boosting.fit(df.select("x", "k", "y").crossJoin(spark.range(5)), ["x"], ["k"], Settings(0.2, 3, 6, 200, 0.5))
    assert len({n for name, n in sizes if name == "boost"}) == 1 and max(n for name, n in sizes if name == "boost") <= 13 * 6 * 2
    assert [t.column for t in one.trees] == [t.column for t in many.trees] and len(one.trees) == 3
    assert all(np.allclose(a.value, b.value) for a, b in zip(one.trees, many.trees))


def fitted(df, settings, monkeypatch, held):
    monkeypatch.setattr(boosting, "HELD", held)
    return boosting.fit_many(df, settings, ["x", "z"], ["k"], valid="valid")


@pytest.mark.parametrize("refresh", [2, 20])
def test_held_rows_and_passes_give_the_same_trees(spark, monkeypatch, refresh):
    monkeypatch.setattr(boosting, "PATIENCE", 4)
    monkeypatch.setattr(boosting, "REFRESH", refresh)
    df, _ = frame(spark, 900, 11)
    settings = {"a": Settings(0.3, 9, 8, 20), "b": Settings(0.1, 5, 12, 10, 0.0, True), "c": Settings(0.3, 4, 6, 20, only=("x", "k")), "none": Settings(least=5000)}
    a, b = (fitted(df, settings, monkeypatch, held) for held in (boosting.HELD, 0))
    for name in settings:
        assert [(t.column, t.left, t.goes.tolist()) for t in a[name].trees] == [(t.column, t.left, t.goes.tolist()) for t in b[name].trees]
        assert all(x.value == pytest.approx(y.value, abs=1e-12) for x, y in zip(a[name].trees, b[name].trees))
        assert a[name].losses == pytest.approx(b[name].losses, abs=1e-7) and a[name].base == b[name].base
    assert len(a["a"].trees) > 3 and a["none"].trees == []
    p, q = (boosting.score(m, df).orderBy("id", "candidato").toPandas().p.to_numpy() for m in (a, b))
    assert len(p) == 900 * 4 and p == pytest.approx(q, abs=1e-8)


def test_jobs_of_a_fit_do_not_grow_with_its_rounds(spark):
    df, _ = frame(spark, 500, 4)
    counts = []
    for rounds in (2, 30):
        spark.sparkContext.setJobGroup(f"rounds-{rounds}", "")
        model = boosting.fit(df, ["x", "z"], ["k"], Settings(0.1, rounds, 12, 10))
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"rounds-{rounds}")))
        assert len(model.trees) == rounds
    spark.sparkContext.setJobGroup(None, None)
    assert counts[0] == counts[1] > 0


def test_scores_of_many_batches(spark, monkeypatch):
    """Rows are gathered and those alike are scored once; each gets its own score back."""
    df, _ = frame(spark, 700, 2, 2)
    model = boosting.fit(df, ["x", "z"], ["k"], Settings(0.2, 5, 8, 20))
    whole = {r["id"]: r["p"] for r in boosting.score({"m": model}, df).collect()}
    monkeypatch.setattr(boosting, "SCORED", 100)
    monkeypatch.setattr(boosting, "ROWS", 30)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        parts = boosting.score({"m": model}, df).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(parts) == 700 and {r["id"]: r["p"] for r in parts} == whole and len(set(whole.values())) > 10


def test_executors_need_no_copy_of_the_package(tmp_path):
    (tmp_path / "fit.py").write_text(f"""import sys
sys.path.insert(0, {str(Path(__file__).resolve().parent.parent)!r})
from pyspark.sql import SparkSession
from riskloom.operators import boosting
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
df = spark.range(400).selectExpr("double(id % 20) x", "string(id % 3) k", "int(id % 20 > 8) y")
print("scored", boosting.score({{"m": boosting.fit(df, ["x"], ["k"], boosting.Settings(0.3, 3, 4, 10))}}, df).select("p").distinct().count())
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "fit.py"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "scored 2" in done.stdout, done.stderr[-2000:]
