import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions import codes
from riskloom.operators import blocks, evaluate
from riskloom.sources import io


def test_codes(spark):
    df = spark.createDataFrame([(" 1.0 ", "2020-1-5"), ("nan", "2020-02-30"), (None, "20200105"), ("9", "05/01/2020")], "c string, d string")
    got = df.select(codes.code(F.col("c")), codes.iso_date(F.col("d")).cast("string"), codes.tolerant_date(F.col("d")).cast("string")).collect()
    assert [tuple(r) for r in got] == [("1", "2020-01-05", "2020-01-05"), (None, None, None), (None, None, None), ("9", None, "2020-01-05")]


def test_auc_and_ap_match_numpy(spark):
    rng = np.random.default_rng(1)
    p, y = rng.integers(0, 40, 300) / 40, rng.integers(0, 2, 300)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p double, y int")
    pos, neg = p[y == 1], p[y == 0]
    auc = ((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()).item()
    ap = sum((pos == t).sum() / len(pos) * (pos >= t).sum() / (p >= t).sum() for t in set(p))
    row = evaluate.discrimination(evaluate.levels(df)).first()
    assert row["roc_auc"] == pytest.approx(auc, abs=1e-6) and row["pr_auc"] == pytest.approx(ap, abs=1e-6)
    flipped = evaluate.discrimination(evaluate.levels(df.withColumn("p", 1 - F.col("p")))).first()
    assert flipped["roc_auc"] == pytest.approx(1 - auc, abs=1e-6)


def test_one_class_has_no_auc(spark):
    df = spark.createDataFrame([(0.2, 0), (0.4, 0)], "p double, y int")
    row = evaluate.metrics(df, 0.5).first()
    assert row["roc_auc"] is None and row["pr_auc"] is None and row["brier"] is None and row["f1"] == 0.0


@pytest.mark.parametrize("parts", [1, 7])
def test_blocks_do_not_depend_on_partitions(spark, parts):
    groups = spark.range(200).select(F.col("id").cast("string").alias("grupo"), (F.col("id") % 3).alias("s")).repartition(parts)
    got = {r["grupo"]: r["bloco"] for r in blocks.hash_blocks(groups, ["s"]).collect()}
    again = {r["grupo"]: r["bloco"] for r in blocks.hash_blocks(groups.coalesce(1), ["s"]).collect()}
    assert got == again and len(got) == 200
    per = blocks.hash_blocks(groups, ["s"]).groupBy("s").agg(F.count_distinct("bloco").alias("b")).collect()
    assert all(r["b"] == 3 for r in per)


def test_sealed_blocks(spark, tmp_path):
    df = spark.createDataFrame([("train_ref", 1), ("test_ref", 2)], "particao string, x int")
    path = f"file://{tmp_path}/t"
    io.write_blocks(df, path)
    with pytest.raises(PermissionError):
        io.read_blocks(spark, path, ("test_ref",))
    with pytest.raises(ValueError):
        io.read_blocks(spark, path, ("val_ref",))
    assert io.read_blocks(spark, path, ("test_ref",), ("test_ref",)).count() == 1


def one(spark, schema, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_code_loses_one_decimal_zero_only(spark):
    got = one(spark, "c string", [("1.0",), ("1.00",), ("10",), (" NaN ",), ("<NA>",), (" 2.0 ",)], codes.code(F.col("c")))
    assert [r[0] for r in got] == ["1", "1.00", "10", None, None, "2"]


def test_group_id_falls_back_and_raises(spark):
    rows = [("12 34", "a"), ("", "b"), ("nan", " c "), (None, "d"), ("None", "e")]
    got = one(spark, "n string, r string", rows, codes.group_id(F.col("n"), F.col("r")))
    assert [r[0] for r in got] == ["1234", "sem_notific:b", "sem_notific:c", "sem_notific:d", "sem_notific:e"]
    with pytest.raises(Exception, match="neither"):
        one(spark, "n string, r string", [("", "null")], codes.group_id(F.col("n"), F.col("r")))


def test_fill_pattern_follows_blanks_then_denials(spark):
    s, c = [f"s{i}" for i in range(7)], ["c1", "c2"]
    rows = [(*["1"] * 7, "1", "9"), (*["1"] * 7, "2", None), (*[None, "", " ", None, None, None], "1", "2", "2"), (*[None] * 5, "1", "1", "2", "1")]
    columns = [F.col(x) for x in s], [F.col(x) for x in c]
    got = one(spark, ", ".join(f"{x} string" for x in s + c), rows, codes.fill_pattern(*columns), codes.any_answer(columns[1]))
    assert got == [("comorbidades_sem_nao", True), ("sim_e_nao", True), ("sintomas_em_branco", True), ("sim_e_nao", True)]


def test_bands_labels_and_policies(spark):
    got = one(spark, "a double, d int", [(0.5, 3), (4.9, -1), (11.0, 99), (79.0, None), (None, 0)], codes.age_band(F.col("a")), codes.coarse_band(codes.age_band(F.col("a"))), codes.label(F.lit("x"), codes.coarse_band(codes.age_band(F.col("a")))), codes.kept_interval(F.col("d"), 60, "descartar"), codes.kept_interval(F.col("d"), 60))
    assert [r[:2] for r in got] == [("<1", "menos de 5 anos"), ("1-4", "menos de 5 anos"), ("5-11", "5 a 17 anos"), ("60-79", "60 anos ou mais"), ("desconhecida", None)]
    assert [r[2] is None for r in got] == [False] * 4 + [True] and [r[3] for r in got] == [True, False, False, False, True] and all(r[4] for r in got)
    with pytest.raises(ValueError):
        codes.kept_interval(F.col("d"), 60, "other")


@pytest.mark.parametrize("parts", [1, 5])
def test_quantile_edges_and_slopes_match_numpy(spark, parts):
    rng = np.random.default_rng(3)
    p, k = np.round(rng.random(400) ** 6, 5), rng.integers(0, 2, 400)
    y = (rng.random(400) < p).astype(int)
    df = spark.createDataFrame([(float(a), int(b), int(c)) for a, b, c in zip(p, y, k)], "p double, y int, k int").repartition(parts)
    edges = {r["k"]: r["inner"] for r in evaluate.quantile_edges(evaluate.levels(df, ["k"]), 10, ["k"]).collect()}
    for key in (0, 1):
        assert edges[key] == pytest.approx(np.unique(np.quantile(p[k == key], np.linspace(0, 1, 11)))[1:-1].tolist())
    slope = {r["k"]: r["inclinacao"] for r in evaluate.slopes(evaluate.levels(df, ["k"]), ["k"]).collect()}
    for key in (0, 1):
        q = np.clip(p[k == key], 1e-6, 1 - 1e-6)
        x, t, w = np.column_stack([np.ones(len(q)), np.log(q / (1 - q))]), y[k == key], np.array([0.0, 1.0])
        for _ in range(30):
            m = 1 / (1 + np.exp(-x @ w))
            w += np.linalg.solve((x * (m * (1 - m))[:, None]).T @ x, x.T @ (t - m))
        assert slope[key] == pytest.approx(w[1], abs=1e-4)


def test_choice_of_a_cut_that_nothing_meets_is_an_error(spark):
    df = spark.createDataFrame([(0.2, 0), (0.4, 1), (0.6, 0)], "p double, y int")
    swept = evaluate.sweep(df, [0.1, 0.3, 0.5])
    assert evaluate.choose(swept, "f1").first()["limiar"] == 0.3
    with pytest.raises(Exception, match="no cut"):
        evaluate.choose(swept, "f1", least_precision=0.9).collect()


def test_bootstrap_interval_is_that_of_numpy(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 400)
    p = np.round(np.clip(0.3 * y + rng.random(400) * 0.7, 0, 1), 2)
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(p, y))], "id int, p double, y int").withColumn("id", F.col("id").cast("string"))
    row = evaluate.bootstrap(df, "id", ["brier"], 400, "s").first()
    loss = (y - p) ** 2
    draws = [loss[rng.integers(0, 400, 400)].mean() for _ in range(2000)]
    assert row["estimativa"] == pytest.approx(loss.mean(), abs=1e-6) and row["replicas"] == 400
    assert row["baixo"] == pytest.approx(np.quantile(draws, 0.025), abs=0.006) and row["alto"] == pytest.approx(np.quantile(draws, 0.975), abs=0.006)
    pair = evaluate.bootstrap_difference(df, "id", F.col("p"), ["brier"], 50, "s").first()
    assert pair["diferenca"] == 0 and pair["p_valor"] == 1


def test_cluster_weights(spark):
    from riskloom.operators import models

    rows = [(float(i), "a" if i % 4 else "b", ["x", "y", "z"][i % 3]) for i in range(24)]
    df = spark.createDataFrame(rows, "n double, c string, d string")
    out, weights = models.cluster_features(df, ["n"], ["c", "d"])
    var = [(1 - (0.75**2 + 0.25**2)) / 2, (1 - 3 / 9) / 3]
    assert weights["c"] == pytest.approx(2**-0.5) and weights["d"] == pytest.approx(3**-0.5) and weights["n"] == pytest.approx((sum(var) / 2) ** 0.5)
    x = np.array([r["weighted"].toArray() for r in out.select("weighted").collect()])
    assert x[:, 0].mean() == pytest.approx(0) and x[:, 0].std(ddof=1) == pytest.approx(weights["n"])


def test_calibration_models_match_numpy(spark):
    from riskloom.operators import models

    rng = np.random.default_rng(9)
    p = np.round(rng.random(300), 3)
    y = (rng.random(300) < p**2).astype(int)
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(p, y))], "id int, p double, y int")
    got = {r["id"]: r["p_cal"] for r in models.sigmoid_calibration(df, df).collect()}
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    q = np.clip(p, 1e-6, 1 - 1e-6)
    x, w = np.column_stack([np.ones(300), np.log(q / (1 - q))]), np.zeros(2)
    for _ in range(50):
        m = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (m * (1 - m))[:, None]).T @ x, x.T @ (t - m))
    assert np.allclose([got[i] for i in range(300)], 1 / (1 + np.exp(-x @ w)), atol=1e-3)
    iso = {r["id"]: r["p_cal"] for r in models.isotonic_calibration(df, df).collect()}
    order = np.argsort(p, kind="stable")
    assert (np.diff([iso[int(i)] for i in order]) >= -1e-12).all() and np.mean(list(iso.values())) == pytest.approx(y.mean(), abs=1e-6)


def test_usable_columns(spark):
    from riskloom.operators import models

    df = spark.range(1).withColumn("a", F.lit(1))
    assert models.usable(df, ["a", "b"], strict=False) == ["a"]
    with pytest.raises(ValueError):
        models.usable(df, ["a", "b"])


def test_tables_are_checked_written_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([("train_ref", 1, "a"), ("val_ref", 2, None)], "particao string, x int, t string")
    assert io.require(df, ["x"]) is df and io.free_targets(df, ["y"]) is df
    for bad in (lambda: io.require(df, ["zz"]), lambda: io.free_targets(df, ["x"]), lambda: io.free_targets(df, ["y", "y"]), lambda: io.guard(["x"], ["x"], ["x"], []), lambda: io.guard(["x", "t"], [], ["x"], [])):
        with pytest.raises(ValueError):
            bad()
    io.guard(["x", "t"], ["y"], ["x"], ["t"])
    assert io.needed_columns({"a": ["x"], "b": ["x", "t"]}, ["t", "particao"]) == ["x", "t", "particao"]
    size, types, rows = io.profile(df)
    assert tuple(size.first()) == (2, 3) and [tuple(r) for r in types.collect()] == [(1, "particao", "string"), (2, "x", "int"), (3, "t", "string")] and rows.count() == 2
    assert [tuple(r) for r in io.presence(df, {"g": ["x", "q"]}).collect()] == [("g", "x", True), ("g", "q", False)]
    assert [tuple(r) for r in io.time_risk(df, {"x": "alta", "q": "alta"}).collect()] == [("x", "alta", True), ("q", "alta", False)]
    path = f"file://{tmp_path}/t"
    df.write.parquet(path)
    assert io.scan(spark, path, ["x"], "x > 1").collect() == [(2,)]
    io.manifest(df, "t", "1", "particao").write.json(f"{path}-m")
    assert io.read_checked(spark, path, f"{path}-m").count() == 2
    df.limit(1).write.mode("append").parquet(path)
    with pytest.raises(ValueError):
        io.read_checked(spark, path, f"{path}-m")
    for gzip in (False, True):
        io.write_csv(df, f"{path}-{gzip}", gzip)
        again = spark.read.option("header", True).schema(df.schema).csv(f"{path}-{gzip}")
        assert io.same_rows(df, again) and not io.same_rows(df, again.limit(1))
        with pytest.raises(Exception):
            io.write_csv(df, f"{path}-{gzip}", gzip)
    found = io.roles(df, {"treino": ("train_ref",), "validacao": ("val_ref",)})
    assert found["treino"].count() == 1
    with pytest.raises(ValueError):
        io.roles(df, {"teste": ("test_ref",)})


def test_joins_that_promise_keys(spark, tmp_path):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, l string")
    right = spark.createDataFrame([(1, 5), (1, 3), (2, 9)], "k int, r int")
    with pytest.raises(ValueError):
        io.one_to_one(left, right, ["k"])
    assert sorted(map(tuple, io.many_to_one(left, right, ["k"], "r").collect())) == [(1, "a", 3), (2, "b", 9)]
    with pytest.raises(ValueError):
        io.many_to_one(left, right.where("k = 1"), ["k"], "r", needed=["r"])
    check = lambda ok: (lambda df: df.sparkSession.createDataFrame([("c", ok)], "verificacao string, ok boolean"))
    assert io.publish(left, f"file://{tmp_path}/s", f"file://{tmp_path}/p", check(True)).count() == 2
    with pytest.raises(ValueError):
        io.publish(left, f"file://{tmp_path}/s", f"file://{tmp_path}/q", check(False))


def test_strata_are_checked(spark):
    rows = spark.createDataFrame([("g1", 1), ("g1", 2), (None, 1), ("g2", None)], "g string, s int")
    got = {r["verificacao"]: r["observado"] for r in blocks.check_strata(rows, "g", ["s"], 3).collect()}
    assert got == {"grupo_nulo": 1, "estrato_nulo": 1, "grupo_em_estratos": 1, "estrato_pequeno": 3}
    with pytest.raises(ValueError):
        blocks.check_strata(rows, "g", ["s"], 2)
    ratio = {r["b"]: tuple(r)[1:] for r in blocks.ratio_check(spark.createDataFrame([("x",), ("odd",)], "b string"), "b", (("x", 0.5), ("y", 0.5))).collect()}
    assert ratio["x"] == (0.5, 1, 0.5, True) and ratio["y"][1] == 0 and not ratio["y"][3] and ratio["odd"][0] is None and not ratio["odd"][3]
