"""What plans and writes must not do: costly keys repeated, sources read again, unchecked tables left behind."""

import re

import pytest
from pyspark.sql import functions as F

from riskloom.operators import blocks, evaluate
from riskloom.plans import registry
from riskloom.sources import io

SMALL = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["rule_waterfall", "effective_waterfall", "rules_by_year", "rule_summary"])
def test_masks_are_worked_out_once(spark, name):
    """No predicate on a computed key is pushed into the rows: dates are parsed seven times for the bits, and once for the year."""
    plan = plan_of(registry.QUERIES[name](spark, SMALL))
    assert 7 <= len(re.findall("gettimestamp", plan)) <= 8 * len(re.findall(r"Relation \[l_orderkey", plan))


@pytest.mark.parametrize("name", ["calibration_summary_by_year", "calibration_summary_by_window", "metric_row", "metrics_by_group", "metrics_by_window"])
def test_levels_are_stored_once(spark, name):
    """The result reads stored levels, and the source no more."""
    assert "l_orderkey" not in plan_of(registry.QUERIES[name](spark, SMALL))


def test_slopes_of_no_key_and_of_one_class(spark):
    df = spark.createDataFrame([(0.2, 0, "a"), (0.4, 1, "a"), (0.6, 0, "a"), (0.9, 1, "a"), (0.5, 1, "b")], "p double, y int, k string")
    assert evaluate.slopes(evaluate.levels(df, ["k"]), ["k"]).count() == 1
    assert evaluate.slopes(evaluate.levels(df)).count() == 1 and evaluate.slopes(evaluate.levels(df.limit(0))).count() == 0


def observed(spark, rows, kind, path, more=lambda df: df):
    return io.publish_observed(spark, lambda s: more(s.createDataFrame(rows, kind)), f"file://{path}", "id", F.col("y").isNull(), (0, 1), "y")


def test_publish_checks_while_it_writes(spark, tmp_path):
    kind, good = "id string, y int", [("a", 1), ("b", 0)]
    table, checks = observed(spark, good, kind, tmp_path / "t")
    assert table.count() == 2 and table.columns == ["id", "y"]
    assert {r["verificacao"]: r["observado"] for r in checks.collect()} == {"linhas": 2, "chave_nula": 0, "chave_repetida": 0, "violacoes": 0, "fora_do_dominio": 0}
    with pytest.raises(FileExistsError):
        observed(spark, good, kind, tmp_path / "t")
    with pytest.raises(ValueError, match="chave_nula.*chave_repetida.*violacoes.*fora_do_dominio"):
        observed(spark, [("a", 1), ("a", None), (None, 3), (None, 0)], kind, tmp_path / "bad")
    with pytest.raises(ValueError, match="linhas"):
        observed(spark, [], kind, tmp_path / "none")
    slow = F.udf(lambda y: 1 // y, "int")
    with pytest.raises(Exception, match="ZeroDivision"):
        observed(spark, good, kind, tmp_path / "err", lambda df: df.withColumn("z", slow("y")))
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["t"]


def test_publish_observed_agrees_with_the_checks_read_back(spark, tmp_path):
    kind, rows = "id string, y int", [(str(i % 40), i % 3 if i % 7 else None) for i in range(100)]
    want = {r["verificacao"]: r["observado"] for r in io.published_checks(spark.createDataFrame(rows, kind), "id", F.col("y").isNull(), (0, 1), "y").collect()}
    with pytest.raises(ValueError) as error:
        observed(spark, rows, kind, tmp_path / "t")
    assert all((name in str(error.value)) == (n > 0) for name, n in want.items() if name != "linhas")


@pytest.mark.parametrize("few", [0, 10**6])
def test_cuts_place_rows_as_ranks_do(spark, monkeypatch, few):
    """Only rows of a prefix that a cut divides are ranked, and all get the place that a full ranking gives."""
    monkeypatch.setattr(blocks, "PLACED_ROWS", few)
    rows = spark.range(3000).select(F.col("id").cast("string").alias("i"), F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id") % 3).alias("s"))
    ranks = {r["i"]: (r["pos"], r["tam"]) for r in blocks.ranked(rows, ["s"], "i", "x").collect()}
    cuts = F.array(F.floor(F.col("tam") / 3).cast("long"), F.floor(F.col("tam") / 2).cast("long"))
    got = {r["i"]: (r["faixa"], r["tam"]) for r in blocks.placed(rows, ["s"], "i", "x", cuts).collect()}
    assert got == {i: ((pos > tam // 3) + (pos > tam // 2), tam) for i, (pos, tam) in ranks.items()}
    per = {r["s"]: r["n"] for r in blocks.quota_sample(rows, ["s"], "i", 40).groupBy("s").agg(F.count("*").alias("n")).collect()}
    assert sum(per.values()) == 40 and len(per) == 4
    one = {r["i"] for r in blocks.random_subsample(rows, "i", 25).collect()}
    everything = blocks.ranked(rows.withColumn("a", F.lit(1)), ["a"], "i", "amostra-1")
    assert one == {r["i"] for r in everything.where("pos <= 25").collect()}


def test_halves_of_rows_with_columns_of_the_same_names(spark):
    rows = spark.range(40).select(F.col("id").cast("string").alias("i"), F.lit("a").alias("faixa"), F.lit(7).alias("tam"), F.lit(1).alias("s"))
    got = blocks.halves(rows, ["s"], "i")
    assert got.columns == [*rows.columns, "metade"] and got.where("faixa = 'a' and tam = 7").groupBy("metade").count().select("count").collect() == [(20,), (20,)]
    assert blocks.quota_sample(rows, ["s"], "i", 8).columns == blocks.random_subsample(rows, "i", 8).columns == rows.columns


def test_class_weights_are_compared(spark):
    rows = registry.QUERIES["class_weight_compare"](spark, SMALL).collect()
    assert {r["candidato"] for r in rows} == {f"{f} {w}" for f in ("lr", "tree") for w in ("sem_peso", "peso")}
    assert sum(r["melhor"] for r in rows) == 2 and all(r["brier"] is not None and r["ece"] is not None for r in rows)


def test_lines_travel_once(spark):
    """Repeated keys and the join to orders share the shuffle of lines by order."""
    from riskloom.sources import episodes as ep

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = ep.episodes(spark, SMALL).select("id_registro")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"Exchange hashpartitioning\(k#", plan)) == 2  # lines and orders
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_terciles_read_the_source_once(spark):
    assert "l_orderkey" not in plan_of(registry.QUERIES["completeness_terciles"](spark, SMALL))
    assert "l_orderkey" not in plan_of(registry.QUERIES["predictions_with_audit"](spark, SMALL))


def test_plain_dates_are_read_as_the_format_reads_them(spark):
    from riskloom.functions import codes

    texts = ["1995-01-02", "1995-1-2", " 1995-01-02 ", "1995-02-30", "0000-01-01", "1995-01-1T", "1995-01-02T", "12345-1-11", "x", None, "1995-13-01", "1995-01-02\n"]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    old = F.to_date(F.try_to_timestamp(codes.stripped(F.col("c")), F.lit("yyyy-M-d")))
    assert df.where(~codes.iso_date(F.col("c")).eqNullSafe(old)).count() == 0


def test_the_build_lays_its_rows_out_once(spark, monkeypatch):
    seen, laid = [], io.stored_by
    monkeypatch.setattr(io, "stored_by", lambda df, key, name, *more: (seen.append((name, key)), laid(df, key, name, *more))[1])
    assert registry.QUERIES["supervised_build"](spark, SMALL).count() > 0
    assert seen == [("built", "grupo")]


def test_ablation_by_year_fits_without_a_job_a_step(spark, monkeypatch):
    """All families and sets by year are there, and no boost goes through passes of jobs; the ablation has the same differences over all years."""
    from riskloom.operators import boosting
    from riskloom.plans import learning

    monkeypatch.setattr(boosting, "_fit_passes", lambda *_: pytest.fail("a job for each step"))
    made, ablated = [], learning._ablated
    monkeypatch.setattr(learning, "_ablated", lambda *a: made[0] if made else made.append(ablated(*a)) or made[0])
    years = learning.ablation_by_year(spark, SMALL).toPandas()
    whole = learning.ablation(spark, SMALL).toPandas()
    keys = {(f, c, m) for f in ("lr", "gbt") for c in learning.SETS for m in learning.ABLATION_METRICS}
    assert len(whole) == len(keys) and set(zip(whole.familia, whole.conjunto, whole.metrica)) == keys
    rows = made[0].groupBy("familia", "conjunto", "ano").count().toPandas()
    assert set(zip(years.familia, years.conjunto, years.ano)) == set(zip(rows.familia, rows.conjunto, rows.ano)) and len(years) == 3 * len(rows)
    assert years.groupby(["familia", "conjunto", "metrica"]).n.sum().nunique() == 1 and set(whole.n) == {int(rows["count"].sum() / 8)}
    ref = whole[whole.conjunto == "P"].set_index(["familia", "metrica"]).valor
    for r in whole[whole.conjunto != "P"].itertuples():
        assert r.diferenca == pytest.approx(r.valor - ref[r.familia, r.metrica], abs=2e-6) and 0 < r.replicas <= 300 and r.baixo <= r.alto
