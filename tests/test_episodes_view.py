"""The view of episodes: what its plan carries, and the flags' order as numbers."""

from itertools import product

from conftest import SMALL
from pyspark.sql import functions as F
from riskloom.functions import codes
from riskloom.sources import episodes


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_not_sorted_and_reach_all_partitions(spark):
    df = episodes.scored(spark, SMALL).select("id", "y", "completude")
    plan = plan_of(df)
    assert "SortMergeJoin" not in plan and "Sort " not in plan and "SortAggregate" not in plan
    assert "REPARTITION_BY_NUM" in plan  # Spark does not merge these partitions into a few large tasks


def test_answers_are_told_where_they_are_used(spark):
    df = episodes.scored(spark, SMALL).select("id", "completude", "padrao", "faixa", "idade")
    carried = df._jdf.queryExecution().optimizedPlan().toString()
    assert " AS c1#" not in carried and " AS s1#" not in carried


def test_least_flag_is_that_of_least_number(spark):
    flags = ["", "0", "A", "AA", "B", "N", "R", "RR", "S", "a", "é", None]
    rows = [(i, f) for i, pair in enumerate(product(flags, flags)) for f in pair]
    got = spark.createDataFrame(rows, "i int, f string").groupBy("i").agg(F.min("f").alias("f"), F.min(episodes._flag(F.col("f"))).alias("n"))
    assert all((r["f"] == "A") == (r["n"] == episodes.FLAG_A) and (r["f"] == "R") == (r["n"] == episodes.FLAG_R) for r in got.collect())


def test_answers_with_margins_and_shares(spark):
    cells = ["1", "2", "9", " 1\t", "　2", "12", "", " ", "é", None]
    rows = spark.createDataFrame([(a, b, c) for a, b, c in product(cells, cells, cells)], "a string, b string, c string")
    of = [F.col(c) for c in "abc"]
    for r in rows.select("*", codes.completeness(of).alias("p")).collect():
        given = sum(x is not None and x.strip() in ("1", "2") for x in (r["a"], r["b"], r["c"]))
        assert r["p"] == (0.0, 33.333333, 66.666667, 100.0)[given]
    shares = spark.range(1).select(*(F.round(F.lit(100.0) * F.lit(n) / 24, 6).alias(f"r{n}") for n in range(25)), *(codes.completeness([F.lit("1" if i < n else None) for i in range(24)]).alias(f"c{n}") for n in range(25))).first()
    assert all(shares[f"r{n}"] == shares[f"c{n}"] for n in range(25))


def test_scores_wide_deals_episodes_once_to_all_partitions(spark):
    from riskloom.plans import registry

    plan = plan_of(registry.QUERIES["scores_wide"](spark, SMALL))
    top = plan[: plan.index("ShuffledHashJoin")]
    assert top.count("Exchange") == 1 and "REPARTITION_BY_NUM" in top and top.index("Generate") < top.index("Exchange")
