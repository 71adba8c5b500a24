"""Keys that hold a large part of all rows, and slices of long texts."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from riskloom.llm import common, site_quality, token_orc


def smallest(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in list(up)}


def test_components_with_hubs(spark, monkeypatch):
    rng = random.Random(5)
    edges = [(500, x) for x in range(400, 600)] + [(7, x) for x in range(1000, 1100)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(40)] + [(3000 + i, 3001 + i) for i in range(30)]
    table = spark.createDataFrame(edges, "a long, b long")
    want = {k: v for k, v in smallest([e for e in edges if e[0] != e[1]]).items()}
    for rows in (10**6, 8):
        monkeypatch.setattr(common, "HOT_ROWS", rows)
        assert {r["node"]: r["component"] for r in common.components(table).collect()} == want
    monkeypatch.setattr(common, "HOT_ROWS", 8)
    assert common.components(table.limit(0)).count() == 0


def test_hot_keys_are_broadcast_and_the_join_is_the_same(spark, monkeypatch):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 2 == 0, (F.col("id") % 50).cast("string")).alias("host"))
    facts = rows.groupBy("host").agg(F.count("*").alias("n")).withColumnRenamed("host", "h")
    same = F.col("host").eqNullSafe(F.col("h"))
    for bound in (10**6, 300):
        monkeypatch.setattr(common, "HOT_ROWS", bound)
        met = common.join_by_load(rows, facts, same, "n", 3000)
        assert met.count() == 3000 and met.where("not host <=> h").isEmpty()
        assert {(r["h"], r["n"]) for r in met.select("h", "n").distinct().collect()} == {tuple(r) for r in facts.collect()}


def test_site_quality_with_a_hot_site(spark, monkeypatch):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of text "), F.col("id") % 7).alias("text"), F.when(F.col("id") % 3 > 0, F.lit("hot")).alias("source"), F.when(F.col("id") % 2 > 0, F.lit("en")).alias("lang"))
    labels = spark.range(600).select(F.col("id").alias("doc_id"), (F.col("id") % 7 > 2).cast("int").alias("quality"))
    found = []
    for bound in (10**6, 50):
        monkeypatch.setattr(common, "HOT_ROWS", bound)
        out = site_quality.classify(docs, labels, F.col("source"), F.col("lang")).toPandas().sort_values("doc_id")
        found.append(out.drop(columns="kept").to_numpy(float))
    assert len(found[0]) == 600 and np.allclose(found[0], found[1])


def test_slices_are_bounded_by_rows_and_bytes(spark, monkeypatch):
    batch = pa.record_batch({"i": list(range(8)), "text": ["a" * 50, None, "", "b" * 200, "c" * 60, "d" * 60, "é" * 20, "x"]})
    got = [x.to_pydict() for x in common.sized_slices([batch], "text", 4, 100)]
    assert [x["i"] for x in got] == [[0, 1, 2], [3], [4], [5, 6], [7]]
    assert sum((x["text"] for x in got), []) == batch.to_pydict()["text"]
    docs = spark.createDataFrame([(i, None if i % 9 == 0 else f"word {i} " * (i % 40)) for i in range(300)], "doc_id long, text string")
    want = sorted(map(tuple, token_orc.round_trip(docs).collect()))
    monkeypatch.setattr(token_orc, "SLICE_BYTES", 64)
    assert sorted(map(tuple, token_orc.round_trip(docs).collect())) == want
