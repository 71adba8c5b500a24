"""Blocks of open buckets: the pairs that meet, and how often rows with sketches are dealt."""

import random

from riskloom.llm import ngram_join


def open_rows(spark, seed=3):
    rng = random.Random(seed)
    rows = {(b, s, s % 5 if b % 3 else s % 2) for b in range(6) for s in rng.sample(range(60), 5 + 8 * b)}
    facts = [(s, 10, bytes(8 * 4)) for s in range(60)]  # equal sketches: no pair is ruled out
    return spark.createDataFrame(sorted(rows), "bucket long, s long, part long"), spark.createDataFrame(facts, "s long, n long, sketch binary"), rows


def test_blocks_bring_all_pairs_of_components(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    open_, facts, rows = open_rows(spark)
    got = {tuple(r) for r in ngram_join.near_pairs(open_, facts, 80, False).collect()}
    expected = {(a, b) for x, a, p in rows for y, b, q in rows if x == y and a < b and p != q}
    assert got == expected


def test_sketches_travel_to_blocks_only(spark):
    open_, facts, _ = open_rows(spark)
    plan = ngram_join.near_pairs(open_, facts, 80, True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1  # members are dealt once
    assert plan.index("sketch") < plan.index("Generate") and "sketch" not in plan[plan.index("Generate") :].split("LogicalRDD")[0]


def test_copies_of_a_row_and_of_a_text_link(spark):
    words = [f"w{i}" for i in range(40)]
    one, near = " ".join(words), " ".join([*words, "more"])
    rows = [(1, one), (1, one), (2, near), (3, near), (4, "other words that nothing shares at all here"), (None, one)]
    got = ngram_join.similarity_components(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (None, None)], key=str)


def test_pairs_that_sketches_rule_out_bring_no_texts(spark):
    """Of sets of 10 shingles, linked ones differ in 2 at most: so may their sketches."""
    sketch = lambda bits: sum(1 << b for b in bits).to_bytes(ngram_join.BITS // 8)
    facts = spark.createDataFrame([(s, 10, bytearray(sketch(range(s)))) for s in (0, 1, 2, 3, 40)], "s long, n long, sketch binary")
    pairs = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (40, 0), (3, 1), (40, 3)], "a long, b long")
    assert sorted(map(tuple, ngram_join.possible(pairs, facts, 80).collect())) == [(1, 0), (2, 0), (3, 1)]


def test_pairs_that_sizes_rule_out_bring_no_texts(spark):
    """Long sets fill their sketches, which then say little; sizes that are too far apart still rule a link out."""
    full = bytearray(ngram_join.BITS // 8)
    facts = spark.createDataFrame([(1, 4000, full), (2, 3200, full), (3, 3199, full), (4, 5000, full)], "s long, n long, sketch binary")
    pairs = spark.createDataFrame([(2, 1), (3, 1), (4, 1), (4, 3)], "a long, b long")
    assert sorted(map(tuple, ngram_join.possible(pairs, facts, 80).collect())) == [(2, 1), (4, 1)]
    open_ = spark.createDataFrame([(9, s, s) for s in (1, 2, 3, 4)], "bucket long, s long, part long")
    assert {tuple(r) for r in ngram_join.near_pairs(open_, facts, 80, False).collect()} == {(1, 2), (2, 3), (1, 4)}
