"""Each stage of the pipeline against a plain computation on a small corpus with odd rows."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))
import corpus_pipeline  # noqa: E402

from riskloom.llm import decontaminate, mixing, ngram_join, token_orc, toxicity  # noqa: E402

SMALL = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    text = docs.where("n_chars > 400").first()["text"]
    odd = [(90001, text, "en", "a", 1), (90001, text, "en", "a", 1), (90002, None, None, None, None), (90003, "", "en", "a", 0), (None, text + " tail", "en", "a", 2), (90004, text + " other end", None, "b", 3), (90005, "tie", "en", "b", 3), (90005, "tie too", "en", "b", 3)]
    return docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("row", F.lit("clash")).withColumn("use", F.lit(1)).withColumn("id", F.lit(7))


def rows(df):
    return sorted(map(tuple, df.select(*corpus_pipeline.COLUMNS).collect()), key=repr)


def test_toxicity_stage(spark, corpus):
    model = toxicity.train(*(spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels")))
    weight = dict(zip(model[0].tolist(), model[1].tolist()))
    cells = toxicity.Cells()
    want = [r for r in rows(corpus) if not weight or model[2] + sum(weight.get(c, 0) for c in cells.of(r[1])) < 0]
    got = STAGES["toxicity"](spark, corpus, SMALL)
    assert got.columns == list(corpus_pipeline.COLUMNS) and rows(got) == want


def test_near_duplicate_stage(spark, corpus):
    all_rows = rows(corpus)
    sets: dict = {}
    for r in all_rows:
        if r[0] is not None:
            sets.setdefault(r[0], []).append(ngram_join.shingle_set(ngram_join.words_of(r[1]), 5))
    linked = lambda a, b: any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b])
    part = {i: i for i in sets}
    edges = [(a, b) for a in sets for b in sets if a < b and linked(a, b)]
    for _ in edges:
        for a, b in edges:
            part[a] = part[b] = min(part[a], part[b])
    assert rows(STAGES["near_duplicates"](spark, corpus, SMALL)) == [r for r in all_rows if r[0] is None or part[r[0]] == r[0]]


def test_decontamination_stage(spark, corpus):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    gone = {r["doc_id"] for r in decontaminate.leaks(corpus, bench).collect()}
    texts = [b["text"] for b in bench.collect()]
    got = rows(STAGES["decontamination"](spark, corpus, SMALL))
    assert got == [r for r in rows(corpus) if r[0] not in gone or r[0] is None]
    assert not any(t in (r[1] or "") for r in got if r[0] is not None for t in texts if len(t.split()) > 12)


def test_mixture_stage(spark, corpus):
    taken = mixing.mix_sources(corpus.select(*corpus_pipeline.COLUMNS), "text", "lang", "n_chars", "source").collect()
    want = []
    for r in taken:
        n = int(r["taken"] / r["size"] + 0.5) if r["size"] else 1
        want += [tuple(r[c] for c in corpus_pipeline.COLUMNS)] * n
    assert rows(STAGES["mixture"](spark, corpus, SMALL)) == sorted(want, key=repr)


def test_token_stage(spark, corpus):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_orc.vocabulary())
    got = STAGES["token_ids"](spark, corpus, SMALL)
    want = sorted((r[0] if r[0] is not None else -1, len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in rows(corpus))
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"]) for r in got.collect()) == want


def test_stages_on_empty_tables(spark, corpus):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, corpus.limit(0), SMALL).count() == 0, name


def test_the_whole_run_applies_the_stages_in_order(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    key = ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, docs.select(key).collect())) == sorted(map(tuple, corpus_pipeline.run(spark, SMALL).select(key).collect()))


def test_mixture_moves_no_text_but_at_edges(spark):
    """Texts meet one row a source by broadcast; only a bucket in 4096 is ordered: disk of the pipeline."""
    docs = spark.createDataFrame([(i, f"w{i} " * (1 + i % 7), "en", "ab"[i % 2], 3) for i in range(500)], "doc_id long, text string, lang string, source string, n_chars long")
    sized = docs.select(*corpus_pipeline.COLUMNS, F.array("source").alias("sources"), mixing.word_count().alias("size"))
    held = mixing.loads(sized, "sources")
    whole, edge = mixing.parted(sized, "sources", {"a": 700, "b": 300}, held)
    moved = [line for line in whole._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line or "SortMergeJoin" in line]
    assert not any("text" in line for line in moved) and "BroadcastHashJoin" in whole._jdf.queryExecution().executedPlan().toString()
    assert whole.count() + edge.count() == 500 and 0 < edge.count() < 5
    rows = whole.unionByName(mixing.dealt(edge)).collect()
    assert sum(r["taken"] for r in rows if r["source"] == "a") == 700 and sum(r["taken"] for r in rows if r["source"] == "b") == 300


def test_rows_that_stay_are_not_shuffled(spark):
    """Only rows that have a bit in the map of ids that go are joined to them; no id is let go by its bit."""
    ids = [None, 0, -1, -5, 2**62, *range(1, 4000)]
    docs = spark.createDataFrame([(i, f"t{i}", "en", "a", 1) for i in ids], "doc_id long, text string, lang string, source string, n_chars long")
    out = [-5, 2**62, *range(3, 4000, 7), *range(10**6, 10**6 + 50)]
    gone = spark.createDataFrame([(i,) for i in [*out, *out, None]], "doc_id long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = corpus_pipeline.without(docs, gone)
        stay, joined = got._jdf.queryExecution().optimizedPlan().toString().split("Join LeftAnti")
        assert stay.count("Join LeftOuter") == 1 and "rightHint=(strategy=broadcast)" in stay
        met = [line for line in joined.splitlines() if "Filter" in line and "getbit" in line.lower() or "bit_get" in line.lower()]
        assert met and sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in got.collect()) == sorted((i is not None, i or 0) for i in ids if i not in set(out))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
