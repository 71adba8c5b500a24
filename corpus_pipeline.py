"""A corpus pipeline: each stage takes what the one before kept, written as Parquet.

1. toxicity: texts that the model, trained on the labelled rows not held out, scores 0.5 or more go;
2. near_duplicates: of each group of linked shingle sets the smallest id stays;
3. decontamination: texts that hold a benchmark item go;
4. mixture: texts are repeated or left out as the mix of sources takes their words;
5. token_ids: what is left is encoded into ORC files, which are read back.

Defined cases: rows without an id stay in stages 2 and 3, which decide by id; rows of one id go
together there and are told apart by all their columns in stages 1 and 4; texts that are null or have no words
stay, once; empty tables give empty results; columns other than those of documents are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import decontaminate, mixing, ngram_join, token_orc, toxicity
from riskloom.llm.common import documents, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


PAGE = 32768  # bits of a map, as Spark's bitmap functions hold them
MAP_BITS = 16  # for each id
MOST_PAGES = 16384  # 64 MB; with more ids than fit, more rows are joined


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose id is not in gone; rows without an id stay.

    Rows whose id has no bit in a map of those that go stay where they are; only those that go and a few that have
    a bit by chance, a sixteenth, are shuffled to the ids themselves.
    """
    ids = stored(gone.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct(), "pipeline-gone")
    pages = max(1, min(MOST_PAGES, ids.count() * MAP_BITS // PAGE + 1))
    bit = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(pages * PAGE))
    page, place = F.floor(bit / PAGE).cast("int"), (bit % PAGE).cast("int")
    maps = ids.groupBy(page.alias("page")).agg(F.bitmap_construct_agg(place).alias("map"))
    byte = F.conv(F.hex(F.substring("map", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    told = docs.select(*COLUMNS).withColumn("page", page).join(F.broadcast(maps), "page", "left")
    told = told.withColumn("met", F.col("doc_id").isNotNull() & F.coalesce(F.getbit(byte, place % 8) == 1, F.lit(False)))
    return told.where("not met").select(*COLUMNS).unionByName(told.where("met").join(ids, "doc_id", "left_anti").select(*COLUMNS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(documents(spark, sf_dir), table("labels")(spark, sf_dir))
    return toxicity.score(docs.select(*COLUMNS), model).where("toxic_score < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, ngram_join.similarity_components(docs).where("doc_id <> component_id"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, decontaminate.leaks(docs, table("benchmark")(spark, sf_dir)))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A text comes as often as its words are taken, rounded to whole texts; one without words stays once.

    Texts stay where they are, but for those at a source's edge: their uses are told from sizes and joined to them.
    """
    sized = docs.select(*COLUMNS, F.array("source").alias("sources"), mixing.word_count().alias("size"))
    held = mixing.loads(sized, "sources")
    whole, edge = mixing.parted(sized, "sources", {name: int(a) for name, _, a in mixing.aims(held)}, held)
    uses = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(1).cast("int")
    keyed = edge.withColumn("row", F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in COLUMNS))).withColumn("id", F.coalesce("doc_id", F.lit(-1)))
    told = mixing.dealt(keyed.drop("text", "lang", "n_chars")).groupBy("row", "id").agg(F.sum(uses).alias("uses"))
    rows = keyed.join(told, ["row", "id"]).dropDuplicates(["row", "id"])  # equal rows are one row with the uses of all
    rows = whole.withColumn("uses", uses).select(*COLUMNS, "uses").unionByName(rows.select(*COLUMNS, "uses"))
    return rows.select(*COLUMNS, F.explode(F.when(F.col("uses") > 0, F.sequence(F.lit(1), F.col("uses").cast("int")))).alias("use")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_orc.round_trip(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixture", mix),
    ("token_ids", encode),
]

ORACLE_SQL = None  # the toxicity model is trained


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
