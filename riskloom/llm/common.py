"""Small helpers that the text operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_ROWS = 200_000  # rows of a key from which it may count as hot
HOT_PART = 1000  # a hot key holds more than this part of all rows too, so there are fewer hot keys than this
WORD_GAP = "\\x20\\x09-\\x0D"  # the six ASCII white-space characters that part words


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is absent and the master is local, as on a laptop or in tests, a
    temporary folder is made once and stored in the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        own = tempfile.TemporaryDirectory(prefix="riskloom-")
        atexit.register(own.cleanup)
        found = f"file://{own.name}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts lineage, survives lost executors."""
    path = path or fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Remove a folder below the shared one that later steps no longer read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Written tables of one run, by name; those that later steps no longer read are removed."""

    def __init__(self, spark: SparkSession, prefix: str):
        self.spark, self.prefix, self.paths = spark, prefix, {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        self.paths[name] = path = fresh_path(self.spark, f"{self.prefix}-{name}")
        return stored(df, name, path)

    def drop(self, *names: str) -> None:
        for name in names:
            forget(self.spark, self.paths.pop(name))


def small_slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Cut batches so that long texts do not fill a worker's memory at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def sized_slices(batches: Iterable[pa.RecordBatch], column: str, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows whose texts have at most ``size`` bytes together; a longer text is a slice of its own."""
    for batch in small_slices(batches, rows):
        at = held = 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
            if i > at and held + n > size:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n
        yield batch.slice(at)


def table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table("documents")(spark, sf_dir)


def join_by_load(rows: DataFrame, facts: DataFrame, on: str | Column, load: str, total: int) -> DataFrame:
    """Inner join of rows with the one row of facts for their key, whose column ``load`` counts the key's rows.

    Hot keys' facts are broadcast, so that no task gets all rows of such a key; they are fewer
    than ``HOT_PART``, as each holds more than that part of ``total``. The others are shuffled.
    """
    limit = max(HOT_ROWS, total // HOT_PART)
    if total <= limit:  # no key can be hot
        return rows.join(facts, on)
    hot = F.broadcast(facts.where(F.col(load) > limit))
    return rows.join(hot, on).unionByName(rows.join(hot, on, "left_anti").join(facts.where(F.col(load) <= limit), on))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``(a, b)`` edges: ``(node, component)``, component the smallest node.

    Alternates neighbour minima (large-star, small-star) until no edge changes; every round
    is written to the shared folder. Rounds grow with the logarithm of a component's size. Edges
    of a hub meet its minimum by a broadcast of the hubs' minima and stay where they are.
    """
    spark = edges.sparkSession
    path = fresh_path(spark, name)
    state = lambda t: t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name, path)
    mark = state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("load")).select("u", F.least("u", "m").alias("m"), "load")
        large = join_by_load(both, low, "u", "load", 2 * mark[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small-star: each node's smaller neighbours, and the node itself, hang from the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("load"))
        small = join_by_load(large, least, "u", "load", 2 * mark[0]).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        before, path = path, fresh_path(spark, name)
        now = stored(small.where("u <> v").distinct(), name, path)
        forget(spark, before)
        seen = state(now)
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
