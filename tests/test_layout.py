"""Tables laid out by group, and manifests kept by block."""

import re

from pyspark.sql import functions as F

from riskloom.operators import blocks
from riskloom.sources import io


def plan_of(df) -> str:
    df.collect()
    return re.sub(r"(?s)== Initial Plan ==.*?(?=\n\S|\Z)", "", df._jdf.queryExecution().executedPlan().toString())


def test_groups_that_lie_together_are_not_shuffled(spark):
    rows = spark.range(2000).select((F.col("id") % 300).cast("string").alias("grupo"), (F.col("id") % 7).cast("int").alias("ano"), (F.col("id") % 2).cast("int").alias("y"), F.lit("r").alias("regiao"), "id")
    laid = io.stored_by(rows, "grupo", "grupos", 4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ok, bad = blocks.quarantine(laid, "grupo", ["ano", "y", "regiao"])
        for df in (ok, bad, blocks.crossing(laid, "ano"), blocks.spanning(laid, "grupo", ["ano"])):
            assert "Exchange hashpartitioning(grupo" not in plan_of(df)
        plain, _ = blocks.quarantine(rows, "grupo", ["ano", "y", "regiao"])
        assert "Exchange hashpartitioning(grupo" in plan_of(plain)
        assert sorted(r["id"] for r in ok.collect()) == sorted(r["id"] for r in plain.collect()) and laid.count() == 2000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_manifests_by_block(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.range(90).select("id", (F.col("id") % 3).cast("string").alias("particao"))
    io.write_blocks(rows, path)
    known = io.stored(io.block_manifest(spark, path), "manifest")
    assert known.count() == 3 and known.agg(F.sum("linhas")).first()[0] == 90
    assert tuple(io.combined_manifest(known).first()) == tuple(io.fingerprint(spark.read.parquet(path)).first())
    assert io.changed_blocks(spark, path, known) == {}
    for b, more in (("1", 1), ("2", 0)):  # one block with another row, one written anew as it was, one not touched
        spark.range(90 + 3 * more).where(F.col("id") % 3 == int(b)).select("id").write.mode("overwrite").parquet(f"{path}/particao={b}")
    spark.range(5).write.parquet(f"{path}/particao=9")
    assert io.changed_blocks(spark, path, known) == {"1": "alterado", "9": "novo"}
    again = io.refreshed_manifest(spark, path, known)
    assert {r["bloco"]: r["linhas"] for r in again.collect()} == {"0": 30, "1": 31, "2": 30, "9": 5}
    assert tuple(io.combined_manifest(again).first()) == tuple(io.fingerprint(spark.read.parquet(path)).first())
    # the block whose files did not change is not read: its row comes from the known manifest
    forged = known.withColumn("linhas", F.when(F.col("bloco") == "0", -1).otherwise(F.col("linhas")))
    assert {r["bloco"]: r["linhas"] for r in io.refreshed_manifest(spark, path, forged).collect()}["0"] == -1
    import shutil

    shutil.rmtree(tmp_path / "t" / "particao=0")
    assert io.changed_blocks(spark, path, known)["0"] == "ausente" and io.combined_manifest(known.limit(0)).first()["linhas"] == 0
