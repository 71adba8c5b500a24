"""Reading and publishing tables: sealed blocks, checks, manifests, round trips."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN_BLOCKS = ("train_ref", "val_ref")
SEALED_BLOCKS = ("test_ref", "test_pandemic")
# Columns known only after the outcome
LEAKING = ("evolucao", "dt_evoluca", "dt_encerra", "uti", "utilizouvni", "suport_ven", "antiviral", "antivirais", "classificacao_final", "cluster", "cluster_rotulo")


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of the session, or in a temporary one where none is set and the master is local."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not top:
        own = tempfile.TemporaryDirectory(prefix="riskloom-")
        atexit.register(own.cleanup)
        top = f"file://{own.name}"
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several jobs read, and read it back."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, key: str, name: str, buckets: int | None = None) -> DataFrame:
    """Write a table in buckets of a key, each sorted by it, and read it back: what follows by that key needs no shuffle.

    The files lie in the shared folder; the name stands in the session's catalog.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = folder(spark, name)
    table = f"{name}_{path.rpartition('-')[2]}"
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(table)
    return spark.table(table)


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, where=None) -> DataFrame:
    """Columns and rows of a Parquet table; both reach the scan."""
    df = spark.read.parquet(path)
    df = df.where(where) if where is not None else df
    return df.select(*columns) if columns else df


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if len(df.columns) != len(set(df.columns)):
        raise ValueError("a column name repeats")
    return df


def free_targets(df: DataFrame, derived: list[str]) -> DataFrame:
    """Derived columns must not collide with columns that are there, nor with each other."""
    if bad := sorted({c for c in derived if c in df.columns or derived.count(c) > 1}):
        raise ValueError(f"columns would collide: {bad}")
    return df


def needed_columns(features: dict[str, list[str]], audit: list[str]) -> list[str]:
    """Physical columns behind features and audit columns, each once, in order."""
    return list(dict.fromkeys([c for sources in features.values() for c in sources] + audit))


def profile(df: DataFrame, sample: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows and columns, types by column, some rows)."""
    types = df.sparkSession.createDataFrame([(i + 1, c, t) for i, (c, t) in enumerate(df.dtypes)], "ordem int, coluna string, tipo string")
    return df.agg(F.count("*").alias("linhas"), F.lit(len(df.columns)).alias("colunas")), types, df.limit(sample)


def presence(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    rows = [(g, c, c in df.columns) for g, cs in groups.items() for c in cs]
    return df.sparkSession.createDataFrame(rows, "grupo string, coluna string, existe boolean")


class LeakageError(ValueError):
    """A feature that is known only after the outcome."""


def guard(columns: list[str], forbidden: list[str], numeric: list[str], categorical: list[str]) -> None:
    """Features are complete, disjoint and free of columns known only after the outcome."""
    if bad := sorted(set(columns) & {*forbidden, *LEAKING}):
        raise LeakageError(f"leaking columns: {bad}")
    if set(numeric) & set(categorical) or set(numeric) | set(categorical) != set(columns):
        raise ValueError("numeric and categorical columns must part the features")


def time_risk(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns known only after the admission, when they become known, and whether the table has them."""
    rows = [(c, moment, c in df.columns) for c, moment in columns.items()]
    return df.sparkSession.createDataFrame(rows, "coluna string, momento string, presente boolean")


def write_blocks(df: DataFrame, path: str, block: str = "particao", overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").option("compression", "zstd").partitionBy(block).parquet(path)


def read_blocks(spark: SparkSession, path: str, blocks: tuple[str, ...] = OPEN_BLOCKS, unsealed: tuple[str, ...] = (), block: str = "particao") -> DataFrame:
    """Rows of the blocks named; a sealed one must be unsealed by name, and each must be there."""
    if shut := [b for b in blocks if b in SEALED_BLOCKS and b not in unsealed]:
        raise PermissionError(f"sealed: {shut}")
    if unknown := [b for b in blocks if b not in OPEN_BLOCKS + SEALED_BLOCKS]:
        raise ValueError(f"unknown: {unknown}")
    df = spark.read.parquet(path)
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = {f.getPath().getName().partition("=")[2] for f in top.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(top)}  # a folder a block
    if absent := [b for b in blocks if b not in there]:
        raise ValueError(f"absent: {absent}")
    return df.where(F.col(block).isin(*blocks))


def roles(df: DataFrame, of: dict[str, tuple[str, ...]], block: str = "particao") -> dict[str, DataFrame]:
    out = {role: df.where(F.col(block).isin(*blocks)) for role, blocks in of.items()}
    if empty := [r for r, d in out.items() if d.isEmpty()]:
        raise ValueError(f"empty roles: {empty}")
    return out


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-free fingerprint of the contents."""
    h = F.xxhash64(*sorted(df.columns))
    return df.agg(F.count("*").alias("linhas"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("impressao"), F.sum(F.shiftright(h, 20)).alias("soma"))


def manifest(df: DataFrame, name: str, seed: str, block: str | None = None) -> DataFrame:
    """One row: size, types and fingerprint of a table, and the rows of each block."""
    types = F.array(*(F.struct(F.lit(c).alias("coluna"), F.lit(t).alias("tipo")) for c, t in df.dtypes))
    out = fingerprint(df).select(F.lit(name).alias("nome"), F.lit(seed).alias("semente"), "linhas", F.lit(len(df.columns)).alias("colunas"), types.alias("tipos"), "impressao", "soma")
    if not block:
        return out
    counts = df.groupBy(block).agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.struct(F.col(block).alias("bloco"), "n"))).alias("blocos"))
    return out.crossJoin(F.broadcast(counts))  # one row each


def _block_files(spark: SparkSession, path: str, block: str) -> dict[str, str]:
    """Of each block's folder, a digest of its files' names, sizes and times; no file is opened."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found = {}
    for f in fs.listStatus(top):
        kind, _, value = f.getPath().getName().partition("=")
        if kind == block:
            files = sorted((x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in fs.listStatus(f.getPath()))
            found[value] = hashlib.sha256(repr(files).encode()).hexdigest()
    return found


def _block_prints(spark: SparkSession, path: str, block: str, files: dict[str, str]) -> DataFrame:
    """``bloco, linhas, impressao, soma, arquivos`` of the blocks named in files."""
    names = spark.createDataFrame(sorted(files.items()), "bloco string, arquivos string")
    df = spark.read.parquet(path)
    h = F.xxhash64(*sorted(df.columns))
    own = df.where(F.col(block).cast("string").isin(*files)) if files else df.limit(0)
    per = own.groupBy(F.col(block).cast("string").alias("bloco")).agg(F.count("*").alias("linhas"), F.bit_xor(h).alias("impressao"), F.sum(F.shiftright(h, 20)).alias("soma"))
    return names.join(per, "bloco", "left").select("bloco", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("linhas", "impressao", "soma")), "arquivos")


def block_manifest(spark: SparkSession, path: str, block: str = "particao") -> DataFrame:
    """A row for each block of a table partitioned by it: rows, fingerprint and its files' state."""
    return _block_prints(spark, path, block, _block_files(spark, path, block))


def combined_manifest(blocks: DataFrame) -> DataFrame:
    """The table's fingerprint from its blocks', equal to ``fingerprint`` of the whole."""
    return blocks.agg(F.coalesce(F.sum("linhas"), F.lit(0)).alias("linhas"), F.coalesce(F.bit_xor("impressao"), F.lit(0)).alias("impressao"), F.sum("soma").alias("soma"))


def changed_blocks(spark: SparkSession, path: str, known: DataFrame, block: str = "particao") -> dict[str, str]:
    """Blocks that came, went or whose contents changed since a manifest: block to ``novo``, ``ausente`` or ``alterado``.

    Only blocks whose files changed are read; one written anew with the same rows is not named.
    """
    old = {r["bloco"]: r for r in known.collect()}  # a row a block
    now = _block_files(spark, path, block)
    out = {b: "novo" for b in now if b not in old} | {b: "ausente" for b in old if b not in now}
    touched = {b: f for b, f in now.items() if b in old and f != old[b]["arquivos"]}
    if touched:
        for r in _block_prints(spark, path, block, touched).collect():
            if any(r[c] != old[r["bloco"]][c] for c in ("linhas", "impressao", "soma")):
                out[r["bloco"]] = "alterado"
    return out


def refreshed_manifest(spark: SparkSession, path: str, known: DataFrame, block: str = "particao") -> DataFrame:
    """The manifest of now: blocks whose files are those of the known one keep its rows, the others are read."""
    now = _block_files(spark, path, block)
    same = spark.createDataFrame(sorted(now.items()), "bloco string, arquivos string")
    kept = known.join(F.broadcast(same), ["bloco", "arquivos"], "left_semi").select("bloco", "linhas", "impressao", "soma", "arquivos")  # a row a block
    names = {r["bloco"] for r in kept.select("bloco").collect()}
    return kept.unionByName(_block_prints(spark, path, block, {b: f for b, f in now.items() if b not in names}))


def read_checked(spark: SparkSession, path: str, manifest_path: str) -> DataFrame:
    """A table whose contents still have the fingerprint of its manifest, a JSON row."""
    df, known = spark.read.parquet(path), spark.read.json(manifest_path).select("linhas", "impressao", "soma").first()
    if tuple(fingerprint(df).first()) != tuple(known):
        raise ValueError(f"{path} is not the table of its manifest")
    return df


def write_csv(df: DataFrame, path: str, gzip: bool = False, overwrite: bool = False) -> None:
    df.coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("compression", "gzip" if gzip else "none").csv(path)  # reports are small


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def one_to_one(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    for side in (left, right):
        if not side.groupBy(*on).count().where("count > 1").isEmpty():
            raise ValueError(f"{on} repeats")
    return left.join(right, on, how)


def first_rows(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row of each key, the first in a stated order."""
    columns = [c for c in df.columns if c not in keys]
    rows = df.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order, *columns)).alias("_r"))
    return rows.select(*keys, "_r.*")


def many_to_one(left: DataFrame, right: DataFrame, on: list[str], *order, needed: list[str] = ()) -> DataFrame:
    """Left join to the first right row of each key; columns that every left row needs may not be null."""
    out = left.join(first_rows(right, on, *order), on, "left")
    if needed and not out.where(" or ".join(f"{c} is null" for c in needed)).isEmpty():
        raise ValueError(f"rows without {list(needed)}")
    return out


def failing(checks: DataFrame) -> DataFrame:
    """The checks themselves; an error that names those that do not hold."""
    if failed := [r["verificacao"] for r in checks.where("not ok").collect()]:
        raise ValueError(f"failed: {failed}")
    return checks


def published_checks(df: DataFrame, key: str, violations, domain: tuple, target: str) -> DataFrame:
    """``(verificacao, observado, ok)`` of a table before it is published."""
    bad_target = ~F.coalesce(F.col(target).isin(*domain), F.lit(False))
    one = df.agg(F.count("*").alias("linhas"), F.sum(F.col(key).isNull().cast("long")).alias("chave_nula"), (F.count(key) - F.count_distinct(key)).alias("chave_repetida"), F.sum(violations.cast("long")).alias("violacoes"), F.sum(bad_target.cast("long")).alias("fora_do_dominio"))
    long = one.unpivot([], one.columns, "verificacao", "observado")
    return long.withColumn("ok", F.when(F.col("verificacao") == "linhas", F.col("observado") > 0).otherwise(F.coalesce("observado", F.lit(0)) == 0))


def _commit(spark: SparkSession, staging: str, path: str) -> None:
    """Give a written folder its published name; an error if the name is taken."""
    old, new = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (staging, path))
    fs = new.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(new) or not fs.rename(old, new):
        raise FileExistsError(path)


def _discard(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def publish(df: DataFrame, staging: str, path: str, check) -> DataFrame:
    """Write aside, check what is read back, then rename it to the published path; a failing check leaves neither."""
    spark = df.sparkSession
    df.write.mode("overwrite").option("compression", "zstd").parquet(staging)
    try:
        failing(check(spark.read.parquet(staging)))
        _commit(spark, staging, path)
    except Exception:
        _discard(spark, staging)
        raise
    return spark.read.parquet(path)


def publish_observed(spark: SparkSession, build, path: str, key: str, violations, domain: tuple, target: str) -> tuple[DataFrame, DataFrame]:
    """Write a table and check it in the same pass: ``(table, checks)``, the checks those of ``published_checks``.

    ``build`` makes the table in the session that it is given, one of its own: a session that has observed a query can
    no longer be sent with the closures that some of Spark's models hold. Rows are dealt by key, so that a repeated one stands beside the first; sums that Spark observes while it writes tell
    the rest. The folder gets its published name by a rename once all checks hold; else an error names those that fail
    and no folder is left. Tasks that run again could be observed twice, so the rows seen must be the rows written.
    """
    df = build(spark.newSession())
    again = F.row_number().over(W.partitionBy(key).orderBy(key)) > 1
    bad_target = ~F.coalesce(F.col(target).isin(*domain), F.lit(False))
    seen = Observation()
    flags = {"chave_nula": F.col(key).isNull(), "chave_repetida": F.col(key).isNotNull() & F.col("_again"), "violacoes": F.coalesce(violations, F.lit(False)), "fora_do_dominio": bad_target}
    rows = df.withColumn("_again", again).observe(seen, F.count(F.lit(1)).alias("linhas"), *(F.count_if(c).alias(name) for name, c in flags.items())).drop("_again")
    staging = f"{path}.{uuid.uuid4().hex}"
    try:
        rows.write.option("compression", "zstd").parquet(staging)
        found = {c: seen.get[c] for c in ("linhas", *flags)}
        if (written := spark.read.parquet(staging).count()) != found["linhas"]:  # from the files' footers
            raise ValueError(f"{written} rows written, {found['linhas']} seen")
        checks = spark.createDataFrame([(c, n, n > 0 if c == "linhas" else n == 0) for c, n in found.items()], "verificacao string, observado long, ok boolean")
        failing(checks)
        _commit(spark, staging, path)
    except Exception:
        _discard(spark, staging)
        raise
    return spark.read.parquet(path), checks
