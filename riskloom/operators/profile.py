"""Profiles of wide tables: fill, cardinality, frequencies, duplicates, crosstabs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def long_form(row: DataFrame, names: list[str], value: str, key: str = "coluna") -> DataFrame:
    """Columns of an aggregate as rows."""
    keep = [c for c in row.columns if c not in names]
    return row.unpivot(keep, names, key, value)


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    one = df.agg(F.count("*").alias("_n"), *(F.count(c).alias(c) for c in columns))
    return long_form(one, columns, "presentes").select("coluna", "presentes", (F.col("_n") - F.col("presentes")).alias("ausentes"), F.round(100 * F.try_divide(F.col("_n") - F.col("presentes"), F.col("_n")), 6).alias("pct_ausente"))


def fill_by(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    rows = df.groupBy(key).agg(*(F.round(100 * F.count(c) / F.count("*"), 6).alias(c) for c in columns))
    return long_form(rows, columns, "pct")


def fill_amplitude(filled: DataFrame, key: str) -> DataFrame:
    return filled.groupBy("coluna").agg(F.round(F.max("pct") - F.min("pct"), 6).alias("amplitude"), F.count(key).alias("anos"))


def cardinality(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    one = df.agg(*(F.struct(count(c).alias("d"), (F.count("*") > F.count(c)).cast("long").alias("null")).alias(c) for c in columns))
    rows = long_form(one, columns, "v")
    return rows.select("coluna", F.col("v.d").alias("distintos"), (F.col("v.d") + F.col("v.null")).alias("distintos_com_nulo"))


LG_CELLS = 12  # 2 ** 12 cells of a sketch: a standard error of about 1.6 %


def cardinality_sketches(df: DataFrame, columns: list[str], keys: list[str] = (), lg_cells: int = LG_CELLS) -> DataFrame:
    """``keys, coluna, nulos, esboco``: a HyperLogLog sketch of each column's values, to be stored and united later."""
    per = df.groupBy(*keys).agg(*(F.struct(F.count_if(F.col(c).isNull()).alias("nulos"), F.hll_sketch_agg(F.col(c).cast("string"), F.lit(lg_cells)).alias("esboco")).alias(c) for c in columns))
    return long_form(per, columns, "v").select(*keys, "coluna", "v.nulos", "v.esboco")


def united_cardinality(sketches: DataFrame, keys: list[str] = ()) -> DataFrame:
    """``keys, coluna, distintos, distintos_com_nulo`` estimated from stored sketches, of any finer keys."""
    per = sketches.groupBy(*keys, "coluna").agg(F.hll_sketch_estimate(F.hll_union_agg("esboco")).alias("distintos"), F.max((F.col("nulos") > 0).cast("long")).alias("_null"))
    return per.select(*keys, "coluna", "distintos", (F.col("distintos") + F.col("_null")).alias("distintos_com_nulo"))


def frequencies(df: DataFrame, columns: list[str], most: int = 30) -> DataFrame:
    """Counts of each value, null kept, of the columns with few values."""
    rows = df.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], columns, "coluna", "valor")
    counts = rows.groupBy("coluna", "valor").agg(F.count("*").alias("n"))
    per = counts.groupBy("coluna").agg(F.count("*").alias("valores"), F.sum("n").alias("total")).where(F.col("valores") <= most)
    return counts.join(per, "coluna").select("coluna", "valor", "n", F.round(100 * F.col("n") / F.col("total"), 6).alias("pct"))


def duplicate_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    per = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("linhas"), F.count("*").alias("chaves"), F.sum((F.col("n") > 1).cast("long")).alias("chaves_repetidas"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("linhas_repetidas"))


def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    many = df.groupBy(*keys).agg(F.count("*").alias("vezes")).where("vezes > 1")
    return df.join(many, keys)


def crosstab_pct(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Shares of each row value within each column value."""
    wide = df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)
    totals = wide.agg(*(F.sum(str(v)).alias(f"t_{v}") for v in values))
    return wide.crossJoin(F.broadcast(totals)).select(row, *(F.round(100 * F.try_divide(F.col(str(v)), F.col(f"t_{v}")), 6).alias(str(v)) for v in values))


def group_summary(df: DataFrame, key: str, y: str, year: str, group: str) -> DataFrame:
    per = df.groupBy(key).agg(F.count("*").alias("n"), F.sum(y).alias("positivos"), F.round(F.avg(y), 9).alias("prevalencia"), F.min(year).alias("ano_min"), F.max(year).alias("ano_max"), F.count_distinct(group).alias("grupos"))
    total = per.agg(F.sum("n").alias("t"))
    return per.crossJoin(F.broadcast(total)).withColumn("pct", F.round(100 * F.col("n") / F.col("t"), 6)).drop("t")


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def best_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key, in an order that has no ties."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
