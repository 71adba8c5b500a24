"""Standardised ratios and means by outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.evaluate import levels, quantile_edges
from riskloom.sources import io


def age_standardised(df: DataFrame, stratum: str, band: str = "faixa", y: str = "y", old=("60-79", "80+")) -> DataFrame:
    """Crude and indirectly standardised ratios of each stratum: observed to expected at the rates of all bands."""
    rates = df.groupBy(band).agg(F.avg(y).alias("taxa"))
    sizes = df.groupBy(stratum, band).agg(F.count("*").alias("n"), F.sum(y).alias("obs"))
    per = sizes.join(rates, band).groupBy(stratum).agg(F.sum("n").alias("n"), F.sum("obs").alias("observados"), F.round(F.sum(F.col("n") * F.col("taxa")), 6).alias("esperados"), F.round(100 * F.sum(F.when(F.col(band).isin(*old), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("pct_60"))
    return per.withColumn("bruta", F.round(F.col("observados") / F.col("n"), 6)).withColumn("padronizada", F.round(F.try_divide(F.col("observados").cast("double"), F.col("esperados")), 4))


def means_by_outcome(df: DataFrame, value: str, band: str = "faixa", y: str = "y") -> DataFrame:
    """Mean of a value by outcome for each band and for all."""
    of = lambda v: F.when(F.col(y) == v, F.col(value))
    per = df.groupBy(band).agg(F.count("*").alias("n"), *(c for v in (1, 0) for c in (F.sum(of(v)).alias(f"s{v}"), F.count(of(v)).alias(f"n{v}"))))  # rows are read once, then bands
    mean = lambda v: F.round(F.try_divide(F.sum(f"s{v}"), F.sum(f"n{v}")), 5).alias(f"media_{v}")
    out = per.groupingSets([[F.col(band)], []], F.col(band)).agg(F.grouping(band).alias("g"), F.sum("n").alias("n"), mean(1), mean(0))
    return out.select(F.when(F.col("g") == 1, "todos").otherwise(F.col(band)).alias(band), F.coalesce("n", F.lit(0)).alias("n"), "media_1", "media_0")


def terciles(df: DataFrame, value: str) -> DataFrame:
    """Least and largest value and size of each tercile; equal edges are one, ties stay together."""
    lv = io.stored(levels(df.select(F.col(value).cast("double").alias("p"), F.lit(0).alias("y"))), "levels")
    place = F.size(F.filter("inner", lambda e: F.col("p") > e))
    kind = df.schema[value].dataType
    return lv.crossJoin(F.broadcast(quantile_edges(lv, 3))).groupBy((place + 1).cast("int").alias("tercil")).agg(F.min("p").cast(kind).alias("minimo"), F.max("p").cast(kind).alias("maximo"), F.sum(F.col("pos") + F.col("neg")).alias("n"))


def error_classes(df: DataFrame, threshold: float) -> DataFrame:
    hit = F.col("p") >= threshold
    name = F.when(hit & (F.col("y") == 1), "VP").when(hit, "FP").when(F.col("y") == 1, "FN").otherwise("VN")
    per = df.groupBy(name.alias("classe")).agg(F.count("*").alias("n"))
    return per.crossJoin(F.broadcast(per.agg(F.sum("n").alias("t")))).select("classe", "n", F.round(F.col("n") / F.col("t"), 6).alias("fracao"))


def missed_against_found(df: DataFrame, threshold: float, columns: list[str]) -> DataFrame:
    """Means of numeric features over missed and found positives."""
    pos = df.where("y = 1")
    hit = F.col("p") >= threshold
    one = pos.agg(*(F.struct(F.avg(F.when(~hit, F.col(c))).alias("fn"), F.avg(F.when(hit, F.col(c))).alias("vp")).alias(c) for c in columns))
    rows = one.unpivot([], columns, "variavel", "v")
    return rows.select("variavel", F.round("v.fn", 5).alias("media_fn"), F.round("v.vp", 5).alias("media_vp"), F.round(F.abs(F.col("v.fn") - F.col("v.vp")), 5).alias("delta_abs"))


def missed_by(df: DataFrame, threshold: float, key: str) -> DataFrame:
    miss = (F.col("y") == 1) & (F.col("p") < threshold)
    per = df.groupBy(key).agg(F.sum("y").cast("long").alias("positivos"), F.sum(miss.cast("long")).alias("sem_alerta"))
    return per.withColumn("fracao", F.round(F.try_divide(F.col("sem_alerta").cast("double"), F.col("positivos")), 6))
