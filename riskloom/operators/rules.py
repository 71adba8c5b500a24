"""Ordered inclusion rules: masks, counts, overlaps and the exclusion waterfall.

One pass turns the masks of a row into a bit set; every report reads the table of bit sets,
which has 2 ** rules rows at most, whatever the input.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.functions import codes

START, END, MOST_DAYS = "1995-02-01", "2001-06-30", 60
RULES = ("hospital", "data_invalida", "evolucao", "antes", "depois", "negativo", "longo")
APPROVED = ("hospital", "data_invalida", "antes", "depois", "negativo")


def masks() -> dict[str, Column]:
    """One column a rule, true where it is violated and never null."""
    day, onset = codes.iso_date(F.col("dt_interna")), codes.iso_date(F.col("dt_sin_pri"))
    days = codes.days_between(onset, day)
    sure = lambda c, default=False: F.coalesce(c, F.lit(default))
    return {
        "hospital": sure(codes.code(F.col("hospital")) != "1", True),
        "data_invalida": day.isNull(),
        "evolucao": ~sure(codes.code(F.col("evolucao")).isin("1", "2")),
        "antes": sure(day < F.to_date(F.lit(START))),
        "depois": sure(day > F.to_date(F.lit(END))),
        "negativo": sure(days < 0),
        "longo": sure(days > MOST_DAYS),
    }


def with_bits(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return rows.withColumn("bits", reduce(Column.__add__, (c.cast("int") * (1 << i) for i, c in enumerate(rules.values()))))


def rule_sets(rows: DataFrame, rules: dict[str, Column], *keys: Column) -> DataFrame:
    return with_bits(rows, rules).groupBy(*keys, "bits").agg(F.count("*").alias("n"))


def _each(names) -> Column:
    return F.explode(F.array(*(F.struct(F.lit(i + 1).alias("ordem"), F.lit(r).alias("regra"), (F.shiftright("bits", i) % 2).alias("hit")) for i, r in enumerate(names))))


def summary(sets: DataFrame, names=RULES) -> DataFrame:
    per = sets.select("n", _each(names).alias("r")).groupBy("r.ordem", "r.regra").agg(F.sum(F.col("n") * F.col("r.hit")).alias("violacoes"), F.sum("n").alias("total"))
    return per.withColumn("proporcao", F.round(F.try_divide(F.col("violacoes"), F.col("total")), 9))


def overlap(sets: DataFrame, names=RULES) -> DataFrame:
    a = sets.select("n", "bits", _each(names).alias("a")).where("a.hit = 1")
    both = a.select("n", F.col("a.regra").alias("regra"), _each(names).alias("b")).where("b.hit = 1")
    wide = both.groupBy("regra").pivot("b.regra", list(names)).agg(F.sum("n"))
    every = sets.sparkSession.createDataFrame([(r,) for r in names], "regra string")
    return every.join(wide, "regra", "left").na.fill(0)


def waterfall(sets: DataFrame, names=RULES, used=None) -> DataFrame:
    """Rows that each rule, in order, is the first to exclude, and what remains after it."""
    used = used or names
    # never null: else the join below would push "ordem is not null", and with it all masks, into the rows once for each rule
    first = F.coalesce(*(F.when(F.shiftright("bits", i) % 2 == 1, i + 1) for i, r in enumerate(names) if r in used), F.lit(0))
    gone = sets.groupBy(first.alias("ordem")).agg(F.sum("n").alias("excluidos"))
    every = sets.sparkSession.createDataFrame([(i + 1, r) for i, r in enumerate(names) if r in used], "ordem int, regra string")
    total = sets.agg(F.sum("n").alias("total"))
    rows = every.join(gone, "ordem", "left").na.fill(0, ["excluidos"]).crossJoin(F.broadcast(total))  # one row
    run = F.sum("excluidos").over(W.orderBy("ordem").rowsBetween(W.unboundedPreceding, 0))  # a row for each rule
    return rows.select("ordem", "regra", "excluidos", (F.coalesce("total", F.lit(0)) - run).alias("restantes"))


def by_key(sets: DataFrame, key: str, names=RULES) -> DataFrame:
    """Violations of each rule by a key that the sets are grouped by."""
    return sets.select(key, "n", _each(names).alias("r")).groupBy(key, "r.regra").agg(F.sum(F.col("n") * F.col("r.hit")).alias("violacoes"))


def reconciliation(sets: DataFrame, names=RULES, used=APPROVED) -> DataFrame:
    mask = sum(1 << names.index(r) for r in used)
    out = F.col("bits").bitwiseAND(mask) != 0
    sums = sets.agg(F.sum("n").alias("origem"), F.sum(F.when(out, F.col("n")).otherwise(0)).alias("excluidos"), F.sum(F.when(out, 0).otherwise(F.col("n"))).alias("mantidos"))
    return sums.withColumn("fecha", F.col("origem") == F.col("excluidos") + F.col("mantidos"))


def kept(rows: DataFrame, rules: dict[str, Column], used=APPROVED) -> DataFrame:
    return rows.where(~reduce(Column.__or__, (rules[r] for r in used)))
