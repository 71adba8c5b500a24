"""Group-disjoint, stratified, deterministic partitioning and sampling.

Groups, not rows, are ranked by a salted hash inside their stratum; labels are joined back.
A stratum's ranks come from counts of hash buckets, so one large stratum is not one task.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.sources import io

BLOCKS = (("train_ref", 0.70), ("val_ref", 0.15), ("test_ref", 0.15))
SALT = "blocos-1"
MIN_GROUPS = 5


def salted(salt: str, c: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{salt}|"), c))


def ranked(rows: DataFrame, stratum: list[str], item: str, salt: str) -> DataFrame:
    """Add ``pos`` (1, 2, ...) by salted hash inside the stratum, and the stratum's size ``tam``."""
    keyed = rows.withColumn("_h", salted(salt, F.col(item))).withColumn("_b", F.substring("_h", 1, 2))
    sizes = keyed.groupBy(*stratum, "_b").agg(F.count("*").alias("_n"))
    inside = W.partitionBy(*stratum)
    offsets = sizes.withColumn("_before", F.sum("_n").over(inside.orderBy("_b")) - F.col("_n")).withColumn("tam", F.sum("_n").over(inside)).drop("_n")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*stratum, "_b"]]
    joined = keyed.alias("l").join(offsets.alias("r"), same).select("l.*", "r._before", "r.tam")
    place = F.row_number().over(W.partitionBy(*stratum, "_b").orderBy("_h", item))
    return joined.withColumn("pos", F.col("_before") + place).drop("_h", "_b", "_before")


OWN = ("_faixa", "_tam")  # names of place and size where rows may have columns of the usual ones
PLACED_ROWS = 200_000  # counts of hash prefixes that are broadcast; beyond it the join shuffles


def placed(rows: DataFrame, stratum: list[str], item: str, salt: str, cuts: Column, facts: DataFrame | None = None, place: str = "faixa", size: str = "tam") -> DataFrame:
    """Add ``place``: how many cut positions lie before the row's rank by salted hash in its stratum, and the stratum's ``size``.

    cuts: an array of positions, an expression of ``tam`` and of the columns of ``facts``, a row for each stratum. Counts
    of hash prefixes tell where each cut falls: rows of all other prefixes are placed where they are, and only those of
    a prefix that a cut divides are ranked.
    """
    keyed = rows.withColumn("_h", salted(salt, F.col(item).cast("string"))).withColumn("_b", F.substring("_h", 1, 3))
    sizes = keyed.groupBy(*stratum, "_b").agg(F.count("*").alias("_n"))
    inside = W.partitionBy(*stratum)
    places = sizes.withColumn("_upto", F.sum("_n").over(inside.orderBy("_b"))).withColumn("tam", F.sum("_n").over(inside))
    same = lambda l, r, cs: [F.col(f"{l}.{c}").eqNullSafe(F.col(f"{r}.{c}")) for c in cs]
    if facts is not None:
        places = places.alias("p").join(facts.alias("f"), same("p", "f", stratum)).select("p.*", *(f"f.{c}" for c in facts.columns if c not in stratum))
    before = F.col("_upto") - F.col("_n")
    index = lambda pos: F.size(F.filter("_cuts", lambda c: c < pos))
    places = places.withColumn("_cuts", cuts).select(*stratum, "_b", "tam", before.alias("_before"), "_cuts", index(before + 1).alias("_low"), index(F.col("_upto")).alias("_high"))
    places = io.stored(places, "places")
    few = places.count() <= PLACED_ROWS
    joined = keyed.alias("l").join((F.broadcast(places) if few else places).alias("r"), same("l", "r", [*stratum, "_b"])).select("l.*", F.col("r.tam").alias("_size"), *(f"r.{c}" for c in ("_before", "_cuts", "_low", "_high")))
    whole = joined.where("_low = _high").select(*rows.columns, F.col("_size").alias(size), F.col("_low").alias(place))
    rank = F.col("_before") + F.row_number().over(W.partitionBy(*stratum, "_b").orderBy("_h", item))
    split = joined.where("_low <> _high").withColumn("_place", index(rank)).select(*rows.columns, F.col("_size").alias(size), F.col("_place").alias(place))
    return whole.unionByName(split)


def block_cuts(size: Column, blocks=BLOCKS) -> Column:
    """Last positions of all blocks but one, by cumulated fractions; each later block keeps one group at least."""
    n = len(blocks)
    cums = list(accumulate(f for _, f in blocks))[:-1]
    return F.array(*(F.greatest(F.lit(i + 1), F.least(F.floor(size * F.lit(cum)), size - (n - 1 - i))).cast("long") for i, cum in enumerate(cums)))


def hash_blocks(groups: DataFrame, stratum: list[str], group: str = "grupo", salt: str = SALT, blocks=BLOCKS) -> DataFrame:
    names = F.array(*(F.lit(b) for b, _ in blocks))
    at = placed(groups, stratum, group, salt, block_cuts(F.col("tam"), blocks), None, *OWN)
    return at.withColumn("bloco", F.element_at(names, F.col(OWN[0]) + 1)).drop(*OWN)


def spanning(rows: DataFrame, group: str, keys: list[str]) -> DataFrame:
    """Groups whose rows disagree on the keys."""
    per = rows.groupBy(group).agg(F.count_distinct(F.struct(*(F.coalesce(F.col(k).cast("string"), F.lit("?")) for k in keys))).alias("combinacoes"))
    return per.where("combinacoes > 1")


def quarantine(rows: DataFrame, group: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of coherent groups, rows of groups that span several combinations)."""
    bad = spanning(rows, group, keys).select(group)
    return rows.join(bad, group, "left_anti"), rows.join(bad, group, "left_semi")


def check_strata(rows: DataFrame, group: str, stratum: list[str], least: int = MIN_GROUPS, blocks: int = len(BLOCKS)) -> DataFrame:
    """``(verificacao, observado, ok)``: no null group or stratum, one stratum a group, and enough groups in each."""
    if least < blocks:
        raise ValueError(f"a stratum needs {blocks} groups at least, not {least}")
    null = reduce(Column.__or__, (F.col(c).isNull() for c in stratum))
    one = rows.agg(F.count_if(F.col(group).isNull()).alias("grupo_nulo"), F.count_if(null).alias("estrato_nulo"))
    many = spanning(rows.where(F.col(group).isNotNull()), group, stratum).agg(F.count("*").alias("grupo_em_estratos"))
    small = stratum_check(rows, group, stratum, least).where("not ok").agg(F.count("*").alias("estrato_pequeno"))
    wide = one.crossJoin(F.broadcast(many)).crossJoin(F.broadcast(small))  # one row each
    return wide.unpivot([], wide.columns, "verificacao", "observado").withColumn("ok", F.col("observado") == 0)


def stratum_check(rows: DataFrame, group: str, stratum: list[str], least: int = MIN_GROUPS) -> DataFrame:
    per = rows.groupBy(*stratum).agg(F.count_distinct(group).alias("grupos"))
    return per.withColumn("ok", F.col("grupos") >= least)


def master_partition(rows: DataFrame, group: str, shared: tuple[int, ...], sealed: tuple[int, ...], year: str = "ano", y: str = "y", region: str = "regiao") -> DataFrame:
    """Add ``particao``: sealed years whole, shared years hashed by stratum, other years for exploration.

    If any stratum of year, target and region has fewer than MIN_GROUPS groups, all use year and target.
    """
    common = rows.where(F.col(year).isin(*shared))
    sizes = common.groupBy(year, y, region).agg(F.count_distinct(group).alias("g"))
    small = sizes.agg(F.coalesce(F.min("g") < MIN_GROUPS, F.lit(False)).alias("_small"))
    groups = common.select(group, year, y, region).distinct().crossJoin(F.broadcast(small))  # one row
    stratum, region_ = [year, y, "_region"], F.when(~F.col("_small"), F.col(region))
    groups = groups.select(group, year, y, region_.alias("_region")).distinct()
    blocks = hash_blocks(groups, stratum, group).select(group, "bloco")
    label = F.when(F.col(year).isin(*sealed), "test_pandemic").when(F.col(year).isin(*shared), F.col("bloco")).otherwise("exploracao")
    return rows.join(blocks, group, "left").withColumn("particao", label).drop("bloco")


def manifest(rows: DataFrame, block: str = "particao", group: str = "grupo") -> DataFrame:
    """Rows, groups, years, prevalence and an order-free fingerprint of the groups of each block."""
    facts = rows.groupBy(block).agg(F.count("*").alias("linhas"), F.array_join(F.array_sort(F.collect_set(F.col("ano").cast("string"))), ",").alias("anos"), F.round(F.avg("y"), 9).alias("prevalencia"))
    prints = rows.select(block, group).distinct().groupBy(block).agg(F.count("*").alias("grupos"), F.sum(F.conv(F.substring(F.md5(group), 1, 8), 16, 10).cast("long")).alias("impressao"))
    return facts.join(prints, block)


def crossing(rows: DataFrame, block: str = "particao", group: str = "grupo") -> DataFrame:
    return rows.groupBy(group).agg(F.count_distinct(block).alias("blocos")).where("blocos > 1")


def ratio_check(rows: DataFrame, block: str, expected: tuple = BLOCKS, among: tuple | None = None, tolerance: float = 0.005) -> DataFrame:
    """Observed and expected shares of blocks, those that only one side has included."""
    seen = rows.where(F.col(block).isin(*among)) if among else rows
    seen = seen.groupBy(block).agg(F.count("*").alias("n"))
    aim = rows.sparkSession.createDataFrame(list(expected), f"{block} string, esperado double")
    both = aim.join(seen, block, "full_outer").crossJoin(F.broadcast(seen.agg(F.sum("n").alias("t"))))
    share = F.coalesce(F.col("n") / F.col("t"), F.lit(0.0))
    ok = F.coalesce(F.abs(share - F.col("esperado")) <= tolerance, F.lit(False))
    return both.select(block, "esperado", F.coalesce("n", F.lit(0)).alias("n"), F.round(share, 9).alias("observado"), ok.alias("ok"))


def same_blocks(rows: DataFrame, expected: tuple[str, ...], block: str = "particao") -> DataFrame:
    """Blocks that only one side has: ``(bloco, lado)``; none if the sets are equal."""
    seen = rows.select(F.col(block).alias("bloco")).distinct()
    aim = rows.sparkSession.createDataFrame([(b,) for b in expected], "bloco string")
    return aim.subtract(seen).withColumn("lado", F.lit("esperado")).unionByName(seen.subtract(aim).withColumn("lado", F.lit("observado")))


def shared_groups(rows: DataFrame, one: str, two: str, block: str = "particao", group: str = "grupo") -> DataFrame:
    """Groups that two blocks have in common."""
    of = lambda b: rows.where(F.col(block) == b).select(group)
    return of(one).intersect(of(two))


def halves(rows: DataFrame, stratum: list[str], item: str, salt: str = "metades-1") -> DataFrame:
    cut = F.array(F.floor(F.col("tam") / 2).cast("long"))
    at = placed(rows, stratum, item, salt, cut, None, *OWN)
    return at.withColumn("metade", F.when(F.col(OWN[0]) == 0, "calibracao").otherwise("medida")).drop(*OWN)


def quotas(rows: DataFrame, stratum: list[str], total: int) -> DataFrame:
    """Rows to draw from each stratum: largest remainders, one at least, none above its size."""
    n = rows.groupBy(*stratum).agg(F.count("*").alias("n"))
    everything = n.agg(F.sum("n").alias("t"))
    share = F.lit(total) * F.col("n") / F.col("t")
    s = n.crossJoin(F.broadcast(everything)).withColumn("piso", F.floor(share)).withColumn("resto", F.round(share - F.floor(share), 9))
    left = s.agg((F.lit(total) - F.sum("piso")).alias("falta"))
    order = F.row_number().over(W.orderBy(F.desc("resto"), *stratum))  # strata are few
    s = s.crossJoin(F.broadcast(left)).withColumn("cota", F.col("piso") + (order <= F.col("falta")).cast("int"))
    return s.select(*stratum, "n", F.least("n", F.greatest(F.lit(1), "cota")).alias("cota"))


def quota_sample(rows: DataFrame, stratum: list[str], item: str, total: int, salt: str = "cotas-1") -> DataFrame:
    """The first rows of each stratum by salted hash, as many as its quota; the rest never leaves its task."""
    q = quotas(rows, stratum, total).drop("n")
    return placed(rows, stratum, item, salt, F.array(F.col("cota").cast("long")), q, *OWN).where(F.col(OWN[0]) == 0).drop(*OWN)


def random_subsample(rows: DataFrame, item: str, n: int, salt: str = "amostra-1") -> DataFrame:
    """The first n rows by salted hash."""
    everything = rows.withColumn("_s", F.lit(1))
    return placed(everything, ["_s"], item, salt, F.array(F.lit(n).cast("long")), None, *OWN).where(F.col(OWN[0]) == 0).drop(*OWN, "_s")


def drift(rows: DataFrame, sample: DataFrame, y: str = "y", tolerance: float = 0.002) -> DataFrame:
    a, b = rows.agg(F.avg(y).alias("original")), sample.agg(F.avg(y).alias("amostra"))
    both = a.crossJoin(b)  # one row each
    return both.select(F.round("original", 9).alias("original"), F.round("amostra", 9).alias("amostra"), (F.abs(F.col("original") - F.col("amostra")) <= tolerance).alias("ok"))
