"""Bootstrap by weight vectors: each row's weights in all replicates, worked out where the row is and never shuffled.

A unit's weights are Poisson(1) counts from one hash of the unit and powers of ROOT. Rows travel once, with the
unit's seed in place of the unit, into ranges of the score. Two passes over the ranges turn seeds into a matrix of
weights, a few rows by all replicates: the first sums weights by range, so that windows over ranges give each one
what lies above it; the second runs down the scores and adds up, for all replicates together, what the metrics
need. Levels that hold many rows are summed to two arrays of replicates in the tasks that read them, before any
shuffle, so no level is one task and their rows are neither dealt nor weighed twice. What leaves a task is a row for each range, key and replicate.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.sources import io

PRIME, ROOT = 2**31 - 1, 48271  # a multiplicative generator: weights of a unit come from its seed times powers of ROOT
# the least values for one draw, two draws, ...: the distribution of Poisson(1) times PRIME
POISSON = [round(PRIME * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(8)]
DENSE = 4  # thresholds that are compared in every cell; the rest where the last of these is reached
ROWS = 128  # of a matrix of weights
HOT_LEVELS = 32768  # levels with more than this part of all rows are summed before the shuffle, this many at most
HELD = 2**25  # sums that a task holds at most, of four bytes; many replicates make for fewer hot levels
SORTED = 2**20  # rows that a task sorts at a time, so that those of a level lie together
FIT = 31  # rows whose weights, 8 at most, add up to a byte
SUMS = ("area", "ap", "np", "nn", "erro", "soma_p")


def multipliers(replicates: int) -> list[int]:
    return [pow(ROOT, r + 1, PRIME) for r in range(replicates)]


def unit_seed(unit: str, seed: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col(unit))), 1, 8), 16, 10).cast("long") % (PRIME - 1) + 1


def weights(seeds: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Weights of units (rows) in replicates (columns)."""
    return _small_weights(seeds, powers).astype(np.float64)


def _small_weights(seeds: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """The same in bytes."""
    p = np.uint32(PRIME)
    wide = seeds.astype(np.uint64)[:, None] * powers[None, :]
    x = wide.astype(np.uint32) & p
    wide >>= np.uint64(31)
    x += wide.astype(np.uint32)  # below 2 * PRIME: a remainder by a Mersenne prime, but for one subtraction
    np.minimum(x, x - p, out=x)  # which wraps around where nothing is to be subtracted
    w = (x >= POISSON[0]).view(np.uint8)
    for t in POISSON[1:DENSE]:
        w += x >= t
    more = np.flatnonzero(x >= POISSON[DENSE])
    w.ravel()[more] = np.searchsorted(POISSON, x.ravel()[more], side="right")
    return w


def _runs(*keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of equal keys."""
    edge = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1 if len(keys[0]) > 1 else []
    ends = [0, *edge, len(keys[0])]
    yield from zip(ends[:-1], ends[1:], strict=True) if len(keys[0]) else ()


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _gathered(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _level_arrays(replicates: int):
    """Rows of hot levels, as they lie, to a row for each level that a task meets: ``kid, p`` and the weights' sums in bytes."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held = np.array(multipliers(replicates), np.uint64), {}
        for table in _gathered(batches, SORTED):
            kid, p, s, y = (table.column(i).to_numpy() for i in range(4))
            yes = (y == 1).astype(np.int8)
            order = np.lexsort((yes, p, kid))
            kid, p, s, yes = kid[order], p[order], s[order], yes[order]
            for at in range(0, len(s), ROWS):
                here = slice(at, at + ROWS)
                w = _small_weights(s[here], powers)
                for a, z in _runs(kid[here], p[here], yes[here]):
                    key = (int(kid[at + a]), float(p[at + a]))
                    if (level := held.get(key)) is None:
                        level = held[key] = np.zeros((2, replicates), np.uint32)
                    for i in range(a, z, FIT):
                        level[1 - yes[at + a]] += np.add.reduce(w[i : min(z, i + FIT)], axis=0, dtype=np.uint8)
        yield from _levels(held.items(), lambda x: x.tobytes(), pa.binary())

    return run


def _levels(levels: Iterable[tuple], told, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    levels = iter(levels)
    while part := list(islice(levels, ROWS)):
        columns = [pa.array([told(both[i]) for _, both in part], kind) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array([k for (k, _), _ in part], pa.int64()), pa.array([p for (_, p), _ in part], pa.float64()), *columns], ["kid", "p", "pos", "neg"])


def _added_levels(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the tasks' rows of each level; they come sorted by level."""
    def each() -> Iterator[tuple]:
        now, both = None, None
        for batch in batches:
            for kid, p, pos, neg in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.vstack([np.frombuffer(pos, np.uint32), np.frombuffer(neg, np.uint32)]).astype(np.float64)
                if (kid, p) != now:
                    if now:
                        yield now, both
                    now, both = (kid, p), own
                else:
                    both += own
        if now:
            yield now, both

    yield from _levels(each(), lambda x: x, pa.list_(pa.float64()))


def _matrices(batch: pa.RecordBatch, powers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of positives and of negatives of each row: from seeds, or the arrays of a hot level."""
    s, y = batch.column("s"), batch.column("y").to_numpy(zero_copy_only=False)
    light = s.is_valid().to_numpy(zero_copy_only=False)
    pos, neg = np.zeros((len(light), len(powers))), np.zeros((len(light), len(powers)))
    if light.any():
        w = weights(s.to_numpy(zero_copy_only=False)[light].astype(np.uint64), powers)
        yes = (y[light] == 1)[:, None]
        pos[light], neg[light] = np.where(yes, w, 0), np.where(yes, 0, w)
    for i in np.flatnonzero(~light):
        pos[i], neg[i] = batch.column("pos")[i].values.to_numpy(), batch.column("neg")[i].values.to_numpy()
    return pos, neg


def _totals(replicates: int):
    """Weights of each range and key: ``part, kid, rep, pos, neg``."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held = np.array(multipliers(replicates), np.uint64), {}
        for batch in _slices(batches):
            part, kid = batch.column("part").to_numpy(), batch.column("kid").to_numpy()
            pos, neg = _matrices(batch, powers)
            for a, z in _runs(part, kid):
                both = np.vstack([pos[a:z].sum(0), neg[a:z].sum(0)])
                at = (int(part[a]), int(kid[a]))
                held[at] = held[at] + both if at in held else both
        for (part, kid), (pos, neg) in held.items():
            n = len(pos)
            yield pa.RecordBatch.from_pydict({"part": np.full(n, part, np.int32), "kid": np.full(n, kid), "rep": np.arange(n, dtype=np.int32), "pos": pos, "neg": neg})

    return run


class _Curve:
    """Running sums of one key down the scores, for all replicates."""

    def __init__(self, tp: np.ndarray, fp: np.ndarray):
        self.tp, self.fp, self.level, self.sums = tp, fp, None, np.zeros((len(SUMS), len(tp)))

    def close(self, p: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> None:
        tp, fp = self.tp + np.cumsum(pos, axis=0), self.fp + np.cumsum(neg, axis=0)
        drawn = np.where(tp + fp > 0, tp + fp, 1)
        p = p[:, None]
        self.sums += [(neg * (tp - 0.5 * pos)).sum(0), (pos * tp / drawn).sum(0), pos.sum(0), neg.sum(0), (pos * (1 - p) ** 2 + neg * p * p).sum(0), ((pos + neg) * p).sum(0)]
        self.tp, self.fp = tp[-1], fp[-1]

    def add(self, p: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> None:
        """Rows in falling order; the last level stays open, as the next rows may go on with it."""
        at = np.array([a for a, _ in _runs(p)])
        p, pos, neg = p[at], np.add.reduceat(pos, at, axis=0), np.add.reduceat(neg, at, axis=0)
        if self.level is not None:
            was, a, b = self.level
            if was == p[0]:
                pos[0] += a
                neg[0] += b
            else:
                p, pos, neg = np.r_[was, p], np.vstack([a, pos]), np.vstack([b, neg])
        if len(p) > 1:
            self.close(p[:-1], pos[:-1], neg[:-1])
        self.level = (p[-1], pos[-1], neg[-1])

    def end(self) -> np.ndarray:
        if self.level is not None:
            p, pos, neg = self.level
            self.close(np.array([p]), pos[None], neg[None])
        return self.sums


def _curves(replicates: int):
    """Sums of each range and key: ``kid, rep`` and SUMS. Rows are sorted by range, key and falling score, what lies above first."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, now, curve = np.array(multipliers(replicates), np.uint64), None, None

        def told() -> pa.RecordBatch:
            sums = curve.end()
            return pa.RecordBatch.from_pydict({"kid": np.full(replicates, now[1]), "rep": np.arange(replicates, dtype=np.int32), **dict(zip(SUMS, sums, strict=True))})

        for batch in _slices(batches):
            part, kid, p = batch.column("part").to_numpy(), batch.column("kid").to_numpy(), batch.column("p").to_numpy(zero_copy_only=False)
            above = batch.column("above").to_numpy(zero_copy_only=False)
            pos, neg = _matrices(batch, powers)
            for a, z in _runs(part, kid):
                if (part[a], kid[a]) != now:
                    if curve:
                        yield told()
                    now, curve = (part[a], kid[a]), _Curve(np.zeros(replicates), np.zeros(replicates))
                if above[a]:
                    curve.tp, curve.fp = pos[a].copy(), neg[a].copy()
                    a += 1
                if a < z:
                    curve.add(p[a:z], pos[a:z], neg[a:z])
        if curve:
            yield told()

    return run


ARRAYS = "pos array<double>, neg array<double>"


def replicate_metrics(df: DataFrame, unit: str, replicates: int, seed: str, keys: list[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """``keys, rep, roc_auc, pr_auc, brier, oe, pr_relativa`` of each replicate that draws both classes; units are drawn."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kid = F.xxhash64(*(F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys)) if keys else F.lit(0).cast("long")
    rows = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).select(kid.alias("kid"), *keys, F.col(p).cast("double").alias("p"), unit_seed(unit, seed).alias("s"), F.col(y).cast("int").alias("y"))
    rows = io.stored(rows, "draws")
    counts = rows.groupBy("kid", "p").agg(F.count("*").alias("n"))
    least = rows.count() // max(1, min(HOT_LEVELS, HELD // (2 * replicates)))
    hot = io.stored(counts.where(F.col("n") > max(least, ROWS)).select("kid", "p"), "hot-levels")  # HOT_LEVELS rows at most
    light = rows.join(F.broadcast(hot), ["kid", "p"], "left_anti").select("kid", "p", "s", "y", F.lit(None).cast("array<double>").alias("pos"), F.lit(None).cast("array<double>").alias("neg"))
    heavy = rows.join(F.broadcast(hot), ["kid", "p"], "left_semi").select("kid", "p", "s", "y").coalesce(parts).mapInArrow(_level_arrays(replicates), "kid long, p double, pos binary, neg binary")
    heavy = io.stored(heavy.repartition(parts, "kid", "p").sortWithinPartitions("kid", "p").mapInArrow(_added_levels, f"kid long, p double, {ARRAYS}"), "level-sums")  # finding ranges would weigh again
    heavy = heavy.select("kid", "p", F.lit(None).cast("long").alias("s"), F.lit(None).cast("int").alias("y"), "pos", "neg")
    falling = ["kid", F.desc("p")]
    dealt = light.unionByName(heavy).repartitionByRange(parts, *falling).sortWithinPartitions(*falling)
    dealt = io.stored(dealt.withColumn("part", F.spark_partition_id()), "ranges")

    totals = dealt.mapInArrow(_totals(replicates), "part int, kid long, rep int, pos double, neg double").groupBy("part", "kid", "rep").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    before = W.partitionBy("kid", "rep").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    above = totals.select("part", "kid", "rep", F.sum("pos").over(before).alias("pos"), F.sum("neg").over(before).alias("neg")).where("pos is not null")
    vector = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("rep", c))), lambda x: x[c]).alias(c)
    above = above.groupBy("part", "kid").agg(vector("pos"), vector("neg"))
    above = above.select("kid", F.lit(None).cast("double").alias("p"), F.lit(None).cast("long").alias("s"), F.lit(None).cast("int").alias("y"), "pos", "neg", "part", F.lit(True).alias("above"))
    both = dealt.withColumn("above", F.lit(False)).unionByName(above).repartitionById(parts, "part").sortWithinPartitions("part", "kid", F.desc("above"), F.desc("p"))
    sums = both.mapInArrow(_curves(replicates), "kid long, rep int, " + ", ".join(f"{c} double" for c in SUMS)).groupBy("kid", "rep").agg(*(F.sum(c).alias(c) for c in SUMS))
    n = F.col("np") + F.col("nn")
    out = sums.where("np > 0 and nn > 0").select(
        "kid", "rep", F.round(F.col("area") / (F.col("np") * F.col("nn")), 6).alias("roc_auc"), F.round(F.col("ap") / F.col("np"), 6).alias("pr_auc"),
        F.round(F.col("erro") / n, 6).alias("brier"), F.round(F.try_divide(F.col("np"), F.col("soma_p")), 6).alias("oe"), n.alias("n"), F.col("np").alias("positivos"))
    out = out.withColumn("pr_relativa", F.round(F.col("pr_auc") * F.col("n") / F.col("positivos"), 6)).drop("n", "positivos")
    if not keys:
        return out.drop("kid")
    names = rows.select("kid", *keys).distinct()  # a row a key
    return names.join(out, "kid").drop("kid")


def _sums(replicates: int, columns: int):
    """Weighted sums of columns, a row for each task and replicate."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, total = np.array(multipliers(replicates), np.uint64), np.zeros((columns, replicates))
        for batch in _slices(batches):
            values = np.vstack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(columns)])
            total += values @ weights(batch.column(0).to_numpy(), powers)
        yield pa.RecordBatch.from_pydict({"rep": np.arange(replicates, dtype=np.int32), **{f"v{i}": v for i, v in enumerate(total)}})

    return run


def weighted_sums(df: DataFrame, unit: str, columns: list[Column], replicates: int, seed: str) -> DataFrame:
    """``rep, v0, v1, ...``: sums of columns, null as 0, in each replicate; rows are read in place."""
    rows = df.select(unit_seed(unit, seed).alias("s"), *(F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"v{i}") for i, c in enumerate(columns)))
    names = [f"v{i}" for i in range(len(columns))]
    return rows.mapInArrow(_sums(replicates, len(columns)), "rep int, " + ", ".join(f"{c} double" for c in names)).groupBy("rep").agg(*(F.sum(c).alias(c) for c in names))


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package
