"""Gradient boosting on histograms, grown leaf by leaf, for several settings in the same passes.

Columns become bins once: numbers by quantiles, categories by name, missing and unknown values a bin of their own. Rows
with the same bins and outcome have the same gradients in every tree, so they are one row with their number; these
are written once. Gradients are integers (SCALE), so sums do not depend on tasks.

Where these distinct rows are few (HELD cells at most), which bins see to however many rows there are, they are broadcast
and each setting is fitted in a task of its own, without a job for every step. Where they are more they stay where
they are, and the same trees come from passes: each sends the trees of the moment to the tasks; a task walks its rows to
their leaves, sums gradients, hessians and counts by leaf, column and bin, and Spark adds these histograms up. The
driver sees sums alone: leaves x columns x bins.

The leaf with the best gain is split until there are ``leaves`` or no gain is left. Missing values go to the side that
gains more; categories are split in the order of their gradient ratios. Of a split the smaller child is summed; the other
is the parent less the smaller one. A pass sums the smaller child of every leaf
that can still be split before the tree is full, so a tree takes about as many passes as it is deep. Settings that
are fitted together share every pass and all histograms' rows.

The loss of rows that ``valid`` marks is summed with the roots' histograms. A model ends when PATIENCE rounds have not
lowered it, and keeps the rounds up to the lowest loss; without such rows it takes all rounds.
"""

from __future__ import annotations

import math
import pickle
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.sources import io

SCALE = 2**24  # gradients, hessians and losses are summed as multiples of 1 / SCALE
BINS = 256  # of a column at most, the first for missing values
SMOOTH = 10.0  # added to hessians where categories are put in order
LEAST_HESSIAN = 1e-3
PATIENCE = 20
TOLERANCE = 1e-7
REFRESH = 20  # trees after which the sums of trees are written anew
ROWS = 65536
SCORED = 2**18  # rows that a task scores at a time, those alike once
HELD = 2**24  # cells (distinct rows x columns) up to which a task holds them all; beyond, passes read them where they lie
HELD_ROWS = 2**28  # rows that these stand for at most, as a task adds in doubles, exact below 2**53


@dataclass(frozen=True)
class Settings:
    rate: float = 0.05
    rounds: int = 500
    leaves: int = 63
    least: int = 100  # rows of a leaf
    l2: float = 0.1
    balanced: bool = False  # both classes weigh alike
    only: tuple[str, ...] | None = None  # the columns that may be split


NOWHERE = np.zeros(BINS, bool)  # of a leaf


@dataclass
class Tree:
    """Nodes in arrays; ``goes[node, bin]`` tells whether a bin of the node's column goes left. A leaf has no left node.
    A tree that grows has a list of rows of ``goes``, a finished one their bits."""

    column: list = field(default_factory=lambda: [0])
    left: list = field(default_factory=lambda: [-1])
    right: list = field(default_factory=lambda: [-1])
    goes: list | np.ndarray = field(default_factory=lambda: [NOWHERE])
    value: list = field(default_factory=lambda: [0.0])

    def split(self, node: int, column: int, goes: np.ndarray) -> tuple[int, int]:
        a = len(self.left)
        self.column[node], self.goes[node], self.left[node], self.right[node] = column, goes, a, a + 1
        for _ in range(2):
            self.column.append(0)
            self.left.append(-1)
            self.right.append(-1)
            self.goes.append(NOWHERE)
            self.value.append(0.0)
        return a, a + 1

    def copy(self) -> Tree:
        return Tree(list(self.column), list(self.left), list(self.right), list(self.goes), list(self.value))

    def finish(self) -> Tree:
        self.goes = np.packbits(np.array(self.goes), axis=1)
        return self

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        column, left, right = np.array(self.column), np.array(self.left), np.array(self.right)
        goes = np.array(self.goes) if isinstance(self.goes, list) else np.unpackbits(self.goes, axis=1).view(bool)
        node = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        while len(rows := rows[left[node[rows]] >= 0]):
            at = node[rows]
            node[rows] = np.where(goes[at, bins[rows, column[at]]], left[at], right[at])
        return node

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaf_of(bins)]


@dataclass
class Split:
    gain: float
    column: int
    goes: np.ndarray
    left_n: int


@dataclass
class Columns:
    """How columns become bins: inner edges of numbers, names of categories."""

    numeric: dict[str, list[float]]
    categorical: dict[str, list[str]]

    @property
    def names(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    def bins(self, batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((batch.num_rows, len(self.names)), np.uint8)
        for i, c in enumerate(self.names):
            values = batch.column(batch.schema.get_field_index(c))
            if c in self.numeric:
                x = values.to_numpy(zero_copy_only=False).astype(np.float64)
                out[:, i] = np.where(np.isnan(x), 0, np.searchsorted(self.numeric[c], x, side="left") + 1)
            else:
                known = pa.array(self.categorical[c], pa.string())
                out[:, i] = pc.fill_null(pc.add(pc.index_in(values, known), 1), 0).to_numpy(zero_copy_only=False) if len(known) else 0
        return out


@dataclass
class Model:
    columns: Columns
    base: float
    trees: list[Tree]
    losses: list[float]


def bin_columns(df: DataFrame, numeric: list[str], categorical: list[str]) -> Columns:
    """Edges at quantiles between distinct values (Spark's percentile sketch); the BINS - 1 most frequent categories."""
    shares = [i / (BINS - 1) for i in range(1, BINS - 1)]
    row = df.agg(*(F.percentile_approx(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), shares, 100_000).alias(c) for c in numeric)).first() if numeric else {}
    edges = {c: sorted(set(row[c] or [])) for c in numeric}
    names = {c: [] for c in categorical}
    if categorical:
        long = df.select(*(F.col(c).cast("string").alias(c) for c in categorical)).unpivot([], categorical, "c", "v").where("v is not null").groupBy("c", "v").agg(F.count("*").alias("n"))
        for c in categorical:  # BINS - 1 rows each
            names[c] = sorted(r["v"] for r in long.where(F.col("c") == c).orderBy(F.desc("n"), "v").limit(BINS - 1).select("v").collect())
    return Columns(edges, names)


def _to_bins(columns: Columns):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = columns.bins(batch)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in bins], pa.binary()), batch.column("y"), batch.column("valid")], ["bins", "y", "valid"])

    return run


def _read(batch: pa.RecordBatch, width: int, models: int) -> tuple[np.ndarray, ...]:
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, width)
    raw = batch.column("raw").flatten().to_numpy().reshape(-1, models)
    return bins, batch.column("y").to_numpy(), batch.column("valid").to_numpy(zero_copy_only=False), batch.column("n").to_numpy(), raw


def _sums(width: int, asked: list[tuple]):
    """Histograms of the nodes asked for: ``m, slot, c, b, g, h, n``; slot -1 has the loss of the validation rows.

    asked: of each model (base, trees not yet in raw, tree, slot of each node or -1, weight of y = 0 and 1), or None.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [None if a is None else np.zeros((max(a[3]) + 1, width, BINS, 3)) for a in asked]
        loss = np.zeros((len(asked), 2))
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                bins, y, valid, n, raw = _read(whole.slice(at, ROWS), width, len(asked))
                for m, a in enumerate(asked):
                    if a is None:
                        continue
                    base, trees, tree, slots, weight = a
                    score = base + raw[:, m]
                    for t in trees:
                        score += t.predict(bins)
                    if tree.left[0] < 0 and valid.any():
                        own = np.logaddexp(0, np.where(y[valid] == 1, -score[valid], score[valid]))
                        loss[m] += (np.rint(own * SCALE) * n[valid]).sum(), n[valid].sum()
                    slot = np.array(slots)[tree.leaf_of(bins)]
                    rows = np.flatnonzero((slot >= 0) & ~valid)
                    p, w = 1 / (1 + np.exp(-score[rows])), np.array(weight)[y[rows]]
                    many = n[rows].astype(np.float64)
                    g, h = np.rint(w * (p - y[rows]) * SCALE) * many, np.rint(w * p * (1 - p) * SCALE) * many
                    size = held[m].shape[0] * BINS
                    for c in range(width):
                        key = slot[rows] * BINS + bins[rows, c]
                        for i, v in enumerate((g, h, many)):
                            held[m][:, c, :, i] += np.bincount(key, v, size).reshape(-1, BINS)
        out = [np.empty((0, 7), np.int64)]
        for m, sums in enumerate(held):
            if sums is not None:
                s, c, b = np.nonzero(sums[..., 2])
                out.append(np.column_stack([np.full(len(s), m), s, c, b, sums[s, c, b].astype(np.int64)]))
                out.append(np.array([[m, -1, 0, 0, loss[m, 0], 0, loss[m, 1]]], np.int64))
        rows = np.vstack(out)
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, i]) for i in range(7)], ["m", "slot", "c", "b", "g", "h", "n"])

    return run


def _added(width: int, trees: list[list[Tree]]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, _, _, _, raw = _read(batch, width, len(trees))
            raw = raw + np.column_stack([sum((t.predict(bins) for t in own), np.zeros(len(bins))) for own in trees])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(list(raw), pa.list_(pa.float64()))], ["bins", "y", "valid", "n", "raw"])

    return run


def best_split(hist: np.ndarray, kinds: list[bool | None], s: Settings) -> Split | None:
    """The split of a leaf with the largest gain, the first column and cut on ties; kinds: whether a column is numeric, None: not split."""
    g, h, n = hist[..., 0] / SCALE, hist[..., 1] / SCALE, hist[..., 2]
    total_g, total_h, total_n = g[0].sum(), h[0].sum(), int(n[0].sum())
    gain_of = lambda a, b: a * a / np.maximum(b + s.l2, 1e-12)
    best = None
    for c, numeric in enumerate(kinds):
        if numeric is None:
            continue
        seen = np.flatnonzero(n[c] > 0)
        if numeric:
            order = seen[seen > 0]
            sides = (True, False) if n[c, 0] > 0 else (None,)
        else:
            order = seen[np.argsort(g[c, seen] / (h[c, seen] + SMOOTH), kind="stable")]
            sides = (None,)
        for missing_left in sides:
            extra = (g[c, 0], h[c, 0], n[c, 0]) if missing_left else (0.0, 0.0, 0)
            a, b, m = (np.cumsum(x[c, order]) + e for x, e in zip((g, h, n), extra, strict=True))
            fine = (m >= s.least) & (total_n - m >= s.least) & (b >= LEAST_HESSIAN) & (total_h - b >= LEAST_HESSIAN)
            gain = np.where(fine, gain_of(a, b) + gain_of(total_g - a, total_h - b) - gain_of(total_g, total_h), -np.inf)
            if not len(gain):
                continue
            i = int(gain.argmax())
            if gain[i] > (best.gain if best else 1e-12):
                goes = np.full(BINS, 2 * m[i] >= total_n)  # bins that the leaf has not seen go with the larger side
                if numeric:
                    goes[1:] = np.arange(1, BINS) <= order[i]
                    goes[0] = goes[0] if missing_left is None else missing_left
                else:
                    goes[seen] = np.isin(seen, order[: i + 1])
                best = Split(float(gain[i]), c, goes, int(m[i]))
    return best


class _Grower:
    """One model: what it needs to know next, and how it goes on once it is told."""

    def __init__(self, settings: Settings, kinds: list[bool | None], base: float, weight: tuple[float, float]):
        self.s, self.kinds, self.base, self.weight = settings, kinds, base, weight
        self.trees, self.losses, self.written, self.done = [], [], 0, False
        self._plant()

    def _plant(self) -> None:
        self.tree, self.open, self.known, self.asked = Tree(), {}, {}, None

    def request(self) -> tuple:
        """The tree to walk, with every split that may come next, and the slot of each node to sum."""
        if not self.open:
            self.asked = [0]
            return self.base, self.trees[self.written:], self.tree, [0], self.weight
        room = self.s.leaves - len(self.open)
        first = sorted((i for i, (_, b) in self.open.items() if b), key=lambda i: (-self.open[i][1].gain, i))[:room]
        tree, slots, self.asked = self.tree.copy(), {}, [i for i in first if i not in self.known]
        for k, i in enumerate(self.asked):
            split = self.open[i][1]
            a, b = tree.split(i, split.column, split.goes)
            slots[a if 2 * split.left_n <= self.open[i][0][0, :, 2].sum() else b] = k
        return self.base, self.trees[self.written:], tree, [slots.get(i, -1) for i in range(len(tree.left))], self.weight

    def told(self, hists: np.ndarray, loss: float | None) -> None:
        if self.asked == [0] and not self.open:
            self.losses.append(loss)
            rounds = len(self.trees)
            best = min(range(rounds + 1), key=lambda i: (self.losses[i] or 0) + TOLERANCE * i)
            if rounds == self.s.rounds or (loss is not None and rounds - best >= PATIENCE) or not hists[0, 0, :, 2].sum():
                self.trees, self.done = self.trees[: best if loss is not None else rounds], True
                return
            self.open[0] = (hists[0], best_split(hists[0], self.kinds, self.s))
        else:
            for k, i in enumerate(self.asked):
                self.known[i] = hists[k]
        self._grow()

    def _small(self, leaf: int) -> np.ndarray | None:
        """Sums of the smaller child of a leaf, None where they have to be asked for."""
        return self.known.pop(leaf, None)

    def _grow(self) -> None:
        """Split as far as is known; a full tree, or one without gain, gets its values."""
        while len(self.open) < self.s.leaves and (best := min((i for i, (_, b) in self.open.items() if b), key=lambda i: (-self.open[i][1].gain, i), default=None)) is not None:
            if (small := self._small(best)) is None:
                return
            hist, split = self.open.pop(best)
            a, b = self.tree.split(best, split.column, split.goes)
            if 2 * split.left_n > hist[0, :, 2].sum():
                a, b = b, a
            for i, own in ((a, small), (b, hist - small)):
                self.open[i] = (own, best_split(own, self.kinds, self.s))
        for i, (hist, _) in self.open.items():
            self.tree.value[i] = float(-self.s.rate * (hist[0, :, 0].sum() / SCALE) / (hist[0, :, 1].sum() / SCALE + self.s.l2))
        if len(self.open) == 1:
            self.done = True  # no split gains: further trees would not either
            return
        self.trees.append(self.tree.finish())
        self._plant()


class _HeldGrower(_Grower):
    """One model that holds all distinct rows, each leaf's row numbers with them, and asks nobody. Rows of the fit come first."""

    def __init__(self, settings: Settings, kinds: list[bool | None], base: float, weight: tuple[float, float], rows: tuple[np.ndarray, ...]):
        self.bins, self.y, self.n, self.fitted = rows
        self.keys = self.bins + np.arange(self.bins.shape[1], dtype=np.int32) * BINS
        self.score = np.full(len(self.y), base)
        super().__init__(settings, kinds, base, weight)

    def _plant(self) -> None:
        if self.trees:
            for i in self.open:
                self.score[self.rows[i]] += self.trees[-1].value[i]
        super()._plant()
        self.rows = {0: np.arange(len(self.y))}

    def _sums(self, rows: np.ndarray) -> np.ndarray:
        rows, width = rows[: np.searchsorted(rows, self.fitted)], self.bins.shape[1]
        keys = self.keys[rows].ravel()
        return np.stack([np.bincount(keys, np.repeat(v[rows], width), width * BINS) for v in self.values], axis=-1).astype(np.int64).reshape(width, BINS, 3)

    def _small(self, leaf: int) -> np.ndarray:
        hist, split = self.open[leaf]
        rows, a = self.rows.pop(leaf), len(self.tree.left)
        left = split.goes[self.bins[rows, split.column]]
        self.rows[a], self.rows[a + 1] = rows[left], rows[~left]
        return self._sums(self.rows[a if 2 * split.left_n <= hist[0, :, 2].sum() else a + 1])

    def run(self) -> None:
        fit, rest = slice(self.fitted), slice(self.fitted, None)
        many, y, w = self.n[fit].astype(np.float64), self.y[fit], np.array(self.weight)[self.y[fit]]
        count = int(self.n[rest].sum())
        while not self.done:
            p = 1 / (1 + np.exp(-self.score[fit]))
            self.values = np.rint(w * (p - y) * SCALE) * many, np.rint(w * p * (1 - p) * SCALE) * many, many
            own = np.logaddexp(0, np.where(self.y[rest] == 1, -self.score[rest], self.score[rest]))
            loss = float(int((np.rint(own * SCALE) * self.n[rest]).sum())) / SCALE / count if count else None
            self.asked = [0]
            self.told(self._sums(self.rows[0])[None], loss)


def _held(width: int, told: list[tuple]):
    """The trees and losses of the model ``m`` of a task, which gets all distinct rows; told: of each model its settings, kinds, base and weight."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        m = table.column("m")[0].as_py()
        bins = np.frombuffer(b"".join(table.column("bins").to_pylist()), np.uint8).reshape(-1, width)
        y, n, valid = (table.column(c).to_numpy() for c in ("y", "n", "valid"))
        order = np.argsort(valid, kind="stable")
        grower = _HeldGrower(*told[m], (bins[order], y[order], n[order], int((~valid).sum())))
        grower.run()
        found = pickle.dumps(([(t.column, t.left, t.right, t.goes, t.value) for t in grower.trees], grower.losses))  # no classes, which are a task's own
        yield pa.RecordBatch.from_arrays([pa.array([m], pa.int64()), pa.array([found], pa.binary())], ["m", "found"])

    return run


def fit_many(df: DataFrame, settings: dict[str, Settings], numeric: list[str], categorical: list[str], y: str = "y", valid: str | None = None) -> dict[str, Model]:
    """A model for each setting. Rows without an outcome are left out; valid: a boolean column of rows that only measure the loss."""
    io.guard([*numeric, *categorical], [y, "p"], numeric, categorical)
    mark = F.coalesce(F.col(valid), F.lit(False)) if valid else F.lit(False)
    rows = df.where(F.col(y).isNotNull()).select(*(F.col(c).cast("double").alias(c) for c in numeric), *(F.col(c).cast("string").alias(c) for c in categorical), F.col(y).cast("int").alias("y"), mark.alias("valid"))
    rows = io.stored(rows, "boost-rows")
    train = rows.where("not valid")
    columns = bin_columns(train, numeric, categorical)
    n, pos = train.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    growers = []
    for s in settings.values():
        weight = (n / (2 * max(1, n - pos)), n / (2 * max(1, pos))) if s.balanced else (1.0, 1.0)
        a, b = weight[1] * pos, weight[0] * (n - pos)
        kinds = [c in numeric if s.only is None or c in s.only else None for c in columns.names]
        growers.append(_Grower(s, kinds, math.log(a / b) if a and b else 0.0, weight))
        growers[-1].done = not (a and b)
    width = len(columns.names)
    alike = io.stored(rows.mapInArrow(_to_bins(columns), "bins binary, y int, valid boolean").groupBy("bins", "y", "valid").agg(F.count("*").alias("n")), "boost")
    cells, number = alike.agg(width * F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if cells <= HELD and number <= HELD_ROWS:
        _fit_held(alike, growers, width)
    else:
        _fit_passes(alike, growers, width)
    return {name: Model(columns, g.base, g.trees, g.losses) for name, g in zip(settings, growers, strict=True)}


def _fit_held(alike: DataFrame, growers: list[_Grower], width: int) -> None:
    """A task for each model: the numbers of models, a partition each, meet all distinct rows by broadcast."""
    live = [g for g in growers if not g.done]
    if not live:
        return
    each = alike.sparkSession.range(0, len(live), 1, len(live)).withColumnRenamed("id", "m").crossJoin(F.broadcast(alike))
    for m, found in each.mapInArrow(_held(width, [(g.s, g.kinds, g.base, g.weight) for g in live]), "m long, found binary").collect():  # a row a model
        trees, live[m].losses = pickle.loads(found)
        live[m].trees, live[m].done = [Tree(*t) for t in trees], True


def _fit_passes(alike: DataFrame, growers: list[_Grower], width: int) -> None:
    state = io.stored(alike.withColumn("raw", F.array_repeat(F.lit(0.0), len(growers))), "boost")
    while any(not g.done for g in growers):
        if max(len(g.trees) - g.written for g in growers) >= REFRESH:
            state = io.stored(state.mapInArrow(_added(width, [g.trees[g.written:] if not g.done else [] for g in growers]), state.schema.simpleString()[7:-1].replace(":", " ")), "boost")
            for g in growers:
                g.written = len(g.trees)
        asked = [None if g.done else g.request() for g in growers]
        found = state.mapInArrow(_sums(width, asked), "m long, slot long, c long, b long, g long, h long, n long").groupBy("m", "slot", "c", "b").agg(F.sum("g"), F.sum("h"), F.sum("n"))
        rows_ = np.array([tuple(r) for r in found.collect()], np.int64).reshape(-1, 7)  # leaves x columns x bins
        for m, g in enumerate(growers):
            if not g.done:
                own = rows_[rows_[:, 0] == m]
                hists = np.zeros((len(g.asked), width, BINS, 3), np.int64)
                inside = own[own[:, 1] >= 0]
                hists[inside[:, 1], inside[:, 2], inside[:, 3]] = inside[:, 4:]
                told = own[own[:, 1] < 0]
                count = int(told[:, 6].sum())
                g.told(hists, float(told[:, 4].sum()) / SCALE / count if count else None)


def fit(df: DataFrame, numeric: list[str], categorical: list[str], settings: Settings | None = None, y: str = "y", valid: str | None = None) -> Model:
    return fit_many(df, {"": settings or Settings()}, numeric, categorical, y, valid)[""]


def score(models: dict[str, Model], df: DataFrame, name: str = "candidato", p: str = "p") -> DataFrame:
    """The rows with the score of each model, a row for each: ``name`` and ``p`` added; all models share one reading."""
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    held = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(models))  # which sends the classes too, as broadcasts do not
    columns = next(iter(models.values())).columns
    kept = df.columns
    inputs = df.select(*kept, *(F.col(c).cast("double").alias(f"_in_{c}") for c in columns.numeric), *(F.col(c).cast("string").alias(f"_in_{c}") for c in columns.categorical))

    def slabs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= SCORED:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if n:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = pickle.loads(held.value)
        for batch in slabs(batches):
            own = pa.RecordBatch.from_arrays(batch.columns[len(kept):], columns.names)
            bins, back = np.unique(columns.bins(own), axis=0, return_inverse=True)
            back = back.ravel()
            for key, model in ready.items():
                raw = model.base + sum((t.predict(bins) for t in model.trees), np.zeros(len(bins)))
                p_of = np.round(1 / (1 + np.exp(-raw)), 9)[back]
                for at in range(0, len(back), ROWS):
                    part = batch.slice(at, ROWS)
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array([key] * len(part), pa.string()), pa.array(p_of[at : at + ROWS])], [*kept, name, p])

    return inputs.mapInArrow(run, StructType([*df.schema.fields, StructField(name, StringType()), StructField(p, DoubleType())]))


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package
