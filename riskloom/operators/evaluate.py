"""Classifier evaluation as aggregates over (y, p), for all rows or for each key.

Rows are first summed to levels: one row for each key and score, and all that follows reads levels. Running sums over levels go
in two steps, by bucket of the score's logit and then inside it, so that no single task holds all levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.operators import resample
from riskloom.operators.resample import POISSON, PRIME, multipliers  # noqa: F401  fixed by the queries' SQL
from riskloom.sources import io

FINE = 32  # buckets a unit of the logit: rare outcomes crowd near 0, where equal widths would not part them
ALL = "todos"


def levels(df: DataFrame, keys: list[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    return df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(p).alias("p")).agg(F.sum(F.col(y)).cast("long").alias("pos"), F.sum(1 - F.col(y)).cast("long").alias("neg"))


def running(lv: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Add ``tp, fp``: positives and negatives at this score or above; and the totals ``np, nn``."""
    q = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col("p")))
    lv = lv.withColumn("_b", F.floor(F.log(q / (1 - q)) * FINE))
    per = lv.groupBy(*keys, "_b").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    above = W.partitionBy(*keys).orderBy(F.desc("_b"))  # 1,330 buckets a key at most
    whole = W.partitionBy(*keys)
    per = per.select(*keys, "_b", (F.sum("_p").over(above) - F.col("_p")).alias("_pa"), (F.sum("_n").over(above) - F.col("_n")).alias("_na"), F.sum("_p").over(whole).alias("np"), F.sum("_n").over(whole).alias("nn"))
    inner = W.partitionBy(*keys, "_b").orderBy(F.desc("p"))
    both = lv.join(per, [*keys, "_b"])
    return both.withColumn("tp", F.col("_pa") + F.sum("pos").over(inner)).withColumn("fp", F.col("_na") + F.sum("neg").over(inner)).drop("_b", "_pa", "_na")


def discrimination(lv: DataFrame, keys: list[str] = ()) -> DataFrame:
    """ROC-AUC with half credit for ties, and average precision by score level; null for one class."""
    r = running(lv, keys)
    area = F.sum(F.col("neg") * (F.col("tp") - 0.5 * F.col("pos")))
    ap = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return r.groupBy(*keys).agg(F.round(F.try_divide(area, F.max("np").cast("double") * F.max("nn")), 6).alias("roc_auc"), F.when(F.max("nn") > 0, F.round(F.try_divide(ap, F.max("np").cast("double")), 6)).alias("pr_auc"))


def _ratio(a: Column, b: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 6)


def confusion_counts(t: float, p: str = "p", y: str = "y") -> list[Column]:
    hit = F.col(p) >= t
    is_y = F.col(y) == 1
    return [F.sum((hit & is_y).cast("long")).alias("vp"), F.sum((hit & ~is_y).cast("long")).alias("fp"), F.sum((~hit & is_y).cast("long")).alias("fn"), F.sum((~hit & ~is_y).cast("long")).alias("vn")]


def rates(df: DataFrame) -> DataFrame:
    """Precision, recall, specificity, F1 and accuracy of counts; 0 where undefined."""
    vp, fp, fn, vn = (F.col(c) for c in ("vp", "fp", "fn", "vn"))
    return df.withColumns({"precisao": _ratio(vp, vp + fp), "recall": _ratio(vp, vp + fn), "especificidade": _ratio(vn, vn + fp), "f1": _ratio(2 * vp, 2 * vp + fp + fn), "acuracia": _ratio(vp + vn, vp + fp + fn + vn)})


def brier(p="p", y="y") -> Column:
    return F.round(F.avg((F.col(y) - F.col(p)) ** 2), 6)


def log_loss(p="p", y="y", eps: float = 1e-15) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col(p)))
    return F.round(F.avg(-(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q))), 6)


def per_level(lv: DataFrame, keys: list[str] = (), threshold: float = 0.5) -> DataFrame:
    """Counts, confusion counts, Brier score, log loss and O/E of levels."""
    n, p = F.col("pos") + F.col("neg"), F.col("p")
    q = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), p))
    sums = lambda c: F.coalesce(F.sum(c), F.lit(0))
    hit = p >= threshold
    counts = [sums(F.when(cond, F.col(c)).otherwise(0)).alias(name) for name, cond, c in (("vp", hit, "pos"), ("fp", hit, "neg"), ("fn", ~hit, "pos"), ("vn", ~hit, "neg"))]
    return lv.groupBy(*keys).agg(
        sums(n).alias("n"), sums("pos").alias("positivos"), F.round(F.sum("pos") / F.sum(n), 6).alias("prevalencia"), *counts,
        F.round(F.sum(F.col("pos") * (1 - p) ** 2 + F.col("neg") * p**2) / F.sum(n), 6).alias("brier"),
        F.round(F.sum(-(F.col("pos") * F.log(q) + F.col("neg") * F.log(1 - q))) / F.sum(n), 6).alias("log_loss"),
        F.round(F.try_divide(F.sum("pos").cast("double"), F.sum(n * p)), 6).alias("oe"))


def metrics(df: DataFrame, threshold: float, keys: list[str] = (), least: int = 0, least_class: int = 0) -> DataFrame:
    """The full row of metrics; keys with fewer than ``least`` rows, or ``least_class`` of a class, keep n and prevalence only."""
    lv = io.stored(levels(df, keys), "levels")
    facts = rates(per_level(lv, keys, threshold))
    both = facts.join(discrimination(lv, keys), list(keys)) if keys else facts.crossJoin(discrimination(lv))  # one row each
    both = both.withColumn("pr_relativa", F.round(F.try_divide(F.col("pr_auc"), F.col("prevalencia")), 4))
    one_class = (F.col("positivos") == 0) | (F.col("positivos") == F.col("n"))
    enough = (F.col("n") >= least) & (F.col("positivos") >= least_class) & (F.col("n") - F.col("positivos") >= least_class)
    for c in both.columns:
        if c in ("roc_auc", "pr_auc", "brier", "oe", "pr_relativa"):
            both = both.withColumn(c, F.when(~one_class, F.col(c)))
        if (least or least_class) and c not in (*keys, "n", "positivos", "prevalencia"):
            both = both.withColumn(c, F.when(enough, F.col(c)))
    return both


def grid(low: float, high: float, n: int) -> list[float]:
    return [round(low + (high - low) * i / (n - 1), 10) for i in range(n)]


def cut_counts(df: DataFrame, cuts: list[float], keys: list[str] = ()) -> DataFrame:
    """Confusion counts at each cut from one histogram of cut places; no row is repeated."""
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("p")))
    binned = levels(df, keys).groupBy(*keys, place.alias("bin")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    totals = binned.groupBy(*keys).agg(F.sum("pos").alias("np"), F.sum("neg").alias("nn"), F.collect_list(F.struct("bin", "pos", "neg")).alias("bins"))
    each = totals.select(*keys, "np", "nn", "bins", F.posexplode(F.array(*map(F.lit, cuts))).alias("i", "limiar"))
    above = lambda f: F.aggregate(F.filter("bins", lambda b: b["bin"] > F.col("i")), F.lit(0).cast("long"), lambda a, b: a + b[f])
    out = each.select(*keys, "limiar", above("pos").alias("vp"), above("neg").alias("fp"), "np", "nn")
    return out.select(*keys, "limiar", "vp", "fp", (F.col("np") - F.col("vp")).alias("fn"), (F.col("nn") - F.col("fp")).alias("vn"))


def sweep(df: DataFrame, cuts: list[float]) -> DataFrame:
    out = rates(cut_counts(df, cuts))
    return out.withColumn("youden", F.round(F.col("recall") + F.col("especificidade") - 1, 6))


def choose(swept: DataFrame, metric: str, least_precision: float = 0.0, least_recall: float = 0.0) -> DataFrame:
    """The cut with the best metric under the constraints, the lowest on ties; an error if none meets them."""
    met = (F.col("precisao") >= least_precision) & (F.col("recall") >= least_recall)
    best = swept.withColumn("_met", met).orderBy(F.desc("_met"), F.desc(metric), "limiar").limit(1)
    return best.where(F.col("_met") | F.raise_error(F.lit("no cut meets the constraints")).cast("boolean")).drop("_met")


def decision_curve(df: DataFrame, cuts: list[float]) -> DataFrame:
    n = F.col("vp") + F.col("fp") + F.col("fn") + F.col("vn")
    odds = F.col("limiar") / (1 - F.col("limiar"))
    out = cut_counts(df, cuts)
    return out.select("limiar", F.round(F.col("vp") / n - F.col("fp") / n * odds, 6).alias("beneficio"), F.round((F.col("vp") + F.col("fn")) / n - (F.col("fp") + F.col("vn")) / n * odds, 6).alias("tratar_todos"), F.round(100 * (F.col("vp") + F.col("fp")) / n, 6).alias("alertas_por_100"))


def curve_points(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    r = running(levels(df, keys), keys)
    return r.select(*keys, "p", _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precisao"), _ratio(F.col("tp"), F.col("np")).alias("recall"), _ratio(F.col("fp"), F.col("nn")).alias("fpr"))


# --- calibration

def with_edges(lv: DataFrame, edges: DataFrame | list[float], keys: list[str] = ()) -> DataFrame:
    """Add ``faixa_p``, the right-closed bin of each level: the number of inner edges below the score."""
    if isinstance(edges, list):
        inner = F.array(*map(F.lit, edges)) if edges else F.array().cast("array<double>")
        return lv.withColumn("faixa_p", F.size(F.filter(inner, lambda e: F.col("p") > e)))
    lv = lv.join(F.broadcast(edges), list(keys)) if keys else lv.crossJoin(F.broadcast(edges))  # a row for each key
    return lv.withColumn("faixa_p", F.size(F.filter("inner", lambda e: F.col("p") > e))).drop("inner")


def quantile_edges(lv: DataFrame, bins: int, keys: list[str] = ()) -> DataFrame:
    """``inner`` edges of each key at exact quantiles of the score, equal ones once; ranks come from running sums."""
    r = running(lv, keys)
    n = F.col("np") + F.col("nn")
    first = n - F.col("tp") - F.col("fp")  # rows below the level
    at = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), ((n - 1) * (i / bins)).alias("h")) for i in range(bins + 1))))
    held = r.select(*keys, "p", first.alias("first"), (first + F.col("pos") + F.col("neg")).alias("stop"), at.alias("q")).select(*keys, "p", "first", "stop", "q.*")
    inside = lambda rank: (F.col("first") <= rank) & (rank < F.col("stop"))
    ends = held.where(inside(F.floor("h")) | inside(F.ceil("h"))).groupBy(*keys, "i", "h").agg(F.min("p").alias("low"), F.max("p").alias("high"))
    edge = F.col("low") + (F.col("high") - F.col("low")) * (F.col("h") - F.floor("h"))
    edges = ends.groupBy(*keys).agg(F.array_sort(F.collect_set(edge)).alias("e"))
    return edges.select(*keys, F.when(F.size("e") > 2, F.slice("e", 2, F.size("e") - 2)).otherwise(F.array().cast("array<double>")).alias("inner"))


SKETCH = 4096  # of a KLL sketch: ranks err by about 0.1 % of the rows


def score_sketches(df: DataFrame, keys: list[str] = (), size: int = SKETCH) -> DataFrame:
    """``keys, n, esboco``: a mergeable quantile sketch of the scores of each key."""
    return df.where(F.col("p").isNotNull() & F.col("y").isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col("p").cast("double"), F.lit(size)).alias("esboco"))


def merged_sketches(sketches: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Sketches of coarser keys from stored ones."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("esboco").alias("esboco"))


def sketch_edges(sketches: DataFrame, bins: int, keys: list[str] = ()) -> DataFrame:
    """``inner`` edges of each key at the sketch's quantiles; an edge's rank errs as the sketch does."""
    at = F.array(*(F.lit(i / bins) for i in range(1, bins)))
    return sketches.where("n > 0").select(*keys, F.array_sort(F.array_distinct(F.kll_sketch_get_quantile_double("esboco", at))).alias("inner"))


def row_reliability(df: DataFrame, edges: DataFrame, keys: list[str] = ()) -> DataFrame:
    """The reliability curve summed from rows: scores that are all different need no levels."""
    rows = df.where(F.col("p").isNotNull() & F.col("y").isNotNull()).select(*keys, "p", F.col("y").cast("long").alias("pos"), (1 - F.col("y")).cast("long").alias("neg"))
    return level_reliability(rows, edges, keys)


def reliability(df: DataFrame, edges: DataFrame | list[float], keys: list[str] = ()) -> DataFrame:
    return level_reliability(levels(df, keys), edges, keys)


def level_reliability(lv: DataFrame, edges: DataFrame | list[float], keys: list[str] = ()) -> DataFrame:
    n = F.sum(F.col("pos") + F.col("neg"))
    per = with_edges(lv, edges, keys).groupBy(*keys, "faixa_p").agg(n.alias("n"), F.round(F.sum(F.col("p") * (F.col("pos") + F.col("neg"))) / n + 1e-9, 6).alias("media_p"), F.round(F.sum("pos") / n, 6).alias("observado"))
    if keys or not isinstance(edges, list):
        return per
    every = lv.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("faixa_p"))
    return every.join(per, "faixa_p", "left").na.fill(0, ["n"])


def calibration_errors(curve: DataFrame, keys: list[str] = ()) -> DataFrame:
    gap = F.abs(F.col("media_p") - F.col("observado"))
    filled = curve.where("n > 0")
    return filled.groupBy(*keys).agg(F.round(F.sum(F.col("n") * gap) / F.sum("n"), 5).alias("ece"), F.round(F.max(gap), 5).alias("mce"))


def brier_parts(df: DataFrame, edges: DataFrame | list[float], keys: list[str] = ()) -> DataFrame:
    n = F.sum(F.col("pos") + F.col("neg"))
    lv = levels(df, keys)
    per = with_edges(lv, edges, keys).groupBy(*keys, "faixa_p").agg(n.alias("n"), (F.sum(F.col("p") * (F.col("pos") + F.col("neg"))) / n).alias("mp"), (F.sum("pos") / n).alias("my"))
    base = lv.groupBy(*keys).agg((F.sum("pos") / n).alias("base"))
    both = per.join(base, list(keys)) if keys else per.crossJoin(F.broadcast(base))  # one row
    return both.groupBy(*keys).agg(F.round(F.sum(F.col("n") * (F.col("mp") - F.col("my")) ** 2) / F.sum("n"), 6).alias("confiabilidade"), F.round(F.sum(F.col("n") * (F.col("my") - F.col("base")) ** 2) / F.sum("n"), 6).alias("resolucao"), F.round(F.max(F.col("base") * (1 - F.col("base"))), 6).alias("incerteza"))


STEPS_A_TABLE = 4  # Newton steps between two written states
FEW_KEYS = 100_000  # states that are broadcast; beyond it the join shuffles


def slopes(lv: DataFrame, keys: list[str] = (), steps: int = 12, eps: float = 1e-6) -> DataFrame:
    """``inclinacao``: slope of an unpenalised logistic model of the outcome on the logit of the score, for each key; null for one class.

    Newton steps for all keys at once: each joins the levels, which the caller has stored, to the state of the step before and
    sums them by key. The state is a table that the driver never sees.
    """
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col("p")))
    own = [*keys, "_k"]
    rows = lv.select(*keys, F.lit(1).alias("_k"), F.log(q / (1 - q)).alias("x"), "pos", (F.col("pos") + F.col("neg")).alias("n"))
    state = rows.groupBy(*own).agg(F.sum("pos").alias("_p"), F.sum("n").alias("_n")).where("_p > 0 and _p < _n").select(*own, F.lit(0.0).alias("a"), F.lit(1.0).alias("b"))
    state = io.stored(state, "slopes")
    few = state.count() <= FEW_KEYS
    for i in range(steps):
        m = 1 / (1 + F.exp(-(F.col("a") + F.col("b") * F.col("x"))))
        w, gap = F.col("n") * m * (1 - m), F.col("pos") - F.col("n") * m
        both = rows.join(F.broadcast(state) if few else state, own)
        sums = both.groupBy(*own, "a", "b").agg(F.sum(gap).alias("g0"), F.sum(gap * F.col("x")).alias("g1"), F.sum(w).alias("h0"), F.sum(w * F.col("x")).alias("h1"), F.sum(w * F.col("x") ** 2).alias("h2"))
        det = F.col("h0") * F.col("h2") - F.col("h1") * F.col("h1")
        moved = lambda now, step: F.when(det > 0, F.col(now) + step / det).otherwise(F.col(now)).alias(now)
        state = sums.select(*own, moved("a", F.col("h2") * F.col("g0") - F.col("h1") * F.col("g1")), moved("b", F.col("h0") * F.col("g1") - F.col("h1") * F.col("g0")))
        if i % STEPS_A_TABLE == STEPS_A_TABLE - 1:
            state = io.stored(state, "slopes")
    return state.select(*keys, F.round("b", 5).alias("inclinacao"))


def calibration_summary(df: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """n, prevalence, O/E, slope, ECE and MCE on quantile bins and Brier score of each key, all from levels stored once."""
    lv = io.stored(levels(df, keys), "levels")
    errors = calibration_errors(level_reliability(lv, quantile_edges(lv, bins, keys), keys), keys)
    facts = per_level(lv, keys).select(*keys, "n", "positivos", "prevalencia", "oe", "brier")
    return facts.join(errors, keys).join(slopes(lv, keys), keys, "left")


# --- bootstrap

def whole_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """The metrics of all rows of each key that has both classes."""
    lv = levels(df, keys)
    b = per_level(lv, keys).select(*keys, "n", "positivos", "brier", "oe")
    out = discrimination(lv, keys).join(b, keys).where("roc_auc is not null and pr_auc is not null")
    return out.withColumn("pr_relativa", F.round(F.col("pr_auc") * F.col("n") / F.col("positivos"), 6)).drop("n", "positivos")


def bootstrap(df: DataFrame, unit: str, metrics_: list[str], replicates: int, seed: str, keys: list[str] = (), alpha: float = 0.05, written: bool = False) -> DataFrame:
    """``metrica, estimativa, replicas, baixo, alto`` by key: the estimate on all rows, and percentiles of the valid replicates.

    written: the rows are cheap to read again, so they are not written.
    """
    df = df.select(*keys, unit, "y", "p")
    df = df if written else io.stored(df, "bootstrap")
    reps = resample.replicate_metrics(df, unit, replicates, seed, keys)
    whole = whole_metrics(df, keys) if keys else whole_metrics(df.withColumn("_all", F.lit(1)), ["_all"]).drop("_all")
    est = whole.unpivot(list(keys), metrics_, "metrica", "estimativa")
    long = reps.unpivot([*keys, "rep"], metrics_, "metrica", "v")
    ends = long.groupBy(*keys, "metrica").agg(F.count("v").alias("replicas"), F.round(F.percentile("v", alpha / 2) + 1e-9, 5).alias("baixo"), F.round(F.percentile("v", 1 - alpha / 2) + 1e-9, 5).alias("alto"))
    return est.join(ends, [*keys, "metrica"], "left")


def bootstrap_difference(df: DataFrame, unit: str, p_b: Column, metrics_: list[str], replicates: int, seed: str, keys: list[str] = (), alpha: float = 0.05) -> DataFrame:
    """Estimate, interval and two-sided p of the difference between p and another score over the same draws."""
    of = [*keys, "_score"]
    scores = F.inline(F.array(F.struct(F.lit("a").alias("_score"), F.col("p").alias("p")), F.struct(F.lit("b").alias("_score"), p_b.alias("p"))))
    rows = io.stored(df.select(*keys, unit, "y", scores), "pairs")

    def gap(found: DataFrame, ids: list[str], digits: int, name: str) -> DataFrame:
        long = found.unpivot([*ids, "_score"], metrics_, "metrica", "v").groupBy(*ids, "metrica").agg(F.max(F.when(F.col("_score") == "a", F.col("v"))).alias("a"), F.max(F.when(F.col("_score") == "b", F.col("v"))).alias("b"))
        return long.where("a is not null and b is not null").select(*ids, "metrica", F.round(F.col("a") - F.col("b"), digits).alias(name))

    k = [*keys, "metrica"]
    d = gap(resample.replicate_metrics(rows, unit, replicates, seed, of), [*keys, "rep"], 9, "d")
    low, high = F.avg((F.col("d") <= 0).cast("int")), F.avg((F.col("d") >= 0).cast("int"))
    ends = d.groupBy(*k).agg(F.count("d").alias("replicas"), F.round(F.percentile("d", alpha / 2) + 1e-9, 5).alias("baixo"), F.round(F.percentile("d", 1 - alpha / 2) + 1e-9, 5).alias("alto"), F.round(F.least(F.lit(1.0), 2 * F.least(low, high)), 5).alias("p_valor"))
    return gap(whole_metrics(rows, of), list(keys), 6, "diferenca").join(ends, k, "left")


def mean_difference(df: DataFrame, unit: str, value: str, replicates: int, seed: str, alpha: float = 0.05) -> DataFrame:
    """Mean of a value among positives less that among negatives, with its interval over draws of units."""
    of = lambda v, c: F.when(F.col("y") == v, c)
    sums = [c for v in (1, 0) for c in (of(v, F.col(value)), of(v, F.when(F.col(value).isNotNull(), 1)))]
    rows = io.stored(df.select(unit, "y", value), "means")
    mean = lambda s, n: F.try_divide(F.col(s), F.col(n))
    gap = mean("v0", "v1") - mean("v2", "v3")
    reps = resample.weighted_sums(rows, unit, sums, replicates, seed).select(gap.alias("d"))
    ends = reps.agg(F.count("d").alias("replicas"), F.round(F.percentile("d", alpha / 2) + 1e-9, 5).alias("baixo"), F.round(F.percentile("d", 1 - alpha / 2) + 1e-9, 5).alias("alto"))
    return rows.agg(*(F.sum(c).alias(f"v{i}") for i, c in enumerate(sums))).select(F.round(gap, 5).alias("diferenca")).crossJoin(ends)  # one row each


def stratum_table(df: DataFrame, unit: str, strata: Column, metrics_: list[str], replicates: int, seed: str, least: int, least_class: int) -> DataFrame:
    """Metrics of each model in each stratum, with intervals and O/E relative to all (``todos``).

    df: ``y, unit`` and an array ``scores`` of (modelo, p). Strata with few rows, or few of a class, keep their counts only.
    """
    keys = ["estrato", "modelo"]
    rows = df.withColumn("_stratum", strata).select(unit, "y", F.inline("scores"), "_stratum").select(unit, "y", "modelo", "p", F.explode(F.array(F.lit(ALL), "_stratum")).alias("estrato")).where("estrato is not null")
    rows = io.stored(rows, "strata")
    facts = per_level(levels(rows, keys), keys).select(*keys, "n", "positivos", "prevalencia")
    few = (F.col("n") < least) | (F.col("positivos") < least_class) | (F.col("n") - F.col("positivos") < least_class)
    facts = io.stored(facts.withColumn("suprimido", few), "strata-facts")  # a row for each stratum and model
    boot = io.stored(bootstrap(rows.join(F.broadcast(facts.where("not suprimido").select(*keys)), keys), unit, metrics_, replicates, seed, keys, written=True), "strata-intervals")  # a row for each stratum, model and metric
    out = facts.withColumn("metrica", F.explode(F.array(*map(F.lit, metrics_)))).join(boot, [*keys, "metrica"], "left")
    total = boot.where("estrato = 'todos' and metrica = 'oe'").select("modelo", F.col("estimativa").alias("_t"))
    ratio = F.when(F.col("metrica") == "oe", F.round(F.try_divide(F.col("estimativa"), F.col("_t")), 5))
    return out.join(F.broadcast(total), "modelo", "left").withColumn("relativo_ao_total", ratio).drop("_t")
