"""Fitting and scoring with MLlib."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import ElementwiseProduct, Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.functions import tails
from riskloom.functions.codes import MISSING
from riskloom.operators import evaluate
from riskloom.sources import io

SEED = 7
OUTCOME = ("y", "p")  # no feature of any fit, beside what leaks


def usable(df: DataFrame, columns: list[str], strict: bool = True) -> list[str]:
    """The columns that the table has; strict: an error if it lacks any."""
    if strict and (lacking := [c for c in columns if c not in df.columns]):
        raise ValueError(f"missing columns: {lacking}")
    return [c for c in columns if c in df.columns]


def preprocessor(numeric: list[str], categorical: list[str], one_hot: bool = True) -> list:
    """Median imputation, scaling without centring, and encoded categories; unseen ones are kept apart."""
    n, stages = [f"{c}_n" for c in numeric], []
    if numeric:
        stages = [Imputer(strategy="median", inputCols=numeric, outputCols=n), VectorAssembler(inputCols=n, outputCol="_num"), StandardScaler(inputCol="_num", outputCol="_scaled", withMean=False)]
    i = [f"{c}_i" for c in categorical]
    if categorical:
        stages.append(StringIndexer(inputCols=categorical, outputCols=i, handleInvalid="keep", stringOrderType="alphabetAsc"))
        if one_hot:
            stages.append(OneHotEncoder(inputCols=i, outputCols=[f"{c}_h" for c in categorical], dropLast=False, handleInvalid="keep"))
    last = [f"{c}_h" for c in categorical] if one_hot else i
    return [*stages, VectorAssembler(inputCols=[*(["_scaled"] if numeric else []), *last], outputCol="features")]


def estimator(name: str, rows: int, c: float = 1.0, l1: float = 0.0, weight: str | None = None, rate: float = 0.05, depth: int = 6):
    common = {"labelCol": "y", "featuresCol": "features", **({"weightCol": weight} if weight else {})}
    if name == "lr":
        return LogisticRegression(regParam=1 / (c * max(rows, 1)), elasticNetParam=l1, standardization=False, maxIter=50, **common)
    if name == "gbt":
        return GBTClassifier(maxDepth=depth, maxIter=500, stepSize=rate, validationTol=1e-3, minInstancesPerNode=20, validationIndicatorCol="valida", seed=SEED, **common)  # rounds end by the validation rows
    if name == "tree":
        return DecisionTreeClassifier(maxDepth=5, minInstancesPerNode=20, seed=SEED, **common)
    return RandomForestClassifier(numTrees=20, maxDepth=6, minInstancesPerNode=10, seed=SEED, **common)


def fit(df: DataFrame, name: str, numeric: list[str], categorical: list[str], strict: bool = True, **options) -> PipelineModel:
    """The fitted stages and model. A linear model reads a row for all rows alike, with their number as its weight, which
    has the same optimum; trees sample rows, so they read all of them, with features written once."""
    numeric, categorical = usable(df, numeric, strict), usable(df, categorical, strict)
    if name == "lr":
        before, alike, n = linear_rows(df, numeric, categorical, {options.get("weight")})
        return PipelineModel(stages=[*before.stages, fit_linear(alike, n, **options)])
    io.guard([*numeric, *categorical], OUTCOME, numeric, categorical)
    rows = df.na.fill(MISSING, categorical)
    before = Pipeline(stages=preprocessor(numeric, categorical, one_hot=False)).fit(rows)
    more = [c for c in (options.get("weight"), "valida" if name == "gbt" else None) if c]
    made = before.transform(rows).select("y", "features", *more)
    kept = io.stored(made, "fit-features")
    found = estimator(name, df.count(), **options).fit(kept.withMetadata("features", made.schema["features"].metadata))
    return PipelineModel(stages=[*before.stages, found])


def linear_rows(df: DataFrame, numeric: list[str], categorical: list[str], weights: set[str | None]) -> tuple[PipelineModel, DataFrame, int]:
    """What linear fits on the same columns share: the fitted stages before them, the features of a row for all rows
    alike with their number (``_alike``) and sums of the weights (``_alike_`` and the weight), and how many rows there are."""
    io.guard([*numeric, *categorical], OUTCOME, numeric, categorical)
    rows = df.na.fill(MISSING, categorical)
    before = Pipeline(stages=preprocessor(numeric, categorical)).fit(rows)
    sums = [F.sum(w).cast("double").alias(f"_alike_{w}") for w in sorted(w for w in weights if w)]
    alike = io.stored(rows.groupBy(*numeric, *categorical, "y").agg(F.count("*").cast("double").alias("_alike"), *sums), "alike")
    n = alike.agg(F.coalesce(F.sum("_alike"), F.lit(0.0))).first()[0]
    return before, before.transform(alike), int(n)


def fit_linear(alike: DataFrame, n: int, weight: str | None = None, **options):
    return estimator("lr", n, weight=f"_alike_{weight}" if weight else "_alike", **options).fit(alike)


def score(model: PipelineModel, df: DataFrame, categorical: list[str]) -> DataFrame:
    out = model.transform(df.na.fill(MISSING, categorical))
    return out.withColumn("p", F.round(vector_to_array("probability")[1], 9))


def prior(train: DataFrame, df: DataFrame) -> DataFrame:
    return df.withColumn("p", F.lit(train.agg(F.avg("y")).first()[0]))


def score_levels(held: DataFrame, p: str = "p", weight: str | None = None) -> DataFrame:
    """``p, y, _n``: each score and outcome with its number of rows, written once; weight: a column of such numbers."""
    return io.stored(held.groupBy(p, "y").agg((F.sum(weight) if weight else F.count("*")).cast("double").alias("_n")), "score-levels")


def sigmoid_calibration(held: DataFrame, df: DataFrame, p: str = "p", weight: str | None = None) -> DataFrame:
    """Platt scaling of the logit with soft targets: two weighted copies of each level of the score."""
    held = score_levels(held, p, weight)
    n1, n0 = held.agg(F.sum(F.col("y") * F.col("_n")), F.sum((1 - F.col("y")) * F.col("_n"))).first()
    t = F.when(F.col("y") == 1, (n1 + 1) / (n1 + 2)).otherwise(1 / (n0 + 2))
    margin = lambda d: VectorAssembler(inputCols=["m"], outputCol="f").transform(d.withColumn("m", logit(p)))
    copies = F.array(F.struct(F.lit(1.0).alias("l"), (t * F.col("_n")).alias("w")), F.struct(F.lit(0.0).alias("l"), ((1 - t) * F.col("_n")).alias("w")))
    model = LogisticRegression(featuresCol="f", labelCol="l", weightCol="w", standardization=False).fit(margin(held).select("f", F.explode(copies).alias("s")).select("f", "s.*"))
    return model.transform(margin(df)).withColumn("p_cal", vector_to_array("probability")[1]).drop("m", "f", "rawPrediction", "probability", "prediction")


def isotonic_calibration(held: DataFrame, df: DataFrame, p: str = "p", weight: str | None = None) -> DataFrame:
    vec = lambda d: VectorAssembler(inputCols=[p], outputCol="f").transform(d)
    model = IsotonicRegression(featuresCol="f", labelCol="y", weightCol="_n", predictionCol="p_cal").fit(vec(score_levels(held, p, weight)))
    return model.transform(vec(df)).drop("f")


def logit(p: str, eps: float = 1e-6):
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col(p)))
    return F.log(q / (1 - q))


def scored_sets(train: DataFrame, valid: DataFrame, candidates: dict[str, dict], numeric: list[str], categorical: list[str]) -> DataFrame:
    """Validation rows with the score of each candidate: ``candidato`` and ``p`` added. Linear candidates on the same
    columns share what comes before their fits and one reading of the validation rows."""
    parts, linear = [], {}
    for name, options in candidates.items():
        o = dict(options)
        kind, n, c = o.pop("name"), o.pop("numeric", numeric), o.pop("categorical", categorical)
        if kind == "lr":
            linear.setdefault((tuple(n), tuple(c)), {})[name] = o
        else:
            parts.append(score(fit(train, kind, n, c, **o), valid, c).select(F.lit(name).alias("candidato"), *valid.columns, "p"))
    for (n, c), own in linear.items():
        n, c = usable(train, list(n)), usable(train, list(c))
        before, alike, many = linear_rows(train, n, c, {o.get("weight") for o in own.values()})
        rows, told = before.transform(valid.na.fill(MISSING, c)), []
        for i, (name, o) in enumerate(own.items()):
            rows = fit_linear(alike, many, **o).setProbabilityCol(f"_p{i}").setRawPredictionCol("").setPredictionCol("").transform(rows)
            told.append(F.struct(F.lit(name).alias("candidato"), F.round(vector_to_array(f"_p{i}")[1], 9).alias("p")))
        parts.append(rows.select(*valid.columns, F.inline(F.array(*told))).select("candidato", *valid.columns, "p"))
    out = None
    for rows in parts:
        out = rows if out is None else out.unionByName(rows)
    return out


def search(scored: DataFrame) -> DataFrame:
    """Metrics of each candidate, best first."""
    row = evaluate.metrics(scored, 0.5, ["candidato"]).select("candidato", "n", "roc_auc", "pr_auc", "brier")
    return row.orderBy(F.desc("pr_auc"), "brier", "candidato")


def against(table: DataFrame, reference: str, metrics_: list[str]) -> DataFrame:
    """Add the difference of each metric from the reference candidate's."""
    ref = F.broadcast(table.where(F.col("candidato") == reference).select(*(F.col(m).alias(f"_{m}") for m in metrics_)))  # one row
    both = table.crossJoin(ref)
    return both.select(*table.columns, *(F.round(F.col(m) - F.col(f"_{m}"), 6).alias(f"dif_{m}") for m in metrics_))


def balanced(df: DataFrame, y: str = "y") -> DataFrame:
    """Add ``peso``: weights by which both classes count alike."""
    n = df.agg(F.count("*").alias("_n"), F.sum(y).alias("_p"))
    weight = F.when(F.col(y) == 1, F.try_divide(F.col("_n"), 2 * F.col("_p"))).otherwise(F.try_divide(F.col("_n"), 2 * (F.col("_n") - F.col("_p"))))
    return df.crossJoin(F.broadcast(n)).withColumn("peso", weight.cast("double")).drop("_n", "_p")  # one row


def cluster_features(df: DataFrame, numeric: list[str], categorical: list[str], alike: bool = False) -> tuple[DataFrame, dict[str, float]]:
    """Rows with ``weighted`` features, and the weights by column; alike: a row for all with the same features, ``peso`` how many.

    The one-hot block of a column weighs 1 / sqrt(its categories); numbers, centred and scaled, weigh
    the square root of the mean variance of the weighted blocks.
    """
    filled = df.na.fill(MISSING, categorical)
    long = filled.select(*categorical).unpivot([], categorical, "c", "v").groupBy("c", "v").agg(F.count("*").alias("n"))
    sums = {r["c"]: (r["k"], 1 - r["q"] / max(1, r["t"]) ** 2) for r in long.groupBy("c").agg(F.count("*").alias("k"), F.sum("n").alias("t"), F.sum(F.col("n").cast("double") ** 2).alias("q")).collect()}
    weights = {c: sums[c][0] ** -0.5 for c in categorical if c in sums}
    spread = sum(v / k for k, v in sums.values()) / max(1, len(categorical))
    weights |= {c: spread**0.5 if spread > 0 else 1.0 for c in numeric}
    n, i, h = ([f"{c}_{x}" for c in cs] for cs, x in ((numeric, "n"), (categorical, "i"), (categorical, "h")))
    stages = [Imputer(strategy="median", inputCols=numeric, outputCols=n), VectorAssembler(inputCols=n, outputCol="_num"), StandardScaler(inputCol="_num", outputCol="_scaled", withMean=True),
              StringIndexer(inputCols=categorical, outputCols=i, handleInvalid="keep", stringOrderType="alphabetAsc"), OneHotEncoder(inputCols=i, outputCols=h, dropLast=False), VectorAssembler(inputCols=["_scaled", *h], outputCol="features")]
    fitted = Pipeline(stages=stages).fit(filled)
    w = [weights[c] for c in numeric] + [weights[c] for c, size in zip(categorical, fitted.stages[4].categorySizes, strict=True) for _ in range(size)]
    if alike:
        filled = io.stored(filled.groupBy(*numeric, *categorical).agg(F.count("*").cast("double").alias("peso")), "alike")
    out = ElementwiseProduct(scalingVec=Vectors.dense(w), inputCol="features", outputCol="weighted").transform(fitted.transform(filled))
    return (io.stored(out.select(*numeric, *categorical, "peso", "weighted"), "clustered") if alike else out), weights


def kmeans(df: DataFrame, k: int, column: str, weight: str | None = None) -> DataFrame:
    own = {"weightCol": weight} if weight else {}
    return KMeans(k=k, seed=SEED, featuresCol=column, predictionCol="cluster", maxIter=15, **own).fit(df).transform(df)


def silhouettes(df: DataFrame, ks: tuple[int, ...], column: str, weight: str | None = None) -> DataFrame:
    """Silhouette of each number of clusters; weight: a column of how many rows a row stands for."""
    rows = [(k, float(ClusteringEvaluator(featuresCol=column, predictionCol="cluster", **({"weightCol": weight} if weight else {})).evaluate(kmeans(df, k, column, weight)))) for k in ks]
    return df.sparkSession.createDataFrame(rows, "k int, silhueta double")


def cramers_v(df: DataFrame, cluster: str, categorical: list[str], weight: str | None = None) -> DataFrame:
    """Chi-square and Cramer's V of each categorical column against the clusters; weight: how many rows a row stands for."""
    w = (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_w")
    long = df.select(cluster, *categorical, w).unpivot([cluster, "_w"], categorical, "variavel", "valor")
    cells = io.stored(long.groupBy("variavel", cluster, "valor").agg(F.sum("_w").alias("o")), "cells")  # columns x clusters x values; doubles, as products pass 64 bits
    rows = cells.groupBy("variavel", cluster).agg(F.sum("o").alias("r"))
    cols = cells.groupBy("variavel", "valor").agg(F.sum("o").alias("c"))
    n = cells.groupBy("variavel").agg(F.sum("o").alias("n"), F.count_distinct("valor").alias("kv"), F.count_distinct(cluster).alias("kc"))
    joined = cells.join(rows, ["variavel", cluster]).join(cols.withColumnRenamed("valor", "v2"), (cells["variavel"] == cols["variavel"]) & F.col("valor").eqNullSafe(F.col("v2"))).drop(cols["variavel"]).join(n, "variavel")
    # sum of o^2 / e less n is the chi-square over all cells, empty ones included
    chi = joined.groupBy("variavel").agg((F.sum(F.col("o") * F.col("o") * F.col("n") / (F.col("r") * F.col("c"))) - F.max("n")).alias("qui2"), F.max("n").alias("n"), F.least(F.max("kv"), F.max("kc")).alias("k"))
    return chi.select("variavel", F.round("qui2", 4).alias("qui2"), F.round(F.sqrt(F.try_divide(F.col("qui2"), F.col("n") * (F.col("k") - 1))), 5).alias("v_cramer"))


def eta_squared(df: DataFrame, cluster: str, numeric: list[str], weight: str | None = None) -> DataFrame:
    """Share of each numeric column's variance between clusters; weight: how many rows a row stands for."""
    w = (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_w")
    long = df.select(cluster, *(F.col(c).cast("double").alias(c) for c in numeric), w).unpivot([cluster, "_w"], numeric, "variavel", "v").where("v is not null")
    per = long.groupBy("variavel", cluster).agg(F.sum("_w").alias("n"), F.sum(F.col("_w") * F.col("v")).alias("s"), F.sum(F.col("_w") * F.col("v") ** 2).alias("q"))
    return per.groupBy("variavel").agg(F.round(F.try_divide(F.sum(F.col("s") ** 2 / F.col("n")) - F.sum("s") ** 2 / F.sum("n"), F.sum("q") - F.sum("s") ** 2 / F.sum("n")), 5).alias("eta2"))


def association_tests(df: DataFrame, group: str, categorical: list[str], numeric: list[str]) -> DataFrame:
    """``variavel, teste, estatistica, gl1, gl2, efeito`` of each column against a grouping, all columns in one pass.

    Categories, null one of them: chi-square and Cramer's V. Numbers, null left out: F of the analysis of variance and
    eta squared. Null where a column or the grouping has one value.
    """
    of = [F.struct(F.lit(c).alias("variavel"), F.lit("qui2").alias("teste"), F.col(c).cast("string").alias("v"), F.lit(None).cast("double").alias("x")) for c in categorical]
    of += [F.struct(F.lit(c).alias("variavel"), F.lit("f").alias("teste"), F.lit(None).cast("string").alias("v"), F.col(c).cast("double").alias("x")) for c in numeric]
    long = df.select(F.col(group).alias("g"), F.explode(F.array(*of)).alias("r")).select("g", "r.*").where("teste = 'qui2' or x is not null")
    cells = long.groupBy("variavel", "teste", "g", "v").agg(F.count("*").alias("o"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    cells = io.stored(cells, "cells")  # columns x groups x values
    over = lambda *k: W.partitionBy("variavel", "teste", *k)
    chi = cells.where("teste = 'qui2'").withColumns({"r": F.sum("o").over(over("g")), "c": F.sum("o").over(over("v")), "n": F.sum("o").over(over())})
    chi = chi.groupBy("variavel", "teste").agg((F.sum(F.col("o").cast("double") * F.col("o") * F.col("n") / (F.col("r") * F.col("c"))) - F.max("n")).alias("x2"), F.max("n").alias("n"), F.count_distinct(F.struct("v")).alias("kv"), F.count_distinct(F.struct("g")).alias("kg"))
    least = F.least("kv", "kg") - 1
    chi = chi.select("variavel", "teste", F.when(least > 0, F.round("x2", 4)).alias("estatistica"), ((F.col("kv") - 1) * (F.col("kg") - 1)).alias("gl1"), F.lit(None).cast("long").alias("gl2"), F.when(least > 0, F.round(F.sqrt(F.col("x2") / (F.col("n") * least)), 5)).alias("efeito"))
    f = cells.where("teste = 'f'").groupBy("variavel", "teste").agg(F.sum("o").alias("n"), F.count("*").alias("k"), (F.sum(F.col("s") * F.col("s") / F.col("o")) - F.sum("s") * F.sum("s") / F.sum("o")).alias("b"), (F.sum("q") - F.sum(F.col("s") * F.col("s") / F.col("o"))).alias("w"))
    ratio = F.try_divide(F.col("b") / F.nullif(F.col("k") - 1, F.lit(0)), F.col("w") / F.nullif(F.col("n") - F.col("k"), F.lit(0)))
    f = f.select("variavel", "teste", F.round(ratio, 4).alias("estatistica"), (F.col("k") - 1).alias("gl1"), (F.col("n") - F.col("k")).alias("gl2"), F.round(F.try_divide(F.col("b"), F.col("b") + F.col("w")), 5).alias("efeito"))
    return chi.unionByName(f)


def p_values(tests: DataFrame) -> DataFrame:
    """Add ``p_valor`` to ``association_tests``, a row a column: the upper tail of the test's distribution."""
    def tail(statistic: pd.Series, one: pd.Series, two: pd.Series) -> pd.Series:
        found = [None if pd.isna(x) or not a or a <= 0 else tails.chi2_tail(x, a) if pd.isna(b) else tails.f_tail(x, a, b) for x, a, b in zip(statistic, one, two, strict=True)]
        return pd.Series(found, dtype="float64")

    return tests.withColumn("p_valor", F.pandas_udf(tail, "double")("estatistica", "gl1", "gl2"))


for _m in (tails, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(_m)  # executors need no copy of the package
