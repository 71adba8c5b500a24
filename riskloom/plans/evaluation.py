"""Queries over scored episodes: discrimination, thresholds, calibration, groups, bootstrap."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from riskloom.functions import codes
from riskloom.operators import evaluate, profile, standard
from riskloom.plans.cohort import SQL_COARSE
from riskloom.sources import io
from riskloom.sources.episodes import SQL_SCORED, scored

QUERIES: dict = {}
SQL: dict = {}
T = 0.5
CUTS = np.linspace(0.01, 0.99, 101).tolist()
NET = evaluate.grid(0.02, 0.40, 20)
EDGES = [0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9]
NUMERIC = ["idade", "completude"]
REPLICATES, STRATUM_REPLICATES, LEAST_ROWS, LEAST_CLASS = 1000, 500, 100, 30
SC = f"WITH {SQL_SCORED}"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _literals(values) -> str:
    return "[" + ", ".join(f"{v!r}::DOUBLE" for v in values) + "]"


def _ratio(a: str, b: str) -> str:
    return f"round(coalesce(({a})::DOUBLE / nullif({b}, 0), 0), 6)"


RATES = ", ".join(f"{_ratio(a, b)} AS {c}" for c, a, b in (("precisao", "vp", "vp + fp"), ("recall", "vp", "vp + fn"), ("especificidade", "vn", "vn + fp"), ("f1", "2 * vp", "2 * vp + fp + fn"), ("acuracia", "vp + vn", "vp + fp + fn + vn")))
COUNTS = f"count(*) FILTER (p >= {T} AND y = 1) AS vp, count(*) FILTER (p >= {T} AND y = 0) AS fp, count(*) FILTER (p < {T} AND y = 1) AS fn, count(*) FILTER (p < {T} AND y = 0) AS vn"


def _running(src: str, keys: str = "") -> str:
    """Level sums and totals of (y, p[, w]) rows of a table, by keys."""
    by, part = (f"{keys}, ", f"PARTITION BY {keys}") if keys else ("", "")
    return f"""lv AS (SELECT {by}p, sum(y)::BIGINT AS pos, sum(1 - y)::BIGINT AS neg FROM {src} GROUP BY {by}p),
rn AS (SELECT *, sum(pos) OVER ({part} ORDER BY p DESC)::BIGINT AS tp, sum(neg) OVER ({part} ORDER BY p DESC)::BIGINT AS fp, sum(pos) OVER ({part})::BIGINT AS np, sum(neg) OVER ({part})::BIGINT AS nn FROM lv)"""


AUC = "round(sum(neg * (tp - 0.5::DOUBLE * pos)) / nullif(max(np)::DOUBLE * max(nn), 0), 6)"
AP = "CASE WHEN max(nn) > 0 THEN round(sum(pos::DOUBLE * tp / (tp + fp)) / nullif(max(np)::DOUBLE, 0), 6) END"


def _metrics(src: str, keys: str = "", least: int = 0) -> str:
    by = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    join = f"JOIN di USING ({keys})" if keys else ", di"
    small = lambda c, x: f"CASE WHEN n >= {least} THEN {x} END AS {c}" if least else f"{x} AS {c}"
    two = lambda x: f"CASE WHEN positivos NOT IN (0, n) THEN {x} END"
    cols = ["vp", "fp", "fn", "vn", "log_loss", "precisao", "recall", "especificidade", "f1", "acuracia"]
    return f"""{_running(src, keys)},
di AS (SELECT {by}{AUC} AS roc_auc, {AP} AS pr_auc FROM rn {group}),
fa AS (SELECT {by}count(*) AS n, sum(y)::BIGINT AS positivos, round(avg(y), 6) AS prevalencia, {COUNTS}, round(avg((y - p) * (y - p)), 6) AS brier,
  round(avg(-(y * ln(greatest(1e-15, least(1 - 1e-15, p))) + (1 - y) * ln(1 - greatest(1e-15, least(1 - 1e-15, p))))), 6) AS log_loss, round(sum(y) / nullif(sum(p), 0), 6) AS oe FROM {src} {group}),
ra AS (SELECT *, {RATES} FROM fa {join})
SELECT {by}n, positivos, prevalencia, {', '.join(small(c, c) for c in cols)}, {', '.join(small(c, two(c)) for c in ('roc_auc', 'pr_auc', 'brier', 'oe'))}, {small('pr_relativa', two('round(pr_auc / nullif(prevalencia, 0), 4)'))} FROM ra"""


@query(f"{SC} SELECT count(*) AS n, count(*) FILTER (p IS NULL OR isnan(p) OR p < 0 OR p > 1) AS invalidos FROM sc")
def score_validity(spark, d):
    bad = F.when(F.isnan("p"), 1).when(F.col("p").between(0, 1), 0).otherwise(1)
    return scored(spark, d).agg(F.count("*").alias("n"), F.sum(bad).cast("long").alias("invalidos"))


@query(f"{SC} SELECT coalesce(y::VARCHAR, 'total') AS real_, coalesce(h::VARCHAR, 'total') AS previsto, count(*) AS n FROM (SELECT y, (p >= {T})::INTEGER AS h FROM sc) GROUP BY CUBE (y, h)")
def confusion(spark, d):
    rows = scored(spark, d).select("y", (F.col("p") >= T).cast("int").alias("h"))
    return rows.cube("y", "h").agg(F.count("*").alias("n")).select(F.coalesce(F.col("y").cast("string"), F.lit("total")).alias("real_"), F.coalesce(F.col("h").cast("string"), F.lit("total")).alias("previsto"), "n")


@query(f"{SC}, {_metrics('sc')}")
def metric_row(spark, d):
    return evaluate.metrics(scored(spark, d), T)


@query(f"{SC}, {_running('sc')} SELECT {AUC} AS roc_auc FROM rn")
def roc_auc(spark, d):
    return evaluate.discrimination(evaluate.levels(scored(spark, d))).select("roc_auc")


@query(f"{SC}, {_running('sc')} SELECT {AP} AS pr_auc FROM rn")
def average_precision(spark, d):
    return evaluate.discrimination(evaluate.levels(scored(spark, d))).select("pr_auc")


@query(f"{SC} SELECT round(avg((y - p) * (y - p)), 6) AS brier FROM sc")
def brier(spark, d):
    return evaluate.per_level(evaluate.levels(scored(spark, d))).select("brier")


@query(f"{SC} SELECT round(avg(-(y * ln(greatest(1e-15, least(1 - 1e-15, p))) + (1 - y) * ln(1 - greatest(1e-15, least(1 - 1e-15, p))))), 6) AS log_loss FROM sc")
def log_loss(spark, d):
    return evaluate.per_level(evaluate.levels(scored(spark, d))).select("log_loss")


def _at(cuts) -> str:
    return f"cu AS (SELECT unnest({_literals(cuts)}) AS limiar), ct AS (SELECT limiar, count(*) FILTER (p >= limiar AND y = 1) AS vp, count(*) FILTER (p >= limiar AND y = 0) AS fp, count(*) FILTER (p < limiar AND y = 1) AS fn, count(*) FILTER (p < limiar AND y = 0) AS vn FROM cu, sc GROUP BY limiar)"


SWEEP = f"{SC}, {_at(CUTS)}, sw AS (SELECT *, {RATES} FROM ct)"


@query(f"{SWEEP} SELECT *, round(recall + especificidade - 1, 6) AS youden FROM sw")
def threshold_sweep(spark, d):
    return evaluate.sweep(scored(spark, d), CUTS)


@query(f"{SWEEP} SELECT *, round(recall + especificidade - 1, 6) AS youden FROM sw WHERE precisao >= 0.2 AND recall >= 0.5 ORDER BY f1 DESC, limiar LIMIT 1")
def threshold_choice(spark, d):
    return evaluate.choose(evaluate.sweep(scored(spark, d), CUTS), "f1", 0.2, 0.5)


@query(f"{SC}, {_running('sc')} SELECT p, {_ratio('tp', 'tp + fp')} AS precisao, {_ratio('tp', 'np')} AS recall, {_ratio('fp', 'nn')} AS fpr FROM rn")
def pr_roc_points(spark, d):
    return evaluate.curve_points(scored(spark, d))


@query(f"{SC}, {_at(NET)} SELECT limiar, round(vp / n - fp / n * (limiar / (1 - limiar)), 6) AS beneficio, round((vp + fn) / n - (fp + vn) / n * (limiar / (1 - limiar)), 6) AS tratar_todos, round(100 * (vp + fp) / n, 6) AS alertas_por_100 FROM (SELECT *, vp + fp + fn + vn AS n FROM ct)")
def decision_curve(spark, d):
    return evaluate.decision_curve(scored(spark, d), NET)


@query(f"{SC}, c AS (SELECT CASE WHEN p >= {T} AND y = 1 THEN 'VP' WHEN p >= {T} THEN 'FP' WHEN y = 1 THEN 'FN' ELSE 'VN' END AS classe, count(*) AS n FROM sc GROUP BY 1) SELECT classe, n, round(n / sum(n) OVER (), 6) AS fracao FROM c")
def error_classes(spark, d):
    return standard.error_classes(scored(spark, d), T)


@query(f"{SC} SELECT id, p FROM sc WHERE y = 1 AND p < {T} ORDER BY p DESC, id LIMIT 20")
def top_false_negatives(spark, d):
    return profile.top(scored(spark, d).where((F.col("y") == 1) & (F.col("p") < T)).select("id", "p"), 20, F.desc("p"), F.col("id"))


@query(f"{SC} SELECT regiao, sum(y)::BIGINT AS positivos, count(*) FILTER (y = 1 AND p < {T}) AS sem_alerta, round(count(*) FILTER (y = 1 AND p < {T}) / nullif(sum(y), 0), 6) AS fracao FROM sc GROUP BY regiao")
def fn_by_group(spark, d):
    return standard.missed_by(scored(spark, d), T, "regiao")


@query(f"{SC} " + " UNION ALL ".join(f"SELECT '{c}' AS variavel, round(avg({c}) FILTER (p < {T}), 5) AS media_fn, round(avg({c}) FILTER (p >= {T}), 5) AS media_vp, round(abs(avg({c}) FILTER (p < {T}) - avg({c}) FILTER (p >= {T})), 5) AS delta_abs FROM sc WHERE y = 1" for c in NUMERIC))
def fn_tp_means(spark, d):
    return standard.missed_against_found(scored(spark, d), T, NUMERIC)


BIN = f"len(list_filter({_literals(EDGES)}, lambda e: p > e))::INTEGER"
QEDGE = "qe AS (SELECT list_sort(list_distinct(quantile_cont(p, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM sc), qb AS (SELECT len(list_filter(e[2:len(e) - 1], lambda x: p > x))::INTEGER AS faixa_p, p, y FROM sc, qe)"
CURVE = "count(*) AS n, round(avg(p) + 1e-9, 6) AS media_p, round(avg(y), 6) AS observado"


@query(f"{SC}, b AS (SELECT {BIN} AS faixa_p, {CURVE} FROM sc GROUP BY 1) SELECT i::INTEGER AS faixa_p, coalesce(n, 0) AS n, media_p, observado FROM range(10) t(i) LEFT JOIN b ON b.faixa_p = i")
def reliability_width(spark, d):
    return evaluate.reliability(scored(spark, d), EDGES)


@query(f"{SC}, {QEDGE} SELECT faixa_p, {CURVE} FROM qb GROUP BY faixa_p")
def reliability_quantile(spark, d):
    df = scored(spark, d)
    return evaluate.reliability(df, evaluate.quantile_edges(evaluate.levels(df), 10))


@query()
def reliability_sketch_by_year(spark, d):
    """Reliability on quantile bins of each year and of all years, the latter from the years' sketches; ranks err by the sketch's bound."""
    df = io.stored(scored(spark, d).select(F.col("ano").cast("string").alias("ano"), "y", "p"), "sketched")
    per = io.stored(evaluate.score_sketches(df, ["ano"]), "sketches")
    whole = evaluate.merged_sketches(per.withColumn("ano", F.lit(evaluate.ALL)), ["ano"])
    rows = df.unionByName(df.withColumn("ano", F.lit(evaluate.ALL)))
    return evaluate.row_reliability(rows, evaluate.sketch_edges(per.unionByName(whole), 10, ["ano"]), ["ano"])


ERRORS = "round(sum(n * abs(media_p - observado)) / sum(n), 5) AS ece, round(max(abs(media_p - observado)), 5) AS mce"


@query(f"{SC}, {QEDGE}, w AS (SELECT {BIN} AS faixa_p, {CURVE} FROM sc GROUP BY 1), q AS (SELECT faixa_p, {CURVE} FROM qb GROUP BY 1) SELECT 'largura' AS faixas, {ERRORS} FROM w UNION ALL SELECT 'quantil', {ERRORS} FROM q")
def calibration_error(spark, d):
    df = scored(spark, d)
    curves = (("largura", EDGES), ("quantil", evaluate.quantile_edges(evaluate.levels(df), 10)))
    parts = [evaluate.calibration_errors(evaluate.reliability(df, e)).select(F.lit(n).alias("faixas"), "ece", "mce") for n, e in curves]
    return parts[0].unionByName(parts[1])


@query(f"{SC}, b AS (SELECT {BIN} AS faixa_p, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM sc GROUP BY 1), o AS (SELECT avg(y) AS base FROM sc) SELECT round(sum(n * (mp - my) * (mp - my)) / sum(n), 6) AS confiabilidade, round(sum(n * (my - base) * (my - base)) / sum(n), 6) AS resolucao, round(max(base * (1 - base)), 6) AS incerteza FROM b, o")
def brier_decomposition(spark, d):
    return evaluate.brier_parts(scored(spark, d), EDGES)


@query(f"{SC} SELECT round(sum(y) / sum(p), 6) AS oe FROM sc")
def oe_ratio(spark, d):
    return scored(spark, d).agg(F.round(F.try_divide(F.sum("y").cast("double"), F.sum("p")), 6).alias("oe"))


@query(f"{SC}, {_metrics('sc', 'regiao', 30)}")
def metrics_by_group(spark, d):
    return evaluate.metrics(scored(spark, d), T, ["regiao"], 30)


@query(f"{SC}, s2 AS (SELECT ano::INTEGER AS ano, y, p FROM sc), {_metrics('s2', 'ano')}")
def metrics_by_year(spark, d):
    return evaluate.metrics(scored(spark, d), T, ["ano"])


WINDOWS = (("A", (1995, 1998)), ("pandemia", (1996, 1997)), ("B", (1995, 1996, 1997, 1998)))
SQL_WINDOWS = ", ".join(f"('{w}', {y})" for w, ys in WINDOWS for y in ys)


@query(f"{SC}, jw(janela, ano) AS (VALUES {SQL_WINDOWS}), s2 AS (SELECT janela, y, p FROM sc JOIN jw USING (ano)), {_metrics('s2', 'janela')}")
def metrics_by_window(spark, d):
    bridge = spark.createDataFrame([(w, y) for w, ys in WINDOWS for y in ys], "janela string, ano int")
    return evaluate.metrics(scored(spark, d).join(bridge, "ano"), T, ["janela"])


def _curve_by(src: str, key: str) -> str:
    """Bins of equal width and at quantiles of each key."""
    qs = ", ".join(str(i / 10) for i in range(11))
    return f"""qe AS (SELECT {key}, list_sort(list_distinct(quantile_cont(p, [{qs}]))) AS e FROM {src} GROUP BY {key}),
qb AS (SELECT {key}, len(list_filter(e[2:len(e) - 1], lambda x: p > x))::INTEGER AS faixa_p, p, y FROM {src} JOIN qe USING ({key})),
qc AS (SELECT {key}, faixa_p, {CURVE} FROM qb GROUP BY ALL), wc AS (SELECT {key}, {BIN} AS faixa_p, {CURVE} FROM {src} GROUP BY ALL)"""


YEARS = f"{SC}, s2 AS (SELECT ano::INTEGER AS ano, y, p FROM sc)"


@query(f"{YEARS}, {_curve_by('s2', 'ano')} SELECT * FROM wc")
def reliability_by_year(spark, d):
    return evaluate.reliability(scored(spark, d), EDGES, ["ano"])


@query(f"{YEARS}, {_curve_by('s2', 'ano')} SELECT * FROM qc")
def reliability_quantile_by_year(spark, d):
    df = scored(spark, d)
    return evaluate.reliability(df, evaluate.quantile_edges(evaluate.levels(df, ["ano"]), 10, ["ano"]), ["ano"])


@query(f"""{YEARS}, {_curve_by('s2', 'ano')}, m AS (SELECT ano, {ERRORS} FROM wc GROUP BY ano), b AS (SELECT ano, {BIN} AS faixa_p, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM s2 GROUP BY ALL), o AS (SELECT ano, avg(y) AS base FROM s2 GROUP BY ano),
q AS (SELECT ano, round(sum(n * (mp - my) * (mp - my)) / sum(n), 6) AS confiabilidade, round(sum(n * (my - base) * (my - base)) / sum(n), 6) AS resolucao, round(max(base * (1 - base)), 6) AS incerteza FROM b JOIN o USING (ano) GROUP BY ano)
SELECT * FROM m JOIN q USING (ano)""")
def calibration_by_year(spark, d):
    df = scored(spark, d)
    return evaluate.calibration_errors(evaluate.reliability(df, EDGES, ["ano"]), ["ano"]).join(evaluate.brier_parts(df, EDGES, ["ano"]), "ano")


def _summary(src: str, key: str) -> str:
    """n, prevalence, O/E, Brier score and errors on quantile bins by key; the slope by twelve Newton steps."""
    steps = "".join(f""",
n{i} AS (SELECT {key}, a, b, sum(pos - n * m) AS g0, sum((pos - n * m) * x) AS g1, sum(n * m * (1 - m)) AS h0, sum(n * m * (1 - m) * x) AS h1, sum(n * m * (1 - m) * x * x) AS h2
  FROM (SELECT *, 1 / (1 + exp(-(a + b * x))) AS m FROM lx JOIN t{i} USING ({key})) GROUP BY {key}, a, b),
t{i + 1} AS (SELECT {key}, a + (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1) AS a, b + (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) AS b FROM n{i})""" for i in range(12))
    return f"""{_curve_by(src, key)}, er AS (SELECT {key}, {ERRORS} FROM qc GROUP BY {key}),
lx AS (SELECT {key}, ln(q / (1 - q)) AS x, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM (SELECT {key}, y, greatest(1e-6, least(1 - 1e-6, p)) AS q FROM {src}) GROUP BY ALL),
t0 AS (SELECT {key}, 0::DOUBLE AS a, 1::DOUBLE AS b FROM lx GROUP BY {key} HAVING sum(pos) BETWEEN 1 AND sum(n) - 1){steps},
fa AS (SELECT {key}, count(*) AS n, sum(y)::BIGINT AS positivos, round(avg(y), 6) AS prevalencia, round(sum(y) / nullif(sum(p), 0), 6) AS oe, round(avg((y - p) * (y - p)), 6) AS brier FROM {src} GROUP BY {key})
SELECT fa.*, ece, mce, round(b, 5) AS inclinacao FROM fa JOIN er USING ({key}) LEFT JOIN t12 USING ({key})"""


@query(f"{YEARS}, {_summary('s2', 'ano')}")
def calibration_summary_by_year(spark, d):
    return evaluate.calibration_summary(scored(spark, d), ["ano"])


@query(f"{SC}, jw(janela, ano) AS (VALUES {SQL_WINDOWS}), s2 AS (SELECT janela, y, p FROM sc JOIN jw USING (ano)), {_summary('s2', 'janela')}")
def calibration_summary_by_window(spark, d):
    bridge = spark.createDataFrame([(w, y) for w, ys in WINDOWS for y in ys], "janela string, ano int")
    return evaluate.calibration_summary(scored(spark, d).join(F.broadcast(bridge), "ano"), ["janela"])


@query(f"{SC} SELECT id, CASE WHEN ano IN (1996, 1997) THEN 'pandemico' WHEN ano IN (1995, 1998, 1999, 2000) THEN 'compartilhado' ELSE 'exploracao' END AS periodo FROM sc")
def period_labels(spark, d):
    return scored(spark, d).select("id", codes.period(F.col("ano"), (1996, 1997), (1995, 1998, 1999, 2000)).alias("periodo"))


MODELS = ["base", "idade", "quadrado"]
SQL_MODELS = "mo AS (SELECT 'base' AS modelo, id, y, p FROM sc UNION ALL SELECT 'idade', id, y, coalesce(least(1, greatest(0, idade / 120)), 0) FROM sc UNION ALL SELECT 'quadrado', id, y, p * p FROM sc)"


def models(spark, d, *more, by=None):
    """A row for each scored episode and model; by: a column by which episodes are dealt to all partitions first."""
    s = scored(spark, d)
    s = s.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), by) if by else s
    age = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("idade") / 120)), F.lit(0.0))
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("modelo"), c.alias("p")) for m, c in (("base", F.col("p")), ("idade", age), ("quadrado", F.col("p") * F.col("p"))))))
    return s.select("id", "y", *more, each.alias("m")).select("m.modelo", "id", "y", *more, "m.p")  # one scan for all models


@query(f"{SC}, {SQL_MODELS}, {_running('mo', 'modelo')}, a AS (SELECT modelo, {AUC} AS roc_auc, {AP} AS pr_auc FROM rn GROUP BY modelo) SELECT a.modelo, a.roc_auc, a.pr_auc, round(a.pr_auc - b.pr_auc, 6) AS delta_pr FROM a, a b WHERE b.modelo = 'base'")
def model_comparison(spark, d):
    per = evaluate.discrimination(evaluate.levels(models(spark, d), ["modelo"]), ["modelo"])
    base = per.where("modelo = 'base'").select(F.col("pr_auc").alias("b"))
    return per.crossJoin(F.broadcast(base)).select("modelo", "roc_auc", "pr_auc", F.round(F.col("pr_auc") - F.col("b"), 6).alias("delta_pr"))  # one row


MY = f"{SC}, {SQL_MODELS}, my AS (SELECT modelo, ano, mo.y, mo.p FROM mo JOIN (SELECT id, ano::INTEGER AS ano FROM sc) USING (id)), {_running('my', 'modelo, ano')}, a AS (SELECT modelo, ano, {AUC} AS roc_auc, {AP} AS pr_auc FROM rn GROUP BY modelo, ano)"


@query(MY + " " + " UNION ALL ".join(f"SELECT modelo, '{m}' AS metrica, min({m}) AS minimo, max({m}) AS maximo, round(avg({m}), 5) AS media, round(max({m}) - min({m}), 6) AS amplitude, count({m}) AS anos FROM a GROUP BY modelo" for m in ("roc_auc", "pr_auc")))
def metric_stability(spark, d):
    rows = models(spark, d, "ano")
    per = evaluate.discrimination(evaluate.levels(rows, ["modelo", "ano"]), ["modelo", "ano"]).unpivot(["modelo", "ano"], ["roc_auc", "pr_auc"], "metrica", "v")
    return per.groupBy("modelo", "metrica").agg(F.min("v").alias("minimo"), F.max("v").alias("maximo"), F.round(F.avg("v"), 5).alias("media"), F.round(F.max("v") - F.min("v"), 6).alias("amplitude"), F.count("v").alias("anos"))


@query(f"{SC}, {SQL_MODELS}, {_running('mo', 'modelo')}, a AS (SELECT modelo, {AUC} AS roc_auc, {AP} AS pr_auc FROM rn GROUP BY modelo), b AS (SELECT modelo, round(avg((y - p) * (y - p)), 6) AS brier FROM mo GROUP BY modelo) SELECT modelo, pr_auc, brier FROM a JOIN b USING (modelo) ORDER BY pr_auc DESC, brier, modelo LIMIT 2")
def model_shortlist(spark, d):
    per = evaluate.metrics(models(spark, d), T, ["modelo"]).select("modelo", "pr_auc", "brier")
    return profile.top(per, 2, F.desc("pr_auc"), F.col("brier"), F.col("modelo"))


@query(f"{MY} SELECT ano, modelo, roc_auc, pr_auc FROM a QUALIFY row_number() OVER (PARTITION BY ano ORDER BY pr_auc DESC, modelo) = 1")
def best_model_by_year(spark, d):
    per = evaluate.discrimination(evaluate.levels(models(spark, d, "ano"), ["modelo", "ano"]), ["modelo", "ano"])
    return profile.best_per(per, ["ano"], F.desc("pr_auc"), F.col("modelo")).select("ano", "modelo", "roc_auc", "pr_auc")


@query(f"{SC}, {SQL_MODELS}, {_running('mo', 'modelo')} SELECT modelo, p, {_ratio('tp', 'tp + fp')} AS precisao, {_ratio('tp', 'np')} AS recall, {_ratio('fp', 'nn')} AS fpr FROM rn")
def curves_by_model(spark, d):
    return evaluate.curve_points(models(spark, d), ["modelo"])


@query(f"{SC}, {SQL_MODELS}, {_curve_by('mo', 'modelo')} SELECT * FROM qc")
def calibration_points_by_model(spark, d):
    rows = models(spark, d)
    return evaluate.reliability(rows, evaluate.quantile_edges(evaluate.levels(rows, ["modelo"]), 10, ["modelo"]), ["modelo"])


@query(f"{SC} SELECT id, y, p, ano::INTEGER AS ano, regiao, faixa, sexo FROM sc")
def predictions_with_audit(spark, d):
    """Predictions and audit columns, one to one by record."""
    s = io.stored_by(scored(spark, d).select("id", "y", "p", "ano", "regiao", "faixa", "sexo"), "id", "predictions")  # the checks and the join by id shuffle no rows
    return io.one_to_one(s.select("id", "y", "p"), s.select("id", "ano", "regiao", "faixa", "sexo"), ["id"])


@query("SELECT o_orderkey, o_custkey, c_name, c_nationkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def orders_with_customer(spark, d):
    orders, customer = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("orders", "customer"))
    named = customer.select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
    return io.many_to_one(orders.select("o_orderkey", "o_custkey"), named.unionByName(named), ["o_custkey"], "c_name", needed=["c_name"]).select("o_orderkey", "o_custkey", "c_name", "c_nationkey")


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey) = 1")
def first_line_of_order(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_quantity")
    return io.first_rows(lines, ["l_orderkey"], -F.col("l_quantity"), F.col("l_partkey"))


@query(f"{SC}, {SQL_MODELS} SELECT id, " + ", ".join(f"round(max(p) FILTER (modelo = '{m}'), 6) AS {m}" for m in MODELS) + " FROM mo GROUP BY id")
def scores_wide(spark, d):
    of = lambda m: F.round(F.max(F.when(F.col("modelo") == m, F.col("p"))), 6).alias(m)
    return models(spark, d, by="id").groupBy("id").agg(*map(of, MODELS))  # episodes travel, not their models; one row an id is held


@query(f"{SC}, r AS (SELECT faixa, avg(y) AS taxa FROM sc GROUP BY faixa), s AS (SELECT regiao, faixa, count(*) AS n, sum(y) AS obs FROM sc GROUP BY ALL), j AS (SELECT regiao, sum(n)::BIGINT AS n, sum(obs)::BIGINT AS observados, round(sum(n * taxa), 6) AS esperados, round(100 * coalesce(sum(n) FILTER (faixa IN ('60-79', '80+')), 0) / sum(n), 6) AS pct_60 FROM s JOIN r USING (faixa) GROUP BY regiao) SELECT *, round(observados / n, 6) AS bruta, round(observados / nullif(esperados, 0), 4) AS padronizada FROM j")
def age_standardised(spark, d):
    return standard.age_standardised(scored(spark, d), "regiao")


@query(f"{SC} SELECT CASE WHEN grouping(faixa) = 1 THEN 'todos' ELSE faixa END AS faixa, count(*) AS n, round(avg(completude) FILTER (y = 1), 5) AS media_1, round(avg(completude) FILTER (y = 0), 5) AS media_0 FROM sc GROUP BY GROUPING SETS ((faixa), ())")
def outcome_means(spark, d):
    return standard.means_by_outcome(scored(spark, d), "completude")


@query(f"{SC}, qe AS (SELECT list_sort(list_distinct(quantile_cont(completude, [0.0, {1 / 3!r}, {2 / 3!r}, 1.0]))) AS e FROM sc), b AS (SELECT len(list_filter(e[2:len(e) - 1], lambda x: completude > x))::INTEGER + 1 AS tercil, completude FROM sc, qe) SELECT tercil, min(completude) AS minimo, max(completude) AS maximo, count(*) AS n FROM b GROUP BY tercil")
def completeness_terciles(spark, d):
    return standard.terciles(scored(spark, d), "completude")


THREE = ["roc_auc", "pr_auc", "brier"]
FIVE = [*THREE, "oe", "pr_relativa"]


def _drawn(unit: str, seed: str, src: str = "sc", keys: str = "", replicates: int = REPLICATES) -> str:
    """Metrics of all rows (em) and of replicates (bm) of a table, by keys: weights are Poisson(1) from hashes."""
    by, on = (f"{keys}, ", keys) if keys else ("", "")
    weight = " + ".join(f"(x >= {t})::INTEGER" for t in evaluate.POISSON)
    level = lambda lv, k: f"""SELECT *, sum(pos) OVER (PARTITION BY {k} ORDER BY p DESC) AS tp, sum(neg) OVER (PARTITION BY {k} ORDER BY p DESC) AS fp, sum(pos) OVER (PARTITION BY {k}) AS np, sum(neg) OVER (PARTITION BY {k}) AS nn FROM {lv}"""
    facts = lambda k: f"""{k}, {AUC} AS roc_auc, {AP} AS pr_auc, round(round({AP}, 6) * sum(pos + neg) / sum(pos), 6) AS pr_relativa, round(sum(pos * (1 - p) * (1 - p) + neg * p * p) / sum(pos + neg), 6) AS brier, round(sum(pos) / nullif(sum((pos + neg) * p), 0), 6) AS oe"""
    return f"""un AS (SELECT DISTINCT {unit} AS u FROM {src}),
mu AS (SELECT unnest({evaluate.multipliers(replicates)}) AS m, unnest(range({replicates})) AS rep),
ms AS (SELECT u, ('0x' || md5('{seed}|' || u)[1:8])::BIGINT % {evaluate.PRIME - 1} + 1 AS s FROM un),
dx AS (SELECT u, mu.rep, s * m::BIGINT % {evaluate.PRIME} AS x FROM ms, mu),
dw AS (SELECT u, rep, {weight} AS w FROM dx WHERE x >= {evaluate.POISSON[0]}),
bl AS (SELECT {by}rep, p, sum(y * w)::BIGINT AS pos, sum((1 - y) * w)::BIGINT AS neg FROM {src} JOIN dw ON {unit} = u GROUP BY {by}rep, p),
br AS ({level('bl', by + 'rep')}),
bm AS (SELECT {facts(by + 'rep')} FROM br GROUP BY {by}rep HAVING max(np) > 0 AND max(nn) > 0),
el AS (SELECT {by}1 AS whole, p, sum(y)::BIGINT AS pos, sum(1 - y)::BIGINT AS neg FROM {src} GROUP BY {by}p),
er AS ({level('el', by + 'whole')}),
em AS (SELECT {facts(by + 'whole')} FROM er GROUP BY {by}whole HAVING max(np) > 0 AND max(nn) > 0)"""


def _interval(metrics, keys: str = "") -> str:
    by, on = (f"{keys}, ", f"USING ({keys})") if keys else ("", "ON true")
    group = f" GROUP BY {keys}" if keys else ""
    return " UNION ALL ".join(f"SELECT {by}'{m}' AS metrica, {m} AS estimativa, replicas, baixo, alto FROM em LEFT JOIN (SELECT {by}count({m}) AS replicas, round(quantile_cont({m}, 0.025) + 1e-9, 5) AS baixo, round(quantile_cont({m}, 0.975) + 1e-9, 5) AS alto FROM bm{group}) {on}" for m in metrics)


@query(f"{SC}, {_drawn('id', 'linhas')} {_interval(THREE)}")
def bootstrap_rows(spark, d):
    return evaluate.bootstrap(scored(spark, d), "id", THREE, REPLICATES, "linhas")


@query(f"{SC}, {_drawn('grupo', 'grupos')} {_interval(THREE)}")
def bootstrap_groups(spark, d):
    return evaluate.bootstrap(scored(spark, d), "grupo", THREE, REPLICATES, "grupos")


PAIR = f"{SC}, s2 AS (SELECT grupo, y, p, 'a' AS m FROM sc UNION ALL SELECT grupo, y, p * p, 'b' FROM sc), {_drawn('grupo', 'pares', 's2', 'm')}, df AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metrica, round(a.{m} - b.{m}, 9) AS d FROM bm a JOIN bm b USING (rep) WHERE a.m = 'a' AND b.m = 'b'" for m in THREE) + "), de AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metrica, round(a.{m} - b.{m}, 6) AS diferenca FROM em a, em b WHERE a.m = 'a' AND b.m = 'b'" for m in THREE) + ")"


@query(f"{PAIR} SELECT metrica, any_value(diferenca) AS diferenca, count(d) AS replicas, round(quantile_cont(d, 0.025) + 1e-9, 5) AS baixo, round(quantile_cont(d, 0.975) + 1e-9, 5) AS alto, round(least(1, 2 * least(avg((d <= 0)::INTEGER), avg((d >= 0)::INTEGER))), 5) AS p_valor FROM df JOIN de USING (metrica) GROUP BY metrica")
def bootstrap_paired(spark, d):
    return evaluate.bootstrap_difference(scored(spark, d), "grupo", F.col("p") * F.col("p"), THREE, REPLICATES, "pares")


MEAN = "sum(CASE WHEN y = 1 THEN {w} * completude END) / sum(CASE WHEN y = 1 THEN {w} END) - sum(CASE WHEN y = 0 THEN {w} * completude END) / sum(CASE WHEN y = 0 THEN {w} END)"


@query(f"{SC}, {_drawn('grupo', 'medias')}, m AS (SELECT rep, {MEAN.format(w='w')} AS d FROM sc JOIN dw ON grupo = u GROUP BY rep) SELECT (SELECT round({MEAN.format(w='1')}, 5) FROM sc) AS diferenca, count(d) AS replicas, round(quantile_cont(d, 0.025) + 1e-9, 5) AS baixo, round(quantile_cont(d, 0.975) + 1e-9, 5) AS alto FROM m")
def bootstrap_mean_diff(spark, d):
    return evaluate.mean_difference(scored(spark, d), "grupo", "completude", REPLICATES, "medias")


STRATA_METRICS = ["roc_auc", "pr_auc", "pr_relativa", "brier", "oe"]


def _strata(stratum: str) -> str:
    """Several models in each stratum and in all: counts, suppression, estimates, intervals, and O/E relative to all."""
    src = f"""sm AS (SELECT grupo, y, unnest([{{'m': 'base', 'p': p}}, {{'m': 'quadrado', 'p': p * p}}]) AS v, {stratum} AS e FROM sc),
sx AS (SELECT grupo, y, v.m AS modelo, v.p AS p, unnest(['todos', e]) AS estrato FROM sm),
sy AS (SELECT * FROM sx WHERE estrato IS NOT NULL),
sf AS (SELECT estrato, modelo, count(*) AS n, sum(y)::BIGINT AS positivos, round(avg(y), 6) AS prevalencia, count(*) < {LEAST_ROWS} OR sum(y) < {LEAST_CLASS} OR sum(1 - y) < {LEAST_CLASS} AS suprimido FROM sy GROUP BY ALL),
sz AS (SELECT sy.* FROM sy JOIN sf USING (estrato, modelo) WHERE NOT suprimido)"""
    metrics = ", ".join(f"'{m}'" for m in STRATA_METRICS)
    return f"""{SC}, {src}, {_drawn('grupo', 'estratos', 'sz', 'estrato, modelo', STRATUM_REPLICATES)}, iv AS ({_interval(STRATA_METRICS, 'estrato, modelo')}),
al AS (SELECT sf.*, unnest([{metrics}]) AS metrica FROM sf), av AS (SELECT al.*, estimativa, replicas, baixo, alto FROM al LEFT JOIN iv USING (estrato, modelo, metrica))
SELECT av.*, CASE WHEN metrica = 'oe' THEN round(estimativa / (SELECT t.estimativa FROM av t WHERE t.estrato = 'todos' AND t.modelo = av.modelo AND t.metrica = 'oe'), 5) END AS relativo_ao_total FROM av"""


def _stratum_table(rows, stratum):
    scores = F.array(*(F.struct(F.lit(m).alias("modelo"), c.alias("p")) for m, c in (("base", F.col("p")), ("quadrado", F.col("p") * F.col("p")))))
    rows = rows.select("grupo", "y", stratum.alias("e"), scores.alias("scores"))
    return evaluate.stratum_table(rows, "grupo", F.col("e"), STRATA_METRICS, STRATUM_REPLICATES, "estratos", LEAST_ROWS, LEAST_CLASS)


@query(_strata("faixa"))
def stratum_ci(spark, d):
    return _stratum_table(scored(spark, d), F.col("faixa"))


PARTS = "split_part(estrato, '|', {0})"


@query(f"SELECT * EXCLUDE (estrato), CASE WHEN estrato = 'todos' THEN 'todos' ELSE {PARTS.format(1)} END AS padrao, CASE WHEN estrato = 'todos' THEN 'todas' ELSE {PARTS.format(2)} END AS ampla FROM ({_strata(f'padrao || chr(124) || {SQL_COARSE}')})")
def pattern_by_age(spark, d):
    out = _stratum_table(scored(spark, d), codes.label(F.col("padrao"), codes.coarse_band(F.col("faixa"))))
    whole = F.col("estrato") == "todos"
    return out.withColumn("padrao", F.when(whole, "todos").otherwise(codes.label_part(F.col("estrato"), 0))).withColumn("ampla", F.when(whole, "todas").otherwise(codes.label_part(F.col("estrato"), 1))).drop("estrato")
