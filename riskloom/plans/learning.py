"""Queries that fit models, and that publish and read tables."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from riskloom.operators import blocks, boosting, evaluate, models, profile
from riskloom.plans.cohort import MASTER, YEARS_SEALED, YEARS_SHARED, master
from riskloom.sources import io
from riskloom.sources.episodes import SQL_EPISODES, SQL_SCORED, episodes, read, scored
from riskloom.sources.io import folder, stored

QUERIES: dict = {}
SQL: dict = {}
NUMERIC, CATEGORICAL = ["idade", "completude"], ["regiao", "faixa", "sexo"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _parts(spark, d, *more):
    """Rows to fit on and to test, written once with the columns that fits read and those named."""
    h = F.conv(F.substring(F.md5("grupo"), 1, 4), 16, 10).cast("int") % 10
    rows = scored(spark, d).withColumn("h", h).withColumn("valida", F.col("h") == 8)
    rows = stored(rows.select("id", "grupo", "y", *NUMERIC, *CATEGORICAL, *more, "h", "valida"), "parts")
    return rows.where("h < 9"), rows.where("h = 9")


def _scores(spark, d, name):
    train, test = _parts(spark, d)
    return models.score(models.fit(train, name, NUMERIC, CATEGORICAL), test, CATEGORICAL).select("id", "y", "p")


@query()
def lr_scores(spark, d):
    return _scores(spark, d, "lr")


@query()
def gbt_scores(spark, d):
    """Boosting as in the studied project: rounds end by the validation rows."""
    train, test = _parts(spark, d)
    return boosting.score({"gbt": boosting.fit(train, NUMERIC, CATEGORICAL, valid="valida")}, test).select("id", "y", "p")


@query()
def tree_scores(spark, d):
    return _scores(spark, d, "tree")


@query()
def forest_scores(spark, d):
    return _scores(spark, d, "forest")


TEST = f"WITH {SQL_SCORED}, h AS (SELECT *, ('0x' || md5(grupo)[1:4])::BIGINT % 10 AS h FROM sc)"


@query(f"{TEST} SELECT id, y, round((SELECT avg(y) FROM h WHERE h < 9), 6) AS p FROM h WHERE h = 9")
def prior_baseline(spark, d):
    return models.prior(*_parts(spark, d)).select("id", "y", F.round("p", 6).alias("p"))


@query()
def calibrated_scores(spark, d):
    s = scored(spark, d).withColumn("h", F.conv(F.substring(F.md5("grupo"), 1, 2), 16, 10).cast("int") % 2)
    held, rest = models.score_levels(s.where("h = 0")), s.where("h = 1")
    iso = models.isotonic_calibration(held, models.sigmoid_calibration(held, rest, weight="_n").select("id", "y", "p", F.col("p_cal").alias("sigmoide")), weight="_n")
    return iso.select("id", "y", "p", "sigmoide", F.col("p_cal").alias("isotonica"))


GRID = {f"lr c={c:g} l1={l1:g} {w or 'sem_peso'}": {"name": "lr", "c": c, "l1": l1, **({"weight": "peso"} if w else {})} for c in (0.1, 1.0, 10.0) for l1 in (0.0, 0.5) for w in (None, "peso")}
BOOSTS = {f"gbt rate={r:g} leaves={n} least={m} l2={l2:g} {'peso' if w else 'sem_peso'}": boosting.Settings(r, 500, n, m, l2, w) for r, n, m, l2, w in
          ((0.05, 63, 100, 0.1, False), (0.1, 63, 100, 0.1, False), (0.05, 31, 100, 0.1, False), (0.05, 127, 100, 0.1, False), (0.05, 63, 20, 0.1, False), (0.05, 63, 100, 0.0, False), (0.05, 63, 100, 1.0, False), (0.05, 63, 100, 0.1, True))}


@query()
def grid_search(spark, d):
    """Logistic models by penalty, mix and weight, and boosting around its settings, one at a time; all boosts share their passes."""
    train, test = _parts(spark, d)
    rows = models.scored_sets(models.balanced(train), test, GRID, NUMERIC, CATEGORICAL)
    boosts = boosting.score(boosting.fit_many(train, BOOSTS, NUMERIC, CATEGORICAL, valid="valida"), test)
    return models.search(rows.unionByName(boosts.select(*rows.columns)))


REFERENCE, WHOLE = "P", [*NUMERIC, *CATEGORICAL]
SETS = {"P": WHOLE, "so_idade_sexo": ["idade", "sexo"], "P_menos_completude": [c for c in WHOLE if c != "completude"], "P_mais_padrao": [*WHOLE, "padrao"]}
ABLATION_REPLICATES, ABLATION_METRICS = 300, ["roc_auc", "pr_auc", "brier"]


def _ablated(spark, d):
    """Test rows scored by each family on each set of columns: ``familia, conjunto`` and ``p`` added."""
    train, test = _parts(spark, d, "ano", "padrao")
    of = lambda cs, among: [c for c in cs if c in among]
    lr = {k: {"name": "lr", "numeric": of(cs, NUMERIC), "categorical": of(cs, [*CATEGORICAL, "padrao"])} for k, cs in SETS.items()}
    linear = models.scored_sets(train, test, lr, NUMERIC, CATEGORICAL).withColumn("familia", F.lit("lr"))
    boosts = boosting.fit_many(train, {k: boosting.Settings(only=tuple(cs)) for k, cs in SETS.items()}, NUMERIC, [*CATEGORICAL, "padrao"], valid="valida")
    trees = boosting.score(boosts, test).withColumn("familia", F.lit("gbt"))
    return stored(linear.unionByName(trees.select(*linear.columns)).withColumnRenamed("candidato", "conjunto"), "ablation")


def _against_reference(rows, keys):
    """Rows of each set but the reference, with the reference's score of the same row: ``p`` and ``q``."""
    other = rows.where(F.col("conjunto") == REFERENCE).select("familia", "id", F.col("p").alias("q"))
    return rows.where(F.col("conjunto") != REFERENCE).join(other, ["familia", "id"]).select("familia", "conjunto", "id", "grupo", *keys, "y", "p", "q")


@query()
def ablation(spark, d):
    """Metrics of each family on each set, and their differences from the reference set with paired intervals."""
    rows = _ablated(spark, d)
    keys = ["familia", "conjunto"]
    table = evaluate.metrics(rows, 0.5, keys).select(*keys, "n", *ABLATION_METRICS)
    pair = evaluate.bootstrap_difference(_against_reference(rows, []), "grupo", F.col("q"), ABLATION_METRICS, ABLATION_REPLICATES, "ablacao", keys)
    return table.unpivot([*keys, "n"], ABLATION_METRICS, "metrica", "valor").join(pair, [*keys, "metrica"], "left")


@query()
def ablation_by_year(spark, d):
    """The same by year: each family, set, year and metric, with the paired interval of its difference from the reference set."""
    rows = _ablated(spark, d)
    keys = ["familia", "conjunto", "ano"]
    table = evaluate.metrics(rows, 0.5, keys).select(*keys, "n", "positivos", *ABLATION_METRICS)
    pair = evaluate.bootstrap_difference(_against_reference(rows, ["ano"]), "grupo", F.col("q"), ABLATION_METRICS, ABLATION_REPLICATES, "ablacao", keys)
    return table.unpivot([*keys, "n", "positivos"], ABLATION_METRICS, "metrica", "valor").join(pair, [*keys, "metrica"], "left")


@query()
def class_weight_compare(spark, d):
    """Calibrated scores of fits with and without class weights; the best of each family by Brier score is marked."""
    train, test = _parts(spark, d)
    sets = {f"{f} {w}": {"name": f, **({"weight": "peso"} if w == "peso" else {})} for f in ("lr", "tree") for w in ("sem_peso", "peso")}
    scores = models.scored_sets(models.balanced(train), test, sets, NUMERIC, CATEGORICAL).select("candidato", "id", "y", "p")
    rows = stored(blocks.halves(stored(scores, "weights"), ["candidato", "y"], "id"), "halves")
    out = None
    for name in sets:
        one = rows.where(F.col("candidato") == name)
        cal = models.sigmoid_calibration(one.where("metade = 'calibracao'").select("id", "y", "p"), one.where("metade = 'medida'").select("candidato", "id", "y", "p"))
        cal = cal.select("candidato", "y", F.round("p_cal", 9).alias("p"))
        out = cal if out is None else out.unionByName(cal)
    table = evaluate.metrics(out, 0.5, ["candidato"]).select("candidato", "brier", "pr_auc", "roc_auc")
    errors = evaluate.calibration_errors(evaluate.reliability(out, [i / 10 for i in range(1, 10)], ["candidato"]), ["candidato"]).select("candidato", "ece")
    table = table.join(errors, "candidato").withColumn("familia", F.split("candidato", " ")[0])
    best = profile.best_per(table, ["familia"], F.col("brier"), F.col("candidato")).select("candidato", F.lit(True).alias("melhor"))
    return table.join(best, "candidato", "left").na.fill(False, ["melhor"])


@query()
def kmeans_groups(spark, d):
    v = read(spark, d, "embeddings").select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    return models.kmeans(v, 10, "v").select("vec_id", "label", "cluster")


def _clustered(spark, d):
    """Distinct features and how many rows have them, from scored rows written once."""
    rows = stored(scored(spark, d).select(*NUMERIC, *CATEGORICAL), "features")
    return models.cluster_features(rows, NUMERIC, CATEGORICAL, alike=True)[0]


@query()
def cluster_quality(spark, d):
    return models.silhouettes(_clustered(spark, d), (2, 3, 4), "weighted", "peso")


@query()
def cluster_profile(spark, d):
    found = stored(models.kmeans(_clustered(spark, d), 4, "weighted", "peso").select(*NUMERIC, *CATEGORICAL, "cluster", "peso"), "clusters")
    v = models.cramers_v(found, "cluster", CATEGORICAL, "peso").select("variavel", F.lit("v_cramer").alias("medida"), F.col("v_cramer").alias("valor"))
    return v.unionByName(models.eta_squared(found, "cluster", NUMERIC, "peso").select("variavel", F.lit("eta2").alias("medida"), F.col("eta2").alias("valor")))


# Cramer's V and eta squared over a given grouping, which SQL can express
LONG = " UNION ALL ".join(f"SELECT '{c}' AS variavel, y AS g, {c} AS v FROM sc" for c in CATEGORICAL)


@query(f"""WITH {SQL_SCORED}, l AS ({LONG}), o AS (SELECT variavel, g, v, count(*) AS o FROM l GROUP BY ALL),
e AS (SELECT *, sum(o) OVER (PARTITION BY variavel, g) AS r, sum(o) OVER (PARTITION BY variavel, v) AS c, sum(o) OVER (PARTITION BY variavel) AS n FROM o),
x AS (SELECT variavel, sum(o::DOUBLE * o * n / (r * c)) - max(n) AS q, max(n) AS n, least(count(DISTINCT v), count(DISTINCT g)) AS k FROM e GROUP BY variavel)
SELECT variavel, round(q, 4) AS qui2, round(sqrt(q / nullif(n * (k - 1), 0)), 5) AS v_cramer FROM x""")
def association(spark, d):
    return models.cramers_v(scored(spark, d), "y", CATEGORICAL)


@query(f"WITH {SQL_SCORED}, o AS (SELECT *, avg(idade) OVER () AS m FROM sc WHERE idade IS NOT NULL), g AS (SELECT y, count(*) AS n, avg(idade) AS a, any_value(m) AS m FROM o GROUP BY y) SELECT 'idade' AS variavel, round((SELECT sum(n * (a - m) * (a - m)) FROM g) / (SELECT sum((idade - m) * (idade - m)) FROM o), 5) AS eta2")
def variance_between(spark, d):
    return models.eta_squared(scored(spark, d), "y", ["idade"])


@query(f"""WITH {SQL_SCORED}, l AS ({LONG}), o AS (SELECT variavel, g, v, count(*) AS o FROM l GROUP BY ALL),
e AS (SELECT *, sum(o) OVER (PARTITION BY variavel, g) AS r, sum(o) OVER (PARTITION BY variavel, v) AS c, sum(o) OVER (PARTITION BY variavel) AS n FROM o),
x AS (SELECT variavel, sum(o::DOUBLE * o * n / (r * c)) - max(n) AS q, max(n) AS n, count(DISTINCT v) AS kv, count(DISTINCT g) AS kg FROM e GROUP BY variavel),
m AS ({" UNION ALL ".join(f"SELECT '{c}' AS variavel, y AS g, {c}::DOUBLE AS x FROM sc WHERE {c} IS NOT NULL" for c in NUMERIC)}),
p AS (SELECT variavel, g, count(*) AS n, avg(x) AS a, sum(x) AS s, sum(x * x) AS q FROM m GROUP BY ALL),
f AS (SELECT variavel, sum(n)::BIGINT AS n, count(*) AS k, sum(s * s / n) - sum(s) * sum(s) / sum(n) AS b, sum(q) - sum(s * s / n) AS w FROM p GROUP BY variavel)
SELECT variavel, 'qui2' AS teste, round(q, 4) AS estatistica, (kv - 1) * (kg - 1) AS gl1, NULL::BIGINT AS gl2, round(sqrt(q / (n * (least(kv, kg) - 1))), 5) AS efeito FROM x
UNION ALL SELECT variavel, 'f', round((b / (k - 1)) / (w / (n - k)), 4), k - 1, n - k, round(b / (b + w), 5) FROM f""")
def association_tests(spark, d):
    """Chi-square and F tests of all columns against the outcome."""
    return models.association_tests(scored(spark, d), "y", CATEGORICAL, NUMERIC)


@query()
def association_p_values(spark, d):
    return models.p_values(models.association_tests(scored(spark, d), "y", CATEGORICAL, NUMERIC))


@query(f"{MASTER} SELECT particao, count(*) AS n FROM mp WHERE particao IN ('train_ref', 'val_ref') GROUP BY particao")
def blocks_roundtrip(spark, d):
    path = folder(spark, "blocks")
    io.write_blocks(master(spark, d).where("particao <> 'exploracao'"), path)
    return io.read_blocks(spark, path).groupBy("particao").agg(F.count("*").alias("n"))


@query(f"{MASTER} SELECT 'partition' AS tabela, particao, count(*) AS n, count(DISTINCT grupo) AS grupos FROM mp GROUP BY particao UNION ALL SELECT 'model', particao, count(*), count(DISTINCT grupo) FROM mp WHERE particao <> 'exploracao' GROUP BY particao")
def supervised_build(spark, d):
    """The whole build: features, groups, target, quarantine, partition, two written tables with manifests, read back and checked."""
    io.guard([*NUMERIC, *CATEGORICAL], models.OUTCOME, NUMERIC, CATEGORICAL)
    rows = io.free_targets(io.require(scored(spark, d), ["id", "grupo", "y", "ano", "regiao", *NUMERIC, *CATEGORICAL]), ["particao"])
    rows = io.stored_by(rows, "grupo", "built")  # read several times, always by group
    ok, _ = blocks.quarantine(rows, "grupo", ["ano", "y", "regiao"])
    at = folder(spark, "build")
    blocks.master_partition(ok, "grupo", YEARS_SHARED, YEARS_SEALED).write.parquet(at)
    out = None
    for name, part in (("partition", lambda t: t.select("id", "grupo", "ano", "regiao", "y", "particao")), ("model", lambda t: t.where("particao <> 'exploracao'"))):
        path = folder(spark, name)
        io.publish_observed(spark, lambda s, part=part: part(s.read.parquet(at)), path, "id", F.col("y").isNull(), (0, 1), "y")
        io.manifest(part(spark.read.parquet(at)), name, blocks.SALT, "particao").write.json(f"{path}-manifest")
        held = io.read_checked(spark, path, f"{path}-manifest")
        facts = held.groupBy("particao").agg(F.count("*").alias("n"), F.count_distinct("grupo").alias("grupos")).select(F.lit(name).alias("tabela"), "particao", "n", "grupos")
        out = facts if out is None else out.unionByName(facts)
    return out


@query(f"""WITH {SQL_EPISODES}, k AS (SELECT *, evolucao NOT IN ('1', '2') AS v, hospital IS NULL OR hospital <> '1' AS bad FROM ep)
SELECT 'linhas' AS verificacao, count(*) AS observado, count(*) > 0 AS ok FROM k UNION ALL SELECT 'chave_nula', count(*) FILTER (id_registro IS NULL), count(*) FILTER (id_registro IS NULL) = 0 FROM k UNION ALL SELECT 'chave_repetida', count(*) - count(DISTINCT id_registro), count(*) = count(DISTINCT id_registro) FROM k
UNION ALL SELECT 'violacoes', count(*) FILTER (bad), count(*) FILTER (bad) = 0 FROM k UNION ALL SELECT 'fora_do_dominio', count(*) FILTER (v), count(*) FILTER (v) = 0 FROM k""")
def validate_published(spark, d):
    """Checks of a table that breaks two of them."""
    bad = F.coalesce(F.col("hospital") != "1", F.lit(True))
    return io.published_checks(episodes(spark, d), "id_registro", bad, ("1", "2"), "evolucao")


@query(f"{MASTER}, b AS (SELECT particao, count(*) AS n FROM mp GROUP BY particao) SELECT 'partition' AS nome, '1' AS semente, (SELECT count(*) FROM mp) AS linhas, 6 AS colunas, 'id:string,grupo:string,ano:int,regiao:string,y:int,particao:string' AS tipos, string_agg(particao || ':' || n, ',' ORDER BY particao) AS blocos FROM b")
def profile_manifest(spark, d):
    table = master(spark, d).select("id", "grupo", "ano", "regiao", "y", "particao")
    m = io.manifest(table, "partition", "1", "particao")
    told = lambda c, a, b: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x[a], x[b].cast("string"))), ",")
    return m.select("nome", "semente", "linhas", "colunas", told("tipos", "coluna", "tipo").alias("tipos"), told("blocos", "bloco", "n").alias("blocos"))
