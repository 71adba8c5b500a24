"""Queries over episodes: rules, features, partition, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import codes
from riskloom.operators import blocks, profile, rules
from riskloom.sources import io
from riskloom.sources.episodes import ANSWERS, CONDITIONS, SECONDARY, SQL_AGE, SQL_COMPLETE, SQL_DATE, SQL_EPISODES, SQL_PATTERN, SQL_SCORED, SYMPTOMS, episodes, read, scored

QUERIES: dict = {}
SQL: dict = {}
SQL_COARSE = "CASE " + " ".join(f"WHEN faixa IN ({', '.join(repr(b) for b in bands)}) THEN '{name}'" for name, bands in codes.COARSE.items()) + " END"
YEARS_SHARED, YEARS_SEALED = (1995, 1998, 1999, 2000), (1996, 1997)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _sets(spark, d, *keys):
    return rules.rule_sets(episodes(spark, d), rules.masks(), *keys)


R = rules.RULES
DAYS = "date_diff('day', onset, dia)"
SQL_MASKS = f"""WITH {SQL_EPISODES},
m0 AS (SELECT *, {SQL_DATE.format('dt_interna')} AS dia, {SQL_DATE.format('dt_sin_pri')} AS onset, nullif(regexp_replace(trim(hospital), '\\.0$', ''), '') AS h FROM ep),
m AS (SELECT *, coalesce(h <> '1', true)::INTEGER AS hospital_, (dia IS NULL)::INTEGER AS data_invalida_, (evolucao NOT IN ('1', '2'))::INTEGER AS evolucao_,
  coalesce(dia < DATE '{rules.START}', false)::INTEGER AS antes_, coalesce(dia > DATE '{rules.END}', false)::INTEGER AS depois_,
  coalesce({DAYS} < 0, false)::INTEGER AS negativo_, coalesce({DAYS} > {rules.MOST_DAYS}, false)::INTEGER AS longo_ FROM m0)"""
LONG = "SELECT * FROM (" + " UNION ALL ".join(f"SELECT {{0}} {i + 1} AS ordem, '{r}' AS regra, {r}_ AS hit FROM m" for i, r in enumerate(R)) + ")"


@query(f"{SQL_MASKS}, l AS ({LONG.format('')}) SELECT ordem, regra, sum(hit)::BIGINT AS violacoes, count(*) AS total, round(sum(hit) / count(*), 9) AS proporcao FROM l GROUP BY ALL")
def rule_summary(spark, d):
    return rules.summary(_sets(spark, d))


@query(f"{SQL_MASKS} " + " UNION ALL ".join(f"SELECT '{r}' AS regra, " + ", ".join(f"coalesce(sum({r}_ * {s}_), 0)::BIGINT AS {s}" for s in R) + " FROM m" for r in R))
def rule_overlap(spark, d):
    return rules.overlap(_sets(spark, d))


def _sql_waterfall(used) -> str:
    first = "CASE " + " ".join(f"WHEN {r}_ = 1 THEN {i + 1}" for i, r in enumerate(R) if r in used) + " END"
    names = ", ".join(f"({i + 1}, '{r}')" for i, r in enumerate(R) if r in used)
    return f"""{SQL_MASKS}, f AS (SELECT {first} AS o FROM m), n(ordem, regra) AS (VALUES {names}),
    g AS (SELECT ordem, regra, (SELECT count(*) FROM f WHERE o = ordem) AS excluidos FROM n)
    SELECT ordem, regra, excluidos, ((SELECT count(*) FROM m) - sum(excluidos) OVER (ORDER BY ordem))::BIGINT AS restantes FROM g"""


@query(_sql_waterfall(R))
def rule_waterfall(spark, d):
    return rules.waterfall(_sets(spark, d))


@query(_sql_waterfall(rules.APPROVED))
def effective_waterfall(spark, d):
    return rules.waterfall(_sets(spark, d), used=rules.APPROVED)


@query(f"{SQL_MASKS}, l AS ({LONG.format('''coalesce(year(dia)::VARCHAR, 'SEM_ANO_VALIDO') AS ano,''')}) SELECT ano, regra, sum(hit)::BIGINT AS violacoes FROM l GROUP BY ALL")
def rules_by_year(spark, d):
    year = F.coalesce(F.year(codes.iso_date(F.col("dt_interna"))).cast("string"), F.lit("SEM_ANO_VALIDO"))
    return rules.by_key(_sets(spark, d, year.alias("ano")), "ano")


@query(f"{SQL_MASKS}, l AS ({LONG.format('''coalesce(evolucao, 'AUSENTE') AS desfecho,''')}) SELECT desfecho, regra, sum(hit)::BIGINT AS violacoes FROM l GROUP BY ALL")
def rules_by_outcome(spark, d):
    return rules.by_key(_sets(spark, d, F.coalesce("evolucao", F.lit(codes.MISSING)).alias("desfecho")), "desfecho")


OUT = " OR ".join(f"{r}_ = 1" for r in rules.APPROVED)


@query(f"{SQL_MASKS} SELECT count(*) AS origem, count(*) FILTER ({OUT}) AS excluidos, count(*) FILTER (NOT ({OUT})) AS mantidos, true AS fecha FROM m")
def population_reconciliation(spark, d):
    return rules.reconciliation(_sets(spark, d))


@query(f"{SQL_MASKS} SELECT id_registro, CASE evolucao WHEN '2' THEN 1 WHEN '1' THEN 0 END AS alvo FROM m WHERE NOT ({OUT})")
def cohort_rows(spark, d):
    e = rules.kept(episodes(spark, d), rules.masks())
    return e.select("id_registro", codes.target(F.col("evolucao"), ("2",), ("1",)).cast("int").alias("alvo"))


@query(f"WITH {SQL_EPISODES} SELECT id_registro, nullif(regexp_replace(trim(hospital), '\\.0$', ''), '') AS codigo FROM ep")
def code_normalise(spark, d):
    return episodes(spark, d).select("id_registro", codes.code(F.col("hospital")).alias("codigo"))


@query(f"WITH {SQL_EPISODES} SELECT id_registro, strftime({SQL_DATE.format('dt_interna')}, '%Y-%m-%d') AS dia FROM ep")
def date_parse(spark, d):
    return episodes(spark, d).select("id_registro", codes.tolerant_date(F.col("dt_interna")).cast("string").alias("dia"))


AGE0 = "CASE tp_idade WHEN '1' THEN nu_idade_n::DOUBLE / 365.25::DOUBLE WHEN '2' THEN nu_idade_n::DOUBLE / 12::DOUBLE ELSE nu_idade_n::DOUBLE END"


@query(f"WITH {SQL_EPISODES} SELECT id_registro, round({SQL_AGE}, 6) AS idade FROM (SELECT id_registro, {AGE0} AS a FROM ep)")
def age_years(spark, d):
    return episodes(spark, d).select("id_registro", F.round(codes.age_years(F.col("nu_idade_n"), F.col("tp_idade")), 6).alias("idade"))


@query(f"{SQL_MASKS} SELECT id_registro, {DAYS}::INTEGER AS dias, coalesce({DAYS} < 0 OR {DAYS} > 60, true)::INTEGER AS invalido, coalesce({DAYS} < 0, false)::INTEGER AS negativo FROM m")
def interval_flags(spark, d):
    days = codes.days_between(codes.iso_date(F.col("dt_sin_pri")), codes.iso_date(F.col("dt_interna")))
    bad, negative = codes.interval_flags(days, rules.MOST_DAYS)
    return episodes(spark, d).select("id_registro", days.alias("dias"), bad.cast("int").alias("invalido"), negative.cast("int").alias("negativo"))


@query(f"{SQL_MASKS} SELECT id_registro, round(sin(2 * pi() / 52.18::DOUBLE * week(dia)), 6) AS seno, round(cos(2 * pi() / 52.18::DOUBLE * week(dia)), 6) AS cosseno, year(dia)::INTEGER AS ano, month(dia)::INTEGER AS mes FROM m")
def seasonality(spark, d):
    day = codes.iso_date(F.col("dt_interna"))
    s, c = codes.season(day)
    return episodes(spark, d).select("id_registro", F.round(s, 6).alias("seno"), F.round(c, 6).alias("cosseno"), F.year(day).alias("ano"), F.month(day).alias("mes"))


@query(f"WITH {SQL_SCORED} SELECT faixa, count(*) AS n FROM sc GROUP BY faixa")
def age_band(spark, d):
    return scored(spark, d).groupBy("faixa").agg(F.count("*").alias("n"))


@query(f"WITH {SQL_EPISODES} SELECT cs_sexo AS sexo, count(*) AS n FROM ep GROUP BY cs_sexo")
def category_map(spark, d):
    return episodes(spark, d).groupBy(codes.sex(F.col("cs_sexo")).alias("sexo")).agg(F.count("*").alias("n"))


@query(f"WITH {SQL_EPISODES} SELECT id_registro, coalesce(r_name, 'AUSENTE') AS regiao FROM ep LEFT JOIN nation ON n_name = sg_uf LEFT JOIN region ON r_regionkey = n_regionkey")
def region_lookup(spark, d):
    dim = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("sg_uf"), "r_name")
    return episodes(spark, d).join(dim, "sg_uf", "left").select("id_registro", F.coalesce("r_name", F.lit(codes.MISSING)).alias("regiao"))


@query(f"WITH {SQL_EPISODES} SELECT id_registro, " + ", ".join(f"CASE WHEN {c} IS NULL AND fator_risc = '2' THEN '2' ELSE {c} END AS {c}" for c in CONDITIONS) + " FROM ep")
def conditional_fill(spark, d):
    return episodes(spark, d).select("id_registro", *(codes.fill_when_parent_denies(F.col(c), F.col("fator_risc")).alias(c) for c in CONDITIONS))


@query(f"WITH {SQL_SCORED} SELECT grupo, count(*) AS n FROM sc GROUP BY grupo")
def group_id(spark, d):
    return scored(spark, d).groupBy("grupo").agg(F.count("*").alias("n"))


@query(f"WITH {SQL_SCORED} SELECT id, y, round(p, 3) AS p, ano::INTEGER AS ano, regiao, faixa, sexo, round(idade, 6) AS idade, completude FROM sc")
def feature_table(spark, d):
    return scored(spark, d).select("id", "y", F.round("p", 3).alias("p"), "ano", "regiao", "faixa", "sexo", F.round("idade", 6).alias("idade"), "completude")


def _laid(spark, d):
    """Scored episodes, written once in buckets of their group: what goes by group reads them without a shuffle."""
    return io.stored_by(scored(spark, d).select("id", "grupo", "ano", "y", "regiao"), "grupo", "cohort")


def _shared(spark, d):
    return blocks.quarantine(_laid(spark, d), "grupo", ["ano", "y", "regiao"])[0]


GROUPS = f"""WITH {SQL_SCORED},
bad AS (SELECT grupo FROM sc GROUP BY grupo HAVING count(DISTINCT ano::VARCHAR || '|' || y || '|' || regiao) > 1),
ok AS (SELECT * FROM sc WHERE grupo NOT IN (SELECT grupo FROM bad))"""
IN_SHARED, IN_SEALED = (", ".join(map(str, y)) for y in (YEARS_SHARED, YEARS_SEALED))
MASTER = f"""{GROUPS},
small AS (SELECT count(*) AS s FROM (SELECT count(DISTINCT grupo) AS g FROM ok WHERE ano IN ({IN_SHARED}) GROUP BY ano, y, regiao HAVING g < {blocks.MIN_GROUPS})),
gr AS (SELECT DISTINCT grupo, ano, y, CASE WHEN (SELECT s FROM small) = 0 THEN regiao END AS r FROM ok WHERE ano IN ({IN_SHARED})),
rk AS (SELECT *, row_number() OVER (PARTITION BY ano, y, r ORDER BY md5('{blocks.SALT}|' || grupo), grupo) AS pos, count(*) OVER (PARTITION BY ano, y, r) AS tam FROM gr),
bl AS (SELECT grupo, CASE WHEN pos <= greatest(1, least(floor(tam * 0.7::DOUBLE), tam - 2)) THEN 'train_ref' WHEN pos <= greatest(2, least(floor(tam * (0.7::DOUBLE + 0.15::DOUBLE)), tam - 1)) THEN 'val_ref' ELSE 'test_ref' END AS b FROM rk),
mp AS (SELECT ok.*, CASE WHEN ano IN ({IN_SEALED}) THEN 'test_pandemic' WHEN ano IN ({IN_SHARED}) THEN b ELSE 'exploracao' END AS particao FROM ok LEFT JOIN bl USING (grupo))"""


@query(f"{GROUPS} SELECT 'coerentes' AS parte, count(*) AS linhas, count(DISTINCT grupo) AS grupos FROM ok UNION ALL SELECT 'quarentena', count(*), count(DISTINCT grupo) FROM sc WHERE grupo IN (SELECT grupo FROM bad)")
def quarantine_split(spark, d):
    ok, bad = blocks.quarantine(_laid(spark, d), "grupo", ["ano", "y", "regiao"])
    facts = lambda df, name: df.agg(F.lit(name).alias("parte"), F.count("*").alias("linhas"), F.count_distinct("grupo").alias("grupos"))
    return facts(ok, "coerentes").unionByName(facts(bad, "quarentena"))


@query(f"{GROUPS} SELECT ano::INTEGER AS ano, y, regiao, count(DISTINCT grupo) AS grupos, count(DISTINCT grupo) >= 5 AS ok FROM ok GROUP BY ano, y, regiao")
def stratum_check(spark, d):
    return blocks.stratum_check(_shared(spark, d), "grupo", ["ano", "y", "regiao"])


@query(f"""{GROUPS}, gr AS (SELECT DISTINCT grupo, ano, y FROM ok),
rk AS (SELECT *, row_number() OVER (PARTITION BY ano, y ORDER BY md5('{blocks.SALT}|' || grupo), grupo) AS pos, count(*) OVER (PARTITION BY ano, y) AS tam FROM gr)
SELECT grupo, ano::INTEGER AS ano, y, CASE WHEN pos <= greatest(1, least(floor(tam * 0.7::DOUBLE), tam - 2)) THEN 'train_ref' WHEN pos <= greatest(2, least(floor(tam * (0.7::DOUBLE + 0.15::DOUBLE)), tam - 1)) THEN 'val_ref' ELSE 'test_ref' END AS bloco FROM rk""")
def hash_blocks(spark, d):
    return blocks.hash_blocks(_shared(spark, d).select("grupo", "ano", "y").distinct(), ["ano", "y"])


def master(spark, d):
    return blocks.master_partition(_shared(spark, d), "grupo", YEARS_SHARED, YEARS_SEALED)


@query()
def cardinality_sketch_by_year(spark, d):
    """Distinct values of columns by year and of all years, from one table of stored sketches."""
    sketches = io.stored(profile.cardinality_sketches(scored(spark, d).withColumn("ano", F.col("ano").cast("string")), ["id", "grupo", "regiao", "faixa", "idade"], ["ano"]), "cardinality")
    whole = profile.united_cardinality(sketches).withColumn("ano", F.lit("todos"))
    return profile.united_cardinality(sketches, ["ano"]).unionByName(whole)


@query(f"{MASTER} SELECT id, particao FROM mp")
def master_partition(spark, d):
    return master(spark, d).select("id", "particao")


@query(f"{MASTER}, g AS (SELECT DISTINCT particao, grupo FROM mp), h AS (SELECT particao, count(*) AS grupos, sum(('0x' || md5(grupo)[1:8])::BIGINT)::BIGINT AS impressao FROM g GROUP BY particao) SELECT particao, count(*) AS linhas, string_agg(DISTINCT ano::VARCHAR, ',' ORDER BY ano::VARCHAR) AS anos, round(avg(y), 9) AS prevalencia, any_value(grupos) AS grupos, any_value(impressao) AS impressao FROM mp JOIN h USING (particao) GROUP BY particao")
def block_manifest(spark, d):
    return blocks.manifest(master(spark, d))


@query(f"""{MASTER}, e(particao, esperado) AS (VALUES ('train_ref', 0.7::DOUBLE), ('val_ref', 0.15::DOUBLE), ('test_ref', 0.15::DOUBLE)),
n AS (SELECT particao, count(*) AS n FROM mp WHERE particao <> 'exploracao' AND particao <> 'test_pandemic' GROUP BY particao), t AS (SELECT sum(n) AS t FROM n)
SELECT particao, esperado, coalesce(n, 0) AS n, round(coalesce(n / t, 0), 9) AS observado, coalesce(abs(coalesce(n / t, 0) - esperado) <= 0.005, false) AS ok FROM e FULL JOIN n USING (particao), t""")
def block_ratio_check(spark, d):
    return blocks.ratio_check(master(spark, d), "particao", among=("train_ref", "val_ref", "test_ref"))


@query(f"{MASTER}, s AS (SELECT DISTINCT particao AS bloco FROM mp), e(bloco) AS (VALUES ('train_ref'), ('val_ref'), ('test_ref'), ('calibracao')) SELECT bloco, 'esperado' AS lado FROM e WHERE bloco NOT IN (SELECT bloco FROM s) UNION ALL SELECT bloco, 'observado' FROM s WHERE bloco NOT IN (SELECT bloco FROM e)")
def block_set_difference(spark, d):
    return blocks.same_blocks(master(spark, d), ("train_ref", "val_ref", "test_ref", "calibracao"))


@query(f"{GROUPS} SELECT DISTINCT a.grupo FROM sc a JOIN sc b USING (grupo) WHERE a.ano = 1995 AND b.ano = 1996")
def groups_in_both_years(spark, d):
    return blocks.shared_groups(_laid(spark, d), 1995, 1996, "ano")


@query(f"""{GROUPS}, sz AS (SELECT count(DISTINCT grupo) AS g FROM sc GROUP BY ano, y, regiao) SELECT 'grupo_nulo' AS verificacao, count(*) FILTER (grupo IS NULL) AS observado, count(*) FILTER (grupo IS NULL) = 0 AS ok FROM sc
UNION ALL SELECT 'estrato_nulo', count(*) FILTER (ano IS NULL OR y IS NULL OR regiao IS NULL), count(*) FILTER (ano IS NULL OR y IS NULL OR regiao IS NULL) = 0 FROM sc
UNION ALL SELECT 'grupo_em_estratos', count(*), count(*) = 0 FROM bad UNION ALL SELECT 'estrato_pequeno', count(*) FILTER (g < 5), count(*) FILTER (g < 5) = 0 FROM sz""")
def stratum_validation(spark, d):
    return blocks.check_strata(_laid(spark, d), "grupo", ["ano", "y", "regiao"])


@query(f"{MASTER} SELECT grupo, count(DISTINCT particao) AS blocos FROM mp GROUP BY grupo HAVING count(DISTINCT particao) > 1")
def groups_crossing_blocks(spark, d):
    return blocks.crossing(master(spark, d))


@query(f"WITH {SQL_SCORED}, rk AS (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY md5('metades-1|' || id), id) AS pos, count(*) OVER (PARTITION BY y) AS tam FROM sc) SELECT id, y, CASE WHEN 2 * pos <= tam THEN 'calibracao' ELSE 'medida' END AS metade FROM rk")
def strat_halves(spark, d):
    return blocks.halves(scored(spark, d).select("id", "y"), ["y"], "id")


QUOTA = f"""WITH {SQL_SCORED}, n AS (SELECT ano, y, count(*) AS n FROM sc GROUP BY ano, y), s AS (SELECT *, 1000 * n / sum(n) OVER () AS share FROM n),
q0 AS (SELECT *, floor(share) AS piso, row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, ano, y) AS o, 1000 - sum(floor(share)) OVER () AS falta FROM s),
q AS (SELECT ano, y, least(n, greatest(1, piso + (o <= falta)::INTEGER)) AS cota FROM q0),
rk AS (SELECT sc.*, row_number() OVER (PARTITION BY ano, y ORDER BY md5('cotas-1|' || id), id) AS pos FROM sc), qs AS (SELECT rk.* FROM rk JOIN q USING (ano, y) WHERE pos <= cota)"""


@query(f"{QUOTA} SELECT id, ano::INTEGER AS ano, y FROM qs")
def strat_quota_sample(spark, d):
    return blocks.quota_sample(scored(spark, d).select("id", "ano", "y"), ["ano", "y"], "id", 1000).select("id", "ano", "y")


@query("SELECT doc_id, quality FROM labels ORDER BY md5('amostra-1|' || doc_id), doc_id LIMIT 200")
def random_subsample(spark, d):
    return blocks.random_subsample(read(spark, d, "labels").select("doc_id", "quality"), "doc_id", 200)


@query(f"{QUOTA}, a AS (SELECT (SELECT avg(y) FROM sc) AS o, (SELECT avg(y) FROM qs) AS s) SELECT round(o, 9) AS original, round(s, 9) AS amostra, abs(o - s) <= 0.002 AS ok FROM a")
def sample_drift(spark, d):
    rows = scored(spark, d).select("id", "ano", "y")
    return blocks.drift(rows, blocks.quota_sample(rows, ["ano", "y"], "id", 1000))


WIDE = ["nu_notific", "dt_sin_pri", "dt_interna", "hospital", "fator_risc", *CONDITIONS, *SYMPTOMS]
MISSING = " UNION ALL ".join(f"SELECT '{c}' AS coluna, count({c}) AS presentes, count(*) - count({c}) AS ausentes, round(100 * (count(*) - count({c})) / count(*), 6) AS pct_ausente FROM ep" for c in WIDE)


@query(f"WITH {SQL_EPISODES} {MISSING}")
def missingness(spark, d):
    return profile.missingness(episodes(spark, d), WIDE)


@query(f"WITH {SQL_EPISODES} SELECT * FROM ({MISSING}) ORDER BY pct_ausente DESC, coluna LIMIT 10")
def topk_missing(spark, d):
    return profile.top(profile.missingness(episodes(spark, d), WIDE), 10, F.desc("pct_ausente"), F.col("coluna"))


FILL = f"{SQL_MASKS}, y AS (SELECT *, year(dia)::INTEGER AS ano FROM m), f AS (" + " UNION ALL ".join(f"SELECT ano, '{c}' AS coluna, round(100 * count({c}) / count(*), 6) AS pct FROM y GROUP BY ano" for c in SYMPTOMS) + ")"


def _filled(spark, d):
    return profile.fill_by(episodes(spark, d).withColumn("ano", F.year(codes.iso_date(F.col("dt_interna")))), "ano", SYMPTOMS)


@query(f"{FILL} SELECT * FROM f")
def fill_by_year(spark, d):
    return _filled(spark, d)


@query(f"{FILL} SELECT coluna, round(max(pct) - min(pct), 6) AS amplitude, count(ano) AS anos FROM f GROUP BY coluna")
def fill_amplitude(spark, d):
    return profile.fill_amplitude(_filled(spark, d), "ano")


LINE = ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey", "l_tax", "l_discount"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS coluna, count(DISTINCT {c}) AS distintos, count(DISTINCT {c}) + (count(*) > count({c}))::BIGINT AS distintos_com_nulo FROM lineitem" for c in LINE))
def cardinality(spark, d):
    return profile.cardinality(read(spark, d, "lineitem"), LINE)


FREQ = ["fator_risc", "cs_sexo", "tp_idade", "evolucao", "hospital"]


@query(f"WITH {SQL_EPISODES}, " + "v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS coluna, {c} AS valor FROM ep" for c in FREQ) + "), n AS (SELECT coluna, valor, count(*) AS n FROM v GROUP BY ALL) SELECT coluna, valor, n, round(100 * n / sum(n) OVER (PARTITION BY coluna), 6) AS pct FROM n QUALIFY count(*) OVER (PARTITION BY coluna) <= 30")
def frequency_tables(spark, d):
    return profile.frequencies(episodes(spark, d), FREQ)


@query("WITH p AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) SELECT sum(n)::BIGINT AS linhas, count(*) AS chaves, count(*) FILTER (n > 1) AS chaves_repetidas, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS linhas_repetidas FROM p")
def duplicate_summary(spark, d):
    return profile.duplicate_summary(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS vezes FROM lineitem QUALIFY vezes > 1")
def duplicate_rows(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return profile.duplicate_rows(rows, ["l_orderkey", "l_linenumber"])


@query(f"{MASTER}, p AS (SELECT particao, count(*) AS n, sum(y)::BIGINT AS positivos, round(avg(y), 9) AS prevalencia, min(ano)::INTEGER AS ano_min, max(ano)::INTEGER AS ano_max, count(DISTINCT grupo) AS grupos FROM mp GROUP BY particao) SELECT *, round(100 * n / sum(n) OVER (), 6) AS pct FROM p")
def partition_summary(spark, d):
    return profile.group_summary(master(spark, d), "particao", "y", "ano", "grupo")


NAMES = ["train_ref", "val_ref", "test_ref", "test_pandemic", "exploracao"]


@query(f"{MASTER}, w AS (SELECT regiao, " + ", ".join(f"count(*) FILTER (particao = '{b}') AS {b}" for b in NAMES) + " FROM mp GROUP BY regiao) SELECT regiao, " + ", ".join(f"round(100 * {b} / nullif(sum({b}) OVER (), 0), 6) AS {b}" for b in NAMES) + " FROM w")
def crosstab_pct(spark, d):
    return profile.crosstab_pct(master(spark, d), "regiao", "particao", NAMES)


@query(f"WITH {SQL_EPISODES} SELECT id_registro, {SQL_COMPLETE} AS completude, ({' + '.join(f'coalesce({c} IN ({chr(39)}1{chr(39)}, {chr(39)}2{chr(39)}), false)::INTEGER' for c in CONDITIONS)}) > 0 AS alguma_resposta, {SQL_PATTERN} AS padrao FROM ep")
def completeness_pattern(spark, d):
    of = lambda names: [F.col(c) for c in names]
    return episodes(spark, d).select("id_registro", codes.completeness(of(ANSWERS)).alias("completude"), codes.any_answer(of(CONDITIONS)).alias("alguma_resposta"), codes.fill_pattern(of(SECONDARY), of(CONDITIONS)).alias("padrao"))


@query(f"WITH {SQL_SCORED} SELECT padrao || '|' || {SQL_COARSE} AS rotulo, padrao, {SQL_COARSE} AS ampla, count(*) AS n FROM sc GROUP BY ALL")
def composite_labels(spark, d):
    rows = scored(spark, d).select(codes.label(F.col("padrao"), codes.coarse_band(F.col("faixa"))).alias("rotulo"))
    return rows.groupBy("rotulo").agg(F.count("*").alias("n")).select("rotulo", codes.label_part(F.col("rotulo"), 0).alias("padrao"), codes.label_part(F.col("rotulo"), 1).alias("ampla"), "n")


@query(f"{SQL_MASKS} SELECT id_registro, {DAYS}::INTEGER AS dias FROM m WHERE {DAYS} BETWEEN 0 AND {rules.MOST_DAYS}")
def interval_kept(spark, d):
    days = codes.days_between(codes.iso_date(F.col("dt_sin_pri")), codes.iso_date(F.col("dt_interna")))
    return episodes(spark, d).where(codes.kept_interval(days, rules.MOST_DAYS, "descartar")).select("id_registro", days.alias("dias"))
