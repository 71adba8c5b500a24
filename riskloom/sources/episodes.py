"""Views that the queries audit: episodes made of orders and their lines, and scored episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONDITIONS = [f"c{i}" for i in range(1, 14)]
SYMPTOMS = [f"s{i}" for i in range(1, 12)]
PRIMES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41)


METHOD_BYTES = 8000  # the JVM compiles no longer methods: whole stages of the many codes would be interpreted for each row


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SECONDARY = [SYMPTOMS[i] for i in (2, 4, 5, 6, 7, 8, 9)]
ANSWERS = SYMPTOMS + CONDITIONS


def _code(i: int, symptom: bool = False):
    """Codes '1', '2', '9' and null by remainders of the part key; some records have blank symptoms or no denied condition."""
    p = PRIMES[i % len(PRIMES)]
    pk = F.col("pk")
    blank, no = (pk % 11 == 4, "2") if symptom else (F.lit(False), F.when(pk % 7 == 3, "1").otherwise("2"))
    return F.when(blank | (pk % (p + 2) == 0), F.lit(None)).when(pk % (p + 3) == 1, "9").when((pk + i) % 2 == 0, no).otherwise("1")


FLAG_A, FLAG_R = 1, 3


def _flag(c: Column) -> Column:
    """The order of flags around A and R as a number: the least of numbers is that of the least flag, and needs no sort."""
    return F.when(c < "A", 0).when(c == "A", FLAG_A).when(c < "R", 2).when(c == "R", FLAG_R).when(c > "R", 4)


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their order's facts, from which the columns of episodes are told.

    Lines travel once, by order, before repeated keys meet; orders bring their customer's nation, whose names come last.
    Lines are dealt to all shuffle partitions, which Spark would merge into a few large tasks by their bytes, little
    as these say of the columns' work; within a task lines are neither sorted nor joined by sorting.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(METHOD_BYTES))
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("pk"), F.col("l_quantity").alias("q"), _flag(F.col("l_returnflag")).alias("rf"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = lines.repartition(parts, "k").groupBy("k", "n").agg(F.min("pk").alias("pk"), F.min("q").alias("q"), F.min("rf").alias("rf"))
    place = read(spark, sf_dir, "nation").join(F.broadcast(read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("sg_uf"), F.col("r_name").alias("regiao"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderpriority")
    orders = orders.join(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey", "c_custkey")
    return lines.join(orders.hint("shuffle_hash"), "k").join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey"))  # a row a nation


def _columns() -> dict[str, Column]:
    """The columns of episodes by name."""
    k, n = F.col("k"), F.col("n")
    rid = (k * 8 + n).cast("string")
    evolucao = F.when(F.col("o_orderpriority") == "1-URGENT", "2").when(F.col("o_orderpriority") == "5-LOW", "9").otherwise("1")
    u = F.conv(F.substring(F.md5(rid), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    y = F.when(evolucao == "2", 1).otherwise(0)
    return {
        "id_registro": rid,
        "nu_notific": F.when(k % 97 == 0, "").when(k % 103 == 0, "NaN").otherwise(k.cast("string")),
        "dt_sin_pri": F.when(k % 41 == 0, F.lit(None)).otherwise(F.col("day").cast("string")),
        "dt_interna": F.when(k % 29 == 0, F.lit(None)).when(k % 113 == 0, "xx").otherwise(F.date_add("day", (k % 75 - 5 + n % 2).cast("int")).cast("string")),
        "hospital": F.when(k % 20 == 0, "2").when(k % 23 == 0, F.lit(None)).when(n == 3, "1.0").otherwise("1"),
        "evolucao": evolucao,
        "nu_idade_n": (F.col("q") * 2).cast("int").cast("string"),
        "tp_idade": F.when(F.col("pk") % 10 == 0, "1").when(F.col("pk") % 10 == 1, "2").otherwise("3"),
        "cs_sexo": F.when(F.col("rf") == FLAG_A, "M").when(F.col("rf") == FLAG_R, "F").otherwise("I"),
        "sg_uf": F.col("sg_uf"),
        "regiao": F.col("regiao"),
        "fator_risc": F.when(F.col("pk") % 7 == 0, F.lit(None)).when(F.col("pk") % 5 == 0, "2").when(F.col("pk") % 5 == 1, "9").otherwise("1"),
        **{c: _code(i) for i, c in enumerate(CONDITIONS)},
        **{c: _code(i + 3, True) for i, c in enumerate(SYMPTOMS)},
        "y_true": y.cast("byte"),
        "y_prob": F.round(F.lit(0.7) * u + F.lit(0.25) * y, 3),
    }


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(spark, sf_dir).select(*(c.alias(name) for name, c in _columns().items()))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes with a known outcome and a valid admission date: id, group, y, p, year, region, band, sex."""
    from riskloom.functions import codes

    of = _columns()
    some = lambda names: [of[c] for c in names]
    # answers are told in the first step, which is the last that has them: their many texts are copied for no row
    told = _joined(spark, sf_dir).where(of["evolucao"].isin("1", "2")).select(
        of["id_registro"].alias("id"), of["nu_notific"].alias("nu_notific"), of["dt_interna"].alias("dt_interna"), of["y_true"].cast("int").alias("y"), of["y_prob"].alias("p"), "regiao", of["cs_sexo"].alias("sexo"),
        codes.completeness(some(ANSWERS)).alias("completude"), codes.fill_pattern(some(SECONDARY), some(CONDITIONS)).alias("padrao"), codes.number(of["nu_idade_n"]).alias("valor"), codes.code(of["tp_idade"]).alias("unidade"))
    dated = told.withColumn("dia", codes.iso_date(F.col("dt_interna"))).where(F.col("dia").isNotNull())
    aged = dated.withColumn("anos", codes.years_of(F.col("valor"), F.col("unidade"))).withColumn("idade", codes.lifetime(F.col("anos")))  # in steps, so that each is told once
    return aged.select("id", codes.group_id(F.col("nu_notific"), F.col("id")).alias("grupo"), "y", "p", F.year("dia").alias("ano"), "regiao", codes.age_band(F.col("idade")).alias("faixa"), "sexo", "completude", "idade", "padrao")


def _sql_code(i: int, symptom: bool = False) -> str:
    p = PRIMES[i % len(PRIMES)]
    blank, no = ("pk % 11 = 4 OR ", "'2'") if symptom else ("", "CASE WHEN pk % 7 = 3 THEN '1' ELSE '2' END")
    return f"CASE WHEN {blank}pk % {p + 2} = 0 THEN NULL WHEN pk % {p + 3} = 1 THEN '9' WHEN (pk + {i}) % 2 = 0 THEN {no} ELSE '1' END"


SQL_GIVEN = " + ".join(f"coalesce({s} IN ('1', '2'), false)::INTEGER" for s in ANSWERS)
SQL_COMPLETE = f"round(100.0::DOUBLE * ({SQL_GIVEN}) / {len(ANSWERS)}, 6)"
SQL_PATTERN = f"CASE WHEN {' + '.join(f'({s} IS NULL)::INTEGER' for s in SECONDARY)} >= 6 THEN 'sintomas_em_branco' WHEN NOT ({' OR '.join(f'coalesce({c} = {chr(39)}2{chr(39)}, false)' for c in CONDITIONS)}) THEN 'comorbidades_sem_nao' ELSE 'sim_e_nao' END"


SQL_EPISODES = f"""
ep0 AS (SELECT l_orderkey AS k, l_linenumber AS n, min(l_partkey) AS pk, min(l_quantity) AS q, min(l_returnflag) AS rf FROM lineitem GROUP BY ALL),
ep AS (
  SELECT (k * 8 + n)::VARCHAR AS id_registro, CASE WHEN k % 97 = 0 THEN '' WHEN k % 103 = 0 THEN 'NaN' ELSE k::VARCHAR END AS nu_notific,
    CASE WHEN k % 41 = 0 THEN NULL ELSE o_orderdate::DATE::VARCHAR END AS dt_sin_pri,
    CASE WHEN k % 29 = 0 THEN NULL WHEN k % 113 = 0 THEN 'xx' ELSE (o_orderdate::DATE + (k % 75 - 5 + n % 2)::INTEGER)::VARCHAR END AS dt_interna,
    CASE WHEN k % 20 = 0 THEN '2' WHEN k % 23 = 0 THEN NULL WHEN n = 3 THEN '1.0' ELSE '1' END AS hospital,
    CASE o_orderpriority WHEN '1-URGENT' THEN '2' WHEN '5-LOW' THEN '9' ELSE '1' END AS evolucao,
    floor(q * 2)::INTEGER::VARCHAR AS nu_idade_n, CASE pk % 10 WHEN 0 THEN '1' WHEN 1 THEN '2' ELSE '3' END AS tp_idade,
    CASE rf WHEN 'A' THEN 'M' WHEN 'R' THEN 'F' ELSE 'I' END AS cs_sexo, n_name AS sg_uf, r_name AS regiao,
    CASE WHEN pk % 7 = 0 THEN NULL WHEN pk % 5 = 0 THEN '2' WHEN pk % 5 = 1 THEN '9' ELSE '1' END AS fator_risc,
    {', '.join(f'{_sql_code(i)} AS {c}' for i, c in enumerate(CONDITIONS))},
    {', '.join(f'{_sql_code(i + 3, True)} AS {c}' for i, c in enumerate(SYMPTOMS))},
    CASE o_orderpriority WHEN '1-URGENT' THEN 1 ELSE 0 END AS y_true,
    round(0.7::DOUBLE * (('0x' || md5((k * 8 + n)::VARCHAR)[1:8])::BIGINT::DOUBLE / 4294967296.0::DOUBLE) + 0.25::DOUBLE * (CASE o_orderpriority WHEN '1-URGENT' THEN 1 ELSE 0 END), 3) AS y_prob
  FROM ep0 JOIN orders ON o_orderkey = k JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"""

SQL_DATE = "try_strptime(trim({0}), '%Y-%m-%d')::DATE"
SQL_AGE = """CASE WHEN a < 0 OR a > 120 THEN NULL ELSE a END"""
SQL_SCORED = f"""{SQL_EPISODES},
sc0 AS (SELECT *, {SQL_DATE.format('dt_interna')} AS dia,
    CASE tp_idade WHEN '1' THEN nu_idade_n::DOUBLE / 365.25::DOUBLE WHEN '2' THEN nu_idade_n::DOUBLE / 12::DOUBLE ELSE nu_idade_n::DOUBLE END AS a FROM ep WHERE evolucao IN ('1', '2')),
sc AS (SELECT id_registro AS id, CASE WHEN nu_notific IN ('', 'NaN') THEN 'sem_notific:' || id_registro ELSE nu_notific END AS grupo, y_true AS y, y_prob AS p, year(dia) AS ano, regiao,
    CASE WHEN a < 1 THEN '<1' WHEN a < 5 THEN '1-4' WHEN a < 12 THEN '5-11' WHEN a < 18 THEN '12-17' WHEN a < 40 THEN '18-39' WHEN a < 60 THEN '40-59' WHEN a < 80 THEN '60-79' ELSE '80+' END AS faixa,
    cs_sexo AS sexo, {SQL_COMPLETE} AS completude, a AS idade, {SQL_PATTERN} AS padrao
  FROM sc0 WHERE dia IS NOT NULL)"""
