"""Mixing of sources to target weights by min-cost flow.

Documents are summed by membership pattern (the set of sources that they count for). The
flow routes words of patterns to the quotas of sources; a pattern's second use costs more
than its first, so documents repeat only where a quota cannot be met otherwise. A pattern's
flow is then dealt to its documents: whole repeats for all, and the rest in a seeded order,
the last document giving only the words that are still wanted.

Only sums by pattern reach the driver: a few rows, as many as there are different patterns.

Defined cases: a null or empty text has no words and gives none; a null source is a source of its own, the last;
sources without words have target 0; null ids are documents as any other; repeated rows each count, and rows that tie in the seeded
order share one place in it by size; long texts are counted whole; an empty table gives an empty
result; other columns pass through ``mix`` unchanged, but for names that begin with ``_mix_`` and a column ``taken``, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_GAP, documents, stored

WEIGHTS = (3, 1, 2)
TOTAL = 1.5  # of all words
REPEATS = 2
COSTS = (1, 4)  # of a word's first and second use
SEED = "mix-1"


def targets(sizes: list[int], weights: list[int], total: float, most: int = REPEATS) -> list[float]:
    """Shares of total by weight; none above most times its size, the excess reshared by weight."""
    capped: set[int] = set()
    while True:
        left = total - sum(most * sizes[i] for i in capped)
        level = left / max(1, sum(w for i, w in enumerate(weights) if i not in capped))
        over = {i for i, w in enumerate(weights) if i not in capped and w * level > most * sizes[i]}
        if not over:
            return [float(most * s) if i in capped else w * level for i, (s, w) in enumerate(zip(sizes, weights, strict=True))]
        capped |= over


def route(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], costs: tuple[int, ...] = COSTS) -> list[int]:
    """Words taken from each pattern (sources, words) so that quotas are met at the least cost.

    Successive shortest paths on the graph start -> pattern (one arc a use) -> source -> end.
    """
    p, s = len(patterns), len(quotas)
    start, end = p + s, p + s + 1
    arcs: list[list[int]] = []  # from, to, room, cost; the reverse arc follows
    out: list[list[int]] = [[] for _ in range(p + s + 2)]

    def arc(a: int, b: int, room: int, cost: int) -> None:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            out[x].append(len(arcs))
            arcs.append([x, y, r, c])

    for i, (members, words) in enumerate(patterns):
        for cost in costs:
            arc(start, i, words, cost)
        for m in members:
            arc(i, p + m, len(costs) * words, 0)
    for j, quota in enumerate(quotas):
        arc(p + j, end, quota, 0)
    while True:
        far, by, queue = {start: 0}, {}, [start]
        while queue:
            x = queue.pop(0)
            for k in out[x]:
                _, y, room, cost = arcs[k]
                if room > 0 and far[x] + cost < far.get(y, 1 << 60):
                    far[y], by[y] = far[x] + cost, k
                    if y not in queue:
                        queue.append(y)
        if end not in far:
            break
        path, y = [], end
        while y != start:
            path.append(by[y])
            y = arcs[by[y]][0]
        push = min(arcs[k][2] for k in path)
        for k in path:
            arcs[k][2] -= push
            arcs[k ^ 1][2] += push
    per = 2 * (len(costs))
    taken, k = [], 0
    for members, _ in patterns:
        taken.append(sum(arcs[k + 2 * c + 1][2] for c in range(len(costs))))
        k += per + 2 * len(members)
    return taken


def word_count(column: str = "text"):
    return F.coalesce(F.regexp_count(column, F.lit(f"[^{WORD_GAP}]+")), F.lit(0)).cast("long")


def _bucket(seed: str):
    return F.substring(_key(seed), 1, 3)


def _key(seed: str):
    return F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def loads(sized: DataFrame, pattern: str, seed: str = SEED) -> DataFrame:
    """Words by pattern and bucket of the seeded order, written once: 4096 rows a pattern at most."""
    return stored(sized.groupBy(F.col(pattern).alias("_mix_p"), _bucket(seed).alias("_mix_bucket")).agg(F.sum("size").alias("_mix_words")), "mix-loads")


def parted(sized: DataFrame, pattern: str, quotas: dict, held: DataFrame, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """Rows with ``taken`` where their bucket is in or out as a whole, and the rows of the bucket at each pattern's edge, for ``dealt``.

    Rows meet one row for each pattern, by broadcast, and are not moved. held: their ``loads``.
    """
    spark = sized.sparkSession
    sums = held.groupBy("_mix_p").agg(F.sum("_mix_words").alias("words")).collect()
    names = list(quotas)
    members = [(tuple(names.index(m) for m in r["_mix_p"] if m in quotas), r["words"]) for r in sums]
    flow = route(members, [int(quotas[m]) for m in names])
    kind = dict(sized.dtypes)[pattern]
    plan = [(r["_mix_p"], f // r["words"] if r["words"] else 0, f % r["words"] if r["words"] else 0) for r, f in zip(sums, flow, strict=True)]
    plan = F.broadcast(spark.createDataFrame(plan, f"_mix_p {kind}, _mix_uses long, _mix_rest long"))  # a row for each pattern
    # whole buckets of the seeded order are in or out; only the one at the edge is ordered
    after = F.sum("_mix_words").over(W.partitionBy("_mix_p").orderBy("_mix_bucket"))
    edge = held.withColumn("_mix_after", after).join(plan, "_mix_p").where("_mix_after > _mix_rest").groupBy("_mix_p").agg(F.min(F.struct("_mix_bucket", (F.col("_mix_after") - F.col("_mix_words")).alias("before"))).alias("e"))
    cuts = plan.join(edge, "_mix_p", "left").select("*", F.coalesce("e.before", F.lit(0)).alias("_mix_before"), F.coalesce("e._mix_bucket", F.lit("")).alias("_mix_edge")).drop("e")
    rows = sized.drop("taken").join(F.broadcast(cuts), F.col(pattern).eqNullSafe(F.col("_mix_p")))
    extra = F.when(_bucket(seed) < F.col("_mix_edge"), F.col("size")).otherwise(0)
    whole = rows.where(_bucket(seed) != F.col("_mix_edge")).withColumn("taken", F.col("_mix_uses") * F.col("size") + extra)
    return whole.drop(*(c for c in whole.columns if c.startswith("_mix_"))), rows.where(_bucket(seed) == F.col("_mix_edge"))


def dealt(edge: DataFrame, seed: str = SEED) -> DataFrame:
    """Add ``taken`` to rows at an edge: in the seeded order, until the pattern's words are reached."""
    order = W.partitionBy("_mix_p").orderBy(_key(seed), "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    used = F.greatest(F.lit(0), F.least("size", F.col("_mix_rest") - F.col("_mix_before") - F.coalesce(F.sum("size").over(order), F.lit(0))))
    rows = edge.withColumn("taken", F.col("_mix_uses") * F.col("size") + used)
    return rows.drop(*(c for c in rows.columns if c.startswith("_mix_")))


def mix(sized: DataFrame, pattern: str, quotas: dict, seed: str = SEED, held: DataFrame | None = None) -> DataFrame:
    """Add ``taken``: words of each row in the mix.

    sized: ``doc_id, size`` and an array column of the sources a row counts for; quotas: words by source; held: the rows' ``loads``.
    """
    whole, edge = parted(sized, pattern, quotas, loads(sized, pattern, seed) if held is None else held, seed)
    return whole.unionByName(dealt(edge, seed))


def aims(held: DataFrame) -> list[tuple[str | None, int, float]]:
    """(source, its words, its target) under the fixed weights, from loads by single sources."""
    sums = held.groupBy("_mix_p").agg(F.sum("_mix_words").alias("words")).collect()
    sums = sorted(((r["_mix_p"][0], r["words"]) for r in sums), key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [w for _, w in sums]
    found = targets(sizes, [WEIGHTS[i % 3] for i in range(len(sums))], TOTAL * sum(sizes))
    return [(name, w, a) for (name, w), a in zip(sums, found, strict=True)]


def mix_sources(docs: DataFrame, *keep: str) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` and the columns named, under the fixed weights of the sources."""
    spark = docs.sparkSession
    sized = stored(docs.select("doc_id", *keep, F.array("source").alias("sources"), word_count().alias("size")), "op8-sizes")
    held = loads(sized, "sources")
    told = aims(held)
    out = mix(sized, "sources", {name: int(a) for name, _, a in told}, held=held)
    facts = F.broadcast(spark.createDataFrame([([n], w, a) for n, w, a in told], "sources array<string>, source_size long, target double"))
    return out.join(facts, "sources").select("doc_id", *keep, "size", "source_size", "target", "taken")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, sum(source_size) OVER () AS everything FROM s),
o AS (
  SELECT *, 2 * source_size / w AS r, row_number() OVER (ORDER BY 2 * source_size / w, source NULLS LAST) AS i FROM w),
l AS (
  SELECT *, (1.5::DOUBLE * everything::DOUBLE - coalesce(sum(2 * source_size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM o),
u AS (SELECT min(level) FILTER (w * level <= 2 * source_size) AS x, min(i) FILTER (w * level <= 2 * source_size) AS first_i FROM l),
t AS (
  SELECT l.source, source_size, CASE WHEN i < first_i THEN (2 * source_size)::DOUBLE ELSE w * (SELECT level FROM l WHERE i = (SELECT first_i FROM u)) END AS target
  FROM l, u),
f AS (
  SELECT doc_id, size, source_size, target, floor(target)::BIGINT AS flow,
    coalesce(sum(size) OVER (PARTITION BY t.source ORDER BY md5('mix-1' || coalesce(doc_id::VARCHAR, '')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size = 0 THEN 0 ELSE (flow // source_size) * size + greatest(0, least(size, flow % source_size - before)) END)::BIGINT AS taken
FROM f
"""
