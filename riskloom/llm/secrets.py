r"""Secret scan with Boolean trigram queries.

``trigram_query`` derives from a regular expression the trigrams that any match must hold,
as an AND of ORs. ``scan`` writes an inverted index of the trigrams that the rules need, ``(trigram, folded, text)``, a
text named by a 64-bit hash, intersects its postings by each rule's query, and runs the rule's expression on the
candidates only; rules without mandatory trigrams are run on all
texts. Two texts with one hash share their postings, which adds candidates and loses none. The list of candidates
goes to the texts by broadcast up to ``BROADCAST_ROWS``; beyond it the join shuffles. Everything is built-in functions.

Positions come from splitting a text at its matches: pieces and matches alternate, so their
lengths add up to starts. They count code points, the end exclusive.

Defined cases: a null text is empty and has no spans; ids may be null or repeat, and each row is answered for itself; spans of
different rules may overlap and tie, they go by start, then by the order of the rules; long texts are read whole; an empty
table gives an empty result; ``scan`` returns all columns of its input, of these only ones named ``spans_<kind>`` are replaced.
"""

from __future__ import annotations

import re._constants as op
import re._parser as parser
from functools import reduce
from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents

MOST_TEXTS = 32  # alternatives of a part of an expression that are followed
BROADCAST_ROWS = 1_000_000  # candidates of 16 bytes


class Rule(NamedTuple):
    kind: str
    pattern: str  # understood alike by Java and Python
    group: int = 0
    least: int = 1  # characters of the group
    fold: bool = False  # letters match in either case
    base: bool = False


# The base rules
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20, False, True),  # a run holds one match at most, so the length can stand in the expression
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, False, True),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("pem", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("login", r"[a-z]{3,10}://[^/\x20\x09-\x0D:@]{1,64}:[^/\x20\x09-\x0D:@]{1,64}@"),
)
RULES = BASE + MORE


class _Part(NamedTuple):
    texts: frozenset | None  # all texts that match, if they are few
    must: frozenset  # clauses, each a set of trigrams of which one occurs


def _trigrams(texts: frozenset) -> frozenset:
    """The clause that a text containing one of these satisfies, one for each place they share."""
    if not texts or min(map(len, texts)) < 3:
        return frozenset()
    n = min(map(len, texts))
    return frozenset(frozenset(t[i : i + 3] for t in texts) for i in range(n - 2))


def _chars(items) -> frozenset | None:
    out: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            out.add(chr(value))
        elif kind is op.RANGE and value[1] - value[0] < MOST_TEXTS:
            out |= {chr(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return frozenset(out) if len(out) <= 8 else None


def _join(parts: list[_Part]) -> _Part:
    """Parts in a row: runs of known texts are multiplied out, then turned into clauses."""
    run, must, whole = frozenset([""]), set(), True
    for part in parts:
        must |= part.must
        if part.texts is None:
            must |= _trigrams(run)
            run, whole = frozenset([""]), False
            continue
        more = frozenset(a + b for a, b in product(run, part.texts))
        if len(more) > MOST_TEXTS:
            must |= _trigrams(run) | _trigrams(part.texts)
            run, whole = part.texts, False
        else:
            run = more
    return _Part(run, frozenset(must)) if whole else _Part(None, frozenset(must) | _trigrams(run))


def _part(kind, value) -> _Part:
    anything = _Part(None, frozenset())
    if kind is op.LITERAL:
        return _Part(frozenset([chr(value)]), frozenset())
    if kind is op.IN:
        chars = _chars(value)
        return _Part(chars, frozenset()) if chars else anything
    if kind is op.SUBPATTERN:
        return _sequence(value[-1])
    if kind is op.BRANCH:
        parts = [_sequence(x) for x in value[1]]
        if all(p.texts is not None for p in parts):
            texts = frozenset().union(*(p.texts for p in parts))
            if len(texts) <= MOST_TEXTS:
                return _Part(texts, frozenset())
        clauses = [_trigrams(p.texts) if p.texts is not None else p.must for p in parts]
        return _Part(None, frozenset(frozenset().union(*c) for c in product(*clauses))) if all(clauses) else anything
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        low, high, body = value
        inner = _sequence(body)
        if (low, high) == (0, 1) and inner.texts is not None:
            return _Part(inner.texts | {""}, frozenset())
        if low and inner.texts is not None and len(inner.texts) ** min(low, 3) <= MOST_TEXTS:
            texts = reduce(lambda a, b: frozenset(x + y for x, y in product(a, b)), [inner.texts] * min(low, 3))
            return _Part(texts, frozenset()) if low == high <= 3 else _Part(None, _trigrams(texts))
        return _Part(None, inner.must if low else frozenset())
    return anything


def _sequence(items) -> _Part:
    return _join([_part(k, v) for k, v in items])


def trigram_query(pattern: str, fold: bool = False) -> list[list[str]]:
    """Clauses of trigrams: a match holds at least one of each. In lower case if letters match in either."""
    part = _sequence(parser.parse(pattern))
    clauses = part.must | (_trigrams(part.texts) if part.texts is not None else frozenset())
    return sorted(sorted({t.lower() for t in c} if fold else c) for c in clauses)


def spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, rule's place, end) of the rule's matches in a text."""
    kind = "array<struct<start:bigint,kind:int,end:bigint>>"
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    parts = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), found.alias("hit"), groups.alias("value"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        keep = x["hit"].isNotNull() & (F.length(x["value"]) >= rule.least)
        own = F.struct(start.alias("start"), F.lit(order).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["out"], F.array(own))).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("out"))
    return F.aggregate(parts, zero, step, lambda acc: acc["out"])


def postings(docs: DataFrame, key: Column, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(trigram, folded, key)`` for each trigram that some rule needs and each text that holds it."""
    need = sorted({(t, r.fold) for r in rules for c in trigram_query(r.pattern, r.fold) for t in c})
    rows = docs.where("text is not null").select(key.alias("key"), "text", F.lower("text").alias("lower"))
    held = F.array_compact(F.array(*(F.when(F.contains("lower" if fold else "text", F.lit(t)), F.struct(F.lit(t).alias("trigram"), F.lit(fold).alias("folded"))) for t, fold in need)))
    return rows.select("key", F.explode(held if need else F.array().cast("array<struct<trigram:string,folded:boolean>>")).alias("p")).select("p.trigram", "p.folded", "key")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(key, met)``: keys whose postings hold a trigram of each clause of a rule's query, and a bit for each such rule."""
    spark = index.sparkSession
    queries = [trigram_query(r.pattern, r.fold) for r in rules]
    wanted = [(t, rules[i].fold, i, j) for i, q in enumerate(queries) for j, c in enumerate(q) for t in c]
    wanted = F.broadcast(spark.createDataFrame(wanted, "trigram string, folded boolean, rule int, clause int"))  # a row for each trigram of a rule
    whole = F.broadcast(spark.createDataFrame([(i, (1 << len(q)) - 1) for i, q in enumerate(queries) if q], "rule int, clauses long"))
    met = index.join(wanted, ["trigram", "folded"]).groupBy("key", "rule").agg(F.bit_or(F.expr("shiftleft(1L, clause)")).alias("clause_bits"))
    met = met.join(whole, "rule").where("clause_bits = clauses")
    return met.groupBy("key").agg(F.sum(F.expr("shiftleft(1L, rule)")).alias("met"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add an array column of spans for each rule, named ``spans_<kind>``."""
    scratch, key = Scratch(docs.sparkSession, "op7"), F.xxhash64("text")
    index = scratch.put("postings", postings(docs, key, rules))
    found = scratch.put("candidates", candidates(index, rules).withColumnsRenamed({"key": "_op7_key", "met": "_op7_met"}))
    scratch.drop("postings")
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    rows = docs.drop(*(f"spans_{r.kind}" for r in rules)).join(found, key == F.col("_op7_key"), "left")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    text = F.coalesce("text", F.lit(""))
    for i, rule in enumerate(rules):
        named = F.coalesce(F.getbit("_op7_met", F.lit(i)) == 1, F.lit(False)) if trigram_query(rule.pattern, rule.fold) else F.lit(True)
        rows = rows.withColumn(f"spans_{rule.kind}", F.when(named & text.rlike(rule.pattern), spans(text, rule, i)).otherwise(none))
    return rows.drop("_op7_key", "_op7_met")


def told(found: Column, rules: tuple[Rule, ...]) -> Column:
    """``kind:start:end`` by start, then by the order of the rules, joined by commas."""
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(documents(spark, sf_dir).select("doc_id", "text"))
    every = lambda rules: told(F.concat(*(F.col(f"spans_{r.kind}") for r in rules)), RULES)
    return rows.select("doc_id", *(F.size(f"spans_{r.kind}").cast("long").alias(f"n_{r.kind}") for r in BASE), F.sha2(every(BASE).cast("binary"), 256).alias("base_sha256"), every(RULES).alias("spans"))


def _sql(i: int, rule: Rule) -> str:
    """DuckDB: (start, kind, end) rows of one rule, by the same alternation of pieces and matches."""
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT doc_id, {i} AS k, '{rule.kind}' AS kind, x.e - length(x.m) AS s, x.e AS e FROM (
      SELECT doc_id, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'m': m[i], 'v': v[i], 'e': list_sum(list_transform(g[1:i], lambda y: length(y)))::BIGINT + list_sum(list_transform(m[1:i], lambda y: length(y)))::BIGINT}})) AS x
      FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS v, regexp_split_to_array(t, '{pattern}') AS g
            FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WHERE regexp_matches(t, '{pattern}')))
      WHERE length(x.v) >= {rule.least}"""


SQL = f"""
WITH s AS ({' UNION ALL '.join(_sql(i, r) for i, r in enumerate(RULES))}),
a AS (
  SELECT doc_id, {', '.join(f"count(*) FILTER (k = {i}) AS n_{r.kind}" for i, r in enumerate(BASE))},
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < {len(BASE)}) AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans
  FROM s GROUP BY doc_id)
SELECT doc_id, {', '.join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in BASE)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN a USING (doc_id)
"""
