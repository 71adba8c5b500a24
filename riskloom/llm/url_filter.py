"""URL filters: given rules by host and path, and rules of URL tokens mined from labels by FP-growth.

A given rule fits its host and all subdomains where the path starts with the rule's; the longest decides. Other
URLs are judged by mined rules:

1. a URL becomes tokens: scheme, host labels numbered from the right, path segments, names of query parameters and
   whether there is a fragment, digits as ``#``; the number in the path names the document, and so its labels: bad is
   quality 0 or toxic 1;
2. a rule's tokens stand in as many bad URLs as the rule's support asks for, so all tokens that do are kept and no
   others; each labelled URL's, with the label itself, are one transaction of Spark's FP-growth. Tokens that stand in
   the same labelled URLs are one item, as any of them makes the same rules, and those in all URLs are none;
3. rules whose consequent is the label stay if they have support and confidence and the lower end of the
   confidence's Wilson interval lies above the base rate;
4. each rule is posted under its rarest token; token sets, each once, meet the postings, and a set that holds a
   whole rule is blocked.

Defined cases: a null URL, or one without ``://``, has an empty host and path and no tokens, so it is allowed;
labels without an id count for nothing, and of several for one id any bad one counts; rows of one page id and equal
rows stay; rules of one length are tried in the order given; without labels nothing is mined; an empty table gives
an empty result; other columns of the tables are dropped.
"""

from __future__ import annotations

from math import ceil

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
LEAST, SUPPORT, CONFIDENCE, Z = 5, 0.002, 0.5, 1.96  # LEAST rows and this share of labelled URLs must hold a whole rule and be bad
VOCABULARY, IN_FIT = 64, 12  # bounds of the SQL alone, which counts the subsets of a URL's tokens one by one
BAD = "=block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    return F.coalesce(F.substr(url, F.nullif(F.instr(url, "://"), F.lit(0)) + 3), F.lit(""))


def parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path."""
    rest = after_scheme(url)
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_for(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest given rule that fits ``host`` and ``path``; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, host, path in reversed(sorted(rules, key=lambda r: -len(r[1] + r[2]))):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL, sorted; no scheme, no tokens."""
    rest, (host, path) = after_scheme(url), parts(url)
    blank = lambda c: F.regexp_replace(c, "[0-9]+", "#")
    told = lambda c: F.filter(c, lambda x: x != "")
    labels = F.transform(F.reverse(told(F.split(host, "\\."))), lambda x, i: F.concat((i + 1).cast("string"), F.lit(":"), blank(x)))
    segments = F.transform(told(F.split(path, "/")), lambda x: F.concat(F.lit("/"), blank(x)))
    names = F.transform(told(F.split(F.regexp_extract(rest, "^[^?#]*\\?([^#]*)", 1), "&")), lambda x: F.concat(F.lit("?"), blank(F.split_part(x, F.lit("="), F.lit(1)))))
    scheme = F.array(F.concat(F.translate(F.split_part(url, F.lit("://"), F.lit(1)), UPPER, LOWER), F.lit(":")))
    fragment = F.when(F.instr(rest, "#") > 0, F.array(F.lit("#"))).otherwise(F.array().cast("array<string>"))
    every = F.array_sort(F.array_distinct(F.concat(scheme, labels, segments, names, fragment)))
    return F.when(F.instr(url, "://") > 0, every).otherwise(F.array().cast("array<string>"))


def document_of(path: Column) -> Column:
    """The number that is a path segment, or its start before a point: the id of the page's document."""
    return F.regexp_extract(path, "/([0-9]{1,18})(\\.[^/]*)?(/|$)", 1).try_cast("long")


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``tokens, bad`` of the pages whose document is labelled."""
    bad = F.max(F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.col("quality") == 0, F.col("toxic") == 1, F.lit(False)).cast("int"))
    per = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("document")).agg(bad.alias("bad"))
    return pages.select("tokens", document_of(F.col("path")).alias("document")).join(per, "document").select("tokens", "bad")


def held_tokens(rows: DataFrame, n: int, least: int, support: float) -> DataFrame:
    """``token, n, b, one, two``: tokens in enough bad URLs, and marks that are equal where the same URLs hold two tokens."""
    mark = lambda seed: F.sum(F.xxhash64(F.lit(seed), "tokens").cast("decimal(38,0)"))
    told = rows.groupBy("tokens").agg(F.count("*").alias("n"), F.sum("bad").alias("b"))
    told = told.select("tokens", "n", "b", F.explode("tokens").alias("token"))
    return told.groupBy("token").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), mark(1).alias("one"), mark(2).alias("two")).where(F.col("b") >= max(least, ceil(support * n)))


def vocabulary(rows: DataFrame, n: int, bad: int, least: int = LEAST, support: float = SUPPORT) -> list[tuple[str, int]]:
    """All tokens that a rule can hold, with the number of labelled URLs that hold them, the most associated with the label first.

    Each stands in at least a share ``support`` of the URLs, so they are at most the mean number of tokens over that share.
    """
    gap = (F.col("b") * n - F.col("n") * bad).cast("double")
    chi = F.try_divide(gap * gap, F.col("n").cast("double") * F.lit(float(n)) - F.col("n").cast("double") * F.col("n").cast("double"))
    return [(r["token"], r["n"]) for r in held_tokens(rows, n, least, support).orderBy(F.coalesce(chi, F.lit(0.0)).desc(), "token").collect()]


def items(rows: DataFrame, n: int, least: int, support: float, alike: bool) -> list[tuple[list[str], int]]:
    """The items of the fit: tokens that stand for each other, and the number of URLs that hold them, rarest first.

    alike: tokens in the same URLs are one item, and those in all URLs none; a set that holds one of a rule's tokens holds
    the rule's item, so the same URLs are blocked as by the rules of all tokens.
    """
    tokens = held_tokens(rows, n, least, support)
    by = tokens.where(F.col("n") < n).groupBy("n", "b", "one", "two") if alike else tokens.groupBy("n", "token")
    return [(r["held"], r["n"]) for r in by.agg(F.array_sort(F.collect_list("token")).alias("held")).select("n", "held").orderBy("n", "held").collect()]


def mine(rows: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST, alike: bool = False) -> DataFrame:
    """``tokens, n_both, n_tokens, confidence, choices``: rules by which URLs are blocked.

    ``choices`` has the tokens of each item, the rarest item first; ``tokens`` the first of each. alike: see ``items``.
    """
    spark, kind = rows.sparkSession, "tokens array<string>, n_both long, n_tokens long, confidence double, choices array<array<string>>"
    n, bad = rows.agg(F.count("*"), F.coalesce(F.sum("bad"), F.lit(0))).first()
    words = items(rows, n, least, support, alike) if bad else []
    if not words:
        return spark.createDataFrame([], kind)
    known = F.broadcast(spark.createDataFrame([([w for w, _ in words],)], "_known array<array<string>>"))  # one row
    held = F.transform(F.filter("_known", lambda w: F.array_contains("tokens", w[0])), lambda w: w[0])
    baskets = rows.crossJoin(known).select(F.when(F.col("bad") == 1, F.concat(held, F.array(F.lit(BAD)))).otherwise(held).alias("items"))
    fewest = max(least, ceil(support * n))
    model = FPGrowth(itemsCol="items", minSupport=(fewest - 0.5) / n, minConfidence=confidence).fit(baskets)
    found = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD)))
    # counts from shares, which the rules carry as doubles
    found = found.select(F.array_sort("antecedent").alias("tokens"), F.round(F.col("support") * n).cast("long").alias("n_both"), F.round(F.col("support") * n / F.col("confidence")).cast("long").alias("n_tokens"))
    share = F.col("n_both") / F.col("n_tokens")
    z2 = Z * Z
    low = (share + z2 / (2 * F.col("n_tokens")) - Z * F.sqrt((share * (1 - share) + z2 / (4 * F.col("n_tokens"))) / F.col("n_tokens"))) / (1 + z2 / F.col("n_tokens"))
    kept = found.where((low > bad / n) & (share >= confidence)).crossJoin(known)
    return kept.select("tokens", "n_both", "n_tokens", share.alias("confidence"), F.filter("_known", lambda w: F.array_contains("tokens", w[0])).alias("choices"))


def blocked_sets(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """The token sets that hold a whole rule: sets meet rules by the tokens of a rule's rarest item, then all items are checked."""
    posted = rules.select(F.col("choices").alias("_rule"), F.explode(F.col("choices")[0]).alias("_token"))
    met = sets.select("tokens", F.explode("tokens").alias("_token")).join(posted, "_token")
    return met.where(F.forall("_rule", lambda w: F.arrays_overlap(w, "tokens"))).select("tokens").distinct()


def judge(pages: DataFrame, labels: DataFrame, given=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of each page."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"), tokens(F.col("url")).alias("tokens"))
    rules = stored(mine(stored(labelled(rows, labels), "url-labelled"), alike=True), "url-rules")
    rule, verdict = rule_for(given)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("told"))
    gone = stored(blocked_sets(rows.where("rule is null").select("tokens").distinct(), rules), "url-blocked")
    mined = F.when(F.col("_hit"), "block").otherwise("allow")
    return rows.join(gone.select("tokens", F.lit(True).alias("_hit")), "tokens", "left").select("page_id", "host", "path", "rule", F.coalesce("told", mined).alias("verdict"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table("pages")(spark, sf_dir), table("labels")(spark, sf_dir))


_BLANK = "regexp_replace({0}, '[0-9]+', '#', 'g')"
_FITS = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
_BY_LENGTH = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
_CASE = lambda i: "CASE " + " ".join(f"WHEN {_FITS.format(h, p)} THEN '{(v, h + p)[i]}'" for v, h, p in _BY_LENGTH) + " END"

# FP-growth's itemsets are the subsets of transactions, which SQL counts one by one
SQL = f"""
WITH u AS (SELECT row_number() OVER () AS k, page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT k, page_id, url, rest, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
t AS (SELECT *, {_CASE(1)} AS rule, {_CASE(0)} AS told, CASE WHEN instr(url, '://') > 0 THEN list_sort(list_distinct(list_concat(
    [translate(split_part(url, '://', 1), '{UPPER}', '{LOWER}') || ':'],
    list_transform(list_reverse(list_filter(string_split(host, '.'), lambda x: x <> '')), lambda x, i: i::VARCHAR || ':' || {_BLANK.format('x')}),
    list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: '/' || {_BLANK.format('x')}),
    list_transform(list_filter(string_split(regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> ''), lambda x: '?' || {_BLANK.format("split_part(x, '=', 1)")}),
    CASE WHEN instr(rest, '#') > 0 THEN ['#'] ELSE [] END))) ELSE []::VARCHAR[] END AS tokens FROM p),
la AS (SELECT doc_id, max((coalesce(quality = 0, false) OR coalesce(toxic = 1, false))::INTEGER) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
tr AS (SELECT k, tokens, bad FROM t JOIN la ON doc_id = try_cast(regexp_extract(path, '/([0-9]{{1,18}})(\\.[^/]*)?(/|$)', 1) AS BIGINT)),
al AS (SELECT count(*) AS n, sum(bad)::BIGINT AS b FROM tr),
st AS (SELECT token, count(*) AS n, sum(bad)::BIGINT AS b FROM (SELECT unnest(tokens) AS token, bad FROM tr) GROUP BY token HAVING count(*) >= {LEAST}),
vo AS (SELECT token, row_number() OVER (ORDER BY coalesce((st.b * al.n - st.n * al.b)::DOUBLE * (st.b * al.n - st.n * al.b)::DOUBLE / nullif(st.n::DOUBLE * al.n::DOUBLE - st.n::DOUBLE * st.n::DOUBLE, 0), 0) DESC, token) AS place FROM st, al WHERE al.b > 0),
he AS (SELECT k, bad, list(token ORDER BY place)[1:{IN_FIT}] AS items FROM (SELECT k, bad, unnest(tokens) AS token FROM tr) JOIN vo USING (token) WHERE place <= {VOCABULARY} GROUP BY k, bad),
su AS (SELECT bad, list_sort(list_filter(items, lambda x, i: (m >> (i - 1)) % 2 = 1)) AS tokens FROM he, range(1, (1 << {IN_FIT})) r(m) WHERE m < (1 << len(items))),
it AS (SELECT tokens, count(*) AS n, sum(bad)::BIGINT AS b FROM su GROUP BY tokens),
ru AS (SELECT it.tokens FROM it, al, (SELECT {Z}::DOUBLE AS z) WHERE it.b >= greatest({LEAST}, ceil({SUPPORT}::DOUBLE * al.n)) AND it.b / it.n >= {CONFIDENCE}
  AND (it.b / it.n + z * z / (2 * it.n) - z * sqrt((it.b / it.n * (1 - it.b / it.n) + z * z / (4 * it.n)) / it.n)) / (1 + z * z / it.n) > al.b / al.n),
se AS (SELECT DISTINCT s.tokens FROM (SELECT DISTINCT tokens FROM t) s JOIN ru ON list_has_all(s.tokens, ru.tokens))
SELECT page_id, host, path, rule, coalesce(told, CASE WHEN se.tokens IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict FROM t LEFT JOIN se USING (tokens)"""
