r"""Benchmark decontamination by templates.

Texts are cut into tokens, and numbers, units that follow numbers, and names (capitalised
words that do not follow an opening or a sentence's end) become typed placeholders. Windows
of ``WINDOW`` template tokens of the benchmark are hash-joined with those of all documents.
For each document and item every alignment of common windows is judged; one counts as a
leak when it covers at least ``SHARE`` of the item's windows and its slots agree: one value
of the item always meets one value of the document, and two names of the item never meet one (two numbers may). So a question with other numbers or
names is caught, and one that only shares its wording with changed roles is not.

An alignment is one shift of the places, or a band of shifts that reaches over half the
item's length, at least over a window: words put in or left out move what follows. Bands
also count windows that are equal when names are read as words in lower case, which finds
texts in capitals or without any. SQL knows the one shift with most windows only: its rows
come out alike, and the rest is added. A text that has words put in so closely that less
than ``SHARE`` of the item's windows stay whole is not found.

Windows that are placeholders only say nothing and are left out. Items with fewer tokens
than a window are compared as one window of their own length.

Only built-in functions run. Benchmark windows, and the names of the texts whose alignments are
checked, are broadcast after their count is checked;
beyond ``BROADCAST_ROWS`` and ``WANTED_ROWS`` the joins shuffle.

Defined cases: null or blank texts have no tokens and no leaks; null ids match as any id
does; an item or document given twice counts once; an empty benchmark or table gives an
empty result; an id that holds several texts matches by any of them; long texts are read whole; of alignments that tie
the smallest shift is told; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, stored, table

WINDOW = 8
SHARE = 0.5
BROADCAST_ROWS = 400_000  # windows of about 40 bytes
WANTED_ROWS = 1_000_000  # texts with alignments to check, 16 bytes each
TOKEN = r"[\p{L}\p{M}]+|[0-9]+(?:[.,][0-9]+)*|[.!?\n]"

# Units that become placeholders after a number
UNITS = ("mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "l", "s", "sec", "min", "h", "hours", "minutes", "seconds", "days", "weeks", "months", "years", "percent", "dollars", "euros", "cents", "miles", "feet", "inches", "pounds", "meters", "metres", "liters", "litres", "grams")


def _is_number(t: Column) -> Column:
    return t.substr(1, 1).between("0", "9")


def _is_end(t: Column) -> Column:
    return t.isin(".", "!", "?", "\n")


def _with(value: Column, body) -> Column:
    """body of a value that is worked out once a row, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def template(text: Column) -> Column:
    """Array of (value, template token) of a text, without sentence ends."""

    def one(t: Column, before: Column) -> Column:
        low = F.lower(t)
        start = before.isNull() | _is_end(before)
        unit = before.isNotNull() & _is_number(before) & low.isin(*UNITS)
        kind = F.when(_is_number(t), "#n").when(unit, "#u").when((low != t) & ~start, "#p").otherwise(low)
        return F.struct(low.alias("v"), F.when(_is_end(t), F.lit(None)).otherwise(kind).alias("k"))

    def all_of(raw: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("string")), F.slice(raw, 1, F.greatest(F.size(raw) - 1, F.lit(0))))
        return F.filter(F.zip_with(raw, before, one), lambda x: x["k"].isNotNull())

    return _with(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), all_of)


def hashes(kinds: Column, size: int) -> Column:
    """Hashes of the windows of an array of template tokens."""
    places = F.sequence(F.lit(1), F.size(kinds) - size + 1)
    return F.when(F.size(kinds) >= size, F.transform(places, lambda i: F.xxhash64(F.lit(size), F.slice(kinds, i, size)))).otherwise(F.array().cast("array<bigint>"))


def windows(rows: DataFrame, key: str, kinds: Column, size: int) -> DataFrame:
    """``(key, place, window)`` of each run of ``size`` template tokens; kinds: their array, from columns of rows."""
    return rows.select(key, F.posexplode(_with(kinds, lambda k: hashes(k, size))).alias("place", "window"))


def kinds_of(tokens: Column) -> Column:
    return F.transform(tokens, lambda x: x["k"])


def folded_of(tokens: Column) -> Column:
    """The template without names: words in lower case, however they were written."""
    return F.transform(tokens, lambda x: F.when(x["k"] == "#p", x["v"]).otherwise(x["k"]))


def folded_places(kinds: Column, size: int) -> Column:
    """First places (from 1) of the windows that hold a name, whose folded form is another one."""
    at = F.filter(F.transform(kinds, lambda k, i: F.when(k == "#p", i + 1)), lambda i: i.isNotNull())
    last = F.size(kinds) - size + 1
    near = F.transform(at, lambda i: F.sequence(F.greatest(i - size + 1, F.lit(1)), F.least(i, last)))
    return F.when(last >= 1, F.array_distinct(F.flatten(near))).otherwise(F.array().cast("array<int>"))


def tokens_of(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, template(F.col("text")).alias("t"))


def _words(kinds: Column, size: Column) -> Column:
    """How many tokens of each window are no placeholders."""
    w = F.transform(kinds, lambda k: (~k.startswith("#")).cast("int"))
    return _with(w, lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.aggregate(F.slice(w, i, size), F.lit(0), lambda a, b: a + b)))


def _slots_agree(slots: Column) -> Column:
    names = F.filter(slots, lambda x: x["k"] == "#p")
    one_to_one = F.size(names) == F.size(F.array_distinct(F.transform(names, lambda x: x["b"])))
    return (F.size(slots) == F.size(F.array_distinct(F.transform(slots, lambda x: F.struct(x["k"], x["a"]))))) & one_to_one


def _met(item: Column, doc: Column) -> Column:
    """Pairs of tokens of two equally long runs: (kind in the item, its value, the document's value)."""
    return F.zip_with(item, doc, lambda a, b: F.struct(a["v"].alias("a"), b["v"].alias("b"), a["k"].alias("k"), (a["k"] == b["k"]).alias("same")))


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """``doc_id, item_id, n_windows, item_windows, n_slots`` of each leak."""
    texts = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    items = stored(tokens_of(texts.withColumn("item", F.monotonically_increasing_id()), "item", "item_id"), "op4-items").where(F.size("t") > 0)
    own = F.least(F.size("t"), F.lit(window))
    sizes = sorted(r[0] for r in items.select(own).distinct().collect()) or [window]  # at most ``window`` numbers
    # placeholders alone say nothing
    counted = items.select("item", F.posexplode(F.arrays_zip(_words(kinds_of(F.col("t")), own).alias("plain"), _words(folded_of(F.col("t")), own).alias("folded"))).alias("place", "words")).select("item", "place", "words.*")
    both_forms = [windows(items.where(own == n), "item", form(F.col("t")), n).withColumn("folded", F.lit(f)) for n in sizes for f, form in ((False, kinds_of), (True, folded_of))]
    held = reduce(DataFrame.unionByName, both_forms).join(counted.withColumnRenamed("folded", "folded_words"), ["item", "place"])
    held = held.where(F.when(F.col("folded"), F.col("folded_words") > 0).otherwise(F.col("plain") > 0))
    # a folded window that equals the plain one is the plain one
    held = stored(held.groupBy("item", "place", "window").agg(F.min("folded").alias("item_folded")), "op4-windows")
    span = 2 * F.greatest(F.lit(window), F.ceil(F.size("t") / 2).cast("int"))
    facts = items.select("item", "item_id", own.alias("n"), span.alias("span")).join(
        counted.groupBy("item").agg(F.count_if(F.col("plain") > 0).alias("item_windows"), F.count_if(F.col("folded") > 0).alias("all_windows")), "item")
    bench = held.select("window", "item", "item_folded", (F.col("place") + 1).alias("item_place"))
    if bench.count() <= BROADCAST_ROWS:
        bench = F.broadcast(bench)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")

    def of(t: Column) -> Column:
        """(place, whether it is folded, window) of a text, for all sizes."""
        def both(s: Column) -> Column:
            plain = (F.transform(hashes(s["k"], n), lambda h, i: F.struct((i + 1).cast("int").alias("place"), F.lit(False).alias("doc_folded"), h.alias("window"))) for n in sizes)
            folded = (F.transform(folded_places(s["k"], n), lambda i: F.struct(i.alias("place"), F.lit(True).alias("doc_folded"), F.xxhash64(F.lit(n), F.slice(s["f"], i, n)).alias("window"))) for n in sizes)
            return F.flatten(F.array(*plain, *folded))

        return _with(F.struct(kinds_of(t).alias("k"), folded_of(t).alias("f")), both)

    hits = rows.select("doc_id", "text_key", F.inline(_with(template(F.col("text")), of))).join(bench, "window")
    plain = ~F.col("doc_folded") & ~F.col("item_folded")
    hits = hits.groupBy("doc_id", "text_key", "item", "place", "item_place").agg(F.max(plain).alias("plain"))
    hits = stored(hits.withColumn("shift", F.col("place") - F.col("item_place")), "op4-hits")
    pair = ["doc_id", "text_key", "item"]

    # one shift: the alignment with most windows
    lines = hits.where("plain").groupBy(*pair, "shift").agg(F.count_distinct("item_place").alias("n_windows"))
    best = lines.groupBy(*pair).agg(F.max_by(F.struct("shift", "n_windows"), F.struct("n_windows", -F.col("shift"))).alias("b")).select(*pair, "b.*")
    best = best.join(facts.select("item", "item_windows"), "item").where(F.col("n_windows") >= share * F.col("item_windows"))

    # shifts in a band, as words that come in or fall out move what follows: of each window of the item the place on the shift with most windows
    weight = F.count("*").over(Window.partitionBy(*pair, "shift"))
    floor = lambda x: F.floor(x / F.col("span"))
    bands = F.array(*(F.struct(F.lit(i).alias("way"), b.cast("long").alias("band")) for i, b in enumerate((F.col("shift"), floor(F.col("shift")), floor(F.col("shift") + F.col("span") / 2)))))
    spread = hits.withColumn("weight", weight).join(facts, "item").withColumn("b", F.explode(bands)).select("*", "b.*")
    picks = spread.groupBy(*pair, "way", "band", "item_place").agg(F.max_by("place", F.struct("weight", -F.col("shift"))).alias("place"))
    wide = picks.groupBy(*pair, "way", "band").agg(F.count("*").alias("n_windows"), F.collect_list(F.struct("item_place", "place")).alias("picks"))
    wide = wide.join(facts.select("item", "n", "all_windows"), "item").where(F.col("n_windows") >= share * F.col("all_windows"))
    found = best.select(*pair, "n_windows", "item_windows", "shift", F.lit(None).cast("array<struct<item_place:int,place:int>>").alias("picks"), F.lit(None).cast("int").alias("n")).unionByName(
        wide.select(*pair, "n_windows", F.col("all_windows").alias("item_windows"), F.lit(None).cast("int").alias("shift"), "picks", "n"))
    found = stored(found, "op4-found")

    # slots: a value of the item meets one value of the document, along the one shift or inside the windows of a band
    wanted = found.select(F.col("doc_id").alias("d"), F.col("text_key").alias("dk")).distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= WANTED_ROWS else wanted
    same_doc = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("dk"))
    near = stored(tokens_of(rows.join(wanted, same_doc, "left_semi").dropDuplicates(["doc_id", "text_key"]), "doc_id", "text_key"), "op4-near")
    near = near.select(F.col("doc_id").alias("d"), F.col("text_key").alias("dk"), F.col("t").alias("dt"))
    both = found.join(near, same_doc).join(items.select("item", "item_id", F.col("t").alias("it")), "item")
    low = F.greatest(F.col("shift"), F.lit(0))
    along = F.filter(_met(F.slice("it", F.greatest(-F.col("shift"), F.lit(0)) + 1, F.size("it")), F.slice("dt", low + 1, F.size("it"))), lambda x: x["same"])
    inside = F.flatten(F.transform("picks", lambda p: _met(F.slice("it", p["item_place"], F.col("n")), F.slice("dt", p["place"], F.col("n")))))
    met = F.when(F.col("picks").isNull(), along).otherwise(inside)
    slots = F.array_distinct(F.transform(F.filter(met, lambda x: x["k"].startswith("#")), lambda x: F.struct(x["k"].alias("k"), x["a"].alias("a"), x["b"].alias("b"))))
    checked = both.select("doc_id", "item_id", "n_windows", "item_windows", F.col("picks").isNull().alias("one"), slots.alias("slots")).where(_slots_agree(F.col("slots")))
    # what one shift shows is told by its figures
    row = F.struct("n_windows", "item_windows", F.size("slots").alias("n_slots"))
    return checked.groupBy("doc_id", "item_id").agg(F.max_by(row, F.struct("one", "n_windows", F.size("slots"))).alias("r")).select("doc_id", "item_id", "r.*")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), table("benchmark")(spark, sf_dir))


def _sql_tokens(name: str, key: str) -> str:
    units = ", ".join(f"'{u}'" for u in UNITS)
    return f"""
{name}_raw AS (SELECT DISTINCT {key}, regexp_extract_all(text, '[\\p{{L}}\\p{{M}}]+|[0-9]+(?:[.,][0-9]+)*|[.!?\\n]') AS r FROM {'benchmark' if key == 'item_id' else 'documents'}),
{name}_tok AS (SELECT {key}, unnest(r) AS t, unnest(range(1, len(r) + 1)) AS i, unnest(list_concat([NULL], r[:len(r) - 1])) AS b FROM {name}_raw WHERE len(r) > 0),
{name}_kind AS (
  SELECT {key}, i, lower(t) AS v, CASE WHEN t[1] BETWEEN '0' AND '9' THEN '#n'
    WHEN b[1] BETWEEN '0' AND '9' AND lower(t) IN ({units}) THEN '#u'
    WHEN lower(t) <> t AND NOT (b IS NULL OR b IN ('.', '!', '?', chr(10))) THEN '#p' ELSE lower(t) END AS k
  FROM {name}_tok WHERE t NOT IN ('.', '!', '?', chr(10))),
{name}_t AS (SELECT {key}, list(v ORDER BY i) AS v, list(k ORDER BY i) AS k FROM {name}_kind GROUP BY {key})"""


SQL = f"""
WITH {_sql_tokens('d', 'doc_id')},
{_sql_tokens('b', 'item_id')},
b_n AS (SELECT item_id, v, k, least(len(k), {WINDOW}) AS n FROM b_t),
b_w0 AS (SELECT item_id, n, k, unnest(range(1, len(k) - n + 2)) AS p FROM b_n),
b_w AS (SELECT item_id, p, n, k[p:p + n - 1] AS w FROM b_w0 WHERE len(list_filter(k[p:p + n - 1], lambda x: NOT starts_with(x, '#'))) > 0),
sizes AS (SELECT DISTINCT n FROM b_w),
d_w0 AS (SELECT doc_id, k, n, unnest(range(1, len(k) - n + 2)) AS p FROM d_t, sizes WHERE len(k) >= n),
d_w AS (SELECT doc_id, p, k[p:p + n - 1] AS w FROM d_w0),
lines AS (
  SELECT doc_id, item_id, d_w.p - b_w.p AS shift, count(DISTINCT b_w.p) AS n_windows FROM d_w JOIN b_w ON d_w.w = b_w.w GROUP BY ALL),
best AS (
  SELECT * FROM lines JOIN (SELECT item_id, count(*) AS item_windows FROM b_w GROUP BY item_id) USING (item_id)
  QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_windows DESC, shift) = 1),
met AS (
  SELECT x.doc_id, x.item_id, n_windows, item_windows, d_t.k AS dk, d_t.v AS dv, b_t.k AS bk, b_t.v AS bv, shift,
    list_filter(range(1, len(b_t.k) + 1), lambda i: i + shift >= 1 AND i + shift <= len(d_t.k) AND b_t.k[i] = d_t.k[i + shift] AND starts_with(b_t.k[i], '#')) AS places
  FROM best x JOIN d_t USING (doc_id) JOIN b_t USING (item_id) WHERE n_windows >= {SHARE} * item_windows),
slots AS (
  SELECT doc_id, item_id, n_windows, item_windows,
    list_distinct(list_transform(places, lambda i: {{'k': bk[i], 'a': bv[i], 'b': dv[i + shift]}})) AS s FROM met)
SELECT doc_id, item_id, n_windows, item_windows, len(s)::INTEGER AS n_slots
FROM slots WHERE len(s) = len(list_distinct(list_transform(s, lambda x: {{'k': x.k, 'a': x.a}})))
  AND len(list_filter(s, lambda x: x.k = '#p')) = len(list_distinct(list_transform(list_filter(s, lambda x: x.k = '#p'), lambda x: x.b)))
"""
