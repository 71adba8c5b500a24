"""Removal of repeated byte strings by prefix-free parsing.

A rolling hash of grams of ``GRAM`` bytes sets triggers: each window of ``LENGTH`` bytes belongs to the
trigger with the least hash inside it, so equal windows have triggers at equal places, and no window is without
one. A phrase is the run of windows of one trigger: its left part, the bytes before the trigger, and its right
part, the bytes from the trigger on. Distinct phrases are the dictionary, their places the parse.

1. Parse. Phrases are kept as hashes: of the core, the trigger's gram, and of the hull, all bytes
   that its windows cover. A core that occurs once rules its windows out; a hull that occurs twice
   marks all of them, and stands once for all its places in what follows.
2. Order. Equal windows have one core, so order is needed among the phrases of a core only, and the suffix arrays of the whole
   dictionary and parse are never built: phrases with one core are sorted by their right parts and by their left parts read
   backwards, with the lengths of common prefixes. A window that reaches ``a`` bytes to the
   left of its trigger is told by the class of left parts that agree on ``a`` bytes and the class of right parts that agree on
   ``LENGTH - a``: windows are equal if both classes are. This compares bytes, in numpy, for all phrases of some cores at once.
3. Cores that more than ``MANY`` open phrases share are first cut into strips: windows that reach about equally far to the left.
   A strip has a longer core and a shorter hull, goes through step 1 again, and then to step 2 or into
   narrower strips; strips of one window are settled by step 1. So no task gets an unbounded group.

Step 1 tells hulls apart by XXH3-128 of their bytes, step 2 windows by their bytes; cores with equal hashes only meet for nothing. No step sends a text twice or pairs texts.

Defined cases: a null text is empty; texts shorter than ``LENGTH`` keep all; equal rows are
copies of each other; ids may be null or repeat (rows are told apart by id and text); long texts are parsed in pieces that overlap, so memory does not
grow with them beyond the text itself; periodic texts give one phrase for each byte of a period, not of the text; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, stored

U = np.uint64
LENGTH, GRAM = 200, 48
REACH = LENGTH - GRAM  # bytes that a window has before its trigger, at most
PIECE = 1 << 20  # bytes that are parsed at once
MANY = 4000  # open phrases of one core that a task sorts; more are cut into strips
STRIPS = (51, 17, 6, 2, 1)  # windows of a strip
TOGETHER = 4000  # phrases that are sorted at once


class Hashes:
    """64-bit hashes of any byte ranges of a buffer, from prefix sums."""

    def __init__(self, data: np.ndarray, seed: int):
        step = xxhash.xxh64_intdigest(b"step", seed) | 5
        letters = np.array([xxhash.xxh64_intdigest(bytes([b]), seed) for b in range(256)], U)
        up, self.down = (np.cumprod(np.r_[U(1), np.full(len(data), x, U)]) for x in (step, pow(step, -1, 2**64)))
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(letters[data] * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * self.down[start]
        x = (x ^ (x >> U(31))) * U(0xFF51AFD7ED558CCD)
        return x ^ (x >> U(29)) ^ (end - start).astype(U)


def pieces(texts: list[str | None], limit: int | None = None) -> Iterator[list[tuple[int, int, bytes]]]:
    """(row, place, bytes) of pieces, in groups of about ``limit`` bytes; each window lies in one piece."""
    limit, held, size = limit or PIECE, [], 0
    for row, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        for at in range(0, max(1, len(raw) - LENGTH + 1), limit):
            piece = raw[at : at + limit + LENGTH - 1]
            if held and size + len(piece) > limit:
                yield held
                held, size = [], 0
            held.append((row, at, piece))
            size += len(piece)
    if held:
        yield held


def phrases(data: np.ndarray, ends: np.ndarray, h: Hashes) -> tuple[np.ndarray, ...]:
    """(piece, trigger, first window, last window) of each phrase, as places in the buffer."""
    n, width = len(data), REACH + 1
    if n < LENGTH:
        return (np.empty(0, np.int64),) * 4
    at = np.arange(n - GRAM + 1)
    low = h.of(at, at + GRAM) & ~U((1 << 28) - 1) | at.astype(U)  # a buffer is shorter than 2 ** 28
    span = 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    windows = np.arange(len(low))
    trigger = (low & U((1 << 28) - 1)).astype(np.int64)
    piece = np.searchsorted(ends, windows, side="right") - 1
    fits = windows + LENGTH <= ends[piece + 1]
    new = np.r_[True, (trigger[1:] != trigger[:-1]) | (piece[1:] != piece[:-1]) | (fits[1:] != fits[:-1])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(low)] - 1
    keep = fits[first]
    return piece[first[keep]], trigger[first[keep]], first[keep], last[keep]


def as_batch(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names.split())


PLACE = "doc long, key long, low int, high int"
PHRASE = f"core long, hull long, hull2 long, w int, at int, {PLACE}"


def _phrases(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases with the count w that they stand for; rows without a core (w = 0) are windows known to repeat."""
    for batch in batches:
        doc, key = (batch.column(c).to_numpy() for c in ("doc", "key"))
        for part in pieces(batch.column("text").to_pylist()):
            raw = b"".join(p[2] for p in part)
            data, ends = np.frombuffer(raw, np.uint8), np.cumsum([0, *(len(p[2]) for p in part)])
            one = Hashes(data, 1)
            piece, at, low, high = phrases(data, ends, one)
            if not len(piece):
                continue
            core = one.of(at, at + GRAM)
            digests = b"".join([xxhash.xxh3_128_digest(raw[a:z]) for a, z in zip(low.tolist(), (high + LENGTH).tolist(), strict=True)])
            hull, hull2 = (np.ascontiguousarray(x) for x in np.frombuffer(digests, U).reshape(-1, 2).T)
            row = np.array([p[0] for p in part])[piece]
            shift = np.array([p[1] for p in part])[piece] - ends[piece]
            # equal phrases of one buffer: one stands for all, the windows of all repeat
            order = np.lexsort((np.arange(len(core)), hull2, hull, core))
            same = np.r_[False, (core[order][1:] == core[order][:-1]) & (hull[order][1:] == hull[order][:-1]) & (hull2[order][1:] == hull2[order][:-1])]
            again = np.zeros(len(core), bool)
            again[order[same]] = True
            twice = again.copy()
            twice[order[:-1][same[1:]]] = True
            keep = np.flatnonzero(~again)
            low, high, at = low + shift, high + shift, at + shift
            yield as_batch("core hull hull2 w at doc key low high", *(x[keep].view(np.int64) for x in (core, hull, hull2)), np.where(twice[keep], 2, 1).astype(np.int32), at[keep].astype(np.int32), doc[row][keep], key[row][keep], low[keep].astype(np.int32), high[keep].astype(np.int32))
            back = np.flatnonzero(twice)
            if len(back):
                new = np.flatnonzero(np.r_[True, (np.diff(back) > 1) | (low[back][1:] != high[back][:-1] + 1) | (row[back][1:] != row[back][:-1])])
                end = np.r_[new[1:], len(back)] - 1
                none = np.zeros(len(new), np.int64)
                yield as_batch("core hull hull2 w at doc key low high", none, none, none, none.astype(np.int32), none.astype(np.int32), doc[row[back[new]]], key[row[back[new]]], low[back[new]].astype(np.int32), high[back[end]].astype(np.int32))


OPEN = "core long, doc long, key long, low int, at int, crowded boolean, bytes binary"


def _contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes under the windows of each open phrase of a text."""
    names = [x.split()[0] for x in OPEN.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
    for batch in batches:
        for doc, key, text, edges in zip(*(batch.column(c).to_pylist() for c in ("doc", "key", "text", "edges")), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            rows = [(e["core"], doc, key, e["low"], e["at"], e["crowded"], raw[e["low"] : e["high"] + LENGTH]) for e in edges]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def matrix(strings: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in strings), np.uint8).reshape(len(strings), width)


def ordered(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of the rows of a byte matrix, and the length of each one's prefix that it shares with the one before."""
    order = np.argsort(np.ascontiguousarray(strings).view(f"S{strings.shape[1]}").reshape(-1), kind="stable")
    apart = strings[order][1:] != strings[order][:-1]
    return order, np.r_[-1, np.where(apart.any(1), apart.argmax(1), strings.shape[1])]


def repeated(low: np.ndarray, at: np.ndarray, hulls: list[bytes]) -> np.ndarray:
    """Of phrases (hull bytes from low on, trigger at), whether the window ``a`` bytes left of the trigger occurs again."""
    n, left = len(hulls), at - low
    least = left - (np.array([len(x) for x in hulls]) - LENGTH)  # the last window's a
    right_order, right_lcp = ordered(matrix([x[k : k + LENGTH] for x, k in zip(hulls, left.tolist(), strict=True)], LENGTH))
    left_order, left_lcp = ordered(matrix([x[:k][::-1] for x, k in zip(hulls, left.tolist(), strict=True)], REACH))
    found, of_left, of_right = np.zeros((n, REACH + 1), bool), np.empty(n, np.int64), np.empty(n, np.int64)
    for a in range(REACH + 1):
        rows = np.flatnonzero((least <= a) & (a <= left))
        if len(rows) < 2:
            continue
        of_left[left_order] = np.cumsum(left_lcp < a)
        of_right[right_order] = np.cumsum(right_lcp < LENGTH - a)
        name = of_left[rows] * (n + 1) + of_right[rows]
        order = np.argsort(name, kind="stable")
        same = name[order][1:] == name[order][:-1]
        found[rows[order[1:][same]], a] = found[rows[order[:-1][same]], a] = True
    return found


def _settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows of phrases sorted by core; a core's phrases are looked at together."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        _, doc, key, low, at, hulls = zip(*rows, strict=True)
        low, at = np.array(low, np.int64), np.array(at, np.int64)
        found = repeated(low, at, list(hulls))[:, ::-1]  # from the leftmost window on
        step = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, first = np.nonzero(step == 1)
        last = np.nonzero(step == -1)[1] - 1
        start = at[row] - REACH
        return as_batch("doc key low high", np.array(doc, np.int64)[row], np.array(key, np.int64)[row], (start + first).astype(np.int32), (start + last).astype(np.int32))

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("core", "doc", "key", "low", "at", "bytes")), strict=True):
            if len(held) >= TOGETHER and held[-1][0] != row[0]:
                yield settle(held)
                held = []
            held.append(row)
    if held:
        yield settle(held)


def _strips(width: int):
    """Cut phrases into strips of windows that reach ``width * s`` to ``width * (s + 1) - 1`` bytes to the left."""
    kinds = (*[pa.int64()] * 3, *[pa.int32()] * 2, *[pa.int64()] * 2, *[pa.int32()] * 2, pa.binary())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for core, doc, key, low, at, raw in zip(*(batch.column(c).to_pylist() for c in ("core", "doc", "key", "low", "at", "bytes")), strict=True):
                left, least = at - low, at - low - (len(raw) - LENGTH)
                for s in range(least // width, left // width + 1):
                    inner = raw[left - s * width : left + LENGTH - ((s + 1) * width - 1)]
                    start, stop = left - min(left, (s + 1) * width - 1), left - max(least, s * width)
                    hull = raw[start : stop + LENGTH]
                    one, two = np.frombuffer(xxhash.xxh3_128_digest(hull, seed=stop - start), "<i8").tolist()
                    rows.append((int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(inner, seed=s) ^ (core & (2**64 - 1))))), one, two, 1, at, doc, key, low + start, low + stop, hull))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*"core hull hull2 w at doc key low high bytes".split()])

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        rows = []
        for doc, text, spans in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            kept, at, removed, n = hashlib.sha256(), 0, 0, 0
            end = -1
            for low, high in sorted((s["low"], s["high"] + LENGTH) for s in spans or ()):
                if low > end:
                    kept.update(raw[max(at, 0) : low])
                    n += 1
                    removed += high - low
                    end = high
                elif high > end:
                    removed += high - end
                    end = high
                at = end
            kept.update(raw[at:])
            rows.append((doc, len(raw), removed, n, kept.hexdigest()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (*[pa.int64()] * 4, pa.string()), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def counted(rows: DataFrame, counts: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Join rows with counts of them by keys. Keys that hold over a thousandth of all rows, fewer than a thousand, are broadcast."""
    limit = (counts.agg(F.sum(count)).first()[0] or 0) / 1000
    hot = F.broadcast(counts.where(F.col(count) > limit))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(counts.where(F.col(count) <= limit), keys)
    return rows.join(hot, keys).unionByName(rest)


def known_by_hash(found: DataFrame, scratch: Scratch, name: str, *more: str) -> tuple[DataFrame, DataFrame]:
    """Windows of phrases whose hull occurs twice, and the phrases that stay open, each hull that occurs twice once.

    found: a written table of that name, which is removed; open phrases carry ``n``, how many share their core.
    """
    hull, place = ["core", "hull", "hull2"], ["at", "doc", "key", "low", "high", *more]
    cores = scratch.put(f"{name}-cores", found.where("w > 0").groupBy("core").agg(F.sum("w").alias("cores")).where("cores > 1"))
    shared = scratch.put(f"{name}-shared", counted(found.where("w > 0"), cores, ["core"], "cores").drop("cores"))
    sure = scratch.put(f"{name}-sure", found.where("w = 0").select("doc", "key", "low", "high"))
    scratch.drop(name, f"{name}-cores")
    hulls = scratch.put(f"{name}-hulls", shared.groupBy(*hull).agg(F.sum("w").alias("hulls")))
    phrases_ = scratch.put(f"{name}-phrases", counted(shared, hulls, hull, "hulls"))
    scratch.drop(f"{name}-shared", f"{name}-hulls")
    again = sure.unionByName(phrases_.where("hulls > 1").select("doc", "key", "low", "high"))
    # open phrases compare with all others of their core, settled ones included: their hulls stand for them once
    first = phrases_.where("hulls > 1").groupBy(*hull).agg(F.min(F.struct("doc", "key", "low", "high", "at", *more)).alias("p")).select("core", "p.*")
    edges = phrases_.where("hulls = 1").select("core", *place).withColumn("own", F.lit(True)).unionByName(first.withColumn("own", F.lit(False)))
    loads = edges.groupBy("core").agg(F.count("*").alias("n"), F.max("own").alias("open")).where("open").select("core", "n")
    return again, counted(edges, scratch.put(f"{name}-loads", loads), ["core"], "n")


def repeated_windows(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc, key, low, high``: first and last places of windows that occur elsewhere too. rows: ``doc, key, text``."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = scratch.put("found", rows.select("doc", "key", "text").mapInArrow(_phrases, PHRASE))
    again, edges = known_by_hash(found, scratch, "found")
    grouped = edges.groupBy("doc", "key").agg(F.collect_list(F.struct("core", "low", "high", "at", (F.col("n") > MANY).alias("crowded"))).alias("edges"))
    open_ = scratch.put("contexts", rows.join(grouped, ["doc", "key"]).select("doc", "key", "text", "edges").mapInArrow(_contexts, OPEN))
    settle = lambda few: few.select("core", "doc", "key", "low", "at", "bytes").repartition(parts, "core").sortWithinPartitions("core").mapInArrow(_settle, PLACE)
    spans = [again, settle(open_.where("not crowded"))]
    open_ = open_.where("crowded")
    for width in STRIPS:
        if open_.isEmpty():
            break
        name = f"strips-{width}"
        strips = scratch.put(name, open_.select("core", "doc", "key", "low", "at", "bytes").mapInArrow(_strips(width), f"{PHRASE}, bytes binary"))
        again, edges = known_by_hash(strips, scratch, name, "bytes")
        edges = scratch.put(f"open-{width}", edges)
        spans += [again, settle(edges.where(F.col("n") <= MANY))]
        open_ = edges.where(F.col("n") > MANY)
    return reduce(DataFrame.unionByName, spans)


def cut_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: its bytes, those removed, the removed runs, and the digest of the rest."""
    scratch = Scratch(docs.sparkSession, "op3")
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), "text", F.coalesce(doc_id, F.lit(0)).alias("doc"), F.xxhash64(F.coalesce(doc_id, F.lit(-1)), "text").alias("key"))
    # equal rows share a key; each is a copy of the other, so all their windows are repeated
    twins = rows.groupBy("doc", "key").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("size")).where(f"n > 1 and size >= {LENGTH}")
    both = twins.select("doc", "key", F.lit(0).alias("low"), (F.col("size") - LENGTH).cast("int").alias("high"))
    spans = repeated_windows(rows, scratch).unionByName(both).groupBy("doc", "key").agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    spans = stored(spans, "op3-spans")
    scratch.drop(*list(scratch.paths))
    return rows.join(spans, ["doc", "key"], "left").select("doc_id", "text", "spans").mapInArrow(_cut, RESULT)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(documents(spark, sf_dir))
