"""Exact Jaccard self-join of word-shingle sets by universe partition.

Sets are put into size bands. Each band has a scheme: a hash deals the universe of
shingles into segments, and two sets that differ in at most H shingles agree on all but
H of them at most. A set walks the segments of its scheme in one fixed order and indexes

* an exact segment by the hash of its shingles (worth one unit), and
* a reserve segment by that hash and those of its one-deletion neighbours (worth two units
  from two shingles on, as a match then fails only if the segment differs twice),

until it holds H + 1 units. Of two linked sets the one that stops first has more units than
the pair has differences, so both hold a common signature. ``plan_schemes`` sets the numbers
of exact and reserve segments by a cost that it takes from the sizes of all documents.

Units count shingles that are not hot only: shingles of popular lines and passages are found
in the pass that sizes the documents, and segments of nothing else are passed over. A set
that runs out of segments indexes the first shingles of its own, hot ones last, as many as a
linked set cannot all miss.

Candidates of a signature are never paired with each other outright. Each set is first
compared with the pivot it meets most often; signatures whose members that brings together are
done. Members of the others meet in tasks, a bounded block at a time, where their parity
sketches and sizes bound how far they are apart: each set names its nearest one of
another component, these are compared, and only pairs that are still apart and that no bound
rules out follow. Every link between different sets is decided on the shingles' words themselves. Words are hashed
by XXH3-128, whose halves give two independent 64-bit hashes of each shingle. Sets are equal when
their sizes and the sums of both kinds of hashes are, 128 bits in all; one of the sums is a set's name, and names are
counted, so that sets told apart by the other never share one (a second seed replaces the first if they do).

Defined cases: a null or blank text has no shingles and no links; fewer words than the
shingle length make one shingle; rows with a null id are returned with a null component and
link nothing; rows with an equal id count as one document having the links of each, and give a row each;
equal texts are linked; ties take the smaller name; a long text gives all its shingles; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, documents, small_slices

U = np.uint64
BAND_RATIO = 1.6
HOT_SHARE = 1e-3  # of all documents: shingles in more are hot; there are 1 / HOT_SHARE times the mean set size at most
CHUNK = 1 << 20  # shingles that are counted at once
GROUP = 1 << 20  # bytes of texts that are hashed at once
LONG = 50_000  # members up to which a signature is told by them
BLOCK = 2048  # members of a signature that are held at once
BROADCAST_ROWS = 200_000  # of four numbers; beyond it the join shuffles
BESIDE = 256  # sets that are compared with one in a task
BITS = 1024  # of the parity sketch that bounds a symmetric difference from below


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


GAP = re.compile(rb"[\x20\x09-\x0D]")
PLACES = [U(xxhash.xxh64_intdigest(bytes([j])) | 1) for j in range(64)]


def word_hashes(raw: bytes) -> np.ndarray:
    """Two independent 64-bit hashes of each word, the halves of XXH3-128; a long text is read in parts."""
    at, parts = 0, []
    while at < len(raw):
        gap = GAP.search(raw, at + GROUP) if len(raw) - at > GROUP else None
        stop = gap.start() if gap else len(raw)
        parts.append(b"".join(map(xxhash.xxh3_128_digest, raw[at:stop].split())))
        at = stop
    return np.frombuffer(b"".join(parts), U).reshape(-1, 2)


def hashed_texts(texts: list[str | None]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first text, word hashes of each text) of some texts in a row, GROUP bytes or one text."""
    held, first, size = [], 0, 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass").lower()
        if held and size + len(raw) > GROUP:
            yield first, held
            held, first, size = [], i, 0
        held.append(word_hashes(raw))
        size += len(raw)
    if held:
        yield first, held


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles."""
    if not len(words):
        return np.empty(0, U)
    span = min(k, len(words))
    h = np.full(len(words) - span + 1, span, U)
    for j in range(span):  # a sum of random words times odd numbers, one for each place
        h += words[j : j + len(h)] * PLACES[j]
    h = np.sort(mix(h))
    return h[np.r_[True, h[1:] != h[:-1]]]


def shingle_set(words: list[bytes], k: int) -> set[tuple]:
    n = min(k, len(words))
    return set(zip(*(words[j : len(words) - n + 1 + j] for j in range(n)), strict=True)) if n else set()


def sketches(sets: list[np.ndarray]) -> list[bytes]:
    """Parity of the shingles in each of BITS cells: sets differ in as many shingles, at least, as bits."""
    cells = (mix(np.concatenate(sets) ^ U(0x2545F4914F6CDD1D)) % U(BITS)).astype(np.int64)
    cells += np.repeat(np.arange(len(sets)) * BITS, [len(h) for h in sets])
    bits = np.packbits((np.bincount(cells, minlength=len(sets) * BITS) & 1).astype(np.uint8).reshape(len(sets), BITS), axis=1)
    return [row.tobytes() for row in bits]


class Scheme(NamedTuple):
    low: int  # sizes from low to below high
    high: int
    exact: int
    reserve: int


def most_apart(x: int, y: int, t: int) -> int:
    """Largest symmetric difference of linked sets of these sizes; t: threshold in percent."""
    return x + y - 2 * math.ceil(t * (x + y) / (100 + t))


def most_apart_of(x: int, low: int, high: int, t: int) -> int:
    """Largest symmetric difference of a set of x and a linked set of low to high shingles.

    Not always that of the largest one: 15 and 13 may differ in 2, 15 and 12 in 3.
    """
    y = np.arange(max(low, -(-x * t // 100)), min(high, x * 100 // t) + 1)
    return int((x + y - 2 * -(-t * (x + y) // (100 + t))).max())


def bands(largest: int, t: int) -> list[tuple[int, int]]:
    low, out = max(1, t // (100 - t)), []  # smaller sets link with equal ones only
    while low <= largest:
        high = max(low + 1, int(low * BAND_RATIO), (low * 100 + t - 1) // t)
        out.append((low, high))
        low = high
    return out


def plan_schemes(sizes: list[tuple[int, int, float]], largest: int, t: int) -> list[Scheme]:
    """Segments of each band: the cheapest of some allocations.

    sizes: (low end of a band, documents in it, their mean size). The cost of an allocation
    counts the signatures of documents of the mean size and of both ends: one a unit from
    exact segments, half of one plus the neighbours a unit from reserve segments, every
    shingle with the chance of running out, and a charge for segments with few shingles,
    which many documents may share.
    """
    mean = {low: m for low, _, m in sizes}
    out = []
    for low, high in bands(largest, t):
        top = high - 1
        wanted = most_apart(top, top * 100 // t, t) + 1
        best = None
        for share in (1.0, 1.08, 1.16, 1.24, 1.32, 1.5, 2.0):
            exact = max(4, math.ceil(share * (wanted)))
            for reserve in sorted({1, 2, 4, exact // 16 + 1, exact // 8 + 1}):
                cost = sum(_cost(x, exact, reserve, most_apart(x, x * 100 // t, t)) for x in (low, int(mean.get(low, top)), top))
                if best is None or cost < best[0]:
                    best = (cost, exact, reserve)
        out.append(Scheme(low, high, best[1], best[2]))
    return out


def _cost(x: int, exact: int, reserve: int, apart: int) -> float:
    need, per = apart + 1, x / (exact + reserve)
    empty = math.exp(-per)
    got = exact * (1 - empty)
    wide = math.sqrt(exact * empty * max(1e-9, 1 - (1 + per) * empty)) + 0.5
    late = 2 * reserve * (1 - empty * (1 + per))
    used = min(max(0.0, need + wide - got), late)
    over = 1 / (1 + math.exp(min(50.0, 1.7 * (got + late - need) / wide)))
    return need + used * (1 + per) / 2 + over * x + need * empty


def signatures(sets: list[np.ndarray], cold: list[np.ndarray], schemes: list[Scheme], t: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(set, signature) of sets in their schemes and in those below. cold: which shingles are not hot."""
    size = np.array([len(h) for h in sets], np.int64)
    for at, s in enumerate(schemes):
        own = (s.low <= size) & (size < s.high)
        high = schemes[at + 1].high if at + 1 < len(schemes) else s.high
        above = (s.high <= size) & (size < high) & (-(-size * t // 100) < s.high)
        which = np.flatnonzero(own | above)
        if not len(which):
            continue
        n = size[which]
        ends = {x: (s.low, x * 100 // t if x < s.high else s.high - 1) for x in set(n.tolist())}
        far = {x: most_apart_of(x, *e, t) for x, e in ends.items()}
        apart = np.array([far[x] for x in n.tolist()], np.int64)
        doc = np.repeat(np.arange(len(which)), n)
        is_cold = np.concatenate([cold[i] for i in which])
        place = mix(np.concatenate([sets[i] for i in which]) ^ U(0x51ED270B * (at + 1)))
        m = s.exact + s.reserve
        seg = ((place >> U(32)) * U(m) >> U(32)).astype(np.int64)
        order = np.argsort(doc * m + seg, kind="stable")
        token, key = mix(place[order] + U(at)), (doc * m + seg)[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        held, of, count = key[first] % m, key[first] // m, np.diff(np.r_[first, len(key)])
        telling = np.add.reduceat(is_cold[order].astype(np.int64), first)
        whole, salt = np.add.reduceat(token, first), mix((held + (at << 40)).astype(U))
        units = np.minimum(telling, np.where(held < s.exact, 1, 2))
        before = np.cumsum(units) - units
        before -= before[np.searchsorted(of, of)]  # units of the segments before in this set's walk
        on = before <= apart[of]
        use = on & (telling > 0)
        yield which[of[use]], mix(whole[use] + salt[use])
        near = np.repeat(on & (held >= s.exact) & (count > 1), count)  # the neighbour of one shingle is empty
        if near.any():
            run = np.repeat(np.arange(len(held)), count)[near]
            yield which[of[run]], mix(whole[run] - token[near] + salt[run])
        out = np.bincount(of, units, len(which)) <= apart  # ran out of segments
        if out.any():
            pick = np.flatnonzero(out[doc])
            rank = pick[np.lexsort((place[pick], ~is_cold[pick], doc[pick]))]
            inside = np.arange(len(rank)) - np.searchsorted(doc[rank], doc[rank])
            rank = rank[inside <= (n + (-n * t // 100))[doc[rank]]]
            yield which[doc[rank]], mix(place[rank] + U((at + 1) << 48))


NODE = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("fa", pa.int64()), ("fb", pa.int64()), ("sketch", pa.binary())])
NODES = "doc_id long, row long, n long, fa long, fb long, sketch binary"
SIG = pa.schema([("sig", pa.int64()), ("s", pa.int64())])


def names(sets: list[np.ndarray], seed: int) -> np.ndarray:
    """A 64-bit sum of the mixed shingles of each set; 0 of an empty one."""
    sums = np.r_[U(0), np.cumsum(mix(np.concatenate(sets) ^ mix(np.array([seed], U))))]
    ends = np.cumsum([0, *(len(h) for h in sets)])
    return (sums[ends[1:]] - sums[ends[:-1]]).view(np.int64)


def grouped_sets(batch: pa.RecordBatch, k: int, halves: int = 1) -> Iterator[tuple[pa.RecordBatch, list[list[np.ndarray]]]]:
    """Some rows at a time with their shingle sets, from the first half of the words' hashes, or from each of two."""
    for first, words in hashed_texts(batch.column("text").to_pylist()):
        yield batch.slice(first, len(words)), [[shingle_hashes(w[:, i], k) for w in words] for i in range(halves)]


def _nodes(k: int, seed: int):
    """A row for each document; rows with n = -1 hold a shingle (fa) that is hot in a chunk, and its count (fb)."""

    def hot(chunk: list[np.ndarray]) -> pa.RecordBatch:
        value, count = np.unique(np.concatenate(chunk), return_counts=True)
        many = count >= max(3, HOT_SHARE * len(chunk) / 2)
        n = int(many.sum())
        columns = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(np.full(n, -1)), pa.array(value[many].view(np.int64)), pa.array(count[many].astype(np.int64)), pa.nulls(n, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, schema=NODE)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, chunk, held = set(), [], 0
        for batch in small_slices(batches):
            for rows, (sets, others) in grouped_sets(batch, k, 2):
                one, two = names(sets, seed), names(others, seed)
                for h, name in zip(sets, one.tolist(), strict=True):
                    if len(h) and name not in seen:  # equal sets count once
                        seen.add(name)
                        chunk.append(h)
                        held += len(h)
                sizes = pa.array([len(h) for h in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("row"), sizes, pa.array(one), pa.array(two), pa.array(sketches(sets), pa.binary())], schema=NODE)
            if held > CHUNK:
                yield hot(chunk)
                chunk, held = [], 0
        if chunk:
            yield hot(chunk)

    return run


def _signatures(k: int, t: int, schemes: list[Scheme], hot, seed: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, known = set(), hot.value
        for batch in small_slices(batches):
            for rows, (sets,) in grouped_sets(batch, k):
                new = []  # equal sets have the same signatures
                for doc, h, name in zip(rows.column("doc_id").to_pylist(), sets, names(sets, seed).tolist(), strict=True):
                    if doc is not None and len(h) and name not in seen:
                        seen.add(name)
                        new.append((h, name))
                if not new:
                    continue
                sets, name = [x[0] for x in new], np.array([x[1] for x in new], np.int64)
                flat = np.concatenate(sets)
                cold = known[np.minimum(np.searchsorted(known, flat), len(known) - 1)] != flat if len(known) else np.ones(len(flat), bool)
                found = list(signatures(sets, np.split(cold, np.cumsum([len(h) for h in sets])[:-1]), schemes, t))
                if found:
                    which, sig = (np.concatenate(x) for x in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(name[which])], schema=SIG)

    return run


BUCKET = pa.schema([("bucket", pa.int64()), ("pivot", pa.int64()), ("s", pa.int64())])


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by signature and name, those of signatures with two sets or more, once each, with the least name.

    A signature is told by its members, so that those with the same members become one bucket; one with
    more than LONG by itself. Members of two signatures that are told alike by chance only meet besides.
    """
    long: tuple | None = None  # the signature that is being passed on: itself, its least name
    sig, name = np.empty(0, np.int64), np.empty(0, np.int64)

    def passed(name: np.ndarray) -> pa.RecordBatch:
        both = [np.full(len(name), x, np.int64) for x in (mix(np.array([long[0]]).view(U)).view(np.int64)[0], long[1])]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (*both, name)], schema=BUCKET)

    def told(sig: np.ndarray, name: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        count = np.diff(np.r_[first, len(sig)])
        bucket = np.add.reduceat(mix(name.view(U)), first).view(np.int64)
        keep = np.repeat(count > 1, count)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(x, count)[keep]) for x in (bucket, name[first])] + [pa.array(name[keep])], schema=BUCKET)

    for batch in batches:
        sig, name = np.r_[sig, batch.column("sig").to_numpy()], np.r_[name, batch.column("s").to_numpy()]
        fresh = np.r_[True, (sig[1:] != sig[:-1]) | (name[1:] != name[:-1])][: len(sig)]
        sig, name = sig[fresh], name[fresh]
        if long and len(sig):
            own = int(np.searchsorted(sig != long[0], True))
            if own:
                yield passed(name[:own])
                sig, name = sig[own:], name[own:]
        if not len(sig):
            continue
        long = None if sig[0] != (long or [None])[0] else long
        last = int(np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])[-1])
        if last:
            yield told(sig[:last], name[:last])
        sig, name = sig[last:], name[last:]
        if len(sig) > LONG:
            long = (sig[0], name[0])
            yield passed(name)
            sig, name = sig[:0], name[:0]
    if len(sig):
        yield told(sig, name)


LINK = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_())])


def _compare(k: int, t: int):
    """Of rows sorted by b and part, the set that b names first: whether each other one is linked with it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, beside = None, set()
        for batch in small_slices(batches, 128):
            rows = []
            for b, part, s, text in zip(*(batch.column(c).to_pylist() for c in ("b", "part", "s", "text")), strict=True):
                own = shingle_set(words_of(text), k)
                if (b, part) != at:
                    at, beside = (b, part), own
                    continue
                both = len(own & beside)
                rows.append((s, b, 100 * both >= t * (len(own) + len(beside) - both)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), LINK, strict=True)], schema=LINK)

    return run


def beside(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """Columns of a table by name ``s``, dealt to the name that pairs repeat (b), which comes first, in parts of bounded size."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wide = pairs.groupBy("b").agg(F.count("*").alias("c"))
    dealt = pairs.join(wide, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.ceil(F.col("c") / BESIDE)).cast("int").alias("part"))
    rows = dealt.select("b", "part", F.col("a").alias("s"), F.lit(1).alias("turn")).unionByName(dealt.select("b", "part").distinct().select("b", "part", F.col("b").alias("s"), F.lit(0).alias("turn")))
    rows = F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
    rows = rows.join(table.select("s", *columns), "s").repartition(parts, "b", "part").sortWithinPartitions("b", "part", "turn")
    return rows.select("b", "part", "s", *columns)


def compare(pairs: DataFrame, texts: DataFrame, k: int, t: int) -> DataFrame:
    """``a, b, linked`` of pairs of names."""
    return beside(pairs, texts, "text").mapInArrow(_compare(k, t), "a long, b long, linked boolean")


def _possible(t: int):
    """Of rows sorted by b and part, the pairs with the set that b names that size and sketch allow to be linked."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, size = None, 0, 0
        for batch in batches:
            rows = []
            for b, part, s, n, sketch in zip(*(batch.column(c).to_pylist() for c in ("b", "part", "s", "n", "sketch")), strict=True):
                bits = int.from_bytes(sketch)
                if (b, part) != at:
                    at, own, size = (b, part), bits, n
                elif max((bits ^ own).bit_count(), abs(n - size)) <= (both := n + size) - 2 * -(-t * both // (100 + t)):
                    rows.append((s, b))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)], names=["a", "b"])

    return run


def possible(pairs: DataFrame, facts: DataFrame, t: int) -> DataFrame:
    """The pairs ``a, b`` whose sizes and sketches do not rule a link out: the texts of the others need not travel."""
    return beside(pairs, facts, "n", "sketch").mapInArrow(_possible(t), "a long, b long")


def bits_apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of each pair of sketches."""
    return np.bitwise_count(x[:, None, :] ^ y[None, :, :]).sum(2, dtype=np.int32)


def _near(t: int, nearest: bool):
    """Pairs of a block's members that lie in different components and that size and sketch allow to be linked.

    Rows are sorted by bucket and block; ``left`` rows meet each other and the rest of their block.
    nearest: of each left member only the pair with the fewest differing bits.
    """

    def pairs(rows: tuple[np.ndarray, ...]) -> list[np.ndarray]:
        name, part, n, left, raw = rows
        bits = np.frombuffer(b"".join(raw), np.uint64).reshape(len(raw), -1)
        lefts, out = np.flatnonzero(left), []
        for at in range(0, len(lefts), 256):
            own = lefts[at : at + 256]
            far = bits_apart(bits[own], bits)
            both = n[own][:, None] + n[None, :]
            room = both - 2 * -(-t * both // (100 + t))
            ok = (far <= room) & (np.abs(n[own][:, None] - n[None, :]) <= room) & (part[own][:, None] != part[None, :]) & (~left[None, :] | (name[own][:, None] < name[None, :]) | nearest)
            if nearest:
                best = np.where(ok, far, 1 << 30).argmin(1)
                keep = ok[np.arange(len(own)), best]
                out.append(np.column_stack([name[own[keep]], name[best[keep]]]))
            else:
                i, j = np.nonzero(ok)
                out.append(np.column_stack([name[own[i]], name[j]]))
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settle() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            key = [rows[c].to_numpy() for c in ("bucket", "x", "y")]
            cols = [rows[c].to_numpy() for c in ("s", "part", "n")]
            left, raw = rows["left"].to_numpy(), np.array(rows["sketch"].to_pylist(), object)
            new = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in key], 0)])
            found = [p for a, z in zip(new, [*new[1:], len(left)], strict=True) for p in pairs((*(c[a:z] for c in cols), left[a:z], raw[a:z]))]
            if found and len(both := np.unique(np.sort(np.concatenate(found), 1), axis=0)):
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        for batch in batches:
            # whole blocks are settled: rows up to the last change of key
            if not batch.num_rows:
                continue
            key = [batch.column(c).to_numpy() for c in ("bucket", "x", "y")]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], 0)) + 1
            if held and any(held[-1].column(c)[-1].as_py() != k[0] for c, k in zip(("bucket", "x", "y"), key, strict=True)):
                yield from settle()
                held = []
            if len(change):
                held.append(batch.slice(0, change[-1]))
                yield from settle()
                held = []
                batch = batch.slice(change[-1])
            held.append(batch)
        if held:
            yield from settle()

    return run


def near_pairs(open_: DataFrame, facts: DataFrame, t: int, nearest: bool) -> DataFrame:
    """Distinct candidate pairs ``a < b`` of members of open buckets. open_: ``bucket, s, part``; facts: ``s, n, sketch``.

    Of each bucket the members outside its largest component (left) meet all members, in blocks. Members are dealt as
    numbers in one pass; their sketches travel only to the blocks.
    """
    parts = int(open_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = open_.groupBy("bucket", "part").agg(F.count("*").alias("c"))
    most = sizes.groupBy("bucket").agg(F.max_by("part", F.struct("c", "part")).alias("main"), F.sum("c").alias("all"), (F.sum("c") - F.max("c")).alias("few"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    place = lambda c: F.pmod(F.xxhash64("s", F.lit(7)), F.greatest(blocks(c), F.lit(1))).cast("int")
    rows = open_.join(most, "bucket").select("bucket", "s", "part", (F.col("part") != F.col("main")).alias("out"), "few", "all", place("few").alias("x0"), place("all").alias("y0"))
    # block x of the left members meets block y of all members
    own = F.when(F.col("out"), F.transform(F.sequence(F.lit(0), blocks("all") - 1), lambda y: F.struct(F.col("x0").alias("x"), y.alias("y"), F.lit(True).alias("left")))).otherwise(F.array())
    met = F.transform(F.sequence(F.lit(0), F.greatest(blocks("few"), F.lit(1)) - 1), lambda x: F.struct(x.alias("x"), F.col("y0").alias("y"), F.lit(False).alias("left")))
    met = F.filter(met, lambda m: ~F.col("out") | (m["x"] != F.col("x0")))
    dealt = rows.select("bucket", "s", "part", F.inline(F.concat(own, met)))
    blocked = dealt.join(facts.select("s", "n", "sketch"), "s").repartition(parts, "bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "s")
    return blocked.select("bucket", "x", "y", "s", "part", "n", "left", "sketch").mapInArrow(_near(t, nearest), "a long, b long").distinct()


def named_sets(docs: DataFrame, k: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Nodes, shingles that are hot in a chunk, classes of equal sets, and the seed of their names."""
    seed = 0
    while True:
        both = scratch.put("nodes", docs.mapInArrow(_nodes(k, seed), NODES))
        nodes = both.where("n >= 0")
        known = nodes.where("doc_id is not null and n > 0")
        classes = scratch.put("classes", known.groupBy("fa", "n", "fb").agg(F.min(F.struct("doc_id", "row")).alias("r"), F.min("sketch").alias("sketch"), F.count("*").alias("held")).select(F.col("fa").alias("s"), "n", "fb", F.col("r.doc_id").alias("rep"), F.col("r.row").alias("row"), "sketch", "held"))
        if classes.groupBy("s").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
            return nodes, both.where("n < 0"), classes, seed
        scratch.drop("nodes", "classes")
        seed += 1


def similarity_components(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, class_id, component_id``.

    class_id is the smallest id with an equal shingle set; component_id the smallest id that
    links reach. threshold: percent of the union that the intersection must reach.
    """
    spark, t = docs.sparkSession, threshold
    scratch = Scratch(spark, "op1")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    nodes, hot_rows, classes, seed = named_sets(docs, k, scratch)

    largest = classes.agg(F.max("n")).first()[0] or 0
    lows = [low for low, _ in bands(largest, t)]
    sized: list = []
    if lows:
        band = F.element_at(F.filter(F.array(*map(F.lit, lows)), lambda low: low <= F.col("n")), -1)
        sized = [(r["band"], r["c"], r["mean"]) for r in classes.where(F.col("n") >= lows[0]).groupBy(band.alias("band")).agg(F.count("*").alias("c"), F.avg("n").alias("mean")).collect()]
    schemes = plan_schemes(sized, largest, t)
    least = max(20, HOT_SHARE * classes.count())
    hot = hot_rows.groupBy("fa").agg(F.sum("fb").alias("c")).where(F.col("c") >= least).select("fa").collect()
    hot = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in hot], np.int64).view(U)))

    sigs = docs.mapInArrow(_signatures(k, t, schemes, hot, seed), "sig long, s long")
    buckets = scratch.put("buckets", sigs.repartition(parts, "sig").sortWithinPartitions("sig", "s").mapInArrow(_shared, "bucket long, pivot long, s long").groupBy("bucket", "pivot", "s").agg(F.count("*").alias("c")))
    star = buckets.where("pivot <> s").groupBy("pivot", "s").agg(F.sum("c").alias("c"))
    best = scratch.put("best", star.groupBy(F.col("s").alias("a")).agg(F.max_by("pivot", F.struct("c", -F.col("pivot"))).alias("b")))

    wanted = scratch.put("wanted", buckets.select("s").distinct())
    facts = classes.join(wanted, "s", "left_semi")
    keys = facts.select("s", F.col("rep").alias("doc_id"), "row", "held")
    found = (F.broadcast(keys) if wanted.count() <= BROADCAST_ROWS else keys).join(docs, ["doc_id", "row"])
    again = found.where("held > 1").dropDuplicates(["doc_id", "row"])  # a set that one row holds has its text once
    texts = scratch.put("texts", found.where("held = 1").select("s", "text").unionByName(again.select("s", "text")))
    near = scratch.put("possible", possible(best, classes, t))
    links = scratch.put("star-links", compare(near, texts, k, t).where("linked").select("a", "b"))

    def opened(links: DataFrame, name: str) -> DataFrame:
        """Members of buckets that hold several components, with their components."""
        part = components(links, f"op1-{name}").select(F.col("node").alias("s"), F.col("component").alias("part"))
        rows = buckets.select("bucket", "s").join(part, "s", "left").withColumn("part", F.coalesce("part", "s"))
        split = rows.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("bucket")
        return scratch.put(name, rows.join(split, "bucket", "left_semi").select("bucket", "s", "part"))

    first = opened(links, "open")
    nearest = scratch.put("nearest", near_pairs(first, facts, t, True).join(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"))
    more = scratch.put("more-links", compare(nearest, texts, k, t).where("linked").select("a", "b"))
    scratch.drop("open")
    links = links.unionByName(more)
    rest = near_pairs(opened(links, "left"), facts, t, False)
    seen = nearest.unionByName(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    rest = scratch.put("rest", rest.join(seen, ["a", "b"], "left_anti"))
    links = links.unionByName(compare(rest, texts, k, t).where("linked").select("a", "b"))

    # from names to ids: the least id of a set stands for it; an id with several sets joins them
    rep = lambda c: classes.select(F.col("s").alias(c), F.col("rep").alias(f"{c}_rep"))
    between = links.join(rep("a"), "a").join(rep("b"), "b").select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"))
    many = nodes.where("doc_id is not null and n > 0").groupBy("doc_id").agg(F.min("fa").alias("low"), F.max("fa").alias("high")).where("low < high").select("doc_id")
    several = nodes.where("n > 0").join(many, "doc_id").select("doc_id", F.col("fa").alias("s")).distinct().join(classes.select("s", "rep"), "s").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    part = components(between.unionByName(several), "op1-parts")
    of_class = classes.select(F.col("s").alias("fa"), "rep").join(part.withColumnRenamed("node", "rep"), "rep", "left").select("fa", "rep", F.coalesce("component", "rep").alias("component"))
    out = nodes.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("fa")).alias("fa")).join(of_class, "fa", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("class_id"), F.coalesce("component", "doc_id").alias("component_id"))
    out = scratch.put("result", out)
    scratch.drop(*(name for name in list(scratch.paths) if name != "result"))
    return out


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i+4], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, reach) AS (
  SELECT doc_id, doc_id FROM n
  UNION
  SELECT r.doc_id, g.b FROM r JOIN g ON r.reach = g.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id)
LEFT JOIN (SELECT doc_id, min(reach) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""
