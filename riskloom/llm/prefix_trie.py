"""The prefix trie of conversations, by ROLLUP over positional columns of turn ids.

1. Turns get their positions: rows are dealt by ranges of conversation and order, numbered inside each range, and
   ranges that continue a conversation get the count before them. A turn's id is 128 bits of SHA-256 of role and text.
2. Each WIDTH turns are a block: one row with WIDTH columns. A conversation's digest comes from its blocks' digests,
   in groups of FAN, so equal conversations are one row with a count; the SHA-256 of their ids is streamed from
   pieces joined range by range.
3. Blocks are taken in order. ``GROUP BY node, ROLLUP (t1, ..., tw)`` makes all prefixes of a block at once, and
   grouping_id tells their depth; rows that go on get the id of their node, by which the next block is grouped.
   A conversation alone at its node is a chain from there on and is read off without further rounds, so there are as
   many rounds as blocks that different conversations share.
4. Back from the last block to the first, a second ROLLUP over the nodes sums leaves and saved tokens of subtrees;
   the totals of a block's root are added to its node in the block before.

Defined cases: turns come by turn, null first, ties by role, the text's first 64 characters and the text's hash;
null role and text are empty; equal rows are turns of their own; rows without a conversation id are left out; long
texts are hashed whole and long conversations kept whole; an empty table gives an empty result; other columns are
dropped. A conversation id is a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, fresh_path, stored, table

WIDTH, FAN, SPAN = 8, 64, 1024
ROOT = hashlib.sha256(b"").hexdigest()[:32]
NO_IDS = hashlib.sha256(b"").hexdigest()
SHARED = 5  # the longest head that a rebuilt conversation takes


def digest(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 32)


def numbered(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv_id, pos, tid, chars``: the turns of each conversation, numbered from 1."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    tid = digest(F.concat(F.char_length(role).cast("string"), F.lit("|"), role, text))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.substring(text, 1, 64).alias("head"), tid.alias("tid"), F.char_length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("row"))  # the row parts equal rows
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "head", "tid", "row"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "tid", "chars")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for c in batch.column(0).to_pylist():
                n = n + 1 if c == last else 1
                last = c
                places.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64())], ["conv_id", "tid", "chars", "part", "n"])

    held = scratch.put("numbered", dealt.mapInArrow(count, "conv_id long, tid string, chars long, part int, n long"))
    sizes = held.groupBy("conv_id", "part").agg(F.max("n").alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(W.partitionBy("conv_id").orderBy("part")) - F.col("size")).where("before > 0").drop("size")  # a row a range
    return held.join(before, ["conv_id", "part"], "left").select("conv_id", (F.col("n") + F.coalesce("before", F.lit(0))).alias("pos"), "tid", "chars")


def rebuilt(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Conversations that begin with the first h turns of another, h a hash of the id; their own follow after their first h."""
    h = F.crc32(F.col("conv_id").cast("string")) % (SHARED + 1)
    of = convs.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
    heads = turns.where((F.col("pos") <= SHARED) & (F.col("conv_id") % 100 == 0)).select(F.col("conv_id").alias("base"), "pos", "tid", "chars")
    taken = of.join(heads, "base").where("pos <= h").select("conv_id", "pos", "tid", "chars")  # of one base: 199 conversations at most, h turns each
    lengths = heads.groupBy("base").agg(F.max("pos").alias("has"))
    short = of.join(lengths, "base", "left").select("conv_id", (F.least("h", F.coalesce("has", F.lit(0))) - F.col("h")).alias("shift")).where("shift < 0")
    own = turns.where(F.col("pos") > h).join(short, "conv_id", "left")
    return taken.unionByName(own.select("conv_id", (F.col("pos") + F.coalesce("shift", F.lit(0))).alias("pos"), "tid", "chars"))


def blocks(turns: DataFrame, width: int) -> DataFrame:
    """``conv_id, b, t1..tw, fill, chars, dg``: a row each ``width`` turns; a turn column has the id and the code points."""
    place = (F.col("pos") - 1) % width
    ts = [F.max(F.when(place == i, F.struct("tid", "chars"))).alias(f"t{i + 1}") for i in range(width)]
    per = turns.groupBy("conv_id", F.floor((F.col("pos") - 1) / width).alias("b")).agg(*ts, F.count("*").cast("int").alias("fill"), F.sum("chars").alias("chars"))
    return per.withColumn("dg", digest(F.concat_ws(",", *(f"t{i + 1}.tid" for i in range(width)))))


def digests(blk: DataFrame) -> DataFrame:
    """``conv_id, dg``: one digest of each whole conversation, from those of its blocks, FAN at a time."""
    level, top = blk.select("conv_id", "b", "dg"), blk.agg(F.max("b")).first()[0] or 0
    while top:
        inside = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "dg"))), lambda x: x["dg"]), ",")
        level = level.groupBy("conv_id", F.floor(F.col("b") / FAN).alias("up")).agg(digest(inside).alias("dg")).withColumnRenamed("up", "b")
        top //= FAN
    return level.select("conv_id", "dg")


def id_hashes(members: DataFrame, scratch: Scratch) -> DataFrame:
    """``dg, ends``: SHA-256 of the ids of each group, ascending and joined by commas, streamed from pieces in order."""
    dealt = members.repartitionByRange("conv_id").select("conv_id", "dg", F.spark_partition_id().alias("part"))
    dealt = scratch.put("dealt", dealt)
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string"))
    pieces = dealt.groupBy("dg", "part").agg(F.array_join(ids, ",").alias("ids"))  # a piece is of one range
    pieces = pieces.repartition("dg").sortWithinPartitions("dg", "part").select("dg", "ids")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h, names, found = None, None, [], []
        for batch in batches:
            for dg, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if dg != now:
                    if h:
                        names.append(now)
                        found.append(h.hexdigest())
                    now, h = dg, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(piece.encode())
            yield pa.RecordBatch.from_pydict({"dg": names, "ends": found}, schema=pa.schema([("dg", pa.string()), ("ends", pa.string())]))
            names, found = [], []
        if h:
            yield pa.RecordBatch.from_pydict({"dg": [now], "ends": [h.hexdigest()]})

    return pieces.mapInArrow(stream, "dg string, ends string")


def chain_sums(chain: DataFrame) -> DataFrame:
    """Add ``after``: code points of a conversation's later blocks. Sums go by SPAN blocks first, so no task holds a long conversation."""
    keyed = chain.withColumn("span", F.floor(F.col("b") / SPAN))
    spans = keyed.groupBy("rep", "span").agg(F.sum("chars").alias("all"))
    later = spans.select("rep", "span", (F.sum("all").over(W.partitionBy("rep").orderBy(F.desc("span"))) - F.col("all")).alias("beyond"))
    inner = F.sum("chars").over(W.partitionBy("rep", "span").orderBy(F.desc("b"))) - F.col("chars")
    return keyed.withColumn("_in", inner).join(later, ["rep", "span"]).withColumn("after", F.col("_in") + F.col("beyond")).drop("_in", "beyond", "span")


def trie(turns: DataFrame, convs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The nodes of ``turns`` (``conv_id, pos, tid, chars``); ``convs`` names all conversations, those without turns too.

    Per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.
    """
    spark = turns.sparkSession
    scratch = Scratch(spark, "trie")
    ts = [f"t{i + 1}" for i in range(width)]
    whole = scratch.put("whole", blocks(turns, width))
    members = scratch.put("members", convs.join(digests(whole), "conv_id", "left").select("conv_id", F.coalesce("dg", F.lit("")).alias("dg")))
    groups = members.groupBy("dg").agg(F.min("conv_id").alias("rep"), F.count("*").alias("n"))
    length = whole.groupBy(F.col("conv_id").alias("rep")).agg(F.max("b").alias("last"))
    reps = groups.join(id_hashes(members, scratch), "dg").join(length, "rep", "left").select("rep", "n", "ends", F.coalesce("last", F.lit(-1)).alias("last"))
    reps = scratch.put("reps", reps)
    own = scratch.put("blocks", whole.withColumnRenamed("conv_id", "rep").drop("dg").join(reps, "rep"))
    scratch.drop("whole", "members", "dealt")

    path = lambda n: F.slice(F.array("node", *(F.col(f"{t}.tid") for t in ts)), 1, n)
    key = lambda n: F.when(n == 0, F.col("node")).otherwise(digest(F.array_join(path(n + 1), "")))

    # down: nodes of each block, and what goes on below its last column
    levels, chains, b = [], None, 0
    front = reps.where("last < 0").select("rep", *(F.lit(None).cast(own.schema[t].dataType).alias(t) for t in ts), F.lit(0).alias("fill"), "n", "ends", "last").unionByName(own.where("b = 0").select("rep", *ts, "fill", "n", "ends", "last")).withColumn("node", F.lit(ROOT))
    while True:
        rows = scratch.put(f"rows{b}", front.withColumn("reach", F.when(F.col("last") > b, width + 1).otherwise(F.col("fill"))))
        found = spark.sql(f"""SELECT node, {', '.join(ts)}, {width} - bit_count(grouping_id()) AS d, sum(n) AS n_convs, min(rep) AS conv_id, count(*) AS reps,
            max(reach) AS reach, min(struct(reach, ends)) AS first FROM {{rows}} GROUP BY node, ROLLUP ({', '.join(ts)})""", rows=rows)
        here = F.element_at(F.array(*(F.col(t) for t in ts)), F.greatest(F.col("d"), F.lit(1)))
        found = found.where((F.col("d") == 0) | here.isNotNull())  # a column that is null and not rolled up lies beyond an end
        ends = F.when(F.col("first.reach") == F.col("d"), F.col("first.ends")).otherwise(NO_IDS)
        found = found.select("node", *ts, F.col("d").cast("int").alias("d"), "n_convs", "conv_id", "reps", (F.col("reach") == F.col("d")).cast("long").alias("leaf"), ends.alias("ends"), F.when(F.col("d") > 0, here["chars"]).otherwise(0).alias("chars"), key(F.col("d")).alias("key"))
        nodes = scratch.put(f"nodes{b}", found)
        levels.append(nodes)
        exits = nodes.where(F.col("d") == width).select("key", "reps")
        on = rows.where(F.col("last") > b).select("rep", key(F.lit(width)).alias("key")).join(exits, "key")
        on = scratch.put(f"on{b}", on)
        alone = on.where("reps = 1").select("rep", F.col("key").alias("top"), F.lit(b).alias("at"))
        chains = alone if chains is None else chains.unionByName(alone)
        b += 1
        if on.where("reps > 1").isEmpty():
            break
        front = own.where(F.col("b") == b).join(on.where("reps > 1").select("rep", F.col("key").alias("node")), "rep").select("rep", *ts, "fill", "n", "ends", "last", "node")

    # chains: a conversation alone, one node a turn
    chain = scratch.put("chains", chain_sums(own.join(chains, "rep").where("b > at")))
    each = chain.select("rep", "n", "ends", "last", "b", "fill", "after", F.array(*ts).alias("ts"), F.explode(F.sequence(F.lit(1), F.col("fill"))).alias("d"))
    still = F.aggregate(F.slice("ts", F.col("d"), F.col("fill") - F.col("d") + 1), F.lit(0).cast("long"), lambda a, x: a + x["chars"])
    end = (F.col("b") == F.col("last")) & (F.col("d") == F.col("fill"))
    single = each.select(F.col("rep").alias("conv_id"), (F.col("b") * width + F.col("d")).alias("depth"), F.col("rep").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.when(end, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), ((F.col("n") - 1) * (still + F.col("after"))).alias("saved_tokens"), F.when(end, F.col("ends")).otherwise(NO_IDS).alias("ends_sha256"))
    tops = chain.where("b = at + 1").select(F.col("top").alias("key"), "at", F.lit(1).cast("long").alias("leaves"), ((F.col("n") - 1) * (F.col("after") + F.col("chars"))).alias("saved"), F.lit(1).cast("long").alias("kids"))

    # up: sums over subtrees, from the last block to the first
    done, totals = None, None
    for b in reversed(range(len(levels))):
        below = tops.where(F.col("at") == b).drop("at")
        below = below if totals is None else below.unionByName(totals)
        rows = levels[b].join(below, "key", "left")
        rows = rows.select("node", *ts, "d", F.coalesce("leaves", "leaf").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars") + F.coalesce("saved", F.lit(0))).alias("saved"), F.struct("d", "key", "n_convs", "conv_id", "ends", F.coalesce("kids", F.lit(0)).alias("kids")).alias("self"))
        kids = ", ".join(f"count_if(d = {i + 1}) AS k{i + 1}" for i in range(width))
        sums = spark.sql(f"""SELECT node, {', '.join(ts)}, {width} - bit_count(grouping_id()) AS g, sum(leaves) AS leaves, sum(saved) AS saved, {kids}, min(self) AS self
            FROM {{rows}} GROUP BY node, ROLLUP ({', '.join(ts)})""", rows=rows)
        n_children = reduce(lambda out, i: F.when(F.col("g") == i, F.col(f"k{i + 1}")).otherwise(out), range(width), F.col("self.kids"))
        sums = sums.where(F.col("self.d") == F.col("g"))  # else the columns lie beyond an end
        parent = F.when(F.col("g") == 0, F.lit(None)).otherwise(key(F.col("g") - 1))
        sums = scratch.put(f"sums{b}", sums.select("node", "g", "leaves", "saved", n_children.alias("kids"), "self", parent.alias("parent")))
        totals = sums.where("g = 0").select(F.col("node").alias("key"), "leaves", "saved", "kids")
        out = sums if b == 0 else sums.where("g > 0")
        out = out.select(F.col("self.key").alias("key"), "parent", F.col("self.conv_id").alias("conv_id"), (F.lit(b * width) + F.col("g")).cast("long").alias("depth"), F.col("self.n_convs").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("self.ends").alias("ends_sha256"))
        done = out if done is None else done.unionByName(out)
    names = done.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    shared = done.join(names, "parent", "left").select(*single.columns)
    result = stored(shared.unionByName(single), "trie-result", fresh_path(spark, "trie-result"))
    scratch.drop(*scratch.paths)
    return result


def conversation_trie(conversations: DataFrame, width: int = WIDTH, rebuild: bool = False) -> DataFrame:
    """The trie of a table of ``conv_id, turn, role, text``; rebuild: of conversations that share heads by hundreds."""
    scratch = Scratch(conversations.sparkSession, "conversations")
    turns = numbered(conversations, scratch)
    convs = turns.select("conv_id").distinct()
    out = trie(rebuilt(turns, convs) if rebuild else turns, convs, width)
    scratch.drop(*scratch.paths)
    return out


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table("conversations")(spark, sf_dir), rebuild=True)
