import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from riskloom.llm import prefix_trie as pt

SMALL = "/root/testdata/sf0.001"
KIND = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, rebuild):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            text = text or ""
            own[c].append(((turn is not None, turn or 0), role or "", text[:64], hashlib.sha256(f"{len(role or '')}|{role or ''}{text}".encode()).hexdigest(), text))
    own = {c: [(r, t) for _, r, _, _, t in sorted(v)] for c, v in own.items()}
    seqs = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        seqs[c] = tuple((own.get(base, [])[:h] if rebuild else []) + v[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in seqs.items():
        ends[s].append(c)
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = defaultdict(list)
    for s in members:
        if s:
            kids[s[:-1]].append(s)
    leaves, saved, out = {}, {}, []
    for s in sorted(members, key=len, reverse=True):
        leaves[s] = sum(leaves[k] for k in kids[s]) or 1
        saved[s] = (len(members[s]) - 1) * (len(s[-1][1]) if s else 0) + sum(saved[k] for k in kids[s])
        told = ",".join(map(str, sorted(ends[s])))
        out.append((min(members[s]), len(s), min(members[s[:-1]]) if s else None, len(members[s]), len(kids[s]), leaves[s], saved[s], hashlib.sha256(told.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_table_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = pt.op11_prefix_trie(spark, SMALL)
    assert out.columns == COLUMNS and {t for _, t in out.dtypes} == {"bigint", "string"}
    assert got(out) == brute(rows, True)


@pytest.mark.parametrize("seed,width,rebuild", [(1, 8, True), (2, 2, True), (3, 2, False), (4, 3, False)])
def test_random_trees_equal_brute_force(spark, seed, width, rebuild):
    """Few texts, so that prefixes are shared over several blocks, copies, ties and nulls; ids without turns after the head."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 40), *range(195, 230), -150, -199, 350, 10**15 + 7]:
        kind = rng.random()
        n = rng.choice([0, 1, 3, 7, 12, 30]) if kind < 0.8 else 5
        for i in range(n):
            text = "é" if kind > 0.8 else rng.choice(["a", "a", "a", "a", "bb", "", None, "c" * 200])
            rows.append((c, rng.choice([i, i, None]) if kind < 0.2 else i, rng.choice(["user", "user", None]) if kind < 0.1 else "user", text))
    rows += rows[:3] + [(None, 1, "user", "a")]
    rng.shuffle(rows)
    assert got(pt.conversation_trie(spark.createDataFrame(rows, KIND), width, rebuild)) == brute(rows, rebuild)


def test_long_conversations_alone_and_alike(spark):
    rows = [(c, i, "user", "x" if i < 20 else f"{c // 2}") for c in range(4) for i in range(3000)] + [(9, i, "user", "y" * 1000) for i in range(50)]
    assert got(pt.conversation_trie(spark.createDataFrame(rows, KIND))) == brute(rows, False)


def test_odd_columns_and_empty_tables(spark):
    rows = [(1, 0, "user", "t" * 200_000, "k", 3), (2, None, None, None, "k", 4)]
    df = spark.createDataFrame(rows, KIND + ", key string, depth int")
    assert got(pt.conversation_trie(df, rebuild=True)) == brute([r[:4] for r in rows], True)
    assert pt.conversation_trie(df.limit(0), rebuild=True).count() == 0
