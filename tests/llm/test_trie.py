"""The trie of prefixes equals a plain one; contraction equals sums by recursion on trees of any form."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from ventana.llm import queries, trie
from ventana.llm.common import remainder

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows, every=100, most=6):
    """The contract, with dictionaries."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    built = {}
    for c, own in convs.items():
        h = (zlib.crc32(str(c).encode()) % most) if most else 0
        base = c - (abs(c) % every if c >= 0 else -(abs(c) % every))
        built[c] = convs.get(base, [])[:h] + own[h:]
    members = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    rep = {k: min(v) for k, v in members.items()}
    out = []
    for k, v in members.items():
        below = [x for x in members if x[:len(k)] == k]
        kids = [x for x in below if len(x) == len(k) + 1]
        leaves = [x for x in below if not any(y[:len(x)] == x and len(y) == len(x) + 1 for y in below)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = sorted(c for c in v if tuple(built[c]) == k)
        out.append((rep[k], len(k), rep[k[:-1]] if k else None, len(v), len(kids), len(leaves), saved,
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, block=trie.BLOCK):
    turns = trie.ordered_turns(spark.createDataFrame(rows, SCHEMA).repartition(3))
    members, rebuilt = trie.share_heads(turns.df, every=100, most=6, heads=remainder("member", 6))
    return sorted((tuple(r) for r in trie.prefix_trie(members, rebuilt, block).collect()), key=str)


def test_random_conversations(spark):
    draw = random.Random(3)
    rows = []
    for c in [*range(0, 8), 100, 101, 102, 199, 205, 300, 307, 399, -1, -100, -105]:
        for t in range(draw.choice([0, 1, 2, 3, 5, 9])):
            rows.append((c, draw.choice([t, t, None]), draw.choice(["user", "assistant", None]),
                         draw.choice(["a", "bb", "", None, "ö🙂"])))
    rows += [(None, 0, "user", "lost"), *rows[:5]]
    want = plain(rows)
    assert run(spark, rows) == want
    assert run(spark, rows, block=2) == want                 # prefixes carried from block to block


def test_defined_cases(spark):
    assert run(spark, []) == []
    nothing = trie.EMPTY_SHA256
    one = run(spark, [(7, None, None, None)])
    assert one == plain([(7, None, None, None)])
    # 107 % 6 turns come from a conversation that is not there
    assert all(r[1] == 0 or r[7] != nothing or r[4] for r in one)
    clash = spark.createDataFrame([(0, 0, "u", "x", "other", 5)], SCHEMA + ", `a.b` string, member long")
    turns = trie.ordered_turns(clash)
    members, own = trie.with_lengths(turns.df)
    got = sorted(map(tuple, trie.prefix_trie(members, own).collect()), key=lambda r: r[1])
    end = hashlib.sha256(b"0").hexdigest()
    assert got == [(0, 0, None, 1, 1, 1, 0, nothing), (0, 1, 0, 1, 0, 1, 0, end)]


def forest(kind, n, seed):
    draw = random.Random(seed)
    parent = {0: None}
    for i in range(1, n):
        if kind == "chain":
            parent[i] = i - 1
        elif kind == "star":
            parent[i] = 0
        elif kind == "caterpillar":
            parent[i] = i - 1 if i % 2 else max(0, i - 2)
        elif kind == "forest" and draw.random() < 0.1:
            parent[i] = None
        else:
            parent[i] = draw.randrange(max(0, i - 6), i)
    names = list(range(n))
    draw.shuffle(names)
    return [(names[i], None if p is None else names[p], draw.randrange(10), 1) for i, p in parent.items()]


@pytest.mark.parametrize("kind,n", [("chain", 300), ("star", 200), ("caterpillar", 150), ("random", 250), ("forest", 120),
                                    ("chain", 1)])
def test_contraction(spark, kind, n):
    rows = forest(kind, n, 9)
    total = {i: [a, b] for i, _, a, b in rows}
    parent = {i: p for i, p, _, _ in rows}
    for i, _, a, b in rows:
        p = parent[i]
        while p is not None:
            total[p][0] += a
            total[p][1] += b
            p = parent[p]
    nodes = spark.createDataFrame(rows, "node long, parent long, x long, y long")
    got = {r.node: [r.x, r.y] for r in trie.subtree_sums(nodes, ["x", "y"]).df.collect()}
    assert got == total


def test_cycles_are_refused(spark, monkeypatch):
    monkeypatch.setattr(trie, "MOST_ROUNDS", 3)
    nodes = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, 1, 1)], "node long, parent long, x long")
    with pytest.raises(RuntimeError):
        trie.subtree_sums(nodes, ["x"])


def test_digest_of_many_ends(spark):
    """One node's ends in many Arrow batches of one task."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        ends = spark.range(2000).select(F.lit(1).cast("long").alias("pos"), (F.col("id") % 2).alias("p"),
                                        F.lit(0).cast("long").alias("q"), F.col("id").alias("member"))
        got = {r.p: r.ends_sha256 for r in trie.end_digests(ends).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k: hashlib.sha256(",".join(str(i) for i in range(k, 2000, 2)).encode()).hexdigest() for k in (0, 1)}


def test_order_of_a_long_conversation(spark):
    """Turns of one conversation that lie in many ranges are numbered through."""
    n = 5000
    rows = spark.range(n).select(F.lit(5).cast("long").alias("conv_id"), (F.lit(n) - F.col("id")).alias("turn"),
                                 F.lit("user").alias("role"), F.col("id").cast("string").alias("text")).repartition(7)
    got = trie.ordered_turns(rows).df
    assert got.agg(F.min("pos"), F.max("pos"), F.count_distinct("pos")).first()[:] == (1, n, n)
    named = rows.select(F.xxhash64(F.lit(1), "role", "text").alias("a"), "turn")
    assert got.join(named, "a").filter("pos <> turn").count() == 0


def test_query_has_its_columns(spark):
    from paths import SF001
    df = queries.QUERIES["op12_conversation_trie"](spark, SF001)
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                          "ends_sha256"]
    roots = df.filter("depth = 0").collect()
    assert len(roots) == 1 and roots[0].parent_conv_id is None
