"""Trie of conversation prefixes with totals of every subtree by parallel tree contraction (operator 12).

**Nodes.** A node is a distinct sequence of first turns (role and text). Every turn is hashed with its place; the
exclusive or of the hashes of the first d turns (two of 64 bits) names the prefix, so prefixes need
no gathering: running hashes inside blocks of turns, and one carry per block of the few long members.
Members, sizes and smallest members are aggregations by that name that combine before the shuffle.

**Contraction.** Subtree sums are found in rounds of joins over the nodes that are left:

* *rake*: all leaves go; what they have collected is added to their parents in one aggregation;
* *compress*: of the nodes with a single child left, those whose hash (anew in each round) is above that of
  their child and of their parent go, which are never two in a row; their child takes their
  place under the parent and keeps their sum on its new edge.

A round takes away all leaves and about a third of every chain, so the rounds grow with the logarithm of the number of
nodes, whatever the depth. Then the rounds are re-expanded backwards: a node that was compressed has
its own sum and that of its child, which is known by then. Tables of the rounds shrink
geometrically, each is written to the shared folder, and the total work is linear in the nodes.

**Members that end at a node** are hashed in order of their ids by a task that streams over sorted rows and
keeps one running digest, so a node at which a third of all members end takes no more memory than others.

Defined cases: null roles and texts count as empty; rows without a conversation id are left out; a null turn comes
first; equal turns of a conversation are ordered by role and text, and repeated rows are turns of
their own; members without turns end at the root; no members, no nodes (not even the root). Only the named columns
are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Table, quoted

#: Turns of a member hashed in one run; longer members are cut into blocks of this size.
BLOCK = 4096
#: Rounds after which contraction is given up as broken (two thirds to this power is below any table).
MOST_ROUNDS = 200
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def ordered_turns(rows: DataFrame, *, member: str = "conv_id", order: str = "turn", role: str = "role",
                  text: str = "text") -> Table:
    """(member, pos, a, b, chars): the turns of each member numbered from 1, with two hashes of role and
    text and the code points of the text.

    Rows are cut into ranges of (member, turn, role, text), so a member of very many turns lies in
    many of them; its numbers are shifted by its counts in the ranges before.
    """
    given = rows.select(F.col(quoted(member)).cast("long").alias("member"), F.col(quoted(order)).alias("turn"),
                        F.coalesce(F.col(quoted(role)).cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")).alias("text")) \
        .filter("member is not null")
    sort = [F.col("member"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    cut = given.repartitionByRange(*sort).sortWithinPartitions(*sort).select(
        "member", F.monotonically_increasing_id().alias("seq"), F.xxhash64(F.lit(1), "role", "text").alias("a"),
        F.xxhash64(F.lit(2), "text", "role").alias("b"), F.length("text").cast("long").alias("chars"))
    ranged = Table(cut.withColumn("part", F.shiftright("seq", 33)), "turns")
    before = Window.partitionBy("member").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.df.groupBy("member", "part").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n")) \
        .withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    out = Table(ranged.df.join(counts, ["member", "part"]).select(
        "member", (F.col("seq") - F.col("first") + F.col("shift") + 1).alias("pos"), "a", "b", "chars"), "turns")
    ranged.drop()
    return out


def share_heads(turns: DataFrame, *, every: int, most: int, heads: Column) -> tuple[DataFrame, DataFrame]:
    """Members rebuilt as copies of a common start: the first ``heads`` turns (an expression of ``member``, below
    ``most``) come from the member ``member - member % every`` where it has them, the others are its own.

    Returns (member, length) of all members and the rebuilt turns (member, pos, a, b, chars, length).
    """
    sizes = turns.groupBy("member").agg(F.count(F.lit(1)).alias("own"))
    asked = sizes.select("member", "own", (F.col("member") - F.col("member") % every).alias("base"), heads.alias("h"))
    starts = sizes.select(F.col("member").alias("base"), F.col("own").alias("start"))
    taken = F.least("h", F.coalesce("start", F.lit(0)))
    plan = asked.join(starts, "base", "left").withColumn("k", taken).withColumn(
        "length", F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    plan = Table(plan.select("member", "base", "h", "k", "length"), "members").df
    first = turns.filter((F.col("pos") < most) & (F.col("member") % every == 0)) \
        .withColumnRenamed("member", "base")       # at most ``every`` members ask for a start
    lent = plan.filter("k > 0").join(first, "base").filter("pos <= k") \
        .select("member", "pos", "a", "b", "chars", "length")
    own = turns.join(plan.select("member", "h", "k", "length"), "member").filter("pos > h") \
        .select("member", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "a", "b", "chars", "length")
    return plan.select("member", "length"), lent.unionByName(own)


def prefixes(turns: DataFrame, block: int = BLOCK) -> Table:
    """(member, pos, chars, length, p, q, p0, q0): names of the prefix that ends with each turn and of the one before."""
    mixed = turns.select("member", "pos", "chars", "length", F.xxhash64("pos", "a", "b").alias("x"),
                         F.xxhash64("b", "pos", "a").alias("y"),
                         F.floor((F.col("pos") - 1) / block).alias("block"))
    run = Window.partitionBy("member", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    inside = mixed.select("*", F.bit_xor("x").over(run).alias("p"), F.bit_xor("y").over(run).alias("q"))
    totals = mixed.filter(F.col("length") > block).groupBy("member", "block") \
        .agg(F.bit_xor("x").alias("cx"), F.bit_xor("y").alias("cy"))
    before = Window.partitionBy("member").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("member", "block", F.bit_xor("cx").over(before).alias("cx"),
                          F.bit_xor("cy").over(before).alias("cy")).filter("cx is not null")
    full = inside.join(carry, ["member", "block"], "left").withColumn(
        "p", F.col("p").bitwiseXOR(F.coalesce("cx", F.lit(0)))).withColumn(
        "q", F.col("q").bitwiseXOR(F.coalesce("cy", F.lit(0))))
    return Table(full.select("member", "pos", "chars", "length", "p", "q",
                             F.col("p").bitwiseXOR(F.col("x")).alias("p0"),
                             F.col("q").bitwiseXOR(F.col("y")).alias("q0")), "prefixes")


def end_digests(ends: DataFrame) -> DataFrame:
    """(pos, p, q, ends_sha256): digest of the ids (ascending, joined by commas) of the members that end at a prefix."""
    keys = ["pos", "p", "q"]
    dealt = ends.select(*keys, "member").repartition(*keys).sortWithinPartitions(*keys, "member")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, done = None, None, []

        def rows():
            cols = list(zip(*done))
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3])],
                                              names=[*keys, "ends_sha256"])
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
            ids = batch.column(3).to_pylist()
            starts = [0, *(1 + np.flatnonzero((k[1:] != k[:-1]).any(axis=1))).tolist(), len(ids)]
            for a, b in zip(starts, starts[1:]):
                part, now = ",".join(map(str, ids[a:b])).encode(), tuple(k[a].tolist())
                if now == key:
                    digest.update(b"," + part)
                    continue
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = now, hashlib.sha256(part)
            if len(done) > 10_000:
                yield rows()
                done.clear()
        if key is not None:
            done.append((*key, digest.hexdigest()))
        if done:
            yield rows()

    return dealt.mapInArrow(digests, "pos long, p long, q long, ends_sha256 string")


def subtree_sums(nodes: DataFrame, sums: list[str]) -> Table:
    """Sums of ``sums`` (long columns) over the subtree of every node of a forest (node, parent, sums), each tree
    contracted by rakes and compressions. Returns (node, sums)."""
    kids = nodes.filter("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("kids")) \
        .withColumnRenamed("parent", "node")
    # own: collected so far at the node; edge: what the compressed nodes above add on the way to the parent
    now = Table(nodes.join(kids, "node", "left").select(
        "node", "parent", F.coalesce("kids", F.lit(0)).alias("kids"), *[F.col(s).cast("long").alias(f"own_{s}") for s in sums],
        *[F.lit(0).cast("long").alias(f"edge_{s}") for s in sums],
        F.lit(None).cast("long").alias("gone"), *[F.lit(None).cast("long").alias(f"gone_{s}") for s in sums]), "contract")
    rounds = [now]
    while not now.df.filter("kids > 0").isEmpty():
        if len(rounds) > MOST_ROUNDS:
            raise RuntimeError(f"subtree_sums: not contracted after {MOST_ROUNDS} rounds; parents form a cycle")
        now = Table(_contracted(now.df, sums, len(rounds)), "contract")
        rounds.append(now)
    total = [F.col(f"own_{s}").alias(s) for s in sums]
    known = Table(now.df.select("node", *total), "subtrees")
    for r in range(len(rounds) - 1, 0, -1):
        back = rounds[r].df.filter("gone is not null").join(known.df, "node").select(
            F.col("gone").alias("node"), *[(F.col(f"gone_{s}") + F.col(s)).alias(s) for s in sums])
        raked = rounds[r - 1].df.filter("kids = 0").select("node", *total)
        more = Table(known.df.unionByName(back).unionByName(raked), "subtrees")
        known.drop()
        known = more
        rounds[r].drop()
    rounds[0].drop()
    return known


def _contracted(alive: DataFrame, sums: list[str], r: int) -> DataFrame:
    """One rake and one compression."""
    leaf = F.col("kids") == 0
    given = alive.filter("parent is not null").groupBy("parent").agg(
        F.sum(F.when(leaf, 0).otherwise(1)).alias("left"), F.min(F.when(~leaf, F.col("node"))).alias("child"),
        *[F.sum(F.when(leaf, F.col(f"own_{s}") + F.col(f"edge_{s}")).otherwise(0)).alias(f"raked_{s}") for s in sums]) \
        .withColumnRenamed("parent", "node")
    raked = alive.filter("kids > 0").join(given, "node").select(
        "node", "parent", F.col("left").alias("kids"), "child",
        *[(F.col(f"own_{s}") + F.col(f"raked_{s}")).alias(f"own_{s}") for s in sums], *[f"edge_{s}" for s in sums])
    height = [F.xxhash64(F.col(c), F.lit(r)) for c in ("node", "child", "parent")]
    goes = F.coalesce((F.col("kids") == 1) & F.col("parent").isNotNull() & (height[0] > height[1]) & (height[0] > height[2]),
                      F.lit(False))
    # a node that goes is told to its child, every other one to itself: one aggregation brings them together
    told = raked.withColumn("goes", goes).withColumn("to", F.when(F.col("goes"), F.col("child")).otherwise(F.col("node")))
    stays, goes = ~F.col("goes"), F.col("goes")
    met = told.groupBy(F.col("to").alias("node")).agg(
        F.max(F.when(stays, F.col("parent"))).alias("parent"), F.max(F.when(stays, F.col("kids"))).alias("kids"),
        F.max(F.when(goes, F.col("node"))).alias("gone"), F.max(F.when(goes, F.col("parent"))).alias("above"),
        *[F.max(F.when(stays, F.col(f"{k}_{s}"))).alias(f"{k}_{s}") for s in sums for k in ("own", "edge")],
        *[F.max(F.when(goes, F.col(f"{k}_{s}"))).alias(f"up_{k}_{s}") for s in sums for k in ("own", "edge")])
    up = F.col("gone").isNotNull()
    return met.select(
        "node", F.when(up, F.col("above")).otherwise(F.col("parent")).alias("parent"), "kids",
        *[f"own_{s}" for s in sums],
        *[(F.col(f"edge_{s}") + F.when(up, F.col(f"up_own_{s}") + F.col(f"up_edge_{s}")).otherwise(0)).alias(f"edge_{s}")
          for s in sums],
        "gone", *[(F.col(f"up_own_{s}") + F.col(f"edge_{s}")).alias(f"gone_{s}") for s in sums])


def prefix_trie(members: DataFrame, turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per distinct prefix of the members' turns, from the root (no turns) on.

    ``members`` is (member, length) and ``turns`` (member, pos, a, b, chars, length) as ``share_heads`` or
    ``with_lengths`` give them. Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (code points that members share beyond their first copy) and ends_sha256.
    """
    pre = prefixes(turns, block)
    named = pre.df.groupBy("pos", "p", "q").agg(
        F.min("member").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"),
        F.min("p0").alias("p0"), F.min("q0").alias("q0"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = members.agg(F.min("member").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0") \
        .select(zero.alias("pos"), zero.alias("p"), zero.alias("q"), "conv_id", "n_convs", zero.alias("chars"),
                none.alias("p0"), none.alias("q0"))
    nodes = Table(named.unionByName(root).withColumn("node", F.monotonically_increasing_id()), "nodes")
    above = nodes.df.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"),
                            (F.col("pos") + 1).alias("pos"), F.col("p").alias("p0"), F.col("q").alias("q0"))
    linked = Table(nodes.df.join(above, ["pos", "p0", "q0"], "left").drop("p0", "q0"), "nodes")
    nodes.drop()
    kids = linked.df.filter("parent is not null").groupBy(F.col("parent").alias("node")) \
        .agg(F.count(F.lit(1)).alias("n_children"))
    saved = ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")
    full = Table(linked.df.join(kids, "node", "left").withColumn("n_children", F.coalesce("n_children", zero)), "nodes")
    linked.drop()
    sums = subtree_sums(full.df.select("node", "parent", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
                                       .alias("n_leaves"), saved), ["n_leaves", "saved_tokens"])
    ends = pre.df.filter("pos = length").select("pos", "p", "q", "member").unionByName(
        members.filter("length = 0").select(zero.alias("pos"), zero.alias("p"), zero.alias("q"), "member"))
    return full.df.join(sums.df, "node").join(end_digests(ends), ["pos", "p", "q"], "left").select(
        "conv_id", F.col("pos").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))


def with_lengths(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members as they are: (member, length) and their turns with the length, for ``prefix_trie``."""
    members = Table(turns.groupBy("member").agg(F.count(F.lit(1)).alias("length")), "members").df
    return members, turns.join(members, "member")


def oracle() -> str:
    """SQL of the query ``op12_conversation_trie``. The root has no parent; pandas holds a column of integers and a null
    as doubles, so the parent is one here."""
    step = ", ".join(["CAST(-1 AS BIGINT)"] * 8)
    return f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
             PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c, c - c % 100 AS base FROM t),
crc AS (SELECT c, base, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(
          string_split(CAST(c AS VARCHAR), ''), lambda s: [CAST(ascii(s) AS BIGINT), {step}]))),
          lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a // 2, 3988292384 * (a % 2)) END), 4294967295) % 6 AS h
        FROM ids),
parts AS (SELECT crc.c, 0 AS own, pos, role, text FROM crc JOIN t ON t.c = crc.base AND pos <= h
          UNION ALL SELECT crc.c, 1, pos, role, text FROM crc JOIN t ON t.c = crc.c AND pos > h),
turns AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, pos) AS d, role, text FROM parts),
pre AS (SELECT c, d, text, list({{'r': role, 't': text}}) OVER (PARTITION BY c ORDER BY d) AS seq FROM turns
        UNION ALL SELECT c, 0, '', [] FROM ids),
node AS (SELECT d, seq, min(c) AS conv_id, count(*) AS n_convs, min(text) AS text FROM pre GROUP BY d, seq),
m AS (SELECT pre.c, pre.d, node.conv_id AS rep FROM pre JOIN node ON pre.d = node.d AND pre.seq = node.seq),
n AS (SELECT node.d, conv_id, n_convs, text, m.rep AS parent FROM node
      LEFT JOIN m ON m.c = node.conv_id AND m.d = node.d - 1),
kids AS (SELECT parent, d - 1 AS d, count(*) AS k FROM n WHERE d > 0 GROUP BY parent, d),
full_n AS (SELECT n.*, coalesce(k, 0) AS n_children FROM n LEFT JOIN kids ON kids.parent = n.conv_id AND kids.d = n.d),
sub AS (SELECT m.rep, m.d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves,
               sum((n_convs - 1) * length(text)) AS saved
        FROM full_n x JOIN m ON m.c = x.conv_id AND m.d <= x.d GROUP BY m.rep, m.d),
last AS (SELECT c, max(d) AS d FROM pre GROUP BY c),
ends AS (SELECT rep, m.d, string_agg(CAST(m.c AS VARCHAR), ',' ORDER BY m.c) AS members
         FROM m JOIN last ON last.c = m.c AND last.d = m.d GROUP BY rep, m.d)
SELECT conv_id, CAST(x.d AS BIGINT) AS depth, CAST(parent AS DOUBLE) AS parent_conv_id, n_convs, CAST(n_children AS BIGINT) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
       sha256(coalesce(members, '')) AS ends_sha256
FROM full_n x JOIN sub ON sub.rep = x.conv_id AND sub.d = x.d
LEFT JOIN ends ON ends.rep = x.conv_id AND ends.d = x.d"""
