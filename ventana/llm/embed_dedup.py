"""Embedding near-duplicates by a robust-pruned flat graph over cluster shards (operator 9).

1. **Classes**: equal vectors form one class, named by its smallest id, with its size.
2. **Shards**: spherical k-means centroids, fitted on a bounded sample (``SAMPLE`` classes), cut the
   space into shards of about ``SHARD`` members; every class joins its ``overlap`` nearest shards.
   Where ``MOST_SHARDS`` shards would still be large on average, each is cut again by centroids fitted on
   a sample of its own members, and its members join the nearest ``INNER`` of those. A shard above
   ``BLOCK`` members (a dense region) is dealt into blocks by a hash.
3. **Graph**: each block builds a flat graph: candidates are the nearest members and random ones,
   robust pruning (``ALPHA``) keeps at most ``DEGREE`` edges that point in different directions. The
   adjacency lists of a class from all its shards are united.
4. **Search**: each pair of blocks of a shard is a cell. Every member is a query: a greedy beam
   starts at the blocks' medoids and follows the united lists; then everything found within reach
   of the threshold is expanded until nothing new comes up (range expansion). A pair found from
   either side counts in the first shard that both share, so once.
5. **Verify**: cosines are computed in double precision; only those at or above the threshold link.
6. **Audit**: the links of ``AUDIT`` sampled classes are counted against all rows by brute force, in
   blocks, and more classes are drawn, up to ``MOST_AUDIT``, until ``ENOUGH`` of them have links. The
   share found is averaged over classes, so that a dense group does not outweigh the others. Below
   ``RECALL`` the search is repeated with twice the overlap; where ``MOST_OVERLAP`` is below it too,
   all pairs are compared, in blocks.

Links never leave a cell: each member sends its number of links and one edge of a spanning forest,
so a dense group of any size sends rows in proportion to its members. Components are then found on
those edges.

Result: one row per vector (id, n_links, component_id, kept). Defined cases: a vector that is null,
empty, zero, or holds a null or non-finite component links with nothing; vectors of different
lengths never link; repeated rows count as separate vectors; a row without an id has no links and
a null component. Only the id and vector columns are read.
"""

from __future__ import annotations

import warnings
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, components, shared, written

SAMPLE, SHARD, BLOCK, MOST_SHARDS = 20_000, 1_200, 2_048, 4_096
#: Average members above which shards are cut again, subshards a member joins, rows assigned at once.
LARGE, INNER, CHUNK = 8_192, 2, 20_000
DEGREE, NEAR, FAR, ALPHA = 24, 48, 24, 1.2
BEAM, STEP, SLACK, QUERIES = 24, 4, 0.06, 256
#: Expansions and dot products of a search held at once (some tens of MB each).
STEPS_AT_ONCE, PRODUCTS_AT_ONCE = 5_000, 25_000
AUDIT, MOST_AUDIT, ENOUGH, RECALL, MOST_OVERLAP = 1_024, 8_192, 100, 0.97, 16


def unit(vectors) -> np.ndarray:
    """Rows of unit length in double precision; scaled first, so that no square overflows."""
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def can_link() -> Column:
    """Whether the vector ``vec`` is neither null, empty nor zero and has finite components only."""
    v = F.col("vec")
    finite = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return F.coalesce(F.col("id").isNotNull() & finite & F.exists(v, lambda c: c != 0), F.lit(False))


def centroids(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means of unit vectors; empty clusters keep their centre."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(sample)))
    c = sample[np.sort(rng.choice(len(sample), k, replace=False))].copy()
    for _ in range(rounds if k > 1 else 0):
        at = np.concatenate([(sample[i:i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, at, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-12, total / np.maximum(size, 1e-12), c)
    return c


def build_graph(x: np.ndarray, seed: int = 11) -> np.ndarray:
    """Adjacency (n, DEGREE), -1 where unused, of unit vectors x by robust pruning."""
    n = len(x)
    if n == 1:
        return np.full((1, DEGREE), -1, np.int64)
    sim = (x @ x.T).astype(np.float32)
    np.fill_diagonal(sim, -2)
    near = min(NEAR, n - 1)
    cand = np.argpartition(-sim, near - 1, axis=1)[:, :near]
    rng = np.random.default_rng(seed)
    cand = np.concatenate([cand, rng.integers(0, n, (n, FAR))], axis=1)
    me = np.arange(n)[:, None]
    dist = np.sqrt(np.maximum(2 - 2 * sim[me, cand], 0))
    dist[cand == me] = np.inf
    out = np.full((n, DEGREE), -1, np.int64)
    row = np.arange(n)
    for d in range(DEGREE):
        at = dist.argmin(axis=1)
        best = cand[row, at]
        live = np.isfinite(dist[row, at])
        if not live.any():
            break
        out[live, d] = best[live]
        between = np.sqrt(np.maximum(2 - 2 * sim[best[:, None], cand], 0))
        between[cand == best[:, None]] = 0
        dist[(ALPHA * between <= dist) & live[:, None]] = np.inf
        dist[row, at] = np.inf
    return out


def both_ways(adj: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges in both directions as (start of each node's list, neighbours)."""
    a = np.repeat(np.arange(n), [len(r) for r in adj])
    b = np.concatenate(adj) if n else np.empty(0, np.int64)
    u, v = np.concatenate([a, b]), np.concatenate([b, a])
    key = np.unique(u * n + v)
    u, v = key // n, key % n
    return np.searchsorted(u, np.arange(n + 1)), v


def search_cell(x: np.ndarray, starts: np.ndarray, lists: np.ndarray, entries: np.ndarray,
                threshold: float) -> np.ndarray:
    """Boolean (n, n): pairs that greedy search with range expansion finds at or above the threshold."""
    n = len(x)
    hits = np.zeros((n, n), bool)
    sizes = np.diff(starts)
    for q0 in range(0, n, QUERIES):
        q = np.arange(q0, min(n, q0 + QUERIES))
        sim = np.full((len(q), n), -2.0)
        open_ = np.zeros((len(q), n), bool)        # seen and not yet expanded
        sim[:, entries] = x[q] @ x[entries].T
        open_[:, entries] = True

        def expand(qi: np.ndarray, node: np.ndarray) -> None:
            open_[qi, node] = False
            for a in range(0, len(qi), STEPS_AT_ONCE):
                qa, na = qi[a:a + STEPS_AT_ONCE], node[a:a + STEPS_AT_ONCE]
                many = sizes[na]
                who = np.repeat(qa, many)
                offset = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                to = lists[np.repeat(starts[na], many) + offset]
                new = sim[who, to] == -2.0
                key = np.unique(who[new] * n + to[new])
                who, to = key // n, key % n
                for i in range(0, len(who), PRODUCTS_AT_ONCE):
                    w, t = who[i:i + PRODUCTS_AT_ONCE], to[i:i + PRODUCTS_AT_ONCE]
                    sim[w, t] = np.einsum("ij,ij->i", x[q[w]], x[t])
                open_[who, to] = True

        beam = min(BEAM, n)
        while True:
            edge = np.partition(sim, n - beam, axis=1)[:, n - beam] if n > beam else np.full(len(q), -2.0)
            todo = np.where(open_ & (sim >= edge[:, None]), sim, -3.0)
            if n > STEP:
                best = np.argpartition(-todo, STEP - 1, axis=1)[:, :STEP]
            else:
                best = np.tile(np.arange(n), (len(q), 1))
            rows = np.repeat(np.arange(len(q)), best.shape[1])
            cols = best.ravel()
            go = todo[rows, cols] > -3.0
            if not go.any():
                break
            expand(rows[go], cols[go])
        while True:
            rows, cols = np.nonzero(open_ & (sim >= threshold - SLACK))
            if not len(rows):
                break
            expand(rows, cols)
        hits[q] = sim >= threshold
    hits |= hits.T
    np.fill_diagonal(hits, False)
    return hits


def spanning(hits: np.ndarray) -> np.ndarray:
    """Smallest position reachable over hits, for each position."""
    n = len(hits)
    label = np.arange(n)
    a, b = np.nonzero(hits)
    while len(a):
        low = label.copy()
        np.minimum.at(low, a, label[b])
        low = np.minimum(low, low[low])
        if (low == label).all():
            break
        label = low
    return label


def near_duplicates(rows: DataFrame, *, threshold: float = 0.95, id_col: str = "vec_id",
                    vec_col: str = "embedding", overlap: int = 4) -> DataFrame:
    """(id, n_links, component_id, kept) for every row."""
    given = rows.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    good = given.filter(can_link())
    # a class of equal vectors has a number of its own: an id may stand for several vectors
    known = written(good.groupBy("vec").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
                    .withColumn("rep", F.monotonically_increasing_id()), "classes")
    n_classes = known.count()
    while True:
        links, edges = _search(known, n_classes, threshold, overlap)
        if _recall(known, links, threshold, n_classes) >= RECALL:
            break
        if overlap >= MOST_OVERLAP:
            links, edges = _search(known, n_classes, threshold, overlap, exact=True)
            break
        overlap *= 2
    comp = components(edges)
    per_class = known.join(links, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left") \
        .select("vec", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                F.coalesce("component", "rep").alias("group"))
    least = per_class.groupBy("group").agg(F.min("first").alias("component_id"))
    per_class = per_class.join(least, "group").select("vec", "n_links", "component_id")
    linked = good.join(per_class, "vec").select("id", "n_links", "component_id")
    alone = given.filter(~can_link()).select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").cast("long").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"),
        F.col("component_id").cast("long").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _search(known: DataFrame, n_classes: int, threshold: float, overlap: int,
            exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rep, links) and spanning edges (a, b); if ``exact``, of all pairs of vectors of one length."""
    if exact:
        whole = known.withColumn("shards", F.array(F.size("vec").cast("long"))) \
            .withColumn("near", F.array().cast("array<long>"))
        sizes = whole.groupBy(F.col("shards")[0].alias("shard")) \
            .agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        return _cells(whole, written(sizes, "blocks"), threshold, exact)
    spark = known.sparkSession
    some = bounded_sample(known.select("rep", "vec"), "rep", SAMPLE).select("vec").toPandas()["vec"]
    by_size: dict[int, list] = {}
    for v in some:
        by_size.setdefault(len(v), []).append(v)
    centres, first = {}, 0
    for size in sorted(by_size):
        share = n_classes * len(by_size[size]) / max(1, len(some))
        k = int(min(MOST_SHARDS, max(1, round(overlap * share / SHARD)), max(1, len(by_size[size]) // 8)))
        c = centroids(unit(by_size[size]), k)
        centres[size] = (first, c)
        first += len(c)
    state = shared(spark, {"centres": centres})

    @F.pandas_udf("array<int>")
    def nearest(vecs: pd.Series) -> pd.Series:
        out: list = [[]] * len(vecs)
        for size in {len(v) for v in vecs}:
            at = [i for i, v in enumerate(vecs) if len(v) == size]
            # a length that the sample has not met is a shard of its own
            start, c = state.value["centres"].get(size, (-size, np.zeros((1, size))))
            top = _nearest_rows(unit([vecs.iloc[i] for i in at]) @ c.T, overlap)
            for i, row in zip(at, top):
                out[i] = (row + start).tolist()
        return pd.Series(out, dtype=object)

    placed = written(known.withColumn("shards", nearest("vec").cast("array<long>")), "placed")
    if overlap * n_classes > LARGE * first:
        inner = int(min(MOST_SHARDS, max(2, overlap * n_classes // max(1, first) // SHARD)))
        placed = written(_cut_again(placed, inner), "placed")
    member = placed.withColumn("shard", F.explode("shards"))
    many = member.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    many = written(many, "blocks")          # one row per shard, at most MOST_SHARDS per vector length

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        ids = pdf["rep"].to_numpy()
        adj = build_graph(unit(pdf["vec"]))
        return pd.DataFrame({"rep": ids, "near": [ids[r[r >= 0]] for r in adj]})

    lists = _blocked(member.select("rep", "vec", "shard"), many).groupBy("shard", "block") \
        .applyInPandas(build, "rep long, near array<long>")
    union = lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    return _cells(written(placed.join(union, "rep"), "graph"), many, threshold, exact)


def _blocked(df: DataFrame, many: DataFrame) -> DataFrame:
    return df.join(many, "shard").withColumn(
        "block", F.pmod(F.xxhash64("rep", F.lit("block")), F.col("blocks")).cast("int"))


def _cells(graph: DataFrame, many: DataFrame, threshold: float, exact: bool) -> tuple[DataFrame, DataFrame]:
    """Links and spanning edges of every pair of blocks of each shard."""
    cells = _blocked(graph.withColumn("shard", F.explode("shards")), many).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep").reset_index(drop=True)
        shard = int(pdf["shard"].iloc[0])
        apart = pdf["i"].iloc[0] != pdf["j"].iloc[0]
        ids, block, weight = pdf["rep"].to_numpy(), pdf["block"].to_numpy(), pdf["n"].to_numpy()
        x = unit(pdf["vec"])
        n = len(ids)
        if exact:
            hits = x @ x.T >= threshold
            np.fill_diagonal(hits, False)
        else:
            near = []
            for own, r in zip(ids, pdf["near"]):
                at = np.minimum(np.searchsorted(ids, r), n - 1)
                near.append(at[(ids[at] == r) & (r != own)])
            starts, neighbours = both_ways(near, n)
            medoids = []
            for b in np.unique(block):
                at = np.flatnonzero(block == b)
                medoids.append(at[int((x[at] @ x[at].mean(axis=0)).argmax())])
            hits = search_cell(x, starts, neighbours, np.array(medoids), threshold)
        if apart:
            hits &= block[:, None] != block[None, :]
        label = spanning(hits)
        lower = sorted({s for row in pdf["shards"] for s in row if s < shard})
        if lower and hits.any():
            column = {s: i for i, s in enumerate(lower)}
            inside = np.zeros((n, len(lower)), np.float32)
            for i, row in enumerate(pdf["shards"]):
                for s in row:
                    if s < shard:
                        inside[i, column[s]] = 1
            for a in range(0, n, 1024):
                hits[a:a + 1024] &= (inside[a:a + 1024] @ inside.T) == 0
        out = pd.DataFrame({"rep": ids, "links": hits @ weight, "low": ids[label]})
        return out[(out["links"] > 0) | (out["low"] != out["rep"])]

    found = written(cells.groupBy("shard", "i", "j").applyInPandas(search, "rep long, links long, low long"), "found")
    return (found.groupBy("rep").agg(F.sum("links").alias("links")),
            found.filter("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b")))


def _nearest_rows(sims: np.ndarray, t: int) -> np.ndarray:
    """Positions of the ``t`` largest values of each row, ascending."""
    t = min(t, sims.shape[1])
    if t == sims.shape[1]:
        return np.tile(np.arange(t), (len(sims), 1))
    return np.sort(np.argpartition(-sims, t - 1, axis=1)[:, :t], axis=1)


def _cut_again(placed: DataFrame, inner: int) -> DataFrame:
    """``placed`` with every shard replaced by its members' nearest subshards.

    Centroids are fitted per shard on about 24 members for each (by hash); members are assigned in
    chunks, each with its shard's centroids beside it, so nothing of a shard meets as a whole.
    """
    member = placed.withColumn("shard", F.explode("shards"))
    sizes = written(member.groupBy("shard").agg(F.count(F.lit(1)).alias("members")), "sizes")
    member = member.join(sizes, "shard")
    drawn = F.pmod(F.xxhash64("rep", F.lit("inner")), F.col("members")) < 24 * inner

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        c = centroids(unit(pdf["vec"]), inner)
        return pd.DataFrame({"shard": pdf["shard"].iloc[0], "sub": np.arange(len(c)), "centre": list(c)})

    centres = written(member.filter(drawn).select("shard", "vec").groupBy("shard")
                      .applyInPandas(fit, "shard long, sub long, centre array<double>"), "centres")
    chunks = sizes.select("shard", F.ceil(F.col("members") / CHUNK).alias("chunks"))
    left = member.drop("members").join(chunks, "shard").withColumn(
        "chunk", F.pmod(F.xxhash64("rep", F.lit("chunk")), F.col("chunks")))
    right = centres.join(chunks, "shard").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))

    def assign(rows: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"rep": [], "inside": []})
        shard = int(rows["shard"].iloc[0])
        if not len(near):                       # no member of the shard was drawn: it stays whole
            return pd.DataFrame({"rep": rows["rep"], "inside": [[shard * (MOST_SHARDS + 1) + MOST_SHARDS]] * len(rows)})
        near = near.sort_values("sub")
        top = _nearest_rows(unit(rows["vec"]) @ np.array(near["centre"].tolist()).T, INNER)
        return pd.DataFrame({"rep": rows["rep"], "inside": list(shard * (MOST_SHARDS + 1) + top)})

    parts = left.select("shard", "chunk", "rep", "vec").groupBy("shard", "chunk").cogroup(
        right.select("shard", "chunk", "sub", "centre").groupBy("shard", "chunk")) \
        .applyInPandas(assign, "rep long, inside array<long>")
    inside = parts.groupBy("rep").agg(F.array_sort(F.flatten(F.collect_list("inside"))).alias("shards"))
    return placed.drop("shards").join(inside, "rep")


def _recall(known: DataFrame, links: DataFrame, threshold: float, n_classes: int | None = None) -> float:
    """Share of the links of a sampled class that the search has counted, averaged over classes with links."""
    def measure(classes: DataFrame, bound: int) -> tuple[int, float | None]:
        # drawn by other hashes than the sample that the shards are fitted on
        asked = bounded_sample(classes.select("rep", "vec"), "rep", bound, salt="audit").toPandas()
        truth = brute_force(known, asked["rep"].tolist(), list(asked["vec"]), threshold)
        found = F.least(F.coalesce("links", F.lit(0)), "links_true") / F.col("links_true")
        return truth.filter("links_true > 0").join(links, "rep", "left").agg(F.count(F.lit(1)), F.avg(found)).first()

    bound = AUDIT
    while True:
        n, share = measure(known, bound)
        if n >= ENOUGH or bound >= MOST_AUDIT:
            break
        bound *= 8
    if not n and bound < (known.count() if n_classes is None else n_classes):
        # links are too rare for a sample of all classes: classes that have some tell what the others of them lack
        n, share = measure(known.join(links.filter("links > 0"), "rep", "left_semi"), AUDIT)
        if not n:
            warnings.warn(f"embedding near-duplicates: no link found, and none among {bound} classes compared with all "
                          "others; recall is unmeasured")
    return share if n else 1.0


def brute_force(known: DataFrame, reps: list, vecs: list, threshold: float) -> DataFrame:
    """(rep, links_true) of the given queries, against every class, block by block."""
    state = shared(known.sparkSession, {"reps": reps, "vecs": vecs})

    def count(parts):
        by: dict[int, tuple] = {}
        for size in {len(v) for v in state.value["vecs"]}:
            at = [i for i, v in enumerate(state.value["vecs"]) if len(v) == size]
            by[size] = (np.array([state.value["reps"][i] for i in at]), unit([state.value["vecs"][i] for i in at]),
                        np.zeros(len(at), np.int64))
        for pdf in parts:
            for size, g in pdf.groupby(pdf["vec"].map(len)):
                if size in by:
                    ids, q, total = by[size]
                    s = q @ unit(g["vec"]).T >= threshold
                    s &= ids[:, None] != g["rep"].to_numpy()[None, :]
                    total += s @ g["n"].to_numpy()
        for ids, _, total in by.values():
            yield pd.DataFrame({"rep": ids, "links_true": total})

    return known.mapInPandas(count, "rep long, links_true long").groupBy("rep") \
        .agg(F.sum("links_true").alias("links_true"))
