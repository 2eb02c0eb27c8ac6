"""Isolation forest (M9), after Liu, Ting and Zhou (2008).

Spark has no isolation forest, so it is built from DataFrame steps:

1. **Sample** (bounded, no driver round trip of rows): every tree draws from
   all complete rows. A row takes part in each tree independently with a
   probability of about 1.5 x psi / n, by seeded hashes of its key: one hash
   says in how many trees (inverse binomial), a second one in which, so a row
   that is in no tree costs one hash. Each tree then keeps the ``psi`` of its
   rows with the smallest hash of (seed, tree, key) -- without replacement
   inside a tree, independently across trees. The rows that move on are about
   1.5 x trees x psi, whatever the table size.
2. **Grow**: ``groupBy(tree).applyInPandas`` grows one tree per group with
   NumPy (random feature, uniform split between the node's min and max,
   depth limit ceil(log2 psi)). Each tree is a few hundred nodes.
3. **Score**: the forest (trees x nodes numbers) is broadcast once; an
   Arrow-batched ``pandas_udf`` walks all trees for a batch of rows at once:
   score = 2 ** (-mean path length / c(psi)). Rows with a missing feature get
   no score (and flag 0, rule J4: no join needed).
4. **Flag**: rows whose score is above the exact (1 - contamination) quantile
   of the scores of complete rows. The scored rows are written once to the
   shared folder; cut and flags are taken from there, so Python runs once.

Scores are not bit-equal to other implementations (different random
streams); the share flagged and the ranking of clear outliers are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as V
from ..functions.exprs import flag_to_int
from ..session import scratch_path
from .stats import exact_quantiles

TREE_SCHEMA = ("tree int, feature array<int>, threshold array<double>, left array<int>, "
               "right array<int>, size array<int>")


def c_factor(n):
    """Average path length of an unsuccessful search in a BST of n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[n == 2] = 1.0
    h = np.log(n[big] - 1.0) + 0.5772156649015329
    out[big] = 2.0 * h - 2.0 * (n[big] - 1.0) / n[big]
    return out


def _grow(x: np.ndarray, rng: np.random.Generator, max_depth: int):
    feature, threshold, left, right, size = [], [], [], [], []

    def new_node():
        feature.append(-1)
        threshold.append(0.0)
        left.append(-1)
        right.append(-1)
        size.append(0)
        return len(feature) - 1

    root = new_node()
    stack = [(root, np.arange(len(x)), 0)]
    while stack:
        node, idx, depth = stack.pop()
        size[node] = len(idx)
        if depth >= max_depth or len(idx) <= 1:
            continue
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if usable.size == 0:
            continue
        f = int(rng.choice(usable))
        t = float(rng.uniform(lo[f], hi[f]))
        go_left = sub[:, f] < t
        ln, rn = new_node(), new_node()
        feature[node], threshold[node], left[node], right[node] = f, t, ln, rn
        stack.append((ln, idx[go_left], depth + 1))
        stack.append((rn, idx[~go_left], depth + 1))
    return feature, threshold, left, right, size


def _tree_builder(features: Sequence[str], psi: int, seed: int):
    max_depth = int(math.ceil(math.log2(max(psi, 2))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf[list(features)].to_numpy(dtype=float)
        rng = np.random.default_rng([seed, tree])
        f, t, lft, rgt, sz = _grow(x, rng, max_depth)
        return pd.DataFrame({"tree": [tree], "feature": [f], "threshold": [t], "left": [lft],
                             "right": [rgt], "size": [sz]})
    return build


def _unit_hash(*cols) -> F.Column:
    """Seeded hash mapped to [0, 1)."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 62)).cast("double") / float(1 << 62)


def _trees_of_row(rate: float, n_trees: int, seed: int, keys: Sequence[F.Column]) -> F.Column:
    """The trees a row takes part in: each of ``n_trees`` independently with probability ``rate``.

    The number of trees k is drawn by the row's hash from the binomial distribution (its cumulative
    sums are a few literals); the k trees with the smallest hashes of (tree, key) are a uniform
    choice of k trees.
    """
    ids = F.sequence(F.lit(0), F.lit(n_trees - 1))
    if rate >= 1.0:
        return ids
    below, total = [], 0.0
    for k in range(n_trees):
        total += math.comb(n_trees, k) * rate ** k * (1 - rate) ** (n_trees - k)
        below.append(total)
        if total > 1 - 1e-15:
            break
    u = _unit_hash(F.lit(seed), F.lit("trees"), *keys)
    k = sum((F.when(u >= c, 1).otherwise(0) for c in below), F.lit(0))
    order = F.array_sort(F.transform(ids, lambda t: F.struct(
        F.xxhash64(F.lit(seed + 1), t, *keys).alias("h"), t.alias("t"))))
    chosen = F.transform(F.slice(order, F.lit(1), k), lambda x: x["t"])
    return F.when(u < below[0], F.array().cast("array<int>")).otherwise(chosen)


class IsolationForestModel:
    def __init__(self, trees: list, features: Sequence[str], psi: int):
        self.trees = [(np.asarray(f, dtype=np.int64), np.asarray(t, dtype=float),
                       np.asarray(lf, dtype=np.int64), np.asarray(rt, dtype=np.int64),
                       np.asarray(sz, dtype=float)) for f, t, lf, rt, sz in trees]
        self.features = list(features)
        self.psi = psi
        self._heap = None

    def _layout(self) -> tuple[int, list]:
        """(depth, per tree: feature, threshold, path length) in heap order.

        Every tree is filled up to the same depth: below a leaf, rows go left (no threshold is
        reached) and find the leaf's path length, so all rows take the same number of steps.
        """
        if self._heap is None:
            deep, placed = 0, []
            for feat, thr, left, right, size in self.trees:
                at, stack = {}, [(0, 0, 0)]
                while stack:
                    node, pos, depth = stack.pop()
                    at[pos] = (node, depth)
                    deep = max(deep, depth)
                    if feat[node] >= 0:
                        stack += [(left[node], 2 * pos + 1, depth + 1), (right[node], 2 * pos + 2, depth + 1)]
                placed.append(at)
            out = []
            for at, (feat, thr, left, right, size) in zip(placed, self.trees):
                n = 2 ** (deep + 1) - 1
                f, t, length = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros(n)
                for pos in range(n):
                    if pos in at:
                        node, depth = at[pos]
                        if feat[node] >= 0:
                            f[pos], t[pos] = feat[node], thr[node]
                        else:
                            length[pos] = depth + c_factor([size[node]])[0]
                    else:
                        length[pos] = length[(pos - 1) // 2]
                out.append((f, t, length))
            self._heap = (deep, out)
        return self._heap

    def path_lengths(self, x: np.ndarray, chunk: int = 4096) -> np.ndarray:
        """Mean path length over the forest for each row of x (vectorised over rows)."""
        deep, trees = self._layout()
        total = np.zeros(len(x))
        for a in range(0, len(x), chunk):
            part = x[a:a + chunk]
            flat, n = np.ascontiguousarray(part.T).ravel(), len(part)
            rows = np.arange(n)
            for f, t, length in trees:
                node = np.zeros(n, np.int64)
                for _ in range(deep):
                    right = flat.take(f.take(node) * n + rows) >= t.take(node)
                    node = 2 * node + 1 + right
                total[a:a + n] += length.take(node)
        return total / max(len(self.trees), 1)

    def score_column(self, spark) -> F.Column:
        """Arrow-batched scorer over the feature columns (NULL if incomplete)."""
        bc = spark.sparkContext.broadcast((self.trees, self.features, self.psi, {}))

        @F.pandas_udf(T.DoubleType())
        def score(*cols: pd.Series) -> pd.Series:
            trees, feats, psi, own = bc.value       # a worker lays the forest out once
            x = np.column_stack([c.to_numpy(dtype=float, na_value=np.nan) for c in cols])
            ok = ~np.isnan(x).any(axis=1)
            out = np.full(len(x), np.nan)
            if ok.any():
                if "model" not in own:
                    own["model"] = IsolationForestModel(trees, feats, psi)
                plen = own["model"].path_lengths(x[ok])
                out[ok] = np.power(2.0, -plen / float(c_factor([psi])[0]))
            return pd.Series(out)

        return score(*[F.col(c).cast("double") for c in self.features])


def fit(df: DataFrame, features: Sequence[str], key_cols: Sequence[str], *,
        n_trees: int = V.IFOREST_TREES, sample_size: int = V.IFOREST_SAMPLE,
        seed: int = V.IFOREST_SEED, oversample: float = 1.5) -> IsolationForestModel:
    """Grow the forest from a bounded, seeded sample of complete rows."""
    complete = df
    for c in features:
        complete = complete.filter(F.col(c).isNotNull())
    n = complete.count()
    psi = int(min(sample_size, max(n, 1)))
    keys = [F.col(k) for k in key_cols]
    pre = complete.select(*key_cols, *[F.col(c).cast("double").alias(c) for c in features])
    per_tree = pre.select("*", F.explode(_trees_of_row(
        min(1.0, psi * oversample / max(n, 1)), n_trees, seed, keys)).alias("tree"))
    w = Window.partitionBy("tree").orderBy(F.xxhash64(F.lit(seed), F.col("tree"), *keys), *key_cols)
    chosen = per_tree.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= psi)
    grown = chosen.select("tree", *features).groupBy("tree").applyInPandas(
        _tree_builder(features, psi, seed), TREE_SCHEMA)
    trees = []
    for r in grown.orderBy("tree").collect():   # n_trees small rows (model parameters)
        trees.append((r["feature"], r["threshold"], r["left"], r["right"], r["size"]))
    return IsolationForestModel(trees, features, psi)


def anomalies(df: DataFrame, features: Sequence[str], key_cols: Sequence[str], *,
              contamination: float = V.IFOREST_CONTAMINATION, n_trees: int = V.IFOREST_TREES,
              sample_size: int = V.IFOREST_SAMPLE, seed: int = V.IFOREST_SEED,
              model: IsolationForestModel | None = None) -> DataFrame:
    """M9 (+J4, P13): anomaly score and 0/1 flag on every row.

    The flag marks the complete rows whose score is above the exact
    (1 - ``contamination``) quantile; incomplete rows get flag 0.
    """
    model = model or fit(df, features, key_cols, n_trees=n_trees, sample_size=sample_size,
                         seed=seed)
    spark = df.sparkSession
    path = scratch_path(spark, "scores")
    df.withColumn("anomaly_score", model.score_column(spark)).write.mode("overwrite").parquet(path)
    scored = spark.read.parquet(path)
    cut = exact_quantiles(scored, "anomaly_score", [1.0 - contamination]).first()
    cut = None if cut is None else cut["q0"]
    above = F.lit(False) if cut is None else F.col("anomaly_score") > F.lit(cut)
    return scored.withColumn("anomaly", flag_to_int(above))
