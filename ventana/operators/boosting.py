"""Boosted regression trees by second-order histograms.

Spark ML's trees know neither ``gamma`` nor ``reg_alpha`` nor a patience, and need several jobs a round. Here

* features are cut into at most ``maxBins`` bins at quantiles of one aggregation (a sketch per feature); a
  feature with fewer values is cut at each of them; nulls have a bin of their own, and every split learns
  to which side they go;
* rows become one byte per feature, written once to the shared folder;
* a tree grows level by level: gradients and row counts are added up per (node, feature, bin) in one
  job, and the best split of every node follows from those sums alone, whose number
  depends on the parameters and never on the rows;
* a split's gain is ``S(left) + S(right) - S(node)`` with ``S = soft(G)^2 / (H + lambda)`` (``soft`` takes
  ``regAlpha`` off the gradient sum); it is made if the gain is above ``gamma`` and both sides hold
  ``minChildWeight`` rows. A leaf predicts ``-stepSize * soft(G) / (H + lambda)``.

Gradients are added as integers (a fixed number of binary digits below the range of the label), and a
row is in a round's sample by a hash of its content, so a fit does not depend on how rows are
partitioned, on the order of additions or on repeated tasks: the same rows give the same trees. Only the cuts of
features with very many values do: the sketch of their quantiles depends on the partitions in which the rows reach it.

Where the training rows are no more than ``ONE_TASK_ROWS`` (a few MB of bins), levels need no exchange: one task
adds up the same sums and grows all rounds. Above it every level is a Spark job over blocks of rows: a round's sample
and gradients are made once and kept by the executors while its levels grow, and the running predictions are written every
``KEEP_ROUNDS`` rounds, so a lost executor costs its blocks' share of these. Both ways give the same trees (tested).
"""

from __future__ import annotations

import functools
import hashlib
import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import path_exists, remove_path, scratch_path

#: Training rows up to which all rounds are grown by one task (20 bytes a row and 20 features: 4 MB).
ONE_TASK_ROWS = 200_000
#: Rounds after which the running predictions are written, where levels are Spark jobs.
KEEP_ROUNDS = 10
#: Rows of a block, and of a task that keeps blocks, where levels are Spark jobs.
BLOCK_ROWS = 1 << 16
PART_ROWS = 1 << 20
#: Bytes of a level's sums that the driver adds up itself; more are added up by tasks first.
MOST_SUMS = 1 << 26
#: Bin of a missing value; the others are below.
MISSING = 255
#: Smallest gain worth a split.
LEAST_GAIN = 1e-6
#: Splits whose sides attributions keep at once (a byte a row of the batch).
MOST_SIDES = 256
#: Rows whose integer sums stay exact in doubles.
EXACT_ROWS = 1 << 18

DEFAULTS = {"maxIter": 100, "stepSize": 0.3, "maxDepth": 6, "subsamplingRate": 1.0, "gamma": 0.0, "regAlpha": 0.0,
            "regLambda": 1.0, "minChildWeight": 1.0, "maxBins": 255, "patience": None}


def settings_of(params: dict) -> dict:
    unknown = set(params) - set(DEFAULTS)
    if unknown:
        raise ValueError(f"unknown boosting parameters: {sorted(unknown)}")
    p = {**DEFAULTS, **params}
    if not 2 <= p["maxBins"] <= MISSING:
        raise ValueError("maxBins must lie between 2 and 255")
    return p


@dataclass
class Tree:
    """Nodes in the order of growth; children of node i are ``left[i]`` and ``left[i] + 1`` (-1: a leaf)."""
    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [-1])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    rows: list[int] = field(default_factory=lambda: [0])

    def add(self, splits: "Splits", g: int, h: int) -> None:
        """A new leaf with the given sums."""
        for column, start in ((self.feature, -1), (self.cut, -1), (self.missing_left, False), (self.left, -1),
                              (self.value, splits.value(g / splits.scale, h)), (self.gain, 0.0), (self.rows, h)):
            column.append(start)

    def arrays(self) -> dict[str, np.ndarray]:
        return {"feature": np.array(self.feature, np.int64), "cut": np.array(self.cut, np.int64),
                "missing_left": np.array(self.missing_left, bool), "left": np.array(self.left, np.int64),
                "value": np.array(self.value, np.float64)}


class Splits:
    """Best split of every node from sums per (node, feature, bin)."""

    def __init__(self, p: dict, n_features: int, scale: float):
        self.p, self.n_features, self.scale = p, n_features, scale

    def score(self, g, h):
        soft = np.maximum(np.abs(g) - self.p["regAlpha"], 0.0)
        return soft * soft / (h + self.p["regLambda"])

    def value(self, g: float, h: float) -> float:
        soft = math.copysign(max(abs(g) - self.p["regAlpha"], 0.0), g)
        return -self.p["stepSize"] * soft / (h + self.p["regLambda"]) if h else 0.0

    def best(self, g: np.ndarray, h: np.ndarray):
        """(gain, feature, bin, missing goes left, gradients and rows on the left) per node; ``g`` and ``h`` are
        integers (node, feature, bin)."""
        total_g, total_h = g[:, 0].sum(axis=1), h[:, 0].sum(axis=1)
        parent = self.score(total_g / self.scale, total_h)[:, None, None]
        least = max(self.p["minChildWeight"], 1)
        gl, hl = np.cumsum(g[:, :, :MISSING], axis=2), np.cumsum(h[:, :, :MISSING], axis=2)
        lost_g, lost_h = g[:, :, MISSING:], h[:, :, MISSING:]
        gains = []
        # with no missing value, both directions are the same split; the first of equal gains wins
        for lost_left in (True, False) if lost_h.any() else (True,):
            a, b = (gl + lost_g, hl + lost_h) if lost_left else (gl, hl)
            c, d = total_g[:, None, None] - a, total_h[:, None, None] - b
            gain = self.score(a / self.scale, b) + self.score(c / self.scale, d) - parent
            gains.append(np.where((b >= least) & (d >= least), gain, -np.inf))
        both = np.stack(gains, axis=3)
        ways = both.shape[3]
        both = both.reshape(len(g), -1)
        at = both.argmax(axis=1)
        each = np.arange(len(g))
        feature, cut, lost_left = at // (ways * MISSING), at // ways % MISSING, at % ways == 0
        left_g = gl[each, feature, cut] + np.where(lost_left, lost_g[each, feature, 0], 0)
        left_h = hl[each, feature, cut] + np.where(lost_left, lost_h[each, feature, 0], 0)
        # where training rows have no missing value, later ones go with the larger side
        lost_left = np.where(lost_h[each, feature, 0] > 0, lost_left, 2 * left_h >= total_h)
        return both[each, at], feature, cut, lost_left, left_g, left_h


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bins of rows: the number of cuts below a value."""
    out = np.empty(x.shape, np.uint8)
    for f, c in enumerate(cuts):
        out[:, f] = np.where(np.isnan(x[:, f]), MISSING, np.searchsorted(c, x[:, f], side="left"))
    return out


def sampled(ids: np.ndarray, rate: float, seed: int, turn: int) -> np.ndarray:
    """Rows of a round's sample: a mixed hash of row, seed and round below the rate."""
    if rate >= 1:
        return np.ones(len(ids), bool)
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03) % 2 ** 64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return z < np.uint64(int(rate * 2.0 ** 64))


def leaves(t: dict[str, np.ndarray], columns: np.ndarray) -> np.ndarray:
    """Node of every row in a tree; ``columns`` holds the bins of each feature."""
    n_nodes, n = len(t["left"]), columns.shape[1]
    depth = np.zeros(n_nodes, np.int64)
    for i in np.flatnonzero(t["left"] >= 0):                 # children come after their parents
        depth[t["left"][i]:t["left"][i] + 2] = depth[i] + 1
    # the node after each node, by the bin of its feature; a leaf is followed by itself
    bins = np.arange(MISSING + 1)
    right = np.where(bins == MISSING, ~t["missing_left"][:, None], bins > t["cut"][:, None])
    inner = t["left"] >= 0
    after = np.where(inner[:, None], t["left"][:, None] + right, np.arange(n_nodes)[:, None]).ravel()
    start = np.where(inner, t["feature"], 0) * n
    cells, row, node = columns.ravel(), np.arange(n), np.zeros(n, np.int64)
    for _ in range(depth.max()):
        node = after[node * (MISSING + 1) + cells[start[node] + row]]
    return node


def sums(columns: np.ndarray, place: np.ndarray, grad: np.ndarray, n_nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and rows per (node, feature, bin), exact; ``columns`` holds the bins of each feature, ``place`` the
    position of each row's node."""
    shape = (n_nodes, len(columns), MISSING + 1)
    g, h = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
    for a in range(0, len(place), EXACT_ROWS):
        base = place[a:a + EXACT_ROWS] * (MISSING + 1)
        weight = grad[a:a + EXACT_ROWS].astype(np.float64)
        for f in range(len(columns)):
            cell = base + columns[f, a:a + EXACT_ROWS]
            size = n_nodes * (MISSING + 1)
            g[:, f] += np.rint(np.bincount(cell, weight, size)).astype(np.int64).reshape(n_nodes, -1)
            h[:, f] += np.bincount(cell, minlength=size).reshape(n_nodes, -1)
    return g, h


def extend(tree: Tree, splits: Splits, nodes: list[int], g: np.ndarray, h: np.ndarray) -> list[tuple[int, int, int]]:
    """Splits ``nodes`` (their sums given) where it pays: (position of the node, left child, right child) of each split."""
    gain, feature, cut, lost_left, left_g, left_h = splits.best(g, h)
    pairs = []
    for i, n in enumerate(nodes):
        if not gain[i] > max(LEAST_GAIN, splits.p["gamma"]):
            continue
        tree.feature[n], tree.cut[n], tree.gain[n] = int(feature[i]), int(cut[i]), float(gain[i])
        tree.missing_left[n], tree.left[n] = bool(lost_left[i]), len(tree.left)
        pairs.append((i, tree.left[n], tree.left[n] + 1))
        whole = (int(g[i, 0].sum()), tree.rows[n])
        part = (int(left_g[i]), int(left_h[i]))
        for side in (part, (whole[0] - part[0], whole[1] - part[1])):
            tree.add(splits, *side)
    return pairs


def grow(splits: Splits, compute, first: tuple[np.ndarray, np.ndarray]) -> Tree:
    """A tree from the root's sums ``first``. ``compute(tree, nodes)`` adds up the sums of some nodes; of two siblings only
    the one with fewer rows is added up, the other is what its parent has beyond it."""
    tree, nodes, (g, h) = Tree(), [0], first
    tree.rows[0] = int(h[0, 0].sum())
    tree.value[0] = splits.value(int(g[0, 0].sum()) / splits.scale, tree.rows[0])
    for depth in range(splits.p["maxDepth"]):
        pairs = extend(tree, splits, nodes, g, h)
        if not pairs or depth + 1 == splits.p["maxDepth"]:
            break
        small = [l if tree.rows[l] <= tree.rows[r] else r for _, l, r in pairs]
        some_g, some_h = compute(tree, small)
        sides_g, sides_h = [], []
        for (i, l, _), s, a, b in zip(pairs, small, some_g, some_h):
            sides_g += [a, g[i] - a] if s == l else [g[i] - a, a]
            sides_h += [b, h[i] - b] if s == l else [h[i] - b, b]
        nodes, g, h = [c for p in pairs for c in p[1:]], np.stack(sides_g), np.stack(sides_h)
    return tree


class Stop:
    """Patience on the error of validation rows: no better round for ``patience`` rounds."""

    def __init__(self, patience: int | None):
        self.patience, self.best, self.at = patience, math.inf, -1

    def after(self, turn: int, error: float) -> bool:
        """Whether to stop after the trees of rounds 0..turn."""
        if error < self.best:
            self.best, self.at = error, turn
        return self.patience is not None and turn - self.at >= self.patience


def places(nodes: list[int], size: int) -> np.ndarray:
    out = np.full(size, -1, np.int64)
    out[nodes] = np.arange(len(nodes))
    return out


def boost_here(bins: np.ndarray, y: np.ndarray, ids: np.ndarray, held: np.ndarray, plan: dict) -> list[Tree]:
    """All rounds on rows at hand."""
    p = plan["params"]
    splits = Splits(p, bins.shape[1], plan["scale"])
    columns = np.ascontiguousarray(bins.T)
    margin = np.full(len(y), plan["base"])
    stop, trees = Stop(p["patience"] if held.any() else None), []
    own = np.flatnonzero(~held)
    every = np.arange(len(y))
    for turn in range(p["maxIter"]):
        used = own[sampled(ids[own], p["subsamplingRate"], plan["seed"], turn)]
        grad = np.rint((margin - y) * plan["scale"]).astype(np.int64)
        node = np.zeros(len(y), np.int64)

        def down(tree: Tree) -> None:
            """Every row one level further."""
            t = tree.arrays()
            live = every[t["left"][node] >= 0]
            at = node[live]
            b = columns[t["feature"][at], live]
            node[live] = t["left"][at] + np.where(b == MISSING, ~t["missing_left"][at], b > t["cut"][at])

        def compute(tree: Tree, nodes: list[int]):
            down(tree)
            at = places(nodes, len(tree.left))[node[used]]
            rows = used[at >= 0]
            return sums(columns[:, rows], at[at >= 0], grad[rows], len(nodes))

        tree = grow(splits, compute, sums(columns[:, used], np.zeros(len(used), np.int64), grad[used], 1))
        down(tree)
        margin = margin + np.array(tree.value)[node]
        trees.append(tree)
        if held.any() and stop.after(turn, float(((margin - y)[held] ** 2).sum())):
            break
    return trees[:stop.at + 1] if stop.patience is not None else trees


# --- on Spark --------------------------------------------------------------------------------------------

def _names(df_cols: Sequence[str]) -> list[str]:
    return ["`" + c.replace("`", "``") + "`" for c in df_cols]


class _Rows:
    """Rows as bins, with label, id, whether held out, and the running prediction, in the shared folder."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = scratch_path(self.spark, "boosting")
        df.write.mode("overwrite").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove_path(self.spark, self.path)


_SCHEMA = "bins binary, y double, id long, held boolean, margin double"


def _matrix(batch: pa.RecordBatch, n_features: int):
    bins = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, n_features)
    return (bins, *[batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, batch.num_columns)])


def _to_bins(rows: DataFrame, cuts: list[np.ndarray], base: float) -> DataFrame:
    n = len(cuts)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(n)]) \
                if b.num_rows else np.empty((0, n))
            raw = binned(x, cuts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.tobytes() for r in raw], pa.binary()), b.column(n), b.column(n + 1), b.column(n + 2),
                 pa.array(np.full(b.num_rows, base))], names=["bins", "y", "id", "held", "margin"])

    return rows.mapInArrow(bins, _SCHEMA)


def _grow_here(data: DataFrame, plan: dict, n_features: int) -> list[Tree]:
    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_matrix(b, n_features) for b in batches if b.num_rows]
        cols = [np.concatenate(c) for c in zip(*parts)] if parts else None
        if cols is not None:
            # the same order of rows whatever file they came from
            trees = boost_here(cols[0], cols[1], cols[2], cols[3].astype(bool), plan)
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps([vars(t) for t in trees])])], names=["trees"])

    return [Tree(**t) for t in json.loads(data.coalesce(1).mapInArrow(grow, "trees string").first().trees)]


_BLOCK = "columns binary, y binary, id binary, held binary, margin binary"
_KINDS = (np.uint8, np.float64, np.int64, np.bool_, np.float64)


def _to_blocks(rows: DataFrame, n_features: int) -> DataFrame:
    """Rows of bins put together in blocks of at most ``BLOCK_ROWS``, every column as the bytes of its array, the bins by
    feature."""
    def block(parts: list) -> pa.RecordBatch:
        bins, *others = [np.concatenate(c) for c in zip(*parts)]
        cols = [np.ascontiguousarray(bins.T), *others]
        return pa.RecordBatch.from_arrays([pa.array([c.astype(k).tobytes()], pa.binary()) for c, k in zip(cols, _KINDS)],
                                          names=["columns", "y", "id", "held", "margin"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for b in batches:
            for i in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(i, BLOCK_ROWS)
                if n + part.num_rows > BLOCK_ROWS:
                    yield block(parts)
                    parts, n = [], 0
                parts.append(_matrix(part, n_features))
                n += part.num_rows
        if n:
            yield block(parts)

    return rows.mapInArrow(blocks, _BLOCK)


def _arrays(row: Sequence, n_features: int) -> list[np.ndarray]:
    columns, *others = [np.frombuffer(x, k) for x, k in zip(row, _KINDS)]
    return [columns.reshape(n_features, -1), *others]


def _with_trees(m: np.ndarray, columns: np.ndarray, trees: list[dict[str, np.ndarray]]) -> np.ndarray:
    for t in trees:
        m = m + t["value"][leaves(t, columns)]
    return m


def _renewed(blocks: DataFrame, trees: list[dict[str, np.ndarray]], n_features: int) -> DataFrame:
    """Blocks whose running predictions hold ``trees`` too."""
    def renew(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = [_with_trees(a[4], a[0], trees).tobytes()
                    for a in (_arrays(row, n_features) for row in zip(*(c.to_pylist() for c in b.columns)))]
            yield b.set_column(4, "margin", pa.array(told, pa.binary()))

    return blocks.mapInArrow(renew, _BLOCK)


def _begin(rows: Iterator, plan: dict, later: list[dict[str, np.ndarray]], turn: int) -> Iterator:
    """(bins, gradients) of a round's rows and the error of the held-out ones, by block."""
    for columns, y, ids, held, m in rows:
        off = _with_trees(m, columns, later) - y
        used = ~held & sampled(ids, plan["params"]["subsamplingRate"], plan["seed"], turn)
        yield (np.compress(used, columns, axis=1), np.rint(off[used] * plan["scale"]).astype(np.int64),
               float((off[held] ** 2).sum()))


def _add(parts: Iterator, n_features: int, t: dict[str, np.ndarray], nodes: list[int]) -> Iterator:
    """Sums of ``nodes`` over the blocks of a task, and their errors."""
    whole = (len(nodes), n_features, MISSING + 1)
    g, h, errors = np.zeros(whole, np.int64), np.zeros(whole, np.int64), []
    for columns, grad, error in parts:
        at = places(nodes, len(t["left"]))[leaves(t, columns)]
        own = at >= 0
        more = sums(np.compress(own, columns, axis=1), at[own], grad[own], len(nodes))
        g += more[0]
        h += more[1]
        errors.append(error)
    yield g, h, errors


def _both(a: tuple, b: tuple) -> tuple:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def _grow_by_levels(data: _Rows, plan: dict, n_features: int, validated: bool, n_rows: int) -> list[Tree]:
    """A Spark job per level, over blocks that executors keep.

    A round takes its sample and its gradients once, from the written blocks and the trees since; its levels then read
    only these. What a lost executor kept is made again from the written blocks. The functions of the tasks are broadcast
    once a fit, so that a job sends its tree alone.
    """
    p, spark = plan["params"], data.spark
    splits = Splits(p, n_features, plan["scale"])
    stop, trees = Stop(p["patience"] if validated else None), []
    kept = 0                    # trees that the written margins hold
    n_parts = max(spark.sparkContext.defaultParallelism, -(-n_rows // PART_ROWS))
    blocks = _Rows(_to_blocks(data.df.repartition(n_parts), n_features))
    code = spark.sparkContext.broadcast({"read": _arrays, "begin": _begin, "add": _add, "plan": plan})

    def read():
        """The blocks as arrays, which reach Python faster than the bytes of rows."""
        return blocks.df.rdd.map(lambda row: code.value["read"](row, n_features)).persist(StorageLevel.MEMORY_AND_DISK_DESER)

    base = read()

    def begun(turn: int):
        later = [t.arrays() for t in trees[kept:]]
        return base.mapPartitions(lambda rows: code.value["begin"](rows, code.value["plan"], later, turn)) \
            .persist(StorageLevel.MEMORY_AND_DISK_DESER)

    def level(rows, tree: Tree, nodes: list[int]):
        """Sums of ``nodes``, and the errors by block."""
        t = tree.arrays()
        added = rows.mapPartitions(lambda parts: code.value["add"](parts, n_features, t, nodes))
        if added.getNumPartitions() * len(nodes) * n_features * (MISSING + 1) * 16 <= MOST_SUMS:
            return functools.reduce(_both, added.collect())
        return added.treeReduce(_both, depth=2)

    try:
        for turn in range(p["maxIter"] + 1):
            rows = begun(turn)
            try:
                g, h, errors = level(rows, Tree(), [0])
                # the first sums of a round also tell the error of the trees so far, whatever the order of blocks
                if turn > 0 and validated and stop.after(turn - 1, math.fsum(errors)):
                    return trees[:stop.at + 1]
                if turn == p["maxIter"]:
                    break
                trees.append(grow(splits, lambda t, nodes: level(rows, t, nodes)[:2], (g, h)))
            finally:
                rows.unpersist()
            if turn + 1 == p["maxIter"] and not validated:
                break
            if len(trees) - kept >= KEEP_ROUNDS:
                new = _Rows(_renewed(blocks.df, [t.arrays() for t in trees[kept:]], n_features))
                base.unpersist()
                blocks.drop()
                blocks, kept = new, len(trees)
                base = read()
    finally:
        base.unpersist()
        code.destroy()
        blocks.drop()
    return trees[:stop.at + 1] if stop.patience is not None else trees


def fit(train: DataFrame, *, features: Sequence[str], label: str, seed: int = 42, validation: DataFrame | None = None,
        one_task_rows: int = ONE_TASK_ROWS, **params) -> "Boosted":
    """Squared-error boosting on the rows of ``train`` that have a label.

    ``patience`` stops after so many rounds without a smaller error on ``validation`` and keeps the best round's
    trees; without it every fit has ``maxIter`` trees, whatever ``validation`` says.
    """
    p = settings_of(params)
    cols, y = _names(features), F.col(_names([label])[0]).cast("double")
    if validation is None or p["patience"] is None:
        validation, p["patience"] = None, None

    def rows(df: DataFrame, held: bool) -> DataFrame:
        x = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"x{i}") for i, c in enumerate(cols)]
        return df.select(*x, y.alias("y")).filter("y is not null and not isnan(y)") \
            .select("*", F.xxhash64(*[f"x{i}" for i in range(len(x))], "y").alias("id"), F.lit(held).alias("held"))

    own = rows(train, False)
    levels = [i / p["maxBins"] for i in range(1, p["maxBins"])]
    one = own.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.min("y").alias("low"), F.max("y").alias("high"),
                  *[F.percentile_approx(f"x{i}", levels, 10_000).alias(f"q{i}") for i in range(len(cols))]).first()
    n = one["n"]
    if not n:
        raise ValueError("no rows with a label to fit the model on")
    # the largest value is no cut: nothing lies above it
    cuts = [np.unique(np.array(one[f"q{i}"] or [], np.float64)) for i in range(len(cols))]
    base = float(f"{one['mean']:.12g}")
    span = max(one["high"] - base, base - one["low"])
    span = span if span > 1e-200 else 1.0             # a constant label
    digits = min(34, 61 - max(1, n).bit_length())
    scale = 2.0 ** (digits - math.ceil(math.log2(span)) - 1)       # predictions may pass the labels' range a little
    plan = {"params": p, "base": base, "scale": scale, "seed": seed}
    both = own if validation is None else own.unionByName(rows(validation, True))
    data = _Rows(_to_bins(both, cuts, base))
    try:
        n_rows = data.df.count()
        if n_rows <= one_task_rows:
            trees = _grow_here(data.df, plan, len(cols))
        else:
            trees = _grow_by_levels(data, plan, len(cols), validation is not None, n_rows)
    finally:
        data.drop()
    return Boosted(list(features), base, [c.tolist() for c in cuts], trees)


@dataclass
class Boosted:
    """A fitted model: a sum of trees; bounded by its parameters."""
    features: list[str]
    base: float
    cuts: list[list[float]]
    trees: list[Tree]

    @property
    def n_trees(self) -> int:
        return len(self.trees)

    def table(self) -> dict[str, np.ndarray]:
        """All nodes in one numbering, with thresholds in the features' own units."""
        starts = np.cumsum([0, *[len(t.left) for t in self.trees]])[:-1]
        a = {k: np.array([v for t in self.trees for v in getattr(t, k)]) for k in vars(Tree())}
        offset = np.repeat(starts, [len(t.left) for t in self.trees]) if self.trees else np.empty(0, np.int64)
        left = a["left"].astype(np.int64)
        at = [self.cuts[f][c] if f >= 0 else math.nan for f, c in zip(a["feature"].astype(int), a["cut"].astype(int))]
        return {"roots": starts.astype(np.int64), "feature": a["feature"].astype(np.int64), "at": np.array(at, np.float64),
                "missing_left": a["missing_left"].astype(bool), "left": np.where(left >= 0, left + offset, -1),
                "value": a["value"].astype(np.float64), "gain": a["gain"].astype(np.float64), "rows": a["rows"].astype(np.int64)}

    def save(self, spark: SparkSession, path: str) -> None:
        text = json.dumps({"features": self.features, "base": self.base, "cuts": self.cuts,
                           "trees": [vars(t) for t in self.trees]})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Boosted":
        m = json.loads(spark.read.text(path, wholetext=True).first().value)
        return Boosted(m["features"], m["base"], m["cuts"], [Tree(**t) for t in m["trees"]])

    def nodes(self, spark: SparkSession) -> DataFrame:
        """(tree, node, feature, threshold, missing_left, left, right, value, gain, rows): ``feature`` is null at leaves;
        rows with a value up to the threshold go left."""
        rows = []
        for i, t in enumerate(self.trees):
            for n in range(len(t.left)):
                leaf = t.left[n] < 0
                rows.append((i, n, None if leaf else self.features[t.feature[n]],
                             None if leaf else self.cuts[t.feature[n]][t.cut[n]], None if leaf else t.missing_left[n],
                             None if leaf else t.left[n], None if leaf else t.left[n] + 1, t.value[n], t.gain[n], t.rows[n]))
        return spark.createDataFrame(rows, "tree int, node int, feature string, threshold double, missing_left boolean, "
                                           "left int, right int, value double, gain double, rows long")

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """``df`` with the prediction; null inputs take each split's side for missing values."""
        state = df.sparkSession.sparkContext.broadcast({"table": self.table(), "base": self.base})

        @F.pandas_udf("double")
        def score(x: pd.DataFrame) -> pd.Series:
            return pd.Series(predicted(state.value["table"], state.value["base"], x.to_numpy(np.float64, na_value=np.nan)))

        return df.withColumn(out, score(F.struct(*[F.col(c).cast("double").alias(f"x{i}")
                                                   for i, c in enumerate(_names(self.features))])))

    def importances(self, kind: str = "gain") -> dict[str, float]:
        """Share of each feature: mean gain of its splits (``gain``), their sum (``total_gain``) or number (``weight``)."""
        t = self.table()
        inner = t["left"] >= 0
        total = np.bincount(t["feature"][inner], t["gain"][inner], len(self.features))
        count = np.bincount(t["feature"][inner], minlength=len(self.features))
        v = {"gain": total / np.maximum(count, 1), "total_gain": total, "weight": count.astype(float)}[kind]
        return dict(zip(self.features, (v / v.sum() if v.sum() else v).tolist()))


    def attribute(self, df: DataFrame, out: str = "attributions", base_out: str = "expected") -> DataFrame:
        """``df`` with the exact Shapley values of every feature (a struct by feature) and the mean prediction they
        start from; both together are the prediction. A feature that is not known follows the training rows down both
        sides of a split, in their shares."""
        state = df.sparkSession.sparkContext.broadcast({"model": self})
        n = len(self.features)

        @F.pandas_udf("array<double>")
        def shares(x: pd.DataFrame) -> pd.Series:
            s = state.value
            if "paths" not in s:                 # built once in a worker
                s["paths"] = [leaf for t in s["model"].trees for leaf in leaf_paths(t, s["model"].cuts)]
            return pd.Series(list(attributed(s["paths"], s["model"].base, n, x.to_numpy(np.float64, na_value=np.nan))))

        told = df.withColumn(out, shares(F.struct(*[F.col(c).cast("double").alias(f"x{i}")
                                                    for i, c in enumerate(_names(self.features))])))
        return told.withColumn(base_out, F.element_at(out, n + 1)).withColumn(
            out, F.struct(*[F.element_at(out, i + 1).alias(f) for i, f in enumerate(self.features)]))


@dataclass
class LeafPath:
    """The splits above a leaf by feature, with the leaf's share of every set of features that the row agrees with."""
    tests: list[tuple[int, list[tuple[float, bool, bool]]]]      # feature, (threshold, goes left, missing goes left)
    shares: np.ndarray                                            # (2^features, features): by the set that agrees
    mean: float                                                   # the leaf's part of the mean prediction


def leaf_paths(tree: Tree, cuts: list[list[float]]) -> list[LeafPath]:
    out: list[LeafPath] = []

    def down(n: int, tests: dict, rest: dict) -> None:
        if tree.left[n] < 0:
            out.append(_leaf_shares(tests, rest, tree.value[n]))
            return
        f = tree.feature[n]
        for child, left in ((tree.left[n], True), (tree.left[n] + 1, False)):
            share = tree.rows[child] / tree.rows[n] if tree.rows[n] else 0.0
            down(child, {**tests, f: [*tests.get(f, []), (cuts[f][tree.cut[n]], left, tree.missing_left[n])]},
                 {**rest, f: rest.get(f, 1.0) * share})

    down(0, {}, {})
    return out


def _leaf_shares(tests: dict, rest: dict, value: float) -> LeafPath:
    """Shapley values of the game in which a known feature lets the row reach the leaf (1) or not (0) and an unknown one
    lets its share of rows through: polynomials in the number of known features, for all sets at once."""
    features = list(tests)
    k = len(features)
    sets = (np.arange(1 << k)[:, None] >> np.arange(k)) & 1                # does the row agree with the feature's tests
    through = np.array([rest[f] for f in features])
    weight = [math.factorial(s) * math.factorial(k - 1 - s) / math.factorial(k) for s in range(k)]
    shares = np.zeros((1 << k, k))
    for i in range(k):
        poly = np.zeros((1 << k, k))                                       # by the number of other features that are known
        poly[:, 0] = 1.0
        for j in range(k):
            if j != i:
                known = np.zeros_like(poly)
                known[:, 1:] = poly[:, :-1] * sets[:, j:j + 1]
                poly = poly * through[j] + known
        shares[:, i] = value * (poly @ weight) * (sets[:, i] - through[i])
    return LeafPath([(f, tests[f]) for f in features], shares, value * float(np.prod(through)) if k else value)


def attributed(paths: list[LeafPath], base: float, n_features: int, x: np.ndarray) -> np.ndarray:
    """(rows, features + 1): contributions, and the mean prediction last."""
    out = np.zeros((n_features + 1, len(x)))
    out[-1] = base + sum(p.mean for p in paths)
    columns = np.ascontiguousarray(x.T)
    lost = np.isnan(columns)
    sides: dict[tuple[int, float, bool], np.ndarray] = {}     # rows on the left of a split; the leaves of a tree share them
    for p in paths:
        which = np.zeros(len(x), np.int64)
        for i, (f, tests) in enumerate(p.tests):
            agrees = np.ones(len(x), bool)
            for at, left, missing_left in tests:
                if (f, at, missing_left) not in sides:
                    if len(sides) >= MOST_SIDES:
                        sides.clear()
                    sides[f, at, missing_left] = np.where(lost[f], missing_left, columns[f] <= at)
                agrees &= sides[f, at, missing_left] == left
            which |= agrees.astype(np.int64) << i
        for i, (f, _) in enumerate(p.tests):
            out[f] += p.shares[:, i][which]
    return np.ascontiguousarray(out.T)


def predicted(t: dict[str, np.ndarray], base: float, x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), base)
    step = max(1, 2_000_000 // max(1, len(t["roots"])))
    for a in range(0, len(x) if len(t["roots"]) else 0, step):
        rows = x[a:a + step]
        node = np.repeat(t["roots"][None, :], len(rows), axis=0)
        line = np.arange(len(rows))[:, None]
        while True:
            left = t["left"][node]
            inner = left >= 0
            if not inner.any():
                break
            v = rows[line, np.maximum(t["feature"][node], 0)]
            right = np.where(np.isnan(v), ~t["missing_left"][node], v > t["at"][node])
            node = np.where(inner, left + right, node)
        # trees are added in their order, as they were while fitting
        for k in range(node.shape[1]):
            out[a:a + step] += t["value"][node[:, k]]
    return out


def saved_fit(train: DataFrame, folder: str, fit, settings: dict | None = None) -> Boosted:
    """The model fitted on exactly these rows with these settings, loaded from ``folder`` or fitted and saved there.

    Its path holds a digest of the rows (count and a combination of row hashes), of their columns and of
    ``settings`` (features, label, parameters), so a model is never used for others than its own.
    """
    spark = train.sparkSession
    n, mark = train.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*[F.col(c) for c in _names(train.columns)]))).first()
    if not n:
        raise ValueError("no complete feature rows to fit the model on")
    told = json.dumps([train.columns, settings or {}], sort_keys=True, default=str)
    path = f"{folder.rstrip('/')}/{n}-{mark & (2 ** 64 - 1):016x}-{hashlib.sha256(told.encode()).hexdigest()[:16]}"
    if path_exists(spark, f"{path}/_SUCCESS"):
        return Boosted.load(spark, path)
    model = fit(train)
    model.save(spark, path)
    return model
