"""Boosted trees: splits by brute force, both ways of growing, patience, penalties, missing values."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ventana.operators import boosting as B


def _frame(spark, n=240, seed=0, missing=0.0):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"a": rng.integers(0, 40, n).astype(float), "b": rng.normal(size=n).round(1),
                        "c": rng.integers(0, 7, n).astype(float)})
    pdf["y"] = np.sin(pdf.a / 5) * 3 + (pdf.b > 0.3) * 2 + 0.1 * rng.normal(size=n)
    if missing:
        for c in "ab":
            pdf.loc[rng.random(n) < missing, c] = np.nan
    return pdf, spark.createDataFrame(pdf).repartition(4)


def _brute(x, g, p):
    """Best (gain, feature, threshold, missing left) over all thresholds of all features."""
    def score(gs, h):
        return max(abs(gs) - p["regAlpha"], 0) ** 2 / (h + p["regLambda"])
    best = (0.0, None, None, None)
    for f in range(x.shape[1]):
        v, lost = x[:, f], np.isnan(x[:, f])
        for t in np.unique(v[~lost]):
            for lost_left in ((True, False) if lost.any() else (False,)):
                left = (v <= t) | (lost & lost_left)
                hl, hr = left.sum(), (~left).sum()
                if min(hl, hr) < max(1, p["minChildWeight"]):
                    continue
                gain = score(g[left].sum(), hl) + score(g[~left].sum(), hr) - score(g.sum(), len(g))
                if gain > best[0] * (1 + 1e-9) + 1e-9:
                    best = (gain, f, t, lost_left)
    return best


@pytest.mark.parametrize("params", [{}, {"regAlpha": 2.0}, {"minChildWeight": 40}, {"regLambda": 10.0}])
@pytest.mark.parametrize("missing", [0.0, 0.2])
def test_every_split_is_the_best_of_all(spark, params, missing):
    pdf, df = _frame(spark, missing=missing)
    features = ["a", "b", "c"]
    m = B.fit(df, features=features, label="y", maxIter=1, maxDepth=3, stepSize=1.0, **params)
    p = B.settings_of(params)
    x, y = pdf[features].to_numpy(float), pdf["y"].to_numpy()
    t = m.trees[0]
    rows = {0: np.arange(len(y))}
    inner = 0
    for n in range(len(t.left)):
        own = rows[n]
        g = m.base - y[own]
        assert t.rows[n] == len(own)
        soft = math.copysign(max(abs(g.sum()) - p["regAlpha"], 0), g.sum())
        assert math.isclose(t.value[n], -soft / (len(own) + p["regLambda"]), rel_tol=1e-6, abs_tol=1e-7)
        if t.left[n] < 0:
            continue
        inner += 1
        f, at = t.feature[n], m.cuts[t.feature[n]][t.cut[n]]
        gain, *_ = _brute(x[own], g, p)
        assert math.isclose(t.gain[n], gain, rel_tol=1e-5)
        v = x[own, f]
        left = (v <= at) | (np.isnan(v) & t.missing_left[n])
        rows[t.left[n]], rows[t.left[n] + 1] = own[left], own[~left]
    assert inner >= 3


def test_gamma_asks_for_more_gain(spark):
    _, df = _frame(spark)
    sizes = []
    for gamma in (0.0, 5.0, 50.0, 1e9):
        m = B.fit(df, features=["a", "b"], label="y", maxIter=1, maxDepth=4, gamma=gamma)
        assert all(g > gamma for t in m.trees for g, l in zip(t.gain, t.left) if l >= 0)
        sizes.append(len(m.trees[0].left))
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] == 1


def test_levels_on_spark_grow_the_same_trees(spark, monkeypatch):
    """However rows are partitioned, and whichever way the levels are added up."""
    monkeypatch.setattr(B, "KEEP_ROUNDS", 2)
    _, df = _frame(spark, missing=0.1)
    held = df.filter("c = 3")
    own = df.filter("c <> 3")
    args = dict(features=["a", "b", "c"], label="y", maxIter=5, maxDepth=3, subsamplingRate=0.7, patience=20)
    here = B.fit(own, validation=held, **args)
    spread = B.fit(own.repartition(7, "b"), validation=held, one_task_rows=0, **args)
    assert here.trees == spread.trees and here.cuts == spread.cuts
    monkeypatch.setattr(B, "EXACT_ROWS", 64)
    assert B.fit(own.coalesce(1), validation=held, **args).trees == here.trees
    # without validation the last round needs no further sums
    free = dict(features=["a", "b"], label="y", maxIter=2, maxDepth=2)
    assert B.fit(own, **free).trees == B.fit(own, one_task_rows=0, **free).trees


def test_all_rounds_unless_patience_is_asked_for(spark):
    _, df = _frame(spark, n=120)
    train, test = df.filter("c < 5"), df.filter("c >= 5")
    args = dict(features=["a", "b"], label="y", maxIter=150, maxDepth=5, stepSize=0.3)
    assert B.fit(train, **args).n_trees == 150
    assert B.fit(train, validation=test, **args).n_trees == 150       # seen, but not asked
    short = B.fit(train, validation=test, patience=5, **args)
    assert 1 <= short.n_trees < 150
    few = {**args, "maxIter": 6, "patience": 2, "maxDepth": 2}
    assert B.fit(train, validation=test, one_task_rows=0, **few).trees == B.fit(train, validation=test, **few).trees
    # the kept number of trees has the least error of those tried
    longer = B.fit(train, **{**args, "maxIter": short.n_trees + 5})
    assert longer.trees[:short.n_trees] == short.trees
    errors = [B.Boosted(short.features, short.base, short.cuts, longer.trees[:k]).predict(test)
              .agg(F.sum((F.col("prediction") - F.col("y")) ** 2)).first()[0] for k in range(1, longer.n_trees + 1)]
    assert int(np.argmin(errors)) + 1 == short.n_trees


def test_prediction_walks_the_trees(spark):
    pdf, df = _frame(spark, missing=0.2)
    m = B.fit(df, features=["a", "b"], label="y", maxIter=8, maxDepth=3)
    nodes = {(r.tree, r.node): r for r in m.nodes(spark).collect()}

    def walk(row):
        total = m.base
        for t in range(m.n_trees):
            n = nodes[t, 0]
            while n.feature is not None:
                v = row[n.feature]
                lost = v is None or math.isnan(v)
                n = nodes[t, n.left if (n.missing_left if lost else v <= n.threshold) else n.right]
            total += n.value
        return total

    got = m.predict(df).collect()
    assert len(got) == len(pdf)
    for r in got[::7]:
        assert math.isclose(r.prediction, walk(r.asDict()), rel_tol=1e-12, abs_tol=1e-12)
    assert m.predict(df.limit(0)).collect() == []


def test_importances(spark):
    _, df = _frame(spark)
    m = B.fit(df, features=["a", "b", "c"], label="y", maxIter=20, maxDepth=3)
    nodes = m.nodes(spark).filter("feature is not null").groupBy("feature").agg(F.avg("gain").alias("g"), F.count("*").alias("n"))
    rows = {r.feature: r for r in nodes.collect()}
    for kind, value in (("gain", lambda r: r.g), ("weight", lambda r: r.n), ("total_gain", lambda r: r.g * r.n)):
        want = {f: value(r) / sum(map(value, rows.values())) for f, r in rows.items()}
        assert all(math.isclose(m.importances(kind)[f], w, rel_tol=1e-9) for f, w in want.items())
    assert m.importances()["a"] > m.importances()["c"]


def test_odd_rows(spark):
    schema = "`a.b` double, x double, y double"
    df = spark.createDataFrame([(1.0, None, 2.0), (2.0, None, None), (3.0, None, float("nan")), (1.0, None, 2.0)], schema)
    m = B.fit(df, features=["a.b", "x"], label="y", maxIter=3)
    assert [r.prediction for r in m.predict(df).collect()] == [2.0] * 4      # constant label, an empty feature
    assert m.n_trees == 3 and all(len(t.left) == 1 for t in m.trees)
    with pytest.raises(ValueError):
        B.fit(df.limit(0), features=["x"], label="y")
    with pytest.raises(ValueError):
        B.fit(df, features=["x"], label="y", maxDeep=3)


def test_attributions_are_shapley_values(spark):
    """Against the definition: every set of known features, each unknown one following the training rows."""
    from itertools import combinations
    pdf, df = _frame(spark, missing=0.1)
    features = ["a", "b", "c"]
    m = B.fit(df, features=features, label="y", maxIter=4, maxDepth=3)

    def value(row, known, t, n=0):
        if t.left[n] < 0:
            return t.value[n]
        f, sides = t.feature[n], (t.left[n], t.left[n] + 1)
        if f in known:
            v = row[f]
            left = t.missing_left[n] if math.isnan(v) else v <= m.cuts[f][t.cut[n]]
            return value(row, known, t, sides[0] if left else sides[1])
        return sum(t.rows[c] / t.rows[n] * value(row, known, t, c) for c in sides)

    got = m.attribute(m.predict(df)).collect()
    assert len(got) == len(pdf)
    for r in got[::23]:
        row = [math.nan if r[f] is None else r[f] for f in features]
        total = {s: m.base + sum(value(row, s, t) for t in m.trees)
                 for k in range(4) for s in map(frozenset, combinations(range(3), k))}
        for i, f in enumerate(features):
            want = sum(math.factorial(len(s)) * math.factorial(2 - len(s)) / 6 * (total[s | {i}] - total[s])
                       for s in total if i not in s)
            assert math.isclose(r.attributions[f], want, rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r.expected, total[frozenset()], rel_tol=1e-9)
        assert math.isclose(r.expected + sum(r.attributions), r.prediction, rel_tol=1e-9)
    assert m.attribute(df.limit(0)).collect() == []


def test_a_level_is_one_job_of_one_stage(spark):
    """A round costs a job without a shuffle for each level, and reads no tree of earlier rounds in its levels."""
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame(pd.DataFrame({"a": rng.normal(size=400), "b": rng.normal(size=400), "y": rng.normal(size=400)}))
    stages = {}
    for rounds in (2, 6):
        spark.sparkContext.setJobGroup(f"rounds-{rounds}", "boosting")
        try:
            B.fit(rows, features=["a", "b"], label="y", one_task_rows=0, maxIter=rounds, maxDepth=3)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        tracker = spark.sparkContext.statusTracker()
        stages[rounds] = sum(len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup(f"rounds-{rounds}"))
    assert stages[6] - stages[2] <= 4 * 3


def test_leaves_follow_every_row():
    """Nodes of whole columns at once, against one row after the other."""
    rng = np.random.default_rng(4)
    tree = {"feature": np.array([1, -1, 0, -1, -1]), "cut": np.array([7, -1, 3, -1, -1]), "left": np.array([1, -1, 3, -1, -1]),
            "missing_left": np.array([False, False, True, False, False]), "value": np.zeros(5)}
    columns = rng.integers(0, 12, (2, 500)).astype(np.uint8)
    columns[rng.random(columns.shape) < 0.2] = B.MISSING
    want = []
    for row in columns.T:
        n = 0
        while tree["left"][n] >= 0:
            b = row[tree["feature"][n]]
            right = not tree["missing_left"][n] if b == B.MISSING else b > tree["cut"][n]
            n = tree["left"][n] + int(right)
        want.append(n)
    assert B.leaves(tree, columns).tolist() == want
    root = {k: v[1:2] for k, v in tree.items()}
    assert not B.leaves(root, columns).any() and B.leaves(root, columns[:, :0]).shape == (0,)


@pytest.mark.parametrize("most", [1, 256])
def test_leaves_share_the_sides_of_a_split(spark, monkeypatch, most):
    """a split is compared with the rows once for all leaves below it; fewer kept sides give the same values."""
    df = spark.range(400).selectExpr("id % 20 as a", "id % 7 as b", "double(id % 20 * (id % 7)) as y")
    m = B.fit(df, features=["a", "b"], label="y", maxIter=4, maxDepth=4)
    paths = [p for t in m.trees for p in B.leaf_paths(t, m.cuts)]
    x = np.array([[i % 20, i % 7] for i in range(400)], float)
    x[::9, 0] = np.nan
    monkeypatch.setattr(B, "MOST_SIDES", most)
    got = B.attributed(paths, m.base, 2, x)
    assert np.allclose(got.sum(axis=1), B.predicted(m.table(), m.base, x))
