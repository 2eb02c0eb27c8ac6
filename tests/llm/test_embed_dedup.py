"""Links and groups against brute force; split shards; odd vectors."""

import numpy as np
import pytest

from ventana.llm import embed_dedup as E


def brute(vectors, threshold=0.95):
    ids = [i for i, _ in vectors]
    x = [np.asarray(v, float) for _, v in vectors]
    near = [[j for j in range(len(x)) if j != i and len(x[i]) == len(x[j])
             and x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= threshold] for i in range(len(x))]
    label = list(range(len(x)))
    changed = True
    while changed:
        changed = False
        for i, js in enumerate(near):
            low = min([label[i], *(label[j] for j in js)])
            for k in (i, *js):
                if label[k] != low:
                    label[k], changed = low, True
    return {ids[i]: (len(near[i]), ids[label[i]]) for i in range(len(x))}


def clustered(n=700, d=16, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d))
    dense = rng.normal(size=d) * 5
    base[: n // 3] = dense + rng.normal(size=(n // 3, d)) * 0.9
    for k in range(n // 3, n // 2):
        base[k] = base[k + n // 3] + rng.normal(size=d) * 0.15
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]


@pytest.mark.parametrize("block", [2048, 60])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    monkeypatch.setattr(E, "SHARD", 200)
    rows = clustered()
    want = brute(rows)
    out = E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    got = {r.vec_id: (r.n_links, r.component_id) for r in out}
    found = sum(v[0] for v in got.values()) / sum(v[0] for v in want.values())
    assert found >= 0.99 and all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.99 * len(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)


def test_shards_cut_again(spark, monkeypatch):
    monkeypatch.setattr(E, "MOST_SHARDS", 3)
    monkeypatch.setattr(E, "SHARD", 150)
    monkeypatch.setattr(E, "LARGE", 100)
    monkeypatch.setattr(E, "CHUNK", 90)
    rows = clustered()
    want = brute(rows)
    out = E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), overlap=2).collect()
    assert sum(r.n_links for r in out) >= 0.97 * sum(v[0] for v in want.values())
    assert all(r.n_links <= want[r.vec_id][0] for r in out) and len(out) == len(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, []), (7, [nan, 1.0]),
            (8, [inf, 1.0]), (9, [None, 1.0]), (10, [1.0, 0.0, 0.0]), (11, [1e300, 1e290]), (12, [-1.0, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, rep int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df).collect()}
    assert got == {1: (3, 1, True), 2: (3, 1, False), 3: (3, 1, False), 11: (3, 1, False), 4: (0, 4, True), 5: (0, 5, True),
                   6: (0, 6, True), 7: (0, 7, True), 8: (0, 8, True), 9: (0, 9, True), 10: (0, 10, True), 12: (0, 12, True),
                   None: (0, None, False)}
    assert E.near_duplicates(df.limit(0)).count() == 0


def test_graph_and_search_find_all_close_pairs():
    x = E.unit([v for _, v in clustered(400, 24, 5)])
    adj = E.build_graph(x)
    assert adj.shape == (400, E.DEGREE) and (adj[:, 0] >= 0).all()
    starts, lists = E.both_ways([r[r >= 0] for r in adj], 400)
    hits = E.search_cell(x, starts, lists, np.array([0, 399]), 0.95)
    true = (x @ x.T >= 0.95) & ~np.eye(400, dtype=bool)
    assert not (hits & ~true).any() and hits.sum() >= 0.99 * true.sum()
    assert (E.build_graph(x[:1]) == -1).all()


def test_audit(spark):
    rows = clustered(300)
    known = spark.createDataFrame([(i, v, 1) for i, v in rows], "rep long, vec array<double>, n long")
    want = brute(rows)
    got = {r.rep: r.links_true for r in E.brute_force(known, [0, 5, 250], [rows[i][1] for i in (0, 5, 250)], 0.95).collect()}
    assert got == {i: want[i][0] for i in (0, 5, 250)}


def test_below_recall_at_the_most_overlap_compares_all(spark, monkeypatch):
    """A search that still loses links at the most overlap is replaced by all pairs, in blocks."""
    search = E._search

    def lossy(known, n_classes, threshold, overlap, exact=False):
        links, edges = search(known, n_classes, threshold, overlap, **({"exact": True} if exact else {}))
        return (links, edges) if exact else (links.filter("rep % 2 = 0"), edges.filter("a % 2 = 0"))

    monkeypatch.setattr(E, "_search", lossy)
    monkeypatch.setattr(E, "BLOCK", 60)
    rows = clustered(300) + [(900 + i, [1.0, i / 9]) for i in range(5)]
    want = brute(rows)
    out = E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), overlap=16).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in out} == want


def test_audit_weighs_classes_not_links(spark):
    """Lost pairs show beside a dense group whose links are all found."""
    rng = np.random.default_rng(4)
    dense = rng.normal(size=32) * 9 + rng.normal(size=(300, 32)) * 0.5
    pairs = np.repeat(rng.normal(size=(60, 32)), 2, axis=0) + rng.normal(size=(120, 32)) * 0.01
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([dense, pairs]))]
    known = spark.createDataFrame([(i, v, 1) for i, v in rows], "rep long, vec array<double>, n long")
    links = spark.createDataFrame([(i, n) for i, (n, _) in brute(rows).items() if i < 300], "rep long, links long")
    assert 0.6 < E._recall(known, links, 0.95) < 0.8


def test_one_id_with_several_vectors(spark):
    """Rows of one id count as the vectors they are, and groups are named by ids."""
    e1, e2, e3 = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    near = lambda v, k: [c + (0.05 * (k + 1) if c == 0 and i == (v.index(1.0) + 1) % 3 else 0) for i, c in enumerate(v)]
    rows = [(1, e1), (1, e2), (2, near(e1, 0)), (3, near(e2, 0)), (4, near(e2, 1)), (9, e3), (9, e3)]
    want = brute([(i, v) for i, (_, v) in enumerate(rows)])
    out = E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted((r.vec_id or 0, r.n_links, r.component_id) for r in out.collect())
    least = {}
    for i, (_, c) in want.items():
        if rows[i][0] is not None:
            least[c] = min(least.get(c, 99), rows[i][0])
    assert got == sorted((rows[i][0] or 0, n, least[c]) for i, (n, c) in want.items())


def test_rare_links_are_found_and_audited(spark):
    """One link among thousands of vectors that have none."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(10_000, 24))
    x[7001] = x[13] + 0.01 * rng.normal(size=24)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    out = E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert {(r.vec_id, r.n_links, r.component_id) for r in out.filter("n_links > 0").collect()} == {(13, 1, 13), (7001, 1, 13)}


def test_audit_draws_others_than_the_fit(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "rep")
    a, b = (set(r.rep for r in E.bounded_sample(ids, "rep", 1000, **k).collect()) for k in ({}, {"salt": "audit"}))
    assert len(a & b) < 0.2 * len(a)
