"""Reply trees against walking them, escaping, and reading back."""

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ventana.llm import chat as C
from ventana.llm import queries

from paths import SF01

TREE = [  # tree, node, parent, role, text, score
    (1, 1, None, "user", "hi", 1.0), (1, 2, 1, "assistant", "a", 0.5), (1, 3, 1, "assistant", "b", 2.0),
    (1, 4, 3, "user", "more", None), (1, 5, 4, "assistant", None, 1.0), (1, 6, 3, None, "x", 9.0),
    (2, 1, 99, "system", "", 0.0), (3, 1, 2, "user", "loop", 0.0), (3, 2, 1, "user", "loop", 0.0),
    (None, 1, None, "user", "lost", 0.0), (1, 2, 1, "assistant", "a", 0.5)]
SCHEMA = "tree long, node long, parent long, role string, text string, score double"


def walk(rows):
    nodes = {(t, n): (p, r or "", x or "", s or 0.0) for t, n, p, r, x, s in rows if t is not None}
    parents = {(t, v[0]) for (t, _), v in nodes.items()}
    out = {}
    for t, n in nodes:
        if (t, n) in parents:
            continue
        path, at = [], n
        while (t, at) in nodes:
            path.append(nodes[t, at])
            at = nodes[t, at][0]
        out[t, n] = path[::-1]
    return out


def test_paths(spark):
    want = walk([r for r in TREE if r[0] != 3])
    rows = [r for r in TREE if r[0] != 3]
    got = {}
    every = C.reply_paths(spark.createDataFrame(rows, SCHEMA), score="score")
    assert {(r.tree, r.leaf, r["rank"]) for r in every.collect()} == {(*k, None) for k in want}
    for r in C.reply_paths(spark.createDataFrame(rows, SCHEMA), score="score", top=9).collect():
        got.setdefault((r.tree, r.leaf), []).append((r.depth, r.role, r.text, r.path_score, r["rank"]))
    assert set(got) == set(want)
    for k, path in got.items():
        path.sort()
        assert [(x[1], x[2]) for x in path] == [(p[1], p[2]) for p in want[k]]
        assert path[0][3] == pytest.approx(sum(p[3] for p in want[k]) / len(want[k]))
    assert {k: v[0][4] for k, v in got.items()} == {(1, 6): 1, (1, 5): 2, (1, 2): 3, (2, 1): 1}
    top = C.reply_paths(spark.createDataFrame(rows, SCHEMA), score="score", top=1)
    assert {(r.tree, r.leaf) for r in top.collect()} == {(1, 6), (2, 1)}


def test_cycles_are_refused(spark, monkeypatch):
    monkeypatch.setattr(C, "MOST_ROUNDS", 4)
    with pytest.raises(ValueError):
        C.reply_paths(spark.createDataFrame(TREE, SCHEMA))


def test_deep_chain(spark):
    rows = spark.range(300).selectExpr("1 as conv", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role",
                                       "concat('t', id) as text")
    made = C.format_paths(C.reply_paths(C.linear_parents(rows, tree="conv", order="turn"))).collect()
    assert len(made) == 1 and made[0].n_turns == 300
    assert made[0].formatted.startswith("<|im_start|>user\nt0<|im_end|>\n<|im_start|>assistant\nt1<|im_end|>\n")
    f = made[0].formatted
    assert [f[s.start:s.end] for s in made[0].loss] == [f"t{i}" for i in range(1, 300, 2)]


def test_empty(spark):
    none = C.format_paths(C.reply_paths(spark.createDataFrame([], SCHEMA)))
    assert none.count() == 0


parts = st.lists(st.sampled_from(["\\", "<", "|", "<|", "\\n", "\n", "im_end|>", "a", "é", "<|im_start|>", ">"]), max_size=12)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(parts.map("".join), parts.map("".join)), min_size=40, max_size=60))
def test_escaping_is_reversible(spark, pairs):
    rows = [(i, 0, r, x) for i, (r, x) in enumerate(pairs)]
    trees = C.linear_parents(spark.createDataFrame(rows, "conv long, turn long, role string, text string"),
                             tree="conv", order="turn")
    made = C.format_paths(trees.select("tree", F.col("node").alias("leaf"), F.lit(0.0).alias("path_score"),
                                       F.lit(1).alias("rank"), F.lit(0).alias("depth"), "role", "text"))
    got = {r.tree: r.t for r in made.select("tree", C.read_turns(F.col("formatted")).alias("t")).collect()}
    assert {i: (t[0].role, t[0].text) for i, t in got.items()} == {i: (r, x) for i, _, r, x in rows}
    assert all(len(t) == 1 for t in got.values())


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF01}/conversations.parquet'")
    rel = con.sql(queries.ORACLES["op8_chat_format"])
    out = queries.QUERIES["op8_chat_format"](spark, SF01).select(*rel.columns)
    assert sorted(map(tuple, out.collect())) == sorted(rel.fetchall())
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
