"""MinHash retrieval and verification against exact containment of every template."""

import duckdb

from ventana.llm import licenses as L

from paths import SF01

GIVEN = (("short", "Licensed under the Example terms"), ("long", " ".join(f"term{i}" for i in range(40))),
         ("tiny", "public domain"))


def expected(con, rows):
    con.sql("CREATE OR REPLACE TABLE documents (doc_id BIGINT, text VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    return sorted(con.sql(L.oracle(GIVEN)).fetchall(), key=str)


def test_planted(spark):
    pad = " ".join(f"filler{i}" for i in range(300))
    long = GIVEN[1][1]
    rows = [(i, f"{' '.join(pad.split()[:i])} {t} {pad}") for i, t in enumerate(
        ["licensed UNDER the-example; terms.", long, long.replace("term7 ", "changed "), long.replace("term9 term10 ", ""),
         " ".join(long.split()[:30]), "licensed under some other terms"])]
    rows += [(90, None), (91, ""), (92, "public domain"), (93, "in the public domain"), (94, "!!!"), (None, long), (1, rows[1][1])]
    rows += [(95, long), (96, f"{long} x"), (97, f"x {long}"), (98, "Licensed under the example terms")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, license int")
    got = sorted((tuple(r) for r in L.scan(docs, given=GIVEN).collect()), key=str)
    assert got == expected(duckdb.connect(), rows)
    assert {r[0] for r in got} >= {0, 1, 2, 92, 95, 98}
    assert L.scan(docs.limit(0), given=GIVEN).count() == 0


def test_documents(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF01}/documents.parquet'")
    want = sorted(con.sql(L.oracle()).fetchall(), key=str)
    got = sorted((tuple(r) for r in L.scan(spark.read.parquet(f"{SF01}/documents.parquet")).collect()), key=str)
    assert got == want and len(got) > 10


def test_no_python_in_the_plan(spark):
    plan = L.scan(spark.read.parquet(f"{SF01}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_short_templates_after_many_endings(spark):
    """A template of one shingle, and one of three, at the end of 4,000 different texts."""
    tails = {"MIT": "released under the mit license", "CC-BY-NC-4.0": "licensed under cc by nc 4 0"}
    docs = spark.range(4000).selectExpr("id as doc_id", "concat_ws(' ', 'start', "
                                        "sha2(string(id), 256), 'of the', 'w' || id, 'v' || id * 7) as head")
    for name, tail in tails.items():
        got = L.scan(docs.selectExpr("doc_id", f"head || ' {tail}' as text")).collect()
        assert sorted(r.doc_id for r in got if r.license == name) == list(range(4000))


def test_scattered_shingles(spark):
    """Every shingle of a template alone between other words, in 500 texts."""
    words = GIVEN[1][1].split()
    rows = [(d, " ".join(f"{' '.join(words[i:i + 5])} x{d}x{i} y{d}y{i} z{d} u{i} q{d}" for i in range(36)))
            for d in range(500)]
    got = L.scan(spark.createDataFrame(rows, "doc_id long, text string"), given=GIVEN).collect()
    assert sorted(r.doc_id for r in got) == list(range(500)) and {r.n_found for r in got} == {36}
