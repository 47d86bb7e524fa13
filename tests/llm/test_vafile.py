import duckdb
import numpy as np
import pandas as pd

from tallybridge.llm import vafile


def brute(rows, k=10):
    good = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, x in good:
        if q % 100 == 0:
            scores = sorted({(-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in good if i != q and len(y) == len(x)})[:k]
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)}
    return out


def test_against_brute_force_and_sql(spark):
    path = "/root/testdata/sf0.01/embeddings.parquet"
    df = spark.read.parquet(path)
    got = {tuple(r) for r in vafile.neighbours(df).collect()}
    assert got == brute([(r.vec_id, r.embedding) for r in df.collect()])
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
    assert set(con.sql(vafile.SQL).fetchall()) == got


def test_odd_rows(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, rnd.normal(size=3).tolist()) for i in range(1, 240)] + [(i, [0.5, 0.25, -0.5]) for i in range(300, 420)]
    rows += [(0, [0.0, 0.0, 0.0]), (600, None), (700, [1.0, None, 2.0]), (800, [float("nan"), 1.0, 1.0]), (900, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (1000, [3.0]), (1001, [4.0]), (100, rows[99][1]), (1100, [1e7, -1e7, 1e7]), (1200, []), (1201, []), (1202, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    vectors = vafile.quantised(df)
    got = [tuple(r) for r in vafile.top_k(vectors, vectors.filter("vec_id % 100 = 0"), shard_rows=50, query_rows=3).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert vafile.neighbours(df.filter("false")).count() == 0


def test_huge_components(spark):
    rows = [(100, [1e15, 1.0]), (1, [1e15, 0.0]), (2, [1e300, -1e300]), (3, [-1e15, 0.0]), (4, [0.0, 0.5]), (5, [1e15, 0.0])]
    got = [(r.rank, r.vec_id, r.score) for r in vafile.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()]
    top = (1 << 63) - 1
    assert got == [(1, 1, top), (2, 2, top), (3, 5, top), (4, 4, 512 * 1024), (5, 3, -top - 1)]


def test_bounds_hold():
    rnd = np.random.default_rng(7)
    for scale in (3, 10_000, 1 << 40):
        shard = vafile.packing(pd.DataFrame({"vec_id": range(300), "v": list(rnd.integers(-scale, scale, (300, 20)))})).iloc[0]
        vectors = np.frombuffer(shard.exact, np.int64).reshape(-1, 20)
        queries = rnd.integers(-scale, scale, (9, 20))
        lower, upper = vafile.bounds(queries.astype(float), np.frombuffer(shard.cells, np.uint8).reshape(-1, 20), np.array(shard.low), np.array(shard.width), scale < 1 << 20)
        exact = (queries.astype(object) @ vectors.T.astype(object)).astype(float)
        assert (lower <= exact).all() and (exact <= upper).all()
        assert (upper - lower).max() < 0.2 * (exact.max() - exact.min())
