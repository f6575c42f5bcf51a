import numpy as np
from pyspark.sql import functions as F

from scriptmill.llm import neighbours as N


def test_multi_index_finds_all_within_radius():
    codes = np.random.default_rng(1).integers(0, 2**63, 500, dtype=np.uint64) & np.uint64(0xFFFF0000FFFF)
    index = N.MultiIndex(codes, 48)
    for radius in (0, 5, 11, 20, 48):
        want = np.flatnonzero(np.bitwise_count(codes ^ codes[7]) <= radius)
        assert index.within(codes[7], radius).tolist() == want.tolist()


def brute(rows, queries, k):
    out = []
    for q in queries:
        v = np.array(rows[q], float)
        far = sorted((float(np.sqrt(((np.array(x, float) - v) ** 2).sum())), i) for i, x in rows.items() if i != q)
        out += [(q, rank + 1, i) for rank, (_, i) in enumerate(far[:k])]
    return out


def test_recall_on_the_table(small):
    df = small("embeddings")
    rows = {r.vec_id: r.embedding for r in df.collect()}
    want = set(brute(rows, [i for i in rows if i % 100 == 0], 10))
    want = {(q, i) for q, _, i in want}
    got = {(r.query_id, r.vec_id) for r in N.nearest(df, F.col("vec_id") % 100 == 0).collect()}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_edge_rows_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [3.0, 0.0]), (4, [0.0, 0.0]), (5, None),
            (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 1.0]), (9, [1.0]), (10, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, id string")
    got = sorted(tuple(r) for r in N.nearest(df, F.col("vec_id").isin(0, 5, 6)).collect())
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 3, 2.0)]
    assert N.nearest(df.where("false"), F.lit(True)).count() == 0
    assert N.nearest(df, F.lit(False)).count() == 0


def test_blocks_agree(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = {i: rng.normal(size=8).tolist() for i in range(300)}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    monkeypatch.setattr(N, "BLOCK_ROWS", 60)
    monkeypatch.setattr(N, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(N, "WITHIN", 1.0)
    got = {(r.query_id, r.vec_id) for r in N.nearest(df, F.col("vec_id") % 10 == 0).collect()}
    want = {(q, i) for q, _, i in brute(rows, range(0, 300, 10), 10)}
    assert len(got) == len(want) and len(got & want) >= 0.97 * len(want)
