from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm.neighbours import Quantised, nearest, tile_nearest

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_force(rows, is_query, k):
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v]
    rows = [(i, v) for i, v in rows if len(v) and np.isfinite(v).all() and v.any()]
    queries = {}
    for i, v in rows:
        if is_query(i):
            queries[i] = min(queries.get(i, v.tolist()), v.tolist())
    out = []
    for q, a in queries.items():
        a = np.array(a)
        near = [(-(a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())), i) for i, b in rows if i != q and len(b) == len(a)]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(near)[:k], 1)]
    return sorted(out)


def same(found, expected):
    found = sorted(map(tuple, found))
    assert [r[:3] for r in found] == [r[:3] for r in expected]
    assert np.allclose([r[3] for r in found], [r[3] for r in expected], rtol=0, atol=1e-14)


def test_whole_table_equals_brute_force(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    expected = brute_force([(r["vec_id"], r["embedding"]) for r in vectors.collect()], lambda i: i % 50 == 0, 5)
    same(nearest(vectors, F.col("vec_id") % 50 == 0).collect(), expected)
    # many small tiles and more than one round of merging
    same(nearest(vectors, F.col("vec_id") % 50 == 0, query_block=4, candidate_block=12).collect(), expected)


def test_bounds_hold_for_hard_vectors():
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(400, 16)) * np.exp(rng.normal(0, 6, (400, 16)))  # components of very different size
    rows[:40] = rows[0] * rng.choice([1.0, 2.0, 4.0], 40)[:, None]
    ids = np.arange(400)
    found = list(tile_nearest(ids[:50], Quantised(rows[:50]), ids, Quantised(rows), 7))
    same(found, brute_force([(i, rows[i].tolist()) for i in range(400)], lambda i: i < 50, 7))


def test_ties_nulls_and_a_frequent_vector(spark, crowded):
    common = [1.0, 2.0, 2.0]
    rows = [(i, common) for i in range(100, 140)] + [
        (1, [2.0, 4.0, 4.0]), (2, None), (3, []), (4, [0.0, 0.0, 0.0]), (5, [1.0, None, 1.0]), (6, [float("nan"), 1.0, 1.0]),
        (7, [float("inf"), 1.0, 1.0]), (None, common), (8, [1.0, 1.0]), (9, [1.0, 0.0, 0.0]), (9, [0.0, 1.0, 0.0]), (10, [-1.0, -2.0, -2.0]),
        (11, [1.0, 2.0]), (12, [3e38, 3e38, 3e38]),
    ]
    frame = crowded(spark.createDataFrame([(*r, None) for r in rows], SCHEMA))
    got = nearest(frame, F.lit(True), k=6, query_block=16, candidate_block=16).collect()
    same(got, brute_force(rows, lambda i: True, 6))
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 139] == [1, 100, 101, 102, 103, 104]


def test_largest_and_smallest_doubles(spark):
    rows = [(1, [1.7e308, -1.7e308]), (2, [5e-324, 0.0]), (3, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in nearest(frame, F.lit(True)).collect()}
    assert abs(got[1, 2] - 0.5**0.5) < 1e-15 and abs(got[2, 3] - 0.5**0.5) < 1e-15 and abs(got[1, 3]) < 1e-15


def test_fewer_candidates_than_asked_and_empty_tables(spark):
    two = spark.createDataFrame([(0, [1.0], 1), (1, [2.0], 1)], SCHEMA)
    assert [tuple(r) for r in nearest(two, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 1.0)]
    assert nearest(two, F.col("vec_id") == 5).count() == 0
    assert nearest(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
