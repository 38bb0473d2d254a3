"""The cluster index against a search of everything."""

import random

from pyspark.sql import functions as F

from netquarry.operators import vector_index, vectors

DDL = "doc_id bigint, embedding array<float>, label int"


def clustered(rng, n, dims, centres):
    middles = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(centres)]
    return [(i, [x + rng.gauss(0, 0.05) for x in middles[i % centres]], i % 5) for i in range(n)]


def same(index, whole, query, k, where=None):
    got = vector_index.search(index, query, k, where)
    want = vectors.top_k(whole, F.array(*[F.lit(float(x)) for x in query]), k, where).collect()
    assert [(r["doc_id"], r["similarity"]) for r in got.rows.collect()] == [(r["doc_id"], r["similarity"]) for r in want]
    return got


def test_clustered_vectors_need_few_lists(spark, frame):
    rng = random.Random(4)
    rows = clustered(rng, 1200, 16, 12)
    rows += [(5000 + i, rows[3][1], 9) for i in range(30)]  # copies: ties
    rows += [(6000, None, 1), (6001, [], 1), (6002, [0.0] * 16, 1)]
    whole = frame(rows, DDL)
    index = vector_index.build(whole, lists=12, sample=600)
    assert index.rows.count() == 1230
    for at in (0, 3, 700):
        got = same(index, whole, rows[at][1], 7)
        assert 0 < len(got.lists_read) < got.lists
    plan = got.rows._jdf.queryExecution().executedPlan().toString()
    assert "_list" in plan.split("PartitionFilters")[1].split("]")[0]
    same(index, whole, rows[1][1], 40, {"label": 2})
    same(index, whole, rows[1][1], 5, {"label": 9})  # far away, and fewer lists have it
    assert same(index, whole, rows[1][1], 2000).lists_read == tuple(sorted(r["_list"] for r in index.lists.collect()))
    assert vector_index.search(index, [0.0] * 16, 3).rows.count() == 0


def test_scattered_vectors_stay_exact(frame):
    rng = random.Random(5)
    whole = frame([(i, [rng.gauss(0, 1) for _ in range(8)], 0) for i in range(400)], DDL)
    index = vector_index.build(whole, lists=8, sample=100)
    for _ in range(3):
        same(index, whole, [rng.gauss(0, 1) for _ in range(8)], 5)
