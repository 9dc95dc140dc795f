import numpy as np
import pyarrow as pa
import pytest
from odd import by_text, collected
from pyspark.sql import functions as F

from statloom.llm import topk
from statloom.llm.topk import exact_top_k


def vectors(spark, rows):
    ids, lists = zip(*rows, strict=True) if rows else ((), ())
    table = {"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(lists, pa.list_(pa.float32()))}
    table |= {c: pa.array(["clash"] * len(ids), pa.string()) for c in ("id", "v", "annulus", "score", "rank", "query_id", "norm2", "distance", "floor")}
    return spark.createDataFrame(pa.table(table))


def by_hand(rows, is_query, k):
    good = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    best = {}
    for q, a in good:
        if is_query(q):
            for i, b in good:
                if i != q:
                    score = sum(x * y for x, y in zip(a, b, strict=False))
                    best.setdefault(q, {})[i] = max(score, best.get(q, {}).get(i, score))
    out = []
    for q, found in best.items():
        for rank, (i, score) in enumerate(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
            out.append((q, rank, i, score))
    return by_text(out)


ODD = [(0, [1.0, 0.0, 0.5]), (1, None), (2, [1.0, None, 0.0]), (3, [float("nan"), 1.0, 1.0]), (4, [float("inf"), 0.0, 0.0]), (5, []), (6, [0.0, 0.0, 0.0]),
       (7, [1.0, 0.0, 0.5]), (8, [1.0, 0.0, 0.5]), (9, [1.0]), (10, [-0.3, 0.2, 0.1, 0.9]), (10, [-0.3, 0.2, 0.1, 0.9]), (None, [1.0, 1.0, 1.0]), (-4, [0.5, 0.5, 0.5]),
       (11, [0.001, -0.001, 0.0]), (12, [100.0, -20.0, 3.0])]


def test_odd_vectors(spark):
    got = exact_top_k(vectors(spark, ODD), F.col("vec_id") % 5 == 0, k=4)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert by_text(collected(got)) == by_hand(ODD, lambda i: i % 5 == 0, 4)


def test_fewer_than_k_and_none(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.25])]
    assert by_text(collected(exact_top_k(vectors(spark, rows), F.col("vec_id") == 0, k=5))) == by_hand(rows, lambda i: i == 0, 5)
    assert exact_top_k(vectors(spark, rows), F.col("vec_id") == 99).collect() == []
    assert exact_top_k(vectors(spark, rows[:1]), F.col("vec_id") == 0).collect() == []
    assert exact_top_k(vectors(spark, []), F.col("vec_id") == 0).collect() == []


@pytest.mark.parametrize("hot", [False, True])
def test_clusters_ties_and_blocks(spark, monkeypatch, hot):
    monkeypatch.setattr(topk, "BLOCK", 32)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 16))
    rows = [(i, (centres[i % 6] * (1 if i % 4 else 1.5) + 0.1 * rng.normal(size=16)).tolist()) for i in range(500)]
    if hot:  # a third of the rows are one vector
        rows = [(i, rows[0][1] if i % 3 == 1 else v) for i, v in rows]
    got = exact_top_k(vectors(spark, rows), F.col("vec_id") % 20 == 0, k=5)
    assert by_text(collected(got)) == by_hand(rows, lambda i: i % 20 == 0, 5)


def test_repeated_ids_do_not_push_others_out(spark):
    rows = [(1, [1.0, 1.0])] * 40 + [(i, [0.5, 0.01 * i]) for i in range(2, 10)] + [(0, [1.0, 1.0])]
    got = exact_top_k(vectors(spark, rows), F.col("vec_id") == 0, k=5)
    assert by_text(collected(got)) == by_hand(rows, lambda i: i == 0, 5)


def test_bounds_hold():
    rng = np.random.default_rng(2)
    rows, pivots = rng.normal(size=(300, 8)) * 50, rng.normal(size=(5, 8)) * 50
    d = topk.distances(rows, pivots)
    near = d.argmin(1)
    own = d[np.arange(300), near]
    annulus = near * topk.RINGS + (own / 20).astype(int)
    names = np.unique(annulus)
    low, high = (np.array([f(own[annulus == a]) for a in names]) for f in (np.min, np.max))
    norm2 = np.array([(rows[annulus == a] ** 2).sum(1).max() for a in names])
    queries = rng.normal(size=(40, 8)) * 60
    bound = topk.bounds(queries, pivots, names, low, high, norm2)
    for j, a in enumerate(names):
        assert ((queries @ rows[annulus == a].T).max(1) <= bound[:, j]).all()


def test_products_are_exact():
    a = np.array([[2.0**40, 3.0], [1.0, 1.0]])
    assert topk.products(a, a).astype(object)[0][1] == 2**40 + 3
    big = np.array([[2.0**30, 1.0]])
    assert int(topk.products(big, big)[0, 0]) == 2**60 + 1
