import hashlib

import numpy as np
import pyarrow as pa
import pytest
from odd import by_text, collected

from statloom.llm import ptolemy
from statloom.llm.ptolemy import ptolemaic_clusters

COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def vectors(spark, rows, kind=None):
    ids, lists = zip(*rows, strict=True) if rows else ((), ())
    table = {"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(lists, pa.list_(kind or pa.float32()))}
    table |= {c: pa.array(["clash"] * len(ids), pa.string()) for c in ("id", "v", "near", "cluster", "distance", "inertia", "number", "place", "limb")}
    return spark.createDataFrame(pa.table(table))


def by_hand(rows, k, rounds, width, single=True, seed=3):
    """Lloyd's rounds with Python's whole numbers."""
    good = []
    for i, v in rows:
        if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v):
            scaled = [float(np.float32(x) if single else x) * 1024 for x in v]
            if all(np.isfinite(scaled)):
                good.append((i, [int(np.floor(x)) if abs(x) < 2**60 else int(x) for x in scaled]))

    def order(row):
        return (row[0] is None, hashlib.sha256(f"{seed}:{row[0]}".encode()).hexdigest(), row[1])

    cents = [v for _, v in sorted(good, key=order)[:k]]

    def assign():
        out = []
        for _, v in good:
            out.append(min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents)))
        return out

    for _ in range(rounds):
        who = assign()
        for j in range(len(cents)):
            own = [v for (_, v), (_, c) in zip(good, who, strict=True) if c == j]
            if own:
                cents[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    who = assign()
    fits = lambda x: x if x is not None and x < 2**63 else None
    sums = {}
    for d, c in who:
        sums.setdefault(c, []).append(d)
    sums = {c: None if any(x >= 2**63 for x in d) else sum(d) for c, d in sums.items()}
    whole = None if None in sums.values() else sum(sums.values())
    return by_text((i, c, fits(d), fits(sums[c]), fits(whole), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest())
                   for (i, _), (d, c) in zip(good, who, strict=True))


ODD = [(0, [1.0, 0.0, 0.5]), (1, None), (2, [1.0, None, 0.0]), (3, [float("nan"), 1.0, 1.0]), (4, [float("inf"), 0.0, 0.0]), (5, []), (6, [0.0, 0.0, 0.0]),
       (7, [1.0, 0.0, 0.5]), (8, [1.0, 0.0, 0.5]), (9, [1.0]), (10, [-0.3, 0.2, 0.1, 0.9]), (11, [0.3, -0.2, 0.1]), (11, [0.3, -0.2, 0.1]), (11, [0.25, 0.2, -0.1]),
       (None, [1.0, 1.0, 1.0]), (None, [-1.0, 1.0, 1.0]), (-4, [0.5, 0.5, 0.5]), (12, [0.001, -0.001, 0.0]), (13, [100.0, -20.0, 3.0])]


@pytest.mark.parametrize("k", [1, 3, 40])
def test_odd_vectors(spark, k):
    got = ptolemaic_clusters(vectors(spark, ODD), k=k, rounds=4, width=3)
    assert got.columns == COLUMNS
    assert by_text(collected(got)) == by_hand(ODD, k, 4, 3)


@pytest.mark.parametrize("size", [1e6, 1e13, 1e300])
def test_components_of_any_size(spark, size):
    rows = [(i, [size * (i % 5), -size * (i % 3), float(i)]) for i in range(30)] + [(99, [1.7e308, 0.0, 0.0]), (100, [0.1, 0.2, 0.3])]
    got = ptolemaic_clusters(vectors(spark, rows, pa.float64()), k=4, rounds=3, width=3)
    assert by_text(collected(got)) == by_hand(rows, 4, 3, 3, single=False)


@pytest.mark.parametrize("hot", [False, True])
def test_clusters(spark, hot, monkeypatch):
    monkeypatch.setattr(ptolemy, "STEP", 64)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 16))
    rows = [(i, (centres[i % 6] + 0.2 * rng.normal(size=16)).tolist()) for i in range(400)]
    if hot:  # a third of the rows are one vector
        rows = [(i, rows[0][1] if i % 3 == 1 else v) for i, v in rows]
    got = ptolemaic_clusters(vectors(spark, rows), k=6, rounds=5, width=16)
    assert by_text(collected(got)) == by_hand(rows, 6, 5, 16)


def test_nothing(spark):
    for rows in ([], [(1, None)], [(1, [1.0])]):
        got = ptolemaic_clusters(vectors(spark, rows), width=3)
        assert got.columns == COLUMNS and got.collect() == []
    assert by_text(collected(ptolemaic_clusters(vectors(spark, [(7, [0.5, 0.25])]), width=2))) == by_hand([(7, [0.5, 0.25])], 8, 10, 2)


def test_bounds_hold_and_rule_out():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 12)) * 3000
    rows = np.floor(centres[np.arange(2000) % 8] + rng.normal(size=(2000, 12)) * 100)
    pivots = ptolemy.choose_pivots(rows[:500], 6)
    assert len({tuple(p) for p in pivots}) == 6
    nearest = ptolemy.Nearest([[int(x) for x in c] for c in centres], pivots)
    near = nearest.pivot_distances(rows)
    for j, far in enumerate(nearest.far):
        true = np.sqrt(((rows - nearest.centroids[j]) ** 2).sum(1))
        assert (ptolemy.lower_bounds(near, far, nearest.between) <= true).all()
    (places, _, who, best), = nearest(rows, near)
    exact = np.array([ptolemy.squares(rows.astype(np.int64), c) for c in nearest.centroids])
    assert (who == exact.argmin(0)).all() and (best == exact.min(0)).all() and len(places) == 2000
    assert nearest.checked < 2000 * 8 // 3


def test_limbs():
    for x in (0, 1, -1, 2**30, -(2**95) - 12345, 10**40):
        assert sum(v << ptolemy.LIMB * at for at, v in ptolemy.limbs(x)) == x
