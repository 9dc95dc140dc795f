"""Exact integer k-means in which Ptolemy's inequality over pivot pairs rules centroids out."""

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import settle
from statloom.llm.topk import matrix
from statloom.session import literal_rows

#: Pivots, and the rows of smallest hash among which they are chosen; both only shape the bounds, never the answer.
PIVOTS, SAMPLE = 6, 1024
#: Sums travel as limbs of so many bits, so that any number of rows of any size adds up exactly.
LIMB = 30
#: Rows that are looked at together.
STEP = 4096
#: Twice the relative rounding error of one operation on doubles.
ULP = 2.0**-52


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, width: int, scale: float) -> DataFrame:
    """(id, v): floor(scale * x) as whole doubles, of the vectors with exactly `width` components, all finite before and after scaling."""
    x = F.col(vector_col)
    good = (F.size(x) == width) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < float("inf")))

    def whole(c):
        scaled = c.cast("double") * scale
        # from 2^52 on every double is whole
        return F.when(F.abs(scaled) >= 2.0**52, scaled).otherwise(F.floor(scaled).cast("double"))

    return df.where(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(x, whole).alias("v"))


def plain_limit(width: int) -> int:
    """Components up to this size keep a squared distance below 2^63."""
    return math.isqrt((2**63 - 1) // width) // 2


def squares(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole rows to a whole point, both of 64-bit or both of Python's integers."""
    gap = rows - point
    return (gap * gap).sum(axis=1)


def roots(square: np.ndarray) -> np.ndarray:
    """Distances as doubles, correct to one ULP; not a number where a double cannot hold the square."""
    if square.dtype != object:
        return np.sqrt(square.astype(np.float64))
    return np.array([math.sqrt(s) if s < 2**1000 else math.nan for s in square.tolist()], np.float64)


def lower_bounds(near: np.ndarray, far: np.ndarray, between: np.ndarray) -> np.ndarray:
    """Lower bounds of the distances of rows to one centroid by Ptolemy's inequality: for pivots p and s,
    d(x, c) d(p, s) >= |d(c, p) d(x, s) - d(c, s) d(x, p)|.

    near: rows by pivots (cached); far: the centroid's distances to the pivots; between: pivots by pivots. Every product is
    taken with the rounding that makes the bound smaller, so that it never exceeds the true distance.
    """
    low = np.zeros(len(near))
    for p, s in combinations(range(len(far)), 2):
        if between[p, s] > 0:
            a, b = far[p] * near[:, s], far[s] * near[:, p]
            low = np.fmax(low, (np.abs(a - b) - 4 * ULP * (a + b)) / between[p, s] * (1 - 4 * ULP))
    return low


class Nearest:
    """Assigns rows to the nearest of some whole centroids; a tie goes to the smaller number."""

    def __init__(self, centroids: list[list[int]], pivots: list[list[int]]):
        self.width = len(centroids[0])
        self.limit = plain_limit(self.width)
        self.big = any(abs(x) > self.limit for c in centroids + pivots for x in c)
        kind = object if self.big else np.int64
        self.centroids, self.pivots = np.array(centroids, kind), np.array(pivots, kind)
        self.between = np.array([roots(squares(self.pivots, p)) for p in self.pivots])
        self.far = np.array([roots(squares(self.pivots, c)) for c in self.centroids])
        self.checked = 0

    def whole(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, rows as whole numbers): 64-bit ones, and those that need Python's integers."""
        big = np.abs(rows).max(axis=1, initial=0) > self.limit
        if self.big:
            big[:] = True
        for places, kind in ((np.flatnonzero(~big), np.int64), (np.flatnonzero(big), object)):
            if len(places):
                part = rows[places]
                yield places, part.astype(np.int64) if kind is np.int64 else np.array([[int(x) for x in r] for r in part.tolist()], object).reshape(len(part), -1)

    def pivot_distances(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty((len(rows), len(self.pivots)))
        for places, part in self.whole(rows):
            own = self.pivots.astype(part.dtype)
            for j, p in enumerate(own):
                out[places, j] = roots(squares(part, p))
        return out

    def __call__(self, rows: np.ndarray, near: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(places, rows as whole numbers, number of the nearest centroid, squared distance).

        The centroid of least bound is measured first; of the others those whose bound exceeds that distance are ruled out and the
        survivors measured exactly.
        """
        for places, part in self.whole(rows):
            centroids = self.centroids.astype(part.dtype)
            low = np.array([lower_bounds(near[places], far, self.between) for far in self.far])
            first = low.argmin(axis=0)
            who, best = first.copy(), np.zeros(len(part), part.dtype)
            for c in range(len(centroids)):
                own = np.flatnonzero(first == c)
                best[own] = squares(part[own], centroids[c])
                self.checked += len(own)
            for c in range(len(centroids)):
                # a bound that is not a number rules nothing out
                out = low[c] ** 2 * (1 - 8 * ULP) > _float(best) * (1 + ULP)
                own = np.flatnonzero(~out & (first != c))
                d = squares(part[own], centroids[c])
                self.checked += len(own)
                wins = (d < best[own]) | ((d == best[own]) & (c < who[own]))
                best[own[wins]], who[own[wins]] = d[wins], c
            yield places, part, who, best


def _float(whole: np.ndarray) -> np.ndarray:
    if whole.dtype != object:
        return whole.astype(np.float64)
    return np.array([float(x) if x < 2**1000 else math.inf for x in whole.tolist()], np.float64)


def choose_pivots(sample: np.ndarray, count: int) -> list[list[int]]:
    """Rows of the sample that lie far from each other: the first, then each time the one farthest from those chosen."""
    if not len(sample):
        return []
    scale = max(1.0, float(np.abs(sample).max()))
    rows = sample / scale
    chosen, gap = [0], ((rows - rows[0]) ** 2).sum(1)
    while len(chosen) < count and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((rows - rows[chosen[-1]]) ** 2).sum(1))
    return [[int(x) for x in sample[i].tolist()] for i in chosen]


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """(limb, signed part) of a whole number."""
    sign, value, at = (-1 if value < 0 else 1), abs(value), 0
    while value:
        if value & ((1 << LIMB) - 1):
            yield at, sign * (value & ((1 << LIMB) - 1))
        value >>= LIMB
        at += 1


def _steps(batches, width):
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            yield part, matrix(part.column(1), width)


def _near(nearest):
    def run(batches):
        for part, rows in _steps(batches, nearest.width):
            d = nearest.pivot_distances(rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1, dtype=np.int32) * d.shape[1]), pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["id", "v", "near"])
    return run


def _sums(nearest):
    """Per task and centroid the number of its rows (place -1) and the sum of each component, in limbs."""

    def run(batches):
        k, width = len(nearest.centroids), nearest.width
        total, count = np.zeros((k, width), object), [0] * k
        for part, rows in _steps(batches, width):
            near = matrix(part.column(2), len(nearest.pivots))
            for _, whole, who, _ in nearest(rows, near):
                for c in range(k):
                    own = whole[who == c]
                    count[c] += len(own)
                    if len(own):
                        total[c] += own.sum(axis=0).astype(object)
        out = [(c, place, at, x) for c in range(k) for place, value in [(-1, count[c]), *enumerate(total[c])] for at, x in limbs(int(value))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)],
                                             ["cluster", "place", "limb", "value"])
    return run


def _found(nearest):
    def run(batches):
        for part, rows in _steps(batches, nearest.width):
            who, best = np.zeros(len(rows), np.int32), np.zeros(len(rows), object)
            for places, _, w, b in nearest(rows, matrix(part.column(2), len(nearest.pivots))):
                who[places], best[places] = w, b
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(who), pa.array([int(b) if b < 2**63 else None for b in best.tolist()], pa.int64())],
                                             ["id", "cluster", "distance"])
    return run


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The `k` vectors of smallest sha256 of `seed:id`; equal ids by their components, null ids last."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.orderBy(order.asc_nulls_last(), "v").limit(k).select("v").collect()
    return [[int(x) for x in r["v"]] for r in rows]


def ptolemaic_clusters(df: DataFrame, k: int = 8, rounds: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", width: int = 64,
                       scale: float = 1024.0, seed: int = 3, pivots: int = PIVOTS) -> DataFrame:
    """Lloyd's rounds over whole numbers, exact: (id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row per vector kept.

    Kept are vectors with exactly `width` components, none null or non-finite (nor infinite once scaled); a component x counts as
    floor(scale * x). The first centroids are the `k` vectors with the smallest sha256 of `seed:id`, in that order; fewer
    vectors give fewer centroids. A round assigns every vector to the nearest centroid (ties: the smaller number) and moves every
    non-empty centroid to the exact floor of its mean; then all are assigned once more. Rows that repeat an id are vectors of
    their own; a null id is kept, its hash comes last. `distance` is squared; it and the inertias are null where they exceed 2^63 - 1.
    Other columns are not looked at; an empty table gives an empty result.

    Every vector's distances to a few pivots are computed once and written beside it. In a round Ptolemy's inequality over all pivot
    pairs bounds its distance to each centroid from below, rounded down; only centroids that the bound cannot rule out are measured,
    in whole numbers. A round shuffles k x (width + 1) sums per task, and the driver gets their totals.
    """
    spark = df.sparkSession
    vectors = settle(whole_vectors(df, id_col, vector_col, width, scale))
    centroids = first_centroids(vectors, k, seed)
    out_id = id_col
    if not centroids:
        return vectors.select(F.col("id").alias(out_id), F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")],
                              F.lit("").alias("centroid_sha256"))
    sample = vectors.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).toArrow()
    points = choose_pivots(matrix(sample.column(0).combine_chunks(), width), pivots)
    cached = settle(vectors.mapInArrow(_near(Nearest(centroids, points)), "id long, v array<double>, near array<double>"))
    for _ in range(rounds):
        parts = cached.mapInArrow(_sums(Nearest(centroids, points)), "cluster int, place int, limb int, value long")
        total: dict[tuple[int, int], int] = {}
        for r in parts.groupBy("cluster", "place", "limb").agg(F.sum("value").alias("value")).collect():
            total[r["cluster"], r["place"]] = total.get((r["cluster"], r["place"]), 0) + (r["value"] << LIMB * r["limb"])
        centroids = [[total.get((c, j), 0) // total[c, -1] for j in range(width)] if total.get((c, -1)) else old for c, old in enumerate(centroids)]
    found = settle(cached.mapInArrow(_found(Nearest(centroids, points)), "id long, cluster int, distance long"))
    lines = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d"), F.count_if(F.col("distance").isNull()).alias("over")).collect()
    sums = {r["cluster"]: None if r["over"] else int(r["d"]) for r in lines}

    def fits(x):
        return x if x is not None and x < 2**63 else None

    whole = fits(None if None in sums.values() else sum(sums.values()))
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    told = literal_rows(spark, [(c, fits(d), whole, digest[c]) for c, d in sums.items()], "number int, cluster_inertia long, inertia long, centroid_sha256 string")
    # one row per centroid
    joined = found.join(F.broadcast(told), F.col("cluster") == F.col("number"))
    return joined.select(F.col("id").alias(out_id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
