"""Exact top-k by inner product over a pivot-distance index."""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from statloom.llm.common import settle

#: Pivots (drawn by hash from the rows), most rings of distance around each, and rows or queries in one block.
PIVOTS, RINGS, BLOCK = 32, 64, 2048
#: Queries of one annulus that are put into blocks together.
DEALT = 8 * BLOCK
#: Annuli that a query looks into before it knows a bound.
FIRST = 4


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, v): floor(scale * x) of each component as doubles; rows with a null id, null vector or a null or non-finite component are left out."""
    x = F.col(vector_col)
    good = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.where(good).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double")).alias("v"))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix; shorter vectors are filled with zeros."""
    sizes = np.asarray(pc.list_value_length(lists))
    if len(sizes) and (sizes == width).all():
        return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    out = np.zeros((len(sizes), width))
    for i, v in enumerate(lists.to_pylist()):
        out[i, :len(v)] = v
    return out


def choose_pivots(vectors: DataFrame, width: int, count: int) -> np.ndarray:
    """`count` rows, those of smallest hash: a bounded sample that only shapes the index, never its answers."""
    rows = vectors.select("v").orderBy(F.xxhash64("v"), F.col("v")).limit(count).toArrow()
    return matrix(rows.column(0).combine_chunks(), width) if rows.num_rows else np.zeros((1, width))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of a to the rows of b."""
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0))


def keyed(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(pivot, distance, norm2, id, v): the nearest pivot and the distance to it."""
    width = pivots.shape[1]

    def run(batches):
        for batch in batches:
            rows = matrix(batch.column(1), width)
            d = distances(rows, pivots)
            near = d.argmin(axis=1)
            d = d[np.arange(len(rows)), near] if len(rows) else np.empty(0)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(d), pa.array((rows * rows).sum(1)), batch.column(0),
                                              batch.column(1)], ["pivot", "distance", "norm2", "id", "v"])

    return vectors.mapInArrow(run, "pivot int, distance double, norm2 double, id long, v array<double>")


def annulus(near: DataFrame, pivots: int) -> Column:
    """Pivot times RINGS plus ring. A pivot's rows are cut at quantiles of their distance into rings of about BLOCK rows, at most
    RINGS of them; the driver gets RINGS numbers per pivot."""
    grid = [i / RINGS for i in range(1, RINGS)]
    lines = near.groupBy("pivot").agg(F.count("*").alias("n"), F.percentile_approx("distance", grid, 10_000).alias("cuts")).collect()
    edges: list[list[float]] = [[] for _ in range(pivots)]
    for line in lines:
        rings = min(RINGS, -(-line["n"] // BLOCK))
        edges[line["pivot"]] = sorted({line["cuts"][RINGS * j // rings - 1] for j in range(1, rings)})
    table = F.array(*[F.array(*[F.lit(float(e)) for e in row]).cast("array<double>") for row in edges])
    return F.col("pivot") * RINGS + F.size(F.filter(F.get(table, F.col("pivot")), lambda e: e <= F.col("distance")))


def bounds(queries: np.ndarray, pivots: np.ndarray, annuli: np.ndarray, low: np.ndarray, high: np.ndarray, norm2: np.ndarray) -> np.ndarray:
    """Upper bound of the inner product of each query with any row of each annulus.

    |q - x| is at least |q - p| - high and low - |q - p| (triangle inequality), and 2 q.x = |q|^2 + |x|^2 - |q - x|^2; also
    q.x <= |q| |x|. A little is added for rounding.
    """
    d = distances(queries, pivots)[:, annuli // RINGS]
    least = np.maximum(0, np.maximum(d - high[None], low[None] - d))
    q2 = (queries * queries).sum(1)[:, None]
    # |x|^2 - |q - x|^2 grows with |x|; the annulus' largest norm bounds it
    bound = np.minimum((q2 + norm2[None] - least**2) / 2, np.sqrt(q2 * norm2[None]))
    return bound + 1e-6 * (1 + np.abs(bound) + q2 + norm2[None])


def _visits(pivots, stats, k, known):
    """(annulus, id, v, floor): the annuli that a query has to look into, best bound first.

    First round (`known` false): the FIRST best annuli and as many more as it takes to see k rows. Second round: every other
    annulus whose bound reaches the k-th best score so far (`floor`).
    """
    annuli, low, high, norm2, count = stats
    width = pivots.shape[1]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                q = matrix(part.column(1), width)
                bound = bounds(q, pivots, annuli, low, high, norm2)
                order = np.argsort(-bound, axis=1, kind="stable")
                seen = np.cumsum(count[order], axis=1)
                rank = np.arange(len(annuli))[None]
                # the query itself may be one of the rows: one more than k
                before = np.c_[np.zeros((len(q), 1)), seen[:, :-1]]
                first = (rank < FIRST) | (before <= k)
                if known:
                    floor = np.array([-math.inf if f is None else f for f in part.column(2).to_pylist()])
                    first = ~first & (np.take_along_axis(bound, order, 1) >= floor[:, None])
                rows, places = np.nonzero(first)
                for a in range(0, len(rows), 1 << 14):
                    r, p = rows[a:a + (1 << 14)], places[a:a + (1 << 14)]
                    own = pa.array(r)
                    yield pa.RecordBatch.from_arrays([pa.array(annuli[order[r, p]].astype(np.int32)), part.column(0).take(own), part.column(1).take(own)],
                                                     ["annulus", "id", "v"])

    return run


def _blocks(width):
    """Rows of one annulus, which come sorted, as blocks of at most BLOCK: (annulus, ids, vectors) in bytes."""

    def run(batches):
        now, ids, rows, n = None, [], [], 0

        def block():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.concatenate(ids).astype("<i8").tobytes()]),
                                               pa.array([np.concatenate(rows).astype("<f8").tobytes()])], ["annulus", "ids", "vectors"])

        for batch in batches:
            annulus = batch.column(0).to_numpy(zero_copy_only=False)
            own, vectors = batch.column(1).to_numpy(zero_copy_only=False), matrix(batch.column(2), width)
            cuts = np.flatnonzero(np.r_[True, annulus[1:] != annulus[:-1]]).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(annulus)], strict=True):
                for c in range(a, b, BLOCK):
                    end = min(b, c + BLOCK)
                    if ids and (annulus[c] != now or n + end - c > BLOCK):
                        yield block()
                        ids, rows, n = [], [], 0
                    now = int(annulus[c])
                    ids.append(own[c:end])
                    rows.append(vectors[c:end])
                    n += end - c
        if ids:
            yield block()

    return run


def blocks(rows: DataFrame, width: int, salts: Column) -> DataFrame:
    """An annulus may hold any share of the rows: they are dealt over `salts` groups, whose blocks spread over tasks."""
    dealt = rows.select("annulus", "id", "v").withColumn("salt", F.pmod(F.xxhash64("id"), salts).cast("int"))
    dealt = dealt.repartition("annulus", "salt").sortWithinPartitions("annulus", "salt").drop("salt")
    return dealt.mapInArrow(_blocks(width), "annulus int, ids binary, vectors binary")


def _best(width, k):
    """For each pair of a query block and a row block, each query's k best rows of the block."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q, x_ids, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                q_ids, x_ids = np.frombuffer(q_ids, "<i8"), np.frombuffer(x_ids, "<i8")
                q, x = np.frombuffer(q, "<f8").reshape(-1, width), np.frombuffer(x, "<f8").reshape(-1, width)
                scores = products(q, x)
                order = np.argsort(x_ids, kind="stable")  # of equal scores the smaller id comes first
                scores, x_ids = scores[:, order], x_ids[order]
                starts = np.flatnonzero(np.r_[True, x_ids[1:] != x_ids[:-1]])
                if len(starts) < len(x_ids):  # repeated ids count once
                    scores, x_ids = np.maximum.reduceat(scores, starts, axis=1), x_ids[starts]
                out = []
                for i in range(len(q_ids)):
                    row = scores[i]
                    some = np.flatnonzero(row >= np.partition(row, -min(k + 1, len(row)))[-min(k + 1, len(row))])
                    some = some[x_ids[some] != q_ids[i]] if len(some) <= 4 * k else _first(row, some, x_ids, q_ids[i], k)
                    some = some[np.argsort(-row[some], kind="stable")][:k]
                    out.append((np.full(len(some), q_ids[i]), x_ids[some], row[some].astype(np.int64)))
                columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    return run


def _first(row, some, x_ids, own, k):
    """Many equal scores: the k + 1 first in order of score and id suffice."""
    some = some[x_ids[some] != own]
    return some[np.argsort(-row[some], kind="stable")][:k + 1]


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: by doubles while every sum stays below 2^53, else by 64-bit integers."""
    most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1])
    return q @ x.T if most < 2.0**53 else q.astype(np.int64) @ x.astype(np.int64).T


def exact_top_k(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0,
                pivots: int = PIVOTS) -> DataFrame:
    """Each query's `k` rows of highest integer inner product: (query_id, rank from 1, id, score), ties to the smaller id.

    Vectors are floor(scale * x). Rows with a null id, a null vector or a null or non-finite component take no part; empty vectors
    do and score 0; a shorter vector counts as filled with zeros. A row is no candidate for a query of its own id.
    A query with fewer than k candidates returns all. Repeated rows (same id) count once, with their best score. Other columns
    are not looked at; an empty table or no query gives an empty result.

    Index: pivots are a bounded sample; every row is keyed by its nearest pivot and the ring of its distance. The driver gets
    one line per annulus (at most pivots x RINGS); a large annulus is several blocks. A query looks into its best annuli, which gives a k-th score, then into all
    others that the triangle inequality lets reach that score, and no more. Within an annulus, blocks of queries meet
    blocks of rows as matrix products.
    """
    vectors = settle(whole_vectors(df, id_col, vector_col, scale))
    asked = settle(whole_vectors(df.where(is_query), id_col, vector_col, scale).dropDuplicates(["id", "v"]))
    width = max(1, vectors.agg(F.max(F.size("v"))).first()[0] or 1)
    points = choose_pivots(vectors, width, pivots)
    near = settle(keyed(vectors, points))
    rows = near.withColumn("annulus", annulus(near, len(points)))
    lines = rows.groupBy("annulus").agg(F.min("distance"), F.max("distance"), F.max("norm2"), F.count("*")).orderBy("annulus").collect()
    stats = tuple(np.array([line[i] for line in lines], float if 0 < i < 4 else np.int64) for i in range(5))
    sets = [1] * (len(points) * RINGS)
    for line in lines:
        sets[line["annulus"]] = -(-line[4] // BLOCK)
    blocked = settle(blocks(rows, width, F.get(F.array(*map(F.lit, sets)), F.col("annulus"))))
    groups = F.lit(max(1, -(-asked.count() // DEALT)))

    def look(queries: DataFrame, known: bool) -> DataFrame:
        visits = queries.mapInArrow(_visits(points, stats, k, known), "annulus int, id long, v array<double>")
        mine = blocks(visits, width, groups).select("annulus", F.col("ids").alias("q_ids"), F.col("vectors").alias("q"))
        met = mine.join(blocked, "annulus").select("q_ids", "q", "ids", "vectors")
        return met.mapInArrow(_best(width, k), "query_id long, vec_id long, score long")

    def top(found: DataFrame) -> DataFrame:
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = settle(top(look(asked.select("id", "v"), False)))
    floors = first.where(F.col("rank") == k).select(F.col("query_id").alias("of"), F.col("score").cast("double").alias("floor"))
    second = look(asked.join(floors, F.col("id") == F.col("of"), "left").select("id", "v", "floor"), True)
    best = top(first.select("query_id", "vec_id", "score").union(second))
    return best.select("query_id", "rank", F.col("vec_id").alias(id_col if id_col != "query_id" else "vec_id"), "score")
