"""Ordered buckets: cut a sort key into even ranges so that no prefix sum needs one task.

Cut points are a few numbers worked out once on the driver; the bucket of a row is then a pure
function of its key, so every stage, retry and branch of a plan agrees on it.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket_count(df: DataFrame) -> int:
    """Several buckets per shuffle partition, so that hashing them leaves the partitions even."""
    return max(32, min(4096, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def cut_points(df: DataFrame, key: str, buckets: int | None = None) -> list[float]:
    """Ascending cut points of a numeric key; approximate, since they only set the balance.

    Distinct keys are weighed, so a value that fills a third of the table counts as one row.
    """
    buckets = buckets or bucket_count(df)
    probs = [i / buckets for i in range(1, buckets)]
    row = (df.select(F.col(key).cast("double").alias("k")).where("k IS NOT NULL").distinct()
           .agg(F.percentile_approx("k", probs, 4 * buckets).alias("cuts")).first())
    return sorted(set(row["cuts"] or []))


def bucket_of(key: Column, cuts: list[float]) -> Column:
    """Number of cut points not above the key, by binary search in the row."""
    if not cuts:
        return F.lit(0)
    size = 1 << (len(cuts).bit_length() - 1)
    steps = []
    while size:
        steps.append(F.lit(size))
        size //= 2
    table = F.array(*[F.lit(float(c)) for c in cuts])
    key = key.cast("double")
    return F.aggregate(F.array(*steps), F.lit(0),
                       lambda at, step: F.when(F.get(table, at + step - 1) <= key, at + step).otherwise(at))
