"""Joins that stay balanced when one key holds a large share of the rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.operators.naming import col
from statloom.session import settle



def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on `keys`, nulls matching nulls; the keys come once."""
    names = [f"_k{i}" for i in range(len(keys))]
    right = right.select(*[col(k).alias(r) for k, r in zip(keys, names)], *[col(c) for c in right.columns if c not in keys])
    on = F.lit(True)
    for k, r in zip(keys, names):
        on = on & col(k).eqNullSafe(F.col(r))
    return left.join(right, on, how).drop(*names)


def lookup_by_key(detail: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join detail rows to a table with one row per key; nulls match nulls.

    The table is written once: its size is then known, so Spark broadcasts a short one, and otherwise both sides are
    shuffled for this join alone, which lets AQE split a hot key over several tasks.
    """
    return null_safe_join(detail, settle(table), keys, how)


def every_pair(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """All pairs of rows of the two reduced tables within a segment, for results that have a row per pair.

    The right rows are dealt into as many pieces as a shuffle has partitions and each left row meets every piece, so that no segment is one task
    and a larger cluster takes smaller shares.
    """
    pieces = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    right = right.withColumn("_piece", F.pmod(F.xxhash64(*[c for c in right.columns if c not in by]), F.lit(pieces)).cast("int"))
    left = left.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    return null_safe_join(left, right, [*by, "_piece"]).drop("_piece")
