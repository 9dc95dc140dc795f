"""Running sums and counts per key, exact, with hot keys spread over many tasks."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.operators.naming import col
from statloom.session import settle

#: Rows of an ordered table that make one unit (as a power of two).
UNIT_BITS = 14
#: Stands for a missing instant in the order of pieces; such rows come first.
_EARLIEST = "0001-01-01 00:00:00"
_PLAIN = {T.StringType: "", T.LongType: 0, T.IntegerType: 0, T.ShortType: 0, T.ByteType: 0, T.DoubleType: 0.0, T.FloatType: 0.0, T.BooleanType: False}


def _present(df: DataFrame, key: str) -> Column:
    """The key in a form without nulls (text of a structure where the type has no plain value), beside which a flag tells nulls apart."""
    kind = df.schema[key].dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.coalesce(col(key), F.lit(_EARLIEST).cast(kind))
    if type(kind) in _PLAIN:
        return F.coalesce(col(key), F.lit(_PLAIN[type(kind)]).cast(kind))
    return F.to_json(F.struct(col(key).alias("k")))


def running_sum(df: DataFrame, keys: list[str], ts: str, order: list[str], value: Column, name: str,
                bucket: str = "minute") -> DataFrame:
    """Add `name`: the sum of `value` over the rows of a key up to and including this row; a null value adds nothing.

    Rows are ordered by (`ts`, then `order`), nulls first; a null key is a key. A key's timeline is cut into `bucket`-long pieces: pieces are
    summed first (map-side combine), a window runs over the piece totals, and a second window runs inside
    each piece. A key with a third of all rows is thus split into as many tasks as it has pieces. Detail rows
    move once: the join and the final window share their partitioning, as keys take part in a form without nulls.
    """
    own = [f"_key{i}" for i in range(len(keys))] + [f"_none{i}" for i in range(len(keys))]
    forms = [_present(df, k) for k in keys] + [col(k).isNull() for k in keys]
    piece = F.coalesce(F.date_trunc(bucket, col(ts)), F.lit(_EARLIEST).cast("timestamp"))
    cut = df.withColumns(dict(zip(own, forms)) | {"_piece": piece, "_value": F.coalesce(value, F.lit(0))})
    totals = cut.groupBy(*own, "_piece").agg(F.sum("_value").alias("_piece_sum"))
    before = (Window.partitionBy(*own).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*own, "_piece", F.coalesce(F.sum("_piece_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*own, "_piece").orderBy(col(ts), *[col(o) for o in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = cut.join(offsets, [*own, "_piece"])
    return joined.select(*[col(c) for c in df.columns], (F.col("_before") + F.sum("_value").over(inside)).alias(name))


def in_units(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows written in global `order` (nulls first) with `_at`, which ascends in that order, and `_unit`, a run of at most 2^UNIT_BITS rows.

    Rows are range-partitioned by the order and a salt, so rows that agree in all of it are spread as well; no key is one task.
    """
    salted = settle(df.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id())))
    keys = [col(o) for o in order] + [F.col("_salt")]
    placed = salted.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_salt")
    return settle(placed.withColumn("_at", F.monotonically_increasing_id())).withColumn("_unit", F.expr(f"shiftright(_at, {UNIT_BITS})"))
