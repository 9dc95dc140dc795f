"""As-of lookups: the newest earlier row of a key for every row, with hot keys spread over many tasks."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statloom.operators.naming import col
from statloom.operators.prefix import _EARLIEST, _present


def last_known(rows: DataFrame, history: DataFrame, keys: list[str], ts: str, values: list[str], order: list[str] = (), bucket: str = "day") -> DataFrame:
    """`rows` with the `values` of the newest row of `history` that has the same keys (nulls are a key) and a `ts` not after theirs; null if there is none.

    Of history rows with one `ts` the last in `order` counts; those without a `ts` are left out, and rows without one find nothing. Both tables are
    united and cut into pieces of time: a piece's newest history row is carried over to the pieces after it, and inside a piece a window finds the
    last one before each row. A hot key is as many tasks as it has pieces.
    """
    own = [f"_key{i}" for i in range(2 * len(keys))]

    def formed(df, mine, theirs, side):
        forms = [_present(df, k) for k in keys] + [col(k).isNull() for k in keys]
        piece = F.coalesce(F.date_trunc(bucket, col(ts)), F.lit(_EARLIEST).cast("timestamp"))
        return df.select(*[f.alias(o) for f, o in zip(forms, own)], piece.alias("_piece"), col(ts).cast("timestamp").alias("_ts"), F.lit(side).alias("_side"), mine, theirs)

    kept, told = F.struct(*[col(c) for c in rows.columns]), F.struct(*[col(o).alias(f"o{i}") for i, o in enumerate(order)], *[col(v).alias(f"v{i}") for i, v in enumerate(values)])
    row_type, told_type = rows.select(kept.alias("x")).schema["x"].dataType, history.select(told.alias("x")).schema["x"].dataType
    left = formed(rows, kept.alias("_row"), F.lit(None).cast(told_type).alias("_told"), 1)
    right = formed(history.where(col(ts).isNotNull()), F.lit(None).cast(row_type).alias("_row"), told.alias("_told"), 0)
    both = left.unionByName(right)
    newest = F.max_by("_told", F.when(F.col("_side") == 0, F.struct("_ts", "_told")))
    pieces = both.groupBy(*own, "_piece").agg(newest.alias("_newest"))
    before = Window.partitionBy(*own).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.select(*own, "_piece", F.last("_newest", True).over(before).alias("_carried"))
    inside = Window.partitionBy(*own, "_piece").orderBy("_ts", "_side", "_told").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.join(carried, [*own, "_piece"]).withColumn("_found", F.coalesce(F.last("_told", True).over(inside), F.col("_carried"))).where("_side = 1")
    found = found.withColumn("_found", F.when(F.col("_ts").isNotNull(), F.col("_found")))
    return found.select(*[F.col("_row").getField(c).alias(c) for c in rows.columns], *[F.col("_found").getField(f"v{i}").alias(v) for i, v in enumerate(values)])
