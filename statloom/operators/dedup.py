"""Duplicate rows: drop, flag, count, and guarded enrolment."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.operators.naming import col, unused
from statloom.operators.skew import lookup_by_key


def drop_duplicates(df: DataFrame, columns: list[str], row_id: str, keep: str = "first", copies: str | None = None) -> DataFrame:
    """One row per distinct content, with the smallest (first) or largest (last) row id of its copies.

    A plain group-by: copies are combined before the shuffle, however many there are. Nulls equal nulls. `copies` names a column for
    the number of rows that each one stands for.
    """
    pick = F.min(col(row_id)) if keep == "first" else F.max(col(row_id))
    aggs = [pick.alias(row_id)] + ([F.count("*").alias(copies)] if copies else [])
    return df.groupBy(*[col(c) for c in columns]).agg(*aggs).select(*[col(c) for c in (row_id, *columns, *([copies] if copies else []))])


def exact(column: Column, kind: T.DataType) -> Column:
    """A value in a form whose text tells exactly what grouping tells: instants to the microsecond, one zero."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, T.TimestampNTZType):
        return column.cast("string")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(column == 0, F.lit("0")).otherwise(column.cast("string"))
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(*[exact(column[f.name], f.dataType).alias(f"c{i}") for i, f in enumerate(kind.fields)]))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: exact(x, kind.elementType))
    return column


def digest(df: DataFrame, columns: list[str]) -> Column:
    """A 256-bit key of a row's content, so that long texts are hashed where they are read and never shuffled."""
    parts = [exact(col(c), df.schema[c].dataType).alias(f"c{i}") for i, c in enumerate(columns)]
    return F.unhex(F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256))


def flag_duplicates(df: DataFrame, columns: list[str], row_id: str) -> DataFrame:
    """Every row, with `_duplicate_flag` telling whether another row has the same content.

    Contents are counted by digest and only those with copies are looked up.
    """
    key, copies = unused("_digest", df.columns), unused("_copies", df.columns)
    keyed = df.withColumn(key, digest(df, columns))
    copied = keyed.groupBy(key).agg(F.count("*").alias(copies)).where(F.col(copies) > 1)
    out = lookup_by_key(keyed, copied, [key], "left")
    return out.select(*[col(c) for c in df.columns], F.col(copies).isNotNull().alias("_duplicate_flag"))


def duplicate_count(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that repeat an earlier row."""
    sizes = df.groupBy(digest(df, columns).alias("_digest")).agg(F.count("*").alias("n"))
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_rows"),
                     F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def new_enrolments(requests: DataFrame, active: DataFrame, keys: list[str]) -> DataFrame:
    """Requests whose (class, student) is not enrolled yet, once each."""
    return requests.select(*keys).distinct().join(active.select(*keys), keys, "left_anti")
