"""A column profile that a stream keeps up to date: mergeable counts and sketches, merged once per batch into a stored table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size of the distinct-count sketch as a power of two; its relative standard error is 0.83 / sqrt(2^LG).
LG = 12
STATE = "variable string, rows bigint, filled bigint, min double, max double, total double, sketch binary"


def batch_profile(batch: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: rows, filled cells, range, sum and a sketch of the distinct values."""
    parts = [F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").cast("double").alias("number"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]
    return batch.select(F.inline(F.array(*parts))).groupBy("variable").agg(
        F.count("*").alias("rows"), F.count("value").alias("filled"), F.min("number").alias("min"), F.max("number").alias("max"),
        F.sum("number").alias("total"), F.hll_sketch_agg("value", LG).alias("sketch"))


def merged(parts: DataFrame) -> DataFrame:
    return parts.groupBy("variable").agg(
        F.sum("rows").alias("rows"), F.sum("filled").alias("filled"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("total").alias("total"),
        F.hll_union_agg("sketch").alias("sketch"))


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Batches whose merged profile is complete, ascending."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path)]
    return sorted(int(p.getName().split("=")[1]) for p in found if p.getName().startswith("batch=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def merge_batch(batch: DataFrame, batch_id: int, columns: list[str], folder: str, keep: int = 2) -> None:
    """Merge one micro-batch into the profile stored below `folder`.

    The merged profile of batch b is written as a table of its own from that of the last batch before b and the rows of b, so a batch that is
    repeated after a failure writes the same again and counts once. The newest `keep` versions stay.
    """
    spark = batch.sparkSession
    own = batch_profile(batch, columns)
    known = versions(spark, folder)
    before = [v for v in known if v < batch_id]
    if before:
        own = own.unionByName(spark.read.schema(STATE).parquet(f"{folder}/batch={before[-1]}"))
    merged(own).coalesce(1).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
    for old in [v for v in before if v <= batch_id - keep][:-1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch={old}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def keep_profile(stream: DataFrame, columns: list[str], folder: str, checkpoint: str):
    """Start a query that keeps the profile of `columns` below `folder` up to date; returns it."""
    return (stream.writeStream.foreachBatch(lambda batch, batch_id: merge_batch(batch, batch_id, columns, folder))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_profile(spark: SparkSession, folder: str) -> DataFrame:
    """(variable, rows, filled, min, max, mean, distinct): the newest stored profile; `distinct` is the sketch's estimate."""
    known = versions(spark, folder)
    if not known:
        return spark.createDataFrame([], "variable string, rows long, filled long, min double, max double, mean double, distinct long")
    return spark.read.schema(STATE).parquet(f"{folder}/batch={known[-1]}").select(
        "variable", "rows", "filled", "min", "max", F.try_divide("total", "filled").alias("mean"), F.hll_sketch_estimate("sketch").alias("distinct"))
