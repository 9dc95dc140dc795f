"""Structured Streaming jobs over the activity and payment events.

Every job appends to a file sink: results are written by the executors and nothing passes through the driver.
Windowed results appear once the watermark has closed their window, so late rows within the delay still count. A stream
that is drained to its end is closed by markers far in the future, so its last windows appear too.
"""

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from statloom import fixed_values as fv
from statloom.session import checkpoint_folder

# Payment events that count as paid, per payload shape.
PAID_A, PAID_B = "charge.success", "order_created"
PAYLOAD_SCHEMA = """
    event string,
    data struct<reference: string, id: string, metadata: struct<user_id: string, pack_id: string, amount_usd: double>>,
    meta struct<event_name: string, custom_data: struct<user_id: string, pack_id: string, amount_usd: double>>
"""


# The instant of the markers that close a drained stream: their own window stays open and is never written.
END_OF_TIME = "2200-01-01 00:00:00"


def event_stream(spark: SparkSession, folder: str, table: str = "events", files_per_batch: int | None = None,
                 markers: str | None = None) -> DataFrame:
    """A parquet table, one file or a folder of files, as a file stream, `ts` as an instant. Rows put into the folder `markers` by
    `drain` join the stream.

    All files there are make one micro-batch: the watermark moves between batches, so no row of the table is late, and an account's
    rows meet in time order, whatever the order of the files. `files_per_batch` bounds a batch; it is for files in time order only.
    """
    path = f"{folder}/{table}.parquet"
    schema = spark.read.parquet(path).schema

    def reader():
        stream = spark.readStream.schema(schema)
        return stream.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else stream

    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        events = reader().parquet(path)
    else:
        events = reader().option("pathGlobFilter", f"{table}.parquet").parquet(folder)
    if markers:
        spark.createDataFrame([], schema).write.mode("append").parquet(markers)
        events = events.unionByName(reader().parquet(markers))
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def marker_folder(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/markers-{uuid.uuid4().hex}"


def drain(stream: DataFrame, fmt: str = "parquet", markers: str | None = None) -> DataFrame:
    """Run a stream over everything available, into a fresh folder of the shared checkpoint area, and read it back.

    With `markers` (the folder given to `event_stream`) the stream is then closed: two marker rows move the watermark past
    every window of the data, which gives the rows that a batch job over the same events gives.
    """
    spark = stream.sparkSession
    folder = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"

    def run():
        query = (stream.writeStream.outputMode("append").format(fmt).option("path", f"{folder}/out")
                 .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
        query.awaitTermination()

    run()
    if markers:
        schema = spark.read.parquet(markers).schema
        row = [F.lit(END_OF_TIME if f.name == "ts" else None).cast(f.dataType).alias(f.name) for f in schema.fields]
        for _ in range(2):  # the watermark a batch sets holds from the next one on
            spark.range(1).select(*row).write.mode("append").parquet(markers)
            run()
    return spark.read.schema(stream.schema).format(fmt).load(f"{folder}/out")


def daily_quota(events: DataFrame, key: str, limit: int, delay: str = "1 day") -> DataFrame:
    """Use per key and closed day, flagged when above the limit."""
    counted = events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), key).agg(F.count("*").alias("used"))
    return counted.select(key, F.col("window.start").alias("day"), "used", (F.col("used") > limit).alias("over"))


def sessions(events: DataFrame, key: str, gap: str = "12 hours", delay: str = "1 day") -> DataFrame:
    """Closed activity sessions of a key."""
    held = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))
    return held.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def sliding_activity(events: DataFrame, key: str, size: str = "1 day", slide: str = "6 hours",
                     delay: str = "1 day") -> DataFrame:
    held = events.withWatermark("ts", delay).groupBy(F.window("ts", size, slide), key).agg(F.count("*").alias("n"))
    return held.select(key, F.col("window.start").alias("start"), "n")


def _spend(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Accept or reject one account's rows of a micro-batch in time order; the balance lives in the state."""
    balance = state.get[0] if state.exists else 0
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    after, ok = [], []
    for delta in rows["delta"].to_numpy():
        fits = delta >= 0 or balance + delta >= 0
        balance += int(delta) if fits else 0
        after.append(balance)
        ok.append(bool(fits))
    state.update((balance,))
    yield rows.assign(user_id=key[0], balance=after, accepted=ok)[
        ["user_id", "event_id", "ts", "delta", "balance", "accepted"]]


def spend_decisions(ledger: DataFrame) -> DataFrame:
    """Ledger rows (user_id, event_id, ts, delta) with the balance after each and whether it was accepted.

    The rows of one account in one micro-batch meet in one task; see `event_stream` for what a batch holds.
    """
    rows = ledger.select("user_id", "event_id", "ts", F.col("delta").cast("long").alias("delta"))
    return rows.groupBy("user_id").applyInPandasWithState(
        _spend, "user_id long, event_id long, ts timestamp, delta long, balance long, accepted boolean",
        "balance long", "append", GroupStateTimeout.NoTimeout)


def payment_events(payloads: DataFrame, body: str, delay: str = "1 day", once: bool = True) -> DataFrame:
    """Paid events of both payload shapes in one form; a reference seen again within the delay is dropped."""
    p = F.from_json(F.col(body), PAYLOAD_SCHEMA)
    first = p["event"].isNotNull()
    paid = (p["event"] == PAID_A) | (~F.coalesce(first, F.lit(False)) & (p["meta"]["event_name"] == PAID_B))

    def pick(a: Column, b: Column) -> Column:
        return F.when(first, a).otherwise(b)

    person_a, person_b = p["data"]["metadata"], p["meta"]["custom_data"]
    out = payloads.where(paid).select(
        "ts", F.when(first, "paystack").otherwise("lemonsqueezy").alias("gateway"),
        pick(p["data"]["reference"], p["data"]["id"]).alias("reference"),
        *[pick(person_a[c], person_b[c]).alias(c) for c in ("user_id", "pack_id", "amount_usd")])
    if not once:
        return out
    return out.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["gateway", "reference"])


def _grants(days: int):
    def grant(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        period = days * 86400
        out = []
        for when in sorted(t for pdf in batches for t in pdf["ts"]):
            second = int(when.timestamp())
            if last is None or second - last >= period:
                last = second
                out.append(when)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"enrolment": [key[0]] * len(out), "granted_at": out})

    return grant


def allowance_grants(activity: DataFrame, key: str, days: int = fv.ALLOWANCE_PERIOD_DAYS) -> DataFrame:
    """A grant at an enrolment's first activity and again at the first activity after the period."""
    rows = activity.select(F.col(key).cast("long").alias("enrolment"), "ts")
    return rows.groupBy("enrolment").applyInPandasWithState(
        _grants(days), "enrolment long, granted_at timestamp", "last long", "append", GroupStateTimeout.NoTimeout)


def profile_increments(stream: DataFrame, columns: list[str], window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Mergeable column counts per closed time slice: filled cells, range, sum and a distinct sketch.

    Slices add up to the profile of any longer span, see `merge_profile`.
    """
    parts = []
    for c in columns:
        parts.append(F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("number"),
                              F.col(c).cast("string").alias("value")))
    long = stream.select("ts", F.inline(F.array(*parts)))
    held = long.withWatermark("ts", delay).groupBy(F.window("ts", window), "variable").agg(
        F.count("*").alias("rows"), F.count("value").alias("filled"), F.min("number").alias("min"),
        F.max("number").alias("max"), F.sum("number").alias("total"), F.hll_sketch_agg("value").alias("sketch"))
    return held.select(F.col("window.start").alias("slice"), "variable", "rows", "filled", "min", "max", "total", "sketch")


def merge_profile(slices: DataFrame) -> DataFrame:
    return slices.groupBy("variable").agg(
        F.sum("rows").alias("rows"), F.sum("filled").alias("filled"), F.min("min").alias("min"),
        F.max("max").alias("max"), F.try_divide(F.sum("total"), F.sum("filled")).alias("mean"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))
