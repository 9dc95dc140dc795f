"""Session settings and the one place where lineage is cut."""

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_settled: list[str] = []


def local_session(app: str = "statloom", cores: str = "*", partitions: int = 8, folder: str | None = None) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own. `folder` takes the written intermediates."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if folder:
        builder = builder.config("spark.checkpoint.dir", folder)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    A session on one machine that names none gets a folder below its warehouse; on a cluster that is an error, because
    a folder of the driver's own machine would be empty for the executors.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master == "local" or master.startswith("local["):
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_settled"
    raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")


def settle(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared checkpoint folder and go on from the written table.

    Later jobs neither recompute it nor lose it with an executor, and read only the columns they need.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _settled.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """`df` written once with its rows dealt evenly over the cores.

    A scan has as many tasks as its files have splits, and a small compressed file is one split however many rows it holds; passes that
    work hard on every row and shuffle none would run in that one task.
    """
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return settle(df.repartition(parts))


def discard_settled(spark: SparkSession) -> int:
    """Delete the tables written by `settle` in this process; call it once their results are stored. Gives their number."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    n = len(_settled)
    while _settled:
        path = jvm.org.apache.hadoop.fs.Path(_settled.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few driver-side rows as a local relation, planned without an RDD."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [part.split() for part in schema.split(", ")]
    columns = [pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names=[name for name, _ in fields]))
