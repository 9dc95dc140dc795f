"""Derived inputs of the registered queries: the driver's tables, made messy or read as account tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def messy_customer(spark: SparkSession, folder: str) -> DataFrame:
    """Customer columns written as text in several locales, cases and null markers."""
    c = table(spark, folder, "customer")
    k = F.col("c_custkey")
    plain = F.format_string("%.2f", "c_acctbal")
    grouped = F.format_number("c_acctbal", 2)
    swapped = F.translate(grouped, ",.", ".,")
    balance = (F.when(k % 6 == 0, plain).when(k % 6 == 1, F.concat(F.lit("$"), grouped)).when(k % 6 == 2, swapped)
               .when(k % 6 == 3, F.concat(F.lit("€ "), F.translate(plain, ".", ","))).when(k % 6 == 4, "N/A")
               .otherwise(F.concat(F.lit("  "), plain, F.lit(" "))))
    seg = F.col("c_mktsegment")
    segment = (F.when(k % 9 == 0, "?").when(k % 4 == 0, F.concat(F.lit(" "), seg, F.lit("  ")))
               .when(k % 4 == 1, F.lower(seg)).when(k % 4 == 2, F.upper(seg)).otherwise(F.initcap(F.lower(seg))))
    mode = F.when(k % 3 == 0, "FULL-TIME").when(k % 3 == 1, "part-time").otherwise("Full-time")
    mixed = F.when(k % 5 == 0, "abc").otherwise((k % 97).cast("string"))
    return c.select("c_custkey", balance.alias("raw_balance"), segment.alias("raw_segment"), mode.alias("raw_mode"),
                    mixed.alias("raw_mixed"), F.lit("").alias("raw_blank"))


def messy_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Order rows with dates in four formats; every tenth key appears twice under a larger row id."""
    o = table(spark, folder, "orders")
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    text = (F.when(k % 5 == 0, F.date_format(d, "yyyy-MM-dd")).when(k % 5 == 1, F.date_format(d, "dd/MM/yyyy"))
            .when(k % 5 == 2, F.date_format(d, "yyyy/MM/dd")).when(k % 5 == 3, F.date_format(d, "MMM d yyyy"))
            .otherwise("?"))
    copies = F.when(k % 10 == 0, F.array(k, k + 1000000000)).otherwise(F.array(k))
    return o.select(F.explode(copies).alias("_row_id"), "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                    text.alias("raw_date"))


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Events as credit rows: purchases and signups grant, clicks and views spend, errors and zero amounts are no rows."""
    e = table(spark, folder, "events")
    size = F.when(F.ceil("value") > 0, F.ceil("value").cast("long"))
    delta = F.when(F.col("event_type").isin("purchase", "signup"), size).when(
        F.col("event_type").isin("click", "view"), -size)
    paid = F.col("event_type") == "purchase"
    return e.select("event_id", "ts", "user_id", F.col("event_type").alias("reason"), delta.alias("delta"),
                    F.when(paid, F.round("value", 2)).alias("amount_usd"),
                    F.when(paid, F.when(F.col("user_id") % 2 == 0, "paystack").otherwise("lemonsqueezy")).alias("gateway")
                    ).where("delta IS NOT NULL")


def audit(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", "ts", "user_id", F.col("event_type").alias("action"), "props")


def users(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.concat(F.lower("c_name"), F.lit("@mail.test")).alias("email"))


def enrolments(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as students of their nation; every seventh has left."""
    c = table(spark, folder, "customer")
    return c.select(F.col("c_custkey").alias("enrolment_id"), F.col("c_nationkey").cast("long").alias("class_id"),
                    F.col("c_custkey").alias("student_id"), (F.col("c_custkey") % 7 != 0).alias("is_active"))


def classes(spark: SparkSession, folder: str) -> DataFrame:
    """Nations as classes of their region; every sixth is closed."""
    n = table(spark, folder, "nation")
    return n.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("class_name"),
                    F.col("n_regionkey").cast("long").alias("lecturer_id"), F.upper(F.col("n_name")).alias("class_code"),
                    (F.col("n_nationkey") % 5 + 1).cast("long").alias("monthly_allowance"),
                    (F.col("n_nationkey") % 6 != 0).alias("is_active"))
