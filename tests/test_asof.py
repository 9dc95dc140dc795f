"""As-of lookups against a loop, and JSON of unlike shapes."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from statloom.operators import accounts, ledger, profile
from statloom.operators.asof import last_known
from statloom.sources import sinks


def frame(spark, **columns):
    kinds = {"k": pa.int64(), "ts": pa.timestamp("us", tz="UTC"), "i": pa.int64(), "v": pa.string()}
    return spark.createDataFrame(pa.table({c: pa.array(x, kinds[c]) for c, x in columns.items()}))


@pytest.mark.parametrize("bucket", ["minute", "day", "year"])
def test_last_known(spark, bucket):
    rng = random.Random(1)

    def ts():
        return None if rng.random() < 0.1 else rng.randrange(10) * 3_600_000_000 * 7 + rng.randrange(3) * 60_000_000

    def key():
        return 1 if rng.random() < 0.5 else rng.choice([None, 2, 3])

    asked = [(key(), ts(), i) for i in range(120)]
    told = [(key(), ts(), i, rng.choice([None, f"v{i}"])) for i in range(80)]
    got = last_known(frame(spark, k=[a[0] for a in asked], ts=[a[1] for a in asked], i=[a[2] for a in asked]),
                     frame(spark, k=[t[0] for t in told], ts=[t[1] for t in told], i=[t[2] for t in told], v=[t[3] for t in told]), ["k"], "ts", ["v"], ["i"], bucket)
    assert got.columns == ["k", "ts", "i", "v"]
    want = {}
    for k, at, i in asked:
        older = [(t, n, v) for key_, t, n, v in told if key_ == k and t is not None and at is not None and t <= at]
        want[i] = max(older)[2] if older else None
    assert {r["i"]: r["v"] for r in got.collect()} == want


def test_due_on_days(spark):
    enrolments = spark.createDataFrame([(1, 10, 100, True), (2, 10, 200, True), (3, 11, 300, True), (4, 10, 400, False)], "enrolment_id long, class_id long, student_id long, is_active boolean")
    classes = spark.createDataFrame([(10, 5, True), (11, 5, False)], "id long, monthly_allowance long, is_active boolean")
    grants = spark.createDataFrame([(100, "2024-01-01"), (100, "2024-02-20"), (200, "2024-05-01")], "student_id long, t string").select("student_id", F.col("t").cast("timestamp").alias("last_allowance_at"))
    got = ledger.due_on_days(enrolments, classes, grants, ["2024-01-15", "2024-01-31", "2024-03-01", "2024-03-21"]).collect()
    assert sorted((str(r["day"])[:10], r["student_id"]) for r in got) == [("2024-01-15", 200), ("2024-01-31", 100), ("2024-01-31", 200), ("2024-03-01", 200), ("2024-03-21", 100), ("2024-03-21", 200)]


def test_variants(spark):
    rows = spark.createDataFrame([("a", '{"k": 3, "x": [1]}'), ("a", '{"k": "three"}'), ("b", "no json"), ("b", None), ("b", "{}"), ("b", "[1, 2]")], "action string, d string")
    assert [r["k"] for r in accounts.audit_details(rows, "action", "d", {"k": "bigint"}).collect()] == [3, None, None, None, None, None]
    fields = {tuple(r) for r in accounts.detail_fields(rows.where("d LIKE '{%'"), "action", "d").collect()}
    assert {("a", "k", "BIGINT", 1), ("a", "k", "STRING", 1), ("a", "x", "ARRAY<BIGINT>", 1)} <= fields
    back = sinks.read_variants(rows.withColumnRenamed("d", "results"))
    shapes = {(r["action"], r["shape"]): r["n"] for r in sinks.result_shapes(back, by=["action"]).collect()}
    assert shapes["b", None] == 2 and shapes["b", "ARRAY<BIGINT>"] == 1


def test_frequent_values(spark):
    """A value in a third of the rows among near-unique ones is certain; where counts are close the answer says so."""
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, "warm").when(F.col("id") % 11 == 1, "mild").otherwise(F.concat(F.lit("u"), F.col("id"))).alias("a.b"),
                                    F.concat(F.lit("v"), F.col("id") % 20_000).alias("even"), (F.col("id") % 5).alias("n"), F.lit(None).cast("string").alias("none"))
    got = {r["variable"]: (r["top"], r["decided"]) for r in profile.frequent_values(df, ["a.b", "even", "n", "none"]).collect()}
    assert got["a.b"] == ("hot, warm, mild", True) and got["n"] == ("0, 1, 2", True)
    assert not got["even"][1] and got["none"] == (None, True)
