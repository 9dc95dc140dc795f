import os

import duckdb
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from statloom.catalog import streams
from statloom.streaming import jobs, profiles, timed


def write(spark, folder, rows):
    df = spark.createDataFrame(rows, "event_id long, user_id long, t string, value double")
    df.withColumn("ts", F.col("t").cast("timestamp")).drop("t").coalesce(1).write.mode("append").parquet(str(folder))


@pytest.fixture
def stream(spark, tmp_path):
    """Four files read one per micro-batch; the last holds a row far behind the watermark."""
    folder = tmp_path / "events"
    write(spark, folder, [(1, 1, "2024-01-01 10:00:00", 1.0), (2, 1, "2024-01-01 11:00:00", 2.0)])
    write(spark, folder, [(3, 1, "2024-01-05 10:00:00", 3.0)])
    write(spark, folder, [(6, 3, "2024-01-05 11:00:00", 3.0)])
    write(spark, folder, [(4, 1, "2024-01-01 12:00:00", 9.0), (5, 2, "2024-01-08 10:00:00", 4.0)])
    schema = spark.read.parquet(str(folder)).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_late_rows_are_dropped(stream):
    out = jobs.drain(jobs.daily_quota(stream, "user_id", 1)).collect()
    got = {(r["user_id"], str(r["day"])[:10]): (r["used"], r["over"]) for r in out}
    assert got == {(1, "2024-01-01"): (2, True), (1, "2024-01-05"): (1, False), (3, "2024-01-05"): (1, False)}


def test_late_rows_within_delay_count(stream):
    out = jobs.drain(jobs.daily_quota(stream, "user_id", 1, delay="5 days")).collect()
    assert {(str(r["day"])[:10], r["used"]) for r in out} == {("2024-01-01", 3)}


def test_spend_keeps_balance_between_batches(spark, stream):
    ledger = stream.select("user_id", "event_id", "ts", F.when(F.col("event_id") == 1, 10).otherwise(-6).alias("delta"))
    out = {r["event_id"]: (r["balance"], r["accepted"]) for r in jobs.drain(jobs.spend_decisions(ledger)).collect()}
    assert out[1] == (10, True) and out[2] == (4, True) and out[3] == (4, False) and out[5] == (0, False)


def test_repeated_payment_is_taken_once(spark, tmp_path):
    body = '{"event":"charge.success","data":{"reference":"r1","metadata":{"user_id":"7","pack_id":"pack_5","amount_usd":5}}}'
    other = '{"meta":{"event_name":"order_created","custom_data":{"user_id":"8","pack_id":"pack_15","amount_usd":13}},"data":{"id":"r1"}}'
    bad = ['{"event":"charge.failed","data":{"reference":"r2"}}', '{"meta":{"event_name":"order_refunded"},"data":{"id":"x"}}', "no json"]
    folder = str(tmp_path / "p")
    rows = [("2024-01-01 10:00:00", b) for b in [body, body, other, *bad]]
    spark.createDataFrame(rows, "t string, body string").withColumn("ts", F.col("t").cast("timestamp")).drop("t").write.parquet(folder)
    src = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    out = jobs.drain(jobs.payment_events(src, "body")).toPandas().sort_values("gateway")
    assert list(out["gateway"]) == ["lemonsqueezy", "paystack"] and list(out["user_id"]) == ["8", "7"]
    src = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    assert jobs.drain(jobs.payment_events(src, "body", once=False)).count() == 3


def test_allowance_period(spark, tmp_path):
    folder = str(tmp_path / "e")
    days = ["2024-01-01", "2024-01-20", "2024-01-31", "2024-02-15", "2024-03-01"]
    pdf = pd.DataFrame({"user_id": [5] * 5, "ts": pd.to_datetime(days)})
    spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(folder)
    src = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    out = jobs.drain(jobs.allowance_grants(src, "user_id")).orderBy("granted_at").collect()
    assert [str(r["granted_at"])[:10] for r in out] == ["2024-01-01", "2024-01-31", "2024-03-01"]


def test_profile_slices_merge(stream):
    r = jobs.merge_profile(jobs.drain(jobs.profile_increments(stream, ["value"], delay="0 seconds"))).first()
    assert (r["rows"], r["min"], r["max"], r["distinct"]) == (4, 1.0, 3.0, 3)


@pytest.mark.parametrize("name", ["stream_daily_quota", "stream_sessions", "stream_sliding_activity", "stream_spend", "stream_payments",
                                  "stream_allowances", "stream_profile", "stream_profile_kept"])
def test_table_in_many_files_out_of_order(spark, folder, tmp_path, name):
    rows = pq.read_table(f"{folder}/events.parquet").sort_by("ts")
    parts = tmp_path / "events.parquet"
    parts.mkdir()
    size = len(rows) // 40 + 1
    for i in range(40):  # each file a stretch of time; neither names nor modification times follow it
        part = parts / f"part-{i * 7 % 40:05}.parquet"
        pq.write_table(rows.slice(i * size, size), part)
        os.utime(part, (1_700_000_000 - i * 60,) * 2)
    query, sql = streams.QUERIES[name]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{parts}/*.parquet'")
    want = con.execute(sql).fetch_df()
    got = query(spark, str(tmp_path)).toPandas()[list(want.columns)]

    def cells(pdf):
        return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in pdf.itertuples(index=False))

    assert len(got) and cells(got) == cells(want)


def ordered_files(spark, folder, rows, n):
    """`rows` (event_id, user_id, t, value) dealt into n files in order of time, read one per batch."""
    for i in range(n):
        write(spark, folder, rows[i * len(rows) // n:(i + 1) * len(rows) // n])
    schema = spark.read.parquet(str(folder)).schema
    return schema, lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_spends_wait_for_their_time(spark, tmp_path):
    """Rows within a batch come in any order, rows of a later file may be older within the delay; a key is many slices; timers decide."""
    rows = [(i, i % 2, f"2024-01-0{1 + i // 24} {i % 24:02d}:{59 - i % 60:02d}:00", 0.0) for i in range(72)]
    rows[10], rows[30] = rows[30], rows[10]
    schema, read = ordered_files(spark, tmp_path / "e", rows, 4)
    stream = read().select("user_id", "event_id", "ts", F.when(F.col("event_id") % 3 == 0, 7).otherwise(-5).alias("delta"))
    out = jobs.drain(timed.spends_in_time(stream, "2 days", 30)).collect()
    want, balance = [], {0: 0, 1: 0}
    for event, who, ts, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        delta = 7 if event % 3 == 0 else -5
        fits = delta > 0 or balance[who] + delta >= 0
        balance[who] += delta if fits else 0
        want.append((event, balance[who], fits))
    got = sorted((r["event_id"], r["balance"], r["accepted"]) for r in out)
    # slices that the watermark has not passed stay in the state
    assert 20 <= len(got) < 72 and set(got) <= set(want)


def test_a_grant_is_forgotten_when_its_period_is_over(monkeypatch):
    """State of an enrolment: what waits, and the last grant until a timer says that any activity is granted."""
    class Value:
        def __init__(self):
            self.v = None

        def exists(self):
            return self.v is not None

        def get(self):
            return self.v

        def update(self, v):
            self.v = v

        def clear(self):
            self.v = None

    class Map(dict):
        def getValue(self, k):
            return self.get(k)

        def updateValue(self, k, v):
            self[k] = v

        def removeKey(self, k):
            del self[k]

    class Handle:
        def __init__(self):
            self.timers = set()

        def getMapState(self, *_):
            return Map()

        def getValueState(self, *_):
            return Value()

        def registerTimer(self, t):
            self.timers.add(t)

    class Now:
        def __init__(self, t):
            self.t = t

        def getExpiryTimeInMs(self):
            return self.t

    hour, day = 3_600_000, 86_400_000
    grants = timed.Grants(hour, 7 * day + 1000)
    grants.init(handle := Handle())
    at = [0, 5 * day, 7 * day, 7 * day + 500, 7 * day + 1000, 7 * day + 2000, 30 * day]
    rows = pd.DataFrame({"us": [a * 1000 for a in reversed(at)], "id": 0, "amount": 0, "real": True})
    assert list(grants.handleInputRows((1,), iter([rows.iloc[:3], rows.iloc[3:]]), None)) == []
    out = []
    while handle.timers:
        now = min(handle.timers)
        handle.timers.remove(now)
        out += [u // 1000 for pdf in grants.handleExpiredTimer((1,), None, Now(now)) for u in pdf["us"]]
    assert out == [0, 7 * day + 1000, 30 * day]
    assert not grants.sizes and not grants.rows and not grants.memory.exists()


def test_a_repeated_batch_counts_once(spark, tmp_path):
    folder = str(tmp_path / "p")
    batches = [spark.range(a, b).select(F.col("id"), (F.col("id") % 7).cast("double").alias("v")) for a, b in ((0, 50), (50, 120), (120, 121))]
    assert profiles.read_profile(spark, folder).collect() == []
    for batch_id in (0, 1, 1, 2, 2, 2):
        profiles.merge_batch(batches[batch_id], batch_id, ["id", "v"], folder)
    got = {r["variable"]: tuple(r)[1:] for r in profiles.read_profile(spark, folder).collect()}
    assert got == {"id": (121, 121, 0.0, 120.0, 60.0, 121), "v": (121, 121, 0.0, 6.0, pytest.approx(sum(i % 7 for i in range(121)) / 121), 7)}
    assert len(profiles.versions(spark, folder)) <= 3


class Calls:
    """A handle whose states are dicts, counting the messages a real one would send."""

    def __init__(self):
        self.n, self.timers, self.states = 0, set(), []

    def registerTimer(self, t):
        self.n += 1
        self.timers.add(t)

    def getValueState(self, *_):
        return self._state()

    getMapState = getValueState

    def _state(self):
        calls, held = self, {}
        self.states.append(held)

        class State:
            def get(self, key=None):
                calls.n += 1
                return held.get(key)

            getValue = get

            def update(self, value):
                self.updateValue(None, value)

            def updateValue(self, key, value):
                calls.n += 1
                held[key] = value

            def removeKey(self, key):
                calls.n += 1
                held.pop(key, None)

            def clear(self):
                self.removeKey(None)

            def exists(self):
                calls.n += 1
                return None in held

            def keys(self):
                calls.n += 1
                return iter(list(held))

        return State()


class At:
    def __init__(self, t):
        self.t = t

    def getExpiryTimeInMs(self):
        return self.t

    getCurrentWatermarkInMs = getExpiryTimeInMs


def driven(processor, batches):
    """The rows a processor gives for one key's batches (us, id, amount), each followed by its watermark; and the handle."""
    processor.init(handle := Calls())
    out = []
    for rows, watermark in batches:
        pdf = pd.DataFrame(rows, columns=["us", "id", "amount"]).assign(real=True)
        processor.handleInputRows((1,), iter([pdf.iloc[i:i + 7] for i in range(0, len(pdf), 7)]), At(watermark))
        while due := [t for t in handle.timers if t <= watermark]:
            handle.timers.remove(min(due))
            for pdf in processor.handleExpiredTimer((1,), At(watermark), At(min(due))):
                out += pdf.values.tolist()
    return out, handle


def granted(rows, period_us):
    out = []
    for us in sorted(r[0] for r in rows):
        if not out or us // 1_000_000 * 1_000_000 - out[-1] // 1_000_000 * 1_000_000 >= period_us:
            out.append(us)
    return out


HOUR = 3_600_000


def test_a_keys_grants_take_few_state_calls():
    rows = [(i * HOUR * 1000 + 5, 0, 0) for i in range(600)]
    out, handle = driven(timed.Grants(HOUR, 7 * 24 * HOUR), [(rows[::-1], 5000 * HOUR)])
    assert [us for _, us in out] == granted(rows, 7 * 24 * HOUR * 1000)
    assert handle.n < 20 and not any(handle.states)


def test_a_keys_spends_take_few_state_calls_and_many_rows_wait_by_slices(monkeypatch):
    rows = [(i * HOUR * 400 + i % 3, i % 50, 7 if i % 3 == 0 else -5) for i in range(600)] + [(0, 1, 4), (0, 1, 4)]
    want, balance = [], 0
    for us, event, delta in sorted(rows):
        fits = delta >= 0 or balance + delta >= 0
        balance += delta if fits else 0
        want.append([1, event, us, delta, balance, fits])
    mixed = sorted(rows, key=lambda r: (r[0] * 7919 + r[2]) % 1009)
    out, handle = driven(timed.Spends(HOUR), [(mixed, 5000 * HOUR)])
    assert out == want and handle.n < 20
    monkeypatch.setattr(timed, "HELD", 40)
    monkeypatch.setattr(timed, "CHUNK", 9)
    # the watermark passes half of the slices, more rows come, then time is over
    late = [r for r in mixed if r[0] >= 120 * HOUR * 1000]
    early = [r for r in mixed if r[0] < 120 * HOUR * 1000]
    for batches in ([(mixed, 5000 * HOUR)], [(early + late[:150], 120 * HOUR), (late[150:], 160 * HOUR + 5), ([], 5000 * HOUR)]):
        out, handle = driven(timed.Spends(HOUR), batches)
        assert out == want
        # only the balance stays
        assert [len(s) for s in handle.states] == [0, 0, 0, 1]
