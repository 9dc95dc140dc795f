"""Running balances and spend replay against a fold over the rows."""

import random

import pyarrow as pa
import pytest

from statloom.operators import ledger, prefix


def frame(spark, rows):
    who, ts, event, delta = zip(*rows)
    return spark.createDataFrame(pa.table({"user_id": pa.array(who, pa.int64()), "ts": pa.array(ts, pa.timestamp("us", tz="UTC")), "event_id": pa.array(event, pa.int64()),
                                           "delta": pa.array(delta, pa.int64())}))


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2], r[3] is not None, r[3] or 0))


def replay(rows):
    out, now, balance = [], object(), 0
    for who, _, event, delta in in_order(rows):
        if who != now:
            now, balance = who, 0
        delta = delta or 0
        fits = delta >= 0 or balance + delta >= 0
        short = 0 if fits else -delta - balance
        balance += delta if fits else 0
        out.append((who, event, delta, balance, fits, short))
    return sorted(out, key=repr)


def random_rows(rng, n, hot, dips):
    rows = []
    for i in range(n):
        who = 7 if rng.random() < hot else rng.choice([None, 1, 2, 3, 4])
        ts = None if rng.random() < 0.05 else rng.randrange(0, 10**9) * 1000
        delta = rng.randrange(1, 60) if rng.random() < 0.5 else -rng.randrange(1, 55 if dips else 3)
        rows.append((who, ts, i, None if rng.random() < 0.02 else delta))
    return rows


@pytest.mark.parametrize("seed", range(5))
def test_replay_in_units(spark, monkeypatch, seed):
    monkeypatch.setattr(prefix, "UNIT_BITS", [1, 2, 3, 14, 4][seed])
    rows = random_rows(random.Random(seed), 400, [0.0, 0.5, 0.9, 0.5, 0.4][seed], seed != 4)
    got = ledger.replay_by_need(frame(spark, rows)).select("user_id", "event_id", "delta", "balance", "accepted", "shortfall")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == replay(rows)


def test_only_doubtful_rows_are_folded(spark, monkeypatch):
    """A long account that dips once: one unit is folded row by row, the others are a sum each."""
    monkeypatch.setattr(prefix, "UNIT_BITS", 4)
    seen = spark.sparkContext.accumulator(0)
    whole = ledger._starts

    def counting(batches):
        def told():
            for b in batches:
                seen.add(sum(not x for x in b.column(3).to_pylist()))
                yield b
        return whole(told())

    monkeypatch.setattr(ledger, "_starts", counting)
    rows = [(1, i * 10**6, i, 5 if i % 2 == 0 else -4) for i in range(2000)]
    rows[1001] = (1, 1001 * 10**6, 1001, -10_000)
    got = ledger.replay_by_need(frame(spark, rows)).select("user_id", "event_id", "delta", "balance", "accepted", "shortfall")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == replay(rows)
    assert 0 < seen.value <= 200


def test_equal_rows_are_spread(spark, monkeypatch):
    monkeypatch.setattr(prefix, "UNIT_BITS", 2)
    rows = [(1, 1000, 5, 3)] * 60 + [(1, 1000, 5, -7)] * 40
    got = ledger.replay_by_need(frame(spark, rows)).select("user_id", "event_id", "delta", "balance", "accepted", "shortfall")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == replay(rows)


def test_rows_without_time_or_account(spark):
    rows = [(1, 5_000_000, 1, 5), (1, None, 2, 7), (None, 1_000_000, 3, 2), (None, None, 4, 1), (None, 2_000_000, 5, None)]
    got = {r["event_id"]: r["balance"] for r in ledger.running_balance(frame(spark, rows)).collect()}
    assert got == {2: 7, 1: 12, 4: 1, 3: 3, 5: 3}
    stored = frame(spark, rows).withColumnRenamed("delta", "d").selectExpr("*", "CASE event_id WHEN 2 THEN 7 WHEN 1 THEN 12 WHEN 4 THEN 1 WHEN 3 THEN 3 ELSE 4 END AS stored")
    assert [r["event_id"] for r in ledger.audit_balances(stored, "stored", "user_id", "ts", ["event_id"], "d").collect()] == [5]
    quota = {r["event_id"]: r["used"] for r in ledger.daily_quota(frame(spark, rows), "user_id", "ts", ["event_id"], 1).collect()}
    assert quota == {1: 1, 2: 1, 3: 1, 5: 2, 4: 1}


def test_keys_of_other_types(spark):
    rows = spark.createDataFrame([("a", True, 1.5, 1), (None, None, None, 2), ("", False, 0.0, 4), ("a", True, 1.5, 8)], "s string, b boolean, d double, v long").selectExpr(
        "*", "struct(s, v % 2 AS m) AS t", "CAST('2024-01-01' AS timestamp) AS ts")
    for keys in (["s"], ["b"], ["d"], ["s", "b", "d"]):
        got = {r["v"]: r["sum"] for r in prefix.running_sum(rows, keys, "ts", ["v"], rows["v"], "sum").collect()}
        assert got == {1: 1, 2: 2, 4: 4, 8: 9}
    assert len(prefix.running_sum(rows, ["t"], "ts", ["v"], rows["v"], "sum").collect()) == 4
