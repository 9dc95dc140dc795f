"""Stateful jobs in event time: rows wait in keyed state until the watermark has passed their slice of time, then are folded in order.

State lives in RocksDB, off the heap. Every call of the state is a message to the JVM, so a key's rows wait together, in chunks, and one
timer, that of its earliest slice, wakes the key: calls grow with keys and chunks, not with slices. Of a key with more than `HELD` waiting
rows the further ones wait slice by slice; a call then holds `HELD` rows and one slice, whatever the key has. The watermark, not batches,
decides when a slice is finished, so the result does not depend on how rows are dealt into files or batches. A key without waiting
rows keeps only what its fold needs, and that is dropped as soon as time alone decides.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from statloom import fixed_values as fv

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows that are kept as one value of the state, and result rows that leave together.
CHUNK = 4096
#: Rows of a key that wait together; those beyond wait by slices.
HELD = 131_072
#: The place of rows that wait together, before any slice, and the time of a timer that is not set.
TOGETHER, NEVER = -1 << 62, (1 << 63) - 1


def use_rocksdb(spark: SparkSession) -> None:
    """Keep streaming state in RocksDB, which keyed state with timers needs; a session that names a provider keeps it."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(key, ""):
        spark.conf.set(key, PROVIDER)


class InTime(StatefulProcessor):
    """Rows (us, id, amount) of a key wait until their slice of `slice_ms` milliseconds is over; `fold` gets them in order, in one or more calls."""

    def __init__(self, slice_ms: int):
        self.slice_ms = slice_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # chunks and rows that wait together, slices that wait apart, and the timer that wakes the key
        self.waiting = handle.getValueState("waiting", "chunks int, held long, slices int, due long")
        self.sizes = handle.getMapState("sizes", "slice long", "chunks int")
        self.rows = handle.getMapState("rows", "slice long, chunk int", "us binary, id binary, amount binary")
        self.memory = handle.getValueState("memory", "value long")

    def _slices(self, rows: np.ndarray) -> np.ndarray:
        return rows[0] // (self.slice_ms * 1000)

    def _add(self, at: int, chunks: int, rows: np.ndarray) -> int:
        """Put rows behind the chunks of a place; the new number of chunks."""
        for i in range(0, rows.shape[1], CHUNK):
            self.rows.updateValue((at, chunks), tuple(x.tobytes() for x in rows[:, i:i + CHUNK]))
            chunks += 1
        return chunks

    def _read(self, at: int, chunks: int) -> np.ndarray:
        parts = [np.stack([np.frombuffer(x, "int64") for x in self.rows.getValue((at, i))]) for i in range(chunks)]
        return np.concatenate(parts, axis=1) if parts else np.empty((3, 0), "int64")

    def _remove(self, at: int, chunks: int) -> None:
        for i in range(chunks):
            self.rows.removeKey((at, i))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chunks, held, slices, due = known = self.waiting.get() or (0, 0, 0, NEVER)
        for part in _gathered(rows):
            own = self._slices(part)
            first = (int(own.min()) + 1) * self.slice_ms
            if first < due:
                self.handle.registerTimer(due := first)
            if held + part.shape[1] <= HELD:
                chunks, held = self._add(TOGETHER, chunks, part), held + part.shape[1]
                continue
            order = np.argsort(own, kind="stable")
            places, starts = np.unique(own[order], return_index=True)
            for at, some in zip(places.tolist(), np.split(part[:, order], starts[1:], axis=1)):
                there = self.sizes.getValue((at,))
                slices += not there
                self.sizes.updateValue((at,), (self._add(at, there[0] if there else 0, some),))
        if (chunks, held, slices, due) != tuple(known):
            self.waiting.update((chunks, held, slices, due))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # the watermark may have passed many slices since; without it the timer tells the time
        now = timerValues.getCurrentWatermarkInMs() if timerValues else expiredTimerInfo.getExpiryTimeInMs()
        chunks, held, slices, due = self.waiting.get() or (0, 0, 0, NEVER)
        if due <= now:
            yield from self._finish(key, chunks, held, slices, now)
        self.forget(now)

    def _finish(self, key, chunks: int, held: int, slices: int, now: int) -> Iterator[pd.DataFrame]:
        """Fold the rows of all slices that are over, and set the timer of the first one that is not."""
        end = now // self.slice_ms
        together = self._read(TOGETHER, chunks)
        over = self._slices(together) < end
        ready, later = together[:, over], together[:, ~over]
        if ready.shape[1]:
            self._remove(TOGETHER, chunks)
            chunks, held = self._add(TOGETHER, 0, later), later.shape[1]
        places = sorted(at for at, in self.sizes.keys()) if slices else []
        for at in [at for at in places if at < end]:
            n = self.sizes.getValue((at,))[0]
            upto = self._slices(ready) <= at
            yield from self._folded(key, np.concatenate([ready[:, upto], self._read(at, n)], axis=1), now)
            self._remove(at, n)
            self.sizes.removeKey((at,))
            ready = ready[:, ~upto]
        if ready.shape[1]:
            yield from self._folded(key, ready, now)
        places = [at for at in places if at >= end]
        left = places[:1] + ([int(self._slices(later).min())] if later.shape[1] else [])
        if left:
            due = (min(left) + 1) * self.slice_ms
            self.handle.registerTimer(due)
            self.waiting.update((chunks, held, len(places), due))
        else:
            self.waiting.clear()

    def _folded(self, key, rows: np.ndarray, now: int) -> Iterator[pd.DataFrame]:
        order = np.lexsort(rows[::-1])
        return self.fold(key, list(zip(*rows[:, order].tolist())), now)

    def fold(self, key, rows: list[tuple[int, int, int]], now: int) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def forget(self, now: int) -> None:
        """What the fold remembers may go when time alone decides."""

    def close(self) -> None:
        pass


def _gathered(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
    """The real rows of a key's batches, `HELD` or a batch more at a time."""
    parts, n = [], 0
    for pdf in batches:
        parts.append(np.stack([pdf[c].to_numpy("int64") for c in ("us", "id", "amount")])[:, pdf["real"].to_numpy(bool)])
        n += parts[-1].shape[1]
        if n >= HELD:
            yield np.concatenate(parts, axis=1)
            parts, n = [], 0
    if n:
        yield np.concatenate(parts, axis=1)


class Spends(InTime):
    """A spend is accepted while the balance covers it."""

    def fold(self, key, rows, now):
        balance = (self.memory.get() or (0,))[0]
        out = []
        for us, event, delta in rows:
            fits = delta >= 0 or balance + delta >= 0
            balance += delta if fits else 0
            out.append((key[0], event, us, delta, balance, fits))
            if len(out) == CHUNK:
                yield pd.DataFrame(out, columns=_SPENDS)
                out = []
        self.memory.update((balance,))
        if out:
            yield pd.DataFrame(out, columns=_SPENDS)


class Grants(InTime):
    """A grant at the first activity, and at the first one after the period of whole seconds since the last grant."""

    def __init__(self, slice_ms: int, period_ms: int):
        super().__init__(slice_ms)
        self.period_ms = period_ms

    def _over(self, second: int) -> int:
        """The end of the slice with which the period of a grant is over."""
        return -(-(second * 1000 + self.period_ms) // self.slice_ms) * self.slice_ms

    def fold(self, key, rows, now):
        last = (self.memory.get() or (None,))[0]
        out = []
        for us, _, _ in rows:
            second = us // 1_000_000
            if last is None or (second - last) * 1000 >= self.period_ms:
                last = second
                out.append((key[0], us))
        if out:
            self.memory.update((last,))
            if self._over(last) > now:  # otherwise it is forgotten at once
                self.handle.registerTimer(self._over(last))
            yield pd.DataFrame(out, columns=["enrolment", "us"])

    def forget(self, now):
        # every later activity is granted, so nothing has to be remembered
        last = self.memory.get()
        if last and now >= self._over(last[0]):
            self.memory.clear()


_SPENDS = ["user_id", "event_id", "us", "delta", "balance", "accepted"]


def _waiting(df: DataFrame, delay: str, key: str, real: Column, event: Column, amount: Column) -> DataFrame:
    """Rows as the processors take them. Those that are not `real` only tell how far time has come: were they filtered out, the filter would
    move below the watermark."""
    none = F.lit(0).cast("long")
    return df.withWatermark("ts", delay).select(
        F.col(key).cast("long").alias("key"), "ts", F.coalesce(F.unix_micros("ts"), none).alias("us"), F.coalesce(event.cast("long"), none).alias("id"),
        F.coalesce(amount.cast("long"), none).alias("amount"), (real & F.col("ts").isNotNull()).alias("real"))


def spends_in_time(ledger: DataFrame, delay: str = "1 day", slice_minutes: int = 60) -> DataFrame:
    """Ledger rows (user_id, event_id, ts, delta) with the balance after each and whether it was accepted.

    Every row is decided once the watermark (`delay` behind the newest row) has passed its slice, in order of (ts, event_id); rows
    that come later are dropped. Rows without time or delta are left out.
    """
    use_rocksdb(ledger.sparkSession)
    rows = _waiting(ledger, delay, "user_id", F.col("delta").isNotNull(), F.col("event_id"), F.col("delta"))
    out = rows.groupBy("key").transformWithStateInPandas(
        Spends(slice_minutes * 60_000), "user_id long, event_id long, us long, delta long, balance long, accepted boolean", "Append", "EventTime")
    return out.select("user_id", "event_id", F.timestamp_micros("us").alias("ts"), "delta", "balance", "accepted")


def grants_in_time(activity: DataFrame, key: str, days: int = fv.ALLOWANCE_PERIOD_DAYS, delay: str = "1 day", slice_minutes: int = 60) -> DataFrame:
    """(enrolment, granted_at) as the allowance rule gives them, decided slice by slice as the watermark passes; what an enrolment's last grant
    blocks is forgotten by a timer when its period is over."""
    use_rocksdb(activity.sparkSession)
    rows = _waiting(activity, delay, key, F.col(key).isNotNull(), F.lit(0), F.lit(0))
    out = rows.groupBy("key").transformWithStateInPandas(Grants(slice_minutes * 60_000, days * 86_400_000), "enrolment long, us long", "Append", "EventTime")
    return out.select("enrolment", F.timestamp_micros("us").alias("granted_at"))
