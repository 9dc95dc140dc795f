"""Repeated word windows across documents: windows repeated at half the length are extended to the whole one."""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.llm.common import letters, maybe_in, rows_of, settle, word_chunks

#: Odd multipliers of the two window hashes; a window's identity is 128 bits.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_WORD = 1 << 64


def word_hashes(text: bytes) -> np.ndarray:
    """Two 64-bit hashes per word, one row each."""
    parts = [b"".join(map(xxhash.xxh3_128_digest, words)) for words in word_chunks(text)]
    return np.frombuffer(b"".join(parts), "<u8").reshape(-1, 2).T


class Windows:
    """Hashes of arbitrary word windows of one text, from running sums of hash times base to the position."""

    def __init__(self, text: bytes):
        self.hashes = word_hashes(text)
        self.n = self.hashes.shape[1]
        self.sums, self.down = [], []
        for row, base in zip(self.hashes, BASES, strict=True):
            up, down = powers(base, self.n), powers(pow(base, -1, _WORD), self.n)
            self.sums.append(np.r_[np.uint64(0), np.cumsum(row * up, dtype=np.uint64)])
            self.down.append(down)

    def hash(self, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        """Mixed hash of words [start, end)."""
        return mix((self.sums[which][end] - self.sums[which][start]) * self.down[which][start])


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 15, 1 << (n - 1).bit_length()) if n else 1 << 15
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if size <= 1 << 20:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads all bits of a hash over all bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def anchors(seeds: np.ndarray, span: int) -> np.ndarray:
    """For every run of `span` consecutive seeds, the position of its smallest (the first of equals).

    The choice depends on the run's content only, so equal windows choose the same place, whatever surrounds them.
    """
    at = np.empty(len(seeds) - span + 1, np.int64)
    for a in range(0, len(at), 1 << 15):
        part = np.lib.stride_tricks.sliding_window_view(seeds[a:a + (1 << 15) + span - 1], span)
        part = part[: len(at) - a]
        at[a:a + len(part)] = part.argmin(axis=1) + np.arange(a, a + len(part))
    return at


_PIECES = pa.schema([("anchor", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("id", pa.int64()), ("mark", pa.int32()),
                     ("start", pa.int32()), ("windows", pa.int16())])


def pieces(text: bytes, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of `length` words that share an anchor: (anchor hash, two hashes of all words of the run, first
    window, number of windows). An anchor is the half-length window of smallest hash in a window."""
    w = Windows(text)
    half = length // 2
    if w.n < length:
        return tuple(np.empty(0, np.uint64) for _ in range(3)) + (np.empty(0, np.int64),) * 2
    starts = np.arange(w.n - half + 1)
    seeds = w.hash(starts, starts + half, 0)
    at = anchors(seeds, length - half + 1)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    after = np.r_[first[1:], len(at)]
    end = after - 1 + length
    return seeds[at[first]], w.hash(first, end, 0), w.hash(first, end, 1), first, after - first


def _pieces(length):
    def run(batches):
        held, n = [], 0
        for id_, mark, text in rows_of(batches, "id", "mark", "text"):
            anchor, s1, s2, start, count = pieces(text, length)
            if len(anchor):
                held.append((anchor, s1, s2, np.full(len(anchor), id_), np.full(len(anchor), mark), start, count))
                n += len(anchor)
            if n >= 1 << 16:
                yield _columns(held, _PIECES)
                held, n = [], 0
        if held:
            yield _columns(held, _PIECES)

    return run


def _columns(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    arrays = [np.concatenate(c).astype(f.type.to_pandas_dtype()) for c, f in zip(zip(*held, strict=True), schema, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(a, f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)


_WINDOWS = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("id", pa.int64()), ("mark", pa.int32()), ("start", pa.int32())])


def _extended(length):
    """Every window of the listed runs, at the whole length."""

    def run(batches):
        held, n = [], 0
        for id_, mark, text, runs in rows_of(batches, "id", "mark", "text", "runs"):
            w = Windows(text)
            start = np.unique(np.concatenate([np.arange(r["start"], r["start"] + r["windows"]) for r in runs]))
            for a in range(0, len(start), 1 << 16):
                s = start[a:a + (1 << 16)]
                held.append((w.hash(s, s + length, 0), w.hash(s, s + length, 1), np.full(len(s), id_), np.full(len(s), mark), s))
                n += len(s)
                if n >= 1 << 16:
                    yield _columns(held, _WINDOWS)
                    held, n = [], 0
        if held:
            yield _columns(held, _WINDOWS)

    return run


def repeated_runs(df: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """Runs of windows to remove: (id, mark, start, windows), `mark` telling rows of one id with different texts apart."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.hash(text_col).alias("mark"), F.col(text_col).alias("text")).where(
        F.col("id").isNotNull() & F.col("text").isNotNull())
    found = settle(docs.mapInArrow(_pieces(length), "anchor long, s1 long, s2 long, id long, mark int, start int, windows short"))
    # level one: half-length windows that more than one document has
    ends = found.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("anchor")
    # written first: both sides of the join are then shuffled, and AQE can split a hot anchor
    live = settle(found.join(settle(ends), "anchor", "left_semi").drop("anchor"))
    # whole runs that a smaller id has go; of equal runs the smallest id's goes on, which keeps every window's smallest holder
    holders = live.groupBy("s1", "s2").agg(F.min("id").alias("low"))
    holders = live.join(settle(holders), ["s1", "s2"])
    holders = settle(holders.select("id", "mark", "start", "windows", "low"))
    whole = holders.where("low < id").select("id", "mark", "start", "windows")
    # level two: the runs that are left, extended to all their windows of the whole length
    runs = settle(holders.where("low = id").groupBy("id", "mark").agg(F.collect_list(F.struct("start", "windows")).alias("runs")))
    texts = maybe_in(docs, "id", runs.select("id"))
    texts = texts.join(runs, ["id", "mark"]).select("id", "mark", "text", "runs").dropDuplicates(["id", "mark"])
    windows = settle(texts.mapInArrow(_extended(length), "w1 long, w2 long, id long, mark int, start int"))
    first = windows.groupBy("w1", "w2").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    single = windows.join(settle(first.drop("high")), ["w1", "w2"]).where("low < id")
    return whole.union(single.select("id", "mark", "start", F.lit(1).cast("short").alias("windows")))


def covered(n: int, runs: list, length: int) -> np.ndarray:
    """Which of n words the runs of windows cover."""
    ends = np.zeros(n + 1, np.int64)
    if runs:
        start = np.array([r["start"] for r in runs])
        stop = start + np.array([r["windows"] for r in runs]) + length - 1
        np.add.at(ends, start, 1)
        np.add.at(ends, stop, -1)
    return np.cumsum(ends[:n]) > 0


def _kept(text: bytes | None, runs: list | None, length: int) -> Iterator:
    """Words, removed words, kept text."""
    if text is None:
        return 0, 0, b""
    # a long text is never all held as words
    gone = covered(max(r["start"] + r["windows"] for r in runs) + length - 1, runs, length) if runs else np.zeros(0, bool)
    n, lost, out = 0, 0, []
    for words in word_chunks(text):
        own = gone[n:n + len(words)]
        n += len(words)
        if own.any():
            lost += int(own.sum())
            words = [w for w, g in zip(words, own.tolist(), strict=False) if not g] + words[len(own):]
        out.append(b" ".join(words))
    return n, lost, b" ".join(x for x in out if x)


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, digest: bool = False,
                    carry: str | None = None) -> DataFrame:
    """Remove words covered by a window of `length` words whose sequence also starts in a document with a smaller id.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged. One row per row of `df`: `id_col`, n_words, n_removed, kept_text (kept words
    joined by one space) or, with `digest`, kept_sha256. `carry` names a column that takes the id's place in the result. Windows
    are judged on the input.

    A null text has no words. Rows with a null id neither lose words nor make others lose any. Rows that repeat an id take
    nothing from each other, as neither id is smaller. Texts below `length` words stay whole. Other columns are not looked
    at; an empty table gives an empty result. Ids must be integers.

    Plan, level by level: the half-length window of smallest hash in each window is its anchor (about one position in
    length / 4), so equal windows share it. Runs of windows with an anchor that two documents have go on. Runs that a smaller
    id holds whole are decided; of equal runs one goes on, so a group of thousands of copies costs one. What is left is
    extended to the whole length, window by window (128-bit identity), and the smallest holder decides. No longer level
    is needed: a repeat of twice the length is covered by its windows of this one.
    """
    runs = repeated_runs(df, id_col, text_col, length)
    runs = settle(runs.groupBy("id", "mark").agg(F.collect_list(F.struct("start", "windows")).alias("runs")))
    own = carry or id_col
    docs = df.select(F.col(own).alias("own"), F.col(id_col).cast("long").alias("id"), F.hash(text_col).alias("mark"), F.col(text_col).alias("text"))
    hit = maybe_in(docs, "id", runs.select("id")).join(runs, ["id", "mark"], "left").select("own", "text", "runs")
    rest = maybe_in(docs, "id", runs.select("id"), keep=False).select("own", "text", F.lit(None).cast(runs.schema["runs"].dataType).alias("runs"))
    last = "kept_sha256" if digest else "kept_text"

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [_kept(text, runs, length) for text, runs in rows_of([part], "text", "runs")]
                n, gone, kept = zip(*rows, strict=True)
                kept = [hashlib.sha256(k).hexdigest() for k in kept] if digest else [k.decode() for k in kept]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                                                 [own, "n_words", "n_removed", last])

    schema = T.StructType([df.schema[own]]).add("n_words", "long").add("n_removed", "long").add(last, "string")
    return hit.mapInArrow(run, schema).union(rest.mapInArrow(run, schema))
