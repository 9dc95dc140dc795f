"""Exact duplicates of whole texts: counting quotient filters find candidates, bytes decide."""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import SPACES, letters, maybe_in, settle

#: Geometry of the filter: 48-bit fingerprints, 16 bits of quotient, 32 of remainder. The upper 12 bits of the quotient
#: name the slice, the unit in which filters travel and are merged.
SLICE_BITS, QUOTIENT_BITS, REMAINDER_BITS = 12, 16, 32
LOCAL = 1 << (QUOTIENT_BITS - SLICE_BITS)
#: A filter under construction is emitted when it has taken so many fingerprints.
FILTER_ROWS = 1 << 20

_SLICES = pa.schema([("slice", pa.int32()), ("runs", pa.binary()), ("remainders", pa.binary()), ("extra", pa.binary())])


def pack(fingerprints: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """One slice of sorted, distinct fingerprints (quotient within the slice above the remainder).

    runs: for each local quotient the length of its run; remainders: run after run, ascending; extra: position and count of
    the remainders that occur more than once, so that a single one costs its remainder alone.
    """
    runs = np.bincount((fingerprints >> np.uint64(REMAINDER_BITS)).astype(np.int64), minlength=LOCAL).astype("<u4")
    many = np.flatnonzero(counts > 1)
    extra = np.stack([many, counts[many]]).astype("<i8")
    return runs.tobytes(), fingerprints.astype("<u4").tobytes(), extra.tobytes()


def unpack(runs: bytes, remainders: bytes, extra: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints and counts that `pack` took: nothing is lost."""
    low = np.frombuffer(remainders, "<u4").astype(np.uint64)
    high = np.repeat(np.arange(LOCAL, dtype=np.uint64), np.frombuffer(runs, "<u4"))
    counts = np.ones(len(low), np.int64)
    where, many = np.frombuffer(extra, "<i8").reshape(2, -1)
    counts[where] = many
    return (high << np.uint64(REMAINDER_BITS)) | low, counts


def build(fingerprints: np.ndarray) -> Iterator[tuple]:
    """The filter of one partition, slice by slice."""
    if not len(fingerprints):
        return
    values, counts = np.unique(fingerprints, return_counts=True)
    cut = np.uint64(QUOTIENT_BITS - SLICE_BITS + REMAINDER_BITS)
    slices = values >> cut
    inner = values & ((np.uint64(1) << cut) - np.uint64(1))
    starts = np.flatnonzero(np.r_[True, slices[1:] != slices[:-1]])
    for a, b in zip(starts, [*starts[1:], len(values)], strict=True):
        yield int(slices[a]), *pack(inner[a:b], counts[a:b])


def merge(filters: Iterable[tuple[bytes, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Filters of one slice merged by their sorted remainders: counts of equal fingerprints add up."""
    values, counts = zip(*(unpack(*f) for f in filters), strict=True)
    values, counts = np.concatenate(values), np.concatenate(counts)
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return values[starts], np.add.reduceat(counts, starts)


def _build(batches):
    held, n = [], 0
    for batch in batches:
        held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64))
        n += len(held[-1])
        if n >= FILTER_ROWS:
            yield _rows(held)
            held, n = [], 0
    if held:
        yield _rows(held)


def _rows(held: list[np.ndarray]) -> pa.RecordBatch:
    rows = list(build(np.concatenate(held)))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, _SLICES, strict=True)],
                                      schema=_SLICES)


def _repeated(batches):
    """Slices arrive sorted; those of one slice are merged and the fingerprints with a count above one leave."""
    now, held = None, []

    def out():
        values, counts = merge(held)
        cut = np.uint64(QUOTIENT_BITS - SLICE_BITS + REMAINDER_BITS)
        found = ((np.uint64(now) << cut) | values[counts > 1]).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found)], ["repeated"])

    for batch in batches:
        for slice_, *filter_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if slice_ != now and held:
                yield out()
                held = []
            now = slice_
            held.append(filter_)
    if held:
        yield out()


def repeated_fingerprints(df: DataFrame, column: str) -> DataFrame:
    """Fingerprints (48-bit longs) that occur more than once in `column`, one row each, by merged quotient filters."""
    slices = df.select(column).mapInArrow(_build, "slice int, runs binary, remainders binary, extra binary")
    return slices.repartition("slice").sortWithinPartitions("slice").mapInArrow(_repeated, "repeated long")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of texts that are equal once white space (space, tab to carriage return) is deleted.

    One row per row of `df`: `id_col`, keep_id (of the row with the most code points in the original text, then the smallest
    id), group_size (rows), kept (id equals keep_id), text_sha256 (hex, of the text without white space).

    Null texts count as empty and form one class with white-space-only ones. Rows with a null id count in group_size; they
    are kept only if every id of their class is null (keep_id is null then). Rows that repeat an id and a text
    share one decision. Other columns are not looked at; an empty table gives an empty result.

    Plan: fingerprints go into one quotient filter per partition; slices of the filters are merged by sorted remainders.
    Rows whose fingerprint counts above one are grouped by their bytes (copies combine before the shuffle, so a hot class is
    a few rows); what is left of each class joins back by digest. Texts without a repeated fingerprint are not shuffled.
    """
    kinds = df.schema
    text = letters(text_col)
    bare = F.translate(text, SPACES, "")
    base = df.select(F.col(id_col).alias("id"), text.alias("text"), bare.alias("bare"))
    keys = settle(base.select("id", F.shiftrightunsigned(F.xxhash64("bare"), 16).alias("print"), F.sha2("bare", 256).alias("sha")))
    repeated = settle(repeated_fingerprints(keys, "print"))
    routed = maybe_in(base.withColumn("print", F.shiftrightunsigned(F.xxhash64("bare"), 16)), "print", repeated)
    # byte verification: the grouping key is the text itself
    classes = (routed.groupBy("bare", F.length("text").alias("chars"))
               .agg(F.count("*").alias("n"), F.count("id").alias("named"), F.min("id").alias("first")))
    best = F.max_by("first", F.struct(F.col("first").isNotNull(), "chars", _falling(F.col("first"), kinds[id_col].dataType.typeName())))
    classes = (classes.select(F.sha2("bare", 256).alias("class"), "chars", "n", "first")
               .groupBy("class").agg(F.sum("n").alias("n"), best.alias("keep")).where("n > 1"))
    classes = settle(classes)  # read back, both sides of the join are shuffled and AQE can split a hot class
    joined = keys.join(classes, F.col("sha") == F.col("class"), "left")
    keep = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("keep"))
    return joined.select(F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
                         F.col("id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"))


def _falling(column, kind):
    """Orders ids downwards, for the smallest id among equally long texts."""
    if kind not in ("long", "integer", "short", "byte"):
        raise ValueError("ids must be integers")
    return -column.cast("decimal(20,0)")
