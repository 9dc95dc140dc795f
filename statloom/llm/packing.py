"""Packing of texts into sequences of several permitted lengths, best fit, least-cost size first."""

from bisect import bisect_left, bisect_right, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import settle

#: Permitted sequence lengths, and what one more sequence costs beside its length, both in words.
SIZES, OVERHEAD = (512, 1024, 2048, 4096), 16
#: Pieces that are packed together. Shards follow the number of pieces, so a shard's size does not grow with the input.
SHARD_PIECES = 8192


def fill(room: int, lengths: list[int]) -> int:
    """How much of `room` the ascending `lengths` fill if the largest that fits is taken again and again."""
    used, hi = 0, len(lengths)
    while hi and room > used:
        hi = bisect_right(lengths, room - used, 0, hi)
        if hi:
            hi -= 1
            used += lengths[hi]
    return used


def pack(items: list[tuple[int, int]], sizes: tuple[int, ...], overhead: int = OVERHEAD) -> list[tuple[int, int, int, int]]:
    """Pack (length, key) items: (key, bin, offset, bin size), bins numbered from 0.

    Longest first; an item goes into the open bin with the least room that holds it. If none does, a bin is opened, of the
    size with the least (size + overhead) per word that it would hold were it filled from what is left; of equals the smaller.
    At the end each bin shrinks to the smallest size that holds its contents.
    """
    sizes = tuple(sorted(sizes))
    order = sorted(items, key=lambda x: (-x[0], x[1]))
    left = sorted(length for length, _ in items)
    rooms: list[tuple[int, int]] = []  # (room, bin), ascending
    used: list[int] = []
    placed = []
    for length, key in order:
        left.pop()  # the longest that is left is this one
        at = bisect_left(rooms, (length, -1))
        if at < len(rooms):
            room, bin_ = rooms.pop(at)
        else:
            room = min((s for s in sizes if s >= length), key=lambda s: ((s + overhead) / (length + fill(s - length, left)), s))
            bin_ = len(used)
            used.append(0)
        placed.append((key, bin_, used[bin_]))
        used[bin_] += length
        if room > length:
            insort(rooms, (room - length, bin_))
    final = [next(s for s in sizes if s >= u) for u in used]
    return [(key, bin_, offset, final[bin_]) for key, bin_, offset in placed]


def best_fit_packing(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes: tuple[int, ...] = SIZES,
                     overhead: int = OVERHEAD, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Pack whole texts into sequences of the permitted `sizes` (in words).

    One row per piece of each row of `df`: `id_col`, piece (from 0), start (first word), n_words, bin_id, bin_size, bin_offset.
    A text longer than the largest size is cut into pieces of that size and a rest. A text without words (null, empty, blank)
    has one row, of length 0, with a null bin. Null ids and repeated rows are packed like any other. Other columns are
    not looked at; an empty table gives an empty result.

    Only lengths are shuffled. Pieces are dealt by a hash (of id, text, piece and row number, so that repeated rows spread) to
    shards of about `shard_pieces`; bins never cross shards, which costs a few bins per shard. The lengths are written once,
    so a lost task is repeated with the same result.
    """
    most = max(sizes)
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"))
    docs = settle(df.select(F.col(id_col).alias("id"), words.alias("words"), F.xxhash64(id_col, text_col).alias("mark"),
                            F.monotonically_increasing_id().alias("row")))
    pieces = F.greatest(F.lit(1), F.ceil(F.col("words") / most).cast("int"))
    cut = docs.select("id", "mark", "row", "words", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    cut = cut.select("id", "mark", "row", "piece", (F.col("piece") * most).alias("start"),
                     F.least(F.lit(most), F.col("words") - F.col("piece") * most).alias("n_words"))
    total = docs.agg(F.sum(pieces)).first()[0] or 0
    shards = max(1, -(-total // shard_pieces))
    cut = cut.withColumn("shard", F.pmod(F.xxhash64("mark", "piece", "row"), F.lit(shards)).cast("int"))
    kind = df.schema[id_col].dataType.simpleString()
    ddl = f"id {kind}, piece int, start int, n_words int, shard int, bin int, bin_size int, bin_offset int"

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("mark", "ascending"), ("piece", "ascending"), ("n_words", "ascending"), ("id", "ascending")])
        lengths = table.column("n_words").to_pylist()
        bins: list = [(None, None, None)] * len(lengths)
        for key, bin_, offset, size in pack([(n, i) for i, n in enumerate(lengths) if n], sizes, overhead):
            bins[key] = (bin_, size, offset)
        columns = zip(*bins, strict=True)
        out = table.select(["id", "piece", "start", "n_words", "shard"])
        for name, values in zip(("bin", "bin_size", "bin_offset"), columns, strict=True):
            out = out.append_column(name, pa.array(values, pa.int32()))
        return out

    packed = cut.groupBy("shard").applyInArrow(run, ddl)
    bin_id = F.when(F.col("bin").isNotNull(), F.shiftleft(F.col("shard").cast("long"), 32) + F.col("bin"))
    return packed.select(F.col("id").alias(id_col), "piece", F.col("start").cast("long").alias("start"), F.col("n_words").cast("long").alias("n_words"),
                         bin_id.alias("bin_id"), "bin_size", F.col("bin_offset").alias("bin_offset"))
