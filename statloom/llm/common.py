"""Shared pieces of the text operators: words, bounded filters, streaming over sorted rows, components."""

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.session import settle

#: White space that separates words, as the characters and as the class of a regular expression.
SPACES = " \t\n\x0b\x0c\r"
#: A long text is cut into word chunks of about so many bytes, so that its words are never all held as objects.
CHUNK_BYTES = 1 << 20
#: Bits of the broadcast filter; at most BITS / 64 rows of 16 bytes (4 MB) whatever the number of keys.
BITS = 1 << 24


def word_chunks(text: bytes) -> Iterator[list[bytes]]:
    """The words `[^\\x20\\x09-\\x0D]+` of a text, in lists that cover about CHUNK_BYTES each."""
    if len(text) <= CHUNK_BYTES:
        yield text.split()
        return
    at = 0
    while at < len(text):
        end = min(len(text), at + CHUNK_BYTES)
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield text[at:end].split()
        at = end


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def rows_of(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples; string columns come as bytes."""
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        yield from zip(*(text_bytes(c) if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) else c.to_pylist()
                         for c in columns), strict=True)


def batches_of(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most `size` rows; nothing else is held."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def row_map(df: DataFrame, fn: Callable[..., Iterable[tuple]], schema: pa.Schema, ddl: str, size: int = 4096) -> DataFrame:
    """Give every row of `df` to `fn(*row)`, which yields result rows."""
    names = df.columns

    def run(batches):
        return batches_of((out for row in rows_of(batches, *names) for out in fn(*row)), schema, size)

    return df.mapInArrow(run, ddl)


def maybe_in(df: DataFrame, key: str, keys: DataFrame, keep: bool = True) -> DataFrame:
    """Rows of `df` whose 64-bit `key` may be in the one column of `keys` (`keep`), or surely isn't.

    A bitmap of BITS bits is broadcast: at most BITS / 64 rows of 16 bytes, whatever the number of keys. A key that is
    in `keys` is always found; more keys only let more rows pass that a join has to drop afterwards.
    """
    slot = F.pmod(F.xxhash64(F.col(keys.columns[0])), F.lit(BITS))
    bitmap = _bitmap(keys.select(slot.alias("_slot")))
    mine = F.pmod(F.xxhash64(F.col(key)), F.lit(BITS))
    marked = df.withColumn("_slot", mine).join(F.broadcast(bitmap), F.shiftright("_slot", 6) == F.col("_word"), "left")
    hit = F.coalesce(F.expr("(shiftrightunsigned(_bits, cast(_slot % 64 as int)) & 1) = 1"), F.lit(False))
    return marked.where(hit if keep else ~hit).select(*df.columns)


def _bitmap(slots: DataFrame) -> DataFrame:
    return (slots.select(F.shiftright("_slot", 6).alias("_word"), F.expr("shiftleft(1L, cast(_slot % 64 as int))").alias("_bit"))
            .groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of `edges(a, b)` (longs): one row (node, root) per node, root being the smallest node reachable.

    Large-star and small-star steps in turn, each as one aggregation and one join, until a round changes nothing. Every
    step writes its minima and edges to the shared folder. A hot node is pre-aggregated in the minimum; the minima are read
    back from a table, so both sides of the join are shuffled and AQE can split a hot node.
    """
    now = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = settle(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("m", "a").alias("m")))
        large = both.where("b > a").join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        large = settle(large)
        low = settle(large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m"))
        small = large.join(low, F.col("a") == F.col("n"))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(F.col("n").alias("a"), F.col("m").alias("b")))
        after = settle(small.where("a <> b").distinct())
        # equal edge sets: same number and same order-free digest
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now = after
        if mark == before:
            break
        before = mark
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def letters(column: str) -> Column:
    """Text, with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))
