"""SimHash near duplicates: fingerprints meet at the anchors of a covering code."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.llm.common import components, letters, rows_of, settle, word_chunks

SEED = 42
#: Home fingerprints of one anchor that a task holds at a time; an anchor with more is cut into several such sets.
HOMES = 4096


def fingerprint(text: bytes, width: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text, A-Z lower-cased; 0 for a text without words.

    A bit is set if it is set in more than half of the shingles' hashes. Fewer words than `width` make one shingle.
    """
    ones, n, tail = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for words in word_chunks(text.lower()):
        words = tail + words
        if len(words) >= width:
            parts = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
            hashes = np.fromiter((digest(p, SEED) for p in parts), np.uint64, len(words) - width + 1)
            n += len(hashes)
            for at in range(0, len(hashes), 1 << 16):
                part = hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
                ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            tail = words[len(words) - width + 1:]
        else:
            tail = words
    if not n:
        return digest(b" ".join(tail), SEED) if tail else 0
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, id_col: str, text_col: str, width: int = 3) -> DataFrame:
    """(id, print): the fingerprint of each text as a signed long."""

    def run(batches):
        for batch in batches:
            prints = [fingerprint(t, width) for (t,) in rows_of([batch], "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, np.uint64).astype(np.int64))], ["id", "print"])

    schema = T.StructType().add("id", df.schema[id_col].dataType).add("print", "long")
    return df.select(F.col(id_col).alias("id"), letters(text_col).alias("text")).mapInArrow(run, schema)


class Anchors:
    """A covering code for `bits` bits: a Hamming code on the largest 2^r - 1 of them, the others verbatim.

    Its covering radius is 1. `home` is the anchor nearest to a value, `near` every anchor within radius + 1, so that of two
    values at distance 1 or less one's home is always near the other.
    """

    def __init__(self, bits: int):
        self.bits = bits
        self.r = (bits + 1).bit_length() - 1
        self.n = (1 << self.r) - 1

    def syndrome(self, values: np.ndarray) -> np.ndarray:
        """Exclusive or of the positions (from 1) of the set bits; 0 for codewords."""
        out = np.zeros(len(values), np.uint64)
        for j in range(self.r):
            mask = np.uint64(sum(1 << (p - 1) for p in range(1, self.n + 1) if p >> j & 1))
            out |= (np.bitwise_count(values & mask).astype(np.uint64) & np.uint64(1)) << np.uint64(j)
        return out

    def home(self, values: np.ndarray) -> np.ndarray:
        s = self.syndrome(values)
        flip = np.where(s > 0, np.uint64(1) << (np.maximum(s, np.uint64(1)) - np.uint64(1)), np.uint64(0))
        return values ^ flip

    def near(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, anchor) for every anchor within distance 2."""
        rows, s = np.arange(len(values)), self.syndrome(values)
        found_rows, found = [rows], [self.home(values)]
        off = s > 0
        one = np.uint64(1)
        for p in range(1, self.n + 1):  # two flips p, q inside the Hamming part with p ^ q = s; counted once, p < q
            q = s ^ np.uint64(p)
            good = off & (q > np.uint64(p))
            found_rows.append(rows[good])
            found.append(values[good] ^ (one << np.uint64(p - 1)) ^ (one << (q[good] - one)))
        for p in range(self.n, self.bits):  # a verbatim bit flipped, and the Hamming part brought to its codeword
            found_rows.append(rows)
            found.append(self.home(values) ^ (one << np.uint64(p)))
        for p in range(self.n, self.bits):  # two verbatim bits flipped: only from a codeword
            for q in range(p + 1, self.bits):
                found_rows.append(rows[~off])
                found.append(values[~off] ^ (one << np.uint64(p)) ^ (one << np.uint64(q)))
        return np.concatenate(found_rows), np.concatenate(found)


def blocks(distance: int) -> list[tuple[int, int]]:
    """(shift, bits) of the blocks of a fingerprint: at distance `distance` or less, some block differs in one bit at most."""
    m = distance // 2 + 1
    edges = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _replicate(distance: int):
    parts = [(shift, Anchors(bits)) for shift, bits in blocks(distance)]

    def run(batches):
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)
            for i, (shift, code) in enumerate(parts):
                mask = np.uint64((1 << code.bits) - 1)
                block = (values >> np.uint64(shift)) & mask
                rows, anchors = code.near(block)
                home = code.home(block)
                yield _keyed(i, home, values, True)
                yield _keyed(i, anchors, values[rows], False)

    return run


def _keyed(i, anchors, values, home):
    n = len(values)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, i, np.int8)), pa.array(anchors.astype(np.int64)), pa.array(values.astype(np.int64)),
                                       pa.array(np.full(n, home))], ["block", "anchor", "value", "home"])


def _links(distance: int):
    """Rows come sorted by anchor, homes first. Only links that join what is not yet joined at the anchor leave."""

    def compare(homes: np.ndarray, parent: list[int], visitors: np.ndarray):
        def top(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for at in range(0, len(visitors), 1024):
            part = visitors[at:at + 1024]
            who, where = np.nonzero(np.bitwise_count(part[:, None] ^ homes[None, :]) <= distance)
            keep = part[who] != homes[where]
            last, first = -1, 0
            for v, h in zip(who[keep].tolist(), where[keep].tolist(), strict=True):
                if v != last:
                    last, first = v, h
                    yield int(part[v]), int(homes[h])
                elif (a := top(first)) != (b := top(h)):
                    parent[b] = a
                    yield int(part[v]), int(homes[h])

    def run(batches):
        key, homes, parent, waiting = None, [], [], []
        grid = np.empty(0, np.uint64)
        out: list[tuple[int, int]] = []

        def flush():
            if waiting and len(grid):
                out.extend(compare(grid, parent, np.array(waiting, np.uint64)))
            waiting.clear()

        def taken():
            a, b = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.array(c, np.uint64).astype(np.int64)) for c in (a, b)], ["a", "b"])

        for batch in batches:
            block, anchor, part, home = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:4])
            values = batch.column(4).to_numpy(zero_copy_only=False).astype(np.uint64)
            change = np.r_[True, (anchor[1:] != anchor[:-1]) | (block[1:] != block[:-1]) | (part[1:] != part[:-1])]
            starts = np.flatnonzero(change)
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(values)], strict=True):
                mine = (block[a], anchor[a], part[a])
                if mine != key:
                    flush()
                    key, homes = mine, []
                    grid = np.empty(0, np.uint64)
                inner = home[a:b]
                if (n := int(inner.sum())):
                    homes.append(values[a:a + n])
                    grid = np.concatenate(homes)
                    parent[:] = range(len(grid))
                if a + n < b:
                    waiting.extend(values[a + n:b].tolist())
                    if len(waiting) >= 1 << 14:
                        flush()
            if out:
                yield taken()
        flush()
        if out:
            yield taken()

    return run


def near_links(prints: DataFrame, distance: int = 3) -> DataFrame:
    """Links (a, b) between distinct fingerprints (one long column `value`) at `distance` bits or less.

    The links span what is connected: at each anchor a link is left out only where its ends are already joined there.
    """
    keyed = settle(prints.select("value").mapInArrow(_replicate(distance), "block byte, anchor long, value long, home boolean"))
    # an anchor with many homes is compared in several sets of homes, each against all of the anchor's visitors
    sizes = keyed.where("home").groupBy("block", "anchor").agg(F.count("*").alias("n")).where(F.col("n") > 0)
    sets = sizes.select("block", "anchor", F.ceil(F.col("n") / HOMES).cast("int").alias("sets"))
    placed = keyed.join(sets, ["block", "anchor"])
    part = F.when(F.col("home"), F.array(F.pmod(F.xxhash64("value"), F.col("sets")).cast("int"))).otherwise(
        F.sequence(F.lit(0), F.col("sets") - 1))
    placed = placed.select("block", "anchor", F.explode(part).alias("part"), "home", "value")
    placed = placed.repartition("block", "anchor", "part").sortWithinPartitions("block", "anchor", "part", F.desc("home"))
    return placed.select("block", "anchor", "part", "home", "value").mapInArrow(_links(distance), "a long, b long")


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3) -> DataFrame:
    """Near-duplicate groups by SimHash: one row per row of `df` with `id_col`, fingerprint (16 hex digits), component_id.

    Words are what white space (space, tab to carriage return) leaves, A-Z lower-cased; shingles of `width` words, repeats
    included, hashed by XXH64 with seed 42. Fingerprints link at `distance` differing bits or fewer; component_id is the
    smallest id reachable over links, the row's own included.

    Null, empty and blank texts have fingerprint zero and link like any other. Rows with a null id get a fingerprint and the
    component's smallest id, null only if the component has no other. Repeated rows give repeated results. Other columns
    are not looked at; an empty table gives an empty result.

    Plan: equal fingerprints become one row. A fingerprint is cut into distance // 2 + 1 blocks, of which at least one
    differs in at most one bit between linked fingerprints. Each block has a covering code of radius 1 (`Anchors`); a
    fingerprint has one home anchor and visits all anchors within radius plus one, at most 17 for 32 bits. Per anchor,
    visitors are compared with homes, streaming, and only a spanning set of links leaves.
    """
    prints = settle(fingerprints(df, id_col, text_col, width))
    values = settle(prints.groupBy("print").agg(F.min("id").alias("first")))
    links = near_links(values.select(F.col("print").alias("value")), distance)
    rooted = settle(components(links)).join(values, F.col("node") == F.col("print")).select("node", "root", "first")
    rooted = settle(rooted)
    smallest = rooted.groupBy(F.col("root").alias("of")).agg(F.min("first").alias("component"))
    linked = rooted.join(smallest, F.col("root") == F.col("of")).select("node", "component")
    classes = settle(values.join(linked, F.col("print") == F.col("node"), "left")
                     .select(F.col("print").alias("value"), F.when(F.col("node").isNull(), F.col("first")).otherwise(F.col("component")).alias("component_id")))
    return prints.join(classes, F.col("print") == F.col("value")).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
