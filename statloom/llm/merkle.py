"""Merkle manifest of a table: trees of digests stored as digest-to-children records, proofs by descent from the root."""

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.llm.common import batches_of, rows_of, settle
from statloom.operators.skew import null_safe_join

#: Levels of a binary tree that one record covers: its children are up to 2^BITS digests.
BITS = 8
#: Characters of a digest in hex.
HEX = 64
_RECORD = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("digest", pa.string()), ("children", pa.string())])


def digest(value: bytes) -> bytes:
    return hashlib.sha256(value).hexdigest().encode()


def encoded(*values: Column) -> Column:
    """Each value as its UTF-8 byte count, a colon and itself; null as a dash."""
    texts = [v.cast("string") for v in values]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def rows_above(nodes: list[bytes], height: int) -> list[list[bytes]]:
    """The levels over `nodes`, lowest first: every two nodes become their digest, a lone last one its own."""
    levels = [nodes]
    for _ in range(height):
        below = levels[-1]
        levels.append([digest(b"".join(below[i:i + 2])) for i in range(0, len(below), 2)])
    return levels


def height_of(block: int, count: int, bits: int) -> int:
    """Levels over a block of `count` nodes. A block that is not the only one of its tree is raised by `bits` levels; a first block
    that is not full must be the only one and ends where one node is left."""
    return bits if block > 0 or count == 1 << bits else (count - 1).bit_length()


def _blocks(bits: int):
    """Nodes of a block, which come together and in order, become its record: top digest and children."""

    def record(tree, block, nodes):
        return tree, block, rows_above(nodes, height_of(block, len(nodes), bits))[-1][0].decode(), b"".join(nodes).decode()

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        now, nodes = None, []
        for tree, block, node in rows:
            if now != (tree, block) and nodes:
                yield record(*now, nodes)
                nodes = []
            now = (tree, block)
            nodes.append(node)
        if nodes:
            yield record(*now, nodes)

    def decoded(rows):
        return ((None if t is None else t.decode(), b, n) for t, b, n in rows)

    return lambda batches: batches_of(run(decoded(rows_of(batches, "tree", "block", "digest"))), _RECORD, 64)


def build(nodes: DataFrame, bits: int) -> tuple[list[DataFrame], DataFrame]:
    """Records of the trees over `nodes` (tree, rank, digest), a table (tree, block, digest, children) per 2^bits-fold level, and the
    roots (tree, digest).

    A block is at most 2^bits nodes. A tree that already is one node stays as it is while larger ones grow.
    """
    levels = []
    while True:
        dealt = nodes.select("tree", F.expr(f"shiftright(rank, {bits})").alias("block"), "rank", "digest")
        dealt = dealt.repartition("tree", "block").sortWithinPartitions("tree", "block", "rank")
        made = settle(dealt.mapInArrow(_blocks(bits), "tree string, block long, digest string, children string"))
        levels.append(made)
        nodes = made.select("tree", F.col("block").alias("rank"), "digest")
        if nodes.where("rank > 0").isEmpty():
            return levels, nodes.select("tree", "digest")


def ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Add `rank`, from 0 within each `tree` (nulls are a tree) in ascending `order`, without a single-task sort.

    Rows are range-partitioned by tree, order and a salt, so neither a hot tree nor rows that agree in all of them are one task.
    Runs of a tree within a partition are counted, and a window adds the runs before: a tree has at most one per partition.
    """
    salted = settle(rows.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id())))
    keys = [tree, *order, "_salt"]
    placed = salted.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_salt").withColumn("_at", F.monotonically_increasing_id())
    placed = settle(placed).withColumn("_part", F.expr("shiftright(_at, 33)"))
    runs = placed.groupBy(F.col(tree).alias("_tree"), F.col("_part").alias("_of")).agg(F.min("_at").alias("_start"), F.count("*").alias("_n"))
    before = Window.partitionBy("_tree").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    runs = settle(runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    met = placed.join(runs, F.col(tree).eqNullSafe(F.col("_tree")) & (F.col("_part") == F.col("_of")))
    return met.withColumn("rank", F.col("_at") - F.col("_start") + F.col("_before")).drop("_at", "_part", "_tree", "_of", "_start", "_before")


def _select(bits: int, carried: pa.DataType | None):
    """In each block the head (path to its top, children) comes first, then the requests; each gets the path to its node.

    A step of a path is what stands beside the node on the way: `L` or `R` and the unselected child, or an empty text.
    """

    def inner(nodes: list[bytes], height: int):
        return [[n.decode() for n in level] for level in rows_above(nodes, height)]

    def run(rows):
        path, entry, levels = [], "", []
        for tree, block, kind, rank, top, steps, children, above, carry in rows:
            if kind == 0:
                nodes = [children[i:i + HEX] for i in range(0, len(children), HEX)] if children is not None else [top]
                path, entry, levels = steps, above.decode(), inner(nodes, height_of(block, len(nodes), bits))
                continue
            down = []
            for h in range(len(levels) - 2, -1, -1):  # from the top: the rank's digits choose, the other child is collected
                at = (rank & ((1 << bits) - 1)) >> h
                other = at ^ 1
                down.append("" if other >= len(levels[h]) else ("L" if other < at else "R") + levels[h][other])
            own = rank & ((1 << bits) - 1)
            yield None if tree is None else tree.decode(), rank, levels[0][own], path + down, entry, carry

    fields = [("tree", pa.string()), ("rank", pa.int64()), ("digest", pa.string()), ("path", pa.list_(pa.string())), ("entry", pa.string()),
              ("carry", carried)]
    names = ("tree", "block", "kind", "rank", "digest", "path", "children", "entry", "carry")
    return lambda batches: batches_of(run(rows_of(batches, *names)), pa.schema(fields), 1024)


def descend(levels: list[DataFrame], entries: DataFrame, wanted: DataFrame, bits: int) -> DataFrame:
    """(tree, rank, digest, path, entry, carry) of the `wanted` nodes (tree, rank, carry; each rank once), `path` from the root downwards, `entry`
    the top of the tree.

    `entries` (tree, digest, path) are the tops of the trees. On each level requests that share all upper digits are one; the digests
    reached are joined to their records, and a request takes the children it does not select into its path. A tree
    of fewer levels has no record on the upper ones and waits.
    """
    carried = wanted.schema["carry"].dataType
    arrow = wanted.select("carry").limit(0).toArrow().schema.field(0).type
    front = entries.select("tree", F.lit(0).cast("long").alias("rank"), "digest", "path", F.col("digest").alias("entry"))
    for level in range(len(levels) - 1, -1, -1):
        asks = wanted
        if level:
            asks = wanted.select("tree", F.expr(f"shiftright(rank, {bits * level})").alias("rank")).distinct().withColumn("carry", F.lit(None).cast(carried))
        records = levels[level].where("digest <> children")
        records = settle(records.select(F.col("digest").alias("of"), "children").dropDuplicates(["of"]))
        met = front.join(records, F.col("digest") == F.col("of"), "left")
        heads = met.select("tree", F.col("rank").alias("block"), F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("rank"), "digest", "path", "children", "entry",
                           F.lit(None).cast(carried).alias("carry"))
        nothing = [F.lit(None).cast("string").alias("digest"), F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("children"),
                   F.lit(None).cast("string").alias("entry")]
        asks = asks.select("tree", F.expr(f"shiftright(rank, {bits})").alias("block"), F.lit(1).alias("kind"), "rank", *nothing, "carry")
        dealt = heads.unionByName(asks).repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", "rank")
        front = dealt.mapInArrow(_select(bits, arrow), f"tree string, rank long, digest string, path array<string>, entry string, carry {carried.simpleString()}")
        if level:
            front = settle(front.drop("carry"))
    return front


@dataclass
class Manifest:
    """Leaves (the caller's columns, tree, rank, leaf), records per level of the trees and of the tree over them, subroots and root."""

    leaves: DataFrame
    levels: list[DataFrame]
    top_levels: list[DataFrame]
    subroots: DataFrame
    root: str | None
    bits: int

    def records(self) -> DataFrame:
        """The content-addressed DAG: (digest, children), every record once; children are hex digests one after the other."""
        out = None
        for t in self.levels + self.top_levels:
            part = t.where("digest <> children").select("digest", "children")
            out = part if out is None else out.union(part)
        return out.dropDuplicates(["digest"])

    def proofs(self, leaves: DataFrame | None = None) -> DataFrame:
        """The given rows of `leaves` (all by default) with tree, subroot and `siblings`: the steps from the leaf to the root, each `L` or `R` and
        the digest beside the node, or an empty text where the node is alone."""
        leaves = self.leaves if leaves is None else leaves
        carry = [c for c in leaves.columns if c not in ("tree", "rank")]
        wanted = leaves.select("tree", "rank", F.struct(*carry).alias("carry"))
        trees = wanted.select("tree").distinct()
        asked = null_safe_join(self.subroots, trees, ["tree"])
        top = self.subroots.sparkSession.range(1).select(F.lit(None).cast("string").alias("tree"), F.lit(self.root).alias("digest"),
                                                         F.array().cast("array<string>").alias("path")).where("digest IS NOT NULL")
        paths = descend(self.top_levels, top, asked.select(F.lit(None).cast("string").alias("tree"), "rank", F.struct(F.col("tree").alias("name")).alias("carry")), self.bits)
        entries = settle(paths.select(F.col("carry.name").alias("tree"), "digest", "path"))
        found = descend(self.levels, entries, wanted, self.bits)
        return found.select("tree", "rank", "digest", F.reverse("path").alias("siblings"), F.col("entry").alias("subroot"), *[F.col("carry").getField(c).alias(c) for c in carry])


def folded(leaf: Column, siblings: Column) -> Column:
    """The root that `leaf` and its siblings give."""
    def step(node, s):
        left, right = s.startswith("L"), s.startswith("R")
        return F.sha2(F.concat(F.when(left, F.substring(s, 2, HEX)).otherwise(""), node, F.when(right, F.substring(s, 2, HEX)).otherwise("")), 256)
    return F.aggregate(siblings, leaf, step)


def merkle_manifest(rows: DataFrame, tree: str, order: str, bits: int = BITS) -> Manifest:
    """The manifest of `rows` (columns `tree`, `order`, `leaf` and any others but rank and those that begin with an underscore).

    Per value of `tree` (null is one) leaves ascend by `order`, nulls first, equal ones by digest; repeated rows are leaves of their own.
    While several nodes remain every two consecutive ones become their digest, a lone last one its own; a lone leaf is its subroot.
    Subroots in order of `tree` (null first, bytewise) give the root likewise. No rows: no root.
    """
    rows = rows.withColumn("tree", F.col(tree))
    leaves = settle(ranked(rows, "tree", [order, "leaf"]))
    levels, roots = build(leaves.select("tree", "rank", F.col("leaf").alias("digest")), bits)
    # one row per tree
    subroots = ranked(roots.select(F.col("tree").alias("name"), F.col("digest").alias("subroot"), F.lit(None).cast("string").alias("one")), "one", ["name"])
    subroots = settle(subroots.select(F.col("name").alias("tree"), "rank", "subroot"))
    tops, root = build(subroots.select(F.lit(None).cast("string").alias("tree"), "rank", F.col("subroot").alias("digest")), bits)
    found = root.first()
    return Manifest(leaves, levels, tops, subroots, found["digest"] if found else None, bits)


def document_manifest(df: DataFrame, tampered: Column, id_col: str = "doc_id", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
                      tree: str = "lang", changed: str = "n_chars", bits: int = BITS) -> DataFrame:
    """Manifest of a table and its check against a copy in which `changed` is one more where `tampered` holds.

    One row per row of `df`: id, leaf, subroot, root, proof_sha256 (of the siblings' digests from the leaf to the root), folded_root (from the
    copy's leaf and the original siblings) and verified (folded_root equals root). Null values are part of a leaf as such; a null `changed` stays
    null. Null ids come first; rows that repeat an id are leaves of their own, ordered by digest. Of a text only its digest is kept.
    Other columns are not looked at; an empty table gives an empty result.
    """
    cells = {c: F.col(c) for c in columns}
    other = cells | {changed: F.when(tampered, F.expr(f"try_add(`{changed}`, 1)")).otherwise(F.col(changed))}
    rows = df.select(F.col(id_col).alias("id"), F.col(tree).cast("string").alias("group"), F.sha2(encoded(*cells.values()), 256).alias("leaf"),
                     F.sha2(encoded(*other.values()), 256).alias("copy"))
    manifest = merkle_manifest(rows, "group", "id", bits)
    root = F.lit(manifest.root).cast("string")
    proofs = manifest.proofs()
    proof = F.sha2(F.array_join(F.transform("siblings", lambda s: F.substring(s, 2, HEX)), ""), 256)
    out = proofs.select(F.col("id").alias(id_col), "leaf", "subroot", root.alias("root"), proof.alias("proof_sha256"), folded(F.col("copy"), F.col("siblings")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
