import hashlib
import zlib

import pytest
from odd import ROWS, by_text, documents
from pyspark.sql import functions as F

from statloom.llm.merkle import document_manifest, folded, merkle_manifest
from statloom.session import settle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def grow(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def tampered(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0


def by_hand(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for row in rows:
        copy = (*row[:3], None if row[3] is None else row[3] + tampered(row[0]), row[4])
        trees.setdefault(row[2], []).append(((row[0] is not None, row[0] or 0, leaf(row)), leaf(row), leaf(copy), row[0]))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    grown = {n: grow([x[1] for x in sorted(trees[n], key=lambda x: x[0])]) for n in names}
    top = grow([grown[n][-1][0] for n in names])
    out = []
    for at, name in enumerate(names):
        for i, (_, own, node, doc_id) in enumerate(sorted(trees[name], key=lambda x: x[0])):
            proof = []
            for levels, place in ((grown[name], i), (top, at)):
                for level in levels[:-1]:
                    run = level[place // 2 * 2:place // 2 * 2 + 2]
                    others = [x for j, x in enumerate(run) if j != place % 2]
                    proof += others
                    node = h(*(node if j == place % 2 else x for j, x in enumerate(run)))
                    place //= 2
            out.append((doc_id, own, grown[name][-1][0], top[-1][0], h(*proof), node, node == top[-1][0]))
    return by_text(out)


def check(spark, rows, bits):
    mark = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    docs = documents(spark, [(r[0], r[4], r[2]) for r in rows])
    own = {(r[0], r[4], r[2]): r for r in rows}
    assert len({k: v for k, v in own.items()}) <= len(rows)
    got = document_manifest(docs, mark, bits=bits)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert by_text(tuple(r) for r in got.collect()) == by_hand([(i, None if i == 5 else f"s{i}", lang, None if t is None else len(t), t) for i, _, lang, _, t in rows])


@pytest.mark.parametrize("bits", [1, 2, 8])
def test_odd_rows(spark, bits):
    check(spark, [(i, None, lang, None, t) for i, t, lang in ROWS], bits)


@pytest.mark.parametrize("bits", [1, 3])
def test_many_levels_and_trees(spark, bits):
    rows = [(i * 7 % 301, None, ["a", "b", "é", None, "Z"][min(i % 7, 4)] if i % 3 else "hot", None, f"text {i % 50}") for i in range(300)]
    check(spark, rows, bits)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9, 16, 17])
def test_full_and_ragged_blocks(spark, n):
    check(spark, [(i, None, "x", None, f"t{i}") for i in range(n)], 2)


def test_repeated_rows_fill_whole_blocks(spark):
    check(spark, [(1, None, "x", None, "same")] * 40 + [(2, None, "y", None, "other")], 2)


def test_many_trees(spark):
    check(spark, [(i, None, f"lang{i % 90:02d}", None, "t") for i in range(120)], 2)


def test_nothing(spark):
    assert document_manifest(documents(spark, []), F.lit(True)).collect() == []


def test_some_proofs_and_records(spark):
    rows = settle(spark.range(100).select("id", F.lit("t").alias("group"), F.sha2(F.col("id").cast("string"), 256).alias("leaf")))
    manifest = merkle_manifest(rows, "group", "id", bits=3)
    assert manifest.root == grow([h(str(i)) for i in range(100)])[-1][0]
    got = manifest.proofs(manifest.leaves.where("id % 30 = 7")).withColumn("back", folded(F.col("leaf"), F.col("siblings"))).collect()
    assert sorted(r["id"] for r in got) == [7, 37, 67, 97]
    assert all(r["back"] == manifest.root and len(r["siblings"]) == 7 for r in got)
    # every record is named by what its children hash to
    for r in manifest.records().collect():
        nodes = [r["children"][i:i + 64] for i in range(0, len(r["children"]), 64)]
        levels = grow(nodes)
        while levels[-1][0] != r["digest"] and len(levels) <= 4:
            levels.append([h(levels[-1][0])])
        assert levels[-1] == [r["digest"]]
