import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import ROWS, by_text, collected, documents, words

from statloom.llm import exact_dedup as quotient
from statloom.llm import simhash, substring_dedup
from statloom.llm.common import components, maybe_in, word_chunks
from statloom.llm.exact_dedup import exact_dedup
from statloom.llm.simhash import Anchors, blocks, fingerprint, simhash_groups


# ---- exact

def bare(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def exact_by_hand(rows):
    groups = {}
    for id_, text, _ in rows:
        groups.setdefault(bare(text), []).append((id_, text or ""))
    out = []
    for id_, text, _ in rows:
        group = groups[bare(text)]
        named = [g for g in group if g[0] is not None]
        keep = min(named, key=lambda g: (-len(g[1]), g[0]))[0] if named else None
        out.append((id_, keep, len(group), id_ == keep, hashlib.sha256(bare(text).encode()).hexdigest()))
    return by_text(out)


def test_exact_dedup_on_odd_rows(spark):
    assert by_text(collected(exact_dedup(documents(spark)))) == exact_by_hand(ROWS)


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup(documents(spark, [])).collect() == []


def test_exact_dedup_hot_class(spark):
    rows = [(i, "same  text" if i % 3 else f"text {i}", "en") for i in range(900)]
    assert by_text(collected(exact_dedup(documents(spark, rows)))) == exact_by_hand(rows)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**48 - 1) | st.integers(0, 50), max_size=60), min_size=1, max_size=5))
def test_quotient_filters_lose_nothing(parts):
    slices = {}
    for part in parts:
        for slice_, *filter_ in quotient.build(np.array(part, np.uint64)):
            slices.setdefault(slice_, []).append(filter_)
    cut = quotient.QUOTIENT_BITS - quotient.SLICE_BITS + quotient.REMAINDER_BITS
    got = {}
    for slice_, filters in slices.items():
        values, counts = quotient.merge(filters)
        got |= {(slice_ << cut) | int(v): int(c) for v, c in zip(values, counts, strict=True)}
    assert got == dict(Counter(v for part in parts for v in part))


def test_equal_fingerprints_do_not_decide(spark, monkeypatch):
    """With every fingerprint routed, only equal bytes make a class."""
    rows = [(i, f"text {i // 2}", "en") for i in range(40)]
    monkeypatch.setattr(quotient, "repeated_fingerprints", lambda df, c: df.select(c).distinct())
    assert by_text(collected(exact_dedup(documents(spark, rows)))) == exact_by_hand(rows)


def test_bounded_filter_loses_no_key(spark):
    left = spark.range(2000).withColumnRenamed("id", "k")
    keys = spark.range(0, 4000, 7).withColumnRenamed("id", "j")
    hit = {r.k for r in maybe_in(left, "k", keys).collect()}
    rest = {r.k for r in maybe_in(left, "k", keys, keep=False).collect()}
    assert hit | rest == set(range(2000)) and not hit & rest
    assert set(range(0, 2000, 7)) <= hit


# ---- simhash

def print_by_hand(text, width=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i:i + width]) for i in range(len(w) - width + 1)] or [b" ".join(w)]
    hashes = Counter(xxhash.xxh64_intdigest(s, 42) for s in shingles)
    n = len(shingles)
    return sum(1 << b for b in range(64) if 2 * sum(c for h, c in hashes.items() if h >> b & 1) > n)


def groups_by_hand(rows, distance=3):
    prints = [print_by_hand(t) for _, t, _ in rows]
    found = list(range(len(rows)))

    def top(i):
        while found[i] != i:
            i = found[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                found[top(i)] = top(j)
    smallest = {}
    for i, (id_, *_) in enumerate(rows):
        if id_ is not None:
            smallest[top(i)] = min(smallest.get(top(i), id_), id_)
    return by_text([(id_, f"{prints[i]:016x}", smallest.get(top(i))) for i, (id_, *_) in enumerate(rows)])


def test_simhash_on_odd_rows(spark):
    assert by_text(collected(simhash_groups(documents(spark)))) == groups_by_hand(ROWS)


def test_simhash_of_nothing(spark):
    assert simhash_groups(documents(spark, [])).collect() == []


def test_simhash_links_chains(spark, monkeypatch):
    """Planted fingerprints: chains of near values, and values just beyond the distance."""
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 2**63, 12, dtype=np.uint64)]
    values = []
    for v in base:
        for _ in range(12):
            values.append(v)
            for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                v ^= 1 << int(b)
    frame = spark.createDataFrame(pa.table({"value": pa.array(np.array(sorted(set(values)), np.uint64).astype(np.int64))}))
    links = {(r.a, r.b) for r in simhash.near_links(frame, 3).collect()}
    mask = (1 << 64) - 1
    assert all(((a ^ b) & mask).bit_count() <= 3 for a, b in links)
    edges = spark.createDataFrame(pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())}))
    roots = {r.node: r.root for r in components(edges).collect()}
    signed = [v - (1 << 64) if v >> 63 else v for v in sorted(set(values))]
    found = {v: v for v in signed}

    def top(v):
        while found[v] != v:
            v = found[v]
        return v

    for x in signed:
        for y in signed:
            if ((x ^ y) & mask).bit_count() <= 3 and top(x) != top(y):
                found[max(top(x), top(y))] = min(top(x), top(y))
    assert {v: roots.get(v, v) for v in signed} == {v: top(v) for v in signed}


def test_anchor_with_many_homes_is_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOMES", 8)
    values = np.array([(i << 32) | 7 for i in range(200)], np.uint64)
    frame = spark.createDataFrame(pa.table({"value": pa.array(values.astype(np.int64))}))
    links = {(r.a, r.b) for r in simhash.near_links(frame, 3).collect()}
    edges = spark.createDataFrame(pa.table({"a": pa.array([a for a, _ in links]), "b": pa.array([b for _, b in links])}))
    roots = {r.node: r.root for r in components(edges).collect()}
    assert set(roots.values()) == {7} and len(roots) == 200


@pytest.mark.parametrize("bits", [5, 16, 21, 32])
def test_covering_code(bits):
    code = Anchors(bits)
    values = np.random.default_rng(bits).integers(0, 1 << bits, 200, dtype=np.uint64)
    home = code.home(values)
    assert (code.syndrome(home) == 0).all() and (np.bitwise_count(home ^ values) <= 1).all()
    rows, anchors = code.near(values)
    near = [set() for _ in values]
    for i, a in zip(rows.tolist(), anchors.tolist(), strict=True):
        assert a not in near[i]
        near[i].add(a)
    for b in range(bits):
        assert all(int(h) in near[i] for i, h in enumerate(code.home(values ^ np.uint64(1 << b))))


def test_blocks_cover_the_print():
    for distance in range(8):
        parts = blocks(distance)
        assert sum(b for _, b in parts) == 64 and 2 * len(parts) > distance


def test_fingerprint_does_not_depend_on_chunks(monkeypatch):
    text = " ".join(f"Word{i % 77}" for i in range(5000)).encode()
    whole = fingerprint(text)
    monkeypatch.setattr("statloom.llm.common.CHUNK_BYTES", 64)
    assert fingerprint(text) == whole == print_by_hand(text.decode())


# ---- components

def test_components_of_a_star_a_chain_and_a_pair(spark):
    edges = [(0, i) for i in range(1, 300)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 4000), (4000, 5000), (9, 9)]
    frame = spark.createDataFrame(pa.table({"a": [a for a, _ in edges], "b": [b for _, b in edges]}))
    roots = {r.node: r.root for r in components(frame).collect()}
    assert roots == {i: 0 for i in range(300)} | {1000 + i: 1000 for i in range(71)} | {4000: 4000, 5000: 4000}


# ---- substrings

def substrings_by_hand(rows, length=50):
    first = {}
    for id_, text, _ in rows:
        if id_ is not None:
            w = words(text)
            for i in range(len(w) - length + 1):
                key = tuple(w[i:i + length])
                first[key] = min(first.get(key, id_), id_)
    out = []
    for id_, text, _ in rows:
        w = words(text)
        gone = np.zeros(len(w), bool)
        if id_ is not None:
            for i in range(len(w) - length + 1):
                if first[tuple(w[i:i + length])] < id_:
                    gone[i:i + length] = True
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((id_, len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return by_text(out)


SHORT = [(i, t if t is None else t[:20_000], lang) for i, t, lang in ROWS]


def test_substring_dedup_on_odd_rows(spark):
    got = substring_dedup.substring_dedup(documents(spark, SHORT), digest=True)
    want = substrings_by_hand(SHORT)
    assert by_text(collected(got)) == want
    assert sum(r[2] for r in want) > 1000


def test_substring_dedup_of_nothing(spark):
    assert substring_dedup.substring_dedup(documents(spark, [])).collect() == []


def test_substring_dedup_of_long_texts(spark):
    got = {(r.doc_id, r.n_words): r.n_removed for r in substring_dedup.substring_dedup(documents(spark)).collect()}
    assert got[12, 300_000] == 0 and got[13, 300_001] == 300_000


@pytest.mark.parametrize("length", [4, 7, 50])
def test_substring_dedup_of_overlapping_repeats(spark, length):
    rng = np.random.default_rng(length)
    source = [f"w{x}" for x in rng.integers(0, 6 if length < 10 else 400, 400)]
    rows = []
    for i in range(60):
        a, n = rng.integers(0, 300), rng.integers(1, 120)
        text = source[a:a + n] + [f"w{x}" for x in rng.integers(0, 6, rng.integers(0, 20))] + (source[a:a + n] if i % 5 == 0 else [])
        rows.append((int(rng.integers(0, 50)), " ".join(text), "en"))
    got = substring_dedup.substring_dedup(documents(spark, rows), length=length, digest=True)
    assert by_text(collected(got)) == substrings_by_hand(rows, length)


def test_kept_text_is_the_kept_words(spark):
    got = {r.doc_id: r.kept_text for r in substring_dedup.substring_dedup(documents(spark, SHORT)).collect()}
    assert got[11] == "" and got[9].startswith("before shared0") and got[10] == "other words in front and behind"


def test_chunks_of_words_are_the_words(monkeypatch):
    monkeypatch.setattr("statloom.llm.common.CHUNK_BYTES", 10)
    for text in (b"", b"   ", b"abc", b"a bb  ccc\ndddd\x0beeeee " * 7, b"x" * 50 + b" y"):
        assert [w for part in word_chunks(text) for w in part] == text.split()
