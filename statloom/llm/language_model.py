"""Bigram scoring: an Elias-Fano trie per shard of contexts, built from all learning rows and asked by all rows."""

import math
import os
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import letters, settle, text_bytes, word_chunks

#: Tokens of texts that are encoded together, and token pairs that one shard of the trie is to hold about.
CHUNK_TOKENS, SHARD_TOKENS = 2_000_000, 1_500_000
LEAST_SHARDS = 64
#: A context's successors are spread over so many shards, so that a very common word is not one shard's.
SPREAD = 16
#: Weight of the unigram distribution in a context, in tokens.
PRIOR = 200.0
#: Quantised log10 probabilities: 16 bits over 0 to -FLOOR.
FLOOR, CODES = 16.0, 65534
#: Hash of the token that ends a text; no word can contain its bytes.
END = xxhash.xxh3_64_intdigest(b"\n end")


# ---- packed arrays

def squeeze(values: np.ndarray) -> bytes:
    """An array as compressed byte planes."""
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T if len(values) else np.empty(0, np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expand(packed: bytes, kind: str) -> np.ndarray:
    """The array that `squeeze` took."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


class EliasFano:
    """An ascending sequence of unsigned numbers: low bytes verbatim, high parts in unary, searched as they lie."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray):
        self.n, self.width, self.low, self.high = n, width, low.reshape(n, width), high
        zeros = np.flatnonzero(np.unpackbits(high, bitorder="little") == 0)
        self.ends = zeros - np.arange(len(zeros))  # of each high part's numbers

    @staticmethod
    def encode(values: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
        n = len(values)
        top = int(values[-1]) if n else 0
        width = min(7, max(1, math.ceil(math.log2(max(2, (top + 1) / max(1, n))) / 8)))
        low = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        high = (values >> np.uint64(8 * width)).astype(np.int64)
        bits = np.zeros((int(high[-1]) if n else 0) + 1 + n, np.uint8)
        bits[high + np.arange(n)] = 1
        return n, width, np.ascontiguousarray(low), np.packbits(bits, bitorder="little")

    def _low(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for k in range(self.width):
            out |= self.low[at, k].astype(np.uint64) << np.uint64(8 * k)
        return out

    def find(self, values: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Position of each value within [begin, end), -1 if it is not there: its successor there is another number."""
        high = (values >> np.uint64(8 * self.width)).astype(np.int64)
        low = values & np.uint64((1 << (8 * self.width)) - 1)
        inside = high < len(self.ends)
        high = np.minimum(high, len(self.ends) - 1)
        a = np.where(high > 0, self.ends[high - 1], 0)
        b = np.minimum(self.ends[high], self.n)
        if begin is not None:
            a, b = np.maximum(a, begin), np.minimum(b, end)
        b = np.where(inside, b, a)
        stop = b
        while (open_ := a < b).any():
            mid = (a + b) >> 1
            less = np.zeros(len(a), bool)
            less[open_] = self._low(mid[open_]) < low[open_]
            a, b = np.where(open_ & less, mid + 1, a), np.where(open_ & ~less, mid, b)
        out = np.full(len(values), -1, np.int64)
        there = np.flatnonzero(a < stop)
        there = there[self._low(a[there]) == low[there]]
        out[there] = a[there]
        return out


class Trie:
    """Two levels in one memory-mapped file: contexts with monotone pointers, and their successors with coded probabilities.

    A successor is stored relative to its context: rank of the context times the number of word ids, plus the word id. That
    makes the level one ascending sequence, and a search in it stays within the context's pointers.
    """

    def __init__(self, path: str, words: int):
        self.words = np.uint64(words)
        raw = np.memmap(path, np.uint8, "r")
        head = raw[:72].view("<i8")
        (nc, wc, lc, n, w, low, high, pointers, _) = head.tolist()
        at = 72

        def take(size):
            nonlocal at
            at += size
            return raw[at - size:at]

        self.contexts = EliasFano(nc, wc, take(nc * wc), take(lc))
        self.successors = EliasFano(n, w, take(low), take(high))
        starts = take(pointers)
        self.codes = take(2 * n)
        bits = np.unpackbits(starts, bitorder="little")  # pointers in unary: a zero per context, a one per successor
        zeros = np.flatnonzero(bits == 0)[: nc + 1]
        self.pointers = zeros - np.arange(len(zeros))

    @staticmethod
    def write(path: str, contexts: np.ndarray, keys: np.ndarray, codes: np.ndarray, words: int) -> None:
        """`keys`: ascending, rank of the context times `words` plus word id; `codes`: uint16 per key."""
        nc, wc, low_c, high_c = EliasFano.encode(contexts)
        n, w, low, high = EliasFano.encode(keys)
        counts = np.bincount((keys // np.uint64(words)).astype(np.int64), minlength=nc)
        unary = np.ones(n + nc + 1, np.uint8)
        unary[np.r_[0, np.cumsum(counts)] + np.arange(nc + 1)] = 0
        unary = np.packbits(unary, bitorder="little")
        head = np.array([nc, wc, len(high_c), n, w, low.size, len(high), len(unary), 0], "<i8")
        with open(path, "wb") as f:
            for part in (head, low_c, high_c, low, high, unary, codes.astype("<u2")):
                f.write(np.ascontiguousarray(part).tobytes())

    def code(self, contexts: np.ndarray, sizes: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Codes of pairs, given by runs of one context; 0 where the pair is not in the trie."""
        rank = self.contexts.find(contexts)
        begin = np.where(rank >= 0, self.pointers[rank], 0)
        end = np.where(rank >= 0, self.pointers[rank + 1], 0)
        base = np.maximum(rank, 0).astype(np.uint64) * self.words
        where = self.successors.find(np.repeat(base, sizes) + words, np.repeat(begin, sizes), np.repeat(end, sizes))
        codes = self.codes.view("<u2")
        return np.where(where >= 0, codes[np.maximum(where, 0)] if len(codes) else 0, 0).astype("<u2")


# ---- chunks of texts

def _chunks(kind: pa.DataType):
    """Texts of a task, in chunks: ids, learning flags, token counts, sorted hashes of the chunk's words with their counts among
    learning texts, tokens as positions among those."""

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        ids, learn, hashes, n = [], [], [], 0

        def chunk():
            nonlocal number
            flat = np.concatenate(hashes)
            sizes = np.array([len(h) for h in hashes], np.int32)
            words, tokens = np.unique(flat, return_inverse=True)
            flags = np.array(learn, bool)
            counts = np.bincount(tokens, np.repeat(flags, sizes), len(words)).astype(np.int32)
            row = [[(part << 32) | number], [ids], [flags.astype(np.uint8).tobytes()], [squeeze(sizes)], [int(sizes.sum())],
                   [words.tobytes()], [squeeze(counts)], [squeeze(tokens.astype(np.int32))]]
            number += 1
            names = ["chunk", "ids", "learn", "sizes", "n", "words", "counts", "tokens"]
            kinds = [pa.int64(), pa.list_(kind), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            for id_, flag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), strict=True):
                words = [np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w)) for w in word_chunks(text.lower())]
                ids.append(id_)
                learn.append(flag)
                hashes.append(np.concatenate([*words, np.array([END], np.uint64)]))
                n += len(hashes[-1])
                if n >= CHUNK_TOKENS:
                    yield chunk()
                    ids, learn, hashes, n = [], [], [], 0
        if ids:
            yield chunk()

    return run


def _word_slices(shards: int):
    """A chunk's words by shard: equal ranges of the hash."""
    edges = np.array([(i << 64) // shards for i in range(shards)], np.uint64)

    def run(batches):
        for batch in batches:
            for chunk, words, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, counts = np.frombuffer(words, np.uint64), expand(counts, "<i4")
                cuts = np.r_[np.searchsorted(words, edges), len(words)]
                some = np.flatnonzero(cuts[1:] > cuts[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some.astype(np.int32)), pa.array(np.full(len(some), chunk)),
                     pa.array([words[cuts[s]:cuts[s + 1]].tobytes() for s in some]), pa.array([squeeze(counts[cuts[s]:cuts[s + 1]]) for s in some])],
                    ["shard", "chunk", "words", "counts"])

    return run


def _word_totals(table: pa.Table) -> pa.Table:
    """All chunks' words of one shard: their ranks among the learnt words of the shard and their total counts."""
    words = [np.frombuffer(w, np.uint64) for w in table.column("words").to_pylist()]
    counts = [expand(c, "<i4") for c in table.column("counts").to_pylist()]
    known, place = np.unique(np.concatenate(words), return_inverse=True)
    total = np.bincount(place, np.concatenate(counts), len(known)).astype(np.int64)
    rank = np.cumsum(total > 0) - 1
    ends = np.cumsum([len(w) for w in words])[:-1]
    return pa.table({
        "chunk": table.column("chunk"), "shard": table.column("shard"), "kind": pa.array(["word"] * len(words)),
        "a": pa.array([squeeze(rank[p]) for p in np.split(place, ends)]), "b": pa.array([squeeze(total[p]) for p in np.split(place, ends)]),
        "distinct": pa.array([int((total > 0).sum())] + [0] * (len(words) - 1)), "tokens": pa.array([int(total.sum())] + [0] * (len(words) - 1))})


class _Chunk:
    """A chunk with the totals of its words, and its pairs (context, token) in order of shard, context, word."""

    def __init__(self, row: dict, answers: list[dict], per_shard: int, shards: int):
        words = sorted((a for a in answers if a["kind"] == "word"), key=lambda a: a["shard"])
        self.ids, self.learn = row["ids"], np.frombuffer(row["learn"], np.uint8).astype(bool)
        self.sizes, self.tokens = expand(row["sizes"], "<i4").astype(np.int64), expand(row["tokens"], "<i4").astype(np.int64)
        rank = [expand(a["a"], "<i8") + a["shard"] * per_shard + 1 for a in words]
        count = np.concatenate([expand(a["b"], "<i8") for a in words])
        end = int(self.tokens[-1])  # every text ends with it
        # the last place stands for a text's beginning: id 0, as often as a text ends
        self.id = np.append(np.concatenate(rank), 0)
        self.count = np.append(count, count[end])
        start = len(count)
        before = np.r_[start, self.tokens[:-1]]
        before[np.cumsum(self.sizes)[:-1]] = start
        keys, self.pair = np.unique(before * (start + 1) + self.tokens, return_inverse=True)
        self.context, self.word = np.divmod(keys, start + 1)
        known = np.flatnonzero((self.count[self.context] > 0) & (self.count[self.word] > 0))
        shard = _mix(self.id[self.context[known]] * SPREAD + self.id[self.word[known]] % SPREAD) % np.uint64(shards)
        order = np.argsort(shard, kind="stable")
        self.known, self.shard = known[order], shard[order].astype(np.int64)

    def learnt(self) -> np.ndarray:
        """How often each known pair occurs in learning texts."""
        flags = np.repeat(self.learn, self.sizes)
        return np.bincount(self.pair, flags, len(self.context)).astype(np.int64)[self.known]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_PAIRS = "shard int, chunk long, contexts binary, sizes binary, contextcounts binary, words binary, wordcounts binary, counts binary"


def _pair_slices(per_shard: int, shards: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {f.split()[0]: [] for f in _PAIRS.split(", ")}
        for row in left.to_pylist():
            c = _Chunk(row, right.to_pylist(), per_shard, shards)
            learnt = c.learnt()
            cuts = np.searchsorted(c.shard, np.unique(c.shard)).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(c.shard)], strict=False):
                context, word = c.context[c.known[a:b]], c.word[c.known[a:b]]
                first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
                out["shard"].append(int(c.shard[a]))
                out["chunk"].append(row["chunk"])
                out["contexts"].append(squeeze(c.id[context[first]]))
                out["sizes"].append(squeeze(np.diff(np.r_[first, b - a]).astype(np.int32)))
                out["contextcounts"].append(squeeze(c.count[context[first]]))
                out["words"].append(squeeze(c.id[word]))
                out["wordcounts"].append(squeeze(c.count[word]))
                out["counts"].append(squeeze(learnt[a:b].astype(np.int32)))
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
        return pa.table([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    return run


def _trie_answers(learnt_tokens: int, distinct: int, words: int, prior: float):
    """Builds the trie of one shard and answers every chunk's pairs with it."""

    def run(table: pa.Table) -> pa.Table:
        parts = [(expand(a, "<i8").astype(np.uint64), expand(b, "<i4"), expand(c, "<i8"), expand(d, "<i8").astype(np.uint64), expand(e, "<i8"), expand(f, "<i4"))
                 for a, b, c, d, e, f in zip(*(table.column(n).to_pylist() for n in ("contexts", "sizes", "contextcounts", "words", "wordcounts", "counts")), strict=True)]
        contexts = np.unique(np.concatenate([p[0] for p in parts]))
        keys = np.concatenate([np.repeat(np.searchsorted(contexts, p[0]).astype(np.uint64) * np.uint64(words), p[1]) + p[3] for p in parts])
        keys, first, place = np.unique(keys, return_index=True, return_inverse=True)
        count = np.bincount(place, np.concatenate([p[5] for p in parts]), len(keys))
        del place
        in_context = np.concatenate([np.repeat(p[2], p[1]) for p in parts])[first]
        alone = (np.concatenate([p[4] for p in parts])[first] + 1) / (learnt_tokens + distinct + 1)
        kept = count > 0
        log = np.log10((count[kept] + prior * alone[kept]) / (in_context[kept] + prior))
        codes = 1 + np.round(np.minimum(-log / FLOOR, 1) * (CODES - 1))
        with tempfile.TemporaryDirectory() as folder:  # the executor's own; gone when the shard is answered
            path = os.path.join(folder, "trie")
            Trie.write(path, contexts, keys[kept], codes, words)
            trie = Trie(path, words)
            answers = [squeeze(trie.code(p[0], p[1], p[3])) for p in parts]
            del trie
        n = len(parts)
        return pa.table({"chunk": table.column("chunk"), "shard": table.column("shard"), "kind": pa.array(["pair"] * n), "a": pa.array(answers),
                         "b": pa.array([b""] * n)})

    return run


def _scores(kind: pa.DataType, per_shard: int, shards: int, learnt_tokens: int, distinct: int, prior: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            answers = right.to_pylist()
            c = _Chunk(row, answers, per_shard, shards)
            codes = np.zeros(len(c.context), np.int64)
            pairs = sorted((a for a in answers if a["kind"] == "pair"), key=lambda a: a["shard"])
            if pairs:
                codes[c.known] = np.concatenate([expand(a["a"], "<u2") for a in pairs])
            alone = np.log10((c.count + 1) / (learnt_tokens + distinct + 1))
            log = np.log10(prior / (c.count[c.context] + prior)) + alone[c.word]
            log = np.where(codes > 0, -(codes - 1) * (FLOOR / (CODES - 1)), log)
            starts = np.r_[0, np.cumsum(c.sizes)[:-1]]
            out.append(pa.table({
                "id": pa.array(c.ids, kind), "n_tokens": c.sizes, "n_known": np.add.reduceat((c.count[c.tokens] > 0).astype(np.int64), starts),
                "base_score": np.add.reduceat(alone[c.tokens], starts), "score": np.add.reduceat(log[c.pair], starts)}))
        return pa.concat_tables(out)

    return run


def score_texts(df: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text", prior: float = PRIOR) -> DataFrame:
    """Score every text with a bigram model learnt from the rows where `learns` holds.

    Tokens: words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, then one end. With c the learnt count of a token, N of all, V of
    distinct ones: P(w) = (c + 1) / (N + V + 1), and after a context h, P(w | h) = (c(h, w) + prior P(w)) / (c(h) + prior);
    the first token's context is the text's beginning. A word never learnt is one common class, so probabilities sum to 1.

    One row per row of `df`: `id_col`, n_tokens, n_known (c > 0), train_tokens (N), base_score (log10 of the product of P(w)),
    score (of P(w | h); learnt pairs as 16-bit codes, at most 0.00013 off each). A null text is empty and scores its end token. Null ids and
    repeated rows are scored like any other; a null `learns` counts as false; without learning rows both scores are 0
    per token. Other columns are not looked at; an empty table gives an empty result.

    Texts are encoded once, in chunks. Chunks send their distinct words to shards and get totals back, then their
    distinct pairs to shards by context (a context's successors over SPREAD of them) and get codes back. Each shard builds
    its trie from all learning pairs, writes it to a file, maps it and searches it. Shards follow the number of tokens.
    """
    kind = pa.int64()
    name = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(learns, F.lit(False)).alias("learns"), letters(text_col).alias("text"))
    chunks = settle(rows.mapInArrow(_chunks(kind), "chunk long, ids array<bigint>, learn binary, sizes binary, n long, words binary, counts binary, tokens binary"))
    shards = max(LEAST_SHARDS, -(-(chunks.agg(F.sum("n")).first()[0] or 0) // SHARD_TOKENS))
    slices = chunks.select("chunk", "words", "counts").mapInArrow(_word_slices(shards), "shard int, chunk long, words binary, counts binary")
    totals = slices.groupBy("shard").applyInArrow(_word_totals, "chunk long, shard int, kind string, a binary, b binary, distinct long, tokens long")
    totals = settle(totals)
    distinct, learnt, most = totals.agg(F.sum("distinct"), F.sum("tokens"), F.max("distinct")).first()
    distinct, learnt, per_shard = distinct or 0, learnt or 0, max(1, most or 0)
    words = shards * per_shard + 1
    totals = totals.select("chunk", "shard", "kind", "a", "b")
    texts = chunks.select("chunk", "ids", "learn", "sizes", "tokens")
    pairs = texts.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(_pair_slices(per_shard, shards), _PAIRS)
    answers = pairs.groupBy("shard").applyInArrow(_trie_answers(learnt, distinct, words, prior), "chunk long, shard int, kind string, a binary, b binary")
    answers = totals.union(settle(answers))
    scored = texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _scores(kind, per_shard, shards, learnt, distinct, prior), "id long, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("id").cast(name).alias(id_col), "n_tokens", "n_known", F.lit(learnt).cast("long").alias("train_tokens"), "base_score", "score")
