"""Encoding and decoding with the pieces of a SentencePiece model, by best total score."""

import re
from array import array
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.llm.common import letters

#: Words whose encoding a worker remembers, with and without a space before; a full memory is started anew.
REMEMBERED = 300_000
#: Longer words are encoded without being remembered.
LONGEST_KEPT = 64
#: What a character that no piece covers scores below the worst piece.
UNKNOWN_PENALTY = 10.0


_RUNS = re.compile(r" +[^ ]*|[^ ]+")


@dataclass(frozen=True)
class Vocabulary:
    """Ordinary pieces (word mark as space) with id and score, byte ids, and whether texts get a space in front."""

    pieces: tuple[tuple[str, int, float], ...]
    byte_ids: tuple[int, ...]
    dummy_prefix: bool


def load(path: str) -> Vocabulary:
    """Read the model on the driver; the vocabulary (bounded by the model) travels with the tasks."""
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    skip = [m.is_control(i) or m.is_unknown(i) or m.is_unused(i) or m.is_byte(i) for i in range(m.get_piece_size())]
    pieces = tuple((m.id_to_piece(i).replace("▁", " "), i, m.get_score(i)) for i, s in enumerate(skip) if not s)
    byte_ids = {int(m.id_to_piece(i)[3:5], 16): i for i in range(len(skip)) if m.is_byte(i)}
    if len(byte_ids) != 256:
        raise ValueError("the model has no byte pieces; texts could not be decoded again")
    return Vocabulary(pieces, tuple(byte_ids[b] for b in range(256)), m.encode("a") == m.encode(" a")[-1:] or m.decode(m.encode("a")) == "a" and m.id_to_piece(m.encode("a")[0])[0] == "▁")


class Memory(dict):
    """Encoded words, each worked out when it is first asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        found = self.encode(word)
        if len(word) <= LONGEST_KEPT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = found
        return found


class Encoder:
    """An Aho-Corasick automaton over the pieces and a memory of encoded words.

    Texts are cut where no piece can reach across: before a run of spaces, and at line breaks if no piece has one.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.automaton = ahocorasick.Automaton()
        for piece, id_, score in vocabulary.pieces:
            self.automaton.add_word(piece, (len(piece), id_, score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, _, s in vocabulary.pieces) - UNKNOWN_PENALTY
        texts = [p for p, _, _ in vocabulary.pieces]
        self.by_space = not any(" " in p.lstrip(" ") for p in texts)
        self.by_line = not any("\n" in p for p in texts)
        self.newline = self.ids("\n") if self.by_line else b""
        self.bare = Memory(self.ids)
        self.spaced = Memory(lambda word: self.ids(" " + word))

    def best(self, text: str) -> tuple[list[int], float]:
        """Ids of the segmentation with the highest total score, and the score; of equals the one with the longest last piece.

        One pass: at each end position the automaton's output links give every piece that ends there, longest first, and
        each relaxes the best score of the position. A character that is no piece of its own may be spelt in bytes.
        """
        n, unknown = len(text), self.unknown
        score = [float("-inf")] * (n + 1)
        score[0] = 0.0
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)

        def spell(at: int):
            if score[at] + unknown > score[at + 1]:
                score[at + 1] = score[at] + unknown
                back[at + 1] = (at, -1)

        last, single = -1, True
        for end, (length, id_, value) in self.automaton.iter(text):
            if end != last:  # the position before is settled; those that no piece ends at are spelt
                if not single:
                    spell(last)
                for at in range(last + 1, end):
                    spell(at)
                last, single = end, False
            if length == 1:
                single = True
            start = end + 1 - length
            if score[start] + value > score[end + 1]:
                score[end + 1] = score[start] + value
                back[end + 1] = (start, id_)
        if not single:
            spell(last)
        for at in range(last + 1, n):
            spell(at)
        out: list[int] = []
        at = n
        while at:
            start, id_ = back[at]
            out.extend([id_] if id_ >= 0 else [self.vocabulary.byte_ids[b] for b in reversed(text[start:at].encode())])
            at = start
        return out[::-1], score[n]

    def ids(self, text: str) -> bytes:
        return array("i", self.best(text)[0]).tobytes()

    def line(self, text: str) -> bytes:
        """A text whose pieces stay between spaces."""
        first, *words = text.split(" ")
        if "" in words:  # runs of spaces
            return b"".join(map(self.bare.__getitem__, _RUNS.findall(text)))
        return (self.bare[first] if first else b"") + b"".join(map(self.spaced.__getitem__, words))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; none for an empty one."""
        if not text:
            return np.empty(0, np.int32)
        text = " " + text if self.vocabulary.dummy_prefix else text
        if not self.by_space:
            return np.frombuffer(self.ids(text), "<i4")
        lines = text.split("\n") if self.by_line else [text]
        return np.frombuffer(self.newline.join(map(self.line, lines)), "<i4")


_encoders: dict[Vocabulary, Encoder] = {}


def encoder(vocabulary: Vocabulary) -> Encoder:
    """The worker's encoder, kept between tasks."""
    if vocabulary not in _encoders:
        _encoders.clear()
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def piece_bytes(vocabulary: Vocabulary) -> pa.Array:
    """The bytes of each id; null for ids that stand for no text."""
    table = {i: p.encode() for p, i, _ in vocabulary.pieces} | {i: bytes([b]) for b, i in enumerate(vocabulary.byte_ids)}
    return pa.array([table.get(i) for i in range(max(table) + 1)], pa.binary())


def decode_lists(lists: pa.ListArray, table: pa.Array, dummy_prefix: bool) -> list[str | None]:
    """Texts of id lists: the bytes of all ids follow each other in one buffer, which is cut per list."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    taken = table.take(lists.flatten())
    if taken.null_count:
        raise ValueError("an id stands for no text")
    raw = taken.buffers()[2].to_pybytes() if len(taken) else b""
    starts = np.frombuffer(taken.buffers()[1], "<i4")[: len(taken) + 1] if len(taken) else np.zeros(1, "<i4")
    cuts = starts[np.r_[0, np.cumsum(sizes)]].tolist()
    out: list[str | None] = []
    for a, b, there in zip(cuts, cuts[1:], lists.is_valid().to_pylist(), strict=False):
        text = raw[a:b].decode("utf-8", "replace")
        out.append((text[1:] if dummy_prefix and text.startswith(" ") else text) if there else None)
    return out


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts: one row per row of `df` with `id_col` and ids (array of int).

    The segmentation is the one of highest total piece score over the model's pieces (of equals the one with the longest
    last piece), with bytes for characters that have no piece. For a model trained by merges this is the best scored
    segmentation, not the one in merge order.
    A null text gives null, an empty one no ids. Null ids and repeated rows are encoded like any other; other columns are
    not looked at; an empty table gives an empty result.

    Map only: nothing is shuffled. The model file is read by the driver; `model_path` is the caller's.
    """
    vocabulary = load(model_path)

    def run(batches):
        own = encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                ids = [None if t is None else own.encode(t) for t in texts]
                sizes = np.cumsum([0, *(0 if i is None else len(i) for i in ids)])
                flat = pa.array(np.concatenate([np.empty(0, np.int32), *(i for i in ids if i is not None)]).astype(np.int32))
                arrays = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat, mask=pa.array([i is None for i in ids]))
                yield pa.RecordBatch.from_arrays([part.column(0), arrays], [id_col, "ids"])

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, T.StructType([df.schema[id_col]]).add("ids", T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of id arrays: one row per row of `df` with `id_col` and text. Null gives null; ids outside the model are an error."""
    vocabulary = load(model_path)

    def run(batches):
        table = piece_bytes(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = decode_lists(part.column(1), table, vocabulary.dummy_prefix)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return df.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, T.StructType([df.schema[id_col]]).add("text", "string"))
