"""Language identification with error-correcting output codes."""

import math

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.llm.common import batches_of, letters, rows_of, settle

#: Hash buckets of the byte n-grams and the n-gram lengths.
BUCKETS, ORDERS = 1 << 16, (2, 3, 4)
#: Labels whose counts a task holds at once; more are passed on and begun anew.
HELD_LABELS = 64
#: Letters of a text are cut into pieces of about so many bytes.
PIECE = 1 << 20
#: Share of a text's n-grams that must have been seen in learning; below it the text is of no learned language.
SEEN = 0.5
#: Why a text has no language, or hardly one.
NO_LETTER, NO_MODEL, UNFAMILIAR = "no letter", "no model", "unfamiliar"
#: Letters and the marks on them, by Unicode category; number signs such as a superscript two are none.
_NO_LETTER = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def codewords(labels: int) -> np.ndarray:
    """A matrix of +1 and -1, a row per label; nothing to tell apart gives no column. Up to 7 labels: every split of the labels into two parts, once.

    Beyond: ceil(10 log2 labels) columns, each the better of several pseudo-random balanced splits by the smallest row distance so far.
    """
    if labels < 2:
        return np.empty((labels, 0), np.int8)
    if labels <= 7:
        columns = [[1 if not i or m >> (i - 1) & 1 else -1 for i in range(labels)] for m in range(2 ** (labels - 1) - 1)]
        return np.array(columns, np.int8).reshape(-1, labels).T
    rng = np.random.default_rng(labels)
    base = np.where(np.arange(labels) % 2, 1, -1).astype(np.int8)
    columns, apart = [], np.zeros((labels, labels), np.int16)
    np.fill_diagonal(apart, np.iinfo(np.int16).max // 2)
    for _ in range(math.ceil(10 * math.log2(labels))):
        tries = [rng.permutation(base) for _ in range(8)]
        best = max(tries, key=lambda c: (apart + (c[:, None] != c[None])).min())
        columns.append(best)
        apart += best[:, None] != best[None]
    return np.array(columns, np.int8).T


def least_distance(code: np.ndarray) -> int:
    """The smallest number of bits in which two codewords differ."""
    return min((int((code[i + 1:] != code[i]).sum(1).min()) for i in range(len(code) - 1)), default=0)


def grams(text: str):
    """Buckets of the byte n-grams of the letters of a text, lower-cased, with one space between words; piece by piece."""
    for at in range(0, len(text), PIECE):
        words = _NO_LETTER.sub(" ", text[at:at + PIECE].lower()).strip()
        if not _LETTER.search(words):
            continue
        b = np.frombuffer(f"  {words}  ".encode(), np.uint8).astype(np.uint64)
        out, code = [], b
        for n in range(2, max(ORDERS) + 1):
            code = (code[:-1] << np.uint64(8)) | b[n - 1:]
            if n in ORDERS:
                out.append((((code * np.uint64(8) + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64))
        yield np.concatenate(out)


def _add(row: np.ndarray, g: np.ndarray) -> None:
    if len(g) < BUCKETS // 16:
        some, n = np.unique(g, return_counts=True)
        row[some] += n
    else:
        row += np.bincount(g, minlength=BUCKETS)


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(label, bucket, n) over all rows of (label, text): counted in arrays per task, added up by Spark."""

    def told(counts):
        for label, row in counts.items():
            some = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(row[some])], ["label", "bucket", "n"])

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for g in grams(text):
                    if label not in counts and len(counts) == HELD_LABELS:
                        yield from told(counts)
                        counts = {}
                    _add(counts.setdefault(label, np.zeros(BUCKETS, np.int64)), g)
        yield from told(counts)

    return labelled.mapInArrow(run, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))


def _bit_weights(labels: dict[bytes, int], totals: np.ndarray, code: np.ndarray):
    """For each bucket that was seen the log odds of every bit, and its mean share over the labels. Rows come bucket by bucket.

    A label's share of a bucket is its count plus a half over its total; the labels of a side weigh alike.
    """
    sides = [code > 0, code < 0]
    base = 0.5 / totals
    rest = [(s * base[:, None]).sum(axis=0) for s in sides]
    sizes = [s.sum(axis=0) for s in sides]
    schema = pa.schema([("bucket", pa.int32()), ("weights", pa.binary()), ("share", pa.float64())])

    def told(bucket, share):
        up, down = ((rest[i] + (sides[i] * share[:, None]).sum(axis=0)) / sizes[i] for i in (0, 1))
        return bucket, (np.log(up) - np.log(down)).astype("<f4").tobytes(), float((base + share).mean())

    def run(rows):
        now, share = None, None
        for bucket, label, n in rows:
            if bucket != now:
                if now is not None:
                    yield told(now, share)
                now, share = bucket, np.zeros(len(totals))
            share[labels[label]] += n / totals[labels[label]]
        if now is not None:
            yield told(now, share)

    return lambda batches: batches_of(run(rows_of(batches, "bucket", "label", "n")), schema)


class CodeModel:
    """Weights of one binary n-gram classifier per bit, and the codewords they vote on. An n-gram that was never seen weighs nothing."""

    def __init__(self, labels: list[str], buckets: np.ndarray, weights: np.ndarray, shares: np.ndarray):
        self.labels = labels
        self.code = codewords(len(labels))
        self.apart = least_distance(self.code)
        self.weights = np.zeros((BUCKETS, self.code.shape[1]), np.float32)
        self.weights[buckets] = weights
        self.seen = np.zeros(BUCKETS, bool)
        self.seen[buckets] = True
        spread = np.sqrt((weights.astype(np.float64)**2 * shares[:, None]).sum(axis=0))
        self.scale = 1 / np.maximum(spread, 1e-6)  # a bit that separates little speaks as loud as the others

    def decode(self, margins: np.ndarray) -> tuple[int, float, bool]:
        """Nearest codeword under exponential loss, its share of the decoded mass, and whether a second one is close."""
        return self.nearest(margins)[:3]

    def nearest(self, margins: np.ndarray) -> tuple[int, float, bool, float]:
        """Nearest codeword under exponential loss, its share of the decoded mass, whether a second one is close, and its loss.

        Ambiguous: the loss of the second is within 5 % of the first, or as many bits disagree with the codeword as the code's
        distance allows to correct, plus one.
        """
        if len(self.labels) == 1:
            return 0, 1.0, False, 0.0
        loss = np.exp(-np.clip(self.code * margins, -20, 20)).mean(axis=1)
        order = np.argsort(loss, kind="stable")
        best, second = order[0], order[1]
        share = np.exp(-8 * (loss / loss[best] - 1))
        bits = (np.sign(margins) * self.code[best] < 0).sum()
        return int(best), float(share[best] / share.sum()), bool(loss[second] <= 1.05 * loss[best] or bits > (self.apart - 1) // 2), float(loss[best])

    def predict(self, text: str) -> tuple[str, float, bool, str | None]:
        """Label, score, ambiguous, and the reason if the text has no language or is of none that was learned."""
        total, n, seen = np.zeros(self.code.shape[1]), 0, 0
        for g in grams(text):
            n += len(g)
            seen += int(self.seen[g].sum())
            for at in range(0, len(g), 1 << 17):
                total += self.weights[g[at:at + (1 << 17)]].sum(axis=0, dtype=np.float64)
        if not n or not self.labels:
            return "und", 0.0, True, NO_MODEL if n else NO_LETTER
        best, score, ambiguous, _ = self.nearest(total / max(seen, 1) * self.scale)
        strange = seen < SEEN * n
        return self.labels[best], score, ambiguous or strange, UNFAMILIAR if strange else None


def fit(labelled: DataFrame, label_col: str = "lang", text_col: str = "text") -> CodeModel:
    """Learn from every row with a label and a text. The driver receives the labels with their totals, and for each of at most BUCKETS buckets a
    number per bit of the code, which has ten bits for each doubling of the labels."""
    rows = labelled.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text")).where("label IS NOT NULL AND text IS NOT NULL")
    counts = settle(gram_counts(rows))
    lines = counts.groupBy("label").agg(F.sum("n").alias("n")).orderBy("label").collect()
    labels = [r["label"] for r in lines]
    if not labels:
        return CodeModel([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros(0))
    totals = np.array([r["n"] + 0.5 * BUCKETS for r in lines])
    places = {x.encode(): i for i, x in enumerate(labels)}
    learn = _bit_weights(places, totals, codewords(len(labels)))
    learned = counts.repartition("bucket").sortWithinPartitions("bucket", "label").mapInArrow(learn, "bucket int, weights binary, share double").toArrow()
    weights = np.frombuffer(b"".join(learned.column(1).to_pylist()), "<f4").reshape(learned.num_rows, codewords(len(labels)).shape[1])
    return CodeModel(labels, learned.column(0).to_numpy(), weights, learned.column(2).to_numpy())


def predict(df: DataFrame, model: CodeModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `df`: `id_col`, lang_pred, score (0 to 1), ambiguous, reason.

    The reason says why a text has no language (`und`, score 0, ambiguous): no letter, or no model (nothing was labelled); or why its label
    means little (ambiguous): unfamiliar, if less than SEEN of its n-grams occur in the learned texts. Else it is null.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lang, score, ambiguous, reason = zip(*(model.predict(t) for t in part.column(1).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ambiguous, pa.bool_()),
                                                  pa.array(reason, pa.string())], [id_col, "lang_pred", "score", "ambiguous", "reason"])

    schema = T.StructType([df.schema[id_col]]).add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean").add("reason", "string")
    return df.select(F.col(id_col), letters(text_col).alias("text")).mapInArrow(run, schema)


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into a fold; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def language_id(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", folds: int = 5, fold: int = 0,
                why: bool = False) -> DataFrame:
    """Learn from the labelled rows outside the held-out fold, then predict every row.

    One row per row of `df`: `id_col`, held_out, lang_pred, score, ambiguous; with `why` also reason (see `predict`). A text that is null
    or has no letter gets `und`, score 0 and ambiguous; so does every row if nothing is labelled. A text of no learned language gets the
    nearest label and is ambiguous. Rows with a null id are not held out. Only text enters a
    prediction; labels, ids and other columns do not. Repeated rows count as often as they occur; an empty table gives an empty
    result. Ties between codewords go to the label that sorts first.

    Byte n-grams of all learning rows are counted per label in one pass (map-side arrays, one aggregation); each bit of the
    labels' codewords gets log odds per n-gram; decoding takes the codeword of least exponential loss.
    """
    out = held_out(id_col, folds, fold)
    model = fit(df.where(~out), label_col, text_col)
    return predict(df, model, id_col, text_col).select(id_col, out.alias("held_out"), "lang_pred", "score", "ambiguous", *(["reason"] if why else []))
