"""A small table with everything that may go wrong, and words as the contracts define them."""

import pyarrow as pa

SPACES = b" \t\n\x0b\x0c\r"
PASSAGE = " ".join(f"shared{i}" for i in range(60))
LONG = " ".join(f"long{i % 997} word{i}" for i in range(150_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog.", "en"),
    (2, "The quick  brown fox\njumps over the lazy dog. ", "en"),
    (3, "The quick brown fox jumps over the lazy dog.", "en"),
    (3, "The quick brown fox jumps over the lazy dog.", "en"),
    (4, None, "en"),
    (5, "", None),
    (6, " \t\n\x0b\x0c\r ", "fr"),
    (7, "12 34 ?! ...", "fr"),
    (8, "Le renard brun saute par-dessus le chien paresseux été ÉTÉ.", "fr"),
    (9, f"before {PASSAGE} after", "en"),
    (10, f"other words in front {PASSAGE} and behind\n{PASSAGE}", "en"),
    (11, PASSAGE, None),
    (12, LONG, "en"),
    (13, LONG + " end", "en"),
    (None, "The quick brown fox jumps over the lazy dog.", "en"),
    (None, f"nameless {PASSAGE}", None),
    (14, "x▁y \U0001f600 日本 \\ ### </turn> <s>", "en"),
    (15, "one", "en"),
    (15, "another text of the same id with seven words", "en"),
    (-3, "negative ids come first, here with a text of some words", "en"),
    (16, "one two", None),
]
#: Names that operators use inside, here as columns of the input.
CLASHES = ["id", "row", "key", "own", "print", "value", "component_id", "fingerprint", "keep_id", "kept", "sha", "digest", "bin", "bin_id",
           "shard", "mark", "words", "runs", "_slot", "_word", "_bits", "score", "unit", "chunk", "n_words", "turns", "anchor"]


def documents(spark, rows=ROWS):
    ids, texts, langs = zip(*rows, strict=True) if rows else ((), (), ())
    table = {"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(langs, pa.string()),
             "source": pa.array([None if i == 5 else f"s{i}" for i in ids], pa.string()),
             "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64())}
    table |= {c: pa.array([f"clash {i}" for i in ids], pa.string()) for c in CLASHES}
    return spark.createDataFrame(pa.table(table))


def words(text):
    return [] if text is None else text.encode().split()


def collected(df):
    return [tuple(r) for r in df.collect()]


def by_text(rows):
    """Sorts rows that may hold nulls."""
    return sorted(rows, key=repr)
