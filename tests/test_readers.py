"""CSV files against one reader of the whole file, however they are split."""

import csv
import io
import random

import pytest

from statloom.sources import readers


def by_hand(text):
    """(header, rows) by one sequential reader; cells beyond the header get a name of their place, blank lines are skipped."""
    records = [[c or None for c in r] for r in csv.reader(io.StringIO(text, newline="")) if r]
    width = max(max((i + 1 for i, c in enumerate(r) if c is not None), default=0) for r in records)
    names = readers._names(records[0], width)
    return names, [tuple((r + [None] * len(names))[:len(names)]) for r in records[1:]]


def read(spark, path, size, bits):
    """The lines are read in splits of `size` bytes; what is written from them is read as usual."""
    before, written = readers.PIECE_BITS, readers.settle

    def once(df):
        out = written(df)
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        return out

    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    readers.PIECE_BITS, readers.settle = bits, once
    try:
        df = readers.read_csv(spark, str(path))
        names = readers.data_columns(df)
        rows = df.orderBy(readers.ROW_ID).collect()
    finally:
        readers.PIECE_BITS, readers.settle = before, written
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    return names, rows


def random_file(rng, ends):
    """Cells with commas, quotes, line ends of all kinds; blank lines, short and long records, stray quotes inside cells."""
    def cell():
        kind = rng.random()
        if kind < 0.5:
            return rng.choice(["", "x", "12", "a b", " pad ", 'in"side', "é"])
        inner = "".join(rng.choice(["a", ",", '""', "\n", "\r\n", "\r", " ", "long text "]) for _ in range(rng.randrange(6)))
        return f'"{inner}"'

    lines = ['id,"na\nme",c']
    for i in range(rng.randrange(1, 60)):
        if rng.random() < 0.1:
            lines.append("")
        lines.append(",".join([f"r{i}", *(cell() for _ in range(rng.randrange(5)))]))
    return rng.choice(ends).join(lines) + rng.choice(["", "\n"])


@pytest.mark.parametrize("seed", range(5))
def test_split_files_equal_one_reader(spark, tmp_path, seed):
    rng = random.Random(seed)
    text = random_file(rng, ["\n", "\r\n"] if seed else ["\r"])
    (tmp_path / "a b%41[1].csv").write_bytes(text.encode())
    names, rows = read(spark, tmp_path, [37, 53, 64, 1000, 41, 31][seed], seed % 3 + 1)
    assert (names, [tuple(r)[2:] for r in rows]) == by_hand(text)
    assert [r[readers.ROW_ID] for r in rows] == list(range(len(rows)))


def test_cell_over_many_splits(spark, tmp_path):
    inner = "\n".join(f"line {i}, text" for i in range(120))
    text = f'a,b\n1,"{inner}"\n2,y\n\n3,"z\nz"\n'
    (tmp_path / "a.csv").write_text(text)
    names, rows = read(spark, tmp_path, 100, 3)
    assert (names, [tuple(r)[2:] for r in rows]) == by_hand(text)


def test_nothing_is_lost(spark, tmp_path):
    """Cells beyond the header, a line break in the header, a last line without an end."""
    (tmp_path / "a.csv").write_text('"a\nb",c,d,e\n1,2,3,4\n2,b,c,d,x,,y\n5', encoding="utf-8")
    names, rows = read(spark, tmp_path, 1000, 16)
    assert names == ["a\nb", "c", "d", "e", "_c4", "_c5", "_c6"]
    assert [tuple(r)[2:] for r in rows] == [("1", "2", "3", "4", None, None, None), ("2", "b", "c", "d", "x", None, "y"), ("5", *[None] * 6)]


def test_a_quote_that_is_never_closed_stays_in_its_line(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x\n2,y\n3,"q"\n4,"open\n5,z\n6,w\n')
    names, rows = read(spark, tmp_path, 20, 1)
    # the first quote is closed before q, as any reader has it; the last one has no end
    assert [tuple(r)[2:] for r in rows] == [("1", 'x\n2,y\n3,q"'), ("4", "open"), ("5", "z"), ("6", "w")]


def test_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    (tmp_path / "b.csv").write_text("x,y\n")
    names, rows = read(spark, tmp_path, 1000, 16)
    assert (names, rows) == (["x", "y"], [])


def test_header_names(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,x,,\n1,2,3,\n")
    (tmp_path / "b.csv").write_text("y\n1\n")
    df = readers.read_csv(spark, str(tmp_path), header="own")
    assert {tuple(r["own"]) for r in df.collect()} == {("x", "x.1", "_c2"), ("y",)}
