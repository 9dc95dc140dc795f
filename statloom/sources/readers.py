"""Table readers: CSV files and folders as text columns with row ids, and the intake gate."""

import csv
import io
import re
import sys
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom import fixed_values as fv
from statloom.operators.skew import lookup_by_key
from statloom.session import settle

# UTF-8 is kept when every line is valid; the single-byte encoding reads anything else.
ENCODINGS = ["UTF-8", "ISO-8859-1"]
ROW_ID, FILE = "_row_id", "_file"


#: Lines of a file are looked at in pieces of so many (as a power of two); a piece is the unit in which work is spread.
PIECE_BITS = 16
#: What a quoted line does to the reading state: bit 0 is the state after it (1: inside quotes) if it begins outside, bit 1 if inside.
_KEEPS = 0b10


def files_of(spark: SparkSession, path) -> list[tuple[str, str]]:
    """(file, encoding) in order of the file names; one pass over the lines.

    A file is UTF-8 if every line is, and is read by the single-byte encoding otherwise.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    rows = lines.groupBy("file").agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8")).orderBy("file").collect()
    return [(r["file"], ENCODINGS[0] if r["utf8"] else ENCODINGS[1]) for r in rows]


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line of a CSV file ends inside a quoted cell. Quotes open a cell only at its beginning; doubled ones are text."""
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            while at >= 0 and line[at + 1:at + 2] == '"':
                at = line.find('"', at + 2)
            if at < 0:
                return True
            inside = False
        elif line[at:at + 1] == '"':
            inside, at = True, at + 1
            continue
        at = line.find(",", at) + 1
        if not at:
            return False


@F.pandas_udf(T.IntegerType())
def _turn(lines: pd.Series) -> pd.Series:
    """The state map of each line that holds a quote; null elsewhere."""
    return pd.Series([None if x is None else ends_inside(x, False) + 2 * ends_inside(x, True) for x in lines], dtype="Int32")


def _lines(spark: SparkSession, files: list[str], encoding: str) -> DataFrame:
    """(file, block, at, text, term, turn): physical lines without their ends, and the ends. Every file is split like any text file."""
    raw = spark.read.option("lineSep", "\n").text([_no_glob(f) for f in files])
    value = F.col("value") if encoding == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    bare = F.when(F.endswith("value", F.lit("\r")), F.expr("substring(value, 1, length(value) - 1)")).otherwise(F.col("value"))
    ended = F.when(F.endswith("value", F.lit("\r")), F.lit("\r\n")).otherwise(F.lit("\n"))
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), value.alias("value"))
    rows = rows.select("file", "block", ended.alias("ended"), F.split(bare, "\r").alias("parts"))
    rows = rows.select("file", "block", "ended", F.size("parts").alias("n"), F.posexplode("parts").alias("i", "text"))
    rows = rows.select("file", "block", F.monotonically_increasing_id().alias("at"), "text", F.when(F.col("i") + 1 == F.col("n"), F.col("ended")).otherwise(F.lit("\r")).alias("term"))
    return rows.withColumn("turn", F.coalesce(_turn(F.when(F.contains("text", F.lit('"')), F.col("text"))), F.lit(_KEEPS)))


def _numbered(lines: DataFrame) -> DataFrame:
    """Add `pos`, the number of a line in its file, and `piece`. Blocks of a file are counted and the counts summed up; a block's lines follow
    each other."""
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("_start"), F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", "_start", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = lookup_by_key(lines, blocks, ["file", "block"])
    placed = placed.withColumn("pos", F.col("at") - F.col("_start") + F.col("_before"))
    return placed.select("file", "pos", F.expr(f"shiftright(pos, {PIECE_BITS})").alias("piece"), "text", "term", "turn")


def _piece_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Quoted lines in order, file by file and piece by piece: for both states at the piece's beginning the state at its end and the line on
    which the record that is open there began (null: before the piece)."""
    now, ends, opened = None, [0, 1], [None, None]
    out = []
    for batch in batches:
        for file, piece, pos, turn in zip(*(c.to_pylist() for c in batch.columns)):
            if now != (file, piece):
                if now:
                    out.append((*now, *ends, *opened))
                now, ends, opened = (file, piece), [0, 1], [None, None]
            for i in (0, 1):
                after = turn >> ends[i] & 1
                if after and not ends[i]:
                    opened[i] = pos
                ends[i] = after
        if len(out) > 4096:
            yield _table(out, _MAPS)
            out = []
    if now:
        out.append((*now, *ends, *opened))
    if out:
        yield _table(out, _MAPS)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Piece maps in order, file by file: the state at the beginning of each piece and the line on which an open record began."""
    now, state, opened = None, 0, None
    for batch in batches:
        out = []
        for file, piece, *maps in zip(*(c.to_pylist() for c in batch.columns)):
            if file != now:
                now, state, opened = file, 0, None
            end, begun = maps[state], maps[2 + state]
            # the pieces after this one begin in its end state until another piece with quotes ends
            opened = (begun if begun is not None else opened) if end else None
            state = end
            out.append((file, piece, state, opened))
        if out:
            yield _table(out, _STARTS)


def _records_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in order, each with the state in which its piece begins: the line on which its record began."""
    now, inside, opened = None, False, None
    for batch in batches:
        out = []
        for file, piece, pos, turn, begins, since in zip(*(c.to_pylist() for c in batch.columns)):
            if now != (file, piece):
                now, inside, opened = (file, piece), bool(begins), since
            out.append((file, pos, opened if inside else pos))
            after = bool(turn >> inside & 1)
            if after and not inside:
                opened = pos
            inside = after
        yield _table(out, _BEGUN)


_MAPS = pa.schema([("file", pa.string()), ("piece", pa.int64()), ("out0", pa.int32()), ("out1", pa.int32()), ("open0", pa.int64()), ("open1", pa.int64())])
_STARTS = pa.schema([("file", pa.string()), ("piece", pa.int64()), ("state", pa.int32()), ("since", pa.int64())])
_BEGUN = pa.schema([("file", pa.string()), ("pos", pa.int64()), ("begun", pa.int64())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _no_glob(path: str) -> str:
    """The path of a file that was found, as one to read: decoded, and without patterns."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(path))


def _records(lines: DataFrame) -> DataFrame:
    """(file, pos, piece, text) of whole records; `pos` is that of a record's first line.

    A line is a record unless quotes leave it open, so only files with such a line need more: each quoted line maps the state before it to the
    one after it, maps are composed within pieces for both beginnings, folded over the pieces of a file, and then every line knows
    on which line its record began. Lines of one record meet by that number; nothing else is grouped.
    """
    torn = settle(lines.where("(turn & 1) = 1").select(F.col("file").alias("of")).distinct())
    if torn.isEmpty():
        return lines.select("file", "pos", "piece", "text")
    own = F.col("file") == F.col("of")
    whole = lines.join(torn, own, "left_anti").select("file", "pos", "piece", "text")
    open_ = settle(lines.join(torn, own, "left_semi"))
    quoted = open_.where(f"turn <> {_KEEPS}").select("file", "piece", "pos", "turn").repartition("file", "piece").sortWithinPartitions("file", "piece", "pos")
    maps = quoted.mapInArrow(_piece_maps, "file string, piece long, out0 int, out1 int, open0 long, open1 long")
    ends = settle(maps.repartition("file").sortWithinPartitions("file", "piece").mapInArrow(_fold, "file string, piece long, state int, since long"))
    # a piece begins as the last piece with quotes before it has ended: fill the pieces without any
    pieces = open_.select("file", "piece").distinct().join(ends, ["file", "piece"], "left")
    before = Window.partitionBy("file").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("state").isNotNull(), F.struct("state", "since")), True).over(before)
    begins = pieces.select("file", "piece", last.alias("b")).select("file", "piece", F.coalesce("b.state", F.lit(0)).alias("begins"), F.col("b.since").alias("since"))
    rows = lookup_by_key(open_.select("file", "piece", "pos", "turn"), begins, ["file", "piece"])
    rows = rows.repartition("file", "piece").sortWithinPartitions("file", "piece", "pos")
    begun = settle(rows.mapInArrow(_records_of, "file string, pos long, begun long"))
    # a quote that is never closed is text: its lines are records of their own
    never = ends.groupBy("file").agg(F.max_by(F.struct("state", "since"), "piece").alias("e")).where("e.state = 1").select("file", F.col("e.since").alias("begun"), F.lit(True).alias("_never"))
    begun = lookup_by_key(begun, never, ["file", "begun"], "left").select("file", "pos", F.when(F.col("_never"), F.col("pos")).otherwise(F.col("begun")).alias("begun"))
    met = open_.join(begun, ["file", "pos"])
    parts = F.array_sort(F.collect_list(F.struct("pos", "text", "term")))
    joined = met.groupBy("file", F.col("begun")).agg(parts.alias("parts"))
    text = F.array_join(F.transform("parts", lambda p, i: F.concat(p["text"], F.when(i + 1 < F.size("parts"), p["term"]).otherwise(""))), "")
    joined = joined.select("file", F.col("begun").alias("pos"), F.expr(f"shiftright(begun, {PIECE_BITS})").alias("piece"), text.alias("text"))
    return whole.unionByName(joined)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _quoted_cells(records: pd.Series) -> pd.Series:
    """Cells of records that hold a quote. An empty cell without quotes is null; what follows an unclosed quote is its cell."""
    csv.field_size_limit(sys.maxsize)

    def cells(text):
        out = next(csv.reader(io.StringIO(text, newline=""), quoting=csv.QUOTE_MINIMAL), [])
        return [c or None for c in out]

    return pd.Series([None if r is None else cells(r) for r in records])


def _cells(text: Column) -> Column:
    quoted = F.contains(text, F.lit('"'))
    plain = F.transform(F.split(text, ","), lambda c: F.when(c != "", c))
    return F.when(quoted, _quoted_cells(F.when(quoted, text))).otherwise(plain)


def _names(cells: list, width: int = 0) -> list[str]:
    """Header names without the byte-order mark; repeated ones (in any letter case) are numbered. Cells beyond the last name, up to `width`, get names of their own;
    a column without name and cells is none."""
    cells = list(cells)
    while cells and cells[-1] is None:
        cells.pop()
    cells += [None] * (width - len(cells))
    names, seen = [], {}
    for i, cell in enumerate(cells):
        name = (cell or "").lstrip("\ufeff").lstrip("\u00ef\u00bb\u00bf").strip() or f"_c{i}"
        low = name.lower()
        seen[low] = seen.get(low, 0) + 1
        names.append(name if seen[low] == 1 else f"{name}.{seen[low] - 1}")
    return names


def read_csv(spark: SparkSession, path, encoding: str | None = None, header: str | None = None) -> DataFrame:
    """All columns as text, with the source file and a row id that follows (file name, record number in the file).

    Each file has its own encoding and header: columns meet by name, whatever its letter case and their order, and a column that a file lacks is
    null there. No cell is lost: a record longer than its header fills columns named after their place (`_c3` is the fourth).
    Large files are read by many tasks, also with line breaks in quoted cells; blank lines are no records. Lines and records are
    written to the shared folder once, so ids and headers agree. `header` names a column for the names of the file's own columns.
    """
    lines = None
    for code, files in sorted(_by_encoding(files_of(spark, path)).items()):
        part = _lines(spark, files, encoding or code)
        lines = part if lines is None else lines.unionByName(part)
    if lines is None:
        raise FileNotFoundError(f"no CSV file: {path}")
    records = _records(_numbered(settle(lines))).where("text <> ''")
    records = settle(records.select(F.col("file").alias(FILE), "pos", "piece", _cells(F.col("text")).alias("_cells")))
    filled = F.array_max(F.transform("_cells", lambda c, i: F.when(c.isNotNull(), i + 1).otherwise(0)))
    heads = {r[FILE]: r for r in records.groupBy(FILE).agg(
        F.min("pos").alias("first"), F.min_by("_cells", "pos").alias("cells"), F.max(filled).alias("width"),
        (F.count("*") == F.max("pos") - F.min("pos") + 1).alias("dense")).collect()}
    order = {f: i for i, f in enumerate(sorted(heads))}
    own = {f: _names(r["cells"], r["width"] or 0) for f, r in heads.items()}
    spelled: dict[str, str] = {}
    for f in order:
        for n in own[f]:
            spelled.setdefault(n.lower(), n)
    names = list(spelled.values())
    rows = []
    for f in order:
        place = {n.lower(): i for i, n in enumerate(own[f])}
        rows.append((f, order[f], heads[f]["first"], heads[f]["dense"], [place.get(n, -1) for n in spelled], own[f]))
    places = spark.createDataFrame(pa.Table.from_batches([_table(rows, _PLACES)]) if rows else _PLACES.empty_table())
    # one row per file
    body = records.join(places, F.col(FILE) == F.col("_of"))
    parts = []
    if any(r["dense"] for r in heads.values()) or not heads:
        parts.append(body.where("_dense").withColumn("_number", F.col("pos") - F.col("_first") - 1))
    if not all(r["dense"] for r in heads.values()):
        # blank lines and records of several lines: a record's number is that of earlier pieces of its file, and within its own piece
        counts = records.groupBy(FILE, "piece").agg(F.count("*").alias("_n"))
        before = Window.partitionBy(FILE).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.select(FILE, "piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        inside = Window.partitionBy(FILE, "piece").orderBy("pos")
        ragged = lookup_by_key(body.where("NOT _dense"), counts, [FILE, "piece"])
        parts.append(ragged.withColumn("_number", F.col("_before") + F.row_number().over(inside) - 2).drop("_before"))
    body = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    body = body.where("pos > _first")
    row_id = F.shiftleft("_rank", 40) + F.col("_number")
    cell = [F.when(F.col("_place")[i] >= 0, F.get("_cells", F.col("_place")[i])).alias(n) for i, n in enumerate(names)]
    extra = [F.col("_own").alias(header)] if header else []
    return body.select(row_id.alias(ROW_ID), FILE, *extra, *cell)


_PLACES = pa.schema([("_of", pa.string()), ("_rank", pa.int64()), ("_first", pa.int64()), ("_dense", pa.bool_()), ("_place", pa.list_(pa.int32())), ("_own", pa.list_(pa.string()))])


def _by_encoding(files: list[tuple[str, str]]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for file, code in files:
        out.setdefault(code, []).append(file)
    return out


def read_parquet(spark: SparkSession, path) -> DataFrame:
    return spark.read.parquet(path)


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (ROW_ID, FILE)]


def gate(counts: DataFrame, columns: int, max_rows: int = fv.MAX_ROWS, max_columns: int = fv.MAX_COLUMNS,
         max_mb: int = fv.MAX_FILE_MB) -> DataFrame:
    """Verdict per file from (file, rows, bytes): the first limit that is broken names the reason."""
    mb = F.col("bytes") / (1024 * 1024)
    reason = (F.when(mb > max_mb, F.format_string(f"File size (%.1f MB) exceeds limit of {max_mb} MB", mb))
              .when(F.col("rows") > max_rows,
                    F.format_string(f"File has ~%s rows, exceeding limit of {max_rows:,} rows",
                                    F.format_number("rows", 0)))
              .when(F.lit(columns > max_columns),
                    F.lit(f"File has {columns} columns, exceeding limit of {max_columns} columns")))
    return counts.select("file", "rows", F.lit(columns).alias("columns"), reason.isNull().alias("ok"),
                         reason.alias("reason"))


def file_counts(df: DataFrame) -> DataFrame:
    """Rows and bytes of every file behind a freshly read frame."""
    return df.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count("*").alias("rows"), F.max("_metadata.file_size").alias("bytes"))
