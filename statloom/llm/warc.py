"""WARC archives as Spark tables: writing, reading, and resolution of records with equal payloads."""

import uuid
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm.common import batches_of, maybe_in, rows_of, settle
from statloom.session import checkpoint_folder

#: The line that opens a record; no proper beginning of it is also its end, so a reader that looks for it can't slip.
MARK = "WARC/1.1\r\n"
#: What ends a head, and a record.
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Digits that Spark's conv gives for base 32, and those of RFC 4648.
_CONV, _RFC = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: Columns of a record read back.
COLUMNS = ["record_type", "record_id", "page_id", "url", "date", "refers_to", "stated_digest", "payload"]


def sha1_base32(payload: Column) -> Column:
    """SHA-1 in base 32, upper case, without a label: 160 bits are four times 40."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*parts)), _CONV, _RFC)


def _line(name: str, value: Column) -> Column:
    """One field of a head, or nothing if the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def _one_line(value: Column) -> Column:
    """Line ends would end the field."""
    return F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def record_text(kind: Column, record_id: Column, page_id: Column, url: Column, date: Column, digest: Column, payload: Column,
                refers: dict[str, Column]) -> Column:
    """A whole record without its end. `payload` is UTF-8 text, ignored for a revisit, whose block is the head of the response alone."""
    body = F.when(kind == "revisit", "").otherwise(payload)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit(END))
    block = F.concat(http, body)
    head = [F.lit(MARK), _line("WARC-Type", kind), _line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), record_id, F.lit(">"))), _line("WARC-Date", date),
            _line("WARC-Target-URI", _one_line(url)), _line("WARC-Page-ID", page_id), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
            *[_line(name, F.when(kind == "revisit", value)) for name, value in refers.items()],
            F.lit("Content-Type: application/http; msgtype=response\r\n"), _line("Content-Length", F.octet_length(block)), F.lit("\r\n"), block]
    return F.concat(*head)


def write_records(records: DataFrame, folder: str, compression: str = "gzip") -> str:
    """Write the one text column as archives, a file per task: records one after the other, each with its end."""
    records.write.option("lineSep", END).option("compression", compression).option("zlib.compress.level", "BEST_SPEED").text(folder)
    return folder


def write_warc(pages: DataFrame, folder: str, date: str, page_id: str = "page_id", url: str = "url", html: str = "html", compression: str = "gzip") -> str:
    """One response record per row of `pages`; a null text is empty, a null url or id has no field. Ids of records are random and new."""
    payload = F.coalesce(F.col(html), F.lit(""))
    text = record_text(F.lit("response"), F.expr("uuid()"), F.col(page_id), F.col(url), F.lit(date), sha1_base32(payload), payload, {})
    return write_records(pages.select(text.alias("value")), folder, compression)


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    """(file, block, at, value, size, need): what stands between marks. In a file, pieces follow each other by (block, at). `need` is the length of the
    record that begins here, by its own head; null if this is no head."""
    text = spark.read.option("lineSep", MARK).text(folder)
    text = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                       F.monotonically_increasing_id().alias("at"), "value")
    head = F.substring_index("value", END, 1)
    length = F.regexp_extract(head, r"(?im)^Content-Length:[ \t]*(\d+)", 1).try_cast("long")
    size = F.octet_length("value")
    ended = F.octet_length(head) < size
    return text.select("*", size.cast("long").alias("size"), F.when(ended, F.octet_length(head) + 2 * len(END) + length).alias("need"))


_STARTS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("start", pa.int64())])


def _starts(batches):
    """Pieces in order: each is told the number of the piece with which its record begins."""

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        now, start, left = None, -1, 0
        for file, block, at, size, need in rows:
            if file != now:  # what stands before the first mark is no record
                now, start, left = file, -1, size + len(MARK)
                yield file.decode(), block, at, -1
                left = 0
                continue
            if left <= 0:
                # without a length a record reaches to the next mark
                start, left = start + 1, need if need is not None else size
            left -= size
            if left > 0:
                left -= len(MARK)
            yield file.decode(), block, at, start

    return batches_of(run(rows_of(batches, "file", "block", "at", "size", "need")), _STARTS)


def _whole(spark: SparkSession, folder: str) -> DataFrame:
    """(value): each record after its mark, whole.

    Where every piece of a file is as long as its head says, each is a record. In a file with a shorter piece a payload holds the mark: such
    files' pieces are written, their lengths (nothing else) pass one task per file in order, and pieces of one record are put together again.
    """
    pieces = _pieces(spark, folder)
    short = (F.col("need").isNull() & (F.col("size") > 0)) | (F.col("need") > F.col("size"))
    empty = F.count_if(F.col("size") == 0) > 1
    torn = settle(pieces.groupBy("file").agg(F.max(F.coalesce(short, F.lit(False))).alias("short"), empty.alias("empty")).where("short OR empty").select(F.col("file").alias("of")))
    sound = pieces.where("size > 0")
    if torn.isEmpty():
        return sound.select("value")
    parts = settle(pieces.join(torn, F.col("file") == F.col("of"), "left_semi"))
    dealt = parts.select("file", "block", "at", "size", "need").repartition("file").sortWithinPartitions("file", "block", "at")
    starts = settle(dealt.mapInArrow(_starts, "file string, block long, at long, start long"))
    joined = parts.join(starts, ["file", "block", "at"]).where("start >= 0")
    again = joined.groupBy("file", "start").agg(F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("parts"))
    again = again.select(F.array_join(F.transform("parts", lambda p: p["value"]), MARK).alias("value"))
    return sound.join(torn, F.col("file") == F.col("of"), "left_anti").select("value").union(again)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The response and revisit records of a folder of archives (plain or compressed as a whole): COLUMNS, `payload` as bytes.

    A record ends where its Content-Length says, also if its payload holds the line that opens a record; one without a length reaches to the next
    mark. An archive that ends early gives what is there. Fields are found in any letter case; missing ones are null. Uncompressed archives are read by many tasks each.
    """
    head = F.substring_index("value", END, 1)
    block = F.substring(F.col("value").cast("binary"), F.octet_length(head) + len(END) + 1, F.coalesce(F.col("length"), F.octet_length("value")))
    http = F.substring_index(F.col("block").cast("string"), END, 1)
    inner = F.octet_length(http) < F.octet_length("block")
    is_http = F.lower(_field("Content-Type")).startswith("application/http")
    payload = F.when(is_http & inner, F.substring(F.col("block"), F.octet_length(http) + len(END) + 1, F.octet_length("block"))).otherwise(F.col("block"))
    rows = _whole(spark, folder).select("value", head.alias("head"), F.regexp_extract(head, r"(?im)^Content-Length:[ \t]*(\d+)", 1).try_cast("int").alias("length"))
    rows = rows.select("head", block.alias("block"))
    bare = F.regexp_replace(F.lower(_field("WARC-Payload-Digest")), "^sha1:", "")
    return rows.select(_field("WARC-Type").alias("record_type"), _id("WARC-Record-ID").alias("record_id"), _field("WARC-Page-ID").try_cast("long").alias("page_id"),
                       _field("WARC-Target-URI").alias("url"), _field("WARC-Date").alias("date"), _id("WARC-Refers-To").alias("refers_to"),
                       F.upper(bare).alias("stated_digest"), payload.alias("payload")).where(F.col("record_type").isin("response", "revisit"))


def _field(name: str) -> Column:
    found = F.regexp_extract("head", rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(F.col("head").rlike(rf"(?im)^{name}:"), found)


def _id(name: str) -> Column:
    return F.regexp_replace(_field(name), "^<urn:uuid:|>$", "")


def _fresh(record_id: Column) -> Column:
    """The id of a record in the new archive: every record finds the new id of another without a join."""
    h = F.md5(F.concat(F.lit("fresh "), record_id))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def deduplicate_warc(spark: SparkSession, source: str, target: str, date: str, min_bytes: int = 0, compression: str = "gzip") -> str:
    """Write the archives of `source` anew to `target`: of response records with equal payloads of at least `min_bytes` bytes the one with the
    largest page id (then record id; null page ids come last) stays, the others become revisits of it, all under fresh heads. A record that is
    a revisit already points to what its original has become.

    Only heads are shuffled by payload digest (length and SHA-256 beside SHA-1, so that a collision merges nothing). Payloads are shuffled
    only for records that may be revisits.
    """
    records = read_warc(spark, source)
    digest = sha1_base32(F.col("payload"))
    heads = records.select("record_type", "record_id", "page_id", "url", "date", "refers_to", F.octet_length("payload").cast("long").alias("bytes"), digest.alias("digest"),
                           F.sha2("payload", 256).alias("sha"))
    heads = settle(heads)
    response = heads.where("record_type = 'response'")
    one = F.struct("page_id", "record_id", "url", "date")
    groups = response.where(F.col("bytes") >= min_bytes).groupBy("digest", "bytes", "sha").agg(F.max(one).alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = settle(groups.select(F.col("digest").alias("d"), F.col("bytes").alias("b"), F.col("sha").alias("s"), "first"))
    same = (F.col("digest") == F.col("d")) & (F.col("bytes") == F.col("b")) & (F.col("sha") == F.col("s"))
    first = [F.col("first.record_id").alias("to_id"), F.col("first.url").alias("to_url"), F.col("first.date").alias("to_date")]
    gone = settle(response.join(groups, same).where("record_id <> first.record_id").select(F.col("record_id").alias("of"), *first))
    # earlier revisits follow their original to the record that has its payload now
    held = heads.where("record_type = 'revisit'").select(F.col("record_id").alias("of"), "refers_to")
    kept = response.select(F.col("record_id").alias("o"), F.col("url").alias("u"), F.col("date").alias("t"))
    moved = gone.select(F.col("of").alias("was"), "to_id", "to_url", "to_date")
    older = held.join(settle(kept.join(held.select("refers_to").distinct(), F.col("o") == F.col("refers_to"), "left_semi")), F.col("refers_to") == F.col("o"), "left")
    older = older.join(moved, F.col("refers_to") == F.col("was"), "left")
    older = older.select("of", F.coalesce("to_id", "refers_to").alias("to_id"), F.coalesce("to_url", "u").alias("to_url"), F.coalesce("to_date", "t").alias("to_date"))
    fate = settle(gone.union(older))
    rows = records.withColumn("key", F.xxhash64("record_id"))
    keys = fate.select(F.xxhash64("of").alias("key"))
    told = maybe_in(rows, "key", keys).join(fate, F.col("record_id") == F.col("of"), "left")
    alone = maybe_in(rows, "key", keys, keep=False)
    for c in ("of", "to_id", "to_url", "to_date"):
        alone = alone.withColumn(c, F.lit(None).cast("string"))
    rows = alone.unionByName(told)
    kind = F.when(F.col("of").isNotNull(), "revisit").otherwise(F.col("record_type"))
    stated = F.when(F.col("record_type") == "response", digest).otherwise(F.col("stated_digest"))
    refers = {"WARC-Profile": F.lit(PROFILE), "WARC-Refers-To": F.concat(F.lit("<urn:uuid:"), _fresh(F.col("to_id")), F.lit(">")),
              "WARC-Refers-To-Target-URI": _one_line(F.col("to_url")), "WARC-Refers-To-Date": F.col("to_date")}
    text = record_text(kind, _fresh(F.col("record_id")), F.col("page_id"), F.col("url"), F.coalesce("date", F.lit(date)), stated, F.col("payload").cast("string"), refers)
    return write_records(rows.select(text.alias("value")), target, compression)


def resolved(records: DataFrame) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest (both of the full payload), record_type, refers_to (the page id of the
    response that a revisit names) and url. A revisit whose response is not there keeps its stated digest and has null bytes."""
    heads = records.select("record_type", "record_id", "page_id", "url", "refers_to", F.octet_length("payload").cast("long").alias("bytes"),
                           F.when(F.col("record_type") == "response", sha1_base32(F.col("payload"))).otherwise(F.col("stated_digest")).alias("digest"))
    heads = settle(heads)
    response = heads.where("record_type = 'response'")
    revisit = heads.where("record_type = 'revisit'")
    named = response.select(F.col("record_id").alias("o"), F.col("page_id").alias("to_page"), F.col("bytes").alias("b"), F.col("digest").alias("d"))
    named = settle(named.join(revisit.select(F.col("refers_to").alias("r")).distinct(), F.col("o") == F.col("r"), "left_semi"))
    found = revisit.join(named, F.col("refers_to") == F.col("o"), "left")
    same = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    own = response.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"), "url")
    back = found.select("page_id", F.col("b").alias("payload_bytes"), F.coalesce("d", "digest").alias("payload_digest"), "record_type", F.col("to_page").alias("refers_to"), "url")
    return own.unionByName(back).select(*same)


def warc_revisits(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, date: str | None = None, page_id: str = "page_id", url: str = "url",
                  html: str = "html", compression: str = "gzip") -> DataFrame:
    """Write `pages` as archives, write them again without repeated payloads, read those back and resolve the revisits: see `resolved`.

    The archives stay below `folder` (by default one below the shared checkpoint folder) as `full` and `deduplicated`. A null text is an
    empty payload and equals other empty ones. Rows that repeat a page id are records of their own; of equal payloads with the same largest id
    exactly one is the response. Rows without an id come last, so one is a response only if no equal payload has an id. Other columns are not
    looked at; an empty table gives empty archives and an empty result.
    """
    spark = pages.sparkSession
    folder = folder or f"{checkpoint_folder(spark)}/warc-{uuid.uuid4().hex}"
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    full = write_warc(pages, f"{folder}/full", date, page_id, url, html, compression)
    small = deduplicate_warc(spark, full, f"{folder}/deduplicated", date, min_bytes, compression)
    return resolved(read_warc(spark, small))
