import base64
import hashlib
import re

import pyarrow as pa
import pytest
from odd import by_text
from pyspark.sql import functions as F

from statloom.llm import warc
from statloom.llm.warc import deduplicate_warc, read_warc, resolved, warc_revisits, write_records, write_warc

DATE = "2024-05-06T07:08:09Z"
INNER = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Page-ID: 777\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
ODD = [(1, "http://a/", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://b/\r\nX: y", "<p>two</p>"), (4, "", ""), (5, "u", None), (None, "n", "<p>two</p>"), (None, "m", "only nameless"),
       (6, "u", "\r\n\r\n"), (7, "u", "WARC/1.1\r\n"), (8, "u", f"before {INNER}{INNER} after"), (9, "u", f"{INNER}"), (10, "u", "WARC/1.1\r\nWARC/1.1\r\n\r\n\r\nWARC/1.1\r\nContent-Length: 99999\r\n\r\n"),
       (11, "u", "x" * 300_000 + "\r\n" + "é日本\U0001f600" * 1000), (12, "u", "same id"), (12, "v", "same id"), (12, "v", "same id"), (-5, "u", "<p>one</p>"), (13, "u", f"before {INNER}{INNER} after"),
       (14, "u", "HTTP/1.1 200 OK\r\n\r\nbody"), (15, "u", "Content-Length: 5\r\n\r\nabc\r\n\r\nWARC/1.1\r\n")]


def pages(spark, rows):
    ids, urls, texts = zip(*rows, strict=True) if rows else ((), (), ())
    table = {"page_id": pa.array(ids, pa.int64()), "url": pa.array(urls, pa.string()), "html": pa.array(texts, pa.string())}
    table |= {c: pa.array(["clash"] * len(ids), pa.string()) for c in ("value", "head", "key", "of", "payload", "digest", "record_id", "file", "at", "block", "size", "need")}
    return spark.createDataFrame(pa.table(table))


def sha1(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def by_hand(rows, least=0):
    out, groups = [], {}
    for i, (page, _, text) in enumerate(rows):
        payload = (text or "").encode()
        groups.setdefault(payload if len(payload) >= least else (payload, i), []).append((page is not None, page or 0, i))
    for key, members in groups.items():
        payload = key if isinstance(key, bytes) else key[0]
        first = max(members)
        for m in members:
            page = m[1] if m[0] else None
            revisit = m != first
            out.append((page, len(payload), sha1(payload), "revisit" if revisit else "response", (first[1] if first[0] else None) if revisit else None))
    return by_text(out)


@pytest.mark.parametrize("compression", ["none", "gzip"])
@pytest.mark.parametrize("least", [0, 12])
def test_round_trip(spark, tmp_path, compression, least):
    got = warc_revisits(pages(spark, ODD), str(tmp_path), least, DATE, compression=compression)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    assert by_text(tuple(r)[:5] for r in got.collect()) == by_hand(ODD, least)


def test_small_splits(spark, tmp_path):
    """Records, heads and marks lie across the borders of splits."""
    texts = [t for _, _, t in ODD if t is None or len(t) < 1000]
    rows = [(i, f"http://h/{i}", texts[i % len(texts)]) for i in range(40)]
    folder = write_warc(pages(spark, rows).coalesce(1), f"{tmp_path}/full", DATE, compression="none")
    for size in (97, 1013, 65536):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = read_warc(spark, folder).select("page_id", "payload").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert by_text((r[0], bytes(r[1])) for r in got) == by_text((i, (t or "").encode()) for i, _, t in rows)


def test_archives_are_warc(spark, tmp_path):
    """An own sequential reader finds the same records, well formed."""
    rows = ODD[:5] + ODD[11:17]
    warc_revisits(pages(spark, rows), str(tmp_path), 0, DATE, compression="none")
    seen, ids = {}, {}
    for folder in ("full", "deduplicated"):
        for path in sorted((tmp_path / folder).glob("part-*")):
            data, at = path.read_bytes(), 0
            while at < len(data):
                end = data.index(b"\r\n\r\n", at)
                first, *lines = data[at:end].decode().split("\r\n")
                fields = dict(x.split(": ", 1) for x in lines)
                assert first == "WARC/1.1" and fields["WARC-Date"] == DATE and re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", fields["WARC-Record-ID"])
                size = int(fields["Content-Length"])
                block = data[end + 4:end + 4 + size]
                assert data[end + 4 + size:end + 8 + size] == b"\r\n\r\n"
                at = end + 8 + size
                http, _, body = block.partition(b"\r\n\r\n")
                assert http.startswith(b"HTTP/1.1 200 OK")
                if fields["WARC-Type"] == "response":
                    assert fields["WARC-Payload-Digest"] == f"sha1:{sha1(body)}"
                else:
                    assert body == b"" and fields["WARC-Profile"] == warc.PROFILE
                seen.setdefault(folder, []).append(fields)
                ids[fields["WARC-Record-ID"]] = fields
    assert len(seen["full"]) == len(seen["deduplicated"]) == len(rows)
    assert len(ids) == 2 * len(rows)
    revisits = [f for f in seen["deduplicated"] if f["WARC-Type"] == "revisit"]
    assert revisits
    for f in revisits:
        to = ids[f["WARC-Refers-To"]]
        assert to["WARC-Type"] == "response" and to["WARC-Payload-Digest"] == f["WARC-Payload-Digest"] and f["WARC-Refers-To-Date"] == to["WARC-Date"]
        assert f.get("WARC-Refers-To-Target-URI") == to.get("WARC-Target-URI")


def test_earlier_revisits_follow_their_original(spark, tmp_path):
    """An archive that was deduplicated, beside one with larger ids for the same payloads."""
    old = [(i, "u", f"text {i % 4}") for i in range(12)]
    new = [(100 + i, "u", f"text {i}") for i in range(3)]
    first = deduplicate_warc(spark, write_warc(pages(spark, old), f"{tmp_path}/a", DATE), f"{tmp_path}/b", DATE)
    both = [read_warc(spark, first), read_warc(spark, write_warc(pages(spark, new), f"{tmp_path}/c", DATE))]
    assert [d.count() for d in both] == [12, 3]
    write_records(spark.read.option("lineSep", warc.END + warc.MARK).text([first, f"{tmp_path}/c"]).select(
        F.when(F.col("value").startswith(warc.MARK), "").otherwise(warc.MARK).alias("m"), F.regexp_replace("value", "\r\n\r\n$", "").alias("value")).select(
        F.concat("m", "value").alias("value")), f"{tmp_path}/d", "none")
    got = resolved(read_warc(spark, deduplicate_warc(spark, f"{tmp_path}/d", f"{tmp_path}/e", DATE)))
    assert by_text(tuple(r)[:5] for r in got.collect()) == by_hand(old + new)


def test_revisit_of_a_record_that_is_not_there(spark, tmp_path):
    lost = ("WARC/1.1\r\nwarc-type: revisit\r\nWARC-Record-ID: <urn:uuid:5>\r\nWARC-Page-ID: 5\r\nWARC-Refers-To: <urn:uuid:none>\r\nWARC-Payload-Digest: sha1:ABC\r\nContent-Length: 0\r\n\r\n")
    info = "WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\ninfo"
    write_records(spark.createDataFrame(pa.table({"value": [info, lost]})).coalesce(1), f"{tmp_path}/a")
    again = deduplicate_warc(spark, f"{tmp_path}/a", f"{tmp_path}/b", DATE)
    for folder in (f"{tmp_path}/a", again):
        assert [tuple(r) for r in resolved(read_warc(spark, folder)).collect()] == [(5, None, "ABC", "revisit", None, None)]


def test_nothing(spark, tmp_path):
    assert warc_revisits(pages(spark, []), str(tmp_path)).collect() == []


def test_hot_payload(spark, tmp_path):
    rows = [(i, "u", "same" if i % 3 else f"own {i}") for i in range(200)]
    got = warc_revisits(pages(spark, rows), str(tmp_path), 0, DATE)
    assert by_text(tuple(r)[:5] for r in got.collect()) == by_hand(rows)
