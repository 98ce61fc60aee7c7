"""Archives: exact round trip, the format itself, revisits, damage."""

import base64
import hashlib
import io
import struct
from pathlib import Path

import oracle
import pytest
import zstandard
from annolytics.llm import warc
from annolytics.llm.queries import ORACLE_SQL, QUERIES
from conftest import SMALL


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)


def by_hand(rows, least=0):
    out, seen = [], {}
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (html or "").encode()
        old = len(data) >= least and data in seen
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if old else "response", seen[data] if old else None))
        seen.setdefault(data, page)
    return sorted(out, key=str)


def result(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


ROWS = [
    (7, "http://a/ b\r\nX: y", "<p>ä</p>"), (3, None, "<p>ä</p>"), (5, "http://c/", None), (9, "http://d/", ""), (9, "http://d/", ""),
    (None, "http://e/", "<p>ä</p>"), (2, "http://f/", "x" * 300_000), (None, None, "alone"), (None, None, "alone"), (1, "u", "\r\n\r\nWARC/1.1\r\n"),
]


@pytest.mark.parametrize("least", [0, 1, 100])
def test_round_trip(spark, least):
    df = frame(spark, ROWS).selectExpr("*", "1 as digest", "2 as original", "3 as payload")
    assert result(warc.round_trip(df, least_bytes=least)) == by_hand(ROWS, least)


def test_empty_table(spark):
    assert warc.round_trip(frame(spark, [])).collect() == []


def test_format_and_payloads(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<html><body>common words of page {i} {'and more ' * (i % 40)}</body></html>") for i in range(400)]
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_archives(frame(spark, rows), folder, archive_bytes=60_000)
    files = {p.name: p for p in Path(tmp_path, "w").iterdir()}
    listed = manifest.collect()
    assert {r.archive for r in listed} == set(files) and sum(r.records for r in listed) == 400 and len(files) > 2
    trained = 0
    for name, path in files.items():
        data = path.read_bytes()
        magic, size = struct.unpack("<II", data[:8])
        assert magic == 0x184D2A5D  # the dictionary format's own skippable frame
        dictionary = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
        trained += len(dictionary) > 0
        decoder = zstandard.ZstdDecompressor(zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        # a reader that knows nothing of dictionaries skips the first frame
        whole = decoder.stream_reader(io.BytesIO(data), read_across_frames=True).read()
        assert whole.count(b"WARC/1.1\r\n") == next(r.records for r in listed if r.archive == name)
    assert trained
    back = {r.page_id: bytes(r.payload).decode() for r in warc.read_archives(manifest, folder).collect()}
    assert back == {i: html for i, _, html in rows}


def test_damage_is_found():
    good = warc.record({"page_id": 1, "url": "u", "payload": "text", "first": True, "original": None}, 0)
    assert warc.parsed(good)["payload"] == b"text"
    with pytest.raises(ValueError, match="damaged"):
        warc.parsed(good.replace(b"text", b"test"))
    with pytest.raises(ValueError, match="not a WARC"):
        warc.parsed(b"x" + good)
    with pytest.raises(ValueError, match="no dictionary"):
        list(warc.read_frames(io.BytesIO(bytes(16))))


def test_uris():
    assert [warc.as_uri(x) for x in ("/a/b", "file:/a", "file:///a", "hdfs://n/a")] == ["file:///a/b", "file:///a", "file:///a", "hdfs://n/a"]


def test_query_against_sql(spark):
    name = "op3_warc_dictionary"
    assert oracle.compare(QUERIES[name](spark, SMALL), oracle.connect(SMALL), ORACLE_SQL[name]) == []


def test_archives_are_read_by_several_tasks(spark, tmp_path):
    rows = [(i, f"http://h/{i}", "words " * 200 + str(i)) for i in range(300)]
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_archives(frame(spark, rows), folder, archive_bytes=40_000)
    archives = manifest.count()
    read = warc.read_archives(manifest, folder)
    assert archives > 5 and read.count() == 300
    assert read.rdd.getNumPartitions() == archives
    tasks = read.rdd.glom().map(lambda part: len({r.archive for r in part})).collect()
    assert max(tasks) <= 2 and sum(t > 0 for t in tasks) > archives // 2
