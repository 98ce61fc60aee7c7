"""WARC archives with a Zstandard dictionary in a leading skippable frame, written and read by Spark tasks.

Every archive starts with a skippable frame (magic 0x184D2A5D) that holds its dictionary, itself one Zstandard frame;
each record follows as a frame of its own, so records can be read one by one. The dictionary is built from the first
``SAMPLE_BYTES`` of the archive's own records (a documented bound on training, not on what is archived); an archive
too small for training gets the empty dictionary, and its records plain frames.

Of pages with equal payloads of at least ``least_bytes`` bytes the one with the smallest id is the response, the
others are revisits that name it. Which one that is follows from ids and digests alone; then each page's HTML moves
once, to the task that archives it. A task cuts archives at ``archive_bytes`` of records, and names them freshly,
so that a task that runs again never writes over what another reads: the manifest names what counts.

Defined cases: null HTML is an empty payload; of rows with equal id and payload one is the response and the others
revisit it; an id that is null stands after all others; white space in an address is percent-encoded, and a null
address is ``about:blank``; an empty table gives no archive; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolytics.llm.common import slices, text_or_empty
from annolytics.session import materialize, new_path

MAGIC, FRAME_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
SAMPLE_BYTES, DICTIONARY_BYTES, ARCHIVE_BYTES = 4 << 20, 64 << 10, 64 << 20
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "archive string, records long, bytes long"
RECORDS = (
    "archive string, place long, page_id {id}, payload_bytes long, payload_digest string, record_type string, "
    "refers_to {id}, url string, payload binary"
)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: object, digest: str, place: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page}:{digest}:{place}'.encode()).digest())}>"


def record(row: dict, place: int) -> bytes:
    """One WARC record: an HTTP response with its payload, or a revisit with the head alone."""
    payload = row["payload"].encode()
    digest = digest_of(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    first = row["first"]
    block = head + payload if first else head
    url = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in row["url"] or "about:blank")
    fields = [
        ("WARC-Type", "response" if first else "revisit"), ("WARC-Record-ID", record_id(row["page_id"], digest, place)),
        ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{digest_of(block)}"), ("X-Page-Id", "" if row["page_id"] is None else row["page_id"]),
    ]
    if not first:
        target = row["original"]
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(target, digest, 0)), ("X-Refers-To-Page-Id", "" if target is None else target),
        ]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary, or none where the samples are too few or too small to train on."""
    total = sum(map(len, samples))
    if len(samples) < 16 or total < 4 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(size, total // 8), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _write_archive(folder: str, records: Iterator[bytes], archive_bytes: int) -> tuple[str, int, int]:
    """Write records up to ``archive_bytes`` as one archive; the iterator goes on where this stops."""
    samples, held = [], 0
    for data in records:
        samples.append(data)
        held += len(data)
        if held >= min(SAMPLE_BYTES, archive_bytes):
            break
    trained = build_dictionary(samples)
    coder = zstandard.ZstdCompressor(
        LEVEL, zstandard.ZstdCompressionDict(trained) if trained else None, write_content_size=True, write_checksum=True
    )
    frame = zstandard.ZstdCompressor(LEVEL).compress(trained)
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    name = f"{uuid.uuid4().hex}.warc.zst"
    count = 0
    with store.open_output_stream(f"{base}/{name}", compression=None) as out:
        out.write(struct.pack("<II", MAGIC, len(frame)) + frame)
        for data in samples:
            out.write(coder.compress(data))
        count = len(samples)
        samples.clear()
        while held < archive_bytes and (data := next(records, None)) is not None:
            out.write(coder.compress(data))
            held += len(data)
            count += 1
        written = out.tell()
    return name, count, written


def with_originals(df: DataFrame, id_column: str, payload_column: str, least_bytes: int) -> DataFrame:
    """``page_id, url, payload, digest, original, marker``: the pages, and before those of repeated payloads a marker row
    that names the response. Pages and markers of one id and digest share a task and stand together."""
    pages = df.select(F.col(id_column).alias("page_id"), F.col("url"), text_or_empty(payload_column).alias("payload"))
    pages = pages.withColumn("digest", F.sha1("payload"))
    ids = pages.where(F.octet_length("payload") >= least_bytes).select("page_id", "digest")
    first = ids.groupBy("digest").agg(F.min("page_id").alias("original"), F.count(F.lit(1)).alias("n"))
    first = materialize(first.where("n > 1").drop("n"), "originals")
    markers = ids.distinct().join(first, "digest").withColumn("marker", F.lit(True))
    rows = pages.withColumn("marker", F.lit(False)).unionByName(markers, allowMissingColumns=True)
    return rows.repartition("page_id", "digest").sortWithinPartitions("page_id", "digest", F.desc("marker"))


def write_archives(
    df: DataFrame, folder: str, id_column: str = "page_id", payload_column: str = "html", *, least_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Archive every page under ``folder`` (a URI all executors reach) and return the stored manifest."""
    laid = with_originals(df, id_column, payload_column, least_bytes)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        last, place, repeated, original = None, 0, False, None
        for batch in slices(batches):
            for row in batch.to_pylist():
                key = (row["page_id"], row["digest"])
                if row["marker"]:
                    last, place, repeated, original = key, -1, True, row["original"]
                    continue
                place, repeated = (place + 1, repeated) if key == last else (0, False)
                last = key
                row["original"] = original
                row["first"] = not repeated or (row["page_id"] == original and not place)
                yield record(row, place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = records(batches)
        while (ahead := next(data, None)) is not None:
            yield _manifest_row(_write_archive(folder, itertools.chain([ahead], data), archive_bytes))

    return materialize(laid.mapInArrow(run, MANIFEST), "manifest")


def _manifest_row(written: tuple[str, int, int]) -> pa.RecordBatch:
    name, count, size = written
    return pa.RecordBatch.from_pydict({"archive": [name], "records": [count], "bytes": [size]})


def read_frames(stream) -> Iterator[bytes]:
    """The uncompressed records of one archive, frame by frame, with bounded memory."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != MAGIC:
        raise ValueError(f"no dictionary frame at the start: {magic:#x}")
    data = stream.read(size)
    trained = zstandard.ZstdDecompressor().decompress(data) if data.startswith(FRAME_MAGIC) else data
    decoder = zstandard.ZstdDecompressor(zstandard.ZstdCompressionDict(trained) if trained else None)
    left = b""
    one, parts = decoder.decompressobj(), []
    while chunk := left or stream.read(1 << 20):
        parts.append(one.decompress(chunk))
        left = b""
        if one.eof:
            yield b"".join(parts)
            left, one, parts = one.unused_data, decoder.decompressobj(), []
    if any(parts):
        raise ValueError("the archive ends inside a record")


def parsed(data: bytes) -> dict:
    """Fields of a record that the writer above or another one made; checks the digests of what is stored."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]}")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kept = fields["warc-type"] == "response"
    if fields["warc-block-digest"] != f"sha1:{digest_of(block)}" or kept and (len(payload), digest_of(payload)) != (length, digest):
        raise ValueError(f"damaged record {fields['warc-record-id']}")
    return {
        "page_id": fields.get("x-page-id") or None, "payload_bytes": length, "payload_digest": digest,
        "record_type": fields["warc-type"], "refers_to": fields.get("x-refers-to-page-id") or None,
        "url": fields["warc-target-uri"], "payload": payload if kept else None,
    }


def read_archives(manifest: DataFrame, folder: str, *, id_type: str = "bigint", payloads: bool = True) -> DataFrame:
    """The records of the archives a manifest names; each archive is read by a task of its own."""
    target = manifest.sparkSession.createDataFrame([], RECORDS.format(id=id_type)).schema
    text = manifest.sparkSession.createDataFrame([], RECORDS.format(id="string")).schema
    names = text.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for place, data in enumerate(read_frames(stream)):
                        row = parsed(data)
                        if not payloads:
                            row["payload"] = None
                        rows.append(row | {"archive": name, "place": place})
                        held += len(data)
                        if held > 1 << 22 or len(rows) == 1024:
                            yield _batch(rows, names)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, names)

    # a given number of partitions is kept: names are too small for adaptive execution to leave them apart
    spread = manifest.select("archive").repartition(max(1, manifest.count()))
    found = spread.mapInArrow(run, text)
    return found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in target])


def _batch(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    kinds = {"place": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays(
        [pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names=names
    )


def as_uri(folder: str) -> str:
    """A folder as Spark names it, as the URI that pyarrow's file systems take."""
    scheme, colon, path = folder.partition(":")
    if not colon or "/" in scheme:
        return f"file://{folder}"
    return folder if path.startswith("//") else f"{scheme}://{path}"


def round_trip(df: DataFrame, id_column: str = "page_id", payload_column: str = "html", *, least_bytes: int = 0) -> DataFrame:
    """Archive every page, read the archives back and describe each page's record."""
    folder = as_uri(new_path(df.sparkSession, "warc"))
    manifest = write_archives(df, folder, id_column, payload_column, least_bytes=least_bytes)
    rows = read_archives(manifest, folder, id_type=dict(df.dtypes)[id_column], payloads=False)
    return rows.select(
        F.col("page_id").alias(id_column), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
