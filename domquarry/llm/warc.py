"""WARC archives compressed record by record with zstandard, written and read back.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the
zstandard dictionary of all its records, itself compressed; then comes one
frame per record.  The dictionary is trained on a bounded sample of the
archive's own first records; with too few of them there is none, and no such
frame.  A page's record is a response with the whole payload, or, where an equal
payload of at least ``min_bytes`` stands under a smaller page_id, a revisit of
that response: its block is the HTTP header alone.

The reader takes the dictionary from the leading frame, decodes a frame at a
time, and checks version line, mandatory headers, Content-Length, record end,
block digest and, of responses, the payload's length and digest.

Results for odd input: null html is an empty payload; a null url becomes the
record's own URN; of repeated rows the first by row is the response and the
others revisit it; a row without page_id comes after those that have one; an
empty table writes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domquarry.llm.common import save
from domquarry.llm.files import new_uri, published, spread

MIN_BYTES = 0
#: Size of a dictionary, and the records and bytes that it is trained on at most.
DICT_BYTES, SAMPLE_RECORDS, SAMPLE_BYTES = 1 << 15, 400, 1 << 22
LEVEL = 3

#: Fixed values of the formats.
DICT_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
#: All records bear one date, so equal input gives equal archives.
DATE = "2000-01-01T00:00:00Z"


def digest(data: bytes) -> str:
    """Bare base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def urn(row: int) -> str:
    return f"<urn:page-row:{row}>"


def header_value(text: str) -> str:
    """A header value on one line."""
    return "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in text)


def record(row: int, page_id: int | None, url: str | None, payload: bytes, refers_to: tuple | None) -> bytes:
    """One record; ``refers_to`` is (row, page_id) of the response that it revisits."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n"
            "\r\n").encode()
    block = http if refers_to else http + payload
    head = {"WARC-Type": "revisit" if refers_to else "response", "WARC-Record-ID": urn(row), "WARC-Date": DATE,
            "WARC-Target-URI": header_value(url) if url else urn(row)[1:-1],
            "Content-Type": "application/http;msgtype=response", "WARC-Payload-Digest": f"sha1:{digest(payload)}",
            "WARC-Block-Digest": f"sha1:{digest(block)}"}
    if page_id is not None:
        head["Page-Id"] = str(page_id)
    if refers_to:
        head |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": urn(refers_to[0])}
        if refers_to[1] is not None:
            head["Refers-To-Page-Id"] = str(refers_to[1])
    head["Content-Length"] = str(len(block))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"{VERSION}\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of a
    record; raises where it is not a valid one."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    if not sep or version != VERSION or any(name not in fields for name in MANDATORY):
        raise ValueError("not a WARC record with its mandatory headers")
    n = int(fields["Content-Length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is not its Content-Length")
    if fields["WARC-Block-Digest"] != f"sha1:{digest(block)}":
        raise ValueError("a block does not have its digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != stated or fields["WARC-Payload-Digest"] != f"sha1:{digest(payload)}"):
        raise ValueError("a payload does not have its length or digest")
    page_id, refers_to = fields.get("Page-Id"), fields.get("Refers-To-Page-Id")
    return {"page_id": None if page_id is None else int(page_id), "payload_bytes": stated,
            "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "record_type": kind,
            "refers_to": None if refers_to is None else int(refers_to)}


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples)
    except zstandard.ZstdError:  # too few samples
        return None


def write_archive(out, records) -> int:
    """Write ``records`` (bytes) to ``out``; the number of them."""
    records, first, size = iter(records), [], 0
    for r in records:
        first.append(r)
        size += len(r)
        if len(first) >= SAMPLE_RECORDS or size >= SAMPLE_BYTES:
            break
    shared = train(first)
    if shared:
        packed = zstandard.ZstdCompressor().compress(shared.as_bytes())
        out.write(struct.pack("<II", DICT_MAGIC, len(packed)) + packed)
    packer, n = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=True), 0
    for part in (first, records):
        for r in part:
            out.write(packer.compress(r))
            n += 1
    return n


def read_archive(source, step: int = 1 << 20):
    """The records (bytes) of an archive, one frame at a time."""
    data, shared = source.read(8), None
    if len(data) == 8 and struct.unpack("<I", data[:4])[0] == DICT_MAGIC:
        n = struct.unpack("<I", data[4:])[0]
        packed, data = source.read(n), b""
        if len(packed) != n:
            raise ValueError("the dictionary's frame is cut short")
        raw = packed
        if struct.unpack("<I", packed[:4])[0] == FRAME_MAGIC:
            raw = zstandard.ZstdDecompressor().decompress(packed)
        shared = zstandard.ZstdCompressionDict(raw)
    unpacker = zstandard.ZstdDecompressor(dict_data=shared)
    while data or (data := source.read(step)):
        frame, made = unpacker.decompressobj(), io.BytesIO()
        while True:
            made.write(frame.decompress(data))
            if frame.eof:
                data = frame.unused_data
                break
            if not (data := source.read(step)):
                raise ValueError("the last frame is cut short")
        yield made.getvalue()


def planned(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """_row, page_id, url, html, first (_row and page_id of the payload's
    response; null for a payload under ``min_bytes``), per row of ``pages``."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = save(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumns({
        "_row": F.monotonically_increasing_id(), "_sha": F.unhex(F.sha1(payload)), "_n": F.length(payload)}), "pages")
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "_row")
    groups = rows.filter(F.col("_n") >= min_bytes).groupBy("_sha", "_n").agg(
        F.min(order).alias("first"), F.count("*").alias("c"))
    shared = groups.filter("c > 1").select("_sha", "_n", "first._row", "first.page_id")
    first = F.when(F.col("s._row").isNotNull(), F.struct("s._row", "s.page_id"))
    # only payloads that occur twice are joined; a hot one is split by Spark's skew join
    return rows.alias("p").join(shared.alias("s"), (F.col("p._sha") == F.col("s._sha")) & (
        F.col("p._n") == F.col("s._n")), "left").select("p._row", "p.page_id", "url", "html", first.alias("first"))


def write(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) and return part, path, n_records per archive."""
    def put(batches):
        first = next(batches, None)
        if first is None:
            return

        def records():
            batch = first
            while batch is not None:
                for row, page_id, url, html, at in zip(*(batch.column(c).to_pylist() for c in (
                        "_row", "page_id", "url", "html", "first"))):
                    own = at is None or at["_row"] == row
                    yield record(row, page_id, url, (html or "").encode(), None if own else (at["_row"], at["page_id"]))
                batch = next(batches, None)

        part = TaskContext.get().partitionId()
        with published(folder, f"part-{part:06d}.warc.zst") as (out, path):
            n = write_archive(out, records())
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, path, n)], ["part", "path", "n_records"])

    return save(planned(pages, min_bytes).mapInArrow(put, "part long, path string, n_records long"), "archives")


READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
READ_ARROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64())])


def read(files: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to per record of the archives."""
    def get(batches):
        store, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with store.open_input_stream(path, compression=None) as source:
                    rows = []
                    for data in read_archive(source):
                        rows.append(parse(data))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=READ_ARROW)
                            rows = []
                    yield pa.RecordBatch.from_pylist(rows, schema=READ_ARROW)

    return spread(files.select("part", "path"), "part").mapInArrow(get, READ_SCHEMA)


def round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write the archives into a fresh shared folder and read them back."""
    folder = new_uri(pages.sparkSession, "archives")
    return read(write(pages, folder, min_bytes), folder)
