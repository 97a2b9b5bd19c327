"""Token-id files: byte or bit planes of fixed-size id blocks, compressed plane by plane.

One file per range of doc_ids, in ascending order (nulls first; equal doc_ids
by their texts' hash).  The ranges come from a pass over ids and hashes alone; texts are
encoded where they are read, and only packed ids are shuffled and sorted.  A file is

    magic | blocks | document blocks | index (zstd JSON) | index length (u32) | magic

A block holds ``block_ids`` ids (the last one fewer) as planes: byte planes are
byte 0 of all ids, byte 1 of all ids, and so on; bit planes are bit 0 of all
ids, and so on, eight ids a byte.  Each plane is a zstandard frame.  The index
has, per block, its place, number of ids, plane lengths and crc32.  Document
blocks hold doc_ids and token counts the same way.  Files are written under a
name of their own and moved into place, so a task that runs twice does no harm.

Null and empty texts are the end id alone; repeated rows are written once per
row; an empty table writes no file and reads back as no row.
"""

from __future__ import annotations

import json
import struct
import zlib
from bisect import bisect_right
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from domquarry.llm.common import save
from domquarry.llm.files import new_uri, published, spread
from domquarry.llm.tokens import Encoder, load, release

MAGIC = b"IDPLANE1"
BLOCK_IDS = 1 << 16
END_ID = 2
FILE_BYTES = 32 << 20  # text of a file, about
MAX_FILES = 1 << 16
SLICE = 512  # documents encoded before their ids are passed on


def to_planes(values: np.ndarray, layout: str) -> list[bytes]:
    """Planes of unsigned integers; ``layout`` is ``byte`` or ``bit``."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize)
    if layout == "bit":
        bits = np.unpackbits(raw, axis=1, bitorder="little")
        return [p.tobytes() for p in np.packbits(bits.T, axis=1, bitorder="little")]
    return [p.tobytes() for p in np.ascontiguousarray(raw.T)]


def from_planes(planes: list[bytes], n: int, dtype: str, layout: str) -> np.ndarray:
    rows = np.stack([np.frombuffer(p, np.uint8) for p in planes])
    if layout == "bit":
        bits = np.unpackbits(rows, axis=1, count=n, bitorder="little")
        rows = np.packbits(bits.T, axis=1, bitorder="little").T
    return np.ascontiguousarray(rows.T).reshape(-1).view(dtype)[:n]


class Writer:
    """Writes one file; memory is bounded by a block of ids and a block of documents."""

    def __init__(self, out, layout: str, block_ids: int):
        self.out, self.layout, self.block_ids = out, layout, block_ids
        self.packer = zstandard.ZstdCompressor(level=3)
        self.at, self.buffer, self.docs, self.index = 0, bytearray(), [], {"ids": [], "docs": []}
        self.n_docs = self.n_ids = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _block(self, kind: str, values: np.ndarray, **more) -> None:
        planes = [self.packer.compress(p) for p in to_planes(values, self.layout)]
        self.index[kind].append({"at": self.at, "n": len(values), "planes": [len(p) for p in planes],
                                 "crc": zlib.crc32(values.tobytes())} | more)
        for p in planes:
            self._put(p)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.buffer += ids
        self.docs.append((doc_id is not None, doc_id or 0, len(ids) // 4))
        self.n_docs, self.n_ids = self.n_docs + 1, self.n_ids + len(ids) // 4
        if len(self.buffer) >= 4 * self.block_ids:
            self._flush_ids(False)
        if len(self.docs) >= self.block_ids:
            self._flush_docs()

    def _flush_ids(self, rest: bool) -> None:
        step, at = 4 * self.block_ids, 0
        while len(self.buffer) - at >= step or rest and at < len(self.buffer):
            self._block("ids", np.frombuffer(bytes(self.buffer[at:at + step]), "<u4"))
            at += step
        del self.buffer[:at]

    def _flush_docs(self) -> None:
        flat = np.asarray(self.docs, np.int64).reshape(-1, 3).T.reshape(-1)
        self._block("docs", flat.astype("<i8").view("<u8"), rows=len(self.docs))
        self.docs = []

    def close(self) -> None:
        self._flush_ids(True)
        if self.docs:
            self._flush_docs()
        meta = {"layout": self.layout, "block_ids": self.block_ids, "n_docs": self.n_docs, "n_ids": self.n_ids}
        index = self.packer.compress(json.dumps(meta | self.index).encode())
        self._put(index + struct.pack("<I", len(index)) + MAGIC)


class Reader:
    """Reads one file by its index; raises where magic, lengths or checksums do not hold."""

    def __init__(self, source):
        self.source, self.unpacker = source, zstandard.ZstdDecompressor()
        end = source.size()
        tail = source.read_at(12, end - 12)
        if tail[4:] != MAGIC or source.read_at(8, 0) != MAGIC:
            raise ValueError("not an id-plane file")
        n = struct.unpack("<I", tail[:4])[0]
        self.index = json.loads(self.unpacker.decompress(source.read_at(n, end - 12 - n)))

    def block(self, entry: dict, dtype: str) -> np.ndarray:
        data, planes, at = self.source.read_at(sum(entry["planes"]), entry["at"]), [], 0
        for n in entry["planes"]:
            planes.append(self.unpacker.decompress(data[at:at + n]))
            at += n
        values = from_planes(planes, entry["n"], dtype, self.index["layout"])
        if len(values) != entry["n"] or zlib.crc32(values.tobytes()) != entry["crc"]:
            raise ValueError("a block does not hold what its index entry says")
        return values

    def documents(self):
        """(doc_id, ids as bytes) in the order of the file."""
        blocks, buffer = iter(self.index["ids"]), bytearray()
        for entry in self.index["docs"]:
            known, doc_ids, lengths = self.block(entry, "<u8").view("<i8").reshape(3, entry["rows"])
            for k, doc_id, n in zip(known.tolist(), doc_ids.tolist(), lengths.tolist()):
                while len(buffer) < 4 * n:
                    buffer += self.block(next(blocks), "<u4").tobytes()
                yield doc_id if k else None, bytes(buffer[:4 * n])
                del buffer[:4 * n]


def ranges(docs: DataFrame, file_bytes: int) -> list[tuple]:
    """Where the files' ranges of (doc_id, hash of the text) begin, in order: one row per file
    reaches the driver.  Files hold some ``file_bytes`` of text, more beyond ``MAX_FILES``."""
    key = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"))
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    dealt = key.repartitionByRange(min(MAX_FILES, total // file_bytes + 1), F.col("doc_id").asc_nulls_first(), "tie")
    first = F.min(F.struct("doc_id", "tie"))  # nulls come first in a struct as well
    rows = dealt.groupBy(F.spark_partition_id()).agg(first.alias("f")).select("f.*").collect()
    return sorted(_place(*r) for r in rows)


def _place(doc_id: int | None, tie: int) -> tuple:
    return doc_id is not None, doc_id or 0, tie


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int, starts: list[tuple]) -> DataFrame:
    """part, doc_id, tie, ids (packed, with the end id) of every document."""
    spec, end, width = load(tokenizer_path), np.asarray([end_id], "<u4").tobytes(), _width(tokenizer_path, end_id)

    def encode(batches):
        encoder = Encoder(spec, "byte")
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                doc_ids, ties = (c.to_pylist() for c in batch.slice(k, SLICE).columns[:2])
                parts = [bisect_right(starts, _place(d, t)) - 1 for d, t in zip(doc_ids, ties)]
                ids = [np.frombuffer(encoder.ids(text.as_py()) + end, "<u4").astype(width).tobytes()
                       for text in batch.column(2).slice(k, SLICE)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in ((parts, pa.int64()), (doc_ids, pa.int64()), (ties, pa.int64()), (ids, pa.binary()))],
                    ["part", "doc_id", "tie", "ids"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    return texts.mapInArrow(encode, "part long, doc_id long, tie long, ids binary")


def _width(tokenizer_path: str, end_id: int) -> str:
    """Two bytes an id where all ids fit."""
    size = Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True)
    return "<u2" if max(size, end_id + 1) <= 1 << 16 else "<u4"


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, layout: str = "byte",
          block_ids: int = BLOCK_IDS, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``docs`` (doc_id long, text) and return the list of files:
    part, path, n_docs, n_ids, start (ids in all earlier files)."""
    width = _width(tokenizer_path, end_id)

    def put(batches):
        release()  # what encoding held
        rows = ((part.as_py(), doc_id.as_py(), ids.as_py())
                for batch in batches for part, doc_id, ids in zip(*batch.columns))
        for part, own in groupby(rows, lambda row: row[0]):
            with published(folder, f"part-{part:06d}.ids") as (out, path):
                writer = Writer(out, layout, block_ids)
                for _, doc_id, ids in own:
                    writer.add(doc_id, np.frombuffer(ids, width).astype("<u4").tobytes())
                writer.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in (part, path, writer.n_docs, writer.n_ids)], ["part", "path", "n_docs", "n_ids"])

    rows = encoded(docs, tokenizer_path, end_id, ranges(docs, file_bytes))
    # a task may get several parts: it writes their files one after the other
    dealt = rows.repartition("part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "tie")
    files = save(dealt.select("part", "doc_id", "ids").mapInArrow(
        put, "part long, path string, n_docs long, n_ids long"), "id_files")
    # one row per file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


def read(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 per document, from the files of ``write``."""

    def get(batches):
        release()
        store, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                with store.open_input_file(path) as source:
                    rows = []
                    for doc_id, ids in Reader(source).documents():
                        rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
                        start += len(ids) // 4
                        if len(rows) == 50_000:
                            yield _batch(rows)
                            rows = []
                    yield _batch(rows)

    return spread(files.select("part", "path", "start"), "part").mapInArrow(
        get, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _batch(rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                      ["doc_id", "start", "n_tokens", "ids_crc32"])


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Write the files into a fresh shared folder and read them back."""
    folder = new_uri(docs.sparkSession, "token_files")
    return read(write(docs, folder, tokenizer_path, end_id), folder)
