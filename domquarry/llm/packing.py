"""Best-fit packing with certified bin counts.

Documents become pieces of at most ``capacity`` tokens.  Full pieces are a
sequence each.  The others are dealt to shards of bounded size, and every shard
packs its pieces by best-fit decreasing.  Dual-feasible functions give a lower
bound of each shard's bin count: a shard that meets its bound is certified.
Shards with a gap give up the pieces of their bins that are not full; a
certified shard gives up only its emptiest bin (the one that a neighbour may
fill).  What was given up is dealt anew, to fewer shards, and packed again, as
long as that saves sequences.

Results for odd input: a null or empty text is the end id alone (one piece of
one token); repeated rows are packed once per row; an empty table gives no row;
null doc_ids are kept as null.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from domquarry.llm.common import save
from domquarry.llm.tokens import Encoder, load

CAPACITY = 4096
END_ID = 1
#: Most pieces that one shard packs (a few tens of MB in its task).
SHARD_PIECES = 200_000
MAX_ROUNDS = 6


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
           with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 [, ids]: the token ids of each
    document and ``end_id``, cut every ``capacity`` ids.  ``ids`` holds them as
    little-endian unsigned 32-bit integers."""
    spec, end = load(tokenizer_path), np.asarray([end_id], "<u4").tobytes()
    id_type = docs.schema["doc_id"].dataType
    fields = [T.StructField("doc_id", id_type), T.StructField("piece", T.IntegerType()),
              T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
              T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))

    def cut(batches):
        encoder = Encoder(spec, "word")
        for batch in batches:
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                data = encoder.ids(text) + end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at:at + 4 * capacity]
                    rows.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            out = [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                   pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                out.append(pa.array(ids, pa.binary()))
            yield pa.RecordBatch.from_arrays(out, [f.name for f in fields])

    return docs.select("doc_id", "text").mapInArrow(cut, T.StructType(fields))


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that items need at least.  counts[x]: items of size x, for x up to ``capacity``.

    The best of two families of dual-feasible functions: one rounds items over
    ``capacity - t`` up to a bin and drops those under t, the other rounds
    sizes to multiples of 1/k of a bin."""
    sizes = np.arange(capacity + 1)
    best = -(-int((counts * sizes).sum()) // capacity)
    number, volume = np.cumsum(counts), np.cumsum(counts * sizes)
    for t in np.flatnonzero(counts[:capacity // 2 + 1]):
        if t:
            large = int(number[capacity] - number[capacity - t])
            middle = int(volume[capacity - t] - volume[t - 1])
            best = max(best, large + -(-middle // capacity))
    half = int(number[capacity] - number[capacity // 2])
    best = max(best, half)
    for k in range(1, 33):
        scaled = sizes * (k + 1)
        exact = scaled % capacity == 0
        # in units of 1 / (k * capacity) of a bin, to stay in integers
        value = np.where(exact, sizes * k, scaled // capacity * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the fill of each bin.  Ties go to the earlier item."""
    bins, offsets, fills = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room left
    some = 0  # bit r: there is a bin with room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fit = some >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                some &= ~(1 << room)
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        rooms[room - size].append(b)
        some |= 1 << (room - size)
    return bins, offsets, np.asarray(fills, np.int64)


def shard_packer(capacity: int, base: int, last: bool):
    """Packs one shard; ``_open`` marks what it gives up, which is nothing if ``last``."""
    def run(key, shard):
        shard = shard.sort_by("_row").drop(["_shard"])
        lengths = shard["length"].to_numpy()
        bins, offsets, fills = best_fit_decreasing(lengths, capacity)
        certified = len(fills) <= lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        if last:
            given = np.zeros(len(fills), bool)
        elif certified:
            given = np.arange(len(fills)) == int(fills.argmin())
        else:
            given = fills < capacity
        places = {"sequence_id": base + (key[0].as_py() << 32) + bins, "offset": offsets, "_open": given[bins]}
        for name, values in places.items():
            shard = shard.append_column(name, pa.array(values))
        return shard

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES,
         max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """``items`` with sequence_id and offset.

    ``items`` needs a column ``length`` (long, 0 to ``capacity``) and must not
    have columns _row, _round, _shard, _open, sequence_id or offset.  Sequences
    are numbered without gaps inside a round and a shard, not over all."""
    numbered = save(items.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    names = numbered.columns
    full = numbered.filter(F.col("length") == capacity).select(
        "*", (F.lit(-1) - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    pool = numbered.filter(F.col("length") < capacity)
    schema = T.StructType([*numbered.schema.fields, T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType()), T.StructField("_open", T.BooleanType())])
    done, before = [full], None
    for number in range(max_rounds):
        n = pool.count()
        if not n:
            break
        shards = -(-n // shard_pieces)
        last = shards == 1 or number == max_rounds - 1
        dealt = pool.select(*names, F.pmod(F.xxhash64("_row", F.lit(number)), F.lit(shards)).alias("_shard"))
        packed = save(dealt.groupBy("_shard").applyInArrow(
            shard_packer(capacity, number << 56, last), schema), "packed")
        if before is not None and packed.agg(F.countDistinct("sequence_id")).first()[0] >= before:
            break  # the former places stay: packing anew saved nothing
        if before is not None:
            done.pop()
        given_up = packed.filter("_open")
        done += [packed.filter("not _open").drop("_open"), given_up.drop("_open")]
        if last:
            break
        before = given_up.agg(F.countDistinct("sequence_id")).first()[0]
        pool = given_up.select(*names)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("_row")


def bound(items: DataFrame, capacity: int = CAPACITY) -> int:
    """Sequences that all items together need at least, from their counts by length."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in items.groupBy("length").count().collect():  # at most capacity + 1 rows
        counts[length] = n
    return lower_bound(counts, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed ids of each sequence (``pieces`` made with_ids)."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # at most capacity pieces
    joined = F.aggregate(ordered, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))


def packed_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY,
                     end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset per piece."""
    packed = pack(pieces(docs, tokenizer_path, capacity, end_id), capacity)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
