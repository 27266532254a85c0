"""Token ids in patched frame-of-reference blocks.

A segment holds the ids of consecutive documents in blocks of BLOCK ids. A block subtracts its minimum and packs the rest
at the width that COVERED of its values fit in; of larger values it packs the low bits and lists position and high bits as
exceptions. The segment's header indexes where each block starts, so a range of ids is read without the blocks before it.

    segment  magic "PFR1", block size u32, ids u64, blocks u32, then for each block its start in the body u64, then the body
    block    minimum u32, values u16, exceptions u16, width u8, packed values (little-endian bits), exception positions
             u16 each, exception high bits u32 each

Segments lie in a Parquet table (columns part, seq, first, ids, data) and their documents in another (doc id, part, seq,
place in the segment, count), both written and read by Spark, so the files can be in any store that Spark reads. Documents
are dealt by ranges of (id, text hash), encoded in that order, and a segment ends after the document that fills it; a
document longer than a segment gets a segment of its own.

Defined results: a null text has no ids of its own, only the end id; null ids sort first; rows of the same id follow each
other by text hash; an empty table gives no segment; other columns take no part.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.store import written
from brindle.llm.tokens import forget, library_table

BLOCK, COVERED, SEGMENT_IDS = 4096, 0.98, 1 << 20
MAGIC = b"PFR1"
HEAD, BLOCK_HEAD = struct.Struct("<4sIQI"), struct.Struct("<IHHB")


def pack(values: np.ndarray, width: int) -> bytes:
    """The low width bits of each value, one after the other: eight values are width bytes, so each group of eight is
    shifted into lanes of 64 bits."""
    if not width or not len(values):
        return b""
    rows = np.zeros((-(-len(values) // 8), 8), dtype=np.uint64)
    rows.ravel()[: len(values)] = values & np.uint32((1 << width) - 1)
    lanes = np.zeros((len(rows), -(-width // 8) + 1), dtype=np.uint64)
    for i in range(8):
        lane, at = divmod(i * width, 64)
        lanes[:, lane] |= rows[:, i] << np.uint64(at)
        if at + width > 64:
            lanes[:, lane + 1] |= rows[:, i] >> np.uint64(64 - at)
    data = np.ascontiguousarray(lanes.astype("<u8", copy=False).view(np.uint8).reshape(len(rows), -1)[:, :width])
    return data.tobytes()[: (len(values) * width + 7) // 8]


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    if not width or not n:
        return np.zeros(n, dtype=np.uint32)
    groups = -(-n // 8)
    held = np.zeros(groups * width, dtype=np.uint8)
    held[: len(data)] = np.frombuffer(data, np.uint8)
    lanes = np.zeros((groups, 8 * (-(-width // 8) + 1)), dtype=np.uint8)
    lanes[:, :width] = held.reshape(groups, width)
    lanes = lanes.view("<u8")
    out, mask = np.empty((groups, 8), dtype=np.uint64), np.uint64((1 << width) - 1)
    for i in range(8):
        lane, at = divmod(i * width, 64)
        out[:, i] = lanes[:, lane] >> np.uint64(at)
        if at + width > 64:
            out[:, i] |= lanes[:, lane + 1] << np.uint64(64 - at)
    return (out & mask).astype(np.uint32).ravel()[:n]


def write_block(ids: np.ndarray) -> bytes:
    low = int(ids.min())
    rest = (ids - np.uint32(low)).astype(np.uint32)
    width = int(np.partition(rest, k := int(np.ceil(COVERED * len(rest))) - 1)[k]).bit_length()
    over = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.empty(0, dtype=int)
    return b"".join((BLOCK_HEAD.pack(low, len(rest), len(over), width), pack(rest, width), over.astype("<u2").tobytes(), (rest[over] >> np.uint32(min(width, 31))).astype("<u4").tobytes()))


def read_block(data: memoryview) -> np.ndarray:
    low, n, n_over, width = BLOCK_HEAD.unpack_from(data)
    at = BLOCK_HEAD.size
    out = unpack(data[at : (at := at + (n * width + 7) // 8)], n, width)
    where = np.frombuffer(data, "<u2", n_over, at)
    out[where] |= np.frombuffer(data, "<u4", n_over, at + 2 * n_over) << np.uint32(min(width, 31))
    return out + np.uint32(low)


def write_segment(ids: np.ndarray, block: int = BLOCK) -> bytes:
    blocks = [write_block(ids[i : i + block]) for i in range(0, len(ids), block)]
    starts = np.cumsum([0, *map(len, blocks)][: len(blocks)] or [0], dtype="<u8")[: len(blocks)]
    return b"".join((HEAD.pack(MAGIC, block, len(ids), len(blocks)), starts.tobytes(), *blocks))


def read_segment(data: bytes, start: int = 0, count: int | None = None) -> np.ndarray:
    """The ids from start on, read from the blocks that hold them only."""
    magic, block, n, n_blocks = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a segment")
    end = n if count is None else min(n, start + count)
    if start >= end:
        return np.empty(0, dtype=np.uint32)
    starts, body, view = np.frombuffer(data, "<u8", n_blocks, HEAD.size), HEAD.size + 8 * n_blocks, memoryview(data)
    first, last = start // block, (end - 1) // block
    return np.concatenate([read_block(view[body + int(starts[i]) :]) for i in range(first, last + 1)])[start - first * block : end - first * block]


def write_table(df: DataFrame, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Encode each text with a tokenizers file, append end_id, and write the segments in ascending order of the id.

    Returns the written table: part, seq, ids, data, docs (array of id and count in the segment's order)."""
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, part, end = library_table(vocabulary), TaskContext.get().partitionId(), np.array([end_id], np.uint32)
        held: list[np.ndarray] = []
        names: list = []
        sizes: list[int] = []
        seq = n = 0

        def segment() -> pa.RecordBatch:
            docs = pa.array([[{"id": i, "n": k} for i, k in zip(names, sizes)]], pa.list_(pa.struct([("id", arrow_kind), ("n", pa.int64())])))
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([n], pa.int64()), pa.array([write_segment(np.concatenate(held))], pa.binary()), docs], names=["part", "seq", "ids", "data", "docs"])

        for b in batches:
            arrow_kind = b.schema.field(0).type
            for i, own in zip(b.column(0).to_pylist(), chunks.ids(b.column(1))):
                size = len(own) + 1
                if n and n + size > segment_ids:
                    yield segment()
                    held, names, sizes, seq, n = [], [], [], seq + 1, 0
                held += [own, end]
                names.append(i)
                sizes.append(size)
                n += size
        if names:
            yield segment()

    text = F.col(text_col)
    rows = df.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    return written(dealt.mapInArrow(run, f"part int, seq int, ids long, data binary, docs array<struct<id:{kind},n:long>>"), "pfor")


def decoded(table: DataFrame) -> DataFrame:
    """part, seq, id, own_start (within the segment), n_tokens, ids binary: read from the segments where they lie."""
    kind = table.schema["docs"].dataType.elementType["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # a worker that has written doesn't need its memos any more
        for b in batches:
            for k in range(b.num_rows):
                part, seq, data, docs = (b.column(i)[k].as_py() for i in range(4))
                ids = read_segment(data)
                ends = np.cumsum([d["n"] for d in docs])
                for i in range(0, len(docs), 1000):
                    some = docs[i : i + 1000]
                    starts = [int(e) - d["n"] for e, d in zip(ends[i : i + 1000], some)]
                    yield pa.record_batch(
                        [pa.array([part] * len(some), pa.int32()), pa.array([seq] * len(some), pa.int32()), pa.array([d["id"] for d in some], b.schema.field(3).type.value_type.field(0).type), pa.array(starts, pa.int64()), pa.array([d["n"] for d in some], pa.int64()), pa.array([ids[s : s + d["n"]].astype("<u4").tobytes() for s, d in zip(starts, some)], pa.binary())],
                        names=["part", "seq", "id", "own_start", "n_tokens", "ids"],
                    )

    return table.select("part", "seq", "data", "docs").mapInArrow(run, f"part int, seq int, id {kind}, own_start long, n_tokens long, ids binary")


def located(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows (part, seq, own_start and more) with start: ids of all documents before. Segments' data is not moved.

    Running sums: over parts (one row for each task that wrote) and over a part's segments."""
    parts = table.groupBy("part").agg(F.sum("ids").alias("total"))
    before = parts.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("parts_before"))
    own = Window.partitionBy("part").orderBy("seq")
    firsts = table.select("part", "seq", (F.sum("ids").over(own) - F.col("ids")).alias("own_before")).join(before, "part")
    first = firsts.select("part", "seq", (F.col("own_before") + F.col("parts_before")).alias("first"))
    return rows.join(first, ["part", "seq"]).withColumn("start", F.col("first") + F.col("own_start"))


def read_table(table: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, start (ids of all documents before it), n_tokens, ids binary (little-endian unsigned 32-bit), read from the segments."""
    return located(decoded(table), table).select(F.col("id").alias(id_col), "start", "n_tokens", "ids")


def digests(table: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, start, n_tokens and ids_crc32 of what is read; only the digests are joined with the starts."""
    rows = decoded(table).select("part", "seq", "id", "own_start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return located(rows, table).select(F.col("id").alias(id_col), "start", "n_tokens", "ids_crc32")


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
