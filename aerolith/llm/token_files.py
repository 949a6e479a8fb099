"""Token ids in binary files: frequency-ranked, byte-aligned variable length.

Ids are replaced by their rank of frequency over the corpus, so that the commonest take
one byte. A file holds whole documents in ascending doc_id order::

    8 bytes   magic
    5 x u64   documents, ids, ids of all documents before the file, control and data bytes
    i64 each  doc_id        u8 each  1 if the doc_id is not null        u64 each  ids of the document
    control   two bits an id (bytes - 1), four ids a byte, the first in the low bits
    data      the ranks' low bytes first

``ranks.bin`` beside them is the id of each rank (u32). A reader needs one control byte to
know where four ids lie: lengths come from a 256-entry table and all ids of a file are
gathered by numpy at once.

Defined results: a null or empty text is the end id alone; null doc_ids come first;
repeated rows are written as often as they occur; an empty table gives no files; other
columns are not looked at.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.llm.common import pieces, staged
from aerolith.llm.tokens import encoder
from aerolith.session import scratch_path

MAGIC = b"RANKVB01"
FILE_IDS = 4_000_000
_HEAD = struct.Struct("<8s5Q")
#: Byte lengths of the four ids that a control byte stands for.
LENGTHS = (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3).astype(np.uint8) + 1
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of uint32 values."""
    v = ranks.astype("<u4")
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    code = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    code[:len(v)] = size - 1
    quads = code.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The uint32 values of control and data bytes, by table lookup."""
    size = LENGTHS[control].reshape(-1)[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    padded = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.uint32)
    value = padded[at]
    for k in (1, 2, 3):
        value |= padded[at + k] << np.uint32(8 * k)
    return value & _MASKS[size]


def pack_file(doc_ids: list[int | None], sizes: list[int], start: int, ranks: np.ndarray) -> bytes:
    control, data = encode_ranks(ranks)
    head = _HEAD.pack(MAGIC, len(sizes), len(ranks), start, len(control), len(data))
    return b"".join((head, np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
                     np.array([x is not None for x in doc_ids], np.uint8).tobytes(),
                     np.array(sizes, "<u8").tobytes(), control, data))


def unpack_file(raw: bytes) -> tuple[list[int | None], np.ndarray, int, np.ndarray]:
    """(doc_ids, ids of each document, ids before the file, ranks)."""
    magic, docs, ids, start, n_control, n_data = _HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = _HEAD.size
    if len(raw) != at + 17 * docs + n_control + n_data:
        raise ValueError("a token file is cut short")
    doc_ids = np.frombuffer(raw, "<i8", docs, at)
    valid = np.frombuffer(raw, np.uint8, docs, at + 8 * docs)
    sizes = np.frombuffer(raw, "<u8", docs, at + 9 * docs).astype(np.int64)
    at += 17 * docs
    control = np.frombuffer(raw, np.uint8, n_control, at)
    data = np.frombuffer(raw, np.uint8, n_data, at + n_control)
    return [int(x) if v else None for x, v in zip(doc_ids, valid, strict=True)], sizes, start, decode_ranks(control, data, ids)


def _tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(part, place, doc_id, n, ids) in ascending doc_id order within each part; place is
    the number of ids before the row in its part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, at = encoder(tokenizer), np.array([end_id], "<u4").tobytes(), 0
        part = TaskContext.get().partitionId()
        for b in pieces(batches, "text"):
            ids = [x + end for x in enc.encode(b.column("text").to_pylist())]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            place = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part, np.int32)), pa.array(place), b.column("doc_id"), pa.array(n), pa.array(ids, pa.binary())],
                ["part", "place", "doc_id", "n", "ids"])

    # the row's number splits a row that is repeated often over several ranges
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc(), F.col("row").asc()]
    ordered = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
                           F.monotonically_increasing_id().alias("row"))
               .repartitionByRange(*order).sortWithinPartitions(*order).drop("row"))
    return staged(ordered.mapInArrow(run, "part int, place bigint, doc_id bigint, n bigint, ids binary"), "token-ids")


def _ranking(rows: DataFrame) -> np.ndarray:
    """The id of each rank: ids by falling count, then by id. One row per vocabulary entry
    reaches the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in pieces(batches, "ids"):
            own = np.bincount(np.frombuffer(b"".join(b.column("ids").to_pylist()), "<u4"))
            if len(own) > len(total):
                own[:len(total)] += total
                total = own
            else:
                total[:len(own)] += own
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    counts = rows.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    return counts.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(np.uint32)


def _files(path: str):
    """(file system, folder) of a path for the tasks that write: s3a and s3n are S3 to pyarrow."""
    from pyarrow import fs as pafs
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))


def write_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the files below ``path`` (local, hdfs, gs, s3 or s3a: file systems that pyarrow writes) and
    returns (file, start, documents, ids, bytes), one row per file. They are read by Spark alone."""
    rows = _tokenized(docs, tokenizer, end_id)
    id_of = _ranking(rows)
    rank_of = np.zeros(int(id_of.max()) + 1 if len(id_of) else 0, np.uint32)
    rank_of[id_of] = np.arange(len(id_of), dtype=np.uint32)
    base, before = {}, 0
    for r in rows.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # a row per partition
        base[r["part"]], before = before, before + r["n"]
    fs, root = _files(path)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/ranks.bin") as f:
        f.write(id_of.astype("<u4").tobytes())
    held = rows.sparkSession.sparkContext.broadcast((rank_of, base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, starts = held.value
        files, top = _files(path)
        doc_ids, sizes, ids, start, end, part = [], [], [], 0, 0, None

        def close() -> pa.RecordBatch:
            raw = pack_file(doc_ids, sizes, start, ranks[np.frombuffer(b"".join(ids), "<u4")])
            name = f"{start:020d}.tok"
            # a task that is run again writes the same bytes; a reader sees whole files only
            own = f"{top}/_{name}-{uuid.uuid4().hex}"
            with files.open_output_stream(own) as f:
                f.write(raw)
            files.move(own, f"{top}/{name}")
            out = name, start, len(sizes), sum(sizes), len(raw)
            doc_ids.clear(), sizes.clear(), ids.clear()
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in out], ["file", "start", "documents", "ids", "bytes"])

        for b in pieces(batches, "ids"):
            for p, place, doc, n, raw in zip(*(b.column(c).to_pylist() for c in ("part", "place", "doc_id", "n", "ids")), strict=True):
                at = starts[p] + place
                if sizes and (p != part or at != end or end - start >= file_ids):
                    yield close()
                if not sizes:
                    start = at
                part, end = p, at + n
                doc_ids.append(doc), sizes.append(n), ids.append(raw)
        if sizes:
            yield close()

    written = rows.mapInArrow(run, "file string, start bigint, documents bigint, ids bigint, bytes bigint")
    return staged(written, "token-files")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files below ``path``, ids as
    little-endian uint32 bytes."""
    ranks = spark.read.format("binaryFile").load(f"{path.rstrip('/')}/ranks.bin").select("content").head()
    # a number per vocabulary entry; Spark has no row for the empty file of an empty table
    held = spark.sparkContext.broadcast(np.frombuffer(bytes(ranks["content"]) if ranks else b"", "<u4"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column("content"):
                doc_ids, sizes, start, ranks = unpack_file(raw.as_py())
                ids, ends = held.value[ranks], np.cumsum(sizes)
                for lo in range(0, len(sizes), 2000):
                    n, e = sizes[lo:lo + 2000], ends[lo:lo + 2000]
                    own = [ids[y - x:y].tobytes() for x, y in zip(n, e, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids[lo:lo + 2000], pa.int64()), pa.array(start + e - n), pa.array(n), pa.array(own, pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"])

    return (spark.read.format("binaryFile").option("pathGlobFilter", "[0-9]*.tok").load(path).select("content")
            .mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary"))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), read back from files that it writes below the shared folder."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_files(docs, path, tokenizer, end_id)
    return read_files(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
