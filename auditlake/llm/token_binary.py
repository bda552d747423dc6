"""Operator 8, token ids in a binary format: bit-plane shuffling.

A file holds chunks of a fixed number of ids. A chunk's block of ids is transposed into byte
planes (or bit planes), and each plane is compressed with zstandard. A chunk index at the end
gives the place, length and first id of every plane, so that any chunk is read alone.

Layout (little endian): magic `BPL1`, u8 planes per id, u8 mode (0 byte planes, 1 bit planes),
u16 zero, u32 ids a chunk; the compressed planes; the index: for each chunk u32 ids, u64
place of its first plane, and u32 length of each plane; the documents: for each doc u64 doc_id
(two's complement), u8 null flag, u64 start, u32 ids; the footer: u32 chunks, u32 documents,
u64 place of the index, magic.

Files are written in ascending doc_id order as rows (range, file, content) of a Parquet table
in a shared folder, so that Spark's commit protocol covers them when an executor is lost.

Defined results: null text counts as empty (the end id alone); a null doc_id sorts first;
rows with equal doc_id keep rows of their own, ordered by text; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, table_partitions, text_chunks, tune
from .textops import prefix, ragged
from .tokenizing import load

MAGIC = b"BPL1"
CHUNK_IDS = 1 << 16
FILE_IDS = 1 << 19
HEAD, FOOT = struct.Struct("<4sBBHI"), struct.Struct("<IIQ4s")
DOC = np.dtype([("doc_id", "<i8"), ("missing", "u1"), ("start", "<u8"), ("n", "<u4")])


def to_planes(ids: np.ndarray, planes: int, bits: bool) -> list[bytes]:
    """Byte planes of a block of unsigned ids; or bit planes, lowest bit first."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :planes]
    if not bits:
        return [raw[:, k].tobytes() for k in range(planes)]
    spread = np.unpackbits(np.ascontiguousarray(raw), axis=1, bitorder="little")
    return [np.packbits(spread[:, k], bitorder="little").tobytes() for k in range(8 * planes)]


def from_planes(parts: list[bytes], n: int, planes: int, bits: bool) -> np.ndarray:
    raw = np.zeros((n, 4), np.uint8)
    if bits:
        spread = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in parts], axis=1)
        raw[:, :planes] = np.packbits(spread, axis=1, bitorder="little")
    else:
        for k, part in enumerate(parts):
            raw[:, k] = np.frombuffer(part, np.uint8)
    return raw.view("<u4").reshape(-1)


def encode_file(doc_ids: list[int | None], ids: np.ndarray, offsets: np.ndarray, bits: bool = False, chunk: int = CHUNK_IDS, level: int = 3) -> bytes:
    planes = max(1, (int(ids.max(initial=0)).bit_length() + 7) // 8)
    coder, out, index = zstandard.ZstdCompressor(level=level), [HEAD.pack(MAGIC, planes, bits, 0, chunk)], []
    place = HEAD.size
    for begin in range(0, len(ids), chunk):
        block = ids[begin : begin + chunk]
        parts = [coder.compress(p) for p in to_planes(block, planes, bits)]
        index.append(struct.pack(f"<IQ{len(parts)}I", len(block), place, *map(len, parts)))
        out += parts
        place += sum(map(len, parts))
    table = np.zeros(len(doc_ids), DOC)
    table["doc_id"] = [d or 0 for d in doc_ids]
    table["missing"] = [d is None for d in doc_ids]
    table["start"], table["n"] = offsets[:-1], np.diff(offsets)
    return b"".join([*out, *index, table.tobytes(), FOOT.pack(len(index), len(doc_ids), place, MAGIC)])


class TokenFile:
    """Reads a file's bytes; ids(a, b) decompresses only the chunks that hold ids a to b."""

    def __init__(self, content: bytes):
        self.content = content
        magic, self.planes, self.bits, _, self.chunk = HEAD.unpack_from(content, 0)
        chunks, documents, place, foot = FOOT.unpack_from(content, len(content) - FOOT.size)
        if magic != MAGIC or foot != MAGIC:
            raise ValueError("not a token file")
        self.parts = self.planes * (8 if self.bits else 1)
        row = struct.Struct(f"<IQ{self.parts}I")
        self.index = [row.unpack_from(content, place + k * row.size) for k in range(chunks)]
        self.documents = np.frombuffer(content, DOC, documents, place + chunks * row.size)
        self.coder = zstandard.ZstdDecompressor()

    def block(self, k: int) -> np.ndarray:
        n, place, *sizes = self.index[k]
        parts = []
        for size in sizes:
            parts.append(self.coder.decompress(self.content[place : place + size]))
            place += size
        return from_planes(parts, n, self.planes, bool(self.bits))

    def ids(self, begin: int, end: int) -> np.ndarray:
        if begin >= end:
            return np.zeros(0, "<u4")
        first = begin // self.chunk
        whole = np.concatenate([self.block(k) for k in range(first, (end - 1) // self.chunk + 1)])
        return whole[begin - first * self.chunk : end - first * self.chunk]


def _write(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, bits: bool) -> Iterator[pa.RecordBatch]:
    coder, part, made = load(tokenizer), TaskContext.get().partitionId(), 0
    doc_ids, held, counts, size = [], [], [], 0

    def flush():
        content = encode_file(doc_ids, np.concatenate(held), prefix(np.concatenate(counts)), bits)
        return pa.RecordBatch.from_pydict({"range": pa.array([part], pa.int64()), "file": pa.array([made], pa.int64()), "n_ids": pa.array([size], pa.int64()), "content": pa.array([content], pa.binary())})

    for batch in text_chunks(batches):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        ids, offsets = coder.encode(texts)
        n = np.diff(offsets) + 1
        full = np.full(len(ids) + len(texts), end_id, np.uint32)
        full[ragged(prefix(n)[:-1], n - 1)] = ids
        doc_ids += batch.column("doc_id").to_pylist()
        held.append(full)
        counts.append(n)
        size += len(full)
        if size >= FILE_IDS:
            yield flush()
            made += 1
            doc_ids, held, counts, size = [], [], [], 0
    if size:
        yield flush()


def write(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, bits: bool = False) -> None:
    """Write the ids of all texts, in ascending doc_id order, into files under path."""
    spark = tune(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = source.repartitionByRange(table_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def encode(batches):
        return _write(batches, tokenizer, end_id, bits)

    ordered.mapInArrow(encode, "range long, file long, n_ids long, content binary").write.option("compression", "uncompressed").option("parquet.block.size", str(16 << 20)).parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, content in zip(batch.column("begin").to_pylist(), batch.column("content"), strict=True):
            file = TokenFile(content.as_py())
            ids = np.concatenate([file.block(k) for k in range(len(file.index))]).astype("<u4")
            raw, docs = ids.view(np.uint8).data, file.documents
            starts, sizes = docs["start"].astype(np.int64), docs["n"].astype(np.int64)
            crc = [zlib.crc32(raw[4 * s : 4 * (s + n)]) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(docs["doc_id"], mask=docs["missing"].astype(bool)),
                "start": pa.array(starts + begin),
                "n_tokens": pa.array(sizes),
                "ids_crc32": pa.array(crc, pa.int64()),
            })


def read_documents(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, from the files' own bytes.

    A file's first id comes from two sums of file sizes: inside its range, and over the ranges
    before it. There are as many ranges as shuffle partitions.
    """
    files = spark.read.parquet(path)
    sums = files.groupBy("range").agg(F.sum("n_ids").alias("n"))
    ranges = sums.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    sizes = files.select("range", "file", "n_ids")
    places = sizes.select("range", "file", (F.sum("n_ids").over(Window.partitionBy("range").orderBy("file")) - F.col("n_ids")).alias("inner"))
    begins = places.join(ranges, "range").select("range", "file", (F.col("inner") + F.col("before")).alias("begin"))
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    placed = files.join(F.broadcast(begins), ["range", "file"]) if _small(begins) else files.join(begins, ["range", "file"])
    return placed.select("begin", "content").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _small(begins: DataFrame, most: int = 100_000) -> bool:
    return begins.count() <= most


def op8_token_binary(spark, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_documents(spark, path)
