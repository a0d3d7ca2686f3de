"""Token ids as length-delimited binary records: a Spark data source that writes and reads shards with offset indexes.

A shard is a run of frames. A frame is the length of its data (8 bytes), the masked checksum of these 8 bytes (4), the data,
and the masked checksum of the data (4); all numbers are little-endian. The data are the document id (8 bytes, signed), one
byte that is 1 where the id is null, one byte for the width of a token id (2, or 4 where one needs it), and the token ids.
The checksum is CRC-32, turned right by 15 bits and raised by a constant, so that a checksum of stored checksums is no
special value. Beside a shard lies its index: for each record, and for the end, the offset of its frame and the token ids
before it (8 bytes each). The manifest, written last, lists the shards in order; what it does not list, such as files of lost
attempts, is never read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from riskloom.llm.pieces import encoded

FORMAT = "token_records"
MANIFEST = "_MANIFEST.json"
#: Data of one frame before the ids; bytes read or written at a time; bytes of a shard that one task reads.
_HEAD, _BUFFER, _RANGE = struct.Struct("<qBB"), 4 << 20, 64 << 20
_FRAME = 16
_MASK = 0xA282EAD8
READ = "position long, doc_id long, start long, ids binary"
#: Positions of a shuffled read that are fetched together, in the order of the files.
_BLOCK = 2048


class DamagedRecord(ValueError):
    """A frame does not match its checksums or its index."""


def masked(data: bytes) -> int:
    """Checksum as it is stored."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    length = struct.pack("<Q", len(data))
    return b"".join((length, struct.pack("<I", masked(length)), data, struct.pack("<I", masked(data))))


def unframe(stored: bytes) -> bytes:
    """Data of exactly one frame; DamagedRecord if a byte of it has changed."""
    if len(stored) < _FRAME or masked(stored[:8]) != int.from_bytes(stored[8:12], "little") or int.from_bytes(stored[:8], "little") != len(stored) - _FRAME:
        raise DamagedRecord("the length of a record is damaged")
    data = stored[12:-4]
    if masked(data) != int.from_bytes(stored[-4:], "little"):
        raise DamagedRecord("the data of a record are damaged")
    return data


def serialise(doc_id: int | None, ids: bytes) -> bytes:
    """Data of a record from 4-byte ids."""
    wide = np.frombuffer(ids, "<u4")
    narrow = not len(wide) or int(wide.max()) < 1 << 16
    return _HEAD.pack(doc_id or 0, doc_id is None, 2 if narrow else 4) + (wide.astype("<u2").tobytes() if narrow else ids)


def deserialise(data: bytes) -> tuple[int | None, bytes]:
    """(doc_id, 4-byte ids) of a record."""
    doc_id, missing, width = _HEAD.unpack_from(data)
    ids = np.frombuffer(data, f"<u{width}", offset=_HEAD.size)
    return None if missing else doc_id, ids.astype("<u4").tobytes()


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder given as URI or as an absolute path."""
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


@dataclass
class Shard(WriterCommitMessage):
    number: int
    name: str
    records: int
    tokens: int
    size: int


class _Writer(DataSourceArrowWriter):
    """Writes ids, or, where a tokenizer is given, the ids of texts: these are encoded in the process that writes them."""

    def __init__(self, folder: str, spec: str | None = None, end: int = 0):
        self.folder, self.spec, self.end = folder, spec, end

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = _store(self.folder)
        number = TaskContext.get().partitionId()
        name = f"shard-{number:06d}-{uuid.uuid4().hex}"
        records = tokens = size = 0
        data = index = None
        try:
            for batch in batches if self.spec is None else encoded(batches, self.spec, self.end):
                if not batch.num_rows:
                    continue
                if data is None:
                    data, index = (store.open_output_stream(f"{root}/{name}.{kind}", compression=None) for kind in ("rec", "idx"))
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                    stored = frame(serialise(doc_id, ids.as_py()))
                    index.write(struct.pack("<QQ", size, tokens))
                    data.write(stored)
                    records, tokens, size = records + 1, tokens + len(ids.as_buffer()) // 4, size + len(stored)
            if data is not None:
                index.write(struct.pack("<QQ", size, tokens))
        finally:
            for file in (data, index):
                if file is not None:
                    file.close()
        return Shard(number, name, records, tokens, size)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _store(self.folder)
        shards = sorted((m for m in messages if m is not None and m.records), key=lambda m: m.number)
        with store.open_output_stream(f"{root}/{MANIFEST}", compression=None) as file:
            file.write(json.dumps([[s.name, s.records, s.tokens, s.size] for s in shards]).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _store(self.folder)
        for message in messages:
            if message is not None and message.records:
                for kind in ("rec", "idx"):
                    store.delete_file(f"{root}/{message.name}.{kind}")


class _Listed(NamedTuple):
    """A shard of the manifest, with the records and token ids of all shards before it."""

    name: str
    records: int
    tokens: int
    size: int
    first: int
    start: int


def manifest(folder: str) -> list[_Listed]:
    store, root = _store(folder)
    with store.open_input_stream(f"{root}/{MANIFEST}", compression=None) as file:
        rows = json.loads(file.read())
    out, first, start = [], 0, 0
    for name, records, tokens, size in rows:
        out.append(_Listed(name, records, tokens, size, first, start))
        first, start = first + records, start + tokens
    return out


def permuted(positions: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A permutation of range(n) at some positions, by a keyed Feistel network that walks on until it lands below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(seed).integers(0, 2**63, 6, dtype=np.uint64)
    out = positions.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for key in keys:
            mixed = (right + key) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


@dataclass
class _Range(InputPartition):
    """Records first to last of one shard, or positions first to last of a shuffled read (shard -1)."""

    shard: int
    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, folder: str, seed: int | None):
        self.folder, self.seed = folder, seed

    def partitions(self) -> list[InputPartition]:
        listed, out = manifest(self.folder), []
        if self.seed is not None:
            n, parts = sum(s.records for s in listed), sum(-(-s.size // _RANGE) for s in listed)
            return [_Range(-1, n * i // parts, n * (i + 1) // parts) for i in range(parts)] or [_Range(-1, 0, 0)]
        for k, shard in enumerate(listed):
            parts = -(-shard.size // _RANGE)
            out += [_Range(k, shard.records * i // parts, shard.records * (i + 1) // parts) for i in range(parts)]
        return out or [_Range(-1, 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        listed = manifest(self.folder) if partition.last > partition.first else []
        if listed:
            yield from self._shuffled(listed, partition) if partition.shard < 0 else self._run(listed[partition.shard], partition)

    def _run(self, shard: _Listed, part: _Range) -> Iterator[pa.RecordBatch]:
        """Consecutive records, some megabytes at a time."""
        store, root = _store(self.folder)
        with store.open_input_file(f"{root}/{shard.name}.idx") as index, store.open_input_file(f"{root}/{shard.name}.rec") as data:
            at = part.first
            while at < part.last:
                found = np.frombuffer(index.read_at(16 * (min(part.last, at + 65536) + 1 - at), 16 * at), "<u8").reshape(-1, 2)
                many = max(1, int(np.searchsorted(found[:, 0], found[0, 0] + _BUFFER, "right")) - 1)
                offsets = (found[: many + 1, 0] - found[0, 0]).tolist()
                stored = data.read_at(offsets[-1], int(found[0, 0]))
                rows = [deserialise(unframe(stored[a:b])) for a, b in zip(offsets, offsets[1:])]
                yield _batch(np.arange(at, at + many) + shard.first, found[:many, 1].astype(np.int64) + shard.start, rows)
                at += many

    def _shuffled(self, listed: list[_Listed], part: _Range) -> Iterator[pa.RecordBatch]:
        """Records in permuted order: a block of positions is fetched in the order of the files through their indexes."""
        store, root = _store(self.folder)
        firsts = np.array([s.first for s in listed])
        n = int(firsts[-1]) + listed[-1].records
        for at in range(part.first, part.last, _BLOCK):
            positions = np.arange(at, min(part.last, at + _BLOCK))
            numbers = permuted(positions, n, self.seed)
            rows: list = [None] * len(numbers)
            starts = np.zeros(len(numbers), np.int64)
            order = np.argsort(numbers).tolist()
            owner = np.searchsorted(firsts, numbers, "right") - 1
            opened, files = None, ()
            for i in order:
                shard = listed[owner[i]]
                if opened != owner[i]:
                    for file in files:
                        file.close()
                    opened, files = owner[i], [store.open_input_file(f"{root}/{shard.name}.{kind}") for kind in ("idx", "rec")]
                offset, before, end, _ = struct.unpack("<4Q", files[0].read_at(32, 16 * (int(numbers[i]) - shard.first)))
                rows[i], starts[i] = deserialise(unframe(files[1].read_at(end - offset, offset))), before + shard.start
            for file in files:
                file.close()
            yield _batch(positions, starts, rows)


def _batch(positions: np.ndarray, starts: np.ndarray, rows: list[tuple[int | None, bytes]]) -> pa.RecordBatch:
    columns = [pa.array(positions, pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array(starts, pa.int64()), pa.array([r[1] for r in rows], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["position", "doc_id", "start", "ids"])


class TokenRecords(DataSource):
    """Options: path, seed for a read in shuffled order, tokenizer and end for a write of texts."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return READ

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options["seed"]) if "seed" in self.options else None)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        store, root = _store(self.options["path"])
        store.create_dir(root)
        if "tokenizer" not in self.options:
            return _Writer(self.options["path"])
        with open(self.options["tokenizer"], encoding="utf-8") as file:
            return _Writer(self.options["path"], file.read(), int(self.options["end"]))


def write_records(sequences: DataFrame, folder: str) -> None:
    """Writes (doc_id long, ids binary of 4-byte numbers) in the order of its partitions and their rows, one shard for each."""
    sequences.sparkSession.dataSource.register(TokenRecords)
    sequences.select("doc_id", "ids").write.format(FORMAT).mode("append").option("path", folder).save()


def write_texts(docs: DataFrame, folder: str, tokenizer: str, end: int) -> None:
    """Writes (doc_id long, text) as the records of `pieces.sequences`, encoded by the writer: ids stay in one process."""
    docs.sparkSession.dataSource.register(TokenRecords)
    writer = docs.select("doc_id", "text").write.format(FORMAT).mode("append")
    writer.option("path", folder).option("tokenizer", tokenizer).option("end", str(end)).save()


def read_records(spark: SparkSession, folder: str, seed: int | None = None) -> DataFrame:
    """(position, doc_id, start, ids) of every record, checksums verified; start counts the token ids before the record.

    Without seed position is the record's number. With it records come in a random order fixed by the seed, a task taking a
    run of positions; nothing is sorted or shuffled for that, as the indexes lead to each record.
    """
    spark.dataSource.register(TokenRecords)
    reader = spark.read.format(FORMAT).option("path", folder)
    return (reader if seed is None else reader.option("seed", str(seed))).load()


def in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in ascending order of doc_id over partitions and rows, nulls first, equal ids in order of a text hash.

    Rows of one id with different texts can be dealt to several tasks; equal rows go to one, which reads them as a stream.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("place", F.xxhash64("text"))  # what is sampled to find the ranges holds no text
    return rows.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place", "text").drop("place")
