"""Sorted-string-table shards of token ids.

A shard holds documents in ascending key order. Layout, all integers little-endian unsigned:

  blocks   one after another; an entry is varint(shared prefix with the entry before), varint(rest of
           key), varint(bytes of value), rest of key, value; the first entry of a block shares nothing
  index    of each block: u16 length of its first key, that key, u64 offset, u32 bytes
  filter   Bloom filter over the keys, u8 array
  footer   64 bytes: u64 offset and u64 bytes of index, the same of the filter, u32 hashes,
           u32 blocks, u64 entries, u64 ids, 8 bytes magic

Keys are the doc_id as eight big-endian bytes with the sign flipped, so that byte order is numeric order, behind
one byte 1; a null doc_id is the byte 0 alone and comes first. Values are a byte with the width
(2 or 4) and the ids in so many bytes each. A lookup asks the filter, then finds its block by binary search in the index, and
reads that block alone.

Shards are written by tasks over ranges of doc_id, under a name of the attempt, and renamed when whole,
so that a lost executor leaves no half shard. They go to the shared folder through pyarrow's
file systems, or below ``path``.

Defined cases: a null text is an empty one and has its end id alone; repeated doc_ids stay separate
entries, in order of their texts' hashes, in as many shards as they need; an empty table gives no shards and an empty result; other columns
are not read.
"""

from __future__ import annotations

import io
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, new_path, written
from .encoding import Encoder, vocabulary_path

MAGIC = b"SSTIDS01"
FOOTER = "<QQQQIIQQ8s"
BLOCK_BYTES = 64 << 10
BITS_PER_KEY, HASHES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(buf: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def pack_ids(ids: np.ndarray) -> bytes:
    """One byte with the width, 2 or 4, then the ids in so many bytes each."""
    wide = len(ids) and int(ids.max()) > 0xFFFF
    return (b"\4" if wide else b"\2") + ids.astype("<u4" if wide else "<u2").tobytes()


def unpack_ids(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4" if data[0] == 4 else "<u2", offset=1).astype("<u4")


def _bloom_bits(key: bytes, bits: int) -> np.ndarray:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & ((1 << 64) - 1), h >> 64
    return np.array([(a + i * b) % bits for i in range(HASHES)], np.int64)


class Writer:
    """Writes one shard to a binary stream; keys must not descend."""

    def __init__(self, out: io.RawIOBase):
        self.out, self.at = out, 0
        self.block, self.last, self.first = bytearray(), b"", b""
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.ids = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must ascend")
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        value = pack_ids(ids)
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.ids += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            self.out.write(bytes(self.block))
            self.index.append((self.first, self.at, len(self.block)))
            self.at += len(self.block)
            self.block.clear()

    def finish(self) -> None:
        self._flush()
        index = b"".join(struct.pack("<H", len(k)) + k + struct.pack("<QI", a, n) for k, a, n in self.index)
        bits = max(64, -(-BITS_PER_KEY * len(self.keys) // 8) * 8)
        bloom = np.zeros(bits, np.uint8)
        for k in self.keys:
            bloom[_bloom_bits(k, bits)] = 1
        packed = np.packbits(bloom).tobytes()
        self.out.write(index + packed + struct.pack(FOOTER, self.at, len(index), self.at + len(index), len(packed), HASHES, len(self.index), len(self.keys), self.ids, MAGIC))


class Reader:
    """Reads a shard through a seekable stream: whole, or one key at a time."""

    def __init__(self, src: io.RawIOBase):
        self.src = src
        src.seek(0, 2)
        end = src.tell()
        size = struct.calcsize(FOOTER)
        src.seek(end - size)
        at, size, bloom_at, bloom_size, _, blocks, self.entries, self.ids, magic = struct.unpack(FOOTER, src.read(size))
        if magic != MAGIC:
            raise ValueError("not a shard of token ids, or cut short")
        src.seek(at)
        raw, p = src.read(size), 0
        self.index = []
        for _ in range(blocks):
            n = struct.unpack_from("<H", raw, p)[0]
            self.index.append((raw[p + 2:p + 2 + n], *struct.unpack_from("<QI", raw, p + 2 + n)))
            p += 14 + n
        src.seek(bloom_at)
        self.bloom, self.bits = np.frombuffer(src.read(bloom_size), np.uint8), bloom_size * 8

    def block(self, number: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, size = self.index[number]
        self.src.seek(at)
        raw, p, key = self.src.read(size), 0, b""
        while p < size:
            shared, p = read_varint(raw, p)
            rest, p = read_varint(raw, p)
            n, p = read_varint(raw, p)
            key = key[:shared] + raw[p:p + rest]
            yield key, unpack_ids(raw[p + rest:p + rest + n])
            p += rest + n

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.index)):
            yield from self.block(k)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document with this identifier."""
        key = key_of(doc_id)
        if not all(self.bloom[b >> 3] >> (7 - b & 7) & 1 for b in _bloom_bits(key, self.bits).tolist()):
            return []
        found, k = [], bisect_right([x[0] for x in self.index], key) - 1
        # Equal keys may have begun in blocks before the last one that starts with this key.
        while k > 0 and self.index[k][0] == key:
            k -= 1
        for k in range(max(k, 0), len(self.index)):
            if self.index[k][0] > key:
                break
            found += [v for q, v in self.block(k) if q == key]
        return found


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_shards(docs: DataFrame, path: str, end: int = 2, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, partitions: int | None = None) -> DataFrame:
    """Encode ``docs`` and write shards below ``path``; returns the manifest ``(shard, file, entries, ids)``, already written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, writer, out = Encoder(vocabulary_path(vocabulary)), TaskContext.get().partitionId(), None, None
        store, base = _open(path)
        name, mine = f"shard-{shard:06d}.sst", f"{base}/.shard-{shard:06d}-{TaskContext.get().taskAttemptId()}"
        for batch in batches:
            for part in bounded(batch, 1, 2500):
                if writer is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(mine)
                    writer = Writer(out)
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1), end)):
                    writer.add(key_of(doc), ids)
        if writer is None:
            return
        writer.finish()
        out.close()
        store.move(mine, f"{base}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([name]), pa.array([len(writer.keys)]), pa.array([writer.ids])], names=["shard", "file", "entries", "ids"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # By text as well, so that rows without an id, or with one that repeats, are several shards; rows alike in both may go anywhere.
    order = ["doc_id", F.xxhash64("text"), F.rand(5)]
    dealt = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    return written(dealt.sortWithinPartitions("doc_id", F.xxhash64("text")).mapInArrow(run, "shard long, file string, entries long, ids long"), "sst-manifest")


def read_shards(manifest: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Every document of the shards: ``(doc_id, start, n_tokens, ids_crc32[, ids])``, start counted over all shards in order."""
    from pyspark.sql import Window

    # One row per shard, not per document: a window over it is small at any input size.
    at = manifest.select("shard", "file", (F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("ids")).alias("before"))
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(path)

        def made(rows: list[tuple]) -> pa.RecordBatch:
            cols = [pa.array(c, pa.list_(pa.int64()) if k == 4 else pa.int64()) for k, c in enumerate(zip(*rows))]
            return pa.RecordBatch.from_arrays(cols, names=names)

        for batch in batches:
            for file, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist()):
                with store.open_input_file(f"{base}/{file}") as src:
                    rows = []
                    for key, ids in Reader(src).scan():
                        rows.append((id_of(key), before, len(ids), zlib.crc32(ids)) + ((ids.tolist(),) if with_ids else ()))
                        before += len(ids)
                        if len(rows) == 4000:
                            yield made(rows)
                            rows = []
                    if rows:
                        yield made(rows)

    # One shard a task: ranges of the shard's number cut the manifest into as many parts as it has rows.
    return at.repartitionByRange(max(1, manifest.count()), "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def lookup(path: str, manifest_rows: list, doc_id: int | None) -> list[np.ndarray]:
    """Ids of one document, from the shards named by rows of the manifest; each says by its filter and index whether it has it."""
    store, base = _open(path)
    found = []
    for row in manifest_rows:
        with store.open_input_file(f"{base}/{row['file']}") as src:
            found += Reader(src).get(doc_id)
    return found


def round_trip(spark: SparkSession, docs: DataFrame, end: int = 2, vocabulary: str | None = None, path: str | None = None) -> DataFrame:
    """Write ``docs`` as shards and read every document back from the files."""
    path = path or new_path(spark, "sst")
    return read_shards(write_shards(docs, path, end, vocabulary=vocabulary), path)
