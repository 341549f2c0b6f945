"""Token ids in sorted-string-table shards: prefix-compressed blocks, sparse block index, Bloom filter, footer.

A shard holds documents in ascending key order. All numbers are little-endian.

    data blocks   zstd frames; inside, per entry: u16 bytes shared with the key before, u16 bytes of the key's rest,
                  u32 bytes of the value, the key's rest, the value (ids as u16 or u32). The first key is whole.
    index block   per data block: u16 length and bytes of its last key, u64 offset, u32 length, u32 entries
    filter block  u32 number of hashes, then the Bloom filter's bits
    footer        FOOTER: offsets and lengths of index and filter, entries, ids, bytes of an id, magic

The key of a document is a byte 1 and its identifier as a big-endian uint64 with the sign bit flipped, which sorts as
the identifiers do; a null identifier is the single byte 0 and comes first.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import scratch, slices, tidied, written
from .units import CAP, SLICE, ByteEncoder, kept

ENTRY, PLACE, FOOTER, MAGIC = struct.Struct("<HHI"), struct.Struct("<QII"), struct.Struct("<QQQQQQII"), 0x31545350
BLOCK_BYTES, BITS_PER_KEY, HASHES = 1 << 18, 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + ((doc_id + (1 << 63)) & (2**64 - 1)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key == b"\x00" else int.from_bytes(key[1:], "big") - (1 << 63)


def _bits(key: bytes, n_bits: int) -> list[int]:
    a, b = xxhash.xxh3_64_intdigest(key), xxhash.xxh3_64_intdigest(key, 7) | 1
    return [(a + i * b) % n_bits for i in range(HASHES)]


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


class ShardWriter:
    """Writes one shard as a stream; holds one block, the index and 16 bytes a key."""

    def __init__(self, out, id_bytes: int) -> None:
        self.out, self.id_bytes, self.at, self.index, self.hashes = out, id_bytes, 0, [], []
        self.block, self.size, self.last, self.entries, self.total, self.ids, self.first = [], 0, b"", 0, 0, 0, None
        self.zip = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.entries:
            if key < self.last:
                raise ValueError("keys must come in ascending order")
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        elif self.first is None:
            self.first = key
        rest = key[shared:]
        self.block += [ENTRY.pack(shared, len(rest), len(value)), rest, value]
        self.size += ENTRY.size + len(rest) + len(value)
        self.last, self.entries = key, self.entries + 1
        self.hashes.append(key)
        self.ids += len(value) // self.id_bytes
        if self.size >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.entries:
            data = self.zip.compress(b"".join(self.block))
            self.index.append((self.last, self.at, len(data), self.entries))
            self.out.write(data)
            self.at += len(data)
            self.total += self.entries
            self.block, self.size, self.entries = [], 0, 0

    def close(self) -> None:
        self._flush()
        index = b"".join(struct.pack("<H", len(k)) + k + PLACE.pack(at, n, e) for k, at, n, e in self.index)
        n_bits = max(64, BITS_PER_KEY * len(self.hashes) + 7 & ~7)
        bits = np.zeros(n_bits, np.uint8)
        for key in self.hashes:
            bits[_bits(key, n_bits)] = 1
        bloom = struct.pack("<I", HASHES) + np.packbits(bits).tobytes()
        self.out.write(index + bloom + FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.total, self.ids, self.id_bytes, MAGIC))


class ShardReader:
    """Reads a shard: footer, index and filter at once, data blocks as they are needed."""

    def __init__(self, source: pa.NativeFile) -> None:
        self.source, size = source, source.size()
        index_at, index_len, bloom_at, bloom_len, self.total, self.n_ids, self.id_bytes, magic = FOOTER.unpack(source.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        raw, at, self.index = source.read_at(index_len, index_at), 0, []
        while at < len(raw):
            (n,) = struct.unpack_from("<H", raw, at)
            self.index.append((raw[at + 2 : at + 2 + n], *PLACE.unpack_from(raw, at + 2 + n)))
            at += 2 + n + PLACE.size
        self.lasts = [x[0] for x in self.index]
        self.bits = np.unpackbits(np.frombuffer(source.read_at(bloom_len, bloom_at)[4:], np.uint8))
        self.dtype, self.zip = np.dtype(f"<u{self.id_bytes}"), zstandard.ZstdDecompressor()

    def block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, n, _ = self.index[k]
        raw, at, key = self.zip.decompress(self.source.read_at(n, at)), 0, b""
        while at < len(raw):
            shared, rest, size = ENTRY.unpack_from(raw, at)
            at += ENTRY.size
            key = key[:shared] + raw[at : at + rest]
            yield key, np.frombuffer(raw, self.dtype, size // self.id_bytes, at + rest)
            at += rest + size

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.index)):
            yield from self.block(k)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document of that identifier: Bloom filter, then binary search of the sparse index."""
        key = key_of(doc_id)
        if not self.bits[_bits(key, len(self.bits))].all():
            return []
        found = []
        for k in range(bisect_left(self.lasts, key), len(self.index)):
            held = list(self.block(k))
            found += [ids for other, ids in held if other == key]
            if held[-1][0] > key:
                break
        return found


def write_shards(docs: DataFrame, vocabulary: str, uri: str, end_id: int = 0) -> DataFrame:
    """Write (doc_id, text) as shards under `uri`; a row per shard: path, first_doc_id, last_doc_id, n_docs, n_ids.

    Rows are dealt by ranges of doc_id (those of one doc_id by a hash of the text, so that many repeats are split), so shards in order of their first key hold all documents in order. A shard's name is
    new for every attempt of a task and only those in the returned manifest count, so a lost executor or a second
    attempt leaves no wrong file in use. The manifest is written to the shared folder: shards are written once.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out, writer = kept(ByteEncoder, vocabulary, CAP, end_id), None, None
        system, root = file_system(uri)
        path = f"{root}/{uuid.uuid4().hex}.sst"
        wide = encoder.dtype.itemsize
        for part in slices(batches, "text", SLICE):
            if writer is None:
                system.create_dir(root, recursive=True)
                out = system.open_output_stream(path)
                writer = ShardWriter(out, wide)
            flat, lengths = encoder.stream(part.column("text"))
            raw, ends = flat.tobytes(), np.cumsum(lengths) * wide
            for doc_id, end, n in zip(part.column("doc_id").to_pylist(), ends.tolist(), (lengths * wide).tolist(), strict=True):
                writer.add(key_of(doc_id), raw[end - n : end])
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "first_doc_id": pa.array([id_of(writer.first)], pa.int64()), "last_doc_id": pa.array([id_of(writer.last)], pa.int64()), "n_docs": pa.array([writer.total], pa.int64()), "n_ids": pa.array([writer.ids], pa.int64())})

    dealt = docs.select(docs["doc_id"].cast("long"), docs["text"]).repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id")
    return written(dealt.mapInArrow(tidied(write), "path string, first_doc_id long, last_doc_id long, n_docs long, n_ids long"), "sst-manifest")


def read_shards(spark: SparkSession, manifest: DataFrame, uri: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files; one task a few shards."""
    order = Window.orderBy(F.col("first_doc_id").asc_nulls_first(), F.col("last_doc_id").asc_nulls_first(), "path")
    placed = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(uri)
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                rows: list[tuple] = []
                with system.open_input_file(path) as source:
                    for key, ids in ShardReader(source):
                        rows.append((id_of(key), before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        before += len(ids)
                for k in range(0, len(rows), 1 << 16):
                    columns = zip(*rows[k : k + (1 << 16)], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = max(1, manifest.count())
    return placed.select("path", "before").repartition(min(shards, 1 << 16), "path").mapInArrow(tidied(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_shards(docs: DataFrame, vocabulary: str, end_id: int = 0) -> DataFrame:
    """Write `docs` (doc_id, text) as shards and read them back: doc_id, start, n_tokens (with the end id), ids_crc32.

    A null text is empty and yields the end id alone. A null doc_id sorts first; rows of equal doc_id are kept, in any
    order among themselves; an empty table gives no rows; other columns are ignored. The shuffle carries each text
    once; a task holds a slice of texts, a block, and 16 bytes a key.
    """
    uri = scratch(docs.sparkSession, "sst")
    return read_shards(docs.sparkSession, write_shards(docs, vocabulary, uri, end_id), uri)
