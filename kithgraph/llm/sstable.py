"""Token ids in sorted-string-table shards: write, look up by binary search, scan.

A shard holds the documents of one range of doc_id in ascending order. Its file:

* blocks of about 64 KiB; an entry is (bytes shared with the key before, length of the rest of the
  key, length of the value, rest of the key, value); the first key of a block shares nothing;
* a sparse index with a row for each block: its first key, place, length, checksum, entries and the
  number of ids before it in the shard;
* a Bloom filter over the keys;
* a footer of fixed size with the places of index and filter, the counts and a magic number.

Keys are doc_id as 8 big-endian bytes with the sign bit turned, so that bytes sort as numbers; a null
doc_id is the empty key and sorts first. Values are little-endian ids, 2 bytes each where the
vocabulary allows it.

Tasks write under names of their own and report them in a manifest that Spark commits, so a task that
runs twice leaves a file that nothing refers to. Files go through pyarrow's file systems (local or
mounted folders, HDFS, S3, GCS).

Defined cases: null text has only the end id; repeated rows and repeated doc_ids are entries of their
own, in the order of their texts; an empty table gives no shards; other columns are not read.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kithgraph.llm.common import shared_dir, table, written
from kithgraph.llm.token_ids import encoder, vocabulary
from kithgraph.storage import qualified

BLOCK = 64 << 10
#: Bytes of entries at which a file ends, so that files, and the keys that a writer keeps for the filter, don't grow with the corpus.
SHARD = 256 << 20
MAGIC = 0x4B47535354303031
END_ID = 0
BITS_PER_KEY, PROBES = 10, 7
_ENTRY, _INDEX, _FOOTER = struct.Struct("<BBI"), struct.Struct("<BQIIIQ"), struct.Struct("<QQQQQQBQ")


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - (1 << 63) if key else None


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = xxhash.xxh64_intdigest(key, 0), xxhash.xxh64_intdigest(key, 1) | 1
    return [(a + i * b) % bits for i in range(PROBES)]


def _file_system(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _covering(first: list[bytes], key: bytes) -> range:
    """Numbers of the blocks or files, given by their first keys in order, that may hold this key; more than one where its entries go on."""
    return range(max(0, bisect.bisect_left(first, key) - 1), bisect.bisect_right(first, key))


class Writer:
    """Appends entries in ascending key order to one file."""

    def __init__(self, uri: str, width: int):
        system, path = _file_system(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.width, self.at = system.open_output_stream(path), width, 0
        self.block, self.index, self.keys, self.ids = bytearray(), [], [], 0
        self.first, self.last, self.entries, self.before = b"", b"", 0, 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if not self.entries:
            self.first, self.last, self.before = key, b"", self.ids
        shared = next((i for i, (x, y) in enumerate(zip(key, self.last, strict=False)) if x != y), min(len(key), len(self.last)))
        value = ids.astype(f"<u{self.width}", copy=False).tobytes()
        self.block += _ENTRY.pack(shared, len(key) - shared, len(value)) + key[shared:] + value
        self.keys.append(key)
        self.last, self.entries, self.ids = key, self.entries + 1, self.ids + len(ids)
        if len(self.block) >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.entries:
            self.index.append(_INDEX.pack(len(self.first), self.at, len(self.block), zlib.crc32(self.block), self.entries, self.before) + self.first)
            self.out.write(bytes(self.block))
            self.at, self.entries = self.at + len(self.block), 0
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        bits = max(64, BITS_PER_KEY * len(self.keys))
        bloom = np.zeros(bits, bool)
        for key in self.keys:
            bloom[_probes(key, bits)] = True
        index, bloom = b"".join(self.index), np.packbits(bloom).tobytes()
        footer = _FOOTER.pack(self.at, len(index), len(self.index), bits, len(self.keys), self.ids, self.width, MAGIC)
        self.out.write(index + bloom + footer)
        self.out.close()


class Reader:
    """Looks documents up in one file, or scans it; reads footer, filter, index and the blocks it needs."""

    def __init__(self, uri: str):
        system, path = _file_system(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        at, index, blocks, self.bits, self.entries, self.ids, self.width, magic = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a shard, or it is cut short")
        tail = self.file.read_at(size - _FOOTER.size - at, at)
        self.bloom, self.blocks, place = tail[index:], [], 0
        for _ in range(blocks):
            head = _INDEX.unpack_from(tail, place)
            place += _INDEX.size
            self.blocks.append((tail[place : place + head[0]], *head[1:]))
            place += head[0]
        self.first = [b[0] for b in self.blocks]

    def _entries(self, number: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, length, checksum, entries, _ = self.blocks[number]
        block, key, place = self.file.read_at(length, at), b"", 0
        if zlib.crc32(block) != checksum:
            raise ValueError(f"block {number} is damaged")
        for _ in range(entries):
            shared, rest, size = _ENTRY.unpack_from(block, place)
            place += _ENTRY.size
            key = key[:shared] + block[place : place + rest]
            yield key, np.frombuffer(block, f"<u{self.width}", size // self.width, place + rest)
            place += rest + size

    def scan(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, number of ids before it in the shard, ids."""
        for number, block in enumerate(self.blocks):
            before = block[5]
            for key, ids in self._entries(number):
                yield id_of(key), before, ids
                before += len(ids)

    def find(self, doc_id: int | None) -> Iterator[tuple[int, np.ndarray]]:
        """Number of ids before it in the shard, and ids, of every entry of this document; no block is read if the filter excludes it."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in _probes(key, self.bits)):
            return
        for number in _covering(self.first, key):
            before = self.blocks[number][5]
            for k, ids in self._entries(number):
                if k == key:
                    yield before, ids
                before += len(ids)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry of this document."""
        return [ids for _, ids in self.find(doc_id)]


def write(docs: DataFrame, directory: str, tokenizer: str | None = None, end_id: int = END_ID, shard: int = SHARD) -> DataFrame:
    """Writes the shards; returns the manifest: path, first_key, docs, ids, base (ids in the shards before). A task's file ends at SHARD bytes and another begins."""
    name, directory = tokenizer or vocabulary(), qualified(docs.sparkSession, directory)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, out, path, part = encoder(name), None, "", 0

        def closed() -> pd.DataFrame:
            out.close()
            return pd.DataFrame({"path": [path], "first_key": [out.keys[0]], "part": [part], "docs": [len(out.keys)], "ids": [out.ids]})

        for rows in batches:
            for key, text in zip(rows["key"], rows["text"], strict=True):
                ids = encode(text)
                if out is None:
                    path = f"{directory}/{uuid.uuid4().hex}.sst"
                    out = Writer(path, ids.itemsize)
                out.add(bytes(key), np.append(ids, np.array(end_id, ids.dtype)))
                if out.at >= shard:
                    yield closed()
                    out, part = None, part + 1
        if out:
            yield closed()

    turned = F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))
    key = F.coalesce(F.to_binary(F.lpad(F.hex(turned), 16, "0"), F.lit("hex")), F.lit(b""))
    ranges = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = written(ranges.select(key.alias("key"), "text").mapInPandas(run, "path string, first_key binary, part long, docs long, ids long"), "sst-manifest")
    before = W.orderBy("first_key", "part").rowsBetween(W.unboundedPreceding, -1)  # a row for each shard
    return manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0))).drop("part")


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, ids (binary, little-endian unsigned 32-bit) of every document in the shards."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for path, base in zip(rows["path"], rows["base"], strict=True):
                found, held = [], 0
                for doc_id, before, ids in Reader(path).scan():
                    found.append((doc_id, base + before, ids.astype("<u4").tobytes()))
                    held += len(found[-1][2])
                    if held > 16 << 20:
                        yield frame(found)
                        found, held = [], 0
                yield frame(found)

    def frame(found):
        doc_id, start, ids = zip(*found, strict=True) if found else ((), (), ())
        return pd.DataFrame({"doc_id": pd.array(doc_id, "Int64"), "start": np.array(start, np.int64), "ids": list(ids)})

    spread = manifest.select("path", "base").repartition(max(1, manifest.count()))
    return spread.mapInPandas(run, "doc_id long, start long, ids binary")


def look_up(manifest: DataFrame, wanted: DataFrame, column: str = "doc_id") -> DataFrame:
    """doc_id, start, ids as ``read`` gives them, of the documents whose ids stand in this column of ``wanted`` only.

    An id is wanted once however often it stands there, null among them; an id without document gives no row, one
    with several a row for each. Ids go to the files whose key ranges hold them, and a file is opened by one task, which
    reads its footer, filter and index, and then only blocks that may hold a wanted id. Tasks get the files' first
    keys and paths: a row for each 256 MB of ids, or for each task that wrote.
    """
    spark = manifest.sparkSession
    files = manifest.orderBy("base").select("first_key", "path", "base").collect()
    shared = spark.sparkContext.broadcast(([bytes(f.first_key) for f in files], [f.path for f in files], [f.base for f in files]))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = shared.value[0]
        for batch in batches:
            pairs = [(i, k) for i in batch.column("doc_id").to_pylist() for k in _covering(first, key_of(i))]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([i for i, _ in pairs], pa.int64()), "file": pa.array([k for _, k in pairs], pa.int32())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, paths, bases = shared.value
        reader, opened = None, None
        for batch in batches:
            found, held = [], 0
            for doc_id, number in zip(batch.column("doc_id").to_pylist(), batch.column("file").to_pylist(), strict=True):
                if number != opened:
                    reader, opened = Reader(paths[number]), number
                for before, ids in reader.find(doc_id):
                    found.append((doc_id, bases[number] + before, ids.astype("<u4").tobytes()))
                    held += len(found[-1][2])
                    if held > 16 << 20:
                        yield rows(found)
                        found, held = [], 0
            yield rows(found)

    def rows(found) -> pa.RecordBatch:
        kinds = {"doc_id": pa.int64(), "start": pa.int64(), "ids": pa.binary()}
        return pa.RecordBatch.from_pydict({c: pa.array([f[i] for f in found], kind) for i, (c, kind) in enumerate(kinds.items())})

    dealt = wanted.select(F.col(column).cast("long").alias("doc_id")).distinct().mapInArrow(deal, "doc_id long, file int")
    return dealt.repartition("file").sortWithinPartitions("file", "doc_id").mapInArrow(run, "doc_id long, start long, ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(write(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/sst-{uuid.uuid4().hex}"))
    return found.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
