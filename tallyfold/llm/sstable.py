"""Token ids in sorted-string-table shards.

A shard holds documents in ascending doc_id order: data blocks of prefix-compressed
keys with restart points, a sparse index with the last key of each block, a Bloom
filter over the keys, and a footer. `Shard.get` finds a document by binary search.

    block:  entries (shared, unshared, value length as varints; key suffix; value),
            restart offsets (u32 each), their number (u32), crc32 of all before (u32)
    index:  per block: last key (8 bytes), offset (u64), size (u32)
    bloom:  bits; footer: index offset, index entries, bloom offset, bloom bytes,
            documents, ids, probes, bytes an id (u64 each), magic

Rows are dealt by ranges of doc_id, about TASK_BYTES of text a range; each range's task
sorts, encodes and writes shard after shard, of DOCS_PER_SHARD documents or SHARD_BYTES
at most. The list of shards is a table in the shared folder, never collected; where each
shard begins among all ids is a sum over ranges and a window within each range. Shards
are written below that folder under a temporary name and then renamed, so a task that
runs again leaves the same file; they and their list stay there, as they are the output.

Defined cases: a null or empty text is its end id alone; rows without doc_id can't be
keyed and are left out; rows with equal doc_id are neighbours, in order of their texts;
texts of any length are encoded whole, and a document is never parted between shards;
ids that don't fit two bytes are written in four; an empty table gives no shard; other
columns are not read.
"""

import os
import struct
import uuid
import zlib
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfold.llm import common

MAGIC = b"TFSSTv01"
FOOTER = struct.Struct("<8Q8s")
INDEX = np.dtype([("key", ">u8"), ("offset", "<u8"), ("size", "<u4")])
BLOCK_BYTES = 64 * 1024
RESTART = 16
PROBES, BITS_PER_KEY = 7, 10
DOCS_PER_SHARD = 4096
SHARD_BYTES = 64 << 20
TASK_BYTES = 16 << 20
END_ID = 1


def key_of(doc_id: int) -> bytes:
    return (doc_id + (1 << 63)).to_bytes(8, "big")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh64_intdigest(key)
    step = (h >> 32) | 1
    return [(h + i * step) % bits for i in range(PROBES)]


def open_file(path: str, mode: str):
    """A file by path or URI; schemes but file: go through pyarrow's file systems."""
    url = urlparse(path)
    if url.scheme in ("", "file"):
        if "w" in mode:
            os.makedirs(os.path.dirname(url.path), exist_ok=True)
        return open(url.path, mode)
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    if "w" in mode:
        system.create_dir(os.path.dirname(at), recursive=True)
        return system.open_output_stream(at)
    return system.open_input_file(at)


def rename(old: str, new: str) -> None:
    if urlparse(old).scheme in ("", "file"):
        os.replace(urlparse(old).path, urlparse(new).path)
    else:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(old)
        system.move(at, fs.FileSystem.from_uri(new)[1])


class ShardWriter:
    def __init__(self, path: str, id_bytes: int = 2):
        """id_bytes is 2 or 4; add() takes values of that width."""
        self.path, self.temporary = path, f"{path}.{uuid.uuid4().hex}.tmp"
        self.file = open_file(self.temporary, "wb")
        self.id_bytes = id_bytes
        self.at = self.ids = 0
        self.keys: list[bytes] = []
        self.index: list[tuple[int, int, int]] = []
        self._start()

    def _start(self) -> None:
        self.block, self.restarts, self.last, self.entries = bytearray(), [], b"", 0

    def add(self, doc_id: int, value: bytes) -> None:
        key = key_of(doc_id)
        shared = 0
        if self.entries % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            while shared < 8 and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(8 - shared) + _varint(len(value)) + key[shared:] + value
        self.last, self.entries = key, self.entries + 1
        self.keys.append(key)
        self.ids += len(value) // self.id_bytes
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.entries:
            body = bytes(self.block) + np.array([*self.restarts, len(self.restarts)], dtype="<u4").tobytes()
            body += zlib.crc32(body).to_bytes(4, "little")
            self.file.write(body)
            self.index.append((int.from_bytes(self.last, "big"), self.at, len(body)))
            self.at += len(body)
            self._start()

    def close(self) -> None:
        self._flush()
        index = np.array(self.index, dtype=INDEX).tobytes()
        bits = max(64, BITS_PER_KEY * len(self.keys))
        bloom = np.zeros(bits, dtype=np.uint8)
        for key in self.keys:
            bloom[_probes(key, bits)] = 1
        packed = np.packbits(bloom).tobytes()
        self.file.write(index + packed + FOOTER.pack(self.at, len(self.index), self.at + len(index), bits, len(self.keys), self.ids, PROBES, self.id_bytes, MAGIC))
        self.file.close()
        rename(self.temporary, self.path)


class Shard:
    """A shard opened for lookup or for reading through."""

    def __init__(self, path: str):
        self.file = open_file(path, "rb")
        end = self.file.seek(0, 2)
        end = self.file.tell() if end is None else end
        (at, n, bloom_at, self.bits, self.docs, self.ids, _, self.id_bytes, magic) = FOOTER.unpack(self._read(end - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"not a shard: {path}")
        self.index = np.frombuffer(self._read(at, n * INDEX.itemsize), dtype=INDEX)
        self.bloom = self._read(bloom_at, -(-self.bits // 8))

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def _values(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, dtype="<u2" if self.id_bytes == 2 else "<u4")

    def _block(self, k: int) -> tuple[bytes, np.ndarray]:
        body = self._read(int(self.index["offset"][k]), int(self.index["size"][k]))
        if zlib.crc32(body[:-4]) != int.from_bytes(body[-4:], "little"):
            raise ValueError("a block is damaged")
        n = int.from_bytes(body[-8:-4], "little")
        restarts = np.frombuffer(body[-8 - 4 * n : -8], dtype="<u4")
        return body[: -8 - 4 * n], restarts

    @staticmethod
    def _entries(data: bytes, at: int = 0):
        key = b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            unshared, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + unshared]
            at += unshared
            yield key, data[at : at + size]
            at += size

    def __iter__(self):
        for k in range(len(self.index)):
            for key, value in self._entries(self._block(k)[0]):
                yield int.from_bytes(key, "big") - (1 << 63), self._values(value)

    def get(self, doc_id: int) -> np.ndarray | None:
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in _probes(key, self.bits)):
            return None
        k = int(np.searchsorted(self.index["key"].astype(np.uint64), np.uint64(int.from_bytes(key, "big"))))
        if k == len(self.index):
            return None
        data, restarts = self._block(k)
        lo, hi = 0, len(restarts) - 1
        while lo < hi:  # the last restart point whose key is not larger
            mid = (lo + hi + 1) // 2
            if next(self._entries(data, int(restarts[mid])))[0] < key:
                lo = mid
            else:
                hi = mid - 1
        for k2, value in self._entries(data, int(restarts[lo])):
            if k2 >= key:
                return self._values(value) if k2 == key else None
        return None


def id_width(tokenizer: str) -> int:
    """Bytes that any id of the tokenizer fits, the end ids included."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def write_shards(spark: SparkSession, docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, task_bytes: int = TASK_BYTES, per_shard: int = DOCS_PER_SHARD) -> DataFrame:
    """Writes the shards; gives the table of share, shard (in order within the share), file, documents and ids of each."""
    common.prepare(spark)
    width = id_width(tokenizer)

    def write(batches):
        bpe, writer, shard, dtype = common.word_bpe(tokenizer), None, 0, f"<u{width}"

        def done():
            writer.close()
            return pd.DataFrame({"share": [share], "shard": [shard], "file": [writer.path], "docs": [len(writer.keys)], "ids": [writer.ids]})

        for batch in batches:
            for share, doc, ids in zip(batch.share, batch.doc_id, bpe.encode_many(list(batch.text)), strict=True):
                if writer is not None and (len(writer.keys) >= per_shard or writer.at + len(writer.block) >= SHARD_BYTES):
                    yield done()
                    writer, shard = None, shard + 1
                if writer is None:
                    writer = ShardWriter(f"{path}/shard-{int(share):06d}-{shard:06d}.sst", width)
                writer.add(int(doc), np.append(ids, np.uint32(end_id)).astype(dtype).tobytes())
        if writer is not None:
            yield done()

    texts = common.keyed_texts(docs)
    size = texts.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    dealt = texts.repartitionByRange(max(1, -(-size // task_bytes)), "doc_id").sortWithinPartitions("doc_id", "text")
    shards = dealt.withColumn("share", F.spark_partition_id()).mapInPandas(write, "share int, shard int, file string, docs long, ids long")
    return common.saved(spark, shards, "shards-list")[0]


def read_shards(spark: SparkSession, shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files, each shard by itself."""

    def run(batches):
        for batch in batches:
            for file, start in zip(batch.file, batch.before, strict=True):
                rows = []
                for doc, ids in Shard(file):
                    rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])

    # one row a share passes one task, not one a shard or a document
    shares = shards.groupBy("share").agg(F.sum("ids").alias("total"))
    shares = shares.select("share", (F.sum("total").over(Window.orderBy("share")) - F.col("total")).alias("first"))
    within = F.sum("ids").over(Window.partitionBy("share").orderBy("shard")) - F.col("ids")
    placed = shards.join(shares, "share").select("file", (F.col("first") + within).alias("before"))
    tasks = max(1, min(1024, shards.count()))
    return placed.repartition(tasks).mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = write_shards(spark, common.read_table(spark, sf_dir, "documents"), common.shared_dir(spark, "shards"), common.tokenizer_path("word_bpe_49k.json"))
    return read_shards(spark, shards)
