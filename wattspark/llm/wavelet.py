"""Token-ID / binary output: one succinct wavelet-matrix file per shard of token ids.

A shard holds the ids of consecutive documents, in ascending order of document id. The matrix stores one bit-plane
for each bit of an id, highest bit first; within a plane, ids stand in the stable order that the planes above made.
Planes are cut into blocks of 2^15 bits that are compressed one by one, each with the count of ones before it, so that
access, rank and select inflate one block a plane.

File: 8 bytes magic, 8 bytes length of a JSON head, the head, document ids (int64), document ends (int64), a bit for each document whose
id is not null (only where some are), then the blocks. The head names the number of ids, the bits, and for each plane its
zeros, block offsets and counts of ones.

Nulls: a null text is empty and gives a document of the end id only; a null document id sorts first and is kept. Repeated
rows stay rows of their own, in any order. An empty table gives no shard and no rows. Other columns are not read.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard

from . import textkit as K
from . import tokens as TK

MAGIC = b"WVMATRX2"
BLOCK = 1 << 15
#: Ids after which a task begins another shard; what a task holds at once is about this, or one document.
SHARD_IDS = 2_000_000
SHARD_SCHEMA = "part int, serial int, path string, n_docs long, n_ids long, n_bytes long"
ROW_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def build(ids: np.ndarray, doc_ids: np.ndarray, ends: np.ndarray, valid: np.ndarray | None = None) -> bytes:
    """The file of a shard. ids: all ids in a row; ends: where each document ends in them; valid: which document ids are not null."""
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    current, planes, blocks, size = ids.astype(np.uint16 if bits <= 16 else np.uint32), [], [], 0
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for level in range(bits - 1, -1, -1):
        ones = (current & current.dtype.type(1 << level)) != 0
        packed = np.packbits(ones, bitorder="little")
        counts = np.zeros(-(-len(packed) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
        counts[: len(packed)] = packed
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(counts.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.int64))])
        raw, at = packed.tobytes(), [size]
        for k in range(0, len(raw), BLOCK // 8):
            block = squeeze(raw[k : k + BLOCK // 8])
            blocks.append(block)
            size += len(block)
            at.append(size)
        planes.append({"zeros": int(len(ones) - before[-1]), "at": at, "ones": before.tolist()})
        if level:
            current = np.concatenate([current[np.flatnonzero(~ones)], current[np.flatnonzero(ones)]])
    some = b"" if valid is None or valid.all() else np.packbits(valid, bitorder="little").tobytes()
    head = json.dumps({"n": len(ids), "bits": bits, "docs": len(doc_ids), "valid": len(some), "planes": planes}).encode()
    return b"".join([MAGIC, struct.pack("<Q", len(head)), head, doc_ids.astype("<i8").tobytes(), ends.astype("<i8").tobytes(), some, *blocks])


class WaveletMatrix:
    """Reads a shard's file: access, rank, select, occurrences, and all ids at once."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("no wavelet-matrix file")
        n = struct.unpack("<Q", raw[8:16])[0]
        self.head = json.loads(raw[16 : 16 + n])
        self.n, self.bits, docs = self.head["n"], self.head["bits"], self.head["docs"]
        at = 16 + n
        self.doc_ids = np.frombuffer(raw, "<i8", docs, at)
        self.ends = np.frombuffer(raw, "<i8", docs, at + 8 * docs)
        some = self.head["valid"]
        self.valid = np.unpackbits(np.frombuffer(raw, np.uint8, some, at + 16 * docs), count=docs, bitorder="little").astype(bool) if some else np.ones(docs, bool)
        self.raw, self.base, self.planes = raw, at + 16 * docs + some, self.head["planes"]
        self.inflate = zstandard.ZstdDecompressor().decompress

    def _block(self, level: int, k: int) -> np.ndarray:
        a, b = self.planes[level]["at"][k : k + 2]
        return np.unpackbits(np.frombuffer(self.inflate(self.raw[self.base + a : self.base + b]), np.uint8), bitorder="little")

    def _rank1(self, level: int, i: int) -> int:
        """Ones before position i of a plane."""
        k = i // BLOCK
        ones = self.planes[level]["ones"]
        return ones[k] + (int(self._block(level, k)[: i - k * BLOCK].sum()) if i > k * BLOCK else 0)

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(self.bits):
            bit = int(self._block(level, i // BLOCK)[i % BLOCK])
            ones = self._rank1(level, i)
            i = self.planes[level]["zeros"] + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def _walk(self, token: int, i: int) -> tuple[int, int]:
        """(start of the token's run in the order below the last plane, end of its part from positions before i)."""
        a, b = 0, i
        for level in range(self.bits):
            bit = token >> (self.bits - 1 - level) & 1
            ra, rb = self._rank1(level, a), self._rank1(level, b)
            z = self.planes[level]["zeros"]
            a, b = (z + ra, z + rb) if bit else (a - ra, b - rb)
        return a, b

    def rank(self, token: int, i: int | None = None) -> int:
        """Occurrences of a token before position i; in the whole shard without i."""
        if token >> self.bits:
            return 0
        a, b = self._walk(token, self.n if i is None else i)
        return b - a

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit of this value in a plane."""
        ones = np.array(self.planes[level]["ones"], np.int64)
        before = ones if bit else np.minimum(np.arange(len(ones)) * BLOCK, self.n) - ones
        b = int(np.searchsorted(before, k, "right")) - 1
        width = min(BLOCK, self.n - b * BLOCK)
        return b * BLOCK + int(np.flatnonzero(self._block(level, b)[:width] == bit)[k - before[b]])

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of a token."""
        if not 0 <= k < self.rank(token):
            raise IndexError(k)
        i = self._walk(token, self.n)[0] + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            i = self._select_bit(level, bit, i - self.planes[level]["zeros"] if bit else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.rank(token))]

    def ids(self) -> np.ndarray:
        """All ids, plane by plane from the lowest up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        current = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            plane = self.planes[level]
            packed = b"".join(self.inflate(self.raw[self.base + a : self.base + b]) for a, b in zip(plane["at"], plane["at"][1:]))
            ones = np.unpackbits(np.frombuffer(packed, np.uint8), count=self.n, bitorder="little").view(bool)
            zeros, above = plane["zeros"], np.empty(self.n, kind)
            above[np.flatnonzero(~ones)] = current[:zeros]
            above[np.flatnonzero(ones)] = current[zeros:] | kind(1 << (self.bits - 1 - level))
            current = above
        return current.astype(np.uint32)


def write_shards(docs, spark, folder: str, path: str, keep_space: bool, lower: bool, end: int = TK.END_ID, shard_ids: int = SHARD_IDS):
    """Writes each range of document ids as files of about shard_ids ids, or one document; returns their manifest, a saved DataFrame of SHARD_SCHEMA."""

    def write(batches):
        from pyspark import TaskContext

        part, serial = TaskContext.get().partitionId(), 0
        encoder = TK.encoder(path, keep_space, lower)
        fs, at = K.filesystem(folder)
        fs.create_dir(at, recursive=True)
        held: list[tuple[np.ndarray, ...]] = []

        def flush():
            nonlocal serial
            ids, doc_ids, valid, counts = (np.concatenate(x) for x in zip(*held))
            held.clear()
            raw = build(ids, doc_ids, np.cumsum(counts), valid)
            name = f"shard-{part:06d}-{serial:06d}-{TaskContext.get().taskAttemptId()}.wvm"  # an attempt that fails leaves no name that counts
            with fs.open_output_stream(f"{at}/{name}") as f:
                f.write(raw)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "serial": pa.array([serial], pa.int32()), "path": [f"{folder}/{name}"], "n_docs": [len(doc_ids)], "n_ids": [len(ids)], "n_bytes": [len(raw)]})
            serial += 1

        size = 0
        for batch in batches:
            for rows in K.slices(batch, "text"):
                ids, offsets = encoder.documents(rows.column("text"), end)
                own = rows.column("doc_id")
                held.append((ids, own.fill_null(0).to_numpy(), own.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets)))
                size += len(ids)
                if size >= shard_ids:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return K.saved(ordered.mapInArrow(K.tidy(write), SHARD_SCHEMA), spark, "wavelet-manifest")


def read_documents(manifest):
    """A row a document from the shards' files, with the place of its first id in the whole order."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    def read(batches):
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
                fs, at = K.filesystem(path)
                with fs.open_input_stream(at) as f:
                    shard = WaveletMatrix(f.read())
                raw, ends = shard.ids().astype("<u4").tobytes(), shard.ends
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(shard.doc_ids, pa.int64(), mask=~shard.valid), "start": pa.array(starts + before), "n_tokens": pa.array(ends - starts), "ids_crc32": pa.array(crc, pa.int64())})

    # What comes before a range is a sum over ranges, as few as there are tasks; what comes before a shard, one within its range.
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    ranges = manifest.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", F.sum("n_ids").over(earlier.orderBy("part")).alias("outer"))
    placed = manifest.select("part", "path", F.sum("n_ids").over(earlier.partitionBy("part").orderBy("serial")).alias("inner")).join(ranges, "part")
    before = F.coalesce("outer", F.lit(0)) + F.coalesce("inner", F.lit(0))
    spread = max(1, min(manifest.count(), 4 * int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return placed.select("path", before.alias("before")).repartition(spread).mapInArrow(K.tidy(read), ROW_SCHEMA)


def op5_wavelet_shards(spark, sf_dir):
    """Per document of `documents`: start, n_tokens and ids_crc32, read back from the shards' files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = K.shared_dir(spark, "wavelet")
    manifest = write_shards(docs, spark, folder, TK.tokenizer_path("word_bpe_49k.json"), keep_space=False, lower=True)
    return read_documents(manifest)
