"""Vectorised text kernels shared by the operators of this subpackage.

Everything works on whole Arrow string columns: the UTF-8 bytes of a batch are one numpy array,
words are found with array comparisons and hashed in blocks of 8 bytes, all words in step, so no Python code
runs per word of usual length. A null text is an empty text.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib

import numpy as np
import pyarrow as pa

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Of a block of 8 bytes, the low ones that belong to a span that ends within it.
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], np.uint64)
_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
#: Spans beyond so many bytes are hashed by BLAKE2, one by one.
_LONG = 128
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[ord(c) for c in '.,;:!?()[]{}<>/"']] = True
#: Last bytes that a white-space character beyond ASCII can end with.
_WIDE_SPACE_END = np.zeros(256, bool)
_WIDE_SPACE_END[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(table: pa.RecordBatch, text: str, limit: int = 1 << 20):
    """Cuts a batch so that each part holds about `limit` bytes of text, or one row."""
    column = table.column(text)
    sizes = np.diff(text_bytes(column)[1]) if len(column) else np.zeros(0, np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > limit:
            yield table.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(column):
        yield table.slice(start)


def spans_of_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes other than ASCII white space within each text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | first[1:n]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | first[1:n]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def is_space(data: np.ndarray) -> np.ndarray:
    """Which bytes are ASCII white space."""
    return _SPACE[data]


def may_end_in_space(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the last character before each end is, or may be, white space of any kind."""
    last = data[ends - 1]
    lead2 = data[np.maximum(ends - 2, 0)] == 0xC2
    lead3 = np.isin(data[np.maximum(ends - 3, 0)], (0xE1, 0xE2, 0xE3))
    return _SPACE[last] | (_WIDE_SPACE_END[last] & (lead2 | lead3))


def spans_of_chunks(data: np.ndarray, offsets: np.ndarray, keep_space: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Cuts each text where any of the byte-pair tokenizers' patterns must cut too.

    That is where ASCII white space follows a character that is no white space at all, and where ASCII
    punctuation (no apostrophe) follows an ASCII letter or digit. Where the character before may be white space
    beyond ASCII, nothing is cut: a longer chunk is as right. Without keep_space, chunks lose the white space in front.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = _SPACE[data]
    cut = np.zeros(n, bool)
    cut[1:] = space[1:] & ~space[:-1]
    doubt = np.flatnonzero(cut)
    cut[doubt[may_end_in_space(data, doubt)]] = False
    cut[1:] |= _PUNCT[data[1:]] & _ALNUM[data[:-1]]
    cut[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], n)
    if not keep_space:
        solid = np.append(np.flatnonzero(~space), n)
        starts = solid[np.searchsorted(solid, starts)]
        kept = starts < ends
        starts, ends = starts[kept], ends[kept]
    return starts, ends


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: its length, then blocks of 8 bytes, each through a non-linear mix."""
    if lower:
        data = _LOWER[data]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    blocks = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    width, seed = ends - starts, _SEEDS[which]
    out = mix(width.astype(np.uint64) * seed + seed)
    active, done = np.flatnonzero((width > 0) & (width <= _LONG)), 0
    while len(active):
        left = width[active] - done
        out[active] = mix((out[active] ^ (blocks[starts[active] + done] & _KEEP[np.minimum(left, 8)])) * seed)
        done += 8
        active = active[left > 8]
    long = np.flatnonzero(width > _LONG)
    if len(long):
        raw = data.tobytes()
        out[long] = [int.from_bytes(hashlib.blake2b(raw[a:b], digest_size=8, salt=bytes([which])).digest(), "little") for a, b in zip(starts[long].tolist(), ends[long].tolist())]
    return out


def owners(offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Counts of spans in each text."""
    return np.diff(np.searchsorted(starts, offsets))


def gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs pool[start : start + length], one after another."""
    total = int(lengths.sum())
    if not total:
        return pool[:0]
    at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return pool[at + np.arange(total)]


def tidy(run):
    """run, a function of batches, with the worker's free memory given back when it ends: workers stay, and wait beside other stages."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # a C library without it
                ctypes.CDLL(None).malloc_trim(0)

    return tidied


def shared_dir(spark, name: str) -> str:
    """A new folder, as a URI, in the folder that driver and executors share.

    The cluster names it in spark.checkpoint.dir; only where that is unset, as in tests on one machine, a
    temporary folder is made and set.
    """
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='wattspark-')}"
        spark.sparkContext.setCheckpointDir(base)
    if "://" not in base and not base.startswith("file:"):
        base = f"file://{base}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df, spark, name: str):
    """Writes df as Parquet in the shared folder and reads it again: lineage ends, and lost executors lose nothing."""
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """The pyarrow file system of a URI and the path in it; works for local, HDFS and object stores."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def text_or_empty(df, column: str = "text"):
    from pyspark.sql import functions as F

    return F.coalesce(df[column], F.lit(""))
