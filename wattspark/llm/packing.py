"""Packing: vector bin packing of training examples by the dot-product heuristic.

An example has a vector (tokens, segments = 1, loss-bearing tokens). A sequence has a capacity in each dimension. A
sequence is filled by the example whose vector has the largest dot product with what is left, both divided by the
capacity; only examples that fit count. When none fits whole and cutting is allowed, the largest example left is cut to
fill the gap. What ends a task, or a sequence that its segment or loss limit closes early, is cut into runs whose lengths
are powers of two, which need no padding. So each task packs its own rows: nothing is shuffled, and a task's surplus
is less than one sequence.

Nulls: a null text is an empty text (one end id). Empty table: no rows. Equal and repeated rows are separate examples; ties in the
dot product go to the earlier example. Texts of any length are cut into full sequences first.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from . import textkit as K
from . import tokens as TK

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


@dataclass(frozen=True)
class Limits:
    """tokens, segments and loss-bearing tokens of a sequence; window: examples considered at once; cut: may examples be cut."""

    tokens: int = 2048
    segments: int = 128
    loss: int = 2048
    window: int = 1024
    cut: bool = True


def fill(length: np.ndarray, loss: np.ndarray, limits: Limits) -> list[list[tuple[int, int, int]]]:
    """Sequences of (example, start, length) pieces.

    loss: of each example, the loss-bearing tokens, which stand at its end (a prompt comes first). Without cut, an
    example beyond a limit by itself raises ValueError.
    """
    n = len(length)
    if not limits.cut and n and (length.max() > limits.tokens or loss.max() > limits.loss):
        raise ValueError("an example exceeds the limits and may not be cut")
    at = np.zeros(n, np.int64)  # of each example, what is placed already
    left = length.astype(np.int64).copy()
    lossy = loss.astype(np.int64).copy()
    done: list[list[tuple[int, int, int]]] = []
    # Full sequences of long examples come first, as far as the loss limit lets them be full.
    if limits.cut:
        for i in np.flatnonzero((left > limits.tokens) | (lossy > limits.loss)):
            while left[i] > limits.tokens or lossy[i] > limits.loss:
                free = left[i] - lossy[i]
                size = int(min(limits.tokens, free + limits.loss, left[i]))
                done.append([(int(i), int(at[i]), size)])
                at[i] += size
                left[i] -= size
                lossy[i] -= max(0, size - free)
    cap = np.array([limits.tokens, limits.segments, limits.loss], float)
    order = np.flatnonzero(left)
    for items in np.array_split(order, max(1, len(order) // limits.window)):
        size, need = left[items].astype(float), lossy[items].astype(float)
        here = np.ones(len(items), bool)
        while here.any():
            room = cap.copy()
            pieces: list[tuple[int, int, int]] = []
            while here.any() and room[1] >= 1:
                fits = here & (size <= room[0]) & (need <= room[2])
                if fits.any():
                    score = size * (room[0] / cap[0] ** 2) + room[1] / cap[1] ** 2 + need * (room[2] / cap[2] ** 2)
                    k = int(np.argmax(np.where(fits, score, -1.0)))
                    take = int(size[k])
                elif limits.cut and min(room[0], room[2]) >= 1:
                    k = int(np.argmax(np.where(here, size, -1.0)))
                    take = int(min(room[0], size[k] - need[k] + room[2], size[k]))
                else:
                    break
                i = items[k]
                bears = int(max(0, take - (size[k] - need[k])))
                pieces.append((int(i), int(at[i]), take))
                room -= (take, 1, bears)
                at[i] += take
                size[k] -= take
                need[k] -= bears
                here[k] = size[k] > 0
            done.append(pieces)
    return [s for p in done for s in (split_powers(p, limits.tokens) if limits.cut else [p])]


def split_powers(pieces: list[tuple[int, int, int]], tokens: int) -> list[list[tuple[int, int, int]]]:
    """One sequence if it is full, else sequences whose lengths are powers of two."""
    total = sum(p[2] for p in pieces)
    if total == tokens or total & (total - 1) == 0:
        return [pieces]
    out, current, want = [], [], 1 << (total.bit_length() - 1)
    for i, start, length in pieces:
        while length:
            take = min(length, want)
            current.append((i, start, take))
            start, length, total, want = start + take, length - take, total - take, want - take
            if not want:
                out.append(current)
                current, want = [], 1 << (total.bit_length() - 1) if total else 0
    return out


def pack_ids(docs, path: str, keep_space: bool = True, lower: bool = False, limits: Limits = Limits(), end: int = TK.END_ID, rows: int = 4096):
    """Tokenises and packs every row of docs(doc_id, text[, loss_from]); returns a row a piece, of PIECE_SCHEMA.

    loss_from, where docs has it: the first loss-bearing token of an example (null: 0, and beyond the end: none); all are without it.
    """

    def pack(batches):
        from pyspark import TaskContext

        encoder = TK.encoder(path, keep_space, lower)
        serial, base = 0, TaskContext.get().partitionId() << 33
        held: list[tuple] = []

        def flush():
            nonlocal serial, held
            ids, counts, doc_ids = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            valid, free = np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held])
            held = []
            begin = np.cumsum(counts) - counts
            loss = np.maximum(counts - np.maximum(free, 0), 0)
            raw = ids.astype("<u4").tobytes()
            out: dict[str, list] = {k: [] for k in ("row", "start", "length", "crc", "seq", "offset")}
            for pieces in fill(counts, loss, limits):
                offset = 0
                for i, start, length in pieces:
                    a = 4 * int(begin[i] + start)
                    for k, v in zip(out, (i, start, length, zlib.crc32(raw[a : a + 4 * length]), base + serial, offset)):
                        out[k].append(v)
                    offset += length
                serial += 1
            row, start, length = (np.array(out[k], np.int64) for k in ("row", "start", "length"))
            bears = np.clip(start + length - np.maximum(counts - loss, 0)[row], 0, length)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids[row], mask=~valid[row]), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(out["crc"], pa.int64()), "doc_tokens": pa.array(counts[row]), "sequence_id": pa.array(out["seq"], pa.int64()), "offset": pa.array(out["offset"], pa.int64()), "loss_tokens": pa.array(bears)})

        n = size = 0
        for batch in batches:
            for part in K.slices(batch, "text"):
                flat, offsets = encoder.documents(part.column("text"), end)
                doc = part.column("doc_id")
                free = part.column("loss_from").fill_null(0).to_numpy(zero_copy_only=False) if "loss_from" in part.schema.names else np.zeros(len(doc), np.int64)
                held.append((flat, np.diff(offsets), doc.fill_null(0).to_numpy(), doc.is_valid().to_numpy(zero_copy_only=False), free))
                n, size = n + len(doc), size + len(flat)
                if n >= rows or size > 2_000_000:
                    yield from flush()
                    n = size = 0
        if held:
            yield from flush()

    columns = ["doc_id", "text"] + [c for c in ("loss_from",) if c in docs.columns]
    return docs.select(*columns).mapInArrow(K.tidy(pack), PIECE_SCHEMA)


def op4_vector_packing(spark, sf_dir):
    """All documents in sequences of at most 2048 byte-level ids, by piece."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_ids(docs, TK.tokenizer_path("byte_bpe_50k.json"))
