"""Exact token ids of whole Arrow columns at the cost of their distinct words.

The text is cut only where the tokenizer's own pre-tokenizer must cut too, so that the ids of a text are the ids
of its chunks in a row. Each distinct chunk of a batch goes through the tokenizers library once; a bounded
memory of chunks lives as long as the Python worker.

Text that spells a special token is plain text here (encode_special_tokens); the library's default gives the special token's id.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from . import textkit as K

END_ID = 1
_ENCODERS: dict[tuple, "ChunkEncoder"] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkEncoder:
    """keep_space: whether white space before a word is part of its chunk (byte-level tokenizers).

    Known chunks are rows of a table of fixed size, found by either of two places that their 128-bit hash names: the two
    halves of the hash, and the place and number of the ids. A newer chunk takes the place of an older one.
    """

    #: Rows of the table (a power of two), ids held at most before all is forgotten, and bytes of the longest chunk remembered.
    SLOTS, POOL, LONGEST = 1 << 19, 3_500_000, 64
    #: Chunks in one call of the library.
    JOINED = 5_000

    def __init__(self, path: str, keep_space: bool, lower: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.keep_space, self.lower = keep_space, lower
        # Bytes that each token spells: in these vocabularies a character stands for a byte, beside the mark of a word's end.
        spelled = {i: len(t.removesuffix("</w>")) for t, i in self.tokenizer.get_vocab().items()}
        self.spelled = np.array([spelled.get(i, 0) for i in range(max(spelled) + 1)], np.int64)
        self.forget()

    def forget(self):
        self.table, self.pool, self.used = np.zeros((self.SLOTS, 3), np.uint64), np.zeros(1 << 18, np.uint32), 0

    def ids_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks in a row, and their counts, by the library: apart, or joined in one text where that gives the same ids."""
        joint = self._joinable(data, starts, ends)
        apart, pool, place, counts, used = [np.flatnonzero(~joint)], [], np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), 0
        together = np.flatnonzero(joint)
        for at in range(0, len(together), self.JOINED):
            some = together[at : at + self.JOINED]
            found = self._joined(data, starts[some], ends[some])
            if found is None:
                apart.append(some)
                continue
            ids, counts[some] = found
            place[some] = used + np.cumsum(counts[some]) - counts[some]
            pool.append(ids)
            used += len(ids)
        rest, raw = np.concatenate(apart), data.tobytes()
        for at in range(0, len(rest), self.JOINED):
            some = rest[at : at + self.JOINED]
            found = [x.ids for x in self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(starts[some].tolist(), ends[some].tolist())], add_special_tokens=False)]
            counts[some] = [len(x) for x in found]
            place[some] = used + np.cumsum(counts[some]) - counts[some]
            pool.append(np.array([i for x in found for i in x], np.uint32))
            used += len(pool[-1])
        return K.gather(np.concatenate(pool), place, counts) if used else np.zeros(0, np.uint32), counts

    def _joinable(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Chunks whose ends stay cuts when others stand beside them.

        Those have white space in front and none at the end; without spaces, they are of ASCII and the letters that UTF-8 begins
        with C3, which keep their number of bytes as a tokenizer normalises and lower-cases them.
        """
        if self.keep_space:
            return K.is_space(data[starts]) & ~K.may_end_in_space(data, ends)
        strange = np.concatenate([[0], np.cumsum((data >= 0x80).view(np.int8) - 2 * (data == 0xC3).view(np.int8), dtype=np.int64)])
        wide = np.concatenate([[0], np.cumsum(data >= 0x80)])
        plain = wide[starts] == wide[ends]
        own = np.flatnonzero(~plain)
        plain[own] = strange[starts[own]] == strange[ends[own]]
        return plain

    def _joined(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids, counts) of chunks as one text, cut where so many bytes are spelled; None if a token crosses a chunk's end."""
        width, gap = ends - starts, int(not self.keep_space)
        text = np.full(int(width.sum()) + gap * len(width), 32, np.uint8)
        at = np.cumsum(width + gap) - width - gap
        text[np.repeat(at - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))] = K.gather(data, starts, width)
        ids = np.array(self.tokenizer.encode_batch_fast([text.tobytes().decode()], add_special_tokens=False)[0].ids, np.uint32)
        spelled, want = np.cumsum(self.spelled[ids]), np.cumsum(width)
        cut = np.searchsorted(spelled, want)
        if not len(ids) or spelled[-1] != want[-1] or (spelled[cut] != want).any():
            return None
        return ids, np.diff(cut + 1, prepend=0)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets), without end ids."""
        data, offsets = K.text_bytes(column)
        starts, ends = K.spans_of_chunks(data, offsets, self.keep_space)
        ids, total = self.spans(data, starts, ends)
        return ids, total[np.searchsorted(starts, offsets)]

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all spans in a row, where each span's begin, and their number)."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        key, check = (K.span_hashes(data, starts, ends, i, self.lower) for i in (0, 1))
        at, lost = self._found(key, check)
        place, size = (at >> np.uint64(16)).astype(np.int64), (at & np.uint64(0xFFFF)).astype(np.int64)
        if len(lost):
            order = lost[np.lexsort((check[lost], key[lost]))]
            fresh = np.ones(len(order), bool)
            fresh[1:] = (key[order[1:]] != key[order[:-1]]) | (check[order[1:]] != check[order[:-1]])
            first = order[fresh]
            ids, counts = self.ids_of(data, starts[first], ends[first])
            while self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.pool[self.used : self.used + len(ids)] = ids
            begin, group = self.used + np.cumsum(counts, dtype=np.int64) - counts, np.cumsum(fresh) - 1
            place[order], size[order] = begin[group], counts[group]
            self.used += len(ids)
            short = (ends - starts)[first] <= self.LONGEST
            self._remember(key[first[short]], check[first[short]], begin[short], counts[short])
        out, total = K.gather(self.pool, place, size), np.concatenate([[0], np.cumsum(size)])
        if self.used > self.POOL:
            self.forget()
        return out, total

    def _slots(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(self.SLOTS - 1)
        return (key & mask).astype(np.int64), ((key >> np.uint64(32)) & mask).astype(np.int64)

    def _found(self, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place << 16 | number of the ids of each chunk, indices of the unknown chunks)."""
        one, two = self._slots(key)
        rows = self.table.take(one, 0)
        out, lost = rows[:, 2].copy(), np.flatnonzero((rows[:, 0] != key) | (rows[:, 1] != check))
        rows = self.table.take(two[lost], 0)
        hit = (rows[:, 0] == key[lost]) & (rows[:, 1] == check[lost])
        out[lost[hit]] = rows[hit, 2]
        return out, lost[~hit]

    def _remember(self, key, check, place, counts) -> None:
        """Each distinct new chunk takes its first place if that is free, else its second."""
        one, two = self._slots(key)
        taken = (self.table[one, 0] != 0) | (self.table[one, 1] != 0)
        self.table[np.where(taken, two, one)] = np.stack([key, check, place.astype(np.uint64) << np.uint64(16) | counts.astype(np.uint64)], 1)

    def documents(self, column: pa.Array, end: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """As encode(), with the end id after each text."""
        ids, offsets = self.encode(column)
        n = len(offsets) - 1
        return np.insert(ids, offsets[1:], np.uint32(end)), offsets + np.arange(n + 1)


def encoder(path: str, keep_space: bool, lower: bool = False) -> ChunkEncoder:
    """This worker's encoder, made once. lower: the tokenizer itself lower-cases."""
    key = (path, keep_space, lower)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(path, keep_space, lower)
    return _ENCODERS[key]
