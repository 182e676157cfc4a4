"""SentencePiece encoding and decoding by suffix-array matching.

No piece goes on past a word's end into white space, so words are encoded apart, and each distinct word of a batch once. The
new words of a batch are concatenated; a suffix array, sorted as deep as the longest piece, indexes the text; every
piece's occurrences are one range of it, found by binary search for all pieces at once. The occurrences are the edges of a
lattice over positions. Edges are sorted by the position where they end and relaxed in that order: for byte-pair models, the last
piece of a prefix is the one edge that the encoding of the shorter prefix can stand before, that is, whose pair with the last
piece there is not merged otherwise. Characters without a piece become byte pieces.

Runs of spaces merge after all else, leftmost first, so that what they become depends on their length alone.

Nulls: a null text is an empty text, which has no pieces. A null doc_id is carried. Repeated rows are encoded alike. Empty table: no rows. Other
columns are not read.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import textkit as K
from .tokens import ChunkEncoder

SPACE = "▁"
UNREACHED, START, UNKNOWN = -4, -3, -2
_ENCODERS: dict[str, "PieceEncoder"] = {}


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions of codes in the order of the next `depth` codes, by prefix doubling."""
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1
    order, k = np.argsort(rank, kind="stable"), 1
    while k < depth:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] if k < n else 0
        key = rank * (n + 2) + after
        order = np.argsort(key)
        ranked = key[order]
        fresh = np.ones(n, np.int64)
        fresh[1:] = ranked[1:] != ranked[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        if rank.max(initial=0) == n:
            break
        k *= 2
    return order


class PieceEncoder(ChunkEncoder):
    """A byte-pair SentencePiece model with byte fallback, identity normalisation and a dummy prefix."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.byte = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.uint32)
        self.rank = {model.id_to_piece(i): (-model.get_score(i), i) for i in plain}
        self.text = {i: model.id_to_piece(i) for i in plain}
        self.bytes_of = {i: model.id_to_piece(i).replace(SPACE, " ").encode() for i in plain} | {int(b): bytes([k]) for k, b in enumerate(self.byte)}
        self.space = self.rank[SPACE][1]
        if any(SPACE in p.lstrip(SPACE) or (p[:2] == SPACE * 2 and p.strip(SPACE)) for p in self.rank):
            raise ValueError("a piece joins a word's end, or several spaces, with more")
        self.runs: dict[int, list[int]] = {}
        pieces = [(p, i) for p, (_, i) in self.rank.items() if len(p) == 1 or not p.startswith(SPACE * 2)]
        pieces = [(p, i) for p, i in pieces if self.merged(p) == [i]]  # others never are in an encoding
        self.piece_ids = np.array([i for _, i in pieces], np.int64)
        self.lengths = np.array([len(p) for p, _ in pieces], np.int64)
        self.depth = int(self.lengths.max())
        self.low, self.high = np.zeros((len(pieces), self.depth), np.uint32), np.full((len(pieces), self.depth), 0xFFFFFFFF, np.uint32)
        for k, (p, _) in enumerate(pieces):
            self.low[k, : len(p)] = self.high[k, : len(p)] = [ord(c) for c in p]
        self.pairs, self.valid = np.zeros(0, np.int64), np.zeros(0, bool)
        self.keep_space, self.lower = False, False
        self.forget()

    def merged(self, text: str) -> list[int]:
        """The pieces of a short text by merging the best pair, leftmost first, again and again; -1: an unknown character."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((self.rank[a + b][0], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [self.rank[p][1] if p in self.rank else -1 for p in parts]

    def run(self, n: int) -> list[int]:
        """The pieces of n spaces in a row."""
        if n not in self.runs:
            size, after, before = [1] * n, list(range(1, n)) + [-1], [-1] + list(range(n - 1))
            heap = [(self.rank[SPACE * 2][0], k, 1, 1) for k in range(n - 1)] if SPACE * 2 in self.rank else []
            heapq.heapify(heap)
            while heap:
                _, k, a, b = heapq.heappop(heap)
                j = after[k]
                if size[k] != a or j < 0 or size[j] != b:
                    continue
                size[k], size[j] = a + b, 0
                after[k] = after[j]
                if after[k] >= 0:
                    before[after[k]] = k
                for x in (before[k], k):
                    y = after[x] if x >= 0 else -1
                    if x >= 0 and y >= 0 and (got := self.rank.get(SPACE * (size[x] + size[y]))):
                        heapq.heappush(heap, (got[0], x, size[x], size[y]))
            out = [self.rank[SPACE * s][1] for s in size if s]
            if n > 4096:
                return out
            self.runs[n] = out
        return self.runs[n]

    def _allowed(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """May a piece (index) stand after the last piece of the text before it?"""
        ok = (before != UNREACHED) & ((before < 0) | (piece < 0))
        ask = np.flatnonzero((before >= 0) & (piece >= 0))
        if len(ask):
            keys, back = np.unique(before[ask] * len(self.piece_ids) + piece[ask], return_inverse=True)
            at = np.minimum(np.searchsorted(self.pairs, keys), max(len(self.pairs) - 1, 0))
            have = self.pairs[at] == keys if len(self.pairs) else np.zeros(len(keys), bool)
            new = keys[~have]
            if len(new):
                found = []
                for key in new.tolist():
                    a, b = (int(self.piece_ids[x]) for x in divmod(key, len(self.piece_ids)))
                    found.append(self.merged(self.text[a] + self.text[b]) == [a, b])
                if len(self.pairs) + len(new) > 4_000_000:
                    self.pairs, self.valid = np.zeros(0, np.int64), np.zeros(0, bool)
                spot = np.searchsorted(self.pairs, new)
                old = (keys[have], self.valid[at[have]] if have.any() else np.zeros(0, bool))
                self.pairs, self.valid = np.insert(self.pairs, spot, new), np.insert(self.valid, spot, found)
                answer = np.zeros(len(keys), bool)
                answer[~have] = found
                answer[have] = old[1]
            else:
                answer = self.valid[at]
            ok[ask] = answer[back]
        return ok

    def occurrences(self, codes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, piece index) of every piece in codes."""
        padded = np.concatenate([codes, np.zeros(self.depth, np.uint32)])

        def bound(keys: np.ndarray) -> np.ndarray:
            a, b = np.zeros(len(keys), np.int64), np.full(len(keys), len(order), np.int64)
            while True:
                open_ = np.flatnonzero(a < b)
                if not len(open_):
                    return a
                mid = (a[open_] + b[open_]) // 2
                window = padded[order[mid][:, None] + np.arange(self.depth)]
                differs = window != keys[open_]
                first = differs.argmax(1)
                rows = np.arange(len(open_))
                less = differs.any(1) & (window[rows, first] < keys[open_, first])
                a[open_[less]] = mid[less] + 1
                b[open_[~less]] = mid[~less]

        lo, hi = bound(self.low), bound(self.high)
        return K.gather(order, lo, hi - lo), np.repeat(np.arange(len(lo)), hi - lo)

    def ids_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each word with a space before it, one after another, and their counts."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        raw = data.tobytes()
        words = [SPACE + raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())]
        codes = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le"), np.uint32)
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size + 1) - size - 1
        position, piece = self.occurrences(codes, suffix_array(codes, self.depth))
        single = np.zeros(len(codes), bool)
        single[position[self.lengths[piece] == 1]] = True
        single[start + size] = True
        alone = np.flatnonzero(~single)
        position, piece = np.concatenate([position, alone]), np.concatenate([piece, np.full(len(alone), UNKNOWN)])
        length = np.where(piece >= 0, self.lengths[piece], 1)
        origin = np.repeat(start, size + 1)
        end = position + length
        step = end - origin[position]
        by_end = np.argsort(step, kind="stable")
        position, piece, end, step = position[by_end], piece[by_end], end[by_end], step[by_end]
        last, back = np.full(len(codes) + 1, UNREACHED), np.zeros(len(codes) + 1, np.int64)
        last[start] = START
        cuts = np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1]]))
        for a, b in zip(cuts, np.append(cuts[1:], len(step))):
            keep = np.flatnonzero(self._allowed(last[position[a:b]], piece[a:b])) + a
            last[end[keep]], back[end[keep]] = piece[keep], position[keep]
        # From each word's end back to its start, all words in step.
        at, word = start + size, np.arange(len(words))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(word):
            if (last[at] == UNREACHED).any():
                raise RuntimeError("a position without a piece")
            found.append((word, last[at], back[at]))
            at = back[at]
            more = at > start[word]
            at, word = at[more], word[more]
        word, piece, begin = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((begin, word))
        word, piece, begin = word[order], piece[order], begin[order]
        unknown = np.flatnonzero(piece == UNKNOWN)
        out = np.where(piece >= 0, self.piece_ids[piece], 0).astype(np.uint32)
        if len(unknown):
            spelled = [chr(int(codes[b])).encode() for b in begin[unknown]]
            width = np.ones(len(out), np.int64)
            width[unknown] = [len(x) for x in spelled]
            at = np.repeat(np.arange(len(out)), width)
            out, word = out[at], word[at]
            out[np.isin(at, unknown)] = self.byte[np.frombuffer(b"".join(spelled), np.uint8)]
        return out, np.bincount(word, minlength=len(words))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        column = pc.replace_substring(column.cast(pa.large_string()).fill_null(""), SPACE, " ")
        data, offsets = K.text_bytes(column)
        n_texts = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n_texts + 1, np.int64)
        solid = data != 32
        first = np.zeros(len(data) + 1, bool)
        first[offsets[:-1]] = True
        begins, ends = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1] | first[1 : len(data)]
        ends[:-1] &= ~solid[1:] | first[1 : len(data)]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        ids, total = self.spans(data, starts, ends)
        text = np.searchsorted(offsets, starts, "right") - 1
        # Spaces before each word beyond the one that is the word's own; the dummy prefix counts as one.
        previous = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        head = np.ones(len(starts), bool)
        head[1:] = text[1:] != text[:-1]
        extra = np.where(head, starts - offsets[text], starts - previous - 1)
        where, what, drop = [], [], []
        for k in np.flatnonzero(extra > 0).tolist():
            bare = ids[total[k]] == self.space
            where.append(total[k])
            what.append(self.run(int(extra[k]) + int(bare)))
            if bare:
                drop.append(total[k])
        # Spaces after the last word of a text; a text of spaces alone has the dummy prefix too.
        bounds = np.searchsorted(starts, offsets)
        words = np.diff(bounds)
        tail_from = np.where(words > 0, ends[np.maximum(bounds[1:] - 1, 0)] if len(ends) else 0, offsets[:-1])
        tail = offsets[1:] - tail_from
        tail = np.where((words == 0) & (tail > 0), tail + 1, tail)
        counts = np.diff(total[bounds])
        for i in np.flatnonzero(tail > 0).tolist():
            where.append(total[bounds[i + 1]])
            what.append(self.run(int(tail[i])))
            counts[i] += len(what[-1])
        for k, w in zip(np.flatnonzero(extra > 0).tolist(), what):
            counts[text[k]] += len(w)
        for d in drop:
            counts[text[np.searchsorted(total, d, "right") - 1]] -= 1
        if where:
            # Tails of one text come before leading runs of the next at the same place, so order by place, then tails first.
            n_lead = int((extra > 0).sum())
            rank = sorted(range(len(where)), key=lambda k: (where[k], 0 if k >= n_lead else 1, k))
            keep = np.ones(len(ids), bool)
            keep[drop] = False
            shift = np.concatenate([[0], np.cumsum(keep)])
            spots = np.repeat(shift[np.array([where[k] for k in rank])], [len(what[k]) for k in rank])
            ids = np.insert(ids[keep], spots, np.array([t for k in rank for t in what[k]], np.uint32))
        return ids, np.concatenate([[0], np.cumsum(counts)])

    def decode(self, ids) -> str:
        """The text of ids: what encode() was given, as far as it is valid UTF-8."""
        return b"".join(self.bytes_of[int(i)] for i in ids)[1:].decode("utf-8", "replace")


def piece_encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


ROW_SCHEMA = "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, round_trip boolean"


def encoded(docs, path: str):
    """Per document: pieces, byte pieces, checksum of the ids (little-endian unsigned 32-bit), and whether decoding gives the text back."""

    def run(batches):
        encoder = piece_encoder(path)
        table = np.array([len(encoder.bytes_of.get(i, b"")) for i in range(max(encoder.bytes_of) + 1)], np.int64)
        pool = np.frombuffer(b"".join(encoder.bytes_of.get(i, b"") for i in range(len(table))), np.uint8)
        begin = np.cumsum(table) - table
        for batch in batches:
            for part in K.slices(batch, "text", 8 << 20):
                ids, offsets = encoder.encode(part.column("text"))
                raw = ids.astype("<u4").tobytes()
                own = np.concatenate([[0], np.cumsum(np.isin(ids, encoder.byte))])
                spelled = K.gather(pool, begin[ids], table[ids]).tobytes()
                at = np.concatenate([[0], np.cumsum(table[ids])])[offsets]
                texts = part.column("text").cast(pa.large_binary()).fill_null(b"")
                same = [spelled[a + (b > a) : b] == t.replace(SPACE.encode(), b" ") for a, b, t in zip(at[:-1].tolist(), at[1:].tolist(), texts.to_pylist())]
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id").cast(pa.int64()), "n_pieces": pa.array(np.diff(offsets)), "n_byte_pieces": pa.array(own[offsets[1:]] - own[offsets[:-1]]), "ids_crc32": pa.array(crc, pa.int64()), "round_trip": pa.array(same)})

    return docs.select("doc_id", "text").mapInArrow(K.tidy(run), ROW_SCHEMA)


def op10_suffix_pieces(spark, sf_dir):
    """Every text of `documents` in pieces of the public 32k byte-pair model, and back."""
    from .tokens import tokenizer_path

    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("piece_bpe_32k.model"))
