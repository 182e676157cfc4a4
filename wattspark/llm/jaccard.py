"""N-gram Jaccard join by a token-group matrix, exact, with connected components.

A document's set holds the 64-bit hashes of its distinct n-word shingles; documents with equal sets (by a
hash of 128 bits, 96 of them in step 2) are one node. The steps:

1. Tokens that about a five-hundredth of all documents hold are found over the whole table by lossy counts of each task, added up.
   There are at most 500 times the mean set size of them.
2. All other tokens travel once, packed as binary runs, to the task of their bucket, where those that one node alone
   holds fall out. Only nodes with enough shared tokens to reach the threshold at all go on. Tokens are counted before, so that
   there are buckets enough for each to fit in memory; a task takes its buckets one after another.
3. Nodes with one min-hash meet in chunks of bounded size; within a chunk, each node joins the first leader that it links to.
   A leader and its nodes are a group: its row holds the union of its tokens and its members. Leaders meet again under other
   min-hashes, in other chunks, so that a family of any size becomes one component, or a few, without its pairs.
4. The matrix (token, group) holds the prefix tokens, rarest first, of each group's members. A node's prefix
   tokens bring it to the groups of other components that could hold a link; the overlap of the node with the group's
   union bounds every member's, and only groups that reach the threshold are opened and compared, member by member. A group
   travels once for each pack of nodes that ask it.
5. Links between components are closed by alternating large-star and small-star rounds on saved tables.

Every link between different components is found in step 4, since linked sets share a token of both prefixes in any
common order; the order (and so the heavy list and the leaders) changes cost alone.

Nulls: null or wordless text has an empty set, which links with nothing: its component is its own doc_id. A null doc_id is carried;
it names a component only if no other id is in it (null then). Repeated rows are copies. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from . import textkit as K

U64 = np.uint64
HOT_DF = np.uint32(0xFFFFFFFF)


@dataclass(frozen=True)
class Params:
    """words: of a shingle; percent: least Jaccard similarity in hundredths; chunk: nodes that meet in one chunk, on average at most;
    bucket: tokens that a task holds at once, on average at most; flush: tokens that a task gathers before it sends them; pack: nodes
    that ask one copy of a group."""

    words: int = 5
    percent: int = 80
    heavy_share: int = 500
    chunk: int = 128
    rounds: int = 4
    bucket: int = 2_000_000
    flush: int = 1_000_000
    pack: int = 1024


def shingle_sets(column, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(all sets in a row, each sorted; offsets) of a string column."""
    data, offsets = K.text_bytes(column)
    starts, ends = K.spans_of_words(data, offsets)
    hashes = K.span_hashes(data, starts, ends, lower=True)
    first = np.searchsorted(starts, offsets)
    n_words = np.diff(first)
    n = np.maximum(n_words - words + 1, np.minimum(n_words, 1))
    # One running key a text: position k of a shingle turns its word's hash by an odd factor of its own.
    at = np.repeat(first[:-1] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    width = np.repeat(np.minimum(n_words, words), n)
    key = np.full(len(at), U64(words), U64)
    for k in range(words):
        use = width > k
        word = hashes[np.minimum(at + k, max(len(hashes) - 1, 0))] if len(hashes) else np.zeros(0, U64)
        key = np.where(use, K.mix(key * U64(0x9E3779B97F4A7C15) + word + U64(k + 1)), key)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.argsort(key, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    key, doc = key[order], doc[order]
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    key, doc = key[keep], doc[keep]
    return key, np.searchsorted(doc, np.arange(len(n) + 1))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, U64), np.cumsum(values, dtype=U64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def node_ids(sets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for a set."""
    n = np.diff(offsets).astype(U64)
    return K.mix(_sums(K.mix(sets ^ U64(0x1234567)), offsets) + n), K.mix(_sums(K.mix(sets + U64(0x51ED270B)), offsets) ^ n)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _numbered(lo: np.ndarray, mid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place of each distinct node, which of them each place has); a node is named by 96 bits."""
    order = np.lexsort((mid, lo))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (lo[order[1:]] != lo[order[:-1]]) | (mid[order[1:]] != mid[order[:-1]])
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(fresh) - 1
    return order[fresh], back


def _distinct_nodes(column, words):
    sets, offsets = shingle_sets(column, words)
    hi, lo = node_ids(sets, offsets)
    n = np.diff(offsets)
    first, _ = _numbered(lo, hi)
    first = first[n[first] > 0]
    return sets, offsets, hi, lo, first


def scan(docs, spark, p: Params):
    """Saved rows: kind 0 (doc_id, set size, node) of each document, kind 1 (token, documents in one task) of heavy tokens."""
    schema = "kind int, a long, b long, hi long, lo long"

    def run(batches):
        texts, tokens, counts = 0, np.zeros(0, U64), np.zeros(0, np.int64)
        for batch in batches:
            for part in K.slices(batch, "text"):
                sets, offsets, hi, lo, first = _distinct_nodes(part.column("text"), p.words)
                n = np.diff(offsets)
                none = n == 0
                yield pa.RecordBatch.from_pydict({"kind": pa.array(np.zeros(len(n), np.int32)), "a": part.column("doc_id").cast(pa.int64()), "b": pa.array(n.astype(np.int64)), "hi": pa.array(hi.view(np.int64), mask=none), "lo": pa.array(lo.view(np.int64), mask=none)})
                texts += len(n)
                own, times = np.unique(sets[_ranges(offsets[first], n[first])], return_counts=True)
                # Lossy counting: what has been rarer than the share so far goes; a token's first parts may be lost, its heavy ones are not.
                both, inverse = np.unique(np.concatenate([tokens, own]), return_inverse=True)
                total = np.bincount(inverse, np.concatenate([counts, times])).astype(np.int64)
                keep = total >= max(2, texts // (2 * p.heavy_share))
                tokens, counts = both[keep], total[keep]
        keep = counts >= max(2, texts // p.heavy_share)
        tokens, counts = tokens[keep], counts[keep]
        if len(tokens):
            zero = pa.array(np.zeros(len(tokens), np.int64))
            yield pa.RecordBatch.from_pydict({"kind": pa.array(np.ones(len(tokens), np.int32)), "a": _long(tokens), "b": pa.array(counts), "hi": zero, "lo": zero})

    return K.saved(docs.select("doc_id", "text").mapInArrow(K.tidy(run), schema), spark, "jaccard-scan")


def heavy_tokens(found, docs: int, p: Params) -> np.ndarray:
    """Tokens that at least a heavy_share-th of all documents hold, as counted; at most heavy_share times the mean set size."""
    rows = found.where("kind = 1").groupBy("a").agg(F.sum("b").alias("n")).where(F.col("n") >= max(64, docs // p.heavy_share)).select("a").toArrow()
    return np.sort(rows.column("a").to_numpy().view(U64))


@dataclass(frozen=True)
class Buckets:
    """count buckets in `partitions` partitions: bucket b is part b // partitions of the partition that keys[b % partitions] is dealt to."""

    partitions: int
    count: int
    keys: tuple[int, ...]

    @staticmethod
    def of(spark, tokens: int, p: Params) -> "Buckets":
        """As many as there are partitions, or more if else one had more than p.bucket tokens."""
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        found = spark.range(40 * partitions).select(F.col("id").cast("int").alias("k")).groupBy(F.pmod(F.hash("k"), F.lit(partitions)).alias("p")).agg(F.min("k").alias("k")).collect()
        keys = {r["p"]: r["k"] for r in found}
        return Buckets(partitions, max(partitions, -(-tokens // p.bucket)), tuple(keys.get(i, i) for i in range(partitions)))

    def dealt(self, packed):
        """Rows in their partitions, a bucket after another."""
        out = packed.repartition(self.partitions, "bucket")
        return out.sortWithinPartitions("sub") if self.count > self.partitions else out

    def of_tokens(self, x: np.ndarray) -> np.ndarray:
        return (x % U64(self.count)).astype(np.int32)


PACKED = "kind int, bucket int, sub int, lo binary, hi binary, sizes binary, counts binary, tokens binary, dfs binary"
_PACKED_ARROW = pa.schema([(c.split()[0], pa.int32() if c.endswith(" int") else pa.binary()) for c in PACKED.split(", ")])


def _packed(kind, b: int, buckets: Buckets, lo, hi, counts, tokens, sizes=None, dfs=None):
    """One row: the nodes with entries in a bucket, how many each has, and all entries in a row.

    Kind 1 names whole nodes and sizes; the others name nodes by 96 bits.
    """
    some = lambda x, kind: b"" if x is None else x.astype(kind).tobytes()
    return {"kind": kind, "bucket": buckets.keys[b % buckets.partitions], "sub": b // buckets.partitions, "lo": lo.tobytes(), "hi": hi.tobytes(), "sizes": some(sizes, np.int32), "counts": some(counts, np.int32), "tokens": tokens.tobytes(), "dfs": some(dfs, np.uint32)}


def _by_bucket(kind, buckets: Buckets, bucket, node, lo, mid, tokens, dfs=None):
    """Rows of _packed(), one a bucket, from entries (bucket, node index, token)."""
    order = np.lexsort((node, bucket))
    bucket, node, tokens = bucket[order], node[order], tokens[order]
    dfs = None if dfs is None else dfs[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    for a, b in zip(cuts, np.append(cuts[1:], len(bucket))):
        own = node[a:b]
        runs = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        yield _packed(kind, int(bucket[a]), buckets, lo[own[runs]], mid[own[runs]], np.diff(np.append(runs, b - a)), tokens[a:b], dfs=None if dfs is None else dfs[a:b])


def _batches_of(rows, size: int = 64):
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema=_PACKED_ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=_PACKED_ARROW)


def spread(docs, heavy: np.ndarray, p: Params, buckets: Buckets):
    """Kind 0: light tokens to their buckets. Kind 1: each node with its size and heavy tokens."""
    shared_heavy = docs.sparkSession.sparkContext.broadcast(heavy)  # bounded, see heavy_tokens()

    def run(batches):
        held, size, heavy = [], 0, shared_heavy.value

        def flush():
            hi, lo, n, tokens = (np.concatenate(x) for x in zip(*held))
            held.clear()
            mid = hi.astype(np.uint32)
            keep = np.zeros(len(lo), bool)
            keep[_numbered(lo, mid)[0]] = True
            node = np.repeat(np.arange(len(n)), n)
            use = np.flatnonzero(keep[node])
            node, tokens = node[use], tokens[use]
            at = np.minimum(np.searchsorted(heavy, tokens), max(len(heavy) - 1, 0))
            hot = heavy[at] == tokens if len(heavy) else np.zeros(len(tokens), bool)
            light, hot = np.flatnonzero(~hot), np.flatnonzero(hot)
            yield from _batches_of(_by_bucket(0, buckets, buckets.of_tokens(tokens[light]), node[light], lo, mid, tokens[light]))
            whole = np.flatnonzero(keep)
            home = buckets.of_tokens(lo[whole])
            order = np.argsort(home, kind="stable")
            whole, home = whole[order], home[order]
            node, tokens = node[hot], tokens[hot]
            begin, end = np.searchsorted(node, whole), np.searchsorted(node, whole, "right")
            cuts = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]])) if len(home) else np.zeros(0, np.int64)
            yield from _batches_of(_packed(1, int(home[a]), buckets, lo[whole[a:b]], hi[whole[a:b]], (end - begin)[a:b], tokens[_ranges(begin[a:b], (end - begin)[a:b])], sizes=n[whole[a:b]]) for a, b in zip(cuts, np.append(cuts[1:], len(home))))

        for batch in batches:
            for part in K.slices(batch, "text"):
                sets, offsets, hi, lo, first = _distinct_nodes(part.column("text"), p.words)
                n = np.diff(offsets)
                held.append((hi[first], lo[first], n[first], sets[_ranges(offsets[first], n[first])]))
                size += len(held[-1][3])
                if size >= p.flush:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return docs.select("text").mapInArrow(K.tidy(run), PACKED)


def _column(rows: list[dict], name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(r[name], kind) for r in rows])


def _buckets_of(batches):
    """Lists of the rows of one bucket, in the order of buckets."""
    held = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["sub"] != held[-1]["sub"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def shared_tokens(packed, buckets: Buckets):
    """Drops tokens of one node alone; sends the others, with the number of nodes that hold them, to their node's bucket."""

    def one(rows):
        yield from _batches_of(row for row in rows if row["kind"] == 1)
        rows = [row for row in rows if row["kind"] == 0]
        if not rows:
            return
        lo, mid, counts, tokens = _column(rows, "lo", U64), _column(rows, "hi", np.uint32), _column(rows, "counts", np.int32), _column(rows, "tokens", U64)
        rows.clear()
        first, number = _numbered(lo, mid)
        order = np.argsort(tokens)
        ranked = tokens[order]
        same = np.zeros(len(ranked) + 1, bool)
        same[1:-1] = ranked[1:] == ranked[:-1]
        many = order[np.flatnonzero(same[1:] | same[:-1])]
        del order, ranked, same
        if not len(many):
            return
        node = np.repeat(number, counts)[many]
        tokens = tokens[many]
        order = np.lexsort((node, tokens))
        tokens, node = tokens[order], node[order]
        fresh = np.ones(len(tokens), bool)
        fresh[1:] = (tokens[1:] != tokens[:-1]) | (node[1:] != node[:-1])
        tokens, node = tokens[fresh], node[fresh]
        cuts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        df = np.diff(np.append(cuts, len(tokens)))
        df = np.repeat(df, df)
        keep = np.flatnonzero(df > 1)
        tokens, node, df = tokens[keep], node[keep], df[keep]
        lo, mid = lo[first], mid[first]
        yield from _batches_of(_by_bucket(2, buckets, buckets.of_tokens(lo)[node], node, lo, mid, tokens, df))

    def run(batches):
        for rows in _buckets_of(batches):
            yield from one(rows)

    return buckets.dealt(packed).mapInArrow(K.tidy(run), PACKED)


def _minhash(tokens: np.ndarray, salt: int) -> np.ndarray:
    return K.mix(tokens ^ U64(salt * 0x9E3779B97F4A7C15 & (2**64 - 1)))


def survivors(shared, buckets: Buckets, p: Params):
    """A row a node that shares enough tokens to link at all: its shared tokens, rarest first, prefix length and min-hashes."""
    schema = "hi long, lo long, n int, prefix int, tokens binary, " + ", ".join(f"m{r} long" for r in range(p.rounds))

    def one(rows):
        rows.sort(key=lambda row: row["kind"])
        whole = [row for row in rows if row["kind"] == 1]
        for row in whole:
            row["dfs"] = np.full(len(row["tokens"]) // 8, HOT_DF, np.uint32).tobytes()
        hi, sizes = _column(whole, "hi", U64), _column(whole, "sizes", np.int32)
        lo, counts, tokens, dfs = _column(rows, "lo", U64), _column(rows, "counts", np.int32), _column(rows, "tokens", U64), _column(rows, "dfs", np.uint32)
        mid = np.concatenate([hi.astype(np.uint32), *(np.frombuffer(r["hi"], np.uint32) for r in rows[len(whole) :])])
        rows.clear()
        # Rows of kind 1 come first and name every node, so that the first place of each has its size.
        canon, back = _numbered(lo, mid)
        have = np.bincount(back, counts, len(canon)).astype(np.int64)
        fit = 100 * have >= p.percent * sizes[canon]  # repeated heavy tokens may let some through here; they go below
        node = np.repeat(back, counts)
        use = np.flatnonzero(fit[node])
        node, tokens, dfs = node[use], tokens[use], dfs[use]
        order = np.lexsort((tokens, dfs, node))
        node, tokens, dfs = node[order], tokens[order], dfs[order]
        fresh = np.ones(len(node), bool)
        fresh[1:] = (node[1:] != node[:-1]) | (tokens[1:] != tokens[:-1])
        node, tokens = node[fresh], tokens[fresh]
        bounds = np.searchsorted(node, np.arange(len(canon) + 1))
        have = np.diff(bounds)
        n = sizes[canon].astype(np.int64)
        need = (p.percent * n + 99) // 100
        who = np.flatnonzero((have >= need) & (have > 0))
        out = {"hi": _long(hi[canon[who]]), "lo": _long(lo[canon[who]]), "n": pa.array(n[who].astype(np.int32)), "prefix": pa.array((have - need + 1)[who].astype(np.int32))}
        # The tokens of the chosen nodes alone, so that each run ends where the next begins.
        begin = np.cumsum(have[who]) - have[who]
        chosen = tokens[_ranges(bounds[:-1][who], have[who])]
        for r in range(p.rounds):
            out[f"m{r}"] = _long(np.minimum.reduceat(_minhash(chosen, r + 1), begin) if len(who) else np.zeros(0, U64))
        for at in range(0, len(who), 1000):
            part = {k: v[at : at + 1000] for k, v in out.items()}
            part["tokens"] = pa.array([tokens[bounds[i] : bounds[i + 1]].tobytes() for i in who[at : at + 1000]], pa.binary())
            yield pa.RecordBatch.from_pydict({k: part[k] for k in ("hi", "lo", "n", "prefix", "tokens", *(f"m{r}" for r in range(p.rounds)))})

    def run(batches):
        for rows in _buckets_of(batches):
            yield from one(rows)

    return buckets.dealt(shared).mapInArrow(K.tidy(run), schema)


def links(inter: int, n: int, m: int, p: Params) -> bool:
    return 100 * inter >= p.percent * (n + m - inter)


GROUP = "ghi long, glo long, least int, most int, matrix_tokens binary, matrix_rest binary, group_tokens binary, members binary, member_counts binary, member_sizes binary, member_positions binary"


def _greedy(rows: list[dict], p: Params) -> list[int]:
    """Of each row, the index of the leader that it joins: the first, by set size and node, that it links to."""
    if len(rows) == 1:
        return [0]
    sets = [np.frombuffer(r["tokens"], U64) for r in rows]
    universe, where = np.unique(np.concatenate(sets), return_inverse=True)
    parts = np.split(where, np.cumsum([len(s) for s in sets])[:-1])
    leaders: list[int] = []
    marks = np.zeros((0, len(universe)), bool)
    of = [0] * len(rows)
    for i in sorted(range(len(rows)), key=lambda i: (-rows[i]["n"], rows[i]["lo"])):
        inter = marks[:, parts[i]].sum(1) if leaders else []
        got = next((k for k, x in zip(leaders, inter) if links(int(x), rows[i]["n"], rows[k]["n"], p)), None)
        if got is None:
            leaders.append(i)
            mark = np.zeros((1, len(universe)), bool)
            mark[0, parts[i]] = True
            marks = np.concatenate([marks, mark])
            got = i
        of[i] = got
    return of


def _joined(rows: list[dict], p: Params) -> list[int]:
    """Of each row, the least index that it reaches by links within the chunk."""
    if len(rows) == 1:
        return [0]
    sets = [np.frombuffer(r["tokens"], U64) for r in rows]
    universe, where = np.unique(np.concatenate(sets), return_inverse=True)
    parts = np.split(where, np.cumsum([len(s) for s in sets])[:-1])
    sizes, of = np.array([r["n"] for r in rows]), np.arange(len(rows))
    for i, part in enumerate(parts):
        mark = np.zeros(len(universe), bool)
        mark[part] = True
        inter = np.add.reduceat(mark[where].astype(np.int64), np.cumsum([0, *(len(s) for s in sets[:-1])]))
        near = of[np.flatnonzero(100 * inter >= p.percent * (sizes[i] + sizes - inter))]
        if len(near) and (near != near.min()).any():
            of[np.isin(of, near)] = near.min()
    return of.tolist()


def _runs(batches, keys):
    """Lists of consecutive rows with equal keys, across batches."""
    held, last = [], None
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if held and key != last:
                yield held
                held = []
            last = key
            held.append(row)
    if held:
        yield held


def meet(nodes, r: int, p: Params, partitions: int):
    """Nodes with min-hash m{r} in one chunk, with the leader (lhi, llo) that each joins; after round 0, with the first that it reaches."""
    key = f"m{r}"
    large = nodes.groupBy(key).count().where(F.col("count") > p.chunk)
    salted = nodes.join(large, key, "left").withColumn("chunk", F.coalesce(F.pmod(F.xxhash64("hi", "lo", F.lit(r)), F.ceil(F.col("count") / p.chunk)), F.lit(0))).drop("count")

    def run(batches):
        schema = None
        out: list[dict] = []
        for rows in _runs(batches, (key, "chunk")):
            for row, k in zip(rows, (_joined if r else _greedy)(rows, p)):
                row.pop("chunk")
                out.append(row | {"lhi": rows[k]["hi"], "llo": rows[k]["lo"]})
            if len(out) >= 2000:
                schema = _arrow_of(p)
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_arrow_of(p))

    names = ["hi", "lo", "n", "prefix", "tokens", *(f"m{i}" for i in range(p.rounds))]
    schema = "hi long, lo long, n int, prefix int, tokens binary, " + ", ".join(f"m{i} long" for i in range(p.rounds)) + ", lhi long, llo long"
    return salted.select(*names, "chunk").repartition(partitions, key, "chunk").sortWithinPartitions(key, "chunk").mapInArrow(K.tidy(run), schema)


def _arrow_of(p: Params) -> pa.Schema:
    return pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("n", pa.int32()), ("prefix", pa.int32()), ("tokens", pa.binary()), *((f"m{i}", pa.int64()) for i in range(p.rounds)), ("lhi", pa.int64()), ("llo", pa.int64())])


def group_rows(joined, p: Params, partitions: int):
    """A row a group (a leader and what joined it in its chunk): sizes, prefix tokens, token union and members."""

    def run(batches):
        out = []
        for rows in _runs(batches, ("lhi", "llo")):
            sets = [np.frombuffer(r["tokens"], U64) for r in rows]
            union, where = np.unique(np.concatenate(sets), return_inverse=True)
            # Of each prefix token, the most that a member has from it on, in the common order.
            matrix, at = np.unique(np.concatenate([s[: r["prefix"]] for s, r in zip(sets, rows)]), return_inverse=True)
            rest = np.zeros(len(matrix), np.int64)
            np.maximum.at(rest, at, np.concatenate([len(s) - np.arange(r["prefix"]) for s, r in zip(sets, rows)]))
            out.append(
                {
                    "ghi": rows[0]["lhi"], "glo": rows[0]["llo"], "least": min(r["n"] for r in rows), "most": max(r["n"] for r in rows),
                    "matrix_tokens": matrix.tobytes(), "matrix_rest": rest.astype(np.int32).tobytes(), "group_tokens": union.tobytes(),
                    "members": np.array([[r["hi"], r["lo"]] for r in rows], np.int64).tobytes(), "member_counts": np.array([len(s) for s in sets], np.int32).tobytes(),
                    "member_sizes": np.array([r["n"] for r in rows], np.int32).tobytes(), "member_positions": where.astype(np.int32).tobytes(),
                }
            )
            if len(out) >= 200:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    arrow = pa.schema([(c.split()[0], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]]) for c in GROUP.split(", ")])
    return joined.repartition(partitions, "lhi", "llo").sortWithinPartitions("lhi", "llo").mapInArrow(K.tidy(run), GROUP)


def _exploded(df, source: str, keys: list[str], count: str | None = None, rest: str | None = None):
    """A row a token of a packed column (its first `count` ones), with `rest`: how many tokens there are from it on, packed or by position."""

    def run(batches):
        for batch in batches:
            sets = [np.frombuffer(x, U64) for x in batch.column(source).to_pylist()]
            left = [np.frombuffer(x, np.int32) for x in batch.column(rest).to_pylist()] if rest else [len(s) - np.arange(len(s)) for s in sets]
            if count:
                cut = batch.column(count).to_pylist()
                sets, left = [s[:n] for s, n in zip(sets, cut)], [x[:n] for x, n in zip(left, cut)]
            lengths = np.array([len(s) for s in sets], np.int64)
            take = pa.array(np.repeat(np.arange(len(sets)), lengths))
            both = (_long(np.concatenate(sets)), pa.array(np.concatenate(left).astype(np.int32))) if sets else (pa.array([], pa.int64()), pa.array([], pa.int32()))
            yield pa.RecordBatch.from_arrays([*both, *(batch.column(k).take(take) for k in keys)], ["token", "rest", *keys])

    kinds = dict(df.dtypes)
    return df.mapInArrow(K.tidy(run), ", ".join(["token long, rest int", *(f"{k} {kinds[k]}" for k in keys)]))


def _opened(batches, p: Params):
    """Rows come by group: first the group (hi is null), then the nodes that ask it. A node's overlap with the union bounds that with each member."""
    group = None
    for batch in batches:
        out = {"hi": [], "lo": [], "ghi": [], "glo": []}
        cols = {c: batch.column(c).to_pylist() for c in ("hi", "lo", "n", "tokens", "ghi", "glo", "least", "group_tokens", "member_counts", "member_sizes", "member_positions")}
        for i, hi in enumerate(cols["hi"]):
            if hi is None:
                counts, sizes, positions = (np.frombuffer(cols[c][i], np.int32) for c in ("member_counts", "member_sizes", "member_positions"))
                group = (np.frombuffer(cols["group_tokens"][i], U64), cols["least"][i], np.cumsum(counts) - counts, sizes, positions)
                continue
            union, least, begin, sizes, positions = group
            n, own = cols["n"][i], np.frombuffer(cols["tokens"][i], U64)
            at = np.searchsorted(union, own)
            at = at[union[np.minimum(at, len(union) - 1)] == own]
            if not links(len(at), n, max(least, len(at)), p):
                continue
            mark = np.zeros(len(union), np.int64)
            mark[at] = 1
            inter = np.add.reduceat(mark[positions], begin)
            if np.any(100 * inter >= p.percent * (n + sizes - inter)):
                for k in out:
                    out[k].append(cols[k][i])
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(k, pa.int64()) for k in out]))


def _asked(pairs, nodes, groups, partitions: int, p: Params):
    """Each group, a copy for every p.pack nodes that ask it, followed by these nodes."""
    packs = pairs.groupBy("ghi", "glo").agg(F.ceil(F.count("*") / p.pack).alias("packs"))
    copies = groups.join(packs, ["ghi", "glo"]).withColumn("pack", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("packs") - 1))).drop("packs")
    asking = pairs.join(packs, ["ghi", "glo"]).withColumn("pack", F.pmod(F.xxhash64("hi", "lo"), "packs")).drop("packs").join(nodes.select("hi", "lo", "n", "tokens"), ["hi", "lo"])
    return copies.unionByName(asking, allowMissingColumns=True).repartition(partitions, "ghi", "glo", "pack").sortWithinPartitions("ghi", "glo", "pack", F.asc_nulls_first("hi"))


def closed(edges, spark, rounds: int = 40):
    """Connected components of edges(a, b), which are comparable columns: rows (a, root), root the least of a component.

    Alternating large-star and small-star; each round's edges are saved in the shared folder.
    """
    edges = K.saved(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), spark, "links")
    digest = None
    for _ in range(rounds if edges.head(1) else 0):
        both = edges.union(edges.select("b", "a").toDF("a", "b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("x"), F.col("a"), "m").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("x").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a != b").distinct()
        edges = K.saved(small, spark, "links")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == digest:
            break
        digest = now
    else:
        if digest is not None:
            raise RuntimeError("components haven't settled")
    return edges.select("a", F.col("b").alias("root"))


def components(docs, p: Params = Params()):
    """doc_id, n_shingles and component_id of every document."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = scan(docs, spark, p)
    n_docs, n_tokens = found.where("kind = 0").agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0))).first()
    buckets = Buckets.of(spark, n_tokens, p)
    shared = shared_tokens(spread(docs, heavy_tokens(found, n_docs, p), p, buckets), buckets)
    nodes = K.saved(survivors(shared, buckets, p), spark, "jaccard-nodes")
    joined = K.saved(meet(nodes, 0, p, parts), spark, "jaccard-joined")
    # Leaders meet under each of the other min-hashes, in other chunks each time.
    leaders = joined.where("hi = lhi and lo = llo").drop("lhi", "llo")
    met = [meet(leaders, r, p, parts).where("hi != lhi or lo != llo").select(F.struct("hi", "lo").alias("a"), F.struct(F.col("lhi").alias("hi"), F.col("llo").alias("lo")).alias("b")) for r in range(1, p.rounds)]
    roots = closed(reduce(lambda x, y: x.unionByName(y), met), spark)
    chain = joined.select("hi", "lo", F.struct(F.col("lhi").alias("hi"), F.col("llo").alias("lo")).alias("a")).join(roots, "a", "left").select("hi", "lo", F.coalesce("root", "a").alias("id"))
    # The smaller component asks the groups of the larger.
    chain = K.saved(chain.join(chain.groupBy("id").agg(F.count("*").alias("size")), "id").select("hi", "lo", F.struct("size", "id").alias("comp")), spark, "jaccard-chain")
    groups = K.saved(group_rows(joined, p, parts), spark, "jaccard-groups")
    group_comp = groups.join(chain.select(F.col("hi").alias("ghi"), F.col("lo").alias("glo"), F.col("comp").alias("gcomp")), ["ghi", "glo"])
    known = nodes.join(chain, ["hi", "lo"])
    matrix = _exploded(group_comp.select("matrix_tokens", "matrix_rest", "ghi", "glo", "gcomp", "least", "most"), "matrix_tokens", ["ghi", "glo", "least", "most", "gcomp"], rest="matrix_rest").withColumnRenamed("rest", "grest")
    query = _exploded(known.select("tokens", "prefix", "hi", "lo", "n", "comp"), "tokens", ["hi", "lo", "n", "comp"], "prefix")
    # A token of one component alone links nothing new.
    ends = matrix.groupBy("token").agg(F.min("gcomp").alias("x"), F.max("gcomp").alias("y")).where("x != y").select("token")
    # Two sets share at most what each has from their first common token on; linked ones share at least `need`.
    need = F.ceil(p.percent * (F.col("n") + F.col("least")) / (100 + p.percent))
    near = (F.col("comp") < F.col("gcomp")) & (100 * F.col("most") >= p.percent * F.col("n")) & (100 * F.col("n") >= p.percent * F.col("least")) & (F.col("rest") >= need) & (F.col("grest") >= need)
    pairs = K.saved(query.join(ends, "token").join(matrix, "token").where(near).select("hi", "lo", "ghi", "glo").distinct(), spark, "jaccard-pairs")
    asked = _asked(pairs, nodes, groups.drop("matrix_tokens", "matrix_rest", "members", "most"), parts, p)
    linked = K.saved(asked.mapInArrow(K.tidy(lambda b: _opened(b, p)), "hi long, lo long, ghi long, glo long"), spark, "jaccard-links")
    named_by = chain.select("hi", "lo", F.col("comp.id").alias("id"))
    edges = linked.join(named_by.withColumnRenamed("id", "a"), ["hi", "lo"]).join(named_by.select(F.col("hi").alias("ghi"), F.col("lo").alias("glo"), F.col("id").alias("b")), ["ghi", "glo"]).select("a", "b")
    roots = closed(edges, spark)
    top = named_by.join(roots.select(F.col("a").alias("id"), "root"), "id", "left").select("hi", "lo", F.coalesce("root", "id").alias("comp"))
    rows = found.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"), "hi", "lo")
    least = rows.where("lo is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("least")).join(top, ["hi", "lo"], "left")
    least = least.withColumn("comp", F.coalesce("comp", F.struct("hi", "lo")))
    named = least.join(least.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").select("hi", "lo", "component_id")
    return rows.join(named, ["hi", "lo"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op6_jaccard_groups(spark, sf_dir):
    """Set size and component of every document of `documents`."""
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
