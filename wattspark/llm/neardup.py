"""Embedding near-dedup: robust-pruned flat graph over tight balls of vectors.

Vectors are compared within one label (and one length). With t the angle of the least cosine:

1. Balls: vectors join a leader within t/2, in chunks of bounded size, so all vectors of a ball are linked with one another and a group
   of copies of any size becomes one ball. Leaders meet again in later rounds; a ball joins another whole if it stays within t/2.
2. Shards: each leader goes to its nearest few of the centroids, which are a bounded sample of rows, drawn by a hash over the
   whole table; a shard that holds too many leaders is cut again about some of them. Each shard builds a robust-pruned graph; the
   adjacency lists of a leader from all its shards are united.
3. Each leader is searched in its nearest shard, beside the neighbours that the united lists bring in: greedily from the
   medoid, then expanding over all that lies in range, which is t plus both balls' radii.
4. Two balls whose angle and radii decide for all pairs are linked or left whole; of the others, each vector is compared with
   the leader, and only where that does not decide, with the ball's vectors in packed blocks, by cosine in double precision. A
   block travels once for each pack of vectors that ask it.
5. Counts are sums of ball sizes and of such comparisons; components come from links between balls.

recall() audits the links of a stated set of vectors against all rows in blocks.

Nulls: a null label or vector, a zero vector, and one with null or non-finite components link with nothing. A null vec_id is
carried. Repeated rows are vectors of their own, linked with cosine 1. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from . import textkit as K
from .jaccard import closed

#: Angles this close to a bound are decided by the cosine itself.
SLACK = 1e-6


@dataclass(frozen=True)
class Params:
    """centroids: sampled rows, about so many at most; per_centroid: rows for each wished; shard: leaders beyond which a shard is cut again;
    overlap: shards a leader is in; chunk: rows that meet at most on average; pack: vectors that ask one copy of a block."""

    cosine: float = 0.98
    centroids: int = 4096
    per_centroid: int = 1000
    shard: int = 8192
    overlap: int = 6
    chunk: int = 512
    pack: int = 2048
    rounds: int = 3
    degree: int = 24
    pool: int = 64
    beam: int = 32
    alpha: float = 1.2

    @property
    def angle(self) -> float:
        return math.acos(self.cosine)


def unit(column) -> tuple[list[bytes | None], np.ndarray]:
    """Unit vectors as float64 bytes (None for unusable ones), and their lengths."""
    out, dims = [], []
    for v in column.to_pylist():
        x = np.array([math.nan if c is None else c for c in v], np.float64) if v is not None else np.zeros(0)
        with np.errstate(over="ignore", invalid="ignore"):
            top = np.abs(x).max() if len(x) else 0.0
            if not np.isfinite(top) or top == 0:
                out.append(None)
                dims.append(0)
                continue
            x = x / top
            x = x / np.sqrt(x @ x)
        out.append(x.tobytes())
        dims.append(len(x))
    return out, np.array(dims, np.int32)


def prepared(vectors, spark):
    """Saved rows (vec_id, seq, space, vec): space names label and length, null for vectors that link with nothing."""

    def run(batches):
        from pyspark import TaskContext

        seq = TaskContext.get().partitionId() << 33
        for batch in batches:
            vec, dims = unit(batch.column("embedding"))
            labels = batch.column("label").to_pylist()
            space = [None if v is None or k is None else f"{k}/{d}" for v, k, d in zip(vec, labels, dims.tolist())]
            n = len(vec)
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id").cast(pa.int64()), "seq": pa.array(np.arange(seq, seq + n)), "space": pa.array(space, pa.string()), "vec": pa.array(vec, pa.binary())})
            seq += n

    return K.saved(vectors.select("vec_id", "embedding", "label").mapInArrow(K.tidy(run), "vec_id long, seq long, space string, vec binary"), spark, "vectors")


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def stacked(vecs: list[bytes]) -> np.ndarray:
    """Vectors of one length as the rows of a matrix."""
    return np.frombuffer(b"".join(vecs)).reshape(len(vecs), -1)


def by_length(vecs: list[bytes]):
    """(indices, matrix) of the vectors of each length."""
    size = np.fromiter(map(len, vecs), np.int64, len(vecs))
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        yield rows, stacked([vecs[i] for i in rows.tolist()])


def gaps(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """The angle of each vector to its partner."""
    out = np.zeros(len(a))
    for rows, x in by_length(a):
        out[rows] = np.arccos(np.clip(np.einsum("ij,ij->i", x, stacked([b[i] for i in rows.tolist()])), -1.0, 1.0))
    return out


def chosen_centroids(rows, p: Params) -> dict[str, np.ndarray]:
    """Of each space, vectors drawn by a hash over the whole table that lie apart by more than the angle; about p.centroids at most, and one a space."""
    usable = rows.where("space is not null")
    total = usable.count()
    want = min(p.centroids, max(64, total // p.per_centroid))
    sample = usable.where(F.pmod(F.xxhash64("seq", F.lit(29)), F.lit(max(1, total // want))) == 0).select("space", "vec").collect()
    seen = {r[0] for r in sample}
    if total:
        sample += [r for r in usable.groupBy("space").agg(F.min_by("vec", "seq").alias("vec")).limit(p.centroids).collect() if r[0] not in seen]
    found: dict[str, list[bytes]] = {}
    for space, vec in sample:
        found.setdefault(space, []).append(vec)
    out = {}
    for space, vecs in found.items():
        x, kept = stacked(vecs), []
        near = np.zeros(len(x), bool)
        for i in range(len(x)):
            if not near[i]:
                kept.append(i)
                near |= x @ x[i] >= p.cosine
        out[space] = x[kept]
    return out


def _nearest(x: np.ndarray, centroids: np.ndarray | None, k: int) -> np.ndarray:
    """The k nearest centroids of each row, nearest first."""
    if centroids is None or len(centroids) == 1:
        return np.zeros((len(x), 1), np.int64)
    k = min(k, len(centroids))
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 1024):
        score = -(x[a : a + 1024] @ centroids.T)
        part = np.argpartition(score, k - 1, 1)[:, :k] if k < len(centroids) else np.broadcast_to(np.arange(k), score.shape)
        out[a : a + 1024] = np.take_along_axis(part, np.argsort(np.take_along_axis(score, part, 1), 1, kind="stable"), 1)
    return out


def _by_space(batch):
    """(space, indices, matrix) of a batch's rows."""
    spaces, vecs = np.array(batch.column("space").to_pylist(), object), batch.column("vec").to_pylist()
    for space in set(spaces.tolist()):
        rows = np.flatnonzero(spaces == space)
        yield space, rows, stacked([vecs[i] for i in rows.tolist()])


def _groups(batches, keys):
    held, last = [], None
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if held and key != last:
                yield last, held
                held = []
            last = key
            held.append(row)
    if held:
        yield last, held


BALL = "space string, seq long, vec binary, radius double, ball long"


def meet(leaders, shared, p: Params, r: int, partitions: int):
    """leaders(space, seq, vec, radius): each with the ball that it joins (its own seq if it leads one). shared: the broadcast centroids."""

    def cell(batches):
        for batch in batches:
            at = np.zeros(batch.num_rows, np.int32)
            for space, rows, x in _by_space(batch):
                at[rows] = _nearest(x, shared.value.get(space), 1)[:, 0]
            yield batch.append_column("cell", pa.array(at))

    placed = leaders.select("space", "seq", "vec", "radius").mapInArrow(K.tidy(cell), "space string, seq long, vec binary, radius double, cell int")
    large = placed.groupBy("space", "cell").count().where(F.col("count") > p.chunk)
    chunked = placed.join(large, ["space", "cell"], "left").withColumn("chunk", F.coalesce(F.pmod(F.xxhash64("seq", F.lit(r)), F.ceil(F.col("count") / p.chunk)), F.lit(0))).drop("count")

    def run(batches):
        for _, rows in _groups(batches, ("space", "cell", "chunk")):
            rows.sort(key=lambda x: x["seq"])
            x, radius = stacked([v["vec"] for v in rows]), np.array([v["radius"] for v in rows])
            ball = np.full(len(rows), -1)
            for i in range(len(rows)):
                if ball[i] < 0:
                    free = np.flatnonzero(ball < 0)
                    near = angles(x[i][None], x[free])[0] + radius[free] <= p.angle / 2 - SLACK
                    ball[free[near]] = i
                    ball[i] = i
            seq = np.array([v["seq"] for v in rows])
            yield pa.RecordBatch.from_pydict({"space": [v["space"] for v in rows], "seq": pa.array(seq), "vec": pa.array([v["vec"] for v in rows], pa.binary()), "radius": pa.array(radius), "ball": pa.array(seq[ball])})

    return chunked.repartition(partitions, "space", "cell", "chunk").sortWithinPartitions("space", "cell", "chunk").mapInArrow(K.tidy(run), BALL)


def robust_prune(x: np.ndarray, p: Params, seed: int) -> list[np.ndarray]:
    """A directed graph on x: of each point's pool (nearest and some random points), kept ones hide those alpha times nearer to them."""
    n = len(x)
    k = min(n - 1, p.pool)
    if k <= 0:
        return [np.zeros(0, np.int64) for _ in range(n)]
    rng, out = np.random.default_rng(seed), []
    for a in range(0, n, 1024):
        d = 1.0 - x[a : a + 1024] @ x.T
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        near = np.argpartition(d, k - 1, 1)[:, :k]
        for i in range(len(d)):
            pool = np.union1d(near[i], rng.integers(0, n, 8))
            pool = pool[pool != a + i]
            pool = pool[np.argsort(d[i, pool], kind="stable")]
            mine, between = np.sqrt(2 * np.maximum(d[i, pool], 0)), np.sqrt(np.maximum(2 - 2 * x[pool] @ x[pool].T, 0))
            alive, kept = np.ones(len(pool), bool), []
            for j in range(len(pool)):
                if alive[j]:
                    kept.append(pool[j])
                    if len(kept) == p.degree:
                        break
                    alive &= p.alpha * between[j] > mine
            out.append(np.array(kept, np.int64))
    back: list[list[int]] = [[] for _ in range(n)]
    for i, own in enumerate(out):
        for j in own[: p.degree // 2]:
            back[j].append(i)
    return [np.union1d(o, np.array(b[: p.degree], np.int64)) if b else o for o, b in zip(out, back)]


SHARD = "space string, seq long, vec binary, radius double, members long, shard long, home boolean"
#: Cuts of one shard; its number is a multiple of this plus the cut.
CUTS = 1 << 20


def sharded(leaders, shared, p: Params):
    """A row a leader and shard; home: is the shard its nearest."""

    def run(batches):
        for batch in batches:
            for space, rows, x in _by_space(batch):
                near = _nearest(x, shared.value.get(space), p.overlap)
                take = pa.array(np.repeat(rows, near.shape[1]))
                columns = [batch.column(c).take(take) for c in ("space", "seq", "vec", "radius", "members")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(near.ravel() * CUTS), pa.array(np.tile(np.arange(near.shape[1]) == 0, len(rows)))], [c.split()[0] for c in SHARD.split(", ")])

    return leaders.select("space", "seq", "vec", "radius", "members").mapInArrow(K.tidy(run), SHARD)


def divided(shards, p: Params, partitions: int):
    """Shards of more than p.shard leaders are cut about heads, a hash sample of their own leaders; each leader goes to the nearest two cuts."""
    large = shards.groupBy("space", "shard").agg(F.count("*").alias("size")).where(F.col("size") > p.shard)
    if not large.head(1):
        return shards
    every = F.greatest(F.lit(max(1, p.shard // 4)), F.ceil(F.col("size") / p.centroids))
    marked = shards.join(large.withColumn("salts", F.ceil(F.col("size") / (8 * p.shard))), ["space", "shard"], "left")
    rest, big = marked.where("size is null").drop("size", "salts"), marked.where("size is not null")
    heads = big.where(F.pmod(F.xxhash64("seq", F.lit(5)), every) == 0).groupBy("space", "shard").agg(F.array_sort(F.collect_list("vec")).alias("heads"), F.max("salts").alias("salts"))
    heads = heads.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1))).drop("salts")
    rows = big.withColumn("salt", F.pmod(F.xxhash64("seq"), "salts")).drop("size", "salts")
    both = rows.unionByName(heads, allowMissingColumns=True).repartition(partitions, "space", "shard", "salt").sortWithinPartitions("space", "shard", "salt", F.asc_nulls_first("seq"))
    names = [c.split()[0] for c in SHARD.split(", ")]

    def run(batches):
        key, own = None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("space", "shard", "salt"))))
            cuts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            for a, b in zip(cuts, [*cuts[1:], len(keys)]):
                if keys[a] != key:
                    key, own = keys[a], None
                if not batch.column("seq")[a].is_valid:
                    own = stacked(batch.column("heads")[a].as_py())
                    a += 1
                if a == b:
                    continue
                part = table.slice(a, b - a).combine_chunks().to_batches()[0]
                near = _nearest(stacked(part.column("vec").to_pylist()), own, 2)
                take = pa.array(np.repeat(np.arange(b - a), near.shape[1]))
                first = np.tile(np.arange(near.shape[1]) == 0, b - a)
                home = part.column("home").take(take).to_numpy(zero_copy_only=False) & first
                columns = [part.column(c).take(take) for c in names[:5]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(key[1] + 1 + near.ravel()), pa.array(home)], names)

    return rest.unionByName(both.mapInArrow(K.tidy(run), SHARD))


def adjacency(shards, p: Params, partitions: int):
    """(seq, near): united adjacency lists of all shards; at most overlap times twice the degree long."""

    def run(batches):
        for key, rows in _groups(batches, ("space", "shard")):
            seq = np.array([r["seq"] for r in rows])
            graph = robust_prune(stacked([r["vec"] for r in rows]), p, int(key[1]))
            yield pa.RecordBatch.from_pydict({"seq": pa.array(seq), "near": pa.array([seq[g].tolist() for g in graph], pa.list_(pa.int64()))})

    lists = shards.select("space", "shard", "seq", "vec").repartition(partitions, "space", "shard").sortWithinPartitions("space", "shard", "seq").mapInArrow(K.tidy(run), "seq long, near array<long>")
    return lists.groupBy("seq").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"))


def range_search(x: np.ndarray, graph: list[np.ndarray], radius: np.ndarray, query: int, medoid: int, p: Params) -> np.ndarray:
    """Points within the angle plus both radii of the query: greedy from the medoid, then expanding while in range."""
    q, widest = x[query], float(radius.max())
    seen = np.zeros(len(x), bool)
    seen[medoid] = True
    ids, dist, expanded = [medoid], [float(1 - x[medoid] @ q)], set()
    while True:
        best = sorted(zip(dist, ids))[: p.beam]
        step = [i for _, i in best if i not in expanded][:4]
        if not step:
            break
        expanded.update(step)
        new = np.unique(np.concatenate([graph[i] for i in step]))
        new = new[~seen[new]]
        seen[new] = True
        ids += new.tolist()
        dist += (1 - x[new] @ q).tolist()
        keep = sorted(zip(dist, ids))[: 4 * p.beam]
        if keep[0][0] <= 1e-15:  # the query itself is reached
            break
    found = np.array(ids)
    reach = p.angle + radius[query] + SLACK
    far = angles(x[found], q[None])[:, 0]
    hits = [found[far <= reach + radius[found]]]
    frontier = found[far <= reach + widest]
    while len(frontier):
        new = np.unique(np.concatenate([graph[i] for i in frontier]))
        new = new[~seen[new]]
        seen[new] = True
        far = angles(x[new], q[None])[:, 0] if len(new) else np.zeros(0)
        hits.append(new[far <= reach + radius[new]])
        frontier = new[far <= reach + widest]
    out = np.concatenate(hits)
    return out[out != query]


PAIR = "a long, b long, angle double"


def searched(shards, near, p: Params, partitions: int):
    """Pairs (a, b) of balls whose vectors may be linked, a searched in its nearest shard."""
    member = shards.join(near, "seq", "left").select("space", "shard", "seq", "vec", "radius", "home", F.coalesce("near", F.array().cast("array<long>")).alias("near"))
    brought = member.where("home").select("space", "shard", F.explode("near").alias("seq")).distinct().join(shards.where("home").select("seq", "vec", "radius"), "seq")
    halo = brought.join(shards.select("space", "shard", "seq"), ["space", "shard", "seq"], "left_anti").select("space", "shard", "seq", "vec", "radius", F.lit(False).alias("home"), F.array().cast("array<long>").alias("near"))

    def run(batches):
        for _, rows in _groups(batches, ("space", "shard")):
            seq = np.array([r["seq"] for r in rows])
            x, radius = stacked([r["vec"] for r in rows]), np.array([r["radius"] for r in rows])
            place = {s: i for i, s in enumerate(seq.tolist())}
            graph = [np.array([place[s] for s in r["near"] if s in place], np.int64) for r in rows]
            middle = x.mean(0)
            medoid = int(np.argmax(x @ middle))
            out = {"a": [], "b": [], "angle": []}
            for i, r in enumerate(rows):
                if r["home"]:
                    hits = range_search(x, graph, radius, i, medoid, p)
                    out["a"] += [r["seq"]] * len(hits)
                    out["b"] += seq[hits].tolist()
                    out["angle"] += angles(x[hits], x[i][None])[:, 0].tolist() if len(hits) else []
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("a", pa.int64()), ("b", pa.int64()), ("angle", pa.float64())]))

    found = member.unionByName(halo).repartition(partitions, "space", "shard").sortWithinPartitions("space", "shard", "seq").mapInArrow(K.tidy(run), PAIR)
    return found.union(found.select("b", "a", "angle")).groupBy("a", "b").agg(F.min("angle").alias("angle"))


def against_members(asking, members, p: Params, partitions: int):
    """(seq, ball, b, n): how many of the vectors of ball b are linked to each asking(seq, ball, b, mb, vec); mb: members of b.

    Blocks of bounded size hold the vectors of a ball. A block travels once for each pack of vectors that ask its ball, in front of them.
    """
    number = lambda count: F.ceil(count / p.chunk)
    packs = asking.groupBy("b").agg(F.ceil(F.count("*") / p.pack).alias("packs"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
    blocks = members.withColumn("block", F.pmod(F.xxhash64("seq"), number(F.col("members")))).join(packs.withColumnRenamed("b", "ball"), "ball")
    blocks = blocks.groupBy(F.col("ball").alias("b"), "block").agg(F.collect_list("vec").alias("vecs"), F.max("packs").alias("packs")).withColumn("pack", each(F.col("packs"))).drop("packs")
    rows = asking.join(packs, "b").withColumn("pack", F.pmod(F.xxhash64("seq"), "packs")).withColumn("block", each(number(F.col("mb")))).drop("packs", "mb")
    both = rows.unionByName(blocks, allowMissingColumns=True).repartition(partitions, "b", "block", "pack").sortWithinPartitions("b", "block", "pack", F.asc_nulls_first("seq"))

    def run(batches):
        key, block = None, None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("b", "block", "pack"))))
            vecs = batch.column("vec").to_pylist()
            n = np.zeros(len(keys), np.int64)
            cuts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            for a, b in zip(cuts, [*cuts[1:], len(keys)]):
                if keys[a] != key:
                    key, block = keys[a], None
                if not batch.column("seq")[a].is_valid:
                    block = stacked(batch.column("vecs")[a].as_py())
                    a += 1
                if block is not None:  # a hash may leave a block empty
                    for at in range(a, b, 1024):
                        end = min(b, at + 1024)
                        n[at:end] = (stacked(vecs[at:end]) @ block.T >= p.cosine).sum(1)
            some = pa.array(np.flatnonzero(n))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(some) for c in ("seq", "ball", "b")), pa.array(n).take(some)], ["seq", "ball", "b", "n"])

    return both.mapInArrow(K.tidy(run), "seq long, ball long, b long, n long").groupBy("seq", "ball", "b").agg(F.sum("n").alias("n"))


def near_duplicates(vectors, p: Params = Params()):
    """vec_id, n_links, component_id and kept of every row of vectors(vec_id, embedding, label)."""
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = prepared(vectors, spark)
    shared = spark.sparkContext.broadcast(chosen_centroids(rows, p))  # a bounded sample
    usable = rows.where("space is not null")
    # Balls: a vector's ball is where its chain of leaders ends; its angle to that leader is measured again.
    leaders, chain = usable.select("space", "seq", "vec", F.lit(0.0).alias("radius")), usable.select("seq", F.col("seq").alias("ball"))
    for r in range(p.rounds):
        again = K.saved(meet(leaders, shared, p, r, parts), spark, "balls")
        chain = chain.join(again.select(F.col("seq").alias("ball"), F.col("ball").alias("to")), "ball").select("seq", F.col("to").alias("ball"))
        heads = again.where("seq = ball").select(F.col("seq").alias("ball"), F.col("vec").alias("lead"))
        measured = chain.join(usable.select("seq", "space", "vec"), "seq").join(heads, "ball")

        def gap(batches):
            for batch in batches:
                far = gaps(batch.column("vec").to_pylist(), batch.column("lead").to_pylist())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("seq", "space", "vec", "ball")), pa.array(far)], ["seq", "space", "vec", "ball", "gap"])

        members = K.saved(measured.select("seq", "space", "vec", "ball", "lead").mapInArrow(K.tidy(gap), "seq long, space string, vec binary, ball long, gap double"), spark, "members")
        chain = members.select("seq", "ball")
        sizes = members.groupBy("ball").agg(F.max("gap").alias("radius"), F.count("*").alias("members"))
        leaders = K.saved(again.where("seq = ball").select("space", "seq", "vec").join(sizes.withColumnRenamed("ball", "seq"), "seq"), spark, "leaders")
    shards = K.saved(divided(K.saved(sharded(leaders, shared, p), spark, "shards"), p, parts), spark, "shards")
    near = K.saved(adjacency(shards, p, parts), spark, "graph")
    pairs = K.saved(searched(shards, near, p, parts), spark, "ball-pairs")
    info = leaders.select("seq", "radius", "members")
    sized = pairs.join(info.select(F.col("seq").alias("a"), F.col("radius").alias("ra")), "a").join(info.select(F.col("seq").alias("b"), F.col("radius").alias("rb"), F.col("members").alias("mb")), "b")
    whole = F.col("angle") + F.col("ra") + F.col("rb") <= p.angle - SLACK
    whole_links = sized.where(whole).groupBy(F.col("a").alias("ball")).agg(F.sum("mb").alias("whole"))
    open_ = sized.where(~whole).select(F.col("a").alias("ball"), "b", "rb", "mb")
    asked = members.select("seq", "vec", "ball").join(open_, "ball").join(leaders.select(F.col("seq").alias("b"), F.col("vec").alias("lead")), "b")

    def decide(batches):
        for batch in batches:
            far = gaps(batch.column("vec").to_pylist(), batch.column("lead").to_pylist())
            rb, mb = batch.column("rb").to_numpy(), batch.column("mb").to_numpy()
            keep = np.flatnonzero(far - rb <= p.angle + SLACK)
            sure = np.where(far + rb <= p.angle - SLACK, mb, 0)[keep]
            take = pa.array(keep)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("seq", "ball", "b", "mb", "vec")), pa.array(sure)], ["seq", "ball", "b", "mb", "vec", "sure"])

    decided = K.saved(asked.select("seq", "ball", "b", "vec", "lead", "rb", "mb").mapInArrow(K.tidy(decide), "seq long, ball long, b long, mb long, vec binary, sure long"), spark, "decided")
    sized_members = members.join(info.select(F.col("seq").alias("ball"), "members"), "ball")
    compared = against_members(decided.where("sure = 0").select("seq", "ball", "b", "mb", "vec"), sized_members, p, parts)
    opened = K.saved(compared.union(decided.where("sure > 0").select("seq", "ball", "b", F.col("sure").alias("n"))), spark, "opened")
    single = opened.groupBy("seq").agg(F.sum("n").alias("single"))
    edges = sized.where(whole).select(F.col("a"), F.col("b")).union(opened.select(F.col("ball").alias("a"), "b"))
    roots = closed(edges, spark).select(F.col("a").alias("ball"), "root")
    counted = members.select("seq", "ball").join(info.select(F.col("seq").alias("ball"), "members"), "ball").join(whole_links, "ball", "left").join(single, "seq", "left").join(roots, "ball", "left")
    counted = counted.select("seq", F.coalesce("root", "ball").alias("root"), (F.col("members") - 1 + F.coalesce("whole", F.lit(0)) + F.coalesce("single", F.lit(0))).alias("links"))
    named = rows.select("vec_id", "seq").join(counted, "seq", "left")
    least = named.where("root is not null").groupBy("root").agg(F.min("vec_id").alias("least"))
    out = named.join(least, "root", "left")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("least", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def recall(vectors, result, p: Params = Params(), every: int = 50) -> float:
    """Share of the true links of every `every`-th vec_id that result counts, by comparison with all rows in blocks."""
    spark = vectors.sparkSession
    rows = prepared(vectors, spark).where("space is not null")
    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "seq", "space", "vec")
    packed = asked.withColumn("block", F.floor(F.col("vec_id") / (every * 256))).groupBy("space", "block").agg(F.collect_list(F.struct("vec_id", "seq", "vec")).alias("asked"))
    blocks = rows.withColumn("row_block", F.pmod(F.xxhash64("seq"), F.lit(64))).groupBy("space", "row_block").agg(F.collect_list(F.struct("seq", "vec")).alias("all"))

    def run(batches):
        for batch in batches:
            for asked_, all_ in zip(batch.column("asked").to_pylist(), batch.column("all").to_pylist()):
                x, y = np.stack([np.frombuffer(r["vec"]) for r in asked_]), np.stack([np.frombuffer(r["vec"]) for r in all_])
                n = ((x @ y.T >= p.cosine) & (np.array([r["seq"] for r in asked_])[:, None] != np.array([r["seq"] for r in all_])[None])).sum(1)
                yield pa.RecordBatch.from_pydict({"vec_id": pa.array([r["vec_id"] for r in asked_], pa.int64()), "true_links": pa.array(n.astype(np.int64))})

    truth = packed.join(blocks, "space").mapInArrow(run, "vec_id long, true_links long").groupBy("vec_id").agg(F.sum("true_links").alias("true_links"))
    got = truth.join(result.select("vec_id", "n_links"), "vec_id").agg(F.sum(F.least("n_links", "true_links")), F.sum("true_links")).first()
    return 1.0 if not got[1] else got[0] / got[1]


def op7_pruned_graph(spark, sf_dir):
    """Links, component and verdict of every vector of `embeddings`."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
