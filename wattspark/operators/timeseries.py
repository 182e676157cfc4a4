"""Ordered-series operators: gaps, grids, as-of values, padded frames, islands and folds.

A series has a channel column, an order column k (BIGINT) and a value x (DOUBLE). Every operator partitions by channel; frame
operators can also cut a channel into blocks with a halo, so that one channel of any length spreads over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: str | Column) -> Column:
    """A timestamp (with or without zone; UTC session) as BIGINT microseconds."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def split_on_gaps(df: DataFrame, channel: str, t: str, max_gap: int, order: Sequence[str] = ()) -> DataFrame:
    """Adds run: a new one where the step exceeds max_gap (strictly). Runs of one reading go before numbering (TS-01)."""
    w = Window.partitionBy(channel).orderBy(t, *order)
    broken = df.withColumn("_new", F.coalesce((F.col(t) - F.lag(t).over(w) > max_gap).cast("int"), F.lit(0)))
    raw = broken.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    alone = (F.coalesce(F.lag("_run").over(w) != F.col("_run"), F.lit(True))) & (F.coalesce(F.lead("_run").over(w) != F.col("_run"), F.lit(True)))
    kept = raw.withColumn("_alone", alone).where(~F.col("_alone"))
    return kept.withColumn("run", (F.dense_rank().over(Window.partitionBy(channel).orderBy("_run")) - 1).cast("long")).drop("_new", "_run", "_alone")


def runs(df: DataFrame, channel: str, t: str, max_gap: int, order: Sequence[str] = ()) -> DataFrame:
    """One row a run: start, stop and n."""
    return split_on_gaps(df, channel, t, max_gap, order).groupBy(channel, "run").agg(F.min(t).alias("start"), F.max(t).alias("stop"), F.count("*").alias("n"))


def asof_backward(left: DataFrame, right: DataFrame, keys: Sequence[str], t: str, values: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """left with the values of the newest right row at or before t within equal keys (JN-03).

    One union and one window: no range join. `tie` orders right rows of equal t; the last wins.
    """
    packed = F.struct(*values)
    tie_type = [F.col(c) for c in tie]
    l = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(right.select(packed.alias("v")).schema["v"].dataType)})
    r = right.select(*keys, t, F.lit(0).alias("_side"), packed.alias("_v"), *(c.alias(f"_tie{i}") for i, c in enumerate(tie_type)))
    w = Window.partitionBy(*keys).orderBy(t, "_side", *(f"_tie{i}" for i in range(len(tie)))).rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r, allowMissingColumns=True)
    out = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return out.select(*left.columns, *(F.col(f"_v.{v}").alias(v) for v in values))


def asof_or_first(left: DataFrame, right: DataFrame, keys: Sequence[str], t: str, values: Sequence[str]) -> DataFrame:
    """As-of backward; before the first entry, the first one holds (a configuration log)."""
    found = asof_backward(left, right, keys, t, values)
    earliest = right.groupBy(*keys).agg(F.min_by(F.struct(*values), t).alias("_first"))
    return found.join(earliest, list(keys), "left").select(*left.columns, *(F.coalesce(F.col(v), F.col(f"_first.{v}")).alias(v) for v in values))


def forward_fill_to_grid(df: DataFrame, channel: str, t: str, value: str, step: int, run: str = "run") -> DataFrame:
    """Each run on the grid start, start + step, ...; the value at a point is the last at or before it (TS-02)."""
    spans = df.groupBy(channel, run).agg(F.min(t).alias("_a"), F.max(t).alias("_b"))
    grid = spans.select(channel, run, F.explode(F.expr(f"sequence(0L, (_b - _a) div {step})")).alias("k"), "_a").select(channel, run, "k", (F.col("_a") + F.col("k") * step).alias(t))
    return asof_backward(grid, df, [channel, run], t, [value])


def with_index(df: DataFrame, channel: str, order: Sequence[str]) -> DataFrame:
    """Adds k: the position within the channel."""
    return df.withColumn("k", (F.row_number().over(Window.partitionBy(channel).orderBy(*order)) - 1).cast("long"))


def in_blocks(df: DataFrame, channel: str, before: int, after: int, block: int) -> DataFrame:
    """Rows in blocks of k with what a frame [-before, after] needs from both neighbours; _core marks a block's own rows."""
    at = F.floor(F.col("k") / block)
    places = F.sequence(F.floor((F.col("k") - after) / block), F.floor((F.col("k") + before) / block))
    return df.withColumn("_block", F.explode(places)).withColumn("_core", F.col("_block") == at)


def frame_stats(df: DataFrame, channel: str, value: str, frames: dict[str, tuple[int, int]], block: int | None = None) -> DataFrame:
    """Adds {name}_mean and {name}_var over row frames; rows that miss are the edge value, the variance is E[x^2]-E[x]^2, at least 0 (TS-03, TS-04).

    Sums are of differences from the channel's first value, so that large levels cost no digits.
    """
    ends = df.groupBy(channel).agg(F.min_by(value, "k").alias("_first"), F.max_by(value, "k").alias("_last"))
    rows = df.join(ends, channel)
    keys = [channel]
    if block:
        rows = in_blocks(rows, channel, max(-a for a, _ in frames.values()), max(b for _, b in frames.values()), block)
        keys.append("_block")
    w = Window.partitionBy(*keys).orderBy("k")
    x = F.col(value) - F.col("_first")
    last = F.col("_last") - F.col("_first")
    for name, (a, b) in frames.items():
        f, size = w.rowsBetween(a, b), b - a + 1
        missing = F.lit(size) - F.count(F.lit(1)).over(f)
        edge = F.when(F.lit(b <= 0), F.lit(0.0)).otherwise(last) if (b <= 0 or a >= 0) else None
        if edge is None:
            raise ValueError("a frame lies on one side of its row")
        mean = (F.coalesce(F.sum(x).over(f), F.lit(0.0)) + missing * edge) / size
        square = (F.coalesce(F.sum(x * x).over(f), F.lit(0.0)) + missing * edge * edge) / size
        rows = rows.withColumn(f"_{name}_m", mean).withColumn(f"{name}_var", F.greatest(square - F.col(f"_{name}_m") * F.col(f"_{name}_m"), F.lit(0.0)))
    if block:
        rows = rows.where("_core").drop("_core", "_block")
    for name in frames:
        rows = rows.withColumn(f"{name}_mean", F.col(f"_{name}_m") + F.col("_first")).drop(f"_{name}_m")
    return rows.drop("_first", "_last")


def leading_edge(df: DataFrame, channel: str, mask: str, out: str = "edge") -> DataFrame:
    """True where the mask turns true (TS-12)."""
    return df.withColumn(out, F.col(mask) & ~F.lag(mask, 1, False).over(Window.partitionBy(channel).orderBy("k")))


def dilate(df: DataFrame, keys: Sequence[str], mask: str, align: int) -> DataFrame:
    """The mask's maximum within align rows to either side."""
    return df.withColumn(mask, F.max(F.col(mask).cast("int")).over(Window.partitionBy(*keys).orderBy("k").rowsBetween(-align, align)) == 1)


def islands(df: DataFrame, channel: str, mask: str) -> DataFrame:
    """Half-open spans [start, stop) of equal mask values, in order (TS-15)."""
    w = Window.partitionBy(channel).orderBy("k")
    changed = df.withColumn("_c", F.coalesce((F.col(mask) != F.lag(mask).over(w)).cast("int"), F.lit(0)))
    return changed.withColumn("_g", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(channel, "_g").agg(F.min("k").alias("start"), (F.max("k") + 1).alias("stop"), F.first(mask).alias(mask)).drop("_g")


def spans_of(df: DataFrame, channel: str, mask: str) -> DataFrame:
    return islands(df, channel, mask).where(F.col(mask)).select(channel, "start", "stop")


def scanned(rows: DataFrame, channel: str, value: str | None, start: Callable[[], object], step: Callable) -> DataFrame:
    """(channel, k) of the rows that step keeps, each channel from front to back in Arrow batches; a task holds a batch and one state.

    step(state, k, x) gives (positions kept, state) for the next stretch of a channel; x is None without a value column.
    """
    names = [channel, "k"] + [value] * (value is not None)
    kinds = dict(rows.select(channel).dtypes)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        last, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            name, k = batch.column(0), batch.column(1).to_numpy()
            x = batch.column(2).to_numpy(zero_copy_only=False) if value is not None else None
            code = pc.fill_null(name.dictionary_encode().indices, -1).to_numpy()
            cuts = [0, *((code[1:] != code[:-1]).nonzero()[0] + 1).tolist(), len(code)]
            kept = []
            for a, b in zip(cuts, cuts[1:]):
                here = (name[a].as_py(),)
                if here != last:
                    last, state = here, start()
                found, state = step(state, k[a:b], None if x is None else x[a:b])
                kept += [a + i for i in found]
            yield pa.RecordBatch.from_arrays([c.take(pa.array(kept, pa.int64())) for c in batch.columns[:2]], [channel, "k"])

    dealt = rows.select(*names).withColumn("k", F.col("k").cast("long")).repartition(channel).sortWithinPartitions(channel, "k")
    return dealt.mapInArrow(run, f"`{channel}` {kinds[channel]}, k long")


def suppressed(events: DataFrame, channel: str, min_gap: int) -> DataFrame:
    """Greedy: an event stays if it lies at least min_gap after the last that stayed (TS-11). events(channel, k), true events alone."""
    if min_gap <= 1:
        return events.select(channel, "k")

    def step(last, k, _):
        import numpy as np

        at, kept = 0 if last is None else int(np.searchsorted(k, last + min_gap)), []
        while at < len(k):
            kept.append(at)
            last = int(k[at])
            at = int(np.searchsorted(k, last + min_gap))
        return kept, last

    return scanned(events, channel, None, lambda: None, step)


def close_short_runs(runs_df: DataFrame, channel: str, mask: str, min_length: int) -> DataFrame:
    """Left to right, a run shorter than min_length takes the value that the run before it has by then; the first never changes (TS-14).

    So each run has the value of the last run up to it that is long enough or first.
    """
    w = Window.partitionBy(channel).orderBy("start")
    holds = (F.col("stop") - F.col("start") >= min_length) | (F.row_number().over(w) == 1)
    held = runs_df.withColumn("_held", F.when(holds, F.struct(F.col(mask).alias("on"))))
    value = F.last("_held", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))["on"]
    return held.select(channel, "start", "stop", value.alias(mask))


def segments(events: DataFrame, lengths: DataFrame, channel: str, min_length: int = 1) -> DataFrame:
    """Cuts [0, n) of each channel (lengths: channel, n) at its events; segments of at least min_length, none empty (TS-16)."""
    points = events.select(channel, "k").unionByName(lengths.select(channel, F.lit(0).cast("long").alias("k"))).distinct()
    w = Window.partitionBy(channel).orderBy("k")
    cut = points.join(lengths, channel).where("k < n").withColumn("stop", F.coalesce(F.lead("k").over(w), F.col("n")))
    return cut.where(F.col("stop") - F.col("k") >= max(1, min_length)).select(channel, F.col("k").alias("start"), "stop")


def transitions(df: DataFrame, channel: str, value: str, threshold: float) -> DataFrame:
    """Samples where value > threshold changes: the first changed sample (TS-17)."""
    on = F.col(value) > threshold
    return df.withColumn("_on", on).withColumn("_was", F.lag("_on").over(Window.partitionBy(channel).orderBy("k"))).where("_was is not null and _on != _was").select(channel, "k", F.col("_on").alias("turned_on"))


def longest_run(df: DataFrame, channel: str, value: str, low: float = 0.2, high: float = 0.999, level: float = 0.25, least: int = 1) -> DataFrame:
    """The longest interior span above base + level * (peak - base), by exact percentiles (TS-18, AG-11, AG-12)."""
    bounds = df.groupBy(channel).agg(F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("_p"), F.max("k").alias("_n"))
    marked = df.join(bounds, channel).withColumn("on", F.col(value) > F.col("_p")[0] + level * (F.col("_p")[1] - F.col("_p")[0]))
    spans = spans_of(marked, channel, "on").join(bounds.select(channel, "_n"), channel).where((F.col("start") > 0) & (F.col("stop") <= F.col("_n")) & (F.col("stop") - F.col("start") >= least))
    best = F.max_by(F.struct("start", "stop"), F.struct(F.col("stop") - F.col("start"), -F.col("start")))
    return spans.groupBy(channel).agg(best.alias("s")).select(channel, "s.start", "s.stop")


def demean_cycles(df: DataFrame, channel: str, value: str, period: int) -> DataFrame:
    """The value less its mean in its mains cycle; the rest at the end has a mean of its own (TS-19)."""
    return df.withColumn(value, F.col(value) - F.avg(value).over(Window.partitionBy(channel, F.floor(F.col("k") / period))))
