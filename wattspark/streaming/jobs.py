"""Structured Streaming forms of the series operators (ST-*).

Late rows: those older than the watermark are dropped; within it, order does not matter to windows, and stateful folds see a batch's rows in time order.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sessions(stream: DataFrame, channel: str, ts: str, gap: str, watermark: str = "1 day") -> DataFrame:
    """Gap-split runs: a step of exactly the gap stays within one. Runs of one reading are for the caller to drop."""
    w = F.session_window(ts, gap)
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark).groupBy(channel, w.alias("w")).agg(F.count("*").alias("n"), F.min(ts).alias("start"), F.max(ts).alias("stop")).drop("w")


def tumbling(stream: DataFrame, channel: str, ts: str, value: str, size: str, hop: str | None = None, watermark: str = "1 day") -> DataFrame:
    """Block means; with a hop, strided windows."""
    w = F.window(ts, size, hop) if hop else F.window(ts, size)
    out = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark).groupBy(channel, w.alias("w")).agg(F.avg(value).alias("p"), F.count("*").alias("n"))
    return out.select(channel, F.col("w.start").alias("start"), "p", "n")


def cusum(stream: DataFrame, channel: str, order: str, value: str, window: int = 64, threshold: float = 50.0, drift: float = 1.0) -> DataFrame:
    """CUSUM with constant state a channel: the window's values, both accumulators, the count; rows (channel, k)."""
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}

    limit = threshold * (1 + 1e-12)

    def step(key, batches, state: GroupState):
        recent, up, down, k = state.get if state.exists else ([], 0.0, 0.0, 0)
        x = pd.concat(list(batches)).sort_values(order)[value].to_numpy(float)
        # The window's values go before the new ones; before the first value of all, that value holds.
        series = np.concatenate([recent if len(recent) else np.full(window, x[0]), x])
        sums = np.cumsum(np.concatenate([[0.0], series - series[0]]))
        away = x - ((sums[window + 1 :] - sums[1:-window]) / window + series[0])
        out = []
        for at, d in enumerate(away.tolist(), k):
            up, down = max(up + d - drift, 0.0), max(down - d - drift, 0.0)
            if up > limit or down > limit:
                out.append(at)
                up = down = 0.0
        state.update((series[-window:].tolist(), up, down, k + len(x)))
        yield pd.DataFrame({channel: [key[0]] * len(out), "k": pd.Series(out, dtype="int64")})

    return stream.select(channel, order, value).groupBy(channel).applyInPandasWithState(step, f"{channel} {kinds[channel]}, k long", "recent array<double>, up double, down double, k long", "append", GroupStateTimeout.NoTimeout)


def folded(stream: DataFrame, channel: str, columns: list[str], out: str, state: str, start, step) -> DataFrame:
    """A fold of each channel with a small state: step(state, arrays of the columns, in the order of the first) gives a dict of new columns and the next state."""
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}

    def run(key, batches, held: GroupState):
        now = held.get if held.exists else start
        rows = pd.concat(list(batches)).sort_values(columns[0], kind="stable")
        found, after = step(now, *(rows[c].to_numpy() for c in columns))
        held.update(after)
        n = len(next(iter(found.values())))
        yield pd.DataFrame({channel: [key[0]] * n} | found)

    return stream.select(channel, *dict.fromkeys(columns)).groupBy(channel).applyInPandasWithState(run, f"{channel} {kinds[channel]}, {out}", state, "append", GroupStateTimeout.NoTimeout)


def spaced(fired: np.ndarray, last: int | None, gap: int) -> tuple[list[int], int | None]:
    """Greedy suppression of sorted positions: those at least gap after the last that stayed."""
    kept = []
    at = 0 if last is None else int(np.searchsorted(fired, last + gap))
    while at < len(fired):
        last = int(fired[at])
        kept.append(last)
        at = int(np.searchsorted(fired, last + gap))
    return kept, last


def zscore(stream: DataFrame, channel: str, order: str, value: str, window: int = 32, threshold: float = 4.0, min_gap: int = 8, min_delta: float = 0.0) -> DataFrame:
    """Causal z-score, suppressed; the state is the last window - 1 values, the count and the last event (ST-04). Rows (channel, k)."""
    limit = threshold + abs(threshold) * 1e-12

    def step(state, _, x):
        recent, k, last = state
        x = x.astype(float)
        series = np.concatenate([recent if len(recent) else np.full(window - 1, x[0]), x])
        d = series - series[0]
        one, two = (np.cumsum(np.concatenate([[0.0], y])) for y in (d, d * d))
        mean = (one[window:] - one[:-window]) / window
        std = np.sqrt(np.maximum((two[window:] - two[:-window]) / window - mean * mean, 0.0))
        far = np.abs(d[window - 1 :] - mean)
        kept, last = spaced(np.flatnonzero((far / np.maximum(std, 1e-6) > limit) & (far > min_delta)) + k, None if last < 0 else last, min_gap)
        return {"k": pd.Series(kept, dtype="int64")}, (series[len(series) - window + 1 :].tolist(), k + len(x), -1 if last is None else last)

    return folded(stream, channel, [order, value], "k long", "recent array<double>, k long, last long", ([], 0, -1), step)


def suppressed(stream: DataFrame, channel: str, position: str, min_gap: int) -> DataFrame:
    """Greedy suppression of a stream of events whose positions come in order; the state is the last event that stayed (ST-04)."""

    def step(state, k):
        kept, last = spaced(k, None if state[0] < 0 else state[0], min_gap)
        return {position: pd.Series(kept, dtype="int64")}, (-1 if last is None else last,)

    return folded(stream, channel, [position], f"{position} long", "last long", (-1,), step)


def cycles(stream: DataFrame, channel: str, order: str, v: str, i: str, cycle_size: int, tolerance: int) -> DataFrame:
    """Mains cycles of a stream of samples: (channel, start, v, i), both arrays of cycle_size points (ST-05).

    A cycle lies between neighbouring rising crossings of v whose distance in whole samples is within tolerance of cycle_size; start is the number of
    its first sample. The state holds the samples from the last crossing on, cycle_size + tolerance + 2 at most: a crossing further
    back than that can end no cycle and is forgotten.
    """
    keep = cycle_size + tolerance + 2

    def step(state, _, new_v, new_i):
        old_v, old_i, k = state
        a, b = np.concatenate([old_v, new_v.astype(float)]), np.concatenate([old_i, new_i.astype(float)])
        base = k - len(old_v)
        at = np.flatnonzero((a[:-1] < 0) & (a[1:] >= 0))
        shift = -a[at] / (a[at + 1] - a[at] + 1e-9)
        good = np.flatnonzero(np.abs(np.diff(at) - cycle_size) <= tolerance)
        begin, end = (at + shift)[good], (at + shift)[good + 1]
        grid = begin[:, None] + ((end - begin) / cycle_size)[:, None] * np.arange(cycle_size)
        points = [np.interp(grid, np.arange(len(x)), x).tolist() if len(good) else [] for x in (a, b)]
        from_ = max(int(at[-1]) if len(at) else len(a) - 1, len(a) - keep, 0)
        return {"start": pd.Series(at[good] + base, dtype="int64"), "v": points[0], "i": points[1]}, (a[from_:].tolist(), b[from_:].tolist(), k + len(new_v))

    return folded(stream, channel, [order, v, i], "start long, v array<double>, i array<double>", "v array<double>, i array<double>, k long", ([], [], 0), step)


def scratch(spark, name: str) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir, else in the warehouse; a temporary one on one machine without either."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="wattspark-") if spark.sparkContext.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def to_table(stream: DataFrame, name: str, mode: str, path: str | None = None) -> DataFrame:
    """Runs all that is there now and gives back what it wrote to Parquet under path: appended rows, or the whole of the last batch's result if complete."""
    spark, path = stream.sparkSession, path or scratch(stream.sparkSession, name)
    writer = stream.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{path}/rows")
    else:
        writer = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{path}/rows"))
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def to_parquet(stream: DataFrame, path: str, checkpoint: str):
    """The streaming writer: each micro-batch appends files."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
