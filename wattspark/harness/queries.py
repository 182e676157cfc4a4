"""The engine's operators on the driver's tables: one query each, with the SQL that a second engine can check it by.

Adapters: events are series (user = channel, value = x); embeddings are mains cycles (vector n = v, vector n + 1 = i); parts are channels (brand,
type = appliance); order lines are predictions and truths. Doubles are rounded at the end alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import align, arrays, labels
from ..functions import electrical as E
from ..operators import benchmark, detect, match, metrics, mixing, splits, targets, windows
from ..operators import timeseries as T
from ..plans import compat, store, views
from ..streaming import jobs

QUERIES: dict = {}
SQL: dict[str, str] = {}
DAY = 86_400_000_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r(c, n=5):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


# ---- adapter A: events as series
def series(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("channel_id"), T.micros("ts").alias("t"), F.col("value").alias("x"), "event_type", "event_id")
    return T.with_index(e, "channel_id", ["t", "event_id"])


EV = "ev AS (SELECT user_id AS channel_id, epoch_us(ts) AS t, value AS x, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events)"


def stats_sql(frames: dict[str, tuple[int, int]], source: str = "ev") -> str:
    """CTE st: frame means and variances with edge values for missing rows."""
    cols = []
    for n, (a, b) in frames.items():
        f = f"OVER (PARTITION BY channel_id ORDER BY k ROWS BETWEEN {-a} PRECEDING AND {f'{-b} PRECEDING' if b < 0 else 'CURRENT ROW' if b == 0 else f'{b} FOLLOWING'})" if a <= 0 else f"OVER (PARTITION BY channel_id ORDER BY k ROWS BETWEEN {a} FOLLOWING AND {b} FOLLOWING)"
        w, edge = b - a + 1, "0" if b <= 0 else "(xl - x0)"
        miss = f"({w} - count(*) {f})"
        cols.append(f"(coalesce(sum(x - x0) {f}, 0) + {miss} * {edge}) / {w}.0::DOUBLE AS {n}_d, (coalesce(sum((x - x0) * (x - x0)) {f}, 0) + {miss} * {edge} * {edge}) / {w}.0::DOUBLE AS {n}_s")
    out = ", ".join(f"{n}_d + x0 AS {n}_mean, greatest({n}_s - {n}_d * {n}_d, 0::DOUBLE) AS {n}_var" for n in frames)
    return f"en AS (SELECT *, first_value(x) OVER (PARTITION BY channel_id ORDER BY k) AS x0, first_value(x) OVER (PARTITION BY channel_id ORDER BY k DESC) AS xl FROM {source}), sr AS (SELECT *, {', '.join(cols)} FROM en), st AS (SELECT *, {out} FROM sr)"


def suppress_sql(gap: int, fired: str = "fired") -> str:
    return f"s AS (SELECT channel_id, min(k) AS k FROM {fired} GROUP BY channel_id UNION ALL SELECT s.channel_id, (SELECT min(f.k) FROM {fired} f WHERE f.channel_id = s.channel_id AND f.k >= s.k + {gap}) FROM s WHERE s.k IS NOT NULL)"


RUNS = f"""g0 AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY channel_id ORDER BY t, event_id) > {DAY} THEN 1 ELSE 0 END AS nw FROM ev),
g1 AS (SELECT *, sum(nw) OVER (PARTITION BY channel_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS rr FROM g0),
g2 AS (SELECT *, count(*) OVER (PARTITION BY channel_id, rr) AS c FROM g1),
g3 AS (SELECT *, dense_rank() OVER (PARTITION BY channel_id ORDER BY rr) - 1 AS run FROM g2 WHERE c > 1)"""


@query(f"WITH {EV}, {RUNS} SELECT channel_id, run::BIGINT AS run, min(t) AS start, max(t) AS stop, count(*)::BIGINT AS n FROM g3 GROUP BY channel_id, run")
def gap_runs(spark, sf):
    return T.runs(series(spark, sf), "channel_id", "t", DAY, ["event_id"])


STEP = 21_600_000_000
GRID = f"""sp AS (SELECT channel_id, run, min(t) AS a, max(t) AS b FROM g3 GROUP BY channel_id, run),
gr AS (SELECT channel_id, run, unnest(range(0, (b - a) // {STEP} + 1)) AS k, a FROM sp), gt AS (SELECT channel_id, run, k, a + k * {STEP} AS t FROM gr),
ff AS (SELECT gt.channel_id, gt.run, gt.k, gt.t, g3.x FROM gt ASOF JOIN g3 ON gt.channel_id = g3.channel_id AND gt.run = g3.run AND gt.t >= g3.t)"""


@query(f"WITH {EV}, {RUNS}, {GRID} SELECT channel_id, run::BIGINT AS run, k::BIGINT AS k, t::BIGINT AS t, x FROM ff")
def grid_ffill(spark, sf):
    return grid(spark, sf).select("channel_id", "run", "k", "t", "x")


def grid(spark, sf):
    run = T.split_on_gaps(series(spark, sf), "channel_id", "t", DAY, ["event_id"])
    return T.forward_fill_to_grid(run, "channel_id", "t", "x", STEP)


@query(f"WITH {EV}, {RUNS}, {GRID} SELECT channel_id, run::BIGINT AS run, (k // 4)::BIGINT AS step, round(avg(x), 5) AS p FROM ff GROUP BY channel_id, run, k // 4")
def lowfreq_power(spark, sf):
    """The minimum slice end to end: gaps, grid, block means (a day each)."""
    g = grid(spark, sf).withColumns({"offset": F.col("k"), "length": F.lit(4 * 2**20)})
    return windows.block_means(g, ["channel_id", "run"], 2**20, F.avg("x")).select("channel_id", "run", "step", r("p").alias("p"))


# ---- windows
CH_A = "ch AS (SELECT channel_id, count(*) AS n FROM ev GROUP BY channel_id)"


def event_channels(spark, sf):
    return series(spark, sf).groupBy("channel_id").agg(F.count("*").alias("n_samples"))


@query(f"WITH {EV}, {CH_A}, i AS (SELECT channel_id, unnest(range(0, n - 10 + 1, 10)) AS start, 10 AS length FROM ch WHERE n >= 10) SELECT channel_id, start::BIGINT AS start, length::BIGINT AS length, (row_number() OVER (ORDER BY channel_id, start) - 1)::BIGINT AS window_idx FROM i")
def window_index(spark, sf):
    return windows.numbered(windows.window_index(event_channels(spark, sf), F.lit(10)))


@query(f"WITH {EV}, {CH_A} SELECT channel_id, unnest(range(0, n - 10 + 1, 4))::BIGINT AS start, 10::BIGINT AS length FROM ch WHERE n >= 10")
def window_index_half_stride(spark, sf):
    return windows.window_index(event_channels(spark, sf), F.lit(10), 0.45)


@query(f"WITH {EV}, {CH_A}, m AS (SELECT channel_id, (n - 4) // 4 + 1 AS w FROM ch WHERE n >= 4) SELECT DISTINCT channel_id, (CASE WHEN w > 5 THEN round_even(i * (w - 1) / 4.0, 0)::BIGINT ELSE i END * 4)::BIGINT AS start, 4::BIGINT AS length FROM (SELECT channel_id, w, unnest(range(0, CASE WHEN w > 5 THEN 5 ELSE w END)) AS i FROM m)")
def window_index_capped(spark, sf):
    return windows.window_index(event_channels(spark, sf), F.lit(4), max_per_channel=5)


@query(f"WITH {EV}, {CH_A} SELECT channel_id, (CASE WHEN n >= 60 THEN (n - 60) // 60 + 1 ELSE 0 END)::BIGINT AS n_windows FROM ch")
def window_counts(spark, sf):
    ch = event_channels(spark, sf)
    return windows.window_counts(windows.window_index(ch, F.lit(60)), ch)


# ---- detectors
@query(f"WITH {EV}, {stats_sql({'c': (-7, 0)})} SELECT channel_id, k::BIGINT AS k, round(c_mean, 5) AS c_mean, round(sqrt(c_var), 4) AS c_std FROM st")
def running_stats(spark, sf):
    s = T.frame_stats(series(spark, sf), "channel_id", "x", {"c": (-7, 0)}, block=64)
    return s.select("channel_id", "k", r("c_mean").alias("c_mean"), r(F.sqrt("c_var"), 4).alias("c_std"))


def detector_sql(frames, fired, gap):
    return f"WITH RECURSIVE {EV}, {stats_sql(frames)}, fired AS (SELECT channel_id, k FROM st WHERE {fired}), {suppress_sql(gap)} SELECT channel_id, k::BIGINT AS k FROM s WHERE k IS NOT NULL"


@query(detector_sql({"c": (-7, 0)}, "abs(x - c_mean) / greatest(sqrt(c_var), 1e-6) > 2 * (1 + 1e-12) AND abs(x - c_mean) > 5", 3))
def zscore_events(spark, sf):
    return detect.ZScore(8, 2.0, 3, 5.0).apply(series(spark, sf), block=256)


LR = {"l": (-4, -1), "r": (1, 4)}
GLR = "2.0::DOUBLE * (r_mean - l_mean) * (r_mean - l_mean) / greatest((4 * l_var + 4 * r_var) / 8, 1e-6) > 20 * (1 + 1e-12) AND abs(r_mean - l_mean) > 20"


@query(detector_sql(LR, GLR, 6))
def glr_events(spark, sf):
    return detect.Glr(4, 4, 20.0, 6, 20.0).apply(series(spark, sf))


@query(detector_sql(LR, "4 * ((r_mean - l_mean) * (r_mean - l_mean) + r_var) / greatest(l_var, 1e-6) > 40 * (1 + 1e-12) AND abs(r_mean - l_mean) > 10", 6))
def gof_events(spark, sf):
    return detect.GoodnessOfFit(4, 4, 40.0, 6, 10.0).apply(series(spark, sf))


@query(detector_sql(LR, "abs(r_mean - l_mean) > (20 + 1.5 * sqrt(greatest(l_var, 1e-6))) * (1 + 1e-12)", 6))
def adaptive_events(spark, sf):
    return detect.AdaptiveThreshold(4, 20.0, 1.5, 6).apply(series(spark, sf))


@query(f"""WITH RECURSIVE {EV}, {stats_sql({'c': (-15, 0)})}, d AS (SELECT channel_id, k, x - c_mean AS d FROM st),
c AS (SELECT channel_id, k, greatest(d - 5, 0::DOUBLE) AS u0, greatest(-d - 5, 0::DOUBLE) AS w0, greatest(d - 5, 0::DOUBLE) AS up, greatest(-d - 5, 0::DOUBLE) AS dn FROM d WHERE k = 0
UNION ALL SELECT d.channel_id, d.k, greatest(p.up + d.d - 5, 0::DOUBLE), greatest(p.dn - d.d - 5, 0::DOUBLE),
 CASE WHEN greatest(p.up + d.d - 5, p.dn - d.d - 5) > 120 * (1 + 1e-12) THEN 0 ELSE greatest(p.up + d.d - 5, 0::DOUBLE) END, CASE WHEN greatest(p.up + d.d - 5, p.dn - d.d - 5) > 120 * (1 + 1e-12) THEN 0 ELSE greatest(p.dn - d.d - 5, 0::DOUBLE) END
 FROM c p JOIN d ON d.channel_id = p.channel_id AND d.k = p.k + 1)
SELECT channel_id, k::BIGINT AS k FROM c WHERE u0 > 120 * (1 + 1e-12) OR w0 > 120 * (1 + 1e-12)""")
def cusum_events(spark, sf):
    return detect.Cusum(16, 120.0, 5.0).apply(series(spark, sf))


@query(f"""WITH RECURSIVE {EV}, en AS (SELECT channel_id, k, x FROM ev UNION ALL SELECT channel_id + 1000000, k, abs(x - coalesce(lag(x) OVER (PARTITION BY channel_id ORDER BY k), x)) FROM ev),
{stats_sql({'c': (-7, 0)}, 'e2').replace('FROM e2', 'FROM en0').replace('en AS', 'e2 AS').replace('FROM en)', 'FROM e2)').replace('FROM en0', 'FROM en')},
fired AS (SELECT channel_id, k FROM st WHERE abs(x - c_mean) / greatest(sqrt(c_var), 1e-6) > 2 * (1 + 1e-12) AND abs(x - c_mean) > 0), {suppress_sql(3)},
hit AS (SELECT DISTINCT channel_id % 1000000 AS channel_id, channel_id // 1000000 AS q, k + unnest([-2, -1, 0, 1, 2]) AS k FROM s WHERE k IS NOT NULL),
vote AS (SELECT channel_id, k FROM (SELECT e.channel_id, e.k, count(DISTINCT q) AS v FROM ev e JOIN hit h ON h.channel_id = e.channel_id AND h.k = e.k GROUP BY ALL) WHERE v = 2),
edge AS (SELECT channel_id, k FROM vote v WHERE NOT EXISTS (SELECT 1 FROM vote w WHERE w.channel_id = v.channel_id AND w.k = v.k - 1)),
{suppress_sql(5, 'edge').replace('s AS', 's2 AS').replace('s.', 's2.').replace('FROM s ', 'FROM s2 ')}
SELECT channel_id, k::BIGINT AS k FROM s2 WHERE k IS NOT NULL""")
def multivariate_events(spark, sf):
    s = series(spark, sf)
    s = s.withColumn("dx", F.abs(F.col("x") - F.coalesce(F.lag("x").over(Window.partitionBy("channel_id").orderBy("k")), F.col("x"))))
    return detect.Multivariate(detect.ZScore(8, 2.0, 3, 0.0), "all", 2).apply_many(s, ["x", "dx"])


ISL = "i0 AS (SELECT *, CASE WHEN m != lag(m) OVER (PARTITION BY channel_id ORDER BY k) THEN 1 ELSE 0 END AS c FROM mk), i1 AS (SELECT *, sum(c) OVER (PARTITION BY channel_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS g FROM i0), isl AS (SELECT channel_id, g, min(k) AS start, max(k) + 1 AS stop, first(m) AS m FROM i1 GROUP BY channel_id, g)"


@query(f"""WITH RECURSIVE {EV}, {stats_sql({'c': (-3, 0)})}, mk AS (SELECT channel_id, k, sqrt(c_var) > 25 * (1 + 1e-12) AS m FROM st), {ISL},
cl AS (SELECT channel_id, g, start, stop, m FROM isl WHERE g = 0 UNION ALL SELECT i.channel_id, i.g, i.start, i.stop, CASE WHEN i.stop - i.start < 3 THEN p.m ELSE i.m END FROM cl p JOIN isl i ON i.channel_id = p.channel_id AND i.g = p.g + 1),
j0 AS (SELECT *, CASE WHEN m != lag(m) OVER (PARTITION BY channel_id ORDER BY start) THEN 1 ELSE 0 END AS c FROM cl), j1 AS (SELECT *, sum(c) OVER (PARTITION BY channel_id ORDER BY start ROWS UNBOUNDED PRECEDING) AS h FROM j0)
SELECT channel_id, min(start)::BIGINT AS start, max(stop)::BIGINT AS stop FROM j1 WHERE m GROUP BY channel_id, h""")
def active_sections(spark, sf):
    return detect.ActiveSections(4, 25.0, 3).sections(series(spark, sf))


@query(f"""WITH RECURSIVE {EV}, {CH_A}, {stats_sql(LR)}, fired AS (SELECT channel_id, k FROM st WHERE {GLR}), {suppress_sql(6)},
pt AS (SELECT channel_id, k FROM s WHERE k IS NOT NULL UNION SELECT channel_id, 0 FROM ch), sg AS (SELECT pt.channel_id, k AS start, coalesce(lead(k) OVER (PARTITION BY pt.channel_id ORDER BY k), n) AS stop FROM pt JOIN ch ON ch.channel_id = pt.channel_id)
SELECT channel_id, start::BIGINT AS start, stop::BIGINT AS stop FROM sg WHERE stop - start >= 5""")
def event_segments(spark, sf):
    s = series(spark, sf)
    return T.segments(detect.Glr(4, 4, 20.0, 6, 20.0).apply(s), event_channels(spark, sf).withColumnRenamed("n_samples", "n"), "channel_id", 5)


@query(f"WITH {EV}, mk AS (SELECT channel_id, k, x > 50 AS m FROM ev), {ISL} SELECT channel_id, start::BIGINT AS start, stop::BIGINT AS stop FROM isl WHERE m")
def on_runs(spark, sf):
    return T.spans_of(series(spark, sf).withColumn("on", F.col("x") > 50), "channel_id", "on")


@query(f"WITH {EV}, o AS (SELECT channel_id, k, x > 80 AS o, lag(x > 80) OVER (PARTITION BY channel_id ORDER BY k) AS w FROM ev) SELECT channel_id, k::BIGINT AS k, o AS turned_on FROM o WHERE w IS NOT NULL AND o != w")
def truth_transitions(spark, sf):
    return T.transitions(series(spark, sf), "channel_id", "x", 80.0)


@query(f"""WITH {EV}, b AS (SELECT channel_id, quantile_cont(x, 0.2) AS lo, quantile_cont(x, 0.999) AS hi, max(k) AS n FROM ev GROUP BY channel_id),
mk AS (SELECT ev.channel_id, k, x > lo + 0.25 * (hi - lo) AS m FROM ev JOIN b ON b.channel_id = ev.channel_id), {ISL},
f AS (SELECT isl.channel_id, start, stop, row_number() OVER (PARTITION BY isl.channel_id ORDER BY stop - start DESC, start) AS q FROM isl JOIN b ON b.channel_id = isl.channel_id WHERE m AND start > 0 AND stop <= n)
SELECT channel_id, start::BIGINT AS start, stop::BIGINT AS stop FROM f WHERE q = 1""")
def longest_run(spark, sf):
    return T.longest_run(series(spark, sf), "channel_id", "x")


@query(f"WITH {EV} SELECT channel_id, k::BIGINT AS k, round(x - avg(x) OVER (PARTITION BY channel_id, k // 12), 5) AS x FROM ev")
def demean_cycles(spark, sf):
    return T.demean_cycles(series(spark, sf), "channel_id", "x", 12).select("channel_id", "k", r("x").alias("x"))


# ---- matching
def predicted_and_true(spark, sf):
    s = series(spark, sf)
    return detect.AdaptiveThreshold(4, 20.0, 1.0, 3).apply(s), T.transitions(s, "channel_id", "x", 80.0).select("channel_id", "k")


MATCH = f"""{EV}, {stats_sql(LR)}, fired AS (SELECT channel_id, k FROM st WHERE abs(r_mean - l_mean) > (20 + sqrt(greatest(l_var, 1e-6))) * (1 + 1e-12)), {suppress_sql(3)},
pr AS (SELECT channel_id, k FROM s WHERE k IS NOT NULL), o AS (SELECT channel_id, k, x > 80 AS o, lag(x > 80) OVER (PARTITION BY channel_id ORDER BY k) AS w FROM ev), tr AS (SELECT channel_id, k FROM o WHERE w IS NOT NULL AND o != w),
pa AS (SELECT pr.channel_id, pr.k AS p, tr.k AS a, row_number() OVER (PARTITION BY pr.channel_id ORDER BY abs(pr.k - tr.k), pr.k, tr.k) AS n FROM pr JOIN tr ON tr.channel_id = pr.channel_id AND abs(pr.k - tr.k) <= 3),
m AS (SELECT channel_id, 0::BIGINT AS n, []::BIGINT[] AS ps, []::BIGINT[] AS qs FROM (SELECT DISTINCT channel_id FROM pa)
 UNION ALL SELECT m.channel_id, pa.n, CASE WHEN list_contains(ps, p) OR list_contains(qs, a) THEN ps ELSE list_append(ps, p) END, CASE WHEN list_contains(ps, p) OR list_contains(qs, a) THEN qs ELSE list_append(qs, a) END FROM m JOIN pa ON pa.channel_id = m.channel_id AND pa.n = m.n + 1),
mx AS (SELECT channel_id, arg_max(ps, n) AS ps, arg_max(qs, n) AS qs FROM m GROUP BY channel_id), mt AS (SELECT channel_id, unnest(ps) AS predicted, unnest(qs) AS actual FROM mx)"""


@query(f"WITH RECURSIVE {MATCH} SELECT channel_id, predicted, actual FROM mt")
def event_match(spark, sf):
    p, a = predicted_and_true(spark, sf)
    return match.match_events(p, a, "channel_id", 3)


@query(f"WITH RECURSIVE {MATCH}, n AS (SELECT (SELECT count(*) FROM mt) AS tp, (SELECT count(*) FROM pr) AS np, (SELECT count(*) FROM tr) AS na, (SELECT avg(abs(predicted - actual)) FROM mt) AS timing) SELECT tp::BIGINT AS tp, (np - tp)::BIGINT AS fp, (na - tp)::BIGINT AS fn, round(timing, 5) AS timing, round(tp / (np + 1e-9), 5) AS precision, round(tp / (na + 1e-9), 5) AS recall, round(2 * tp / (np + na + 1e-9), 5) AS f1 FROM n")
def event_f1(spark, sf):
    p, a = predicted_and_true(spark, sf)
    c = match.event_counts(p, a, "channel_id", 3)
    return c.select("tp", "fp", "fn", *(r(x).alias(x) for x in ("timing", "precision", "recall", "f1")))


# ---- joins between channels
def order_channels(spark, sf):
    o = table(spark, sf, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("channel_id"), F.lit("tpch").alias("dataset"), F.col("o_custkey").cast("string").alias("house"), F.col("o_orderkey").cast("string").alias("session"))
    li = table(spark, sf, "lineitem").select(F.concat_ws("-", F.col("l_orderkey").cast("string"), "l_partkey", "l_suppkey", "l_linenumber").alias("channel_id"), F.lit("tpch").alias("dataset"), F.lit("x").alias("house"), F.col("l_orderkey").cast("string").alias("session"))
    return o.drop("house").join(li.select("session").distinct(), "session", "left_semi").withColumn("house", F.lit("x")).unionByName(li)


@query("WITH c AS (SELECT 'o' || o_orderkey AS id, o_orderkey AS s FROM orders UNION ALL SELECT l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber, l_orderkey FROM lineitem) SELECT a.id AS channel_id, b.id AS sibling_id FROM c a JOIN c b ON a.s = b.s AND a.id != b.id")
def siblings(spark, sf):
    return targets.siblings(order_channels(spark, sf))


def sub_series(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", F.col("value").alias("p"), T.micros("ts").alias("t"), "event_id")
    return T.with_index(e.withColumn("channel_id", F.concat_ws("-", F.col("user_id").cast("string"), "event_type")), "channel_id", ["t", "event_id"])


def house_channels(spark, sf):
    """(mains, sub-meters): each user a house; a sub-meter an event type, at half the rate and three seconds late."""
    meta = lambda df, kind, fs, t0: df.select("channel_id", F.lit("a").alias("dataset"), "house", F.lit("run_0").alias("session"), F.lit(kind).alias("kind"), "appliance", F.lit(fs).alias("fs"), F.lit(t0).alias("t0"), "n_samples")
    mains = event_channels(spark, sf).select(F.col("channel_id").cast("string").alias("channel_id"), F.col("channel_id").cast("string").alias("house"), F.lit(None).cast("string").alias("appliance"), "n_samples")
    sub = sub_series(spark, sf).groupBy("channel_id", F.col("user_id").cast("string").alias("house"), F.col("event_type").alias("appliance")).agg(F.count("*").alias("n_samples"))
    return meta(mains, "mains", 1.0, 0.0), meta(sub, "submeter", 0.5, 3.0)


def mains_windows(spark, sf):
    mains, _ = house_channels(spark, sf)
    return windows.window_index(mains, F.lit(8))


SIB = f"""{EV}, {CH_A}, wi AS (SELECT channel_id, unnest(range(0, n - 8 + 1, 8)) AS start FROM ch WHERE n >= 8),
sb AS (SELECT user_id AS channel_id, event_type, value AS p, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS j FROM events),
sn AS (SELECT channel_id, event_type, count(*) AS n FROM sb GROUP BY ALL),
sp AS (SELECT wi.channel_id, start, event_type, greatest(floor((start - 3) * 0.5), 0) AS a, least(ceil((start + 8 - 3) * 0.5), n) AS b FROM wi JOIN sn ON sn.channel_id = wi.channel_id),
sw AS (SELECT sp.channel_id, sp.start, sp.event_type AS appliance, avg(p) AS watts FROM sp JOIN sb ON sb.channel_id = sp.channel_id AND sb.event_type = sp.event_type AND sb.j >= a AND sb.j < b GROUP BY ALL)"""


@query(f"WITH {SIB} SELECT channel_id::VARCHAR AS channel_id, start::BIGINT AS start, appliance, round(watts, 5) AS watts FROM sw")
def sibling_power(spark, sf):
    mains, sub = house_channels(spark, sf)
    got = targets.sibling_power(mains_windows(spark, sf), mains, sub, sub_series(spark, sf).select("channel_id", "k", "p"))
    return got.select("channel_id", "start", "appliance", r("watts").alias("watts"))


def activations(spark, sf):
    runs = T.spans_of(series(spark, sf).withColumn("on", F.col("x") > 30), "channel_id", "on")
    return runs.select(F.col("channel_id").cast("string").alias("channel_id"), F.lit("click").alias("appliance"), F.col("start").alias("on"), F.col("stop").alias("off"))


@query(f"WITH {EV}, {CH_A}, mk AS (SELECT channel_id, k, x > 30 AS m FROM ev), {ISL}, wi AS (SELECT channel_id, unnest(range(0, n - 8 + 1, 8)) AS w FROM ch WHERE n >= 8) SELECT DISTINCT wi.channel_id::VARCHAR AS channel_id, w::BIGINT AS start, 8::BIGINT AS length, 'click' AS appliance FROM wi JOIN isl ON isl.channel_id = wi.channel_id AND m WHERE least(w + 8, stop) - greatest(w, start) > 4")
def activation_overlap(spark, sf):
    return targets.activation_overlap(mains_windows(spark, sf), activations(spark, sf))


@query(f"""WITH {SIB}, mk AS (SELECT channel_id, k, x > 30 AS m FROM ev), {ISL}, ov AS (SELECT DISTINCT wi.channel_id, wi.start FROM wi JOIN isl ON isl.channel_id = wi.channel_id AND m WHERE least(wi.start + 8, stop) - greatest(wi.start, isl.start) > 4),
ap AS (SELECT DISTINCT event_type AS appliance FROM events WHERE event_type != 'error'), lo AS (SELECT DISTINCT channel_id, start FROM sw WHERE appliance = 'error' AND watts > 10)
SELECT wi.channel_id::VARCHAR AS channel_id, wi.start::BIGINT AS start, ap.appliance, (coalesce(watts, 0) > 40 OR (ap.appliance = 'click' AND ov.start IS NOT NULL))::DOUBLE AS presence, round(coalesce(watts, 0), 5) AS power, watts IS NOT NULL AS power_mask, lo.start IS NOT NULL AS is_unknown
FROM wi CROSS JOIN ap LEFT JOIN sw ON sw.channel_id = wi.channel_id AND sw.start = wi.start AND sw.appliance = ap.appliance LEFT JOIN ov ON ov.channel_id = wi.channel_id AND ov.start = wi.start LEFT JOIN lo ON lo.channel_id = wi.channel_id AND lo.start = wi.start""")
def window_targets(spark, sf):
    mains, sub = house_channels(spark, sf)
    w = mains_windows(spark, sf)
    watts = targets.sibling_power(w, mains, sub, sub_series(spark, sf).select("channel_id", "k", "p"))
    apps = sub.select("appliance").distinct().select("appliance", F.lit(40.0).alias("on_threshold_w"), (F.col("appliance") != "error").alias("is_known"))
    total = w.select("channel_id", "start", F.lit(0.0).alias("p_total"))
    got = targets.targets(w, mains, apps, total, watts, targets.activation_overlap(w, activations(spark, sf)))
    return got.withColumn("power", r("power"))


@query(f"WITH {EV}, {RUNS}, rn AS (SELECT channel_id, run, min(t) AS a, max(t) AS b FROM g3 GROUP BY ALL) SELECT event_id, ev.channel_id, coalesce('run_' || run, 'hf_only') AS session FROM ev LEFT JOIN rn ON rn.channel_id = ev.channel_id AND ev.t + 3600000000 BETWEEN a AND b")
def run_containing_point(spark, sf):
    s = series(spark, sf)
    runs = T.runs(s, "channel_id", "t", DAY, ["event_id"]).withColumn("session", F.concat(F.lit("run_"), "run"))
    points = s.select("event_id", "channel_id", (F.col("t") + 3_600_000_000).alias("t"))
    return targets.run_containing(points, runs, "channel_id", "t").select("event_id", "channel_id", "session")


@query(f"WITH {EV}, lg AS (SELECT channel_id, t, x FROM ev WHERE event_type = 'purchase'), f AS (SELECT channel_id, arg_min(x, t) AS x FROM lg GROUP BY channel_id) SELECT event_id, coalesce(lg.x, f.x) AS config FROM ev ASOF LEFT JOIN lg ON lg.channel_id = ev.channel_id AND ev.t >= lg.t LEFT JOIN f ON f.channel_id = ev.channel_id")
def config_as_of(spark, sf):
    s = series(spark, sf)
    log = s.where("event_type = 'purchase'").select("channel_id", "t", F.col("x").alias("config"))
    return T.asof_or_first(s.select("event_id", "channel_id", "t"), log, ["channel_id"], "t", ["config"]).select("event_id", "config")


# ---- metadata: parts as channels
def part_channels(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("channel_id"), F.when(F.col("p_size") % 2 == 0, "alpha").otherwise("beta").alias("dataset"), F.concat(F.lit("house_"), F.col("p_size") % 7).alias("house"), F.lit("run_0").alias("session"), F.lit("submeter").alias("kind"), F.col("p_type").alias("appliance"), F.col("p_brand").alias("brand"), F.concat_ws(":", "p_type", "p_brand").alias("instance_id"), F.lit(10.0).alias("fs"), F.lit(50.0).alias("f0"), F.lit(0.0).alias("t0"), (F.col("p_size") * 36000).cast("long").alias("n_samples"), F.when(F.col("p_size") > 25, F.array(F.lit("i"), F.lit("v"))).otherwise(F.array(F.lit("p"))).alias("quantities"))


PT = "pt AS (SELECT p_partkey::VARCHAR AS channel_id, CASE WHEN p_size % 2 = 0 THEN 'alpha' ELSE 'beta' END AS dataset, 'house_' || (p_size % 7) AS house, p_type AS appliance, p_brand AS brand, p_type || ':' || p_brand AS instance_id, p_size AS size FROM part)"


@query(f"WITH {PT} SELECT appliance, count(*)::BIGINT AS n_channels, count(DISTINCT instance_id)::BIGINT AS n_instances, count(DISTINCT brand)::BIGINT AS n_brands, round(sum(size)::DOUBLE, 4) AS hours FROM pt GROUP BY appliance UNION ALL SELECT 'absent', 0, 0, 0, 0.0")
def describe_store(spark, sf):
    c = part_channels(spark, sf)
    apps = c.select("appliance").distinct().union(spark.createDataFrame([("absent",)], "appliance string"))
    return store.describe(apps, c).withColumn("hours", r("hours", 4))


@query(f"WITH {PT}, v AS (SELECT 'appliance' AS k, appliance AS v FROM pt UNION SELECT 'brand', brand FROM pt UNION SELECT 'house', house FROM pt UNION SELECT 'dataset', dataset FROM pt) SELECT k AS kind, v AS value FROM v")
def distinct_labels(spark, sf):
    c = part_channels(spark, sf)
    out = None
    for k in ("appliance", "brand", "house", "dataset"):
        one = c.select(F.lit(k).alias("kind"), F.col(k).alias("value")).distinct()
        out = one if out is None else out.union(one)
    return out


@query("SELECT p_type AS appliance, (row_number() OVER (ORDER BY p_type) - 1)::BIGINT AS index, 10.0::DOUBLE AS on_threshold_w, TRUE AS is_known FROM (SELECT DISTINCT p_type FROM part)")
def label_space(spark, sf):
    c = part_channels(spark, sf)
    table_ = store.default_appliances(c, spark.createDataFrame([], "channel_id string, appliance string, `on` long, off long"))
    return store.label_space(table_).select("appliance", "index", "on_threshold_w", "is_known")


@query("SELECT p_partkey::VARCHAR AS channel_id FROM part WHERE p_name IN (SELECT p_name FROM part GROUP BY p_name HAVING count(*) >= 30)")
def drop_rare(spark, sf):
    p = table(spark, sf, "part")
    return p.join(p.groupBy("p_name").count().where("count >= 30"), "p_name", "left_semi").select(F.col("p_partkey").cast("string").alias("channel_id"))


# ---- splits
BRANDS = sorted(f"Brand#{k}" for k in range(1, 26))
TYPES = sorted(["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"])
HOUSES = sorted(f"house_{k}" for k in range(7))


def fold_sql(column: str, groups: list[str], protocol: splits.SplitProtocol) -> str:
    folds = protocol.folds_of(groups)
    lists = {f: ", ".join(f"'{g}'" for g in sorted(groups) if folds[g] == f) for f in ("train", "val", "test")}
    cases = " ".join(f"WHEN {column} IN ({v}) THEN '{f}'" for f, v in lists.items() if v)
    return f"WITH {PT} SELECT channel_id, CASE {cases} END AS fold FROM pt"


@query(fold_sql("'i' || brand", sorted(f"i{b}" for b in BRANDS), splits.RandomSplit(0.2, 0.1, 3)))
def split_random(spark, sf):
    return splits.RandomSplit(0.2, 0.1, 3).apply(part_channels(spark, sf).withColumn("instance_id", F.concat(F.lit("i"), "brand"))).folds


@query(fold_sql("brand", BRANDS, splits.LeaveBrandOut(0.25, 0.0, 1)))
def split_leave_brand_out(spark, sf):
    return splits.LeaveBrandOut(0.25, 0.0, 1).apply(part_channels(spark, sf)).folds


@query(fold_sql("house", HOUSES, splits.LeaveHouseOut(0.3, 0.2, 7)))
def split_leave_house_out(spark, sf):
    return splits.LeaveHouseOut(0.3, 0.2, 7).apply(part_channels(spark, sf)).folds


@query(f"WITH {PT} SELECT channel_id, CASE dataset WHEN 'alpha' THEN 'train' ELSE 'val' END AS fold FROM pt")
def split_cross_dataset(spark, sf):
    return splits.CrossDataset(["alpha"], ["beta"]).apply(part_channels(spark, sf)).folds


@query(f"WITH {PT} SELECT channel_id, CASE WHEN appliance IN ({', '.join(repr(TYPES[k]) for k in np.random.default_rng(5).permutation(len(TYPES))[:2])}) THEN 'val' ELSE 'train' END AS fold FROM pt")
def split_unseen(spark, sf):
    return splits.UnseenAppliance(n_unknown=2, seed=5).apply(part_channels(spark, sf)).folds


@query(f"WITH {PT}, f AS (SELECT *, CASE dataset WHEN 'alpha' THEN 'train' ELSE 'val' END AS fold FROM pt) SELECT x.fold, coalesce(channels, 0)::BIGINT AS channels, coalesce(instances, 0)::BIGINT AS instances, coalesce(houses, 0)::BIGINT AS houses, round(coalesce(hours, 0), 4) AS hours FROM (VALUES ('train'), ('val'), ('test')) x(fold) LEFT JOIN (SELECT fold, count(*) AS channels, count(DISTINCT instance_id) AS instances, count(DISTINCT house) AS houses, sum(size)::DOUBLE AS hours FROM f GROUP BY fold) y ON x.fold = y.fold")
def split_summary(spark, sf):
    c = part_channels(spark, sf)
    return splits.CrossDataset(["alpha"], ["beta"]).apply(c).summary(c).withColumn("hours", r("hours", 4))


@query(f"WITH {PT}, f AS (SELECT *, CASE dataset WHEN 'alpha' THEN 'train' ELSE 'val' END AS fold FROM pt) SELECT 'brand' AS key, brand AS value, count(DISTINCT fold)::BIGINT AS n_folds FROM f GROUP BY brand HAVING count(DISTINCT fold) > 1 UNION ALL SELECT 'house', house, count(DISTINCT fold) FROM f GROUP BY house HAVING count(DISTINCT fold) > 1")
def leakage_check(spark, sf):
    c = part_channels(spark, sf)
    return splits.check_leakage(splits.CrossDataset(["alpha"], ["beta"]).apply(c).folds, c, ["brand", "house"])


# ---- taxonomy
NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '\(\s*\d+\s*\)', ' ', 'g'), '^\s+|\s+$', '', 'g'), '[\s\-/,.()\[\]]+', '_', 'g'), '[^a-z0-9_]+', '', 'g'), '_')"


@query("SELECT p_partkey, " + NORM.format("p_name || ' (' || p_size || ')/' || p_brand") + " AS label FROM part")
def taxonomy_normalise(spark, sf):
    return table(spark, sf, "part").select("p_partkey", labels.normalise(F.concat("p_name", F.lit(" ("), "p_size", F.lit(")/"), "p_brand")).alias("label"))


EVENT_TAXONOMY = labels.Taxonomy({"browse": ["View", "CLICK"], "buy": ["purchase"]}, {"even": {"signup": "buy"}})


@query("SELECT event_id, CASE WHEN event_type = 'signup' AND user_id % 2 = 0 THEN 'buy' WHEN event_type IN ('view', 'click') THEN 'browse' WHEN event_type = 'purchase' THEN 'buy' END AS canonical FROM events")
def taxonomy_resolve(spark, sf):
    e = table(spark, sf, "events").withColumn("dataset", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd"))
    return EVENT_TAXONOMY.resolve(e.select("event_id", "event_type", "dataset"), "event_type", "dataset").select("event_id", "canonical")


@query("SELECT DISTINCT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset, event_type FROM events WHERE event_type = 'error' OR (event_type = 'signup' AND user_id % 2 = 1)")
def taxonomy_unmapped(spark, sf):
    e = table(spark, sf, "events").withColumn("dataset", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd"))
    return EVENT_TAXONOMY.unmapped(e, "event_type", "dataset")


# ---- compatibility and merging
@query(f"WITH {PT}, l AS (SELECT 'fs' AS axis, '10.0' AS v UNION ALL SELECT 'f0', '50.0' UNION ALL SELECT DISTINCT 'quantities', CASE WHEN size > 25 THEN 'i,v' ELSE 'p' END FROM pt UNION ALL SELECT DISTINCT 'vocabulary', appliance FROM pt UNION ALL SELECT DISTINCT 'dataset', dataset FROM pt) SELECT axis, string_agg(v, ';' ORDER BY v) AS vals FROM l GROUP BY axis")
def compat_axes(spark, sf):
    return compat.axes(part_channels(spark, sf)).select("axis", F.array_join("values", ";").alias("vals"))


@query("""WITH RECURSIVE v AS (SELECT nk, x, row_number() OVER (PARTITION BY nk ORDER BY x) AS i FROM (SELECT DISTINCT c_nationkey AS nk, abs(c_acctbal) AS x FROM customer)),
c AS (SELECT nk, i, x AS f, x AS s, 1::BIGINT AS n, 1::BIGINT AS g FROM v WHERE i = 1 UNION ALL SELECT v.nk, v.i, CASE WHEN v.x <= c.f * 1.5::DOUBLE THEN c.f ELSE v.x END, CASE WHEN v.x <= c.f * 1.5::DOUBLE THEN c.s + v.x ELSE v.x END, CASE WHEN v.x <= c.f * 1.5::DOUBLE THEN c.n + 1 ELSE 1 END, CASE WHEN v.x <= c.f * 1.5::DOUBLE THEN c.g ELSE c.g + 1 END FROM c JOIN v ON v.nk = c.nk AND v.i = c.i + 1)
SELECT nk AS c_nationkey, (g - 1)::INT AS cluster, round(arg_max(s / n, i), 7) AS volts FROM c GROUP BY nk, g""")
def voltage_clusters(spark, sf):
    c = table(spark, sf, "customer").groupBy("c_nationkey").agg(compat.clusters(F.collect_set(F.abs("c_acctbal")), 0.5).alias("v"))
    return c.select("c_nationkey", F.posexplode("v").alias("cluster", "volts")).withColumn("volts", r("volts", 7))


@query(f"WITH {PT} SELECT channel_id, FALSE AS aligned, TRUE AS lowfreq, size > 25 AS apparent FROM pt")
def view_usable(spark, sf):
    return part_channels(spark, sf).select("channel_id", compat.supports("aligned").alias("aligned"), compat.supports("lowfreq").alias("lowfreq"), compat.supports("apparent").alias("apparent"))


@query("SELECT 'c' || c_custkey AS channel_id, c_acctbal AS balance, lower(c_mktsegment) AS label FROM customer UNION ALL SELECT 's' || s_suppkey, s_acctbal, NULL FROM supplier")
def merge_union(spark, sf):
    a = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("channel_id"), F.col("c_acctbal").alias("balance"), F.lower("c_mktsegment").alias("label"))
    b = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("channel_id"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


# ---- stores: each written by the engine and read back
def event_store(spark, sf, rest: int):
    """The events of users with this rest by 2 as a store: value as v, half of it as i, 5 samples a cycle at 50 samples a second."""
    s = series(spark, sf).where(F.col("channel_id") % 2 == rest).withColumns({"channel_id": F.concat(F.lit("u"), "channel_id"), "i": F.col("x") / 2})
    signals = store.chunked(s, ["channel_id"], "x", "v").unionByName(store.chunked(s, ["channel_id"], "i", "i"))
    channels = s.groupBy("channel_id").agg(F.count("*").alias("n_samples")).withColumns({
        "dataset": F.lit("odd" if rest else "even"), "house": F.concat(F.lit("h"), F.length("channel_id").cast("string")), "session": F.lit("s"), "kind": F.lit("submeter"),
        "appliance": F.lit("Firdge" if rest else "kettle"), "brand": F.lit(None).cast("string"), "instance_id": F.lit(None).cast("string"), "fs": F.lit(50.0), "f0": F.lit(10.0), "t0": F.lit(0.0)})
    return store.write_store(jobs.scratch(spark, "events"), store.with_ids(channels), signals, source="events")


@query(f"WITH {EV} SELECT 'u' || channel_id AS channel_id, q AS quantity, k::BIGINT AS k, round((CASE q WHEN 'v' THEN x ELSE x / 2 END)::FLOAT::DOUBLE, 4) AS x FROM ev CROSS JOIN (VALUES ('v'), ('i')) t(q) WHERE channel_id % 2 = 0")
def store_signals(spark, sf):
    return store.unchunked(event_store(spark, sf, 0).signals).select("channel_id", "quantity", "k", r("x", 4).alias("x"))


@query(f"WITH {EV} SELECT 'u' || channel_id AS channel_id, 'odd' AS dataset, 'Firdge' AS appliance, 'odd:h' || (length(channel_id::VARCHAR) + 1) || ':s' AS instance_id, count(*)::BIGINT AS n_samples, 'i,v' AS quantities FROM ev WHERE channel_id % 2 = 1 GROUP BY channel_id")
def store_channels(spark, sf):
    return event_store(spark, sf, 1).submeters().select("channel_id", "dataset", "appliance", "instance_id", "n_samples", F.array_join("quantities", ",").alias("quantities"))


@query(f"WITH {EV} SELECT 'u' || channel_id AS channel_id, problem FROM (SELECT DISTINCT channel_id FROM ev WHERE channel_id % 2 = 0 AND channel_id % 3 = 0) CROSS JOIN (VALUES ('missing signal v'), ('not in the table: kettle')) t(problem) UNION ALL SELECT DISTINCT 'u' || channel_id, 'not in the table: kettle' FROM ev WHERE channel_id % 2 = 0 AND channel_id % 3 != 0 UNION ALL SELECT DISTINCT 'u' || channel_id, 'wrong hash' FROM ev WHERE channel_id % 2 = 0 AND channel_id % 3 = 0")
def store_verify(spark, sf):
    """Voltages of every third user are lost, and the appliance's row."""
    s = event_store(spark, sf, 0)
    whole = s.signals.where((F.col("quantity") != "v") | (F.substring("channel_id", 2, 20).cast("long") % 3 != 0))
    return store.verify(s.channels, whole, s.activations, s.appliance_table.where("false"), True)


@query(f"WITH {EV}, {CH_A}, w AS (SELECT channel_id, unnest(range(0, n, 10)) AS start FROM ch WHERE channel_id % 2 = 0) SELECT 'u' || w.channel_id AS channel_id, start::BIGINT AS start, 10::INT AS n, round(sum(x::FLOAT::DOUBLE * ev.k), 3) AS moment FROM w JOIN ev ON ev.channel_id = w.channel_id AND ev.k BETWEEN start AND start + 9 GROUP BY ALL")
def raw_windows(spark, sf):
    """Windows of 10 samples from the store's chunks, the last one of a channel filled with zeros."""
    s = event_store(spark, sf, 0)
    index = s.channels.select("channel_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_samples") - 1, F.lit(10).cast("long"))).alias("start")).withColumn("length", F.lit(10).cast("long"))
    got = views.raw_windows(index, s.signals, ("v",))
    moment = E.total(F.transform("v", lambda x, k: x * (k + F.col("start"))))
    return got.select("channel_id", "start", F.size("v").alias("n"), r(moment, 3).alias("moment"))


HEADS = "hd AS (SELECT channel_id, sqrt(avg(x::FLOAT::DOUBLE * x::FLOAT::DOUBLE)) AS rms FROM (SELECT *, count(*) OVER (PARTITION BY channel_id) AS n FROM ev) WHERE k < floor(least(50, n) / 5) * 5 GROUP BY channel_id)"


@query(f"WITH {EV}, {HEADS} SELECT 'u' || channel_id AS channel_id, round(CASE WHEN rms > 1 THEN 230 / rms ELSE 1 END, 6) AS scale FROM hd WHERE channel_id % 2 = 0")
def voltage_scales(spark, sf):
    s = event_store(spark, sf, 0)
    return compat.voltage_scale(s.signals, s.channels, 230.0).select("channel_id", r("scale", 6).alias("scale"))


@query(f"WITH {EV}, {HEADS} SELECT CASE ev.channel_id % 2 WHEN 0 THEN 'even:u' ELSE 'odd:u' END || ev.channel_id AS channel_id, CASE ev.channel_id % 2 WHEN 0 THEN 'kettle' ELSE 'cooler' END AS appliance, count(*)::BIGINT AS n_samples, round(avg(x * x / 2), 2) AS p, round(sqrt(avg(x * x)) * CASE WHEN any_value(rms) > 1 THEN 230 / any_value(rms) ELSE 1 END, 2) AS vrms FROM ev LEFT JOIN hd ON hd.channel_id = ev.channel_id GROUP BY ev.channel_id")
def merged_store(spark, sf):
    """Two stores become one: labels by the alias table and a rename, voltages at 230 V, powers as before."""
    out = compat.merge_stores([event_store(spark, sf, 0), event_store(spark, sf, 1)], jobs.scratch(spark, "merged"), ["fs", "f0", "voltage"], labels.Taxonomy(), {"fridge": "cooler"}, 230.0)
    long_ = store.unchunked(out.signals).groupBy("channel_id", "k").pivot("quantity", ["v", "i"]).agg(F.first("x"))
    power = long_.groupBy("channel_id").agg(r(F.avg(F.col("v") * F.col("i")), 2).alias("p"), r(F.sqrt(F.avg(F.col("v") * F.col("v"))), 2).alias("vrms"))
    return out.channels.select("channel_id", "appliance", "n_samples").join(power, "channel_id")


SPELLINGS = sorted({x for name, own in labels.ALIASES.items() for x in [name, *own]})
MEANT = {x: name for name, own in labels.ALIASES.items() for x in [name, *own]}
ALIAS_SQL = "al(n, label, canonical, category) AS (VALUES " + ", ".join(f"({n}, '{x}', '{MEANT[x]}', '{labels.CATEGORIES[MEANT[x]]}')" for n, x in enumerate(SPELLINGS)) + ")"


@query(f"WITH {ALIAS_SQL} SELECT p_partkey, canonical, category FROM part JOIN al ON n = p_partkey % {len(SPELLINGS)}")
def alias_table(spark, sf):
    """The shipped alias table: each part bears one of its spellings, in capitals, with an instance number."""
    words = F.array(*map(F.lit, SPELLINGS))
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.upper(F.get(words, (F.col("p_partkey") % len(SPELLINGS)).cast("int"))), F.lit(" (2)")).alias("label"), F.lit("d").alias("dataset"))
    t = labels.Taxonomy()
    groups = t.report(p, "label", "dataset").select("label", "category")
    return t.resolve(p, "label", "dataset").join(groups, "label").select("p_partkey", "canonical", "category")


@query(f"WITH {PT} SELECT channel_id, regexp_replace(dataset || '-' || house || '-run 0-' || appliance, '[^A-Za-z0-9_.-]', '_', 'g') AS made_id, CASE WHEN size % 3 = 0 THEN 'mine' WHEN size % 3 = 1 THEN appliance || ':' || brand ELSE dataset || ':' || house || ':run 0' END AS made_instance, CASE WHEN appliance LIKE 'S%' THEN 'plain' ELSE appliance END AS appliance FROM pt")
def channel_names(spark, sf):
    p = part_channels(spark, sf).withColumns({"session": F.lit("run 0"), "size": F.col("n_samples") / 36000})
    p = p.withColumns({"instance_id": F.when(F.col("size") % 3 == 0, "mine"), "brand": F.when(F.col("size") % 3 == 1, F.col("brand"))})
    p = p.withColumns({"made_id": labels.channel_id("dataset", "house", "session", "appliance", "kind"), "made_instance": labels.instance_id("instance_id", "appliance", "brand", "dataset", "house", "session")})
    plain = {t: "plain" for t in TYPES if t.startswith("S")}
    return labels.relabelled(p.select("channel_id", "made_id", "made_instance", "appliance"), "appliance", None, plain)


@query(f"WITH {PT} SELECT channel_id, ceil(11 * 1.3::DOUBLE * size / 50)::BIGINT AS cycles, ceil(30 * size / 2.0::DOUBLE)::BIGINT AS steps FROM pt")
def view_samples(spark, sf):
    p = part_channels(spark, sf).withColumn("fs", (F.col("n_samples") / 36000).cast("double"))
    return p.select("channel_id", views.HighFreqView(10).window_samples().alias("cycles"), views.LowFreqView(2.0, 30).window_samples().alias("steps"))


# ---- a benchmark of detectors
def benchmark_runs(spark, sf):
    """(mains, sub-meters, series): the grids of even users are mains, those of odd ones sub-meters, five houses."""
    g = grid(spark, sf).withColumns({"house": F.col("channel_id") % 5, "run": F.concat_ws(":", "channel_id", "run"), "appliance": F.concat(F.lit("a"), F.floor(F.col("channel_id") / 5) % 4)})
    runs = g.groupBy("house", "channel_id", "appliance", "run").agg((F.min("t") / 1e6).alias("t0"), F.count("*").alias("n")).withColumn("fs", F.lit(1e6 / STEP))
    odd = F.col("channel_id") % 2 == 1
    return runs.where(~odd), runs.where(odd), g.where(odd).select("house", "appliance", "run", "k", F.col("x").alias("p"))


BENCH = f"""{EV}, {RUNS}, {GRID}, ru AS (SELECT channel_id % 5 AS house, channel_id, 'a' || (channel_id // 5 % 4) AS appliance, channel_id || ':' || run AS run, min(t) / 1e6 AS t0, count(*) AS n FROM ff GROUP BY channel_id, run),
sc AS (SELECT m.house, m.run, m.t0, m.n, (SELECT count(*) FROM ru s WHERE s.house = m.house AND s.channel_id % 2 = 1 AND least(m.t0 + m.n * 21600, s.t0 + s.n * 21600) - greatest(m.t0, s.t0) > 90000) AS c FROM ru m WHERE m.channel_id % 2 = 0),
bs AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY house ORDER BY c DESC, n DESC, t0, run) = 1)"""


@query(f"WITH {BENCH} SELECT house, run, c::BIGINT AS overlaps FROM bs")
def benchmark_run(spark, sf):
    m, s, _ = benchmark_runs(spark, sf)
    best = benchmark.benchmark_runs(m, s, 24.0, 90_000.0).select("house", "run")
    return benchmark.overlap_counts(m, s, 90_000.0).join(best, ["house", "run"]).select("house", "run", "overlaps")


@query(f"""WITH {BENCH}, b AS (SELECT house, t0, least(n, 240) AS w FROM bs), mv AS (SELECT s.*, b.w, round_even((s.t0 - b.t0) * (1e6 / {STEP}), 0)::BIGINT AS sh FROM ru s JOIN b ON b.house = s.house WHERE s.channel_id % 2 = 1),
ks AS (SELECT house, appliance, w FROM mv WHERE least(n - greatest(-sh, 0), w - greatest(sh, 0)) > 0 GROUP BY ALL HAVING sum(least(n - greatest(-sh, 0), w - greatest(sh, 0))) > w // 100),
th AS (SELECT mv.house, mv.appliance, ff.k + sh AS k, arg_max(x, (t0, mv.run)) AS p FROM ff JOIN mv ON mv.channel_id = ff.channel_id AND mv.run = ff.channel_id || ':' || ff.run WHERE ff.k + sh >= 0 AND ff.k + sh < w GROUP BY ALL),
gd AS (SELECT house, appliance, unnest(range(0, w)) AS k FROM ks)
SELECT gd.house, gd.appliance, gd.k::BIGINT AS k, round(coalesce(p, 0), 5) AS p FROM gd LEFT JOIN th ON th.house = gd.house AND th.appliance = gd.appliance AND th.k = gd.k""")
def benchmark_align(spark, sf):
    return benchmark.aligned(*benchmark_runs(spark, sf), 1440.0, 90_000.0).select("house", "appliance", "k", r("p").alias("p"))


LEVELS = (60.0, 70.0, 80.0, 90.0)


@query(f"""WITH {EV}, lv AS (SELECT unnest([{', '.join(map(str, LEVELS))}])::DOUBLE AS level), h AS (SELECT channel_id, level, count(*) FILTER (WHERE x > level) AS n, count(*) AS a FROM ev CROSS JOIN lv GROUP BY ALL)
SELECT channel_id, arg_min(level, (abs(n / a::DOUBLE - 0.25), level)) AS level, round(1 - min(abs(n / a::DOUBLE - 0.25)), 6) AS score FROM h GROUP BY channel_id""")
def best_level(spark, sf):
    """Of each user the level that a quarter of the values pass most nearly; the first of equal ones."""
    s = series(spark, sf)
    each = {("level", x): s.groupBy("channel_id").agg((-F.abs(F.count(F.when(F.col("x") > x, 1)) / F.count("*") - 0.25)).alias("score")) for x in LEVELS}
    got = benchmark.best_settings(benchmark.sweep(each, "detector", "level"), ["channel_id"], "level", "score", "position")
    return got.select("channel_id", "level", r(1 + F.col("score"), 6).alias("score"))


# ---- adapter B: embeddings as cycles
def cycles(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    i = e.select((F.col("vec_id") - 1).alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("i"))
    return e.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v")).join(i, "vec_id")


CY = "cy AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS v, b.embedding::DOUBLE[] AS i FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), lg AS (SELECT vec_id, unnest(v) AS v, unnest(i) AS i, generate_subscripts(v, 1) - 1 AS k FROM cy)"


def long(df, column: str, keys=("vec_id",), name="k", n=5):
    """Points as rows. The outer form, without its rows of no point: for the inner one Spark computes the array twice, in a filter by its size below joins too."""
    points = df.select(*keys, F.posexplode_outer(column).alias(name, column)).where(F.col(name).isNotNull())
    return points.withColumn(column, r(column, n))


@query(f"WITH {CY} SELECT vec_id, round(avg(v * i), 7) AS p, round(sqrt(avg(v * v)) * sqrt(avg(i * i)), 7) AS s, round(sqrt(avg(v * v)), 6) AS vrms, round(sqrt(greatest(avg(v * v) * avg(i * i) - avg(v * i) * avg(v * i), 0)), 6) AS q, round(avg(v * i) / greatest(sqrt(avg(v * v)) * sqrt(avg(i * i)), 1e-12), 5) AS pf FROM lg GROUP BY vec_id")
def electrical_quantities(spark, sf):
    p, s = E.array_active_power("v", "i"), E.array_apparent_power("v", "i")
    c = cycles(spark, sf).select("vec_id", p.alias("p"), s.alias("s"), E.array_rms("v").alias("vrms"))
    return c.select("vec_id", r("p", 7).alias("p"), r("s", 7).alias("s"), r("vrms", 6).alias("vrms"), r(E.reactive(F.col("p"), F.col("s")), 6).alias("q"), r(E.power_factor(F.col("p"), F.col("s"))).alias("pf"))


@query(f"WITH {CY} SELECT vec_id, (k // 16)::BIGINT AS step, round(sqrt(avg(v * v)) * sqrt(avg(i * i)), 6) AS p FROM lg GROUP BY vec_id, k // 16")
def lowfreq_apparent(spark, sf):
    c = cycles(spark, sf).select("vec_id", F.posexplode(F.arrays_zip("v", "i")).alias("offset", "s")).select("vec_id", "offset", "s.v", "s.i", F.lit(64).alias("length"))
    return windows.block_means(c, ["vec_id"], 4, E.apparent_power("v", "i")).withColumn("p", r("p", 6))


@query(f"WITH {CY}, g AS (SELECT vec_id, avg(v * i) / (avg(v * v) + 1e-12) AS g FROM lg GROUP BY vec_id) SELECT lg.vec_id, k::INT AS k, round(g * v, 5) AS active, round(i - g * v, 5) AS residual FROM lg JOIN g ON g.vec_id = lg.vec_id")
def fryze(spark, sf):
    f = cycles(spark, sf).select("vec_id", E.fryze("v", "i").alias("f"))
    return f.select("vec_id", F.posexplode(F.arrays_zip("f.active", "f.residual")).alias("k", "s")).select("vec_id", "k", r("s.active").alias("active"), r("s.residual").alias("residual"))


@query(f"WITH {CY}, b AS (SELECT unnest(range(0, 10)) AS j) SELECT vec_id, j::INT AS k, round(avg(v), 5) AS y FROM lg JOIN b ON k >= floor(j * 64 / 10.0) AND k < ceil((j + 1) * 64 / 10.0) GROUP BY vec_id, j")
def paa(spark, sf):
    return long(cycles(spark, sf).select("vec_id", arrays.adaptive_mean("v", 10).alias("y")), "y")


@query(f"WITH {CY}, b AS (SELECT unnest(range(0, 8)) AS j) SELECT vec_id, j::INT AS patch, (k - 7 * j)::INT AS k, round(v, 5) AS y FROM lg JOIN b ON k >= 7 * j AND k < 7 * j + 12")
def patchify(spark, sf):
    c = cycles(spark, sf).select("vec_id", F.posexplode(arrays.patchify("v", 12, 7)).alias("patch", "y"))
    return long(c, "y", ("vec_id", "patch"))


@query(f"WITH {CY} SELECT a.vec_id, a.k::INT AS a, b.k::INT AS b, round(abs(a.v - b.v), 5) AS y FROM lg a JOIN lg b ON b.vec_id = a.vec_id")
def distance_matrix(spark, sf):
    c = cycles(spark, sf).select("vec_id", F.posexplode(arrays.distance_matrix("v")).alias("a", "y"))
    return long(c, "y", ("vec_id", "a"), "b")


@query(f"WITH {CY}, b AS (SELECT unnest(range(0, 25)) AS j), s AS (SELECT j, least(greatest((j + 0.5::DOUBLE) * 64 / 25 - 0.5::DOUBLE, 0::DOUBLE), 63) AS s FROM b) SELECT vec_id, j::INT AS k, round(v[floor(s)::INT + 1] + (v[least(floor(s)::INT + 1, 63) + 1] - v[floor(s)::INT + 1]) * (s - floor(s)), 5) AS y FROM cy CROSS JOIN s")
def resample_linear(spark, sf):
    return long(cycles(spark, sf).select("vec_id", arrays.resample_linear("v", 25).alias("y")), "y")


@query(f"WITH {CY} SELECT vec_id, k::INT AS k, round((v - 0.1::DOUBLE) / 0.25::DOUBLE, 5) AS y FROM lg")
def standard_scale(spark, sf):
    return long(cycles(spark, sf).select("vec_id", arrays.standard_scale("v", 0.1, 0.25).alias("y")), "y")


DFT = f"{CY}, h AS (SELECT unnest(range(0, 6)) AS h), z AS (SELECT vec_id, h, sum(v * cos(-2 * pi() * h * k / 64)) AS re, sum(v * sin(-2 * pi() * h * k / 64)) AS im, sum(i * cos(-2 * pi() * h * k / 64)) AS ri, sum(i * sin(-2 * pi() * h * k / 64)) AS ii FROM lg CROSS JOIN h GROUP BY vec_id, h)"


@query(f"WITH {DFT} SELECT vec_id, h::INT AS h, round(sqrt(ri * ri + ii * ii), 5) AS y FROM z")
def harmonics(spark, sf):
    return long(cycles(spark, sf).select("vec_id", arrays.harmonics("i", 6, False).alias("y")), "y", name="h")


@query(f"WITH {DFT} SELECT vec_id, h::INT AS k, round(re / 64, 6) AS y FROM z UNION ALL SELECT vec_id, (h + 6)::INT, round(im / 64, 6) FROM z")
def reim(spark, sf):
    out = long(cycles(spark, sf).select("vec_id", arrays.re_im("v", 6).alias("y")), "y", n=6)
    return out.withColumn("y", F.col("y") + 0.0)


@query(f"WITH {DFT}, t AS (SELECT unnest(range(0, 64)) AS k) SELECT vec_id, k::INT AS k, round(sum(CASE WHEN h = 0 THEN 1 ELSE 2 END * (re * cos(2 * pi() * h * k / 64) - im * sin(2 * pi() * h * k / 64))) / 64, 5) AS y FROM z CROSS JOIN t GROUP BY vec_id, k")
def harmonic_lowpass(spark, sf):
    return long(cycles(spark, sf).select("vec_id", arrays.harmonic_lowpass("v", 6).alias("y")), "y")


@query(f"WITH {DFT} SELECT a.vec_id, a.h::INT AS a, b.h::INT AS b, round(sqrt(pow((a.re * b.ri - a.im * b.ii) / 4096, 2) + pow((a.re * b.ii + a.im * b.ri) / 4096, 2)), 7) AS magnitude FROM z a JOIN z b ON b.vec_id = a.vec_id")
def dfia_crop(spark, sf):
    c = cycles(spark, sf).select("vec_id", F.posexplode(arrays.dfia("v", "i", 6)).alias("a", "row"))
    return c.select("vec_id", "a", F.posexplode("row").alias("b", "c")).select("vec_id", "a", "b", r("c.magnitude", 7).alias("magnitude"))


@query(f"WITH {CY}, pk AS (SELECT vec_id, greatest(max(abs(v)), 1e-12) AS pv, greatest(max(abs(i)), 1e-12) AS pi FROM lg GROUP BY vec_id), c AS (SELECT lg.vec_id, round_even((i / pi + 1.0::DOUBLE) / 2.0::DOUBLE * 15, 0)::INT AS row, round_even((v / pv + 1.0::DOUBLE) / 2.0::DOUBLE * 15, 0)::INT AS col, abs(v / pv * i / pi) AS p FROM lg JOIN pk ON pk.vec_id = lg.vec_id) SELECT vec_id, row, col, 1 AS occupancy, round(max(p), 5) AS power FROM c GROUP BY ALL")
def vi_occupancy(spark, sf):
    return arrays.vi_raster(cycles(spark, sf), ["vec_id"], "v", "i", 16).select("vec_id", "row", "col", "occupancy", r("power").alias("power"))


ZC = "zc AS (SELECT vec_id, k + greatest(least(v / (v - n), 1), 0) AS position FROM (SELECT vec_id, k, v, lead(v) OVER (PARTITION BY vec_id ORDER BY k) AS n FROM lg) WHERE v < 0 AND n >= 0)"


@query(f"WITH {CY}, {ZC} SELECT vec_id, round(position, 5) AS position FROM zc")
def zero_crossings(spark, sf):
    c = cycles(spark, sf).select(F.col("vec_id"), F.posexplode("v").alias("k", "v"))
    return align.rising_crossings(c, "vec_id", "v").withColumn("position", r("position"))


@query(f"WITH {CY}, {ZC}, d AS (SELECT vec_id, lead(position) OVER (PARTITION BY vec_id ORDER BY position) - position AS d FROM zc), o AS (SELECT vec_id, list(d ORDER BY d) AS ds FROM d WHERE d IS NOT NULL GROUP BY vec_id) SELECT vec_id, len(ds)::INT AS n, round(ds[(len(ds) + 1) // 2], 5) AS median FROM o")
def cycle_lengths(spark, sf):
    """The lower median of crossing distances, which is the expected cycle where f0 is unknown."""
    c = cycles(spark, sf).select("vec_id", align.array_crossings("v").alias("z"))
    d = c.select("vec_id", F.array_sort(F.transform(F.slice("z", 2, F.greatest(F.size("z") - 1, F.lit(0))), lambda x, k: x - F.get(F.col("z"), k))).alias("d")).where("size(d) > 0")
    return d.select("vec_id", F.size("d").alias("n"), r(F.element_at("d", ((F.size("d") + 1) / 2).cast("int"))).alias("median"))


@query(f"WITH {CY}, n AS (SELECT a.vec_id, a.k, abs(a.v) AS v, abs(a.i) AS i, abs(b.i) AS o FROM lg a JOIN lg b ON b.vec_id = a.vec_id + 1 AND b.k = a.k) SELECT vec_id, round(avg(v * (i + o)), 7) AS p_total, round(sum(i + o), 5) AS total, round(avg(v * i) + avg(v * o), 7) AS parts FROM n GROUP BY vec_id")
def mix_superpose(spark, sf):
    """Each cycle with the next one's current; the parts' powers add up to the whole."""
    c = cycles(spark, sf).withColumns({x: F.transform(x, F.abs) for x in ("v", "i")}).withColumns({"p_total": E.array_active_power("v", "i"), "presence": F.array(F.lit(1.0)), "power_mask": F.array(F.lit(True)), "is_unknown": F.lit(False)})
    c = c.withColumn("power", F.array("p_total"))
    other = c.withColumn("vec_id", F.col("vec_id") - 1)
    got = mixing.superposed(c, other, ["vec_id"])
    return got.select("vec_id", r("p_total", 7).alias("p_total"), r(E.total(F.col("i"))).alias("total"), r(F.element_at("power", 1), 7).alias("parts"))


@query(f"WITH {CY} SELECT vec_id, round(sqrt(avg(pow(v * 230 / rms, 2))), 5) AS vrms, round(avg(v * 230 / rms * i * rms / 230), 7) AS p FROM lg JOIN (SELECT vec_id AS id, sqrt(avg(v * v)) AS rms FROM lg GROUP BY vec_id) ON id = vec_id GROUP BY vec_id")
def voltage_normalise(spark, sf):
    """To 230 V; the power stays."""
    c = cycles(spark, sf).withColumn("s", 230.0 / E.array_rms("v"))
    c = c.withColumns({"v": F.transform("v", lambda x: x * F.col("s")), "i": F.transform("i", lambda x: x / F.col("s"))})
    return c.select("vec_id", r(E.array_rms("v")).alias("vrms"), r(E.array_active_power("v", "i"), 7).alias("p"))


@query(
    f"""WITH {EV}, c AS (SELECT channel_id, k, x - avg(x) OVER (PARTITION BY channel_id) AS v FROM ev),
n AS (SELECT *, lead(v) OVER (PARTITION BY channel_id ORDER BY k) AS nv FROM c),
z AS (SELECT channel_id, k + least(greatest(v / (v - nv), 0), 1) AS a FROM n WHERE v < 0 AND nv >= 0),
e AS (SELECT * FROM (SELECT *, lead(a) OVER (PARTITION BY channel_id ORDER BY a) AS b FROM z) WHERE b IS NOT NULL),
m AS (SELECT channel_id, quantile_disc(b - a, 0.5) AS expected FROM e GROUP BY channel_id),
y AS (SELECT e.*, row_number() OVER (PARTITION BY e.channel_id ORDER BY a) AS j FROM e JOIN m ON m.channel_id = e.channel_id WHERE abs(b - a - expected) <= 0.5 * expected AND b - a > 1),
q AS (SELECT channel_id, a + (b - a) * unnest(range(16)) / 16 AS p FROM y WHERE j <= 4),
g AS (SELECT q.channel_id, max(abs(v + coalesce(nv - v, 0) * (p - floor(p)))) AS peak FROM q JOIN n ON n.channel_id = q.channel_id AND n.k = floor(p)::BIGINT GROUP BY q.channel_id),
w AS (SELECT channel_id, count(*) AS n_valid FROM y WHERE j <= 4 GROUP BY channel_id)
SELECT u.channel_id, coalesce(n_valid, 0)::INT AS n_valid, round(coalesce(peak, 0.0), 5) AS peak FROM (SELECT DISTINCT channel_id FROM ev) u LEFT JOIN w ON w.channel_id = u.channel_id LEFT JOIN g ON g.channel_id = u.channel_id"""
)
def aligned_cycles(spark, sf):
    """Each user's values less their mean, as one signal; cycles by crossings at 16 points."""
    s = series(spark, sf).groupBy("channel_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda p: p["x"]).alias("x"))
    c = s.withColumn("v", E.let(E.mean(F.col("x")), lambda m: F.transform("x", lambda x: x - m)))
    got = c.select("channel_id", align.cycle_align_udf(1.0, 16, 4, None, 0.5)("v", "v").alias("a"))
    return got.select("channel_id", F.size(F.filter("a.mask", lambda m: m)).alias("n_valid"), r(F.array_max(F.transform(F.flatten("a.v"), F.abs))).alias("peak"))


@query(f"WITH {CY}, c AS (SELECT vec_id, k, v - avg(v) OVER (PARTITION BY vec_id) AS v FROM lg), h AS (SELECT unnest(range(0, 33)) AS h), m AS (SELECT vec_id, h, sqrt(pow(sum(v * cos(2 * pi() * h * k / 64)), 2) + pow(sum(v * sin(2 * pi() * h * k / 64)), 2)) AS a FROM c CROSS JOIN h GROUP BY vec_id, h) SELECT vec_id, arg_max(h, a) * 100 / 64.0::DOUBLE AS f0 FROM m GROUP BY vec_id")
def estimated_f0(spark, sf):
    return cycles(spark, sf).select("vec_id", align.estimate_f0_udf(100.0)("v").alias("f0"))


@query(f"""WITH {CY}, fr AS (SELECT unnest(range(0, 9)) AS f), pd AS (SELECT f, j, CASE WHEN f * 8 + j < 8 THEN 8 - f * 8 - j WHEN f * 8 + j > 71 THEN 134 - f * 8 - j ELSE f * 8 + j - 8 END AS k, 0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / 16) AS w FROM fr CROSS JOIN (SELECT unnest(range(0, 16)) AS j)),
b AS (SELECT unnest(range(0, 9)) AS h), z AS (SELECT vec_id, h, f, sum(v * w * cos(2 * pi() * h * j / 16)) AS re, sum(v * w * sin(2 * pi() * h * j / 16)) AS im FROM lg JOIN pd ON pd.k = lg.k CROSS JOIN b GROUP BY ALL)
SELECT vec_id, h::INT AS bin, f::INT AS frame, round(10 * log10(greatest(sqrt(re * re + im * im) / sqrt(6.0::DOUBLE), 1e-10)), 4) AS db FROM z""")
def spectrogram(spark, sf):
    c = cycles(spark, sf).select("vec_id", F.posexplode(arrays.spectrogram_udf(16, 8)("v")).alias("bin", "row"))
    return c.select("vec_id", "bin", F.posexplode("row").alias("frame", "db")).withColumn("db", r("db", 4))


@query(f"WITH {CY} SELECT vec_id, (k // 8)::INT AS step, round(avg(v * i), 7) AS active, round(sqrt(avg(v * v)) * sqrt(avg(i * i)), 7) AS apparent FROM lg GROUP BY vec_id, k // 8")
def lowfreq_view(spark, sf):
    c = cycles(spark, sf)
    a = long(views.LowFreqView(1.0, 8)(c).select("vec_id", F.col("p").alias("active")), "active", name="step", n=7)
    return a.join(long(views.LowFreqView(1.0, 8, "apparent")(c).select("vec_id", F.col("p").alias("apparent")), "apparent", name="step", n=7), ["vec_id", "step"])


@query(f"WITH {CY} SELECT vec_id, round(avg(v * i), 6) AS p, round(avg(v * i) / greatest(sqrt(avg(v * v)) * sqrt(avg(i * i)), 1e-12), 5) AS pf, TRUE AS scaled FROM lg GROUP BY vec_id")
def jitter(spark, sf):
    """What jitter leaves: the power under voltage jitter; the power factor, and power over p_total, under gain jitter."""
    c = cycles(spark, sf).withColumn("p_total", E.array_active_power("v", "i")).withColumn("power", F.array("p_total"))
    a = mixing.voltage_jitter(c, 0.1, 7, ["vec_id"]).select("vec_id", r(E.array_active_power("v", "i"), 6).alias("p"))
    g = mixing.gain_jitter(c, 0.1, 7, ["vec_id"]).withColumn("now", E.array_active_power("v", "i"))
    near = F.abs(F.col("now") - F.col("p_total")) + F.abs(F.element_at("power", 1) - F.col("p_total")) <= 1e-9
    return a.join(g.select("vec_id", r(E.power_factor(F.col("now"), E.array_apparent_power("v", "i"))).alias("pf"), near.alias("scaled")), "vec_id")


# ---- metrics
def judged(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return table(spark, sf, "labels").join(d, "doc_id").select("doc_id", "lang", "quality", "toxic", (F.pmod(F.col("doc_id") * 37, F.lit(101)) / 101.0).alias("score"))


JD = "jd AS (SELECT l.doc_id, lang, quality, toxic, (l.doc_id * 37 % 101) / 101.0::DOUBLE AS score FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"


@query(f"WITH {JD}, c AS (SELECT lang, sum((quality = 1 AND toxic = 1)::INT) AS tp, sum((quality = 1 AND toxic = 0)::INT) AS fp, sum((quality = 0 AND toxic = 1)::INT) AS fn FROM jd GROUP BY lang) SELECT round(avg(CASE WHEN tp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn + 1e-9) END), 6) AS f1_macro, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn) + 1e-9), 6) AS f1_micro FROM c")
def metrics_detection(spark, sf):
    return metrics.detection_f1(judged(spark, sf), "quality", "toxic", "lang").select(r("f1_macro", 6).alias("f1_macro"), r("f1_micro", 6).alias("f1_micro"))


@query(f"WITH {JD}, c AS (SELECT sum((quality = 1 AND toxic = 1)::INT)::DOUBLE AS tp, sum((quality = 1 AND toxic = 0)::INT)::DOUBLE AS fp, sum((quality = 0 AND toxic = 1)::INT)::DOUBLE AS fn, sum((quality = 0 AND toxic = 0)::INT)::DOUBLE AS tn FROM jd) SELECT round((tp * tn - fp * fn) / greatest(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 1e-9), 6) AS mcc FROM c")
def metrics_mcc(spark, sf):
    return metrics.matthews(judged(spark, sf), "quality", "toxic").select(r("mcc", 6).alias("mcc"))


@query(f"WITH {JD}, c AS (SELECT CASE WHEN score > 0.5 THEN score ELSE 1 - score END AS c, ((score > 0.5) = (quality = 1))::INT AS k FROM jd), b AS (SELECT sum(c) AS c, sum(k) AS k, count(*) AS n FROM c GROUP BY least(floor(c * 15), 14)) SELECT round(sum(abs(c - k)) / sum(n), 6) AS ece FROM b")
def metrics_calibration(spark, sf):
    return metrics.calibration_error(judged(spark, sf), "score", "quality").select(r("ece", 6).alias("ece"))


@query(f"WITH {JD}, k AS (SELECT quality, row_number() OVER (ORDER BY score, doc_id) AS r FROM jd), c AS (SELECT sum(CASE WHEN quality = 1 THEN r END) AS r, sum(quality) AS p, sum(1 - quality) AS n FROM k) SELECT CASE WHEN p > 0 AND n > 0 THEN round((r - p * (p + 1) / 2.0::DOUBLE) / (p::DOUBLE * n), 6) END AS auroc FROM c")
def metrics_auroc(spark, sf):
    return metrics.unknown_auroc(judged(spark, sf), "score", "quality", "doc_id").select(r("auroc", 6).alias("auroc"))


def powers(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("window"), F.col("l_returnflag").alias("appliance"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("power_pred"), F.col("l_extendedprice").alias("power"), (F.col("l_linestatus") == "F").alias("mask"))


PW = "pw AS (SELECT l_orderkey AS w, l_returnflag AS a, l_extendedprice * (1 - l_discount) AS p, l_extendedprice AS y, l_linestatus = 'F' AS m FROM lineitem)"


@query(f"WITH {PW}, f AS (SELECT sum(abs(p - y)) FILTER (WHERE m) / greatest(count(*) FILTER (WHERE m), 1) AS mae, sum(abs(p - y)) FILTER (WHERE m) / greatest(sum(abs(y)) FILTER (WHERE m), 1e-9) AS nde FROM pw), s AS (SELECT avg(abs(sp - sy) / sy) AS sae FROM (SELECT sum(p) AS sp, sum(y) AS sy FROM pw WHERE m GROUP BY a)), t AS (SELECT avg(1 - e / (2 * y)) AS teca FROM (SELECT sum(abs(p - y)) AS e, sum(y) AS y FROM pw GROUP BY w) WHERE y > 1e-9) SELECT round(mae, 4) AS mae, round(nde, 6) AS nde, round(sae, 6) AS sae, round(teca, 6) AS teca FROM f, s, t")
def metrics_power(spark, sf):
    got = metrics.power_metrics(powers(spark, sf), "power_pred", "power", "appliance", "window", "mask")
    return got.select(r("mae", 4).alias("mae"), *(r(c, 6).alias(c) for c in ("nde", "sae", "teca")))


@query(f"WITH {PW}, b AS (SELECT p, y, p > 20000 AS op, y > 21000 AS oy FROM pw), c AS (SELECT sum((op AND oy AND abs(p - y) <= 0.05::DOUBLE * abs(y))::INT) AS af, sum((op AND oy AND NOT abs(p - y) <= 0.05::DOUBLE * abs(y))::INT) AS i1, sum((op AND oy AND abs(p - y) <= 2000)::INT) AS aj, sum((op AND oy AND NOT abs(p - y) <= 2000)::INT) AS i2, sum((op AND NOT oy)::INT) AS fp, sum((NOT op AND oy)::INT) AS fn FROM b) SELECT round(af / (af + i1 + 0.5 * (fp + fn) + 1e-9), 6) AS modified_f1, round(aj / (aj + i2 + fp + fn + 1e-9), 6) AS modified_jaccard FROM c")
def metrics_joint(spark, sf):
    p = powers(spark, sf).withColumns({"on_p": F.col("power_pred") > 20000, "on_y": F.col("power") > 21000})
    got = metrics.joint_metrics(p, "power_pred", "power", "on_p", "on_y", 0.05, 2000.0)
    return got.select(r("modified_f1", 6).alias("modified_f1"), r("modified_jaccard", 6).alias("modified_jaccard"))


@query("WITH v AS (SELECT l_returnflag AS arm, 'mae' AS metric, avg(l_extendedprice * l_discount) AS value FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'f1', avg(l_discount) FROM lineitem GROUP BY 1) SELECT v.arm, v.metric, round(v.value, 4) AS value, round((v.value - b.value) * CASE WHEN v.metric = 'mae' THEN -1 ELSE 1 END, 4) AS delta FROM v JOIN v b ON b.metric = v.metric AND b.arm = 'N'")
def compare_arms(spark, sf):
    li = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("arm")).agg(F.avg(F.col("l_extendedprice") * F.col("l_discount")).alias("mae"), F.avg("l_discount").alias("f1"))
    got = metrics.compare(li.unpivot(["arm"], ["mae", "f1"], "metric", "value"), "N", ["mae"])
    return got.select("arm", "metric", r("value", 4).alias("value"), r("delta", 4).alias("delta"))


# ---- streams
def event_stream(spark, sf):
    """The table as a stream of files, all that is there now."""
    import os
    import uuid

    path = f"{sf}/events.parquet"
    source = spark.readStream.schema(table(spark, sf, "events").schema)
    if not path.startswith("/") or os.path.isdir(path):
        return source.parquet(path), f"s{uuid.uuid4().hex}"
    return source.option("pathGlobFilter", "events.parquet").parquet(sf), f"s{uuid.uuid4().hex}"


@query(f"WITH {EV}, {RUNS} SELECT channel_id, min(t) AS start, max(t) AS stop, count(*)::BIGINT AS n FROM g3 GROUP BY channel_id, run")
def session_stream(spark, sf):
    s, name = event_stream(spark, sf)
    got = jobs.to_table(jobs.sessions(s.withColumnRenamed("user_id", "channel_id"), "channel_id", "ts", "1 day"), name, "complete")
    return got.where("n > 1").select("channel_id", F.unix_micros("start").alias("start"), F.unix_micros("stop").alias("stop"), "n")


@query(f"SELECT user_id AS channel_id, epoch_us(ts) // {DAY} AS day, round(avg(value), 5) AS p, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def tumbling_stream(spark, sf):
    s, name = event_stream(spark, sf)
    got = jobs.to_table(jobs.tumbling(s.withColumnRenamed("user_id", "channel_id"), "channel_id", "ts", "value", "1 day"), name, "complete")
    return got.select("channel_id", F.floor(F.unix_micros("start") / DAY).alias("day"), r("p").alias("p"), "n")


@query(SQL["cusum_events"])
def cusum_stream(spark, sf):
    s, name = event_stream(spark, sf)
    return jobs.to_table(jobs.cusum(s.withColumnRenamed("user_id", "channel_id"), "channel_id", "ts", "value", 16, 120.0, 5.0), name, "append")


@query(SQL["zscore_events"])
def zscore_stream(spark, sf):
    s, name = event_stream(spark, sf)
    return jobs.to_table(jobs.zscore(s.withColumnRenamed("user_id", "channel_id"), "channel_id", "ts", "value", 8, 2.0, 3, 5.0), name, "append")


@query(f"""WITH {EV}, n AS (SELECT channel_id, k, x - 50 AS v, lead(x) OVER (PARTITION BY channel_id ORDER BY k) - 50 AS nv FROM ev),
z AS (SELECT channel_id, k, k - v / (nv - v + 1e-9) AS a, lead(k) OVER (PARTITION BY channel_id ORDER BY k) AS k2, lead(k - v / (nv - v + 1e-9)) OVER (PARTITION BY channel_id ORDER BY k) AS b FROM n WHERE v < 0 AND nv >= 0),
q AS (SELECT channel_id, k AS start, j, a + (b - a) / 4 * j AS p FROM z CROSS JOIN (SELECT unnest(range(4)) AS j) WHERE abs(k2 - k - 4) <= 2)
SELECT q.channel_id, start::BIGINT AS start, j::INT AS k, round(v + coalesce(nv - v, 0) * (p - floor(p)), 5) AS v FROM q JOIN n ON n.channel_id = q.channel_id AND n.k = floor(p)::BIGINT""")
def cycle_stream(spark, sf):
    s, name = event_stream(spark, sf)
    s = s.withColumn("value", F.col("value") - 50).withColumn("i", F.col("value") * 2).withColumnRenamed("user_id", "channel_id")
    got = jobs.to_table(jobs.cycles(s, "channel_id", "ts", "value", "i", 4, 2), name, "append")
    return long(got, "v", ("channel_id", "start"))


def flagship(spark, sf):
    """Detection end to end: steps found in each series, matched with the true transitions, scored by user."""
    p, a = predicted_and_true(spark, sf)
    by = lambda df: df.withColumn("house", F.col("channel_id"))
    return match.event_counts(by(p), by(a), "channel_id", 3, ["house"])
