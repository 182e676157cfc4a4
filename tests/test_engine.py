import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattspark.functions import align, arrays, labels
from wattspark.functions import electrical as E
from wattspark.operators import benchmark, detect, match, metrics, mixing, splits, windows
from wattspark.operators import timeseries as T
from wattspark.plans import views
from wattspark.plans.measurement import Measurement
from wattspark.streaming import jobs


def long(spark, x, channel="c"):
    return spark.createDataFrame([(channel, k, float(v)) for k, v in enumerate(x)], "channel_id string, k long, x double")


def ks(df):
    return sorted(r["k"] for r in df.collect())


# ---- series
def test_gaps_and_grid(spark):
    rows = [("c", t * 10**6, float(t)) for t in (0, 6, 12, 5000, 5006, 5012, 9000)]
    df = spark.createDataFrame(rows, "channel_id string, t long, x double")
    runs = sorted((r["run"], r["start"] // 10**6, r["n"]) for r in T.runs(df, "channel_id", "t", 300 * 10**6).collect())
    assert runs == [(0, 0, 3), (1, 5000, 3)]  # the single reading goes
    split = T.split_on_gaps(df.limit(3), "channel_id", "t", 300 * 10**6)
    assert T.forward_fill_to_grid(split, "channel_id", "t", "x", 10**6).count() == 13


def test_gap_of_exactly_the_limit_does_not_split(spark):
    df = spark.createDataFrame([("c", 0, 1.0), ("c", 300, 1.0), ("c", 601, 1.0), ("c", 700, 1.0)], "channel_id string, t long, x double")
    assert T.runs(df, "channel_id", "t", 300).count() == 2


@pytest.mark.parametrize("block", [None, 7, 64])
def test_frames_pad_with_the_edge(spark, block):
    x = np.random.default_rng(0).normal(1000, 5, 50)
    got = T.frame_stats(long(spark, x), "channel_id", "x", {"c": (-4, 0), "l": (-3, -1), "r": (1, 6)}, block).orderBy("k").collect()
    p = np.concatenate([[x[0]] * 6, x, [x[-1]] * 6])
    for k, row in enumerate(got):
        for name, part in (("c", p[k + 2 : k + 7]), ("l", p[k + 3 : k + 6]), ("r", p[k + 7 : k + 13])):
            assert row[f"{name}_mean"] == pytest.approx(part.mean()) and row[f"{name}_var"] == pytest.approx(part.var(), abs=1e-7)


def test_suppression_and_runs(spark):
    events = long(spark, [0] * 30).where("k in (1, 3, 8, 9, 17)").select("channel_id", "k")
    assert ks(T.suppressed(events, "channel_id", 8)) == [1, 9, 17]
    mask = long(spark, [1, 0, 1, 1, 1, 0, 0, 0, 1]).withColumn("on", F.col("x") > 0)
    closed = T.close_short_runs(T.islands(mask, "channel_id", "on"), "channel_id", "on", 2)
    assert [(r["start"], r["on"]) for r in closed.orderBy("start").collect()] == [(0, True), (1, True), (2, True), (5, False), (8, False)]


def test_segments(spark):
    n = spark.createDataFrame([("c", 10)], "channel_id string, n long")
    events = spark.createDataFrame([("c", 4), ("c", 6)], "channel_id string, k long")
    got = T.segments(events, n, "channel_id", 3)
    assert sorted((r["start"], r["stop"]) for r in got.collect()) == [(0, 4), (6, 10)]


# ---- detectors, on signals without noise
def test_steps(spark):
    step = long(spark, [0.0] * 60 + [2000.0] * 60)
    assert ks(detect.ZScore(10, 3.0, 1).apply(step)) == []  # the score equals the threshold
    for d in (detect.Glr(10, 10), detect.GoodnessOfFit(10, 10), detect.AdaptiveThreshold(10)):
        assert len(ks(d.apply(step))) >= 1 and abs(ks(d.apply(step))[0] - 59) <= 10


def test_glr_finds_both_edges(spark):
    x = [0.0] * 60 + [2000.0] * 60 + [0.0] * 40
    noise = np.random.default_rng(3).normal(0, 4, len(x))
    found = ks(detect.Glr(20, 20, 1000.0, 20, 100.0).apply(long(spark, np.array(x) + noise)))
    assert len(found) == 2 and abs(found[0] - 59) <= 20 and abs(found[1] - 119) <= 20


def test_cusum_against_a_plain_loop(spark):
    x = np.random.default_rng(1).normal(50, 20, 200)
    want, up, down = [], 0.0, 0.0
    for k in range(200):
        mean = np.mean([x[max(j, 0)] for j in range(k - 15, k + 1)])
        up, down = max(up + x[k] - mean - 1, 0), max(down - x[k] + mean - 1, 0)
        if up > 50 or down > 50:
            want.append(k)
            up = down = 0.0
    assert ks(detect.Cusum(16, 50.0, 1.0).apply(long(spark, x))) == want


def test_active_sections(spark):
    x = [0.0] * 40 + [100.0, 0.0] * 20 + [0.0] * 40
    got = detect.ActiveSections(8, 20.0, 4).sections(long(spark, x)).collect()
    assert len(got) == 1 and got[0]["start"] in (40, 41) and 80 <= got[0]["stop"] <= 88


def test_multivariate_rules(spark):
    a, b = [0.0] * 40 + [100.0] * 40, [0.0] * 42 + [100.0] * 38
    df = spark.createDataFrame([("c", k, p, q, 0.0) for k, (p, q) in enumerate(zip(a, b))], "channel_id string, k long, a double, b double, z double")
    d = detect.AdaptiveThreshold(8, 20.0, 4.0, 16)
    assert len(ks(detect.Multivariate(d, "any", 4).apply_many(df, ["a", "b", "z"]))) >= 1
    assert ks(detect.Multivariate(d, "all", 4).apply_many(df, ["a", "b", "z"])) == []
    assert len(ks(detect.Multivariate(d, "vote", 4).apply_many(df, ["a", "b", "z"]))) >= 1
    with pytest.raises(ValueError):
        detect.Multivariate(d, "most", 4).apply_many(df, ["a"])


def test_matching(spark):
    of = lambda xs: spark.createDataFrame([("c", x) for x in xs], "channel_id string, k long")
    got = match.match_events(of([10, 51, 200]), of([12, 50]), "channel_id", 5)
    assert sorted((r["predicted"], r["actual"]) for r in got.collect()) == [(10, 12), (51, 50)]
    c = match.event_counts(of([10, 51, 200]), of([12, 50]), "channel_id", 5).first()
    assert (c["tp"], c["fp"], c["fn"]) == (2, 1, 0) and c["f1"] == pytest.approx(0.8) and c["timing"] == 1.5


# ---- arrays and alignment
def test_transforms_equal_numpy(spark):
    x = np.random.default_rng(2).normal(size=64)
    df = spark.createDataFrame([([float(v) for v in x],)], "x array<double>")
    z = np.fft.rfft(x)
    got = df.select(arrays.harmonic_lowpass("x", 6).alias("a"), arrays.re_im("x", 40).alias("b"), arrays.harmonics("x", 6, False).alias("c"), arrays.lowpass_udf(6)("x").alias("d")).first()
    assert np.allclose(got["a"], np.fft.irfft(np.where(np.arange(33) < 6, z, 0), 64)) and np.allclose(got["a"], got["d"])
    pad = np.concatenate([z / 64, np.zeros(7)])
    assert np.allclose(got["b"], np.concatenate([pad.real, pad.imag])) and np.allclose(got["c"], np.abs(z[:6]))


def test_bins_and_patches(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0],)], "x array<double>")
    got = df.select(arrays.adaptive_mean("x", 2).alias("a"), arrays.patchify("x", 2, 2).alias("b"), arrays.resample_linear("x", 10).alias("c"), arrays.patchify("x", 9).alias("d")).first()
    assert got["a"] == [2.0, 4.0] and got["b"] == [[1.0, 2.0], [3.0, 4.0]] and got["d"] == []
    assert np.allclose(got["c"], np.interp(np.clip((np.arange(10) + 0.5) / 2 - 0.5, 0, 4), np.arange(5), [1, 2, 3, 4, 5]))


@pytest.mark.parametrize("f0", [49.3, 50.0, 59.4, 60.0])
def test_alignment_of_a_sine(spark, f0):
    fs, size = 6000.0, 64
    t = np.arange(2400) / fs
    v = np.sin(2 * math.pi * f0 * t + 0.3)
    df = spark.createDataFrame([(v.tolist(), (2 * v).tolist())], "v array<double>, i array<double>")
    a = df.select(align.cycle_align_udf(fs, size, 10, f0)("v", "i").alias("a")).first()["a"]
    assert all(a["mask"]) and np.abs(np.array(a["v"]) - np.sin(2 * math.pi * np.arange(size) / size)).max() < 1e-3
    got = df.select(align.estimate_f0_udf(fs)("v")).first()[0]
    assert abs(got - f0) <= fs / 2400 / 2 + 1e-9


def test_too_few_cycles_are_padded(spark):
    df = spark.createDataFrame([([0.0] * 50, [1.0] * 50)], "v array<double>, i array<double>")
    a = df.select(align.cycle_align_udf(1000.0, 8, 3, 50.0)("v", "i").alias("a")).first()["a"]
    assert a["mask"] == [False] * 3 and a["v"] == [[0.0] * 8] * 3


def test_window_sizes():
    assert views.window_samples(views.HighFreqView(10), 6000, 50) == 1716
    assert views.window_samples(views.HighFreqView(20), 6000, 50) == 3276
    assert views.window_samples(views.LowFreqView(1.0, 60), 6000) == 360_000


def test_window_index(spark):
    ch = spark.createDataFrame([("a", 12_000), ("b", 10)], "channel_id string, n_samples long")
    got = windows.window_index(ch, F.lit(937))
    assert got.count() == 12 and {r["channel_id"] for r in got.collect()} == {"a"}
    with pytest.raises(ValueError):
        windows.window_index(ch, F.lit(5), 1.5)


# ---- measurements
def test_measurement(spark):
    t = np.arange(6000) / 6000
    v = 230 * math.sqrt(2) * np.sin(2 * math.pi * 50 * t)
    m = Measurement.from_vi(spark, v, 10 * math.sqrt(2) * np.sin(2 * math.pi * 50 * t - 0.5), 6000.0, f0=50.0)
    assert m.vrms() == pytest.approx(230, rel=1e-6) and m.irms() == pytest.approx(10, rel=1e-6)
    assert m.active_power() == pytest.approx(2300 * math.cos(0.5), rel=1e-6) and m.power_factor() == pytest.approx(math.cos(0.5), rel=1e-6)
    both = m + m
    assert both.n_components == 2 and both.active_power() == pytest.approx(2 * m.active_power())
    h = m.aligned(64).harmonics(4)
    assert h[1] == 1 and max(h[0], h[2], h[3]) < 1e-3
    p = Measurement.from_power(spark, [0.0] * 40 + [2000.0] * 40 + [0.0] * 40, 1.0)
    assert p.events(detect.ZScore(8, 2.5, 8, 100.0)) == [40, 80]
    assert p.window(30, 20).n_samples == 20
    with pytest.raises(ValueError):
        m.aligned(64).window(0, 10)


# ---- labels, splits, mixing, metrics
def test_normalise(spark):
    rows = ["Fridge-Freezer(2)", "Washing Machine", "washing_machine", "???", "Magimix(Blender)", "  TV / Satellite ", "Freezer(garage)"]
    df = spark.createDataFrame([(x,) for x in rows], "x string")
    assert [r[0] for r in df.select(labels.normalise("x")).collect()] == ["fridge_freezer", "washing_machine", "washing_machine", "", "magimix_blender", "tv_satellite", "freezer_garage"]
    t = labels.Taxonomy()
    got = [r["canonical"] for r in t.resolve(df, "x").collect()]
    assert got == ["fridge_freezer", "washing_machine", "washing_machine", None, None, "television", "freezer"]
    with pytest.raises(ValueError):
        labels.Taxonomy({"a": ["x"], "b": ["X"]}).table(spark)
    with pytest.raises(Exception, match="no canonical"):
        labels.Taxonomy(strict=True).resolve(df, "x").collect()


def test_split_holds_groups_together(spark):
    rows = [(f"c{k}", "d", f"h{k % 5}", "kettle", None if k % 4 else f"b{k % 3}", f"i{k}", 10.0, 100) for k in range(40)]
    ch = spark.createDataFrame(rows, "channel_id string, dataset string, house string, appliance string, brand string, instance_id string, fs double, n_samples long")
    s = splits.LeaveHouseOut(0.4, 0.2, 1).apply(ch)
    assert splits.check_leakage(s.folds, ch, ["house"]).count() == 0
    assert {f: len(g) for f, g in s.manifest["groups"].items()} == {"train": 2, "val": 2, "test": 1}
    assert splits.LeaveBrandOut(seed=1).apply(ch).folds.count() == 10
    with pytest.raises(ValueError):
        splits.CrossDataset(["d"], ["d"]).apply(ch)
    with pytest.raises(ValueError):
        splits.UnseenAppliance(["toaster"]).apply(ch)


def test_superposition_keeps_power(spark):
    r = np.random.default_rng(4)
    item = lambda k: (k, [float(x) for x in 230 * r.normal(size=40)], [float(x) for x in r.normal(size=40)], [1.0, 0.0], [5.0, 2.0], [True, True], False)
    df = spark.createDataFrame([item(0), item(1)], "window_idx int, v array<double>, i array<double>, presence array<double>, power array<double>, power_mask array<boolean>, is_unknown boolean")
    df = df.withColumn("p_total", E.array_active_power("v", "i"))
    df = df.withColumn("power", F.array(F.col("p_total"), F.lit(0.0)))
    plan = spark.createDataFrame([(0, 0, 1)], "window_idx int, `order` int, partner int")
    rows = {x["window_idx"]: x for x in mixing.mixed(df, plan, 1).collect()}
    assert rows[0]["n_components"] == 2 and rows[1]["n_components"] == 1
    plan_ = mixing.partner_plan([0, 1, 2], {0: "a", 1: "b", 2: "c"}, {0: "a", 1: "b", 2: "c"}, seed=3)
    assert plan_ == mixing.partner_plan([0, 1, 2], {0: "a", 1: "b", 2: "c"}, {0: "a", 1: "b", 2: "c"}, seed=3)
    jittered = mixing.voltage_jitter(df, 0.1, 1, ["window_idx"]).withColumn("q", E.array_active_power("v", "i")).collect()
    assert all(x["q"] == pytest.approx(x["p_total"]) for x in jittered)


@pytest.mark.parametrize("names,tries", [("ab", 2), ("aaab", 1), ("abcde", 16), ("a", 3)])
def test_partner_plans_equal_the_plan_of_single_windows(spark, names, tries):
    channel = {i * i: None if i % 11 == 5 else names[i % len(names)] for i in range(150)}
    pool = {w: c for w, c in channel.items() if w % 3 != 1}
    table = lambda rows: spark.createDataFrame(list(rows.items()), "window_idx long, channel_id string").repartition(3)
    for k, p in (((2, 3), 1.0), ((1, 4), 0.6)):
        got = mixing.partner_plans(table(channel), table(pool), k, p, seed=7, epoch=2, max_tries=tries)
        assert sorted(map(tuple, got.collect())) == sorted(mixing.partner_plan(list(channel), pool, channel, k, p, 7, 2, tries))
    assert mixing.partner_plans(table(channel).where("false"), table(pool)).count() == 0
    assert mixing.partner_plans(table(channel), table(pool).where("false")).count() == 0


def test_metrics(spark):
    df = spark.createDataFrame([("w1", "a", 10.0, 10.0), ("w1", "b", 5.0, 10.0), ("w2", "a", 20.0, 20.0), ("w2", "b", 15.0, 10.0)], "window string, appliance string, power_pred double, power double")
    m = metrics.power_metrics(df, "power_pred", "power", "appliance", "window").first()
    assert m["mae"] == 2.5 and m["nde"] == pytest.approx(0.2) and m["sae"] == 0
    e = metrics.Evaluator()
    e.update(df)
    assert set(e.compute()) == {"mae", "nde", "sae", "teca"} and "mae" in e.report()
    scores = spark.createDataFrame([(1, 0.9, 1), (2, 0.8, 1), (3, 0.3, 0), (4, 0.2, 0)], "id int, s double, y int")
    assert metrics.unknown_auroc(scores, "s", "y", "id").first()[0] == 1.0


def plain_frames(x, a, b):
    """Mean and variance of each frame [k + a, k + b], edge values standing for what misses."""
    out = []
    for k in range(len(x)):
        own = [x[min(max(j, 0), len(x) - 1)] for j in range(k + a, k + b + 1)]
        m = sum(own) / len(own)
        out.append((m, sum((v - m) ** 2 for v in own) / len(own)))
    return out


@pytest.mark.parametrize("block", [3, 7, 8, 16, 64])
@pytest.mark.parametrize("frame", [5, 32, 64])
def test_blocks_shorter_than_the_frame_change_nothing(spark, block, frame):
    import random

    from wattspark.operators import timeseries

    x = [random.Random(block).gauss(100, 20) + 50 * (k > 60) for k in range(120)]
    df = spark.createDataFrame([("c", k, v) for k, v in enumerate(x)], "channel_id string, k long, x double")
    got = timeseries.frame_stats(df, "channel_id", "x", {"l": (-frame, -1), "r": (1, frame)}, block).orderBy("k").collect()
    for name, (a, b) in {"l": (-frame, -1), "r": (1, frame)}.items():
        for row, (m, v) in zip(got, plain_frames(x, a, b), strict=True):
            assert abs(row[f"{name}_mean"] - m) < 1e-9 and abs(row[f"{name}_var"] - v) < 1e-6


def test_folds_equal_plain_loops(spark):
    import random

    from wattspark.operators import detect, timeseries

    r = random.Random(2)
    events = {c: sorted(r.sample(range(400), 60)) for c in ("a", "b", None)}
    df = spark.createDataFrame([(c, k) for c, ks in events.items() for k in ks], "channel_id string, k long").repartition(3)
    want = set()
    for c, ks in events.items():
        last = None
        for k in ks:
            if last is None or k - last >= 9:
                want.add((c, k))
                last = k
    assert {tuple(x) for x in timeseries.suppressed(df, "channel_id", 9).collect()} == want
    runs, at, on = [], 0, False
    for _ in range(80):
        n = r.randint(1, 12)
        runs.append(("a", at, at + n, on))
        at, on = at + n, not on
    held, closed = None, []
    for c, a, b, on in runs:
        held = on if held is None or b - a >= 5 else held
        closed.append((c, a, b, held))
    got = timeseries.close_short_runs(spark.createDataFrame(runs, "channel_id string, start long, stop long, on boolean"), "channel_id", "on", 5)
    assert sorted(map(tuple, got.collect())) == closed
    x = [r.gauss(0, 3) + 30 * (150 < k < 200) for k in range(300)]
    series = spark.createDataFrame([("a", k, v) for k, v in enumerate(x)], "channel_id string, k long, x double")
    up = down = 0.0
    fired = []
    for k, v in enumerate(x):
        d = v - sum(x[max(j, 0)] for j in range(k - 15, k + 1)) / 16
        up, down = max(up + d - 1, 0.0), max(down - d - 1, 0.0)
        if up > 40 or down > 40:
            fired.append(k)
            up = down = 0.0
    assert fired and sorted(row["k"] for row in detect.Cusum(16, 40.0, 1.0).apply(series).collect()) == fired


def test_labels_are_case_folded(spark):
    from wattspark.functions import labels

    words = ["Stra\u00dfe", "\u212aettle", "o\ufb03ce", "fri\u00a0dge (\u0662)", "\u017fink", None]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(labels.normalise("w")).collect()]
    assert got == ["strasse", "kettle", "office", "fri_dge", "sink", None]


def test_splits_check_their_sizes(spark):
    from wattspark.operators import splits

    for bad in ({"test_size": 0.0}, {"test_size": 1.0}, {"holdout_size": 1.0}, {"holdout_size": -0.1}, {"test_size": 0.6, "holdout_size": 0.4}):
        with pytest.raises(ValueError):
            splits.RandomSplit(**bad)
    with pytest.raises(ValueError, match="no column"):
        splits.LeaveHouseOut().apply(spark.createDataFrame([("a", "i")], "channel_id string, instance_id string"))


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_benchmark_alignment(spark):
    """Against the rule by hand: the run with more overlaps wins over a longer one; shifts are whole samples; the later run holds."""
    mains = frame(spark, [("h", "m0", 0.0, 1.0, 20), ("h", "m1", 100.0, 1.0, 10)], "house string, run string, t0 double, fs double, n long")
    runs = [("h", "a", "r0", 97.0, 1.0, 6), ("h", "a", "r1", 102.0, 1.0, 3), ("h", "b", "r2", 101.6, 1.0, 9), ("h", "c", "r3", 5.0, 1.0, 9), ("h", "d", "r4", 103.0, 1.0, 1)]
    subs = frame(spark, runs, "house string, appliance string, run string, t0 double, fs double, n long")
    series = frame(spark, [("h", a, r, k, 10.0 * k + 1) for _, a, r, _, _, n in runs for k in range(n)], "house string, appliance string, run string, k long, p double")
    assert {r["run"]: r["overlaps"] for r in benchmark.overlap_counts(mains, subs, 1.5).collect()} == {"m0": 1, "m1": 3}
    got = {}
    for r in benchmark.aligned(mains, subs, series, 1.0, 1.5).collect():
        got.setdefault(r["appliance"], {})[r["k"]] = r["p"]
    assert set(got) == {"a", "b", "d"} and all(sorted(x) == list(range(10)) for x in got.values())
    assert [got["a"][k] for k in range(10)] == [31.0, 41.0, 1.0, 11.0, 21.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    assert [got["b"][k] for k in range(10)] == [0.0, 0.0] + [10.0 * k + 1 for k in range(8)] and got["d"][3] == 1.0
    assert benchmark.aligned(mains.where("false"), subs, series).count() == 0


def test_overlap_counts_equal_all_pairs(spark):
    r = np.random.default_rng(8)
    rows = [("h", f"r{i}", float(a), 0.5, int(n)) for i, (a, n) in enumerate(zip(r.integers(0, 60, 80), r.integers(0, 12, 80)))]
    mains = frame(spark, rows[:30], "house string, run string, t0 double, fs double, n long")
    subs = frame(spark, rows[30:], "house string, run string, t0 double, fs double, n long")
    want = {m[1]: sum(min(m[2] + 2 * m[4], s[2] + 2 * s[4]) - max(m[2], s[2]) > 6 for s in rows[30:]) for m in rows[:30]}
    assert {x["run"]: x["overlaps"] for x in benchmark.overlap_counts(mains, subs, 6.0).collect()} == want


def test_best_settings_take_the_first_of_equals(spark):
    one = lambda v: frame(spark, [(v,)], "score double")
    s = benchmark.sweep({("z", 1.0): one(0.2), ("z", 2.0): one(0.9), ("z", 3.0): one(0.9), ("c", 5.0): one(None), ("c", 6.0): one(0.1)}, "detector", "setting")
    assert {r["detector"]: (r["setting"], r["score"]) for r in benchmark.best_settings(s, ["detector"], "setting", "score", "position").collect()} == {"z": (2.0, 0.9), "c": (6.0, 0.1)}


def streamed(spark, tmp_path, parts, schema, apply):
    """The rows of a stream that sees each part as a batch of its own."""
    for n, rows in enumerate(parts):
        frame(spark, rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    return jobs.to_table(apply(source), f"t{abs(hash(str(tmp_path)))}", "append", f"{tmp_path}/out").collect()


def test_streamed_folds_do_not_see_batches(spark, tmp_path):
    """z-score, suppression and cycles over many batches against plain loops over the whole series."""
    r = np.random.default_rng(3)
    n, size, tol = 400, 20, 3
    v = np.sin(2 * np.pi * np.cumsum(np.where(np.arange(n) % 100 < 70, 1 / 20.3, 1 / 11))) + 0.001
    x = np.where(np.arange(n) % 60 < 30, 1.0, 40.0) + r.normal(0, 0.2, n)
    cuts = [0, 1, 7, 130, 131, 250, 400]
    rows = [("c", k, float(v[k]), float(x[k])) for k in range(n)]
    parts, schema = [rows[a:b] for a, b in zip(cuts, cuts[1:])], "channel_id string, t long, v double, x double"
    cycles = {c["start"]: (c["v"], c["i"]) for c in streamed(spark, tmp_path / "a", parts, schema, lambda s: jobs.cycles(s, "channel_id", "t", "v", "x", size, tol))}
    at = [k for k in range(n - 1) if v[k] < 0 <= v[k + 1]]
    want = {}
    for a, b in zip(at, at[1:]):
        if abs(b - a - size) <= tol:
            lo, hi = (k - v[k] / (v[k + 1] - v[k] + 1e-9) for k in (a, b))
            grid = [lo + (hi - lo) / size * j for j in range(size)]
            want[a] = (np.interp(grid, range(n), v), np.interp(grid, range(n), x))
    assert want and set(cycles) == set(want) and len(want) < len(at) - 1
    assert all(np.allclose(cycles[k], want[k]) for k in want)
    whole = detect.ZScore(8, 2.0, 5, 5.0).apply(frame(spark, [("c", k, k, float(x[k])) for k in range(n)], "channel_id string, t long, k long, x double")).collect()
    fired = streamed(spark, tmp_path / "b", parts, schema, lambda s: jobs.zscore(s, "channel_id", "t", "x", 8, 2.0, 5, 5.0))
    assert whole and sorted(e["k"] for e in fired) == sorted(e["k"] for e in whole)
    ks, last = [], -10
    for k in range(0, n, 3):
        if k - last >= 10:
            ks, last = [*ks, k], k
    events = [[("c", k) for k in range(a, b) if k % 3 == 0] for a, b in ((0, 100), (100, 250), (250, n))]
    assert sorted(e["k"] for e in streamed(spark, tmp_path / "c", events, "channel_id string, k long", lambda s: jobs.suppressed(s, "channel_id", "k", 10))) == ks


def test_evaluator_takes_events_and_unknown_scores(spark):
    e = metrics.Evaluator(tolerance=1)
    e.update_events(frame(spark, [("c", 3), ("c", 9)], "channel_id string, k long"), frame(spark, [("c", 4), ("c", 20)], "channel_id string, k long"))
    assert e.compute()["event_tp"] == 1 and e.compute()["event_f1"] == pytest.approx(0.5, abs=1e-6)
    e.update(frame(spark, [(w, "a", 0.1 * w, w > 2) for w in range(5)] * 2, "window long, appliance string, unknown_score double, is_unknown boolean"))
    assert e.compute()["auroc"] == 1.0 and "event_fp" in e.compute()
    e.reset()
    assert e.compute() == {}
