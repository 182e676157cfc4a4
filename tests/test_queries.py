"""Every query of the engine against its SQL in DuckDB, on the smallest tables."""

import glob
import os
import time

import duckdb
import numpy as np
import pytest

from wattspark.functions import arrays
from wattspark.harness import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    return "null" if v is None else f"{v + 0.0:.4f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, tables, name):
    df = Q.QUERIES[name](spark, SF)
    order = sorted(df.columns)
    got = sorted([plain(r[c]) for c in order] for r in df.collect())
    assert len(got) or name in ("drop_rare",)
    if name in Q.SQL:
        cur = tables.execute(Q.SQL[name])
        at = [[d[0] for d in cur.description].index(c) for c in order]
        assert got == sorted([plain(r[k]) for k in at] for r in cur.fetchall())


def test_flagship(spark):
    assert Q.flagship(spark, SF).count() > 0


PURCHASES = {
    1: [86.96, 33.82, 9.96, 24.86, 87.28, 56.69, 21.21, 115.44, 2.23, 61.68, 124.86, 20.58, 14.79, 22.28, 6.81, 69.4],
    2: [2.89, 102.17, 30.63, 67.02, 56.29, 128.24, 27.29, 38.45, 19.94, 89.98, 24.34, 115.55, 20.1],
    3: [19.04, 1.24, 65.43, 4.23, 209.84, 6.55, 21.41, 43.85, 79.41, 29.97, 25.36, 33.84],
}


def test_means_of_just_the_threshold(spark, tmp_path):
    """Rows of larger tables whose window means are 40 by sums in order, or 40 and a rounding; earlier samples must not move them."""
    at = [(u, k, v, kind) for u, vs in PURCHASES.items() for kind in ("purchase", "error") for k, v in enumerate(vs)]
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("INSERT INTO events VALUES (?, TIMESTAMP '2024-01-01' + ? * INTERVAL 1 HOUR, ?, ?, ?, '{}')", [(n, k, u, kind, v) for n, (u, k, v, kind) in enumerate(at)])
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    got = Q.window_targets(spark, str(tmp_path)).collect()
    cur = con.execute(Q.SQL["window_targets"])
    names = [d[0] for d in cur.description]
    assert sorted(tuple(plain(r[c]) for c in names) for r in got) == sorted(tuple(map(plain, r)) for r in cur.fetchall())
    ties = {(r["channel_id"], r["start"]): r["presence"] for r in got if r["power"] == 40.0 and r["appliance"] == "purchase"}
    assert ties == {("1", 8): 0.0, ("2", 16): 1.0, ("3", 16): 0.0}


def test_lowpass_of_many_cycles_takes_little_work(spark, tmp_path):
    """Bins once a row: with bins for each point and once more in a filter below the join, these 300 cycles took over a minute."""
    x = np.random.default_rng(5).normal(size=(300, 64)).astype("float32")
    rows = [(k, [float(v) for v in c]) for k, c in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    began = time.perf_counter()
    got = Q.harmonic_lowpass(spark, str(tmp_path)).collect()
    assert time.perf_counter() - began < 20
    z = np.fft.rfft(x[:-1].astype(float), axis=1)
    z[:, 6:] = 0
    want = np.fft.irfft(z, 64, axis=1)
    y = np.empty_like(want)
    for r in got:
        y[r["vec_id"], r["k"]] = r["y"]
    assert len(got) == want.size and np.allclose(y, want, atol=6e-6)


def test_lowpass_of_no_points(spark):
    got = spark.sql("SELECT CAST(array() AS array<double>) AS x UNION ALL SELECT CAST(NULL AS array<double>)").select(arrays.harmonic_lowpass("x", 6).alias("y"))
    assert sorted((r["y"] for r in got.collect()), key=str) == [None, []]
