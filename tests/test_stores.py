import numpy as np
import json
import math
import os

import pytest
from pyspark.sql import functions as F

from wattspark import cli
from wattspark.functions.labels import Taxonomy
from wattspark.plans import compat, inference, views
from wattspark.plans.store import Store
from wattspark.sources import binary, fetch, registry, synthetic, text


@pytest.fixture(scope="module")
def example(spark, tmp_path_factory):
    return synthetic.example(spark).write(str(tmp_path_factory.mktemp("s") / "example"))


def test_example_store(example):
    assert example.channels.count() == 8 and example.manifest["n_channels"] == 8
    assert example.verify(deep=True).count() == 0
    kettle = example.channels.where("appliance = 'kettle' and house = 'house_1'").first()
    assert kettle["n_samples"] == 12_000 and kettle["quantities"] == ["i", "v"]
    v, i = (example.read_window(kettle["channel_id"], q, 0, 12_000) for q in ("v", "i"))
    assert sum(a * b for a, b in zip(v, i)) / 12_000 == pytest.approx(2926.1, abs=0.1)
    assert example.read_window(kettle["channel_id"], "v", 11_999, 3)[1:] == [0.0, 0.0]
    assert {r["appliance"]: r["n_channels"] for r in example.describe().collect()} == {"kettle": 2, "fridge": 2, "laptop": 1, "microwave": 1}
    with pytest.raises(KeyError):
        example.channel("nothing")


def test_hash_is_stable_and_sees_content(spark, tmp_path, example):
    again = synthetic.example(spark).write(str(tmp_path / "again"))
    assert again.manifest["content_sha256"] == example.manifest["content_sha256"]
    r = synthetic.example(spark)
    r.samples = r.samples.withColumn("x", F.when(F.col("k") == 5, 0.0).otherwise(F.col("x")))
    assert r.write(str(tmp_path / "other")).manifest["content_sha256"] != example.manifest["content_sha256"]
    with pytest.raises(Exception):
        synthetic.example(spark).write(str(tmp_path / "again"))


def test_view_over_raw_windows(example):
    from wattspark.operators.windows import window_index

    ch = example.channels.where("appliance = 'kettle'")
    view = views.HighFreqView(10, 64)
    raw = views.raw_windows(window_index(ch, F.lit(1716), max_per_channel=2), example.signals, ("v", "i"))
    got = view(raw, 6000.0, 50.0).collect()
    assert len(got) == 4 and all(r["p_total"] == pytest.approx(2926, rel=2e-3) for r in got) and all(all(r["cycle_mask"]) for r in got)
    low = views.LowFreqView(50.0, 10)(raw).first()
    assert len(low["p"]) == 10 and low["p_total"] == pytest.approx(2926, rel=0.05)


def test_merge(spark, tmp_path):
    rows = lambda v, name: [{"dataset": f"d{v}", "house": "h", "kind": "submeter", "appliance": name, "fs": 6000, "f0": 50.0, "signals": {"v": [v * math.sqrt(2) * math.sin(2 * math.pi * k / 120) for k in range(1200)], "i": [2300 / v * math.sqrt(2) * math.sin(2 * math.pi * k / 120) for k in range(1200)]}}]
    a = registry.from_rows(spark, rows(230, "Firdge")).write(str(tmp_path / "a"))
    b = registry.from_rows(spark, rows(120, "refrigerator")).write(str(tmp_path / "b"))
    assert len(compat.compatibility(a, b).axis("voltage")) == 2
    with pytest.raises(ValueError, match="voltage"):
        compat.merge_stores([a, b], str(tmp_path / "no"), ["voltage"])
    m = compat.merge_stores([a, b], str(tmp_path / "m"), ["fs", "voltage"], Taxonomy(), normalize_voltage=230.0)
    assert m.distinct("appliance") == ["fridge"] and m.verify().count() == 0
    assert [r["vrms"] for r in compat.supply_voltages(m.signals, 1200).collect()] == [pytest.approx(230, rel=1e-5)] * 2
    assert cli.main(["compat", str(tmp_path / "a"), str(tmp_path / "b")]) == 0
    assert cli.main(["describe", str(tmp_path / "m"), "--verify"]) == 0
    assert cli.main(["merge", str(tmp_path / "x"), str(tmp_path / "a"), "--rename", "oops"]) == 2


def test_verify_finds_damage(spark, example):
    from wattspark.plans.store import verify

    got = verify(example.channels, example.signals.where("chunk > 0 or quantity = 'i'"), example.activations, example.appliance_table.where("appliance != 'laptop'"), False)
    said = {r["problem"] for r in got.collect()}
    assert said == {"missing signal v", "not in the table: laptop"}


def test_invalid_recordings_are_refused(spark, tmp_path):
    with pytest.raises(Exception, match="fs must be over 0"):
        registry.from_rows(spark, [{"dataset": "d", "house": "h", "kind": "mains", "fs": 0, "f0": 50.0, "signals": {"p": [1.0]}}]).write(str(tmp_path / "bad"))


# ---- text corpora in their formats on disk
def write(path, content):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(content)


def test_plaid(spark, tmp_path):
    for k in ("1", "2", "3"):
        write(f"{tmp_path}/CSV/{k}.csv", "\n".join(f"{j % 7 / 10},{j}" for j in range(300)))
    meta = {"1": {"header": {"sampling_frequency": "6000Hz"}, "appliance": {"type": "Air Conditioner", "brand": "Acme"}, "location": "x"}, "2": {"header": {"sampling_frequency": "6000Hz"}, "appliances": [{"type": "fan", "on": "[10 400]", "off": "[200 500]"}, {"type": "tv", "on": "[50]", "off": "[]"}]}, "3": {"header": {}}, "9": {"appliance": {"type": "tv"}}}
    write(f"{tmp_path}/meta.json", json.dumps(meta))
    r = text.plaid(spark, f"{tmp_path}/CSV", f"{tmp_path}/meta.json")
    ch = {c["session"]: c for c in r.channels.collect()}
    assert set(ch) == {"1", "2"} and ch["1"]["appliance"] == "air_conditioner" and ch["2"]["kind"] == "mains" and ch["1"]["fs"] == 6000
    assert sorted((a["appliance"], a["on"], a["off"]) for a in r.activations.collect()) == [("fan", 10, 200), ("tv", 50, 300)]
    assert r.samples.where("quantity = 'v' and k = 7").select("x").first()[0] == 7.0
    assert r.write(f"{tmp_path}/store").verify(True).count() == 0


def test_ukdale(spark, tmp_path):
    times = [*range(0, 600, 6), *range(4000, 4600, 6)]
    for c, w in ((1, 100), (2, 50)):
        write(f"{tmp_path}/house_1/channel_{c}.dat", "\n".join(f"{1352164036 + t} {w}" for t in times))
    write(f"{tmp_path}/house_1/labels.dat", "1 aggregate\n2 kettle")
    r = text.ukdale(spark, str(tmp_path))
    assert sorted((c["session"], c["kind"]) for c in r.channels.collect()) == [("run_0", "mains"), ("run_0", "submeter"), ("run_1", "mains"), ("run_1", "submeter")]
    assert r.samples.groupBy("channel_id").count().select("count").distinct().collect()[0][0] == 100
    assert text.ukdale(spark, str(tmp_path), time_range=(1352164036, 1352164636)).channels.count() == 2


def test_refit_and_uci(spark, tmp_path):
    body = "\n".join(f"t,{1000 + 8 * k},{500},{k},{1 if k == 3 else 0}" for k in range(10))
    write(f"{tmp_path}/r/CLEAN_House1.csv", f"Time,Unix,Aggregate,Appliance1,Issues\n{body}")
    write(f"{tmp_path}/names.csv", "house,column,name\n1,Appliance1,Freezer(garage)")
    r = text.refit(spark, f"{tmp_path}/r", f"{tmp_path}/names.csv")
    assert sorted(str(c["appliance"]) for c in r.channels.collect()) == ["None", "freezer"]
    rows = "\n".join(f"16/12/2006;17:{24 + k}:00;{'?' if k == 2 else 4.2};0.4;234;18;0;1;17" for k in range(10))
    write(f"{tmp_path}/u.txt", f"Date;Time;Global_active_power;Global_reactive_power;Voltage;Global_intensity;Sub_metering_1;Sub_metering_2;Sub_metering_3\n{rows}")
    u = text.uci(spark, f"{tmp_path}/u.txt")
    mains = u.channels.where("kind = 'mains'").select("channel_id")
    assert [x[0] for x in u.samples.join(mains, "channel_id").select("x").distinct().collect()] == [4200.0]
    assert u.samples.join(u.channels.where("appliance = 'water_heater_air_conditioner'"), "channel_id").first()["x"] == 1020.0


def test_hifda(spark, tmp_path):
    for cls, stem in (("Air_conditioner", "a1"), ("EmptyGrid", "e1")):
        write(f"{tmp_path}/Current/{cls}/{stem}Current.txt", "\n".join(["1.6462", "2.6462", "1.6462"]))
        write(f"{tmp_path}/Voltage/{cls}/{stem}Voltage.txt", "\n".join(["1.5992", "2.5992"]))
    write(f"{tmp_path}/Current/Fan/onlyCurrent.txt", "1")
    r = text.hifda(spark, str(tmp_path))
    assert sorted(str(c["appliance"]) for c in r.channels.collect()) == ["None", "air_conditioner"]
    assert r.samples.groupBy("channel_id", "quantity").count().select("count").distinct().collect()[0][0] == 2
    assert r.samples.where("quantity = 'i' and k = 1").first()["x"] == pytest.approx(12.55)


def test_names_and_decoders(spark):
    name = spark.createDataFrame([("medal-1-2016-09-30T11-02-08.736487T+0200-0000000.hdf5",), ("x.hdf5",)], "n string")
    a, b = (r[0] for r in name.select(binary.blond_name(F.col("n"))).collect())
    assert b is None and a["unit"] == "medal-1" and a["sequence"] == 0 and a["t0"] == pytest.approx(1475226128.736487, abs=1e-5)
    assert binary.smartnialm_power({"Voltage L1": 230.0, "Current L1": 2.0, "Power Factor L1": 0.5}) == 230
    with pytest.raises(ImportError, match="soundfile"):
        binary.decode_flac(b"")


def test_fetch_from_files(tmp_path):
    write(f"{tmp_path}/src.dat", "1 5\nodd line\n2 6\n9 7\n")
    plan = fetch.Plan([fetch.Artifact(f"file://{tmp_path}/src.dat", "a/b.dat", 20, until=5.0)])
    assert fetch.fetch(plan, f"{tmp_path}/cache").fetched == ["a/b.dat"]
    assert open(f"{tmp_path}/cache/a/b.dat").read() == "1 5\nodd line\n2 6\n"
    assert fetch.fetch(plan, f"{tmp_path}/cache").current == ["a/b.dat"]
    with pytest.raises(ValueError):
        fetch.Artifact("u", "../x")
    with pytest.raises(ValueError):
        fetch.fetch(plan, f"{tmp_path}/cache", max_bytes=1)
    assert [fetch.human_bytes(n) for n in (0, 1023, 1536, 3_585_155_959, 2**60)] == ["0 B", "1023 B", "1.5 KiB", "3.3 GiB", "1024.0 PiB"] and fetch.pruned(["h1_c2", "h2_c1"], r"h(?P<house>\d)_", house="2") == ["h2_c1"]


def test_inference(spark):
    df = spark.createDataFrame([(k, [float(k)] * 9) for k in range(20)], "window_idx int, p array<double>")
    got = inference.predict(df, inference.build("mean_share", 3), "p", ["window_idx"]).orderBy("window_idx").collect()
    assert len(got) == 20 and got[6]["prediction"][0][0] == pytest.approx(2.0)
    with pytest.raises(KeyError):
        inference.build("nothing", 2)


def test_newer_format_is_refused(spark, tmp_path, example):
    import shutil

    shutil.copytree(example.path, f"{tmp_path}/s")
    Store(spark, f"{tmp_path}/s").write_manifest({"format_version": 99})
    with pytest.raises(ValueError, match="newer"):
        Store(spark, f"{tmp_path}/s")


def test_binary_readers_write_stores(spark, tmp_path):
    from wattspark.sources import binary

    wave = np.sin(np.arange(2000) * 2 * np.pi * 50 / 1000)

    def flac(raw):
        return 1000.0, np.stack([wave, wave / 2], 1)

    def hdf5(raw):
        return 1000.0, {"voltage": wave + 1, "current1": wave * 2 + 5, "current2": wave}

    def clear(raw):
        return 1000.0, {"voltage1": wave, "current1": wave, "voltage2": wave, "current2": wave}

    def mkv(raw):
        return 10.0, {"p": np.full(50, 7.0)}

    def table(raw):
        return np.concatenate([np.arange(20) * 5.0, 5000 + np.arange(10) * 5.0]), {"Active Power L1": np.full(30, 3.0), "Active Power L2": np.full(30, 4.0)}

    names = ["w/Kettle_Acme_r1_MK1_20200101.flac", "w/Fan_Acme_r1_MK9_20200101.flac", "u/house_2/vi-1700000000_250000.flac", "b/2016-10-01/medal-1/medal-1-2016-10-01T00-00-10.123456T+0200-0000001.hdf5", "c/clear-2016-10-01T00-00-10.123456T+0200-0000001.hdf5", "f/powermeter08/powermeter08_2020_06_14__00_10_00.mkv", "f/powermeter09/powermeter09_2020_06_14__00_10_00.mkv", "s/building_01/freezer.hdf5"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(b"x")
    log = spark.createDataFrame([("MEDAL-1", 1, 0.0, "Desk Lamp", "L1")], "unit string, socket int, t double, class_name string, appliance_name string")
    got = {
        "w": binary.whited(spark, f"{tmp_path}/w", read=flac),
        "u": binary.ukdale_waveforms(spark, f"{tmp_path}/u", runs=spark.createDataFrame([("house_2", 1.69e9, 1.71e9, "run_3")], "house string, start double, stop double, session string"), read=flac),
        "b": binary.blond(spark, f"{tmp_path}/b", log, read=hdf5),
        "c": binary.blond(spark, f"{tmp_path}/c", phases=[2], read=clear),
        "f": binary.fired(spark, f"{tmp_path}/f", {"powermeter08": "kettle"}, read=mkv),
        "s": binary.smartnialm(spark, f"{tmp_path}/s", read=table),
    }
    stores = {k: x.write(f"{tmp_path}/store/{k}") for k, x in got.items()}
    rows = {k: [(r["house"], r["session"], r["kind"], r["appliance"], r["n_samples"], r["quantities"]) for r in x.channels.orderBy("channel_id").collect()] for k, x in stores.items()}
    assert rows["w"] == [("r1", "20200101", "submeter", "kettle", 2000, ["i", "v"])]
    assert rows["u"] == [("house_2", "run_3", "mains", None, 2000, ["i", "v"])]
    assert rows["b"] == [("blond", "2016-10-01", "submeter", "desk_lamp", 2000, ["i", "v"])]
    assert rows["c"] == [("blond", "2016-10-01", "mains", None, 2000, ["i", "v"])]
    assert rows["f"] == [("house_1", "2020-06-14", "submeter", "kettle", 50, ["p"])]
    assert [x[2:4] + x[5:] for x in rows["s"]] == [("submeter", "freezer", ["p"])] * 2
    assert all(x.verify(deep=True).isEmpty() for x in stores.values())
    one = stores["w"].channels.first()["channel_id"]
    m = stores["w"].measurement(one, start=100, samples=200)
    assert m.n_samples == 200 and abs(m.vrms() - 1033.64 / 2**0.5) < 2 and abs(m.t0 - 0.1) < 1e-12
    assert stores["w"].measurement(one, start=1990, seconds=1).n_samples == 10 and stores["f"].measurement(stores["f"].channels.first()["channel_id"]).kind == "power"
    with pytest.raises(ValueError):
        stores["w"].measurement(one, start=2000)
    assert got["w"].limited(0).channels.count() == 0


def test_frame_names():
    from wattspark.sources import binary

    assert binary.frame_names(b"(lp0\nVActive Power\np1\naVPower Factor\np2\na.") == ["Active Power", "Power Factor"] == binary.frame_names(["Active Power", b"Power Factor"])


def test_report_says_what_blocks_and_what_narrows(spark, tmp_path):
    wave = {"v": [230 * math.sqrt(2) * math.sin(2 * math.pi * k / 120) for k in range(1200)], "i": [0.5] * 1200}
    row = lambda fs, signals: {"dataset": "d", "house": "h", "kind": "submeter", "appliance": "kettle", "fs": fs, "f0": 50.0, "signals": signals}
    a = registry.from_rows(spark, [row(6000, wave)]).write(str(tmp_path / "a"))
    b = registry.from_rows(spark, [row(1, {"p": [1.0] * 50})]).write(str(tmp_path / "b"))
    one, both, low = compat.compatibility(a), compat.compatibility(a, b), compat.compatibility(b)
    assert one.varying() == [] and all(one.is_compatible(v) for v in compat.VIEWS) and one.usable(views.HighFreqView(aligned=False)) == 1
    assert both.blocking("raw") == ["fs"] and both.blocking("aligned") == [] and both.partial("aligned") == ["quantities"] and both.partial("lowfreq") == []
    assert (both.usable("aligned"), both.usable(views.LowFreqView())) == (1, 2) and both.is_compatible("aligned") and not both.is_compatible("raw")
    assert not low.is_compatible("aligned") and low.is_compatible("lowfreq") and low.axis("voltage") == []
    table = both.to_frame().set_index("axis")
    assert table.loc["fs", "distinct"] == 2 and table.loc["fs", "blocks"] == "raw" and table.loc["quantities", "narrows"] == "aligned, raw"
    assert "aligned: ok on 1 of 2 channels" in both.summary() and "raw: blocked by fs" in both.summary()


def test_batches_of_windows(spark):
    rows = spark.createDataFrame([(f"c{k}", k, [float(k)] * 3) for k in range(5)], "channel_id string, start long, p array<double>")
    got = list(views.batches(rows, 2))
    assert [len(x["channel_id"]) for x in got] == [2, 2, 1] and got[0]["p"].shape == (2, 3) and isinstance(got[0]["channel_id"], list)
    with pytest.raises(ValueError, match="extra"):
        views.collate([{"a": 1}, {"a": 2, "extra": 3}])
    assert views.collate([]) == {}
    with pytest.raises(TypeError, match="supports"):
        views.register("odd", object)
    views.register("slow", lambda: views.LowFreqView(0.5))
    assert views.VIEWS.pop("slow")().rate_hz == 0.5
