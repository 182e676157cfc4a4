"""Readers of corpora in binary formats: files go to tasks whole, decoders are optional imports that name what they lack.

Decoders give chunks (quantity, chunk, values) a file, so that no row holds more than a chunk.
"""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import timeseries as T
from ..schemas import CHUNK
from .text import Recordings, meter_runs

# Volts and amperes of a full-scale sample, by measurement kit.
WHITED_CALIBRATION = {"MK1": (1033.64, 61.4835), "MK2": (861.15, 60.200), "MK3": (988.926, 60.9562)}
# Volts and amperes of a full-scale sample.
UKDALE_CALIBRATION = (388.45, 251.51)


def _need(name: str):
    try:
        return __import__(name)
    except ImportError as e:
        raise ImportError(f"reading this corpus needs the package {name}") from e


def decode_flac(raw: bytes) -> tuple[float, np.ndarray]:
    data, fs = _need("soundfile").read(io.BytesIO(raw), always_2d=True)
    return float(fs), data


def decode_hdf5(raw: bytes) -> tuple[float, dict[str, np.ndarray]]:
    """Calibrated signals of one file, integer samples times calibration_factor."""
    with _need("h5py").File(io.BytesIO(raw), "r") as f:
        return float(f.attrs["frequency"]), {k: f[k][:] * float(f[k].attrs.get("calibration_factor", 1.0)) for k in f}


def decode_matroska(raw: bytes) -> tuple[float, dict[str, np.ndarray]]:
    """Signals named by CHANNEL_TAGS; milliamperes become amperes. Needs ffprobe and ffmpeg."""
    import json
    import shutil
    import subprocess
    import tempfile

    if not shutil.which("ffmpeg"):
        raise ImportError("reading this corpus needs ffmpeg and ffprobe")
    with tempfile.NamedTemporaryFile(suffix=".mkv") as f:  # a task's own scratch: gone with it
        f.write(raw)
        f.flush()
        said = json.loads(subprocess.run(["ffprobe", "-v", "error", "-show_streams", "-of", "json", f.name], capture_output=True, check=True).stdout)["streams"][0]
        out = subprocess.run(["ffmpeg", "-v", "error", "-i", f.name, "-f", "f32le", "-"], capture_output=True, check=True).stdout
    tags = [t.strip() for t in said["tags"]["CHANNEL_TAGS"].split(",")]
    data = np.frombuffer(out, "<f4").reshape(-1, len(tags))
    return float(said["sample_rate"]), {t: data[:, k] / (1000.0 if t == "i" else 1.0) for k, t in enumerate(tags) if t in ("v", "i", "p")}


def chunks_of(signals: dict[str, np.ndarray], fs: float) -> Iterator[dict]:
    for q, x in signals.items():
        for c in range(0, len(x), CHUNK):
            yield {"fs": fs, "quantity": q, "chunk": c // CHUNK, "start": c, "values": np.asarray(x[c : c + CHUNK], np.float32).tolist()}


def decoded(spark: SparkSession, path: str, pattern: str, decode: Callable[[str, bytes], Iterator[dict]]) -> DataFrame:
    """(file, part, fs, quantity, chunk, start, values): decode(file, bytes) gives the rows of one file."""

    def run(batches):
        for pdf in batches:
            for file, raw in zip(pdf["path"], pdf["content"]):
                rows = [{"file": file, "part": r.pop("part", "")} | r for r in decode(file, bytes(raw))]
                if rows:
                    yield pd.DataFrame(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "file string, part string, fs double, quantity string, chunk long, start long, values array<float>")


FILE = ["file", "part"]


def recordings(chunks: DataFrame, dataset: str, **columns: Column) -> Recordings:
    """A channel a file and part of decoded() rows; columns give house, session, kind, appliance, brand, f0 and t0, null where they are not given."""
    from ..plans.store import unchunked, with_ids

    null = lambda kind: F.lit(None).cast(kind)
    own = {"dataset": F.lit(dataset), "house": null("string"), "session": F.lit("run_0"), "kind": F.lit("submeter"), "appliance": null("string"), "brand": null("string"), "instance_id": null("string"), "f0": null("double"), "t0": F.lit(0.0)} | columns
    heads = chunks.groupBy(*FILE).agg(F.first("fs").alias("fs"), F.max(F.col("start") + F.size("values")).alias("n_samples"), *(F.first(c).alias(c) for c in chunks.columns if c not in (*FILE, "fs", "quantity", "chunk", "start", "values")))
    named = with_ids(heads.withColumns(own).withColumn("channel_id", null("string")))
    signals = chunks.select(*FILE, "quantity", "chunk", "start", "values").join(named.select(*FILE, "channel_id"), FILE).drop(*FILE)
    channels = named.select("channel_id", "dataset", "house", "session", "kind", "appliance", "brand", "instance_id", "fs", "f0", "t0")
    return Recordings(channels, unchunked(signals), None, signals.select("channel_id", "quantity", "chunk", "start", "values"))


def whited(spark: SparkSession, path: str, calibration: dict[str, tuple[float, float]] | None = None, strict: bool = False, read: Callable = decode_flac) -> Recordings:
    """Stereo FLAC appliance_model_region_kit_time; an unknown kit is left out, or an error if strict (SRC-03)."""
    table = calibration or WHITED_CALIBRATION

    def decode(file, raw):
        kit = file.rsplit("/", 1)[1].split("_")[3]
        if kit not in table:
            if strict:
                raise ValueError(f"{file}: no calibration of {kit}")
            return
        fs, data = read(raw)
        yield from chunks_of({"v": data[:, 0] * table[kit][0], "i": data[:, 1] * table[kit][1]}, fs)

    return recordings(decoded(spark, path, "*.flac", decode), "whited", **whited_names(F.url_decode("file")))


def whited_names(file: Column) -> dict[str, Column]:
    part = F.split(F.regexp_extract(file, r"([^/]+)\.flac$", 1), "_")
    return {"appliance": F.regexp_replace(F.lower(F.get(part, F.lit(0))), r"\s+", "_"), "brand": F.lower(F.get(part, F.lit(1))), "house": F.get(part, F.lit(2)), "session": F.get(part, F.lit(4))}


def ukdale_waveforms(spark: SparkSession, path: str, runs: DataFrame | None = None, time_range: tuple[float, float] | None = None, read: Callable = decode_flac) -> Recordings:
    """FLAC of v and i under house_N; the start time is in the name (SRC-05). runs(house, start, stop, session) of the meters name the session; hf_only beside them."""
    from ..operators.targets import run_containing

    def decode(file, raw):
        fs, data = read(raw)
        yield from chunks_of({"v": data[:, 0] * UKDALE_CALIBRATION[0], "i": data[:, 1] * UKDALE_CALIBRATION[1]}, fs)

    chunks = decoded(spark, path, "vi-*.flac", decode).withColumns({"_t0": vi_start(F.col("file")), "_house": F.regexp_extract("file", r"(house_\d+)", 1)})
    if time_range:
        chunks = chunks.where(F.col("_t0").between(*time_range))
    session = F.lit("hf_only")
    if runs is not None:
        files = chunks.select("file", F.col("_house").alias("house"), F.col("_t0").alias("t")).distinct()
        chunks = chunks.join(run_containing(files, runs, "house", "t", "hf_only").select("file", F.col("session").alias("_session")), "file")
        session = F.col("_session")
    return recordings(chunks, "ukdale", house=F.col("_house"), session=session, kind=F.lit("mains"), t0=F.col("_t0"))


def vi_start(name: Column) -> Column:
    """vi-<seconds>_<fraction>.flac to seconds."""
    return F.concat(F.regexp_extract(name, r"vi-(\d+)_(\d+)", 1), F.lit("."), F.regexp_extract(name, r"vi-(\d+)_(\d+)", 2)).cast("double")


BLOND_NAME = r"^(.+?)-(\d{4}-\d{2}-\d{2})T(\d{2})-(\d{2})-(\d{2})\.(\d+)T([+-])(\d{2})(\d{2})-(\d+)\.hdf5$"


def blond_name(name: Column) -> Column:
    """struct(unit, sequence, local, t0) of a file name, null if it is none: the name is the clock (SC-07)."""
    g = lambda k: F.regexp_extract(name, BLOND_NAME, k)
    local = F.unix_micros(F.to_timestamp(F.concat(g(2), F.lit(" "), F.concat_ws(":", g(3), g(4), g(5))))) / 1e6 + F.rpad(F.substring(g(6), 1, 6), 6, "0").cast("double") / 1e6
    offset = F.when(g(7) == "-", -1).otherwise(1) * (g(8).cast("int") * 3600 + g(9).cast("int") * 60)
    return F.when(name.rlike(BLOND_NAME), F.struct(g(1).alias("unit"), g(10).cast("long").alias("sequence"), local.alias("local"), (local - offset).alias("t0")))


def blond(spark: SparkSession, path: str, appliance_log: DataFrame | None = None, units: list[str] | None = None, phases: list[int] | None = None, sockets: list[int] | None = None, time_range: tuple[float, float] | None = None, read: Callable = decode_hdf5) -> Recordings:
    """HDF5 of three phases (clear, mains) or six sockets, each cycle less its mean; files called summary have no signals (SRC-11, HP-07).

    appliance_log(unit, socket, t, class_name, appliance_name): what hung at a socket from local time t on; sockets without an entry are left out.
    """

    def clean(x, period):
        n = len(x) // period * period
        whole = x[:n].reshape(-1, period)
        return np.concatenate([(whole - whole.mean(1, keepdims=True)).ravel(), x[n:] - x[n:].mean() if n < len(x) else x[n:]])

    def decode(file, raw):
        name = file.rsplit("/", 1)[1]
        wanted = phases if name.startswith("clear") else sockets
        if name.startswith("summary") or (units and not any(name.startswith(u) for u in units)):
            return
        fs, data = read(raw)
        for key in sorted(k for k in data if k.startswith("current")):
            n = key.removeprefix("current")
            if wanted and int(n) not in wanted:
                continue
            v = data.get(f"voltage{n}", data.get("voltage"))
            both = {"i": data[key]} | ({"v": v} if v is not None else {})
            for row in chunks_of({q: clean(x, max(1, round(fs / 50.0))) for q, x in both.items()}, fs):
                yield row | {"part": n}

    name = blond_name(F.regexp_extract("file", r"([^/]+)$", 1))
    chunks = decoded(spark, path, "*.hdf5", decode).withColumn("_n", name).where("_n is not null")
    chunks = chunks.select("*", F.col("_n.unit").alias("_unit"), F.col("_n.local").alias("_local"), F.col("_n.t0").alias("_t0")).drop("_n")
    if time_range:
        chunks = chunks.where(F.col("_t0").between(*time_range))
    mains = F.col("_unit") == "clear"
    parts = chunks.where(~mains).select(*FILE, F.lower("_unit").alias("unit"), F.col("part").cast("int").alias("socket"), F.col("_local").alias("t")).distinct()
    log = appliance_log if appliance_log is not None else spark.createDataFrame([], "unit string, socket int, t double, class_name string, appliance_name string")
    log = log.select(F.lower("unit").alias("unit"), F.col("socket").cast("int").alias("socket"), F.col("t").cast("double").alias("t"), "class_name", "appliance_name")
    known = T.asof_or_first(parts, log, ["unit", "socket"], "t", ["class_name", "appliance_name"]).where(F.trim("class_name") != "")
    chunks = chunks.join(known.select(*FILE, F.col("class_name").alias("_class"), F.col("appliance_name").alias("_model")), FILE, "left").where(mains | F.col("_class").isNotNull())
    appliance = F.regexp_replace(F.trim(F.lower("_class")), r"\s+", "_")
    day = F.to_date(F.timestamp_seconds("_local")).cast("string")
    return recordings(chunks, "blond", house=F.lit("blond"), session=day, kind=F.when(mains, "mains").otherwise("submeter"), appliance=appliance, brand=F.trim("_model"), t0=F.col("_t0"))


def smartnialm_power(columns: dict[str, np.ndarray]) -> np.ndarray | None:
    """Any Active Power columns summed; else the sum over phases of V * I * PF; else none (SRC-10)."""
    active = [x for k, x in columns.items() if k.startswith("Active Power")]
    if active:
        return np.sum(active, axis=0)
    phases = {k.rsplit(" ", 1)[1] for k in columns if k.startswith("Voltage ")}
    parts = [columns[f"Voltage {p}"] * columns[f"Current {p}"] * columns[f"Power Factor {p}"] for p in sorted(phases) if {f"Current {p}", f"Power Factor {p}"} <= set(columns)]
    return np.sum(parts, axis=0) if parts else None


def frame_names(raw) -> list[str]:
    """The column names in a frame table's attribute: a list, or a pickled one, whose lines of text begin with V."""
    if isinstance(raw, (list, tuple, np.ndarray)):
        return [n.decode() if isinstance(n, bytes) else str(n) for n in raw]
    return [n.decode() for n in re.findall(rb"(?m)^a?V(.*)$", raw if isinstance(raw, bytes) else raw.encode())]


def decode_frame(raw: bytes) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(times in seconds, columns) of the frame table data/table."""
    with _need("h5py").File(io.BytesIO(raw), "r") as f:
        rows, names = f["data/table"][:], frame_names(f["data/table"].attrs["values_block_0_kind"])
    return rows["index"] / 1e9, {n: rows["values_block_0"][:, k] for k, n in enumerate(names)}


def smartnialm(spark: SparkSession, path: str, buildings: list[int] | None = None, appliances: list[str] | None = None, aggregate: bool = True, rate_hz: float = 0.2, max_gap_s: float = 900.0, time_range: tuple[float, float] | None = None, read: Callable = decode_frame) -> Recordings:
    """building_NN/*.hdf5 frame tables at 5 s, cut at gaps; the smart meter's file is the aggregate (SRC-10)."""

    def run(batches):
        for pdf in batches:
            for file, raw in zip(pdf["path"], pdf["content"]):
                t, columns = read(bytes(raw))
                p = smartnialm_power(columns)
                if p is not None:
                    yield pd.DataFrame({"file": file, "t": np.asarray(t, float), "w": np.asarray(p, float)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.hdf5").option("recursiveFileLookup", "true").load(path).select("path", "content")
    building, stem = F.regexp_extract("path", r"building_(\d+)", 1).cast("int"), F.lower(F.regexp_extract("path", r"([^/]+)\.hdf5$", 1))
    meter = stem.rlike("smart_?meter|aggregate")
    if buildings:
        files = files.where(building.isin(buildings))
    if appliances:
        files = files.where(meter | stem.isin([x.lower() for x in appliances]))
    if not aggregate:
        files = files.where(~meter)
    rows = files.mapInPandas(run, "file string, t double, w double").withColumnRenamed("file", "path")
    if time_range:
        rows = rows.where(F.col("t").between(*time_range))
    named = rows.select(F.concat(F.lit("building_"), building.cast("string")).alias("house"), F.when(meter, "mains").otherwise(stem).alias("name"), "t", "w")
    return meter_runs(named, ["house", "name"], rate_hz, max_gap_s, "smartnialm")


def fired(spark: SparkSession, path: str, device_mapping: dict[str, str] | None = None, meters: list[str] | None = None, days: list[str] | None = None, read: Callable = decode_matroska) -> Recordings:
    """Matroska files with WavPack audio, meter/meter_YYYY_MM_DD__hh_mm_ss.mkv (SRC-14). device_mapping: plug meter to appliance; plugs without one are left out."""
    mapping = device_mapping or {}

    def decode(file, raw):
        meter = file.rsplit("/", 1)[1].split("_")[0]
        if (meters and meter not in meters) or (days and not any(d in file for d in days)) or not (meter.startswith("smartmeter") or meter in mapping):
            return
        fs, data = read(raw)
        yield from chunks_of(data, fs)

    clock = r"(\d{4})_(\d\d)_(\d\d)__(\d\d)_(\d\d)_(\d\d)"
    g = lambda k: F.regexp_extract("file", clock, k)
    meter = F.regexp_extract("file", r"([^/_]+)_[^/]*$", 1)
    names = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))[meter] if mapping else F.lit(None).cast("string")
    t0 = F.unix_timestamp(F.concat(F.concat_ws("-", g(1), g(2), g(3)), F.lit(" "), F.concat_ws(":", g(4), g(5), g(6)))).cast("double")
    kind = F.when(meter.startswith("smartmeter"), "mains").otherwise("submeter")
    return recordings(decoded(spark, path, "*.mkv", decode), "fired", house=F.lit("house_1"), session=F.concat_ws("-", g(1), g(2), g(3)), kind=kind, appliance=names, t0=F.coalesce(t0, F.lit(0.0)))
