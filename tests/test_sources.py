import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesforge.functions import scalars as S
from seriesforge.operators import series, silhouettes, summaries
from seriesforge.sources import depth, files, npz

SCHEMA = "frame_index int, hand_label string, joints_uv array<array<double>>, faces array<long>, candidate_index int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    npz.register(spark)
    path = tmp_path_factory.mktemp("npz")
    for i in range(6):
        n = 4 + i
        np.savez_compressed(path / f"s{i}.npz", frame_index=np.arange(n) + 10 * i, hand_label=np.array(["left", "right"] * 5)[:n], joints_uv=np.arange(n * 4.0).reshape(n, 2, 2),
                            faces=np.arange(3), unused=np.full(n, i))
    np.savez_compressed(path / "empty.npz", frame_index=np.zeros(0, int), hand_label=np.zeros(0, str), joints_uv=np.zeros((0, 2, 2)), faces=np.arange(3))
    return str(path)


def test_npz_source_reads_asked_columns_and_frames(spark, folder, monkeypatch):
    df = spark.read.format("npz").schema(SCHEMA).load(folder)
    rows = df.collect()
    assert len(rows) == sum(4 + i for i in range(6)) and {tuple(r["faces"]) for r in rows} == {(0, 1, 2)}
    one = next(r for r in rows if r["frame_index"] == 21)
    assert one["joints_uv"] == [[4.0, 5.0], [6.0, 7.0]] and one["hand_label"] == "right" and one["candidate_index"] == 1
    few = df.filter("frame_index >= 12 AND frame_index < 31 AND hand_label = 'left'")
    assert {r["frame_index"] for r in few.collect()} == {12, 14, 20, 22, 24, 30}
    plan = few._jdf.queryExecution().executedPlan().toString()
    kept = [x for x in plan.split("\n") if "Filter (" in x]
    assert kept and all("hand_label" in x and "frame_index" not in x for x in kept), plan  # only the label is left to Spark
    assert {r["frame_index"] for r in df.filter("frame_index IN (3, 51, 99)").collect()} == {3, 51}
    with pytest.raises(Exception, match="missing columns: nothing"):
        spark.read.format("npz").schema("nothing int").load(folder).collect()
    monkeypatch.setattr(npz, "PARTITION_BYTES", 1)
    reader = npz.NpzReader(df.schema, folder)
    assert len(reader.partitions()) == 7 and all(len(p.paths) == 1 for p in reader.partitions())
    opened = []
    plain = np.lib.npyio.NpzFile.__getitem__
    monkeypatch.setattr(np.lib.npyio.NpzFile, "__getitem__", lambda z, k: (opened.append(k), plain(z, k))[1])
    from pyspark.sql.datasource import GreaterThan

    reader = npz.NpzReader(df.select("frame_index", "hand_label").schema, folder)
    assert list(reader.pushFilters([GreaterThan(("frame_index",), 1000)])) == []
    assert [b for p in reader.partitions() for b in reader.read(p)] == [] and set(opened) == {"frame_index"}


def test_npz_round_trip_of_many_files(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    df = spark.read.format("npz").schema(SCHEMA).load(folder)
    df.repartition(4).write.format("npz").mode("append").save(out)
    back = spark.read.format("npz").schema(SCHEMA).load(out)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    import os

    assert len([f for f in os.listdir(out) if f.endswith(".npz")]) == 4 and not [f for f in os.listdir(out) if f.startswith(".") and f.endswith(".npz")]
    df.limit(3).coalesce(1).write.format("npz").mode("overwrite").save(out)
    assert spark.read.format("npz").schema(SCHEMA).load(out).count() == 3
    with pytest.raises(Exception):
        df.withColumn("bad", F.raise_error(F.lit("stop"))).write.format("npz").mode("append").save(out)
    assert spark.read.format("npz").schema(SCHEMA).load(out).count() == 3 and not [f for f in os.listdir(out) if f.startswith(".") and f.endswith(".npz")]


def test_depth_samples_by_manifest(spark, tmp_path):
    """Files of one name in two folders, a later manifest row, a missing frame, a missing file, and points of every kind."""
    rng = np.random.default_rng(1)
    maps = {}
    for name in ("a/d0.npy", "b/d0.npy", "a/d1.npy"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        maps[name] = rng.uniform(0.5, 0.6, (8, 10))
        maps[name][0] = np.nan
        np.save(tmp_path / name, maps[name])
    rows = [("x", 0, str(tmp_path / "b/d0.npy"), 0), ("x", 0, str(tmp_path / "a/d0.npy"), 1), ("y", 0, f"file://{tmp_path}/b/d0.npy", 0), ("x", 1, str(tmp_path / "a/d1.npy"), 0), ("x", 2, str(tmp_path / "a/gone.npy"), 0)]
    manifest = depth.latest(spark.createDataFrame(rows, "s string, f int, path string, o int"), ["s", "f"], "o")
    asked = [(s, f, i, u, v) for s, f in (("x", 0), ("y", 0), ("x", 1), ("x", 2), ("x", 9)) for i, (u, v) in enumerate([(4.4, 3.6), (0.0, 0.0), (99.0, 1.0), (None, 1.0), (float("nan"), 1.0)])]
    points = spark.createDataFrame(asked, "s string, f int, point int, u double, v double")
    found = depth.sample_maps(spark, points, manifest, ["s", "f"], "path", str(tmp_path), radius=1, least=3).cache()
    got = {(r["s"], r["f"], r["point"]): r for r in found.collect()}
    assert len(got) == 25
    for key, name in ((("x", 0), "a/d0.npy"), (("y", 0), "b/d0.npy"), (("x", 1), "a/d1.npy")):
        part = maps[name][3:6, 3:6]
        assert got[*key, 0]["depth"] == pytest.approx(np.median(part)) and got[*key, 0]["count"] == 9 and got[*key, 0]["status"] == "ok"
        assert [got[*key, i]["status"] for i in range(1, 5)] == ["too_few_pixels", "out_of_image", "no_point", "no_point"]
    assert {got["x", 2, i]["status"] for i in range(5)} == {"missing_depth_file"} and {got["x", 9, i]["status"] for i in range(5)} == {"missing_depth_frame"}
    assert {tuple(r) for r in depth.missing_frames(found, ["s", "f"]).collect()} == {("x", 2, "missing_depth_file"), ("x", 9, "missing_depth_frame")}
    strict = depth.sample_maps(spark, points, manifest, ["s", "f"], "path", str(tmp_path), radius=2, least=3, most_span=0.001)
    assert {r["status"] for r in strict.filter("s = 'x' AND f = 0 AND point = 0").collect()} == {"depth_span_high"}


def test_silhouettes_on_odd_rows(spark):
    px = spark.createDataFrame([("a", x, y) for x, y in ((0, 0), (1, 0), (1, 0), (3, 0), (1, 1))] + [("b", 0, 0)], "k string, px int, py int")
    runs = silhouettes.pixel_runs(px, ["k"])
    assert {(r["k"], r["py"], r["x0"], r["x1"]) for r in runs.collect()} == {("a", 0, 0, 1), ("a", 0, 3, 3), ("a", 1, 1, 1), ("b", 0, 0, 0)}
    mask = spark.createDataFrame([("a", 2, 1, 1.0), ("a", 3, 1, 0.5), ("a", 5, 1, None), ("a", 9, 1, 7.0)], "k string, px int, py int, weight double")
    sums = silhouettes.row_sums(mask, ["k"], 6)
    assert sums.first()["sums"] == [0.0, 0.0, 0.0, 1.0, 1.5, 1.5, 1.5]
    got = {r["k"]: r for r in silhouettes.best_shift(runs, sums, ["k"], 6, 4, 2, least_area=1, shift_penalty=0.0).collect()}
    assert (got["a"]["du"], got["a"]["dv"], got["a"]["coverage"]) == (2, 1, 1.0) and got["a"]["precision"] == pytest.approx(1.5 / 4)
    assert got["b"]["score"] == -1e9 and (got["b"]["du"], got["b"]["dv"]) == (-2, -2)


def test_files_are_told_apart_by_their_path(spark, tmp_path):
    for name in ("a/d.npy", "b/d.npy", "c/e.npy"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "a/d.npy").unlink()
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).select("path", "length", "modificationTime")
    asked = spark.createDataFrame([(x,) for x in (f"{tmp_path}/a/d.npy", f"{tmp_path}/b/d.npy", f"file:{tmp_path}/b/d.npy", "b/d.npy", "a/d.npy", "d.npy", "c/e.npy", "/c/e.npy", None)], "p string")
    assert sorted(r["p"] for r in files.existing(asked, listed, "p").collect()) == sorted([f"{tmp_path}/b/d.npy", f"file:{tmp_path}/b/d.npy", "b/d.npy", "d.npy", "c/e.npy"])
    log = str(tmp_path / "log")
    for i, (stage, ok) in enumerate((("C1", "ok"), ("C1", "failed"), ("C2", "ok"))):
        files.append_timing(spark, log, stage, ok, i + 0.5, int(ok != "ok"), i, i + 1)
    lines = spark.read.json(log)
    assert {tuple(r) for r in files.timing_rollup(lines, "stage", "status", "duration_sec").collect()} == {("C1", 2, 1, 1, 0.5), ("C2", 1, 1, 0, 2.5)}
    cams = spark.createDataFrame([("a", None, 500.0), ("a", None, float("nan")), ("a", None, 700.0), ("b", '{"fx": 1, "fy": 2, "cx": 3, "cy": 4}', 9.0), ("c", None, None)], "s string, cell string, f double")
    got = {r["s"]: r["camera"] for r in files.session_intrinsics(cams.withColumn("w", F.lit(640)).withColumn("h", F.lit(480)), "s", "cell", "f", "w", "h", 450.0).collect()}
    assert (got["a"]["fx"], got["a"]["cx"], got["a"]["source"]) == (600.0, 320.0, "focal") and got["b"]["fy"] == 2.0 and got["c"]["source"] == "default"
    assert files.importable(["json", "no_such_module", "no_such.module"]) == {"json": True, "no_such_module": False, "no_such.module": False}


def test_neighbours_of_label_and_reach(spark):
    rows = [("a", "l", 0, 1.0, True), ("a", "l", 5, None, False), ("a", "r", 6, None, False), ("a", "r", 9, 9.0, None), ("b", "l", 1, 2.0, False), ("a", None, 4, 4.0, False)]
    df = spark.createDataFrame(rows, "k string, side string, p int, v double, ref boolean")
    got = {(r["k"], r["p"]): (r["nearest"], r["source"]) for r in series.nearest_of_label(df, "k", "side", "p", "v", F.col("ref")).collect()}
    assert got["a", 5] == (1.0, "label") and got["a", 6] == (1.0, "any") and got["a", 4] == (1.0, "any") and got["b", 1] == (None, "none")
    line = spark.createDataFrame([("a", p, v) for p, v in ((0, 0.0), (3, None), (20, None), (40, 40.0), (41, None))], "k string, p int, v double")
    near = {r["p"]: (r["filled"], r["gap"]) for r in series.bracket_fill(line, "k", "p", "p", "v", reach=12).collect()}
    assert near[3] == (0.0, 999) and near[20] == (None, 999) and near[41] == (40.0, 999)
    assert {r["p"]: r["filled"] for r in series.bracket_fill(line, "k", "p", "p", "v").collect()}[20] == 20.0
    seen = spark.createDataFrame([("a", 0, 0.0, 0.0), ("a", 1, float("nan"), 0.0), ("a", 2, 3.0, 4.0), ("b", 3, 1.0, 1.0)], "k string, n int, x double, y double")
    assert {r["n"]: r["jump"] for r in series.last_seen_jump(seen, "k", "n", ["x", "y"]).collect()} == {0: None, 1: None, 2: 5.0, 3: None}
    spread = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 9.0, float("nan"), None)] + [("b", None)], "k string, v double")
    assert {tuple(r) for r in summaries.spread_about_median(spread, ["k"], "v").collect()} == {("a", 3, 2.0, 1.0), ("b", 0, None, None)}


def test_scalars_without_a_query(spark):
    """Text of floats, guarded ratios, flags, rigid transforms and slerp."""
    df = spark.createDataFrame([(1.5, 0.0), (float("nan"), 2.0), (None, None), (3.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(S.csv_float(F.col("a"))).collect()] == ["1.500000000", "", "", "3.000000000"]
    q = S.slerp([F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)], [F.lit(np.cos(0.5)), F.lit(np.sin(0.5)), F.lit(0.0), F.lit(0.0)], F.lit(0.25))
    assert list(df.limit(1).select(*[x.alias(f"q{i}") for i, x in enumerate(q)]).first()) == pytest.approx([np.cos(0.125), np.sin(0.125), 0, 0])
    assert [list(r[0]) for r in df.limit(1).select(S.int_list(F.lit("3,x,5, 7"))).collect()] == [[3, 5, 7]]
