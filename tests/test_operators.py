import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesforge.functions import scalars as S
from seriesforge.operators import matching, series
from seriesforge.sources import files


def test_parsing(spark):
    df = spark.createDataFrame([("2.5", "YES", "3,7-9;12,8"), ("nan", " no", "1"), ("x", None, "")], "a string, b string, c string")
    got = df.select(S.parse_int(F.col("a"), 0).alias("i"), S.parse_float(F.col("a"), -1).alias("f"), S.truthy(F.col("b")).alias("t"), S.frame_list(F.col("c")).alias("l")).collect()
    assert [tuple(r)[:3] for r in got] == [(2, 2.5, True), (0, -1.0, False), (0, -1.0, False)]
    assert got[0]["l"] == [3, 7, 8, 9, 12]


def test_flags(spark):
    df = spark.createDataFrame([(5.0,), (15.0,), (float("nan"),), (10.0,)], "v double")
    assert [r[0] for r in df.select(S.join_flags(S.level_flag(F.col("v"), 4, 10, "x"))).collect()] == ["warn_x", "bad_x", "ok", "warn_x"]


def test_smoothing_keeps_constants_and_quadratics(spark):
    rows = [("c", i, 3.0, 1.0) for i in range(12)] + [("q", i, float(i * i), 1.0) for i in range(12)] + [("s", i, float(i), 1.0) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, p int, v double, t double")
    for r in series.savgol(df, "k", "p", "v").collect():
        assert r["smooth"] == pytest.approx(r["v"])
    for r in series.gaussian_smooth(df.filter("k = 'c'"), "k", "p", "v", "t").collect():
        assert r["smooth"] == pytest.approx(3.0)


def test_islands_join_over_one_missing(spark):
    df = spark.createDataFrame([("a", p) for p in (1, 3, 4, 8)], "k string, p int")
    assert sorted((r["first"], r["last"]) for r in series.islands(df, "k", "p", F.lit(True), 0).collect()) == [(1, 4), (8, 8)]


def test_majority_tie_takes_first(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2)], "k string, l string, p int")
    assert series.majority(df, "k", "l", F.lit(1.0), "p").first()["label"] == "x"


BOXES = "f int, c int, conf double, x1 double, y1 double, x2 double, y2 double"


def test_dropped_box_does_not_suppress(spark):
    rows = [(1, 0, 3.0, 0.0, 0.0, 10.0, 10.0), (1, 1, 2.0, 4.0, 0.0, 14.0, 10.0), (1, 2, 1.0, 8.0, 0.0, 18.0, 10.0), (2, 0, None, 0.0, 0.0, 9.0, 9.0),
            (2, 1, float("nan"), 0.0, 0.0, 9.0, 9.0), (2, 2, 0.1, 0.0, 0.0, 9.0, 9.0), (3, 0, 1.0, None, 0.0, 9.0, 9.0), (3, 1, 2.0, 0.0, 0.0, 9.0, 9.0)]
    got = matching.greedy_dedup(spark.createDataFrame(rows, BOXES), "f", "c", "conf").orderBy("f", "c").collect()
    assert [r["dropped"] for r in got] == [0, 1, 0, 1, 1, 0, 0, 0]
    assert matching.greedy_dedup(spark.createDataFrame([], BOXES), "f", "c", "conf").count() == 0


def test_tracks_bridge_a_gap():
    frames = np.array([0, 0, 1, 4, 30])
    b = np.array([[0, 0, 10, 10], [500, 0, 510, 10], [1, 0, 11, 10], [2, 0, 12, 10], [2, 0, 12, 10]], float)
    assert matching.tracks(frames, b, 0.12, 6, 130.0).tolist() == [0, 1, 0, 0, 2]


def test_npz(spark, tmp_path):
    np.savez(tmp_path / "a.npz", frame_index=np.array([4, 7], np.int32), joints=np.zeros((2, 3, 2), np.float32), faces=np.zeros((5, 3)))
    got = files.read_npz(spark, str(tmp_path / "*.npz"), "frame_index int, candidate_index int, joints array<float>").collect()
    assert [(r[0], r[1], len(r[2])) for r in got] == [(4, 0, 6), (7, 1, 6)]


def test_clean_json(spark):
    assert files.clean_json(spark.createDataFrame([(float("nan"), 1)], "a double, b int")).first()[0] == '{"a":null,"b":1}'
