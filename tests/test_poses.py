import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesforge.operators import depthmaps, poses, series

POSE = "array<struct<x:double,y:double,z:double>>"


def matrix(v):
    a = np.linalg.norm(v)
    if a < 1e-12:
        return np.eye(3)
    k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]]) / a
    return np.eye(3) + math.sin(a) * k + (1 - math.cos(a)) * k @ k


def vector(m):
    a = math.acos(np.clip((np.trace(m) - 1) / 2, -1, 1))
    axis = np.array([m[2, 1] - m[1, 2], m[0, 2] - m[2, 0], m[1, 0] - m[0, 1]])
    return axis * (a / np.linalg.norm(axis)) if a > 1e-9 else np.zeros(3)


def test_clamped_pose_by_matrices(spark):
    """Limits hold joint by joint; what is within them stays; NULLs and joints without a limit pass."""
    rng = np.random.default_rng(4)
    vectors = [*rng.uniform(-1.5, 1.5, (14, 3)), np.zeros(3)]
    small = np.array([0.05, 0.3, 0.2])
    vectors[4] = small
    rows = [(1, [tuple(map(float, v)) for v in vectors] + [(3.0, 0.0, 0.0)]), (2, [None, (0.1, None, 0.0)]), (3, None), (4, [])]
    got = {r["i"]: r["p"] for r in spark.createDataFrame(rows, f"i int, p {POSE}").select("i", poses.clamped_pose(F.col("p")).alias("p")).collect()}
    for j, v in enumerate(vectors):
        swing_most, twist_most = np.radians(poses.LIMITS[j])
        swing = vector(matrix(v) @ matrix(np.array([v[0], 0, 0])).T)
        angle = np.linalg.norm(swing)
        want = v
        if np.linalg.norm(v) > 1e-8 and (angle > swing_most or abs(v[0]) > twist_most):
            want = vector(matrix(swing * min(1, swing_most / max(angle, 1e-12))) @ matrix(np.array([np.clip(v[0], -twist_most, twist_most), 0, 0])))
        g = got[1][j]
        assert np.allclose(matrix(np.array([g["x"], g["y"], g["z"]])), matrix(want), atol=1e-6) and g["changed"] == (want is not v)
    assert got[1][15]["changed"] is False and got[1][15]["x"] == 3.0
    assert [x["changed"] for x in got[2]] == [False, False] and got[3] is None and got[4] == []


def test_filled_poses_at_ends_and_alone(spark):
    pose = lambda a: [(a, 0.0, 0.0), (0.0, 0.0, -a)]
    rows = [("a", 0, pose(9.0), [9.0], False), ("a", 2, pose(0.2), [2.0], True), ("a", 3, None, None, None), ("a", 6, pose(0.6), [6.0], True), ("a", 7, pose(9.0), [9.0], False)]
    rows += [("one", 0, pose(5.0), [5.0], False), ("one", 1, pose(0.1), [1.0], True), ("none", 0, pose(5.0), [5.0], False)]
    df = spark.createDataFrame(rows, f"k string, f int, p {POSE}, v array<double>, good boolean")
    got = {(r["k"], r["f"]): r for r in poses.filled(df, "k", "f", F.col("good"), ["p"], ["v"]).collect()}
    angle = lambda k: (got[k]["p"][0]["x"], -got[k]["p"][1]["z"], got[k]["v"][0])
    assert angle(("a", 0)) == pytest.approx((0.2, 0.2, 2.0)) and angle(("a", 3)) == pytest.approx((0.3, 0.3, 3.0)) and angle(("a", 7)) == pytest.approx((0.6, 0.6, 6.0))
    assert angle(("one", 0)) == pytest.approx((0.1, 0.1, 5.0)) and angle(("none", 0)) == (5.0, 5.0, 5.0)
    assert poses.filled(df.limit(0), "k", "f", F.col("good"), ["p"], ["v"]).count() == 0
    dense = {r["f"]: r for r in poses.infilled(df.filter("good"), "k", "f", ["p"], ["v"]).filter("k = 'a'").collect()}
    assert [dense[f]["method"] for f in range(2, 7)] == ["observed"] + ["interpolation"] * 3 + ["observed"]
    assert dense[4]["gap_len"] == 3 and dense[4]["nearest_frame"] == 2 and dense[5]["nearest_frame"] == 6 and dense[4]["v"] == [pytest.approx(4.0)]
    turned = spark.createDataFrame([("a", 0, 0.2), ("a", 1, 0.4), ("a", 2, 3.0), ("a", 3, None)], "k string, f int, a double")
    q = [F.cos(F.col("a") / 2), F.sin(F.col("a") / 2), F.lit(0.0), F.lit(0.0)]
    turned = turned.withColumns({n: c for n, c in zip("wxyz", q, strict=True)})
    jumps = [r["j"] for r in turned.select("f", poses.rotation_jump([F.col(n) for n in "wxyz"], series.over("k", "f")).alias("j")).orderBy("f").collect()]
    assert jumps[0] is None and jumps[1] == pytest.approx(math.degrees(0.2)) and jumps[2] == pytest.approx(math.degrees(2.6)) and jumps[3] is None
    points = spark.createDataFrame([("a", f, z) for f, m in enumerate((1.0, 5.0, 1.2)) for z in (m - 0.1, m + 0.1)], "k string, f int, z double")
    moved = {(r["f"], round(r["z"], 3)): r["new"] for r in poses.shifted_mean(points, "k", "f", "z", "new").collect()}
    assert moved[1, 4.9] == pytest.approx(1.1) and moved[1, 5.1] == pytest.approx(1.3)


def test_depth_maps_on_odd_rows(spark):
    nan = float("nan")
    rows = [("a", f, 0, [1.0 + f, nan if f else 2.0, 0.0, None], [False, False, False, f == 1]) for f in range(4)]
    tiles = spark.createDataFrame(rows, "k string, f int, t int, d array<double>, m array<boolean>")
    assert depthmaps.template(tiles, "k", "f", "t", "d", "m").first()["template"] == [2.5, 2.0, 0.0, 0.0]
    assert depthmaps.template(tiles, "k", "f", "t", "d", "m", least_ratio=0.5).first()["template"] == [2.5, 0.0, 0.0, 0.0]
    stats = {r["f"]: r for r in depthmaps.frame_depths(tiles, ["k", "f"], "d").collect()}
    assert stats[0]["valid_ratio"] == 0.5 and stats[0]["median"] == 1.5 and stats[3]["valid_ratio"] == 0.25
    assert depthmaps.template(tiles.limit(0), "k", "f", "t", "d").count() == 0
    mask = spark.createDataFrame([("a", x, y) for x in range(6) for y in range(5) if (x, y) != (3, 2)], "k string, px int, py int")
    k = depthmaps.ellipse(2)
    assert len(k) == 17 and len(depthmaps.ellipse(0)) == 1
    inside = lambda x, y: 0 <= x < 6 and 0 <= y < 5
    grown = {(r["px"], r["py"]) for r in depthmaps.dilated(mask, ["k"], k, 6, 5).collect()}
    assert grown == {(x, y) for x in range(6) for y in range(5)}
    had = {(r["px"], r["py"]) for r in mask.collect()}
    left = {(r["px"], r["py"]) for r in depthmaps.eroded(mask, ["k"], k, 6, 5).collect()}
    assert left == {(x, y) for x in range(6) for y in range(5) if all((x + a, y + b) in had for a, b in k if inside(x + a, y + b))}
    boxes = spark.createDataFrame([("a", (0.5, 0.5, 2.5, 1.5)), ("a", (1.0, 1.0, 2.0, 2.0)), ("b", (nan, 0.0, 1.0, 1.0)), ("c", None), ("d", (-9.0, -9.0, -5.0, -5.0))],
                                  "k string, b struct<x1:double,y1:double,x2:double,y2:double>")
    got = {tuple(r) for r in depthmaps.box_pixels(boxes, ["k"], "b", 4, 4, 0.0).collect()}
    assert got == {("a", 0, 0), ("a", 1, 0), ("a", 1, 1)}
    flow = spark.createDataFrame([("a", 0, 1, 1, 9.0), ("a", 1, 2, 2, nan), ("a", 2, 3, 3, 9.0)], "k string, n int, px int, py int, m double")
    on = lambda window: {(r["frame"], r["px"]) for r in depthmaps.moving_pixels(flow, "k", "n", "m", F.lit(4), window=window).collect()}
    assert on(3) == {(0, 1), (1, 1), (2, 3), (3, 3)} and on(1) == {(0, 1), (2, 3), (3, 3)}
