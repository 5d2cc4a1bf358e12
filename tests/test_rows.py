"""Tests of the operators that SQL doesn't cover: sources, estimators, streams, matching and odd input."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesforge.functions import rotations as R
from seriesforge.functions import scalars as S
from seriesforge.operators import blocks, estimators, matching, meshes, relations, series, stages, summaries, tracks
from seriesforge.sources import files
from seriesforge.streaming import sessions, tracking


def test_frame_lists(spark):
    texts = ["3,,5", "", None, "9-7", "7-9;8", "x,2-y,4", "-3", " 1 - 2 "]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(S.frame_list(F.col("t"))).collect()]
    assert got == [[3, 5], [], [], [], [7, 8, 9], [4], [], [1, 2]]


def test_outliers_leave_out_what_is_not_finite_or_not_trusted(spark):
    nan = float("nan")
    rows = [(i, v, t) for i, (v, t) in enumerate([(1.0, 1), (1.1, 1), (nan, 1), (0.9, 1), (50.0, 0), (60.0, 1), (None, 1), (1.0, 1), (float("inf"), 1)])]
    df = spark.createDataFrame(rows, "p int, v double, t int").withColumn("k", F.lit("a"))
    got = {r["p"]: r["outlier"] for r in series.rolling_mad_outliers(df, "k", "p", "v", trust="t").collect()}
    assert got == {i: int(i == 5) for i in range(9)}
    assert series.rolling_mad_outliers(df.limit(0), "k", "p", "v").count() == 0


def test_a_single_value_fills_nothing(spark):
    df = spark.createDataFrame([("a", 0, None), ("a", 1, 3.0), ("a", 2, None), ("b", 0, 1.0), ("b", 1, None), ("b", 2, 3.0), ("b", 3, None)], "k string, p int, v double")
    got = {(r["k"], r["p"]): r["filled"] for r in series.bracket_fill(df, "k", "p", "p", "v").collect()}
    assert got == {("a", 0): None, ("a", 1): 3.0, ("a", 2): None, ("b", 0): 1.0, ("b", 1): 2.0, ("b", 2): 3.0, ("b", 3): 3.0}


def test_quaternion_savgol_and_zero_products(spark):
    rows = [("a", i, float(np.cos(i / 20)) * (-1) ** i, float(np.sin(i / 20)) * (-1) ** i, 0.0, 0.0) for i in range(9)]
    rows += [("z", 0, 1.0, 0.0, 0.0, 0.0), ("z", 1, -1.0, 0.0, 0.0, 0.0), ("z", 2, 0.0, -1.0, 0.0, 0.0), ("z", 3, 0.0, 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "k string, p int, w double, x double, y double, z double")
    turned = {(r["k"], r["p"]): (r["w"], r["x"]) for r in series.steady_signs(df, "k", "p", ["w", "x", "y", "z"]).collect()}
    assert all(turned["a", i] == pytest.approx((np.cos(i / 20), np.sin(i / 20))) for i in range(9))
    assert turned["z", 1] == (1.0, 0.0) and turned["z", 2] == (0.0, -1.0) and turned["z", 3] == (0.0, -1.0)
    for r in series.smooth_quaternions(df.filter("k = 'a'"), "k", "p", ["w", "x", "y", "z"]).collect():
        assert (r["w"], r["x"]) == pytest.approx((np.cos(r["p"] / 20), np.sin(r["p"] / 20)), abs=1e-3)


def test_duplicate_clusters(spark):
    boxes = [(0, 0, 10, 10), (1, 0, 11, 10), (100, 100, 110, 110), (2, 0, 12, 10), (101, 100, 111, 110), (300, 0, 305, 5), (None, 0, 5, 5)]
    conf = [0.5, 0.9, 0.2, 0.9, 0.8, 1.0, 1.0]
    rows = [(1, i, c, *[None if x is None else float(x) for x in b]) for i, (b, c) in enumerate(zip(boxes, conf, strict=True))]
    rows += [(2, 0, 1.0, 0.0, 0.0, 10.0, 10.0), (2, 1, 1.0, 4.0, 4.0, 6.0, 6.0)]  # near, but not alike in size
    rows += [(3, 5, None, 0.0, 0.0, 10.0, 10.0), (3, 7, 0.1, 0.0, 0.0, 10.0, 10.0)]
    df = spark.createDataFrame(rows, "f int, c int, conf double, x1 double, y1 double, x2 double, y2 double")
    got = {(r["f"], r["c"]): (r["cluster"], r["dropped"]) for r in matching.mark_duplicates(df, "f", "c", "conf", 0.55, 5.0, 0.35).collect()}
    assert [got[1, i] for i in range(7)] == [(0, 1), (0, 0), (1, 1), (0, 1), (1, 0), (-1, 0), (-1, 0)]
    assert got[2, 0] == got[2, 1] == (-1, 0) and got[3, 5] == (0, 1) and got[3, 7] == (0, 0)
    assert matching.mark_duplicates(df.limit(0), "f", "c", "conf").count() == 0


def test_defaults_are_the_documented_ones():
    import inspect

    of = lambda f: {n: p.default for n, p in inspect.signature(f).parameters.items() if p.default is not p.empty}
    assert of(matching.mark_duplicates) == {"least": 0.45, "reach": 35.0, "alike": 0.35}
    assert of(tracks.filter_tracks) == {"least": 5, "relative": 0.30, "distance": 0.5, "ratio": 3.0}
    assert of(tracks.spikes) == {"gap": 3, "floor": 0.08, "factor": 3.0}


def test_statistics_leave_out_what_is_not_finite(spark):
    values = [1.0, 2.0, 3.0, None] + [float("nan")] * 3 + [float("inf")]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", float("nan"))], "k string, v double")
    got = {r["k"]: r for r in series.stats(df, ["k"], "v").collect()}
    assert (got["a"]["count"], got["a"]["min"], got["a"]["median"], got["a"]["mean"], got["a"]["max"]) == (3, 1.0, 2.0, 2.0, 3.0)
    assert got["a"]["std"] == pytest.approx(np.std([1, 2, 3])) and got["b"]["count"] == 0 and got["b"]["mean"] is None
    mean = {r["k"]: r for r in summaries.inlier_mean(df, ["k"], "v").collect()}
    assert (mean["a"]["median"], mean["a"]["mad"], mean["a"]["inliers"], mean["a"]["mean"]) == (2.0, 1.0, 3, 2.0) and mean["b"]["median"] is None
    left = {r["k"]: r for r in summaries.residuals(df, ["k"], "v").collect()}
    assert (left["a"]["count"], left["a"]["max"]) == (3, 1.0) and left["a"]["rms"] == pytest.approx((2 / 3) ** 0.5) and left["b"]["count"] == 0


def test_painted_phases(spark):
    """The greatest order on top, against a loop over the phases."""
    import random

    rng = random.Random(4)
    phases = [(k, a := rng.randint(-40, 200), a + rng.choice([-3, 0, 1, 5, 40, 150]), f"p{i}", i) for k in "ab" for i in range(30)]
    samples = [(k, p) for k in "abc" for p in range(-60, 400)] + [("a", None), (None, 3), ("a", 5)]
    got = relations.painted_phases(spark.createDataFrame(samples, "k string, p int"), spark.createDataFrame(phases, "k string, first int, last int, name string, o int"),
                                   "k", "p", "name", "o").collect()
    assert len(got) == len(samples)
    for r in got:
        want = "unknown"
        for k, a, b, name, _ in phases:
            if r["p"] is not None and k == r["k"] and a <= r["p"] <= b:
                want = name
        assert r["name"] == want
    none = spark.createDataFrame([], "k string, first int, last int, name string, o int")
    assert {r["name"] for r in relations.painted_phases(spark.createDataFrame(samples, "k string, p int"), none, "k", "p", "name", "o").collect()} == {"unknown"}


def test_blocks_give_the_rows_of_whole_series(spark):
    """One long key over several tasks; a short one; windows at ends and at block borders."""
    import random

    rng = random.Random(8)
    rows = [("long", i * 3, rng.gauss(0, 1) + (9 if i % 97 == 0 else 0), rng.choice([0.0, 0.5, 1.0])) for i in range(1000)] + [("short", i, float(i), 1.0) for i in range(4)]
    df = spark.createDataFrame(rows, "k string, t int, v double, w double")
    whole = df.withColumn("pos", F.row_number().over(series.over("k", "t")))
    cut = blocks.numbered(df, "k", ["t"], F.col("t") / 100)
    assert {(r["k"], r["t"], r["pos"]) for r in cut.collect()} == {(r["k"], r["t"], r["pos"]) for r in whole.collect()}
    assert blocks.with_halo(cut, "k", "pos", 50, 15, 15).filter("own").select("block").distinct().count() == 21
    for op, out in ((lambda d, k, o: series.moving_average(d, k, o, "v", 6), "average"), (lambda d, k, o: series.rolling_mad_outliers(d, k, o, "v"), "mad"),
                    (lambda d, k, o: series.savgol(d, k, o, "v"), "smooth"), (lambda d, k, o: series.gaussian_smooth(d, k, o, "v", "w"), "smooth"),
                    (lambda d, k, o: series.rolling_median(d, k, o, ["v"]), "v_median")):
        a = {(r["k"], r["pos"]): r[out] for r in op(whole, "k", "pos").collect()}
        b = {(r["k"], r["pos"]): r[out] for r in blocks.in_blocks(cut, "k", "pos", op, halo=16, rows=50).collect()}
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)
    assert blocks.in_blocks(blocks.numbered(df.limit(0), "k", ["t"], F.col("t")), "k", "pos", lambda d, k, o: series.savgol(d, k, o, "v"), halo=6).count() == 0


def test_chained_tracks():
    frames = np.array([0, 0, 3, 3, 4, 9])
    b = np.array([[0, 0, 10, 10], [50, 0, 60, 10], [51, 0, 61, 10], [1, 0, 11, 10], [500, 0, 510, 10], [1, 0, 11, 10]], float)
    assert matching.chained(frames, b).tolist() == [0, 1, 1, 0, 2, 3]


def _plain_suppression(rows):
    kept, gone = [], {}
    iou = lambda a, b: matching.iou(np.array([a]), np.array([b]))[0, 0]
    for c, conf, box in sorted(rows, key=lambda r: (-r[1], r[0])):
        gone[c] = int(any(iou(box, k) > 0.3 for k in kept))
        if not gone[c]:
            kept.append(box)
    return gone


def test_matching_by_plain_models(spark, sf):
    from seriesforge.plans.registry import boxes

    b = boxes(spark, sf).filter("l_orderkey < 400").cache()
    frames = {}
    for r in b.collect():
        frames.setdefault(r["l_orderkey"], []).append((r["candidate"], r["confidence"], [r["x1"], r["y1"], r["x2"], r["y2"]]))
    got = {(r["l_orderkey"], r["candidate"]): r["dropped"] for r in matching.greedy_dedup(b, "l_orderkey", "candidate", "confidence").collect()}
    assert got == {(f, c): g for f, rows in frames.items() for c, g in _plain_suppression(rows).items()}
    # Tracking: every pair's score in one list, taken from the best on.
    one = b.withColumn("session", F.expr("l_orderkey div 64")).withColumnRenamed("l_orderkey", "frame")
    got = {(r["frame"], r["candidate"]): r["track_id"] for r in matching.track(one, "session", "frame", "candidate", reach=8.0).collect()}
    for s in {f // 64 for f in frames}:
        live, n = {}, 0
        for f in sorted(x for x in frames if x // 64 == s):
            rows, pairs = sorted(frames[f]), []
            for i, (_, _, box) in enumerate(rows):
                for t, (at, old) in live.items():
                    o = matching.iou(np.array([box]), np.array([old]))[0, 0]
                    d = float(np.hypot((box[0] + box[2] - old[0] - old[2]) / 2, (box[1] + box[3] - old[1] - old[3]) / 2))
                    if f - at <= 6 and (o >= 0.12 or d <= 8.0):
                        pairs.append((-(3 * o - d / 8.0 - 0.25 * (f - at - 1)), i, t))
            mine = {}
            for _, i, t in sorted(pairs):
                if i not in mine and t not in mine.values():
                    mine[i] = t
            for i, (c, _, box) in enumerate(rows):
                if i not in mine:
                    mine[i], n = n, n + 1
                assert got[f, c] == mine[i]
                live[mine[i]] = (f, box)


@pytest.mark.parametrize("batch", [10_000, 7])
def test_trackers_in_a_stream_equal_their_models(spark, batch):
    """Many ties, gaps, NULLs, crowded frames, and sessions that go over the batches' ends; no task holds a group."""
    rng = random.Random(4)
    rows = [(k, f, c, *((None,) * 4 if rng.random() < 0.05 else (x, y, x + 6.0, y + 6.0)))
            for k in range(-3, 9) for f in range(60) if rng.random() < 0.6 and f // 9 != 3 for c in range(rng.choice((1, 2, 5, 12)))
            for x, y in [(float(rng.randint(0, 7)), float(rng.randint(0, 7)))]]
    rows += [(None, f, c, 1.0 * c, 0.0, c + 6.0, 6.0) for f in (1, 2, 40) for c in range(3)]
    df = spark.createDataFrame(rows, "k int, f int, c int, x1 double, y1 double, x2 double, y2 double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = [{(r["k"], r["f"], r["c"]): r["track_id"] for r in d.collect()} for d in (
            matching.track(df, "k", "f", "c", bridge=4, reach=5.0), matching.chain(df, "k", "f", "c"))]
        plan = matching.track(df, "k", "f", "c")._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "FlatMapGroups" not in plan
        assert matching.track(df.limit(0), "k", "f", "c").count() == matching.chain(df.limit(0), "k", "f", "c").count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == k)
        frames, boxes = np.array([r[0] for r in own]), np.array([r[2:] for r in own], float)
        for found, want in zip(got, (matching.tracks(frames, boxes, 0.12, 4, 5.0), matching.chained(frames, boxes)), strict=True):
            assert [found[k, r[0], r[1]] for r in own] == want.tolist()
    assert [len(g) for g in got] == [len(rows)] * 2


def test_visible_choice_and_ladder(spark):
    seen = [[1 if j in on else 0 for j in range(21)] for on in ((0, 5), (0, 1, 2), (3, 4, 7, 8), ())]
    df = spark.createDataFrame([(i, v, [True] * 21) for i, v in enumerate(seen)], "i int, v array<int>, s array<boolean>")
    got = [tuple(r["c"]) for r in df.orderBy("i").select(estimators.visible_choice(F.col("v"), F.col("s"), every=4).alias("c")).collect()]
    assert got == [([0, 5], "visible_reliable_joints"), ([0, 1, 2], "visible_stable_joints"), ([3, 4, 7, 8], "visible_all_joints_fallback"), ([], "keep_previous_low_visible_depth")]
    one = df.select(estimators.first_ok([("palm", F.col("i") == 0, F.col("i")), ("wrist", F.col("i") < 2, F.col("i") + 10)]).alias("c")).collect()
    assert [r["c"] and tuple(r["c"]) for r in one] == [("palm", 0), ("wrist", 11), None, None]


def test_robust_translation_and_depth_correction(spark):
    rows = [("a", j, 1.0 + (j == 9) * 5, 2.0) for j in (0, 5, 9)] + [("b", 1, 3.0, 1.0), ("b", 0, 4.0, 1.0), ("b", 2, 8.0, 1.0), ("b", 3, float("nan"), 1.0)]
    got = {r["k"]: r for r in estimators.robust_translation(spark.createDataFrame(rows, "k string, j int, x double, y double"), ["k"], "j", ["x", "y"]).collect()}
    assert (got["a"]["x"], got["a"]["count"], got["a"]["max"], got["a"]["source"]) == (1.0, 3, 5.0, "depth_reliable_joints")
    assert (got["b"]["x"], got["b"]["count"], got["b"]["source"]) == (4.0, 3, "depth_all_joints")
    rng = np.random.default_rng(1)
    d = rng.uniform(0.5, 3, 300)
    t = 1.04 * d + rng.normal(0, 1e-4, 300)
    t[:40] += 2
    px = spark.createDataFrame([(7, float(a), float(b)) for a, b in zip(d, t)] + [(8, 1.0, 2.0)], "f int, d double, t double")
    got = {r["f"]: (r["scale"], r["offset"]) for r in estimators.depth_corrections(px, "f", "d", "t").collect()}
    assert got[7][0] == pytest.approx(1.04, abs=1e-3) and got[7][1] == pytest.approx(0, abs=1e-3) and got[8] == (1.0, 0.0)


def test_depth_from_two_dimensions(spark):
    rng = np.random.default_rng(2)
    rel, t = rng.uniform(-0.1, 0.1, (21, 3)), np.array([0.05, -0.02, 0.5])
    p = rel + t
    uv = np.stack((500 * p[:, 0] / p[:, 2] + 320, 500 * p[:, 1] / p[:, 2] + 240), 1)
    points = [(*map(float, r), *map(float, v)) for r, v in zip(rel, uv)]
    df = spark.createDataFrame([("a", points, 0.45), ("b", points[:3], None)], "k string, p array<struct<x:double,y:double,z:double,u:double,v:double>>, s double")
    got = {r["k"]: r for r in estimators.fit_depth(df, "k", "p", F.col("s"), 500, 500, 320, 240).collect()}
    assert (got["a"]["tx"], got["a"]["ty"], got["a"]["tz"]) == pytest.approx(tuple(t), abs=2e-3) and got["a"]["rms"] < 0.5 and "b" in got


def _plain_contact(z, speed, closed, fps):
    n, half, least = len(z), max(2, round(0.2 * fps)), max(2, round(0.12 * fps))

    def smooth(x):
        w = max(1, min(max(3, round(0.35 * fps)), n))
        return [np.mean([x[min(max(i - w // 2 + k, 0), n - 1)] for k in range(w)]) for i in range(n)]

    zs, ss = smooth(z), smooth(speed)
    on = [a <= np.percentile(zs, 30) + 1e-12 and b <= np.percentile(ss, 38) + 1e-12 for a, b in zip(zs, ss)]
    runs = []
    for i in np.flatnonzero(on).tolist():
        if runs and i <= runs[-1][1] + max(1, round(0.08 * fps)) + 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    runs = [tuple(r) for r in runs if r[1] - r[0] + 1 >= least]
    close = next((i for i in range(1, n) if closed[i] and not closed[i - 1]), None)
    release = None if close is None else next((i for i in range(max(close + 1, n // 3), n) if closed[i - 1] and not closed[i]), None)
    around = lambda c: (max(0, c - half), min(n - 1, c + half))
    mid = round(0.45 * (n - 1))
    if close is not None:
        pick, source = around(close), "gripper_close_transition"
    elif runs:
        pick, source = next((r for r in runs if r[0] <= mid), runs[0]), "low_z_slow"
    else:
        pick, source = around(int(np.argmin(zs[: max(2, n // 2)]))), "fallback_first_low_height"
    late = [r for r in runs if r[0] >= mid]
    two = around(release) if release is not None else late[-1] if late else runs[-1] if len(runs) >= 2 else None
    return pick, two if two and two[0] > pick[1] + least else None, source


def test_contact_windows_and_phases(spark):
    rng, rows, want = np.random.default_rng(5), [], {}
    for k in range(12):
        n = 60 + 7 * k
        z, v = np.round(rng.uniform(0, 1, n).cumsum() % 3, 3), np.round(rng.uniform(0, 1, n), 3)
        closed = [bool(k % 3 == 0 and n // 4 < i < n // 2) for i in range(n)]
        rows += [(k, i, float(z[i]), float(v[i]), closed[i]) for i in range(n)]
        want[k] = _plain_contact(z, v, closed, 10.0)
    df = spark.createDataFrame(rows, "k int, i int, z double, v double, c boolean")
    found = estimators.contact_windows(df, "k", "i", "z", "v", F.col("c"), 10.0).cache()
    for r in found.collect():
        two = None if r["release_from"] is None else (r["release_from"], r["release_to"])
        assert ((r["pick_from"], r["pick_to"]), two, r["source"]) == want[r["k"]]
    cover = {}
    for r in estimators.phases(found, "k").collect():
        cover.setdefault(r["k"], []).append((r["first"], r["last"]))
    for k, parts in cover.items():
        assert [x for a, b in sorted(parts) for x in range(a, b + 1)] == list(range(60 + 7 * k))


def test_gates_fail_on_missing_measures(spark):
    m = spark.createDataFrame([(5, None)], "rows long, source_rows long")
    m = m.withColumn("k", F.lit(1))
    lines = stages.lines(m, "k", "x", (stages.Check("agree", "rows = source_rows"), stages.Check("some", "rows > 0", "warning")))
    r = stages.report(lines, "k").first()
    assert (r["errors"], r["warnings"], r["ok"], r["exit_code"]) == (1, 0, False, 2)


def test_every_check_fails_and_holds_somewhere(spark):
    """Over the sessions of the given tables; fields are all there, see the next test."""
    from seriesforge.plans import stages as plans

    for node, measure in plans.MEASURES.items():
        seen = {(r["check"], r["ok"]) for r in stages.lines(measure(spark, "/root/testdata/sf0.01"), "session", node, stages.GATES[node]).select("check", "ok").distinct().collect()}
        for c in stages.GATES[node]:
            assert (c.name, True) in seen or c.name == "no overlap in a label", (node, c.name)
            assert (c.name, False) in seen or c.name in ("fields there", "valid ratio", "mostly finite"), (node, c.name)


def test_gate_phases_and_missing_fields(spark):
    sessions = spark.createDataFrame([("a", 2), ("b", 2), ("c", 2), ("d", None)], "s string, expected long")
    summary = spark.createDataFrame([("a", True, 2, [], None), ("b", False, 2, ["x", "y"], ["w"]), ("d", True, 7, None, None)],
                                    "s string, ok boolean, candidates long, hard_errors array<string>, warnings array<string>")
    nan = float("nan")
    rows = spark.createDataFrame([("a", [(1.0, nan)], "ok"), ("a", [(1.0, 2.0)], "bad_x|warn_y"), ("b", None, None), ("b", [], "ok"), ("d", [(nan, nan)], "ok")],
                                 "s string, joints_cam_smooth array<struct<x:double,y:double>>, f string")
    m = stages.counted(stages.stage_measures(stages.summarised(sessions, "s", summary), "s", rows, ("joints_cam_smooth", "f"), ("joints_cam_smooth",), "f"), "s", "quality_rows", rows)
    got = {r["s"]: r for r in m.collect()}
    assert (got["a"]["not_finite"], got["a"]["half_finite"], got["d"]["half_finite"], got["c"]["rows"]) == (1, 0, 1, 0)
    assert (got["b"]["summary_errors"], got["b"]["summary_warnings"], got["d"]["summary_errors"]) == (2, 1, 0)
    asked = {}
    for r in stages.lines(m, "s", "F", stages.GATES["F"]).collect():
        asked.setdefault(r["s"], {})[r["check"]] = (r["ok"], r["times"])
    assert set(asked["c"]) == {"summary there"} and asked["c"]["summary there"] == (False, 1)
    assert asked["b"]["summary errors"] == (False, 2) and "finite" not in asked["b"] and "fields there" in asked["b"]
    assert asked["a"]["finite"] == (False, 1) and asked["a"]["bad flags"] == (False, 1) and asked["a"]["quality rows agree"] == (True, 0)
    assert asked["d"]["summary count as expected"] == (True, 0)
    bare = stages.stage_measures(stages.summarised(sessions, "s", summary), "s", rows.drop("f"), ("joints_cam_smooth", "f", "g"), ("joints_cam_smooth", "g"), "f")
    out = {r["s"]: r for r in stages.report(stages.lines(stages.counted(bare, "s", "quality_rows", None), "s", "F", stages.GATES["F"]), "s").collect()}
    assert bare.first()["missing_fields"] == 2 and out["a"]["errors"] == 1 and out["c"]["errors"] == 0 and out["c"]["warnings"] == 1
    out = {r["s"]: r for r in stages.report(stages.lines(stages.counted(bare, "s", "quality_rows", rows), "s", "F", stages.GATES["F"]), "s").collect()}
    assert out["a"]["errors"] == 2 and out["a"]["exit_code"] == 2


def test_relations_on_odd_input(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "p int, v string")
    with pytest.raises(ValueError):
        relations.joined_in_place(df, df.limit(1), "p")
    assert relations.joined_in_place(df, df.withColumnRenamed("v", "w"), "p").count() == 2
    with pytest.raises(ValueError):
        relations.active_segment(df.withColumn("k", F.lit(1)), "k", "p", F.lit(False), 0)
    assert relations.with_missing(df, {"v": "x", "w": 5}).first()["w"] == 5
    assert relations.common_keys([df.limit(0)], "p").count() == 0
    keys = spark.range(1000).selectExpr("id * 7919 % 100003 AS p").cache()
    assert [r["place"] for r in relations.common_keys([keys, keys], "p", parts=16).orderBy("p").collect()] == list(range(1000))
    assert tracks.spikes(spark.createDataFrame([], "t int, f int, x double"), "t", "f", ["x"]).count() == 0
    s = spark.createDataFrame([((1, 2),)], "s struct<a:int,b:int>").select(summaries.overridden(F.col("s"), b=F.lit(9), c=F.lit(3)).alias("s")).first()["s"]
    assert s.asDict() == {"a": 1, "b": 9, "c": 3}


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,NA\n,2\n")
    got = files.read_csv_indexed(spark, str(tmp_path / "a.csv"), ["y", "x"]).orderBy("row_index").collect()
    assert [(r["row_index"], r["y"], r["x"]) for r in got] == [(0, "NA", "1"), (1, "2", "")]
    with pytest.raises(Exception, match="missing columns: z"):
        files.read_csv_indexed(spark, str(tmp_path / "a.csv"), ["z"]).collect()
    a, b = spark.createDataFrame([(1, "p")], "u int, v string"), spark.createDataFrame([(2.5, 3)], "w double, u int")
    files.write_csv_union([a, b], str(tmp_path / "union"))
    back = files.read_csv_checked(spark, str(tmp_path / "union"), ["u", "v", "w"])
    assert back.columns == ["u", "v", "w"] and {tuple(r) for r in back.collect()} == {("1", "p", None), ("3", None, "2.5")}
    with pytest.raises(ValueError):
        files.read_csv_checked(spark, str(tmp_path / "union"), ["nothing"])
    rows = spark.createDataFrame([("f", 0, 1, [1.0, 2.0], "x"), ("f", 0, 0, [3.0, 4.0], "y")], "file string, frame_index int, candidate_index int, j array<double>, t string")
    content = files.npz_files(rows, "file", ["frame_index", "candidate_index", "j", "t"]).first()["content"]
    (tmp_path / "b.npz").write_bytes(content)
    np.savez(tmp_path / "c.npz", frame_index=np.array([4]), j=np.array([[1.0, 2.0]]), faces=np.arange(6.0).reshape(2, 3), scale=np.float64(2))
    got = files.read_npz(spark, str(tmp_path / "b.npz"), "candidate_index int, j array<double>, t string").collect()
    assert [tuple(r) for r in got] == [(0, [3.0, 4.0], "y"), (1, [1.0, 2.0], "x")]
    got = files.read_npz(spark, str(tmp_path / "c.npz"), "frame_index int, faces array<double>, scale double").first()
    assert tuple(got) == (4, [0.0, 1.0, 2.0, 3.0, 4.0, 5.0], 2.0)
    found = files.listing(spark, str(tmp_path / "*.npz"))
    assert files.newest(found).endswith("c.npz") and files.newest(found.limit(0)) is None
    assert [r["ready"] for r in files.ready(found, 10**9).collect()] == [False, False]
    named = spark.createDataFrame([("b.npz",), ("x/b.npz",), ("none.npz",)], "p string")
    assert [r["p"] for r in files.existing(named, found, "p").collect()] == ["b.npz"]
    assert files.subset(rows, F.col("t") == "x", "frame_index", ["candidate_index"]).first()["candidate_index"] == 0
    assert files.empty_table(spark, "a int").columns == ["a"]


def test_json_and_lookups(spark, tmp_path):
    df = spark.createDataFrame([([1.0, float("nan")], {"a": float("inf")}, (float("nan"), 2), None)], "v array<double>, m map<string,double>, s struct<x:double,y:int>, n struct<x:double>")
    assert json.loads(files.clean_json(df).first()[0]) == {"v": [1.0, None], "m": {"a": None}, "s": {"x": None, "y": 2}, "n": None}
    (tmp_path / "d.json").write_text('{"a": {"b": [1, 2]},\n "c": "t"}')
    assert files.read_json(spark, str(tmp_path / "d.json")).first()["a"]["b"] == [1, 2]
    row = spark.createDataFrame([('{"a": {"b": "v"}}', '{"fx": 1, "fy": 2, "cx": 3, "cy": 4}', 600.0, "/host/x/y")], "j string, cell string, f double, p string")
    got = row.select(files.json_at(F.col("j"), "a.b"), files.intrinsics(F.col("cell"), F.col("f"), F.lit(640), F.lit(480), 500.0), files.intrinsics(F.lit("{}"), F.col("f"), F.lit(640), F.lit(480), 500.0),
                     files.intrinsics(F.lit(None), F.lit(None), F.lit(640), F.lit(480), 500.0), files.moved_path(F.col("p"), "/host/", "/in"), files.moved_path(F.col("p"), "/hos", "/in")).first()
    assert got[0] == "v" and tuple(got[1]) == (1.0, 2.0, 3.0, 4.0, "json") and tuple(got[2]) == (600.0, 600.0, 320.0, 240.0, "focal")
    assert got[3]["source"] == "default" and got[4] == "/in/x/y" and got[5] == "/host/x/y"
    eye = [[float(i == j) for j in range(4)] for i in range(4)]
    m = spark.createDataFrame([(1, eye), (2, None), (3, eye[:3])], "i int, m array<array<double>>")
    assert m.filter("i < 3").select(files.checked_matrix(F.col("m"))).count() == 2
    with pytest.raises(Exception, match="4 x 4"):
        m.select(files.checked_matrix(F.col("m"))).collect()
    t = spark.createDataFrame([("a", "ok", 1.5), ("a", "bad", 9.0), ("b", "bad", 1.0)], "s string, r string, t double")
    assert {tuple(r) for r in files.timing_rollup(t, "s", "r", "t").collect()} == {("a", 2, 1, 1, 1.5), ("b", 1, 0, 1, 0.0)}
    f = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (5, 0, "d"), (7, 0, "e")], "f int, o int, v string")
    assert {(r["f"], r["v"]) for r in files.manifest(f, "f", "o").collect()} == {(1, "b"), (2, "c"), (5, "d"), (7, "e")}
    assert {r["f"] for r in files.frame_options(f, "f", 1, 7, 2, 2).collect()} == {1, 5}
    n = files.nested_frames(spark.createDataFrame([(0, 1, 1, 2.0), (0, 1, 0, 1.0), (0, 0, 0, 5.0)], "f int, c int, p int, x double"), "f", "c", "p", ["x"]).first()
    assert [(c["c"], [tuple(p) for p in c["points"]]) for c in n["candidates"]] == [(0, [(0, 5.0)]), (1, [(0, 1.0), (1, 2.0)])]


def test_clamped_rotation_keeps_its_swing(spark):
    q = np.array([0.8, 0.1, 0.2, 0.55])
    q /= np.linalg.norm(q)
    df = spark.createDataFrame([tuple(map(float, q))], "w double, x double, y double, z double")
    c, axis = [F.col(n) for n in "wxyz"], [F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    clamped = R.clamped_twist(c, axis, -0.2, 0.2)
    df = df.select(*"wxyz", *[x.alias(f"h{n}") for n, x in zip("wxyz", clamped)]).cache()
    got = []
    for p in ("", "h"):
        swing, twist = R.swing_twist([F.col(p + n) for n in "wxyz"], axis)
        got.append(df.select(*[x.alias(f"s{i}") for i, x in enumerate(swing)], F.atan2(twist[3], twist[0]).alias("t")).first())
    assert list(got[0])[:4] == pytest.approx(list(got[1])[:4]) and 2 * got[1]["t"] == pytest.approx(0.2)



def test_held_values_over_batches(spark, tmp_path):
    """Order holds across batches; late rows drop; what never came in time isn't held."""
    t0 = dt.datetime(2024, 1, 1)
    schema = "k string, ts timestamp, p long, v double, g boolean"
    row = lambda k, s, p, v, g: (k, t0 + dt.timedelta(seconds=s), p, v, g)
    batches = [[row("a", 1, 1, 1.0, True), row("a", 3, 3, 3.0, False), row("b", 1, 1, 9.0, True)], [row("a", 2, 2, 2.0, True), row("a", 9, 9, 9.0, False)],
               [row("a", 1, 0, 7.0, True), row("a", 40, 40, None, True), row("b", 40, 2, 4.0, False)], [row("c", 90, 1, 1.0, True)]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        (tmp_path / "now").mkdir()
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "now"))
        out = sessions.hold_last_stream(stream, "k", "ts", "p", "v", "g", 2, late="2 seconds")
        q = out.writeStream.format("memory").queryName("held_rows").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
        for i in range(len(batches)):
            for f in (tmp_path / f"in/{i}").glob("*.parquet"):
                f.rename(tmp_path / "now" / f"{i}.parquet")
            q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {(r["k"], r["p"]): r["held"] for r in spark.table("held_rows").collect()}
    assert got[("a", 1)] == 1.0 and got[("a", 2)] == 2.0 and got[("a", 3)] == 2.0 and got[("a", 9)] is None
    assert ("a", 0) not in got and got[("b", 1)] == 9.0


def test_session_islands(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(seconds=s)) for s in (0, 2, 4, 60, 61, 500)]
    spark.createDataFrame(rows, "k string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in"))
    q = sessions.session_islands(stream, "k", "ts", "10 seconds", "1 second").writeStream.format("memory").queryName("islands").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["n"] for r in spark.table("islands").collect()) == [2, 3]


def _fed(spark, tmp_path, name, batches, schema, build):
    """What a stream that gets these batches, one after another, gives."""
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.shuffle.partitions", "2")
    (tmp_path / "now").mkdir()
    stream = own.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "now"))
    q = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    for i in range(len(batches)):
        for f in (tmp_path / f"in/{i}").glob("*.parquet"):
            f.rename(tmp_path / "now" / f"{i}.parquet")
        q.processAllAvailable()
    q.stop()
    return own.table(name).collect()


def test_streaming_tracker_equals_batch(spark, tmp_path):
    """Three batches with rows out of order and late ones; tracks expire, and numbers are never given twice."""
    import random

    rng, t0 = random.Random(2), dt.datetime(2024, 1, 1)
    schema = "k string, ts timestamp, f int, c int, x1 double, y1 double, x2 double, y2 double"

    def row(k, f, c):
        x, y = 10.0 * c + rng.random() * 4 + f / 5, 3.0 * (f % 4)
        return (k, t0 + dt.timedelta(seconds=f), f, c, x, y, x + 12, y + 12)

    frames = [f for f in range(60) if f % 20 < 13]  # gaps longer than a track lives
    rows = [row(k, f, c) for k in "ab" for f in frames for c in range(rng.randint(0, 3))]
    rows.append(("a", t0 + dt.timedelta(seconds=12), 12, 9, None, 0.0, 5.0, 5.0))
    cut = [[r for r in rows if r[2] < 22], [r for r in rows if 22 <= r[2] < 42], [r for r in rows if r[2] >= 42]]
    held = [r for r in cut[0] if r[2] in (20, 21)]  # come a batch later, still in time
    cut[0] = [r for r in cut[0] if r not in held]
    cut[1] = held + cut[1]
    for b in cut:
        rng.shuffle(b)
    late = [row("a", 1, 7), row("b", 2, 7)]  # long past
    end = [(k, t0 + dt.timedelta(seconds=500), 500, 0, 0.0, 0.0, 1.0, 1.0) for k in "ab"]
    got = _fed(spark, tmp_path, "tracked", [cut[0], cut[1], cut[2] + late, end, [("c", t0 + dt.timedelta(seconds=900), 1, 0, 0.0, 0.0, 1.0, 1.0)]], schema,
               lambda s: tracking.track_stream(s, "k", "ts", "f", "c", bridge=5, reach=20.0, late="5 seconds"))
    batch = matching.track(spark.createDataFrame(rows, schema), "k", "f", "c", bridge=5, reach=20.0).collect()
    want = {(r["k"], r["f"], r["c"]): r["track_id"] for r in batch}
    mine = {(r["k"], r["f"], r["c"]): r["track_id"] for r in got if r["f"] < 500}
    assert mine == want and len(set(want.values())) > 4
    assert {r["track_id"] for r in got if r["f"] == 500 and r["k"] == "a"} == {1 + max(t for (k, _, _), t in want.items() if k == "a")}


def test_streaming_jump(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    row = lambda k, p, x, y: (k, t0 + dt.timedelta(seconds=p), p, x, y)
    batches = [[row("a", 1, 0.0, 0.0), row("a", 3, 3.0, 4.0)], [row("a", 2, 3.0, 4.0), row("a", 4, None, 1.0), row("b", 4, 1.0, 1.0)],
               [row("a", 9, 0.0, 0.0), row("a", 1, 7.0, 7.0)], [row("a", 100, 6.0, 8.0), row("b", 100, 1.0, 2.0)], [row("c", 900, 1.0, 1.0)]]
    got = _fed(spark, tmp_path, "jumps", batches, "k string, ts timestamp, p int, x double, y double",
               lambda s: tracking.jump_stream(s, "k", "ts", "p", ["x", "y"], late="3 seconds", idle_ms=10**7))
    mine = {(r["k"], r["p"]): r["jump"] for r in got}
    assert mine["a", 2] == 5.0 and mine["a", 3] == 0.0 and mine["a", 100] == 10.0 and mine["b", 100] == 1.0
    assert all(mine[k] is None for k in (("a", 1), ("a", 4), ("a", 9), ("b", 4))) and len(mine) == 8


def test_mesh_edges(spark):
    """Vertices that aren't finite or lie behind, faces without area or corners, points outside; nearest points on ties and in other keys."""
    v = lambda *p: {"u": p[0], "v": p[1], "z": p[2]}
    square = [v(0.0, 0.0, 2.0), v(4.0, 0.0, 2.0), v(0.0, 4.0, 2.0), v(4.0, 4.0, 1.0), v(float("nan"), 0.0, 1.0), v(1.0, 1.0, -1.0)]
    df = spark.createDataFrame([("a", square, (0, 0, 3, 9)), ("b", [], (0, 0, 9, 9)), ("c", None, (0, 0, 9, 9)), ("d", square, None)],
                               "k string, v array<struct<u:double,v:double,z:double>>, clip struct<x1:int,y1:int,x2:int,y2:int>")
    faces = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip("abc", f, strict=True)]) for f in ((0, 1, 2), (1, 2, 3), (0, 1, 4), (0, 1, 5), (0, 0, 1), (0, 1, 77))])
    front = meshes.surface(df, ["k"], "v", faces, "clip").cache()
    z = {(r["px"], r["py"]): r["z"] for r in front.collect()}
    assert len(z) == 4 * 5 and z[0, 0] == 2.0 and z[3, 4] == pytest.approx(1.25) and set(front.select("k").distinct().collect()) == {("a",)}
    points = spark.createDataFrame([("a", 1, 0.4, 0.5, 2.005), ("a", 2, 3.0, 4.0, 2.5), ("a", 3, 90.0, 0.0, 1.0), ("a", 4, None, 0.0, 1.0), ("b", 1, 0.0, 0.0, 1.0),
                                    ("a", 5, 1.0, 1.0, None)], "k string, i int, u double, v double, z double")
    got = {(r["k"], r["i"]): r for r in meshes.visible_points(points, front, ["k"], "i", "u", "v", "z", radius=0).collect()}
    assert got["a", 1]["visible"] == 1 and got["a", 2]["visible"] == 0 and got["a", 2]["margin"] == pytest.approx(1.25)
    assert all(got[k]["margin"] is None and got[k]["visible"] == 0 for k in (("a", 3), ("a", 4), ("b", 1), ("a", 5)))
    import random

    rng = random.Random(1)
    near = [("x", i, float(rng.randint(0, 9)), float(rng.randint(0, 9))) for i in range(300)] + [("y", 1, 5.0, 5.0), ("y", 2, 5.0, 5.0), ("x", 999, float("nan"), 1.0)]
    asked = [("x", i, rng.uniform(-40, 60), rng.uniform(-3, 12)) for i in range(60)] + [("y", 1, 0.0, 0.0), ("z", 1, 0.0, 0.0), ("x", 900, None, 0.0)]
    found = meshes.nearest_points(spark.createDataFrame(asked, "k string, q int, a double, b double"), spark.createDataFrame(near, "k string, p int, a double, b double"),
                                  "k", "q", "p", ["a", "b"], 7).collect()
    want = set()
    for k, q, a, b in asked:
        if a is not None:
            own = sorted((np.sqrt((a - c) ** 2 + (b - d) ** 2), p) for kk, p, c, d in near if kk == k and c == c)[:7]
            want |= {(k, q, p, i + 1) for i, (_, p) in enumerate(own)}
    assert {(r["k"], r["q"], r["p"], r["rank"]) for r in found} == want


def test_nearest_points_ranks_few_candidates(spark):
    """Of what the cells around a query hold, only points within the k-th distance of its own cell are ranked."""
    import random

    rng = random.Random(5)
    near = [("x", i, *(rng.random() for _ in range(3))) for i in range(4000)] + [("x", 4000 + i, 0.5, 0.5, 0.5) for i in range(9)]
    asked = [("x", i, *(rng.random() for _ in range(3))) for i in range(150)] + [("x", 900, 0.5, 0.5, 0.5), ("x", 901, 7.0, 7.0, -7.0)]
    schema = "a double, b double, c double"
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = meshes.nearest_points(spark.createDataFrame(asked, f"k string, q int, {schema}"), spark.createDataFrame(near, f"k string, p int, {schema}"), "k", "q", "p", ["a", "b", "c"], 6)
        found = {(r["q"], r["p"], r["rank"]) for r in got.collect()}
        plan = got._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    rows, todo = [], [plan]
    while todo:
        p = todo.pop()
        if "Join" in p.nodeName():
            rows.append(p.metrics().apply("numOutputRows").value())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    assert rows and max(rows) < 60 * len(asked)
    dist = lambda u, v: np.sqrt(sum((x - y) * (x - y) for x, y in zip(u, v, strict=True)))
    assert found == {(q, p, n) for _, q, *u in asked for n, (_, p) in enumerate(sorted((dist(u, v), p) for _, p, *v in near)[:6], 1)}
