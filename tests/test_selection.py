"""Exact medians without sorting pixels, samples merged over tasks, and detection of images in bands."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import frames as fr, selection
from framelake.operators.skew import group_medians
from framelake.plans.detection import detections
from framelake.plans.large_images import large_detections
from framelake.sources.bands import read_bands
from framelake.sources.manifest import list_files
from framelake.sources.tables import scan_binary
from tests.helpers import fits_bytes, frames_of

INF, NAN = float("inf"), float("nan")


def test_keys_keep_the_order(spark):
    rng = np.random.default_rng(1)
    values = [0.0, -0.0, 1.5, -1.5, 5e-324, -5e-324, 1.7e308, -1.7e308, *rng.normal(0, 1e6, 300), *rng.normal(0, 1e-6, 300)]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    rows = df.select("v", selection.ordered_key("v").alias("k")).withColumn("back", selection.key_value("k")).collect()
    known = [r for r in rows if r.v is not None]
    assert [r.v for r in sorted(known, key=lambda r: r.k)] == sorted(r.v for r in known)
    assert all(r.back == r.v for r in known) and [tuple(r) for r in rows if r.v is None] == [(None, None, None)]
    zeros = {r.k for r in known if r.v == 0}
    assert len(zeros) == 1 and zeros == {struct.unpack("<q", struct.pack("<d", 0.0))[0]}


@pytest.fixture(scope="module")
def groups(spark):
    """A large group with few values, others of all sizes, nulls, NaN and infinities, a null key."""
    rng = np.random.default_rng(2)
    data = {
        "ties": rng.integers(0, 4, 4000).astype(float), "near": 1.0 + rng.integers(0, 50, 999) * 2.0**-52,
        "mixed": np.concatenate([rng.normal(0, 1, 500), rng.normal(0, 1e300, 500)]), "one": np.array([-7.5]),
        "two": np.array([3.0, 4.0]), "odd": np.array([1.0, NAN, INF, -INF, 2.0, 9.0]), "none": np.array([NAN, INF]), None: rng.normal(0, 1, 64),
    }
    rows = [(k, float(v)) for k, values in data.items() for v in values] + [("ties", None), ("void", None)]
    return data, spark.createDataFrame(rows, "k string, v double").repartition(7)


def test_selected_medians(groups):
    data, df = groups
    found = {r.k: (r.n_valid, r.median) for r in selection.exact_medians(df, ["k"], "v").collect()}
    assert found.pop("void") == (0, None) and found.pop("none") == (0, None)
    for k, (n, median) in found.items():
        good = data[k][np.isfinite(data[k])]
        assert n == good.size and median == np.median(good), k


def test_selection_equals_the_sorted_plan(spark, groups):
    _, df = groups
    finite = df.filter(F.abs("v") < INF)
    plain = {r.k: r.median for r in group_medians(finite, ["k"], "v").collect()}
    assert {r.k: r.median for r in selection.exact_medians(finite, ["k"], "v").collect()} == plain
    whole = [r.v for r in finite.collect()]
    assert [tuple(r) for r in selection.exact_medians(finite, [], "v").collect()] == [(len(whole), float(np.median(whole)))]
    assert selection.exact_medians(finite.limit(0), ["k"], "v").collect() == []


def test_pixels_are_neither_sorted_nor_shuffled(spark, groups, monkeypatch):
    """Each round's plan: pixels are scanned and counted; only counts go through an exchange."""
    plans, plain = [], selection.materialize
    monkeypatch.setattr(selection, "materialize", lambda df, label: plans.append(
        (label, df._jdf.queryExecution().executedPlan().toString())) or plain(df, label))
    selection.exact_medians(groups[1], ["k"], "v").collect()
    rounds = [p for label, p in plans if label == "narrowed"]
    assert len(rounds) == 4
    for plan in rounds:
        # Below the partial count there is no exchange or sort of its own branch but what feeds a broadcast.
        partial = plan[plan.rindex("partial_count(1)"):]
        assert "Sort" not in partial and "SortMergeJoin" not in plan
        assert "Exchange hashpartitioning" not in partial or "BroadcastExchange" in partial


@pytest.mark.parametrize("sample,parts", [(1, 3), (20, 1), (20, 9), (700, 5), (5000, 2)])
def test_same_draw_as_the_row_form(spark, sample, parts):
    rng = np.random.default_rng(3)
    images = {f"i{n}": rng.normal(10, 3, (h, w)).astype(np.float32) for n, (h, w) in enumerate([(30, 40), (7, 3), (1, 1), (50, 31)])}
    images["i0"][3, 4], images["i3"][0, 0] = NAN, 500
    rows = frames_of(spark, images).select("frame_id", "pixels", "width")
    expected = {r.frame_id: r for r in fr.sampled_stats(rows, "pixels", ["frame_id"], sample, 5).collect()}
    pixels = fr.pixel_explode(rows, ["frame_id"], "pixels", "width").join(rows.select("frame_id", "width"), "frame_id")
    pixels = pixels.withColumn("place", F.col("y") * F.col("width") + F.col("x")).repartition(parts)
    for r in selection.sampled_stats_long(pixels, ["frame_id"], "place", "v", sample, 5).collect():
        own = expected.pop(r.frame_id)
        assert r.num_objects == own.num_objects
        assert r.mean_value == pytest.approx(own.mean_value) and r.std_value == pytest.approx(own.std_value)
    assert not expected


def test_tasks_hand_over_samples_only(spark, monkeypatch):
    """However many pixels a task sees, it passes a sample per image on, also when images are many."""
    few = spark.range(0, 200_000, 1, 4).selectExpr("id % 3 as k", "cast(id as int) as place", "cast(id as double) as v")
    hashed = few.select("k", fr.pixel_hash(F.col("k"), F.col("place")).alias("_h"), F.col("place").alias("_i"), F.col("v").alias("_v"))
    kept = hashed.mapInArrow(selection._smallest(["k"], 10), hashed.schema)
    assert kept.count() == 4 * 3 * 10
    monkeypatch.setattr(selection, "HELD", 1000)
    many = hashed.withColumn("k", F.col("_i") % 50_000)
    passed = many.mapInArrow(selection._smallest(["k"], 10), many.schema)
    best = {(r.k, r._h) for r in many.collect()}
    assert {(r.k, r._h) for r in passed.collect()} == best  # at most ten a key: nothing may be lost


def test_large_detections_equal_the_row_form(spark, tmp_path):
    rng = np.random.default_rng(4)
    files = {}
    for n, (h, w) in enumerate([(60, 45), (33, 70), (16, 16)]):
        image = rng.normal(100, 2, (h, w))
        for _ in range(12):
            y, x = rng.integers(0, h), rng.integers(0, w)
            image[max(0, y - 2):y + 2, max(0, x - 3):x + 3] += rng.uniform(8, 300)
        image[0, 0], image[1, 1] = NAN, INF
        files[f"20250101{n}0_science.fits"] = fits_bytes(image)
    files["flat_template.fits"] = fits_bytes(np.full((9, 9), 3.0))
    files["dark_difference.fits"] = fits_bytes(np.full((9, 9), NAN))
    files["broken.fits"], files["short.fits"] = b"no", fits_bytes(np.ones((200, 9)))[:-3000]
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    expected = {r.file_path: r for r in detections(scan_binary(spark, str(tmp_path)), listed=20).collect()}
    bands = read_bands(list_files(spark, str(tmp_path)), band_bytes=2000)
    found = {r.file_path: r for r in large_detections(bands, tile=16).collect()}
    assert set(found) == set(expected) and len(found) == len(files)

    def close(a, b):
        if isinstance(a, list):
            return len(a) == len(b) and all(close(x, y) for x, y in zip(a, b))
        if isinstance(a, float):
            return math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-9)
        return close(list(a), list(b)) if isinstance(a, tuple) else a == b

    for path, own in expected.items():
        for column in own.asDict():
            assert close(own[column], found[path][column]), (path, column, own[column], found[path][column])
    assert sum(r.bright_sources > 0 for r in found.values()) >= 2
