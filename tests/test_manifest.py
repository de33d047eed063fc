"""Listings and readings by tasks, and images in bands, against Spark's file source and whole files."""

import gzip
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.sources.bands import BAND, band_pixels, layouts, read_bands
from framelake.sources.images import decode_frames, read_image
from framelake.sources.manifest import list_files, packed, read_files
from framelake.sources.tables import scan_binary
from tests.helpers import fits_bytes


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Files at several depths, an empty folder, hidden names, an empty file."""
    root = tmp_path_factory.mktemp("raw")
    rng = np.random.default_rng(1)
    for i in range(60):
        place = root / f"night{i % 3}" / f"ccd{i % 5}"
        place.mkdir(parents=True, exist_ok=True)
        (place / f"{i}_science.fits").write_bytes(rng.bytes(100 + 37 * i))
    (root / "top.fits").write_bytes(b"top")
    (root / "empty.fits").write_bytes(b"")
    (root / "note.txt").write_bytes(b"text")
    (root / "_hidden.fits").write_bytes(b"x")
    (root / ".dot").mkdir()
    (root / ".dot" / "a.fits").write_bytes(b"x")
    (root / "nothing" / "below").mkdir(parents=True)
    return str(root)


def by_path(df, *columns):
    return {r.path: tuple(bytes(r[c]) if c == "content" else r[c] for c in columns) for r in df.collect()}


@pytest.mark.parametrize("glob", [None, "*.fits", "1*_science.fits"])
def test_listing_equals_the_file_source(spark, folder, glob):
    expected = scan_binary(spark, folder, glob, recursive=True)
    found = list_files(spark, folder, glob)
    columns = ["length", "modificationTime"]
    # The file source leaves empty files out; here they are rows that cannot be decoded.
    assert by_path(found.filter("length > 0"), *columns) == by_path(expected, *columns)
    assert {r.status for r in found.collect()} == {"SUCCESS"} and found.filter("length = 0").count() == (glob in (None, "*.fits"))


def test_reading_equals_the_file_source(spark, folder):
    expected = by_path(scan_binary(spark, folder, recursive=True), "length", "modificationTime", "content")
    for size in (500, 10_000, 1 << 30):
        read = read_files(list_files(spark, folder), bytes_per_task=size, open_cost=10)
        assert by_path(read.filter("length > 0"), "length", "modificationTime", "content") == expected
        assert [bytes(r.content) for r in read.filter("length = 0").collect()] == [b""]


def test_unreadable_paths_are_rows(spark, folder):
    paths = [f"{folder}/night0", f"{folder}/missing", f"{folder}/top.fits", "nosuch://host/x", f"{folder}/missing"]
    rows = list_files(spark, paths).collect()
    failed = {r.path: r.status for r in rows if r.status != "SUCCESS"}
    assert set(failed) == {f"{folder}/missing", "nosuch://host/x"} and all(s.startswith("ERR:") for s in failed.values())
    assert len(rows) == 2 + 1 + len([r for r in rows if "/night0/" in r.path])
    read = read_files(list_files(spark, paths)).collect()
    assert sorted(r.path for r in read if r.content is None) == sorted(failed) and {r.status for r in read if r.content is not None} == {"SUCCESS"}


def test_a_file_that_is_gone_is_a_row(spark, tmp_path):
    for name in ("a.fits", "b.fits"):
        (tmp_path / name).write_bytes(b"data")
    listed = list_files(spark, str(tmp_path))
    os.remove(tmp_path / "a.fits")
    rows = {r.path.rsplit("/", 1)[-1]: r for r in read_files(listed).collect()}
    assert rows["a.fits"].content is None and rows["a.fits"].status.startswith("ERR:") and bytes(rows["b.fits"].content) == b"data"


def test_nothing_to_list(spark, tmp_path):
    assert list_files(spark, str(tmp_path)).collect() == [] == list_files(spark, []).collect()
    assert read_files(list_files(spark, str(tmp_path))).collect() == [] == read_bands(list_files(spark, str(tmp_path))).collect()


def test_paths_may_be_a_table(spark, folder):
    paths = spark.createDataFrame([(f"{folder}/night{i}",) for i in (0, 1, 1)], "path string")
    found = {r.path for r in list_files(spark, paths).collect()}
    assert found == {r.path for r in list_files(spark, [f"{folder}/night0", f"{folder}/night1"]).collect()} and len(found) == 40


def test_packs_hold_equal_bytes(spark, folder):
    listed = list_files(spark, folder)
    for size in (2_000, 20_000):
        rows, packs = packed(listed, size, 100)
        loads = {}
        for r in rows.collect():
            loads[r.pack] = loads.get(r.pack, 0) + r.length + 100
        largest = max(r.length for r in listed.collect()) + 100
        assert set(loads) <= set(range(packs)) and max(loads.values()) <= size + largest
        assert packs == -(-sum(loads.values()) // size)


def test_no_file_index_of_images(spark, folder):
    """Images are read by tasks: the only scans are of the manifest, and packs go where they belong."""
    read = read_files(list_files(spark, folder), bytes_per_task=5_000)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert folder not in plan and "binaryfile" not in plan.lower() and "MapInArrow" in plan
    per_task = read.groupBy(F.spark_partition_id()).agg(F.sum("length").alias("n")).collect()
    assert len(per_task) > 5 and max(r.n for r in per_task) <= 5_000 + 2_300


# Bands ------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def images(tmp_path_factory):
    """Every pixel type, an image behind an empty unit, scaled and blank pixels, gzipped files, broken ones."""
    root = tmp_path_factory.mktemp("bands")
    rng = np.random.default_rng(2)
    grid = rng.normal(100, 20, (37, 23))
    grid[3, 4] = np.nan
    whole = np.abs(np.nan_to_num(grid)).round()
    files = {f"bits{b}.fits": fits_bytes(grid if b < 0 else whole % 256, b) for b in (8, 16, 32, 64, -32, -64)}
    files["scaled.fits"] = fits_bytes(whole, 16, {"BSCALE": "2.5", "BZERO": "-7.0", "BLANK": str(int(whole[5, 5]))})
    files["second.fits"] = fits_bytes(grid, empty_first=True)
    files["cube.fits"] = fits_bytes(rng.normal(0, 1, (3, 5, 7)))
    files["line.fits"] = fits_bytes(rng.normal(0, 1, (1, 50)))
    files["column.fits"] = fits_bytes(rng.normal(0, 1, (50, 1)))
    plain = files["bits-64.fits"]
    files["one.fits.gz"] = gzip.compress(plain)
    files["two.fits.gz"] = gzip.compress(plain[:5000]) + gzip.compress(plain[5000:]) + b"\0" * 64
    good = sorted(files)
    files["broken.fits"] = b"not an image"
    files["empty.fits"] = b""
    files["short.fits"] = plain[:-4000]
    files["header.fits"] = plain[:1000]
    files["none.fits"] = fits_bytes(np.zeros((0,)), -32) [:2880]
    for name, data in files.items():
        (root / name).write_bytes(data)
    return str(root), good, files


@pytest.mark.parametrize("band_bytes", [1, 23 * 4 * 5, 1000, 1 << 20])
def test_bands_equal_whole_files(spark, images, band_bytes):
    root, good, files = images
    bands = read_bands(list_files(spark, root), band_bytes=band_bytes)
    assert bands.schema == BAND
    pixels = {}
    for r in band_pixels(bands).collect():
        pixels.setdefault(r.frame_id.rsplit("/", 1)[-1], {})[r.y, r.x] = r.v
    assert sorted(pixels) == good
    for name in good:
        image = read_image(files[name]).astype(float)
        ys, xs = np.indices(image.shape)
        expected = dict(zip(zip(ys.ravel().tolist(), xs.ravel().tolist()), image.ravel().tolist()))
        assert str(sorted(pixels[name].items())) == str(sorted(expected.items())), name
    for r in bands.filter("y IS NOT NULL").collect():
        assert r.lines == max(1, min(band_bytes // 4 // r.width, r.height - r.y)) or r.lines == r.height - r.y


def test_files_without_pixels_are_rows(spark, images):
    root, good, files = images
    found = {r.frame_id.rsplit("/", 1)[-1]: r.status for r in read_bands(list_files(spark, root)).filter("y IS NULL").collect()}
    whole = {r.frame_id.rsplit("/", 1)[-1]: r.status for r in decode_frames(scan_binary(spark, root)).collect()}
    assert set(found) == set(files) - set(good) and found.pop("empty.fits") == "ERR:not an image file"
    assert {n: whole[n] for n in found} == found


def test_layouts_read_headers_only(spark, images):
    root, good, _ = images
    rows = {r.path.rsplit("/", 1)[-1]: r for r in layouts(list_files(spark, root)).collect()}
    assert (rows["bits16.fits"].height, rows["bits16.fits"].width, rows["bits16.fits"].offset) == (37, 23, 2880)
    assert rows["second.fits"].offset == 5760 and rows["one.fits.gz"].gzipped and not rows["line.fits"].gzipped
    assert (rows["cube.fits"].height, rows["cube.fits"].width) == (15, 7)
