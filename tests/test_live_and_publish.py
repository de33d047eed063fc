"""Live triplets, ingestion from manifests, runs published by pointer, buckets, and the pattern index."""

import itertools
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F, types as T

from framelake import schemas
from framelake.functions import naming
from framelake.functions.pattern_index import classify_by_index, literals
from framelake.operators import aggregates
from framelake.plans import medallion
from framelake.registry.live import live_triplet_rows
from framelake.sources import sinks, tables
from framelake.sources.manifest import MANIFEST, list_files
from framelake.streaming import live
from framelake.streaming.triplets import live_triplets
from framelake.workspace import run_folder
from tests.helpers import fits_bytes, golden_image

ARRIVING = schemas.with_fields(schemas.BRONZE, came=T.TimestampType())


def bronze_row(name, kind, minute, path=None, median=1.0, status="SUCCESS"):
    return (path or f"/raw/{name}_{kind.lower()}.fits", name, kind, median, 0.5, 2.0, 3, status, minute)


def bronze_frame(spark, rows):
    df = spark.createDataFrame(rows, "file_path string, object_id string, image_type string, median_bg double, mean_sub double, "
                                     "std_sub double, bright_pixels int, status string, minute int")
    stamped = df.withColumn("came", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("minute") * 60))
    return stamped.select(*[F.col(f.name).cast(f.dataType) for f in ARRIVING])


class Stream:
    """Bronze rows that arrive in drops; each drop is a run of the stream from its checkpoint."""

    def __init__(self, spark, root):
        self.spark, self.folder, self.root = spark, f"{root}/in", root

    def drop(self, rows, **options):
        bronze_frame(self.spark, rows).coalesce(1).write.mode("append").parquet(self.folder)
        return live_triplets(live.stream_parquet(self.spark, self.folder, ARRIVING, 1), "came", f"{self.root}/out", f"{self.root}/state", **options)


def test_any_order_and_restart_gives_the_batch_silver(spark, tmp_path):
    rows = [bronze_row(name, kind, i, median=float(i)) for i, (name, kind) in enumerate(
        itertools.product("abcd", ["SCIENCE", "TEMPLATE", "DIFFERENCE"]))]
    rows += [bronze_row("e", "SCIENCE", 3), bronze_row("e", "TEMPLATE", 4), bronze_row("a", "UNKNOWN", 5),
             bronze_row("e", "DIFFERENCE", 6, status="ERR:AllNaN")]
    batch = {tuple(r) for r in medallion.silver(bronze_frame(spark, rows)).collect()}
    random.Random(1).shuffle(rows)
    stream = Stream(spark, tmp_path)
    for at in range(0, len(rows), 4):
        out = stream.drop(rows[at:at + 4])
    found = out.filter("state = 'complete'")
    assert {tuple(r)[:-2] for r in found.collect()} == batch and found.count() == 4 and out.count() == 4
    assert found.columns[:-2] == medallion.silver(bronze_frame(spark, rows)).columns


def test_objects_are_handed_over_once(spark, tmp_path):
    stream = Stream(spark, tmp_path)
    whole = [bronze_row("a", kind, 1) for kind in schemas.IMAGE_TYPES]
    twice = bronze_row("a", "SCIENCE", 1, path="/raw/0.fits", median=9.0)
    assert stream.drop([*whole[:1], twice, *whole[1:]]).first().SCIENCE_median_bg == 9.0  # the lower path counts
    assert stream.drop(whole).count() == 1 and stream.drop([twice]).count() == 1


def test_incomplete_objects_time_out(spark, tmp_path):
    stream = Stream(spark, tmp_path)
    options = dict(delay="10 minutes", keep_hours=1.0)
    stream.drop([bronze_row("a", "SCIENCE", 0), bronze_row("a", "DIFFERENCE", 5), bronze_row("b", "SCIENCE", 0)], **options)
    stream.drop([bronze_row("b", "TEMPLATE", 50)], **options)
    out = stream.drop([bronze_row("z", "SCIENCE", 100)], **options)  # the watermark passes the hour of object a only
    found = {r.object_id: r for r in out.collect()}
    assert set(found) == {"a"} and (found["a"].state, found["a"].missing) == ("incomplete", "TEMPLATE")
    assert (found["a"].SCIENCE_median_bg, found["a"].TEMPLATE_median_bg, found["a"].SCIENCE_bright_pixels) == (1.0, None, 3)
    out = stream.drop([bronze_row("b", "DIFFERENCE", 101), bronze_row("c", "SCIENCE", 101, median=float("nan"))], **options)
    assert {(r.object_id, r.state) for r in out.collect()} == {("a", "incomplete"), ("b", "complete")}
    out = stream.drop([bronze_row("c", "TEMPLATE", 102), bronze_row("c", "DIFFERENCE", 102)], **options)
    assert {(r.object_id, r.state, r.missing) for r in out.collect()} == {
        ("a", "incomplete", "TEMPLATE"), ("b", "complete", ""), ("c", "incomplete", "SCIENCE")}


def test_a_part_is_one_batch_however_many_files_it_has(spark, tmp_path):
    frames = spark.range(0, 240, 1, 12).selectExpr("id AS vec_id", "transform(sequence(0, 63), x -> cast((x * 7 + id) % 11 AS float)) AS embedding")
    frames.write.parquet(f"{tmp_path}/embeddings.parquet")
    found = live_triplet_rows(spark, str(tmp_path))
    newest = max(Path(run_folder(spark)).glob("triplets-checkpoint-*"), key=lambda p: p.stat().st_mtime)
    assert found.count() == 80
    # Two runs of two parts each; a run may end with a batch without rows, for what has timed out.
    assert 4 <= sum(p.name.isdigit() for p in (newest / "commits").iterdir()) <= 6


def test_a_file_listed_twice_is_one_row(spark, tmp_path):
    raw, folder = tmp_path / "raw", f"{tmp_path}/manifest"
    raw.mkdir()

    def listed():
        list_files(spark, [str(raw), f"{raw}/gone"]).coalesce(1).write.mode("append").parquet(folder)
        return live.live_manifest_ingest(live.stream_parquet(spark, folder, MANIFEST, 1), f"{tmp_path}/bronze", f"{tmp_path}/state")

    (raw / "1_science.fits").write_bytes(fits_bytes(golden_image()))
    assert listed().count() == 1
    (raw / "2_science.fits").write_bytes(b"broken")
    (raw / "3_template.fits").write_bytes(fits_bytes(golden_image()))
    listed()
    rows = listed()
    batch = medallion.bronze(tables.scan_binary(spark, str(raw)))
    assert sorted(map(str, rows.collect())) == sorted(map(str, batch.collect())) and rows.count() == 3
    # The stream's log names manifest files; no image is a source file of it.
    assert "science" not in "".join(p.read_text(errors="ignore") for p in (tmp_path / "state" / "sources").rglob("*") if p.is_file())


# Published runs ---------------------------------------------------------------------------------

def test_readers_follow_the_pointer(spark, tmp_path):
    base = f"{tmp_path}/features"
    assert sinks.current_run(spark, base) is None and sinks.published_runs(spark, base).collect() == []
    folders = [sinks.publish_run(spark.range(n), base, f"r{n}") for n in (3, 5)]
    assert sinks.current_run(spark, base) == folders[1] and spark.read.parquet(folders[0]).count() == 3
    assert [tuple(r)[:2] for r in sinks.published_runs(spark, base).orderBy("sequence").collect()] == [(1, "r3"), (2, "r5")]
    again = sinks.publish_run(spark.range(7), base, "r5", lambda df, path: sinks.sink_csv(df, path))
    assert sinks.current_run(spark, base) == again != folders[1] and spark.read.parquet(folders[1]).count() == 5


@pytest.mark.parametrize("step", ["before data", "within data", "after data", "pointer"])
def test_a_failure_leaves_the_old_run(spark, tmp_path, monkeypatch, step):
    base = f"{tmp_path}/features"
    old = sinks.publish_run(spark.range(3), base, "old")
    before = {str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*")}

    def write(df, path):
        if step == "before data":
            raise RuntimeError(step)
        if step == "within data":
            df = df.select(F.when(F.col("id") == 4, F.raise_error(F.lit(step))).otherwise(F.col("id").cast("string")).alias("id"))
        sinks.sink_parquet(df, path)
        if step == "after data":
            raise RuntimeError(step)

    if step == "pointer":
        monkeypatch.setattr(sinks, "published_runs", lambda *a: (_ for _ in ()).throw(RuntimeError(step)))
    with pytest.raises(Exception):
        sinks.publish_run(spark.range(5), base, "new", write)
    monkeypatch.undo()
    assert sinks.current_run(spark, base) == old and spark.read.parquet(old).count() == 3
    assert before <= {str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*")}  # nothing was moved or deleted
    assert sinks.current_run(spark, base) != sinks.publish_run(spark.range(5), base, "new") == sinks.current_run(spark, base)


def test_pivot_where_the_buckets_lie(spark, tmp_path):
    rows = [(f"o{i % 40}", kind, float(i), i) for i in range(400) for kind in ("A", "B")]
    df = spark.createDataFrame(rows, "k string, kind string, m double, place int")
    stored = sinks.sink_buckets(df, "bucketed_rows", f"{tmp_path}/b", "k", 4)
    pivot = lambda d: aggregates.silver_triplets(d, "k", "kind", ["A", "B"], ["m"], "place")
    plan = pivot(stored)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Exchange" in pivot(df)._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, pivot(stored).collect())) == sorted(map(tuple, pivot(df).collect()))


# Pattern index ----------------------------------------------------------------------------------

@pytest.mark.parametrize("pattern,expected", [
    (r"_science\.fits$", ["_science.fits"]), (r"^HSCA.*\.fits$", [".fits", "HSCA"]), (r"[0-9]{6}_x", ["_x"]), (r"ab?c", ["a", "c"]),
    (r"ab+c", ["ab", "c"]), (r"a|b", []), (r"x(a|b)y", ["x", "y"]), (r"(?i)abc", []), (r"a\d\.b", [".b", "a"]), (r"a{2}b", ["b"]),
    (r"[]a]z", ["z"]), (r"", []), (r"x*", []), (r"\Qa.b\E", []), (r"q[a[bc]]w", ["q", "w"]), (r"(ab)+c", ["c"]), (r"a\{b", ["a{b"]),
])
def test_literals(pattern, expected):
    assert literals(pattern) == expected


def test_index_equals_the_chain(spark):
    rng = random.Random(5)
    words = ["sci", "tmpl", "diff", "raw", "cal", "ccd", "vis", "exp"]
    rules = []
    for i in range(1000):
        a, b = rng.choice(words), rng.choice(words)
        rules.append((f"K{i}", rng.choice([
            rf"_{a}{i:03d}\.fits$", rf"^{a}[0-9]+_{b}{i % 50}", rf"{a}.*{i:03d}", rf"({a}|{b})_{i % 97}$", rf"^[a-z]{{3}}{i:03d}",
            rf"{a}|{b}{i}", rf"{a}_?{i:03d}", rf"\d{{4}}{a}x{i % 7}"])))
    names = [f"/raw/{rng.choice(words)}{rng.randrange(1000):03d}_{rng.choice(words)}{rng.randrange(1200)}{rng.choice(['.fits', '', '.gz'])}" for _ in range(400)]
    rows = [(n,) for n in names] + [("",), (None,), ("/a/",), ("plain",)]
    df = spark.createDataFrame(rows, "path string")
    chain = [(k, re.compile(p)) for k, p in rules]
    expected = [next((k for k, p in chain if p.search((n or "").rsplit("/", 1)[-1])), "UNKNOWN") for (n,) in rows]
    found = [r[0] for r in df.coalesce(1).select(classify_by_index("path", rules)).collect()]
    assert found == ["UNKNOWN" if n is None else e for (n,), e in zip(rows, expected)]
    few = rules[:40]
    both = df.select(classify_by_index("path", few).alias("a"), naming.classify_by_patterns("path", few).alias("b"))
    assert both.filter("a <> b").count() == 0
    assert {r[0] for r in df.select(classify_by_index("path", [])).collect()} == {"UNKNOWN"}
