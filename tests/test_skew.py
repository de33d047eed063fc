"""The plans for oversized groups give what the plain plans give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import aggregates, history, labeling, skew
from tests.helpers import brute_components

SMALL = 40


@pytest.fixture(scope="module")
def skewed(spark):
    """Group 0 and a null group hold most rows; values repeat; ids are unique."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(1200):
        group = None if i % 11 == 0 else 0 if i % 3 else int(i % 25)
        value = float(rng.integers(0, 30)) / 4 if i % 13 else None
        rows.append((group, i, int(rng.integers(0, 100)), value))
    return spark.createDataFrame(rows, "g int, id int, t int, v double").repartition(6)


def rows_of(df):
    return sorted((tuple(str(v) for v in row) for row in df.collect()))


def test_split_keeps_every_row_once(skewed):
    split = skew.split_hot(skewed, ["g"], SMALL)
    assert split.slices > 10 and rows_of(split.cold.union(split.hot)) == rows_of(skewed)
    assert {r[0] for r in split.hot.select("g").distinct().collect()} >= {0, None}


def test_no_hot_group_leaves_the_plan_alone(skewed):
    split = skew.split_hot(skewed, ["g"])
    assert split.hot is None and split.cold is skewed


@pytest.mark.parametrize("before,current", [(9, True), (5, False), (1, False)])
@pytest.mark.parametrize("keys", [["g"], []])
def test_rolling(skewed, keys, before, current):
    columns = {
        "s": lambda w: F.sum("id").over(w), "c": lambda w: F.count(F.lit(1)).over(w),
        "first_id": lambda w: F.first("id").over(w),
    }
    plain = skew.rolling(skewed, keys, ["t", "id"], before, columns, current)
    sliced = skew.rolling(skewed, keys, ["t", "id"], before, columns, current, max_group_rows=SMALL)
    assert rows_of(plain) == rows_of(sliced)


def test_running_number(skewed):
    plain = skew.running_number(skewed, ["g"], ["t", "id"], "n")
    assert rows_of(plain) == rows_of(skew.running_number(skewed, ["g"], ["t", "id"], "n", SMALL))


def test_group_medians(skewed):
    plain = skew.group_medians(skewed, ["g"], "v")
    assert rows_of(plain) == rows_of(skew.group_medians(skewed, ["g"], "v", max_group_rows=SMALL))


def test_median_of_a_hot_group_without_values(skewed):
    bare = skewed.withColumn("v", F.when(F.col("g").isNotNull(), F.col("v")))
    plain = skew.group_medians(bare, ["g"], "v")
    assert rows_of(plain) == rows_of(skew.group_medians(bare, ["g"], "v", max_group_rows=SMALL))


def test_long_frame_stats(skewed):
    digits = lambda df: df.withColumns({c: F.round(c, 9) for c in ("mean_sub", "std_sub")})
    plain = digits(skew.long_frame_stats(skewed, ["g"], "v"))
    assert rows_of(plain) == rows_of(
        digits(skew.long_frame_stats(skewed, ["g"], "v", max_group_rows=SMALL))
    )


def test_no_keys_on_both_sides(skewed):
    for limit in (skew.MAX_GROUP_ROWS, SMALL):
        median = skew.group_medians(skewed, [], "v", max_group_rows=limit).collect()
        values = [r["v"] for r in skewed.collect() if r["v"] is not None]
        assert [r["median"] for r in median] == [pytest.approx(np.median(values))]
        stats = skew.long_frame_stats(skewed, [], "v", limit).collect()
        sub = np.array(values) - np.median(values)
        assert len(stats) == 1 and stats[0]["n_valid"] == len(values)
        assert stats[0]["std_sub"] == pytest.approx(sub.std())


def test_many_hot_keys(spark):
    rows = spark.range(0, 600).selectExpr("id div 3 as g", "id % 3 as v")
    out = skew.group_medians(rows, ["g"], "v", max_group_rows=2)
    assert out.agg(F.count(F.lit(1)), F.min("median"), F.max("median")).first() == (200, 1.0, 1.0)


def test_rounds_of_a_long_chain(spark, monkeypatch):
    """Parts in raster order, each touching the next: rounds follow the logarithm."""
    tables = []
    plain = labeling.materialize
    monkeypatch.setattr(labeling, "materialize", lambda df, label: tables.append(label) or plain(df, label))
    pairs = spark.range(1000).selectExpr("'a' as k", "id as _low", "id + 1 as _high")
    roots = labeling._merge_in_rounds(pairs, ["k"]).collect()
    assert len(roots) == 1001 and {r["_root"] for r in roots} == {0} and len(tables) < 25


def test_long_frame_stats_matches_numpy(spark):
    rng = np.random.default_rng(3)
    data = {k: rng.normal(100, 5, 500 + k) for k in range(3)}
    data[1][:4] = [400, np.nan, np.inf, -np.inf]
    rows = [(k, float(v)) for k, values in data.items() for v in values]
    df = spark.createDataFrame(rows, "k int, v double")
    for limit in (skew.MAX_GROUP_ROWS, 50):
        for row in skew.long_frame_stats(df, ["k"], "v", limit).collect():
            good = data[row["k"]][np.isfinite(data[row["k"]])]
            sub = good - np.median(good)
            assert row["n_valid"] == good.size
            assert row["median_bg"] == pytest.approx(np.median(good))
            assert row["mean_sub"] == pytest.approx(sub.mean())
            assert row["std_sub"] == pytest.approx(sub.std())
            assert row["bright_pixels"] == (sub > sub.mean() + 3 * sub.std()).sum()


def test_history_on_hot_groups(skewed):
    jobs = skewed.withColumns({"files": F.col("id") + 1, "seconds": F.col("t") / 10})
    args = (["g"], ["t", "id"], "files", "seconds")
    assert rows_of(history.rolling_throughput(jobs, *args)) == rows_of(
        history.rolling_throughput(jobs, *args, max_group_rows=SMALL)
    )


def test_scaling_steps_sliced(spark):
    sizes = spark.createDataFrame([(n, 10.0 * n**0.9) for n in range(1, 200)], "n int, thr double")
    plain = history.scaling_steps(sizes, "n", "thr")
    assert plain.count() == 198
    assert rows_of(plain) == rows_of(history.scaling_steps(sizes, "n", "thr", max_group_rows=SMALL))


@pytest.mark.parametrize("density,limit", [(0.2, 10**6), (0.45, 10**6), (0.45, 60), (0.7, 60)])
def test_tiled_labels_match_flood_fill(spark, density, limit):
    rng = np.random.default_rng(int(density * 100))
    masks = {k: rng.random((23, 31)) < density for k in range(3)}
    rows = [(k, int(y), int(x)) for k, m in masks.items() for y, x in zip(*np.nonzero(m))]
    pixels = spark.createDataFrame(rows, "k int, y int, x int")
    found = labeling.label_pixels(pixels, ["k"], 5, limit).collect()
    assert len(found) == len(rows)
    for key, mask in masks.items():
        regions = {}
        for row in found:
            if row["k"] == key:
                regions.setdefault(row["source"], set()).add((row["y"], row["x"]))
        ordered = [regions[s] for s in sorted(regions)]
        assert ordered == [set(region) for region in brute_components(mask)]


@pytest.mark.parametrize("limit", [10**6, 10])
def test_tiled_labels_of_a_snake(spark, limit):
    """One thin region that crosses the tiles many times."""
    mask = np.zeros((24, 24), bool)
    mask[::2] = True
    for row in range(1, 24, 4):
        mask[row, -1] = True
    for row in range(3, 24, 4):
        mask[row, 0] = True
    rows = [(int(y), int(x)) for y, x in zip(*np.nonzero(mask))]
    pixels = spark.createDataFrame(rows, "y int, x int").withColumn("k", F.lit("a"))
    found = labeling.label_pixels(pixels, ["k"], 4, limit)
    assert found.select("source").distinct().count() == 1


def test_pivot_picks_one_row_per_kind(spark):
    rows = [("a", "X", "2", 5.0, None), ("a", "X", "1", None, 7), ("a", "Y", "3", 1.0, 2),
            ("a", "Z", "0", 9.0, 9), ("b", "X", "1", 2.0, 3)]
    df = spark.createDataFrame(rows, "k string, kind string, path string, m double, n int")
    out = {r["k"]: r for r in aggregates.pivot_first(df, "k", "kind", ["X", "Y"], ["m", "n"], "path").collect()}
    assert (out["a"]["X_m"], out["a"]["X_n"], out["a"]["Y_m"]) == (None, 7, 1.0)
    assert out["b"]["Y_m"] is None
    lost = spark.createDataFrame([("k", "A", None, 1.0), ("k", "A", 3, 2.0), ("j", "A", None, 5.0)], "k string, kind string, n int, m double")
    for tie in (F.col("n"), F.col("n").cast("string"), F.col("n").cast("double")):
        out = aggregates.pivot_first(lost.withColumn("n", tie), "k", "kind", ["A"], ["m"], "n").collect()
        assert {r["k"]: r["A_m"] for r in out} == {"k": 2.0, "j": 5.0}
    kept = aggregates.silver_triplets(df, "k", "kind", ["X", "Y"], ["n"], "path").collect()
    assert [tuple(r) for r in kept] == [("a", 7, 2)]


def test_pivot_by_numbers_of_every_type(spark):
    """Ties are broken in the tie-break's own type; nulls come last; a metric is never taken from another row."""
    rows = [("a", "X", 1.70, 10.0, None), ("a", "X", 1.20, 20.0, 1), ("b", "X", None, 5.0, 2), ("b", "X", 9.5, None, 3), ("c", "X", None, 7.0, 4)]
    df = spark.createDataFrame(rows, "k string, kind string, p double, m double, n int")
    for kind in ("decimal(10,2)", "decimal(38,10)", "double", "float", "string"):
        for shuffled in (df, df.orderBy(F.desc("m")), df.repartition(5)):
            out = aggregates.pivot_first(shuffled.withColumn("p", F.col("p").cast(kind)), "k", "kind", ["X", "Y"], ["m", "n"], "p")
            assert {r.k: (r.X_m, r.X_n, r.Y_m) for r in out.collect()} == {"a": (20.0, 1, None), "b": (None, 3, None), "c": (7.0, 4, None)}
    far = df.withColumn("p", F.expr("CAST(90000000000000000000 AS DECIMAL(38, 2))") + F.col("p").cast("decimal(10,2)"))
    plan = aggregates.pivot_first(far, "k", "kind", ["X"], ["m"], "p")
    assert {r.k: r.X_m for r in plan.collect()} == {"a": 20.0, "b": None, "c": 7.0}
    assert "SortAggregate" not in plan._jdf.queryExecution().executedPlan().toString()


def test_best_and_worst_of_runs_without_throughput(spark):
    nan = float("nan")
    rows = [(1, 5.0, 2.0, "p1", "t1"), (1, nan, 4.0, "p2", "t0"), (1, None, 6.0, "p3", "t2"), (1, 5.0, 8.0, "p4", "t0"),
            (2, nan, 1.0, "p5", "t1"), (2, None, 1.0, "p6", "t2"), (3, 1.0, 1.0, "p7", "t1"), (None, 2.0, 1.0, "p8", "t1"), (None, 4.0, 3.0, "p9", "t2")]
    df = spark.createDataFrame(rows, "size int, thr double, sec double, conf string, at string")
    out = {r["size"]: r for r in aggregates.best_worst_by_group(df, "size", "thr", "sec", ["conf"], ["at"]).collect()}
    assert set(out) == {1, 2, None}
    one = out[1]
    assert (one.num_configurations_tested, one.best_throughput, one.worst_throughput, one.best_conf, one.worst_conf) == (4, 5.0, 5.0, "p4", "p4")
    assert (one.throughput_variance, one.avg_execution_time, one.speedup_factor) == (0.0, 5.0, 1.0)
    assert (out[2].best_throughput, out[2].best_conf, out[2].num_configurations_tested) == (None, None, 2)
    assert (out[None].best_conf, out[None].worst_conf, out[None].speedup_factor) == ("p9", "p8", 2.0)


def test_rolling_with_equal_orders(spark):
    """Rows that the order leaves equal stand alike in the plain and the sliced plan, in every partitioning."""
    df = spark.range(400).selectExpr("id % 2 as g", "id div 40 as t", "(id * 7919) % 101 as v")
    results = []
    for limit in (skew.MAX_GROUP_ROWS, SMALL, 7):
        for parts in (1, 6):
            made = skew.rolling(df.repartition(parts), ["g"], ["t"], 3, {"s": lambda w: F.sum("v").over(w)}, max_group_rows=limit)
            assert made.columns == ["g", "t", "v", "s"]
            results.append(rows_of(made))
    assert all(r == results[0] for r in results)
    numbered = [rows_of(skew.running_number(df, ["g"], ["t"], "n", max_group_rows=m)) for m in (skew.MAX_GROUP_ROWS, 7)]
    assert numbered[0] == numbered[1]


def test_input_of_hot_groups_runs_once_more(spark):
    """Beyond the count of keys the input runs once, also with hot groups."""
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    df = spark.range(0, 300, 1, 3).selectExpr("id % 2 as g", "id as t", "id as v").mapInArrow(counted, "g long, t long, v long")
    skew.rolling(df, ["g"], ["t"], 3, {"s": lambda w: F.sum("v").over(w)}, max_group_rows=40).collect()
    assert runs.value == 2 * 300
