"""Controls made within rows, against the same made by plain loops and by windows."""

import collections
import hashlib
import random
import statistics

import pytest
from pyspark.sql import functions as F

from strandline.functions import stats
from strandline.operators import controls, validation


def md5(*parts) -> str:
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def test_selections_and_blocks_match_plain_loops(spark):
    made = random.Random(2)
    rows = [("c", m, n, made.choice([0.1, made.random()]), made.uniform(-0.1, 0.1), made.choice([None, 0.0, 1.0, 2.5])) for m in (1, 2, 3, 5) for n in range(9 if m != 5 else 2)]
    df = spark.createDataFrame(rows, "candidate string, month int, number long, score double, ret double, raw double").repartition(3)
    months = controls.month_arrays(df, ["candidate"], F.col("raw")).withColumns({"top_n": F.lit(4), "is_on": F.col("month") != 2})
    got = {(r.run, r.month): r.excess for r in controls.selections(months, ["candidate"], 5, 11).collect()}
    for run in range(6):
        for m in (1, 2, 3, 5):
            own = [r for r in rows if r[1] == m]
            order = sorted(own, key=lambda r: (-r[3], r[2]) if run == 0 else (md5(11, run, m, r[2]), r[2]))[:4]
            total = sum(r[5] or 0.0 for r in order)
            parts = [(r[5] or 0.0) / total if total else 1 / len(order) for r in order]
            want = sum(p * r[4] for p, r in zip(parts, order, strict=True)) * len(order) / 4 - statistics.fmean(r[4] for r in own)
            assert got.pop((run, m)) == pytest.approx(0.0 if m == 2 else want, abs=1e-11)
    assert not got
    series = [float(k) for k in range(11)]
    one = spark.createDataFrame([("c", series), ("e", [])], "candidate string, rets array<double>")
    runs = {r.run: r.rets for r in controls.block_orders(one, ["candidate"], F.col("candidate"), 4, 4, 17).collect()}
    for run in range(5):
        order = sorted(range(3), key=lambda k: (md5(17, run, "c", k), k)) if run else range(3)
        assert runs[run] == [x for k in order for x in series[4 * k : 4 * k + 4]]


def test_resamples_in_a_row_are_those_of_windows(spark):
    made = random.Random(3)
    rows = [(s, m, made.gauss(0.01, 0.05) if s != "flat" else 0.01) for s in ("a", "b", "flat") for m in range(20)]
    df = spark.createDataFrame(rows, "series string, month int, ret double")
    arrays = df.groupBy("series").agg(F.transform(F.array_sort(F.collect_list(F.struct("month", "ret"))), lambda x: x["ret"]).alias("rets"))
    got = {(r.series, r.resample): r.sharpe for r in validation.bootstrap_sharpes(arrays, ["series"], F.col("series"), 30, 6.0, 23).collect()}
    drawn = validation.stationary_bootstrap(df, "series", "month", "ret", 30, 6.0, 23).groupBy("series", "resample").agg(stats.sharpe(F.col("ret")).alias("sharpe"))
    want = {(r.series, r.resample): r.sharpe for r in drawn.collect()}
    assert len(got) == 90 and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(0.0 if k[0] == "flat" else want[k], abs=1e-9) for k in got)


def test_all_three_figures_must_be_as_good(spark):
    rows = [("x", 0, 1.0, 0.5, 0.1), ("x", 1, 1.0, 0.5, 0.1), ("x", 2, 2.0, 0.4, 0.2), ("y", 0, None, 0.0, 0.0), ("y", 1, -1.0, -1.0, -1.0)]
    got = {(r.control, r.run): r.passed for r in controls.passed(spark.createDataFrame(rows, "control string, run int, sharpe double, low double, deflated double"), ["control"]).collect()}
    assert collections.Counter(got.items()) == collections.Counter({("x", 0): True, ("x", 1): True, ("x", 2): False, ("y", 0): True, ("y", 1): True}.items())


def test_stages_are_found_again_and_follow_their_inputs(spark, tmp_path):
    from strandline import storage

    made = []
    spark.range(3).write.parquet(str(tmp_path / "in" / "a.parquet"))
    make = lambda: made.append(1) or spark.read.parquet(str(tmp_path / "in" / "a.parquet"))
    for _ in range(3):
        assert storage.stage(spark, str(tmp_path / "in"), "s", make).count() == 3
    storage.clear(spark)  # what later processes find again stays
    assert storage.stage(spark, str(tmp_path / "in"), "s", make).count() == 3 and len(made) == 1
    assert storage.stage(spark, str(tmp_path / "in"), "other", make).count() == 3 and len(made) == 2
    spark.range(4).write.mode("append").parquet(str(tmp_path / "in" / "a.parquet"))
    assert storage.stage(spark, str(tmp_path / "in"), "s", make).count() == 7 and len(made) == 3
    storage.clear_stages(spark)
    assert storage.stage(spark, str(tmp_path / "in"), "s", make).count() == 7 and len(made) == 4


def test_sketches_are_within_their_bound_and_merge(spark):
    rows = spark.range(60000).select((F.col("id") % 3).alias("step"), F.md5(F.col("id").cast("string")).alias("h")).select("step", (F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / 2**32).alias("equity"))
    quantiles = [0.01, 0.25, 0.5, 0.97]
    exact = {r.step: r.q for r in rows.groupBy("step").agg(F.percentile("equity", quantiles).alias("q")).collect()}
    whole = validation.path_sketches(rows, ["step"], "equity")
    halves = validation.path_sketches(rows.where("equity < 0.3"), ["step"], "equity").union(validation.path_sketches(rows.where("equity >= 0.3"), ["step"], "equity"))
    for sketches in (whole, validation.merged_sketches(halves, ["step"])):
        for r in validation.sketched_quantiles(sketches, ["step"], quantiles).collect():
            # values are uniform, so a rank's error is a value's
            assert r.n == 20000 and all(abs(a - b) < 0.01 for a, b in zip(r.q, exact[r.step], strict=True))
    every = validation.merged_sketches(whole.withColumn("all", F.lit(1)), ["all"])
    assert validation.sketched_quantiles(every, ["all"], [0.5]).first().n == 60000


def test_density_leaves_out_what_is_beyond_the_outer_quantiles(spark):
    paths = spark.createDataFrame([("c", s, v) for s in (0, 1) for v in (0.0, 1.0, 1.5, 2.0, 3.0, 4.0, 9.0)] + [("flat", 0, 5.0)], "k string, step int, v double")
    outer = spark.createDataFrame([("c", 0, 1.0, 3.0), ("c", 1, 1.5, 4.0), ("flat", 0, 5.0, 5.0)], "k string, step int, low double, high double")
    got = {(r.k, r.step, r.bin): r.n for r in validation.path_density(paths, outer, ["k"], "step", "v", 3).collect()}
    assert got == {("c", s, b): n for s in (0, 1) for b, n in ((0, 2), (1, 1), (2, 2))} | {("flat", 0, 0): 1}
