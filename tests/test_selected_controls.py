"""Shuffled controls on months of many names: what is held at a time doesn't grow with names times runs."""

import hashlib
import os
import random
import statistics
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strandline.operators import controls

ROOT = Path(__file__).resolve().parents[1]
MONTHS = {1: 2000, 2: 700, 3: 4, 4: 0, 5: 900, 6: 30}


def tables(spark, top_n: int):
    made = random.Random(4)
    rows = [("c", m, n, made.choice((0.1, made.random())), made.uniform(-0.1, 0.1), made.choice((None, 0.0, 1.0, 2.5))) for m, names in MONTHS.items() for n in range(names)]
    df = spark.createDataFrame(rows, "candidate string, month int, number long, score double, ret double, raw double").repartition(3)
    return rows, df, spark.createDataFrame([("c", m, top_n, m != 5) for m in MONTHS], "candidate string, month int, top_n int, is_on boolean")


def wanted(rows, run: int, month: int, top_n: int) -> float:
    own = [r for r in rows if r[1] == month]
    if month == 5 or not own:
        return 0.0
    order = sorted(own, key=lambda r: (-r[3], r[2]) if run == 0 else (hashlib.md5(f"11:{run}:{month}:{r[2]}".encode()).hexdigest(), r[2]))[:top_n]
    total = sum(r[5] or 0.0 for r in order)
    parts = [(r[5] or 0.0) / total if total else 1 / len(order) for r in order]
    return sum(p * r[4] for p, r in zip(parts, order, strict=True)) * len(order) / top_n - statistics.fmean(r[4] for r in own)


@pytest.mark.parametrize("spare", [32, 0, -7])
def test_selected_books_match_plain_loops_also_where_a_bound_leaves_too_few(spark, monkeypatch, spare):
    monkeypatch.setattr(controls, "SPARE", spare)
    monkeypatch.setattr(controls, "SPARE_ROOTS", 8 if spare > 0 else 0)
    rows, df, months = tables(spark, 7)
    got = {(r.run, r.month): r.excess for r in controls.selected(df, months, ["candidate"], 9, 11).collect()}
    assert len(got) == 10 * len(MONTHS)
    for (run, month), excess in got.items():
        assert excess == pytest.approx(wanted(rows, run, month, 7), abs=1e-11), (run, month)


def test_few_rows_of_a_run_are_grouped_whatever_the_universe(spark):
    _, df, months = tables(spark, 7)
    counted = months.join(df.groupBy("month").agg(F.count("*").alias("n")), "month")
    many = {(r.run, r.month): r["count"] for r in controls.beginnings(df, counted, ["candidate"], 40, 11).groupBy("run", "month").count().collect()}
    assert {m for _, m in many} == {1, 2, 3, 6} and all(many[run, 3] == 4 for run in range(41))
    assert all(7 <= n < 130 for (run, m), n in many.items() if run > 0 and m in (1, 2))


def test_a_large_month_and_all_its_runs_fit_a_small_heap():
    code = """
from pyspark.sql import SparkSession, functions as F
from strandline.operators import controls
spark = SparkSession.builder.master("local[2]").config("spark.driver.memory", "512m").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
rows = spark.range(60000).select(F.lit("c").alias("candidate"), F.lit(1).alias("month"), F.col("id").alias("number"), (F.col("id") % 997 / 997.0).alias("score"), (F.col("id") % 89 / 89.0 - 0.5).alias("ret"))
months = controls.month_arrays(rows, ["candidate"], F.lit(1.0)).withColumns({"top_n": F.lit(10), "is_on": F.lit(True)})
print("runs", len([r.excess for r in controls.selections(months, ["candidate"], 200, 11).collect()]))
spark.stop()
"""
    env = {**os.environ, "PYTHONPATH": f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300, check=False)
    assert "runs 201" in done.stdout, done.stderr[-2000:]
