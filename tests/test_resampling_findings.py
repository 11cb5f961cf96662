"""Small tests of what a review of the market operators found missing."""

import inspect
import math
import random

from pyspark.sql import functions as F

from strandline.operators import validation
from strandline.plans import queries, research


def test_overfitting_takes_the_slices_that_fit(spark):
    made = random.Random(4)
    for n, want in ((120, 10), (72, 8), (36, 6), (67, 10), (37, 6), (10, None)):
        rows = [(c, m, made.gauss(0, 0.1)) for c in "ab" for m in range(n)]
        got = validation.overfitting(spark.createDataFrame(rows, "candidate_id string, month int, net double")).count()
        assert got == (math.comb(want, want // 2) if want else 0)


def test_bootstrap_paths_end_apart(spark, monkeypatch):
    assert inspect.signature(validation.sharpe_interval).parameters["resamples"].default == research.RESAMPLES == 2000
    made = random.Random(6)
    rows = [("a", m, made.gauss(0, 0.1)) for m in range(24)]
    monkeypatch.setattr(research, "backtest", lambda *_: spark.createDataFrame(rows, "candidate_id string, month int, net double"))
    last = queries.queries()["bootstrap_path_quantiles"](spark, "").where("step = 23").first()
    assert last.p05 < last.p50 < last.p95  # a path that is only reordered ends where all end
    n = queries.queries()["bootstrap_path_density"](spark, "").groupBy("step").agg(F.sum("n").alias("n")).collect()
    assert {r.n for r in n} == {2000}
    caps = queries.queries()["bootstrap_projection"](spark, "").first()
    assert caps.low_cap < caps.last_equity < caps.high_cap
