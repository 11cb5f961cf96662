"""Schedules, returns between entry days and deflated Sharpe ratios on small tables."""

import math
import random
import statistics
from datetime import date

from pyspark.sql import functions as F

from strandline.functions import stats
from strandline.operators import cadence


def test_periods(spark):
    days = spark.createDataFrame([(date(2021, 1, d),) for d in (1, 4, 5, 8, 11, 29)] + [(date(2021, 2, 1),), (date(2021, 2, 26),)], "date date")
    got = cadence.schedule(days)
    assert {(r.cadence, r.date.isoformat()) for r in got.where("cadence in ('month', 'quarter')").collect()} == {("month", "2021-01-29"), ("month", "2021-02-26"), ("quarter", "2021-02-26")}
    assert [r.date.isoformat() for r in got.where("cadence = 'week'").orderBy("date").collect()] == ["2021-01-01", "2021-01-08", "2021-01-11", "2021-01-29", "2021-02-01", "2021-02-26"]
    spans = cadence.periods(days, got.where("cadence = 'week'")).orderBy("period").collect()
    assert [(s.period, s.entry_date.day, s.exit_date.day) for s in spans] == [(0, 4, 11), (1, 11, 29), (2, 29, 1), (3, 1, 26)]


def test_offset_schedule(spark):
    days = spark.createDataFrame([(date(2021 + k // 12, k % 12 + 1, d),) for k in range(18) for d in (3, 17, 26) if k != 7], "date date")  # no day in August 2021
    got = {}
    for r in cadence.offset_schedule(days).collect():
        got.setdefault(r.cadence, set()).add(r.date)
    assert set(got) == {f"quarter-{k}" for k in range(3)} | {f"half-{k}" for k in range(6)}
    for name, length in (("quarter", 3), ("half", 6)):
        for k in range(length):
            assert got[f"{name}-{k}"] == {date(2021 + m // 12, m % 12 + 1, 26) for m in range(18) if m != 7 and (m % 12 + 1) % length == (length - k) % length}
    assert cadence.offset_schedule(days.limit(0)).count() == 0


def test_holding_returns_and_books(spark):
    spans = spark.createDataFrame([("week", 0, date(2021, 1, 1), date(2021, 1, 4), date(2021, 1, 11))], "cadence string, period int, rebalance_date date, entry_date date, exit_date date")
    rows = [(1, 4, 10.0, 9.0), (1, 11, 12.0, 1.0), (2, 4, 10.0, 9.0), (2, 5, 8.0, 8.0), (3, 5, 1.0, 1.0), (3, 11, 2.0, 2.0), (4, 4, 0.0, 5.0), (4, 11, 2.0, 2.0), (5, 4, 10.0, None), (5, 11, None, None)]
    daily = spark.createDataFrame([(n, date(2021, 1, d), o, c) for n, d, o, c in rows], "number long, date date, open_sek double, close_sek double")
    names = daily.select("number").distinct()
    got = {r.number: r.ret for r in cadence.holding_returns(names, spans, daily).collect()}
    assert set(got) == {1, 2, 5} and got[5] is None
    assert abs(got[1] - 0.2) < 1e-12 and abs(got[2] - (8 * 0.7 / 10 - 1)) < 1e-12
    scored = spark.createDataFrame([("week", 0, n, s, r) for n, s, r in ((1, 1.0, 0.1), (2, 1.0, 0.2), (3, None, 0.3), (4, 2.0, None), (5, 0.5, 0.0))], "cadence string, period int, number long, score double, ret double")
    book = cadence.books(scored, spark.createDataFrame([(2,), (5,)], "top_n int")).collect()
    assert {(b.candidate_id, b.number, b.weight) for b in book} == {("week_n2", 1, 0.5), ("week_n2", 2, 0.5), ("week_n5", 1, 0.2), ("week_n5", 2, 0.2), ("week_n5", 5, 0.2)}
    assert cadence.holding_returns(names, spans, daily.limit(0)).count() == 0


def test_normal_cdf(spark):
    xs = [-40.0, -6.9, -3.0, -1e-9, 0.0, 0.5, 1.96, 5.0, 40.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", stats.normal_cdf(F.col("x")).alias("p")).collect()
    assert all(abs(r.p - statistics.NormalDist().cdf(r.x)) < 1e-13 for r in got)


def test_deflated(spark):
    made, trials = random.Random(5), 36
    own = {"a": [made.gauss(0.02, 0.05) for _ in range(40)], "flat": [0.01] * 5, "short": [0.1, 0.2]}
    rows = spark.createDataFrame([(k, r) for k, rs in own.items() for r in [*rs, None]], "c string, r double")
    got = {r.c: r for r in stats.deflated(rows, ["c"], "r", trials).collect()}
    assert tuple(got["flat"])[1:] == tuple(got["short"])[1:] == (0.0, 0.0, 0.0)
    rs, normal = own["a"], statistics.NormalDist()
    m, s, n = statistics.fmean(rs), statistics.stdev(rs), len(rs)
    k3, k4 = (sum(((r - m) / s) ** p for r in rs) / n for p in (3, 4))
    deviation = math.sqrt(max(1 - k3 * m / s + (k4 - 1) / 4 * (m / s) ** 2, 1e-12) / (n - 1))
    noise = deviation * ((1 - 0.5772156649) * normal.inv_cdf(1 - 1 / trials) + 0.5772156649 * normal.inv_cdf(1 - 1 / (trials * math.e)))
    assert abs(got["a"].expected_max_noise_sharpe - noise) < 1e-12 and abs(got["a"].score - (m / s - noise)) < 1e-9
    assert abs(got["a"].probability - normal.cdf((m / s - noise) / deviation)) < 1e-9
    assert stats.expected_maximum(1) == 0.0
