"""Operators on small tables, against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import stats, text
from strandline.operators import portfolio, validation
from strandline.operators.asof import asof_join, asof_lookup
from strandline.plans import queries
from strandline.sources import files
from strandline.streaming import ticks


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("exact", [False, True])
def test_asof_joins(spark, forward, exact):
    made = random.Random(2)
    left = [(k, made.randrange(3), made.randrange(30)) for k in range(80)] + [(80, 9, 5)]
    right = [(c, t, f"{c}-{t}") for c in range(3) for t in made.sample(range(30), 8)]
    one, two = spark.createDataFrame(left, "id int, c int, t int"), spark.createDataFrame(right, "c int, t int, v string")

    def best(c, t):
        own = [(x, v) for k, x, v in right if k == c and ((x == t and exact) or (x > t if forward else x < t))]
        return (min(own) if forward else max(own))[1] if own else None

    want = {k: best(c, t) for k, c, t in left}
    how = {"forward": forward, "exact": exact}
    assert {r.id: r.v for r in asof_join(one, two, ["c"], "t", ["v"], **how).collect()} == want
    assert {r.id: r.v for r in asof_lookup(one, two, ["c"], "t", ["v"], **how).collect()} == want


def test_names(spark):
    df = spark.createDataFrame([("Åkerö Holding AB (publ) ser. B",), ("Smith & Co Ltd",), ("AB",), (None,)], "n string")
    got = [tuple(r) for r in df.select(text.issuer_group(F.col("n")), text.company_key(F.col("n")), text.share_class(F.col("n"))).collect()]
    assert got == [("akero-holding", "akero holding publ ser", "ordinary"), ("smith-and-co", "smith co", "ordinary"), ("ab", "", "ordinary"), ("", "", "ordinary")]
    ratio, kind = text.split_ratio(F.col("r"))
    rows = spark.createDataFrame([("2/1",), ("1/4",), ("x",), (None,), ("1/0",)], "r string").select(ratio, kind).collect()
    assert [tuple(r) for r in rows] == [(2.0, "split"), (0.25, "reverse_split"), (None, None), (None, None), (None, None)]
    flags = spark.createDataFrame([("Yes",), (" 0 ",), (None,)], "f string")
    assert [r[0] for r in flags.select(text.flag(F.col("f"), True)).collect()] == [True, False, True]
    with pytest.raises(Exception, match="not a flag"):
        spark.createDataFrame([("maybe",)], "f string").select(text.flag(F.col("f"), True)).collect()


def test_statistics(spark):
    made = random.Random(4)
    r = [made.gauss(0.01, 0.05) for _ in range(40)]
    n, mean = len(r), sum(r) / len(r)
    sd = (sum((x - mean) ** 2 for x in r) / (n - 1)) ** 0.5
    row = spark.createDataFrame([(x,) for x in r], "r double").agg(stats.sharpe(F.col("r")), stats.skewness(F.col("r")), stats.kurtosis(F.col("r"))).first()
    want = (mean / sd * 12**0.5, sum(((x - mean) / sd) ** 3 for x in r) / n, sum(((x - mean) / sd) ** 4 for x in r) / n)
    assert all(abs(a - b) < 1e-9 for a, b in zip(row, want, strict=True))
    assert spark.createDataFrame([(0.1,)], "r double").agg(stats.sharpe(F.col("r"))).first()[0] == 0


def test_path_books(spark):
    made = random.Random(6)
    rows = [(number, month, "", made.random(), 0.0, 12, 1) for month in range(30) for number in made.sample(range(25), 18)]
    scored = spark.createDataFrame(rows, "number long, month int, reason string, score double, ret double, lookback int, skip int")
    cells = [(f"c{b}{m}", 12, 1, 6, b, m) for b in (0, 4) for m in (0, 3)]
    grid = spark.createDataFrame(cells, "candidate_id string, lookback int, skip int, top_n int, band int, min_hold int")
    got: dict = {}
    for r in portfolio.path_books(scored, grid).collect():
        got.setdefault((r.candidate_id, r.month), {})[r.number] = r.age
    for name, _, _, n, band, least in cells:
        ages: dict = {}
        for month in range(30):
            order = [x[0] for x in sorted((r for r in rows if r[1] == month), key=lambda r: (-r[3], r[0]))]
            stay = [x for i, x in enumerate(order, 1) if x in ages and (i <= n + band or ages[x] < least)][:n]
            new = stay + [x for x in order if x not in stay][: n - len(stay)]
            ages = {x: ages.get(x, 0) + 1 for x in new}
            assert got[name, month] == ages


def test_bootstrap(spark):
    data = [(c, k, float(k + 100 * c)) for c in (0, 1) for k in range(24)]
    df = spark.createDataFrame(data, "c int, month int, r double")
    got = validation.stationary_bootstrap(df, "c", "month", "r", 50, 4.0).collect()
    assert len(got) == 2 * 24 * 50 and all(r.ret // 100 == r.c for r in got)
    paths: dict = {}
    for r in got:
        paths.setdefault((r.c, r.resample), {})[r.step] = r.ret % 100
    goes_on = [p[k + 1] == (p[k] + 1) % 24 for p in paths.values() for k in range(23)]
    assert 0.68 < sum(goes_on) / len(goes_on) < 0.85
    assert sorted(map(tuple, got)) == sorted(map(tuple, validation.stationary_bootstrap(df.repartition(3), "c", "month", "r", 50, 4.0).collect()))


def test_neighbours(spark):
    grid = spark.createDataFrame([(f"{a}-{b}", a, b) for a in (3, 6, 12) for b in (5, 10)], "candidate_id string, a int, b int")
    got = {}
    for r in validation.neighbours(grid, ["a", "b"]).collect():
        got.setdefault(r.candidate_id, set()).add(r.neighbour_id)
    assert got["6-5"] == {"3-5", "12-5", "6-10"} and got["3-10"] == {"6-10", "3-5"}


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Name ; Include\nx;yes\n", encoding="utf-8")
    df = files.read_csv(spark, str(tmp_path / "a.csv"), ";")
    assert df.columns == ["name", "include"] and df.first() == ("x", "yes")
    months = spark.createDataFrame([(1, "2020-01"), (2, "2020-02")], "v int, m string")
    files.write_monthly(months, str(tmp_path / "h"), "m")
    files.write_monthly(spark.createDataFrame([(5, "2020-02")], "v int, m string"), str(tmp_path / "h"), "m")
    assert sorted((r.v, str(r.m)[:7]) for r in spark.read.parquet(str(tmp_path / "h")).collect()) == [(1, "2020-01"), (5, "2020-02")]
    nested = spark.createDataFrame([("lead", [("A", 0.5), ("B", 0.5)])], "role string, positions array<struct<id:string,w:double>>")
    assert [tuple(r) for r in files.flatten_positions(nested).collect()] == [("lead", 1, "A", 0.5), ("lead", 2, "B", 0.5)]


def test_stream_of_ticks(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k % 90, t0 + dt.timedelta(hours=k % 90), k % 3, float(k % 90)) for k in range(100)] + [(999, t0 + dt.timedelta(days=30), 0, 1.0)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id int, value double")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ticks.daily_summary(ticks.read_ticks(spark, str(tmp_path / "in"), df.schema))
    for _ in range(2):
        ticks.run_available(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(r.date, r.user_id): (r.n, r.total) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want: dict = {}
    for k in range(90):
        key = (t0 + dt.timedelta(hours=k)).date(), k % 3
        n, total = want.get(key, (0, 0.0))
        want[key] = n + 1, total + k
    assert got == want


def test_every_query_has_a_stable_schema(spark):
    assert set(queries.oracle_sql()) < set(queries.queries())
    for name in ("exchange_calendar", "grid_backtest", "trend_regime"):
        df = queries.queries()[name](spark, "/root/testdata/sf0.001")
        assert df.count() > 0 and len(set(df.columns)) == len(df.columns)
