"""Small tests of what a review of the market queries on larger tables found."""

import datetime as dt
import hashlib
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from strandline import storage
from strandline.operators import controls, portfolio, universe
from strandline.operators.asof import asof_both, asof_join
from strandline.plans import holdout, queries

SMOKE = "/root/testdata/sf0.001"


def test_holdout_gate_takes_books_that_weigh_nothing(spark, monkeypatch):
    first = holdout.HOLDOUT[0]
    held = [("a", m, n, "SE" if n == 1 else "DK", w, 0.1) for m in (first, first + 1) for n, w in ((1, 0.0), (2, 1.0))]
    known = [(n, m, False) for m in (first, first + 1) for n in (1, 2)]
    monkeypatch.setattr(holdout, "book", lambda *_: spark.createDataFrame(held, "candidate_id string, month int, number long, country_code string, weight double, ret double"))
    monkeypatch.setattr(holdout, "monthly", lambda *_: spark.createDataFrame(known, "number long, month int, is_liquid boolean"))
    monkeypatch.setattr(holdout, "_levels", lambda *_: spark.createDataFrame([(first - 1 + i, 100.0 + i) for i in range(3)], "month int, level double"))
    got = {r.variant: r for r in queries.queries()["holdout_gate"](spark, "").collect()}
    assert set(got) == {"full", "se_only", "without_se"} and {r.months for r in got.values()} == {2}
    assert math.isnan(got["se_only"].total_return) and abs(got["without_se"].total_return - 0.21) < 1e-9


def test_rates_are_found_without_a_shuffle_of_prices(spark):
    made = random.Random(3)
    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(days=k)
    seen = {c: {k: made.random() for k in [0, *made.sample(range(1, 60), 9)]} for c in ("EUR", "NOK")}
    rates = spark.createDataFrame([(c, day(k), r) for c, own in seen.items() for k, r in own.items()], "currency string, date date, sek_per_ccy double")
    prices = spark.createDataFrame([(c, day(k), 2.0, 3.0) for c in ("EUR", "NOK", "SEK") for k in range(80)], "currency string, date date, close_raw double, volume double")
    out = universe.in_sek(prices, rates)
    want = {(c, day(k)): 1.0 if c == "SEK" else seen[c][max(x for x in seen[c] if x <= k)] for c in ("EUR", "NOK", "SEK") for k in range(80)}
    assert {(r.currency, r.date): r.sek_per_ccy for r in out.collect()} == want
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan


def test_books_drop_what_cannot_be_held_before_they_rank(spark):
    made = random.Random(5)
    rows = [(m, n, made.choice((made.random(), 0.5)), top) for top in (2, 5) for m in range(3) for n in range(1000)] + [(9, n, made.random(), 5) for n in range(3)]
    df = spark.createDataFrame(rows, "month int, number long, score double, top_n int")
    by = ["month", "top_n"]
    left = portfolio.foremost(df, by)
    best = lambda x: sorted(map(tuple, portfolio.ranked(x, by).where("rank <= top_n").select("month", "top_n", "number", "rank").collect()))
    assert best(left) == best(df) and left.count() < 0.05 * len(rows)


def test_saved_tables_have_a_row_a_security_and_month_and_no_derived_column(spark):
    found = queries.scored(spark, SMOKE)
    months = queries.monthly(spark, SMOKE).count()
    assert found.count() == 6 * months
    kept = {key[1]: df for key, df in storage._KEPT.items() if key[2] == SMOKE}
    assert kept["scored"].count() == months and not set(universe.REPRICED) & set(kept["daily"].columns)
    again = queries.daily(spark, SMOKE).where("adj_close_sek <> close_raw * (adj_close / close_raw) * sek_per_ccy or open_sek <> (high_raw + low_raw) / 2 * sek_per_ccy").count()
    assert again == 0
    turns = queries.daily(spark, SMOKE).groupBy("number", F.trunc("date", "month")).agg(F.count_if("starts_month").alias("a"), F.count_if("ends_month").alias("b"))
    assert {(r.a, r.b) for r in turns.collect()} == {(1, 1)}


def test_shuffled_books_rank_few_rows_whatever_the_universe(spark):
    made = random.Random(8)
    rows = [(m, n, made.choice((made.random(), 0.5)), made.uniform(-0.2, 0.2)) for m, names in ((1, 3000), (2, 1500), (3, 4), (4, 10)) for n in range(names)]
    df = spark.createDataFrame(rows, "month int, number long, score double, ret double").repartition(3)
    got = {(r.run, r.month): r.excess for r in controls.shuffled_scores(df, 10, 6, 7).collect()}
    for run in range(7):
        for m in (1, 2, 3, 4):
            own = [r for r in rows if r[0] == m]
            digest = lambda r: hashlib.md5(f"7:{run}:{r[0]}:{r[1]}".encode()).hexdigest()  # noqa: E731, B023
            best = sorted(own, key=lambda r: (-r[2], r[1]) if run == 0 else (digest(r), r[1]))[:10]
            base = statistics.fmean(r[3] for r in own)
            assert got.pop((run, m)) == pytest.approx(sum(r[3] - base for r in best) / 10, abs=1e-11)
    assert not got
    left = controls.contenders(df, 10, 6, 7).where("run > 0").groupBy("month").count().collect()
    assert all(r["count"] < 6 * 40 for r in left)


def test_holdings_are_shuffled_once_by_security_in_bounded_parts(spark):
    made = random.Random(11)
    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(days=k)
    due = [(n, m, day(30 * m + made.randrange(5))) for n in range(40) for m in range(6)]
    prices = [(n, day(k), made.uniform(1, 9), made.uniform(1, 9)) for n in range(40) for k in sorted(made.sample(range(200), 12))]
    acted = [(n, day(made.randrange(200)), made.choice(("split", "cash_merger"))) for n in range(0, 40, 3)]
    months = spark.createDataFrame(due, "number long, month int, next_execution_date date")
    daily = spark.createDataFrame(prices, "number long, date date, adj_open_sek double, adj_close_sek double")
    actions = spark.createDataFrame(acted, "number long, date date, action_type string")
    rows = lambda df: sorted((r.number, r.month, r.ret, r.ret_close) for r in df.select("number", "month", F.coalesce("ret", F.lit(-9.0)).alias("ret"), F.coalesce("ret_close", F.lit(-9.0)).alias("ret_close")).collect())
    out = portfolio.holding_returns(months, daily, actions, 3)
    assert rows(out) == rows(portfolio.holding_returns(months, daily, actions)) and out.count() > 100
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") == 2  # prices with months, and actions


def test_rows_of_an_asof_join_stay_partitioned_by_its_key(spark):
    left = spark.createDataFrame([(c, t) for c in range(5) for t in range(4)], "c int, t int")
    right = spark.createDataFrame([(c, t, 10.0 * c + t) for c in range(4) for t in (1, 3)], "c long, t int, v double").where("c <> 2")
    for found in (asof_join(left, right, ["c"], "t", ["v"], parts=2), asof_both(left, right, ["c"], "t", ["v"], 2).withColumn("v", F.col("back.v"))):
        assert found.schema["c"].dataType == left.schema["c"].dataType
        assert {(r.c, r.t): r.v for r in found.collect()} == {(c, t): None if c in (2, 4) or t == 0 else 10.0 * c + (3 if t == 3 else 1) for c in range(5) for t in range(4)}
    same = right.withColumn("c", F.col("c").cast("int"))
    for found in (asof_join(left, same, ["c"], "t", ["v"], parts=2), asof_both(left, same, ["c"], "t", ["v"], 2)):
        assert found.groupBy("c").count()._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
