"""Files in and out, streams with state, and that splits and scaling leave scores and returns as they are."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from strandline import storage
from strandline.functions import text
from strandline.operators import portfolio, universe
from strandline.sources import files
from strandline.streaming import ticks


def test_staged_and_appended(spark, tmp_path):
    path = str(tmp_path / "t")
    files.write_staged(spark.range(3), path)
    bad = spark.range(5).withColumn("x", F.raise_error(F.lit("no")))
    with pytest.raises(Exception, match="no"):
        files.write_staged(bad, path)
    assert spark.read.parquet(path).count() == 3 and [p.name for p in tmp_path.iterdir()] == ["t"]
    files.write_staged(spark.range(7), path)
    assert spark.read.parquet(path).count() == 7
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    for _ in range(2):
        files.append_new(rows, str(tmp_path / "h"), ["k"])
    files.append_new(spark.createDataFrame([(2, "z"), (3, "d")], "k int, v string"), str(tmp_path / "h"), ["k"])
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "h")).collect()) == [1, 2, 3]


def test_vendor_files(spark, tmp_path):
    for name, rows in {
        "h/A.ST": [{"date": "2020-01-02", "open": 1, "high": 2, "low": 1, "close": 1.5, "volume": 10}, {"date": "x", "close": 1}, {"date": "2020-01-03"}], "h/B.ST": [],
        "d/A.ST": [{"date": "2020-01-02", "value": 0.5, "currency": "SEK"}], "s/A.ST": [{"date": "2020-01-03", "split": "2/1"}, {"date": "2020-01-04", "split": "x"}],
        "r/ST": [{"Code": " VOLV-B ", "Name": "Volvo B", "Type": "Common Stock"}, {"Code": "VOLV-B", "Name": "twice"}, {"Code": ""}],
    }.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / f"{name}.json").write_text(json.dumps(rows))
    assert [(r.security_id, str(r.date), r.close_raw) for r in files.read_history(spark, str(tmp_path / "h")).collect()] == [("A.ST", "2020-01-02", 1.5)]
    got = files.read_actions(spark, str(tmp_path / "d"), str(tmp_path / "s")).orderBy("date").collect()
    assert [(r.action_type, r.action_value, r.action_ratio) for r in got] == [("cash_dividend", 0.5, None), ("split", None, 2.0)]
    assert [(r.exchange_group, r.code) for r in files.read_roster(spark, str(tmp_path / "r")).collect()] == [("ST", "VOLV-B")]


def test_json_csv_and_protocols(spark, tmp_path):
    df = spark.createDataFrame([("n", (2, 1, None), [(1, 2)])], "name string, inner struct<z:int,a:int,m:int>, list array<struct<y:int,b:int>>")
    files.write_summary(df, str(tmp_path / "s"))
    line = "".join(f.read_text() for f in (tmp_path / "s").glob("*.json")).strip()
    assert line == '{"inner":{"a":1,"m":null,"z":2},"list":[{"b":2,"y":1}],"name":"n"}'
    files.write_csv(spark.createDataFrame([("a;b", 1)], "Name string, n int").coalesce(1), str(tmp_path / "c"), ";", mark=True)
    assert files.read_csv(spark, str(tmp_path / "c"), ";").collect() == [("a;b", "1")]
    assert next((tmp_path / "c").glob("*.csv")).read_bytes().startswith(b"\xef\xbb\xbf")
    (tmp_path / "p.json").write_text(json.dumps({"name": "x", "insample_end": "2014-12", "oos_start": "2015-01", "oos_end": "2016-12", "rolling_origin_folds": [["2005-01", "2009-12", "2010-01", "2010-12"]]}))
    folds, holdout = files.read_protocol(spark, str(tmp_path / "p.json"))
    assert [tuple(r) for r in folds.collect()] == [(1, 2010 * 12, 2010 * 12 + 11)] and tuple(holdout.first()) == ("x", 2015 * 12, 2016 * 12 + 11)
    panel = spark.createDataFrame([(12, 1, "a"), (6, 1, "b"), (6, 1, "c")], "l int, s int, v string")
    assert [r.v for r in files.locked_rows(panel, panel.where("l = 12"), ["l", "s"]).collect()] == ["a"]
    for missing in (panel.where("l = 6"), spark.createDataFrame([(1, 1)], "l int, s int")):
        with pytest.raises(Exception, match="one row"):
            files.locked_rows(panel, missing, ["l", "s"]).collect()
    typed = files.read_parquet(spark, _saved(spark, tmp_path), spark.createDataFrame([], "d date, v double").schema, ["d"])
    assert [(str(r.d), r.v) for r in typed.collect()] == [("2020-01-02", 1.0), ("None", 2.0)]


def _saved(spark, tmp_path):
    spark.createDataFrame([("2020-01-02", 1), ("odd", 2)], "d string, v int").coalesce(1).write.parquet(str(tmp_path / "typed"))
    return str(tmp_path / "typed")


def test_candidate_names_and_numbers(spark):
    df = spark.createDataFrame([(12, 1, 10, "cap", float("nan")), (3, 0, 5, "a_b", 2.0)], "l int, s int, n int, w string, x double")
    name = text.candidate_id(F.col("l"), F.col("s"), F.col("n"), F.col("w"))
    got = df.select(name.alias("c"), text.finite(F.col("x")).alias("x")).select("c", "x", text.candidate_parts(F.col("c")).alias("p"), text.candidate_parts(F.lit("odd")).alias("q")).collect()
    assert [(r.c, r.x, tuple(r.p), r.q) for r in got] == [("l12_s1_n10_strat=cap", None, (12, 1, 10, "cap"), None), ("l3_s0_n5_strat=a_b", 2.0, (3, 0, 5, "a_b"), None)]
    names = spark.createDataFrame([("Big ETF", "X", "Common Stock"), ("Firm", "X-TR", "Common Stock"), ("Firm", "X", "Fund"), ("Firm", "X", "Common Stock"), ("Firm Pref", "X", "x"), ("Møller & Co AB", "M", "x")], "n string, c string, t string")
    out = names.select(text.security_type(F.col("n"), F.col("c"), F.col("t")), text.share_class(F.col("n"), F.col("c")), text.issuer_group(F.col("n"))).collect()
    assert [tuple(r) for r in out] == [("other", "ordinary", "big-etf"), ("other", "rights", "firm"), ("fund", "ordinary", "firm"), ("common_share", "ordinary", "firm"), ("other", "preferred", "firm"), ("other", "ordinary", "mller-and-co")]


def test_rates_on_a_stream(spark, tmp_path):
    rates = spark.createDataFrame([("EUR", dt.date(2024, 1, 1), 10.0), ("EUR", dt.date(2024, 1, 4), 12.0)], "currency string, date date, sek_per_ccy double")
    rows = [(1, "EUR", dt.datetime(2024, 1, 3, 5), 2.0), (2, "EUR", dt.datetime(2024, 1, 6), 2.0), (3, "SEK", dt.datetime(2024, 1, 6), 2.0), (4, "EUR", dt.datetime(2023, 12, 31), 2.0), (5, "EUR", dt.datetime(2024, 3, 1), 2.0)]
    df = spark.createDataFrame(rows, "event_id long, currency string, ts timestamp, value double")
    df.write.parquet(str(tmp_path / "in"))
    ticks.run_available(ticks.with_rates(ticks.read_ticks(spark, str(tmp_path / "in"), df.schema), rates), str(tmp_path / "out"), str(tmp_path / "state"))
    assert {r.event_id: r.value_sek for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: 20.0, 2: 24.0, 3: 2.0, 4: None, 5: None}


def test_ledger_and_periods_on_a_stream(spark, tmp_path):
    schema = "role string, month int, trade_date date, positions array<struct<security_id:string,weight:double,price:double>>"
    rows = [
        ("lead", 5, dt.date(2024, 1, 1), [("A", 0.5, 10.0), ("B", 0.5, 20.0)]), ("lead", 5, dt.date(2024, 1, 2), [("C", 1.0, 1.0)]),
        ("lead", 6, dt.date(2024, 2, 1), [("A", 1.0, 20.0), ("B", 0.0, 20.0)]), ("lead", 4, dt.date(2024, 2, 2), [("C", 1.0, 1.0)]), ("other", 6, dt.date(2024, 2, 1), None),
    ]
    for k, own in enumerate((rows[:2], rows[:1], rows[2:], rows)):
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = ticks.read_ticks(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
        ticks.run_available(ticks.paper_ledger(stream, 1000.0, 0.0), str(tmp_path / "ledger"), str(tmp_path / "s1"))
        ticks.run_available(ticks.new_periods(stream.select("role", "month")), str(tmp_path / "periods"), str(tmp_path / "s2"))
    got = sorted((r.month, r.security_id, r.action, round(r.shares, 6)) for r in spark.read.parquet(str(tmp_path / "ledger")).collect())
    assert got == [(5, "A", "enter", 50.0), (5, "B", "enter", 25.0), (6, "A", "adjust", 25.0), (6, "B", "exit", -25.0)]
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "periods")).collect())) == [("lead", 5), ("lead", 6), ("other", 6)]
    seen = spark.createDataFrame([("a", dt.date(2024, 1, 1)), ("a", dt.date(2024, 1, 9)), ("b", dt.date(2024, 1, 1)), ("c", None)], "k string, d date")
    assert {r.k: r.days for r in ticks.stale(seen, "k", "d", dt.date(2024, 1, 10)).collect()} == {"b": 9, "c": None}


def _panel(spark, scale: float, split: bool):
    """Monthly prices of two names; with ``split``, one is split two for one in its twelfth month."""
    made = random.Random(3)
    rows, actions = [], []
    for n in (1, 2):
        p = 100.0 * n
        for m in range(30):
            p *= 1 + made.gauss(0, 0.05)
            q = p * scale / (2 if split and n == 1 and m >= 12 else 1)
            for day in (3, 25):
                rows.append((n, dt.date(2020 + m // 12, m % 12 + 1, day), q, q, q, q, 1e6, f"S{n}", "ST", "SE", "SEK", n, 1000.0, "ordinary", False))
    if split:
        actions.append((1, dt.date(2021, 1, 3), "split", None, 2.0))
    prices = spark.createDataFrame(rows, "number long, date date, open_raw double, high_raw double, low_raw double, close_raw double, volume double, security_id string, exchange_group string, country_code string, currency string, issuer_group_id long, shares double, share_class string, is_delisted boolean")
    rates = spark.createDataFrame([("EUR", dt.date(2019, 1, 1), 10.0)], "currency string, date date, sek_per_ccy double")
    acted = spark.createDataFrame(actions, "number long, date date, action_type string, action_value double, action_ratio double")
    daily = universe.daily_panel(prices, rates, acted)
    months = universe.universe(daily)
    grid = spark.createDataFrame([("c", 6, 1, 2, "equal")], "candidate_id string, lookback int, skip int, top_n int, weighting string")
    scores = {(r.number, r.month): r.score for r in portfolio.momentum(months, grid).collect()}
    returns = {(r.number, r.month): r.ret for r in portfolio.holding_returns(months, daily, acted).collect()}
    return scores, returns


def test_splits_and_scaling_leave_scores_and_returns(spark):
    same = lambda a, b: a.keys() == b.keys() and all((a[k] is None) == (b[k] is None) and (a[k] is None or abs(a[k] - b[k]) < 1e-9) for k in a)
    scores, returns = _panel(spark, 1.0, False)
    assert sum(x is not None for x in scores.values()) > 20 and sum(x is not None for x in returns.values()) > 40
    for other in (_panel(spark, 3.0, False), _panel(spark, 1.0, True)):
        assert same(scores, other[0]) and same(returns, other[1])


def test_cashouts_are_paid_in_full(spark):
    days = [dt.date(2020, 1, 5), dt.date(2020, 2, 5), dt.date(2020, 2, 20)]
    daily = spark.createDataFrame([(n, d, 10.0, 8.0) for n in (1, 2) for d in days], "number long, date date, adj_open_sek double, adj_close_sek double")
    months = spark.createDataFrame([(n, m, dt.date(2020, m + 1, 5)) for n in (1, 2) for m in (0, 1, 2)], "number long, month int, next_execution_date date")
    actions = spark.createDataFrame([(1, days[-1], "delisting_cashout", 1.0, None)], "number long, date date, action_type string, action_value double, action_ratio double")
    got = {(r.number, r.month): (r.ret, r.ret_close) for r in portfolio.holding_returns(months, daily, actions).collect()}
    assert got[1, 0] == got[2, 0] == (0.0, 0.0)
    assert abs(got[1, 1][0] + 0.2) < 1e-12 and abs(got[2, 1][0] - (8 * 0.7 / 10 - 1)) < 1e-12 and (1, 2) not in got


def test_saved_tables_are_kept_by_state_and_removed(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in" / "a.parquet"))
    made = []
    make = lambda: made.append(1) or spark.read.parquet(str(tmp_path / "in" / "a.parquet"))
    for _ in range(2):
        assert storage.kept(spark, str(tmp_path / "in"), "t", make).count() == 3
    spark.range(4).write.mode("append").parquet(str(tmp_path / "in" / "a.parquet"))
    assert storage.kept(spark, str(tmp_path / "in"), "t", make).count() == 7 and len(made) == 2
    assert storage.clear(spark) >= 2 and storage.clear(spark) == 0
