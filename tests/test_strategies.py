"""Strategies that carry a book, against a plain loop over random rows."""

import collections
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import strategies
from strandline.operators.strategies import Strategy
from strandline.operators.universe import CURRENCY_BPS, IMPACT
from strandline.sources import files

SCORED = "lookback int, skip int, number long, month int, reason string, reason_se string, score double, ret double, ret_close double, market_cap_sek double, volatility double, median_value double, close_sek double, currency string"
SOME = (
    Strategy("baseline"), Strategy("banded2", "banded", band=2), Strategy("minhold3", "min_hold", min_hold=3), Strategy("minhold2cap", "min_hold", min_hold=2, weighting="cap"),
    Strategy("vol", weighting="inv_vol"), Strategy("gated", average=2), Strategy("gatedband", "banded", band=2, weighting="inv_vol", average=3), Strategy("liquid", floor=2e7), Strategy("liquidband", "banded", band=1, floor=2e7),
)


def table(seed: int) -> list[dict]:
    made = random.Random(seed)
    rows = []
    for number in range(1, 15):
        for month in range(24000, 24012):
            if number == 14 and month > 24006:
                continue  # a name that leaves the universe
            pick = lambda *xs: made.choice(xs)
            rows.append({
                "lookback": 12, "skip": 1, "number": number, "month": month, "reason": pick("", "", "", "", "stale"), "reason_se": pick("", "outside"), "score": pick(None, *[made.choice([0.1, 0.2, made.random()])] * 6),
                "ret": pick(None, *[made.uniform(-0.2, 0.2)] * 6), "ret_close": pick(None, *[made.uniform(-0.2, 0.2)] * 6), "market_cap_sek": pick(None, -1.0, 1e9, 2e9, made.random() * 1e9), "volatility": pick(None, 0.0, math.nan, 0.1, 0.2),
                "median_value": pick(None, 6e6, 9e6, 1.5e7, 2.5e7, 6e7), "close_sek": pick(20.0, 80.0), "currency": pick("SEK", "DKK"),
            })
    return [r for r in rows if r["month"] != 24009]  # a month that nobody trades in


def cost(r: dict, top_n: int, execution: str, bps: float) -> float:
    value = r.get("median_value")
    part = 250_000 / top_n / value if value and value > 0 else math.inf
    if part > 0.01:
        return 0.0
    spread = next((b for least, b in ((50e6, 15), (20e6, 25), (10e6, 40), (5e6, 60)) if value >= least), 100)
    taken = next(b for most, b in ((0.0025, 0), (0.005, 10), (0.0075, 20), (0.01, 40)) if part <= most)
    order = 250_000 / top_n
    return (max(1.0, order * 0.0009) / order * 1e4 + (spread + taken) * IMPACT[execution] + (10 if r["close_sek"] < 50 else 0) + (bps if r["currency"] != "SEK" else 0)) / 1e4


def walked(rows, months, strategy, top_n, reason, execution, bps, off) -> list[tuple]:
    """A window's months of one cell: (month, gross, cost, entries, exits, held)."""
    by_month = collections.defaultdict(dict)
    for r in rows:
        by_month[r["month"]][r["number"]] = r
    gain = strategies.EXECUTIONS[execution]
    held, ages, out = {}, {}, []
    for month in months:
        here = by_month[month]
        order = sorted(
            (r for r in here.values() if r[reason] == "" and r["score"] is not None and r[gain] is not None and (r["median_value"] or 0) > 0 and 250_000 / top_n / r["median_value"] <= 0.01 and r["median_value"] >= strategy.floor),
            key=lambda r: (-r["score"], r["number"]),
        )
        place = {r["number"]: k + 1 for k, r in enumerate(order)}
        if strategy.average and strategy.average in off.get(month, ()):
            chosen, weights, ages = [], {}, {}
        else:
            stay = []
            if strategy.rebalance == "banded":
                stay = [x for x in held if place.get(x, 99) <= top_n + strategy.band]
            if strategy.rebalance == "min_hold":
                now = {x: ages[x] + 1 for x in held if x in place}
                stay = [x for x, a in now.items() if a < max(strategy.min_hold, 1)]
            chosen = stay + [r["number"] for r in order if r["number"] not in stay][: top_n - len(stay)]
            if strategy.rebalance == "min_hold":
                ages = {x: now.get(x, 1) for x in chosen}
            raw = {}
            for x in chosen:
                cap, vol = here[x]["market_cap_sek"], here[x]["volatility"]
                raw[x] = {"equal": 1.0, "cap": cap if cap and cap > 0 else 0.0, "inv_vol": 1 / vol if vol and vol > 0 else 0.0}[strategy.weighting]
            total = sum(raw.values())
            raw = raw if total > 0 else dict.fromkeys(raw, 1.0)
            weights = {x: len(chosen) / top_n * v / sum(raw.values()) for x, v in raw.items()}
        entered, gone = set(chosen) - set(held), set(held) - set(chosen)
        paid = sum(weights[x] * cost(here[x], top_n, execution, bps) for x in entered) + sum(held[x] * cost(here.get(x, {}), top_n, execution, bps) for x in gone)
        out.append((month, sum(weights[x] * here[x][gain] for x in chosen), paid, len(entered), len(gone), len(chosen)))
        held = weights
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_matches_a_plain_loop(spark, seed):
    rows = table(seed)
    off = {24003: [2], 24004: [2, 3], 24008: [3]}
    scored = spark.createDataFrame([tuple(r.values()) for r in rows], SCORED).repartition(3)
    points = spark.createDataFrame([(12, 1, 3), (12, 1, 5)], "lookback int, skip int, top_n int")
    windows = {0: (24000, 24011), 1: (24002, 24004), 2: (24007, 24011)}
    spans = spark.createDataFrame([(k, *v) for k, v in windows.items()], "window_id int, first int, last int")
    gates = spark.createDataFrame(list(off.items()), "month int, off array<int>")
    got = collections.defaultdict(dict)
    for r in strategies.strategy_returns(scored, points, spans, gates, {"full": "reason", "se_only": "reason_se"}, SOME).collect():
        got[r.strategy_id, r.top_n, r.variant, r.execution, r.scenario, r.window_id][r.month] = (r.month, r.gross, r.cost, r.entries, r.exits, r.held)
    months = sorted({r["month"] for r in rows if r["ret"] is not None or r["ret_close"] is not None})
    cells = 0
    for s in SOME:
        for n in (3, 5):
            for variant, reason in (("full", "reason"), ("se_only", "reason_se")):
                for execution in strategies.EXECUTIONS:
                    for scenario, bps in CURRENCY_BPS.items():
                        for w, (a, b) in windows.items():
                            want = walked(rows, [m for m in months if a <= m <= b], s, n, reason, execution, bps, off)
                            own = got.pop((s.strategy_id, n, variant, execution, scenario, w))
                            assert sorted(own) == [m[0] for m in want]
                            for m in want:
                                assert own[m[0]] == pytest.approx(m, abs=1e-12), (s, n, variant, execution, scenario, w)
                            cells += 1
    assert not got and cells == len(SOME) * 2 * 2 * 2 * 3 * 3


def test_a_protocol_file_gives_the_windows(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"name": "x", "oos_start": "2000-08", "oos_end": "2000-12", "rolling_origin_folds": [["1999-01", "1999-12", "2000-01", "2000-03"], ["1999-01", "2000-03", "2000-04", "2000-07"]]}))
    spans = strategies.protocol_windows(*files.read_protocol(spark, str(tmp_path / "p.json")))
    assert sorted(map(tuple, spans.collect())) == [(0, 24007, 24011), (1, 24000, 24002), (2, 24003, 24006)]
    rows = table(1)
    scored = spark.createDataFrame([tuple(r.values()) for r in rows], SCORED)
    points = spark.createDataFrame([(12, 1, 3)], "lookback int, skip int, top_n int")
    made = strategies.strategy_returns(scored, points, spans, spark.createDataFrame([], "month int, off array<int>"), {"full": "reason"}, SOME[:3])
    months = {r.window_id: r.n for r in made.where("scenario = 'base' and execution = 'next_open' and strategy_id = 'minhold3'").groupBy("window_id").agg(F.count("*").alias("n")).collect()}
    assert months == {0: 4, 1: 3, 2: 4}  # nobody trades in 24009


def test_gate_knows_the_month_that_follows(spark):
    prices = spark.createDataFrame([("primary", f"2000-{m:02d}-03", p) for m, p in enumerate((10.0, 11.0, 12.0, 9.0, 9.0, 14.0, 2.0), 1)], "benchmark_id string, date string, adj_close double").selectExpr("benchmark_id", "cast(date as date) as date", "adj_close")
    months = spark.createDataFrame([(24000 + k,) for k in range(7)], "month int")
    off = {r.month: r.off for r in strategies.trend_off(prices, months, (2, 3)).collect()}
    # at 24002 the level of 24003 (9) is below (12 + 9) / 2; lengths of more months than have gone by don't count; there is no level after 24006
    assert off == {24002: [2], 24003: [3], 24005: [2, 3]}


def test_strategies_by_name_and_combined_ones():
    assert len(strategies.STRATEGIES) == 28 and len({s.strategy_id for s in strategies.STRATEGIES}) == 28
    assert [s.strategy_id for s in strategies.matching(strategies.STRATEGIES, ("cap_weighted", "baseline"))] == ["baseline", "cap_weighted"]
    assert len(strategies.matching(strategies.STRATEGIES, combined=True)) == 9
    with pytest.raises(ValueError):
        strategies.matching(strategies.STRATEGIES, ("nothing", "baseline"), combined=True)
