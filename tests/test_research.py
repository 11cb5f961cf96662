"""Controls, table comparison and the ledger on small tables, against plain Python."""

import hashlib
import random

from strandline.operators import controls, ledger


def _md5(*parts):
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def test_shuffled_scores(spark):
    made = random.Random(3)
    rows = [(m, n, round(made.random(), 1), made.gauss(0, 0.1)) for m in range(3) for n in range(12)]
    got = {(r.run, r.month): r.excess for r in controls.shuffled_scores(spark.createDataFrame(rows, "month int, number long, score double, ret double"), 4, 3).collect()}
    assert len(got) == 12
    for (run, month), excess in got.items():
        own = [r for r in rows if r[0] == month]
        base = sum(r[3] for r in own) / len(own)
        best = sorted(own, key=lambda r: (-r[2], r[1]) if run == 0 else _md5(7, run, month, r[1]))[:4]
        assert abs(excess - sum(r[3] - base for r in best) / 4) < 1e-11
    empty = spark.createDataFrame([], "month int, number long, score double, ret double")
    assert controls.shuffled_scores(empty, 4, 3).count() == 0


def test_block_shuffles(spark):
    rows = [("a", m, float(m)) for m in range(8)] + [("b", 5, 1.5)]
    got = {}
    for r in controls.block_shuffles(spark.createDataFrame(rows, "c string, m int, r double"), "c", "m", "r", 4, 3).orderBy("c", "run", "step").collect():
        got.setdefault((r.c, r.run), []).append(r.ret)
    for run in range(4):
        blocks = sorted(range(3), key=lambda b: _md5(7, run, "a", b))
        assert got["a", run] == [float(m) for b in blocks for m in range(8) if m // 3 == b]
        assert got["b", run] == [1.5]


def test_table_diff(spark):
    kind = "k int, v double"
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None), (4, None), (5, 1e9)], kind)
    b = spark.createDataFrame([(1, 1.0 + 1e-12), (2, 2.1), (3, None), (5, 1e9 + 0.1), (6, 0.0)], kind)
    got = {r.k: r.status for r in controls.table_diff(a, b, ["k"], ["v"], 1e-9).collect()}
    assert got == {1: "same", 2: "differs", 3: "same", 4: "left_only", 5: "same", 6: "right_only"}


def test_ledger(spark):
    book = spark.createDataFrame([("c", 1, 1, 0.5), ("c", 1, 2, 0.5), ("c", 2, 2, 0.5), ("c", 2, 3, 0.5)], "candidate_id string, month int, number long, weight double")
    prices = spark.createDataFrame([(n, m, float(10 * n + m)) for n in (1, 2, 3) for m in (1, 2)] + [(9, 1, 1.0), (1, 3, None)], "number long, month int, price double")
    trades = ledger.ledger(book, prices, 1000.0, 40.0).orderBy("month", "number").collect()
    assert [(t.month, t.number, t.action) for t in trades] == [(1, 1, "enter"), (1, 2, "enter"), (2, 1, "exit"), (2, 2, "adjust"), (2, 3, "enter")]
    cash, held = 1000.0, {}
    for t in trades:
        assert abs(t.trade_value - t.shares_delta * t.price) < 1e-9 and abs(t.cost - abs(t.trade_value) * 0.004) < 1e-9
        cash -= t.trade_value + t.cost
        held[t.number] = held.get(t.number, 0.0) + t.shares_delta
        assert abs(t.cash_after - cash) < 1e-9
    assert cash >= 0 and abs(held[1]) < 1e-6
    assert ledger.ledger(book.limit(0), prices, 1000.0, 40.0).count() == 0
    assert ledger.rebalance({1: 10.0}, 0.0, {1: 1.0}, {1: 5.0}, 0.01) == []
