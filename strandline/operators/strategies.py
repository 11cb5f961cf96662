"""Strategies that carry a book from month to month: bands, least holding times, trend gates, weights and their costs, in one fold of many cells."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.operators.asof import asof_join
from strandline.operators.portfolio import foremost
from strandline.operators.universe import CURRENCY_BPS, IMPACT, tiered_cost_bps, within_capacity


@dataclass(frozen=True)
class Strategy:
    """How a book is renewed (``full``, ``banded`` or ``min_hold``) and weighted, the length of the trend gate's average (0: none), and the least median value of a name."""

    strategy_id: str
    rebalance: str = "full"
    band: int = 0
    min_hold: int = 0
    weighting: str = "equal"
    average: int = 0
    floor: float = 0.0


#: The strategies.
STRATEGIES = (
    Strategy("baseline"),
    Strategy("banded2", "banded", band=2),
    Strategy("minhold3", "min_hold", min_hold=3),
    Strategy("vol_weighted", weighting="inv_vol"),
    Strategy("cap_weighted", weighting="cap"),
    Strategy("trend_filter", average=10),
    Strategy("trend_filter_banded2", "banded", band=2, average=10),
    Strategy("trend_filter_minhold3", "min_hold", min_hold=3, average=10),
    Strategy("trend_filter_vol_weighted", weighting="inv_vol", average=10),
    Strategy("trend_filter_banded2_ma12", "banded", band=2, average=12),
    Strategy("trend_filter_minhold3_ma12", "min_hold", min_hold=3, average=12),
    Strategy("trend_filter_vol_weighted_ma12", weighting="inv_vol", average=12),
    Strategy("trend_filter_banded2_ma15", "banded", band=2, average=15),
    Strategy("trend_filter_minhold3_ma15", "min_hold", min_hold=3, average=15),
    Strategy("trend_filter_vol_weighted_ma15", weighting="inv_vol", average=15),
    *(Strategy(f"trend_filter_ma{n}", average=n) for n in (12, 15, 6, 7, 8, 9, 11, 13, 14, 16, 17, 18)),
    Strategy("liquidity_filter", floor=10_000_000.0),
)
#: Months of returns behind a volatility, and the latest that are left out.
VOLATILITY_MONTHS, VOLATILITY_SKIP = 12, 1
EXECUTIONS = {"next_open": "ret", "next_close": "ret_close"}
SCENARIOS = tuple(CURRENCY_BPS)
GROUP = ("variant", "execution", "lookback", "skip", "top_n", "floor", "window_id")


def matching(strategies: tuple[Strategy, ...], ids: tuple[str, ...] = (), combined: bool = False) -> tuple[Strategy, ...]:
    """Those named in ``ids`` (all, if none is), in their order; ``combined`` keeps trend gates together with another renewal or weighting than the usual. None left is an error."""
    out = tuple(s for s in strategies if (not ids or s.strategy_id in ids) and (not combined or (s.average and (s.rebalance != "full" or s.weighting != "equal"))))
    if not out:
        raise ValueError("no strategy is left")
    return out


def protocol_windows(folds: DataFrame, holdout: DataFrame) -> DataFrame:
    """Windows (window_id, first, last) for ``strategy_returns`` from a protocol file's folds and holdout (see ``sources.files.read_protocol``), in place of the usual ones; 0 is the holdout."""
    own = folds.select(F.col("fold_id").cast("int").alias("window_id"), F.col("test_from").cast("int").alias("first"), F.col("test_to").cast("int").alias("last"))
    return own.union(holdout.select(F.lit(0).alias("window_id"), F.col("first").cast("int"), F.col("last").cast("int")))


def trend_off(prices: DataFrame, months: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """month and off, the lengths of average under which a benchmark (``prices``: date, adj_close, of one benchmark_id) is in that month.

    A month's level is the first price from its beginning on. What is known when a month's signal is traded is the level of the month
    after; the gate is off if that is below the mean of as many levels up to it. Where one of them is missing, or fewer months
    than that have gone by since the first in ``months``, it isn't off.
    """
    both = months.select("month").union(months.select(F.col("month") + 1)).distinct()
    start = F.make_date(F.floor(F.col("month") / 12).cast("int"), (F.col("month") % 12 + 1).cast("int"), F.lit(1))
    keys = both.crossJoin(F.broadcast(prices.select("benchmark_id").distinct())).withColumn("date", start)
    levels = asof_join(keys, prices, ["benchmark_id"], "date", ["adj_close"], forward=True).where("adj_close is not null").select("benchmark_id", F.col("month").alias("at"), F.col("adj_close").alias("level"))
    first = months.agg(F.min("month").alias("first"))
    ordered = Window.partitionBy("benchmark_id").orderBy("at")
    flags = []
    for n in lengths:
        w = ordered.rangeBetween(1 - n, 0)
        flags.append(F.when((F.count("level").over(w) == n) & (F.col("level") < F.avg("level").over(w)), F.lit(n)))
    off = levels.select((F.col("at") - 1).alias("month"), F.array_compact(F.array(*flags)).alias("off")).crossJoin(F.broadcast(first))
    return off.select("month", F.filter("off", lambda n: n <= F.col("month") - F.col("first")).alias("off")).where(F.size("off") > 0)


def _fold(strategies: tuple[Strategy, ...]):
    """Month by month, all strategies of a group at once: arrays have a row for each strategy and a column for each name that can matter."""

    def run(group: pa.Table) -> pa.Table:
        key = {c: group.column(c)[0].as_py() for c in GROUP}
        own = [s for s in strategies if s.floor == key["floor"]]
        n = key["top_n"]
        band, least = (np.array([getattr(s, f) for s in own])[:, None] for f in ("band", "min_hold"))
        banded, aged = (np.array([s.rebalance == r for s in own])[:, None] for r in ("banded", "min_hold"))
        by_cap, by_vol = (np.array([s.weighting == w for s in own])[:, None] for w in ("cap", "inv_vol"))

        def column(c: str) -> np.ndarray:
            return group.column(c).to_numpy().astype(float)

        month, number, rank = column("month"), column("number"), np.nan_to_num(column("rank"), nan=np.inf)
        able = group.column("able").fill_null(False).to_numpy().astype(bool)
        gain = column("gain")
        cap, vol = column("market_cap_sek"), column("volatility")
        with np.errstate(divide="ignore", invalid="ignore"):
            cap, vol = np.where(cap > 0, cap, 0.0), np.where((vol > 0) & np.isfinite(vol), 1 / vol, 0.0)
        costs = np.stack([np.nan_to_num(column(f"cost_{c}"), nan=0.0) for c in SCENARIOS])
        off = group.column("off").to_pylist()
        names = np.unique(number[~np.isnan(number)])
        at = np.searchsorted(names, number)
        held, age, weight = np.zeros((len(own), len(names)), bool), np.zeros((len(own), len(names)), int), np.zeros((len(own), len(names)))
        order = np.lexsort((number, rank, month))
        out = []
        for rows in np.split(order, np.flatnonzero(np.diff(month[order])) + 1):
            gates = next((o for o in (off[i] for i in rows) if o), [])
            on = np.array([s.average not in gates for s in own])[:, None]
            rows = rows[~np.isnan(number[rows])]
            here = at[rows]
            was, before = held[:, here], weight[:, here]
            ages = np.where(was & able[rows], age[:, here] + 1, 0)
            stay = (banded & was & able[rows] & (rank[rows] <= n + band)) | (aged & (ages > 0) & (ages < np.maximum(least, 1)))
            open_ = able[rows] & ~stay
            chosen = (stay | (open_ & (np.cumsum(open_, axis=1) <= n - stay.sum(1, keepdims=True)))) & on
            raw = np.where(by_cap, cap[rows], np.where(by_vol, vol[rows], 1.0)) * chosen
            raw = np.where(raw.sum(1, keepdims=True) > 0, raw, chosen)
            many = chosen.sum(1, keepdims=True)
            now = many / n * raw / np.maximum(raw.sum(1, keepdims=True), 1e-300)
            entered, gone = chosen & ~was, was & ~chosen
            gross = np.where(chosen, now * np.where(chosen, gain[rows], 0.0), 0.0).sum(1)
            paid = [(np.where(entered, now, 0.0) * c).sum(1) + (np.where(gone, before, 0.0) * c).sum(1) for c in costs[:, rows]]
            held[:], age[:], weight[:] = False, 0, 0.0
            held[:, here], age[:, here], weight[:, here] = chosen, np.where(chosen, np.maximum(ages, 1), 0), now
            out.append((None, gross, entered.sum(1), gone.sum(1), many[:, 0], paid))
        months = np.unique(month).astype(int)
        made = {c: pa.array([key[c]] * (len(own) * len(out)), group.schema.field(c).type) for c in GROUP}
        made["strategy_id"] = pa.array([s.strategy_id for _ in out for s in own])
        made["month"] = pa.array(np.repeat(months, len(own)), pa.int32())
        for k, c in ((1, "gross"), (2, "entries"), (3, "exits"), (4, "held")):
            made[c] = pa.array(np.concatenate([o[k] for o in out]), pa.float64() if c == "gross" else pa.int64())
        for k, c in enumerate(SCENARIOS):
            made[f"cost_{c}"] = pa.array(np.concatenate([o[5][k] for o in out]))
        return pa.table(made)

    return run


def strategy_returns(
    scored: DataFrame, points: DataFrame, windows: DataFrame, off: DataFrame, variants: dict[str, str], strategies: tuple[Strategy, ...] = STRATEGIES
) -> DataFrame:
    """variant, execution, lookback, skip, top_n, window_id, strategy_id, scenario, month, gross, cost, net, entries, exits and held of every cell.

    ``scored`` has every row of the universe for each (lookback, skip), with reasons, score, returns, volatility and what costs depend on; ``points`` are
    (lookback, skip, top_n); ``windows`` (window_id, first, last) are months, each begun without a book; ``off`` is of ``trend_off``;
    ``variants`` name the columns whose reason must be empty.

    A name can be held if its reason is empty, its score and return are known, its order is within capacity, and its median value
    is at least the strategy's floor. Held names within the band stay, as do those held for too short a time (a name's age is 1 in its first month and it
    is locked while its age, this month counted, is below min_hold); the rest is filled by rank. While the gate is off there is no book and ages are lost.
    Entries pay on the new weight, exits on the old, both at this month's cost; a trade without a known cost is free.

    Only names that were within the band, or came in lately, go into the fold, a group for each (variant, execution, point, floor, window), so
    a group is bounded by months x books, whatever the universe. Ranks are cut at the widest band before they are shuffled.
    """
    deepest = max(s.band for s in strategies)
    longest = max(1, max(s.min_hold for s in strategies) - 1)
    floors = sorted({s.floor for s in strategies})
    widest = points.agg(F.max("top_n")).first()[0] + deepest  # of a parameter table
    variant = F.explode(F.array_compact(F.array(*[F.when(F.col(r) == "", F.lit(v)) for v, r in variants.items()])))
    gains = F.array(*[F.struct(F.lit(e).alias("execution"), F.col(r).alias("gain")) for e, r in EXECUTIONS.items()])
    cells = F.broadcast(points.withColumn("floor", F.explode(F.array(*map(F.lit, floors)))))
    enough = within_capacity(F.col("top_n")) & (F.col("median_value") >= F.col("floor"))
    rows = scored.where("score is not null").select("lookback", "skip", "number", "month", "score", "median_value", variant.alias("variant"), gains.alias("gains"))
    rows = rows.select("*", F.inline("gains")).where("gain is not null").drop("gains").join(cells, ["lookback", "skip"]).where(enough)
    keys = [c for c in GROUP if c != "window_id"]
    rows = foremost(rows, [*keys, "month"], F.col("top_n") + deepest, 2 * widest)
    best = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "month").orderBy(F.desc("score"), "number"))).where(F.col("rank") <= widest).where(F.col("rank") <= F.col("top_n") + deepest)
    # the months that follow are those in which anything is traded, whatever lies between them
    traded = " or ".join(f"{r} is not null" for r in EXECUTIONS.values())
    months = scored.where(traded).select("month").distinct()
    places = F.broadcast(months.withColumn("place", F.row_number().over(Window.orderBy("month"))))  # a row for each month
    later = F.array(*[F.struct((F.col("place") + j).alias("place"), (F.col("rank") if j == 0 else F.lit(None).cast("int")).alias("rank")) for j in range(longest + 1)])
    wanted = best.join(places, "month").select(*keys, "number", F.inline(later)).join(places, "place").groupBy(*keys, "number", "month").agg(F.max("rank").alias("rank"))

    facts = scored.select("lookback", "skip", "number", "month", "score", "median_value", "market_cap_sek", "volatility", "close_sek", "currency", *variants.values(), *EXECUTIONS.values())
    # of the universe only the rows that books ask for are shuffled
    asked = wanted.select("lookback", "skip", "number", "month").distinct()
    facts = facts.join(F.broadcast(asked), ["lookback", "skip", "number", "month"], "left_semi")
    full = wanted.join(facts, ["lookback", "skip", "number", "month"], "left")
    reason, gain = F.lit(None).cast("string"), F.lit(None).cast("double")
    for v, r in variants.items():
        reason = F.when(F.col("variant") == v, F.col(r)).otherwise(reason)
    for e, r in EXECUTIONS.items():
        gain = F.when(F.col("execution") == e, F.col(r)).otherwise(gain)
    impact = F.when(F.col("execution") == "next_open", IMPACT["next_open"]).otherwise(IMPACT["next_close"])
    able = (reason == "") & F.col("score").isNotNull() & gain.isNotNull() & enough
    full = full.withColumns({"able": F.coalesce(able, F.lit(False)), "gain": gain, **{f"cost_{c}": tiered_cost_bps(F.col("top_n"), impact, b) / 1e4 for c, b in CURRENCY_BPS.items()}})

    spans = F.broadcast(windows)
    inside = F.col("month").between(F.col("first"), F.col("last"))
    held = [c for c in (*GROUP, "month", "number", "rank", "able", "gain", "market_cap_sek", "volatility", *(f"cost_{c}" for c in SCENARIOS))]
    full = full.join(spans, inside).select(*held)
    axis = months.join(spans, inside).select("window_id", "month").crossJoin(cells)
    axis = axis.withColumn("variant", F.explode(F.array(*map(F.lit, variants)))).withColumn("execution", F.explode(F.array(*map(F.lit, EXECUTIONS))))
    axis = axis.join(F.broadcast(off), "month", "left").select(*GROUP, "month", "off")
    every = full.unionByName(axis, allowMissingColumns=True)
    kinds = {"lookback": "int", "skip": "int", "top_n": "int", "floor": "double", "window_id": "int"}
    schema = ", ".join(f"{c} {kinds.get(c, 'string')}" for c in GROUP) + ", strategy_id string, month int, gross double, entries long, exits long, held long, " + ", ".join(f"cost_{c} double" for c in SCENARIOS)
    made = every.groupBy(*GROUP).applyInArrow(_fold(strategies), schema)
    cost = F.array(*[F.struct(F.lit(c).alias("scenario"), F.col(f"cost_{c}").alias("cost")) for c in SCENARIOS])
    return made.select(*[c for c in GROUP if c != "floor"], "strategy_id", "month", "gross", "entries", "exits", "held", F.inline(cost)).withColumn("net", F.col("gross") - F.col("cost"))
