"""Registered queries over strategies that carry a book from month to month."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions import stats
from strandline.operators import controls, strategies, universe, validation
from strandline.operators.strategies import STRATEGIES
from strandline.plans.holdout import _SHARPE, _TAIL
from strandline.plans.queries import _CAPACITY, _RAW, _RETURNS, _SCORED, _SPLITS, FOLDS, _cost, monthly, query, scored
from strandline.sources import market
from strandline.storage import kept, stage

#: The point and the sizes at which strategies are compared; variants and their reasons; the windows: the folds, and 0 for all of their years.
LOOKBACK, SKIP, SIZES = 12, 1, (5, 8, 10, 12, 15, 20)
REASONS = {"full": "reason", "se_only": "reason_se", "liquid": "liquid_reason"}
WINDOWS = [(0, 1996 * 12, 2000 * 12 + 11), *((f, a, b) for f, _, _, a, b in FOLDS)]
CELL = ("variant", "execution", "top_n", "strategy_id", "window_id")

#: The fold as a recursion: one round a month; a cell's book, and a row 0 that keeps a cell without names going.
_STRATEGIES = f"""{_SCORED},
st(strategy_id, rebalance, band, min_hold, weighting, average, floor) as (values {", ".join(str((s.strategy_id, s.rebalance, s.band, s.min_hold, s.weighting, s.average, s.floor)) for s in STRATEGIES)}),
wn(window_id, a, b) as (values {", ".join(map(str, WINDOWS))}),
one as materialized (select * from sc where lookback = {LOOKBACK} and skip = {SKIP}),
ax as materialized (select window_id, month, row_number() over (partition by window_id order by month) as i
    from (select distinct month from one where ret is not null or ret_close is not null) join wn on month between a and b),
fm as (select min(month) as first from uni),
p0 as (select distinct k as month, make_date((k // 12)::int, (k % 12 + 1)::int, 1) as start from (select unnest([month, month + 1]) as k from uni)),
p1 as materialized (select p0.month, x.adj_close as level from p0 asof join (select * from bench where benchmark_id = 'primary') x on p0.start <= x.date),
off as materialized (select t.month - 1 as month, average from p1 t cross join fm join (select distinct average from st where average > 0) on t.month - 1 - first >= average join p1 o on o.month between t.month + 1 - average and t.month
    group by t.month, average having count(*) = average and any_value(t.level) < avg(o.level)),
vr(variant) as (values {", ".join(f"('{v}')" for v in REASONS)}), er(execution) as (values {", ".join(f"('{e}')" for e in strategies.EXECUTIONS)}), tn as (select unnest({list(SIZES)}) as top_n),
gr as materialized (select variant, execution, top_n, floor, month, number, market_cap_sek, volatility, row_number() over (partition by variant, execution, top_n, floor, month order by score desc, number) as place
    from (select one.*, variant, execution, case execution when 'next_open' then ret else ret_close end as gain from one, vr, er
        where case variant {" ".join(f"when '{v}' then {r}" for v, r in REASONS.items())} end = '' and score is not null), tn, (select distinct floor from st)
    where gain is not null and {_CAPACITY} and median_value >= floor),
ce as materialized (select row_number() over () as cell, * from st, wn, vr, er, tn),
mm as materialized (
    select cell, i, number, place, {_RAW} as raw, rebalance, band, min_hold, ce.top_n from ce join ax using (window_id) join gr using (variant, execution, top_n, floor, month)
    where not exists (select 1 from off where off.month = ax.month and off.average = ce.average)
    union all select cell, i, 0, 0, 1, rebalance, band, min_hold, top_n from ce join ax using (window_id)),
bo as (
    select cell, 0::bigint as i, 0::bigint as number, 0::double as weight, 0::bigint as age from ce
    union all
    select cell, i, number, count(*) over w / top_n::double * case when coalesce(sum(raw) over w, 0) > 0 then coalesce(raw, 0) / sum(raw) over w else 1 / count(*) over w end as weight, age
    from (select *, row_number() over (partition by cell, number = 0 order by stays desc, place) as k from (
        select m.*, case when rebalance = 'min_hold' then coalesce(p.age, 0) + 1 else 1 end as age,
            p.number is not null and (rebalance = 'banded' and m.place <= m.top_n + band or rebalance = 'min_hold' and p.age + 1 < greatest(min_hold, 1)) as stays
        from bo s join mm m on m.cell = s.cell and m.i = s.i + 1 left join bo p on p.cell = m.cell and p.number = m.number where s.number = 0))
    where number = 0 or k <= top_n window w as (partition by cell, number = 0)),
bn as materialized (select * from bo where number <> 0),
mv as (select coalesce(a.cell, b.cell) as cell, coalesce(a.i, b.i + 1) as i, coalesce(a.number, b.number) as number, a.weight, b.weight as was
    from bn a full outer join bn b on a.cell = b.cell and a.number = b.number and a.i = b.i + 1),
mc as (select mv.cell, mv.i, weight, was, case execution when 'next_open' then ret else ret_close end as gain, execution, top_n, median_value, close_sek, currency
    from mv join ce using (cell) join ax on ax.window_id = ce.window_id and ax.i = mv.i left join one on one.number = mv.number and one.month = ax.month),
cs(scenario, extra) as (values {", ".join(f"('{c}', {b}::double)" for c, b in universe.CURRENCY_BPS.items())}),
co as (select mc.*, scenario, coalesce(case execution {" ".join(f"when '{e}' then {_cost(str(i), 'extra')}" for e, i in universe.IMPACT.items())} end, 0) as part from mc, cs),
sn as materialized (select ce.cell, ce.variant, ce.execution, ce.top_n, ce.strategy_id, ce.window_id, cs.scenario, ax.month, coalesce(sum(weight * gain), 0) as gross,
    coalesce(sum(case when was is null then weight when weight is null then was end * part), 0) as cost, coalesce(sum(weight * gain), 0) - coalesce(sum(case when was is null then weight when weight is null then was end * part), 0) as net,
    count(*) filter (was is null and weight is not null) as entries, count(*) filter (weight is null and was is not null) as exits, count(weight) as held
    from ce join ax using (window_id) cross join cs left join co on co.cell = ce.cell and co.i = ax.i and co.scenario = cs.scenario group by all)"""


def off(spark, sf_dir):
    """Months in which the primary benchmark is below its average, and of which lengths."""
    prices = market.benchmark_prices(spark, sf_dir).where("benchmark_id = 'primary'")
    return strategies.trend_off(prices, monthly(spark, sf_dir).select("month").distinct(), tuple(sorted({s.average for s in STRATEGIES if s.average})))


def returns(spark, sf_dir):
    """Months of every strategy, size, variant, execution, currency scenario and window."""

    def make():
        rows = scored(spark, sf_dir).where(f"lookback = {LOOKBACK} and skip = {SKIP}")
        points = spark.createDataFrame([(LOOKBACK, SKIP, n) for n in SIZES], "lookback int, skip int, top_n int")
        spans = spark.createDataFrame(WINDOWS, "window_id int, first int, last int")
        return strategies.strategy_returns(rows, points, spans, off(spark, sf_dir), REASONS)

    return kept(spark, sf_dir, "strategies", make)


def _judged(rows, *by):
    """Months, figures and costs of the series that ``by`` names."""
    net = F.col("net")
    curve = Window.partitionBy(*by).orderBy("month")
    equity = rows.withColumn("equity", F.product(1 + net).over(curve))
    fall = 1 - F.col("equity") / F.greatest(F.lit(1.0), F.max("equity").over(curve))
    return equity.withColumn("fall", fall).groupBy(*by).agg(
        F.count("*").alias("months"), F.count_if(F.col("held") == 0).alias("months_out"), F.sum("entries").alias("entries"), F.sum("exits").alias("exits"),
        F.round(stats.sharpe(net), 6).alias("sharpe"), F.round(stats.total_return(net), 6).alias("total_return"), F.round(F.max("fall"), 6).alias("max_drawdown"), F.round(F.sum("cost"), 10).alias("cost"),
    )


_JUDGED = f"""count(*) as months, count(*) filter (held = 0) as months_out, sum(entries)::bigint as entries, sum(exits)::bigint as exits, round({_SHARPE.format("net", 12)}, 6) as sharpe,
    round(product(1 + net) - 1, 6) as total_return, round(max(1 - equity / peak), 6) as max_drawdown, round(sum(cost), 10) as cost"""


def _curves(by: str) -> str:
    return f"""eq as (select *, product(1 + net) over (partition by {by} order by month) as equity from sn),
pk as (select *, greatest(1.0, max(equity) over (partition by {by} order by month)) as peak from eq)"""


@query(f"""{_STRATEGIES},
{_curves("cell, scenario")}
select variant, execution, top_n, strategy_id, window_id, scenario, {_JUDGED} from pk group by cell, scenario, variant, execution, top_n, strategy_id, window_id""")
def strategy_cube(spark, sf_dir):
    """The 28 strategies at six sizes in every variant, execution, currency scenario and window.

    Each window begins without a book. Rows with a window of 0 are of all folds' years in one go.
    """
    return _judged(returns(spark, sf_dir), *CELL, "scenario")


#: Runs of either control, resamples of each run, the seeds, blocks, and the largest share of runs that may be as good as the candidate; the control that gates.
SHUFFLES, BLOCK_RUNS, RESAMPLES, SHUFFLE_SEED, BLOCK_SEED, RESAMPLE_SEED, BLOCK, LARGEST_RATE = 500, 200, 250, 11, 17, 23, 6, 0.20
GATED = "cross_sectional_shuffle"
TRIALS = len(STRATEGIES) * len(SIZES)
_IDS = "[" + ", ".join(f"'{s.strategy_id}'" for s in STRATEGIES) + "]"
_PRIMARY = "variant = 'full' and execution = 'next_open' and scenario = 'base' and window_id > 0"


def candidate(spark, sf_dir):
    """The candidate that controls look at: the best median Sharpe ratio over the folds, the first in the grid's order of several; one row with its strategy."""

    def make():
        folds = returns(spark, sf_dir).where(_PRIMARY).groupBy("strategy_id", "top_n", "window_id").agg(stats.sharpe(F.col("net")).alias("sharpe"))
        middle = folds.groupBy("strategy_id", "top_n").agg(F.round(F.percentile("sharpe", 0.5), 9).alias("median_sharpe"))
        place = F.array_position(F.array(*[F.lit(s.strategy_id) for s in STRATEGIES]), F.col("strategy_id"))
        best = middle.orderBy(F.desc("median_sharpe"), "top_n", place).limit(1)
        return best.join(F.broadcast(spark.createDataFrame(list(STRATEGIES))), "strategy_id")

    return kept(spark, sf_dir, "candidate", make)


def _benchmark(spark, sf_dir):
    """month and base: what the primary benchmark returns over the month after."""
    from strandline.plans.queries import benchmark_returns

    return benchmark_returns(spark, sf_dir).where("benchmark_id = 'primary'").select((F.col("month") - 1).alias("month"), F.col("ret").alias("base"))


def _controls(spark, sf_dir):
    def make():
        chosen = F.broadcast(candidate(spark, sf_dir).select("strategy_id", "top_n", "weighting", "average", "floor"))  # one row
        lo, hi = min(w[1] for w in WINDOWS if w[0]), max(w[2] for w in WINDOWS if w[0])
        rows = scored(spark, sf_dir).where(f"lookback = {LOOKBACK} and skip = {SKIP} and month between {lo} and {hi}")
        axis = rows.where("ret is not null or ret_close is not null").select("month").distinct().crossJoin(chosen)
        able = rows.where("reason = '' and score is not null and ret is not null").crossJoin(chosen).where(universe.within_capacity(F.col("top_n")) & (F.col("median_value") >= F.col("floor")))
        cap, vol = F.when(F.col("market_cap_sek") > 0, F.col("market_cap_sek")), F.when(F.col("volatility") > 0, 1 / F.col("volatility"))
        raw = F.when(F.col("weighting") == "cap", cap).when(F.col("weighting") == "inv_vol", vol).otherwise(1.0)
        by = ["strategy_id", "top_n"]
        is_on = ~F.coalesce(F.array_contains("off", F.col("average")), F.lit(False))
        months = axis.join(F.broadcast(off(spark, sf_dir)), "month", "left").select(*by, "month", is_on.alias("is_on"))
        in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("month", c))), lambda x: x[c])
        shuffled = controls.selected(able.select(*by, "month", "number", "score", "ret", raw.cast("double").alias("raw")), months, by, SHUFFLES, SHUFFLE_SEED).groupBy(*by, "run").agg(in_order("excess").alias("rets")).withColumn("control", F.lit(GATED))
        net = returns(spark, sf_dir).where(_PRIMARY).join(chosen.select(*by), by).join(F.broadcast(_benchmark(spark, sf_dir)), "month", "left")
        both = net.groupBy(*by).agg(F.count("base").alias("known"), F.count("*").alias("months"), in_order("net").alias("own"), in_order("base").alias("base"))
        excess = F.when(F.col("known") == F.col("months"), F.zip_with("own", "base", lambda a, b: F.round(a - b, 12))).otherwise(F.transform("own", lambda a: F.round(a, 12)))
        blocks = controls.block_orders(both.select(*by, excess.alias("rets")), by, F.col("strategy_id"), BLOCK_RUNS, BLOCK, BLOCK_SEED).withColumn("control", F.lit("block_shuffled_null"))
        found = controls.figures(shuffled.unionByName(blocks), ["control", *by], RESAMPLES, float(BLOCK), RESAMPLE_SEED, TRIALS)
        return controls.passed(found, ["control", *by])

    return kept(spark, sf_dir, "strategy controls", make)


_CONTROLS = f"""{_STRATEGIES},
fs as (select strategy_id, top_n, window_id, {_SHARPE.format("net", 12)} as sharpe from sn where {_PRIMARY} group by 1, 2, 3),
fo as (select strategy_id, top_n, round(median(sharpe), 9) as middle from fs group by 1, 2),
cd as materialized (select fo.*, weighting, average, floor from fo join st using (strategy_id) order by middle desc, top_n, list_position({_IDS}, strategy_id) limit 1),
cx as materialized (select distinct month from one where (ret is not null or ret_close is not null) and month between {min(w[1] for w in WINDOWS if w[0])} and {max(w[2] for w in WINDOWS if w[0])}),
cn as materialized (select month, number, score, ret, {_RAW} as raw, top_n, avg(ret) over (partition by month) as base from one, cd where reason = '' and score is not null and ret is not null and {_CAPACITY} and median_value >= floor),
cr as (select run, month, ret, raw, base, top_n, row_number() over (partition by run, month order by case when run = 0 then score end desc nulls last, case when run > 0 then md5(concat_ws(':', {SHUFFLE_SEED}, run, month, number)) end, number) as k
    from cn, (select unnest(range({SHUFFLES + 1})) as run) where month in (select month from cx)),
cg as (select run, month, round(sum(part * ret) * count(*) / any_value(top_n) - any_value(base), 12) as excess
    from (select *, case when coalesce(sum(raw) over w, 0) > 0 then coalesce(raw, 0) / sum(raw) over w else 1 / count(*) over w end as part from cr where k <= top_n window w as (partition by run, month)) group by 1, 2),
cy as (select '{GATED}' as control, r.run, cx.month, case when exists (select 1 from off, cd where off.month = cx.month and off.average = cd.average) then 0 else coalesce(excess, 0) end as ret
    from cx cross join (select unnest(range({SHUFFLES + 1})) as run) r left join cg on cg.run = r.run and cg.month = cx.month),
bk1 as (select month, row_number() over (order by month) - 1 as i, round(net - base, 12) as x, round(net, 12) as y, base is null as lost from (select sn.month, net, round(z.level / t.level - 1, 6) as base from sn join cd using (strategy_id, top_n)
    left join p1 t on t.month = sn.month + 1 left join p1 z on z.month = sn.month + 2 where {_PRIMARY})),
bz as (select run, i, case when (select bool_or(lost) from bk1) then y else x end as ret, case when run > 0 then md5(concat_ws(':', {BLOCK_SEED}, run, (select strategy_id from cd), (i // {BLOCK})::int)) else '' end as digest from bk1, (select unnest(range({BLOCK_RUNS + 1})) as run)),
by_ as (select 'block_shuffled_null' as control, run, row_number() over (partition by run order by digest, i) as month, ret from bz),
ca as materialized (select *, row_number() over (partition by control, run order by month) - 1 as i, count(*) over (partition by control, run) as n from (select * from cy union all select * from by_)),
d0 as (select control, run, i, n, resample, md5(concat_ws(':', {RESAMPLE_SEED}, control, (select strategy_id from cd), (select top_n from cd), run, resample, i)) as digest from ca, (select unnest(range({RESAMPLES})) as resample)),
d1 as (select control, run, i, n, resample, case when i = 0 or ('0x' || substr(digest, 1, 12))::bigint / 281474976710656.0::double < {1 / BLOCK!r}::double
    then floor(('0x' || substr(digest, 13, 12))::bigint / 281474976710656.0::double * n)::bigint - i end as place from d0),
d2 as (select *, last_value(place ignore nulls) over (partition by control, run, resample order by i) + i as at from d1),
d3 as (select d.control, d.run, d.resample, {_SHARPE.format("s.ret", 12)} as sharpe from d2 d join ca s on s.control = d.control and s.run = d.run and s.i = ((d.at % d.n) + d.n) % d.n group by 1, 2, 3),
lw as (select control, run, round(quantile_cont(sharpe, 0.025), 9) as low from d3 group by 1, 2),
dg as (select control, run, count(*) as n, avg(ret) as m, nullif(stddev_samp(ret), 0) as s from ca group by 1, 2),
dh as (select control, run, any_value(dg.n) as n, any_value(m / s) as r, sum(pow((ret - m) / s, 3)) / any_value(dg.n) as k3, sum(pow((ret - m) / s, 4)) / any_value(dg.n) as k4 from ca join dg using (control, run) group by 1, 2),
cf as materialized (select control, strategy_id, top_n, run, round(coalesce(r * sqrt(12), 0), 9) as sharpe, low, round(coalesce(r - sqrt(greatest(1 - k3 * r + (k4 - 1) / 4 * r * r, 1e-12) / (n - 1)) * {stats.expected_maximum(TRIALS)!r}::double, 0), 9) as deflated from dh join lw using (control, run), cd),
cp as materialized (select a.*, a.sharpe >= o.sharpe and a.low >= o.low and a.deflated >= o.deflated as passed, o.sharpe as own_sharpe, o.low as own_low, o.deflated as own_deflated from cf a join (select * from cf where run = 0) o using (control))"""


@query(f"{_CONTROLS} select control, strategy_id, top_n, run, round(sharpe, 6) as sharpe, round(low, 6) as low, round(deflated, 6) as deflated, passed from cp")
def control_figures(spark, sf_dir):
    """The chosen candidate and its controls, 500 shuffles and 200 orders of blocks, each with three figures, and whether all three are as good as its own."""
    six = [F.round(c, 6).alias(c) for c in ("sharpe", "low", "deflated")]
    return _controls(spark, sf_dir).select("control", "strategy_id", "top_n", F.col("run").cast("long").alias("run"), *six, "passed")


@query(f"""{_CONTROLS}
select control, strategy_id, top_n, count(*) as runs, count(*) filter (sharpe >= own_sharpe) as by_sharpe, count(*) filter (low >= own_low) as by_interval, count(*) filter (deflated >= own_deflated) as by_deflated, count(*) filter (passed) as passed,
    round(avg(passed::int), 6) as pass_rate, control = '{GATED}' as gates, avg(passed::int) <= {LARGEST_RATE} as accepted from cp where run > 0 group by 1, 2, 3""")
def control_gate(spark, sf_dir):
    """Of either control the runs that are as good as the candidate, by each figure and by all, and the gate on their share."""
    rate = F.avg(F.col("passed").cast("int"))
    better = {"by_sharpe": "sharpe", "by_interval": "low", "by_deflated": "deflated"}
    return _controls(spark, sf_dir).where("run > 0").groupBy("control", "strategy_id", "top_n").agg(
        F.count("*").alias("runs"), *[F.count_if(F.col(c) >= F.col(f"own_{c}")).alias(n) for n, c in better.items()], F.count_if("passed").alias("passed"),
        F.round(rate, 6).alias("pass_rate"), (F.first("control") == GATED).alias("gates"), (rate <= LARGEST_RATE).alias("accepted"),
    )


#: The Sharpe ratio that a fold must pass and how many folds must; resamples of each candidate's own interval, and their seed; bands of the probability of overfitting.
FOLD_SHARPE, FOLDS_REQUIRED, OWN_RESAMPLES, OWN_SEED, PBO_GOOD, PBO_CUTOFF = 0.4, 3, 2000, 42, 0.30, 0.50
PLATEAU_RATIO = 0.7
FOLD_COUNT = len([w for w in WINDOWS if w[0]])
NEIGHBOURS = [(SIZES[k], SIZES[j]) for k in range(len(SIZES)) for j in (k - 1, k + 1) if 0 <= j < len(SIZES)]
PROFILE = [
    "candidate_id", "strategy_id", "top_n", "place", "fold_passes", "median_sharpe", "overall_sharpe", "total_return", "max_drawdown", "deflated", "probability", "low", "high", "spread",
    "neighbour_sharpe", "neighbour_ratio", "gate_folds", "gate_deflated", "gate_bootstrap", "gate_controls", "gate_plateau", "gate_ratio", "reasons", "pbo", "pbo_band", "selected", "selection_status",
]


def _aggregates(spark, sf_dir):
    """Every candidate's figures over the folds of the primary track, and those of its neighbours in size."""
    by, net = ["strategy_id", "top_n"], F.col("net")
    rows = returns(spark, sf_dir).where("execution = 'next_open' and scenario = 'base' and window_id > 0")
    main = rows.where("variant = 'full'")
    folds = main.groupBy(*by, "window_id").agg(stats.sharpe(net).alias("sharpe"))
    folds = folds.groupBy(*by).agg(F.round(F.percentile("sharpe", 0.5), 6).alias("median_sharpe"), F.count_if(F.col("sharpe") > FOLD_SHARPE).alias("fold_passes"))
    overall = _judged(main, *by).select(*by, F.col("sharpe").alias("overall_sharpe"), "total_return", "max_drawdown")
    arrays = main.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("month", "net"))), lambda x: x["net"]).alias("rets"))
    resampled = validation.bootstrap_sharpes(arrays, by, F.concat_ws(":", *by), OWN_RESAMPLES, float(BLOCK), OWN_SEED)
    interval = resampled.groupBy(*by).agg(F.round(F.percentile("sharpe", 0.025), 6).alias("low"), F.round(F.percentile("sharpe", 0.975), 6).alias("high"))
    noise = stats.deflated(main, by, "net", TRIALS).select(*by, F.round("score", 6).alias("deflated"), F.round("probability", 6).alias("probability"))
    variants = rows.groupBy(*by, "variant").agg(stats.sharpe(net).alias("sharpe"), F.count_distinct("window_id").alias("folds")).where(F.col("folds") == FOLD_COUNT)
    spread = variants.groupBy(*by).agg(F.when(F.count("*") < len(REASONS), float("inf")).otherwise(F.round(F.stddev_pop("sharpe"), 6)).alias("spread"))
    out = folds.join(overall, by).join(interval, by).join(noise, by).join(spread, by)
    pairs = F.broadcast(spark.createDataFrame(NEIGHBOURS, "top_n int, other int"))
    around = folds.select("strategy_id", F.col("top_n").alias("other"), "median_sharpe").join(pairs, "other").groupBy(*by).agg(F.round(F.percentile("median_sharpe", 0.5), 7).alias("neighbour_sharpe"))
    return out.join(around, by)


def _profile(spark, sf_dir):
    """The stages of a run, each written once for a state of the tables: returns and controls (kept), then figures, overfitting, and what is selected under all verdicts."""
    figures = stage(spark, sf_dir, "profile figures", lambda: _aggregates(spark, sf_dir))
    names = F.concat_ws("_n", "strategy_id", "top_n")
    main = returns(spark, sf_dir).where(_PRIMARY).select(names.alias("candidate_id"), "month", "net")
    splits = stage(spark, sf_dir, "profile overfitting", lambda: validation.overfitting(main))
    gate = control_gate(spark, sf_dir).where("gates").select("accepted").limit(1)

    def make():
        own, median = F.col("neighbour_sharpe"), F.col("median_sharpe")
        rows = figures.crossJoin(F.broadcast(gate.select(F.col("accepted").alias("gate_controls"))))
        rows = rows.withColumns({
            "candidate_id": names, "neighbour_ratio": F.round(F.when(median == 0, 0.0).otherwise(own / median), 6), "gate_folds": F.col("fold_passes") >= FOLDS_REQUIRED,
            "gate_deflated": F.col("deflated") > 0, "gate_bootstrap": F.col("low") > 0, "gate_plateau": own >= 0,
        })
        hard = F.col("gate_folds") & F.col("gate_deflated") & F.col("gate_bootstrap") & F.col("gate_controls")
        ordinal = F.array_position(F.array(*[F.lit(s.strategy_id) for s in STRATEGIES]), F.col("strategy_id"))
        order = [F.desc(hard.cast("int")), F.desc("median_sharpe"), "spread", F.desc("neighbour_sharpe"), F.desc("neighbour_ratio"), "max_drawdown", "top_n", ordinal]
        rows = rows.withColumns({"gate_ratio": F.col("neighbour_ratio") >= PLATEAU_RATIO, "place": F.row_number().over(Window.orderBy(*order)), "hard": hard})  # a row for each point of the grid
        pbo = splits.agg(F.round(F.avg((F.round("logit", 9) <= 0).cast("int")), 6).alias("pbo"))
        band = F.when(F.col("pbo").isNull(), "n/a").when(F.col("pbo") < PBO_GOOD, "good").when(F.col("pbo") < PBO_CUTOFF, "caution").otherwise("hard_cutoff")
        rows = rows.crossJoin(F.broadcast(pbo)).withColumn("pbo_band", band)
        any_ = F.max(F.when(F.col("place") == 1, F.col("hard"))).over(Window.partitionBy(F.lit(1)))
        status = F.when(F.col("pbo_band") == "hard_cutoff", "pbo_hard_cutoff").when(~any_, "no_candidate_passed_hard_gates").when(F.col("pbo_band") == "caution", "selected_with_caution").otherwise("selected")
        reasons = F.concat_ws(",", *[F.when(~F.col(g), n) for g, n in (("gate_folds", "folds"), ("gate_deflated", "deflated"), ("gate_bootstrap", "interval"), ("gate_controls", "controls"))])
        rows = rows.withColumns({"reasons": reasons, "selection_status": status, "selected": (F.col("place") == 1) & F.col("hard") & (F.col("pbo_band") != "hard_cutoff")})
        return rows.select(*PROFILE)

    return stage(spark, sf_dir, "profile selection", make)


_RUN = f"""{_CONTROLS},
net as (select strategy_id || '_n' || top_n as candidate_id, month, net from sn where {_PRIMARY}){_SPLITS.removeprefix(_RETURNS).rstrip()},
pm as (select strategy_id, top_n, month, net, row_number() over (partition by strategy_id, top_n order by month) - 1 as i, count(*) over (partition by strategy_id, top_n) as n from sn where {_PRIMARY}),
pf as (select strategy_id, top_n, round(median(sharpe), 6) as median_sharpe, count(*) filter (sharpe > {FOLD_SHARPE}) as fold_passes from fs group by 1, 2),
pe as (select *, product(1 + net) over (partition by strategy_id, top_n order by month) as equity from pm),
pk as (select *, greatest(1.0, max(equity) over (partition by strategy_id, top_n order by month)) as peak from pe),
po as (select strategy_id, top_n, round({_SHARPE.format("net", 12)}, 6) as overall_sharpe, round(product(1 + net) - 1, 6) as total_return, round(max(1 - equity / peak), 6) as max_drawdown from pk group by 1, 2),
q0 as (select strategy_id, top_n, i, n, resample, md5(concat_ws(':', {OWN_SEED}, strategy_id, top_n, resample, i)) as digest from pm, (select unnest(range({OWN_RESAMPLES})) as resample)),
q1 as (select strategy_id, top_n, i, n, resample, case when i = 0 or ('0x' || substr(digest, 1, 12))::bigint / 281474976710656.0::double < {1 / BLOCK!r}::double
    then floor(('0x' || substr(digest, 13, 12))::bigint / 281474976710656.0::double * n)::bigint - i end as place from q0),
q2 as (select *, last_value(place ignore nulls) over (partition by strategy_id, top_n, resample order by i) + i as at from q1),
q3 as (select d.strategy_id, d.top_n, d.resample, {_SHARPE.format("s.net", 12)} as sharpe from q2 d join pm s on s.strategy_id = d.strategy_id and s.top_n = d.top_n and s.i = ((d.at % d.n) + d.n) % d.n group by 1, 2, 3),
pi as (select strategy_id, top_n, round(quantile_cont(sharpe, 0.025), 6) as low, round(quantile_cont(sharpe, 0.975), 6) as high from q3 group by 1, 2),
pg as (select strategy_id, top_n, count(*) as n, avg(net) as m, nullif(stddev_samp(net), 0) as s from pm group by 1, 2),
ph as (select strategy_id, top_n, any_value(pg.n) as n, any_value(m / s) as r, sum(pow((net - m) / s, 3)) / any_value(pg.n) as k3, sum(pow((net - m) / s, 4)) / any_value(pg.n) as k4 from pm join pg using (strategy_id, top_n) group by 1, 2),
px1 as (select strategy_id, top_n, r, sqrt(greatest(1 - k3 * r + (k4 - 1) / 4 * r * r, 1e-12) / (n - 1)) as d from ph),
px2 as (select strategy_id, top_n, r - d * {stats.expected_maximum(TRIALS)!r}::double as score, (r - d * {stats.expected_maximum(TRIALS)!r}::double) / d as x from px1),
pd as (select strategy_id, top_n, round(coalesce(score, 0), 6) as deflated, round(coalesce(case when x > 0 then 1 - {_TAIL} else {_TAIL} end, 0), 6) as probability from px2),
pv as (select strategy_id, top_n, variant, {_SHARPE.format("net", 12)} as sharpe from sn where execution = 'next_open' and scenario = 'base' and window_id > 0 group by 1, 2, 3 having count(distinct window_id) = {FOLD_COUNT}),
ps as (select strategy_id, top_n, case when count(*) < {len(REASONS)} then 'infinity'::double else round(stddev_pop(sharpe), 6) end as spread from pv group by 1, 2),
pn as (select f.strategy_id, a as top_n, round(median(median_sharpe), 7) as neighbour_sharpe from pf f join (values {", ".join(map(str, NEIGHBOURS))}) t(a, b) on f.top_n = t.b group by 1, 2),
pa as (select *, round(case when median_sharpe = 0 then 0 else neighbour_sharpe / median_sharpe end, 6) as neighbour_ratio, fold_passes >= {FOLDS_REQUIRED} as gate_folds, deflated > 0 as gate_deflated, low > 0 as gate_bootstrap,
    (select avg(passed::int) <= {LARGEST_RATE} from cp where run > 0 and control = '{GATED}') as gate_controls, neighbour_sharpe >= 0 as gate_plateau
    from pf join po using (strategy_id, top_n) join pi using (strategy_id, top_n) join pd using (strategy_id, top_n) join ps using (strategy_id, top_n) join pn using (strategy_id, top_n)),
pr as (select *, gate_folds and gate_deflated and gate_bootstrap and gate_controls as hard, row_number() over (order by (gate_folds and gate_deflated and gate_bootstrap and gate_controls)::int desc, median_sharpe desc, spread, neighbour_sharpe desc,
    neighbour_ratio desc, max_drawdown, top_n, list_position({_IDS}, strategy_id)) as place from pa),
pb as (select round(avg((round(logit, 9) <= 0)::int), 6) as pbo from sp),
pc as (select pbo, case when pbo is null then 'n/a' when pbo < {PBO_GOOD} then 'good' when pbo < {PBO_CUTOFF} then 'caution' else 'hard_cutoff' end as pbo_band, (select hard from pr where place = 1) as best from pb)"""


@query(f"""{_RUN}
select strategy_id || '_n' || top_n as candidate_id, strategy_id, top_n, place, fold_passes, median_sharpe, overall_sharpe, total_return, max_drawdown, deflated, probability, low, high, spread, neighbour_sharpe, neighbour_ratio,
    gate_folds, gate_deflated, gate_bootstrap, gate_controls, gate_plateau, neighbour_ratio >= {PLATEAU_RATIO} as gate_ratio,
    concat_ws(',', case when not gate_folds then 'folds' end, case when not gate_deflated then 'deflated' end, case when not gate_bootstrap then 'interval' end, case when not gate_controls then 'controls' end) as reasons,
    pbo, pbo_band, place = 1 and hard and pbo_band <> 'hard_cutoff' as selected,
    case when pbo_band = 'hard_cutoff' then 'pbo_hard_cutoff' when not best then 'no_candidate_passed_hard_gates' when pbo_band = 'caution' then 'selected_with_caution' else 'selected' end as selection_status from pr, pc""")
def profile_run(spark, sf_dir):
    """A whole run over 168 candidates: figures, controls, plateaus, overfitting, ranks, and the one selected unless a verdict stands against it.

    Its stages are found again by a later process, so a run that was stopped goes on.
    """
    return _profile(spark, sf_dir)


@query(f"""{_STRATEGIES},
ks2 as (select strategy_id from st where average > 0 and (rebalance <> 'full' or weighting <> 'equal')),
{_curves("cell").replace("from sn)", "from sn join ks2 using (strategy_id) where variant = 'full' and execution = 'next_open' and scenario = 'base' and window_id = 0)")}
select strategy_id, top_n, {_JUDGED} from pk group by 1, 2""")
def combined_strategies(spark, sf_dir):
    """Trend gates together with another renewal or weighting than the usual, over all folds' years in one go (PF20)."""
    names = [s.strategy_id for s in strategies.matching(STRATEGIES, combined=True)]
    rows = returns(spark, sf_dir).where("variant = 'full' and execution = 'next_open' and scenario = 'base' and window_id = 0").where(F.col("strategy_id").isin(names))
    return _judged(rows, "strategy_id", "top_n")


#: The window that is the holdout, and the least Sharpe ratio there.
HOLDOUT_WINDOW, HOLDOUT_SHARPE = FOLDS[-1][0], 0.3


@query(f"""{_STRATEGIES},
hn as (select * from sn where window_id = {HOLDOUT_WINDOW}),
{_curves("cell, scenario").replace("from sn)", "from hn)")},
hb2 as (select round(product(1 + round(z.level / t.level - 1, 6)) - 1, 6) as benchmark_return, count(*) = (select count(distinct month) from hn) as complete
    from (select distinct month from hn) m join p1 t on t.month = m.month + 1 join p1 z on z.month = m.month + 2),
hc as (select variant, execution, scenario, strategy_id, top_n, {_JUDGED} from pk group by cell, scenario, variant, execution, strategy_id, top_n)
select hc.*, case when complete then benchmark_return end as benchmark_return, coalesce(complete and total_return > benchmark_return, false) as beats, coalesce(complete and total_return > benchmark_return and sharpe >= {HOLDOUT_SHARPE}, false) as eligible,
    variant = 'full' and execution = 'next_open' and scenario = 'base' as is_primary from hc, hb2""")
def holdout_cells(spark, sf_dir):
    """Every strategy and size on the holdout in each variant, execution and currency scenario, selected within the variant and after costs, against the primary benchmark, and whether it is eligible."""
    rows = returns(spark, sf_dir).where(f"window_id = {HOLDOUT_WINDOW}")
    months = rows.select("month").distinct().join(_benchmark(spark, sf_dir), "month", "left")
    bench = months.agg(F.when(F.count("base") == F.count("*"), F.round(F.product(1 + F.col("base")) - 1, 6)).alias("benchmark_return"))
    cells = _judged(rows, "variant", "execution", "scenario", "strategy_id", "top_n").crossJoin(F.broadcast(bench))
    beats = F.coalesce(F.col("total_return") > F.col("benchmark_return"), F.lit(False))
    primary = (F.col("variant") == "full") & (F.col("execution") == "next_open") & (F.col("scenario") == "base")
    return cells.withColumns({"beats": beats, "eligible": beats & (F.col("sharpe") >= HOLDOUT_SHARPE), "is_primary": primary})
