"""Registered queries that evaluate the grid over variants, executions and currency scenarios, rank it, and report on the outcome."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions import stats
from strandline.operators import portfolio, universe, validation
from strandline.plans.holdout import _SHARPE, HOLDOUT, TRIALS, WINDOWS
from strandline.plans.queries import _CAPACITY, _DAILY, _RAW, _RETURNS, _SCORED, _UNIVERSE, FOLDS, _cost, _rounded, _weight, backtest, book, daily, facts, folds, grid, monthly, query, scored
from strandline.plans.research import _LEVELS, AVERAGES, _levels
from strandline.sources import market
from strandline.storage import kept

#: Variants of the universe and their reasons; gates on a fold's Sharpe ratio and on how many folds pass; limits of the audit.
REASONS = {"full": "reason", "se_only": "reason_se"}
FOLD_SHARPE, FOLDS_REQUIRED = 0.4, 3
CONCENTRATED, WATCHED_PART, HIGH_TURNOVER = 0.60, 0.005, 0.40
#: Bands of the probability of overfitting; windows of crises in these tables' years; sub-periods (month ordinals).
GOOD, BLOCKED = 0.30, 0.50
CRISES = {"asia 1997-1998": (1997 * 12 + 6, 1998 * 12 + 9), "dotcom 2000-2001": (2000 * 12 + 2, 2001 * 12 + 8)}
SUB_PERIODS = {"1995-1996": (1995 * 12, 1996 * 12 + 11), "1997-1998": (1997 * 12, 1998 * 12 + 11), "1999-2000": (1999 * 12, 2000 * 12 + 11), "2001-end": (2001 * 12, 9999 * 12)}
#: Largest differences between two profiles of one candidate.
APART = {"sharpe": 0.15, "max_drawdown": 0.05, "total_return": 0.10}
SEED, TRIM, SAMPLED = 7, 0.05, 20
#: Shuffled runs that are tested as controls, and resamples of each; lengths of the trend gate's average.
CONTROLS, CONTROL_RESAMPLES = 100, 250

_CUBE = f"""{_SCORED},
ce as (select * from (values {", ".join(f"('{e}', '{c}', {i}::double, {b}::double)" for e, i in universe.IMPACT.items() for c, b in universe.CURRENCY_BPS.items())}) c(execution, scenario, impact, extra)),
vs as ({" union all ".join(f"select sc.*, '{v}' as variant from sc where {r} = ''" for v, r in REASONS.items())}),
xs as (select vs.*, 'next_open' as execution, ret as gain from vs union all select vs.*, 'next_close', ret_close from vs),
xr as (select *, row_number() over (partition by variant, execution, lookback, skip, top_n, month order by score desc, number) as place
    from (select xs.*, top_n from xs, (select distinct top_n from grid)) where score is not null and gain is not null and {_CAPACITY}),
xb0 as (select variant, execution, candidate_id, month, number, top_n, gain, {_RAW} as raw from xr join grid using (lookback, skip, top_n) where place <= top_n),
xb as materialized (select *, {_weight("variant, execution, candidate_id, month")} as weight from xb0),
xm as (select coalesce(a.variant, b.variant) as variant, coalesce(a.execution, b.execution) as execution, coalesce(a.candidate_id, b.candidate_id) as candidate_id, coalesce(a.month, b.month + 1) as month,
    coalesce(a.number, b.number) as number, coalesce(a.top_n, b.top_n) as top_n, a.weight, b.weight as was, a.gain
    from xb a full outer join xb b on a.variant = b.variant and a.execution = b.execution and a.candidate_id = b.candidate_id and a.number = b.number and a.month = b.month + 1),
xc as (select xm.*, scenario, coalesce({_cost("impact", "extra")}, 0) as one from xm join ce using (execution) left join (select number, month, median_value, close_sek, currency from uni) u using (number, month)),
xn as materialized (select o.variant, o.execution, e.scenario, g.candidate_id, o.month, coalesce(sum(weight * gain), 0) as gross,
    coalesce(sum(case when was is null then weight when weight is null then was end * one), 0) as cost, gross - cost as net
    from grid g cross join (select distinct variant, execution, month from xb) o join ce e using (execution)
    left join xc on xc.variant = o.variant and xc.execution = o.execution and xc.scenario = e.scenario and xc.candidate_id = g.candidate_id and xc.month = o.month group by 1, 2, 3, 4, 5),
hv as (select * from (values {", ".join(map(str, FOLDS))}) f(fold_id, train_from, train_to, test_from, test_to))"""


def cube(spark, sf_dir):
    """variant, execution, scenario, candidate_id, month, gross, cost, net, ... of every cell of the grid."""

    def make():
        variants = F.array_compact(F.array(*[F.when(F.col(r) == "", F.lit(v)) for v, r in REASONS.items()]))
        gains = F.array(*[F.struct(F.lit(e).alias("execution"), F.col(r).alias("ret")) for e, r in (("next_open", "ret"), ("next_close", "ret_close"))])
        rows = scored(spark, sf_dir).where("score is not null").withColumn("variant", F.explode(variants)).withColumn("gain", F.explode(gains))
        rows = rows.withColumn("ret", F.col("gain.ret")).withColumn("execution", F.col("gain.execution")).drop("gain")
        names = portfolio.books(rows, grid(spark), "ret is not null", ("variant", "execution"))
        cells = F.broadcast(spark.createDataFrame([(c, b) for c, b in universe.CURRENCY_BPS.items()], "scenario string, extra double"))
        impact = F.when(F.col("execution") == "next_open", universe.IMPACT["next_open"]).otherwise(universe.IMPACT["next_close"])
        extra = F.lit(None).cast("double")
        for c, b in universe.CURRENCY_BPS.items():
            extra = F.when(F.col("scenario") == c, b).otherwise(extra)
        keys = ("variant", "execution", "scenario")
        months = names.select("variant", "execution", "month").distinct().crossJoin(cells.drop("extra")).crossJoin(F.broadcast(grid(spark).select("candidate_id")))
        return portfolio.period_returns(names.crossJoin(cells.drop("extra")), universe.tiered_cost_bps(F.col("top_n"), impact, extra) / 1e4, facts(spark, sf_dir), keys, months)

    return kept(spark, sf_dir, "cube", make)


@query(f"""{_CUBE}
select variant, execution, scenario, candidate_id, fold_id, count(*) as months, round({_SHARPE.format("net", 12)}, 6) as sharpe, round(product(1 + net) - 1, 6) as total_return, round(sum(cost), 8) as cost
from xn join hv on month between test_from and test_to group by 1, 2, 3, 4, 5""")
def evaluation_cube(spark, sf_dir):
    """Every candidate in every fold, variant, execution and currency scenario, after tiered costs within capacity."""
    rows = cube(spark, sf_dir).join(F.broadcast(folds(spark)), F.col("month").between(F.col("test_from"), F.col("test_to")))
    r = F.col("net")
    out = rows.groupBy("variant", "execution", "scenario", "candidate_id", "fold_id").agg(
        F.count("*").alias("months"), F.round(stats.sharpe(r), 6).alias("sharpe"), F.round(stats.total_return(r), 6).alias("total_return"), F.round(F.sum("cost"), 8).alias("cost")
    )
    return out


@query(f"""{_CUBE},
t as (select variant, execution, candidate_id, count(*) as months, {_SHARPE.format("net", 12)} as sharpe, product(1 + net) as growth from xn where scenario = 'base' and month between {HOLDOUT[0]} and {HOLDOUT[1]} group by 1, 2, 3)
select candidate_id, variant, execution, months, round(sharpe, 6) as sharpe, round(case when growth <= 0 then -1 else pow(growth, 12.0 / months) - 1 end, 6) as cagr,
    variant = 'full' and execution = 'next_open' as is_primary,
    row_number() over (partition by candidate_id order by case variant when 'full' then 0 else 1 end, case execution when 'next_open' then 0 else 1 end) as position from t""")
def holdout_tracks(spark, sf_dir):
    """The holdout of every variant and execution at the base scenario, one row a track in a fixed order (IO13, R19)."""
    rows = cube(spark, sf_dir).where(f"scenario = 'base' and month between {HOLDOUT[0]} and {HOLDOUT[1]}")
    r, first = F.col("net"), (F.col("variant") == "full", F.col("execution") == "next_open")
    out = rows.groupBy("candidate_id", "variant", "execution").agg(F.count("*").alias("months"), stats.sharpe(r).alias("sharpe"), stats.cagr(r).alias("cagr"))
    order = Window.partitionBy("candidate_id").orderBy(*[F.when(c, 0).otherwise(1) for c in first])
    out = out.withColumns({"is_primary": first[0] & first[1], "position": F.row_number().over(order)})
    return _rounded(out, "candidate_id", "variant", "execution", "months", "sharpe", "cagr", "is_primary", "position")


@query(f"""{_CUBE},
v as (select variant, candidate_id, {_SHARPE.format("net", 12)} as sharpe from xn join hv on month between test_from and test_to where execution = 'next_open' and scenario = 'base' group by 1, 2),
s as (select candidate_id, case when count(*) < {len(REASONS)} then 'infinity'::double else round(stddev_pop(sharpe), 6) end as spread, count(*) as variants from v group by 1)
select * from s""")
def variant_sensitivity(spark, sf_dir):
    """Population deviation of the Sharpe ratios of the variants over all folds (A13, U17: variants that have rows)."""
    rows = cube(spark, sf_dir).where("execution = 'next_open' and scenario = 'base'").join(F.broadcast(folds(spark)), F.col("month").between(F.col("test_from"), F.col("test_to")))
    each = rows.groupBy("variant", "candidate_id").agg(stats.sharpe(F.col("net")).alias("sharpe"))
    spread = F.when(F.count("*") < len(REASONS), float("inf")).otherwise(F.round(F.stddev_pop("sharpe"), 6))
    return each.groupBy("candidate_id").agg(spread.alias("spread"), F.count("*").alias("variants"))


_MAIN = f"""
fs as (select candidate_id, fold_id, {_SHARPE.format("net", 12)} as sharpe from net join hv on month between test_from and test_to group by 1, 2),
fa as (select candidate_id, round(median(sharpe), 6) as median_sharpe, count(*) filter (sharpe > {FOLD_SHARPE}) as fold_passes from fs group by 1),
cc as (select candidate_id, month, net, product(1 + net) over (partition by candidate_id order by month) as equity from net where month between {FOLDS[0][3]} and {FOLDS[-1][4]}),
cp as (select *, greatest(1.0, max(equity) over (partition by candidate_id order by month)) as peak from cc),
ca as (select candidate_id, round({_SHARPE.format("net", 12)}, 6) as overall_sharpe, round(product(1 + net) - 1, 6) as total_return, round(max(1 - equity / peak), 6) as max_drawdown from cp group by 1),
dg as (select candidate_id, count(*) as n, avg(net) as m, stddev_samp(net) as s from cc group by 1),
dh as (select candidate_id, any_value(n) as n, any_value(m / s) as r, sum(pow((net - m) / s, 3)) / any_value(n) as k3, sum(pow((net - m) / s, 4)) / any_value(n) as k4 from cc join dg using (candidate_id) group by 1),
ds as (select candidate_id, round(coalesce(r - sqrt(greatest(1 - k3 * r + (k4 - 1) / 4 * r * r, 1e-12) / (n - 1)) * {stats.expected_maximum(TRIALS)!r}::double, 0), 6) as deflated from dh),
sp as (select candidate_id, round(stddev_pop(sharpe), 6) as spread from (select variant, candidate_id, {_SHARPE.format("net", 12)} as sharpe from xn join hv on month between test_from and test_to
    where execution = 'next_open' and scenario = 'base' group by 1, 2) group by 1),
gk as (select *, dense_rank() over (order by lookback) as a, dense_rank() over (order by skip) as b, dense_rank() over (order by top_n) as c, dense_rank() over (order by weighting) as d from grid),
nb as (select x.candidate_id, round(median(overall_sharpe), 7) as neighbour_sharpe from gk x join gk y on abs(x.a - y.a) + abs(x.b - y.b) + abs(x.c - y.c) + abs(x.d - y.d) = 1
    join ca on ca.candidate_id = y.candidate_id group by 1),
ag as (select candidate_id, lookback, skip, top_n, median_sharpe, fold_passes, overall_sharpe, total_return, max_drawdown, deflated, spread, neighbour_sharpe,
    round(case when overall_sharpe = 0 then 0 else neighbour_sharpe / overall_sharpe end, 6) as neighbour_ratio,
    fold_passes >= {FOLDS_REQUIRED} as gate_folds, deflated > 0 as gate_deflated, max_drawdown < 0.5 as gate_drawdown, neighbour_sharpe > 0 as gate_plateau
    from grid join fa using (candidate_id) join ca using (candidate_id) join ds using (candidate_id) join sp using (candidate_id) join nb using (candidate_id)),
rg as materialized (select *, 25 * (gate_folds::int + gate_deflated::int + gate_drawdown::int + gate_plateau::int) as composite,
    row_number() over (order by (gate_folds and gate_deflated) desc, median_sharpe desc, spread, neighbour_sharpe desc, neighbour_ratio desc, max_drawdown, lookback, skip, top_n, candidate_id) as place from ag)"""
_RANKED = _CUBE + "," + _RETURNS.removeprefix(_SCORED).lstrip(",").lstrip() + "," + _MAIN


def _ranked(spark, sf_dir):
    def make():
        rows, r = backtest(spark, sf_dir), F.col("net")
        cells = rows.join(F.broadcast(folds(spark)), F.col("month").between(F.col("test_from"), F.col("test_to")))
        each = cells.groupBy("candidate_id", "fold_id").agg(stats.sharpe(r).alias("sharpe"))
        each = each.groupBy("candidate_id").agg(F.round(F.percentile("sharpe", 0.5), 6).alias("median_sharpe"), F.count_if(F.col("sharpe") > FOLD_SHARPE).alias("fold_passes"))
        joined = rows.where(F.col("month").between(FOLDS[0][3], FOLDS[-1][4]))
        overall = stats.equity(joined, ["candidate_id"], "month", "net").groupBy("candidate_id").agg(
            F.round(stats.sharpe(r), 6).alias("overall_sharpe"), F.round(stats.total_return(r), 6).alias("total_return"), F.round(F.max("drawdown"), 6).alias("max_drawdown")
        )
        deflated = stats.deflated(joined, ["candidate_id"], "net", TRIALS).select("candidate_id", F.round("score", 6).alias("deflated"))
        around = validation.neighbours(grid(spark), ["lookback", "skip", "top_n", "weighting"]).join(overall.withColumnRenamed("candidate_id", "neighbour_id"), "neighbour_id")
        around = around.groupBy("candidate_id").agg(F.round(F.percentile("overall_sharpe", 0.5), 7).alias("neighbour_sharpe"))
        out = grid(spark)
        for part in (each, overall, deflated, variant_sensitivity(spark, sf_dir).drop("variants"), around):
            out = out.join(part, "candidate_id")
        ratio = F.when(F.col("overall_sharpe") == 0, 0.0).otherwise(F.col("neighbour_sharpe") / F.col("overall_sharpe"))
        gates = {"gate_folds": F.col("fold_passes") >= FOLDS_REQUIRED, "gate_deflated": F.col("deflated") > 0, "gate_drawdown": F.col("max_drawdown") < 0.5, "gate_plateau": F.col("neighbour_sharpe") > 0}
        out = out.withColumns({"neighbour_ratio": F.round(ratio, 6), **gates})
        out = out.withColumn("composite", 25 * sum((F.col(g).cast("int") for g in gates), F.lit(0)))
        hard = F.col("gate_folds") & F.col("gate_deflated")
        order = [F.desc(hard.cast("int")), F.desc("median_sharpe"), "spread", F.desc("neighbour_sharpe"), F.desc("neighbour_ratio"), "max_drawdown", "lookback", "skip", "top_n", "candidate_id"]
        return out.withColumn("place", F.row_number().over(Window.orderBy(*order))).drop("weighting")  # the grid's points, a parameter

    return kept(spark, sf_dir, "ranked", make)


_RANKED_COLUMNS = [
    "candidate_id", "median_sharpe", "fold_passes", "overall_sharpe", "total_return", "max_drawdown", "deflated", "spread", "neighbour_sharpe", "neighbour_ratio",
    "gate_folds", "gate_deflated", "gate_drawdown", "gate_plateau", "composite", "place",
]


@query(f"{_RANKED} select {', '.join(_RANKED_COLUMNS)} from rg")
def candidate_ranking(spark, sf_dir):
    """Each candidate's folds, overall figures, gates and composite score, ranked by ten keys."""
    return _ranked(spark, sf_dir).select(*_RANKED_COLUMNS)


@query(f"""{_RETURNS},
hv as (select * from (values {", ".join(map(str, FOLDS))}) f(fold_id, train_from, train_to, test_from, test_to)),
c as (select fold_id, candidate_id, round(coalesce(avg(net) filter (month <= train_to) / stddev_samp(net) filter (month <= train_to), 0) * sqrt(12), 9) as a,
    coalesce(avg(net) filter (month >= test_from) / nullif(stddev_samp(net) filter (month >= test_from), 0), 0) * sqrt(12) as b, any_value(test_from - train_to - 1) as gap_months
    from net join hv on month >= train_from and month <= test_to group by 1, 2),
w as (select *, row_number() over (partition by fold_id order by a desc, candidate_id) as k from c)
select count(*) as folds, count(*) filter (b > {FOLD_SHARPE}) as passes, count(*) filter (b > 0) as positive, count(*) filter (b < 0) as negative,
    round(median(b - a), 6) as median_gap, round(min(b - a), 6) as worst_gap, min(gap_months) as least_months, max(gap_months) as most_months from w where k = 1""")
def walk_forward_gaps(spark, sf_dir):
    """Test less train Sharpe ratios of the folds' best candidates, folds over the gate, and months between."""
    best = validation.walk_forward(backtest(spark, sf_dir), folds(spark)).join(F.broadcast(folds(spark)), "fold_id")
    gap, months, b = F.col("test_sharpe") - F.col("train_sharpe"), F.col("test_from") - F.col("train_to") - 1, F.col("test_sharpe")
    return best.agg(
        F.count("*").alias("folds"), F.count_if(b > FOLD_SHARPE).alias("passes"), F.count_if(b > 0).alias("positive"), F.count_if(b < 0).alias("negative"),
        F.round(F.percentile(gap, 0.5), 6).alias("median_gap"), F.round(F.min(gap), 6).alias("worst_gap"), F.min(months).alias("least_months"), F.max(months).alias("most_months"),
    )


@query(f"""{_RETURNS},
hv as (select * from (values {", ".join(map(str, FOLDS))}) f(fold_id, train_from, train_to, test_from, test_to)),
c as (select fold_id, candidate_id, round(coalesce(avg(net) filter (month <= train_to) / stddev_samp(net) filter (month <= train_to), 0) * sqrt(12), 9) as a from net join hv on month >= train_from and month <= test_to group by 1, 2),
w as (select *, row_number() over (partition by fold_id order by a desc, candidate_id) as k from c),
p as (select fold_id, unnest(['lookback', 'skip', 'top_n', 'weighting']) as axis, unnest([lookback::varchar, skip::varchar, top_n::varchar, weighting]) as value from w join grid using (candidate_id) where k = 1)
select axis, value, count(*) as folds from p group by 1, 2""")
def selection_distribution(spark, sf_dir):
    """How many folds select each value of each parameter."""
    best = validation.walk_forward(backtest(spark, sf_dir), folds(spark)).select("fold_id", "candidate_id").join(F.broadcast(grid(spark)), "candidate_id")
    axes = best.select(F.expr("stack(4, 'lookback', cast(lookback as string), 'skip', cast(skip as string), 'top_n', cast(top_n as string), 'weighting', weighting) as (axis, value)"))
    return axes.groupBy("axis", "value").agg(F.count("*").alias("folds"))


@query(f"""{_RETURNS},
hv as (select * from (values {", ".join(map(str, FOLDS))}) f(fold_id, train_from, train_to, test_from, test_to)),
cr as (select * from (values {", ".join(f"('{k}', {a}, {b})" for k, (a, b) in CRISES.items())}) c(label, a, b)),
fl as (select fold_id, string_agg(label, ', ' order by label) as crises from hv join cr on a <= test_to and b >= test_from group by 1),
fs as (select candidate_id, fold_id, round({_SHARPE.format("net", 12)}, 6) as sharpe, count(*) filter (exists (select 1 from cr where month between a and b)) as crisis_months
    from net join hv on month between test_from and test_to group by 1, 2)
select candidate_id, fold_id, sharpe, sharpe > {FOLD_SHARPE} as passes, crisis_months, crises from fs left join fl using (fold_id)""")
def crisis_folds(spark, sf_dir):
    """Each candidate's folds beside the crises that their test windows overlap, and the months in one."""
    crises = spark.createDataFrame([(k, *v) for k, v in CRISES.items()], "label string, a int, b int")
    labels = folds(spark).join(crises, (F.col("a") <= F.col("test_to")) & (F.col("b") >= F.col("test_from"))).groupBy("fold_id").agg(F.array_join(F.sort_array(F.collect_list("label")), ", ").alias("crises"))
    rows = backtest(spark, sf_dir).join(F.broadcast(folds(spark)), F.col("month").between(F.col("test_from"), F.col("test_to")))
    inside = F.lit(False)
    for a, b in CRISES.values():
        inside = inside | F.col("month").between(a, b)
    each = rows.groupBy("candidate_id", "fold_id").agg(F.round(stats.sharpe(F.col("net")), 6).alias("sharpe"), F.count_if(inside).alias("crisis_months"))
    return each.join(F.broadcast(labels), "fold_id", "left").select("candidate_id", "fold_id", "sharpe", (F.col("sharpe") > FOLD_SHARPE).alias("passes"), "crisis_months", "crises")


@query(f"""{_RETURNS},{_LEVELS},
br as (select a.month, a.level / b.level - 1 as base from lv a join lv b on b.month = a.month - 1),
w as (select * from (values {", ".join(f"('{k}', {a}, {b})" for k, (a, b) in SUB_PERIODS.items())}) t(label, a, b)),
n as (select label, candidate_id, month, net, base, product(1 + net) over (partition by label, candidate_id order by month) as equity from net left join br using (month) join w on month between a and b),
p as (select *, greatest(1.0, max(equity) over (partition by label, candidate_id order by month)) as peak from n)
select label, candidate_id, count(*) as months, round({_SHARPE.format("net", 12)}, 6) as sharpe, round(case when product(1 + net) <= 0 then -1 else pow(product(1 + net), 12.0 / count(*)) - 1 end, 6) as cagr,
    round(product(1 + net) - 1, 6) as total_return, round(max(1 - equity / peak), 6) as max_drawdown, round(product(1 + base) - 1, 6) as benchmark_return,
    round(product(1 + net) - 1, 9) > round(product(1 + base) - 1, 9) as beats_benchmark from p group by 1, 2""")
def sub_periods(spark, sf_dir):
    """Fixed sub-windows clipped to the data: Sharpe ratio, growth, drawdown and the benchmark."""
    levels = _levels(spark, sf_dir)
    base = levels.join(levels.select((F.col("month") + 1).alias("month"), F.col("level").alias("was")), "month").select("month", (F.col("level") / F.col("was") - 1).alias("base"))
    windows = spark.createDataFrame([(k, *v) for k, v in SUB_PERIODS.items()], "label string, a int, b int")
    rows = backtest(spark, sf_dir).join(F.broadcast(base), "month", "left").join(F.broadcast(windows), F.col("month").between(F.col("a"), F.col("b")))
    r, b = F.col("net"), F.col("base")
    out = stats.equity(rows, ["label", "candidate_id"], "month", "net").groupBy("label", "candidate_id").agg(
        F.count("*").alias("months"), stats.sharpe(r).alias("sharpe"), stats.cagr(r).alias("cagr"), stats.total_return(r).alias("total_return"), F.max("drawdown").alias("max_drawdown"),
        stats.total_return(b).alias("benchmark_return"),
    )
    out = out.withColumn("beats_benchmark", F.round("total_return", 9) > F.round("benchmark_return", 9))
    return _rounded(out, *out.columns)


@query(f"""{_RETURNS},{_LEVELS},
br as (select a.month, a.level / b.level - 1 as base from lv a join lv b on b.month = a.month - 1),
x as (select candidate_id, month, net, base, product(1 + net) over (partition by candidate_id order by month) as equity from net left join br using (month)),
p as (select *, greatest(1.0, max(equity) over (partition by candidate_id order by month)) as peak from x),
s as (select candidate_id, count(*) as n, avg(net) as mean, stddev_samp(net) * sqrt(12) as volatility, avg(net) / nullif(stddev_samp(net) filter (net < 0), 0) * sqrt(12) as sortino,
    pow(product(1 + net), 12.0 / count(*)) - 1 as cagr, max(1 - equity / peak) as drawdown, avg((net > 0)::int) as win_rate, avg(net - base) / nullif(stddev_samp(net - base), 0) * sqrt(12) as information_ratio,
    pow(product(1 + base), 12.0 / count(base)) - 1 as base_cagr, median(net) as middle, quantile_cont(net, 0.05) as p05, quantile_cont(net, 0.95) as p95, min(net) as lowest, max(net) as highest from p group by 1)
select candidate_id, round(mean, 6) as mean, round(middle, 6) as median, round(p05, 6) as p05, round(p95, 6) as p95, round(lowest, 6) as lowest, round(highest, 6) as highest, round(volatility, 6) as volatility,
    round(coalesce(sortino, 0), 5) as sortino, round(case when drawdown > 0 then cagr / drawdown else 0 end, 5) as calmar, round(win_rate, 6) as win_rate, round(coalesce(information_ratio, 0), 5) as information_ratio,
    round(cagr - base_cagr, 6) as cagr_alpha from s""")
def risk_metrics(spark, sf_dir):
    """Summary of returns; Sortino, Calmar and information ratios, win rate and growth over the benchmark's."""
    levels = _levels(spark, sf_dir)
    base = levels.join(levels.select((F.col("month") + 1).alias("month"), F.col("level").alias("was")), "month").select("month", (F.col("level") / F.col("was") - 1).alias("base"))
    rows = stats.equity(backtest(spark, sf_dir).join(F.broadcast(base), "month", "left"), ["candidate_id"], "month", "net")
    r, over = F.col("net"), F.col("net") - F.col("base")
    out = rows.groupBy("candidate_id").agg(
        F.avg(r).alias("mean"), F.percentile(r, 0.5).alias("median"), F.percentile(r, 0.05).alias("p05"), F.percentile(r, 0.95).alias("p95"), F.min(r).alias("lowest"), F.max(r).alias("highest"),
        (F.stddev_samp(r) * F.sqrt(F.lit(12.0))).alias("volatility"), F.round(stats.sortino(r), 5).alias("sortino"), stats.cagr(r).alias("cagr"), F.max("drawdown").alias("drawdown"),
        F.avg((r > 0).cast("int")).alias("win_rate"), F.round(stats.sharpe(over), 5).alias("information_ratio"), stats.cagr(F.col("base")).alias("base_cagr"),
    )
    out = out.withColumn("calmar", F.round(F.when(F.col("drawdown") > 0, F.col("cagr") / F.col("drawdown")).otherwise(0.0), 5)).withColumn("cagr_alpha", F.col("cagr") - F.col("base_cagr"))
    columns = ["candidate_id", "mean", "median", "p05", "p95", "lowest", "highest", "volatility", "sortino", "calmar", "win_rate", "information_ratio", "cagr_alpha"]
    return _rounded(out, *columns)


@query(f"""{_RETURNS},
k as (select *, row_number() over (partition by candidate_id order by round(net, 9), month) as k from net)
select candidate_id, 'worst' as report, month as at, round(net, 6) as value from k where k <= 10
union all select candidate_id, 'january', null, round(avg(net) filter (month % 12 = 0) - avg(net) filter (month % 12 <> 0), 6) from net group by 1
union all select candidate_id, 'hit_rate', null, round(avg((net > 0)::int), 6) from net group by 1
union all select candidate_id, 'turnover', null, round(avg(entries + exits), 6) from net group by 1
union all select candidate_id, 'cost', null, round(avg(cost), 9) from net group by 1
union all select candidate_id, 'capacity', null, round(max(250000.0::double / top_n / median_value), 8) from bk group by 1""")
def trade_reports(spark, sf_dir):
    """The ten worst months, January against the rest, hit rate, turnover, cost and the largest part of a median day's volume, by candidate."""
    rows, r = backtest(spark, sf_dir), F.col("net")
    january = F.col("month") % 12 == 0
    k = F.row_number().over(Window.partitionBy("candidate_id").orderBy(F.round(r, 9), "month"))
    worst = rows.withColumn("k", k).where("k <= 10").select("candidate_id", F.lit("worst").alias("report"), F.col("month").alias("at"), F.round(r, 6).alias("value"))
    figures = {
        "january": F.round(F.avg(F.when(january, r)) - F.avg(F.when(~january, r)), 6), "hit_rate": F.round(F.avg((r > 0).cast("int")), 6),
        "turnover": F.round(F.avg(F.col("entries") + F.col("exits")), 6), "cost": F.round(F.avg("cost"), 9),
    }
    each = rows.groupBy("candidate_id").agg(*[v.alias(name) for name, v in figures.items()])
    each = each.select("candidate_id", F.explode(F.array(*[F.struct(F.lit(n).alias("report"), F.col(n).alias("value")) for n in figures])).alias("f"))
    each = each.select("candidate_id", "f.report", F.lit(None).cast("int").alias("at"), "f.value")
    part = F.round(F.max(universe.CAPITAL_SEK / F.col("top_n") / F.col("median_value")), 8)
    used = book(spark, sf_dir).groupBy("candidate_id").agg(part.alias("value")).select("candidate_id", F.lit("capacity").alias("report"), F.lit(None).cast("int").alias("at"), "value")
    return worst.unionByName(each).unionByName(used)


@query(f"""{_SCORED},
lm as (select candidate_id, max(month) as last from bk group by 1),
nw as (select b.*, 250000.0::double / top_n / median_value as part, {_cost()} * 1e4 as bps, s.asof_date, s.anchor_date from bk b join lm on b.candidate_id = lm.candidate_id and b.month = last join (select number, month, asof_date, anchor_date from uni) s using (number, month)),
ol as (select b.candidate_id, b.number, b.top_n, {_cost()} * 1e4 as bps from bk b join lm on b.candidate_id = lm.candidate_id and b.month = last - 1),
j as (select coalesce(n.candidate_id, o.candidate_id) as candidate_id, n.number as now, o.number as was, coalesce(n.top_n, o.top_n) as top_n, n.part, n.bps, o.bps as old_bps, n.asof_date < n.anchor_date as stale, n.country_code, n.weight
    from nw n full outer join ol o on n.candidate_id = o.candidate_id and n.number = o.number),
cw as (select candidate_id, country_code, sum(weight) as w from nw group by 1, 2),
ct as (select candidate_id, arg_max(country_code, (round(w, 9), country_code)) as top_country, max(w) as top_weight from cw group by 1),
a as (select candidate_id, max(part) as most_part, avg(part) as mean_part, avg(bps) as mean_bps, coalesce(sum(bps) filter (was is null), 0) / max(top_n) as entry_bps, coalesce(sum(old_bps) filter (now is null), 0) / max(top_n) as exit_bps,
    count(*) filter (was is null) as entries, count(*) filter (now is null) as exits, count(*) filter (was is null) / max(top_n)::double as turnover, count(*) filter (stale) as stale from j group by 1)
select candidate_id, top_country, round(top_weight, 6) as top_weight, round(most_part, 8) as most_part, round(mean_part, 8) as mean_part, round(mean_bps, 5) as mean_bps, round(entry_bps, 5) as entry_bps, round(exit_bps, 5) as exit_bps,
    entries, exits, round(turnover, 6) as turnover, stale, concat_ws(',', case when round(top_weight, 9) >= {CONCENTRATED} then 'concentrated' end, case when most_part >= {WATCHED_PART} then 'large_orders' end,
    case when stale > 0 then 'stale' end, case when turnover >= {HIGH_TURNOVER} then 'high_turnover' end) as flags from a join ct using (candidate_id)""")
def pre_trade_audit(spark, sf_dir):
    """Each latest book before it is traded: use of volume, costs in and out, turnover, stale names, the largest country, and flags."""
    dates = monthly(spark, sf_dir).select("number", "month", "asof_date", "anchor_date")
    last = Window.partitionBy("candidate_id")
    rows = book(spark, sf_dir).withColumn("last", F.max("month").over(last)).where("month >= last - 1").withColumn("bps", universe.tiered_cost_bps(F.col("top_n")))
    now = rows.where("month = last").join(dates, ["number", "month"]).select(
        "candidate_id", "number", F.lit(True).alias("now"), "top_n", "country_code", "weight", "bps", (universe.CAPITAL_SEK / F.col("top_n") / F.col("median_value")).alias("part"),
        (F.col("asof_date") < F.col("anchor_date")).alias("stale"),
    )
    was = rows.where("month = last - 1").select("candidate_id", "number", F.lit(True).alias("was"), F.col("top_n").alias("top_was"), F.col("bps").alias("old_bps"))
    both = now.join(was, ["candidate_id", "number"], "full_outer")
    n = F.max(F.coalesce("top_n", "top_was"))
    entered, left = F.col("was").isNull(), F.col("now").isNull()
    audit = both.groupBy("candidate_id").agg(
        F.max("part").alias("most_part"), F.avg("part").alias("mean_part"), F.avg("bps").alias("mean_bps"), (F.coalesce(F.sum(F.when(entered, F.col("bps"))), F.lit(0.0)) / n).alias("entry_bps"),
        (F.coalesce(F.sum(F.when(left, F.col("old_bps"))), F.lit(0.0)) / n).alias("exit_bps"), F.count_if(entered).alias("entries"), F.count_if(left).alias("exits"), (F.count_if(entered) / n).alias("turnover"),
        F.count_if("stale").alias("stale"),
    )
    places = now.groupBy("candidate_id", "country_code").agg(F.sum("weight").alias("w"))
    top = places.groupBy("candidate_id").agg(F.max_by("country_code", F.struct(F.round("w", 9), "country_code")).alias("top_country"), F.max("w").alias("top_weight"))
    flags = F.concat_ws(
        ",", F.when(F.round("top_weight", 9) >= CONCENTRATED, "concentrated"), F.when(F.col("most_part") >= WATCHED_PART, "large_orders"), F.when(F.col("stale") > 0, "stale"),
        F.when(F.col("turnover") >= HIGH_TURNOVER, "high_turnover"),
    )
    out = audit.join(top, "candidate_id").withColumn("flags", flags)
    bps = [F.round(c, 5).alias(c) for c in ("mean_bps", "entry_bps", "exit_bps")]
    return out.select("candidate_id", "top_country", F.round("top_weight", 6).alias("top_weight"), F.round("most_part", 8).alias("most_part"), F.round("mean_part", 8).alias("mean_part"), *bps, "entries", "exits", F.round("turnover", 6).alias("turnover"), "stale", "flags")


@query(f"""{_SCORED},
x as (select country_code as out_of from uni where country_code <> 'EU' group by 1),
r as (select out_of, month, number, ret, row_number() over (partition by out_of, month order by score desc, number) as k from rn, x where lookback = 12 and skip = 1 and top_n = 10 and country_code <> out_of)
select out_of, month, count(*) as held, round(sum(ret) / 10, 6) as gross from r where k <= 10 group by 1, 2""")
def leave_one_country_out(spark, sf_dir):
    """The chosen book without each country in turn (B18, PF19)."""
    rows = scored(spark, sf_dir).where(f"{portfolio.RANKABLE} and lookback = 12 and skip = 1").where(universe.within_capacity(F.lit(10)))
    places = monthly(spark, sf_dir).where("country_code <> 'EU'").select(F.col("country_code").alias("out_of")).distinct()  # a row for each country
    kept_rows = rows.crossJoin(F.broadcast(places)).where("country_code <> out_of")
    best = portfolio.ranked(kept_rows, ["out_of", "month"]).where("rank <= 10")
    return best.groupBy("out_of", "month").agg(F.count("*").alias("held"), F.round(F.sum("ret") / 10, 6).alias("gross"))


@query(f"""{_SCORED},
e as (select month, number, ret, row_number() over (partition by run, month order by md5(concat_ws(':', {SEED}, run, month, number)), number) as k, run
    from rn, (select unnest(range(20)) as run) where lookback = 12 and skip = 1 and top_n = 10)
select run, month, count(*) as held, round(sum(ret) / 10, 6) as gross from e where k <= 10 group by 1, 2""")
def random_selection(spark, sf_dir):
    """Books of ten names drawn at random from the rankable ones, by a seeded hash."""
    rows = scored(spark, sf_dir).where(f"{portfolio.RANKABLE} and lookback = 12 and skip = 1").where(universe.within_capacity(F.lit(10)))
    runs = F.broadcast(spark.range(20).select(F.col("id").cast("int").alias("run")))
    order = F.md5(F.concat_ws(":", F.lit(SEED), "run", "month", "number"))
    k = F.row_number().over(Window.partitionBy("run", "month").orderBy(order, "number"))
    drawn = rows.select("month", "number", "ret").crossJoin(runs).withColumn("k", k).where("k <= 10")
    return drawn.groupBy("run", "month").agg(F.count("*").alias("held"), F.round(F.sum("ret") / 10, 6).alias("gross"))


@query(f"""{_DAILY},
d as (select distinct date from px),
g as (select number, d.date, p.close_sek from (select number, min(date) as lo, max(date) as hi from dly group by 1) s join d on d.date between lo and hi left join dly p using (number, date))
select number, date, round(last_value(close_sek ignore nulls) over (partition by number order by date), 6) as filled_forward,
    round(first_value(close_sek ignore nulls) over (partition by number order by date rows between current row and unbounded following), 6) as filled_back from g""")
def filled_prices(spark, sf_dir):
    """Closes on every trading day of the market between a security's first and last: the last one known, and the next one."""
    prices = daily(spark, sf_dir).select("number", "date", "close_sek")
    days = F.broadcast(prices.select("date").distinct())  # a row for each calendar day at most
    span = prices.groupBy("number").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    every = span.join(days, F.col("date").between(F.col("lo"), F.col("hi"))).select("number", "date").join(prices, ["number", "date"], "left")
    w = Window.partitionBy("number")
    known = lambda order: F.last("close_sek", ignorenulls=True).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return every.select("number", "date", F.round(known(F.asc("date")), 6).alias("filled_forward"), F.round(known(F.desc("date")), 6).alias("filled_back"))


_RUNS = f"""{_RETURNS},
se as (select candidate_id, net, row_number() over (partition by candidate_id order by month) - 1 as i from net),
bs as (select candidate_id, run, net, row_number() over (partition by candidate_id, run order by md5(concat_ws(':', {SEED}, run, candidate_id, (i // 6)::int)), i) - 1 as step
    from se, (select unnest(range(100)) as run)),
wr as (select candidate_id, run, round(min(total), 9) as lowest from (select candidate_id, run, product(1 + net) over (partition by candidate_id, run order by step) as total from bs) group by 1, 2)"""


def _lowest(spark, sf_dir):
    """The lowest equity of each of 100 reordered paths of each candidate."""
    from strandline.operators import controls

    paths = stats.equity(controls.block_shuffles(backtest(spark, sf_dir), "candidate_id", "month", "net", 100, 6, SEED), ["candidate_id", "run"], "step")
    return paths.groupBy("candidate_id", "run").agg(F.round(F.min("equity"), 9).alias("lowest"))


@query(f"""{_RUNS},
o as (select *, row_number() over (partition by candidate_id order by lowest, run) - 1 as k, count(*) over (partition by candidate_id) as n from wr),
p as (select *, row_number() over (partition by candidate_id order by k) from o where k in (select round(j * (n - 1) / {SAMPLED - 1}.0)::int from (select unnest(range({SAMPLED})) as j)))
select candidate_id, run, k, round(lowest, 4) as lowest from p""")
def sampled_paths(spark, sf_dir):
    """Twenty paths of each candidate at even steps of their order by lowest equity."""
    w = Window.partitionBy("candidate_id")
    ordered = _lowest(spark, sf_dir).withColumns({"k": F.row_number().over(w.orderBy("lowest", "run")) - 1, "n": F.count("*").over(w)})
    wanted = F.transform(F.sequence(F.lit(0), F.lit(SAMPLED - 1)), lambda j: F.round(j * (F.col("n") - 1) / float(SAMPLED - 1)).cast("int"))
    return ordered.where(F.array_contains(wanted, F.col("k"))).select("candidate_id", "run", "k", F.round("lowest", 4).alias("lowest"))


@query(f"""{_RUNS},
o as (select *, row_number() over (partition by candidate_id order by lowest desc, run) as k, count(*) over (partition by candidate_id) as n from wr)
select candidate_id, count(*) as stayed, round(avg(lowest), 6) as mean, round(max(lowest), 6) as highest from o where k > floor(n * {TRIM}) group by 1""")
def trimmed_paths(spark, sf_dir):
    """What is left of each candidate's paths without the best twentieth."""
    w = Window.partitionBy("candidate_id")
    ordered = _lowest(spark, sf_dir).withColumns({"k": F.row_number().over(w.orderBy(F.desc("lowest"), "run")), "n": F.count("*").over(w)})
    stays = ordered.where(F.col("k") > F.floor(F.col("n") * TRIM)).groupBy("candidate_id")
    return stays.agg(F.count("*").alias("stayed"), F.round(F.avg("lowest"), 6).alias("mean"), F.round(F.max("lowest"), 6).alias("highest"))


@query(f"""{_CUBE},
tr as (select candidate_id, count(*) as months, round({_SHARPE.format("net", 12)}, 9) as train_sharpe from xn where variant = 'full' and execution = 'next_open' and scenario = 'base' and month < {HOLDOUT[0]} group by 1),
te as (select candidate_id, round({_SHARPE.format("net", 12)}, 9) as sharpe, round(product(1 + net) - 1, 9) as total_return from xn where variant = 'full' and execution = 'next_open' and scenario = 'base' and month between {HOLDOUT[0]} and {HOLDOUT[1]} group by 1),
hy as (select *, weighting as hypothesis, row_number() over (partition by weighting order by train_sharpe desc, candidate_id) as k from grid join tr using (candidate_id) join te using (candidate_id)),
hz as (select hypothesis, candidate_id, train_sharpe, sharpe, total_return, sharpe >= 0.3 as eligible from hy where k = 1)
select hypothesis, candidate_id, round(train_sharpe, 6) as train_sharpe, round(sharpe, 6) as holdout_sharpe, round(total_return, 6) as total_return, eligible,
    eligible and row_number() over (order by eligible desc, sharpe desc, total_return desc, hypothesis) = 1 as is_winner from hz""")
def hypothesis_batch(spark, sf_dir):
    """Pre-registered hypotheses (one a weighting): the candidate each locks before the holdout, its holdout, and the winner among the eligible."""
    rows, r = cube(spark, sf_dir).where("variant = 'full' and execution = 'next_open' and scenario = 'base'"), F.col("net")
    train = rows.where(F.col("month") < HOLDOUT[0]).groupBy("candidate_id").agg(F.round(stats.sharpe(r), 9).alias("train_sharpe"))
    test = rows.where(F.col("month").between(*HOLDOUT)).groupBy("candidate_id").agg(F.round(stats.sharpe(r), 9).alias("holdout_sharpe"), F.round(stats.total_return(r), 9).alias("total_return"))
    k = F.row_number().over(Window.partitionBy("weighting").orderBy(F.desc("train_sharpe"), "candidate_id"))
    locked = grid(spark).join(train, "candidate_id").join(test, "candidate_id").withColumn("k", k).where("k = 1").withColumnRenamed("weighting", "hypothesis")
    locked = locked.withColumn("eligible", F.col("holdout_sharpe") >= 0.3)
    first = F.row_number().over(Window.orderBy(F.desc("eligible"), F.desc("holdout_sharpe"), F.desc("total_return"), "hypothesis")) == 1  # a row for each hypothesis
    return _rounded(locked.withColumn("is_winner", F.col("eligible") & first), "hypothesis", "candidate_id", "train_sharpe", "holdout_sharpe", "total_return", "eligible", "is_winner")


@query(f"""{_CUBE},
p as (select variant, candidate_id, month, net, product(1 + net) over (partition by variant, candidate_id order by month) as equity from xn where execution = 'next_open' and scenario = 'base'),
q as (select *, greatest(1.0, max(equity) over (partition by variant, candidate_id order by month)) as peak from p),
s as (select variant, candidate_id, {_SHARPE.format("net", 12)} as sharpe, max(1 - equity / peak) as max_drawdown, product(1 + net) - 1 as total_return from q group by 1, 2)
select a.candidate_id, round(abs(a.sharpe - b.sharpe), 6) as sharpe_apart, round(abs(a.max_drawdown - b.max_drawdown), 6) as drawdown_apart, round(abs(a.total_return - b.total_return), 6) as return_apart,
    concat_ws(',', case when round(abs(a.sharpe - b.sharpe), 9) > {APART["sharpe"]} then 'sharpe' end, case when round(abs(a.max_drawdown - b.max_drawdown), 9) > {APART["max_drawdown"]} then 'max_drawdown' end,
        case when round(abs(a.total_return - b.total_return), 9) > {APART["total_return"]} then 'total_return' end) as warnings
from s a join s b using (candidate_id) where a.variant = 'full' and b.variant = 'se_only'""")
def profile_consistency(spark, sf_dir):
    """Each candidate under two profiles (the whole universe and the home market), with a warning for each figure that is too far apart."""
    rows, r = cube(spark, sf_dir).where("execution = 'next_open' and scenario = 'base'"), F.col("net")
    each = stats.equity(rows, ["variant", "candidate_id"], "month", "net").groupBy("candidate_id", "variant").agg(
        stats.sharpe(r).alias("sharpe"), F.max("drawdown").alias("max_drawdown"), stats.total_return(r).alias("total_return")
    )
    both = each.groupBy("candidate_id").agg(*[F.abs(F.max(F.when(F.col("variant") == "full", F.col(c))) - F.max(F.when(F.col("variant") == "se_only", F.col(c)))).alias(c) for c in APART])
    both = both.where("sharpe is not null and total_return is not null")
    warnings = F.concat_ws(",", *[F.when(F.round(c, 9) > most, c) for c, most in APART.items()])
    return _rounded(both.withColumn("warnings", warnings).withColumnsRenamed({"sharpe": "sharpe_apart", "max_drawdown": "drawdown_apart", "total_return": "return_apart"}), "candidate_id", "sharpe_apart", "drawdown_apart", "return_apart", "warnings")


@query(f"""{_UNIVERSE} select variant, bool_or(eligible) as active, count(*) filter (eligible) as n_rows from (
{" union all ".join(f"select '{v}' as variant, {r} = '' as eligible from uni" for v, r in (REASONS | {"liquid": "liquid_reason"}).items())}) group by 1""")
def active_variants(spark, sf_dir):
    """Variants that have an eligible row."""
    each = F.array(*[F.struct(F.lit(v).alias("variant"), (F.col(r) == "").alias("eligible")) for v, r in (REASONS | {"liquid": "liquid_reason"}).items()])
    return monthly(spark, sf_dir).select(F.inline(each)).groupBy("variant").agg(F.bool_or("eligible").alias("active"), F.count_if("eligible").alias("n_rows"))


@query(f"""{market.SQL.strip()},
m as (select min((year(date) * 12 + month(date) - 1)::int) as lo, max((year(date) * 12 + month(date) - 1)::int) as hi from px),
w as (select greatest(lo, {WINDOWS["early"][0]}) as lo, least(hi, {HOLDOUT[1]}) as hi from m),
f as (select unnest(range(5))::int as fold_id),
s as (select fold_id, lo, (hi - lo + 1) // 5 as size, (hi - lo + 1) % 5 as rest from w, f)
select fold_id, (lo + fold_id * size + case when fold_id > 0 then rest else 0 end)::int as first_month, (lo + (fold_id + 1) * size + rest - 1)::int as last_month, (size + case when fold_id = 0 then rest else 0 end)::int as months from s""")
def equal_folds(spark, sf_dir):
    """Five folds of equal length over the window that prices cover, the remainder in the first."""
    months = daily(spark, sf_dir).agg(F.min(universe.month_ordinal(F.col("date"))).alias("lo"), F.max(universe.month_ordinal(F.col("date"))).alias("hi"))
    w = months.select(F.greatest("lo", F.lit(WINDOWS["early"][0])).alias("lo"), F.least("hi", F.lit(HOLDOUT[1])).alias("hi"))
    n = F.col("hi") - F.col("lo") + 1
    s = w.withColumns({"size": F.floor(n / 5).cast("int"), "rest": (n % 5).cast("int")}).withColumn("fold_id", F.explode(F.sequence(F.lit(0), F.lit(4))))
    first = F.col("fold_id") == 0
    return s.select(
        "fold_id", (F.col("lo") + F.col("fold_id") * F.col("size") + F.when(first, 0).otherwise(F.col("rest"))).cast("int").alias("first_month"),
        (F.col("lo") + (F.col("fold_id") + 1) * F.col("size") + F.col("rest") - 1).cast("int").alias("last_month"), (F.col("size") + F.when(first, F.col("rest")).otherwise(0)).cast("int").alias("months"),
    )


@query(f"""{_RANKED}
select c.candidate_id, variant, execution, scenario, fold_id, round({_SHARPE.format("net", 12)}, 6) as sharpe, any_value(median_sharpe) as median_sharpe, any_value(place) as place, any_value(composite) as composite
from (xn join hv on month between test_from and test_to) c join rg using (candidate_id) group by 1, 2, 3, 4, 5""")
def evaluation_rows(spark, sf_dir):
    """Every evaluation beside its candidate's aggregates, for export (IO9)."""
    cells = evaluation_cube(spark, sf_dir).select("candidate_id", "variant", "execution", "scenario", "fold_id", "sharpe")
    return cells.join(F.broadcast(_ranked(spark, sf_dir).select("candidate_id", "median_sharpe", "place", "composite")), "candidate_id")


_GATE = f"""{_LEVELS},
mw as (select unnest({list(AVERAGES)}) as months),
of as (select a.month, w.months from lv a cross join mw w left join lv b on b.month between a.month - w.months and a.month - 1 group by 1, 2
    having count(b.level) = w.months and max(case when b.month = a.month - 1 then b.level end) < avg(b.level))"""


def _off(spark, sf_dir):
    """(month, months) in which the benchmark's last level was below its average of so many months."""
    levels = _levels(spark, sf_dir)
    lengths = F.broadcast(spark.createDataFrame([(n,) for n in AVERAGES], "months int"))
    past = F.broadcast(levels.select(F.col("month").alias("past"), F.col("level").alias("old")))  # a row for each month
    points = levels.select("month").crossJoin(lengths).join(past, (F.col("past") >= F.col("month") - F.col("months")) & (F.col("past") < F.col("month")))
    last = F.max(F.when(F.col("past") == F.col("month") - 1, F.col("old")))
    return points.groupBy("month", "months").agg(((F.count("old") == F.col("months")) & (last < F.avg("old"))).alias("off")).where("off").drop("off")


@query(f"""{_SCORED},{_GATE},
gb as (select bk.*, mw.months from bk cross join mw where not exists (select 1 from of where of.month = bk.month and of.months = mw.months)),
gm as (select coalesce(a.months, b.months) as months, coalesce(a.candidate_id, b.candidate_id) as candidate_id, coalesce(a.month, b.month + 1) as month, coalesce(a.number, b.number) as number, coalesce(a.top_n, b.top_n) as top_n,
    a.weight, b.weight as was, a.ret from gb a full outer join gb b on a.months = b.months and a.candidate_id = b.candidate_id and a.number = b.number and a.month = b.month + 1),
gc as (select gm.*, coalesce({_cost()}, 0) as one from gm left join (select number, month, median_value, close_sek, currency from uni) u using (number, month)),
gn as (select w.months, g.candidate_id, o.month, coalesce(sum(weight * ret), 0) - coalesce(sum(case when was is null then weight when weight is null then was end * one), 0) as net, count(weight) as held
    from grid g cross join (select distinct month from bk) o cross join mw w left join gc on gc.months = w.months and gc.candidate_id = g.candidate_id and gc.month = o.month group by 1, 2, 3)
select months, candidate_id, count(*) filter (held = 0) as months_out, round(product(1 + net) - 1, 6) as total_return, round({_SHARPE.format("net", 12)}, 6) as sharpe from gn group by 1, 2""")
def gated_backtest(spark, sf_dir):
    """The grid under the trend gate of four windows: off, all names are sold at a cost; on again, all are bought anew."""
    lengths = F.broadcast(spark.createDataFrame([(n,) for n in AVERAGES], "months int"))
    names = book(spark, sf_dir)
    gated = names.crossJoin(lengths).join(F.broadcast(_off(spark, sf_dir)), ["month", "months"], "left_anti")
    months = names.select("month").distinct().crossJoin(lengths).crossJoin(F.broadcast(grid(spark).select("candidate_id")))
    net = portfolio.period_returns(gated, universe.tiered_cost_bps(F.col("top_n")) / 1e4, facts(spark, sf_dir), ("months",), months)
    r = F.col("net")
    return net.groupBy("months", "candidate_id").agg(F.count_if(F.col("held") == 0).alias("months_out"), F.round(stats.total_return(r), 6).alias("total_return"), F.round(stats.sharpe(r), 6).alias("sharpe"))


@query(f"""{_SCORED},
mv as (select coalesce(a.candidate_id, b.candidate_id) as candidate_id, coalesce(a.month, b.month + 1) as month, coalesce(a.country_code, b.country_code) as country_code, a.number as now, b.number as was
    from bk a full outer join bk b on a.candidate_id = b.candidate_id and a.number = b.number and a.month = b.month + 1),
tn as (select candidate_id, month, country_code, count(*) filter (was is null) as entries, count(*) filter (now is null) as exits from mv where month in (select month from bk) group by 1, 2, 3)
select *, round((entries + exits) / greatest(1, sum(entries + exits) over (partition by candidate_id, month))::double, 6) as turnover from tn where entries + exits > 0""")
def country_turnover(spark, sf_dir):
    """Entries and exits by country, and each country's share of the month's."""
    names = book(spark, sf_dir).select("candidate_id", "month", "number", "country_code")
    before = names.select("candidate_id", (F.col("month") + 1).alias("month"), "number", F.col("country_code").alias("was"))
    both = names.join(before, ["candidate_id", "month", "number"], "full_outer").join(F.broadcast(names.select("month").distinct()), "month", "left_semi")
    entered, left = F.col("was").isNull(), F.col("country_code").isNull()
    each = both.groupBy("candidate_id", "month", F.coalesce("country_code", "was").alias("country_code")).agg(F.count_if(entered).alias("entries"), F.count_if(left).alias("exits"))
    trades = F.col("entries") + F.col("exits")
    share = trades / F.greatest(F.lit(1), F.sum(trades).over(Window.partitionBy("candidate_id", "month")))
    return each.withColumn("turnover", F.round(share, 6)).where(trades > 0)


@query(f"""{_SCORED},
mv as (select coalesce(a.candidate_id, b.candidate_id) as candidate_id, coalesce(a.month, b.month + 1) as month, coalesce(a.number, b.number) as number, b.number is null as entered, a.number is null as gone
    from bk a full outer join bk b on a.candidate_id = b.candidate_id and a.number = b.number and a.month = b.month + 1),
l as (select max(month) as last from bk)
select candidate_id, month, coalesce(string_agg(number::varchar, ',' order by number) filter (entered), '') as entered, coalesce(string_agg(number::varchar, ',' order by number) filter (gone), '') as gone,
    coalesce(string_agg(number::varchar, ',' order by number) filter (not gone), '') as held from mv, l where month between last - 11 and last group by 1, 2""")
def history_records(spark, sf_dir):
    """The last twelve months of every book with the names that enter, leave and are held."""
    names = book(spark, sf_dir).select("candidate_id", "month", "number")
    last = names.agg(F.max("month").alias("last"))
    recent = names.crossJoin(F.broadcast(last)).where("month >= last - 12").drop("last")
    before = recent.select("candidate_id", (F.col("month") + 1).alias("month"), "number", F.lit(True).alias("was"))
    both = recent.withColumn("now", F.lit(True)).join(before, ["candidate_id", "month", "number"], "full_outer").crossJoin(F.broadcast(last)).where("month between last - 11 and last")
    listed = lambda test: F.array_join(F.sort_array(F.collect_list(F.when(test, F.col("number")))), ",")
    return both.groupBy("candidate_id", "month").agg(listed(F.col("was").isNull()).alias("entered"), listed(F.col("now").isNull()).alias("gone"), listed(F.col("now").isNotNull()).alias("held"))


@query(f"""{_RETURNS},
s as (select lookback, skip, top_n, {_SHARPE.format("net", 12)} as sharpe from net join grid using (candidate_id) group by 1, 2, 3, weighting),
p as (select 'lookback' as axis, lookback as value, sharpe from s union all select 'skip', skip, sharpe from s union all select 'top_n', top_n, sharpe from s),
v as (select axis, value, round(median(sharpe), 9) as middle from p group by 1, 2)
select axis, arg_max(value, (middle, -value)) as best, arg_min(value, (middle, value)) as worst, round(max(middle) - min(middle), 6) as spread, round(corr(value, middle), 5) as correlation from v group by 1""")
def parameter_spread(spark, sf_dir):
    """Each numeric parameter's best and worst value by median Sharpe ratio, the spread, and how value and median go together."""
    each = backtest(spark, sf_dir).groupBy("candidate_id").agg(stats.sharpe(F.col("net")).alias("sharpe")).join(F.broadcast(grid(spark)), "candidate_id")
    axes = each.select("sharpe", F.expr("stack(3, 'lookback', lookback, 'skip', skip, 'top_n', top_n) as (axis, value)"))
    middle = axes.groupBy("axis", "value").agg(F.round(F.percentile("sharpe", 0.5), 9).alias("middle"))
    m, v = F.col("middle"), F.col("value")
    return middle.groupBy("axis").agg(
        F.max_by(v, F.struct(m, -v)).alias("best"), F.min_by(v, F.struct(m, v)).alias("worst"), F.round(F.max(m) - F.min(m), 6).alias("spread"), F.round(F.corr(v.cast("double"), m), 5).alias("correlation")
    )


@query(f"""{_SCORED},
sh as (select run, month, ret - base as x, row_number() over (partition by run, month order by md5(concat_ws(':', {SEED}, run, month, number)), number) as k
    from (select *, avg(ret) over (partition by month) as base from (select rk.*, 10 as top_n from rk where lookback = 12 and skip = 1) where {_CAPACITY}), (select unnest(range(1, {CONTROLS + 1})) as run)),
ex as (select run, month, round(sum(x) / 10, 12) as net from sh where k <= 10 group by 1, 2),
er as (select run, net as ret, row_number() over (partition by run order by month) - 1 as i, count(*) over (partition by run) as n from ex),
e0 as (select run, i, n, resample, md5(concat_ws(':', 23, run, resample, i)) as digest from er, (select unnest(range({CONTROL_RESAMPLES})) as resample)),
e1 as (select run, i as step, n, resample, case when i = 0 or ('0x' || substr(digest, 1, 12))::bigint / 281474976710656.0::double < {1 / 6.0!r}::double
    then floor(('0x' || substr(digest, 13, 12))::bigint / 281474976710656.0::double * n)::bigint - i end as place from e0),
e2 as (select *, last_value(place ignore nulls) over (partition by run, resample order by step) + step as at from e1),
e3 as (select d.run, d.resample, {_SHARPE.format("s.ret", 12)} as sharpe from e2 d join er s on s.run = d.run and s.i = ((d.at % d.n) + d.n) % d.n group by 1, 2),
lo as (select run, round(quantile_cont(sharpe, 0.025), 6) as low from e3 group by 1),
dg as (select run, count(*) as n, avg(net) as m, nullif(stddev_samp(net), 0) as s from ex group by 1),
dh as (select run, any_value(n) as n, any_value(m / s) as r, sum(pow((net - m) / s, 3)) / any_value(n) as k3, sum(pow((net - m) / s, 4)) / any_value(n) as k4 from ex join dg using (run) group by 1),
df as (select run, round(coalesce(r * sqrt(12), 0), 6) as sharpe, round(coalesce(r - sqrt(greatest(1 - k3 * r + (k4 - 1) / 4 * r * r, 1e-12) / (n - 1)) * {stats.expected_maximum(TRIALS)!r}::double, 0), 6) as deflated from dh)
select count(*) as runs, count(*) filter (sharpe > {FOLD_SHARPE}) as by_sharpe, count(*) filter (low > 0) as by_interval, count(*) filter (deflated > 0) as by_deflated,
    round(avg((sharpe > {FOLD_SHARPE} and low > 0 and deflated > 0)::int), 6) as pass_rate, avg((sharpe > {FOLD_SHARPE} and low > 0 and deflated > 0)::int) <= 0.2 as accepted from df join lo using (run)""")
def negative_controls(spark, sf_dir):
    """Shuffled books that pass the absolute thresholds: Sharpe ratio, lower bound of its bootstrap interval and deflated ratio; and the gate on their share."""
    from strandline.operators import controls

    rows = scored(spark, sf_dir).where(f"{portfolio.RANKABLE} and lookback = 12 and skip = 1").where(universe.within_capacity(F.lit(10)))
    runs = controls.shuffled_scores(rows, 10, CONTROLS, SEED).where("run > 0").withColumnRenamed("excess", "net")
    runs = kept(spark, sf_dir, "controls", lambda: runs)
    low = validation.stationary_bootstrap(runs, "run", "month", "net", CONTROL_RESAMPLES, 6.0, 23).groupBy("run", "resample").agg(stats.sharpe(F.col("ret")).alias("s"))
    low = low.groupBy("run").agg(F.round(F.percentile("s", 0.025), 6).alias("low"))
    each = runs.groupBy("run").agg(F.round(stats.sharpe(F.col("net")), 6).alias("sharpe")).join(stats.deflated(runs, ["run"], "net", TRIALS).select("run", F.round("score", 6).alias("deflated")), "run").join(low, "run")
    tests = {"by_sharpe": F.col("sharpe") > FOLD_SHARPE, "by_interval": F.col("low") > 0, "by_deflated": F.col("deflated") > 0}
    rate = F.avg((tests["by_sharpe"] & tests["by_interval"] & tests["by_deflated"]).cast("int"))
    return each.agg(F.count("*").alias("runs"), *[F.count_if(t).alias(n) for n, t in tests.items()], F.round(rate, 6).alias("pass_rate"), (rate <= 0.2).alias("accepted"))
