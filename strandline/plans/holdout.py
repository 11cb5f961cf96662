"""Registered queries that judge candidates on held-out windows, deflate them, project them and rebalance them at other cadences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions import stats
from strandline.operators import cadence, portfolio
from strandline.plans.queries import _RETURNS, _UNIVERSE, COST_BPS, FOLDS, LOOKBACKS, SIZES, SKIPS, WEIGHTINGS, _rounded, backtest, book, daily, folds, monthly, query
from strandline.plans.research import _LEVELS, _PATHS, VARIANTS, _levels, _paths
from strandline.sources import market

#: The holdout (month ordinals) and its gate, windows to compare, quantiles that cap projections, books of the cadences.
HOLDOUT, LEAST_SHARPE = (2000 * 12, 2000 * 12 + 11), 0.3
WINDOWS = {"early": (1996 * 12, 1997 * 12 + 11), "middle": (1998 * 12, 1999 * 12 + 11), "holdout": HOLDOUT}
LOW, HIGH = 0.05, 0.90
LOOKBACK, SKIP, BOOKS = 12, 1, (5, 10)
TRIALS = len(LOOKBACKS) * len(SKIPS) * len(SIZES) * len(WEIGHTINGS)

_SHARPE = "case when count({0}) >= 2 and stddev_samp({0}) > 0 then avg({0}) / stddev_samp({0}) * sqrt({1}) else 0 end"


def _horner(cs, a):
    return reduce(lambda total, c: f"({total} * {a} + {c!r}::double)", cs[1:], f"{cs[0]!r}::double")


_TAIL = f"case when abs(x) > 7 then 0 else exp(-x * x / 2) * {_horner(stats.NORMAL_ABOVE, 'abs(x)')} / {_horner(stats.NORMAL_BELOW, 'abs(x)')} end"


@query(f"""{_RETURNS},
g as (select candidate_id, count(*) as n, avg(net) as m, stddev_samp(net) as s from net group by 1),
h as (select candidate_id, any_value(n) as n, any_value(m / s) as r, sum(pow((net - m) / s, 3)) / any_value(n) as k3, sum(pow((net - m) / s, 4)) / any_value(n) as k4 from net join g using (candidate_id) group by 1),
d as (select candidate_id, r, sqrt(greatest(1 - k3 * r + (k4 - 1) / 4 * r * r, 1e-12) / (n - 1)) as d from h),
x as (select candidate_id, r - d * {stats.expected_maximum(TRIALS)!r}::double as score, d * {stats.expected_maximum(TRIALS)!r}::double as noise, score / d as x from d)
select candidate_id, round(score, 6) as score, round(case when x > 0 then 1 - {_TAIL} else {_TAIL} end, 6) as probability, round(noise, 6) as expected_max_noise_sharpe from x""")
def deflated_sharpe(spark, sf_dir):
    """Sharpe ratios less what the best of so many trials would show by chance (A10)."""
    return _rounded(stats.deflated(backtest(spark, sf_dir), ["candidate_id"], "net", TRIALS), "candidate_id", "score", "probability", "expected_max_noise_sharpe")


@query(f"""{_RETURNS},{_LEVELS},
w as (select * from (values {", ".join(f"('{k}', {a}, {b})" for k, (a, b) in WINDOWS.items())}) t(window_id, a, b)),
n as (select window_id, candidate_id, month, net, product(1 + net) over (partition by window_id, candidate_id order by month) as equity from net join w on month between a and b),
p as (select *, greatest(1.0, max(equity) over (partition by window_id, candidate_id order by month)) as peak from n)
select window_id, candidate_id, count(*) as months, round({_SHARPE.format("net", 12)}, 6) as sharpe, round(product(1 + net) - 1, 6) as total_return, round(max(1 - equity / peak), 6) as max_drawdown from p group by 1, 2""")
def window_comparison(spark, sf_dir):
    """Each candidate over several windows side by side."""
    windows = spark.createDataFrame([(k, *v) for k, v in WINDOWS.items()], "window_id string, a int, b int")
    rows = backtest(spark, sf_dir).join(F.broadcast(windows), (F.col("month") >= F.col("a")) & (F.col("month") <= F.col("b")))
    r = F.col("net")
    out = stats.equity(rows, ["window_id", "candidate_id"], "month", "net").groupBy("window_id", "candidate_id")
    out = out.agg(F.count("*").alias("months"), stats.sharpe(r).alias("sharpe"), stats.total_return(r).alias("total_return"), F.max("drawdown").alias("max_drawdown"))
    return _rounded(out, *out.columns)


_HELD = f"month between {HOLDOUT[0]} and {HOLDOUT[1]}"


@query(f"""{_RETURNS},{_LEVELS},
br as (select a.month, a.level / b.level - 1 as base from lv a join lv b on b.month = a.month - 1),
vg as ({" union all ".join(f"select '{v}' as variant, candidate_id, month, sum(b.weight * b.ret) / sum(b.weight) as gross from bk b join (select number, month, country_code as cc, is_liquid from uni) u using (number, month) where {c.replace('country_code', 'cc')} and {_HELD} group by 2, 3" for v, c in VARIANTS.items())}),
s as (select variant, candidate_id, count(*) as months, {_SHARPE.format("gross", 12)} as sharpe, product(1 + gross) - 1 as total_return, product(1 + base) - 1 as benchmark_return from vg left join br using (month) group by 1, 2)
select variant, candidate_id, months, round(sharpe, 6) as sharpe, round(total_return, 6) as total_return, round(benchmark_return, 6) as benchmark_return,
    round(total_return, 9) > round(benchmark_return, 9) and round(sharpe, 9) >= {LEAST_SHARPE} as eligible from s""")
def holdout_gate(spark, sf_dir):
    """Books of each variant in the holdout, before costs, against the primary benchmark and the least Sharpe ratio."""
    levels = _levels(spark, sf_dir)
    base = levels.join(levels.select((F.col("month") + 1).alias("month"), F.col("level").alias("was")), "month").select("month", (F.col("level") / F.col("was") - 1).alias("base"))
    liquid = monthly(spark, sf_dir).where(_HELD).select("number", "month", "is_liquid")
    held = book(spark, sf_dir).where(_HELD).join(liquid, ["number", "month"])
    inside = F.array_compact(F.array(*[F.when(F.expr(c), v) for v, c in VARIANTS.items()]))
    # names without a market value weigh nothing; months in which a variant has only such are NaN, as 0 / 0 is in the SQL, and no error
    total = F.sum("weight")
    gross = F.when(total == 0, F.lit(float("nan"))).otherwise(F.sum(F.col("weight") * F.col("ret")) / total).alias("gross")
    rows = held.withColumn("variant", F.explode(inside)).groupBy("variant", "candidate_id", "month").agg(gross).join(F.broadcast(base), "month", "left")
    out = rows.groupBy("variant", "candidate_id").agg(
        F.count("*").alias("months"), stats.sharpe(F.col("gross")).alias("sharpe"), stats.total_return(F.col("gross")).alias("total_return"), stats.total_return(F.col("base")).alias("benchmark_return")
    )
    gate = (F.round("total_return", 9) > F.round("benchmark_return", 9)) & (F.round("sharpe", 9) >= LEAST_SHARPE)
    return _rounded(out.withColumn("eligible", gate), "variant", "candidate_id", "months", "sharpe", "total_return", "benchmark_return", "eligible")


@query(f"""{_RETURNS},
hv as (select * from (values {", ".join(map(str, FOLDS))}) f(fold_id, train_from, train_to, test_from, test_to)),
c as (select candidate_id, fold_id, count(month) as n_months, any_value(test_from > train_to) as starts_after_training, any_value(test_to - test_from + 1) as wanted, any_value(test_to < {HOLDOUT[0]}) as before_holdout
    from (select distinct candidate_id from net) cross join hv left join net using (candidate_id) where month between test_from and test_to group by 1, 2)
select k.candidate_id, k.fold_id, coalesce(n_months, 0) as n_months, k.starts_after_training, coalesce(n_months, 0) = k.wanted as complete, k.before_holdout
from (select candidate_id, fold_id, test_from > train_to as starts_after_training, test_to - test_from + 1 as wanted, test_to < {HOLDOUT[0]} as before_holdout from (select distinct candidate_id from net) cross join hv) k
left join c using (candidate_id, fold_id)""")
def fold_conformity(spark, sf_dir):
    """Whether folds leave the holdout alone, start after training and have all their months."""
    rows = backtest(spark, sf_dir).select("candidate_id", "month")
    both = rows.select("candidate_id").distinct().crossJoin(F.broadcast(folds(spark)))
    inside = F.broadcast(folds(spark).select("fold_id", "test_from", "test_to"))
    seen = rows.join(inside, (F.col("month") >= F.col("test_from")) & (F.col("month") <= F.col("test_to"))).groupBy("candidate_id", "fold_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return both.join(seen, ["candidate_id", "fold_id"], "left").select(
        "candidate_id", "fold_id", n.alias("n_months"), (F.col("test_from") > F.col("train_to")).alias("starts_after_training"),
        (n == F.col("test_to") - F.col("test_from") + 1).alias("complete"), (F.col("test_to") < HOLDOUT[0]).alias("before_holdout"),
    )


_LOCK = FOLDS[-1]  # the fold whose test is the holdout


@query(f"""{_RETURNS},{_LEVELS},
br as (select a.month, a.level / b.level - 1 as base from lv a join lv b on b.month = a.month - 1),
tr as (select candidate_id, round(coalesce({_SHARPE.format("net", 12)}, 0), 9) as s from net where month between {_LOCK[1]} and {_LOCK[2]} group by 1),
lk as (select candidate_id from tr order by s desc, candidate_id limit 1),
hm as (select candidate_id, month, net, base from net join lk using (candidate_id) left join br using (month) where {_HELD})
select candidate_id, month, round(product(1 + net) over w, 6) as equity, round(product(1 + coalesce(base, 0)) over w, 6) as benchmark from hm window w as (order by month)""")
def locked_walk_forward(spark, sf_dir):
    """The candidate locked before the holdout, month by month through it, beside the primary benchmark (R18, IO12)."""
    rows = backtest(spark, sf_dir)
    before = rows.where(f"month between {_LOCK[1]} and {_LOCK[2]}").groupBy("candidate_id").agg(F.round(stats.sharpe(F.col("net")), 9).alias("s"))
    locked = before.orderBy(F.desc("s"), "candidate_id").limit(1).select("candidate_id")
    levels = _levels(spark, sf_dir)
    base = levels.join(levels.select((F.col("month") + 1).alias("month"), F.col("level").alias("was")), "month").select("month", (F.col("level") / F.col("was") - 1).alias("base"))
    held = rows.where(_HELD).join(F.broadcast(locked), "candidate_id").join(F.broadcast(base), "month", "left")
    w = Window.partitionBy("candidate_id").orderBy("month")
    growth = [F.product(1 + F.coalesce(c, F.lit(0.0))).over(w).alias(n) for c, n in (("net", "equity"), ("base", "benchmark"))]
    return _rounded(held.select("candidate_id", "month", *growth), "candidate_id", "month", "equity", "benchmark")


@query(f"""{_PATHS},
la as (select candidate_id, product(1 + net) as last from net group by 1)
select candidate_id, any_value(last) is not null as projected, round(any_value(last), 4) as last_equity, round(quantile_cont(last * equity, {LOW}), 4) as low_cap, round(quantile_cont(last * equity, {HIGH}), 4) as high_cap
from pa join la using (candidate_id) group by 1""")
def forward_projection(spark, sf_dir):
    """Resampled paths that go on from the last equity, and the caps over all their values."""
    last = backtest(spark, sf_dir).groupBy("candidate_id").agg((stats.total_return(F.col("net")) + 1).alias("last"))
    value = F.col("last") * F.col("equity")
    out = _paths(spark, sf_dir).join(F.broadcast(last), "candidate_id").groupBy("candidate_id").agg(
        F.lit(True).alias("projected"), F.max("last").alias("last_equity"), F.percentile(value, LOW).alias("low_cap"), F.percentile(value, HIGH).alias("high_cap")
    )
    return _rounded(out, *out.columns, digits=4)


_CADENCE = f"""{_UNIVERSE},
dd as (select distinct date from px),
wk as (select isoyear(date) as y, weekofyear(date) as k, max(date) as date from dd group by 1, 2),
sch as (select 'month' as cadence, max(date) as date from dd group by date_trunc('month', date) union all select 'quarter', max(date) from dd group by date_trunc('quarter', date)
    union all select 'biweek', date from wk where (y * 53 + k) % 2 = 0 union all select 'week', date from wk),
ne as (select date, lead(date) over (order by date) as entry_date from dd),
pe0 as (select cadence, row_number() over w - 1 as period, date as rebalance_date, entry_date, lead(entry_date) over w as exit_date from sch join ne using (date) window w as (partition by cadence order by date)),
pe as (select * from pe0 where exit_date > entry_date),
hc as (select pe.*, d.number, d.adj_open_sek as entry_price from pe join dly d on d.date = pe.entry_date and d.adj_open_sek > 0),
hd as (select hc.*, o.adj_open_sek, l.adj_close_sek from hc asof left join (select * from dly where adj_close_sek > 0) l on l.number = hc.number and hc.exit_date >= l.date
    left join (select number, date, adj_open_sek from dly where adj_open_sek > 0) o on o.number = hc.number and o.date = hc.exit_date),
ch as (select cadence, period, number, coalesce(adj_open_sek, adj_close_sek * 0.7::double) / entry_price - 1 as ret from hd)"""
_CADENCE_NET = f"""{_CADENCE},
sk as (select number, cadence, period, rebalance_date, (year(entry_date) * 12 + month(entry_date) - 2)::int as month, (rebalance_date - interval {SKIP} month)::date as d1, (rebalance_date - interval {SKIP + LOOKBACK} month)::date as d0 from pe cross join span),
s1 as (select sk.*, d.adj_close as p1 from sk asof left join (select * from dly where adj_close > 0) d on sk.number = d.number and sk.d1 >= d.date),
s0 as (select s1.*, d.adj_close as p0 from s1 asof left join (select * from dly where adj_close > 0) d on s1.number = d.number and s1.d0 >= d.date),
kr as (select cadence, period, number, ret, row_number() over (partition by cadence, period order by p1 / p0 - 1 desc nulls last, number) as rank
    from s0 join (select number, month from uni where reason = '') using (number, month) join ch using (cadence, period, number) where p1 / p0 is not null and ret is not null),
kb as (select cadence || '_n' || n as candidate_id, cadence, period, number, 1.0::double / n as weight, ret from kr, (select unnest({list(BOOKS)}) as n) where rank <= n),
km as (select coalesce(a.candidate_id, b.candidate_id) as candidate_id, coalesce(a.period, b.period + 1) as period, a.weight, b.weight as was, a.ret
    from kb a full outer join kb b on a.candidate_id = b.candidate_id and a.number = b.number and a.period = b.period + 1),
kn as (select candidate_id, period, sum(coalesce(weight * ret, 0)) as gross, sum(case when was is null then weight when weight is null then was else 0 end * {COST_BPS / 1e4}::double) as cost, gross - cost as net,
    count(weight) as held from km where (candidate_id, period) in (select (candidate_id, period) from kb) group by 1, 2)"""


_SCHEDULE = _CADENCE[_CADENCE.index("sch as (") : _CADENCE.index("ne as (")]
_OFFSET_SCHEDULE = f"""me as (select max(date) as date from dd group by date_trunc('month', date)),
sch as ({" union all ".join(f"select '{name}-{k}' as cadence, date from me where month(date) % {length} = ({length} - {k}) % {length}" for name, length in cadence.OFFSETS.items() for k in range(length))}),
"""
_OFFSET_NET = _CADENCE_NET.replace(_SCHEDULE, _OFFSET_SCHEDULE)


def _periods(spark, sf_dir, prices, schedule=cadence.schedule):
    days = prices.select("date").distinct()
    return cadence.periods(days, schedule(days))


def _adjusted(spark, sf_dir):
    """Daily total-return prices in SEK."""
    return daily(spark, sf_dir).select("number", "date", F.col("adj_open_sek").alias("open_sek"), F.col("adj_close_sek").alias("close_sek"))


def _cadence_returns(spark, sf_dir, schedule=cadence.schedule):
    prices = _adjusted(spark, sf_dir)
    spans, names = _periods(spark, sf_dir, prices, schedule), market.securities(spark, sf_dir).select("number")
    eligible = monthly(spark, sf_dir).where("reason = ''").select("number", "month")
    local = daily(spark, sf_dir).select("number", "date", F.col("adj_close").alias("close_sek"))
    scored = cadence.momentum(names, spans, local, LOOKBACK, SKIP).join(eligible, ["number", "month"], "left_semi").drop("month")
    rows = scored.join(cadence.holding_returns(names, spans, prices), ["cadence", "period", "number"])
    sizes = spark.createDataFrame([(n,) for n in BOOKS], "top_n int")
    return portfolio.period_returns(cadence.books(rows, sizes), COST_BPS / 1e4).withColumnRenamed("month", "period")


@query(f"{_CADENCE} select cadence, period, number, round(ret, 6) as ret from ch")
def cadence_holding_returns(spark, sf_dir):
    """Returns between the entry days of weekly, biweekly, monthly and quarterly schedules."""
    prices = _adjusted(spark, sf_dir)
    out = cadence.holding_returns(market.securities(spark, sf_dir).select("number"), _periods(spark, sf_dir, prices), prices)
    return _rounded(out, "cadence", "period", "number", "ret")


@query(f"{_CADENCE_NET} select candidate_id, period, round(gross, 6) as gross, round(cost, 6) as cost, round(net, 6) as net, held from kn")
def cadence_backtest(spark, sf_dir):
    """Momentum books rebalanced at each cadence, masked by the universe known at entry."""
    return _rounded(_cadence_returns(spark, sf_dir), "candidate_id", "period", "gross", "cost", "net", "held")


_YEARLY = "case split_part(candidate_id, '_', 1) " + " ".join(f"when '{k}' then {v}" for k, v in cadence.PERIODS.items()) + " end"


@query(f"""{_CADENCE_NET},
kc as (select candidate_id, any_value({_YEARLY}) as yearly, count(*) as periods, avg(net) as m, stddev_samp(net) as s, product(1 + net) - 1 as total_return, sum(cost) as cost from kn group by 1),
kk as (select *, case when periods >= 2 and s > 0 then m / s * sqrt(yearly) else 0 end as sharpe from kc)
select candidate_id, periods, round(sharpe, 5) as sharpe, round(total_return, 5) as total_return, round(cost, 5) as cost,
    row_number() over (partition by split_part(candidate_id, '_', 2) order by round(sharpe, 9) desc, candidate_id) = 1 as is_winner from kk""")
def cadence_comparison(spark, sf_dir):
    """Cadences against each other for each size of book, and the winner by annualised Sharpe ratio."""
    each = _cadence_returns(spark, sf_dir).groupBy("candidate_id").agg(
        F.count("*").alias("periods"), F.round(stats.sharpe(F.col("net"), 1), 12).alias("once"), stats.total_return(F.col("net")).alias("total_return"), F.sum("cost").alias("cost")
    )
    name = F.substring_index("candidate_id", "_", 1)
    yearly = reduce(lambda c, k: F.when(name == k, F.sqrt(F.lit(float(cadence.PERIODS[k])))).otherwise(c), cadence.PERIODS, F.lit(None))
    out = each.withColumn("sharpe", F.col("once") * yearly)
    best = Window.partitionBy(F.substring_index("candidate_id", "_", -1)).orderBy(F.round("sharpe", 9).desc(), "candidate_id")
    return _rounded(out.withColumn("is_winner", F.row_number().over(best) == 1), "candidate_id", "periods", "sharpe", "total_return", "cost", "is_winner", digits=5)


@query(f"""{_CADENCE_NET}
select cadence, period, rebalance_date, entry_date, exit_date from pe""")
def cadence_periods(spark, sf_dir):
    """Rebalance, entry and exit dates of each cadence."""
    return _periods(spark, sf_dir, market.daily_prices(spark, sf_dir))


@query(f"""{_OFFSET_NET}
select cadence, period, rebalance_date, entry_date, exit_date from pe""")
def offset_periods(spark, sf_dir):
    """Rebalance, entry and exit dates of quarters and half-years at each of their offsets."""
    return _periods(spark, sf_dir, market.daily_prices(spark, sf_dir), cadence.offset_schedule)


@query(f"""{_OFFSET_NET},
oc as (select candidate_id, count(*) as periods, avg(net) as m, stddev_samp(net) as s, product(1 + net) - 1 as total_return, sum(cost) as cost from kn group by 1),
ok as (select *, case when periods >= 2 and s > 0 then m / s * sqrt(case when candidate_id like 'half%' then 2 else 4 end) else 0 end as sharpe from oc)
select candidate_id, periods, round(sharpe, 5) as sharpe, round(total_return, 5) as total_return, round(cost, 5) as cost from ok""")
def offset_comparison(spark, sf_dir):
    """What momentum books earn by the month in which quarters and half-years are taken to end, each size of book (B8 over D5)."""
    each = _cadence_returns(spark, sf_dir, cadence.offset_schedule).groupBy("candidate_id").agg(
        F.count("*").alias("periods"), F.round(stats.sharpe(F.col("net"), 1), 12).alias("once"), stats.total_return(F.col("net")).alias("total_return"), F.sum("cost").alias("cost")
    )
    name = F.substring_index("candidate_id", "-", 1)
    yearly = reduce(lambda c, k: F.when(name == k, F.sqrt(F.lit(12.0 / cadence.OFFSETS[k]))).otherwise(c), cadence.OFFSETS, F.lit(None))
    return _rounded(each.withColumn("sharpe", F.col("once") * yearly), "candidate_id", "periods", "sharpe", "total_return", "cost", digits=5)
