"""Further registered queries: controls, paths, stability, variants, positions and invariants."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions import stats
from strandline.operators import controls, ledger, portfolio, universe, validation
from strandline.operators.asof import asof_join
from strandline.plans.queries import (
    _CAPACITY,
    _CLOSES,
    _DAILY,
    _RETURNS,
    _SCORED,
    _UNIVERSE,
    FOLDS,
    _drawn_sql,
    _rounded,
    backtest,
    book,
    daily,
    folds,
    grid,
    monthly,
    query,
    scored,
)
from strandline.sources import market
from strandline.storage import kept

#: The book that single-book queries look at, runs of controls, lengths of blocks, windows of volatility and averages.
CHOSEN, CHOSEN_LOOKBACK, CHOSEN_SKIP, CHOSEN_SIZE = "l12_s1_n10_strat=equal", 12, 1, 10
RUNS, BLOCK_RUNS, BLOCK, SEED, LARGEST_PASS_RATE = 500, 200, 6, 7, 0.20
#: Paths of the stationary bootstrap; ``BLOCK_RUNS`` counts the block-shuffled ones.
RESAMPLES = 2000
WINDOW, SKIP, AVERAGES = 12, 1, (6, 9, 12, 15)
ORDER_SEK = 1e6
VARIANTS = {"full": "true", "se_only": "country_code = 'SE'", "without_se": "country_code <> 'SE'", "liquid": "is_liquid"}

_MONTHLY = f"{_UNIVERSE},{_CLOSES}, pr as (select a.number, a.m as month, a.p / b.p - 1 as ret from cl a join cl b on a.number = b.number and b.m = a.m - 1)"


def _monthly_returns(spark, sf_dir):
    return portfolio.monthly_returns(monthly(spark, sf_dir))


@query(f"{_MONTHLY} select number, month, round(ret, 6) as ret from pr")
def monthly_returns(spark, sf_dir):
    """Anchor close over the month before's (W9); missing months give none."""
    return _rounded(_monthly_returns(spark, sf_dir), "number", "month", "ret")


@query(f"""{_MONTHLY}
select number, month, round(case when count(ret) over w = {WINDOW} then stddev_samp(ret) over w end, 6) as volatility from pr
window w as (partition by number order by month range between {SKIP + WINDOW - 1} preceding and {SKIP} preceding)""")
def rolling_volatility(spark, sf_dir):
    """Sample deviation of twelve monthly returns, the latest left out; null unless all twelve months are there."""
    w = Window.partitionBy("number").orderBy("month").rangeBetween(-(SKIP + WINDOW - 1), -SKIP)
    sd = F.when(F.count("ret").over(w) == WINDOW, F.stddev_samp("ret").over(w))
    return _rounded(_monthly_returns(spark, sf_dir).withColumn("volatility", sd), "number", "month", "volatility")


@query(f"""{_UNIVERSE},
k as (select number, month, (anchor_date - interval 1 month)::date as d1, (anchor_date - interval 13 month)::date as d0 from uni),
a as (select k.*, d.adj_close as p1 from k asof left join dly d on k.number = d.number and k.d1 >= d.date),
b as (select a.*, d.adj_close as p0 from a asof left join dly d on a.number = d.number and a.d0 >= d.date)
select number, month, round(p1 / p0 - 1, 6) as score from b""")
def calendar_momentum(spark, sf_dir):
    """Momentum between calendar-shifted dates, prices carried forward."""
    prices, rows = daily(spark, sf_dir), monthly(spark, sf_dir).select("number", "month", "anchor_date")
    for back, name in ((1, "p1"), (13, "p0")):
        rows = asof_join(rows.withColumn("date", F.add_months("anchor_date", -back)), prices, ["number"], "date", ["adj_close"]).drop("date", "right_on").withColumnRenamed("adj_close", name)
    return _rounded(rows.withColumn("score", F.col("p1") / F.col("p0") - 1), "number", "month", "score")


_SHUFFLED = f"""{_SCORED},
sh as (select run, month, ret - base as x, row_number() over (partition by run, month order by case when run = 0 then score end desc nulls last,
    case when run > 0 then md5(concat_ws(':', {SEED}, run, month, number)) end, number) as k
    from (select *, avg(ret) over (partition by month) as base from (select rk.*, {CHOSEN_SIZE} as top_n from rk where lookback = {CHOSEN_LOOKBACK} and skip = {CHOSEN_SKIP}) where {_CAPACITY}), (select unnest(range({RUNS + 1})) as run)),
ex as (select run, month, round(sum(x) / {CHOSEN_SIZE}, 12) as excess from sh where k <= {CHOSEN_SIZE} group by 1, 2),
sr as (select run, case when stddev_samp(excess) > 0 then round(avg(excess) / stddev_samp(excess) * sqrt(12), 9) else 0 end as sharpe, avg(excess) as mean_excess from ex group by 1)"""


def _shuffled(spark, sf_dir):
    rows = scored(spark, sf_dir).where(f"{portfolio.RANKABLE} and lookback = {CHOSEN_LOOKBACK} and skip = {CHOSEN_SKIP}").where(universe.within_capacity(F.lit(CHOSEN_SIZE)))
    each = controls.shuffled_scores(rows, CHOSEN_SIZE, RUNS, SEED)
    return each.groupBy("run").agg(F.round(stats.sharpe(F.col("excess")), 9).alias("sharpe"), F.avg("excess").alias("mean_excess"))


@query(f"{_SHUFFLED} select run, round(sharpe, 6) as sharpe, round(mean_excess, 6) as mean_excess from sr")
def score_shuffle_null(spark, sf_dir):
    """The actual book (run 0) and books of scores shuffled within the month, over all rankable names."""
    return _rounded(_shuffled(spark, sf_dir), "run", "sharpe", "mean_excess")


@query(f"""{_SHUFFLED}
select count(*) as runs, count(*) filter (sharpe >= own) as passed, round(avg((sharpe >= own)::int), 6) as pass_rate, avg((sharpe >= own)::int) <= {LARGEST_PASS_RATE} as accepted
from sr, (select sharpe as own from sr where run = 0) where run > 0""")
def negative_control_gate(spark, sf_dir):
    """Shuffled runs as good as the actual one, and the gate on their share."""
    runs = _shuffled(spark, sf_dir)
    own = runs.agg(F.max(F.when(F.col("run") == 0, F.col("sharpe"))).alias("own"))
    passed = F.col("sharpe") >= F.col("own")
    rate = F.avg(passed.cast("int"))
    return runs.where("run > 0").crossJoin(F.broadcast(own)).agg(F.count("*").alias("runs"), F.count_if(passed).alias("passed"), F.round(rate, 6).alias("pass_rate"), (rate <= LARGEST_PASS_RATE).alias("accepted"))


_PATHS = f"""{_RETURNS},
se as (select candidate_id, net, row_number() over (partition by candidate_id order by month) - 1 as i from net),
bs as (select candidate_id, run, net, row_number() over (partition by candidate_id, run order by md5(concat_ws(':', {SEED}, run, candidate_id, (i // {BLOCK})::int)), i) - 1 as step
    from se, (select unnest(range({BLOCK_RUNS})) as run)),
pa as (select candidate_id, run, step, net, product(1 + net) over (partition by candidate_id, run order by step) as equity from bs)"""


def _paths(spark, sf_dir):
    shuffled = controls.block_shuffles(backtest(spark, sf_dir), "candidate_id", "month", "net", BLOCK_RUNS, BLOCK, SEED)
    return stats.equity(shuffled, ["candidate_id", "run"], "step")


@query(f"""{_PATHS},
q as (select *, greatest(1.0, max(equity) over (partition by candidate_id, run order by step)) as peak from pa)
select candidate_id, run, round(max(1 - equity / peak), 4) as max_drawdown from q group by 1, 2""")
def block_shuffle_null(spark, sf_dir):
    """Largest drawdown of each path whose blocks are in another order."""
    w = Window.partitionBy("candidate_id", "run").orderBy("step")
    peak = F.greatest(F.lit(1.0), F.max("equity").over(w))
    out = _paths(spark, sf_dir).withColumn("fall", 1 - F.col("equity") / peak)
    return out.groupBy("candidate_id", "run").agg(F.round(F.max("fall"), 4).alias("max_drawdown"))


@query(f"""{_PATHS}
select candidate_id, step, round(quantile_cont(equity, 0.05), 4) as p05, round(median(equity), 4) as p50, round(quantile_cont(equity, 0.95), 4) as p95, round(min(equity), 4) as lowest
from pa group by 1, 2""")
def path_quantiles(spark, sf_dir):
    """Quantiles of resampled paths at each step."""
    q = [F.percentile("equity", p).alias(n) for p, n in ((0.05, "p05"), (0.5, "p50"), (0.95, "p95"))]
    return _rounded(_paths(spark, sf_dir).groupBy("candidate_id", "step").agg(*q, F.min("equity").alias("lowest")), "candidate_id", "step", "p05", "p50", "p95", "lowest", digits=4)


@query(f"""{_PATHS},
d as (select candidate_id, step, round(equity, 6) as equity from pa),
b as (select candidate_id, min(equity) as lo, max(equity) as hi from d group by 1)
select candidate_id, step, least(71, floor((equity - lo) / ((hi - lo) / 72)))::int as bin, count(*) as n from d join b using (candidate_id) group by 1, 2, 3""")
def path_density(spark, sf_dir):
    """Paths in each of 72 bins at each step."""
    paths = _paths(spark, sf_dir).withColumn("equity", F.round("equity", 6))
    span = paths.groupBy("candidate_id").agg(F.min("equity").alias("lo"), F.max("equity").alias("hi"))
    slot = F.least(F.lit(71), F.floor((F.col("equity") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 72))).cast("int")
    return paths.join(span, "candidate_id").groupBy("candidate_id", "step", slot.alias("bin")).agg(F.count("*").alias("n"))


def _resampled(spark, sf_dir):
    drawn = validation.stationary_bootstrap(backtest(spark, sf_dir), "candidate_id", "month", "net", RESAMPLES, BLOCK, SEED)
    return stats.equity(drawn, ["candidate_id", "resample"], "step")


def _shared_paths(spark, sf_dir):
    """``_resampled``, saved once for those that start from them."""
    return kept(spark, sf_dir, "bootstrap paths", lambda: _resampled(spark, sf_dir))


_DRAWN = f"""{_drawn_sql(RESAMPLES, SEED)},
pt as (select candidate_id, resample, step, product(1 + ret) over (partition by candidate_id, resample order by step) as equity from drawn)"""
_TWENTIETHS = [k / 20 for k in range(1, 20)]


@query(f"""{_DRAWN},
pq as (select candidate_id, step, quantile_cont(equity, {_TWENTIETHS}) as q, min(equity) as lowest from pt group by 1, 2)
select candidate_id, step, {", ".join(f"round(q[{k}], 4) as p{5 * k:02d}" for k in range(1, 20))}, round(lowest, 4) as lowest from pq""")
def bootstrap_path_quantiles(spark, sf_dir):
    """Nineteen quantiles of the paths of the stationary bootstrap at each step."""
    names = [f"p{5 * k:02d}" for k in range(1, 20)]
    q = [F.percentile("equity", [k / 20 for k in range(1, 20)]).alias("q"), F.min("equity").alias("lowest")]
    out = _resampled(spark, sf_dir).groupBy("candidate_id", "step").agg(*q)
    return _rounded(out.select("candidate_id", "step", *[F.col("q")[k].alias(n) for k, n in enumerate(names)], "lowest"), "candidate_id", "step", *names, "lowest", digits=4)


@query(f"""{_DRAWN},
d as (select candidate_id, step, round(equity, 6) as equity from pt),
b as (select candidate_id, min(equity) as lo, max(equity) as hi from d group by 1)
select candidate_id, step, least(71, floor((equity - lo) / ((hi - lo) / 72)))::int as bin, count(*) as n from d join b using (candidate_id) group by 1, 2, 3""")
def bootstrap_path_density(spark, sf_dir):
    """Paths of the stationary bootstrap in each of 72 bins at each step, bins between the least and greatest value."""
    paths = _resampled(spark, sf_dir).withColumn("equity", F.round("equity", 6))
    span = paths.groupBy("candidate_id").agg(F.min("equity").alias("lo"), F.max("equity").alias("hi"))
    slot = F.least(F.lit(71), F.floor((F.col("equity") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 72))).cast("int")
    return paths.join(span, "candidate_id").groupBy("candidate_id", "step", slot.alias("bin")).agg(F.count("*").alias("n"))


#: The quantiles of paths that are reported.
PATH_QUANTILES = [0.01, 0.03, 0.05, 0.10, 0.15, 0.20, 0.25, 0.35, 0.45, 0.50, 0.55, 0.65, 0.75, 0.80, 0.85, 0.90, 0.95, 0.97, 0.99]
_QUANTILE_NAMES = [f"p{round(100 * q):02d}" for q in PATH_QUANTILES]


def _sketches(spark, sf_dir):
    return kept(spark, sf_dir, "path sketches", lambda: validation.path_sketches(_shared_paths(spark, sf_dir), ["candidate_id", "step"], "equity"))


@query()
def bootstrap_path_sketches(spark, sf_dir):
    """The reported quantiles of the resampled paths at each step, from sketches that can be merged (A18, R3); bootstrap_path_quantiles has others, exactly."""
    out = validation.sketched_quantiles(_sketches(spark, sf_dir), ["candidate_id", "step"], PATH_QUANTILES)
    return out.select("candidate_id", "step", "n", *[F.col("q")[k].alias(n) for k, n in enumerate(_QUANTILE_NAMES)])


@query(f"""{_DRAWN},
d as (select candidate_id, step, round(equity, 6) as equity from pt),
o as (select candidate_id, step, quantile_cont(equity, 0.01) as low, quantile_cont(equity, 0.99) as high from d group by 1, 2),
b as (select candidate_id, min(low) as lo, case when max(high) <= min(low) then min(low) + 1 else max(high) end as hi from o group by 1)
select candidate_id, step, least(71, floor((equity - lo) / ((hi - lo) / 72)))::int as bin, count(*) as n from d join b using (candidate_id) where equity between lo and hi group by 1, 2, 3""")
def outer_path_density(spark, sf_dir):
    """Paths of the stationary bootstrap in each of 72 bins at each step, bins between the outer quantiles of all steps."""
    paths = _shared_paths(spark, sf_dir).withColumn("equity", F.round("equity", 6))
    outer = paths.groupBy("candidate_id", "step").agg(F.percentile("equity", 0.01).alias("low"), F.percentile("equity", 0.99).alias("high"))
    return validation.path_density(paths, outer, ["candidate_id"], "step", "equity")


@query(f"""{_DRAWN},
ls as (select candidate_id, product(1 + net) as last from net group by 1)
select candidate_id, round(any_value(last), 4) as last_equity, round(quantile_cont(last * equity, 0.05), 4) as low_cap, round(quantile_cont(last * equity, 0.90), 4) as high_cap from pt join ls using (candidate_id) group by 1""")
def bootstrap_projection(spark, sf_dir):
    """Paths of the stationary bootstrap that go on from the last equity, and the caps over all their values."""
    last = backtest(spark, sf_dir).groupBy("candidate_id").agg((stats.total_return(F.col("net")) + 1).alias("last"))
    value = F.col("last") * F.col("equity")
    out = _resampled(spark, sf_dir).join(F.broadcast(last), "candidate_id").groupBy("candidate_id").agg(
        F.max("last").alias("last_equity"), F.percentile(value, 0.05).alias("low_cap"), F.percentile(value, 0.90).alias("high_cap")
    )
    return _rounded(out, *out.columns, digits=4)


@query(f"""{_RETURNS}
select candidate_id, count(*) as n, round(min(net), 6) as lowest, round(max(net), 6) as highest, round(avg((net > 0.1)::int), 6) as over_ten, round(avg((net < -0.1)::int), 6) as under_ten,
    round(avg(net), 6) as mean, round(stddev_samp(net), 6) as deviation from net group by 1""")
def base_return_statistics(spark, sf_dir):
    """Count, range, large moves, mean and deviation of what is resampled."""
    r = F.col("net")
    out = backtest(spark, sf_dir).groupBy("candidate_id").agg(
        F.count("*").alias("n"), F.min(r).alias("lowest"), F.max(r).alias("highest"), F.avg((r > 0.1).cast("int")).alias("over_ten"),
        F.avg((r < -0.1).cast("int")).alias("under_ten"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("deviation"),
    )
    return _rounded(out, *out.columns)


@query(f"""{_RETURNS},
hv as (select * from (values {", ".join(map(str, FOLDS))}) f(fold_id, train_from, train_to, test_from, test_to)),
fs as (select candidate_id, fold_id, avg(net) / stddev_samp(net) * sqrt(12) as sharpe from net join hv on month between test_from and test_to group by 1, 2),
ag as (select candidate_id, count(*) as n, round(median(sharpe), 6) as median_sharpe, case when count(*) < 3 then 'infinity'::double else round(stddev_pop(sharpe), 6) end as spread,
    round(avg((sharpe > 0)::int), 6) as positive from fs group by 1)
select *, row_number() over (order by median_sharpe desc, candidate_id) as place from ag""")
def fold_stability(spark, sf_dir):
    """Median and population deviation of the folds' Sharpe ratios, and the order in which controls are chosen."""
    cells = backtest(spark, sf_dir).join(F.broadcast(folds(spark)), F.col("month").between(F.col("test_from"), F.col("test_to")))
    each = cells.groupBy("candidate_id", "fold_id").agg(stats.sharpe(F.col("net")).alias("sharpe"))
    spread = F.when(F.count("*") < 3, float("inf")).otherwise(F.round(F.stddev_pop("sharpe"), 6))
    out = each.groupBy("candidate_id").agg(
        F.count("*").alias("n"), F.round(F.percentile("sharpe", 0.5), 6).alias("median_sharpe"), spread.alias("spread"), F.round(F.avg((F.col("sharpe") > 0).cast("int")), 6).alias("positive")
    )
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("median_sharpe"), "candidate_id")))


@query(f"""{_RETURNS},
s as (select candidate_id, round(avg(net) / stddev_samp(net) * sqrt(12), 9) as sharpe from net group by 1),
g as (select *, dense_rank() over (order by lookback) as a, dense_rank() over (order by skip) as b, dense_rank() over (order by top_n) as c, dense_rank() over (order by weighting) as d from grid),
nb as (select x.candidate_id, count(*) as neighbours, median(s.sharpe) as middle from g x join g y on abs(x.a - y.a) + abs(x.b - y.b) + abs(x.c - y.c) + abs(x.d - y.d) = 1
    join s on s.candidate_id = y.candidate_id group by 1),
r as (select candidate_id, sharpe, neighbours, middle, case when sharpe = 0 then 0 else middle / sharpe end as ratio from nb join s using (candidate_id))
select candidate_id, neighbours, round(middle, 6) as median_neighbour, round(ratio, 6) as ratio,
    concat_ws(',', case when middle < 0 then 'negative_neighbours' end, case when ratio < 0.7 then 'no_plateau' end) as reasons from r""")
def plateaus(spark, sf_dir):
    """Each candidate against those one step away on one axis, with the reasons against it."""
    own = backtest(spark, sf_dir).groupBy("candidate_id").agg(F.round(stats.sharpe(F.col("net")), 9).alias("sharpe"))
    pairs = validation.neighbours(grid(spark), ["lookback", "skip", "top_n", "weighting"])
    around = pairs.join(own.withColumnRenamed("candidate_id", "neighbour_id"), "neighbour_id").groupBy("candidate_id").agg(F.count("*").alias("neighbours"), F.percentile("sharpe", 0.5).alias("median_neighbour"))
    out = around.join(own, "candidate_id").withColumn("ratio", F.when(F.col("sharpe") == 0, 0.0).otherwise(F.col("median_neighbour") / F.col("sharpe")))
    reasons = F.concat_ws(",", F.when(F.col("median_neighbour") < 0, "negative_neighbours"), F.when(F.col("ratio") < 0.7, "no_plateau"))
    return _rounded(out.withColumn("reasons", reasons), "candidate_id", "neighbours", "median_neighbour", "ratio", "reasons")


@query(f"""{_RETURNS},
j as (select a.candidate_id as one, b.candidate_id as two, a.net as x, b.net as y from net a join net b on a.month = b.month and a.candidate_id < b.candidate_id)
select one, two, count(*) as months, round(corr(x, y), 5) as correlation, round(median(abs(x - y)), 9) as median_difference from j group by 1, 2""")
def candidate_correlations(spark, sf_dir):
    """Correlation and median difference of all pairs of candidates (A23, R26); the grid, a parameter, bounds the pairs."""
    net = backtest(spark, sf_dir).select("candidate_id", "month", "net")
    one, two = net.toDF("one", "month", "x"), net.toDF("two", "month", "y")
    out = one.join(two, "month").where("one < two").groupBy("one", "two").agg(
        F.count("*").alias("months"), F.round(F.corr("x", "y"), 5).alias("correlation"), F.round(F.percentile(F.abs(F.col("x") - F.col("y")), 0.5), 9).alias("median_difference")
    )
    return out


@query(f"""{_RETURNS},
e as (select candidate_id, row_number() over w - 1 as step, product(1 + net) over w as equity from net window w as (partition by candidate_id order by month))
select step, count(*) as candidates, round(median(equity), 4) as median_equity from e group by 1 having count(*) = (select count(distinct candidate_id) from net)""")
def median_path(spark, sf_dir):
    """Median equity over candidates, as far as the shortest goes."""
    net = backtest(spark, sf_dir)
    curve = stats.equity(net, ["candidate_id"], "month", "net").withColumn("step", F.row_number().over(Window.partitionBy("candidate_id").orderBy("month")) - 1)
    each = curve.groupBy("step").agg(F.count("*").alias("candidates"), F.round(F.percentile("equity", 0.5), 4).alias("median_equity"))
    return each.join(F.broadcast(net.agg(F.count_distinct("candidate_id").alias("every"))), F.col("candidates") == F.col("every")).drop("every")


_LEVELS = """
lv as (select (year(date) * 12 + month(date) - 1)::int as month, arg_max(adj_close, date) as level from bench where benchmark_id = 'primary' group by 1)"""


def _levels(spark, sf_dir):
    prices = market.benchmark_prices(spark, sf_dir).where("benchmark_id = 'primary'")
    return prices.groupBy(universe.month_ordinal(F.col("date")).alias("month")).agg(F.max_by("adj_close", "date").alias("level"))


@query(f"""{_RETURNS},{_LEVELS},
br as (select a.month, a.level / b.level - 1 as base from lv a join lv b on b.month = a.month - 1)
select candidate_id, month, round(net - base, 6) as excess, round(base, 6) as base from net join br using (month)""")
def excess_returns(spark, sf_dir):
    """Net returns over the primary benchmark's."""
    levels = _levels(spark, sf_dir)
    before = levels.select((F.col("month") + 1).alias("month"), F.col("level").alias("was"))
    base = levels.join(before, "month").select("month", (F.col("level") / F.col("was") - 1).alias("base"))
    return _rounded(backtest(spark, sf_dir).join(F.broadcast(base), "month").withColumn("excess", F.col("net") - F.col("base")), "candidate_id", "month", "excess", "base")


@query(f"""{_RETURNS},{_LEVELS},
mw as (select unnest({list(AVERAGES)}) as months),
ma as (select a.month, w.months, count(b.level) = w.months and max(case when b.month = a.month - 1 then b.level end) < avg(b.level) as off
    from lv a cross join mw w left join lv b on b.month between a.month - w.months and a.month - 1 group by 1, 2),
gd as (select candidate_id, months, case when coalesce(off, false) then 0 else net end as net, coalesce(off, false) as off from net cross join mw left join ma using (month, months))
select candidate_id, months, count(*) filter (off) as months_off, round(product(1 + net) - 1, 4) as total_return, round(avg(net) / stddev_samp(net) * sqrt(12), 5) as sharpe from gd group by 1, 2""")
def moving_average_sweep(spark, sf_dir):
    """The trend gate under four windows: no return in months whose benchmark was below its average."""
    levels = _levels(spark, sf_dir)
    lengths = spark.createDataFrame([(n,) for n in AVERAGES], "months int")
    past = levels.select(F.col("month").alias("past"), F.col("level").alias("old"))
    points = levels.select("month").crossJoin(F.broadcast(lengths)).join(F.broadcast(past), (F.col("past") >= F.col("month") - F.col("months")) & (F.col("past") < F.col("month")))
    last = F.max(F.when(F.col("past") == F.col("month") - 1, F.col("old")))
    off = points.groupBy("month", "months").agg(((F.count("old") == F.col("months")) & (last < F.avg("old"))).alias("off"))
    gated = backtest(spark, sf_dir).crossJoin(F.broadcast(lengths)).join(F.broadcast(off), ["month", "months"], "left")
    is_off = F.coalesce("off", F.lit(False))
    r = F.when(is_off, 0.0).otherwise(F.col("net"))
    return gated.groupBy("candidate_id", "months").agg(F.count_if(is_off).alias("months_off"), F.round(stats.total_return(r), 4).alias("total_return"), F.round(stats.sharpe(r), 5).alias("sharpe"))


@query(f"""{_SCORED},
rc as (select * from (select rk.*, {CHOSEN_SIZE} as top_n from rk where lookback = {CHOSEN_LOOKBACK} and skip = {CHOSEN_SKIP}) where {_CAPACITY}),
v as (""" + " union all ".join(f"select '{k}' as variant, month, number, score, ret from rc where {p}" for k, p in VARIANTS.items()) + f"""),
k as (select *, row_number() over (partition by variant, month order by score desc, number) as k from v)
select variant, month, count(*) as held, round(sum(ret) / {CHOSEN_SIZE}, 6) as gross from k where k <= {CHOSEN_SIZE} group by 1, 2""")
def variant_returns(spark, sf_dir):
    """The chosen book within each variant of the universe."""
    rows = scored(spark, sf_dir).where(f"{portfolio.RANKABLE} and lookback = {CHOSEN_LOOKBACK} and skip = {CHOSEN_SKIP}").where(universe.within_capacity(F.lit(CHOSEN_SIZE)))
    inside = F.array_compact(F.array(*[F.when(F.expr(p), F.lit(k)) for k, p in VARIANTS.items()]))
    each = portfolio.ranked(rows.select("month", "number", "score", "ret", F.explode(inside).alias("variant")), ["variant", "month"]).where(F.col("rank") <= CHOSEN_SIZE)
    return each.groupBy("variant", "month").agg(F.count("*").alias("held"), F.round(F.sum("ret") / CHOSEN_SIZE, 6).alias("gross"))


@query(f"""{_SCORED}
select candidate_id, month, bps, extra, round(sum((bps + case when currency <> 'SEK' then extra else 0 end) / 1e4 / top_n), 8) as cost
from bk, (select unnest([10, 25, 50, 75, 100]) as bps), (select unnest([0, 10, 25, 50]) as extra) group by 1, 2, 3, 4""")
def flat_costs(spark, sf_dir):
    """What buying the whole book costs under each flat rate and currency surcharge, at one part of the capital a name; a book's names are within capacity."""
    rates = spark.createDataFrame([(b, e) for b in (10, 25, 50, 75, 100) for e in (0, 10, 25, 50)], "bps int, extra int")
    one = F.col("bps") + F.when(F.col("currency") != "SEK", F.col("extra")).otherwise(0)
    return book(spark, sf_dir).crossJoin(F.broadcast(rates)).groupBy("candidate_id", "month", "bps", "extra").agg(F.round(F.sum(one / 1e4 / F.col("top_n")), 8).alias("cost"))


@query(f"""{_SCORED},
lt as (select candidate_id, max(month) as month from sc join grid using (lookback, skip) where reason = '' and score is not null group by 1),
k as (select candidate_id, s.month, number, score, top_n, row_number() over (partition by candidate_id order by score desc, number) as position
    from sc s join grid using (lookback, skip) join lt using (candidate_id, month) where reason = '' and score is not null and {_CAPACITY})
select candidate_id, month, number, position, round(score, 6) as score from k where position <= top_n""")
def latest_selection(spark, sf_dir):
    """Names of the latest month with scores that are within capacity, whether or not their return is known."""
    rows = scored(spark, sf_dir).where("reason = '' and score is not null").select("lookback", "skip", "month", "number", "score", "median_value")
    rows = rows.withColumn("latest", F.max("month").over(Window.partitionBy("lookback", "skip"))).where("month = latest")
    able = rows.join(F.broadcast(grid(spark).select("lookback", "skip", "top_n").distinct()), ["lookback", "skip"]).where(universe.within_capacity(F.col("top_n")))
    best = portfolio.ranked(able, ["lookback", "skip", "top_n"]).join(F.broadcast(grid(spark)), ["lookback", "skip", "top_n"]).where("rank <= top_n")
    return _rounded(best.withColumnRenamed("rank", "position"), "candidate_id", "month", "number", "position", "score")


@query(f"""{_SCORED}
select b.candidate_id, b.month, u.security_id, u.currency, round(b.weight * {ORDER_SEK}, 4) as order_notional, round(b.weight * {ORDER_SEK} / u.median_value, 8) as participation,
    case when u.median_value is null then 'no_volume' else 'ok' end as data_status, case when p.number is null then 'enter' else 'hold' end as action
from bk b join uni u on u.number = b.number and u.month = b.month left join bk p on p.candidate_id = b.candidate_id and p.number = b.number and p.month = b.month - 1""")
def position_rows(spark, sf_dir):
    """Orders of each book with their share of volume and whether they are new."""
    held = book(spark, sf_dir)
    before = held.select("candidate_id", (F.col("month") + 1).alias("month"), "number", F.lit(True).alias("was"))
    facts = monthly(spark, sf_dir).select("number", "month", "security_id")
    out = held.join(facts, ["number", "month"]).join(before, ["candidate_id", "month", "number"], "left")
    notional = F.col("weight") * ORDER_SEK
    return out.select(
        "candidate_id", "month", "security_id", "currency", F.round(notional, 4).alias("order_notional"), F.round(notional / F.col("median_value"), 8).alias("participation"),
        F.when(F.col("median_value").isNull(), "no_volume").otherwise("ok").alias("data_status"), F.when(F.col("was").isNull(), "enter").otherwise("hold").alias("action"),
    )


@query(f"""{_SCORED},
e as (select h1.number, h1.month, entry_date, h0.exit_due from h1 join h0 using (number, month))
select number, month, count(*) filter (action_type = 'cash_dividend') as dividends, count(*) filter (action_type in ('split', 'reverse_split')) as splits,
    count(*) filter (action_type in ('cash_merger', 'delisting_cashout')) as cashouts
from e join act using (number) where act.date between entry_date and exit_due group by 1, 2""")
def actions_while_held(spark, sf_dir):
    """Corporate actions between entry and exit, both included."""
    due = monthly(spark, sf_dir).select("number", "month", "next_execution_date", F.lead("next_execution_date").over(Window.partitionBy("number").orderBy("month")).alias("exit_due"))
    held = asof_join(due.withColumn("date", F.col("next_execution_date")), daily(spark, sf_dir), ["number"], "date", [], forward=True).drop("date").withColumnRenamed("right_on", "entry_date")
    both = held.join(market.corporate_actions(spark, sf_dir), "number").where(F.col("date").between(F.col("entry_date"), F.col("exit_due")))
    kind = F.col("action_type")
    counts = {"dividends": kind == "cash_dividend", "splits": kind.isin(*universe.SPLITS), "cashouts": kind.isin(*universe.CASHOUTS)}
    return both.groupBy("number", "month").agg(*[F.count_if(test).alias(name) for name, test in counts.items()])


@query(f"""{_DAILY},
r as (select px.*, coalesce((close_raw + coalesce(cash, 0)) * coalesce(split, 1) / lag(close_raw) over (partition by number order by date), close_raw) as ratio from px left join ad using (number, date)),
t as (select security_id, case when abs(product(ratio) over w - exp(sum(ln(ratio)) over w)) > 1e-9 * greatest(1, product(ratio) over w) then 'differs' else 'same' end as status
    from r window w as (partition by number order by date))
select security_id, status, count(*) as n from t group by 1, 2""")
def adjusted_parity(spark, sf_dir):
    """Adjusted closes against a second computation by logarithms, key by key."""
    prices, actions = market.daily_prices(spark, sf_dir), market.corporate_actions(spark, sf_dir)
    stored = daily(spark, sf_dir)
    w = Window.partitionBy("number").orderBy("date")
    ratio = (F.col("close_raw") + F.coalesce("cash", F.lit(0.0))) * F.coalesce("split", F.lit(1.0)) / F.lag("close_raw").over(w)
    again = prices.join(universe.action_days(actions), ["number", "date"], "left").withColumn("ratio", F.coalesce(ratio, F.col("close_raw")))
    again = again.withColumn("adj_close", F.exp(F.sum(F.ln("ratio")).over(w)))
    return controls.table_diff(stored, again, ["security_id", "date"], ["adj_close"], 1e-9).groupBy("security_id", "status").agg(F.count("*").alias("n"))


_INVARIANTS = {
    "eligible_in_scope": "reason <> '' or exchange_group <> 'XX'",
    "eligible_not_stale": "reason <> '' or stale_days = 0",
    "eligible_age": "reason <> '' or listing_age_months >= 18",
    "eligible_price": "reason <> '' or close_sek >= 20",
    "eligible_primary": "reason <> '' or is_primary",
    "liquid_is_eligible": "not is_liquid or reason = ''",
    "asof_not_after_anchor": "asof_date is null or asof_date <= anchor_date",
    "execution_after_anchor": "next_execution_date > anchor_date",
}


@query(f"{_UNIVERSE} " + " union all ".join(f"select 'universe' as section, '{k}' as check_name, count(*) as n_rows, count(*) filter (not ({p})) as n_bad, count(*) filter (not ({p})) = 0 as passed from uni" for k, p in _INVARIANTS.items()))
def universe_invariants(spark, sf_dir):
    """What must hold of every row of the universe, in one pass over it."""
    row = monthly(spark, sf_dir).agg(F.count("*").alias("n_rows"), *[F.count_if(~F.expr(p)).alias(k) for k, p in _INVARIANTS.items()])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("check_name"), F.col(k).alias("n_bad")) for k in _INVARIANTS]))
    return row.select("n_rows", each.alias("c")).select(F.lit("universe").alias("section"), "c.check_name", "n_rows", "c.n_bad", (F.col("c.n_bad") == 0).alias("passed"))


@query(f"""{_DAILY}
select security_id, min(date) as listing_date, max(date) as last_date, count(*) as bars,
    ((year(max(date)) - year(min(date))) * 12 + month(max(date)) - month(min(date)))::int as months from px group by 1""")
def listing_spans(spark, sf_dir):
    """First and last trade of each security, and the months between."""
    out = market.daily_prices(spark, sf_dir).groupBy("security_id").agg(F.min("date").alias("listing_date"), F.max("date").alias("last_date"), F.count("*").alias("bars"))
    return out.withColumn("months", F.greatest(F.lit(0), universe.month_ordinal(F.col("last_date")) - universe.month_ordinal(F.col("listing_date"))))


@query(f"""{_DAILY},
s as (select security_id, min(date) as lo, max(date) as hi from px group by 1),
m as (select security_id, unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), interval 1 month))::date as start from s)
select m.security_id, m.start, count(px.date) as bars from m left join px on px.security_id = m.security_id and date_trunc('month', px.date) = m.start group by 1, 2""")
def months_listed(spark, sf_dir):
    """Every month from a security's first trade to its last, with its bars (D3)."""
    prices = market.daily_prices(spark, sf_dir)
    each = prices.groupBy("security_id", F.trunc("date", "month").alias("start")).agg(F.count("*").alias("bars"))
    span = each.groupBy("security_id").agg(F.min("start").alias("lo"), F.max("start").alias("hi"))
    months = span.select("security_id", F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("start"))
    return months.join(each, ["security_id", "start"], "left").withColumn("bars", F.coalesce("bars", F.lit(0).cast("long")))


@query()
def paper_ledger(spark, sf_dir):
    """Trades of every candidate's portfolio at the month's first open."""
    # only names that a book ever holds: as many as books hold, whatever the universe; what is found on or after an execution starts a month
    names = F.broadcast(book(spark, sf_dir).select("number").distinct())
    due = monthly(spark, sf_dir).select("number", "month", F.col("next_execution_date").alias("date")).join(names, "number", "left_semi")
    opens = daily(spark, sf_dir).where("starts_month").select("number", "date", "adj_open_sek").join(names, "number", "left_semi")
    prices = asof_join(due, opens, ["number"], "date", ["adj_open_sek"], forward=True).select("number", "month", F.col("adj_open_sek").alias("price"))
    return ledger.ledger(book(spark, sf_dir), prices, ORDER_SEK, 40.0)
