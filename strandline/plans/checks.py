"""Registered checks of all market tables: rules as data, a pass over each table, and their roll-up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions import text
from strandline.operators import checks, controls, roster, universe
from strandline.operators.checks import Rule
from strandline.plans.intake import _BARE, _MERGED, _TYPE, EARLY_DAYS, NEEDED, _merged
from strandline.plans.queries import _UNIVERSE, daily, monthly, query
from strandline.sources import market, rosters
from strandline.storage import kept
from strandline.streaming.ticks import daily_rates

#: Venues of the master and their currencies, where they have their own; currencies that rates are needed of; kinds of actions and of benchmarks; days a rate may be old.
VENUES = [("ST", "Nasdaq Stockholm", "SE", None), ("CO", "Nasdaq Copenhagen", "DK", "DKK"), ("OL", "Oslo Bors", "NO", "NOK")]
CURRENCIES, FRESH_DAYS = ("NOK", "DKK", "EUR", "USD"), 7
ACTIONS = ("split", "reverse_split", "cash_dividend", "special_dividend", "cash_merger", "delisting_cashout")
BENCHMARKS, KINDS = ("primary", "secondary", "tertiary"), ("total_return", "proxy")
LIQUID_REASONS = ("liquid_subset_disabled", "market_cap_data_unavailable", "outside_liquid_subset_cut")
_ELIGIBLE = """share_class = 'ordinary' and exchange_group <> 'XX' and is_primary and listing_age_months >= 18 and asof_date is not null and close_raw is not null and trade_value_sek is not null
    and stale_days = 0 and not delisted_before_execution and close_sek >= 20 and not is_outlier"""

#: For each table: the expression that names a row, and its rules.
RULES: dict[str, tuple[str, tuple[Rule, ...]]] = {
    "ck_master": ("security_id", (
        Rule("master", "status_domain", "vendor_roster_status is null or vendor_roster_status not in ('active_only', 'delisted_only', 'both')"),
        Rule("master", "no_issuer", "coalesce(issuer_group_id, '') = ''"),
        Rule("master", "id_is_not_symbol", "security_id <> eodhd_symbol"),
        Rule("master", "type_out_of_scope", "security_type_normalized <> 'common_share'"),
        Rule("master", "class_out_of_scope", "share_class_normalized <> 'ordinary'"),
        Rule("master", "venue_out_of_scope", f"exchange_group not in {tuple(v[0] for v in VENUES)}"),
    )),
    "ck_prices": ("concat_ws(':', security_id, cast(date as string))", (
        Rule("prices", "null_date", "date is null"),
        Rule("prices", "not_positive", "not (open_raw > 0 and high_raw > 0 and low_raw > 0 and close_raw > 0)"),
        Rule("prices", "negative_volume", "volume < 0"),
        Rule("prices", "high_low_order", "high_raw < low_raw or open_raw > high_raw or open_raw < low_raw or close_raw > high_raw + 1e-6 or close_raw < low_raw - 1e-6"),
        Rule("prices", "value_identity", "not coalesce(abs(trade_value_local - close_raw * volume) <= 1e-9, false)"),
        Rule("prices", "value_sek_not_finite", "trade_value_sek is null or isnan(trade_value_sek) or abs(trade_value_sek) > 1e300 or trade_value_sek < 0"),
        Rule("rates", "asof_conversion", "not coalesce(abs(trade_value_sek - trade_value_local * expected_rate) <= 1e-6, false)"),
    )),
    "ck_adjusted": ("concat_ws(':', security_id, cast(date as string))", (
        Rule("prices", "adjusted_keys", "status in ('left_only', 'right_only')"),
        Rule("prices", "adjusted_differs", "status = 'differs'"),
    )),
    "ck_actions": ("concat_ws(':', cast(number as string), cast(date as string), action_type)", (
        Rule("actions", "type_domain", f"action_type is null or action_type not in {ACTIONS}"),
        Rule("actions", "split_ratio", "action_type in ('split', 'reverse_split') and not coalesce(action_ratio > 0, false)"),
        Rule("actions", "no_trading_day", "not traded"),
    )),
    "ck_rates": ("concat_ws(':', currency, cast(date as string))", (Rule("rates", "not_positive", "not coalesce(sek_per_ccy > 0, false)"), Rule("rates", "null_date", "date is null"))),
    "ck_currencies": ("currency", (
        Rule("rates", "currency_missing", "not observed"),
        Rule("rates", "currency_unexpected", "not expected"),
        Rule("rates", "stale", f"expected and not coalesce(days_old <= {FRESH_DAYS}, false)"),
    )),
    "ck_delistings": ("cast(number as string)", (Rule("delistings", "unknown_security", "not known"), Rule("delistings", "still_trading", "known and coalesce(days_early <= 30, false)"))),
    "ck_histories": ("security_id", (Rule("delistings", "early_end_without_coverage", f"days_early > {EARLY_DAYS} and not covered"),)),
    "ck_benchmarks": ("concat_ws(':', benchmark_id, cast(date as string))", (
        Rule("benchmarks", "type_domain", f"benchmark_type is null or benchmark_type not in {KINDS}"),
        Rule("benchmarks", "not_positive", "not coalesce(adj_close > 0 and close_sek > 0, false)"),
    )),
    "ck_series": ("benchmark_id", (
        Rule("benchmarks", "id_missing", "not observed"),
        Rule("benchmarks", "id_unexpected", "not expected"),
        Rule("benchmarks", "name_changes", "names > 1"),
        Rule("benchmarks", "type_changes", "types > 1"),
    )),
    "ck_universe": ("concat_ws(':', cast(month as string), security_id)", (
        Rule("universe", "not_in_status", "not in_status"),
        Rule("universe", "not_in_universe", "not in_universe"),
        Rule("universe", "proxy_market_value", "status_source = 'trade_value_proxy_market_cap'"),
        Rule("universe", "age_differs", "listing_age_months <> status_age"),
        Rule("universe", "market_value_differs", "abs(market_cap_sek - status_cap) > 1e-9"),
        Rule("universe", "se_only_elsewhere", "reason_se = '' and exchange_group <> 'ST'"),
        Rule("universe", "liquid_not_full", "is_liquid and reason <> ''"),
        Rule("universe", "full_not_eligible", "reason = '' and not eligible"),
        Rule("universe", "eligible_not_full", "eligible and reason <> ''"),
        Rule("universe", "no_reason", "in_universe and (reason is null or reason_se is null or liquid_reason is null)"),
        Rule("universe", "too_young", "reason = '' and listing_age_months < 18"),
        Rule("universe", "too_cheap", "reason = '' and close_sek < 20"),
        Rule("universe", "execution_not_after_anchor", "next_execution_date <= anchor_date"),
        Rule("universe", "delisted_before_execution", "reason = '' and delisted_before_execution"),
        Rule("universe", "liquid_without_value", "is_liquid and market_cap_sek is null"),
        Rule("universe", "liquid_not_top_third", "any_liquid and is_liquid <> top_third"),
        Rule("universe", "liquid_reason_domain", f"not any_liquid and reason = '' and liquid_reason not in {LIQUID_REASONS}"),
    )),
}
#: Tables whose keys must be unique: section and keys.
UNIQUE = {"ck_master": ("master", ["security_id"]), "ck_prices": ("prices", ["security_id", "date"]), "ck_rates": ("rates", ["currency", "date"]), "ck_benchmarks": ("benchmarks", ["benchmark_id", "date"]), "ck_universe": ("universe", ["month", "security_id"])}


def tables(spark, sf_dir) -> dict[str, DataFrame]:
    """The tables that ``RULES`` are about."""
    prices, actions, rates = daily(spark, sf_dir), market.corporate_actions(spark, sf_dir), market.currency_rates(spark, sf_dir)
    filled = daily_rates(rates, 4000).withColumnRenamed("sek_per_ccy", "filled")  # a rate for each day, by another way than that of the prices
    expected = F.when(F.col("currency") == "SEK", 1.0).otherwise(F.col("filled"))
    w = Window.partitionBy("number").orderBy("date")
    ratio = (F.col("close_raw") + F.coalesce("cash", F.lit(0.0))) * F.coalesce("split", F.lit(1.0)) / F.lag("close_raw").over(w)
    again = market.daily_prices(spark, sf_dir).join(universe.action_days(actions), ["number", "date"], "left").withColumn("ratio", F.coalesce(ratio, F.col("close_raw")))
    again = again.withColumn("adj_close", F.exp(F.sum(F.ln("ratio")).over(w)))
    traded = prices.select("number", "date").withColumn("traded", F.lit(True))
    ends = prices.groupBy("number", "security_id").agg(F.max("date").alias("last_date"))
    latest = prices.agg(F.max("date").alias("latest"))
    seen = rates.groupBy("currency").agg(F.max("date").alias("last"), F.lit(True).alias("seen"))
    wanted = spark.createDataFrame([(c, True) for c in CURRENCIES], "currency string, wanted boolean")
    flag = lambda c: F.coalesce(c, F.lit(False))
    ended = rosters.delistings(spark, sf_dir)
    lasting = ends.crossJoin(F.broadcast(latest)).withColumn("days_early", F.date_diff("latest", "last_date"))
    series = market.named_benchmarks(spark, sf_dir)
    ids = spark.createDataFrame([(b, True) for b in BENCHMARKS], "benchmark_id string, wanted boolean")
    return {
        "ck_master": roster.master_rows(_merged(spark, sf_dir), spark.createDataFrame(VENUES, "exchange_group string, exchange_name string, country_code string, currency string"), "SEK"),
        "ck_prices": prices.join(filled, ["currency", "date"], "left").withColumn("expected_rate", expected),
        "ck_adjusted": controls.table_diff(prices, again, ["security_id", "date"], ["adj_close"], 1e-9),
        "ck_actions": actions.join(traded, ["number", "date"], "left").withColumn("traded", flag(F.col("traded"))),
        "ck_rates": rates,
        "ck_currencies": seen.join(wanted, "currency", "full_outer").crossJoin(latest).select("currency", flag(F.col("seen")).alias("observed"), flag(F.col("wanted")).alias("expected"), F.date_diff("latest", "last").alias("days_old")),
        "ck_delistings": ended.join(lasting, "number", "left").select("number", F.col("security_id").isNotNull().alias("known"), "days_early"),
        "ck_histories": lasting.join(ended.distinct().withColumn("covered", F.lit(True)), "number", "left").withColumn("covered", flag(F.col("covered"))),
        "ck_benchmarks": series,
        "ck_series": series.groupBy("benchmark_id").agg(F.count_distinct("benchmark_name").alias("names"), F.count_distinct("benchmark_type").alias("types"), F.lit(True).alias("seen")).join(ids, "benchmark_id", "full_outer").select("benchmark_id", "names", "types", flag(F.col("seen")).alias("observed"), flag(F.col("wanted")).alias("expected")),
        "ck_universe": _universe(spark, sf_dir),
    }


def _universe(spark, sf_dir) -> DataFrame:
    """The universe beside a status table that is made anew from the prices, with eligibility and the upper third told in another way."""
    own, prices = monthly(spark, sf_dir), daily(spark, sf_dir)
    keys = ["number", "month", "exchange_group", "country_code", "anchor_date", "next_execution_date"]
    month = universe.month_ordinal(F.col("date"))
    span = prices.groupBy("number", "exchange_group", "country_code", "shares").agg(F.min(month).alias("first"))
    last = prices.groupBy("number", month.alias("month")).agg(F.max_by("close_sek", "date").alias("last_close"))
    status = span.join(F.broadcast(universe.calendar(prices)), "exchange_group").join(last, ["number", "month"], "left")
    status = status.select(*keys, F.greatest(F.lit(0), F.col("month") - F.col("first")).alias("status_age"), (F.col("shares") * F.col("last_close")).alias("status_cap"), F.lit(True).alias("s "))
    eligible = F.expr(_ELIGIBLE)
    ranks = (F.col("reason") == "") & F.col("market_cap_sek").isNotNull()
    by_cap = Window.partitionBy("month", ranks).orderBy(F.desc("market_cap_sek"), "security_id")
    third = ranks & (F.row_number().over(by_cap) <= F.ceil(F.count("*").over(Window.partitionBy("month", ranks)) / 3))
    some = own.agg(F.coalesce(F.bool_or("is_liquid"), F.lit(False)).alias("any_liquid"))
    told = own.withColumns({"eligible": F.coalesce(eligible, F.lit(False)), "top_third": third}).crossJoin(F.broadcast(some)).withColumn("u ", F.lit(True))
    both = told.join(status, keys, "full_outer")
    return both.withColumns({"in_universe": F.col("`u `").isNotNull(), "in_status": F.col("`s `").isNotNull()}).drop("u ", "s ")


_TABLES = f"""{_UNIVERSE},
{_MERGED.strip()},
ck_prices as (select dly.*, close_raw * volume as trade_value_local, case when dly.currency = 'SEK' then 1.0::double else e.rate end as expected_rate from dly
    left join (select d.currency, d.date, arg_max(fx.sek_per_ccy, fx.date) as rate from (select distinct currency, date from dly) d join fx on fx.currency = d.currency and fx.date <= d.date group by 1, 2) e on e.currency = dly.currency and e.date = dly.date),
lg as (select number, security_id, date, exp(sum(ln(ratio)) over (partition by number order by date)) as again from dly1),
ck_adjusted as (select coalesce(a.security_id, b.security_id) as security_id, coalesce(a.date, b.date) as date,
    case when b.date is null then 'left_only' when a.date is null then 'right_only' when abs(adj_close - again) > 1e-9 * greatest(1, abs(adj_close), abs(again)) then 'differs' else 'same' end as status
    from dly a full outer join lg b on a.security_id = b.security_id and a.date = b.date),
ck_actions as (select act.*, exists (select 1 from px where px.number = act.number and px.date = act.date) as traded from act),
ck_rates as (select * from fx),
en as (select number, security_id, max(date) as last_date, date_diff('day', max(date), (select max(date) from px)) as days_early from px group by 1, 2),
ck_currencies as (select coalesce(s.currency, w.c) as currency, s.currency is not null as observed, w.c is not null as expected, date_diff('day', s.last, (select max(date) from px)) as days_old
    from (select currency, max(date) as last from fx group by 1) s full outer join (values {", ".join(f"('{c}')" for c in CURRENCIES)}) w(c) on s.currency = w.c),
ck_delistings as (select ended.number, en.number is not null as known, days_early from ended left join en using (number)),
ck_histories as (select en.*, number in (select number from ended) as covered from en),
ck_benchmarks as (select benchmark_id, upper(substr(benchmark_id, 1, 1)) || substr(benchmark_id, 2) || ' index' as benchmark_name, case when benchmark_id = 'primary' then 'total_return' else 'proxy' end as benchmark_type, date, adj_close, adj_close as close_sek from bench),
ck_series as (select coalesce(s.benchmark_id, w.b) as benchmark_id, names, types, s.benchmark_id is not null as observed, w.b is not null as expected
    from (select benchmark_id, count(distinct benchmark_name) as names, count(distinct benchmark_type) as types from ck_benchmarks group by 1) s full outer join (values {", ".join(f"('{b}')" for b in BENCHMARKS)}) w(b) on s.benchmark_id = w.b),
lm as (select number, (year(date) * 12 + month(date) - 1)::int as month, arg_max(close_sek, date) as last_close from dly group by 1, 2),
us as (select span.number, cal.month, span.exchange_group, span.country_code, anchor_date, next_execution_date, greatest(0, cal.month - (year(listing_date) * 12 + month(listing_date) - 1)) as status_age, shares * last_close as status_cap
    from span join cal using (exchange_group) left join lm on lm.number = span.number and lm.month = cal.month),
uo as (select *, coalesce({_ELIGIBLE}, false) as eligible, (select coalesce(bool_or(is_liquid), false) from uni) as any_liquid,
    ranks and row_number() over (partition by month, ranks order by market_cap_sek desc, security_id) <= ceil(count(*) over (partition by month, ranks) / 3) as top_third
    from (select * exclude (ranks), reason = '' and market_cap_sek is not null as ranks from uni)),
ck_universe as (select uo.*, uo.number is not null as in_universe, us.number is not null as in_status, status_age, status_cap from uo full outer join us
    on uo.number = us.number and uo.month = us.month and uo.exchange_group = us.exchange_group and uo.country_code = us.country_code and uo.anchor_date = us.anchor_date and uo.next_execution_date = us.next_execution_date),
ck_master as (select security_id, security_id as eodhd_symbol, exchange_group, {_BARE} as issuer_group_id, vendor_roster_status, {_TYPE} as security_type_normalized, {text.class_sql("company_name", "split_part(security_id, '.', 1)")} as share_class_normalized
    from ro where {_TYPE} = 'common_share' and {text.class_sql("company_name", "split_part(security_id, '.', 1)")} = 'ordinary' and exchange_group in {tuple(v[0] for v in VENUES)})"""


def _rule_sql(source: str, key: str, rule: Rule) -> str:
    return f"""select '{rule.section}' as section, '{rule.name}' as check_name, (select count(*) from {source}) as n_rows, (select count(*) from {source} where {rule.bad}) as n_bad,
    coalesce((select string_agg(k, ',' order by k) from (select coalesce({key}, 'null') as k from {source} where {rule.bad} order by k limit {checks.SAMPLE})), '') as sample"""


def _unique_sql(source: str, section: str, keys: list[str]) -> str:
    text_key = "concat_ws(':', " + ", ".join(f"coalesce(cast({k} as string), 'null')" for k in keys) + ")"
    return _rule_sql(f"(select {', '.join(keys)}, count(*) as times from {source} group by all)", text_key, Rule(section, "duplicate_key", "times > 1"))


def _present_sql(name: str, columns: list[str]) -> list[str]:
    missing = f"(select c from (values {', '.join(f"('{c}')" for c in columns)}) v(c) where c not in (select column_name from (describe {name})))"
    return [
        f"select 'tables', '{name}_missing', 1, 0, ''",
        f"select 'tables', '{name}_empty', 1, ((select count(*) from {name}) = 0)::int, case when (select count(*) from {name}) = 0 then '{name}' else '' end",
        f"select 'tables', '{name}_columns', {len(columns)}, (select count(*) from {missing}), coalesce((select string_agg(c, ',' order by c) from {missing}), '')",
    ]


_FOUND = f"""{_TABLES},
found as materialized ({" union all ".join([*(_rule_sql(t, key, r) for t, (key, rules) in RULES.items() for r in rules), *(_unique_sql(t, *u) for t, u in UNIQUE.items()), *(q for n, cs in NEEDED.items() for q in _present_sql(n, cs))])})"""


def _found(spark, sf_dir) -> DataFrame:
    def make() -> DataFrame:
        every = tables(spark, sf_dir)
        rows = [checks.checked(every[t], rules, key) for t, (key, rules) in RULES.items()] + [checks.repeated(every[t], *u) for t, u in UNIQUE.items()] + [checks.present(spark, sf_dir, NEEDED)]
        return reduce(DataFrame.unionByName, rows)

    return kept(spark, sf_dir, "checks", make)


@query(f"{_FOUND} select section, check_name, n_rows::bigint as n_rows, n_bad::bigint as n_bad, case when n_bad = 0 then 'PASS' else 'FAIL' end as status, sample from found")
def validation_checks(spark, sf_dir):
    """Every check of every table, a row each, with the first offenders."""
    return checks.outcome(_found(spark, sf_dir))


@query(f"""{_FOUND},
e as (select section, n_bad from found union all select 'all', n_bad from found)
select section, count(*) as n_checks, count(*) filter (n_bad > 0) as n_failed, case when count(*) filter (n_bad > 0) = 0 then 'PASS' else 'FAIL' end as status from e group by 1""")
def validation_report(spark, sf_dir):
    """Sections that pass and fail, and all together."""
    return checks.report(_found(spark, sf_dir))


_MASTER_SQL = f"""with {_MERGED.strip()}
select security_id, security_id as eodhd_symbol, split_part(security_id, '.', 1) as ticker_local, isin, trim(company_name) as company_name, country_code, exchange_name, exchange_group, {_BARE} as issuer_group_id, vendor_roster_status,
    coalesce(currency, 'SEK') as currency, '' as security_type_raw, {_TYPE} as security_type_normalized, '' as share_class_raw, 'ordinary' as share_class_normalized, null::date as listing_date, null::date as delisting_date,
    null::double as shares_outstanding, vendor_roster_status = 'delisted_only' as is_delisted
from ro join (values {", ".join(f"('{g}', '{n}', '{c}', {f"'{m}'" if m else 'null'})" for g, n, c, m in VENUES)}) x(exchange_group, exchange_name, country_code, currency) using (exchange_group)
where {_TYPE} = 'common_share' and {text.class_sql("company_name", "split_part(security_id, '.', 1)")} = 'ordinary'"""


@query(_MASTER_SQL)
def master_contract(spark, sf_dir):
    """Security-master rows with all columns of their contract (PF10)."""
    return tables(spark, sf_dir)["ck_master"]
