"""Market tables derived from the star schema: securities, prices, actions, currency rates, benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Exchange code, country and currency by region.
VENUES = {0: ("ST", "SE", "SEK"), 1: ("CO", "DK", "DKK"), 2: ("OL", "NO", "NOK"), 3: ("ST", "SE", "SEK"), 4: ("XX", "EU", "EUR")}
#: Currency of rates by customers' region.
RATE_CURRENCY = {1: "DKK", 2: "NOK", 3: "EUR", 4: "USD"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(key, values: dict[int, str]):
    out = None
    for k, v in values.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out


def week_end(c):
    """The Friday of a timestamp's week."""
    return F.date_add(F.to_date(F.date_trunc("week", c)), 4)


def to_six(x):
    """Rounded half up to six places, by arithmetic that gives the same bits in other engines."""
    return F.floor(x * 1e6 + 0.5).cast("double") / 1e6


def mean_of_cents(c, divisor: float):
    """Mean of an amount of two decimals over ``divisor``; summed as whole cents, so the order of rows doesn't matter."""
    return F.sum(F.round(c * 100).cast("long")).cast("double") / (F.count(c) * (100 * divisor))


def securities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each supplier: security_id, exchange_group, country_code, currency, issuer_group_id, shares (some unknown), number, share_class, is_delisted."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    at = [_pick(F.col("n_regionkey"), {k: v[i] for k, v in VENUES.items()}) for i in range(3)]
    return table(spark, sf_dir, "supplier").join(nation, "s_nationkey").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string"), F.lit("."), at[0]).alias("security_id"),
        at[0].alias("exchange_group"),
        at[1].alias("country_code"),
        at[2].alias("currency"),
        F.floor(F.col("s_suppkey") / 2).cast("long").alias("issuer_group_id"),
        F.when(F.col("s_suppkey") % 41 != 40, 1000.0 + 10 * F.col("s_suppkey")).alias("shares"),
        F.col("s_suppkey").alias("number"),
        F.when(F.col("s_suppkey") % 29 == 28, "preferred").otherwise("ordinary").alias("share_class"),
        (F.col("s_suppkey") % 10 == 7).alias("is_delisted"),
    )


def _after_delisting():
    """Lines (number, date) of names that are no longer traded by then."""
    return (F.col("number") % 10 == 7) & (F.col("date") > F.lit("1999-12-31").cast("date"))


#: Fixed value: bytes of the lines' files for each partition by security.
PART_BYTES = 8 << 20


def parts(spark: SparkSession, sf_dir: str) -> int:
    """Partitions by security: as many as the lines' size asks for, so that none grows with it, and at least one a core."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/lineitem.parquet")
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return max(spark.sparkContext.defaultParallelism, -(-size // PART_BYTES))


def daily_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of each security: open, high, low, close and volume, with its venue.

    Lines are shuffled by security, as few columns, and bars made of them there; two lines make a bar on average, so sums before the shuffle would be larger.
    """
    n = F.col("number")
    scale = F.when(n % 10 == 3, 5.0).otherwise(1.0)
    price = (50 + F.col("l_extendedprice") / 1000) / scale
    close = to_six((50 + mean_of_cents(F.col("l_extendedprice"), 1000.0)) / scale)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("number"), "l_extendedprice", "l_quantity", week_end(F.col("l_shipdate")).alias("date"))
    bars = (
        lines.where(~_after_delisting()).repartition(parts(spark, sf_dir), "number")
        .withColumn("p", price)
        .groupBy("number", "date")
        .agg(F.max("p").alias("high_raw"), F.min("p").alias("low_raw"), close.alias("close_raw"), (F.sum("l_quantity") * 1000 * (1 + F.col("number") % 10)).alias("volume"))
        .withColumn("open_raw", (F.col("high_raw") + F.col("low_raw")) / 2)
    )
    return bars.join(securities(spark, sf_dir), "number")


def corporate_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dividends, splits and payments at delisting: number, date, action_type, action_value, action_ratio."""
    line = table(spark, sf_dir, "lineitem")
    cash = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_discount") >= 0.095)
    split = (F.col("l_returnflag") == "A") & (F.col("l_discount") < 0.005) & (F.col("l_tax") >= 0.075)
    even = F.col("l_linenumber") % 2 == 0
    traded = line.select(F.col("l_suppkey").alias("number"), week_end(F.col("l_shipdate")).alias("date")).where(F.col("number") % 20 == 7)
    paid = traded.where(~_after_delisting()).groupBy("number").agg(F.max("date").alias("date"))
    paid = paid.select("number", "date", F.lit("delisting_cashout").alias("action_type"), F.lit(1.0).alias("action_value"), F.lit(None).cast("double").alias("action_ratio"))
    return line.where(cash | split).select(
        F.col("l_suppkey").alias("number"),
        week_end(F.col("l_shipdate")).alias("date"),
        F.when(cash, "cash_dividend").when(even, "split").otherwise("reverse_split").alias("action_type"),
        F.when(cash, 10 * F.col("l_tax")).alias("action_value"),
        F.when(~cash, F.when(even, 2.0).otherwise(0.5)).alias("action_ratio"),
    ).unionByName(paid)


def currency_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed rates to SEK: currency, date, sek_per_ccy; a first one on 1994-12-31."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(nation, "c_nationkey")
    currency = _pick(F.col("n_regionkey"), RATE_CURRENCY)
    seen = (
        table(spark, sf_dir, "orders")
        .select(F.col("o_custkey").alias("c_custkey"), "o_totalprice", F.to_date("o_orderdate").alias("date"))
        .join(customer, "c_custkey")
        .withColumn("currency", currency)
        .where("currency is not null")
        .groupBy("currency", "date")
        .agg(to_six(0.8 + mean_of_cents(F.col("o_totalprice"), 1e6)).alias("sek_per_ccy"))
    )
    first = seen.select("currency").distinct().select("currency", F.lit("1994-12-31").cast("date").alias("date"), F.lit(1.0).alias("sek_per_ccy"))
    return seen.unionByName(first)


def benchmark_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly levels of three benchmarks: benchmark_id, date, adj_close."""
    names = {1: "primary", 2: "secondary", 3: "tertiary"}
    which = _pick(F.substring("o_orderpriority", 1, 1).cast("int"), names)
    return (
        table(spark, sf_dir, "orders")
        .select(which.alias("benchmark_id"), week_end(F.col("o_orderdate")).alias("date"), "o_totalprice")
        .where("benchmark_id is not null")
        .groupBy("benchmark_id", "date")
        .agg((100 + to_six(mean_of_cents(F.col("o_totalprice"), 5000.0))).alias("adj_close"))
    )


def named_benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``benchmark_prices`` with benchmark_name, benchmark_type (total_return or proxy), currency and close_sek."""
    which = F.col("benchmark_id")
    return benchmark_prices(spark, sf_dir).select(
        "benchmark_id", F.concat(F.initcap(which), F.lit(" index")).alias("benchmark_name"), F.when(which == "primary", "total_return").otherwise("proxy").alias("benchmark_type"), F.lit("SEK").alias("currency"), "date", "adj_close", F.col("adj_close").alias("close_sek"),
    )


# The same tables in DuckDB SQL, as common table expressions.
_WEEK = "(date_trunc('week', {0})::date + 4)"


def _six(x: str) -> str:
    return f"(floor(({x}) * 1e6 + 0.5::double) / 1e6)"


def _mean(c: str, divisor: float) -> str:
    return f"(sum(round({c} * 100)::bigint)::double / (count({c}) * {100 * divisor}::double))"


_SCALE = "case when number % 10 = 3 then 5.0::double else 1.0::double end"


def _case(key: str, values: dict[int, str]) -> str:
    return f"case {key} " + " ".join(f"when {k} then '{v}'" for k, v in values.items()) + " end"


SQL = f"""
sec as (select 'S' || s_suppkey || '.' || {_case("n_regionkey", {k: v[0] for k, v in VENUES.items()})} as security_id,
    {_case("n_regionkey", {k: v[0] for k, v in VENUES.items()})} as exchange_group,
    {_case("n_regionkey", {k: v[1] for k, v in VENUES.items()})} as country_code,
    {_case("n_regionkey", {k: v[2] for k, v in VENUES.items()})} as currency,
    s_suppkey // 2 as issuer_group_id, case when s_suppkey % 41 <> 40 then 1000.0::double + 10 * s_suppkey end as shares, s_suppkey as number,
    case when s_suppkey % 29 = 28 then 'preferred' else 'ordinary' end as share_class, s_suppkey % 10 = 7 as is_delisted
    from supplier join nation on s_nationkey = n_nationkey),
bar as (select number, date, max(p) as high_raw, min(p) as low_raw, {_six(f"(50 + {_mean('x', 1000.0)}) / {_SCALE}")} as close_raw,
    sum(q) * 1000 * (1 + number % 10) as volume, (max(p) + min(p)) / 2 as open_raw
    from (select l_suppkey as number, {_WEEK.format("l_shipdate")} as date, l_quantity as q, l_extendedprice as x,
        (50 + l_extendedprice / 1000) / case when l_suppkey % 10 = 3 then 5.0::double else 1.0::double end as p from lineitem)
    where not (number % 10 = 7 and date > date '1999-12-31') group by number, date),
px as (select * from bar join sec using (number)),
act as (select l_suppkey as number, {_WEEK.format("l_shipdate")} as date,
    case when l_returnflag = 'R' then 'cash_dividend' when l_linenumber % 2 = 0 then 'split' else 'reverse_split' end as action_type,
    case when l_returnflag = 'R' then 10 * l_tax end as action_value,
    case when l_returnflag = 'A' then case when l_linenumber % 2 = 0 then 2.0::double else 0.5::double end end as action_ratio
    from lineitem where (l_returnflag = 'R' and l_linestatus = 'F' and l_discount >= 0.095)
        or (l_returnflag = 'A' and l_discount < 0.005 and l_tax >= 0.075)
    union all select number, max(date), 'delisting_cashout', 1.0::double, null::double from bar where number % 20 = 7 group by number),
fx0 as (select {_case("n_regionkey", RATE_CURRENCY)} as currency, o_orderdate::date as date, {_six(f"0.8::double + {_mean('o_totalprice', 1e6)}")} as sek_per_ccy
    from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
    where n_regionkey in (1, 2, 3, 4) group by 1, 2),
fx as (select * from fx0 union all select distinct currency, date '1994-12-31', 1.0::double from fx0),
bench as (select case substr(o_orderpriority, 1, 1) when '1' then 'primary' when '2' then 'secondary' when '3' then 'tertiary' end as benchmark_id,
    {_WEEK.format("o_orderdate")} as date, 100 + {_six(_mean("o_totalprice", 5000.0))} as adj_close
    from orders where substr(o_orderpriority, 1, 1) in ('1', '2', '3') group by 1, 2)
"""
