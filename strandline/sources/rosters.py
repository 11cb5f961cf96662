"""Vendor rosters, an official list and an allowlist derived from customers; delistings from suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.sources.market import VENUES, _case, _pick, table

#: What company names end with, by number.
ENDINGS = {0: " AB", 1: " ASA", 2: " ETF", 3: " Fund", 4: " Bond", 5: " Pref", 6: " Warrant", 7: " Akk", 8: " Oyj", 9: " PLC", 10: " KL", 11: ""}


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("number")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    rows = table(spark, sf_dir, "customer").join(nation, "c_nationkey").withColumn("number", F.col("c_custkey"))
    group, country = (_pick(F.col("n_regionkey"), {k: v[i] for k, v in VENUES.items()}) for i in (0, 1))
    shared = F.when((n % 10).isin(1, 2), n - n % 10).otherwise(n)
    return rows.select(
        "number",
        group.alias("exchange_group"),
        F.concat(F.lit("C"), n.cast("string"), F.when(n % 4 == 0, "-B").otherwise("")).alias("ticker"),
        F.when(n % 3 != 0, F.concat(country, F.lpad(shared.cast("string"), 10, "0"))).alias("isin"),
        F.concat(F.regexp_replace("c_name", "#", " "), _pick(n % 12, ENDINGS)).alias("company_name"),
    )


def active_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """security_id, exchange_group, isin, company_name."""
    return _listed(spark, sf_dir).where("number % 7 <> 3").select(F.concat("ticker", F.lit("."), "exchange_group").alias("security_id"), "exchange_group", "isin", "company_name")


def delisted_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.concat("company_name", F.lit(" (old)")).alias("company_name")
    return _listed(spark, sf_dir).where("number % 4 = 1").select(F.concat("ticker", F.lit("."), "exchange_group").alias("security_id"), "exchange_group", "isin", old)


def official_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """official_id, exchange_group, isin, symbol, company_name of a venue's own list, which spells some differently."""
    n = F.col("number")
    symbol = F.when(n % 9 == 0, F.concat(F.lit("X"), n.cast("string"))).otherwise(F.regexp_replace("ticker", "-", " "))
    name = F.when(n % 18 == 0, F.lit("Unknown")).otherwise(F.concat(F.upper("company_name"), F.lit(" Limited")))
    return _listed(spark, sf_dir).where("number % 11 <> 5").select(n.alias("official_id"), "exchange_group", "isin", symbol.alias("symbol"), name.alias("company_name"))


def allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as typed by hand: security_id, exchange_group, isin, include (texts; blanks, spaces and repeats)."""
    n = F.col("number")
    rows = _listed(spark, sf_dir).where("number % 2 = 0").select(
        F.when(n % 8 == 0, F.concat(F.lit(" "), "ticker", F.lit("."), "exchange_group")).otherwise("").alias("security_id"),
        F.when(n % 6 == 2, F.col("exchange_group")).otherwise("").alias("exchange_group"),
        F.coalesce("isin", F.lit("")).alias("isin"),
        F.when(n % 10 == 4, "no").otherwise(" Yes").alias("include"),
    )
    return rows.unionByName(rows.where("security_id <> ''"))


def delistings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """number of securities that ended; some are missing and some unknown."""
    n = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").where("s_suppkey % 10 = 9 or (s_suppkey % 10 = 7 and s_suppkey % 30 <> 7)").select(F.when(n % 10 == 9, -n).otherwise(n).alias("number"))


_GROUP, _COUNTRY = (_case("n_regionkey", {k: v[i] for k, v in VENUES.items()}) for i in (0, 1))
SQL = f"""
listed as (select number, exchange_group, 'C' || number || case when number % 4 = 0 then '-B' else '' end as ticker,
    case when number % 3 <> 0 then country || lpad((case when number % 10 in (1, 2) then number - number % 10 else number end)::varchar, 10, '0') end as isin,
    replace(c_name, '#', ' ') || {_case("number % 12", ENDINGS)} as company_name
    from (select *, c_custkey as number, {_GROUP} as exchange_group, {_COUNTRY} as country from customer join nation on c_nationkey = n_nationkey)),
active as (select ticker || '.' || exchange_group as security_id, exchange_group, isin, company_name from listed where number % 7 <> 3),
gone as (select ticker || '.' || exchange_group as security_id, exchange_group, isin, company_name || ' (old)' as company_name from listed where number % 4 = 1),
official as (select number as official_id, exchange_group, isin, case when number % 9 = 0 then 'X' || number else replace(ticker, '-', ' ') end as symbol,
    case when number % 18 = 0 then 'Unknown' else upper(company_name) || ' Limited' end as company_name from listed where number % 11 <> 5),
allow0 as (select case when number % 8 = 0 then ' ' || ticker || '.' || exchange_group else '' end as security_id, case when number % 6 = 2 then exchange_group else '' end as exchange_group,
    coalesce(isin, '') as isin, case when number % 10 = 4 then 'no' else ' Yes' end as include from listed where number % 2 = 0),
allow as (select * from allow0 union all select * from allow0 where security_id <> ''),
ended as (select case when s_suppkey % 10 = 9 then -s_suppkey else s_suppkey end as number from supplier where s_suppkey % 10 = 9 or (s_suppkey % 10 = 7 and s_suppkey % 30 <> 7))
"""
