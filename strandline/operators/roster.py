"""Rosters merged, matched to official lists and cut down to an allowlist, by equi-joins on normalised keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import text

#: Words that speak against a company being a common share, and the reason they give.
REASONS = [
    (r"\b(etf|etn)\b", "fund_or_exchange_traded_product"),
    (r"\b(fund|fond|fonden)\b", "fund_or_exchange_traded_product"),
    (r"\binvesteringsforeningen\b", "fund_or_exchange_traded_product"),
    (r"\b(oblig|bond)\b", "bond_or_obligation_product"),
    (r"\b(certificate|certifikat|warrant|rights|unit|trust)\b", "non_common_share_instrument"),
    (r"\b(pref|preference|pfd)\b", "preferred_share_like"),
    (r"\b(clo|pensionplanner)\b", "fund_or_credit_vehicle"),
    (r"\bakk\b", "accumulating_fund_share_class"),
    (r"\bkl\b", "fund_share_class_kl"),
]
INACTIVE, NEEDS_REVIEW = "not_currently_active", "active_common_share_needs_segment_review"


def merged(active: DataFrame, delisted: DataFrame) -> DataFrame:
    """Both rosters by security_id with vendor_roster_status; the active row wins, of repeated rows the least one. Rows without an id go."""

    def one(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c != "security_id"]
        return df.where("security_id is not null").groupBy("security_id").agg(F.min(F.struct(*rest)).alias("row"))

    both = one(active).withColumnRenamed("row", "a").join(one(delisted).withColumnRenamed("row", "d"), "security_id", "full_outer")
    status = F.when(F.col("a").isNull(), "delisted_only").when(F.col("d").isNull(), "active_only").otherwise("both")
    return both.select("security_id", F.coalesce("a", "d").alias("row"), status.alias("vendor_roster_status")).select("security_id", "row.*", "vendor_roster_status")


def recommendation(name: Column, status: Column) -> tuple[Column, Column]:
    """(exclude or candidate, reason): the first pattern that fits; names are matched in any case."""
    reason = F.when(~F.coalesce(status == "active_only", F.lit(False)), INACTIVE)
    for pattern, why in REASONS:
        reason = reason.when(F.lower(text.clean(name)).rlike(pattern), why)
    reason = reason.otherwise(NEEDS_REVIEW)
    return F.when(reason == NEEDS_REVIEW, "candidate").otherwise("exclude"), reason


def matched(official: DataFrame, roster: DataFrame) -> DataFrame:
    """official_id, security_id and match_reason.

    Within an exchange, the only roster row with the isin, else with the symbol key, else with the company key; else "unmatched".
    A key that several roster rows share, or that is empty or null, matches none. A tier's roster side is aggregated by key first.
    """
    keys = {"isin": lambda df: F.upper(text.clean(F.col("isin"))), "symbol": None, "company": lambda df: text.company_key(F.col("company_name"))}
    out, found, reason = official, [], None
    for tier, key in keys.items():
        theirs = key(official) if key else text.symbol_key(F.col("symbol"))
        ours = key(roster) if key else text.symbol_key(text.stem(F.col("security_id")))
        one = roster.select(F.col("exchange_group"), ours.alias("key "), "security_id").where("`key ` <> ''").groupBy("exchange_group", "key ")
        one = one.agg(F.min("security_id").alias(f"{tier} id"), F.count("*").alias("n ")).where("`n ` = 1").drop("n ")
        out = out.withColumn("key ", theirs).join(one, ["exchange_group", "key "], "left").drop("key ")
        hit = F.col(f"`{tier} id`").isNotNull()
        reason = F.when(hit, f"exchange_plus_{tier}") if reason is None else reason.when(hit, f"exchange_plus_{tier}")
        found.append(F.col(f"`{tier} id`"))
    return out.select("official_id", F.coalesce(*found).alias("security_id"), reason.otherwise("unmatched").alias("match_reason"))


def finalised(rows: DataFrame) -> DataFrame:
    """Hand-typed rows trimmed, in upper case, those to include only."""
    kept = [F.upper(text.clean(F.col(c))).alias(c) for c in ("security_id", "exchange_group", "isin")]
    return rows.where(text.flag(F.col("include"), True)).select(*kept)


def in_scope(rows: DataFrame, groups: list[str], codes: list[str]) -> DataFrame:
    """Rows whose group is active, or without a group whose id's code is, or has none; without id and isin they go.

    Of rows that repeat (security_id, isin) one stays, with the greatest group.
    """
    code = text.exchange_code(F.col("security_id"))
    scope = F.when(F.col("exchange_group") != "", F.col("exchange_group").isin(groups)).otherwise((code == "") | code.isin(codes))
    return rows.where(scope & ((F.col("security_id") != "") | (F.col("isin") != ""))).groupBy("security_id", "isin").agg(F.max("exchange_group").alias("exchange_group"))


def allowed(roster: DataFrame, allow: DataFrame) -> DataFrame:
    """security_id, allowed_by and n_rows (of the allowlist that match): by id, else by exchange and isin, else by isin of rows that have nothing else."""
    tiers = {
        "id": ("security_id <> ''", ["security_id"]),
        "exchange_isin": ("exchange_group <> '' and isin <> ''", ["exchange_group", "isin"]),
        "isin_only": ("exchange_group = '' and security_id = '' and isin <> ''", ["isin"]),
    }
    out, by = roster.select(*[F.upper(c).alias(c) for c in ("security_id", "exchange_group", "isin")]), None
    for tier, (which, keys) in tiers.items():
        out = out.join(allow.where(which).groupBy(*keys).agg(F.count("*").alias(tier)), keys, "left")
        by = F.when(F.col(tier).isNotNull(), tier) if by is None else by.when(F.col(tier).isNotNull(), tier)
    return out.select("security_id", by.alias("allowed_by"), F.coalesce(*tiers).alias("n_rows")).where("allowed_by is not null")


def unmatched(allow: DataFrame, roster: DataFrame) -> DataFrame:
    """Allowlist rows that stand for no roster row, whatever tier it was allowed by."""
    upper = roster.select(*[F.upper(c).alias(c) for c in ("security_id", "exchange_group", "isin")])
    left = allow.join(upper.select("security_id"), "security_id", "left_anti")
    whole = left.where("exchange_group <> ''").join(upper.select("exchange_group", "isin"), ["exchange_group", "isin"], "left_anti")
    bare = left.where("exchange_group = '' and security_id = ''").join(upper.select("isin"), "isin", "left_anti")
    return whole.unionByName(bare).unionByName(left.where("exchange_group = '' and security_id <> ''"))


def oversize(roster: DataFrame, limits: DataFrame) -> DataFrame:
    """exchange_group, n_active, most, oversize: active common shares of each exchange against ``limits`` (exchange_group, most)."""
    code = text.stem(F.col("security_id")) if "security_id" in roster.columns else None
    counts = roster.where("vendor_roster_status <> 'delisted_only'").where(text.security_type(F.col("company_name"), code) == "common_share")
    counts = counts.groupBy("exchange_group").agg(F.count("*").alias("n_active"))
    return counts.join(F.broadcast(limits), "exchange_group").select("exchange_group", "n_active", "most", (F.col("n_active") > F.col("most")).alias("oversize"))


def contract(df: DataFrame, needed: list[str]) -> DataFrame:
    """One row: n_missing (columns of ``needed`` that ``df`` lacks) and is_empty."""
    return df.limit(1).agg((F.count("*") == 0).alias("is_empty")).select(F.lit(len(set(needed) - set(df.columns))).cast("long").alias("n_missing"), "is_empty")


def master(rows: DataFrame, exchanges: DataFrame, currency: str) -> DataFrame:
    """Master rows of ordinary common shares on known exchanges: ``exchanges`` has exchange_group, country_code and currency (null: the default).

    One row for each row kept; names that are null are common and ordinary, with an empty issuer.
    """
    name, code = F.col("company_name"), text.stem(F.col("security_id"))
    kept = rows.where((text.security_type(name, code) == "common_share") & (text.share_class(name, code) == "ordinary")).join(F.broadcast(exchanges), "exchange_group")
    return kept.select(
        "security_id", code.alias("ticker_local"), text.exchange_code(F.col("security_id")).alias("exchange_code"), "exchange_group", "country_code",
        F.coalesce("currency", F.lit(currency)).alias("currency"), text.issuer_group(name).alias("issuer_group_id"), (F.col("vendor_roster_status") == "delisted_only").alias("is_delisted"),
    )


def master_rows(rows: DataFrame, exchanges: DataFrame, currency: str) -> DataFrame:
    """As ``master``, with all columns of a security master: symbols, isin, name, venue, roster status, raw and normalised type and class; dates and shares are unknown here.

    ``exchanges`` has exchange_group, exchange_name, country_code and currency. A roster's raw type is the part of its name that tells it, which it is taken from; without one both raw columns are empty.
    """
    name, code = F.col("company_name"), text.stem(F.col("security_id"))
    kind, share = text.security_type(name, code), text.share_class(name, code)
    kept = rows.where((kind == "common_share") & (share == "ordinary")).join(F.broadcast(exchanges), "exchange_group")
    unknown = {"listing_date": "date", "delisting_date": "date", "shares_outstanding": "double"}
    return kept.select(
        "security_id", F.col("security_id").alias("eodhd_symbol"), code.alias("ticker_local"), F.when(text.clean(F.col("isin")) != "", text.clean(F.col("isin"))).alias("isin"), text.clean(name).alias("company_name"),
        "country_code", "exchange_name", "exchange_group", text.issuer_group(name).alias("issuer_group_id"), "vendor_roster_status", F.coalesce("currency", F.lit(currency)).alias("currency"),
        F.lit("").alias("security_type_raw"), kind.alias("security_type_normalized"), F.lit("").alias("share_class_raw"), share.alias("share_class_normalized"),
        *[F.lit(None).cast(t).alias(c) for c, t in unknown.items()], (F.col("vendor_roster_status") == "delisted_only").alias("is_delisted"),
    )
