"""Rosters on small tables."""

import pytest
from pyspark.sql import functions as F

from strandline.operators import roster
from strandline.plans import queries

ROSTER = "security_id string, exchange_group string, isin string, company_name string"


def test_merged(spark):
    active = spark.createDataFrame([("A.ST", "ST", "1", "Alpha"), ("A.ST", "ST", "1", "Alpha"), (None, "ST", None, "None"), ("B.ST", None, None, None)], ROSTER)
    gone = spark.createDataFrame([("A.ST", "ST", "2", "Old Alpha"), ("C.ST", "ST", None, "Gamma")], ROSTER)
    got = {r.security_id: (r.company_name, r.isin, r.vendor_roster_status) for r in roster.merged(active, gone).collect()}
    assert got == {"A.ST": ("Alpha", "1", "both"), "B.ST": (None, None, "active_only"), "C.ST": ("Gamma", None, "delisted_only")}


def test_matched_in_tiers(spark):
    rows = [("A.ST", "ST", "S1", "Alpha AB"), ("B-A.ST", "ST", "S2", "Beta"), ("C.ST", "ST", "S2", "Gamma"), ("D.OL", "OL", "S3", "Delta ASA"), ("E.ST", "ST", None, "Twin"), ("F.ST", "ST", None, "Twin AB")]
    official = [(1, "ST", "s1 ", "ZZ", ""), (2, "ST", "S2", "b a", ""), (3, "ST", "S3", "D", "Delta"), (4, "OL", None, "", "DELTA limited"), (5, "ST", None, None, "Twin"), (6, "ST", None, None, None)]
    got = roster.matched(spark.createDataFrame(official, "official_id int, exchange_group string, isin string, symbol string, company_name string"), spark.createDataFrame(rows, ROSTER))
    assert {r.official_id: (r.security_id, r.match_reason) for r in got.collect()} == {
        1: ("A.ST", "exchange_plus_isin"), 2: ("B-A.ST", "exchange_plus_symbol"), 3: (None, "unmatched"),
        4: ("D.OL", "exchange_plus_company"), 5: (None, "unmatched"), 6: (None, "unmatched"),
    }


def test_recommendation(spark):
    rows = [("Alpha AB", "active_only"), ("Alpha ETF", "both"), ("Alpha Fund Bond", "active_only"), ("Bondi", "active_only"), ("x PREF", "active_only"), (None, None)]
    df = spark.createDataFrame(rows, "n string, s string")
    got = df.select(*roster.recommendation(F.col("n"), F.col("s"))).collect()
    assert [tuple(r) for r in got] == [
        ("candidate", roster.NEEDS_REVIEW), ("exclude", roster.INACTIVE), ("exclude", "fund_or_exchange_traded_product"),
        ("candidate", roster.NEEDS_REVIEW), ("exclude", "preferred_share_like"), ("exclude", roster.INACTIVE),
    ]


def test_allowlist(spark):
    kind = "security_id string, exchange_group string, isin string, include string"
    typed = [(" a.st", "", "", "yes"), ("A.ST", "", "", None), ("", "ol", "S3", "1"), ("", "", "S2", ""), ("", "XX", "S9", "y"), ("", "", "", "y"), ("Q.XX", "", "", "y"), ("Z.ST", "", "", "y"), ("C.ST", "", "", "no")]
    allow = roster.in_scope(roster.finalised(spark.createDataFrame(typed, kind)), ["ST", "OL"], ["ST", "OL"])
    assert {(r.security_id, r.isin) for r in allow.collect()} == {("A.ST", ""), ("", "S3"), ("", "S2"), ("Z.ST", "")}
    listed = spark.createDataFrame([("A.ST", "ST", "S1", "Alpha"), ("B.ST", "ST", "S2", "Beta"), ("D.OL", "OL", "S3", "Delta"), ("C.ST", "ST", None, "Gamma")], ROSTER)
    assert {(r.security_id, r.allowed_by, r.n_rows) for r in roster.allowed(listed, allow).collect()} == {("A.ST", "id", 1), ("B.ST", "isin_only", 1), ("D.OL", "exchange_isin", 1)}
    assert [r.security_id for r in roster.unmatched(allow, listed).collect()] == ["Z.ST"]
    with pytest.raises(Exception, match="not a flag"):
        roster.finalised(spark.createDataFrame([("a", "", "", "maybe")], kind)).collect()


def test_contract_and_size(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert tuple(roster.contract(df, ["a", "b"]).first()) == (0, False)
    assert tuple(roster.contract(df.limit(0), ["a", "c"]).first()) == (1, True)
    rows = spark.createDataFrame([("ST", "Alpha", "both"), ("ST", "Beta", "active_only"), ("ST", "Fund", "both"), ("ST", "Old", "delisted_only")], "exchange_group string, company_name string, vendor_roster_status string")
    assert [tuple(r) for r in roster.oversize(rows, spark.createDataFrame([("ST", 1)], "exchange_group string, most int")).collect()] == [("ST", 2, 1, True)]


def test_master(spark):
    rows = [("A-B.ST", "ST", "Alpha AB (publ)", "both"), ("B.ST", "ST", "Beta Pref", "both"), ("C.ST", "ST", "Gamma Fund", "both"), ("D.OL", "OL", "Delta & Sons ASA", "delisted_only"), ("E.QQ", "QQ", "Eta", "both"), ("F.ST", "ST", None, None)]
    known = spark.createDataFrame([("ST", "SE", None), ("OL", "NO", "NOK")], "exchange_group string, country_code string, currency string")
    got = roster.master(spark.createDataFrame(rows, "security_id string, exchange_group string, company_name string, vendor_roster_status string"), known, "SEK")
    assert {(r.security_id, r.ticker_local, r.exchange_code, r.currency, r.issuer_group_id, r.is_delisted) for r in got.collect()} == {
        ("A-B.ST", "A-B", "ST", "SEK", "alpha", False), ("D.OL", "D", "OL", "NOK", "delta-and-sons", True), ("F.ST", "F", "ST", "SEK", "", None),
    }


def test_registered():
    assert {"merged_rosters", "official_matches", "allowlist_matches"} <= set(queries.queries()) & set(queries.oracle_sql())
