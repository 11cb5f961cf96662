"""Checks as data: counts and first offenders however rows are dealt out, missing tables as rows, and rules watched while a table is written."""

import random

import pytest

from strandline.operators import checks
from strandline.operators.checks import Rule
from strandline.plans.checks import RULES

SOME = (Rule("a", "negative", "x < 0"), Rule("a", "unknown", "x is null"), Rule("b", "odd", "x % 2 = 1"), Rule("b", "never", "false"))


@pytest.mark.parametrize("parts", [1, 7])
def test_counts_and_first_offenders(spark, parts):
    made = random.Random(4)
    rows = [(f"k{made.randrange(400)}é" if k % 50 else None, made.choice([None, *range(-3, 9)])) for k in range(700)]
    df = spark.createDataFrame(rows, "name string, x int").repartition(parts)
    got = {(r.section, r.check_name): (r.n_rows, r.n_bad, list(r.sample)) for r in checks.checked(df, SOME, "name").collect()}
    tests = {("a", "negative"): lambda x: x is not None and x < 0, ("a", "unknown"): lambda x: x is None, ("b", "odd"): lambda x: x is not None and x > 0 and x % 2 == 1, ("b", "never"): lambda x: False}
    for key, bad in tests.items():
        own = [n if n is not None else "null" for n, x in rows if bad(x)]
        assert got[key] == (700, len(own), sorted(own, key=str.encode)[:5])
    status = {r.section: (r.n_checks, r.n_failed, r.status) for r in checks.report(checks.checked(df, SOME, "name")).collect()}
    assert status == {"a": (2, 2, "FAIL"), "b": (2, 1, "FAIL"), "all": (4, 3, "FAIL")}
    empty = checks.outcome(checks.checked(df.where("false"), SOME, "name")).collect()
    assert len(empty) == 4 and all((r.n_rows, r.n_bad, r.status, r.sample) == (0, 0, "PASS", "") for r in empty)


def test_repeated_keys(spark):
    rows = [(1, "a"), (1, "a"), (1, "a"), (1, None), (1, None), (2, "b")]
    r = checks.repeated(spark.createDataFrame(rows, "n int, s string"), "t", ["n", "s"]).first()
    assert (r.section, r.check_name, r.n_rows, r.n_bad, list(r.sample)) == ("t", "duplicate_key", 3, 2, ["1:a", "1:null"])


def test_missing_and_empty_tables_are_rows(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "full.parquet"))
    spark.range(0).write.parquet(str(tmp_path / "bare.parquet"))
    got = {r.check_name: (r.status, r.sample) for r in checks.outcome(checks.present(spark, str(tmp_path), {"full": ["id", "x", "w"], "bare": ["id"], "gone": ["a", "b"]})).collect()}
    assert got == {
        "full_missing": ("PASS", ""), "full_empty": ("PASS", ""), "full_columns": ("FAIL", "w,x"), "bare_missing": ("PASS", ""), "bare_empty": ("FAIL", "bare"), "bare_columns": ("PASS", ""),
        "gone_missing": ("FAIL", "gone"), "gone_empty": ("FAIL", "gone"), "gone_columns": ("FAIL", "a,b"),
    }


def test_rules_watched_while_a_table_is_written(spark, tmp_path):
    df, seen = checks.watched(spark.createDataFrame([(k,) for k in (-1, 2, 3, None)], "x int"), SOME)
    df.write.parquet(str(tmp_path / "out"))
    assert seen.get == {"n_rows": 4, "negative": 1, "unknown": 1, "odd": 1, "never": 0}


GOOD = {
    "month": 24000, "security_id": "S1.ST", "exchange_group": "ST", "status_source": "shares", "listing_age_months": 20, "status_age": 20, "market_cap_sek": 10.0, "status_cap": 10.0, "reason": "", "reason_se": "", "liquid_reason": "",
    "is_liquid": True, "eligible": True, "close_sek": 30.0, "next_execution_date": "2000-02-01", "anchor_date": "2000-01-31", "delisted_before_execution": False, "any_liquid": True, "top_third": True, "in_universe": True, "in_status": True,
}
BROKEN = {
    "not_in_status": {"in_status": False}, "not_in_universe": {"in_universe": False}, "proxy_market_value": {"status_source": "trade_value_proxy_market_cap"}, "age_differs": {"status_age": 21}, "market_value_differs": {"status_cap": 10.1},
    "se_only_elsewhere": {"exchange_group": "CO"}, "liquid_not_full": {"reason": "x", "eligible": False}, "full_not_eligible": {"eligible": False}, "eligible_not_full": {"reason": "x", "is_liquid": False, "top_third": False},
    "no_reason": {"liquid_reason": None}, "too_young": {"listing_age_months": 17, "status_age": 17}, "too_cheap": {"close_sek": 19.99}, "execution_not_after_anchor": {"next_execution_date": "2000-01-31"},
    "delisted_before_execution": {"delisted_before_execution": True}, "liquid_without_value": {"market_cap_sek": None}, "liquid_not_top_third": {"top_third": False},
    "liquid_reason_domain": {"any_liquid": False, "is_liquid": False, "liquid_reason": "other"},
}


def test_each_invariant_of_the_universe_finds_what_breaks_it(spark):
    key, rules = RULES["ck_universe"]
    assert set(BROKEN) == {r.name for r in rules} and len(rules) == 17
    rows = [GOOD | {"security_id": "good"}] + [GOOD | change | {"security_id": name} for name, change in BROKEN.items()]
    kinds = {int: "int", float: "double", str: "string", bool: "boolean"}
    df = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{c} {kinds[type(v)]}" for c, v in GOOD.items()))
    for r in checks.checked(df, rules, key).collect():
        assert list(r.sample) == [f"24000:{r.check_name}"], r
