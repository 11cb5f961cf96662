"""Registered queries from vendor rosters to the securities in scope, with the checks on what comes in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from strandline.functions import text
from strandline.operators import roster, universe
from strandline.plans.queries import _DAILY, _UNIVERSE, monthly, query
from strandline.sources import market, rosters

#: Active exchanges, their codes, most active shares of each, days a history may end early.
GROUPS, CODES, EARLY_DAYS = ["ST", "CO", "OL"], ["ST", "CO", "OL"], 30
LIMITS = [("ST", 400), ("CO", 200), ("OL", 200), ("XX", 100)]
#: Columns that the tables must have.
NEEDED = {
    "lineitem": ["l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_linenumber"],
    "orders": ["o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "supplier": ["s_suppkey", "s_nationkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey"],
    "nation": ["n_nationkey", "n_regionkey"],
    "events": ["ts"],
}

_ROSTER = rosters.SQL.strip()
_NAME = "lower(trim(coalesce(company_name, '')))"
_REASON = f"case when coalesce(vendor_roster_status, '') <> 'active_only' then '{roster.INACTIVE}' " + " ".join(f"when regexp_matches({_NAME}, '{p}') then '{r}'" for p, r in roster.REASONS) + f" else '{roster.NEEDS_REVIEW}' end"
_CODE = "split_part(security_id, '.', 1)"
_TYPE = text.type_sql("company_name", _CODE)
_MERGED = f"""{_ROSTER},
ro as (select security_id, case when a.security_id is null then d.exchange_group else a.exchange_group end as exchange_group, case when a.security_id is null then d.isin else a.isin end as isin,
    coalesce(a.company_name, d.company_name) as company_name,
    case when a.company_name is null then 'delisted_only' when d.company_name is null then 'active_only' else 'both' end as vendor_roster_status
    from active a full outer join gone d using (security_id)),
rv as (select *, {_REASON} as reason from ro)"""
_FINAL = f"""{_MERGED},
fin as (select upper(trim(security_id)) as security_id, upper(trim(exchange_group)) as exchange_group, upper(trim(isin)) as isin from allow where lower(trim(include)) <> 'no'),
al as (select security_id, isin, max(exchange_group) as exchange_group from (select *, case when instr(security_id, '.') > 0 then split_part(security_id, '.', -1) else '' end as code from fin)
    where (security_id <> '' or isin <> '') and case when exchange_group <> '' then exchange_group in {tuple(GROUPS)} else code = '' or code in {tuple(CODES)} end group by 1, 2)"""


def _with(sql: str) -> str:
    return "with " + sql


def _merged(spark, sf_dir):
    return roster.merged(rosters.active_roster(spark, sf_dir), rosters.delisted_roster(spark, sf_dir))


def _allow(spark, sf_dir):
    return roster.in_scope(roster.finalised(rosters.allowlist(spark, sf_dir)), GROUPS, CODES)


@query(_with(f"{_MERGED} select security_id, exchange_group, isin, company_name, vendor_roster_status from ro"))
def merged_rosters(spark, sf_dir):
    """Active and delisted rosters in one."""
    return _merged(spark, sf_dir)


@query(_with(f"{_MERGED} select security_id, case when reason = '{roster.NEEDS_REVIEW}' then 'candidate' else 'exclude' end as recommendation, reason from rv"))
def review_recommendations(spark, sf_dir):
    """Which names to review, and why others are out (PF13)."""
    decision, reason = roster.recommendation(F.col("company_name"), F.col("vendor_roster_status"))
    return _merged(spark, sf_dir).select("security_id", decision.alias("recommendation"), reason.alias("reason"))


_EXCHANGES = [("ST", "SE", None), ("CO", "DK", "DKK"), ("OL", "NO", "NOK")]
_DASHED = f"regexp_replace(regexp_replace(regexp_replace(lower(company_name), '\\([^)]*\\)', ' ', 'g'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"
_BARE = reduce(lambda x, own: f"regexp_replace({x}, '(^|-)({'|'.join(own)})(-({'|'.join(own)}))*$', '')", (text.SHARE_WORDS, text.LEGAL_WORDS), _DASHED)


@query(_with(f"""{_MERGED}
select security_id, split_part(security_id, '.', 1) as ticker_local, split_part(security_id, '.', -1) as exchange_code, exchange_group, country_code, coalesce(currency, 'SEK') as currency,
    {_BARE} as issuer_group_id, vendor_roster_status = 'delisted_only' as is_delisted
from ro join (values ('ST', 'SE', null), ('CO', 'DK', 'DKK'), ('OL', 'NO', 'NOK')) x(exchange_group, country_code, currency) using (exchange_group)
where {_TYPE} = 'common_share' and {text.class_sql("company_name", _CODE)} = 'ordinary'"""))
def security_master(spark, sf_dir):
    """Ordinary common shares of the roster as master rows (PF10, PF7)."""
    return roster.master(_merged(spark, sf_dir), spark.createDataFrame(_EXCHANGES, "exchange_group string, country_code string, currency string"), "SEK")


@query(_with(f"{_MERGED} select distinct security_id, exchange_group, isin from rv where reason = '{roster.NEEDS_REVIEW}' and exchange_group in {tuple(GROUPS)}"))
def review_shortlist(spark, sf_dir):
    """Candidates on active exchanges (PF11, PF14)."""
    decision, _ = roster.recommendation(F.col("company_name"), F.col("vendor_roster_status"))
    return _merged(spark, sf_dir).where((decision == "candidate") & F.col("exchange_group").isin(GROUPS)).select("security_id", "exchange_group", "isin").dropDuplicates()


_WORDS = ", ".join(f"'{w}'" for w in text.NOISE_WORDS)


def _company(c: str) -> str:
    return f"array_to_string(list_filter(string_split(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '' and w not in ({_WORDS})), ' ')"


def _tier(name: str, theirs: str, ours: str) -> str:
    return f"left join (select exchange_group as g, {ours} as k, min(security_id) as id from ro where {ours} <> '' group by 1, 2 having count(*) = 1) {name} on {name}.g = o.exchange_group and {name}.k = {theirs}"


@query(_with(f"""{_MERGED}
select official_id, coalesce(a.id, b.id, c.id) as security_id,
    case when a.id is not null then 'exchange_plus_isin' when b.id is not null then 'exchange_plus_symbol' when c.id is not null then 'exchange_plus_company' else 'unmatched' end as match_reason
from official o {_tier("a", "upper(trim(coalesce(o.isin, '')))", "upper(trim(coalesce(isin, '')))")}
{_tier("b", "regexp_replace(upper(o.symbol), '[^A-Z0-9]', '', 'g')", "regexp_replace(upper(split_part(security_id, '.', 1)), '[^A-Z0-9]', '', 'g')")}
{_tier("c", _company("o.company_name"), _company("company_name"))}"""))
def official_matches(spark, sf_dir):
    """A venue's list matched to the roster by three keys in turn."""
    return roster.matched(rosters.official_list(spark, sf_dir), _merged(spark, sf_dir))


@query(_with(f"{_FINAL} select security_id, isin from al"))
def allowlist_scope(spark, sf_dir):
    """The allowlist, cleaned and cut to active exchanges (PF14, PF15)."""
    return _allow(spark, sf_dir).select("security_id", "isin")


@query(_with(f"""{_FINAL},
m as (select r.security_id, case when a.n is not null then 'id' when b.n is not null then 'exchange_isin' when c.n is not null then 'isin_only' end as allowed_by, coalesce(a.n, b.n, c.n) as n_rows
    from ro r left join (select security_id, count(*) as n from al where security_id <> '' group by 1) a on a.security_id = r.security_id
    left join (select exchange_group, isin, count(*) as n from al where exchange_group <> '' and isin <> '' group by 1, 2) b on b.exchange_group = r.exchange_group and b.isin = r.isin
    left join (select isin, count(*) as n from al where exchange_group = '' and security_id = '' and isin <> '' group by 1) c on c.isin = r.isin)
select * from m where allowed_by is not null"""))
def allowlist_matches(spark, sf_dir):
    """Roster rows that the allowlist lets in, and by what."""
    return roster.allowed(_merged(spark, sf_dir), _allow(spark, sf_dir))


@query(_with(f"""{_FINAL}
select security_id, isin from al where not exists (select 1 from ro where ro.security_id = al.security_id)
    and not (exchange_group <> '' and exists (select 1 from ro where ro.exchange_group = al.exchange_group and ro.isin = al.isin))
    and not (exchange_group = '' and security_id = '' and exists (select 1 from ro where ro.isin = al.isin))"""))
def allowlist_unmatched(spark, sf_dir):
    """Allowlist rows that no roster row answers to."""
    return roster.unmatched(_allow(spark, sf_dir), _merged(spark, sf_dir)).select("security_id", "isin")


@query(_with(f"""{_MERGED}, most as (select * from (values {", ".join(map(str, LIMITS))}) t(exchange_group, most)),
n as (select exchange_group, count(*) as n_active from ro where vendor_roster_status <> 'delisted_only' and {_TYPE} = 'common_share' group by 1)
select exchange_group, n_active, most, n_active > most as oversize from n join most using (exchange_group)"""))
def roster_size_guard(spark, sf_dir):
    """Active common shares of each exchange against the most there should be."""
    return roster.oversize(_merged(spark, sf_dir), spark.createDataFrame(LIMITS, "exchange_group string, most int"))


@query(_with(f"""{_MERGED}
select exchange_group, count(*) as securities, count(*) filter (not regexp_matches(security_id, '^[^.]+\\.[A-Z]+$')) as bad_id, count(*) filter (exchange_group is null or exchange_group not in {tuple(GROUPS)}) as bad_venue,
    count(*) filter (vendor_roster_status is null or vendor_roster_status not in ('active_only', 'delisted_only', 'both')) as bad_status,
    count(*) filter ({_TYPE} <> 'common_share') as bad_type, count(*) filter (coalesce(trim(company_name), '') = '') as no_issuer from ro group by 1"""))
def master_checks(spark, sf_dir):
    """Domains of the merged roster by exchange (V5)."""
    status, kinds = F.col("vendor_roster_status"), ("active_only", "delisted_only", "both")
    group, ident = F.col("exchange_group"), F.col("security_id")
    return _merged(spark, sf_dir).groupBy("exchange_group").agg(
        F.count("*").alias("securities"),
        F.count_if(~ident.rlike(r"^[^.]+\.[A-Z]+$")).alias("bad_id"),
        F.count_if(group.isNull() | ~group.isin(GROUPS)).alias("bad_venue"),
        F.count_if(status.isNull() | ~status.isin(*kinds)).alias("bad_status"),
        F.count_if(text.security_type(F.col("company_name"), text.stem(ident)) != "common_share").alias("bad_type"),
        F.count_if(text.clean(F.col("company_name")) == "").alias("no_issuer"),
    )


def _column_sql() -> str:
    each = (f"select '{t}' as table_name, (select count(*) from (values {', '.join(f"('{c}')" for c in cs)}) v(c) where c not in (select column_name from (describe {t}))) as n_missing, (select count(*) from {t}) = 0 as is_empty" for t, cs in NEEDED.items())
    return " union all ".join(each)


@query(_column_sql())
def table_contracts(spark, sf_dir):
    """Columns that tables lack, and whether they are empty (V1, V4)."""
    out = None
    for name, needed in NEEDED.items():
        row = roster.contract(market.table(spark, sf_dir, name), needed).withColumn("table_name", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@query(f"""{_DAILY},{_ROSTER},
sp as (select number, max(date) as last_date from px group by 1), hi as (select max(date) as latest from px)
select 'unknown_security' as check_name, (select count(*) from ended where number not in (select number from sec)) as n_bad
union all select 'still_trading', (select count(*) from ended join sp using (number), hi where last_date > latest - {EARLY_DAYS})
union all select 'early_end_without_coverage', (select count(*) from sp, hi where last_date < latest - {EARLY_DAYS} and number not in (select number from ended))""")
def delisting_checks(spark, sf_dir):
    """Unknown delistings, delisted names that still trade and histories that end early without one."""
    ended = rosters.delistings(spark, sf_dir)
    ends = market.daily_prices(spark, sf_dir).groupBy("number").agg(F.max("date").alias("last_date"))
    early = F.col("last_date") < F.date_sub("latest", EARLY_DAYS)
    latest = ends.crossJoin(F.broadcast(ends.agg(F.max("last_date").alias("latest"))))
    rows = {
        "unknown_security": ended.join(market.securities(spark, sf_dir).select("number"), "number", "left_anti"),
        "still_trading": latest.where(F.col("last_date") > F.date_sub("latest", EARLY_DAYS)).join(ended, "number"),
        "early_end_without_coverage": latest.where(early).join(ended, "number", "left_anti"),
    }
    out = None
    for name, bad in rows.items():
        row = bad.agg(F.count("*").alias("n_bad")).select(F.lit(name).alias("check_name"), "n_bad")
        out = row if out is None else out.unionByName(row)
    return out


@query(f"""{_DAILY}
select benchmark_id, count(*) as rows, count(*) filter (not adj_close > 0) as not_positive, count(*) - count(distinct date) as repeated,
    min(adj_close) = max(adj_close) as is_constant, benchmark_id not in ('primary', 'secondary', 'tertiary') as is_unknown from bench group by 1""")
def benchmark_checks(spark, sf_dir):
    """Each benchmark's rows, bad levels, repeated days and whether it ever moves."""
    return market.benchmark_prices(spark, sf_dir).groupBy("benchmark_id").agg(
        F.count("*").alias("rows"),
        F.count_if(~(F.col("adj_close") > 0)).alias("not_positive"),
        (F.count("*") - F.count_distinct("date")).alias("repeated"),
        (F.min("adj_close") == F.max("adj_close")).alias("is_constant"),
        (~F.col("benchmark_id").isin("primary", "secondary", "tertiary")).alias("is_unknown"),
    )


@query(f"""{_UNIVERSE},
st as (select month, number, exchange_group, country_code, anchor_date, next_execution_date from u0),
lt as (select a.number, month from (select * from span) a join cal using (exchange_group) where listing_date <= (select max(anchor_date) from cal) and last_date >= (select min(anchor_date) from cal))
select (select count(*) from uni) as n_universe, (select count(*) from st) as n_status, count(*) as n_joined, count(*) = (select count(*) from uni) as complete, (select count(*) from lt) as n_overlapping
from uni join st using (month, number, exchange_group, country_code, anchor_date, next_execution_date)""")
def universe_status_join(spark, sf_dir):
    """The universe joined with listing status on all six keys, with the row counts, and rows whose listing overlaps the anchors (J7, PF12)."""
    keys = ["month", "number", "exchange_group", "country_code", "anchor_date", "next_execution_date"]
    prices, own = market.daily_prices(spark, sf_dir), monthly(spark, sf_dir).select(*keys)
    cal = universe.calendar(prices)
    span = prices.groupBy("number", "exchange_group", "country_code").agg(F.min("date").alias("listing_date"), F.max("date").alias("last_date"))
    status = span.join(F.broadcast(cal), "exchange_group")
    ends = cal.agg(F.min("anchor_date").alias("lo"), F.max("anchor_date").alias("hi"))
    overlap = status.crossJoin(F.broadcast(ends)).where("listing_date <= hi and last_date >= lo")
    counts = [own.agg(F.count("*").alias("n_universe")), status.agg(F.count("*").alias("n_status")), own.join(status.select(*keys), keys).agg(F.count("*").alias("n_joined")), overlap.agg(F.count("*").alias("n_overlapping"))]
    out = counts[0]
    for c in counts[1:]:
        out = out.crossJoin(c)
    return out.withColumn("complete", F.col("n_joined") == F.col("n_universe"))


@query("""
with w as (select distinct unnest(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0b\\x0c\\r.,;:!?]+')) as word from documents),
f as (select word, regexp_replace(strip_accents(word), '[^\\x00-\\x7F]', '', 'g') as folded from w where regexp_matches(word, '[^\\x00-\\x7F]'))
select folded, count(*) as spellings, min(word) as first_spelling from f group by 1""")
def folded_words(spark, sf_dir):
    """Words with letters beyond ASCII by what they fold to, how many spellings fold so, and the first (PF6, PF7)."""
    words = market.table(spark, sf_dir, "documents").select(F.explode(F.expr(r"regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0b\\x0c\\r.,;:!?]+', 0)")).alias("word")).distinct()
    marked = words.where(F.col("word").rlike(r"[^\x00-\x7F]"))
    return marked.groupBy(text.folded(F.col("word")).alias("folded")).agg(F.count("*").alias("spellings"), F.min("word").alias("first_spelling"))


@query(_with(f"""{_ROSTER},
u as (select 'official' as source, 1 as k, official_id::varchar as id, exchange_group, isin from official union all select 'active', 2, security_id, exchange_group, isin from active
    union all select 'delisted', 3, security_id, exchange_group, isin from gone),
f as (select *, row_number() over (partition by exchange_group, isin order by k, id) as place, count(*) over (partition by exchange_group, isin) as rows from u where isin is not null)
select exchange_group, isin, source, id, rows from f where place = 1"""))
def listed_instruments(spark, sf_dir):
    """Official list, active and delisted rosters as one, the first that names an instrument on an exchange."""
    lists = [rosters.official_list(spark, sf_dir).select(F.lit("official").alias("source"), F.lit(1).alias("k"), F.col("official_id").cast("string").alias("id"), "exchange_group", "isin")]
    for source, k, rows in (("active", 2, rosters.active_roster(spark, sf_dir)), ("delisted", 3, rosters.delisted_roster(spark, sf_dir))):
        lists.append(rows.select(F.lit(source).alias("source"), F.lit(k).alias("k"), F.col("security_id").alias("id"), "exchange_group", "isin"))
    every = reduce(lambda a, b: a.unionByName(b), lists).where("isin is not null")
    first = F.min_by(F.struct("source", "id"), F.struct("k", "id"))
    return every.groupBy("exchange_group", "isin").agg(first.alias("f"), F.count("*").alias("rows")).select("exchange_group", "isin", "f.source", "f.id", "rows")
