"""Queries over sources, cleaning, the single-valued surface and exploration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.buckets import MATURITY, MONEYNESS, WINGS, bucket, maturity, moneyness, sql_bucket
from ..operators import audit, explore, surface as S
from ..operators.stage import scratch
from ..sources import files, payload
from . import adapters as A
from .registry import query

MAT, MON = sql_bucket("tau", MATURITY), sql_bucket("log_moneyness", MONEYNESS)
CLEAN = "date is not null and expiration is not null and strike is not null and type is not null and implied_volatility is not null and close is not null and bid >= 0 and ask >= 0 and ask >= bid and implied_volatility > 0 and implied_volatility <= 5 and tau > 0 and tau <= 3"


def derived(s: SparkSession, d: str) -> DataFrame:
    return S.derive(S.join_underlying(A.raw_quotes(s, d), A.underlying(s, d)))


def clean(s: SparkSession, d: str) -> DataFrame:
    return S.hard_clean(derived(s, d))


def events(s: SparkSession, d: str) -> DataFrame:
    """Payloads of up to two contracts made from the events' JSON."""
    e = A.table(s, d, "events")
    k = F.get_json_object("props", "$.k")
    body = F.concat(F.lit('{"data":[{"contractID":"C'), F.col("event_id").cast("string"), F.lit('","type":"CALL","strike":"'), k, F.lit('","bid":"'), k, F.lit('.5","volume":"'), k, F.lit('.9","open_interest":"n/a","expiration":"2024-03-'), F.lpad((F.col("event_id") % 31 + 1).cast("string"), 2, "0"), F.lit('"}]}'))
    note = F.lit('{"Information":"This is a PREMIUM endpoint"}')
    return e.select("event_id", F.when(F.col("event_id") % 10 == 0, note).otherwise(body).alias("body"))


# ---- sources

EVENT_SQL = """e as (select event_id, json_extract_string(props, '$.k') as k from events where event_id % 10 <> 0)"""


@query(
    "chain_from_json",
    f"""with {EVENT_SQL} select 'C' || cast(event_id as varchar) as contract_id, try_cast('2024-03-' || lpad(cast(event_id % 31 + 1 as varchar), 2, '0') as date) as expiration, 'call' as type,
    try_cast(k as double) as strike, try_cast(k || '.5' as double) as bid, cast(trunc(cast(k || '.9' as double)) as bigint) as volume, cast(0 as bigint) as open_interest from e where k is not null""",
    base=False,
)
def _(s, d):
    return payload.chain_from_json(events(s, d)).where("contract_id is not null").select("contract_id", "expiration", "type", "strike", "bid", "volume", "open_interest")


@query("chain_scalar_coerce", "select event_id, try_cast(event_type as double) as as_double, coalesce(cast(trunc(try_cast(json_extract_string(props, '$.k') as double)) as bigint), 0) as as_long from events", base=False)
def _(s, d):
    return A.table(s, d, "events").select("event_id", payload.to_double(F.col("event_type")).alias("as_double"), payload.to_long(F.get_json_object("props", "$.k")).alias("as_long"))


EMPTY_KINDS = ("empty list", "null list", "no list", "null body", "empty body", "broken")


@query(
    "chain_empty_payload",
    f"""select kind, count(*) as n_payloads, count(*) filter (kind = 'full') as n_rows, {len(payload.CHAIN.split(", "))} as n_columns from (
    select case when event_id % 10 = 0 or json_extract_string(props, '$.k') is null then 'refused or null' when event_id % 7 < 6 then (array[{", ".join(f"'{k}'" for k in EMPTY_KINDS)}])[cast(event_id % 7 + 1 as int)] else 'full' end as kind from events) group by 1""",
    base=False,
)
def _(s, d):
    full = events(s, d)
    odd = (F.lit('{"data":[]}'), F.lit('{"data":null}'), F.lit('{"endpoint":"chain"}'), F.lit(None).cast("string"), F.lit(""), F.lit('{"data":[{"contractID":"C'))
    other = F.col("body").isNull() | (F.col("event_id") % 10 == 0)
    at = (F.col("event_id") % 7 + 1).cast("int")
    kind = F.when(other, "refused or null").when(at < 7, F.element_at(F.array(*map(F.lit, EMPTY_KINDS)), at)).otherwise("full")
    mixed = full.select("event_id", kind.alias("kind"), F.when(other | (at == 7), F.col("body")).otherwise(F.element_at(F.array(*odd, F.lit("")), at)).alias("body"))
    rows = payload.chain_from_json(mixed)
    given = rows.where("contract_id is not null").groupBy(F.substring("contract_id", 2, 20).cast("bigint").alias("event_id")).agg(F.count("*").alias("rows"))
    out = mixed.join(given, "event_id", "left").groupBy("kind").agg(F.count("*").alias("n_payloads"), F.coalesce(F.sum("rows"), F.lit(0)).alias("n_rows"))
    return out.withColumn("n_columns", F.lit(len(rows.columns)))


@query("chain_error_payload", "select event_id % 10 = 0 as refused, count(*) as n from events group by 1", base=False)
def _(s, d):
    return events(s, d).groupBy(payload.error_payload(F.col("body")).alias("refused")).agg(F.count("*").alias("n"))


@query("underlying_normalise", "select date, close as close, 'SPX' as symbol from underlying", "close")
def _(s, d):
    return payload.underlying_normalise(A.underlying(s, d).select(F.col("date").cast("timestamp").alias("Date"), F.col("close").alias("Close")), "SPX").select("date", "close", "symbol")


@query("underlying_load", "select date, close from (select cast(o_orderdate as date) as date, o_totalprice as close, row_number() over (partition by cast(o_orderdate as date) order by o_orderkey, o_totalprice) as rn from orders) where rn = 1", base=False)
def _(s, d):
    o = A.table(s, d, "orders").select(F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("close"), "o_orderkey")
    return payload.underlying_load(o, "o_orderkey", "close")


@query("scan_years", "select distinct year(o_orderdate) as year from orders", base=False)
def _(s, d):
    return files.scan_years(A.table(s, d, "orders").withColumn("date", F.to_date("o_orderdate")))


@query("scan_year_pruned", "select cast(o_orderdate as date) as date, o_totalprice from orders where cast(o_orderdate as date) between date '1997-01-01' and date '1997-12-31'", base=False)
def _(s, d):
    return files.scan_year(A.table(s, d, "orders").withColumn("date", F.to_date("o_orderdate")), 1997, ["date", "o_totalprice", "not_there"])


@query("scan_benchmark_splits", "select split, count(*) as n, sum(cast(observed as int)) as n_observed from predictions group by 1")
def _(s, d):
    parts = files.scan_splits(A.predictions(s, d), ["row_key", "observed"])
    out = [p.groupBy("split").agg(F.count("*").alias("n"), F.sum(F.col("observed").cast("int")).alias("n_observed")) for p in parts.values()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def _scratch(s: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    return scratch(s, name)


@query("scan_predictions_csv", "select row_key, iv_pred from predictions", "iv_pred")
def _(s, d):
    path = _scratch(s, "predictions")
    files.write_csv(A.predictions(s, d).select("row_key", "date", "iv_pred", "iv_clean"), path, append=False)
    return files.read_csv(s, path, "row_key string, date date, iv_pred double, iv_clean double", ["row_key", "iv_pred"])


@query("sink_year_partitions", "select cast(year(date) as int) as year, count(*) as n from surface group by 1")
def _(s, d):
    path = _scratch(s, "years")
    files.write_years(A.surface(s, d), path)
    return s.read.parquet(path).groupBy("year").agg(F.count("*").alias("n"))


@query("sink_consolidate", "select count(*) as n from surface")
def _(s, d):
    path = _scratch(s, "years")
    files.write_years(A.surface(s, d), path)
    files.consolidate(s, path, f"{path}-all")
    return s.read.parquet(f"{path}-all").agg(F.count("*").alias("n"))


@query("sink_benchmark_meta", "select 'random' as strategy, count(*) as n from surface")
def _(s, d):
    path = _scratch(s, "meta")
    files.write_with_meta(A.surface(s, d), path, {"strategy": "random"})
    return s.read.parquet(path).agg(F.lit(files.read_meta(s, path)["strategy"]).alias("strategy"), F.count("*").alias("n"))


RESIDUAL = """residual as (
  select *, row_number() over (partition by date, lm_key, tau_key order by spread nulls last, open_interest desc nulls last, volume desc nulls last, row_key) as q_rank,
    row_number() over (partition by date, lm_key, tau_key order by type, row_key) as t_rank, count(*) over k as n_key,
    greatest(max(abs(bid - b0)) over k, max(abs(ask - a0)) over k, max(abs(mid - m0)) over k, max(abs(implied_volatility - i0)) over k, max(abs(volume - v0)) over k, max(abs(open_interest - o0)) over k) <= 1E-8 as equivalent
  from (select *, first_value(bid) over f as b0, first_value(ask) over f as a0, first_value(mid) over f as m0, first_value(implied_volatility) over f as i0, first_value(volume) over f as v0, first_value(open_interest) over f as o0
    from (select *, round(log_moneyness, 10) + 0E0 as lm_key, round(tau, 10) + 0E0 as tau_key from otm) window f as (partition by date, lm_key, tau_key order by row_key))
  window k as (partition by date, lm_key, tau_key)
), built as (select * from residual where case when equivalent then t_rank else q_rank end = 1)"""
OTM = f"""{A.BASE}, spread_rows as (select *, (ask - bid) / greatest(mid, 1E-8) as spread from surface),
atm as (select * from (select *, row_number() over (partition by date, expiration, strike order by spread nulls last, (type = 'put') desc, row_key) as r from spread_rows where abs(log_moneyness) <= 25E-4) where r = 1),
side as (select * from spread_rows where (log_moneyness < -25E-4 and type = 'put') or (log_moneyness > 25E-4 and type = 'call')),
otm as (select * exclude (r) from atm union all select * from side), {RESIDUAL}"""


def _otm(body: str) -> str:
    return f"{OTM}\n{body}"


@query("sink_residual_csv", _otm("select row_key from residual where n_key > 1"), base=False)
def _(s, d):
    path = _scratch(s, "residual")
    files.write_csv(S.residual_groups(S.otm_select(A.surface(s, d))).select("row_key", "date"), path)
    return files.read_csv(s, path, "row_key string, date date", ["row_key"])


@query("table_fingerprint", "select count(*) as n_rows, cast(sum(cast('0x' || substr(md5(concat_ws('|', row_key, type, cast(volume as varchar))), 1, 8) as bigint)) as bigint) as digest from quotes")
def _(s, d):
    return explore.fingerprint(A.raw_quotes(s, d), ["row_key", "type", "volume"])


@query("ingest_summary", "select count(*) as n_rows, count(distinct date) as dates_returned, min(date) as min_date, max(date) as max_date, (select count(distinct cast(o_orderdate as date)) from orders) as dates_requested from quotes")
def _(s, d):
    asked = A.table(s, d, "orders").select(F.to_date("o_orderdate").alias("date"))
    return explore.ingest_summary(asked, A.raw_quotes(s, d))


@query(
    "trading_dates_missing",
    "with d as (select distinct cast(o_orderdate as date) as date from orders), r as (select cast(unnest(generate_series((select min(date) from d), (select max(date) from d), interval 1 day)) as date) as date) select date from r where isodow(date) <= 5 and date not in (select date from d)",
    base=False,
)
def _(s, d):
    return explore.missing_business_days(A.table(s, d, "orders").select(F.to_date("o_orderdate").alias("date")))


PROFILED = ["row_key", "date", "strike", "type", "bid", "ask", "implied_volatility", "volume"]


@query("profile_columns", " union all ".join(f"select '{c}' as name, count({c}) as non_null, 1E2 * (count(*) - count({c})) / count(*) as null_pct from quotes" for c in PROFILED), "null_pct")
def _(s, d):
    return explore.profile_columns(A.raw_quotes(s, d).select(*PROFILED)).drop("dtype")


@query("profile_ranges", "select 'date' as name, cast(min(date) as varchar) as min_value, cast(max(date) as varchar) as max_value from quotes union all select 'expiration', cast(min(expiration) as varchar), cast(max(expiration) as varchar) from quotes union all select 'volume', cast(min(volume) as varchar), cast(max(volume) as varchar) from quotes")
def _(s, d):
    return explore.profile_ranges(A.raw_quotes(s, d), ["date", "expiration", "volume"])


@query("profile_option_types", "select string_agg(type, ',' order by type) as types from (select distinct type from quotes)")
def _(s, d):
    return explore.option_types(A.raw_quotes(s, d))


CHECKS = {"bid < 0": "bid < 0", "ask < 0": "ask < 0", "ask < bid": "ask < bid", "IV <= 0": "implied_volatility <= 0", "IV > 5.0": "implied_volatility > 5", **{f"{c} is null": f"{c} is null" for c in ("date", "expiration", "strike", "type")}}


@query("profile_suspicious", " union all ".join(f"select '{n}' as \"check\", count(*) filter ({c}) as n_rows, 1E2 * count(*) filter ({c}) / count(*) as pct from quotes" for n, c in CHECKS.items()), "pct")
def _(s, d):
    return explore.suspicious(A.raw_quotes(s, d))


@query("parquet_summary")
def _(s, d):
    return files.parquet_summary(A.surface(s, d))


@query(
    "build_report",
    f"select cast(year(date) as int) as year, count(*) as rows_in, count(*) filter ({CLEAN}) as rows_kept, count(*) - count(*) filter ({CLEAN}) as rows_dropped, count(*) filter ({CLEAN} and row_key in (select row_key from surface)) as rows_strict, 1E2 * count(*) filter ({CLEAN} and row_key in (select row_key from surface)) / greatest(count(*) filter ({CLEAN}), 1) as retention_pct from derived group by 1",
    "retention_pct",
)
def _(s, d):
    return explore.build_report(derived(s, d))


# ---- columns, filters, joins


@query("derive_surface", "select row_key, mid, days_to_expiry, tau, spot, log_moneyness from derived", "mid tau spot log_moneyness")
def _(s, d):
    return derived(s, d).select("row_key", "mid", "days_to_expiry", "tau", "spot", "log_moneyness")


@query("hard_clean", f"select row_key, bid, ask from derived where {CLEAN}", "bid ask")
def _(s, d):
    return clean(s, d).select("row_key", "bid", "ask")


@query("hard_clean_counts", f"select count(*) as rows_before, count(*) filter ({CLEAN}) as rows_after, count(*) - count(*) filter ({CLEAN}) as rows_dropped from derived")
def _(s, d):
    return S.hard_clean_counts(derived(s, d))


FLAGS = "bid = 0 as flag_zero_bid, volume = 0 as flag_zero_volume, open_interest = 0 as flag_zero_oi, (ask - bid) / greatest(mid, 1E-8) > 5E-1 as flag_wide_spread"


@query("quality_flags", f"select row_key, {FLAGS} from derived where {CLEAN}")
def _(s, d):
    return S.quality_flags(clean(s, d)).select("row_key", "flag_zero_bid", "flag_zero_volume", "flag_zero_oi", "flag_wide_spread")


@query("strict_subset", "select row_key, log_moneyness from surface", "log_moneyness")
def _(s, d):
    return A.surface(s, d).select("row_key", "log_moneyness")


@query("relative_spread", "select row_key, (ask - bid) / greatest(mid, 1E-8) as spread from derived", "spread")
def _(s, d):
    return derived(s, d).select("row_key", S.relative_spread().alias("spread"))


@query("micro_features", "select row_key, (ask - bid) / greatest(mid, 1E-4) as relative_spread, case when type = 'call' then 1E0 else -1E0 end as put_call_indicator from surface", "relative_spread")
def _(s, d):
    return S.micro_features(A.surface(s, d)).select("row_key", "relative_spread", "put_call_indicator")


@query("context_feature_select", "select row_key, log_moneyness as f0, tau as f1, implied_volatility as f2, bid as f3, ask as f4, (ask - bid) / greatest(mid, 1E-4) as f5, cast(volume as double) as f6, cast(open_interest as double) as f7, case when type = 'call' then 1E0 else -1E0 end as f8 from surface", " ".join(f"f{i}" for i in range(9)))
def _(s, d):
    return S.context_features(A.surface(s, d), "micro_v1").select("row_key", *(F.col("features")[i].alias(f"f{i}") for i in range(9)))


@query("context_query_sets", "select date, count(*) filter (observed) as n_context, count(*) as n_query, sum(iv_clean) as target_sum from predictions group by 1", "target_sum")
def _(s, d):
    sets = S.context_query_sets(A.predictions(s, d))
    return sets.select("date", F.col("n_context").cast("bigint").alias("n_context"), F.col("n_query").cast("bigint").alias("n_query"), F.aggregate("query", F.lit(0.0), lambda a, p: a + p["target"]).alias("target_sum"))


_F4 = [16.0 ** (i / 3) for i in range(4)]


@query(
    "fourier_encode",
    "select row_key, log_moneyness as e0, tau as e1, " + ", ".join(f"{fn}(2E0 * pi() * {f!r}E0 * {c}) as e{2 + 8 * j + 4 * k + i}" for j, c in enumerate(("log_moneyness", "tau")) for k, fn in enumerate(("sin", "cos")) for i, f in enumerate(_F4)) + " from surface",
    " ".join(f"e{i}" for i in range(18)),
)
def _(s, d):
    return S.fourier_encode(A.surface(s, d)).select("row_key", *(F.col("encoded")[i].alias(f"e{i}") for i in range(18)))


@query("encode_coords", "select row_key, log_moneyness as x, tau as y from surface", "x y")
def _(s, d):
    return S.encode_coords(A.surface(s, d), "raw").select("row_key", F.col("encoded")[0].alias("x"), F.col("encoded")[1].alias("y"))


@query("tau_bucket", f"select {MAT} as maturity, count(*) as n from surface group by 1")
def _(s, d):
    return A.surface(s, d).groupBy(maturity().alias("maturity")).agg(F.count("*").alias("n"))


@query("moneyness_bucket", f"select {MON} as moneyness, count(*) as n from surface group by 1")
def _(s, d):
    return A.surface(s, d).groupBy(moneyness().alias("moneyness")).agg(F.count("*").alias("n"))


WING = sql_bucket("log_moneyness", WINGS, "'unknown'")
CELL = f"{WING} || '/' || {sql_bucket('tau', MATURITY, chr(39) + 'unknown' + chr(39))}"


@query("audit_bucket", f"select {CELL} as cell, count(*) as n from surface group by 1")
def _(s, d):
    return A.surface(s, d).groupBy(audit.audit_bucket().alias("cell")).agg(F.count("*").alias("n"))


@query("round_key", "select date, round(log_moneyness, 8) + 0E0 as lm_key, round(tau, 8) + 0E0 as tau_key, count(*) as n from surface group by 1, 2, 3")
def _(s, d):
    lm, tau = S.rounded_key(8)
    return A.surface(s, d).groupBy("date", lm, tau).agg(F.count("*").alias("n"))


@query("join_underlying", "select q.row_key, q.strike, u.close from quotes q join underlying u on q.date = u.date", "close")
def _(s, d):
    return S.join_underlying(A.raw_quotes(s, d), A.underlying(s, d)).select("row_key", "strike", "close")


@query("join_unmatched", "select count(*) as n_rows, count(*) filter (u.date is null) as n_unmatched from quotes q left join (select * from underlying where year(date) > 1996) u on q.date = u.date")
def _(s, d):
    return S.unmatched(A.raw_quotes(s, d), A.underlying(s, d).where("year(date) > 1996"))


@query("cap_dates_semi", "select date, count(*) as n from surface where date in (select distinct date from surface order by date limit 5) group by 1")
def _(s, d):
    return explore.cap_dates(A.surface(s, d), 5).groupBy("date").agg(F.count("*").alias("n"))


@query("first_n_dates", "select distinct date from surface order by date limit 7")
def _(s, d):
    return explore.cap_dates(A.surface(s, d), 7).select("date").distinct()


@query("dup_membership", _otm("select row_key, n_key > 1 as duplicated from residual"), base=False)
def _(s, d):
    return S.residual_ranked(S.otm_select(A.surface(s, d))).select("row_key", (F.col("n_key") > 1).alias("duplicated"))


@query("ordered_output", "select date, count(*) as n from surface group by 1 order by 1")
def _(s, d):
    return A.surface(s, d).groupBy("date").agg(F.count("*").alias("n")).orderBy("date")


@query("distinct_dates", "select distinct date from (select date from quotes union all select cast(o_orderdate as date) from orders)")
def _(s, d):
    return explore.distinct_dates(A.raw_quotes(s, d), A.table(s, d, "orders").select(F.to_date("o_orderdate").alias("date")))


# ---- the single-valued surface


@query("otm_select", _otm("select row_key from otm"), base=False)
def _(s, d):
    return S.otm_select(A.surface(s, d)).select("row_key")


@query("otm_side", _otm("select row_key from side"), base=False)
def _(s, d):
    return S.otm_side(A.surface(s, d)).select("row_key")


@query("otm_atm_tiebreak", _otm("select row_key, type from atm"), base=False)
def _(s, d):
    return S.otm_atm(A.surface(s, d)).select("row_key", "type")


@query(
    "otm_fallback_count",
    _otm("select count(*) as atm_groups, count(*) filter (n > 1 and (least is null or ties > 1)) as atm_fallback_count from (select count(*) as n, max(lo) as least, count(*) filter (spread = lo) as ties from (select *, min(spread) over (partition by date, expiration, strike) as lo from spread_rows where abs(log_moneyness) <= 25E-4) group by date, expiration, strike)"),
    base=False,
)
def _(s, d):
    return S.otm_fallback_count(A.surface(s, d))


@query("otm_band_sensitivity", "select count(*) filter (abs(log_moneyness) <= 1E-12) as rows_in_band_0, count(*) filter (abs(log_moneyness) <= 1E-3) as rows_in_band_1, count(*) filter (abs(log_moneyness) <= 25E-4) as rows_in_band_2, count(*) filter (abs(log_moneyness) <= 5E-3) as rows_in_band_3 from surface")
def _(s, d):
    return S.band_sensitivity(A.surface(s, d))


@query("otm_residual_equiv", _otm("select row_key, equivalent from residual where n_key > 1"), base=False)
def _(s, d):
    return S.residual_groups(S.otm_select(A.surface(s, d))).select("row_key", "equivalent")


@query("otm_residual_quality", _otm("select row_key from residual where n_key > 1 and not equivalent and q_rank = 1"), base=False)
def _(s, d):
    return S.residual_groups(S.otm_select(A.surface(s, d))).where("not equivalent and rank = 1").select("row_key")


@query("otm_residual_groups", _otm("select date, lm_key, tau_key, count(*) as n from residual where n_key > 1 group by 1, 2, 3"), base=False, r="lm_key tau_key")
def _(s, d):
    return S.residual_groups(S.otm_select(A.surface(s, d))).groupBy("date", "lm_key", "tau_key").agg(F.count("*").alias("n"))


@query("otm_build", _otm("select row_key, date, type, implied_volatility from built"), base=False, r="implied_volatility")
def _(s, d):
    return S.otm_build(A.surface(s, d)).select("row_key", "date", "type", "implied_volatility")


@query("otm_flagship", _otm(f"select {MAT} as maturity, {MON} as moneyness, count(*) as n, avg(implied_volatility) as mean_iv from built group by 1, 2"), base=False, r="mean_iv")
def _(s, d):
    return S.otm_build(A.surface(s, d)).groupBy(maturity().alias("maturity"), moneyness().alias("moneyness")).agg(F.count("*").alias("n"), F.avg("implied_volatility").alias("mean_iv"))


@query("single_valued_assert", _otm("select max(n) as largest_group from (select count(*) as n from built group by date, lm_key, tau_key)"), base=False)
def _(s, d):
    return S.single_valued(S.otm_build(A.surface(s, d)))


@query(
    "build_manifest",
    _otm("""select (select count(*) from surface) as rows_in, (select count(*) from surface where abs(log_moneyness) > 25E-4) - (select count(*) from side) as dropped_wrong_type, (select count(*) from surface where abs(log_moneyness) <= 25E-4) as atm_rows_seen,
    (select count(distinct date) from surface) as dates_processed, (select count(*) from built) as rows_out, (select count(*) from built where n_key > 1) as residual_groups, (select count(*) from residual where n_key > 1) as residual_rows_in,
    (select count(*) from residual where n_key > 1 and equivalent and t_rank > 1) as dropped_equivalent, (select count(*) from residual where n_key > 1 and not equivalent and q_rank = 1) as quality_picked"""),
    base=False,
)
def _(s, d):
    return S.build_manifest(A.surface(s, d))


# ---- exploration


@query("rows_by_year", "select cast(year(date) as int) as year, count(*) as n from quotes group by 1")
def _(s, d):
    return A.raw_quotes(s, d).groupBy(F.year("date").alias("year")).agg(F.count("*").alias("n"))


@query("call_put_split", "select count(*) filter (type = 'call') as n_call, count(*) filter (type = 'put') as n_put, count(*) filter (type = 'call') / cast(count(*) filter (type = 'put') as double) as ratio from quotes", "ratio")
def _(s, d):
    return explore.call_put_split(A.raw_quotes(s, d))


@query("histogram", "select cast(least(floor((least(greatest(implied_volatility, 0E0), 1E0) - 0E0) / 1E0 * 20), 19) as int) as bin, count(*) as n from quotes where implied_volatility is not null group by 1")
def _(s, d):
    return explore.histogram(A.raw_quotes(s, d), "implied_volatility", 0.0, 1.0, 20, clip=True)


@query("describe_column", "select count(implied_volatility) as n, avg(implied_volatility) as mean, stddev_samp(implied_volatility) as std, min(implied_volatility) as min, quantile_cont(implied_volatility, 25E-2) as q25, quantile_cont(implied_volatility, 5E-1) as q50, quantile_cont(implied_volatility, 75E-2) as q75, max(implied_volatility) as max from quotes", "mean std min q25 q50 q75 max")
def _(s, d):
    return explore.describe(A.raw_quotes(s, d), "implied_volatility")


FLAG_NAMES = ("flag_zero_bid", "flag_zero_volume", "flag_zero_oi", "flag_wide_spread")


@query("flag_rates", " union all ".join(f"select '{f}' as name, count(*) filter ({f}) as n_rows, avg(cast({f} as int)) as share from (select {FLAGS} from derived where {CLEAN})" for f in FLAG_NAMES), "share")
def _(s, d):
    return explore.flag_rates(S.quality_flags(clean(s, d)), FLAG_NAMES)


@query("null_rates", "select 'implied_volatility' as name, 1E2 * avg(cast(implied_volatility is null as int)) as null_pct from quotes", "null_pct")
def _(s, d):
    return explore.null_rates(A.raw_quotes(s, d))


INSIDE = "row_key in (select row_key from surface)"


@query("strict_summary", f"""select avg(cast({INSIDE} as int)) as strict_share, min(date) filter ({INSIDE}) as min_date, max(date) filter ({INSIDE}) as max_date, count(distinct date) filter ({INSIDE}) as n_dates,
  min(implied_volatility) filter ({INSIDE}) as iv_min, max(implied_volatility) filter ({INSIDE}) as iv_max, min(tau) filter ({INSIDE}) as tau_min, max(tau) filter ({INSIDE}) as tau_max from derived where {CLEAN}""", "strict_share iv_min iv_max tau_min tau_max")  # fmt: skip
def _(s, d):
    return explore.strict_summary(clean(s, d))


@query("spaced_dates", "select date, count(*) as n from surface where date in (select date from (select date, row_number() over (order by date) - 1 as i, count(*) over () as n from (select distinct date from surface)) where i = floor(n / 4) or i = floor(n / 2) or i = floor(n * 3 / 4) or i = n - 1) group by 1")
def _(s, d):
    return explore.spaced_dates(A.surface(s, d)).groupBy("date").agg(F.count("*").alias("n"))


@query("busiest_date", "select row_key from surface where date = (select date from surface group by 1 order by count(*) desc, date limit 1)")
def _(s, d):
    return explore.busiest_date(A.surface(s, d)).select("row_key")


@query("sample_dates", "select date, count(*) as n from surface where date in (select date from (select distinct date from surface) order by cast('0x' || substr(md5(concat(cast(date as varchar), '|dates3')), 1, 8) as bigint), date limit 6) group by 1")
def _(s, d):
    return explore.sample_dates(A.surface(s, d), 6).groupBy("date").agg(F.count("*").alias("n"))


@query("diff_summary", "select avg(abs_error) as mean_diff, quantile_cont(abs_error, 5E-1) as median_diff, quantile_cont(abs_error, 9E-1) as p90_diff from banded", "mean_diff median_diff p90_diff")
def _(s, d):
    return explore.diff_summary(A.with_bands(A.predictions(s, d)))


@query("rich_cheap_scan", "(select row_key, iv_clean - iv_pred as diff, 'rich' as side from predictions where volume > 0 order by 2 desc, row_key limit 6) union all (select row_key, iv_clean - iv_pred, 'cheap' from predictions where volume > 0 order by 2, row_key limit 6)", "diff")
def _(s, d):
    return explore.rich_cheap(A.predictions(s, d), F.col("iv_clean") - F.col("iv_pred")).select("row_key", "diff", "side")
