"""Stand-ins for option data over the driver's tables, in Spark and as SQL common table expressions.

``quotes`` comes from lineitem and orders, ``underlying`` from orders, ``surface`` from both, ``predictions`` from
``surface`` by hashing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import key_uniforms
from ..operators import surface as S
from ..operators.benchmark import date_split_map, time_split
from ..operators.stage import staged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_KEPT: dict[tuple[str, str, str], DataFrame] = {}


def kept(hold):
    """Holds a view by ``hold``, once for each application and folder, as most queries start from it."""

    def of(view):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            key = (spark.sparkContext.applicationId, sf_dir, view.__name__)
            if key not in _KEPT:
                _KEPT[key] = hold(view(spark, sf_dir))
            return _KEPT[key]

        return run

    return of


def forget(spark: SparkSession) -> None:
    """Lets go of all held views, so that the next query starts from the files."""
    for key in [k for k in _KEPT if k[0] == spark.sparkContext.applicationId]:
        _KEPT.pop(key).unpersist(blocking=True)


def _month(c: str) -> Column:
    return F.to_date(F.date_trunc("month", F.col(c)))


@kept(DataFrame.persist)  # a row a month
def underlying(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(_month("o_orderdate").alias("date"), F.round(F.col("o_totalprice") * 100.0).cast("bigint").alias("cents"))
    close = F.floor(F.sum("cents").cast("double") / F.count("*").cast("double") / 1e3) / 1e2
    return o.groupBy("date").agg(close.alias("close"))


def raw_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes with the underlying's close already looked up for the strike; ``close`` is left out again."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_tax", "l_quantity", "l_discount", "l_linestatus", "l_returnflag")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), _month("o_orderdate").alias("date"))
    j = li.join(o, "l_orderkey").join(F.broadcast(underlying(spark, sf_dir)), "date")  # one row a month: small whatever the scale
    dte = F.element_at(F.array(*map(F.lit, (0, 7, 30, 91, 182, 365, 800))), F.col("l_linenumber").cast("int"))
    cents, tax, qty = F.round(F.col("l_extendedprice") * 100.0).cast("bigint"), F.round(F.col("l_tax") * 100.0).cast("int"), F.col("l_quantity").cast("int")
    j = j.select("*", cents.alias("cents"), tax.alias("tax"), qty.alias("qty"), dte.alias("dte"), (F.col("l_partkey") % 41).cast("double").alias("kslot"))
    c = F.col
    bid_c = F.floor(c("cents") / 1e3).cast("double")
    extra = F.when((c("l_returnflag") == "R") & (c("tax") > 5), F.lit(90)).otherwise(F.lit(0))
    ask = F.when((c("tax") == 3) & (c("l_returnflag") == "N"), F.floor(bid_c * 0.99) / 1e2).otherwise(F.floor(bid_c * (F.lit(100) + c("tax") + extra).cast("double") / 1e2 + 1.0) / 1e2)
    key = F.md5(F.concat_ws("|", *(c(x).cast("string") for x in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "cents", "qty"))))
    return j.select(
        key.alias("row_key"),
        "date",
        "dte",
        F.date_add("date", c("dte")).alias("expiration"),
        "kslot",
        F.floor(c("close") * (F.lit(0.5) + F.lit(0.025) * c("kslot"))).cast("double").alias("strike"),
        F.when(c("l_linestatus") == "F", "call").otherwise("put").alias("type"),
        F.when(c("qty") == 1, 0.0).when(c("qty") == 2, -0.01).otherwise(bid_c / 1e2).alias("bid"),
        ask.alias("ask"),
        F.when(c("qty") == 50, F.lit(None).cast("double")).when(c("qty") == 49, 6.0).otherwise(F.lit(0.12) + c("l_discount") + F.lit(0.4) * (c("kslot") - 20.0) * (c("kslot") - 20.0) / 1600.0).alias("implied_volatility"),
        F.greatest(c("qty") - 3, F.lit(0)).cast("bigint").alias("volume"),
        (c("l_suppkey") % 50).cast("bigint").alias("open_interest"),
    )


def _surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.strict_subset(S.hard_clean(S.derive(S.join_underlying(raw_quotes(spark, sf_dir), underlying(spark, sf_dir)))))


surface = kept(staged)(_surface)


@kept(staged)
def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with all columns that come from hashes: a query that filters by them would make them several times a row."""
    known = (spark.sparkContext.applicationId, sf_dir, _surface.__name__) in _KEPT
    s = (surface if known else _surface)(spark, sf_dir).withColumn("iv_clean", F.col("implied_volatility"))
    names = ("mask", "p", "s", *(f"m{k}" for k in range(5)))
    u = dict(zip(names, (F.col("_u")[k] for k in range(len(names))), strict=True))
    return s.withColumn("_u", key_uniforms("row_key", names)).withColumns(
        {
            "observed": u["mask"] < 0.4,
            "iv_pred": F.col("iv_clean") + F.lit(0.02) * (u["p"] - 0.5),
            "sigma": F.lit(0.002) + F.lit(0.01) * u["s"],
            **{f"member_{k}": F.col("iv_clean") + F.lit(0.02) * (u[f"m{k}"] - 0.5) for k in range(5)},
        }
    ).drop("_u")


@kept(DataFrame.persist)  # a row a date
def _splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return date_split_map(_hashed(spark, sf_dir).select("date"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return time_split(_hashed(spark, sf_dir), _splits(spark, sf_dir))


def with_bands(p: DataFrame) -> DataFrame:
    """Predictions with an uncertainty, a 90 % band and a confidence, as evaluation tables have them."""
    z = 1.6448536269514722
    return p.withColumns(
        {
            "uncertainty": F.col("sigma"),
            "lower": F.col("iv_pred") - F.lit(z) * F.col("sigma"),
            "upper": F.col("iv_pred") + F.lit(z) * F.col("sigma"),
            "confidence": F.lit(1.0) - F.lit(80.0) * F.col("sigma"),
            "abs_error": F.abs(F.col("iv_pred") - F.col("iv_clean")),
        }
    )


def _u(name: str) -> str:
    return f"(cast('0x' || substr(md5(concat(row_key, '|{name}')), 1, 8) as bigint) / 4294967296E0)"


UNDERLYING_SQL = """underlying as (
  select cast(date_trunc('month', o_orderdate) as date) as date,
    floor(cast(sum(cast(round(o_totalprice * 100E0) as bigint)) as double) / cast(count(*) as double) / 1E3) / 1E2 as close
  from orders group by 1
)"""
QUOTES_SQL = """quote_rows as (
  select l.*, cast(date_trunc('month', o_orderdate) as date) as date, cast(round(l_extendedprice * 100E0) as bigint) as cents,
    cast(round(l_tax * 100E0) as int) as tax, cast(l_quantity as int) as qty, cast(l_partkey % 41 as double) as kslot,
    (array[0, 7, 30, 91, 182, 365, 800])[cast(l_linenumber as int)] as dte
  from lineitem l join orders on l_orderkey = o_orderkey
), quote_bids as (
  select q.*, u.close, cast(floor(cents / 1E3) as double) as bid_c from quote_rows q join underlying u using (date)
), quotes as (
  select md5(concat_ws('|', cast(l_orderkey as varchar), cast(l_partkey as varchar), cast(l_suppkey as varchar), cast(l_linenumber as varchar), cast(cents as varchar), cast(qty as varchar))) as row_key,
    date, dte, cast(date + cast(dte as int) as date) as expiration, kslot, floor(close * (5E-1 + 25E-3 * kslot)) as strike,
    case when l_linestatus = 'F' then 'call' else 'put' end as type,
    case when qty = 1 then 0E0 when qty = 2 then -1E-2 else bid_c / 1E2 end as bid,
    case when tax = 3 and l_returnflag = 'N' then floor(bid_c * 99E-2) / 1E2
      else floor(bid_c * cast(100 + tax + case when l_returnflag = 'R' and tax > 5 then 90 else 0 end as double) / 1E2 + 1E0) / 1E2 end as ask,
    case when qty = 50 then null when qty = 49 then 6E0 else 12E-2 + l_discount + 4E-1 * (kslot - 2E1) * (kslot - 2E1) / 16E2 end as implied_volatility,
    cast(greatest(qty - 3, 0) as bigint) as volume, cast(l_suppkey % 50 as bigint) as open_interest
  from quote_bids
)"""
SURFACE_SQL = """derived as (
  select q.*, close, (bid + ask) / 2E0 as mid, cast(expiration - q.date as int) as days_to_expiry, cast(expiration - q.date as double) / 365E0 as tau,
    close as spot, ln(strike / close) as log_moneyness
  from quotes q join underlying u on q.date = u.date
), surface as (
  select * from derived
  where bid > 0 and ask >= bid and mid > 0 and implied_volatility between 1E-2 and 3E0 and tau between 1E0 / 365E0 and 2E0 and log_moneyness between -1E0 and 1E0
)"""
SPLIT_SQL = """split_map as (
  select date, case when rn <= floor(n * 7E-1) then 'train' when rn <= floor(n * 7E-1) + floor(n * 15E-2) then 'val' else 'test' end as split
  from (select date, row_number() over (order by date) as rn, count(*) over () as n from (select distinct date from surface))
)"""
PREDICTIONS_SQL = f"""predictions as (
  select s.*, implied_volatility as iv_clean, {_u("mask")} < 4E-1 as observed, implied_volatility + 2E-2 * ({_u("p")} - 5E-1) as iv_pred,
    2E-3 + 1E-2 * {_u("s")} as sigma, {", ".join(f"implied_volatility + 2E-2 * ({_u(f'm{k}')} - 5E-1) as member_{k}" for k in range(5))},
    coalesce(m.split, 'test') as split
  from surface s left join split_map m on s.date = m.date
), banded as (
  select *, sigma as uncertainty, iv_pred - 1.6448536269514722E0 * sigma as lower, iv_pred + 1.6448536269514722E0 * sigma as upper,
    1E0 - 8E1 * sigma as confidence, abs(iv_pred - iv_clean) as abs_error
  from predictions
)"""
BASE = "with " + ",\n".join((UNDERLYING_SQL, QUOTES_SQL, SURFACE_SQL, SPLIT_SQL, PREDICTIONS_SQL))
