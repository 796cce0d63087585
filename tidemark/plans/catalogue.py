"""Registered queries over the driver tables, and their SQL twins.

The tables stand in for a sales domain: an order of a customer is a sale, the customer's nation its postcode, the customer
its dwelling, the order's quantity its area, the market segment its council and the priority its zoning.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import cleaning, describe, econometrics, encoders, fences, geo, hypotheses, keys, metrics, models, panel, splits, temporal
from ..sources import tables
from . import experiments, pipelines

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}

_TYPES = {"i": "bigint", "f": "double", "s": "string", "d": "date", "b": "boolean"}
PLACES = 6


def query(columns: str, sql: str | None = None):
    """Registers a query. ``columns`` lists ``name:type`` of the result; both sides are cast alike and doubles rounded."""
    spec = [c.split(":") for c in columns.split()]

    def register(f: Callable) -> Callable:
        def run(spark, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[(F.round(F.col(n).cast("double"), PLACES) + F.lit(0.0) if t == "f" else F.col(n).cast(_TYPES[t])).alias(n) for n, t in spec])

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            kind = _TYPES | {"s": "varchar"}
            out = ", ".join(f'round(cast("{n}" as double), {PLACES}) + 0.0 as "{n}"' if t == "f" else f'cast("{n}" as {kind[t]}) as "{n}"' for n, t in spec)
            ORACLE_SQL[f.__name__] = f"select {out} from ({sql})"
        return f

    return register


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales(spark, sf_dir: str) -> DataFrame:
    area = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("area_sqm"))
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(area, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return orders.select(
        F.col("o_orderkey").alias("sale_id"), F.col("o_orderdate").cast("date").alias("contract_date"), F.col("o_totalprice").alias("purchase_price"), F.col("c_nationkey").alias("post_code"),
        F.col("o_custkey").alias("group_key"), "area_sqm", F.col("c_mktsegment").alias("council"), F.col("o_orderpriority").alias("zoning"), F.col("o_orderstatus").alias("purpose"),
    )


SALES = """sales as (
  select o_orderkey as sale_id, cast(o_orderdate as date) as contract_date, o_totalprice as purchase_price, c_nationkey as post_code,
    o_custkey as group_key, area_sqm, c_mktsegment as council, o_orderpriority as zoning, o_orderstatus as purpose
  from orders join customer on o_custkey = c_custkey
  left join (select l_orderkey, sum(l_quantity) as area_sqm from lineitem group by 1) on o_orderkey = l_orderkey)"""

PANEL = """panel as (
  select post_code, cast(date_trunc('month', contract_date) as date) as month, count(*) as n_sales, quantile_cont(purchase_price, 0.5) as median_price,
    avg(purchase_price) as mean_price, quantile_cont(purchase_price, 0.25) as p25_price, quantile_cont(purchase_price, 0.75) as p75_price,
    quantile_cont(purchase_price / nullif(area_sqm, 0), 0.5) as median_unit_price, quantile_cont(area_sqm, 0.5) as median_area
  from sales where post_code is not null and purchase_price is not null and contract_date is not null group by 1, 2)"""

SPINE = """spine as (
  select post_code, month, coalesce(n_sales, 0) as n_sales, n_sales is not null as observed, median_price, p25_price, p75_price, median_unit_price
  from (select distinct post_code from panel) cross join (select cast(unnest(generate_series(min(month), max(month), interval 1 month)) as date) as month from panel)
  left join panel using (post_code, month))"""


def _spine(spark, sf_dir: str) -> DataFrame:
    return panel.complete_spine(panel.build_panel(sales(spark, sf_dir)))


# panels


@query("post_code:i month:d n_sales:i median_price:f mean_price:f p25_price:f p75_price:f median_unit_price:f median_area:f", f"with {SALES}, {PANEL} select * from panel")
def panel_base(spark, sf_dir):
    return panel.build_panel(sales(spark, sf_dir))


@query("post_code:i month:d n_sales:i observed:b median_price:f", f"with {SALES}, {PANEL}, {SPINE} select * from spine")
def spine_gaps(spark, sf_dir):
    return _spine(spark, sf_dir)


_ROLL = [(w, f"pc_median_price_{w}m", f"pc_n_sales_{w}m", f"pc_unit_price_{w}m", f"pc_spread_{w}m", f"pc_n_months_observed_{w}m") for w in panel.WINDOWS]
_ROLL_SQL = ", ".join(
    f"""case when count(median_price) over w{w} = {w} then quantile_cont(median_price, 0.5) over w{w} end as {a},
    case when count(n_sales) over w{w} = {w} then sum(n_sales) over w{w} end as {b},
    case when count(median_unit_price) over w{w} = {w} then quantile_cont(median_unit_price, 0.5) over w{w} end as {c},
    case when count(p75_price) over w{w} = {w} then quantile_cont(p75_price, 0.5) over w{w} end / nullif(case when count(p25_price) over w{w} = {w} then quantile_cont(p25_price, 0.5) over w{w} end, 0) as {d},
    sum(cast(observed as int)) over w{w} as {e}"""
    for w, a, b, c, d, e in _ROLL
)
_WINDOWS_SQL = ", ".join(f"w{w} as (partition by post_code order by month rows between {w} preceding and 1 preceding)" for w in panel.WINDOWS)
_FEATURES = f"""features as (select *, {_ROLL_SQL},
    date_diff('day', max(case when observed then month end) over (partition by post_code order by month rows between unbounded preceding and 1 preceding), month) / 30.44 as pc_months_since_sale,
    row_number() over (partition by post_code order by month) - 1 as pc_months_observed
  from spine window {_WINDOWS_SQL})"""


@query("post_code:i month:d n_sales:i " + " ".join(f"{a}:f {b}:i {c}:f {d}:f {e}:i" for _, a, b, c, d, e in _ROLL), f"with {SALES}, {PANEL}, {SPINE}, {_FEATURES} select * from features")
def panel_rolling(spark, sf_dir):
    """Leakage-safe rolling features of every postcode and month."""
    return panel.rolling_features(_spine(spark, sf_dir))


@query("post_code:i month:d pc_months_since_sale:f pc_months_observed:i", f"with {SALES}, {PANEL}, {SPINE}, {_FEATURES} select * from features")
def months_since_obs(spark, sf_dir):
    return panel.rolling_features(_spine(spark, sf_dir), windows=(3,))


@query("post_code:i month:d fw_median_price_3m:f fw_median_price_6m:f", f"""with {SALES}, {PANEL}, {SPINE} select post_code, month,
  case when count(median_price) over a = 3 then quantile_cont(median_price, 0.5) over a end as fw_median_price_3m,
  case when count(median_price) over b = 6 then quantile_cont(median_price, 0.5) over b end as fw_median_price_6m
  from spine window a as (partition by post_code order by month rows between 1 following and 3 following), b as (partition by post_code order by month rows between 1 following and 6 following)""")
def forward_window_placebo(spark, sf_dir):
    return panel.forward_features(_spine(spark, sf_dir), windows=(3, 6))


@query("sale_id:i post_code:i pc_median_price_3m:f contemporaneous_n_sales:i", f"""with {SALES}, {PANEL}, {SPINE}, {_FEATURES}
  select sale_id, s.post_code, pc_median_price_3m, n_sales as contemporaneous_n_sales from sales s left join features f on s.post_code = f.post_code and date_trunc('month', contract_date) = f.month""")
def attach_panel_features(spark, sf_dir):
    return panel.attach_panel(sales(spark, sf_dir), panel.rolling_features(_spine(spark, sf_dir), windows=(3,)))


@query("post_code:i month:d month_index:i", f"""with {SALES}, {PANEL} select post_code, month,
  (year(month) - min(year(month)) over ()) * 12 + month(month) - min(month(month)) over () + 1 as month_index from panel""")
def month_index(spark, sf_dir):
    return panel.month_index(panel.build_panel(sales(spark, sf_dir)))


# joins along time

_ASOF = """select e.event_id, e.user_id, r.event_id as signup_id, r.value as signup_value
  from (select * from events where event_type = 'error') e asof left join
  (select user_id, {at} as at, max(event_id) as event_id, max_by(value, event_id) as value from events where event_type = 'signup' and user_id is not null group by 1, 2) r
  on e.user_id = r.user_id and e.ts >= r.at"""


def _asof(spark, sf_dir: str, lag_days: int) -> DataFrame:
    e = table(spark, sf_dir, "events")
    left = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'signup'").select("user_id", (F.col("ts") + F.expr(f"interval {lag_days} days")).alias("at"), F.col("event_id").alias("signup_id"), F.col("value").alias("signup_value"))
    return temporal.asof_bucketed(left, right, "ts", "at", ["user_id"], ["signup_id", "signup_value"], ["signup_id"])


@query("event_id:i user_id:i signup_id:i signup_value:f", _ASOF.format(at="ts"))
def asof_backward(spark, sf_dir):
    return _asof(spark, sf_dir, 0)


@query("event_id:i user_id:i signup_id:i signup_value:f", _ASOF.format(at="ts + interval 1 day"))
def asof_publication_lag(spark, sf_dir):
    return _asof(spark, sf_dir, 1)


_INDEX = """series as (select cast(date_trunc('quarter', contract_date) + interval 3 month - interval 1 day as date) as period_end, avg(purchase_price) as cpi_index from sales group by 1),
  released as (select *, cast(period_end + interval 28 day as date) as release_date, (cpi_index / lag(cpi_index, 4) over (order by period_end) - 1) * 100 as cpi_yoy from series)"""


def _index(spark, sf_dir: str) -> DataFrame:
    end = F.date_sub(F.add_months(F.trunc("contract_date", "quarter"), 3), 1)
    return sales(spark, sf_dir).groupBy(end.alias("period_end")).agg(F.avg("purchase_price").alias("cpi_index")).withColumn("release_date", F.date_add("period_end", tables.RELEASE_LAG))


@query("period_end:d release_date:d cpi_index:f cpi_yoy:f", f"with {SALES}, {_INDEX} select * from released")
def yoy_lag4(spark, sf_dir):
    return temporal.yoy(_index(spark, sf_dir), "cpi_index", "release_date", out="cpi_yoy")


_RATE = """cash as (select cast(date_trunc('month', contract_date) + interval 10 day as date) as effective_date, count(*) / 100.0 as cash_rate from sales where month(contract_date) % 2 = 1 group by 1)"""
_MACRO = f"""with {SALES}, {_INDEX}, {_RATE}, rated as (select s.*, cash_rate from sales s asof left join cash c on s.contract_date >= c.effective_date),
  known as (select r.*, cpi_index, cpi_yoy, period_end, release_date from rated r asof left join released i on r.contract_date >= i.release_date)"""


def _macro(spark, sf_dir: str) -> DataFrame:
    cash = sales(spark, sf_dir).where(F.month("contract_date") % 2 == 1).groupBy(F.date_add(F.trunc("contract_date", "MM"), 10).alias("effective_date")).agg((F.count("*") / 100.0).alias("cash_rate"))
    return temporal.attach_macro(sales(spark, sf_dir), cash, _index(spark, sf_dir))


@query("sale_id:i cash_rate:f cpi_index:f cpi_yoy:f period_end:d release_date:d", f"{_MACRO} select * from known")
def asof_macro(spark, sf_dir):
    return _macro(spark, sf_dir)


@query("name:s passed:b violations:i", f"""{_MACRO}, c as (select count_if(release_date > contract_date) as a, count_if(period_end > contract_date) as b, count_if(cash_rate is null) as c from known)
  select 'released_by_contract' as name, a = 0 as passed, a as violations from c union all select 'period_over_by_contract', b = 0, b from c union all select 'cash_rate_known', c = 0, c from c""")
def macro_contract(spark, sf_dir):
    return cleaning.contract(_macro(spark, sf_dir), temporal.macro_checks())


@query("year:i n:i mean_cash_rate:f median_cpi_yoy:f min_lag:i median_lag:f max_lag:i", f"""{_MACRO} select year(contract_date) as year, count(*) as n, avg(cash_rate) as mean_cash_rate, quantile_cont(cpi_yoy, 0.5) as median_cpi_yoy,
  min(contract_date - release_date) as min_lag, quantile_cont(contract_date - release_date, 0.5) as median_lag, max(contract_date - release_date) as max_lag from known group by 1""")
def macro_coverage(spark, sf_dir):
    return temporal.macro_coverage(_macro(spark, sf_dir))


@query("year:i mean_cpi_index:f days:i", f"""with {SALES}, {_INDEX}, spans as (select cpi_index, period_end as a, coalesce(lead(period_end) over (order by period_end), date '2002-01-01') as b from series),
  days as (select cpi_index, unnest(generate_series(a, b - interval 1 day, interval 1 day)) as day from spans where b > a) select year(day) as year, avg(cpi_index) as mean_cpi_index, count(*) as days from days group by 1""")
def annual_day_weighted(spark, sf_dir):
    return temporal.annual_day_weighted(_index(spark, sf_dir), "period_end", "cpi_index", "2001-12-31")


@query("sale_id:i label:s", f"""with {SALES} select sale_id, case when contract_date > date '1998-12-31' then case when post_code % 3 = 0 then 'Greenfield' when post_code % 3 = 1 then 'Established' end
  when contract_date > date '1996-12-31' then case when post_code % 2 = 0 then 'Greenfield' else 'Established' end end as label from sales""")
def legal_label(spark, sf_dir):
    new = F.when(F.col("post_code") % 3 == 0, "Greenfield").when(F.col("post_code") % 3 == 1, "Established")
    old = F.when(F.col("post_code") % 2 == 0, "Greenfield").otherwise("Established")
    return sales(spark, sf_dir).withColumn("label", temporal.legal_label(F.col("contract_date"), [("1996-12-31", old), ("1998-12-31", new)]))


@query("post_code:i n_base_v1:i base_vac_v1:f development_type_v1:s n_base_v2:i base_vac_v2:f development_type_v2:s", f"""with {SALES}, c as (select post_code,
  count_if(contract_date between date '1995-01-01' and date '1995-06-30') as n1, count_if(contract_date between date '1995-01-01' and date '1995-06-30' and purpose = 'F') as v1,
  count_if(contract_date between date '1997-01-01' and date '1998-12-31') as n2, count_if(contract_date between date '1997-01-01' and date '1998-12-31' and purpose = 'F') as v2 from sales group by 1)
  select post_code, n1 as n_base_v1, 100.0 * v1 / nullif(n1, 0) as base_vac_v1, case when n1 >= 50 then case when 100.0 * v1 / n1 >= 33 then 'Greenfield' else 'Established' end end as development_type_v1,
  n2 as n_base_v2, 100.0 * v2 / nullif(n2, 0) as base_vac_v2, case when n2 >= 50 then case when 100.0 * v2 / n2 >= 33 then 'Greenfield' else 'Established' end end as development_type_v2 from c""")
def vacancy_label(spark, sf_dir):
    rows = sales(spark, sf_dir).withColumn("purpose", F.when(F.col("purpose") == "F", "VACANT LAND").otherwise("RESIDENCE"))
    return geo.development_labels(rows, {"v1": ("1995-01-01", "1995-06-30"), "v2": ("1997-01-01", "1998-12-31")}, share=33.0)


# cleaning


@query("l_orderkey:i l_linenumber:i l_partkey:i l_suppkey:i l_quantity:f l_extendedprice:f l_shipdate:d", """select * from (select *, row_number() over (partition by l_orderkey, l_linenumber
  order by l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as k from lineitem) where k = 1""")
def dedup_identity(spark, sf_dir):
    return keys.keep_first(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"])


@query("rows_in:i rows_out:i rows_removed:i", "select sum(n) as rows_in, count(*) as rows_out, sum(n) - count(*) as rows_removed from (select count(*) as n from lineitem group by l_orderkey, l_linenumber)")
def dedup_report(spark, sf_dir):
    return keys.dedup_counts(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("c_custkey:i group_key:s group_key_source:s", r"""with a as (select c_custkey, c_nationkey, case c_custkey % 4 when 0 then null when 1 then c_name when 2 then 'unit 5/' || c_custkey || ' ' || c_name else ' ' || c_custkey || ' smith st' end as address,
    case when c_custkey % 8 = 1 then ' ' else cast(c_custkey as varchar) end as id from customer),
  b as (select *, coalesce(regexp_matches(address, '(?i)^\s*(?:(?:UNIT|U|SHOP|SUITE|LOT|FLAT|LEVEL|APT|APARTMENT)\s*)?\d'), false) as numbered from a)
  select c_custkey, case when not numbered and nullif(trim(id), '') is not null then trim(id) else coalesce(upper(nullif(trim(address), '')), '<missing>') || '|' || coalesce(cast(c_nationkey as varchar), '<missing>') end as group_key,
  case when not numbered and nullif(trim(id), '') is not null then 'property_id' else 'address' end as group_key_source from b""")
def group_key_fallback(spark, sf_dir):
    k, name = F.col("c_custkey"), F.col("c_name")
    address = F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, name).when(k % 4 == 2, F.concat(F.lit("unit 5/"), k.cast("string"), F.lit(" "), name)).otherwise(F.concat(F.lit(" "), k.cast("string"), F.lit(" smith st")))
    df = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("post_code"), address.alias("address"), F.when(k % 8 == 1, " ").otherwise(k.cast("string")).alias("property_id"))
    return keys.add_group_key(df)


def _stages() -> dict:
    return {"window": cleaning.date_window(F.col("contract_date"), "1996-01-01", "2000-12-31"), "required": F.col("area_sqm").isNotNull(), "purpose": F.col("purpose") != "P", "kind": F.col("council") == "BUILDING"}


@query("rows_in:i after_window:i after_required:i after_purpose:i after_kind:i", f"""with {SALES}, f as (select contract_date between date '1996-01-01' and date '2000-12-31' as a, area_sqm is not null as b, purpose <> 'P' as c, council = 'BUILDING' as d from sales)
  select count(*) as rows_in, count_if(a) as after_window, count_if(a and b) as after_required, count_if(a and b and c) as after_purpose, count_if(a and b and c and d) as after_kind from f""")
def staged_counts(spark, sf_dir):
    return cleaning.staged_filter(sales(spark, sf_dir), _stages())[1]


BOUNDS = cleaning.Bounds(first_day="1996-01-01", last_day="2000-12-31", area=(20.0, 200.0), price=(10_000.0, 450_000.0), unit_price=(100.0, 20_000.0), residential_area=(50.0, 150.0))
_GATE = f"""with {SALES}, g as (select *, coalesce(area_sqm < 20, false) as area_low, coalesce(area_sqm > 200, false) as area_high, coalesce(purchase_price < 10000, false) as price_low, coalesce(purchase_price > 450000, false) as price_high,
  coalesce(purchase_price / nullif(area_sqm, 0) < 100, false) as unit_low, coalesce(purchase_price / nullif(area_sqm, 0) > 20000, false) as unit_high from sales), bad as (select *, area_low or area_high or price_low or price_high or unit_low or unit_high as out from g)"""


@query("rows_in:i area_low:i area_high:i price_low:i price_high:i unit_low:i unit_high:i dropped:i rows_out:i", f"""{_GATE} select count(*) as rows_in, count_if(area_low) as area_low, count_if(area_high) as area_high, count_if(price_low) as price_low, count_if(price_high) as price_high,
  count_if(unit_low) as unit_low, count_if(unit_high) as unit_high, count_if(out) as dropped, count_if(not out) as rows_out from bad""")
def plausibility_gate(spark, sf_dir):
    return cleaning.plausibility_gate(sales(spark, sf_dir), b=BOUNDS)[1]


@query("sale_id:i", f"{_GATE} select sale_id from bad where not out")
def plausible_rows(spark, sf_dir):
    return cleaning.plausibility_gate(sales(spark, sf_dir), b=BOUNDS)[0]


@query("rows_in:i rows_out:i dropped:i", f"with {SALES} select count(*) as rows_in, count_if(coalesce(area_sqm between 50 and 150, false)) as rows_out, count_if(not coalesce(area_sqm between 50 and 150, false)) as dropped from sales")
def residential_scope(spark, sf_dir):
    return cleaning.residential(sales(spark, sf_dir), b=BOUNDS)[1]


@query("name:s passed:b violations:i", f"""{_GATE}, one as (select count_if(group_key is null or trim(cast(group_key as varchar)) = '') as v1, count_if(contract_date is null) as v2, count_if(coalesce(purchase_price <= 0, true)) as v3, count_if(area_sqm <= 0) as v4, count_if(out) as v5 from bad),
  twice as (select coalesce(sum(n - 1), 0) as v from (select count(*) as n from sales group by group_key, contract_date)), wide as (select count_if(n > 15) as v from (select count(distinct area_sqm) as n from sales group by group_key))
  select 'group_key_present' as name, v1 = 0 as passed, v1 as violations from one union all select 'date_parsed', v2 = 0, v2 from one union all select 'price_positive', v3 = 0, v3 from one
  union all select 'area_positive', v4 = 0, v4 from one union all select 'plausible', v5 = 0, v5 from one union all select 'identity_unique', v = 0, v from twice union all select 'areas_per_group', v = 0, v from wide""")
def contract_table(spark, sf_dir):
    df = sales(spark, sf_dir)
    return cleaning.contract(df, cleaning.clean_checks(df, BOUNDS)).unionByName(cleaning.identity_contract(df, ["group_key", "contract_date"])).unionByName(cleaning.areas_per_group_contract(df, most=15))


@query("rows:i postcodes:i groups:i rows_on_repeated_groups:i", f"""with {SALES} select count(*) as "rows", count(distinct post_code) as postcodes, count(distinct group_key) as groups,
  count_if(n > 1) as rows_on_repeated_groups from (select *, count(*) over (partition by group_key) as n from sales)""")
def coverage(spark, sf_dir):
    return cleaning.coverage(sales(spark, sf_dir))


@query("zoning:s n:i", "select case when n < 3000 then 'OTHER' else z end as zoning, sum(n) as n from (select upper(trim(o_orderpriority)) as z, count(*) as n from orders group by 1) group by 1")
def rare_category(spark, sf_dir):
    return keys.value_counts(keys.clean_category(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("zoning")), "zoning", 3000), "zoning")


@query("council:s n:i", "select c_mktsegment as council, count(*) as n from customer group by 1")
def value_counts(spark, sf_dir):
    return keys.value_counts(table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "council"), "council")


@query("column:s missing:i rows:i", f"""with {SALES} select 'area_sqm' as "column", count_if(area_sqm is null) as missing, count(*) as "rows" from sales union all select 'purchase_price', count_if(purchase_price is null), count(*) from sales
  union all select 'post_code', count_if(post_code is null), count(*) from sales""")
def missing_counts(spark, sf_dir):
    return keys.missing_counts(sales(spark, sf_dir), ["area_sqm", "purchase_price", "post_code"])


_RAW = "case o_orderkey % 6 when 0 then ' ' || (o_orderkey % 12000) || '.0' when 1 then cast(o_orderkey % 900 as varchar) when 2 then '' when 3 then 'x' || o_orderkey when 4 then null else cast(o_orderkey as varchar) || '.5' end"


@query("o_orderkey:i key:s", rf"""with r as (select o_orderkey, regexp_replace(trim({_RAW}), '\.0$', '') as t from orders), n as (select o_orderkey, case when regexp_matches(t, '^[0-9]+$') then cast(cast(t as bigint) as varchar) end as d from r)
  select o_orderkey, case when length(d) >= 4 then d else lpad(d, 4, '0') end as key from n""")
def postcode_keys(spark, sf_dir):
    k = F.col("o_orderkey")
    raw = F.when(k % 6 == 0, F.concat(F.lit(" "), (k % 12000).cast("string"), F.lit(".0"))).when(k % 6 == 1, (k % 900).cast("string")).when(k % 6 == 2, "").when(k % 6 == 3, F.concat(F.lit("x"), k.cast("string"))).when(k % 6 == 4, F.lit(None)).otherwise(F.concat(k.cast("string"), F.lit(".5")))
    return table(spark, sf_dir, "orders").select("o_orderkey", s.postcode_key(raw).alias("key"))


@query("o_orderkey:i day:d", "select o_orderkey, case when o_orderkey % 5 = 4 then null else cast(o_orderdate as date) end as day from orders")
def parsed_dates(spark, sf_dir):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    text = F.when(k % 5 == 0, F.date_format(d, "yyyy-MM-dd")).when(k % 5 == 1, F.concat(F.date_format(d, "yyyyMMdd"), F.lit(".0"))).when(k % 5 == 2, F.date_format(d, "d/M/yyyy")).when(k % 5 == 3, F.concat(F.lit(" "), F.date_format(d, "d-M-yyyy"))).otherwise("soon")
    return table(spark, sf_dir, "orders").select("o_orderkey", s.contract_date(text).alias("day"))


@query("sale_id:i year:s month_num:s month_sin:f month_cos:f year_num:f log_price:f log_area:f", f"""with {SALES} select sale_id, cast(year(contract_date) as varchar) as year, cast(month(contract_date) as varchar) as month_num, sin(2 * pi() * month(contract_date) / 12) as month_sin,
  cos(2 * pi() * month(contract_date) / 12) as month_cos, year(contract_date) + (month(contract_date) - 1) / 12.0 as year_num, case when purchase_price > 0 then log10(purchase_price) end as log_price, case when area_sqm > 0 then log10(area_sqm) end as log_area from sales""")
def calendar_features(spark, sf_dir):
    return sales(spark, sf_dir).withColumns(s.calendar_features(F.col("contract_date")) | {"log_price": s.safe_log10(F.col("purchase_price")), "log_area": s.safe_log10(F.col("area_sqm"))})


# fences

_LOGGED = "logged as (select *, cast(year(contract_date) as varchar) as grp, log10(purchase_price) as lp, log10(area_sqm) as la from sales where purchase_price > 0 and area_sqm > 0)"
_FIT = """fit as (select grp, 'purchase_price' as col, quantile_cont(lp, 0.25) as q1, quantile_cont(lp, 0.75) as q3, count(*) as n from {rows} group by 1 union all select grp, 'area_sqm', quantile_cont(la, 0.25), quantile_cont(la, 0.75), count(*) from {rows} group by 1
  union all select '__all__', 'purchase_price', quantile_cont(lp, 0.25), quantile_cont(lp, 0.75), count(*) from {rows} union all select '__all__', 'area_sqm', quantile_cont(la, 0.25), quantile_cont(la, 0.75), count(*) from {rows}),
  bound as (select grp, col as "column", q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi, n from fit)"""
_COLS = ["purchase_price", "area_sqm"]
_TRAIN = "train as (select * from logged where contract_date <= date '1998-12-31')"
_WIDE = """wide as (select grp, max(case when "column" = 'purchase_price' then lo end) as plo, max(case when "column" = 'purchase_price' then hi end) as phi, max(case when "column" = 'area_sqm' then lo end) as alo, max(case when "column" = 'area_sqm' then hi end) as ahi from bound group by 1)"""
_MARKED = f"""with {SALES}, {_LOGGED}, {_TRAIN}, {_FIT.format(rows="train")}, {_WIDE},
  logs as (select sale_id, cast(year(contract_date) as varchar) as grp, case when purchase_price > 0 then log10(purchase_price) end as lp, case when area_sqm > 0 then log10(area_sqm) end as la from sales),
  marked as (select l.sale_id, l.grp, coalesce(lp between g.plo and g.phi and la between g.alo and g.ahi, false) as iqr_corruption_ok,
    coalesce(lp between g.plo and g.phi and la between g.alo and g.ahi, false) and coalesce(case when o.grp is not null then lp between o.plo and o.phi and la between o.alo and o.ahi else lp between g.plo and g.phi and la between g.alo and g.ahi end, false) as iqr_keep,
    coalesce(lp between o.plo and o.phi and la between o.alo and o.ahi, false) as own_keep
    from logs l cross join (select * from wide where grp = '__all__') g left join (select * from wide where grp <> '__all__') o on l.grp = o.grp)"""


def _year():
    return F.year("contract_date")


def _train(spark, sf_dir: str) -> DataFrame:
    return sales(spark, sf_dir).where(F.col("contract_date") <= "1998-12-31")


@query("grp:s column:s lo:f hi:f n:i", f"with {SALES}, {_LOGGED}, {_FIT.format(rows='logged')} select * from bound")
def iqr_fence_by_year(spark, sf_dir):
    return fences.fit_bounds(sales(spark, sf_dir), _COLS, _year())


@query("sale_id:i iqr_corruption_ok:b iqr_keep:b", f"{_MARKED} select * from marked")
def iqr_fence_global_fallback(spark, sf_dir):
    train = _train(spark, sf_dir)
    return fences.mark_quality(sales(spark, sf_dir), fences.fit_bounds(train, _COLS, _year()), fences.global_bounds(train, _COLS), _COLS, _year())


@query("sale_id:i iqr_keep:b", f"{_MARKED} select sale_id, own_keep as iqr_keep from marked")
def iqr_flags(spark, sf_dir):
    return fences.flag_outliers(sales(spark, sf_dir), fences.fit_bounds(_train(spark, sf_dir), _COLS, _year()), _COLS, _year())


@query("rows_in:i dropped:i rows_out:i flagged:i", f"{_MARKED} select count(*) as rows_in, count_if(not iqr_corruption_ok) as dropped, count_if(iqr_corruption_ok) as rows_out, count_if(iqr_corruption_ok and not iqr_keep) as flagged from marked")
def iqr_filter_report(spark, sf_dir):
    return fences.fence(sales(spark, sf_dir), _COLS, _year(), F.col("contract_date") <= "1998-12-31", "per_year_train_only")[1]


@query("grp:s rows:i kept:i flagged:i dropped:i upper_purchase_price:f share_flagged:f", f"""{_MARKED} select m.grp, count(*) as "rows", count_if(iqr_keep) as kept, count_if(iqr_corruption_ok and not iqr_keep) as flagged, count_if(not iqr_corruption_ok) as dropped,
  max(pow(10, phi)) as upper_purchase_price, count_if(iqr_corruption_ok and not iqr_keep) / count(*) as share_flagged from marked m left join wide w on m.grp = w.grp group by 1""")
def fence_diagnostic(spark, sf_dir):
    train = _train(spark, sf_dir)
    fitted = fences.fit_bounds(train, _COLS, _year())
    return fences.diagnostic(fences.mark_quality(sales(spark, sf_dir), fitted, fences.global_bounds(train, _COLS), _COLS, _year()), fitted, _COLS, _year())


# splits

_SHAPE = {"min_train": 24, "horizon": 6, "step": 12, "embargo": 1, "holdout": 12}
_FOLDS_SQL = """months as (select date_trunc('month', min(contract_date)) as a, date_diff('month', min(contract_date), max(contract_date)) - 12 as ceiling from sales),
  folds as (select k as fold, cast(a as date) as train_start, cast(a + to_months(cast(23 + 12 * k as int)) as date) as train_end, cast(a + to_months(cast(25 + 12 * k as int)) as date) as valid_start,
    cast(a + to_months(cast(least(30 + 12 * k, ceiling) as int)) as date) as valid_end, 1 as embargo from months cross join range(0, 1000) t(k) where 25 + 12 * k <= ceiling and (k = 0 or 18 + 12 * k < ceiling))"""
_TAGS = f"""with {SALES}, {_FOLDS_SQL}, tags as (select s.*, fold, case when date_trunc('month', contract_date) between valid_start and valid_end then 'valid' else 'train' end as side from sales s join folds
  on date_trunc('month', contract_date) between train_start and train_end or date_trunc('month', contract_date) between valid_start and valid_end),
  purged as (select * from tags t where side = 'valid' or not exists (select 1 from tags v where v.side = 'valid' and v.fold = t.fold and v.group_key = t.group_key))"""


def _folds(spark, df: DataFrame) -> DataFrame:
    return splits.folds_frame(spark, splits.folds_of(df, **_SHAPE))


def _tags(spark, sf_dir: str) -> DataFrame:
    df = sales(spark, sf_dir)
    return splits.tagged(df, _folds(spark, df))


@query("fold:i train_start:d train_end:d valid_start:d valid_end:d embargo:i train_rows:i valid_rows:i train_rows_purged:i", f"""{_TAGS} select f.*, (select count(*) from tags t where t.fold = f.fold and side = 'train') as train_rows,
  (select count(*) from tags t where t.fold = f.fold and side = 'valid') as valid_rows, (select count(*) from purged t where t.fold = f.fold and side = 'train') as train_rows_purged from folds f""")
def fold_summary(spark, sf_dir):
    df = sales(spark, sf_dir)
    return splits.summarize(df, _folds(spark, df))


@query("fold:i side:s sale_id:i", f"{_TAGS} select * from purged")
def group_purge(spark, sf_dir):
    return splits.purge(_tags(spark, sf_dir))


@query("side:s sale_id:i", f"""with {SALES}, w as (select date_trunc('month', max(contract_date)) - interval 11 month as a from sales), v as (select s.* from sales s, w where contract_date >= a)
  select 'holdout' as side, sale_id from v union all select 'train', sale_id from sales s, w where contract_date < a and not exists (select 1 from v where v.group_key = s.group_key)""")
def holdout_split(spark, sf_dir):
    df = sales(spark, sf_dir)
    train, held = splits.holdout_split(df, *df.agg(F.min("contract_date"), F.max("contract_date")).first())
    return train.select(F.lit("train").alias("side"), "sale_id").union(held.select(F.lit("holdout"), "sale_id"))


# encoders


@query("key:s freq:f", f"with {SALES} select coalesce(cast(council as varchar), '<missing>') as key, count(*) / (select count(*) from sales where contract_date <= date '1998-12-31') as freq from sales where contract_date <= date '1998-12-31' group by 1")
def freq_encode(spark, sf_dir):
    return encoders.frequency_table(_train(spark, sf_dir), "council")


@query("key:s te:f", f"""with {SALES}, t as (select coalesce(cast(post_code as varchar), '<missing>') as key, log10(purchase_price) as y from sales where contract_date <= date '1998-12-31' and purchase_price > 0)
  select key, (sum(y) + 20 * (select avg(y) from t)) / (count(*) + 20) as te from t group by 1""")
def target_encode(spark, sf_dir):
    return encoders.target_table(_train(spark, sf_dir).withColumn("log_price", s.safe_log10(F.col("purchase_price"))), "post_code", "log_price")


@query("sale_id:i bin:i", f"""with {SALES}, e as (select list_sort(list_distinct(quantile_cont(area_sqm, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) as e from sales where contract_date <= date '1998-12-31')
  select sale_id, case when area_sqm is null or area_sqm < e[1] or area_sqm > e[len(e)] then -1 else greatest(0, len(list_filter(e, lambda x: x < area_sqm)) - 1) end as bin from sales cross join e""")
def quantile_bins(spark, sf_dir):
    edges = encoders.bin_edges(_train(spark, sf_dir), ["area_sqm"])["area_sqm"]
    return sales(spark, sf_dir).withColumn("bin", encoders.bin_of(F.col("area_sqm"), edges))


@query("sale_id:i area_sqm:f area_sqm__isna:f council__freq:f post_code__te:f", f"""with {SALES}, t as (select *, log10(purchase_price) as y from sales where contract_date <= date '1998-12-31'), m as (select quantile_cont(area_sqm, 0.5) as med, avg(y) as mean, count(*) as n from t),
  f as (select council, count(*) / (select n from m) as f from t group by 1), te as (select post_code, (sum(y) + 20 * (select mean from m)) / (count(*) + 20) as te from t group by 1),
  enc as (select s.sale_id, s.contract_date, coalesce(area_sqm, med) as a, cast(area_sqm is null as int) as na, coalesce(f, 0) as f, coalesce(te, mean) as te from sales s cross join m left join f on s.council = f.council left join te on s.post_code = te.post_code),
  st as (select avg(a) as ma, stddev_pop(a) as sa, avg(na) as mn, stddev_pop(na) as sn, avg(f) as mf, stddev_pop(f) as sf, avg(te) as mt, stddev_pop(te) as stt from enc where contract_date <= date '1998-12-31')
  select sale_id, (a - ma) / coalesce(nullif(sa, 0), 1) as area_sqm, (na - mn) / coalesce(nullif(sn, 0), 1) as area_sqm__isna, (f - mf) / coalesce(nullif(sf, 0), 1) as council__freq, (te - mt) / coalesce(nullif(stt, 0), 1) as post_code__te from enc cross join st""")
def standardize(spark, sf_dir):
    spec = encoders.FeatureSpec(numeric=("area_sqm",), low_card=("council",), high_card=("post_code",))
    log = lambda df: df.withColumn("log_price", s.safe_log10(F.col("purchase_price")))
    return encoders.Encoder(spec).fit(log(_train(spark, sf_dir))).transform(log(sales(spark, sf_dir)))


# models and metrics

_NAIVE = f"""with {SALES}, {PANEL}, {SPINE}, {_FEATURES}, med as (select quantile_cont(purchase_price, 0.5) as m from sales where contract_date <= date '1998-12-31'),
  naive as (select s.sale_id, s.contract_date, s.post_code, s.council, s.purchase_price, log10(s.purchase_price) as y, log10(greatest(coalesce(pc_median_price_12m, pc_median_price_6m, pc_median_price_3m, m), 1)) as p
    from sales s cross join med left join features f on s.post_code = f.post_code and date_trunc('month', contract_date) = f.month where contract_date > date '1998-12-31')"""
_METRICS = """count(*) as n, sqrt(avg((p - y) * (p - y))) * ln(10) as rmsle, avg(abs(p - y)) as mae_log10, case when var_pop(y) > 0 then 1 - sum((p - y) * (p - y)) / (var_pop(y) * count(y)) end as r2,
  quantile_cont(abs(pow(10, p) - pow(10, y)) / pow(10, y), 0.5) * 100 as mdape, avg(abs(pow(10, p) - pow(10, y)) / pow(10, y)) * 100 as mape"""


def _naive(spark, sf_dir: str) -> DataFrame:
    joined = panel.attach_panel(sales(spark, sf_dir), panel.rolling_features(_spine(spark, sf_dir)))
    late = joined.where(F.col("contract_date") > "1998-12-31")
    return models.naive_postcode(late, models.train_median(_train(spark, sf_dir)), "y_pred_log10").withColumn("y_true_log10", s.safe_log10(F.col("purchase_price")))


@query("sale_id:i y_pred_log10:f", f"{_NAIVE} select sale_id, p as y_pred_log10 from naive")
def naive_baseline(spark, sf_dir):
    return _naive(spark, sf_dir)


@query("n:i rmsle:f mae_log10:f r2:f mdape:f mape:f", f"{_NAIVE} select {_METRICS} from naive")
def metrics_overall(spark, sf_dir):
    return metrics.report(_naive(spark, sf_dir))


@query("council:s n:i rmsle:f mae_log10:f r2:f mdape:f mape:f", f"{_NAIVE} select council, {_METRICS} from naive group by 1 having count(*) >= 50")
def metrics_grouped(spark, sf_dir):
    return metrics.grouped_report(_naive(spark, sf_dir), ["council"])


_SCORES = "scores as (select post_code % 3 as fold, council as model, sqrt(avg((p - y) * (p - y))) * ln(10) as rmsle from naive group by 1, 2)"


def _scores(spark, sf_dir: str) -> DataFrame:
    return metrics.grouped_report(_naive(spark, sf_dir).withColumn("fold", F.col("post_code") % 3), ["fold", "council"], least=1).withColumnRenamed("council", "model")


@query("model:s mean:f std:f min:f max:f folds:i", f"{_NAIVE}, {_SCORES} select model, avg(rmsle) as mean, stddev_samp(rmsle) as std, min(rmsle) as min, max(rmsle) as max, count(*) as folds from scores group by 1")
def fold_stability(spark, sf_dir):
    return metrics.fold_stability(_scores(spark, sf_dir))


@query("model:s wins:i leader_flips:i", f"""{_NAIVE}, {_SCORES}, lead as (select fold, arg_min(model, rmsle) as leader from scores group by 1), steps as (select leader <> lag(leader) over (order by fold) as f from lead)
  select leader as model, count(*) as wins, (select count_if(f) from steps) as leader_flips from lead group by 1""")
def win_counts(spark, sf_dir):
    return metrics.win_counts(_scores(spark, sf_dir))


@query("layer:s mean:f std:f folds_improved:i delta:f", f"""{_NAIVE}, {_SCORES}, l as (select *, dense_rank() over (order by model) as i from scores), d as (select *, rmsle - lag(rmsle) over (partition by fold order by i) as d from l),
  g as (select model as layer, i, avg(rmsle) as mean, stddev_samp(rmsle) as std, coalesce(count_if(d < 0), 0) as folds_improved from d group by 1, 2) select *, mean - lag(mean) over (order by i) as delta from g""")
def ablation(spark, sf_dir):
    from pyspark.sql import Window

    return metrics.ablation(_scores(spark, sf_dir).withColumn("layer_idx", F.dense_rank().over(Window.orderBy("model"))).withColumnRenamed("model", "layer"))


@query("rows:i worst_rows:i share_of_squared_error:f", f"""{_NAIVE}, r as (select (p - y) * (p - y) as e, row_number() over (order by (p - y) * (p - y) desc, sale_id) as k, count(*) over () as n from naive)
  select max(n) as "rows", count_if(k <= ceil(n * 0.01)) as worst_rows, sum(case when k <= ceil(n * 0.01) then e end) / sum(e) as share_of_squared_error from r""")
def worst1pct_share(spark, sf_dir):
    return metrics.worst_share(_naive(spark, sf_dir).withColumn("error", F.col("y_pred_log10") - F.col("y_true_log10")), "error", "sale_id")


_BIN = "greatest(0, cast(ceil((row_number() over (order by {v}, sale_id) - 1) * {q} / cast(nullif(count(*) over () - 1, 0) as double) - 1e-12) as bigint) - 1)"


@query("sale_id:i bin:i", f"with {SALES} select sale_id, {_BIN.format(v='purchase_price', q=10)} as bin from sales")
def qcut_deciles(spark, sf_dir):
    return metrics.ranked_bins(sales(spark, sf_dir), "purchase_price", "sale_id", 10)


@query("band:i n:i mdape:f mape:f", f"""{_NAIVE}, b as (select *, abs(pow(10, p) - pow(10, y)) / pow(10, y) as ape, {_BIN.format(v='purchase_price', q=5)} as band from naive)
  select band, count(*) as n, quantile_cont(ape, 0.5) * 100 as mdape, avg(ape) * 100 as mape from b group by 1""")
def price_band_errors(spark, sf_dir):
    y, p = F.pow(F.lit(10.0), "y_true_log10"), F.pow(F.lit(10.0), "y_pred_log10")
    df = _naive(spark, sf_dir).withColumn("ape", F.abs(p - y) / y)
    return metrics.price_band_errors(df, "purchase_price", "ape", "ape", "sale_id")


@query("band:i n:i median_area:f median_price:f median_unit_price:f unit_price_index:f", f"""with {SALES}, f as (select *, {_BIN.format(v='area_sqm', q=10)} as band from sales where purchase_price > 0 and area_sqm > 0),
  g as (select band, count(*) as n, quantile_cont(area_sqm, 0.5) as median_area, quantile_cont(purchase_price, 0.5) as median_price, quantile_cont(purchase_price / area_sqm, 0.5) as median_unit_price from f group by 1)
  select *, median_unit_price / first(median_unit_price) over (order by band) * 100 as unit_price_index from g""")
def unit_price_index(spark, sf_dir):
    return describe.unit_price_index(sales(spark, sf_dir), "purchase_price", "area_sqm", "sale_id")


# correlation

_BOTH = f"with {SALES}, b as (select *, log10(purchase_price) as lp, log10(area_sqm) as la from sales where purchase_price > 0 and area_sqm > 0)"


def _both(spark, sf_dir: str) -> DataFrame:
    return sales(spark, sf_dir).withColumns({"lp": s.safe_log10(F.col("purchase_price")), "la": s.safe_log10(F.col("area_sqm"))}).where("lp is not null and la is not null")


@query("n:i r:f", f"{_BOTH} select count(*) as n, corr(la, lp) as r from b")
def corr_pearson_log(spark, sf_dir):
    return econometrics.pearson(_both(spark, sf_dir), "la", "lp")


@query("n:i r:f", f"{_BOTH}, k as (select rank() over (order by area_sqm) + (count(*) over (partition by area_sqm) - 1) / 2.0 as a, rank() over (order by purchase_price) + (count(*) over (partition by purchase_price) - 1) / 2.0 as p from b) select count(*) as n, corr(a, p) as r from k")
def corr_spearman(spark, sf_dir):
    return econometrics.spearman(_both(spark, sf_dir), "area_sqm", "purchase_price")


@query("year:i n:i r:f", f"{_BOTH} select year(contract_date) as year, count(*) as n, corr(area_sqm, purchase_price) as r from b group by 1 having count(*) >= 500")
def corr_by_year(spark, sf_dir):
    return econometrics.pearson(_both(spark, sf_dir).withColumn("year", _year()), "area_sqm", "purchase_price", ["year"], 500)


@query("slope:f n:i", f"{_BOTH}, d as (select la - avg(la) over (partition by post_code) as x, lp - avg(lp) over (partition by post_code) as y from b) select sum(x * y) / sum(x * x) as slope, count(*) as n from d")
def within_location_slope(spark, sf_dir):
    return econometrics.within_slope(_both(spark, sf_dir), "lp", "la", "post_code")


# description


@query("year:i median_F:f median_O:f index_F:f index_O:f gap:f", f"""with {SALES}, g as (select year(contract_date) as year, quantile_cont(case when purpose = 'F' then purchase_price end, 0.5) as f, quantile_cont(case when purpose = 'O' then purchase_price end, 0.5) as o from sales group by 1),
  b as (select f as bf, o as bo from g where year = 1996) select year, f as median_F, o as median_O, f / bf * 100 as index_F, o / bo * 100 as index_O, o / bo * 100 - f / bf * 100 as gap from g left join b on true""")
def pivot_index_base(spark, sf_dir):
    return describe.pivot_index(sales(spark, sf_dir), _year(), "purpose", ["F", "O"], "purchase_price", 1996)


@query("bin:i left:f n:i", """with e as (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders where o_totalprice is not null), b as (select least(59, cast(floor((o_totalprice - lo) / nullif((hi - lo) / 60, 0)) as int)) as bin, lo, hi from orders cross join e where o_totalprice is not null)
  select bin, lo + bin * ((hi - lo) / 60) as "left", count(*) as n from b group by bin, lo, hi""")
def histogram(spark, sf_dir):
    return describe.histogram(table(spark, sf_dir, "orders"), "o_totalprice")


@query("count:i mean:f std:f min:f p01:f p25:f p50:f p75:f p99:f max:f", """select count(o_totalprice) as count, avg(o_totalprice) as mean, stddev_samp(o_totalprice) as std, min(o_totalprice) as min, quantile_cont(o_totalprice, 0.01) as p01, quantile_cont(o_totalprice, 0.25) as p25,
  quantile_cont(o_totalprice, 0.5) as p50, quantile_cont(o_totalprice, 0.75) as p75, quantile_cont(o_totalprice, 0.99) as p99, max(o_totalprice) as max from orders""")
def describe_price(spark, sf_dir):
    return describe.summary(table(spark, sf_dir, "orders"), "o_totalprice")


@query("c_mktsegment:s q1:f median:f q3:f low:f high:f outliers:i n:i", """with q as (select c_mktsegment as m, quantile_cont(c_acctbal, 0.25) as q1, quantile_cont(c_acctbal, 0.5) as median, quantile_cont(c_acctbal, 0.75) as q3 from customer where c_acctbal is not null group by 1)
  select m as c_mktsegment, q1, median, q3, min(c_acctbal) filter (c_acctbal between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as low, max(c_acctbal) filter (c_acctbal between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as high,
  count_if(not c_acctbal between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as outliers, count(*) as n from customer join q on c_mktsegment = m where c_acctbal is not null group by 1, 2, 3, 4""")
def boxplot(spark, sf_dir):
    return describe.boxplot(table(spark, sf_dir, "customer"), "c_acctbal", "c_mktsegment")


@query("year:i n:i median_price:f min_price:f max_price:f", f"with {SALES} select year(contract_date) as year, count(*) as n, quantile_cont(purchase_price, 0.5) as median_price, min(purchase_price) as min_price, max(purchase_price) as max_price from sales group by 1")
def yearly_prices(spark, sf_dir):
    return describe.yearly(sales(spark, sf_dir), "contract_date", "purchase_price")


@query("threshold:f n:i", "select t as threshold, (select count(*) from orders where o_totalprice < t) as n from (values (10000.0), (100000.0), (250000.0)) v(t)")
def threshold_counts(spark, sf_dir):
    return describe.below(table(spark, sf_dir, "orders"), "o_totalprice", [10_000, 100_000, 250_000])


@query("ix:i iy:i n:i", f"{_BOTH} select floor(la / 0.1) as ix, floor(lp / 0.1) as iy, count(*) as n from b group by 1, 2")
def grid_counts(spark, sf_dir):
    return describe.grid_counts(_both(spark, sf_dir), F.col("la"), F.col("lp"), 0.1, 0.1)


@query("bin:i n:i median_x:f median_y:f", f"""{_BOTH}, e as (select list_sort(list_distinct(quantile_cont(area_sqm, [0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0]))) as e from b)
  select greatest(0, len(list_filter(e, lambda x: x < area_sqm)) - 1) as bin, count(*) as n, quantile_cont(area_sqm, 0.5) as median_x, quantile_cont(purchase_price, 0.5) as median_y from b cross join e group by 1 having count(*) >= 30""")
def binned_trend(spark, sf_dir):
    return describe.binned_trend(_both(spark, sf_dir), "area_sqm", "purchase_price")


# distance and events

_STATIONS = [(-33.87 + 0.11 * i, 151.2 - 0.07 * i * i) for i in range(6)]
_XY = "(-34.5 + 0.05 * (c_custkey % 37)) as lat, (150.1 + 0.043 * (c_custkey % 41)) as lon"
_KM = "6371 * acos(greatest(-1, least(1, sin(radians(lat)) * sin(radians(slat)) + cos(radians(lat)) * cos(radians(slat)) * cos(radians(slon) - radians(lon)))))"
_STATIONS_SQL = "stations(slat, slon) as (values " + ", ".join(f"(cast({a!r} as double), cast({b!r} as double))" for a, b in _STATIONS) + ")"
_NEAR = f"with {_STATIONS_SQL}, c as (select c_custkey, c_nationkey, cast({_XY.split(' as lat, ')[0]} as double) as lat, cast({_XY.split(' as lat, ')[1].removesuffix(' as lon')} as double) as lon from customer), near as (select c_custkey, c_nationkey, min({_KM}) as km from c cross join stations group by 1, 2)"


def _near(spark, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", (F.lit(-34.5) + F.lit(0.05) * (k % 37)).alias("lat"), (F.lit(150.1) + F.lit(0.043) * (k % 41)).alias("lon"))
    return geo.nearest_km(df, _STATIONS, out="km")


@query("c_custkey:i km:f", f"{_NEAR} select * from near")
def geo_nearest(spark, sf_dir):
    return _near(spark, sf_dir)


@query("c_nationkey:i n_points:i dist_mean:f dist_range:f dist_p25:f dist_p50:f dist_p90:f dist_p100:f share_within_5km:f", f"""{_NEAR} select c_nationkey, count(*) as n_points, avg(km) as dist_mean, max(km) - min(km) as dist_range, quantile_cont(km, 0.25) as dist_p25, quantile_cont(km, 0.5) as dist_p50,
  quantile_cont(km, 0.9) as dist_p90, max(km) as dist_p100, avg(case when km <= 5 then 1.0 else 0.0 end) as share_within_5km from near group by 1 having count(*) >= 3""")
def geo_distribution(spark, sf_dir):
    return geo.geo_distribution(_near(spark, sf_dir), "c_nationkey", "km")


_EVENT = geo.EventSpec("1998-06-01", regions=("AFRICA", "ASIA", "EUROPE", "AMERICA"))
_LOOKUP = """lookup as (select n_nationkey as post_code, r_name as sa4, case when n_nationkey % 7 = 6 then null else round_even(n_nationkey * 0.37, 2) end as centroid from nation join region on n_regionkey = r_regionkey),
  measured as (select n_nationkey as post_code, (n_nationkey % 6) * 0.9 as m from nation where n_nationkey % 3 = 0),
  assigned as (select l.post_code, coalesce(m, centroid) as distance, case when m is not null then 'geocoded' when centroid is not null then 'centroid' end as distance_source,
    case when coalesce(m, centroid) <= 2 then 1 when coalesce(m, centroid) > 3 and sa4 in ('AFRICA', 'ASIA', 'EUROPE', 'AMERICA') then 0 end as treated, centroid <= 2 as by_centroid from lookup l left join measured using (post_code))"""


def _assigned(spark, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    lookup = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(n.alias("post_code"), F.col("r_name").alias("sa4"), F.when(n % 7 == 6, None).otherwise(s.half_even(n * 0.37, 2)).alias("dist_metro_new"))
    measured = table(spark, sf_dir, "nation").where(n % 3 == 0).select(n.alias("post_code"), ((n % 6) * 0.9).alias("dist_p25"))
    return geo.assign_treatment(lookup, _EVENT, measured)


@query("post_code:i distance:f distance_source:s treated:i", f"with {_LOOKUP} select * from assigned")
def treatment_assign(spark, sf_dir):
    return _assigned(spark, sf_dir)


@query("treated:i keys:i mean_distance:f geocoded:i disagree:i", f"with {_LOOKUP} select treated, count(distinct post_code) as keys, avg(distance) as mean_distance, count_if(distance_source = 'geocoded') as geocoded, coalesce(count_if(by_centroid <> (treated = 1)), 0) as disagree from assigned group by 1")
def treatment_summary(spark, sf_dir):
    return geo.treatment_summary(_assigned(spark, sf_dir))


_EVENT_PANEL = f"""with {SALES}, {_LOOKUP}, ep as (select s.post_code, cast(date_trunc('month', contract_date) as date) as month, treated, count(*) as n_sales, quantile_cont(purchase_price, 0.5) as median_price, quantile_cont(purchase_price / nullif(area_sqm, 0), 0.5) as median_unit_price,
  max((year(contract_date) - 1998) * 12 + month(contract_date) - 6) as event_time from sales s join assigned a on s.post_code = a.post_code and treated is not null where (year(contract_date) - 1998) * 12 + month(contract_date) - 6 between -24 and 24 group by 1, 2, 3)"""


def _event_panel(spark, sf_dir: str) -> DataFrame:
    return geo.event_panel(sales(spark, sf_dir), _assigned(spark, sf_dir), _EVENT)


@query("post_code:i month:d treated:i n_sales:i median_price:f median_unit_price:f event_time:i", f"{_EVENT_PANEL} select * from ep")
def event_panel(spark, sf_dir):
    return _event_panel(spark, sf_dir)


@query("post_code:i month:d treated:i n_sales:i median_price:f event_time:i", f"""{_EVENT_PANEL}, u as (select post_code, max(treated) as treated from ep group by 1), m as (select cast(unnest(generate_series(min(month), max(month), interval 1 month)) as date) as month from ep)
  select u.post_code, m.month, u.treated, coalesce(n_sales, 0) as n_sales, median_price, (year(m.month) - 1998) * 12 + month(m.month) - 6 as event_time from u cross join m left join ep on ep.post_code = u.post_code and ep.month = m.month""")
def balanced_panel(spark, sf_dir):
    return panel.balance_panel(_event_panel(spark, sf_dir), event=_EVENT.event)


# rows only: solved on the driver from aggregated moments, resampled with our own draws, or learned


_ONE_WAY = """d as (select unit, cast(x as double) - avg(x) over (partition by unit) as x, cast(y as double) - avg(y) over (partition by unit) as y from w),
  f as (select sum(x * y) / sum(x * x) as coef, sum(x * x) as sxx, count(*) as n from d), c as (select unit, sum(x * (y - coef * x)) as s from d cross join f group by 1),
  g as (select count(*) as clusters, sum(s * s) as meat from c)
  select '{term}' as term, coef, sqrt(meat * clusters / (clusters - 1)) / sxx as se, n, clusters from f cross join g"""


@query("term:s coef:f se:f n:i clusters:i", f"{_BOTH}, w as (select post_code as unit, la as x, lp as y from b), {_ONE_WAY.format(term='la')}")
def place_regression(spark, sf_dir):
    """One absorbed factor: a closed form, with clustered errors."""
    return econometrics.fe_regression(_both(spark, sf_dir), "lp", ["la"], "post_code", None, "post_code").frame(spark)


@query("term:s coef:f se:f n:i clusters:i", f"""{_EVENT_PANEL}, w as (select e.post_code as unit, case when event_time >= 0 then ln(1 + distance) else 0 end as x, log10(median_price) as y from ep e join assigned a on e.post_code = a.post_code where distance <= 10), {_ONE_WAY.format(term='dose')}""")
def dose_without_months(spark, sf_dir):
    """All months as one: a closed form."""
    log = _event_panel(spark, sf_dir).withColumns({"log_price": s.safe_log10(F.col("median_price")), "one": F.lit(1)})
    return econometrics.dose_response(log, "log_price", _assigned(spark, sf_dir).select("post_code", "distance"), month="one").frame(spark)


@query("coef:f intercept:f", f"{_BOTH} select covar_pop(la, lp) * count(*) / (var_pop(la) * count(*) + 1) as coef, avg(lp) - avg(la) * covar_pop(la, lp) * count(*) / (var_pop(la) * count(*) + 1) as intercept from b")
def ridge_of_one(spark, sf_dir):
    fit = models.ridge(_both(spark, sf_dir), ["la"], "lp")
    return spark.createDataFrame([(float(fit.coef[0]), fit.intercept)], "coef double, intercept double")


@query("term:s coef:f se:f ci_low:f ci_high:f p_value:f n:i clusters:i")
def fe_regression(spark, sf_dir):
    """Two absorbed factors have no closed SQL form; tests hold it against dense least squares."""
    df = _both(spark, sf_dir).withColumn("month", s.month_floor(F.col("contract_date")))
    return econometrics.fe_regression(df, "lp", ["la"], "post_code", "month", "post_code").frame(spark)


@query("event_time:i coef:f se:f ci_low:f ci_high:f")
def event_study(spark, sf_dir):
    """As fe_regression."""
    log = panel.balance_panel(_event_panel(spark, sf_dir), event=_EVENT.event).withColumn("log_price", s.safe_log10(F.col("median_price")))
    return econometrics.event_study(log, "log_price").frame(spark)


@query("term:s coef:f se:f ci_low:f ci_high:f p_value:f n:i clusters:i")
def dose_response(spark, sf_dir):
    """As fe_regression."""
    log = _event_panel(spark, sf_dir).withColumn("log_price", s.safe_log10(F.col("median_price")))
    return econometrics.dose_response(log, "log_price", _assigned(spark, sf_dir).select("post_code", "distance")).frame(spark)


def _bootstrap_sql(rows: str, x: str, y: str, draws: int = 300, by: str = "0") -> str:
    """Resampled postcodes of each ``by``, drawn by the same hashes as the operator draws."""
    sums = "sum(n) as n, sum(sx) as sx, sum(sy) as sy, sum(sxx) as sxx, sum(syy) as syy, sum(sxy) as sxy"
    return f"""(with g as (select {by} as g, post_code, count(*) as n, sum({x}) as sx, sum({y}) as sy, sum({x} * {x}) as sxx, sum({y} * {y}) as syy, sum({x} * {y}) as sxy from {rows} where {x} is not null and {y} is not null group by 1, 2),
    m as (select *, row_number() over (partition by g order by cast(post_code as varchar)) - 1 as i, count(*) over (partition by g) as k from g),
    p as (select g, d, ('0x' || substr(md5(concat_ws(':', 17, d, i)), 1, 12))::bigint % k as i from m cross join range(1, {draws + 1}) t(d)),
    e as (select g, 0 as d, n, sx, sy, sxx, syy, sxy from m union all select p.g, d, n, sx, sy, sxx, syy, sxy from p join m on p.g = m.g and p.i = m.i),
    r as (select g, d, case when n * sxx > sx * sx and n * syy > sy * sy then (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) end as r from (select g, d, {sums} from e group by 1, 2))
    select g, max(r) filter (where d = 0) as estimate, quantile_cont(r, 0.025) filter (where d > 0) as low, quantile_cont(r, 0.975) filter (where d > 0) as high, stddev_pop(r) filter (where d > 0) as std,
      count(r) filter (where d > 0) as draws, (select count(*) from m where m.g = r.g) as clusters from r group by 1)"""


@query("estimate:f low:f high:f std:f draws:i clusters:i", f"{_BOTH} select * from {_bootstrap_sql('b', 'la', 'lp')}")
def bootstrap_ci(spark, sf_dir):
    return econometrics.bootstrap_ci(_both(spark, sf_dir), "la", "lp", "post_code")


@query("year:i n:i estimate:f low:f high:f draws:i", f"{_BOTH} select g as year, n, estimate, low, high, draws from {_bootstrap_sql('b', 'la', 'lp', 60, 'year(contract_date)')} join (select year(contract_date) as g, count(*) as n from b group by 1 having count(*) >= 500) using (g)")
def area_price_by_year(spark, sf_dir):
    return hypotheses.yearly_intervals(_both(spark, sf_dir).withColumn("year", _year()), "la", "lp", "post_code")


_PRIME = 2**31 - 1
_PLACEBO_SQL = f"""{_BOTH}, s as (select count(*) as n, avg(la) as ma, avg(lp) as mp, var_pop(la) as va, var_pop(lp) as vp, covar_pop(la, lp) as c from b),
  o as (select la - ma as a, lp - mp as p, ('0x' || substr(md5('17:' || sale_id), 1, 12))::bigint % greatest(1, n // 50000) as block, ('0x' || substr(md5('17:o:' || sale_id), 1, 12))::bigint as o, cast(sale_id as varchar) as k from b cross join s),
  r as (select a, p, block, row_number() over (partition by block order by o, k) as r from o),
  h0 as (select d, block, p, r, (r * 48271 + d * 69621) % {_PRIME} as h from r cross join range(1, 201) t(d)),
  h1 as (select d, block, p, r, (xor(h, h >> 13) * 1103515245) % {_PRIME} as h from h0),
  h2 as (select d, block, p, r, (xor(h, h >> 16) * 1566083941) % {_PRIME} as h from h1),
  q as (select d, block, p, row_number() over (partition by d, block order by h, r) as r from h2),
  c as (select 0 as draw, c from s union all select q.d, sum(r.a * q.p) / max(n) from q join r on q.block = r.block and q.r = r.r cross join s group by 1)
  select draw, (c.c - va) / sqrt(va * (vp + va - 2 * c.c)) as correlation from c cross join s"""


@query("draw:i correlation:f", _PLACEBO_SQL)
def permutation_placebo(spark, sf_dir):
    return econometrics.ratio_placebo(_both(spark, sf_dir), "la", "lp", "sale_id")


@query("draw:i post_mean:f pretrend_p:f")
def random_treatment_placebo(spark, sf_dir):
    """Random arms of our own."""
    log = _event_panel(spark, sf_dir).withColumn("log_price", s.safe_log10(F.col("median_price"))).cache()
    got = econometrics.placebo_random(log, "log_price", 3, 17)
    out = spark.createDataFrame([(i, e.post_mean(), e.pretrend_p) for i, e in enumerate(got)], "draw int, post_mean double, pretrend_p double")
    log.unpersist()
    return out


_SPEC = encoders.FeatureSpec(numeric=("area_sqm", "pc_median_price_12m", "year_num"), low_card=("council", "zoning"), high_card=("post_code",))


def _cv(spark, sf_dir: str, name: str, **sizes) -> DataFrame:
    """Scores by fold of a learner over features of a whole run."""
    features = pipelines.build_features(sales(spark, sf_dir)).persist()
    return pipelines.cross_validate(features, _SPEC, splits.folds_of(features, **_SHAPE), [name], **sizes).by_fold


@query("fold:i n:i rmsle:f r2:f mdape:f")
def ridge_cv(spark, sf_dir):
    """A solved linear system per fold; tests hold it against the closed form."""
    return _cv(spark, sf_dir, "ridge")


@query("fold:i n:i rmsle:f r2:f mdape:f")
def rf_cv(spark, sf_dir):
    """Learned trees."""
    return _cv(spark, sf_dir, "random_forest", random_forest={"trees": 10, "depth": 6})


@query("fold:i n:i rmsle:f r2:f mdape:f")
def gbt_cv(spark, sf_dir):
    """Learned trees."""
    return _cv(spark, sf_dir, "gbt", gbt={"rounds": 8, "depth": 4})


# whole runs


@query("sale_id:i log_price:f log_area:f month_sin:f pc_median_price_12m:f contemporaneous_n_sales:i zoning:s", f"""with {SALES}, {PANEL}, {SPINE}, {_FEATURES}, z as (select zoning as zone, count(*) as zn from (select upper(trim(zoning)) as zoning from sales) group by 1)
  select sale_id, log10(purchase_price) as log_price, log10(area_sqm) as log_area, sin(2 * pi() * month(contract_date) / 12) as month_sin, pc_median_price_12m, n_sales as contemporaneous_n_sales, case when zn < 500 then 'OTHER' else zone end as zoning
  from sales s left join features f on s.post_code = f.post_code and date_trunc('month', contract_date) = f.month left join z on upper(trim(s.zoning)) = zone where area_sqm is not null and purchase_price is not null""")
def feature_frame(spark, sf_dir):
    return pipelines.build_features(sales(spark, sf_dir))


@query("sale_id:i", f"""with {SALES}, {_LOGGED}, {_FIT.format(rows="logged")}, {_WIDE} select l.sale_id from logged l join wide g on g.grp = '__all__' where lp between plo and phi and la between alo and ahi""")
def global_fence_removal(spark, sf_dir):
    df = sales(spark, sf_dir)
    return fences.drop_outside(df, fences.global_bounds(df, _COLS), _COLS)


@query("kind:s value:s n:i rmsle:f mae_log10:f r2:f mdape:f mape:f", f"""{_NAIVE}, u as (select 'council' as kind, council as value, * from naive union all select 'year', cast(year(contract_date) as varchar), * from naive) select kind, value, {_METRICS} from u group by 1, 2 having count(*) >= 200""")
def diagnostics(spark, sf_dir):
    return pipelines.diagnostics(_naive(spark, sf_dir).withColumn("year", _year()), {"council": "council", "year": "year"})


@query("fold:i AUTOMOBILE:f BUILDING:f", f"{_NAIVE}, {_SCORES} select fold, max(case when model = 'AUTOMOBILE' then rmsle end) as AUTOMOBILE, max(case when model = 'BUILDING' then rmsle end) as BUILDING from scores group by 1")
def fold_table(spark, sf_dir):
    return pipelines.fold_table(_scores(spark, sf_dir), ["AUTOMOBILE", "BUILDING"])


@query("model:s mean_difference:f wins:i folds:i", f"""{_NAIVE}, {_SCORES} select s.model, avg(s.rmsle - b.rmsle) as mean_difference, count_if(s.rmsle < b.rmsle) as wins, count(*) as folds from scores s join scores b on s.fold = b.fold and b.model = 'BUILDING' where s.model <> 'BUILDING' group by 1""")
def paired_differences(spark, sf_dir):
    return metrics.paired_differences(_scores(spark, sf_dir).withColumnRenamed("model", "config"), "BUILDING").withColumnRenamed("config", "model")


@query("post_code:i month:d pc_median_price_3m:f", f"""with {SALES}, {PANEL}, {SPINE}, {_FEATURES}, r as (select *, row_number() over (partition by post_code order by month) as a, row_number() over (partition by post_code order by month desc) as b from features)
  select x.post_code, x.month, y.pc_median_price_3m from r x join r y on x.post_code = y.post_code and x.a = y.b""")
def time_reversed_placebo(spark, sf_dir):
    return hypotheses.time_reversed(panel.rolling_features(_spine(spark, sf_dir), windows=(3,)))


_RANKED = "(select post_code, rank() over (order by area_sqm) + (count(*) over (partition by area_sqm) - 1) / 2.0 as rx, rank() over (order by purchase_price) + (count(*) over (partition by purchase_price) - 1) / 2.0 as ry from b)"


@query("statistic:s estimate:f low:f high:f draws:i clusters:i", f"""{_BOTH} select 'pearson' as statistic, * from {_bootstrap_sql('b', 'area_sqm', 'purchase_price')} union all
  select 'spearman', * from {_bootstrap_sql(_RANKED, 'rx', 'ry')} union all select 'log_pearson', * from {_bootstrap_sql('b', 'la', 'lp')}""")
def area_price_headline(spark, sf_dir):
    return hypotheses.area_price(sales(spark, sf_dir)).headline


@query("specification:s term:s coef:f se:f n:i")
def elasticity_robustness(spark, sf_dir):
    """As fe_regression."""
    df = sales(spark, sf_dir).withColumn("distance", (F.col("post_code") % 7) * 1.5)
    out = None
    for name, fit in hypotheses.robustness(df, "distance").items():
        own = fit.frame(spark).withColumn("specification", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


@query("draw:i correlation:f", _PLACEBO_SQL)
def unit_price_placebo(spark, sf_dir):
    return hypotheses.unit_price(sales(spark, sf_dir), "sale_id").placebo


@query("name:s passed:b violations:i")
def run_consistency(spark, sf_dir):
    """Tables of a run of two baselines agree with each other; driver-side comparison of a few counts."""
    features = pipelines.build_features(sales(spark, sf_dir)).persist()
    runs = pipelines.cross_validate(features, _SPEC, splits.folds_of(features, **_SHAPE), ["naive", "global"])
    held = pipelines.evaluate_holdout(features, _SPEC, ["naive", "global"])
    out = pipelines.consistency(runs.predictions, runs.by_fold, runs.pooled, held.pooled)
    features.unpersist()
    return out


# parts of runs


@query("model:s n:i rmsle:f mae_log10:f r2:f mdape:f mape:f", f"{_NAIVE}, u as (select 'naive_postcode' as model, y, p from naive union all select 'naive_global', y, log10(greatest(m, 1)) from naive cross join med) select model, {_METRICS} from u group by 1")
def compare_models(spark, sf_dir):
    own = _naive(spark, sf_dir)
    both = F.array(F.struct(F.lit("naive_postcode").alias("model"), F.col("y_pred_log10").alias("p")), F.struct(F.lit("naive_global").alias("model"), F.log10(F.lit(max(models.train_median(_train(spark, sf_dir)), 1.0))).alias("p")))
    return metrics.compare_models(own.withColumn("_m", F.explode(both)).select("_m.model", "y_true_log10", F.col("_m.p").alias("y_pred_log10")))


@query("post_code:i month:d pc_median_price_6m:f pc_n_sales_6m:i", f"""with {SALES}, {PANEL}, {SPINE} select post_code, month, case when count(median_price) over w >= 3 then quantile_cont(median_price, 0.5) over w end as pc_median_price_6m,
  case when count(n_sales) over w >= 3 then sum(n_sales) over w end as pc_n_sales_6m from spine window w as (partition by post_code order by month rows between 6 preceding and 1 preceding)""")
def rolling_half_windows(spark, sf_dir):
    return panel.rolling_features(_spine(spark, sf_dir), windows=(6,), strict=False)


@query("sale_id:i fwd:f", f"""with {SALES}, {PANEL}, {SPINE}, fw as (select post_code, month, case when count(median_price) over a = 3 then quantile_cont(median_price, 0.5) over a end as fwd
  from spine window a as (partition by post_code order by month rows between 1 following and 3 following)) select sale_id, fwd from sales s left join fw on s.post_code = fw.post_code and date_trunc('month', contract_date) = fw.month""")
def forward_attached(spark, sf_dir):
    ahead = experiments.attach_forward(sales(spark, sf_dir), panel.forward_features(_spine(spark, sf_dir), windows=(3,)))
    return ahead.withColumnRenamed("pc_median_price_3m__fwd", "fwd")


@query("p_partkey:i fine:b", "select p_partkey, p_retailprice > 0 and (case when p_size % 5 = 0 then null else p_size - 10 end >= 0 or p_size % 5 = 0) as fine from part")
def valid_rows(spark, sf_dir):
    df = table(spark, sf_dir, "part").withColumn("dist", F.when(F.col("p_size") % 5 != 0, F.col("p_size") - 10))
    return df.withColumn("fine", cleaning.valid_values(df.withColumn("p_retailprice", F.col("p_retailprice").cast("double")), ["p_retailprice"], ["dist", "absent"]))


@query("c_nationkey:i lat:f lon:f c_name:s", f"{_NEAR} select c.c_nationkey, avg(lat) as lat, avg(lon) as lon, min_by(c_name, c.c_custkey) as c_name from c join customer using (c_custkey) group by 1")
def centroid_table(spark, sf_dir):
    k = F.col("c_custkey")
    df = table(spark, sf_dir, "customer").withColumns({"lat": F.lit(-34.5) + F.lit(0.05) * (k % 37), "lon": F.lit(150.1) + F.lit(0.043) * (k % 41)})
    return geo.centroids(df, "c_nationkey", label="c_name", order="c_custkey")


@query("post_code:i treated_a:i treated_b:i agree:b", f"with {_LOOKUP}, t as (select post_code, treated as treated_a, case when centroid <= 2 then 1 when centroid > 3 and sa4 in ('AFRICA', 'ASIA', 'EUROPE', 'AMERICA') then 0 end as treated_b from assigned join lookup using (post_code)) select *, treated_a is not distinct from treated_b as agree from t")
def definitions_compared(spark, sf_dir):
    measured = _assigned(spark, sf_dir)
    n = F.col("n_nationkey")
    lookup = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(n.alias("post_code"), F.col("r_name").alias("sa4"), F.when(n % 7 == 6, None).otherwise(s.half_even(n * 0.37, 2)).alias("dist_metro_new"))
    return geo.compare_definitions(measured, geo.assign_treatment(lookup, _EVENT))


@query("fold:i train_start:d train_end:d valid_start:d valid_end:d embargo:i", """select k as fold, date '2001-01-01' as train_start, cast(date '2001-01-01' + to_months(cast(83 + 24 * k as int)) as date) as train_end, cast(date '2001-01-01' + to_months(cast(85 + 24 * k as int)) as date) as valid_start,
  cast(date '2001-01-01' + to_months(cast(least(96 + 24 * k, 263) as int)) as date) as valid_end, 1 as embargo from range(0, 8) t(k)""")
def fold_months(spark, sf_dir):
    """The folds of 23 years by default."""
    return splits.folds_frame(spark, splits.rolling_origin(date(2001, 1, 1), date(2023, 12, 1)))


@query("fold:i train_start:d train_end:d valid_start:d valid_end:d", f"with {SALES}, {_FOLDS_SQL} select fold, greatest(train_start, cast(train_end - interval 29 month as date)) as train_start, train_end, valid_start, valid_end from folds")
def sliding_folds(spark, sf_dir):
    return splits.folds_frame(spark, splits.folds_of(sales(spark, sf_dir), mode="sliding", window=30, **_SHAPE))


@query("sale_id:i", f"""with {SALES}, t as (select * from sales where contract_date <= date '1998-12-31'), c as (select contract_date, sum(count(*)) over (order by contract_date) as upto from t group by 1),
  e as (select min(contract_date) as e from c where upto >= 0.9 * (select count(*) from t)) select sale_id from t, e where contract_date > e.e""")
def stop_tail(spark, sf_dir):
    train = _train(spark, sf_dir)
    return train.where(models.early_stop_tail(train, "contract_date"))


@query("sale_id:i", f"with {SALES}, r as (select sale_id, row_number() over (order by contract_date, sale_id) as r from sales) select sale_id from r where (r - 1) % 7 = 0")
def sampled_rows(spark, sf_dir):
    return tables.systematic_sample(sales(spark, sf_dir), "contract_date", "sale_id", 7)


@query("o_orderkey:i x:f area:f parts:i head:s", """select o_orderkey, case when o_orderkey % 3 = 0 then null else o_totalprice end as x, o_totalprice * case o_orderkey % 4 when 0 then 10000 when 3 then null else 1 end as area,
  len(list_filter([trim(o_orderstatus), '', trim(o_orderpriority)], lambda v: v <> '')) as parts, trim(o_orderstatus) as head from orders""")
def scalar_texts(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, F.lit("n/a")).otherwise(F.concat(F.lit(" "), F.col("o_totalprice").cast("string"), F.lit(" ")))
    parts = s.split_list(F.concat_ws(" | ", "o_orderstatus", F.lit(" "), "o_orderpriority"))
    unit = F.when(k % 4 == 0, " h").when(k % 4 == 3, "x").otherwise("M")
    return table(spark, sf_dir, "orders").select("o_orderkey", s.number(text).alias("x"), s.area_sqm(F.col("o_totalprice").cast("double"), unit).alias("area"), F.size(parts).alias("parts"), parts[0].alias("head"))
