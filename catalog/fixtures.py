"""The filing world derived from the given tables.

The SQL texts run unchanged on Spark and on the checking engine, save that Spark
sums firm-years before it joins the firms; amounts are integer cents, so sums
are exact.
"""

from __future__ import annotations

from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from filingrisk.policy import ITEM_CODES
from filingrisk.session import configure, materialise, shuffles_removed

SWITCH = date(1998, 1, 1)
MIN_FYEAR = 1996
HORIZON = 12
MARKING = {"trust_legacy_regime": False, "switch": SWITCH, "table": ITEM_CODES}

_LINES = """
with li as (
  select o_custkey, cast(year(o_orderdate) as int) as fyear, l_returnflag as rf, l_linestatus as ls,
         l_quantity as q, l_discount as dc, l_tax as tx, cast(round(l_extendedprice*100) as bigint) as c
  from {orders} join {lineitem} on l_orderkey = o_orderkey)
"""
_KEYS = """  make_date(fyear,12,31) as reporting_date,
  case when o_custkey % 50 = 0 then null else make_date(fyear+1,3,31) end as filing_date,
  concat(cast(o_custkey as string),'_',cast(fyear as string),'-12-31') as doc_id,
"""
_AMOUNTS = """  cast(sum(c) as bigint) as total_assets,
  cast(sum(case when rf<>'R' then c end) as bigint) as total_liabilities,
  cast(sum(case when ls='O' then c end) as bigint) as current_assets,
  cast(sum(case when rf='A' then c end) as bigint) as current_liabilities,
  cast(sum(case when ls='O' and rf='R' then c end) as bigint) as cash,
  cast(sum(case when rf='N' then c end) as bigint) as long_term_debt,
  cast(sum(case when rf='R' then c end) as bigint) as equity,
  cast(sum(case when dc>=0.05 then -c else c end) as bigint) as net_income,
  cast(sum(case when q>=10 then c end) as bigint) as revenue,
  cast(sum(case when dc>=0.06 then -c else c end) as bigint) as ebit,
  cast(sum(case when tx>=0.06 then c end) as bigint) as interest_expense,
  cast(sum(case when tx<0.02 then c end) as bigint) as retained_earnings,
  cast(sum(case when ls='O' and rf='N' then c end) as bigint) as inventory,
  cast(sum(case when ls='O' and rf='A' then c end) as bigint) as receivables
"""
_SIC = "when 'AUTOMOBILE' then 3711 when 'BUILDING' then 1520\n    when 'FURNITURE' then 2510 when 'HOUSEHOLD' then 2840 else 351 end"
FIRM_YEARS = f"""{_LINES}select o_custkey as cik, fyear, max(c_name) as name,
  case max(c_mktsegment) {_SIC} as sic,
{_KEYS}{_AMOUNTS}from li join {{customer}} on c_custkey = o_custkey group by o_custkey, fyear
"""

# The same rows for Spark: a text in a grouping makes it sort all lines, so the firms' texts are joined to their sums.
# A firm that comes several times in the customers counts as often.
_NAMES = [line.rsplit(" as ", 1)[1].strip(" ,") for line in _AMOUNTS.strip().splitlines()]
FIRM_YEARS_BY_SUMS = f"""{_LINES.rstrip()},
sums as (select o_custkey, fyear, {_AMOUNTS}from li group by o_custkey, fyear),
firms as (select c_custkey, max(c_name) as c_name, max(c_mktsegment) as c_mktsegment, count(*) as copies from {{customer}} group by c_custkey)
select o_custkey as cik, fyear, c_name as name, case c_mktsegment {_SIC} as sic,
{_KEYS}{', '.join(f'{n} * copies as {n}' for n in _NAMES)}
from sums join firms on c_custkey = o_custkey
"""

EVENTS = """
select o_custkey as cik, cast(l_shipdate as date) as filing_date_8k,
  concat_ws(',',
    case when l_quantity>=50 and l_discount>=0.10
      then case when l_shipdate>=timestamp '1998-01-01 00:00:00' then '1.03' else '3' end end,
    case l_linenumber
      when 1 then case when l_shipdate>=timestamp '1998-01-01 00:00:00' then '4.01' else '4' end
      when 2 then case when l_shipdate>=timestamp '1998-01-01 00:00:00' then '5.02' else '6' end
      when 3 then '2.04' when 4 then '2.06' when 5 then '3.01' when 6 then '4.02' else '8.01' end,
    '9.01') as items,
  concat(cast(l_orderkey as string),'-',cast(l_linenumber as string)) as accession
from {lineitem} join {orders} on l_orderkey = o_orderkey
"""

ENFORCEMENT = """
select o_custkey as cik, cast(date_trunc('month', o_orderdate) as date) as m0,
  case when o_orderpriority='1-URGENT' and o_orderkey % 20 = 0 and o_orderkey % 3 <> 0 then 1 else 0 end as fsf,
  case when o_orderkey % 7 = 0 then 1 else 0 end as revoked
from {orders}
"""

# Scores with many ties: 1009 and 1013 distinct values.
PREDICTIONS = """
select o_orderkey as row_id, o_custkey as cik, cast(o_orderkey % 3 as int) as fold,
  case when o_orderpriority='1-URGENT' then 1 else 0 end as y,
  ((o_orderkey*7919) % 1009)/1009.0e0 as p,
  ((o_orderkey*104729 + case when o_orderpriority='1-URGENT' then 300 else 0 end) % 1013)/1013.0e0 as p_b,
  o_orderdate < timestamp '2000-01-01 00:00:00' as is_train
from {orders}
"""

# Every document as a raw filing record; equal doc ids on purpose.
RAW_FILINGS = """
select doc_id as line_no, cast(doc_id % 300 as string) as cik, concat('Firm ', cast(doc_id % 300 as string)) as name,
  cast(1000 + doc_id % 97 as string) as sic, '10-K' as filing_type,
  concat(cast(1 + doc_id % 31 as string), '-', cast(1 + doc_id % 12 as string), '-', cast(2001 + doc_id % 8 as string)) as filing_date,
  concat('31-12-', cast(cast(2000 + (doc_id % 2400 - doc_id % 300) / 300 as int) as string)) as reporting_date,
  text as mda
from {documents}
"""

# Flat annual facts: several tags, forms and filing days per concept and year.
FACTS = """
select o_custkey as cik,
  case l_returnflag when 'A' then 'Revenues' when 'N' then 'SalesRevenueNet' else 'Assets' end as tag,
  'USD' as unit, cast((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey as bigint) as pos,
  cast(year(o_orderdate) as int) as fy, case when l_linenumber = 7 then 'Q1' else 'FY' end as fp,
  case when l_linenumber = 6 then '10-Q' when l_linenumber = 5 then '10-K/A' else '10-K' end as form,
  cast(l_shipdate as date) as filed, cast(round(l_extendedprice*100) as double) as val
from {lineitem} join {orders} on l_orderkey = o_orderkey
"""

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
_TEXTS = {
    "fx_firm_year": FIRM_YEARS,
    "fx_events": EVENTS,
    "fx_aaer": ENFORCEMENT,
    "fx_pred": PREDICTIONS,
    "fx_raw": RAW_FILINGS,
    "fx_facts": FACTS,
}
_SPARK_TEXTS = _TEXTS | {"fx_firm_year": FIRM_YEARS_BY_SUMS}


def with_views(*names: str) -> str:
    """The WITH head that defines the named derived views in check SQL."""
    bare = {t: t for t in TABLES}
    return "with " + ",\n".join(f"{n} as ({_TEXTS[n].format(**bare).strip()})" for n in names)


class World:
    """Given tables and derived views for one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _view(self, name: str) -> DataFrame:
        text = _SPARK_TEXTS[name]
        used = {t: self.table(t) for t in TABLES if "{" + t + "}" in text}
        return self.spark.sql(text, **used)

    @cached_property
    def firm_years(self) -> DataFrame:
        return self._view("fx_firm_year")

    @cached_property
    def stored_firm_years(self) -> DataFrame:
        """The firm-years computed once, for operators that read them repeatedly."""
        with shuffles_removed(self.spark):
            return materialise(self.firm_years)

    @cached_property
    def events(self) -> DataFrame:
        return self._view("fx_events")

    @cached_property
    def enforcement(self) -> DataFrame:
        return self._view("fx_aaer")

    @cached_property
    def predictions(self) -> DataFrame:
        return self._view("fx_pred")

    @cached_property
    def raw_filings(self) -> DataFrame:
        return self._view("fx_raw")

    @cached_property
    def facts(self) -> DataFrame:
        return self._view("fx_facts")

    @property
    def documents(self) -> DataFrame:
        return self.table("documents")
