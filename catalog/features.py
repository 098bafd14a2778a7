"""Financial ratios, trends, percentiles, panel joins and annual facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.fixtures import MARKING, MIN_FYEAR, with_views
from catalog.labels import HEAD, training_rows
from catalog.registry import query
from filingrisk.operators import facts as fct
from filingrisk.operators import panel, ratios
from filingrisk.operators.roles import resolve_concepts, resolve_roles
from filingrisk.policy import CONCEPTS
from filingrisk.session import materialise
from filingrisk.sources.facts import flatten_facts


def _div(a: str, b: str) -> str:
    return f"(cast({a} as double) / nullif(cast({b} as double), 0))"


SQL_RATIOS = {
    "fin_leverage": _div("total_liabilities", "total_assets"),
    "fin_debt_to_equity": _div("long_term_debt", "equity"),
    "fin_current_ratio": _div("current_assets", "current_liabilities"),
    "fin_quick_ratio": _div("(current_assets - inventory)", "current_liabilities"),
    "fin_cash_ratio": _div("cash", "current_liabilities"),
    "fin_wc_to_assets": _div("(current_assets - current_liabilities)", "total_assets"),
    "fin_roa": _div("net_income", "total_assets"),
    "fin_net_margin": _div("net_income", "revenue"),
    "fin_interest_coverage": _div("ebit", "interest_expense"),
    "fin_re_to_assets": _div("retained_earnings", "total_assets"),
    "fin_asset_turnover": _div("revenue", "total_assets"),
    "fin_log_assets": "case when total_assets is not null then ln(1 + greatest(total_assets, 0)) end",
}
SQL_RATIOS["fin_altman_z"] = (
    f"1.2e0*{SQL_RATIOS['fin_wc_to_assets']} + 1.4e0*{SQL_RATIOS['fin_re_to_assets']}"
    f" + 3.3e0*{_div('ebit', 'total_assets')} + 0.6e0*{_div('equity', 'total_liabilities')}"
    f" + 1.0e0*{SQL_RATIOS['fin_asset_turnover']}"
)
TRENDS = ("leverage", "roa", "debt_to_equity", "current_ratio", "log_assets", "asset_turnover", "net_margin")


def _digits(name: str) -> int:
    # Percentiles are short fractions: at six digits some would be exact halves.
    return 9 if name.endswith("_sic_pct") else 6


def _rounded(names):
    return [F.round(n, _digits(n)).alias(n) for n in names]


def _ratio_cte(source: str, name: str = "r") -> str:
    cols = ", ".join(f"{e} as {n}" for n, e in SQL_RATIOS.items())
    return f"{name} as (select *, {cols} from {source})"


# One query per ratio family keeps a failing one easy to place.
_FAMILIES = {
    "prj4_leverage": ["fin_leverage"],
    "prj5_debt_to_equity": ["fin_debt_to_equity"],
    "prj6_current_ratio": ["fin_current_ratio"],
    "prj7_quick_ratio": ["fin_quick_ratio"],
    "prj8_cash_ratio": ["fin_cash_ratio"],
    "prj9_working_capital": ["fin_wc_to_assets"],
    "prj10_return_on_assets": ["fin_roa"],
    "prj11_net_margin": ["fin_net_margin"],
    "prj12_interest_coverage": ["fin_interest_coverage"],
    "prj13_retained_earnings": ["fin_re_to_assets"],
    "prj14_asset_turnover": ["fin_asset_turnover"],
    "prj15_log_assets": ["fin_log_assets"],
    "prj16_altman_z": ["fin_altman_z"],
}


def _register_ratio(name: str, cols: list[str]) -> None:
    picked = ", ".join(f"round({SQL_RATIOS[c]}, 6) as {c}" for c in cols)

    @query(name, f"{with_views('fx_firm_year')} select doc_id, {picked} from fx_firm_year")
    def _(w):
        levels = ratios.base_ratios(w.firm_years)
        return w.firm_years.select("doc_id", *[F.round(levels[c], 6).alias(c) for c in cols])


for _name, _cols in _FAMILIES.items():
    _register_ratio(_name, _cols)


@query(
    "prj2_concept_aliases",
    f"""{with_views('fx_firm_year')} select doc_id, round({SQL_RATIOS['fin_leverage']}, 6) as fin_leverage,
    round({SQL_RATIOS['fin_roa']}, 6) as fin_roa, round({SQL_RATIOS['fin_asset_turnover']}, 6) as fin_asset_turnover
    from fx_firm_year""",
)
def _(w):
    # Short data-vendor names, mixed case.
    named = w.firm_years.select(
        "doc_id",
        F.col("total_assets").alias("AT"),
        F.col("total_liabilities").alias("lt"),
        F.col("net_income").alias("NI"),
        F.col("revenue").alias("sale"),
    )
    assert set(resolve_concepts(named)) == {"total_assets", "total_liabilities", "net_income", "revenue"}
    levels = ratios.base_ratios(named)
    return named.select("doc_id", *[F.round(levels[c], 6).alias(c) for c in ("fin_leverage", "fin_roa", "fin_asset_turnover")])


@query(
    "prj1_column_roles",
    f"""{with_views('fx_firm_year')} select concat(cast(cik as varchar), '_', cast(fyear as varchar)) as doc_id,
    'misstate' as label, 'item7' as text, 'fyear' as year from fx_firm_year""",
)
def _(w):
    named = w.firm_years.select(
        "cik", "fyear", F.lit(0).alias("misstate"), F.col("name").alias("item7"), F.lit(1).alias("default")
    )
    out, roles = resolve_roles(named)
    return out.select(
        roles.row_id,
        F.lit(roles.label).alias("label"),
        F.lit(roles.text).alias("text"),
        F.lit(roles.year).alias("year"),
    )


@query(
    "prj3_safe_division",
    """select l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_discount, 0), 6) as per_discount,
    round(l_extendedprice / nullif(l_tax, 0), 6) as per_tax from lineitem""",
)
def _(w):
    from filingrisk.functions.numeric import safe_div

    price = F.col("l_extendedprice")
    return w.table("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.round(safe_div(price, F.col("l_discount")), 6).alias("per_discount"),
        F.round(safe_div(price, F.col("l_tax")), 6).alias("per_tax"),
    )


def _trend_sql(source: str, named: str = "t") -> str:
    w = "over (partition by cik order by fyear, doc_id)"
    w3 = "over (partition by cik order by fyear, doc_id rows between 2 preceding and current row)"
    cols = []
    for t in TRENDS:
        cols.append(f"fin_{t} - lag(fin_{t}) {w} as fin_d_{t}")
        cols.append(
            f"case when count(fin_{t}) {w3} >= 2 then stddev_samp(fin_{t}) {w3} end as fin_vol3_{t}"
        )
    rev = "case when revenue is not null then ln(1 + greatest(revenue, 0)) end"
    cols.append(f"{rev} - lag({rev}) {w} as fin_d_log_revenue")
    return f"{named} as (select *, {', '.join(cols)} from {source})"


TREND_NAMES = [f"fin_{k}_{t}" for t in TRENDS for k in ("d", "vol3")] + ["fin_d_log_revenue"]


@query(
    "wn1_wn2_wn3_trends",
    f"{with_views('fx_firm_year')},{_ratio_cte('fx_firm_year')},{_trend_sql('r')} select doc_id, "
    + ", ".join(f"round({n}, 6) as {n}" for n in TREND_NAMES)
    + " from t",
)
def _(w):
    rows = w.stored_firm_years
    levels = rows.withColumns(ratios.base_ratios(rows))
    out, names = ratios.add_trends(levels)
    return out.select("doc_id", *_rounded(names))


PCT = {"fin_leverage", "fin_roa", "fin_current_ratio", "fin_wc_to_assets"}
_SIC2 = "case when sic >= 1000 then sic // 100 else sic // 10 end"


def _pct_sql(source: str, named: str = "q") -> str:
    cols = []
    for b in sorted(PCT):
        part = f"partition by sic2, fyear, {b} is null"
        cols.append(
            f"case when {b} is not null and count({b}) over (partition by sic2, fyear) >= 5 then "
            f"(rank() over ({part} order by {b}) + (count(*) over (partition by sic2, fyear, {b}) - 1) / 2.0e0)"
            f" / count({b}) over (partition by sic2, fyear) end as {b}_sic_pct"
        )
    return f"{named} as (select *, {', '.join(cols)} from (select *, {_SIC2} as sic2 from {source}))"


@query(
    "wn4_industry_percentile",
    f"{with_views('fx_firm_year')},{_ratio_cte('fx_firm_year')},{_pct_sql('r')} select doc_id, "
    + ", ".join(f"round({b}_sic_pct, 9) as {b}_sic_pct" for b in sorted(PCT))
    + " from q",
)
def _(w):
    rows = w.stored_firm_years
    levels = rows.withColumns(ratios.base_ratios(rows))
    out, names = ratios.add_industry_percentiles(levels)
    return out.select("doc_id", *_rounded(names))


@query(
    "wn4_percentile_repeated_ids",
    f"{with_views('fx_firm_year')},{_ratio_cte('fx_firm_year')},{_pct_sql('r')} select cik, fyear, 'same' as doc_id, "
    + ", ".join(f"round({b}_sic_pct, 9) as {b}_sic_pct" for b in sorted(PCT))
    + " from q",
)
def _(w):
    rows = w.stored_firm_years.withColumn("doc_id", F.lit("same"))
    out, names = ratios.add_industry_percentiles(rows.withColumns(ratios.base_ratios(rows)))
    return out.select("cik", "fyear", "doc_id", *_rounded(names))


ALL_FEATURES = [*SQL_RATIOS, *TREND_NAMES, *[f"{b}_sic_pct" for b in sorted(PCT)]]


@query(
    "prj17_missing_flags",
    f"{with_views('fx_firm_year')},{_ratio_cte('fx_firm_year')} select doc_id, "
    + ", ".join(f"case when {n} is null then 1.0e0 else 0.0e0 end as fin_miss_{n[4:]}" for n in SQL_RATIOS)
    + " from r",
)
def _(w):
    out, names = ratios.add_financial_features(
        w.firm_years, include_trends=False, include_industry=False
    )
    return out.select("doc_id", *[n for n in names if n.startswith("fin_miss_")])


@query(
    "prj18_all_financial_features",
    f"{with_views('fx_firm_year')},{_ratio_cte('fx_firm_year')},{_trend_sql('r')},{_pct_sql('t')} select doc_id, "
    + ", ".join(f"round({n}, {_digits(n)}) as {n}" for n in ALL_FEATURES)
    + ", "
    + ", ".join(f"case when {n} is null then 1.0e0 else 0.0e0 end as fin_miss_{n[4:]}" for n in ALL_FEATURES)
    + " from q",
)
def _(w):
    out, names = ratios.add_financial_features(w.stored_firm_years)
    return out.select("doc_id", *_rounded(names))


# Half of the panel's years, one clashing column.
_PANEL = "panel as (select cik, fyear, total_assets, revenue * 2 as sales_twice from fx_firm_year where fyear % 2 = 0)"


def _half_panel(w):
    return w.firm_years.where("fyear % 2 = 0").select(
        "cik", "fyear", "total_assets", (F.col("revenue") * 2).alias("sales_twice")
    )


@query(
    "jn1_join_panel",
    f"""{with_views('fx_firm_year')},{_PANEL} select f.doc_id, f.total_assets, p.total_assets as total_assets_fin, p.sales_twice
    from fx_firm_year f left join panel p using (cik, fyear)""",
)
def _(w):
    rows = w.firm_years.select("doc_id", "cik", "fyear", "total_assets")
    return panel.join_panel(rows, _half_panel(w)).drop("cik", "fyear")


@query(
    "jn8_fill_from_local",
    f"""{with_views('fx_firm_year')} select f.doc_id, coalesce(f.filing_date, l.filing_date) as filing_date, l.mda
    from fx_firm_year f left join (select cik, fyear, reporting_date as filing_date, concat('text ', doc_id) as mda
      from fx_firm_year where fyear >= 1997) l using (cik, fyear)""",
)
def _(w):
    local = w.firm_years.where("fyear >= 1997").select(
        "cik", "fyear", F.col("reporting_date").alias("filing_date"), F.concat(F.lit("text "), "doc_id").alias("mda")
    )
    base = w.firm_years.select("doc_id", "cik", "fyear", "filing_date")
    return panel.fill_from_local(base, local, ["filing_date", "mda", "label"]).drop("cik", "fyear")


@query(
    "jn3_bankruptcy_lookup",
    f"{HEAD} select doc_id, bankruptcy_date from fx_firm_year left join bk using (cik)",
)
def _(w):
    from filingrisk.operators.events import bankruptcy_dates

    return w.firm_years.join(bankruptcy_dates(w.events, **MARKING), "cik", "left").select(
        "doc_id", "bankruptcy_date"
    )


@query(
    "prj26_default_dates",
    f"""{with_views('fx_firm_year')} select doc_id, rep as reporting_date, coalesce(filing_date, cast(rep + interval 90 day as date)) as filing_date
    from (select doc_id, filing_date, coalesce(case when cik % 3 = 0 then null else cast(reporting_date - interval 30 day as date) end,
      make_date(fyear, 12, 31)) as rep from fx_firm_year)""",
)
def _(w):
    gaps = w.firm_years.select(
        "doc_id",
        "fyear",
        "filing_date",
        F.when(F.col("cik") % 3 == 0, None).otherwise(F.date_sub("reporting_date", 30)).alias("reporting_date"),
    )
    return panel.with_default_dates(gaps).drop("fyear")


@query(
    "prj24_firm_year_keys",
    f"{with_views('fx_firm_year')} select cik, fyear, doc_id from fx_firm_year",
)
def _(w):
    from filingrisk.sources.firm_years import add_firm_year_keys

    return add_firm_year_keys(w.firm_years.select("cik", "reporting_date")).drop("reporting_date")


@query(
    "prj25_missing_model_columns",
    f"{with_views('fx_firm_year')} select doc_id, total_assets, cast(null as double) as fin_new from fx_firm_year",
)
def _(w):
    rows = w.firm_years.select("doc_id", "total_assets")
    return panel.with_null_columns(rows, ["total_assets", "fin_new"])


def _clean_facts() -> str:
    return """annual as (select *, case tag when 'Assets' then 'total_assets' else 'revenue' end as concept,
      case tag when 'SalesRevenueNet' then 2 else 0 end as pr from fx_facts
      where fp = 'FY' and form in ('10-K','10-K/A') and fy is not null and val is not null),
    best as (select *, min(pr) over (partition by cik, concept) as bp from annual),
    firsts as (select cik, fy as fyear, concept, val from best where pr = bp
      qualify row_number() over (partition by cik, concept, fy order by filed nulls last, pos) = 1)"""


@query(
    "ag5_first_filed_facts",
    f"{with_views('fx_facts')},{_clean_facts()} select * from firsts",
)
def _(w):
    return fct.first_filed(w.facts)


@query(
    "ag5_coalesce_tags",
    f"""{with_views('fx_facts')},{_clean_facts()} select cik, fy as fyear, concept, val from annual
    qualify row_number() over (partition by cik, concept, fy order by pr, filed nulls last, pos) = 1""",
)
def _(w):
    return fct.first_filed(w.facts, coalesce_tags=True)


@query(
    "ag6_pivot_panel",
    f"{with_views('fx_facts')},{_clean_facts()} select cik, fyear, "
    + ", ".join(
        f"max(case when concept = '{c}' then val end) as {c}"
        if c in ("total_assets", "revenue")
        else f"cast(null as double) as {c}"
        for c in CONCEPTS
    )
    + " from firsts group by cik, fyear",
)
def _(w):
    return fct.annual_panel(w.facts)


@query(
    "src5_nested_facts",
    f"{with_views('fx_facts')} select cik, tag, unit, fy, fp, form, filed, val from fx_facts",
)
def _(w):
    return flatten_facts(nested_facts(w)).drop("pos", "end")


def nested_facts(w):
    """The flat facts folded into objects of a company and year, as JSON text, and parsed again."""
    from filingrisk.schemas import COMPANY_FACTS

    entry = F.struct(
        "fy", "fp", "form", F.col("filed").cast("string").alias("filed"), "val"
    )
    by_tag = w.facts.groupBy("cik", "fy", "tag", "unit").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", entry.alias("e")))), lambda x: x["e"]).alias("es")
    )
    by_firm = by_tag.groupBy("cik", "fy").agg(
        F.map_from_entries(
            F.collect_list(
                F.struct("tag", F.struct(F.create_map("unit", "es").alias("units")))
            )
        ).alias("gaap")
    )
    text = by_firm.select(
        F.to_json(F.struct("cik", F.struct(F.col("gaap").alias("us-gaap")).alias("facts"))).alias("j")
    )
    return text.select(F.from_json("j", COMPANY_FACTS).alias("o")).select("o.*")


@query(
    "so2_first_panel_rows",
    f"""{with_views('fx_facts')} select cik, fy as fyear, val from fx_facts
    qualify row_number() over (partition by cik, fy order by filed, pos, tag, val) = 1""",
)
def _(w):
    rows = w.facts.withColumnRenamed("fy", "fyear")
    return fct.first_panel_rows(rows, ["filed", "pos", "tag", "val"]).select("cik", "fyear", "val")


_FEATURE_SUMS = ", ".join(f"round(avg({n}), 6) as {n}" for n in ALL_FEATURES)


@query(
    "training_feature_means",
    f"""{HEAD}, kept as (select * from train_rows where fyear >= {MIN_FYEAR}),
    {_ratio_cte('kept')},{_trend_sql('r')},{_pct_sql('t')}
    select fyear, {_FEATURE_SUMS} from q group by fyear""",
)
def _(w):
    kept = materialise(panel.from_year(training_rows(w), MIN_FYEAR))
    out, _names = ratios.add_financial_features(kept, include_missing=False)
    return out.groupBy("fyear").agg(*[F.round(F.avg(n), 6).alias(n) for n in ALL_FEATURES])
