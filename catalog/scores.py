"""Score arithmetic, look-ups and sorted selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.evaluation import bundle_sql, rounded
from catalog.fixtures import with_views
from catalog.registry import query
from catalog.sources import scratch, spread
from filingrisk import policy
from filingrisk.operators import evaluation, panel, scoring
from filingrisk.plans import jobs

PRED = with_views("fx_pred")
YEARS = with_views("fx_firm_year")
_EPS = "1e-6"


def _logit(p: str) -> str:
    c = f"least(greatest({p}, {_EPS}), 1 - {_EPS})"
    return f"ln({c}/(1-{c}))"


@query(
    "prj28_combine_log_odds",
    f"""{PRED} select row_id, round(1/(1+exp(-(0.6e0*{_logit('p')} + 0.4e0*{_logit('p_b')}))), 8) as p_ensemble,
    round(0.75e0*p + 0.25e0*p_b, 8) as p_mean from fx_pred""",
)
def _(w):
    p, b = F.col("p"), F.col("p_b")
    return rounded(
        w.predictions.select(
            "row_id",
            scoring.combine_probabilities(p, b).alias("p_ensemble"),
            scoring.combine_probabilities(
                p, b, scoring.EnsembleWeights(3, 1), method="mean"
            ).alias("p_mean"),
        ),
        ["p_ensemble", "p_mean"],
    )


def _scaled(p: str, frm: int, to) -> str:
    return f"(1 - pow(1 - least({p}, 1-1e-15), {to}/{frm}.0e0))"


@query(
    "prj29_horizon_scaling",
    f"""{PRED} select row_id, round({_scaled('p', 12, 24)}, 8) as pd_24, round({_scaled('p', 12, 6)}, 8) as pd_6,
    round(p, 8) as pd_12 from fx_pred""",
)
def _(w):
    p = F.col("p")
    return w.predictions.select(
        "row_id",
        *[
            F.round(scoring.scale_pd(p, from_months=12, to_months=m), 8).alias(f"pd_{m}")
            for m in (24, 6, 12)
        ],
    )


_H, _M, _L = policy.BAND_NAMES["default"]
_FH, _FM, _FL = policy.BAND_NAMES["fraud"]


@query(
    "prj30_risk_bands",
    f"""{PRED} select row_id, case when p >= 2.5e0*b then '{_H}' when p >= 0.85e0*b then '{_M}' else '{_L}' end as default_band,
    case when p >= 0.22e0 then '{_FH}' when p >= 0.15e0 then '{_FM}' else '{_FL}' end as fraud_band
    from fx_pred, (select 1 - pow(1 - 0.2e0, 24/12.0e0) as b)""",
)
def _(w):
    p = F.col("p")
    return w.predictions.select(
        "row_id",
        scoring.risk_band(p, label_source="default", months=24, base_rate=0.2).alias("default_band"),
        scoring.risk_band(p).alias("fraud_band"),
    )


def _years_scored(w):
    return w.firm_years.select(
        "doc_id", "cik", "fyear", "reporting_date",
        (((F.col("cik") * 7919 + F.col("fyear")) % 1009) / F.lit(1009.0)).alias("pd_score"),
    )


_YS = "ys as (select doc_id, cik, fyear, reporting_date, ((cik*7919 + fyear) % 1009)/1009.0e0 as pd_score from fx_firm_year)"


@query(
    "prj31_term_structure",
    f"""{YEARS},{_YS}, g as (select unnest([12,24,36,48,60,120]) as horizon_months),
    t as (select doc_id, horizon_months, reporting_date as window_start, cast(reporting_date + to_months(horizon_months) as date) as window_end,
      case when horizon_months = 24 then pd_score else 1 - pow(1-pd_score, horizon_months/24.0e0) end as pd,
      1 - pow(1 - 0.012e0, horizon_months/12.0e0) as b from ys, g)
    select doc_id, cast(horizon_months as int) as horizon_months, window_start, window_end, round(pd, 8) as pd,
      case when pd >= 2.5e0*b then '{_H}' when pd >= 0.85e0*b then '{_M}' else '{_L}' end as band from t""",
)
def _(w):
    out = scoring.term_structure(_years_scored(w), model_months=24, horizon_months=48)
    return rounded(out, ["pd"]).select(
        "doc_id", "horizon_months", "window_start", "window_end", "pd", "band"
    )


@query(
    "prj32_wide_horizons",
    f"""{YEARS},{_YS} select doc_id, 12 as pd_score_model_h, 36 as pd_horizon_months, round({_scaled('pd_score', 12, 36)}, 8) as pd_score_horizon,
    round(pd_score, 8) as pd_12m, round({_scaled('pd_score', 12, 24)}, 8) as pd_24m, round({_scaled('pd_score', 12, 60)}, 8) as pd_60m,
    round({_scaled('pd_score', 12, 120)}, 8) as pd_120m from ys""",
)
def _(w):
    names = ["pd_score_horizon", *[f"pd_{m}m" for m in policy.WIDE_HORIZONS]]
    out = scoring.wide_horizons(_years_scored(w), model_months=12, horizon_months=36)
    return rounded(out, names).select("doc_id", "pd_score_model_h", "pd_horizon_months", *names)


@query(
    "prj33_base_rate_and_lift",
    f"""{PRED}, b as (select fold, avg(cast(y as double)) as base_rate from fx_pred group by fold)
    select row_id, round(1 - pow(1 - base_rate, 12/60.0e0), 8) as base_12m, round(p/(1 - pow(1 - 0.012e0, 60/12.0e0)), 8) as lift
    from fx_pred join b using (fold)""",
)
def _(w):
    rows = evaluation.with_null_model(w.predictions, ["fold"], name="base_rate")
    return rounded(
        rows.select(
            "row_id",
            scoring.base_rate_12m(F.col("base_rate"), 60).alias("base_12m"),
            scoring.lift_over_base(F.col("p"), None, 60).alias("lift"),
        ),
        ["base_12m", "lift"],
    )


@query(
    "ag10_score_summary",
    f"""{YEARS},{_YS}, z as (select *, cast(cik % 7 = 0 and fyear % 2 = 0 as int) as lab from ys)
    select cik, round(avg(pd_score), 8) as mean_score, round(min(pd_score), 8) as min_score, round(max(pd_score), 8) as max_score,
    round(avg(pd_score) filter (lab = 1), 8) as mean_positive_score,
    coalesce(array_to_string(list_sort(list(distinct fyear) filter (lab = 1)), ','), '') as positive_years from z group by cik""",
)
def _(w):
    label = ((F.col("cik") % 7 == 0) & (F.col("fyear") % 2 == 0)).cast("int")
    out = scoring.score_summary(_years_scored(w).withColumn("lab", label), label_col="lab", by=["cik"])
    text = F.array_join(F.transform("positive_years", lambda y: y.cast("string")), ",")
    return rounded(
        out.withColumn("positive_years", text),
        ["mean_score", "min_score", "max_score", "mean_positive_score"],
    )


@query(
    "ev16_backfill_brier_skill",
    f"{PRED},{bundle_sql('fx_pred', 'fold', 12)} select fold, round(1 - brier/(base_rate*(1-base_rate)), 7) as brier_skill from m",
)
def _(w):
    stored = evaluation.metric_bundle(w.predictions, ["fold"]).drop("brier_skill")
    out = scoring.backfill_brier_skill(rounded(stored, ["brier", "base_rate"], 12))
    return out.select("fold", F.round("brier_skill", 7).alias("brier_skill"))


@query("so3_company_index", f"{YEARS} select distinct cik, name from fx_firm_year")
def _(w):
    return panel.company_index(w.firm_years)


@query(
    "prj27_search_by_name",
    f"{YEARS} select distinct cik, name from fx_firm_year where lower(name) like '%r#00000001%' order by name, cik limit 15",
)
def _(w):
    return panel.search_companies(panel.company_index(w.firm_years), " meR#00000001 ")


@query("prj27_search_by_cik", f"{YEARS} select distinct cik, name from fx_firm_year where cik = 77")
def _(w):
    return panel.search_companies(panel.company_index(w.firm_years), "77")


@query(
    "so5_latest_filing",
    f"""{YEARS} select cik, doc_id, fyear from fx_firm_year
    qualify row_number() over (partition by cik order by fyear desc, reporting_date desc, doc_id) = 1""",
)
def _(w):
    return panel.latest_filing(w.firm_years).select("cik", "doc_id", "fyear")


@query("so5_filing_of_year", f"{YEARS} select cik, doc_id from fx_firm_year where fyear = 1999")
def _(w):
    return panel.filing_of_year(w.firm_years, 1999).select("cik", "doc_id")


@query("so6_sorted_ciks", "select distinct o_custkey as cik from orders where o_custkey is not null")
def _(w):
    return panel.sorted_ciks(w.table("orders").withColumnRenamed("o_custkey", "cik"))


@query(
    "so4_first_rows",
    f"{YEARS} select doc_id, total_assets from fx_firm_year order by total_assets desc, doc_id limit 50",
)
def _(w):
    ranked = w.firm_years.select("doc_id", "total_assets", (-F.col("total_assets")).alias("_o"))
    return panel.first_rows(ranked, 50, ["_o", "doc_id"]).drop("_o")


@query(
    "st1_stacked_sources",
    """select cast(o_orderkey as varchar) as id, o_totalprice as amount, cast(null as varchar) as lang from orders
    union all select concat('d', cast(doc_id as varchar)), null, lang from documents""",
)
def _(w):
    orders = w.table("orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_totalprice").alias("amount")
    )
    docs = w.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "lang")
    return orders.unionByName(docs, allowMissingColumns=True)


@query(
    "src12_normalise_scoring_input",
    """select cik, fyear, reporting_date, concat(cast(cik as varchar), '_', strftime(reporting_date, '%Y-%m-%d')) as doc_id,
    cast(cik as varchar) as name, 0 as label, length(mda) as n from (select doc_id % 500 as cik,
      make_date(cast(1990 + doc_id % 30 as int), cast(1 + doc_id % 12 as int), cast(1 + doc_id % 28 as int)) as reporting_date,
      cast(1990 + doc_id % 30 as int) as fyear, text as mda from documents)""",
)
def _(w):
    d = F.col("doc_id")
    day = F.make_date((1990 + d % 30).cast("int"), (1 + d % 12).cast("int"), (1 + d % 28).cast("int"))
    raw = w.documents.select(
        F.concat((d % 500).cast("string"), F.lit(".0")).alias(" CIK "),
        # Two date styles in one column.
        F.when(d % 2 == 0, F.date_format(day, "yyyy-MM-dd"))
        .otherwise(F.date_format(day, "dd-MM-yyyy"))
        .alias("Reporting_Date"),
        F.col("text").alias("Text"),
    )
    out = panel.normalise_scoring_input(raw)
    return out.select("cik", "fyear", "reporting_date", "doc_id", "name", "label", F.length("mda").alias("n"))


@query(
    "src12_json_scoring_input",
    f"{YEARS} select doc_id, cik, fyear, name, sic, cast(total_assets as bigint) as total_assets, 0 as label from fx_firm_year",
)
def _(w):
    """Lists of several firms in one file each, and files with one object."""
    path = scratch(w, "firms") + ".json"
    fields = F.to_json(F.struct("doc_id", "cik", "fyear", "name", "sic", "total_assets"))
    rows = w.stored_firm_years.select("cik", fields.alias("j"))
    single = F.col("cik") % 100 == 1
    lists = rows.where(~single).groupBy(F.floor(F.col("cik") / 20)).agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list("j"), ",\n"), F.lit("]")).alias("value"))
    for part in (lists.select("value"), rows.where(single).select(F.col("j").alias("value"))):
        spread(part).write.option("maxRecordsPerFile", 1).mode("append").text(path)
    out = jobs.read_scoring_input(w.spark, path)
    return out.select("doc_id", "cik", "fyear", "name", F.col("sic").cast("int").alias("sic"), F.col("total_assets").cast("long").alias("total_assets"), "label")
