"""Labels, event flags and look-back counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.fixtures import HORIZON, MARKING, MIN_FYEAR, with_views
from catalog.registry import query
from filingrisk.operators import events as ev
from filingrisk.operators import labels, panel
from filingrisk.sources.enforcement import tidy_enforcement

CODES = """
codes as (select *, list_filter(list_transform(string_split(items, ','), lambda x: trim(x)), lambda x: x <> '') as c from fx_events)
"""
NEW = "filing_date_8k >= date '1998-01-01'"
FLAGS = f"""
marked as (select cik, filing_date_8k, items, accession,
  ({NEW} and list_contains(c,'1.03')) as is_bankruptcy,
  ({NEW} and list_contains(c,'4.01')) as is_auditor_change,
  ({NEW} and list_contains(c,'5.02')) as is_officer_departure,
  ({NEW} and list_contains(c,'2.04')) as is_covenant_accel,
  ({NEW} and list_contains(c,'2.06')) as is_impairment,
  ({NEW} and list_contains(c,'3.01')) as is_delisting,
  ({NEW} and list_contains(c,'4.02')) as is_restatement from codes)
"""
FLAGS_LEGACY = f"""
marked as (select cik, filing_date_8k, items, accession,
  (({NEW} and list_contains(c,'1.03')) or (not {NEW} and list_contains(c,'3'))) as is_bankruptcy,
  (({NEW} and list_contains(c,'4.01')) or (not {NEW} and list_contains(c,'4'))) as is_auditor_change,
  (({NEW} and list_contains(c,'5.02')) or (not {NEW} and list_contains(c,'6'))) as is_officer_departure,
  ({NEW} and list_contains(c,'2.04')) as is_covenant_accel,
  ({NEW} and list_contains(c,'2.06')) as is_impairment,
  ({NEW} and list_contains(c,'3.01')) as is_delisting,
  ({NEW} and list_contains(c,'4.02')) as is_restatement from codes)
"""
BANKRUPT = "bk as (select cik, min(filing_date_8k) as bankruptcy_date from marked where is_bankruptcy group by cik)"
TRAIN_LABEL = f"""
labelled as (select f.*, cast(coalesce(reporting_date < bankruptcy_date
    and bankruptcy_date <= cast(reporting_date + interval {HORIZON} month as date), false) as int) as label_default
  from fx_firm_year f left join bk using (cik)
  where bankruptcy_date is null or reporting_date < bankruptcy_date),
train_rows as (select * from labelled where label_default = 1
  or cast(reporting_date + interval {HORIZON} month as date) <= (select max(filing_date_8k) from fx_events))
"""
HEAD = f"{with_views('fx_firm_year', 'fx_events')},{CODES},{FLAGS},{BANKRUPT},{TRAIN_LABEL}"


def training_rows(world):
    """Firm-years with the default label, censored and post-bankruptcy rows gone."""
    return labels.attach_default_labels(
        world.firm_years, world.events, horizon_months=HORIZON, **MARKING
    )


def enforcement_windows(world):
    """Enforcement rows the way the CSV states them: month strings."""
    return world.enforcement.select(
        F.col("cik").cast("string").alias("cik"),
        F.date_format("m0", "MM-yyyy").alias("fraud_start"),
        F.date_format(F.add_months("m0", 5), "MM-yyyy").alias("fraud_end"),
        F.col("fsf").cast("string").alias("fsf"),
        F.col("revoked").cast("string").alias("revoked"),
    )


_WINDOWS = """
win as (select cik, m0 as fraud_start, cast(m0 + interval 6 month - interval 1 day as date) as fraud_end, fsf, revoked from fx_aaer)
"""


@query(
    "src3_enforcement_windows",
    f"{with_views('fx_aaer')},{_WINDOWS} select cik, fraud_start, fraud_end, fsf, revoked from win",
)
def _(w):
    return tidy_enforcement(enforcement_windows(w))


_FRAUD = """select f.doc_id, f.cik, f.reporting_date, cast(exists(select 1 from win a where a.cik = f.cik {where}
  and a.fraud_start <= f.reporting_date
  and a.fraud_end >= cast(f.reporting_date - interval 1 year + interval 1 day as date)) as int) as label
from fx_firm_year f"""


@query(
    "lbl1_fraud_label",
    f"{with_views('fx_firm_year', 'fx_aaer')},{_WINDOWS}"
    + _FRAUD.format(where="and a.revoked <> 1 and a.fsf = 1"),
)
def _(w):
    out = labels.attach_fraud_labels(w.firm_years, tidy_enforcement(enforcement_windows(w)))
    return out.select("doc_id", "cik", "reporting_date", "label")


@query(
    "jn2_overlap_all_windows",
    f"{with_views('fx_firm_year', 'fx_aaer')},{_WINDOWS}" + _FRAUD.format(where=""),
)
def _(w):
    out = labels.attach_fraud_labels(
        w.firm_years,
        tidy_enforcement(enforcement_windows(w)),
        require_fsf=False,
        drop_revoked=False,
    )
    return out.select("doc_id", "cik", "reporting_date", "label")


@query(
    "ag1_fraud_base_rate",
    f"{with_views('fx_firm_year', 'fx_aaer')},{_WINDOWS}, lab as ("
    + _FRAUD.format(where="and a.revoked <> 1 and a.fsf = 1")
    + """) select count(*) as n, cast(sum(label) as bigint) as positives,
    round(avg(cast(label as double)), 9) as base_rate, count(distinct cik) as n_firms from lab""",
)
def _(w):
    out = labels.attach_fraud_labels(w.firm_years, tidy_enforcement(enforcement_windows(w)))
    return panel.sample_counts(out, "label").withColumn("base_rate", F.round("base_rate", 9))


@query(
    "prj19_item_codes",
    f"{with_views('fx_events')},{CODES} select accession, array_to_string(list_distinct_sorted, '|') as codes from "
    "(select accession, list_sort(list_distinct(c)) as list_distinct_sorted from codes)",
)
def _(w):
    codes = F.array_sort(ev.item_codes(F.col("items")))
    return w.events.select("accession", F.array_join(codes, "|").alias("codes"))


@query("prj21_mark_concepts", f"{with_views('fx_events')},{CODES},{FLAGS} select * from marked")
def _(w):
    return ev.mark_concepts(w.events, **MARKING)


@query(
    "prj20_mark_concepts_legacy",
    f"{with_views('fx_events')},{CODES},{FLAGS_LEGACY} select * from marked",
)
def _(w):
    return ev.mark_concepts(w.events, **{**MARKING, "trust_legacy_regime": True})


@query(
    "ag2_bankruptcy_dates",
    f"{with_views('fx_events')},{CODES},{FLAGS},{BANKRUPT} select * from bk",
)
def _(w):
    return ev.bankruptcy_dates(w.events, **MARKING)


@query(
    "ag4_item_coverage",
    f"""{with_views('fx_events')} select cast(floor(year(filing_date_8k)/10)*10 as int) as decade, count(*) as n_filings,
    avg(case when length(trim(items)) > 0 then 1.0e0 else 0.0e0 end) as share_with_items from fx_events group by 1""",
)
def _(w):
    return ev.item_coverage(w.events)


@query(
    "lbl2_annotate_default",
    f"""{with_views('fx_firm_year', 'fx_events')},{CODES},{FLAGS},{BANKRUPT}
    select doc_id, f.cik, bankruptcy_date, cast(coalesce(reporting_date < bankruptcy_date
      and bankruptcy_date <= cast(reporting_date + interval {HORIZON} month as date), false) as int) as label_default
    from fx_firm_year f left join bk using (cik)""",
)
def _(w):
    out = labels.annotate_default_labels(w.firm_years, w.events, horizon_months=HORIZON, **MARKING)
    return out.select("doc_id", "cik", "bankruptcy_date", "label_default")


@query("lbl3_training_default_label", f"{HEAD} select doc_id, cik, fyear, label_default from train_rows")
def _(w):
    return training_rows(w).select("doc_id", "cik", "fyear", "label_default")


@query(
    "lbl3_keep_censored",
    f"{HEAD} select doc_id, cik, fyear, label_default from labelled",
)
def _(w):
    out = labels.attach_default_labels(
        w.firm_years, w.events, horizon_months=HORIZON, drop_censored=False, **MARKING
    )
    return out.select("doc_id", "cik", "fyear", "label_default")


@query(
    "jn9_observation_end",
    f"""{HEAD} select doc_id, cast(reporting_date + interval {HORIZON} month as date) as horizon_end,
    (select max(filing_date_8k) from fx_events) as observed_to from fx_firm_year""",
)
def _(w):
    observed_to = w.events.agg(F.max("filing_date_8k")).scalar()
    return w.firm_years.select(
        "doc_id", F.add_months("reporting_date", HORIZON).alias("horizon_end")
    ).withColumn("observed_to", observed_to)


_COUNTS = """
select f.doc_id, cast(count(m.cik) as bigint) as evt_n_8k,
  cast(coalesce(sum(cast(is_auditor_change as int)),0) as bigint) as evt_n_auditor_change,
  cast(coalesce(sum(cast(is_officer_departure as int)),0) as bigint) as evt_n_officer_departure,
  cast(coalesce(sum(cast(is_covenant_accel as int)),0) as bigint) as evt_n_covenant_accel,
  cast(coalesce(sum(cast(is_impairment as int)),0) as bigint) as evt_n_impairment,
  cast(coalesce(sum(cast(is_delisting as int)),0) as bigint) as evt_n_delisting{extra}
from {rows} f left join marked m on m.cik = f.cik
  and m.filing_date_8k > coalesce(f.filing_date, f.reporting_date) - {days}
  and m.filing_date_8k <= coalesce(f.filing_date, f.reporting_date)
group by f.doc_id
"""
_RESTATED = ", cast(coalesce(sum(cast(is_restatement as int)),0) as bigint) as evt_n_restatement"


@query("jn4_event_lookback", HEAD + _COUNTS.format(rows="fx_firm_year", days=365, extra=""))
def _(w):
    out, names = ev.add_event_features(w.firm_years, w.events, **MARKING)
    return out.select("doc_id", *names)


@query(
    "ag3_event_counts_with_restatement",
    f"{with_views('fx_firm_year', 'fx_events')},{CODES},{FLAGS_LEGACY}"
    + _COUNTS.format(rows="fx_firm_year", days=730, extra=_RESTATED),
)
def _(w):
    out, names = ev.add_event_features(
        w.firm_years,
        w.events,
        window_days=730,
        include_restatement=True,
        **{**MARKING, "trust_legacy_regime": True},
    )
    return out.select("doc_id", *names)


@query(
    "train_sample_with_events",
    f"""{HEAD}, counts as ({_COUNTS.format(rows='train_rows', days=365, extra='')})
    select t.doc_id, t.cik, t.fyear, label_default, counts.* exclude (doc_id)
    from train_rows t join counts using (doc_id) where fyear >= {MIN_FYEAR} and total_assets is not null""",
)
def _(w):
    rows = panel.require_financials(panel.from_year(training_rows(w), MIN_FYEAR))
    out, names = ev.add_event_features(rows, w.events, **MARKING)
    return out.select("doc_id", "cik", "fyear", "label_default", *names)


@query(
    "prj22_min_year",
    f"{with_views('fx_firm_year')} select doc_id, fyear from fx_firm_year where fyear >= {MIN_FYEAR}",
)
def _(w):
    return panel.from_year(w.firm_years, MIN_FYEAR).select("doc_id", "fyear")


@query(
    "prj23_require_financials",
    f"{with_views('fx_firm_year')} select doc_id, equity from fx_firm_year where equity is not null",
)
def _(w):
    return panel.require_financials(w.firm_years, "equity").select("doc_id", "equity")


@query(
    "ag7_counts_by_year",
    f"""{HEAD} select fyear, count(*) as n, cast(sum(label_default) as bigint) as positives,
    round(avg(cast(label_default as double)), 9) as base_rate, count(distinct cik) as n_firms from train_rows group by fyear""",
)
def _(w):
    out = panel.sample_counts(training_rows(w), "label_default", ["fyear"])
    return out.withColumn("base_rate", F.round("base_rate", 9))


@query(
    "ag8_firm_count",
    f"{with_views('fx_events')} select count(distinct cik) as n_firms from fx_events",
)
def _(w):
    return w.events.agg(F.count_distinct("cik").alias("n_firms"))


@query(
    "ag9_financial_coverage",
    f"""{with_views('fx_firm_year')} select round(avg(case when current_liabilities is not null then 1.0e0 else 0.0e0 end), 9) as coverage
    from fx_firm_year""",
)
def _(w):
    out = panel.financial_coverage(w.firm_years, "current_liabilities")
    return out.withColumn("coverage", F.round("coverage", 9))
