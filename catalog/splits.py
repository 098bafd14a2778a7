"""Train/test splits, rolling folds, calibration folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.fixtures import with_views
from catalog.labels import HEAD, training_rows
from catalog.registry import query
from filingrisk.operators import splits, training

YEARS = with_views("fx_firm_year")
PRED = with_views("fx_pred")


def unit_sql(seed: int, *keys: str) -> str:
    text = ", ".join(f"cast({k} as varchar)" for k in keys)
    return f"(cast(concat('0x', substr(md5(concat_ws('|', '{seed}', {text})), 1, 12)) as bigint) / cast(281474976710656 as double))"


@query(
    "wn5_sp1_temporal_split",
    f"""{YEARS}, y as (select fyear, count(*) as n from fx_firm_year group by fyear),
    c as (select fyear, coalesce(sum(n) over (order by fyear desc rows between unbounded preceding and 1 preceding), 0) as newer,
      sum(n) over () as n_all from y)
    select doc_id, fyear >= (select min(fyear) from c where newer < 0.2e0*n_all) as is_test from fx_firm_year""",
)
def _(w):
    return splits.temporal_split(w.firm_years).select("doc_id", "is_test")


@query(
    "sp2_group_split",
    f"""{YEARS}, g as (select cik, row_number() over (order by {unit_sql(42, 'cik')}) as rn, count(*) over () as n
      from (select distinct cik from fx_firm_year))
    select doc_id, rn <= ceil(0.2e0*n) as is_test from fx_firm_year join g using (cik)""",
)
def _(w):
    return splits.group_split(w.firm_years).select("doc_id", "is_test")


@query(
    "sp3_stratified_split",
    f"""{PRED}, r as (select row_id, y, row_number() over (partition by y order by {unit_sql(7, 'row_id')}) as rn,
      count(*) over (partition by y) as n from fx_pred)
    select row_id, rn <= round(0.25e0*n) as is_test from r""",
)
def _(w):
    out = splits.stratified_split(
        w.predictions, label_col="y", row_id="row_id", test_size=0.25, seed=7
    )
    return out.select("row_id", "is_test")


@query(
    "sp4_auto_split",
    f"""{HEAD}, y as (select fyear, count(*) as n from train_rows group by fyear),
    c as (select fyear, coalesce(sum(n) over (order by fyear desc rows between unbounded preceding and 1 preceding), 0) as newer,
      sum(n) over () as n_all from y)
    select doc_id, 'temporal' as strategy, fyear >= (select min(fyear) from c where newer < 0.2e0*n_all) as is_test from train_rows""",
)
def _(w):
    out, strategy = splits.smart_split(training_rows(w), label_col="label_default")
    return out.select("doc_id", "is_test", F.lit(strategy).alias("strategy"))


_FOLDS = """y as (select fyear, count(*) as n, sum(label_default) as p from train_rows group by fyear),
 u as (select list_sort(list(fyear)) as ys from y),
 cut as (select unnest(range(ys[{k}], ys[len(ys)] - {w} + 1, {s})) as cutoff from u where len(ys) >= {k} + {w}),
 f as (select cutoff, sum(n) filter (fyear <= cutoff) as n_train, sum(n) filter (fyear > cutoff and fyear <= cutoff + {w}) as n_test,
   sum(p) filter (fyear <= cutoff) as positives_train, sum(p) filter (fyear > cutoff and fyear <= cutoff + {w}) as positives_test,
   string_agg(cast(fyear as varchar), ',' order by fyear) filter (fyear > cutoff and fyear <= cutoff + {w}) as test_years
   from cut, y group by cutoff)
 select cast(cutoff as int) as cutoff, test_years, cast(n_train as bigint) as n_train, cast(n_test as bigint) as n_test,
   cast(positives_train as bigint) as positives_train, cast(positives_test as bigint) as positives_test
 from f where positives_train > 0 and positives_test > 0 and positives_train < n_train and positives_test < n_test
   and positives_train >= {mt} and positives_test >= 1"""


@query("sp5_wn8_rolling_folds", f"{HEAD},{_FOLDS.format(k=3, w=1, s=1, mt=1)}")
def _(w):
    out = splits.rolling_folds(
        training_rows(w),
        label_col="label_default",
        test_window_years=1,
        step_years=1,
        min_train_years=3,
        min_train_positives=1,
    )
    years = F.array_join(F.transform("test_years", lambda y: y.cast("string")), ",")
    return out.withColumn("test_years", years)


@query(
    "sp5_fold_rows",
    f"""{YEARS}, cut as (select unnest([1997, 1999]) as cutoff)
    select doc_id, cast(cutoff as int) as cutoff, case when fyear <= cutoff then 'train' else 'test' end as role
    from fx_firm_year, cut where fyear <= cutoff + 2""",
)
def _(w):
    out = splits.tag_fold_rows(w.firm_years, [{"cutoff": 1997}, {"cutoff": 1999}])
    return out.select("doc_id", "cutoff", "role")


@query(
    "sp6_calibration_folds",
    f"{PRED} select row_id, cast(floor({unit_sql(43, 'cik')} * 3) as int) as cal_fold from fx_pred",
)
def _(w):
    out, _k, _whole = splits.calibration_folds(w.predictions, label_col="y", row_id="row_id")
    return out.select("row_id", "cal_fold")


@query(
    "ag11_exact_medians",
    f"""{YEARS} select feature, median(v) as median from (unpivot (select cast(total_assets as double) as total_assets, cast(cash as double) as cash,
      cast(equity as double) as equity, cast(net_income as double) as net_income from fx_firm_year where fyear < 2000)
      on total_assets, cash, equity, net_income into name feature value v) group by feature""",
)
def _(w):
    train = w.firm_years.where("fyear < 2000")
    return training.feature_medians(train, ["total_assets", "cash", "equity", "net_income"])


@query(
    "ag13_class_weights",
    f"""{PRED} select y as label, count(*) as n, round((select count(*) from fx_pred)/(2.0e0*count(*)), 9) as weight from fx_pred group by y""",
)
def _(w):
    return training.class_weights(w.predictions, "y").withColumn("weight", F.round("weight", 9))
