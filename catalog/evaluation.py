"""Evaluation tables over scored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.fixtures import with_views
from catalog.registry import query
from filingrisk.operators import bootstrap, evaluation

PRED = with_views("fx_pred")
N_BOOT = 500


def bundle_sql(source: str, by: str = "", digits: int = 8) -> str:
    """Metric bundle of (by, y, p) rows by running sums over distinct scores."""
    key = f"{by}, " if by else ""
    part = f"partition by {by} " if by else ""
    using = f"using ({by})" if by else "on true"
    group = f"group by {by}" if by else ""
    return f"""
    d as (select {key}p, sum(y) as pos, sum(1-y) as neg from {source} group by {key}p),
    c as (select *, sum(pos) over ({part}order by p desc) as tp, sum(neg) over ({part}order by p desc) as fp from d),
    a as (select {key}sum(neg*(tp - pos/2.0e0)) as area, sum(pos*tp*1.0e0/(tp+fp)) as ap from c {group}),
    s as (select {key}count(*) as n, cast(coalesce(sum(y), 0) as bigint) as positives, avg(cast(y as double)) as base_rate,
      avg((p-y)*(p-y)) as brier from {source} {group}),
    m as (select {('s.' + by + ', ') if by else ''}n, positives, round(base_rate, {digits}) as base_rate, round(brier, {digits}) as brier,
      case when base_rate > 0 and base_rate < 1 then round(1 - brier/(base_rate*(1-base_rate)), {digits}) end as brier_skill,
      case when positives > 0 and positives < n then round(area/(cast(positives as double)*(n-positives)), {digits}) end as roc_auc,
      case when positives > 0 and positives < n then round(ap/positives, {digits}) end as pr_auc
      from s join a {using})"""


def rounded(df, names, digits=8):
    return df.withColumns({n: F.round(n, digits) for n in names})


_METRICS = ("base_rate", "brier", "brier_skill", "roc_auc", "pr_auc")


@query("ev5_metric_bundle", f"{PRED},{bundle_sql('fx_pred')} select * from m")
def _(w):
    return rounded(evaluation.metric_bundle(w.predictions), _METRICS)


@query("ev5_metrics_by_fold", f"{PRED},{bundle_sql('fx_pred', 'fold')} select * from m")
def _(w):
    return rounded(evaluation.metric_bundle(w.predictions, ["fold"]), _METRICS)


@query("ev3_roc_auc_by_firm", f"{PRED},{bundle_sql('fx_pred', 'cik')} select cik, n, roc_auc from m")
def _(w):
    out = evaluation.metric_bundle(w.predictions, ["cik"])
    return rounded(out, ["roc_auc"]).select("cik", "n", "roc_auc")


@query("ev4_average_precision", f"""{PRED}, q as (select row_id, cik, y, p_b as p from fx_pred),
{bundle_sql('q')} select n, positives, pr_auc from m""")
def _(w):
    out = evaluation.metric_bundle(w.predictions, score="p_b")
    return rounded(out, ["pr_auc"]).select("n", "positives", "pr_auc")


@query(
    "ev1_ev2_brier_skill",
    f"""{PRED} select fold, round(avg((p-y)*(p-y)), 8) as brier,
    round(1 - avg((p-y)*(p-y)) / avg((0.2e0-y)*(0.2e0-y)), 8) as brier_skill from fx_pred group by fold""",
)
def _(w):
    out = evaluation.brier_skill(w.predictions, ["fold"], reference=0.2)
    return rounded(out, ["brier", "brier_skill"])


def _top_k_sql(by: str, score: str = "p") -> str:
    part = f"partition by {by} " if by else ""
    key = f"{by}, " if by else ""
    return f"""fr(fraction) as (values (0.1e0), (0.3e0)),
    r as (select *, row_number() over ({part}order by {score} desc, row_id) as rn,
      count(*) over ({part.strip()}) as n_all, sum(y) over ({part.strip()}) as y_all from fx_pred),
    k as (select r.*, fraction, greatest(1, cast(round_even(fraction * n_all, 0) as bigint)) as k from r, fr),
    t as (select {key}fraction, any_value(k) as k, cast(sum(y) as bigint) as events, any_value(y_all) as y_all, any_value(n_all) as n_all
      from k where rn <= k group by {key}fraction)
    select {key}fraction, k, events, round(events*1.0e0/y_all, 8) as capture, round(events*1.0e0/k, 8) as precision,
      round((events*1.0e0/k)/(y_all*1.0e0/n_all), 8) as lift from t"""


_TOPK = ("capture", "precision", "lift")


@query("ev6_wn7_top_k_capture", f"{PRED},{_top_k_sql('')}")
def _(w):
    return rounded(evaluation.top_k_capture(w.predictions), _TOPK)


@query("wn7_top_k_by_fold", f"{PRED},{_top_k_sql('fold', 'p_b')}")
def _(w):
    return rounded(evaluation.top_k_capture(w.predictions, ["fold"], score="p_b"), _TOPK)


@query(
    "wn7_top_k_constant_score",
    f"""{PRED} select fraction, greatest(1, cast(round_even(fraction * n, 0) as bigint)) as k, cast(null as bigint) as events,
    fraction as capture, round(base, 8) as "precision", 1.0e0 as lift
    from (select count(*) as n, avg(cast(y as double)) as base from fx_pred), (values (0.1e0), (0.3e0)) t(fraction)""",
)
def _(w):
    flat = evaluation.with_null_model(w.predictions)
    return rounded(evaluation.top_k_capture(flat, score="p_null"), _TOPK)


def _decile_sql(by: str) -> str:
    part = f"partition by {by} " if by else ""
    key = f"{by}, " if by else ""
    return f"""r as (select *, row_number() over ({part}order by p, row_id) as rn, count(*) over ({part.strip()}) as n_all,
      sum(y) over ({part.strip()}) as y_all from fx_pred),
    b as (select *, 10 - greatest(cast(ceil((rn-1)*10.0e0/(n_all-1)) as int) - 1, 0) as decile from r),
    g as (select {key}decile, count(*) as n, cast(sum(y) as bigint) as events, avg(p) as avg_score, any_value(y_all) as y_all,
      any_value(n_all) as n_all from b group by {key}decile)
    select {key}decile, n, events, round(avg_score, 8) as avg_score, round(events*1.0e0/n, 8) as event_rate,
      round((events*1.0e0/n)/(y_all*1.0e0/n_all), 8) as lift,
      round(sum(events) over ({part}order by decile)*1.0e0/y_all, 8) as cum_capture from g"""


_DEC = ("avg_score", "event_rate", "lift", "cum_capture")


@query("ev8_wn6_deciles", f"{PRED},{_decile_sql('')}")
def _(w):
    return rounded(evaluation.decile_table(w.predictions), _DEC)


@query("wn6_deciles_by_fold", f"{PRED},{_decile_sql('fold')}")
def _(w):
    return rounded(evaluation.decile_table(w.predictions, ["fold"]), _DEC)


@query(
    "ev7_reliability",
    f"""{PRED}, e as (select *, {' + '.join(f'cast(p > {i * 0.1!r} as int)' for i in range(1, 10)).replace('> 0.', '> 0.')} + 1 as bin from fx_pred)
    select fold, bin, round((bin-1)*0.1e0, 8) as p_lo, round(bin*0.1e0, 8) as p_hi, count(*) as n, round(avg(p), 8) as avg_p,
    round(avg(cast(y as double)), 8) as event_rate from e group by fold, bin""",
)
def _(w):
    out = evaluation.reliability_table(w.predictions, ["fold"])
    return rounded(out, ("p_lo", "p_hi", "avg_p", "event_rate"))


@query(
    "ev7_reliability_null_scores",
    f"""{PRED}, e as (select *, {' + '.join(f'cast(p > {i * 0.1!r} as int)' for i in range(1, 10)).replace('> 0.', '> 0.')} + 1 as bin
      from fx_pred where row_id % 4 <> 0)
    select bin, count(*) as n, round(avg(p), 8) as avg_p, round(avg(cast(y as double)), 8) as event_rate from e group by bin""",
)
def _(w):
    gaps = w.predictions.withColumn("p", F.when(F.col("row_id") % 4 != 0, F.col("p")))
    out = evaluation.reliability_table(gaps).select("bin", "n", "avg_p", "event_rate")
    return rounded(out, ("avg_p", "event_rate"))


@query(
    "ev2_brier_skill_null_scores",
    f"""{PRED}, s as (select avg((p-y)*(p-y)) as b, avg(cast(y as double)) as r from fx_pred where row_id % 4 <> 0)
    select round(b, 8) as brier, round(1 - b/(r*(1-r)), 8) as brier_skill from s""",
)
def _(w):
    gaps = w.predictions.withColumn("p", F.when(F.col("row_id") % 4 != 0, F.col("p")))
    return rounded(evaluation.brier_skill(gaps), ("brier", "brier_skill"))


_OVERLAP = """s as (select cik, bool_or(is_train) as tr, bool_or(not is_train) as te from fx_pred where cik is not null group by cik)
select count(*) filter (tr) as n_train_firms, count(*) filter (te) as n_test_firms, count(*) filter (tr and te) as n_overlap_firms,
  count(*) filter (te and not tr) as n_new_test_firms,
  round(count(*) filter (tr and te)*1.0e0/count(*) filter (te), 8) as overlap_rate from s"""


@query("ev11_st2_firm_overlap", f"{PRED},{_OVERLAP}")
def _(w):
    sides = w.predictions.withColumn("is_test", ~F.col("is_train"))
    return rounded(evaluation.firm_overlap(sides), ["overlap_rate"])


_NEW = "fresh as (select * from fx_pred where not is_train and cik not in (select cik from fx_pred where is_train and cik is not null))"


@query("jn7_new_firm_rows", f"{PRED},{_NEW} select row_id, cik, y from fresh")
def _(w):
    p = w.predictions
    return evaluation.new_firm_rows(p.where("not is_train"), p.where("is_train")).select("row_id", "cik", "y")


@query("ev13_new_firm_metrics", f"{PRED},{_NEW},{bundle_sql('fresh')} select * from m")
def _(w):
    p = w.predictions
    out = evaluation.new_firm_metrics(p.where("not is_train"), p.where("is_train"))
    return rounded(out, _METRICS)


@query(
    "ev12_null_model",
    f"""{PRED}, q as (select row_id, fold, y, avg(cast(y as double)) over (partition by fold) as p from fx_pred),
    {bundle_sql('q', 'fold')} select fold, n, positives, base_rate, brier, roc_auc from m""",
)
def _(w):
    flat = evaluation.with_null_model(w.predictions, ["fold"])
    out = evaluation.metric_bundle(flat, ["fold"], score="p_null")
    return rounded(out, _METRICS).drop("brier_skill", "pr_auc")


_DIGEST = """select fold, count(*) as n_ids, sha1(concat_ws('|', cast(count(*) as varchar), cast(bit_xor(h) as varchar), cast(sum(h) as varchar))) as fingerprint
from (select fold, cast(concat('0x', substr(md5(cast(row_id as varchar)), 1, 15)) as bigint) as h from fx_pred) group by fold"""


@query("ag12_id_fingerprint", f"{PRED} {_DIGEST}")
def _(w):
    return evaluation.id_fingerprint(w.predictions, "row_id", ["fold"])


@query(
    "ag14_mean_of_folds",
    f"{PRED},{bundle_sql('fx_pred', 'fold')} select round(avg(roc_auc), 7) as mean_roc_auc, round(avg(brier), 7) as mean_brier from m",
)
def _(w):
    folds = rounded(evaluation.metric_bundle(w.predictions, ["fold"]), _METRICS)
    return rounded(
        evaluation.mean_of_folds(folds, ["roc_auc", "brier"]), ["mean_roc_auc", "mean_brier"], 7
    )


@query(
    "ev15_models_side_by_side",
    f"""{PRED}, q as (select row_id, y, 'p' as model, p from fx_pred union all select row_id, y, 'p_b', p_b from fx_pred),
    {bundle_sql('q', 'model')} select * from m""",
)
def _(w):
    long = evaluation.melt_scores(w.predictions, ["p", "p_b"], ["row_id", "y"])
    return rounded(evaluation.metric_bundle(long, ["model"]), _METRICS)


def _draw_sql(seed: int, n_boot: int) -> str:
    return f"""firms as (select cik, row_number() over (order by cik) - 1 as i, count(*) over () as k from (select distinct cik from fx_pred)),
    draws as (select rep, cast(floor((cast(concat('0x', substr(md5(concat_ws('|', '{seed}', cast(rep as varchar), cast(i as varchar))), 1, 12)) as bigint)
        / cast(281474976710656 as double)) * k) as bigint) as i
      from firms, range(1, {n_boot} + 1) t(rep)),
    w as (select rep, cik, count(*) as w from draws join firms using (i) group by rep, cik
      union all select 0, cik, 1 from firms)"""


def _boot_sql(score: str) -> str:
    return f"""d as (select rep, {score} as p, sum(w*y) as pos, sum(w*(1-y)) as neg from fx_pred join w using (cik) group by rep, {score}),
    c as (select *, sum(pos) over (partition by rep order by p desc) as tp, sum(neg) over (partition by rep order by p desc) as fp from d),
    a as (select rep, cast(sum(pos) as double) as np, cast(sum(neg) as double) as nn, sum(neg*(tp - pos/2.0e0)) as area,
      sum(pos*tp*1.0e0/(tp+fp)) as ap, sum(pos*(1-p)*(1-p) + neg*p*p) as sq from c group by rep)"""


_BOOT_VALUES = """v as (select rep, 'roc_auc' as metric, area/(np*nn) as value from a
    union all select rep, 'pr_auc', ap/np from a union all select rep, 'brier', sq/(np+nn) from a
    union all select rep, 'brier_skill', 1 - (sq/(np+nn))/((np/(np+nn))*(nn/(np+nn))) from a)"""
_CI = """select metric, round(max(value) filter (rep = 0), 8) as point, round(quantile_cont(value, 0.025) filter (rep > 0), 8) as ci_low,
    round(quantile_cont(value, 0.975) filter (rep > 0), 8) as ci_high from v group by metric"""
_CIS = ("point", "ci_low", "ci_high")


@query(
    "ev9_cluster_bootstrap",
    f"{PRED},{_draw_sql(42, N_BOOT)},{_boot_sql('p')},{_BOOT_VALUES} {_CI}",
)
def _(w):
    out = bootstrap.cluster_bootstrap_ci(w.predictions, n_boot=N_BOOT)
    return rounded(out, _CIS).drop("n_boot")


@query(
    "ev10_bootstrap_delta",
    f"""{PRED},{_draw_sql(42, N_BOOT)},{_boot_sql('p')},
    va as (select rep, area/(np*nn) as va from a),
    {_boot_sql('p_b').replace('d as', 'd2 as').replace('from d)', 'from d2)').replace('c as (', 'c2 as (').replace('from c group', 'from c2 group').replace('a as (select rep, cast', 'a2 as (select rep, cast')},
    v as (select rep, 'roc_auc' as metric, va - area/(np*nn) as value from a2 join va using (rep)) {_CI}""",
)
def _(w):
    out = bootstrap.cluster_bootstrap_delta(w.predictions, "p", "p_b", n_boot=N_BOOT)
    return rounded(out, _CIS).drop("n_boot")


def _poisson_sql(seed: int, n_boot: int) -> str:
    """Weights from the same hash: how many cumulative Poisson(1) terms it reaches."""
    steps, term, total = [], 0.36787944117144233, 0.0
    for k in range(18):
        total += term
        steps.append(f"cast(u >= {total!r} as int)")
        term /= k + 1
    return f"""u as (select rep, cik, cast(concat('0x', substr(md5(concat_ws('|', '{seed}', cast(rep as varchar), cast(cik as varchar))), 1, 12)) as bigint)
        / cast(281474976710656 as double) as u from (select distinct cik from fx_pred), range(1, {n_boot} + 1) t(rep)),
    w as (select rep, cik, {" + ".join(steps)} as w from u union all select 0, cik, 1 from (select distinct cik from fx_pred))"""


@query(
    "ev9_poisson_bootstrap",
    f"""{PRED},{_poisson_sql(42, N_BOOT)},{_boot_sql('p')},
    v as (select rep, 'roc_auc' as metric, area/(np*nn) as value from a union all select rep, 'gini', 2*(area/(np*nn)) - 1 from a) {_CI}""",
)
def _(w):
    out = bootstrap.cluster_bootstrap_ci(
        w.predictions,
        n_boot=N_BOOT,
        method="poisson",
        metrics={"roc_auc": "roc_auc", "gini": 2 * F.col("roc_auc") - 1},
    )
    return rounded(out, _CIS).drop("n_boot")
