"""From raw tables to a decile table: label, look-back counts, ratios, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.evaluation import rounded
from catalog.features import _pct_sql, _ratio_cte
from catalog.fixtures import MARKING, MIN_FYEAR
from catalog.labels import _COUNTS, HEAD, training_rows
from catalog.registry import query
from filingrisk.operators import panel, ratios
from filingrisk.operators.evaluation import decile_table
from filingrisk.operators.events import add_event_features
from filingrisk.session import materialise

_SQL = f"""{HEAD}, kept as (select * from train_rows where fyear >= {MIN_FYEAR} and total_assets is not null),
counts as ({_COUNTS.format(rows='kept', days=365, extra='')}),
{_ratio_cte('kept')},{_pct_sql('r')},
scored as (select cik * 10000 + fyear as row_id, label_default as y,
  (coalesce(fin_leverage_sic_pct, 0.5e0) + least(evt_n_8k, 10)/10.0e0) / 2 as p from q join counts using (doc_id)),
rk as (select *, row_number() over (order by p, row_id) as rn, count(*) over () as n_all, sum(y) over () as y_all from scored),
b as (select *, 10 - greatest(cast(ceil((rn-1)*10.0e0/(n_all-1)) as int) - 1, 0) as decile from rk),
g as (select decile, count(*) as n, cast(sum(y) as bigint) as events, avg(p) as avg_score, any_value(y_all) as y_all, any_value(n_all) as n_all
  from b group by decile)
select decile, n, events, round(avg_score, 7) as avg_score, round(events*1.0e0/n, 7) as event_rate,
  round((events*1.0e0/n)/(y_all*1.0e0/n_all), 7) as lift, round(sum(events) over (order by decile)*1.0e0/y_all, 7) as cum_capture from g"""


@query("flagship_risk_deciles", _SQL)
def flagship(w):
    """Default-label sample, ranked by industry leverage and event count."""
    # The feature steps read the sample several times, the ranking the scores.
    rows = materialise(panel.require_financials(panel.from_year(training_rows(w), MIN_FYEAR)))
    levels, _ = ratios.add_financial_features(rows, include_trends=False, include_missing=False)
    table, _ = add_event_features(levels, w.events, **MARKING)
    leverage = F.coalesce("fin_leverage_sic_pct", F.lit(0.5))
    filings = F.least(F.col("evt_n_8k"), F.lit(10)) / 10.0
    scored = materialise(table.select(
        (F.col("cik") * 10000 + F.col("fyear")).alias("row_id"),
        F.col("label_default").alias("y"),
        ((leverage + filings) / 2).alias("p"),
    ))
    measures = ("avg_score", "event_rate", "lift", "cum_capture")
    return rounded(decile_table(scored), measures, 7)
