"""Score arithmetic: combining, horizons, bands, look-up tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingrisk import policy
from filingrisk.functions.numeric import clamp

_EPS = 1e-6


@dataclass(frozen=True)
class EnsembleWeights:
    financial: float = policy.WEIGHT_FINANCIAL
    text: float = policy.WEIGHT_TEXT

    def normalised(self) -> tuple[float, float]:
        total = self.financial + self.text
        if total <= 0:
            raise ValueError("ensemble weights must sum to more than 0")
        return self.financial / total, self.text / total


def combine_probabilities(
    p_financial: Column,
    p_text: Column,
    weights: EnsembleWeights = EnsembleWeights(),
    *,
    method: str = "logit",
) -> Column:
    """Weighted mean of two probabilities, on the log-odds scale or plainly."""
    w_fin, w_txt = weights.normalised()
    if method == "mean":
        return F.lit(w_fin) * p_financial + F.lit(w_txt) * p_text
    if method != "logit":
        raise ValueError(f"unknown combination method {method!r}")

    def log_odds(p: Column) -> Column:
        inside = clamp(p, _EPS, 1.0 - _EPS)
        return F.log(inside / (F.lit(1.0) - inside))

    mixed = F.lit(w_fin) * log_odds(p_financial) + F.lit(w_txt) * log_odds(p_text)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-mixed))


def scale_pd(p: Column, *, from_months: int, to_months: int | Column) -> Column:
    """Probability over another horizon at constant hazard."""
    if from_months <= 0 or (isinstance(to_months, int) and to_months <= 0):
        raise ValueError("horizons must be positive")
    inside = clamp(p, 0.0, 1.0 - 1e-15)
    to = F.lit(to_months) if isinstance(to_months, int) else to_months
    scaled = F.lit(1.0) - F.pow(F.lit(1.0) - inside, to / F.lit(float(from_months)))
    return F.when(to == from_months, inside).otherwise(scaled)


def base_rate_over(base_rate_12m: float | None, months: int | Column) -> Column:
    rate = policy.BASE_RATE_12M if base_rate_12m is None else base_rate_12m
    horizon = max(1, months) if isinstance(months, int) else F.greatest(months, F.lit(1))
    return scale_pd(F.lit(float(rate)), from_months=12, to_months=horizon)


def base_rate_12m(base_rate: Column, model_months: int) -> Column:
    """A base rate over the model's horizon, restated for 12 months."""
    scaled = scale_pd(base_rate, from_months=model_months, to_months=12)
    return F.when(base_rate > 0, scaled).otherwise(base_rate)


def risk_band(
    score: Column,
    *,
    label_source: str = "fraud",
    months: int | Column = 12,
    base_rate: float | None = None,
    mid_mult: float = policy.BAND_MID_MULT,
    high_mult: float = policy.BAND_HIGH_MULT,
    names: tuple[str, str, str] | None = None,
) -> Column:
    """Band name: relative to the base rate for defaults, fixed cuts for fraud."""
    high_name, mid_name, low_name = names or policy.BAND_NAMES[
        "default" if label_source == "default" else "fraud"
    ]
    if label_source == "default":
        base = base_rate_over(base_rate, months)
        high, mid = F.lit(high_mult) * base, F.lit(mid_mult) * base
    else:
        high, mid = F.lit(policy.FRAUD_BAND_HIGH), F.lit(policy.FRAUD_BAND_MID)
    return F.when(score >= high, high_name).when(score >= mid, mid_name).otherwise(low_name)


def lift_over_base(score: Column, base_rate: float | None, months: int) -> Column:
    return F.try_divide(score, base_rate_over(base_rate, months))


def term_structure(
    scores: DataFrame,
    *,
    model_months: int,
    horizon_months: int | None = None,
    base_rate: float | None = None,
    score_col: str = "pd_score",
) -> DataFrame:
    """One row per score and horizon: window, probability and band."""
    grid = sorted({*policy.HORIZON_GRID, model_months, horizon_months or model_months})
    out = scores.withColumn("horizon_months", F.explode(F.array(*[F.lit(m) for m in grid])))
    months = F.col("horizon_months")
    pd = scale_pd(F.col(score_col), from_months=model_months, to_months=months)
    added = {"pd": pd}
    if "reporting_date" in scores.columns:
        added["window_start"] = F.col("reporting_date")
        added["window_end"] = F.add_months("reporting_date", months)
    out = out.withColumns(added)
    band = risk_band(F.col("pd"), label_source="default", months=months, base_rate=base_rate)
    return out.withColumn("band", band)


def wide_horizons(
    scores: DataFrame,
    *,
    model_months: int,
    horizon_months: int,
    score_col: str = "pd_score",
    months: Sequence[int] = policy.WIDE_HORIZONS,
) -> DataFrame:
    """Adds the chosen horizon's score and one `pd_<m>m` per standard horizon."""
    p = F.col(score_col)

    def over(m: int) -> Column:
        return scale_pd(p, from_months=model_months, to_months=m)

    return scores.withColumns(
        {
            "pd_score_model_h": F.lit(model_months),
            "pd_horizon_months": F.lit(horizon_months),
            "pd_score_horizon": over(horizon_months),
            **{f"pd_{m}m": over(m) for m in months},
        }
    )


def score_summary(scores: DataFrame, *, label_col: str, by: Sequence[str] = (), score_col: str = "pd_score") -> DataFrame:
    """Score mean, range, and for positives the mean score and their years."""
    positive = F.col(label_col) == 1
    return scores.groupBy(*by).agg(
        F.avg(score_col).alias("mean_score"),
        F.min(score_col).alias("min_score"),
        F.max(score_col).alias("max_score"),
        F.avg(F.when(positive, F.col(score_col))).alias("mean_positive_score"),
        # Distinct years, so the list is bounded by the calendar.
        F.array_sort(F.collect_set(F.when(positive, F.col("fyear")))).alias("positive_years"),
    )


def backfill_brier_skill(metrics: DataFrame) -> DataFrame:
    """brier_skill from stored brier and base_rate where it is missing."""
    base = F.col("base_rate")
    derived = F.when(
        (base > 0) & (base < 1), F.lit(1.0) - F.col("brier") / (base * (F.lit(1.0) - base))
    )
    stored = F.col("brier_skill") if "brier_skill" in metrics.columns else F.lit(None)
    return metrics.withColumn("brier_skill", F.coalesce(stored.cast("double"), derived))
