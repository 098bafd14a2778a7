"""Evaluation of scores, per any set of group columns (model, fold, replicate)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingrisk.functions.numeric import finite
from filingrisk.operators.ordered import cumulative_at_ranks, running_totals


def metric_bundle(
    df: DataFrame,
    by: Sequence[str] = (),
    *,
    score: str = "p",
    label: str = "y",
    weight: str | None = None,
    reference: float | None = None,
) -> DataFrame:
    """n, positives, base_rate, brier, brier_skill, roc_auc and pr_auc per group.

    Ties share credit in the ROC area; the PR area is average precision. Both
    are NULL for a single class. Everything is read off the positives and
    negatives per distinct score.
    """
    w = F.lit(1).cast("long") if weight is None else F.col(weight)
    y = F.col(label).cast("int")
    per_score = df.groupBy(*by, score).agg(
        F.sum(F.when(y == 1, w).otherwise(0)).alias("pos"),
        F.sum(F.when(y == 1, 0).otherwise(w)).alias("neg"),
    )
    return metrics_of_counts(per_score, by, score=score, reference=reference)


def metrics_of_counts(
    per_score: DataFrame, by: Sequence[str], *, score: str = "p", reference: float | None = None
) -> DataFrame:
    """The metric bundle from (by, score, pos, neg) rows."""
    totals = running_totals(per_score, by, score, ["pos", "neg"], descending=True)
    p = F.col(score)
    pos, neg = F.col("pos"), F.col("neg")
    tp, fp = F.col("pos_before") + pos, F.col("neg_before") + neg
    sums = totals.groupBy(*by).agg(
        F.coalesce(F.sum(pos + neg), F.lit(0)).alias("n"),
        F.coalesce(F.sum(pos), F.lit(0)).alias("positives"),
        F.sum(pos * F.pow(F.lit(1.0) - p, 2) + neg * F.pow(p, 2)).alias("_sq"),
        F.sum(neg * (F.col("pos_before") + pos / 2)).alias("_area"),
        F.sum(pos * F.try_divide(tp.cast("double"), tp + fp)).alias("_ap"),
    )
    return bundle_of_sums(sums, by, reference=reference)


def bundle_of_sums(sums: DataFrame, by: Sequence[str], *, reference: float | None = None) -> DataFrame:
    """The metric bundle from counts, squared errors, area and precision sums, one row per group.

    `_area` counts pairs of a negative with the positives above it, ties half;
    `_ap` sums the precision at each positive.
    """
    n, positives = F.col("n"), F.col("positives")
    base = F.try_divide(positives.cast("double"), n)
    ref = base if reference is None else F.lit(float(reference))
    ref_brier = base * F.pow(F.lit(1.0) - ref, 2) + (F.lit(1.0) - base) * F.pow(ref, 2)
    brier = F.try_divide(F.col("_sq"), n)
    return sums.select(
        *by,
        "n",
        "positives",
        base.alias("base_rate"),
        brier.alias("brier"),
        F.when(ref_brier > 0, F.lit(1.0) - brier / ref_brier).alias("brier_skill"),
        F.try_divide(F.col("_area"), positives.cast("double") * (n - positives)).alias("roc_auc"),
        F.when(positives < n, F.try_divide(F.col("_ap"), positives)).alias("pr_auc"),
    )


def brier_skill(
    df: DataFrame, by: Sequence[str] = (), *, score: str = "p", label: str = "y", reference: float | None = None
) -> DataFrame:
    """brier and brier_skill of scored rows against a constant (their base rate by default)."""
    y = F.col(label).cast("double")
    base = F.avg(y)
    sums = df.where(F.col(score).isNotNull()).groupBy(*by).agg(
        F.avg(F.pow(F.col(score) - y, 2)).alias("brier"), base.alias("_base")
    )
    ref = F.col("_base") if reference is None else F.lit(float(reference))
    ref_brier = F.col("_base") * F.pow(F.lit(1.0) - ref, 2) + (F.lit(1.0) - F.col("_base")) * F.pow(ref, 2)
    return sums.select(
        *by,
        "brier",
        F.when(ref_brier > 0, F.lit(1.0) - F.col("brier") / ref_brier).alias("brier_skill"),
    )


def top_k_capture(
    df: DataFrame,
    by: Sequence[str] = (),
    *,
    score: str = "p",
    label: str = "y",
    row_id: str = "row_id",
    fractions: Sequence[float] = (0.1, 0.3),
) -> DataFrame:
    """Share of positives among the highest-scored fraction, and its lift.

    k is the fraction of n rounded half to even, at least 1. A constant score
    ranks nothing: its capture is the fraction, its lift 1, its events NULL.
    """

    def cuts(n: Column) -> Column:
        return F.array(
            *[
                F.struct(
                    F.lit(float(f)).alias("cut"),
                    F.greatest(F.lit(1), F.bround(F.lit(float(f)) * n, 0)).cast("long").alias("r"),
                )
                for f in fractions
            ]
        )

    at = cumulative_at_ranks(df, by, score, label, row_id, cuts, descending=True)
    constant = F.col("n_scores") == 1
    total, n = F.col("hits_total"), F.col("n_total")
    base = total / n
    rate = F.col("hits") / F.col("r")
    some = total > 0
    return at.select(
        *by,
        F.col("cut").alias("fraction"),
        F.col("r").alias("k"),
        F.when(~constant, F.col("hits")).alias("events"),
        F.when(some, F.when(constant, F.col("cut")).otherwise(F.col("hits") / total)).alias("capture"),
        F.when(constant, base).otherwise(rate).alias("precision"),
        F.when(constant, F.lit(1.0)).otherwise(F.try_divide(rate, base)).alias("lift"),
    )


def widen_top_k(top_k: DataFrame, by: Sequence[str], fractions: Sequence[float] = (0.1, 0.3)) -> DataFrame:
    """One row per group with `top_<pct>pct_<measure>` columns."""
    measures = ("k", "events", "capture", "precision", "lift")
    cols = [
        F.max(F.when(F.col("fraction") == f, F.col(m))).alias(
            f"top_{round(100 * f)}pct_{'n' if m == 'k' else m}"
        )
        for f in fractions
        for m in measures
    ]
    return top_k.groupBy(*by).agg(*cols)


def decile_table(
    df: DataFrame,
    by: Sequence[str] = (),
    *,
    score: str = "p",
    label: str = "y",
    row_id: str = "row_id",
    n_bins: int = 10,
) -> DataFrame:
    """Equal-count score bins, 1 = highest: events, rate, lift, running capture.

    Bin edges are the linear quantiles of the ranks 1..n, right-closed.
    """

    def cuts(n: Column) -> Column:
        return F.array(
            *[
                F.struct(
                    F.lit(b).alias("cut"),
                    (F.floor(F.lit(b) * (n - 1) / n_bins) + 1).cast("long").alias("r"),
                )
                for b in range(1, n_bins + 1)
            ]
        )

    at = cumulative_at_ranks(df, by, score, label, row_id, cuts, descending=False)
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("cut")

    def below(name: str) -> Column:
        return F.coalesce(F.lag(name).over(w), F.lit(0))

    bins = at.withColumns({f"_{c}": below(c) for c in ("r", "hits", "score_sum")})
    n = F.col("r") - F.col("_r")
    events = F.col("hits") - F.col("_hits")
    total = F.col("hits_total")
    rate = events / n
    top = F.when(F.col("n_total") == 1, 1).otherwise(F.lit(n_bins + 1) - F.col("cut"))
    return bins.where(n > 0).select(
        *by,
        top.cast("int").alias("decile"),
        n.alias("n"),
        events.alias("events"),
        ((F.col("score_sum") - F.col("_score_sum")) / n).alias("avg_score"),
        rate.alias("event_rate"),
        F.try_divide(rate, total / F.col("n_total")).alias("lift"),
        F.try_divide((total - F.col("_hits")).cast("double"), total).alias("cum_capture"),
    )


def reliability_table(
    df: DataFrame, by: Sequence[str] = (), *, score: str = "p", label: str = "y", n_bins: int = 10
) -> DataFrame:
    """Equal-width score bins of scored rows, right-closed, the first including 0; empty bins left out."""
    edges = [i * (1.0 / n_bins) for i in range(n_bins)] + [1.0]
    p = F.col(score)
    index = sum((F.when(p > e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    bounds = F.array(*[F.lit(e) for e in edges])
    return (
        df.where(p.isNotNull())
        .groupBy(*by, (index + 1).alias("bin"))
        .agg(
            F.count("*").alias("n"),
            F.avg(score).alias("avg_p"),
            F.avg(F.col(label).cast("double")).alias("event_rate"),
        )
        .select(
            *by,
            "bin",
            F.element_at(bounds, F.col("bin")).alias("p_lo"),
            F.element_at(bounds, F.col("bin") + 1).alias("p_hi"),
            "n",
            "avg_p",
            "event_rate",
        )
    )


def firm_overlap(
    df: DataFrame, by: Sequence[str] = (), *, is_test: str = "is_test", firm: str = "cik"
) -> DataFrame:
    """How many test firms also train. Rows without a firm are ignored."""
    sides = (
        df.where(F.col(firm).isNotNull())
        .groupBy(*by, firm)
        .agg(F.max(~F.col(is_test)).alias("_tr"), F.max(F.col(is_test)).alias("_te"))
    )
    both = F.col("_tr") & F.col("_te")
    out = sides.groupBy(*by).agg(
        F.count_if("_tr").alias("n_train_firms"),
        F.count_if("_te").alias("n_test_firms"),
        F.count_if(both).alias("n_overlap_firms"),
        F.count_if(F.col("_te") & ~F.col("_tr")).alias("n_new_test_firms"),
    )
    rate = F.try_divide(F.col("n_overlap_firms").cast("double"), F.col("n_test_firms"))
    return out.withColumn("overlap_rate", rate)


def new_firm_rows(test: DataFrame, train: DataFrame, *, by: Sequence[str] = (), firm: str = "cik") -> DataFrame:
    """Test rows whose firm never trains; rows without a firm count as new."""
    known = train.select(*by, firm).distinct()
    return test.join(known, [*by, firm], "left_anti")


def new_firm_metrics(test: DataFrame, train: DataFrame, *, by: Sequence[str] = (), firm: str = "cik", score: str = "p", label: str = "y") -> DataFrame:
    """Metrics of the new-firm subset; AUCs are NULL unless both classes occur."""
    return metric_bundle(
        new_firm_rows(test, train, by=by, firm=firm), by, score=score, label=label
    )


def with_null_model(
    df: DataFrame, by: Sequence[str] = (), *, label: str = "y", name: str = "p_null"
) -> DataFrame:
    """Adds the constant base rate of the rows as a score."""
    if by:
        rates = df.groupBy(*by).agg(F.avg(F.col(label).cast("double")).alias(name))
        return df.join(rates, list(by))
    rate = df.agg(F.avg(F.col(label).cast("double"))).scalar()
    return df.withColumn(name, rate)


def melt_scores(df: DataFrame, models: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Long scores (keep..., model, p) from one column per model."""
    return df.select(
        *keep,
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("p")) for m in models])
        ).alias("_s"),
    ).select(*keep, "_s.model", "_s.p")


def id_fingerprint(df: DataFrame, row_id: str, by: Sequence[str] = ()) -> DataFrame:
    """An order-free digest of a set of ids, combined from per-id hashes.

    Count, sum and xor of 60 bits of each id's MD5, so it aggregates in parallel
    and two tables agree on it exactly if they hold the same ids (up to hash
    collisions).
    """
    bits = F.conv(F.substring(F.md5(F.col(row_id).cast("string")), 1, 15), 16, 10).cast("long")
    sums = (
        df.select(*by, bits.alias("_h"))
        .groupBy(*by)
        .agg(
            F.count("*").alias("n_ids"),
            F.bit_xor("_h").alias("_x"),
            F.sum(F.col("_h").cast("decimal(38,0)")).alias("_s"),
        )
    )
    digest = F.sha1(F.concat_ws("|", F.col("n_ids").cast("string"), F.col("_x").cast("string"), F.col("_s").cast("string")))
    return sums.select(*by, "n_ids", digest.alias("fingerprint"))


def mean_of_folds(folds: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean of fold metrics; folds without a value are skipped."""
    return folds.agg(*[F.avg(finite(F.col(c))).alias(f"mean_{c}") for c in columns])
