"""Train/test splits that do not leak across time or firms.

Each split adds a boolean `is_test`. The cut is one number per split, found by
aggregation; which side a row falls on is then decided from the row alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingrisk.functions.numeric import hash_unit
from filingrisk.operators.ordered import order_statistics


def temporal_split(df: DataFrame, *, year_col: str = "fyear", test_size: float = 0.2) -> DataFrame:
    """The newest years, added until they hold `test_size` of all rows, are the test side.

    Rows without a year train.
    """
    years = df.groupBy(F.col(year_col).try_cast("double").alias("_year")).agg(
        F.count("*").alias("_n")
    )
    # One row per calendar year from here on.
    every = Window.partitionBy(F.lit(0))
    newer = every.orderBy(F.col("_year").desc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    first_test_year = (
        years.withColumn("_newer", F.coalesce(F.sum("_n").over(newer), F.lit(0)))
        .withColumn("_all", F.sum("_n").over(every))
        .where(F.col("_year").isNotNull() & (F.col("_newer") < F.lit(test_size) * F.col("_all")))
        .agg(F.min("_year"))
        .scalar()
    )
    in_test = F.col(year_col).try_cast("double") >= first_test_year
    return df.withColumn("is_test", F.coalesce(in_test, F.lit(False)))


def _one_rank(rank: Column, tag: str = "cut") -> Column:
    return F.array(F.struct(F.lit(tag).alias("tag"), rank.cast("long").alias("r")))


def group_split(
    df: DataFrame, *, group_col: str = "cik", test_size: float = 0.2, seed: int = 42
) -> DataFrame:
    """A random share of the firms is the test side; no firm is on both."""
    u = hash_unit(seed, F.col(group_col))
    firms = df.select(group_col).distinct().select(u.alias("_u"))
    cut = order_statistics(firms, [], "_u", lambda n: _one_rank(F.ceil(F.lit(test_size) * n)))
    last = cut.agg(F.max("_u")).scalar()
    return df.withColumn("is_test", F.coalesce(u <= last, F.lit(False)))


def stratified_split(
    df: DataFrame, *, label_col: str, row_id: str, test_size: float = 0.2, seed: int = 42
) -> DataFrame:
    """A random share of each class is the test side."""
    u = hash_unit(seed, F.col(row_id))
    keyed = df.select(F.col(label_col).cast("int").alias("_y"), u.alias("_u"))
    cut = order_statistics(
        keyed, ["_y"], "_u", lambda n: _one_rank(F.round(F.lit(test_size) * n))
    )
    last = {
        y: cut.where(F.col("_y") == y).agg(F.max("_u")).scalar() for y in (0, 1)
    }
    label = F.col(label_col).cast("int")
    in_test = F.when(label == 0, u <= last[0]).when(label == 1, u <= last[1])
    return df.withColumn("is_test", F.coalesce(in_test, F.lit(False)))


def has_both_classes(split: DataFrame, label_col: str) -> bool:
    """Whether both sides hold both classes (one row comes to the driver)."""
    y = F.col(label_col).cast("int")
    sides = split.agg(
        *[
            F.count_if((F.col("is_test") == test) & (y == label)).alias(f"c{int(test)}{label}")
            for test in (False, True)
            for label in (0, 1)
        ]
    ).first()
    return all(n > 0 for n in sides)


def smart_split(
    df: DataFrame,
    *,
    label_col: str,
    row_id: str = "doc_id",
    group_col: str | None = "cik",
    year_col: str | None = "fyear",
    test_size: float = 0.2,
    strategy: str = "auto",
    seed: int = 42,
) -> tuple[DataFrame, str]:
    """The asked split, or for `auto` the first usable of temporal, group, random.

    A split is usable if both sides hold both classes; else random is used.
    """
    chain = {"auto": ("temporal", "group"), "temporal": ("temporal",), "group": ("group",), "random": ()}
    if strategy not in chain:
        raise ValueError(f"unknown split strategy {strategy!r}")
    for name in chain[strategy]:
        column = year_col if name == "temporal" else group_col
        if column is None or column not in df.columns:
            continue
        if name == "temporal":
            candidate = temporal_split(df, year_col=column, test_size=test_size)
        else:
            candidate = group_split(df, group_col=column, test_size=test_size, seed=seed)
        if has_both_classes(candidate, label_col):
            return candidate, name
    return (
        stratified_split(df, label_col=label_col, row_id=row_id, test_size=test_size, seed=seed),
        "random",
    )


def rolling_folds(
    df: DataFrame,
    *,
    label_col: str,
    year_col: str = "fyear",
    test_window_years: int = 2,
    step_years: int = 2,
    min_train_years: int = 4,
    min_train_positives: int = 5,
    min_test_positives: int = 1,
) -> DataFrame:
    """One row per usable expanding-window fold.

    Train is year <= cutoff, test the `test_window_years` after it. Folds with
    an empty or one-class side or too few positives are left out. Works on the
    per-year counts only.
    """
    if year_col not in df.columns:
        raise KeyError(f"year column {year_col!r} is not in the data")
    years = (
        df.groupBy(F.col(year_col).try_cast("double").cast("int").alias("year"))
        .agg(F.count("*").alias("n"), F.sum(F.col(label_col).cast("long")).alias("pos"))
        .where("year IS NOT NULL")
        # One entry per calendar year.
        .agg(F.array_sort(F.collect_list(F.struct("year", "n", "pos"))).alias("ys"))
    )
    first = F.get("ys", F.lit(min_train_years - 1))["year"]
    last = F.element_at("ys", -1)["year"] - test_window_years
    long_enough = F.size("ys") >= min_train_years + test_window_years
    cutoffs = years.where(long_enough).where(first <= last).select(
        "ys", F.explode(F.sequence(first, last, F.lit(step_years))).alias("cutoff")
    )

    def total(rows: Column, name: str) -> Column:
        return F.aggregate(rows, F.lit(0).cast("long"), lambda acc, x: acc + x[name])

    train = F.filter("ys", lambda x: x["year"] <= F.col("cutoff"))
    test = F.filter(
        "ys",
        lambda x: (x["year"] > F.col("cutoff"))
        & (x["year"] <= F.col("cutoff") + test_window_years),
    )
    folds = cutoffs.select(
        "cutoff",
        F.transform(test, lambda x: x["year"]).alias("test_years"),
        total(train, "n").alias("n_train"),
        total(test, "n").alias("n_test"),
        total(train, "pos").alias("positives_train"),
        total(test, "pos").alias("positives_test"),
    )
    for side, least in (("train", min_train_positives), ("test", min_test_positives)):
        pos, n = F.col(f"positives_{side}"), F.col(f"n_{side}")
        folds = folds.where((n > 0) & (pos > 0) & (pos < n) & (pos >= least))
    return folds


def tag_fold_rows(
    df: DataFrame, folds: Sequence[Mapping], *, year_col: str = "fyear", window_years: int = 2
) -> DataFrame:
    """Each row once per fold it belongs to, with `cutoff` and `role`."""
    year = F.col(year_col)
    marks = F.array(
        *[
            F.struct(
                F.lit(int(f["cutoff"])).alias("cutoff"),
                F.when(year <= int(f["cutoff"]), "train")
                .when(year <= int(f["cutoff"]) + window_years, "test")
                .alias("role"),
            )
            for f in folds
        ]
    )
    return (
        df.withColumn("_m", F.explode(F.filter(marks, lambda m: m["role"].isNotNull())))
        .withColumns({"cutoff": F.col("_m.cutoff"), "role": F.col("_m.role")})
        .drop("_m")
    )


def calibration_folds(
    df: DataFrame,
    *,
    label_col: str,
    row_id: str = "doc_id",
    group_col: str | None = "cik",
    n_splits: int = 3,
    seed: int = 42,
) -> tuple[DataFrame, int, bool]:
    """Adds `cal_fold` in 0..k-1; returns (rows, k, whether firms stay whole).

    Firms are dealt to folds by hash. If that leaves a fold or its rest with one
    class, or there are fewer than two firms, rows are dealt instead.
    """
    label = F.col(label_col).cast("int")

    def dealt(column: str, k: int) -> DataFrame:
        fold = F.floor(hash_unit(seed + 1, F.col(column)) * k).cast("int")
        return df.withColumn("cal_fold", fold)

    if group_col is not None and group_col in df.columns:
        k = min(n_splits, df.select(group_col).distinct().limit(n_splits).count())
        if k >= 2:
            folded = dealt(group_col, k)
            per_fold = folded.groupBy("cal_fold").agg(
                F.count_if(label == 1).alias("p"), F.count_if(label == 0).alias("q")
            ).collect()
            p, q = sum(r["p"] for r in per_fold), sum(r["q"] for r in per_fold)
            if len(per_fold) == k and all(
                0 < r["p"] < p and 0 < r["q"] < q for r in per_fold
            ):
                return folded, k, True
    k = max(2, n_splits)
    return dealt(row_id, k), k, False
