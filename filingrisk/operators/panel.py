"""Firm-year table joins, filters and look-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingrisk.functions import dates
from filingrisk.functions.ids import content_id
from filingrisk.operators.ordered import keep_first
from filingrisk.policy import TEXT_ALIASES


def join_panel(df: DataFrame, panel: DataFrame, keys: Sequence[str] = ("cik", "fyear")) -> DataFrame:
    """Left join on (cik, fyear); clashing panel columns get the suffix `_fin`."""
    taken = set(df.columns) - set(keys)
    right = panel.select(
        *keys, *[F.col(c).alias(f"{c}_fin" if c in taken else c) for c in panel.columns if c not in keys]
    )
    return df.join(right, list(keys), "left")


def fill_from_local(panel: DataFrame, local: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Left join on (cik, fyear) where local values fill what the panel lacks."""
    keys = ["cik", "fyear"]
    wanted = [c for c in columns if c in local.columns]
    right = local.select(*keys, *[F.col(c).alias(f"{c}_loc") for c in wanted])
    joined = panel.join(right, keys, "left")
    filled = {
        c: F.coalesce(F.col(c), F.col(f"{c}_loc")) if c in panel.columns else F.col(f"{c}_loc")
        for c in wanted
    }
    return joined.withColumns(filled).drop(*[f"{c}_loc" for c in wanted])


def from_year(df: DataFrame, min_fyear: int | None) -> DataFrame:
    """Rows of `min_fyear` and later; rows without a numeric year go."""
    if min_fyear is None or "fyear" not in df.columns:
        return df
    return df.where(F.col("fyear").try_cast("double") >= min_fyear)


def require_financials(df: DataFrame, column: str = "total_assets") -> DataFrame:
    if column not in df.columns:
        raise KeyError(f"{column!r} is missing: join the financial panel first")
    return df.where(F.col(column).isNotNull())


def with_default_dates(df: DataFrame, *, filing_lag_days: int = 90) -> DataFrame:
    """Year end for a missing reporting date, 90 days later for a missing filing date."""
    none = F.lit(None).cast("date")
    rep = F.col("reporting_date") if "reporting_date" in df.columns else none
    fil = F.col("filing_date") if "filing_date" in df.columns else none
    dated = df.withColumn(
        "reporting_date", F.coalesce(rep, F.make_date(F.col("fyear"), F.lit(12), F.lit(31)))
    )
    return dated.withColumn(
        "filing_date", F.coalesce(fil, F.date_add("reporting_date", filing_lag_days))
    )


def with_null_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """NULL doubles for the features a model wants and the data lacks."""
    absent = [n for n in dict.fromkeys(names) if n not in df.columns]
    return df.withColumns({n: F.lit(None).cast("double") for n in absent}) if absent else df


def normalise_scoring_input(df: DataFrame) -> DataFrame:
    """Firm rows from any supported file to the columns scoring expects."""
    out = df.toDF(*[c.strip().lower() for c in df.columns])
    typed = {}
    if "cik" in out.columns:
        typed["cik"] = F.col("cik").try_cast("double").cast("long")
    for name in ("filing_date", "reporting_date"):
        if name in out.columns:
            typed[name] = dates.any_date(F.col(name))
    if typed:
        out = out.withColumns(typed)
    if "fyear" in out.columns:
        out = out.withColumn("fyear", F.col("fyear").try_cast("double").cast("int"))
    elif "reporting_date" in out.columns:
        out = out.withColumn("fyear", F.year("reporting_date"))
    if "doc_id" not in out.columns:
        cik = F.col("cik").cast("string") if "cik" in out.columns else None
        if cik is not None and "reporting_date" in out.columns:
            made = dates.firm_year_id(F.col("cik"), F.col("reporting_date"))
        elif cik is not None and "fyear" in out.columns:
            made = F.concat_ws("_", cik, F.col("fyear").cast("string"))
        else:
            made = F.concat(F.lit("row_"), content_id(out))
        out = out.withColumn("doc_id", made)
    if "name" not in out.columns:
        known = F.col("cik").cast("string") if "cik" in out.columns else F.lit("unbekannt")
        out = out.withColumn("name", known)
    if "mda" not in out.columns:
        alias = next((a for a in TEXT_ALIASES if a in out.columns), None)
        if alias is not None:
            out = out.withColumnRenamed(alias, "mda")
    if "label" not in out.columns:
        out = out.withColumn("label", F.lit(0))
    return out


def company_index(df: DataFrame) -> DataFrame:
    """Distinct (cik, name), sorted by name."""
    return df.select("cik", "name").distinct().orderBy(F.col("name").asc_nulls_last(), "cik")


def search_companies(index: DataFrame, query: str, limit: int = 15) -> DataFrame:
    """Firms by exact cik or by a part of the name; at most `limit` by name."""
    wanted = query.strip()
    if not wanted:
        return index.limit(0)
    if wanted.isdigit():
        hit = F.col("cik") == int(wanted)
    else:
        hit = F.lower("name").contains(wanted.lower())
    return index.where(hit).orderBy("name", "cik").limit(limit)


def sorted_ciks(df: DataFrame) -> DataFrame:
    return df.select("cik").where("cik IS NOT NULL").distinct().orderBy("cik")


def first_rows(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first n rows in a stated order."""
    return df.orderBy(*order).limit(n)


def latest_filing(df: DataFrame, *, row_id: str = "doc_id") -> DataFrame:
    """The newest firm-year per firm."""
    return keep_first(
        df,
        ["cik"],
        [F.col("fyear").desc_nulls_last(), F.col("reporting_date").desc_nulls_last(), row_id],
    )


def filing_of_year(df: DataFrame, fyear: int) -> DataFrame:
    return df.where(F.col("fyear") == fyear)


def sample_counts(df: DataFrame, label_col: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows, positives, base rate and firms of a labelled sample."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sum(label_col).cast("long").alias("positives"),
        F.avg(F.col(label_col).cast("double")).alias("base_rate"),
        F.count_distinct("cik").alias("n_firms"),
    )


def financial_coverage(df: DataFrame, column: str = "total_assets") -> DataFrame:
    """Share of rows with the financial column."""
    return df.agg(F.avg(F.col(column).isNotNull().cast("double")).alias("coverage"))

