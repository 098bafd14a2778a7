"""Financial ratios, trends, industry percentiles and missing flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingrisk.functions.numeric import finite, finite_sql, log1p_floor0, safe_div_sql
from filingrisk.operators.ordered import running_totals, with_previous_rows
from filingrisk.operators.roles import resolve_concepts
from filingrisk.policy import INDUSTRY_MIN_PEERS, INDUSTRY_RATIOS, TREND_RATIOS

# name -> (numerator concept, denominator concept)
_SIMPLE_RATIOS = {
    "fin_leverage": ("total_liabilities", "total_assets"),
    "fin_current_ratio": ("current_assets", "current_liabilities"),
    "fin_cash_ratio": ("cash", "current_liabilities"),
    "fin_roa": ("net_income", "total_assets"),
    "fin_net_margin": ("net_income", "revenue"),
    "fin_interest_coverage": ("ebit", "interest_expense"),
    "fin_re_to_assets": ("retained_earnings", "total_assets"),
    "fin_asset_turnover": ("revenue", "total_assets"),
}
# The weights of the composite score.
_Z_WEIGHTS = {"working": 1.2, "retained": 1.4, "ebit": 3.3, "equity": 0.6, "sales": 1.0}


def base_ratios(df: DataFrame) -> dict[str, Column]:
    """The level ratios that the available concepts allow."""
    v = {c: finite_sql(f"`{name}`") for c, name in resolve_concepts(df).items()}

    def has(*concepts: str) -> bool:
        return all(c in v for c in concepts)

    out = {
        name: safe_div_sql(v[num], v[den])
        for name, (num, den) in _SIMPLE_RATIOS.items()
        if has(num, den)
    }
    if has("long_term_debt", "equity"):
        debt = v["long_term_debt"]
        if has("debt_in_current"):
            # Either part may be missing, not both.
            debt = f"coalesce({debt} + {v['debt_in_current']}, {debt}, {v['debt_in_current']})"
        out["fin_debt_to_equity"] = safe_div_sql(debt, v["equity"])
    if has("current_assets", "current_liabilities", "inventory"):
        quick = f"{v['current_assets']} - {v['inventory']}"
        out["fin_quick_ratio"] = safe_div_sql(quick, v["current_liabilities"])
    if has("current_assets", "current_liabilities", "total_assets"):
        working = f"{v['current_assets']} - {v['current_liabilities']}"
        out["fin_wc_to_assets"] = safe_div_sql(working, v["total_assets"])
    if has("total_assets"):
        assets = v["total_assets"]
        # greatest() skips NULL, so a missing value is kept apart.
        out["fin_log_assets"] = f"if({assets} IS NULL, NULL, log1p(greatest({assets}, 0D)))"
    if {"fin_wc_to_assets", "fin_re_to_assets", "fin_asset_turnover"} <= out.keys():
        parts = {
            "working": out["fin_wc_to_assets"],
            "retained": out["fin_re_to_assets"],
            "ebit": safe_div_sql(v["ebit"], v["total_assets"]) if has("ebit") else "double(NULL)",
            "equity": safe_div_sql(v["equity"], v["total_liabilities"])
            if has("equity", "total_liabilities")
            else "double(NULL)",
            "sales": out["fin_asset_turnover"],
        }
        out["fin_altman_z"] = " + ".join(f"{_Z_WEIGHTS[k]}D * {e}" for k, e in parts.items())
    return {name: F.expr(text) for name, text in out.items()}


def add_trends(
    df: DataFrame, *, row_id: str = "doc_id", strict_years: bool = False
) -> tuple[DataFrame, list[str]]:
    """Change against the previous row, three-row volatility and revenue growth.

    Rows of a firm are ordered by year, then reporting date, then id. By
    default the previous row counts whatever its year; `strict_years` asks for
    the year before.
    """
    bases = [b for b in TREND_RATIOS if b in df.columns]
    revenue = resolve_concepts(df).get("revenue")
    order = [F.col("fyear")]
    if "reporting_date" in df.columns:
        order.append(F.unix_date("reporting_date"))
    names: list[str] = []

    def columns(w: Window) -> dict[str, Column]:
        made: dict[str, Column] = {}
        last3 = w.rowsBetween(-2, 0)

        def previous(col: Column) -> Column:
            before = F.lag(col).over(w)
            if strict_years:
                before = F.when(F.lag("fyear").over(w) == F.col("fyear") - 1, before)
            return before

        for base in bases:
            short = base.removeprefix("fin_")
            value = F.col(base)
            made[f"fin_d_{short}"] = value - previous(value)
            made[f"fin_vol3_{short}"] = F.when(
                F.count(value).over(last3) >= 2, F.stddev_samp(value).over(last3)
            )
        if revenue is not None:
            level = log1p_floor0(F.col(f"`{revenue}`"))
            made["fin_d_log_revenue"] = level - previous(level)
        names.extend(made)
        return made

    out = with_previous_rows(df, "cik", order, row_id, columns, depth=2)
    return out, names


def industry_group(sic: Column) -> Column:
    """Two-digit industry: 4-digit codes // 100, shorter ones // 10."""
    code = finite(sic)
    return F.when(code >= 1000, F.floor(code / 100)).otherwise(F.floor(code / 10))


def industry_percentiles(
    df: DataFrame, *, peers: DataFrame | None = None
) -> tuple[DataFrame | None, list[str]]:
    """Average rank of four ratios within industry and year, per distinct values.

    One row for each combination of industry, year and ratios in `df`, so rows
    need no id. NULL for fewer than five values in the cell, and without a value,
    industry or year. `peers` (sic, fyear and the ratios) widens the comparison
    group beyond the rows of `df`, for instance when one firm is scored.
    """
    bases = [b for b in INDUSTRY_RATIOS if b in df.columns]
    names = [f"{b}_sic_pct" for b in bases]
    if not bases or not {"sic", "fyear"} <= set(df.columns):
        return None, []
    cell = ["ratio", "sic2", "fyear"]

    def melted(source: DataFrame) -> DataFrame:
        values = F.explode(
            F.array(*[F.struct(F.lit(b).alias("ratio"), F.col(b).alias("v")) for b in bases])
        )
        return (
            source.select(*_industry_cell(), values.alias("_m"))
            .select("sic2", "fyear", "_m.ratio", "_m.v")
            .where("v IS NOT NULL AND sic2 IS NOT NULL AND fyear IS NOT NULL")
        )

    pool = melted(df)
    if peers is not None:
        pool = pool.unionByName(melted(peers))
    # Ranks come from counts per distinct value, so neither a huge industry nor
    # one very common value ends up in a single task.
    counts = pool.groupBy(*cell, "v").agg(F.count("*").alias("n"))
    totals = running_totals(counts, cell, "v", ["n"])
    pct = F.when(
        F.col("n_total") >= INDUSTRY_MIN_PEERS,
        (F.col("n_before") + (F.col("n") + 1) / 2) / F.col("n_total"),
    )
    ranks = totals.select(*cell, "v", pct.alias("pct"))
    out = df.select(*_industry_cell(), *bases).distinct()
    for b, name in zip(bases, names):
        own = ranks.where(F.col("ratio") == b).select("sic2", "fyear", F.col("v").alias(b), F.col("pct").alias(name))
        out = out.join(own, ["sic2", "fyear", b], "left")
    return out.select("sic2", "fyear", *bases, *names), names


def _industry_cell() -> tuple[Column, Column]:
    return industry_group(F.col("sic")).alias("sic2"), F.col("fyear").cast("double").alias("fyear")


def _join_percentiles(df: DataFrame, percentiles: DataFrame, names: list[str]) -> DataFrame:
    """The percentiles to every row with the same industry, year and ratios, NULL ones included."""
    bases = [n.removesuffix("_sic_pct") for n in names]
    keyed = percentiles.select(*[F.col(c).alias(f"_k_{c}") for c in ("sic2", "fyear", *bases)], *names)
    sic2, fyear = _industry_cell()
    own = df.withColumns({"_sic2": sic2, "_fyear": fyear})
    same = own["_sic2"].eqNullSafe(keyed["_k_sic2"]) & own["_fyear"].eqNullSafe(keyed["_k_fyear"])
    for b in bases:
        same = same & own[b].eqNullSafe(keyed[f"_k_{b}"])
    return own.join(keyed, same, "left").drop("_sic2", "_fyear", *[c for c in keyed.columns if c.startswith("_k_")])


def add_industry_percentiles(
    df: DataFrame, *, peers: DataFrame | None = None
) -> tuple[DataFrame, list[str]]:
    """Adds the industry percentiles to every row; row ids play no part."""
    percentiles, names = industry_percentiles(df, peers=peers)
    return (df if percentiles is None else _join_percentiles(df, percentiles, names)), names


def missing_flags(names: list[str]) -> dict[str, Column]:
    """`fin_miss_<feature>`: 1.0 where the feature is NULL."""
    return {
        f"fin_miss_{n.removeprefix('fin_')}": F.col(n).isNull().cast("double") for n in names
    }


def add_financial_features(
    df: DataFrame,
    *,
    row_id: str = "doc_id",
    include_trends: bool = True,
    include_industry: bool = True,
    include_missing: bool = True,
    strict_years: bool = False,
    peers: DataFrame | None = None,
) -> tuple[DataFrame, list[str]]:
    """All financial features of a firm-year table and their sorted names.

    `row_id` must be unique. Keep filing text out of `df`: the trend windows
    move whole rows.
    """
    levels = base_ratios(df)
    out = base = df.withColumns(levels) if levels else df
    names = list(levels)
    if include_trends and {"cik", "fyear"} <= set(df.columns):
        out, trends = add_trends(out, row_id=row_id, strict_years=strict_years)
        names += trends
    if include_industry:
        if peers is not None:
            peers = peers.withColumns(base_ratios(peers))
        # From the level ratios, so the trend windows are not part of this branch.
        ranked, percentiles = industry_percentiles(base, peers=peers)
        if ranked is not None:
            out = _join_percentiles(out, ranked, percentiles)
        names += percentiles
    if include_missing and names:
        flags = missing_flags(names)
        out = out.withColumns(flags)
        names += list(flags)
    return out, sorted(names)
