"""Which column plays which role, decided on column names at plan time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingrisk import policy
from filingrisk.functions.ids import content_id


@dataclass(frozen=True)
class Roles:
    label: str
    row_id: str
    text: str | None
    year: str | None


def _choose(df: DataFrame, asked: str | None, candidates: Sequence[str], role: str) -> str | None:
    if asked is not None:
        if asked not in df.columns:
            raise KeyError(f"{role} column {asked!r} is not in the data")
        return asked
    return next((c for c in candidates if c in df.columns), None)


def resolve_roles(
    df: DataFrame,
    *,
    label: str | None = None,
    row_id: str | None = None,
    text: str | None = None,
    year: str | None = None,
) -> tuple[DataFrame, Roles]:
    """Label, id, text and year columns: the named one, else the first known name.

    A label is required. Without an id column, doc_id becomes cik_year, or a hash
    of the row where either is missing. Filings of one firm and year share the
    former, equal rows the latter.
    """
    label_col = _choose(df, label, policy.LABEL_COLUMNS, "label")
    if label_col is None:
        raise KeyError(f"no label column, expected one of {policy.LABEL_COLUMNS}")
    id_col = _choose(df, row_id, policy.ID_COLUMNS, "id")
    text_col = _choose(df, text, policy.TEXT_COLUMNS, "text")
    year_col = _choose(df, year, policy.YEAR_COLUMNS, "year")
    if id_col is None:
        id_col = "doc_id"
        if "cik" in df.columns and year_col is not None:
            made = F.concat(F.col("cik").cast("string"), F.lit("_"), F.col(year_col).cast("string"))
            made = F.coalesce(made, content_id(df))
        else:
            made = content_id(df)
        df = df.withColumn(id_col, made)
    return df, Roles(label_col, id_col, text_col, year_col)


def with_default_label(df: DataFrame) -> DataFrame:
    """A zero label where the data has none, so scoring input resolves too."""
    known = (*policy.LABEL_COLUMNS, "label_default")
    return df if any(c in df.columns for c in known) else df.withColumn("label", F.lit(0))


def resolve_concepts(
    df: DataFrame, aliases: Mapping[str, Sequence[str]] = policy.CONCEPT_ALIASES
) -> dict[str, str]:
    """concept -> column: the first alias that exists, ignoring case."""
    present = {c.lower(): c for c in df.columns}
    found = {}
    for concept, names in aliases.items():
        match = next((present[n] for n in names if n in present), None)
        if match is not None:
            found[concept] = match
    return found
