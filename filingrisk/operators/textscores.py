"""Text scores for a table of documents: native word lists or any scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingrisk import policy
from filingrisk.functions import text as tx
from filingrisk.operators.ordered import keep_first
from filingrisk.schemas import PROFILE

# text -> profile fields, as a dict
Scorer = Callable[[str], dict]


def prepared_texts(
    df: DataFrame,
    text_col: str,
    id_col: str,
    *,
    max_chars: int | None = None,
    entities: bool = True,
) -> DataFrame:
    """(id, prepared, text_hash) per row."""
    prepared = tx.prepare_text(F.col(text_col), max_chars=max_chars, entities=entities)
    return df.select(id_col, prepared.alias("prepared")).withColumn(
        "text_hash", tx.text_hash(F.col("prepared"))
    )


def raw_hash(text: Column) -> Column:
    """A cheap key of the text as it came; null is a text of its own."""
    return F.sha2(F.coalesce(F.concat(F.lit("t"), text), F.lit("")), 256)


def distinct_texts(prepared: DataFrame) -> DataFrame:
    """(text_hash, prepared), one row per distinct text."""
    return keep_first(prepared.select("text_hash", "prepared"), ["text_hash"], ["text_hash"])


def heuristic_profiles(texts: DataFrame, text_col: str = "prepared") -> DataFrame:
    """Adds `profile` from the word lists, all in native expressions."""
    tokens = texts.withColumns(
        {
            "_toks": tx.words(F.col(text_col)),
            "_nsent": F.greatest(F.size(tx.sentences(F.col(text_col))), F.lit(1)),
        }
    ).withColumn("_top", tx.top_negative_terms(F.col("_toks")))
    profile = tx.heuristic_profile(F.col("_toks"), F.col("_nsent"), F.col("_top"))
    return tokens.withColumn("profile", profile).drop("_toks", "_nsent", "_top")


def scored_by(texts: DataFrame, scorer: Scorer, *, keep_fallbacks: bool = True) -> DataFrame:
    """(text_hash, profile) from an injected scorer, one call per text.

    A text whose call fails, or whose profile is out of range, gets the
    fallback profile, or is left out; the job goes on.
    """

    # Plain locals, so executors need no import of this package.
    scores = [n for n in policy.PROFILE_SCORES if n != "confidence"]
    term_chars, terms_kept = policy.INDICATOR_CHARS, policy.INDICATORS_KEPT
    summary_chars = policy.SUMMARY_CHARS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            profiles, errors = [], []
            for body in batch["prepared"]:
                try:
                    found = dict(scorer(body))
                    row = {n: float(found[n]) for n in scores}
                    row["confidence"] = float(found.get("confidence", 0.5))
                    terms = list(found.get("obfuscation_indicators") or [])
                    row["obfuscation_indicators"] = [str(t)[:term_chars] for t in terms[:terms_kept]]
                    summary = str(found.get("risk_summary") or "")
                    if len(summary) > summary_chars:
                        summary = summary[: summary_chars - 1] + "…"
                    row["risk_summary"] = summary
                    profiles.append(row)
                    errors.append(None)
                except Exception as exc:  # one bad text must not end the job
                    profiles.append(None)
                    errors.append(str(exc))
            yield pd.DataFrame(
                {"text_hash": batch["text_hash"], "profile": profiles, "error": errors}
            )

    schema = f"text_hash string, profile {PROFILE.simpleString()}, error string"
    scored = texts.select("text_hash", "prepared").mapInPandas(run, schema)
    reason = F.coalesce("error", F.lit("profile out of range"))
    usable = tx.profile_is_valid(F.col("profile"))
    if not keep_fallbacks:
        return scored.where(usable).select("text_hash", "profile")
    return scored.select(
        "text_hash",
        F.when(usable, F.col("profile")).otherwise(tx.fallback_profile(reason)).alias("profile"),
    )


def text_features(
    df: DataFrame,
    *,
    text_col: str,
    id_col: str = "doc_id",
    scorer: Scorer | None = None,
    cache: DataFrame | None = None,
    max_chars: int | None = None,
    prefix: str = policy.PROFILE_PREFIX,
    summary: bool = True,
    entities: bool = True,
) -> DataFrame:
    """One row of text features per id.

    Each distinct text is scored once: by the word lists, or by `scorer` where
    `cache` (text_hash, profile) does not know it. Equal texts share the result
    by hash, so only hashes travel back to the documents.
    """
    raw = raw_hash(F.col(text_col))
    distinct = df.select(raw.alias("raw_hash"), text_col).dropDuplicates(["raw_hash"])
    # Cleaned once for each distinct text; documents come back by the raw hash.
    texts = prepared_texts(distinct, text_col, "raw_hash", max_chars=max_chars, entities=entities)
    if scorer is None and cache is None:
        profiles = heuristic_profiles(texts).select("raw_hash", "profile")
    else:
        keyed = texts.select("raw_hash", "text_hash")
        open_texts = distinct_texts(texts)
        if cache is not None:
            open_texts = open_texts.join(cache.select("text_hash"), "text_hash", "left_anti")
        if scorer is None:
            found = heuristic_profiles(open_texts).select("text_hash", "profile")
        else:
            found = scored_by(open_texts, scorer)
        if cache is not None:
            found = found.unionByName(cache.select("text_hash", "profile"))
        profiles = keyed.join(found, "text_hash", "left").select("raw_hash", "profile")
    # Repeated ids have one text each or share it; the first one stands.
    ids = keep_first(df.select(id_col, raw.alias("raw_hash")), [id_col], ["raw_hash"])
    return ids.join(profiles, "raw_hash", "left").select(
        id_col, *tx.profile_features(F.col("profile"), prefix, summary=summary)
    )


def join_text_features(df: DataFrame, features: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Left join by id; a repeated id in `features` never multiplies rows."""
    return df.join(keep_first(features, [id_col], [id_col]), id_col, "left")
