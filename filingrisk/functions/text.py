"""Text clean-up and lexicon scores as native column expressions."""

from __future__ import annotations

import html
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filingrisk import policy
from filingrisk.schemas import PROFILE

# The clean-up and token patterns.
TABLE_BLOCK = r"(?s)##TABLE_START.*?##TABLE_END"
HTML_TAG = r"<[^>]+>"
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"
WORD = r"[A-Za-z][A-Za-z\-']*"
SENTENCE_GAP = r"(?U)(?<=[.!?])[\s\x1c-\x1f]+"
NOT_BLANK = r"(?U)[^\s\x1c-\x1f]"
JOINER = " […] "


def decode_entities(col: Column) -> Column:
    """HTML entities to characters; Spark has no expression for the full table.

    Only texts with an ampersand travel to Python.
    """

    # A local function, so executors need no import of this package.
    @F.pandas_udf(T.StringType())
    def unescape(text: pd.Series) -> pd.Series:
        return text.map(html.unescape, na_action="ignore")

    return F.coalesce(unescape(F.when(col.contains("&"), col)), col)


def clean_text(col: Column, *, strip_tables: bool = True, entities: bool = True) -> Column:
    """Entities decoded, table blocks and tags dropped, whitespace collapsed."""
    out = F.coalesce(col, F.lit(""))
    if entities:
        out = decode_entities(out)
    if strip_tables:
        out = F.regexp_replace(out, TABLE_BLOCK, " ")
    out = F.regexp_replace(out, HTML_TAG, " ")
    return F.trim(F.regexp_replace(out, WHITESPACE, " "))


def head_and_tail(col: Column, max_chars: int, tail_share: float = 0.2) -> Column:
    """Long texts as head and tail around a joiner (max_chars - 15 characters)."""
    tail = int(max_chars * tail_share)
    head = max_chars - tail - 20
    end = F.substring(col, -tail, tail) if tail else col
    cut = F.concat(F.substring(col, 1, head), F.lit(JOINER), end)
    return F.when(F.length(col) <= max_chars, col).otherwise(cut)


def prepare_text(
    col: Column,
    *,
    max_chars: int | None = None,
    strip_tables: bool = True,
    tail_share: float = 0.2,
    entities: bool = True,
) -> Column:
    """Cleaned text for analysis; whole unless `max_chars` asks for head and tail."""
    cleaned = clean_text(col, strip_tables=strip_tables, entities=entities)
    return cleaned if max_chars is None else head_and_tail(cleaned, max_chars, tail_share)


def text_hash(col: Column) -> Column:
    """First 32 hex digits of the SHA-256 of the text; '' for a missing text."""
    # Never NULL, so joins on it need no filter that would clean every text twice.
    return F.coalesce(F.substring(F.sha2(col.cast("binary"), 256), 1, 32), F.lit(""))


def words(col: Column) -> Column:
    return F.transform(F.regexp_extract_all(col, F.lit(WORD), 0), F.lower)


def sentences(col: Column) -> Column:
    return F.filter(F.split(col, SENTENCE_GAP), lambda s: s.rlike(NOT_BLANK))


def _between(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Limit a value that is never NULL; the expression appears once, so it runs once."""
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))


def _in_list(tokens: Column, terms: Sequence[str]) -> Column:
    return F.filter(tokens, lambda t: t.isin(*terms))


def hedge_density(tokens: Column) -> Column:
    """Hedge words per 100 tokens."""
    n = F.size(tokens)
    return F.try_divide(F.lit(100.0) * F.size(_in_list(tokens, policy.HEDGE_WORDS)), n)


# The scores below are for texts with at least one token.
def vagueness(tokens: Column) -> Column:
    return _between(hedge_density(tokens) / 5.0)


def redundancy(tokens: Column) -> Column:
    """Repeated trigrams and low word variety."""
    n = F.size(tokens)
    triples = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.concat(
            F.get(tokens, i), F.lit(" "), F.get(tokens, i + 1), F.lit(" "), F.get(tokens, i + 2)
        ),
    )
    repeated = F.when(
        n >= 3, F.lit(1.0) - F.size(F.array_distinct(triples)) / F.greatest(n - 2, F.lit(1))
    ).otherwise(0.0)
    variety = F.try_divide(F.size(F.array_distinct(tokens)).cast("double"), n)
    return _between(F.lit(3.0) * repeated + F.lit(0.5) * (F.lit(1.0) - variety))


def complexity(tokens: Column, n_sentences: Column) -> Column:
    """Long sentences and long words."""
    n = F.size(tokens)
    length = n / n_sentences
    long_share = F.try_divide(F.size(F.filter(tokens, lambda t: F.length(t) >= 9)).cast("double"), n)
    return _between(
        F.lit(0.6) * _between((length - 10.0) / 25.0) + F.lit(0.4) * _between(F.lit(4.0) * long_share)
    )


def risk_sentiment(tokens: Column) -> Column:
    """Smoothed balance of positive and negative terms."""
    neg = F.size(_in_list(tokens, policy.NEGATIVE_TERMS))
    pos = F.size(_in_list(tokens, policy.POSITIVE_TERMS))
    return _between((pos - neg) / (pos + neg + 3.0), -1.0, 1.0)


def top_negative_terms(tokens: Column, k: int = 5) -> Column:
    """The k most frequent negative terms; equal counts by first occurrence."""
    hits = _in_list(tokens, policy.NEGATIVE_TERMS)
    # Distinct hits come in first-occurrence order and are at most the word list.
    distinct = F.array_distinct(hits)
    counted = F.transform(
        distinct,
        lambda term, i: F.struct(
            (-F.size(F.filter(hits, lambda h: h == term))).alias("neg_count"),
            i.alias("place"),
            term.alias("term"),
        ),
    )
    return F.transform(F.slice(F.array_sort(counted), 1, k), lambda s: s["term"])


def fallback_profile(reason: Column | str) -> Column:
    """The neutral profile: middle scores, confidence 0."""
    why = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(
        F.lit(0.5).alias("vagueness_score"),
        F.lit(0.5).alias("redundancy_score"),
        F.lit(0.5).alias("complexity_score"),
        F.lit(0.0).alias("risk_sentiment"),
        F.lit(0.0).alias("confidence"),
        F.array().cast("array<string>").alias("obfuscation_indicators"),
        F.format_string(policy.FALLBACK_FORMAT, why).alias("risk_summary"),
    ).cast(PROFILE)


def heuristic_profile(tokens: Column, n_sentences: Column, top_terms: Column) -> Column:
    """The word-list profile of a tokenised text; short texts get the fallback.

    Pass materialised columns, so the token array is built once per text.
    """
    n = F.size(tokens)
    summary = F.format_string(
        policy.SUMMARY_FORMAT,
        n,
        n_sentences,
        # One decimal, halves to even.
        F.format_string("%.1f", F.bround(hedge_density(tokens), 1)),
        F.when(F.size(top_terms) > 0, F.concat_ws(", ", top_terms)).otherwise(
            policy.SUMMARY_NO_TERMS
        ),
    )
    scored = F.struct(
        F.bround(vagueness(tokens), 4).alias("vagueness_score"),
        F.bround(redundancy(tokens), 4).alias("redundancy_score"),
        F.bround(complexity(tokens, n_sentences), 4).alias("complexity_score"),
        F.bround(risk_sentiment(tokens), 4).alias("risk_sentiment"),
        F.lit(policy.HEURISTIC_CONFIDENCE).alias("confidence"),
        top_terms.alias("obfuscation_indicators"),
        summary.alias("risk_summary"),
    ).cast(PROFILE)
    return F.when(n < 10, fallback_profile(policy.FALLBACK_SHORT)).otherwise(scored)


def profile_is_valid(profile: Column) -> Column:
    """All scores present and inside their ranges."""
    checks = profile.isNotNull()
    for name in policy.PROFILE_SCORES:
        low = -1.0 if name == "risk_sentiment" else 0.0
        value = profile[name]
        # A profile that does not state its confidence counts as 0.5.
        if name == "confidence":
            value = F.coalesce(value, F.lit(0.5))
        checks = checks & F.coalesce(value.between(low, 1.0), F.lit(False))
    return checks


def validated_profile(json: Column, reason: str = "unavailable") -> Column:
    """A profile from JSON text, over-long parts shortened, unusable ones replaced."""
    raw = F.from_json(json, PROFILE)
    summary = F.coalesce(raw["risk_summary"], F.lit(""))
    shortened = F.when(
        F.length(summary) > policy.SUMMARY_CHARS,
        F.concat(F.substring(summary, 1, policy.SUMMARY_CHARS - 1), F.lit("…")),
    ).otherwise(summary)
    indicators = F.transform(
        F.slice(
            F.coalesce(raw["obfuscation_indicators"], F.array().cast("array<string>")),
            1,
            policy.INDICATORS_KEPT,
        ),
        lambda x: F.substring(x, 1, policy.INDICATOR_CHARS),
    )
    good = F.struct(
        *[raw[n].alias(n) for n in policy.PROFILE_SCORES[:-1]],
        F.coalesce(raw["confidence"], F.lit(0.5)).alias("confidence"),
        indicators.alias("obfuscation_indicators"),
        shortened.alias("risk_summary"),
    ).cast(PROFILE)
    return F.when(profile_is_valid(raw), good).otherwise(fallback_profile(reason))


def profile_features(
    profile: Column, prefix: str = policy.PROFILE_PREFIX, *, summary: bool = True
) -> list[Column]:
    """The numeric profile fields as prefixed columns, plus the summary."""
    cols = [profile[n].alias(f"{prefix}{n}") for n in policy.PROFILE_SCORES]
    if summary:
        cols.append(profile["risk_summary"].alias(f"{prefix}risk_summary"))
    return cols


def profile_feature_names(prefix: str = policy.PROFILE_PREFIX) -> list[str]:
    return [f"{prefix}{n}" for n in policy.PROFILE_SCORES]
