"""Text clean-up, word-list scores, profiles and the profile cache."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.sources import scratch
from filingrisk import policy
from filingrisk.functions import text as tx
from filingrisk.operators import textscores
from filingrisk.plans import jobs
from filingrisk.schemas import PROFILE
from filingrisk.sources import profile_cache

_WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"
_TABLES = "(?s)##TABLE_START.*?##TABLE_END"


def _clean(col: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(regexp_replace({col}, '{_TABLES}', ' ', 'g'), '<[^>]+>', ' ', 'g'), '{_WS}', ' ', 'g'))"
    )


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


PREPARED = f"prep as (select doc_id, {_clean('text')} as t from documents)"
TOKENS = (
    f"{PREPARED}, tok as (select doc_id, t, list_transform(regexp_extract_all(t, '[A-Za-z][A-Za-z\\-'']*'), lambda x: lower(x)) as k, "
    f"case when t = '' then 1 else len(regexp_extract_all(t, '[.!?]{_WS}')) + 1 end as ns from prep)"
)
_N = "len(k)"
_COUNT = "len(list_filter(k, lambda x: x in ({})))"
_HEDGES = _COUNT.format(_list(policy.HEDGE_WORDS))
_NEG = _COUNT.format(_list(policy.NEGATIVE_TERMS))
_POS = _COUNT.format(_list(policy.POSITIVE_TERMS))
_CLAMP = "least(greatest({}, {}), 1.0e0)"
_VAGUE = _CLAMP.format(f"100.0e0*{_HEDGES}/{_N}/5.0e0", "0.0e0")
_TRIPLES = "list_transform(range(1, len(k) - 1), lambda i: concat(k[i], ' ', k[i+1], ' ', k[i+2]))"
_REDUND = _CLAMP.format(
    f"3.0e0*(case when {_N} >= 3 then 1.0e0 - len(list_distinct({_TRIPLES}))*1.0e0/({_N}-2) else 0.0e0 end)"
    f" + 0.5e0*(1.0e0 - len(list_distinct(k))*1.0e0/{_N})",
    "0.0e0",
)
_LEN_PART = _CLAMP.format(f"({_N}*1.0e0/ns - 10.0e0)/25.0e0", "0.0e0")
_LONG_PART = _CLAMP.format(
    f"4.0e0*len(list_filter(k, lambda x: length(x) >= 9))*1.0e0/{_N}", "0.0e0"
)
_COMPLEX = _CLAMP.format(f"0.6e0*{_LEN_PART} + 0.4e0*{_LONG_PART}", "0.0e0")
_TONE = _CLAMP.format(f"({_POS} - {_NEG})/({_POS} + {_NEG} + 3.0e0)", "-1.0e0")


def documents_prepared(w, max_chars=None):
    """Cleaned text without the entity step, which SQL cannot state."""
    return w.documents.select(
        "doc_id", tx.prepare_text(F.col("text"), max_chars=max_chars, entities=False).alias("t")
    )


def documents_tokens(w):
    return documents_prepared(w).withColumns(
        {
            "k": tx.words(F.col("t")),
            "ns": F.greatest(F.size(tx.sentences(F.col("t"))), F.lit(1)),
        }
    )


@query("txt1_prepare_whole_text", f"with {PREPARED} select doc_id, md5(t) as digest, length(t) as n from prep")
def _(w):
    return documents_prepared(w).select("doc_id", F.md5("t").alias("digest"), F.length("t").alias("n"))


@query(
    "txt1_drop_table_blocks",
    f"""with marked as (select doc_id, concat(substr(text, 1, cast(length(text)//2 as int)), '##TABLE_START 1 2', chr(10), '3##TABLE_END',
      substr(text, cast(length(text)//2 as int) + 1)) as x from documents)
    select doc_id, md5({_clean('x')}) as digest from marked""",
)
def _(w):
    half = F.floor(F.length("text") / 2).cast("int")
    marked = F.concat(
        F.substring(F.col("text"), F.lit(1), half),
        F.lit("##TABLE_START 1 2\n3##TABLE_END"),
        F.substring(F.col("text"), half + 1, F.length("text")),
    )
    return w.documents.select(
        "doc_id", F.md5(tx.clean_text(marked, entities=False)).alias("digest")
    )


@query(
    "txt1_head_and_tail",
    f"""with {PREPARED} select doc_id, case when length(t) <= 12000 then md5(t)
    else md5(concat(substr(t, 1, 9580), ' […] ', right(t, 2400))) end as digest from prep""",
)
def _(w):
    out = documents_prepared(w, policy.PROMPT_TEXT_CHARS)
    return out.select("doc_id", F.md5("t").alias("digest"))


@query("txt1_html_pages", f"select page_id, md5({_clean('html')}) as digest from pages")
def _(w):
    cleaned = tx.clean_text(F.col("html"), entities=False)
    return w.table("pages").select("page_id", F.md5(cleaned).alias("digest"))


# The entities that the pages hold, the ampersand last.
_DECODED = "html"
for _entity, _char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("amp", "&")):
    _DECODED = f"regexp_replace({_DECODED}, '&{_entity};?', '{_char}', 'g')"


@query("txt1_html_entities", f"select page_id, {_clean(_DECODED)} as t from pages")
def _(w):
    return w.table("pages").select("page_id", tx.prepare_text(F.col("html")).alias("t"))


@query("txt2_words", f"with {TOKENS} select doc_id, len(k) as n, md5(array_to_string(k, ' ')) as digest from tok")
def _(w):
    return documents_tokens(w).select(
        "doc_id", F.size("k").cast("long").alias("n"), F.md5(F.array_join("k", " ")).alias("digest")
    )


@query("txt3_sentences", f"with {TOKENS} select doc_id, cast(ns as bigint) as n_sentences from tok")
def _(w):
    return documents_tokens(w).select("doc_id", F.col("ns").cast("long").alias("n_sentences"))


def _score_query(name: str, out: str, sql: str, build) -> None:
    @query(name, f"with {TOKENS} select doc_id, round(case when {_N} > 0 then {sql} end, 6) as {out} from tok")
    def _(w):
        score = F.when(F.size("k") > 0, build())
        return documents_tokens(w).select("doc_id", F.round(score, 6).alias(out))


_score_query("txt4_vagueness", "vagueness", _VAGUE, lambda: tx.vagueness(F.col("k")))
_score_query("txt5_redundancy", "redundancy", _REDUND, lambda: tx.redundancy(F.col("k")))
_score_query("txt6_complexity", "complexity", _COMPLEX, lambda: tx.complexity(F.col("k"), F.col("ns")))
_score_query("txt7_risk_sentiment", "sentiment", _TONE, lambda: tx.risk_sentiment(F.col("k")))

_VALUES = (
    f"vals as (select *, case when {_N} > 0 then {_VAGUE} end as v, case when {_N} > 0 then {_REDUND} end as r,"
    f" case when {_N} > 0 then {_COMPLEX} end as c, {_TONE} as s from tok)"
)


def _four(x: str) -> str:
    """Four digits, exact halves to even, by comparing with the halfway double itself."""
    k = f"floor({x}*10000)"
    half = f"({k} + 0.5e0)/10000.0e0"
    return f"(case when {x} > {half} then {k} + 1 when {x} < {half} then {k} else {k} + abs({k} % 2) end)/10000.0e0"


_TOP = f"""hits as (select doc_id, term, count(*) as c, min(pos) as p from (
    select doc_id, unnest(k) as term, generate_subscripts(k, 1) as pos from tok) where term in ({_list(policy.NEGATIVE_TERMS)}) group by doc_id, term),
  top as (select doc_id, string_agg(term, ', ' order by c desc, p) as terms from (
    select * from hits qualify row_number() over (partition by doc_id order by c desc, p) <= 5) group by doc_id)"""


@query(
    "txt8_top_negative_terms",
    f"with {TOKENS},{_TOP} select doc_id, coalesce(terms, '') as terms from tok left join top using (doc_id)",
)
def _(w):
    top = tx.top_negative_terms(F.col("k"))
    return documents_tokens(w).select("doc_id", F.array_join(top, ", ").alias("terms"))


_SUMMARY = (
    f"concat('[MOCK] ', {_N}, ' Tokens, ', ns, ' Sätze; Hedge-Dichte ', printf('%.1f', 100.0e0*{_HEDGES}/{_N}),"
    f" '/100; dominierende Risikobegriffe: ', coalesce(terms, 'keine'), '.')"
)
@query(
    "txt9_heuristic_profile",
    f"""with {TOKENS},{_TOP},{_VALUES} select doc_id,
    case when {_N} < 10 then 0.5e0 else {_four('v')} end as llm_vagueness_score,
    case when {_N} < 10 then 0.5e0 else {_four('r')} end as llm_redundancy_score,
    case when {_N} < 10 then 0.5e0 else {_four('c')} end as llm_complexity_score,
    case when {_N} < 10 then 0.0e0 else {_four('s')} end as llm_risk_sentiment,
    case when {_N} < 10 then 0.0e0 else 0.35e0 end as llm_confidence,
    case when {_N} < 10 then '[fallback] text too short for analysis' else {_SUMMARY} end as llm_risk_summary
    from vals left join top using (doc_id)""",
)
def _(w):
    return textscores.text_features(w.documents, text_col="text", entities=False)


@query(
    "txt10_validate_profile",
    """select doc_id, case doc_id % 5 when 0 then (doc_id % 10)/10.0e0 when 3 then 0.1e0 else 0.5e0 end as vagueness,
    case doc_id % 5 when 0 then 0.9e0 when 3 then 0.5e0 else 0.0e0 end as confidence,
    case doc_id % 5 when 0 then -0.5e0 when 3 then 1.0e0 else 0.0e0 end as sentiment,
    case when doc_id % 5 = 0 then 600 when doc_id % 5 = 3 then least(length(text), 600)
      else length('[fallback] unavailable') end as n_summary,
    case when doc_id % 5 in (0) then 8 else 0 end as n_terms
    from documents""",
)
def _(w):
    d = F.col("doc_id")
    score = ((d % 10) / F.lit(10.0)).alias("vagueness_score")
    const = [
        F.lit(0.5).alias("redundancy_score"),
        F.lit(0.25).alias("complexity_score"),
    ]
    # A long summary and too many terms.
    full = F.to_json(
        F.struct(
            score,
            *const,
            F.lit(-0.5).alias("risk_sentiment"),
            F.lit(0.9).alias("confidence"),
            F.rpad(F.lit("x"), 700, "x").alias("risk_summary"),
            F.array_repeat(F.lit("term"), 12).alias("obfuscation_indicators"),
            F.lit(1).alias("unknown"),
        )
    )
    too_high = F.to_json(F.struct(F.lit(1.5).alias("vagueness_score"), *const, F.lit(0.0).alias("risk_sentiment")))
    plain = F.to_json(
        F.struct(
            F.lit(0.1).alias("vagueness_score"),
            *const,
            F.lit(1.0).alias("risk_sentiment"),
            F.col("text").alias("risk_summary"),
        )
    )
    partial = F.to_json(F.struct(F.lit(0.1).alias("vagueness_score"), *const))
    json = (
        F.when(d % 5 == 0, full).when(d % 5 == 1, too_high).when(d % 5 == 2, F.lit("not json"))
        .when(d % 5 == 3, plain).otherwise(partial)
    )
    out = w.documents.select("doc_id", tx.validated_profile(json).alias("p"))
    return out.select(
        "doc_id",
        F.col("p.vagueness_score").alias("vagueness"),
        F.col("p.confidence").alias("confidence"),
        F.col("p.risk_sentiment").alias("sentiment"),
        F.length("p.risk_summary").alias("n_summary"),
        F.size("p.obfuscation_indicators").alias("n_terms"),
    )


@query(
    "txt11_profile_features",
    f"""with {TOKENS},{_VALUES} select doc_id, case when {_N} < 10 then 0.0e0 else {_four('s')} end as t_risk_sentiment,
    case when {_N} < 10 then 0.0e0 else 0.35e0 end as t_confidence from vals""",
)
def _(w):
    profiles = textscores.heuristic_profiles(documents_prepared(w), "t")
    out = profiles.select("doc_id", *tx.profile_features(F.col("profile"), "t_", summary=False))
    return out.select("doc_id", "t_risk_sentiment", "t_confidence")


_SHARE = "least(length(t), 10000)/10000.0e0"
_BY_LENGTH = f"""round(case when length(t) < 50 then 0.5e0 else {_SHARE} end, 9) as llm_vagueness_score,
    round(case when length(t) < 50 then 0.5e0 else 1 - {_SHARE} end, 9) as llm_complexity_score,
    case when length(t) < 50 then 0.0e0 else 0.8e0 end as llm_confidence"""


@query("txt12_injected_scorer", f"with {PREPARED} select doc_id, {_BY_LENGTH} from prep")
def _(w):
    out = textscores.text_features(w.documents, text_col="text", scorer=_length_scorer(), entities=False)
    return _by_length(out)


@query(
    "txt12_precomputed_cache",
    f"""with {PREPARED} select doc_id, case when length(t) < 50 then null else round({_SHARE}, 9) end as llm_vagueness_score,
    case when length(t) < 50 then null else round(1 - {_SHARE}, 9) end as llm_complexity_score,
    case when length(t) < 50 then null else 0.8e0 end as llm_confidence, 0 as n_misses from prep""",
)
def _(w):
    """The second run scores nothing: its scorer fails on every text."""
    path = scratch(w, "precomputed")
    jobs.precompute_text(w.documents, _length_scorer(), path, "length", text_col="text", entities=False)
    before = profile_cache.read_cache(w.spark, path, "length").count()

    def none(_body):
        raise ValueError("not asked")

    again = jobs.precompute_text(w.documents, none, path, "length", text_col="text", entities=False)
    misses = profile_cache.read_cache(w.spark, path, "length").count() - before
    return _by_length(again).withColumn("n_misses", F.lit(misses).cast("int"))


def _by_length(out):
    return out.select(
        "doc_id", F.round("llm_vagueness_score", 9).alias("llm_vagueness_score"),
        F.round("llm_complexity_score", 9).alias("llm_complexity_score"), "llm_confidence",
    )


def _length_scorer():
    def by_length(body):
        if len(body) < 50:
            raise ValueError("too short")
        share = min(len(body), 10000) / 10000
        return {
            "vagueness_score": share,
            "redundancy_score": 0.5,
            "complexity_score": 1 - share,
            "risk_sentiment": 0.0,
            "confidence": 0.8,
            "risk_summary": "by length",
        }

    return by_length


@query("txt13_text_hash", f"with {PREPARED} select doc_id, substr(sha256(t), 1, 32) as text_hash from prep")
def _(w):
    return documents_prepared(w).select("doc_id", tx.text_hash(F.col("t")).alias("text_hash"))


_KNOWN = f"{PREPARED}, h as (select doc_id, substr(sha256(t), 1, 32) as text_hash from prep), known as (select distinct text_hash from h where doc_id % 3 <> 0)"


def _cache(w):
    """Profiles of two thirds of the documents, as the cache would hold them."""
    known = documents_prepared(w).where("doc_id % 3 <> 0").withColumnRenamed("t", "prepared")
    hashed = known.withColumn("text_hash", tx.text_hash(F.col("prepared")))
    return textscores.distinct_texts(hashed).select(
        "text_hash",
        F.struct(
            *[F.lit(0.25).alias(n) for n in policy.PROFILE_SCORES],
            F.array().cast("array<string>").alias("obfuscation_indicators"),
            F.lit("cached").alias("risk_summary"),
        ).cast(PROFILE).alias("profile"),
    )


def _hashes(w):
    return documents_prepared(w).select("doc_id", tx.text_hash(F.col("t")).alias("text_hash"))


@query(
    "jn6_cache_counts",
    f"with {_KNOWN} select count(k.text_hash) as n_hits, count(*) - count(k.text_hash) as n_misses from (select distinct text_hash from h) d left join known k using (text_hash)",
)
def _(w):
    return profile_cache.cache_counts(_hashes(w), _cache(w))


@query(
    "jn6_cache_misses",
    f"with {_KNOWN} select distinct text_hash from h where text_hash not in (select text_hash from known)",
)
def _(w):
    return profile_cache.split_by_cache(_hashes(w), _cache(w))[1]


@query(
    "src11_cached_profiles",
    f"""with {_KNOWN},{TOKENS[len(PREPARED) + 2:]},{_VALUES} select doc_id, case when known.text_hash is not null then 0.25e0
    when {_N} < 10 then 0.0e0 else {_four('s')} end as llm_risk_sentiment
    from vals join h using (doc_id) left join known using (text_hash)""",
)
def _(w):
    out = textscores.text_features(
        w.documents, text_col="text", cache=_cache(w), entities=False, summary=False
    )
    return out.select("doc_id", "llm_risk_sentiment")


@query(
    "jn5_join_text_features",
    f"""with {TOKENS},{_VALUES} select d.doc_id, l.quality, case when {_N} < 10 then 0.0e0 else {_four('s')} end as llm_risk_sentiment
    from labels l join documents d using (doc_id) join vals using (doc_id)""",
)
def _(w):
    feats = textscores.text_features(w.documents, text_col="text", entities=False, summary=False)
    twice = feats.unionByName(feats)
    rows = w.table("labels").join(w.documents.select("doc_id"), "doc_id")
    out = textscores.join_text_features(rows, twice)
    return out.select("doc_id", "quality", "llm_risk_sentiment")
