"""Language ID: nearest of several TF-IDF n-gram centroids per language, by cosine."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingrisk.llm.common import add_columns, arrow_schema, flat_map, ship_package

#: n-grams of 1 to 3 letters are hashed to so many features (a power of 2).
FEATURES = 1 << 12
#: Labelled documents per language that fit the centroids, about; the bound of the model's sample.
SAMPLE_PER_LANGUAGE = 1500
#: Centroids per language, at most.
CLUSTERS = 4
#: A text is rejected if its cosine is below this share of the least usual one (FLOOR_QUANTILE) of its language.
FLOOR_SHARE = 0.25
FLOOR_QUANTILE = 0.01
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Which code points below 0x40000 are letters."""
    out = np.zeros(0x40000, dtype=bool)
    out[[i for i in range(0x40000) if chr(i).isalpha()]] = True
    return out


def n_gram_counts(text: str) -> np.ndarray | None:
    """Counts of the hashed n-grams of a text, None if it has no letters.

    The text is lower-cased; each run of other characters than letters counts
    as one blank, which is no 1-gram.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    letters = _letters()
    known = letters[np.minimum(points, len(letters) - 1)]
    if not known.any():
        return None
    blank = ~known
    keep = known.copy()
    keep[1:] |= known[:-1]  # the first blank after a letter
    a = np.where(blank, np.uint32(32), points)[keep].astype(np.uint32)
    if a[-1] != 32:
        a = np.append(a, np.uint32(32))
    shift = np.uint32(32 - FEATURES.bit_length() + 1)
    one = a * np.uint32(2654435761)
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(40503) + a[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(2246822519) + a[2:]
    counts = np.zeros(FEATURES, dtype=np.int64)
    for grams in (one[a != 32], two * np.uint32(3266489917), three * np.uint32(668265263)):
        counts += np.bincount(grams >> shift, minlength=FEATURES)
    return counts


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF vectors of rows of counts."""
    vectors = np.log1p(counts) * idf
    norms = np.linalg.norm(vectors, axis=-1, keepdims=True)
    return vectors / np.where(norms > 0, norms, 1)


@dataclass
class Model:
    """Learned languages and their centroids; its size does not grow with the data."""

    idf: np.ndarray
    languages: list[str]
    centroids: np.ndarray
    floors: np.ndarray


def held_out(doc_id: str | Column) -> Column:
    """Documents kept for testing: remainder 2 of the CRC-32 of the id's text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == 2


def fit(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, clusters: int = CLUSTERS, seed: int = 7) -> Model:
    """Learn from columns text and lang; rows with null in either, or without letters, teach nothing.

    Document frequencies come from all rows, centroids from about `per_language`
    rows of each language, chosen by hash of the text. No rows give a model
    that knows no language.
    """
    rows = labelled.select("text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())

    def count(batches):
        seen, total = np.zeros(FEATURES, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts = n_gram_counts(text)
                if counts is not None:
                    seen += counts > 0
                    total += 1
        at = np.append(np.flatnonzero(seen), FEATURES)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(seen, total)[at])], names=["feature", "n"])

    ship_package(rows.sparkSession)
    found = rows.select("text").mapInArrow(count, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    seen = {r["feature"]: r["n"] for r in found}
    total = seen.pop(FEATURES, 0)
    idf = np.zeros(FEATURES)
    for feature, n in seen.items():
        idf[feature] = np.log((1 + total) / (1 + n)) + 1

    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()
    share = {r["lang"]: min(1.0, per_language / r["n"]) for r in sizes}
    if not share:
        return Model(idf, [], np.zeros((0, FEATURES)), np.zeros(0))
    steps = 1 << 30
    limit = F.create_map(*(x for k, v in sorted(share.items()) for x in (F.lit(k), F.lit(int(v * steps)))))
    chosen = rows.where(F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(steps)) < limit[F.col("lang")])

    def make():
        def produce(text, lang):
            counts = n_gram_counts(text)
            if counts is not None:
                at = np.flatnonzero(counts)
                yield lang, at.tolist(), counts[at].tolist()

        return produce

    # A text with very many copies is in the sample once.
    sample = flat_map(chosen.dropDuplicates(["text", "lang"]), make, "lang string, at array<bigint>, counts array<bigint>")
    schema = arrow_schema("lang string, centroid array<float>, floor double")

    def cluster(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["at"].to_pylist(), table["counts"].to_pylist(), strict=True))
        counts = np.zeros((len(rows), FEATURES), dtype=np.float32)
        for i, (at, n) in enumerate(rows):
            counts[i, at] = n
        centres, floors = spherical_means(weigh(counts, idf).astype(np.float32), clusters)
        lang = table["lang"][0].as_py()
        return pa.table([pa.array([lang] * len(centres)), pa.array(centres.tolist(), schema.types[1]), pa.array(floors.tolist())], schema=schema)

    made = sample.groupBy("lang").applyInArrow(cluster, "lang string, centroid array<float>, floor double").collect()
    made.sort(key=lambda r: (r["lang"], r["centroid"]))
    return Model(idf, [r["lang"] for r in made], np.array([r["centroid"] for r in made]), np.array([r["floor"] for r in made]))


def spherical_means(vectors: np.ndarray, k: int, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Centres of up to k clusters by cosine, and for each the least cosine that is not rejected.

    Starts from the mean's nearest vector and goes on with the farthest from those chosen.
    """
    nearest = vectors @ vectors.mean(axis=0)
    chosen = [int(nearest.argmax())]
    best = vectors @ vectors[chosen[0]]
    while len(chosen) < min(k, len(vectors)) and best.min() < 1 - 1e-6:
        chosen.append(int(best.argmin()))
        best = np.maximum(best, vectors @ vectors[chosen[-1]])
    centres = vectors[chosen]
    for _ in range(rounds):
        own = (vectors @ centres.T).argmax(axis=1)
        sums = np.stack([vectors[own == c].sum(axis=0) for c in range(len(centres))])
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        moved = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
        if np.allclose(moved, centres):
            break
        centres = moved
    floor = FLOOR_SHARE * float(np.quantile((vectors @ centres.T).max(axis=1), FLOOR_QUANTILE))
    return centres, np.full(len(centres), floor)


def classify(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs, lang_pred, score and rejected, one row per row.

    `score` is the cosine to the nearest centroid, ties to the first language by
    name. A text without letters, or null, is `und` with score 0 and rejected,
    and so is every text if the model knows no language. A text farther from its
    centroid than FLOOR_SHARE allows keeps its language and is rejected.
    """
    made = _classified(docs.select(*dict.fromkeys([*keep, "text"])), model)
    return made.select(*(F.col(c) for c in keep), *(F.col(f"{MADE}{c}").alias(c) for c in ("lang_pred", "score", "rejected")))


def keep_recognised(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose language is recognised, all columns as they are.

    Rows with a null text, one without letters, or one too far from all
    languages go; every repeated row is judged on its own.
    """
    return _classified(docs, model).where(~F.col(f"{MADE}rejected")).select(*(F.col(f"`{c}`") for c in docs.columns))


#: Before the names of made columns, so that they cannot clash with those of the table.
MADE = "_langid_"


def _classified(docs: DataFrame, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        known = shared.value
        centroids = np.ascontiguousarray(known.centroids.T)

        def produce(text):
            counts = n_gram_counts(text) if text and known.languages else None
            if counts is None:
                return UNKNOWN, 0.0, True
            cosines = weigh(counts, known.idf) @ centroids
            best = int(cosines.argmax())
            return known.languages[best], float(min(1.0, max(0.0, cosines[best]))), bool(cosines[best] < known.floors[best])

        return produce

    return add_columns(docs, ["text"], make, f"{MADE}lang_pred string, {MADE}score double, {MADE}rejected boolean")
