"""Operators without check SQL against slow versions written from their definitions, over the whole small tables."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from filingrisk.llm import catalog, decontaminate, langid, licenses, secretscan, signatures  # noqa: F401

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: (r.text or "", r.lang) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def n_grams(text):
    """Counts of the hashed 1- to 3-grams by a loop over the characters."""
    made, last = [], " "
    for c in text.lower():
        c = c if c.isalpha() else " "
        if c != " " or last != " ":
            made.append(ord(c))
        last = c
    if not made:
        return None
    if made[-1] != 32:
        made.append(32)
    mask, shift = 0xFFFFFFFF, 33 - langid.FEATURES.bit_length()
    one = [c * 2654435761 & mask for c in made]
    two = [((a ^ a >> 15) * 40503 + c) & mask for a, c in zip(one, made[1:], strict=False)]
    three = [((a ^ a >> 13) * 2246822519 + c) & mask for a, c in zip(two, made[2:], strict=False)]
    grams = [g for g, c in zip(one, made, strict=True) if c != 32]
    grams += [g * 3266489917 & mask for g in two] + [g * 668265263 & mask for g in three]
    return Counter(g >> shift for g in grams)


def test_language_id(spark, texts):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out("doc_id")))
    counts = {d: n_grams(t) for d, (t, _) in texts.items()}
    taught = [counts[d] for d, (t, lang) in texts.items() if zlib.crc32(str(d).encode()) % 4 != 2 and lang is not None and counts[d]]
    seen = Counter(f for c in taught for f in c)
    for f in range(langid.FEATURES):
        assert math.isclose(model.idf[f], math.log((1 + len(taught)) / (1 + seen[f])) + 1 if seen[f] else 0.0)
    assert (np.abs(np.linalg.norm(model.centroids, axis=1) - 1) < 1e-5).all()
    got = {r.doc_id: r for r in catalog.QUERIES["op1_language_id"](spark, FOLDER).collect()}
    assert set(got) == set(texts)
    for d, c in counts.items():
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2)
        if c is None:
            assert (got[d].lang_pred, got[d].score) == ("und", 0.0)
            continue
        weights = {f: math.log1p(n) * model.idf[f] for f, n in c.items()}
        norm = math.sqrt(sum(v * v for v in weights.values())) or 1.0
        cosines = [sum(v * float(centre[f]) for f, v in weights.items()) / norm for centre in model.centroids]
        best = max(range(len(cosines)), key=lambda i: cosines[i])
        assert abs(got[d].score - cosines[best]) < 1e-5 and got[d].rejected == (cosines[best] < model.floors[best])
        assert got[d].lang_pred == model.languages[best] or sorted(cosines)[-1] - sorted(cosines)[-2] < 1e-6


def canonical(text):
    """(word, placeholder or word) of each token, by one expression over the text."""
    out, start, last = [], True, 0
    for m in re.finditer(r"\d+(?:[.,]\d+)*|[^\W\d_]+", text):
        start = (start and not out) or bool(re.search(r"[.!?:\n]", text[last : m.start()]))
        last, word, low = m.end(), m[0], m[0].lower()
        if low[0].isdigit() or low in decontaminate.NUMBER_WORDS:
            shape = "<num>"
        elif low in decontaminate.UNITS:
            shape = "<unit>"
        elif not start and len(word) > 1 and word[0] != low[0] and word[1:] == low[1:]:
            shape = "<name>"
        else:
            shape = low
        out.append((low, shape))
    return out


def cut(tokens, size):
    for at in range(len(tokens) - size + 1):
        part = tokens[at : at + size]
        literals = sum(w == s for w, s in part)
        enough = literals >= math.ceil(decontaminate.LITERAL_SHARE * max(size, decontaminate.WINDOW))
        yield at, tuple(w for w, _ in part), tuple(s for _, s in part), enough


def plain_leaks(docs, items):
    out = {}
    as_is, shaped = defaultdict(list), defaultdict(list)
    totals = {}
    for item, text in items.items():
        tokens = canonical(text)
        size = min(decontaminate.WINDOW, len(tokens))
        if not size:
            continue
        windows = list(cut(tokens, size))
        totals[item] = size, len(windows), sum(e for *_, e in windows)
        for at, words, shape, enough in windows:
            as_is[words].append((item, at, enough))
            if enough:
                shaped[shape].append((item, at, words))
    sizes = {t[0] for t in totals.values()}
    for doc, text in docs.items():
        tokens = canonical(text)
        met = defaultdict(lambda: (set(), set(), set()))
        for size in sizes:
            windows = list(cut(tokens, size))
            if size < min(decontaminate.WINDOW, decontaminate.LEAST_WORDS) and len(windows) > 1:
                continue
            for at, words, shape, enough in windows:
                for item, i_at, usable in as_is.get(words, ()):
                    if totals[item][0] == size:
                        met[item, at - i_at][0].add((i_at, usable))
                for item, i_at, theirs in shaped.get(shape, ()) if enough else ():
                    if totals[item][0] == size:
                        met[item, at - i_at][1].add((i_at, True))
                        pairs = {(s, a, b) for s, a, b in zip(shape, theirs, words, strict=True) if s in decontaminate.PLACE.values()}
                        met[item, at - i_at][2].update(pairs)
        per_item = defaultdict(lambda: [set(), True, 0])
        for (item, _), (verbatim, templates, pairs) in met.items():
            consistent = len(pairs) == len({(s, a) for s, a, _ in pairs})
            one = per_item[item]
            one[0] |= verbatim | templates if consistent else verbatim
            one[1] &= not consistent or all(a == b for _, a, b in pairs)
            run = best = 0
            at_last = None
            for at in sorted(a for a, _ in verbatim):
                run = run + 1 if at_last is not None and at == at_last + 1 else 1
                best, at_last = max(best, run), at
            one[2] = max(one[2], best)
        for item, (found, same, run) in per_item.items():
            _, n, usable = totals[item]
            coverage = max(len(found) / n, sum(u for _, u in found) / usable if usable else 0)
            if coverage >= decontaminate.MIN_COVERAGE or run >= max(1, decontaminate.RUN_WORDS - decontaminate.WINDOW + 1):
                out[doc, item] = len(found), n, round(coverage, 9), same
    return out


def test_template_leaks(spark, texts):
    items = {r.item_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    changed = {}
    for i, text in enumerate(items.values()):
        # Each item again with other numbers and names, and with a word taken out.
        changed[10_000 + i] = "Some words before. " + re.sub(r"\d+", lambda m: str(int(m[0]) + 7), text) + " And after."
        words = text.split()
        changed[20_000 + i] = " ".join(words[: len(words) // 2] + words[len(words) // 2 + 1 :])
    whole = {d: t for d, (t, _) in texts.items()} | changed
    docs = spark.createDataFrame(list(whole.items()), "doc_id long, text string")
    asked = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_found, r.n_windows, round(r.coverage, 9), r.same_slots) for r in decontaminate.find_leaks(docs, asked).collect()}
    want = plain_leaks(whole, items)
    assert got == want and len(want) > len(items)
    found = {(r.doc_id, r.item_id) for r in catalog.QUERIES["op8_template_leaks"](spark, FOLDER).collect()}
    assert found == {k for k in want if k[0] < 10_000}


def test_linked_secrets(spark, texts):
    scan = secretscan._scanner()
    found = {r.doc_id: r for r in secretscan.find_secrets(spark.read.parquet(f"{FOLDER}/documents.parquet"), ["doc_id"]).collect()}
    extra = [(d, t) for d, (t, _) in texts.items()]
    far = "x " * secretscan.SCOPE
    secret = "Ab3dEf6hIj9kLm2nOp5qRs8tUv1wXy4z"
    extra += [(-1, f"user = bob {secret} https://host.example/a"), (-2, f"user = bob {far} {secret}"), (-3, f"{secret} https://host.example/a"), (-4, "login: eve " * 300 + secret)]
    found |= {r.doc_id: r for r in secretscan.find_secrets(spark.createDataFrame(extra[-4:], "doc_id long, text string"), ["doc_id"]).collect()}
    some = 0
    for d, text in extra:
        *_, base, parts = scan(text)
        base = [tuple(base[i : i + 3]) for i in range(0, len(base), 3)]
        parts = [tuple(parts[i : i + 3]) for i in range(0, len(parts), 3)]
        linked = set()
        for kind, s, e in parts:
            near = {k for k, bs, be in parts if k != kind and k < 5 and bs <= e + secretscan.SCOPE and be >= s - secretscan.SCOPE}
            if near and (kind != 5 or near == {3, 4}) and not any(bs < e and s < be for _, bs, be in base):
                linked.add((s, kind, e))
        want = sorted([(s, k, e) for k, s, e in base] + list(linked))
        assert sorted(tuple(x) for x in found[d].spans) == want
        some += bool(linked)
    assert some >= 2


def test_license_suppression(texts):
    """What stays of all matches of all rules, taken one by one in the order of the rules."""
    for text, _ in texts.values():
        low = text.encode().lower()
        starts = licenses.word_starts(low).tolist()
        matches = []
        for priority, label, _, pattern in licenses.compiled():
            for m in pattern.finditer(low):
                matches.append((priority, label, sum(s < m.start() for s in starts), sum(s < m.end() for s in starts)))
        base = [m for m in matches if m[0] == 0]
        kept = []
        for m in sorted((m for m in matches if m[0]), key=lambda m: (m[0], m[2] - m[3], m[2], m[1])):
            if any(b[1] == m[1] and b[2] <= m[2] and m[3] <= b[3] for b in base):
                continue
            if all(k[2] > m[2] or m[3] > k[3] for k in kept):
                kept.append(m)
        assert licenses.detect(low, licenses.word_starts(low)) == sorted(base + kept, key=lambda m: (m[2], m[3], m[1]))


def test_finite_components_of_any_size(spark):
    from filingrisk.llm import neighbours

    rng = np.random.default_rng(4)
    made = rng.standard_normal((60, 6)) * 10.0 ** rng.choice([-200, -3, 0, 3, 200], (60, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(made)], "vec_id long, embedding array<double>")
    unit = made / np.abs(made).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    got = defaultdict(list)
    for r in sorted(neighbours.nearest(df, F.col("vec_id") % 10 == 0, k=5).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append((r.vec_id, r.score))
    for q in range(0, 60, 10):
        scores = unit @ unit[q]
        scores[q] = -2
        assert [v for v, _ in got[q]] == np.argsort(-scores)[:5].tolist()
        assert all(abs(s - scores[v]) < 1e-12 for v, s in got[q])
