"""Runs of words against a definition-by-definition search, and the query over the small table."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from filingrisk.llm import catalog, periodic


def lyndon(word):
    """Length of the longest Lyndon word at each place: up to the next smaller suffix."""
    ends = []
    for i in range(len(word)):
        j = i + 1
        while j < len(word) and word[i:] < word[j:]:
            j += 1
        ends.append(j - i)
    return ends


def plain_runs(words, min_length=24, min_periods=3):
    found = []
    for p in range(1, len(words) // min_periods + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            n = j - i + p
            if j > i and n >= max(min_length, min_periods * p) and not any(s <= i and i + n <= s + m for s, m, _ in found):
                found.append((i, n, p))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(3))
def test_groups_and_runs(seed):
    rng = random.Random(seed)
    for _ in range(300):
        word = rng.choices(range(rng.choice([1, 2, 3, 6])), k=rng.randint(1, 40))
        group, length = periodic.group_suffixes(np.array(word))
        assert length.tolist() == lyndon(word)
        roots = {tuple(word[i : i + n]) for i, n in enumerate(length)}
        assert len(roots) == len({(g, tuple(word[i : i + n])) for i, (g, n) in enumerate(zip(group, length, strict=True))}) == len(set(group.tolist()))
        for least, periods in ((1, 2), (4, 2), (6, 3), (9, 3), (10, 4)):
            assert periodic.word_runs(word, least, periods) == plain_runs(word, least, periods)
        longer = word + rng.choices(word, k=rng.randint(1, 12)) * rng.randint(2, 6) + word
        assert periodic.word_runs(longer) == plain_runs(longer)


def test_runs_that_overlap_and_lie_in_each_other():
    inner = ["a"] * 24 + ["b"]
    assert periodic.word_runs(inner * 3) == [(0, 24, 1), (0, 75, 25), (25, 24, 1), (50, 24, 1)]


def test_edges(spark):
    schema = "doc_id long, text string, runs string, words int, collapsed double"
    long = "x y z " * 60_000
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a " * 23), (5, "a " * 24), (5, "a " * 24), (None, "b\x0bc\x0cb\rc " * 6), (6, long), (7, "a\xa0b " * 30)]
    docs = spark.createDataFrame([(d, t, "clash", 1, 0.5) for d, t in rows], schema)
    got = {}
    for r in periodic.find_runs(docs).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, [tuple(x) for x in r.runs], r.collapsed))
    assert got[1] == got[2] == got[3] == [(0, [], "")]
    assert got[4] == [(23, [], " ".join("a" * 23))]
    assert got[5] == [(24, [(0, 24, 1)], "a")] * 2
    assert got[None] == [(24, [(0, 24, 2)], "b c")]
    assert got[6] == [(180_000, [(0, 180_000, 3)], "x y z")]
    assert got[7] == [(30, [(0, 30, 1)], "a\xa0b")]
    assert periodic.find_runs(docs.where("false")).count() == 0


def test_query_against_plain_search(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").where(F.length("text") < 12_000).select("doc_id", "text").collect()
    got = {r.doc_id: r for r in catalog.QUERIES["op11_periodic_runs"](spark, folder).collect()}
    some = 0
    for row in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", row.text or "")
        n, h = len(words), zlib.crc32(str(row.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words)
        dropped = {i for s, m, p in runs for i in range(s + p, s + m)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        want = (
            len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)),
        )
        assert tuple(got[row.doc_id])[1:] == want
        some += bool(runs)
    assert some > 10
