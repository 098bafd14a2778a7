"""Each query over the smallest tables: check SQL, or a brute-force version."""

import hashlib
import re
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from compare import connect, differences
from conftest import DATA
from tokenizers import Tokenizer

from filingrisk.llm import bpe, catalog, decontaminate, secretscan

FOLDER = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.fixture(scope="module")
def docs(con):
    return con.execute("select doc_id, coalesce(text, ''), lang from documents order by doc_id").fetchall()


def run(spark, name):
    return catalog.QUERIES[name](spark, FOLDER).collect()


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.mark.parametrize("name", sorted(catalog.CHECK_SQL))
def test_matches_sql(spark, con, name):
    assert not differences(catalog.QUERIES[name](spark, FOLDER), con, catalog.CHECK_SQL[name])


def test_op1_held_out_accuracy(spark, docs):
    langs = {d: lang for d, _, lang in docs}
    rows = run(spark, "op1_language_id")
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    tested = [r for r in rows if r.held_out and langs[r.doc_id]]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in tested]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_op2_base_columns(spark, docs):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    got = {r.doc_id: r for r in run(spark, "op2_license_scan")}
    for d, text, _ in docs:
        words = word.findall(text.translate(lower))
        at = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        r, starts, labels = got[d], [i for i, _ in at], {x for _, x in at}
        assert (r.n_words, r.n_base) == (len(words), len(at))
        assert (r.first_word, r.last_word) == (min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted(labels))
        assert labels <= set(r.labels.split(","))


def test_op4_ids_in_order(spark, docs):
    made, at = library("word_bpe_49k.json"), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in run(spark, "op4_huffman_ids")}
    for d, text, _ in docs:
        ids = [*made.encode(text, add_special_tokens=False).ids, 1]
        assert got[d] == (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)


def test_op5_recall(spark, con):
    rows = con.execute("select vec_id, embedding from embeddings order by vec_id").fetchall()
    ids, units = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    got = defaultdict(list)
    for r in sorted(run(spark, "op5_nearest_neighbours"), key=lambda r: r["rank"]):
        got[r.query_id].append((r.vec_id, r.score))
    hits = []
    for i in np.flatnonzero(ids % 50 == 0):
        scores = units @ units[i]
        scores[i] = -9
        best = np.lexsort((ids, -scores))[:5]
        assert all(abs(s - scores[ids == v][0]) < 1e-12 for v, s in got[ids[i]])
        hits += [v in {x for x, _ in got[ids[i]]} for v in ids[best]]
    assert np.mean(hits) >= 0.9


def test_op7_round_trip(spark, docs):
    made = library("byte_bpe_50k.json")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, "op7_bpe_round_trip")}
    for d, text, _ in docs:
        ids = made.encode(text, add_special_tokens=False).ids
        back = made.decode(ids, skip_special_tokens=False)
        assert got[d] == (len(ids), sha(np.array(ids, dtype="<u4").tobytes()), sha(back.encode()))


def test_op8_finds_whole_items(spark, docs, con):
    items = con.execute("select item_id, text from benchmark").fetchall()
    whole = {(d, i) for i, item in items for d, text, _ in docs if item in text}
    got = {(r.doc_id, r.item_id) for r in run(spark, "op8_template_leaks")}
    assert whole and whole <= got
    flat = lambda t: re.findall(r"\w+", t.lower())
    shared = lambda a, b: set(zip(*(a[i:] for i in range(8)))) & set(zip(*(b[i:] for i in range(8))))
    texts, asked = {d: flat(t) for d, t, _ in docs}, {i: flat(t) for i, t in items}
    assert all(shared(texts[d], asked[i]) for d, i in got)


def brute_secrets(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(secretscan.ASSIGN, text, re.I | re.A) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(secretscan.ACCESS, text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer(secretscan.HEX, text) if len(m[0]) >= 24])


def test_op9_base_spans(spark, docs):
    got = {r.doc_id: r for r in run(spark, "op9_secret_scan")}
    for d, text, _ in docs:
        spans = brute_secrets(text)
        shown = [f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in spans]
        assert [got[d].n_assign, got[d].n_access, got[d].n_hex] == [sum(k == x for _, k, _ in spans) for x in range(3)]
        assert got[d].base_sha256 == sha(",".join(shown).encode())
        assert set(shown) <= set(got[d].spans.split(",")) | {""}


def test_pipeline_against_its_parts(spark, docs):
    """The stages' rows from brute-force groups, whole items, masked spans and the library's ids."""
    shingles = {}
    for d, text, _ in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
        shingles[d] = set(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else {tuple(w)} if w else set()
    label = {d: d for d in shingles}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(shingles)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = shingles[a], shingles[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((root(a), root(b)))
                label[high] = low
    leaks = decontaminate.find_leaks(
        spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    )
    leaked = {r.doc_id for r in leaks.collect()}
    path, want = public_tokenizers.path("byte_bpe_50k.json"), {}
    for d, text, _ in docs:
        if root(d) == d and d not in leaked and re.search(r"[^\W\d_]", text):
            out, at = "", 0
            for start, _, end in brute_secrets(text):
                if start >= at:
                    out += text[at:start] + secretscan.MASK
                at = max(at, end)
            want[d] = sha(bpe.encode_text(out + text[at:], path).astype("<u4").tobytes())
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert got == want
