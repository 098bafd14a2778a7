"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from filingrisk.llm import bpe, catalog, chat, decontaminate, huffman, langid, licenses, neardup, neighbours, secretscan, vocabulary, warc
from filingrisk.llm.catalog import new_folder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, node long, score string"


@pytest.fixture(scope="module")
def docs(spark):
    long = "one two three four five six " * 20_000
    rows = [(1, None), (2, ""), (3, "a b c d e f g h"), (3, "a b c d e f g h"), (4, "a b c d e f g h"), (None, "no id here at all"), (5, long), (6, "x" * 90_000)]
    return spark.createDataFrame([(d, t, "en", None, None, "clash", 7, None) for d, t in rows], DOCS)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def by_id(rows, *fields):
    return sorted(((r.doc_id, *(r[f] for f in fields)) for r in rows), key=repr)


def test_bpe(docs, none):
    rows = bpe.encode_documents(docs, BYTE, decoded=True, task_chars=20_000).collect()
    made = vocabulary.tokenizer(BYTE)
    want = [(r.doc_id, made.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()]
    assert by_id(rows, "ids") == sorted(((d, bytearray(np.array(i, dtype="<u4").tobytes())) for d, i in want), key=repr)
    assert {(r.doc_id, r.decoded) for r in rows} == {(r.doc_id, r.text or "") for r in docs.collect()}
    assert {(r.doc_id, r.decoded) for r in bpe.decode_documents(bpe.encode_documents(docs, BYTE), BYTE).collect()} == {(r.doc_id, r.text or "") for r in docs.collect()}
    assert bpe.encode_documents(none, BYTE).count() == 0


def random_text(rng):
    runs = [
        lambda: "".join(rng.choices("abcdetheningonst", k=rng.randint(1, 600))),
        lambda: "".join(rng.choices("0123456789", k=rng.randint(1, 300))),
        lambda: "".join(rng.choices("中文字符日本語", k=rng.randint(1, 200))),
        lambda: "".join(rng.choices("!-=.'", k=rng.randint(1, 200))),
        lambda: "".join(rng.choices(" \n\t", k=rng.randint(1, 100))),
        lambda: " ".join(rng.choices(["the", "don't", "'ll", "café", "<|endoftext|>", "😀", "<|endof", "Ω", "\x1c", "12"], k=rng.randint(1, 90))),
    ]
    return "".join(rng.choice(runs)() for _ in range(rng.randint(1, 4)))


@pytest.mark.parametrize("seed", range(4))
def test_tree_concatenation_equals_the_library(seed):
    rng, made = random.Random(seed), vocabulary.tokenizer(BYTE)
    for _ in range(40):
        text = random_text(rng)
        want = made.encode(text, add_special_tokens=False).ids
        for leaf in (8, 60, 4096):
            assert bpe.encode_text(text, BYTE, leaf).tolist() == want
        assert bpe.decode_ids(np.array(want, dtype="<u4").tobytes(), BYTE) == made.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pieces_equal_the_library(path):
    known, rng = vocabulary.EncodedPieces(path), random.Random(1)
    marks = ["a", "The", "é", "ÉÇ", "'s", "'LL", "'", ".", "!!", "12", "½", "³", "\xad", "<|", "ß", "µ", "Ω", "́", "DON'T", "<|endoftext|>", "\x85"]
    for _ in range(3000):
        text = "".join(rng.choices(marks, k=rng.randint(1, 8)))
        assert np.frombuffer(known[text], dtype="<u4").tolist() == known.tokenizer.encode(text, add_special_tokens=False).ids


def test_huffman_files(spark, docs, none):
    for rows, blocks in ((docs, 1 << 18), (docs, 1), (none, 10)):
        at = new_folder(spark, "ids")
        huffman.write_ids(huffman.tokenize(rows, WORD, 1), at, 3, block_tokens=blocks)
        back = huffman.read_ids(spark, at).collect()
        made = vocabulary.tokenizer(WORD)
        want = [[*made.encode(r.text or "", add_special_tokens=False).ids, 1] for r in rows.collect()]
        assert sorted(bytes(r.ids) for r in back) == sorted(np.array(x, dtype="<u4").tobytes() for x in want)
        place = sorted(back, key=lambda r: r.start)
        assert [r.start for r in place] == np.cumsum([0, *(r.n_tokens for r in place)])[:-1].tolist()
        assert [r.doc_id for r in place] == sorted((r.doc_id for r in back), key=lambda d: (d is not None, d))


@pytest.mark.parametrize("n,bits", [(1, 18), (2, 18), (5, 3), (300, 9), (3000, 12), (40, 6)])
def test_limited_codes(n, bits):
    rng = np.random.default_rng(n)
    ids = np.sort(rng.choice(49_000, n, replace=False))
    counts = {int(i): int(1 + 1e6 / (k + 1) ** 2) for k, i in enumerate(ids)}
    lengths = huffman.code_lengths(counts, bits)
    assert max(lengths.values()) <= bits and sum(2.0**-v for v in lengths.values()) <= 1
    free = huffman._plain_lengths(sorted(counts.values())) if n > 1 else [1]
    merged = huffman._package_merge(np.array(sorted(counts.values()), dtype=float), 40) if n > 1 else [1]
    assert np.dot(free, sorted(counts.values())) == np.dot(merged, sorted(counts.values()))
    book = huffman.Codebook(np.array(sorted(lengths)), np.array([lengths[i] for i in sorted(lengths)]))
    sizes = rng.choice([0, 1, 255, 256, 257, 900], 12)
    stream = rng.choice(ids, sizes.sum())
    payloads, marks = book.encode(stream, sizes, 256)
    for own, mark, part in zip(payloads, marks, np.split(stream, np.cumsum(sizes)[:-1]), strict=True):
        assert book.decode(own, mark, 256, book.tables()).ravel()[: len(part)].tolist() == part.tolist()


def test_language_id(spark, docs, none):
    model = langid.fit(none)
    assert {r.lang_pred for r in langid.classify(docs, model, ["doc_id"]).collect()} == {"und"}
    taught = spark.createDataFrame([("the cat sat on the mat", "en"), ("der hund und die katze", "de"), (None, "en"), ("123", None), ("!!", "fr")], "text string, lang string")
    model = langid.fit(taught)
    rows = langid.classify(docs.withColumn("text", F.when(F.col("doc_id") == 3, "the mat and the cat").otherwise(F.col("text"))), model, ["doc_id", "key"]).collect()
    got = {r.doc_id: (r.lang_pred, r.rejected) for r in rows}
    assert got[1] == got[2] == ("und", True) and got[3] == ("en", False) and len(rows) == 8
    other = langid.classify(spark.createDataFrame([("完全不同的文字在这里",)], "text string"), model, []).first()
    assert other.rejected


def test_licenses(docs, none, spark):
    rows = licenses.scan_licenses(docs).collect()
    assert len(rows) == 8 and all(r.labels == "" and r.score == 0 for r in rows)
    assert licenses.scan_licenses(none).count() == 0
    scan = lambda text: licenses.scan(text)
    assert scan("Licensed under the GNU General Public License, version 3.")[4:6] == ("gpl", "gpl,gpl-3.0")
    # Contained in the longer, versioned name: no label of its own.
    assert scan("GNU Lesser General Public License version 2.1")[5] == "lgpl-2.1"
    assert scan("AGPLv3 text")[5] == "agpl-3.0"
    assert scan("CC BY-SA 4.0")[5] == "cc-by,cc-by-sa-4.0"
    assert len(licenses.compiled()) > 200


def test_near_duplicates(spark, docs, none):
    got = by_id(neardup.near_duplicates(docs, k=2).collect(), "n_shingles", "component_id", "kept")
    want = [(1, 0, 1, True), (2, 0, 2, True), (3, 7, 3, True), (3, 7, 3, True), (4, 7, 3, False), (None, 4, None, True), (5, 6, 5, True), (6, 1, 6, True)]
    assert got == sorted(want, key=repr)
    assert neardup.near_duplicates(none).count() == 0


def test_near_duplicates_against_all_pairs(spark):
    """A chain of edits, in which few members are alike, and noise."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    rows, text = [], rng.choices(words, k=120)
    for i in range(160):
        at = rng.randrange(0, 110)
        text = text[:at] + rng.choices(words, k=rng.choice([1, 2, 5, 9])) + text[at + 4 :]
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join(rng.choices(words[:60], k=rng.randint(1, 30)))) for i in range(150)]
    sets = {d: set(zip(t.split(), t.split()[1:])) or {t} for d, t in rows}
    label = {d: d for d in sets}

    def root(d):
        return d if label[d] == d else root(label[d])

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                label[high] = low
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()
    assert {r.doc_id: r.component_id for r in got} == {d: root(d) for d in sets}


def test_posterior_bounds():
    least = neardup.least_matches(80)
    assert least == sorted(least) and all(m < n for m, n in zip(least, range(neardup.BATCH, neardup.CHECKED + 1, neardup.BATCH)))


def test_leaks(spark, docs, none):
    item = "A train leaves Boston at 5 km per hour and Alice sees 12 birds near the old red barn before noon today"
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "short one here")], "item_id long, text string")
    changed = item.replace("Boston", "Denver").replace("12", "977").replace("Alice", "Robert")
    rows = [(10, f"Intro words. {item} And more."), (11, changed), (12, None), (13, "nothing of the kind"), (13, "nothing of the kind"), (14, "so short one here it is")]
    leaks = {r.doc_id: r for r in decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert set(leaks) == {10, 11, 14} and leaks[10].same_slots and not leaks[11].same_slots and leaks[14].item_id == 4
    twice = "Alice saw 4 birds and then 4 more birds flew over the barn while 4 dogs slept near it"
    spoilt = twice.replace("4 dogs", "5 dogs")
    asked = spark.createDataFrame([(1, twice)], "item_id long, text string")
    given = spark.createDataFrame([(1, spoilt), (2, twice.replace("4", "6"))], "doc_id long, text string")
    # One changed number leaves verbatim windows, which count alone; numbers changed alike are a re-parameterised question.
    assert {r.doc_id: r.same_slots for r in decontaminate.find_leaks(given, asked).collect()} == {1: True, 2: False}
    assert decontaminate.find_leaks(none, items).count() == 0
    assert decontaminate.find_leaks(docs, items.where("false")).count() == 0


def test_secrets(spark, docs, none):
    text = "user = bob\nwJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY https://s3.example.com/x"
    rows = [(1, text, 0), (2, None, 3), (3, "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY" + " x" * 400 + " user=bob", 1), (4, 'é token="abcdef12"', 9), (4, 'é token="abcdef12"', 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = sorted((r.doc_id, r.s) for r in secretscan.find_secrets(df, ["doc_id"]).select("doc_id", secretscan.shown("spans").alias("s")).collect())
    assert got == [(1, "identifier:0:10,secret:11:51,endpoint:52:76"), (2, ""), (3, ""), (4, "assign:2:17"), (4, "assign:2:17")]
    masked = {r.doc_id: (r.text, r.n_chars) for r in secretscan.redact(df).collect()}
    assert masked[1] == ("[SECRET]\n[SECRET] [SECRET]", 26) and masked[2] == (None, 3) and masked[4] == ('é [SECRET]"', 11)
    assert secretscan.find_secrets(docs, ["doc_id"]).count() == 8 and secretscan.redact(none).count() == 0
    assert secretscan.redact(docs).columns == docs.columns


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(60)] + [(100 + i, [1.0] * 8) for i in range(40)]
    rows += [(200, None), (201, [0.0] * 8), (202, [1.0, None] + [0.0] * 6), (203, [float("nan")] * 8), (204, [1.0, 2.0]), (None, [1.0] * 8), (105, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, node string")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 10 == 0, k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {*range(0, 60, 10), 100, 110, 120, 130}
    assert [v for _, v, _ in sorted(got[100])] == [101, 102, 103, 104, 105]
    good = {i: np.array(v) for i, v in rows if v and i is not None and i < 200}
    for q, found in got.items():
        cosine = lambda v: float(good[q] @ good[v] / np.linalg.norm(good[q]) / np.linalg.norm(good[v]))
        best = sorted((-round(cosine(v), 12), v) for v in good if v != q)[:5]
        assert [v for _, v, _ in sorted(found)] == [v for _, v in best]
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in neighbours.nearest(two, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 0.0)]
    assert neighbours.nearest(two.where("false"), F.col("vec_id") == 0).count() == 0


def test_warc(spark):
    rows = [(2, "http://b\r\nX: y", "same", "t"), (1, None, "same", "t"), (3, "u", None, "t"), (4, "u", "", "t"), (5, "u", "é", "t"), (5, "u", "é", "t"), (None, "u", "same", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    at = new_folder(spark, "warc")
    warc.write_archive(pages, at)
    records = warc.read_archive(spark, at)
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.record_digests(records).collect()), key=repr)
    want = [(1, 4, "response", None), (2, 4, "revisit", 1), (3, 0, "response", None), (4, 0, "revisit", 3), (5, 2, "response", None), (5, 2, "response", None), (None, 4, "revisit", 1)]
    assert got == sorted(want, key=repr)
    assert spark.read.parquet(f"{at}/payloads").count() == 3
    assert all(r.record.count(b"\r\n\r\n") >= 2 and b"\nX: y" not in r.record for r in records.collect())
    empty = new_folder(spark, "warc")
    warc.write_archive(pages.where("false"), empty)
    assert warc.read_archive(spark, empty).count() == 0
    # Short payloads are never shared.
    short = new_folder(spark, "warc")
    warc.write_archive(pages, short, min_bytes=5)
    assert {r.record_type for r in warc.record_digests(warc.read_archive(spark, short)).collect()} == {"response"}


def test_chats(spark):
    rows = [
        (1, 2, "assistant", "b ~ <|im_end|>~1"), (1, 1, "user", "a<"), (1, 3, "assistant", None), (1, 4, "sys\ntem", "x"), (1, 4, "sys\ntem", "x"),
        (2, 1, None, "~0<~1"), (None, None, "assistant", ""),
    ]
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, segments string")
    made = chat.format_chats(df)
    got = {r.conv_id: r for r in chat.parse_chats(made).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", "a<"), ("assistant", "b ~ <|im_end|>~1"), ("assistant", ""), ("sys\ntem", "x"), ("sys\ntem", "x")]
    assert [tuple(t) for t in got[2].turns] == [("", "~0<~1")] and got[1].learned == ["b ~ <|im_end|>~1", ""]
    assert [tuple(t) for t in got[None].turns] == [("assistant", "")]
    assert got[1].formatted.count("<|im_start|>") == 3
    assert chat.format_chats(df.where("false")).count() == 0
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_registered():
    assert [f"op{n}" for n in range(1, 11)] == sorted((n.split("_")[0] for n in catalog.QUERIES), key=lambda n: int(n[2:]))
