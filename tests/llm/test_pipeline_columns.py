"""Stages over documents with columns of any name and type, null, empty, long and repeated rows; the entry without the operators."""

import datetime
import shutil
import subprocess
import sys
from decimal import Decimal
from pathlib import Path

import pytest

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]
EXTRA = (
    "score string, rejected int, lang_pred date, kept_id string, text_key string, spans array<double>, secret_key decimal(20,3), "
    "made timestamp, small smallint, byte tinyint, raw binary, pairs map<string, int>, inner struct<a: int, text: string>, text_0 string, key string"
)


def extra(i):
    day = datetime.date(2020, 1, 1) + datetime.timedelta(days=i)
    return (
        f"s{i}", i, day, "k", "t", [0.5, None], Decimal(i) / 8, datetime.datetime(2021, 5, 6, 7, 8, 9, i), i % 100, 1, bytes([i % 256]), {"x": i},
        (i, "inner"), None, "key",
    )


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").limit(80).collect()]
    words = " ".join(rows[0][1].split()[:60]) + " of the and"
    rows += [(9001, None, "en", None, None), (9002, "", None, None, 0), (9003, "12 34", "en", None, 5), (None, "no id " + words, "en", None, 9), (9004, (words + " ") * 400, "en", None, 1)]
    rows += [rows[5], rows[5], (rows[6][0], "another text " + words, "en", None, 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA
    made = spark.createDataFrame([(*r, *extra(i)) for i, r in enumerate(rows)], schema)
    return made.cache()


def rows_of(df):
    return {(r.doc_id, r.score): r for r in df.collect()}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_other_columns_stay(spark, docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    before, made = rows_of(docs), stage(spark, docs, FOLDER)
    assert made.schema.simpleString() == docs.schema.simpleString()
    after = rows_of(made)
    assert after and set(after) <= set(before)
    for k, r in after.items():
        for c in docs.columns:
            if name != "secret_scan" or c not in ("text", "n_chars"):
                assert r[c] == before[k][c], c
    if name == "language_id":
        assert not {9001, 9002, 9003} & {k[0] for k in after}
    else:
        assert {9001, 9002, 9003, None} <= {k[0] for k in after}
    if name == "near_dedup":
        again = docs.where("doc_id = 9004").collect()[0].doc_id
        assert again in {k[0] for k in after}
    if name == "secret_scan":
        assert len(made.collect()) == docs.count()
    assert stage(spark, docs.where("false"), FOLDER).count() == 0


def test_repeated_ids(spark, docs):
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER).collect()
    texts = [(r.doc_id, r.text) for r in kept]
    assert len(texts) == len(set(texts))


def test_last_stage(spark, docs):
    made = corpus_pipeline.encode(spark, docs, FOLDER)
    assert made.count() == docs.count() and made.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]


def test_entry_without_the_operators(tmp_path):
    """The folders and the pipeline file may be absent, together or one of them, or what they import."""
    for case in ("none", "folders", "pipeline", "import"):
        copy = tmp_path / case
        copy.mkdir()
        for name in ("__spark_entry__.py", "corpus_pipeline.py", "catalog", "filingrisk"):
            source = ROOT / name
            (shutil.copytree if source.is_dir() else shutil.copy)(source, copy / name)
        if case in ("folders", "none"):
            shutil.rmtree(copy / "filingrisk" / "llm")
        if case in ("pipeline", "none"):
            (copy / "corpus_pipeline.py").unlink()
        block = "import sys; sys.modules['public_tokenizers'] = None; " if case == "import" else ""
        code = f"{block}import __spark_entry__ as e; q = e.queries(); print(len(q), 'op1_language_id' in q, 'pipeline' in q)"
        out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=True).stdout.split()
        assert int(out[0]) > 150 and out[1] == str(case == "pipeline") and out[2] == "False"
