import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from filingrisk import policy
from filingrisk.functions import text as tx
from filingrisk.operators import textscores
from filingrisk.plans import jobs
from filingrisk.sources import csv_records, facts, firm_years, json_arrays, profile_cache, submissions, tables


def record(cik, rep, text, **more):
    return {"cik": cik, "name": f"F{cik}", "sic": "3711", "filing_type": "10-K", "filing_date": "1-4-2006", "reporting_date": rep, "mda": text, **more}


def write_array(path, records, extra=()):
    lines = ["["] + [json.dumps(r) + "," for r in records] + list(extra) + ["]"]
    path.write_text("\n".join(lines), encoding="utf-8")
    return str(path)


def test_line_array(spark, tmp_path):
    records = [
        record(1, "31-12-2005", "a" * 250),
        record(1, "31-12-2005", "b" * 300),  # same id, later
        record("2", "31-02-2005", "c" * 300),  # no such day
        record(None, "31-12-2005", "d" * 300),
        record(3, "31-12-2005", "e" * 199),
        record(4, "31-12-2005", "f" * 500),
    ]
    path = write_array(tmp_path / "firm_years.json", records, ["{broken", ""])
    raw = firm_years.read_firm_years(spark, path)
    assert raw.count() == 6
    assert firm_years.count_bad_lines(spark, path).first().asDict() == {"n_lines": 7, "n_bad": 1}
    rows = firm_years.tidy_firm_years(raw, text_chars=400).orderBy("cik").collect()
    assert [(r["doc_id"], r["text_chars"], r["mda"][0], r["fyear"]) for r in rows] == [
        ("1_2005-12-31", 250, "a", 2005),
        ("4_2005-12-31", 400, "f", 2005),
    ]
    whole = firm_years.tidy_firm_years(raw).where("cik = 4").first()
    assert whole["text_chars"] == 500


def test_whole_array_and_one_firm(spark, tmp_path):
    path = tmp_path / "all.json"
    path.write_text(json.dumps([record(7, "31-12-2005", "x" * 300), record(8, "31-12-2005", "y" * 300)], indent=1))
    raw = firm_years.read_json_array(spark, str(path))
    assert firm_years.tidy_firm_years(raw).count() == 2
    labelled = spark.createDataFrame([(7, "7_known", 1)], "cik long, doc_id string, label int")
    assert [r["doc_id"] for r in firm_years.firm_years_of(labelled, raw, 7).collect()] == ["7_known"]
    other = firm_years.firm_years_of(labelled, raw, 8).first()
    assert (other["doc_id"], other["label"], other["source"]) == ("8_2005-12-31", 0, "raw")


def test_dataset_formats(spark, tmp_path):
    plain = tmp_path / "d.csv.gz"
    with gzip.open(plain, "wt", encoding="utf-8") as out:
        out.write('CIK, Fyear ,mda,total_assets\n1,2005,"two\nlines, ""quoted""",12.5\nx,2006,t,nan\n')
    rows = tables.read_dataset(spark, str(plain), multi_line=True).orderBy("fyear").collect()
    assert rows[0]["mda"] == 'two\nlines, "quoted"' and rows[0]["total_assets"] == 12.5
    assert rows[1]["cik"] is None and rows[1]["total_assets"] is None
    with pytest.raises(ValueError):
        tables.read_dataset(spark, "raw.json")


def test_arrays_survive_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, [2001, 2002])], "cik long, years array<int>")
    tables.write_table(df, str(tmp_path / "o.csv"))
    assert tables.read_csv(spark, str(tmp_path / "o.csv")).first()["years"] == "[2001,2002]"


def test_facts_and_submission_files(spark, tmp_path):
    (tmp_path / "facts").mkdir()
    body = {"cik": 5, "facts": {"us-gaap": {"Assets": {"units": {"USD": [{"fy": 2010, "fp": "FY", "form": "10-K", "filed": "2011-03-01", "val": 9}], "EUR": [{"fy": 2010, "val": 1}]}}}}}
    (tmp_path / "facts" / "CIK0000000005.json").write_text(json.dumps(body, indent=1))
    got = facts.read_facts(spark, str(tmp_path / "facts")).collect()
    assert [(r["cik"], r["tag"], r["pos"], r["val"]) for r in got] == [(5, "Assets", 0, 9.0)]

    (tmp_path / "main").mkdir()
    (tmp_path / "pages").mkdir()
    recent = {"form": ["8-K", "10-Q", "8-K/A"], "filingDate": ["2010-01-01", "2010-01-02", "bad"], "items": ["1.03", "", ""], "accessionNumber": ["a", "b", "c"]}
    (tmp_path / "main" / "CIK0000000009.json").write_text(json.dumps({"cik": "0000000009", "filings": {"recent": recent, "files": []}}))
    (tmp_path / "main" / "CIK0000000010.json").write_text("{oops")
    page = {"form": ["8-K"], "filingDate": ["2001-05-01"], "items": [None], "accessionNumber": ["old"]}
    (tmp_path / "pages" / "CIK0000000009-submissions-001.json").write_text(json.dumps(page))
    arrays = submissions.read_submission_arrays(spark, str(tmp_path / "main"), str(tmp_path / "pages"))
    rows = submissions.build_events(arrays).orderBy("accession").collect()
    assert [(r["cik"], r["accession"], r["items"]) for r in rows] == [(9, "a", "1.03"), (9, "old", "")]


def test_cache_latest_valid_entry_wins(spark, tmp_path):
    path = str(tmp_path / "cache")
    good = {"vagueness_score": 0.1, "redundancy_score": 0.2, "complexity_score": 0.3, "risk_sentiment": 0.4, "confidence": 0.5}
    for entry in ({**good}, {**good, "vagueness_score": 0.9}):
        df = spark.createDataFrame([("h1", json.dumps(entry)), ("h2", json.dumps({**good, "confidence": 7})), ("h3", "{")], "text_hash string, json string")
        profile_cache.append_cache(profile_cache.parse_entries(df), path, "a")
    profile_cache.append_cache(profile_cache.parse_entries(df), path, "b")
    rows = profile_cache.read_cache(spark, path, "a").collect()
    assert [(r["text_hash"], r["profile"]["vagueness_score"]) for r in rows] == [("h1", 0.9)]
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "00ab.json").write_text(json.dumps(good, indent=1))
    assert [r["text_hash"] for r in profile_cache.read_entry_files(spark, str(folder)).collect()] == ["00ab"]


def one(spark, text, col):
    return spark.createDataFrame([(text,)], "t string").select(col(F.col("t"))).first()[0]


def test_prepare_text(spark):
    raw = "A &amp; B &lt;b&gt;  <p>x</p> ##TABLE_START 1\n2 ##TABLE_END y ##TABLE_START z"
    assert one(spark, raw, tx.prepare_text) == "A & B x y ##TABLE_START z"
    assert one(spark, None, tx.prepare_text) == ""
    cut = one(spark, "h" * 50 + "t" * 50, lambda c: tx.prepare_text(c, max_chars=60))
    assert cut == "h" * 28 + tx.JOINER + "t" * 12 and len(cut) == 60 - 15


def test_text_hash(spark):
    import hashlib

    assert one(spark, "Ü text", tx.text_hash) == hashlib.sha256("Ü text".encode()).hexdigest()[:32]


TEXTS = {
    "plain": "The company sold ten thousand units in the last quarter and paid its suppliers in full.",
    "hedging": "We may possibly believe results could potentially be uncertain and might likely vary, subject to assumptions.",
    "negative": "Default and litigation led to impairment losses; a loss, a covenant breach and a loss followed the fraud investigation.",
    "positive": "Strong growth and improved profitability exceeded expectations with robust momentum and record success across units.",
    "short": "Too short.",
}


def profiles(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "doc_id string, text string")
    rows = textscores.text_features(df, text_col="text").collect()
    return {r["doc_id"]: r for r in rows}


def test_heuristic_profile(spark):
    got = profiles(spark)
    assert got["hedging"]["llm_vagueness_score"] > got["plain"]["llm_vagueness_score"]
    assert got["negative"]["llm_risk_sentiment"] < 0 < got["positive"]["llm_risk_sentiment"]
    assert got["short"]["llm_confidence"] == 0.0 and got["short"]["llm_vagueness_score"] == 0.5
    assert got["short"]["llm_risk_summary"] == "[fallback] text too short for analysis"
    assert "loss, default, litigation, impairment, losses" in got["negative"]["llm_risk_summary"]
    for r in got.values():
        for n in policy.PROFILE_SCORES:
            low = -1 if n == "risk_sentiment" else 0
            assert low <= r[f"llm_{n}"] <= 1
    assert tx.profile_feature_names() == [f"llm_{n}" for n in policy.PROFILE_SCORES]


def test_injected_scorer_falls_back_per_text(spark, tmp_path):
    log = str(tmp_path / "calls")

    def scorer(body):
        with open(log, "a") as out:
            out.write("x")
        if "hedg" in body or "may" in body:
            raise RuntimeError("down")
        high = 2.0 if "Strong" in body else 0.5
        return {"vagueness_score": high, "redundancy_score": 0.1, "complexity_score": 0.1, "risk_sentiment": 0.0, "risk_summary": "s" * 700}

    df = spark.createDataFrame([(k + i, v) for k, v in TEXTS.items() for i in "ab"], "doc_id string, text string")
    cached = textscores.prepared_texts(df.where("doc_id = 'shorta'"), "text", "doc_id").select(
        "text_hash", tx.fallback_profile("from cache").alias("profile")
    )
    rows = {r["doc_id"]: r for r in textscores.text_features(df, text_col="text", scorer=scorer, cache=cached).collect()}
    assert len(rows) == 10
    assert rows["plaina"]["llm_confidence"] == 0.5 and len(rows["plaina"]["llm_risk_summary"]) == 600
    assert rows["hedginga"]["llm_risk_summary"] == "[fallback] down" == rows["hedgingb"]["llm_risk_summary"]
    assert rows["positivea"]["llm_confidence"] == 0.0
    assert rows["shortb"]["llm_risk_summary"] == "[fallback] from cache"
    # Each distinct uncached text is scored once.
    assert len(open(log).read()) == 4


def test_repeated_feature_ids_do_not_multiply_rows(spark):
    left = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    right = spark.createDataFrame([("a", 1.0), ("a", 1.0)], "doc_id string, x double")
    assert textscores.join_text_features(left, right).count() == 2


def test_each_file_gets_its_reader(spark, tmp_path):
    """An array on one line, one printed with indents, and one with a record per line."""
    folder = tmp_path / "mixed"
    folder.mkdir()
    made = [record(i, "31-12-2005", "x" * 250) for i in range(1, 8)]
    (folder / "one.json").write_text(json.dumps(made[:3]))
    (folder / "pretty.json").write_text(json.dumps(made[3:5], indent=2))
    write_array(folder / "lines.json", made[5:], ["{broken"])
    raw = firm_years.read_firm_years(spark, str(folder))
    assert sorted(int(r["cik"]) for r in raw.collect()) == list(range(1, 8))
    assert firm_years.count_bad_lines(spark, str(folder)).first().asDict() == {"n_lines": 8, "n_bad": 1}


def small_splits(spark, size):
    """Splits of some bytes only, so that records, strings and escapes lie across them."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", size)
    spark.conf.set("spark.sql.files.minPartitionNum", 1)


@pytest.fixture
def splits(spark):
    names = ("maxPartitionBytes", "openCostInBytes", "minPartitionNum")
    before = {f"spark.sql.files.{n}": spark.conf.get(f"spark.sql.files.{n}", None) for n in names}
    yield lambda size: small_splits(spark, size)
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


TRICKY = ['}, {"a": 1', '{"cik": "9"},', "}}}{{{", '\\', '\\"}', "line\nbreak,\n{", "", "ü}ß{", '"},\n{"cik":"5"', "]", "[", "plain"]


@pytest.mark.parametrize("size", [37, 200, 1 << 20])
def test_arrays_of_any_shape_in_any_splits(spark, tmp_path, splits, size):
    rng = random.Random(size)
    made = [record(i, "31-12-2005", "".join(rng.choices(TRICKY, k=rng.randint(0, 6)))) for i in range(24)]
    (tmp_path / "one line [1].json").write_text(json.dumps(made[:8]))
    (tmp_path / "pretty.json").write_text(json.dumps(made[8:16], indent=2, ensure_ascii=False) + "\n")
    (tmp_path / "packed.json").write_text("[" + ",".join(json.dumps(r) for r in made[16:20]) + "\n]")
    write_array(tmp_path / "lines.json", made[20:])
    splits(size)
    raw = firm_years.read_firm_years(spark, str(tmp_path))
    assert {int(r.cik): r.mda for r in raw.collect()} == {r["cik"]: r["mda"] for r in made} and raw.count() == 24
    assert firm_years.count_bad_lines(spark, str(tmp_path)).first().asDict() == {"n_lines": 24, "n_bad": 0}
    ordered = raw.where(F.col("_file").contains("pretty")).orderBy(*firm_years.FILE_ORDER).collect()
    assert [int(r.cik) for r in ordered] == list(range(8, 16))


def test_objects_in_objects(spark, tmp_path, splits):
    path = tmp_path / "nested.json"
    made = [{"cik": i, "name": "n", "more": [{"a": {"b": [1, {"c": "}"}]}}, {"a": 2}]} for i in range(9)]
    path.write_text(json.dumps(made))
    splits(41)
    found = json_arrays.array_records(spark, str(path)).collect()
    assert sorted((json.loads(r.value) for r in found), key=lambda r: r["cik"]) == made and all(r.sound for r in found)


@pytest.mark.parametrize("bad", ["{", "[1, 2],", '{"cik": 3, "mda": "cut', "{broken", "nothing", '"'])
def test_one_bad_line_costs_one_record(spark, tmp_path, bad):
    made = [record(i, "31-12-2005", "x" * 250) for i in range(100)]
    lines = ["[", *(json.dumps(r) + "," for r in made), "]"]
    for at, name in ((50, "middle"), (2, "second"), (1, "first")):
        path = tmp_path / f"{name}.json"
        path.write_text("\n".join(lines[:at] + [bad] + lines[at:]))
        if name == "first" and bad == "{":
            continue  # that head is one of a printed array, see below
        assert firm_years.read_firm_years(spark, str(path)).count() == 100
        assert firm_years.count_bad_lines(spark, str(path)).first().asDict() == {"n_lines": 101, "n_bad": 1}


@pytest.mark.parametrize("size", [300, 1 << 20])
@pytest.mark.parametrize("bad", ["{", "{broken},", '{"cik": 3, "mda": "cut', '{"cik": 3, "mda": "x" "y"},', "nothing,"])
def test_damage_in_whole_arrays(spark, tmp_path, splits, size, bad):
    made = [record(i, "31-12-2005", 'x "quoted" } ' * 20) for i in range(30)]
    texts = [json.dumps(r) + "," for r in made]
    path = tmp_path / "damaged.json"
    path.write_text("[" + "\n".join(texts[:15] + [bad] + texts[15:]) + "]")
    splits(size)
    rows = firm_years.firm_year_records(spark, str(path)).collect()
    read = [r for r in rows if r.parsed]
    assert {int(r.cik) for r in read} >= {r["cik"] for r in made} - {15} and {r.mda for r in read} == {made[0]["mda"]}
    # Damage that leaves quotes and braces matched takes the record it stands before with it.
    assert len(read) == (29 if bad == "nothing," else 30) and len(rows) - len(read) == 1
    assert all(r.unread for r in rows if not r.parsed)


def test_heads_decide(spark, tmp_path):
    made = [record(i, "31-12-2005", "x" * 250) for i in range(3)]
    heads = {
        "a": ("lines", "[\n" + ",\n".join(map(json.dumps, made)) + "\n]"),
        "b": ("lines", "\n\n" + "\n".join(map(json.dumps, made))),
        "c": ("whole", "[\n{\n" + json.dumps(made[0])[1:] + "\n]"),
        "d": ("whole", json.dumps(made)),
        "e": ("whole", json.dumps(made[0], indent=1)),
        "f": ("lines", "[\n]"),
    }
    for name, (_, text) in heads.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = json_arrays.file_modes(spark, str(tmp_path))
    assert {n[-6]: mode for mode, names in got.items() for n in names} == {n: mode for n, (mode, _) in heads.items()}
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "empty.json").write_text("")
    assert firm_years.read_firm_years(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("size", [23, 150, 1 << 20])
def test_quoted_line_breaks_in_any_splits(spark, tmp_path, splits, size):
    rng = random.Random(size)
    bits = ["a", 'say ""no""', "x,y", "two\nlines", "\n\n", "", "end\n", "wïde", ",", "1"]
    folder = tmp_path / "csv"
    folder.mkdir()
    want = []
    for name, n, end in (("a.csv", 40, "\n"), ("b.csv", 25, "\r\n"), ("c.csv", 0, "\n")):
        rows = ['"I D",b,"long\nhead"']
        for i in range(n):
            text, last = "".join(rng.choices(bits, k=3)), rng.choice(["", "z", '""', "q w"])
            rows.append(f'{name}{i},"{text}",{last}')
            # As from Spark's own reader, an empty field is NULL, quoted or not.
            want.append((f"{name}{i}", text.replace('""', '"') or None, None if last in ("", '""') else last))
        (folder / name).write_bytes((end.join(rows) + rng.choice(["", end])).encode())
    splits(size)
    got = tables.read_csv(spark, str(folder), multi_line=True)
    assert got.columns == ["i d", "b", "long\nhead"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    if size < 1000:
        assert csv_records.csv_records(spark, str(folder)).count() == 68
        assert spark.read.option("lineSep", "\n").text(str(folder)).rdd.getNumPartitions() > 10


def test_scoring_rows_of_a_split_list(spark, tmp_path, splits):
    made = [{"CIK": i, "name": "n } {", "total_assets": i / 2 if i % 3 else None, "tags": [{"a": 1}, {"a": 2}]} for i in range(30)]
    (tmp_path / "list.json").write_text(json.dumps(made, indent=1))
    (tmp_path / "one.json").write_text(json.dumps(made[4]))
    splits(100)
    rows = tables.read_scoring_rows(spark, str(tmp_path / "list.json")).orderBy("cik").collect()
    assert [(r.cik, r.name, r.total_assets, len(r.tags)) for r in rows] == [(m["CIK"], m["name"], m["total_assets"], 2) for m in made]
    assert tables.read_scoring_rows(spark, str(tmp_path / "one.json")).first().cik == 4


def test_precompute_scores_each_text_once(spark, tmp_path):
    calls, path = spark.sparkContext.accumulator(0), str(tmp_path / "cache")
    df = spark.createDataFrame([(1, "good text"), (2, "good text"), (3, "bad")], "doc_id long, mda string")

    def scorer(body):
        calls.add(1)
        if body == "bad":
            raise ValueError("no answer")
        return {"vagueness_score": 0.5, "redundancy_score": 0.5, "complexity_score": 0.5, "risk_sentiment": 0.0}

    def run(**options):
        rows = jobs.precompute_text(df, scorer, path, "m", **options).collect()
        return calls.value, {r["doc_id"]: r["llm_vagueness_score"] for r in rows}

    want = {1: 0.5, 2: 0.5, 3: None}
    assert run() == (2, want)
    assert run() == (3, want)  # only the failed text is asked again
    assert run(refresh=True) == (5, want)
