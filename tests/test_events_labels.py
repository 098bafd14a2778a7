from datetime import date

import pytest
from pyspark.sql import functions as F

from filingrisk.operators import events as ev
from filingrisk.operators import labels
from filingrisk.sources.enforcement import tidy_enforcement
from filingrisk.sources.submissions import extract_events

D = date.fromisoformat


def events_of(spark, *rows):
    data = [(c, D(d) if d else None, i, f"a{n}") for n, (c, d, i) in enumerate(rows)]
    return spark.createDataFrame(
        data, "cik long, filing_date_8k date, items string, accession string"
    )


def years_of(spark, *rows):
    data = [(c, D(r) if r else None, D(f) if f else None, f"{c}_{r}") for c, r, f in rows]
    return spark.createDataFrame(
        data, "cik long, reporting_date date, filing_date date, doc_id string"
    )


def by_doc(df, column):
    return {r["doc_id"]: r[column] for r in df.collect()}


def test_horizon_end_is_included(spark):
    years = years_of(spark, (1, "2010-12-31", None), (2, "2010-12-31", None))
    events = events_of(
        spark, (1, "2011-12-31", "1.03"), (2, "2012-01-01", "1.03"), (9, "2020-01-01", "8.01")
    )
    out = by_doc(labels.attach_default_labels(years, events), "label_default")
    assert out == {"1_2010-12-31": 1, "2_2010-12-31": 0}


def test_censored_zeros_go_and_ones_stay(spark):
    years = years_of(
        spark, (1, "2010-12-31", None), (1, "2012-12-31", None), (2, "2012-12-31", None), (3, None, None)
    )
    events = events_of(spark, (2, "2013-03-01", "1.03"), (1, "2013-06-01", "8.01"))
    out = by_doc(labels.attach_default_labels(years, events), "label_default")
    assert out == {"1_2010-12-31": 0, "2_2012-12-31": 1}


def test_no_event_censors_nothing(spark):
    years = years_of(spark, (1, "2010-12-31", None))
    none = events_of(spark, (1, "2011-01-01", "8.01")).where("false")
    assert labels.attach_default_labels(years, none).count() == 1


def test_rows_after_bankruptcy_go(spark):
    years = years_of(spark, (1, "2009-12-31", None), (1, "2010-06-30", None), (1, "2011-12-31", None))
    events = events_of(spark, (1, "2010-06-30", "1.03"), (9, "2030-01-01", "8.01"))
    out = by_doc(labels.attach_default_labels(years, events), "label_default")
    assert out == {"1_2009-12-31": 1}
    kept = labels.attach_default_labels(years, events, drop_post_bankruptcy=False)
    assert kept.count() == 3


def test_numbering_changes_at_the_switch(spark):
    events = events_of(
        spark,
        (1, "2004-08-22", "3, 4 ,6"),
        (2, "2004-08-23", "1.03,4.01"),
        (3, "2005-01-01", "3.01"),
        (4, "2003-01-01", "3.01"),
        (5, None, "1.03"),
    )
    new = {r["cik"]: r for r in ev.mark_concepts(events).collect()}
    assert not new[1]["is_bankruptcy"] and new[2]["is_bankruptcy"]
    assert new[3]["is_delisting"] and not new[3]["is_bankruptcy"]
    assert not new[5]["is_bankruptcy"]
    old = {r["cik"]: r for r in ev.mark_concepts(events, trust_legacy_regime=True).collect()}
    assert old[1]["is_bankruptcy"] and old[1]["is_auditor_change"] and old[1]["is_officer_departure"]
    assert not old[4]["is_bankruptcy"] and not old[4]["is_delisting"]


def test_annotation_keeps_rows(spark):
    years = years_of(spark, (1, "2010-12-31", None), (1, "2012-12-31", None), (2, None, None))
    events = events_of(spark, (1, "2011-06-01", "1.03"), (1, "2012-06-01", "1.03"))
    out = labels.annotate_default_labels(years, events)
    assert by_doc(out, "label_default") == {"1_2010-12-31": 1, "1_2012-12-31": 0, "2_None": 0}
    assert by_doc(out, "bankruptcy_date")["1_2012-12-31"] == D("2011-06-01")


def test_look_back_window(spark):
    years = years_of(spark, (1, "2010-12-31", "2011-03-31"), (1, "2009-12-31", None), (None, "2010-12-31", None))
    events = events_of(
        spark,
        (1, "2011-03-31", "4.01,5.02"),
        (1, "2011-04-01", "4.01"),
        (1, "2010-03-31", "4.01"),
        (1, "2010-04-01", "1.03"),
        (1, "2010-04-01", ""),
    )
    out, names = ev.add_event_features(years, events)
    rows = {r["doc_id"]: r for r in out.collect()}
    hit = rows["1_2010-12-31"]
    assert (hit["evt_n_8k"], hit["evt_n_auditor_change"], hit["evt_n_officer_departure"]) == (3, 1, 1)
    assert rows["1_2009-12-31"]["evt_n_8k"] == 0 and rows["None_2010-12-31"]["evt_n_8k"] == 0
    assert not any("bankruptcy" in n for n in names)


def test_later_events_never_change_features(spark):
    years = years_of(spark, (1, "2010-12-31", "2011-03-31"))
    early = events_of(spark, (1, "2011-01-01", "4.01"))
    late = events_of(spark, (1, "2011-04-01", "4.01"), (1, "2011-05-01", "1.03"))
    before = ev.add_event_features(years, early)[0].collect()
    after = ev.add_event_features(years, early.union(late))[0].collect()
    assert before == after


def test_fraud_window_edges(spark):
    years = years_of(spark, (1, "2005-12-31", None), (2, "2005-12-31", None), (3, "2005-12-31", None), (4, "2005-12-31", None))
    raw = spark.createDataFrame(
        [
            ("1", "12-2005", "3-2006", "0", "1"),  # starts in the last month
            ("2", "1-2004", "12-2004", "0", "1"),  # ends the day before
            ("3", "1-2004", "1-2005", "", "1.0"),
            ("4", "1-2005", "6-2005", "1", "1"),  # revoked
            ("4", "1-2005", "6-2005", "0", "0"),  # no statement fraud
            ("1", "bad", "1-2005", "0", "1"),
            ("x", "1-2005", "1-2005", "0", "1"),
        ],
        "cik string, fraud_start string, fraud_end string, revoked string, fsf string",
    )
    windows = tidy_enforcement(raw)
    assert windows.count() == 5
    assert windows.where("cik = 3").first()["fraud_end"] == D("2005-01-31")
    out = by_doc(labels.attach_fraud_labels(years, windows), "label")
    assert [out[f"{c}_2005-12-31"] for c in (1, 2, 3, 4)] == [1, 0, 1, 0]
    loose = labels.attach_fraud_labels(years, windows, require_fsf=False, drop_revoked=False)
    assert by_doc(loose, "label")["4_2005-12-31"] == 1


def test_short_arrays_pad(spark):
    arrays = spark.createDataFrame(
        [(7, ["8-K", "10-K", "8-K/A"], ["2010-01-01", "2010-02-01"], ["1.03"], None)],
        "cik long, form array<string>, filingDate array<string>, items array<string>, accessionNumber array<string>",
    )
    filled = arrays.withColumn("accessionNumber", F.coalesce("accessionNumber", F.array().cast("array<string>")))
    rows = extract_events(filled).orderBy("items").collect()
    assert [(r["items"], r["filing_date_8k"], r["accession"]) for r in rows] == [
        ("", None, ""),
        ("1.03", D("2010-01-01"), ""),
    ]


def test_missing_event_array_is_empty(spark):
    arrays = spark.createDataFrame(
        [(7, ["8-K"], ["2010-01-01"], None, None)],
        "cik long, form array<string>, filingDate array<string>, items array<string>, accessionNumber array<string>",
    )
    assert extract_events(arrays).first()["items"] == ""


def test_item_coverage(spark):
    events = events_of(spark, (1, "1999-01-01", " "), (1, "1998-01-01", "5"), (2, "2004-01-01", "5"))
    rows = {r["decade"]: (r["n_filings"], r["share_with_items"]) for r in ev.item_coverage(events).collect()}
    assert rows == {1990: (2, pytest.approx(0.5)), 2000: (1, 1.0)}
