import numpy as np
import pytest
from pyspark.sql import functions as F

from filingrisk.operators import bootstrap, evaluation, scoring, splits

ROWS = "row_id long, cik long, y int, p double"


def scored(spark, ys, ps, ciks=None):
    ciks = ciks or [i // 2 for i in range(len(ys))]
    data = [(i, c, int(y), float(p)) for i, (c, y, p) in enumerate(zip(ciks, ys, ps))]
    return spark.createDataFrame(data, ROWS)


def auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    d = pos[:, None] - neg[None, :]
    return float((d > 0).mean() + 0.5 * (d == 0).mean())


def average_precision(y, p):
    total = 0.0
    for t in np.unique(p):
        hit = y[p == t].sum()
        total += hit * y[p >= t].sum() / (p >= t).sum()
    return float(total / y.sum())


def test_bundle_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    y = (rng.random(200) < 0.2).astype(int)
    p = np.round(rng.random(200) * 0.6 + 0.3 * y, 1)
    r = evaluation.metric_bundle(scored(spark, y, p)).first()
    assert r["roc_auc"] == pytest.approx(auc(y, p)) and r["pr_auc"] == pytest.approx(average_precision(y, p))
    assert r["brier"] == pytest.approx(float(((p - y) ** 2).mean()))
    skill = 1 - ((p - y) ** 2).mean() / ((y.mean() - y) ** 2).mean()
    assert r["brier_skill"] == pytest.approx(float(skill))


def test_null_and_perfect_scores(spark):
    y = [0, 0, 0, 1, 1, 0, 0, 0, 0, 0]
    base = evaluation.metric_bundle(scored(spark, y, [0.2] * 10)).first()
    assert base["brier_skill"] == pytest.approx(0.0) and base["roc_auc"] == 0.5
    best = evaluation.metric_bundle(scored(spark, y, [0.99 if v else 0.01 for v in y])).first()
    assert best["brier_skill"] > 0.9 and best["roc_auc"] == 1.0


def test_single_class_and_empty(spark):
    one = evaluation.metric_bundle(scored(spark, [0, 0, 0], [0.1, 0.2, 0.3])).first()
    assert one["roc_auc"] is None and one["pr_auc"] is None and one["brier_skill"] is None
    none = evaluation.metric_bundle(scored(spark, [1], [0.5]).where("false")).first()
    assert none["n"] == 0 and none["brier"] is None


def test_top_k(spark):
    y = [1, 0, 0, 0, 0, 1, 0, 0, 0, 0]
    df = scored(spark, y, [0.9 - 0.05 * i for i in range(10)])
    got = {r["fraction"]: r for r in evaluation.top_k_capture(df, fractions=(0.1, 0.5)).collect()}
    assert (got[0.1]["k"], got[0.1]["events"], got[0.1]["capture"], got[0.1]["lift"]) == (1, 1, 0.5, 5.0)
    assert (got[0.5]["k"], got[0.5]["events"]) == (5, 1)
    flat = evaluation.top_k_capture(scored(spark, y, [0.2] * 10), fractions=(0.1,)).first()
    assert (flat["events"], flat["capture"], flat["lift"]) == (None, 0.1, 1.0)
    wide = evaluation.widen_top_k(evaluation.top_k_capture(df), []).first().asDict()
    assert wide["top_10pct_n"] == 1 and wide["top_30pct_events"] == 1


def test_reliability_is_right_closed(spark):
    edges = [i * 0.1 for i in range(11)]
    df = scored(spark, [0] * 11, edges)
    got = {r["bin"]: r["n"] for r in evaluation.reliability_table(df).collect()}
    want = {}
    for p in edges:
        b = int(np.digitize([p], np.linspace(0, 1, 11)[1:-1], right=True)[0]) + 1
        want[b] = want.get(b, 0) + 1
    assert got == want


def test_bootstrap_weights_and_order(spark):
    rng = np.random.default_rng(0)
    y = np.array([0, 1] * 20)
    df = scored(spark, y, 0.3 + 0.3 * y + 0.2 * rng.random(40)).withColumn("p_b", F.lit(1.0) - F.col("p"))
    w = bootstrap.draw_weights(df, "cik", n_boot=7, seed=1)
    sums = {r["rep"]: r["s"] for r in w.groupBy("rep").agg(F.sum("w").alias("s")).collect()}
    assert sums == {rep: 20 for rep in range(8)}
    for method in ("multinomial", "poisson"):
        for r in bootstrap.cluster_bootstrap_ci(df, n_boot=20, method=method).collect():
            assert r["ci_low"] <= r["ci_high"] and r["point"] is not None
    delta = bootstrap.cluster_bootstrap_delta(df, "p", "p_b", n_boot=20).first()
    assert delta["point"] > 0 and delta["ci_low"] > 0
    with pytest.raises(KeyError):
        bootstrap.cluster_bootstrap_delta(df, "p", "p_b", metric="nope")


def test_bootstrap_equals_concatenated_resampling(spark):
    rng = np.random.default_rng(3)
    y = (rng.random(60) < 0.4).astype(int)
    p = np.round(rng.random(60), 1)
    ciks = [i % 9 for i in range(60)]
    df = scored(spark, y, p, ciks)
    reps = {r["rep"]: r for r in bootstrap.replicate_metrics(df, n_boot=5).collect()}
    weights = bootstrap.draw_weights(df, "cik", n_boot=5, seed=42).collect()
    for rep in range(6):
        times = {r["cik"]: r["w"] for r in weights if r["rep"] == rep}
        idx = [i for i, c in enumerate(ciks) for _ in range(times.get(c, 0))]
        assert reps[rep]["n"] == len(idx)
        assert reps[rep]["roc_auc"] == pytest.approx(auc(y[idx], p[idx]))
        assert reps[rep]["pr_auc"] == pytest.approx(average_precision(y[idx], p[idx]))


def test_overlap_and_new_firms(spark):
    df = spark.createDataFrame(
        [(1, False), (2, False), (None, False), (2, True), (3, True), (2, True), (None, True), (1, True)],
        "cik long, is_test boolean",
    )
    r = evaluation.firm_overlap(df).first()
    assert (r["n_train_firms"], r["n_test_firms"], r["n_overlap_firms"], r["n_new_test_firms"]) == (2, 3, 2, 1)
    assert r["overlap_rate"] == pytest.approx(2 / 3)
    new = evaluation.new_firm_rows(df.where("is_test"), df.where("not is_test"))
    assert sorted(str(r["cik"]) for r in new.collect()) == ["3", "None"]


def test_fingerprint_ignores_order(spark):
    df = spark.createDataFrame([(f"{i}_x",) for i in range(50)], "doc_id string")
    a = evaluation.id_fingerprint(df, "doc_id").first()
    assert a == evaluation.id_fingerprint(df.orderBy(F.rand()).repartition(4), "doc_id").first()
    assert a != evaluation.id_fingerprint(df.where("doc_id <> '7_x'"), "doc_id").first()


def year_panel(spark):
    rows = [(f"{c}_{y}", c, y, 1 if (c == 0 and y % 2 == 0) or (c == 1 and y == 2011) else 0) for c in range(5) for y in range(2005, 2016)]
    return spark.createDataFrame(rows, "doc_id string, cik long, fyear int, label_default int")


def test_rolling_folds_are_ordered_and_disjoint(spark):
    df = year_panel(spark)
    folds = splits.rolling_folds(df, label_col="label_default", min_train_positives=2).collect()
    assert [f["cutoff"] for f in folds] == [2008, 2010, 2012]
    tagged = splits.tag_fold_rows(df, [f.asDict() for f in folds])
    for f in folds:
        part = tagged.where(F.col("cutoff") == f["cutoff"])
        assert part.where("role = 'train'").agg(F.max("fyear")).first()[0] <= f["cutoff"]
        assert part.where("role = 'test'").agg(F.min("fyear")).first()[0] > f["cutoff"]
        assert part.where("role = 'train'").count() == f["n_train"] and part.where("role = 'test'").count() == f["n_test"]
    short = df.where("fyear < 2009")
    assert splits.rolling_folds(short, label_col="label_default").count() == 0


def test_split_chain(spark):
    df = year_panel(spark)
    out, used = splits.smart_split(df, label_col="label_default")
    assert used == "temporal" and {r[0] for r in out.where("is_test").select("fyear").distinct().collect()} == {2013, 2014, 2015}
    late = df.withColumn("label_default", F.when(F.col("fyear") < 2012, F.col("label_default")).otherwise(0))
    out, used = splits.smart_split(late, label_col="label_default")
    assert used in ("group", "random")
    g = splits.group_split(df)
    firms = g.groupBy("cik").agg(F.count_distinct("is_test").alias("sides")).agg(F.max("sides")).first()[0]
    assert firms == 1 and g.where("is_test").select("cik").distinct().count() == 1
    s = splits.stratified_split(df, label_col="label_default", row_id="doc_id")
    n_pos = df.where("label_default = 1").count()
    assert s.where("is_test and label_default = 1").count() == round(0.2 * n_pos)


def test_calibration_folds_keep_firms_whole(spark):
    df = spark.createDataFrame([(i, i // 4, int(i // 4 % 2 == 0 and i % 4 == 0)) for i in range(48)], "doc_id long, cik long, y int")
    out, k, whole = splits.calibration_folds(df, label_col="y")
    if whole:
        assert out.groupBy("cik").agg(F.count_distinct("cal_fold").alias("n")).agg(F.max("n")).first()[0] == 1
    out, k, whole = splits.calibration_folds(df, label_col="y", group_col=None)
    assert k == 3 and not whole


def test_score_arithmetic(spark):
    one = spark.range(1)

    def value(col):
        return one.select(col).first()[0]

    assert value(scoring.scale_pd(F.lit(0.1), from_months=12, to_months=24)) == pytest.approx(0.19)
    assert value(scoring.scale_pd(F.lit(1.0), from_months=12, to_months=12)) < 1.0
    assert value(scoring.combine_probabilities(F.lit(0.3), F.lit(0.3))) == pytest.approx(0.3)
    assert value(scoring.combine_probabilities(F.lit(None).cast("double"), F.lit(0.3))) is None
    assert 0 < value(scoring.combine_probabilities(F.lit(0.0), F.lit(1.0))) < 1
    assert value(scoring.risk_band(F.lit(0.031), label_source="default")) == "über Basisrate"
    assert value(scoring.risk_band(F.lit(0.16))) == "mittel"
    with pytest.raises(ValueError):
        scoring.scale_pd(F.lit(0.1), from_months=0, to_months=12)
    with pytest.raises(ValueError):
        scoring.EnsembleWeights(0, 0).normalised()
    with pytest.raises(ValueError):
        scoring.combine_probabilities(F.lit(0.1), F.lit(0.1), method="max")


def test_rows_without_score_are_left_out(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.2), (1, None)], "y int, p double")
    assert [r["n"] for r in evaluation.reliability_table(df).collect()] == [1, 1]
    bundle, own = evaluation.metric_bundle(df).first(), evaluation.brier_skill(df).first()
    assert own["brier_skill"] == pytest.approx(bundle["brier_skill"])


def test_draws_by_hash_equal_hashlib():
    from hashlib import md5

    from filingrisk.functions.digests import numbered_units, units

    def plain(message):
        return int.from_bytes(md5(message).digest()[:6], "big") / 2.0**48

    assert np.concatenate([*numbered_units(b"42|7|", 95, 1005)]).tolist() == [plain(b"42|7|%d" % i) for i in range(95, 1005)]
    for length in (0, 1, 55, 56, 80):
        messages = np.random.default_rng(length).integers(0, 256, (9, length)).astype(np.uint8)
        assert units(messages).tolist() == [plain(m.tobytes()) for m in messages]


def test_draws_are_dealt_by_their_number(spark, monkeypatch):
    """Draws of a replicate spread over tasks however few bytes name them; hits are numbered as one array."""
    firms = spark.range(5000).select(F.lit("k").alias("_key"), F.col("id").alias("cik"), F.lit(1).cast("long").alias("rows"))
    monkeypatch.setattr(bootstrap, "DRAW_RANGE", 2000)
    hits = bootstrap._draws(bootstrap._numbered(firms, "cik"), 8, 3)
    assert hits.withColumn("t", F.spark_partition_id()).select("t").distinct().count() >= 8
    assert hits.groupBy("rep").agg(F.sum(F.length("hits")).alias("n")).where("n = 10000").count() == 8


def test_bootstrap_of_one_hot_firm_in_slices(spark, monkeypatch):
    """A firm with most rows is dealt to several tasks; draws, rows of a chunk and sums stay the same."""
    rng = np.random.default_rng(5)
    y, p = (rng.random(400) < 0.4).astype(int), np.round(rng.random(400), 2)
    ciks = [0 if i % 4 else i for i in range(400)]
    df = scored(spark, y, p, ciks)
    whole = {m: bootstrap.replicate_metrics(df, n_boot=12, method=m).orderBy("rep").collect() for m in ("multinomial", "poisson")}
    monkeypatch.setattr(bootstrap, "SLICE_ROWS", 16)
    monkeypatch.setattr(bootstrap, "FIRM_CHUNK", 32)
    for method, rows in whole.items():
        again = bootstrap.replicate_metrics(df, n_boot=12, method=method).orderBy("rep").collect()
        weights = bootstrap.draw_weights(df, "cik", n_boot=12, seed=42, method=method).collect()
        for one, other in zip(rows, again, strict=True):
            assert one["n"] == other["n"] and one["roc_auc"] == pytest.approx(other["roc_auc"])
            times = {r["cik"]: r["w"] for r in weights if r["rep"] == one["rep"]}
            assert one["n"] == sum(times.get(c, 0) for c in ciks)
