from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from filingrisk.operators import facts, panel, ratios
from filingrisk.operators.roles import resolve_concepts, resolve_roles


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_zero_denominator_is_missing_and_flagged(spark):
    df = table(
        spark,
        [("a", 100.0, 50.0, 0.0), ("b", 0.0, 50.0, 10.0), ("c", float("nan"), 1.0, float("inf"))],
        "doc_id string, total_assets double, total_liabilities double, net_income double",
    )
    out, names = ratios.add_financial_features(df)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows["a"]["fin_leverage"] == 0.5 and rows["a"]["fin_miss_leverage"] == 0.0
    assert rows["b"]["fin_leverage"] is None and rows["b"]["fin_miss_leverage"] == 1.0
    assert rows["c"]["fin_roa"] is None and rows["c"]["fin_log_assets"] is None
    assert names == sorted(names) and set(names) == {
        "fin_leverage", "fin_roa", "fin_log_assets", "fin_miss_leverage", "fin_miss_roa", "fin_miss_log_assets",
    }


def test_aliases_take_the_first_existing_column(spark):
    df = table(spark, [(1.0, 2.0, 3.0)], "AT double, assets double, LT double")
    assert resolve_concepts(df) == {"total_assets": "AT", "total_liabilities": "LT"}


def test_debt_counts_if_one_part_is_known(spark):
    df = table(
        spark,
        [("a", 10.0, None, 5.0), ("b", None, 10.0, 5.0), ("c", None, None, 5.0), ("d", 10.0, 5.0, 5.0)],
        "doc_id string, long_term_debt double, debt_in_current double, equity double",
    )
    got = {r[0]: r[1] for r in df.select("doc_id", ratios.base_ratios(df)["fin_debt_to_equity"]).collect()}
    assert got == {"a": 2.0, "b": 2.0, "c": None, "d": 3.0}


def test_all_concepts_give_64_features(spark):
    from filingrisk.policy import CONCEPTS

    cols = ", ".join(f"{c} double" for c in CONCEPTS)
    df = table(spark, [("a", 1, 2000, 3711, *[1.0] * 14)], f"doc_id string, cik long, fyear int, sic int, {cols}")
    _, names = ratios.add_financial_features(df)
    assert len(names) == 64


def panel_rows(n_firms=3, years=6, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n_firms):
        for y in range(2000, 2000 + years):
            if rng.random() < 0.15:
                continue
            ta = float(rng.integers(1, 100)) if rng.random() > 0.2 else None
            rows.append((f"{c}_{y}", c, y, 3711 if c % 2 else 351, ta, float(rng.integers(1, 50)), float(rng.integers(-5, 9))))
    return rows


SCHEMA = "doc_id string, cik long, fyear int, sic int, total_assets double, total_liabilities double, revenue double"


def test_trends_match_pandas(spark):
    rows = panel_rows()
    out, _ = ratios.add_financial_features(table(spark, rows, SCHEMA))
    got = out.select("doc_id", "fin_d_leverage", "fin_vol3_leverage", "fin_d_log_revenue").toPandas().set_index("doc_id")
    pdf = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).sort_values(["cik", "fyear"])
    pdf["lev"] = pdf.total_liabilities / pdf.total_assets
    g = pdf.groupby("cik")
    pdf["d"] = g.lev.diff()
    pdf["v"] = g.lev.transform(lambda s: s.rolling(3, min_periods=2).std())
    pdf["r"] = np.log1p(pdf.revenue.clip(lower=0)) - np.log1p(g.revenue.shift(1).clip(lower=0))
    want = pdf.set_index("doc_id")
    for ours, theirs in (("fin_d_leverage", "d"), ("fin_vol3_leverage", "v"), ("fin_d_log_revenue", "r")):
        np.testing.assert_allclose(
            got.loc[want.index, ours].astype(float), want[theirs].astype(float), rtol=1e-9, atol=1e-12
        )


def test_strict_years_ignores_gaps(spark):
    df = table(
        spark,
        [("a", 1, 2000, 1, 10.0, 5.0, 1.0), ("b", 1, 2002, 1, 10.0, 8.0, 1.0), ("c", 1, 2003, 1, 10.0, 9.0, 1.0)],
        SCHEMA,
    )
    out, _ = ratios.add_financial_features(df, strict_years=True)
    got = {r["doc_id"]: r["fin_d_leverage"] for r in out.collect()}
    assert got["b"] is None and got["c"] == pytest.approx(0.1)


def test_industry_percentile_needs_five_and_averages_ties(spark):
    vals = [1.0, 2.0, 2.0, 4.0, None, 5.0]
    rows = [(f"a{i}", i, 2000, 3711, 10.0, v, 1.0) for i, v in enumerate(vals)]
    rows += [(f"b{i}", 50 + i, 2000, 351, 10.0, float(i), 1.0) for i in range(4)]
    rows += [(f"c{i}", 90 + i, 2000, None, 10.0, float(i), 1.0) for i in range(6)]
    out, _ = ratios.add_industry_percentiles(
        table(spark, rows, SCHEMA).withColumn("fin_leverage", F.col("total_liabilities") / F.col("total_assets"))
    )
    got = {r["doc_id"]: r["fin_leverage_sic_pct"] for r in out.collect()}
    assert [got[f"a{i}"] for i in range(6)] == [0.2, 0.5, 0.5, 0.8, None, 1.0]
    assert all(got[f"b{i}"] is None for i in range(4)) and all(got[f"c{i}"] is None for i in range(6))
    group = table(spark, [(3711,), (351,), (999,), (1000,)], "sic int").select(ratios.industry_group(F.col("sic")))
    assert [r[0] for r in group.collect()] == [37, 35, 99, 10]


def test_peers_widen_the_comparison(spark):
    one = table(spark, [("x", 1, 2000, 3711, 10.0, 3.0, 1.0)], SCHEMA)
    others = table(spark, [(f"p{i}", 9 + i, 2000, 3711, 10.0, float(i), 1.0) for i in range(6)], SCHEMA)
    alone, _ = ratios.add_financial_features(one)
    assert alone.first()["fin_leverage_sic_pct"] is None
    among, _ = ratios.add_financial_features(one, peers=others)
    assert among.first()["fin_leverage_sic_pct"] == pytest.approx(4.5 / 7)


FACT = "cik long, tag string, unit string, pos long, fy int, fp string, form string, filed date, end date, val double"


def test_first_filed_value_wins(spark):
    d = date.fromisoformat
    rows = [
        (1, "Assets", "USD", 0, 2010, "FY", "10-K/A", d("2011-09-01"), None, 999.0),
        (1, "Assets", "USD", 1, 2010, "FY", "10-K", d("2011-03-01"), None, 100.0),
        (1, "Assets", "USD", 2, 2010, "FY", "10-K", d("2011-03-01"), d("2010-12-31"), 101.0),
        (1, "Assets", "USD", 3, 2010, "Q1", "10-K", d("2010-01-01"), None, 1.0),
        (1, "Assets", "EUR", 4, 2010, "FY", "10-K", d("2010-01-01"), None, 2.0),
        (1, "Assets", "USD", 5, 2011, "FY", "10-K", None, None, 3.0),
        (1, "Revenues", "USD", 0, 2010, "FY", "10-K", d("2011-03-01"), None, 7.0),
        (1, "SalesRevenueNet", "USD", 0, 2009, "FY", "10-K", d("2010-03-01"), None, 6.0),
        (2, "SalesRevenueNet", "USD", 0, 2009, "FY", "10-K", d("2010-03-01"), None, 5.0),
    ]
    df = table(spark, rows, FACT)
    got = {(r["cik"], r["fyear"], r["concept"]): r["val"] for r in facts.first_filed(df).collect()}
    assert got == {
        (1, 2010, "total_assets"): 100.0,
        (1, 2011, "total_assets"): 3.0,
        (1, 2010, "revenue"): 7.0,
        (2, 2009, "revenue"): 5.0,
    }
    filled = facts.first_filed(df, coalesce_tags=True)
    assert filled.where("cik = 1 and concept = 'revenue'").count() == 2
    latest = facts.first_filed(df, latest_period=True)
    assert latest.where("cik = 1 and fyear = 2010 and concept = 'total_assets'").first()["val"] == 101.0


def test_roles(spark):
    df = table(spark, [(1, 2000, "t", 0)], "cik long, fyear int, mda string, label int")
    out, roles = resolve_roles(df)
    assert (roles.label, roles.row_id, roles.text, roles.year) == ("label", "doc_id", "mda", "fyear")
    assert out.first()["doc_id"] == "1_2000"
    with pytest.raises(KeyError):
        resolve_roles(df, text="nope")
    with pytest.raises(KeyError):
        resolve_roles(df.drop("label"))


def test_scoring_input(spark):
    df = table(spark, [("12", "31-12-2004", "abc"), ("x", "2005-12-31", None)], "CIK string, `Reporting_Date ` string, content string")
    rows = panel.normalise_scoring_input(df).orderBy("mda").collect()
    assert rows[1]["doc_id"] == "12_2004-12-31" and rows[1]["fyear"] == 2004 and rows[1]["label"] == 0
    assert rows[0]["cik"] is None and rows[1]["mda"] == "abc" and rows[1]["name"] == "12"


def test_search(spark):
    idx = panel.company_index(table(spark, [(1, "Acme (US) Inc"), (2, "acme two"), (1, "Acme (US) Inc")], "cik long, name string"))
    assert panel.search_companies(idx, "ACME").count() == 2
    assert panel.search_companies(idx, "e (us)").count() == 1
    assert panel.search_companies(idx, "2").first()["name"] == "acme two"
    assert panel.search_companies(idx, "  ").count() == 0


def test_require_financials_needs_the_column(spark):
    with pytest.raises(KeyError):
        panel.require_financials(table(spark, [(1,)], "cik long"))


def test_percentiles_do_not_go_by_id(spark):
    rows = [("same" if i < 2 else f"d{i}", i, 2000, 3711, 10.0, float(i + 1), 1.0) for i in range(8)]
    df = table(spark, rows, SCHEMA).withColumn("fin_leverage", F.col("total_liabilities") / F.col("total_assets"))
    out, _ = ratios.add_industry_percentiles(df)
    assert [r["fin_leverage_sic_pct"] for r in out.orderBy("cik").collect()] == [(i + 1) / 8 for i in range(8)]


def test_ids_come_from_content(spark):
    df = spark.createDataFrame([(None, 1, "a"), (None, 1, "b"), (5, 2000, "c")], "cik long, fyear int, name string").withColumn("label", F.lit(0))
    first, again = ({r["name"]: r["doc_id"] for r in resolve_roles(df.repartition(n))[0].collect()} for n in (1, 3))
    assert first == again and len(set(first.values())) == 3 and first["c"] == "5_2000"


def test_firm_years_join_names_after_sums(spark, tmp_path):
    """Firm-years equal their SQL, also for repeated and null keys, without a sort of all lines for the names."""
    from catalog.fixtures import FIRM_YEARS, World

    stamp = "timestamp '1996-03-04 00:00:00'"
    spark.sql("select * from values (1L,'b','BUILDING'),(1L,'a','X'),(2L,null,null),(3L,'c','FURNITURE'),(null,'n','BUILDING') t(c_custkey,c_name,c_mktsegment)").write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql(f"select * from values (10L,1L,{stamp}),(11L,1L,{stamp}),(12L,2L,null),(13L,3L,{stamp}),(13L,3L,{stamp}),(14L,null,{stamp}),(15L,9L,{stamp}) t(o_orderkey,o_custkey,o_orderdate)").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql(
        "select 10 + id % 6 as l_orderkey, if(id % 5 = 0, null, double(id)) as l_quantity, id * 1.25D as l_extendedprice, if(id % 7 = 0, null, (id % 11) / 100D) as l_discount,"
        " (id % 9) / 100D as l_tax, substr('RAN', 1 + int(id % 3), 1) as l_returnflag, substr('OF', 1 + int(id % 2), 1) as l_linestatus from range(60)"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    w = World(spark, str(tmp_path))
    names = {t: w.table(t) for t in ("customer", "orders", "lineitem")}
    want = spark.sql(FIRM_YEARS, **names)
    assert w.firm_years.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(repr, w.firm_years.collect())) == sorted(map(repr, want.collect())) and want.count() == 3
    plan = w.firm_years._jdf.queryExecution().executedPlan().toString()
    lines = [line for line in plan.splitlines() if "SortAggregate" in line]
    assert not any("o_custkey" in line for line in lines)
