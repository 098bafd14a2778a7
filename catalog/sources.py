"""Raw file formats: written from the given tables, read back by the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog.fixtures import with_views
from catalog.registry import query
from filingrisk.session import checkpoint_dir, materialise
from filingrisk.sources import (
    enforcement,
    facts,
    firm_years,
    profile_cache,
    submissions,
    tables,
)

RAW = with_views("fx_raw")


def scratch(w, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(w.spark)}/filingrisk/{name}-{uuid.uuid4().hex}"


def spread(df):
    """The rows dealt over all cores, for writers that make a file of each."""
    return df.repartition(max(8, 2 * df.sparkSession.sparkContext.defaultParallelism))


_TIDY = """typed as (select line_no, cast(cik as bigint) as cik, name, filing_date, reporting_date, mda from fx_raw where length(mda) >= 200),
dated as (select line_no, cik, name, try_strptime(filing_date, '%d-%m-%Y') as fd, try_strptime(reporting_date, '%d-%m-%Y') as rd, mda from typed),
keyed as (select *, concat(cast(cik as varchar), '_', strftime(rd, '%Y-%m-%d')) as doc_id from dated where rd is not null)"""
_ONE = "tidy as (select * from keyed qualify row_number() over (partition by doc_id order by line_no) = 1)"


@query(
    "src2_tidy_firm_years",
    f"""{RAW},{_TIDY},{_ONE} select doc_id, cik, name, cast(fd as date) as filing_date, cast(rd as date) as reporting_date,
    cast(year(rd) as int) as fyear, md5(mda) as digest, cast(length(mda) as int) as text_chars from tidy""",
)
def _(w):
    out = firm_years.tidy_firm_years(w.raw_filings, order=("line_no",))
    return out.select(
        "doc_id", "cik", "name", "filing_date", "reporting_date", "fyear",
        F.md5("mda").alias("digest"), "text_chars",
    )


@query(
    "so1_keep_first_document",
    f"{RAW},{_TIDY} select doc_id, min(line_no) as line_no from keyed group by doc_id",
)
def _(w):
    from filingrisk.operators.ordered import keep_first

    typed = w.raw_filings.where("length(mda) >= 200").select(
        "line_no", F.col("cik").cast("long").alias("cik"),
        F.try_to_date("reporting_date", "d-M-yyyy").alias("reporting_date"),
    )
    keyed = firm_years.add_firm_year_keys(typed.where("reporting_date is not null"))
    return keep_first(keyed, ["doc_id"], ["line_no"]).select("doc_id", "line_no")


def _write_line_array(w, name: str) -> str:
    """The raw filings as a line-wise JSON array with one unreadable line."""
    path = scratch(w, name)
    rows = w.raw_filings.select(
        F.concat(F.to_json(F.struct(*[c for c in w.raw_filings.columns if c != "line_no"])), F.lit(",")).alias("value")
    )
    frame = w.spark.sql("select explode(array('[', ']', '', '{\"cik\": broken,')) as value")
    rows.unionByName(frame).write.text(path)
    return path


@query(
    "src1_line_json_array",
    f"{RAW} select cik, name, sic, filing_type, filing_date, reporting_date, md5(mda) as digest from fx_raw",
)
def _(w):
    raw = firm_years.read_firm_years(w.spark, _write_line_array(w, "lines"))
    return raw.select(
        "cik", "name", "sic", "filing_type", "filing_date", "reporting_date", F.md5("mda").alias("digest")
    )


@query(
    "src1_whole_json_array",
    f"{RAW} select cik, name, sic, filing_type, filing_date, reporting_date, md5(mda) as digest from fx_raw",
)
def _(w):
    # A third of the filings as whole arrays, one per file and several records a line; the rest line-wise.
    path = scratch(w, "mixed")
    fields = F.to_json(F.struct(*[c for c in w.raw_filings.columns if c != "line_no"]))
    rows = w.raw_filings.select("line_no", fields.alias("j"))
    third = F.col("line_no") % 3 == 0
    arrays = rows.where(third).groupBy(F.floor(F.col("line_no") / 300)).agg(F.array_join(F.collect_list("j"), ", ").alias("j"))
    arrays.select(F.concat(F.lit("["), "j", F.lit("]")).alias("value")).repartition(8).write.option("maxRecordsPerFile", 1).text(path)
    rows.where(~third).select(F.concat("j", F.lit(",")).alias("value")).write.mode("append").text(path)
    raw = firm_years.read_firm_years(w.spark, path)
    return raw.select("cik", "name", "sic", "filing_type", "filing_date", "reporting_date", F.md5("mda").alias("digest"))


@query("src1_bad_line_count", "select count(*) + 1 as n_lines, 1 as n_bad from documents")
def _(w):
    return firm_years.count_bad_lines(w.spark, _write_line_array(w, "bad"))


def _damaged_lines(w) -> str:
    """The raw filings as a line-wise JSON array with a line that is no record behind every hundredth."""
    path = scratch(w, "damaged-lines")
    fields = F.to_json(F.struct(*[c for c in w.raw_filings.columns if c != "line_no"]))
    broken = F.element_at(F.array(*map(F.lit, ("{", "[1, 2],", '{"cik": 3, "mda": "cut'))), (F.floor(F.col("line_no") / 100) % 3 + 1).cast("int"))
    lines = F.when(F.col("line_no") % 100 == 0, F.array(F.concat(fields, F.lit(",")), broken)).otherwise(F.array(F.concat(fields, F.lit(","))))
    w.raw_filings.select(F.explode(lines).alias("value")).write.text(path)
    return path


@query(
    "src1_damaged_lines",
    f"{RAW} select cik, name, sic, filing_type, filing_date, reporting_date, md5(mda) as digest from fx_raw",
)
def _(w):
    raw = firm_years.read_firm_years(w.spark, _damaged_lines(w))
    return raw.select("cik", "name", "sic", "filing_type", "filing_date", "reporting_date", F.md5("mda").alias("digest"))


@query(
    "src1_damaged_line_count",
    f"{RAW}, b as (select count(*) filter (line_no % 100 = 0) as n_bad, count(*) as n from fx_raw) select n + n_bad as n_lines, n_bad from b",
)
def _(w):
    return firm_years.count_bad_lines(w.spark, _damaged_lines(w))


@query(
    "src1_damaged_arrays",
    f"""{RAW} select md5(mda) as digest, cik, reporting_date, true as parsed, count(*) as n from fx_raw group by all
    union all select null, null, null, false, count(distinct line_no // 100) from fx_raw""",
)
def _(w):
    # Whole arrays of a hundred records over any line breaks, each with one that breaks off in a string.
    path = scratch(w, "damaged-arrays")
    fields = F.to_json(F.struct(*[c for c in w.raw_filings.columns if c != "line_no"]))
    group = F.floor(F.col("line_no") / 100)
    arrays = w.raw_filings.groupBy(group).agg(F.collect_list(fields).alias("j"))
    text = F.concat(F.lit("["), F.element_at("j", 1), F.lit(',\n{"cik": 3, "mda": "cut,\n'), F.array_join(F.slice("j", 2, 100), ",\n"), F.lit("]"))
    alone = F.concat(F.lit("["), F.element_at("j", 1), F.lit(',\n{"cik": 3, "mda": "cut]'))
    rows = arrays.select(F.when(F.size("j") > 1, text).otherwise(alone).alias("value"))
    spread(rows).write.option("maxRecordsPerFile", 1).text(path)
    read = firm_years.firm_year_records(w.spark, path)
    return read.groupBy(F.md5("mda").alias("digest"), "cik", "reporting_date", "parsed").agg(F.count("*").alias("n"))


@query(
    "src14_one_firm",
    f"""{RAW},{_TIDY} select doc_id, cik, 'raw' as source, count(*) as n_lines from keyed where cik = 77 group by doc_id, cik""",
)
def _(w):
    path = _write_line_array(w, "firm")
    raw = firm_years.read_firm_years(w.spark, path, contains="77")
    labelled = w.firm_years.where("cik <> 77").select("cik", "doc_id", "fyear")
    found = firm_years.firm_years_of(labelled, raw, 77)
    lines = raw.where("cik = '77' and length(mda) >= 200").withColumn(
        "doc_id",
        F.concat_ws("_", "cik", F.date_format(F.try_to_date("reporting_date", "d-M-yyyy"), "yyyy-MM-dd")),
    )
    per_doc = lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"))
    return found.select("doc_id", "cik", "source").join(per_doc, "doc_id")


@query(
    "src4_dataset_csv_gz",
    f"{with_views('fx_firm_year')} select doc_id, cik, fyear, reporting_date, filing_date, cast(cash as double) as cash from fx_firm_year",
)
def _(w):
    path = scratch(w, "dataset") + ".csv.gz"
    upper = w.firm_years.toDF(*[c.upper() for c in w.firm_years.columns])
    tables.write_table(upper, path)
    return tables.read_dataset(w.spark, path).select(
        "doc_id", "cik", "fyear", "reporting_date", "filing_date", "cash"
    )


@query(
    "src10_panel_csv",
    f"""{with_views('fx_firm_year')} select cik, fyear, cast(total_assets as double) as total_assets, cast(equity as double) as equity
    from fx_firm_year""",
)
def _(w):
    path = scratch(w, "panel") + ".csv"
    tables.write_table(w.firm_years.select("cik", "fyear", "total_assets", "equity"), path)
    return tables.read_panel(w.spark, path)


@query("src13_cik_names", f"{with_views('fx_firm_year')} select cik, name from fx_firm_year")
def _(w):
    path = scratch(w, "names")
    tables.write_table(w.firm_years, path)
    return tables.read_cik_names(w.spark, path)


@query("src9_events_csv", f"{with_views('fx_events')} select * from fx_events")
def _(w):
    path = scratch(w, "events") + ".csv"
    tables.write_table(w.events, path)
    return submissions.read_events(w.spark, path)


@query(
    "src3_enforcement_csv",
    f"""{with_views('fx_aaer')} select cik, m0 as fraud_start, cast(m0 + interval 6 month - interval 1 day as date) as fraud_end,
    fsf, revoked from fx_aaer""",
)
def _(w):
    from catalog.labels import enforcement_windows

    path = scratch(w, "enforcement") + ".csv"
    enforcement_windows(w).write.options(header=True, sep=";").csv(path)
    return enforcement.read_enforcement(w.spark, path)


@query(
    "src5_facts_json_lines",
    f"{with_views('fx_facts')} select cik, tag, fy, fp, form, filed, val from fx_facts",
)
def _(w):
    from catalog.features import nested_facts

    path = scratch(w, "facts")
    nested_facts(w).write.json(path)
    return facts.read_fact_lines(w.spark, path).select("cik", "tag", "fy", "fp", "form", "filed", "val")


def _filing_arrays(w):
    """Per firm and year a block of event filings as parallel arrays, with annual reports mixed in."""
    rows = w.events.select(
        "cik",
        F.year("filing_date_8k").alias("page"),
        F.struct(
            "accession",
            # A quarter of the rows is another form and must be left out.
            F.when(F.crc32("accession") % 4 == 0, "10-K").otherwise("8-K").alias("form"),
            F.col("filing_date_8k").cast("string").alias("filingDate"),
            "items",
        ).alias("e"),
    )
    listed = rows.groupBy("cik", "page").agg(F.array_sort(F.collect_list("e")).alias("es"))
    return listed.select(
        "cik",
        "page",
        *[
            F.col(f"es.{n}").alias(a)
            for a, n in (("form", "form"), ("filingDate", "filingDate"), ("items", "items"), ("accessionNumber", "accession"))
        ],
    )


@query(
    "src7_extract_events",
    f"{with_views('fx_events')} select cik, filing_date_8k, items, accession from fx_events",
)
def _(w):
    both = _filing_arrays(w)
    kept = submissions.extract_events(both)
    annual = submissions.extract_events(both, ("10-K",))
    return kept.unionByName(annual)


@query(
    "src6_src8_submission_files",
    f"{with_views('fx_events')} select cik, filing_date_8k, items, accession from fx_events where cik <> 5",
)
def _(w):
    arrays = _filing_arrays(w).withColumn("form", F.transform("form", lambda f: F.lit("8-K/A")))
    path = scratch(w, "submissions")
    block = F.struct("form", "filingDate", "items", "accessionNumber")
    arrays.select(
        F.col("cik").cast("string").alias("cik"), F.struct(block.alias("recent")).alias("filings")
    ).write.json(path)
    # One object per line here; one file per firm in the wild.
    from filingrisk.schemas import SUBMISSIONS

    main = w.spark.read.schema(SUBMISSIONS).json(path).select(
        F.col("cik").try_cast("long").alias("cik"), "filings.recent.*"
    )
    wanted = w.events.where("cik <> 5").select("cik")
    return submissions.build_events(main, wanted)


@query(
    "src6_recent_and_further_pages",
    f"""{with_views('fx_events')} select cik, filing_date_8k, items, accession from fx_events""",
)
def _(w):
    # A firm's newest year in its own file's recent block, all earlier ones in pages named by the firm.
    newest = Window.partitionBy("cik")
    arrays = _filing_arrays(w).withColumn("form", F.transform("form", lambda f: F.lit("8-K")))
    arrays = materialise(arrays.withColumn("recent", F.col("page") == F.max("page").over(newest)))
    main, pages = scratch(w, "firms"), scratch(w, "pages")
    names = ("form", "filingDate", "items", "accessionNumber")
    block = F.struct(F.struct(*names).alias("recent")).alias("filings")
    record = F.to_json(F.struct(F.col("cik").cast("string").alias("cik"), block))
    recent = arrays.where("recent").select(record.alias("value"))
    recent.repartition(8).write.option("maxRecordsPerFile", 1).text(main)
    # One page file a firm here; several years in it are several objects of its array.
    older = arrays.where("not recent").groupBy("cik").agg(F.to_json(F.collect_list(F.struct(*names))).alias("value"))
    folder = F.format_string("CIK%010d-submissions-001", "cik")
    older.select(folder.alias("page"), "value").repartition(8, "page").write.partitionBy("page").text(pages)
    return submissions.build_events(submissions.read_submission_arrays(w.spark, main, pages))


@query(
    "src4_quoted_line_breaks",
    f"""{RAW} select line_no, md5(concat('[', replace(mda, chr(13), ''), chr(10), '"', ']')) as digest from fx_raw""",
)
def _(w):
    path = scratch(w, "texts") + ".csv"
    text = F.concat(F.lit("["), F.replace("mda", F.lit("\r"), F.lit("")), F.lit('\n"]'))
    tables.write_table(w.raw_filings.select("line_no", text.alias("mda")), path)
    read = tables.read_csv(w.spark, path, multi_line=True)
    return read.select(F.col("line_no").cast("long").alias("line_no"), F.md5("mda").alias("digest"))


@query(
    "src11_cache_table",
    """select substr(sha256(text), 1, 32) as text_hash, 0.75e0 as vagueness from documents group by 1""",
)
def _(w):
    from filingrisk.functions import text as tx
    from filingrisk.operators.textscores import distinct_texts

    path = scratch(w, "cache")
    rows = w.documents.select(F.col("text").alias("prepared")).withColumn(
        "text_hash", tx.text_hash(F.col("prepared"))
    )
    for vagueness in (0.25, 0.75):
        profile = F.to_json(
            F.struct(
                F.lit(vagueness).alias("vagueness_score"),
                F.lit(0.5).alias("redundancy_score"),
                F.lit(0.5).alias("complexity_score"),
                F.lit(0.0).alias("risk_sentiment"),
                F.lit(0.5).alias("confidence"),
            )
        )
        entries = distinct_texts(rows).select("text_hash", profile.alias("json"))
        profile_cache.append_cache(profile_cache.parse_entries(entries), path, "scorer-a")
    # The later of the two scorings counts.
    newest = profile_cache.read_cache(w.spark, path, "scorer-a")
    return newest.select("text_hash", F.col("profile.vagueness_score").alias("vagueness"))


@query(
    "snk1_parquet_by_year",
    f"{with_views('fx_firm_year')} select doc_id, fyear, total_assets from fx_firm_year where fyear = 1999",
)
def _(w):
    path = scratch(w, "by_year")
    tables.write_table(w.firm_years, path, partition_by=["fyear"])
    return w.spark.read.parquet(path).where("fyear = 1999").select("doc_id", "fyear", "total_assets")


@query(
    "snk2_evaluation_tables",
    f"{with_views('fx_pred')} select fold, count(*) as n, cast(sum(y) as bigint) as positives from fx_pred group by fold",
)
def _(w):
    from filingrisk.operators.evaluation import metric_bundle

    path = scratch(w, "metrics")
    tables.write_table(metric_bundle(w.predictions, ["fold"]), path)
    return w.spark.read.parquet(path).select("fold", "n", "positives")


@query(
    "build_dataset_with_labels",
    f"""{with_views('fx_raw', 'fx_aaer')},{_TIDY},{_ONE},
    win as (select cik, m0 as s, cast(m0 + interval 6 month - interval 1 day as date) as e from fx_aaer where fsf = 1 and revoked <> 1)
    select doc_id, tidy.cik, cast(rd as date) as reporting_date, cast(exists(select 1 from win where win.cik = tidy.cik and s <= rd
      and e >= rd - interval 1 year + interval 1 day) as int) as label from tidy""",
)
def _(w):
    from catalog.labels import enforcement_windows
    from filingrisk.operators.labels import attach_fraud_labels

    tidy = firm_years.tidy_firm_years(w.raw_filings, order=("line_no",))
    windows = enforcement.tidy_enforcement(enforcement_windows(w))
    return attach_fraud_labels(tidy, windows).select("doc_id", "cik", "reporting_date", "label")
