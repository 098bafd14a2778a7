"""Content-addressed WARC archive: payload bytes once, record headers apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format.
DIGITS_32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE_32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: four times 40 bits give 32 letters."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), DIGITS_32, BASE_32)


def _field(name: str, value: Column) -> Column:
    """One header line, or nothing where the value is null."""
    clean = F.regexp_replace(F.regexp_replace(value.cast("string"), "\r", "%0D"), "\n", "%0A")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(END)), F.lit(""))


def header_value(header: Column, name: str) -> Column:
    """A field of a header, null where it has none."""
    pattern = rf"(?:^|\r\n){name}: ([^\r\n]*)"
    return F.when(F.regexp_like(header, F.lit(pattern)), F.regexp_extract(header, pattern, 1))


def write_archive(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write pages (page_id, url, html) as two tables under `folder`.

    `payloads` holds the bytes of each SHA-256 address once; `headers` holds the
    exact header of each record and the address its bytes are at. Among records
    with equal payloads of at least `min_bytes` bytes the smallest page_id is
    the response and the others are revisits of it; shorter payloads are always
    responses. Equal addresses whose SHA-1 or length differ stop the job.

    A null html is an empty payload; a null url leaves out the target field.
    Rows repeated with the same page_id and payload are repeated records of one
    type. A null page_id counts as larger than all others. Other columns of
    `pages` are not read. An empty table gives an empty archive.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    address = F.sha2("payload", 256)
    rows.select(address.alias("address"), "payload").dropDuplicates(["address"]).write.parquet(f"{folder}/payloads")

    narrow = rows.select(
        "page_id", "url", address.alias("address"), base32_sha1(F.col("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("n")
    )
    agree = (F.min("digest") == F.max("digest")) & (F.min("n") == F.max("n"))
    firsts = narrow.groupBy(F.col("address").alias("at")).agg(F.min("page_id").alias("first_id"), agree.alias("agree"))
    joined = narrow.join(firsts, F.col("address") == F.col("at"))
    same = F.when(F.col("agree"), F.lit(True)).otherwise(F.raise_error(F.lit("one address, two payloads")).cast("boolean"))
    response = (F.col("page_id").eqNullSafe(F.col("first_id"))) | (F.col("n") < min_bytes)
    header = F.concat(
        F.lit(f"WARC/1.1{END}"),
        _field("WARC-Type", F.when(response, "response").otherwise("revisit")),
        _field("WARC-Record-ID", F.format_string("<urn:page:%s>", F.col("page_id").cast("string"))),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        _field("WARC-Refers-To", F.when(~response, F.concat(F.lit("<urn:page:"), F.col("first_id").cast("string"), F.lit(">")))),
        _field("WARC-Profile", F.when(~response, F.lit(PROFILE))),
        _field("Content-Type", F.lit("text/html; charset=utf-8")),
        _field("Content-Length", F.when(response, F.col("n")).otherwise(F.lit(0))),
        F.lit(END),
    )
    joined.where(same).select(header.alias("header"), "address").write.parquet(f"{folder}/headers")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Header, record and full payload of each record written to `folder`.

    `record` has the exact bytes of the WARC record: header, the payload of a
    response (a revisit has none), and two line ends. `payload` is what the
    record stands for, also for a revisit. Bytes that do not give their address
    again stop the job, and so does a header whose bytes are missing.
    """
    stored = spark.read.parquet(f"{folder}/payloads")
    payload = F.when(F.sha2("payload", 256) == F.col("address"), F.col("payload")).otherwise(
        F.raise_error(F.lit("payload does not match its address")).cast("binary")
    )
    stored = stored.select(F.col("address").alias("at"), payload.alias("payload"))
    rows = spark.read.parquet(f"{folder}/headers").join(stored, F.col("address") == F.col("at"), "left")
    rows = rows.select("header", F.coalesce("payload", F.raise_error(F.lit("payload is missing")).cast("binary")).alias("payload"))
    own = F.when(header_value(F.col("header"), "WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    end = F.lit((END * 2).encode())
    return rows.select("header", "payload", F.concat(F.encode("header", "UTF-8"), own, end).alias("record"))


def record_digests(records: DataFrame) -> DataFrame:
    """Per record what its header and full payload say."""
    header = F.col("header")
    page = F.regexp_extract(header_value(header, "WARC-Record-ID"), "<urn:page:(-?[0-9]+)>", 1)
    refers = F.regexp_extract(header_value(header, "WARC-Refers-To"), "<urn:page:(-?[0-9]+)>", 1)
    return records.select(
        page.try_cast("long").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
        header_value(header, "WARC-Type").alias("record_type"),
        refers.try_cast("long").alias("refers_to"),
        F.octet_length("record").cast("long").alias("record_bytes"),
    )
