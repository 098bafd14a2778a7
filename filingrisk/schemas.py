"""Explicit schemas of the raw inputs; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

from filingrisk.policy import CONCEPTS


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


FIRM_YEAR_RAW = _strings(
    "cik", "name", "city", "state", "sic", "incorp_state", "filing_type", "fye",
    "filing_date", "reporting_date", "url", "mda",
)

FACT_ENTRY = T.StructType(
    [
        T.StructField("fy", T.IntegerType()),
        T.StructField("fp", T.StringType()),
        T.StructField("form", T.StringType()),
        T.StructField("filed", T.StringType()),
        T.StructField("end", T.StringType()),
        T.StructField("val", T.DoubleType()),
    ]
)
COMPANY_FACTS = T.StructType(
    [
        T.StructField("cik", T.LongType()),
        T.StructField(
            "facts",
            T.StructType(
                [
                    T.StructField(
                        "us-gaap",
                        T.MapType(
                            T.StringType(),
                            T.StructType(
                                [
                                    T.StructField(
                                        "units",
                                        T.MapType(T.StringType(), T.ArrayType(FACT_ENTRY)),
                                    )
                                ]
                            ),
                        ),
                    )
                ]
            ),
        ),
    ]
)

FILING_ARRAYS = T.StructType(
    [
        T.StructField(n, T.ArrayType(T.StringType()))
        for n in ("form", "filingDate", "items", "accessionNumber")
    ]
)
SUBMISSIONS = T.StructType(
    [
        T.StructField("cik", T.StringType()),
        T.StructField("filings", T.StructType([T.StructField("recent", FILING_ARRAYS)])),
    ]
)

PANEL = T.StructType(
    [
        T.StructField("cik", T.LongType()),
        T.StructField("fyear", T.IntegerType()),
        *[T.StructField(c, T.DoubleType()) for c in CONCEPTS],
    ]
)

PROFILE = T.StructType(
    [
        T.StructField("vagueness_score", T.DoubleType()),
        T.StructField("redundancy_score", T.DoubleType()),
        T.StructField("complexity_score", T.DoubleType()),
        T.StructField("risk_sentiment", T.DoubleType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("obfuscation_indicators", T.ArrayType(T.StringType())),
        T.StructField("risk_summary", T.StringType()),
    ]
)
