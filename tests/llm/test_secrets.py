"""Secrets of any length, and without capitals, beside an identifier."""

from filingrisk.llm import secretscan


def test_long_and_lower_case_secrets(spark):
    made = "".join(chr(97 + i * i * 7 % 26) + chr(65 + i * 5 % 26) + str(i * 3 % 10) for i in range(200))
    small = "q7x2m9k4v1c8z3b6n5j0h7g2f9d4s1a8p3"
    values = ["github_pat_" + made[:82], made, small, small.upper()]
    plain = ["-".join(["some"] * 20), "x1" * 40]
    rows = [(i, f"user = bob\n{v} end") for i, v in enumerate(values + plain)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in secretscan.redact(df).collect()}
    assert all(got[i] == "[SECRET]\n[SECRET] end" for i in range(len(values)))
    assert all(got[len(values) + i] == rows[len(values) + i][1] for i in range(len(plain)))
