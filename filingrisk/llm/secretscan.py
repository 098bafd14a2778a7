"""Secret scan: base patterns, and weak credential parts linked by an interval join."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingrisk.llm.common import flat_map, free_name, text_or_empty
from filingrisk.session import materialise

# Base patterns, their least lengths, and the order of kinds.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")

# Weak parts: worth nothing alone, a credential together.
NAMED_ID = r"""(client_?id|account_?id|access_?key_?id|key_?id|user_?name|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{3,}"""
OTHER_ID = r"ASIA[A-Z0-9]{16,}|(?<![A-Za-z0-9])AC[0-9a-f]{32}(?![A-Za-z0-9])|(?<![A-Za-z0-9])AIza[A-Za-z0-9_-]{35}"
WEAK_SECRET = r"(?<![A-Za-z0-9/+=_-])[A-Za-z0-9/+_-]{32,}+={0,2}+(?![A-Za-z0-9/+=_-])"
ENDPOINT = r"""(?:https?|s3|gs|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?)://[^\s"'<>]{4,}"""

#: Different characters from which a run of two kinds of characters looks random.
VARIETY = 16
#: Code points between two parts of one credential, at most.
SCOPE = 256
MASK = "[SECRET]"

SCANNED = "n_assign bigint, n_access bigint, n_hex bigint, base array<bigint>, parts array<bigint>"


def _scanner():
    assign = re.compile(ASSIGN, re.I | re.A)
    access, hexes = re.compile(ACCESS), re.compile(HEX.replace("+", f"{{{LEAST["hex"]},}}"))
    named, other = re.compile(NAMED_ID, re.I | re.A), re.compile(OTHER_ID)
    weak, endpoint = re.compile(WEAK_SECRET), re.compile(ENDPOINT, re.I | re.A)

    def scan(text: str) -> tuple:
        """Counts per base kind, base spans and parts, each flat (kind number, start, end)."""
        pairs = "=" in text or ":" in text
        base = []
        if pairs:
            base += [(0, *m.span()) for m in assign.finditer(text) if len(m[2]) >= LEAST["assign"]]
        if "AKIA" in text:
            base += [(1, *m.span()) for m in access.finditer(text) if m.end() - m.start() >= LEAST["access"]]
        base += [(2, *m.span()) for m in hexes.finditer(text)]
        counts = [sum(kind == k for kind, _, _ in base) for k in range(3)]
        base.sort(key=lambda s: (s[1], s[0]))
        # A part joins others only through an identifier: without one, nothing else is looked for.
        ids = [m.span() for m in named.finditer(text)] if pairs else []
        if "ASIA" in text or "AC" in text or "AIza" in text:
            ids += [m.span() for m in other.finditer(text)]
        parts = [(3, *s) for s in ids] + [(3, s, e) for kind, s, e in base if kind == 1]
        if parts:
            parts += [(4, s, e) for kind, s, e in base if kind != 1]
            parts += [(4, *m.span()) for m in weak.finditer(text) if _mixed(m[0])]
            if "://" in text:
                parts += [(5, *m.span()) for m in endpoint.finditer(text)]
        flat = lambda spans: [x for span in spans for x in span]
        return *counts, flat(base), flat(sorted(set(parts)))

    return scan


def _mixed(value: str) -> bool:
    """Random-looking: small and large letters and digits, or two of these with VARIETY different characters."""
    seen = set(value)
    kinds = any(c.isdigit() for c in seen) + any(c.islower() for c in seen) + any(c.isupper() for c in seen)
    return kinds == 3 or kinds == 2 and len(seen) >= VARIETY


def _spans(column: str):
    """A flat triple array as an array of (start, kind_no, end)."""
    at = F.sequence(F.lit(0), F.size(column) - 3, F.lit(3))
    get = lambda i: F.get(F.col(column), i)
    spans = F.transform(at, lambda i: F.struct(get(i + 1).alias("start"), get(i).alias("kind"), get(i + 2).alias("end")))
    return F.when(F.size(column) > 0, spans).otherwise(F.array().cast("array<struct<start:bigint,kind:bigint,end:bigint>>"))


def scan_texts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs, the text's key, base counts, base spans and parts."""
    rows = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), text_or_empty().alias("text"))
    rows = rows.withColumn("key", F.sha2("text", 256))
    ddl = ", ".join(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    n = len(keep)

    def make():
        scan = _scanner()

        def produce(*row):
            yield *row[:n], row[n + 1], *scan(row[n])

        return produce

    made = flat_map(rows, make, f"{ddl}, key string, {SCANNED}" if ddl else f"key string, {SCANNED}")
    return made.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *made.columns[n:])


def link_parts(scanned: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak parts that have their complements within `scope`: key, linked spans.

    Identifiers and secrets report each other; an endpoint is reported next to
    an identifier and a secret. Parts are joined as intervals: each is dealt to
    the cells of length `scope` that it touches, the probe after widening by
    `scope`, so a part meets the parts of a few cells only, however many a text
    has. Parts that overlap a base span are linked but not reported again.
    """
    texts = scanned.where(F.size("parts") > 0).select("key", "base", "parts").dropDuplicates(["key"])
    part = texts.select("key", F.explode(_spans("parts")).alias("p")).select("key", "p.*")
    cells = part.withColumn("cell", F.explode(F.sequence(_cell(F.col("start") - scope, scope), _cell(F.col("end") + scope, scope))))
    touched = F.explode(F.sequence(_cell(F.col("start"), scope), _cell(F.col("end"), scope)))
    build = part.select(F.col("key").alias("bkey"), F.col("kind").alias("bkind"), F.col("start").alias("bs"), F.col("end").alias("be"), touched.alias("bcell"))
    near = (F.col("bs") <= F.col("end") + scope) & (F.col("be") >= F.col("start") - scope) & (F.col("bkind") != F.col("kind")) & (F.col("bkind") < 5)
    met = cells.join(build, (F.col("key") == F.col("bkey")) & (F.col("cell") == F.col("bcell")) & near)
    met = met.groupBy("key", "kind", "start", "end").agg(F.max(F.when(F.col("bkind") == 3, 1)).alias("id"), F.max(F.when(F.col("bkind") == 4, 1)).alias("sec"))
    whole = (F.col("kind") != 5) | (F.col("id").isNotNull() & F.col("sec").isNotNull())
    spans = met.where(whole).groupBy("key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))
    base = texts.select(F.col("key").alias("tkey"), _spans("base").alias("base"))
    overlap = lambda s: F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return spans.join(base, F.col("key") == F.col("tkey")).select("key", F.filter("linked", lambda s: ~overlap(s)).alias("linked"))


def _cell(position, scope: int):
    return F.floor(position / scope)


def find_secrets(docs: DataFrame, keep: list[str], scope: int = SCOPE) -> DataFrame:
    """One row per row of docs: the columns `keep`, key, base counts, base and spans.

    `base` and `spans` are arrays of (start, kind, end) in code points, sorted by
    start and then kind (its number in KINDS); `spans` also has the linked weak
    parts. A null or empty text has none, repeated rows give repeated rows, and
    texts of any length are scanned whole. `keep` names plain columns of docs.
    """
    scanned = materialise(scan_texts(docs, keep))
    linked = link_parts(scanned, scope).select(F.col("key").alias("lkey"), "linked")
    some = scanned.where(F.size("parts") > 0)
    rows = some.join(linked, F.col("key") == F.col("lkey"), "left").drop("lkey")
    rest = scanned.where(F.size("parts") == 0).withColumn("linked", F.lit(None).cast("array<struct<start:bigint,kind:bigint,end:bigint>>"))
    rows = rows.unionByName(rest).withColumn("base", _spans("base")).drop("parts")
    none = F.slice("base", 1, 0)
    return rows.withColumn("spans", F.array_sort(F.concat("base", F.coalesce("linked", none)))).drop("linked")


def shown(spans: str):
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"].cast("int")), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def redact(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """docs with each span of its text replaced by a mask and n_chars set anew.

    Texts without any span stay as they are, null ones too.
    """
    key, spans = free_name("secret_key", docs), free_name("spans", docs)
    found = find_secrets(docs.select("text"), [], scope).where(F.size("spans") > 0).dropDuplicates(["key"])
    found = found.select(F.col("key").alias(key), F.col("spans").alias(spans))
    hit = docs.withColumn(key, F.sha2(text_or_empty(), 256)).join(found, key, "left")

    # Spans may overlap; from the left, each adds what lies beyond the last one.
    def step(state, s):
        fresh = s["start"] >= state["at"]
        gap = F.substring("text", state["at"].cast("int") + 1, (s["start"] - state["at"]).cast("int"))
        return F.struct(
            F.when(fresh, F.concat(state["out"], gap, F.lit(MASK))).otherwise(state["out"]).alias("out"),
            F.greatest(state["at"], s["end"]).alias("at"),
        )

    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    masked = F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring("text", s["at"].cast("int") + 1, F.length("text"))))
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(masked)
    hit = hit.withColumn("text", text)
    if "n_chars" in docs.columns:
        changed = F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text"))
        hit = hit.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return hit.select(*docs.columns)
