"""License scan: ordered signature rules behind a keyword gate, overlaps resolved by priority."""

from __future__ import annotations

import re
from functools import cache

import numpy as np
from pyspark.sql import DataFrame

from filingrisk.llm.common import flat_map, text_or_empty
from filingrisk.llm.signatures import RULES

# What separates words, in lower-cased UTF-8.
SEPARATORS = rb"\x00-\x2F\x3A-\x60\x7B-\x7F"
GAP = b"[" + SEPARATORS + b"]+"
EDGE_BEFORE, EDGE_AFTER = rb"(?<![^\x00-\x2F\x3A-\x60\x7B-\x7F])", rb"(?![^\x00-\x2F\x3A-\x60\x7B-\x7F])"
WORD_BYTE = np.ones(256, dtype=bool)
WORD_BYTE[:0x80] = False
WORD_BYTE[0x30:0x3A] = WORD_BYTE[0x61:0x7B] = True

#: Confidence by priority.
CONFIDENCE = {0: 1.0, 1: 1.0, 2: 0.95, 3: 0.85, 4: 0.7}

SCANNED = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
    "detections array<string>"
)


# A class of a rule, an optional blank, or a blank.
_BLANKS = re.compile(r"\[[^]]*\]| \?| ")


def translate(rule: str) -> bytes:
    """The rule as a pattern over bytes: a blank is any gap, an optional one may be absent, one in a class is any separator."""

    def part(m: re.Match) -> str:
        if m[0].startswith("["):
            return m[0].replace(" ", SEPARATORS.decode())
        return f"(?:{GAP.decode()})?" if m[0] == " ?" else GAP.decode()

    return _BLANKS.sub(part, rule).encode()


@cache
def compiled() -> list[tuple]:
    """(priority, label, keyword, pattern) in priority order; see translate for the blanks of a rule."""
    out = []
    for line in RULES.strip().splitlines():
        priority, label, keyword, rule = (x.strip() for x in line.split("|", 3))
        out.append((int(priority), label, keyword.encode(), re.compile(EDGE_BEFORE + b"(?:" + translate(rule) + b")" + EDGE_AFTER)))
    return sorted(out, key=lambda r: r[0])


@cache
def gate() -> tuple[bytes, ...]:
    """The shortest keywords: a text with none of them fires no rule."""
    words = {r[2] for r in compiled()}
    return tuple(sorted(w for w in words if not any(o != w and o in w for o in words)))


def word_starts(low: bytes) -> np.ndarray:
    """Byte positions at which words start."""
    inside = WORD_BYTE[np.frombuffer(low, dtype=np.uint8)]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    return np.flatnonzero(begins)


def detect(low: bytes, starts: np.ndarray) -> list[tuple[int, str, int, int]]:
    """(priority, label, first word, word after the last) of what remains, by position.

    Rules fire in priority order. A detection that lies within one of a better
    priority, or within a longer one of the same priority, is dropped; base
    rules (priority 0) are never dropped and drop only what is equal in label.
    """
    if not any(k in low for k in gate()):
        return []
    found = []
    for priority, label, keyword, pattern in compiled():
        if keyword in low:
            for m in pattern.finditer(low):
                a, b = np.searchsorted(starts, (m.start(), m.end()))
                found.append((priority, label, int(a), int(b)))
    base = [d for d in found if d[0] == 0]
    kept: list[tuple[int, str, int, int]] = []
    for d in sorted((d for d in found if d[0] > 0), key=lambda d: (d[0], d[2] - d[3], d[2], d[1])):
        inside = any(k[2] <= d[2] and d[3] <= k[3] for k in kept)
        repeats = any(k[1] == d[1] and k[2] <= d[2] and d[3] <= k[3] for k in base)
        if not inside and not repeats:
            kept.append(d)
    return sorted(base + kept, key=lambda d: (d[2], d[3], d[1]))


def scan(text: str) -> tuple:
    low = text.encode().lower()
    starts = word_starts(low)
    found = detect(low, starts)
    base = [d for d in found if d[0] == 0]
    at = [d[2] for d in base]
    return (
        len(starts),
        len(base),
        min(at, default=None),
        max(at, default=None),
        ",".join(sorted({d[1] for d in base})),
        ",".join(sorted({d[1] for d in found})),
        max((CONFIDENCE[d[0]] for d in found), default=0.0),
        [f"{label}:{a}:{b}" for _, label, a, b in found],
    )


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id and what the rules find in the whole text, one row per row of docs.

    Only ASCII letters are lower-cased. A null or empty text has no words, no
    labels (empty strings) and score 0; repeated rows give repeated rows, other
    columns are not read. `detections` lists label:first word:word after the
    last, by position. Places of one rule do not overlap.
    """

    def make():
        def produce(doc_id, text):
            yield doc_id, *scan(text)

        return produce

    kind = docs.schema["doc_id"].dataType.simpleString()
    return flat_map(docs.select("doc_id", text_or_empty().alias("text")), make, f"doc_id {kind}, {SCANNED}")
