"""Benchmark decontamination by templates: typed placeholders, window joins, slot checks."""

from __future__ import annotations

import hashlib
import re
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingrisk.llm.common import flat_map, ship_package, text_or_empty
from filingrisk.session import materialise

#: Words in a window, and the share of them that must not be placeholders for the template to stand for it.
WINDOW = 8
LITERAL_SHARE = 0.6
#: Share of an item's windows that a document must hold to be a leak.
MIN_COVERAGE = 0.2
#: Words on end that are a leak whatever their share of the item.
RUN_WORDS = 20
#: Words of the shortest item that is looked for inside texts; one below is only met by a text of the same words.
LEAST_WORDS = 3
#: Bits of the gate that keeps windows of no item off the join; a fixed size.
GATE_BITS = 26

NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half".split()
)
UNITS = frozenset(
    "kg kilogram kilograms gram grams mg km kilometer kilometers kilometre kilometres meter meters metre metres cm mm mile miles inch inches "
    "foot feet yard yards liter liters litre litres ml gallon gallons second seconds minute minutes hour hours day days week weeks month "
    "months year years percent dollar dollars cent cents euro euros pound pounds usd eur gbp mph kmh degree degrees celsius fahrenheit "
    "watt watts volt volts joule joules newton newtons".split()
)
PLACE = {"num": "<num>", "unit": "<unit>", "name": "<name>"}

_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+")
_SENTENCE_END = re.compile(r"[.!?:\n]")
# Forms of a window: the words as they are, or with placeholders.
LITERAL, TEMPLATE = 0, 1
#: Odd multiplier of the rolling hash, and those of the characters of a token by their place.
STEP = np.uint64(0x9E3779B97F4A7C15)
_BY_PLACE = np.random.default_rng(8).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Characters looked at together; a longer text is cut at a blank.
PIECE_CHARS = 1 << 16
# Classes of characters: part of a word, of a number, what may join numbers, what ends a sentence.
_WORD, _DIGIT, _JOINS, _ENDS, _FIGURE = 1, 2, 4, 8, 16


@cache
def _classes() -> np.ndarray:
    """Class bits of every code point, as the regular expressions above take them."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isdecimal():
            out[i] = _DIGIT | _FIGURE
        elif c.isalnum():
            out[i] = _WORD | (_FIGURE if c.isdigit() else 0)
    out[[ord(c) for c in ".,"]] |= _JOINS
    out[[ord(c) for c in ".!?:\n"]] |= _ENDS
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _lowered(text: str) -> str:
    """Lower case, character by character where the whole text would change its length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _tokens(text: str):
    """Hash, begin and end of each token of a text, whether it is a capitalised word, and the class bits of all characters.

    Equal lower-cased tokens have equal hashes. Vectorised over the characters.
    """
    points, low = _points(text), _points(_lowered(text))
    kinds = _classes()[points]
    group = kinds & np.uint8(_WORD | _DIGIT)
    joins = np.flatnonzero(kinds & np.uint8(_JOINS))
    joins = joins[(joins > 0) & (joins < len(group) - 1)]
    group[joins[(group[joins - 1] == _DIGIT) & (group[joins + 1] == _DIGIT)]] = _DIGIT
    at = np.flatnonzero(group)
    if not len(at):
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none.astype(bool), kinds
    # A token begins where the one before is not next to it or of another class.
    own = group[at]
    bounds = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1])]))
    starts = at[bounds]
    lengths = np.diff(bounds, append=len(at))
    place = (np.arange(len(at)) - np.repeat(bounds, lengths)) & 255
    value = (low[at] + np.uint64(1)) * _BY_PLACE[place]
    value = np.add.reduceat(value, bounds) + lengths.astype(np.uint64) * STEP
    value ^= value >> np.uint64(32)
    value *= np.uint64(0xD6E8FEB86659FD93)
    value ^= value >> np.uint64(32)
    ends = starts + lengths
    large = np.flatnonzero(points != low)
    one = np.searchsorted(large, ends) - np.searchsorted(large, starts) == 1
    return value, starts, ends, one & (points[starts] != low[starts]) & (lengths > 1), kinds


@cache
def _listed(kind: str) -> np.ndarray:
    words = sorted(NUMBER_WORDS if kind == "num" else UNITS)
    return np.sort(np.concatenate([_tokens(w)[0] for w in words]))


def _among(values: np.ndarray, listed: np.ndarray) -> np.ndarray:
    return listed[np.minimum(np.searchsorted(listed, values), len(listed) - 1)] == values


def _number(text: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(text.encode()))


PLACE_NUMBER = {kind: _number(mark) for kind, mark in PLACE.items()}


def _is_name(token: str, low: str) -> bool:
    """Capitalised: one large letter, then small ones only."""
    return token[0] != low[0] and len(token) > 1 and token[1:] == low[1:]


def token_type(low: str) -> str:
    """num or unit for what is a placeholder anywhere, else nothing."""
    return "num" if low[0].isdigit() or low in NUMBER_WORDS else "unit" if low in UNITS else ""


def _pieces(text: str):
    """A text in pieces of about PIECE_CHARS, cut before a blank; a word without end stays whole."""
    at = 0
    while len(text) - at > PIECE_CHARS:
        cut = text.find(" ", at + PIECE_CHARS)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


class Templates:
    """The canonical tokens of texts: numbers, units and names become placeholders.

    A name is a capitalised word that does not start a sentence; a line starts one.
    """

    def packed(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of each token, of each canonical token, and whether that is a placeholder."""
        made, starting = [], True
        for piece in _pieces(text):
            if piece:
                raw, starts, ends, capitalised, kinds = _tokens(piece)
                enders = np.flatnonzero(kinds & np.uint8(_ENDS))
                if not len(starts):
                    starting |= bool(len(enders))
                    continue
                # A token starts a sentence if something between it and the last one ends one.
                before = np.searchsorted(enders, starts)
                begins = before > np.searchsorted(enders, np.concatenate([[0], ends[:-1]]))
                begins[0] |= starting
                starting = bool(len(enders) and enders[-1] >= ends[-1])
                num = ((kinds[starts] & np.uint8(_FIGURE)) > 0) | _among(raw, _listed("num"))
                unit = ~num & _among(raw, _listed("unit"))
                name = capitalised & ~num & ~unit & ~begins
                canonical = raw.copy()
                for kind, at in (("name", name), ("num", num), ("unit", unit)):
                    canonical[at] = PLACE_NUMBER[kind]
                made.append((raw, canonical, name | num | unit))
        if not made:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
        return made[0] if len(made) == 1 else tuple(np.concatenate(parts) for parts in zip(*made, strict=True))

    def words(self, text: str) -> tuple[list[str], list[str]]:
        """Canonical tokens, and those of the text, lower-cased; in step with packed()."""
        raw, canonical, start, last = [], [], True, 0
        for m in _TOKEN.finditer(text):
            start = start and not raw or bool(_SENTENCE_END.search(text, last, m.start()))
            low, last = _lowered(m[0]), m.end()
            kind = token_type(low) or ("name" if not start and _is_name(m[0], low) else "")
            raw.append(low)
            canonical.append(PLACE[kind] if kind else low)
        return canonical, raw

    def windows(self, text: str, sizes: list[int], least: int):
        """(size, hashes of the windows by position as they are and as templates, which of them have enough literals).

        Enough is the share of `least` words also in a shorter window.
        """
        raw, canonical, slots = self.packed(text)
        literal = np.concatenate([[0], np.cumsum(~slots)])
        for size in sizes:
            n = len(raw) - size + 1
            if n > 0:
                enough = literal[size:] - literal[:n] >= int(np.ceil(LITERAL_SHARE * max(size, least)))
                yield size, _rolled(raw, size, LITERAL), _rolled(canonical, size, TEMPLATE), enough


def _mixed(left: np.ndarray, right) -> np.ndarray:
    value = (left * STEP) ^ right
    value ^= value >> np.uint64(29)
    return value


def _rolled(numbers: np.ndarray, size: int, form: int) -> np.ndarray:
    """Hash of each window of `size` numbers, from hashes of 1, 2, 4 and so on."""
    n, value, taken, width = len(numbers) - size + 1, None, 0, 1
    while True:
        if size & width:
            part = numbers[taken : taken + n]
            value = part if value is None else _mixed(value, part)
            taken += width
        if 2 * width > size:
            return _mixed(value, np.uint64(2 * size + form))
        numbers = _mixed(numbers[:-width], numbers[width:])
        width *= 2


_WINDOWS = "hash bigint, form bigint, size bigint, at bigint, words string, slots array<string>"


def _row(words: tuple[list[str], list[str]], size: int, at: int, form: int, value: np.uint64) -> tuple:
    canonical, raw = words[0][at : at + size], words[1][at : at + size]
    slots = [f"{c}{r}" for c, r in zip(canonical, raw, strict=True) if c in _PLACES] if form == TEMPLATE else []
    return int(value.astype(np.int64)), form, size, at, " ".join(canonical if form == TEMPLATE else raw), slots


_PLACES = frozenset(PLACE.values())


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """Windows of each item; one shorter than the window is one window of its own.

    Every window stands as it is, one with enough literals as a template too.
    """

    def make():
        templates = Templates()

        def produce(item_id, text):
            words = templates.words(text)
            size = min(window, len(words[0]))
            if size:
                for _, as_is, values, enough in templates.windows(text, [size], window):
                    for at, usable in enumerate(enough.tolist()):
                        head = item_id, len(enough), int(enough.sum()), usable
                        yield *head, *_row(words, size, at, LITERAL, as_is[at])
                        if usable:
                            yield *head, *_row(words, size, at, TEMPLATE, values[at])

        return produce

    kind = items.schema["item_id"].dataType.simpleString()
    rows = items.select("item_id", text_or_empty().alias("text"))
    return flat_map(rows, make, f"item_id {kind}, n_windows bigint, n_usable bigint, usable boolean, {_WINDOWS}")


def find_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(doc_id, text_key, item_id, n_found, n_windows, coverage, same_slots) of every leak.

    docs has doc_id and text, items has item_id and text. A document leaks an
    item if its windows stand in it and cover at least `min_coverage` of the
    item's windows, or if RUN_WORDS words on end of the item stand in it. A window that stands there word for word counts; one with
    other values in its template's slots counts if its alignment fills the slots
    consistently (equal values with equal values). `same_slots` says that all
    values are the item's own; otherwise the question was re-parameterised. coverage is the greater of the shares of all windows
    (n_found of n_windows) and of those that have templates. text_key is the
    SHA-256 of the text.

    An item shorter than the window must stand in the text whole, word for word;
    its template will do if that has as many literals as a window needs. One of
    fewer than LEAST_WORDS words is only leaked by a text of just these words.

    Null texts, and items or documents without words, leak nothing. Rows with
    equal doc_id and text count once. Documents' windows are tested against a
    gate of fixed size first, which only keeps off what no item has; the join
    itself is a shuffled hash-key join that compares whole templates.
    """
    asked = materialise(item_windows(items, window))
    sizes = sorted(r["size"] for r in asked.select("size").distinct().collect())
    ship_package(docs.sparkSession)

    def gate(batches):
        taken = np.zeros(1 << GATE_BITS >> 3, dtype=np.uint8)
        for batch in batches:
            slot = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64) & np.uint64((1 << GATE_BITS) - 1)
            np.bitwise_or.at(taken, (slot >> np.uint64(3)).astype(np.int64), np.uint8(1) << (slot & np.uint64(7)).astype(np.uint8))
        at = np.flatnonzero(taken)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(taken[at].astype(np.int64))], names=["at", "bits"])

    bits = asked.select("hash").mapInArrow(gate, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    table = np.zeros(1 << GATE_BITS >> 3, dtype=np.uint8)
    found = bits.toArrow()
    table[found["at"].to_numpy()] = found["bits"].to_numpy().astype(np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def make():
        templates, open_ = Templates(), shared.value

        def produce(doc_id, text):
            words = key = None
            for size, as_is, values, enough in templates.windows(text, sizes, window):
                if size < min(window, LEAST_WORDS) and len(as_is) > 1:
                    continue
                for form, made, wanted in ((LITERAL, as_is, None), (TEMPLATE, values, enough)):
                    slot = made & np.uint64((1 << GATE_BITS) - 1)
                    hit = (open_[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1
                    for at in np.flatnonzero(hit if wanted is None else hit & wanted).tolist():
                        words = words or templates.words(text)
                        key = key or hashlib.sha256(text.encode()).hexdigest()
                        yield doc_id, key, *_row(words, size, at, form, made[at])

        return produce

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    met = flat_map(rows, make, f"doc_id {kind}, text_key string, {_WINDOWS}")
    own = ("hash", "form", "size", "at", "words", "slots")
    asked = asked.select("item_id", "n_windows", "n_usable", "usable", *(F.col(c).alias(f"i_{c}") for c in own))
    same = F.lit(True)
    for c in ("hash", "form", "size", "words"):
        same = same & (F.col(c) == F.col(f"i_{c}"))
    pairs = F.arrays_zip(F.col("i_slots").alias("asked"), F.col("slots").alias("given"))
    pairs = met.join(asked, same).select(
        "doc_id", "text_key", "item_id", "n_windows", "n_usable", "usable", "form", "i_at",
        (F.col("at") - F.col("i_at")).alias("shift"), F.array_distinct(pairs).alias("pairs"),
    )
    # Verbatim windows count anyway, templates if the slots of their alignment have as many pairs of values as values asked for.
    keys = ["doc_id", "text_key", "item_id", "n_windows", "n_usable"]
    place = F.struct("i_at", "usable")
    aligned = pairs.groupBy(*keys, "shift").agg(
        F.collect_set(F.when(F.col("form") == LITERAL, place)).alias("verbatim"),
        F.collect_set(F.when(F.col("form") == TEMPLATE, place)).alias("shaped"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
    )
    # The longest run of verbatim windows: where it began, which window comes next, and its length.
    def step(state, at):
        begin = F.when(at == state["next"], state["begin"]).otherwise(at)
        return F.struct(begin.alias("begin"), (at + 1).alias("next"), F.greatest(state["run"], at + 1 - begin).alias("run"))

    zero = F.struct(*(F.lit(n).cast("long").alias(c) for c, n in (("begin", -1), ("next", -1), ("run", 0))))
    run = F.aggregate(F.array_sort(F.transform("verbatim", lambda w: w["i_at"])), zero, step, lambda state: state["run"])
    consistent = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["asked"])))
    own_values = F.forall("pairs", lambda p: p["asked"] == p["given"])
    counted = F.when(consistent, F.concat("verbatim", "shaped")).otherwise(F.col("verbatim"))
    per_item = aligned.groupBy(*keys).agg(
        F.array_distinct(F.flatten(F.collect_list(counted))).alias("found"),
        F.every(~consistent | own_values).alias("same_slots"),
        F.max(run).alias("run"),
    )
    # Windows that only count as they are do not thin out a re-parameterised item.
    n_found, n_shaped = F.size("found").cast("long"), F.size(F.filter("found", lambda w: w["usable"]))
    coverage = F.greatest(n_found / F.col("n_windows"), n_shaped / F.nullif(F.col("n_usable"), F.lit(0)))
    leaks = per_item.select("doc_id", "text_key", "item_id", n_found.alias("n_found"), "n_windows", coverage.alias("coverage"), "same_slots", "run")
    return leaks.where((F.col("coverage") >= min_coverage) | (F.col("run") >= max(1, RUN_WORDS - window + 1))).drop("run")
