"""Byte-level BPE: tree concatenation of encoded halves, and decoding."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingrisk.llm.common import arrow_schema, flat_map, text_or_empty
from filingrisk.llm.vocabulary import byte_letters, encoded_pieces, tokenizer

#: Longest text, in code points, that is encoded in one go; longer ones are halved.
LEAF_CHARS = 4096
#: Longest part of a text that one task encodes; longer texts are spread over tasks.
TASK_CHARS = 65_536

_ODD_SPACE = re.compile(r" \s|[^\S ] |^ | $")
_SAFE = re.compile(r"(?<=\S)(?= \S)")


@dataclass
class Vocabulary:
    path: str
    pieces: list[bytes]  # bytes of each id
    lengths: np.ndarray  # and how many
    special: dict[str, int]


@cache
def vocabulary(path: str) -> Vocabulary:
    made = tokenizer(path)
    special = {t.content: i for i, t in made.get_added_tokens_decoder().items()}
    letters = {letter: b for b, letter in byte_letters().items()}
    pieces = [b""] * made.get_vocab_size(with_added_tokens=True)
    for token, i in made.get_vocab(with_added_tokens=True).items():
        pieces[i] = token.encode() if token in special else bytes(letters[c] for c in token)
    return Vocabulary(path, pieces, np.array([len(p) for p in pieces], dtype=np.int64), special)


def encode_text(text: str, path: str, leaf: int = LEAF_CHARS) -> np.ndarray:
    """Ids of a text, special tokens in it as the library takes them."""
    vocab = vocabulary(path)
    out = []
    for part, special in _parts(text, vocab):
        out.append(_tree(part, vocab, leaf))
        if special is not None:
            out.append(np.array([special], dtype="<u4"))
    return np.concatenate(out)


def _parts(text: str, vocab: Vocabulary):
    """(text up to a special token, its id), the last with None."""
    if any(s in text for s in vocab.special):
        pattern = "|".join(re.escape(s) for s in sorted(vocab.special, key=len, reverse=True))
        at = 0
        for m in re.finditer(pattern, text):
            yield text[at : m.start()], vocab.special[m[0]]
            at = m.end()
        text = text[at:]
    yield text, None


def _tree(text: str, vocab: Vocabulary, leaf: int) -> np.ndarray:
    if len(text) <= leaf:
        return _leaf(text, vocab)
    mid = len(text) // 2
    left, right = text[:mid], text[mid:]
    return join_encoded(left, _tree(left, vocab, leaf), right, _tree(right, vocab, leaf), vocab)


def _leaf(text: str, vocab: Vocabulary) -> np.ndarray:
    """Ids of a text without special tokens, piece by piece.

    A single space between two other characters always starts a new piece in the
    vocabulary's splitting, so texts cut there are encoded independently.
    """
    known = encoded_pieces(vocab.path)
    if _ODD_SPACE.search(text):
        pieces = _SAFE.split(text)
        packed = b"".join([known[p] for p in pieces if p])
    else:
        first, *rest = text.split(" ")
        packed = known[first] + b"".join([known[" " + p] for p in rest]) if first or rest else b""
    return np.frombuffer(packed, dtype="<u4")


def _class(char: str) -> str:
    """Letter, number, space or other; nothing where Unicode versions may differ."""
    kind = unicodedata.category(char)
    if kind == "Cn" or ord(char) >= 0xA000:
        return ""
    if char.isspace():
        return "Z"
    return kind[0] if kind[0] in "LN" else "P"


def _cut_kind(raw: bytes, at: int) -> str:
    """What a cut of raw UTF-8 at a byte means: 'safe', 'inner' or ''.

    safe: pieces never cross it. inner: it lies within one piece, whatever
    stands further away, because enough characters of one class surround it.
    """
    if at <= 0 or at >= len(raw):
        return "safe"
    if raw[at] & 0xC0 == 0x80:
        return ""
    before = raw[max(0, at - 24) : at].decode(errors="ignore")[-4:]
    after = raw[at : at + 12].decode(errors="ignore")[:2]
    if len(after) == 2 and after[0] == " " and not after[1].isspace() and before and not before[-1].isspace():
        return "safe"
    if len(before) < 4 or len(after) < 2:
        return ""
    kinds = {_class(c) for c in before} | {_class(c) for c in after}
    return "inner" if len(kinds) == 1 and "" not in kinds else ""


def _edge(offsets: np.ndarray, ids: np.ndarray, least: int, raw: bytes, forward: bool, vocab: Vocabulary) -> tuple[int, str]:
    """How many of the tokens nearest the join to encode again: the first usable
    cut at least `least` tokens away, or all; and the kind of that cut."""
    specials = set(vocab.special.values())
    for n in range(1, len(ids)):
        # The n-th token is the last one taken; beyond a special token nothing reaches.
        beyond = int(ids[n] if forward else ids[-n - 1])
        if beyond in specials:
            return n, "safe"
        if n >= least and (kind := _cut_kind(raw, int(offsets[n - 1]))):
            return n, kind
    return len(ids), "safe"


def join_encoded(left: str, a: np.ndarray, right: str, b: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Ids of left + right from the ids of each.

    A window around the join is encoded again and grown until both sides agree:
    either its end is a cut that no piece crosses, or the window's outermost
    token is the one that the side had there. In the second case the cut is
    within one piece, where ids are right if each neighbouring pair is, and all
    pairs come from right encodings: of the side, or of the window.
    """
    if not len(a) or not len(b):
        return a if len(a) else b
    specials = set(vocab.special.values())
    if int(a[-1]) in specials or int(b[0]) in specials:
        return np.concatenate([a, b])
    reach = 16
    while True:
        tail, head = a[-2 * reach - 64 :], b[: 2 * reach + 64]
        known_left = _tail_text(left, int(vocab.lengths[tail].sum())) if len(tail) < len(a) else left.encode()
        known_right = _head_text(right, int(vocab.lengths[head].sum())) if len(head) < len(b) else right.encode()
        raw, cut = known_left + known_right, len(known_left)
        back = cut - np.cumsum(vocab.lengths[tail][::-1])
        ahead = cut + np.cumsum(vocab.lengths[head])
        n, kind_a = _edge(back, tail, reach, raw, False, vocab)
        m, kind_b = _edge(ahead, head, reach, raw, True, vocab)
        open_a, open_b = n == len(tail) < len(a), m == len(head) < len(b)
        if not open_a and not open_b:
            window = raw[int(back[n - 1]) : int(ahead[m - 1])].decode()
            made = np.asarray(tokenizer(vocab.path).encode(window, add_special_tokens=False).ids, dtype="<u4")
            agrees = len(made) > 1 and (kind_a == "safe" or made[0] == a[-n]) and (kind_b == "safe" or made[-1] == b[m - 1])
            if agrees or (kind_a == kind_b == "safe"):
                return np.concatenate([a[: len(a) - n], made, b[m:]])
        reach *= 2


def _tail_text(text: str, n_bytes: int) -> bytes:
    """The last bytes of a text, some more than n_bytes of them."""
    return text[-n_bytes - 8 :].encode()


def _head_text(text: str, n_bytes: int) -> bytes:
    return text[: n_bytes + 8].encode()


def decode_ids(packed: bytes, path: str) -> str:
    """The text of ids packed as little-endian unsigned 32-bit integers; unknown ids add nothing."""
    pieces = vocabulary(path).pieces
    ids = np.frombuffer(packed, dtype="<u4")
    return b"".join([pieces[i] for i in ids.tolist() if i < len(pieces)]).decode("utf-8", errors="replace")


def _task_parts(text: str, vocab: Vocabulary, size: int) -> list[str]:
    """A text in equal parts of about `size`; no cut divides a special token."""
    count = -(-len(text) // size)
    cuts = [len(text) * i // count for i in range(count + 1)]
    for i in range(1, count):
        for special in vocab.special:
            at = text.find(special, max(0, cuts[i] - len(special) + 1), cuts[i] + len(special) - 1)
            if at != -1 and at < cuts[i]:
                cuts[i] = at + len(special)
    return [text[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]


def encode_documents(docs: DataFrame, path: str, decoded: bool = False, task_chars: int = TASK_CHARS, leaf: int = LEAF_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit, packed) and, if asked, decoded.

    As the tokenizers library encodes with add_special_tokens=False; `path` is
    the tokenizer's file on every machine. A null text is empty and has no ids.
    Repeated rows give repeated rows; other columns are not read. Texts are
    halved down to `leaf` code points and joined again; texts over `task_chars`
    are spread over tasks first, each distinct one once.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    result = "n_tokens bigint, ids binary" + (", decoded string" if decoded else "")

    def finish(ids: np.ndarray) -> tuple:
        packed = ids.astype("<u4").tobytes()
        return (len(ids), packed, decode_ids(packed, path)) if decoded else (len(ids), packed)

    def make_short():
        def produce(doc_id, text):
            yield doc_id, *finish(encode_text(text, path, leaf))

        return produce

    short = flat_map(rows.where(F.length("text") <= task_chars), make_short, f"doc_id {kind}, {result}")

    long = rows.where(F.length("text") > task_chars).withColumn("key", F.sha2("text", 256))

    def make_parts():
        def produce(key, text):
            parts = _task_parts(text, vocabulary(path), task_chars)
            for i, part in enumerate(parts):
                yield key, i, part

        return produce

    parts = flat_map(long.select("key", "text").dropDuplicates(["key"]), make_parts, "key string, part bigint, text string")

    def make_encoded():
        def produce(key, part, text):
            yield key, part, text, encode_text(text, path, leaf).astype("<u4").tobytes()

        return produce

    spread = parts.repartition(F.col("key"), F.col("part"))
    encoded = flat_map(spread, make_encoded, "key string, part bigint, text string, ids binary")
    schema = arrow_schema(f"key string, {result}")

    def join_parts(table: pa.Table) -> pa.Table:
        vocab = vocabulary(path)
        made = [(r["text"], np.frombuffer(r["ids"], dtype="<u4")) for r in table.sort_by("part").to_pylist()]
        while len(made) > 1:
            pairs = [
                (x[0] + y[0], join_encoded(*x, *y, vocab)) for x, y in zip(made[::2], made[1::2], strict=False)
            ]
            made = pairs + made[len(made) - len(made) % 2 :]
        return pa.Table.from_pylist([dict(zip(schema.names, (table["key"][0].as_py(), *finish(made[0][1])), strict=True))], schema=schema)

    joined = encoded.groupBy("key").applyInArrow(join_parts, f"key string, {result}")
    joined = joined.withColumnRenamed("key", "text_key")
    back = long.select("doc_id", "key").join(joined, F.col("key") == F.col("text_key")).drop("key", "text_key")
    return short.unionByName(back)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of packed `ids`; null ids give an empty text."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def make():
        def produce(doc_id, ids):
            yield doc_id, decode_ids(ids or b"", path)

        return produce

    return flat_map(encoded.select("doc_id", "ids"), make, f"doc_id {kind}, decoded string")
