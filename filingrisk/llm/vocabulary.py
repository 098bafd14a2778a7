"""Access to tokenizer files inside tasks; vocabularies are read, never trained."""

from __future__ import annotations

import json
import os
import re
from functools import cache

import numpy as np

#: Pieces that a worker keeps encoded, at most; full, it starts anew.
CACHED_PIECES = 300_000
#: Longer pieces are encoded each time.
CACHED_CHARS = 48

# The two splitting rules known here, narrowed to Latin-1 text.
_LETTER, _NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
_OTHER = rf"[^\s{_LETTER}{_NUMBER}]"
_SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d"
WORD_RULE = re.compile(rf"{_SUFFIXES}|[{_LETTER}]+|[{_NUMBER}]|{_OTHER}+")
BYTE_RULE = re.compile(rf"{_SUFFIXES}| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?{_OTHER}+|\s+(?!\S)|\s+")
#: Text on which Python's classes and the rules' own agree, without what special tokens start with.
_PLAIN = re.compile("[\x20-\x3b\x3d-\x7e\n\r\t\xa1-\xac\xae-\xff]+")


@cache
def tokenizer(path: str):
    """The library's tokenizer without truncation or padding, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


@cache
def byte_letters() -> dict[int, str]:
    """The letters that stand for the 256 bytes in byte-level vocabularies.

    Fixed rule: printable Latin-1 bytes stand for themselves, the others take
    the code points from 256 on in order.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def splitting(path: str) -> tuple[re.Pattern, bool] | None:
    """The rule by which a tokenizer file splits plain text, and whether it lower-cases; None if unknown."""
    with open(path, encoding="utf-8") as source:
        made = json.load(source)
    steps = made.get("pre_tokenizer") or {}
    if steps.get("type") == "ByteLevel" and not made.get("normalizer"):
        return (BYTE_RULE, False) if steps.get("use_regex") and not steps.get("add_prefix_space") else None
    parts = steps.get("pretokenizers") or [{}]
    pattern = (parts[0].get("pattern") or {}).get("Regex", "")
    kinds = [n.get("type") for n in (made.get("normalizer") or {}).get("normalizers", [])]
    known = pattern == _SUFFIXES + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" and [p.get("type") for p in parts] == ["Split", "ByteLevel"]
    return (WORD_RULE, True) if known and kinds == ["NFC", "Replace", "Lowercase"] else None


class EncodedPieces(dict):
    """piece -> its ids as little-endian 32-bit bytes, filled on demand by the library.

    Plain Latin-1 pieces are split here by the tokenizer's own rule, and the
    library's model merges each part; it is kept too, since parts repeat more
    often than pieces. All other pieces take the library's whole way.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        self.tokenizer = tokenizer(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.rule, self.lower = (all(t.startswith("<") for t in special) and splitting(path)) or (None, False)
        self.parts = EncodedParts(self.tokenizer)

    def of_text(self, text: str) -> bytes:
        """Packed ids of a whole text, for vocabularies that join nothing across white space.

        Plain text is split by the rule at once; other text at white space, each
        piece on its own. (Python takes four control characters for white space,
        the rule does not.)
        """
        if self.rule is WORD_RULE and _PLAIN.fullmatch(text):
            parts = self.parts
            return b"".join([parts[p] for p in self.rule.findall(text.lower() if self.lower else text)])
        if any(mark in text for mark in "\x1c\x1d\x1e\x1f"):
            return b"".join([self[p] for p in re.split("[ \n\t\r]", text) if p])
        return b"".join([self[p] for p in text.split()])

    def __missing__(self, piece: str) -> bytes:
        if self.rule and _PLAIN.fullmatch(piece):
            text = piece.lower() if self.lower else piece
            # Letters alone are one part, also behind the byte rule's blank.
            if text.isalpha():
                ids = self.parts[text]
            else:
                parts = self.parts
                ids = b"".join([parts[p] for p in self.rule.findall(text)])
        else:
            ids = np.asarray(self.tokenizer.encode(piece, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class EncodedParts(dict):
    """Part of a piece, as the splitting rule gives it -> its packed ids."""

    def __init__(self, made) -> None:
        super().__init__()
        self.model = made.model
        self.letters = byte_letters()
        size = made.get_vocab_size(with_added_tokens=True)
        self.packed = [i.to_bytes(4, "little") for i in range(size)]

    def __missing__(self, part: str) -> bytes:
        spelled = part if part.isascii() and part.isalpha() else part.encode().decode("latin-1").translate(self.letters)
        packed = self.packed
        ids = b"".join([packed[t.id] for t in self.model.tokenize(spelled)])
        if len(part) <= CACHED_CHARS:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[part] = ids
        return ids


@cache
def encoded_pieces(path: str) -> EncodedPieces:
    """One per worker process, kept between tasks."""
    return EncodedPieces(path)
