"""Exact token ids of whole texts through a public tokenizer, with a memory of what was encoded.

Both vocabularies split a text by a fixed pattern before merging, and merge inside a piece only. Pieces
repeat, so each new one goes through the tokenizers library's model once and is remembered. This holds
for texts of ASCII and Latin-1 letters; any other text, or one with a special token's mark, is encoded
whole by the library. Results are those of ``encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

from multirun.llm.common import fresh, keep

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces remembered by a worker before the ones not used again are dropped; as many older ones stay beside them.
MEMORY = 250_000
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Latin-1 bytes of the texts that are split here.
SURE = "".join(chr(c) for c in range(256) if re.match(rf"[ -~\n{LETTER}]", chr(c))).encode("latin-1")
CONTRACTED = "'s|'t|'re|'ve|'m|'ll|'d"
#: The vocabularies' splitting patterns for that alphabet (fixed values).
PIECES = {
    "keeps space": re.compile(rf"{CONTRACTED}| ?[{LETTER}]+| ?[0-9]+| ?[^\s{LETTER}0-9]+|\s+(?!\S)|\s+"),
    "drops space": re.compile(rf"{CONTRACTED}|[{LETTER}]+|[0-9]|[^\s{LETTER}0-9]+"),
}


def byte_letters() -> dict[int, str]:
    """Code points below 256 to the letters that stand for their UTF-8 bytes in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(256)}


class Memory(dict):
    """Piece to ids as little-endian bytes; what is missing is encoded, and long unused ones go."""

    def __init__(self, model):
        self.model, self.letters, self.old = model, byte_letters(), {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            a = array("I", [t.id for t in self.model.tokenize(piece.translate(self.letters))])
            if sys.byteorder == "big":
                a.byteswap()
            ids = a.tobytes()
        if len(self) >= MEMORY:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


def sure(text: str) -> bool:
    """Whether a text holds nothing but ASCII and Latin-1 letters, and no mark of a special token."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return b"<|" not in raw and not raw.translate(None, SURE)


class Encoder:
    def __init__(self, path: str, drops_space: bool = False):
        """``drops_space``: the vocabulary lowers letters and ignores white space."""
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.lowers = drops_space
        self.pieces = PIECES["drops space" if drops_space else "keeps space"]
        self.known = Memory(self.tok.model)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers; a null or empty text has none."""
        if not text:
            return b""
        if not sure(text):
            ids = array("I", self.tok.encode(text, add_special_tokens=False).ids)
            if sys.byteorder == "big":
                ids.byteswap()
            return ids.tobytes()
        return b"".join(map(self.known.__getitem__, self.pieces.findall(text.lower() if self.lowers else text)))


_ENCODERS: dict[tuple, Encoder] = {}
keep("tokens", _ENCODERS.clear)


def encoder(path: str, drops_space: bool = False) -> Encoder:
    """One per worker process and vocabulary file, kept from task to task."""
    fresh("tokens")
    key = (path, drops_space)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, drops_space)
    return _ENCODERS[key]
