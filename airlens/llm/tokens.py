"""Ids of whole texts as the tokenizers library gives them, each distinct stretch of text encoded once a worker.

A text is cut before every space that follows a character other than white space. Neither of the two split
patterns has an alternative that goes on from such a character into a space, and what follows a cut is split
as if the text began there, so the ids of the stretches, one after another, are the ids of the text. Special
tokens hold no spaces and are found inside a stretch just as inside the text. A stretch is encoded by the
tokenizers library when first met and remembered as little-endian bytes, within a bound.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
import regex
from tokenizers import Tokenizer

_CUT = re.compile(r"(?<!\s) ")
#: Texts of these characters need no normalisation beyond lower case and split alike in any Unicode version.
_PLAIN = re.compile(r"[\n\x20-;=-~\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
#: Stretches remembered in each of two generations of a worker's memory, their bytes, and the longest one that is.
REMEMBERED, REMEMBERED_BYTES, LONGEST = 250_000, 32 << 20, 1000


class Unsafe(Exception):
    """The text holds white space before a space."""


class _Memory(dict):
    """stretch without its leading space -> its ids; asks the encoder for what is missing."""

    def __init__(self, encoder: Encoder, old: dict):
        super().__init__()
        self.encoder, self.old, self.bytes = encoder, old, 0

    def __missing__(self, stretch: str) -> bytes:
        if not stretch or stretch[-1].isspace():
            raise Unsafe
        ids = self.old.get(stretch)
        if ids is None:
            ids = self.encoder.word(stretch) if stretch.isascii() and stretch.isalpha() else self.encoder.fresh(" " + stretch)
        if len(stretch) <= LONGEST:  # text without spaces is one long stretch, and seldom comes again
            self[stretch] = ids
            self.bytes += len(stretch) + len(ids)
        return ids

    def full(self) -> bool:
        return len(self) >= REMEMBERED or self.bytes >= REMEMBERED_BYTES


class Encoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        self.lower = bool(spec.get("normalizer"))  # the lower-casing one; it also makes all white space one space
        self.model = self.tokenizer.model
        self.model._resize_cache(0)  # what comes again is remembered here
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" if self.lower else r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.pieces = regex.compile(pattern).findall
        self.size = self.tokenizer.get_vocab_size()
        # The byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}
        self.known: dict[str, bytes] = {}
        self.memory = _Memory(self, {})

    def plain(self, text: str) -> bytes:
        """Ids by the library itself, of any text."""
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def fresh(self, text: str) -> bytes:
        """Ids of one stretch: by the library's model for plain pieces, else by the library as a whole."""
        if not _PLAIN.fullmatch(text):
            return self.plain(text)
        if text.isascii() and text.isalpha():
            return self.piece(text)
        out = []
        for piece in self.pieces(text.lower() if self.lower else text):
            ids = self.known.get(piece)
            out.append(self.piece(piece) if ids is None else ids)
        return b"".join(out)

    def word(self, letters: str) -> bytes:
        """Ids of a space and ASCII letters: one piece in either vocabulary, its bytes their own symbols."""
        symbols = letters.lower() if self.lower else "\u0120" + letters
        return array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes()

    def piece(self, piece: str) -> bytes:
        if self.lower:
            piece = piece.lower()
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        symbols = piece.encode().decode("latin-1").translate(self.letters)
        ids = array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes()
        if len(piece) <= LONGEST:
            self.known[piece] = ids
        return ids

    def renew(self) -> None:
        """A full memory becomes the older one of two."""
        if self.memory.full():
            self.memory = _Memory(self, dict(self.memory))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        self.renew()
        first, _, rest = text.partition(" ")
        if not first or first[-1].isspace():
            return self.careful(text)
        try:
            return self.fresh(first) + b"".join(map(self.memory.__getitem__, rest.split(" "))) if _ else self.fresh(first)
        except Unsafe:
            return self.careful(text)

    def careful(self, text: str) -> bytes:
        first, *rest = _CUT.split(text)
        return self.fresh(first) + b"".join(self.fresh(" " + x) for x in rest)

    @property
    def special(self) -> dict[int, str]:
        return {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}

    @lru_cache(maxsize=1)  # noqa: B019  an encoder lives as long as its worker
    def token_bytes(self) -> list[bytes]:
        """What each id stands for, of a byte-level vocabulary."""
        back = {chr(v): k for k, v in self.letters.items()}
        own = {i: s.encode() for i, s in self.special.items()}
        return [own.get(i) or bytes(back[c] for c in self.tokenizer.id_to_token(i)) for i in range(self.size)]

    def decode(self, ids: bytes) -> str:
        """As the library's decode(ids, skip_special_tokens=False) of a byte-level tokenizer."""
        return b"".join(map(self.token_bytes().__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The worker's own encoder of this file; its memory lasts from task to task."""
    return Encoder(path)
