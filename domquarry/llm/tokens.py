"""Token ids of whole texts, by the ``tokenizers`` library.

Both public vocabularies split a text into short pieces by a fixed pattern and
encode every piece on its own.  The encoder below finds the pieces with that
pattern, asks the library for the ids of each distinct piece once, and joins
them.  Texts with a character beyond Latin script go to the library whole, so
the ids are always those that the library gives for the whole text.  Names of
special tokens inside a text are ordinary text.
"""

from __future__ import annotations

import re
import sys
import types
from array import array

from tokenizers import Tokenizer

#: Latin letters, digits and white space up to U+024F, by Unicode category.
LETTERS, NUMBERS, BLANKS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"

#: The split patterns of the two vocabularies, for texts of these characters.
WORD_PIECES = re.compile(
    f"'[sStTmMdD]|'(?:[rR][eE]|[vV][eE]|[lL][lL])|[{LETTERS}]+|[{NUMBERS}]|[^{BLANKS}{LETTERS}{NUMBERS}]+")
BYTE_PIECES = re.compile(
    f"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{BLANKS}{LETTERS}{NUMBERS}]+"
    f"|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+")

#: Characters for which the patterns above do not hold (U+0130 lower-cases to two characters).
BEYOND = re.compile("[^\x00-įı-ɏ]")

PATTERNS = {"word": WORD_PIECES, "byte": BYTE_PIECES}


def worker_state() -> types.ModuleType:
    """A module of this Python process only: what it holds outlives a task, as
    Python workers are used again.  Nothing in it changes a result."""
    return sys.modules.setdefault("_worker_state_of_tokens", types.ModuleType("_worker_state_of_tokens"))


def release() -> None:
    """Drop what earlier tasks of this Python process left; for tasks that need none of it."""
    vars(worker_state()).clear()


def byte_characters() -> dict[int, int]:
    """The character that stands for each byte in a byte-level vocabulary: the
    printable ones of Latin-1 for themselves, the others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in shown]
    return {b: 0x100 + others.index(b) if b in others else b for b in range(256)}


BYTE_CHARACTERS = byte_characters()


def little_endian(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


#: Bytes of an entry of the memo besides its characters and ids: two objects and a place in the table.
ENTRY_BYTES = 160


class _Pieces(dict):
    """piece -> its ids as little-endian unsigned 32-bit integers, within ``limit`` bytes."""

    def __init__(self, tokenizer: Tokenizer, lower: bool, limit: int):
        super().__init__()
        self.tokenizer, self.model, self.lower, self.limit, self.held = tokenizer, tokenizer.model, lower, limit, 0

    def __missing__(self, piece: str) -> bytes:
        # one piece goes straight to the library's model, in the characters that stand for its bytes
        plain = piece.lower() if self.lower else piece
        ids = little_endian([t.id for t in self.model.tokenize(
            plain.encode().decode("latin-1").translate(BYTE_CHARACTERS))])
        if len(piece) <= 64:
            if self.held > self.limit:
                self.clear()
                self.held = 0
            self.held += ENTRY_BYTES + 2 * len(piece) + len(ids)
            self[piece] = ids
        return ids


class Encoder:
    """``ids(text)``: the ids as bytes.  ``kind``: ``word`` (white space dropped)
    or ``byte`` (byte-level), the way the vocabulary splits a text.  ``limit``
    bounds the bytes of the memo of pieces, which a worker's next task goes on with
    until a task calls ``release``."""

    def __init__(self, tokenizer_json: str, kind: str, limit: int = 48 << 20):
        state, key = worker_state(), f"{kind}-{hash(tokenizer_json)}-{limit}"
        if not hasattr(state, key):
            tokenizer = Tokenizer.from_str(tokenizer_json)
            tokenizer.encode_special_tokens = True
            setattr(state, key, _Pieces(tokenizer, kind == "word", limit))
        self.pieces, self.find = getattr(state, key), PATTERNS[kind].findall

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if BEYOND.search(text):
            return little_endian(self.pieces.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.pieces.__getitem__, self.find(text)))


def load(path: str) -> str:
    """The tokenizer file's text (a few MB), to ship with the task code."""
    with open(path, encoding="utf-8") as f:
        return f.read()
