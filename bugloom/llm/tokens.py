"""Token ids of whole texts by a public tokenizer, word by word with a bounded memory.

The tokenizer cuts a text into pieces before it merges bytes, and always cuts before a single
blank that is followed by something else than white space. Texts are split there, and the pieces
are encoded by the tokenizers library where a worker does not remember them (a plain word by its
model alone). The ids are those of the whole text, which tests check.
"""

import gc
import re
from array import array

from tokenizers import Tokenizer

from bugloom.llm.common import worker_memory

# Fixed value: how the vocabulary's tokenizer cuts printable ASCII without white space inside.
_ASCII_PIECE = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^ A-Za-z0-9]+")
_CONTROL = re.compile(r"[^!-~]")

CACHE_PIECES = 700_000
LONG_PIECE = 13  # longer ones seldom come again
VOCABULARY = "byte_bpe_50k.json"
# A blank before white space or at the end: there a piece may reach over it.
_LOOSE_BLANK = re.compile(r" (?=[\s\x1c-\x1f\x85᠎​]|\Z)")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


_ASCII_SPACES = "\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"


def _is_loose(text: str) -> bool:
    """Does a blank come before white space or at the end? Plain searches do for ASCII."""
    if not text.isascii():
        return _LOOSE_BLANK.search(text) is not None
    return (
        text.endswith(" ") or "  " in text
        or any(c in text and " " + c in text for c in _ASCII_SPACES)
    )


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte: printable ones for themselves, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in plain)
    return {b: 256 + k for k, b in enumerate(others)}


class _Known(dict):
    """Ids of short pieces; new ones are learnt, those long not asked for forgotten."""

    def __init__(self, learn, most: int):
        self.learn, self.most, self.older = learn, most, {}

    def __missing__(self, piece: str) -> bytes:
        if len(piece) > LONG_PIECE:
            return self.learn(piece)
        found = self.older.get(piece)
        if found is None:
            found = self.learn(piece)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[piece] = found
        return found


class Encoder:
    """Little-endian unsigned 32-bit ids of texts, as bytes."""

    def __init__(self, path: str | None = None, cache_pieces: int = CACHE_PIECES):
        self.tokenizer = Tokenizer.from_file(path or vocabulary_path())
        # The vocabulary's special strings are ordinary text where they occur in a document.
        self.tokenizer.encode_special_tokens = True
        self.merge = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.blank = chr(self.letters[ord(" ")])
        self.marks = {m: self.direct([m])[0] for m in ".,;:!?"}
        self.line = self.direct(["\n"])[0]
        # Pieces at a beginning, and pieces after a blank, named without it.
        self.first = _Known(self._learn, max(1, cache_pieces // 16))
        self.after_blank = _Known(self._learn_after_blank, max(1, cache_pieces // 2))

    def direct(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _word(self, blank: str, word: str) -> bytes:
        """Ids of letters after a blank or none, which stay in one piece."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.merge(blank + word)]).tobytes()

    def _learn_after_blank(self, piece: str) -> bytes:
        if piece.isalpha():
            return self._word(self.blank, piece)
        return self._other(" ", piece, self.after_blank)

    def _learn(self, piece: str) -> bytes:
        if piece.isalpha():
            return self._word("", piece)
        return self._other("", piece, self.first)

    def _other(self, blank: str, piece: str, known: _Known) -> bytes:
        """Ids of a piece that is not letters alone."""
        if piece[-1:] in self.marks and piece[:-1].isalpha():
            return known[piece[:-1]] + self.marks[piece[-1]]
        left, line, right = piece.partition("\n")
        if left and right and not left[-1].isspace() and not right[0].isspace():
            # A single line end between other signs is a piece of its own.
            return known[left] + self.line + self.first[right]
        if not piece.isascii() or _CONTROL.search(piece):
            return self.direct([blank + piece])[0]
        parts = _ASCII_PIECE.findall(blank + piece)
        return b"".join(
            self._word(self.blank, p[1:]) if p[0] == " " else self._word("", p) for p in parts
        )

    def _encode(self, text: str) -> bytes:
        if _is_loose(text):
            return self.direct([text])[0]
        head, *rest = text.split(" ")
        first = self.first[head] if head else b""
        return first + b"".join(map(self.after_blank.__getitem__, rest))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; a null text has none."""
        # Nothing here forms cycles; collections would walk the remembered pieces for nothing.
        collects = gc.isenabled()
        gc.disable()
        try:
            return [self._encode(t) if t else b"" for t in texts]
        finally:
            if collects:
                gc.enable()


def encoder(path: str | None = None) -> Encoder:
    """This worker's encoder, kept between tasks until another operator's tasks come."""
    return worker_memory(("encoder", path), lambda: Encoder(path))
