"""Tokenizing in tasks: ids of whole texts as little-endian unsigned 32-bit bytes."""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Callable

from .base import CACHES, give_back, keep_only

#: Texts of these characters only are plain.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf"[\t\n\r\x20-\x7e{_LETTERS}]*")
_PIECES = {
    "word": re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[0-9]|[^\s0-9{_LETTERS}]+"),
    "byte": re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+"),
}
_CHUNK = re.compile(r"(?<=\S)(?= )")


def _byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: visible Latin-1 characters stand for themselves, other bytes take letters from 256 on in order."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return [chr(256 + rest.index(b)) if b in rest else chr(b) for b in range(256)]


class _Kept(dict):
    """What `make` gives for strings seen lately. When `keep` are held they become the old ones, of which those used again are taken over."""

    def __init__(self, make: Callable[[str], bytes], keep: int) -> None:
        self.make, self.keep, self.old = make, keep, {}

    def __missing__(self, text: str) -> bytes:
        made = self.old.get(text) or self.make(text)
        if len(text) <= 64:
            if len(self) >= self.keep:
                self.old = dict(self)
                super().clear()
            self[text] = made
        return made

    def clear(self) -> None:
        super().clear()
        self.old = {}


class Encoder:
    """Ids of texts by a tokenizer file of the tokenizers library, equal to encoding each text whole.

    Such tokenizers split a text into pieces and their model encodes each piece by itself. In a text of plain Latin characters
    the pieces are found here, the file's own model encodes each new piece, and the ids of pieces seen lately are kept. Any other text is
    cut before each space that follows a character which isn't white space, as no piece of these files holds such a space in its
    middle; plain chunks go that way too, others to the tokenizer as they are. A text that spells an added token such as <|endoftext|>, in either
    case, is encoded whole. `kind` is the file's splitting rule: "word" (lower case, white space dropped) or "byte" (byte
    level, a piece keeps its leading space).
    """

    def __init__(self, path: str, kind: str, keep: int = 300_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind, self.find = kind, _PIECES[kind].findall
        letters = _byte_letters()
        self.written = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256) if _PLAIN.fullmatch(chr(c))}
        self.pieces = _Kept(self._piece, keep)

    def _piece(self, piece: str) -> bytes:
        return _bytes_of([t.id for t in self.model.tokenize(piece.translate(self.written))])

    def _whole(self, text: str) -> bytes:
        return _bytes_of(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def ids_of(self, text: str | None) -> bytes:
        """Ids of one text; null is empty."""
        if not text:
            return b""
        low = text.lower()
        if any(map(low.__contains__, self.added)):
            return self._whole(text)
        get = self.pieces.__getitem__
        if _PLAIN.fullmatch(text):
            return b"".join(map(get, self.find(low if self.kind == "word" else text)))
        made = []
        for chunk in _CHUNK.split(text):
            if _PLAIN.fullmatch(chunk):
                made += map(get, self.find(chunk.lower() if self.kind == "word" else chunk))
            else:
                made.append(self._whole(chunk))
        return b"".join(made)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """One bytes value for each text."""
        return list(map(self.ids_of, texts))

    def clear(self) -> None:
        self.pieces.clear()


def _bytes_of(ids: list[int]) -> bytes:
    made = array("I", ids)
    if sys.byteorder == "big":
        made.byteswap()
    return made.tobytes()


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """The worker's own encoder for a file: kept between tasks."""
    found = _ENCODERS.get((path, kind))
    keep_only(found)  # before a file is read: reading it takes more for a while than the encoder does
    if found is None:
        found = _ENCODERS[path, kind] = Encoder(path, kind)
        CACHES.append(found)
        give_back()
    return found


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file, looked up where the task runs unless name is already a path."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))
