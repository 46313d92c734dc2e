"""Token ids of whole texts with a public tokenizer file.

Byte-level and word BPE files cut a text into pieces before merging, and no
piece holds a letter on both sides of a white-space run. So a text can be cut
before a space or line break that follows something else than white space, and
the ids of the parts, end to end, are the ids of the whole. Parts recur, so
each Python worker keeps the ids of up to CACHE parts.

Special tokens in a text count as the plain library counts them: a part that may
hold one goes to the library as it is.
"""

from __future__ import annotations

import os
import re
from array import array

#: Parts whose ids a worker keeps in each of two stores. When the newer one is
#: full it becomes the older one, so parts that recur stay.
CACHE = 600_000
_MARKS = frozenset(",.;:!?")

_CUT = re.compile(r"(?<=\S)(?=[ \n])")
#: Pieces of ASCII parts without apostrophe, by kind of file.
_SPACED = re.compile(r" ?[A-Za-z]+| ?[0-9]+| ?[!-/:-@\[-`{-~]+")
_SPACELESS = re.compile(r"[a-z]+|[0-9]|[!-/:-@\[-`{-~]+")

#: Byte-level files name each byte by a printable character: itself where it
#: is one, else the next one from U+0100 on.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARS = {b: 256 + n for n, b in enumerate(x for x in range(256) if x not in _SHOWN)}


def _plain(part: str) -> bool:
    """Only characters below U+0250, whose case and normal form are settled."""
    return part.isascii() or (max(part) < "ɐ" and "İ" not in part)


class _Inner(Exception):
    """A part ends in white space, so the text was cut inside a run of it."""


class _Store(dict):
    """Ids by part; finds those of new parts."""

    def __init__(self, encoder: Encoder, old: dict[str, bytes]) -> None:
        self.encoder, self.old = encoder, old

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            ids = self.encoder.learn(part, self)
        self[part] = ids
        return ids


class Encoder:
    """Encodes texts to little-endian ids of a fixed width.

    drops_space: the file's pre-tokenizer throws white space away, so parts
    need not carry the space before them.
    """

    def __init__(self, path: str, code: str, drops_space: bool) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.code, self.drops_space = code, drops_space
        self.pieces = _SPACELESS if drops_space else _SPACED
        self.known = _Store(self, {})

    def whole(self, text: str) -> bytes:
        """The library's ids, without a look at the stores."""
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def learn(self, part: str, known: _Store) -> bytes:
        """The ids of a new part. Pieces end before a break and between a settled
        letter and a closing mark, so these have ids of their own. A run of Latin
        letters, with or without a space before it, is one piece for either kind
        of file and goes straight to the merges of the library's model."""
        if not part:
            return b""
        last = part[-1]
        if last.isspace() and not self.drops_space:
            raise _Inner
        if "<|" in part:
            return self.whole(part)
        if last in _MARKS and len(part) > 1 and part[-2].isalpha() and _plain(part[-2]):
            return known[part[:-1]] + known[last]
        if part[0] == "\n" and len(part) > 1 and not part[1].isspace():
            return self.whole("\n") + known[part[1:]]
        if self.drops_space and _plain(part):
            low = part.lower()  # as the file's normaliser does
            if low != part:
                return known[low]
        if (part[1:] if part[0] == " " else part).isalpha() and _plain(part):
            runs = [part]
        elif part.isascii() and "'" not in part:
            runs = self.pieces.findall(part)
            if sum(map(len, runs)) < len(part):  # white space or control characters inside
                return self.whole(part)
        else:
            return self.whole(part)
        ids: list[int] = []
        for x in runs:
            mapped = x.replace(" ", "Ġ") if x.isascii() else x.encode().decode("latin-1").translate(_BYTE_CHARS)
            ids += [t.id for t in self.merge(mapped)]
        return array(self.code, ids).tobytes()

    def _by_parts(self, text: str) -> bytes:
        get = self.known.__getitem__
        if self.drops_space:
            return b"".join(map(get, text.replace("\n", " ").split(" ")))
        if "\x01" not in text:
            try:
                return b"".join(map(get, text.replace(" ", "\x01 ").replace("\n", "\x01\n").split("\x01")))
            except _Inner:
                pass
        *parts, last = _CUT.split(text)
        return b"".join([*map(get, parts), self.whole(last)])  # the last may end in white space

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, end to end, as bytes."""
        out = []
        for text in texts:
            if len(self.known) > CACHE:  # what is in use moves over from the old store
                full = self.known
                full.old = {}
                self.known = _Store(self, full)
            out.append(self._by_parts(text))
        return out


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, code: str = "I", drops_space: bool = False) -> Encoder:
    """This process's encoder of a file."""
    key = (path, code)
    if key not in _encoders:
        _encoders[key] = Encoder(path, code, drops_space)
    return _encoders[key]
