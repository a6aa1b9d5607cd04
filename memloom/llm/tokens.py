"""Token ids of whole texts with a per-worker cache of the ids of space-separated chunks.

The cache rests on one property of the two supported kinds of tokenizer: a text may be cut
at certain white space and the ids of the parts, joined, are those of the whole. Kind
``byte`` (byte-level BPE, GPT-2 pattern): before a space, and around a newline, that
touches no other white space. Kind ``word`` (lower case, white space is dropped): at any
space or newline. Texts that can't be cut so are encoded in one piece.

A chunk that is plain letters and then plain punctuation is two words to the tokenizer's
own pattern, so it is handed to the library's BPE model as such, without the cost of its
normaliser and pattern; any other chunk goes through the whole tokenizer.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks of an executor share its cores already

from tokenizers import Tokenizer  # noqa: E402

#: Chunks of each of two generations whose ids a worker keeps, about 220 bytes each.
CACHED = 150_000
_TOUCHING = re.compile(r"\s[ \n]|[ \n]\s")
#: Letters that both lower-case alike and are stable under normalisation (U+0130 is not), then punctuation without apostrophes.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ſ]+)([.,;:!?%#$*&|()\"-]*)")
#: White space other than space and newline.
_OTHER_SPACE = [chr(x) for x in (0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
#: Byte-level BPE writes bytes as characters: printable Latin-1 as itself, the others from U+0100 on.
_SAME = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_CHARS = {b: b if b in _SAME else 0x100 + sum(x not in _SAME for x in range(b)) for b in range(256)}
_SPACE = chr(_BYTE_CHARS[0x20])
_loaded: dict[tuple[str, str], ChunkedTokenizer] = {}


def tokenizer(path: str, kind: str) -> ChunkedTokenizer:
    """One for each worker process, as loading takes a second."""
    if (path, kind) not in _loaded:
        _loaded[path, kind] = ChunkedTokenizer(path, kind)
    return _loaded[path, kind]


class _Cache(dict):
    """Values by key, made when first asked for. A full generation becomes the old one, from which keys in use are taken over."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > CACHED:
            self.old = dict(self)
            self.clear()


class ChunkedTokenizer:
    def __init__(self, path: str, kind: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = kind
        self.lead = " " if kind == "byte" else ""
        self.tails = _Cache(self._whole)
        self.after = _Cache(lambda x: self._chunk(x, self.lead))  # chunks that follow a space
        self.first = _Cache(lambda x: self._chunk(x, ""))  # chunks that begin a line
        self.cores = _Cache(self._core)
        self.newline = self._whole("\n") if kind == "byte" else b""

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; null is empty."""
        for cache in (self.after, self.first, self.cores, self.tails):
            cache.trim()
        one = self._words if self.kind == "word" else self._lines
        return [one(x or "") for x in texts]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _core(self, word: str) -> bytes:
        """Ids of letters, after a space if the word begins with one."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_BYTE_CHARS)
        elif word[0] == " ":
            word = _SPACE + word[1:]
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _chunk(self, chunk: str, lead: str) -> bytes:
        if plain := _PLAIN.fullmatch(chunk):
            core, tail = plain.groups()
            ids = self.cores[lead + (core.lower() if self.kind == "word" else core)]
            return ids + self.tails[tail] if tail else ids
        return self._whole(lead + chunk) if chunk or self.kind == "byte" else b""

    def _words(self, text: str) -> bytes:
        return b"".join(map(self.after.__getitem__, text.replace("\n", " ").split(" ")))

    def _lines(self, text: str) -> bytes:
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or any(c in text for c in _OTHER_SPACE) and _TOUCHING.search(text):
            return self._whole(text)
        out, get = [], self.after.__getitem__
        for line in text.split("\n"):
            head, space, rest = line.partition(" ")
            out.append(self.first[head] + b"".join(map(get, rest.split(" "))) if space else self.first[head])
        return self.newline.join(out)
