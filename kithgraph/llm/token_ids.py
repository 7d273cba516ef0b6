"""Token ids of whole texts by a byte-level BPE of the tokenizers library.

The library's pre-tokenizer cuts a text into pieces that its model encodes on their own, and it
always cuts before a space that stands before a visible character, and around a line feed that stands
alone or beside one other. So a text is split there, and ids are kept by chunk: words come back often,
and only new ones pass through the library. A text that holds the name of a special token goes through
the library whole, which reads it as that token.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

#: Chunks kept by a Python worker, at most (about 200 bytes each); further ones are encoded each time.
KEPT = 300_000
_CUT = re.compile(r"(?= \S)")
_ODD = re.compile(r" \s")
#: A line feed that may belong to a longer piece: before other white space, in a run of three, in a pair behind other white space, or in white space that ends the text.
_ODD_LINE = re.compile(r"\n(?:[^\S\n]|\n(?:\n|\Z|(?<=[^\S\n]\n\n))|(?<=[^\S\n]\n)\Z)")
#: Marks of which a run behind a word is one piece.
_MARKS = ".,;:!?*$%#"
#: A word of Latin letters, and marks behind it: pieces of their own to the pre-tokenizer.
_LATIN = [*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x250)]
_WORD = re.compile(rf"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+)([{_MARKS}]*)")


class _Library:
    """Ids, as little-endian bytes, of chunks that aren't known yet."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.library, self.tokenize = whole, whole.model.tokenize
        self.special = [t.content for t in whole.get_added_tokens_decoder().values()]
        self.size, self.kind = (2, "H") if whole.get_vocab_size() <= 1 << 16 else (4, "I")
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.letters = dict(zip(printable, printable, strict=True)) | {b: 256 + i for i, b in enumerate(others)}
        self.space = chr(self.letters[32])
        self.written = {chr(c): chr(c).encode().decode("latin-1").translate(self.letters) for c in _LATIN}
        self.spaced, self.plain = _Chunks(self, " "), _Chunks(self, "")
        self.line = self.ids("", "\n")

    def word(self, before: str, letters: str) -> bytes:
        """Ids of one piece, given in the vocabulary's letters."""
        return array(self.kind, [t.id for t in self.tokenize(self.space + letters if before else letters)]).tobytes()

    def ids(self, before: str, chunk: str) -> bytes:
        """Ids of a chunk behind a space or nothing."""
        if chunk.isascii():
            word = chunk.rstrip(_MARKS)
            if word.isalpha():
                return (self.spaced if before else self.plain)[word] + self.plain[chunk[len(word) :]]
        elif simple := _WORD.fullmatch(chunk):
            word, marks = simple.groups()
            if marks:
                return (self.spaced if before else self.plain)[word] + self.plain[marks]
            return self.word(before, "".join(map(self.written.__getitem__, word)))
        pieces = self.pieces(before + chunk)
        if len(pieces) > 1:
            return b"".join([self.spaced[p[1:]] if p[0] == " " and p[1:2] not in ("", "\n") else self.plain[p] for p in pieces])
        letters = (before + chunk).encode("utf-8", "replace").decode("latin-1").translate(self.letters)
        return self.word("", letters)


class _Chunks(dict):
    """chunk without the space before it -> its ids with that space, filled on first sight. A chunk that starts with a line feed has no space before it."""

    def __init__(self, library: _Library, before: str):
        self.library, self.before, self.first = library, before, before and library.space
        self.kind, self.tokenize = library.kind, library.tokenize

    def __missing__(self, chunk: str) -> bytes:
        library = self.library
        if chunk.isascii() and chunk.isalpha():  # the usual case, in few calls
            ids = array(self.kind, [t.id for t in self.tokenize(self.first + chunk)]).tobytes()
        elif self.before and chunk[:1] == "\n":
            ids = library.line + library.plain[chunk[1:]] if len(chunk) > 1 else library.line
        else:
            ids = library.ids(self.before, chunk)
        if len(library.spaced) + len(library.plain) < KEPT:
            self[chunk] = ids
        return ids


_LIBRARIES: dict[str, _Library] = {}


def encoder(path: str):
    """A function from a text to its ids (unsigned, little-endian array); None is an empty text."""
    if path not in _LIBRARIES:
        _LIBRARIES[path] = _Library(path)
    library = _LIBRARIES[path]
    kind, special, spaced, plain = f"<u{library.size}", library.special, library.spaced.__getitem__, library.plain.__getitem__

    def encode(text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, kind)
        for name in special:
            if name in text:
                return np.array(library.library.encode(text, add_special_tokens=False).ids, kind)
        if _ODD.search(text) or _ODD_LINE.search(text):
            found = [spaced(c[1:]) if c[0] == " " and c[1:2] not in ("", "\n") else plain(c) for c in _CUT.split(text) if c]
        else:
            first, *rest = text.replace("\n", " \n").split(" ")
            found = [plain(first), *map(spaced, rest)] if first else map(spaced, rest)
        return np.frombuffer(b"".join(found), kind)

    return encode


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
