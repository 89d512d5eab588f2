"""Exact tokenization with the tokenizers library, with a cache of words.

Both vocabularies are BPE over pieces that never cross the boundaries used here, so a
text's ids are those of its words joined: words are looked up, and only unseen ones go
through the library. Texts that don't cut cleanly go through the library as a whole.
``Encoder.raw`` takes one text; ``Encoder.many`` takes them in bulk, cuts them in Arrow and
looks a word up once for all its places.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cached words of a generation, of which a Python worker holds two (about 200 bytes a word).
WORDS = 120_000
_PLAIN = re.compile(r"(\0?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:#$%&*]*)")
_MARKS = re.compile(r"\0([.,!?;:#$%&*]+)")
#: Arrow's form of a plain word with marks after it.
_MARKED = r"^(?P<core>\x00?[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[.,!?;:#$%&*]+)$"
_ODD = re.compile(r"[\s\x00\x1c-\x1f]")
#: Characters that ``many`` takes at a time, more or less; words looked up, and words put together, at a time.
BULK, SOME = 8 << 20, 1 << 14


def _byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = [""] * 256, 0
    for b in range(256):
        out[b] = chr(b) if b in keep else chr(256 + n)
        n += b not in keep
    return out


_ALPHABET = dict(enumerate(_byte_alphabet()))
_SPACE = _ALPHABET[32]


def _stand_in(s: str) -> str:
    return s.encode("utf-8").decode("latin-1").translate(_ALPHABET)


def _spaced(text: str) -> str:
    """A text for byte-level vocabularies, to be cut at single spaces."""
    return ("\0" + text).replace("\n", " \n \0")


class _Odd(Exception):
    """A word that holds white space: the text has to be encoded as a whole."""


class Encoder:
    """ids of whole texts for one vocabulary file; ``ids(text)`` is an array of ``dtype``.

    Strings of added tokens become their ids, as the library has it; a text that holds one goes
    through the library as a whole.
    """

    def __init__(self, path: str, words: int = WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.by_word = self.lib.normalizer is not None  # white space is dropped, words end in a mark
        wide = self.lib.get_vocab_size(True) > 1 << 16
        self.dtype, self.kind = np.dtype("<u4" if wide else "<u2"), "I" if wide else "H"
        self.added = [x.content.lower() for x in self.lib.get_added_tokens_decoder().values()]
        self.starts = tuple({x[:2] for x in self.added})
        self.model, self.limit = self.lib.model, words
        self.words = _Words(self)

    def library(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def piece(self, p: str) -> bytes:
        """ids of one pre-token, given in the vocabulary's stand-ins of bytes."""
        return array(self.kind, [t.id for t in self.model.tokenize(p)]).tobytes()

    def word(self, w: str) -> bytes:
        """``w``: a word that stood after a space; a leading NUL marks one that didn't."""
        if m := _PLAIN.fullmatch(w):
            glued, core, marks = m.groups()
            if marks:  # letters and the marks after them are pieces of their own
                return self.words[glued + core] + self.words["\0" + marks]
            if self.by_word:
                core = core.lower()
            own = core if core.isascii() else _stand_in(core)
            return self.piece(own if glued or self.by_word else _SPACE + own)
        if m := _MARKS.fullmatch(w):
            return self.piece(m[1])
        if self.by_word:
            return self.library(w)
        if w == "\n":
            return self.library(w)
        glued = w[:1] == "\0"
        body = w[1:] if glued else w
        if not body or _ODD.search(body):
            raise _Odd
        return self.library(body if glued else " " + body)

    def whole(self, text: str) -> bool:
        """Whether a text holds what words don't allow for."""
        if any(x in text for x in self.starts) and any(x in text.lower() for x in self.added):
            return True
        return "\0" in text or self.by_word and ("\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text)

    def raw(self, text: str | None) -> bytes:
        """ids as little-endian bytes of ``dtype``."""
        if not text:
            return b""
        if len(self.words) > self.limit:
            self.words.turn()
        if self.whole(text):
            return self.library(text)
        get = self.words.__getitem__
        if self.by_word:
            return b"".join(map(get, text.split()))
        try:
            return b"".join(map(get, _spaced(text).split(" ")))
        except _Odd:
            return self.library(text)

    def many(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """``raw`` of each text, in order."""
        held, n = [], 0
        for t in texts:
            size = len(t or "") + 1
            if held and n + size > BULK:
                yield from self._bulk(held)
                held, n = [], 0
            held.append(t)
            n += size
        yield from self._bulk(held)

    def _bulk(self, texts: list[str | None]) -> list[bytes]:
        out, at, parts = [b""] * len(texts), [], []
        for i, t in enumerate(texts):
            if t and self.whole(t):
                out[i] = self.library(t)
            elif t and (part := " ".join(t.split()) if self.by_word else _spaced(t)):
                at.append(i)
                parts.append(part)
        if not at:
            return out
        counts = np.array([p.count(" ") + 1 for p in parts])
        words = pc.split_pattern(pa.array([" ".join(parts)], pa.large_string()), " ").values.dictionary_encode()
        del parts
        place, firsts = words.indices.to_numpy(), np.cumsum(counts) - counts
        each = self._distinct(words.dictionary)
        odd = np.array([x is None for x in each])
        each = [x or b"" for x in each]
        lengths = np.fromiter(map(len, each), np.int64, len(each)) // self.dtype.itemsize
        starts, ids, joined = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(each), self.dtype), []
        for i in range(0, len(place), SOME):  # each word's ids to all its places
            own = place[i : i + SOME]
            n = lengths[own]
            joined.append(ids[np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes())
        raw, ends = b"".join(joined), np.cumsum(np.add.reduceat(lengths[place], firsts)) * self.dtype.itemsize
        whole = np.logical_or.reduceat(odd[place], firsts)
        for i, a, b, w in zip(at, [0, *ends.tolist()], ends.tolist(), whole.tolist(), strict=False):
            out[i] = self.library(texts[i]) if w else raw[a:b]
        return out

    def _distinct(self, words: pa.Array) -> list[bytes | None]:
        """ids of distinct words; None: the word holds white space."""
        cut = pc.extract_regex(words, _MARKED)  # words that only differ in marks share a look-up
        cores = pc.coalesce(pc.struct_field(cut, [0]), words).dictionary_encode()
        marks = pc.struct_field(cut, [1]).dictionary_encode()
        todo, own = cores.dictionary.to_numpy(zero_copy_only=False).tolist(), []
        for i in range(0, len(todo), SOME):
            if len(self.words) > self.limit:
                self.words.turn()
            some = todo[i : i + SOME]
            try:
                own += list(map(self.words.__getitem__, some))
            except _Odd:
                own += map(self._even, some)
        ends = [self.words["\0" + m] for m in marks.dictionary.to_pylist()]
        places = (x.indices.fill_null(-1).to_numpy().tolist() for x in (cores, marks))
        return [own[c] if m < 0 else own[c] + ends[m] for c, m in zip(*places, strict=True)]

    def _even(self, w: str) -> bytes | None:
        try:
            return self.words[w]
        except _Odd:
            return None

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.raw(text), self.dtype)


class _Words(dict):
    """Words of two generations: when the young one is full it becomes the old one, and words met
    again move to the young one. So words that come once don't push common ones out."""

    def __init__(self, owner: Encoder):
        super().__init__()
        self.owner, self.old = owner, {}

    def turn(self) -> None:
        self.old = dict(self)
        self.clear()

    def __missing__(self, w: str) -> bytes:
        got = self.old.get(w)
        if got is None:
            got = self.owner.word(w)
        if len(w) < 64:  # long junk isn't kept
            self[w] = got
        return got


@cache
def encoder(path: str, words: int = WORDS) -> Encoder:
    """One encoder for each Python worker and vocabulary, kept from task to task."""
    return Encoder(path, words)
