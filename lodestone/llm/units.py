"""Whole texts cut into pieces that byte-level BPE encodes independently, and a per-worker memory of their codes.

The pre-tokenizer's pattern never lets a match run from a non-blank into a blank, nor leave a lone space behind before
a non-blank, so a text may be cut before every space unless that space stands inside a longer run of blanks. Cutting
with ``str.split`` is many times faster than matching the pattern, and equal pieces are encoded once per worker.
Texts with inner runs of blanks are cut by the pattern itself.
"""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Callable
from itertools import islice

import pyarrow as pa
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
RUN = re.compile(r"\s (?:\s|\Z)")
#: Entries of one worker's memory. When it is full, those that came first stay (frequent pieces come early) and the other
#: half goes, so memory stays bounded and results do not change.
ENTRIES = 600_000
#: Longer pieces are rare and not remembered.
LONGEST = 40


class Memory(dict):
    """piece -> code; a missing piece is encoded match by match, each match remembered in turn."""

    def __init__(self, lead: str, encode: Callable, join: Callable, find: Callable, words: dict):
        super().__init__()
        self.lead, self.encode, self.join, self.find, self.words = lead, encode, join, find, words

    def __missing__(self, piece: str):
        out, lead = [], len(self.lead)
        for m in self.find(self.lead + piece):
            held, key = (self.words, m) if out else (self, m[lead:])  # the first match is a piece of its own elsewhere
            got = self.get(key) if held is self else held.get(key)
            if got is None:
                got = self.encode(m)
                if len(m) <= LONGEST:
                    held[key] = got
            out.append(got)
        code = out[0] if len(out) == 1 else self.join(out)
        if len(piece) <= LONGEST:
            self[piece] = code
        return code


class Pieces:
    """Codes of a text's pieces in order. encode maps one match of the pattern to its code, join puts codes together."""

    def __init__(self, pattern: str, encode: Callable, join: Callable, entries: int = ENTRIES):
        self.find, self.words, self.entries = regex.compile(pattern).findall, {}, entries
        self.first, self.rest = (Memory(x, encode, join, self.find, self.words) for x in ("", " "))

    def trim(self) -> None:
        for x in (self.first, self.rest, self.words):
            if len(x) > self.entries:
                early = list(islice(x.items(), self.entries // 2))
                x.clear()
                x.update(early)

    def __call__(self, text: str) -> list:
        self.trim()
        if RUN.search(text):
            return list(map(self.first.__getitem__, self.find(text)))
        parts = text.split(" ")
        out = list(map(self.rest.__getitem__, parts))
        out[0] = self.first[parts[0]]
        return out


_held: dict = {}


def held(key, make: Callable[[], object]):
    """The object of a key, kept from task to task. A worker process keeps that of the last key only, as stages of many
    kinds follow each other in one process."""
    if key not in _held:
        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _held[key] = make()
    return _held[key]


def byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: printable ones themselves, the others from 256 up."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}


def library_encoder(path: str) -> Callable[[str], list[int]]:
    """Ids of one pattern match by the tokenizers library's model, as its encode gives them."""
    from tokenizers import Tokenizer

    model, letters = Tokenizer.from_file(path).model, byte_letters()
    return lambda m: [t.id for t in model.tokenize(m.encode().decode("latin-1").translate(letters))]


class Cut:
    """Codes of a text in which added tokens are recognised before the pattern cuts what stands between them."""

    def __init__(self, pieces: Pieces, added: dict[str, bytes]):
        self.pieces, self.added = pieces, added
        # Longer contents first: of two that start at one place the longer one counts.
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split

    def __call__(self, text: str) -> list[bytes]:
        if not any(x in text for x in self.added):
            return self.pieces(text)
        out = []
        for i, part in enumerate(self.split(text)):
            if i % 2:
                out.append(self.added[part])
            elif part:
                out += self.pieces(part)
        return out


def library_ids(path: str, pattern: str) -> Callable[[str], list[bytes]]:
    """Texts to little-endian unsigned 32-bit ids by a tokenizers file, one bytes object a piece or added token."""
    import struct

    from tokenizers import Tokenizer

    def make() -> Callable[[str], list[bytes]]:
        encode = library_encoder(path)
        pieces = Pieces(pattern, lambda m: struct.pack(f"<{len(ids := encode(m))}I", *ids), b"".join)
        known = Tokenizer.from_file(path)
        added = known.get_added_tokens_decoder()
        if any(x.single_word or x.lstrip or x.rstrip or (x.normalized and known.normalizer) for x in added.values()):
            raise ValueError(f"{path} has added tokens that take in or depend on what stands beside them")
        return Cut(pieces, {x.content: struct.pack("<I", i) for i, x in added.items() if x.content}) if added else pieces

    return held(("ids", path), make)
