"""Whole-text encoding by a tokenizer file, with a bounded cache of chunks.

The ``tokenizers`` library does all encoding; the cache only saves it from
encoding the same chunk again. A text is cut where no token can cross, so
that the chunks' ids in a row are the text's ids.
"""

from __future__ import annotations

import os
import re
from array import array

from .held import held

#: A place between tokens whatever the pre-tokenizer does with runs of white space: before one space between two other characters.
_EDGE = re.compile(r"(?<=\S)(?= \S)")
#: White space other than space and line feed.
_ODD = re.compile(r"[^\S \n]")


def spaced_chunks(text: str) -> list[str]:
    """Chunks that keep their leading space, for pre-tokenizers that join a space to the next word; a line feed alone between others is a chunk."""
    if "  " in text or "\n \n" in text or "\0" in text or _ODD.search(text):
        return _EDGE.split(text)
    if "\n\n" not in text and " \n" not in text and "\n " not in text:
        text = text.replace("\n", "\0\n\0")
    return text.replace(" ", "\0 ").split("\0")


def bare_chunks(text: str) -> list[str]:
    """Chunks without spaces and line feeds, for tokenizers that drop white space."""
    return text.replace("\n", " ").split(" ")


#: Words of letters whose class, case and bytes leave no doubt, then marks that are one run: such chunks need no pre-tokenizer.
_WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
_MARKS = ".,;:!?|"


#: Longer keys are not kept, so that a cache's entries bound its bytes.
SHORT = 64


class _Parts(dict):
    """Ids of keys, made by ``make`` when missed; of two generations, the older goes when the younger is full."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key: str) -> bytes:
        if len(key) > SHORT:
            return self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        found = self.old.get(key)
        self[key] = found = self.make(key) if found is None else found
        return found


class ChunkEncoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit integers.

    A plain chunk's word and marks go to the tokenizer's own model, by the byte letters that its
    pre-tokenizer has for them; any other chunk goes through the whole tokenizer.
    """

    def __init__(self, path: str, drops_spaces: bool, limit: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.drops_spaces = Tokenizer.from_file(path), drops_spaces
        self.model, before = self.tokenizer.model, self.tokenizer.pre_tokenizer
        plain = [chr(c) for c in range(33, 256) if _WORD.fullmatch(chr(c))] + list(_MARKS)
        self.letters = str.maketrans({c: before.pre_tokenize_str(c)[0][0] for c in plain} | ({} if drops_spaces else {" ": before.pre_tokenize_str(" ")[0][0]}))
        self.chunks = bare_chunks if drops_spaces else spaced_chunks
        self.words, self.known = _Parts(self.word, limit), _Parts(self.chunk, limit)

    def word(self, text: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(text.translate(self.letters))]).tobytes() if text else b""

    def chunk(self, text: str) -> bytes:
        word = text.rstrip(_MARKS)
        if (word.isascii() and word.removeprefix(" ").isalpha()) or _WORD.fullmatch(word):
            marks = text[len(word) :]
            return self.words[word.lower() if self.drops_spaces else word] + self.words[marks]
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        find = self.known.__getitem__
        return [b"".join(map(find, self.chunks(x or ""))) for x in texts]


def encoder(path: str, drops_spaces: bool) -> ChunkEncoder:
    """One for each Python worker, kept between its tasks."""
    return held(("encoder", path, drops_spaces), lambda: ChunkEncoder(path, drops_spaces))


def slices(batch, text: int, rows: int = 64, chars: int = 1_000_000):
    """(first row, texts) in slices of bounded rows and, but for one longer text, characters."""
    column, start, held, n = batch.column(text), 0, [], 0
    for i, x in enumerate(column):
        x = x.as_py()
        if held and (len(held) == rows or n + len(x or "") > chars):
            yield start, held
            start, held, n = i, [], 0
        held.append(x)
        n += len(x or "")
    if held:
        yield start, held
