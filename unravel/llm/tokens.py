"""Exact token ids of whole texts, each distinct piece of text encoded once.

The pre-tokenizers of the two vocabularies split a text at fixed places. A text is
cut at some of these places, lines and single spaces, and the ids of each cut are
kept per Python worker, so that the library encodes a frequent word once. A new cut
is split further where letters meet punctuation; a run of Latin letters goes
straight to the library's BPE model, anything else through its whole encoder.
``tests/llm`` holds the result against the library's ids of uncut texts.
"""

from __future__ import annotations

import re
import sys
from array import array
from functools import lru_cache

#: Cuts that a worker keeps; when more come, it starts anew.
KEPT = 500_000
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
ENDS = ".,;:!?#*$%&|<>()"
PUNCT = re.escape(ENDS)
WORD = re.compile(f"[{LETTERS}]+")
#: Runs of Latin letters that end at white space or plain punctuation, runs of that
#: punctuation up to white space, and else all up to the next space or line end.
PIECES = re.compile(rf"([ \n]*)([{LETTERS}]+)(?=[ \n{PUNCT}]|\Z)|([{PUNCT}]+(?=[ \n]|\Z)|[ \n]*[^ \n]+|[ \n]+\Z)")
#: Texts with other white space, or with white space in a row, are cut by PIECES or
#: not at all.
ODD_SPACE = re.compile(r"[^\S \n]|[\x1c-\x1f\x85]")
DOUBLE_SPACE = ("  ", "\n\n", " \n", "\n ")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies:
    printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(4)
def library(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True  # their strings in a text are ordinary text
    return tok


def packed(ids: list[int]) -> bytes:
    """ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Encoder:
    """ids of texts as little-endian unsigned 32-bit bytes.

    ``lowered``: the vocabulary lower-cases and drops white space (word_bpe_49k);
    otherwise case and white space count (byte_bpe_50k).
    """

    def __init__(self, path: str, lowered: bool = False, kept: int = KEPT):
        self.tok, self.lowered, self.kept = library(path), lowered, kept
        self.model, self.letters = self.tok.model, byte_letters()
        self.spaced: dict[str, bytes] = {}  # cuts after one space
        self.bare: dict[str, bytes] = {}  # cuts at a text's start or, with "\n", after a line end
        self.words: dict[str, bytes] = {}

    def uncut(self, text: str) -> bytes:
        return packed(self.tok.encode(text, add_special_tokens=False).ids)

    def word(self, word: str) -> bytes:
        """ids of a run of Latin letters, with the space before it if it counts."""
        if (found := self.words.get(word)) is None:
            if len(self.words) >= self.kept:
                self.words.clear()
            mapped = word.encode().decode("latin-1").translate(self.letters)
            found = self.words[word] = packed([t.id for t in self.model.tokenize(mapped)])
        return found

    def piecewise(self, text: str) -> bytes:
        out = []
        for m in PIECES.finditer(text):
            space, word, other = m.groups()
            if other is not None:
                if (found := self.words.get(other)) is None:
                    found = self.uncut(other)
                    if len(other) < 100:
                        self.words[other] = found
                out.append(found)
            elif self.lowered:
                out.append(self.word(word.lower()))
            elif space in ("", " "):
                out.append(self.word(space + word))
            else:
                out.append(self.uncut(m.group()))
        return b"".join(out)

    def cut_ids(self, before: str, cut: str) -> bytes:
        """``piecewise`` of before + cut, shorter for letters and then punctuation."""
        core = cut.rstrip(ENDS)
        if not WORD.fullmatch(core):
            return self.piecewise(before + cut)
        out = self.word(core.lower() if self.lowered else before + core)
        if core == cut:
            return out
        end = cut[len(core) :]
        return out + (self.words.get(end) or self.piecewise(end))

    def fresh(self, cuts: list[str]) -> None:
        """Keep those of ``cuts``, after a space that counts, that aren't yet. ASCII letters
        stand for themselves in the vocabulary; the rest goes through ``cut_ids``."""
        kept, words, tokenize = self.spaced, self.words, self.model.tokenize
        if len(words) >= self.kept:
            words.clear()
        space = self.letters[32]
        for x in cuts:
            if x in kept:
                continue
            core = x if x.isalpha() else x.rstrip(ENDS)
            if not (core.isascii() and core.isalpha()):
                kept[x] = self.cut_ids(" ", x)
                continue
            key = " " + core
            if (ids := words.get(key)) is None:
                ids = words[key] = packed([t.id for t in tokenize(space + core)])
            if core is not x:
                end = x[len(core) :]
                ids += words.get(end) or self.piecewise(end)
            kept[x] = ids

    def known(self, kept: dict[str, bytes], before: str, cuts: list[str]) -> bytes:
        try:
            return b"".join(map(kept.__getitem__, cuts))
        except KeyError:
            if len(kept) > self.kept:
                kept.clear()
            if before == " " and not self.lowered:
                self.fresh(cuts)
            else:
                for x in cuts:
                    if x not in kept:
                        kept[x] = self.cut_ids(before, x)
            return b"".join(map(kept.__getitem__, cuts))

    def encode(self, text: str) -> bytes:
        if not text.replace("\n", " ").isprintable() and ODD_SPACE.search(text):
            return self.uncut(text)
        if not text or text[0] in " \n" or text[-1] in " \n" or any(x in text for x in DOUBLE_SPACE):
            return self.piecewise(text)
        lines = [x.split(" ") for x in text.split("\n")]
        firsts = [lines[0][0], *("\n" + x[0] for x in lines[1:])]
        out = []
        for first, line in zip(firsts, lines, strict=True):
            del line[0]
            out.append(self.known(self.bare, "", (first,)))
            out.append(self.known(self.spaced, " ", line))
        return b"".join(out)


@lru_cache(4)
def encoder(path: str, lowered: bool = False) -> Encoder:
    return Encoder(path, lowered)
