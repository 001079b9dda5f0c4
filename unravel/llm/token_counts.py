"""Greedy longest-match token counts without building pieces.

A trie over the vocabulary gets failure links, and each link knows how many pieces
it pops (Song et al., "Fast WordPiece Tokenization", 2021). A word is counted in one
pass over its bytes, whatever its length. Words end in a mark, so a vocabulary entry
either ends a word or continues it.

Edge cases: a null or empty text has no words and no tokens; a word that the
vocabulary can't spell counts as one token; an empty vocabulary makes every word one;
repeated rows are counted one by one; other columns are ignored.
"""

from __future__ import annotations

import json
from collections import deque
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_pass, binary
from .tokens import byte_letters

#: Stands for the end of a word after its bytes.
END = 256


class Automaton:
    """``pieces``: vocabulary entries as tuples of symbols, bytes and maybe END."""

    def __init__(self, pieces):
        self.go: list[dict[int, int]] = [{}]
        final = [False]
        for piece in pieces:
            node = 0
            for s in piece:
                nxt = self.go[node].get(s)
                if nxt is None:
                    nxt = self.go[node][s] = len(self.go)
                    self.go.append({})
                    final.append(False)
                node = nxt
            final[node] = node != 0
        n = len(self.go)
        self.fail, self.popped = [-1] * n, [0] * n
        todo = deque([0])
        while todo:
            u = todo.popleft()
            for s, v in self.go[u].items():
                todo.append(v)
                if final[v]:
                    self.fail[v], self.popped[v] = 0, 1
                    continue
                z, pops = self.fail[u], self.popped[u]
                while z >= 0 and s not in self.go[z]:
                    pops += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.popped[v] = self.go[z][s], pops

    def count(self, word: bytes) -> int:
        """Pieces of ``word``, or 1 if it can't be spelled."""
        go, fail, popped, node, n = self.go, self.fail, self.popped, 0, 0
        for s in (*word, END):
            while (nxt := go[node].get(s)) is None:
                n += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = nxt
        while node > 0:
            n += popped[node]
            node = fail[node]
        return n if node == 0 else 1


def vocabulary(path: str, end: str = "</w>") -> list[tuple[int, ...]]:
    """The entries of a tokenizer file's vocabulary as bytes, END for its mark of a
    word's end; special tokens are left out."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    special = {x["content"] for x in file.get("added_tokens", [])}
    to_byte = {c: b for b, c in byte_letters().items()}
    out = []
    for entry in file["model"]["vocab"]:
        if entry not in special:
            letters = entry.removesuffix(end)
            out.append((*(to_byte[c] for c in letters), *([END] if entry.endswith(end) else [])))
    return out


class Counter:
    """Counts by word, kept for frequent words."""

    def __init__(self, automaton: Automaton, kept: int = 500_000):
        self.automaton, self.kept, self.known = automaton, kept, {}

    def count(self, words: list[bytes]) -> int:
        try:
            return sum(map(self.known.__getitem__, words))
        except KeyError:
            if len(self.known) > self.kept:
                self.known.clear()
            for w in words:
                if w not in self.known:
                    self.known[w] = self.automaton.count(w)
            return sum(map(self.known.__getitem__, words))


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(Automaton(vocabulary(path)))


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens of every whole text; words end at ASCII white space
    and A-Z count as a-z."""
    kind = docs.schema[id_col].dataType.simpleString()

    def counts(part: pa.RecordBatch) -> dict[str, list]:
        c = counter(vocabulary_path)
        words = [(x or b"").lower().split() for x in binary(part.column(1))]
        return {"doc_id": part.column(0), "n_words": [len(w) for w in words], "n_tokens": [c.count(w) for w in words]}

    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_pass(base, counts, f"doc_id {kind}, n_words long, n_tokens long")


def op5_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
