"""Passages of test items in training documents, edited copies included.

An item's seeds are its rarest word pairs, by the number of documents that hold them. A
document that holds a seed is aligned with the item (Smith-Waterman over words) where
enough of the item's pairs lie together, and the alignment's score, as a share of the
item's own, decides. Enough is what no alignment of that score can do without: M matched
words and E edits score 2 M - E and leave at least M - 1 - E pairs whole, so S - 1 - n of
an item of n words at score S. Of the item's n - 1 pairs all but so many may be gone, so
that many rare ones and one more hold one that is whole: no match is lost by the choice.
Where enough may be none (items of up to five words at 0.6), the seeds are single words.

Items are a stated query set: they are held in blocks of at most about BLOCK items,
each block against all documents. Words are lower-cased runs without ASCII
punctuation.

Edge cases: null and empty texts match nothing; items of fewer than three words
match nothing; rows that repeat a doc_id or item_id may give a pair once each;
empty tables give no pair; other columns are ignored.
"""

from __future__ import annotations

import string
from collections import Counter, defaultdict
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_schema, binary, slices, staged

GRAM, LEAST = 2, 3
BLOCK = 20_000
MIN_SCORE = 0.6
MATCH, MISMATCH, SKIP = 2.0, -1.0, -1.0
TO_SPACE = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def words_of(text: bytes | None) -> list[bytes]:
    return text.decode().lower().encode().translate(TO_SPACE).split() if text else []


class Index:
    """The word pairs of a block of items, and which items have each. ``need``: the
    seeds of an item that lie together in any alignment of its least score;
    ``span``: the words of a text that such an alignment covers at most."""

    def __init__(self, items: list[tuple], min_score: float):
        self.items = [(i, words_of(t)) for i, t in items]
        self.vocab: dict[bytes, int] = {}
        for _, words in self.items:
            for w in words:
                self.vocab.setdefault(w, len(self.vocab) + 1)
        self.base = len(self.vocab) + 1
        if self.base**GRAM >= 2**63:
            raise ValueError("a block has too many different words; take fewer items a block")
        self.words = [np.array([self.vocab[w] for w in words], dtype=np.int64) for _, words in self.items]
        n = np.array([len(w) for w in self.words], dtype=np.int64)
        least = min_score * MATCH * n
        self.need = np.maximum(np.ceil(least - 1 - n - 1e-9), 1).astype(np.int64)
        self.span = np.ceil((MATCH + 1) * n - least + 1e-9).astype(np.int64)
        single = least <= n + 1 + 1e-9
        # Single words as seeds have the codes of pairs with nothing.
        grams = [np.empty(0, dtype=np.int64) if len(w) < LEAST else np.unique(w) if one else np.unique(self.grams(w)) for w, one in zip(self.words, single, strict=True)]
        self.singles = bool(single.any())
        self.codes = np.unique(np.concatenate([np.empty(0, dtype=np.int64), *grams]))
        of = np.concatenate([np.empty(0, dtype=np.int64), *(np.searchsorted(self.codes, g) for g in grams)])
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        order = np.argsort(of, kind="stable")
        self.owner, self.many = owner[order], np.bincount(of, minlength=len(self.codes))
        self.start = np.cumsum(self.many) - self.many
        self.single = single

    def rare(self, often: np.ndarray) -> np.ndarray:
        """For each place of ``owner``, whether the code is a seed of the item; ``often``:
        the documents that hold each code."""
        code, out = np.repeat(np.arange(len(self.codes)), self.many), np.zeros(len(self.owner), dtype=bool)
        for k in np.unique(self.owner).tolist():
            at = self.of_item[k]
            own = self.words[k] if self.single[k] else self.grams(self.words[k])
            times = np.bincount(np.searchsorted(self.codes[code[at]], own), minlength=len(at))
            order = np.lexsort((code[at], often[code[at]]))
            before = np.cumsum(times[order]) - times[order]
            out[at[order[before <= len(own) - self.need[k]]]] = True
        return out

    @cached_property
    def of_item(self) -> list[np.ndarray]:
        """The places of ``owner`` that are each item's, in order of code."""
        order = np.argsort(self.owner, kind="stable")
        return np.split(order, np.searchsorted(self.owner[order], np.arange(1, len(self.items))))

    def grams(self, ids: np.ndarray) -> np.ndarray:
        if len(ids) < GRAM:
            return np.empty(0, dtype=np.int64)
        code = np.zeros(len(ids) - GRAM + 1, dtype=np.int64)
        known = np.ones(len(code), dtype=bool)
        for j in range(GRAM):
            part = ids[j : len(code) + j]
            code = code * self.base + part
            known &= part > 0
        code[~known] = -1
        return code

    def ids(self, words: list[bytes]) -> np.ndarray:
        get = self.vocab.get
        return np.array([get(w, 0) for w in words], dtype=np.int64)

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, seed numbers) of what is found in a text."""
        code = self.grams(ids)
        at = np.flatnonzero(code >= 0)
        code = code[at]
        if self.singles:
            known = np.flatnonzero(ids > 0)
            at, code = np.concatenate([at, known]), np.concatenate([code, ids[known]])
        if not len(at) or not len(self.codes):
            return at[:0], at[:0]
        n = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        found = self.codes[n] == code
        return at[found], n[found]

    def places(self, ids: np.ndarray, rare: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Of each item with a seed (``rare``) and enough codes together in a text, (first,
        last) positions of such."""
        at, n = self.hits(ids)
        many = self.many[n]
        total = int(many.sum())
        nth = np.arange(total) - np.repeat(np.cumsum(many) - many, many)
        which = np.repeat(self.start[n], many) + nth
        item, place = self.owner[which], np.repeat(at, many)
        seeded = np.isin(item, item[rare[which]])
        item, place = item[seeded], place[seeded]
        total = len(item)
        order = np.lexsort((place, item))
        item, place = item[order], place[order]
        last = np.arange(total) + self.need[item] - 1
        near = np.flatnonzero(last < total)
        near = near[item[last[near]] == item[near]]
        near = near[place[last[near]] - place[near] <= self.span[item[near]]]
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, x, y in zip(item[near].tolist(), place[near].tolist(), place[last[near]].tolist(), strict=True):
            out[k].append((x, y))
        return out


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int]:
    """(best local score, end in ``text``) of Smith-Waterman with linear gaps. Gaps
    along the text are a running maximum."""
    step = np.arange(len(text)) * -SKIP
    above = np.zeros(len(text))
    best, end = 0.0, 0
    for w in item:
        diagonal = np.concatenate([[0.0], above[:-1]]) + np.where(text == w, MATCH, MISMATCH)
        row = np.maximum(np.maximum(diagonal, above + SKIP), 0.0)
        row = np.maximum.accumulate(row + step) - step
        k = int(row.argmax())
        if row[k] > best:
            best, end = float(row[k]), k + 1
        above = row
    return best, end


def seed_counts(docs: DataFrame, index) -> np.ndarray:
    """How many of ``docs`` (doc_id, text) hold each code of the broadcast ``index``; as many
    numbers as a block of items has codes."""
    arrow = arrow_schema("code long, n long")

    def count(batches):
        found = np.zeros(len(index.value.codes), dtype=np.int64)
        for part in slices(batches):
            for text in binary(part.column(1)):
                found[np.unique(index.value.hits(index.value.ids(words_of(text)))[1])] += 1
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], schema=arrow)

    out = np.zeros(len(index.value.codes), dtype=np.int64)
    for r in docs.mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        out[r.code] = r.n
    return out


def matches(index: Index, ids: np.ndarray, min_score: float, rare: np.ndarray) -> list[tuple[int, float, int, int]]:
    """(item number, score, first word, end) of the items in a text, best each."""
    out = []
    for k, found in index.places(ids, rare).items():
        item = index.words[k]
        n, best = len(item), None
        counts = Counter(item.tolist())
        spans: list[list[int]] = []
        reach = int(index.span[k])
        for x, y in found:
            low, high = max(x - reach, 0), y + reach + GRAM
            if spans and low <= spans[-1][1]:
                spans[-1][1] = max(high, spans[-1][1])
            else:
                spans.append([low, high])
        for low, high in spans:
            text = ids[low:high]
            there = Counter(text[np.isin(text, item)].tolist())
            if MATCH * sum(min(c, there[w]) for w, c in counts.items()) < min_score * MATCH * n:
                continue  # no alignment can score more than its equal words
            score, end = align(item, text)
            if score >= min_score * MATCH * n and (best is None or score > best[0]):
                _, back = align(item[::-1], text[:end][::-1])
                best = (score, low + end - back, low + end)
        if best:
            out.append((k, best[0] / (MATCH * n), best[1], best[2]))
    return out


def contaminated(docs: DataFrame, items: DataFrame, min_score: float = MIN_SCORE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, score, first_word, end_word of documents that hold an item."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    queries = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    blocks = max(1, -(-queries.count() // block))
    schema = f"doc_id {kind}, item_id {item_kind}, score double, first_word long, end_word long"
    arrow = arrow_schema(schema)
    found = []
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        chosen = spark.sparkContext.broadcast(Index([(r.item_id, r.text.encode()) for r in rows], min_score))

        seeds = spark.sparkContext.broadcast(chosen.value.rare(seed_counts(base, chosen)))

        def search(batches, chosen=chosen, seeds=seeds):
            index = chosen.value
            for part in slices(batches):
                out = [(d, index.items[k][0], *rest) for d, text in zip(part.column(0).to_pylist(), binary(part.column(1)), strict=True) for k, *rest in matches(index, index.ids(words_of(text)), min_score, seeds.value)]
                cols = list(zip(*out, strict=True)) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        found.append(staged(base.mapInArrow(search, schema), "contaminated"))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that hold no item. Documents are told apart by id: a row that
    shares its doc_id with one that holds an item goes too; rows of a null doc_id or a null
    text stay."""
    bad = contaminated(docs, items, id_col=id_col, **options).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, docs[id_col] == bad["__bad"], "left_anti")


def op6_decontaminate(spark, sf_dir):
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
