"""Order-preserving packing of token ids into windows.

Documents in id order are one stream of ids. Windows of at most ``size`` ids are
cut from it by dynamic programming: the best cost up to a cut is the least over the
cuts within ``size`` ids before it, plus the padding between and the cut's penalty
(none at a document's end, little at a sentence's, more inside a sentence). The
least over the moving range comes from a monotone queue, so each cut enters and
leaves once. Ranges of ids are packed side by side, one task each; what is left at a
range's end is split into powers of two, which need no padding.

Edge cases: a null text is empty and gives the end id alone; an empty table gives no
piece; rows that repeat a doc_id are packed one after the other; a document longer
than a window is cut into several; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_schema, binary
from .tokens import encoder, library, packed

SIZE = 4096
#: Cost, in ids of padding, of a cut inside a document: after a sentence, elsewhere.
SENTENCE, INSIDE = 4.0, 48.0
#: Without a sentence's end for so many ids, cuts are offered every GAP ids.
GAP = 128
#: Windows that are planned together; the last one is carried on.
PLANNED = 64
PIECE = "doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def window_cuts(points: np.ndarray, penalties: np.ndarray, size: int = SIZE) -> list[int]:
    """Indices into ``points`` (ascending positions, the first 0) of the cheapest
    cuts: each window is at most ``size`` long and costs its padding plus the penalty
    of its end. The last point is always cut, at no cost: its window is carried on or
    split into powers of two. Neighbouring points must lie within ``size``."""
    at = points.tolist()
    pen = penalties.tolist()
    best, came = [0.0] * len(at), [0] * len(at)
    queue: deque[int] = deque([0])  # candidates, their best[i] + at[i] rising
    key = [0.0] * len(at)
    for j in range(1, len(at)):
        low = at[j] - size
        while at[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        came[j] = i
        if j == len(at) - 1:
            came[j] = min(queue, key=best.__getitem__)
            break
        best[j] = key[i] + size - at[j] + pen[j]
        key[j] = k = best[j] + at[j]
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(j)
        j = came[j]
    return cuts[::-1]


def cut_points(n: int, doc_ends: np.ndarray, sentence_ends: np.ndarray, gap: int = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Positions 0..n where cuts are offered, and their penalties."""
    soft = np.unique(np.concatenate([[0], doc_ends, sentence_ends, [n]]))
    soft = soft[soft <= n]
    wide = np.flatnonzero(np.diff(soft) > gap)
    more = [np.arange(soft[i] + gap, soft[i + 1], gap) for i in wide]
    points = np.unique(np.concatenate([soft, *more])).astype(np.int64)
    pen = np.full(len(points), INSIDE)
    pen[np.isin(points, sentence_ends)] = SENTENCE
    pen[np.isin(points, doc_ends)] = 0.0
    return points, pen


def powers(n: int) -> list[int]:
    """n as descending powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


@lru_cache(2)
def sentence_marks(path: str) -> np.ndarray:
    """ids of entries that end in a full stop, exclamation or question mark."""
    vocab = library(path).get_vocab(with_added_tokens=False)
    return np.array(sorted(i for x, i in vocab.items() if x.removesuffix("</w>")[-1:] in (".", "!", "?")), dtype=np.uint32)


class Packer:
    """Takes documents in order, gives pieces as windows fill."""

    def __init__(self, first_sequence: int, marks: np.ndarray, size: int = SIZE, planned: int = PLANNED):
        self.sequence, self.marks, self.size, self.enough = first_sequence, marks, size, planned * size
        self.docs: list[tuple] = []  # doc_id, ids, start of what is left
        self.held = 0

    def add(self, doc_id, ids: np.ndarray):
        self.docs.append((doc_id, ids, 0))
        self.held += len(ids)
        while self.held >= self.enough:
            yield from self.plan(min(self.held, 2 * self.enough), False)

    def end(self):
        while self.held > 2 * self.enough:
            yield from self.plan(2 * self.enough, False)
        if self.held:
            yield from self.plan(self.held, True)

    def plan(self, n: int, last: bool):
        """Pack the next ``n`` ids; unless ``last``, but for the last window."""
        parts, got = [], 0
        for _, ids, start in self.docs:
            part = ids[start : start + n - got]
            parts.append(part)
            got += len(part)
            if got == n:
                break
        stream = np.concatenate(parts)
        doc_ends = np.cumsum([len(p) for p in parts])
        points, pen = cut_points(n, doc_ends, np.flatnonzero(np.isin(stream, self.marks)) + 1)
        cuts = points[window_cuts(points, pen, self.size)]
        lengths = np.diff(cuts, prepend=0).tolist()
        tail = lengths.pop()
        if last:
            lengths += [tail] if tail == self.size else powers(tail)
        for length in lengths:
            yield from self.window(length)

    def window(self, length: int):
        offset, used = 0, 0
        while offset < length:
            doc_id, ids, start = self.docs[used]
            part = ids[start : start + length - offset]
            yield doc_id, start, len(part), zlib.crc32(part.astype("<u4").tobytes()), len(ids), self.sequence, offset
            offset += len(part)
            if start + len(part) == len(ids):
                used += 1
            else:
                self.docs[used] = (doc_id, ids, start + len(part))
        del self.docs[:used]
        self.held -= length
        self.sequence += 1


def pack(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. Sequence ids rise with doc_id, with gaps between tasks."""
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = base.repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id").sortWithinPartitions("doc_id")
    schema = PIECE.format(kind=kind)
    arrow = arrow_schema(schema)
    end = packed([end_id])

    def run(batches):
        from pyspark import TaskContext

        encode = encoder(tokenizer, True).encode
        packer = Packer(TaskContext.get().partitionId() << 40, sentence_marks(tokenizer), size)
        rows: list[tuple] = []

        def flush():
            cols = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for doc_id, text in zip(part.column(0).to_pylist(), binary(part.column(1)), strict=True):
                    ids = np.frombuffer(encode(text.decode()) + end if text else end, dtype="<u4")
                    rows.extend(packer.add(doc_id, ids))
                if len(rows) > 5000:
                    yield flush()
        rows.extend(packer.end())
        if rows:
            yield flush()

    return base.mapInArrow(run, schema)


def op3_packing(spark, sf_dir):
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), 2)
