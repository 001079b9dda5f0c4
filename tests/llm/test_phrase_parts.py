"""Pairs dealt to parts as packed rows; wide rows in small row groups."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from test_phrases import DOCS, expected, some_rows
from unravel.llm import phrases
from unravel.llm.common import staged


@pytest.mark.parametrize("values", [[], [0], [-1, 5, 2**62, -(2**40), 7]])
def test_pack(values):
    got = phrases.unpack(phrases.pack(np.array(values, dtype=np.int64)), len(values))
    assert got.tolist() == values


def test_many_parts(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", 3000)
    monkeypatch.setattr(phrases, "PART", 400)
    rows = some_rows()
    docs = spark.createDataFrame([(i, t, lang, "clash", 1) for i, (lang, t) in enumerate(rows)], DOCS).repartition(4)
    assert sorted(tuple(r) for r in phrases.collocations(docs, 20, 4, 2000, 80).collect()) == expected(rows, 20, 4, 2000, 80)


def test_row_groups_are_small(spark, monkeypatch):
    """A reader takes up to 4096 rows of a row group at once, and each row is a block."""
    monkeypatch.setattr(phrases, "BLOCK", 20_000)
    words = np.random.default_rng(1).integers(0, 1 << 40, 400_000)
    docs = spark.createDataFrame([(1, " ".join(f"{w:x}" for w in words[k::40].tolist()), "en", "", 1) for k in range(40)], DOCS).coalesce(1)
    blocks = staged(phrases.word_blocks(docs), "blocks", **phrases.NARROW | {"parquet.block.size": str(1 << 18)})
    assert blocks.staged_rows == 20
    for file in blocks.inputFiles():
        meta = pq.ParquetFile(file.removeprefix("file://")).metadata
        assert max(meta.row_group(k).num_rows for k in range(meta.num_row_groups)) <= 3
