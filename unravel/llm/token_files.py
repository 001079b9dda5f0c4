"""Token ids in ORC files: integer runs, row indexes and Bloom filters on ids.

Documents are range-partitioned by id, so that every file holds a run of ids in
ascending order and its stripe statistics prune by id. Ids are an ``array<int>``
column (ORC run-length encodes integers); stripes are read in parallel.

Edge cases: a null text is empty and yields the end id alone; rows that repeat a
doc_id stay rows of their own, in one file; an empty table writes and reads as
empty; other columns of the input are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import arrow_pass, binary, shared_dir
from .tokens import encoder, packed


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", rows_in_index: int = 1000, stripe_bytes: int = 16 << 20, compress: str = "lz4") -> None:
    """Encode every whole text, append ``end_id``, write ORC in ascending id order.

    Columns: doc_id, part (the file's number), start (ids before it in its file),
    n_tokens, ids. Texts, smaller than ids, are what is shuffled.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = base.repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id").sortWithinPartitions("doc_id")
    end = packed([end_id])

    def encode(batches):
        from pyspark import TaskContext

        part_no, start, encode = TaskContext.get().partitionId(), 0, encoder(tokenizer).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids = [encode(x.decode()) + end if x else end for x in binary(part.column(1))]
                counts = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                ends = np.cumsum(counts)
                flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                cols = [part.column(0), pa.array(np.full(len(ids), part_no, dtype=np.int32)), pa.array(start + ends - counts), pa.array(counts), pa.ListArray.from_arrays(offsets, flat)]
                start += int(ends[-1])
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "part", "start", "n_tokens", "ids"])

    rows = base.mapInArrow(encode, f"doc_id {kind}, part int, start long, n_tokens long, ids array<int>")
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": str(rows_in_index), "orc.stripe.size": str(stripe_bytes), "orc.compress": compress}
    rows.write.mode("overwrite").options(**options).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids.

    The files' totals, one row a file, give each file's start; no row of a
    document is shuffled.
    """
    rows = spark.read.orc(path)
    totals = rows.groupBy("part").agg(F.min("doc_id").alias("first"), F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("first", "part").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(F.broadcast(totals), "part").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids")


def id_checksums(rows: DataFrame) -> DataFrame:
    """``ids`` replaced by ids_crc32 of their little-endian 32-bit bytes."""
    keep = [c for c in rows.columns if c != "ids"]

    def sums(part: pa.RecordBatch) -> dict[str, list]:
        out = [zlib.crc32(x.values.to_numpy().astype("<u4").tobytes()) for x in part.column(len(keep))]
        return {c: part.column(i) for i, c in enumerate(keep)} | {"ids_crc32": out}

    fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return arrow_pass(rows.select(*keep, "ids"), sums, f"{fields}, ids_crc32 long")


def op9_token_orc(spark, sf_dir):
    import public_tokenizers

    path = f"{shared_dir(spark)}/unravel-{spark.sparkContext.applicationId}/token-orc-{uuid.uuid4().hex}"
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"), 0)
    return id_checksums(read_token_files(spark, path))
