"""Exact copies by an extendible-hash index on shared files.

Texts are equal when identical after lower-casing A-Z. A text's key is the first
KEY_BITS bits of its SHA-256. The directory has a slot for each prefix of the global
depth and names the slot's bucket; a bucket of more than ``capacity`` keys splits on its
next bit, and the directory doubles while such a bucket is as deep as it is. Buckets hold
ranges of keys. Keys of a single row need no comparison. The texts of the others go to
the owner of their bucket, which chains the texts of a key that differ and compares
bytes along the chain. The finished entries are a table in the shared folder, sorted by
bucket, so that look-ups read few of its files.

Equal texts become one row in each task before anything is shuffled; what is left of a
key with many rows is dealt over about the cube root of their number of owners, whose
results meet in one more step. So a group of copies takes no task more than a few
hundred texts for millions of rows. An owner holds the texts of one key.

Edge cases: a null text counts as empty; of rows that repeat the largest doc_id of their
group all are kept, and a null doc_id is less than any other; an empty table gives an
empty index and result; other columns are ignored by ``exact_groups`` and kept by
``drop_exact_copies``, which leaves out rows by doc_id and text.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import arrow_pass, arrow_schema, binary, gathered, near, release, slices, staged

KEY_BITS = 60
#: Keys of a bucket; bits that are counted beyond the expected depth at a time.
CAPACITY, STEP = 4096, 4
#: Bytes of texts that a task holds to fold equal ones.
HELD = 8 << 20
DIGEST = ["s1", "s2", "s3", "s4"]


def normal(text: bytes | None) -> bytes:
    return (text or b"").lower()  # bytes: A-Z alone


def digests(texts: list[bytes]) -> list[np.ndarray]:
    """The SHA-256 of each text as four columns of longs."""
    whole = np.frombuffer(b"".join(hashlib.sha256(t).digest() for t in texts), dtype=">i8").astype(np.int64)
    return list(whole.reshape(-1, 4).T)


def key_of(first: Column, key_bits: int) -> Column:
    return F.shiftrightunsigned(first, 64 - key_bits)


def hashed(docs: DataFrame, key_bits: int) -> DataFrame:
    """doc_id, key, s1..s4 (the digest) of the rows of ``docs`` (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(part: pa.RecordBatch) -> dict:
        return {"doc_id": part.column(0)} | dict(zip(DIGEST, digests([normal(t) for t in binary(part.column(1))]), strict=True))

    return arrow_pass(docs, rows, f"doc_id {kind}, " + ", ".join(f"{s} long" for s in DIGEST)).withColumn("key", key_of(F.col("s1"), key_bits))


def directory(keys: DataFrame, distinct: int, capacity: int, key_bits: int) -> DataFrame:
    """bucket (its first key), depth, and n (its keys) of ``distinct`` ``keys`` (key):
    children of overfull nodes of the tree of prefixes that aren't overfull themselves.

    A round counts some levels at once; the next takes up what is overfull at its last."""
    depth, parts, rest = 0, [], keys.select("key")
    step = max(math.ceil(math.log2(max(distinct / capacity, 1))), 0) + STEP
    while depth < key_bits:
        last = min(depth + step, key_bits)
        fine = rest.groupBy(F.shiftright("key", key_bits - last).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
        level = F.explode(F.sequence(F.lit(depth), F.lit(last))).alias("depth")
        nodes = fine.select("prefix", "n", level).groupBy("depth", F.expr(f"shiftright(prefix, {last} - depth)").alias("prefix")).agg(F.sum("n").alias("n"))
        nodes = staged(nodes, "nodes")
        over = nodes.where((F.col("n") > capacity) & (F.col("depth") < key_bits))
        children = over.where(F.col("depth") < last).select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
        below = children.join(nodes, ["depth", "prefix"], "left").na.fill(0, ["n"])
        if not depth:
            root = nodes.where("depth = 0").select("depth", "prefix", "n")
            below = root.union(below.select("depth", "prefix", "n"))
        parts.append(below.where((F.col("n") <= capacity) | (F.col("depth") == key_bits)).select(F.expr(f"shiftleft(prefix, {key_bits} - depth)").alias("bucket"), "depth", "n"))
        deep = staged(over.where(F.col("depth") == last).select("prefix"), "overfull")
        if not deep.staged_rows:
            break
        rest = keys.select("key").join(near(deep), F.shiftright("key", key_bits - last) == deep["prefix"], "left_semi")
        depth, step = last, STEP
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return staged(out, "buckets")


def slots(buckets: DataFrame, global_depth: int, key_bits: int) -> DataFrame:
    """slot, bucket: the directory at its global depth; a bucket has a slot for each
    prefix of it."""
    first = F.shiftright("bucket", key_bits - global_depth)
    more = F.expr(f"shiftleft(1L, {global_depth} - depth)")
    return buckets.select("bucket", F.explode(F.sequence(first, first + more - 1)).alias("slot"))


class Chains:
    """Texts by key; those of a key are told apart by their bytes."""

    def __init__(self):
        self.of: dict[int, list[list]] = {}
        self.bytes = 0

    def add(self, key: int, text: bytes, keep, size: int, bucket: int = 0, salts: int = 0) -> None:
        chain = self.of.setdefault(key, [])
        for entry in chain:
            if entry[0] == text:
                entry[1] = max((x for x in (entry[1], keep) if x is not None), default=None)
                entry[2] += size
                return
        chain.append([text, keep, size, bucket, salts])
        self.bytes += len(text)

    def drained(self, arrow: pa.Schema) -> pa.RecordBatch:
        """The texts as rows with the columns of ``arrow``; none are left."""
        found = [(key, at, *entry) for key, chain in self.of.items() for at, entry in enumerate(chain)]
        made = dict(zip(("key", "chain", "text", "keep_id", "group_size", "bucket", "salts"), list(zip(*found, strict=True)) or [[]] * 7, strict=True))
        if DIGEST[0] in arrow.names:
            made |= dict(zip(DIGEST, digests(list(made["text"])), strict=True))
        self.of, self.bytes = {}, 0
        return pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in arrow], schema=arrow)


def folded_texts(docs: DataFrame, key_bits: int) -> DataFrame:
    """key, text, keep_id, group_size of ``docs`` (doc_id, text), equal texts that a task
    meets within HELD bytes as one row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"key long, text binary, keep_id {kind}, group_size long"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chains = Chains()
        for part in slices(batches):
            for name, raw in zip(part.column(0).to_pylist(), binary(part.column(1)), strict=True):
                text = normal(raw)
                key = int.from_bytes(hashlib.sha256(text).digest()[:8], "big") >> (64 - key_bits)
                chains.add(key, text, name, 1)
            if chains.bytes >= HELD:
                yield chains.drained(arrow)
        yield chains.drained(arrow)

    return docs.mapInArrow(run, schema)


def owned(rows: DataFrame, kind: str) -> DataFrame:
    """Rows (bucket, key, salts, text, keep_id, group_size), sorted by bucket and key in
    each task, of which equal ones are one, with chain, the place in its key's chain, and
    the digest."""
    schema = f"bucket long, key long, salts long, chain int, text binary, keep_id {kind}, group_size long, " + ", ".join(f"{s} long" for s in DIGEST)
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chains, last = Chains(), None
        for part in slices(batches):
            for bucket, key, salts, text, keep, size in zip(*(part.column(i).to_pylist() for i in range(6)), strict=True):
                if key != last and chains.bytes >= HELD:
                    yield chains.drained(arrow)
                chains.add(key, text, keep, size, bucket, salts)
                last = key
        yield chains.drained(arrow)

    return rows.select("bucket", "key", "salts", "text", "keep_id", "group_size").mapInArrow(run, schema)


@dataclass
class Index:
    """entries (bucket, key, chain, s1..s4, keep_id, group_size) in the shared folder,
    sorted by bucket; buckets (bucket, depth, n); the directory's global depth."""

    entries: DataFrame
    buckets: DataFrame
    global_depth: int
    key_bits: int

    @property
    def directory(self) -> DataFrame:
        return slots(self.buckets, self.global_depth, self.key_bits)

    def placed(self, rows: DataFrame) -> DataFrame:
        """``rows`` (key) with the bucket that the directory names."""
        slot = F.shiftright("key", self.key_bits - self.global_depth)
        known = near(self.directory, rows=1 << self.global_depth)
        return rows.withColumn("slot", slot).join(known, "slot").drop("slot")

    def lookup(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, keep_id, group_size of every row: those of the equal text that is in
        the index, or null."""
        rows = hashed(columns(docs, id_col, text_col), self.key_bits)
        return self.placed(rows).join(self.entries.select("bucket", *DIGEST, "keep_id", "group_size"), ["bucket", *DIGEST], "left").select("doc_id", "keep_id", "group_size")


def columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def build(docs: DataFrame, rows: DataFrame, capacity: int = CAPACITY, key_bits: int = KEY_BITS) -> Index:
    """The index of ``docs`` (doc_id, text), whose hashes are the staged ``rows``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    each = [F.max(s).alias(s) for s in DIGEST]
    keys = staged(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep_id"), *each), "keys")
    buckets = directory(keys, keys.staged_rows, capacity, key_bits)
    deepest = buckets.agg(F.max("depth").alias("d")).first().d or 0
    index = Index(keys, buckets, deepest, key_bits)

    # Texts of keys that several rows have, equal ones folded in each task.
    shared = keys.where("n > 1").select("key", F.ceil(F.cbrt("n")).cast("long").alias("salts"))
    shared = staged(gathered(index.placed(shared), keys.staged_rows), "shared")
    dealt = folded_texts(docs, key_bits).join(near(shared), "key").withColumn("salt", F.spark_partition_id() % F.col("salts"))
    owners = staged(owned(dealt.repartition("bucket", "salt").sortWithinPartitions("bucket", "key"), kind), "owners")
    chained = owned(owners.repartition("bucket").sortWithinPartitions("bucket", "key"), kind)
    order = ["bucket", "key", "chain", "keep_id", "group_size", *DIGEST]
    alone = index.placed(keys.where("n = 1")).select("bucket", "key", F.lit(0).alias("chain"), "keep_id", F.col("n").alias("group_size"), *DIGEST)
    entries = staged(alone.select(*order).union(chained.select(*order)), "entries")
    files = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index.entries = staged(entries.repartitionByRange(files, "bucket").sortWithinPartitions("bucket", "key"), "index")
    release(keys, shared, owners, entries)
    return index


def exact_groups(docs: DataFrame, capacity: int = CAPACITY, key_bits: int = KEY_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row: the largest doc_id of
    the rows with an equal text, their number, whether this one is it."""
    base = columns(docs, id_col, text_col)
    rows = staged(hashed(base, key_bits), "hashes")
    index = build(base, rows, capacity, key_bits)
    out = rows.join(near(index.entries.select(*DIGEST, "keep_id", "group_size")), DIGEST)
    sha = F.lower(F.concat(*(F.lpad(F.hex(s), 16, "0") for s in DIGEST)))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), sha.alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay of their group; a row that shares its doc_id with a
    copy of another text is judged by its own text."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    gone = exact_groups(docs, id_col=id_col, text_col=text_col).where(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).distinct()
    sha = F.sha2(F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), upper, lower), 256)
    return docs.join(gone, docs[id_col].eqNullSafe(gone["__id"]) & (sha == gone["__sha"]), "left_anti")


def op11_exact_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = """WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256 FROM t WINDOW w AS (PARTITION BY text)"""
