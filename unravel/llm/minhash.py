"""Near copies by b-bit MinHash.

A document is the set of its distinct word shingles. Documents with equal sets are
one class. Each class keeps ROWS * BANDS minima; bands of ROWS minima give candidate
keys, and the low BITS bits of CORE minima are packed into bit planes. Candidates
are scored by counting bits, corrected for chance agreement, and those that may
reach the threshold are confirmed on their full sets.

With 45 bands of 6 minima a pair at similarity 0.8 shares no band with probability
1e-6; the estimate's cut lies six standard deviations below the threshold. Nodes of
bands that a hub leaves open are compared by their rarest shingles, with a bound on
places, which finds all pairs among them.

Edge cases: a null, empty or blank text has no shingles and is linked with nothing; a
text with fewer words than a shingle is one shingle; rows that repeat a doc_id count
as one node; an empty table gives an empty result; other columns are ignored by
``near_duplicates`` and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import arrow_pass, binary, gathered, near, release, staged
from .linking import linked

ROWS, BANDS, BITS, CORE = 6, 45, 4, 256
#: Standard deviations of the estimate that a candidate may lie below the threshold.
MARGIN = 6.0
MIX = np.uint64(0x9E3779B97F4A7C15)


def finish(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(1)
def coefficients() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = ROWS * BANDS
    draw = finish(np.arange(1, 3 * n + 1, dtype=np.uint64) * MIX)
    return (draw[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (draw[n : 2 * n] >> np.uint64(32)).astype(np.uint32), draw[2 * n :] | np.uint64(1)


class WordHashes:
    """64-bit hashes of words as bytes, kept for frequent words."""

    def __init__(self, kept: int = 500_000):
        self.kept, self.known = kept, {}

    def of(self, words: list[bytes]) -> np.ndarray:
        try:
            raw = b"".join(map(self.known.__getitem__, words))
        except KeyError:
            from xxhash import xxh3_64_intdigest

            if len(self.known) > self.kept:
                self.known.clear()
            for w in words:
                if w not in self.known:
                    self.known[w] = xxh3_64_intdigest(w).to_bytes(8, "little")
            raw = b"".join(map(self.known.__getitem__, words))
        return np.frombuffer(raw, dtype="<u8")


@lru_cache(1)
def word_hashes() -> WordHashes:
    return WordHashes()


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; with fewer words, one of them all."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = word_hashes().of(words)
    n = min(width, len(words))
    acc = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for j in range(n):
        acc = (acc ^ h[j : len(words) - n + 1 + j]) * MIX
        acc ^= acc >> np.uint64(29)
    return np.unique(finish(acc))


def minima(shingles: np.ndarray) -> np.ndarray:
    a, b, _ = coefficients()
    x = (shingles >> np.uint64(32)).astype(np.uint32)[:, None]
    best = np.full(len(a), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(best, (x[at : at + 512] * a + b).min(axis=0), out=best)
    return best


def signature(best: np.ndarray) -> tuple[list[int], list[int]]:
    """(bit planes of the low bits as longs, plane after plane; band keys)."""
    low = best[:CORE]
    planes = [np.packbits((low >> np.uint32(p) & np.uint32(1)).astype(np.uint8)).view("<i8") for p in range(BITS)]
    mixed = best.astype(np.uint64) * coefficients()[2]
    keys = finish(mixed.reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * MIX)
    return np.concatenate(planes).tolist(), keys.view(np.int64).tolist()


def signatures(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, d1, d2 (digest of the set), planes, bands."""
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(part: pa.RecordBatch) -> dict[str, list]:
        out = []
        for text in binary(part.column(1)):
            s = shingle_hashes((text or b"").lower().split(), width)
            if not len(s):
                out.append((0, None, None, None, None))
                continue
            digest = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype="<i8").tolist()
            out.append((len(s), *digest, *signature(minima(s))))
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        return {"doc_id": part.column(0)} | dict(zip(("n_shingles", "d1", "d2", "planes", "bands"), cols, strict=True))

    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_pass(base, rows, f"doc_id {kind}, n_shingles long, d1 long, d2 long, planes array<long>, bands array<long>")


def similarity_estimate(x: Column, y: Column) -> Column:
    """Of two arrays of bit planes: the share of equal b-bit minima, less that which
    agrees by chance."""
    words = CORE // 64
    differ = F.lit(0)
    for j in range(words):
        bits = F.lit(0).cast("long")
        for p in range(BITS):
            bits = bits.bitwiseOR(x[p * words + j].bitwiseXOR(y[p * words + j]))
        differ = differ + F.bit_count(bits)
    chance = 1.0 / (1 << BITS)
    return ((F.lit(CORE) - differ) / F.lit(float(CORE)) - F.lit(chance)) / F.lit(1 - chance)


def shingle_set(text: bytes | None, width: int) -> set:
    words = (text or b"").lower().split()
    return {tuple(words[i : i + width]) for i in range(max(len(words) - width + 1, 1))} if words else set()


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets of shingles, from the full ``texts`` (node, text),
    have 100 * intersection >= percent * union. ``pairs`` is staged, and the result."""
    nodes = staged(gathered(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), 2 * pairs.staged_rows), "nodes")
    used = staged(texts.join(near(nodes), "node", "left_semi"), "texts")
    both = pairs.join(used.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").join(used.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    kind = pairs.schema["a"].dataType.simpleString()

    def check(part: pa.RecordBatch) -> dict[str, list]:
        last, kept, out = None, set(), {"a": [], "b": []}
        for a, b, ta, tb in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), binary(part.column(2)), binary(part.column(3)), strict=True):
            if ta != last:
                last, kept = ta, shingle_set(ta, width)
            other = shingle_set(tb, width)
            common = len(kept & other)
            if common and 100 * common >= percent * (len(kept) + len(other) - common):
                out["a"].append(a)
                out["b"].append(b)
        return out

    out = staged(arrow_pass(both.select("a", "b", "ta", "tb"), check, f"a {kind}, b {kind}").distinct(), "confirmed")
    release(nodes, used)
    return out


def rare_prefixes(rows: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """key (a shingle), node, x (its place in the node's set, rarest first, and the set's
    size) of the rarest shingles of the nodes of ``rows``, as many as two sets at
    the threshold must share one of; shingles of a single node are counted, but give no
    row. Frequencies are those among these nodes."""
    nodes = staged(gathered(rows.select("node").distinct(), rows.staged_rows), "opennodes")
    kind = rows.schema["node"].dataType.simpleString()

    def hashes(part: pa.RecordBatch) -> dict[str, list]:
        sets = [shingle_hashes((t or b"").lower().split(), width).view(np.int64) for t in binary(part.column(1))]
        return {"node": part.column(0), "shingles": sets}

    sets = staged(arrow_pass(texts.join(near(nodes), "node", "left_semi").select("node", "text"), hashes, f"node {kind}, shingles array<long>").dropDuplicates(["node"]), "sets")
    each = sets.select("node", F.explode("shingles").alias("key"))
    often = each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ranked = each.join(often, "key", "left").groupBy("node").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(1)).alias("n"), "key"))).alias("s"))
    size = F.size("s")
    prefix = F.slice("s", 1, size - F.ceil(size * percent / 100).cast("int") + 1)
    placed = ranked.select("node", size.alias("size"), F.posexplode(prefix).alias("at", "s")).where("s.n > 1")
    out = staged(placed.select("s.key", "node", F.struct("at", F.col("size").alias("n")).alias("x")), "prefixes")
    release(nodes, sets)
    return out


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, class_id, component_id, kept of every row. class_id: the
    least doc_id with the same set; component_id: the least doc_id reachable by
    links; kept: it is its own component's."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = staged(signatures(base, width), "signatures")
    classes = staged(rows.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("class_id")), "classes")
    heads = rows.join(classes, (rows.doc_id == classes.class_id) & (rows.d1 == classes.d1) & (rows.d2 == classes.d2), "left_semi").dropDuplicates(["doc_id", "d1", "d2"])
    heads = staged(heads.select(F.col("doc_id").alias("node"), "n_shingles", "planes", "bands"), "heads")
    keys = heads.select(F.explode(F.array_distinct("bands")).alias("key"), "node", F.struct(F.col("n_shingles").alias("n")).alias("x"))
    cut = percent / 100 - MARGIN * (percent / 100 * (1 - percent / 100) / CORE) ** 0.5 / (1 - 1 / (1 << BITS))
    texts = base.select(F.col("doc_id").alias("node"), "text")

    def confirm(pairs: DataFrame) -> DataFrame:
        side = lambda s: heads.select(F.col("node").alias(s), F.col("n_shingles").alias(f"n{s}"), F.col("planes").alias(f"p{s}"))
        both = side("b").join(near(side("a").join(near(pairs), "a"), pairs.staged_rows), "b")
        may = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (similarity_estimate(F.col("pa"), F.col("pb")) >= cut)
        candidates = staged(gathered(both.where(may).select("a", "b").distinct(), pairs.staged_rows), "candidates")
        out = confirmed(candidates, texts, width, percent)
        release(candidates)
        return out

    # Two sets at the threshold are of like sizes; if their first common shingle in the
    # order of rarity has these places, what follows can still be common.
    sizes = lambda l, r: 100 * F.least(l["n"], r["n"]) >= percent * F.greatest(l["n"], r["n"])
    places = lambda l, r: sizes(l, r) & ((100 + percent) * F.least(l["n"] - l["at"], r["n"] - r["at"]) >= percent * (l["n"] + r["n"]))
    groups, _ = linked(keys, confirm, lambda rows: rare_prefixes(rows, texts, width, percent), places, sizes)
    out = rows.select("doc_id", "n_shingles", "d1", "d2").join(classes, ["d1", "d2"], "left").join(near(groups.withColumnRenamed("node", "class_id"), groups.staged_rows), "class_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component", "class_id", "doc_id").alias("component_id")).withColumn("kept", F.col("component_id") == F.col("doc_id"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without those that another document of their group stands for.
    Documents are told apart by id: a row that shares its doc_id with a copy goes with it;
    rows of a null doc_id, or without words, stay; an empty table stays empty."""
    gone = near_duplicates(docs, width, percent, id_col, text_col).where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")


def op2_minhash(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2).select("doc_id", "n_shingles", "component_id", "kept", "class_id")
