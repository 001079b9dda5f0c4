"""Toxicity scores by a counterfactual-regularised classifier.

A logistic model over words and word beginnings present in a text. Besides the usual
loss, each labelled text that holds an identity term is paired with its copy in
which the term is swapped for another of its group; the squared difference of the
two scores is penalised, so a neutral mention of a group doesn't move the score. Groups
are a list of common English terms and groups of frequent words with mostly neutral
mentions, mined from the sample.

Labels are taken from a bounded sample of SAMPLE labelled rows, by a hash of the id;
rows whose crc32(id as text) mod 5 is 0 are held out. Scores use the text alone.

Edge cases: null and empty texts get the model's base score; labels without a
document and null labels are unused; without labels of both kinds every score is the
share of ones, smoothed; repeated rows are scored one by one; an empty table gives an
empty result; other columns are kept by ``drop_toxic`` and ignored by ``score``.
"""

from __future__ import annotations

import string
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_pass, binary, release, slices, staged

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 16_000
BUCKETS = 1 << 20
FEATURES = 1024
#: Lengths of the beginnings of a word that are features of their own.
STARTS = (4, 5, 6)
#: Terms mined from the sample, at most; terms of a group.
TERMS, TERM_GROUP = 64, 4
# Our own list of common English identity terms by group; a term is swapped within its
# group. The terms of other corpora come from ``mined_terms``.
IDENTITY = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("female", "male"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european", "american", "mexican", "indian", "chinese"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("old", "young", "elderly"),
    ("blind", "deaf", "disabled", "paralyzed"),
    ("immigrant", "refugee", "migrant", "foreigner"),
)
STRIP = string.punctuation


def term_swaps(groups: tuple[tuple[str, ...], ...] = IDENTITY) -> dict[str, str]:
    return {t: group[(i + 1) % len(group)] for group in reversed(groups) for i, t in enumerate(group)}


def word_features(word: str) -> tuple[int, ...]:
    """Buckets of a word and of its beginnings."""
    word = word.strip(STRIP)
    if not word:
        return ()
    names = [f"w:{word}", *(f"s:{word[:n]}" for n in STARTS if len(word) >= n)]
    return tuple(zlib.crc32(x.encode()) % BUCKETS for x in names)


class Kept(dict):
    """Values of ``fn`` by word; begins anew when it is full."""

    def __init__(self, fn, most: int = 500_000):
        self.fn, self.most = fn, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.fn(word)
        return value


def text_words(text: bytes | None) -> list[str]:
    return text.decode().lower().split() if text else []


@dataclass
class Model:
    bias: float
    weights: dict[int, float] = field(default_factory=dict)  # by bucket
    swapped: int = 0  # texts of the fit whose swapped copy has other features

    def scorer(self):
        index = {b: i for i, b in enumerate(self.weights)}
        w = list(self.weights.values())
        kept = Kept(lambda x: tuple(index[b] for b in word_features(x) if b in index))

        def score(text: bytes | None) -> float:
            present = set().union(*filter(None, map(kept.__getitem__, text_words(text))))
            z = self.bias + sum(w[i] for i in sorted(present))
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score


#: Rows that are spread out at a time in a sum.
BLOCK = 512


def newton(rows: list[tuple[np.ndarray, np.ndarray | None, int]], features: int, penalty: float = 1.0, swap_penalty: float = 10.0, rounds: int = 25) -> tuple[float, np.ndarray]:
    """(bias, weights) by Newton's method on loss + penalty |w|^2 / 2 +
    swap_penalty * sum((w x - w x')^2) / 2. ``rows``: places of a text's features, those of
    its swapped copy or None, label. Sums are formed BLOCK rows at a time. A step is halved
    until the sum falls: whole steps may run away where texts have many features in common."""
    y = np.array([r[2] for r in rows], dtype=np.float64)
    share = (y.sum() + 1) / (len(y) + 2)
    bias, w = float(np.log(share / (1 - share))), np.zeros(features)

    def spread(parts: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(parts), features), dtype=np.float32)
        for i, at in enumerate(parts):
            out[i, at] = 1
        return out

    ridge = penalty * np.eye(features)
    swapped = [(x, z) for x, z, _ in rows if z is not None]
    for at in range(0, len(swapped), BLOCK):
        part = swapped[at : at + BLOCK]
        d = spread([x for x, _ in part]) - spread([z for _, z in part])
        ridge += swap_penalty * (d.T @ d)
    flat = np.concatenate([r[0] for r in rows]).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])

    def total(w: np.ndarray, bias: float) -> float:
        z = bias + np.bincount(owner, w[flat], len(rows))
        return float((np.logaddexp(0, z) - y * z).sum() + w @ ridge @ w / 2)

    now = total(w, bias)
    for _ in range(rounds):
        gw, gb, h, cross, mass = ridge @ w, 0.0, ridge.copy(), np.zeros(features), 0.0
        for at in range(0, len(rows), BLOCK):
            x = spread([r[0] for r in rows[at : at + BLOCK]])
            p = 1 / (1 + np.exp(-np.clip(x @ w + bias, -30, 30)))
            v, off = np.maximum(p * (1 - p), 1e-6), p - y[at : at + BLOCK]
            xv = x * v[:, None].astype(np.float32)
            h += x.T @ xv
            gw, gb, cross, mass = gw + x.T @ off, gb + off.sum(), cross + xv.sum(axis=0, dtype=np.float64), mass + v.sum()
        step = np.linalg.solve(h - np.outer(cross, cross) / mass, gw - cross * gb / mass)
        shift, share = float(gb - cross @ step) / mass, 1.0
        while (after := total(w - share * step, bias - share * shift)) > now and share > 1e-9:
            share /= 2
        if after > now:
            break
        w, bias, now = w - share * step, bias - share * shift, after
        if np.abs(step).max() < 1e-4:
            break
    return bias, w


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """text, y of at most ``sample`` labelled ids that aren't held out; staged. Of rows
    that repeat an id the text that sorts first counts."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    known = known.where(F.crc32(F.col("id").cast("string")) % 5 != 0).groupBy("id").agg(F.max("y").alias("y"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), "id")
    return staged(rows.groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y")).select("text", "y"), "labelled")


def associated(rows: DataFrame, name: str, ones: int, n: int) -> DataFrame:
    """``name``, n1, n0 (texts of label 1 and 0 with it), chi (squared) of rows
    (``name``, y)."""
    counts = rows.groupBy(name).agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0"))
    expect = (F.col("n1") + F.col("n0")) * (ones / n)
    return counts.withColumn("chi", (F.col("n1") - expect) ** 2 / (expect * (1 - (F.col("n1") + F.col("n0")) / n) + 1e-9))


def mined_terms(sample: DataFrame, ones: int, n: int) -> list[tuple[str, ...]]:
    """Groups of TERM_GROUP terms of like frequency. Terms are frequent words whose
    texts are mostly of label 0, though fewer than of all texts: neutral mentions that a
    plain model holds against a text, in whatever language the corpus is. Of these
    the TERMS that the labels tell apart most."""
    words = F.transform(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[ \t\n\r\f\x0b]+"), lambda w: F.btrim(w, F.lit(STRIP)))
    each = sample.select("y", F.explode(F.array_distinct(words)).alias("word")).where("word <> ''")
    texts = F.col("n1") + F.col("n0")
    found = associated(each, "word", ones, n).where((texts >= max(20, n // 100)) & (F.col("n1") < F.col("n0")) & (F.col("n1") * n > texts * ones))
    top = sorted((-(r.n1 + r.n0), r.word) for r in found.orderBy(F.desc("chi"), "word").limit(TERMS).collect())
    return [tuple(word for _, word in top[i : i + TERM_GROUP]) for i in range(0, len(top) - TERM_GROUP + 1, TERM_GROUP)]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, features: int = FEATURES, least: int = 5, swap_penalty: float = 10.0) -> Model:
    """Fitted on the rows that aren't held out, at most ``sample`` of them. The engine
    counts and ranks the features; the driver gets the ``features`` chosen buckets
    (chi squared, in at least ``least`` texts), TERMS terms and, for each row, the
    places of its chosen features."""
    rows = labelled(docs, labels, id_col, text_col, label_col, sample)
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones")).first()
    n, ones = total["n"], total["ones"] or 0
    share = (ones + 1) / (n + 2)
    base = Model(float(np.log(share / (1 - share))))
    if not 0 < ones < n:
        return base

    def buckets(part: pa.RecordBatch) -> dict[str, list]:
        kept = Kept(word_features)
        return {"x": [sorted(set().union(*map(kept.__getitem__, text_words(t)))) for t in binary(part.column(0))], "y": part.column(1)}

    each = arrow_pass(rows, buckets, "x array<int>, y int").select(F.explode("x").alias("bucket"), "y")
    top = associated(each, "bucket", ones, n).where(f"n1 + n0 >= {least} and chi > 0").orderBy(F.desc("chi"), "bucket").limit(features)
    chosen = {r.bucket: i for i, r in enumerate(sorted(top.select("bucket").collect()))}
    if not chosen:
        return base
    swaps = term_swaps((*IDENTITY, *mined_terms(rows, ones, n)))

    def places(part: pa.RecordBatch) -> dict[str, list]:
        kept = Kept(lambda word: tuple(chosen[b] for b in word_features(word) if b in chosen))
        pack = lambda words: np.array(sorted(set().union(*map(kept.__getitem__, words))), dtype="<i2").tobytes()
        out = {"x": [], "swapped": [], "y": part.column(1)}
        for text in binary(part.column(0)):
            words = set(text_words(text))
            out["x"].append(pack(words))
            held = any(w.strip(STRIP) in swaps for w in words)
            out["swapped"].append(pack({swaps.get(w.strip(STRIP), w) for w in words}) if held else None)
        return out

    unpack = lambda b: None if b is None else np.frombuffer(bytes(b), dtype="<i2")
    got = arrow_pass(rows, places, "x binary, swapped binary, y int").collect()
    got = sorted((r.y, bytes(r.x), bytes(r.swapped or b""), r.swapped is not None) for r in got)
    bias, w = newton([(unpack(x), unpack(z) if held else None, y) for y, x, z, held in got], len(chosen), swap_penalty=swap_penalty)
    release(rows)
    return Model(bias, dict(zip(chosen, w.tolist(), strict=True)), sum(held and x != z for _, x, z, held in got))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = sent.value.scorer()
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([scorer(x) for x in binary(part.column(1))], pa.float64())], names=["doc_id", "score"])

    out = base.mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``least``."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        scorer = sent.value.scorer()
        for part in slices(batches):
            yield part.filter(pa.array([scorer(x) < least for x in binary(part.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_toxicity(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, train(docs, labels))
