"""Quality rules with host verdicts.

Every document gets counts from its whole text and a base verdict. Failures of each rule
are summed by host, each host's failure rate is shrunk towards an empirical beta prior
fitted over all hosts, and the host's verdict is joined back. A host fails by a rule if
its rate is over a limit or a multiple of the mean of all hosts, by so many standard
deviations of its posterior that chance is no likely cause.

Edge cases: a null text counts as empty (no words, base_failed); a document
without a host gets no host verdict; an empty table gives an empty table; repeated
rows are judged one by one; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_pass, binary, bounded, staged

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\r\x0b\x0c"
WINDOW = 8
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in some ``window``-word run found twice or more (overlaps
    count). Runs are numbered exactly by doubling, not hashed."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    if len(seen) == len(words):
        return 0
    width = 1
    while width < window:
        step = min(width, window - width)
        pair = ids[: len(ids) - step] * (ids.max() + 1) + ids[step:]
        kinds, ids = np.unique(pair, return_inverse=True)
        if len(kinds) == len(pair):
            return 0
        width += step
    starts = np.flatnonzero(np.bincount(ids)[ids] > 1)
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + window, -1)
    return int((np.cumsum(covered) > 0).sum())


def text_counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    text = text or b""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    chars = len(text.translate(None, SPACE).decode("utf-8", "replace"))
    return len(words), chars, sum(text.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS))), len(lines) - len(set(lines)), repeat_words(words)


def document_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """doc_id, host, the counts and base_failed of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def counts(part: pa.RecordBatch) -> dict[str, list]:
        rows = [text_counts(x) for x in binary(part.column(2))]
        cols = zip(*rows, strict=True) if rows else [[]] * 5
        return {"doc_id": part.column(0), "host": part.column(1)} | dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), map(list, cols), strict=True))

    base = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    out = arrow_pass(base, counts, f"doc_id {kind}, host string, {COUNTS}")
    out = out.withColumns({"short_failed": F.col("n_words") < min_words, "repeats_failed": 100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")})
    return out.withColumn("base_failed", F.col("short_failed") | F.col("repeats_failed"))


#: The rules whose failures are judged by host, by the prefix of their columns.
RULES = ("short", "repeats")


def host_verdicts(rules: DataFrame, names: tuple[str, ...] = RULES, max_rate: float = 0.5, factor: float = 2.0, deviations: float = 2.0, least_prior: float = 2.0) -> DataFrame:
    """host, host_docs, and <rule>_rate (shrunk failure rate), <rule>_ok of each rule
    with a column <rule>_failed, host_ok (all of them).

    Rates follow Beta(a, b): mean and variance of the hosts' raw rates give a and
    b by moments, with the sampling variance taken off and at least
    ``least_prior`` pseudo-documents, so that a host of a few rows stays near the
    mean. A host fails if its posterior mean less ``deviations`` of its posterior's
    standard deviation is over the lesser of ``max_rate`` and ``factor`` times the mean
    of all documents. The priors come from one row of sums; no list of hosts is gathered.
    """
    failed = [F.sum(F.col(f"{r}_failed").cast("long")).alias(f"{r}_failed") for r in names]
    hosts = rules.where(F.col("host").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"), *failed)
    hosts = staged(hosts, "hostcounts")
    sums = [x for r in names for x in (F.sum(f"{r}_failed").alias(f"f_{r}"), F.var_pop(F.col(f"{r}_failed") / F.col("host_docs")).alias(f"v_{r}"))]
    row = hosts.agg(F.sum("host_docs").alias("n"), F.avg(1 / F.col("host_docs")).alias("inv"), *sums).first()
    out, ok = hosts, F.lit(True)
    for r in names:
        mean = (row[f"f_{r}"] or 0) / row.n if row.n else 0.0
        spread = max((row[f"v_{r}"] or 0.0) - mean * (1 - mean) * (row.inv or 0.0), 1e-9)
        prior = min(max(mean * (1 - mean) / spread - 1, least_prior), 1e6)
        a, n = mean * prior, F.col("host_docs") + F.lit(prior)
        rate = F.col(f"{r}_rate")
        out = out.withColumn(f"{r}_rate", (F.col(f"{r}_failed") + F.lit(a)) / n)
        limit = min(max_rate, factor * mean) if mean else max_rate
        out = out.withColumn(f"{r}_ok", rate - deviations * F.sqrt(rate * (1 - rate) / (n + 1)) <= F.lit(limit))
        ok = ok & F.col(f"{r}_ok")
    return out.withColumn("host_ok", ok).drop(*(f"{r}_failed" for r in names))


def host_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = 0.5, factor: float = 2.0, broadcast_hosts: int = 200_000, **rules) -> DataFrame:
    """Counts, base_failed, host_docs, each rule's rate and verdict, host_ok and kept of
    every row.

    Texts are read once: the narrow counts are staged. Hosts are broadcast only
    up to ``broadcast_hosts`` rows; beyond, the join shuffles and AQE splits a hot
    host.
    """
    counts = staged(document_rules(docs, id_col, text_col, host_col, **rules), "quality")
    verdicts = staged(host_verdicts(counts, max_rate=max_rate, factor=factor), "hosts")
    if bounded(verdicts, broadcast_hosts):
        verdicts = F.broadcast(verdicts)
    out = counts.join(verdicts, "host", "left")
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce("host_ok", F.lit(True)))


def op1_host_quality(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return host_quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host", "short_rate", "repeats_rate", "host_ok")
