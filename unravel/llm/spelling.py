"""Groups of spelling variants, without pairs.

Words are near if they differ by one inserted, deleted or replaced code point. A word
of m letters belongs to m wildcard groups (position, prefix, suffix); two words that
differ by a replacement share exactly one of them. A group has no more words than the
alphabet has letters; its size and two most frequent words tell each member how many
near words it has there and which is the most frequent: the group's first word, or the
second for the first itself. For insertions and deletions each word less a letter is
joined with the vocabulary, which gives real links alone, at most one a letter. A word's
form is its most frequent near word, if that is frequent enough; forms are followed to
their roots by doubling, so a chain takes a number of rounds that is the logarithm of
its length.

Runs of letters are counted in Arrow passes with a bounded table a task; all else is
DataFrame code, over distinct words.

Edge cases: a null text has no words; a null doc_id is written as an empty string where
``noise`` hashes it; rows that repeat a doc_id count on their own; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import arrow_schema, binary, gathered, near, release, slices, staged

#: Letters of a run, once A-Z are lower case.
LETTERS = "a-zÀ-ÿ"
#: Distinct words that a task counts before it hands them on.
HELD = 400_000


def word_counts(docs: DataFrame, least_length: int, noise: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n of the runs of letters of all texts that have ``least_length`` letters.
    ``noise``: runs of a document whose crc32 with its id is divisible by it lose a
    letter."""
    schema = "word string, n long"
    arrow = arrow_schema(schema)
    runs = re.compile(f"[{LETTERS}]{{{least_length},}}")  # shorter ones only get shorter

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, int] = {}

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], schema=arrow)
            found.clear()
            return out

        for part in slices(batches, 64):
            for name, text in zip(part.column(0).to_pylist(), binary(part.column(1)), strict=True):
                if not text:
                    continue
                own: dict[str, int] = {}
                for w in runs.findall(text.lower().decode()):
                    own[w] = own.get(w, 0) + 1
                head = zlib.crc32(f"{'' if name is None else name}:".encode())
                for w, n in own.items():
                    if noise and not (h := zlib.crc32(w.encode(), head)) % noise:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                        if len(w) < least_length:
                            continue
                    found[w] = found.get(w, 0) + n
            if len(found) >= HELD:
                yield flushed()
        yield flushed()

    rows = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(count, schema)
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


#: Orders words by count, falling, then by code points; the least comes first.
def ranked(word: str = "word", n: str = "n"):
    return F.struct((-F.col(n)).alias("less"), F.col(word).alias("word"))


def replaced(words: DataFrame) -> DataFrame:
    """word, near, best of each wildcard group with other words of ``words`` (word, n)."""
    at = words.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at"))
    key = F.concat(F.expr("substr(word, 1, at - 1)"), F.lit("*"), F.expr("substr(word, at + 1)"))
    groups = at.groupBy(key.alias("key")).agg(F.sort_array(F.collect_list(ranked())).alias("members"))  # no more than the alphabet has letters
    groups = groups.select("members", F.size("members").alias("size"), F.col("members")[0].alias("first"), F.try_element_at("members", F.lit(2)).alias("second")).where("size > 1")
    each = groups.select(F.explode("members").alias("m"), "size", "first", "second")
    other = F.when(F.col("m.word") == F.col("first.word"), F.col("second")).otherwise(F.col("first"))
    return each.select("m.word", (F.col("size") - 1).cast("long").alias("near"), other.alias("best"))


def shortened(words: DataFrame, rows: int) -> DataFrame:
    """word, near (1), best of both ends of each pair of words of which one is the
    other less a letter. Of a run of equal letters only the first is left out."""
    at = words.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at"))
    at = at.where("at = 1 OR substr(word, at, 1) <> substr(word, at - 1, 1)")
    less = at.select(F.col("word").alias("long"), F.col("n").alias("long_n"), F.concat(F.expr("substr(word, 1, at - 1)"), F.expr("substr(word, at + 1)")).alias("word"))
    links = less.join(near(words.select("word", "n"), rows), "word")
    ends = F.array(F.struct(F.col("long").alias("word"), ranked("word", "n").alias("best")), F.struct(F.col("word"), ranked("long", "long_n").alias("best")))
    return links.select(F.explode(ends).alias("e")).select("e.word", F.lit(1).cast("long").alias("near"), "e.best")


def followed(forms: DataFrame) -> DataFrame:
    """word, root: where the chain that starts with ``forms`` (word, form), each rising
    in count, ends. Staged; a round doubles the steps."""
    roots = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = staged(roots.join(near(up, roots.staged_rows), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        release(roots)
        roots = after.select("word", "root")
        roots.staged_rows, roots.staged_path = after.staged_rows, after.staged_path
        if not after.where("moved").limit(1).count():
            return roots


def spelling_groups(docs: DataFrame, least_length: int = 6, least_count: int = 5, ratio: int = 5, noise: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of at least ``least_length``
    letters and ``least_count`` occurrences. form: the near word of most occurrences,
    ties to the first in code-point order, if it has ``ratio`` times the word's."""
    words = staged(word_counts(docs, least_length, noise, id_col, text_col).where(F.col("n") >= least_count), "words")
    nothing = F.lit(None).cast("struct<less:bigint,word:string>")
    parts = words.select("word", "n", F.lit(0).cast("long").alias("near"), nothing.alias("best"))
    for found in (replaced(words), shortened(words, words.staged_rows)):
        parts = parts.union(found.select("word", F.lit(None).cast("long").alias("n"), "near", "best"))
    known = parts.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("n")
    known = staged(known.select("word", "n", "n_near", F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "near")
    roots = followed(gathered(known.where("form IS NOT NULL").select("word", "form"), words.staged_rows))
    out = known.join(near(roots, roots.staged_rows), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), noise=199)
