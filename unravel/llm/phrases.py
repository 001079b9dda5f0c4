"""Collocations by hierarchical pair naming.

Frequent words get ids. At each place of a text the two frequent (k-1)-grams that begin
there and at the next place make a pair; pairs are counted over all texts and frequent
ones get an id of their own, which replaces the pair at its places. A phrase's id so
stands for a pair of parents, the phrase less its last word and the phrase less its first:
the parents' counts, carried along, are those of all its cuts, and a phrase lies in a
longer one exactly if it is a parent of a phrase one word longer that is as frequent as
the longer one at least, so that one level up decides.

Texts are kept as blocks of word numbers, in the shared folder. A block's distinct words
or pairs, and no single places, are joined globally by one shuffle, which counts and
names them; the ids come back to the block in a cogroup, which replaces and pairs at
once. So no dictionary is held whole: a block's task has the block and its own names. A
block ends with the text that fills it. Hot phrases have one row a block. Words are
rows of that shuffle. Pairs, far more, are dealt to parts by a hash; what a block sends to
a part is one row, its pairs in order as packed numbers, and the part, a group of about
PART pairs at most, answers with one row of ids. The best phrases
are first sought in BINS parts of each language, then among these.

Scores are compared as whole numbers in decimals of 38 digits.

Edge cases: a null text is empty, a null language ``und``; words are anything between
spaces and tabs, NUL and quotes included; rows that repeat a doc_id count on their own;
a piece is held by the task of its text; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import arrow_schema, binary, gathered, release, slices, staged

LEAST, MOST_WORDS, TOP, INSIDE = 30, 4, 2000, 80
#: Words of a block; parts in which the best phrases of a language are sought first.
BLOCK, BINS = 1 << 20, 64
#: Words of the texts for each part that pairs are dealt to; a part has fewer pairs.
PART = 1 << 21
#: Wide rows are written in row groups of about this size, so that no reader or writer
#: holds many of them; the size is asked for at every row.
NARROW = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
#: Bits of a key's number in its block and of a block's number in its task: a task may make
#: 2048 blocks, and 2 ** 21 tasks may.
NUMBER_BITS, MADE_BITS = 31, 11
#: Pieces end at these; the first stands for all of them.
ENDS = b".,;:!?\n\x0b\x0c\r"
PIECES = bytes.maketrans(ENDS, b"." * len(ENDS))


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as 64-bit bytes, compressed: all lowest bytes first, then the next."""
    if not len(values):
        return b""
    return pa.compress(values.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def unpack(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.empty(0, dtype=np.int64)
    planes = np.frombuffer(pa.decompress(data, 8 * n, "zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<i8").ravel()


def steps(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=0)


def word_blocks(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """block, size (of places), places (packed numbers into ``keys``, -1 between pieces), keys (lang, word, n:
    the block's distinct words and their number)."""
    schema = "block long, size long, places binary, keys array<struct<lang:string,word:string,n:long>>"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part_no, made, held, places = TaskContext.get().partitionId(), 0, 0, []
        number = itertools.count()
        known: dict[str, dict[bytes, int]] = defaultdict(lambda: defaultdict(number.__next__))

        def flushed() -> pa.RecordBatch:
            nonlocal number, made, held
            flat = np.concatenate(places)
            n = next(number)
            langs, words, end = [""] * n, [b""] * n, np.zeros(n, dtype=bool)
            for lang, of in known.items():
                for w, k in of.items():
                    langs[k], words[k], end[k] = lang, w, w == b"."
            counts = np.bincount(flat, minlength=n)
            keep = np.flatnonzero(~end)
            to = np.full(n, -1, dtype=np.int32)
            to[keep] = np.arange(len(keep), dtype=np.int32)
            keys = pa.StructArray.from_arrays([pa.array([langs[k] for k in keep], pa.string()), pa.array([words[k] for k in keep], pa.binary()).cast(pa.string()), pa.array(counts[keep], pa.int64())], fields=list(arrow.field("keys").type.value_type))
            if made >> MADE_BITS or part_no >> (63 - NUMBER_BITS - MADE_BITS):
                raise ValueError("too many blocks to number: read the texts in more and smaller tasks, or enlarge BLOCK")
            rows = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys).cast(arrow.field("keys").type)
            out = pa.RecordBatch.from_arrays([pa.array([(part_no << MADE_BITS) + made]), pa.array([len(flat)]), pa.array([pack(to[flat])]), rows], schema=arrow)
            number, held, made = itertools.count(), 0, made + 1
            known.clear()
            places.clear()
            return out

        for part in slices(batches, 64):
            for lang, text in zip(part.column(0).to_pylist(), binary(part.column(1)), strict=True):
                found = (text or b"").lower().translate(PIECES).replace(b".", b" . ").split()
                if not found:
                    continue
                of = known[lang]
                places.append(np.fromiter(map(of.__getitem__, found), dtype=np.int32, count=len(found)))
                places.append(np.array([of[b"."]], dtype=np.int32))
                held += len(found) + 1
                if held >= BLOCK:
                    yield flushed()
        if places:
            yield flushed()

    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")), F.col(text_col).cast("string")).mapInArrow(run, schema)


def named(blocks: DataFrame, parts: list[str], least: int) -> tuple[DataFrame, DataFrame]:
    """(names, places) of the staged ``blocks``: id, ``parts``, a (count) of the keys with
    at least ``least`` occurrences; block, number, id of their places in blocks. A key's
    id is its first place, so keys are shuffled once, for count and id together."""
    keys = blocks.select("block", F.posexplode("keys").alias("number", "key"))
    place = (F.shiftleft("block", NUMBER_BITS) + F.col("number")).alias("place")
    same = Window.partitionBy(*parts)
    counted = keys.select(place, *(F.col(f"key.{p}").alias(p) for p in parts), F.col("key.n").alias("n"))
    counted = counted.select("place", *parts, F.sum("n").over(same).alias("a"), F.min("place").over(same).alias("id")).where(F.col("a") >= least)
    first = F.col("id") == F.col("place")
    number = (F.col("place").bitwiseAND((1 << NUMBER_BITS) - 1)).cast("int").alias("number")
    found = staged(counted.select(F.shiftright("place", NUMBER_BITS).alias("block"), number, "id", F.when(first, F.col("a")).alias("a"), *(F.when(first, F.col(p)).alias(p) for p in parts)), "places")
    names = staged(gathered(found.where("a IS NOT NULL").select("id", *parts, "a"), found.staged_rows), "names")
    return names, found


def paired(blocks: DataFrame, found: DataFrame, parts: int) -> DataFrame:
    """Blocks like ``blocks`` whose places hold pairs: of the names that ``found`` (block,
    number, id, or packed: block, first, size, ids) gives to a place and to the next.
    keys: a row for each part with pairs: part, first (number of its first pair), size,
    pairs (packed: left, right, n), ordered by left and right."""
    schema = "block long, size long, places binary, keys array<struct<part:int,first:long,size:long,pairs:binary>>"
    arrow = arrow_schema(schema)
    rows = "number" in found.columns

    def named_places(right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        if rows:
            return right.column("number").to_numpy(), right.column("id").to_numpy()
        sizes, data = right.column("size").to_pylist(), right.column("ids").to_pylist()
        ids = [np.cumsum(unpack(x, n)) for x, n in zip(data, sizes, strict=True)]
        number = [unpack(x, n) + k for x, n, k in zip(right.column("numbers").to_pylist(), sizes, right.column("first").to_pylist(), strict=True)]
        return np.concatenate(number), np.concatenate(ids)

    def pairs(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        places = unpack(left.column("places")[0].as_py(), left.column("size")[0].as_py())
        number, ids = named_places(right)
        order = np.argsort(ids)
        number, ids = number[order], ids[order]
        to = np.full(max(int(places.max(initial=0)), int(number.max())) + 2, -1, dtype=np.int32)
        to[number] = np.arange(len(number), dtype=np.int32)
        at = to[places]  # -1 reads the last, which is -1
        at = at[(at >= 0) | (np.concatenate([[0], at[:-1]]) >= 0)]  # one -1 is as good as many
        start = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0))
        pair = at[start].astype(np.int64) * len(ids) + at[start + 1]
        kinds, which, n = np.unique(pair, return_inverse=True, return_counts=True)
        one, two = ids[kinds // len(ids)], ids[kinds % len(ids)]
        part = dealt(one, two, parts)
        by_part = np.argsort(part, kind="stable")  # so a part's pairs stay in order
        new = np.empty(len(kinds), dtype=np.int64)
        new[by_part] = np.arange(len(kinds))
        out = np.full(len(at), -1, dtype=np.int64)
        out[start] = new[which]
        del to, at, start, pair, which, new
        part, one, two, n = part[by_part], one[by_part], two[by_part], n[by_part]
        ends = np.searchsorted(part, np.arange(parts + 1))
        keys = []
        for k in np.flatnonzero(np.diff(ends)).tolist():
            a, b = int(ends[k]), int(ends[k + 1])
            keys.append({"part": k, "first": a, "size": b - a, "pairs": pack(np.concatenate([steps(one[a:b]), two[a:b], n[a:b]]))})
        row = {"block": left.column("block")[0].as_py(), "size": len(out), "places": pack(out), "keys": keys}
        return pa.Table.from_pylist([row], schema=arrow)

    given = found.select(F.col("block").alias("of"), *(c for c in found.columns if c in ("number", "id", "first", "size", "numbers", "ids")))
    return blocks.select("block", "size", "places").groupBy("block").cogroup(given.groupBy("of")).applyInArrow(pairs, schema)


def dealt(left: np.ndarray, right: np.ndarray, parts: int) -> np.ndarray:
    """The part of each pair: a hash of both ids."""
    h = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((h >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)


def named_pairs(blocks: DataFrame, least: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """As ``named``, of pairs: names are id, left, right, a; the places in blocks are packed
    rows of block, first, size, numbers (of the frequent pairs, from first on), ids. A
    part's names are numbered in order; the part is the id's rest by ``parts``."""
    schema = "block long, first long, size long, numbers binary, ids binary, names array<struct<id:long,left:long,right:long,a:long>>"
    arrow = arrow_schema(schema)

    def count(rows: pa.Table) -> pa.Table:
        sizes = rows.column("size").to_numpy()
        left, right, n = (np.empty(int(sizes.sum()), dtype=np.int64) for _ in range(3))
        ends = np.cumsum(sizes)
        for end, size, data in zip(ends.tolist(), sizes.tolist(), rows.column("pairs").to_pylist(), strict=True):
            one, right[end - size : end], n[end - size : end] = np.split(unpack(data, 3 * size), 3)
            left[end - size : end] = np.cumsum(one)
        order = np.lexsort((right, left))
        changed = np.empty(len(order), dtype=bool)
        changed[:1] = True
        changed[1:] = (np.diff(left[order]) != 0) | (np.diff(right[order]) != 0)
        begin = np.flatnonzero(changed)
        a = np.add.reduceat(n[order], begin)
        often = a >= least
        ids = np.where(often, (np.cumsum(often) - 1) * parts + rows.column("part")[0].as_py(), -1)
        of = np.empty(len(order), dtype=np.int64)
        of[order] = ids[np.cumsum(changed) - 1]
        first = order[begin[often]]
        out: list[list] = [[], [], [], [], []]
        for block, start, end, size in zip(rows.column("block").to_pylist(), rows.column("first").to_pylist(), ends.tolist(), sizes.tolist(), strict=True):
            own = of[end - size : end]
            numbers = np.flatnonzero(own >= 0)
            if len(numbers):
                for column, x in zip(out, (block, start, len(numbers), pack(numbers), pack(steps(own[numbers]))), strict=True):
                    column.append(x)
        if not out[0]:
            return arrow.empty_table()
        fields = list(arrow.field("names").type.value_type)
        names = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (ids[often], left[first], right[first], a[often])], fields=fields)
        held = pa.ListArray.from_arrays(pa.array([0] + [len(names)] * len(out[0]), pa.int32()), names).cast(arrow.field("names").type)
        return pa.Table.from_arrays([*(pa.array(x, f.type) for x, f in zip(out, arrow, strict=False)), held], schema=arrow)

    keys = blocks.select("block", F.explode("keys").alias("k")).select("block", "k.part", "k.first", "k.size", "k.pairs")
    found = staged(keys.groupBy("part").applyInArrow(count, schema), "places", **NARROW)
    names = staged(found.select(F.inline("names")), "names")
    return names, found


def composed(names: DataFrame, parents: DataFrame) -> DataFrame:
    """id, left, right, a with lang, phrase, last (word), before and after (counts of the
    parts before and after each cut) from the phrases that are a word shorter."""
    left = parents.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("start"), F.concat("before", F.array("a")).alias("before"))
    right = parents.select(F.col("id").alias("right"), "last", F.concat(F.array("a"), "after").alias("after"))
    out = names.join(left, "left").join(right, "right")
    out = out.select("id", "left", "right", "a", "lang", F.concat_ws(" ", "start", "last").alias("phrase"), "last", "before", "after")
    return staged(gathered(out, names.staged_rows), "phrases")


def whole(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def weakest_cut(least_words: int = 1) -> Column:
    """score, cut, l, r of the cut of least score, ties to the first."""
    cuts = F.arrays_zip(F.col("before").alias("before"), F.col("after").alias("after"))
    score = lambda c: F.call_function("div", whole(F.col("a")) * F.lit(2_000_000).cast("decimal(7,0)"), whole(c["before"] + c["after"]))
    return F.array_min(F.transform(cuts, lambda c, i: F.struct(score(c).alias("score"), i.alias("cut"), c["before"].alias("l"), c["after"].alias("r"))))


def collocations(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, top: int = TOP, inside_percent: int = INSIDE, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the ``top`` phrases of two to ``most_words``
    words of each language: those of at least ``least`` occurrences, but for ones that
    lie in a longer phrase with ``inside_percent`` of their occurrences."""
    blocks = staged(word_blocks(docs, lang_col, text_col), "blocks", **NARROW)
    totals = staged(blocks.select(F.explode("keys").alias("k")).groupBy("k.lang").agg(F.sum("k.n").alias("n")), "totals")
    parts = (totals.agg(F.sum("n")).first()[0] or 0) // PART + 1
    names, found = named(blocks, ["lang", "word"], least)
    empty = F.array().cast("array<bigint>")
    level = names.select("id", "a", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), empty.alias("before"), empty.alias("after"))
    levels = []
    for _ in range(most_words - 1):
        longer = staged(paired(blocks, found, parts), "blocks", **NARROW)
        release(blocks, found)
        blocks = longer
        names, found = named_pairs(blocks, least, parts)
        level = composed(names, level)
        levels.append(level)
    release(blocks, found)
    kept = None
    for k, phrases in enumerate(levels):
        if k + 1 < len(levels):
            up = levels[k + 1].select(F.explode(F.array("left", "right")).alias("id"), "a").groupBy("id").agg(F.max("a").alias("most"))
            phrases = phrases.join(up, "id", "left")
            phrases = phrases.where(F.col("most").isNull() | (whole(F.col("most")) * 100 < whole(F.col("a")) * inside_percent))
        phrases = phrases.select("id", "lang", "phrase", "a", weakest_cut().alias("c"))
        kept = phrases if kept is None else kept.union(phrases)
    order = [F.desc("c.score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(BINS))
    first = kept.withColumn("place", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("place") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "c.l", "c.r", "n", "c.score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS ws FROM pieces),
totals AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY 1),
f AS (SELECT lang, k, phrase, count(*) AS a FROM (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 5) t(k)) GROUP BY 1, 2, 3),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 30),
inner_parts AS (SELECT lang, j, unnest(list_transform(range(1, k - j + 2), lambda i: array_to_string(ws[i:i + j - 1], ' '))) AS phrase, a FROM c, range(2, 4) t(j) WHERE j < k),
most AS (SELECT lang, j AS k, phrase, max(a) AS a FROM inner_parts GROUP BY 1, 2, 3),
kept AS (SELECT c.* FROM c LEFT JOIN most m USING (lang, k, phrase) WHERE m.a IS NULL OR 100 * m.a < 80 * c.a),
cuts AS (SELECT c.lang, c.phrase, c.a, l.a AS l, r.a AS r, (2000000 * c.a) // (l.a + r.a) AS score, j FROM kept c JOIN range(1, 4) t(j) ON j < c.k JOIN f l ON l.lang = c.lang AND l.k = j AND l.phrase = array_to_string(c.ws[1:j], ' ') JOIN f r ON r.lang = c.lang AND r.k = c.k - j AND r.phrase = array_to_string(c.ws[j + 1:], ' ')),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""
