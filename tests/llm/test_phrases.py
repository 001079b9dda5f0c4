"""Collocations against counts of all runs of words."""

import collections
import random
import re

import pytest

from unravel.llm import phrases

DOCS = "doc_id long, text string, lang string, a string, left long"


def expected(rows, least, most_words, top, inside):
    total, f = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k in range(1, most_words + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    often = [p for p, a in f.items() if len(p[1]) > 1 and a >= least]
    gone = set()
    for lang, p in often:
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                part = (lang, p[i : i + k])
                if 100 * f[lang, p] >= inside * f[part]:
                    gone.add(part)
    out = collections.defaultdict(list)
    for lang, p in often:
        if (lang, p) not in gone:
            a = f[lang, p]
            cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out[lang].append((-score, -a, " ".join(p).encode(), a, f[lang, p[:k]], f[lang, p[k:]], total[lang], score))
    return sorted((lang, i + 1, x[2].decode(), *x[3:]) for lang, xs in out.items() for i, x in enumerate(sorted(xs)[:top]))


def some_rows():
    rng = random.Random(3)
    vocab = ["the", "of", "a", "Über", "é", "it's", "x\x00y", "日本", "a_b", "\x85q"]
    rows = []
    for k in range(300):
        words = [rng.choice(vocab[: 3 + k % 7]) for _ in range(rng.randrange(60))]
        text = "".join(w + rng.choice((" ", " ", "  ", "\t", ", ", ".", "\r\n")) for w in words)
        rows.append((rng.choice(("en", "de", None)), text + "The new york stock exchange of a"))
    return rows + [("en", None), ("en", ""), ("xx", "alone"), rows[0], rows[0], ("en", "the of " * 20_000)]


@pytest.mark.parametrize("least,most_words,top,inside,block", [(30, 4, 2000, 80, 1 << 20), (3, 5, 7, 50, 40), (10, 2, 50, 80, 1000)])
def test_against_all_runs(spark, monkeypatch, least, most_words, top, inside, block):
    monkeypatch.setattr(phrases, "BLOCK", block)
    rows = some_rows()
    docs = spark.createDataFrame([(i, t, lang, "clash", 1) for i, (lang, t) in enumerate(rows)], DOCS).repartition(4)
    assert sorted(tuple(r) for r in phrases.collocations(docs, least, most_words, top, inside).collect()) == expected(rows, least, most_words, top, inside)


def test_whole_table(spark):
    rows = [(r.lang, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = phrases.op13_phrases(spark, "/root/testdata/sf0.01")
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == expected(rows, 30, 4, 2000, 80)


def test_large_counts(spark):
    """Products past 64 bits stay exact."""
    a = 9 * 10**14
    rows = spark.createDataFrame([(a, [a + 1, 3 * a], [a + 3, a + 4]), (a, [a], [a])], "a long, before array<long>, after array<long>")
    got = [tuple(r.c) for r in rows.select(phrases.weakest_cut().alias("c")).collect()]
    assert got == [(2_000_000 * a // (4 * a + 4), 1, 3 * a, a + 4), (1_000_000, 0, a, a)]


def test_empty(spark):
    assert phrases.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, "no word often", None, "", 1)], DOCS)).count() == 0
