"""Spelling variants against a comparison of all pairs."""

import collections
import random
import re
import zlib

from unravel.llm import spelling

DOCS = "doc_id long, text string, word string, n string"


def near_words(a, b):
    """Whether one inserted, deleted or replaced letter makes ``a`` of ``b``."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(rows, noise):
    """By all pairs of words of like length."""
    counts = collections.Counter()
    for i, text in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if noise and h % noise == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    by_length = collections.defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)
    found = {w: [x for k in (-1, 0, 1) for x in by_length[len(w) + k] if near_words(w, x)] for w in words}
    form = {}
    for w, xs in found.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(found[w]), words.get(form[w])))
    return sorted(out)


def rows_of(seed):
    rng = random.Random(seed)
    base = ["aaaaaaa", "bettering", "straße", "éèêëēaa", "abcabc", "letters", "lettters", "lettter", "ÀÉÎÕÜß", "a×b÷cdef"]
    often = {w: 400 // (k + 1) for k, w in enumerate(base)}
    for w in base:
        for _ in range(25):
            x = list(w)
            for _ in range(rng.randrange(1, 4)):
                at = rng.randrange(len(x))
                x[at : at + 1] = rng.choice(([], [rng.choice("abtéß")], [x[at], rng.choice("abtéß")]))
            often[("".join(x))] = rng.choice((3, 5, 6, 25, 30, 130))
    often |= {"xchainx": 5, "xchaiqx": 30, "xchaqqx": 200}
    words = [w.upper() if rng.random() < 0.1 and w.isascii() else w for w, n in often.items() for _ in range(n)]
    rng.shuffle(words)
    rows = [(k, rng.choice((" ", "-", "\n", "3")).join(words[k * 40 : k * 40 + 40])) for k in range(len(words) // 40 + 1)]
    return rows + [(None, "letters bettering"), (3, None), (3, ""), (4, "x" * 100_000 + " short"), rows[0], rows[0]]


def test_against_all_pairs(spark):
    for seed, noise in ((1, None), (2, 7)):
        rows = rows_of(seed)
        docs = spark.createDataFrame([(i, t, "clash", "x") for i, t in rows], DOCS).repartition(3)
        want = expected(rows, noise)
        assert sorted(tuple(r) for r in spelling.spelling_groups(docs, noise=noise).collect()) == want
        assert noise or ("xchainx", "xchaiqx", "xchaqqx", 5, 1, 30) in want


def test_whole_table(spark):
    """The query over whole documents, against the words of all texts."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = spelling.op12_spelling(spark, "/root/testdata/sf0.001")
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(tuple(r) for r in got.collect()) == expected(rows, 199)


def test_long_chain_and_empty(spark):
    forms = spark.createDataFrame([(f"w{k:03}", f"w{k + 1:03}") for k in range(100)], "word string, form string")
    assert {r.root for r in spelling.followed(forms).collect()} == {"w100"}
    assert spelling.spelling_groups(spark.createDataFrame([], DOCS)).count() == 0
