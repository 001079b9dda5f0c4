"""Base spans of secrets and personal data against Python's regular expressions."""

import hashlib
import random
import re

import pytest

from unravel.llm import pii, secrets

ASSIGN = re.compile(r"""(?a:((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", re.ASCII)
DIGITS = re.compile("[0-9]")


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def secret_spans(text):
    out = [("assign", m) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    rank = ["assign", "access", "hex"].index
    return sorted(((k, m.start(), m.end()) for k, m in out), key=lambda s: (s[1], rank(s[0])))


def personal_spans(text):
    tests = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda h, d: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda h, d: all(int(p) <= 255 for p in h.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda h, d: 13 <= len(d) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda h, d: 9 <= len(d) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, ok) in tests.items() for m in re.finditer(p, text) if ok(m[0], DIGITS.findall(m[0]))]


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def made_texts():
    """Pieces of the patterns, run together in any order."""
    rng = random.Random(8)
    parts = ["password", "PassWd", "token", "api_KEY", "apikey", "ſecret", "secret", " ", "  ", ":", "=", '"', "'", "abc123", "short", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "é", "日", "\n", "+", "-", ".", "@", "a.b", "example.com", "10", "255", "256", "4111 1111 1111 1111", "4111-1111", "+1 (212) 555-0187", "(", ")", "00", "7", "%", "x" * 50, "1." * 8, "a@b" * 3]
    texts = [None, ""] + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    return texts + ["1 " * 3000, "token=abcdef " * 500, "a@b.c " * 1500, "9" * 30_000, "deadbeef" * 4000]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("made"))
    spark.createDataFrame(list(enumerate(made_texts())), "doc_id long, text string").repartition(4).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("query,spans,kinds", [(secrets.op4_secrets, secret_spans, ("assign", "access", "hex")), (pii.op7_pii, personal_spans, ("email", "ip", "card", "phone"))])
def test_base_spans(spark, folder, query, spans, kinds):
    for path in (folder, "/root/testdata/sf0.001"):
        texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
        got = query(spark, path).collect()
        assert len(got) == len(texts)
        for r in got:
            want = spans(texts[r.doc_id])
            assert [r[f"n_{k}"] for k in kinds] == [sum(s[0] == k for s in want) for k in kinds], texts[r.doc_id][:300]
            assert r.base_sha256 == digest(want), texts[r.doc_id][:300]
            assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(","))  # base spans stay
