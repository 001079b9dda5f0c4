"""Personal data by weak supervision. DataFrame functions only.

Four base kinds are found by rule and always stay: email, ip, card, phone. Looser
candidates of further kinds are voted on by labelers, each saying yes, no or
nothing: shape rules (regular expressions), gazetteers, and context before the span.
Expectation-maximisation over the table of vote patterns estimates each kind's share
and each labeler's reliability without labels. A logistic classifier over the votes
and the span's surroundings is then trained on the posteriors, and candidates that
it gives at least ``least`` are added.

Vote patterns and feature patterns are counted by the engine over all candidates;
what the driver fits on is one row a pattern, at most PATTERNS of them by
construction, whatever the input. Patterns are scored by an expression, in place.

Edge cases: a null text is empty and has no spans; an empty table, or one without
candidates, adds nothing; repeated rows are scanned one by one; other columns are
ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import staged

#: Characters before a span that context labelers read.
BEFORE = 40
# Base kinds in their order and their patterns. The look-behinds and
# possessive quantifiers find the same matches in linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


@dataclass(frozen=True)
class Kind:
    """A further kind. ``shape`` and ``odd``: patterns of the span's text that speak
    for and against it; ``gazetteer``, ``cues`` and ``against``: of what is before."""

    name: str
    pattern: str
    shape: str
    odd: str
    gazetteer: str
    cues: str
    against: str


# Patterns and word lists of the further kinds.
KINDS = (
    Kind("local_phone", r"(?:\([0-9]{3}\)\x20?|(?<![0-9])[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])", r"^\(?[2-9][0-9]{2}\)?.?[2-9]", r"([0-9])\1\1[.-]?\1|123.?456", r"(?i)\b(?:tel|phone|fax|mobile|cell|telefon|handy|teléfono|móvil|téléphone|portable)\b", r"(?i)\b(?:call|ring|reach|contact|dial|text|anrufen|llamar|appeler)\b", r"(?i)\b(?:version|order|invoice|isbn|part|item|figure|page)\b"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)", r"^(?:000|666|9)|-00-|-0000$|123-45-6789", r"(?i)\b(?:ssn|social|security)\b", r"(?i)\b(?:number|taxpayer|identification|born)\b", r"(?i)\b(?:version|order|invoice|isbn|part|item|case)\b"),
    Kind("iban", r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Z0-9])", r"^(?:AT|BE|CH|DE|ES|FR|GB|IE|IT|LU|NL|PL|PT)", r"(.)\1{7}", r"(?i)\b(?:iban|bic|swift)\b", r"(?i)\b(?:account|bank|konto|cuenta|compte|transfer)\b", r"(?i)\b(?:key|token|serial|licen[cs]e|hash)\b"),
    Kind("person", r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Monsieur|Madame)\.?\x20[A-ZÀ-Ý][a-zà-ÿ]+(?:\x20[A-ZÀ-Ý][a-zà-ÿ]+)?", r"\x20[A-ZÀ-Ý][a-zà-ÿ]+\x20[A-ZÀ-Ý][a-zà-ÿ]+$", r"\x20(?:The|This|That|Der|Die|Das|El|La|Le)$", r"(?i)\b(?:dear|name|signed|sincerely|liebe|querid[oa]|cher)\b", r"(?i)\b(?:said|told|by|with|from|contact|von|por|par)\b", r"(?i)\b(?:street|avenue|inc|ltd|gmbh)\b"),
)
LABELERS = ("shape", "odd", "gazetteer", "cues", "against", "joined")
#: Votes of six labelers (two, two, two, two, two, two values) by kind.
PATTERNS = len(KINDS) * 2 ** len(LABELERS) * 4 * 4
SPAN = "array<struct<rank:int,start:int,end:int,kind:string,hit:string,before:string,after:string>>"


def spans_of(text: str, kind: str, pattern: str, rank: int, test) -> Column:
    """All matches of ``pattern`` whose text passes ``test``, with what is around
    them. Offsets in code points. ``{kind}_hits`` are the matches."""
    hits = F.col(f"{kind}_hits")
    gaps = F.split(text, pattern, -1)
    empty = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        end = start + F.length(x["h"])
        span = F.struct(F.lit(rank).alias("rank"), start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x["h"].alias("hit"), F.substring(x["g"], -BEFORE, BEFORE).alias("before"), F.substring(x["n"], 1, 1).alias("after"))
        return F.struct(end.alias("at"), (acc["i"] + 1).alias("i"), F.when(test(x["h"]), F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    rows = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("g"), hits.alias("h"), F.slice(gaps, 2, F.size(hits)).alias("n"))
    return F.when(F.size(hits) > 0, F.aggregate(rows, empty, step, lambda acc: acc["out"])).otherwise(F.array().cast(SPAN))


def base_tests() -> dict:
    digits = lambda h: F.regexp_replace(h, "[^0-9]", "")
    part = lambda p: F.ltrim(p, F.lit("0"))
    small = lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255)
    return {
        "email": lambda h: F.lit(True),
        "ip": lambda h: F.forall(F.split(h, "[.]"), small),
        "card": lambda h: F.length(digits(h)).between(13, 19) & F.call_function("luhn_check", digits(h)),
        "phone": lambda h: F.length(digits(h)).between(9, 15),
    }


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, base (spans), candidates (spans of further kinds outside of them)."""
    text = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    patterns = BASE | {k.name: k.pattern for k in KINDS}
    needs = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+"))}
    none = F.array().cast("array<string>")
    hits = text.select("*", *(F.when(needs.get(k, F.lit(True)), F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none).alias(f"{k}_hits") for k, p in patterns.items()))
    tests = base_tests()
    base = F.concat(*(spans_of("text", k, p, i, tests[k]) for i, (k, p) in enumerate(BASE.items())))
    more = F.concat(*(spans_of("text", k.name, k.pattern, len(BASE) + i, lambda h: F.lit(True)) for i, k in enumerate(KINDS)))
    out = hits.select("doc_id", base.alias("base"), more.alias("more"))
    apart = F.filter("more", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return out.select("doc_id", F.transform("base", lambda b: F.struct(b["rank"].alias("rank"), b["start"].alias("start"), b["end"].alias("end"), b["kind"].alias("kind"))).alias("base"), apart.alias("candidates"))


def votes(span: Column) -> dict[str, Column]:
    """1 for, -1 against, 0 nothing, of each labeler."""
    by_kind = lambda value: F.coalesce(*(F.when(span["kind"] == k.name, value(k)) for k in KINDS))
    yes = lambda test: F.when(test, 1).otherwise(0)
    no = lambda test: F.when(test, -1).otherwise(0)
    return {
        "shape": by_kind(lambda k: yes(F.regexp_like(span["hit"], F.lit(k.shape)))),
        "odd": by_kind(lambda k: no(F.regexp_like(span["hit"], F.lit(k.odd)))),
        "gazetteer": by_kind(lambda k: yes(F.regexp_like(span["before"], F.lit(k.gazetteer)))),
        "cues": by_kind(lambda k: yes(F.regexp_like(span["before"], F.lit(k.cues)))),
        "against": by_kind(lambda k: no(F.regexp_like(span["before"], F.lit(k.against)))),
        "joined": no(F.regexp_like(span["before"], F.lit(r"[\p{L}0-9./_=-]$")) | F.regexp_like(span["after"], F.lit(r"^[\p{L}0-9/_=-]"))),
    }


def surroundings(span: Column) -> dict[str, Column]:
    """0 edge, 1 white space, 2 punctuation, 3 other, of the characters around."""
    sort = lambda c: F.when(c == "", 0).when(F.regexp_like(c, F.lit(r"\s")), 1).when(F.regexp_like(c, F.lit(r"\p{P}")), 2).otherwise(3)
    return {"left": sort(F.substring(span["before"], -1, 1)), "right": sort(span["after"])}


@dataclass
class Reliability:
    """Shares of true spans by kind; by labeler, how often it votes on a true span and
    on a false one."""

    share: dict[str, float]
    votes: dict[str, tuple[float, float]]


def posterior(kind: str, vote: dict[str, int], r: Reliability) -> float:
    z = math.log(r.share[kind] / (1 - r.share[kind]))
    for j, (on_true, on_false) in r.votes.items():
        z += math.log(on_true / on_false) if vote[j] else math.log((1 - on_true) / (1 - on_false))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def reliabilities(patterns: list[tuple[str, dict[str, int], float]], rounds: int = 50, weight: float = 8.0) -> Reliability:
    """EM over (kind, votes, count), from labelers that are right more often than not;
    ``weight`` spans' worth of that start stays in every estimate. A labeler that
    speaks against spans (odd, against, joined) votes more on false ones."""
    against = {"odd", "against", "joined"}
    start = {j: (0.2, 0.6) if j in against else (0.6, 0.2) for j in LABELERS}
    r = Reliability({k.name: 0.5 for k in KINDS}, start)
    for _ in range(rounds):
        mass, yes = dict.fromkeys(r.share, weight), dict.fromkeys(r.share, weight / 2)
        true = false = weight
        on = {j: [weight * a, weight * b] for j, (a, b) in start.items()}
        for kind, vote, n in patterns:
            p = posterior(kind, vote, r)
            mass[kind] += n
            yes[kind] += n * p
            true += n * p
            false += n * (1 - p)
            for j, v in vote.items():
                if v:
                    on[j][0] += n * p
                    on[j][1] += n * (1 - p)
        clip = lambda x: min(max(x, 0.01), 0.99)
        r = Reliability({k: clip(yes[k] / mass[k]) for k in mass}, {j: (clip(a / true), clip(b / false)) for j, (a, b) in on.items()})
    return r


def feature_names() -> list[str]:
    return ["bias", *(f"kind_{k.name}" for k in KINDS), *(f"vote_{j}" for j in LABELERS), *(f"{s}_{v}" for s in ("left", "right") for v in range(4))]


def train_classifier(rows: list[tuple[dict[str, float], float, float]], penalty: float = 0.1, rounds: int = 30) -> dict[str, float]:
    """Logistic weights from (features, posterior, count) by Newton's method."""
    names = feature_names()
    if not rows:
        return dict.fromkeys(names, 0.0) | {"bias": -30.0}
    x = np.array([[f.get(n, 0.0) for n in names] for f, _, _ in rows])
    t, n = np.array([r[1] for r in rows]), np.array([r[2] for r in rows], dtype=np.float64)
    w = np.zeros(len(names))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (n * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(names))
        step = np.linalg.solve(h, x.T @ (n * (p - t)) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return dict(zip(names, w.tolist(), strict=True))


def probability(span: Column, weights: dict[str, float]) -> Column:
    z = F.lit(weights["bias"])
    for k in KINDS:
        z = z + F.when(span["kind"] == k.name, F.lit(weights[f"kind_{k.name}"])).otherwise(F.lit(0.0))
    for j, v in votes(span).items():
        z = z + v * F.lit(weights[f"vote_{j}"])
    for s, v in surroundings(span).items():
        z = z + F.element_at(F.array(*(F.lit(weights[f"{s}_{i}"]) for i in range(4))), v + 1)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """doc_id and spans, an array of (rank, start, end, kind) by kind, then start."""
    rows = staged(scan(docs, id_col, text_col), "pii")
    spans = rows.select(F.explode("candidates").alias("span"))
    span = F.col("span")
    pattern = [span["kind"].alias("kind"), *(v.alias(j) for j, v in votes(span).items()), *(v.alias(s) for s, v in surroundings(span).items())]
    counted = spans.select(*pattern).groupBy("kind", *LABELERS, "left", "right").agg(F.count(F.lit(1)).alias("n")).collect()  # at most PATTERNS rows
    known = [(c.kind, {j: c[j] for j in LABELERS}, float(c.n)) for c in counted]
    r = reliabilities(sorted(known, key=lambda x: (x[0], sorted(x[1].items()), x[2])))
    training = [({"bias": 1.0, f"kind_{c.kind}": 1.0, f"left_{c.left}": 1.0, f"right_{c.right}": 1.0} | {f"vote_{j}": float(c[j]) for j in LABELERS}, posterior(c.kind, {j: c[j] for j in LABELERS}, r), float(c.n)) for c in sorted(counted)]
    weights = train_classifier(training)
    added = F.filter("candidates", lambda s: probability(s, weights) >= least)
    plain = F.transform(added, lambda s: F.struct(s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return rows.select("doc_id", F.array_sort(F.concat("base", plain)).alias("spans"))


def op7_pii(spark, sf_dir):
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    own = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(own(k) for k in BASE), F.sha2(joined(F.filter("spans", lambda s: s["rank"] < len(BASE))), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
