"""Secret scans behind a trigram index. DataFrame functions only.

Each rule's regular expression is given with the literals that a match must hold.
Their trigrams form a Boolean query, a conjunction for each alternative; a rule
whose matches hold no fixed trigram (bare hexadecimal runs) has none and scans every
text. Postings (trigram, document) of the trigrams that some rule asks for are
gathered once, intersected per document, and only candidates are verified.

Offsets count code points; they are the lengths of what lies between and in the
matches.

Edge cases: a null text is empty and has no spans; an empty table gives an empty
result; rows that repeat a doc_id share the index's verdict on any of them, and
each is verified on its own text; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded, staged


@dataclass(frozen=True)
class Rule:
    """``least``: characters that ``group`` of a match needs. ``literals``: a match
    holds one of these, in either case; none: no index helps."""

    kind: str
    pattern: str
    literals: tuple[str, ...] = ()
    group: int = 0
    least: int = 0
    base: bool = False


# The kinds in their order, and their patterns. Quantifiers are
# possessive where nothing after them could match what they give back.
RULES = (
    Rule("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""", ("password", "passwd", "secret", "token", "api_key", "apikey"), 1, 6, True),
    Rule("access", r"AKIA[A-Z0-9]++", ("AKIA",), 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}+", (), 0, 24, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}+", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}+", ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-")),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", ("AIza",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", (".eyJ",)),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", ("PRIVATE KEY-----",)),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9._%+-]{1,64}:[^\x20\x09-\x0D/@]{3,64}@", ("://",)),
)


def trigrams(literal: str) -> list[str]:
    """The distinct lower-cased trigrams that every text with ``literal`` holds."""
    low = literal.lower()
    return sorted({low[i : i + 3] for i in range(len(low) - 2)})


def trigram_query(rule: Rule) -> list[list[str]]:
    """Alternatives, each a list of trigrams that must all be there; [] if some
    alternative holds none."""
    found = [trigrams(x) for x in rule.literals]
    return found if all(found) else []


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """(gram, doc_id) of the trigrams asked for; in either case, as in the query."""
    low = docs.select("doc_id", F.lower("text").alias("low"))
    found = F.filter(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams)), lambda g: g.isNotNull())
    return low.select("doc_id", F.explode(found).alias("gram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and, for each rule with a query, whether its trigrams allow a match."""
    has = lambda g: F.max(F.col("gram") == g)
    any_of = lambda parts: parts[0] if len(parts) == 1 else F.greatest(*parts)
    all_of = lambda parts: parts[0] if len(parts) == 1 else F.least(*parts)
    columns = [any_of([all_of([has(g) for g in alt]) for alt in q]).alias(f"may_{r.kind}") for r in rules if (q := trigram_query(r))]
    return index.groupBy("doc_id").agg(*columns)


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """array<struct<start, rank, end, kind>> of a rule's matches, in order."""
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else hits
    gaps = F.split(text, rule.pattern, -1)
    sizes = F.transform(F.arrays_zip(gaps.alias("g"), hits.alias("h"), value.alias("v")), lambda x: F.struct(F.length(x["g"]).alias("gap"), F.coalesce(F.length(x["h"]), F.lit(0)).alias("hit"), F.coalesce(F.length(x["v"]), F.lit(0)).alias("value")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start, end = acc["at"] + x["gap"], acc["at"] + x["gap"] + x["hit"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        keep = (x["hit"] > 0) & (x["value"] >= rule.least)
        return F.struct(end.alias("at"), F.when(keep, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(sizes, empty, step, lambda acc: acc["out"])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 300_000) -> DataFrame:
    """doc_id and spans, an array of (start, rank, end, kind) by start, then by the
    rules' order. Candidates are broadcast only up to ``broadcast_rows`` rows; beyond,
    texts are shuffled to them."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    grams = sorted({g for r in rules for alt in trigram_query(r) for g in alt})
    rows = base
    if grams:
        allowed = candidates(postings(base, grams), rules)
        allowed = staged(allowed.where(F.greatest(F.lit(False), *(F.col(c) for c in allowed.columns if c != "doc_id"))), "trigrams")
        rows = base.join(F.broadcast(allowed) if bounded(allowed, broadcast_rows) else allowed, "doc_id", "left")
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    found = []
    for rank, rule in enumerate(rules):
        if trigram_query(rule):
            # A row without an id meets no posting and is scanned whole.
            test = F.col("doc_id").isNull() | F.coalesce(F.col(f"may_{rule.kind}"), F.lit(False))
        else:
            test = F.regexp_like("text", F.lit(rule.pattern))
        found.append(F.when(test, spans_of(F.col("text"), rule, rank)).otherwise(none))
    return rows.select("doc_id", F.array_sort(F.concat(*found)).alias("spans"))


def op4_secrets(spark, sf_dir):
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = [i for i, r in enumerate(RULES) if r.base]
    own = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(own(RULES[i].kind) for i in base), F.sha2(joined(F.filter("spans", lambda s: s["rank"] <= max(base))), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
