"""Secret scan over whole texts by a trigram inverted index, DataFrame operations only.

Each rule's regular expression yields a Boolean query: alternatives (clauses) of
trigrams that a matching text has to contain.  A first pass over the texts builds
the postings (trigram, document) of every trigram that some rule asks for;
joining them with the clauses and counting per document intersects the lists.
Only documents that satisfy a clause of a rule are verified with that rule's
expression; rules without a mandatory trigram (long hexadecimal runs) read all.

Defined results: a null or empty text has no spans; null and repeated document
ids are kept row by row (postings of equal ids are united, which only adds
candidates); an empty table gives no rows; columns of any other name pass
through.  Positions count code points, ends are exclusive.
"""

from __future__ import annotations

from re import _constants as node, _parser as parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from busweave.session import fixed_rows, settle


class Rule(NamedTuple):
    """A kind of secret; ``least`` is the length that ``group`` needs at least."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The three base kinds in the order of their names in results.
BASE_RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
RULES = BASE_RULES + (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)

_MOST_STRINGS = 64
_CHUNK = 256


def _strings(items) -> set[str] | None:
    """All lower-case strings that a pattern part can match, or None when too many."""
    found = {""}
    for op, value in items:
        if op is node.LITERAL:
            part = {chr(value).lower()}
        elif op is node.IN and all(kind is node.LITERAL for kind, _ in value):
            part = {chr(code).lower() for _, code in value}
        elif op is node.SUBPATTERN:
            part = _strings(value[3])
        elif op is node.BRANCH:
            options = [_strings(option) for option in value[1]]
            part = None if None in options else set().union(*options)
        elif op is node.MAX_REPEAT and value[1] == 1:
            part = _strings(value[2])
            part = part if part is None or value[0] else part | {""}
        elif op is node.MAX_REPEAT and value[0] == value[1] and value[0] <= 8:
            part = _strings(list(value[2]) * value[0])
        else:
            part = None
        if part is None or len(found) * len(part) > _MOST_STRINGS:
            return None
        found = {a + b for a in found for b in part}
    return found


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Clauses of trigrams, one of which every match contains; empty: scan fully."""
    best: list[frozenset[str]] = []
    run: list = []
    for item in [*parser.parse(pattern), None]:
        if item is not None and _strings([*run, item]) is not None:
            run.append(item)
            continue
        clauses = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in _strings(run)}
        clauses = [c for c in clauses if not any(other < c for other in clauses)]
        if all(clauses) and (not best or min(map(len, clauses)) > min(map(len, best))):
            best = clauses
        run = [] if item is None or _strings([item]) is None else [item]
    return sorted(best, key=sorted)


def _clause_rows(rules) -> list[tuple]:
    rows = []
    for rule in rules:
        for n, clause in enumerate(trigram_query(rule.pattern)):
            for bit, trigram in enumerate(sorted(clause)[:60]):
                rows.append((rule.kind, n, trigram, 1 << bit, min(len(clause), 60)))
    return rows


def candidates(docs: DataFrame, rules=RULES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_key, rules): the documents that satisfy a rule's trigram query."""
    rows = _clause_rows(rules)
    clauses = fixed_rows(
        docs.sparkSession, "rule string, clause int, trigram string, bit bigint, needed int", rows
    )
    vocabulary = sorted({row[2] for row in rows})
    folded = docs.select(F.col(key).alias("doc_key"), F.lower(text).alias("folded"))
    postings = folded.select(
        "doc_key",
        F.explode(
            F.array_compact(F.array(*[F.when(F.contains("folded", F.lit(t)), t) for t in vocabulary]))
        ).alias("trigram"),
    )
    met = (
        postings.join(clauses, "trigram")
        .groupBy("doc_key", "rule", "clause", "needed")
        .agg(F.bit_or("bit").alias("seen"))
        .filter(F.bit_count("seen") == F.col("needed"))
    )
    return met.groupBy("doc_key").agg(F.collect_set("rule").alias("rules"))


def _running_sum(steps: Column) -> Column:
    """Prefix sums of an array; full chunks are set aside, so long arrays stay cheap.

    All inputs of the lambdas come in as arguments: a lambda evaluates whatever
    else stands in it once per element.
    """
    acc = F.struct(
        F.lit(0).alias("total"),
        F.array().cast("array<int>").alias("part"),
        F.array().cast("array<array<int>>").alias("done"),
    )

    def step(acc, x):
        total = acc["total"] + x
        part = F.concat(acc["part"], F.array(total))
        full = F.size(acc["part"]) >= _CHUNK
        return F.struct(
            total.alias("total"),
            F.when(full, F.array(total)).otherwise(part).alias("part"),
            F.when(full, F.concat(acc["done"], F.array(acc["part"])))
            .otherwise(acc["done"]).alias("done"),
        )

    return F.aggregate(
        steps, acc, step, lambda a: F.flatten(F.concat(a["done"], F.array(a["part"])))
    )


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """Leftmost non-overlapping matches of a rule as (start, ord, kind, stop).

    The pieces between matches and the matches themselves alternate, so running
    sums of their lengths are the positions.
    """
    whole, wanted = (
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(g)) for g in (0, rule.group)
    )
    steps = F.zip_with(
        F.split(text, rule.pattern, -1),
        F.concat(F.array(F.lit("")), whole),
        lambda gap, hit: F.length(gap) + F.length(hit),
    )
    spans = F.arrays_zip(_running_sum(steps).alias("s"), whole.alias("w"), wanted.alias("v"))
    return F.transform(
        F.filter(spans, lambda m: F.length(m["v"]) >= rule.least),
        lambda m: F.struct(
            m["s"].alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"),
            (m["s"] + F.length(m["w"])).alias("stop"),
        ),
    )


def scan_secrets(
    docs: DataFrame, rules=RULES, text: str = "text", key: str = "doc_id", out: str = "secret_spans"
) -> DataFrame:
    """Rows of ``docs`` with ``out``: all spans by start, then by the order of rules.

    The candidate list is written first, so Spark knows its size and broadcasts
    it only when it is small; otherwise both sides are shuffled by document.
    """
    found = settle(candidates(docs, rules, text, key), "secret-candidates")
    found = found.select(F.col("doc_key").alias("__key"), F.col("rules").alias("__rules"))
    joined = docs.join(found, F.col(key).eqNullSafe(F.col("__key")), "left")
    body = F.coalesce(F.col(text), F.lit(""))
    parts = []
    for order, rule in enumerate(rules):
        chosen = (
            F.array_contains("__rules", rule.kind)
            if trigram_query(rule.pattern)
            else body.rlike(rule.pattern)
        )
        parts.append(F.when(chosen, rule_spans(body, rule, order)))
    none = F.array().cast("array<struct<start:int,ord:int,kind:string,stop:int>>")
    spans = F.array_sort(F.concat(*[F.coalesce(part, none) for part in parts]))
    return joined.withColumn(out, spans).drop("__key", "__rules")


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ","
    )


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones united, replaced by ``mark``."""
    pair = lambda a, b: F.struct(a.alias("start"), b.alias("stop"))
    none = F.array().cast("array<struct<start:int,stop:int>>")
    united = F.aggregate(
        spans, none,
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s["start"] <= F.element_at(acc, -1)["stop"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(pair(
                    F.element_at(acc, -1)["start"],
                    F.greatest(F.element_at(acc, -1)["stop"], s["stop"]),
                )),
            ),
        ).otherwise(F.concat(acc, F.array(pair(s["start"], s["stop"])))),
    )
    edges = F.zip_with(
        F.concat(F.array(F.lit(0)), F.transform(united, lambda s: s["stop"])),
        F.concat(F.transform(united, lambda s: s["start"]), F.array(F.length(text))),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )
    pieces = F.transform(edges, lambda e: F.substring(text, e["a"] + 1, e["b"] - e["a"]))
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(pieces, mark))


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of the secrets in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    spans = F.col("secret_spans")
    base = F.filter(spans, lambda s: s["ord"] < len(BASE_RULES))
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return scan_secrets(docs).select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(spans).alias("spans"),
    )


QUERIES = {"op9_secret_scan": op9_secret_scan}
