"""Secret scans through a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over lower-case
trigrams (an OR of ANDs) that every text with a match satisfies. The index
holds, for the trigrams that occur in those queries, the ids of the texts that
have them. Postings are intersected for each clause; only texts that satisfy a
clause of a rule are verified against its expression. Rules without mandatory
trigrams (a run of hex digits) are verified on every text.

All steps are DataFrame functions. Postings are gathered by text id and clause,
as bits and before they are shuffled, so that neither a common trigram nor an id
that many rows share (null, say) gathers more than one row a task. Candidates
are pairs of numbers, a hash of the id and the bits of its rules; as long as
there are at most ``MAX_BROADCAST_ROWS`` of them they are broadcast, and no text
is shuffled. Beyond that texts and candidates meet by a join on the hash, in
which AQE splits an id that many rows share.

Positions are code points, ends exclusive. A rule's matches are the leftmost
non-overlapping ones of its expression; those whose value is too short are
dropped afterwards and still use up their text.

Defined cases: null text counts as empty and has no spans; repeated rows and
repeated ids are each scanned whole (candidates of an id hold for all its rows);
a null id is an id like another; an empty table gives an empty result; columns
of the input that clash with helper names are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product
from re import _constants as sre
from re import _parser as sre_parse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, literal_rows, text_of, with_out

# Bounds on the sets of strings and clauses that a query is derived through. Beyond
# them a query gets weaker (more candidates), never wrong.
MAX_STRINGS = 64
MAX_CLASS = 6
MAX_CLAUSES = 64
#: Candidates (two numbers each) that may be broadcast.
MAX_BROADCAST_ROWS = 1_000_000
#: Bits in a number that stands for a set; larger sets share bits, which gives more candidates, not fewer.
BITS = 62


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: The group whose length counts, and the least length that it may have.
    group: int = 0
    least: int = 1


#: The kinds that results must have, in their order.
BASE_RULES = (
    Rule("assign", "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]{24,}"),
)
#: Kinds added to them: published token formats.
RULES = (
    *BASE_RULES,
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", "[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{10,}\\.eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", "-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
)

# A query is None (every text may match) or a set of clauses, each a set of trigrams.
Query = frozenset | None


def _all_of(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    both = frozenset(x | y for x, y in product(a, b))
    return both if len(both) <= MAX_CLAUSES else min(a, b, key=len)


def _any_of(queries: Sequence[Query]) -> Query:
    if any(q is None for q in queries):
        return None
    out = frozenset().union(*queries)
    return out if len(out) <= MAX_CLAUSES else None


def _of_strings(strings) -> Query:
    if any(len(s) < 3 for s in strings):
        return None
    return frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _class(items) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            out.add(chr(arg).lower())
        elif op is sre.RANGE and arg[1] - arg[0] < MAX_CLASS:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= MAX_CLASS else None


def _step(op, arg) -> tuple[set[str] | None, Query]:
    """Of one item: all strings that it matches in lower case, if they are few; else a query that its matches satisfy."""
    if op is sre.LITERAL:
        return {chr(arg).lower()}, None
    if op is sre.IN:
        return _class(arg), None
    if op is sre.AT:
        return {""}, None
    if op is sre.SUBPATTERN:
        return _walk(arg[-1])
    if op is sre.BRANCH:
        parts = [_walk(x) for x in arg[1]]
        if all(s is not None for s, _ in parts) and len(every := set().union(*(s for s, _ in parts))) <= MAX_STRINGS:
            return every, None
        return None, _any_of([_of_strings(s) if s is not None else q for s, q in parts])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        low, high, sub = arg
        strings, query = _walk(sub)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, None
        if low == 0:
            return None, None
        if low == high and strings is not None and len(strings) ** low <= MAX_STRINGS:
            return {"".join(x) for x in product(strings, repeat=low)}, None
        return None, _of_strings(strings) if strings is not None else query
    return None, None


def _walk(items) -> tuple[set[str] | None, Query]:
    run, query, whole = {""}, None, True
    for op, arg in items:
        strings, of_item = _step(op, arg)
        if strings is not None and len(strings) * len(run) <= MAX_STRINGS:
            run = {a + b for a, b in product(run, strings)}
            continue
        query, whole = _all_of(query, _of_strings(run)), False
        if strings is None:
            query, run = _all_of(query, of_item), {""}
        else:
            run = strings
    return (run, None) if whole else (None, _all_of(query, _of_strings(run)))


def trigram_query(pattern: str) -> Query:
    """Clauses of lower-case trigrams; a text that matches ``pattern`` has all trigrams of at least one. None: no trigram is mandatory."""
    strings, query = _walk(sre_parse.parse(pattern))
    query = _of_strings(strings) if strings is not None else query
    return query and frozenset(c for c in query if not any(other < c for other in query))  # a clause that holds another adds nothing


def postings(docs: DataFrame, trigrams: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index over the given trigrams: rows (trigram, id_col), one for each trigram that a row's text has in either case."""
    (low,) = fresh(docs, "low")
    there = docs.select(F.col(id_col), F.lower(text_of(text_col)).alias(low))
    found = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in trigrams)))
    return there.select(F.explode_outer(found).alias("trigram"), F.col(id_col)).where("trigram is not null")


def _bit(number: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(number, F.lit(BITS)).cast("int"))


def candidates(docs: DataFrame, rules: Sequence[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame | None:
    """Rows (key, rules): for the hash of each id that satisfies a clause of some indexed rule, the bits of those rules. None if no rule is indexed."""
    clauses = [(n, sorted(c)) for n, r in enumerate(rules) for c in sorted(map(sorted, trigram_query(r.pattern) or ()))]
    if not clauses:
        return None
    # a clause's trigrams by their places in it; its full set of bits is what an id must have
    rows = [(n, k, sum(1 << i for i in {i % BITS for i in range(len(c))}), i, t) for k, (n, c) in enumerate(clauses) for i, t in enumerate(c)]
    wanted = literal_rows(docs.sparkSession, "rule int, clause int, full bigint, place int, trigram string", rows)
    index = postings(docs, sorted({t for *_, t in rows}), id_col, text_col).select(F.xxhash64(F.col(id_col)).alias("key"), "trigram")
    found = index.join(F.broadcast(wanted), "trigram").groupBy("key", "clause", "rule", "full").agg(F.bit_or(_bit(F.col("place"))).alias("has"))
    return found.where("has = full").groupBy("key").agg(F.bit_or(_bit(F.col("rule"))).alias("rules"))


def rule_spans(text: Column, rule: Rule, number: int) -> Column:
    """Array of (start, rule number, end, kind) of a rule's matches that are long enough."""
    whole, value = (F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(g)) for g in (0, rule.group))
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda g: F.length(g))
    sizes = F.zip_with(whole, value, lambda w, v: F.struct(F.length(w).alias("size"), F.length(v).alias("of_value")))
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(whole)), sizes, lambda g, s: F.struct(g.alias("gap"), s["size"].alias("size"), s["of_value"].alias("of_value")))
    span = lambda start, end: F.struct(start.alias("start"), F.lit(number).alias("rule"), end.alias("end"), F.lit(rule.kind).alias("kind"))
    none = F.array().cast("array<struct<start:int,rule:int,end:int,kind:string>>")
    zero = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def add(state, x):
        start = state["at"] + x["gap"]
        end = start + x["size"]
        more = F.when(x["of_value"] >= rule.least, F.concat(state["spans"], F.array(span(start, end)))).otherwise(state["spans"])
        return F.struct(end.alias("at"), more.alias("spans"))

    return F.when(F.rlike(text, F.lit(rule.pattern)), F.aggregate(steps, zero, add, lambda s: s["spans"])).otherwise(none)


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text", out: str = "spans") -> DataFrame:
    """The rows and columns of ``docs`` with ``out``: array of struct (start, rule, end, kind), by start, then by the rules' order."""
    for r in rules:
        re.compile(r.pattern)
    found = candidates(docs, rules, id_col, text_col)
    cand, key, text, *each = fresh(docs, "cand", "key", "text", *(f"rule{n}_" for n in range(len(rules))))
    df = docs
    if found is not None:
        found = cut(found.select(F.col("key").alias(key), F.col("rules").alias(cand)))
        few = found.count() <= MAX_BROADCAST_ROWS
        df = docs.withColumn(key, F.xxhash64(F.col(id_col))).join(F.broadcast(found) if few else found.hint("merge"), key, "left")
    df = df.withColumn(text, text_of(text_col))
    none = F.array().cast("array<struct<start:int,rule:int,end:int,kind:string>>")
    spans = {}
    for n, rule in enumerate(rules):
        full = trigram_query(rule.pattern) is None
        verified = rule_spans(F.col(text), rule, n)
        spans[each[n]] = verified if full else F.when(F.coalesce(F.col(cand), F.lit(0)).bitwiseAND(1 << n % BITS) != 0, verified).otherwise(none)
    df = df.withColumns(spans)
    return df.withColumn(out, F.sort_array(F.concat(*each))).select(*with_out(docs, out))


def redact(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each stretch of text under one or more spans replaced by ``mark``. Texts without spans, null ones too, stay as they are."""
    (spans,) = fresh(docs, "spans")
    df = scan(docs, rules, id_col, text_col, spans)
    text = F.col(text_col)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(state, x):
        apart = x["start"] >= state["at"]
        before = F.substring(text, state["at"] + 1, x["start"] - state["at"])
        parts = F.when(apart, F.concat(state["parts"], F.array(before, F.lit(mark)))).otherwise(state["parts"])
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), parts.alias("parts"))

    clean = F.aggregate(spans, zero, add, lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, s["at"] + 1, F.length(text))))
    return df.withColumn(text_col, F.when(F.size(spans) > 0, clean).otherwise(text)).select(*docs.columns)
