"""Secret scans over a trigram inverted index (operator 2), built-in functions only.

Every rule is a regular expression. From its syntax tree follows a Boolean query over trigrams that any match must
contain; a rule from which none follows scans every text. The index has a posting for every text and every trigram
that some query asks for, on text with A-Z lower-cased. Queries intersect the postings of a text; rules run on their
candidates only, and what they find is joined with what the scanning rules found.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as op
from re import _parser as syntax

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlane.session import cut

_ANY_QUOTE = "[\"']?"
_NAMES = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
                  for w in ("password", "passwd", "secret", "token", "api_?key"))


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, and the group that must have at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base rules in their order, then the added ones.
BASE = (
    Rule("assign", rf"({_NAMES}){_ANY_QUOTE}\x20*[:=]\x20*{_ANY_QUOTE}([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", "[0-9a-f]{32,}", 0, 32),  # the runs [0-9a-f]+ of 32 characters or more
)
ADDED = (
    Rule("github", "gh[oprsu]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", "xox[abeprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", "AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + ADDED

# ------------------------------------------------------------ queries from patterns

#: A query: alternatives, each a set of trigrams that must all occur. An empty alternative is always true.
Query = frozenset[frozenset[str]]
_TRUE: Query = frozenset([frozenset()])
_MOST = 48


def _simplest(alternatives: set[frozenset[str]]) -> Query:
    """Without the alternatives that another one implies."""
    return frozenset(a for a in alternatives if not any(b < a for b in alternatives))


def _both(a: Query, b: Query) -> Query:
    found = _simplest({x | y for x in a for y in b})
    return found if len(found) <= _MOST else min(a, b, key=len)  # either is implied, so either may stand alone


def _needs(strings: frozenset[str]) -> Query:
    """What a text must contain that contains one of ``strings``."""
    return _simplest({frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings})


def _letters(items: list) -> frozenset[str] | None:
    """The lower-cased characters of a class, if they are few."""
    found: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            found.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < 8:
            found.update(chr(c).lower() for c in range(value[0], value[1] + 1))
        else:
            return None
    return frozenset(found) if len(found) <= 6 else None


def _strings(node) -> frozenset[str] | None:
    """All strings the node matches, lower-cased, if they are few and known."""
    kind, value = node
    if kind is op.LITERAL:
        return frozenset([chr(value).lower()])
    if kind is op.IN:
        return _letters(value)
    if kind is op.SUBPATTERN:
        return _sequence(value[-1])
    if kind is op.BRANCH:
        parts = [_sequence(b) for b in value[1]]
        return None if None in parts else frozenset().union(*parts)
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] in (0, 1) and value[1] == 1:
        inner = _sequence(value[2])
        return None if inner is None else inner | (frozenset([""]) if value[0] == 0 else frozenset())
    return None


def _sequence(nodes) -> frozenset[str] | None:
    strings = frozenset([""])
    for node in nodes:
        found = _strings(node)
        if found is None or len(strings) * len(found) > _MOST:
            return None
        strings = frozenset(a + b for a in strings for b in found)
    return strings


def _query(nodes) -> Query:
    """Runs of nodes whose strings are known give trigrams; what lies between them must hold too."""
    total, run = _TRUE, frozenset([""])
    for node in nodes:
        found = _strings(node)
        if found is not None and len(run) * len(found) <= _MOST:
            run = frozenset(a + b for a in run for b in found)
            continue
        total, run = _both(total, _needs(run)), frozenset([""])
        if found is not None:
            run = found
        else:
            kind, value = node
            inner = _TRUE
            if kind is op.SUBPATTERN:
                inner = _query(value[-1])
            elif kind is op.BRANCH:
                inner = _simplest(set().union(*[_query(b) for b in value[1]]))
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] >= 1:
                inner = _query(value[2])
            total = _both(total, inner)
    return _both(total, _needs(run))


def trigram_query(pattern: str) -> Query:
    """The trigrams that any match of ``pattern`` has, lower-cased; ``{{}}`` if none are certain."""
    found = _query(syntax.parse(pattern))
    return _TRUE if frozenset() in found else found


# ------------------------------------------------------------ spans


def spans(text: Column, rule: Rule) -> Column:
    """Start and end (code points, end exclusive) of the rule's matches, left to right, without the failing ones.

    The pieces between matches and the matches themselves have lengths; their running sums are the positions.
    """
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    between = F.split(text, rule.pattern, -1)
    core = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    steps = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), found.alias("hit"), core.alias("core"))
    empty = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def add(state: Column, step: Column) -> Column:
        begin = state["at"] + F.length(step["gap"])
        end = begin + F.length(step["hit"])
        span = F.struct(begin.alias("start"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(
            F.length(step["core"]) >= rule.least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    return F.when(F.size(found) > 0, F.aggregate(steps, start, add)["spans"]).otherwise(empty)


# ------------------------------------------------------------ the scan


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def postings(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The index: trigram, key for every text of ``texts`` (key, text) and every trigram that a query asks for."""
    wanted = sorted({t for r in rules for a in trigram_query(r.pattern) for t in a})
    if not wanted:
        return texts.select(F.lit("").alias("trigram"), "key").limit(0)
    low = texts.select("key", _lower(F.col("text")).alias("low"))
    present = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in wanted]))
    return low.select(F.explode(present).alias("trigram"), "key").distinct()


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """key and the kinds of the rules whose query the postings of the key satisfy; only keys that have some."""
    held = index.groupBy("key").agg(F.collect_set("trigram").alias("held"))  # at most the trigrams of all queries

    def true(query: Query) -> Column:
        ways = [F.forall(F.array(*[F.lit(t) for t in sorted(a)]), lambda t: F.array_contains("held", t))
                for a in sorted(query, key=sorted)]
        total = ways[0]
        for w in ways[1:]:
            total = total | w
        return total

    indexed = [(r.kind, trigram_query(r.pattern)) for r in rules if trigram_query(r.pattern) != _TRUE]
    kinds = F.array_compact(F.array(*[F.when(true(q), F.lit(k)) for k, q in indexed]))
    return held.select("key", kinds.alias("kinds")).where("size(kinds) > 0")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id`` and ``found`` (start, end, kind of every span) of every row of ``docs`` (doc_id, text).

    A null text is empty. Texts are told apart by a digest of id and text, so repeated rows find the same spans and
    need no key of their own.
    """
    body = F.coalesce("text", F.lit(""))
    key = F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), body).cast("binary"), 256)
    texts = docs.select("doc_id", body.alias("text"), F.unhex(key).alias("key"))
    wanted = cut(candidates(postings(texts, rules), rules))
    full = [r for r in rules if trigram_query(r.pattern) == _TRUE]
    indexed = [r for r in rules if trigram_query(r.pattern) != _TRUE]
    empty = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    scanned = F.concat(empty, *[spans(F.col("text"), r) for r in full])
    verified = F.concat(empty, *[
        F.when(F.array_contains("kinds", r.kind), spans(F.col("text"), r)).otherwise(empty) for r in indexed])
    everywhere = texts.select("doc_id", "key", scanned.alias("scanned"))
    some = texts.join(wanted, "key").select("key", verified.alias("verified")).where("size(verified) > 0").distinct()
    return everywhere.join(some, "key", "left").select(
        "doc_id", F.concat("scanned", F.coalesce("verified", empty)).alias("found"))


def joined(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of every span by start, then kind in the order of the rules, comma-joined."""
    place = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(
        s["start"].alias("start"), place[s["kind"]].alias("place"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    kinds = [r.kind for r in BASE]
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    base = joined(F.filter("found", lambda s: s["kind"].isin(kinds)), BASE)
    return scan(docs).select("doc_id", *[count(k).alias(f"n_{k}") for k in kinds],
                             F.sha2(base, 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
