"""Main text of web pages by a maximum-scoring subsequence (operator 5).

A page is a sequence of words and tags. Words score positive and tags negative, each by how much more often it stands
inside the main text of labelled pages than outside; one linear scan finds the contiguous stretch of the highest sum.
Words and tags are weighed apart where they stand in an article or main element, beside one, or on a page without any.
Tags and the tokens of class, id and role also have a weight for the words below them; an element whose words come out
negative by it (menus, forms, adverts, reader comments and the like) is passed over as if it were one tag. Tokens that
no labelled page has start from a prior.
Labelled pages are those of whose longest blocks one is also a line of a document; its lines are their main text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages the weights are learnt from at most, drawn by the hash of their ids.
SAMPLE = 2000
#: Blocks of a page that are looked up among the documents' lines, and the characters they have at least.
LONGEST, LEAST_CHARS = 3, 40
# Fixed values of the markup language: elements that begin a block, that have no end tag, and whose content is not text;
# elements whose start ends an open element, up to a bound; elements that end an open paragraph.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary "
    "table tbody td textarea tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|iframe|textarea|title|object|canvas"
CELLS = frozenset(("td", "th"))
ROWS = CELLS | {"tr"}
ENDED_BY = {"li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "option": frozenset(("option",)),
            "td": CELLS, "th": CELLS, "tr": ROWS, "body": frozenset(("head",)),
            **dict.fromkeys(("thead", "tbody", "tfoot"), ROWS | {"thead", "tbody", "tfoot"})}
BOUNDS = frozenset("article aside dl main menu nav ol section select table ul html".split())
ENDS_PARAGRAPH = BLOCKS - frozenset("button caption body head html option legend tbody td tfoot th thead title tr".split())
PARAGRAPH_BOUNDS = frozenset("button caption table td th html".split())
MAIN = frozenset(("article", "main"))

#: Used where there are no labelled pages, and for tags that none of them has: words, tags of running text and tags in
#: an article, others, and the words below an element that has one of the names to be passed over.
WORD_WEIGHT, INLINE_WEIGHT, TAG_WEIGHT, BELOW_WEIGHT = 1.0, -0.1, -3.0, -3.0
INLINE = frozenset("p br b i em strong u s q a abbr cite code span small sub sup mark h1 h2 h3 h4 h5 h6 blockquote pre img wbr".split())
#: Names with that prior: tags, and tokens of class, id and role; the latter also as the last part of a compound, or
#: as its first part before a word for a container.
PRIOR_TAGS = frozenset("nav header footer aside form button select menu dialog head".split())
PRIOR_NAMES = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie "
    "cookies disqus footer header masthead menu nav navbar navigation newsletter notice notices popup promo promoted "
    "related respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
CONTAINERS = frozenset("area bar block body box buttons container content form inner item items links list section text wrap wrapper".split())
#: A compound that begins so says what an element has, not what it is.
_ABOUT = frozenset("has with no not is without".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?:svg|math)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*/>"
    rf"|<(?P<raw>{RAW}|svg|math)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>"
    r"|</?[a-z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")


@dataclass(slots=True)
class Event:
    """A tag or, without a name, a stretch of text. ``place`` is '+' in an article or main element, '-' beside one on a
    page that has one, and else ''. A start tag has its tokens and the event before which its element ends."""

    name: str
    text: str
    block: int
    place: str
    tokens: tuple[str, ...] = ()
    end: int = 0


def prior(token: str) -> float:
    """The weight of the words below an element with a token that no labelled page has."""
    if token in PRIOR_TAGS or token in PRIOR_NAMES:
        return BELOW_WEIGHT
    parts = [p for p in _SPLIT.split(token) if p]
    if len(parts) < 2 or parts[0] in _ABOUT:
        return 0.0
    return BELOW_WEIGHT if parts[-1] in PRIOR_NAMES or parts[0] in PRIOR_NAMES and parts[-1] in CONTAINERS else 0.0


def _tokens(name: str, rest: str) -> tuple[str, ...]:
    found = [name] if name in PRIOR_TAGS else []
    for values in _NAMES.findall(rest):
        found += "".join(values).lower().split()
    return tuple(dict.fromkeys(found))


def events(page: str) -> list[Event]:
    """Tags and texts in page order.

    An element ends at its end tag or where the markup language implies it; without either it reaches to the next start
    of a block. Whatever is open where the first article or main element begins ends there.
    """
    out: list[Event] = []
    open_at: list[tuple[str, int]] = []
    block, at, inside, seen = 0, 0, 0, False

    def close(depth: int, own: bool) -> None:
        """Take the elements from ``depth`` on off the stack; ``own`` if the lowest of them has an end of its own."""
        nonlocal inside
        for i in range(len(open_at) - 1, depth - 1, -1):
            name, start = open_at.pop()
            inside -= name in MAIN
            if not out[start].end:
                out[start].end = len(out) if own and i == depth else -1

    def text(piece: str) -> None:
        out.append(Event("", html.unescape(piece), block, "+" if inside else "-"))

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text(page[at:m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        place = "+" if inside else "-"
        if m["end"]:
            for i in range(len(open_at) - 1, -1, -1):
                if open_at[i][0] == name:
                    close(i, True)
                    break
                if open_at[i][0] in BLOCKS and name not in BLOCKS:
                    break
            block += name in BLOCKS
            out.append(Event("/" + name, "", block, place))
            continue
        for ended, bounds in ((ENDED_BY.get(name), BOUNDS), (("p",) if name in ENDS_PARAGRAPH else None, PARAGRAPH_BOUNDS)):
            lowest = -1
            for i in range(len(open_at) - 1, -1, -1) if ended else ():
                if open_at[i][0] in ended:
                    lowest = i
                elif open_at[i][0] in bounds and open_at[i][0] not in ended:
                    break
            if lowest >= 0:
                close(lowest, True)
        if name in MAIN and not seen:
            seen = True
            for _, start in open_at:
                out[start].end = out[start].end or len(out)
        block += name in BLOCKS
        out.append(Event(name, "", block, place, _tokens(name, m["rest"])))
        if name == "br":
            text(" ")
        elif name not in VOID:
            open_at.append((name, len(out) - 1))
            inside += name in MAIN
    if at < len(page):
        text(page[at:])
    close(0, False)
    after = len(out)
    for i in range(len(out) - 1, -1, -1):
        e = out[i]
        if e.end < 0:
            e.end = after
        if not seen:
            e.place = ""
        if e.name in BLOCKS:
            after = i
    return out


def _tidy(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def blocks(found: list[Event]) -> list[str]:
    """The texts of the blocks, without the empty ones."""
    by: dict[int, list[str]] = {}
    for e in found:
        if not e.name:
            by.setdefault(e.block, []).append(e.text)
    return [t for t in map(_tidy, by.values()) if t]


def _score(e: Event, weights: dict[str, float]) -> float:
    """The weight of a tag or of one word, by its place if labelled pages have it there."""
    known = weights.get(e.place + e.name)
    if known is not None:
        return known
    if not e.name:
        return weights.get("", WORD_WEIGHT)
    return INLINE_WEIGHT if e.place == "+" or e.name.lstrip("/") in INLINE else TAG_WEIGHT


def passed_over(found: list[Event], weights: dict[str, float]) -> list[tuple[Event, float]]:
    """The events with their scores; an element whose words are negative by its tokens is one tag without text."""
    out: list[tuple[Event, float]] = []
    until = 0
    for i, e in enumerate(found):
        if i < until:
            continue
        if e.tokens and e.end > i:
            below = sum(w if (w := weights.get("." + t)) is not None else prior(t) for t in e.tokens)
            if below < 0 and below + weights.get("", WORD_WEIGHT) < 0:
                until = e.end
                out.append((e, INLINE_WEIGHT if e.place == "+" else TAG_WEIGHT))
                continue
        out.append((e, _score(e, weights) * (1 if e.name else len(e.text.split()))))
    return out


def main_text(found: list[Event], weights: dict[str, float]) -> str:
    """The text of the stretch with the highest sum; of equal ones the first to end, from its latest start; '' if no sum is
    positive."""
    scored = passed_over(found, weights)
    best = total = 0.0
    start = first = last = 0
    for i, (_, score) in enumerate(scored):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, first, last = total, start, i + 1
    return "\n".join(blocks([e for e, _ in scored[first:last]]))


# ---------------------------------------------------------------- weights


def _count(found: list[Event], lines: set[str], whole: str) -> Counter[tuple[str, bool]]:
    """How often words ('') and tags, after their place, stand inside and outside the stretch from the first to the last
    main block; and, after a dot, how many words of main and of other blocks stand below each token."""
    by: dict[int, list[str]] = {}
    for e in found:
        if not e.name:
            by.setdefault(e.block, []).append(e.text)
    main = {b for b, parts in by.items() if (t := _tidy(parts)) and (t in lines or len(t) >= 20 and whole.startswith(t))}
    at = [i for i, e in enumerate(found) if e.block in main]
    seen: Counter[tuple[str, bool]] = Counter()
    below: list[tuple[int, tuple[str, ...]]] = []
    for i, e in enumerate(found):
        words = len(e.text.split())
        seen[e.place + e.name, bool(at) and at[0] <= i <= at[-1]] += 1 if e.name else words
        if words:
            below = [b for b in below if b[0] > i]
            for token in {t for _, tokens in below for t in tokens}:
                seen["." + token, e.block in main] += words
        elif e.tokens and e.end > i:
            below.append((e.end, e.tokens))
    return seen


def weigh(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log odds of standing inside: words at least 0.1, tags at most -0.1. A name without a place sums all places, and as
    a tag has TAG_WEIGHT at least, as an unknown one has. Tokens are held against all words."""
    by: Counter[tuple[str, bool]] = Counter()
    whole: Counter[bool] = Counter()
    words: Counter[bool] = Counter()
    for (key, inside), n in counts.items():
        by[key, inside] += n
        if key[:1] != ".":
            name = key.lstrip("+-")
            if name != key:
                by[name, inside] += n
            whole[inside] += n
            if not name:
                words[inside] += n
    if not whole[True]:
        return {}
    out = {}
    for key in {k for k, _ in by}:
        of = words if key[:1] == "." else whole
        odds = math.log((by[key, True] + 0.5) / (of[True] + 1)) - math.log((by[key, False] + 0.5) / (of[False] + 1))
        if key[:1] == ".":
            out[key] = odds
        elif not key.lstrip("+-"):
            out[key] = max(0.1, odds)
        else:
            out[key] = min(-0.1, odds if key[0] in "+-" else max(TAG_WEIGHT, odds))
    return out


def _line(text):
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def learn(pages: DataFrame, docs: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Weights from at most ``sample`` pages one of whose longest blocks is a line of a document; {} if there are
    none. Of several documents the one with most of these lines counts, then the first."""
    known = pages.where("html IS NOT NULL AND page_id IS NOT NULL").select("page_id", "html")
    ids = known.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    drawn = known.join(F.broadcast(ids), "page_id")  # at most `sample` numbers

    def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [sorted({t for t in blocks(events(p)) if len(t) >= LEAST_CHARS}, key=lambda t: (-len(t), t))[:LONGEST]
                     for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.list_(pa.string()))], names=["page_id", "lines"])

    marked = drawn.mapInArrow(longest, "page_id long, lines array<string>").select(
        "page_id", F.explode("lines").alias("line")).select("page_id", F.xxhash64("line").alias("h"))
    wanted = F.broadcast(marked.select("h").distinct())  # at most LONGEST numbers a page
    lines = docs.where("doc_id IS NOT NULL").select(
        "doc_id", F.explode(F.split("text", "\n")).alias("l")).select("doc_id", F.xxhash64(_line(F.col("l"))).alias("h"))
    owner = lines.join(wanted, "h").groupBy("h").agg(F.min("doc_id").alias("doc_id"))
    votes = marked.join(owner, "h").groupBy("page_id", "doc_id").agg(F.count("*").alias("n"))
    chosen = votes.groupBy("page_id").agg((-F.max(F.struct("n", (-F.col("doc_id")).alias("d")))["d"]).alias("doc_id"))
    pairs = drawn.join(chosen, "page_id")
    owners = F.broadcast(chosen.select("doc_id").distinct())  # at most one a page
    bodies = docs.select("doc_id", "text").join(owners, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[tuple[str, bool]] = Counter()
            for page, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines = {" ".join(x.split()) for x in text.split("\n")} - {""}
                seen += _count(events(page), lines, " ".join(text.split()))
            keys = list(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in keys], pa.string()), pa.array([i for _, i in keys], pa.bool_()),
                 pa.array([seen[k] for k in keys], pa.int64())], names=["name", "inside", "n"])

    total = pairs.join(bodies, "doc_id").select("html", "text").mapInArrow(count, "name string, inside boolean, n long")
    return weigh({(r["name"], r["inside"]): r["n"] for r in total.groupBy("name", "inside").agg(F.sum("n").alias("n")).collect()})


def extract(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    A null or empty page has the text ''. Rows without an id and repeated rows are read each for itself; an id with several
    pages gives all of them to the weights. Of equal stretches the first to end counts. Without pages or documents the weights are
    the fixed ones; other columns are ignored.
    """
    weights = learn(pages, docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [main_text(events(p), weights) if p else "" for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
