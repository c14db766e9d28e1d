"""Plain restatements of what the operators return, for small fixtures."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(text, lower=False):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER) if lower else text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(docs, items, window=13):
    found = defaultdict(set)
    for name, text in items:
        w = alnum(text)
        for i in range(len(w) - window + 1):
            found[tuple(w[i:i + window])].add(str(name))
        if 0 < len(w) < window:
            found[tuple(w)].add(str(name))
    sizes = {len(k) for k in found}
    out = []
    for doc, text in docs:
        w, hit, names = alnum(text), set(), set()
        for i in range(len(w)):
            for n in sizes:
                key = tuple(w[i:i + n])
                if len(key) == n and key in found:
                    hit |= set(range(i, i + n))
                    names |= found[key]
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)


def base_secrets(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def unigrams(docs):
    """(held_out, n_tokens, n_known, N, base score) by position."""
    rows = [(spaced(t, True), zlib.crc32(str(d).encode()) % 5 == 1) for d, t in docs]
    c = Counter()
    for w, held in rows:
        if not held:
            c.update(w)
            c[None] += 1
    n, v = sum(c.values()), len(c)
    return [(held, len(w) + 1, sum(c[x] > 0 for x in [*w, None]), n,
             sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in [*w, None])) for w, held in rows]


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = spaced(text)
    lines = [x for x in text.split("\n") if spaced(x)]
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


def shingles(text, size=4):
    w = spaced(text, True)
    if len(w) < size:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1))


def components(docs):
    """doc -> smallest doc reachable over links of at least 80 in 100; docs are (id, text) with different ids."""
    sets = {d: shingles(t) for d, t in docs}
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}, {d: len(s) for d, s in sets.items()}
