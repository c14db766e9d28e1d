"""Operators 11 to 13 over the awkward texts of conftest and small tables, against brute force."""

import hashlib
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
import tiktoken

from pitlane.llm import bpe, fim, whitening
from pitlane.llm.queries import ranks

from .conftest import frame


def sha(data):
    return hashlib.sha256(data).hexdigest()


# ---------------------------------------------------------------- fill-in-the-middle


def turned(doc_id, text, rate=100, spm_rate=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    h = sha(f"7:{doc_id}".encode())
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if doc_id is None or not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    if h4 % 100 < spm_rate:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


LINES = [(300, "one\n\ntwo\r\nthree"), (301, "\n"), (302, "\n\n\n"), (303, "no end"), (304, "a<P>b\nc"), (305, "a<\nS>b\n<P\n>"),
         (306, "é日😀\n" * 5000), (307, "<\n<S\n<M\n"), (308, "x" * 4096 + "\n" + "y" * 4095 + "\n"), (None, "a\nb\n"),
         (303, "no end"), (303, "other\ntext")]


def test_turned_texts(spark, texts):
    rows = texts + LINES + [(1000 + i, "".join(random.Random(i).choice(["a", "é", "\n", "<", "S>"]) for _ in range(60)))
                            for i in range(60)]
    key = lambda r: (str(r[0]), r[1:])
    got = fim.transform(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=lambda r: str(r)) == sorted(((d, *turned(d, t)) for d, t in rows), key=lambda r: str(r))
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    digests = [tuple(r) for r in fim.report(frame(spark, rows)).collect()]
    want = [(d, *turned(d, t)[:4], sha(turned(d, t)[4].encode()), sha((t or "").encode())) for d, t in rows]
    assert sorted(digests, key=lambda r: key((r[0], str(r)))) == sorted(want, key=lambda r: key((r[0], str(r))))


def test_rates_of_turning(spark, texts):
    got = {tuple(r) for r in fim.transform(frame(spark, texts, extra=False), rate=40, spm_rate=10).collect()}
    assert got == {(d, *turned(d, t, 40, 10)) for d, t in texts}


@pytest.mark.parametrize("unit,pattern", [("line", r"[^\n]*\n|[^\n]+"), ("word", r"[^ \t-\r]*[ \t-\r]+|[^ \t-\r]+"), ("point", r"(?s).")])
def test_cuts_at_every_unit(unit, pattern):
    rng = random.Random(5)
    for length in (0, 1, 7, 64, 300):
        text = "".join(rng.choice(["a", "é", "日", "\n", " ", "\t"]) for _ in range(length))
        units = re.findall(pattern, text)
        tree = fim.BlockTree(np.frombuffer(text.encode(), np.uint8), unit, block=8)
        assert tree.n == len(units)
        for k in range(len(units) + 1):
            head = "".join(units[:k])
            assert tree.cut(k) == (len(head.encode()), len(head))


def test_turning_nothing_and_bad_units(nothing):
    assert fim.report(nothing).collect() == []
    with pytest.raises(ValueError):
        fim.transform(nothing, unit="page")


# ---------------------------------------------------------------- whitening


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def whitened(rows):
    """n, deviation by vector, eigenvalues and components, from exact integers."""
    xs = {tuple(math.floor(64 * c) + 1_000_000 for c in v) for v in rows if usable(v)}
    n, total = len(xs), [sum(c) for c in zip(*xs, strict=True)]
    centred = np.array([[float(Fraction(n * v - s, n)) for v, s in zip(x, total, strict=True)] for x in xs])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return n, total, values[::-1], vectors[:, ::-1]


def embeddings(spark, rows):
    return spark.createDataFrame([(i, v, "k", 1) for i, v in rows], "vec_id long, embedding array<float>, x string, n int")


def test_whitened_vectors(spark):
    rng = np.random.default_rng(1)
    mix = rng.normal(size=(6, 6)) @ np.diag([40, 20, 9, 3, 1, 0.5])
    vectors = (rng.normal(size=(300, 6)) @ mix).astype(np.float32).tolist()
    rows = list(enumerate(vectors)) + [(400 + i, vectors[0]) for i in range(150)]
    rows += [(600, None), (601, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (602, [float("nan")] * 6), (603, [float("inf")] + [0.0] * 5),
             (604, [1.0, 2.0]), (605, []), (606, [1e30] * 6), (None, vectors[1]), (3, vectors[2])]
    got = whitening.report(embeddings(spark, rows)).collect()
    plain = [(i, v) for i, v in rows if usable(v) and len(v) == 6 and max(v) < 1e20]
    n, total, values, components = whitened([v for _, v in plain])
    assert len(got) == 6 * len(plain)
    by_key = {}
    for r in got:
        by_key.setdefault((r.vec_id, r.deviation), {})[r.component] = r
    assert all(r.n == n for r in got) and max(r.identity_error for r in got) < 1e-9
    sign = {}
    for i, v in plain:
        x = [math.floor(64 * c) + 1_000_000 for c in v]
        dev = sum((n * a - s) ** 2 for a, s in zip(x, total, strict=True))
        z = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, total, strict=True)]) @ components / np.sqrt(values)
        for k in range(6):
            r = by_key[i, dev][k + 1]
            sign.setdefault(k, np.sign(r.whitened * z[k]))
            assert r.whitened == pytest.approx(sign[k] * z[k], rel=1e-8, abs=1e-8)
            assert r.explained == pytest.approx(values[k] / values.sum(), rel=1e-9)


def test_ill_conditioned_and_empty_directions(spark):
    rng = np.random.default_rng(2)
    wide = rng.integers(-(1 << 30), 1 << 30, 200)
    rows = [(i, [float(w), float(w) + float(s) / 64, 5.0, -3.0 * float(w)]) for i, (w, s) in
            enumerate(zip(wide, rng.integers(-9, 9, 200), strict=True))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.report(table).collect()
    assert {r.component for r in got} == {1, 2} and len(got) == 400
    assert max(r.identity_error for r in got) < 1e-4
    x = np.array([[math.floor(64 * c) for c in v] for _, v in rows], object)
    spread = x - np.array([[Fraction(sum(c), 200) for c in zip(*x, strict=True)]])
    v = np.array([[sum(spread[:, a] * spread[:, b]) / 200 for b in range(4)] for a in range(4)])
    trace = sum(v[a, a] for a in range(4))
    minors = sum(v[a, a] * v[b, b] - v[a, b] * v[b, a] for a in range(4) for b in range(a))
    least = float(minors / trace ** 2)
    assert {round(r.explained / least, 4) for r in got if r.component == 2} == {1.0}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_whiten(spark, rows):
    assert whitening.report(embeddings(spark, rows)).collect() == []


def test_deviation_beyond_a_long_is_null():
    model = whitening.Whitening(1 << 40, [0, 0], np.eye(2), np.ones(2), 2.0)
    assert model.deviation(np.array([[1 << 20, 1], [0, 0]])) == [None, 0]
    half = whitening.Whitening(3, [10, 11], np.eye(2), np.ones(2), 2.0)
    assert half.deviation(np.array([[4, -2]])) == [(12 - 10) ** 2 + (-6 - 11) ** 2]


# ---------------------------------------------------------------- byte-level BPE


@pytest.fixture(scope="session")
def vocabularies():
    path, pattern = ranks()
    table = bpe.read_ranks(path)
    return bpe.ByteBpe(table, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def test_ids_against_the_library(spark, texts, vocabularies):
    _, library = vocabularies
    rows = texts + [(None, "a b"), (1, "twice"), (1, "twice"), (500, "ab" * 20_000 + "é日" * 3000), (501, "aaaaaaa" * 999)]
    got = bpe.encode(frame(spark, rows), *ranks()).collect()
    want = [(d, library.encode_ordinary(t or "")) for d, t in rows]
    assert sorted(map(str, ((r.doc_id, r.ids) for r in got))) == sorted(map(str, want))
    digests = {tuple(r) for r in bpe.report(frame(spark, rows), *ranks()).collect()}
    assert digests == {(d, len(i), sha(",".join(map(str, i)).encode()), sha((t or "").encode()))
                       for (d, t), (_, i) in zip(rows, want, strict=True)}


def test_long_texts_are_taken_in_runs(vocabularies, monkeypatch):
    own, library = vocabularies
    monkeypatch.setattr(bpe, "LISTED", 10)
    monkeypatch.setattr(bpe, "RUN", 3)
    text = "Some words, 12 numbers   and \n\n breaks — ünïcode 日本語 don't" * 5
    assert own.encode(text).tolist() == library.encode_ordinary(text)


def merged(piece, table):
    """The definition: while two neighbours join to a token, those of the lowest rank do, the leftmost first."""
    parts = [bytes([b]) for b in piece]
    while True:
        found = [(table[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in table]
        if not found:
            return [table[p] for p in parts]
        i = min(found)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def test_merges_of_any_vocabulary():
    rng = random.Random(9)
    for _ in range(30):
        tokens = [bytes([b]) for b in range(256)]
        while len(tokens) < 330:
            new = rng.choice(tokens[97:100] + tokens[256:]) + rng.choice(tokens[97:100] + tokens[256:])
            if new not in tokens:
                tokens.append(new)
        order = list(range(len(tokens)))
        rng.shuffle(order)
        table = dict(zip(tokens, order, strict=True))
        own = bpe.ByteBpe(table, r"\S+|\s+")
        for _ in range(20):
            piece = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 60)))
            if piece not in table:
                assert own.merge(piece) == merged(piece, table)
                assert own.decode(own.merge(piece)) == piece
        assert not any(own.words) and not any(own.buckets)


def test_memory_keeps_frequent_pretokens(vocabularies):
    own, _ = vocabularies
    memory = bpe._Memory(own.merge, limit=2)
    for piece in ("aa", "bb", "cc", "aa", "dd", "aa", "zz" * 40):
        assert memory[piece] == np.array(own.merge(piece.encode()), np.int32).tobytes()
    assert len(memory) <= 2 and "aa" in memory and "zz" * 40 not in memory


def test_decoding_edges(spark, nothing, vocabularies):
    assert bpe.report(nothing, *ranks()).collect() == []
    own, _ = vocabularies
    table = spark.createDataFrame([(1, None), (2, []), (3, [own.byte[0xC3]])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.data for r in bpe.decode(table, *ranks()).collect()}
    assert got[1] is None and bytes(got[2]) == b"" and bytes(got[3]) == b"\xc3"
    with pytest.raises(KeyError):
        own.decode([10 ** 9])
    with pytest.raises(ValueError):
        bpe.ByteBpe({b"a": 0}, ".")
