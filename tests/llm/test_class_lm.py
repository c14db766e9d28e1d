"""The class model against plain restatements, with few frequent words so that most are rare."""

import random

import numpy as np
import pytest

from pitlane.llm import class_lm
from pitlane.llm.class_lm import CLASSES, END, PLACES, REAL, REST

from .conftest import frame


def corpus():
    """Two languages that never meet, with words of all frequencies; some held-out words are unseen, also in a row."""
    rng = random.Random(3)
    rows = []
    for i in range(240):
        letter = "ab"[i % 2]
        vocabulary = [f"{letter}{j}" for j in range(60)]
        weights = [1 / (j + 1) for j in range(60)]
        text = rng.choices(vocabulary, weights, k=rng.randint(0, 30))
        if i % 3 == 0:
            text[len(text) // 2:len(text) // 2] = [f"{letter}new{i}_{j}" for j in range(rng.randint(1, 4))]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(text)))
    return rows + [(900, None), (901, ""), (902, "never seen by anyone"), (903, "A1 a1 A1"), (903, "A1 a1 A1")]


@pytest.fixture(scope="module")
def fitted(spark):
    docs = frame(spark, corpus()).repartition(4).select("doc_id", class_lm.held_out().alias("held_out"), "text")
    seen = []
    model, rare = class_lm.train(docs.where("NOT held_out"), own_words=6, head_words=30, watch=seen.append)
    return docs, model, rare, seen


def _classes(docs, model, rare):
    """Counts and classes of all training words, with the hashes turned back into words."""
    import pyarrow as pa

    counts = {}
    for r in docs.where("NOT held_out").collect():
        for w in (r["text"] or "").lower().split():
            counts[w] = counts.get(w, 0) + 1
    names = sorted(counts)
    piece = next(class_lm.words.pieces(pa.array([" ".join(names)]), class_lm.words.NON_SPACE, lower=True))
    place = dict(zip(model.head.view(np.int64).tolist(), model.place.tolist(), strict=True))
    for r in rare.collect():
        assert r["h"] not in place
        place[r["h"]] = r["place"]
    keys = dict(zip(names, piece.hashes.view(np.int64).tolist(), strict=True))
    assert {r["h"]: r["c"] for r in rare.collect()}.items() <= {keys[w]: n for w, n in counts.items()}.items()
    return counts, {w: place[keys[w]] for w in names}


def test_every_word_has_a_class_and_the_rest_follows(fitted):
    docs, model, rare, seen = fitted
    counts, place = _classes(docs, model, rare)
    assert 6 < len(model.head) <= 30 < len(counts) and set(place.values()) <= set(range(CLASSES))
    assert seen == sorted(seen)
    table = np.zeros((PLACES, PLACES))
    for r in docs.where("NOT held_out").collect():
        line = [END, *(place[w] for w in (r["text"] or "").lower().split()), END]
        for a, b in zip(line, line[1:]):
            table[a, b] += 1
    after = table.sum(axis=0)
    share = (after[REAL] + 0.5) / (after[REAL] + 0.5).sum()
    want = (table[np.ix_(REAL, REAL)] + class_lm.PRIOR * share) / (table[REAL].sum(axis=1, keepdims=True) + class_lm.PRIOR)
    assert np.allclose(10 ** model.move[np.ix_(REAL, REAL)], want) and np.allclose(want.sum(axis=1), 1)
    total = after + 0.5
    for w, n in counts.items():
        total[place[w]] += 0.5
    assert np.allclose(10 ** model.total[REAL], total[REAL])
    assert model.n == after.sum() and model.v == len(counts) + 1


def test_scores_sum_over_the_classes_of_unseen_words(fitted):
    docs, model, rare, _ = fitted
    counts, place = _classes(docs, model, rare)
    move, total = 10 ** model.move, 10 ** model.total

    def logp(text):
        state = np.zeros(PLACES)
        state[END] = 1
        for w in (text or "").lower().split():
            if w in counts:
                new = np.zeros(PLACES)
                new[place[w]] = state @ move[:, place[w]] * (counts[w] + 0.5) / total[place[w]]
            else:
                new = state @ move * 0.5 / total
                new[REST] = new[END] = 0
            state = new
        return np.log10(state @ move[:, END] * (model.ends + 0.5) / total[END])

    got = sorted(map(tuple, class_lm.score(docs, model, rare).select("doc_id", "score").collect()))
    want = sorted((r["doc_id"], logp(r["text"])) for r in docs.collect())
    assert [d for d, _ in got] == [d for d, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], rel=1e-9)
    held = [r["doc_id"] for r in docs.where("held_out").collect()]
    assert any(w not in counts for i, t in corpus() if i in held for w in (t or "").lower().split())


def test_batches_may_cut_runs_of_unseen_words(fitted, spark):
    docs, model, rare, _ = fitted
    rows = spark.createDataFrame([(1, False, "a1 " + "u v w " * 50 + "a2"), (2, False, "x y"), (3, False, "z " * 999)],
                                 "doc_id long, held_out boolean, text string")
    want = {r["doc_id"]: r["score"] for r in class_lm.score(rows, model, rare).collect()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["doc_id"]: r["score"] for r in class_lm.score(rows, model, rare).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == pytest.approx(want, rel=1e-9) and all(np.isfinite(list(want.values())))


@pytest.mark.parametrize("seed", range(5))
def test_the_best_class_is_that_of_the_likelihood(seed):
    """Each word moved alone to every class, the likelihood counted anew."""
    rng = np.random.default_rng(seed)
    words_, classes = 12, 4
    counts = rng.integers(0, 4, (words_ + 1, words_ + 1)).astype(float)
    place = np.append(rng.integers(0, classes, words_), classes)

    def table(where):
        member = np.zeros((words_ + 1, classes + 1))
        member[np.arange(words_ + 1), where] = 1
        return member.T @ counts @ member

    member = np.zeros((words_ + 1, classes + 1))
    member[np.arange(words_ + 1), place] = 1
    itself = np.diagonal(counts)[:words_].copy()
    right, left = (counts @ member)[:words_], (counts.T @ member)[:words_]
    right[np.arange(words_), place[:words_]] -= itself
    left[np.arange(words_), place[:words_]] -= itself
    got = class_lm.best_classes(table(place), right, left, itself, place[:words_], classes)
    for w in range(words_):
        by = []
        for b in range(classes):
            other = place.copy()
            other[w] = b
            by.append(class_lm.likelihood(table(other)))
        assert by[got[w]] == pytest.approx(max(by), abs=1e-6)
