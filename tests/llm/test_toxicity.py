"""Toxicity: short words, stems with endings, and dictionaries of few samples."""

import random

from pitlane.llm import toxicity


def test_short_words_and_stems_are_found(spark):
    """Words of four letters, and a stem that takes many endings and stands in some ordinary texts too."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abdefgilnrt") for _ in range(rng.randint(2, 8)))
    known = [word() for _ in range(400)]
    rows, marks = [], []
    for i in range(1200):
        w = [rng.choice(known) for _ in range(rng.randint(20, 120))]
        toxic = i % 4 == 0
        bad = [rng.choice(["scum", "oaf"]) for _ in range(2)] if i % 8 else ["vostok" + rng.choice(known) for _ in range(3)]
        for x in bad if toxic else ["vostok"] if i % 9 == 1 else []:
            w.insert(rng.randrange(len(w)), x)
        rows.append((i, " ".join(w)))
        marks.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r for r in toxicity.score(docs, spark.createDataFrame(marks, "doc_id long, toxic int")).collect() if r["held_out"]]
    toxic = [r["predicted"] for r in got if r["doc_id"] % 4 == 0]
    clean = [r["predicted"] for r in got if r["doc_id"] % 4]
    assert len(toxic) > 50 and sum(toxic) / len(toxic) >= 0.9 and sum(clean) / len(clean) <= 0.03


def test_dictionary_of_few_samples():
    """Too little to train on: whole samples, the most frequent last, none cut."""
    assert toxicity._dictionary([b"", b" ab ", b" xyz ", b" ab "], 9) == b" xyz  ab "
    assert toxicity._dictionary([b" ab ", b" xyz ", b" ab "], 8) == b" ab "
    assert toxicity._dictionary([], 8) == b""


def test_marked_stretches():
    chosen = {b" scum", b"mbers", b"cumbers "}
    assert toxicity._marked([b"scum", b"cucumbers", b"ok", b"scum"], chosen) == b" scumcumbers "
