import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


WORDS = [a + b for a in "the an re st on in er ti ou ha".split() for b in "ing ed ly ble and or wh es at en".split()]


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): prose, nulls, empties, one word, very long, repeated lines and windows, copies and near copies,
    tabs, letters beyond ASCII, secrets, licence lines."""
    rng = random.Random(7)
    rows = [(i, sentence(rng, rng.randint(20, 120))) for i in range(40)]
    base = sentence(rng, 200)
    rows += [(100, base), (101, base), (102, base.upper()), (103, base + " one more"), (104, base[:len(base) // 2])]
    for i in range(105, 125):
        w = base.split()
        for _ in range(i - 104):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "word"), (204, "two words"), (205, "a b c"), (206, "a b c"),
             (207, "a b c d"), (208, "é" * 300), (209, ("again and again " * 400).strip()),
             (210, sentence(rng, 30_000)), (211, "line of words here\n" * 30 + "\n\n  \nlast"), (212, "x" * 50_000),
             (213, "\x01 mark \x01word <|endoftext|> End's don't naïve é   ÀÉ straße 日本語 😀"),
             (214, "token = \"923abcdef012\" AKIA" + "A1" * 10 + " " + "0a" * 20 + " secret:short passwd=token=abcdefgh"),
             (215, sentence(rng, 20) + "\nReleased under the MIT License.\n" + sentence(rng, 20)),
             (216, "#$% *** |a| <b> & " * 40)]
    return rows


def frame(spark, rows, extra=True):
    """The documents as a table, with columns that clash with names the operators use."""
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string")
    return spark.createDataFrame(
        [(d, t, "en" if (d or 0) % 2 else None, "s", None if t is None else len(t), -1, "k", 0) for d, t in rows],
        DOCS + ", n_words long, key string, id int")


@pytest.fixture(scope="session")
def docs(spark, texts):
    return frame(spark, texts).repartition(3, "doc_id").cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
