"""The pipeline against a plain restatement of its stages; all queries of the package on the smallest tables."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from pitlane.llm import decontam, mixing, token_files
from pitlane.llm.queries import QUERIES, SQL, vocabulary

from . import brute
from .conftest import frame, sentence


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(21)
    rows = [(i, sentence(rng, rng.randint(40, 160))) for i in range(120)]
    for i in range(120, 150):
        w = rows[i - 120][1].split()
        w[rng.randrange(len(w))] = "edited"
        rows.append((i, " ".join(w)))
    item = sentence(rng, 30)
    rows += [(150, sentence(rng, 100) + " " + item), (151, sentence(rng, 2000) + " " + item + " " + sentence(rng, 50)),
             (152, None), (153, ""), (154, "again and again " * 50)]
    labels = [(i, int(i % 9 > 0), int(i % 11 == 0)) for i, _ in rows]
    folder = str(tmp_path_factory.mktemp("corpus"))
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, item


def test_pipeline(spark, tables):
    folder, rows, item = tables
    left = [(d, t) for d, t in rows if not brute.quality(t)[-1]]
    comps, _ = brute.components(left)
    left = [(d, t) for d, t in left if comps[d] == d]
    found = {r[0]: r for r in brute.contamination(left, [(7, item)])}
    assert found[150][-1] and found[151][2] == 30 and not found[151][-1]
    cleaned = []
    for d, t in left:
        if not found[d][-1]:
            n = brute.alnum(t)
            spans = [(i, i + 30) for i in range(len(n)) if n[i:i + 30] == brute.alnum(item)]
            cleaned.append((d, decontam.without_spans(t, spans)))
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    copies = {r["doc_id"]: r["copies"] for r in mixing.report(frame(spark, cleaned), labels, corpus_pipeline.TARGETS).collect()}
    tokenizer, want, start = Tokenizer.from_file(vocabulary()), [], 0
    for d, t in sorted(cleaned):
        for _ in range(copies[d]):
            ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, token_files.END_ID], "<u4")
            want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
    got = corpus_pipeline.run(spark, folder)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got.collect()) == want
    assert len(want) > 60


def test_stages_keep_the_columns(spark, tables):
    folder, rows, _ = tables
    docs = frame(spark, rows[:30])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).schema.simpleString() == docs.schema.simpleString()


def test_stages_on_an_empty_table(spark, tables, nothing):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, tables[0]).count() == 0


def test_registration():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(SQL) <= set(QUERIES) and set(entry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_over_whole_table(spark, name):
    folder = "/root/testdata/sf0.001"
    table = "pages" if name.startswith("op5_") else "documents"
    assert entry.queries()[name](spark, folder).count() == spark.read.parquet(f"{folder}/{table}.parquet").count()
