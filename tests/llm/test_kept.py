"""A Python worker keeps one operator's memory at a time."""

import public_tokenizers
import pyarrow as pa

from pitlane.llm import kept, near_dup, token_files


def _run(step, texts):
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    return list(step(iter([batch])))


def test_words_of_the_tokenizer_go_when_another_operator_starts():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = token_files.encoder(path)
    assert token_files.encoder(path) is encoder
    _run(near_dup._signatures, ["a b c d e"])
    assert token_files.encoder(path) is not encoder


def test_one_thing_is_kept():
    one = kept.keep(("a", 1), lambda: [1])
    assert kept.keep(("a", 1), lambda: [2]) is one
    assert kept.keep(("b", 1), lambda: [3]) == [3]
    assert kept.keep(("a", 1), lambda: [4]) == [4]
