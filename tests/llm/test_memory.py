"""What tasks of Python hold: texts are worked on in slices, with the same results."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from riskweave.llm import neardup, packing
from riskweave.llm.queries import tokenizer_path

TEXTS = pa.array([" ".join(f"w{(i * 37 + k * k) % 991}" for k in range(2_000 + i % 7)) for i in range(120)] + ["", None, "one two", "  "])
IDF = neardup.Idf(np.zeros(0, np.uint64), np.zeros(0), 7.0)


@pytest.mark.parametrize("texts", [TEXTS, TEXTS.slice(0, 0), TEXTS.slice(120), TEXTS.slice(3, 1)])
def test_slices_give_the_same_shingles(monkeypatch, texts):
    monkeypatch.setattr(neardup, "SLICE_BYTES", 9_000)
    for got, want in zip(neardup.shingles_by_slices(texts, IDF), neardup.shingles(texts, IDF), strict=True):
        assert got.tolist() == want.tolist()


def test_a_chunk_of_texts_is_never_whole_in_words():
    class Shared:
        value = IDF

    names = [str(i).encode() for i in range(len(TEXTS))]
    table = pa.table({"key": pa.array(names), "a": pa.array(names[:1] * len(names)), "text": pa.array(["" if x is None else x for x in TEXTS.to_pylist()])})
    tracemalloc.start()
    neardup._similar(Shared, 0.8)(table)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20 * table.nbytes, most / table.nbytes


class Task:
    """Stands for the context of a task."""

    @staticmethod
    def get():
        return Task

    @staticmethod
    def partitionId():
        return 3


def first_round(texts):
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    return [row for out in packing._first_round(tokenizer_path(), 2048, 2043)(iter([batch])) for row in out.to_pylist()]


def test_packing_holds_the_words_of_a_slice(monkeypatch):
    monkeypatch.setattr(packing, "TaskContext", Task)
    texts = pa.array(TEXTS.to_pylist() * 6)
    first_round(TEXTS)  # the tokenizer is there, its words are known
    tracemalloc.start()
    first_round(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 10 * texts.nbytes, most / texts.nbytes


@pytest.mark.parametrize("texts", [TEXTS, TEXTS.slice(0, 0), TEXTS.slice(120), TEXTS.slice(3, 1)])
def test_slices_give_the_same_bins(monkeypatch, texts):
    monkeypatch.setattr(packing, "TaskContext", Task)
    want = first_round(texts)
    monkeypatch.setattr(packing, "SLICE_BYTES", 9_000)
    assert first_round(texts) == want
