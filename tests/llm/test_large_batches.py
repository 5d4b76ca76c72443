import types

import pyarrow as pa

from lodestone.llm import bpe


def batches():
    return (pa.RecordBatch.from_pydict({"k": [i], "t": ["x" * 100]}) for i in range(10))


def keys(found):
    return [k for b in found for k in b.column(0).to_pylist()]


def test_no_row_is_lost_where_a_column_has_several_chunks(monkeypatch):
    joined = lambda held: types.SimpleNamespace(combine_chunks=lambda: types.SimpleNamespace(to_batches=lambda: list(held)))
    monkeypatch.setattr(bpe, "pa", types.SimpleNamespace(Table=types.SimpleNamespace(from_batches=joined), RecordBatch=pa.RecordBatch))
    assert keys(bpe._text_batches(batches(), 1, 4)) == list(range(10))


def test_a_batch_is_closed_by_its_bytes():
    found = list(bpe._text_batches(batches(), 1, 1000, 300))
    assert keys(found) == list(range(10)) and max(map(len, found)) <= 3
