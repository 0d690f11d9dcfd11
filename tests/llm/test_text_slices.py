import pyarrow as pa

from tidewell.llm._common import slices_by_bytes


def test_slices_hold_all_texts_in_order():
    """Before: the encoder made Python strings of all texts of an Arrow batch."""
    texts = ["a" * 400, None, "", "é" * 300, "b" * 5000, "c", None, "d" * 999]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], ["doc_id", "text"])
    got = list(slices_by_bytes(batch, 1, 1000))
    assert [t for s in got for t in s.column(1).to_pylist()] == texts
    assert [k for s in got for k in s.column(0).to_pylist()] == list(range(8))
    sizes = [sum(len((t or "").encode()) for t in s.column(1).to_pylist()) for s in got]
    assert all(n <= 1000 or s.column(1).to_pylist() == ["b" * 5000] for n, s in zip(sizes, got))
    assert list(slices_by_bytes(batch.slice(0, 0), 1, 1000)) == []
