import pyarrow as pa
import pytest

from sunfold.llm.batches import each_row, slices


@pytest.mark.parametrize("texts", [[], [None], ["", None, ""], ["a" * 50, None, "b"], ["a"] * 30, ["a" * 9, "b" * 9, "", "c" * 100, "d"]])
@pytest.mark.parametrize("rows", [None, 1, 4])
def test_slices_keep_every_row_in_order(texts, rows):
    batch = pa.record_batch([pa.array(texts, pa.string()), pa.array(range(len(texts)), pa.int64())], ["text", "n"])
    parts = list(slices(batch, "text", 10, rows))
    assert [r for p in parts for r in each_row(p)] == list(zip(texts, range(len(texts)), strict=True))
    for p in parts:
        assert rows is None or p.num_rows <= rows
        before_last = [t or "" for t in p["text"].to_pylist()][:-1]
        assert sum(map(len, before_last)) < 20
