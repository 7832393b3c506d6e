import os

import pyarrow as pa
from corpusloom.llm import shared


def test_stored_tables_can_be_dropped(spark):
    mark = shared.stored_count()
    tables = [shared.stored(spark.range(5), "t") for _ in range(4)]
    there = lambda: [os.path.isdir(t.stored_at.removeprefix("file:")) for t in tables]
    shared.forget(tables[0])
    assert tables[1].count() == 5 and there() == [False, True, True, True]
    assert shared.drop_stored(spark, since=mark, but=tables[2]) == 2 and there() == [False, False, True, False]
    assert shared.drop_stored(spark, since=mark) == 1 and not any(there())


def test_slices_cover_a_batch_in_order():
    texts = ["", "x" * 10, None, "y" * 100, "z", "é" * 7]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    for most in (1, 5, 20, 1000):
        parts = list(shared.text_slices(batch, most=most))
        assert [t for p in parts for t in p["text"].to_pylist()] == texts
        assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p["text"].to_pylist()) <= most for p in parts)
