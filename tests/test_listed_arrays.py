"""Batches of lists become rows of numbers without a Python object each."""

import pyarrow as pa

from quillon.operators import wide_deep as W


def test_lists_as_rows():
    class Column:
        """A column that may not be turned into Python objects."""

        def __init__(self, a):
            self.a = a

        def flatten(self):
            return self.a.flatten()

    x, w = pa.array([[1.0, 2.0], [3.0, 4.0]], pa.list_(pa.float64())), pa.array([[1], [2]], pa.list_(pa.int32()))
    batch = type("Batch", (), {"num_rows": 2, "column": lambda self, n: Column({"x": x, "w": w}[n])})()
    got = W._arrays(batch, "x", "w")
    assert got[0].tolist() == [[1.0, 2.0], [3.0, 4.0]] and got[1].tolist() == [[1], [2]]
    part = pa.RecordBatch.from_arrays([x, w], names=["x", "w"]).slice(1)
    assert [a.tolist() for a in W._arrays(part, "x", "w")] == [[[3.0, 4.0]], [[2]]]
