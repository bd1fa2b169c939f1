"""Components by one task and by star rounds against union-find."""

import random

import pyarrow as pa
import pytest

from quire.llm import components


@pytest.mark.parametrize("small", [0, 200_000])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(components, "SMALL", small)
    rnd = random.Random(4)
    edges = [(k, k + 1) for k in range(100, 160)] + [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(200, 200 + k) for k in range(1, 40)] + [(7, 7), (500, 501), (501, 500)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    want = {(x, root(x)) for x in parent if root(x) != x}
    got = components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b")
    assert {tuple(r) for r in got.collect()} == want
    every = components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b", roots=True).collect()
    assert sorted(map(tuple, every)) == sorted(want | {(r, r) for _, r in want})
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_contraction_is_bounded_and_keeps_components(monkeypatch):
    """A task's stars leave whenever it holds many nodes, and join the same nodes."""
    monkeypatch.setattr(components, "HELD", 20)
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + 10)), pa.array(range(k + 1, k + 11))], names=["a", "b"]) for k in range(0, 100, 10)]
    out = list(components._contract(iter(batches)))
    assert len(out) > 3 and max(b.num_rows for b in out) <= 30
    monkeypatch.setattr(components, "HELD", 1000)
    (last,) = components._contract(iter(out))
    assert sorted(map(tuple, zip(*last.to_pydict().values(), strict=True))) == [(k, 0) for k in range(1, 101)]
