import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog_engine.llm import topk_search as ts

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=5, divisor=50):
    """Sorted results over rows (vec_id, vector), in Python's integers."""
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
             if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v) in enumerate(whole):
        if i is not None and i % divisor == 0:
            best = sorted(((-sum(x * y for x, y in zip(v, w, strict=False)), j is None, j or 0) for b, (j, w) in enumerate(whole) if b != a))[:k]
            out += [(i, r, None if gone else j, -s) for r, (s, gone, j) in enumerate(best, 1)]
    return sorted(out, key=str)


def check(spark, rows, schema=SCHEMA, parts=3):
    table = spark.createDataFrame([(*r, 0) for r in rows], schema).repartition(parts)
    clash = table.withColumns({c: F.lit(1) for c in ("row", "v", "block", "part", "home", "query", "rank", "score")})
    found = sorted((tuple(r) for r in ts.top_k(clash).collect()), key=str)
    assert found == brute([(r.vec_id, r.embedding) for r in table.collect()])
    return found


@pytest.mark.parametrize("least_block", [2048, 20])
def test_random_and_tied_vectors(spark, monkeypatch, least_block):
    monkeypatch.setattr(ts, "LEAST_BLOCK_ROWS", least_block)
    rng = random.Random(1)
    hot = [rng.gauss(0, 0.2) for _ in range(8)]
    rows = [(i, hot if i % 3 == 0 else [rng.gauss(0, 0.2) for _ in range(8)]) for i in range(400)]  # a third are one vector
    check(spark, rows)
    coarse = [(i, [float(rng.randint(-1, 1)) for _ in range(3)]) for i in range(300)]  # many ties
    check(spark, coarse)


def test_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(ts, "LEAST_BLOCK_ROWS", 4)
    rows = [(0, [0.5, -0.25]), (50, [0.0, 0.0]), (50, [0.1]), (100, []), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]),
            (4, [float("inf"), 0.0]), (None, [0.5, 0.5]), (None, [0.5, 0.5]), (5, [0.5, 0.5]), (0, [0.5, -0.25]), (150, None), (7, [-0.001, 0.001])]
    found = check(spark, rows)
    assert {r[0] for r in found} == {0, 50, 100}
    assert ts.top_k(spark.createDataFrame([], SCHEMA)).collect() == []
    assert check(spark, [(0, [1.0])]) == [] and len(check(spark, [(0, [1.0]), (1, [2.0])])) == 1


def test_large_products_stay_exact(spark):
    rows = [(0, [2.0 ** 22, 1.0]), (1, [2.0 ** 22, 1.0]), (2, [2.0 ** 22, 1.0 + 2 ** -8]), (3, [-2.0 ** 22, 3.0])]
    check(spark, rows, SCHEMA.replace("float", "double"))


def test_search_stops_early_and_is_exact():
    rng = np.random.default_rng(3)
    matrix = np.floor(256 * np.sort(rng.random((3000, 2)), axis=0))  # one line of growing vectors
    lists = ts.SortedLists(matrix, np.arange(3000))
    reads = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            reads.append(np.size(key))
            return super().__getitem__(key)

    lists.matrix = matrix.view(Counted)
    rows, scores = lists.search(np.array([3.0, 5.0]), 5)
    all_scores = matrix @ np.array([3.0, 5.0])
    best = np.lexsort((np.arange(3000), -all_scores))[:5]
    assert list(rows) == list(best) and list(np.asarray(scores)) == list(all_scores[best])
    assert sum(reads) < 300  # of 3,000
    rows, scores = lists.search(np.array([3.0, 5.0]), 5, floor=float(all_scores.max()) + 1)
    assert len(rows) == 0
