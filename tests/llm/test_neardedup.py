import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog_engine.llm import neardedup as nd
from catalog_engine.llm.components import components


def brute(rows, settings):
    """Rows (doc_id, text) in, (doc_id, n_shingles, component_id, kept) out, by all pairs."""
    sets = []
    for _, text in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lower)
        k = min(settings.words, len(w))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set())
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= settings.percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [d for j, (d, _) in enumerate(rows) if find(j) == find(i) and d is not None]
        own = (min(ids) if ids else None) if sets[i] else doc
        out.append((doc, len(sets[i]), own, doc == own))
    return out


@pytest.fixture(scope="module")
def copies(words):
    """Groups of near copies on both sides of the threshold, chains, copies and strays."""
    rng = random.Random(11)
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([30, 80, 200]))]
        for _ in range(rng.randint(1, 8)):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(words).upper()
            rows.append((n, " ".join(text)))
            n += 1
            base = text if rng.random() < 0.5 else base
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("settings", [nd.Settings(), nd.Settings(5, 80)])
def test_components_match_brute_force(spark, copies, settings):
    docs = spark.createDataFrame(copies, "doc_id long, text string")
    found = sorted(map(tuple, nd.near_duplicates(docs, settings).collect()))
    assert found == sorted(brute(copies, settings))


def test_blocks_of_any_size(spark, copies, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 2)
    monkeypatch.setattr(nd, "_hub_pairs", lambda classes, *_: classes.select(F.col("node").alias("a"), F.col("node").alias("b")).where("a < b"))
    docs = spark.createDataFrame(copies, "doc_id long, text string")
    assert sorted(map(tuple, nd.near_duplicates(docs).collect())) == sorted(brute(copies, nd.Settings()))


def test_odd_rows(odd_docs, odd_rows):
    found = sorted(map(tuple, nd.near_duplicates(odd_docs).collect()), key=str)
    assert found == sorted(brute([(r[0], r[1]) for r in odd_rows], nd.Settings()), key=str)


def test_empty_tables(spark, no_docs):
    assert nd.near_duplicates(no_docs).collect() == []
    only_empty = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, nd.near_duplicates(only_empty).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_keep_one(odd_docs, odd_rows):
    kept = nd.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted((r.doc_id for r in kept.select("doc_id").collect()), key=lambda x: (x is None, x))
    # the copies 4, 5, 5 and 6 are one group; two texts have the id 7; empty texts all stay
    assert ids == [1, 2, 3, 4, 7, 7, 8, 9, 10, 11, None, None]


def test_sketch_fills_and_agrees():
    rng = np.random.default_rng(4)
    size = nd.Settings().size
    for n in (1, 2, 5, 40, 300, 9000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        assert (nd.sketch(a, size) != np.uint64(2**64 - 1)).all()
        assert (nd.sketch(a, size) == nd.sketch(a.copy(), size)).all()
    errors = []
    for share in (0.5, 0.85, 0.95):
        for _ in range(30):
            both = rng.integers(0, 2**63, int(600 * share))
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**63, (600 - len(both)) // 2)])).astype(np.uint64) for _ in (0, 1))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append((nd.sketch(a, size) == nd.sketch(b, size)).mean() - true)
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.05


def test_band_count_bounds_the_miss():
    for settings in (nd.Settings(), nd.Settings(5, 80)):
        assert (1 - (settings.percent / 100) ** nd.ROWS) ** settings.bands <= nd.MISS
        assert settings.size == nd.ROWS * settings.bands


def test_graph_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    edges = [(a, b) for a, b in edges if a != b]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    found = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.label for r in found.collect()} == label
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
