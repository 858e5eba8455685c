import hashlib
import re
from collections import defaultdict

import duckdb
import pytest

from catalog_engine.llm import mixing as mx


def fill(children, budget):
    """children: name -> (capacity, weight); shares by repeated rounds."""
    share, open_names = {}, set(children)
    while True:
        left = budget - sum(share.values())
        weights = sum(children[n][1] for n in open_names)
        full = {n for n in open_names if children[n][0] * weights <= children[n][1] * left}
        if not full:
            return share | {n: children[n][1] * left // weights for n in open_names}
        share |= {n: children[n][0] for n in full}
        open_names -= full
        if not open_names:
            return share


def brute(rows, weights, seed, percent, epochs):
    """rows: (doc_id, domain, lang, source, n_tokens); the copies of each."""
    supply = defaultdict(int)
    for r in rows:
        supply[r[1:4]] += r[4]
    budgets = {(): min(sum(supply.values()) * percent // 100, sum(supply.values()) * epochs)}
    for depth in (1, 2, 3):
        nodes = defaultdict(int)
        for leaf, s in supply.items():
            nodes[leaf[:depth]] += s * epochs
        for parent in {n[:-1] for n in nodes}:
            budgets |= fill({n: (c, weights.get(n, 1)) for n, c in nodes.items() if n[:-1] == parent}, budgets[parent])
    copies = []
    for r in rows:
        s, b = supply[r[1:4]], budgets[r[1:4]]
        whole, rest = divmod(b, s) if s else (0, 0)
        name = lambda i: hashlib.md5("|".join([str(seed), str(whole), *([] if i is None else [str(i)])]).encode()).hexdigest()
        upto = sum(x[4] for x in rows if x[1:4] == r[1:4] and name(x[0]) <= name(r[0]))
        copies.append((*r, whole + (upto <= rest)))
    return copies


def table_rows(rows):
    def path(source, lang):
        if not source:
            domain = "unknown"
        else:
            domain = ("web", "books", "forum")[ord(source[-1]) % 3]
        return domain, lang if lang is not None else "unknown", source if source is not None else "unknown"
    return [(r[0], *path(r[3], r[2]), len(re.findall(r"[^ \t-\r]+", r[1] or ""))) for r in rows]


@pytest.mark.parametrize("percent,epochs", [(60, 3), (90, 1), (250, 3), (1000, 2), (0, 1)])
def test_selection_matches_brute_force(small_docs, small_rows, percent, epochs):
    rows = table_rows([(r.doc_id, r.text, r.lang, r.source) for r in small_rows.values()])
    found = mx.selection(small_docs, share_percent=percent, max_epochs=epochs).collect()
    assert sorted(map(tuple, found)) == sorted(brute(rows, mx.WEIGHTS, mx.SEED, percent, epochs))


def test_sql_twin(spark, small_docs, sf_small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_small}/documents.parquet')")
    for percent, epochs in ((60, 3), (170, 2)):
        expected = con.execute(mx.oracle(share_percent=percent, max_epochs=epochs)).fetchall()
        assert sorted(map(tuple, mx.selection(small_docs, share_percent=percent, max_epochs=epochs).collect())) == sorted(expected)


def test_odd_tables(odd_docs, odd_rows, no_docs):
    found = mx.selection(odd_docs).collect()
    assert sorted(map(tuple, found), key=str) == sorted(brute(table_rows(odd_rows), mx.WEIGHTS, mx.SEED, 60, 3), key=str)
    assert mx.selection(no_docs).collect() == [] and mx.take(no_docs).collect() == []


def test_shortage_goes_to_siblings_first():
    # leaf a of domain x is short: its sibling b takes the rest of x's half
    rows = [(i, "x", "l", "a", 1) for i in range(2)] + [(10 + i, "x", "l", "b", 1) for i in range(50)] + [(100 + i, "y", "l", "c", 1) for i in range(50)]
    taken = defaultdict(int)
    for r in brute(rows, {}, 1, 40, 1):
        taken[r[3]] += r[5]
    assert taken == {"a": 2, "b": 18, "c": 20}


def test_take_repeats_rows(odd_docs):
    taken = mx.take(odd_docs, share_percent=250, max_epochs=3)
    copies = {(r.doc_id, r.n_tokens): r.copies for r in mx.selection(odd_docs, share_percent=250, max_epochs=3).collect()}
    assert taken.columns == odd_docs.columns
    assert taken.where("doc_id = 8").count() == copies[8, 30000]


def test_shuffle_join_of_a_long_plan(small_docs, monkeypatch):
    expected = sorted(map(tuple, mx.selection(small_docs).collect()))
    monkeypatch.setattr(mx, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, mx.selection(small_docs).collect())) == expected
