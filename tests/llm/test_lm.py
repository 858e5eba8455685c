import math
from collections import Counter

import pytest

from catalog_engine.llm import lm


def brute(rows, order):
    words = [(t or "").encode().lower().split() for _, t in rows]
    grams = lambda w, k: [tuple(w[i:i + k]) for i in range(len(w) - k + 1)]
    count = [None] + [Counter(g for w in words for g in grams(w, k)) for k in range(1, order + 1)]
    total, out = sum(map(len, words)), []
    for (doc, _), w in zip(rows, words, strict=True):
        own = [None] + [Counter(grams(w, k)) for k in range(1, order + 1)]
        score, backoff = 0.0, 0
        for p in range(len(w)):
            top = min(order, p + 1)
            for k in range(top, 0, -1):
                g = tuple(w[p - k + 1:p + 1])
                c = count[k][g] - own[k][g]
                if c > 0:
                    context = count[k - 1][g[:-1]] - own[k - 1][g[:-1]] if k > 1 else total - len(w)
                    score += math.log(c / context) + (top - k) * math.log(lm.BACKOFF)
                    backoff += k < top
                    break
            else:
                score += order * math.log(lm.BACKOFF) - math.log(total - len(w) + 1)
                backoff += 1
        out.append((doc, len(w), backoff, round(score, 4)))
    return sorted(out, key=str)


@pytest.mark.parametrize("order,block", [(2, 20_000), (3, 60_000)])
def test_scores_match_brute_force(small_docs, small_rows, monkeypatch, order, block):
    monkeypatch.setattr(lm, "BLOCK_BYTES", block)
    found = [(r.doc_id, r.n_words, r.n_backoff, round(r.log_score, 4)) for r in lm.scores(small_docs, order).collect()]
    assert sorted(found, key=str) == brute([(r.doc_id, r.text) for r in small_rows.values()], order)


def test_odd_and_empty_tables(odd_docs, odd_rows, no_docs, spark):
    found = [(r.doc_id, r.n_words, r.n_backoff, round(r.log_score, 4)) for r in lm.scores(odd_docs).collect()]
    assert sorted(found, key=str) == brute([(r[0], r[1]) for r in odd_rows], 2)
    assert lm.scores(no_docs).collect() == []
    one = spark.createDataFrame([(1, "a b a")], "doc_id long, text string")
    assert [(r.n_words, r.n_backoff) for r in lm.scores(one).collect()] == [(3, 3)]
