import random
import re
from collections import Counter, defaultdict

import numpy as np

from catalog_engine.llm import divergence as dv

PATTERN = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_docs, top):
    """All result rows over rows (text, lang, source)."""
    rows = [(PATTERN.findall((t or "").translate(LOWER)), g or "", s or "") for t, g, s in rows]
    holders, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for words, lang, source in rows:
        groups[lang].add(source)
        holders[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    for lang, sources in groups.items():
        kept = sorted((t for t, n in holders[lang].items() if n >= min_docs), key=lambda t: t.encode())
        total = Counter({t: sum(counts[lang, s][t] for s in sources) for t in kept})
        smooth = lambda c: {t: 1 + 10 ** 9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        p = {s: smooth(counts[lang, s]) for s in sources}
        q = smooth(total)
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources - {s}]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, r) for r, (value, item) in enumerate(items, 1) if part == "pair" or r <= top]
    return sorted(out)


def check(docs, rows, min_docs, top=50):
    found = sorted(tuple(r) for r in dv.audit(docs, min_docs, top).select("lang", "source", "part", "item", "value", "rank").collect())
    assert found == brute(rows, min_docs, top)
    return found


def test_odd_rows(odd_docs, odd_rows, no_docs):
    rows = [(r[1], r[2], r[3]) for r in odd_rows]
    for least in (1, 3, 100):  # 100: no term is kept, pairs have value 0
        found = check(odd_docs, rows, least)
    assert found and all(r[2] == "pair" and r[4] == 0 for r in found)
    assert dv.audit(no_docs).collect() == []


def test_many_groups_tiles_and_stripes(spark, words, monkeypatch):
    rng = random.Random(8)
    for tile, stripe in ((64, 1024), (5, 40)):
        monkeypatch.setattr(dv, "TILE_GROUPS", tile)
        monkeypatch.setattr(dv, "STRIPE_TERMS", stripe)
        rows = []
        for i in range(400):
            source = 0 if i % 3 == 0 else rng.randint(1, 90)  # one source holds a third
            own = words[source % 7::7]
            text = " ".join(rng.choice(own if rng.random() < 0.9 else words) for _ in range(rng.randint(0, 60)))
            rows.append((text.upper() if i % 5 == 0 else text, "xy"[i % 4 == 0], f"s{source}"))
        docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)
        check(docs, rows, 3, 7)


def test_letters_and_ties(spark):
    rows = [("É é É1 ß-ẞ AbC_abc ﬀ K İ", "en", "a"), ("é ab\x00c ab", "en", "b"), ("İ 文字 文字。", "en", "c"), ("", "en", "d"), (None, None, None)]
    check(spark.createDataFrame(rows, "text string, lang string, source string"), rows, 1)


def test_tree_traversal_against_dense_rows():
    rng = np.random.default_rng(5)
    for density in (0.0, 0.01, 0.3):
        for width in (64, 37, 1):
            sides = []
            for _ in range(2):
                base = rng.integers(1, 50, dv.SIDE)
                dense = np.repeat(base[:, None], dv.SIDE, axis=1)
                rows, columns = np.nonzero(rng.random((dv.SIDE, width)) < density)
                values = rng.integers(1, 1000, len(rows))
                dense[rows, columns] = values
                sides.append((base, dense, dv.build_tree(rows, columns, values, base, dv.SIDE)))
            (base_a, a, tree_a), (base_b, b, tree_b) = sides
            sums = np.zeros((dv.SIDE, dv.SIDE), dtype=np.int64)
            dv.add_differences(sums, tree_a, tree_b, base_a, base_b, width)
            assert (sums == np.abs(a[:, None, :width] - b[None, :, :width]).sum(axis=2)).all()


def test_large_counts_in_decimals(spark):
    row = spark.sql("SELECT 4000000000000 AS n, 900000000000000 AS total, 7L AS terms").select(dv.billionths("n", "total", "terms")).first()
    assert row[0] == 1 + 10 ** 9 * (4000000000000 + 5) // (900000000000000 + 35)
