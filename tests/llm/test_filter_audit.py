import random
from collections import Counter
from itertools import permutations

import xxhash
from pyspark.sql import functions as F

from catalog_engine.llm import filter_audit as fa

BLANKS = " \t\n\x0b\x0c\r"


def words_of(text):
    for c in BLANKS:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute_masks(rows):
    """(doc_id, part, failing letters) of rows (doc_id, text, source)."""
    rows = [(i, t or "", s or "") for i, t, s in rows]
    out = []
    for i, t, s in rows:
        w = words_of(t)
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
               "D": any(c in "#$%&*|" for c in t), "E": i is not None and any(t == u and j is not None and j < i for j, u, _ in rows)}
        out.append((i, s, "".join(c for c in "ABCDE" if bad[c])))
    return out


def brute_audit(rows, labels):
    masked = brute_masks(rows)
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    out, shapley = {}, Counter()
    for part in {p for _, p, _ in masked}:
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in masked if r[1] == part]
            for step, c in enumerate(order, 1):
                gone = [r for r in left if c in r[2]]
                out[part, order, step] = [len(left) - len(gone), len(gone),
                                          sum(c in r[2] and any(x in r[2] for x in order[:step - 1]) for r in masked if r[1] == part),
                                          sum(r[2] == c for r in masked if r[1] == part), sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone)]
                shapley[part, c] += len(gone)
                left = [r for r in left if c not in r[2]]
    return {(p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


COLUMNS = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def check(docs, rows, labels, label_rows):
    found = fa.audit(docs, labels).select(*COLUMNS).collect()
    expected = brute_audit(rows, label_rows)
    assert len(found) == len(expected) and {tuple(r) for r in found} == expected


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    marks = [(4, 1, 0), (5, 1, 1), (5, 0, None), (None, 1, 1), (8, 0, 1), (77, 1, 1), (7, None, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").withColumn("part", F.lit(1)).withColumn("mask", F.lit(2))
    check(odd_docs, [(r[0], r[1], r[3]) for r in odd_rows], labels, marks)
    assert fa.audit(no_docs, labels).collect() == []
    check(odd_docs, [(r[0], r[1], r[3]) for r in odd_rows], labels.limit(0), [])


def random_rows(words, n, seed):
    rng = random.Random(seed)
    head = " ".join(rng.choice(words) for _ in range(400))
    texts = [head, head + " tail", head[:-3], "", "a", "A b"] + [" ".join(rng.choice(words) for _ in range(rng.choice((3, 150, 250)))) for _ in range(25)]
    return [(rng.choice((None, *range(n))), rng.choice((*texts, None)), rng.choice((None, "", "s", "t"))) for _ in range(n)]


def test_masks_of_copies_in_any_order(spark, words, monkeypatch):
    for seed in range(3):
        rows = random_rows(words, 150, seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
        monkeypatch.setattr(fa, "LEAST_RANGE_BYTES", (1 << 30, 20_000, 2_000)[seed])
        monkeypatch.setattr(fa, "RANGE_BYTES", (1 << 30, 20_000, 2_000)[seed])  # up to many ranges and rounds of prefixes
        found = sorted(((r.doc_id, r.part, "".join(c for k, c in enumerate("ABCDE") if r.mask >> k & 1)) for r in fa.masks(docs).collect()), key=str)
        assert found == sorted(brute_masks(rows), key=str)


def test_heavy_prefixes_lengthen(spark):
    common = "x" * 100
    rows = [(common + str(i) * 50,) for i in range(10)] + [(c * 200,) for c in "abc"]
    heavy = fa.heavy_prefixes(spark.createDataFrame(rows, "text string"), 500)
    assert [length for length, _ in heavy] == [16, 64] and all(len(h) == 1 for _, h in heavy)
    assert len({fa.adaptive_prefix(t, heavy) for t, in rows[:10]}) == 10 and fa.adaptive_prefix("a" * 200, heavy) == "a" * 16


def test_prefix_hash_is_sparks(spark):
    texts = ["", "a", "Ünï 文字 🙂", "x" * 1000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t")).collect()
    assert [r[0] for r in rows] == [fa._prefix_hash(t) for t in texts] and xxhash.xxh64_intdigest(b"", 42) >= 0


def test_trie_against_a_dictionary():
    rng = random.Random(4)
    trie, least = fa.RadixTrie(), {}
    for _ in range(3000):
        text = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) * rng.choice((1, 40))
        doc = rng.randint(0, 1000)
        trie.insert(text, doc, (text,))
        least[text] = min(doc, least.get(text, doc))
    assert {n.rows[0][0]: n.least for n in trie.terminals()} == least
    assert all({r[0] for r in n.rows} == {n.rows[0][0]} for n in trie.terminals())
    waiting = list(trie.root.children.values())
    while waiting:  # compressed: an inner node without rows branches
        node = waiting.pop()
        assert node.edge and (node.rows or len(node.children) > 1)
        waiting.extend(node.children.values())
