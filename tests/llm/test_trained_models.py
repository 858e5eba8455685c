import itertools
import math
import zlib

import numpy as np

from catalog_engine.llm import languages, toxicity


def held(doc_id, divisor, remainder):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % divisor == remainder


# --- languages

def test_languages_of_held_out_documents(small_docs, small_rows):
    rows = languages.identify(small_docs).collect()
    assert len(rows) == len(small_rows) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == held(r.doc_id, 4, 2) for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == small_rows[r.doc_id].lang for r in out) >= 0.97 * len(out)


def test_vector_is_the_bundle_of_its_grams():
    p = languages.Profiler(64)
    packed, counts = languages.grams("Ab1c ab!")
    decoded = {"".join(chr(int(g) >> 21 * k & 0x1FFFFF) for k in (2, 1, 0)): int(c) for g, c in zip(packed, counts, strict=True)}
    assert decoded == {" ab": 2, "ab ": 2, "b c": 1, " c ": 1, "c a": 1}
    total = np.zeros(64)
    for gram, count in decoded.items():
        v = np.ones(64)
        for place, letter in enumerate(reversed(gram)):
            v = v * np.roll(languages.letter_vector(ord(letter), 64), place)
        total += count * v
    assert np.allclose(p.vector("Ab1c ab!"), total / np.linalg.norm(total), atol=1e-5)


def test_undetermined_and_unlabelled(odd_docs, no_docs, spark):
    rows = {(r.doc_id, r.lang_pred) for r in languages.identify(odd_docs).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (11, "und"), (None, "und")} <= rows
    assert languages.identify(no_docs).collect() == []
    bare = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in languages.identify(bare).collect()] == [(1, False, "und", 0.0)]


# --- toxicity

def sample(n=120):
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(200)]
    rows = []
    for i in range(n):
        words = list(rng.choice(vocabulary, 40))
        if i % 3 == 0:
            for w in rng.choice(["vilewort", "nastyling", "grubx" + "".join(rng.choice(list("abc"), 3))], 2):
                words.insert(int(rng.integers(0, 40)), str(w))
        rows.append(([str(w) for w in words], int(i % 3 == 0)))
    return rows


def test_marginals_equal_enumeration():
    model = toxicity.fit(sample())
    assert {"vilewort", "nastyling"} <= {e.rstrip("*") for e in model.lexicon} | {w for w in ("vilewort", "nastyling") if any(e in model.lexicon for e in toxicity.entries(w))}
    for f in ([0], [1, 0], [0, 1, 0, 2, 0, 0], [2, 2, 1, 0]):
        mass = np.zeros((len(f), 2))
        for tags in itertools.product((0, 1), repeat=len(f)):
            w = model.start * tags[0] + sum(model.emission[x] * y for x, y in zip(f, tags, strict=True))
            w += sum(model.change[a, b] for a, b in zip(tags, tags[1:], strict=False))
            for t, y in enumerate(tags):
                mass[t, y] += math.exp(w)
        assert np.allclose(toxicity.marginals(model, np.array(f)), mass[:, 1] / mass.sum(1))


def test_scan_on_long_chains():
    model = toxicity.fit(sample())
    f = np.zeros(50_000, dtype=np.int64)
    f[[10, 40_000]] = 1
    p = toxicity.marginals(model, f)
    assert np.isfinite(p).all() and p[10] > 0.5 and p[40_000] > 0.5 and p[20_000] < 0.1


def test_fit_separates_and_generalises_stems():
    model = toxicity.fit(sample())
    scorer = toxicity.Scorer(model)
    bad, spans = scorer.row("abcde grubxzzz fghij, Vilewort!")
    good, none = scorer.row("abcde fghij")
    assert bad > 0.5 > good and none == []
    assert [("abcde grubxzzz fghij, Vilewort!")[s["start"]:s["stop"]] for s in spans] == ["grubxzzz", "Vilewort"]


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.tag(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == held(r.doc_id, 5, 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held_out = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.toxic for r in held_out) >= 0.95 * len(held_out)
    assert not [r.doc_id for r in rows if r.predicted and not r.toxic]


def test_odd_tables(odd_docs, no_docs, spark):
    labels = spark.createDataFrame([(4, 1), (5, 1), (6, 1), (7, 0), (8, 0), (99, 1), (None, 1), (10, None)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0)):
        out = toxicity.tag(odd_docs, known).collect()
        assert len(out) == odd_docs.count() and all(0 <= r.score <= 1 for r in out)
    assert toxicity.tag(no_docs, labels).collect() == []
    kept = toxicity.keep_clean(odd_docs, toxicity.Model())
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
