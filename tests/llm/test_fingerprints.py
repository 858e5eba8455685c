import hashlib
import os
import random

from catalog_engine.llm import fingerprints as fp


def test_extensions_and_digests_match_naive():
    rng = random.Random(3)
    common = lambda a, b: len(os.path.commonprefix([a, b]))
    for _ in range(800):
        letters = rng.choice(["ab", "a", "abcdefgh é🙂", "\x00a"])
        a = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        b = a[:rng.randint(0, 60)] + "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        x, y = fp.Prefixes(a), fp.Prefixes(b)
        i, j = rng.randint(0, len(a)), rng.randint(0, len(b))
        assert fp.common_extension(x, i, y, j) == common(a[i:], b[j:])
        assert fp.common_suffix(x, y, min(len(a), len(b))) == common(a[::-1], b[::-1])
        assert (x.digest() == y.digest()) == (a == b)
        likeness = fp.likeness(x, y)
        assert 0 <= likeness <= 1 and abs(likeness - fp.likeness(y, x)) < 1e-12
        if a == b:
            assert likeness == 1
    long = "".join(rng.choice("abc ") for _ in range(300_000))
    x, y = fp.Prefixes(long), fp.Prefixes(long[:200_000] + "Z" + long[200_001:])
    assert fp.common_extension(x, 0, y, 0) == 200_000 and fp.likeness(x, y) > 0.99


def test_extended_prefixes_equal_fresh_ones():
    a, b = fp.Prefixes("hello wide world"), fp.Prefixes("hello wide sea")
    c = fp.Prefixes("hello wide sea", a, 11)
    assert (b.sums == c.sums).all()


def brute(rows):
    rows = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        q = len(t) // 4
        new = t[:len(t) - q] + following[:q]
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), fp.Prefixes(t).digest(), fp.Prefixes(new).digest()))
    return out


def key(rows):
    return sorted(map(tuple, rows), key=str)


def test_query_matches_brute_force(small_docs, small_rows):
    out = fp.digests(small_docs).collect()
    assert key(r[:5] for r in out) == key(brute([(r.doc_id, r.text) for r in small_rows.values()]))
    assert all(r.near_edited >= 0.74 or r.n_chars < 40 for r in out)


def test_odd_and_empty_tables(odd_docs, odd_rows, no_docs, spark):
    assert key(r[:5] for r in fp.digests(odd_docs).collect()) == key(brute(odd_rows))
    assert fp.digests(no_docs).collect() == []
    one = spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")
    assert [r.n_chars for r in fp.digests(one).collect()] == [8]
