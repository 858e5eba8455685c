import random
import re

import pyarrow as pa

from catalog_engine.llm import linededup as ld

PIECES = ["a", "b", "ä", "1", "7", "٣", " ", " ", " ", "\x85", "\xa0", " ", "　", "\n", "\t", "\x1c", "\r", "<*>", "“", "€", "😀"]


def plain(texts):
    """(row, line, tokens) of every line that isn't blank."""
    for row, text in enumerate(texts):
        for i, line in enumerate(text.split("\n")):
            raw = line.split()
            tokens = ["<*>" if re.search(r"\d", t) else t for t in raw] if len(raw) >= 3 else raw
            if tokens:
                yield row, i, tokens


def runs(tokens):
    """The parts of a line, and the tokens that name its leaves."""
    n = len(tokens)
    if n < 8:
        half = n // 2
        return [(t,) for t in tokens], [tuple(tokens[:half]), tuple(tokens[half:])] if n > 3 else [tuple(tokens)]
    cuts = [0] + [3 + (n - 3) * k // 4 for k in range(5)]
    blocks = [tuple(tokens[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    return blocks, [b[:3] for b in blocks[:3]]


def one_to_one(keys, hashes):
    pairs = set(zip(keys, hashes, strict=True))
    return len(pairs) == len({k for k, _ in pairs}) == len({h for _, h in pairs})


def test_lines_of_texts_equal_a_plain_parser():
    rng = random.Random(31)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.choice([0, 1, 5, 50, 300]))) for _ in range(2000)]
    texts += ["x" * 50_000 + " y", " ".join("w%d" % (i % 7) for i in range(20_000)), "\n" * 30]
    row, line, n, named, parts = ld.text_lines(pa.array(["left out", *texts]).slice(1))
    expected = list(plain(texts))
    assert list(zip(row.tolist(), line.tolist(), n.tolist(), strict=True)) == [(r, i, len(t)) for r, i, t in expected]
    found = [runs(t) for *_, t in expected]
    assert one_to_one([p for x, _ in found for p in x], parts.tolist())
    assert one_to_one([p for _, x in found for p in x], named.tolist())


def test_stretches_do_not_change_hashes(monkeypatch):
    texts = pa.array([" ".join("word%s" % chr(97 + i % 26) for i in range(k)) for k in (3, 9, 500, 1)])
    whole = [x.tolist() for x in ld.text_lines(texts)]
    monkeypatch.setattr(ld, "PARSE_BYTES", 16)
    assert [x.tolist() for x in ld.text_lines(texts)] == whole


def test_no_lines():
    for texts in ([], ["", ""], ["\n \n"], [" \x85"]):
        assert all(len(x) == 0 for x in ld.text_lines(pa.array(texts, pa.string())))
