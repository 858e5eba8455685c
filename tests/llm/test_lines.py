import math
import random
import re
from collections import defaultdict
from itertools import combinations

from pyspark.sql import functions as F

from catalog_engine.llm import linededup as ld


def least(fixed):
    """Documents that make a template of so many fixed tokens recur."""
    return 2 if fixed >= 50 else 3 if fixed >= 8 else math.ceil(60 / max(fixed, 1))


def templates(line):
    """{template: least documents} of a line, spelled out: a field is None."""
    raw = line.split()
    n = len(raw)
    tokens = ["<*>" if re.search(r"\d", t) else t for t in raw] if n >= 3 else raw
    if not n:
        return {}
    out = {(n, "", tuple(tokens)): least(n)}
    if 3 < n < 8:
        out |= {(n, k, tuple(tokens[:k] + tokens[k + 1:])): least(n - 1) for k in range(n)}
    if n >= 8:
        cuts = [0] + [3 + (n - 3) * k // 4 for k in range(5)]
        blocks = [tuple(tokens[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        for fields in [(k,) for k in range(5)] + list(combinations(range(5), 2)):
            kept = tuple(None if k in fields else b for k, b in enumerate(blocks))
            fixed = sum(len(b) for b in kept if b is not None)
            out[n, fields, kept] = min(3, least(fixed)) if len(fields) == 1 and fields != (0,) else least(fixed)
    return out


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def near_groups(docs):
    """A number for each document: documents linked by 0.8 of their shingles share it."""
    docs = sorted(docs, key=str)
    label, sets = list(range(len(docs))), [shingles(t) for _, t in docs]
    for a, b in combinations(range(len(docs)), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            label = [label[a] if x == label[b] else x for x in label]
    return dict(zip(docs, label, strict=True))


def brute(rows):
    """Rows (doc_id, text); the text of each after line dedup, by dictionaries."""
    docs = {(i, t or "") for i, t in rows}
    held = {d: {i: templates(x) for i, x in enumerate(d[1].split("\n"))} for d in docs}

    def recurring(lines, name):
        holders, need = defaultdict(set), {}
        for d, of in lines.items():
            for found in of.values():
                need |= found
                for t in found:
                    holders[t].add(name(d))
        return {d: {i: {t: m for t, m in found.items() if len(holders[t]) >= need[t]} for i, found in of.items()} for d, of in lines.items()}
    first = recurring(held, lambda d: d[1])
    groups = near_groups([d for d, of in first.items() if any(of.values())])
    second = recurring({d: first[d] for d in groups}, groups.__getitem__)
    return {d: "\n".join(x for i, x in enumerate(d[1].split("\n")) if not second.get(d, {}).get(i)) for d in docs}


def check(docs, rows):
    expected = brute(rows)
    found = sorted(((r.doc_id, r.text, r.n_lines - r.n_dropped) for r in ld.dedup(docs).collect()), key=str)
    wanted = sorted(((i, expected[i, t or ""], len(expected[i, t or ""].split("\n")) if expected[i, t or ""] else None) for i, t in rows), key=str)
    assert [x[:2] for x in found] == [x[:2] for x in wanted]
    assert all(x[2] == y[2] for x, y in zip(found, wanted, strict=True) if y[2])
    return found


def sentences(words, seed):
    rng = random.Random(seed)
    return rng, lambda k: " ".join(rng.choice(words) for _ in range(k)) + "."


def made_rows(words):
    rng, say = sentences(words, 9)
    rows = []
    for i in range(70):
        lines = [say(15) for _ in range(6)]
        if i < 10:
            lines.insert(2, f"Page {i} of this site was printed on 2020-01-{i:02d} for you, dear reader.")  # digits vary
        if i < 6:
            lines.insert(4, f"Dear friend of ours {rng.choice(words)} come and see the wide green hills again.")  # one word varies
        if i < 30:
            lines.append("Contact us today.")
        if i % 9 == 0:
            lines.append(f"{rng.choice(words)} is a member of ours")
        if i in (40, 41):
            lines.append("This passage of more than eight words is in two documents only, friends.")
        rows.append((i, "\n".join(lines)))
    whole = "\n".join(say(12) for _ in range(5))
    return rows + [(100 + k, whole + f" {k}" * (k == 2)) for k in range(5)] + [(None, rows[0][1]), (3, rows[3][1])]


def test_templates_recur_over_documents(spark, words):
    rows = made_rows(words)
    found = check(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    assert sum(n for *_, n in found) < sum(t.count("\n") + 1 for _, t in rows) - 40


def test_real_and_odd_tables(small_docs, small_rows, odd_docs, odd_rows, no_docs):
    check(small_docs, [(r.doc_id, r.text) for r in small_rows.values()])
    check(odd_docs, [(r[0], r[1]) for r in odd_rows])
    assert ld.dedup(no_docs).collect() == []


def test_columns_of_any_name_stay(spark, words):
    rows = made_rows(words)
    names = "doc _doc _cut _lines _dropped row key line lines cut same leaf template templates least label n_lines n_dropped".split()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.concat_ws(" ", F.lit(c), "doc_id") for c in names})
    out = ld.drop_lines(docs)
    assert out.columns == docs.columns
    expected = brute(rows)
    assert (sorted((tuple(r) for r in out.collect()), key=str)
            == sorted(((i, expected[i, t], *(c if i is None else f"{c} {i}" for c in names)) for i, t in rows), key=str))


def test_text_of_very_many_recurring_lines(spark, words):
    _, say = sentences(words, 11)
    lines = [say(9) for _ in range(20_000)]
    rows = [(i, "\n".join([*lines, say(30), *(say(40) for _ in range(9 * i))])) for i in range(3)]
    shorter = [(10 + i, "\n".join(lines[::2] + [say(12) for _ in range(20_000)])) for i in range(3)]
    found = {r.doc_id: r.text for r in ld.dedup(spark.createDataFrame(rows + shorter, "doc_id long, text string")).collect()}
    assert all(t.count("\n") == 19_999 and not set(t.split("\n")) & set(lines) for i, t in found.items() if i >= 10)
