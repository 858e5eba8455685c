import re
from collections import Counter

from catalog_engine.llm import quality as q

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    inside = {i + k for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            sum(x in lines[:i] for i, x in enumerate(lines)) if len(lines) < 2000 else len(lines) - len(set(lines)), len(inside))


def test_base_counts_match_brute_force(small_docs, small_rows, odd_docs, odd_rows):
    for docs, rows in ((small_docs, [(r.doc_id, r.text) for r in small_rows.values()]), (odd_docs, odd_rows)):
        found = q.verdicts(docs).collect()
        assert sorted((tuple(r[:6]) for r in found), key=str) == sorted(((r[0], *brute(r[1])) for r in rows), key=str)
        for r in found:
            assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
            assert not (r.kept and r.base_failed)


def test_repeats_and_symbols():
    text = ("one two three four five six seven eight nine ten. " * 3 + "\n" + "x#|\n") * 2
    assert q.base_counts(text) == brute(text)


def test_line_rules():
    rules = q.Rules()
    fault = lambda line: q.line_fault(line, rules)
    assert fault("This is a plain sentence that ends.") is None
    assert fault('He said "so."') is None
    assert fault("A sentence that has no end") == "punctuation"
    assert fault("Home | News | Contact | About.") == "navigation"
    assert fault("All rights reserved.") == "boilerplate"
    assert fault("LOUD WORDS ALL THE WAY.") == "capitals"
    assert fault("###$$$ %%% x.") == "symbols"


def test_verdict_depends_on_what_is_lost():
    good = " ".join(["some", "plain", "words", "here"] * 1 + [f"w{i}" for i in range(30)]) + "."
    bad = "\n".join(f"Menu | Item | Entry {i} | x{i}" for i in range(20))
    rules = q.Rules()
    kept, words = q.clean_lines(good + "\n" + bad, rules)
    assert kept == [good] and words == 34
    rows = [(1, good), (2, good + "\n" + bad), (3, bad)]
    assert [len(q.clean_lines(t, rules)[0]) for _, t in rows] == [1, 1, 0]


def test_labels_agree(small_docs, spark, sf_small):
    found = q.verdicts(small_docs).join(spark.read.parquet(f"{sf_small}/labels.parquet"), "doc_id")
    rows = found.where("not base_failed").select("kept", "quality").collect()
    assert sum(r.kept == bool(r.quality) for r in rows) >= 0.95 * len(rows)


def test_empty(no_docs):
    assert q.verdicts(no_docs).collect() == []


def test_sql_twin(small_docs, sf_small):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_small}/documents.parquet')")
    found = q.verdicts(small_docs)
    expected = con.execute(q.oracle())
    order = [d[0] for d in expected.description]
    assert sorted(map(tuple, found.select(order).collect())) == sorted(expected.fetchall())
