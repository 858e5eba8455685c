import os
import random

from catalog_engine.llm import common
from catalog_engine.llm import linededup as ld


def kept(spark, rows):
    return {r.doc_id: r.text for r in ld.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def lines_of(words, seed):
    rng = random.Random(seed)
    return lambda k: " ".join(rng.choice(words) for _ in range(k)) + "."


def test_mostly_template_is_cut_and_copies_count_once(spark, words):
    say = lines_of(words, 21)
    shared = [say(20) for _ in range(3)]
    own = {i: [say(20) for _ in range(2)] for i in range(12)}
    rows = [(i, "\n".join(own[i] + shared)) for i in own]  # 60 shared words, 40 own
    base = [say(12) for _ in range(20)]
    versions = {100 + k: [*base[:k], say(12), *base[k + 1:]] for k in range(6)}  # near copies of each other
    rows += [(i, "\n".join([*text, shared[0]])) for i, text in versions.items()]
    two = [say(12) for _ in range(4)]
    rows += [(200 + k, "\n".join([*two, say(300)][: 4 + (k == 3)])) for k in range(4)]  # three equal texts and one that holds them
    out = kept(spark, rows)
    assert all(out[i] == "\n".join(own[i]) for i in own)
    assert all(out[i] == "\n".join(text) for i, text in versions.items())  # whole but for the template
    assert [out[i] for i in range(200, 204)] == [t for i, t in rows if i >= 200]  # two different texts only


def test_null_ids_and_repeated_rows_count_by_text(spark, words):
    say = lines_of(words, 22)
    template = say(10)
    rows = [(None, f"{say(30)}\n{template}"), (1, f"{say(30)}\n{template}"), (1, f"{say(30)}\n{template}")]
    rows = rows + rows
    found = sorted(r.text for r in ld.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == sorted(t.split("\n")[0] for _, t in rows)


def test_minimum_follows_from_length(spark, words):
    say = lines_of(words, 23)
    passage, shorter = say(50), say(49)
    rows = []
    for i in range(70):
        lines = [say(15) for _ in range(4)]
        lines += [passage] * (i < 2) + [shorter] * (10 <= i < 12) + ["Read more"] * (i < 30) + ["Next"] * (i < 60)
        lines += ["Go back"] * (i < 29) + ["Home"] * (i < 59) + ["See all of it"] * (i < 15) + ["See all of them"] * (i < 14) + [f"page {i}"]
        rows.append((i, "\n".join(lines)))
    out = kept(spark, rows)
    gone = {passage, "Read more", "Next", "See all of it"}
    assert all(out[i] == "\n".join(x for x in t.split("\n") if x not in gone) for i, t in rows)


def test_fields_early_in_short_lines_and_in_two_places(spark, words):
    say = lines_of(words, 24)
    rng = random.Random(25)
    name = lambda: "".join(rng.choice("klmnopqrstu") for _ in range(9))
    rows = []
    for i in range(25):
        lines = [say(15) for _ in range(3)]
        if i < 3:
            lines.append(f"Welcome back to us dear {name()} you have new messages and some mail today from {name()}")
            lines.append(f"{name()} has left a new comment under the picture of {name()}, and you can answer here")
        if i < 10:
            lines.append(f"Posted by {name()} on Monday in Berlin")
        if i < 9:
            lines.append(f"Written by {name()} on Sunday in Paris")
        rows.append((i, "\n".join(lines)))
    out = kept(spark, rows)
    gone = ("Welcome", "Posted")
    assert all(out[i] == "\n".join(x for x in t.split("\n") if not x.startswith(gone) and " has left a new " not in x) for i, t in rows)


def test_only_the_list_of_drops_stays_stored(spark, words, tmp_path, monkeypatch):
    say = lines_of(words, 26)
    shared = say(12)
    docs = spark.createDataFrame([(i, f"{say(20)}\n{shared}") for i in range(6)], "doc_id long, text string")
    names = iter(range(1000))
    monkeypatch.setattr(common, "scratch_path", lambda spark, label: f"{tmp_path}/{label}-{next(names)}")
    tables = lambda: sorted(x.rsplit("-", 1)[0] for x in os.listdir(tmp_path))
    drops = ld.recurring_lines(docs)
    assert drops.count() == 6 and tables() == ["line-drops"]
    with common.passing() as outer:
        with common.passing():
            kept = common.stored(docs, "a", outer)
            common.stored(docs, "b")
        assert kept.count() == 6 and tables() == ["a", "line-drops"]
    assert tables() == ["line-drops"]
