"""Rows that cannot match stay where they are; templates that decide nothing are not counted."""

import random
from contextlib import redirect_stdout
from io import StringIO

from pyspark.sql import functions as F

from catalog_engine.llm import common
from catalog_engine.llm import linededup as ld
from catalog_engine.llm import neardedup as nd


def test_sifted_rows_hold_all_matches_and_move_nothing(spark):
    rows = spark.range(20_000).select(F.xxhash64("id").alias("key"))
    keys = rows.where("key % 10 = 0")
    found, rest = (common.sifted(rows, "key", keys, how) for how in ("left_semi", "left_anti"))
    assert keys.subtract(found).count() == 0 and found.count() < keys.count() + 100
    assert found.count() + rest.count() == 20_000 and common.sifted(rows, "key", keys.limit(0)).count() == 0
    out = StringIO()
    with redirect_stdout(out):
        found.explain()
    assert "BroadcastHashJoin" in out.getvalue() and "SortMergeJoin" not in out.getvalue()


def test_full_sieve_lets_all_rows_pass(spark, monkeypatch):
    monkeypatch.setattr(common, "SIEVE_BITS", 6)
    rows = spark.range(3000).select(F.xxhash64("id").alias("key"))
    assert common.sifted(rows, "key", rows.limit(2000)).count() == 3000


def test_templates_that_decide_nothing_are_not_counted():
    for n in (1, 2, 3, 5, 7, 8, 10, 15, 30, 49, 50, 80, 200):
        of, need = ld.kinds(n), ld.counted(n)
        for (_, fields, least), yes in zip(of, need, strict=True):
            others = [enough for (_, more, enough), also in zip(of, need, strict=True) if also and set(fields) < set(more)]
            assert yes or min(others) <= least
    assert all(ld.counted(7)) and sum(ld.counted(30)) == 10 and sum(ld.counted(200)) == 10


def test_lines_and_cut_move_no_text_of_other_documents(spark, words):
    """Only texts with lines to drop go through an exchange."""
    rng = random.Random(41)
    say = lambda k: " ".join(rng.choice(words) for _ in range(k)) + "."
    shared = say(12)
    rows = [(i, f"{say(30)}\n{shared}" if i < 4 else say(30)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cuts = {r["same"]: r["cut"] for r in ld.recurring_lines(docs).collect()}
    assert len(cuts) == 4 and all(c == [1] for c in cuts.values())
    assert {r.doc_id: r.text for r in ld.dedup(docs).collect()} == {i: t.split("\n")[0] for i, t in rows}


def test_buckets_of_the_same_members_count_once(spark):
    classes = spark.createDataFrame([(1, [11, 21, 31]), (2, [11, 21, 32]), (3, [12, 22, 31])], "node long, buckets array<long>")
    found = sorted((r.bucket, r.node) for r in nd._members(classes).collect())
    assert found == [(11, 1), (11, 2), (31, 1), (31, 3)]
