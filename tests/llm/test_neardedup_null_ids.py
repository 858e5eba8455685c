import random

from catalog_engine.llm import neardedup as nd


def test_near_copies_with_null_ids_are_linked(spark, words):
    rng = random.Random(31)
    say = lambda k: [rng.choice(words) for _ in range(k)]
    base, other = say(300), say(300)
    rows = [(None, " ".join(base)), (None, " ".join([*base, "more"])), (None, " ".join(say(300))),
            (7, " ".join(other)), (None, " ".join([*other, "more"])), (9, " ".join(say(300)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = [r.text for r in nd.keep_one(docs).collect()]
    assert len(left) == 4 and sum(t.startswith(rows[0][1]) for t in left) == 1
    assert rows[3][1] in left and rows[4][1] not in left
    assert sorted((r.component_id for r in nd.near_duplicates(docs).collect()), key=str) == [7, 7, 9, None, None, None]
