import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# extra columns whose names the operators use themselves
CLASH = ("score ids key node label bucket n set sketch a b part ahead block grams totals copies domain "
         "epochs rest line template leaf tokens fingerprint kept _row _key _doc _lines _cut").split()


@pytest.fixture(scope="session")
def words():
    """A fixed small vocabulary."""
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(400)]


@pytest.fixture(scope="session")
def odd_rows(words):
    """Null and empty texts, null and repeated ids, copies, ties, one very long text."""
    rng = random.Random(6)
    say = lambda k: " ".join(rng.choice(words) for _ in range(k)) + "."
    base = say(60)
    long = "\n".join(say(50) for _ in range(600))
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, base), (5, base), (5, base), (6, base + " extra."), (7, say(80)),
             (7, say(70)), (None, say(40)), (None, None), (8, long), (9, "Ünï 文字 🙂 \x1c <|endoftext|> İΣ"), (10, "one two"), (11, "12 34 !!")]
    return [(i, t, [None, "en", "de"][k % 3], [None, "s1", "s2", ""][k % 4], None if t is None else len(t)) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    from pyspark.sql import functions as F
    docs = spark.createDataFrame(odd_rows, SCHEMA).repartition(3)
    return docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small_docs(spark, sf_small):
    return spark.read.parquet(f"{sf_small}/documents.parquet")


@pytest.fixture(scope="session")
def small_rows(small_docs):
    return {r.doc_id: r for r in small_docs.collect()}
