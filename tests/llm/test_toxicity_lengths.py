import numpy as np
import pytest

from catalog_engine.llm import toxicity as tx


def field(emission, start, change, curve=(-1.0, 0.4, 0.9)):
    return tx.Model({}, np.array([emission]), start, np.array(change), curve)


@pytest.mark.parametrize("model", [field(-4.0, -3.0, [[0.5, -1.0], [0.2, 1.0]]), field(-0.5, -0.2, [[0.0, 0.1], [-0.1, 0.3]]), tx.Model()])
def test_texts_without_lexicon_words_at_their_real_length(model):
    scorer = tx.Scorer(model)
    for n in (0, 1, 2, 3, 64, 65, 500, 5000, 7, 1024, 1025):
        whole = tx.document_score(model, tx.marginals(model, np.zeros(n, dtype=np.int64)))
        assert scorer.quiet_score(n) == pytest.approx(whole, rel=1e-9)
        assert scorer.row("word " * n) == (scorer.quiet_score(n), [])


def test_length_counts_where_marginals_do():
    model = field(-0.5, -0.2, [[0.0, 0.1], [-0.1, 0.3]])
    scores = [tx.Scorer(model).quiet_score(n) for n in (64, 640, 6400)]
    assert scores[0] < scores[1] < scores[2]


def test_repeated_ids_learn_from_the_first_text(spark):
    rows = [(i, f"{'vile' if i % 2 else 'kind'} words of number {i}") for i in range(1, 60)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    once = tx.learn(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    again = tx.learn(spark.createDataFrame([*rows, *((i, f"zz {t}") for i, t in rows)], "doc_id long, text string").repartition(5), labels)
    assert once.lexicon == again.lexicon and np.allclose(once.emission, again.emission) and once.curve == again.curve
