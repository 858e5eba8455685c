import pytest

import __spark_entry__ as entry
import corpus_pipeline as cp
from catalog_engine.llm import bpe, linededup, mixing, neardedup, toxicity
from catalog_engine.llm.common import stored


def test_one_query_for_each_operator():
    names = [n.split("_")[0] for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(names, key=lambda n: int(n[2:])) == [f"op{i}" for i in range(1, 14)]
    assert "pipeline" in entry.queries()
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "near_dedup", "source_mixing", "bpe"]


SF = "/root/testdata/sf0.01"  # smaller tables have too few toxic documents to learn from


@pytest.fixture(scope="module")
def steps(spark):
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in cp.STAGES:
        out.append(stored(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def test_stages_do_what_their_operators_say(spark, steps):
    docs, clean, lines, unique, mixed, encoded = steps
    assert all(x.columns == docs.columns for x in steps[1:-1])
    scores = toxicity.score(docs, toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    ids = lambda x: sorted(r.doc_id for r in x.select("doc_id").collect())
    assert ids(clean) == ids(scores.where("predicted = 0")) and clean.count() < docs.count()
    texts = lambda x: {r.doc_id: r.text for r in x.collect()}
    assert texts(lines) == texts(linededup.dedup(clean))
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    assert ids(unique) == ids(neardedup.near_duplicates(lines, cp.NEAR).where("kept")) and unique.count() < lines.count()
    assert ids(mixed) == ids(mixing.selection(unique, share_percent=90, max_epochs=1).where("copies > 0"))
    assert {(r.doc_id, r.n_tokens) for r in encoded.collect()} == {(r.doc_id, r.n_tokens) for r in bpe.digests(mixed, bpe.word_bpe()).collect()}


def test_odd_rows_pass_all_stages(spark, odd_rows, sf_small):
    docs = spark.createDataFrame(odd_rows, "doc_id long, text string, lang string, source string, n_chars long")
    for rows in (docs, docs.limit(0)):
        for name, stage in cp.STAGES:
            rows = stored(stage(spark, rows, sf_small), f"odd-{name}")
        assert rows.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256"]
