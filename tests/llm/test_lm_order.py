import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from test_lm import brute

from catalog_engine.llm import lm, plans


def test_registered_query_has_order_three(spark, sf_small, small_rows):
    found = [(r.doc_id, r.n_words, r.n_backoff, round(r.log_score, 4)) for r in plans.QUERIES["op10_lm_scoring"](spark, sf_small).collect()]
    assert sorted(found, key=str) == brute([(r.doc_id, r.text) for r in small_rows.values()], 3)


def test_packed_numbers_come_back():
    rng = np.random.default_rng(3)
    for x in ([], [1], [1, 255], [256, 1, 2**32], [2**64 - 1, 1], [2] * 9):
        assert lm.unpacked(lm.packed(np.array(x, np.uint64))).tolist() == x
    grams = np.unique(np.concatenate([rng.integers(0, 2**64, 5000, dtype=np.uint64), np.array([0, 1, 2**64 - 1], np.uint64)]))
    for buckets in (1, 7, 36, 4096):
        starts = lm.bucket_starts(grams, buckets)
        back = [lm.unpacked_grams(lm.packed_grams(grams[a:b], k, buckets), k, buckets) for k, (a, b) in enumerate(zip(starts, starts[1:], strict=False))]
        assert len(back) == buckets and (np.concatenate(back) == grams).all()


def test_words_of_a_block():
    texts = ["", " \t\n", "A b\x0bA\x0c c\r", "\x1c ä\xa0Ä x", "  lead", "trail  "]
    hashes, lengths = lm.block_words(pa.array(texts))
    words = [t.encode().lower().split() for t in texts]
    assert lengths.tolist() == list(map(len, words))
    assert hashes.tolist() == [xxhash.xxh3_64_intdigest(w) for ws in words for w in ws]
    assert [len(x) for x in lm.block_words(pa.array([], pa.string()))] == [0, 0]


def test_texts_come_back_packed():
    rows = [(i, i % 3, t) for i, t in enumerate(["", "aä", "x" * 5000, "", "🙂", "b c", ""])] + [(None, 1, "no id")]
    part = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.string()), strict=True)], ["doc_id", "block", "text"])
    back = pa.Table.from_batches([lm.pack_texts(part)]).cast(lm.PACKED)
    assert back.column("block").to_pylist() == [0, 1, 2]
    for block in range(3):
        found = lm.unpack_texts(back.filter(pc.equal(back.column("block"), block)))
        assert [(i, t) for i, t in zip(*found.to_pydict().values(), strict=True)] == [(i, t) for i, b, t in rows if b == block]
    assert lm.pack_texts(part.slice(0, 0)).num_rows == 0
