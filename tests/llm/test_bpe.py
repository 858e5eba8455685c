import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from catalog_engine.llm import bpe, token_files
from catalog_engine.llm.common import scratch_path

PATH = bpe.word_bpe()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(encoder, texts):
    return [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)]


def naive_merge(vocab, word):
    """Repeated leftmost merge of the lowest rank, by a scan."""
    pairs = {k: (r, m) for k, r, m in zip(vocab.keys.tolist(), vocab.ranks.tolist(), vocab.merged[vocab.ranks].tolist(), strict=True)}
    symbols = [s for s in vocab.start([word.encode()])[0].tolist() if s >= 0]
    while True:
        found = [(pairs[a << 24 | b][0], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a << 24 | b in pairs]
        if not found:
            return symbols
        _, i = min(found)
        symbols[i:i + 2] = [pairs[symbols[i] << 24 | symbols[i + 1]][1]]


def test_segment_tree_equals_naive_merges(words):
    vocab = bpe.vocabulary(PATH)
    rng = random.Random(1)
    sample = words[:100] + ["".join(rng.choice("the ingaon").strip() or "a" for _ in range(rng.randint(1, 40))).replace(" ", "x") for _ in range(200)]
    found = vocab.encode_words(set(sample))
    for w in sample:
        assert np.frombuffer(found[w], "<u4").tolist() == naive_merge(vocab, w)


def test_texts_equal_library(library, small_rows):
    encoder = bpe.Encoder(bpe.vocabulary(PATH))
    rng = random.Random(2)
    parts = ["a", "the", "'s", "'", "é", "Σ", "İ", " ", "\n", "\x1c", "\x85", "1", "½", "!", "?", "🙂", "ing", "ß", "文", "<|endoftext|>", "<|"]
    texts = [r.text for r in small_rows.values()] + ["", " ", "x" * 5000, "ab" * 3000] + [
        "".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    expected = library.encode_batch(texts, add_special_tokens=False)
    found = ids(encoder, texts)
    assert found == [e.ids for e in expected]
    assert [encoder.vocab.decode(x) for x in found] == [library.decode(e.ids, skip_special_tokens=False) for e in expected]
    bpe_cache = bpe.CACHE_ENTRIES
    try:  # a table that is emptied again and again changes nothing
        bpe.CACHE_ENTRIES = 10
        assert ids(bpe.Encoder(bpe.vocabulary(PATH)), texts[:50]) == found[:50]
    finally:
        bpe.CACHE_ENTRIES = bpe_cache


def test_plain_text_round_trip():
    vocab = bpe.vocabulary(PATH)
    encoder = bpe.Encoder(vocab)
    text = "the quick brown fox jumps over 文 é🙂"
    assert vocab.plain_text(ids(encoder, [text])[0]).replace(" ", "") == text.replace(" ", "")


def test_query_on_odd_and_empty_tables(library, odd_docs, odd_rows, no_docs):
    def expected(i, text):
        e = library.encode(text or "", add_special_tokens=False).ids
        return (i, len(e), hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest(),
                hashlib.sha256(library.decode(e, skip_special_tokens=False).encode()).hexdigest())
    found = bpe.digests(odd_docs, PATH).collect()
    assert sorted(map(tuple, found), key=str) == sorted((expected(r[0], r[1]) for r in odd_rows), key=str)
    assert bpe.digests(no_docs, PATH).collect() == []


def file_rows(library, rows):
    out, start = [], 0
    for i, text in sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        e = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        out.append((i, start, len(e), zlib.crc32(e.tobytes())))
        start += len(e)
    return sorted(out, key=str)


def test_token_files_round_trip(library, small_docs, small_rows, odd_docs, odd_rows, no_docs):
    for docs, rows in ((small_docs, [(r.doc_id, r.text) for r in small_rows.values()]), (odd_docs, odd_rows)):
        assert sorted(map(tuple, token_files.round_trip(docs, PATH).collect()), key=str) == file_rows(library, rows)
    assert token_files.round_trip(no_docs, PATH).collect() == []


def test_token_files_random_access(spark, library, small_docs, small_rows):
    folder = scratch_path(spark, "test-files")
    manifest = token_files.write(small_docs, PATH, folder, length=64).where("n_docs > 0").collect()
    for m in manifest:
        reader = token_files.Reader(folder, m.path)
        stream = np.concatenate([ids for ids in reader.ids(0, m.n_ids)])
        index = [row for batch in reader.documents() for row in batch.to_pylist()]
        for row in index[::7]:
            expected = [*library.encode(small_rows[row["doc_id"]].text, add_special_tokens=False).ids, 2]
            assert stream[row["start"]:row["start"] + row["n_tokens"]].tolist() == expected
        last = -(-m.n_ids // 64) - 1
        for i in (0, last // 2, last):
            ids_view, mask = reader.sequence(i)
            used = min(64, m.n_ids - 64 * i)
            assert ids_view[:used].tolist() == stream[64 * i:64 * i + used].tolist()
            assert mask.to_pylist() == [True] * used + [False] * (64 - used)


def test_every_code_point_as_the_library(library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"ab{c}cd 1{c}2 " for c in points[at:at + 2048]) for at in range(0, len(points), 2048)]
    wanted = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    encoder = bpe.Encoder(bpe.vocabulary(bpe.word_bpe()))
    for text, ids in zip(texts, wanted, strict=True):
        assert np.frombuffer(encoder.encode([text])[0], dtype="<u4").tolist() == ids


def test_words_come_back_from_the_older_generation(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 50)
    asked = []
    vocab = bpe.vocabulary(bpe.word_bpe())
    encoder = bpe.Encoder(vocab, lambda words: asked.extend(words) or vocab.encode_words(words))
    plain = bpe.Encoder(vocab)
    for k in range(40):
        text = f"the same words, always. and word{k} {'x' * k} {' '.join(f'w{k}v{j}' for j in range(9))}"
        assert encoder.encode([text]) == [np.frombuffer(plain.encode([text])[0], "<u4").tobytes()]
        assert len(encoder.known.now) <= 60 and len(encoder.known_words.now) <= 60
    assert asked.count("always") == 1  # although the tables filled many times
