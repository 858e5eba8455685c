"""Language-model scoring (operator 10): stupid backoff, computed relationally.

Documents fall into blocks by a hash of the row. Each block explodes its n-grams of all orders
once, with their counts, and deals them out by hash. In each hash partition the blocks' rows
are summed to the count table of the whole corpus and joined back to the n-grams that each
block sent: the totals return to their block, which sums the scores of its documents. So an
n-gram moves once for each block that has it, however often it occurs, and a frequent n-gram
is no more work than a rare one.

A document is scored by the rest of the corpus: its own counts are subtracted. With c' for
those counts, a word after its context scores c'(context word) / c'(context) at the longest
order whose n-gram occurs elsewhere, times BACKOFF for each order given up; a word that no
other document has scores BACKOFF ** order / (N' + 1), N' the number of words elsewhere.

Words are lower-cased (A-Z) runs without ASCII white space; n-grams are compared by 64-bit
hashes. The order is a parameter; the registered query uses 3. Buckets are ranges of hashes, one for
BLOCK_BYTES of input or less; n-grams and counts move packed, texts compressed, those of a slice that
go to one block together. Texts of a block are scored by slices, with one sort of n-grams for each order.

Defined cases: null and empty texts score 0 over 0 words; a single document scores every word
as unknown; a text may be any length; copies of a document count as other documents; repeated
rows give repeated rows; an empty table gives no rows.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog_engine.llm.common import id_text, map_slices, slices
from catalog_engine.llm.neardedup import mix

BACKOFF = 0.4
BLOCK_BYTES = 12 << 20
PACKED = pa.schema([("block", pa.int32()), ("ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int32())), ("texts", pa.binary())])
GRAMS = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())])
TOTALS = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("totals", pa.binary())])
SCORES = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_backoff", pa.int64()), ("log_score", pa.float64())])


def pack_texts(part: pa.RecordBatch) -> pa.RecordBatch:
    """A row for each block in a slice of documents: ids, where texts end in bytes, and all texts compressed."""
    part = part.take(pc.sort_indices(part.column("block")))
    block = part.column("block").to_numpy()
    cuts = np.flatnonzero(np.diff(block, prepend=-1, append=-1)).tolist() if len(block) else [0]
    sizes = pc.binary_length(part.column("text")).to_numpy()
    texts = [pa.compress("".join(part.column("text").slice(a, b - a).to_pylist()).encode(), codec="zstd", asbytes=True) for a, b in zip(cuts, cuts[1:], strict=False)]
    offsets = pa.array(cuts, pa.int32())
    ends = np.concatenate([np.zeros(0, np.int32), *(np.cumsum(sizes[a:b], dtype=np.int32) for a, b in zip(cuts, cuts[1:], strict=False))])
    return pa.RecordBatch.from_arrays(
        [pa.array(block[cuts[:-1]], pa.int32()), pa.ListArray.from_arrays(offsets, part.column("doc_id")),
         pa.ListArray.from_arrays(offsets, pa.array(ends, pa.int32())), pa.array(texts, pa.binary())], PACKED.names)


def unpack_texts(group: pa.Table) -> pa.RecordBatch:
    """(doc_id, text) of a block's documents."""
    texts = []
    for ends, data in zip(group.column("ends").to_pylist(), group.column("texts").to_pylist(), strict=True):
        offsets = np.array([0, *ends], dtype=np.int32)
        whole = pa.decompress(data, decompressed_size=ends[-1], codec="zstd")
        texts.append(pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(whole)))
    return pa.RecordBatch.from_arrays([group.column("ids").combine_chunks().flatten(), pa.concat_arrays(texts)], ["doc_id", "text"])


def block_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of some texts, one after another, and the number of words of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = lists.flatten()
    real = pc.not_equal(words, "")  # white space at a text's ends leaves empty pieces
    text_of = pc.list_parent_indices(lists).filter(real).to_numpy()
    coded = words.filter(real).dictionary_encode()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return hashes[coded.indices.to_numpy()], np.bincount(text_of, minlength=len(texts))


def block_grams(hashes: np.ndarray, place: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order from 1 on, the places (in the block) that end an n-gram and its hashes there;
    place is each word's place in its text."""
    scrambled, grams = mix(hashes), np.zeros(len(hashes), dtype=np.uint64)
    for k in range(1, order + 1):
        # the n-gram ending here: the one of order k - 1 that ends a word earlier, and this word
        grams = mix((grams if k == 1 else np.concatenate([grams[:1], grams[:-1]])) + np.uint64(k) + scrambled)
        at = np.flatnonzero(place >= k - 1)
        yield at, grams[at]


def places(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text of each word and the word's place in it."""
    text_of = np.repeat(np.arange(len(lengths)), lengths)
    return text_of, np.arange(len(text_of)) - (np.cumsum(lengths) - lengths)[text_of]


def bucket_width(buckets: int) -> int:
    """Hashes in a bucket: each bucket is a range of hashes."""
    return -(-(1 << 64) // buckets)


def bucket_starts(grams: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket starts in sorted n-grams, and the end."""
    inner = np.arange(1, buckets, dtype=np.uint64) * np.uint64(bucket_width(buckets) % (1 << 64))
    return np.concatenate([[0], np.searchsorted(grams, inner), [len(grams)]])


def packed(x: np.ndarray) -> bytes:
    """Positive counts: a bit for each says whether it is above 1, then those that are, by byte
    planes without the planes that are all zero."""
    more = x[x > 1]
    width = (int(more.max(initial=0)).bit_length() + 7) // 8
    planes = more.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return struct.pack("<qB", len(x), width) + np.packbits(x > 1).tobytes() + planes.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    n, width = struct.unpack_from("<qB", data)
    above = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, 9), count=n).astype(bool)
    out = np.ones(n, dtype=np.uint64)
    if width:
        planes = np.frombuffer(data, np.uint8, offset=9 + (n + 7) // 8).reshape(width, -1)
        wide = np.zeros((planes.shape[1], 8), dtype=np.uint8)
        wide[:, :width] = planes.T
        out[above] = wide.reshape(-1).view("<u8")
    return out


def packed_grams(grams: np.ndarray, bucket: int, buckets: int) -> bytes:
    """Sorted distinct n-grams of one bucket: the low bytes of each as they are, and of the high
    parts, which rise slowly, a row of bits: one bit set for each n-gram, a zero for each step."""
    width, n = bucket_width(buckets), len(grams)
    rest = grams - np.uint64(bucket * width)
    gap = max(1, width // max(n, 1)).bit_length() - 1
    low = min(7, gap // 8 + (gap % 8 > 2))
    high = (rest >> np.uint64(8 * low)).astype(np.int64)
    bits = np.zeros(n + (int(high[-1]) if n else 0), dtype=bool)
    bits[high + np.arange(n)] = True
    return struct.pack("<qB", n, low) + rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :low].tobytes() + np.packbits(bits).tobytes()


def unpacked_grams(data: bytes, bucket: int, buckets: int) -> np.ndarray:
    n, low = struct.unpack_from("<qB", data)
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :low] = np.frombuffer(data, np.uint8, n * low, 9).reshape(n, low)
    high = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=9 + n * low))) - np.arange(n)
    return out.reshape(-1).view("<u8") + (high.astype(np.uint64) << np.uint64(8 * low)) + np.uint64(bucket * bucket_width(buckets))


def _elsewhere(grams: np.ndarray, text_of: np.ndarray, known: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """c' of each n-gram occurrence: its total less the count of its own text."""
    if not len(grams):
        return np.zeros(0, dtype=np.int64)
    by = np.argsort(grams, kind="stable")  # occurrences of one n-gram stay in the order of texts
    sorted_grams, texts = grams[by], text_of[by]
    new_gram = np.concatenate([[True], sorted_grams[1:] != sorted_grams[:-1]])
    starts = np.flatnonzero(new_gram | np.concatenate([[True], texts[1:] != texts[:-1]]))
    own = np.diff(starts, append=len(grams))
    total = totals[np.searchsorted(known, sorted_grams[starts])]
    out = np.empty(len(grams), dtype=np.int64)
    out[by] = np.repeat(total - own, own)
    return out


def score_texts(hashes: np.ndarray, lengths: np.ndarray, order: int, known: np.ndarray, totals: np.ndarray,
                all_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Words that backed off, and log score, of each text, from the totals of known n-grams."""
    text_of, place = places(lengths)
    words_left = (all_words - lengths)[text_of]
    score = math.log(BACKOFF) * order - np.log(words_left + 1)  # as of a word that no other text has
    first = np.minimum(place + 1, order)  # the longest order at each place
    backed = np.ones(len(score), dtype=bool)
    context = words_left  # c' of the n-gram of order k - 1 that ends at a place; N' for the empty one
    for k, (at, grams) in enumerate(block_grams(hashes, place, order), 1):
        counts = _elsewhere(grams, text_of[at], known, totals)
        # each longer order that is found takes the place of the shorter ones
        found = counts > 0
        here, before = at[found], context[at[found] - (k > 1)]
        score[here] = np.log(counts[found]) - np.log(before) + math.log(BACKOFF) * (first[here] - k)
        backed[here] = first[here] != k
        context = np.zeros(len(score), dtype=np.int64)
        context[at] = counts
    return (np.bincount(text_of, weights=backed, minlength=len(lengths)).astype(np.int64),
            np.bincount(text_of, weights=score, minlength=len(lengths)))


def scores(docs: DataFrame, order: int = 2) -> DataFrame:
    """(doc_id, n_words, n_backoff, log_score, mean_log_score) of every document."""
    spark = docs.sparkSession
    rows = id_text(docs)
    size, all_words = rows.agg(F.sum(F.octet_length("text")), F.sum(F.regexp_count("text", F.lit("[^ \\t-\\r]+")))).first()
    blocks = max(1, math.ceil((size or 0) / BLOCK_BYTES))
    buckets = max(3 * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((size or 0) / BLOCK_BYTES), 1)
    placed = map_slices(rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")),
                        lambda: pack_texts, "block int, ids array<long>, ends array<int>, texts binary")

    def words_grams(group: pa.Table, **counts) -> tuple:
        """By slices of a block, the ids, words and lengths of texts; the block's distinct n-grams,
        sorted (and their counts); where buckets start."""
        parts = [(part.column("doc_id"), *block_words(part.column("text"))) for part in slices(unpack_texts(group), "text")]
        distinct = np.unique(np.concatenate([g for _, hashes, lengths in parts for _, g in block_grams(hashes, places(lengths)[1], order)]), **counts)
        return parts, distinct, bucket_starts(distinct[0] if counts else distinct, buckets)

    def explode(group: pa.Table) -> pa.Table:
        _, (grams, counts), starts = words_grams(group, return_counts=True)
        used = np.flatnonzero(np.diff(starts))
        part = {b: slice(starts[b], starts[b + 1]) for b in used.tolist()}
        return pa.table([pa.array(used, pa.int32()), pa.array([group.column("block")[0].as_py()] * len(used), pa.int32()),
                         pa.array([packed_grams(grams[s], b, buckets) for b, s in part.items()], pa.binary()),
                         pa.array([packed(counts[s]) for s in part.values()], pa.binary())], schema=GRAMS)

    def join_counts(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        sent = [unpacked_grams(b, bucket, buckets) for b in group.column("grams").to_pylist()]
        counts = np.concatenate([unpacked(b) for b in group.column("counts").to_pylist()])
        known, inverse = np.unique(np.concatenate(sent), return_inverse=True)
        totals = np.bincount(inverse, weights=counts, minlength=len(known)).astype(np.uint64)[inverse]
        ends = np.cumsum([len(s) for s in sent])
        return pa.table([group.column("block"), group.column("bucket"),
                         pa.array([packed(t) for t in np.split(totals, ends[:-1])], pa.binary())], schema=TOTALS)

    def score(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not group.num_rows:
            return SCORES.empty_table()
        parts, known, starts = words_grams(group)
        totals = np.zeros(len(known), dtype=np.int64)
        for bucket, found in zip(answers.column("bucket").to_pylist(), answers.column("totals").to_pylist(), strict=True):
            totals[starts[bucket]:starts[bucket + 1]] = unpacked(found)
        out = [pa.table([ids, pa.array(lengths, pa.int64()), *score_texts(hashes, lengths, order, known, totals, all_words)], schema=SCORES)
               for ids, hashes, lengths in parts]
        return pa.concat_tables(out)

    exploded = placed.groupBy("block").applyInArrow(explode, "bucket int, block int, grams binary, counts binary")
    answers = exploded.groupBy("bucket").applyInArrow(join_counts, "block int, bucket int, totals binary")
    out = placed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        score, "doc_id long, n_words long, n_backoff long, log_score double")
    return out.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).otherwise(0.0))
