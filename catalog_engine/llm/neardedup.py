"""MinHash near-dedup (operator 3): fast similarity sketching, banding, exact verification.

A document is the set of 64-bit hashes of its word shingles. Its sketch has t coordinates,
filled in rounds: in round i < t every element falls into a hashed bin with value (i, hash),
in round t + b bin b takes all elements; a bin keeps its smallest value, so every coordinate
fills, after about t log t placed elements, and agreement is concentrated around the
Jaccard similarity. Bands of five coordinates make buckets; their number leaves a pair at the
threshold a chance under 1e-8 to share none.

Work goes by classes of equal sets, so copies cost one row. Links between classes:

1. Every bucket sends its members to its smallest and largest node only (no pairs among the
   members). A member verifies the hub that its sketch agrees with best; components follow.
2. Buckets that still hold several components compare members of different components, in
   blocks of bounded size: by sketch, and by full set where the agreement is not 6.5 standard
   deviations below the threshold. A pair is compared in the first bucket that it shares.
   A block hands on only links that join components there, at most one for each member.

Verification compares the full sets. Pairs inside a component need no further check, so no
group is expanded into all its pairs, and no bucket is capped.

Defined cases: null and empty texts and texts without words have the empty set, no links and
their own id as component; texts may be any length; equal texts are one class; rows that
repeat a doc_id with another text are judged by their own text, and so are rows with a null id; a
null id can't be a component's smallest id unless all its ids are null; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_engine.llm.common import BATCH_ROWS, id_text, lists, map_slices, sifted, stored
from catalog_engine.llm.components import components

ROWS = 5
MISS = 1e-8
DEVIATIONS = 6.5
BLOCK = 512


@dataclass(frozen=True)
class Settings:
    """Words of a shingle and the least similarity of a link, in percent."""

    words: int = 3
    percent: int = 85

    @property
    def bands(self) -> int:
        return math.ceil(math.log(MISS) / math.log(1 - (self.percent / 100) ** ROWS))

    @property
    def size(self) -> int:
        return ROWS * self.bands

    @property
    def least_agreement(self) -> int:
        s = self.percent / 100
        return math.floor(self.size * (s - DEVIATIONS * math.sqrt(s * (1 - s) / self.size)))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler (two multiply-xorshift steps)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes. Words: bytes.split() and .lower() know ASCII only."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    out = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        out = mix(out) + hashes[k:k + len(out)]
    return np.unique(out)


@lru_cache(maxsize=4)
def _seeds(rounds: int) -> np.ndarray:
    return mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sketch(elements: np.ndarray, size: int) -> np.ndarray:
    """The coordinates of a set that isn't empty: round number and 52 hash bits."""
    empty = np.uint64(2**64 - 1)
    out, seeds = np.full(size, empty), _seeds(2 * size)
    at, together = 0, max(1, 2048 // len(elements))
    while at < size:
        rounds = np.arange(at, min(size, at + together), dtype=np.uint64)
        hashed = mix(elements[None, :] ^ seeds[at:at + len(rounds), None])
        bins = ((hashed & np.uint64(0xFFFFFFFF)) * np.uint64(size)) >> np.uint64(32)
        np.minimum.at(out, bins.ravel().astype(np.int64), (rounds[:, None] << np.uint64(52) | hashed >> np.uint64(12)).ravel())
        at += len(rounds)
        if (out != empty).all():
            return out
    for b in np.flatnonzero(out == empty):
        least = mix(elements ^ seeds[size + b]).min()
        out[b] = np.uint64(size + b) << np.uint64(52) | least >> np.uint64(12)
    return out


def buckets(coordinates: np.ndarray) -> np.ndarray:
    """One signed 64-bit bucket for each band, different from band to band."""
    bands = coordinates.reshape(-1, ROWS)
    out = _seeds(len(bands)).copy()
    for k in range(ROWS):
        out = mix(out ^ bands[:, k])
    return out.view(np.int64)


def sketches(docs: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, key, n, set, buckets, sketch) of every row; key is a hash of id and text, set a
    128-bit digest, null if empty."""
    kinds = [pa.int64(), pa.binary()]

    def make():
        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            n, digest, keys, short = [], [], [], []
            for text in part.column("text").to_pylist():
                elements = shingles(text, settings.words)
                n.append(len(elements))
                if not len(elements):
                    digest.append(None), keys.append(np.zeros(0, np.int64)), short.append(None)
                    continue
                digest.append(xxhash.xxh3_128_digest(elements.tobytes()))
                coordinates = sketch(elements, settings.size)
                keys.append(buckets(coordinates))
                short.append(mix(coordinates).astype(np.uint8).tobytes())
            return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(n, kinds[0]), pa.array(digest, kinds[1]),
                                               lists(keys, pa.int64()), pa.array(short, kinds[1])],
                                              ["doc_id", "key", "n", "set", "buckets", "sketch"])

        return one

    rows = id_text(docs).withColumn("key", F.xxhash64("doc_id", "text"))
    return map_slices(rows, make, "doc_id long, key long, n long, set binary, buckets array<long>, sketch binary")


def _sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame, settings: Settings) -> DataFrame:
    """(node, elements) of the given nodes, from one document of each class; dealt by node, so that joins by node need not move them again."""
    needed = stored(classes.join(nodes, "node").select("node", "key", "set"), "near-needed")
    # few of all texts: the others stay where they are
    rows = sifted(id_text(docs).withColumn("key", F.xxhash64("doc_id", "text")), "key", needed).join(needed, "key")

    def make():
        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            found = {}
            for node, digest, text in zip(*(part.column(c).to_pylist() for c in ("node", "set", "text")), strict=True):
                elements = shingles(text, settings.words)
                if xxhash.xxh3_128_digest(elements.tobytes()) == digest:  # not another row of that key
                    found[node] = elements.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), lists(list(found.values()), pa.int64())], ["node", "elements"])

        return one

    return map_slices(rows.select("node", "set", "text"), make, "node long, elements array<long>").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    with_sets = (pairs.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("_a")), "a")
                 .join(sets.select(F.col("node").alias("b"), F.col("elements").alias("_b")), "b"))
    inter = F.size(F.array_intersect("_a", "_b"))
    union = F.size("_a") + F.size("_b") - inter
    return stored(with_sets.where(100 * inter >= settings.percent * union).select("a", "b"), "near-links", batch_rows=BATCH_ROWS)


def _members(classes: DataFrame) -> DataFrame:
    """(node, bucket) of the buckets with several members. Of buckets with the same members only the
    first band's is kept: a pair is compared in the first bucket that it shares, and hubs are the same."""
    entries = classes.select("node", F.posexplode("buckets").alias("band", "bucket"))
    several = entries.groupBy("bucket").agg(F.min("node").alias("_low"), F.max("node").alias("_high")).where(F.col("_low") != F.col("_high"))
    several = stored(several.select("bucket"), "near-buckets")
    shared = stored(sifted(entries, "bucket", several).join(several, "bucket"), "near-shared")
    same = shared.groupBy("bucket").agg(F.min("band").alias("band"), F.count(F.lit(1)).alias("_n"), F.min("node").alias("_low"),
                                        F.max("node").alias("_high"), F.bit_xor(F.xxhash64("node")).alias("_mark"))
    first = same.groupBy("_n", "_low", "_high", "_mark").agg(F.min(F.struct("band", "bucket")).alias("_first")).select(F.col("_first.bucket").alias("bucket"))
    return stored(shared.select("node", "bucket").join(first, "bucket"), "near-members")


def _hub_pairs(classes: DataFrame, members: DataFrame, settings: Settings) -> DataFrame:
    """For each member the hub, among those of its buckets, that its sketch agrees with best."""
    hubs = members.groupBy("bucket").agg(F.min("node").alias("_low"), F.max("node").alias("_high"))
    pairs = (members.join(hubs, "bucket")
             .select("node", F.explode(F.array("_low", "_high")).alias("hub")).where(F.col("node") != F.col("hub")).distinct())
    side = classes.select("node", "n", "sketch")
    both = (pairs.join(side, "node")
            .join(side.select(F.col("node").alias("hub"), F.col("n").alias("_hub_n"), F.col("sketch").alias("_hub_sketch")), "hub"))
    fits = (100 * F.least("n", "_hub_n") >= settings.percent * F.greatest("n", "_hub_n"))
    agree = agreement("sketch", "_hub_sketch")
    best = (both.where(fits).withColumn("_agree", agree).where(F.col("_agree") >= settings.least_agreement)
            .groupBy("node").agg(F.max(F.struct("_agree", "hub")).alias("_best")))
    hub = F.col("_best.hub")
    return best.select(F.least("node", hub).alias("a"), F.greatest("node", hub).alias("b")).distinct()


def agreement(a: str, b: str) -> Column:
    """Coordinates in which two short sketches agree."""

    @F.pandas_udf("int")
    def agree(x, y):
        import pandas as pd
        if not len(x):
            return pd.Series([], dtype="int32")
        left, right = (np.frombuffer(b"".join(s), dtype=np.uint8).reshape(len(s), -1) for s in (x, y))
        return pd.Series((left == right).sum(axis=1).astype(np.int32))

    return agree(a, b)


def _block_links(docs: DataFrame, classes: DataFrame, members: DataFrame, labels: DataFrame, pairs: DataFrame, settings: Settings) -> DataFrame:
    """Links (a, b) between different components that share a bucket: enough of them to join
    the components that links join. Pairs that were verified need no second look."""
    known = members.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    mixed = (known.groupBy("bucket").agg(F.min("label").alias("_low"), F.max("label").alias("_high"), F.count(F.lit(1)).alias("_members"))
             .where(F.col("_low") != F.col("_high")).select("bucket", F.ceil(F.col("_members") / BLOCK).cast("int").alias("_blocks")))
    entries = stored(known.join(mixed, "bucket"), "near-mixed")
    own = F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")
    # two of its partners tell nearly all verified pairs: a member has few, though a hub may have many
    partner = F.when(F.col("node") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    verified = (pairs.select("a", "b", F.explode(F.array("a", "b")).alias("node")).select("node", partner.alias("_partner"))
                .groupBy("node").agg(F.min("_partner").alias("one"), F.max("_partner").alias("two")))
    side = classes.select("node", "n", "sketch", "buckets").join(verified, "node", "left").fillna(-1, ["one", "two"])
    spread = (entries.join(side, "node")
              .select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other"))
              .select("bucket", F.least("own", "_other").alias("low"), F.greatest("own", "_other").alias("high"), "own", "node", "label", "n", "one", "two", "sketch", "buckets"))
    in_blocks = lambda rows: rows.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    # by sketch first: only members of pairs whose sketches agree are compared by their sets
    kept = "bucket long, low int, high int, own int, node long, label long, n long, one long, two long, sketch binary, buckets array<long>"
    near = stored(in_blocks(spread).mapInArrow(lambda batches: _compare(batches, settings, _agreeing), kept), "near-agreeing", batch_rows=BATCH_ROWS)
    near = near.join(_sets(docs, classes, near.select("node").distinct(), settings), "node")
    return stored(in_blocks(near).mapInArrow(lambda batches: _compare(batches, settings, _group_links), "a long, b long"), "near-links", batch_rows=BATCH_ROWS)


def _compare(batches, settings: Settings, of):
    """What a function yields of groups of sorted rows, one after the other: members of one or two blocks of a bucket."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
        key = np.column_stack([held.column(c).to_numpy() for c in ("bucket", "low", "high")])
        starts = np.concatenate([[0], 1 + np.flatnonzero((key[1:] != key[:-1]).any(axis=1))]) if len(key) else np.zeros(1, int)
        for start, stop in zip(starts.tolist(), starts[1:].tolist(), strict=False):
            yield from of(held.slice(start, stop - start), settings)
        held = held.slice(int(starts[-1]))
    if held is not None and held.num_rows:
        yield from of(held, settings)


def _near_by_sketch(rows: pa.Table, label: np.ndarray, settings: Settings):
    """(i, others) of the members i of a group: those behind it, of other labels by now and not verified
    before, whose sketches agree with its own and that share no earlier bucket with it."""
    node, own, n, one, two = (rows.column(c).to_numpy() for c in ("node", "own", "n", "one", "two"))
    two_blocks = rows.column("low")[0] != rows.column("high")[0]
    bucket = rows.column("bucket")[0].as_py()
    marks = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), dtype=np.uint8).reshape(len(node), -1)
    bands = rows.column("buckets").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
    band = int(np.flatnonzero(bands[0] == bucket)[0])
    for i in range(len(node) - 1):
        others = np.arange(i + 1, len(node))
        fits = (label[others] != label[i]) & (100 * np.minimum(n[others], n[i]) >= settings.percent * np.maximum(n[others], n[i]))
        if two_blocks:
            fits &= own[others] != own[i]  # pairs inside a block are compared where it meets itself
        fits &= (one[others] != node[i]) & (two[others] != node[i]) & (node[others] != one[i]) & (node[others] != two[i])
        others = others[fits]
        others = others[(marks[others] == marks[i]).sum(axis=1) >= settings.least_agreement]
        others = others[(bands[others] == bands[i]).argmax(axis=1) == band]  # else an earlier bucket has the pair
        if len(others):
            yield i, others


def _agreeing(rows: pa.Table, settings: Settings):
    """The members of one block or of two whose sketches agree with another one's."""
    rows = rows.combine_chunks()
    label = rows.column("label").to_numpy()
    if (label == label[0]).all():
        return
    found = np.zeros(len(label), bool)
    for i, others in _near_by_sketch(rows, label, settings):
        found[i] = found[others] = True
    yield from rows.filter(pa.array(found)).to_batches()


def _group_links(rows: pa.Table, settings: Settings):
    """Verified links of one block or of two, without those inside a component."""
    rows = rows.combine_chunks()
    node, label, n = (rows.column(c).to_numpy() for c in ("node", "label", "n"))
    if (label == label[0]).all():
        return
    label = label.copy()
    elements = rows.column("elements").combine_chunks()
    flat, ends = elements.flatten().to_numpy().view(np.uint64), np.cumsum(elements.value_lengths().to_numpy())
    left, right = [], []
    for i, others in _near_by_sketch(rows, label, settings):
        mine = flat[ends[i] - n[i]:ends[i]]
        theirs = np.concatenate([flat[ends[j] - n[j]:ends[j]] for j in others.tolist()])
        at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
        both = np.add.reduceat((mine[at] == theirs).astype(np.int64), np.cumsum(n[others]) - n[others])
        for j in others[100 * both >= settings.percent * (n[others] + n[i] - both)].tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                left.append(min(node[i], node[j]))
                right.append(max(node[i], node[j]))
    if left:
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def groups(docs: DataFrame, settings: Settings = Settings(), among: DataFrame | None = None) -> DataFrame:
    """(doc_id, key, n, label, component_id) of every row, or of those whose id is among some: label
    numbers the component of a row whose set isn't empty, component_id is its smallest id."""
    rows = stored(sketches(docs, settings), "near-sketches", batch_rows=BATCH_ROWS)
    own = rows.select("doc_id", "key", "n", "set")
    marks = [F.first("buckets").alias("buckets"), F.first("sketch").alias("sketch")]
    names = [F.min("doc_id").alias("doc_id"), F.min("key").alias("key"), F.first("n").alias("n")]
    by_set = rows.where(F.col("set").isNotNull()).groupBy("set")
    if among is None:
        classes = by_set.agg(*names, *marks)
    else:  # the sketches meet by set only
        own = stored(own.join(among, "doc_id", "left_semi"), "near-own")
        classes = by_set.agg(*marks).join(own.where(F.col("set").isNotNull()).groupBy("set").agg(*names), "set")
    # numbered once and written, so numbers stay
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")
    members = _members(classes)
    mark = F.xxhash64("node").alias("_mark")
    side = stored(sifted(classes.select("*", mark), "_mark", members.select(mark)).drop("_mark"), "near-side")  # the others have no pairs
    pairs = stored(_hub_pairs(side, members, settings), "near-pairs")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    links = _verified(pairs, _sets(docs, side, nodes, settings), settings)
    more = _block_links(docs, side, members, components(links), pairs, settings)
    labels = components(links.unionByName(more))
    named = classes.select("node", "set", "doc_id").join(labels, "node", "left").select("set", "doc_id", F.coalesce("label", "node").alias("label"))
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    by_set = named.select("set", "label").join(smallest, "label")
    return own.join(by_set, "set", "left").select(
        "doc_id", "key", "n", "label", F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    return groups(docs, settings).select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                                         F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of docs without near duplicates: of each component the row of the smallest id
    stays (of rows equal in id and text one); rows with the empty set all stay."""
    found = groups(docs, settings)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))
    kept = found.where("n > 0").groupBy("label").agg(first.alias("_first")).select(F.col("_first.key").alias("_key"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("_row"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("_key"), (F.regexp_count(text, F.lit("[^ \\t-\\r]")) == 0).alias("_empty"))
    chosen = rows.where(~F.col("_empty")).join(kept, "_key", "left_semi").dropDuplicates(["_key"])
    return chosen.select("_row.*").unionByName(rows.where("_empty").select("_row.*"))
