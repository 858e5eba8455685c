"""Filter interaction audit (operator 11): what each filter removes, by the order of filters.

Five filters give every document a mask of failures. Four of them (A to D) look at the text
alone. The fifth (E) marks texts that equal the text of a smaller id, by radix tries: texts go
to ranges of adaptive prefixes, longer where many bytes share a prefix, and each range
inserts its full texts into a compressed trie whose terminals hold the minimum id. A
traversal gives the flags. Masks are then counted by part, and every order of the filters is
read off the at most 32 counts of a part.

Copies before the shuffle: a task that has met a text with a smaller id knows a row's flag
already and sends no text for it, so a text that a third of all rows hold travels about once
for each task. Heavy prefixes are known by hash, one entry for half a range of input.

Defined cases: null texts and sources are empty ones; empty texts equal each other; a null id
is neither smaller than others nor fails E, and has no labels; rows that repeat an id count
each, and equal texts of one id don't mark each other; of several label rows of an id the
larger value counts; other columns aren't read; a text may be any length; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_engine.llm.common import map_slices, stored

FILTERS = "ABCDE"
DUPLICATE = 16
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITALS_PERCENT, SYMBOLS = 200, 50, 2, b"#$%&*|"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
POINT_STARTS = bytes(b for b in range(256) if not 0x80 <= b < 0xC0)
"""Bytes that start a code point."""

RANGE_BYTES, LEAST_RANGE_BYTES = 32 << 20, 1 << 20
"""Text bytes of one range, that is of one task's trie: no more than the first; less, down to the
second, where that gives the shuffle's partitions a range each."""
FIRST_LENGTH, LENGTH_FACTOR = 16, 4
"""Code points of the shortest adaptive prefix, and how much longer it gets in each round."""
SPARK_SEED = 42
OUT_ROWS = 8192


def text_mask(raw: bytes) -> int:
    """Failures of filters A to D (bits 0 to 3) of a text in UTF-8."""
    words = raw.split()  # bytes split at ASCII white space only
    n = len(words)
    points = len(raw) - len(raw.translate(None, POINT_STARTS))
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    return ((n < MIN_WORDS) | (100 * len(set(words)) < MIN_DISTINCT_PERCENT * n) << 1
            | (100 * capitals > MAX_CAPITALS_PERCENT * points) << 2
            | (len(raw.translate(None, SYMBOLS)) < len(raw)) << 3)


def _prefix_hash(head: str) -> int:
    """Spark's xxhash64 of a string."""
    value = xxhash.xxh64_intdigest(head.encode(), SPARK_SEED)
    return value - (1 << 64) if value >= 1 << 63 else value


def heavy_prefixes(texts: DataFrame, most: int) -> list[tuple[int, frozenset[int]]]:
    """(length, hashes) for each round: the prefixes of that length which more than `most` bytes
    of longer texts share. A round looks only at texts under the heavy prefixes of the last."""
    found, length, held = [], FIRST_LENGTH, texts.select("text")
    while True:
        head = F.xxhash64(F.substring("text", 1, length))
        sums = (held.where(F.length("text") > length).groupBy(head.alias("_head"))
                .agg(F.sum(F.octet_length("text").cast("long")).alias("_bytes")).where(F.col("_bytes") > most).select("_head"))
        hashes = frozenset(r[0] for r in sums.collect())  # at most input bytes / most of them
        if not hashes:
            return found
        found.append((length, hashes))
        held = held.where(head.isin(list(hashes)))
        length *= LENGTH_FACTOR


def adaptive_prefix(text: str, heavy: list[tuple[int, frozenset[int]]]) -> str:
    """The shortest prefix of a text, of the rounds' lengths, that is not heavy."""
    length = FIRST_LENGTH
    for length, hashes in heavy:
        if _prefix_hash(text[:length]) not in hashes:
            return text[:length]
    return text[:length * LENGTH_FACTOR] if heavy else text[:length]


ROWS = "doc_id long, part string, mask int, prefix string, text string"


def screened(docs: DataFrame, heavy: list[tuple[int, frozenset[int]]]) -> DataFrame:
    """(doc_id, part, mask, prefix, text) of every row: mask with A to D, and with E where this
    task has met the text under a smaller id. Prefix and text only where E is still open."""

    def make():
        seen: dict[bytes, list[int]] = {}  # digest -> [smallest id so far, mask]

        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            ids, sources, texts = (part.column(c).to_pylist() for c in ("doc_id", "part", "text"))
            out = [None] * len(ids)
            # ascending ids: of the copies in a slice only the first stays open
            for k in sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0)):
                doc, text = ids[k], texts[k]
                raw = text.encode()
                digest = hashlib.sha256(raw).digest()
                entry = seen.get(digest)
                if entry is None:
                    entry = [None, text_mask(raw)]
                    seen[digest] = entry
                if doc is None:
                    out[k] = (doc, sources[k], entry[1], None, None)
                elif entry[0] is not None and doc > entry[0]:
                    out[k] = (doc, sources[k], entry[1] | DUPLICATE, None, None)
                else:
                    entry[0] = doc
                    out[k] = (doc, sources[k], entry[1], adaptive_prefix(text, heavy), text)
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                              ["doc_id", "part", "mask", "prefix", "text"])

        return one

    return map_slices(docs, make, ROWS)


class Node:
    """A node of a compressed trie: the bytes of its edge, children by first byte, and at a
    terminal the minimum id and the rows that ended here."""

    __slots__ = ("edge", "children", "least", "rows")

    def __init__(self, edge: bytes):
        self.edge = edge
        self.children: dict[int, Node] = {}
        self.least: int | None = None
        self.rows: list[tuple] = []


def _common(text: bytes, at: int, edge: bytes) -> int:
    """Length of the common prefix of text[at:] and edge, by bisection over slices."""
    low, high = 0, min(len(text) - at, len(edge))
    while low < high:
        middle = (low + high + 1) // 2
        if text[at + low:at + middle] == edge[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class RadixTrie:
    """A compressed trie over bytes."""

    def __init__(self):
        self.root = Node(b"")

    def terminal(self, text: bytes) -> Node:
        """The node at which text ends; made, by splitting an edge where needed, if new."""
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
                return child
            if not text.startswith(child.edge, at):
                shared = _common(text, at, child.edge)
                upper = Node(child.edge[:shared])
                child.edge = child.edge[shared:]
                upper.children[child.edge[0]] = child
                node.children[text[at]] = child = upper
            node, at = child, at + len(child.edge)
        return node

    def insert(self, text: bytes, doc: int, row: tuple) -> None:
        end = self.terminal(text)
        end.least = doc if end.least is None else min(end.least, doc)
        end.rows.append(row)

    def terminals(self) -> Iterator[Node]:
        """All nodes that hold rows."""
        waiting = [self.root]
        while waiting:
            node = waiting.pop()
            if node.rows:
                yield node
            waiting.extend(node.children.values())


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range with E decided, after all its texts are in the trie."""
    trie = RadixTrie()
    for batch in batches:
        for doc, part, mask, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "mask", "text")), strict=True):
            trie.insert(text.encode(), doc, (doc, part, mask))

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int32()), strict=True)],
                                          ["doc_id", "part", "mask"])
    held = []
    for node in trie.terminals():
        held.extend((doc, part, mask | DUPLICATE if doc > node.least else mask) for doc, part, mask in node.rows)
        if len(held) >= OUT_ROWS:
            yield packed(held)
            held = []
    if held:
        yield packed(held)


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of every row: bit k of mask is set if filter FILTERS[k] fails."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = min(RANGE_BYTES, max(LEAST_RANGE_BYTES, total // partitions))
    known = stored(screened(rows, heavy_prefixes(rows, size // 2)), "audit-rows")
    ranges = max(1, math.ceil(total / size))
    open_rows = known.where(F.col("prefix").isNotNull()).repartitionByRange(ranges, "prefix")
    flagged = open_rows.select("doc_id", "part", "mask", "text").mapInArrow(_flag, "doc_id long, part string, mask int")
    return flagged.unionByName(known.where(F.col("prefix").isNull()).select("doc_id", "part", "mask"))


def _steps() -> Column:
    """(filter_order, step, bit, before) of every step of every order; before has the bits of
    the filters that come earlier."""
    bits = {c: 1 << k for k, c in enumerate(FILTERS)}
    rows = [(order, k + 1, bits[c], sum(bits[x] for x in order[:k]))
            for order in map("".join, permutations(FILTERS)) for k, c in enumerate(order)]
    return F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("bit"), F.lit(e).alias("before"))
                     for o, s, b, e in rows])


def interactions(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit's rows, from (doc_id, part, mask) and labels."""
    marks = (labels.groupBy(F.col("doc_id").cast("long").alias("_id"))
             .agg(F.max((F.col("quality") == 1).cast("long")).alias("_good"), F.max((F.col("toxic") == 1).cast("long")).alias("_toxic"))
             .where(F.col("_id").isNotNull()).withColumn("_salt", F.lit(0)))
    # null ids match nothing: spread them over the join's partitions
    salted = masked.withColumn("_salt", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id() % 1024).otherwise(0).cast("int"))
    joined = salted.join(marks, (F.col("doc_id") == F.col("_id")) & (salted["_salt"] == marks["_salt"]), "left")
    counts = joined.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_good"), F.lit(0)).alias("good"),
                                                F.coalesce(F.sum("_toxic"), F.lit(0)).alias("toxic"))
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("_counts"))  # at most 32 entries
    rows = parts.select("part", "_counts", F.explode(_steps()).alias("_step")).select("part", "_counts", "_step.*")

    def total(value, condition):
        return F.aggregate("_counts", F.lit(0).cast("long"), lambda acc, x: acc + F.when(condition(x["mask"]), value(x)).otherwise(F.lit(0).cast("long")))

    bit, before = F.col("bit"), F.col("before")
    fails, passed, lost = (lambda m: m.bitwiseAND(bit) != 0), (lambda m: m.bitwiseAND(before) == 0), (lambda x: x["n"])
    removed = lambda m: passed(m) & fails(m)
    # a filter comes first of a mask's k failures in 120 / k of the orders
    firsts = F.array(*[F.lit(math.factorial(len(FILTERS)) // k).cast("long") for k in range(1, len(FILTERS) + 1)])
    return rows.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        total(lost, lambda m: passed(m) & ~fails(m)).alias("kept"), total(lost, removed).alias("removed"),
        total(lost, lambda m: ~passed(m) & fails(m)).alias("redundant"), total(lost, lambda m: m == bit).alias("unique_fails"),
        total(lambda x: x["good"], removed).alias("good_lost"), total(lambda x: x["toxic"], removed).alias("toxic_lost"),
        total(lambda x: x["n"] * F.element_at(firsts, F.greatest(F.bit_count(x["mask"]), F.lit(1))), fails).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the five filters and step."""
    return interactions(masks(docs), labels)


def oracle() -> str:
    """DuckDB SQL for audit() over documents and labels."""
    letters = ", ".join(f"('{c}', {1 << k})" for k, c in enumerate(FILTERS))
    return f"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words,
                 min(doc_id) OVER (PARTITION BY text) AS least FROM texts),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
masked AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (len(words) < {MIN_WORDS})::INT + 2 * (100 * len(list_distinct(words)) < {MIN_DISTINCT_PERCENT} * len(words))::INT
         + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > {MAX_CAPITALS_PERCENT} * length(text))::INT
         + 8 * regexp_matches(text, '[#$%&*|]')::INT + {DUPLICATE} * coalesce(split.doc_id > least, false)::INT AS mask
  FROM split LEFT JOIN marks ON split.doc_id = marks.doc_id),
counts AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masked GROUP BY ALL),
letters(c, bit) AS (VALUES {letters}),
orders AS (SELECT a.c || b.c || d.c || e.c || f.c AS filter_order FROM letters a, letters b, letters d, letters e, letters f
           WHERE a.bit + b.bit + d.bit + e.bit + f.bit = 31 AND len(list_distinct([a.c, b.c, d.c, e.c, f.c])) = 5),
steps AS (SELECT filter_order, step, (SELECT bit FROM letters WHERE c = filter_order[step]) AS bit,
                 (SELECT coalesce(sum(bit), 0)::INT FROM letters WHERE contains(left(filter_order, step - 1), c)) AS earlier
          FROM orders, (SELECT unnest(range(1, 6))::INT AS step))
SELECT part, filter_order, step,
       coalesce(sum(n) FILTER (mask & (earlier | bit) = 0), 0)::BIGINT AS kept,
       coalesce(sum(n) FILTER (mask & earlier = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
       coalesce(sum(n) FILTER (mask & earlier <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant,
       coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
       coalesce(sum(good) FILTER (mask & earlier = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost,
       coalesce(sum(toxic) FILTER (mask & earlier = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost,
       coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (mask & bit <> 0), 0)::BIGINT AS shapley
FROM counts, steps GROUP BY part, filter_order, step"""
