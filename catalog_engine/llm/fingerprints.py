"""Document fingerprints (operator 1): prefix polynomial hashes.

A text's fingerprint is its array of modular prefix hashes, in two lanes modulo 2^31 - 1.
Differences of two entries answer whether any two spans are equal; a binary search over
span lengths finds the longest common extension of two places. The string column is the
digest of that array: the length and the last entry of each lane.

Likeness of two fingerprints, from 0 to 1: the longest common prefix and suffix (by
extension queries) and, of the stretch between them, the share of sampled spans of 24 code
points that the other text's stretch holds as well; relative to the longer text.

Neighbours in document order meet without a global sort: ids are cut into ranges at ids that
occur, each range is one partition, and the first row of a range is also sent to the range
before it (the first of all to the last).

Defined cases: null texts count as empty; two empty texts are alike (1), an empty one and
another are not (0); texts under four code points keep all their text when edited; rows of
one id follow each other by text, null ids come first; a single document is its own next.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_engine.llm.common import id_text, slices

PRIME = (1 << 31) - 1
#: Two fixed multipliers under PRIME, one for each lane.
BASES = (1_103_515_245, 1_664_525_069)
SPAN = 24
SAMPLE = 8
"""One of so many spans is sampled, chosen by its hash, so that equal spans are chosen alike."""


LOW, SHIFT = np.uint64(PRIME), np.uint64(31)


def _fold(x: np.ndarray) -> np.ndarray:
    """A number under 2^33 that equals x modulo the prime; x is overwritten."""
    high = x >> SHIFT
    x &= LOW
    x += high
    return x


def _reduce(x: np.ndarray) -> np.ndarray:
    """x modulo the Mersenne prime; x is overwritten."""
    x = _fold(_fold(x))
    return np.subtract(x, LOW, out=x, where=x >= LOW)


@lru_cache(maxsize=4)
def _powers(size: int) -> np.ndarray:
    """Powers of both bases, then of their inverses, up to a size that is a power of two."""
    factors = [*BASES, *(pow(base, -1, PRIME) for base in BASES)]
    out = np.ones((4, size), dtype=np.uint64)
    for lane, step in enumerate(factors):
        done = 1
        while done < size:
            out[lane, done:2 * done] = _reduce(out[lane, :done] * np.uint64(step))
            done, step = 2 * done, step * step % PRIME
    return out


class Prefixes:
    """Prefix hashes of a text; of one that begins with the first keep code points of
    another, only the rest is hashed."""

    def __init__(self, text: str, base: Prefixes | None = None, keep: int = 0):
        codes = np.frombuffer(text[keep:].encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        self.n = keep + len(codes)
        self.power = _powers(1 << max(17, self.n.bit_length()))
        self.sums = np.zeros((2, self.n + 1), dtype=np.uint64)
        if base is not None:
            self.sums[:, :keep + 1] = base.sums[:, :keep + 1]
        codes += np.uint64(1)
        terms = _fold(codes * self.power[:2, keep:self.n])
        terms[:, :1] += self.sums[:, keep:keep + 1][:, :terms.shape[1]]
        self.sums[:, keep + 1:] = _reduce(np.cumsum(terms, axis=1))
        self.lanes = [memoryview(row) for row in self.sums]
        self._sample = None

    def digest(self) -> str:
        return f"{self.n:x}-{int(self.lanes[0][self.n]):08x}{int(self.lanes[1][self.n]):08x}"

    def spans(self, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the sampled SPAN-long spans inside [start, stop). A hash does
        not depend on the span's place; the first lane decides on the sample."""
        count = max(0, stop - SPAN + 1 - start)
        low = self.sums[0, start + SPAN:start + SPAN + count] + LOW
        low -= self.sums[0, start:start + count]
        low *= self.power[2, start:start + count]
        low = _reduce(low)
        chosen = np.flatnonzero((low & np.uint64(SAMPLE - 1)) == 0)
        places = chosen + start
        high = (self.sums[1, places + SPAN] + LOW - self.sums[1, places]) * self.power[3, places]
        return places, low[chosen] << SHIFT | _reduce(high)

    def sample(self, start: int, stop: int) -> set[int]:
        """Distinct sampled span hashes inside [start, stop). A stretch of most of the text is
        taken from the whole text's sample, which is kept."""
        if self._sample is None and stop - start > self.n // 2:
            self._sample = self.spans(0, self.n)
        places, hashes = self._sample or self.spans(start, stop)
        return set(hashes[(places >= start) & (places <= stop - SPAN)].tolist())


def _span_test(a: Prefixes, b: Prefixes, lift: int):
    """The test, by hashes, whether a[i:i+length] == b[i+lift:i+lift+length]."""
    f0, f1 = (pow(base, abs(lift), PRIME) for base in BASES)
    if lift < 0:
        back = _span_test(b, a, -lift)
        return lambda i, length: back(i + lift, length)
    (a0, a1), (b0, b1) = a.lanes, b.lanes

    def test(i: int, length: int) -> bool:
        j = i + lift
        return not ((a0[i + length] - a0[i]) * f0 - (b0[j + length] - b0[j])) % PRIME and not (
            (a1[i + length] - a1[i]) * f1 - (b1[j + length] - b1[j])) % PRIME

    return test


def same_span(a: Prefixes, i: int, b: Prefixes, j: int, length: int) -> bool:
    return _span_test(a, b, j - i)(i, length)


def _longest(holds, most: int) -> int:
    """The largest length up to most for which holds() is true; it is true up to there."""
    low, high = 0, most
    while low < high:
        middle = (low + high + 1) // 2
        if holds(middle):
            low = middle
        else:
            high = middle - 1
    return low


def common_extension(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """Length of the longest common extension to the right of places i and j."""
    test = _span_test(a, b, j - i)
    return _longest(lambda length: test(i, length), min(a.n - i, b.n - j))


def common_suffix(a: Prefixes, b: Prefixes, most: int) -> int:
    """Length of the longest common extension to the left of both ends, most at most."""
    test = _span_test(a, b, b.n - a.n)
    return _longest(lambda length: test(a.n - length, length), most)


def likeness(a: Prefixes, b: Prefixes) -> float:
    longest = max(a.n, b.n)
    if not longest or not min(a.n, b.n):
        return float(not longest)
    head = common_extension(a, 0, b, 0)
    tail = common_suffix(a, b, min(a.n, b.n) - head)
    between = longest - head - tail
    if min(a.n, b.n) - head - tail < SPAN:
        return (head + tail) / longest
    chosen = [x.sample(head, x.n - tail) for x in (a, b)]
    most = max(map(len, chosen))
    shared = len(chosen[0] & chosen[1]) / most if most else 0.0
    return (head + tail + between * shared) / longest


def edited(text: str, following: str) -> str:
    """The last quarter of a text's code points replaced by the first as many of the next."""
    quarter = len(text) // 4
    return text[:len(text) - quarter] + following[:quarter]


SCHEMA = ("doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def _range_of(bounds: list[int]) -> Column:
    """Number of the id range of a row: how many bounds are at most its id; 0 for a null id."""
    cuts = np.array(bounds, dtype=np.int64)

    @F.pandas_udf("int")
    def place(ids):
        import pandas as pd
        known = ids.notna()
        out = np.zeros(len(ids), dtype=np.int32)
        out[known] = np.searchsorted(cuts, ids[known].astype("int64"), side="right")
        return pd.Series(out)

    return place("doc_id")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows in document order inside partitions by id range, each range followed by the first
    row of the next one (ahead = true)."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = id_text(docs)
    ids = rows.select("doc_id")
    cuts = [i / parts for i in range(1, parts)] or [0.5]
    least, nulls, quantiles = ids.agg(
        F.min("doc_id"), F.count_if(F.col("doc_id").isNull()),
        F.percentile_approx("doc_id", cuts, 100 * parts)).first()
    bounds = sorted({q for q in quantiles or [] if q > least}) if parts > 1 else []
    first = F.col("doc_id").isNull() if nulls else F.col("doc_id") == (least if least is not None else 0)
    at = F.col("_range")
    before = F.when(first, len(bounds)).when(F.col("doc_id").isin(bounds), at - 1) if bounds else F.when(first, 0)
    places = F.array_compact(F.array(
        F.struct(at.alias("part"), F.lit(False).alias("ahead")),
        F.when(before.isNotNull(), F.struct(before.cast("int").alias("part"), F.lit(True).alias("ahead")))))
    return (rows.withColumn("_range", _range_of(bounds))
            .select("doc_id", "text", F.explode(places).alias("_at"))
            .select("doc_id", "text", "_at.part", "_at.ahead")
            .repartitionById(len(bounds) + 1, F.col("part"))
            .sortWithinPartitions("part", "ahead", F.col("doc_id").asc_nulls_first(), "text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness."""

    def pairs(batches):
        held = None  # the row whose next one is still to come
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for doc_id, text, ahead in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "ahead")), strict=True):
                    own = Prefixes(text)
                    if held is not None:
                        last_id, last_text, last = held
                        new_text = edited(last_text, text)
                        new = Prefixes(new_text, last, last.n - last.n // 4)
                        out.append((last_id, last.n, new_text, last.digest(), new.digest(), likeness(last, new), likeness(last, own)))
                    held = None if ahead else (doc_id, text, own)
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), ARROW, strict=True)], schema=ARROW)

    return with_next(docs).mapInArrow(pairs, SCHEMA)


ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_text", pa.string()), ("fingerprint", pa.string()),
                   ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def digests(docs: DataFrame) -> DataFrame:
    """The digest columns of every document."""
    return fingerprints(docs).select(
        "doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next")
