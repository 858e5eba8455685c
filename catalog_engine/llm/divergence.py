"""Source divergence audit (operator 13): k²-trees over the group-term count matrix.

A group is a (language, source). Its row of the matrix holds its counts of the language's kept
terms. The matrix is cut into tiles of at most TILE_GROUPS groups (by hash of the source) by stripes of
about STRIPE_TERMS terms (by hash of the term); no numbering of groups or terms is needed.
In a tile the stripe's terms, commonest first, form squares of SIDE columns, each a k²-tree
(k = 2): a quadrant without a count is one empty node, a nonzero leaf holds LEAF x LEAF
smoothed probabilities. Two tiles of a stripe are traversed jointly, by row half, row half and
column half. Where both nodes are empty, all terms below have one probability for each group, so the
quadrant's share of every pair is width x |p0 - q0|; leaves are compared entry by entry. Tile pairs give partial sums of
pairs, which Spark adds up over the stripes.

Probabilities are whole numbers of billionths, 1 + floor(10^9 (count + 5) / (N + 5 V)), in
decimal arithmetic; all sums are exact.

Defined cases: null text, language and source are empty strings; groups without kept terms take
part with p = 1 + floor(10^9 / V); a language without kept terms gives pairs of value 0 and no
terms; a language with one source gives no pairs; rows that repeat an id count each;
a text may be any length; other columns aren't read; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalog_engine.llm.common import SLICE_BYTES, slices, stored

MIN_DOCS = 30
UNIT, SMOOTHING = 1_000_000_000, 5
TOP_TERMS = 50
TILE_GROUPS, STRIPE_TERMS = 64, 1024
SIDE, LEAF = 64, 8
HELD_ENTRIES = 300_000
"""Distinct terms that a task holds before it hands on its partial counts."""

#: Letters A-Z in lower case, other letters and all bytes of longer code points as they are, the rest blank.
TO_TERMS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def _terms_of_slice(part: pa.RecordBatch, held: dict) -> None:
    """Add the terms of a slice's texts to held[lang, source] = (occurrences, documents)."""
    for lang, source, text in zip(*(part.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
        words = text.encode().translate(TO_TERMS).split()
        if words:
            counts, docs = held.setdefault((lang, source), (Counter(), Counter()))
            counts.update(words)
            docs.update(set(words))


def _handed_on(held: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), (counts, docs) in held.items():
        terms = list(counts)
        n = len(terms)
        yield pa.RecordBatch.from_arrays(
            [pa.repeat(pa.scalar(lang, pa.string()), n), pa.repeat(pa.scalar(source, pa.string()), n), pa.array(terms, pa.binary()).cast(pa.string()),
             pa.array(list(counts.values()), pa.int64()), pa.array([docs[t] for t in terms], pa.int64())],
            ["lang", "source", "term", "n", "docs"])


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict = {}
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            _terms_of_slice(part, held)
            if sum(len(c) for c, _ in held.values()) > HELD_ENTRIES:
                yield from _handed_on(held)
                held = {}
    yield from _handed_on(held)


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term in a group, and documents that hold it."""
    rows = docs.select(_blank("lang"), _blank("source"), _blank("text"))
    partial = rows.mapInArrow(_partial_counts, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def billionths(count: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)); null where terms is 0."""
    return F.expr(f"""IF({terms} > 0, 1 + CAST((CAST({count} + {SMOOTHING} AS DECIMAL(20,0)) * {UNIT})
                      DIV CAST(GREATEST({total} + {SMOOTHING} * {terms}, 1) AS DECIMAL(20,0)) AS BIGINT), NULL)""")


# ---- k²-trees -------------------------------------------------------------------------------

def build_tree(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, base: np.ndarray, size: int):
    """The k²-tree of a square: None if it has no entry, the probabilities of its LEAF rows and
    columns, or its four quadrants. base: probability of a term without a count, by row."""
    if not len(rows):
        return None
    if size == LEAF:
        leaf = np.repeat(base[:, None], LEAF, axis=1)
        leaf[rows, columns] = values
        return leaf
    half = size // 2
    quadrants = []
    for low in (True, False):
        for left in (True, False):
            here = ((rows < half) == low) & ((columns < half) == left)
            quadrants.append(build_tree(rows[here] - (0 if low else half), columns[here] - (0 if left else half), values[here],
                                        base[:half] if low else base[half:], half))
    return quadrants


def add_differences(sums: np.ndarray, a, b, base_a: np.ndarray, base_b: np.ndarray, width: int) -> None:
    """Add to sums[g, h] the sum of |p - q| over the first width columns of two nodes that
    cover the same columns, p from row g of a, q from row h of b."""
    if width <= 0 or not len(base_a) or not len(base_b):
        return
    if a is None and b is None:  # all counts are zero: one price for every column
        sums += width * np.abs(base_a[:, None] - base_b[None, :])
        return
    if isinstance(a, np.ndarray) or isinstance(b, np.ndarray):
        p = base_a[:, None, None] if a is None else a[:, None, :width]
        q = base_b[None, :, None] if b is None else b[None, :, :width]
        sums += np.abs(p - q).sum(axis=2)
        return
    size = len(base_a)
    half = size // 2
    for column in (0, 1):
        inner = min(width, half) if column == 0 else width - half
        for i in (0, 1):
            for j in (0, 1):
                add_differences(sums[i * half:(i + 1) * half, j * half:(j + 1) * half], None if a is None else a[2 * i + column],
                                None if b is None else b[2 * j + column], base_a[i * half:(i + 1) * half], base_b[j * half:(j + 1) * half], inner)


def _forest(rows, columns, values, base, n_squares: int) -> list:
    """One tree for each square of SIDE columns."""
    order = np.argsort(columns, kind="stable")
    rows, columns, values = rows[order], columns[order], values[order]
    cuts = np.searchsorted(columns, np.arange(n_squares + 1) * SIDE)
    return [build_tree(rows[a:b], columns[a:b] - k * SIDE, values[a:b], base, SIDE) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


PAIRS = "lang string, a string, b string, value long"


def _pair_sums(table: pa.Table) -> pa.Table:
    """Sums of |p - q| over one stripe, of every pair of groups of two tiles (a of the first,
    b of the second; of one tile, a before b)."""
    lang, first, second = (table[c][0].as_py() for c in ("lang", "first", "second"))
    heads = table.filter(table["term"].is_null())
    cells = table.filter(table["term"].is_valid())
    n_terms = heads["n_terms"][0].as_py()
    sides = {}
    for tile in {first, second}:
        of_tile = heads.filter(pc.equal(heads["tile"], tile)).sort_by([("size", "descending"), ("source", "ascending")])
        sides[tile] = (of_tile["source"].to_pylist(), of_tile["p"].fill_null(0).to_numpy())
    # commonest terms first, so that rare terms leave whole quadrants empty
    codes = cells["term"].combine_chunks().dictionary_encode()
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    term_of_cell = codes.indices.to_numpy()
    present = len(codes.dictionary)
    weight = np.zeros(present, dtype=np.int64)
    weight[term_of_cell] = cells["df"].to_numpy()
    place = np.empty(present, dtype=np.int64)
    place[np.argsort(-weight, kind="stable")] = np.arange(present)
    columns, values, tiles = place[term_of_cell], cells["p"].to_numpy(), cells["tile"].to_numpy()
    sources = np.array(cells["source"].to_pylist(), dtype=object)
    n_squares = -(-present // SIDE)

    def blocks(tile: int):
        """Row blocks of SIDE groups of a tile (a hash may give it some more): names, bases, trees."""
        names, base = sides[tile]
        number = {s: i for i, s in enumerate(names)}
        here = tiles == tile
        rows = np.array([number[s] for s in sources[here]], dtype=np.int64)
        out = []
        for at in range(0, len(names), SIDE):
            padded = np.zeros(SIDE, dtype=np.int64)
            padded[:len(names[at:at + SIDE])] = base[at:at + SIDE]
            in_block = (rows >= at) & (rows < at + SIDE)
            out.append((names[at:at + SIDE], padded,
                        _forest(rows[in_block] - at, columns[here][in_block], values[here][in_block], padded, n_squares)))
        return out

    left = blocks(first)
    right = left if first == second else blocks(second)
    out = ([], [], [])
    for i, (names_a, base_a, trees_a) in enumerate(left):
        for j, (names_b, base_b, trees_b) in enumerate(right):
            if first == second and j < i:
                continue
            sums = np.zeros((SIDE, SIDE), dtype=np.int64)
            for k in range(n_squares):
                add_differences(sums, trees_a[k], trees_b[k], base_a, base_b, min(SIDE, present - k * SIDE))
            add_differences(sums, None, None, base_a, base_b, n_terms - present)  # terms of neither tile
            for g, a in enumerate(names_a):
                for h, b in enumerate(names_b):
                    if first != second or i < j or g < h:
                        out[0].append(a)
                        out[1].append(b)
                        out[2].append(int(sums[g, h]))
    n = len(out[2])
    return pa.Table.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), n), pa.array(out[0], pa.string()), pa.array(out[1], pa.string()),
                                 pa.array(out[2], pa.int64())], ["lang", "a", "b", "value"])


def matrix(docs: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """groups (lang, source, tile, tiles, terms, stripes, size, p: of a term without a count) and cells
    (lang, source, tile, tiles, term, stripe, df, p, q): p of the group, q of the language."""
    counts = stored(term_counts(docs), "divergence-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("df"), F.sum("n").alias("total")).where(F.col("df") >= min_docs)
    kept = stored(kept, "divergence-terms")
    names = docs.select(_blank("lang"), _blank("source")).distinct()
    languages = (names.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
                 .join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_total")), "lang", "left")
                 .select("lang", F.ceil(F.col("sources") / TILE_GROUPS).cast("int").alias("tiles"),
                         F.coalesce("terms", F.lit(0).cast("long")).alias("terms"), F.coalesce("lang_total", F.lit(0).cast("long")).alias("lang_total")))
    languages = languages.withColumn("stripes", F.greatest(F.ceil(F.col("terms") / STRIPE_TERMS), F.lit(1)).cast("int"))
    held = stored(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "df", "total"), "divergence-cells")
    sizes = held.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = (names.join(sizes, ["lang", "source"], "left").withColumn("size", F.coalesce("size", F.lit(0).cast("long"))).join(languages, "lang")
              .withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int"))
              .withColumn("p", billionths("0", "size", "terms")))
    groups = stored(groups, "divergence-groups")
    cells = (held.join(groups.select("lang", "source", "tile", "tiles", "terms", "stripes", "size", "lang_total"), ["lang", "source"])
             .select("lang", "source", "tile", "tiles", "term", F.pmod(F.xxhash64("term"), F.col("stripes")).cast("int").alias("stripe"), "df",
                     billionths("n", "size", "terms").alias("p"), billionths("total", "lang_total", "terms").alias("q")))
    return groups, stored(cells, "divergence-probabilities")


def pair_values(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of a language's sources."""
    # a tile meets every tile of its language: as the first, or as the second of the pair
    meets = F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1),
                                  lambda t: F.struct(F.least(t, F.col("tile")).alias("first"), F.greatest(t, F.col("tile")).alias("second"))))
    widths = cells.select("lang", "stripe", "term").distinct().groupBy("lang", "stripe").agg(F.count(F.lit(1)).alias("n_terms"))
    heads = (groups.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.col("stripes") - 1))).join(widths, ["lang", "stripe"], "left")
             .select("lang", "stripe", meets.alias("_pair"), "tile", "source", "size", "p",
                     F.coalesce("n_terms", F.lit(0).cast("long")).alias("n_terms"), F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("df")))
    body = cells.select("lang", "stripe", meets.alias("_pair"), "tile", "source", F.lit(0).cast("long").alias("size"), "p",
                        F.lit(0).cast("long").alias("n_terms"), "term", "df")
    rows = heads.unionByName(body).select("lang", "stripe", "_pair.*", "tile", "source", "size", "p", "n_terms", "term", "df")
    partial = rows.groupBy("lang", "stripe", "first", "second").applyInArrow(_pair_sums, PAIRS)
    sums = partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return sums.select("lang", both.alias("_pair"), "value").select("lang", "_pair.*", "value")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): the other sources by divergence, and the terms
    that a group uses more than its language."""
    groups, cells = matrix(docs, min_docs)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = pair_values(groups, cells).withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    terms = (cells.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
             .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms).withColumn("part", F.lit("term")))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))


def oracle(min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> str:
    """DuckDB SQL for audit() over documents."""
    p = f"1 + ({UNIT}::HUGEINT * (coalesce({{n}}, 0) + {SMOOTHING})) // ({{total}} + {SMOOTHING} * terms)"
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents),
terms AS (SELECT d, lang, source, unnest(words) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM terms GROUP BY lang, term HAVING count(DISTINCT d) >= {min_docs}),
cells AS (SELECT lang, source, term, count(*) AS n FROM terms JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
languages AS (SELECT lang, count(*) AS terms, sum(total) AS lang_total FROM kept GROUP BY lang),
sizes AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS size FROM groups g LEFT JOIN cells USING (lang, source) GROUP BY ALL),
full_matrix AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, {p.format(n="c.n", total="size")} AS p, {p.format(n="k.total", total="lang_total")} AS q
  FROM sizes s JOIN languages USING (lang) JOIN kept k USING (lang) LEFT JOIN cells c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pairs AS (
  SELECT g.lang, g.source, h.source AS item, coalesce(v.value, 0) AS value FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM full_matrix a
             JOIN full_matrix b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) v
    ON v.lang = g.lang AND v.source = g.source AND v.item = h.source),
above AS (SELECT lang, source, term AS item, p - q AS value FROM full_matrix WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM above)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= {top_terms}"""
