"""Line dedup (operator 5): a fixed-depth tree of line templates.

A line is parsed into tokens at white space; tokens with a digit become the field <*>. From
GENERAL_TOKENS tokens on it has BLOCKS blocks, the LEADING first tokens and four quarters of
the rest, and belongs to the template of its exact tokens and to those in which one block or
two are variable fields; a shorter line, to those in which any one token is a field (with
MIN_TOKENS fixed tokens left). Each template is kept under a leaf of the tree: the token count
and the first tokens that are no field. So lines of one form whose fields differ meet under a
common template, in any order of arrival, and no leaf is ever gathered in one place: leaves that
too few lines or one text alone reach are pruned by partial sums, and only then are the templates
of the other lines made and counted by hash.

Limits: fields in three or more blocks, in two places of a short line, or of differing token
counts do not meet; lines under MIN_TOKENS + 1 tokens have no field.

A template recurs when enough different documents hold it. Equal texts count as one, and so
do near copies, confirmed by their full sets of word shingles (operator 3): what only the
versions of one document share is its text, not a template. Lines of recurring templates are
dropped from every document, copies included.

Defined cases: null and empty texts have no lines and stay as they are (null becomes empty);
blank lines always stay; digits of lines under MIN_TOKENS tokens count; a line that a document
repeats counts once for it; rows of equal text get the same result; null ids are ordinary; an
empty table gives no rows. Templates are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
import re
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_engine.llm.common import BATCH_ROWS, map_slices, passing, sifted, stored
from catalog_engine.llm.neardedup import Settings, groups, mix

LEADING = 3
MIN_TOKENS = 3
GENERAL_TOKENS = 8
BLOCKS = 5
MIN_DOCS = 3
SHORT_MIN_DOCS = 20
LONG_TOKENS = 50
"""Documents that make a template recur: two from LONG_TOKENS tokens on, where chance is ruled
out, MIN_DOCS from GENERAL_TOKENS tokens on; below, SHORT_MIN_DOCS at MIN_TOKENS tokens, and in
inverse ratio to the length."""
COPIES = Settings(words=5, percent=80)
"""Near copies, as the pipeline's near-duplicate removal has them."""

PARSE_BYTES = 1 << 20
"""Text bytes whose lines a task holds at once."""

RARE_SPACE = re.compile(r"[^\S\x00-\x7f]")
RARE_DIGIT = re.compile(r"([^\D\x00-\x7f])")
FIELD = b"<*>"
BYTES = np.arange(256, dtype=np.uint64)
SPACE = np.isin(BYTES, [*range(9, 14), *range(28, 33)])
"""ASCII white space, as str.split() has it."""
LETTERS = np.where(SPACE, np.uint64(0), mix(mix(BYTES + np.uint64(1))))
"""A number for each byte; none for white space."""
RADIX = np.uint64(0x9E3779B97F4A7C15)


def _kept(fields: tuple[int, ...]) -> list[int]:
    return [k for k in range(BLOCKS) if k not in fields]


HEADS = 3
"""Blocks that can be the first without a field."""
BLOCK_FIELDS = [(), *((k,) for k in range(BLOCKS)), *combinations(range(BLOCKS), 2)]
"""Blocks that are fields, of each template of a line that has blocks."""


def least_docs(fixed: int) -> int:
    """Documents that make a template of so many fixed tokens recur."""
    if fixed >= GENERAL_TOKENS:
        return 2 if fixed >= LONG_TOKENS else MIN_DOCS
    return math.ceil(MIN_TOKENS * SHORT_MIN_DOCS / max(fixed, 1))


def _cuts(n):
    """Where the blocks of a line of n tokens begin, and its end (n: a number or an array)."""
    return [0 * n, *(LEADING + (n - LEADING) * k // (BLOCKS - 1) for k in range(BLOCKS))]


@cache
def kinds(n: int) -> tuple[tuple[int, tuple[int, ...], int], ...]:
    """(head, fields, least) of each template of a line of n tokens: the leaf that keeps it, its
    parts that are fields, the documents that make it recur. Parts are blocks, or tokens of a short line."""
    if n < GENERAL_TOKENS:
        whole = (0, (), least_docs(n))
        return (whole, *((int(k < n // 2), (k,), least_docs(n - 1)) for k in range(n if n > MIN_TOKENS else 0)))
    cuts, out = _cuts(n), []
    for fields in BLOCK_FIELDS:
        fixed = n - sum(cuts[k + 1] - cuts[k] for k in fields)
        # one field behind the leading tokens: as for the whole line, LONG_TOKENS apart
        least = min(MIN_DOCS, least_docs(fixed)) if len(fields) == 1 and fields[0] else least_docs(fixed)
        out.append((_kept(fields)[0], fields, least))
    return tuple(out)


@cache
def counted(n: int) -> tuple[bool, ...]:
    """Which of the kinds decide. A template with more fields has all the lines of one with fewer; if it
    needs no more documents, it recurs whenever the other does, and the other needn't be counted."""
    of = kinds(n)
    return tuple(not any(set(fields) < set(more) and least >= enough for _, more, enough in of) for _, fields, least in of)


@cache
def leaf_least(n: int) -> tuple[int, ...]:
    """For each head of a line of n tokens, the fewest documents that make a template of its leaf recur."""
    heads = HEADS if n >= GENERAL_TOKENS else 2 if n > MIN_TOKENS else 1
    return tuple(min(least for (head, _, least), yes in zip(kinds(n), counted(n), strict=True) if yes and head == k) for k in range(heads))


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each run of values that begins at a start and ends before the next: the sum of its
    values times powers of RADIX. Works on a stretch of runs at a time."""
    ends, out, at = np.append(starts, len(values)), np.zeros(len(starts), np.uint64), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + PARSE_BYTES, side="right")) - 1)
        place = np.arange(ends[at], ends[to]) - np.repeat(ends[at:to], np.diff(ends[at:to + 1]))
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(place.max(), RADIX)]), dtype=np.uint64)
        part = values[ends[at]:ends[to]]
        part = LETTERS[part] if part.dtype == np.uint8 else part
        out[at:to] = np.add.reduceat(part * powers[place], starts[at:to] - ends[at])
        at = to
    return mix(out)


def _plain(texts: pa.Array) -> pa.Array:
    """The texts with white space as ASCII blanks and a "0" after digits of other alphabets."""
    _, data = _bytes(texts)
    if not len(data) or data.max() < 0xC2:
        return texts
    # two blanks lie under U+0660, the first digit that isn't ASCII; all others have a first byte from 0xD9 on
    if not (data >= 0xD9).any() and not ((data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))).any():
        return texts
    return pa.array([t if t.isascii() else RARE_DIGIT.sub(r"\g<1>0", RARE_SPACE.sub(" ", t)) for t in texts.to_pylist()], pa.string())


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of texts without nulls."""
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data


def text_lines(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """(row, line, n, named, parts) of the lines of some texts that aren't blank: number in its text,
    token count; in two flat arrays, hashes of the tokens that name its leaves, and of its parts."""
    none = np.zeros(0, np.int64)
    if not len(texts):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    rows, data = _bytes(_plain(texts))
    begins = ~SPACE[data]
    fresh = np.ones(len(data) + 1, bool)  # behind white space, or first of a text
    fresh[1:-1] = ~begins[:-1]
    fresh[rows[:-1]] = True
    starts = np.flatnonzero(begins & fresh[:-1])
    if not len(starts):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    tokens = _sums(data, starts)
    breaks = np.flatnonzero(data == 10)
    row = np.searchsorted(rows, starts, side="right") - 1
    line = np.searchsorted(breaks, starts) - np.searchsorted(breaks, rows[row])
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (line[1:] != line[:-1])]))
    n = np.diff(first, append=len(starts))
    # tokens with a digit are fields; in a line under MIN_TOKENS tokens they stay as they are
    fields = np.zeros(len(starts), bool)
    fields[np.searchsorted(starts, np.flatnonzero((data >= 48) & (data <= 57)), side="right") - 1] = True
    tokens[fields & np.repeat(n >= MIN_TOKENS, n)] = _sums(np.frombuffer(FIELD, np.uint8), np.zeros(1, np.int64))[0]
    # parts: blocks of long lines, tokens of short ones
    long = n >= GENERAL_TOKENS
    is_part = np.repeat(~long, n)
    cuts = np.stack(_cuts(n[long]), 1) + first[long][:, None]
    is_part[cuts[:, :-1].ravel()] = True
    parts = _sums(tokens, np.flatnonzero(is_part))
    # leaves are named by the leading tokens of the first blocks, or by a half of a short line
    heads = np.array([len(leaf_least(min(c, GENERAL_TOKENS))) for c in range(1, GENERAL_TOKENS + 1)])[np.minimum(n, GENERAL_TOKENS) - 1]
    ends = _offsets(heads)
    begin, end = np.repeat(first, heads), np.repeat(first + n, heads)
    head = np.arange(ends[-1]) - np.repeat(ends[:-1], heads)
    halves = np.repeat(heads == 2, heads)
    middle = np.repeat(first + n // 2, heads)
    begin, end = np.where(halves & (head == 1), middle, begin), np.where(halves & (head == 0), middle, end)
    blocks = np.repeat(long, heads)
    begin[blocks], end[blocks] = cuts[:, :HEADS].ravel(), np.minimum(cuts[:, :HEADS] + LEADING, cuts[:, 1:HEADS + 1]).ravel()
    named = np.zeros(len(begin), np.uint64)
    for k in range(GENERAL_TOKENS // 2):
        held = begin + k < end
        named[held] = mix(named[held] * np.uint64(3) + tokens[begin[held] + k])
    return row[first], line[first], n, named, parts


def leaf_hashes(n: np.ndarray, head: np.ndarray, named: np.ndarray) -> np.ndarray:
    """Leaves of lines of n tokens, by head and the hash of the tokens that name them."""
    return mix(mix(mix(n.astype(np.uint64)) + head.astype(np.uint64)) ^ named)


def templates_of(n: np.ndarray, head: np.ndarray, offsets: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, template, least) of the templates that the leaf of each row keeps; a row is a line of n
    tokens, by head, with the hashes of its parts from its offset on."""
    rows, found, least = [], [], []
    shape = np.minimum(n, GENERAL_TOKENS)
    for size in np.unique(shape).tolist():
        for kind, (of, fields, _) in enumerate(kinds(size)):
            at = np.flatnonzero((shape == size) & (head == of))
            counts, which = np.unique(n[at], return_inverse=True)
            need = np.array([counted(c)[kind] for c in counts.tolist()], bool)[which]
            at, which = at[need], which[need]
            one = mix(mix(n[at].astype(np.uint64)) + np.uint64(HEADS + kind))
            for k in range(BLOCKS if size == GENERAL_TOKENS else size):
                if k not in fields:
                    one = mix(one * np.uint64(3) + parts[offsets[at] + k])
            rows.append(at), found.append(one), least.append(np.array([kinds(c)[kind][2] for c in counts.tolist()], np.int32)[which])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
    return np.concatenate(rows), np.concatenate(found), np.concatenate(least)


def whole_text(column: str = "text") -> Column:
    """A text column with null texts as empty ones."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def parsed_lines(docs: DataFrame) -> DataFrame:
    """(same, line, n, parts, leaves, least) of every line that isn't blank: its token count,
    the hashes of its parts, its leaves and the fewest documents that make a template of each recur;
    same is a hash of the text."""
    rows = docs.select(F.xxhash64(whole_text()).alias("same"), whole_text().alias("text"))

    def make():
        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            row, line, n, named, parts = text_lines(part.column("text"))
            counts, which = np.unique(n, return_inverse=True)
            k = np.array([len(leaf_least(c)) for c in counts.tolist()], np.int64)[which]
            ends = _offsets(k)
            head = np.arange(ends[-1]) - np.repeat(ends[:-1], k)
            least = np.array([[*leaf_least(c), 0, 0][:HEADS] for c in counts.tolist()], np.int32).reshape(-1, HEADS)
            least = least[np.repeat(which, k), head]
            leaves = leaf_hashes(np.repeat(n, k), head, named).view(np.int64)
            of = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            flat = [part.column("same").take(pa.array(row))] + [pa.array(x.astype(np.int32)) for x in (line, n)]
            lists = [of(_offsets(np.where(n < GENERAL_TOKENS, n, BLOCKS)), parts.view(np.int64)), of(ends, leaves), of(ends, least)]
            return pa.RecordBatch.from_arrays([*flat, *lists], ["same", "line", "n", "parts", "leaves", "least"])

        return one

    schema = "same long, line int, n int, parts array<long>, leaves array<long>, least array<int>"
    return map_slices(rows, make, schema, most=PARSE_BYTES)


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)


def _line_templates(batches):
    """Batches (same, line, template, least) for batches of lines under one of their leaves."""
    for batch in batches:
        parts = batch.column("parts")
        offsets = parts.offsets.to_numpy()[:batch.num_rows]
        n, head = (batch.column(c).to_numpy() for c in ("n", "head"))
        rows, templates, least = templates_of(n, head, offsets, parts.values.to_numpy().view(np.uint64))
        kept = batch.select(["same", "line"]).take(pa.array(rows))
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(templates.view(np.int64)), pa.array(least)],
                                         ["same", "line", "template", "least"])


def _candidates(docs: DataFrame) -> DataFrame:
    """(same, line, template, least) of all lines whose templates may recur."""
    lines = stored(parsed_lines(docs), "line-parts", batch_rows=BATCH_ROWS)
    leaves = (lines.select("same", "least", F.posexplode("leaves").alias("head", "leaf"))
              .groupBy("leaf").agg(F.min("same").alias("_low"), F.max("same").alias("_high"), F.count(F.lit(1)).alias("_lines"),
                                   F.min(F.get("least", F.col("head"))).alias("_least")))
    # no fewer lines than texts: a leaf left out here has no template that recurs
    leaves = stored(leaves.where((F.col("_low") != F.col("_high")) & (F.col("_lines") >= F.col("_least"))).select("leaf"), "line-leaves")
    # a leaf too many does no harm, its templates are counted as all others
    live = sifted(lines.select("same", "line", "n", "parts", F.posexplode("leaves").alias("head", "leaf")), "leaf", leaves)
    return live.mapInArrow(_line_templates, "same long, line int, template long, least int")


def _near_copies(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """(same, label) of those of some texts that have near copies among them; these share a label."""
    # one document of each text would do, but to find it costs more than to sketch them all
    held = sifted(docs.select(F.xxhash64(whole_text()).alias("doc_id"), whole_text().alias("text")), "doc_id", texts)
    found = groups(held, COPIES, among=texts).select(F.col("doc_id").alias("same"), "label").distinct()
    return found.join(found.groupBy("label").agg(F.count(F.lit(1)).alias("_texts")).where(F.col("_texts") > 1), "label", "left_semi")


def recurring_lines(docs: DataFrame) -> DataFrame:
    """(same, cut): the numbers of the lines to drop, for each text (by its hash) that has any."""
    with passing() as block:
        with passing() as first:
            with passing():  # the parts of all lines go before templates are counted
                each = stored(_candidates(docs), "line-candidates", first)
            counts = each.select("template", "least", "same").distinct().groupBy("template", "least").agg(F.count(F.lit(1)).alias("_docs"))
            counts = stored(counts.where(F.col("_docs") >= F.col("least")), "line-recurring-templates", block)
            each = stored(sifted(each.select("same", "line", "template"), "template", counts).join(counts, "template", "left_semi"), "line-recurring", block)
        with passing():
            texts = stored(each.select(F.col("same").alias("doc_id")).distinct(), "line-texts")
            copies = stored(_near_copies(docs, texts), "line-copies", block)
        # near copies of one text count once: of each label all texts but one are taken off
        held = sifted(each.select("template", "same"), "same", copies).distinct().join(copies, "same")
        over = (held.groupBy("template", "label").agg(F.count(F.lit(1)).alias("_texts")).where(F.col("_texts") > 1)
                .groupBy("template").agg(F.sum(F.col("_texts") - 1).alias("_over")))
        left = F.col("_docs") - F.coalesce("_over", F.lit(0))
        recurring = stored(counts.join(over, "template", "left").where(left >= F.col("least")).select("template"), "line-recurring-templates")
        drops = sifted(each, "template", recurring).join(recurring, "template", "left_semi").select("same", "line").distinct()
        return stored(drops.groupBy("same").agg(F.collect_list("line").alias("cut")), "line-drops", None)  # lines of one text


def _cut_rows(docs: DataFrame) -> DataFrame:
    """(row, text, n_lines, n_dropped) of every row of docs: the row itself as a struct, so that no
    column of docs can clash, its text after line dedup, and the numbers of its lines."""
    drops = recurring_lines(docs)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(whole_text()).alias("same"))
    # the text moves once, inside its row, and only if it may have lines to drop
    keys, text = drops.select("same"), whole_text("row.text")
    found = sifted(rows, "same", keys).join(drops, "same", "left").select("row", text.alias("text"), F.split(text, "\n").alias("lines"), "cut")
    # set difference and access by position: linear in the lines, however many are cut
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("cut"))
    cut = F.array_join(F.transform(kept, lambda i: F.col("lines")[i]), "\n")
    moved = found.select("row", F.when(F.col("cut").isNull(), F.col("text")).otherwise(cut).alias("text"),
                         F.when(F.col("text") == "", 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
                         F.coalesce(F.size("cut"), F.lit(0)).cast("long").alias("n_dropped"))
    breaks = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    stays = (sifted(rows, "same", keys, "left_anti").select("row", text.alias("text"))
             .select("row", "text", F.when(F.col("text") == "", 0).otherwise(1 + breaks).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")))
    return moved.unionByName(stays)


def drop_lines(docs: DataFrame) -> DataFrame:
    """The rows of docs with text cut; other columns, whatever their names, unchanged."""
    rows = _cut_rows(docs)
    return rows.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) of every document after line dedup."""
    return _cut_rows(docs.select("doc_id", "text")).select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_lines", "n_dropped", "text")
