"""Quality rules (operator 6): line-first cleaning, then a verdict on the document.

Each line is judged by itself: a line fails without end punctuation, as navigation, as
boilerplate, as noise, or as a repeat of an earlier line of its document. Failed lines are
removed. A document that loses more than max_loss of its words, or keeps fewer than
min_words, is rejected. Base statistics of the whole text are counted beside that.

Defined cases: null and empty texts have zero counts and fail the base rules; a text may be
any length (work is linear but for one sort of its word windows); repeated rows give
repeated rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog_engine.llm.common import id_text, map_slices

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
WINDOW = 8

#: A line ends a sentence if this matches at its end: a mark, then closing quotes or brackets.
SENTENCE_END = re.compile(r"""[.!?…。！？][)\]}"'»”’]*$""")
SEPARATORS = frozenset("| || » « > >> -> · • → / – —".split())
BOILERPLATE = re.compile(
    r"\b(?:all rights reserved|terms of (?:use|service)|privacy policy|cookie(?:s| policy)|"
    r"enable javascript|lorem ipsum|click here|subscribe (?:now|to our)|sign (?:in|up)|"
    r"log ?in|skip to (?:main )?content|powered by|copyright)\b|©", re.IGNORECASE)


@dataclass(frozen=True)
class Rules:
    """Thresholds of the line rules and of the verdict."""

    max_separators: float = 0.2
    max_symbols: float = 0.1
    max_capitals: float = 0.7
    boilerplate_words: int = 30
    max_loss: float = 0.5
    min_words: int = 20


def line_fault(line: str, rules: Rules) -> str | None:
    """The first rule that a line with words breaks, or None."""
    words = line.split()
    if sum(map(SEPARATORS.__contains__, words)) > rules.max_separators * len(words):
        return "navigation"
    bare = line.strip()
    if sum(map(bare.count, "#*$%&|<>")) > rules.max_symbols * len(bare):
        return "symbols"
    if len(words) <= rules.boilerplate_words and BOILERPLATE.search(bare):
        return "boilerplate"
    if not SENTENCE_END.search(bare):
        return "punctuation"
    if len(words) > 3 and sum(map(str.isupper, words)) > rules.max_capitals * len(words):
        return "capitals"
    return None


def clean_lines(text: str, rules: Rules) -> tuple[list[str], int]:
    """Lines that pass every rule, and their words."""
    kept, words, seen = [], 0, set()
    for line in text.split("\n"):
        n = len(line.split())
        if not n or line in seen:
            continue
        seen.add(line)
        if line_fault(line, rules) is None:
            kept.append(line)
            words += n
    return kept, words


def repeated_window_words(words: list[bytes]) -> int:
    """Words inside 8-word windows that occur twice or more, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    windows = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        windows = (windows ^ (windows >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + hashes[k:k + n]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    again = np.zeros(n, dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    marks = np.zeros(len(words) + 1, dtype=np.int64)
    marks[:n] += again
    marks[WINDOW:] -= again
    return int((np.cumsum(marks) > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    raw = text.encode()
    words = raw.split()  # bytes split at ASCII white space only
    lines = [line for line in raw.split(b"\n") if line.strip(BLANKS)]
    return (len(words), len(text) - sum(raw.count(c) for c in BLANKS), sum(raw.count(c) for c in SYMBOLS),
            len(lines) - len(set(lines)), repeated_window_words(words))


SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "clean_words long, clean_text string, base_failed boolean, kept boolean")


def assess(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Counts, cleaned text and verdict of every document."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def row(doc_id, text):
            n_words, chars, symbols, dups, repeats = base_counts(text)
            kept, words = clean_lines(text, rules)
            failed = n_words < rules.min_words or 100 * repeats > 30 * n_words
            whole = words >= rules.min_words and words >= (1 - rules.max_loss) * n_words
            return doc_id, n_words, chars, symbols, dups, repeats, words, "\n".join(kept), failed, not failed and whole

        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            rows = map(row, part.column("doc_id").to_pylist(), part.column("text").to_pylist())
            columns = list(zip(*rows, strict=True))
            kinds = [*[pa.int64()] * 7, pa.string(), pa.bool_(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                              [c.split()[0] for c in SCHEMA.split(", ")])

        return one

    return map_slices(id_text(docs), make, SCHEMA)


def verdicts(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """assess() without the cleaned texts; their share of words instead."""
    return assess(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "clean_words", F.sha2(F.col("clean_text").cast("binary"), 256).alias("clean_sha256"))


def oracle(rules: Rules = Rules()) -> str:
    """verdicts() in DuckDB SQL. White space of other alphabets, which only the Python rules
    know, isn't in it."""
    seps = ", ".join(f"'{s}'" for s in sorted(SEPARATORS))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^ \t-\r]+') AS words FROM d),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
worded AS (SELECT *, regexp_extract_all(line, '[^ \t-\r]+') AS lw, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
           row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS nth FROM lines WHERE regexp_matches(line, '[^ \t-\r]')),
judged AS (SELECT *, nth = 1
    AND len(list_filter(lw, lambda x: list_contains([{seps}], x))) <= {rules.max_separators} * len(lw)
    AND len(regexp_extract_all(bare, '[#*$%&|<>]')) <= {rules.max_symbols} * length(bare)
    AND NOT (len(lw) <= {rules.boilerplate_words} AND regexp_matches(bare, '{BOILERPLATE.pattern}', 'i'))
    AND regexp_matches(bare, '{SENTENCE_END.pattern.replace("'", "''")}')
    AND NOT (len(lw) > 3 AND len(list_filter(lw, lambda x: upper(x) = x AND lower(x) <> x)) > {rules.max_capitals} * len(lw)) AS good FROM worded),
per AS (SELECT doc_id, count(*) AS n_lines, count(DISTINCT line) AS n_distinct,
        coalesce(sum(len(lw)) FILTER (good), 0) AS clean_words, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (good), '') AS clean FROM judged GROUP BY doc_id),
win AS (SELECT doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(0, {WINDOW}) AS r(k) GROUP BY doc_id),
base AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(n_lines - n_distinct, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(clean_words, 0) AS BIGINT) AS clean_words, sha256(coalesce(clean, '')) AS clean_sha256
    FROM w LEFT JOIN per USING (doc_id) LEFT JOIN rep USING (doc_id)),
failed AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND clean_words >= {rules.min_words} AND clean_words >= {1 - rules.max_loss} * n_words AS kept, clean_words, clean_sha256
FROM failed"""
