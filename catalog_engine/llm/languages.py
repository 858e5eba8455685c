"""Language identification (operator 7): hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A letter n-gram is
the product of its letters' vectors, each rotated by its place. A document is the sum of its
n-grams' vectors, a language prototype the sum of its documents' unit vectors, and a
document's language is the prototype of the largest cosine. Non-letters count as one blank.

Prototypes are learned from at most about per_language documents of each language, chosen by
a hash of the id; every document is compared.

Defined cases: null texts and texts without a letter are 'und' with score 0; texts of any
length are used whole; with no labelled rows every document is 'und'; equal cosines go to the
language that sorts first; repeated rows give repeated rows.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog_engine.llm.common import id_text, is_held_out, map_slices

DIMENSIONS = 1024
GRAM = 3
TABLE_ROWS = 24_000
BLANK = ord(" ")


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=20_000)
def letter_vector(code: int, dimensions: int) -> np.ndarray:
    return np.random.Generator(np.random.Philox(key=code)).integers(0, 2, dimensions).astype(np.float32) * 2 - 1


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct letter n-grams of a text, packed in integers, and their counts."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), dtype="<u4")
    is_letter = _letters()[codes]
    if not is_letter.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    codes = np.where(is_letter, codes, BLANK).astype(np.uint64)
    kept = is_letter.copy()
    kept[1:] |= is_letter[:-1]  # one blank after each run of letters
    codes = codes[kept]
    codes = np.concatenate([[BLANK], codes, [BLANK][:int(codes[-1] != BLANK)]]).astype(np.uint64)
    packed = codes[:len(codes) - GRAM + 1]
    for k in range(1, GRAM):
        packed = packed << np.uint64(21) | codes[k:len(codes) - GRAM + 1 + k]
    return np.unique(packed, return_counts=True)


class Profiler:
    """Document vectors; keeps the vectors of n-grams that it has met, in bounded space."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self.rows: dict[int, int] = {}
        self.table = np.zeros((1024, dimensions), dtype=np.float32)

    def gram_vector(self, packed: int) -> np.ndarray:
        out = np.ones(self.dimensions, dtype=np.float32)
        for place in range(GRAM):
            out = out * np.roll(letter_vector(packed >> 21 * place & 0x1FFFFF, self.dimensions), place)
        return out

    def _rows(self, packed: list[int]) -> list[int]:
        new = [g for g in packed if g not in self.rows]
        if new and len(self.rows) + len(new) > max(TABLE_ROWS, len(packed)):
            self.rows, new = {}, packed
        for g in new:
            at = self.rows[g] = len(self.rows)
            if at == len(self.table):
                grown = np.zeros((max(at + 1, min(2 * at, TABLE_ROWS)), self.dimensions), dtype=np.float32)
                grown[:at] = self.table
                self.table = grown
            self.table[at] = self.gram_vector(g)
        return [self.rows[g] for g in packed]

    def vector(self, text: str) -> np.ndarray | None:
        """The unit vector of a text; None without letters."""
        packed, counts = grams(text)
        if not len(packed):
            return None
        out = np.zeros(self.dimensions, dtype=np.float32)
        listed = packed.tolist()
        for at in range(0, len(listed), 4096):  # a long text in many scripts has many n-grams
            rows = self._rows(listed[at:at + 4096])
            out += counts[at:at + 4096].astype(np.float32) @ self.table[rows]
        return out / max(float(np.linalg.norm(out)), 1e-9)


_PROFILER: list[Profiler] = []


def _profiler() -> Profiler:
    if not _PROFILER:
        _PROFILER.append(Profiler())
    return _PROFILER[0]


def learn(docs: DataFrame, per_language: int = 1500) -> dict[str, list[float]]:
    """Prototype of each language, from rows whose lang is known and that aren't held out."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(4, 2))
    sizes = labelled.groupBy("lang").count().collect()  # a row for each language
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, per_language / r["count"]))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    chosen = labelled.where(draw < share[F.col("lang")]).select(F.col("lang").alias("_lang"), "text")

    def bundle(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                v = _profiler().vector(text)
                if v is not None:
                    sums[lang] = sums.get(lang, 0) + v.astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))],
                                             ["lang", "vector"])

    parts = chosen.mapInArrow(bundle, "lang string, vector array<double>")
    # rounded: the order of the partial sums must not matter
    sums = (parts.select("lang", F.posexplode("vector").alias("place", "value"))
            .groupBy("lang", "place").agg(F.round(F.sum("value"), 6).alias("value"))
            .groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("vector")))
    return {r["lang"]: r["vector"] for r in sums.collect()}  # DIMENSIONS numbers for each language


def predict(docs: DataFrame, prototypes: dict[str, list[float]]) -> DataFrame:
    """(doc_id, lang_pred, score): the nearest prototype and its cosine (0 if negative)."""
    names = sorted(prototypes)
    matrix = np.array([prototypes[n] for n in names] or np.zeros((0, DIMENSIONS)), dtype=np.float64)
    unit = (matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def make():
        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            langs, scores = [], []
            for text in part.column("text").to_pylist():
                v = _profiler().vector(text) if names else None
                cosines = unit @ v if v is not None else None
                best = int(np.argmax(cosines)) if cosines is not None else -1
                langs.append(names[best] if best >= 0 else "und")
                scores.append(min(1.0, max(0.0, float(cosines[best]))) if best >= 0 else 0.0)
            return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                              ["doc_id", "lang_pred", "score"])

        return one

    return map_slices(id_text(docs), make, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that aren't held out, predict every row."""
    out = predict(docs, learn(docs))
    return out.select("doc_id", F.coalesce(is_held_out(4, 2), F.lit(False)).alias("held_out"), "lang_pred", "score")
