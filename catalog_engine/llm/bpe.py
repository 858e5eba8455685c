"""BPE encoding and decoding (operator 2).

Each word keeps a segment tree over its adjacent pairs. A leaf holds (rank of the pair,
place), so the root is the leftmost merge of the lowest rank. A merge changes three leaves,
and each change climbs to the root in logarithmic time, until no pair can merge. The trees
of all new words of a slice advance side by side as rows of one matrix.

Words repeat, so a process keeps the ids of white-space chunks and of words that it has seen, in
tables of bounded size: a full one becomes the older generation, from which entries that are met
again come back. This changes no result.

Code points that Python's Unicode tables don't assign may be letters, numbers or cased to the
tokenizers library. Texts that hold any are normalised and split into words by the library.

Defined cases: null and empty texts have no ids and decode to ''; a text may be any length
(a word of n symbols costs O(n log n)); repeated rows give repeated rows.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from catalog_engine.llm.common import lists, map_slices

CACHE_ENTRIES = 200_000
NO_PAIR = np.int64(2**62)
PLACE_BITS = 32
PLACE = np.int64(2**PLACE_BITS - 1)

# Fixed values of the tokenizer format: contractions that are words of their own, and the
# characters of Unicode's White_Space property.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
WHITE_SPACE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _category(initial: str, top: int) -> str:
    """Character class of all code points up to top whose Unicode category starts so."""
    own = np.fromiter((unicodedata.category(chr(c)).startswith(initial) for c in range(top + 1)), bool, top + 1)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges.reshape(-1, 2))


@lru_cache(maxsize=2)
def word_pattern(top: int) -> re.Pattern:
    """Pre-tokens of a lower-cased text: contractions, letter runs, single digits, other runs.
    top 0xFFFF serves texts of the basic plane faster than the whole range does."""
    letters, numbers = _category("L", top), _category("N", top)
    return re.compile(f"{CONTRACTIONS}|[{letters}]+|[{numbers}]|[^{WHITE_SPACE}{letters}{numbers}]+")


@lru_cache(maxsize=1)
def _unassigned_pattern() -> re.Pattern:
    return re.compile(f"[{_category('Cn', 0x10FFFF)}]")


def has_unassigned(text: str) -> bool:
    """Whether a text holds code points that this Python's Unicode tables don't assign."""
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
        return False
    except UnicodeEncodeError:
        return _unassigned_pattern().search(text) is not None


WIDE = re.compile("[\U00010000-\U0010ffff]")
#: str.split() also cuts at these four, which are ordinary characters to the tokenizer.
SEPARATORS = re.compile("[\x1c-\x1f]")
CHUNK = re.compile(f"[^{WHITE_SPACE}]+")


def split_words(chunk: str) -> list[str]:
    if chunk[-1] in ",.;:!?|" and chunk[:-1].isalpha():  # the common case, without the pattern
        return [chunk[:-1], chunk[-1]]
    if has_unassigned(chunk):  # a word already, split off by the library
        return [chunk]
    return word_pattern(0x10FFFF if WIDE.search(chunk) else 0xFFFF).findall(chunk)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies:
    printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE tokenizer file with an end-of-word mark."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.tokens = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in chain(vocab.items(), self.special.items()):
            self.tokens[i] = token
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.last = np.array([vocab[c + end] for c in letters], dtype=np.int64)
        self.letters = {b: c for b, c in enumerate(letters)}
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]]
        keys = np.array([a << 24 | b for a, b, _ in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([c for _, _, c in pairs], dtype=np.int64)

    def pair_keys(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Leaf values: rank and place of each pair that can merge, else NO_PAIR."""
        key = left << 24 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(known, self.ranks[at] << PLACE_BITS | place, NO_PAIR)

    def start(self, words: list[bytes]) -> np.ndarray:
        """A row of single-byte symbols for each word; -1 fills up."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        rows = np.full((len(words), int(lengths.max())), -1, dtype=np.int64)
        inside = np.arange(rows.shape[1]) < lengths[:, None]
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        rows[inside] = self.inner[flat]
        rows[np.arange(len(words)), lengths - 1] = self.last[flat[np.cumsum(lengths) - 1]]
        return rows

    def merge(self, symbols: np.ndarray) -> np.ndarray:
        """All merges of each row, by segment trees; merged-away places become -1."""
        n_words, width = symbols.shape
        if width < 2:
            return symbols
        symbols = np.hstack([symbols, np.full((n_words, 1), -1, dtype=np.int64)])  # a stop after the last
        leaves = 1 << (width - 1).bit_length()
        place = np.arange(width, dtype=np.int64)
        tree = np.full((n_words, 2 * leaves), NO_PAIR)
        tree[:, leaves:leaves + width] = self.pair_keys(symbols[:, :-1], symbols[:, 1:], place)
        level = leaves // 2
        while level:
            below = tree[:, 2 * level:4 * level]
            np.minimum(below[:, 0::2], below[:, 1::2], out=tree[:, level:2 * level])
            level //= 2
        after = np.tile(np.arange(1, width + 2), (n_words, 1))
        after[:, width] = width
        before = np.tile(np.arange(-1, width), (n_words, 1))
        active = np.flatnonzero(tree[:, 1] < NO_PAIR)

        def put(rows, leaf, value):
            at = leaf + leaves
            tree[rows, at] = value
            while at[0] > 1:
                at = at >> 1
                tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])

        while active.size:
            root = tree[active, 1]
            i = root & PLACE
            j = after[active, i]
            k = after[active, j]
            h = before[active, i]
            new = self.merged[root >> PLACE_BITS]
            symbols[active, i] = new
            symbols[active, j] = -1
            after[active, i] = k
            before[active, k] = i
            put(active, j, NO_PAIR)
            put(active, i, self.pair_keys(new, symbols[active, k], i))
            led = h >= 0
            if led.any():
                put(active[led], h[led], self.pair_keys(symbols[active[led], h[led]], new[led], h[led]))
            active = active[tree[active, 1] < NO_PAIR]
        return symbols[:, :width]

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of each word as little-endian 32-bit integers. Words of like length go
        together, so that no short word carries the padding of a long one."""
        classes: dict[int, list[str]] = {}
        for word in words:
            classes.setdefault((len(word.encode()) - 1).bit_length(), []).append(word)
        out = {}
        for size, own in classes.items():
            step = max(1, (1 << 20) >> size)
            for at in range(0, len(own), step):
                part = own[at:at + step]
                rows = self.merge(self.start([w.encode() for w in part]))
                live = rows >= 0
                flat = rows[live].astype("<u4").tobytes()
                ends = 4 * np.cumsum(live.sum(axis=1))
                for word, a, b in zip(part, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    out[word] = flat[a:b]
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """Token strings joined by a blank, as a decoder-less tokenizer file decodes."""
        return " ".join(map(self.tokens.__getitem__, ids))

    def plain_text(self, ids: Iterable[int], end: str = "</w>") -> str:
        """The readable text of ids: bytes of the tokens, a blank at each word end."""
        back = {c: b for b, c in self.letters.items()}
        out = bytearray()
        for token in map(self.tokens.__getitem__, ids):
            if token in self.special:
                out += token.encode() + b" "
                continue
            body = token.removesuffix(end)
            out += bytes(back[c] for c in body) + (b" " if token.endswith(end) else b"")
        return out.decode("utf-8", "replace").rstrip(" ")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=4)
def _library(path: str):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


class Known:
    """A table of bounded size, of two generations."""

    def __init__(self):
        self.now: dict = {}
        self.older: dict = {}

    def missing(self, wanted: set) -> set:
        """The wanted entries that aren't known; all others are in the present generation after."""
        new = wanted.difference(self.now)
        if len(self.now) + len(new) > CACHE_ENTRIES:
            self.older, self.now, new = self.now, {}, wanted
        back = self.older.keys() & new
        self.now.update(zip(back, map(self.older.__getitem__, back), strict=True))
        return new - back


class Encoder:
    """Ids of whole texts. encode_words turns new words into id bytes: by segment trees
    unless another function is given."""

    def __init__(self, vocab: Vocabulary, encode_words: Callable[[Iterable[str]], dict[str, bytes]] | None = None):
        self.vocab = vocab
        self.encode_words = encode_words or vocab.encode_words
        self.known, self.known_words = Known(), Known()

    def chunks(self, text: str) -> list[str | bytes]:
        """White-space chunks of the normalised text; special tokens as their id bytes."""
        if "<|" not in text or not self.vocab.special_pattern.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.vocab.special_pattern.finditer(text):
            out += self._plain(text[at:m.start()])
            out.append(self.vocab.special[m[0]].to_bytes(4, "little"))
            at = m.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[str]:
        if has_unassigned(text):
            library = _library(self.vocab.path)
            text = library.normalizer.normalize_str(text)
            return [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]
        # lower case letter by letter: no special form for a final sigma
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return CHUNK.findall(text) if SEPARATORS.search(text) else text.split()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Id bytes of each text. Chunks that aren't known yet are encoded together."""
        rows = [self.chunks(t) for t in texts]
        new = self.known.missing(set().union(*rows))
        if new:
            self.known.now.update(self._encode_chunks(new))
        return [b"".join(map(self.known.now.__getitem__, r)) for r in rows]

    def _encode_chunks(self, new: set[str | bytes]) -> dict[str | bytes, bytes]:
        out = {c: c for c in new if isinstance(c, bytes)}
        plain = [c for c in new if isinstance(c, str) and c.isalpha()]  # all letters: one word
        mixed = {c: split_words(c) for c in new if isinstance(c, str) and not c.isalpha()}
        words = self.known_words.missing({*plain, *chain.from_iterable(mixed.values())})
        ids = self.known_words.now
        if words:
            ids.update(self.encode_words(words))
        out.update((c, ids[c]) for c in plain)
        out.update((chunk, b"".join(map(ids.__getitem__, words))) for chunk, words in mixed.items())
        return out


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One encoder for each worker process and file: later tasks reuse its word table."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(vocabulary(path))
    return _ENCODERS[path]


def _kept_rows(docs: DataFrame, keep: tuple[str, ...]) -> tuple[DataFrame, list[str], str]:
    """doc_id, kept columns and text (null as empty); the names and types of all but the text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c) for c in keep],
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    kept = ["doc_id", *keep]
    return rows, kept, ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)


def _id_arrays(path: str, texts: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(b, dtype="<u4").astype(np.int32) for b in _encoder(path).encode(texts.to_pylist())]


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ids) of whole texts under the tokenizer file at path, plus kept columns."""
    rows, kept, types = _kept_rows(docs, keep)

    def make():
        return lambda part: pa.RecordBatch.from_arrays(
            [*[part.column(c) for c in kept], lists(_id_arrays(path, part.column("_text")), pa.int32())], [*kept, "ids"])

    return map_slices(rows, make, f"{types}, ids array<int>", "_text")


def round_trip(docs: DataFrame, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """encode() and decode() of its ids in one pass, so that a task has one Python worker:
    (doc_id, ids, decoded) plus kept columns."""
    rows, kept, types = _kept_rows(docs, keep)

    def make():
        vocab = vocabulary(path)

        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            ids = _id_arrays(path, part.column("_text"))
            texts = pa.array([vocab.decode(x.tolist()) for x in ids], pa.string())
            return pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], lists(ids, pa.int32()), texts], [*kept, "ids", "decoded"])

        return one

    return map_slices(rows, make, f"{types}, ids array<int>, decoded string", "_text")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of encoded with another column decoded: the library's decoded text of their ids."""
    names = [*encoded.columns, "decoded"]

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [vocab.decode(ids) for ids in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names)

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("decoded", StringType())]))


def word_bpe() -> str:
    """The tokenizer file that the queries use."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """The digest columns of encoding and decoding every document."""
    out = round_trip(docs, path)
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))

