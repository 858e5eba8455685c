"""Token-id output (operator 4): Arrow files of equal-length sequences.

Documents are cut into id ranges; each range becomes one Arrow IPC file. Its rows are
sequences of a fixed length (fixed-size lists of ids and of mask bits), packed without gaps:
a document goes on in the next sequence, and only the last sequence of a file is padded
(mask false). Record batches hold a fixed number of sequences, so sequence i lies in batch
i // BATCH at row i % BATCH and is a zero-copy view of the mapped file. An index file beside
it holds the id, first place and length of each document.

Files are written under a new name in each task attempt; the manifest, itself a table in the
shared folder, names the files of the attempts that ended well. Others are never read.

Defined cases: null and empty texts consist of the end id alone; rows of one doc_id follow
each other by text; a null doc_id comes first; an empty table gives no documents.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalog_engine.llm.bpe import Encoder, byte_letters, vocabulary
from catalog_engine.llm.common import id_text, scratch_path, slices, stored

SEQUENCE = 2048
BATCH = 64
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def file_schema(length: int, id_type: pa.DataType) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.field("item", id_type, nullable=False), length)),
                      ("mask", pa.list_(pa.field("item", pa.bool_(), nullable=False), length))])


@lru_cache(maxsize=2)
def _library_encoder(path: str) -> Encoder:
    """Ids by the tokenizers library: its BPE model encodes each distinct word."""
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(path).model
    letters = byte_letters()

    def encode_words(words: Iterable[str]) -> dict[str, bytes]:
        return {w: array("I", [t.id for t in model.tokenize("".join([letters[b] for b in w.encode()]))]).tobytes()
                for w in words}

    return Encoder(vocabulary(path), encode_words)


class SequenceFile:
    """Writes a stream of ids as fixed-length sequences."""

    def __init__(self, sink, length: int, dtype):
        self.length, self.dtype = length, np.dtype(dtype)
        self.schema = file_schema(length, pa.from_numpy_dtype(self.dtype))
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.parts: list[np.ndarray] = []
        self.waiting = 0

    def add(self, ids: np.ndarray) -> None:
        self.parts.append(ids.astype(self.dtype))
        self.waiting += len(ids)
        if self.waiting >= BATCH * self.length:
            flat = np.concatenate(self.parts)
            whole = len(flat) // (BATCH * self.length) * BATCH * self.length
            for at in range(0, whole, BATCH * self.length):
                self._write(flat[at:at + BATCH * self.length], BATCH * self.length)
            self.parts, self.waiting = [flat[whole:]], len(flat) - whole

    def _write(self, flat: np.ndarray, used: int) -> None:
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(values), type=field.type)
                   for values, field in zip((flat, np.arange(len(flat)) < used), self.schema, strict=True)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        flat = np.concatenate([*self.parts, np.zeros(0, self.dtype)])
        if len(flat):
            padded = np.zeros(-(-len(flat) // self.length) * self.length, self.dtype)
            padded[:len(flat)] = flat
            self._write(padded, len(flat))
        self.writer.close()


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, length: int = SEQUENCE) -> DataFrame:
    """Write all documents; returns the manifest (part, path, n_docs, n_ids)."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = (id_text(docs).repartitionByRange(parts, F.col("doc_id").asc_nulls_first())
            .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text"))

    def run(batches):
        from pyarrow import fs
        encoder = _library_encoder(tokenizer)
        small = max(end_id, len(encoder.vocab.tokens) - 1) < 1 << 16
        store, base = fs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        path = f"{base}/part-{part:06d}-{uuid.uuid4().hex}"
        store.create_dir(base)
        index, total = [], 0
        with store.open_output_stream(f"{path}.arrow") as sink:
            out = SequenceFile(sink, length, np.uint16 if small else np.uint32)
            for batch in batches:
                for piece in slices(batch, "text"):
                    for doc_id, ids in zip(piece.column("doc_id").to_pylist(), encoder.encode(piece.column("text").to_pylist()), strict=True):
                        own = np.append(np.frombuffer(ids, dtype="<u4"), np.uint32(end_id))
                        out.add(own)
                        index.append((doc_id, total, len(own)))
                        total += len(own)
            out.close()
        with store.open_output_stream(f"{path}.index.arrow") as sink, pa.ipc.new_file(sink, INDEX) as writer:
            for at in range(0, len(index), 1 << 16):
                columns = zip(*index[at:at + (1 << 16)], strict=True)
                writer.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=INDEX))
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), pa.array([len(index)], pa.int64()), pa.array([total], pa.int64())],
                                         ["part", "path", "n_docs", "n_ids"])

    return stored(rows.mapInArrow(run, "part int, path string, n_docs long, n_ids long"), "token-manifest")


class Reader:
    """Random access to one file's sequences, masks and documents."""

    def __init__(self, folder: str, path: str):
        from pyarrow import fs
        store, _ = fs.FileSystem.from_uri(folder)
        opened = pa.memory_map if isinstance(store, fs.LocalFileSystem) else store.open_input_file
        self.file = pa.ipc.open_file(opened(f"{path}.arrow"))
        self.index = pa.ipc.open_file(opened(f"{path}.index.arrow"))
        self.length = self.file.schema.field("ids").type.list_size

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Sequence i as views of the file: its ids and its mask."""
        batch = self.file.get_batch(i // BATCH)
        ids, mask = (batch.column(c).slice(i % BATCH, 1).flatten() for c in (0, 1))
        return ids.to_numpy(zero_copy_only=True), mask

    def ids(self, start: int, count: int) -> Iterator[np.ndarray]:
        """Ids from a place on, as views of the batches that hold them."""
        per = BATCH * self.length
        while count:
            flat = self.file.get_batch(start // per).column(0).flatten().to_numpy(zero_copy_only=True)
            part = flat[start % per:start % per + count]
            yield part
            start, count = start + len(part), count - len(part)

    def documents(self) -> Iterator[pa.RecordBatch]:
        for i in range(self.index.num_record_batches):
            yield self.index.get_batch(i)


def read_digests(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files."""
    spark = manifest.sparkSession
    files = manifest.where("n_docs > 0")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    based = files.select("part", "path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                reader = Reader(folder, path)
                for rows in reader.documents():
                    starts, counts = rows.column("start").to_pylist(), rows.column("n_tokens").to_pylist()
                    crcs = []
                    for start, count in zip(starts, counts, strict=True):
                        crc = 0
                        for ids in reader.ids(start, count):
                            crc = zlib.crc32(ids.astype("<u4"), crc)
                        crcs.append(crc)
                    yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([base + s for s in starts], pa.int64()),
                                                      rows.column("n_tokens"), pa.array(crcs, pa.int64())],
                                                     ["doc_id", "start", "n_tokens", "ids_crc32"])

    return based.repartitionById(parts, F.pmod(F.col("part"), F.lit(parts))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write all documents to a new folder of the shared storage and read the files back."""
    folder = scratch_path(docs.sparkSession, "token-files")
    return read_digests(write(docs, tokenizer, folder), folder)
