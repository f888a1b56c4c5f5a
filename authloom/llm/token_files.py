"""Token ids as Arrow stream files of fixed-size-list batches.

The id stream is the documents in ascending order of id, each followed by an end id. It is dealt out
by ranges of the id; every range is written by its task, while it encodes, as one stream file of
equal-length sequences with masks (only the last sequence of a range is padded), next to a stream of
its documents' places. All batches but the last have the same bytes, so the place of any sequence in
the file is known without reading others, and a memory map gives it without a copy.

A task writes under a name of its own and reports it; the written table of reports says which files
count, so a repeated or lost task leaves no trace in the result.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from authloom.llm import bpe, pieces
from authloom.llm.store import Store, bounded_batches, small_batches

LENGTH = 1024    # ids of a sequence
READ_TOKENS = 1 << 21  # ids that a task reads back at least
SEQUENCES = 256  # sequences of a batch
PIECES = 20_000  # pieces that the library gets at a time


class ByteBpe(bpe.PieceCoder):
    """A byte-level vocabulary of the tokenizers library; every distinct piece is encoded by the library once."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            super().__init__({t["content"]: t["id"] for t in json.load(f)["added_tokens"]})
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)

    def split(self, cp, rows):
        return pieces.split_spaced(cp, rows)

    def merge(self, words):
        # pieces as words of one text: one object for many, with the word of every id
        n, flat = np.zeros(len(words), dtype=np.int64), []
        for lo in range(0, len(words), PIECES):
            made = self.tokenizer.encode(words[lo:lo + PIECES], is_pretokenized=True, add_special_tokens=False)
            n[lo:lo + PIECES] = np.bincount(np.array(made.word_ids, dtype=np.int64), minlength=len(words[lo:lo + PIECES]))
            flat.append(np.array(made.ids, dtype=np.int32))
        return n, np.concatenate(flat)


@cache
def byte_bpe(path: str) -> ByteBpe:
    """One encoder per Python worker."""
    return ByteBpe(path)


def sequence_schema(dtype: pa.DataType, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(dtype, length)), ("mask", pa.list_(pa.bool_(), length))])


PLACES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _open_out(base: str):
    system, folder = fs.FileSystem.from_uri(base)
    system.create_dir(folder, recursive=True)
    return system, folder


class Writer:
    """One range of documents: its sequences and the places of its documents."""

    def __init__(self, base: str, name: str, dtype: pa.DataType, length: int, sequences: int) -> None:
        self.dtype, self.schema, self.length, self.full = dtype, sequence_schema(dtype, length), length, length * sequences
        system, folder = _open_out(base)
        self.out = [system.open_output_stream(f"{folder}/{name}.{kind}.arrows") for kind in ("ids", "docs")]
        self.sequences = pa.ipc.new_stream(self.out[0], self.schema)
        self.places = pa.ipc.new_stream(self.out[1], PLACES)
        self.held: list[np.ndarray] = []
        self.size = self.total = self.documents = 0
        self.rows: list[tuple] = []

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = np.zeros(len(ids), dtype=bool)
        mask[:real] = True
        self.sequences.write_batch(pa.RecordBatch.from_arrays([
            pa.FixedSizeListArray.from_arrays(pa.array(ids.astype(self.dtype.to_pandas_dtype()), self.dtype), self.length),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.rows.append((doc_id, self.total, len(ids)))
        self.total += len(ids)
        self.documents += 1
        self.held.append(ids)
        self.size += len(ids)
        full = self.full
        if self.size >= full:
            flat = np.concatenate(self.held)
            whole = len(flat) // full * full
            for lo in range(0, whole, full):
                self._batch(flat[lo:lo + full], full)
            self.held, self.size = [flat[whole:]], len(flat) - whole
        if len(self.rows) >= 10_000:
            self._flush_places()

    def _flush_places(self) -> None:
        if self.rows:
            self.places.write_batch(pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*self.rows, strict=True)], schema=PLACES))
            self.rows = []

    def close(self) -> None:
        if self.size:
            flat = np.concatenate(self.held)
            padded = np.zeros(-(-len(flat) // self.length) * self.length, dtype=flat.dtype)
            padded[:len(flat)] = flat
            self._batch(padded, len(flat))
        self._flush_places()
        for x in (self.sequences, self.places, *self.out):
            x.close()


def _open_in(base: str, name: str):
    system, folder = fs.FileSystem.from_uri(base)
    path = f"{folder}/{name}"
    return pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)


class SequenceFile:
    """Random access to the sequences of one file."""

    def __init__(self, base: str, name: str) -> None:
        self.source = _open_in(base, f"{name}.ids.arrows")
        self.schema = pa.ipc.read_schema(self.source)
        self.header = self.source.tell()
        first = pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)
        self.stride, self.rows = self.source.tell() - self.header, first.num_rows

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence ``k``; the ids are a view of the file where it is mapped."""
        self.source.seek(self.header + k // self.rows * self.stride)
        batch = pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)
        row = k % self.rows
        return (batch.column(0)[row].values.to_numpy(), batch.column(1)[row].values.to_numpy(zero_copy_only=False))


def write_files(docs: DataFrame, path: str, base: str, end_id: int = 0, id_col: str = "doc_id",
                text_col: str = "text", length: int = LENGTH, sequences: int = SEQUENCES) -> DataFrame:
    """Encode and write all texts below ``base``; returns ``part, name, documents, tokens`` per file.

    Rows without id come first; rows that repeat an id follow each other in the order of their texts.
    Null texts count as empty and consist of the end id. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        coder, writer = byte_bpe(path), None
        for group in bpe.blocks(batches, 1):
            ids = coder.encode([t or "" for b in group for t in b.column(1).to_pylist()])
            for doc, own in zip((x for b in group for x in b.column(0).to_pylist()), ids, strict=True):
                if writer is None:
                    kind = pa.uint16() if max(coder.size, end_id + 1) <= 1 << 16 else pa.uint32()
                    writer = Writer(base, name, kind, length, sequences)
                writer.add(doc, np.append(own, np.int32(end_id)))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([name]), pa.array([writer.documents], pa.int64()),
                 pa.array([writer.total], pa.int64())], ["part", "name", "documents", "tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return (rows.repartitionByRange("id").sortWithinPartitions("id", "text")
            .mapInArrow(run, "part int, name string, documents long, tokens long"))


def read_files(files: DataFrame, base: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files that ``files`` lists."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one small row per file
    placed = files.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0))).select("name", "base")

    def run(batches):
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with _open_in(base, f"{name}.ids.arrows") as a, _open_in(base, f"{name}.docs.arrows") as b:
                    stream = iter(pa.ipc.open_stream(a))
                    held, at = np.zeros(0, dtype=np.uint16), 0
                    for places in pa.ipc.open_stream(b):
                        sums = []
                        for left in places.column(2).to_pylist():
                            crc = 0
                            while left:
                                if at == len(held):
                                    held, at = next(stream).column(0).values.to_numpy(), 0
                                take = min(left, len(held) - at)
                                crc = zlib.crc32(held[at:at + take].astype("<u4").tobytes(), crc)
                                at, left = at + take, left - take
                            sums.append(crc)
                        starts = np.asarray(places.column(1)) + first
                        yield pa.RecordBatch.from_arrays(
                            [places.column(0), pa.array(starts), places.column(2), pa.array(sums, pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"])

    # small files are read several to a task
    count, tokens = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    return placed.repartition(max(1, min(count, -(-tokens // READ_TOKENS)))).mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")


@small_batches(1000)
def round_trip(docs: DataFrame, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents and read them back: ``doc_id, start, n_tokens, ids_crc32``."""
    store = Store(docs.sparkSession, "tokens")
    base = f"{store.path}/files"
    files = store.save(write_files(docs, path, base, end_id, id_col, text_col), "written")
    return read_files(files, base)
