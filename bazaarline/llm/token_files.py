"""Token ids packed into Arrow files of fixed-size-list batches.

Documents are dealt out by ranges of their id, so that shard files follow each
other in id order, and each task streams its documents into one IPC file: equal
sequences ``ids`` (fixed_size_list of the smallest unsigned type) with a ``mask``
that is false for padding at the end of a shard. Beside it lies an index file
with the ids and lengths of the shard's documents. Memory-mapped, a batch gives
its sequences as one array without a copy, and sequence k is in batch
``k // BATCH_SEQUENCES``.

A task writes under a name of its own, so a lost executor's half-written file is
never read: only files named in the manifest, which holds the rows of tasks that
ended well, belong to the corpus.

Defined cases: null text counts as empty and holds only the end id; null
document ids come first; rows of one id follow each other by a digest of their
text and may fill several shards; repeated rows are written each; an empty table makes no
files; columns other than id and text are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe_kernel import encoder
from .storage import keep

SEQUENCE = 2048
BATCH_SEQUENCES = 64
MANIFEST = "shard int, file string, index string, n_tokens long, n_docs long"


def _open(uri: str):
    """A readable Arrow source: a memory map where the folder is mounted, else the store's own file."""
    if urlparse(uri).scheme in ("", "file"):
        return pa.memory_map(unquote(urlparse(uri).path))
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


class _Shard:
    """Streams the documents of one task into its two files."""

    def __init__(self, folder: str, number: int, dtype: np.dtype, sequence: int):
        self.file, self.index = (f"{folder}/shard-{number:06d}-{uuid.uuid4().hex}.{kind}.arrow" for kind in ("ids", "docs"))
        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        self.sequence, self.dtype, self.type = sequence, dtype, pa.from_numpy_dtype(dtype)
        schema = pa.schema([("ids", pa.list_(self.type, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.sinks = [store.open_output_stream(fs.FileSystem.from_uri(f)[1]) for f in (self.file, self.index)]
        self.ids = pa.ipc.new_file(self.sinks[0], schema)
        self.docs = pa.ipc.new_file(self.sinks[1], pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())]))
        self.held: list[np.ndarray] = []
        self.n_held = self.n_tokens = self.n_docs = 0

    def add(self, doc_ids: pa.Array, encoded: list[np.ndarray]) -> None:
        lengths = [len(x) for x in encoded]
        self.docs.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(lengths, pa.int64())], ["doc_id", "n_tokens"]))
        self.held += encoded
        self.n_held += sum(lengths)
        self.n_tokens += sum(lengths)
        self.n_docs += len(lengths)
        if self.n_held >= self.sequence * BATCH_SEQUENCES:
            self._flush()

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.zeros(len(ids), bool)
        mask[:real] = True
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(values), self.sequence) for values in (ids, mask)]
        self.ids.write_batch(pa.RecordBatch.from_arrays(arrays, ["ids", "mask"]))

    def _flush(self, last: bool = False) -> None:
        ids, step = np.concatenate([*self.held, np.empty(0, self.dtype)]), self.sequence * BATCH_SEQUENCES
        full = len(ids) // step * step
        for at in range(0, full, step):
            self._write(ids[at : at + step], step)
        ids = ids[full:]
        if last and len(ids):
            padded = np.zeros(-(-len(ids) // self.sequence) * self.sequence, self.dtype)
            padded[: len(ids)] = ids
            self._write(padded, len(ids))
        self.held, self.n_held = [ids], len(ids)

    def close(self) -> None:
        self._flush(last=True)
        for x in (self.ids, self.docs, *self.sinks):
            x.close()


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, sequence: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards to ``folder``, which all executors reach; returns the manifest with ``first``, the ids before each shard."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel, shard, number = encoder(tokenizer_path), None, TaskContext.get().partitionId()
        end = np.array([end_id], kernel.dtype)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                if some.num_rows:
                    shard = shard or _Shard(folder, number, kernel.dtype, sequence)
                    shard.add(some.column("_id"), [np.append(kernel.encode(text.as_py()), end) for text in some.column("_text")])
        if shard:
            shard.close()
            yield pa.RecordBatch.from_pylist([{"shard": number, "file": shard.file, "index": shard.index, "n_tokens": shard.n_tokens, "n_docs": shard.n_docs}], pa.schema([("shard", pa.int32()), ("file", pa.string()), ("index", pa.string()), ("n_tokens", pa.int64()), ("n_docs", pa.int64())]))

    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")).withColumn("_tie", F.xxhash64("_text"))
    shards = keep(own.repartitionByRange("_id", "_tie").sortWithinPartitions("_id", "_tie").drop("_tie").mapInArrow(write, MANIFEST), "token-manifest")
    # one row per shard file
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def sequences(file: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The batches of a shard as (ids, mask) arrays of shape (n, sequence length); ids are not copied."""
    with _open(file) as source:
        reader = pa.ipc.open_file(source)
        for k in range(reader.num_record_batches):
            batch = reader.get_batch(k)
            size = batch.schema.field("ids").type.list_size
            yield tuple(batch.column(c).flatten().to_numpy(zero_copy_only=c == "ids").reshape(-1, size) for c in ("ids", "mask"))


def sequence_at(file: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence ``k`` of a shard and its mask, by random access."""
    with _open(file) as source:
        batch = pa.ipc.open_file(source).get_batch(k // BATCH_SEQUENCES)
        ids, mask = (batch.column(c)[k % BATCH_SEQUENCES].values for c in ("ids", "mask"))
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)


def _documents(file: str, index: str) -> Iterator[tuple[int | None, int, list[np.ndarray]]]:
    """(doc_id, start within the shard, pieces of its ids) in order."""
    real = (ids.reshape(-1)[mask.reshape(-1)] if not mask.all() else ids.reshape(-1) for ids, mask in sequences(file))
    rest, start = np.empty(0, np.uint16), 0
    with _open(index) as source:
        reader = pa.ipc.open_file(source)
        for k in range(reader.num_record_batches):
            batch = reader.get_batch(k)
            for doc_id, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pieces, need = [], n
                while need:
                    if not len(rest):
                        rest = next(real)
                    pieces.append(rest[:need])
                    need -= len(pieces[-1])
                    rest = rest[len(pieces[-1]) :]
                yield doc_id, start, pieces
                start += n


def read_documents(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document from the files: id, start, n_tokens, ids_crc32 (of its ids as little-endian 32-bit integers)."""
    schema = pa.schema([(id_col, pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                out: list[tuple] = []
                for doc_id, start, pieces in _documents(shard["file"], shard["index"]):
                    crc = 0
                    for piece in pieces:
                        crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
                    out.append((doc_id, shard["first"] + start, sum(map(len, pieces)), crc))
                    if len(out) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)

    spark = manifest.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(tasks).mapInArrow(read, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")
