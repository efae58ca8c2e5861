"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the last bytes cuts texts into chunks where content says so,
so passages that documents share give the same chunks wherever they stand. All
chunks are counted by a 128-bit digest; those seen twice are encoded once, and
their ids are handed to every document that holds them. What no other document
shares is encoded in place.

A chunk's ids are not those its bytes have in a text near the chunk's ends. Such
joins are repaired by encoding again from a pre-token border in one chunk to a
pre-token border in the next, moved outwards until both lie between tokens of
the ids at hand. At a border, a space after a plain character, every encoding
starts a new pre-token, so the ids then agree exactly with those of the whole
text; where a chunk has no such border, it is encoded with its neighbours.

A bitmap tells tasks which chunks may be shared. Documents with
none are encoded where they lie; only the others are written out, compressed,
and joined to chunk ids.

Defined cases: null text counts as empty and has no ids; repeated rows get a row
each; an empty table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_kernel import Encoder, encoder
from .membership import MOST as MOST_BITS
from .membership import ROW_BITS, Bitmap, bitmap
from .storage import keep

#: Chunk lengths in bytes: mean beyond the least, least, most; width of the rolling hash.
MEAN, LEAST, MOST, WIDTH = 1024, 256, 8192, 16
_FACTOR = 0x9E3779B1


def cuts(raw: bytes) -> list[int]:
    """Ends of the content-defined chunks of a text's UTF-8 bytes; always between characters."""
    n = len(raw)
    if not n:
        return []
    b = np.frombuffer(raw, np.uint8)
    h, width, factor = b.astype(np.uint32), 1, _FACTOR
    while width < WIDTH:  # h[i] covers the last `width` bytes
        wider = h.copy()
        wider[width:] += h[:-width] * np.uint32(factor)
        h, width, factor = wider, width * 2, factor * factor & 0xFFFFFFFF
    starts = np.ones(n + 1, bool)  # a character or the end
    starts[:n] = (b & 0xC0) != 0x80
    chosen = np.nonzero(((h >> np.uint32(8)) & np.uint32(MEAN - 1) == 0) & starts[1:])[0] + 1
    out, last, k = [], 0, 0
    chosen = chosen.tolist()
    while last < n:
        while k < len(chosen) and chosen[k] < last + LEAST:
            k += 1
        end = chosen[k] if k < len(chosen) else n
        if end - last > MOST:
            end = last + MOST
            while not starts[end]:
                end -= 1
        out.append(end)
        last = end
    return out


def chunks(raw: bytes) -> list[tuple[int, int, bytes]]:
    """(start, end, digest) of each chunk."""
    ends = cuts(raw)
    return [(s, e, xxhash.xxh3_128_digest(raw[s:e])) for s, e in zip([0, *ends], ends, strict=False)]


def _short(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _borders(raw: bytes) -> np.ndarray:
    """Byte positions of spaces after a plain character: pre-token borders in any context."""
    b = np.frombuffer(raw, np.uint8)
    return np.nonzero((b[1:] == 32) & (b[:-1] > 32) & (b[:-1] < 127))[0] + 1


def assemble(raw: bytes, known: dict[bytes, bytes], kernel: Encoder) -> np.ndarray:
    """Ids of a whole text; chunks whose digest is in ``known`` bring their own."""
    borders, out, start = _borders(raw), [], 0
    for s, e, digest in chunks(raw):
        if digest not in known:
            continue
        ids = np.frombuffer(known[digest], kernel.dtype)
        upto = np.concatenate([[0], np.cumsum(kernel.lengths[ids])]) + s
        inside = borders[(borders > s) & (borders <= e)].tolist()
        if start == s:
            inside.insert(0, s)  # all before is final, and the chunk starts at a border
        at = np.searchsorted(upto, inside)
        agree = [(p, k) for p, k in zip(inside, at.tolist(), strict=True) if k < len(upto) and upto[k] == p]
        if len(agree) < 2:
            continue  # no part of the chunk stands apart: it is encoded with its neighbours
        (first, low), (last, high) = agree[0], agree[-1]
        if first > start:
            out.append(kernel.encode(raw[start:first].decode("utf-8")))
        out.append(ids[low:high])
        start = last
    if start < len(raw):
        out.append(kernel.encode(raw[start:].decode("utf-8")))
    return np.concatenate(out) if out else np.empty(0, kernel.dtype)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    lengths = np.fromiter((len(a) for a in arrays), np.int64, len(arrays))
    flat = np.concatenate([*arrays, np.empty(0, np.uint16)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat))


def _some(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class _Marks:
    """The bitmap of shared chunks, as tasks read it."""

    def __init__(self, marks: Bitmap):
        self.bits, self.blocks = marks.bits, {r["_block"]: bytes(r["_bits"]) for r in marks.rows.collect()}

    def __contains__(self, digest: bytes) -> bool:
        slot = _short(digest) % self.bits
        block = self.blocks.get(slot // ROW_BITS)
        return block is not None and bool(block[slot % ROW_BITS // 8] >> (slot % 8) & 1)


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_BITS) -> DataFrame:
    """One row per input row: id, ids (array of token ids of the whole text)."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _some(batches, 1024):
            found = [d for t in batch.column(0) for _, _, d in chunks(t.as_py().encode())]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["digest"])

    counted = own.select("_text").mapInArrow(digests, "digest binary").groupBy("digest").agg(F.count(F.lit(1)).alias("n"))

    def shorts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_short(d.as_py()) for d in batch.column(0)], pa.int64())], ["short"])

    shared = keep(counted.where("n > 1").select("digest"), "bpe-shared")
    # at most MOST_BITS / 32768 rows of 4 KB, whatever the number of chunks
    marks = spark.sparkContext.broadcast(_Marks(bitmap(keep(shared.mapInArrow(shorts, "short long"), "bpe-shorts"), "short", most)))

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = encoder(tokenizer_path)
        for batch in _some(batches):
            rows, found = [], []
            for k, text in enumerate(batch.column("_text")):
                text = text.as_py()
                if not any(d in marks.value for _, _, d in chunks(text.encode())):
                    rows.append(k)
                    found.append(kernel.encode(text))
            yield pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array(rows, pa.int64())), _lists(found)], ["_id", "ids"])

    def sharing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, row = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << 40
        for batch in _some(batches, 512):
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("_id"), batch.column("_text"), strict=True):
                raw = text.as_py().encode()
                held = list(dict.fromkeys(d for _, _, d in chunks(raw) if d in marks.value))
                if held:
                    out.append((row, doc_id.as_py(), pack.compress(raw), held))
                row += 1
            types = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()))
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["row", "_id", "packed", "held"])

    held = keep(own.mapInArrow(sharing, "row long, _id long, packed binary, held array<binary>"), "bpe-held")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, done = zstandard.ZstdDecompressor(), set()
        for batch in _some(batches):
            out = {}
            for packed in batch.column(0):
                raw = unpack.decompress(packed.as_py())
                out |= {d: raw[s:e] for s, e, d in chunks(raw) if d in marks.value and d not in done}
            done = (done | out.keys()) if len(done) < 1_000_000 else set()
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), pa.array(list(out.values()), pa.binary())], ["digest", "chunk"])

    def encode_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = encoder(tokenizer_path)
        for batch in _some(batches):
            ids = [kernel.encode(c.as_py().decode("utf-8")).tobytes() for c in batch.column("chunk")]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(ids, pa.binary())], ["digest", "ids"])

    once = held.select("packed").mapInArrow(texts, "digest binary, chunk binary").groupBy("digest").agg(F.first("chunk").alias("chunk"))
    once = keep(once.join(shared, "digest", "left_semi").mapInArrow(encode_chunks, "digest binary, ids binary"), "bpe-chunk-ids")
    handed = held.select("row", F.explode("held").alias("digest")).join(once, "digest")
    handed = handed.groupBy("row").agg(F.collect_list(F.struct("digest", "ids")).alias("known"))  # of one document

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel, unpack = encoder(tokenizer_path), zstandard.ZstdDecompressor()
        for batch in _some(batches):
            found = []
            for packed, known in zip(batch.column("packed"), batch.column("known"), strict=True):
                ids = {k["digest"]: k["ids"] for k in known.as_py() or []}
                found.append(assemble(unpack.decompress(packed.as_py()), ids, kernel))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), _lists(found)], ["_id", "ids"])

    joined = held.select("row", "_id", "packed").join(handed, "row", "left").select("_id", "packed", "known")
    out = own.mapInArrow(alone, "_id long, ids array<int>").unionByName(joined.mapInArrow(repair, "_id long, ids array<int>"))
    return out.withColumnRenamed("_id", id_col)


def decode(df: DataFrame, tokenizer_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids, special tokens included; null ids give null."""
    names = df.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = encoder(tokenizer_path)
        for batch in _some(batches):
            texts = [None if not x.is_valid else kernel.decode(x.values.to_pylist()) for x in batch.column(ids_col)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, out])

    return df.mapInArrow(run, f"{fields}, `{out}` string")
