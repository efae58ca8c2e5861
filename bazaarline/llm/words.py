"""Words of whole texts as bytes, and the shards of documents that index operators work on.

Words are taken from UTF-8 bytes: a table maps ``A-Z`` to lower case, keeps what
belongs to words and turns every other byte into a space. Bytes of characters
beyond ASCII always belong to words, so no character is cut.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _table(digits: bool) -> bytes:
    out = bytearray(b" " * 128 + bytes(range(128, 256)))
    for c in range(ord("a"), ord("z") + 1):
        out[c] = out[c - 32] = c
    if digits:
        out[ord("0") : ord("9") + 1] = b"0123456789"
    return bytes(out)


#: Letters and digits; letters only. Characters beyond ASCII count as letters.
WORDS, LETTERS = _table(True), _table(False)


def as_binary(df: DataFrame, text: str) -> "F.Column":
    """The text column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")


@dataclass
class Shard:
    """Some documents as one sequence of word numbers; number ``k`` is ``terms[k]``."""

    terms: list[bytes]
    words: np.ndarray
    #: Of each document: its input row, where its words begin, and how many there are.
    rows: list
    starts: np.ndarray
    lengths: np.ndarray


def shards(batches: Iterator[pa.RecordBatch], most_words: int, most_docs: int) -> Iterator[Shard]:
    """Consecutive rows (text as bytes first, then what the caller needs of a row) as shards of bounded size.

    A shard ends before it has more words or documents than the bounds; a longer
    document is a shard of its own.
    """
    numbers: defaultdict = defaultdict(count().__next__)
    parts: list[np.ndarray] = []
    rows: list = []
    total = 0

    def close() -> Shard:
        lengths = np.array([len(p) for p in parts], np.int64)
        words = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        return Shard(list(numbers), words, rows, np.cumsum(lengths) - lengths, lengths)

    for batch in batches:
        others = [c.to_pylist() for c in batch.columns[1:]]
        for k, text in enumerate(batch.column(0)):
            found = text.as_py().translate(WORDS).split()
            if rows and (total + len(found) > most_words or len(rows) >= most_docs):
                yield close()
                numbers, parts, rows, total = defaultdict(count().__next__), [], [], 0
            parts.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
            rows.append(tuple(c[k] for c in others))
            total += len(found)
    if rows:
        yield close()


def task_numbers() -> Iterator[int]:
    """Numbers that no other task of the same job gives out."""
    return count(TaskContext.get().partitionId() << 40)
