"""Helpers shared by the training-data operators.

Text is handled as UTF-8 bytes inside tasks: ``bytes.split()``, ``strip`` and ``lower``
work on the ASCII classes only, which is what the operators define (words are runs of
anything but ``[\\x20\\x09-\\x0D]``; only A-Z is lower-cased).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.stage import drop_written, written

SPACE = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

materialize, drop_temporary = written, drop_written


def column(batch: pa.RecordBatch, name: str) -> list:
    """A column as Python values, strings as their UTF-8 bytes."""
    col = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
        col = col.cast(pa.large_binary())
    return col.to_pylist()


def sliced(batches: Iterator[pa.RecordBatch], n: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that few of them are held as Python values at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)


def doc_batches(
    rows: Iterator[pa.RecordBatch], target_bytes: int
) -> Iterator[tuple[int, list, list[bytes]]]:
    """Group a partition's (doc_id, text) rows into batches of about target_bytes of text.

    Yields (batch id, ids, texts). The id holds the partition and a running number, so that
    two readings of the same scan give the same batches.
    """
    part, n = TaskContext.get().partitionId(), 0
    ids: list = []
    texts: list[bytes] = []
    held = 0
    for batch in sliced(rows):
        for i, t in zip(column(batch, "doc_id"), column(batch, "text"), strict=True):
            ids.append(i)
            texts.append(t or b"")
            held += len(texts[-1]) + 16
            if held >= target_bytes:
                yield (part << 24) + n, ids, texts
                ids, texts, held, n = [], [], 0, n + 1
    if ids:
        yield (part << 24) + n, ids, texts


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Flat arrays in one blob, for unpack_arrays()."""
    head = ";".join(f"{a.dtype.str},{len(a)}" for a in arrays).encode()
    return len(head).to_bytes(4, "little") + head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack_arrays(data: bytes) -> list[np.ndarray]:
    at = 4 + int.from_bytes(data[:4], "little")
    out = []
    for field in data[4:at].decode().split(";"):
        kind, n = field.split(",")
        out.append(np.frombuffer(data, dtype=kind, count=int(n), offset=at))
        at += out[-1].nbytes
    return out


class WordHash(dict):
    """word -> XXH64, computed once for each distinct word of a batch."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word, 0)
        return h


def signed(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a, dtype=np.uint64).view(np.int64)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns of any name can't get in the way."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def hidden(df: DataFrame, *keep: str) -> DataFrame:
    """df with columns named by their places but for those kept, so that none clashes with a name
    used inside; toDF() with df's own names brings them back."""
    return df.toDF(*(c if c in keep else f"_{i}" for i, c in enumerate(df.columns)))
