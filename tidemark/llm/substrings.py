"""Substring dedup: recurring passages located by sharded Aho-Corasick automata.

1. Nominate. Every window of words is hashed; a batch of documents sends each of its distinct
   hashes, with the smallest doc_id that has it, to the hash's bucket. The bucket tells the batch of
   the smallest doc_id which of its windows recur in which other batches: an entry per window and
   batch, not one per document.
2. Confirm. That batch cuts the nominated windows from its documents, as the passages that adjoining
   windows make, and sends their words to the batches where they recur.
3. Locate. A batch's passages, those sent and those that recur within it, are one shard: blocks of
   every passage, so spaced that each window holds a whole one, are compiled into an automaton, and
   all documents of the batch stream through it. Where a block is found the words around it are
   compared with the passage; a window that agrees goes if the passage's document comes first. So
   a hash only nominates, and two windows of one hash never remove each other's words.

Words are numbered within a shard and written as fixed-width digits, so that the automaton's nodes
have few children; matches that don't start on a word are skipped. Documents are read once, and they
and their windows go through one exchange.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import doc_batches, only, pack_arrays, unpack_arrays

BATCH_BYTES = 4 << 20
#: A null doc_id comes after all others.
LAST = np.iinfo(np.int64).max
BASE = 64


def numbered(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word in turn, equal words alike, and the hashes of the words by number."""
    distinct = dict.fromkeys(chain.from_iterable(words))  # in order of appearance, which keeps lookups local
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, distinct), dtype=np.uint64, count=len(distinct))
    number = dict(zip(distinct, range(len(distinct)), strict=True))
    return np.fromiter(map(number.__getitem__, chain.from_iterable(words)), dtype=np.int64, count=sum(map(len, words))), hashes


class Shard:
    """The windows of a batch of documents."""

    def __init__(self, ids: list, texts: list[bytes], window: int):
        self.window = window
        self.ids = np.array([LAST if i is None else i for i in ids], dtype=np.int64)
        self.words = [t.split() for t in texts]
        sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        self.numbers, hashes = numbered(self.words)
        self.distinct = len(hashes)
        self.start = np.concatenate(([0], np.cumsum(sizes)))
        counts = np.maximum(sizes - window + 1, 0)
        self.doc = np.repeat(np.arange(len(sizes)), counts)
        first = np.concatenate(([0], np.cumsum(counts)))
        self.at = np.arange(len(self.doc)) - first[self.doc] + self.start[self.doc]
        self.codes = window_hashes(hashes[self.numbers], window)[self.at]

    def distinct_windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct hashes; each one's smallest doc_id, a window of it there, and whether a
        larger doc_id has it too."""
        ids = self.ids[self.doc]
        order = np.lexsort((ids, self.codes))
        codes, ids = self.codes[order], ids[order]
        edge = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.empty(0, dtype=np.int64)
        last = np.append(edge[1:], len(codes)) - 1 if len(codes) else edge
        return codes[edge], ids[edge], order[edge], ids[last] > ids[edge]

    def passages(self, windows: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """The stretches of words that the windows make where they adjoin, as (doc_id, start, end).
        windows are in order."""
        cut = np.flatnonzero((np.diff(windows) != 1) | (np.diff(self.doc[windows]) != 0)) + 1
        for part in np.split(windows, cut) if len(windows) else ():
            yield int(self.ids[self.doc[part[0]]]), int(self.at[part[0]]), int(self.at[part[-1]]) + self.window

    def removals(self, sent: list[tuple[int, list[bytes]]]) -> list[np.ndarray]:
        """For each document, which words to remove. sent: passages of other batches, as (doc_id, words)."""
        _, _, first, again = self.distinct_windows()
        known: list[tuple[int, np.ndarray]] = [(i, self.numbers[a:b]) for i, a, b in self.passages(np.sort(first[again]))]
        if sent:
            number = dict(zip(chain.from_iterable(self.words), self.numbers.tolist(), strict=True))
            known += [(i, np.array([number.get(w, -1) for w in words], dtype=np.int64)) for i, words in sent]
        find, width = self._automaton(known)
        digits = self._digits(self.numbers, width) if find else ""
        block = (self.window + 1) // 2
        out = []
        for n in range(len(self.ids)):
            a, b = int(self.start[n]), int(self.start[n + 1])
            gone = bytearray(b - a)
            if find and b - a >= self.window:
                own = self.numbers[a:b].tolist()
                for end, found in find.iter(digits[a * width : b * width]):
                    if (end + 1) % width == 0:
                        self._mark(gone, own, (end + 1) // width - block, found, int(self.ids[n]))
            out.append(np.frombuffer(gone, dtype=np.uint8) > 0)
        return out

    def _mark(self, gone: bytearray, own: list[int], j: int, found: list[tuple[int, list[int], int]], doc_id: int) -> None:
        """Mark the windows that hold the block at j and agree with a passage. found has the
        passages with this block, by doc_id, and where in them it is."""
        block = (self.window + 1) // 2
        reach = self.window - block
        lo, hi = max(0, j - reach), min(len(own), j + block + reach)
        for owner, words, o in found:
            if owner >= doc_id or gone.find(0, lo, hi) < 0:
                return
            left, right = 0, block
            while left < min(o, j - lo) and words[o - left - 1] == own[j - left - 1]:
                left += 1
            while right < min(len(words) - o, hi - j) and words[o + right] == own[j + right]:
                right += 1
            if left + right >= self.window:
                gone[j - left : j + right] = b"\x01" * (left + right)

    def _digits(self, numbers: np.ndarray, width: int) -> str:
        out = np.empty((len(numbers), width), dtype=np.uint8)
        for i in range(width):
            out[:, i] = numbers // BASE**i % BASE + 48
        return out.tobytes().decode("latin-1")

    def _automaton(self, passages: list[tuple[int, np.ndarray]]):
        """The passages' blocks compiled, each with (doc_id, words, place) of those that hold it; and
        the width of a word."""
        width, block = 1, (self.window + 1) // 2
        while BASE**width < self.distinct:
            width += 1
        held: dict[str, list[tuple[int, list[int], int]]] = {}
        for owner, numbers in passages:
            digits, words = self._digits(np.maximum(numbers, 0), width), numbers.tolist()
            for o in range(0, len(words) - block + 1, block):
                if min(words[o : o + block]) >= 0:
                    held.setdefault(digits[o * width : (o + block) * width], []).append((owner, words, o))
        if not held:
            return None, width
        find = ahocorasick.Automaton()
        for key, found in held.items():
            find.add_word(key, sorted(found, key=lambda x: x[0]))
        find.make_automaton()
        return find, width


def window_hashes(hashed: np.ndarray, window: int) -> np.ndarray:
    """The hash of every window over words' hashes."""
    code = np.zeros(max(0, len(hashed) - window + 1), dtype=np.uint64)
    for i in range(window):
        code *= np.uint64(0x9E3779B97F4A7C15)
        code += hashed[i : i + len(code)]
    code ^= code >> np.uint64(29)
    code *= np.uint64(0xBF58476D1CE4E5B9)
    return code ^ (code >> np.uint64(32))


CUT = "key long, batch long, data binary"


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 3
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["key", "batch", "data"])


def _rows_of(codes: np.ndarray, owner: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per bucket that has some, the places of its hashes in the order in which they are sent."""
    edge = np.searchsorted((codes >> np.uint64(64 - bits)).astype(np.int64), np.arange((1 << bits) + 1))
    for b in np.flatnonzero(np.diff(edge)).tolist():
        yield b, edge[b] + np.argsort(owner[edge[b] : edge[b + 1]], kind="stable")


def _cut(window: int, bits: int, batch_bytes: int):
    """mapInArrow body: each batch's documents under key -1 - batch, and its windows by bucket."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch, ids, texts in doc_batches(rows, batch_bytes):
            codes, owner, _, _ = Shard(ids, texts, window).distinct_windows()
            out = [(-1 - batch, batch, pack_docs(ids, texts))]
            for b, places in _rows_of(codes, owner, bits):
                low = np.ascontiguousarray(codes[places]).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].ravel()
                steps = squeeze.compress(np.diff(owner[places], prepend=0).astype("<i8").tobytes())
                out.append((b, batch, pack_arrays(low, np.frombuffer(steps, dtype=np.uint8))))
            yield from _table(out).to_batches(64)

    return run


def _nominate(bits: int):
    """For a bucket: to the batch of each recurring window's smallest document, the window's place in
    the row that it sent and the batches where it recurs."""

    def run(rows: pa.Table) -> pa.Table:
        if rows["key"][0].as_py() < 0:
            return _table([])
        opened, squeeze = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        codes, owners, row, place = [], [], [], []
        for n, data in enumerate(rows["data"]):
            low, steps = unpack_arrays(data.as_py())
            part = np.zeros((len(low) // 7, 8), dtype=np.uint8)
            part[:, :7] = low.reshape(-1, 7)
            codes.append(part.view("<u8").ravel())
            owners.append(np.cumsum(np.frombuffer(opened.decompress(steps.tobytes()), dtype="<i8")))
            row.append(np.full(len(part), n, dtype=np.int32))
            place.append(np.arange(len(part), dtype=np.int32))
        codes, owners, row, place = map(np.concatenate, (codes, owners, row, place))
        order = np.lexsort((row, owners, codes))
        codes, owners, row, place = codes[order], owners[order], row[order], place[order]
        edge = np.concatenate(([True], codes[1:] != codes[:-1]))
        head = np.flatnonzero(edge)[np.cumsum(edge) - 1]
        later = np.flatnonzero(owners > owners[head])
        by = later[np.argsort(row[head[later]], kind="stable")]
        batch = rows["batch"].to_numpy()
        out = []
        for part in np.split(by, np.flatnonzero(np.diff(row[head[by]])) + 1) if len(by) else ():
            sender = int(batch[row[head[part[0]]]])
            data = pack_arrays(place[head[part]].astype("<u4"), batch[row[part]])
            out.append((-1 - sender, rows["key"][0].as_py(), squeeze.compress(data)))
        return _table(out)

    return run


def pack_docs(ids: list, texts: list[bytes]) -> bytes:
    """Documents as a compressed Arrow table, for unpack()."""
    table = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.large_binary())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue())


def unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_all()


def bucket_bits(docs: DataFrame, bucket_bytes: int = 32 << 20) -> int:
    """Bits of the bucket number, so that a bucket has the windows of about bucket_bytes of text."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(8, int(np.ceil(np.log2(max(1, size) / bucket_bytes))))


OUT = "doc_id long, text string, n_words long, n_removed long, spans array<struct<start:int,end:int>>"


def remove_repeats(docs: DataFrame, window: int = 13, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(doc_id, text, n_words, n_removed, spans) for each row of docs.

    text has the kept words joined by one space, spans the ranges of removed words. A word goes if
    a window that covers it also starts in a document of smaller doc_id. Null texts have no words.
    Rows with equal ids don't affect each other; null ids come after all others. An empty table
    gives an empty result.
    """
    rows = only(docs, "doc_id", "text")
    bits = bucket_bits(rows)
    cut = rows.mapInArrow(_cut(window, bits, batch_bytes), CUT)  # one exchange, used three times
    asked = cut.groupBy("key").applyInArrow(_nominate(bits), CUT)

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table([])
        me, opened, squeeze = left["batch"][0].as_py(), zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        table = unpack(left["data"][0].as_py())
        shard = Shard(table["doc_id"].to_pylist(), table["text"].to_pylist(), window)
        codes, owner, first, _ = shard.distinct_windows()
        sent = dict(_rows_of(codes, owner, bits))
        windows, target = [], []
        for b, data in zip(right["batch"].to_pylist(), right["data"], strict=True):
            place, to = unpack_arrays(opened.decompress(data.as_py()))
            windows.append(first[sent[b][place]])
            target.append(to)
        windows, target = np.concatenate(windows), np.concatenate(target)
        order = np.lexsort((windows, target))
        windows, target = windows[order], target[order]
        words = list(chain.from_iterable(shard.words))
        out = []
        for a, b in _stretches(target):
            found = list(shard.passages(windows[a:b]))
            data = b"\n".join(b" ".join(words[x:y]) for _, x, y in found)
            owners = np.array([i for i, _, _ in found], dtype="<i8")
            out.append((-1 - int(target[a]), me, squeeze.compress(pack_arrays(owners, np.frombuffer(data, dtype=np.uint8)))))
        return _table(out)

    passages = cut.groupBy("key").cogroup(asked.groupBy("key")).applyInArrow(send, CUT)

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and left["key"][0].as_py() < 0:
            opened = zstandard.ZstdDecompressor()
            sent = []
            for _, data in sorted(zip(right["batch"].to_pylist(), right["data"].to_pylist(), strict=True)):
                owners, text = unpack_arrays(opened.decompress(data))
                sent += zip(owners.tolist(), (x.split(b" ") for x in text.tobytes().split(b"\n")), strict=True)
            table = unpack(left["data"][0].as_py())
            ids, texts = table["doc_id"].to_pylist(), table["text"].to_pylist()
            shard = Shard(ids, texts, window)
            for i, words, gone in zip(ids, shard.words, shard.removals(sent), strict=True):
                edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                spans = [{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()]
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if spans else words
                out.append((i, b" ".join(kept), len(words), int(gone.sum()), spans))
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        i, text, n, m, spans = zip(*out, strict=True) if out else ((),) * 5
        columns = [pa.array(i, pa.int64()), pa.array(text, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(spans, span)]
        return pa.Table.from_arrays(columns, ["doc_id", "text", "n_words", "n_removed", "spans"])

    return cut.groupBy("key").cogroup(passages.groupBy("key")).applyInArrow(remove, OUT)


def _stretches(sorted_: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of equal entries."""
    cut = (np.flatnonzero(np.diff(sorted_)) + 1).tolist()
    yield from zip([0, *cut], [*cut, len(sorted_)], strict=True)
