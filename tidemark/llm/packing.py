"""Packing documents' tokens into sequences of bounded length: bounded-space online best-fit.

Each task reads its documents once and puts their pieces into a fixed number of open bins, kept in
lists by free space with a bitset of the free spaces that there are. A piece goes to the fullest bin
that takes it; if none does and all bins are open, the fullest one closes for a new one. A full bin
closes at once. Pieces that are still in open bins when a task ends are packed in the same way by
fewer tasks, round by round, until one task closes its bins: a round's tasks get at most SHARE times
the tokens that they can leave open, so that their number falls and no task grows with the corpus.
The last one takes its pieces longest first and has bins for all that it can get.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import column, materialize, only, sliced

#: Tokens that a task of a later round gets, in times of what its open bins hold.
SHARE = 16
#: Distinct runs whose ids are remembered, besides those of one batch.
REMEMBERED = 500_000
#: The normalizer and the pattern that a tokenizer's file must have for texts to be cut here.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts that are not cut here have characters other than Latin-1's letters, ASCII and its white space, or may name a special token.
ODD = r"[^\x09-\x0D\x20-~À-ÖØ-öø-ÿ]|<\|"
RUN = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\x09-\x0D ]+"
#: Bytes of text that are cut into words at once.
STRETCH = 4 << 20
FIELDS = ("piece", "start", "length", "ids_crc32", "sequence_id", "offset")
SCHEMA = "piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class Encoder:
    """Ids of texts. Texts of Latin letters, digits and ASCII marks are cut into runs a batch at a
    time, as the tokenizer's file says (lower case, then GPT's pattern), and each run that is new
    goes to the library's model once; all other texts go to the library as they are.

    Tests hold both ways against the library on whole texts.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.model = Tokenizer.from_file(path)  # for runs, joined by spaces
        self.model.normalizer = None
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        suffix, vocabulary = rules["model"].get("end_of_word_suffix"), rules["model"]["vocab"]
        self.cuts = bool(suffix) and rules["normalizer"] == NORMALIZER and rules["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] == PATTERN
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        if suffix:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.known: dict[bytes, bytes] = {b"": b""}

    def runs(self, runs: list[bytes]) -> list[bytes]:
        """Each run's ids as little-endian unsigned 32-bit numbers."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
            known[b""] = b""
        new = [r for r in runs if r not in known]
        for k in range(0, len(new), 500):
            ids = np.array(self.model.encode_batch_fast([b" ".join(new[k : k + 500]).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
            data, start = ids.tobytes(), 0
            for run, end in zip(new[k : k + 500], (4 * np.flatnonzero(self.ends[ids]) + 4).tolist(), strict=True):
                known[run] = data[start:end]
                start = end
        return [known[r] for r in runs]

    def texts(self, texts: list[bytes]) -> list[np.ndarray]:
        """Each text's ids."""
        col = pa.array(texts, type=pa.binary()).cast(pa.string())
        odd = pc.match_substring_regex(col, ODD).to_numpy(zero_copy_only=False) if self.cuts else np.ones(len(texts), dtype=bool)
        spaced = pc.replace_substring_regex(pc.utf8_lower(pc.if_else(pa.array(odd), "", col)), RUN, r"\0 ")
        split = pc.ascii_split_whitespace(spaced)
        coded = split.flatten().dictionary_encode()
        ids = self.runs(coded.dictionary.cast(pa.binary()).to_pylist())
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), dtype=np.int32, count=len(ids)) // 4)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(ids), dtype="<u4")).take(coded.indices)
        found, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy()
        words = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])
        out = np.split(found, ends[words[1:-1]])
        for i in np.flatnonzero(odd).tolist():
            out[i] = np.array(self.library.encode(texts[i].decode(), add_special_tokens=False).ids, dtype="<u4")
        return out

    def documents(self, rows: Iterator[tuple], end: int) -> Iterator[tuple]:
        """(doc_id, ids with the id ``end`` after them) for rows (doc_id, text)."""
        texts, owners, held, parts = [], [], 0, []

        def flushed() -> Iterator[tuple]:
            for ids, (doc_id, last) in zip(self.texts(texts), owners, strict=True):
                parts.append(ids)
                if last:
                    yield doc_id, np.concatenate([*parts, [end]]).astype("<u4")
                    parts.clear()
            texts.clear()
            owners.clear()

        for doc_id, text in rows:
            cut = [*stretches(text or b"")]
            for i, s in enumerate(cut, 1):
                texts.append(s)
                owners.append((doc_id, i == len(cut)))
                held += len(s)
                if held > STRETCH:
                    yield from flushed()
                    held = 0
        if texts:
            yield from flushed()


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def stretches(text: bytes) -> Iterator[bytes]:
    """text cut at line ends or spaces after about STRETCH bytes each."""
    at = 0
    while len(text) - at > STRETCH:
        to = max(text.rfind(b" ", at, at + STRETCH), text.rfind(b"\n", at, at + STRETCH))
        if to <= at:  # one word longer than a stretch
            found = [x for x in (text.find(b" ", at + STRETCH), text.find(b"\n", at + STRETCH)) if x >= 0]
            to = min(found, default=len(text))
        yield text[at:to]
        at = to
    yield text[at:]


class Bins:
    """Open bins by free space. A bin is the list of (row, offset) in it."""

    def __init__(self, capacity: int, most: int) -> None:
        self.capacity, self.most = capacity, most
        self.by_free: list[list[list]] = [[] for _ in range(capacity + 1)]
        self.bits = self.n = 0

    def _take(self, free: int) -> list:
        at = self.by_free[free]
        found = at.pop()
        if not at:
            self.bits ^= 1 << free
        return found

    def put(self, size: int, row: tuple) -> Iterator[list]:
        """Place a row; yields the bins that close by it."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            held = self._take(free)
        else:
            free, held = self.capacity, []
            if size < free:
                if self.n == self.most:
                    yield self._take((self.bits & -self.bits).bit_length() - 1)
                else:
                    self.n += 1
        held.append((row, self.capacity - free))
        if free > size:
            self.by_free[free - size].append(held)
            self.bits |= 1 << (free - size)
        else:
            self.n -= free < self.capacity
            yield held

    def rest(self) -> Iterator[list]:
        for held in self.by_free:
            yield from held


def _packed(rows: Iterator[tuple[int, tuple]], capacity: int, most: int, turn: int, last: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """rows (size, (doc_id, piece, start, length, crc)) with sequence and offset; rows of bins that
    stay open have none, unless this is the last round."""
    bins, out, n = Bins(capacity, most), [], 0
    name = (turn << 58) + (TaskContext.get().partitionId() << 28)

    def add(held: list, number: int | None) -> None:
        for row, offset in held:
            out.append((*row, number, None if number is None else offset))

    def flushed() -> pa.RecordBatch:
        arrays = [pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    for size, row in rows:
        for held in bins.put(size, row):
            add(held, name + n)
            n += 1
        if len(out) >= 20_000:
            yield flushed()
    for held in bins.rest():
        add(held, name + n if last else None)
        n += 1
        if len(out) >= 20_000:
            yield flushed()
    if out:
        yield flushed()


def pieces_of(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end: int) -> Iterator[tuple[int, tuple]]:
    rows = (r for b in sliced(batches, 256) for r in zip(column(b, "doc_id"), column(b, "text"), strict=True))
    for doc_id, ids in encoder(path).documents(rows, end):
        for k, at in enumerate(range(0, len(ids), capacity)):
            piece = ids[at : at + capacity]
            yield len(piece), (doc_id, k, at, len(piece), zlib.crc32(piece))


def pack(docs: DataFrame, path: str, capacity: int = 2048, open_bins: int = 512, end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): where each piece of each
    document lies.

    A document is its text's ids (a null text counts as empty) and the id ``end``; only documents of
    more than ``capacity`` tokens are cut, into pieces of that length and a last one. Sequences are
    filled from offset 0 without gaps. Repeated rows and null doc_ids are documents of their own; an
    empty table gives no rows. ``open_bins`` bounds a task's memory to as many sequences.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCHEMA}"
    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], kind).schema)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _packed(pieces_of(batches, path, capacity, end), capacity, open_bins, 0, False, schema)

    def again(turn: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ("doc_id", *FIELDS[:4])
            rows = (r for b in sliced(batches, 8192) for r in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in names), strict=True))
            return _packed(((r[3], r) for r in rows), capacity, 2 * SHARE * open_bins if last else open_bins, turn, last, schema)

        return run

    packed = materialize(only(docs, "doc_id", "text").mapInArrow(first, kind), "packed")
    out, turn = packed.where("sequence_id is not null"), 0
    while tokens := packed.where("sequence_id is null").agg(F.sum("length")).first()[0]:
        tasks, turn = -(-tokens // (SHARE * open_bins * capacity)), turn + 1
        left = packed.where("sequence_id is null").repartition(tasks)
        left = left.sortWithinPartitions(F.desc("length")) if tasks == 1 else left
        packed = materialize(left.mapInArrow(again(turn, tasks == 1), kind), "packed")
        out = out.union(packed.where("sequence_id is not null"))
    return out
