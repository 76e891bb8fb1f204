"""SentencePiece encoding and decoding as a relational lattice.

Texts are cut into units that no piece crosses: a newline, or spaces and what follows them. Of each
distinct unit the substrings of bounded length are exploded and joined with the piece table; the
edges that meet a piece are grouped by unit and folded with ``aggregate``: Viterbi for unigram
models, the model's merges for BPE models, whose scores are ranks that a best path over sums would
misread. The merges take the edges from best to worst score, then leftmost, in one pass. That is
right if every piece's own merges come in order of rank: while an edge's ends are boundaries, what
lies between them merges as the piece alone would, so that at its turn there are its two parts or
never will be. ``Vocabulary.check`` tests this for each piece.

Documents are read once: a batch becomes one row with its texts as numbers of its distinct units,
and one row per bucket with those units. Both kinds of row go through one exchange.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import column, only, pack_arrays, sliced, unpack_arrays
from tidemark.llm.substrings import bucket_bits

SPACE = "▁"
UNIT = re.compile(rb"\n|(?: |\xe2\x96\x81)*[^ \n]+| +")
BATCH_BYTES = 16 << 20
#: Boundaries of units up to BITS characters are bits of a long, of longer ones characters of a string.
BITS = 60
#: Units of more characters are merged with a heap in the task: a fold's cost grows with the square.
LONGEST = 4096
#: Most pieces that are broadcast; a vocabulary is of fixed size, whatever the corpus.
MOST_PIECES = 1_000_000


@dataclass
class Vocabulary:
    """Pieces with scores and kinds: 'normal', 'byte' or 'other' (never matched)."""

    pieces: list[str]
    scores: list[float]
    kinds: list[str]
    unk: int = 0
    unigram: bool = False

    @classmethod
    def load(cls, path: str, unigram: bool = False) -> Vocabulary:
        """Read a .model file with the sentencepiece library. unigram: fold by Viterbi."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(len(sp))
        kind = lambda i: "byte" if sp.is_byte(i) else "other" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "normal"
        return cls([sp.id_to_piece(i) for i in n], [sp.get_score(i) for i in n], [kind(i) for i in n], sp.unk_id(), unigram).check()

    def check(self) -> Vocabulary:
        """Refuse a BPE vocabulary with a piece whose own merges don't come in order of rank."""
        rank = {p: n for n, (p, _, _) in enumerate(sorted(self.normal(), key=lambda x: (-x[1], x[2])))}
        for piece, own in rank.items() if not self.unigram else ():
            parts = list(piece)
            while len(parts) > 1:
                options = [(rank[x + y], at) for at, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in rank]
                if not options or len(parts) > 2 and min(options)[0] > own:
                    raise ValueError(f"piece {piece!r} is not made by merges in order of rank")
                at = min(options)[1]
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self

    def normal(self) -> list[tuple[str, float, int]]:
        return [(p, float(s), i) for i, (p, s, k) in enumerate(zip(self.pieces, self.scores, self.kinds, strict=True)) if k == "normal"]

    def byte_ids(self) -> list[int]:
        """Id of each byte's piece; the unknown id where there is none."""
        out = [self.unk] * 256
        for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)):
            if k == "byte":
                out[int(p[3:5], 16)] = i
        return out


def units_of(text: bytes) -> list[bytes]:
    """The units of a text, spaces not yet replaced; a space is put before the text."""
    return UNIT.findall(b" " + text) if text else []


def _pieces(spark: SparkSession, vocabulary: Vocabulary) -> DataFrame:
    """(piece, score, rank, id); rank 0 has the best score."""
    rows = sorted(vocabulary.normal(), key=lambda x: (-x[1], x[2]))
    if len(rows) > MOST_PIECES:
        raise ValueError(f"{len(rows)} pieces; at most {MOST_PIECES} are broadcast")
    rows = [(p, s, rank, i) for rank, (p, s, i) in enumerate(rows)]
    return F.broadcast(spark.createDataFrame(rows, "piece string, score double, rank long, id long"))


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


#: An edge as a long, best first: rank, start and length.
RANK_AT, START_AT = 40, 20
FIELD = (1 << 20) - 1


def _start(x: Column) -> Column:
    return F.shiftright(x, START_AT).bitwiseAND(F.lit(FIELD)).cast("int")


def _length(x: Column) -> Column:
    return x.bitwiseAND(F.lit(FIELD)).cast("int")


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at)


def _inner(bounds: Column, x: Column) -> Column:
    """The boundaries strictly inside an edge."""
    return bounds.bitwiseAND(_bit(_start(x) + _length(x)) - _bit(_start(x) + 1))


def _ends_hold(bounds: Column, x: Column) -> Column:
    ends = _bit(_start(x)).bitwiseOR(_bit(_start(x) + _length(x)))
    return bounds.bitwiseAND(ends) == ends


def _merged(n: Column, edges: Column) -> Column:
    """The sorted edges that are left: an edge whose ends are boundaries with just one boundary
    between them takes that one away. n is at most BITS."""

    def step(bounds, x):
        inner = _inner(bounds, x)
        one = (inner != 0) & (inner.bitwiseAND(inner - 1) == 0)
        return F.when(one & _ends_hold(bounds, x), bounds - inner).otherwise(bounds)

    everywhere = _bit(n + 1) - 1
    bounds = F.aggregate(edges, everywhere, step)
    return _let(bounds, lambda b: F.filter(edges, lambda x: (_inner(b, x) == 0) & _ends_hold(b, x)))


def _merged_long(n: Column, edges: Column) -> Column:
    """_merged() for any n: boundaries are the 1s of a string of n + 1 characters."""

    def between(bounds, x):
        """What an edge spans, its ends included; and its 1s alone."""
        part = F.substr(bounds, _start(x) + 1, _length(x) + 1)
        return part, F.replace(part, F.lit("0"), F.lit(""))

    def holds(part, ones, count):
        return (ones == F.lit("1" * count)) & part.startswith("1") & part.endswith("1")

    def step(bounds, x):
        part, ones = between(bounds, x)
        inner = _start(x) + F.call_function("locate", F.lit("1"), part, F.lit(2))
        return F.when(holds(part, ones, 3), F.overlay(bounds, F.lit("0"), inner, F.lit(1))).otherwise(bounds)

    bounds = F.aggregate(edges, F.repeat(F.lit("1"), n + 1), step)
    return _let(bounds, lambda b: F.filter(edges, lambda x: holds(*between(b, x), 2)))


def _viterbi(n: Column, edges: Column, lowest: float) -> Column:
    """Spans, as above, of the path with the greatest sum of scores; a character without a piece
    costs lowest - 10. edges are structs (e, s, score, id)."""
    start = F.transform(
        F.sequence(F.lit(0), n),
        lambda p: F.struct(F.when(p == 0, F.lit(0.0)).otherwise(F.lit(float("-inf"))).alias("score"), F.lit(-1).alias("s"), F.lit(-1).cast("long").alias("id")),
    )
    lone = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct((i + 1).alias("e"), i.alias("s"), F.lit(lowest - 10).alias("score"), F.lit(-1).cast("long").alias("id")),
    )

    def step(best, x):
        def put(v, i):
            score = F.get(best, x["s"])["score"] + x["score"]
            return F.when((i == x["e"]) & (score > v["score"]), F.struct(score.alias("score"), x["s"].alias("s"), x["id"].alias("id"))).otherwise(v)

        return F.transform(best, put)

    best = F.aggregate(F.array_sort(F.concat(edges, lone)), start, step)

    def follow(best):
        back = F.aggregate(
            F.sequence(F.lit(1), n),
            F.array(n),
            lambda path, _: F.when(F.get(path, F.lit(0)) == 0, path).otherwise(F.concat(F.array(F.get(best, F.get(path, F.lit(0)))["s"]), path)),
        )
        known = F.filter(back, lambda e: F.get(best, e)["id"] >= 0)
        return F.transform(known, lambda e: F.shiftleft(F.get(best, e)["s"].cast("long"), 20) + F.get(best, e)["id"])

    return _let(best, follow)


def lattice(units: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(bucket, unit, spans) for distinct units of at most LONGEST characters, U+2581 for spaces.

    spans has start << 20 | id of each piece under Viterbi, rank, start and length of each under
    merges, in any order (Helper.spans reads either); characters without a piece have none,
    nor have lone characters under merges, which only join two pieces or more, and units without
    any edge are left out. With units partitioned by bucket, neither the explode
    nor the broadcast join moves rows, and grouping needs no further shuffle.
    """
    pieces = _pieces(units.sparkSession, vocabulary)
    longest = max((len(p) for p, _, _ in vocabulary.normal()), default=1)
    n = F.char_length("unit")
    least = 1 if vocabulary.unigram else 2
    starts = units.where(n >= least).select("bucket", "unit", F.explode(F.sequence(F.lit(0), n - least)).alias("s"))
    cut = starts.select("bucket", "unit", "s", F.explode(F.sequence(F.lit(least), F.greatest(F.lit(least), F.least(F.lit(longest), n - F.col("s"))))).alias("k"))
    edges = cut.withColumn("piece", F.substr("unit", F.col("s") + 1, F.col("k"))).join(pieces, "piece")
    s, e = F.col("s"), F.col("s") + F.col("k")
    if vocabulary.unigram:
        entry = F.struct(e.alias("e"), s.alias("s"), "score", "id")
    else:
        entry = F.shiftleft("rank", RANK_AT) + F.shiftleft(s.cast("long"), START_AT) + F.col("k")
    grouped = edges.select("bucket", "unit", entry.alias("edge")).groupBy("bucket", "unit").agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    lowest = min((s for _, s, _ in vocabulary.normal()), default=0.0)
    edges = F.col("edges")
    merged = F.when(n <= BITS, _merged(n, edges)).otherwise(_merged_long(n, edges))
    spans = _viterbi(n, edges, lowest) if vocabulary.unigram else merged
    return grouped.select("bucket", "unit", spans.alias("spans"))


class Helper:
    """One unit at a time, for those that the lattice leaves out, and the ids of lone characters."""

    def __init__(self, vocabulary: Vocabulary):
        self.at = {p: (s, i) for p, s, i in vocabulary.normal()}
        self.pieces, self.bytes, self.unigram = vocabulary.pieces, vocabulary.byte_ids(), vocabulary.unigram
        self.kinds, self.unk = set(vocabulary.kinds), vocabulary.unk
        self.lowest = min((s for s, _ in self.at.values()), default=0.0)
        self.ranked = [i for _, _, i in sorted(vocabulary.normal(), key=lambda x: (-x[1], x[2]))]

    def spell(self, char: str) -> list[int]:
        """Byte pieces, or one unknown id where the vocabulary has none."""
        return [self.bytes[b] for b in char.encode()] if "byte" in self.kinds else [self.unk]

    def lone(self, char: str) -> list[int]:
        return [self.at[char][1]] if char in self.at else self.spell(char)

    def spans(self, edges: Iterable[int]) -> list[tuple[int, int]]:
        """The lattice's spans in order, as (start, id)."""
        if self.unigram:
            return sorted((x >> 20, x & FIELD) for x in edges)
        return sorted((x >> START_AT & FIELD, self.ranked[x >> RANK_AT]) for x in edges)

    def fill(self, unit: str, edges: Iterable[int]) -> list[int]:
        """The ids of a unit from the lattice's spans; characters between them stand alone."""
        out: list[int] = []
        pos = 0
        for start, i in self.spans(edges):
            for char in unit[pos:start]:
                out += self.lone(char)
            out.append(i)
            pos = start + len(self.pieces[i])
        for char in unit[pos:]:
            out += self.lone(char)
        return out

    def encode(self, unit: str) -> list[int]:
        parts = self._best_path(unit) if self.unigram else self._merge(unit)
        return [i for p in parts for i in ([self.at[p][1]] if p in self.at else self.spell(p))]

    def _merge(self, unit: str) -> list[str]:
        parts: list[str | None] = list(unit)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(parts) and (p := parts[a] + parts[b]) in self.at:
                heapq.heappush(heap, (-self.at[p][0], a, b, p))

        for a in range(len(parts) - 1):
            offer(a, a + 1)
        while heap:
            _, a, b, p = heapq.heappop(heap)
            if parts[a] is None or parts[b] is None or parts[a] + parts[b] != p:
                continue
            parts[a], parts[b] = p, None
            after[a] = after[b]
            if after[a] < len(parts):
                before[after[a]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [p for p in parts if p is not None]

    def _best_path(self, unit: str) -> list[str]:
        longest = max(map(len, self.at), default=1)
        best = [(0.0, -1)]
        for e in range(1, len(unit) + 1):
            options = [(best[s][0] + (self.at[unit[s:e]][0] if unit[s:e] in self.at else self.lowest - 10), -s) for s in range(max(0, e - longest), e) if e - s == 1 or unit[s:e] in self.at]
            score, s = max(options)
            best.append((score, -s))
        parts, e = [], len(unit)
        while e:
            parts.append(unit[best[e][1] : e])
            e = best[e][1]
        return parts[::-1]


class Numbers(dict):
    """Units by number, in order of appearance. A unit of one space and a word is kept under the
    word, any other one under a newline and itself, so that most words are looked up as split."""

    def __missing__(self, key: bytes) -> int:
        n = self[key] = len(self)
        return n

    def of(self, text: bytes) -> np.ndarray:
        """The numbers of a text's units (units_of), cut line by line."""
        out: list[int] = []
        get = self.__getitem__
        for n, line in enumerate((b" " + text).split(b"\n") if text else ()):
            if n:
                out.append(get(b"\n\n"))
            if b"  " in line or line[-1:] == b" " or b"\xe2\x96\x81" in line:
                for u in UNIT.findall(line):
                    plain = u[:1] == b" " and u[1:] and u[1:2] != b" " and u[1:4] != b"\xe2\x96\x81"
                    out.append(get(u[1:] if plain else b"\n" + u))
            elif line:
                first, *words = line.split(b" ")
                if first:
                    out.append(get(b"\n" + first))
                out += map(get, words)
        return np.array(out, dtype="<u4")

    def units(self) -> list[bytes]:
        return [k[1:] if k[:1] == b"\n" else b" " + k for k in self]


class Ragged:
    """Lists of ids in one array."""

    def __init__(self, size: np.ndarray, flat: np.ndarray):
        self.size, self.flat = size.astype(np.int64), flat
        self.start = np.cumsum(self.size) - self.size

    @classmethod
    def of(cls, lists: list[list[int]]) -> Ragged:
        return cls(np.array([len(x) for x in lists], dtype=np.int64), np.array([i for x in lists for i in x], dtype="<u4"))

    def take(self, places: np.ndarray) -> Ragged:
        size = self.size[places]
        at = np.repeat(self.start[places] - (np.cumsum(size) - size), size)
        at += np.arange(len(at))
        return Ragged(size, self.flat[at])

    def dumps(self) -> bytes:
        small = (a.astype(np.min_scalar_type(int(a.max(initial=0)))) for a in (self.size, self.flat))
        return pack_arrays(*small)

    @classmethod
    def loads(cls, data: bytes) -> Ragged:
        size, flat = unpack_arrays(data)
        return cls(size, flat.astype("<u4"))


CUT = "key long, batch long, data binary"
CUT_TYPES = {"key": pa.int64(), "batch": pa.int64(), "data": pa.binary()}


def _table(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], list(types))


def _cut(bits: int, batch_bytes: int):
    """mapInArrow body: of each batch its documents as numbers of units, under key -1 - batch, and
    its distinct units, newlines between them, under each one's bucket."""

    def rows_of(batch: int, ids: list, texts: list[np.ndarray], numbers: Numbers) -> Iterator[tuple]:
        squeeze = zstandard.ZstdCompressor(level=3)
        units = numbers.units()
        top = np.array([xxhash.xxh64_intdigest(u) for u in units], dtype=np.uint64) >> np.uint64(64 - bits)
        bucket = top.astype(np.min_scalar_type((1 << bits) - 1))
        flat = np.concatenate(texts) if texts else np.empty(0, dtype="<u4")
        planes = np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 4).T).ravel()
        lost = np.array([i is None for i in ids])
        kept = np.array([0 if i is None else i for i in ids], dtype="<i8")
        data = pack_arrays(kept, lost, np.array([len(t) for t in texts], dtype="<u4"), bucket, planes)
        yield -1 - batch, batch, squeeze.compress(data)
        order = np.argsort(bucket, kind="stable")
        edge = np.flatnonzero(np.diff(bucket[order].astype(np.int64), prepend=-1, append=1 << 62))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            own = order[a:b].tolist()
            yield int(bucket[own[0]]), batch, squeeze.compress(b"\n".join(b"" if units[i] == b"\n" else units[i] for i in own))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held = TaskContext.get().partitionId(), 0, 0
        ids, texts, numbers = [], [], Numbers()
        for batch in sliced(rows):
            for i, text in zip(column(batch, "doc_id"), column(batch, "text"), strict=True):
                ids.append(i)
                texts.append(numbers.of(text))
                held += len(text) + 16
                if held >= batch_bytes:
                    yield from _table(list(rows_of((part << 24) + n, ids, texts, numbers)), CUT_TYPES).to_batches(64)
                    ids, texts, numbers, held, n = [], [], Numbers(), 0, n + 1
        if ids:
            yield from _table(list(rows_of((part << 24) + n, ids, texts, numbers)), CUT_TYPES).to_batches(64)

    return run


def _opened(data: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(data).split(b"\n")


def written(unit: bytes) -> str:
    return unit.decode("utf-8", "replace").replace(" ", SPACE)


def _distinct(rows: pa.Table) -> pa.Table:
    """A bucket's distinct units; the newline's unit is empty here and has no lattice."""
    key = rows["key"][0].as_py()
    units = {u for data in rows["data"] for u in _opened(data.as_py())} if key >= 0 else ()
    units = sorted(u for u in map(written, units) if 0 < len(u) <= LONGEST)
    return pa.table({"bucket": pa.array([key] * len(units), pa.int64()), "unit": pa.array(units, pa.string())})


def encode(docs: DataFrame, vocabulary: Vocabulary, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(doc_id, ids) for each row of docs, as the sentencepiece library encodes the whole text.

    A null text gives null, an empty one no ids. Rows repeat as in docs; an empty table gives an
    empty result. A batch and a bucket exchange a row or none, so there are never more rows than
    distinct units of the batches.
    """
    rows = only(docs, "doc_id", "text")
    full = rows.where("text is not null")
    bits = bucket_bits(full)
    cut = full.mapInArrow(_cut(bits, batch_bytes), CUT)  # one exchange, used three times
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = cut.groupBy("key").applyInArrow(_distinct, "bucket long, unit string").repartition(tasks, "bucket")
    found = lattice(units, vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    types = {"key": pa.int64(), "bucket": pa.int64(), "ids": pa.binary()}

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or left["key"][0].as_py() < 0:
            return _table([], types)
        helper = Helper(shared.value)
        known = dict(zip(right["unit"].to_pylist(), right["spans"].to_pylist(), strict=True))
        squeeze = zstandard.ZstdCompressor(level=3)
        place: dict[bytes, int] = {}
        asked = []
        for data in left["data"]:
            asked.append(np.array([place.setdefault(u, len(place)) for u in _opened(data.as_py())], dtype=np.int64))
        each = []
        for u in map(written, (u or b"\n" for u in place)):
            each.append(helper.encode(u) if len(u) > LONGEST else helper.fill(u, known.get(u, ())))
        ids = Ragged.of(each)
        return _table(
            [(-1 - b, k, squeeze.compress(ids.take(x).dumps())) for b, k, x in zip(left["batch"].to_pylist(), left["key"].to_pylist(), asked, strict=True)],
            types,
        )

    answers = cut.groupBy("key").cogroup(found.groupBy("bucket")).applyInArrow(answer, "key long, bucket long, ids binary")

    def final(left: pa.Table, right: pa.Table) -> pa.Table:
        opened = zstandard.ZstdDecompressor()
        shape = {"doc_id": pa.int64(), "ids": pa.list_(pa.int32())}
        if not left.num_rows or left["key"][0].as_py() >= 0:
            return _table([], shape)
        own, lost, n_units, bucket, planes = unpack_arrays(opened.decompress(left["data"][0].as_py()))
        parts = [Ragged.loads(opened.decompress(x)) for _, x in sorted(zip(right["bucket"].to_pylist(), right["ids"].to_pylist(), strict=True))]
        known = Ragged(*(np.concatenate([getattr(p, k) for p in parts]) if parts else np.empty(0, dtype="<u4") for k in ("size", "flat")))
        if len(known.size) != len(bucket):
            raise RuntimeError("answers are missing")
        place = np.empty(len(bucket), dtype=np.int64)
        place[np.argsort(bucket, kind="stable")] = np.arange(len(bucket))
        ends = np.concatenate(([0], np.cumsum(n_units, dtype=np.int64)))
        numbers = np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()
        lists = []
        for a, b in _runs(n_units, 1 << 20):  # some documents at a time
            ids = known.take(place[numbers[ends[a] : ends[b]]])
            until = np.concatenate(([0], np.cumsum(ids.size)))[ends[a : b + 1] - ends[a]]
            lists.append(pa.ListArray.from_arrays(pa.array(until.astype(np.int32)), pa.array(ids.flat.astype(np.int32))))
        return pa.table({"doc_id": pa.array(own, mask=lost), "ids": pa.chunked_array(lists, shape["ids"])})

    out = cut.groupBy("key").cogroup(answers.groupBy("key")).applyInArrow(final, "doc_id long, ids array<int>")
    nulls = rows.where("text is null").select("doc_id", F.lit(None).cast("array<int>").alias("ids"))
    return out.union(nulls)


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of sizes that sum to about ``most``."""
    a, held = 0, 0
    for b, n in enumerate(sizes.tolist(), 1):
        held += n
        if held >= most or b == len(sizes):
            yield a, b
            a, held = b, 0


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, text) from (doc_id, ids), null from null: pieces put together, byte pieces as their
    bytes, U+2581 as a space, without the space that encoding puts first. Ids of no piece are refused."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        parts = [bytes([int(p[3:5], 16)]) if k == "byte" else p.replace(SPACE, " ").encode() if k == "normal" else b"" for p, k in zip(v.pieces, v.kinds, strict=True)]
        for batch in batches:
            out = []
            for ids in batch.column(1):
                ids = ids.as_py()
                out.append(None if ids is None else b"".join(parts[i] for i in ids).removeprefix(b" ").decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return only(encoded, "doc_id", "ids").mapInArrow(run, "doc_id long, text string")
