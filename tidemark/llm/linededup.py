"""Line dedup: sharded cuckoo filters backed by an exact reference-count table.

The table holds, for every line key, in how many documents it occurs. A shard's cuckoo filter
holds the keys at or over the threshold. Inserting or deleting documents adds or subtracts their
counts; keys that cross the threshold enter or leave their filter, so both are reversible.

While the filters together are within ``broadcast_bytes`` they are broadcast and documents are
cleaned in one pass without a shuffle: the keys of the table that hit a filter without being
common (its false positives) are known, and sent along as exceptions, so the answer is exact.
Beyond that size, lines travel to their shard's filter, and those that pass it are joined with the
common keys.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import SPACE, column, hidden, materialize, only, signed
from tidemark.llm.cuckoo import CuckooFilter

KEYS_PER_SHARD = 200_000
SALTS = 16


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()


def key_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _hi_lo(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def _unsigned(s: pd.Series) -> np.ndarray:
    return s.to_numpy(dtype=np.int64).view(np.uint64)


def line_counts(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(hi, lo, docs): how many rows of docs hold each line key of min_chars or more."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found: Counter = Counter()
            for text in column(batch, "text"):
                keys = {line_key(x) for x in (text or b"").split(b"\n")}
                found.update(k for k in keys if k and len(k.decode()) >= min_chars)
            hi, lo = _hi_lo([key_hash(k) for k in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(hi)), pa.array(signed(lo)), pa.array(list(found.values()), pa.int64())],
                ["hi", "lo", "docs"],
            )

    each = only(docs, "text").mapInArrow(run, "hi long, lo long, docs long")
    return each.groupBy("hi", "lo").agg(F.sum("docs").alias("docs"))


@dataclass
class LineIndex:
    """counts(hi, lo, docs) and filters(shard, bits); build(), insert() and delete() give new ones."""

    counts: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int = 10
    min_chars: int = 1

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> LineIndex:
        counts = materialize(line_counts(docs, min_chars), "line-counts")
        return cls._of(counts, min_docs, min_chars)

    @classmethod
    def _of(cls, counts: DataFrame, min_docs: int, min_chars: int) -> LineIndex:
        common = counts.where(F.col("docs") >= min_docs)
        shards = max(8, -(-common.count() // KEYS_PER_SHARD))

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            made = CuckooFilter.build(_unsigned(pdf["hi"]), _unsigned(pdf["lo"]))
            return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "bits": [made.dumps()]})

        filters = common.select("hi", "lo", _shard(shards)).groupBy("shard").applyInPandas(build, "shard int, bits binary")
        return cls(counts, materialize(filters, "line-filters"), shards, min_docs, min_chars)

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._changed(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        """Take out documents that were inserted before, unchanged."""
        return self._changed(docs, -1)

    def _changed(self, docs: DataFrame, sign: int) -> LineIndex:
        old = self.counts.select("hi", "lo", "docs", F.col("docs").alias("was"))
        new = line_counts(docs, self.min_chars).select("hi", "lo", (sign * F.col("docs")).alias("docs"), F.lit(0).cast("long").alias("was"))
        both = materialize(old.union(new).groupBy("hi", "lo").agg(F.sum("docs").alias("docs"), F.sum("was").alias("was")), "line-counts")
        counts = both.where("docs > 0").select("hi", "lo", "docs")
        hot, was = F.col("docs") >= self.min_docs, F.col("was") >= self.min_docs
        if counts.where(hot).count() > 2 * KEYS_PER_SHARD * self.shards:
            return self._of(counts, self.min_docs, self.min_chars)
        keys = both.where(hot | was).select("hi", "lo", hot.alias("hot"), was.alias("was"), _shard(self.shards))

        def update(old: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
            if not len(keys):
                return old
            hi, lo = _unsigned(keys["hi"]), _unsigned(keys["lo"])
            is_hot, was_hot = keys["hot"].to_numpy(bool), keys["was"].to_numpy(bool)
            held = CuckooFilter.loads(old["bits"].iloc[0]) if len(old) else None
            if held is not None:
                gone, come = was_hot & ~is_hot, is_hot & ~was_hot
                held.delete(hi[gone], lo[gone])
                if not held.insert(hi[come], lo[come]):
                    held = None
            if held is None:
                held = CuckooFilter.build(hi[is_hot], lo[is_hot])
            return pd.DataFrame({"shard": [int(keys["shard"].iloc[0])], "bits": [held.dumps()]})

        filters = self.filters.groupBy("shard").cogroup(keys.groupBy("shard")).applyInPandas(update, "shard int, bits binary")
        return LineIndex(counts, materialize(filters, "line-filters"), self.shards, self.min_docs, self.min_chars)

    def clean(self, docs: DataFrame, broadcast_bytes: int = 64 << 20) -> DataFrame:
        """docs with common lines taken out of text, plus n_lines and n_dropped.

        A null or empty text is one empty line, which stays; its cleaned text is ''. Other columns
        pass through, except own ones named n_lines or n_dropped, which are replaced. The counts
        must cover docs; rows repeat as they do in docs.
        """
        docs = docs.drop("n_lines", "n_dropped")
        size = self.filters.agg(F.sum(F.length("bits"))).first()[0] or 0
        if size <= broadcast_bytes:
            sc = docs.sparkSession.sparkContext
            held = {r["shard"]: bytes(r["bits"]) for r in self.filters.collect()}
            probe = _probe(sc.broadcast(held), self.shards)
            wrong = self.counts.where(F.col("docs") < self.min_docs).select("hi", "lo").mapInPandas(
                lambda it: (p[probe(_unsigned(p["hi"]), _unsigned(p["lo"]))] for p in it), "hi long, lo long"
            )
            most = broadcast_bytes // 64
            wrong = [(r[0], r[1]) for r in wrong.limit(most + 1).collect()]
            if len(wrong) <= most:
                return _clean_with(docs, sc.broadcast(held), self.shards, sc.broadcast(frozenset(wrong)), self.min_chars)
        return self._clean_by_join(docs)

    def _clean_by_join(self, docs: DataFrame) -> DataFrame:
        given = docs.columns
        docs = hidden(docs, "text")
        names = docs.columns
        docs = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "docs")
        least = self.min_chars

        def lines(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                row, pos, digests = [], [], []
                for r, text in zip(column(batch, "__row"), column(batch, "text"), strict=True):
                    for n, key in enumerate(map(line_key, (text or b"").split(b"\n"))):
                        if key and len(key.decode()) >= least:
                            row.append(r)
                            pos.append(n)
                            digests.append(key_hash(key))
                hi, lo = _hi_lo(digests)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row, pa.int64()), pa.array(pos, pa.int32()), pa.array(signed(hi)), pa.array(signed(lo))],
                    ["row", "pos", "hi", "lo"],
                )

        each = docs.select("__row", "text").mapInArrow(lines, "row long, pos int, hi long, lo long")
        each = each.select(_shard(self.shards), F.pmod("row", F.lit(SALTS)).cast("int").alias("salt"), F.lit(None).cast("binary").alias("bits"), "*")
        salts = F.explode(F.array(*(F.lit(i) for i in range(SALTS)))).alias("salt")
        nothing = (F.lit(None).cast(t).alias(c) for c, t in (("row", "long"), ("pos", "int"), ("hi", "long"), ("lo", "long")))
        held = self.filters.select("shard", salts, "bits", *nothing)
        dealt = held.union(each).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("bits").isNull())
        hits = dealt.mapInArrow(_screen, "row long, pos int, salt int, hi long, lo long")
        common = self.counts.where(F.col("docs") >= self.min_docs).select("hi", "lo", salts)
        gone = hits.join(common, ["hi", "lo", "salt"]).groupBy("row").agg(F.collect_list("pos").alias("gone")).toDF("__of", "__gone")
        both = docs.join(gone, F.col("__row") == F.col("__of"), "left").select(*(F.col(f"`{c}`") for c in names), "__gone")
        at_text = names.index("text")
        schema = T.StructType([*both.schema.fields[:-1], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

        def drop(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                kept, n, m = [], [], []
                for text, places in zip(column(batch, "text"), batch.column(len(names)).to_pylist(), strict=True):
                    own, dropped = (text or b"").split(b"\n"), set(places or ())
                    kept.append(b"\n".join(x for i, x in enumerate(own) if i not in dropped))
                    n.append(len(own))
                    m.append(len(dropped))
                columns = batch.columns[:-1]
                columns[at_text] = pa.array(kept, pa.binary()).cast(columns[at_text].type)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(m, pa.int64())], schema.names)

        return both.mapInArrow(drop, schema).toDF(*given, "n_lines", "n_dropped")


def _screen(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body over lines by shard and salt, the shard's filter first: the lines that pass it."""
    held, where = None, None
    for batch in rows:
        shard, salt = (batch.column(i).to_numpy() for i in range(2))
        cut = np.flatnonzero((np.diff(shard) != 0) | (np.diff(salt) != 0)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(shard)], strict=True):
            if a == b:
                continue
            if (shard[a], salt[a]) != where:
                held, where = None, (shard[a], salt[a])
            if (bits := batch.column(2)[a].as_py()) is not None:
                held, a = CuckooFilter.loads(bits), a + 1
            if held is None or a == b:
                continue
            part = batch.slice(a, b - a)
            hi, lo = (part.column(i).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for i in (5, 6))
            found = part.filter(pa.array(held.contains(hi, lo)))
            yield pa.RecordBatch.from_arrays([found.column(i) for i in (3, 4, 1, 5, 6)], ["row", "pos", "salt", "hi", "lo"])


def _shard(shards: int):
    return F.pmod("lo", F.lit(shards).cast("long")).cast("int").alias("shard")


def _probe(held, shards: int):
    """(hi, lo) -> which keys are in their shard's filter; held is a broadcast of the filters."""
    opened: dict[int, CuckooFilter] = {}

    def probe(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        if not opened:
            opened.update((k, CuckooFilter.loads(v)) for k, v in held.value.items())
        shard = np.mod(lo.view(np.int64), shards)
        out = np.zeros(len(hi), dtype=bool)
        for k in np.unique(shard):
            if k in opened:
                at = np.flatnonzero(shard == k)
                out[at] = opened[k].contains(hi[at], lo[at])
        return out

    return probe


def _clean_with(docs: DataFrame, held, shards: int, wrong, min_chars: int) -> DataFrame:
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    at_text = docs.columns.index("text")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = _probe(held, shards)
        for batch in rows:
            texts = [(t or b"").split(b"\n") for t in column(batch, "text")]
            keys = [line_key(x) for lines in texts for x in lines]
            hi, lo = _hi_lo([key_hash(k) for k in keys])
            hit = probe(hi, lo)
            at = -1
            kept, dropped = [], []
            hits = hit.tolist()
            for lines in texts:
                stay, n = [], 0
                for line in lines:
                    at += 1
                    if hits[at] and len(keys[at].decode()) >= max(1, min_chars) and (int(hi[at].view(np.int64)), int(lo[at].view(np.int64))) not in wrong.value:
                        n += 1
                    else:
                        stay.append(line)
                kept.append(b"\n".join(stay))
                dropped.append(n)
            columns = batch.columns
            columns[at_text] = pa.array(kept, pa.binary()).cast(columns[at_text].type)
            columns += [pa.array([len(x) for x in texts], pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.mapInArrow(run, schema)


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """docs without lines whose key is in min_docs or more of its rows; see LineIndex.clean."""
    return LineIndex.build(docs, min_docs, min_chars).clean(docs)
