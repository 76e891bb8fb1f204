"""SimHash near-duplicates with pigeonring filtering.

The 64 bits of a fingerprint lie on a ring of eight segments of eight bits. If two fingerprints
differ in at most 4 bits, some chain of consecutive segments keeps every prefix of l segments
within floor(4 l / 8) differing bits (the pigeonring principle). For chains of five that leaves
the first segment equal and at most two of the other four touched, in five possible ways, each
of which leaves three segments equal. Those 8 x 5 triples are the join keys: no pair is lost.
Pairs that meet under a key must pass the whole chain test before the full Hamming check; where
more than SMALL meet, the whole ring is tested at once, which is the Hamming check itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import column, hidden, materialize, only, signed
from tidemark.llm.components import connected

SEGMENTS, WIDTH, CHAIN = 8, 8, 5
SEED = 42
#: Above this many fingerprints, a key's bucket is dealt out in pairs of chunks.
BUCKET = 4096
SMALL = 64


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """The hashes of a text's shingles in order, repeats included; none without words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    k = min(shingle, len(words))
    hash_of = xxhash.xxh64_intdigest
    return np.array([hash_of(joined[a:b], SEED) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist())], dtype=np.uint64)


def fingerprint(text: bytes, shingle: int) -> int:
    return fingerprint_of(shingle_hashes(text, shingle))


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bit b is set if it is set in over half of the shingles' hashes; 0 if there are none."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, tagged: bool = False) -> DataFrame:
    """(doc_id, fp) for each row of docs, and its h if tagged; fp is the fingerprint as a signed long.

    Null and wordless texts have fingerprint 0; fewer words than a shingle give one shingle.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            fps = [fingerprint(t or b"", shingle) for t in column(batch, "text")]
            found = [batch.column(0), pa.array(signed(np.array(fps, dtype=np.uint64))), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(found, ["doc_id", "fp", *more])

    more = ["h"] * tagged
    return only(docs, "doc_id", "text", *more).mapInArrow(run, "doc_id long, fp long" + ", h long" * len(more))


def _budget(length: int, tau: int) -> int:
    return length * tau // SEGMENTS


def chain_keys(tau: int) -> list[tuple[int, ...]]:
    """For each start on the ring, the sets of segments that a viable chain may leave equal. From
    as many bits as segments on, a chain may have none, and keys would lose pairs."""
    if not 0 <= tau < SEGMENTS:
        raise ValueError(f"tau is {tau}; keys hold for 0 to {SEGMENTS - 1} bits")
    left: set[frozenset[int]] = set()
    for size in range(CHAIN):
        for wild in combinations(range(CHAIN), size):
            if all(sum(w < n for w in wild) <= _budget(n, tau) for n in range(1, CHAIN + 1)):
                left.add(frozenset(range(CHAIN)) - set(wild))
    least = [s for s in left if not any(o < s for o in left)]
    return [tuple(sorted((start + i) % SEGMENTS for i in s)) for start in range(SEGMENTS) for s in sorted(least, key=sorted)]


def close(a: np.ndarray, b: np.ndarray, tau: int) -> np.ndarray:
    """Which pairs of fingerprints differ in at most tau bits: chain test, then Hamming check."""
    x = a ^ b
    per = np.bitwise_count(np.ascontiguousarray(x).view(np.uint8).reshape(-1, SEGMENTS)).astype(np.int64)
    ring = np.concatenate([per, per], axis=1).cumsum(axis=1)
    ring = np.concatenate([np.zeros((len(per), 1), dtype=np.int64), ring], axis=1)
    viable = np.zeros(len(x), dtype=bool)
    for start in range(SEGMENTS):
        ok = np.ones(len(x), dtype=bool)
        for n in range(1, SEGMENTS + 1):
            ok &= ring[:, start + n] - ring[:, start] <= _budget(n, tau)
        viable |= ok
    out = np.zeros(len(x), dtype=bool)
    at = np.flatnonzero(viable)
    out[at] = np.bitwise_count(x[at]) <= tau
    return out


def forest(fps: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected within fps, one less than each group's size."""
    rest = np.arange(len(fps))
    a, b = [], []
    queue: list[int] = []
    while len(rest):
        if not queue:
            queue, rest = [int(rest[0])], rest[1:]
        here = queue.pop()
        hit = np.bitwise_count(fps[rest] ^ fps[here]) <= tau
        if hit.any():
            found = rest[hit]
            a.append(np.full(len(found), here))
            b.append(found)
            queue += found.tolist()
            rest = rest[~hit]
    if not a:
        return fps[:0], fps[:0]
    return fps[np.concatenate(a)], fps[np.concatenate(b)]


def _bucket_links(keys: np.ndarray, fps: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within buckets; keys are sorted and every bucket is whole."""
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    sizes = np.diff(edge)
    out_a, out_b = [], []
    small = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
    k, f = keys[small], fps[small]
    for step in range(1, SMALL):
        same = np.flatnonzero(k[step:] == k[:-step]) if len(k) > step else np.empty(0, dtype=int)
        if not len(same):
            break
        ok = close(f[same], f[same + step], tau)
        out_a.append(f[same[ok]])
        out_b.append(f[same[ok] + step])
    for g in np.flatnonzero(sizes > SMALL):
        a, b = forest(fps[edge[g] : edge[g + 1]], tau)
        out_a.append(a)
        out_b.append(b)
    if not out_a:
        return fps[:0], fps[:0]
    pairs = np.unique(np.stack([np.concatenate(out_a), np.concatenate(out_b)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _links_of_partition(tau: int):
    """mapInArrow body over rows sorted by key. Buckets over BUCKET pass through as 'hot' rows."""

    def emit(a, b, hot):
        n = len(a)
        return pa.RecordBatch.from_arrays(
            [pa.array(signed(a) if not hot else a), pa.array(signed(b)), pa.array(np.full(n, hot))], ["a", "b", "hot"]
        )

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        hot_key = None
        for batch in rows:
            k = batch.column(0).to_numpy(zero_copy_only=False)
            f = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            keys, fps = np.concatenate([keys, k]), np.concatenate([fps, f])
            if hot_key is not None:
                n = np.searchsorted(keys, hot_key, side="right")
                yield emit(keys[:n], fps[:n], True)
                keys, fps = keys[n:], fps[n:]
                if len(keys):
                    hot_key = None
            if len(keys) < 1 << 17:
                continue
            last = np.searchsorted(keys, keys[-1], side="left")
            if last:
                yield emit(*_bucket_links(keys[:last], fps[:last], tau), False)
                keys, fps = keys[last:], fps[last:]
            if len(keys) > BUCKET:
                hot_key = keys[0]
                yield emit(keys, fps, True)
                keys, fps = keys[:0], fps[:0]
        if len(keys):
            yield emit(*_bucket_links(keys, fps, tau), False)

    return run


def links(fps: DataFrame, tau: int = 4) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all pairs within tau bits."""
    codes = []
    for n, segs in enumerate(chain_keys(tau)):
        code = F.lit(n).cast("long")
        for s in segs:
            code = code * 256 + F.shiftrightunsigned("fp", WIDTH * s).bitwiseAND(F.lit(255))
        codes.append(code)
    keyed = fps.select(F.explode(F.array(*codes)).alias("key"), "fp")
    dealt = keyed.repartition("key").sortWithinPartitions("key")
    found = materialize(dealt.mapInArrow(_links_of_partition(tau), "a long, b long, hot boolean"), "links")
    hot = found.where("hot").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    chunks = hot.groupBy("key").agg(F.ceil(F.count("*") / BUCKET).cast("int").alias("n"))
    mine = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    dealt = (
        hot.join(chunks, "key")
        .select("key", "fp", "n", mine.alias("c"))
        .select("key", "fp", "c", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("o"))
        .select("key", "fp", F.least("c", "o").alias("lo"), F.greatest("c", "o").alias("hi"))
    )

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = forest(pdf["fp"].to_numpy().view(np.uint64), tau)
        return pd.DataFrame({"a": signed(a), "b": signed(b)})

    rest = dealt.groupBy("key", "lo", "hi").applyInPandas(pair, "a long, b long")
    return found.where("not hot").select("a", "b").union(rest).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, tau: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links, itself included.

    Equal fingerprints form one class, so copies are never paired. Rows whose doc_id is null get
    their component's id (null if no row of it has one). Repeated rows repeat in the result;
    an empty table gives an empty result.
    """
    return _components(docs, shingle, tau).select("doc_id", "fp", "component_id")


def _components(docs: DataFrame, shingle: int, tau: int, tagged: bool = False) -> DataFrame:
    """near_duplicates() and whole, the component's smallest fingerprint, which names it even if it
    has no id; if tagged, also docs' h."""
    each = materialize(fingerprints(docs, shingle, tagged), "fingerprints")
    classes = materialize(each.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    parts = connected(materialize(links(classes.select("fp"), tau), "pairs"))
    named = classes.join(parts, classes.fp == parts.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("whole"))
    named = materialize(named, "classes")
    least = named.groupBy("whole").agg(F.min("rep").alias("component_id"))
    return each.join(named.select("fp", "whole").join(least, "whole"), "fp")


def row_hash(docs: DataFrame) -> Column:
    """A hash of a row's columns, maps aside."""
    return F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()))


def first_rows(docs: DataFrame, each: DataFrame) -> DataFrame:
    """The rows of docs that come first in their component, by doc_id, nulls last, then by hash;
    each (doc_id, h, component) has a row for each of docs, h its row_hash()."""
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "h")
    keep = each.groupBy("component", "doc_id", "h").agg(F.count("*").alias("n")).groupBy("component").agg(F.min_by(F.struct("doc_id", "h", "n"), order).alias("first"))
    keep = materialize(keep.select("first.*"), "keep").toDF("__d", "__h", "n_same")
    own = hidden(docs, "doc_id")
    tagged = own.withColumn("__row", row_hash(own))
    # as many rows as groups: never broadcast
    kept = tagged.join(keep.hint("merge"), (F.col("__row") == F.col("__h")) & tagged["doc_id"].eqNullSafe(keep["__d"]), "left_semi")
    if not keep.where("n_same > 1").isEmpty():  # the same row again
        kept = kept.dropDuplicates(["doc_id", "__row"])
    return kept.select(*own.columns).toDF(*docs.columns)


def keep_first(docs: DataFrame, shingle: int = 5, tau: int = 4) -> DataFrame:
    """docs without near-duplicates: of each group of linked fingerprints one row stays, that with
    the smallest doc_id, nulls last; of several such rows that with the smallest row_hash().

    So rows of one doc_id whose texts aren't near stay both. An empty table gives an empty result.
    """
    tagged = docs.select(F.col("doc_id"), F.col("text"), row_hash(docs).alias("h"))
    return first_rows(docs, _components(tagged, shingle, tau, tagged=True).select("doc_id", "h", F.col("whole").alias("component")))


#: Bands of minima and minima a band: at Jaccard 0.8 a pair shares no band with chance (1 - 0.8^5)^32, 3 in a million.
BANDS, ROWS = 32, 5
FACTORS = np.random.default_rng(SEED).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Documents and bytes of text of a candidate group that one task holds.
GROUP, GROUP_BYTES = 512, 16 << 20


def shingles(text: bytes, shingle: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; none without words."""
    return np.unique(shingle_hashes(text, shingle))


def class_of(found: np.ndarray) -> int:
    """Names a set of shingles, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).view(np.int64))


def bands(found: np.ndarray) -> np.ndarray:
    """A set's band keys; two sets agree on a band's minima with chance Jaccard^ROWS."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), 4096):
        np.minimum(least, (found[at : at + 4096, None] * FACTORS).min(axis=0), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = (key ^ row) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def similar_forest(sets: list[np.ndarray], keys: np.ndarray, fps: np.ndarray, tau: int, least: float) -> list[tuple[int, int]]:
    """Places of links that connect what pairs with fingerprints within tau bits or a band in common,
    of Jaccard least or more, connect."""
    sizes = np.array([len(s) for s in sets])
    rest = np.arange(len(sets))
    queue: list[int] = []
    out = []
    while len(rest):
        if not queue:
            queue, rest = [int(rest[0])], rest[1:]
        here = queue.pop()
        near = rest[(np.bitwise_count(fps[rest] ^ fps[here]) <= tau) | (keys[rest] == keys[here]).any(axis=1)]
        near = near[np.minimum(sizes[near], sizes[here]) >= least * np.maximum(sizes[near], sizes[here])]
        if not len(near):
            continue
        both = np.isin(np.concatenate([sets[i] for i in near]), sets[here])
        both = np.add.reduceat(both, np.cumsum(sizes[near]) - sizes[near], dtype=np.int64)
        hit = near[both >= least * (sizes[near] + sizes[here] - both)]
        out += [(here, int(i)) for i in hit]
        queue += hit.tolist()
        rest = np.setdiff1d(rest, hit, assume_unique=True)
    return out


def near_prints(classes: DataFrame, tau: int) -> DataFrame:
    """Links (a, b) that connect the classes (class, fp) whose fingerprints differ in at most tau bits:
    those of one fingerprint to its smallest class, and these by links()."""
    prints = materialize(classes.groupBy("fp").agg(F.min("class").alias("a"), F.count("*").alias("n")), "prints")
    same = classes.join(prints.where("n > 1"), "fp").where("a <> class").select("a", F.col("class").alias("b"))
    one, other = prints.select(F.col("fp").alias("p"), "a"), prints.select(F.col("fp").alias("q"), F.col("a").alias("b"))
    return same.union(links(prints.select("fp"), tau).toDF("p", "q").join(one, "p").join(other, "q").select("a", "b"))


def similar_classes(docs: DataFrame, shingle: int = 5, tau: int = 4, least: float = 0.8) -> DataFrame:
    """(doc_id, h, component) per row of docs (doc_id, text, h): linked rows have one component.

    Rows with equal sets of shingles form a class; texts without words are one. Classes are linked
    if the Jaccard similarity of their sets is least or more, by the sets themselves. Candidates are
    classes whose fingerprints pigeonring chains find within tau bits and, beyond that radius, those
    that share a band with another, by links to each band's smallest class. They form groups; each
    group's texts, one of each class, come together once and are compared within. A group over
    GROUP documents or GROUP_BYTES is dealt out in pairs of chunks.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            named, fps, keys = [], [], []
            for text in column(batch, "text"):
                hashes = shingle_hashes(text or b"", shingle)
                found = np.unique(hashes)
                named.append(class_of(found))
                fps.append(fingerprint_of(hashes))
                keys.append(bands(found) if len(found) else None)
            told = [pa.array(named, pa.int64()), pa.array(signed(np.array(fps, dtype=np.uint64))), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *told], ["doc_id", "h", "class", "fp", "keys"])

    texts = only(docs, "doc_id", "text", "h")
    each = materialize(texts.mapInArrow(run, "doc_id long, h long, class long, fp long, keys array<long>"), "shingled")
    classes = each.groupBy("class").agg(F.min("h").alias("rep"), F.min_by("fp", "h").alias("fp"), F.first("keys").alias("keys"))
    classes = materialize(classes, "classes")
    keyed = classes.select(F.explode("keys").alias("key"), "class")
    pivots = keyed.groupBy("key").agg(F.min("class").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a")
    banded = keyed.join(pivots, "key").where("a <> class").select("a", F.col("class").alias("b"))
    printed = near_prints(classes.where("keys is not null").select("class", "fp"), tau)
    met = materialize(printed.union(banded).distinct(), "met")
    groups = materialize(connected(met).toDF("class", "group").join(classes, "class"), "groups")
    # rows of one h are the same row again, so any of them will do
    own = texts.join(groups.select(F.col("rep").alias("h")).hint("merge"), "h", "left_semi").groupBy("h").agg(F.first("text").alias("text"))
    members = materialize(groups.join(own, groups["rep"] == own["h"]).select("group", "class", "fp", "keys", "text"), "members")
    parts = members.groupBy("group").agg(
        F.ceil(F.greatest(F.count("*") / GROUP, F.sum(F.octet_length("text")) / GROUP_BYTES)).cast("int").alias("n")
    )
    mine = F.pmod(F.xxhash64("class"), F.col("n")).cast("int")
    dealt = (
        members.join(parts, "group")
        .withColumn("c", mine)
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select("group", F.least("c", "o").alias("lo"), F.greatest("c", "o").alias("hi"), "class", "fp", "keys", "text")
    )

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [shingles((text or "").encode(), shingle) for text in pdf["text"]]
        keys = np.array(pdf["keys"].tolist(), dtype=np.int64).reshape(-1, BANDS)
        names = pdf["class"].tolist()
        found = similar_forest(sets, keys, pdf["fp"].to_numpy().view(np.uint64), tau, least)
        return pd.DataFrame({"a": [names[i] for i, _ in found], "b": [names[i] for _, i in found]}, dtype="int64")

    linked = materialize(dealt.groupBy("group", "lo", "hi").applyInPandas(pair, "a long, b long").distinct(), "pairs")
    found = connected(linked).toDF("class", "found")
    return each.join(found, "class", "left").select("doc_id", "h", F.coalesce("found", "class").alias("component"))


def keep_first_similar(docs: DataFrame, shingle: int = 5, tau: int = 4, least: float = 0.8) -> DataFrame:
    """docs without near-duplicates by Jaccard similarity of shingles: of each group of linked texts
    one row stays, as in keep_first(). Null texts are texts without words."""
    tagged = docs.select(F.col("doc_id"), F.col("text"), row_hash(docs).alias("h"))
    return first_rows(docs, similar_classes(tagged, shingle, tau, least))
