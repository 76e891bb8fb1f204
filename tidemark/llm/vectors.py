"""Embedding near-duplicates through an inverted multi-index.

A vector is scaled to length 1 and cut in halves, each with a codebook of its own; the product of
the codebooks is a grid of cells. In each half a vector has a squared distance to every centroid's
region: that to the plane between it and the vector's own centroid. From a vector, the
multi-sequence order visits cells by the sum over both halves. How far to go is calibrated: on the
fitting sample and on neighbours made at the threshold, the radius is the distance within which
the target share of pairs has one vector visiting the other's cell. The grid grows with the table,
so that the share of it that a vector visits falls. Vectors travel to the occupied cells they visit
and are verified there in double precision. Linked pairs are never emitted: a cell gives each
vector its number of links and one edge to its group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, only
from tidemark.llm.components import connected

SAMPLE = 8_192
#: Most centroids a half, and vectors in a cell that is not cut in parts, or one in CUTS if that is more.
CELLS, BLOCK, CUTS = 2_048, 512, 200_000


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = _distances(x, centers).argmin(axis=1)
        n = np.bincount(near, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
    return centers


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances (rows, centers)."""
    d = (x * x).sum(axis=1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(axis=1)[None, :]
    return np.maximum(d, 0)


class MultiIndex:
    """Two codebooks and the search radius; which cells are occupied, and in how many parts the
    large ones are cut."""

    def __init__(self, sample: np.ndarray, cells: int, threshold: float, recall: float, seed: int = 1):
        rng = np.random.default_rng(seed)
        x = _unit(sample)
        self.half = x.shape[1] // 2 or 1
        self.books = [_kmeans(h, cells, rng) for h in self.halves(x)]
        self.apart = [2 * np.sqrt(_distances(b, b)) for b in self.books]
        self.radius = self._calibrate(x, threshold, recall, rng)
        self.occupied = np.ones(len(self.books[0]) * len(self.books[1]), dtype=bool)
        self.parts: dict[int, int] = {}

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.half], x[:, self.half :] if x.shape[1] > 1 else np.zeros((len(x), 1))

    def places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each vector's own cell, and per half its squared distance to every centroid's region."""
        cell, out = 0, []
        n = np.arange(len(x))
        for h, book, apart in zip(self.halves(x), self.books, self.apart, strict=True):
            d = _distances(h, book)
            own = d.argmin(axis=1)
            gap = apart[own]
            plane = np.divide(d - d[n, own][:, None], gap, out=np.zeros_like(d), where=gap > 1e-12)
            out.append(np.square(np.maximum(plane, 0)))
            cell = cell * len(book) + own
        return cell, *out

    def _reach(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For pairs (x, y): the nearer of x to y's cell and y to x's cell."""
        n, k = np.arange(len(x)), len(self.books[1])
        (cx, ax, bx), (cy, ay, by) = self.places(x), self.places(y)
        return np.minimum(ax[n, cy // k] + bx[n, cy % k], ay[n, cx // k] + by[n, cx % k])

    def _calibrate(self, x: np.ndarray, threshold: float, recall: float, rng: np.random.Generator) -> float:
        reach = [0.0]
        pairs = []
        for at in range(0, len(x), 1024):
            i, j = np.nonzero(x[at : at + 1024] @ x.T >= threshold)
            i = i + at
            keep = i < j
            i, j = i[keep], j[keep]
            if len(i) > 2_000:
                pick = rng.choice(len(i), 2_000, replace=False)
                i, j = i[pick], j[pick]
            pairs.append((i, j))
        i, j = (np.concatenate(p) for p in zip(*pairs, strict=True))
        noise = rng.standard_normal(x.shape)
        noise -= (noise * x).sum(axis=1, keepdims=True) * x
        edge = threshold * x + np.sqrt(1 - threshold**2) * _unit(noise) if x.shape[1] > 1 else x
        for one, two in ((x[i], x[j]), (x, edge)):
            found = [self._reach(one[k : k + 1024], two[k : k + 1024]) for k in range(0, len(one), 1024)]
            if found:
                reach.append(float(np.quantile(np.concatenate(found), recall)))
        return max(reach) + 1e-12

    def visits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Multi-sequence traversal: the occupied cells by growing a[i] + b[j] up to the radius. Along
        growing a, each row takes a shorter stretch of growing b."""
        i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        i, j = i[: np.searchsorted(a[i], self.radius, side="right")], j[: np.searchsorted(b[j], self.radius, side="right")]
        ends = np.searchsorted(b[j], self.radius - a[i], side="right")
        cells = np.concatenate([i[r] * len(self.books[1]) + j[:end] for r, end in enumerate(ends.tolist())])
        cells = cells[self.occupied[cells]]
        return cells[np.argsort(a[cells // len(self.books[1])] + b[cells % len(self.books[1])], kind="stable")]

    def route(self, x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, list, list, list]:
        """Each vector's cell, the cells it visits, and the blocks that it is a member of and that it
        visits. A block is cell << 40 | part << 20 | salt; a cell cut in parts has as many salts,
        by which its visitors are dealt out."""
        home, members, visits, blocks = [], [], [], []
        for at in range(0, len(x), 512):
            cell, a, b = self.places(x[at : at + 512])
            home.append(cell)
            for n, own in enumerate(cell.tolist()):
                seen = self.visits(a[n], b[n])
                visits.append(seen)
                draw = xxhash.xxh64_intdigest(int(ids[at + n]).to_bytes(8, "little", signed=True))
                parts = self.parts.get(own, 1)
                members.append([own << 40 | draw % parts << 20 | salt for salt in range(parts)])
                to = seen.astype(np.int64) << 40
                cut = [c for c in seen.tolist() if c in self.parts] if self.parts else ()
                if cut:
                    to = [c << 40 for c in seen.tolist() if c not in self.parts]
                    to += [c << 40 | part << 20 | (draw >> 32) % self.parts[c] for c in cut for part in range(self.parts[c])]
                blocks.append(to)
        return np.concatenate(home), visits, members, blocks


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows of doubles, scaled to length 1."""
    return _unit(column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1))


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, k1, k2) per row and (rep, n, embedding) per distinct usable vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, ok = [], [], []
            for v in batch.column(1).to_pylist():
                x = np.array([np.nan if c is None else c for c in v or []], dtype=np.float64) + 0.0
                good = len(x) > 0 and np.isfinite(x).all() and bool(np.any(x))
                h = np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), dtype="<i8")
                k1.append(int(h[0]))
                k2.append(int(h[1]))
                ok.append(bool(good))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(ok)],
                ["vec_id", "embedding", "k1", "k2", "ok"],
            )

    rows = only(vectors, "vec_id", "embedding")
    kind = rows.schema["embedding"].dataType.simpleString()
    each = materialize(rows.mapInArrow(run, f"vec_id long, embedding {kind}, k1 long, k2 long, ok boolean"), "vectors")
    classes = each.where("ok").groupBy("k1", "k2").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    return each.select("vec_id", "k1", "k2", "ok"), materialize(classes, "vector-classes")


ROUTED = "rep long, n long, home int, visits array<int>, members array<long>, blocks array<long>"
FOUND = "rep long, links long, root long"


def _links(members: list[tuple], query: tuple, threshold: float) -> list[np.ndarray] | None:
    """(rep, links, root) of those linked among a block's members and some of its visitors, each
    given as (vectors, rep, n, home, visits)."""
    y, y_rep, y_n, y_visits = members
    x, x_rep, x_n, x_home = query
    i, j = np.nonzero(x @ y.T >= threshold)
    other = x_rep[i] != y_rep[j]
    i, j = i[other], j[other]
    if not len(i):
        return None
    # a visitor counts its links here; a member counts those whose home it doesn't visit itself
    want = (j.astype(np.int64) << 32) | x_home[i]
    at = np.minimum(np.searchsorted(y_visits, want), len(y_visits) - 1)
    lone = y_visits[at] != want
    reps, inverse = np.unique(np.concatenate([x_rep, y_rep]), return_inverse=True)
    a, b = inverse[i], inverse[len(x_rep) + j]
    links = np.bincount(a, weights=y_n[j], minlength=len(reps)) + np.bincount(b[lone], weights=x_n[i[lone]], minlength=len(reps))
    root = np.arange(len(reps))
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            break
        root = new
    own = np.flatnonzero((links > 0) | (root != np.arange(len(reps))))
    return [reps[own], links[own].astype(np.int64), reps[root[own]]]


def _verify(threshold: float):
    """mapInArrow body over rows (block, member, rep, n, home, visits, embedding), a block's members first."""

    def opened(held: list[tuple]) -> tuple:
        vectors, reps, n, _, visits = zip(*held, strict=True)
        visits = [v for part in visits for v in part.to_pylist()]
        keys = np.concatenate([np.full(len(v), k, dtype=np.int64) << 32 | np.asarray(v, dtype=np.int64) for k, v in enumerate(visits)])
        return np.concatenate(vectors), np.concatenate(reps), np.concatenate(n), np.sort(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, members = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            block, member, rep, n, home = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            vectors = matrix(batch.column(6))
            cut = np.flatnonzero((np.diff(block) != 0) | (np.diff(member.astype(np.int8)) != 0)) + 1
            out = []
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(block)], strict=True):
                if block[a] != key:
                    key, held, members = block[a], [], None
                if member[a]:
                    held.append((vectors[a:b], rep[a:b], n[a:b], home[a:b], batch.column(5).slice(a, b - a)))
                    continue
                members = members or opened(held)
                for at in range(a, b, 2048):
                    end = min(b, at + 2048)
                    found = _links(members, (vectors[at:end], rep[at:end], n[at:end], home[at:end]), threshold)
                    if found:
                        out.append(found)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["rep", "links", "root"])

    return run


def _sample(classes: DataFrame, n: int, size: int) -> list[list[float]]:
    """About ``size`` of the n embeddings, all if there are no more, in the order of a hash of rep. They
    are picked by the hash before they reach the driver: a top-k would send as many rows of each partition."""
    picked = classes.select(F.xxhash64("rep").alias("h"), "rep", "embedding")
    if n > size:
        picked = picked.where(F.pmod("h", F.lit(1 << 40)) < (size << 40) // n)
    return [r["embedding"] for r in sorted(picked.collect(), key=lambda r: (r["h"], r["rep"]))]


def _occupied(rows: list, cells: int) -> np.ndarray:
    """Which cells have a bit, cell 0 the first, in Spark's bitmaps of 32,768 bits, numbered from 1."""
    out = np.zeros(cells, dtype=bool)
    for k, bits in rows:
        at = (k - 1) * 32_768 + np.flatnonzero(np.unpackbits(np.frombuffer(bits, dtype=np.uint8), bitorder="little"))
        out[at] = True
    return out


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.995, cells: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding).

    Equal vectors are one class and are linked by count, never in pairs. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing. Usable vectors of
    different lengths are refused. Rows without a vec_id count as links of others and get
    their class's component. An empty table gives an empty result.
    """
    each, classes = _classes(vectors)
    classes = classes.where("rep is not null")
    n, shortest, longest = classes.agg(F.count("*"), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if n and shortest != longest:
        raise ValueError(f"vectors have {shortest} to {longest} components; all must have as many")
    if not n:
        return each.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if cells is None:
        cells = int(min(CELLS, max(4, 2 ** round(np.log2(np.sqrt(n / 16) + 1)))))
    sample = _sample(classes, n, max(SAMPLE, 8 * cells))
    index = MultiIndex(np.array(sample, dtype=float), cells, threshold, recall)
    spark = vectors.sparkSession
    fitted = spark.sparkContext.broadcast(index)  # two codebooks of at most CELLS rows

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(0)) if batch.num_rows else np.empty((0, 1))
            found = [fitted.value.places(x[at : at + 512])[0] for at in range(0, len(x), 512)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else [], pa.int64())], ["cell"])

    counts = materialize(classes.select("embedding").mapInArrow(cell, "cell long").groupBy("cell").count(), "cells")
    most = max(BLOCK, n // CUTS)
    index.parts = {r[0]: -(-r[1] // most) for r in counts.where(F.col("count") > most).collect()}  # at most CUTS
    bit = F.col("cell") + 1
    bits = counts.groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    index.occupied = _occupied(bits.collect(), len(index.occupied))  # a bit per cell
    placed = spark.sparkContext.broadcast(index)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            home, visits, members, blocks = placed.value.route(matrix(batch.column(2)), batch.column(0).to_numpy())
            lists = [pa.array(visits, pa.list_(pa.int32())), pa.array(members, pa.list_(pa.int64())), pa.array(blocks, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(home, pa.int32()), *lists, batch.column(2)], [x.split()[0] for x in shape.split(", ")])

    shape = f"{ROUTED}, embedding {classes.schema['embedding'].dataType.simpleString()}"
    routed = materialize(classes.select("rep", "n", "embedding").mapInArrow(route, shape), "routed")
    member = routed.select(F.explode("members").alias("block"), F.lit(True).alias("member"), "rep", "n", "home", "visits", "embedding")
    query = routed.select(F.explode("blocks").alias("block"), F.lit(False).alias("member"), "rep", "n", "home", F.array().cast("array<int>").alias("visits"), "embedding")
    dealt = member.union(query).repartition("block").sortWithinPartitions("block", F.desc("member"))
    found = materialize(dealt.mapInArrow(_verify(threshold), FOUND), "vector-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    whole = classes.select("rep", "n", "k1", "k2").join(links, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left")
    whole = materialize(whole.select(
        "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "vector-parts")
    both = each.join(whole, ["k1", "k2"], "left")
    lone = ~F.col("ok") | F.col("component_id").isNull()
    component = F.when(lone, F.col("vec_id")).otherwise(F.col("component_id"))
    return both.select(
        "vec_id", F.when(lone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
