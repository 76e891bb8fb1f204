"""Periodic runs of words by the runs theorem, and texts with their repetitions collapsed.

Every maximal repetition has a Lyndon root that is the longest Lyndon word at its start under an
order of the words or under its inverse. Those are next-smaller values of the inverse suffix array;
how far a root repeats is a longest common extension, a range minimum over the LCP array from a
sparse table. Documents stay whole in a task and share its arrays in batches: a suffix array over
(document, word) compares no two documents, so that a batch costs no more than its documents.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import doc_batches, only

#: Bytes of text that share arrays; a longer document is a batch of its own.
BATCH = 2 << 20
SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def suffix_ranks(first: np.ndarray, order: np.ndarray, end: np.ndarray, smallest: bool) -> list[np.ndarray]:
    """Ranks of all positions by their first 1, 2, 4, ... words, the last ones by whole suffixes.

    first are the ranks by one word, order the positions in their order, end each position's end of
    document. Equal ranks mean equal words, a rank is the number of positions before its group. A
    suffix that ends counts as smaller (or as larger) than one that goes on. Only groups that aren't
    single yet are sorted again.
    """
    n, order = len(first), order.copy()
    rank = np.append(first, -1).astype(np.int32)
    single = np.bincount(first, minlength=n) == 1 if n else np.zeros(0, dtype=bool)
    open_ = np.flatnonzero(~single[first[order]])
    ranks, step = [rank.copy()], 1
    beyond = -1 if smallest else n
    while len(open_):
        at = order[open_]
        after = at + step
        second = np.where(after < end[at], rank[np.minimum(after, n)], beyond).astype(np.int64)
        key = rank[at].astype(np.int64) * (n + 2) + second + 1
        by = np.argsort(key)
        key = key[by]
        order[open_] = at[by]
        new = np.append(True, key[1:] != key[:-1])
        head = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        rank[order[open_]] = open_[head]
        ranks.append(rank.copy())
        open_ = open_[~(new & np.append(new[1:], True))]
        step *= 2
    return ranks


def adjacent_lcp(ranks: list[np.ndarray]) -> np.ndarray:
    """lcp[r]: words that the suffixes of ranks r - 1 and r have in common."""
    last = ranks[-1][:-1]
    n = len(last)
    order = np.empty(n, dtype=np.int64)
    order[last] = np.arange(n)
    lcp = np.zeros(n, dtype=np.int32)
    pairs = np.flatnonzero(ranks[0][order[1:]] == ranks[0][order[:-1]]) + 1
    a, b = order[pairs - 1], order[pairs]
    got = np.zeros(len(pairs), dtype=np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        same = ranks[level][np.minimum(a + got, n)] == ranks[level][np.minimum(b + got, n)]
        got += same.astype(np.int64) << level
    lcp[pairs] = got
    return lcp


class Extensions:
    """Longest common extensions by a sparse table of range minima over the LCP array."""

    def __init__(self, ranks: list[np.ndarray]) -> None:
        self.rank = ranks[-1]
        self.tables = [adjacent_lcp(ranks)]
        width = 1
        while 2 * width < len(self.tables[0]):
            last = self.tables[-1]
            self.tables.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes at a and at b, all different, have in common."""
        x, y = self.rank[a], self.rank[b]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.zeros(len(low), dtype=np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.tables[k][low[at]], self.tables[k][high[at] - (1 << k)])
        return out


def next_smaller(values: np.ndarray) -> np.ndarray:
    """For each position the next one with a smaller value, or the number of values."""
    out = [len(values)] * len(values)
    stack: list[int] = []
    tops: list[int] = []
    for i, v in enumerate(values.tolist()):
        while tops and tops[-1] > v:
            tops.pop()
            out[stack.pop()] = i
        stack.append(i)
        tops.append(v)
    return np.array(out, dtype=np.int64)


def find_runs(words: np.ndarray, ends: np.ndarray, times: int = 4, least: int = 6) -> np.ndarray:
    """(start, length, period) of all runs of at least ``times`` periods and ``least`` words, in
    order; words are numbers in [0, number of words), ends the documents' ends."""
    n = len(words)
    if not n:
        return np.zeros((0, 3), dtype=np.int64)
    sizes = np.diff(ends, prepend=0)
    doc = np.repeat(np.arange(len(ends)), sizes)
    end = np.repeat(ends, sizes)
    key = doc * np.int64(n) + words
    order = np.argsort(key)
    new = np.append(True, np.diff(key[order]) != 0)
    first = np.empty(n, dtype=np.int64)
    first[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    up = suffix_ranks(first, order, end, smallest=True)
    roots = [np.minimum(next_smaller(up[-1][:-1]), end), next_smaller(-suffix_ranks(first, order, end, smallest=False)[-1][:-1])]
    start = np.concatenate([np.arange(n)] * 2)
    after = np.concatenate(roots)
    period = after - start
    # A root that starts in the first period of its run is followed by three periods less a word.
    near = np.flatnonzero((start + (times - 1) * period < np.concatenate([end, end])) & (words[start] == words[np.minimum(after, n - 1)]))
    start, after, period = start[near], after[near], period[near]
    if not len(near):
        return np.zeros((0, 3), dtype=np.int64)
    common = Extensions(up)
    right = common(start, after)
    near = np.flatnonzero(right >= (times - 2) * period)
    start, period, stop = start[near], period[near], after[near] + right[near]
    _, one = np.unique(np.stack([stop, period]), axis=1, return_index=True)  # roots of one run
    start, period, stop = start[one], period[one], stop[one]
    floor = np.repeat(ends - sizes, sizes)[start]
    left, step = np.zeros(len(start), dtype=np.int64), 1
    while (step <= start - floor).any():
        step *= 2
    while step:  # a run goes back to where its words still agree with those a period on
        back = start - left - step
        at = np.flatnonzero(back >= floor)
        fits = at[common(back[at], back[at] + period[at]) >= start[at] - back[at]]
        left[fits] += step
        step //= 2
    start, length = start - left, stop - start + left
    keep = length >= np.maximum(least, times * period)
    found = np.stack([start[keep], length[keep], period[keep]], axis=1)
    return np.unique(found, axis=0)


def damaged(doc_id, words: list[bytes]) -> list[bytes]:
    """One document in ten with a tail of repetitions, by its number; others, and those without a
    doc_id, as they are."""
    if doc_id is None or not words or zlib.crc32(str(doc_id).encode()) % 10:
        return words
    n, g = len(words), zlib.crc32(str(doc_id).encode()) // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * -(-(n - a) // len(unit)))[: n - a]


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def describe(ids: list, words: list[list[bytes]]) -> Iterator[tuple]:
    """A row of SCHEMA after the doc_id for each document's words."""
    number: dict[bytes, int] = {}
    coded = np.array([number.setdefault(w, len(number)) for doc in words for w in doc], dtype=np.int64)
    ends = np.cumsum([len(doc) for doc in words])
    runs = find_runs(coded, ends)
    cuts = np.searchsorted(runs[:, 0], ends)
    for i, doc in enumerate(words):
        mine = runs[cuts[i - 1] if i else 0 : cuts[i]]
        if not len(mine):
            yield ids[i], 0, None, None, None, None, _digest(b""), _digest(b" ".join(doc))
            continue
        mine = mine - [ends[i] - len(doc), 0, 0]
        start, length, period = min(mine.tolist(), key=lambda r: (-r[1], r[0], r[2]))
        gone = np.zeros(len(doc) + 1, dtype=np.int64)
        np.add.at(gone, mine[:, 0] + mine[:, 2], 1)
        np.add.at(gone, mine[:, 0] + mine[:, 1], -1)
        kept = [doc[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in mine[np.lexsort((mine[:, 2], mine[:, 0]))].tolist())
        yield ids[i], len(mine), start, length, period, 1000 * length // period, _digest(listed.encode()), _digest(b" ".join(kept))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per document: its number of runs, the longest one, and digests of all runs and of the
    text that is left when repetitions after a run's first period are dropped.

    A run is a stretch of words with smallest period q, at least 6 words and 4 periods long, that
    can't be extended. A null text has no words. Repeated rows and null doc_ids each give their row,
    an empty table gives none. A task holds a batch of documents or one longer one: about 4 * (levels
    of doubling + 40) bytes a word, that is 100 to 250.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCHEMA}"
    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], kind).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, texts in doc_batches(batches, BATCH):
            rows = describe(ids, [damaged(i, t.split()) for i, t in zip(ids, texts, strict=True)])
            arrays = [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return only(docs, "doc_id", "text").mapInArrow(run, kind)
