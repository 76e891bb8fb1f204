"""Quality classifier: document evidence combined with host and path posteriors.

Two logistic models over hashed words and marks, one for quality and one for toxicity, give each
document a log odds of being bad. Sites are judged by hierarchical empirical Bayes over all labels:
a host's rate of bad documents is a Beta posterior around the global rate, a path's one around its
host's rate, with prior strengths estimated by the method of moments from the groups themselves, so
that sparse sites shrink toward the global prior. Documents are dealt into folds, and the rates
for a fold come from the labels of the others, so that no document votes for itself. A document's
odds are its evidence times its path's posterior odds over the global odds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import column, materialize, only

BITS = 16
SLOTS = 1 << BITS
#: The ridge of a telling slot, and how many standard errors from 0 its log odds ratio is where it doubles.
RIDGE, HALF_Z = 0.1, 4.0


class Features(dict):
    """word -> slot; one table per task."""

    def __missing__(self, word: bytes) -> int:
        slot = self[word] = xxhash.xxh32_intdigest(word) & (SLOTS - 1)
        return slot


def _shape(text: bytes, words: list[bytes]) -> list[bytes]:
    """Tokens for the look of a text: case, marks, repetition, each in coarse steps."""
    n = max(1, len(words))
    upper = sum(w.isupper() for w in words)
    marked = sum(not w[-1:].isalnum() and w[-1] < 128 for w in words)
    odd = len(text) - len(text.translate(None, b"#*$%&|<>!=_~^{}[]\\"))
    step = lambda x: min(10, int(10 * x))
    return [
        b"\x00upper%d" % step(upper / n),
        b"\x00marked%d" % step(marked / n),
        b"\x00odd%d" % step(odd / n),
        b"\x00new%d" % step(len(set(words)) / n),
        b"\x00short%d" % (n < 10),
    ]


def slots(text: bytes, seen: Features) -> np.ndarray:
    """Distinct slots of a text: lower-cased words without outer marks, and its shape tokens."""
    words = text.split()
    found = {seen[w] for w in {w.lower().strip(b".,;:!?\"'()*$%&#|") for w in words}}
    found.update(seen[t] for t in _shape(text, words))
    return np.fromiter(found, dtype=np.int64, count=len(found))


def judged(labels: DataFrame) -> DataFrame:
    """(doc_id, low, toxic), one row per labelled document; of several labels the worst holds."""
    return only(labels, "doc_id", "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("low"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"),
    )


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> np.ndarray:
    """Weights (2, SLOTS + 1) for low quality and for toxicity; the last column is the intercept.

    Ridge logistic regression over all slots, fitted on at most ``sample`` labelled documents,
    those of smallest hash of doc_id: only their slots come to the driver. Of several rows of one
    doc_id the least text counts, so that ``sample`` bounds rows too. No slot is left out; the
    less its log odds ratio differs from 0, in standard errors, the more it is shrunk.
    """
    known = judged(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Features()
        for batch in batches:
            found = [np.sort(slots(text or b"", seen)).astype("<u2").tobytes() for text in column(batch, "text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (1, 2)), pa.array(found, pa.binary())], ["low", "toxic", "slots"])

    rows = only(docs, "doc_id", "text").join(F.broadcast(known), "doc_id")
    rows = rows.groupBy("doc_id", "low", "toxic").agg(F.min("text").alias("text")).select("text", "low", "toxic")
    rows = materialize(rows.mapInArrow(run, "low int, toxic int, slots binary"), "labelled")
    # in an order of their own, so that sums don't depend on the partitions
    picked = sorted((bytes(r["slots"]), r["low"], r["toxic"]) for r in rows.toLocalIterator())
    out = np.zeros((2, SLOTS + 1))
    if not picked:
        return out
    at = np.frombuffer(b"".join(p[0] for p in picked), dtype="<u2").astype(np.int64)
    sizes = np.array([len(p[0]) // 2 for p in picked])
    for k in range(2):
        y = np.array([p[k + 1] for p in picked], dtype=float)
        if y.any():
            out[k] = _logistic(at, sizes, y)
    return out


def _logistic(at: np.ndarray, sizes: np.ndarray, y: np.ndarray, steps: int = 8) -> np.ndarray:
    """Newton's method with conjugate gradients, stopped early: verdicts settle long before weights
    do. ``at`` holds each document's slots one after
    another, of which it has ``sizes`` (1 at least); the intercept is last and lightly shrunk."""
    used, at = np.unique(at, return_inverse=True)
    n, starts = len(used), np.cumsum(sizes) - sizes
    n_in, n_bad = np.bincount(at, minlength=n), np.bincount(at, np.repeat(y, sizes), n)
    a, b, c, d = n_bad + 0.5, y.sum() - n_bad + 0.5, n_in - n_bad + 0.5, (1 - y).sum() - n_in + n_bad + 0.5
    z = np.abs(np.log(a * d / (b * c))) / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    penalty = np.append(RIDGE * (1 + (HALF_Z / np.maximum(z, 0.05)) ** 8), 0.01)

    def forth(w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(w[at], starts) + w[-1]

    def back(r: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(at, np.repeat(r, sizes), n), r.sum())

    def loss(w: np.ndarray) -> float:
        z = forth(w)
        return float((np.logaddexp(0, z) - y * z).sum() + (penalty * w * w).sum() / 2)

    w = np.zeros(n + 1)
    rate = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    w[-1] = np.log(rate / (1 - rate))
    before = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(forth(w), -30, 30)))
        gradient = back(y - p) - penalty * w
        bend = p * (1 - p)
        scale = back(bend) + penalty
        step, left = np.zeros(n + 1), gradient
        z = left / scale
        way, size = z, left @ z
        first = size
        for _ in range(10):
            if size <= 1e-1 * first:
                break
            bent = back(bend * forth(way)) + penalty * way
            length = size / (way @ bent)
            step, left = step + length * way, left - length * bent
            z = left / scale
            size, last = left @ z, size
            way = z + size / last * way
        share = 1.0
        while share > 1e-3 and (after := loss(w + share * step)) > before:
            share /= 2
        if share <= 1e-3:
            break
        w, gain, before = w + share * step, before - after, after
        if gain < 1e-2 * after:
            break
    out = np.zeros(SLOTS + 1)
    out[used], out[-1] = w[:-1], w[-1]
    return out


def evidence(docs: DataFrame, weights: np.ndarray, whole: bool = False) -> DataFrame:
    """(doc_id, source, lang, low, toxic): log odds by each model; if whole, also row, docs' row as a struct."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, prior = shared.value[:, :-1], shared.value[:, -1]
        seen = Features()
        for batch in batches:
            scores = np.zeros((2, batch.num_rows))
            for i, text in enumerate(column(batch, "text")):
                scores[:, i] = prior + table[:, slots(text or b"", seen)].sum(axis=1)
                if len(seen) > 300_000:
                    seen.clear()
            out = [*(batch.column(i) for i in range(3)), pa.array(scores[0]), pa.array(scores[1])]
            yield pa.RecordBatch.from_arrays(out + batch.columns[4:], ["doc_id", "source", "lang", "low", "toxic"] + ["row"] * whole)

    names = ["doc_id", "source", "lang", "text"]
    rows = docs.select(*names, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")) if whole else only(docs, *names)
    shape = "doc_id long, source string, lang string, low double, toxic double"
    return rows.mapInArrow(run, f"{shape}, row {rows.schema['row'].dataType.simpleString()}" if whole else shape)


def classify(docs: DataFrame, labels: DataFrame, sample: int = 20_000, threshold: float = 0.5, whole: bool = False) -> DataFrame:
    """(doc_id, low_odds, toxic_odds, host_rate, path_rate, bad_probability, kept) per row of docs;
    if whole, also row, docs' row as a struct.

    The host is source, the path source and lang; nulls are groups of their own, as are null texts
    the empty text. Site rates come from the labels of all documents of other folds; a site without
    any has its host's rate, or the global one. Repeated rows repeat; without labels every word
    weighs nothing and all documents are kept. An empty table gives an empty result.
    """
    weights = fit(docs, labels, sample)
    salted, rate = site_rates(docs, labels)
    each = evidence(docs, weights, whole).withColumn("k", _fold("doc_id"))
    both = each.join(salted, each.source.eqNullSafe(salted.s) & each.lang.eqNullSafe(salted.l) & (each.k == salted.fold))
    prior = float(np.log(rate / (1 - rate)))
    shift = _odds(F.least(F.greatest("path_rate", F.lit(1e-6)), F.lit(1 - 1e-6))) - prior
    good = 1 / (1 + F.exp(F.greatest("low", "toxic") + shift))
    return both.select(
        "doc_id", F.col("low").alias("low_odds"), F.col("toxic").alias("toxic_odds"), "host_rate", "path_rate",
        (1 - good).alias("bad_probability"), ((1 - good <= F.lit(threshold)) | F.lit(not weights.any())).alias("kept"),
        *["row"] * whole,
    )


#: Folds of documents; they also deal out a hot site's documents.
FOLDS = 32


def _fold(doc_id: str):
    return F.pmod(F.xxhash64(doc_id), F.lit(FOLDS)).cast("int")


def site_rates(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """(s, l, fold, host_rate, path_rate) for every source, lang and fold, and the global rate."""
    own = judged(labels).select(F.col("doc_id").alias("labelled"), F.greatest("low", "toxic").alias("own"))
    rows = only(docs, "doc_id", "source", "lang")
    each = rows.join(own, rows.doc_id == own.labelled, "left").withColumn("fold", _fold("doc_id"))
    cells = each.groupBy("source", "lang", "fold").agg(F.count("own").alias("n"), F.coalesce(F.sum("own"), F.lit(0)).alias("bad"))
    cells = materialize(cells, "site-folds")
    paths = cells.groupBy("source", "lang").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    hosts = paths.groupBy("source").agg(F.sum("n").alias("host_n"), F.sum("bad").alias("host_bad"))
    total, bad = paths.agg(F.sum("n"), F.sum("bad")).first()
    if not total:
        total, bad = 2, 1
    rate = min(1 - 1e-6, max(1e-6, bad / total))
    host_strength = _strength(hosts, "host_n", "host_bad", F.lit(rate))
    host = hosts.withColumnRenamed("source", "host").withColumn("mean", _shrunk("host_n", "host_bad", F.lit(rate), host_strength))
    sites = materialize(paths.join(host, F.col("source").eqNullSafe(F.col("host"))).drop("host"), "sites")
    path_strength = _strength(sites, "n", "bad", F.col("mean"))
    # every site in every fold, less what the fold itself has
    whole = sites.withColumnsRenamed({"source": "s", "lang": "l"}).drop("mean").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1))))
    less = cells.select(F.col("source").alias("ls"), F.col("lang").alias("ll"), F.col("fold").alias("lf"), F.col("n").alias("ln"), F.col("bad").alias("lb"))
    host_less = less.groupBy("ls", "lf").agg(F.sum("ln").alias("hn"), F.sum("lb").alias("hb")).withColumnsRenamed({"ls": "hs", "lf": "hf"})
    left = whole.join(less, F.col("s").eqNullSafe(F.col("ls")) & F.col("l").eqNullSafe(F.col("ll")) & (F.col("fold") == F.col("lf")), "left")
    left = left.join(host_less, F.col("s").eqNullSafe(F.col("hs")) & (F.col("fold") == F.col("hf")), "left")
    for n, b, m, c in (("n", "bad", "ln", "lb"), ("host_n", "host_bad", "hn", "hb")):
        left = left.withColumn(n, F.col(n) - F.coalesce(m, F.lit(0))).withColumn(b, F.col(b) - F.coalesce(c, F.lit(0)))
    left = left.withColumn("host_rate", _shrunk("host_n", "host_bad", F.lit(rate), host_strength))
    left = left.withColumn("path_rate", _shrunk("n", "bad", F.col("host_rate"), path_strength))
    return materialize(left.select("s", "l", "fold", "host_rate", "path_rate"), "site-rates"), rate


def _odds(p):
    return F.log(p / (1 - p))


def _shrunk(n: str, bad: str, mean, strength: float):
    """A group's rate as the posterior mean around ``mean``."""
    return (F.col(bad) + mean * strength) / (F.col(n) + strength)


def _strength(groups: DataFrame, n: str, bad: str, mean) -> float:
    """How many documents the prior counts for: method of moments over the groups' rates."""
    rate = F.col(bad) / F.col(n)
    row = groups.where(F.col(n) > 0).agg(
        F.sum(F.pow(rate - mean, 2) * F.col(n)), F.sum(mean * (1 - mean)), F.sum(mean * (1 - mean) * F.col(n)), F.sum(n), F.count("*")
    ).first()
    if not row[4]:
        return 1.0
    spread, within, weighted, total, _ = row
    between = max(1e-9, (spread - within) / total)
    return float(min(1e6, max(1.0, weighted / total / between - 1)))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that classify() keeps, with the columns of docs: each row by its own
    verdict, whatever its doc_id."""
    kept = classify(docs, labels, **options, whole=True).where("kept")
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
