"""Mixing sources to target weights with pivotal dependent rounding.

A source's target over its size is every document's number of copies, a whole part and a
fraction. The fractions are rounded pairwise: of two open documents, or of one and all shorter ones
of its chunk, one takes mass from the other, in a random direction that keeps every expectation and
the source's sum of words, until one of them is integral. Chunks of a source are rounded in parallel, each leaves at most one open
document, and those meet in ever larger groups of a reduction tree until one is left per source.
So a source's words differ from its target by less than one document, and as documents meet from
the longest to the shortest, that one is among the shortest of its group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, materialize, only

#: Documents in a chunk of the first level, and open documents that meet in a group above it.
CHUNK, FAN_IN = 10_000, 1_000
SALTS = 64
EPS = 1e-9


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target) for sizes(source, size).

    Sources in code point order, null last, take the weights in turn. Their targets share
    ``share`` times all sizes by weight; a target over ``most`` times its source's size stops
    there and the excess is shared again among the others, until none is above.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # windows over one row per source
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank % len(weights) + 1).cast("int"))
    limit = F.lit(float(most)) * F.col("source_size")
    ranked = materialize(totals.select("source", "source_size", weight.alias("weight"), limit.alias("limit")), "sources")
    # sources stop in order of limit by weight: the level is that of the first source that doesn't
    full = F.col("limit") / F.col("weight")
    before = Window.orderBy("full", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    held, gone = (F.coalesce(F.sum(c).over(before), F.lit(0.0)) for c in ("limit", "weight"))
    levels = ranked.withColumn("full", full).select(
        "full", ((F.lit(float(share)) * F.sum("source_size").over(every) - held) / (F.sum("weight").over(every) - gone)).alias("level"))
    found = levels.where("level <= full").agg(F.min_by("level", "full")).first()[0]
    target = F.col("limit") if found is None else F.least(F.lit(float(found)) * F.col("weight"), F.col("limit"))
    return ranked.select("source", "source_size", target.alias("target"))


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def _round_equal(size: np.ndarray, part: float, draw: np.ndarray) -> np.ndarray:
    """Round entries of one fraction, from the first to the last: each is paired with all that come
    after it as one, which keep a common fraction, and mass moves until it or they are integral."""
    out = np.zeros(len(size))
    after = np.cumsum(size[::-1])[::-1] - size
    words = float(size.sum()) * part  # of the entry and those after it
    for i, (a, rest) in enumerate(zip(size.tolist(), after.tolist(), strict=True)):
        p = words / (a + rest)
        theirs = words - a * p
        up, down = min(a * (1 - p), theirs), min(a * p, rest - theirs)
        if up + down < EPS:
            out[i], out[i + 1 :] = p, np.rint(theirs / rest) if rest else 0.0
            break
        rises = draw[i] * (up + down) < down
        p, theirs = (p + up / a, theirs - up) if rises else (p - down / a, theirs + down)
        out[i], words = p, theirs
        if min(p, 1 - p) > EPS:
            out[i + 1 :] = np.rint(theirs / rest)
            break
        out[i] = round(p)
    return out


def _round_group(size: np.ndarray, part: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Round part in pairs, keeping sum(size * part); at most one entry stays fractional."""
    out = part.copy()
    open_ = np.flatnonzero((part > EPS) & (part < 1 - EPS))
    if len(open_) > 1 and np.ptp(part[open_]) < EPS:
        out[open_] = _round_equal(size[open_], float(part[open_].mean()), draw[open_])
        return out
    held = -1
    for i in np.flatnonzero((part > EPS) & (part < 1 - EPS)).tolist():
        if held < 0:
            held = i
            continue
        a, b = size[held], size[i]
        p, q = out[held], out[i]
        up = min(a * (1 - p), b * q)  # words that held can take from i
        down = min(a * p, b * (1 - q))
        moved = up if draw[i] * (up + down) < down else -down
        p, q = p + moved / a, q - moved / b
        p, q = (round(x) if min(x, 1 - x) < EPS else x for x in (p, q))
        out[held], out[i] = p, q
        held = held if EPS < p < 1 - EPS else i if EPS < q < 1 - EPS else -1
    return out


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for each row of docs.

    size counts the words of the text, 0 for null or blank ones, which get no copies. Null sources
    are one source. Copies are within one of target over source_size. The draws are hashes of
    doc_id, source, size and text: reruns agree; rows equal in all four are interchangeable. An empty
    table gives an empty result.
    """
    return _mixed(docs, weights, share, most, seed).drop("draw")


def _draw(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id", "source", "size", "text")


def _mixed(docs: DataFrame, weights: Sequence[float], share: float, most: float, seed: int) -> DataFrame:
    """mix() with draw, which tells rows apart."""
    rows = only(docs, "doc_id", "source", "text").withColumn("size", _size())
    rows = rows.select("doc_id", "source", "size", _draw(seed).alias("draw"))
    rows = materialize(rows, "sizes")
    targets = materialize(source_targets(rows, weights, share, most), "targets")
    counts = rows.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("n"))
    plan = targets.join(counts, F.col("source").eqNullSafe(F.col("s"))).select(
        "source", "source_size", "target", F.ceil(F.col("n") / CHUNK).cast("long").alias("chunks")
    )
    # a hot source's rows are dealt out by a salt before they meet the source's line
    plan = materialize(plan, "mix-plan")
    salted = plan.withColumnRenamed("source", "s").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod("draw", F.lit(SALTS)).cast("int"))
    each = rows.join(salted, rows.source.eqNullSafe(salted.s) & (rows.salt == salted.salt)).select(
        "doc_id", "source", "size", "source_size", "target", "draw", "chunks",
        F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"),
    )
    each = each.withColumn("copies", F.floor("rate")).withColumn("part", F.col("rate") - F.col("copies"))
    each = each.withColumn("chunk", F.pmod(F.shiftrightunsigned("draw", 8), F.col("chunks")))
    schema = "doc_id long, source string, size long, source_size long, target double, copies long, draw long, chunk long, chunks long, part double"

    def level(pdf: pd.DataFrame) -> pd.DataFrame:
        by = {"size": False, "draw": True, "doc_id": True}  # the longest first
        pdf = pdf.sort_values([*by], ascending=[*by.values()], kind="stable", na_position="last", ignore_index=True)
        u = (pdf["draw"].to_numpy(np.int64).view(np.uint64) >> np.uint64(11)) / 2.0**53
        part = _round_group(pdf["size"].to_numpy(float), pdf["part"].to_numpy(float), u)
        done = (part < EPS) | (part > 1 - EPS)
        pdf["copies"] += np.where(done, np.rint(part), 0).astype(np.int64)
        pdf["part"] = np.where(done, 0.0, part)
        return pdf

    names = [x.split()[0] for x in schema.split(", ")]
    rows, parts = each.select(*names), []
    while True:
        rounded = materialize(rows.groupBy("source", "chunk").applyInPandas(level, schema), "mix-level")
        still = rounded.where("part > 0")
        parts.append(rounded.where("part = 0"))
        chunks_left = still.agg(F.max("chunks")).first()[0]
        if chunks_left is None or chunks_left <= 1:
            break
        rows = still.select(
            *names[:-3],
            F.floor(F.col("chunk") / FAN_IN).alias("chunk"),
            F.ceil(F.col("chunks") / FAN_IN).alias("chunks"),
            "part",
        )
    # the last open document of a source: its own draw decides
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "draw"), 11) / F.lit(2.0**53)
    out = still.withColumn("copies", F.col("copies") + F.when(u < F.col("part"), 1).otherwise(0))
    for part in parts:
        out = out.union(part)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", "draw")


def take(
    docs: DataFrame,
    weights: Sequence[float] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
) -> DataFrame:
    """docs with each row repeated as often as the mix takes it (possibly never).

    Rows are met by their draw; rows of one draw, which agree in doc_id, source and text, are
    numbered on both sides, so each takes its own copies.
    """
    names = [f"__c{n}" for n in range(len(docs.columns))]
    at = {c: F.col(n) for c, n in zip(docs.columns, names, strict=True)}
    keyed = docs.toDF(*names).withColumns({c: at[c] for c in ("doc_id", "source", "text")}).withColumn("size", _size())
    keyed = keyed.select(*names, _draw(seed).alias("__draw"))
    n = _mixed(docs, weights, share, most, seed).select(F.col("draw").alias("__of"), F.col("copies").alias("__copies"))
    n = materialize(n, "copies")
    same = F.col("__draw") == F.col("__of")
    if not n.groupBy("__of").count().where("count > 1").isEmpty():  # the same row again
        keyed = keyed.withColumn("__i", F.row_number().over(Window.partitionBy("__draw").orderBy("__draw")))
        n = n.withColumn("__j", F.row_number().over(Window.partitionBy("__of").orderBy("__copies")))
        same = same & (F.col("__i") == F.col("__j"))
    both = keyed.join(n.where("__copies > 0").hint("merge"), same)  # as many rows as documents: never broadcast
    each = both.select(*names, F.explode(F.expr("array_repeat(1, cast(__copies as int))")).alias("__copy"))
    return each.select(*(at[c].alias(c) for c in docs.columns))
