"""Quality rules, line first: rules judge each line, failing lines go, and a document that loses
too much of its text goes too.

A line fails by itself if it is ridden with symbols or exclamations, is hardly made of letters of
any script, is a bar of links, or has a known phrase of pages' furniture. It fails by its company if
the text has said it twice before, or in a stretch of short lines of which none ends a sentence, as
menus have.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import SPACE, WordHash, column

SYMBOLS = b"#*$%&|<>"
#: Fixed phrases of pages' furniture, lower case.
BOILERPLATE = (
    b"all rights reserved", b"cookie policy", b"privacy policy", b"terms of use", b"terms of service",
    b"subscribe to our newsletter", b"sign up for our newsletter", b"share on facebook", b"share on twitter",
    b"enable javascript", b"javascript is disabled", b"lorem ipsum", b"powered by", b"click here to",
)
#: What ends a sentence, in several scripts.
STOPS = tuple(x.encode() for x in ".!?:;…。！？»”\"')]")
#: From how many equal lines on the later ones fail, and how many short lines in a row of how few words.
REPEATS, MENU_LINES, MENU_WORDS = 3, 3, 4
_LETTERS = bytes(range(0x80, 0x100)) + b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
NAVIGATION = re.compile(rb"\||>|\xc2\xbb|\xc2\xb7|\xe2\x80\xba")
_BOILER = re.compile(b"|".join(re.escape(x) for x in BOILERPLATE))

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FIELDS = [*BASE, "n_lines", "n_bad_lines", "lost_chars", "text_chars"]


def characters(data: bytes) -> int:
    """Code points in UTF-8 bytes."""
    return len(data.decode("utf-8", "replace"))


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """How many words lie in a window of words that is found twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = WordHash()
    ids = np.array([h[w] for w in words], dtype=np.uint64)
    code = ids[:n].copy()
    for i in range(1, window):
        code = code * np.uint64(0x9E3779B97F4A7C15) + ids[i : n + i]
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((edge.cumsum()[:-1] > 0).sum())


def bad_line(line: bytes) -> bool:
    """Whether a line fails by itself. Blank lines never do."""
    words = line.split()
    if not words:
        return False
    chars = sum(map(len, words))
    symbols = chars - len(b"".join(words).translate(None, SYMBOLS + b"!_=~^{}[]\\"))
    if 4 * symbols > chars:
        return True
    if len(words) > 3 and 2 * len(b"".join(words).translate(None, _LETTERS)) > chars:
        return True
    if 3 * len(NAVIGATION.findall(line)) > len(words) and len(words) > 2:
        return True
    marks = sum(w.endswith((b"!!", b"??")) for w in words)
    if len(words) > 3 and 2 * marks > len(words):
        return True
    return len(words) < 30 and _BOILER.search(line.lower()) is not None


def bad_lines(lines: list[bytes]) -> list[bool]:
    """Which lines fail, by themselves or by their company."""
    bad = [bad_line(x) for x in lines]
    said: dict[bytes, list[int]] = {}
    run: list[int] = []
    for n, line in enumerate([*lines, b""]):
        words = line.split()
        if 0 < len(words) < MENU_WORDS and not words[-1].endswith(STOPS):
            run.append(n)
            continue
        if len(run) >= MENU_LINES:
            for i in run:
                bad[i] = True
        run = []
    for n, line in enumerate(lines):
        if key := line.strip(SPACE).lower():
            said.setdefault(key, []).append(n)
    for found in said.values():
        for i in found[1:] if len(found) >= REPEATS else ():
            bad[i] = True
    return bad


def judge(text: bytes) -> tuple[dict[str, int], bytes]:
    """The figures of one text, and the text without its bad lines."""
    words = text.split()
    seen: set[bytes] = set()
    kept, dup, bad, lost = [], 0, 0, 0
    lines = text.split(b"\n")
    for line, fails in zip(lines, bad_lines(lines), strict=True):
        blank = not line.split()
        if not blank:
            dup += line in seen
            seen.add(line)
        if fails:
            bad += 1
            lost += characters(b"".join(line.split()))
        else:
            kept.append(line)
    chars = characters(b"".join(words))
    return {
        "n_words": len(words),
        "word_chars": chars,
        "n_symbols": len(text) - len(text.translate(None, SYMBOLS)),
        "n_dup_lines": dup,
        "n_repeat_words": repeated_words(words),
        "n_lines": len(lines),
        "n_bad_lines": bad,
        "lost_chars": lost,
        "text_chars": chars,
    }, b"\n".join(kept)


def clean(docs: DataFrame, most_lost: float = 0.3, min_words: int = 10, most_repeated: float = 20.0) -> DataFrame:
    """docs with cleaned text, the figures of FIELDS, base_failed, lost_share and kept.

    A null text counts as empty (no words, so base_failed) and stays null. lost_share is the share
    of word characters in removed lines, 0 for wordless texts. Input columns named as an added one
    are replaced; other columns pass through; rows repeat as they do in docs.
    """
    added = [*FIELDS, "base_failed", "lost_share", "kept"]
    docs = docs.drop(*added)
    at_text = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in FIELDS)])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = column(batch, "text")
            found = [judge(t or b"") for t in texts]
            columns = batch.columns
            kept = [None if t is None else f[1] for t, f in zip(texts, found, strict=True)]
            columns[at_text] = pa.array(kept, pa.binary()).cast(columns[at_text].type)
            columns += [pa.array([f[0][n] for f in found], pa.int64()) for n in FIELDS]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    share = F.when(F.col("text_chars") > 0, F.col("lost_chars") / F.col("text_chars")).otherwise(0.0)
    out = docs.mapInArrow(run, schema).withColumn("base_failed", failed).withColumn("lost_share", share)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= most_lost))
