"""Conversations damaged by rule, diagnosed, and repaired at least cost to a grammar of roles.

Rows are dealt by a hash of their conversation and sorted, so that each task reads conversations one
after the other. A batch of them is cut into segments of at most SEGMENT turns, and one recursive
DuckDB query advances all segments a turn at a time, keeping the least cost and audit per grammar
state at the start and the end of each segment. A conversation's segments are then chained, so that
long ones need no more memory than their audit.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, column, only, sliced

#: Turns that a recursion goes through, turns and bytes of a batch.
SEGMENT, TURNS, BYTES = 256, 20_000, 16 << 20
#: The costs of edits, and what a truncated turn that stays adds.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: The grammar (s?(ua)+)?: what symbol leads from a state to which. It accepts states 0 and 3.
START, ACCEPTED = 0, (0, 3)
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES = (0, 1, 2, 3)
ROLES = {"s": b"system", "u": b"user", "a": b"assistant"}
SYMBOLS = {b"s": 0, b"u": 1, b"a": 2}
FINE, CUT, GONE = 0, 1, 2
SCHEMA = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _inserts(state: int) -> dict[int, int]:
    """State -> the fewest insertions that lead there from ``state``."""
    found, reached = {state: 0}, [state]
    for s in reached:
        for (was, symbol), to in NEXT.items():
            if was == s and symbol != "s" and to not in found:
                found[to] = found[s] + 1
                reached.append(to)
    return found


def edges() -> list[tuple]:
    """(turn's code, state, state after it, cost, letters) of every way to take a turn and then to
    insert others; a code is 4 * fault + the role's symbol."""
    out = []
    for fault in (FINE, CUT, GONE):
        for symbol, role in enumerate("sua "):
            for state in STATES:
                ways = [(state, DELETE, "D")]
                if fault != GONE:
                    more = TRUNCATED * (fault == CUT)
                    ways += [(to, more, "K") for (s, by), to in NEXT.items() if s == state and by == role]
                    ways += [(to, REROLE + more, "R") for (s, by), to in NEXT.items() if s == state and by != "s"]
                for to, cost, letter in ways:
                    out += [(4 * fault + symbol, state, end, cost + INSERT * n, letter + "I" * n) for end, n in _inserts(to).items()]
    return out


WALK = """
with recursive walk as (
  select seg, 0 as i, s0, s, cost, letters from seeds
  union all
  select seg, i + 1, s0, s, least_.cost, least_.letters from (
    select w.seg, w.i, w.s0, e.after as s, min(struct_pack(cost := w.cost + e.cost, letters := w.letters || e.letters)) as least_
    from walk w join turns t on t.seg = w.seg and t.i = w.i join edges e on e.code = t.code and e.state = w.s
    group by w.seg, w.i, w.s0, e.after))
select seg, s0, s, cost, letters from walk join sizes using (seg) where i = n"""


@lru_cache(maxsize=1)
def _duck():
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})
    con.execute("create table edges (code int, state int, after int, cost bigint, letters varchar)")
    con.executemany("insert into edges values (?, ?, ?, ?, ?)", edges())
    return con


def walk(segments: list[tuple[bool, list[int]]]) -> list[dict]:
    """For segments (is it a conversation's first, codes of its turns): {(state before, state after):
    (cost, letters)} of the cheapest edits, ties the least letters."""
    con = _duck()
    seeds = [(k, s0, s, INSERT * n, "I" * n) for k, (first, _) in enumerate(segments) for s0 in ((START,) if first else STATES) for s, n in (_inserts(s0) if first else {s0: 0}).items()]
    turns = [(k, i, code) for k, (_, codes) in enumerate(segments) for i, code in enumerate(codes)]
    named = lambda rows, names, kinds: pa.table([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    number = pa.int32()
    con.register("seeds", named(seeds, ["seg", "s0", "s", "cost", "letters"], [number, number, number, pa.int64(), pa.string()]))
    con.register("turns", named(turns, ["seg", "i", "code"], [number] * 3))
    con.register("sizes", named([(k, len(c)) for k, (_, c) in enumerate(segments)], ["seg", "n"], [number] * 2))
    out: list[dict] = [{} for _ in segments]
    for seg, s0, s, cost, letters in con.execute(WALK).fetchall():
        out[seg][s0, s] = cost, letters
    for name in ("seeds", "turns", "sizes"):
        con.unregister(name)
    return out


class Conversation:
    """One conversation while its sorted turns come in."""

    def __init__(self, conv_id) -> None:
        self.conv_id = conv_id
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.low = self.high = self.before = self.initial = None
        self.turns = 0
        #: state -> (cost, letters since what all states share, digest of the repaired lines, lines)
        self.states: dict[int, tuple] = {START: (0, "", hashlib.sha256(), 0)}
        self.audit: list[str] = []
        self.segments: list[tuple[list[int], list[tuple[bytes, bytes]]]] = []

    def add(self, turn, role: bytes, text: bytes, again: bool) -> None:
        if turn is not None and turn != self.before:
            self.low = turn if self.low is None else self.low
            self.high = self.before = turn
            self.turns += 1
        said = text.rstrip(SPACE)
        fault, what = (GONE, "blank") if not said else (GONE, "duplicate") if again else (CUT, "truncated") if said[-1] not in b".!?" else (FINE, "")
        if what:
            self.counts[what] += 1
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in (b"su", b"ua", b"au"):
            self.counts["illegal"] += 1
        self.initial = initial
        if not self.segments or len(self.segments[-1][0]) == SEGMENT:
            self.segments.append(([], []))
        self.segments[-1][0].append(4 * fault + SYMBOLS.get(initial, 3))
        self.segments[-1][1].append((role, text))

    def chain(self, ways: list[dict], last: bool) -> None:
        """Carry states through the segments; the last conversation's end needs one state only."""
        for k, ((_, rows), way) in enumerate(zip(self.segments, ways, strict=True)):
            found: dict[int, tuple] = {}
            for (s0, s), (cost, letters) in way.items():
                if s0 in self.states:
                    was = self.states[s0]
                    new = (was[0] + cost, was[1] + letters, s0, letters)
                    found[s] = min(found.get(s, new), new)
            if last and k + 1 == len(ways):
                end = min((s for s in ACCEPTED if s in found), key=lambda s: found[s][:2])
                found = {end: found[end]}
            elif 3 in found:  # from 3 all goes on as from 0, but for a system turn to delete, or as from 1
                found = {s: x for s, x in found.items() if not (s == 0 and x[0] > found[3][0] + DELETE or s == 1 and x[0] > found[3][0])}
            states = {}
            for s, (cost, letters, s0, new) in found.items():
                digest, n = self.states[s0][2].copy(), self.states[s0][3]
                for line in repaired(new, rows, s0):
                    digest.update(b"\n" + line if n else line)
                    n += 1
                states[s] = cost, letters, digest, n
            shared = os.path.commonprefix([x[1] for x in states.values()])
            self.audit.append(shared)
            self.states = {s: (x[0], x[1][len(shared) :], *x[2:]) for s, x in states.items()}
        self.segments = []

    def row(self) -> tuple:
        cost, letters, digest, _ = self.states[min((s for s in ACCEPTED if s in self.states), key=lambda s: self.states[s][:2])]
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv_id, gaps, *self.counts.values(), cost, "".join([*self.audit, letters]), digest.hexdigest()


def repaired(letters: str, rows: list[tuple[bytes, bytes]], state: int) -> Iterator[bytes]:
    """The lines that edits make of (role, text) rows, from a grammar state on."""
    at = iter(rows)
    for letter in letters:
        role, text = (b"", b"") if letter == "I" else next(at)
        if letter == "D":
            continue
        symbol = role[:1].decode() if letter == "K" else next(by for s, by in NEXT if s == state and by != "s")
        yield (role if letter == "K" else ROLES[symbol]) + b":" + text
        state = NEXT[state, symbol]


def _repair(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of conversations, each one's together and sorted, to a row per conversation."""
    done: list[Conversation] = []
    now: Conversation | None = None
    turns = held = 0

    def solved(last: bool) -> pa.RecordBatch:
        """Walk all that is held; ``now`` has ended if this is the last."""
        every = [*done, now]
        ways = iter(walk([(not c.audit and not k, s[0]) for c in every for k, s in enumerate(c.segments)])) if turns else iter(())
        for c in every:
            c.chain([next(ways) for _ in c.segments], last or c is not now)
        rows = [c.row() for c in (every if last else done)]
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(schema)], schema=schema)

    for batch in sliced(batches):
        for conv_id, turn, role, text, copies, again in zip(*(column(batch, n) for n in ("conv_id", "turn", "role", "text", "copies", "again")), strict=True):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    done.append(now)
                now = Conversation(conv_id)
            for k in range(copies):
                now.add(turn, role, text, again or k > 0)
                turns, held = turns + 1, held + len(text) + 200
            held += 500  # of a conversation itself
            if turns >= TURNS or held >= BYTES:
                yield solved(False)
                turns = held = 0
    if now is not None:
        yield solved(True)


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows as CRC-32 of "conv_id:turn" modulo 20 has them; a
    null counts as a space everywhere, a dropped row has no copy and no text."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20
    role = F.when(fate == 4, F.lit("user")).otherwise(filled("role"))
    text = F.when(fate == 0, F.lit("")).when(fate == 1, F.lit("")).when(fate == 2, F.regexp_replace(filled("text"), "[.!?]", "")).otherwise(filled("text"))
    copies = F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1)
    return only(rows, "conv_id", "turn", "role", "text").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of damaged ``rows``: what is wrong with it, the cheapest edits that
    make its roles' initials (s?(ua)+)?, their cost, and a digest of the repaired text.

    A conversation's rows go by turn, nulls first, then by role and text. A null conv_id is a
    conversation like any other; one without rows has zeros and empty texts; repeated rows are
    duplicates; an empty table gives none. One exchange deals rows by conversation and serves the
    window that finds repeated turns, the sort and the batches. A conversation of any length passes
    its task as a stream: its audit and digest are built in its order, and can't be by others.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {SCHEMA}"
    schema = to_arrow_schema(rows.sparkSession.createDataFrame([], kind).schema)
    dealt = damage(rows).repartition("conv_id")
    said = F.when(F.col("copies") > 0, F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text")))
    order = F.col("turn").asc_nulls_first()
    again = F.row_number().over(Window.partitionBy("conv_id", "said").orderBy(order)) > 1
    sorted_ = dealt.withColumn("said", said).withColumn("again", again).drop("said").sortWithinPartitions("conv_id", order, "role", "text", "again")
    return sorted_.mapInArrow(lambda batches: _repair(batches, schema), kind)
