"""Repairs against an exhaustive search, and conversations in pieces."""

import random

import pytest

from tidemark.llm import dialogue


def by_search(codes):
    """(cost, audit) of the cheapest edits, found by trying all."""
    found = None

    def go(i, state, cost, audit, inserted):
        nonlocal found
        if found and cost > found[0]:
            return
        if i == len(codes) and state in dialogue.ACCEPTED and (found is None or (cost, audit) < found):
            found = cost, audit
        forced = [(s, to) for (s, symbol), to in dialogue.NEXT.items() if s == state and symbol != "s"]
        if inserted < 3:
            for _, to in forced:
                go(i, to, cost + 5, audit + "I", inserted + 1)
        if i < len(codes):
            fault, symbol = divmod(codes[i], 4)
            go(i + 1, state, cost + 2, audit + "D", 0)
            if fault != dialogue.GONE:
                cost += 5 * (fault == dialogue.CUT)
                if (to := dialogue.NEXT.get((state, "sua "[symbol]))) is not None:
                    go(i + 1, to, cost, audit + "K", 0)
                for _, to in forced:
                    go(i + 1, to, cost + 1, audit + "R", 0)

    go(0, 0, 0, "", 0)
    return found


def test_walk_finds_the_cheapest_and_least():
    rng = random.Random(1)
    segments = [(True, [rng.randrange(12) for _ in range(rng.randint(1, 6))]) for _ in range(300)]
    for (_, codes), way in zip(segments, dialogue.walk(segments), strict=True):
        assert min(x for (_, s), x in way.items() if s in dialogue.ACCEPTED) == by_search(codes)


TALK = [(c, t, ("system", "user", "assistant", None)[(c * t + t * t) % 4], ("So.", "cut", "", "Why?", f"{c} {t}!")[(c + 3 * t) % 5]) for c in range(12) for t in range(3 * c)]


def rows(spark, talk):
    df = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as copies", "true as again", "text as said")
    return sorted((tuple(r) for r in dialogue.repair(df).collect()), key=repr)


@pytest.mark.parametrize("segment, turns", [(1, 1), (3, 7), (256, 5), (4, 20_000)])
def test_pieces_of_any_size_give_the_same(spark, monkeypatch, segment, turns):
    whole = rows(spark, TALK)
    edges = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(dialogue, "SEGMENT", segment)
    monkeypatch.setattr(dialogue, "TURNS", turns)
    done = [c.asDict() for c in dialogue.damage(edges).sort("conv_id", "turn", "role", "text").collect()]
    out, seen = [], set()
    import pyarrow as pa

    for r in done:
        key = (r["conv_id"], r["role"], r["text"])
        r["again"] = bool(r["copies"]) and key in seen
        if r["copies"]:
            seen.add(key)
    schema = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    for batch in dialogue._repair(iter(pa.Table.from_pylist(done).to_batches(max_chunksize=10)), schema):
        out += [tuple(r.values()) for r in batch.to_pylist()]
    assert sorted(out, key=repr) == whole


def test_one_exchange_and_empty_table(spark):
    df = spark.createDataFrame(TALK[:0], "conv_id string, turn int, role string, text string")
    assert dialogue.repair(df).collect() == []
    plan = dialogue.repair(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
