import re
from collections import Counter

from hypothesis import given
from hypothesis import strategies as st

from tidemark.llm import queries, rules


def slow_repeats(words, k=5):
    seen = Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    hit = {i + j for i in range(len(words) - k + 1) if seen[tuple(words[i : i + k])] > 1 for j in range(k)}
    return len(hit)


@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60))
def test_repeated_words(words):
    assert rules.repeated_words(words) == slow_repeats(words)


def test_figures():
    got, kept = rules.judge("été #1 <b>\n\nA b c\nA b c \nA b c\n".encode())
    assert {k: got[k] for k in rules.BASE} == {"n_words": 12, "word_chars": 17, "n_symbols": 3, "n_dup_lines": 1, "n_repeat_words": 9}
    assert kept == b"\n"  # the rest reads like a menu


def test_lines():
    assert rules.bad_line(b"Home | About | Contact | Help")
    assert rules.bad_line(b"*** $$$ ### word")
    assert rules.bad_line(b"WIN!! NOW!! CASH!! FREE!!")
    assert rules.bad_line(b"Copyright 2020. All rights reserved.")
    assert not rules.bad_line(b"A plain sentence, with a comma and (perhaps) a bracket.")
    assert not rules.bad_line(b"  ")


def slow_verdict(text):
    """The whole result for a text, character by character."""
    space = " \t\n\x0b\x0c\r"
    split = lambda x: re.findall(f"[^{space}]+", x)
    words, lines = split(text), text.split("\n")
    full = [x for x in lines if split(x)]
    fails = []
    for line in lines:
        own = split(line)
        chars = "".join(own)
        size = len(chars.encode())
        odd = sum(c in "#*$%&|<>!_=~^{}[]\\" for c in chars)
        letters = sum(len(c.encode()) for c in chars if c.isascii() and c.isalpha() or not c.isascii())
        bars = sum(line.count(x) for x in "|>»·›")
        loud = sum(w.endswith(("!!", "??")) for w in own)
        fails.append(bool(own) and (
            4 * odd > size or len(own) > 3 and 2 * (size - letters) > size or len(own) > 2 and 3 * bars > len(own)
            or len(own) > 3 and 2 * loud > len(own) or len(own) < 30 and any(p.decode() in line.lower() for p in rules.BOILERPLATE)))
    short = [0 < len(split(x)) < 4 and split(x)[-1][-1] not in ".!?:;…。！？»”\"')]" for x in lines]
    for a in range(len(lines) - 2):
        if all(short[a : a + 3]):
            fails[a : a + 3] = [True] * 3
    keys = ["".join(c.lower() if c.isascii() else c for c in x.strip(space)) for x in lines]
    for i, key in enumerate(keys):
        if key and keys.count(key) >= 3 and key in keys[:i]:
            fails[i] = True
    size = lambda x: len("".join(split(x)))
    lost, repeated = sum(size(x) for x, f in zip(lines, fails) if f), slow_repeats(words)
    base = len(words) < 10 or 100 * repeated > 20 * len(words)
    return (len(words), size(text), sum(c in "#*$%&|<>" for c in text), len(full) - len(set(full)), repeated, base,
            not base and (not size(text) or lost / size(text) <= 0.3), sum(fails), lost)


def test_query_matches_a_slow_version(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = ["Menu\nHome\nAbout us\nContact", "Yes\nyes \nYES\nno.\n" * 3, "1 2 3 4 5 6 7 8 9 10 11\nfine words here. » « ›", None, "", " \n\t", "é\u00a0ü Ünd ß " * 9, "a\x0bb\x0cc\rd " * 5, "Datenschutz > Impressum > Kontakt > Über"]
    docs = docs.union(spark.createDataFrame([(5000 + i, t) for i, t in enumerate(odd)], docs.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in queries.op8_quality_rules(spark, str(tmp_path)).collect()}
    want = {r.doc_id: slow_verdict(r.text or "") for r in docs.collect()}
    assert got == want and not all(w[6] for w in want.values())


def test_clean(spark):
    prose = " ".join(f"word{i}" for i in range(40)) + "."
    rows = [(1, prose), (2, prose + "\nHome | About | Help | More"), (3, "\n".join(["a | b | c | d"] * 9) + "\nsome text"), (4, None), (5, ""), (6, "x y " * 50), (6, prose), (None, prose)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, kept string")
    got = rules.clean(df).collect()
    assert [r.kept for r in got] == [True, True, False, False, False, False, True, True]
    assert got[1].text == prose and got[3].text is None and got[3].n_words == 0
    assert rules.clean(df.limit(0)).count() == 0


def test_long_text():
    words = [b"w%d" % (i % 50_000) for i in range(200_000)]
    assert rules.judge(b" ".join(words))[0]["n_repeat_words"] == 200_000
