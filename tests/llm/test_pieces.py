import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tidemark.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, ids string"
TEXTS = [
    "Hello world", " two  spaces   here ", "line\n\nbreaks \n and\ttabs", "naïve café ☃ 漢字 🙂", "", None, "a▁b ▁▁c", "x" * 300, "<s> </s> <unk> <0x0A>",
    "   ", "\n", "Thstinnt thndhain. Onhalyti the in erthst%%% ouè***", "don't stop!!! " * 5, "nul \x00 byte",
]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load(PATH)


def test_encode_equals_the_library_and_decode_returns_the_text(spark, vocabulary):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = np.random.default_rng(0)
    letters = list("etaoin shrdlu  .,éÜ\n'")
    texts = TEXTS + ["".join(rng.choice(letters, 80)) for _ in range(40)] + [TEXTS[0]]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA).coalesce(2)
    encoded = pieces.encode(docs, vocabulary, batch_bytes=500)
    got = {r.doc_id: r.ids for r in encoded.collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == (None if t is None else sp.encode(t)), repr(t)
    back = {r.doc_id: r.text for r in pieces.decode(encoded, vocabulary).collect()}
    assert back == {i: t if t is None else t.replace("▁", " ") for i, t in enumerate(texts)}


def test_viterbi_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    parts = sorted({"".join(rng.choice(list("abc▁"), rng.integers(1, 5))) for _ in range(60)} - {"c"})
    vocabulary = pieces.Vocabulary(["<unk>", *parts], [0.0, *(-rng.random(len(parts)) * 9).tolist()], ["other"] + ["normal"] * len(parts), 0, True)
    helper = pieces.Helper(vocabulary)

    def splits(unit):
        if not unit:
            yield 0.0, []
        for k in range(1, len(unit) + 1):
            head = unit[:k]
            if head in helper.at or k == 1:
                for s, rest in splits(unit[k:]):
                    yield (helper.at[head][0] if head in helper.at else helper.lowest - 10) + s, [head, *rest]

    units = ["▁" + "".join(rng.choice(list("abc"), rng.integers(1, 9))) for _ in range(30)]
    df = spark.createDataFrame([(0, u) for u in sorted(set(units))], "bucket long, unit string")
    for r in pieces.lattice(df, vocabulary).collect():
        best = max(splits(r.unit))[0]
        ids = helper.fill(r.unit, r.spans)
        score = sum(vocabulary.scores[i] if i else helper.lowest - 10 for i in ids)
        path = helper._best_path(r.unit)
        assert score == pytest.approx(best) and "".join(path) == r.unit
        assert sum(helper.at[p][0] if p in helper.at else helper.lowest - 10 for p in path) == pytest.approx(best)


def test_units_of_any_length_stay_in_the_lattice(spark, vocabulary):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = np.random.default_rng(4)
    units = sorted({"▁" + "".join(rng.choice(list("etaoinshrdlué-/"), n)) for n in [2, 59, 60, 61, 62, 63, 64, 120, 400] for _ in range(4)} | {"▁" + "a" * 150})
    helper = pieces.Helper(vocabulary)
    found = pieces.lattice(spark.createDataFrame([(0, u) for u in units], "bucket long, unit string"), vocabulary).collect()
    assert len(found) == len(units)
    assert all(helper.fill(r.unit, r.spans) == sp.encode(r.unit[1:]) for r in found)


def test_numbers_are_the_units_of_the_regular_expression():
    for text in [t for t in TEXTS if t is not None] + ["\n\n a\n▁b \n  c d▁ e", " ", "  \n", "a \n", "▁", " ▁x  ▁ y"]:
        numbers = pieces.Numbers()
        at = numbers.of(text.encode())
        units = numbers.units()
        assert [units[i] for i in at] == pieces.units_of(text.encode()), repr(text)


def test_a_vocabulary_out_of_order_is_refused():
    scores = {"a": 0.0, "b": 0.0, "c": 0.0, "ab": -9.0, "abc": -1.0}
    with pytest.raises(ValueError, match="order of rank"):
        pieces.Vocabulary(list(scores), list(scores.values()), ["normal"] * 5).check()


def test_documents_are_cut_into_batches_and_keep_their_rows(spark, vocabulary):
    rows = [(i % 5 if i % 5 else None, "one two  three\n" * (i % 4), "x") for i in range(50)] + [(7, "word " * 200_000, "x")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = sorted(((r.doc_id, r.ids) for r in pieces.encode(docs, vocabulary, batch_bytes=300).collect()), key=repr)
    assert got == sorted(((i, sp.encode(t)) for i, t, _ in rows), key=repr)


def test_helper_equals_the_library(vocabulary):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    helper = pieces.Helper(vocabulary)
    rng = np.random.default_rng(3)
    for _ in range(100):
        word = "".join(rng.choice(list("etaoinshrdlu"), rng.integers(1, 90)))
        assert helper.encode("▁" + word) == sp.encode(word)


def test_empty(spark, vocabulary):
    assert pieces.encode(spark.createDataFrame([], SCHEMA), vocabulary).count() == 0
