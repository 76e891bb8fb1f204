import numpy as np
import pytest
import xxhash

from tidemark.llm import simhash


def slow_fp(text, k):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(ids, fps, tau):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i, a in zip(ids, fps):
            for j, b in zip(ids, fps):
                if label[j] < label[i] and bin(int(a) ^ int(b)).count("1") <= tau:
                    label[i], changed = label[j], True
    return label


def test_fingerprint():
    for text in ["", "one", "A b\tc", "The quick  brown\nfox jumps over the lazy dog été", "x y " * 50]:
        assert simhash.fingerprint(text.encode(), 4) == slow_fp(text, 4)


def test_spark_hash_is_the_same_function(spark):
    got = spark.sql("select xxhash64('the quick brown fox') as h").first().h
    assert got % 2**64 == xxhash.xxh64_intdigest(b"the quick brown fox", 42)


def test_chain_keys_lose_no_pair():
    rng = np.random.default_rng(0)
    keys = simhash.chain_keys(4)
    a = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, 6), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    near = np.bitwise_count(a ^ b) <= 4
    assert (simhash.close(a, b, 4) == near).all()
    seg = lambda x: x.view(np.uint8).reshape(-1, 8)
    meet = np.zeros(len(a), dtype=bool)
    for k in keys:
        meet |= (seg(a)[:, list(k)] == seg(b)[:, list(k)]).all(axis=1)
    assert meet[near].all()


@pytest.mark.parametrize("bucket,small", [(4096, 64), (5, 2)])
def test_components_match_brute_force(spark, monkeypatch, bucket, small):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = np.random.default_rng(3)
    words = ["w%d" % i for i in range(300)]
    rows = []
    for base in range(8):
        text = [words[i] for i in rng.integers(0, 300, 120)]
        for copy in range(12):
            t = list(text)
            for at in rng.integers(0, 120, copy % 3):
                t[at] = "edit"
            rows.append((len(rows), " ".join(t)))
    rows += [(1000, None), (1001, "  "), (5000, rows[0][1]), (5000, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs, 4).collect()}
    ids = [r[0] for r in rows]
    want = slow_components(ids, [slow_fp(t or "", 4) for _, t in rows], 4)
    assert got == set(want.items())
    kept = simhash.keep_first(docs, 4)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c in want.items() if i == c)


def test_buckets_of_a_stream(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 3)
    fps = spark.createDataFrame([(i,) for i in range(64)], "fp long")
    found = {(r.a, r.b) for r in simhash.links(fps).collect()}
    label = {i: i for i in range(64)}
    for _ in range(64):
        for a, b in found:
            label[a] = label[b] = min(label[a], label[b])
    assert set(label.values()) == {0}


def test_nulls_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b"), (3, "a b"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(None, 3), (3, 3), (None, None)], key=repr)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    for keep in (simhash.keep_first, simhash.keep_first_similar):
        assert keep(empty).count() == 0
        assert sorted(map(tuple, keep(docs).collect()), key=repr) == [(3, "a b"), (None, None)]


def test_rows_of_one_id_are_told_apart(spark):
    far, near = "one two three four five six seven", " ".join(f"w{i}" for i in range(200))
    rows = [(1, far, 1.0, "p"), (1, near, 2.0, "q"), (1, near, 3.0, "q"), (2, near + " end", 4.0, "r"), (None, far, 5.0, "s"), (1, far, 1.0, "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h double, component string")
    for keep in (simhash.keep_first, simhash.keep_first_similar):
        kept = keep(docs)
        assert kept.columns == docs.columns
        kept = sorted(map(tuple, kept.collect()))
        assert [r[:2] for r in kept] == [(1, far), (1, near)] and kept == sorted(map(tuple, keep(docs.repartition(3)).collect()))


def test_long_text_and_a_radius_past_the_keys(spark):
    long = "one two three four five six seven " * 30_000
    docs = spark.createDataFrame([(1, long), (2, long + "more"), (3, "other")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()} == {(1, 1), (2, 1), (3, 3)}
    with pytest.raises(ValueError, match="tau"):
        simhash.chain_keys(8)


def slow_shingles(text, k=5):
    words = text.lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def slow_similar(texts, least=0.8):
    label = list(range(len(texts)))
    sets = [slow_shingles(t or "") for t in texts]
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if label[j] < label[i] and (a == b or len(a & b) >= least * len(a | b)):
                    label[i], changed = label[j], True
    return label


@pytest.mark.parametrize("group", [2048, 5])
def test_pipeline_stage_matches_brute_force_jaccard(spark, monkeypatch, group):
    import corpus_pipeline

    monkeypatch.setattr(simhash, "GROUP", group)
    rng = np.random.default_rng(5)
    rows = []
    for base in range(12):
        text = ["w%d" % i for i in rng.integers(0, 3000, 100)]
        for copy in range(8):
            t = list(text)
            for at in rng.integers(0, 100, copy):
                t[at] = "edit%d" % copy
            rows.append((len(rows), " ".join(t)))
    rows += [(500, None), (501, " "), (502, rows[0][1].upper()), (503, "one two"), (504, "One two")]
    label = slow_similar([t for _, t in rows])
    want = [r[0] for i, r in enumerate(rows) if label[i] == i]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.simhash_near_dedup(spark, docs, "")
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == want
    bits = simhash.keep_first(docs, 5, 4)
    assert bits.count() > len(want)  # one changed word in 100 is past four bits


def test_pipeline_stage_takes_fingerprints_within_four_bits(spark, monkeypatch):
    import corpus_pipeline

    rng = np.random.default_rng(3)
    fps = rng.integers(0, 2**63, 40, dtype=np.uint64)
    for i in range(1, 40, 2):  # every second one is near the one before it, some are equal
        fps[i] = fps[i - 1] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, i % 5, replace=False)))
    classes = spark.createDataFrame([(i, int(f.view(np.int64))) for i, f in enumerate(fps)], "class long, fp long")
    assert sorted({tuple(sorted(r)) for r in simhash.near_prints(classes, 4).collect()}) == [(i, i + 1) for i in range(0, 40, 2)]
    # two texts that are near by their fingerprints and shingles but share no band
    sets = [np.arange(100, dtype=np.uint64), np.arange(1, 101, dtype=np.uint64), np.arange(50, 150, dtype=np.uint64)]
    keys = np.arange(3 * simhash.BANDS).reshape(3, -1)
    assert simhash.similar_forest(sets, keys, np.array([7, 6, 5], dtype=np.uint64), 4, 0.8) == [(0, 1)]
    asked, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda prints, tau: asked.append((prints.count(), tau)) or links(prints, tau))
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f g"), (3, None)], "doc_id long, text string")
    assert corpus_pipeline.simhash_near_dedup(spark, docs, "").count() == 3
    assert asked == [(2, 4)]
