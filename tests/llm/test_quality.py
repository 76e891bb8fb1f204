import numpy as np
import pytest

from tidemark.llm import quality

DOCS = "doc_id long, text string, source string, lang string, kept string"
LABELS = "doc_id long, quality int, toxic int"


def corpus(n=600, seed=4):
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{k}" for k in rng.integers(0, 400, 60)]
        low, toxic = i % 5 == 0, i % 7 == 0
        if low:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            words[7] = words[20] = ["vile", "scum"][i % 2]
        rows.append((i, " ".join(words), f"s{i % 3}" if i % 11 else None, "en", "x"))
        labels.append((i, int(not low), int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame([x for x in labels if x[0] % 3], LABELS)
    got = {r.doc_id: r.kept for r in quality.classify(docs, known).collect()}
    held = [(not (q == 1 and not t), not got[i]) for i, q, t in labels if i % 3 == 0]
    assert np.mean([a == b for a, b in held]) > 0.97
    kept = quality.keep_good(docs, known)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}


def test_posteriors_match_brute_force(spark):
    rows, labels = corpus(200)
    rows += [(9000, "never labelled", "new", "xx", "x"), (9001, "never labelled", "s1", "xx", "x")]
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels[:150], LABELS)
    got = quality.classify(docs, known).collect()
    where = {r[0]: (r[2], r[3]) for r in rows}
    bad = {i: int(q == 0 or t == 1) for i, q, t in labels[:150]}
    fold = {r.doc_id: r.fold for r in docs.select("doc_id", quality._fold("doc_id").alias("fold")).collect()}
    rate = np.mean(list(bad.values()))

    def groups(key):
        out = {}
        for i, b in bad.items():
            out.setdefault(key(where[i]), []).append(b)
        return {k: (len(v), sum(v)) for k, v in out.items()}

    def strength(g, mean):
        total = sum(n for n, _ in g.values())
        spread = sum(n * (b / n - mean(k)) ** 2 for k, (n, b) in g.items())
        within = sum(mean(k) * (1 - mean(k)) for k in g)
        weighted = sum(n * mean(k) * (1 - mean(k)) for k, (n, _) in g.items())
        return min(1e6, max(1.0, weighted / total / max(1e-9, (spread - within) / total) - 1))

    hosts, paths = groups(lambda w: w[0]), groups(lambda w: w)
    sh = strength(hosts, lambda k: rate)
    sp = strength(paths, lambda k: (hosts[k[0]][1] + rate * sh) / (hosts[k[0]][0] + sh))
    assert len(got) == 202
    for r in got:
        i, w = r.doc_id, where[r.doc_id]
        others = {k: b for k, b in bad.items() if fold[k] != fold[i]}
        in_host = [b for k, b in others.items() if where[k][0] == w[0]]
        in_path = [b for k, b in others.items() if where[k] == w]
        host = (sum(in_host) + rate * sh) / (len(in_host) + sh)
        path = (sum(in_path) + host * sp) / (len(in_path) + sp)
        assert r.host_rate == pytest.approx(host) and r.path_rate == pytest.approx(path)
        shift = np.log(path / (1 - path)) - np.log(rate / (1 - rate))
        p = 1 / (1 + np.exp(-(max(r.low_odds, r.toxic_odds) + shift)))
        assert r.bad_probability == pytest.approx(p) and r.kept == (p <= 0.5)


def test_sites_change_verdicts_for_the_better(spark):
    """Weak evidence in the text, strong in the host: held-out labels are met more often with both."""
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(1500):
        host = i % 10
        low = rng.random() < (0.9 if host < 3 else 0.05)
        words = [f"w{k}" for k in rng.integers(0, 50, 20)] + ["doubt"] * (rng.random() < (0.7 if low else 0.3))
        rows.append((i, " ".join(words), f"h{host}", "en", "x"))
        labels.append((i, int(not low), 0))
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels[:1000], LABELS)
    got = {r.doc_id: r for r in quality.classify(docs, known).collect()}
    held = [(got[i], q == 1) for i, q, _ in labels[1000:]]
    alone = np.mean([(r.low_odds <= 0) == good for r, good in held])
    both = np.mean([r.kept == good for r, good in held])
    assert both > 0.9 and both > alone + 0.05


def test_edges(spark):
    none = spark.createDataFrame([], LABELS)
    rows = [(1, None, None, None, ""), (1, "", "a", None, ""), (None, "x " * 100_000, "a", "en", "")]
    got = quality.classify(spark.createDataFrame(rows, DOCS), none).collect()
    assert len(got) == 3 and all(r.kept for r in got)
    assert quality.keep_good(spark.createDataFrame(rows, DOCS), none).count() == 3
    assert quality.classify(spark.createDataFrame([], DOCS), none).count() == 0


def test_rows_with_one_id_are_judged_apart(spark):
    rows, labels = corpus()
    clean, toxic = "calm words w1 w2 w3 w4 w5 w6 w7 w8 w9 w10", "vile scum vile w1 w2 w3 w4 w5 w6 w7 w8 w9"
    more = [(i, t, "s0", "en", "x") for i in (None, 9001) for t in (clean, toxic)]
    docs, known = spark.createDataFrame(rows + more, DOCS), spark.createDataFrame(labels, LABELS)
    kept = quality.keep_good(docs, known).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept if r.doc_id in (None, 9001)) == [("9001", clean), ("None", clean)]


def test_word_of_few_toxic_texts_counts(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join([f"w{k}" for k in rng.integers(0, 300, 30)] + ["vile"] * (i % 20 == 0)), "s", "en", "x") for i in range(400)]
    labels = [(i, 1, int(i % 20 == 0)) for i in range(200)]
    got = quality.classify(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    held = {r.doc_id: r.toxic_odds for r in got if r.doc_id >= 200}
    assert all((odds > 0) == (i % 20 == 0) for i, odds in held.items())


def test_held_out_toxic_documents_of_the_labelled_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}
    got = {r.doc_id: r.kept for r in quality.classify(docs, labels.where("doc_id % 5 < 3")).collect() if r.doc_id % 5 >= 3}
    toxic = [not k for i, k in got.items() if i in known and known[i][1] == 1]
    clean = [k for i, k in got.items() if known.get(i) == (1, 0)]
    assert np.mean(toxic) > 0.6 and np.mean(clean) > 0.97


def test_repeated_rows_of_a_labelled_id_count_once(spark):
    texts = [(i, f"good words {i}" if i % 2 else f"bad trash {i}") for i in range(200)]
    docs = spark.createDataFrame(texts + [(0, "bad trash 0")] * 10_000, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    once = quality.fit(docs.dropDuplicates(), labels)
    assert (once == quality.fit(docs, labels)).all() and once.any()
