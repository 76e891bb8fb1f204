from collections import Counter

import corpus_pipeline
from tidemark.llm import mixing, pieces, queries
from tidemark.llm.linededup import line_key
from tests.llm.test_simhash import slow_similar

SF = "/root/testdata/sf0.001"


def test_every_stage_against_brute_force(spark):
    docs = queries.table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = queries.materialize(stage(spark, docs, SF), "test")
        after = out.collect()
        if name != "sentencepiece_encode":
            assert out.columns == columns
        if name == "quality_classifier":
            labels = {r.doc_id: (r.quality, r.toxic) for r in queries.table(spark, SF, "labels").collect()}
            kept = {r.doc_id for r in after}
            good = {i for i, x in labels.items() if x == (1, 0)}
            assert len(good & kept) > 0.9 * len(good) and all(before[r.doc_id] == r for r in after)
        if name == "line_dedup":
            keys = Counter(k for r in before.values() for k in {line_key(x.encode()) for x in (r.text or "").split("\n")})
            for r in after:
                lines = (before[r.doc_id].text or "").split("\n")
                want = [x for x in lines if not line_key(x.encode()) or keys[line_key(x.encode())] < 10]
                assert r.text == "\n".join(want) and r.n_chars == len(r.text)
        if name == "simhash_near_dedup":
            ids = sorted(before)
            label = slow_similar([before[i].text for i in ids])
            assert sorted(r.doc_id for r in after) == [i for n, i in enumerate(ids) if label[n] == n]
            assert all(before[r.doc_id] == r for r in after)
        if name == "mix_sources":
            copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
            assert Counter(r.doc_id for r in after) == {i: n for i, n in copies.items() if n}
        if name == "sentencepiece_encode":
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())
            assert len(after) == docs.count() and all(r.ids == sp.encode(before[r.doc_id].text) for r in after)
            back = pieces.decode(out, pieces.Vocabulary.load(queries.tokenizer_path())).collect()
            assert all(r.text == before[r.doc_id].text for r in back)
        docs = out


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "ids"]


CLASHING = "low long, toxic long, kept long, row long, own long, n_lines long, n_dropped long, size long, draw long, copies long, h long, class long, component long, key long, batch long, __h long, __d long, __row long, __of long, __gone long, __draw long, __i long"


def odd_rows():
    prose = [" ".join(f"w{(7 * i + k * k) % 5000}" for k in range(80)) for i in range(40)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(prose)]
    rows += [(None, None, None, None, None), (None, None, None, None, None), (50, "", "en", None, 0), (51, " \n\t", "en", "s1", 3), (52, "few words", "de", "s0", 9)]
    rows += [(None, prose[1] + " end", "en", "s1", 1), (3, prose[3], "en", "s0", len(prose[3])), (3, prose[4] + " other", "en", "s0", 1), (60, "long text here " * 70_000, "fr", "s2", 1)]
    return rows


def test_stages_on_odd_rows(spark, tmp_path):
    rows = [(*r, *range(CLASHING.count(",") + 1)) for r in odd_rows()]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}").repartition(3)
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    empty.write.parquet(f"{tmp_path}/labels.parquet")
    run = dict(corpus_pipeline.STAGES)
    key = lambda r: repr((r.doc_id, r.text))
    kept = run["quality_classifier"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=repr) == sorted(rows, key=repr)
    lines = run["line_dedup"](spark, docs, str(tmp_path))
    assert lines.columns == docs.columns
    assert sorted(((r.doc_id, r.text, *tuple(r)[5:]) for r in lines.collect()), key=repr) == sorted(((r[0], r[1] or "", *r[5:]) for r in rows), key=repr)
    first = run["simhash_near_dedup"](spark, docs, str(tmp_path))
    got = sorted(first.collect(), key=key)
    assert first.columns == docs.columns
    gone = [(None, rows[1][1] + " end"), (4, rows[4][1]), (51, " \n\t"), (None, None)]
    want = [r for n, r in enumerate(rows) if r[:2] not in gone and r not in rows[:n]]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    mixed = run["mix_sources"](spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns and {tuple(r) for r in mixed.collect()} <= set(rows)
    assert all((r.text or "").split() for r in mixed.collect())
    ids = run["sentencepiece_encode"](spark, docs, str(tmp_path)).collect()
    assert len(ids) == len(rows) and sum(r.ids is None for r in ids) == 2 and sum(r.ids == [] for r in ids) == 1
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
