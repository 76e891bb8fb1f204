"""The queries that have SQL against it, on the tables and on fixtures with links in them."""

import duckdb
import numpy as np
import pytest

from tidemark.llm import queries

SF = "/root/testdata/sf0.001"


def same(spark, folder, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet{'' if folder == SF else '/*.parquet'}')")
    got = queries.QUERIES[name](spark, folder)
    names = sorted(got.columns)
    want = con.sql(f"select {', '.join(names)} from ({queries.ORACLES[name]})").fetchall()
    rows = [tuple(r[c] for c in names) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    return rows


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql_on_the_tables(spark, name):
    assert same(spark, SF, name)


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("planted"))
    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 8))
    x = np.concatenate([x, x[:20] + 0.02 * rng.standard_normal((20, 8)), x[:3]]).astype(np.float32).tolist()
    x = [*((i * 5 % 997, v, 0) for i, v in enumerate(x)), (2000, None, 0), (2001, [0.0] * 8, 0), (2002, [float("nan")] * 8, 1), (2003, [None] * 8, 1), (2004, [], 1)]
    spark.createDataFrame(x, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    pages = [(i, f"http://x/{i}", t) for i, t in enumerate(["<p>one</p>", "é", None, "", "<p>one</p>", "z" * 3_000_000, "é", "z" * 3_000_000])]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    docs = [(i, t, "en", "s", 1) for i, t in enumerate([None, "", " ", "a b c " * 9, "Menu\nx", "menu \ny"] * 12)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    roles, said = ["system", "user", "assistant", "tool", "", None, "ursa"], ["Hi.", "Yes!", "cut off", "", " \n", None, "é?", "One. Two", "b" * 400]
    talk = [(int(rng.integers(40)), int(rng.integers(9)), roles[rng.integers(7)], said[rng.integers(9)]) for _ in range(700)]
    talk += [(None, t, "user", f"{t}.") for t in (3, 1, None, None)] + [(50, None, "user", "Hm.")] * 4 + [(c, 0, "user", "x.") for c in range(100, 200)]
    talk += [(60, t, "user" if t % 3 else "assistant", f"{t} is said{'.' * (t % 5 > 0)}") for t in range(700)]
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql_on_planted_rows(spark, planted, name):
    rows = same(spark, planted, name)
    assert len(set(rows)) > 5
