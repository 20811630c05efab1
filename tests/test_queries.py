"""Every registered retrieval query against its SQL on the smallest tables."""

import duckdb
import pytest

from lakesearch import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(frame):
    cells = frame[sorted(frame.columns)].astype(object)
    cells = cells.where(cells.notna(), None).map(lambda v: str(int(v)) if isinstance(v, float) and v == int(v) else str(v))
    return sorted(map(tuple, cells.to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, con, name):
    got = queries.queries()[name](spark, SF).toPandas()
    sql = queries.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_the_entry_works_without_the_corpus_operators():
    import __spark_entry__ as entry

    assert {"L01_search", "B14_split_oversized_block"} <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_written_texts_of_several_chunks_or_with_headings(spark, tmp_path):
    long = "\n".join(f"line {i} " + "word " * 20 for i in range(60))
    marked = "---\na: b\n---\n# One\n\nfirst\n\n## Two\nsecond"
    only_front = "---\na: b"
    texts = [(1, 0, long), (1, 1, marked), (2, 0, only_front), (2, 1, "short\r\ntext "), (3, 0, long), (11, 0, "blank, with an old text"), (13, 0, "# Head\n" + long)]
    rows = [(c, t, "user", x) for c, t, x in texts]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.queries()["L06_store_documents"](spark, str(tmp_path)).toPandas()
    own = duckdb.connect()
    own.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = own.execute(queries.oracle_sql()["L06_store_documents"]).df()
    assert len(got) == 5 and got.text.str.len().max() < 2100 and plain(got) == plain(want)
