"""The pipeline and the registered queries on the smallest tables, against plain Python."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_dedup import brute_force, unions  # noqa: E402

from lakesearch.llm import mixing, near_copies, queries, toxicity  # noqa: E402
from lakesearch.llm.store import written  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(written(stage(spark, seen[-1], SF), name))
    rows = [{r.doc_id: r for r in d.collect()} for d in seen]
    assert all(d.columns == COLUMNS for d in seen[:-1])
    # toxicity: the same model scored in plain Python
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter(~queries.held_out())
    model = toxicity.train(docs, labels)
    ids = sorted(rows[0])
    scores = dict(zip(ids, model.score([rows[0][i].text for i in ids])))
    assert set(rows[1]) == {i for i in ids if scores[i] < 0.5}
    # near copies: all pairs of five-word shingle sets
    ids = sorted(rows[1])
    sets = [near_copies.shingles(rows[1][i].text.encode()) for i in ids]
    root = unions(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if near_copies.jaccard(sets[i], sets[j]) >= 0.8])
    assert set(rows[2]) == {ids[r] for r in root}
    # repeated passages
    want = {i: kept for i, _, _, kept in brute_force([(i, rows[2][i].text) for i in rows[2]])}
    assert {i: " ".join(r.text.split()) for i, r in rows[3].items()} == want
    assert all(r.n_chars == len(r.text) for r in rows[3].values())
    # benchmark items: documents that hold one whole are gone
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    whole = {i for i, r in rows[3].items() if any(x in r.text for x in items)}
    assert whole and not whole & set(rows[4]) and len(rows[3]) - len(rows[4]) <= 2 * len(whole) + 2
    # the mix takes some of each source
    assert set(rows[5]) <= set(rows[4]) and all(r.taken == r.copies * r.size and 1 <= r.copies <= mixing.MOST for r in rows[5].values())
    assert sorted((r.doc_id, r.copies) for r in corpus_pipeline.run(spark, SF).collect()) == sorted((i, r.copies) for i, r in rows[5].items())


def test_stages_on_odd_documents(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, "en", "a", 1), (2, text, "en", "a", 1), (None, None, None, None, None), (3, "", "en", None, 0), (3, "", "en", None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    out, empty = docs, docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out, empty = written(stage(spark, out, SF), name), written(stage(spark, empty, SF), name)
        assert empty.count() == 0
    assert {r.doc_id for r in out.collect()} <= {1}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_return_one_row_each(spark, name):
    got = queries.queries()[name](spark, SF)
    n = {t: spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("documents", "pages")}
    chats = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count() + 1
    want = {"op8_html_extraction": n["pages"], "op9_chat_formatting": chats, "op13_structure_repair": chats - 1}.get(name, n["documents"])
    rows = got.count()
    assert rows == want or name.startswith(("op6", "op11"))  # pairs, nodes
    assert name != "op11_prefix_trie" or rows >= chats // 2
