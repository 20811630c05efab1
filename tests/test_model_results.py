"""Models are asked once for each content."""

import uuid

import pytest

from lakesearch import plans
from lakesearch.operators.results import ModelResults, embed_once


def noted(folder, answer):
    """A model that leaves a file for each thing that it is asked."""

    def asked(*given):
        (folder / uuid.uuid4().hex).write_text("|".join(given))
        return answer(*given)

    return asked


def heard(folder):
    out = sorted(f.read_text() for f in folder.iterdir())
    for f in folder.iterdir():
        f.unlink()
    return out


def vectors_of(note):
    def embed(texts):
        for t in texts:
            note(t)
        return [[len(t), 1] for t in texts]

    return embed


def index(spark, docs, folders, results, contextualizer=None):
    rows = spark.createDataFrame(docs, "doc_id long, rel_path string, title string, text string")
    chunks, vectors = plans.index_documents(rows, vectors_of(noted(folders[0], lambda t: None)), 2, contextualizer, embeddings=results[0], contexts=results[1])
    return {(r.doc_id, r.text): (r.context, r.embedding[0]) for r in chunks.join(vectors, "chunk_id").collect()}


@pytest.fixture
def places(tmp_path):
    folders = [tmp_path / "embedded", tmp_path / "contexts"]
    for f in folders:
        f.mkdir()
    results = ModelResults(str(tmp_path / "v"), "model 1", "array<float>"), ModelResults(str(tmp_path / "c"), "model 2", "string")
    return folders, results


def sections(*texts):
    return "\n".join(f"# S{i}\n{t}" for i, t in enumerate(texts))


def test_an_edit_embeds_only_its_chunks(spark, places):
    folders, results = places
    docs = [(1, "a.md", "A", sections("one", "two", "three")), (2, "b.md", "B", sections("one", "two", "three")), (3, "c.md", "C", sections("alone"))]
    first = index(spark, docs, folders, results)
    assert len(first) == 7 and len(heard(folders[0])) == 4  # equal texts below equal headings are asked once
    docs[0] = (1, "a.md", "A", sections("one", "changed", "three"))
    second = index(spark, docs, folders, results)
    assert [t for t in heard(folders[0]) if "changed" not in t] == [] and len(second) == 7
    assert {v for k, v in second.items() if "changed" not in k[1]} <= set(first.values())
    assert index(spark, docs, folders, results) == second and heard(folders[0]) == []
    assert second == index(spark, docs, folders, (None, None))


def test_contexts_of_unchanged_documents_stay(spark, places):
    folders, results = places
    answer = noted(folders[1], lambda title, document, chunk: f"{title}: {len(document)}")
    docs = [(1, "a.md", "A", sections("one", "two")), (2, "b.md", "B", sections("alone"))]
    first = index(spark, docs, folders, results, answer)
    assert len(heard(folders[1])) == 2 and sorted(c for c, _ in first.values()) == ["", "A: 17", "A: 17"]
    docs += [(3, "c.md", "A", docs[0][3]), (4, "d.md", "D", sections("one", "two"))]
    second = index(spark, docs, folders, results, answer)
    assert all(t.startswith("D|") for t in heard(folders[1])) and sum(c == "A: 17" for c, _ in second.values()) == 4
    assert second == index(spark, docs, folders, (None, None), answer)


def test_edge_cases_and_failures(spark, places):
    folders, (results, _) = places
    note = vectors_of(noted(folders[0], lambda t: None))
    rows = lambda *xs: spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "id long, text string")
    assert embed_once(rows(), note, 2, results, "text").count() == 0
    got = embed_once(rows(None, "", "same", "same", "x" * 100_000), note, 2, results, "text")
    assert sorted((r.id, r.embedding[0]) for r in got.collect()) == [(0, 0), (1, 0), (2, 4), (3, 4), (4, 100_000)]
    assert len(heard(folders[0])) == 4

    def broken(texts):
        raise ValueError("no model")

    with pytest.raises(Exception, match="no model"):
        embed_once(rows("same", "new"), broken, 2, results, "text").count()
    embed_once(rows("same", "new"), note, 2, results, "text").count()
    assert heard(folders[0]) == ["new"]
    other = ModelResults(results.path, "model 3", results.kind)
    embed_once(rows("new"), note, 2, other, "text").count()
    assert heard(folders[0]) == ["new"]
