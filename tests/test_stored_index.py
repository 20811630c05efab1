"""Segments of a stored index, what a search reads of them, failures of single documents, and batches that come twice."""

import time

import numpy as np
import pytest
from conftest import stand_in_embedder
from pyspark.sql import functions as F

from lakesearch import plans
from lakesearch.operators import extract, keyword, ranking
from lakesearch.streaming import Ledger, poll_source

LISTING = "source_name string, rel_path string, size_bytes long, mtime long, content_sha256 string"
WORDS = "fox dog cat owl bee ant elk".split()


def text_of(i, version=0):
    return " ".join(WORDS[(i * k + version) % 7] for k in range(1, 3 + i % 5))


def contents(spark, texts):
    rows = spark.createDataFrame([("s", p, t) for p, t in texts.items()], "source_name string, rel_path string, text string")
    return lambda keys: rows.join(keys, ["source_name", "rel_path"], "left_semi")


def listing(spark, texts):
    return spark.createDataFrame([("s", p, None, None, str(hash(t))) for p, t in texts.items()], LISTING)


def hits(spark, i):
    queries = spark.createDataFrame(list(enumerate(["fox", "dog cat", "bee bee owl", "none"])), "query_id long, query string")
    rows = keyword.bm25(queries, i.postings, i.lengths, i.stats, i.terms).join(i.chunks, "chunk_id").join(i.docs, "doc_id")
    return sorted((r.query_id, r.rel_path, round(r.bm25, 9)) for r in rows.collect())


def test_an_updated_index_is_as_one_built_anew(spark, tmp_path):
    embed, calls = stand_in_embedder(8), spark.sparkContext.accumulator(0)

    def counted(texts):
        calls.add(len(texts))
        return embed(texts)

    first = {f"{i}.txt": text_of(i) for i in range(20)}
    second = {p: (text_of(int(p[:-4]), 3) if int(p[:-4]) % 4 == 0 else t) for p, t in first.items() if p != "7.txt"} | {"new.txt": "fox fox dog"}
    third = {p: t for p, t in second.items() if p not in ("4.txt", "new.txt")} | {"7.txt": "owl again"}
    base, _ = plans.rebuild(listing(spark, first), plans.Base(*empty(spark)), contents(spark, first), embed, 8)
    index, manifest = plans.Index(base.docs, base.chunks, base.vectors).write(str(tmp_path / "i")), base.manifest
    for texts, changed in ((second, 6), (third, 1)):
        before = calls.value
        index, manifest, summary = plans.sync_index(listing(spark, texts), index, manifest.cache(), contents(spark, texts), counted, 8)
        assert calls.value - before == changed  # only what changed goes to the model, once
        anew, _ = plans.rebuild(listing(spark, texts), plans.Base(*empty(spark)), contents(spark, texts), embed, 8)
        fresh = plans.Index(anew.docs, anew.chunks, anew.vectors)
        assert hits(spark, index) == hits(spark, fresh) != []
        assert sorted(index.terms.groupBy("term").agg(F.sum("df").alias("n")).filter("n > 0").collect()) == sorted(keyword.term_counts(fresh.postings).collect())
        assert index.vectors.count() == fresh.vectors.count() and index.stats.first() == keyword.corpus_stats(fresh.lengths).first()
    merged = index.merged()
    assert hits(spark, merged) == hits(spark, fresh) and len(plans.index._segments(spark, index.path)) == 1
    gone = merged.docs.filter("rel_path = '1.txt'").select("doc_id")
    nothing = merged.docs.limit(0), merged.chunks.limit(0), merged.vectors.limit(0)
    assert merged.updated(gone, *nothing, tag="stream-0").docs.count() == len(third) - 1
    again = merged.updated(merged.docs.select("doc_id"), *nothing, tag="stream-0")  # a batch that comes again
    assert again.docs.count() == len(third) - 1


def empty(spark):
    made = plans.index_documents(spark.createDataFrame([], "doc_id string, rel_path string, title string, text string"), stand_in_embedder(8), 8)
    return spark.createDataFrame([], "source_name string, rel_path string, doc_id string, title string"), *made, spark.createDataFrame([], LISTING)


def scanned(spark, run):
    """Rows that the scans of ``run()`` gave."""
    store = spark._jsparkSession.sharedState().statusStore()
    known = store.executionsCount()
    run()
    time.sleep(1)
    total = 0
    for n in range(known, store.executionsCount()):
        e = store.executionsList(n, 1).head()
        values = store.executionMetrics(e.executionId())
        nodes = store.planGraph(e.executionId()).allNodes()
        for k in range(nodes.size()):
            if nodes.apply(k).name().startswith("Scan parquet"):
                metrics = nodes.apply(k).metrics()
                for m in range(metrics.size()):
                    if metrics.apply(m).name() == "number of output rows":
                        found = values.get(metrics.apply(m).accumulatorId())
                        total += int(found.get().replace(",", "")) if found.isDefined() else 0
    return total


def test_few_rows_are_read_for_many_terms(spark, tmp_path):
    n = 400_000
    rows = spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("term"), "id").select("term", F.col("id").alias("chunk_id"), F.lit(1).cast("long").alias("freq"), F.array(F.lit(0).cast("long")).alias("places"))
    keyword.store(rows, str(tmp_path / "p"), 40_000_000)
    index = keyword.stored(spark, str(tmp_path / "p"), "long")
    asked = rows.filter(f"chunk_id % {n // 200} = 0").select("term").cache()
    assert asked.count() == 200
    phrases = asked.select(F.monotonically_increasing_id().alias("query_id"), F.lit(0).alias("phrase_no"), F.lit(1).alias("n_terms"), F.lit(0).alias("token_no"), "term")
    found = []
    read = scanned(spark, lambda: found.append(keyword.asked_terms(phrases, index).count()))
    assert found == [200] and 200 <= read < 0.15 * n  # some 200 pages of 256 rows


def test_neighbours_stay_within_groups_and_blocks(spark):
    rng = np.random.default_rng(5)
    v = [(i, [float(x) for x in rng.normal(size=6)], f"g{i % 3}") for i in range(300)]
    q = [(i, [float(x) for x in rng.normal(size=6)], f"g{i % 4}") for i in range(40)]
    vectors = ranking.read_embeddings(spark.createDataFrame([x[:2] for x in v], "chunk_id long, embedding array<float>"), 6).join(spark.createDataFrame([(x[0], x[2]) for x in v], "chunk_id long, kb string"), "chunk_id")
    queries = spark.createDataFrame(q, "query_id long, query_vec array<float>, kb string")
    x = {i: np.float32(e).astype(float) for i, e, _ in v}
    want = set()
    for i, e, g in q:
        e = np.float32(e).astype(float)
        score = lambda j: round(float(e @ x[j] / np.linalg.norm(e) / np.linalg.norm(x[j])), 9)  # noqa: B023, E731
        best = sorted((j for j, _, h in v if h == g), key=lambda j: (-score(j), j))[:5]
        want |= {(i, j, r) for r, j in enumerate(best, 1)}
    for block, part in ((4096, 16384), (7, 11)):
        got = ranking.knn_cosine(queries, vectors, 5, block, part, by="kb").collect()
        assert {(r.query_id, r.chunk_id, r.vec_rank) for r in got} == want


def test_any_number_of_filters_and_knowledge_bases(spark):
    n = 150
    docs = spark.createDataFrame([(i, "s", f"{i}.md", {"k": str(i), "all": "x"} if i else None, f"kb{i % 75:02d}") for i in range(n)], "doc_id long, source_name string, rel_path string, metadata map<string,string>, kb string")
    chunks = spark.createDataFrame([(i, i, "common words") for i in range(n)], "chunk_id long, doc_id long, text string")
    vectors = ranking.read_embeddings(spark.createDataFrame([(i, [1.0, float(i)]) for i in range(n)], "chunk_id long, embedding array<float>"), 2)
    asked = spark.createDataFrame([(i, "common", [1.0, 0.0], {"k": str(i)} if i else {"k": ""}) for i in range(n)], "query_id long, query string, query_vec array<float>, filter map<string,string>")
    found = plans.search(asked, plans.Index(docs.drop("kb"), chunks, vectors), prefilter=True).collect()
    assert {(r.query_id, r.doc_id) for r in found} == {(i, i) for i in range(n)}
    both = plans.search_all(asked.filter("query_id < 2").drop("filter").withColumn("limit", F.lit(200)), plans.Index(docs, chunks, vectors)).collect()
    assert len(both) == 2 * n and {r.kb for r in both if r.query_id == 1} == {f"kb{i:02d}" for i in range(75)}
    one = plans.search_all(asked.filter("query_id = 5"), plans.Index(docs, chunks, vectors), prefilter=True).collect()
    assert [(r.kb, r.doc_id) for r in one] == [("kb05", 5)]
    with pytest.raises(ValueError, match="kb"):
        plans.search(asked, plans.Index(docs, chunks, vectors))


def test_bad_documents_fail_alone(spark, monkeypatch):
    monkeypatch.setattr(extract.has_overlong_line, "__defaults__", (100,))
    texts = {f"{i}.txt": text_of(i) for i in range(6)}
    base, _ = plans.rebuild(listing(spark, texts), plans.Base(*empty(spark)), contents(spark, texts), stand_in_embedder(8), 8)
    now = texts | {"0.txt": "x" * 101, "1.txt": None, "2.txt": "changed", "3.txt": "gone while reading", "9.txt": "y" * 200, "8.txt": "short lines\n" * 20}
    listed = listing(spark, now)

    def read(keys):
        got = contents(spark, now)(keys).filter("rel_path <> '3.txt'")
        return got.withColumn("error", F.when(F.col("rel_path") == "4.txt", "refused"))

    after, summary = plans.sync_source(listed, base, read, stand_in_embedder(8), 8)
    assert tuple(summary.first()) == ("s", 2, 0, 2, 4)
    stored = {r.rel_path: r.text for r in after.docs.join(after.chunks, "doc_id").collect()}
    assert stored["0.txt"] == texts["0.txt"] and stored["1.txt"] == texts["1.txt"] and stored["2.txt"] == "changed" and "9.txt" not in stored and stored["8.txt"].startswith("short lines")
    manifest = {r.rel_path: r.content_sha256 for r in after.manifest.collect()}
    assert manifest["0.txt"] == str(hash(texts["0.txt"])) and "9.txt" not in manifest


def test_each_chunk_gets_its_context_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def context(title, document, chunk):
        seen.add(1)
        return f"{title}:{len(chunk)}"

    docs = spark.createDataFrame([(str(i), f"{i}.md", f"t{i}", "\n".join(f"# H{k}\n\nsome words here" for k in range(5))) for i in range(4)], "doc_id string, rel_path string, title string, text string")
    chunks, vectors = plans.index_documents(docs, stand_in_embedder(4), 4, context)
    assert chunks.count() == vectors.count() == 20 and seen.value == 20


def test_polling_waits_for_whole_listings(spark, tmp_path):
    ledger, root = Ledger(spark, str(tmp_path / "ledger")), str(tmp_path / "listings")
    manifest = spark.createDataFrame([("s", p, 1, 1, p) for p in "abcd"], LISTING)
    schema = f"{LISTING}, listing long, total long"
    applied, errors, fail = [], [], [True]

    def apply(diff, n):
        if n == 3 and fail.pop():
            raise OSError("store")
        applied.append((n, {r.rel_path: r.action for r in diff.collect()}))

    def batch(rows):
        spark.createDataFrame([("s" if p else None, p, 1, 1, p, n, total) for p, n, total in rows], schema).coalesce(1).write.mode("append").parquet(root)
        poll_source(spark.readStream.schema(schema).parquet(root), lambda: manifest, apply, ledger, str(tmp_path / "points"), errors.append).awaitTermination()

    for rows in ([("a", 1, 3)], [("b", 1, 3)]):
        batch(rows)
    assert applied == []
    batch([("x", 1, 3), ("a", 2, 2)])
    assert applied == [(1, {"a": "skip", "b": "skip", "x": "index", "c": "delete", "d": "delete"})]
    batch([("b", 2, 2), (None, 3, 0)])  # an empty listing after a whole one; it fails
    assert len(applied) == 1 and len(errors) == 1
    fail.append(False)
    batch([("b", 2, 2)])
    assert applied[1:] == [(3, dict.fromkeys("abcd", "delete"))]


def test_fences_of_long_documents(spark):
    rng = np.random.default_rng(1)
    docs = []
    for i in range(6):
        docs += [(str(i), n, line) for n, line in enumerate(rng.choice(["```", "~~~", "  ```py", "text", "# head"], 3000 if i else 1).tolist(), 1)]
    got = {(r.doc_id, r.line_no): r.fenced for r in extract.mark_fences(spark.createDataFrame(docs, "doc_id string, line_no int, line string")).collect()}
    open_, doc = "", None
    for d, n, line in docs:
        open_ = open_ if d == doc else ""
        doc, mark = d, line.strip()[:3]
        inside = open_ != ""
        if mark in ("```", "~~~"):
            open_ = mark if not open_ else "" if open_ == mark else open_
        assert got[d, n] == (inside or mark in ("```", "~~~"))

    def seconds(groups):
        lines = spark.createDataFrame([("d", "```\ncode\n```\ntext\n" * groups)], "doc_id string, text string")
        began = time.perf_counter()
        extract.mark_fences(extract.explode_lines(lines)).agg(F.count_if("fenced")).collect()
        return time.perf_counter() - began

    seconds(100)
    assert seconds(32_000) < 8 * max(seconds(8_000), 0.5)
