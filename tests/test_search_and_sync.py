"""Search, reranking, sync, evaluation, catalog and streams on small inputs written by hand."""

import datetime as dt
import json
import math

import pytest
from conftest import stand_in_embedder
from pyspark.sql import functions as F

from lakesearch import plans
from lakesearch.operators import chunking, evaluate, keyword, ranking, sync
from lakesearch.sources import golden_queries, list_files, read_content, safe_path
from lakesearch.streaming import EVENTS, debounce_paths, initial_then_live, managed_write_stream, resync_on_fire, watch_event_counts, watch_source


def make_index(spark):
    chunks = spark.createDataFrame([(1, 1, "the quick fox", "Animals", "ctxmarker"), (2, 1, "lazy dog sleeps", "Animals", ""), (3, 2, "quick quick brown.fox", "", ""), (4, 3, "nothing here", "", "")], "chunk_id long, doc_id long, text string, heading_path string, context string")
    docs = spark.createDataFrame([(1, "a", "x.md", {"k": "v"}), (2, "a", "y.md", None), (3, "b", "z.md", {"k": "w"})], "doc_id long, source_name string, rel_path string, metadata map<string,string>")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8]), (4, [0.0, 0.0])], "chunk_id long, embedding array<float>")
    return plans.Index(docs, chunks, ranking.read_embeddings(vectors, 2))


def test_bm25_by_hand(spark):
    i = make_index(spark)
    queries = spark.createDataFrame([(1, "quick quick"), (2, "brown.fox"), (3, "ctxmarker"), (4, "...")], "query_id long, query string")
    got = {(r.query_id, r.chunk_id): r.bm25 for r in keyword.bm25(queries, i.postings, i.lengths).collect()}
    lengths = {1: 5, 2: 4, 3: 4, 4: 2}
    avg = sum(lengths.values()) / 4
    weight = lambda n, f, c: max(1e-6, math.log((4 - n + 0.5) / (n + 0.5))) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * lengths[c] / avg))
    assert got[1, 1] == pytest.approx(2 * weight(2, 1, 1)) and got[1, 3] == pytest.approx(2 * weight(2, 2, 3))
    assert {k: v for k, v in got.items() if k[0] == 2} == {(2, 3): pytest.approx(weight(1, 1, 3))}
    assert (3, 1) in got and not any(q == 4 for q, _ in got)


def test_knn(spark):
    i = make_index(spark)
    queries = spark.createDataFrame([(1, [1.0, 1.0]), (2, [0.0, 0.0]), (3, None)], "query_id long, query_vec array<float>")
    got = ranking.knn_cosine(queries, i.vectors, 2).orderBy("vec_rank").collect()
    assert [(r.query_id, r.chunk_id) for r in got] == [(1, 3), (1, 1)] and got[0].cosine == pytest.approx(1.4 / math.sqrt(2))
    many = spark.range(1, 40).select(F.col("id").alias("query_id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("query_vec"))
    assert sorted(map(tuple, ranking.knn_cosine(many, i.vectors, 2, block=8).collect())) == sorted(map(tuple, ranking.knn_cosine(many, i.vectors, 2).collect()))
    with pytest.raises(Exception, match="wrong dimension"):
        ranking.read_embeddings(i.vectors.select("chunk_id", "embedding"), 3).collect()


def test_search_options(spark):
    i = make_index(spark)
    asked = spark.createDataFrame([(1, "quick", [1.0, 0.0], None, 0.0, 1), (2, "quick", [1.0, 0.0], {"k": "v"}, 0.0, 2), (3, "quick", [1.0, 0.0], {"k": ""}, 0.0, 2), (4, "quick", [1.0, 0.0], None, 0.995, -1)], "query_id long, query string, query_vec array<float>, filter map<string,string>, min_score double, max_per_doc int")
    hits = plans.search(asked, i).orderBy("query_id", "rank").collect()
    got = {q: [r.chunk_id for r in hits if r.query_id == q] for q in range(1, 5)}
    # chunks 1 and 3 are first in one leg and second in the other; nothing is first in both
    assert got == {1: [1, 3], 2: [1, 2], 3: [3], 4: []}
    assert all(0 < r.relevance <= 1 for r in hits)
    two = plans.Index(i.docs.withColumn("kb", F.when(F.col("doc_id") == 1, "b").otherwise("a")), i.chunks, i.vectors)
    both = plans.search_all(asked.filter("query_id = 1"), two).orderBy("merged_rank").collect()
    # ranks begin anew in each knowledge base
    assert {(r.kb, r.rank) for r in both} >= {("a", 1), ("b", 1)} and all((r.kb == "b") == (r.doc_id == 1) for r in both) and {r.query_id for r in both} == {1}


def test_cap(spark):
    hits = spark.createDataFrame([(1, d, r, 2) for r, d in enumerate([1, 1, 1, 2, 1, 3], 1)], "query_id int, doc_id int, rank int, max_per_doc int")
    assert [r.doc_id for r in ranking.cap_per_document(hits).orderBy("rank").collect()] == [1, 1, 2, 3]
    assert ranking.cap_per_document(hits.withColumn("max_per_doc", F.lit(-1))).count() == 6


def test_rerank(spark):
    hits = spark.createDataFrame([(q, c, c, "q", t, 0.01 * (9 - c)) for q in (1, 2) for c, t in ((1, "-4.0"), (2, "6.0"))] + [(3, c, c, "q", t, 0.02) for c, t in ((1, "0.999"), (2, "0.0"))], "query_id int, chunk_id int, rank int, query string, text string, rrf double")
    got = {(r.query_id, r.chunk_id): (r.rank, r.relevance) for r in ranking.rerank(hits.filter("query_id <> 2"), lambda q, t: [float(x) for x in t]).collect()}
    assert got[1, 2] == (1, pytest.approx(1 / (1 + math.exp(-6)))) and got[1, 1][0] == 2
    assert got[3, 1] == (1, 0.999) and got[3, 2] == (2, 0.0)

    def broken(q, t):
        raise OSError("endpoint")

    kept = ranking.rerank(hits.filter("query_id = 2"), broken).orderBy("rank").collect()
    assert [(r.chunk_id, r.rank) for r in kept] == [(1, 1), (2, 2)] and kept[0].relevance == pytest.approx(0.08 * 61 / 2 if 0.08 * 61 / 2 < 1 else 1)


LISTING = "source_name string, rel_path string, size_bytes long, mtime long, content_sha256 string"


def test_sync_actions(spark):
    listing = spark.createDataFrame([("s", "same", 1, 1, "a"), ("s", "touched", 1, 2, "a"), ("s", "edited", 2, 2, "b"), ("s", "new", 1, 1, "c"), ("s", "sneaky", 1, 1, "z")], LISTING)
    manifest = spark.createDataFrame([("s", "same", 1, 1, "a"), ("s", "touched", 1, 1, "a"), ("s", "edited", 1, 1, "a"), ("s", "gone", 1, 1, "d"), ("s", "sneaky", 1, 1, "y")], LISTING)
    diff = sync.manifest_diff(listing, manifest)
    assert {r.rel_path: r.action for r in diff.collect()} == {"same": "skip", "touched": "touch", "edited": "index", "new": "index", "gone": "delete", "sneaky": "skip"}
    assert {r.rel_path: r.action for r in sync.manifest_diff(listing, manifest, verify=True).collect()}["sneaky"] == "index"
    assert tuple(sync.sync_summary(diff, spark.createDataFrame([("s", "new")], "source_name string, rel_path string")).first()) == ("s", 1, 1, 3, 1)
    after = {r.rel_path: r.content_sha256 for r in sync.next_manifest(manifest, diff).collect()}
    assert after == {"same": "a", "touched": "a", "edited": "b", "new": "c", "sneaky": "y"}
    none = spark.createDataFrame([], "chunk_id long")
    assert sync.read_manifest(manifest, none).count() == 0 and sync.read_manifest(manifest, spark.range(3)).count() == 5
    dirty = spark.createDataFrame([("s", "same"), ("s", "edited"), ("s", "gone"), ("s", "nowhere"), ("s", "same")], "source_name string, rel_path string")
    assert {r.rel_path: r.action for r in sync.sync_paths(dirty, listing, manifest).collect()} == {"same": "touch", "edited": "index", "gone": "delete", "nowhere": "ignore"}


def test_identity_and_counts(spark):
    empty = spark.createDataFrame([], "embedding_model string, embedding_dimensions int")
    meta = sync.check_identity(empty, "m", 8)
    assert tuple(meta.first()) == ("m", 8) and tuple(sync.check_identity(meta, "m", 8).first()) == ("m", 8)
    with pytest.raises(Exception, match="index was built with m"):
        sync.check_identity(meta, "other", 8).collect()
    chunks = spark.createDataFrame([(1,), (1,), (2,)], "doc_id int")
    assert [tuple(r) for r in sync.check_counts(chunks, chunks.limit(1)).orderBy("doc_id").collect()] != []
    assert sync.check_counts(chunks, chunks).count() == 0


def test_evaluation(spark):
    golden = spark.createDataFrame([(1, "q1", ["b"]), (2, "q2", ["zz", ""]), (3, "q3", ["d"])], "query_id int, query string, expect array<string>")
    hits = spark.createDataFrame([(q, r, p) for q in (1, 2, 3) for r, p in enumerate("aabcad", 1)], "query_id int, rank int, rel_path string")
    ranks = evaluate.doc_rank(golden, hits, 3)
    assert {r.query_id: r.rank for r in ranks.collect()} == {1: 2, 2: 0, 3: 0}
    assert tuple(evaluate.recall_mrr(ranks).first()) == (3, 0.0, pytest.approx(1 / 3), pytest.approx(1 / 6))
    times = spark.createDataFrame([(v,) for v in (5, 1, 9, 3, 7)], "ms int")
    p = lambda d: tuple(d.agg(evaluate.percentile_nearest_rank("ms", 0.5), evaluate.percentile_nearest_rank("ms", 0.95)).first())
    assert p(times) == (5, 9) and p(times.limit(0)) == (0, 0)
    compared = evaluate.parity_compare(golden, hits, hits.filter("query_id = 2"), 3)
    assert tuple(evaluate.parity_gate(compared).first()) == (3, 1, 0, True)
    log = spark.createDataFrame([("a", 0.003), ("a", 0.2), ("a", 9.0), ("b", 2.5)], "kb string, seconds double")
    cells = {(r.kb, r["le"]): r["count"] for r in evaluate.latency_histogram(log).collect()}
    assert cells["a", "0.005"] == 1 and cells["a", "0.25"] == 2 and cells["a", "+Inf"] == 3 and cells["b", "2.5"] == 1
    assert json.loads(evaluate.eval_json(ranks.filter("query_id = 1"), "a").first().value) == {"run": "a", "query_id": 1, "query": "q1", "rank": 2}


def test_pages_of_documents(spark):
    docs = spark.createDataFrame([(f"N/{i}", s) for i in range(4) for s in ("b", "a")], "rel_path string, source_name string")
    first = evaluate.keyset_page(docs, "n/", None, 3).collect()
    assert [tuple(r) for r in first] == [("N/0", "a"), ("N/0", "b"), ("N/1", "a")]
    assert tuple(evaluate.keyset_page(docs, "n/", tuple(first[-1]), 3).first()) == ("N/1", "b")


def vault(root):
    files = {"notes/one.md": "# One\n\nabout foxes\n", "notes/two.md": "---\na: 1\n---\n# Two\n\ntext\n## Sub\nmore", "notes/empty.md": "", "attach/tool.go": "package tool\n", "pic.png": "x", "a.drawio": "x", ".obsidian/app.md": "hidden"}
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


def test_vault_from_files_to_search(spark, tmp_path):
    vault(tmp_path / "v")
    root = str(tmp_path / "v")
    with_source = lambda: list_files(spark, root).withColumns({"source_name": F.lit("vault"), "mtime": F.unix_seconds("mtime")})
    assert sorted(r.rel_path for r in with_source().collect()) == ["attach/tool.go", "notes/one.md", "notes/two.md"]
    assert sorted(r.rel_path for r in list_files(spark, root, include=["notes/**"], exclude=["**/e*"]).collect()) == ["notes/one.md", "notes/two.md"]

    def listing():
        return with_source().join(read_content(spark, root, with_source()).select("rel_path", "content_sha256"), "rel_path")

    state = {"base": None, "n": 0}

    def texts(keys):
        return keys.join(read_content(spark, root, keys).select("rel_path", "text"), "rel_path")

    def stored(base):
        state["n"] += 1
        kept = []
        for name in ("docs", "chunks", "vectors", "manifest"):
            path = str(tmp_path / f"kb-{state['n']}/{name}")
            getattr(base, name).write.parquet(path)
            kept.append(spark.read.parquet(path))
        state["base"] = plans.Base(*kept)

    def run(embed=stand_in_embedder(16)):
        base, summary = plans.sync_source(listing(), state["base"], texts, embed, 16) if state["base"] else plans.rebuild(listing(), first, texts, embed, 16)
        counts = tuple(summary.select("indexed", "deleted", "skipped", "failed").first() or ())
        stored(base)
        return counts

    empty = plans.index_documents(spark.createDataFrame([], "doc_id string, rel_path string, title string, text string"), stand_in_embedder(16), 16)
    first = plans.Base(spark.createDataFrame([], "source_name string, rel_path string, doc_id string, title string"), *empty, spark.createDataFrame([], LISTING))
    assert run() == (3, 0, 0, 0)
    assert run() == (0, 0, 3, 0)
    (tmp_path / "v/notes/one.md").write_text("# One\n\nabout badgers now\n")
    before = state["base"]
    with pytest.raises(Exception, match="no model"):
        run(lambda t: (_ for _ in ()).throw(RuntimeError("no model")))
    assert state["base"] is before  # an error leaves the tables as they were
    assert run() == (1, 0, 2, 0)
    (tmp_path / "v/attach/tool.go").unlink()
    dirty = spark.createDataFrame([("vault", "attach/tool.go"), ("vault", "notes/two.md"), ("vault", "gone.md")], "source_name string, rel_path string")
    after, actions = plans.sync_paths(dirty, listing(), state["base"], texts, stand_in_embedder(16), 16)
    assert {r.rel_path: r.action for r in actions.collect()} == {"attach/tool.go": "delete", "notes/two.md": "touch", "gone.md": "ignore"}
    assert sorted(r.rel_path for r in after.docs.collect()) == ["notes/one.md", "notes/two.md"]
    assert run() == (0, 1, 2, 0)
    chunks = state["base"].chunks
    assert state["base"].vectors.count() == chunks.count()
    hits = keyword.bm25(spark.createDataFrame([(1, "badgers")], "query_id long, query string"), keyword.postings(chunks), keyword.chunk_lengths(chunks)).join(chunks, "chunk_id").collect()
    assert [(r.heading_path, r.text) for r in hits] == [("One", "# One\n\nabout badgers now")]
    assert not spark.range(1).select(safe_path(F.lit("a/../b"))).first()[0] and spark.range(1).select(safe_path(F.lit("a/..b"))).first()[0]
    golden = tmp_path / "golden.json"
    golden.write_text('{"query": "badgers", "expect": ["one.md"]}\n{"query": null}\n')
    assert golden_queries(spark, str(golden)).count() == 1
    golden.write_text("")
    with pytest.raises(ValueError, match="no golden"):
        golden_queries(spark, str(golden))


def test_managed_documents(spark):
    kbs = spark.createDataFrame([("w", True), ("r", False)], "kb string, writable boolean")
    ts = dt.datetime(2024, 1, 2, 3, 4, 5)
    writes = spark.createDataFrame([("1", "w", ts, "", "# Head\n\nbody", {"agent": "x"}), ("2", "r", ts, "t", "x", None), ("3", "w", ts, "t", " ", None), ("4", "?", ts, "t", "x", None)], "key string, kb string, ts timestamp, title string, content string, metadata map<string,string>")
    none = sync.managed_documents(writes.limit(0), F.col("kb")).withColumn("doc_id", F.lit(""))
    empty = plans.index_documents(spark.createDataFrame([], "doc_id string, rel_path string, title string, text string"), stand_in_embedder(4), 4)
    base, rejected = plans.store_documents(writes, kbs, plans.Base(none, *empty, none), stand_in_embedder(4), 4)
    d = base.docs.first()
    assert base.docs.count() == 1 and d.rel_path.startswith("memory_20240102_030405_") and d.uri == f"managed://w/{d.rel_path}" and d.size_bytes == 12
    assert [r.heading_path for r in base.chunks.collect()] == ["Head"] and base.vectors.count() == 1
    assert {r.key: r.reason for r in rejected.collect()} == {"2": "not writable", "3": "blank content", "4": "unknown knowledge base"}
    again, _ = plans.store_documents(writes.withColumn("content", F.concat("content", F.lit(" more"))), kbs, base, stand_in_embedder(4), 4)
    assert [r.content for r in again.docs.orderBy("content").collect()][0].endswith("more") and again.chunks.filter("text like '%more'").count() == again.chunks.count()
    left, cut = plans.delete_managed(base.docs, kbs, base.docs.select("kb", "rel_path"), base.chunks)
    assert left.count() == 0 and cut.count() == 0


def test_deletes_stay_in_their_knowledge_base(spark):
    """Equal paths in a writable and in a frozen knowledge base are two documents."""
    kbs = spark.createDataFrame([("w", True), ("r", False), ("v", True)], "kb string, writable boolean")
    docs = spark.createDataFrame([(k, "managed", "m1", f"{k}1") for k in "wrv"], "kb string, source_name string, rel_path string, doc_id string")
    chunks = docs.select("doc_id", F.lit("x").alias("text"))
    left, cut = plans.delete_managed(docs, kbs, docs.filter("kb <> 'v'").select("kb", "rel_path"), chunks)
    assert sorted(r.kb for r in left.collect()) == ["r", "v"] and sorted(r.doc_id for r in cut.collect()) == ["r1", "v1"]
    new = docs.filter("kb = 'v'").withColumn("doc_id", F.lit("v2"))
    assert sorted(r.doc_id for r in sync.upsert_documents(docs, new).collect()) == ["r1", "v2", "w1"]
    with pytest.raises(ValueError, match="kb"):
        sync.delete_documents(docs, docs.drop("kb"))


def test_listed_keys_of_unknown_size_are_there(spark):
    listing = spark.createDataFrame([("s", "a", None, None, "h"), ("s", "b", None, None, "new")], LISTING)
    manifest = spark.createDataFrame([("s", "a", None, None, "h"), ("s", "b", 1, 1, "old"), ("s", "c", None, None, None)], LISTING)
    assert {r.rel_path: r.action for r in sync.manifest_diff(listing, manifest).collect()} == {"a": "touch", "b": "index", "c": "delete"}
    dirty = spark.createDataFrame([("s", x) for x in "abcd"], "source_name string, rel_path string")
    assert {r.rel_path: r.action for r in sync.sync_paths(dirty, listing, manifest).collect()} == {"a": "touch", "b": "index", "c": "delete", "d": "ignore"}


def test_prefilter_and_stored_index(spark, tmp_path):
    i = make_index(spark).write(str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "quick", [1.0, 0.0], {"k": "w"}), (2, "quick", [1.0, 0.0], None)], "query_id long, query string, query_vec array<float>, filter map<string,string>")
    rows = plans.search(asked.filter("query_id = 1").withColumn("filter", F.create_map(F.lit("k"), F.lit("v"))), i, prefilter=True).collect()
    assert {r.doc_id for r in rows} == {1} and {(r.fts_rank, r.vec_rank) for r in rows} == {(1, 1), (0, 2)}


def events(rows):
    return "\n".join(json.dumps({"kb": "k", "source_name": "s", "rel_path": p, "ts": f"2024-01-01T00:00:{t:06.3f}Z"}) for p, t in rows)


def test_streams(spark, tmp_path):
    log, point = tmp_path / "log", tmp_path / "points"
    log.mkdir()
    (log / "1.json").write_text(events([("a.md", 1), ("a.md", 2.5), ("a.md", 4.5), ("a.md", 9), ("pic.png", 1), ("b.md", 3), ("b.md", 40)]))
    rows = spark.read.schema(EVENTS).json(str(log))
    bursts = {(r.rel_path, r.n_events) for r in debounce_paths(rows.filter("rel_path <> 'pic.png'")).collect()}
    assert bursts == {("a.md", 2), ("a.md", 1), ("b.md", 1)} or bursts == {("a.md", 3), ("a.md", 1), ("b.md", 1)}
    listing = spark.createDataFrame([("s", "a.md", 1, 1, "new")], LISTING)
    manifest = spark.createDataFrame([("s", "a.md", 1, 1, "old"), ("s", "b.md", 1, 1, "x")], LISTING)
    seen, synced = [], []

    def live():
        stream = debounce_paths(watch_source(spark, str(log)))
        return resync_on_fire(stream, lambda: listing, lambda: manifest, lambda actions, n: seen.extend((r.rel_path, r.action) for r in actions.collect()), str(point / "a"))

    initial_then_live(lambda: synced.append(1), live).awaitTermination()
    assert synced == [1] and ("a.md", "index") in seen and all(p in ("a.md", "b.md") for p, _ in seen)
    counted = watch_event_counts(watch_source(spark, str(log))).writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    counted.awaitTermination()
    assert spark.table("counted").first().n_events == 6
    stored = []
    managed_write_stream(watch_source(spark, str(log)), lambda batch, n: stored.append(batch.count()), str(point / "b")).awaitTermination()
    assert sum(stored) == 6
