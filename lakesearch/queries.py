"""

Scores are rounded to six decimals in results; ranks are decided before that.  Streams read what is there and end.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bindings as b
from . import functions as fn
from . import plans
from .operators import chunking, evaluate, extract, keyword, ranking, sync
from .operators.results import ModelResults, embed_once
from .sources import contents, golden_queries, listed, shared_dir
from .streaming import EVENTS, Ledger, debounce_paths, initial_then_live, managed_write_stream, poll_source, resync_on_fire, watch_event_counts, watch_source

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str | None]] = {}
LIMIT, OVERLAP = 128, 16
def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _stored(rows: DataFrame, name: str) -> str:
    """A folder of JSON lines."""
    path = _path(rows.sparkSession, name)
    rows.write.json(path)
    return path


_BLOCK_COLUMNS = "doc_id, block_no, heading_path, start_line, end_line, text"
_CHUNK_COLUMNS = "doc_id, seq, heading_path, start_line, end_line, text, token_est"


def query(sql: str | None = None, blocks: tuple[str, int, int] | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _FOUND[f.__name__] = f, b.sql(sql, blocks) if sql else None
        return f

    return add


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _FOUND.items() if sql}


# sources and sinks


@query("SELECT rel_path, size_bytes FROM fls WHERE NOT regexp_matches(rel_path, '(^|/)\\.[^/]*/') AND regexp_matches(lower(rel_path), '\\.(md|txt|go)$')")
def A01_list_files(spark, d):
    return listed(b.files(spark, d)).select("rel_path", F.col("length").alias("size_bytes"))


@query("SELECT rel_path, size_bytes FROM fls WHERE regexp_matches(rel_path, '^notes/src[0-4]-[^/]*[02468]\\.(md|txt)$')")
def A02_list_files_included(spark, d):
    return listed(b.files(spark, d), include=["**/src[0-4]-*[02468].{md,txt}"], exclude=["../**"]).select("rel_path", F.col("length").alias("size_bytes"))


@query("SELECT rel_path, size_bytes FROM fls WHERE regexp_matches(lower(rel_path), '\\.(md|txt|go)$') AND NOT starts_with(rel_path, 'a/')")
def A03_list_files_object_store(spark, d):
    return listed(b.files(spark, d), exclude=["a/**"], dot_folders=True).select("rel_path", F.col("length").alias("size_bytes"))


@query("SELECT rel_path, text, size_bytes, sha256(text) AS content_sha256 FROM fls WHERE NOT starts_with(rel_path, '../')")
def A04_read_content(spark, d):
    files = b.files(spark, d)
    return contents(files, files.select("rel_path").union(files.select(F.concat(F.lit("/"), "rel_path"))))


@query("SELECT kb, 'managed' AS source_name, rel_path, 'managed://' || kb || '/' || rel_path AS uri, title, content, sha256(content) AS content_sha256, CAST(strlen(content) AS BIGINT) AS size_bytes FROM mg")
def A05_managed_writes(spark, d):
    return sync.managed_documents(b.writes(spark, d), F.col("kb")).drop("mtime", "metadata")


@query("SELECT DISTINCT query, array_to_string(expect, ',') AS expect FROM gold")
def A06_golden_queries(spark, d):
    path = _stored(b.golden(spark, d).select("query", "expect").dropDuplicates(["query"]), "golden")
    return golden_queries(spark, path).select("query", F.array_join("expect", ",").alias("expect"))


@query("SELECT source_name, rel_path, text FROM docs WHERE doc_id % 3 <> 0 UNION ALL SELECT source_name, rel_path, text || ' v2' FROM docs WHERE doc_id % 3 = 0")
def A07_upsert_documents(spark, d):
    base = b.docs(spark, d).select("source_name", "rel_path", "text")
    new = b.docs(spark, d).filter("doc_id % 3 = 0").select("source_name", "rel_path", F.concat("text", F.lit(" v2")).alias("text"))
    return sync.upsert_documents(base, new)


@query("SELECT doc_id, source_name, rel_path FROM docs WHERE doc_id % 4 <> 1")
def A08_delete_documents(spark, d):
    docs = b.docs(spark, d).select("doc_id", "source_name", "rel_path")
    absent = docs.limit(1).select(F.lit("src0").alias("source_name"), F.lit("absent.txt").alias("rel_path"))
    return sync.delete_documents(docs, docs.filter("doc_id % 4 = 1").select("source_name", "rel_path").union(absent))


@query("SELECT source_name, rel_path, size_bytes, mtime, content_sha256 FROM mnf WHERE (SELECT count(*) FROM documents) > 0")
def A09_read_manifest(spark, d):
    return sync.read_manifest(b.manifest(spark, d), b.chunks(spark, d))


@query("""SELECT coalesce(l.source_name, m.source_name) AS source_name, coalesce(l.rel_path, m.rel_path) AS rel_path, coalesce(l.size_bytes, m.size_bytes) AS size_bytes,
  coalesce(l.mtime, m.mtime) AS mtime, coalesce(l.content_sha256, m.content_sha256) AS content_sha256 FROM mnf m FULL JOIN lst l ON l.source_name = m.source_name AND l.rel_path = m.rel_path""")
def A10_touch_manifest(spark, d):
    return sync.touch_manifest(b.manifest(spark, d), b.listing(spark, d))


@query("SELECT vec_id AS chunk_id, CAST(len(embedding) AS INTEGER) AS dim, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def A11_read_embeddings(spark, d):
    return b.vectors(spark, d).select("chunk_id", F.size("embedding").alias("dim"), F.round("norm", 6).alias("norm"))


@query("SELECT '{\"run\":\"base\",\"query_id\":' || query_id || ',\"rank\":' || fts_rank || '}' AS value FROM kw")
def A12_eval_json(spark, d):
    hits = _keyword(spark, d).select("query_id", F.col("fts_rank").alias("rank"), F.lit(None).cast("string").alias("query"))
    return evaluate.eval_json(hits, "base")


@query("SELECT source_name, rel_path, size_bytes, mtime, content_sha256 FROM lst")
def A13_rebuild(spark, d):
    return plans.rebuild(b.listing(spark, d), b.old_base(spark, d), b.contents_of(spark, d), b.lengths_embedder, 2)[0].manifest


@query("SELECT 'stub' AS embedding_model, CAST(max(len(embedding)) AS INTEGER) AS embedding_dimensions FROM embeddings")
def A14_check_identity(spark, d):
    meta = b.vectors(spark, d).agg(F.lit("stub").alias("embedding_model"), F.max(F.size("embedding")).alias("embedding_dimensions"))
    return sync.check_identity(meta, "stub", b.DIM)


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'plaintext' WHEN doc_id % 4 = 1 THEN 'markdown' WHEN doc_id % 4 = 2 THEN 'code' END AS format FROM documents")
def A15_format_of(spark, d):
    ends = F.element_at(F.array(F.lit(".TXT"), F.lit(".md"), F.lit(".go"), F.lit(".drawio")), (F.col("doc_id") % 4 + 1).cast("int"))
    path = F.concat(F.lit("a.b/c"), F.col("doc_id").cast("string"), ends)
    return b.docs(spark, d).select("doc_id", fn.format_of(fn.file_ext(path)).alias("format"))


# extraction and chunking


@query("SELECT doc_id, CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS line_no, unnest(l) AS line FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '\\r?\\n\\z', ''), '\\r?\\n') AS l FROM documents WHERE text <> '')")
def B01_explode_lines(spark, d):
    return extract.explode_lines(b.docs(spark, d))


@query("SELECT doc_id, line_no, line FROM md_lines")
def B02_skip_frontmatter(spark, d):
    return extract.skip_frontmatter(extract.explode_lines(b.markdown(spark, d)))


@query("SELECT doc_id, line_no, fenced FROM md_fenced")
def B03_mark_fences(spark, d):
    return extract.mark_fences(extract.skip_frontmatter(extract.explode_lines(b.markdown(spark, d)))).select("doc_id", "line_no", "fenced")


@query("SELECT doc_id, line_no, level, heading FROM md_heads WHERE level > 0")
def B04_parse_atx_heading(spark, d):
    lines = extract.with_headings(extract.mark_fences(extract.skip_frontmatter(extract.explode_lines(b.markdown(spark, d)))))
    return lines.filter("level > 0").select("doc_id", "line_no", "level", "heading")


@query("SELECT doc_id, line_no, heading_path FROM md_paths")
def B05_heading_path(spark, d):
    return extract.markdown_lines(b.markdown(spark, d)).select("doc_id", "line_no", "heading_path")


@query(f"SELECT {_BLOCK_COLUMNS} FROM md_blocks")
def B06_sectionize_blocks(spark, d):
    return extract.markdown_blocks(b.markdown(spark, d))


@query("SELECT m.doc_id, CASE WHEN m.doc_id % 10 = 0 THEN 'Given' ELSE coalesce(h.heading, CAST(m.doc_id AS VARCHAR)) END AS title FROM md m LEFT JOIN (SELECT doc_id, min_by(heading, line_no) AS heading FROM md_heads WHERE level = 1 AND heading <> '' GROUP BY doc_id) h ON h.doc_id = m.doc_id")
def B07_resolve_title(spark, d):
    docs = b.markdown(spark, d)
    return extract.resolve_title(docs.withColumn("given", F.when(F.col("doc_id") % 10 == 0, "Given")), extract.markdown_lines(docs))


@query(f"SELECT {_BLOCK_COLUMNS} FROM wf_blocks")
def B08_whole_file_block(spark, d):
    return extract.whole_file_block(b.docs(spark, d))


@query(f"SELECT {_BLOCK_COLUMNS} FROM pg_blocks")
def B09_pages_to_blocks(spark, d):
    return extract.pages_to_blocks(b.pages(spark, d))[0]


@query("""SELECT doc_id, CAST(block_no AS INTEGER) AS block_no, concat_ws(' > ', CASE WHEN p1 > 0 THEN h1 END, CASE WHEN p2 > coalesce(p1, 0) THEN h2 END) AS heading_path, start_line, end_line, text FROM (
  SELECT doc_id, block_no, min(line_no) AS start_line, max(line_no) AS end_line, min_by(p1, line_no) AS p1, min_by(p2, line_no) AS p2, min_by(h1, line_no) AS h1, min_by(h2, line_no) AS h2,
    regexp_replace(string_agg(text, '\n' ORDER BY line_no), '^\\s+|\\s+$', '', 'g') AS text FROM (
    SELECT *, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER v AS block_no, last_value(CASE WHEN level = 1 THEN line_no END IGNORE NULLS) OVER v AS p1, last_value(CASE WHEN level = 2 THEN line_no END IGNORE NULLS) OVER v AS p2,
      last_value(CASE WHEN level = 1 THEN t END IGNORE NULLS) OVER v AS h1, last_value(CASE WHEN level = 2 THEN t END IGNORE NULLS) OVER v AS h2 FROM (
      SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS line_no, text, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 0 END AS level FROM conversations)
    WINDOW v AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)) GROUP BY doc_id, block_no)""")
def B10_paragraphs_to_blocks(spark, d):
    return extract.paragraphs_to_blocks(b.paragraphs(spark, d))


_OCR = """SELECT *, CAST(coalesce(last, 0) + 1 + coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start_line FROM (
  SELECT s.doc_id, s.page_no, t.text, CAST(len(string_split(t.text, '\n')) AS INTEGER) AS n, x.last FROM pg_scan s
  JOIN (SELECT conv_id AS doc_id, turn + 1 AS page_no, regexp_replace(CASE WHEN conv_id % 4 = 0 THEN '[no text]' ELSE text END, '^\\s+|\\s+$', '', 'g') AS text FROM conversations WHERE (turn + 1) % 3 = 0) t ON t.doc_id = s.doc_id AND t.page_no = s.page_no
  LEFT JOIN (SELECT doc_id, max(end_line) AS last FROM pg_blocks GROUP BY doc_id) x ON x.doc_id = s.doc_id WHERE t.text <> '' AND t.text <> '[no text]')"""


@query(f"SELECT {_BLOCK_COLUMNS} FROM pg_blocks UNION ALL SELECT doc_id, page_no, 'Page ' || page_no || ' (OCR)', start_line, start_line + n - 1, text FROM ({_OCR})")
def B11_append_ocr_blocks(spark, d):
    return extract.append_ocr_blocks(*extract.pages_to_blocks(b.pages(spark, d)), b.transcripts(spark, d))[0]


@query("SELECT doc_id, 'vlm' AS ocr, string_agg(page_no, ',' ORDER BY page_no) AS ocr_pages FROM pg_scan GROUP BY doc_id")
def B11_ocr_metadata(spark, d):
    found = extract.append_ocr_blocks(*extract.pages_to_blocks(b.pages(spark, d)), b.transcripts(spark, d))[1]
    return found.select("doc_id", F.col("metadata.ocr").alias("ocr"), F.col("metadata.ocr_pages").alias("ocr_pages"))


@query("SELECT doc_id, CAST(CASE WHEN text = '' THEN 0 ELSE greatest(1, strlen(text) // 4) END AS INTEGER) AS tokens FROM documents")
def B12_estimate_tokens(spark, d):
    return b.docs(spark, d).select("doc_id", fn.estimate_tokens(F.col("text")).alias("tokens"))


@query(f"SELECT {_CHUNK_COLUMNS} FROM ck", ("md_blocks", LIMIT, OVERLAP))
def B13_chunk_markdown(spark, d):
    return chunking.chunk_blocks(extract.markdown_blocks(b.markdown(spark, d)), LIMIT, OVERLAP)


@query(f"SELECT {_CHUNK_COLUMNS} FROM ck", ("wf_blocks", 512, 64))
def B13_chunk_documents(spark, d):
    return chunking.chunk_blocks(extract.whole_file_block(b.docs(spark, d)))


@query(f"SELECT {_CHUNK_COLUMNS} FROM ck", ("wf_blocks", LIMIT, OVERLAP))
def B14_split_oversized_block(spark, d):
    return chunking.chunk_blocks(extract.whole_file_block(b.docs(spark, d)), LIMIT, OVERLAP)


@query("SELECT c.doc_id, c.seq, CASE WHEN count(*) OVER (PARTITION BY c.doc_id) > 1 THEN 'about ' || d.rel_path || ': ' || length(d.text) || '/' || length(c.text) ELSE '' END AS context FROM ck c JOIN md d ON d.doc_id = c.doc_id", ("md_blocks", LIMIT, OVERLAP))
def B15_contextualize_chunks(spark, d):
    docs = b.markdown(spark, d).withColumn("title", F.col("rel_path"))
    chunks = chunking.chunk_blocks(extract.markdown_blocks(docs), LIMIT, OVERLAP)
    return chunking.contextualize_chunks(chunks, docs, lambda title, document, chunk: f"about {title}: {len(document)}/{len(chunk)}").select("doc_id", "seq", "context")


@query("SELECT doc_id, block_no, concat_ws(chr(10) || chr(10), CASE WHEN doc_id % 2 = 0 THEN 'ctx' END, nullif(heading_path, ''), text) AS embedding_text FROM md_blocks")
def B16_embedding_text(spark, d):
    blocks = extract.markdown_blocks(b.markdown(spark, d)).withColumn("context", F.when(F.col("doc_id") % 2 == 0, "ctx").otherwise(""))
    return chunking.with_embedding_text(blocks).select("doc_id", "block_no", "embedding_text")


@query("SELECT doc_id, CAST(length(text) AS DOUBLE) AS first, CAST(2 * length(text) AS DOUBLE) AS second FROM documents")
def B17_embed_texts(spark, d):
    out = chunking.embed_texts(b.docs(spark, d), lambda texts: [[len(t), 2 * len(t)] for t in texts], 2, "text")
    return out.select("doc_id", F.col("embedding")[0].cast("double").alias("first"), F.col("embedding")[1].cast("double").alias("second"))


@query("SELECT doc_id, length(text)::DOUBLE AS size, CASE WHEN text IN (SELECT text FROM documents WHERE lang = 'de') THEN 1.0::DOUBLE ELSE 2 END AS run FROM documents")
def B17_embed_once(spark, d):
    """Two runs that share their results; the second component says which of them asked the model."""
    results = ModelResults(_path(spark, "results"), "sizes", "array<float>")
    docs = b.docs(spark, d)
    for run, rows in (1, docs.filter(F.col("rel_path").startswith("de/"))), (2, docs):
        out = embed_once(rows, lambda texts, run=run: [[len(t), run] for t in texts], 2, results, "text")
    return out.select("doc_id", F.col("embedding")[0].cast("double").alias("size"), F.col("embedding")[1].cast("double").alias("run"))


@query("SELECT doc_id, sha256(text) AS content_sha256 FROM documents")
def B18_content_hash(spark, d):
    return b.docs(spark, d).select("doc_id", fn.content_hash(F.col("text")).alias("content_sha256"))


# filters and projections


@query("SELECT doc_id, rel_path FROM docs WHERE (rel_path LIKE 'en/%' OR rel_path LIKE 'de/%') AND NOT regexp_matches(rel_path, '^(?:[^/]+/)*[^/]*7[^/]\\.txt$')")
def C01_is_indexable(spark, d):
    docs = b.docs(spark, d).select("doc_id", "rel_path")
    return docs.filter(fn.is_indexable(F.col("rel_path"), include=["{en,de}/**"], exclude=["**/*7?.txt"]))


@query("SELECT d.doc_id FROM docs d LEFT JOIN labels l USING (doc_id) WHERE coalesce(CAST(l.quality AS VARCHAR), '') = '1' AND coalesce(CAST(l.toxic AS VARCHAR), '') = '0'")
def C02_filter_by_metadata(spark, d):
    rows = b.docs(spark, d).join(b.metadata(spark, d), "doc_id", "left")
    wanted = F.create_map(F.lit("quality"), F.lit("1"), F.lit("toxic"), F.lit("0"), F.lit("absent"), F.lit(""))
    return rows.filter(fn.metadata_matches(F.col("metadata"), wanted)).select("doc_id")


@query("SELECT query_id, chunk_id, round(least(1, rrf / (2.0::DOUBLE / 61)), 6) AS relevance FROM fr WHERE rank <= 8 AND least(1, rrf / (2.0::DOUBLE / 61)) >= 0.48")
def C03_min_score(spark, d):
    hits = _fused(spark, d).filter("rank <= 8").select("query_id", "chunk_id", fn.relevance(F.col("rrf")).alias("relevance"), F.lit(0.48).alias("min_score"))
    return ranking.above_min_score(hits).select("query_id", "chunk_id", F.round("relevance", 6).alias("relevance"))


@query("SELECT doc_id, rel_path FROM docs WHERE starts_with(lower(rel_path), 'en/000')")
def C04_path_prefix(spark, d):
    return b.docs(spark, d).filter(fn.path_has_prefix(F.col("rel_path"), "EN/000")).select("doc_id", "rel_path")


@query("SELECT g.query_id, d.rel_path FROM gold g JOIN docs d ON list_contains(g.expect, d.rel_path)")
def C05_matches_expectation(spark, d):
    wanted = b.golden(spark, d).select("query_id", "expect", F.explode("expect").alias("rel_path"))
    docs = b.docs(spark, d).select("rel_path").join(wanted, "rel_path")
    return docs.filter(fn.matches_expectation(F.col("rel_path"), F.concat("expect", F.array(F.lit(""))))).select("query_id", "rel_path")


@query("SELECT d.doc_id, 1::BIGINT AS n_chunks, CASE WHEN v.vec_id IS NULL THEN 0 ELSE 1 END::BIGINT AS n_vectors FROM documents d LEFT JOIN embeddings v ON v.vec_id = d.doc_id WHERE v.vec_id IS NULL UNION ALL SELECT vec_id, 0, 1 FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)")
def C06_validate_counts(spark, d):
    return sync.check_counts(b.chunks(spark, d), b.vectors(spark, d).withColumnRenamed("chunk_id", "doc_id"))


@query("SELECT query_id, chunk_id, round(least(1, rrf / (2.0::DOUBLE / 61)), 6) AS relevance FROM rrf")
def C07_relevance(spark, d):
    return _fused(spark, d).select("query_id", "chunk_id", F.round(fn.relevance(F.col("rrf")), 6).alias("relevance"))


@query("SELECT doc_id, translate(CASE WHEN length(text) > 200 THEN left(text, 200) || '…' ELSE text END, '\n', ' ') AS preview FROM documents")
def C08_hit_preview(spark, d):
    return b.docs(spark, d).select("doc_id", fn.preview(F.col("text")).alias("preview"))


@query("""SELECT doc_id, CASE WHEN e <= 0 THEN array_to_string(l[s:], '\n') WHEN s <= least(e, len(l)) THEN array_to_string(l[s:e], '\n') ELSE '' END AS lines
  FROM (SELECT doc_id, string_split(text, '\n') AS l, greatest(1, doc_id % 4) AS s, doc_id % 6 - 1 AS e FROM documents) WHERE NOT (e <= 0 AND s > len(l)) UNION ALL
  SELECT doc_id, '' FROM (SELECT doc_id, len(string_split(text, '\n')) AS n, greatest(1, doc_id % 4) AS s, doc_id % 6 - 1 AS e FROM documents) WHERE e <= 0 AND s > n""")
def C09_slice_lines(spark, d):
    return b.docs(spark, d).select("doc_id", fn.slice_lines(F.col("text"), (F.col("doc_id") % 4).cast("int"), (F.col("doc_id") % 6 - 1).cast("int")).alias("lines"))


def _kbs(spark, d):
    return b.writes(spark, d).select("kb").distinct().withColumn("writable", F.col("kb") != "frozen")


@query("SELECT key, CASE WHEN kb = 'frozen' THEN 'not writable' ELSE 'blank content' END AS reason FROM wr WHERE kb = 'frozen' OR trim(regexp_replace(content, '\\s+', ' ', 'g')) = ''")
def C10_writable_guard(spark, d):
    return sync.writable_guard(b.writes(spark, d), _kbs(spark, d))[1].select("key", "reason")


# joins


@query("SELECT source_name, rel_path, action, size_bytes, mtime, content_sha256 FROM diff")
def D01_manifest_diff(spark, d):
    return sync.manifest_diff(b.listing(spark, d), b.manifest(spark, d))


@query("SELECT source_name, rel_path FROM mnf EXCEPT SELECT source_name, rel_path FROM lst")
def D02_deleted_paths(spark, d):
    return sync.deleted_paths(b.listing(spark, d), b.manifest(spark, d))


@query("SELECT query_id, rank, doc_id, rel_path, text FROM hyd WHERE rank <= 8")
def D03_hydrate_hits(spark, d):
    i = b.index(spark, d)
    return ranking.hydrate_hits(_fused(spark, d).filter("rank <= 8"), i.chunks, i.docs).select("query_id", "rank", "doc_id", "rel_path", "text")


@query("SELECT query_id, chunk_id, fts_rank, vec_rank FROM rrf")
def D04_rrf_fuse(spark, d):
    return _fused(spark, d).select("query_id", "chunk_id", "fts_rank", "vec_rank")


@query("SELECT query_id, phrase_no, chunk_id, freq FROM phr JOIN mat USING (phrase)")
def D05_match_terms(spark, d):
    i = b.index(spark, d)
    return keyword.phrase_hits(keyword.query_phrases(b.queries(spark, d)), i.postings).select("query_id", F.col("phrase_no").cast("long").alias("phrase_no"), "chunk_id", "freq")


@query("SELECT query_id, chunk_id, vec_rank, round(cosine, 6) AS cosine FROM vk")
def D06_knn_cosine(spark, d):
    return _vector(spark, d).select("query_id", "chunk_id", "vec_rank", F.round("cosine", 6).alias("cosine"))


@query("SELECT source_name, rel_path, action, size_bytes, mtime, content_sha256 FROM spath")
def D07_sync_paths(spark, d):
    return sync.sync_paths(b.dirty(spark, d), b.listing(spark, d), b.manifest(spark, d))


_SCORE = "CAST((doc_id * 7919 + query_id * 104729) % 1000 AS DOUBLE) / 100 - 4"
_POOL = f"SELECT query_id, doc_id AS chunk_id, rank - 1 AS pool_idx, CASE WHEN query_id % 2 = 0 THEN {_SCORE} ELSE ((doc_id * 7919 + query_id * 104729) % 1000)::DOUBLE / 1000 END AS score, rrf FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM hyd) WHERE place <= 24"
_REL = f"SELECT *, CASE WHEN max(CASE WHEN score < 0 OR score > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) = 1 THEN 1 / (1 + exp(-score)) ELSE score END AS relevance FROM ({_POOL})"


def _scores():
    raw = (F.col("doc_id") * 7919 + F.col("query_id") * 104729) % 1000
    return F.when(F.col("query_id") % 2 == 0, raw.cast("double") / 100 - 4).otherwise(raw.cast("double") / 1000)


def _hydrated(spark, d):
    i = b.index(spark, d)
    return ranking.hydrate_hits(_fused(spark, d), i.chunks, i.docs)


@query(f"SELECT query_id, chunk_id, round(relevance, 6) AS relevance, row_number() OVER (PARTITION BY query_id ORDER BY round(relevance, 9) DESC, pool_idx)::INTEGER AS rank FROM ({_REL})")
def D08_attach_rerank_scores(spark, d):
    hits = _hydrated(spark, d).join(b.queries(spark, d).select("query_id", "query"), "query_id")
    return ranking.rerank(hits, _scores()).select("query_id", "chunk_id", F.round("relevance", 6).alias("relevance"), "rank")


@query("SELECT doc_id, count(*) AS n FROM post JOIN docs ON doc_id = chunk_id WHERE doc_id % 10 <> 9 GROUP BY doc_id")
def D09_cascade_delete(spark, d):
    docs = b.docs(spark, d)
    rows = keyword.postings(b.chunks(spark, d), ("text",)).withColumnRenamed("chunk_id", "doc_id")
    return sync.cascade_delete(docs, sync.deleted_paths(b.listing(spark, d), docs), rows)[1].groupBy("doc_id").agg(F.sum("freq").alias("n"))


_RANKS = "SELECT g.query_id, g.query, coalesce(r.rank, 0) AS rank FROM gold g LEFT JOIN (SELECT h.query_id, min(h.place) AS rank FROM ({hits}) h JOIN gold x ON x.query_id = h.query_id WHERE list_contains(x.expect, h.rel_path) AND h.place <= 5 GROUP BY h.query_id) r ON r.query_id = g.query_id"
_BY_KEYWORD = _RANKS.format(hits="SELECT k.query_id, d.rel_path, k.fts_rank AS place FROM kw k JOIN docs d ON d.doc_id = k.chunk_id")
_BY_VECTOR = _RANKS.format(hits="SELECT k.query_id, d.rel_path, row_number() OVER (PARTITION BY k.query_id ORDER BY k.vec_rank) AS place FROM vk k JOIN docs d ON d.doc_id = k.chunk_id")


def _ranks(spark, d, leg):
    hits = leg(spark, d).join(b.docs(spark, d).select(F.col("doc_id").alias("chunk_id"), "rel_path"), "chunk_id")
    rank = "fts_rank" if "fts_rank" in hits.columns else "vec_rank"
    return hits.select("query_id", "rel_path", F.col(rank).alias("rank"))


def _by_keyword(spark, d):
    return evaluate.doc_rank(b.golden(spark, d), _ranks(spark, d, _keyword), 5)


def _by_vector(spark, d):
    return evaluate.doc_rank(b.golden(spark, d), _ranks(spark, d, _vector), 5)


@query(f"SELECT a.query_id, a.query, a.rank::INTEGER AS rank_a, z.rank::INTEGER AS rank_b FROM ({_BY_KEYWORD}) a JOIN ({_BY_VECTOR}) z ON z.query_id = a.query_id WHERE a.rank <> z.rank")
def D10_eval_deltas(spark, d):
    return evaluate.eval_deltas(_by_keyword(spark, d), _by_vector(spark, d))


@query(f"SELECT a.query_id, a.rank > 0 AS new_hit, z.rank > 0 AS legacy_hit FROM ({_BY_KEYWORD}) a JOIN ({_BY_VECTOR}) z ON z.query_id = a.query_id")
def D11_parity_compare(spark, d):
    return evaluate.parity_compare(b.golden(spark, d), _ranks(spark, d, _keyword), _ranks(spark, d, _vector), 5)


# aggregations


@query(f"SELECT kb, count(*) AS documents, sum(n)::BIGINT AS chunks, max(doc_id + {b.EPOCH}) AS last_indexed_at FROM (SELECT lang AS kb, doc_id, 1 + doc_id % 2 AS n FROM documents) GROUP BY kb")
def E01_kb_stats(spark, d):
    docs = b.table(spark, d, "documents").select(F.col("lang").alias("kb"), (F.col("doc_id") + b.EPOCH).alias("indexed_at"), "doc_id")
    return evaluate.kb_stats(docs.select("kb").distinct(), docs, docs.union(docs.filter("doc_id % 2 = 1")))


@query("SELECT array_to_string(phrase, ' ') AS phrase, df, n_chunks, round(avgdl, 6) AS avgdl FROM dfs CROSS JOIN stats")
def E02_bm25_corpus_stats(spark, d):
    i = b.index(spark, d)
    df = keyword.document_frequency(keyword.match_phrases(keyword.query_phrases(b.queries(spark, d)), i.postings))
    return df.join(F.broadcast(keyword.corpus_stats(i.lengths))).select(F.array_join("phrase", " ").alias("phrase"), "df", "n_chunks", F.round("avgdl", 6).alias("avgdl"))


@query("SELECT query_id, chunk_id, round(bm25, 6) AS bm25 FROM bm")
def E03_bm25_score(spark, d):
    i = b.index(spark, d)
    return keyword.bm25(b.queries(spark, d), i.postings, i.lengths, i.stats, i.terms).select("query_id", "chunk_id", F.round("bm25", 6).alias("bm25"))


@query("SELECT query_id, chunk_id, round(rrf, 6) AS rrf FROM rrf")
def E04_rrf_score(spark, d):
    return _fused(spark, d).select("query_id", "chunk_id", F.round("rrf", 6).alias("rrf"))


@query(f"SELECT count(*) AS queries, round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_1, round(avg(CASE WHEN rank > 0 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_n, round(avg(CASE WHEN rank > 0 THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr FROM ({_BY_KEYWORD})")
def E05_recall_mrr(spark, d):
    out = evaluate.recall_mrr(_by_keyword(spark, d))
    return out.select("queries", *(F.round(c, 6).alias(c) for c in ("recall_at_1", "recall_at_n", "mrr")))


@query("SELECT kb, round(quantile_disc(seconds, 0.5), 6) AS p50, round(quantile_disc(seconds, 0.95), 6) AS p95 FROM logs GROUP BY kb")
def E06_percentile_nearest_rank(spark, d):
    p = lambda x: F.round(evaluate.percentile_nearest_rank("seconds", x), 6)
    return b.log(spark, d).groupBy("kb").agg(p(0.5).alias("p50"), p(0.95).alias("p95"))


@query("SELECT source_name, count(*) FILTER (action = 'index') AS indexed, count(*) FILTER (action = 'delete') AS deleted, count(*) FILTER (action IN ('skip', 'touch')) AS skipped, 0::BIGINT AS failed FROM diff GROUP BY source_name")
def E07_sync_summary(spark, d):
    return sync.sync_summary(sync.manifest_diff(b.listing(spark, d), b.manifest(spark, d)))


@query(f"SELECT count(*) AS queries, count(*) FILTER (a.rank > 0) AS new_hits, count(*) FILTER (z.rank > 0) AS legacy_hits, count(*) FILTER (a.rank > 0) >= count(*) FILTER (z.rank > 0) AS pass FROM ({_BY_KEYWORD}) a JOIN ({_BY_VECTOR}) z ON z.query_id = a.query_id")
def E08_parity_gate(spark, d):
    return evaluate.parity_gate(evaluate.parity_compare(b.golden(spark, d), _ranks(spark, d, _keyword), _ranks(spark, d, _vector), 5))


@query("SELECT conv_id AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def E09_reassemble_document(spark, d):
    return evaluate.reassemble_document(b.table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), "text"))


@query("SELECT kb, le, count(*) FILTER (seconds <= bound) AS count, count(*) AS n, round(sum(seconds), 6) AS total FROM logs, (VALUES ('0.005', 0.005), ('0.01', 0.01), ('0.025', 0.025), ('0.05', 0.05), ('0.1', 0.1), ('0.25', 0.25), ('0.5', 0.5), ('1', 1), ('2.5', 2.5), ('+Inf', 'inf'::DOUBLE)) t(le, bound) GROUP BY kb, le")
def E10_latency_histogram(spark, d):
    return evaluate.latency_histogram(b.log(spark, d)).withColumn("total", F.round("total", 6))


@query("SELECT kb, op, count(*) AS n FROM logs GROUP BY kb, op")
def E11_operation_counts(spark, d):
    return evaluate.operation_counts(b.log(spark, d))


@query(f"SELECT DISTINCT query_id, max(CASE WHEN score < 0 OR score > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) = 1 AS needs FROM ({_POOL})")
def E12_needs_sigmoid(spark, d):
    pool = ranking.rerank_pool(_hydrated(spark, d)).withColumn("score", _scores())
    return pool.select("query_id", ranking.needs_sigmoid(F.col("score")).alias("needs")).distinct()


# windows


def _keyword(spark, d):
    i = b.index(spark, d)
    return ranking.ranked(keyword.best(b.queries(spark, d), i.postings, i.lengths, i.stats, i.terms, ranking.CANDIDATES), "bm25", "fts_rank", ranking.CANDIDATES)


def _vector(spark, d):
    return ranking.knn_cosine(b.queries(spark, d), b.vectors(spark, d))


def _fused(spark, d):
    return ranking.fused_rank(ranking.rrf_fuse(_keyword(spark, d), _vector(spark, d)))


@query("SELECT query_id, chunk_id, fts_rank FROM kw")
def F01_fts_rank(spark, d):
    return _keyword(spark, d).select("query_id", "chunk_id", "fts_rank")


@query("SELECT query_id, chunk_id, vec_rank FROM vk")
def F02_vec_rank(spark, d):
    return _vector(spark, d).select("query_id", "chunk_id", "vec_rank")


@query("SELECT query_id, chunk_id, rank FROM fr")
def F03_fused_rank(spark, d):
    return _fused(spark, d).select("query_id", "chunk_id", "rank")


@query("SELECT query_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source_name ORDER BY rank) AS n FROM hyd) WHERE n <= 2")
def F04_cap_per_document(spark, d):
    hits = _hydrated(spark, d).withColumn("doc_id", F.col("source_name")).withColumn("max_per_doc", F.lit(2))
    return ranking.cap_per_document(hits).select("query_id", "chunk_id")


@query(f"SELECT query_id, chunk_id FROM ({_POOL})")
def F05_rerank_pool(spark, d):
    return ranking.rerank_pool(_hydrated(spark, d)).select("query_id", "chunk_id")


@query(f"SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(relevance, 9) DESC, pool_idx)::INTEGER AS rerank_rank FROM ({_REL})")
def F06_rerank_order(spark, d):
    pool = ranking.rerank_pool(_hydrated(spark, d)).withColumn("score", _scores())
    return ranking.rerank_order(pool).select("query_id", "chunk_id", "rerank_rank")


@query(f"SELECT query_id, query, rank::INTEGER AS rank FROM ({_BY_KEYWORD})")
def F07_doc_rank(spark, d):
    return _by_keyword(spark, d)


@query("SELECT query_id, rel_path, doc_rank::INTEGER AS doc_rank FROM (SELECT query_id, rel_path, row_number() OVER (PARTITION BY query_id ORDER BY first, rel_path) AS doc_rank FROM (SELECT k.query_id, d.source_name AS rel_path, min(k.fts_rank) AS first FROM kw k JOIN docs d ON d.doc_id = k.chunk_id GROUP BY ALL)) WHERE doc_rank <= 5")
def F08_first_n_unique_docs(spark, d):
    hits = _keyword(spark, d).join(b.docs(spark, d).select(F.col("doc_id").alias("chunk_id"), F.col("source_name").alias("rel_path")), "chunk_id").withColumnRenamed("fts_rank", "rank")
    return evaluate.first_n_unique_docs(hits, 5)


@query("SELECT doc_id, page_no AS block_no, start_line FROM pg_start")
def F09_running_line_offset(spark, d):
    return extract.pages_to_blocks(b.pages(spark, d))[0].select("doc_id", "block_no", "start_line")


@query("SELECT doc_id, seq, start_line FROM ck", ("md_blocks", LIMIT, OVERLAP))
def F10_chunk_seq(spark, d):
    return chunking.chunk_blocks(extract.markdown_blocks(b.markdown(spark, d)), LIMIT, OVERLAP).select("doc_id", "seq", "start_line")


@query("SELECT DISTINCT doc_id, heading_path FROM md_paths")
def F11_carry_forward_heading(spark, d):
    return extract.markdown_lines(b.markdown(spark, d)).select("doc_id", "heading_path").distinct()


# limits


@query("SELECT query_id, count(*) AS n, max(fts_rank) AS last FROM kw GROUP BY query_id")
def G01_top_k_per_leg(spark, d):
    return _keyword(spark, d).groupBy("query_id").agg(F.count("*").alias("n"), F.max("fts_rank").alias("last"))


@query("SELECT query_id, chunk_id, rank FROM fr WHERE rank <= CASE WHEN query_id % 2 = 0 OR query_id % 3 <> 0 THEN greatest(4 * (query_id % 10), 24) ELSE query_id % 10 END")
def G02_fetch_k(spark, d):
    k = ranking.fetch_k((F.col("query_id") % 10).cast("int"), F.col("query_id") % 2 == 0, F.when(F.col("query_id") % 3 != 0, 2).otherwise(-1))
    return _fused(spark, d).filter(F.col("rank") <= k).select("query_id", "chunk_id", "rank")


@query("SELECT query_id, chunk_id, n::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM hyd) WHERE n <= 8")
def G03_limit(spark, d):
    return ranking.limited(_hydrated(spark, d).withColumn("limit", F.lit(8))).select("query_id", "chunk_id", "rank")


_MERGED = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(least(1, rrf / (2.0::DOUBLE / 61)), 9) DESC, source_name, rank) AS merged_rank FROM hyd"


@query(f"SELECT query_id, source_name AS kb, chunk_id, merged_rank::INTEGER AS merged_rank FROM ({_MERGED}) WHERE merged_rank <= 8")
def G04_merge_by_relevance(spark, d):
    hits = _hydrated(spark, d).withColumns({"kb": F.col("source_name"), "relevance": fn.relevance(F.col("rrf")), "limit": F.lit(8)})
    return ranking.merge_by_relevance(hits).select("query_id", "kb", "chunk_id", "merged_rank")


@query("SELECT rel_path, source_name FROM docs WHERE starts_with(rel_path, 'en/') AND rel_path > 'en/00000050.txt' ORDER BY rel_path, source_name LIMIT 50")
def G05_keyset_page(spark, d):
    return evaluate.keyset_page(b.docs(spark, d), "en/", ("en/00000050.txt", "~")).select("rel_path", "source_name")


@query(f"SELECT query_id, query, rank::INTEGER AS rank FROM ({_BY_KEYWORD}) WHERE rank = 0")
def G06_misses(spark, d):
    return evaluate.misses(_by_keyword(spark, d))


# set operations


@query(f"SELECT doc_id, count(*) AS n FROM (SELECT {_BLOCK_COLUMNS} FROM md_blocks UNION ALL SELECT {_BLOCK_COLUMNS} FROM wf_blocks) GROUP BY doc_id")
def H02_union_blocks(spark, d):
    return extract.markdown_blocks(b.markdown(spark, d)).unionByName(extract.whole_file_block(b.docs(spark, d))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT source_name, count(*) AS n FROM (SELECT source_name, rel_path FROM mnf EXCEPT ALL SELECT source_name, rel_path FROM lst) GROUP BY source_name")
def H03_except_listing(spark, d):
    return sync.deleted_paths(b.listing(spark, d), b.manifest(spark, d)).groupBy("source_name").agg(F.count("*").alias("n"))


@query("SELECT query_id, count(DISTINCT source_name) AS n FROM hyd GROUP BY query_id")
def H04_distinct_docs(spark, d):
    hits = _hydrated(spark, d).select("query_id", F.col("source_name").alias("rel_path"), "rank")
    return evaluate.first_n_unique_docs(hits, 2**31 - 1).groupBy("query_id").agg(F.count("*").alias("n"))


# scalar functions


@query("SELECT query_id, string_agg('\"' || text || '\"', ' OR ' ORDER BY phrase_no) AS match FROM words GROUP BY query_id")
def S01_sanitize_query(spark, d):
    return b.queries(spark, d).select("query_id", fn.match_string(F.col("query")).alias("match"))


@query(f"SELECT doc_id, array_to_string({b.TERMS}, ' ') AS terms FROM documents")
def S02_tokenize(spark, d):
    return b.docs(spark, d).select("doc_id", F.array_join(fn.tokenize(F.col("text")), " ").alias("terms"))


_NEXT = "FROM embeddings a JOIN embeddings z ON z.vec_id = a.vec_id + 1"


def _next(spark, d):
    v = b.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    return v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("z")), "vec_id")


@query(f"SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], z.embedding::DOUBLE[]), 6) AS dot {_NEXT}")
def S03_dot(spark, d):
    return _next(spark, d).select("vec_id", F.round(fn.dot(F.col("a"), F.col("z")), 6).alias("dot"))


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def S04_norm(spark, d):
    return b.table(spark, d, "embeddings").select("vec_id", F.round(fn.norm(F.col("embedding")), 6).alias("norm"))


@query(f"SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], z.embedding::DOUBLE[]), 6) AS cosine {_NEXT}")
def S05_cosine(spark, d):
    return _next(spark, d).select("vec_id", F.round(fn.cosine(F.col("a"), F.col("z")), 6).alias("cosine"))


@query("SELECT event_id, round(CASE WHEN value > 1 THEN 1 / (1 + exp(-value)) ELSE value END, 6) AS score FROM events")
def S06_sigmoid(spark, d):
    return b.table(spark, d, "events").select("event_id", F.round(fn.sigmoid(F.col("value"), F.col("value") > 1), 6).alias("score"))


@query("SELECT page_id, regexp_extract(url, '/([^/]*)$', 1) AS name, lower(regexp_extract(url, '(\\.[^./]*)$', 1)) AS ext, regexp_replace(regexp_replace(url, '^.*/', ''), '\\.[^.]*$', '') AS title FROM pages")
def S07_file_ext(spark, d):
    url = F.col("url")
    return b.table(spark, d, "pages").select("page_id", F.regexp_extract(url, "/([^/]*)$", 1).alias("name"), fn.file_ext(url).alias("ext"), fn.base_title(url).alias("title"))


@query("SELECT doc_id, regexp_matches(rel_path, '^(?:[^/]+/)*0000[0-3][^/]*[13579]\\.(?:txt|md)$') AS matches FROM docs")
def S08_glob_match(spark, d):
    return b.docs(spark, d).select("doc_id", fn.glob_match(F.col("rel_path"), "**/0000[0-3]*[13579].{txt,md}").alias("matches"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '{}' ELSE '{\"quality\":\"' || quality || '\",\"toxic\":\"' || toxic || '\"}' END AS json, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE CAST(quality AS VARCHAR) END AS back FROM labels")
def S09_metadata_codec(spark, d):
    m = F.when(F.col("doc_id") % 4 != 0, F.col("metadata"))
    rows = b.metadata(spark, d).select("doc_id", fn.metadata_to_json(m).alias("json"))
    return rows.select("doc_id", "json", fn.metadata_from_json(F.col("json"))["quality"].alias("back"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'file:///vault/' || rel_path WHEN 1 THEN 'https://git.example.org/r#main:' || rel_path WHEN 2 THEN 's3://bucket/notes/' || rel_path ELSE 'managed://kb/' || rel_path END AS uri FROM docs")
def S10_render_uri(spark, d):
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.col("doc_id") % 4 + 1).cast("int"))
    return b.docs(spark, d).select("doc_id", fn.render_uri(pick("file", "git", "s3", "managed"), pick("/vault", "https://git.example.org/r", "bucket/notes/", "kb"), F.lit("main"), F.col("rel_path")).alias("uri"))


@query("SELECT key, rel_path AS id FROM mg")
def S11_memory_id(spark, d):
    return b.writes(spark, d).select("key", fn.memory_id(F.col("ts"), F.col("key")).alias("id"))


@query("SELECT doc_id, sha256('Title: ' || rel_path || '\n\nDocument:\n' || left(text, 32000) || '\n\nChunk of this document:\n' || text || '\n\nSay in one or two sentences where this chunk stands in the document.') AS prompt_sha256 FROM docs")
def S12_context_prompt(spark, d):
    return b.docs(spark, d).select("doc_id", F.sha2(fn.context_prompt(F.col("rel_path"), F.col("text"), F.col("text")), 256).alias("prompt_sha256"))


@query("SELECT conv_id, turn, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 0 END AS level FROM conversations")
def S13_heading_level(spark, d):
    rows = b.paragraphs(spark, d)
    return rows.select(F.col("doc_id").alias("conv_id"), (F.col("para_no") - 1).cast("long").alias("turn"), fn.style_level(F.col("style")).alias("level"))


# streams: on events at rest, and on logs written from the tables

_BLANK = "trim(regexp_replace(content, '\\s+', ' ', 'g')) = ''"

_BURSTS = "SELECT kb, source_name, rel_path, count(*) AS n_events, max(ts) AS last_event, max(ts) + INTERVAL 30 MINUTE AS fires_at FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY kb, rel_path ORDER BY ts) AS burst FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY kb, rel_path ORDER BY ts) AS gap FROM logs)) GROUP BY kb, source_name, rel_path, burst"


@query(f"SELECT kb, source_name, rel_path, n_events, epoch_us(last_event) AS last_event, epoch_us(fires_at) AS fires_at FROM ({_BURSTS})")
def J02_debounce_paths(spark, d):
    out = debounce_paths(b.log(spark, d), gap="30 minutes")
    return out.withColumns({c: F.unix_micros(F.col(c).cast("timestamp")) for c in ("last_event", "fires_at")})


_NOTICED = "SELECT kb, source_name, rel_path || CASE WHEN seconds > 0.02 THEN '.md' ELSE '.png' END AS rel_path, ts FROM logs"


def _run(query):
    query.awaitTermination()


def _ledger(spark):
    return Ledger(spark, _path(spark, "ledger"))


@query(f"SELECT kb, source_name, rel_path, epoch_us(ts) // 1000 AS ts FROM ({_NOTICED}) WHERE rel_path LIKE '%.md'")
def J01_watch_source(spark, d):
    ext = F.when(F.col("seconds") > 0.02, ".md").otherwise(".png")
    log = _stored(b.log(spark, d).select("kb", "source_name", F.concat("rel_path", ext).alias("rel_path"), F.col("ts").cast("timestamp").alias("ts")), "log")
    out = _path(spark, "watched")
    _run(watch_source(spark, log).writeStream.format("parquet").option("path", out).option("checkpointLocation", _path(spark, "points")).trigger(availableNow=True).start())
    return spark.read.schema(EVENTS).parquet(out).withColumn("ts", F.unix_millis("ts"))


def _dirty_log(spark, d):
    """The dirty keys as events, one each second, and a last one far behind them, whose window stays open."""
    keys = b.dirty(spark, d).select(F.lit("vault").alias("kb"), "source_name", "rel_path", F.timestamp_seconds(F.lit(b.EPOCH) + F.pmod(F.xxhash64("rel_path"), F.lit(100_000))).alias("ts"))
    last = keys.limit(1).select("kb", F.lit("none").alias("source_name"), F.lit("last.txt").alias("rel_path"), F.timestamp_seconds(F.lit(b.EPOCH + 1_000_000)).alias("ts"))
    return _stored(keys.union(last), "log")


_ACTIONS = "source_name string, rel_path string, action string, size_bytes long, mtime long, content_sha256 string"


def _live(spark, d, ledger, log):
    fired = debounce_paths(watch_source(spark, log))
    return resync_on_fire(fired, lambda: b.listing(spark, d), lambda: b.manifest(spark, d), lambda actions, n: ledger.store("actions", n, actions), _path(spark, "points"))


@query("SELECT source_name, rel_path, action, size_bytes, mtime, content_sha256 FROM spath")
def J03_resync_on_fire(spark, d):
    ledger, log = _ledger(spark), _dirty_log(spark, d)
    for _ in range(2):  # without the first one's checkpoint the second sends every batch again
        _run(_live(spark, d, ledger, log))
    return ledger.read("actions", _ACTIONS).filter("source_name <> 'none'").drop("batch")


@query("SELECT source_name, rel_path, action, size_bytes, mtime, content_sha256 FROM diff")
def J04_poll_source(spark, d):
    ledger, root = _ledger(spark), _path(spark, "listings")
    listing = b.listing(spark, d)
    # a listing in three parts, each a batch, and after two of them a whole one that lacks half of its rows
    rows = listing.withColumns({"listing": F.lit(1).cast("long"), "total": F.lit(listing.count()).cast("long"), "part": F.pmod(F.xxhash64("rel_path"), F.lit(3))})
    schema = "source_name string, rel_path string, size_bytes long, mtime long, content_sha256 string, listing long, total long"
    start = lambda: poll_source(spark.readStream.schema(schema).parquet(root), lambda: b.manifest(spark, d), lambda diff, n: ledger.store("differences", n, diff), ledger, points)
    points = _path(spark, "points")
    for part in range(3):
        if part == 2:
            rows.filter("part = 0").withColumn("listing", F.lit(0).cast("long")).drop("part").write.mode("append").parquet(root)
            _run(start())
        rows.filter(F.col("part") == part).drop("part").write.mode("append").parquet(root)
        _run(start())
    return ledger.read("differences", _ACTIONS).drop("batch")


@query("SELECT kb, source_name, count(*) AS n_events FROM logs GROUP BY kb, source_name")
def J05_watch_event_counts(spark, d):
    return watch_event_counts(b.log(spark, d))


@query("SELECT 'initial' AS stage, source_name, rel_path, action FROM diff UNION ALL SELECT 'live', source_name, rel_path, action FROM spath")
def J06_initial_then_live(spark, d):
    ledger, log = _ledger(spark), _dirty_log(spark, d)
    _run(initial_then_live(lambda: ledger.store("initial", 0, sync.manifest_diff(b.listing(spark, d), b.manifest(spark, d))), lambda: _live(spark, d, ledger, log)))
    stages = [ledger.read(name, _ACTIONS).filter("source_name <> 'none'").select(F.lit(stage).alias("stage"), "source_name", "rel_path", "action") for stage, name in (("initial", "initial"), ("live", "actions"))]
    return stages[0].union(stages[1])


@query(f"SELECT kb, rel_path, title, CAST(strlen(content) AS BIGINT) AS size_bytes FROM mg WHERE kb <> 'frozen' AND NOT {_BLANK}")
def J07_managed_write_stream(spark, d):
    writes, ledger = _stored(b.writes(spark, d), "writes"), _ledger(spark)
    kbs = _kbs(spark, d)
    store = lambda batch, n: ledger.store("managed", n, sync.managed_documents(sync.writable_guard(batch, kbs)[0], F.col("kb")).select("kb", "rel_path", "title", "size_bytes"))
    for _ in range(2):  # every batch comes twice
        stream = spark.readStream.schema("key string, kb string, ts timestamp, title string, content string, metadata map<string,string>").json(writes)
        _run(managed_write_stream(stream, store, _path(spark, "points")))
    return ledger.read("managed", "kb string, rel_path string, title string, size_bytes long").drop("batch")


# whole jobs

_SEARCH = """SELECT query_id, n::INTEGER AS rank, doc_id, round(relevance, 6) AS relevance, fts_rank, vec_rank FROM (
  SELECT *, least(1, rrf / (2.0::DOUBLE / 61)) AS relevance, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM hyd WHERE rank <= 32 {where})
  WHERE n <= {limit} AND relevance >= {least}"""


def _shown(hits):
    return hits.select("query_id", "rank", "doc_id", F.round("relevance", 6).alias("relevance"), "fts_rank", "vec_rank")


@query("SELECT query_id, fts_rank AS rank, chunk_id AS doc_id, round(bm25, 6) AS bm25 FROM kw WHERE fts_rank <= 8")
def L01_keyword_search(spark, d):
    return _keyword(spark, d).filter("fts_rank <= 8").select("query_id", F.col("fts_rank").alias("rank"), F.col("chunk_id").alias("doc_id"), F.round("bm25", 6).alias("bm25"))


@query(_SEARCH.format(where="", limit=8, least=0))
def L01_search(spark, d):
    return _shown(plans.search(b.queries(spark, d), b.index(spark, d)))


@query(_SEARCH.format(where="AND coalesce(CAST(quality AS VARCHAR), '') = '1'", limit=5, least=0.47))
def L01_search_filtered(spark, d):
    asked = b.queries(spark, d).withColumns({"filter": F.create_map(F.lit("quality"), F.lit("1")), "limit": F.lit(5), "min_score": F.lit(0.47)})
    return _shown(plans.search(asked, b.index(spark, d)))


@query(f"""SELECT query_id, chunk_id AS doc_id, n::INTEGER AS rank, round(relevance, 6) AS relevance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(relevance, 9) DESC, pool_idx) AS n FROM ({_REL.replace("FROM hyd", "FROM hyd WHERE rank <= 32")})) WHERE n <= 8""")
def L03_search_reranked(spark, d):
    asked = b.queries(spark, d).withColumn("rerank", F.lit(True))
    return plans.search(asked, b.index(spark, d), _scores()).select("query_id", "doc_id", "rank", F.round("relevance", 6).alias("relevance"))


_ALL = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(least(1, rrf / (2.0::DOUBLE / 61)), 9) DESC, kb, rank) AS merged_rank FROM kfr WHERE rank <= 8"


@query(f"SELECT query_id, kb, chunk_id AS doc_id, merged_rank::INTEGER AS merged_rank FROM ({_ALL}) WHERE merged_rank <= 8")
def L02_search_all(spark, d):
    return plans.search_all(b.queries(spark, d), b.two_kbs(spark, d)).select("query_id", "kb", "doc_id", "merged_rank")


@query(f"SELECT query_id, kb, count(*) AS n FROM ({_ALL}) WHERE merged_rank <= 8 GROUP BY query_id, kb")
def H01_union_kbs(spark, d):
    return plans.search_all(b.queries(spark, d), b.two_kbs(spark, d)).groupBy("query_id", "kb").agg(F.count("*").alias("n"))


_SHOWN = "t.source_name, t.rel_path, c.seq, c.start_line, c.end_line, c.text, CAST(length(c.text) AS DOUBLE) AS size"


def _synced(base):
    """Chunks of a base with their documents and vectors."""
    rows = base.chunks.join(base.docs.select("doc_id", "source_name", "rel_path"), "doc_id").join(base.vectors, "chunk_id")
    return rows.select("source_name", "rel_path", "seq", "start_line", "end_line", "text", F.col("embedding")[0].cast("double").alias("size"))


@query(f"SELECT {_SHOWN} FROM ck c JOIN docs t ON t.doc_id = c.doc_id WHERE t.doc_id % 10 <> 9", ("wf_blocks", 512, 64))
def L04_sync_source(spark, d):
    return _synced(plans.sync_source(b.listing(spark, d), b.old_base(spark, d), b.contents_of(spark, d), b.lengths_embedder, 2)[0])


_UNREAD = "CASE WHEN CAST(substr(rel_path, -6, 2) AS INTEGER) % 3 = 0 THEN 1 ELSE 0 END"


@query(f"""SELECT source_name, count_if(action = 'index' AND {_UNREAD} = 0) AS indexed, count_if(action = 'delete') AS deleted, count_if(action IN ('skip', 'touch')) AS skipped, count_if(action = 'index' AND {_UNREAD} = 1) AS failed FROM diff GROUP BY source_name""")
def L04_sync_with_failures(spark, d):
    return plans.sync_source(b.listing(spark, d), b.old_base(spark, d), b.broken_contents_of(spark, d), b.lengths_embedder, 2)[1]


_AFTER_FAILURES = f"SELECT source_name, rel_path, doc_id % 10 AS k, {_UNREAD} AS unread, text FROM docs WHERE doc_id % 10 <> 9"


@query(f"SELECT source_name, rel_path, length(regexp_replace(CASE WHEN k = 2 AND unread = 1 THEN text || 'old' ELSE text END, '\n+\\z', ''))::BIGINT AS n_chars, false AS known FROM ({_AFTER_FAILURES}) WHERE NOT (k = 8 AND unread = 1) AND trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''")
def L04_failures_keep_old_rows(spark, d):
    whole = {"max_tokens": 1 << 30, "overlap": 0}
    after, _ = plans.sync_source(b.listing(spark, d), b.old_base(spark, d, **whole), b.broken_contents_of(spark, d), b.lengths_embedder, 2, **whole)
    rows = after.chunks.join(after.docs.select("doc_id", "source_name", "rel_path"), "doc_id").join(after.vectors, "chunk_id")
    return rows.select("source_name", "rel_path", F.length("text").cast("long").alias("n_chars"), (F.col("embedding")[0] != F.length("text")).alias("known"))


def _sql_after_sync():
    """The keyword leg over the listed documents, whose chunks have the ids that a sync gives them."""
    key = "length(source) || ':' || source || length(path) || ':' || path"
    corpus = f"corpus AS (SELECT left(sha256({key}), 32) || '-000000000' AS cid, path, text FROM (SELECT *, lang || '/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.txt' AS path FROM documents WHERE doc_id % 10 <> 9))"
    text = b.sql("SELECT query_id, fts_rank, path AS rel_path, round(bm25, 6) AS bm25 FROM kw JOIN corpus ON cid = chunk_id")
    return text.replace("doc_id AS chunk_id", "cid AS chunk_id").replace("FROM documents", "FROM corpus").replace("WITH RECURSIVE ", f"WITH RECURSIVE {corpus},\n", 1)


def L04_search_after_sync(spark, d):
    """A sync adds a segment to a stored index; a search of both segments, and of the two made one, gives the same hits."""
    whole = {"max_tokens": 1 << 30, "overlap": 0}
    base = b.old_base(spark, d, **whole)
    old = plans.Index(base.docs.select("doc_id", "source_name", "rel_path", "title"), base.chunks, base.vectors).write(_path(spark, "synced"))
    new, _, _ = plans.sync_index(b.listing(spark, d), old, base.manifest, b.contents_of(spark, d), b.lengths_embedder, 2, **whole)
    hits = lambda i: ranking.ranked(keyword.best(b.queries(spark, d), i.postings, i.lengths, i.stats, i.terms, ranking.CANDIDATES), "bm25", "fts_rank", ranking.CANDIDATES)
    both = hits(new).join(hits(new.merged()).select("query_id", "chunk_id", F.col("fts_rank").alias("merged_rank")), ["query_id", "chunk_id"], "full_outer").filter("fts_rank <=> merged_rank")
    found = both.join(new.chunks.select("chunk_id", "doc_id"), "chunk_id").join(new.docs.select("doc_id", "rel_path"), "doc_id")
    return found.select("query_id", "fts_rank", "rel_path", F.round("bm25", 6).alias("bm25"))


_FOUND["L04_search_after_sync"] = L04_search_after_sync, _sql_after_sync()


@query("SELECT source_name, rel_path, size_bytes, mtime, content_sha256 FROM lst")
def L04_sync_manifest(spark, d):
    return plans.sync_source(b.listing(spark, d), b.old_base(spark, d), b.contents_of(spark, d), b.lengths_embedder, 2)[0].manifest


@query(f"SELECT {_SHOWN} FROM ck c JOIN docs t ON t.doc_id = c.doc_id WHERE t.doc_id % 10 <> 8", ("wf_blocks", 512, 64))
def L05_sync_paths(spark, d):
    return _synced(plans.sync_paths(b.dirty(spark, d), b.listing(spark, d), b.old_base(spark, d), b.contents_of(spark, d), b.lengths_embedder, 2)[0])


def _sql_stored():
    """The writes as markdown, cut as every document is; of a text that takes several chunks the first one is shown."""
    writes = {"wr": b.SQL["wr"], "mg": b.SQL["mg"], "md": f"SELECT key AS doc_id, content AS text FROM mg WHERE kb <> 'frozen' AND NOT {_BLANK}"}
    return b.sql(f"""SELECT m.kb, m.rel_path, m.title, CAST(strlen(m.content) AS BIGINT) AS size_bytes, c.text FROM mg m JOIN ck c ON c.doc_id = m.key WHERE c.seq = 0
  UNION ALL SELECT kb, rel_path, title, 8, 'old text' FROM mg WHERE kb = 'notes' AND key LIKE '%-0' AND {_BLANK}""", ("md_blocks", 512, 64), writes)


def L06_store_documents(spark, d):
    """Each stored document with its first chunk."""
    base, _ = plans.store_documents(b.writes(spark, d), _kbs(spark, d), b.managed_base(spark, d), b.lengths_embedder, 2)
    texts = base.chunks.join(base.vectors, "chunk_id").groupBy("doc_id").agg(F.min_by("text", "seq").alias("text"))
    return base.docs.join(texts, "doc_id").select("kb", "rel_path", "title", "size_bytes", "text")


_FOUND["L06_store_documents"] = L06_store_documents, _sql_stored()


@query("SELECT kb, rel_path FROM (SELECT kb, rel_path, title FROM mg UNION ALL SELECT kb || '2', rel_path, title FROM mg) WHERE NOT (kb = 'notes' AND title = 'user')")
def L07_delete_documents(spark, d):
    docs = sync.managed_documents(b.writes(spark, d), F.col("kb"))
    docs = docs.union(docs.withColumn("kb", F.concat("kb", F.lit("2")))).withColumn("doc_id", fn.document_id("kb", "rel_path"))
    return plans.delete_managed(docs, _kbs(spark, d), docs.filter("title = 'user' and kb in ('notes', 'frozen')").select("kb", "rel_path"))[0].select("kb", "rel_path")


@query("SELECT rel_path, array_to_string(string_split(text, '\n')[2:4], '\n') AS text FROM docs")
def L08_get_document(spark, d):
    docs = b.docs(spark, d).drop("text")
    keys = docs.select("rel_path", F.lit(None).cast("string").alias("source_name"), F.lit(2).alias("start"), F.lit(4).alias("end"))
    return evaluate.get_document(docs, b.chunks(spark, d).withColumn("seq", F.lit(0)), keys).select("rel_path", "text")


@query("SELECT rel_path FROM docs WHERE starts_with(lower(rel_path), 'de/') ORDER BY rel_path, source_name LIMIT 50")
def L09_list_documents(spark, d):
    return evaluate.keyset_page(b.docs(spark, d), "DE/").select("rel_path")


@query("SELECT lang AS kb, count(*) AS documents, count(*) AS chunks FROM documents GROUP BY lang UNION ALL SELECT 'none', 0, 0")
def L10_list_knowledge_bases(spark, d):
    docs = b.table(spark, d, "documents").select(F.col("lang").alias("kb"), F.col("doc_id").alias("indexed_at"))
    kbs = docs.select("kb").distinct()
    return evaluate.kb_stats(kbs.union(kbs.limit(1).select(F.lit("none"))), docs, docs).drop("last_indexed_at")


_HYBRID = _RANKS.format(hits="SELECT query_id, rel_path, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM hyd WHERE rank <= 80")


@query(f"SELECT query_id, query, rank::INTEGER AS rank FROM ({_HYBRID})")
def L11_evaluate(spark, d):
    return plans.run_evaluation(b.golden(spark, d), b.index(spark, d))[0]


@query(f"SELECT round(avg(CASE WHEN z.rank = 1 THEN 1.0::DOUBLE ELSE 0 END) - avg(CASE WHEN a.rank = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_at_1, round(avg(CASE WHEN z.rank > 0 THEN 1.0::DOUBLE ELSE 0 END) - avg(CASE WHEN a.rank > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_at_n, round(avg(CASE WHEN z.rank > 0 THEN 1.0::DOUBLE / z.rank ELSE 0 END) - avg(CASE WHEN a.rank > 0 THEN 1.0::DOUBLE / a.rank ELSE 0 END), 6) AS mrr FROM ({_BY_KEYWORD}) a JOIN ({_HYBRID}) z ON z.query_id = a.query_id")
def L12_compare_runs(spark, d):
    out = plans.compare_runs(_by_keyword(spark, d), plans.run_evaluation(b.golden(spark, d), b.index(spark, d))[0])[0]
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query(f"SELECT count(*) AS queries, count(*) FILTER (z.rank > 0) AS new_hits, count(*) FILTER (a.rank > 0) AS legacy_hits, count(*) FILTER (z.rank > 0) >= count(*) FILTER (a.rank > 0) AS pass FROM ({_BY_KEYWORD}) a JOIN ({_BY_VECTOR}) z ON z.query_id = a.query_id")
def L13_parity(spark, d):
    return plans.parity(b.golden(spark, d), _ranks(spark, d, _vector), _ranks(spark, d, _keyword))


@query(f"SELECT {_SHOWN} FROM ck c JOIN docs t ON t.doc_id = c.doc_id WHERE t.doc_id % 10 <> 9", ("wf_blocks", 512, 64))
def L14_rebuild(spark, d):
    return _synced(plans.rebuild(b.listing(spark, d), b.old_base(spark, d), b.contents_of(spark, d), b.lengths_embedder, 2)[0])
