"""What the given tables stand for: documents, markdown, manifests, vectors, golden queries and logs, in Spark and in SQL.

``SQL`` has the same tables as DuckDB common table expressions; ``sql`` puts those that a query needs before it.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ACCENTED, PLAIN, document_id
from .operators import keyword
from .operators.ranking import read_embeddings
from .operators.sync import managed_documents
from .plans import Base, Index, index_documents
from .sources import shared_dir

EPOCH = 1_704_067_200
DIM = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source_name, rel_path, text)."""
    path = F.concat("lang", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("source_name"), path.alias("rel_path"), "text")


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, rel_path, text): a markdown file for each conversation, some with front matter, fences and deep headings."""
    kind = (F.col("conv_id") + F.col("turn")) % 5
    body = (
        F.when(kind == 0, F.concat(F.lit("```\n# not a heading\n"), "text", F.lit("\n```")))
        .when(kind == 1, F.concat(F.lit("~~~\n```\n### inside\n"), "text", F.lit("\n~~~")))
        .when(kind == 2, F.concat(F.lit("### Deep "), "turn", F.lit(" #\n"), "text"))
        .otherwise(F.col("text"))
    )
    turn = F.concat(F.lit("## Turn "), "turn", F.lit(" "), "role", F.lit("\n"), body)
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))), lambda x: x.t), "\n").alias("turns"))
    front = F.when(F.col("conv_id") % 7 == 3, "---\nopen: yes\n").when(F.col("conv_id") % 3 == 0, "---\nclosed: yes\n---\n").otherwise("")
    text = F.concat(front, F.lit("# Conversation "), "conv_id", F.lit("\n\n"), "turns")
    return turns.select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("chats/"), "conv_id", F.lit(".md")).alias("rel_path"), text.alias("text"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_no, text): conversations as page texts; every third page has none."""
    page = F.col("turn") + 1
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), page.cast("int").alias("page_no"), F.when(page % 3 == 0, " ").otherwise(F.col("text")).alias("text"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_no, text): what was read from the pages without text."""
    page = F.col("turn") + 1
    return table(spark, sf_dir, "conversations").filter(page % 3 == 0).select(F.col("conv_id").alias("doc_id"), page.cast("int").alias("page_no"), F.when(F.col("conv_id") % 4 == 0, "[no text]").otherwise(F.col("text")).alias("text"))


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, para_no, style, text): conversations as styled paragraphs."""
    style = F.when(F.col("role") == "system", "Heading 1").when(F.col("role") == "user", "heading2").otherwise("Normal")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("para_no"), style.alias("style"), "text")


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_name, rel_path, size_bytes, mtime, content_sha256): documents as files; by the last digit of the id, 9 is gone,
    1 and 2 have a new time."""
    d = docs(spark, sf_dir).filter(F.col("doc_id") % 10 != 9)
    mtime = F.lit(EPOCH) + F.col("doc_id") + F.when((F.col("doc_id") % 10).isin(1, 2), 3600).otherwise(0)
    return d.select("source_name", "rel_path", F.octet_length("text").cast("long").alias("size_bytes"), mtime.alias("mtime"), F.sha2("text", 256).alias("content_sha256"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of an earlier sync: 8 wasn't there, 2 had another text."""
    d = docs(spark, sf_dir).filter(F.col("doc_id") % 10 != 8)
    edited = F.col("doc_id") % 10 == 2
    size = F.octet_length("text").cast("long") + F.when(edited, 3).otherwise(0)
    return d.select("source_name", "rel_path", size.alias("size_bytes"), (F.lit(EPOCH) + F.col("doc_id")).alias("mtime"), F.when(edited, F.sha2(F.concat("text", F.lit("old")), 256)).otherwise(F.sha2("text", 256)).alias("content_sha256"))


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that events name: every fifth document and one path that doesn't exist."""
    d = docs(spark, sf_dir).filter(F.col("doc_id") % 5 < 3).select("source_name", "rel_path")
    return d.union(d.agg(F.lit("src0").alias("source_name"), F.lit("nowhere.txt").alias("rel_path")))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, metadata) from labels."""
    m = F.create_map(F.lit("quality"), F.col("quality").cast("string"), F.lit("toxic"), F.col("toxic").cast("string"))
    return table(spark, sf_dir, "labels").select("doc_id", m.alias("metadata"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk for each document."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "doc_id", "text", F.lit("").alias("heading_path"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_embeddings(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"), DIM)


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as queries, with the vector of the same number."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("query_vec"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return items.join(v, F.col("query_id") == F.col("vec_id"), "left").select("query_id", "query", "query_vec")


_STORED: dict[tuple, str] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make) -> Index:
    """An index of ``sf_dir``, built and stored by the first query of a session that needs it."""
    known = (spark.sparkContext.applicationId, sf_dir, name)
    if known not in _STORED:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        make().write(path)
        _STORED[known] = path
    return Index.read(spark, _STORED[known])


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).drop("text").join(metadata(spark, sf_dir), "doc_id", "left")


def index(spark: SparkSession, sf_dir: str) -> Index:
    return _once(spark, sf_dir, "index", lambda: Index(_described(spark, sf_dir), chunks(spark, sf_dir), vectors(spark, sf_dir)))


def two_kbs(spark: SparkSession, sf_dir: str) -> Index:
    """The documents in two knowledge bases, by even and odd ids."""
    return _once(spark, sf_dir, "kbs", lambda: Index(_described(spark, sf_dir).withColumn("kb", F.concat(F.lit("kb"), F.col("doc_id") % 2)), chunks(spark, sf_dir), vectors(spark, sf_dir)))


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query, query_vec, expect): paths of the documents that contain the item.

    An item's words but the first and last are whole words of such a document; the first four of them are looked up among
    the runs of words of all documents, and only what has one is searched.  Items of one or two words have no such run and are
    searched for in all documents."""
    words = lambda c: F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")
    run = lambda w, i, n: F.array_join(F.slice(w, i, n), " ")
    q = queries(spark, sf_dir)
    asked = q.select("query_id", "query", words(F.col("query")).alias("w")).withColumn("n", F.least(F.size("w") - 2, F.lit(4)))
    first = asked.filter("n > 0").select("query_id", "query", run("w", F.lit(2), F.col("n")).alias("run"), "n")
    known = first.select("n", "run").distinct().limit(keyword.LISTED + 1).collect()  # bounded
    d = docs(spark, sf_dir)
    held = d.select("doc_id", "rel_path", "text", words(F.col("text")).alias("w"))
    # runs are put together only where a word stands that begins one
    begins = F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1)))
    if 0 < len(known) <= keyword.LISTED:
        begins = F.filter(begins, lambda i: F.get("w", i - 1).isin(sorted({r.run.split(" ")[0] for r in known})))
    runs = lambda n: F.transform(begins, lambda i: run("w", i, n))
    found = F.flatten(F.array(*map(runs, sorted({r.n for r in known})))) if known else F.array().cast("array<string>")
    if 0 < len(known) <= keyword.LISTED:
        found = F.filter(found, lambda r: r.isin([k.run for k in known]))
    runs_of = lambda *cs: held.select(*cs, F.explode(F.array_distinct(found)).alias("run"))
    if first.count() <= keyword.LISTED:  # queries are sent to the documents, no text is shuffled
        pairs = runs_of("rel_path", "text").join(F.broadcast(first), "run")
    else:
        pairs = runs_of("doc_id").join(first, "run").select("query_id", "query", "doc_id").distinct().join(d, "doc_id")
    short = asked.filter("n <= 0").select("query_id", "query")
    matched = pairs.filter(F.contains("text", "query")).select("query_id", "rel_path")
    if not short.isEmpty():
        matched = matched.union(d.join(F.broadcast(short), F.contains("text", "query")).select("query_id", "rel_path"))
    expect = matched.groupBy("query_id").agg(F.array_sort(F.collect_set("rel_path")).alias("expect"))
    return q.join(expect, "query_id", "left").withColumn("expect", F.coalesce("expect", F.array().cast("array<string>")))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rel_path, length, content): documents as files, some of other kinds, in folders with a dot or outside of the root."""
    n = F.col("doc_id") % 6
    ext = F.element_at(F.array(*map(F.lit, (".md", ".txt", ".GO", ".png", ".drawio", ".md"))), (n + 1).cast("int"))
    folder = F.when(F.col("doc_id") % 7 == 0, ".hidden/").when(F.col("doc_id") % 11 == 0, "../").when(F.col("doc_id") % 13 == 0, "a/.git/").otherwise("notes/")
    return docs(spark, sf_dir).select(F.concat(folder, "source_name", F.lit("-"), "doc_id", ext).alias("rel_path"), F.octet_length("text").cast("long").alias("length"), F.encode("text", "UTF-8").alias("content"))


def old_base(spark: SparkSession, sf_dir: str, **cut) -> Base:
    """The tables of the earlier sync that ``manifest`` tells of."""
    d = docs(spark, sf_dir).filter(F.col("doc_id") % 10 != 8)
    was = d.withColumns({"text": F.when(F.col("doc_id") % 10 == 2, F.concat("text", F.lit("old"))).otherwise(F.col("text")), "doc_id": document_id("source_name", "rel_path"), "title": F.lit("t")})
    made, vecs = index_documents(was, lengths_embedder, 2, **cut)
    return Base(was.drop("text"), made, vecs, manifest(spark, sf_dir))


def managed_base(spark: SparkSession, sf_dir: str) -> Base:
    """A knowledge base that holds an older text of the first write of each conversation."""
    was = writes(spark, sf_dir).filter("kb = 'notes' and endswith(key, '-0')").withColumn("content", F.lit("old text"))
    d = managed_documents(was, F.col("kb")).withColumn("doc_id", document_id("kb", "source_name", "rel_path"))
    made, vecs = index_documents(d.select("doc_id", F.concat("rel_path", F.lit(".md")).alias("rel_path"), "title", F.col("content").alias("text")), lengths_embedder, 2)
    return Base(d, made, vecs, d.select("kb", "source_name", "rel_path", "size_bytes", "mtime", "content_sha256"))


def contents_of(spark: SparkSession, sf_dir: str):
    """Reads the texts of keys."""
    return lambda keys: docs(spark, sf_dir).select("source_name", "rel_path", "text").join(keys, ["source_name", "rel_path"], "left_semi")


def broken_contents_of(spark: SparkSession, sf_dir: str):
    """Reads the texts of keys; every third can't be read, with an error, without a text, or not at all."""

    def read(keys: DataFrame) -> DataFrame:
        n = F.substring("rel_path", -6, 2).cast("int")
        rows = contents_of(spark, sf_dir)(keys).withColumn("n", n).filter("n % 9 <> 6")
        return rows.select("source_name", "rel_path", F.when(F.col("n") % 9 != 3, F.col("text")).alias("text"), F.when(F.col("n") % 9 == 0, "refused").alias("error"))

    return read


def lengths_embedder(texts: list[str]) -> np.ndarray:
    """In place of a model: a text's length and twice that."""
    return np.array([[len(t), 2 * len(t)] for t in texts])


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kb, op, seconds, source_name, rel_path, ts) from events."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("kb"), F.when(F.col("value") > 50, "search").otherwise("get").alias("op"), (F.col("value") / 1000).alias("seconds"), F.lit("vault").alias("source_name"), F.col("user_id").cast("string").alias("rel_path"), "ts")


def writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent-written texts from conversations; every eleventh is blank, and a third go to a knowledge base that can't be
    written."""
    c = table(spark, sf_dir, "conversations")
    key = F.concat_ws("-", "conv_id", "turn")
    kb = F.when(F.col("conv_id") % 3 == 0, "frozen").otherwise("notes")
    return c.select(key.alias("key"), kb.alias("kb"), F.timestamp_seconds(F.lit(EPOCH) + F.col("conv_id") * 60 + F.col("turn")).alias("ts"), F.col("role").alias("title"), F.when((F.col("conv_id") + F.col("turn")) % 11 == 0, " \n ").otherwise(F.col("text")).alias("content"), F.create_map(F.lit("agent"), "role").alias("metadata"))


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _tokens(x: str) -> str:
    return f"CAST(CASE WHEN length({x}) > 0 THEN greatest(1, strlen({x}) // 4) ELSE 0 END AS INTEGER)"


TERMS = f"regexp_extract_all(translate(lower(text), '{ACCENTED}', '{PLAIN}'), '[\\p{{L}}\\p{{N}}]+')"
_P = [f"last_value(CASE WHEN level = {n} THEN line_no END IGNORE NULLS) OVER w AS p{n}, last_value(CASE WHEN level = {n} THEN heading END IGNORE NULLS) OVER w AS h{n}" for n in range(1, 7)]
_LIVE = [f"CASE WHEN p{n} > greatest(0, {', '.join(f'coalesce(p{k}, 0)' for k in range(1, n)) or '0'}) AND h{n} <> '' THEN h{n} END" for n in range(1, 7)]

#: Common table expressions; later ones may use earlier ones.
SQL = {
    "docs": "SELECT doc_id, source AS source_name, lang || '/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.txt' AS rel_path, text FROM documents",
    "md": """SELECT conv_id AS doc_id, 'chats/' || conv_id || '.md' AS rel_path,
      CASE WHEN conv_id % 7 = 3 THEN '---\nopen: yes\n' WHEN conv_id % 3 = 0 THEN '---\nclosed: yes\n---\n' ELSE '' END || '# Conversation ' || conv_id || '\n\n' ||
      string_agg('## Turn ' || turn || ' ' || role || '\n' || CASE (conv_id + turn) % 5 WHEN 0 THEN '```\n# not a heading\n' || text || '\n```'
        WHEN 1 THEN '~~~\n```\n### inside\n' || text || '\n~~~' WHEN 2 THEN '### Deep ' || turn || ' #\n' || text ELSE text END, '\n' ORDER BY turn) AS text
      FROM conversations GROUP BY conv_id""",
    "md_all": "SELECT doc_id, CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS line_no, unnest(l) AS line FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '\\r?\\n\\z', ''), '\\r?\\n') AS l FROM md WHERE regexp_replace(text, '\\r?\\n\\z', '') <> '')",
    "md_ends": f"SELECT doc_id, bool_or(line_no = 1 AND {_trim('line')} = '---') AS opens, min(CASE WHEN line_no > 1 AND {_trim('line')} IN ('---', '...') THEN line_no END) AS last FROM md_all GROUP BY doc_id",
    "md_lines": "SELECT a.doc_id, a.line_no, a.line FROM md_all a JOIN md_ends e USING (doc_id) WHERE NOT e.opens OR a.line_no > e.last",
    "md_marks": f"SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS rn, CASE WHEN left({_trim('line')}, 3) IN ('```', '~~~') THEN left({_trim('line')}, 3) ELSE '' END AS mark FROM md_lines",
    "md_fenced": """SELECT doc_id, rn, line_no, line, mark AS open, mark <> '' AS fenced FROM md_marks WHERE rn = 1
      UNION ALL SELECT m.doc_id, m.rn, m.line_no, m.line, CASE WHEN f.open = '' THEN m.mark WHEN f.open = m.mark THEN '' ELSE f.open END, f.open <> '' OR m.mark <> ''
      FROM md_fenced f JOIN md_marks m ON m.doc_id = f.doc_id AND m.rn = f.rn + 1""",
    "md_found": f"SELECT doc_id, line_no, line, fenced, CASE WHEN fenced THEN 0 ELSE CAST(length(regexp_extract({_trim('line')}, '^(#{{1,6}}) ([\\s\\S]*)$', 1)) AS INTEGER) END AS level, {_trim("rtrim(regexp_extract(" + _trim('line') + ", '^(#{1,6}) ([\\s\\S]*)$', 2), '#')")} AS text_ FROM md_fenced",
    "md_heads": "SELECT doc_id, line_no, line, fenced, level, CASE WHEN level > 0 THEN text_ END AS heading FROM md_found",
    "md_stack": f"SELECT *, {', '.join(_P)} FROM md_heads WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)",
    "md_paths": f"SELECT doc_id, line_no, line, level, heading, concat_ws(' > ', {', '.join(_LIVE)}) AS heading_path FROM md_stack",
    "md_numbered": "SELECT *, CAST(sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS INTEGER) AS block_no FROM md_paths",
    "md_grouped": f"SELECT doc_id, block_no, min_by(heading_path, line_no) AS heading_path, min(line_no) AS start_line, max(line_no) AS end_line, {_trim("string_agg(line, '\n' ORDER BY line_no)")} AS text FROM md_numbered GROUP BY doc_id, block_no",
    "md_blocks": "SELECT * FROM md_grouped WHERE text <> ''",
    "wf_blocks": f"SELECT doc_id, 0 AS block_no, '' AS heading_path, 1 AS start_line, CAST(len(string_split(regexp_replace(text, '\n\\z', ''), '\n')) AS INTEGER) AS end_line, regexp_replace(text, '\n+\\z', '') AS text FROM (SELECT doc_id, replace(text, '\r\n', '\n') AS text FROM documents) WHERE {_trim('text')} <> ''",
    "pg": "SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS page_no, CASE WHEN (turn + 1) % 3 = 0 THEN ' ' ELSE text END AS text FROM conversations",
    "pg_trim": f"SELECT doc_id, page_no, {_trim('text')} AS text FROM pg",
    "pg_scan": "SELECT doc_id, page_no FROM pg_trim WHERE coalesce(strlen(text) < 20, true)",
    "pg_kept": "SELECT *, CAST(len(string_split(text, '\n')) AS INTEGER) AS n FROM pg_trim WHERE strlen(text) >= 20",
    "pg_start": "SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS INTEGER) AS start_line FROM pg_kept",
    "pg_blocks": "SELECT doc_id, page_no AS block_no, 'Page ' || page_no AS heading_path, start_line, start_line + n - 1 AS end_line, text FROM pg_start",
    "fls": "SELECT CASE WHEN doc_id % 7 = 0 THEN '.hidden/' WHEN doc_id % 11 = 0 THEN '../' WHEN doc_id % 13 = 0 THEN 'a/.git/' ELSE 'notes/' END || source_name || '-' || doc_id || ['.md', '.txt', '.GO', '.png', '.drawio', '.md'][doc_id % 6 + 1] AS rel_path, CAST(strlen(text) AS BIGINT) AS size_bytes, text FROM docs",
    "lst": f"SELECT source_name, rel_path, CAST(strlen(text) AS BIGINT) AS size_bytes, {EPOCH} + doc_id + CASE WHEN doc_id % 10 IN (1, 2) THEN 3600 ELSE 0 END AS mtime, sha256(text) AS content_sha256 FROM docs WHERE doc_id % 10 <> 9",
    "mnf": f"SELECT source_name, rel_path, CAST(strlen(text) AS BIGINT) + CASE WHEN doc_id % 10 = 2 THEN 3 ELSE 0 END AS size_bytes, {EPOCH} + doc_id AS mtime, CASE WHEN doc_id % 10 = 2 THEN sha256(text || 'old') ELSE sha256(text) END AS content_sha256 FROM docs WHERE doc_id % 10 <> 8",
    "diff": """SELECT coalesce(l.source_name, m.source_name) AS source_name, coalesce(l.rel_path, m.rel_path) AS rel_path,
      CASE WHEN l.rel_path IS NULL THEN 'delete' WHEN l.size_bytes = m.size_bytes AND l.mtime = m.mtime THEN 'skip' WHEN l.content_sha256 = m.content_sha256 THEN 'touch' ELSE 'index' END AS action,
      l.size_bytes, l.mtime, l.content_sha256 FROM lst l FULL JOIN mnf m ON l.source_name = m.source_name AND l.rel_path = m.rel_path""",
    "drt": "SELECT source_name, rel_path FROM docs WHERE doc_id % 5 < 3 UNION SELECT 'src0', 'nowhere.txt'",
    "spath": """SELECT d.source_name, d.rel_path, CASE WHEN l.rel_path IS NOT NULL AND m.rel_path IS NOT NULL AND l.content_sha256 = m.content_sha256 THEN 'touch' WHEN l.rel_path IS NOT NULL THEN 'index'
      WHEN m.rel_path IS NOT NULL THEN 'delete' ELSE 'ignore' END AS action, l.size_bytes, l.mtime, l.content_sha256
      FROM drt d LEFT JOIN lst l ON l.source_name = d.source_name AND l.rel_path = d.rel_path LEFT JOIN mnf m ON m.source_name = d.source_name AND m.rel_path = d.rel_path""",
    "post": f"SELECT chunk_id, unnest(tok) AS term, unnest(range(len(tok))) AS pos FROM (SELECT doc_id AS chunk_id, {TERMS} AS tok FROM documents)",
    "lens": f"SELECT doc_id AS chunk_id, CAST(len({TERMS}) AS BIGINT) AS n_tokens FROM documents",
    "stats": "SELECT count(*) AS n_chunks, avg(n_tokens) AS avgdl FROM lens",
    "words": "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY i) - 1 AS phrase_no, word AS text FROM (SELECT query_id, i, regexp_replace(w, '^[-._]+|[-._]+$', '', 'g') AS word FROM (SELECT item_id AS query_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT item_id, regexp_split_to_array(text, '[^A-Za-z0-9_.\\-\\x{80}-\\x{10FFFF}]+') AS ws FROM benchmark))) WHERE word <> ''",
    "phr": f"SELECT query_id, phrase_no, {TERMS} AS phrase FROM words WHERE len({TERMS}) > 0",
    "ptok": "SELECT phrase, len(phrase) AS n, unnest(phrase) AS term, unnest(range(len(phrase))) AS token_no FROM (SELECT DISTINCT phrase FROM phr)",
    "runs": "SELECT phrase, n, chunk_id, pos - token_no AS start, count(*) AS m FROM post JOIN ptok USING (term) GROUP BY ALL",
    "mat": "SELECT phrase, chunk_id, count(*) AS freq FROM runs WHERE m = n GROUP BY phrase, chunk_id",
    "dfs": "SELECT phrase, count(*) AS df FROM mat GROUP BY phrase",
    "bm": """SELECT p.query_id, m.chunk_id, sum(greatest(1e-6, ln((n_chunks - df + 0.5) / (df + 0.5))) * freq * 2.2::DOUBLE / (freq + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n_tokens / avgdl))) AS bm25
      FROM phr p JOIN mat m USING (phrase) JOIN dfs USING (phrase) JOIN lens USING (chunk_id) CROSS JOIN stats GROUP BY p.query_id, m.chunk_id""",
    "kw": "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, chunk_id) AS INTEGER) AS fts_rank FROM bm) WHERE fts_rank <= 50",
    "qv": "SELECT item_id AS query_id, b.text AS query, e.embedding AS v FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id",
    "cosines": "SELECT query_id, vec_id AS chunk_id, list_dot_product(v::DOUBLE[], embedding::DOUBLE[]) / (sqrt(list_dot_product(v::DOUBLE[], v::DOUBLE[])) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS cosine FROM qv, embeddings WHERE v IS NOT NULL",
    "vk": "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, chunk_id) AS INTEGER) AS vec_rank FROM cosines) WHERE vec_rank <= 50",
    "rrf": "SELECT query_id, chunk_id, coalesce(1.0::DOUBLE / (60 + fts_rank), 0::DOUBLE) + coalesce(1.0::DOUBLE / (60 + vec_rank), 0::DOUBLE) AS rrf, coalesce(fts_rank, 0) AS fts_rank, coalesce(vec_rank, 0) AS vec_rank FROM kw FULL JOIN vk USING (query_id, chunk_id)",
    "fr": "SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 9) DESC, chunk_id) AS INTEGER) AS rank FROM rrf",
    "hyd": "SELECT f.*, d.doc_id, d.source_name, d.rel_path, d.text, l.quality, l.toxic FROM fr f JOIN docs d ON d.doc_id = f.chunk_id LEFT JOIN labels l ON l.doc_id = d.doc_id",
    "kst": "SELECT chunk_id % 2 AS kb, count(*) AS n_chunks, avg(n_tokens) AS avgdl FROM lens GROUP BY 1",
    "kdf": "SELECT phrase, chunk_id % 2 AS kb, count(*) AS df FROM mat GROUP BY phrase, chunk_id % 2",
    "kbm": """SELECT p.query_id, m.chunk_id % 2 AS kb, m.chunk_id, sum(greatest(1e-6, ln((n_chunks - df + 0.5) / (df + 0.5))) * freq * 2.2::DOUBLE / (freq + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n_tokens / avgdl))) AS bm25
      FROM phr p JOIN mat m USING (phrase) JOIN kdf f ON f.phrase = m.phrase AND f.kb = m.chunk_id % 2 JOIN lens USING (chunk_id) JOIN kst s ON s.kb = m.chunk_id % 2 GROUP BY p.query_id, m.chunk_id""",
    "kkw": "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, kb ORDER BY round(bm25, 9) DESC, chunk_id) AS INTEGER) AS fts_rank FROM kbm) WHERE fts_rank <= 50",
    "kvk": "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, chunk_id % 2 ORDER BY round(cosine, 9) DESC, chunk_id) AS INTEGER) AS vec_rank FROM cosines WHERE chunk_id IN (SELECT doc_id FROM documents)) WHERE vec_rank <= 50",
    "krrf": "SELECT query_id, chunk_id, coalesce(1.0::DOUBLE / (60 + fts_rank), 0::DOUBLE) + coalesce(1.0::DOUBLE / (60 + vec_rank), 0::DOUBLE) AS rrf FROM kkw FULL JOIN kvk USING (query_id, chunk_id)",
    "kfr": "SELECT query_id, chunk_id, 'kb' || (chunk_id % 2) AS kb, rrf, row_number() OVER (PARTITION BY query_id, chunk_id % 2 ORDER BY round(rrf, 9) DESC, chunk_id) AS rank FROM krrf",
    "gold": "SELECT b.item_id AS query_id, b.text AS query, coalesce(list_sort(list(DISTINCT d.rel_path) FILTER (d.rel_path IS NOT NULL)), []) AS expect FROM benchmark b LEFT JOIN docs d ON contains(d.text, b.text) GROUP BY b.item_id, b.text",
    "logs": "SELECT event_type AS kb, CASE WHEN value > 50 THEN 'search' ELSE 'get' END AS op, value / 1000 AS seconds, 'vault' AS source_name, CAST(user_id AS VARCHAR) AS rel_path, ts FROM events",
    "wr": f"SELECT conv_id || '-' || turn AS key, CASE WHEN conv_id % 3 = 0 THEN 'frozen' ELSE 'notes' END AS kb, TIMESTAMP '1970-01-01 00:00:00' + to_seconds({EPOCH} + conv_id * 60 + turn) AS ts, role AS title, CASE WHEN (conv_id + turn) % 11 = 0 THEN ' \n ' ELSE text END AS content FROM conversations",
    "mg": "SELECT *, 'memory_' || strftime(ts, '%Y%m%d_%H%M%S') || '_' || left(sha256(key), 8) AS rel_path FROM wr",
}


def _split(source: str, limit: int, overlap: int) -> dict[str, str]:
    """Expressions for the chunks of the blocks in ``source``."""
    t = _tokens("text")
    return {
        "ck_lines": f"SELECT *, string_split(text, '\n') AS ls, {t} AS tok FROM {source}",
        "ck_toks": f"SELECT *, [{_tokens('x')} for x in ls] AS ts FROM ck_lines",
        "ck_walk": f"""SELECT doc_id, block_no, 0 AS i, 0 AS first, ts[1] AS tok, ts, NULL::INTEGER AS done_first, NULL::INTEGER AS done_last FROM ck_toks WHERE tok > {limit}
          UNION ALL SELECT doc_id, block_no, i + 1, CASE WHEN c THEN nf ELSE first END, CASE WHEN c THEN coalesce(list_sum(ts[nf + 1:i + 1]), 0) ELSE tok END + ts[i + 2], ts, CASE WHEN c THEN first END, CASE WHEN c THEN i END
          FROM (SELECT *, first < i + 1 AND tok + ts[i + 2] > {limit} AS c, {f"coalesce(list_max([k for k in range(first, i + 1) if list_sum(ts[k + 1:i + 1]) >= {overlap}]), first)" if overlap else "i + 1"} AS nf FROM ck_walk WHERE i + 1 < len(ts))""",
        "ck_bounds": f"""SELECT doc_id, block_no, done_first AS first, done_last AS last, false AS final FROM ck_walk WHERE done_first IS NOT NULL
          UNION ALL SELECT doc_id, block_no, first, i, true FROM ck_walk WHERE i + 1 = len(ts) UNION ALL SELECT doc_id, block_no, 0, len(ls) - 1, true FROM ck_toks WHERE tok <= {limit}""",
        "ck_cut": f"SELECT b.doc_id, b.block_no, b.first, b.last, t.heading_path, t.start_line + b.first AS start_line, CASE WHEN b.final THEN t.end_line ELSE t.start_line + b.last END AS end_line, {_trim("array_to_string(t.ls[b.first + 1:b.last + 1], '\n')")} AS text FROM ck_bounds b JOIN ck_toks t USING (doc_id, block_no)",
        "ck": f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start_line, block_no, first, last) - 1 AS INTEGER) AS seq, heading_path, start_line, end_line, text, {t} AS token_est FROM ck_cut WHERE text <> ''",
    }


def sql(query: str, blocks: tuple[str, int, int] | None = None, instead: dict[str, str] | None = None) -> str:
    """``query`` with the expressions that it names, directly or through others.  ``blocks`` (name, limit, overlap) adds
    those of ``_split``; those of ``instead`` replace others and come first."""
    known = {**(instead or {}), **{n: x for n, x in SQL.items() if n not in (instead or {})}, **(_split(*blocks) if blocks else {})}
    needed: set[str] = set()

    def need(text: str) -> None:
        for name in set(re.findall(r"\b\w+\b", text)) & known.keys() - needed:
            if re.search(rf"\b(?:FROM|JOIN|,)\s+(?:\w+,\s+)?{name}\b", text):
                needed.add(name)
                need(known[name])

    need(query)
    parts = ",\n".join(f"{n} AS ({known[n]})" for n in known if n in needed)
    return f"WITH RECURSIVE {parts}\n{query}" if parts else query
