
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of each format that can be indexed (fixed values; A15).
FORMATS = {
    "markdown": [".md", ".markdown"],
    "plaintext": [".txt", ".rst", ".adoc"],
    "code": [".go", ".py", ".js", ".ts", ".tsx", ".jsx", ".java", ".rs", ".c", ".h", ".cpp", ".hpp", ".rb", ".sh", ".sql", ".yaml", ".yml", ".toml", ".json", ".tf", ".lua", ".css", ".html"],
    "pdf": [".pdf"],
    "docx": [".docx"],
}
#: Accented letters and their plain forms for keyword search (fixed values; S2).
ACCENTED = "áàâäãåçéèêëíìîïñóòôöõúùûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
RRF_K = 60
PREVIEW = 200


def trim_all(x: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.regexp_replace(x, r"^\s+|\s+\z", "")


def estimate_tokens(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, at least 1; 0 for an empty text; null is empty."""
    size = F.octet_length(F.coalesce(text, F.lit("")))
    return F.when(size > 0, F.greatest(F.lit(1), (size / 4).cast("int"))).otherwise(0)


def embedding_text(context: Column, heading_path: Column, text: Column) -> Column:
    """The parts that aren't empty, an empty line between."""
    empty = F.lit("")
    return F.concat_ws("\n\n", F.nullif(context, empty), F.nullif(heading_path, empty), text)


def content_hash(content: Column) -> Column:
    """SHA-256 of the raw bytes, hex."""
    return F.sha2(content, 256)


def file_ext(path: Column) -> Column:
    """Lower-cased extension with its dot, '' without one."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def base_title(path: Column) -> Column:
    """The file's name without extension."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]*$", "")


def format_of(ext: Column, formats: dict[str, list[str]] = FORMATS) -> Column:
    """The format that claims an extension, null if none does; an extension claimed twice is an error."""
    claims = [e for exts in formats.values() for e in exts]
    if len(claims) != len(set(claims)):
        raise ValueError("an extension is claimed by two formats")
    pairs = [F.lit(x) for name, exts in formats.items() for e in exts for x in (e, name)]
    return F.element_at(F.create_map(*pairs), F.lower(ext))


def glob_regex(glob: str) -> str:
    """A regex for a glob with ``**`` (any folders), ``*``, ``?``, classes and braces, anchored at both ends."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
            continue
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end]
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]")
            i = end
        elif c == "{":
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def glob_match(path: Column, glob: str) -> Column:
    return path.rlike(glob_regex(glob))


def is_indexable(path: Column, include: list[str] = (), exclude: list[str] = (), formats: dict[str, list[str]] = FORMATS) -> Column:
    """An extension that some format claims, no excluding glob, and any including glob (none given: all)."""
    ok = file_ext(path).isin(*[e for exts in formats.values() for e in exts])
    for g in exclude:
        ok = ok & ~glob_match(path, g)
    if include:
        any_of = F.lit(False)
        for g in include:
            any_of = any_of | glob_match(path, g)
        ok = ok & any_of
    return ok


def metadata_matches(metadata: Column, wanted: Column) -> Column:
    """Every pair of ``wanted`` holds in ``metadata``; a missing key reads as ''.  Null maps are empty."""
    none = F.create_map().cast("map<string,string>")
    have = F.coalesce(metadata, none)
    return F.forall(F.map_entries(F.coalesce(wanted, none)), lambda e: F.coalesce(F.element_at(have, e.key), F.lit("")) == F.coalesce(e.value, F.lit("")))


def path_has_prefix(path: Column, prefix: Column | str) -> Column:
    """C4: case-insensitive prefix; no pattern characters."""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.startswith(F.lower(path), F.lower(prefix))


def matches_expectation(path: Column, expect: Column) -> Column:
    """Some non-empty expected string is a part of the path."""
    return F.exists(expect, lambda w: (F.length(w) > 0) & F.contains(path, w))


def relevance(rrf: Column) -> Column:
    """A fused score against the best possible one, at most 1."""
    return F.least(F.lit(1.0), rrf / (2.0 / (RRF_K + 1)))


def preview(text: Column, chars: int = PREVIEW) -> Column:
    """The first characters on one line, with an ellipsis where something is left out."""
    short = F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("…"))).otherwise(text)
    return F.translate(short, "\n", " ")


def slice_lines(text: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end``, 1-based, clamped; an ``end`` of 0 or less means the last; '' if inverted."""
    lines = F.split(text, "\n")
    first = F.greatest(F.lit(1), start)
    last = F.when(end <= 0, F.size(lines)).otherwise(F.least(end, F.size(lines)))
    return F.when(first <= last, F.array_join(F.slice(lines, first, F.greatest(F.lit(0), last - first + 1)), "\n")).otherwise("")


def sanitize_query(query: Column) -> Column:
    """The words of a free query (array): runs of ASCII letters, digits, ``_ . -`` and anything beyond ASCII, without
    ``- . _`` at their ends."""
    words = F.split(query, r"[^A-Za-z0-9_.\-\x{80}-\x{10FFFF}]+")
    return F.filter(F.transform(words, lambda w: F.regexp_replace(w, r"^[-._]+|[-._]+$", "")), lambda w: w != "")


def match_string(query: Column) -> Column:
    """The words as quoted phrases joined by OR."""
    return F.concat_ws(" OR ", F.transform(sanitize_query(query), lambda w: F.concat(F.lit('"'), w, F.lit('"'))))


def tokenize(text: Column) -> Column:
    """Lower-cased runs of letters and digits without accents (array)."""
    return F.regexp_extract_all(F.translate(F.lower(text), ACCENTED, PLAIN), F.lit(r"[\p{L}\p{N}]+"), 0)


def joined_terms(text: Column) -> Column:
    """The terms of ``tokenize`` joined by spaces, without an array between; texts of ASCII alone, told by their sizes, need no
    table of accents and no character properties."""
    runs = lambda x, no: F.trim(F.regexp_replace(x, no, " "))
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, runs(F.lower(text), "[^a-z0-9]+")).otherwise(runs(F.translate(F.lower(text), ACCENTED, PLAIN), r"[^\p{L}\p{N}]+"))


def dot(a: Column, b: Column) -> Column:
    """S3."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    """S4."""
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def sigmoid(score: Column, needed: Column) -> Column:
    """The logistic function, only where ``needed``."""
    return F.when(needed, 1 / (1 + F.exp(-score))).otherwise(score)


def metadata_from_json(text: Column) -> Column:
    """A map, null for '', '{}' and null."""
    found = F.from_json(F.nullif(text, F.lit("")), "map<string,string>")
    return F.when(F.size(found) > 0, found)


def metadata_to_json(metadata: Column) -> Column:
    """JSON with sorted keys; '{}' for null."""
    entries = F.map_from_entries(F.array_sort(F.map_entries(metadata)))
    return F.when(metadata.isNull() | (F.size(metadata) == 0), "{}").otherwise(F.to_json(entries))


def render_uri(kind: Column, base: Column, branch: Column, path: Column) -> Column:
    """By kind of source: ``file`` (base is a root), ``git`` (a URL), ``s3`` (bucket and prefix), ``managed`` (a KB)."""
    return (
        F.when(kind == "file", F.concat(F.lit("file://"), base, F.lit("/"), path))
        .when(kind == "git", F.concat(base, F.lit("#"), branch, F.lit(":"), path))
        .when(kind == "s3", F.concat(F.lit("s3://"), base, path))
        .when(kind == "managed", F.concat(F.lit("managed://"), base, F.lit("/"), path))
    )


def document_id(*key: Column | str) -> Column:
    """128 bits of a digest of a document's key, as hex; parts of the key are told apart by their lengths."""
    parts = [F.col(k) if isinstance(k, str) else k for k in key]
    return F.left(F.sha2(F.concat(*(F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts)), 256), F.lit(32))


def chunk_id(doc_id: Column, seq: Column) -> Column:
    """Id of a document's chunk; in order of ``seq`` within a document."""
    return F.concat(doc_id, F.lit("-"), F.lpad(seq.cast("string"), 9, "0"))


def memory_id(ts: Column, key: Column) -> Column:
    """Time and eight hex digits; a hash of ``key`` stands for a random number, so reruns agree."""
    return F.concat(F.lit("memory_"), F.date_format(ts, "yyyyMMdd_HHmmss"), F.lit("_"), F.substring(F.sha2(key, 256), 1, 8))


PROMPT_CHARS = 32_000


def context_prompt(title: Column, document: Column, chunk: Column) -> Column:
    """The document first, cut at a number of characters, so that prompts of one document share a beginning."""
    return F.concat(
        F.lit("Title: "), title, F.lit("\n\nDocument:\n"), F.substring(document, 1, PROMPT_CHARS),
        F.lit("\n\nChunk of this document:\n"), chunk, F.lit("\n\nSay in one or two sentences where this chunk stands in the document."),
    )


def style_level(style: Column) -> Column:
    """1 to 6 for heading styles, else 0."""
    found = F.regexp_extract(F.lower(F.replace(style, F.lit(" "), F.lit(""))), "^heading([1-6])$", 1)
    return F.coalesce(F.nullif(found, F.lit("")).cast("int"), F.lit(0))
