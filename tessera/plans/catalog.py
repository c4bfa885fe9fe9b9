"""Registered queries of the engine, each with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import dates, json_ops, paths, text, vectors
from tessera.operators import context, graph, registry, search, state, study
from tessera.plans import domain as D
from tessera.sources import files, models, parsers, staging, tables
from tessera.streaming import debounce, events, log, runs, worker

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, ctes: str = "") -> Callable[[Query], Query]:
    """Register a query under its name, with its SQL."""
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = D.with_ctes(ctes, sql) if ctes else sql
        return f

    return add


# --- documents, chunks, paths -------------------------------------------------------------------


@query("SELECT document_id, sequence_index, token_count, sha256(text_content) AS text_sha FROM c", "c")
def chunk_documents(spark, sf):
    return D.chunks(spark, sf).select("document_id", "sequence_index", "token_count", F.sha2("text_content", 256).alias("text_sha"))


@query("SELECT document_id, workspace_id, relative_path, size FROM d", "d")
def docs_by_workspace(spark, sf):
    return D.documents(spark, sf).select("document_id", "workspace_id", "relative_path", "size")


@query("SELECT document_id, content_hash, content_hash || ':chunker-v1' AS cache_key, size FROM d", "d")
def content_hash(spark, sf):
    return D.documents(spark, sf).select("document_id", "content_hash", text.cache_key(F.col("content_hash"), "chunker-v1").alias("cache_key"), "size")


@query(r"""SELECT page_id, CASE WHEN e IN ('jpg','jpeg','png','gif','bmp','tiff','webp') THEN 'image' WHEN e = 'htm' THEN 'html' ELSE e END AS file_type
FROM (SELECT page_id, ['jpg','htm','md','PDF','docx','txt','webp'][page_id % 7 + 1] AS x, lower(x) AS e FROM pages)""")
def file_type(spark, sf):
    ext = F.element_at(F.array(*[F.lit(x) for x in ("jpg", "htm", "md", "PDF", "docx", "txt", "webp")]), (F.col("page_id") % 7 + 1).cast("int"))
    return D.table(spark, sf, "pages").select("page_id", paths.file_type(F.concat(F.lit("a.b/page"), F.col("page_id").cast("string"), F.lit("."), ext)).alias("file_type"))


@query("""SELECT folder, count(*) AS n_files, min(relative_path) AS first_file FROM (SELECT split_part(relative_path, '/', 1) AS folder, relative_path FROM d) GROUP BY folder""", "d")
def folder_tree(spark, sf):
    d = D.documents(spark, sf).select("relative_path", F.explode(paths.folders(F.col("relative_path"))).alias("folder"))
    return d.groupBy("folder").agg(F.count("*").alias("n_files"), F.min("relative_path").alias("first_file"))


@query("""SELECT d.document_id, d.relative_path, CASE WHEN d.document_id % 3 = 0 THEN 'changed' ELSE 'kept' END AS state,
CASE WHEN d.document_id % 3 = 0 THEN sha256(d.text || 'x') ELSE d.content_hash END AS content_hash FROM d WHERE d.document_id % 10 <> 9
UNION ALL SELECT document_id, relative_path, 'new', sha256(text || 'x') FROM d WHERE document_id % 10 = 9""", "d")
def document_upsert(spark, sf):
    d = D.documents(spark, sf)
    old = d.filter("document_id % 10 <> 9").select("document_id", "workspace_id", "relative_path", "content_hash", F.lit("kept").alias("state"))
    delta = d.filter("document_id % 3 = 0 OR document_id % 10 = 9").select("document_id", "workspace_id", "relative_path", F.sha2(F.concat("text", F.lit("x")), 256).alias("content_hash"), F.when(F.col("document_id") % 10 == 9, "new").otherwise("changed").alias("state"))
    return state.upsert(old, delta, ["workspace_id", "relative_path"]).select("document_id", "relative_path", "state", "content_hash")


@query("SELECT document_id, relative_path FROM d WHERE document_id % 4 = 0 OR document_id % 10 = 9", "d")
def incremental_skip(spark, sf):
    d = D.documents(spark, sf)
    held = d.filter("document_id % 10 <> 9").select("document_id", "workspace_id", "relative_path", F.when(F.col("document_id") % 4 == 0, "stale").otherwise(F.col("content_hash")).alias("last_indexed_hash"))
    new = d.select(F.col("document_id").alias("file_id"), "workspace_id", "relative_path", "content_hash")
    return state.changed(new, held).select(F.col("file_id").alias("document_id"), "relative_path")


@query(r"""SELECT document_id, CAST(len(b) AS BIGINT) AS n_blocks, sha256(array_to_string(b, chr(10))) AS blocks_sha FROM (
SELECT document_id, list_filter(list_transform(string_split_regex(text, '\n[ \t\r]*\n\s*'), lambda p: array_to_string(list_filter(list_transform(string_split(p, chr(10)), lambda l: trim(l)), lambda l: l <> ''), ' ')), lambda p: p <> '') AS b FROM d)""", "d")
def parse_txt_blocks(spark, sf):
    d = D.documents(spark, sf).select("document_id", parsers.text_blocks(F.col("text")).alias("b"))
    return d.select("document_id", F.size("b").cast("long").alias("n_blocks"), F.sha2(F.array_join(F.transform("b", lambda x: x["text_content"]), "\n"), 256).alias("blocks_sha"))


#: The one tag of HTML at which a block ends, for the SQL of ``parse_html_blocks``.
BREAK = r"(?i)</*(?:h[1-6]|pre|code|p|div|li|td|th|tr|blockquote|section|article|br)(?:[^A-Za-z0-9>][^>]*)?(?:>|$)"


@query(rf"""WITH cut AS (SELECT page_id, regexp_replace(html, '(?is)<(?:script\b[^>]*>.*?</script|style\b[^>]*>.*?</style|head\b[^>]*>.*?</head|noscript\b[^>]*>.*?</noscript)[^>]*>', '', 'g') AS h FROM pages),
p AS (SELECT page_id, unnest(regexp_split_to_array(h, '{BREAK}')) AS piece, generate_subscripts(regexp_split_to_array(h, '{BREAK}'), 1) AS i, regexp_extract_all(h, '{BREAK}') AS tags FROM cut),
b AS (SELECT page_id, i, CASE WHEN i = 1 THEN 'Paragraph' WHEN regexp_matches(tags[i - 1], '(?i)^</*h[1-6]') THEN 'Heading' WHEN regexp_matches(tags[i - 1], '(?i)^</*(pre|code)') THEN 'Code' ELSE 'Paragraph' END AS block_type,
  regexp_replace(regexp_replace(piece, '<[^>]*>?', '', 'g'), '^\s+|\s+$', '', 'g') AS t FROM p)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS pos, block_type, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) AS VARCHAR) AS page_or_location,
  replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', '''') AS text_content FROM b WHERE t <> ''""")
def parse_html_blocks(spark, sf):
    p = D.table(spark, sf, "pages").select("page_id", F.posexplode(parsers.html_blocks(F.col("html"))).alias("pos", "b"))
    return p.select("page_id", "pos", "b.block_type", "b.page_or_location", "b.text_content")


@query(r"""WITH t AS (SELECT doc_id AS document_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(^|\n)([TD])', '\1  ## \2', 'g'), '(^|\n)[AE][^\n]*', '\1```', 'g'), '(^|\n)[SL][^\n]*', '\1 ', 'g') AS md FROM documents),
l AS (SELECT document_id, unnest(string_split(md, chr(10))) AS raw, generate_subscripts(string_split(md, chr(10)), 1) AS no FROM t),
k AS (SELECT document_id, no, regexp_replace(raw, '\s+$', '') AS line, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS body FROM l),
f AS (SELECT *, starts_with(body, '```') AS fence, sum(CASE WHEN starts_with(body, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY no) - CASE WHEN starts_with(body, '```') THEN 1 ELSE 0 END AS before,
  sum(CASE WHEN starts_with(body, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY document_id) AS fences FROM k),
g AS (SELECT *, CASE WHEN fence THEN 'fence' WHEN before % 2 = 1 THEN 'code' WHEN starts_with(body, '#') THEN 'heading' WHEN body = '' THEN 'blank' ELSE 'text' END AS kind FROM f),
p AS (SELECT *, sum(CASE WHEN kind = 'text' AND last IS DISTINCT FROM 'text' THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY no) AS island FROM (SELECT *, lag(kind) OVER (PARTITION BY document_id ORDER BY no) AS last FROM g)),
b AS (SELECT document_id, min(no) AS first, 'Paragraph' AS block_type, string_agg(body, ' ' ORDER BY no) AS t FROM p WHERE kind = 'text' GROUP BY document_id, island
UNION ALL SELECT document_id, no, 'Heading', regexp_replace(ltrim(body, '#'), '^\s+|\s+$', '', 'g') FROM p WHERE kind = 'heading'
UNION ALL SELECT o.document_id, o.no, 'Code', coalesce(string_agg(c.line, chr(10) ORDER BY c.no), '') FROM p o LEFT JOIN (SELECT * FROM p WHERE kind = 'code') c ON c.document_id = o.document_id AND c.before = o.before + 1
  WHERE o.fence AND o.before % 2 = 0 GROUP BY o.document_id, o.no, o.before, o.fences HAVING o.fences > o.before + 1 OR count(c.no) > 0)
SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY first) - 1 AS INTEGER) AS pos, block_type, CAST(first AS VARCHAR) AS page_or_location, sha256(t) AS text_sha FROM b""")
def parse_markdown_blocks(spark, sf):
    """Documents whose lines are turned into headings, fences and blank lines by their first letter."""
    md = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "(^|\n)([TD])", "$1  ## $2"), "(^|\n)[AE][^\n]*", "$1```"), "(^|\n)[SL][^\n]*", "$1 ")
    d = D.documents(spark, sf).select("document_id", F.posexplode(parsers.markdown_blocks(md)).alias("pos", "b"))
    return d.select("document_id", "pos", "b.block_type", "b.page_or_location", F.sha2("b.text_content", 256).alias("text_sha"))


@query(r"""SELECT page_id, sha256(replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', '''')) AS text_sha
FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g'), '(?is)<head\b[^>]*>.*?</head\s*>', '', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM pages)""")
def html_to_text(spark, sf):
    return D.table(spark, sf, "pages").select("page_id", F.sha2(parsers.html_text(F.col("html")), 256).alias("text_sha"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS authored_at FROM orders""")
def authored_date(spark, sf):
    o = D.table(spark, sf, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    k = F.col("o_orderkey") % 4
    body = (
        F.when(k == 0, F.concat(F.lit("Report\nPublished: "), day))
        .when(k == 1, F.concat(F.lit("Published on "), F.date_format("o_orderdate", "MMMM d, yyyy")))
        .when(k == 2, F.concat(F.lit("Date: "), F.date_format("o_orderdate", "dd MMM yyyy"), F.lit(" by us")))
        .otherwise(F.concat(F.lit("Published under a licence "), day))
    )
    return o.select("o_orderkey", dates.authored_date(body).alias("authored_at"))


@query("""SELECT authored, count(*) AS n, min(o_orderkey) AS first_order FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(date_trunc('month', o_orderdate) AS DATE) END AS authored FROM orders) GROUP BY authored""")
def timeline(spark, sf):
    o = D.table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.trunc(F.col("o_orderdate").cast("date"), "month")).alias("authored"))
    return o.groupBy("authored").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_order"))


@query("SELECT document_id, left(text, 60) AS title, CASE WHEN length(text) <= 240 THEN text ELSE left(text, 240) || '…' END AS snippet FROM d", "d")
def title_snippets(spark, sf):
    return D.documents(spark, sf).select("document_id", text.session_title(F.col("text")).alias("title"), text.search_snippet(F.col("text")).alias("snippet"))


@query(r"""SELECT p_partkey, s || CASE WHEN n > 1 THEN '-' || (n - 1) ELSE '' END AS slug FROM (
SELECT p_partkey, s, row_number() OVER (PARTITION BY p_size, s ORDER BY p_partkey) AS n FROM (SELECT p_partkey, p_size, regexp_replace(regexp_replace(trim(lower(p_brand || ' / ' || p_type)), '[^\w\s-]', '', 'g'), '\s+', '-', 'g') AS s FROM part))""")
def heading_slugs(spark, sf):
    p = D.table(spark, sf, "part").select("p_partkey", "p_size", text.slug(F.concat("p_brand", F.lit(" / "), "p_type")).alias("s"))
    n = F.row_number().over(Window.partitionBy("p_size", "s").orderBy("p_partkey"))
    return p.withColumn("n", n).select("p_partkey", F.concat("s", F.when(F.col("n") > 1, F.concat(F.lit("-"), (F.col("n") - 1).cast("string"))).otherwise("")).alias("slug"))


# --- retrieval ------------------------------------------------------------------------------------


@query("SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(score, 6) AS score FROM kwr WHERE rank <= 10", "kwr")
def keyword_topk(spark, sf):
    hits = search.ranked_hits(D.chunks(spark, sf), D.questions(spark, sf), 10)
    return hits.select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


@query("""SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, v.vec_id) AS rank
FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id) WHERE rank <= 10""")
def vector_topk(spark, sf):
    v = D.table(spark, sf, "embeddings")
    q = v.filter("vec_id % 100 = 0 AND label IS NOT NULL").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("qv"))
    hits = search.vector_hits(v.select(F.col("vec_id").alias("chunk_id"), "label", F.col("embedding").alias("vector")), q, 10, by="label")
    return hits.select("query_id", "rank", F.col("chunk_id").alias("vec_id"), "score")


@query("""SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
FROM (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)) WHERE rank <= 10""")
def vector_topk_all(spark, sf):
    """The nearest of all rows, whatever their label; ``vector_topk`` is the search within a workspace."""
    v = D.table(spark, sf, "embeddings")
    q = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    hits = search.vector_hits(v.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")), q, 10)
    return hits.select("query_id", "rank", F.col("chunk_id").alias("vec_id"), "score")


EMBED = r"""
t AS (SELECT chunk_id AS id, unnest(list_filter(string_split_regex(lower(text_content), '\s+'), lambda w: w <> '')) AS token FROM c),
h AS MATERIALIZED (SELECT id, CAST('0x' || substr(sha256(token), 1, 8) AS BIGINT) % 128 AS bucket, CASE WHEN CAST('0x' || substr(sha256(token), 9, 8) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END AS sign FROM t),
s AS (SELECT id, bucket, sum(sign) AS n FROM h GROUP BY 1, 2 HAVING sum(sign) <> 0),
v AS (SELECT id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS weight FROM s)"""
EMBED_Q = r"""
tq AS (SELECT query_id AS id, unnest(terms) AS token FROM qt),
hq AS (SELECT id, CAST('0x' || substr(sha256(token), 1, 8) AS BIGINT) % 128 AS bucket, CASE WHEN CAST('0x' || substr(sha256(token), 9, 8) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END AS sign FROM tq),
sq AS (SELECT id, bucket, sum(sign) AS n FROM hq GROUP BY 1, 2 HAVING sum(sign) <> 0),
vq AS (SELECT id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS weight FROM sq),
vh AS (SELECT vq.id AS query_id, v.id AS chunk_id, round(sum(vq.weight * v.weight), 6) AS score FROM vq JOIN v USING (bucket) GROUP BY 1, 2),
vp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM vh),
kp AS (SELECT query_id, chunk_id, score FROM kwr WHERE rank <= 30),
mg AS (SELECT query_id, chunk_id, round(sum(score), 6) AS score FROM (SELECT query_id, chunk_id, score * 0.4 AS score FROM kp UNION ALL SELECT query_id, chunk_id, score * 0.6 FROM vp WHERE rank <= 30) GROUP BY 1, 2),
mr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM mg)"""


def _with(ctes: str, more: str, body: str) -> str:
    head = D.with_ctes(ctes, "")
    return head.rstrip() + "," + more + "\n" + body


@query(_with("c", EMBED, "SELECT id AS chunk_id, bucket, round(weight, 6) AS weight FROM v"))
def hash_embedding_sparse(spark, sf):
    e = vectors.hash_embedding(D.chunks(spark, sf), "chunk_id", "text_content")
    return e.select("chunk_id", "bucket", F.round("weight", 6).alias("weight"))


def _hybrid(spark, sf, limit: int = 10) -> DataFrame:
    """Merged pool of each query (three times the limit)."""
    return search.hybrid_hits(D.chunks(spark, sf), D.questions(spark, sf), limit)


def _keyword_hits(spark, sf, limit: int) -> DataFrame:
    """Each query's best chunks with their texts; only documents that are hit are cut into chunks again."""
    return search.keyword_hits(D.chunks(spark, sf), D.questions(spark, sf), limit=limit, texts=lambda hits: D.chunks(spark, sf, hits))


@query(_with("kwr", EMBED + "," + EMBED_Q, "SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, score FROM mr WHERE rank <= 30"))
def hybrid_merge(spark, sf):
    return _hybrid(spark, sf).select("query_id", "rank", "chunk_id", "score")


RERANK = "CASE WHEN len(terms) = 0 THEN 0.0 ELSE least(1.0, len(list_filter(terms, lambda t: contains(lower(text_content), t))) / CAST(len(terms) AS DOUBLE) + CASE WHEN contains(lower(text_content), lower(trim(query))) THEN 0.25 ELSE 0.0 END) END"


@query(_with("kwr", EMBED + "," + EMBED_Q, f"""SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, score, relative_path, workspace_name, snippet FROM (
SELECT mr.query_id, mr.chunk_id, round({RERANK}, 6) AS score, d.relative_path, ws.display_name AS workspace_name, CASE WHEN length(c.text_content) <= 240 THEN c.text_content ELSE left(c.text_content, 240) || '…' END AS snippet,
row_number() OVER (PARTITION BY mr.query_id ORDER BY {RERANK} DESC, mr.score DESC, mr.chunk_id) AS rank
FROM mr JOIN c USING (chunk_id) JOIN qt USING (query_id) JOIN (SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS workspace_id, 'Workspace ' || substr(source, 4) AS display_name FROM documents) ws ON ws.workspace_id = c.workspace_id LEFT JOIN d ON d.document_id = c.document_id WHERE mr.rank <= 30) WHERE rank <= 20"""))
def global_search(spark, sf):
    pool = staging.stored(_hybrid(spark, sf).drop("rank"), "pool")
    queries = D.questions(spark, sf)
    full = search.hydrated(pool, D.chunks(spark, sf, pool), queries, 30).join(queries, "query_id")
    best = search.reranked(full, F.col("query"), 20)
    out = search.decorated(best, D.documents(spark, sf), D.workspaces(spark, sf))
    return out.select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"), "relative_path", "workspace_name", "snippet")


@query("""SELECT query_id, workspace_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, workspace_id ORDER BY score DESC, chunk_id) AS rank FROM kw) WHERE rank <= 3""", "kw")
def retrieve_multi_workspace(spark, sf):
    """The pool of each workspace (three times a limit of one), all of them without a further limit."""
    hits = search.ranked_hits(D.chunks(spark, sf), D.questions(spark, sf), search.POOL_FACTOR, by="workspace_id")
    return hits.select("query_id", "workspace_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


@query("""SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, workspace_id, rank) AS place, workspace_id, chunk_id, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, workspace_id ORDER BY score DESC, chunk_id) AS rank FROM kw) WHERE rank <= 30""", "kw")
def multi_workspace_order(spark, sf):
    """The pools of all workspaces (three times a limit of ten) merged into one order for each query."""
    hits = search.ranked_hits(D.chunks(spark, sf), D.questions(spark, sf), search.POOL_FACTOR * 10, by="workspace_id")
    return search.merged_workspaces(hits).select("query_id", "place", "workspace_id", "chunk_id", F.round("score", 6).alias("score"))


@query(f"""SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {RERANK} DESC, score DESC, chunk_id) AS INTEGER) AS rank, chunk_id, round({RERANK}, 6) AS score FROM kwr WHERE rank <= 15""", "kwr")
def rerank_topk(spark, sf):
    hits = _keyword_hits(spark, sf, 15)
    return search.reranked(hits, F.col("query")).select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


# --- context --------------------------------------------------------------------------------------


def _pool(spark, sf) -> DataFrame:
    """Ranked hits of each query: three times a limit of 20."""
    hits = _keyword_hits(spark, sf, POOL_SIZE)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(order))


POOL_SIZE = search.POOL_FACTOR * search.DEFAULT_LIMIT
POOL = f"p AS (SELECT * FROM kwr WHERE rank <= {POOL_SIZE})"


@query(_with("kwr", " " + POOL, "SELECT query_id, document_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY rank) AS k FROM p) WHERE k = 1"))
def context_exact_dedup(spark, sf):
    hits = _pool(spark, sf).withColumn("chunk_id", F.col("document_id"))
    return context.exact_dedup(hits, ["query_id"]).select("query_id", "document_id", "rank")


@query(_with("kwr", " " + POOL, "SELECT query_id, chunk_id, CAST(cum AS BIGINT) AS total_tokens FROM (SELECT *, sum(token_count) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS cum FROM p) WHERE cum <= 3072 OR rank = 1"))
def context_token_budget(spark, sf):
    return context.token_budget(_pool(spark, sf), ["query_id"], 3072).select("query_id", "chunk_id", "total_tokens")


@query(_with("kwr", " " + POOL + """, g AS (SELECT *, sum(fresh) OVER (PARTITION BY query_id ORDER BY chunk_id ROWS UNBOUNDED PRECEDING) AS island FROM (
SELECT *, CASE WHEN lag(document_id) OVER o = document_id AND lag(chunk_id) OVER o = chunk_id - 1 THEN 0 ELSE 1 END AS fresh FROM p WINDOW o AS (PARTITION BY query_id ORDER BY chunk_id)))""",
"SELECT query_id, min(chunk_id) AS chunk_id, min(document_id) AS document_id, sha256(string_agg(text_content, chr(10) ORDER BY chunk_id)) AS text_sha, round(max(score), 6) AS score, count(*) AS n_merged FROM g GROUP BY query_id, island"))
def context_merge_adjacent(spark, sf):
    m = context.merge_adjacent(_pool(spark, sf), ["query_id"])
    return m.select("query_id", "chunk_id", "document_id", F.sha2("text_content", 256).alias("text_sha"), F.round("score", 6).alias("score"), "n_merged")


@query(_with("kwr", " " + POOL + r""", l AS (SELECT query_id, list({'r': CAST(rank AS INTEGER), 'c': chunk_id, 't': lower(array_to_string(list_filter(string_split_regex(text_content, '\s+'), lambda w: w <> ''), ' '))} ORDER BY rank) AS l FROM p GROUP BY 1),
k AS (SELECT query_id, list_reduce(list_prepend([l[1]], list_transform(l[2:], lambda x: [x])), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: strlen(y.t) > 0 AND strlen(x[1].t) > 0 AND (contains(y.t, x[1].t) OR contains(x[1].t, y.t)) AND 10 * least(strlen(y.t), strlen(x[1].t)) >= 9 * greatest(strlen(y.t), strlen(x[1].t)))) > 0 THEN acc ELSE list_concat(acc, x) END) AS kept FROM l)""",
"SELECT query_id, x.c AS chunk_id FROM (SELECT query_id, unnest(kept) AS x FROM k)"))
def context_near_dup(spark, sf):
    return context.near_dedup(_pool(spark, sf), ["query_id"]).select("query_id", "chunk_id")


@query(_with("kwr", " " + POOL, "SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS INTEGER) AS number, chunk_id, document_id, CASE WHEN length(trim(text_content)) <= 160 THEN trim(text_content) ELSE rtrim(left(trim(text_content), 160)) || '...' END AS snippet FROM p"))
def citations(spark, sf):
    return context.citations(_pool(spark, sf), ["query_id"])


@query(_with("kwr", " x AS (SELECT query_id, query, array_to_string(list('[' || n || '] ' || text_content ORDER BY n), chr(10) || chr(10)) AS ctx FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS n FROM kwr WHERE rank <= 5) GROUP BY 1, 2)",
f"SELECT query_id, sha256('SYSTEM' || chr(10) || chr(10) || '{text.TUTOR}' || chr(10) || chr(10) || '{text.MATHS}' || r || 'PASSAGES' || chr(10) || chr(10) || ctx || r || 'QUESTION' || chr(10) || chr(10) || query || r || 'REPLY' || chr(10) || chr(10) || 'Write the answer only.') AS prompt_sha FROM (SELECT *, chr(10) || chr(10) || '---' || chr(10) || chr(10) AS r FROM x)"))
def rag_prompt(spark, sf):
    hits = _keyword_hits(spark, sf, 5)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "text_content"))), lambda x: x["text_content"])
    return hits.groupBy("query_id", "query").agg(listed.alias("hits")).select("query_id", F.sha2(text.prompt(F.col("query"), F.col("hits")), 256).alias("prompt_sha"))


@query("""SELECT d2.document_id, CASE WHEN d2.document_id % 11 = 0 THEN 'document #' || d2.document_id ELSE coalesce(ws.display_name, 'workspace #' || d2.workspace_id) || ' / ' || d2.relative_path END AS label
FROM d d2 LEFT JOIN (SELECT * FROM ws WHERE workspace_id % 2 = 0) ws USING (workspace_id)""", "d ws")
def research_labels(spark, sf):
    d = D.documents(spark, sf)
    return search.research_labels(d.select("document_id"), d.filter("document_id % 11 <> 0"), D.workspaces(spark, sf).filter("workspace_id % 2 = 0"))


# --- jobs, study, chat ----------------------------------------------------------------------------


@query("""SELECT workspace_id, CAST(count_if(status = 'queued') AS BIGINT) AS queued, CAST(count_if(status = 'running') AS BIGINT) AS running, CAST(count_if(status = 'succeeded') AS BIGINT) AS succeeded, CAST(count_if(status = 'failed') AS BIGINT) AS failed, count(*) AS total,
round(count_if(status IN ('succeeded', 'failed')) * 1000.0 / count(*)) / 10 AS percent, max(completed_at) AS last_completed_at, min(CASE WHEN status = 'running' THEN id END) AS running_id FROM jobs GROUP BY 1""", "jobs")
def job_status_rollup(spark, sf):
    return state.indexing_status(D.jobs(spark, sf))


@query("SELECT workspace_id, id, priority FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY priority DESC, id) AS n FROM jobs WHERE status = 'queued') WHERE n = 1", "jobs")
def next_job(spark, sf):
    return state.next_jobs(D.jobs(spark, sf), ["workspace_id"]).select("workspace_id", "id", "priority")


@query("""SELECT user_id, split_part(s, ':', 1) AS status, CAST(split_part(s, ':', 2) AS INTEGER) AS retry_count FROM (SELECT user_id, list_reduce(list_prepend('queued:0', list(t ORDER BY ts, event_id)), lambda p, k: CASE k WHEN 'failed' THEN CASE WHEN CAST(split_part(p, ':', 2) AS INTEGER) + 1 <= 3 THEN 'queued:' ELSE 'failed:' END || (CAST(split_part(p, ':', 2) AS INTEGER) + 1) ELSE k || ':' || split_part(p, ':', 2) END) AS s
FROM (SELECT user_id, ts, event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'succeeded' WHEN 'signup' THEN 'cancelled' ELSE 'running' END AS t FROM events) GROUP BY 1)""")
def job_retry_fold(spark, sf):
    e = D.table(spark, sf, "events")
    t = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "succeeded").when(F.col("event_type") == "signup", "cancelled").otherwise("running")
    return state.job_folded(e.select("user_id", "ts", "event_id", t.alias("t")), ["user_id"], ["ts", "event_id"], "t")


ATTEMPTS = "a AS (SELECT CAST(d.source AS VARCHAR) AS quiz, l.doc_id, l.quality AS correct, CASE WHEN l.doc_id % 7 = 0 THEN NULL ELSE l.toxic END AS selected FROM labels l JOIN documents d USING (doc_id))"


def _attempts(spark, sf) -> DataFrame:
    l, d = D.table(spark, sf, "labels"), D.table(spark, sf, "documents").select("doc_id", "source")
    return l.join(d, "doc_id").select(F.col("source").alias("quiz"), "doc_id", F.col("quality").alias("correct"), F.when(F.col("doc_id") % 7 != 0, F.col("toxic")).alias("selected"))


@query(f"WITH {ATTEMPTS} SELECT quiz, CAST(sum(CASE WHEN selected = correct THEN 1 ELSE 0 END) AS BIGINT) AS correct_count, count(*) AS total, round(avg(CASE WHEN selected = correct THEN 1.0 ELSE 0.0 END), 6) AS score FROM a GROUP BY 1")
def quiz_grade(spark, sf):
    return study.graded(_attempts(spark, sf), ["quiz"]).withColumn("score", F.round("score", 6))


RESULTS = "r AS (SELECT user_id AS concept_node_id, ts AS seen, event_id, round(value % 1, 4) AS score FROM events WHERE event_type IN ('click', 'view'))"
PROGRESS = "g AS (SELECT concept_node_id, max_by(score, {'a': seen, 's': score}) AS mastery_score, 1 - max_by(score, {'a': seen, 's': score}) AS weakness_score, max(seen) AS last_reviewed_at, count(*) AS attempt_count FROM r GROUP BY 1)"


def _progress(spark, sf) -> DataFrame:
    e = D.table(spark, sf, "events").filter(F.col("event_type").isin("click", "view"))
    return study.progressed(e.select(F.col("user_id").alias("concept_node_id"), F.col("ts").alias("at"), F.round(F.col("value") % 1, 4).alias("score")))


@query(f"WITH {RESULTS}, {PROGRESS} SELECT concept_node_id, round(mastery_score, 4) AS mastery_score, round(weakness_score, 4) AS weakness_score, last_reviewed_at, attempt_count FROM g")
def progress_update(spark, sf):
    return _progress(spark, sf).withColumns({"mastery_score": F.round("mastery_score", 4), "weakness_score": F.round("weakness_score", 4)})


@query(f"WITH {RESULTS}, {PROGRESS} SELECT concept_node_id, round(weakness_score, 4) AS weakness_score, attempt_count FROM g WHERE weakness_score >= 0.75")
def weak_concepts(spark, sf):
    return _progress(spark, sf).filter("weakness_score >= 0.75").select("concept_node_id", F.round("weakness_score", 4).alias("weakness_score"), "attempt_count")


@query(f"""WITH {RESULTS}, {PROGRESS}, w AS (SELECT n_nationkey AS plan_id, unnest(list_transform(generate_series(0, 9), lambda k: CAST(n_nationkey * 3 + k * 7 AS BIGINT))) AS concept_node_id, unnest(generate_series(0, 9)) AS pos FROM nation)
SELECT plan_id, sha256(string_agg('concept ' || concept_node_id || ': mastery ' || round(CAST(mastery_score AS DECIMAL(10, 4)), 2) || ', weakness ' || round(CAST(weakness_score AS DECIMAL(10, 4)), 2) || ', attempts ' || attempt_count, chr(10) ORDER BY pos)) AS plan_sha FROM w JOIN g USING (concept_node_id) GROUP BY 1""")
def revision_plan(spark, sf):
    ids = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: (F.col("n_nationkey") * 3 + k * 7).cast("long"))
    progress = _progress(spark, sf).withColumns({c: F.round(c, 4) for c in ("mastery_score", "weakness_score")})
    plans = study.revision_plan(D.table(spark, sf, "nation").select(F.col("n_nationkey").alias("plan_id"), ids.alias("ids")), progress)
    return plans.select("plan_id", F.sha2("plan", 256).alias("plan_sha"))


@query("""SELECT conv_id, left(min_by(text, turn), 60) AS title, max(turn) AS updated_at, count(*) AS n_messages FROM conversations WHERE role <> 'system' GROUP BY 1""")
def chat_sessions_recent(spark, sf):
    m = D.table(spark, sf, "conversations").filter("role <> 'system'").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("at"), "role", F.col("text").alias("content"))
    return study.sessions(m).withColumnRenamed("session_id", "conv_id")


@query("SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS n, role, CAST(length(text) AS BIGINT) AS n_chars FROM conversations WHERE role IN ('user', 'assistant')")
def chat_transcript(spark, sf):
    m = D.table(spark, sf, "conversations").filter(F.col("role").isin("user", "assistant"))
    return m.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("n"), "role", F.length("text").cast("long").alias("n_chars"))


@query("SELECT user_id, document_id, opened, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY opened DESC, document_id) AS place FROM (SELECT user_id, event_id % 37 AS document_id, max(ts) AS opened FROM events GROUP BY 1, 2)) WHERE place <= 10")
def recent_documents(spark, sf):
    e = D.table(spark, sf, "events").select("user_id", (F.col("event_id") % 37).alias("document_id"), F.col("ts").alias("at"))
    return state.recent_documents(e, ["user_id"]).withColumnRenamed("at", "opened")


@query("SELECT workspace_id, metric_key, period, metric_value, computed_at FROM (SELECT user_id % 10 AS workspace_id, event_type AS metric_key, CAST(date_trunc('month', ts) AS DATE) AS period, value AS metric_value, ts AS computed_at, row_number() OVER (PARTITION BY user_id % 10, event_type, date_trunc('month', ts) ORDER BY ts DESC, value DESC) AS n FROM events) WHERE n = 1")
def analytics_upsert(spark, sf):
    e = D.table(spark, sf, "events")
    points = e.select((F.col("user_id") % 10).alias("workspace_id"), F.col("event_type").alias("metric_key"), F.trunc(F.col("ts").cast("date"), "month").alias("period"), F.col("value").alias("metric_value"), F.col("ts").alias("computed_at"))
    return study.latest_metrics(points)


# --- graph ----------------------------------------------------------------------------------------


@query("SELECT e.edge_id, e.from_node_id, e.to_node_id, e.relation_type, n.workspace_id FROM e JOIN n ON n.node_id = e.from_node_id", "e n")
def graph_full(spark, sf):
    return graph.workspace_edges(D.edges(spark, sf), D.nodes(spark, sf)).select("edge_id", "from_node_id", "to_node_id", "relation_type", "workspace_id")


@query("SELECT e.from_node_id AS node_id, count(*) AS n_out FROM e GROUP BY 1 ORDER BY n_out DESC, node_id LIMIT 20", "e")
def top_concepts(spark, sf):
    """A report of the twenty concepts with most links out."""
    return D.edges(spark, sf).groupBy(F.col("from_node_id").alias("node_id")).agg(F.count("*").alias("n_out")).orderBy(F.desc("n_out"), "node_id").limit(20)


@query("SELECT workspace_id, min(label) AS label FROM (SELECT p_size % 5 AS workspace_id, p_type AS label, lower(trim(p_type)) AS k FROM part) x WHERE (workspace_id, k) NOT IN (SELECT p_size % 5, lower(trim(p_type)) FROM part WHERE p_partkey % 50 = 0) GROUP BY workspace_id, k")
def graph_label_dedup(spark, sf):
    p = D.table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 5).alias("workspace_id"), F.col("p_type").alias("label"))
    return graph.new_nodes(p.select("workspace_id", "label"), p.filter("p_partkey % 50 = 0"))


@query("""SELECT (SELECT max(p_partkey) FROM part WHERE p_partkey % 50 = 0) + row_number() OVER (ORDER BY workspace_id, label) AS node_id, workspace_id, label FROM (
SELECT workspace_id, min(label) AS label FROM (SELECT p_size % 5 AS workspace_id, p_name || ' ' || p_partkey % 97 AS label, lower(trim(p_name || ' ' || p_partkey % 97)) AS k FROM part) x WHERE (workspace_id, k) NOT IN (SELECT p_size % 5, lower(trim(p_name || ' ' || p_partkey % 97)) FROM part WHERE p_partkey % 50 = 0) GROUP BY workspace_id, k)""")
def graph_new_nodes(spark, sf):
    """Extracted labels that the graph lacks, with new ids."""
    label = F.concat("p_name", F.lit(" "), (F.col("p_partkey") % 97).cast("string"))
    p = D.table(spark, sf, "part").select(F.col("p_partkey").alias("node_id"), (F.col("p_size") % 5).alias("workspace_id"), label.alias("label"))
    return graph.inserted_nodes(p.select("workspace_id", "label"), p.filter("node_id % 50 = 0")).select("node_id", "workspace_id", "label")


@query("SELECT from_node_id, to_node_id, relation_type FROM e WHERE from_node_id % 2 = 1", "e")
def edge_anti_insert(spark, sf):
    e = D.edges(spark, sf)
    return graph.new_edges(e, e.filter("from_node_id % 2 = 0")).select("from_node_id", "to_node_id", "relation_type")


@query("""SELECT e.edge_id, a.label AS from_label, b.label AS to_label, CAST(len(s.docs) AS BIGINT) AS n_sources, s.docs[1] AS first_source FROM e JOIN n a ON a.node_id = e.from_node_id JOIN n b ON b.node_id = e.to_node_id
JOIN (SELECT edge_id, list_sort(list(DISTINCT document_id)) AS docs FROM (SELECT edge_id, from_node_id AS node_id FROM e UNION ALL SELECT edge_id, to_node_id FROM e) JOIN src USING (node_id) GROUP BY 1) s USING (edge_id)
WHERE len(s.docs) > 1""", "e n src")
def citation_graph(spark, sf):
    chosen = D.nodes(spark, sf).select("workspace_id")
    c = graph.citation_edges(D.links(spark, sf), D.nodes(spark, sf), D.node_sources(spark, sf), chosen)
    return c.select(D.edge_id().alias("edge_id"), "from_label", "to_label", F.size("source_documents").cast("long").alias("n_sources"), F.get("source_documents", F.lit(0)).alias("first_source"))


@query("SELECT node_id, workspace_id, round(cos(angle) * 240 + 400, 4) AS x, round(sin(angle) * 240 + 300, 4) AS y FROM (SELECT *, 2 * pi() * (row_number() OVER (PARTITION BY workspace_id ORDER BY node_id) - 1) / count(*) OVER (PARTITION BY workspace_id) - pi() / 2 AS angle FROM n)", "n")
def circular_layout(spark, sf):
    return graph.circular_layout(D.nodes(spark, sf)).select("node_id", "workspace_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(r"""WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 AND p_partkey % 6 <> 3 THEN 'Sure: ' ELSE '' END || CASE p_partkey % 6
  WHEN 0 THEN '{"questions": [{"question": "' || p_name || '?", "options": ["a", "b"], "correct_index": 1}]}' WHEN 1 THEN '{"questions": [{"question": "q", "options": ["a", "b"], "correct_index": 2}]}'
  WHEN 2 THEN '{"questions": [{"question": "q", "options": [], "correct_index": 0}, {"question": "r", "options": ["a"], "correct_index": 0}]}' WHEN 3 THEN 'no quiz on ' || p_name
  WHEN 4 THEN '{"cards": []}' ELSE '{"questions": [{"question": " ", "options": ["a"], "correct_index": 0}, {"question": "q", "options": ["a"], "correct_index": "x"}]}' END AS raw FROM part),
j AS (SELECT p_partkey, CASE WHEN json_valid(raw) THEN raw ELSE nullif(regexp_extract(raw, '\{.*\}'), '') END AS t FROM r),
q AS (SELECT p_partkey, unnest(from_json(json_extract(t, '$.questions'), '["json"]')) AS q, generate_subscripts(from_json(json_extract(t, '$.questions'), '["json"]'), 1) - 1 AS pos FROM j WHERE t IS NOT NULL AND json_extract(t, '$.questions') IS NOT NULL)
SELECT p_partkey, CAST(pos AS INTEGER) AS pos, json_extract_string(q, '$.question') AS question, CASE WHEN trim(json_extract_string(q, '$.question')) = '' THEN 'no question' WHEN json_array_length(q, '$.options') = 0 THEN 'no options'
  WHEN coalesce(TRY_CAST(json_extract_string(q, '$.correct_index') AS INTEGER), -1) NOT BETWEEN 0 AND json_array_length(q, '$.options') - 1 THEN 'no correct option' END AS reason FROM q
UNION ALL SELECT p_partkey, NULL, NULL, CASE WHEN t IS NULL THEN 'no JSON' ELSE 'no questions' END FROM j WHERE t IS NULL OR json_extract(t, '$.questions') IS NULL""")
def quiz_checks(spark, sf):
    """Answers of a model to a quiz request, each question with what is wrong with it."""
    k, name = F.col("p_partkey") % 6, F.col("p_name")
    body = (
        F.when(k == 0, F.concat(F.lit('{"questions": [{"question": "'), name, F.lit('?", "options": ["a", "b"], "correct_index": 1}]}')))
        .when(k == 1, F.lit('{"questions": [{"question": "q", "options": ["a", "b"], "correct_index": 2}]}'))
        .when(k == 2, F.lit('{"questions": [{"question": "q", "options": [], "correct_index": 0}, {"question": "r", "options": ["a"], "correct_index": 0}]}'))
        .when(k == 3, F.concat(F.lit("no quiz on "), name))
        .when(k == 4, F.lit('{"cards": []}'))
        .otherwise('{"questions": [{"question": " ", "options": ["a"], "correct_index": 0}, {"question": "q", "options": ["a"], "correct_index": "x"}]}')
    )
    raw = F.concat(F.when((F.col("p_partkey") % 4 < 2) & (k != 3), "Sure: ").otherwise(""), body)
    return study.checked_questions(D.table(spark, sf, "part").select("p_partkey", raw.alias("raw")), "raw").select("p_partkey", "pos", "question", "reason")


@query(r"""SELECT folder, count(*) AS n_lines, CAST(sum(strlen(line)) + count(*) AS BIGINT) AS size, sha256(string_agg(line, chr(10) ORDER BY doc_id) || chr(10)) AS content_hash, 'txt' AS file_type
FROM (SELECT doc_id, 'source=' || source || '/part=' || doc_id // 500 AS folder, sha256(coalesce(text, '')) AS line FROM documents) GROUP BY folder""")
def scanned_files(spark, sf):
    """A tree of files (of each source and five hundred ids the digests of its documents), scanned, read and fingerprinted."""
    root = _tree(spark, D.table(spark, sf, "documents"))
    held = files.scan(spark, root)
    prints = files.fingerprint(held, paths.file_type(F.col("relative_path")).alias("file_type"), F.regexp_count(F.col("content").cast("string"), F.lit("\n")).cast("long").alias("n_lines"))
    return prints.select(F.regexp_replace("relative_path", "/[^/]*$", "").alias("folder"), "n_lines", "size", "content_hash", "file_type")


@query("""WITH l AS (SELECT doc_id, 'source=' || source || '/part=' || doc_id // 500 AS path FROM documents),
b AS (SELECT DISTINCT path FROM l WHERE doc_id % 1500 >= 500), a AS (SELECT DISTINCT path FROM l WHERE doc_id % 1500 < 1000), x AS (SELECT DISTINCT path FROM l WHERE doc_id % 1500 < 1000 AND doc_id % 7 = 0)
SELECT path, CASE WHEN b.path IS NULL THEN 'Added' WHEN a.path IS NULL THEN 'Removed' ELSE 'Changed' END AS change FROM b FULL JOIN a USING (path) WHERE b.path IS NULL OR a.path IS NULL OR path IN (SELECT path FROM x)""")
def file_ledger(spark, sf):
    """What a second scan finds against the ledger of the first: trees that share some files, with others changed in size."""
    d = D.table(spark, sf, "documents")
    folder = F.regexp_replace("relative_path", "/[^/]*$", "")
    first = files.fingerprint(files.scan(spark, _tree(spark, d.filter("doc_id % 1500 >= 500"))))
    second = files.fingerprint(files.scan(spark, _tree(spark, d.filter("doc_id % 1500 < 1000").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text"))))))
    return files.ledger_changes(first.withColumn("relative_path", folder), second.withColumn("relative_path", folder), ["size", "content_hash"]).select(F.col("relative_path").alias("path"), "change")


def _tree(spark, documents) -> str:
    """Text files ``source=.../part=.../*.txt`` of the digests of documents, a line each in order of id; the folder.

    The number of parts is named, since Spark would join parts of few bytes, and it is files that take the time here."""
    path = staging.new_path(spark, "tree")
    lines = documents.select("source", F.floor(F.col("doc_id") / 500).alias("part"), "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("value"))
    lines.repartition(staging.parts(documents), "source", "part").sortWithinPartitions("source", "part", "doc_id").select("source", "part", "value").write.options(**staging.MANY_FILES).partitionBy("source", "part").text(path)
    return path


@query(r"""SELECT p_partkey, array_to_string(string_split(regexp_replace(p_name, '(?i)(ar)', chr(1) || '\1' || chr(1), 'g'), chr(1)), '|') AS parts FROM part""")
def highlighted(spark, sf):
    """names cut at a text that was looked for."""
    return D.table(spark, sf, "part").select("p_partkey", F.array_join(text.highlight_parts(F.col("p_name"), "AR"), "|").alias("parts"))


@query(r"""SELECT document_id, CAST(i - 1 AS INTEGER) AS pos, CASE WHEN fine THEN 'Paragraph' ELSE 'Image' END AS block_type, CAST(i AS VARCHAR) AS page_or_location, sha256(CASE WHEN fine THEN page ELSE '' END) AS text_sha, NOT fine AS needs_ocr
FROM (SELECT document_id, i, page, length(regexp_replace(page, '^[\s]+|[\s]+$', '', 'g')) > 0 AND 10 * length(regexp_replace(page, '[\x21-\x7E\s]', '', 'g')) <= length(page) AS fine
FROM (SELECT document_id, unnest(string_split(text, chr(10))) AS page, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d))""", "d")
def pdf_pages(spark, sf):
    """The lines of documents as page texts of a PDF plug-in; pages without real text are images that need OCR."""
    d = D.documents(spark, sf).select("document_id", F.posexplode(parsers.pdf_page_blocks(F.split("text", "\n"))).alias("pos", "b"))
    return d.select("document_id", "pos", "b.block_type", "b.page_or_location", F.sha2("b.text_content", 256).alias("text_sha"), files.requires_ocr(F.col("b.block_type"), F.col("b.text_content")).alias("needs_ocr"))


@query(r"""SELECT relative_path, CASE page_id % 6 WHEN 0 THEN 'text/markdown' WHEN 1 THEN 'application/octet-stream' WHEN 2 THEN 'image/png' WHEN 3 THEN 'image/jpeg' ELSE 'application/octet-stream' END AS mime,
sha256(CASE WHEN page_id % 6 = 0 THEN body ELSE to_base64(CASE page_id % 6 WHEN 2 THEN '\x89PNG'::BLOB || encode(body) WHEN 3 THEN '\xFF\xD8\xFF'::BLOB || encode(body) ELSE encode(body) END) END) AS content_sha, page_id % 6 IN (2, 3) AS is_image
FROM (SELECT page_id, coalesce(html, '') AS body, 'a/' || page_id || ['.md', '.htm', '.png', '.JPG', '', '.txt'][page_id % 6 + 1] AS relative_path FROM pages)""")
def viewed_files(spark, sf):
    """Pages as files of several types, as a viewer gets them, and whether their first bytes are those of an image."""
    p, k, body = D.table(spark, sf, "pages"), F.col("page_id") % 6, F.encode(F.coalesce("html", F.lit("")), "utf-8")
    ending = F.element_at(F.array(*[F.lit(e) for e in (".md", ".htm", ".png", ".JPG", "", ".txt")]), (k + 1).cast("int"))
    content = F.when(k == 2, F.concat(F.unhex(F.lit("89504E47")), body)).when(k == 3, F.concat(F.unhex(F.lit("FFD8FF")), body)).otherwise(body)
    held = p.select(F.concat(F.lit("a/"), F.col("page_id").cast("string"), ending).alias("relative_path"), content.alias("content"))
    seen = files.viewed(held).select("relative_path", "mime", F.sha2("content", 256).alias("content_sha"))
    return seen.join(held.select("relative_path", files.is_image(F.col("content")).alias("is_image")), "relative_path")


# --- models and settings --------------------------------------------------------------------------


def _pages(spark, lines, name, *by):
    """Lines (value) as text files of a shared folder, those of one ``by`` in one file and in order; the files' addresses."""
    path = staging.new_path(spark, name)
    lines.repartition(by[0]).sortWithinPartitions(*by).select("value").write.text(path)
    root = path if "://" in path else f"file://{path.removeprefix('file:')}"
    return [f"{root}/{n}" for n in staging.Files(spark, path).names(".") if n.startswith("part-")]


@query("""SELECT model_identifier, array_to_string(list_concat(['TextGeneration'], list_filter([CASE WHEN sees THEN 'Vision' END, CASE WHEN embeds THEN 'Embedding' END, CASE WHEN tools THEN 'Tools' END,
CASE WHEN NOT sees AND f IN (1, 3) THEN 'Vision' END, CASE WHEN NOT embeds AND f = 2 THEN 'Embedding' END], lambda x: x IS NOT NULL)), ',') AS capabilities, context_length, parameter_size FROM (
SELECT s_name AS model_identifier, s_suppkey % 5 AS f, s_suppkey % 4 <> 0 AND s_nationkey % 3 = 1 AS sees, s_suppkey % 4 <> 0 AND s_nationkey % 3 = 2 AS embeds, s_suppkey % 4 <> 0 AND s_nationkey % 3 = 2 AS tools,
CAST(CASE WHEN s_suppkey % 6 = 0 THEN 4096 ELSE s_nationkey * 512 + 2048 END AS INTEGER) AS context_length, CASE WHEN s_suppkey % 7 <> 0 THEN (s_suppkey % 70) || 'B' END AS parameter_size FROM supplier)""")
def model_source(spark, sf):
    """Suppliers as the listings of model servers, a hundred models a listing, read by a data source."""
    s, k, n = D.table(spark, sf, "supplier"), F.col("s_suppkey"), F.col("s_nationkey") % 3
    reported = F.when(k % 4 != 0, F.when(n == 0, F.array(F.lit("completion"))).when(n == 1, F.array(F.lit("completion"), F.lit("vision"))).otherwise(F.array(F.lit("embedding"), F.lit("Tools"))))
    family = F.element_at(F.array(*[F.lit(f) for f in ("llama", "clip", "nomic-bert", "mllama", "qwen")]), (k % 5 + 1).cast("int"))
    details = F.struct(family.alias("family"), F.array(F.lit("gguf")).alias("families"), F.when(k % 7 != 0, F.concat((k % 70).cast("string"), F.lit("B"))).alias("parameter_size"))
    info = F.when(k % 6 != 0, F.create_map(F.concat(family, F.lit(".context_length")), F.col("s_nationkey") * 512 + 2048)).otherwise(F.create_map(F.lit("general.layers"), F.lit(32)))
    model = F.struct(F.col("s_name").alias("name"), details.alias("details"), reported.alias("capabilities"), info.alias("model_info"))
    page = s.groupBy(F.floor(k / 100).alias("page")).agg(F.collect_list(model).alias("models")).select("page", F.to_json(F.struct("models")).alias("value"))
    return models.discovered(spark, _pages(spark, page, "listings", "page")).withColumn("capabilities", F.array_join("capabilities", ","))


@query(r"""WITH w AS (SELECT conv_id, turn, i, w, starts_with(w, 'a') AS bad FROM (SELECT conv_id, turn, unnest(string_split_regex(text, '\s+')) AS w, generate_subscripts(string_split_regex(text, '\s+'), 1) AS i FROM conversations WHERE role = 'assistant' AND text IS NOT NULL) WHERE w <> '')
SELECT conv_id, count(*) AS n, sha256(string_agg(w, ' ' ORDER BY turn, i)) AS tokens_sha FROM w WHERE NOT bad GROUP BY conv_id UNION ALL SELECT NULL, count(*), sha256('malformed') FROM w WHERE bad""")
def token_stream(spark, sf):
    """Answers of conversations as generations, a word a line. Words that begin with an a are malformed lines and come out
    as errors (counted under no conversation), empty ones are blank lines."""
    c = D.table(spark, sf, "conversations").filter("role = 'assistant' AND text IS NOT NULL")
    words = c.select("conv_id", "turn", F.posexplode(F.split("text", r"\s+")).alias("i", "w"))
    token = F.to_json(F.struct(F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("w")).alias("response"), F.lit(False).alias("done")))
    line = F.when(F.col("w") == "", "").when(F.col("w").startswith("a"), F.concat(F.lit('{"response": '), F.col("w"))).otherwise(token)
    own = models.tokens(spark, _pages(spark, words.withColumn("value", line), "generations", "conv_id", "turn", "i"))
    path = staging.new_path(spark, "tokens")
    own.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(own.schema).parquet(f"{path}/out")
    good = rows.filter("error IS NULL").select(F.split_part("token", F.lit(":"), F.lit(1)).cast("long").alias("conv_id"), "line", F.expr("substring(token, locate(':', token) + 1)").alias("w"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "w"))), lambda x: x["w"]), " ")
    by_conversation = good.groupBy("conv_id").agg(F.count("*").alias("n"), F.sha2(text, 256).alias("tokens_sha"))
    return by_conversation.unionByName(rows.filter("error IS NOT NULL").agg(F.lit(None).cast("long").alias("conv_id"), F.count("*").alias("n"), F.sha2(F.lit("malformed"), 256).alias("tokens_sha")))


@query("SELECT n_nationkey AS workspace_id, k AS key, CASE WHEN k = 'name' THEN n_name WHEN k = 'region' THEN r_name ELSE 'global' END AS value FROM nation JOIN region ON r_regionkey = n_regionkey, (VALUES ('name'), ('region'), ('limit')) t(k) WHERE k <> 'region' OR n_nationkey % 2 = 0")
def settings_resolve(spark, sf):
    n, r = D.table(spark, sf, "nation"), D.table(spark, sf, "region")
    named = n.select(F.lit("workspace").alias("layer"), F.lit("name").alias("key"), F.col("n_nationkey").alias("workspace_id"), F.col("n_name").alias("value"))
    region = n.filter("n_nationkey % 2 = 0").join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.lit("runtime").alias("layer"), F.lit("region").alias("key"), F.col("n_nationkey").alias("workspace_id"), F.col("r_name").alias("value"))
    weaker = n.select(F.lit("default").alias("layer"), F.lit("limit").alias("key"), F.col("n_nationkey").alias("workspace_id"), F.lit("own").alias("value"))
    everywhere = r.limit(1).select(F.lit("user").alias("layer"), F.explode(F.array(F.lit("name"), F.lit("limit"))).alias("key"), F.lit(None).cast("int").alias("workspace_id"), F.lit("global").alias("value"))
    return registry.resolved_settings(named.unionByName(region).unionByName(weaker).unionByName(everywhere), n.select(F.col("n_nationkey").alias("workspace_id")))


def _registry(spark, sf) -> DataFrame:
    c = registry.candidates(D.models(spark, sf))
    return c.select(F.col("pos").alias("id"), "model_identifier", "engine_role", (F.col("pos") % 9 == 0).alias("is_selected_for_role"))


@query("SELECT engine_role, model_identifier, pos, context_length FROM (SELECT *, row_number() OVER (PARTITION BY engine_role ORDER BY CASE WHEN engine_role = 'Embedding' THEN context_length ELSE coalesce(CAST(replace(parameter_size, 'B', '') AS DOUBLE), 0) END DESC, context_length DESC, pos) AS n FROM mr) WHERE n = 1", "mr")
def best_model_for_role(spark, sf):
    return registry.best_per_role(registry.candidates(D.models(spark, sf))).select("engine_role", "model_identifier", "pos", "context_length")


@query("SELECT model_identifier, engine_role, CASE WHEN pos % 4 <> 0 THEN 'Available' ELSE 'Unavailable' END AS status, pos % 4 <> 0 AND pos % 9 = 0 AND pos % 6 <> 0 AS is_selected_for_role FROM mr WHERE pos % 4 <> 0 OR pos % 6 <> 0", "mr")
def discovery_reconcile(spark, sf):
    held = _registry(spark, sf).filter("id % 6 <> 0")
    found = registry.candidates(D.models(spark, sf)).filter("pos % 4 <> 0")
    return registry.reconciled(held, found)


@query("SELECT engine_role, model_identifier, CASE WHEN engine_role IN ('Tutor', 'Vision') AND EXISTS (SELECT 1 FROM mr x WHERE x.engine_role = mr.engine_role AND x.pos = 7) THEN pos = 7 ELSE pos % 9 = 0 END AS is_selected_for_role FROM mr", "mr")
def select_for_role(spark, sf):
    name = D.models(spark, sf).filter("pos = 7").select(F.explode(F.array(F.lit("Tutor"), F.lit("Vision"))).alias("engine_role"), F.col("model_identifier").alias("chosen"))
    return registry.select_for_role(_registry(spark, sf), name).select("engine_role", "model_identifier", "is_selected_for_role")


# --- events and streams ---------------------------------------------------------------------------


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('signup', 'purchase')")
def event_type_filter(spark, sf):
    return events.subscribed(D.table(spark, sf, "events"), ["signup", "purchase"]).select("event_id", "event_type")


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) < 50")
def event_payload_json(spark, sf):
    e = D.table(spark, sf, "events").withColumn("k", json_ops.payload_long(F.col("props"), "k"))
    return e.filter("k < 50").select("event_id", "k")


@query("""SELECT path, kind, at_ms FROM (SELECT path, list_reduce(list_prepend('', list(kind ORDER BY at_ms, seq)), lambda p, k: CASE k WHEN 'Created' THEN 'Added' WHEN 'Modified' THEN CASE WHEN p = 'Added' THEN 'Added' ELSE 'Updated' END ELSE CASE WHEN p = 'Added' THEN '' ELSE 'Deleted' END END) AS kind, max(at_ms) AS at_ms
FROM (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY at_ms, seq ROWS UNBOUNDED PRECEDING) AS burst FROM (SELECT *, CASE WHEN at_ms - lag(at_ms) OVER (PARTITION BY path ORDER BY at_ms, seq) < 3600000 THEN 0 ELSE 1 END AS fresh FROM ch)) GROUP BY path, burst) WHERE kind <> ''""", "ch")
def debounce_changes(spark, sf):
    return debounce.debounced(D.changes(spark, sf), 3_600_000)


@query(SQL["debounce_changes"])
def debounce_changes_stream(spark, sf):
    """R2: the same as a stream over eight files in any order, three a batch."""
    return runs.through(D.changes(spark, sf), "at_ms", lambda rows: debounce.debounce_stream(rows, 3_600_000), "debounce", files=8, per_trigger=3)


@query("""SELECT workspace_id, row_number() OVER (PARTITION BY workspace_id ORDER BY at_ms // 3600000, priority DESC, id, attempt) AS place, id, CAST(attempt AS INTEGER) AS attempt,
CASE WHEN NOT failing THEN 'succeeded' WHEN attempt <= 3 THEN 'queued' ELSE 'failed' END AS status, NOT failing AND k % 4 <> 0 AS enriched,
CASE WHEN odd THEN 'unrecognized job type ''reindex_all''' WHEN bare THEN 'job ' || id || ': payload missing ''relative_path''' WHEN failing THEN 'file k' || k || ' is busy' END AS error
FROM (SELECT *, odd OR bare OR attempt <= k % 6 AS failing FROM (SELECT *, unnest(generate_series(1, CASE WHEN odd OR bare THEN 4 ELSE least(k % 6 + 1, 4) END)) AS attempt FROM wj))""", "wj")
def job_worker(spark, sf):
    """The attempts of each workspace's worker, as a stream over four files."""
    return runs.through(D.worker_jobs(spark, sf), "at_ms", lambda rows: worker.work(rows, D.run_job, 3_600_000), "worker", files=4, per_trigger=2)


def _event_log(spark, sf, per_trigger=None):
    """A log over the events (four files, as many batches as ``per_trigger`` makes of them) with two subscribers: jobs of
    all but errors, and counts by type."""
    e = D.table(spark, sf, "events").select("event_id", "ts", "event_type", json_ops.payload(workspace_id=F.col("user_id"), props=F.col("props")).alias("payload"))
    path = staging.new_path(spark, "event-log")
    e.repartition(4).write.parquet(f"{path}/in")
    own = log.EventLog(spark, path, e.schema, [F.col("ts"), F.col("event_id")])
    own.subscribe("jobs", log.to_folder(f"{path}/jobs", lambda b: b.select("id", "event_id", json_ops.payload_long(F.col("payload"), "workspace_id").alias("workspace_id"))), ["signup", "click", "view", "purchase"])
    own.subscribe("counts", log.to_folder(f"{path}/counts", lambda b: b.groupBy("event_type").agg(F.count("*").alias("n"))))
    reader = spark.readStream.schema(e.schema)
    if per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    own.start(reader.parquet(f"{path}/in")).awaitTermination()
    return own, spark.read.parquet(f"{path}/jobs"), spark.read.parquet(f"{path}/counts")


@query("SELECT row_number() OVER (ORDER BY ts, event_id) AS id, event_id, event_type, user_id AS workspace_id FROM events")
def event_log(spark, sf):
    """The whole log with its ids, persisted in one batch."""
    own, _, _ = _event_log(spark, sf)
    return own.events().select("id", "event_id", "event_type", json_ops.payload_long(F.col("payload"), "workspace_id").alias("workspace_id"))


@query("""SELECT 'counts' AS subscriber, event_type AS what, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'jobs', CAST(user_id AS VARCHAR), count(*) FROM events WHERE event_type <> 'error' GROUP BY 2
UNION ALL SELECT 'log', 'ids without a gap', count(*) FROM events""")
def event_fanout(spark, sf):
    """What the subscribers got over several batches, and how many ids there are if they have no gap."""
    own, jobs, counts = _event_log(spark, sf, per_trigger=1)
    ids = own.events().agg(F.lit("log").alias("subscriber"), F.when((F.min("id") == 1) & (F.max("id") == F.count("*")), "ids without a gap").otherwise("a gap").alias("what"), F.countDistinct("id").alias("n"))
    by_type = counts.groupBy(F.lit("counts").alias("subscriber"), F.col("event_type").alias("what")).agg(F.sum("n").alias("n"))
    by_user = jobs.groupBy(F.lit("jobs").alias("subscriber"), F.col("workspace_id").cast("string").alias("what")).agg(F.count("*").alias("n"))
    return by_type.unionByName(by_user).unionByName(ids)


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, sf):
    w = events.windowed_counts(D.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day")
    return w.withColumn("start", F.col("start").cast("timestamp_ntz"))


# --- further operators ----------------------------------------------------------------------------


@query("SELECT document_id, relative_path FROM d WHERE contains(lower(relative_path), lower('SRC1'))", "d")
def path_filter(spark, sf):
    """Documents whose path contains a text, case-insensitively."""
    d = D.documents(spark, sf)
    return d.filter(F.contains(F.lower("relative_path"), F.lower(F.lit("SRC1")))).select("document_id", "relative_path")


@query("""SELECT user_id, split_part(s, ':', 1) AS status, CAST(split_part(s, ':', 2) AS INTEGER) AS refused FROM (SELECT user_id, list_reduce(list_prepend('Unlinked:0', list(a ORDER BY ts, event_id)), lambda p, k:
CASE WHEN k = 'link' AND starts_with(p, 'Unlinked') THEN 'Active:' || split_part(p, ':', 2) WHEN k = 'archive' AND NOT starts_with(p, 'Unlinked') THEN 'Archived:' || split_part(p, ':', 2)
WHEN k = 'restore' AND starts_with(p, 'Archived') THEN 'Active:' || split_part(p, ':', 2) WHEN k = 'unlink' AND NOT starts_with(p, 'Unlinked') THEN 'Unlinked:' || split_part(p, ':', 2)
ELSE split_part(p, ':', 1) || ':' || (CAST(split_part(p, ':', 2) AS INTEGER) + 1) END) AS s
FROM (SELECT *, CASE event_type WHEN 'signup' THEN 'link' WHEN 'error' THEN 'archive' WHEN 'purchase' THEN 'restore' WHEN 'click' THEN 'unlink' ELSE 'link' END AS a FROM events) GROUP BY 1)""")
def workspace_lifecycle(spark, sf):
    """Status of each workspace after its ordered actions."""
    e = D.table(spark, sf, "events")
    a = F.when(F.col("event_type") == "error", "archive").when(F.col("event_type") == "purchase", "restore").when(F.col("event_type") == "click", "unlink").otherwise("link")
    return state.workspaces_folded(e.select("user_id", "ts", "event_id", a.alias("a")), ["user_id"], ["ts", "event_id"], "a")


@query("SELECT engine_role, model_identifier, count(*) OVER (PARTITION BY engine_role) AS n_models, bool_or(pos % 9 = 0) OVER (PARTITION BY engine_role) AS has_selection FROM mr", "mr")
def models_by_role(spark, sf):
    """Models of each role."""
    return registry.by_role(_registry(spark, sf))


@query("SELECT model_identifier, engine_role FROM mr WHERE pos % 9 = 0 AND pos % 4 = 0", "mr")
def stale_selections(spark, sf):
    """Selected models that a discovery no longer finds."""
    found = D.models(spark, sf).filter("pos % 4 <> 0")
    return registry.stale_selections(_registry(spark, sf), found).select("model_identifier", "engine_role")


@query("SELECT engine_role, model_identifier FROM (SELECT *, row_number() OVER (PARTITION BY engine_role ORDER BY pos) AS k FROM mr WHERE pos % 9 = 0) WHERE k = 1", "mr")
def selected_models(spark, sf):
    """The selected model of each role."""
    return registry.selected_model(_registry(spark, sf))


@query(f"WITH {RESULTS}, {PROGRESS} SELECT p_partkey AS concept_node_id, p_name AS label, round(mastery_score, 4) AS mastery_score, attempt_count FROM part LEFT JOIN g ON concept_node_id = p_partkey")
def concepts_with_progress(spark, sf):
    """Every concept with its progress, if any."""
    n = D.nodes(spark, sf).select(F.col("node_id").alias("concept_node_id"), "label")
    return study.with_progress(n, _progress(spark, sf)).select("concept_node_id", "label", F.round("mastery_score", 4).alias("mastery_score"), "attempt_count")


@query("SELECT chunk_id, 'workspace-' || workspace_id AS vector_db_collection, 'workspace-' || workspace_id || ':' || chunk_id AS vector_id FROM c", "c")
def vector_ids(spark, sf):
    """M7: collection and vector id of each chunk."""
    return state.vector_ids(D.chunks(spark, sf)).select("chunk_id", "vector_db_collection", "vector_id")


@query("""SELECT DISTINCT f.node_id AS from_node_id, t.node_id AS to_node_id, r.relation_type FROM (SELECT p_size % 5 AS workspace_id, ' ' || upper(p_type) AS a, p_brand AS b, CASE WHEN p_partkey % 3 = 0 THEN 'part-of' WHEN p_partkey % 3 = 1 THEN 'related-to' ELSE 'other' END AS relation_type FROM part) r
JOIN (SELECT workspace_id, k, min(node_id) AS node_id FROM (SELECT p_size % 5 AS workspace_id, p_partkey AS node_id, lower(p_type) AS k FROM part UNION ALL SELECT p_size % 5, p_partkey + 1000000, lower(p_brand) FROM part) GROUP BY 1, 2) f ON f.workspace_id = r.workspace_id AND f.k = lower(trim(r.a))
JOIN (SELECT workspace_id, k, min(node_id) AS node_id FROM (SELECT p_size % 5 AS workspace_id, p_partkey AS node_id, lower(p_type) AS k FROM part UNION ALL SELECT p_size % 5, p_partkey + 1000000, lower(p_brand) FROM part) GROUP BY 1, 2) t ON t.workspace_id = r.workspace_id AND t.k = lower(trim(r.b)) WHERE r.relation_type <> 'other' AND f.node_id <> t.node_id""")
def relation_resolution(spark, sf):
    """Relations by label as edges by node."""
    p = D.table(spark, sf, "part").withColumn("workspace_id", F.col("p_size") % 5)
    n = p.select("workspace_id", F.col("p_partkey").alias("node_id"), F.col("p_type").alias("label")).union(p.select("workspace_id", F.col("p_partkey") + 1_000_000, "p_brand"))
    kind = F.when(F.col("p_partkey") % 3 == 0, "part-of").when(F.col("p_partkey") % 3 == 1, "related-to").otherwise("other")
    r = p.select("workspace_id", F.concat(F.lit(" "), F.upper("p_type")).alias("from_label"), F.col("p_brand").alias("to_label"), kind.alias("relation_type"))
    return graph.resolved_relations(r, n).select("from_node_id", "to_node_id", "relation_type").distinct()


# --- lookups, lists, merges onto held rows ----------------------------------------------------------


@query("SELECT document_id, workspace_id, relative_path FROM d WHERE document_id IN (SELECT doc_id FROM labels)", "d")
def documents_by_id(spark, sf):
    """The documents that labels name."""
    ids = D.table(spark, sf, "labels").select(F.col("doc_id").alias("document_id"))
    return state.lookup(D.documents(spark, sf), "document_id", ids).select("document_id", "workspace_id", "relative_path")


@query("SELECT workspace_id, document_id, CAST(row_number() OVER (PARTITION BY workspace_id ORDER BY relative_path, document_id) AS INTEGER) AS place FROM d", "d")
def workspace_document_list(spark, sf):
    """Documents of each workspace in order of their paths."""
    return state.listed(D.documents(spark, sf), ["workspace_id"], ["relative_path", "document_id"]).select("workspace_id", "document_id", "place")


@query("SELECT document_id, chunk_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY sequence_index) AS INTEGER) AS place FROM c", "c")
def document_chunk_list(spark, sf):
    """Chunks of each document in reading order."""
    return state.listed(D.chunks(spark, sf), ["document_id"], ["sequence_index"]).select("document_id", "chunk_id", "place")


STATES = "st AS (SELECT c_custkey AS workspace_id, ['Unlinked', 'Linking', 'Indexing', 'Active', 'Archived'][c_custkey % 5 + 1] AS status FROM customer)"


def _states(spark, sf) -> DataFrame:
    status = F.element_at(F.array(*[F.lit(x) for x in ("Unlinked", "Linking", "Indexing", "Active", "Archived")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    return D.table(spark, sf, "customer").select(F.col("c_custkey").alias("workspace_id"), status.alias("status"))


@query(f"WITH {STATES} SELECT workspace_id, status FROM st WHERE status IN ('Active', 'Indexing')")
def searchable_workspaces(spark, sf):
    """Workspaces that a search over all of them covers."""
    return state.searchable(_states(spark, sf))


@query(f"WITH {STATES} SELECT status = 'Archived' AS archived, count(*) AS n FROM st GROUP BY 1")
def archived_split(spark, sf):
    """Both sides of the list of workspaces."""
    return _states(spark, sf).groupBy(state.archived(F.col("status")).alias("archived")).agg(F.count("*").alias("n"))


@query("""SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
FROM (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)) WHERE rank <= 10 AND vec_id IN (SELECT vec_id FROM embeddings WHERE label % 2 = 0)""")
def vector_hits_with_pointer(spark, sf):
    """Of the ten nearest those that still have a pointer."""
    pointers = D.table(spark, sf, "embeddings").filter("label % 2 = 0").select(F.col("vec_id").alias("chunk_id"))
    hits = vector_topk_all(spark, sf).withColumn("chunk_id", F.col("vec_id"))
    return search.existing(hits, pointers).select("query_id", "rank", "vec_id")


@query(f"""WITH {RESULTS}, {PROGRESS} SELECT quiz_id, k.node_id AS concept_node_id, round(mastery_score, 4) AS mastery_score, attempt_count
FROM (SELECT p_partkey AS quiz_id, p_size % 5 AS workspace_id, CASE WHEN p_partkey % 9 = 0 THEN 'no such topic' ELSE ' ' || upper(p_type) END AS topic FROM part) z
LEFT JOIN (SELECT p_size % 5 AS workspace_id, lower(p_type) AS t, min(p_partkey) AS node_id FROM part GROUP BY 1, 2) k ON k.workspace_id = z.workspace_id AND k.t = lower(trim(z.topic)) LEFT JOIN g ON g.concept_node_id = k.node_id""")
def quiz_topic_progress(spark, sf):
    """The concept that a quiz is about, and its progress."""
    p = D.table(spark, sf, "part").withColumn("workspace_id", F.col("p_size") % 5)
    topic = F.when(F.col("p_partkey") % 9 == 0, "no such topic").otherwise(F.concat(F.lit(" "), F.upper("p_type")))
    nodes = p.select("workspace_id", F.col("p_partkey").alias("node_id"), F.col("p_type").alias("label"))
    out = study.topic_progress(p.select(F.col("p_partkey").alias("quiz_id"), "workspace_id", topic.alias("topic")), nodes, _progress(spark, sf))
    return out.select("quiz_id", "concept_node_id", F.round("mastery_score", 4).alias("mastery_score"), "attempt_count")


@query("SELECT workspace_id, CAST(sum(document_id % 5) AS BIGINT) AS concepts_added, CAST(sum(document_id % 3) AS BIGINT) AS relations_added, CAST(sum(document_id % 7) AS BIGINT) AS chunks_read, CAST(sum(CASE WHEN document_id % 11 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS failures FROM d GROUP BY 1", "d")
def extraction_outcomes(spark, sf):
    """Totals of a re-extraction of each workspace."""
    d = F.col("document_id")
    made = D.documents(spark, sf).select("workspace_id", (d % 5).alias("concepts_added"), (d % 3).alias("relations_added"), (d % 7).alias("chunks_read"), (d % 11 == 0).cast("long").alias("failures"))
    return state.extraction_totals(made, ["workspace_id"])


@query(_with("c", " b AS (SELECT *, coalesce(sum(strlen(text_content) + 2) OVER (PARTITION BY document_id ORDER BY sequence_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM c), x AS (SELECT document_id, string_agg(text_content, chr(10) || chr(10) ORDER BY sequence_index) AS t FROM b WHERE ahead < 12002 GROUP BY 1)",
"SELECT document_id, sha256(CASE WHEN strlen(t) <= 12000 THEN t ELSE left(t, list_max(list_filter(range(3000, 12001), lambda k: strlen(left(t, k)) <= 12000))) END) AS text_sha FROM x"))
def extraction_texts(spark, sf):
    """what of each document an extraction reads (12,000 bytes)."""
    return state.extraction_text(D.chunks(spark, sf), ["document_id"], "sequence_index").select("document_id", F.sha2("extraction_text", 256).alias("text_sha"))


@query(_with("c", EMBED, "SELECT chunk_id, 128 AS dimensions, CAST(count(v.id) AS BIGINT) AS n_buckets, round(coalesce(sum(abs(weight)), 0), 6) AS total FROM c LEFT JOIN v ON v.id = chunk_id GROUP BY 1"))
def embedded_chunks(spark, sf):
    """V3: every chunk with words has its vector."""
    e = vectors.embedded_chunks(D.chunks(spark, sf))
    return e.select("chunk_id", F.size("embedding").alias("dimensions"), F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("n_buckets"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.abs(x)), 6).alias("total"))


@query("SELECT n_nationkey, coalesce(TRY_CAST(CASE n_nationkey % 3 WHEN 0 THEN CAST(n_nationkey AS VARCHAR) WHEN 1 THEN n_name END AS INTEGER), 20) AS search_limit FROM nation")
def search_limits(spark, sf):
    """Limits from settings."""
    n = D.table(spark, sf, "nation")
    value = F.when(F.col("n_nationkey") % 3 == 0, F.col("n_nationkey").cast("string")).when(F.col("n_nationkey") % 3 == 1, F.col("n_name"))
    return n.select("n_nationkey", search.default_limit(value).alias("search_limit"))


HALVES = "g1 AS (SELECT concept_node_id, max_by(score, {'a': seen, 's': score}) AS m, max(seen) AS l, count(*) AS n FROM r WHERE event_id % 2 = 0 GROUP BY 1), g2 AS (SELECT concept_node_id, max_by(score, {'a': seen, 's': score}) AS m, max(seen) AS l, count(*) AS n FROM r WHERE event_id % 2 = 1 AND concept_node_id % 5 <> 0 GROUP BY 1)"


@query(f"WITH {RESULTS}, {HALVES} SELECT concept_node_id, round(coalesce(g2.m, g1.m), 4) AS mastery_score, round(1 - coalesce(g2.m, g1.m), 4) AS weakness_score, coalesce(g2.l, g1.l) AS last_reviewed_at, coalesce(g1.n, 0) + coalesce(g2.n, 0) AS attempt_count FROM g1 FULL JOIN g2 USING (concept_node_id)")
def progress_merge(spark, sf):
    """M2: held progress after new results."""
    e = D.table(spark, sf, "events").filter(F.col("event_type").isin("click", "view")).select("event_id", F.col("user_id").alias("concept_node_id"), F.col("ts").alias("at"), F.round(F.col("value") % 1, 4).alias("score"))
    out = study.progress_merged(study.progressed(e.filter("event_id % 2 = 0")), e.filter("event_id % 2 = 1 AND concept_node_id % 5 <> 0"))
    return out.withColumns({c: F.round(c, 4) for c in ("mastery_score", "weakness_score")})


POINTS = "pt AS (SELECT user_id % 10 AS workspace_id, event_type AS metric_key, CAST(date_trunc('month', ts) AS DATE) AS period, value AS metric_value, ts AS computed_at, event_id FROM events)"


@query(f"WITH {POINTS} SELECT workspace_id, metric_key, period, metric_value, computed_at FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id, metric_key, period ORDER BY event_id % 2 DESC, computed_at DESC, metric_value DESC) AS n FROM pt) WHERE n = 1")
def analytics_merge(spark, sf):
    """M3: held points (even events) overwritten by new ones (odd events)."""
    e = D.table(spark, sf, "events")
    point = [(F.col("user_id") % 10).alias("workspace_id"), F.col("event_type").alias("metric_key"), F.trunc(F.col("ts").cast("date"), "month").alias("period"), F.col("value").alias("metric_value"), F.col("ts").alias("computed_at")]
    held, new = (study.latest_metrics(e.filter(F.col("event_id") % 2 == k).select(*point)) for k in (0, 1))
    return state.upsert(held, new, ["workspace_id", "metric_key", "period"])


@query("SELECT scope, workspace_id, key, value FROM (SELECT CASE WHEN n_nationkey % 4 = 0 THEN 'user' ELSE 'workspace' END AS scope, CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey END AS workspace_id, 'k' || n_nationkey AS key, CASE WHEN n_nationkey % 2 = 0 THEN 'new ' || n_name ELSE n_name END AS value FROM nation)")
def settings_merge(spark, sf):
    """Settings updated or inserted by a key whose workspace may be null."""
    n, k = D.table(spark, sf, "nation"), F.col("n_nationkey")
    columns = [F.when(k % 4 == 0, "user").otherwise("workspace").alias("scope"), F.when(k % 4 != 0, k).alias("workspace_id"), F.concat(F.lit("k"), k.cast("string")).alias("key")]
    held = n.filter(k % 3 != 0).select(*columns, F.col("n_name").alias("value"))
    new = n.filter((k % 2 == 0) | (k % 3 == 0)).select(*columns, F.when(k % 2 == 0, F.concat(F.lit("new "), F.col("n_name"))).otherwise(F.col("n_name")).alias("value"))
    return state.upsert(held, new, ["scope", "workspace_id", "key"])


@query("SELECT model_identifier, engine_role, CASE WHEN pos % 4 = 0 THEN 'updated' ELSE 'held' END AS status FROM mr WHERE pos % 3 <> 0 OR pos % 4 = 0", "mr")
def registry_upsert(spark, sf):
    """M5: registry entries updated or inserted by model and role."""
    m = registry.candidates(D.models(spark, sf)).select("pos", "model_identifier", "engine_role")
    held = m.filter("pos % 3 <> 0").select("model_identifier", "engine_role", F.lit("held").alias("status"))
    return state.upsert(held, m.filter("pos % 4 = 0").select("model_identifier", "engine_role", F.lit("updated").alias("status")), ["model_identifier", "engine_role"])


@query("""SELECT pos AS id, model_identifier, CASE WHEN pos % 5 = 0 THEN 'updated' ELSE 'held' END AS status FROM m WHERE pos % 3 <> 0
UNION ALL SELECT pos, model_identifier, 'given' FROM m WHERE pos % 3 = 0 AND pos % 2 = 1
UNION ALL SELECT (SELECT max(pos) FROM m WHERE pos % 6 <> 0) + row_number() OVER (ORDER BY pos), model_identifier, 'new' FROM m WHERE pos % 6 = 0""", "m")
def registry_new_ids(spark, sf):
    """M5: entries of id 0 get new ids, known ids are updated, unknown ones inserted as given."""
    m = D.models(spark, sf).select("pos", "model_identifier")
    held = m.filter("pos % 3 <> 0").select(F.col("pos").alias("id"), "model_identifier", F.lit("held").alias("status"))
    updated = m.filter("pos % 3 <> 0 AND pos % 5 = 0").select(F.col("pos").alias("id"), "model_identifier", F.lit("updated").alias("status"), "pos")
    other = m.filter("pos % 3 = 0").select(F.when(F.col("pos") % 2 == 1, F.col("pos")).otherwise(0).alias("id"), "model_identifier", F.when(F.col("pos") % 2 == 1, "given").otherwise("new").alias("status"), "pos")
    return state.upsert_by_id(held, updated.union(other), "id", [F.col("pos")])


@query("""SELECT vec_id, label, list_sum(list_transform(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), lambda x: CASE WHEN vec_id % 7 = 0 AND vec_id % 5 <> 0 THEN -x ELSE x END))::DECIMAL(18, 4) AS total,
CASE WHEN vec_id % 3 = 0 THEN 'moved' WHEN vec_id % 7 = 0 THEN 'renewed' ELSE 'kept' END AS state FROM embeddings WHERE vec_id % 5 <> 0 OR vec_id % 7 = 0 AND vec_id % 5 <> 0""")
def vector_table(spark, sf):
    """A vector collection is created, upserted, updated and deleted from in four versions."""
    v = D.table(spark, sf, "embeddings").select("vec_id", "label", "embedding", F.lit("kept").alias("state"))
    own = tables.Table.create(v, staging.new_path(spark, "vectors"), ["vec_id"], 8)
    own.upsert(v.filter("vec_id % 7 = 0").withColumns({"embedding": F.transform("embedding", lambda x: -x), "state": F.lit("renewed")}))
    own.update(v.filter("vec_id % 3 = 0"), state=F.lit("moved"))
    own.delete(v.filter("vec_id % 5 = 0"))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")).cast("decimal(18, 4)")
    return own.read().select("vec_id", "label", total.alias("total"), "state")


@query("""SELECT document_id, chunk_id, sequence_index, CASE WHEN document_id % 3 = 0 THEN 'new' ELSE 'old' END AS state FROM c WHERE document_id % 3 <> 0 OR sequence_index % 2 = 0""", "c")
def chunk_table(spark, sf):
    """M8: the chunks of reindexed documents take the place of all they had, in one new version."""
    c = D.chunks(spark, sf).select("document_id", "chunk_id", "sequence_index", F.lit("old").alias("state"))
    own = tables.Table.create(c, staging.new_path(spark, "chunks"), ["document_id"], 8)
    own.replace(c.filter("document_id % 3 = 0 AND sequence_index % 2 = 0").withColumn("state", F.lit("new")), "document_id")
    return own.read()


@query("SELECT document_id, chunk_id, 'old' AS state FROM c WHERE document_id % 3 <> 0 UNION ALL SELECT document_id, chunk_id, 'new' FROM c WHERE document_id % 3 = 0 AND sequence_index < 2", "c")
def rechunked_documents(spark, sf):
    """M8: the chunks of re-indexed documents are replaced as a whole."""
    c = D.chunks(spark, sf)
    new = c.filter("document_id % 3 = 0 AND sequence_index < 2").select("document_id", "chunk_id", F.lit("new").alias("state"))
    return state.replace_rows(c.select("document_id", "chunk_id", F.lit("old").alias("state")), new, "document_id")


@query("SELECT conv_id, coalesce(a.title, b.title) AS title, greatest(a.u, b.u) AS updated_at, coalesce(a.n, 0) + coalesce(b.n, 0) AS n_messages FROM (SELECT conv_id, left(min_by(text, turn), 60) AS title, max(turn) AS u, count(*) AS n FROM conversations WHERE turn < 3 GROUP BY 1) a FULL JOIN (SELECT conv_id, left(min_by(text, turn), 60) AS title, max(turn) AS u, count(*) AS n FROM conversations WHERE turn >= 3 GROUP BY 1) b USING (conv_id)")
def chat_append(spark, sf):
    """M9: sessions after messages were appended."""
    m = D.table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("at"), "role", F.col("text").alias("content"))
    return study.sessions_bumped(study.sessions(m.filter("at < 3")), m.filter("at >= 3")).withColumnRenamed("session_id", "conv_id")


@query("SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id % 10 ORDER BY u DESC, conv_id) AS INTEGER) AS place FROM (SELECT conv_id, max(turn) AS u FROM conversations GROUP BY 1)")
def chat_session_list(spark, sf):
    """Sessions of each workspace, the last changed first."""
    m = D.table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("at"), "role", F.col("text").alias("content"))
    listed = study.latest_first(study.sessions(m).withColumn("workspace_id", F.col("session_id") % 10), ["workspace_id"])
    return listed.select(F.col("session_id").alias("conv_id"), "place")


@query("SELECT document_id, CASE WHEN document_id % 13 = 0 THEN 'failed' WHEN n = 0 THEN 'parsed_empty' ELSE 'parsed' END AS parse_status FROM (SELECT d.document_id, count(c.chunk_id) AS n FROM d LEFT JOIN c USING (document_id) GROUP BY 1)", "d c")
def parse_statuses(spark, sf):
    """Outcome of each document's parsing."""
    n = D.chunks(spark, sf).groupBy("document_id").agg(F.count("*").alias("n"))
    d = D.documents(spark, sf).select("document_id").join(n, "document_id", "left")
    return d.select("document_id", state.parse_outcome(F.coalesce("n", F.lit(0)), F.when(F.col("document_id") % 13 == 0, "unreadable")).alias("parse_status"))


@query("SELECT s_suppkey, least(4096, greatest(w - 1024, 0)) AS budget, least(greatest(s_suppkey + 1024, 2048), coalesce(w, 4096)) AS num_ctx FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 0 THEN s_nationkey * 512 + 512 END AS w FROM supplier)")
def context_sizes(spark, sf):
    """V5/V6: tokens left for context, and the context to ask for, of each model."""
    w = F.when(F.col("s_suppkey") % 4 != 0, F.col("s_nationkey") * 512 + 512)
    return D.table(spark, sf, "supplier").select("s_suppkey", text.context_budget(w).alias("budget"), text.context_size(F.col("s_suppkey"), w).alias("num_ctx"))


@query("SELECT id, 'queued' AS status FROM jobs WHERE status IN ('queued', 'running')", "jobs")
def resumable_jobs(spark, sf):
    """Jobs that a restart queues again."""
    return state.resumable(D.jobs(spark, sf)).select("id", "status")


@query("SELECT n_nationkey AS plan_id, n_regionkey AS scheduled_at, n_regionkey AS created_at FROM nation")
def revision_history(spark, sf):
    """Appended history rows."""
    n = D.table(spark, sf, "nation").select(F.col("n_nationkey").alias("plan_id"), F.col("n_regionkey").alias("scheduled_at"))
    return study.revision_rows(n)


@query(r"""SELECT p_partkey, '$' || p_name || '$ and $$' || p_brand || '$$, \( \)' AS shown FROM part""")
def latex_texts(spark, sf):
    r"""delimiters of formulas."""
    t = F.concat(F.lit(r"\( "), F.col("p_name"), F.lit(r" \) and \["), F.col("p_brand"), F.lit(r"\], \( \)"))
    return D.table(spark, sf, "part").select("p_partkey", text.latex_delimiters(t).alias("shown"))


# --- functions on derived columns -------------------------------------------------------------------


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS made, strftime(make_timestamp(CAST(o_orderkey AS BIGINT) * 86461 * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS at FROM orders")
def pdf_and_unix_times(spark, sf):
    """Dates of PDF headers (a month 13 is none), Unix seconds as text."""
    k = F.col("o_orderkey")
    raw = F.when(k % 4 == 3, "D:20241301000000").otherwise(F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("120000+01'00'")))
    return D.table(spark, sf, "orders").select("o_orderkey", dates.pdf_date(raw).alias("made"), dates.iso_time(k * 86461).alias("at"))


@query("""SELECT c_custkey, '{"workspace_id":' || c_nationkey || ',"relative_path":"' || c_name || '"}' AS payload, c_nationkey AS workspace_back, c_name AS path_back FROM customer""")
def event_payload_round_trip(spark, sf):
    """K1/K2/K4: payloads written and read back."""
    made = D.table(spark, sf, "customer").select("c_custkey", json_ops.payload(workspace_id=F.col("c_nationkey"), relative_path=F.col("c_name")).alias("payload"))
    return made.select("c_custkey", "payload", json_ops.payload_long(F.col("payload"), "workspace_id").cast("int").alias("workspace_back"), json_ops.payload_text(F.col("payload"), "relative_path").alias("path_back"))


@query("SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 3 = 0 THEN 4096 ELSE s_nationkey * 100 + 512 END AS INTEGER) AS context_length FROM supplier")
def model_context_lengths(spark, sf):
    """K5: context length from a model's description; 4096 where it has none."""
    info = F.when(F.col("s_suppkey") % 3 == 0, '{"general.name": "m"}').otherwise(F.concat(F.lit('{"general.name": "m", "arch.context_length": '), (F.col("s_nationkey") * 100 + 512).cast("string"), F.lit("}")))
    return D.table(spark, sf, "supplier").select("s_suppkey", json_ops.context_length(info).alias("context_length"))


@query("SELECT s_suppkey, array_to_string(CASE s_suppkey % 4 WHEN 0 THEN ['TextGeneration'] WHEN 1 THEN ['TextGeneration', 'Vision'] WHEN 2 THEN ['TextGeneration', 'Embedding'] ELSE ['TextGeneration', 'Vision', 'Tools'] END, ',') AS capabilities FROM supplier")
def model_capabilities(spark, sf):
    """What models can do, as they say or as their families tell."""
    k = F.col("s_suppkey") % 4
    said = F.when(k == 3, F.array(F.lit("Vision"), F.lit("tools")))
    families = F.when(k == 1, F.array(F.lit("Llava"))).when(k == 2, F.array(F.lit("nomic-bert"))).otherwise(F.array(F.lit("llama")))
    return D.table(spark, sf, "supplier").select("s_suppkey", F.array_join(json_ops.capabilities(said, families), ",").alias("capabilities"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'blank key' WHEN p_partkey % 5 = 1 THEN 'unknown scope' WHEN p_partkey % 5 = 2 THEN 'workspace scope without workspace' WHEN p_partkey % 5 = 3 THEN 'global scope with workspace' ELSE '' END AS errors FROM part""")
def setting_checks(spark, sf):
    """What is wrong with settings rows."""
    k = F.col("p_partkey") % 5
    key = F.when(k == 0, " ").otherwise(F.col("p_name"))
    scope = F.when(k == 1, "elsewhere").when(k.isin(2, 4), "workspace").otherwise("global")
    workspace = F.when(k.isin(1, 3, 4), F.col("p_partkey"))
    return D.table(spark, sf, "part").select("p_partkey", F.array_join(schemas.setting_errors(key, F.lit("string"), scope, workspace), ",").alias("errors"))


@query("SELECT id, status, status IN ('queued', 'running', 'succeeded', 'failed', 'cancelled') AS known FROM jobs", "jobs")
def job_domains(spark, sf):
    """Values of a closed domain; an unknown one would stop the query."""
    return D.jobs(spark, sf).select("id", schemas.checked(F.col("status"), "job_status").alias("status"), schemas.in_domain(F.col("status"), "job_status").alias("known"))


@query("""SELECT path, kind, 'File' || kind AS event_type, kind <> 'Deleted' AS makes_job, count(*) AS n FROM (SELECT path, list_reduce(list_prepend('', list(kind ORDER BY at_ms, seq)), lambda p, k: CASE k WHEN 'Created' THEN 'Added' WHEN 'Modified' THEN CASE WHEN p = 'Added' THEN 'Added' ELSE 'Updated' END ELSE CASE WHEN p = 'Added' THEN '' ELSE 'Deleted' END END) AS kind
FROM (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY at_ms, seq ROWS UNBOUNDED PRECEDING) AS burst FROM (SELECT *, CASE WHEN at_ms - lag(at_ms) OVER (PARTITION BY path ORDER BY at_ms, seq) < 3600000 THEN 0 ELSE 1 END AS fresh FROM ch)) GROUP BY path, burst) WHERE kind <> '' GROUP BY 1, 2""", "ch")
def change_event_counts(spark, sf):
    """Events and index jobs that debounced changes make."""
    c = debounce.debounced(D.changes(spark, sf), 3_600_000)
    made = events.change_events(c, 1).select(json_ops.payload_long(F.col("payload"), "relative_path").alias("path"), "event_type", F.lit(0).alias("job"))
    jobs = events.change_jobs(c, 1).select(json_ops.payload_long(F.col("payload"), "relative_path").alias("path"), F.lit(None).cast("string").alias("event_type"), F.lit(1).alias("job"))
    both = made.groupBy("path", "event_type").agg(F.count("*").alias("n"))
    with_jobs = jobs.select("path").distinct().withColumn("held", F.lit(True))
    kind = F.regexp_replace("event_type", "^File", "")
    return both.join(with_jobs, "path", "left").select("path", kind.alias("kind"), "event_type", (F.coalesce("held", F.lit(False)) & (kind != "Deleted")).alias("makes_job"), "n")


@query("SELECT node_id, min(label) AS label FROM (SELECT e.from_node_id AS node_id, a.label FROM e JOIN n a ON a.node_id = e.from_node_id UNION ALL SELECT e.to_node_id, b.label FROM e JOIN n b ON b.node_id = e.to_node_id) GROUP BY 1", "e n")
def edge_end_nodes(spark, sf):
    """The distinct nodes of labelled edges."""
    n, own = D.nodes(spark, sf), D.links(spark, sf)
    k = staging.parts(D.table(spark, sf, "lineitem"))
    start = n.select(F.col("node_id").alias("from_node_id"), F.col("label").alias("from_label")).repartition(k, "from_node_id")
    end = n.select(F.col("node_id").alias("to_node_id"), F.col("label").alias("to_label")).repartition(k, "to_node_id")
    return graph.edge_ends(own.join(start, "from_node_id").repartition(k, "to_node_id").join(end, "to_node_id"))


@query("SELECT DISTINCT node_id, document_id FROM src", "src")
def recorded_sources(spark, sf):
    """U4: sources of nodes as a set, however often they are recorded."""
    s = D.recorded(spark, sf)
    return graph.recorded_sources(s.filter("document_id % 3 <> 0"), s.filter("document_id % 2 = 0 OR document_id % 3 = 0"))


@query(_with("kwr", " x AS (SELECT query_id, query, array_to_string(list('[' || n || '] (source: document ' || document_id || ')' || chr(10) || text_content ORDER BY n), chr(10) || chr(10)) AS ctx FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS n FROM kwr WHERE rank <= 5) GROUP BY 1, 2)",
f"SELECT query_id, sha256('SYSTEM' || chr(10) || chr(10) || '{text.REVIEW}' || chr(10) || chr(10) || '{text.MATHS}' || r || 'SOURCES' || chr(10) || chr(10) || ctx || r || 'QUESTION' || chr(10) || chr(10) || query || r || 'REPLY' || chr(10) || chr(10) || 'Write the answer only.') AS prompt_sha FROM (SELECT *, chr(10) || chr(10) || '---' || chr(10) || chr(10) AS r FROM x)"))
def research_prompts(spark, sf):
    """F16: prompts of labelled sources."""
    hits = _keyword_hits(spark, sf, 5)
    named = F.struct("chunk_id", F.concat(F.lit("document "), F.col("document_id").cast("string")).alias("label"), F.col("text_content").alias("text"))
    listed = F.transform(F.array_sort(F.collect_list(named)), lambda x: F.struct(x["label"].alias("label"), x["text"].alias("text")))
    return hits.groupBy("query_id", "query").agg(listed.alias("hits")).select("query_id", F.sha2(text.research_prompt(F.col("query"), F.col("hits")), 256).alias("prompt_sha"))


@query(r"""SELECT p_partkey, inside, CASE WHEN json_valid(inside) THEN inside WHEN contains(inside, '{') THEN regexp_extract(inside, '\{"name": "[^"]*", "n": \{[^}]*\}\}') ELSE inside END AS object FROM (
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN '{"name": "' || p_name || '"}' WHEN 2 THEN '[{"a": "' || p_name || '"}, {"b": 2}]' WHEN 3 THEN 'So: {"name": "} ' || p_name || ' {", "n": {"k": 1}} is it }' ELSE CAST(p_partkey AS VARCHAR) END AS inside FROM part)""")
def fenced_texts(spark, sf):
    """what stands in a code fence, and its JSON: the whole where it is valid, else the first object."""
    k, name = F.col("p_partkey") % 5, F.col("p_name")
    body = (
        F.when(k == 0, name)
        .when(k == 1, F.concat(F.lit('{"name": "'), name, F.lit('"}')))
        .when(k == 2, F.concat(F.lit('[{"a": "'), name, F.lit('"}, {"b": 2}]')))
        .when(k == 3, F.concat(F.lit('So: {"name": "} '), name, F.lit(' {", "n": {"k": 1}} is it }')))
        .otherwise(F.col("p_partkey").cast("string"))
    )
    fenced = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return D.table(spark, sf, "part").select("p_partkey", text.without_fence(fenced).alias("inside"), text.json_text(fenced).alias("object"))
