"""Registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import shared_dir, stored, table


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import sentencepiece

    return sentencepiece.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", toxicity.is_held_out(F.col("doc_id")).alias("held_out"), toxicity.toxicity(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import pii

    # Texts are searched once; only spans and features are kept for fitting and selecting.
    spans = stored(pii.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "pii-spans")
    return pii.digest(spans, pii.fit(spans))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import decontamination

    found = decontamination.with_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), "d")
    return found.select("doc_id", "d.n_words", "d.n_hit", "d.n_items", "d.items_sha256", "d.contaminated")


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import chat

    calls, results = chat.turn_calls(table(spark, sf_dir, "conversations"))
    made = chat.format_calls(calls, results, chat.ASK)
    return made.select("call_id", F.col("turn"), "level", "n_results", "valid", F.length("json").cast("long").alias("n_chars"), F.sha2("json", 256).alias("json_sha256"))


OP5_SQL = r"""
WITH RECURSIVE m AS (
  SELECT CAST(conv_id AS VARCHAR) AS scope, turn, role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL
), c AS (
  SELECT scope, scope || '-' || turn AS call_id, min(turn) AS turn, min(text) AS text
  FROM m WHERE role = 'user' GROUP BY 1, 2
), r AS (
  SELECT scope || '-' || (turn - 1) AS call_id, count(*) AS n_results, min(text) AS result
  FROM m WHERE role <> 'user' GROUP BY 1
), j AS (
  SELECT c.scope, c.call_id, c.turn, c.text, len(list_filter(regexp_split_to_array(c.text, '[ \t\n\r]+'), lambda w: w <> '')) AS words,
         scope || '-' || (c.turn - 2) AS needs, coalesce(r.n_results, 0) AS n_results, r.result
  FROM c LEFT JOIN r USING (call_id)
), e AS (
  SELECT j.*, list_concat(
      CASE WHEN length(text) < 1 THEN ['text: minLength'] ELSE CAST([] AS VARCHAR[]) END,
      CASE WHEN length(text) > 100000 THEN ['text: maxLength'] ELSE CAST([] AS VARCHAR[]) END,
      CASE WHEN words < 1 THEN ['words: minimum'] ELSE CAST([] AS VARCHAR[]) END,
      CASE WHEN words > 100 THEN ['words: maximum'] ELSE CAST([] AS VARCHAR[]) END,
      CASE WHEN turn >= 2 AND needs NOT IN (SELECT call_id FROM c) THEN ['missing call: ' || needs] ELSE CAST([] AS VARCHAR[]) END) AS errors
  FROM j
), v AS (
  SELECT call_id, 0 AS level FROM j WHERE turn < 2 OR needs NOT IN (SELECT call_id FROM c)
  UNION ALL
  SELECT j.call_id, v.level + 1 FROM j JOIN v ON j.needs = v.call_id WHERE j.turn >= 2
), s AS (
  SELECT call_id, turn, level, n_results, len(errors) = 0 AS valid,
    CAST(to_json({'arguments': CAST(to_json({'text': text, 'words': words}) AS VARCHAR),
      'depends_on': CASE WHEN turn >= 2 THEN [needs] ELSE CAST([] AS VARCHAR[]) END,
      'errors': errors, 'id': call_id, 'level': level, 'name': 'ask', 'result': result}) AS VARCHAR) AS json
  FROM e JOIN v USING (call_id)
)
SELECT call_id, turn, CAST(level AS INTEGER) AS level, n_results, valid, CAST(length(json) AS BIGINT) AS n_chars, sha256(json) AS json_sha256 FROM s
"""


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import html_extract

    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", html_extract.extracted(F.col("html")).alias("x")).select("page_id", "url", "x.text", "x.n_chars")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import ann

    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import near_dedup

    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import token_files

    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"))
    return token_files.read_digests(spark, path)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import token_counts

    return token_counts.section_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import filter_audit

    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d
), l AS (
  SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INTEGER)) AS good, max(CAST(coalesce(toxic = 1, false) AS INTEGER)) AS toxic FROM labels GROUP BY 1
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words),
    100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(first < w.doc_id, false)] AS fails
  FROM w LEFT JOIN l USING (doc_id)
), n AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL
), s AS (
  SELECT unnest([1, 2, 3, 4, 5]) AS i
), o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM s a, s b, s c, s d, s e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), g AS (
  SELECT part, array_to_string(list_transform(o, lambda x: 'ABCDE'[x]), '') AS filter_order, i AS step, o[i] AS f, fails[o[i]] AS failing,
    len(list_filter(o[1:i-1], lambda x: fails[x])) > 0 AS gone, len(list_filter(fails, lambda x: x)) = 1 AS alone, n, good, toxic
  FROM n, o, s
), r AS (
  SELECT part, filter_order, step, f, CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND NOT failing), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND failing), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (WHERE gone AND failing), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (WHERE failing AND alone), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (WHERE NOT gone AND failing), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (WHERE NOT gone AND failing), 0) AS BIGINT) AS toxic_lost
  FROM g GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
"""


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import suffix_dedup

    columns = [F.col("doc_id"), F.col("n_bytes"), F.col("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")]
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), select=columns)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import lexical_search

    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), n AS (
  SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM d WHERE len(terms) > 0
), t AS (
  SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d
), c AS (
  SELECT doc_id, n, term, count(*) AS tf FROM t GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM c, n GROUP BY term, docs
), q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * c.n * docs) // total)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN c USING (term), n GROUP BY 1, 2
), r AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sentencepiece, op2_toxicity, op3_pii, op4_decontamination, op5_tool_calls, op6_html_extraction, op7_nearest_neighbours, op8_near_duplicates, op9_token_files, op10_token_counts, op11_filter_audit, op12_suffix_dedup, op13_lexical_search)}


def oracle_sql() -> dict[str, str]:
    return {"op5_tool_calls": OP5_SQL, "op11_filter_audit": OP11_SQL, "op13_lexical_search": OP13_SQL}
