"""Corpus pipeline: five stages over ``documents``, each applying one operator to all rows that the
stage before it kept.

1. toxicity: documents scored at or over the threshold go;
2. near_dedup: one document of each near-duplicate class stays, that of the smallest id;
3. decontamination: documents in which a benchmark window occurs go;
4. pii: personal data is replaced by its kind in brackets, ``n_chars`` follows the new text;
5. sentencepiece: digests of each text's ids and of what they decode to.

All stages but the last return the columns of ``documents``, extra ones included; own columns start
with ``__tessera_``, so names cannot clash. Rows with null or empty texts pass through all stages;
equal rows are one after stage 2; of ties the smallest id stays; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, near_dedup, pii, sentencepiece, toxicity
from tessera.llm.common import stored, table
from tessera.llm.queries import tokenizer_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.toxicity(docs, model) < toxicity.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    proposals = stored(pii.with_spans(docs.select("text")).select("__tessera_more"), "pipeline-proposals")
    return pii.redact(docs, pii.fit(proposals)).withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece.encode_digests(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("sentencepiece", encode_pieces),
]

#: Models and tokenizers are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
