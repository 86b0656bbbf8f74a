"""A training corpus from ``documents``: five stages, each one operator on all that the stage before it kept.

A stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last
give the columns of ``documents``. Stages are written as Parquet between them,
in the shared checkpoint folder, so that a lost executor costs no earlier stage.

Defined cases are those of the operators; a table without rows gives an empty
result at every stage. Stages with Python workers lower the session's
``spark.sql.execution.arrow.maxRecordsPerBatch`` to ARROW_ROWS, and leave it so:
their plans run after they return.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, table
from tidemark.llm.jaccard_join import keep_one
from tidemark.llm.mixing import mix
from tidemark.llm.packing import pack_documents
from tidemark.llm.queries import MIX_TARGETS, fold_of
from tidemark.llm.secret_scan import redact
from tidemark.llm.toxicity import learn, score

#: Share of the tokens that the mixing stage draws.
MIX_SHARE = 0.8


#: Rows that a Python worker is handed at once, at most: bounds its memory where texts are long.
ARROW_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's number of rows in an Arrow batch to ARROW_ROWS."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by a lexicon learned from ``labels`` (the rows that op2 learns from too)."""
    small_batches(spark)
    lexicon = learn(docs, table(spark, sf_dir, "labels").where(fold_of() != 0))
    return score(docs, lexicon, out="__toxicity").where("__toxicity < 0.5").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar documents the one of the smallest id."""
    small_batches(spark)
    return keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in the text; n_chars follows the text."""
    clean = redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))


def draw_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by calibrated probabilities, so that sources, languages and topics come near their target weights."""
    return mix(docs, MIX_TARGETS, MIX_SHARE).where("mix.sampled").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences: doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    import public_tokenizers

    small_batches(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_copies),
    ("secret_scan", redact_secrets),
    ("mixing", draw_mix),
    ("packing", pack),
]

#: Scores of a learned lexicon, similarity classes and packing are beyond SQL; the tests hold each stage against a brute-force version: every term compared at every place, all pairs, matches by Python's expressions, raking in Python, ids of the tokenizers library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the last stage gives."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
