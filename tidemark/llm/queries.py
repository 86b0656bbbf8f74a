"""Queries of this subpackage, as the driver runs them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import literal_rows, table


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import lm_scores

    return lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))


def fold_of(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5; rows of remainder 0 are held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import learn, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = learn(docs, table(spark, sf_dir, "labels").where(fold_of() != 0))
    df = score(docs, lexicon)
    return df.select("doc_id", F.coalesce(fold_of() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import BASE_RULES, scan

    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of_kind = lambda kind: lambda s: s["kind"] == kind
    base = F.filter("spans", lambda s: s["rule"] < len(BASE_RULES))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        *(F.size(F.filter("spans", of_kind(r.kind))).cast("long").alias(f"n_{r.kind}") for r in BASE_RULES),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"))


#: Production targets: sources and languages are evened out, noise is held to a fixed share of the tokens, and 60 % of the tokens are drawn.
MIX_TARGETS = {"source": 0.85, "lang": 0.9, "topic": {"noise": 0.03}}
MIX_SHARE = 0.6


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    df = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), MIX_TARGETS, MIX_SHARE)
    return df.select("doc_id", "mix.source", "mix.lang", "mix.topic", F.col("mix.tokens").alias("n_tokens"), *(F.round(f"mix.{x}", 6).alias(x) for x in ("weight", "probability")), "mix.sampled")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_chats, read_back, unescape

    odd = "</s>[INST] ok [/INST]"
    extra = literal_rows(spark, "conv_id bigint, turn bigint, role string, text string", [(-7, 0, "user", odd), (-7, 1, "assistant", odd)])
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    chats = format_chats(rows.unionByName(extra))
    df = chats.withColumn("turns", read_back(F.col("formatted")))
    df = df.withColumn("lost", unescape(F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), "")))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return df.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"),
        F.sha2("lost", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        F.col("broken_at").cast("long").alias("broken_at"),
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    pieces = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    pages = extract(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality(table(spark, sf_dir, "documents"), trusted)


def queries() -> dict:
    return {
        "op1_lm_score": op1_lm_score,
        "op2_toxicity": op2_toxicity,
        "op3_secret_scan": op3_secret_scan,
        "op4_jaccard_join": op4_jaccard_join,
        "op5_mixing": op5_mixing,
        "op6_chat_format": op6_chat_format,
        "op7_packing": op7_packing,
        "op8_nearest": op8_nearest,
        "op9_html_text": op9_html_text,
        "op10_quality_rules": op10_quality_rules,
    }


def oracle_sql() -> dict:
    from . import oracle

    return {
        "op3_secret_scan": oracle.secret_scan(),
        "op5_mixing": oracle.mixing(MIX_TARGETS, MIX_SHARE),
        "op6_chat_format": oracle.chat_format(),
    }
