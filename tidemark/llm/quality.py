"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Two multinomials over hashed n-grams are counted: one over the trusted
documents, one over every document. A document's verdict is the mean, over its
n-grams, of log p_target - log p_raw, held against a fixed threshold. The
n-grams are the 1-grams and 2-grams of a text's words, and beside them those of
the words' shapes (each run of lower-case letters collapsed to ``a``), which
tell stray symbols, shouting and table cells whatever the words are.

All steps are DataFrame functions. Corpus counts are summed before they are
shuffled (at most ``buckets`` rows a task); a document is never shuffled.

Defined cases: null text counts as empty; an empty text has no words, score 0
and fails the base rules; repeated rows are scored each; null ids give rows
with a null id; an empty table gives an empty result; with no trusted document
(or an empty ``trusted`` table) all scores are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, fresh, text_of

#: Hash buckets of the n-grams of words, and after them those of shapes.
WORD_BUCKETS, SHAPE_BUCKETS = 1 << 16, 1 << 13
BUCKETS = WORD_BUCKETS + SHAPE_BUCKETS
#: Documents scoring below this mean log-likelihood ratio (nats an n-gram) are dropped.
THRESHOLD = -0.25
#: Trusted documents that the target multinomial is fitted on, at most: the bound of what is broadcast.
MAX_TARGET_DOCS = 20_000
#: Words in a window that counts as a repeat.
WINDOW = 5
#: What is left of a text without these are its symbols.
NO_SYMBOLS = "[^#*$%&|<>]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_CLASS), lambda w: w != F.lit(""))


def hashes_of(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _grams(hashes: Column, buckets: int, first: int) -> Column:
    """The buckets, from ``first``, of the 1-grams and 2-grams of an array of hashes."""
    place = lambda h: (F.pmod(h, F.lit(buckets)) + first).cast("int")
    many = F.greatest(F.size(hashes) - 1, F.lit(0))
    return F.concat(F.transform(hashes, place), F.zip_with(F.slice(hashes, F.lit(1), many), F.slice(hashes, F.lit(2), many), lambda a, b: place(F.xxhash64(a, b))))


def with_ngrams(df: DataFrame, text: str, hashes: str, out: str) -> DataFrame:
    """Adds ``out``: the hash buckets of the n-grams of column ``text`` and of its shapes; ``hashes`` names the hashes of its words."""
    (shapes,) = fresh(df, "shapes")
    df = df.withColumn(shapes, hashes_of(words_of(F.regexp_replace(F.col(text), "\\p{Ll}+", "a"))))
    return df.withColumn(out, F.concat(_grams(F.col(hashes), WORD_BUCKETS, 0), _grams(F.col(shapes), SHAPE_BUCKETS, WORD_BUCKETS))).drop(shapes)


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_target_docs: int = MAX_TARGET_DOCS) -> DataFrame:
    """One row with the array ``ratios``: log p_target - log p_raw of each bucket, both with add-one smoothing.

    ``trusted`` holds ids in ``id_col``. The ``max_target_docs`` ids of lowest
    hash make up the target.
    """
    ids = trusted.select(F.col(id_col).alias("__id")).where(F.col("__id").isNotNull()).distinct()
    ids = ids.orderBy(F.xxhash64("__id"), "__id").limit(max_target_docs).withColumn("__trusted", F.lit(1))
    grams = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text"))
    grams = grams.join(F.broadcast(ids), "__id", "left").withColumn("__hashes", hashes_of(words_of(F.col("__text"))))
    flagged = with_ngrams(grams, "__text", "__hashes", "__grams")
    counts = (
        # the outer form: explode() has the optimizer compute the n-grams once more, for a filter on their number
        flagged.select(F.coalesce("__trusted", F.lit(0)).alias("__trusted"), F.explode_outer("__grams").alias("bucket"))
        .where("bucket is not null")
        .groupBy("bucket", "__trusted")
        .count()
        .groupBy("bucket")
        .agg(F.sum("count").alias("raw"), F.sum(F.when(F.col("__trusted") == 1, F.col("count")).otherwise(0)).alias("target"))
    )
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(counts, "bucket", "left").select("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    packed = full.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("c"), F.sum("raw").alias("n_raw"), F.sum("target").alias("n_target"))
    ratio = lambda x: F.log((x["target"] + 1) / (F.col("n_target") + BUCKETS)) - F.log((x["raw"] + 1) / (F.col("n_raw") + BUCKETS))
    return packed.select(F.transform("c", lambda x: F.when(F.col("n_target") > 0, ratio(x)).otherwise(F.lit(0.0))).alias("ratios"))


def with_base_rules(df: DataFrame, text: str, words: str, one: str) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words; ``text``, ``words`` and ``one``, the hashes of the words, name columns."""
    hashes, dup, at = fresh(df, "hashes", "dup", "at")
    n = F.size(words)
    t = F.col(text)
    lines = F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit("[^\\x20\\x09-\\x0D]")))
    df = df.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(t, NO_SYMBOLS, "")).cast("long"),
            "__lines": lines,
        }
    )
    # The hash of each window of WINDOW words, from those of its words.
    starts = F.slice(F.col(one), F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(0)))
    df = df.withColumn(hashes, F.transform(starts, lambda h, i: F.xxhash64(h, *(F.get(F.col(one), i + k) for k in range(1, WINDOW)))))
    df = df.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")).drop("__lines")
    # (hash, place) in order; a window repeats where a neighbour has its hash. Most texts have no repeat and skip this.
    pairs = F.sort_array(F.transform(F.col(hashes), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn(dup, F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), pairs).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    none = F.struct(F.lit(None).cast("bigint").alias("h"), F.lit(None).cast("int").alias("i"))
    k = F.size(dup)
    before = F.slice(F.concat(F.array(none), F.col(dup)), F.lit(1), k)
    after = F.slice(F.concat(F.col(dup), F.array(none)), F.lit(2), k)
    hit = F.zip_with(
        F.zip_with(F.col(dup), before, lambda a, b: F.struct(a["i"].alias("i"), (a["h"] == b["h"]).alias("b"), a["h"].alias("h"))),
        after,
        lambda a, c: F.when(F.coalesce(a["b"], F.lit(False)) | F.coalesce(a["h"] == c["h"], F.lit(False)), a["i"]),
    )
    df = df.withColumn(at, F.when(k > 0, F.sort_array(F.filter(hit, lambda i: i.isNotNull()))).otherwise(F.array().cast("array<int>")))
    # Each repeated window covers WINDOW words, less those that the next one covers too.
    nexts = F.slice(F.concat(F.col(at), F.array(F.lit(None).cast("int"))), F.lit(2), F.size(at))
    covered = F.zip_with(F.col(at), nexts, lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    return df.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("bigint"), lambda s, x: s + x)).drop(hashes, dup, at)


def quality(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, max_target_docs: int = MAX_TARGET_DOCS) -> DataFrame:
    """One row for each row of ``docs``: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept."""
    ratios = log_ratios(docs, trusted, id_col, text_col, max_target_docs)
    df = docs.select(F.col(id_col), text_of(text_col).alias("__text"))
    df = df.withColumn("__words", words_of(F.col("__text"))).withColumn("__one", hashes_of(F.col("__words")))
    df = with_base_rules(df, "__text", "__words", "__one")
    df = with_ngrams(df.drop("__words"), "__text", "__one", "__grams").drop("__text", "__one")
    df = df.withColumn("__ratios", ratios.scalar())  # one array of BUCKETS doubles
    total = F.aggregate("__grams", F.lit(0.0), lambda s, g: s + F.get(F.col("__ratios"), g))
    df = df.withColumn("score", F.when(F.size("__grams") > 0, total / F.size("__grams")).otherwise(F.lit(0.0))).drop("__grams", "__ratios")
    df = df.withColumn("base_failed", (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20))
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(threshold)))
