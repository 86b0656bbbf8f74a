"""Approximate nearest neighbours by additive quantisation, largest inner product first.

A vector's direction is coded as a sum of one full-dimensional codeword from
each of several codebooks; its norm is stored. Codebooks start as residual
k-means and are refined by least squares; codes are found by beam search.
Queries are scored against codes by lookup tables, and the best candidates are
reranked exactly, in double precision, on the original vectors: of the first
block of the index that a query meets the ``rerank`` best, and of every block
all that could still be among the k best found so far. What a vector could reach
is its approximate score and ``SPREAD`` deviations of its coding error, whose
length is stored with its norm; so among thousands of nearly equal vectors, as
many as need be are reranked, without a cap.

Codebooks are fitted on a bounded sample (``max_train`` distinct vectors, by
hash); every vector is indexed. Equal vectors are indexed once, with as many of
their smallest ids as a result can need, so a vector that a third of the rows
share costs no more than another. Queries (a stated set of rows) meet the index
block by block: a task holds a block of queries and reads a part of the index,
nothing is copied by a shuffle, and each part gives at most k rows a query, of
which a window keeps the k best. Every code is looked at: vectors without
clusters, like those of the test tables, have their neighbours in most cells of
any coarse partition (README), so that inverted lists would lose what they save.

Defined cases: vectors that are null, empty, zero, or hold nulls or non-finite
components take no part, nor do those of a length other than the most frequent
one; null ids take no part; of the rows that repeat an id the one of the least
vector counts; ties go to the smaller id; fewer candidates than k give all of them; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Codebooks, codewords in each, and width of the beam.
BOOKS, WORDS, BEAM = 8, 256, 4
#: Distinct vectors that the codebooks are fitted on, at most.
MAX_TRAIN = 16_384
#: Vectors in a block of the index, queries in a block, and candidates of a block that are reranked for a query.
BLOCK, QUERY_BLOCK, RERANK = 2048, 512, 100
#: Vectors in a partition of the index: of those each query keeps its k best before results are shuffled.
PART = 1 << 17
MAX_QUERY_PARTS = 512
FIELDS = ["codes", "norms", "errors", "vectors", "ids", "counts"]
#: Deviations of a score's coding error that are allowed for.
SPREAD = 3.0


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        nearest = (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        n = np.bincount(nearest, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)])
    return centres


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (rows by books): beam search for the codeword sums nearest to the rows of ``x``."""
    m, k, _ = books.shape
    out = np.empty((len(x), m), dtype=np.uint8 if k <= 256 else np.uint16)
    for at in range(0, len(x), 1024):
        part = x[at : at + 1024]
        n = len(part)
        codes = np.zeros((n, 1, 0), dtype=np.int64)
        rest = part[:, None, :]
        error = np.zeros((n, 1))
        for b in range(m):
            # the error once a word is taken off: |r|^2 - 2 r.c + |c|^2; |r|^2 is `error` up to a constant
            gain = error[:, :, None] - 2 * (rest @ books[b].T) + (books[b] ** 2).sum(1)
            flat = gain.reshape(n, -1)
            width = min(beam, flat.shape[1])
            top = np.argpartition(flat, width - 1, axis=1)[:, :width]
            parent, word = top // k, top % k
            rows = np.arange(n)[:, None]
            error = flat[rows, top]
            codes = np.concatenate([codes[rows, parent], word[:, :, None]], axis=2)
            rest = rest[rows, parent] - books[b][word]
        out[at : at + n] = codes[np.arange(n), error.argmin(1)]
    return out


def train(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 2, seed: int = 7) -> np.ndarray:
    """Codebooks (books, words, dimensions) for the rows of ``x``."""
    rng = np.random.default_rng(seed)
    words = max(1, min(words, len(x) // 4))
    out, rest = [], x.copy()
    for _ in range(books):
        centres = _means(rest, words, rng)
        rest = rest - centres[(rest @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)]
        out.append(centres)
    found = np.stack(out)
    for _ in range(rounds):  # least squares over all books at once, given the codes
        codes = encode(x, found, 1).astype(np.int64) + np.arange(books) * words
        pairs = np.zeros((books * words, books * words))
        sums = np.zeros((books * words, x.shape[1]))
        for a in range(books):
            np.add.at(sums, codes[:, a], x)
            for b in range(books):
                np.add.at(pairs, (codes[:, a], codes[:, b]), 1.0)
        solved = np.linalg.solve(pairs + 0.1 * np.eye(len(pairs)), sums + 0.1 * found.reshape(len(pairs), -1))
        found = solved.reshape(found.shape)
    return found


def valid(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", books: int = BOOKS, words: int = WORDS, beam: int = BEAM, rerank: int = RERANK, max_train: int = MAX_TRAIN) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each row that ``is_query`` picks, its ``k`` nearest among all other rows."""
    rows = vectors.where(F.col(id_col).isNotNull() & valid(F.col(vector_col))).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("q"))
    empty = vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return empty
    d = sizes["d"]
    rows = rows.where(F.size("v") == d)
    # k + 1 ids of equal vectors are enough: a query is itself one of them at most
    first = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    rows = cut(rows.groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q")))
    distinct = cut(rows.withColumn("n", first).where(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    sample = distinct.select("v").orderBy(F.xxhash64("v")).limit(max_train)
    x = sample.toArrow()["v"].combine_chunks().flatten().to_numpy().reshape(-1, d)  # max_train vectors at most
    codebooks = train(x / np.linalg.norm(x, axis=1, keepdims=True), books, words)

    def index_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.iloc[at : at + BLOCK]
                v = np.array(part["v"].tolist(), dtype=np.float64).reshape(len(part), d)
                norms = np.linalg.norm(v, axis=1)
                ids = np.full((len(part), k + 1), -1, dtype=np.int64)
                for i, own in enumerate(part["ids"]):
                    ids[i, : len(own)] = own
                counts = np.array([len(own) for own in part["ids"]], dtype=np.int64)
                codes = encode(v / norms[:, None], codebooks, beam)
                coded = sum(codebooks[b][codes[:, b]] for b in range(len(codebooks))) * norms[:, None]
                errors = np.linalg.norm(v - coded, axis=1) / np.sqrt(d)  # of one component, as the error has no direction
                yield pd.DataFrame({"codes": [codes.astype(np.uint16).tobytes()], "norms": [norms.tobytes()], "errors": [errors.tobytes()], "vectors": [v.tobytes()], "ids": [ids.tobytes()], "counts": [counts.tobytes()]})

    def query_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), QUERY_BLOCK):
                part = batch.iloc[at : at + QUERY_BLOCK]
                yield pd.DataFrame({"query_ids": [part["id"].to_numpy(np.int64).tobytes()], "queries": [np.array(part["v"].tolist(), dtype=np.float64).tobytes()]})

    def compact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        rows = 0
        join = lambda: pd.DataFrame([tuple(b"".join(x) for x in zip(*held, strict=True))], columns=FIELDS)
        for batch in batches:
            for r in batch[FIELDS].itertuples(index=False):
                held.append(tuple(r))
                rows += len(r.norms) // 8
                if rows >= BLOCK:
                    yield join()
                    held, rows = [], 0
        if held:
            yield join()

    def near_ones(r, q: np.ndarray, qid: np.ndarray, floor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query of a block: ids and scores of its best in a block of the index, those below ``floor`` left out."""
        codes = np.frombuffer(r.codes, dtype=np.uint16).reshape(-1, codebooks.shape[0]).astype(np.int64)
        v = np.frombuffer(r.vectors).reshape(-1, d)
        ids = np.frombuffer(r.ids, dtype=np.int64).reshape(-1, k + 1)
        counts = np.frombuffer(r.counts, dtype=np.int64)
        slack = (np.frombuffer(r.errors) * SPREAD).astype(np.float32)
        n = len(v)
        # lookup tables: a query's inner product with each codeword; a vector's score is its norm times a sum of lookups
        about = np.zeros((len(q), n), dtype=np.float32)
        for b in range(codebooks.shape[0]):
            about += (q @ codebooks[b].T).astype(np.float32)[:, codes[:, b]]
        about *= np.frombuffer(r.norms).astype(np.float32)
        least = floor.copy()
        new = np.flatnonzero(np.isneginf(floor))
        if len(new):
            width = min(max(rerank, k + 1), n)
            top = np.argpartition(-about[new], width - 1, axis=1)[:, :width]
            exact = np.einsum("qrd,qd->qr", v[top], q[new])
            # the query itself may be among the best: one more than k
            place = width - 1 - min(k, width - 1)
            least[new] = np.partition(exact, place, axis=1)[:, place] if width > k else -np.inf
        lengths = np.linalg.norm(q, axis=1)
        reach = about + slack * lengths[:, None].astype(np.float32)
        for i in range(len(q)):
            near = np.flatnonzero(reach[i] >= least[i] - 1e-4 * abs(least[i])) if np.isfinite(least[i]) else np.arange(n)
            scores = v[near] @ q[i]
            if len(near) > k + 1:
                best = scores >= np.partition(scores, len(scores) - 1 - k)[len(scores) - 1 - k]
                near, scores = near[best], scores[best]
            # equal vectors stand for several ids, one of them perhaps the query's own
            own, scores = ids[near], np.repeat(scores[:, None], k + 1, 1)
            there = (np.arange(k + 1) < counts[near][:, None]) & (own != qid[i])
            yield best_of(own[there], scores[there])

    def best_of(ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((ids, -scores))[:k]
        return ids[order], scores[order]

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The best of each block of queries over all blocks of the index that its task holds."""
        asking, best = b"", []

        def frame() -> pd.DataFrame:
            qid = np.frombuffer(asking, dtype=np.int64)
            return pd.DataFrame({"query_id": np.repeat(qid, [len(x[0]) for x in best]), "vec_id": np.concatenate([x[0] for x in best]), "score": np.concatenate([x[1] for x in best])})

        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.query_ids != asking:
                    if best:
                        yield frame()
                    asking, best = r.query_ids, []
                qid = np.frombuffer(asking, dtype=np.int64)
                floor = np.array([x[1][k - 1] if len(x[1]) >= k else -np.inf for x in best]) if best else np.full(len(qid), -np.inf)
                found = near_ones(r, np.frombuffer(r.queries).reshape(-1, d), qid, floor)
                best = [best_of(np.concatenate([x[0], y[0]]), np.concatenate([x[1], y[1]])) for x, y in zip(best, found, strict=True)] if best else list(found)
        if best:
            yield frame()

    schema = ", ".join(f"{x} binary" for x in FIELDS)
    parts = -(-distinct.count() // PART)
    index = cut(distinct.mapInPandas(index_blocks, schema).repartition(parts).mapInPandas(compact, schema))
    asked = cut(rows.where("q").select("id", "v").mapInPandas(query_blocks, "query_ids binary, queries binary"))
    asked = asked.repartition(max(1, min(asked.count(), MAX_QUERY_PARTS)))  # a block of queries a task, as far as that goes
    found = asked.crossJoin(index).mapInPandas(meet, "query_id bigint, vec_id bigint, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
