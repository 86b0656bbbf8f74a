"""Masked pseudo-likelihood of documents under a bidirectional window network.

Each token is predicted from ``WINDOW`` tokens on either side of it: the sum of
their embeddings (a table for each place) and a bias go through tanh, and a
two-level softmax gives first the token's group, then the token within it. A
document's score is the sum of the log probabilities of all its tokens, each
with the token itself masked.

Tokens are lower-case words parted by white space. The network's vocabulary
grows with the corpus: the ``WORDS`` most frequent words and every word that
occurs ``FREQUENT`` times. Any other word is for the network one of ``OTHERS``
symbols by its last two characters, which tell more of its language and place in
a sentence than its hash would; in the likelihood that symbol's probability is multiplied
by the word's share of the symbol's tokens (``learn_shares``): its own count for
every word that occurs ``LISTED`` times, the mean count of the rarer ones for
these. One unseen word of count 1 is counted with each symbol, so that words
beyond the corpus have a probability too.

Training is data-parallel, in numpy. In each of ``ROUNDS`` rounds every task
starts from the same parameters and takes Adagrad steps over its documents,
with one in ``STRIDE`` positions of each document as targets (the others in the
next round, so that each position is a target once, and context throughout);
the results are averaged by the number of targets, in two levels, so that no
task sums more than a share of them. What is gathered grows with the number of
tasks and of distinct words; a task sends the network, and tasks are joined as
it grows, so that together they send no more than in proportion to the corpus.
Texts are split into words twice, to count them and to encode them as symbols;
the rounds and the scoring read the encoded table.

Defined cases: null and empty texts have no tokens, log probability 0 and mean
0; repeated rows are scored each (and train each); a null id stays null; very
long texts are worked on in pieces with their context; an empty table gives an
empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, cut, text_of

WORDS, OTHERS = 768, 256
#: Occurrences from which a word is in the network's vocabulary whatever its rank, and from which its count is held.
FREQUENT, LISTED = 5000, 5
#: Tokens on either side, dimensions, groups of the softmax.
WINDOW, DIMENSIONS, GROUPS = 2, 32, 32
ROUNDS, STRIDE, BATCH, RATE = 2, 2, 4096, 0.1
#: Positions that are scored at once, and parameters in a row that a task sends.
CHUNK, BLOCK = 8192, 1 << 14
#: First-level groups of the averaging.
SALTS = 256
#: Tokens for each parameter that a training task has at least, so that what tasks send stays in proportion to the corpus.
TOKENS_A_PARAMETER = 2

SIZE = WORDS + OTHERS
#: Symbols beyond the first SIZE come after PAD.
PAD = SIZE
OFFSETS = tuple(k for k in range(-WINDOW, WINDOW + 1) if k)


def shapes(side: int) -> dict[str, tuple[int, ...]]:
    """Of the parameters of a network of ``side`` groups of ``side`` symbols."""
    return {"tables": (len(OFFSETS), side * side + 1, DIMENSIONS), "bias": (DIMENSIONS,), "group_w": (DIMENSIONS, side), "group_b": (side,), "word_w": (side, DIMENSIONS, side), "word_b": (side, side)}


def parameters(side: int) -> int:
    return sum(int(np.prod(x)) for x in shapes(side).values())


def side_of(n_words: int) -> int:
    """Groups of the network for so many words."""
    return max(GROUPS, math.isqrt(max(0, n_words + OTHERS - 1)) + 1)


class Network:
    """The parameters, in one flat array with named views."""

    def __init__(self, flat: np.ndarray | None = None, side: int = GROUPS):
        if flat is None:
            flat = np.zeros(parameters(side), dtype=np.float32)
            rng = np.random.default_rng(11)
            n = int(np.prod(shapes(side)["tables"]))
            flat[:n] = rng.normal(0, 0.1, n)
        self.side = next(s for s in itertools.count(1) if parameters(s) >= len(flat))
        self.flat = flat.astype(np.float32, copy=True)
        at = 0
        for name, shape in shapes(self.side).items():
            n = int(np.prod(shape))
            setattr(self, name, self.flat[at : at + n].reshape(shape))
            at += n

    def places(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Groups of symbols, and their places within them."""
        index = target - (target > PAD)
        return index % self.side, index // self.side

    def hidden(self, context: np.ndarray) -> np.ndarray:
        """tanh of the summed embeddings; ``context`` has a row of symbols for each place of OFFSETS."""
        h = self.tables[0][context[0]]
        for k in range(1, len(OFFSETS)):
            h = h + self.tables[k][context[k]]
        return np.tanh(h + self.bias)

    def by_group(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order of targets by group, the ends of groups in it, and the places within them in it."""
        group, word = self.places(target)
        order = np.argsort(group.astype(np.uint16), kind="stable")
        return order, np.searchsorted(group[order], np.arange(self.side + 1)), word[order]

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        order, ends, word = self.by_group(target)
        h = self.hidden(context[:, order])
        columns = np.arange(len(target))
        found = _log_softmax_at(self.group_w.T @ h.T + self.group_b[:, None], np.repeat(np.arange(self.side), np.diff(ends)), columns)
        for g in range(self.side):
            a, b = ends[g], ends[g + 1]
            if a < b:
                found[a:b] += _log_softmax_at(self.word_w[g].T @ h[a:b].T + self.word_b[g][:, None], word[a:b], columns[: b - a])
        out = np.empty_like(found)
        out[order] = found
        return out

    def train_step(self, context: np.ndarray, target: np.ndarray, squares: Network, rate: float = RATE) -> None:
        """One Adagrad step on the mean log loss; ``squares`` holds the summed squares of gradients."""
        n = len(target)
        order, ends, word = self.by_group(target)
        context = context[:, order]  # of one group after another, so that a group's rows are a slice
        h = self.hidden(context)
        columns = np.arange(n)
        # symbols down, positions across: sums over the symbols are sums of long rows
        error = _softmax(self.group_w.T @ h.T + self.group_b[:, None])
        error[np.repeat(np.arange(self.side), np.diff(ends)), columns] -= 1
        back = error.T @ self.group_w.T
        steps = [("group_w", ..., h.T @ error.T), ("group_b", ..., error.sum(1))]
        word_w, word_b = np.zeros_like(self.word_w), np.zeros_like(self.word_b)
        for g in range(self.side):
            a, b = ends[g], ends[g + 1]
            if a < b:
                e = _softmax(self.word_w[g].T @ h[a:b].T + self.word_b[g][:, None])
                e[word[a:b], columns[: b - a]] -= 1
                back[a:b] += e.T @ self.word_w[g].T
                np.matmul(h[a:b].T, e.T, out=word_w[g])
                e.sum(1, out=word_b[g])
        steps += [("word_w", ..., word_w), ("word_b", ..., word_b)]
        back *= 1 - h * h
        steps.append(("bias", ..., back.sum(0)))
        for k in range(len(OFFSETS)):
            by = np.argsort(context[k].astype(np.uint16) if self.side < 256 else context[k], kind="stable")
            ids = context[k][by]
            starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            steps.append(("tables", (k, ids[starts]), np.add.reduceat(back[by], starts)))
        for name, where, gradient in steps:
            gradient *= np.float32(1 / n)
            view, seen = getattr(self, name), getattr(squares, name)
            sums = seen[where] + gradient * gradient
            seen[where] = sums
            np.sqrt(sums, out=sums)
            sums += np.float32(1e-6)
            gradient /= sums
            gradient *= np.float32(rate)
            view[where] -= gradient


def _softmax(x: np.ndarray) -> np.ndarray:
    """Of each column, in place."""
    x -= x.max(0)
    np.exp(x, out=x)
    x /= x.sum(0)
    return x


def _log_softmax_at(x: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The log softmax of each column of ``x`` (which is used up) at one of its rows."""
    x -= x.max(0)
    own = x[rows, columns]
    np.exp(x, out=x)
    return own - np.log(x.sum(0))


def others_of(hashes: np.ndarray) -> np.ndarray:
    """The symbols, from 0, of words beyond the vocabulary."""
    return (hashes.view(np.uint64) % np.uint64(OTHERS)).astype(np.int64)


def _other_column():
    return F.pmod(F.col("word"), F.lit(OTHERS)).cast("int")  # as ``others_of``: OTHERS is a power of two


def symbols(hashes: np.ndarray, vocabulary: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Symbols of word hashes: the vocabulary's (sorted, with each word's symbol in ``places``), or one of the others."""
    out = (WORDS + others_of(hashes)).astype(np.int32)
    if len(vocabulary):
        at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
        known = vocabulary[at] == hashes
        out[known] = places[at[known]]
    return out


def with_padding(tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after another, WINDOW pads before and after each; and the places of the tokens."""
    place = np.arange(len(tokens)) + WINDOW * (1 + np.repeat(np.arange(len(lengths)), lengths))
    flat = np.full(len(tokens) + WINDOW * (len(lengths) + 1), PAD, dtype=np.int32)
    flat[place] = tokens
    return flat, place


def contexts(flat: np.ndarray, place: np.ndarray) -> np.ndarray:
    return np.stack([flat[place + k] for k in OFFSETS])


def targets(lengths: np.ndarray, number: int, rounds: int = ROUNDS, stride: int = STRIDE) -> np.ndarray:
    """Whether each token is a target of a round; the first one differs from text to text."""
    inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(np.arange(len(lengths)), lengths)
    return (inside + number * (stride // rounds)) % stride == 0


def words_of(text):
    """The numbers of a text's words: hashes, whose last bits are the symbol (of OTHERS, a power of two) that a word has if it is beyond the vocabulary."""
    number = lambda w: F.xxhash64(w).bitwiseAND(F.lit(-OTHERS)).bitwiseOR(F.pmod(F.xxhash64(F.substring(w, -2, 2)), F.lit(OTHERS)))
    return F.transform(F.filter(F.split(F.lower(text), SPACE_CLASS), lambda w: w != F.lit("")), number)


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (word, count): the hash of each word of all documents, and its occurrences."""
    return cut(docs.select(F.explode_outer(words_of(text_of(text_col))).alias("word")).where("word is not null").groupBy("word").count())


def learn_vocabulary(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the network's words, sorted, and their symbols (by rank)."""
    by_rank = [F.desc("count"), "word"]
    top = counts.orderBy(*by_rank).limit(WORDS).union(counts.where(F.col("count") >= FREQUENT)).distinct().orderBy(*by_rank)
    hashes = top.select("word").toArrow()["word"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], np.where(order < WORDS, order, order + OTHERS + 1).astype(np.int32)


def learn_shares(counts: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words beyond the vocabulary: hashes of the listed ones, sorted, the logs of their shares of their symbol, and the log share of any other word by symbol."""
    other = _other_column()
    known = counts.sparkSession.createDataFrame(pa.table({"word": pa.array(vocabulary, pa.int64())}))
    rest = counts.join(F.broadcast(known), "word", "left_anti")
    rare = F.col("count") < LISTED
    sums = rest.groupBy(other.alias("other")).agg(F.sum("count").alias("n"), F.sum(F.when(rare, F.col("count")).otherwise(0)).alias("rare_n"), F.sum(rare.cast("long")).alias("rare_words")).collect()
    mass, rare_n, rare_words = np.ones(OTHERS), np.ones(OTHERS), np.ones(OTHERS)  # the unseen word
    for r in sums:
        mass[r["other"]] += r["n"]
        rare_n[r["other"]] += r["rare_n"]
        rare_words[r["other"]] += r["rare_words"]
    held = rest.where(~rare).select("word", F.col("count").cast("int").alias("count")).toArrow()
    words, n = held["word"].to_numpy(), held["count"].to_numpy()
    order = np.argsort(words)
    words, n = words[order], n[order]
    return words, (np.log(n) - np.log(mass[others_of(words)])).astype(np.float32), np.log(rare_n / rare_words / mass)


def log_shares(hashes: np.ndarray, tokens: np.ndarray, shares: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Of each token the log of its word's share of its symbol."""
    words, logs, rest = shares
    out = np.zeros(len(tokens))
    at = np.flatnonzero((tokens >= WORDS) & (tokens < SIZE))
    own = hashes[at]
    out[at] = rest[tokens[at] - WORDS]
    if len(words):
        place = np.minimum(np.searchsorted(words, own), len(words) - 1)
        held = words[place] == own
        out[at[held]] = logs[place[held]]
    return out


def _texts(batch: pa.RecordBatch, vocabulary: np.ndarray, places: np.ndarray, most: int = 1 << 17) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes, symbols, lengths) of some rows at a time."""
    words = batch.column("words")
    offsets = words.offsets.to_numpy().astype(np.int64)
    values = words.values.to_numpy(zero_copy_only=False)
    at = 0
    while at < len(offsets) - 1:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        hashes = values[offsets[at] : offsets[end]]
        yield at, end, hashes, symbols(hashes, vocabulary, places), np.diff(offsets[at : end + 1])
        at = end


def encode(docs: DataFrame, vocabulary: np.ndarray, places: np.ndarray, shares: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, n_tokens, symbols, share): of each document its symbols, as whole numbers of ``symbol_type``, and the sum of its words' log shares."""
    kind = symbol_type(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column("id"), 0
            for first, end, hashes, tokens, lengths in _texts(batch, vocabulary, places):
                total = np.zeros(end - first)
                some = lengths > 0
                if shares is not None and some.any():
                    total[some] = np.add.reduceat(log_shares(hashes, tokens, shares), (np.cumsum(lengths) - lengths)[some])
                ends = np.concatenate([[0], np.cumsum(lengths)]) * kind.itemsize
                held = pa.Array.from_buffers(pa.large_binary(), end - first, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(tokens.astype(kind))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(at, end - first), pa.array(lengths), held, pa.array(total)], names=["id", "n_tokens", "symbols", "share"])
                at += end - first

    own = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), words_of(text_of(text_col)).alias("words"))
    return rows.mapInArrow(run, f"id {own}, n_tokens bigint, symbols binary, share double").withColumnRenamed("id", id_col)


def symbol_type(vocabulary: np.ndarray) -> np.dtype:
    """The little-endian type that symbols are written in."""
    return np.dtype("<u2" if len(vocabulary) + OTHERS + 1 < 1 << 16 else "<u4")


def _documents(batch: pa.RecordBatch, kind: np.dtype, most: int = 1 << 17) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, symbols, lengths) of some rows at a time."""
    lengths = batch.column("n_tokens").to_numpy().astype(np.int64)
    held, ends, at = batch.column("symbols"), np.cumsum(lengths), 0
    while at < len(lengths):
        before = ends[at] - lengths[at]
        end = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield at, end, np.frombuffer(b"".join(x.as_buffer() for x in held.slice(at, end - at)), dtype=kind).astype(np.int32), lengths[at:end]
        at = end


def train(encoded: DataFrame, vocabulary: np.ndarray, rounds: int = ROUNDS, stride: int = STRIDE) -> np.ndarray:
    """The flat parameters of a network for the documents that ``encode`` gives."""
    flat, kind = Network(side=side_of(len(vocabulary))).flat, symbol_type(vocabulary)
    n_tokens = encoded.agg(F.sum("n_tokens")).first()[0] or 0
    rows = encoded.select("n_tokens", "symbols")
    rows = rows.coalesce(max(encoded.sparkSession.sparkContext.defaultParallelism, n_tokens // (TOKENS_A_PARAMETER * len(flat))))

    def one_round(start: np.ndarray, number: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            net, squares = Network(start), Network(np.zeros_like(start))
            held: list[tuple[np.ndarray, np.ndarray]] = []
            waiting = seen = 0
            for batch in batches:
                for _, _, tokens, lengths in _documents(batch, kind):
                    flat_tokens, place = with_padding(tokens, lengths)
                    chosen = place[targets(lengths, number, rounds, stride)]
                    held.append((contexts(flat_tokens, chosen), flat_tokens[chosen]))
                    waiting += len(chosen)
                    if waiting >= BATCH:
                        context, target = np.concatenate([x[0] for x in held], 1), np.concatenate([x[1] for x in held])
                        end = waiting - waiting % BATCH
                        for i in range(0, end, BATCH):
                            net.train_step(context[:, i : i + BATCH], target[i : i + BATCH], squares)
                        held, seen, waiting = [(context[:, end:], target[end:])], seen + end, waiting - end
            if waiting:
                net.train_step(np.concatenate([x[0] for x in held], 1), np.concatenate([x[1] for x in held]), squares)
                seen += waiting
            if seen:
                parts = [net.flat[i : i + BLOCK] for i in range(0, len(net.flat), BLOCK)]
                task = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_pydict({"block": pa.array(range(len(parts)), pa.int32()), "task": pa.array([task] * len(parts), pa.int32()), "weight": pa.array([float(seen)] * len(parts)), "part": pa.array([p.tobytes() for p in parts], pa.binary())})

        def add(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("task")  # one order of summing, whatever the order of arrival
            weight = group["weight"].to_numpy()
            total = sum(np.frombuffer(p, dtype=np.float32).astype(np.float64) * w for p, w in zip(group["part"], weight, strict=True)) / weight.sum()
            return pd.DataFrame({"block": group["block"].iloc[:1], "task": group["task"].iloc[:1], "weight": [weight.sum()], "part": [total.astype(np.float32).tobytes()]})

        schema = "block int, task int, weight double, part binary"
        sent = rows.mapInArrow(run, schema)
        first = sent.groupBy("block", F.pmod("task", F.lit(SALTS)).alias("salt")).applyInPandas(lambda g: add(g), schema)
        summed = {r["block"]: r["part"] for r in first.groupBy("block").applyInPandas(lambda g: add(g), schema).collect()}
        return np.concatenate([np.frombuffer(summed[b], dtype=np.float32) for b in sorted(summed)]) if summed else start

    for number in range(rounds):
        flat = one_round(flat, number)
    return flat


def score(encoded: DataFrame, vocabulary: np.ndarray, flat: np.ndarray, id_col: str = "doc_id") -> DataFrame:
    """Rows (id_col, n_tokens, logprob, mean_logprob), one for each document that ``encode`` gives: of its words if it was given shares, else of their symbols."""
    kind = symbol_type(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(flat)
        for batch in batches:
            total = batch.column("share").to_numpy().copy()
            for first, end, tokens, lengths in _documents(batch, kind):
                flat_tokens, place = with_padding(tokens, lengths)
                logs = np.zeros(len(tokens))
                for i in range(0, len(place), CHUNK):
                    p = place[i : i + CHUNK]
                    logs[i : i + CHUNK] = net.log_probabilities(contexts(flat_tokens, p), flat_tokens[p])
                some = lengths > 0
                if some.any():
                    total[first:end][some] += np.add.reduceat(logs, (np.cumsum(lengths) - lengths)[some])
            n = batch.column("n_tokens").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n), pa.array(total), pa.array(total / np.maximum(n, 1))], names=["id", "n_tokens", "logprob", "mean_logprob"])

    own = encoded.schema[id_col].dataType.simpleString()
    rows = encoded.select(F.col(id_col).alias("id"), "n_tokens", "symbols", "share")
    return rows.mapInArrow(run, f"id {own}, n_tokens bigint, logprob double, mean_logprob double").withColumnRenamed("id", id_col)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A network trained on ``docs`` and their scores by it. Texts are counted once and encoded once; all rounds and the scoring read the encoded table."""
    counts = count_words(docs, text_col)
    vocabulary, places = learn_vocabulary(counts)
    encoded = cut(encode(docs, vocabulary, places, learn_shares(counts, vocabulary), id_col, text_col))
    return score(encoded, vocabulary, train(encoded, vocabulary), id_col)
