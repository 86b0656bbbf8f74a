"""N-gram Jaccard self-join with Bayesian pruning of candidate pairs.

Texts are sets of five-word shingles (lower case, words parted by white space;
a shorter text is one shingle). Linked are texts of a Jaccard similarity of at
least ``threshold``.

1. Equal texts are one node. A node has ``HASHES`` MinHash values, a byte each.
2. Nodes meet in buckets of equal bands. Within a bucket, MinHash values are
   compared step by step; a pair is dropped when the posterior probability
   (uniform prior) that its similarity reaches the threshold falls below
   ``TOLERANCE``. Pairs that are left connect nodes to families.
3. Within a family every pair is pruned in the same way and those left are
   verified exactly, on the shingles themselves (as 64-bit hashes).
4. Verified links give each text its number of links and its class.

No pair is ever a row: a bucket or family is split by hash into blocks of
bounded size, pairs of blocks meet in one task each, and a task gives link
counts and a spanning forest. A bucket only has to tell what hangs together, so
a text is compared with one of each group that has been found first, and with
the others only where that leaves groups apart: a bucket of near copies takes
time in proportion to its size. The number of links of each text in a family
needs all its pairs; blocks grow with the family, so that of m texts each is
copied at most 32 times up to m = 32,768, and m / 1,024 times beyond (or as
often as blocks of ``BLOCK_WORDS`` words need). A pair at the threshold shares no band with a
probability of 6e-5, and of these most meet in a family all the same; nothing
else is left out.

Defined cases: null text counts as empty; texts without words are similar to
each other alone (similarity 1); repeated rows are copies of each other; null
ids are kept, and a class that has only null ids has a null class; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, cut, fresh, text_of
from .graph import components

SHINGLE, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
BANDS, ROWS = 32, 6
HASHES = BANDS * ROWS
#: MinHash values that are compared before a pair is judged again.
STEP = 32
#: Members of a block of a bucket; of a family, at least and at most, words of such a block, and blocks that a family is split into before they grow.
BUCKET_BLOCK = 2048
FAMILY_BLOCK, MAX_FAMILY_BLOCK, BLOCK_WORDS, FAMILY_BLOCKS = 256, 1024, 1 << 21, 32
#: Members of a bucket up to which all pairs are compared at once.
FEW = 32
#: Rows that may be broadcast; beyond them the join shuffles.
MAX_BROADCAST_ROWS = 200_000

_RNG = np.random.default_rng(20_240_229)
_A = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def word_hashes(text: Column) -> Column:
    """Array of the 64-bit hashes of a text's words."""
    return F.transform(F.filter(F.split(F.lower(text), SPACE_CLASS), lambda w: w != F.lit("")), lambda w: F.xxhash64(w))


def _mixed(s: np.ndarray) -> np.ndarray:
    s = (s ^ (s >> np.uint64(30))) * _Q
    return s ^ (s >> np.uint64(29))


def shingle_positions(words: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of texts whose words stand one after another, and how many each text has. Short texts have one."""
    n = len(words)
    s = np.zeros(n, dtype=np.uint64)
    until = np.repeat(ends, lengths)
    at = np.arange(n)
    for k in range(SHINGLE):
        inside = at + k < until
        s = np.where(inside, s * _P + words[np.minimum(at + k, n - 1)] + np.uint64(k + 1), s)
    first = at == until - np.repeat(lengths, lengths)
    keep = (at + SHINGLE <= until) | first
    return _mixed(s[keep]), np.where(lengths > 0, np.maximum(lengths - SHINGLE + 1, 1), 0)


def minhashes(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A row of HASHES bytes for each text; all 255 where it has no words."""
    out = np.full((len(lengths), HASHES), 255, dtype=np.uint8)
    ends = np.cumsum(lengths)
    shingles, counts = shingle_positions(words, ends, lengths)
    full = counts > 0
    if full.any():
        starts = (np.cumsum(counts) - counts)[full]
        for k in range(HASHES):
            h = ((shingles * _A[k] + _B[k]) >> np.uint64(32)).astype(np.uint32)
            out[full, k] = np.minimum.reduceat(h, starts) & 0xFF
    return out


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id, words) to (key, id, sig, and n, the number of words)."""
    for batch in batches:
        words = batch.column("words")
        offsets = words.offsets.to_numpy()
        values = words.values.to_numpy(zero_copy_only=False).view(np.uint64)
        lengths = np.diff(offsets)
        sigs, at = [], 0
        while at < len(lengths):  # some texts at a time, so that the arrays stay in the cache
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + 100_000, side="right")) - 1)
            end = min(end, len(lengths))
            sigs.append(minhashes(values[offsets[at] : offsets[end]], lengths[at:end].astype(np.int64)))
            at = end
        flat = np.concatenate(sigs) if sigs else np.zeros((0, HASHES), dtype=np.uint8)
        sig = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer((np.arange(len(lengths) + 1) * HASHES).astype(np.int32)), pa.py_buffer(flat.tobytes())])
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("id"), sig, pa.array(lengths, pa.int64())], names=["key", "id", "sig", "n"])


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each number n of compared values: the fewest matches m with P(similarity >= threshold | m of n) >= tolerance.

    With a uniform prior the posterior of the match probability is a Beta
    distribution, whose upper tail is a binomial sum: P(Bin(n + 1, t) <= m).
    Values are bytes, so unequal ones match with a probability of 1/256.
    """
    t = threshold + (1 - threshold) / 256
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, 0
        while True:
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out[n] = m
    return out


def surviving(sigs: np.ndarray, i: np.ndarray, j: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Of the pairs (i, j) of rows of ``sigs``: the numbers of those that the posterior does not drop."""
    left = np.arange(len(i))
    same = np.zeros(len(i), dtype=np.int32)
    for n, m in least.items():
        if not len(left):
            break
        kept = []
        for at in range(0, len(left), 1 << 16):
            part = left[at : at + (1 << 16)]
            same[part] += (sigs[i[part], n - STEP : n] == sigs[j[part], n - STEP : n]).sum(1, dtype=np.int32)
            kept.append(part[same[part] >= m])
        left = np.concatenate(kept)
    return left


def block_pairs(block: np.ndarray, first: int, second: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places: all within one block, or all across two."""
    if first == second:
        return np.triu_indices(len(block), 1)
    a, b = np.flatnonzero(block == first), np.flatnonzero(block == second)
    return np.repeat(a, len(b)), np.tile(b, len(a))


def forest(nodes: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node) that connect what the pairs connect."""
    label = nodes.copy()
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        if (label == before).all():
            break
    moved = label != nodes
    return nodes[moved], label[moved]


def connected(sigs: np.ndarray, block: np.ndarray, first: int, second: int, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places that connect what all surviving pairs of a pair of blocks connect."""
    if len(block) <= FEW:
        i, j = block_pairs(block, first, second)
        left = surviving(sigs, i, j, least)
        return i[left], j[left]
    group = np.arange(len(block))  # the least place that each place hangs together with
    pivots, others = np.flatnonzero(block == first), np.flatnonzero(block == second)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for p in pivots:
        apart = others[(group[others] != group[p]) & ((others > p) | (first != second))]
        if not len(apart):
            continue
        one_each = apart[np.unique(group[apart], return_index=True)[1]]
        for rest in (one_each, None):
            at = apart[(group[apart] != group[p]) & ~np.isin(apart, one_each)] if rest is None else rest
            hits = at[surviving(sigs, np.full(len(at), p), at, least)]
            if len(hits):
                out.append((np.full(len(hits), p), hits))
                joined = np.unique(np.append(group[hits], group[p]))
                group[np.isin(group, joined)] = joined[0]
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([x[0] for x in out] or [none]), np.concatenate([x[1] for x in out] or [none])


def groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches cut at the ends of groups, with the places where groups begin (and the end). Rows come sorted by ``keys``."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        k = batch[keys].to_numpy()
        last = np.flatnonzero((k != k[-1]).any(1))
        end = last[-1] + 1 if len(last) else 0
        if held and (held[-1][keys].to_numpy()[-1] != k[0]).any():
            yield _cut_up(held, keys)
            held = []
        if end:
            held.append(batch.iloc[:end])
            yield _cut_up(held, keys)
            held = []
        held.append(batch.iloc[end:])
    if held:
        yield _cut_up(held, keys)


def _cut_up(parts: list[pd.DataFrame], keys: list[str]) -> tuple[pd.DataFrame, np.ndarray]:
    df = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0].reset_index(drop=True)
    k = df[keys].to_numpy()
    return df, np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1, [len(df)]])


def in_block_pairs(df: DataFrame, key: str, blocks: Column, node: str) -> DataFrame:
    """Rows dealt out to pairs of ``blocks`` blocks (key, first, second), sorted so within partitions; ``block`` tells a row's own block."""
    n = blocks.cast("int")
    own = F.pmod(F.xxhash64(node), n).cast("int")
    dealt = df.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    dealt = dealt.withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")}).drop("other")
    return dealt.repartition(key, "first", "second").sortWithinPartitions(key, "first", "second", node)


def family_edges(nodes: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Edges (u, v) between nodes that share a bucket in which the posterior connects them."""
    least = least_matches(threshold, tolerance)
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring("sig", b * ROWS + 1, F.lit(ROWS))))
    rows = nodes.select("node", F.explode(bands).alias("bucket"))
    crowded = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = rows.join(crowded, "bucket").join(nodes.select("node", "sig"), "node")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df, bounds in groups(batches, ["bucket", "first", "second"]):
            sigs = np.frombuffer(b"".join(df["sig"]), dtype=np.uint8).reshape(-1, HASHES)
            node, block = df["node"].to_numpy(), df["block"].to_numpy()
            first, second = df["first"].to_numpy(), df["second"].to_numpy()
            sizes = np.diff(bounds)
            two = bounds[:-1][(sizes == 2) & ((first == second)[bounds[:-1]] | (block[bounds[:-1]] != block[np.minimum(bounds[:-1] + 1, len(block) - 1)]))]
            left = two[surviving(sigs, two, two + 1, least)]
            out = [(np.maximum(node[left], node[left + 1]), np.minimum(node[left], node[left + 1]))]
            for a, b in zip(bounds[:-1][sizes > 2], bounds[1:][sizes > 2], strict=True):
                i, j = connected(sigs[a:b], block[a:b], first[a], second[a], least)
                out.append(forest(node[a:b], i, j))
            yield pd.DataFrame({"u": np.concatenate([x[0] for x in out]), "v": np.concatenate([x[1] for x in out])})

    dealt = in_block_pairs(members, "bucket", F.ceil(F.col("size") / BUCKET_BLOCK), "node")
    return dealt.select("bucket", "first", "second", "block", "node", "sig").mapInPandas(compare, "u bigint, v bigint")


def exact_links(words: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Of the pairs (i, j) of texts: the numbers of those whose shingle sets have a similarity of at least ``threshold``."""
    if not len(i):
        return i
    sets = [np.unique(shingle_positions(w.view(np.uint64), np.array([len(w)]), np.array([len(w)]))[0]) if len(w) else np.zeros(0, np.uint64) for w in words]
    size = np.array([len(s) for s in sets])
    every, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    width = int(shared.sum())
    if len(i) > 64 and len(sets) ** 2 * width < 2e3 * len(i) * max(1.0, size.mean()):  # as products of 0/1 matrices
        column = np.cumsum(shared) - 1
        row = np.repeat(np.arange(len(sets)), size)
        use = shared[place]
        row, col = row[use], column[place[use]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        common = np.zeros((len(sets), len(sets)), dtype=np.float32)
        for at in range(0, width, 4096):
            a, b = np.searchsorted(col, [at, at + 4096])
            x = np.zeros((len(sets), min(4096, width - at)), dtype=np.float32)
            x[row[a:b], col[a:b] - at] = 1
            common += x @ x.T
        both = common[i, j]
    else:
        both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) if min(size[a], size[b]) >= threshold * max(size[a], size[b]) else 0 for a, b in zip(i, j, strict=True)])
    either = size[i] + size[j] - both
    return np.flatnonzero((both >= threshold * either - 1e-9) | (either == 0))


def similarity_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row for each text that ``docs`` holds: key (md5 of the text), class_id, links.

    class_id is the smallest id in the class; links counts the other rows of
    ``docs`` that are linked with a row of this text, copies among them.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text")).select("id", F.md5(F.col("text").cast("binary")).alias("key"), "text")
    signed = rows.select("key", "id", word_hashes(F.col("text")).alias("words")).mapInArrow(signatures, "key string, id bigint, sig binary, n bigint")
    nodes = signed.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("n").alias("n"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    families = components(family_edges(nodes, threshold, tolerance))
    members = cut(families.join(nodes, "node").select("node", "root", "key", "id", "copies", "n"))
    sizes = members.groupBy("root").agg(F.count("*").alias("size"), F.sum("n").alias("n_words"))
    block = F.least(F.lit(MAX_FAMILY_BLOCK), F.greatest(F.lit(FAMILY_BLOCK), F.col("size") / FAMILY_BLOCKS))
    sizes = sizes.select("root", F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("n_words") / BLOCK_WORDS), F.lit(1)).alias("blocks"))
    wanted = cut(members.join(sizes, "root").drop("n"))
    few = wanted
    few = F.broadcast(few) if wanted.count() <= MAX_BROADCAST_ROWS else few
    texts = rows.withColumnRenamed("id", "own").join(few, "key").where(F.col("own").eqNullSafe(F.col("id"))).select("node", "root", "blocks", "copies", word_hashes(F.col("text")).alias("words"))
    texts = texts.groupBy("node", "root", "blocks", "copies").agg(F.first("words").alias("words"))  # rows may repeat an id and its text
    least = least_matches(threshold, tolerance)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df, bounds in groups(batches, ["root", "first", "second"]):
            u, v, links = [], [], []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                part = df.iloc[a:b]
                node, copies = part["node"].to_numpy(), part["copies"].to_numpy()
                words = list(part["words"])
                sigs = minhashes(np.concatenate(words).view(np.uint64), np.array([len(w) for w in words]))
                i, j = block_pairs(part["block"].to_numpy(), part["first"].iloc[0], part["second"].iloc[0])
                kept = surviving(sigs, i, j, least)
                i, j = i[kept], j[kept]
                sure = exact_links(words, i, j, threshold)
                i, j = i[sure], j[sure]
                count = np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
                some = count > 0
                high, low = forest(node, i, j)
                u += [node[some], high]
                v += [np.full(some.sum(), -1), low]
                links += [count[some], np.zeros(len(high))]
            yield pd.DataFrame({"u": np.concatenate(u), "v": np.concatenate(v), "links": np.concatenate(links).astype(np.int64)})

    dealt = in_block_pairs(texts, "root", F.col("blocks"), "node")
    found = cut(dealt.select("root", "first", "second", "block", "node", "copies", "words").mapInPandas(verify, "u bigint, v bigint, links bigint"))
    links = found.where("v = -1").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(found.where("v >= 0").select("u", "v"))
    placed = nodes.select("node", "key", "id", "copies").join(roots, "node", "left").join(links, "node", "left")
    placed = placed.withColumn("root", F.coalesce("root", "node"))
    names = placed.groupBy("root").agg(F.min("id").alias("class_id"))
    return placed.join(names, "root").select("key", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row for each row of ``docs``: id_col, class_id, n_links."""
    classes = similarity_classes(docs, id_col, text_col, threshold, tolerance)
    rows = docs.select(F.col(id_col), F.md5(text_of(text_col).cast("binary")).alias("__key"))
    return rows.join(classes.withColumnRenamed("key", "__key"), "__key").select(id_col, "class_id", F.col("links").alias("n_links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the row of the smallest id (nulls last, then by text), once."""
    classes = cut(similarity_classes(docs, id_col, text_col, threshold, tolerance))
    key = F.md5(text_of(text_col).cast("binary"))
    pairs = docs.select(F.col(id_col).cast("bigint").alias("__id"), key.alias("__key")).join(classes.select(F.col("key").alias("__key"), "class_id"), "__key")
    # a class of null ids is named by its texts
    name = F.struct(F.col("class_id"), F.when(F.col("class_id").isNull(), F.col("__key")))
    least = pairs.groupBy(name.alias("name")).agg(F.min(F.struct(F.col("__id").isNull().alias("last"), F.col("__id").alias("id"), F.col("__key").alias("key"))).alias("m"))
    stays = cut(least.select(F.col("m.id").alias("__id"), F.col("m.key").alias("__key")))
    key_col, own_key, own_id = fresh(docs, "key", "own_key", "own_id")
    stays = stays.select(F.col("__id").alias(own_id), F.col("__key").alias(own_key))
    rows = docs.withColumn(key_col, key)
    rows = rows.join(stays, F.col(key_col) == F.col(own_key)).where(F.col(own_id).eqNullSafe(F.col(id_col).cast("bigint")))
    # rows that repeat one id and text: one of them stays
    return rows.groupBy(own_id, own_key).agg(*(F.first(F.col(f"`{c}`")).alias(c) for c in docs.columns)).select(*(f"`{c}`" for c in docs.columns))
