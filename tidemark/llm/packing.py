"""Cost-balanced packing of tokenised documents into sequences of bounded length.

A document's ids end with a separator id. It is first cut into pieces of at
most the sequence length; full pieces are sequences by themselves. The rest are
packed in blocks of a bounded number of ids: the cost of a piece of n ids is
estimated as ``linear * n + quadratic * n * n`` (attention grows with the
square of a piece), and pieces go, in descending order, to the sequence of
lowest cost with room for them. A piece that fits nowhere whole is cut: the
cheapest sequence that is not full takes what it has room for, and the rest
queues again. A block's sequences are full; what is left of it goes to the next
block, and of a partition's last block to one sequence for each power of two in
it. Neither kind is padded.

Blocks are cut from the rows of one input partition in their order, so packing
shuffles nothing, holds one block at a time, and gives the same pieces when a
lost task runs again. Sequence ids are unique over all partitions: partition
number in the upper bits, a counter in the lower 33.

Ids are those that the ``tokenizers`` library gives for the vocabulary file. By
default they are computed by ``tiktoken`` from the same file's vocabulary,
which is several times faster; ``engine="tokenizers"`` uses that library itself.

Defined cases: null and empty texts have the separator alone; repeated rows are
packed each; a null id stays null; very long texts, and runs of white space of
any length, are cut like others; an empty table gives no pieces.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEQUENCE = 2048
SEPARATOR = 1
#: Estimated cost of a piece of n ids: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / SEQUENCE
#: Ids that a block holds before it is packed (pieces below the sequence length only).
BLOCK_IDS = 1 << 20
#: White space, as the vocabulary's pattern has it, so long that its run is cut out of a text.
LONG_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{20000,}")

PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


@functools.lru_cache(maxsize=4)
def encoder(vocabulary: str, engine: str = "tiktoken"):
    """A function from texts to their lists of ids, without special tokens added."""
    if engine == "tokenizers":
        import os

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        plain = Tokenizer.from_file(vocabulary)
        return lambda texts: [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    import public_tokenizers
    import tiktoken

    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    # The file writes each byte as a printable character: itself where it is one, else the next free code from 256.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    as_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    ranks = {bytes(as_byte[c] for c in token): n for token, n in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> list[int]:
        """The pattern's engine gives up on very long runs of white space; these are taken out and merged as the pieces that the pattern makes of them."""
        out, at = [], 0
        for run in LONG_SPACE.finditer(text):
            after = run.end() < len(text) and not text.startswith(tuple(special), run.end())
            end = run.end() - after  # the last character goes with what follows
            out += fast.encode(text[at : run.start()], allowed_special="all")
            out += fast._encode_single_piece(text[run.start() : end])
            at = end
        return out + fast.encode(text[at:], allowed_special="all")

    return lambda texts: [encode(t) for t in texts]


def powers_of_two(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack_block(lengths: list[int], sequence: int = SEQUENCE, linear: float = LINEAR, quadratic: float = QUADRATIC, last: bool = True) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """Pieces (which, start, length, sequence number, offset) of the given lengths, and what is left (which, start, length).

    All sequences but those for the rest of the ``last`` block are full; of other blocks that rest is what is left.
    """
    full, rest = divmod(sum(lengths), sequence)
    room = np.array([sequence] * full + powers_of_two(rest) * last, dtype=np.int64)
    total = room.copy()
    cost = np.zeros(len(room))
    queue = [(-n, i, 0) for i, n in enumerate(lengths) if n]
    heapq.heapify(queue)
    out, spare = [], int(room.sum())
    while spare:
        n, i, start = heapq.heappop(queue)
        n = -n
        fits = np.where(room >= n, cost, np.inf)
        s = int(fits.argmin())
        if fits[s] == np.inf:
            s = int(np.where(room > 0, cost, np.inf).argmin())
        take = min(n, int(room[s]))
        out.append((i, start, take, s, int(total[s] - room[s])))
        room[s] -= take
        spare -= take
        cost[s] += linear * take + quadratic * take * take
        if take < n:
            heapq.heappush(queue, (take - n, i, start + take))
    return out, sorted((i, start, -n) for n, i, start in queue)


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, separator: int = SEPARATOR, linear: float = LINEAR, quadratic: float = QUADRATIC, block_ids: int = BLOCK_IDS, engine: str = "tiktoken") -> DataFrame:
    """Rows of ``PIECES``; ``ids`` are little-endian unsigned 32-bit, ``start`` counts the document's ids before the piece."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode = encoder(vocabulary, engine)
        number = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        block: list[tuple] = []  # (doc id, start, ids, ids of the document)
        held = 0

        def flush(last: bool) -> None:
            nonlocal number, block, held
            pieces, left = pack_block([len(x[2]) for x in block], sequence, linear, quadratic, last)
            for i, at, n, s, offset in pieces:
                doc, start, ids, whole = block[i]
                rows.append((doc, start + at, n, ids[at : at + n].tobytes(), whole, number + s, offset))
            number += 1 + max((p[3] for p in pieces), default=-1)
            block = [(doc, start + at, ids[at : at + n], whole) for (doc, start, ids, whole), at, n in ((block[i], at, n) for i, at, n in left)]
            held = sum(len(x[2]) for x in block)

        def frame() -> pd.DataFrame:
            nonlocal rows
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            rows = []
            names = [x.split()[0] for x in PIECES.split(", ")]
            return pd.DataFrame({name: pd.array(c, dtype="Int64") if name != "ids" else pd.Series(c, dtype=object) for name, c in zip(names, cols, strict=True)})

        for batch in batches:
            for begin in range(0, len(batch), 64):
                part = batch.iloc[begin : begin + 64]
                for doc, tokens in zip(part["id"], encode([t if isinstance(t, str) else "" for t in part["text"]]), strict=True):
                    doc = None if pd.isna(doc) else int(doc)
                    ids = np.array([*tokens, separator], dtype="<u4")
                    whole = len(ids)
                    cut = whole - whole % sequence
                    for start in range(0, cut, sequence):
                        rows.append((doc, start, sequence, ids[start : start + sequence].tobytes(), whole, number, 0))
                        number += 1
                    if cut < whole:
                        block.append((doc, cut, ids[cut:].copy(), whole))
                        held += whole - cut
                    if held >= block_ids:
                        flush(False)
                if len(rows) >= 2000:
                    yield frame()
        flush(True)
        yield frame()

    df = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return df.mapInPandas(run, PIECES)
