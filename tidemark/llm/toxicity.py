"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length, with exception phrases.

Texts are folded before matching: compatibility forms, case, look-alike letters
of other scripts, and digits and signs that stand for letters. 1, l and i fold
to one letter, as 1 stands for either. Signs beside letters are matched both as
letters ("$tupid", "a$$hole") and as signs ("@idiot"). The lexicon is a short list of
seeds and what is learned from labelled rows: words, and beginnings of words where no single word stands for them, that
toxic texts have far oftener than others; a term's weight is the log ratio of its rates. A
match counts at the beginning of a word (and, for whole words, up to its end)
and not inside an exception phrase. The sum of weights for each 1,000 words is
turned into a score by a logistic curve whose middle is fitted.

The labelled rows are a bounded sample: at most about ``max_train`` (by hash of
the id), near copies among them counted once. Every text is scored whole, in
Arrow batches, without a shuffle; the lexicon has at most ``max_terms`` terms.

Defined cases: null and empty texts score as texts without a match; repeated
rows are scored each; rows with a null id or label teach nothing; several
labels for one id count as toxic if one does; with no toxic or no other
labelled row the lexicon is that of the seeds, with a fixed middle; texts without
a match always score below 0.5; empty tables give empty results.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, text_of

MAX_TRAIN = 20_000
MAX_TERMS = 2_000
#: Toxic texts that a term must stand in: this many, and this share of them.
MIN_TEXTS, MIN_SHARE = 5, 0.005
#: Least weight of a term (log ratio of its rates in toxic and other texts), and the greatest share of other texts that may have it.
MIN_WEIGHT, MAX_OTHERS = 3.0, 0.02
#: Lengths of the beginnings of words that can be terms.
STEMS = range(4, 9)
#: Times that a term counts in one text when the lexicon is learned, at most.
MAX_TIMES = 3
#: Texts whose terms a task counts together.
COUNT_TEXTS = 500
#: Steepness of the logistic score.
SLOPE = 2.0

# Letters of other scripts by the Latin letters they look like.
HOMOGLYPHS = {
    "a": "аαɑ", "b": "вβЬ", "c": "сϲ", "d": "ԁ", "e": "еєεҽ", "g": "ɡ", "h": "һнη", "i": "іıιӏ", "j": "ј", "k": "кκ", "m": "мμ", "n": "пո",
    "o": "оοσօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "t": "тτ", "u": "υս", "v": "ѵν", "w": "ԝω", "x": "хχ", "y": "уγү", "z": "ᴢ",
}
# Digits and signs by the letters they stand for.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "€": "e", "!": "i", "|": "i"}
#: Characters that hide inside words without being seen.
UNSEEN = "­​‌‍⁠﻿"

# Terms that need no labelled row, unless other texts have them as well.
SEEDS = ("asshole", "bastard", "bitch", "clown", "cunt", "disgusting", "dumbass", "fuck", "idiot", "imbecile", "loser", "moron", "pathetic", "retard", "scum", "shithead", "slut", "stupid", "trash", "whore", "worthless")
SEED_WEIGHT = 4.0
#: Strength at which a score is 0.5 where no labels tell: one term of SEED_WEIGHT in 500 words.
DEFAULT_MIDDLE = math.log1p(1000 * SEED_WEIGHT / 500)

#: Phrases in which a term is meant otherwise.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "take out the trash", "clown fish", "class clown", "pathetic fallacy", "pond scum")

_FOLD = str.maketrans({ord(c): to for to, group in HOMOGLYPHS.items() for c in group} | {ord(a): b for a, b in SUBSTITUTES.items()} | {ord("l"): "i"} | {ord(c): None for c in UNSEEN})
_SIGNS = re.compile(r"[@$€!|]+")
_WORD = re.compile(r"[^\W\d_]+")


def _lettered(m: re.Match) -> str:
    """A run of signs as letters: all of it before a letter or digit; after one, up to a "!" or "|"."""
    run, text = m[0], m.string
    if m.end() < len(text) and text[m.end()].isalnum():
        n = len(run)
    elif m.start() and text[m.start() - 1].isalnum():
        n = len(run) - len(run.lstrip("@$€"))
    else:
        n = 0
    return "".join(SIGNS[c] for c in run[:n]) + run[n:]


def fold(text: str) -> str:
    """``text`` as it is matched, signs as letters; white space stays where it is."""
    return folds(text)[-1]


def folds(text: str) -> list[str]:
    """``text`` folded with signs as signs and, where that is another text, with signs as letters; both are of one length."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    out = [text]
    if any(s in text for s in SIGNS):
        lettered = _SIGNS.sub(_lettered, text)
        out += [lettered] * (lettered != text)
    return [x.translate(_FOLD) for x in out]


@dataclass(frozen=True)
class Lexicon:
    #: (folded term, whether it is a whole word, weight)
    terms: tuple[tuple[str, bool, float], ...] = ()
    exceptions: tuple[str, ...] = EXCEPTIONS
    #: score = 1 / (1 + exp(-(bias + slope * strength)))
    bias: float = -math.inf
    slope: float = 0.0

    def score(self, strength: float) -> float:
        x = self.bias + self.slope * strength
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


class Matcher:
    """A lexicon's automaton."""

    def __init__(self, lexicon: Lexicon):
        self.automaton = ahocorasick.Automaton()
        found: dict[str, list] = {}
        for term, whole, weight in lexicon.terms:
            found.setdefault(term, []).append((len(term), whole, weight))
        for phrase in lexicon.exceptions:
            found.setdefault(fold(phrase), []).append((len(fold(phrase)), True, None))
        for key, entries in found.items():
            self.automaton.add_word(key, entries)
        self.any = bool(found)
        if self.any:
            self.automaton.make_automaton()

    def matches(self, folded: list[str]) -> list[tuple[int, int, float]]:
        """(start, end, weight) of each counted match in any of a text's folds."""
        if not self.any:
            return []
        terms, spared = [], []
        for own in folded:
            for last, entries in self.automaton.iter(own):
                end = last + 1
                for size, whole, weight in entries:
                    start = end - size
                    if start and own[start - 1].isalnum() or whole and end < len(own) and own[end].isalnum():
                        continue
                    (spared if weight is None else terms).append((start, end, weight))
        if spared:
            terms = [t for t in terms if not any(a <= t[0] and t[1] <= b for a, b, _ in spared)]
        best: dict[int, tuple[int, int, float]] = {}  # of those that begin at one place the weightiest
        for t in terms:
            if t[0] not in best or best[t[0]][2] < t[2]:
                best[t[0]] = t
        return list(best.values())

    def strength(self, text: str) -> tuple[float, int, int]:
        """log(1 + weight for each 1,000 words), number of matches, number of words."""
        folded = folds(text)
        words = len(folded[0].split())
        found = self.matches(folded)
        return math.log1p(1000 * sum(t[2] for t in found) / max(words, 20)), len(found), words


def candidate_terms(text: str) -> Counter:
    """How often, MAX_TIMES at most, each folded word (marked by a space at its end) and each beginning of a word stands in ``text``; under "" the number of words."""
    words = Counter(_WORD.findall(fold(text)))
    found: Counter = Counter()
    for w, n in words.items():
        if len(w) >= STEMS[0]:
            found[w + " "] += n
            for k in STEMS:
                if len(w) >= k:
                    found[w[:k]] += n
    found = Counter({w: min(n, MAX_TIMES) for w, n in found.items()})
    found[""] = words.total()
    return found


def choose_terms(weights: dict[str, tuple[float, float]], max_terms: int = MAX_TERMS) -> list[tuple[str, bool, float]]:
    """Of candidates with (times in toxic texts, weight): those that tell most, none within another's reach; of nearly equal ones the whole word, else the longest stem."""
    gain = {c: times * w for c, (times, w) in weights.items()}
    chosen: dict[str, float] = {}
    for c in sorted(gain, key=lambda c: (-gain[c], c)):
        if len(chosen) >= max_terms:
            break
        plain = c.strip()
        if any(plain.startswith(x.strip()) or x.startswith(plain) for x in chosen):
            continue
        near = [x for x in gain if x.startswith(plain) and gain[x] >= (0.9 if x[-1] == " " else 0.97) * gain[c]]
        best = max(near, key=lambda x: (x[-1] == " ", len(x), x))
        chosen[best] = weights[best][1]
    return [(c.strip(), c[-1] == " ", w) for c, w in sorted(chosen.items(), key=lambda x: (-x[1], x[0]))]


def fit(x: np.ndarray, y: np.ndarray, slope: float = SLOPE) -> tuple[float, float]:
    """Bias and slope of the logistic score: 0.5 stands where the fewest rows fall on the wrong side, in the middle of the widest such gap."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    # wrong[k]: texts below the k-th value taken as harmless, the others as toxic
    wrong = np.concatenate([[0], np.cumsum(y)]) + (len(y) - y.sum()) - np.concatenate([[0], np.cumsum(1 - y)])
    low = np.concatenate([[x[0] - 1], x])
    high = np.concatenate([x, [x[-1] + 1]])
    gap = high - low
    # a text without a match is never taken as toxic; of equally good places the one that spares most texts
    wrong = np.where((gap > 1e-9) & (low >= 0), wrong, np.inf)
    best = np.flatnonzero(wrong == wrong.min())[::-1]
    k = best[gap[best].argmax()]
    return float(-slope * (low[k] + high[k]) / 2), slope


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN, max_terms: int = MAX_TERMS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """A lexicon from the texts of ``docs`` that ``labels`` (id_col, label_col 0 or 1) marks."""
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("__toxic"))
    share = min(1.0, max_train / max(1, marks.count()))
    marks = marks.where(F.pmod(F.xxhash64("__id"), F.lit(1_000_000)) < int(share * 1_000_000))
    words = F.split(F.lower("__text"), "\\s+")
    rows = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text")).join(F.broadcast(marks), "__id")
    # near copies mostly share the least hash of their windows of three words; of those that do one teaches
    rows = rows.withColumn("__words", words).withColumn("__key", F.coalesce(F.array_min(F.transform("__words", lambda w, i: F.xxhash64(w, F.get("__words", i + 1), F.get("__words", i + 2)))), F.lit(0)))
    rows = cut(rows.drop("__words").dropDuplicates(["__key", "__toxic"]))
    size = {r["__toxic"]: r["count"] for r in rows.groupBy("__toxic").count().collect()}
    toxic, others = size.get(1, 0), size.get(0, 0)
    if not toxic or not others:
        return Lexicon(tuple((fold(w), True, SEED_WEIGHT) for w in SEEDS), exceptions, -SLOPE * DEFAULT_MIDDLE, SLOPE)
    seeds = {fold(w) + " " for w in SEEDS}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), COUNT_TEXTS):  # what is held at once is the terms of so many texts
                part = batch.iloc[at : at + COUNT_TEXTS]
                times, texts = {0: Counter(), 1: Counter()}, {0: Counter(), 1: Counter()}
                for text, mark in zip(part["__text"], part["__toxic"], strict=True):
                    found = candidate_terms(text)
                    times[mark == 1].update(found)
                    texts[mark == 1].update(found.keys())
                terms = list(times[0].keys() | times[1].keys())
                yield pd.DataFrame({"term": terms} | {f"{a}{k}": np.fromiter((c[k][t] for t in terms), np.int64, len(terms)) for a, c in (("times", times), ("texts", texts)) for k in (0, 1)})

    names = [f"{a}{k}" for a in ("times", "texts") for k in (0, 1)]
    counts = rows.select("__text", "__toxic").mapInPandas(count, "term string, " + ", ".join(f"{x} long" for x in names)).groupBy("term").agg(*(F.sum(x).alias(x) for x in names))
    fits = (F.col("texts1") >= max(MIN_TEXTS, math.ceil(MIN_SHARE * toxic))) & (F.col("texts0") <= max(1, MAX_OTHERS * others))
    counts = cut(counts.where(fits | F.col("term").isin("", *sorted(seeds))))
    words = counts.where("term = ''").first()
    weight = F.log((F.col("times1") + 0.5) / max(1, words["times1"])) - F.log((F.col("times0") + 0.5) / max(1, words["times0"]))
    known = {r["term"]: (r["texts0"], r["weight"]) for r in counts.where(F.col("term").isin(*sorted(seeds))).withColumn("weight", weight).collect()}
    strong = counts.where((F.col("term") != "") & fits & (weight >= MIN_WEIGHT)).orderBy(F.desc(weight * F.col("times1")), "term").limit(10 * max_terms)
    terms = choose_terms({r["term"]: (r["times1"], r["weight"]) for r in strong.withColumn("weight", weight).collect()}, max_terms)
    told = [t for t, _, _ in terms]
    for seed in sorted(seeds):  # those that the labels neither taught nor speak against
        elsewhere, w = known.get(seed, (0, SEED_WEIGHT))
        if not any(seed.startswith(t) for t in told) and (elsewhere <= MAX_OTHERS * others or w >= MIN_WEIGHT):
            terms.append((seed.strip(), True, SEED_WEIGHT))
    plain = Lexicon(tuple(terms), exceptions)
    seen = score(rows, plain, text_col="__text", out="__score", raw=True).select("__score", "__toxic").toPandas()  # at most max_train rows
    bias, slope = fit(seen["__score"].to_numpy(float), seen["__toxic"].to_numpy(float))
    return Lexicon(tuple(terms), exceptions, bias, slope)


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", out: str = "score", raw: bool = False) -> DataFrame:
    """The rows and columns of ``docs`` with ``out``, 0 to 1 (``raw``: the strength it is made from)."""

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(lexicon)
        for batch in batches:
            strengths = batch.map(lambda t: matcher.strength(t)[0]).astype(float)
            yield strengths if raw else strengths.map(lexicon.score).astype(float)

    (text,) = fresh(docs, "text")
    return docs.withColumn(text, text_of(text_col)).withColumn(out, scores(F.col(text))).drop(text)
