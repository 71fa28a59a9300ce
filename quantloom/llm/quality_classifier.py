"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled texts give a non-negative unbiased risk: with the class prior p, the risk on negatives is that
of the unlabelled texts less p times that of the positives counted as negatives; where this estimate falls below zero, its
gradient is turned round instead of followed. The prior is estimated from the same two samples: a first classifier tells
positives from unlabelled texts, and of all its thresholds the smallest ratio of the unlabelled share above it to the
positive share above it bounds the share of positives among the unlabelled.

A text enters only by its own characters and words: shares of words, word pairs and runs of three bytes, hashed into
``GRAMS`` places each, and ``FEATURES``, statistics of the whole text. Both are standardised; the many n-grams weigh a tenth, or
they would drown the statistics and fit the sample by heart.

The model is fitted on ``SAMPLE`` positives and twice as many unlabelled texts at most, chosen by a hash of the id: this is
the only bound, and it concerns fitting alone. Every text is scored, whole.

Defined results: a null or empty text has a score like any other; rows with a null id are scored but never learned from, and of
rows that share an id one is learned from; with no positives or no unlabelled texts every score is the prior given (0.5 by
default); repeated rows get equal scores; an empty table gives an empty result; columns besides id and text are ignored by
``score`` and kept by ``keep``, whatever their names.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import compact, done_with, kept, map_texts, text_rows
from .row_lists import FILE, ROW, numbered, save, stored, without

#: Positives that the model is fitted on at most; unlabelled texts: twice as many.
SAMPLE = 4_000

FEATURES = ["log_words", "word_length", "upper", "digits", "symbols", "bars", "marks", "stops", "commas", "echoes", "distinct", "repeats", "line_words", "non_ascii", "long_words"]
#: Places for n-grams of words and for those of bytes (a power of two: the first bits of a hash), and their weight.
GRAMS, GRAM_WEIGHT = 256, 0.1
#: Words whose hashes a worker remembers.
_WORDS = 100_000
_RUN = 5


def _share(x, n) -> np.ndarray:
    return np.asarray(x, float) / np.maximum(np.asarray(n, float), 1)


def features(texts: list[bytes]) -> np.ndarray:
    """One row of ``FEATURES`` for each text; finite whatever the text."""
    split = [t.split() for t in texts]
    n = np.fromiter(map(len, split), np.int64, len(texts))
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(n)])
    hashes = np.fromiter(map(hash, chain.from_iterable(split)), np.int64, int(starts[-1]))
    lengths = np.fromiter(map(len, chain.from_iterable(split)), np.int64, int(starts[-1]))
    doc = np.repeat(np.arange(len(texts)), n)
    count = lambda chars: np.fromiter((len(t) - len(t.translate(None, chars)) for t in texts), np.int64, len(texts))
    upper, lower = count(bytes(range(65, 91))), count(bytes(range(97, 123)))
    symbols, bars, marks = count(b"#*$%&<>@^~=_"), count(b"|"), count(b"!?")

    def within(mask: np.ndarray) -> np.ndarray:
        return np.bincount(doc[: len(mask)][mask], minlength=len(texts))

    echo = within((hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])) if len(hashes) > 1 else np.zeros(len(texts))
    repeats = np.zeros(len(texts))
    if len(hashes) >= _RUN:
        m = len(hashes) - _RUN + 1
        roll = np.zeros(m, np.uint64)
        for k in range(_RUN):
            roll = roll * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + m].view(np.uint64)
        key = (roll + doc[:m].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))[inside := doc[:m] == doc[_RUN - 1 :]]
        order = np.argsort(key)
        again = np.zeros(len(key), bool)
        again[order[1:][key[order][1:] == key[order][:-1]]] = True
        repeats = np.bincount(doc[:m][inside][again], minlength=len(texts))
    distinct = np.fromiter((len(set(w)) for w in split), np.int64, len(texts))
    lines = np.fromiter((t.count(b"\n") + 1 for t in texts), np.int64, len(texts))
    x = np.column_stack([
        np.log1p(n), np.minimum(_share(np.bincount(doc, lengths, len(texts)), n), 20), _share(upper, upper + lower), _share(count(b"0123456789"), size), _share(symbols, n), _share(bars, n), _share(marks, n),
        _share(count(b"."), n), _share(count(b","), n), _share(echo, n), _share(distinct, np.maximum(n, 1) ** 0.8), _share(repeats, n), np.log1p(_share(n, lines)), _share(count(bytes(range(128, 256))), size), _share(within(lengths > 16), n),
    ])
    return np.nan_to_num(x, posinf=0.0, neginf=0.0)


class _Hashes(dict):
    """A hash of 32 bits for each word, the same in every process."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh32_intdigest(word)
        return found


def _known() -> _Hashes:
    """A worker keeps them from task to task while it works for this operator."""
    return kept("word-hashes", _Hashes)


_SHIFT = np.uint32(33 - GRAMS.bit_length())


def _places(x: np.ndarray) -> np.ndarray:
    """The first bits of a multiplicative hash."""
    return ((x * np.uint32(0x9E3779B1)) >> _SHIFT).astype(np.int64)


def _shares(counts: np.ndarray) -> np.ndarray:
    """Square roots of shares of a row, in 255 steps."""
    return np.rint(255 * np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))).astype(np.uint8)


def grams(texts: list[bytes]) -> np.ndarray:
    """For each text ``2 * GRAMS`` numbers from 0 to 255: words and word pairs, then runs of three bytes."""
    known = _known()
    if len(known) > _WORDS:
        known.clear()
    split, size = [t.split() for t in texts], (len(texts), GRAMS)
    n = np.fromiter(map(len, split), np.int64, len(texts))
    hashes = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.uint32, int(n.sum()))
    doc = np.repeat(np.arange(len(texts)), n) * GRAMS
    inside = doc[1:] == doc[:-1]
    pairs = (hashes[1:] * np.uint32(0x85EBCA6B) ^ hashes[:-1])[inside]
    at = np.concatenate([doc + _places(hashes), doc[1:][inside] + _places(pairs)])
    words = np.bincount(at, minlength=len(texts) * GRAMS).reshape(size)
    runs = np.zeros(size, np.int64)
    for k, t in enumerate(texts):
        if len(t) > 2:
            b = np.frombuffer(t, np.uint8).astype(np.uint32)
            runs[k] = np.bincount(_places(b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]), minlength=GRAMS)
    return np.hstack([_shares(words), _shares(runs)])


def vectors(texts: list[bytes]) -> np.ndarray:
    """``FEATURES`` and n-grams, one row for each text."""
    return np.hstack([features(texts).astype(np.float32), grams(texts).astype(np.float32)])


WEIGHTS = np.concatenate([np.ones(len(FEATURES)), np.full(2 * GRAMS, GRAM_WEIGHT)])


class PuModel:
    """A linear model on standardised features times ``weights``, fitted to the non-negative risk with the logistic loss."""

    def __init__(self, weights: np.ndarray = WEIGHTS, steps: int = 300, rate: float = 0.05, decay: float = 1e-3):
        self.weights, self.steps, self.rate, self.decay = weights, steps, rate, decay
        self.mean, self.scale = np.zeros(len(weights)), np.ones(len(weights))
        self.w, self.b, self.prior = np.zeros(len(weights)), 0.0, 0.5

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) * self.weights

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Row by row, so that equal rows have equal logits in whatever company."""
        return (self._standard(x) * self.w).sum(1) + self.b

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -700, 700)))

    def _descend(self, gradient) -> None:
        """Adam over (w, b)."""
        theta, m, v = np.zeros(len(self.mean) + 1, np.float32), 0.0, 0.0
        for t in range(1, self.steps + 1):
            g = gradient(theta) + self.decay * np.append(theta[:-1], 0)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = (theta - self.rate * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        self.w, self.b = theta[:-1].astype(float), float(theta[-1])

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> PuModel:
        if not len(positive) or not len(unlabelled):
            self.prior = 0.5 if prior is None else prior
            self.b = float(np.log(self.prior / (1 - self.prior)))
            return self
        self.mean, self.scale = unlabelled.mean(0), np.maximum(unlabelled.std(0), 1e-6)
        z = lambda x: np.column_stack([self._standard(x), np.ones(len(x))]).astype(np.float32)
        p, u = z(positive), z(unlabelled)
        sigmoid = lambda a: 1 / (1 + np.exp(-np.clip(a, -30, 30)))
        softplus = lambda a: np.logaddexp(0, a)
        self.prior = self._estimate_prior(p, u, sigmoid) if prior is None else prior

        def gradient(theta: np.ndarray) -> np.ndarray:
            ap, au = p @ theta, u @ theta
            as_positive = self.prior * (p.T @ (sigmoid(ap) - 1)) / len(p)
            negative = (u.T @ sigmoid(au)) / len(u) - self.prior * (p.T @ sigmoid(ap)) / len(p)
            risk = softplus(au).mean() - self.prior * softplus(ap).mean()
            return as_positive + negative if risk >= 0 else -negative

        self._descend(gradient)
        return self

    def _estimate_prior(self, p: np.ndarray, u: np.ndarray, sigmoid) -> float:
        half = len(p) // 2, len(u) // 2

        def gradient(theta: np.ndarray) -> np.ndarray:
            a, b = p[: half[0] or None], u[: half[1] or None]
            return a.T @ (sigmoid(a @ theta) - 1) / len(a) + b.T @ sigmoid(b @ theta) / len(b)

        self._descend(gradient)
        theta = np.append(self.w, self.b)
        sp, su = np.sort(p[half[0] :] @ theta), np.sort(u[half[1] :] @ theta)
        at = np.quantile(sp, np.linspace(0, 0.5, 101))  # thresholds that keep half of the positives at least
        above_p = 1 - np.searchsorted(sp, at, "left") / len(sp)
        above_u = 1 - np.searchsorted(su, at, "left") / len(su)
        # each share is uncertain by its standard error; the bound is read a little above the smallest ratio for that
        slack = np.sqrt(np.maximum(above_u * (1 - above_u), 1 / len(su)) / len(su))
        return float(np.clip(np.min((above_u + slack) / np.maximum(above_p, 1e-9)), 0.05, 0.98))


def held_out(key: Column) -> Column:
    """Whether crc32 of the id as text leaves no remainder by five; such labels are never learned from."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def _drawn(ids: DataFrame, n: int, salt: int) -> list[int]:
    """``n`` of the ids at most, by a hash. The hash keeps somewhat more than that in all, so that few come from each task; its order settles which."""
    place = F.xxhash64("doc_id", F.lit(salt))
    share = min(1.0, 1.5 * n / max(ids.count(), 1))
    chosen = ids.filter(F.shiftrightunsigned(place, 2) < int(share * 2**62)) if share < 1 else ids
    return [r[0] for r in chosen.distinct().orderBy(place, "doc_id").limit(n).collect()]


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, prior: float | None = None) -> PuModel:
    """Learns from rows of ``df``: positives are those with label 1 that aren't held out, unlabelled are any that aren't held out. Only ids are looked through, and the texts of the sample are read."""
    spark, key = df.sparkSession, F.col("doc_id")
    usable = lambda t: t.select(F.col(f"`{id_col}`").cast("long").alias("doc_id")).filter(key.isNotNull() & ~held_out(key))
    positive, unlabelled = set(_drawn(usable(labels.filter(F.col(label_col) == 1)), sample, 1)), set(_drawn(usable(df), 2 * sample, 2))
    chosen = spark.createDataFrame([(i,) for i in sorted(positive | unlabelled)], "doc_id long")

    def run(ids, texts, _):
        return {"doc_id": ids, "vector": [v.tobytes() for v in vectors(texts)]}

    rows = text_rows(df, id_col, text_col).join(F.broadcast(chosen), "doc_id", "left_semi")
    found = compact(map_texts(rows, run, "doc_id long, vector binary", _known), "quality-vectors")
    read = sorted(found.groupBy("doc_id").agg(F.min("vector").alias("vector")).collect())
    done_with(found)
    of = lambda some: np.array([np.frombuffer(v, np.float32) for i, v in read if i in some], float).reshape(-1, len(WEIGHTS))
    return PuModel().fit(of(positive), of(unlabelled), prior)


def _scored(model: PuModel, rows: DataFrame) -> DataFrame:
    return map_texts(rows, lambda ids, texts, _: {"doc_id": ids, "score": model.scores(vectors(texts))}, "doc_id long, score double", _known)


def score(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""
    scored = compact(_scored(fit(df, labels, id_col, text_col), text_rows(df, id_col, text_col)), "quality-scores")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``df`` that the model takes for good, with all their columns. Texts are scored once; then they move from the scan to the output, past a list of the rows that go."""
    table = numbered(stored(df))
    scored = _scored(fit(table, labels, id_col, text_col), text_rows(table, id_col, text_col, (FILE, ROW)))
    return without(table, save(scored.filter(F.col("score") < threshold).select(FILE, ROW)))
