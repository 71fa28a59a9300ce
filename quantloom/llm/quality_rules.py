"""Quality rules by weak supervision.

Every rule looks at statistics of a text and votes good (1), junk (-1) or abstains (0); every rule can vote both ways. Junk
comes in kinds, and a kind trips some rules and passes others, so the model has one class of good texts and one for each kind
of ``KINDS``. Expectation-maximisation over the counts of vote patterns (all documents; there are at most 3 ** rules
patterns, whatever the input) estimates how large each class is and how often each rule, where it votes, blames its texts. An
abstention is no evidence. The posterior probability of the good class replaces all-must-pass filtering: a blame that good
texts get now and then is outweighed by the rules that vouch, one that they never get isn't. Nothing is known of a rule
beforehand but which kind it is meant for, and that only where the iteration begins.

Defined results: a null or empty text has no words and fails the base rule; texts of any length count whole; repeated rows are
judged alike, each for itself; null ids stay; an empty table gives an empty result; columns besides id and text are ignored by
``judge`` and kept by ``keep``, whatever their names.
"""

from __future__ import annotations

from itertools import chain, repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import compact, done_with, map_texts, text_rows
from .row_lists import FILE, ROW, numbered, save, stored, without

STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_lower long, n_echo long, n_bare long, n_marks long, n_stops long, n_distinct long"

_SPACE = b" \t\n\r\x0b\x0c"
_NOT_STARTS = bytes(range(0x80, 0xC0)) + _SPACE
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
WINDOW = 8


def _covered(starts: np.ndarray, n: int) -> int:
    """Words that windows at ``starts`` cover."""
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, starts, 1)
    np.subtract.at(mark, starts + WINDOW, 1)
    return int((np.cumsum(mark[:n]) > 0).sum())


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of eight words found twice or more in ``words``; exact, by comparing the windows themselves."""
    first: dict[tuple, int] = {}
    hit: set[int] = set()
    for i, w in enumerate(zip(*(words[k:] for k in range(WINDOW)))):
        j = first.setdefault(w, i)
        if j != i:
            hit.update((i, j))
    return _covered(np.fromiter(hit, np.int64, len(hit)), len(words)) if hit else 0


def text_stats(ids: list, texts: list[bytes]) -> dict:
    """The columns of ``STATS`` for a batch. Windows are first compared by a hash over the whole batch; texts with equal hashes are compared word by word."""
    split = [t.split() for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    starts = np.concatenate([[0], np.cumsum(counts)])
    hashes = np.fromiter(map(hash, chain.from_iterable(split)), np.int64, int(starts[-1])).view(np.uint64)
    repeats = np.zeros(len(texts), np.int64)
    if len(hashes) >= WINDOW:
        m = len(hashes) - WINDOW + 1
        roll = np.zeros(m, np.uint64)
        for k in range(WINDOW):
            roll = roll * np.uint64(0x9E3779B97F4A7C15) + (hashes[k : k + m] ^ (hashes[k : k + m] >> np.uint64(29)))
        doc = np.repeat(np.arange(len(texts)), counts)
        inside = doc[:m] == doc[WINDOW - 1 :]
        key = (roll + doc[:m].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))[inside]
        order = np.argsort(key, kind="quicksort")
        same = key[order][1:] == key[order][:-1]
        if same.any():
            owner = doc[:m][inside]
            for d in np.unique(np.concatenate([owner[order][1:][same], owner[order][:-1][same]])):
                repeats[d] = repeat_words(split[d])
    echo = np.zeros(len(texts), np.int64)
    if len(hashes) > 1:
        inner = np.ones(len(hashes) - 1, bool)
        inner[starts[1:-1][(starts[1:-1] > 0) & (starts[1:-1] < len(hashes))] - 1] = False
        at = np.flatnonzero((hashes[1:] == hashes[:-1]) & inner)
        np.add.at(echo, np.searchsorted(starts, at, "right") - 1, 1)
    lines = [[x for x in t.split(b"\n") if not x.isspace() and x] for t in texts]
    deleted = lambda t, d: len(t) - len(t.translate(None, d))
    return {
        "doc_id": ids, "n_words": counts, "word_chars": [len(t.translate(None, _NOT_STARTS)) for t in texts], "n_symbols": list(map(deleted, texts, repeat(_SYMBOLS))),
        "n_dup_lines": [len(x) - len(set(x)) for x in lines], "n_repeat_words": repeats, "n_lines": list(map(len, lines)), "n_upper": list(map(deleted, texts, repeat(_UPPER))),
        "n_lower": list(map(deleted, texts, repeat(_LOWER))), "n_echo": echo, "n_bare": [n - len(t.translate(None, _PUNCTUATION).split()) for n, t in zip(counts.tolist(), texts)],
        "n_marks": [t.count(b"!") for t in texts], "n_stops": [t.count(b".") for t in texts], "n_distinct": [len(set(w)) for w in split],
    }


def rules(get=F.col) -> dict[str, Column]:
    """Votes on the columns of ``STATS``; each is 1, 0 or -1 and never null. Between the limit for blame and the one for praise, and on texts too short for it, a rule abstains."""
    words, letters = F.greatest(get("n_words"), F.lit(1)), F.greatest(get("n_upper") + get("n_lower"), F.lit(1))
    long, length, lines = get("n_words") >= 20, get("word_chars") / words, F.greatest(get("n_lines"), F.lit(1))
    per_word = lambda c: get(c) / words
    vote = lambda bad, good: F.when(bad, -1).when(good, 1).otherwise(0)
    upper, variety = get("n_upper") / letters, get("n_distinct") / F.pow(words, F.lit(0.85))
    return {
        "symbols": vote(per_word("n_symbols") > 0.1, per_word("n_symbols") < 0.01),
        "bare": vote(per_word("n_bare") > 0.05, per_word("n_bare") < 0.005),
        "word_length": vote((length < 3) | (length > 6.5), length.between(4, 6)),
        "capitals": vote((letters >= 20) & (upper > 0.3), upper < 0.12),
        "marks": vote(per_word("n_marks") > 0.2, per_word("n_marks") < 0.02),
        "echoes": vote(long & (per_word("n_echo") > 0.15), per_word("n_echo") < 0.04),
        "repeats": vote(per_word("n_repeat_words") > 0.2, get("n_repeat_words") == 0),
        "lines": vote((get("n_lines") >= 4) & (get("n_dup_lines") / lines > 0.2), (get("n_lines") >= 2) & (get("n_dup_lines") == 0)),
        "variety": vote(long & (variety < 0.55), long & (variety > 0.8)),
        "sentences": vote(long & (per_word("n_stops") < 0.02), per_word("n_stops").between(0.04, 0.3)),
    }


#: Kinds of junk and the rules that are meant for them.
KINDS = {"symbols": ("symbols", "bare", "word_length"), "shouting": ("capitals", "marks"), "repetition": ("echoes", "repeats", "lines", "variety")}


class LabelModel:
    """Good texts and several kinds of junk; given the class, each rule votes independently, and ``blame`` is the share of blames among its votes."""

    def __init__(self, names: list[str], kinds: dict[str, tuple[str, ...]] = KINDS, prior: float = 0.8, steps: int = 500, smooth: float = 1.0):
        """``smooth``: pseudo-counts of each vote, which keep logarithms finite."""
        self.steps, self.smooth = steps, smooth
        self.sizes = np.array([prior] + [(1 - prior) / len(kinds)] * len(kinds))
        self.blame = np.full((len(names), len(kinds) + 1), 0.2)
        self.blame[:, 0] = 0.03
        for c, meant in enumerate(kinds.values(), 1):
            self.blame[[names.index(n) for n in meant], c] = 0.9

    @property
    def prior(self) -> float:
        """The share of good texts."""
        return float(self.sizes[0])

    def classes(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of each class for texts with these votes: good first, then the kinds."""
        score = np.log(self.sizes) + (patterns == -1) @ np.log(self.blame) + (patterns == 1) @ np.log1p(-self.blame)
        p = np.exp(score - score.max(1, keepdims=True)) if len(patterns) else score
        return p / p.sum(1, keepdims=True)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability that a text with these votes is good."""
        return self.classes(patterns)[:, 0]

    def fit(self, patterns: np.ndarray, counts: np.ndarray) -> LabelModel:
        if not len(patterns) or not counts.sum():
            return self
        for _ in range(self.steps):
            before, weight = self.blame, self.classes(patterns) * counts[:, None]
            self.sizes = (weight.sum(0) + 1) / (counts.sum() + len(self.sizes))
            blames, praises = (patterns == -1).T @ weight + self.smooth, (patterns == 1).T @ weight + self.smooth
            self.blame = blames / (blames + praises)
            if np.abs(self.blame - before).max() < 1e-9:
                break
        return self

    def accuracies(self) -> np.ndarray:
        """Estimated probability that a rule is right where it votes, if it votes as often on every class."""
        return self.sizes[0] * (1 - self.blame[:, 0]) + self.blame[:, 1:] @ self.sizes[1:]


def _pattern(get=F.col) -> Column:
    return F.concat(*[F.substring(F.lit("-0+"), v.cast("int") + 2, F.lit(1)) for v in rules(get).values()])


def fitted(stats: DataFrame) -> tuple[LabelModel, dict[str, float]]:
    """The model of ``stats``, and each vote pattern with its posterior. All rows are counted; at most 3 ** rules patterns come to the driver."""
    seen = sorted(stats.groupBy(_pattern().alias("votes")).agg(F.count("*").alias("n")).collect())
    names = list(rules())
    codes = np.array([["-0+".index(c) - 1 for c in x["votes"]] for x in seen], np.int64).reshape(len(seen), len(names))
    model = LabelModel(names).fit(codes, np.array([x["n"] for x in seen], float))
    return model, dict(zip((x["votes"] for x in seen), model.posterior(codes).tolist()))


def _judged(stats: DataFrame, threshold: float) -> DataFrame:
    found = F.broadcast(stats.sparkSession.createDataFrame(sorted(fitted(stats)[1].items()) or [("", 0.0)], "votes string, quality double"))
    return stats.withColumn("votes", _pattern()).join(found, "votes", "left").withColumn("base_failed", _base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def _base_failed(get=F.col) -> Column:
    return (get("n_words") < 20) | (100 * get("n_repeat_words") > 30 * get("n_words"))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Statistics, votes, posterior and verdict of every row. The statistics are written once, so texts are read once."""
    stats = compact(map_texts(text_rows(df, id_col, text_col), text_stats, STATS), "rule-stats")
    return _judged(stats, threshold).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "votes", "quality")


def keep(df: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``df`` that the rules keep, with all their columns. Statistics are made once; texts then move from the scan to the output, past a list of the rows that go."""
    table = numbered(stored(df))
    rows = table.select(F.lit(None).cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), FILE, ROW)
    stats = compact(map_texts(text_rows(rows, also=(FILE, ROW)), text_stats, STATS), "rule-stats")
    out = without(table, save(_judged(stats, threshold).filter(~F.col("kept")).select(FILE, ROW)))
    done_with(stats)
    return out
