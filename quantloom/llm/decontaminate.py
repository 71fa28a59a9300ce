"""Benchmark decontamination by pigeonhole edit matching.

An item of n words may appear with up to ``int(rate * n)`` word edits. It is split into one piece more than that, so at least
one piece must appear unchanged. Pieces are found by a rolling hash over whole texts and compared word by word; the text
around each hit is verified with Myers' bit-parallel edit distance, whose symbols are words.

Items come to the driver in blocks of bounded size (``block_bytes`` of text); every block is matched against all documents.

Defined results: null or empty texts and items without words match nothing; texts and items of any length are searched whole;
repeated rows are reported each; several items with the same text are all reported; a null id stays null; an empty table on
either side gives no finds; columns besides id and text are ignored by ``find_leaks`` and kept by ``drop_leaks``, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, slices, text_rows
from .row_lists import FILE, ROW, numbered, save, stored, without

RATE = 0.2
BLOCK_BYTES = 8 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)

#: bytes.translate table: ASCII bytes that are no digit or letter become spaces.
_WORD_TABLE = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words in lower case, of digits, letters and non-ASCII characters."""
    lowered = text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()
    return lowered.translate(_WORD_TABLE).split()


def edit_ends(masks: dict[int, int], n: int, text: list[int]) -> list[int]:
    """Myers: for each position of ``text``, the least edit distance between the pattern and a part of the text that ends there."""
    full, top = (1 << n) - 1, 1 << (n - 1)
    pv, mv, score, out = full, 0, n, []
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        out.append(score)
    return out


class LeakFinder:
    """Finds the items of one block. Built once per worker."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        if not 0 <= rate < 1:
            raise ValueError("rate is at least 0 and below 1")
        self.ids: dict[bytes, int] = {}
        self.items: list[tuple[int, list[int], int]] = []
        pieces: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for item, text in items:
            seq = [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of((text or "").encode())]
            if not seq:
                continue
            k, n = int(rate * len(seq)), len(seq)
            cuts = [n * i // (k + 1) for i in range(k + 2)]
            for s, e in zip(cuts, cuts[1:]):
                pieces.setdefault(tuple(seq[s:e]), []).append((len(self.items), s))
            self.items.append((item, seq, k))
        self.masks: dict[int, tuple[dict[int, int], dict[int, int]]] = {}
        self.by_length: dict[int, tuple[np.ndarray, list[list[tuple[int, ...]]]]] = {}
        self.pieces = pieces
        for m in sorted({len(p) for p in pieces}):
            by: dict[int, list[tuple[int, ...]]] = {}
            for p in pieces:
                if len(p) == m:
                    by.setdefault(int(self._hash(np.array(p, np.uint64), np.zeros(1, np.int64), m)[0]), []).append(p)
            keys = np.array(sorted(by), np.uint64)
            self.by_length[m] = keys, [by[int(x)] for x in keys]

    @staticmethod
    def _hash(ids: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        for j in range(m):
            h = (h ^ ids[at + j]) * _BASE
            h ^= h >> np.uint64(31)
        return h

    def find(self, texts: list[bytes]) -> list[list[tuple[int, int, int, int, int]]]:
        """Per text: (item id, distance, words of the item, first word, last word) of the best place of each item."""
        out: list[list[tuple[int, int, int, int, int]]] = [[] for _ in texts]
        if not self.items:
            return out
        words: list[bytes] = []
        starts = [0]
        for t in texts:
            words += words_of(t)
            words.append(b" ")  # no item has it: nothing matches across texts
            starts.append(len(words))
        ids = np.fromiter(map(self.ids.get, words, repeat(0)), np.uint64, len(words))
        gaps = np.flatnonzero(ids == 0)
        run = gaps[np.searchsorted(gaps, np.arange(len(ids)))] - np.arange(len(ids))  # known words from here on
        windows: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for m, (keys, found) in self.by_length.items():
            at = np.flatnonzero(run >= m)
            h = self._hash(ids, at, m)
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[k] == h
            for i, key in zip(at[hit].tolist(), k[hit].tolist()):
                here = tuple(ids[i : i + m].tolist())
                if here not in found[key]:
                    continue
                doc = int(np.searchsorted(starts, i, "right")) - 1
                for item, offset in self.pieces[here]:
                    _, seq, budget = self.items[item]
                    first = max(i - offset - budget, starts[doc])
                    last = min(i - offset + len(seq) + budget, starts[doc + 1] - 1)
                    windows.setdefault((doc, item), []).append((first, last))
        for (doc, item), spans in windows.items():
            if best := self._verify(item, ids, spans):
                d, s, e = best
                out[doc].append((self.items[item][0], d, len(self.items[item][1]), s - starts[doc], e - starts[doc]))
        return out

    def _verify(self, item: int, ids: np.ndarray, spans: list[tuple[int, int]]) -> tuple[int, int, int] | None:
        _, seq, budget = self.items[item]
        if item not in self.masks:
            ahead: dict[int, int] = {}
            back: dict[int, int] = {}
            for i, c in enumerate(seq):
                ahead[c] = ahead.get(c, 0) | 1 << i
                back[c] = back.get(c, 0) | 1 << (len(seq) - 1 - i)
            self.masks[item] = ahead, back
        ahead, back = self.masks[item]
        merged: list[list[int]] = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        best = None
        for s, e in merged:
            part = ids[s:e].tolist()
            scores = edit_ends(ahead, len(seq), part)
            d = min(scores, default=len(seq))
            if d <= budget and (best is None or d < best[0]):
                end = scores.index(d)
                behind = edit_ends(back, len(seq), part[max(0, end + 1 - len(seq) - d) : end + 1][::-1])
                best = d, s + end - behind.index(min(behind)), s + end
        return best


def blocks_of(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of ``block_bytes`` of text at most (an item longer than that stands alone); the driver holds one at a time."""
    block: list[tuple[int, str]] = []
    held = 0
    for row in benchmark.select(F.col(item_col).cast("long"), F.col(text_col)).filter(F.col(text_col).isNotNull()).toLocalIterator():
        if block and held + len(row[1]) > block_bytes:
            yield block
            block, held = [], 0
        block.append((row[0], row[1]))
        held += len(row[1])
    if block:
        yield block


def _finder(shared, rate: float) -> LeakFinder:
    """The index of a broadcast block, built once per worker; it holds the block, so the key names no other object."""
    block = shared.value

    def make() -> LeakFinder:
        finder = LeakFinder(block, rate)
        finder.block = block
        return finder

    return kept(("leaks", id(block), rate), make)


SCHEMA = "doc_id long, item_id long, distance long, item_words long, first_word long, last_word long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document and item that it holds within the error budget, at its best place (in words)."""
    spark = docs.sparkSession
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = _finder(shared, rate)
            for batch in batches:
                for ids, texts in slices(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    rows = [(i, *x) for i, found in zip(ids, finder.find(texts)) for x in found]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

        return text_rows(docs, id_col, text_col).mapInArrow(run, SCHEMA)

    parts = [search(spark.sparkContext.broadcast(b)) for b in blocks_of(benchmark, block_bytes=block_bytes)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], SCHEMA)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; no text is shuffled."""
    table = numbered(stored(docs))
    rows = table.select(F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("text"), FILE, ROW)

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = _finder(shared, rate)
            for batch in batches:
                for at, texts in slices(list(range(batch.num_rows)), batch.column(0).to_pylist()):
                    hit = [k for k, found in zip(at, finder.find(texts)) if found]
                    if hit:
                        yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(hit)) for c in (1, 2)], names=[FILE, ROW])

        return rows.mapInArrow(run, f"{FILE} long, {ROW} long")

    parts = [search(docs.sparkSession.sparkContext.broadcast(b)) for b in blocks_of(benchmark, block_bytes=block_bytes)]
    return without(table, save(reduce(DataFrame.unionByName, parts))) if parts else docs
