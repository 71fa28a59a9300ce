"""Near-duplicates by SimHash and the Jaccard similarity of shingles, of which none is missed but by a chance of 1e-8.

A text is the set of its shingles' hashes (64 bits); equal sets are one node. Candidates come in two ways, and nodes that
either brings together are in one cluster. First the fingerprints of ``simhash_dedup``: its covering anchors give all links at
three bits or fewer. Then signatures of minima, cut into bands, for the pairs that fingerprints can't reach: nodes share a
band, which costs one row per band and no row per pair. Whatever brought them together, in a cluster pairs are compared exactly, by the sizes of the sets' intersections; large clusters are compared in blocks of bounded size,
each of which gives a spanning forest of its links, and pairs that links join already are left out. A pair just at similarity 0.8 shares none of the 60 bands of six minima
with a chance of (1 - 0.8^6)^60 = 1.2e-8; what the bands bring together without need is only compared.

This is the near-duplicate step for a similarity of 0.8. The covering anchors alone can't reach all of it, as most such pairs
differ in more than three of 64 bits; no link depends on them alone, and none of theirs skips the exact comparison. Rows stay and go, and hot keys are joined, as in that module; no text is shuffled.

Defined results: a text of fewer words than a shingle is one shingle; null, empty and blank texts have no shingle and are
copies of each other; texts of any length count whole; an empty table gives an empty result; rows are chosen as in
``simhash_dedup.drop_near_duplicates``, and other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import compact, discard, done_with, map_texts, release, slices, text_rows, trim
from .row_lists import FILE, ROW, holds, numbered, save, stored
from .simhash_dedup import SEED, components, fingerprint, mark, signed, spanning, survivors, uneven_join
from .simhash_dedup import links as fingerprint_links

SHINGLE, LEAST = 5, 0.8
#: Bands of a signature and minima of a band.
BANDS, MINIMA = 60, 6
#: Nodes of a block of a cluster, shingles that are hashed at once, and columns of a block's matrix.
BLOCK, _ROWS, _COLUMNS = 512, 512, 4096
#: Bytes of the shingles of a block.
BLOCK_BYTES = 8 << 20
#: Seeds of a large cluster, and bytes that the shingles of one may have.
SEEDS, SEED_BYTES = 16, 1 << 17

_RNG = np.random.default_rng(SEED)
_MUL, _ADD = _RNG.integers(0, 1 << 32, (2, BANDS * MINIMA), np.uint32)
_MUL |= 1
_MIX, _SHIFT = _RNG.integers(0, 1 << 64, (BANDS, MINIMA), np.uint64) | 1, _RNG.integers(0, 1 << 64, BANDS, np.uint64)


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; words are lower-cased (ASCII) and cut at ASCII white space."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    runs = map(b" ".join, zip(*(words[k:] for k in range(size)))) if len(words) >= size else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64))


def node(found: np.ndarray) -> int:
    return signed(xxhash.xxh64_intdigest(found.astype("<u8", copy=False).tobytes(), SEED))


def bands(found: np.ndarray) -> np.ndarray:
    """A key for each band of the signature; none for a text without shingles."""
    if not len(found):
        return np.zeros(0, np.int64)
    low, least = (found ^ found >> np.uint64(32)).astype(np.uint32), np.full(BANDS * MINIMA, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(low), _ROWS):
        np.minimum(least, (low[lo : lo + _ROWS, None] * _MUL + _ADD).min(0), out=least)
    keys = (least.reshape(BANDS, MINIMA) * _MIX).sum(1, dtype=np.uint64) + _SHIFT
    return ((keys ^ keys >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def similar(a: list[np.ndarray], b: list[np.ndarray], least: float = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``a`` and ``b`` of all pairs of sets whose Jaccard similarity is ``least`` or more."""
    sizes = np.array([len(x) for x in a + b], np.int64)
    values, column, counts = np.unique(np.concatenate([*a, *b]), return_inverse=True, return_counts=True)
    shared = np.cumsum(counts > 1) - 1
    use = counts[column] > 1
    row, column = np.repeat(np.arange(len(sizes)), sizes)[use], shared[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(a), len(b)), np.float32)  # whole numbers, far below 2^24
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        start, stop = np.searchsorted(column, (lo, lo + _COLUMNS))
        holds = np.zeros((len(sizes), min(_COLUMNS, int(column[-1]) + 1 - lo)), np.float32)
        holds[row[start:stop], column[start:stop] - lo] = 1
        common += holds[: len(a)] @ holds[len(a) :].T
    both = common.astype(np.float64)
    either = sizes[: len(a), None] + sizes[None, len(a) :] - both
    return np.nonzero(both / np.maximum(either, 1) >= least)


def _compared(groups: DataFrame, by: list[str], least: float) -> DataFrame:
    """Edges of each group of ``by``: rows that are ``left`` are compared with rows that are ``right``."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, of = pdf["node"].to_numpy(np.int64), [np.frombuffer(x, "<u8") for x in pdf["shingles"]]
        first, second = (np.flatnonzero(pdf[side].to_numpy(bool)) for side in ("left", "right"))
        if not len(first) or not len(second):
            return pd.DataFrame({"a": nodes[:0], "b": nodes[:0], "large": np.zeros(0, bool)})
        x, y = similar([of[k] for k in first], [of[k] for k in second], least)
        a, b = spanning(nodes, first[x], second[y])
        return pd.DataFrame({"a": a, "b": b, "large": np.full(len(a), pdf["parts"].iloc[0] > 1)})

    return groups.groupBy(*by).applyInPandas(compare, "a long, b long, large boolean")


def _parts(block: int):
    """Blocks of a group: of ``block`` nodes and ``BLOCK_BYTES`` at most, but for chance."""
    return F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("long")


def _numbers(n: str):
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))


def _deal(n: str):
    return F.pmod(F.xxhash64("node"), F.col(n))


def remaining(members: DataFrame, near: DataFrame, block: int, total: int) -> DataFrame:
    """node, root, parts and others of the nodes of large clusters that aren't in the largest component of their cluster by the edges ``near``; ``others`` is the number of blocks that they make."""
    label = components(near.filter("large"))
    of = members.join(label.withColumnRenamed("root", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    counted = of.groupBy("root", "label").agg(F.count("*").alias("n"))
    main = counted.groupBy("root").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("n"))
    rest = uneven_join(of, main, "root", total).filter("label <> main").drop("label", "main")
    return uneven_join(rest, rest.groupBy("root").agg(F.count("*").alias("n"), _parts(block).alias("others")), "root", total).select("node", "root", "parts", "others")


def links(sets: DataFrame, clusters: DataFrame, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of nodes in one cluster at similarity ``least`` or more, as a table.

    ``sets`` has node and shingles (bytes), ``clusters`` node and root; both are read more than once. Nodes of a cluster are
    dealt by a hash into blocks of about ``block`` nodes and ``BLOCK_BYTES``. A block is compared with itself and with a few
    seeds of its cluster, which ties the blocks of a group of copies together. Of two nodes that this leaves in different
    components one isn't in the largest of their cluster: only those nodes are compared with all blocks, so work grows with
    the square of a cluster only as far as the cluster falls apart. Seeds save work; no link depends on them.
    """
    total = clusters.count()
    rooted = sets.withColumn("bytes", F.octet_length("shingles")).join(clusters, "node")
    sized = rooted.groupBy("root").agg(F.count("*").alias("n"), _parts(block).alias("parts"))
    dealt = uneven_join(rooted, sized, "root", total)
    members = compact(dealt.filter("parts > 1").select("node", "root", "parts", "bytes"), "large-clusters")
    best = F.min(F.struct(F.xxhash64(F.lit(1), "node").alias("rank"), "node", "parts")).alias("x")
    seeds = members.filter(F.col("bytes") <= SEED_BYTES).groupBy("root", F.pmod(F.xxhash64(F.lit(2), "node"), F.lit(SEEDS))).agg(best).select("root", "x.node", "x.parts")
    yes, no = F.lit(True), F.lit(False)
    own = dealt.select("root", _deal("parts").alias("part"), "node", "shingles", "parts", yes.alias("left"), yes.alias("right"))
    copied = sets.join(seeds, "node").select("root", _numbers("parts").alias("part"), "node", "shingles", "parts", no.alias("left"), yes.alias("right"))
    near = compact(_compared(own.unionByName(copied), ["root", "part"], least), "near-links")
    if members.isEmpty():
        done_with(members)
        return near
    rest = compact(remaining(members, near, block, total), "rest")
    roots = members.groupBy("root").agg(F.count("*").alias("n")).join(rest.groupBy("root").agg(F.first("others").alias("others")), "root")
    some = sets.join(rest, "node").select("root", _deal("others").alias("i"), _numbers("parts").alias("j"), "node", "shingles", "parts", yes.alias("left"), no.alias("right"))
    every = uneven_join(dealt, roots, "root", total).select("root", _numbers("others").alias("i"), _deal("parts").alias("j"), "node", "shingles", "parts", no.alias("left"), yes.alias("right"))
    far = _compared(some.unionByName(every), ["root", "i", "j"], least)
    out = compact(near.unionByName(far), "links")
    done_with(members, near, rest)
    return out


def alike(prints: DataFrame) -> DataFrame:
    """node and key, from rows of node and fp: nodes whose fingerprints are linked at three bits or fewer, by any chain, have a key in common."""
    pairs = compact(prints.select("node", "fp").distinct(), "fingerprints-of-nodes")
    sizes = compact(pairs.groupBy("fp").agg(F.count("*").alias("n")), "distinct-fingerprints")
    found = compact(sizes.join(components(fingerprint_links(sizes.select("fp"))).withColumnRenamed("node", "fp"), "fp"), "linked-fingerprints")
    out = compact(uneven_join(pairs, found, "fp", pairs.count(), "left").select("node", F.coalesce("root", "fp").alias("key")).distinct(), "fingerprint-keys")
    done_with(pairs, sizes, found)
    return out


def clusters_of(keyed: DataFrame, also: DataFrame) -> DataFrame:
    """node and root for nodes that share a band or a key of ``also`` (node, key) with others, from rows of node and keys."""
    each = keyed.groupBy("node").agg(F.first("keys").alias("keys")).select("node", F.explode("keys").alias("key")).unionByName(also)
    shared = compact(each.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).filter("low < high").select("key", "low", "n"), "shared-bands")
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return components(uneven_join(each, shared, "key", total).select("node", "low"), "node", "low")


def _chosen_sets(rows: DataFrame, path: str, size: int) -> DataFrame:
    """node and shingles (bytes) of the texts that the list at ``path`` names. One Python worker a task looks them up and makes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            file, row = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            texts = batch.column(1).filter(pa.array(holds(path, file, row))).to_pylist()
            for _, some in slices([None] * len(texts), texts):
                found = [shingles(t, size) for t in some]
                yield pa.RecordBatch.from_arrays([pa.array(list(map(node, found)), pa.int64()), pa.array([x.astype("<u8", copy=False).tobytes() for x in found], pa.binary())], names=["node", "shingles"])
        trim()

    return rows.mapInArrow(run, "node long, shingles binary")


def drop_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """One row of each group that pairs of similarity ``least`` or more connect, that of its smallest id, with all columns."""
    if not 0.8 <= least <= 1:
        raise ValueError("the bands are chosen for similarities of 0.8 and more")

    def keys(ids: list, texts: list[bytes]) -> dict:
        found = [shingles(t, size) for t in texts]
        keyed = [bands(x) for x in found]
        ends = np.cumsum([0, *map(len, keyed)]).astype(np.int32)
        prints = [fingerprint(t.lower().split()) for t in texts]
        return {"doc_id": ids, "mark": list(map(mark, texts)), "node": list(map(node, found)), "fp": prints, "keys": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keyed)))}

    table = numbered(stored(df))
    prints = compact(map_texts(text_rows(table, id_col, text_col, (FILE, ROW)), keys, "doc_id long, mark long, node long, fp long, keys array<long>"), "signatures")
    near = alike(prints)
    clusters = compact(clusters_of(prints.select("node", "keys"), near), "clusters")
    # Sets are made again from the texts, one of each node, and only for nodes in clusters.
    firsts = prints.select("node", FILE, ROW).join(clusters, "node", "left_semi").groupBy("node").agg(F.min(F.struct(FILE, ROW)).alias("at"))
    chosen = save(firsts.select("at.*"))
    sets = compact(_chosen_sets(text_rows(table, id_col, text_col, (FILE, ROW)), chosen, size), "shingle-sets")
    linked = links(sets, clusters, least)
    out = survivors(table, prints, components(linked))
    discard(chosen)
    done_with(prints, near, clusters, sets, linked)
    return out
