"""SimHash near-duplicates by anchor-point covering.

Two fingerprints of 64 bits that differ in three bits or fewer differ in at most one bit in one of their halves. For each
half, the anchors are a covering code of its 32 bits: the Hamming code of length 31, times both values of the last bit.
Every half lies within one bit (the covering radius) of exactly one anchor, its home. If two halves differ in at most one
bit, the home of the first lies within two bits (radius plus threshold) of the second. So each fingerprint is copied to all
anchors within two bits, of which there are 17 at most, and is compared there with those whose home the anchor is.

Texts with the same fingerprint count once. An anchor that is the home of many fingerprints (a large group of near copies)
is compared in blocks of bounded size, each of which gives a spanning forest of its links and not the links themselves.
Components come from alternating star contractions over the edges, written to the shared folder after each round. Wherever
rows meet a key that many of them may share (a hub of a component, a popular fingerprint), the few keys that hold more than
1/512 of the rows are broadcast and the others shuffled.

No text is shuffled: fingerprints are made where texts are read, and ``drop_near_duplicates`` leaves rows out by lists of rows
per file.

Defined results: a null or empty text has the fingerprint 0 and is linked like any other; texts of any length count whole;
repeated rows share a component; a null id takes part, but only names a component of null ids; an empty table gives an empty
result; columns besides id and text are ignored by ``near_duplicates`` and kept by ``drop_near_duplicates``, whatever their
names.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import compact, done_with, map_texts, text_rows
from .row_lists import FILE, ROW, numbered, save, stored, without

SHINGLE, SEED, BITS = 3, 42, 3
#: Homes of an anchor beyond which it is compared in blocks, and fingerprints of a block.
MANY, BLOCK = 24, 4096
_ROWS = 4096
#: A key with more than this share of the rows is broadcast in a join; there are fewer such keys than twice that number.
SHARE = 512


def fingerprint(words: list[bytes], size: int = SHINGLE) -> int:
    """Bits set in over half the hashes of the shingles; signed, as Spark stores it."""
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(size)))) if len(words) >= size else [b" ".join(words)]
    n = max(len(words) - size + 1, 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n).astype("<u8", copy=False).view(np.uint8).reshape(n, 8)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, _ROWS):
        ones += np.unpackbits(hashes[lo : lo + _ROWS], axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (long); words are lower-cased (ASCII) and cut at ASCII white space."""
    return map_texts(text_rows(df, id_col, text_col), lambda ids, texts: {"doc_id": ids, "fp": [fingerprint(t.lower().split()) for t in texts]}, "doc_id long, fp long")


def _bit(k: int) -> int:
    return 1 << k


#: For the k-th bit of the syndrome: the bits of a half whose place, counted from 1, has that bit.
_CHECKS = [sum(_bit(i - 1) for i in range(1, 32) if i >> k & 1) for k in range(5)]


def _syndrome(half: Column) -> Column:
    parity = [F.bit_count(half.bitwiseAND(F.lit(m).cast("long"))).cast("long") % 2 * _bit(k) for k, m in enumerate(_CHECKS)]
    return sum(parity[1:], parity[0])


def _power(exponent: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), exponent.cast("int"))


def _halves(fps: DataFrame) -> DataFrame:
    """fp, side (0, 1), half (its 32 bits as a number), s (the syndrome), home (the nearest anchor)."""
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), F.shiftrightunsigned("fp", 32)
    both = fps.select("fp", F.posexplode(F.array(low, high)).alias("side", "half")).withColumn("s", _syndrome(F.col("half")))
    return both.withColumn("home", F.when(F.col("s") == 0, F.col("half")).otherwise(F.col("half").bitwiseXOR(_power(F.col("s") - 1))))


def _key(anchor: Column) -> Column:
    return anchor.bitwiseOR(F.col("side").cast("long") * _bit(32)).alias("anchor")


def homes(fps: DataFrame) -> DataFrame:
    return _halves(fps).select(_key(F.col("home")), "fp")


def covers(fps: DataFrame) -> DataFrame:
    """Every anchor within two bits of each half."""
    s, half = F.col("s"), F.col("half")
    partner = lambda i: i.bitwiseXOR(s)
    pairs = F.transform(
        F.filter(F.sequence(F.lit(1).cast("long"), F.lit(31).cast("long")), lambda i: (s > 0) & (i < partner(i))),
        lambda i: half.bitwiseXOR(_power(i - 1)).bitwiseXOR(_power(partner(i) - 1)),
    )
    near = F.concat(F.array(F.col("home"), F.col("home").bitwiseXOR(F.lit(_bit(31)).cast("long"))), pairs)
    return _halves(fps).select("side", "fp", F.explode(near).alias("a")).select(_key(F.col("a")), "fp")


def _forest(homes_in: np.ndarray, others: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the links between two blocks connect: each fingerprint with the first of its component."""
    nodes, where = np.unique(np.concatenate([homes_in, others]), return_inverse=True)
    a, b = where[: len(homes_in)], where[len(homes_in) :]
    left, right = [], []
    for lo in range(0, len(a), 128):
        x, y = np.nonzero(np.bitwise_count((homes_in[lo : lo + 128, None] ^ others[None, :]).view(np.uint64)) <= bits)
        left.append(a[lo + x])
        right.append(b[y])
    return spanning(nodes, np.concatenate(left or [a[:0]]), np.concatenate(right or [a[:0]]))


def spanning(nodes: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the first of its component, for links between positions of ``nodes``."""
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def links(fps: DataFrame, bits: int = BITS, many: int = MANY, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) over distinct fingerprints whose components are those of all links at ``bits`` or fewer differing bits.

    Anchors with few homes give their links themselves. For the others, fingerprints are dealt into blocks of about ``block``
    by a hash; each pair of blocks is one group.
    """
    if bits != 3:
        raise ValueError("the anchors are chosen for three bits")
    # A fingerprint is a few bytes but becomes 17 rows a side: few file splits would mean few tasks. Spark's estimate of a side
    # leaves those rows out, so without a hint it would broadcast all of them as a small table, through the driver.
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    near, around = homes(fps), covers(fps)
    counted = near.groupBy("anchor").agg(F.count("*").alias("n_homes")).filter(F.col("n_homes") > many)
    heavy = compact(around.hint("merge").join(counted, "anchor").groupBy("anchor").agg(F.count("*").alias("n_around"), F.first("n_homes").alias("n_homes")), "heavy-anchors")
    light = near.join(heavy, "anchor", "left_anti").alias("h").join(around.alias("c").hint("merge"), "anchor")
    light = light.filter((F.col("h.fp") < F.col("c.fp")) & (F.bit_count(F.col("h.fp").bitwiseXOR(F.col("c.fp"))) <= bits)).select(F.col("h.fp").alias("a"), F.col("c.fp").alias("b"))

    sized = heavy.select("anchor", F.ceil(F.col("n_homes") / block).alias("hb"), F.ceil(F.col("n_around") / block).alias("cb"))
    deal = lambda n: F.pmod(F.xxhash64("fp", "anchor"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))
    hs = near.join(sized, "anchor").select("anchor", "fp", deal(F.col("hb")).alias("i"), every(F.col("cb")).alias("j"), F.lit(True).alias("home"))
    cs = around.join(sized, "anchor").select("anchor", "fp", deal(F.col("cb")).alias("j"), every(F.col("hb")).alias("i"), F.lit(False).alias("home"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, home = pdf["fp"].to_numpy(np.int64), pdf["home"].to_numpy(bool)
        a, b = _forest(fp[home], fp[~home], bits)
        return pd.DataFrame({"a": a, "b": b})

    dense = hs.unionByName(cs).groupBy("anchor", "i", "j").applyInPandas(compare, "a long, b long")
    return light.unionByName(dense)


def uneven_join(rows: DataFrame, small: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``small``, which has one row for each key and as ``n`` how many rows have it at most.

    Of ``total`` rows, the keys with more than one in ``SHARE`` are fewer than twice ``SHARE``, whatever the input: they may be
    broadcast, so no task gets all rows of a hot key.
    """
    limit = max(total // SHARE, 1)
    value = [c for c in small.columns if c not in (key, "n")]
    heavy = small.filter(F.col("n") > limit).select(key, F.struct(*value).alias("__found"))
    marked = rows.join(F.broadcast(heavy), key, "left")
    hot = marked.filter(F.col("__found").isNotNull()).select(*rows.columns, "__found.*")
    rest = marked.filter(F.col("__found").isNull()).drop("__found")
    return hot.unionByName(rest.join(small.filter(F.col("n") <= limit).select(key, *value), key, how).select(*rows.columns, *value))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root (the smallest node it is connected with) for every node of ``edges``, by alternating star contractions."""
    x, y = F.col(a), F.col(b)
    now = compact(edges.filter(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges")
    while True:
        total = 2 * now.count()
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = compact(uneven_join(both.filter("v > u"), lowest, "u", total).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-stars")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        pointing = uneven_join(large, low, "u", total).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, compact(pointing.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        done_with(before, large)
        # done when every node points once, and to one that doesn't point itself
        if now.join(now.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty() and now.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links reach) for every row."""
    prints = compact(fingerprints(df, id_col, text_col), "fingerprints")
    distinct = compact(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    found = components(links(distinct.select("fp")))
    # Only fingerprints of several rows or with links need a look-up; for all others the row is its own component.
    rooted = compact(distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").filter((F.col("n") > 1) | F.col("root").isNotNull()).withColumn("root", F.coalesce("root", "fp")), "rooted")
    low = rooted.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("n"))
    size = rooted.select("fp", F.col("n").alias("size"), "root")
    named = compact(uneven_join(size, low, "root", rooted.count()).select("fp", "component", F.col("size").alias("n")), "components")
    done_with(distinct, rooted)
    return uneven_join(prints, named, "fp", prints.count(), "left").select("doc_id", "fp", F.coalesce("component", "doc_id").alias("component_id"))


def signed(x: int) -> int:
    """An unsigned hash of 64 bits as Spark stores it."""
    return x - (1 << 64) if x >> 63 else x


def mark(text: bytes) -> int:
    """What Spark's ``xxhash64`` gives for the text."""
    return signed(xxhash.xxh64_intdigest(text, 42))


def survivors(table: DataFrame, prints: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of a numbered table that stay: of each component of ``found`` (node, root) and of each node outside it, the row of the smallest id (null comes last), then of the smallest mark, then the first.

    ``prints`` has node, doc_id, mark and the place of every row.
    """
    least = prints.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark", FILE, ROW)).alias("least"))
    rooted = least.join(found, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("least").alias("least"))
    gone = prints.select(FILE, ROW).join(rooted.select(f"least.{FILE}", f"least.{ROW}"), [FILE, ROW], "left_anti")
    return without(table, save(gone))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, that of its smallest id, with all columns; a null id is the largest.

    A row is known by its place: of rows that repeat id and text one stays, and different texts under one id, or without any,
    are rows of their own.
    """
    table = numbered(stored(df))
    prints = compact(map_texts(text_rows(table, id_col, text_col, (FILE, ROW)), lambda ids, texts: {"doc_id": ids, "mark": list(map(mark, texts)), "node": [fingerprint(t.lower().split()) for t in texts]}, "doc_id long, mark long, node long"), "fingerprints")
    distinct = compact(prints.select(F.col("node").alias("fp")).distinct(), "distinct-fingerprints")
    out = survivors(table, prints, components(links(distinct)))
    done_with(prints, distinct)
    return out
