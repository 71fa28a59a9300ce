import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quantloom.llm import simhash_dedup as sd

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fp(text):
    words = SPACE.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b) and root(a) != root(b):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return {n: root(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_of_hard_rows(docs, empty):
    got = sd.fingerprints(docs).collect()
    assert [(r.doc_id, r.fp) for r in got] == [(g.doc_id, signed(brute_fp(g.text))) for g in docs.select("doc_id", "text").collect()]
    assert sd.fingerprints(empty).count() == 0


def test_whole_table_equals_all_pairs(sample):
    texts = {r.doc_id: r.text for r in sample.select("doc_id", "text").collect()}
    fps = {i: brute_fp(t) for i, t in texts.items()}
    want = brute_components(sorted(texts), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    got = {r.doc_id: (r.fp, r.component_id) for r in sd.near_duplicates(sample).collect()}
    assert got == {i: (signed(fps[i]), want[i]) for i in texts}
    assert len(set(want.values())) < len(texts)


def test_anchors_cover_every_half(spark):
    """The home lies within one bit; all anchors within two bits are there, 17 at most, and any two halves one bit apart meet."""
    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1, 1 << 31, 1 << 63]
    fps += [f ^ (1 << rng.randrange(64)) for f in fps]
    df = spark.createDataFrame([(signed(f),) for f in set(fps)], "fp long")
    home, cover = {}, {}
    for r in sd.homes(df).collect():
        home.setdefault(r.fp, []).append(r.anchor)
    for r in sd.covers(df).collect():
        cover.setdefault(r.fp, []).append(r.anchor)
    code = lambda a: all((a & m).bit_count() % 2 == 0 for m in sd._CHECKS)
    half = lambda f, side: (f & (1 << 64) - 1) >> 32 * side & 0xFFFFFFFF
    for f in home:
        assert len(home[f]) == 2 and len(cover[f]) == len(set(cover[f])) <= 34
        for side in (0, 1):
            own = [a & 0xFFFFFFFF for a in cover[f] if a >> 32 == side]
            assert all(code(a) and (a ^ half(f, side)).bit_count() <= 2 for a in own)
            at = next(a & 0xFFFFFFFF for a in home[f] if a >> 32 == side)
            assert (at ^ half(f, side)).bit_count() <= 1 and at in own
    for f in home:
        for g in home:
            if ((f ^ g) & (1 << 64) - 1).bit_count() <= 3:
                assert set(home[f]) & set(cover[g])


@pytest.mark.parametrize("many,block", [(24, 1024), (0, 1024), (0, 3), (2, 2)])
def test_dense_groups_lose_nothing(spark, many, block):
    """Large balls of near copies around a few centres, compared directly or in blocks of any size."""
    rng = random.Random(many * 7 + block)
    fps = set()
    for _ in range(4):
        c = rng.getrandbits(64)
        for _ in range(60):
            f = c
            for _ in range(rng.randint(0, 4)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    fps |= {rng.getrandbits(64) for _ in range(100)}
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = {r.node: r.root for r in sd.components(sd.links(df, many=many, block=block)).collect()}
    want = brute_components(sorted(map(signed, fps)), lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    assert {n: got.get(n, n) for n in want} == want


def broadcast(plan):
    """What a plan, as it ran, broadcasts: the lines below each broadcast."""
    lines = plan.split("Initial Plan")[0].splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*|"))
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(k + 1, len(lines)) if depth(lines[j]) <= depth(line)), len(lines))
            yield "\n".join(lines[k:end])


def test_rows_at_anchors_are_not_broadcast(spark, monkeypatch):
    """A fingerprint of a few bytes becomes 34 rows, which Spark's estimate leaves out; under its limit they would go through the driver."""
    rng, plans, compact = random.Random(12), [], sd.compact
    centre = rng.getrandbits(64)
    fps = {rng.getrandbits(64) for _ in range(3000)} | {centre ^ 1 << a ^ 1 << b for a in range(32) for b in range(a)}

    def ran(df):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(sd, "compact", lambda df, name: compact(ran(df), name))
    ran(sd.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long").repartition(4)))
    assert len(plans) == 2 and "SortMergeJoin" in plans[0] and "SortMergeJoin" in plans[1]
    assert not [b for plan in plans for b in broadcast(plan) if "explode" in b]


@pytest.mark.parametrize("seed", range(4))
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 60
    edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(45)} | {(i, i + 1) for i in range(100, 160)}
    got = {r.node: r.root for r in sd.components(spark.createDataFrame(sorted(edges), "a long, b long")).collect()}
    nodes = sorted({x for e in edges for x in e})
    both = edges | {(b, a) for a, b in edges}
    want = brute_components(nodes, lambda a, b: (a, b) in both)
    assert {x: got.get(x, x) for x in nodes} == want


def test_hard_rows(docs, empty):
    rows = sd.near_duplicates(docs).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 12 and sd.near_duplicates(empty).count() == 0
    assert {by[i].component_id for i in (2, 3, 4)} == {2} and by[2].fp == 0 and by[5].component_id == 5
    kept = sd.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 5, 6, 7, 8, 9, 10] and ids.count(None) == 1
    assert sd.drop_near_duplicates(empty).count() == 0


def test_one_row_of_each_group_stays(sample):
    twice = sample.unionByName(sample.withColumn("doc_id", F.col("doc_id") + 100000))
    found = sd.near_duplicates(twice).collect()
    kept = {r.doc_id for r in sd.drop_near_duplicates(twice).collect()}
    assert kept == {r.component_id for r in found} and max(kept) < 100000


def test_rows_of_different_texts_stay_whatever_their_ids(spark):
    """Null ids and a repeated id over unrelated texts; copies of each go."""
    texts = ["a first text about rivers", "some other words on trains", "nothing to do with either of them", "one more that stands alone"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3]), (None, texts[3]), (None, None), (None, "")]
    kept = sd.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id or 0, r.text or "") for r in kept)) == sorted([(0, texts[0]), (0, texts[1]), (7, texts[2]), (7, texts[3]), (0, "")])


def test_marks_equal_those_of_spark(spark):
    texts = ["", "a", "abcdefg", "x" * 31, "é" * 40, "中" * 333]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64(F.col("t").cast("binary"))).collect()
    assert [r[0] for r in got] == [sd.mark(t.encode()) for t in texts]


def test_forest_of_blocks():
    a, b = sd._forest(np.array([0, 255], np.int64), np.array([1, 3, 0xF0F0F0], np.int64), 3)
    assert set(zip(a.tolist(), b.tolist())) == {(1, 0), (3, 0)}


def test_hot_keys_are_not_shuffled(spark, monkeypatch):
    """A third of the rows share a key, some keys have no match: the join is whole, and the shuffled part has no hot key."""
    monkeypatch.setattr(sd, "SHARE", 8)
    rows = spark.createDataFrame([(0 if i % 3 == 0 else i, i) for i in range(600)], "k long, x long")
    small = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("x").alias("y")).filter("k % 5 = 0")
    want = sorted((r.k, r.x, r.y) for r in rows.join(small.drop("n"), "k", "left").collect())
    key = lambda t: tuple(-1 if v is None else v for v in t)
    got = [(r.k, r.x, r.y) for r in sd.uneven_join(rows, small, "k", 600, "left").collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sorted((r.k, r.x, r.y) for r in sd.uneven_join(rows, small, "k", 600).collect()) == sorted((t for t in want if t[2] is not None))


@pytest.mark.parametrize("share", [4, 512])
def test_hub_of_a_third_of_all_nodes(spark, monkeypatch, share):
    monkeypatch.setattr(sd, "SHARE", share)
    edges = [(500, i) for i in range(1000, 1300)] + [(i, i + 1) for i in range(2000, 2600, 2)] + [(1299, 2000), (1200, 3)]
    got = {r.node: r.root for r in sd.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    both = set(edges) | {(b, a) for a, b in edges}
    assert got == brute_components(sorted({x for e in edges for x in e}), lambda a, b: (a, b) in both)


def test_a_component_of_a_third_of_all_rows(spark, monkeypatch):
    """Exact copies and near copies under one popular text, empty texts, and unrelated ones."""
    monkeypatch.setattr(sd, "SHARE", 8)
    rng = random.Random(9)
    base = " ".join(f"w{i}" for i in range(400))
    texts = [base] * 60 + [base + f" end{i}" for i in range(40)] + [""] * 60 + [None] * 20 + [" ".join(f"v{rng.randrange(9999)}" for _ in range(30)) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fps = {i: brute_fp(t) for i, t in enumerate(texts)}
    want = brute_components(list(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    assert {r.doc_id: r.component_id for r in sd.near_duplicates(df).collect()} == want
    assert sorted(r.doc_id for r in sd.drop_near_duplicates(df).collect()) == sorted(set(want.values()))


def test_no_text_is_shuffled(sample):
    """What is left of the plan is a scan and a look at two numbers of each row."""
    plan = sd.drop_near_duplicates(sample)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Scan parquet" in plan
