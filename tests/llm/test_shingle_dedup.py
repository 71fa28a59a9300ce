import random

import numpy as np
import pytest

import corpus_pipeline as cp
from quantloom.llm import shingle_dedup as sh

from .conftest import SF
from .test_dedup import brute_components, brute_fp


def brute(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[k : k + 5]) for k in range(len(words) - 4)} or ({b" ".join(words)} if words else set())


def want_of(rows):
    """Ids that stay, by all pairs."""
    sets = {i: brute(t) for i, t in rows}
    linked = lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    return set(brute_components(sorted(sets), linked).values())


def test_whole_table_equals_all_pairs(sample):
    rows = [tuple(r) for r in sample.select("doc_id", "text").collect()]
    kept = [r.doc_id for r in sh.drop_similar(sample).collect()]
    assert sorted(kept) == sorted(want_of(rows)) and len(kept) < len({frozenset(brute(t)) for _, t in rows})


def edited(rng, words, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"new{rng.randrange(10**9)}"
    return " ".join(out)


def test_stage_drops_copies_with_a_few_edits(spark):
    """One edit in a short text, several in long ones, and pairs just at and below the limit."""
    rng = random.Random(3)
    rows = []
    for k in range(60):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randint(40, 300))]
        rows += [(10 * k, " ".join(words)), (10 * k + 1, edited(rng, words, max(1, len(words) // 60))), (10 * k + 2, edited(rng, words, len(words) // 25))]
    rows += [(5000, "a b c d e f g h i"), (5001, "a b c d e f g h"), (5002, "q r s t u v w x"), (5003, "q r s t u v w")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in cp.dedup(spark, df, SF).collect())
    assert kept == sorted(want_of(rows)) and 5001 not in kept and 5003 in kept and 61 < len(kept) < 130


def test_fingerprints_bring_candidates(spark, monkeypatch):
    """Without any band the stage finds what covering anchors link, if the exact comparison holds; and nothing else."""
    monkeypatch.setattr(sh, "bands", lambda found: np.zeros(0, np.int64))
    rng = random.Random(8)
    rows = []
    for k in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(600)]
        rows += [(10 * k, " ".join(words)), (10 * k + 1, edited(rng, words, 1)), (10 * k + 2, edited(rng, words, 120))]
    rows += [(500, "one two three one two three one two three"), (501, "one two three one two three one two three one two three")]
    rows += [(600, "a " * 100 + "one end of it that no other text has"), (601, "a " * 100 + "and a second tail of many other words"), (602, "")]
    sets, fps = ({i: of(t) for i, t in rows} for of in (brute, brute_fp))
    close = lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3
    alike = lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    want = brute_components(sorted(sets), lambda a, b: close(a, b) and alike(a, b))
    assert want_of(rows) < set(want.values()) < set(sets) and any(close(a, b) and not alike(a, b) for a in sets for b in sets)
    kept = sorted(r.doc_id for r in sh.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == sorted(set(want.values()))


def test_hard_rows(docs, empty):
    kept = sh.drop_similar(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and sorted(i for i in ids if i is not None) == [1, 2, 5, 6, 7, 8, 9, 10] and ids.count(None) == 1
    assert sh.drop_similar(empty).count() == 0


def tables(spark, texts):
    sets = spark.createDataFrame([(n, sh.shingles(t.encode()).tobytes()) for n, t in enumerate(texts)], "node long, shingles binary")
    return sets, spark.createDataFrame([(n, 0) for n in range(len(texts))], "node long, root long")


@pytest.mark.parametrize("block, seed_bytes", [(512, 1 << 17), (7, 1 << 17), (7, 0)])
def test_blocks_lose_nothing(spark, block, seed_bytes, monkeypatch):
    """Clusters that fall apart into several components, with seeds and without any."""
    monkeypatch.setattr(sh, "SEED_BYTES", seed_bytes)
    rng = random.Random(block)
    words = [f"w{k}" for k in range(80)]
    texts = sorted({edited(rng, words, rng.randint(0, 4)) for _ in range(120)})
    of = {n: brute(t) for n, t in enumerate(texts)}
    found = {r.node: r.root for r in sh.components(sh.links(*tables(spark, texts), block=block)).collect()}
    want = brute_components(sorted(of), lambda a, b: len(of[a] & of[b]) / len(of[a] | of[b]) >= 0.8)
    assert {n: found.get(n, n) for n in want} == want and 1 < len(set(want.values())) < len(want)


def test_large_group_of_copies_is_not_compared_in_all_pairs(spark, monkeypatch):
    """Seeds tie the blocks of a group together; two texts that are unlike the others are all that is left to compare."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(80)]
    texts = [edited(rng, words, 1) for _ in range(300)] + [edited(rng, words, 30) for _ in range(2)]
    left, remaining = [], sh.remaining

    def watched(*given):
        left.append(sorted(r.node for r in remaining(*given).collect()))
        return remaining(*given)

    monkeypatch.setattr(sh, "remaining", watched)
    found = {r.node: r.root for r in sh.components(sh.links(*tables(spark, texts), block=20)).collect()}
    assert set(found) == set(range(300)) and set(found.values()) == {0} and left == [[300, 301]]


def test_similar_equals_sets(monkeypatch):
    monkeypatch.setattr(sh, "_COLUMNS", 5)
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 30, 25).astype(np.uint64)) for _ in range(40)]
    x, y = sh.similar(sets[:15], sets[15:], 0.6)
    py = [set(s.tolist()) for s in sets]
    assert set(zip(x.tolist(), y.tolist())) == {(i, j) for i in range(15) for j in range(25) if len(py[i] & py[15 + j]) / len(py[i] | py[15 + j]) >= 0.6}
