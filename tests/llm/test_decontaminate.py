import random

import numpy as np
import pytest

from quantloom.llm import decontaminate as dc

from .conftest import SF


def distance_ends(pattern, text):
    """Edit distances by the table: a free start in the text."""
    row = list(range(len(pattern) + 1))
    out = []
    for c in text:
        last, row[0] = row[0], 0
        for i, p in enumerate(pattern, 1):
            last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (p != c))
        out.append(row[-1])
    return out


@pytest.mark.parametrize("seed", range(40))
def test_myers_equals_the_table(seed):
    rng = random.Random(seed)
    pattern = [rng.randint(1, 3) for _ in range(rng.randint(1, 90))]
    text = [rng.randint(0, 3) for _ in range(rng.randint(0, 120))]
    masks = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    assert dc.edit_ends(masks, len(pattern), text) == distance_ends(pattern, text)


def brute(items, text, rate=dc.RATE):
    words = dc.words_of((text or "").encode())
    found = {}
    for i, t in items:
        seq = dc.words_of((t or "").encode())
        if seq and (d := min(distance_ends(seq, words), default=len(seq))) <= int(rate * len(seq)):
            found[i] = d
    return found


def test_finder_equals_brute_force():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 25)))) for i in range(40)] + [(40, ""), (41, None), (42, "?!")]
    texts = []
    for _ in range(150):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 30))]
        seq = rng.choice(items[:40])[1].split()
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(seq)) if seq else 0
            seq[k : k + rng.randint(0, 1)] = [rng.choice(vocab)] * rng.randint(0, 2)
        at = rng.randint(0, len(words))
        texts.append(", ".join(words[:at] + seq + words[at:]))
    got = dc.LeakFinder(items).find([t.encode() for t in texts])
    for t, found in zip(texts, got):
        assert {i: d for i, d, *_ in found} == brute(items, t)
        for i, d, n, first, last in found:
            part, seq = dc.words_of(t.encode())[first : last + 1], dc.words_of(dict(items)[i].encode())
            assert distance_ends(seq, part)[-1] == d and n == len(seq)


def test_case_and_punctuation_do_not_hide_a_leak():
    item = "Étant donné que la réponse est quarante deux, donnez la question."
    assert dc.LeakFinder([(7, item)]).find([("x y. " + item.upper().replace(" ", " -- ") + " z").encode()])[0][0][:2] == (7, 0)


def test_whole_table_equals_brute_force(spark, sample):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    got = {(r.doc_id, r.item_id): r.distance for r in dc.find_leaks(sample, bench).collect()}
    short = {r.doc_id: r.text for r in sample.collect() if len(r.text or "") < 6000}
    want = {(d, i): k for d, t in short.items() for i, k in brute(items, t).items()}
    assert {k: v for k, v in got.items() if k[0] in short} == want and want
    small = {(r.doc_id, r.item_id): r.distance for r in dc.find_leaks(sample, bench, block_bytes=500).collect()}
    assert small == got
    clean = dc.drop_leaks(sample, bench, block_bytes=2000)
    assert {r.doc_id for r in sample.collect()} - {r.doc_id for r in clean.collect()} == {d for d, _ in got} and clean.columns == sample.columns


def test_hard_rows(spark, docs, empty):
    bench = spark.createDataFrame([(1, "same text here"), (2, None), (3, ""), (4, "same text here"), (None, "a text without an id")], "item_id long, text string")
    got = sorted((r.doc_id or -1, r.item_id or -1) for r in dc.find_leaks(docs, bench).collect())
    assert got == [(-1, -1), (5, 1), (5, 1), (5, 4), (5, 4)]
    assert dc.find_leaks(empty, bench).count() == 0 and dc.find_leaks(docs, bench.filter("item_id > 9")).count() == 0
    assert dc.drop_leaks(docs, bench).count() == 9 and dc.drop_leaks(docs, bench.filter("item_id > 9")).count() == 12


def test_pieces_are_one_more_than_the_budget():
    f = dc.LeakFinder([(0, " ".join(f"w{i}" for i in range(30)))])
    assert len(f.pieces) == f.items[0][2] + 1 == 7 and sum(map(len, f.pieces)) == 30
    with pytest.raises(ValueError):
        dc.LeakFinder([], 1.0)
    assert np.array_equal(dc.LeakFinder([]).find([b"a"]), [[]])
