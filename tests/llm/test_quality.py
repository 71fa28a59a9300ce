import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import quality_classifier as qc, quality_rules as qr, queries

from .conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_base_columns_equal_brute_force(spark, docs, sample):
    odd = spark.createDataFrame([(100 + i, t, "", 0.0) for i, t in enumerate(["a b c d e f g h a b c d e f g h", "a " * 20, "x\ny\nx\n \n\ny", "é ü|# é", "a b c d e f g h i a b c d e f g", "\x1c\x1f\x85", "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 0"])], "doc_id long, text string, labels string, score double")
    for df in (docs, odd, sample):
        rows = qr.judge(df).collect()
        want = Counter((r.doc_id, *brute(r.text)) for r in df.select("doc_id", "text").collect())
        assert Counter((r.doc_id, *(r[c] for c in BASE)) for r in rows) == want
        for r in rows:
            assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)


NAMES = ["a", "b", "c", "d", "e"]
TWO = {"x": ("a", "b"), "y": ("c", "d")}
SIZES = np.array([0.8, 0.12, 0.08])
BLAME = np.array([[0.1, 0.9, 0.1], [0.01, 0.9, 0.1], [0.01, 0.1, 0.9], [0.01, 0.1, 0.9], [0.5, 0.5, 0.5]])


def drawn(seed, n=4000):
    """Votes of five rules on good texts and two kinds of junk; the first rule blames one good text in ten, the last votes at random."""
    rng = np.random.default_rng(seed)
    kind = rng.choice(3, n, p=SIZES)
    votes = np.where(rng.random((n, 5)) < BLAME[:, kind].T, -1, 1)
    votes[rng.random((n, 5)) < 0.15] = 0
    return kind, votes, *np.unique(votes, axis=0, return_counts=True)


def plain_em(patterns, counts, names, kinds, steps):
    """The same model by loops over patterns, classes and rules."""
    C, R = len(kinds) + 1, len(names)
    sizes = [0.8] + [0.2 / len(kinds)] * len(kinds)
    blame = [[0.03] + [0.9 if n in meant else 0.2 for meant in kinds.values()] for n in names]
    for step in range(steps + 1):
        post = []
        for p in patterns:
            w = [sizes[c] * np.prod([blame[r][c] if p[r] == -1 else 1 - blame[r][c] if p[r] == 1 else 1.0 for r in range(R)]) for c in range(C)]
            post.append([x / sum(w) for x in w])
        if step == steps:
            return sizes, blame, [x[0] for x in post]
        sizes = [(sum(n * x[c] for n, x in zip(counts, post)) + 1) / (sum(counts) + C) for c in range(C)]
        of = lambda r, c, v: 1 + sum(n * x[c] for p, n, x in zip(patterns, counts, post) if p[r] == v)
        blame = [[of(r, c, -1) / (of(r, c, -1) + of(r, c, 1)) for c in range(C)] for r in range(R)]


def test_expectation_maximisation_equals_plain_loops():
    _, _, patterns, counts = drawn(1)
    model = qr.LabelModel(NAMES, TWO, steps=15).fit(patterns, counts.astype(float))
    sizes, blame, good = plain_em(patterns.tolist(), counts.tolist(), NAMES, TWO, 15)
    assert np.allclose(model.sizes, sizes) and np.allclose(model.blame, blame) and np.allclose(model.posterior(patterns), good)


def test_posterior_weighs_votes_instead_of_asking_for_all():
    """A blame of the careless rule alone doesn't sink a text; the rule that votes at random counts for nothing; two blames that good texts never get do sink one."""
    kind, votes, patterns, counts = drawn(2)
    model = qr.LabelModel(NAMES, TWO).fit(patterns, counts.astype(float))
    kept, all_pass = model.posterior(votes) >= 0.5, ~(votes == -1).any(1)
    known = qr.LabelModel(NAMES, TWO)
    known.sizes, known.blame = SIZES, BLAME
    right = lambda x: (x == (kind == 0)).mean()
    assert right(kept) > right(known.posterior(votes) >= 0.5) - 0.01 > 0.9 > 0.7 > right(all_pass)
    assert (kept & ~all_pass & (kind == 0)).sum() > 500
    assert abs(model.prior - 0.8) < 0.03 and np.abs(model.blame[:, 0] - [0.1, 0.01, 0.01, 0.01, 0.5]).max() < 0.04
    one = lambda *v: model.posterior(np.array([v]))[0]
    assert one(-1, 1, 1, 1, 1) > 0.8 > 0.1 > one(1, 1, -1, -1, 1) and abs(one(1, 1, 1, 1, -1) - one(1, 1, 1, 1, 0)) < 0.05
    assert np.argsort(model.accuracies())[0] == 4
    assert len(qr.LabelModel(NAMES, TWO).fit(patterns[:0], counts[:0].astype(float)).posterior(patterns[:0])) == 0


def test_posterior_differs_from_all_must_pass_and_is_better(spark):
    """Over labelled documents that pass the base rule: texts with a blame are kept, as their labels say, and junk isn't."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    x = qr.judge(docs).filter(~F.col("base_failed")).withColumnRenamed("quality", "posterior").join(labels, "doc_id").select("kept", "quality", F.col("votes").contains("-").alias("blamed")).collect()
    good, junk = [r for r in x if r.quality == 1], [r for r in x if r.quality == 0]
    share = lambda rows, f: sum(map(f, rows)) / len(rows)
    assert share(good, lambda r: r.kept) > 0.995 > share(good, lambda r: not r.blamed) and share(junk, lambda r: r.kept) < 0.01
    assert sum(r.kept and r.blamed for r in good) > 10 > 1 > sum(r.kept and r.blamed for r in junk)


def test_rules_follow_the_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    x = qr.judge(docs).drop("quality").filter(~F.col("base_failed")).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {r.quality: r.kept for r in x}
    assert share[1] > 0.98 and share[0] < 0.3


def test_keep_filters_whole_rows(docs, empty, sample):
    for df in (docs, sample):
        want = Counter(r.doc_id for r in qr.judge(df).filter("kept").collect())
        kept = qr.keep(df)
        assert kept.columns == df.columns and Counter(r.doc_id for r in kept.collect()) == want
    assert qr.keep(empty).count() == 0 and qr.judge(empty).count() == 0


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    x = queries.op4_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert len(x) > 50
    assert np.mean([r.predicted == r.quality for r in x]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in x)


def test_held_out_rows_are_not_learned_from(spark):
    """Turning the labels of held-out rows round changes no score."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(qc.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = [{r.doc_id: r.score for r in qc.score(docs, x).collect()} for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_classifier_bears_hard_rows(spark, docs, empty):
    labels = spark.createDataFrame([(i, 1, 0) for i in (1, 6, 9)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = qc.score(docs, labels).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    none = labels.filter("doc_id > 99")
    assert {r.score for r in qc.score(docs, none).collect()} == {0.5}
    assert qc.score(empty, labels).count() == 0 and qc.keep(docs, none).count() == 12 and qc.keep(empty, labels).columns == empty.columns


def test_prior_of_separable_data():
    rng = np.random.default_rng(1)
    k = len(qc.FEATURES)
    flat = np.ones(k)
    p = rng.normal(2, 1, (2000, k))
    u = np.concatenate([rng.normal(2, 1, (3200, k)), rng.normal(-2, 1, (800, k))])[rng.permutation(4000)]
    m = qc.PuModel(flat).fit(p, u)
    assert abs(m.prior - 0.8) < 0.05
    assert (m.logits(rng.normal(-2, 1, (200, k))) < 0).mean() > 0.95 and (m.logits(rng.normal(2, 1, (200, k))) > 0).mean() > 0.95


@pytest.mark.parametrize("texts", [[b""], [b"", b" "], [b"one"], [b"\xff\xfe"], [b"a " * 10000]])
def test_features_are_finite(texts):
    assert np.isfinite(qc.vectors(texts)).all() and qc.vectors(texts).shape == (len(texts), len(qc.WEIGHTS))


def test_grams_equal_counts_by_hand():
    """Shares of hashed words, pairs and runs of bytes, whatever else is in the batch."""
    import xxhash

    place = lambda x: (x * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - 8
    texts = [b"a b a  b c", b"", b"ab", "é — ü".encode(), b"x" * 50, b"one\ntwo"]
    got = qc.grams(texts)
    for t, row in zip(texts, got):
        h = [xxhash.xxh32_intdigest(w) for w in t.split()]
        words = [place(x) for x in h] + [place((y * 0x85EBCA6B & 0xFFFFFFFF) ^ x) for x, y in zip(h, h[1:])]
        runs = [place(t[i] << 16 | t[i + 1] << 8 | t[i + 2]) for i in range(len(t) - 2)]
        want = [round(255 * (some.count(k) / max(len(some), 1)) ** 0.5) for some in (words, runs) for k in range(qc.GRAMS)]
        assert row.tolist() == want
    assert all((qc.grams([t])[0] == row).all() for t, row in zip(texts, got))


def test_junk_that_only_the_words_show(spark):
    """Two vocabularies with equal statistics: labels name the first one's texts, and the n-grams tell them from the rest."""
    import random

    rng = random.Random(4)
    vocab = {k: ["".join(rng.sample("abcdefghij", 5)) for _ in range(60)] for k in (0, 1)}
    kind = [int(rng.random() < 0.3) for _ in range(1500)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(vocab[k]) for _ in range(60))) for i, k in enumerate(kind)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i, k in enumerate(kind) if not k and i % 2], "doc_id long, quality int, toxic int")
    rows = qc.score(docs, labels).collect()
    assert np.mean([(r.score >= 0.5) == (kind[r.doc_id] == 0) for r in rows if r.held_out]) > 0.95
