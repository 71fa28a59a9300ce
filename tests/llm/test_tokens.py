import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quantloom.llm import bpe_stream, queries, token_counts, token_output
from quantloom.llm.common import fresh_path
from quantloom.llm.piece_encoder import PieceEncoder

from .conftest import SF, VOCABULARIES

BYTES, WORDS = f"{VOCABULARIES}/byte_bpe_50k.json", f"{VOCABULARIES}/word_bpe_49k.json"
ODD = list("abcdeABCÉéßÜΣσςİıſ́\xa0\x85\x1c\x1f\n\t\r     ''sdt.,!?<|>0123½²中あ한😀👍🏽‍​﻿̸` 　 ") + ["<|endoftext|>", "<|startoftext|>", "'ll", " the"]


@pytest.fixture(scope="module")
def library():
    made = {p: Tokenizer.from_file(p) for p in (BYTES, WORDS)}
    for t in made.values():
        t.no_truncation()
        t.no_padding()
    return made


def texts(seed, n=1500, longest=30):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_pieces_equal_the_library(library):
    some = texts(1) + ["One line.\nNext line, with words", "a\nb c\nd", "\n", " ", "x" * 5000]
    got = PieceEncoder(BYTES).encode([t.encode() for t in some])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [e.ids for e in library[BYTES].encode_batch_fast(some, add_special_tokens=False)]


def test_pieces_with_a_small_memo(library, monkeypatch):
    e = PieceEncoder(BYTES)
    e.memo.most = 3
    for t in ("a b c d e f", "c d e x y z", "a a a b b b"):
        assert np.frombuffer(e.encode([t.encode()])[0], "<u4").tolist() == library[BYTES].encode(t, add_special_tokens=False).ids


def test_words_equal_the_library(library):
    bpe = bpe_stream.WordBpe(WORDS)
    for t in texts(2):
        want = library[WORDS].encode(t, add_special_tokens=False).ids
        for block in (bpe_stream.BLOCK, 5, 17):
            assert np.frombuffer(b"".join(bpe.stream(t, block)), "<u4").tolist() == want
        assert bpe.decode(want) == library[WORDS].decode(want, skip_special_tokens=False)


def test_every_piece_comes_from_the_transducer_and_every_text_from_ids(library, monkeypatch):
    """All ids are counted on their way out of ``stream`` and into the decoder; nothing else makes ids or text."""
    bpe, out, fed = bpe_stream.WordBpe(WORDS), [], []
    stream, feed = bpe.merges.stream, bpe_stream.Decoder.feed
    monkeypatch.setattr(bpe.merges, "stream", lambda symbols: (out.append(t) or t for t in stream(symbols)))
    monkeypatch.setattr(bpe_stream.Decoder, "feed", lambda self, ids: fed.append(ids) or feed(self, ids))
    text = "Words that differ from one another, 42 of them; unforgettably " + "x" * 300_000 + " <|endoftext|> end"
    n, _, decoded = bpe_stream.digest(bpe, text)
    want = library[WORDS].encode(text, add_special_tokens=False).ids
    assert n == len(want) and np.frombuffer(b"".join(fed), "<u4").tolist() == want and len(fed) > 2
    # a piece that comes twice would be in the memo, so none does here; special tokens aren't merged
    assert [bpe.vocab[t] for t in out] == [i for i in want if i not in bpe.special.values()]
    assert decoded == hashlib.sha256(library[WORDS].decode(want, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("segment", [1, 2, 3, 7, 50])
def test_runs_read_in_segments_have_the_pieces_of_the_whole(segment):
    for t in texts(8, 400) + ["'ll've're" * 9, "Ǆ" * 30 + "中文" * 40 + "각" * 9 + "e\u0301" * 20]:
        t = "".join(bpe_stream._SPACES.split(t))
        got = ["".join(p) for p in bpe_stream._Run(t, 0, len(t), segment).pieces()]
        assert got == bpe_stream._PIECES.findall(bpe_stream._normal(t))


@pytest.mark.parametrize("run", ["lorem ipsum dolor sit amet, ", "x", "Ab1!é"])
def test_memory_does_not_grow_with_the_text(run):
    """Peaks of a digest over a text and over one six times as long, besides the text itself."""
    import tracemalloc

    bpe, peaks = bpe_stream.WordBpe(WORDS), []
    for n in (150_000, 900_000):
        text = run * (n // len(run))
        bpe_stream.digest(bpe, text[:100_000])
        tracemalloc.start()
        bpe_stream.digest(bpe, text)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.2 * peaks[0] + 1_000_000


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz", "aeinrst", "ab", "the", "😀é"])
def test_stream_equals_all_at_once(alphabet):
    bpe, rng = bpe_stream.WordBpe(WORDS), random.Random(alphabet)
    for n in (1, 2, 700, 1400, 4001):
        symbols = list(bpe._symbols(["".join(rng.choice(alphabet) for _ in range(n))]))
        assert list(bpe.merges.stream(iter(symbols))) == bpe.merges.merge(list(symbols))


@pytest.mark.parametrize("seed", range(60))
def test_lookahead_of_random_merge_lists(seed):
    """The computed lookahead suffices: windows just above it give the tokens of the whole."""
    rng = random.Random(seed)
    tokens, merges = list("abc"), []
    for _ in range(rng.randint(1, 25)):
        m = rng.choice(tokens), rng.choice(tokens)
        if m not in merges and m[0] + m[1] not in tokens:
            merges.append(m)
            tokens.append(m[0] + m[1])
    ml = bpe_stream.MergeList(merges)
    for _ in range(20):
        s = [rng.choice("abc") for _ in range(rng.randint(1, 6 * ml.lookahead))]
        assert list(ml.stream(iter(s), window=1)) == ml.merge(list(s))


def test_held_symbols_are_bounded():
    ml = bpe_stream.MergeList([("a", "b"), ("ab", "c")])
    taken = 0

    def endless():
        nonlocal taken
        while True:
            for c in "abcb":
                taken += 1
                yield c

    out = ml.stream(endless())
    for k in range(3000):
        next(out)
        assert taken - 2 * k < 20 * ml.lookahead


def test_incremental_text():
    bpe = bpe_stream.WordBpe(WORDS)
    ids = np.frombuffer(bpe.encode("Héllo wörld 😀<|endoftext|>"), "<u4").tolist()
    assert "".join(bpe.text(ids)).split() == ["héllo", "wörld", "😀", "<|endoftext|>"]


def test_digests_of_hard_rows(docs, empty, library):
    rows = bpe_stream.digests(docs, WORDS).collect()
    given = docs.select("doc_id", "text").collect()
    assert len(rows) == len(given) and bpe_stream.digests(empty, WORDS).count() == 0
    for r, g in zip(rows, given):
        ids = library[WORDS].encode(g.text or "", add_special_tokens=False).ids
        assert (r.doc_id, r.n_tokens) == (g.doc_id, len(ids))
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library[WORDS].decode(ids, skip_special_tokens=False).encode()).hexdigest()
    full = bpe_stream.encode_documents(docs, WORDS).filter("doc_id = 1").first()
    assert len(full.ids) == 4 * full.n_tokens and full.decoded.startswith("this</w> work</w>")


def test_orc_round_trip(spark, docs, sample, empty, library):
    for df in (docs, sample.select("doc_id", "text")):
        path = fresh_path(spark, "orc")
        token_output.write_tokens(df, path, BYTES, 2)
        rows = token_output.summaries(spark, path).collect()
        given = sorted(((g.doc_id is not None, g.doc_id or 0, g.text or "") for g in df.select("doc_id", "text").collect()), key=lambda x: (x[0], x[1], x[2].encode()))
        start, want = 0, []
        for known, i, t in given:
            ids = library[BYTES].encode(t, add_special_tokens=False).ids + [2]
            want.append((i if known else None, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert sorted(map(tuple, rows), key=lambda x: x[1]) == want
        some = given[len(given) // 2][1]
        assert {r.doc_id for r in token_output.read_tokens(spark, path, [some]).collect()} <= {some}
    path = fresh_path(spark, "orc")
    token_output.write_tokens(empty, path, BYTES, 2)
    assert token_output.summaries(spark, path).count() == 0


def test_orc_filters_reach_the_scan(spark, sample):
    path = fresh_path(spark, "orc")
    token_output.write_tokens(sample, path, BYTES, 2)
    plan = token_output.read_tokens(spark, path, [3, 5])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id, [3,5])]" in plan or "PushedFilters: [IsNotNull(doc_id), In(doc_id" in plan


@pytest.mark.parametrize("block", [256, 1 << 20])
def test_flat_files(spark, docs, sample, library, block):
    """Texts with the separator's literal, at starts, ends and in between, are among them; blocks of a few ids cut everywhere."""
    mark = "<|endoftext|>"
    odd = spark.createDataFrame([(50, mark), (51, mark + "start"), (52, f"end{mark}"), (53, f"a {mark} b {mark}{mark} c"), (54, "plain")], "doc_id long, text string")
    df = docs.select("doc_id", "text").unionByName(odd).unionByName(sample.select("doc_id", "text"))
    plain = Tokenizer.from_file(BYTES)
    plain.encode_special_tokens = True
    path = fresh_path(spark, "flat")
    manifest = _stored(spark, token_counts.write_token_files(df, path, BYTES, 50256))
    found = token_counts.count_documents(token_counts.scan_blocks(token_counts.blocks(spark, path, manifest, block), path, 50256)).join(manifest, ["file", "position"]).collect()
    want = sorted((-1 if g.doc_id is None else g.doc_id, len(plain.encode(g.text or "", add_special_tokens=False).ids) + 1) for g in df.collect())
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in found) == want and all(r.closed for r in found)


def test_token_counts_of_the_whole_query_equal_the_library(spark, sample):
    plain = Tokenizer.from_file(BYTES)
    plain.encode_special_tokens = True
    want = sorted((g.doc_id, len(plain.encode(g.text or "", add_special_tokens=False).ids) + 1, True) for g in sample.select("doc_id", "text").collect())
    assert sorted(map(tuple, queries.op2_token_counts(spark, SF).collect())) == want
    path = fresh_path(spark, "none")
    assert token_counts.count_documents(token_counts.scan_blocks(token_counts.blocks(spark, path), path, 0)).count() == 0


@pytest.mark.parametrize("block", [256, 1 << 20])
def test_flat_files_with_the_literal_of_the_end(spark, docs, block):
    """Row 9 holds the literal; it and the rows after it keep their own counts, and no position is left over."""
    plain = Tokenizer.from_file(BYTES)
    plain.encode_special_tokens = True
    odd = spark.createDataFrame([(20, "see <|endoftext|> here"), (21, "<|endoftext|>"), (22, "after"), (23, " <|endoftext|>\n\n<|endoftext|>x")], "doc_id long, text string")
    df = docs.select("doc_id", "text").unionByName(odd).coalesce(1)
    path = fresh_path(spark, "flat")
    manifest = _stored(spark, token_counts.write_token_files(df, path, BYTES, 50256))
    found = token_counts.count_documents(token_counts.scan_blocks(token_counts.blocks(spark, path, manifest, block), path, 50256)).join(manifest, ["file", "position"], "full").collect()
    want = sorted((-1 if g.doc_id is None else g.doc_id, len(plain.encode(g.text or "", add_special_tokens=False).ids) + 1) for g in df.collect())
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in found) == want and all(r.closed for r in found)


def test_an_end_id_inside_a_text_is_refused(spark, library):
    inside = library[BYTES].encode("here", add_special_tokens=False).ids[0]
    with pytest.raises(Exception, match="a text holds the end id"):
        token_counts.write_token_files(spark.createDataFrame([(1, "here")], "doc_id long, text string"), fresh_path(spark, "flat"), BYTES, inside).collect()


def _stored(spark, df):
    path = fresh_path(spark, "manifest")
    df.write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("seed", range(6))
def test_separators_across_blocks(spark, tmp_path, seed):
    rng = np.random.default_rng(seed)
    want = []
    for k, n in enumerate((0, 1, 7, 40, 200)):
        ids = rng.integers(0, 4, n).astype("<u2")
        (tmp_path / f"f{k}.bin").write_bytes(ids.tobytes())
        cuts = [0, *(np.flatnonzero(ids == 3) + 1).tolist()]
        want += [(f"f{k}.bin", p, s, e - s, True) for p, (s, e) in enumerate(zip(cuts, cuts[1:]))]
        if cuts[-1] < n:
            want.append((f"f{k}.bin", len(cuts) - 1, cuts[-1], n - cuts[-1], False))
    uri = f"file://{tmp_path}"
    for block in (2, 4, 10, 1 << 20):
        found = token_counts.count_documents(token_counts.scan_blocks(token_counts.blocks(spark, uri, block_bytes=block), uri, 3))
        assert sorted(map(tuple, found.select("file", "position", "start", "n_tokens", "closed").collect())) == sorted(want)
