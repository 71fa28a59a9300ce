import random
import re

import pytest

from quantloom.llm.license_scan import BASE_PHRASES, TEMPLATES, LicenseScanner, SuffixAutomaton, scan_licenses, words_of
from quantloom.llm.license_texts import LICENSES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for phrase, label in BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def longest(seqs, text):
    """Matching statistics by definition."""
    subs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    return [max((n for n in range(1, i + 2) if tuple(text[i + 1 - n : i + 1]) in subs), default=0) for i in range(len(text))]


@pytest.mark.parametrize("seed", range(30))
def test_automaton_gives_matching_statistics(seed):
    rng = random.Random(seed)
    seqs = [[rng.randint(1, 3) for _ in range(rng.randint(1, 9))] for _ in range(rng.randint(1, 5))]
    text = [rng.randint(1, 4) for _ in range(40)]
    sa, state, matched, got = SuffixAutomaton(seqs), 0, 0, []
    for c in text:
        state, matched = sa.step(state, matched, c)
        got.append(matched)
        for k, end in sa.ends[state]:
            assert seqs[k][end + 1 - matched : end + 1] == text[len(got) - matched : len(got)]
    assert got == longest(seqs, text)


@pytest.mark.parametrize("seed", range(20))
def test_base_phrases_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = "cc by CC-BY general public license All rights reserved gnu the of licensed under 4.0 GENERAL Public rights".split(" ") + ["\n", "é", "_", "cc\x7fby"]
    texts = ["".join(rng.choice(pool) + rng.choice([" ", " ", "-", "\n", "."]) for _ in range(rng.randint(0, 40))) for _ in range(50)]
    scanner = LicenseScanner()
    for t, x in zip(texts, scanner.scan([t.encode() for t in texts])):
        at = [s for _, s in x["base"]]
        assert (x["n_words"], len(at), min(at, default=None), max(at, default=None), ",".join(sorted({scanner.phrases[p][0] for p, _ in x["base"]}))) == brute(t)


@pytest.mark.parametrize("label,text", TEMPLATES)
def test_every_template_is_found_in_prose(label, text):
    x = LicenseScanner().scan([f"Some prose, then. {text.upper()}! And more of it.".encode()])[0]
    assert label in {s[0] for s in x["spans"]}
    assert max(s[3] for s in x["spans"]) == 1.0
    start, end = next((s[1], s[2]) for s in x["spans"] if s[0] == label)
    assert end - start >= len(words_of(text.encode())) * 0.6


def test_changed_words_still_chain():
    text = dict(TEMPLATES)["isc"].replace("for any purpose", "for every purpose")
    assert "isc" in {s[0] for s in LicenseScanner().scan([text.encode()])[0]["spans"]}
    assert not LicenseScanner().scan([b"you may use the software and the license of the work"])[0]["spans"]


def test_hard_rows(docs, empty):
    rows = scan_licenses(docs).collect()
    assert len(rows) == 12 and scan_licenses(empty).count() == 0
    by = {r.doc_id: r for r in rows}
    assert by[1].base_labels == "cc-by,reserved" and "cc-by-4.0" in by[1].labels and 0.9 < by[1].score <= 1
    for i in (2, 3, 4):
        assert (by[i].n_words, by[i].n_base, by[i].first_word, by[i].labels, by[i].score) == (0, 0, None, "", 0.0)
    assert [r.n_words for r in rows if r.doc_id == 5] == [3, 3] and by[None].n_words == 5 and by[7].n_words == 4000


@pytest.mark.parametrize("filler", ["", "some prose of another kind stands here between the two notices and goes on for a while"])
def test_every_copy_of_a_notice_has_a_span(filler):
    """Concatenated files: three copies of one notice and one of another."""
    isc, other = dict(TEMPLATES)["isc"], next((label, t) for label, t in TEMPLATES if label != "isc" and len(words_of(t.encode())) > 20)
    text = f" {filler} ".join([isc, other[1], isc, isc.replace("for any purpose", "for every purpose")])
    spans = LicenseScanner().scan([text.encode()])[0]["spans"]
    mine = [s for s in spans if s[0] == "isc"]
    assert len(mine) == 3 and all(a[2] <= b[1] for a, b in zip(mine, mine[1:])) and mine[0][3] == mine[1][3] == 1.0 > mine[2][3] >= 0.6
    assert other[0] in {s[0] for s in spans}


SCANNER = LicenseScanner()


def spans(text):
    return SCANNER.scan([text.encode()])[0]["spans"]


def test_stock_phrases_give_no_label():
    for text in (
        "music licensed under the rules", "she was released under the terms of the deal", "permission is hereby granted to nobody", "this is free and it is provided as is", "in no event shall the children be late",
        "you may use the software and the license of the work, in whole or in part", "licensed under the gnu general public license version 5", "for any purpose with or without a fee",
    ):
        assert spans(text) == [], text


@pytest.mark.parametrize("label,text", LICENSES)
def test_whole_licences_and_their_paragraphs(label, text):
    """A whole licence is one span of its own label; a paragraph alone has a span of a licence that holds it."""
    n = len(words_of(text.encode()))
    assert spans(f"before it {text} after it") == [(label, 2, 2 + n, 1.0)]
    holders = lambda p: {k for k, t in LICENSES if words_of(p.encode()) == [w for w in words_of(t.encode())][: len(words_of(p.encode()))] or " ".join(map(bytes.decode, words_of(p.encode()))) in " ".join(map(bytes.decode, words_of(t.encode())))}
    for p in text.split("\n\n"):
        if len(p.split()) >= 12:
            found = spans(f"prose {p} prose")
            assert len(found) == 1 and found[0][3] == 1.0 and found[0][0] in holders(p) | {k for k, _ in TEMPLATES}


def test_a_dozen_licences_are_whole():
    assert sum(len(words_of(t.encode())) > 90 for _, t in LICENSES) >= 12 and len({k for k, _ in LICENSES}) >= 20


def test_tags():
    for tag, label in (("MIT", "mit"), ("MIT-0", "mit-0"), ("Apache-2.0", "apache-2.0"), ("GPL-3.0-or-later", "gpl-3.0"), ("LGPL-2.1-only", "lgpl-2.1"), ("CC-BY-SA-4.0", "cc-by-sa-4.0")):
        assert [s[0] for s in spans(f"# SPDX-License-Identifier: {tag}\nimport os")] == [label]


def test_files_one_after_another_keep_all_their_licences():
    parts = [LICENSES[k] for k in (0, 6, 8, 0, 3)]
    text = " some code between them ".join(t for _, t in parts)
    assert [s[0] for s in sorted(spans(text), key=lambda s: s[1])] == [k for k, _ in parts]


def best_chain(parts, max_gap):
    """Most covered words of any chain of ``parts``, by all of their subsets."""
    best = 0
    for mask in range(1, 1 << len(parts)):
        some = [p for k, p in enumerate(parts) if mask >> k & 1]
        cov, ok = some[0][2], True
        for (s, t, n, _), (s2, t2, n2, _) in zip(some, some[1:]):
            cut = max(0, s + n - s2, t + n - t2)
            ok &= cut < n2 and s2 - s - n <= max_gap and t2 - t - n <= max_gap and some[0][0] < s2
            cov += n2 - cut
        best = max(best, cov if ok else 0)
    return best


@pytest.mark.parametrize("seed", range(60))
def test_chains_equal_all_subsets(seed):
    """Random matches with gaps and overlaps: the best chain covers as much as the best of all subsets in order."""
    rng = random.Random(seed)
    parts = sorted({(rng.randint(0, 40), rng.randint(0, 40), rng.randint(3, 9), True) for _ in range(rng.randint(1, 8))})
    assert max(c for c, *_ in SCANNER.chained(parts, 60)) == best_chain(parts, SCANNER.max_gap)


@pytest.mark.parametrize("seed", range(40))
def test_matches_equal_all_maximal_runs(seed):
    """For every template, all runs of three words or more that it shares with the text and that go on to neither side."""
    rng = random.Random(seed)
    seqs = [[rng.choice("abcd") for _ in range(rng.randint(3, 14))] for _ in range(rng.randint(1, 5))]
    scanner = LicenseScanner([(f"l{k}", " ".join(q)) for k, q in enumerate(seqs)], {"a b": "x"})
    known = [[w.decode() for w in t] for _, t in scanner.templates]
    text = [rng.choice("abcde") for _ in range(60)]
    into = {"base": [], "segments": []}
    scanner._walk([scanner.ids.get(w.encode(), 0) for w in text], 0, into)
    want = set()
    for k, q in enumerate(known):
        for i in range(len(text)):
            for j in range(len(q)):
                if text[i] == q[j] and not (i and j and text[i - 1] == q[j - 1]):
                    n = next((m for m in range(len(q)) if i + m == len(text) or j + m == len(q) or text[i + m] != q[j + m]), len(q) - j)
                    if n >= 3:
                        want.add((i, j, n, k))
    got = [x[:4] for x in into["segments"]]
    assert sorted(got) == sorted(want)
