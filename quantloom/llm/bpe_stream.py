"""BPE encoding as a bounded-lookahead streaming transducer, and incremental decoding.

A merge list fixes how far to the left one more symbol at the right end of a string can change its tokens. A merge
``(a, b)`` that newly happens, or no longer does, touches the symbol ``a``; left of it, only a merge of lower priority
(a higher rank) whose right part begins with ``a`` can change in turn, and it reaches left by its own left part. So the
longest such chain of rising ranks, weighted with the bytes of the left parts, bounds the influence: the *sufficient
lookahead*. The transducer keeps a window a little longer than that, emits tokens that end before the lookahead and drops
what it has emitted; by the definition of BPE the rest is tokenized as if it stood alone. Every piece of every text goes
through it; a memo of bounded size remembers what it gave for short pieces.

A text is read in blocks that end at white space, where no token can reach across; a run without white space that is longer
than a block is normalised, cut into pieces and merged while it is read. So what is held besides the text doesn't grow with
it. Decoding takes ids in portions of any size through a state machine: bytes of tokens come out at once, and a character
whose bytes aren't all there is held back.

``WordBpe`` does this for a vocabulary with word ends (lower case, white space dropped). Defined results: a null, empty or
blank text has no tokens and decodes to the empty string; texts of any length are encoded whole; repeated rows give repeated
results; null ids stay null; an empty table gives an empty result; columns besides id and text are ignored, whatever their
names.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import kept, map_texts, text_rows

#: Entries of a generation of a memo; two generations are kept.
MEMO = 100_000
#: Longer pieces are not remembered.
MEMO_CHARS = 40
#: Characters of a block of text, and ids of a portion of a long run.
BLOCK, PORTION = 1 << 16, 1 << 13

_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: What goes on with a piece that touches the end of what has been read; pieces of other kinds are complete.
_LETTERS, _MARKS = regex.compile(r"\p{L}+"), regex.compile(r"[^\s\p{L}\p{N}]+")
_CONTRACTION = 3
_SPACES = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
_LAST_SPACE, _NEXT_SPACE = regex.compile(r"(?r)[\t-\r \x85\xa0  -     　]"), regex.compile(r"[\t-\r \x85\xa0  -     　]")
#: Characters that never compose with one before them, so a text may be normalised in parts that begin with one.
_SAFE = regex.compile(r"[!-~\p{Ll}\p{Lu}\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3]")
#: White space for str.split, but not for the vocabulary.
_ODD = regex.compile(r"[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies (a fixed format)."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class MergeList:
    """Merges by rank over symbols given as strings; ``sizes`` are their lengths in input symbols."""

    def __init__(self, merges: list[tuple[str, str]], size=len):
        self.rank = {m: i for i, m in enumerate(merges)}
        self.size = size
        self.lookahead = self._lookahead(merges)

    def _lookahead(self, merges: list[tuple[str, str]]) -> int:
        left_of = {a + b: a for a, b in reversed(merges)}
        reach: dict[str, int] = {}  # of a change of a symbol, by merges ranked later than the one at hand
        most = 0
        for a, b in reversed(merges):
            here = self.size(a) + reach.get(a, 0)
            most = max(most, here)
            at = b
            while at is not None:
                reach[at] = max(reach.get(at, 0), here)
                at = left_of.get(at)
        return most + max((self.size(a + b) for a, b in merges), default=1)

    def merge(self, symbols: list[str]) -> list[str]:
        """All merges applied, lowest rank first and leftmost of equals first."""
        if len(symbols) > 48:
            return self._merge_long(symbols)
        none = 1 << 60
        get = self.rank.get
        ranks = [get(p, none) for p in zip(symbols, symbols[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            symbols[i] += symbols.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = get((symbols[i - 1], symbols[i]), none)
            if i < len(ranks):
                ranks[i] = get((symbols[i], symbols[i + 1]), none)
        return symbols

    def _merge_long(self, symbols: list[str]) -> list[str]:
        """The same with a heap and a linked list: n log n."""
        rank, n = self.rank, len(symbols)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(rank[p], i, p) for i, p in enumerate(zip(symbols, symbols[1:])) if p in rank]
        heapq.heapify(heap)
        alive = list(symbols)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = after[i] if alive[i] is not None else -1
            if alive[i] != p[0] or j < 0 or alive[j] != p[1]:
                continue
            alive[i], alive[j] = p[0] + p[1], None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (alive[x], alive[y]) in rank:
                    heapq.heappush(heap, (rank[alive[x], alive[y]], x, (alive[x], alive[y])))
        return [x for x in alive if x is not None]

    def stream(self, symbols: Iterable[str], window: int | None = None) -> Iterator[str]:
        """Tokens of a stream of symbols, emitted once no further symbol can change them."""
        window = 2 * self.lookahead if window is None else max(window, self.lookahead + 1)
        held: list[str] = []
        for s in symbols:
            held.append(s)
            if len(held) >= window + self.lookahead:
                done = 0
                for token in self.merge(list(held)):
                    done += self.size(token)
                    if done > len(held) - self.lookahead:
                        done -= self.size(token)
                        break
                    yield token
                held = held[done:]
        yield from self.merge(held)


class Memo:
    """A map of bounded size: when the young generation is full it becomes the old one, and what is used again is young again."""

    def __init__(self, most: int = MEMO):
        self.most, self.young, self.old = most, {}, {}

    def get(self, key: str):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: str, value) -> None:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value


class WordBpe:
    """Encoder and decoder of a vocabulary file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.token_bytes = {i: t.encode() for i, t in self.tokens.items()}
        self.symbol = byte_symbols()
        size = lambda t: len(t) - len(self.end) * (t.endswith(self.end) and len(t) > len(self.end))
        self.merges = MergeList([tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], size)
        self._special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self._memo, self._words = Memo(), Memo()

    def _symbols(self, parts: Iterable[str]) -> Iterator[str]:
        """Symbols of a piece that comes in parts; the last one carries the word's end."""
        last = None
        for part in parts:
            for byte in part.encode():
                if last is not None:
                    yield last
                last = self.symbol[byte]
        if last is not None:
            yield last + self.end

    def _ids(self, parts: Iterable[str]) -> Iterator[int]:
        """Ids of a piece through the transducer; symbols that the vocabulary lacks are left out."""
        return (i for t in self.merges.stream(self._symbols(parts)) if (i := self.vocab.get(t)) is not None)

    def _piece(self, piece: str) -> bytes:
        """Little-endian ids of a piece."""
        found = self._words.get(piece)
        if found is None:
            found = array("I", self._ids((piece,))).tobytes()
            if len(piece) <= MEMO_CHARS:
                self._words.put(piece, found)
        return found

    def _pieces(self, chunk: str) -> list[bytes]:
        """Pieces of text without special tokens."""
        chunk = _normal(chunk)
        return [self._piece(chunk)] if chunk.isalpha() else [self._piece(p) for p in _PIECES.findall(chunk)]

    def _encode_chunk(self, chunk: str) -> bytes:
        found: list[bytes] = []
        at = 0
        for m in self._special.finditer(chunk) if self._special and "<" in chunk else ():
            found += self._pieces(chunk[at : m.start()])
            found.append(array("I", [self.special[m.group()]]).tobytes())
            at = m.end()
        return b"".join(found + self._pieces(chunk[at:] if at else chunk))

    def _encode_block(self, block: str) -> bytes:
        """Parts between white space are looked up or encoded: no token has any white space."""
        memo, found = self._memo, []
        for c in [x for x in _SPACES.split(block) if x] if _ODD.search(block) else block.split():
            x = memo.young.get(c)
            if x is None:
                x = memo.get(c)
                if x is None:
                    x = self._encode_chunk(c)
                    if len(c) <= MEMO_CHARS:
                        memo.put(c, x)
            found.append(x)
        return b"".join(found)

    def _encode_run(self, text: str, at: int, end: int) -> Iterator[bytes]:
        """A long run without white space, in portions of ids."""
        for m in self._special.finditer(text, at, end) if self._special else ():
            yield from self._encode_plain(text, at, m.start())
            yield array("I", [self.special[m.group()]]).tobytes()
            at = m.end()
        yield from self._encode_plain(text, at, end)

    def _encode_plain(self, text: str, at: int, end: int) -> Iterator[bytes]:
        ids = chain.from_iterable(map(self._ids, _Run(text, at, end).pieces()))
        while part := array("I", islice(ids, PORTION)):
            yield part.tobytes()

    def stream(self, text: str, block: int = BLOCK) -> Iterator[bytes]:
        """Little-endian 32-bit ids of the text, block by block."""
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > block:
                space = _LAST_SPACE.search(text, at + 1, at + block)
                if space is None:
                    space = _NEXT_SPACE.search(text, at + block)
                    end = space.start() if space else end
                    yield from self._encode_run(text, at, end)
                    at = end
                    continue
                end = space.start()
            yield self._encode_block(text[at:end])
            at = end

    def encode(self, text: str) -> bytes:
        return b"".join(self.stream(text))

    def decode(self, ids: Iterable[int]) -> str:
        """Token strings joined by blanks, special tokens included; unknown ids are left out."""
        machine = Decoder(self)
        return machine.feed(array("I", ids).tobytes()).decode()

    def text(self, ids: Iterable[int]) -> Iterator[str]:
        """Readable text, piece by piece: bytes go through a state machine that holds an unfinished character back."""
        byte_of = {s: b for b, s in enumerate(self.symbol)}
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            token = self.tokens.get(i, "")
            if token in self.special:
                yield machine.decode(b"", final=True) + token
                machine.reset()
                continue
            ended = token.endswith(self.end)
            yield machine.decode(bytes(byte_of[c] for c in token.removesuffix(self.end)))
            if ended:
                yield " "
        yield machine.decode(b"", final=True)


def _normal(text: str) -> str:
    """NFC and lower case, character by character: a capital sigma has one form, wherever it stands."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class _Run:
    """Pieces of ``text[at:end]``, which has no white space, read in segments; each piece comes as an iterator of its parts."""

    def __init__(self, text: str, at: int, end: int, segment: int = BLOCK):
        self.text, self.at, self.end, self.segment = text, at, end, segment
        self.held, self.pos = "", 0

    def _more(self) -> bool:
        if self.at >= self.end:
            return False
        safe = _SAFE.search(self.text, min(self.at + self.segment, self.end), self.end)
        cut = safe.start() if safe else self.end
        self.held, self.pos = self.held[self.pos :] + _normal(self.text[self.at : cut]), 0
        self.at = cut
        return True

    def pieces(self) -> Iterator[Iterator[str]]:
        while True:
            while len(self.held) - self.pos < _CONTRACTION and self._more():
                pass
            if self.pos >= len(self.held):
                return
            piece = _PIECES.match(self.held, self.pos)
            if piece is None:  # white space that only the vocabulary's pattern takes for it
                self.pos += 1
                continue
            yield self._parts(piece)

    def _parts(self, piece) -> Iterator[str]:
        self.pos = piece.end()
        yield piece.group()
        for kind in (_LETTERS, _MARKS):
            if kind.fullmatch(piece.group()):
                while self.pos == len(self.held) and self._more() and (more := kind.match(self.held, self.pos)):
                    self.pos = more.end()
                    yield more.group()


class Decoder:
    """The state machine of ``WordBpe.decode``: ids in, bytes of the text out, in portions of any size."""

    def __init__(self, bpe: WordBpe):
        self.bytes, self.begun = bpe.token_bytes, False

    def feed(self, ids: bytes) -> bytes:
        """UTF-8 bytes of the text that the ids (little-endian, 32 bits) add."""
        known = self.bytes.get
        parts = [x for x in map(known, np.frombuffer(ids, "<u4").tolist()) if x is not None]
        if not parts:
            return b""
        out = b" ".join(parts)
        if self.begun:
            return b" " + out
        self.begun = True
        return out


SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"


def loaded(path: str) -> WordBpe:
    """One encoder per Python worker, so its memo outlives a task."""
    return kept(("words", path), lambda: WordBpe(path))


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: number of tokens, ids as little-endian 32-bit integers, and the text decoded from them."""

    def run(ids, texts, bpe):
        found = [bpe.encode(t.decode("utf-8", "replace")) for t in texts]
        return {"doc_id": ids, "n_tokens": [len(x) // 4 for x in found], "ids": found, "decoded": [Decoder(bpe).feed(x).decode() for x in found]}

    return map_texts(text_rows(df, id_col, text_col), run, SCHEMA, lambda: loaded(path))


def digest(bpe: WordBpe, text: str) -> tuple[int, str, str]:
    """Number of tokens and SHA-256 of ids and of the text decoded from them, portion by portion."""
    ids, decoded, machine, n = hashlib.sha256(), hashlib.sha256(), Decoder(bpe), 0
    for part in bpe.stream(text):
        n += len(part) // 4
        ids.update(part)
        decoded.update(machine.feed(part))
    return n, ids.hexdigest(), decoded.hexdigest()


def digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: number of tokens and SHA-256 of ids and of the text decoded from them; nothing longer leaves the worker."""

    def run(ids, texts, bpe):
        n, a, b = zip(*(digest(bpe, t.decode("utf-8", "replace")) for t in texts))
        return {"doc_id": ids, "n_tokens": n, "ids_sha256": a, "decoded_sha256": b}

    return map_texts(text_rows(df, id_col, text_col), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda: loaded(path))
