"""Byte-level BPE by the tokenizers library, each distinct part of a text encoded once per worker."""

from __future__ import annotations

import gc
import os

import numpy as np

from .common import kept

#: Entries of a generation of a worker's memo of parts, and the bytes that a remembered part may have.
MEMO, MEMO_CHARS = 800_000, 32
#: Parts that the library gets in one string.
PARTS = 100

#: White space besides the blank and the line end: bytes, and how UTF-8 writes the others (a few other characters begin like them).
_OTHER_SPACE = b"\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
_WIDE_SPACE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
_TOUCHING = (b"  ", b" \n", b"\n ", b"\n\n")


def isolated(text: bytes) -> bool:
    """Whether all white space is single blanks and line ends between other characters."""
    return text[:1] not in b" \n" and text[-1:] not in b" \n" and not any(x in text for x in _TOUCHING) and len(text.translate(None, _OTHER_SPACE)) == len(text) and (text.isascii() or not any(x in text for x in _WIDE_SPACE))


class Memo(dict):
    """Ids by part, of bounded size in two generations. A part that is asked for and unknown stands for its number among those to encode."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old, self.todo = most, {}, []

    def __missing__(self, part: bytes):
        found = self.old.get(part)
        if found is None:
            found = len(self.todo)
            self.todo.append(part)
        self[part] = found
        return found

    def turn(self) -> None:
        """Makes the young generation the old one when it is full."""
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()


class PieceEncoder:
    """Ids of whole texts, equal to those of the library over the whole text.

    The byte-level pattern never joins characters across a blank or a line end that stands between two characters that are
    no white space: a blank begins the next piece, a line end is a piece of its own. So a text is cut before each of them,
    and the library encodes only the parts that aren't in the memo, many in one string: as no part has a blank or a line end
    but at its start, the tokens that begin with one tell where parts begin. Texts with any other white space, or with white
    space that touches white space or an end of the text, go to the library whole.

    With ``plain``, the literals of special tokens in a text are ordinary characters, so no text can hold a special id.
    """

    def __init__(self, path: str, plain: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the unit of parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = plain
        self.memo = Memo(MEMO)
        vocab = self.library.get_vocab()
        #: by id: whether the token begins with a blank or a line end, in the form that byte-level vocabularies give them
        self.begins = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.begins[i] = token[:1] in ("\u0120", "\u010a")

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _encode_parts(self, parts: list[bytes]) -> list[bytes]:
        """Of parts in the form of keys: all but those that begin with a line end stand for a blank and themselves; no other blank or line end is in them."""
        out: list[bytes] = []
        groups = [parts[lo : lo + PARTS] for lo in range(0, len(parts), PARTS)]
        joined = [(b" " + b" ".join(g)).replace(b" \n", b"\n").decode("utf-8", "replace") for g in groups]
        for some, ids in zip(groups, self._encode(joined)):
            cuts = np.append(np.flatnonzero(self.begins[ids]), len(ids)) * 4
            if len(cuts) != len(some) + 1:
                out += [x.tobytes() for x in self._encode([(p if p[:1] == b"\n" else b" " + p).decode("utf-8", "replace") for p in some])]
                continue
            data, cuts = ids.tobytes(), cuts.tolist()
            out += [data[s:e] for s, e in zip(cuts, cuts[1:])]
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each UTF-8 text."""
        on = gc.isenabled()
        gc.disable()  # many short lists and no cycles
        try:
            return self._encode_texts(texts)
        finally:
            if on:
                gc.enable()

    def _encode_texts(self, texts: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        split = {k: (b"\n" + t.replace(b"\n", b" \n")).split(b" ") for k, t in enumerate(texts) if t and isolated(t)}
        whole = [k for k, t in enumerate(texts) if t and k not in split]
        for k, ids in zip(whole, self._encode([texts[k].decode("utf-8", "replace") for k in whole])):
            out[k] = ids.tobytes()
        # Keys have no blank at their start; what begins with a line end keeps it. The line end before a text is dropped again.
        memo = self.memo
        memo.turn()
        found = {k: list(map(memo.__getitem__, parts)) for k, parts in split.items()}
        todo, memo.todo = memo.todo, []
        new = self._encode_parts(todo)
        memo.update(zip(todo, new))
        for k, ids in found.items():
            out[k] = b"".join([x if x.__class__ is bytes else new[x] for x in ids])[4:]
        for p in todo:
            if len(p) > MEMO_CHARS:
                del memo[p]
        return out


def loaded(path: str, plain: bool = False) -> PieceEncoder:
    """One encoder per Python worker, so its memo outlives a task."""
    return kept(("pieces", path, plain), lambda: PieceEncoder(path, plain))
