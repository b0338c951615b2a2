"""Token ids of texts by a public tokenizer file, with each distinct piece tokenized once per task and cache.

The vocabulary splits a text at white space and then into letters, single digits and other signs, which are
merged on their own. Words of ASCII and of the letters from U+00C0 to U+00FF are cut where the kind of sign
changes, for a whole block of texts at once, and go to the library's merge model. Any other word, and one with an
apostrophe or ``<``, goes through the whole library. Both give the library's ids; the tests compare whole texts.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from skyqa.llm.words import SPACED, hash_ranges, text_blocks

#: Distinct pieces that a task remembers; then it forgets all and begins again.
CACHE_PIECES = 400_000

_LETTER, _DIGIT, _SIGN = 1, 2, 3
_KIND = np.full(256, _SIGN, np.uint8)
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[~SPACED] = 0
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Bytes whose word goes through the whole library: control signs, the apostrophe, the start of special tokens.
_ODD = np.zeros(256, bool)
_ODD[:32] = _ODD[127] = _ODD[ord("'")] = _ODD[ord("<")] = True
_ODD[~SPACED] = False


class Tokens:
    """Tokenizes Arrow text columns by the file at ``path``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self._signs = {b: chr(c) for b, c in _byte_signs().items()}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.begin = array("I"), array("q", [0])

    def _learn(self, h: int, piece: bytes, whole: bool) -> int:
        if whole:
            self.flat.extend(self.library.encode(piece.decode(), add_special_tokens=False).ids)
        else:
            text = piece.decode().lower()
            signs = text if piece.isascii() else text.encode().decode("latin-1").translate(self._signs)
            self.flat.extend([t.id for t in self.library.model.tokenize(signs)])
        self.begin.append(len(self.flat))
        at = self.known[h] = len(self.begin) - 2
        return at

    def blocks(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """``(first text, last text + 1, flat ids, ids per text)`` of consecutive texts; NULL counts as empty."""
        for at, to, data, offsets in text_blocks(texts):
            ids, sizes = self._block(data, offsets)
            yield at, to, ids, sizes

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > CACHE_PIECES:
            self._forget()
        raw, start, end, whole = _pieces(data, offsets)
        h = hash_ranges(_FOLD[raw], start, end)
        h[whole] = hash_ranges(raw, start[whole], end[whole]) ^ np.uint64(1)
        distinct, which = np.unique(h, return_inverse=True)
        one = np.empty(len(distinct), np.int64)
        one[which] = np.arange(len(h))
        known = self.known
        places = [known.get(k, -1) for k in distinct.tolist()]
        held = raw.tobytes()
        for i, place in enumerate(places):
            if place < 0:
                j = one[i]
                places[i] = self._learn(int(distinct[i]), held[start[j] : end[j]], bool(whole[j]))
        place = np.array(places, np.int64)
        begin, flat = np.frombuffer(self.begin, np.int64), np.frombuffer(self.flat, np.uint32)
        first, size = begin[place][which], (begin[place + 1] - begin[place])[which]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = flat[np.repeat(first - total[:-1], size) + np.arange(total[-1])]
        del begin, flat  # the arrays cannot grow while a view of them is held
        return ids, np.diff(total[np.searchsorted(start, offsets)])


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, start, end of every piece, and which pieces are words for the whole library."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return data, none, none, np.zeros(0, bool)
    kind = _KIND[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    odd = _ODD[data]
    high = data >= 128
    if high.any():
        lead = data == 0xC3
        tail = np.zeros(n, bool)
        tail[1:] = lead[:-1]
        odd |= high & ~lead & ~tail
        odd |= tail & ((data == 0x97) | (data == 0xB7))  # the signs for times and division
    change = edge.copy()
    change[1:n] |= kind[1:] != kind[:-1]
    change[:n] |= kind == _DIGIT
    change[1:n] |= kind[:-1] == _DIGIT
    change[n] = True
    whole_at = np.zeros(0, np.int64)
    if odd.any():
        space = kind == 0
        first = np.flatnonzero(~space & (np.concatenate([[True], space[:-1]]) | edge[:n]))
        last = np.flatnonzero(~space & (np.concatenate([space[1:], [True]]) | edge[1:])) + 1
        hit = np.unique(np.searchsorted(first, np.flatnonzero(odd), "right") - 1)
        whole_at = first[hit]
        step = np.zeros(n + 2, np.int32)
        step[whole_at + 1] += 1
        step[last[hit]] -= 1
        change &= np.cumsum(step[: n + 1]) <= 0
    cuts = np.flatnonzero(change)
    start, end = cuts[:-1], cuts[1:]
    keep = kind[start] != 0
    start, end = start[keep], end[keep]
    whole = np.zeros(len(start), bool)
    whole[np.searchsorted(start, whole_at)] = True
    return data, start, end, whole


def _byte_signs() -> dict[int, int]:
    """The byte alphabet of byte-level vocabularies: printable bytes stand for themselves, others follow 255."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {b: b for b in printable}
    return signs | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in signs)}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
