"""Token ids of whole texts: pre-tokens found, hashed and merged as arrays."""

from __future__ import annotations

import os

import numpy as np

from . import spans
from .bpe import Merges

#: Units whose ids a worker keeps at most; then the half not met for longest goes.
KEPT_UNITS = 1_000_000
_SPACE, _LETTER, _DIGIT, _OTHER, _SPECIAL = range(5)


def _classes(special: bytes) -> np.ndarray:
    kind = np.full(256, _SPECIAL, np.uint8)
    for b in range(0x21, 0x7F):
        kind[b] = _LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _OTHER
    kind[list(spans.WORD_SEPARATORS)] = _SPACE
    kind[list(b"'" + special)] = _SPECIAL
    return kind


class Encoder:
    """Token ids as the library of a lower-casing vocabulary with word ends gives them.

    Pre-tokens are runs of letters, single digits and runs of other signs, and
    never span white space. Chunks between white space that hold only ASCII
    and the letters from U+00C0 to U+00FF are cut into pre-tokens here, whose
    pairs are merged in arrays; any other chunk (apostrophes, other letters,
    what may begin a special string) is encoded whole by the library. Either
    way ids are kept by a hash of the bytes.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.merges = Merges(path)
        self.kind = _classes(b"".join(x.encode()[:1] for x in self.merges.special))
        self.known, self.begin, self.count, self.used = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.now = np.zeros(0, np.uint32), 0

    def _units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lower-cased bytes; begin, end and text of every unit; and whether the library is to encode it, from the bytes as they were."""
        kind = self.kind[data]
        begin, end, text = spans.split(data, offsets)
        lower = data + ((data >= 0x41) & (data <= 0x5A)).astype(np.uint8) * np.uint8(0x20)
        lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, np.int64)
        after = data[lead + 1]
        letter = (after >= 0x80) & (after <= 0xBF) & (after != 0x97) & (after != 0xB7)
        kind[lead[letter]] = kind[lead[letter] + 1] = _LETTER
        lower[lead[letter & (after < 0x9F)] + 1] += np.uint8(0x20)
        held = np.r_[0, np.cumsum(kind == _SPECIAL)]
        whole = held[end] > held[begin]
        cut = np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)) + 1 if len(kind) else np.zeros(0, np.int64)
        cut = cut[(kind[cut] != _SPACE) & (kind[cut - 1] != _SPACE)]
        owner = np.searchsorted(begin, cut, side="right") - 1
        cut = cut[(owner >= 0) & (begin[owner] < cut) & (cut < end[owner]) & ~whole[owner]]
        first, last = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
        first[begin] = first[cut] = last[end] = last[cut] = True
        chunk = np.flatnonzero(first)
        owner = np.searchsorted(begin, chunk, side="right") - 1
        return lower, chunk, np.flatnonzero(last), text[owner], whole[owner]

    def _learn(self, hashes: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        begin = len(self.pool) + np.cumsum(count) - count
        order = np.argsort(hashes)
        at = np.searchsorted(self.known, hashes[order])
        self.pool = np.concatenate([self.pool, ids.astype(np.uint32)])
        self.known, self.begin, self.count = (np.insert(x, at, y[order]) for x, y in ((self.known, hashes), (self.begin, begin), (self.count, count)))
        self.used = np.insert(self.used, at, self.now)

    def _forget(self) -> None:
        stays = np.flatnonzero(self.used >= np.median(self.used))[-KEPT_UNITS:]
        at = ragged(self.begin[stays], self.count[stays])
        self.pool, self.known, self.count, self.used = self.pool[at], self.known[stays], self.count[stays], self.used[stays]
        self.begin = np.cumsum(self.count) - self.count

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids (uint32) of all texts, one after the other, and each text's number of ids."""
        texts = len(offsets) - 1
        lower, begin, end, text, whole = self._units(data, offsets)
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(texts, np.int64)
        if len(self.known) > KEPT_UNITS:
            self._forget()
        self.now += 1
        hashes = spans.hash_spans(lower, begin, end)
        special = np.flatnonzero(whole)
        hashes[special] = spans.mix(spans.hash_spans(data, begin[special], end[special]) + np.uint64(1))
        values, one, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, values)
        new = np.ones(len(values), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != values[inside]
        by_library = whole[one] & new
        plain = one[new & ~by_library]
        sizes = end[plain] - begin[plain]
        merged, counts = self.merges.merge_bytes(lower[ragged(begin[plain], sizes)], sizes)
        strings = [data[a:b].tobytes().decode() for a, b in zip(begin[one[by_library]].tolist(), end[one[by_library]].tolist(), strict=True)]
        found = [x.ids for x in self.library.encode_batch_fast(strings, add_special_tokens=False)] if strings else []
        ids = np.concatenate([merged, *(np.array(x, np.int64) for x in found)])
        self._learn(np.r_[hashes[plain], values[by_library]], ids, np.r_[counts, np.array([len(x) for x in found], np.int64)])
        at = np.searchsorted(self.known, values)
        self.used[at] = self.now
        size = self.count[at][inverse]
        return self.pool[ragged(self.begin[at][inverse], size)], np.bincount(text, size, minlength=texts).astype(np.int64)


def ragged(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each range, one range after the other."""
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
