"""Rank-synchronous merging: byte pairs of many pre-tokens at once, as ragged numpy arrays."""

from __future__ import annotations

import json

import numpy as np

_SLOTS = 1 << 18
_SPREAD = np.int64(0x9E3779B97F4A7C15 - (1 << 64))


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others for letters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Merges:
    """The merges of a vocabulary file, looked up by pair in an open-addressed table.

    ``suffix`` is what the file writes at the end of a pre-token's last symbol,
    if it marks words' ends.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        vocabulary, merges = held["model"]["vocab"], held["model"]["merges"]
        suffix = held["model"].get("end_of_word_suffix") or ""
        self.special = [x["content"] for x in held.get("added_tokens", [])]
        letters = byte_letters()
        self.of_byte = np.array([vocabulary[letters[b]] for b in range(256)], np.int64)
        self.of_last = np.array([vocabulary[letters[b] + suffix] for b in range(256)], np.int64)
        self.size = max(vocabulary.values()) + 1
        self.none = len(merges)
        self.merged = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        self.keys, self.ranks = np.full(_SLOTS, -1, np.int64), np.full(_SLOTS, self.none, np.int64)
        pairs = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in merges], np.int64)
        for rank, (pair, slot) in enumerate(zip(pairs.tolist(), self._slot(pairs).tolist(), strict=True)):
            while self.keys[slot] >= 0:
                slot = (slot + 1) % _SLOTS
            self.keys[slot], self.ranks[slot] = pair, rank

    @staticmethod
    def _slot(pairs: np.ndarray) -> np.ndarray:
        return ((pairs * _SPREAD) >> np.int64(46)) & np.int64(_SLOTS - 1)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of neighbours, or ``none`` where the two don't merge."""
        wanted = left * self.size + right
        slot = self._slot(wanted)
        found = self.keys[slot]
        out = np.where(found == wanted, self.ranks[slot], self.none)
        open_ = np.flatnonzero((found != wanted) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % _SLOTS
            found = self.keys[slot[open_]]
            right_one = found == wanted[open_]
            out[open_[right_one]] = self.ranks[slot[open_[right_one]]]
            open_ = open_[~right_one & (found >= 0)]
        return out

    def merge(self, sequences: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that survive in each sequence, one sequence after the other, and their numbers.

        In every round each sequence merges all places of its own lowest-rank
        pair, from the left; sequences in which no pair merges are done.
        """
        return self.merge_bytes(np.frombuffer(b"".join(sequences), np.uint8), np.array([len(x) for x in sequences], np.int64))

    def merge_bytes(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``merge``, of sequences that follow each other in ``data``."""
        ends = np.cumsum(lengths)
        symbols, alive = self.of_byte[data], np.ones(len(data), bool)
        last = ends[lengths > 0] - 1
        symbols[last] = self.of_last[data[last]]
        at, now = np.arange(len(data)), symbols.copy()
        owner = np.repeat(np.arange(len(lengths)), lengths)
        rank = np.full(len(data), self.none, np.int64)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self.rank(now[inner], now[inner + 1])
        while len(now):
            begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, begin), np.diff(np.r_[begin, len(owner)]))
            active = least < self.none
            if not active.all():
                at, now, owner, rank, least = at[active], now[active], owner[active], rank[active], least[active]
                if not len(now):
                    break
            hit = np.flatnonzero(rank == least)
            run = np.r_[True, np.diff(hit) > 1]
            if not run.all():  # of places that overlap, as in three equal symbols, every second one
                hit = hit[(np.arange(len(hit)) - np.flatnonzero(run)[np.cumsum(run) - 1]) % 2 == 0]
            now[hit] = symbols[at[hit]] = self.merged[rank[hit]]
            alive[at[hit + 1]] = False
            stays = np.ones(len(now), bool)
            stays[hit + 1] = False
            moved = np.zeros(len(now), bool)
            moved[hit] = True
            moved[np.maximum(hit - 1, 0)] = True
            at, now, owner, rank, moved = at[stays], now[stays], owner[stays], rank[stays], moved[stays]
            changed = np.flatnonzero(moved)
            rank[changed] = self.none
            changed = changed[changed + 1 < len(now)]
            changed = changed[owner[changed] == owner[changed + 1]]
            rank[changed] = self.rank(now[changed], now[changed + 1])
        held = np.r_[0, np.cumsum(alive)]
        return symbols[alive], held[ends] - held[ends - lengths]
