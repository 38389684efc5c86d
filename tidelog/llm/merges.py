"""Byte-pair merges of many words at once.

A word's symbols are a column of arrays, with the positions before and after each as links. A step merges in
every word the pair with the lowest rank, the leftmost of equal ones, which is the order of the tokenizers library.
"""

from __future__ import annotations

import numpy as np

#: Bytes of the longest word, words worked on at once.
LONGEST, TOGETHER = 64, 4096
_POS = 6  # bits of a position in a key of a merge: rank << _POS | position
_NONE = np.int32((1 << 31) - 1)
_NOTHING, _EMPTY = 0xFFFF, np.uint32(0xFFFFFFFF)  # the symbol beside the first and the last; a free slot
_FACTOR = np.uint32(0x9E3779B1)


class Merges:
    """Ids of words, given as bytes, under a model of ``vocab`` and ``merges`` whose letters stand for bytes.

    ``letters``: the letter of each byte that occurs. KeyError or ValueError if the model can't be worked on this way.
    """

    def __init__(self, model: dict, letters: dict[int, str]):
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        others = ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")
        if model["type"] != "BPE" or any(model[k] for k in others) or max(vocab.values()) >= _NOTHING:
            raise ValueError("another model")
        self.first, self.last = np.zeros(256, np.int32), np.zeros(256, np.int32)
        for byte, letter in letters.items():
            self.first[byte], self.last[byte] = vocab[letter], vocab[letter + end]
        ranks: dict[int, int] = {}
        made = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            ranks[vocab[left] << 16 | vocab[right]] = rank
            made.append(vocab[left + right])
        if len(made) >= 1 << 30 - _POS:
            raise ValueError("too many merges")
        self.made = np.array(made, np.int32)
        keys, values = np.array(list(ranks), np.uint32), np.array(list(ranks.values()), np.int32) << _POS
        bits = max(8, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint32(32 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, _EMPTY), np.full(1 << bits, _NONE)
        slot = (keys * _FACTOR >> self.shift).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):  # the first of those that want a free slot has it, the others go on to the next
            free = left[self.keys[slot[left]] == _EMPTY]
            _, which = np.unique(slot[free], return_index=True)
            mine = free[which]
            self.keys[slot[mine]], self.values[slot[mine]] = keys[mine], values[mine]
            left = np.setdiff1d(left, mine, assume_unique=True)
            slot[left] = slot[left] + 1 & self.mask

    def found(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank << _POS of each pair, _NONE where it isn't merged."""
        key = left << 16
        key |= right
        key = key.view(np.uint32)
        slot = (key * _FACTOR >> self.shift).astype(np.int64)
        have = self.keys.take(slot)
        out = self.values.take(slot)
        out[have != key] = _NONE
        left = np.flatnonzero((have != key) & (have != _EMPTY))
        slot = slot[left]
        while len(left):
            slot += 1
            slot &= self.mask
            have = self.keys.take(slot)
            hit = have == key[left]
            out[left[hit]] = self.values[slot[hit]]
            on = ~hit & (have != _EMPTY)
            left, slot = left[on], slot[on]
        return out

    def ids(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in turn as uint16, and how many each has; words have 1 to LONGEST bytes."""
        order = np.argsort(sizes, kind="stable")
        counts = np.zeros(len(sizes), np.int32)
        parts = []
        for i in range(0, len(order), TOGETHER):
            which = order[i : i + TOGETHER]
            found, counts[which] = self._merged(data, starts[which], sizes[which])
            parts.append(found)
        if not parts:
            return np.zeros(0, np.uint16), counts
        every, n = np.concatenate(parts), counts[order]
        at = np.zeros(len(order), np.int64)
        at[order] = np.cumsum(n) - n
        places = np.repeat(at - (np.cumsum(counts) - counts), counts)
        places += np.arange(len(places))
        return every[places], counts

    def _merged(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, rows = len(sizes), int(sizes[-1])
        row = np.arange(rows)[:, None]
        inside = row < sizes
        word = np.arange(n)
        at = starts + row
        np.minimum(at, len(data) - 1, out=at)
        letters = data.take(at)
        # beyond the rows: the ends of all words, what stands before them
        symbols = np.full((rows + 2, n), _NOTHING, np.int32)
        symbols[:rows] = np.where(inside, self.first.take(letters), -1)
        symbols[sizes - 1, word] = self.last.take(letters[sizes - 1, word])
        after, before = np.empty((rows + 2, n), np.int32), np.empty((rows + 2, n), np.int32)
        after[:rows], before[:rows] = row + 1, row - 1
        after[sizes - 1, word], before[0] = rows, rows + 1
        keys = np.full((rows + 2, n), _NONE, np.int32)
        both = np.flatnonzero(inside[1:])
        flat = symbols.reshape(-1)
        found = self.found(flat[both], flat[both + n])
        found += np.where(found == _NONE, 0, both // n).astype(np.int32)
        keys.reshape(-1)[both] = found
        least, after, before, keys = keys[:rows], after.reshape(-1), before.reshape(-1), keys.reshape(-1)
        while True:
            low = least.min(axis=0)
            word = np.flatnonzero(low != _NONE)
            if not len(word):
                break
            low = low.take(word)
            pos = low & (1 << _POS) - 1
            made = self.made.take(low >> _POS)
            here = pos * n + word
            there = after.take(here) * n + word
            beyond, ahead = after.take(there), before.take(here)
            flat[here], flat[there], keys[there], after[here] = made, -1, _NONE, beyond
            end, start = beyond * n + word, ahead * n + word
            before[end] = pos
            found = self.found(np.concatenate([made, flat.take(start)]), np.concatenate([flat.take(end), made]))
            some = found != _NONE
            found += np.concatenate([pos, ahead]) * some
            keys[here], keys[start] = found[: len(word)], found[len(word) :]
        left = np.ascontiguousarray(symbols[:rows].T)
        some = left >= 0
        return left[some].astype(np.uint16), some.sum(axis=1)
