"""Adaptive context-mixing range coder for token ids below 65,536.

Ids of a file are coded in blocks. For each id the model has two predictions, the id that followed
the last two ids before (order 2) and the one that followed the last id (order 1), found by hashed
contexts that are checked, each with a confidence; and an order-0 distribution of all ids. The three
are mixed into one distribution: weights for the predictions adapt by the pair of confidences and by
whether the predictions agree, and what is left goes to order 0. The range coder codes the share that
the id falls in, then for order 0 the id.

Order 0 is the file's: a table of the frequencies of its ids, stored once (``Prior``). Each block starts
from it with empty contexts and first weights, so with the table a block is decoded on its own.

Blocks are independent, so numpy works on many at once: block k is lane k of every array, and a
step codes or decodes the next id of all blocks. Arithmetic is on integers except for one quotient
that a double holds well enough to be corrected, so any machine gives the same bytes.

A frame: magic, number of ids, number of 16-bit words, CRC-32 of the ids as little-endian unsigned
32-bit integers, then the words. A table: magic, bits of the total, number of ids, CRC-32 of what
follows, then ids and frequencies, deflated.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

BLOCK = 4096
MAGIC, TABLE_MAGIC = b"TCM2", b"TCT2"
HEADER, TABLE_HEADER = struct.Struct("<4sIII"), struct.Struct("<4sIII")
#: Lanes at a time, at most: each holds some 50 KB, most of it its tables.
LANES = 1536
#: Ids that are counted at a time.
_COUNTED = 1 << 20

_T1, _T2 = 11, 12  # bits of the context tables' sizes
_I, _U = np.int64, np.uint32
#: Steps whose contexts and shares are computed together.
_AHEAD = 16
_HIGH = 32  # the span is at least 1 << _HIGH between ids, and at most 1 << (_HIGH + 16)
_NO = 1 << 18  # stands for no prediction


class CorruptBlock(ValueError):
    """A frame whose contents don't give the checksum in its header."""


class Prior:
    """Frequencies of ids that add up to 1 << bits, with their sums (``places``: sum of those before << 32, frequency) and the id of each place."""

    def __init__(self, ids: np.ndarray, frequencies: np.ndarray, bits: int):
        self.ids, self.frequencies, self.bits = ids, frequencies, bits
        ends = np.cumsum(frequencies)
        if len(ids) and (ends[-1] != 1 << bits or frequencies.min() < 1):
            raise CorruptBlock("frequencies don't add up")
        self.places = np.zeros(1 << 16, _I)
        self.places[ids] = ends - frequencies << 32 | frequencies
        self.place: np.ndarray | None = None

    @property
    def size(self) -> np.ndarray:
        return self.places & 0xFFFFFFFF

    def inverse(self) -> np.ndarray:
        if self.place is None:
            self.place = np.repeat(self.ids.astype(np.uint16), self.frequencies)
        return self.place

    @staticmethod
    def of(ids: np.ndarray) -> Prior:
        """From the ids themselves; each that occurs has a frequency of 1 at least."""
        counts = np.zeros(1 << 16, _I)
        for i in range(0, len(ids), _COUNTED):  # counting makes 64 bits of each id
            counts += np.bincount(ids[i : i + _COUNTED], minlength=1 << 16)
        some = np.flatnonzero(counts)
        bits = min(20, max(12, int(len(some)).bit_length() + 6))
        left = (1 << bits) - len(some)
        share = counts[some].astype(_I)
        whole = max(int(share.sum()), 1)
        extra = share * left // whole
        missing = left - int(extra.sum())  # fewer than there are ids
        extra[np.argsort(-share, kind="stable")[:missing]] += 1
        return Prior(some, extra + 1, bits)

    def packed(self) -> bytes:
        body = zlib.compress(np.diff(self.ids, prepend=0).astype("<u2").tobytes() + self.frequencies.astype("<u4").tobytes(), 9)
        return TABLE_HEADER.pack(TABLE_MAGIC, self.bits, len(self.ids), zlib.crc32(body)) + body

    @staticmethod
    def unpacked(data: bytes) -> Prior:
        if len(data) < TABLE_HEADER.size:
            raise CorruptBlock("the table is cut off")
        magic, bits, n, crc = TABLE_HEADER.unpack_from(data)
        body = data[TABLE_HEADER.size :]
        if magic != TABLE_MAGIC or zlib.crc32(body) != crc or bits > 20:
            raise CorruptBlock("the table doesn't match its checksum")
        plain = zlib.decompress(body)
        return Prior(np.cumsum(np.frombuffer(plain, "<u2", n).astype(_I)), np.frombuffer(plain, "<u4", n, 2 * n).astype(_I), bits)


class _Model:
    """State of all lanes. ``predict`` sets the mixture; ``learn`` takes the ids of the lanes.

    Row 0 of the stacked arrays is order 1, row 1 is order 2. A cell of a table holds check of the context << 18,
    prediction << 2 and confidence: 0 for a context not seen, 1 for a new one, up to 3. A lane's chances are pairs, that of order 2 << 16 and that of order 1.
    """

    def __init__(self, lanes: int):
        lane = np.arange(lanes, dtype=_I)
        self.table = np.zeros((lanes << _T1) + (lanes << _T2), np.int32)
        self.base = np.stack([lane << _T1, (lanes << _T1) + (lane << _T2)])
        # of 65536: chance that order 2 is right, and that order 1 is where order 2 is wrong; by agreement and both confidences
        first = np.array([64, 8000, 24000, 44000] * 8, np.uint32) << _U(16) | np.repeat(np.array([64, 4000, 12000, 24000] * 2, np.uint32), 4)
        self.chance = np.tile(first, lanes)
        self.cell = lane << 5
        self.at, self.check = self.base.copy(), np.zeros((2, lanes), np.int32)
        self.old = np.zeros(lanes, np.uint32)

    def narrow(self, n: int) -> None:
        """From here on only the first n lanes are at work."""
        self.base, self.cell, self.at, self.check, self.old = (np.ascontiguousarray(x[..., :n]) for x in (self.base, self.cell, self.at, self.check, self.old))

    def predict(self, at: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Predictions p (_NO >> 2: none) of the contexts, whether they are the same, and the chances x."""
        # masks are numbers, all bits or none: masked operations cost several plain ones
        self.cells = cells = self.table.take(at, mode="clip")
        self.p = p = cells ^ check
        np.minimum(p, _NO, out=p)  # the check's bits are left where the context isn't the cell's
        self.c = c = p & 3
        p >>= 2
        self.same = (p[0] == p[1]).astype(np.int32)
        context = self.same << 2
        context += c[0]
        context <<= 2
        context += c[1]
        self.ctx = ctx = context.astype(_I)
        ctx += self.cell
        pair = self.chance.take(ctx, mode="clip")
        self.x = x = np.empty(p.shape, np.int32)
        np.bitwise_and(pair, _U(0xFFFF), out=x[0].view(_U))
        np.right_shift(pair, _U(16), out=x[1].view(_U))
        return x

    def learn(self, at: np.ndarray, check: np.ndarray, ids: np.ndarray, right: np.ndarray, hits: np.ndarray) -> None:
        """ids: as int32. right: rows of 1 where the predictions are the ids, else 0; hits: masks of the same, but of order 1
        only where order 2 was wrong. Chances stay within 64 and 60000."""
        moved = hits & 59967
        moved += 64
        moved -= self.x
        moved >>= 5
        moved[0] &= ~hits[1]  # order 1 wasn't asked
        moved += self.x
        pair = moved[1] << 16
        pair |= moved[0]
        self.chance[self.ctx] = pair.view(_U)
        # one more up to 3 if right, else one less: a cell without confidence is the new context's from now on
        move = right << 1
        move -= 1
        np.minimum(3 - self.c, move, out=move)
        self.c += move
        stays = np.negative(self.c, out=self.c)
        stays >>= 31
        move += self.cells
        ids = ids << 2
        ids += 1
        cells = check + ids
        move ^= cells
        move &= stays
        cells ^= move
        self.table[at] = cells

    def contexts(self, ids: np.ndarray, old: np.ndarray, at: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Sets cells and checks of the contexts after ids; ``old`` is of the ids before, that of these is returned. All may have rows of steps."""
        one = ids.view(_U) * _U(0x9E3779B1)
        kept = one >> _U(3)
        kept += _U(1)
        if one.ndim > 1:
            old = np.concatenate([old[None], kept[:-1]])
        two = one ^ old
        two *= _U(0x85EBCA6B)
        at[..., 0, :] = one >> _U(32 - _T1)
        at[..., 1, :] = two >> _U(32 - _T2)
        at += self.base
        check = check.view(_U)
        np.left_shift(one, _U(7), out=check[..., 0, :])
        np.left_shift(two, _U(8), out=check[..., 1, :])
        check &= _U(0x3FF << 18)
        return kept if one.ndim == 1 else kept[-1].copy()


def _shares(x: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cumulated shares a (order 2) and b (order 2 and 1) of 65536, from chances in rows."""
    x2 = x[..., 1, :]
    a = 65536 - x2
    a *= x[..., 0, :] >> 1
    a >>= 15
    b = a + x2
    a *= same
    a += x2
    return a.astype(_I), b.astype(_I)


def _cut(a: np.ndarray, b: np.ndarray, full: int | np.ndarray, some: np.ndarray, two: np.ndarray) -> None:
    """Makes of a and b the start and the end: 0 and a where order 2 is right, a and b where order 1 is, else b and full."""
    d = a ^ b
    np.bitwise_and(d, some, out=a)
    a ^= b
    a &= ~two
    b ^= full
    b &= some
    b ^= full
    d &= two
    b ^= d


def _spans(sizes: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Ranges of up to _AHEAD steps, and the lanes still at work in them; sizes fall."""
    begin = 0
    for size in np.unique(sizes).tolist():
        n = int(np.searchsorted(-sizes, -size, "right"))
        for t in range(begin, size, _AHEAD):
            yield t, min(t + _AHEAD, size), n
        begin = size


def _encode(blocks: list[np.ndarray], prior: Prior) -> list[np.ndarray]:
    """The 16-bit words of each block; no block is empty."""
    sizes = np.array([len(b) for b in blocks], _I)
    order = np.argsort(-sizes, kind="stable")
    sizes, lanes = sizes[order], len(blocks)
    steps = np.zeros((lanes, int(sizes[0])), np.uint16)
    for k, i in enumerate(order.tolist()):
        steps[k, : sizes[k]] = blocks[i]
    # words with their carries, room for those of most blocks
    width = steps.shape[1] * 5 // 8 + 8
    out = np.zeros((lanes, width), np.uint32)
    filled = np.zeros(lanes, _I)
    low, span = np.zeros(lanes, _I), np.full(lanes, 1 << _HIGH + 16, _I)
    model = _Model(lanes)

    def put(words: list[np.ndarray], due: list[np.ndarray]) -> None:
        """Write out the words that are due, of rows of lanes."""
        nonlocal out
        some = np.array(due).T
        counts = some.sum(axis=1)
        n, have = len(counts), out.shape[1]
        if (more := int((filled[:n] + counts).max()) - have) > 0:
            out = np.pad(out, ((0, 0), (0, max(more, have))))
        places = np.repeat(np.arange(n) * out.shape[1] + filled[:n] - (np.cumsum(counts) - counts), counts)
        places += np.arange(len(places))
        out.reshape(-1)[places] = np.array(words, np.uint32).T[some]
        filled[:n] += counts

    most = lanes
    for begin, end, n in _spans(sizes):
        if n < most:
            model.narrow(n)
            most = n
        ids = steps[:n, begin:end].T.astype(np.int32, order="C")
        places = prior.places.take(ids)
        # what the contexts are is known before
        at, check = np.empty((len(ids) + 1, 2, n), _I), np.empty((len(ids) + 1, 2, n), np.int32)
        at[0], check[0] = model.at, model.check
        model.old = model.contexts(ids, model.old, at[1:], check[1:])
        model.at, model.check = at[-1].copy(), check[-1].copy()
        x, same, hits = np.empty((len(ids), 2, n), np.int32), np.empty((len(ids), n), np.int32), np.empty((len(ids), 2, n), np.int32)
        for t in range(len(ids)):
            x[t] = model.predict(at[t], check[t])
            same[t] = model.same
            right = (model.p == ids[t]).astype(np.int32)
            np.negative(right, out=hits[t])
            hits[t, 0] &= ~hits[t, 1]
            model.learn(at[t], check[t], ids[t], right, hits[t])
        start, share, two, some = *_shares(x, same), hits[:, 1].astype(_I), (hits[:, 0] | hits[:, 1]).astype(_I)
        _cut(start, share, 1 << 16, some, two)
        share -= start
        # order 0 for those that neither predicted
        np.invert(some, out=some)
        less = some & prior.bits
        first = places >> 32
        first &= some
        part = places
        part &= 0xFFFFFFFF
        part -= 1
        part &= some
        part += 1
        value, size = low[:n], span[:n]
        words, due = [], []
        for t in range(len(ids)):
            size >>= 16
            value += size * start[t]
            size *= share[t]
            size >>= less[t]
            value += size * first[t]
            size *= part[t]
            # a word from each lane that has one, then from those that have another
            while True:
                due.append(size < 1 << _HIGH)
                words.append((value >> _HIGH).astype(np.uint32))
                mask = due[-1].astype(_I)
                np.negative(mask, out=mask)
                rest = value & (1 << _HIGH) - 1
                rest <<= 16
                rest ^= value
                rest &= mask
                value ^= rest
                mask &= 16
                size <<= mask
                if size.min() >= 1 << _HIGH:
                    break
        put(words, due)
    put([(low >> k & 0xFFFF) + (low >> _HIGH + 16 << 16) * (k == _HIGH) for k in (_HIGH, 16, 0)], [np.ones(lanes, bool)] * 3)
    del model
    done = [np.zeros(0, np.uint16)] * lanes
    for k, i in enumerate(order.tolist()):
        words = out[k, : filled[k]]
        while (carry := words[1:] >> 16).any():  # into the word before
            words &= _U(0xFFFF)
            words[:-1] += carry
        done[i] = words.astype(np.uint16)
    return done


def _decode(words: list[np.ndarray], lengths: list[int], prior: Prior) -> list[np.ndarray]:
    sizes = np.array(lengths, _I)
    order = np.argsort(-sizes, kind="stable")
    sizes, lanes = sizes[order], len(words)
    # a damaged block may ask for more words than there are: it reads zeros
    given = np.array([len(words[i]) for i in order], _I)
    starts = np.concatenate([[0], np.cumsum(given + 4)])
    source = np.zeros(int(starts[-1]), np.uint16)
    for k, i in enumerate(order.tolist()):
        source[starts[k] : starts[k] + given[k]] = words[i]
    at, stop = starts[:-1].copy(), starts[1:] - 1
    value = source[at].astype(_I) << 32 | source[at + 1].astype(_I) << 16 | source[at + 2]
    at += 3
    span = np.full(lanes, 1 << _HIGH + 16, _I)
    model, inverse = _Model(lanes), prior.inverse()
    last = len(inverse) - 1
    out = np.zeros((int(sizes[0]), lanes), np.uint16)
    most = lanes
    for begin, end, n in _spans(sizes):
        if n < most:
            model.narrow(n)
            most = n
        left, size, here, there = value[:n], span[:n], at[:n], stop[:n]
        hits = np.empty((2, n), np.int32)
        for t in range(begin, end):
            a, b = _shares(model.predict(model.at, model.check), model.same)
            size >>= 16
            a *= size
            b *= size
            size <<= 16
            some, two = left - b, left - a
            some >>= 63
            two >>= 63
            hits[0], hits[1] = some, two
            _cut(a, b, size, some, two)
            hits[0] ^= hits[1]
            left -= a
            b -= a
            # order 0 for those that neither predicted; a quotient of doubles is at most one too high
            none = np.invert(some, out=some)
            r = b >> prior.bits
            np.maximum(r, 1, out=r)
            place = (left / r).astype(_I)
            place -= (place * r > left).astype(_I)
            place &= none
            found = inverse.take(np.minimum(place, last, out=place), mode="clip").astype(_I)
            places = prior.places.take(found, mode="clip")
            first = places >> 32
            first &= none
            first *= r
            left -= first
            places &= 0xFFFFFFFF
            places *= r
            places ^= b
            places &= none
            np.bitwise_xor(places, b, out=size)
            found &= none
            ids = found.astype(np.int32)
            ids |= model.p[0] & hits[0]
            ids |= model.p[1] & hits[1]
            ids &= 0xFFFF
            out[t, :n] = ids
            model.learn(model.at, model.check, ids, (model.p == ids).astype(np.int32), hits)
            model.old = model.contexts(ids, model.old, model.at, model.check)
            mask = size - (1 << _HIGH)
            mask >>= 63
            more = left & (1 << _HIGH) - 1
            more <<= 16
            more |= source.take(here, mode="clip").astype(_I)
            more ^= left
            more &= mask
            left ^= more
            here -= mask
            np.minimum(here, there, out=here)
            mask &= 16
            size <<= mask
            if size.min() < 1 << _HIGH:
                short = np.flatnonzero(size < 1 << _HIGH)
                while len(short):
                    words_at = np.minimum(at.take(short), stop.take(short))
                    value[short] = (value.take(short) & (1 << _HIGH) - 1) << 16 | source.take(words_at)
                    at[short] = words_at + 1
                    again = np.maximum(span.take(short), 1) << 16
                    span[short] = again
                    short = short[again < 1 << _HIGH]
    del model
    done = [np.zeros(0, np.uint16)] * lanes
    columns = np.ascontiguousarray(out.T)
    for k, i in enumerate(order.tolist()):
        done[i] = columns[k, : sizes[k]]
    return done


def _groups(n: int) -> list[tuple[int, int]]:
    """Ranges of n blocks that are worked on together: as few as LANES allows, of like length."""
    k = -(-n // LANES)
    return [(n * i // k, n * (i + 1) // k) for i in range(k)]


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def compress(ids: np.ndarray, block: int = BLOCK) -> tuple[bytes, list[bytes]]:
    """The table of the ids, and frames of blocks of ``block`` of them."""
    if len(ids) and (int(ids.min()) < 0 or int(ids.max()) > 0xFFFF):
        raise ValueError("ids must be from 0 to 65535")
    prior = Prior.of(ids)
    parts = [ids[i : i + block].astype(np.uint16, copy=False) for i in range(0, len(ids), block)]
    frames = []
    for i, j in _groups(len(parts)):
        group = parts[i:j]
        for part, words in zip(group, _encode(group, prior), strict=True):
            frames.append(HEADER.pack(MAGIC, len(part), len(words), checksum(part)) + words.astype("<u2").tobytes())
    return prior.packed(), frames


def decompress(table: bytes, data: bytes) -> np.ndarray:
    """The ids of frames that follow one another. CorruptBlock if the table, a header or a checksum doesn't hold."""
    prior = Prior.unpacked(table)
    sizes, sums, words, at = [], [], [], 0
    while at < len(data):
        if at + HEADER.size > len(data):
            raise CorruptBlock(f"a header is cut off at byte {at}")
        magic, n, n_words, crc = HEADER.unpack_from(data, at)
        at += HEADER.size
        if magic != MAGIC or not n or at + 2 * n_words > len(data) or not len(prior.ids):
            raise CorruptBlock(f"no valid header before byte {at}")
        sizes.append(n)
        sums.append(crc)
        words.append(np.frombuffer(data, "<u2", n_words, at))
        at += 2 * n_words
    out = []
    for i, j in _groups(len(sizes)):
        for k, ids in enumerate(_decode(words[i:j], sizes[i:j], prior), i):
            if checksum(ids) != sums[k]:
                raise CorruptBlock(f"block {k} doesn't match its checksum")
            out.append(ids)
    return np.concatenate(out) if out else np.zeros(0, np.uint16)
