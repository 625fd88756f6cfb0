"""Adaptive context-mixing range coder for token ids; many blocks advance together, one numpy lane each.

Three predictions name one id each: without context (the block's leading id by majority vote), after the last id, after the
last two ids (the ids that last stood there). Which of them were right at the last two tokens, whether the longest context is
known and whether it agrees with the shorter one choose a cell of a table that holds the masses of the three; a cell's masses
move towards the prediction that was right. The mixture is

    P(id) = sum over orders of mass(order) * [id is the order's] + rest * Base(id)

where Base is the id histogram of the record (sent with it, as one byte an id) and every id keeps a share of it. An id that
several orders name is coded with the longest. The mixture's intervals drive a range coder with 48-bit state and 16-bit
digits; carries are settled at a block's end.

A block starts from the same state whatever stands before it, so any block can be decoded alone with its record's histogram.
Encoder and decoder use integers only.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOTAL_BITS, BASE_BITS, CELL_BITS = 26, 20, 9
TOTAL, BASE = 1 << TOTAL_BITS, 1 << BASE_BITS
MOST_IDS = BASE // 4
LOW, STATE = 1 << 32, 1 << 48
LANES = 8192
#: Masses are 20-bit fields of one number, in units of TOTAL / 2**20; together they stay below 31/32 or little more.
FIELD, UNIT = 21, 6
MASK = (1 << 20) - 1
RATE = 5
PREDICTED = (MASK + 1) * 31 // 32
FADE = sum(((MASK >> RATE) << FIELD * m) for m in range(3))
#: What a field gains when it is right: by interval (order 2, order 1, order 0, none of them).
GAIN = np.array([(PREDICTED >> RATE) << 2 * FIELD, (PREDICTED >> RATE) << FIELD, PREDICTED >> RATE, 0], np.int64)
START = sum((MASK + 1) // 32 << FIELD * m for m in range(3))
STATES = 64
#: One-byte frequencies: 0 to 7, then steps of an eighth of a power of two.
SIZES = np.array([*range(8), *[(8 + m) << e for e in range(24) for m in range(8)]], np.int64)


def histogram(ids: np.ndarray) -> bytes:
    """One byte for each id up to the largest: its frequency, rounded down to SIZES but never to 0."""
    counts = np.bincount(ids) if len(ids) else np.zeros(1, np.int64)
    if len(counts) > MOST_IDS:
        raise ValueError(f"ids must be below {MOST_IDS}")
    return (np.searchsorted(SIZES, np.minimum(counts, SIZES[-1]), side="right") - 1).astype(np.uint8).tobytes()


def base_of(table: bytes) -> np.ndarray:
    """Running sums of Base over ids, from 0 to BASE; each id has one unit at least."""
    sizes = SIZES[np.frombuffer(table, np.uint8)]
    upto = np.concatenate(([0], np.cumsum(sizes)))
    return np.arange(len(upto)) + upto * (BASE - len(sizes)) // max(1, int(upto[-1])) if upto[-1] else np.linspace(0, BASE, len(upto)).astype(np.int64)


class Mixer:
    """The predictions' state for all lanes; each step names the lanes that still run. Cells hold id + 1, 0 is unknown."""

    def __init__(self, lanes: int):
        self.lead, self.votes = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.one, self.two = np.zeros(lanes << CELL_BITS, np.int32), np.zeros(lanes << CELL_BITS, np.int32)
        self.masses = np.full(lanes * STATES, START, np.int64)
        self.rows, self.lanes = np.arange(lanes) * STATES, np.arange(lanes) << CELL_BITS
        self.history = np.zeros(lanes, np.int64)  # intervals of the last two ids
        self.hash, self.numbers = np.zeros(lanes, np.int64), np.arange(lanes)
        self.at = [self.lanes, self.lanes]
        self.n = lanes

    def predict(self, n: int) -> None:
        """Names the ids and lays out the masses' running sums, a row for each interval and one for the end."""
        if n != self.n:
            self.n, self.at = n, [a[:n] for a in self.at]
        self.c0, self.c1, self.c2 = self.lead[:n], self.one.take(self.at[0]), self.two.take(self.at[1])
        self.cell = self.history[:n] + self.rows[:n]
        self.cell += (self.c2 > 0) << 4
        self.cell += (self.c2 == self.c1) << 5
        self.packed = self.masses.take(self.cell)
        ends = np.zeros((5, n), np.int64)
        np.right_shift(self.packed, 2 * FIELD, out=ends[1])
        np.bitwise_and(self.packed >> FIELD, MASK, out=ends[2])
        np.bitwise_and(self.packed, MASK, out=ends[3])
        ends[2] += ends[1]
        ends[3] += ends[2]
        ends[1:4] <<= UNIT
        ends[4] = TOTAL
        self.ends = ends

    def which(self, ids1: np.ndarray) -> np.ndarray:
        """Interval of each id: 0 for order 2, 1 for order 1, 2 for order 0, 3 for none of them. ids1: ids + 1."""
        found = np.full(len(ids1), 3)
        found[np.flatnonzero(self.c0 == ids1)] = 2
        found[np.flatnonzero(self.c1 == ids1)] = 1
        found[np.flatnonzero(self.c2 == ids1)] = 0
        return found

    def named(self, which: np.ndarray) -> np.ndarray:
        """The ids + 1 that the intervals stand for; 0 where it is none of them."""
        out = np.zeros(len(which), np.int64)
        for k, ids1 in ((2, self.c0), (1, self.c1), (0, self.c2)):
            at = np.flatnonzero(which == k)
            out[at] = ids1[at]
        return out

    def interval(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = which * self.n + self.numbers[: self.n]
        flat = self.ends.reshape(-1)
        start = flat.take(at)
        at += self.n
        return start, flat.take(at) - start

    def learn(self, ids1: np.ndarray, which: np.ndarray) -> None:
        n = self.n
        self.packed -= (self.packed >> RATE) & FADE
        self.packed += GAIN.take(which)
        self.masses[self.cell] = self.packed
        self.one[self.at[0]] = ids1
        self.two[self.at[1]] = ids1
        # majority vote: a rival takes a vote off, and the lead when none is left
        votes, same = self.votes[:n], self.c0 == ids1
        votes += same
        votes -= ~same
        lost = np.flatnonzero(votes < 0)
        self.lead[lost], votes[lost] = ids1[lost], 1
        self.history[:n] = (self.history[:n] << 2 | which) & 15
        # places of the next step
        mixed = ids1 * 0x9E3779B1 & 0xFFFFFFFF
        lanes, cells = self.lanes[:n], (1 << CELL_BITS) - 1
        two = (mixed + (self.hash[:n] >> 7)) * 5 >> 12 & cells
        self.at = [(mixed >> 12 & cells) + lanes, two + lanes]
        self.hash[:n] = mixed


def _lengths(n: int, block: int) -> np.ndarray:
    return np.minimum(block, n - np.arange(0, n, block))


def encode(ids: np.ndarray, table: bytes, block: int) -> list[bytes]:
    """The ids in blocks of so many, each coded from a fresh state."""
    base, out = base_of(table), []
    for at in range(0, len(ids), block * LANES):
        out.extend(_encode_lanes(ids[at : at + block * LANES], base, block))
    return out


def _encode_lanes(ids: np.ndarray, base: np.ndarray, block: int) -> list[bytes]:
    lengths = _lengths(len(ids), block)
    lanes, steps = len(lengths), int(lengths[0])
    grid = np.zeros(lanes * steps, np.int32)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    mixer, room = Mixer(lanes), 2 * steps + 4
    low, width = np.zeros(lanes, np.int64), np.full(lanes, STATE, np.int64)
    # digit k of a lane lies at k * lanes + lane: lanes advance alike, so what is written lies close together
    digits, used = np.zeros(lanes * room, np.int32), np.arange(lanes)
    for t in range(steps):
        n = lanes if t < lengths[-1] else lanes - 1
        x = grid[t, :n].astype(np.int64)
        mixer.predict(n)
        which = mixer.which(x + 1)
        start, size = mixer.interval(which)
        mixer.learn(x + 1, which)
        new = np.flatnonzero(which == 3)
        rest, ids = size[new], x[new]
        down = rest * base.take(ids) >> BASE_BITS
        start[new] += down
        size[new] = (rest * base.take(ids + 1) >> BASE_BITS) - down
        unit = width[:n] >> TOTAL_BITS
        low[:n] += unit * start
        np.multiply(unit, size, out=width[:n])
        due = np.flatnonzero(width[:n] < LOW)
        while len(due):
            now, place = low[due], used[due]
            digits[place] = now >> 32
            used[due] = place + lanes
            low[due] = (now & (LOW - 1)) << 16
            wide = width[due] << 16
            width[due] = wide
            due = due[wide < LOW]
    digits[used] = (low + LOW - 1) >> 32
    digits = digits.reshape(room, lanes)
    n_digits = used // lanes + 1
    for k in range(int(n_digits.max()) - 1, 0, -1):
        digits[k - 1] += digits[k] >> 16
    small = np.ascontiguousarray(digits[: int(n_digits.max())].T).astype("<u2")  # the low 16 bits
    return [small[i, :n].tobytes() for i, n in enumerate(n_digits.tolist())]


def decode(blocks: list[bytes], table: bytes, n: int, block: int) -> np.ndarray:
    """The n ids of blocks in a row."""
    base = base_of(table)
    lookup = np.repeat(np.arange(len(base) - 1, dtype=np.uint16 if len(base) <= 1 << 16 else np.int32), np.diff(base))
    parts = [
        _decode_lanes(blocks[at : at + LANES], base, lookup, _lengths(min(n - at * block, LANES * block), block))
        for at in range(0, len(blocks), LANES)
    ]
    return np.concatenate(parts) if parts else np.empty(0, np.int32)


def decode_block(data: bytes, table: bytes, n: int) -> np.ndarray:
    """One block alone."""
    return decode([data], table, n, n)


def _decode_lanes(blocks: list[bytes], base: np.ndarray, lookup: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    lanes, steps = len(lengths), int(lengths[0])
    room = max(map(len, blocks)) // 2 + 8  # zeros follow a block's digits
    digits = np.zeros((lanes, room), np.uint16)
    for i, data in enumerate(blocks):
        digits[i, : len(data) // 2] = np.frombuffer(data, "<u2")
    digits = np.ascontiguousarray(digits.T).reshape(-1)
    first, second, third = (digits[k * lanes : (k + 1) * lanes].astype(np.int64) for k in range(3))
    code = (first << 32) | (second << 16) | third
    used = np.arange(3 * lanes, 4 * lanes)
    last_digit = np.arange((room - 1) * lanes, room * lanes)
    width, mixer = np.full(lanes, STATE, np.int64), Mixer(lanes)
    grid = np.zeros((steps, lanes), np.int32)
    for t in range(steps):
        n = lanes if t < lengths[-1] else lanes - 1
        mixer.predict(n)
        unit = width[:n] >> TOTAL_BITS
        value = np.minimum(code[:n] // unit, TOTAL - 1)
        which = (value >= mixer.ends[1]).astype(np.int64)
        which += value >= mixer.ends[2]
        which += value >= mixer.ends[3]
        x1 = mixer.named(which)
        start, size = mixer.interval(which)
        new = np.flatnonzero(which == 3)
        rest = size[new]
        point = (((value[new] - start[new] + 1) << BASE_BITS) - 1) // rest
        ids = lookup.take(np.minimum(point, BASE - 1)).astype(np.int64)
        down = rest * base.take(ids) >> BASE_BITS
        start[new] += down
        size[new] = (rest * base.take(ids + 1) >> BASE_BITS) - down
        x1[new] = ids + 1
        # a rest that happens to name a predicted id was never written, so the interval is the id's own
        mixer.learn(x1, which)
        code[:n] -= unit * start
        np.multiply(unit, size, out=width[:n])
        due = np.flatnonzero(width[:n] < LOW)
        while len(due):
            place = used[due]
            code[due] = (code[due] << 16) | digits[np.minimum(place, last_digit[due])]
            used[due] = place + lanes
            wide = width[due] << 16
            width[due] = wide
            due = due[wide < LOW]
        grid[t, :n] = x1 - 1
    whole = grid.T.reshape(-1)
    return whole[: (lanes - 1) * steps + int(lengths[-1])]
