"""Adaptive context-mixing range coder for token ids, in blocks that are reset and checksummed on their own.

A block's ids are dealt to lanes of at most STEPS ids. All lanes advance together, one id a step, so that numpy codes a
step of every lane at once. Their model is shared and learns after each step: order-0 counts of ids, and for the last
one and the last two ids of a lane the id that followed them before, with a confidence. The three are mixed by weights
that follow the measured hit rates into one interval per id, and a 64-bit range coder with carries codes the interval.
The decoder makes the same steps from the ids it has decoded."""

from __future__ import annotations

import struct
import zlib

import numpy as np

STEPS = 256
BLOCK = 1 << 20  # ids in a block
#: A block's alphabet; larger ids are coded by their rank among the block's different ids, in blocks of half as many ids.
ALPHABET = 1 << 19
_UNIT = 20  # an order's probabilities are in 1 / 2**20, weights in 1 / 256
_TOTAL = 28
_SLOTS1, _SLOTS2 = 16, 18
_HEADER = struct.Struct("<4sIIIIIII")
_MAGIC = b"CMX2"
U = np.uint64


class _Model:
    """All numbers of a step stay below 2**31. An entry of a context is the id that followed, times 4, and its confidence."""

    def __init__(self, alphabet: int, lanes: int, decodes: bool = False):
        self.size, self.decodes = alphabet, decodes
        self.counts = np.zeros(alphabet, np.int64)
        self.follows = [np.zeros(1 << _SLOTS1, np.int32), np.zeros(1 << _SLOTS2, np.int32)]
        self.hits = [np.ones(4, np.int64), np.ones(4, np.int64)]
        self.tries = [np.full(4, 8, np.int64), np.full(4, 8, np.int64)]
        self.last = np.zeros(lanes, np.int32)
        self.before = np.zeros(lanes, np.int32)
        self.new: list[np.ndarray] = []
        self.step = 0
        self._refresh()

    def _refresh(self) -> None:
        if self.new:
            self.counts += np.bincount(np.concatenate(self.new), minlength=self.size)
            self.new = []
        spare = (1 << _UNIT) - self.size
        cum = np.zeros(self.size + 1, np.int64)
        np.cumsum(self.counts, out=cum[1:])
        total = int(cum[-1])
        each = np.arange(self.size + 1, dtype=np.int64)
        cum = each + (cum * spare // total if total else each * spare // self.size)
        if self.decodes:  # the id of each of the 2**20 parts
            self.id_at = np.repeat(np.arange(self.size, dtype=np.uint16 if self.size <= 1 << 16 else np.int32), np.diff(cum))
        self.cum = cum.astype(np.int32)
        w1, w2 = (np.clip(256 * h // t, 0, 224) for h, t in zip(self.hits, self.tries))
        second = w2[None, :] + 0 * w1[:, None]
        first = np.minimum(w1[:, None] * (256 - second) // 256, 248 - second)
        self.w = (256 - first - second + (first << 9) + (second << 18)).reshape(16).astype(np.int32)  # three of 9 bits each

    def look(self) -> None:
        """The slots, predictions and weights of the next step."""
        last, before = self.last.view(np.uint32), self.before.view(np.uint32)
        s1 = (last * np.uint32(40503)) & np.uint32((1 << _SLOTS1) - 1)
        s2 = (last * np.uint32(10007) + before * np.uint32(2654435) ^ before >> np.uint32(3)) & np.uint32((1 << _SLOTS2) - 1)
        self.slot = (s1, s2)
        self.e1, self.e2 = self.follows[0][s1], self.follows[1][s2]
        self.p1, self.p2 = self.e1 >> 2, self.e2 >> 2
        self.c1, self.c2 = self.e1 & 3, self.e2 & 3
        w = self.w[self.c1 * 4 + self.c2]
        self.w0, self.w1, self.w2 = w & 511, (w >> 9 & 511) << _UNIT, w >> 18 << _UNIT

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = self.cum[ids]
        start = self.w0 * low + self.w1 * (self.p1 < ids) + self.w2 * (self.p2 < ids)
        width = self.w0 * (self.cum[ids + 1] - low) + self.w1 * (self.p1 == ids) + self.w2 * (self.p2 == ids)
        return start, width

    def find(self, v: np.ndarray) -> np.ndarray:
        """The ids whose intervals hold v."""
        first = self.p1 <= self.p2
        a, b = np.minimum(self.p1, self.p2), np.maximum(self.p1, self.p2)
        wa, both = np.where(first, self.w1, self.w2), self.w1 + self.w2
        w0, cum = self.w0, self.cum
        start_a, start_b = w0 * cum[a], w0 * cum[b] + np.where(a == b, 0, wa)
        end_a, end_b = w0 * cum[a + 1] + wa, w0 * cum[b + 1] + both
        past = v - np.where(v >= end_b, both, np.where(v >= end_a, wa, 0))
        ids = self.id_at[np.minimum(past // w0, (1 << _UNIT) - 1)].astype(np.int32)
        ids = np.where((v >= start_a) & (v < end_a), a, ids)
        return np.where((v >= start_b) & (v < end_b), b, ids)

    def learn(self, ids: np.ndarray) -> None:
        fresh = ids << 2
        for k, (e, p, c) in enumerate(((self.e1, self.p1, self.c1), (self.e2, self.p2, self.c2))):
            hit = p == ids
            seen = np.bincount(c * 2 + hit, minlength=8).reshape(4, 2)
            self.hits[k] += seen[:, 1]
            self.tries[k] += seen.sum(1)
            self.follows[k][self.slot[k]] = np.where(hit, e + (c < 3), np.where(c > 0, e - 1, fresh))
        self.new.append(ids)
        self.before, self.last = self.last, ids
        self.step += 1
        if self.step & (self.step - 1) == 0 or self.step % 32 == 0:
            self._refresh()


def _encode_block(ids: np.ndarray) -> bytes:
    n, table = len(ids), b""
    check = zlib.crc32(ids.astype("<u4").tobytes())
    if ids.max() >= ALPHABET:
        known, ids = np.unique(ids, return_inverse=True)
        table = zlib.compress(known.astype("<u4").tobytes(), 1)
    lanes = max(1, -(-n // STEPS))
    steps = -(-n // lanes)
    grid = np.zeros(lanes * steps, np.int32)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    alphabet = int(grid.max()) + 1
    model = _Model(alphabet, lanes)
    low, width = np.zeros(lanes, U), np.full(lanes, 0xFFFFFFFFFFFFFFFF, U)
    words, used, every = np.zeros((steps + 3, lanes), U), np.ones(lanes, np.int64), np.arange(lanes)
    for row in grid:
        model.look()
        start, size = model.interval(row)
        unit = width >> U(_TOTAL)
        moved = low + unit * start.astype(U)
        carry = moved < low
        if carry.any():
            at = every[carry]
            words[used[at] - 1, at] += U(1)
        low, width = moved, unit * size.astype(U)
        at = np.flatnonzero(width < U(1 << 32))
        if len(at):
            words[used[at], at] = low[at] >> U(32)
            used[at] += 1
            low[at] <<= U(32)
            width[at] <<= U(32)
        model.learn(row)
    for _ in range(2):
        words[used, every] = low >> U(32)
        used += 1
        low <<= U(32)
    for k in range(len(words) - 1, 0, -1):
        words[k - 1] += words[k] >> U(32)
    out = (words[1:] & U(0xFFFFFFFF)).astype("<u4").T
    payload = out[np.arange(steps + 2)[None, :] < (used - 1)[:, None]].tobytes()
    lengths = (used - 1).astype("<u2").tobytes()
    body = zlib.compress(lengths, 1)
    return _HEADER.pack(_MAGIC, n, alphabet, check, zlib.crc32(table + body + payload), len(table), len(body), len(payload)) + table + body + payload


def _decode_block(data: memoryview) -> tuple[np.ndarray, int]:
    magic, n, alphabet, check, stored, t, m, size = _HEADER.unpack_from(data)
    if magic != _MAGIC:
        raise ValueError("not a block of token ids")
    at, end = _HEADER.size, _HEADER.size + t + m + size
    if zlib.crc32(data[at:end]) != stored:
        raise ValueError("a block's bytes are damaged")
    used = np.frombuffer(zlib.decompress(data[at + t : at + t + m]), "<u2").astype(np.int64)
    words = np.frombuffer(data[at + t + m : end], "<u4").astype(U)
    lanes = max(1, -(-n // STEPS))
    steps = -(-n // lanes)
    words = np.concatenate([words, np.zeros(2, U)])
    place = np.concatenate([[0], np.cumsum(used)[:-1]])
    model = _Model(alphabet, lanes, decodes=True)
    diff, width = words[place] << U(32) | words[place + 1], np.full(lanes, 0xFFFFFFFFFFFFFFFF, U)
    place += 2
    out = np.zeros((steps, lanes), np.int32)
    for k in range(steps):
        model.look()
        unit = width >> U(_TOTAL)
        v = np.minimum(diff // unit, U((1 << _TOTAL) - 1)).astype(np.int32)
        ids = model.find(v)
        start, wide = model.interval(ids)
        diff = diff - unit * start.astype(U)
        width = unit * wide.astype(U)
        at2 = np.flatnonzero(width < U(1 << 32))
        if len(at2):
            diff[at2] = diff[at2] << U(32) | words[np.minimum(place[at2], len(words) - 1)]
            place[at2] += 1
            width[at2] <<= U(32)
        out[k] = ids
        model.learn(ids)
    ids = np.ascontiguousarray(out.T).reshape(-1)[:n].astype("<u4")
    if t:
        ids = np.frombuffer(zlib.decompress(data[at : at + t]), "<u4")[ids]
    if zlib.crc32(ids.tobytes()) != check:
        raise ValueError("a block's checksum differs")
    return ids, end


def encode(ids: np.ndarray) -> bytes:
    """Blocks of ids (any of 32 bits), one after another; nothing for no ids."""
    ids = np.asarray(ids)
    size = BLOCK if not len(ids) or ids.max() < ALPHABET else min(BLOCK, ALPHABET)
    return b"".join(_encode_block(ids[k : k + size]) for k in range(0, len(ids), size))


def decode(data: bytes) -> np.ndarray:
    parts, view = [], memoryview(data)
    while len(view):
        ids, size = _decode_block(view)
        parts.append(ids)
        view = view[size:]
    return np.concatenate(parts) if parts else np.zeros(0, "<u4")
