"""An open-addressed table in numpy that interns the word n-grams of a slice of texts.

A slice's words are written one space apart, so a run of words is one stretch of bytes.  Each run is hashed by XXH64 and looks
for its slot from there on, a place further whenever another n-gram sits there; two runs share a slot only if their bytes are
equal.  A slot has a representative run, its bucket (CRC-32 of the bytes, modulo the number of buckets) and its count.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
from xxhash import xxh64_intdigest

from .common import Words

#: Words, and bytes of words, of a slice; a longer word is a slice of its own.  Runs up to SHORT bytes are hashed and compared eight bytes at a time.
SLICE_WORDS, SLICE_BYTES, SHORT = 1 << 17, 2 << 20, 64
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
# The primes of XXH64, and the polynomial of CRC-32.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_POLYNOMIAL = 0xEDB88320


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(sum_: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turned(sum_ + lane * _P2, 31) * _P1


def xxh64_values(eight: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """XXH64 (seed 0) of the stretches of one size that begin at start; eight: the eight bytes from each place on."""
    n, at = len(start), 0
    if size >= 32:
        with np.errstate(over="ignore"):
            begin = (_P1 + _P2, _P2, np.uint64(0), np.uint64(0) - _P1)
        sums = [np.full(n, x) for x in begin]
        while at + 32 <= size:
            sums = [_round(x, eight[start + at + 8 * k]) for k, x in enumerate(sums)]
            at += 32
        h = _turned(sums[0], 1) + _turned(sums[1], 7) + _turned(sums[2], 12) + _turned(sums[3], 18)
        for x in sums:
            h = (h ^ _round(np.uint64(0), x)) * _P1 + _P4
    else:
        h = np.full(n, _P5)
    h = h + np.uint64(size)
    while at + 8 <= size:
        h = _turned(h ^ _round(np.uint64(0), eight[start + at]), 27) * _P1 + _P4
        at += 8
    if at + 4 <= size:
        h = _turned(h ^ ((eight[start + at] & _MASK[4]) * _P1), 23) * _P2 + _P3
        at += 4
    while at < size:
        h = _turned(h ^ ((eight[start + at] & _MASK[1]) * _P5), 11) * _P1
        at += 1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def crc_values(data: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """CRC-32 of the stretches of one size that begin at start."""
    crc = np.full(len(start), 0xFFFFFFFF, dtype=np.uint32)
    for k in range(size):
        crc = _CRC[(crc ^ data[start + k]) & np.uint32(255)] ^ (crc >> np.uint32(8))
    return ~crc


def by_size(size: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(size, which) of the runs of each size up to SHORT, and (0, which) of the longer ones."""
    short = np.minimum(size, SHORT + 1).astype(np.uint8)
    order = np.argsort(short, kind="stable")
    ends = np.cumsum(np.bincount(short, minlength=SHORT + 2))
    for k in range(1, SHORT + 2):
        if ends[k] > ends[k - 1]:
            yield (k if k <= SHORT else 0), order[ends[k - 1] : ends[k]]


class Slots:
    """slot[i] is the slot of run i; bucket and count are the slots' columns, used lists the slots that have a run."""

    def __init__(self, raw: bytes, start: np.ndarray, end: np.ndarray, buckets: int, key=None):
        """key replaces XXH64, for tests."""
        n = len(start)
        size = 1 << max(4, (2 * n - 1).bit_length())
        self.raw, self.start, self.length = raw, start, end - start
        padded = np.frombuffer(raw + bytes(SHORT + 8), dtype=np.uint8)
        self.eight = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))  # eight bytes from each place on
        hashes = np.empty(n, dtype=np.uint64)
        for k, own in by_size(self.length):
            if k and not key:
                hashes[own] = xxh64_values(self.eight, start[own], k)
            else:
                hashes[own] = [(key or xxh64_intdigest)(raw[a:b]) for a, b in zip(start[own].tolist(), end[own].tolist())]
        run = np.full(size, -1, dtype=np.int64)
        at, todo, mask = (hashes & np.uint64(size - 1)).astype(np.int64), np.arange(n), size - 1
        self.slot = np.empty(n, dtype=np.int64)
        while len(todo):
            place = at[todo]
            free = run[place] < 0
            run[place[free]] = todo[free]  # of several runs that want it, one gets it
            sitting = run[place]
            found = (hashes[sitting] == hashes[todo]) & (self.length[sitting] == self.length[todo])
            check = np.flatnonzero(found & (sitting != todo))
            found[check] = self.equal(todo[check], sitting[check])
            self.slot[todo[found]] = place[found]
            todo = todo[~found]
            at[todo] = (at[todo] + 1) & mask
        self.used = np.flatnonzero(run >= 0)
        self.count = np.bincount(self.slot, minlength=size)
        self.bucket = np.zeros(size, dtype=np.int64)
        crc = np.empty(len(self.used), dtype=np.uint32)
        first, last = start[run[self.used]], end[run[self.used]]
        for k, own in by_size(last - first):
            crc[own] = crc_values(padded, first[own], k) if k else [crc32(raw[a:b]) for a, b in zip(first[own].tolist(), last[own].tolist())]
        self.bucket[self.used] = crc % np.uint32(buckets)

    def equal(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the bytes of runs i and j, of equal lengths, are equal."""
        size, a, b = self.length[i], self.start[i], self.start[j]
        out, live = np.ones(len(i), dtype=bool), np.flatnonzero(size <= SHORT)
        for k in range(0, SHORT, 8):
            live = live[size[live] > k]
            if not len(live):
                break
            differ = (self.eight[a[live] + k] ^ self.eight[b[live] + k]) & _MASK[np.minimum(size[live] - k, 8)]
            out[live] = differ == 0
            live = live[out[live]]
        for k in np.flatnonzero(size > SHORT).tolist():
            out[k] = self.raw[a[k] : a[k] + size[k]] == self.raw[b[k] : b[k] + size[k]]
        return out


def slices(words: Words, most: int, buckets: int) -> Iterator[tuple[Slots, np.ndarray]]:
    """(slots, text of each run) of all runs of 1 to `most` words, a bounded number of words at a time."""
    data, doc, n = words.text.bytes, words.doc, len(words)
    sizes = words.end - words.start + 1
    total, i = np.cumsum(sizes), 0
    while i < n:
        base = total[i - 1] if i else 0
        j = max(i + 1, min(i + SLICE_WORDS, int(np.searchsorted(total, base + SLICE_BYTES, "right"))))
        last = min(n, j + most - 1)  # runs that begin here end there at the latest
        length = sizes[i:last]
        end = np.cumsum(length)
        own = data[np.repeat(words.start[i:last] - (end - length), length) + np.arange(int(end[-1]))]
        own[end - 1] = 0x20
        begin, end = end - length, end - 1
        starts, ends, docs = [], [], []
        for k in range(most):  # runs of k + 1 words
            first = np.arange(min(j, n - k) - i) if n - k > i else np.empty(0, dtype=np.int64)
            first = first[doc[i + first] == doc[i + first + k]]
            starts.append(begin[first])
            ends.append(end[first + k])
            docs.append(doc[i + first])
        yield Slots(own.tobytes(), np.concatenate(starts), np.concatenate(ends), buckets), np.concatenate(docs)
        i = j
