"""A compressed FM-index over integer sequences: suffix order, wavelet matrix, backward search of many patterns at once."""

from __future__ import annotations

import numpy as np


def suffix_order(seq: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols at least (ties by place), by prefix doubling."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    h = 1
    while h < depth:
        key = rank * (n + 1)
        key[:-h] += rank[h:] + 1
        order = np.argsort(key)
        sorted_key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.r_[0, sorted_key[1:] != sorted_key[:-1]])
        rank = new
        if rank.max(initial=0) == n - 1:
            break
        h *= 2
    return np.argsort(rank, kind="stable")


class WaveletMatrix:
    """Bit planes of a sequence, packed in 64-bit words with a running count for each word."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.n, self.words, self.counts, self.zeros = len(seq), [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level) & 1
            one = bit.astype(bool)
            packed = np.packbits(np.r_[one, np.zeros(-len(one) % 64 + 64, bool)], bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.r_[0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)].astype(np.int32))
            self.zeros.append(int(len(one) - one.sum()))
            seq = np.concatenate([seq[~one], seq[one]])

    def walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the first ``at`` places lead when only ``symbol`` is followed down all planes."""
        at = at.astype(np.int64)
        for k in range(self.levels):
            word = at >> 6
            below = self.words[k][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = self.counts[k][word] + np.bitwise_count(below)
            at = np.where((symbol >> (self.levels - 1 - k)) & 1, self.zeros[k] + ones, at - ones)
        return at


class FMIndex:
    """Backward search over ``seq`` (symbols from 1; 0 parts texts), good for patterns of up to ``depth`` symbols."""

    def __init__(self, seq: np.ndarray, depth: int):
        self.n, symbols = len(seq), int(seq.max(initial=0)) + 1
        sa = suffix_order(seq, depth)
        self.wavelet = WaveletMatrix(seq[sa - 1], symbols)  # place 0 is preceded by the last separator
        self.first = np.searchsorted(seq[sa], np.arange(symbols))  # suffixes of lesser first symbols
        self.base = self.first - self.wavelet.walk(np.arange(symbols), np.zeros(symbols, np.int64))
        least, k = [sa.astype(np.int32)], 1
        while 2 * k <= self.n:  # least place of the next 2**k suffixes
            last = least[-1]
            least.append(np.r_[np.minimum(last[: self.n - 2 * k + 1], last[k : self.n - k + 1]), np.zeros(2 * k - 1, np.int32)])
            k *= 2
        self.least = np.concatenate(least)

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of symbol + pattern, from those of the pattern."""
        both = self.wavelet.walk(np.r_[symbol, symbol], np.r_[lo, hi]) + np.tile(self.base[symbol], 2)
        return both[: len(lo)], both[len(lo) :]

    def first_place(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least place in ``seq`` among the suffixes of non-empty intervals."""
        k = np.frexp((hi - lo).astype(np.float64))[1].astype(np.int64) - 1
        at = k * self.n
        return np.minimum(self.least[at + lo], self.least[at + hi - (np.int64(1) << k)])


def earlier_matches(seq: np.ndarray, starts: np.ndarray, lengths: np.ndarray, limits: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matching statistics of texts inside their own index: the stretches of ``least`` symbols or more of each text
    (``starts``, ``lengths``) that also start before place ``limits``. Returns text, from, to (symbols, maximal to the left
    for their end). All texts are searched in step, each from its right end to the left; where a match ends, the search
    goes on at the rightmost end that a stretch over the failing symbol can still have."""
    index = FMIndex(seq, int(lengths.max(initial=1)) + 1)
    lane = np.flatnonzero(lengths >= least)
    end = lengths[lane].copy()
    saved = np.zeros_like(end)  # end to go on with after a probe, else 0
    target = np.zeros_like(end)
    j, lo, hi = end.copy(), np.zeros_like(end), np.full_like(end, len(seq))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(lane):
        new_lo, new_hi = index.extend(seq[starts[lane] + j - 1], lo, hi)
        ok = new_hi > new_lo
        at = np.flatnonzero(ok)
        ok[at] = index.first_place(new_lo[at], new_hi[at]) < limits[lane[at]]
        j = j - ok
        lo, hi = np.where(ok, new_lo, lo), np.where(ok, new_hi, hi)
        probing = saved > 0
        stop = np.flatnonzero(~ok | (j == 0) | (probing & (j == target)))
        if not len(stop):
            continue
        sj, se, sp, good = j[stop], end[stop], probing[stop], ok[stop]
        found = (se - sj >= least) & ~sp
        if found.any():
            out.append((lane[stop[found]], sj[found], se[found]))
        fail = sj - 1  # the symbol that no match ending here can take in
        reach = np.minimum(se - 1, fail + least)
        probe = ~sp & ~good & (fail + 4 < reach)
        over = sp & good  # the probe took its target in: search from the saved end
        new_end = np.where(sp, np.where(over, saved[stop], np.minimum(saved[stop], se - 1)), np.where(probe, fail + 4, reach))
        done = np.where(sp, new_end < least, ((sj == 0) & good) | (reach < least))
        saved[stop] = np.where(probe, reach, 0)
        target[stop] = np.where(probe, fail, -1)
        end[stop] = new_end
        j[stop], lo[stop], hi[stop] = new_end, 0, len(seq)
        if done.any():
            keep = np.ones(len(lane), bool)
            keep[stop[done]] = False
            lane, end, saved, target, j, lo, hi = (x[keep] for x in (lane, end, saved, target, j, lo, hi))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))
