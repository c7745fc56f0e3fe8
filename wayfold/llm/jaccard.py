"""N-gram Jaccard self-join with token-combination prefixes; classes of linked documents.

A document is its set of distinct word n-grams (``ngram`` words, A-Z lower-cased; with fewer words the whole sequence is its
only token). Two documents link when their Jaccard similarity is ``percent`` per cent or more.

1. Every token is counted in a sketch of 2**21 counters (8 MB whatever the corpus). Tokens whose counter stands out are the
   frequent class. All sets are ordered alike: rare tokens first, then frequent ones, each by hash. The class only decides
   the order and the kind of key, so a wrong guess costs time and never a link.
2. Equal sets are one class from here on. Prefixes are extended by one, so that two linked sets share at least two tokens
   of their prefixes: either a rare one (indexed alone), or two frequent ones (indexed as pair combinations). Sets of more
   than ``LONG_PREFIX`` prefix tokens index frequent tokens alone, and near the border sets carry both kinds of key.
3. Groups of a key of up to ``SMALL`` members give all their pairs. Larger groups don't: a member that is not of the group's
   commonest component gives only its ``GIVES`` nearest members of other components (by a parity-bitmap bound on the symmetric
   difference, which is exact as a bound). What links there is merged, and whoever had more partners than it gave gives eight
   times as many in the next round, until nobody is left with a pair between two components that was not verified; groups
   without such a member are done and stay out of it, and groups of the same members are one. First each class does so in the one group of its least key, where near copies meet, then in all its groups. Groups of more than
   ``GROUP`` members are dealt into blocks, and each pair of blocks is a task's work. So groups of near copies don't emit
   their square, and no partner is capped.
4. Candidates pass the bitmap bound (larger sets have larger bitmaps) and are then verified on their whole token sets. Those of
   small groups that hang together are verified in one place, so that each set moves once; what hangs together in more than
   ``BLOCK_TOKENS`` tokens, and the few of large groups, are verified pair by pair. Only texts that verification may need are moved: a bitmap of
   2 MB, whatever the corpus, holds which these are.
5. That gives enough links to connect every class with all it is linked with. The rest lie inside components of three
   classes or more: their classes are dealt into blocks of about ``LINK_ROWS`` sets or ``LINK_TOKENS`` tokens, and each pair
   of blocks, a task's work, counts the shared tokens of all its pairs of fitting length. So all links are found; numbers of
   links are added up where the sets lie, so that pairs need not leave the task. The work of a component of many near copies
   is its square, as it may have that many links; users who ask for components alone (``every=False``) don't pay for it.

Classes are told apart by 128 bits: where two share the first 64, the second hash names all but one of them.
Null and empty texts have an empty set and link with nothing. A null doc_id takes part and shows the least id it is linked
with, or null. Rows may repeat or share ids. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wayfold.llm.common import LOWER, chained, column_bytes, lean, mix, ragged, release, signed, slices, table, word_hashes, words
from wayfold.llm.graph import components

SLOTS = 1 << 21
BLOCK = 1 << 16
LONG_PREFIX = 20
SMALL = 8
GIVES, GROUP = 2, 4096
BUCKET = 1 << 20  # keys that are sorted at once
MATRIX = 1 << 22  # bytes of bitmaps that are compared at once
BITS = ((0, 1024), (1350, 4096), (6000, 16384))  # sets of so many tokens at least have bitmaps of so many bits
BLOCK_TOKENS = 2_000_000
BLOOM_BITS = 1 << 24
LINK_ROWS, LINK_TOKENS = 4096, 1_000_000
_NONE = (1 << 63) - 1
_PAIRS = "a long, b long"


def _grams(data: np.ndarray, offsets: np.ndarray, ngram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """n-gram hashes of slices of texts, one text after another, how many each text has, and how many words."""
    for i, j in slices(offsets):
        lo, hi = offsets[i], offsets[j]
        part, offs = LOWER[data[lo:hi]], offsets[i : j + 1] - lo
        starts, ends, bounds = words(part, offs)
        word, many = word_hashes(part, starts, ends), np.diff(bounds)
        count = np.where(many >= ngram, many - ngram + 1, np.minimum(many, 1))
        of, place = ragged(count)
        at = bounds[:-1][of] + place
        all_ = chained(word, ngram)
        grams = all_[np.minimum(at, max(len(all_) - 1, 0))] if len(all_) else np.zeros(len(at), np.uint64)
        begin = np.cumsum(count) - count
        for d in np.flatnonzero((many > 0) & (many < ngram)):
            grams[begin[d]] = chained(word[bounds[d] : bounds[d + 1]], int(many[d]))[0]
        yield grams, count, many


def slice_sets(data: np.ndarray, offsets: np.ndarray, ngram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The sets of slices of texts: distinct n-gram hashes of one text after another, ascending in each, their sizes, and how
    many words each text has."""
    for grams, count, many in _grams(data, offsets, ngram):
        end = np.cumsum(count)
        for a, b in zip((end - count).tolist(), end.tolist(), strict=True):
            grams[a:b].sort()
        first = np.ones(len(grams), bool)
        first[1:] = grams[1:] != grams[:-1]
        first[(end - count)[count > 0]] = True
        places = np.r_[0, np.cumsum(first)]
        yield grams[first], places[end] - places[end - count], many


def token_sets(data: np.ndarray, offsets: np.ndarray, ngram: int) -> Iterator[np.ndarray]:
    """The set of each text: its distinct n-gram hashes, ascending."""
    for tokens, size, _ in slice_sets(data, offsets, ngram):
        end = np.cumsum(size)
        yield from (tokens[a:b] for a, b in zip((end - size).tolist(), end.tolist(), strict=True))


def _sketch(texts: DataFrame, ngram: int) -> np.ndarray:
    """How often tokens of each slot occur."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.uint32)
        for batch in batches:
            for grams, _, _ in _grams(*column_bytes(batch.column("text")), ngram):
                np.add.at(total, (grams >> np.uint64(43)).astype(np.int64), np.uint32(1))
        for k in range(0, SLOTS, BLOCK):
            if (part := total[k : k + BLOCK]).any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([k // BLOCK], pa.int32()), "counts": pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK, np.uint64)
        for c in rows["counts"]:
            total += np.frombuffer(zlib.decompress(c), np.uint32)
        return pd.DataFrame({"block": rows["block"].iloc[:1], "counts": [total.tobytes()]})

    out = np.zeros(SLOTS, np.uint64)
    for r in texts.mapInArrow(lean(count), "block int, counts binary").groupBy("block").applyInPandas(add, "block int, counts binary").collect():  # 16 MB at most
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["counts"], np.uint64)
    return out


def _long(percent: int) -> int:
    return LONG_PREFIX * 100 // max(1, 100 - percent)


def _least_size(percent: int) -> int:
    """Smaller sets link with equal ones only."""
    return max(2, -(-percent // max(1, 100 - percent)))


def _need(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that a set of n must share with any set it links with."""
    return -(-percent * n // 100)


def _scrambled(s: np.ndarray) -> np.ndarray:
    return mix(s + np.uint64(0x9E3779B97F4A7C15))


def _names(m: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set, from its scrambled tokens."""
    if not len(m):
        return 0, 0
    return int(signed(mix(np.add.reduce(m, keepdims=True) + np.uint64(len(m))))[0]), int(signed(np.bitwise_xor.reduce(mix(m), keepdims=True))[0])


def _profiles(texts: DataFrame, frequent: np.ndarray, ngram: int, percent: int) -> DataFrame:
    """For each row: its columns but the text, words (how many), n, h1, h2 (hashes of the set), prefix (tokens, rare ones first),
    rare (how many) and bits (a parity bitmap, larger for larger sets)."""
    own = [f for f in texts.schema if f.name != "text"]
    held = texts.sparkSession.sparkContext.broadcast(np.packbits(frequent))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.unpackbits(held.value).astype(bool)
        least = _least_size(percent)
        for batch in batches:
            many, n, h1, h2, prefix, rare, bits = [], [], [], [], [], [], []
            for tokens, size, count in slice_sets(*column_bytes(batch.column("text")), ngram):
                end = np.cumsum(size)
                begin = end - size
                m = _scrambled(tokens)
                sums, odds = np.r_[np.uint64(0), np.cumsum(m)], np.r_[np.uint64(0), np.bitwise_xor.accumulate(mix(m))]
                many.append(count)
                n.append(size)
                h1.append(np.where(size > 0, signed(mix(sums[end] - sums[begin] + size.astype(np.uint64))), 0))
                h2.append(signed(odds[end] ^ odds[begin]))
                is_often = often[(tokens >> np.uint64(43)).astype(np.int64)]
                length = np.minimum(size, size - _need(size, percent) + 2)
                place = (m >> np.uint64(50)).astype(np.int64)
                for a, b, k in zip(begin.tolist(), end.tolist(), length.tolist(), strict=True):
                    if b - a < least:
                        prefix.append(b"")
                        rare.append(0)
                        bits.append(b"")
                        continue
                    s, o = tokens[a:b], is_often[a:b]
                    low = s[~o][:k]
                    prefix.append(low.tobytes() + s[o][: k - len(low)].tobytes())
                    rare.append(len(low))
                    wide = max(w for from_, w in BITS if b - a >= from_)
                    odd = np.bincount(place[a:b] & (wide - 1), minlength=wide) & 1
                    bits.append(np.packbits(odd.astype(bool)).tobytes())
            many, n, h1, h2 = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (many, n, h1, h2))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in own), pa.array(many), pa.array(n), pa.array(h1), pa.array(h2), pa.array(prefix, pa.binary()), pa.array(rare, pa.int32()), pa.array(bits, pa.binary())],
                names=[*(f.name for f in own), "words", "n", "h1", "h2", "prefix", "rare", "bits"],
            )

    made = StructType.fromDDL("words long, n long, h1 long, h2 long, prefix binary, rare int, bits binary")
    return texts.mapInArrow(lean(make), StructType([*own, *made]))


@lru_cache(maxsize=None)
def _two_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of n places; n is at most a prefix's length below ``LONG_PREFIX``."""
    return np.triu_indices(n, 1)


def _many_keys(percent: int) -> Column:
    """How many keys ``_keys`` makes of a class."""
    often = F.octet_length("prefix") / 8 - F.col("rare")
    two = F.when(F.col("n") <= _long(percent) * 100 // percent + 1, often * (often - 1) / 2).otherwise(0)
    return (F.col("rare") + two + F.when(F.col("n") >= _long(percent), often).otherwise(0)).cast("long")


def _keys(batches: Iterator[pa.RecordBatch], percent: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Index keys of each class: rare prefix tokens, and combinations of two frequent ones (long sets: frequent ones alone).
    They travel as arrays (``_packed``), by bucket. Keys that have more than ``SMALL`` members here are large: their members
    travel apart (``known``) and need not meet, the key's bucket gets a mark (n of -1)."""
    key, c, n, held = [], [], [], 0

    def dealt() -> pa.RecordBatch:
        k, cc, nn = np.concatenate(key), np.concatenate(c), np.concatenate(n)
        place = mix(k)
        order = np.argsort(place)
        place, k, cc, nn = place[order], signed(k[order]), cc[order], nn[order]
        starts, size = _runs(place)
        of, known, data = [], [], []
        if (size > SMALL).any():
            big, first = np.repeat(size > SMALL, size), starts[size > SMALL]
            for at in range(0, len(much := np.flatnonzero(big)), 1 << 16):
                part = much[at : at + (1 << 16)]
                of.append(int(cc[part[0]]) % buckets)
                known.append(True)
                data.append(_packed(k[part], cc[part], nn[part]))
            nn[first], big[first] = -1, False  # has travelled: from here on a mark
            place, k, cc, nn = (x[~big] for x in (place, k, cc, nn))
        bucket = (place >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        for at, m in zip(*_runs(bucket), strict=True):
            of.append(int(bucket[at]))
            known.append(False)
            data.append(_packed(k[at : at + m], cc[at : at + m], nn[at : at + m]))
        return pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(known, pa.bool_()), pa.array(data, pa.binary())], names=["bucket", "known", "data"])

    for batch in batches:
        names = batch.column("c").to_numpy()
        for i, (m, rare, raw) in enumerate(zip(batch.column("n").to_pylist(), batch.column("rare").to_pylist(), batch.column("prefix").to_pylist(), strict=True)):
            t = np.frombuffer(raw, np.uint64)
            mine, often = [t[:rare]], t[rare:]
            if m <= _long(percent) * 100 // percent + 1 and len(often) > 1:
                x, y = _two_of(len(often))
                mine.append(mix(often[x] + mix(often[y])))
            if m >= _long(percent):
                mine.append(mix(often ^ np.uint64(0x5851F42D4C957F2D)))
            key += mine
            many = sum(map(len, mine))
            c.append(np.full(many, names[i]))
            n.append(np.full(many, m, np.int32))
            held += many
            if held > BUCKET // 2:
                yield dealt()
                key, c, n, held = [], [], [], 0
    if held:
        yield dealt()


def _packed(key: np.ndarray, c: np.ndarray, n: np.ndarray) -> bytes:
    return key.tobytes() + c.tobytes() + n.tobytes()


def _unpacked(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m = [len(d) // 20 for d in data]
    key, c = (np.concatenate([np.frombuffer(d, np.int64, k, at * k) for d, k in zip(data, m, strict=True)]) for at in (0, 8))
    return key, c, np.concatenate([np.frombuffer(d, np.int32, k, 16 * k) for d, k in zip(data, m, strict=True)]).astype(np.int64)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by key, cut anew so that no group spans two."""
    left: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1], side="left"))
        if cut or left and key[0] != left[-1].column("key")[-1].as_py():
            yield pa.Table.from_batches([*left, batch.slice(0, cut)] if cut else left)
            left = []
        left.append(batch.slice(cut))
    if left:
        yield pa.Table.from_batches(left)


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return starts, np.diff(np.r_[starts, len(key)])


def _pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of small groups all pairs of fitting length; rows of large ones as (c, null, key). Holds a bucket at a time, and of large
    groups what no batch of ``_keys`` found to be large by itself."""

    def told(a: np.ndarray, b: np.ndarray, c: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        zeros = np.zeros(len(a), np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.r_[a, c]), pa.array(np.r_[b, np.zeros(len(c), np.int64)]), pa.array(np.r_[zeros, key]), pa.array(np.r_[zeros != 0, np.ones(len(c), bool)])],
            names=["a", "b", "key", "large"],
        )

    def met(data: list[bytes]) -> pa.RecordBatch:
        key, c, n = _unpacked(data)
        order = np.argsort(key)
        size = _runs(key[order])[1]
        order = order[np.repeat(size > 1, size)]
        if not len(order):
            return told(*np.zeros((4, 0), np.int64))
        order = order[np.lexsort((c[order], n[order], key[order]))]
        key, c, n = key[order], c[order], n[order]
        starts, size = _runs(key)
        large = (size > SMALL) | (n[starts] < 0)
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for m in range(2, SMALL + 1):
            s = starts[(size == m) & ~large]
            for x in range(m) if len(s) else ():
                for y in range(x + 1, m):
                    fit = 100 * n[s + x] >= percent * n[s + y]  # n ascends in a group
                    out_a.append(c[s + x][fit])
                    out_b.append(c[s + y][fit])
        big = np.repeat(large, size) & (n >= 0)
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
        return told(*pair, c[big], key[big])

    held: list[bytes] = []
    bucket = -1
    for batch in batches:
        for of, known, data in zip(batch.column("bucket").to_pylist(), batch.column("known").to_pylist(), batch.column("data").to_pylist(), strict=True):
            if known:
                key, c, _ = _unpacked([data])
                yield told(*np.zeros((2, 0), np.int64), c, key)
                continue
            if of != bucket and held:
                yield met(held)
                held = []
            bucket = of
            held.append(data)
    if held:
        yield met(held)


def _nearest(batches: Iterator[pa.RecordBatch], percent: int, gives: int) -> Iterator[pa.RecordBatch]:
    """Candidates of a large group: each member that is not of its commonest component with its ``gives`` nearest members of
    other components, of those that pass the bounds on length and symmetric difference; ``more``, with the group's key as a:
    some member has others. A pair that several groups of a task give comes once."""
    held: list[np.ndarray] = []
    left: set[int] = set()

    def once() -> pa.RecordBatch:
        a, b = np.unique(np.concatenate([*held, np.zeros((2, 0), np.int64)], axis=1), axis=1)
        keys = np.array(sorted(left), np.int64)
        held.clear()
        left.clear()
        more = np.r_[np.zeros(len(a), bool), np.ones(len(keys), bool)]
        return pa.RecordBatch.from_arrays([pa.array(np.r_[a, keys]), pa.array(np.r_[b, keys]), pa.array(more)], names=["a", "b", "more"])

    for t in _grouped(batches):
        key, c, n, label = (t.column(x).to_numpy() for x in ("key", "c", "n", "label"))
        raw, whole = t.column("bits").to_pylist(), t.column("whole")
        size = np.array([len(r) for r in raw])  # ascends with n
        for s, m in zip(*_runs(key), strict=True):
            nn, cc, own = n[s : s + m], c[s : s + m], size[s : s + m]
            names, of, many = np.unique(label[s : s + m], return_inverse=True, return_counts=True)
            if len(names) == 1:
                continue
            kinds = np.unique(own)
            maps = {b: (k := int(np.searchsorted(own, b)), _folded(raw[s + k : s + m], b)) for b in kinds.tolist()}
            outer = np.flatnonzero(of != many.argmax())
            low, high = np.searchsorted(nn, -(-percent * nn[outer] // 100)), np.searchsorted(nn, nn[outer] * 100 // percent, side="right")
            some = max(1, MATRIX // (m * int(own[-1])))
            for at in range(0, len(outer), some):  # n ascends: partners of one, and of neighbours, lie in a stretch
                x, lo, hi = outer[at : at + some], low[at : at + some, None], high[at : at + some, None]
                y = np.arange(lo[0, 0], hi[-1, 0])
                apart = np.empty((len(x), len(y)), np.int64)
                for p in kinds.tolist():
                    i = slice(*np.searchsorted(own[x], [p, p + 1]))
                    for q in kinds.tolist() if i.start < i.stop else ():
                        j = slice(*np.searchsorted(own[y], [q, q + 1]))
                        k, rows = maps[min(p, q)]
                        apart[i, j] = np.bitwise_count(rows[x[i] - k, None] ^ rows[None, y[j] - k]).sum(axis=2, dtype=np.int64)
                both = nn[x, None] + nn[None, y]
                fit = (apart * (100 + percent) <= (100 - percent) * both) & (of[x, None] != of[None, y]) & (y >= lo) & (y < hi)
                over = np.flatnonzero(fit.sum(axis=1) > gives)
                if len(over):
                    near = np.argpartition(np.where(fit[over], apart[over] / both[over], np.inf), gives, axis=1)[:, :gives]
                    fit[over] = False
                    fit[over[:, None], near] = True
                    of_block = whole[int(s)].as_py()
                    left.add(int(key[s]) if of_block is None else of_block)
                i, j = np.nonzero(fit)
                held.append(np.stack([np.minimum(cc[x[i]], cc[y[j]]), np.maximum(cc[x[i]], cc[y[j]])]))
        if sum(h.shape[1] for h in held) > 200_000:
            yield once()
    yield once()


def _folded(raw: list[bytes], size: int) -> np.ndarray:
    """Bitmaps of ``size`` bytes or more as rows of ``size`` bytes: parities of the parts add up."""
    if all(len(r) == size for r in raw):
        return np.frombuffer(b"".join(raw), np.uint64).reshape(len(raw), size // 8)
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(r, np.uint64).reshape(-1, size // 8), axis=0) for r in raw])


def _apart(p: list[bytes], q: list[bytes]) -> np.ndarray:
    """A lower bound of how many tokens only one of two sets has, by their bitmaps."""
    size = np.array([min(len(a), len(b)) for a, b in zip(p, q, strict=True)])
    out = np.zeros(len(p), np.int64)
    for b in np.unique(size).tolist():
        at = np.flatnonzero(size == b)
        out[at] = np.bitwise_count(_folded([p[i] for i in at], b) ^ _folded([q[i] for i in at], b)).sum(axis=1, dtype=np.int64)
    return out


def _bounded(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs that pass the bounds on length and symmetric difference."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if t.num_rows:
                na, nb = t.column("na").to_numpy(), t.column("nb").to_numpy()
                ok = (_apart(t.column("x").to_pylist(), t.column("y").to_pylist()) * (100 + percent) <= (100 - percent) * (na + nb)) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
                yield t.select(["a", "b"]).filter(pa.array(ok))

    x = classes.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("bits").alias("x"))
    y = classes.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "x", "y").mapInArrow(lean(bound), _PAIRS)


def _bloom(ids: DataFrame) -> np.ndarray:
    """A bitmap of the hashes in the column ``rep``."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BLOOM_BITS, bool)
        for batch in batches:
            bits[(batch.column(0).to_numpy().view(np.uint64) % np.uint64(BLOOM_BITS)).astype(np.int64)] = True
        for k in range(0, BLOOM_BITS, BLOCK):
            if bits[k : k + BLOCK].any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([k // BLOCK], pa.int32()), "bits": pa.array([np.packbits(bits[k : k + BLOCK]).tobytes()], pa.binary())})

    def any_of(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": rows["block"].iloc[:1], "bits": [np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in rows["bits"]]).tobytes()]})

    out = np.zeros(BLOOM_BITS // 8, np.uint8)
    for r in ids.select("rep").mapInArrow(lean(mark), "block int, bits binary").groupBy("block").applyInPandas(any_of, "block int, bits binary").collect():  # 2 MB at most
        out[r["block"] * BLOCK // 8 : (r["block"] + 1) * BLOCK // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _shared(p: bytes, q: bytes) -> tuple[int, int]:
    """Sizes of the intersection and of the union of two sets."""
    both = np.sort(np.concatenate([np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)]), kind="stable")
    k = int((both[1:] == both[:-1]).sum())
    return k, len(both) - k


_LINKS = "a long, b long, shared long"


def _sets(who: DataFrame, texts: DataFrame, ngram: int, owner: str) -> DataFrame:
    """Whole token sets of the classes ``who`` (c, rep, label, big): c, tokens, label, big; a class may come twice."""
    needed = texts.sparkSession.sparkContext.broadcast(_bloom(who))

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # a task passes each text on once, however often the row is repeated
        for batch in batches:
            rep = batch.column("rep").to_numpy()
            h = rep.view(np.uint64) % np.uint64(BLOOM_BITS)
            ok = (needed.value[(h >> np.uint64(3)).astype(np.int64)] >> (7 - (h & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
            for i in np.flatnonzero(ok).tolist():
                if (r := int(rep[i])) in done:
                    ok[i] = False
                done.add(r)
            yield batch.filter(pa.array(ok))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, tokens, labels, big = [], [], [], []
            for w, s, v, g in zip(batch.column("c").to_pylist(), token_sets(*column_bytes(batch.column("text")), ngram), batch.column("label").to_pylist(), batch.column("big").to_pylist(), strict=True):
                if len(s) and w in _names(_scrambled(s)):  # two texts may have one rep
                    c.append(w)
                    tokens.append(s.tobytes())
                    labels.append(v)
                    big.append(g)
            yield pa.RecordBatch.from_pydict({"c": pa.array(c, pa.int64()), "tokens": pa.array(tokens, pa.binary()), "label": pa.array(labels, pa.int64()), "big": pa.array(big, pa.bool_())})

    keyed = texts.select("rep", "text").mapInArrow(lean(maybe), "rep long, text string")
    got = keyed.join(who, "rep").select("c", "text", "label", "big").mapInArrow(lean(sets), "c long, tokens binary, label long, big boolean")
    return table(got, "jaccard-sets", owner)


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, ngram: int, percent: int, owner: str, few: bool = False) -> DataFrame:
    """Pairs whose whole sets reach the threshold: a, b, shared. ``few``: about as many pairs as sets, so each by itself."""
    if few:
        ends = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
        who = classes.select("c", "rep").join(ends, "c").select("c", "rep", F.lit(0).cast("long").alias("label"), F.lit(True).alias("big"))
        who = table(who, "jaccard-who", owner)
    else:
        label = components(pairs, owner)
        who = classes.select("c", "rep", "n").join(label.withColumnRenamed("v", "c"), "c")
        size = who.groupBy("label").agg(F.sum("n").alias("tokens")).filter(F.col("tokens") > BLOCK_TOKENS).select("label", F.lit(True).alias("big"))
        who = table(who.join(size, "label", "left").select("c", "rep", "label", F.coalesce("big", F.lit(False)).alias("big")), "jaccard-who", owner)
    got = _sets(who, texts, ngram, owner)

    def together(mine: pa.Table, there: pa.Table) -> pa.Table:
        tokens = dict(zip(there.column("c").to_pylist(), there.column("tokens").to_pylist(), strict=True))
        out = [(a, b, *_shared(tokens[a], tokens[b])) for a, b in zip(mine.column("a").to_pylist(), mine.column("b").to_pylist(), strict=True)]
        out = [x for x in out if 100 * x[2] >= percent * x[3]]
        return pa.table({k: pa.array([x[i] for x in out], pa.int64()) for i, k in enumerate(("a", "b", "shared"))})

    def apiece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_shared(p, q) for p, q in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            ok = pa.array([100 * k >= percent * u for k, u in out], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array([k for k, _ in out], pa.int64())], names=["a", "b", "shared"]).filter(ok)

    one = got.filter("big").dropDuplicates(["c"])

    def by_pair(some: DataFrame) -> DataFrame:
        full = some.select("a", "b").join(one.select(F.col("c").alias("a"), F.col("tokens").alias("x")), "a").join(one.select(F.col("c").alias("b"), F.col("tokens").alias("y")), "b")
        return full.select("a", "b", "x", "y").mapInArrow(lean(apiece), _LINKS)

    if few:
        return by_pair(pairs)
    placed = pairs.join(who.select(F.col("c").alias("a"), "label", "big"), "a")
    near = placed.filter("not big").select("label", "a", "b").groupBy("label").cogroup(got.filter("not big").select("label", "c", "tokens").groupBy("label")).applyInArrow(together, _LINKS)
    return near.unionByName(by_pair(placed.filter("big")))


def _linked(n: np.ndarray, tokens: np.ndarray, first: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Linked pairs of sets: places x and y, shared tokens. ``n`` (ascending): sizes; ``tokens``: the sets one after another,
    distinct in a set; ``first``: the block of each. Of one block all pairs, of two those across."""
    number = np.unique(tokens, return_inverse=True)[1]
    starts = np.cumsum(n) - n
    one = (first == first[0]).all()
    mark = np.zeros(len(number), bool)
    here = first == first.min()
    there = np.arange(len(n)) if one else np.flatnonzero(~here)
    text = number if one else number[np.repeat(~here, n)]
    size = n[there]
    begin = np.cumsum(size) - size
    for x in np.flatnonzero(here):
        lo = x + 1 if one else int(np.searchsorted(size, -(-percent * n[x] // 100)))
        hi = int(np.searchsorted(size, n[x] * 100 // percent, side="right"))
        if lo >= hi:
            continue
        own = number[starts[x] : starts[x] + n[x]]
        mark[own] = True
        shared = np.add.reduceat(mark[text[begin[lo] : begin[hi - 1] + size[hi - 1]]], begin[lo:hi] - begin[lo], dtype=np.int64)
        mark[own] = False
        ok = np.flatnonzero(100 * shared >= percent * (n[x] + size[lo:hi] - shared))
        yield np.full(len(ok), x), there[lo + ok], shared[ok]


def _all_links(links: DataFrame, label: DataFrame, classes: DataFrame, texts: DataFrame, ngram: int, percent: int, owner: str, count: bool = False) -> DataFrame:
    """All links, from ``links`` that connect each class with all it is linked with. With ``count``, instead: c and others
    (how many rows of other classes it is linked with), added up where the sets lie."""
    mine = f"{owner}-try"
    sized = label.withColumnRenamed("v", "c").join(classes.select("c", "rep", "n", "docs"), "c")
    many = sized.groupBy("label").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("tokens")).filter("k > 2")
    many = table(many.select("label", F.greatest(F.ceil(F.col("k") / LINK_ROWS), F.ceil(F.col("tokens") / LINK_TOKENS)).cast("int").alias("blocks")), "jaccard-many", mine)
    who = table(sized.join(many, "label").select("c", "rep", "docs", "label", F.lit(False).alias("big")), "jaccard-who", mine)
    sets = _sets(who, texts, ngram, mine).dropDuplicates(["c"]).join(many, "label").join(who.select("c", "docs"), "c")
    dealt = sets.withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "c", "docs", "tokens")

    def among(t: pa.Table) -> pa.Table:
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        c, block, docs, raw = t.column("c").to_numpy(), t.column("block").to_numpy(), t.column("docs").to_numpy(), t.column("tokens").to_pylist()
        n = np.array([len(x) // 8 for x in raw])
        order = np.lexsort((c, n))
        c, docs = c[order], docs[order]
        a, b, shared = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        others = np.zeros(len(c), np.int64)
        if len(np.unique(block)) == (1 if i == j else 2):
            for x, y, k in _linked(n[order], np.frombuffer(b"".join([raw[o] for o in order]), np.uint64), block[order], percent):
                if count:
                    np.add.at(others, x, docs[y])
                    np.add.at(others, y, docs[x])
                else:
                    a.append(np.minimum(c[x], c[y]))
                    b.append(np.maximum(c[x], c[y]))
                    shared.append(k)
        if count:
            return pa.table({"c": c, "others": others}).filter(pa.array(others > 0))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b), "shared": np.concatenate(shared)})

    within = dealt.groupBy("label", "i", "j").applyInArrow(among, "c long, others long" if count else _LINKS)
    pairs = links.join(label.join(many, "label", "left_anti").select(F.col("v").alias("a")), "a", "left_semi").select("a", "b", "shared")
    if not count:
        return _settled(pairs.unionByName(within), "jaccard-links", owner)
    docs = classes.select(F.col("c").alias("other"), "docs")
    ends = pairs.select(F.col("a").alias("c"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("c"), F.col("a").alias("other")))
    two = ends.join(docs, "other").select("c", F.col("docs").alias("others"))
    return _settled(two.unionByName(within).groupBy("c").agg(F.sum("others").alias("others")), "jaccard-links", owner)


def row_hash() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def _texts(docs: DataFrame, carry: dict[str, Column] | None = None) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash().alias("rep"), "text", *[v.alias(f"_wf_{k}") for k, v in (carry or {}).items()])


def join(docs: DataFrame, ngram: int = 3, percent: int = 90, owner: str = "query", every: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Self-join of ``docs`` (doc_id, text). Returns (profiles, classes, links).

    profiles: doc_id, n, c for each row. classes: c, n, docs (how many rows), least (its least doc_id).
    links: a, b, shared: all linked pairs of classes, a < b; without ``every`` only enough of them to connect every class
    with all it is linked with, for users who ask for components alone."""
    profiles, classes, links, label = _connect(docs, ngram, percent, owner)
    if every:
        links = _all_links(links, label, classes, _texts(docs), ngram, percent, owner)
    return profiles, classes, links


def _classes(profiles: DataFrame, owner: str) -> tuple[DataFrame, DataFrame]:
    """Profiles with the name ``c`` of their class (null for empty sets), and the classes."""
    least = F.min(F.coalesce("doc_id", F.lit(_NONE))).alias("least")
    few = profiles.filter("n > 0").groupBy("h1", "h2").agg(least, F.min("rep").alias("rep"), F.count(F.lit(1)).alias("docs"), *[F.first(x).alias(x) for x in ("n", "rare", "prefix", "bits")])
    few = table(few, "jaccard-classes", owner)
    twice = few.groupBy("h1").agg(F.count(F.lit(1)).alias("k"), F.min("h2").alias("low")).filter("k > 1").select("h1", "low")
    if twice.isEmpty():
        return profiles.withColumn("c", F.when(F.col("n") > 0, F.col("h1"))), few.withColumnRenamed("h1", "c").drop("h2")
    c = F.when(F.col("n") > 0, F.when(F.col("h2") > F.col("low"), F.col("h2")).otherwise(F.col("h1")))
    return profiles.join(twice, "h1", "left").withColumn("c", c).drop("low"), few.join(twice, "h1", "left").withColumn("c", c).drop("low", "h1", "h2")


def _settled(df: DataFrame, tag: str, owner: str) -> DataFrame:
    """``df`` written; the tables of the trial it came from go."""
    out = table(df, tag, owner)
    release(f"{owner}-try")
    return out


def _connect(docs: DataFrame, ngram: int, percent: int, owner: str, carry: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What ``join`` returns, with enough links to connect every class with all it is linked with; and the components (v, label)
    of linked classes."""
    spark: SparkSession = docs.sparkSession
    texts = _texts(docs)
    counts = _sketch(texts.select("text"), ngram)
    load = float(counts.mean())
    profiles, classes = _classes(table(_profiles(_texts(docs, carry), counts > load + 8 * load**0.5 + 24, ngram, percent), "jaccard-profiles", owner), owner)
    big = classes.filter(F.col("n") >= _least_size(percent))
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = max(4 * parts, (big.agg(F.sum(_many_keys(percent))).first()[0] or 0) // BUCKET)
    keyed = big.select("c", "n", "rare", "prefix").mapInArrow(lean(lambda x: _keys(x, percent, buckets)), "bucket int, known boolean, data binary")
    keyed = keyed.repartition(parts, "bucket").sortWithinPartitions("bucket")
    met = table(keyed.mapInArrow(lean(lambda x: _pairs(x, percent)), "a long, b long, key long, large boolean"), "jaccard-met", owner)
    near = table(_bounded(met.filter("not large").select("a", "b").distinct(), big, percent), "jaccard-first", owner)
    links = _settled(_verified(near, classes, texts, ngram, percent, f"{owner}-try"), "jaccard-links", owner)
    label = components(links.select("a", "b"), owner)
    large, blocks = _large(met.filter("large").select("key", F.col("a").alias("c")), owner)
    if large.isEmpty():
        return profiles, classes, links, label
    least = large.groupBy("c").agg(F.min("key").alias("key")).select("key", "c")
    gives, groups, tried = GIVES, least, near
    while True:
        more, found = _cross(groups, blocks, big, label, percent, gives, parts, owner)
        new = table(found.join(tried, ["a", "b"], "left_anti"), "jaccard-cross", owner)
        if not new.isEmpty():
            tried = tried.unionByName(new)
            good = _settled(_verified(new, classes, texts, ngram, percent, f"{owner}-try", few=True), "jaccard-more", owner)
            if not good.isEmpty():
                links = table(links.unionByName(good), "jaccard-links", owner)
                label = components(links.select("a", "b"), owner)
        if groups is least:
            groups = large
        elif more.isEmpty():
            return profiles, classes, links, label
        else:  # the other groups are done: all pairs between their components were tried, and components only grow
            gives, groups = gives * 8, groups.join(more, "key", "left_semi")


def _large(rows: DataFrame, owner: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` (key, c) of large groups, and in how many blocks each group is dealt (key, blocks). Of groups of the same members
    (near copies share most of their keys) that of the least key stands for all: told by 128 bits and the number of members."""
    of = rows.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.bit_xor(F.xxhash64("c")).alias("x"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("y"))
    blocks = of.groupBy("x", "y", "many").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("many") / F.lit(GROUP)).cast("int").alias("blocks"))
    blocks = table(blocks, "jaccard-groups", owner)
    return table(rows.join(blocks.select("key"), "key", "left_semi"), "jaccard-large", owner), blocks


def _cross(groups: DataFrame, blocks: DataFrame, classes: DataFrame, label: DataFrame, percent: int, gives: int, parts: int, owner: str) -> tuple[DataFrame, DataFrame]:
    """Groups of ``groups`` (key, c) that have more candidates between different components (key), and those found."""
    rows = groups.join(label.withColumnRenamed("v", "c"), "c", "left").select("key", "c", F.coalesce("label", "c").alias("label"))
    rows = table(rows, "jaccard-rows", f"{owner}-try")
    mixed = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").join(blocks, "key").select("key", "blocks")
    dealt = rows.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    of = F.when(F.col("blocks") > 1, F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))).otherwise(F.col("key"))
    dealt = dealt.select(of.alias("key"), F.when(F.col("blocks") > 1, F.col("key")).alias("whole"), "c", "label").join(classes.select("c", "n", "bits"), "c").select("key", "whole", "c", "n", "label", "bits")
    dealt = dealt.repartition(parts, "key").sortWithinPartitions("key", "n", "c")
    met = _settled(dealt.mapInArrow(lean(lambda x: _nearest(x, percent, gives)), "a long, b long, more boolean"), "jaccard-near", owner)
    return met.filter("more").select(F.col("a").alias("key")).distinct(), met.filter("not more").select("a", "b").distinct()


def near_duplicates(docs: DataFrame, ngram: int = 3, percent: int = 90, owner: str = "query", every: bool = True, carry: dict[str, Column] | None = None) -> DataFrame:
    """Each row of ``docs``: doc_id, n_shingles, component_id (the least doc_id it can reach by links), set_hash, row_hash (of id
    and text, as ``row_hash`` gives it), n_words, root (names its component, ids or not; null for empty sets), with ``every``
    n_links (how many other rows it is linked with, equal sets included), and ``carry``: short columns of ``docs`` by new names,
    so that what else a row has need not be looked up."""
    profiles, classes, links, label = _connect(docs, ngram, percent, owner, carry)
    rooted = classes.select("c", "least", "docs").join(label.withColumnRenamed("v", "c"), "c", "left").withColumn("root", F.coalesce("label", "c"))
    low = rooted.groupBy("root").agg(F.min("least").alias("component"))
    of = rooted.join(low, "root").select("c", "root", "component", "docs")
    if every:
        of = of.join(_all_links(links, label, classes, _texts(docs), ngram, percent, owner, count=True), "c", "left").withColumn("n_links", F.col("docs") - 1 + F.coalesce("others", F.lit(0)))
    with_it = [f"_wf_{k}" for k in carry or {}]
    out = profiles.select("doc_id", "rep", "words", "n", "c", *with_it).join(of, "c", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.nullif("component", F.lit(_NONE)))
    count = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if every else []
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("c").alias("set_hash"), F.col("rep").alias("row_hash"), F.col("words").alias("n_words"), "root", *count, *[F.col(x).alias(x[4:]) for x in with_it])
