"""Repeated byte strings by prefix-free parsing and suffix order.

Every byte covered by a string of ``length`` bytes that also starts anywhere else in the corpus is removed; strings never
cross documents and are judged on the input.

1. Parse: a rolling hash over ``TRIGGER`` bytes that is 0 modulo ``MODULUS`` is a trigger; a phrase reaches from one trigger
   to the end of the next, so phrases overlap by a trigger and no phrase is a proper prefix of another.
2. Dictionary: of the runs of ``RUN`` phrases that lie whole inside a string, that of the least hash opens it. Equal strings
   are opened by the same run at the same place. Only these runs are counted over the corpus; strings whose run occurs once
   are not repeated. Strings too poor in triggers to hold a run are counted themselves, by 128-bit hashes; those that occur
   again nearby go on as stretches, so that a long text of one byte or of a short period is a few rows.
3. Records: neighbouring strings opened by one run make one record (left context, run, right context). Equal records are
   one; with two copies all their strings are repeated.
4. Order: records that are left single are dealt to shards by their run. There the order of the parse's suffixes (right
   contexts from the run on, with longest common prefixes of neighbours) and the suffixes of what lies left of it combine into
   the corpus order of all strings: strings with the same left suffix are neighbours in the order of their right contexts, and
   a string is repeated if a neighbour shares the rest of its ``length`` bytes. All this compares bytes, not hashes.
5. Runs that open more than ``CROWD`` distinct records (more than a shard holds) don't go to one shard; their strings are
   counted by hash, wherever they lie.

Null and empty texts have no bytes. Rows with equal texts are each other's copies, so all their strings are repeated. Ids may
be null or repeat. Runs without triggers (say, one byte over and over) are covered by 2. Texts
of more than ``PART_BYTES`` are parsed in overlapping parts. An empty table gives no rows. Other columns, whatever their names, are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import SYMBOL_BYTES, Rolling, byte_symbols, column_bytes, lean, ragged, release, signed, slices, table

LENGTH = 200
TRIGGER = 8
MODULUS = 8
PART_BYTES, HELD_ROWS = 1 << 20, 1 << 20
RUN = 4
SHARD_RECORDS = 20_000
CROWD = SHARD_RECORDS
_PLACE = np.uint64((1 << 24) - 1)


def _parts(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Texts i to j, as bytes lo to hi and how many bytes of text i lie before lo. Texts of more than ``PART_BYTES`` go in parts
    that overlap, so that each of their strings lies whole in exactly one."""
    for i, j in slices(offsets, PART_BYTES // 2):
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= PART_BYTES:
            yield i, j, lo, hi, 0
        else:  # one long text
            for at in range(lo, hi - length + 1, PART_BYTES):
                yield i, j, at, min(hi, at + PART_BYTES + length - 1), at - lo


def _offsets(offsets: np.ndarray, i: int, j: int, lo: int, hi: int) -> np.ndarray:
    return np.clip(offsets[i : j + 1], lo, hi) - lo


def triggers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of the triggers inside each text, and each text's bounds among them."""
    n = len(data)
    if n < TRIGGER:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, TRIGGER)).view("<u8")[:, 0]
    at = np.flatnonzero(((word * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(MODULUS) == 0)
    end = offsets[np.searchsorted(offsets, at, side="right")]
    at = at[at + TRIGGER <= end]
    return at, np.searchsorted(at, offsets)


def openings(data: np.ndarray, offsets: np.ndarray, length: int, roll: Rolling) -> tuple[np.ndarray, ...]:
    """For stretches of strings that one run of phrases opens: text, run (its first trigger's number), first and last start; and
    of strings without a run: text and start. Last: triggers and each text's bounds among them."""
    at, bounds = triggers(data, offsets)
    runs = max(0, len(at) - RUN)
    reach = at[RUN:] + TRIGGER  # end of each run
    # the runs inside a string change only where it loses or gains one, or where a text begins or ends
    last = offsets[1:] - length
    edge = np.unique(np.concatenate([at + 1, reach - length, offsets[:-1], last + 1]))
    edge = edge[(edge >= 0) & (edge < offsets[-1])]
    text = np.searchsorted(offsets, edge, side="right") - 1
    stop = np.minimum(np.r_[edge[1:], offsets[-1]] - 1, last[text])
    edge, text, stop = (x[stop >= edge] for x in (edge, text, stop))
    lo, hi = np.searchsorted(at, edge), np.searchsorted(reach, edge + length, side="right")  # runs lo .. hi - 1
    has = hi > lo
    least = np.zeros(len(edge), np.int64)
    if has.any():
        levels = [(roll.spans(at[:runs], reach) & ~_PLACE) | (np.arange(runs, dtype=np.uint64) & _PLACE)]
        span = hi - lo
        while 2 << (len(levels) - 1) <= int(span.max()):
            half = 1 << (len(levels) - 1)
            levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
        k = np.frexp(np.maximum(span, 1).astype(np.float64))[1] - 1
        for v in np.unique(k[has]):
            m = has & (k == v)
            value = np.minimum(levels[v][lo[m]], levels[v][hi[m] - (1 << v)])
            place = (value & _PLACE).astype(np.int64)
            least[m] = lo[m] + ((place - lo[m]) & int(_PLACE))
    spare_group, spare_place = ragged((stop - edge + 1)[~has])
    spare = (text[~has][spare_group], edge[~has][spare_group] + spare_place)
    edge, text, stop, least = (x[has] for x in (edge, text, stop, least))
    first = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (least[1:] != least[:-1]) | (edge[1:] != stop[:-1] + 1)]) if len(edge) else np.zeros(0, np.int64)
    ends = stop[np.r_[first[1:] - 1, len(stop) - 1]] if len(edge) else edge
    return text[first], least[first], edge[first], ends, *spare, at, bounds


def _parse(docs: DataFrame, length: int) -> DataFrame:
    """(h, h2, row, k, m): opening runs (k the place of their first trigger in the text) and ``m`` neighbouring strings without
    one (k = -1 - first byte). Of what occurs again among the rows held at a time one row stays, marked; the others are known to be
    repeated and only pass through, neighbouring strings as one row: a text of one byte over and over is a few rows."""

    def flush(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h, h2, r, k = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((k, r, h2, h))
        h, h2, r, k = h[order], h2[order], r[order], k[order]
        first = np.r_[True, (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])]
        group = np.cumsum(first) - 1
        several = (np.bincount(group) > 1)[group]
        fresh = np.r_[True, (r[1:] != r[:-1]) | (k[1:] != k[:-1])] | first
        known = several & fresh & ~first
        kr, kk = r[known], k[known]
        order = np.lexsort((-kk, kr))
        kr, kk = kr[order], kk[order]
        new = np.r_[True, (kr[1:] != kr[:-1]) | (kk[1:] != kk[:-1] - 1) | (kk[:-1] >= 0)][: len(kk)]
        m = np.diff(np.r_[np.flatnonzero(new), len(kk)])
        kr, kk = kr[new], kk[new]
        key = kr.view(np.uint64) ^ (kk.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        ones = np.ones(int(first.sum()), np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(signed(np.r_[h[first], key])), pa.array(signed(np.r_[h2[first], key])), pa.array(np.r_[r[first], kr]), pa.array(np.r_[k[first], kk]), pa.array(np.r_[ones, m]), pa.array(np.r_[several[first].astype(np.int32), np.full(len(kk), 2, np.int32)])],
            names=["h", "h2", "row", "k", "m", "mark"],
        )

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        held = 0
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            row = batch.column("row").to_numpy()
            for i, j, lo, hi, base in _parts(offsets, length):
                part, offs = data[lo:hi], _offsets(offsets, i, j, lo, hi)
                symbols = byte_symbols(part)
                roll = Rolling(symbols, 0, SYMBOL_BYTES)
                text, run, _, _, st, sb, at, _ = openings(part, offs, length, roll)
                parts.append((roll.spans(at[run], at[run + RUN] + TRIGGER), np.zeros(len(run), np.uint64), row[i:j][text], base + at[run] - offs[text]))
                if len(st):
                    parts.append((roll.spans(sb, sb + length), Rolling(symbols, 2, SYMBOL_BYTES).spans(sb, sb + length), row[i:j][st], -1 - (base + sb - offs[st])))
                held += len(run) + len(st)
                if held > HELD_ROWS:
                    yield flush(parts)
                    parts, held = [], 0
            if held:
                yield flush(parts)
                parts, held = [], 0

    return docs.select("row", "text").mapInArrow(lean(parse), "h long, h2 long, row long, k long, m long, mark int")


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (h, h2): those that occur more than once. Of a group that goes on no more is held than one fresh row."""
    left: pa.Table | None = None
    known: tuple[int, int] | None = None  # the last group, once it is known to occur again
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
        keep, known, open_ = _repeated(t, known)
        yield _passed(t.slice(0, open_), keep[:open_])
        left = t.slice(open_) if open_ < t.num_rows else None
    if left is not None:
        yield _passed(left, left.column("mark").to_numpy() == 2)


def _repeated(t: pa.Table, known: tuple[int, int] | None) -> tuple[np.ndarray, tuple[int, int] | None, int]:
    """Which rows to keep, the last group if it occurs again, and where the rows begin that can't be told yet."""
    h, h2, mark = (t.column(c).to_numpy() for c in ("h", "h2", "mark"))
    fresh = mark < 2
    first = np.r_[True, (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])]
    group = np.cumsum(first) - 1
    many = np.bincount(group, weights=np.where(fresh, 1 + (mark == 1), 0)) > 1
    many[0] |= known == (int(h[0]), int(h2[0]))
    if many[-1]:
        return ~fresh | many[group], (int(h[-1]), int(h2[-1])), len(h)
    return ~fresh | many[group], None, int(np.flatnonzero(first)[-1])


def _passed(t: pa.Table, keep: np.ndarray) -> pa.RecordBatch:
    rows = pa.array(keep)
    return pa.RecordBatch.from_arrays([t.column(c).combine_chunks().filter(rows) for c in ("row", "k", "m")], names=["row", "k", "m"])


_CUT = "kind int, row long, doc_id long, text string, n_bytes long, sha string, z1 long, z2 long, phrase long, n int, lo long, hi long, left_n int, bytes binary"
_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
_SCHEMA = pa.schema([(x.split()[0], _TYPES[x.split()[1]]) for x in _CUT.split(", ")])


def _kind(kind: int, rows: int, /, **columns) -> pa.RecordBatch:
    columns["kind"] = pa.array(np.full(rows, kind, np.int32))
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(rows, f.type) for f in _SCHEMA], schema=_SCHEMA)


def merged(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of stretches [lo, hi) for each row number."""
    order = np.lexsort((lo, row))
    row, lo, hi = row[order], lo[order], hi[order]
    if not len(row):
        return row, lo, hi
    group = np.cumsum(np.r_[0, row[1:] != row[:-1]])
    span = np.int64(1) << 40
    reach = np.maximum.accumulate(hi + group * span) - group * span
    first = np.r_[True, (row[1:] != row[:-1]) | (lo[1:] > reach[:-1])]
    return row[first], lo[first], reach[np.r_[np.flatnonzero(first)[1:] - 1, len(row) - 1]]


def _cut(docs: DataFrame, length: int) -> DataFrame:
    """kind 0: finished documents; 1: documents with candidates; 2: records; 3: stretches known to be repeated."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            row = batch.column("row").to_numpy()
            dup = batch.column("dup")
            dup_at, dup_of, dup_m = dup.offsets.to_numpy(), dup.values.field("k").to_numpy(), dup.values.field("m").to_numpy()
            dup_n = np.where(np.asarray(dup.is_valid()), np.diff(dup_at), 0)
            has = np.zeros(batch.num_rows, bool)
            for i, j, lo, hi, base in _parts(offsets, length):
                part, offs = data[lo:hi], _offsets(offsets, i, j, lo, hi)
                raw = part.tobytes()
                known = []
                busy = np.flatnonzero(dup_n[i:j])
                if len(busy):
                    symbols = byte_symbols(part)
                    roll = Rolling(symbols, 0, SYMBOL_BYTES)
                    text, run, first, last, _, _, at, _ = openings(part, offs, length, roll)
                    number, ok = base + at[run] - offs[text], np.zeros(len(run), bool)
                    left, right = np.searchsorted(text, busy), np.searchsorted(text, busy, side="right")
                    for d, x, y in zip(busy, left, right, strict=True):
                        mine = slice(dup_at[i + d], dup_at[i + d + 1])
                        k, m = dup_of[mine], dup_m[mine]
                        ok[x:y] = np.isin(number[x:y], k)
                        if base == 0 and (k < 0).any():  # strings without a run are settled
                            s = -1 - k[k < 0]
                            known.append(np.stack([np.full(len(s), d), s, s + m[k < 0] + (length - 1)]))
                    d, g, g1, z_lo, z_hi = text[ok], at[run[ok]], at[run[ok] + RUN], first[ok], last[ok]
                    has[i + d] = True
                if len(busy) and len(d):
                    z1, z2 = roll.spans(z_lo, z_hi + length), Rolling(symbols, 2, SYMBOL_BYTES).spans(z_lo, z_hi + length)
                    order = np.lexsort((z2, z1))
                    fresh = np.r_[True, (z1[order][1:] != z1[order][:-1]) | (z2[order][1:] != z2[order][:-1])]
                    group = np.cumsum(fresh) - 1
                    count = np.bincount(group)
                    several = np.empty(len(order), bool)
                    several[order] = (count > 1)[group]
                    if several.any():
                        known.append(np.stack([d, base + z_lo - offs[d], base + z_hi + length - offs[d]])[:, several])
                    rep = order[fresh]
                    yield _kind(
                        2, len(rep), row=pa.array(row[i:j][d[rep]]), z1=pa.array(signed(z1[rep])), z2=pa.array(signed(z2[rep])), phrase=pa.array(signed(roll.spans(g[rep], g1[rep] + TRIGGER))), n=pa.array(np.minimum(count, 2)),
                        lo=pa.array((base + z_lo - offs[d])[rep]), hi=pa.array((base + z_hi - offs[d])[rep]), left_n=pa.array((g - z_lo)[rep]), bytes=pa.array([raw[x : y + length] for x, y in zip(z_lo[rep], z_hi[rep], strict=True)], pa.binary()),
                    )
                if known:
                    d, a, b = merged(*np.concatenate(known, axis=1))
                    has[i + d] = True
                    yield _kind(3, len(d), row=pa.array(row[i:j][d]), lo=pa.array(a), hi=pa.array(b))
            ids, text = batch.column("doc_id"), batch.column("text")
            rest = np.flatnonzero(~has)
            sha = [hashlib.sha256(data[offsets[d] : offsets[d + 1]]).hexdigest() for d in rest]
            yield _kind(0, len(rest), doc_id=ids.take(pa.array(rest)), n_bytes=pa.array(np.diff(offsets)[rest]), sha=pa.array(sha, pa.string()))
            some = np.flatnonzero(has)
            if len(some):
                yield _kind(1, len(some), row=pa.array(row[some]), doc_id=ids.take(pa.array(some)), text=text.take(pa.array(some)))

    return docs.select("row", "doc_id", "text", "dup").mapInArrow(lean(cut), _CUT)


def order_records(left: np.ndarray, left_n: np.ndarray, right: np.ndarray, right_n: np.ndarray, fewest: np.ndarray, length: int) -> np.ndarray:
    """Which strings of records are repeated, as (record, distance of the string's start from the trigger) pairs.

    ``left``: bytes before the trigger, nearest first (rows of a matrix, ``left_n`` valid); ``right``: bytes from the trigger
    on (``right_n`` valid, at most ``length``); ``fewest``: a record's least distance."""
    k, width = right.shape
    padded = np.zeros((k, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = right
    keys = np.ascontiguousarray(padded).view(">u8").astype(np.uint64)
    order = np.lexsort(tuple(keys[:, c] for c in range(keys.shape[1] - 1, -1, -1)))  # the parse's order
    differ = right[order][1:] != right[order][:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    common = np.minimum(common, np.minimum(right_n[order][1:], right_n[order][:-1]))
    levels, step = [common], 1
    while 2 * step <= len(common):
        levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
        step *= 2
    rank = np.empty(k, np.int64)
    rank[order] = np.arange(k)
    suffix, out = np.zeros(k, np.int64), []
    alive = np.arange(k)
    for a in range(int(left_n.max(initial=0)) + 1):
        alive = alive[left_n[alive] >= a]
        if a:  # one byte further left: the next dictionary suffix
            suffix[alive] = np.unique(suffix[alive] * 256 + left[alive, a - 1], return_inverse=True)[1]
        mine = alive[(fewest[alive] <= a) & (right_n[alive] >= length - a)]
        if len(mine) < 2:
            continue
        by = mine[np.lexsort((rank[mine], suffix[mine]))]
        x, y = rank[by][:-1], rank[by][1:]
        together = np.flatnonzero(suffix[by][:-1] == suffix[by][1:])
        if not len(together):
            continue
        x, y = x[together], y[together]
        e = np.frexp((y - x).astype(np.float64))[1] - 1
        shared = np.empty(len(x), np.int64)
        for v in np.unique(e):
            at = e == v
            shared[at] = np.minimum(levels[v][x[at]], levels[v][y[at] - (1 << v)])
        good = together[shared >= length - a]
        hit = np.unique(np.r_[by[good], by[good + 1]])
        out.append(np.stack([hit, np.full(len(hit), a)]))
    return np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)


def _order_shard(t: pa.Table, length: int) -> pa.Table:
    """Repeated stretches of the single records of a shard; records are compared when they open with the same phrase."""
    t = t.sort_by([("phrase", "ascending"), ("z1", "ascending"), ("z2", "ascending")])
    data, offsets = column_bytes(t.column("bytes"))
    left_n = t.column("left_n").to_numpy().astype(np.int64)
    size = np.diff(offsets)
    fewest = size - length  # strings start at 0 .. size - length of the record
    fewest = left_n - fewest
    right_n = np.minimum(size - left_n, length)
    wide = int(left_n.max(initial=0))
    padded = np.concatenate([data, np.zeros(length + wide + 1, np.uint8)])
    trig = offsets[:-1] + left_n
    right = padded[trig[:, None] + np.arange(length)]
    right[np.arange(length) >= right_n[:, None]] = 0
    left = padded[np.maximum(trig[:, None] - 1 - np.arange(max(wide, 1)), 0)]
    rec, a = order_records(left, left_n, right, right_n, fewest, length)
    single = (t.column("n").to_numpy() == 1)[rec]
    rec, a = rec[single], a[single]
    begin = t.column("lo").to_numpy()[rec] + left_n[rec] - a
    row, lo, hi = merged(t.column("row").to_numpy()[rec], begin, begin + length)
    return pa.table({"row": pa.array(row), "lo": pa.array(lo), "hi": pa.array(hi)})


def _strings(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Every string of the records, as two hashes."""
    for batch in batches:
        data, offsets = column_bytes(batch.column("bytes"))
        base = batch.column("lo").to_numpy()
        for i, j in slices(offsets, 1 << 19):
            part, offs = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            of, off = ragged(np.diff(offs) - length + 1)
            s, symbols = offs[of] + off, byte_symbols(part)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(pa.array(of + i)), batch.column("n").take(pa.array(of + i)), pa.array(base[i:j][of] + off), pa.array(signed(Rolling(symbols, 0, SYMBOL_BYTES).spans(s, s + length))), pa.array(signed(Rolling(symbols, 2, SYMBOL_BYTES).spans(s, s + length)))],
                names=["row", "n", "at", "w1", "w2"],
            )


def repeated_spans(docs: DataFrame, length: int = LENGTH, owner: str = "query") -> tuple[DataFrame, DataFrame]:
    """(cut, spans): the rows of ``_cut``, and by row number the byte stretches (lo, hi) to remove."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.xxhash64("text"))
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parsed = _parse(base, length).repartition(parts, "h").sortWithinPartitions("h", "h2")
    dup = parsed.mapInArrow(lean(_again), "row long, k long, m long").groupBy("row").agg(F.collect_set(F.struct("k", "m")).alias("dup"))
    # tables that the next one is made of go with it: the parse and the heads are not kept beside texts on their way
    cut = table(_cut(base.join(table(dup, "pfp-dup", f"{owner}-parse"), "row", "left"), length), "pfp-cut", owner, ["kind"])
    release(f"{owner}-parse")
    records = cut.filter("kind = 2").select("row", "z1", "z2", "phrase", "n", "lo", "hi", "left_n", "bytes")
    # what to compare is settled without the bytes, which then move for the heads of phrases with several heads only
    mine = f"{owner}-heads"
    light = table(records.groupBy("z1", "z2").agg(F.sum("n").alias("n"), F.first("phrase").alias("phrase")), "pfp-light", mine)
    whole = records.select("z1", "z2", "row", "lo", "hi").join(light.filter("n > 1").select("z1", "z2"), ["z1", "z2"], "left_semi").select("row", "lo", (F.col("hi") + length).alias("hi"))
    shared = light.groupBy("phrase").agg(F.count(F.lit(1)).alias("heads")).filter("heads > 1")
    tagged = table(light.join(shared, "phrase").select("z1", "z2", F.least("n", F.lit(2)).alias("n"), "phrase", "heads"), "pfp-tagged", mine)

    def heads(which: DataFrame) -> DataFrame:
        """One record of each head, with its bytes."""
        return records.select("z1", "z2", "row", "lo", "left_n", "bytes").join(which, ["z1", "z2"]).dropDuplicates(["z1", "z2"])

    few, many = tagged.filter(F.col("heads") <= CROWD), tagged.filter(F.col("heads") > CROWD)
    shards = max(1, -(-few.count() // SHARD_RECORDS))
    calm = heads(few).select("row", "z1", "z2", "n", "phrase", "lo", "left_n", "bytes", F.pmod(F.xxhash64("phrase"), F.lit(shards)).alias("shard"))
    ordered = calm.repartition(shards, "shard").groupBy("shard").applyInArrow(lambda t: _order_shard(t, length), "row long, lo long, hi long")
    crowd = heads(many).select("row", "n", "lo", "bytes").mapInArrow(lean(lambda x: _strings(x, length)), "row long, n long, at long, w1 long, w2 long")
    often = crowd.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("w1", "w2")
    more = crowd.filter("n = 1").join(often, ["w1", "w2"], "left_semi").select("row", F.col("at").alias("lo"), (F.col("at") + length).alias("hi"))
    spans = cut.filter("kind = 3").select("row", "lo", "hi").unionByName(whole).unionByName(ordered)
    if not many.isEmpty():
        spans = spans.unionByName(more)
    found = table(spans.groupBy("row").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "pfp-spans", owner)
    release(mine)
    return cut, found


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = column_bytes(batch.column("text"))
        n, gone, runs, sha = [], [], [], []
        spans = batch.column("spans").to_pylist()
        for d, own in enumerate(spans):
            text = data[offsets[d] : offsets[d + 1]]
            lo, hi = (np.array([x[k] for x in own or ()], np.int64) for k in ("lo", "hi"))
            _, lo, hi = merged(np.zeros(len(lo), np.int64), lo, hi)
            left, at = hashlib.sha256(), 0
            for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                left.update(text[at:a])
                at = b
            left.update(text[at:])
            n.append(len(text))
            gone.append(int((hi - lo).sum()))
            runs.append(len(lo))
            sha.append(left.hexdigest())
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})


def dedup_bytes(docs: DataFrame, length: int = LENGTH, owner: str = "query") -> DataFrame:
    """Each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    cut, spans = repeated_spans(docs, length, owner)
    zero = F.lit(0).cast("long")
    clean = cut.filter("kind = 0").select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.col("sha").alias("kept_sha256"))
    rest = cut.filter("kind = 1").select("row", "doc_id", "text").join(spans, "row", "left")
    return clean.unionByName(rest.select("doc_id", "text", "spans").mapInArrow(lean(_without), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
