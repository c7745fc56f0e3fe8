"""Substring deduplication on words: compressed FM-indexes of shards, searched backward by streamed documents.

Every word covered by a window of ``window`` consecutive words whose word sequence also starts in a document of a smaller
doc_id is removed. Windows are judged on the input. In steps:

1. Every window picks an anchor: the least hash among its ``gram``-word grams. Equal windows pick the same, at the same place.
   Anchors that occur in one document only need no further look: (anchor, document) rows tell which these are. What a row
   shares is gathered by row (a hash of id and text), so rows without an id are no hot group.
2. The windows that pick an anchor of several documents are cut out as segments, one for each stretch of windows with one
   anchor. Equal segments are one; all but the copies of the least doc_id go at once.
3. The first copy of each segment is dealt to a shard by its anchor, so equal windows meet there. A shard indexes its
   segments, in the order of their doc_id, as an FM-index (suffix order, wavelet matrix), and streams them against it:
   backward search with matching statistics, bounded to places before the segment's own document.
4. Anchors with more than ``CROWD`` distinct segments (more than a shard holds; say, a passage of a third of all documents) don't go to one
   shard: their windows are compared one by one through their hashes, wherever those lie.
5. The stretches found are put together by document and taken out; kept words are joined by one space.

Null or empty texts have no words. A null doc_id counts as larger than all others. Rows with the same doc_id never remove
each other's words. Words are compared by 64-bit hashes, windows of a crowd by 128-bit hashes. An empty table gives no rows.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import Rolling, chained, column_bytes, lean, signed, slices, table, word_hashes, words
from wayfold.llm.fmindex import earlier_matches

WINDOW = 50
GRAM = 10
SHARD_WORDS = 400_000
CROWD = SHARD_WORDS // (2 * WINDOW)
_LAST = (1 << 63) - 1
_PLACE = np.uint64((1 << 24) - 1)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    n = len(x)
    if n < width:
        return x[:0]
    padded = np.concatenate([x, np.full(-n % width, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(gram_hash: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows inside one text (``bounds``: word bounds of texts): text, first word and place of the anchor."""
    span = window - gram + 1
    count = np.maximum(bounds[1:] - bounds[:-1] - window + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    start = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(bounds[:-1], count)
    if not len(start):
        return text, start, start
    step = 1 << 23
    at = np.empty(len(start), np.int64)
    for lo in range(0, len(gram_hash), step):  # places must fit in 24 bits
        part = gram_hash[lo : lo + step + span - 1]
        least = sliding_min((part & ~_PLACE) | np.arange(len(part), dtype=np.uint64), span)
        mine = (start >= lo) & (start < lo + step)
        at[mine] = (least[start[mine] - lo] & _PLACE).astype(np.int64) + lo
    return text, start, at


def _parsed(data: np.ndarray, offsets: np.ndarray, i: int, j: int, gram: int):
    """Words and gram hashes of texts i to j."""
    part, offs = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
    starts, ends, bounds = words(part, offs)
    return part, starts, ends, bounds, chained(word_hashes(part, starts, ends), gram)


def _stretches(text: np.ndarray, start: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of consecutive windows of one text with one anchor: first and length among the windows."""
    first = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)])
    return first, np.diff(np.r_[first, len(start)])


def _anchor_rows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            key, row = batch.column("key").to_numpy(), batch.column("row").to_numpy()
            for i, j in slices(offsets):
                *_, bounds, grams = _parsed(data, offsets, i, j, gram)
                text, _, at = anchors(grams, bounds, window, gram)
                if len(at):
                    fresh = np.r_[True, at[1:] != at[:-1]]
                    pair = np.unique(np.stack([text[fresh], grams[at[fresh]].view(np.int64)]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(pair[1]), pa.array(key[i:j][pair[0]]), pa.array(row[i:j][pair[0]])], names=["anchor", "key", "row"])

    return docs.select("key", "row", "text").mapInArrow(lean(pick), "anchor long, key long, row long")


_CUT = "kind int, row long, key long, doc_id long, text string, n_words long, sha string, s1 long, s2 long, anchor long, at long, windows int, bytes binary"


def _cut(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """kind 0: finished documents; 1: documents with segments; 2: segments."""

    def kinds(kind: int, n: int, **columns: pa.Array) -> pa.RecordBatch:
        schema = pa.schema([(x.split()[0], {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]]) for x in _CUT.split(", ")])
        columns["kind"] = pa.array(np.full(n, kind, np.int32))
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            shared = batch.column("shared")
            shared_at, shared_of = shared.offsets.to_numpy(), shared.values.to_numpy()
            shared_n = np.where(np.asarray(shared.is_valid()), np.diff(shared_at), 0)
            key, row = batch.column("key").to_numpy(), batch.column("row").to_numpy()
            for i, j in slices(offsets):
                part, starts, ends, bounds, grams = _parsed(data, offsets, i, j, gram)
                raw, has = part.tobytes(), np.zeros(j - i, bool)
                busy = np.flatnonzero(shared_n[i:j])
                if len(busy):
                    text, start, at = anchors(grams, bounds, window, gram)
                    first, count = _stretches(text, start, at)
                    t, a = text[first], grams[at[first]].view(np.int64)
                    ok = np.zeros(len(first), bool)
                    lo, hi = np.searchsorted(t, busy), np.searchsorted(t, busy, side="right")
                    for d, x, y in zip(busy, lo, hi, strict=True):
                        ok[x:y] = np.isin(a[x:y], shared_of[shared_at[i + d] : shared_at[i + d + 1]])
                    first, count, t, a = first[ok], count[ok], t[ok], a[ok]
                    has[t] = True
                    w0 = start[first]
                    w1 = w0 + count + window - 1
                    spans = [raw[starts[x] : ends[y - 1]] for x, y in zip(w0, w1, strict=True)]
                    if len(first):
                        once, twice = Rolling(grams, 1, gram), Rolling(grams, 2, gram)
                        yield kinds(
                            2, len(first), row=pa.array(row[i:j][t]), key=pa.array(key[i:j][t]), s1=pa.array(signed(once.spans(w0, w1))), s2=pa.array(signed(twice.spans(w0, w1))),
                            anchor=pa.array(a), at=pa.array(w0 - bounds[t]), windows=pa.array(count.astype(np.int32)), bytes=pa.array(spans, pa.binary()),
                        )
                rest = np.flatnonzero(~has)
                sha = [hashlib.sha256(b" ".join(raw[starts[k] : ends[k]] for k in range(bounds[d], bounds[d + 1]))).hexdigest() for d in rest]
                yield kinds(0, len(rest), doc_id=batch.column("doc_id").slice(i, j - i).take(pa.array(rest)), n_words=pa.array(np.diff(bounds)[rest]), sha=pa.array(sha, pa.string()))
                some = pa.array(np.flatnonzero(has))
                if len(some):
                    yield kinds(1, len(some), row=pa.array(row[i:j]).take(some), key=pa.array(key[i:j]).take(some), doc_id=batch.column("doc_id").slice(i, j - i).take(some), text=batch.column("text").slice(i, j - i).take(some))

    return docs.select("row", "key", "doc_id", "text", "shared").mapInArrow(lean(cut), _CUT)


_ANSWER = "s1 long, s2 long, lo int, hi int"


def _search_shard(rows: pa.Table, window: int) -> pa.Table:
    """Stretches (in words of the segment) of every segment of a shard that start in a document of smaller key too."""
    rows = rows.sort_by([("least", "ascending"), ("s1", "ascending"), ("s2", "ascending")])
    data, offsets = column_bytes(rows.column("bytes"))
    starts, ends, bounds = words(data, offsets)
    symbol = np.unique(word_hashes(data, starts, ends), return_inverse=True)[1] + 1
    k = len(bounds) - 1
    seq = np.zeros(len(symbol) + k, np.int64)
    seq[np.arange(len(symbol)) + np.repeat(np.arange(k), np.diff(bounds))] = symbol
    first = bounds[:-1] + np.arange(k)
    key = rows.column("least").to_numpy()
    limit = first[np.searchsorted(key, key, side="left")]
    lane, lo, hi = earlier_matches(seq, first, np.diff(bounds), limit, window)
    at = pa.array(lane)
    return pa.table({"s1": rows.column("s1").take(at), "s2": rows.column("s2").take(at), "lo": pa.array(lo.astype(np.int32)), "hi": pa.array(hi.astype(np.int32))})


def _windows(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Every window of the segments, as two hashes."""
    for batch in batches:
        data, offsets = column_bytes(batch.column("bytes"))
        for i, j in slices(offsets):
            part, offs = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            starts, ends, bounds = words(part, offs)
            grams = chained(word_hashes(part, starts, ends), gram)
            count = np.diff(bounds) - window + 1
            of = np.repeat(np.arange(j - i), count)
            off = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            w0 = bounds[of] + off
            at = pa.array(of + i)
            yield pa.RecordBatch.from_arrays(
                [batch.column("s1").take(at), batch.column("s2").take(at), batch.column("least").take(at), pa.array(off.astype(np.int32)), pa.array(signed(Rolling(grams, 1, gram).spans(w0, w0 + window))), pa.array(signed(Rolling(grams, 2, gram).spans(w0, w0 + window)))],
                names=["s1", "s2", "least", "off", "w1", "w2"],
            )


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words of ``spans``."""
    for batch in batches:
        data, offsets = column_bytes(batch.column("text"))
        spans = batch.column("spans").to_pylist()
        n, gone, sha = [], [], []
        for i, j in slices(offsets):
            part, offs = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            starts, ends, bounds = words(part, offs)
            raw = part.tobytes()
            for d in range(j - i):
                a, b = bounds[d], bounds[d + 1]
                edge = np.zeros(b - a + 1, np.int64)
                for s in spans[i + d] or ():
                    edge[s["lo"]] += 1
                    edge[s["hi"]] -= 1
                keep = np.flatnonzero(np.cumsum(edge[:-1]) == 0) + a
                n.append(int(b - a))
                gone.append(int(b - a - len(keep)))
                sha.append(hashlib.sha256(b" ".join(raw[starts[k] : ends[k]] for k in keep)).hexdigest())
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, owner: str = "query") -> tuple[DataFrame, DataFrame]:
    """(cut, spans): the rows of ``_cut``, and for each row number with something to remove its spans (lo, hi) in words."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", F.coalesce("doc_id", F.lit(_LAST))).withColumn("row", F.xxhash64("doc_id", "text"))
    picked = table(_anchor_rows(base, window, gram), "sub-anchors", owner)
    # written tables as join sides: a join with an aggregate would tie the other side to its partitions, hot anchors and all
    several = table(picked.groupBy("anchor").agg(F.min("key").alias("x"), F.max("key").alias("y")).filter("x < y").select("anchor"), "sub-several", owner)
    shared = picked.join(several, "anchor", "left_semi").groupBy("row").agg(F.collect_set("anchor").alias("shared"))
    cut = table(_cut(base.join(shared, "row", "left"), window, gram), "sub-cut", owner, ["kind"])
    segments = cut.filter("kind = 2").select("row", "key", "s1", "s2", "anchor", "at", "windows", "bytes")
    heads = segments.groupBy("s1", "s2").agg(F.min("key").alias("least"), F.first("anchor").alias("anchor"), F.first("windows").alias("windows"), F.first("bytes").alias("bytes"))
    heads = table(heads, "sub-heads", owner)
    crowds = heads.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("least").alias("x"), F.max("least").alias("y"), F.sum(F.col("windows") + window).alias("words"))
    crowds = table(crowds.filter("x < y").select("anchor", "n", "words"), "sub-crowds", owner)  # alone or of one document: nothing earlier
    few, many = (crowds.filter(x) for x in (F.col("n") <= CROWD, F.col("n") > CROWD))
    shards = max(1, -(-(few.agg(F.sum("words")).first()[0] or 0) // SHARD_WORDS))
    calm = heads.join(few.select("anchor"), "anchor", "left_semi").select("least", "s1", "s2", "bytes", F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"))
    answers = calm.repartition(max(1, shards), "shard").groupBy("shard").applyInArrow(lambda t: _search_shard(t, window), _ANSWER)
    crowd = heads.join(many.select("anchor"), "anchor", "left_semi").select("s1", "s2", "least", "bytes").mapInArrow(lean(lambda x: _windows(x, window, gram)), "s1 long, s2 long, least long, off int, w1 long, w2 long")
    early = crowd.groupBy("w1", "w2").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    more = crowd.join(early, ["w1", "w2"]).filter(F.col("least") > F.col("first")).select("s1", "s2", F.col("off").alias("lo"), (F.col("off") + window).alias("hi"))
    found = table(answers.unionByName(more), "sub-answers", owner)
    places = segments.select("row", "key", "s1", "s2", "at", "windows").join(heads.select("s1", "s2", "least"), ["s1", "s2"])
    whole = places.filter("key > least").select("row", F.col("at").alias("lo"), (F.col("at") + F.col("windows") + (window - 1)).alias("hi"))
    some = places.filter("key = least").join(found, ["s1", "s2"]).select("row", (F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi"))
    return cut, table(whole.unionByName(some).groupBy("row").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "sub-spans", owner)


def dedup_words(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, owner: str = "query") -> DataFrame:
    """Each document: doc_id, n_words, n_removed, kept_sha256."""
    cut, spans = repeated_spans(docs, window, gram, owner)
    clean = cut.filter("kind = 0").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"))
    rest = cut.filter("kind = 1").select("row", "doc_id", "text").join(spans, "row", "left")
    return clean.unionByName(rest.select("doc_id", "text", "spans").mapInArrow(lean(_without), "doc_id long, n_words long, n_removed long, kept_sha256 string"))
