"""Language identification by nearest centroid.

A text is the vector of its byte n-grams (1 to 3 bytes, hashed into ``DIMS`` places, lower-case ASCII), weighed by
log(1 + tf) * idf and normalised. Each language has several centroids, found by spherical k-means over a sample of labelled
rows. The language is that of the centroid of largest cosine where only letters are looked at (other ASCII bytes count as
blanks). Rejection looks at all bytes: a text is rejected when its cosine with the nearest centroid lies below what texts of
its length show in training (the far-out fence Q1 - 3 IQR of the sample's cosines, by power of two of the length). Every
length has a fence. Cosines fall with very long texts, so those longer than the sample shows are judged by the mean cosine of
equal windows, each as long as a class that the sample fills. Those shorter than it shows are judged by beginnings of sample
texts cut to their length, and a gap between filled classes by the lower fence of its neighbours. A sample of less than
``FEW`` rows has no quartiles to trust: its fences are half the lower quartile of cosines with the nearest other row
(an eighth of that with its own beginning where it is alone).

Fitting takes at most ``sample_rows`` labelled rows to one task (spread evenly over languages, one a language at least, those
of least hash of id and text); that is the only bound, prediction reads every whole text. The model has ``clusters`` centroids
a language, so it grows with the number of distinct labels, which a table of languages bounds. Null texts and texts without a letter are ``und`` with score 0 and count
as rejected. Without any labelled row every text is ``und``. Labels are never inputs of a prediction; ties go to the smaller
language name. Repeated rows, null ids and very long texts (read in parts, never cut) need no care.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import LOWER, column_bytes, lean

DIMS = 4096
SAMPLE_ROWS = 4000
CLUSTERS = 3
FEW = 30
HEAD = 2048  # bytes kept of the beginning of each sample text
_STEP = 1 << 20
_MUL = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


#: Bytes as letters: ASCII lower-cased, what is no letter in ASCII a blank, the rest as it is.
LETTERS = np.where((LOWER >= 97) & (LOWER <= 122) | (np.arange(256) >= 128), LOWER, 32).astype(np.uint8)


def counts(text: np.ndarray, as_bytes: np.ndarray = LOWER) -> np.ndarray:
    """n-gram counts of one text (bytes), with a blank on either side; long texts go in parts."""
    out = np.zeros(DIMS, np.int64)
    n = len(text)
    for at in range(0, max(n, 1), _STEP):
        part = text[max(0, at - 2) : at + _STEP]
        lead = min(at, 2)
        b = np.empty(len(part) + (at == 0) + (at + _STEP >= n), np.uint32)
        b[0] = 32
        b[(at == 0) : (at == 0) + len(part)] = as_bytes[part]
        if at + _STEP >= n:
            b[-1] = 32
        shift = np.uint32(32 - DIMS.bit_length() + 1)
        one = (b * _MUL[0]) >> shift
        two = ((b[:-1] | b[1:] << np.uint32(8)) * _MUL[1]) >> shift
        three = ((b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)) * _MUL[2]) >> shift
        out += np.bincount(np.concatenate([one[lead:], two[max(0, lead - 1) :], three]), minlength=DIMS)
    return out


@dataclass
class Centroids:
    idf: np.ndarray
    rows: np.ndarray  # a centroid each
    of: np.ndarray  # language of each

    def cosines(self, c: np.ndarray) -> np.ndarray:
        v = np.log1p(c).astype(np.float32) * self.idf
        norm = float(np.sqrt(v @ v))
        return self.rows @ (v / norm if norm else v)


@dataclass
class Model:
    languages: list[str]
    letters: Centroids | None = None
    whole: Centroids | None = None
    fences: np.ndarray | None = None  # by log2 of the text's length
    longest: int = 0  # log2 of the length from which texts go in windows
    judge: int = 0  # log2 of the length of these windows

    def predict(self, text: np.ndarray) -> tuple[str, float, bool]:
        if not self.languages:
            return "und", 0.0, True
        cosines = self.letters.cosines(counts(text, LETTERS))
        best = int(np.argmax(cosines))
        return self.languages[self.letters.of[best]], float(min(1.0, max(0.0, cosines[best]))), self.far(text)

    def far(self, text: np.ndarray) -> bool:
        n = len(text)
        if n.bit_length() <= self.longest:
            return float(self.whole.cosines(counts(text)).max()) < self.fences[n.bit_length()]
        parts = -(-n // ((1 << self.judge) - 1))
        near = [float(self.whole.cosines(counts(text[n * k // parts : n * (k + 1) // parts])).max()) for k in range(parts)]
        return sum(near) / parts < self.fences[self.judge]


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(8):
        near = np.argmax(x @ c.T, axis=1)
        for j in range(k):
            if (mine := near == j).any():
                m = x[mine].mean(axis=0)
                c[j] = m / max(float(np.linalg.norm(m)), 1e-12)
    return c


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, clusters: int = CLUSTERS, seed: int = 11) -> Model:
    """Fit on rows of ``docs`` (doc_id, text, lang) with a label and a letter."""
    good = docs.filter("lang is not null and text is not null").filter(F.col("text").rlike(r"\p{L}"))
    by = {r["lang"]: r["n"] for r in docs.filter("lang is not null and text is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not by:
        return Model([])
    each = max(1, sample_rows // len(by))
    share = F.create_map(*[F.lit(x) for lang, n in by.items() for x in (lang, min(1.0, 2 * each / n))])
    draw = good.select("lang", "text", F.xxhash64("doc_id", "text", F.lit(seed)).alias("draw"))
    unit = F.pmod(F.col("draw"), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def least(rows: DataFrame) -> DataFrame:
        """The rows of least draw, ``each`` of a language."""
        return rows.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).filter(F.col("rn") <= each).select("lang", "text")

    sample = least(draw.filter(unit < share[F.col("lang")]))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = column_bytes(batch.column("text"))
            out: list[list[bytes]] = [[], [], [], [], []]
            for a, b in zip(offs[:-1], offs[1:], strict=True):
                for k, kind in ((0, LETTERS), (2, LOWER)):
                    c = counts(data[a:b], kind)
                    at = np.flatnonzero(c)
                    out[k].append(at.astype("<u2").tobytes())
                    out[k + 1].append(np.log1p(c[at]).astype("<f4").tobytes())
                out[4].append(data[a : min(b, a + HEAD)].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(np.diff(offs)), *[pa.array(x, pa.binary()) for x in out]], names=["lang", "n", "i0", "v0", "i1", "v1", "head"])

    def model(rows: DataFrame) -> Model:
        """Learned in one task: the sample never comes to the driver, whose Python and JVM would hold it side by side."""
        found = rows.mapInArrow(lean(vectors), "lang string, n long, i0 binary, v0 binary, i1 binary, v1 binary, head binary")
        got = found.repartition(1).mapInArrow(lean(learned), "model binary").collect()
        return pickle.loads(got[0]["model"]) if got else Model([])

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if rows := [r for batch in batches for r in batch.to_pylist()]:
            yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(_learned(rows, clusters, seed))], pa.binary())})

    out = model(sample)
    if missed := sorted(set(by) - set(out.languages)):  # few texts over and over may all have missed the draw
        out = model(sample.unionByName(least(draw.filter(F.col("lang").isin(missed)))))
    return out


def _learned(rows: list[dict], clusters: int, seed: int) -> Model:
    """The model of sample rows: lang, n (bytes), i0, v0 (letters' n-grams and their log counts), i1, v1 (all bytes'), head."""
    rows.sort(key=lambda r: (r["lang"], r["i0"], r["v0"], r["i1"], r["v1"]))
    languages = sorted({r["lang"] for r in rows})
    own = np.array([languages.index(r["lang"]) for r in rows], dtype=int)
    size = np.array([int(r["n"]).bit_length() for r in rows])

    def learn(kind: int) -> tuple[Centroids, np.ndarray]:  # and the rows' vectors
        x = np.zeros((len(rows), DIMS), np.float32)
        for i, r in enumerate(rows):
            x[i, np.frombuffer(r[f"i{kind}"], "<u2")] = np.frombuffer(r[f"v{kind}"], "<f4")
        idf = np.log((1 + len(rows)) / (1 + np.count_nonzero(x, axis=0))).astype(np.float32) + np.float32(0.1)
        x *= idf
        x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], 1e-12)  # without a second matrix
        rng = np.random.default_rng(seed)
        found = [_kmeans(x[own == j], clusters, rng) for j in range(len(languages))]
        got = Centroids(idf, np.concatenate(found), np.repeat(np.arange(len(languages)), [len(c) for c in found]))
        return got, x

    letters = learn(0)[0]
    whole, x = learn(1)
    few = len(rows) < FEW

    def nearest(vectors: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The largest cosine of each vector, made of a sample row, with a centroid; of few rows, with another row."""
        if not few:
            return (vectors @ whole.rows.T).max(axis=1)
        cosines = vectors @ x.T
        if len(rows) > 1:
            cosines[np.arange(len(row)), row] = -1
        return cosines.max(axis=1)

    def fence(near: np.ndarray) -> float:
        q1, q3 = np.quantile(near, [0.25, 0.75])
        return max(0.0, float(q1 - 3 * (q3 - q1) if not few else q1 / 2 if len(rows) > 1 else q1 / 8))

    best = nearest(x, np.arange(len(rows)))
    fences = np.full(33, np.nan)
    for k in range(33):
        near = best[size == k] if (size == k).sum() >= FEW else best[np.abs(size - k) <= 2]
        if len(near) >= FEW:
            fences[k] = fence(near)
    filled = np.flatnonzero(~np.isnan(fences))
    longest = int(filled[-1] if len(filled) else size.max())
    judge = max((k for k in range(longest + 1) if (size == k).sum() >= FEW), default=longest)
    for k in range(1, int(filled[0]) if len(filled) else longest + 1):
        length = max(1, (3 << k) >> 2)
        able = np.array([i for i, r in enumerate(rows) if len(r["head"]) >= length], dtype=int)
        if len(able) >= min(FEW, len(rows) // 2 + 1):
            near = []
            for lo in range(0, len(able), 256):  # a few at a time: one full matrix is held already
                part = able[lo : lo + 256]
                v = np.stack([np.log1p(counts(np.frombuffer(rows[i]["head"][:length], np.uint8))).astype(np.float32) for i in part]) * whole.idf
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                near.append(nearest(v, part))
            fences[k] = fence(np.concatenate(near))
    if np.isnan(fences[longest]):  # no class is filled
        fences[longest] = fence(best[size >= longest - 2])
    filled = np.flatnonzero(~np.isnan(fences))
    for k in np.flatnonzero(np.isnan(fences)):
        fences[k] = min(fences[j] for j in (*filled[filled < k][-1:], *filled[filled > k][:1]))
    return Model(languages, letters, whole, fences, longest, judge)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score and rejected, from ``text`` alone."""
    docs = docs.drop("lang_pred", "score", "rejected")  # columns of these names give way
    names = docs.columns
    schema = docs.select(*names, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("rejected")).schema
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred KB for each language, whatever the corpus

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            lettered = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_pylist()
            data, offs = column_bytes(text)
            got = [model.predict(data[offs[i] : offs[i + 1]]) if ok else ("und", 0.0, True) for i, ok in enumerate(lettered)]
            columns = [*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([bool(g[2]) for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "lang_pred", "score", "rejected"])

    return docs.mapInArrow(lean(tell), schema)


def held_out(doc_id) -> object:
    """Whether crc32 of the id's text leaves 2 modulo 4 (a null id: the empty text's crc32)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2
