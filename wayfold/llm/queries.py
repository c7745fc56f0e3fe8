"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfold.llm import langid

    docs = read_table(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"))
    model = langid.fit(docs.filter(~out).select("doc_id", "text", "lang"))
    told = langid.identify(docs.select("doc_id", "text"), model)
    return told.select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfold.llm import lines

    out = lines.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


ORACLE["op3_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, text, i, string_split(text, chr(10))[i] AS raw, trim(string_split(text, chr(10))[i], ' ') AS x
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)
), s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j FROM l WHERE x <> ''),
w AS (SELECT doc_id, j, x || chr(10) || lead(x, 1) OVER p || chr(10) || lead(x, 2) OVER p AS k FROM s WINDOW p AS (PARTITION BY doc_id ORDER BY j)),
f AS (SELECT k, min(struct_pack(d := doc_id, j := j)) AS f FROM w WHERE k IS NOT NULL GROUP BY k),
m AS (SELECT w.doc_id, w.j FROM w JOIN f USING (k) WHERE struct_pack(d := w.doc_id, j := w.j) > f.f),
dead AS (SELECT DISTINCT doc_id, j + o AS j FROM m, (VALUES (0), (1), (2)) t(o)),
z AS (SELECT l.doc_id, l.i, l.raw, s.j, dead.j AS gone FROM l LEFT JOIN s USING (doc_id, i) LEFT JOIN dead ON dead.doc_id = s.doc_id AND dead.j = s.j),
g AS (SELECT doc_id, count(j) AS n_lines, count(gone) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (WHERE gone IS NULL), '') AS kept FROM z GROUP BY doc_id)
SELECT d.doc_id, coalesce(g.n_lines, 0)::INT AS n_lines, coalesce(g.n_removed, 0)::INT AS n_removed, md5(coalesce(g.kept, '')) AS kept_md5
FROM documents d LEFT JOIN g USING (doc_id)
"""


@query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfold.llm import warc

    return warc.records(warc.archive_pages(read_table(spark, sf_dir, "pages")))


ORACLE["op4_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS d FROM p),
k AS (SELECT d, max(page_id) AS kept FROM h WHERE n >= 1000 GROUP BY d)
SELECT h.page_id, h.n::BIGINT AS payload_bytes, h.d AS payload_digest,
  CASE WHEN k.kept <> h.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN k.kept <> h.page_id THEN k.kept END AS refers_to, true AS digest_ok
FROM h LEFT JOIN k ON k.d = h.d
"""


@query
def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfold.llm import mixing

    placed, slots = mixing.mix_sources(read_table(spark, sf_dir, "documents"))
    return mixing.taken(placed, slots).select("doc_id", "source", "size", "source_size", "target", "taken")


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfold.llm import packing

    return packing.pack_documents(read_table(spark, sf_dir, "documents")).drop("row_no")


@query
def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfold.llm import hamming

    codes, bits = hamming.sign_codes(read_table(spark, sf_dir, "embeddings"))
    return hamming.search(codes, bits, lambda c: F.pmod(c, F.lit(20)) == 0)


ORACLE["op5_exact_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS b FROM embeddings WHERE vec_id IS NOT NULL),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.b, c.b), lambda x: (x[1] <> x[2])::INT))::INT AS distance
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""


@query
def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfold.llm import ann

    return ann.search(read_table(spark, sf_dir, "embeddings"), lambda c: F.pmod(c, F.lit(50)) == 0)


@query
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfold.llm import jaccard

    return jaccard.near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
ORACLE["op10_jaccard_join"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5_number(t) AS t FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS t FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS c FROM u UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.doc_id WHERE r.c < u.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(m.c, d.doc_id), d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) m USING (doc_id)
"""


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfold.llm import substrings

    return substrings.dedup_words(read_table(spark, sf_dir, "documents"))


ORACLE["op6_substring_dedup"] = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
v AS (SELECT doc_id, i, md5_number(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
f AS (SELECT h, min(doc_id) AS least FROM v GROUP BY 1),
g AS (SELECT v.doc_id, v.i FROM v JOIN f USING (h) WHERE v.doc_id > f.least),
x AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
e AS (SELECT doc_id, i, sum(d) AS d FROM (SELECT doc_id, i, 1 AS d FROM g UNION ALL SELECT doc_id, i + 50, -1 FROM g) GROUP BY ALL),
z AS (SELECT x.doc_id, x.i, word, sum(coalesce(e.d, 0)) OVER (PARTITION BY x.doc_id ORDER BY x.i) > 0 AS gone FROM x LEFT JOIN e ON e.doc_id = x.doc_id AND e.i = x.i),
k AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM z GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""


@query
def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfold.llm import prefixfree

    return prefixfree.dedup_bytes(read_table(spark, sf_dir, "documents"))


ORACLE["op2_suffix_array_dedup"] = """
WITH b AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
v AS (SELECT r, i, md5_number(substr(x, 2 * i + 1, 400)) AS h FROM (SELECT r, x, unnest(range(0, length(x) // 2 - 199)) AS i FROM b WHERE length(x) >= 400)),
m AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM v) WHERE n > 1),
g AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM m),
s AS (SELECT r, min(i) AS lo, max(i) + 200 AS hi FROM (SELECT *, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS k FROM g) GROUP BY r, k),
k AS (SELECT r, count(*) AS n_spans, sum(hi - lo)::BIGINT AS n_removed, list(lo ORDER BY lo) AS los, list(hi ORDER BY lo) AS his FROM s GROUP BY r),
t AS (SELECT b.*, n_spans, n_removed, list_concat([0], his) AS a, list_concat(los, [length(x) // 2]) AS z FROM b LEFT JOIN k USING (r))
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN n_spans IS NULL THEN unhex(x) ELSE unhex(array_to_string(list_transform(range(1, len(a) + 1), lambda j: substr(x, 2 * a[j] + 1, 2 * (z[j] - a[j]))), '')) END) AS kept_sha256
FROM t
"""
