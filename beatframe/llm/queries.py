"""Registered queries of the operators and SQL of the same meaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from beatframe.llm.language_id import language, learn_languages
from beatframe.llm.lexical_search import search
from beatframe.llm.line_dedup import remove_repeated_lines
from beatframe.llm.mixing import mix_sources
from beatframe.llm.near_dedup import near_duplicates
from beatframe.llm.packing import pack_documents
from beatframe.llm.personal_data import KINDS, find_personal_data, joined
from beatframe.llm.quality_classifier import crc_remainder, learn_quality, quality_score
from beatframe.llm.quality_rules import quality_rules
from beatframe.llm.resampling import resample
from beatframe.llm.substring_dedup import remove_shared_words
from beatframe.llm.suffix_dedup import remove_earlier_bytes
from beatframe.llm.vector_search import top_k_products

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_quality_classifier")
def op1(spark, sf):
    docs = table(spark, sf, "documents")
    left = crc_remainder("doc_id", 3)
    params = learn_quality(docs, table(spark, sf, "labels"), allowed=left != 1)
    scored = docs.select("doc_id", F.coalesce(left == 1, F.lit(False)).alias("held_out"), quality_score(F.col("text"), params).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op2_quality_rules")
def op2(spark, sf):
    return quality_rules(table(spark, sf, "documents"))


@query("op3_mix_sources")
def op3(spark, sf):
    r = mix_sources(table(spark, sf, "documents"))
    return r.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op4_suffix_dedup")
def op4(spark, sf):
    r = remove_earlier_bytes(table(spark, sf, "documents"))
    return r.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_near_dedup", """WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(
 translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1),
 lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM d),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
 HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
u AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(node, reach) AS (SELECT doc_id, doc_id FROM g UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.reach),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node)
SELECT g.doc_id, CAST(len(g.s) AS BIGINT) AS n_shingles, c.component_id, g.doc_id = c.component_id AS kept FROM g JOIN c ON c.node = g.doc_id""")
def op5(spark, sf):
    return near_duplicates(table(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


@query("op6_language_id")
def op6(spark, sf):
    docs = table(spark, sf, "documents")
    left = crc_remainder("doc_id", 4)
    params, names = learn_languages(docs, allowed=left != 2)
    return docs.select("doc_id", F.coalesce(left == 2, F.lit(False)).alias("held_out"), language(F.col("text"), params, names).alias("p")).select(
        "doc_id", "held_out", "p.lang_pred", "p.score")


@query("op7_substring_dedup")
def op7(spark, sf):
    r = remove_shared_words(table(spark, sf, "documents"))
    return r.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


@query("op8_vector_search", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) e FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) score FROM v q JOIN v c ON c.vec_id <> q.vec_id
 AND len(c.e) = len(q.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20""")
def op8(spark, sf):
    return top_k_products(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op9_pack_documents")
def op9(spark, sf):
    return pack_documents(table(spark, sf, "documents"))


@query("op10_line_dedup", """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l WHERE trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''),
w AS (SELECT a.doc_id, a.k, a.i AS i1, b.i AS i2, a.line AS l1, b.line AS l2 FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.k = a.k + 1),
g AS (SELECT *, row_number() OVER (PARTITION BY l1, l2 ORDER BY doc_id, k) AS nth FROM w),
x AS (SELECT doc_id, i1 AS i FROM g WHERE nth > 1 UNION SELECT doc_id, i2 FROM g WHERE nth > 1),
t AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS kept FROM l LEFT JOIN x ON x.doc_id = l.doc_id AND x.i = l.i WHERE x.i IS NULL GROUP BY 1)
SELECT d.doc_id, (SELECT count(*) FROM c WHERE c.doc_id = d.doc_id) AS n_lines, (SELECT count(*) FROM x WHERE x.doc_id = d.doc_id) AS n_removed,
 sha256(coalesce(t.kept, '')) AS kept_sha256 FROM d LEFT JOIN t ON t.doc_id = d.doc_id""")
def op10(spark, sf):
    r = remove_repeated_lines(table(spark, sf, "documents"))
    return r.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.encode(F.coalesce("row.text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


@query("op11_lexical_search", """WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
c AS (SELECT count(*) AS all_docs, CAST(sum(len(ts)) AS BIGINT) AS all_terms FROM t WHERE len(ts) > 0),
f AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM t) GROUP BY r, term),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark)),
w AS (SELECT term, CAST(floor(1000 * ln((2 * all_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, c GROUP BY term, all_docs),
m AS (SELECT r, doc_id, 100 - 50 + ((50 * len(ts) * all_docs) // all_terms) AS m FROM t, c),
s AS (SELECT q.item_id, f.r, sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 20 * m.m))) AS score FROM q JOIN f ON f.term = q.term JOIN w ON w.term = q.term
 JOIN m ON m.r = f.r GROUP BY q.item_id, f.r),
o AS (SELECT s.item_id, CAST(row_number() OVER (PARTITION BY s.item_id ORDER BY s.score DESC, m.doc_id) AS INT) AS rank, m.doc_id, CAST(s.score AS BIGINT) AS score
 FROM s JOIN m ON m.r = s.r WHERE s.score > 0)
SELECT * FROM o WHERE rank <= 50""")
def op11(spark, sf):
    return search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op12_importance_resampling", """WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tab),
d AS (SELECT row_number() OVER () AS r, doc_id, sha256(coalesce(text, '')) AS tie, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
x AS (SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
 list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM (SELECT r, w FROM d UNION ALL SELECT 0, w FROM b)),
g AS (SELECT r, f, count(*) AS n FROM x GROUP BY r, f),
h AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM g)),
c AS (SELECT f, xor(list_reduce(list_transform(range(len(h) // 2), lambda k: CAST('0x' || substr(h, 2 * k + 1, 2) AS BIGINT)),
 lambda c, y: xor(tab[1 + (xor(c, y) & 255)], c >> 8), 4294967295), 4294967295) % 10000 AS k FROM h, tab),
s AS (SELECT k, sum(CASE WHEN r > 0 THEN n ELSE 0 END) AS s, sum(CASE WHEN r = 0 THEN n ELSE 0 END) AS t FROM g JOIN c ON c.f = g.f GROUP BY k),
z AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM s),
a AS (SELECT k, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) AS gain FROM s, z),
v AS (SELECT g.r, sum(g.n) AS n_features, sum(g.n * a.gain) AS weight FROM g JOIN c ON c.f = g.f JOIN a ON a.k = c.k WHERE g.r > 0 GROUP BY g.r),
o AS (SELECT d.r, d.doc_id, d.tie, len(w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST(coalesce(weight, 0)
 + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
 FROM d LEFT JOIN v ON v.r = d.r),
p AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, tie) AS rank FROM o WHERE n_words >= 20)
SELECT o.doc_id, o.n_features, o.weight, o.score, CASE WHEN p.rank <= 5 * (SELECT count(*) FROM p) // 100 THEN p.rank END AS rank FROM o LEFT JOIN p ON p.r = o.r""")
def op12(spark, sf):
    return resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op13_personal_data")
def op13(spark, sf):
    r = find_personal_data(table(spark, sf, "documents")).withColumn("base", F.filter("spans", lambda s: s["base"]))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return r.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
