"""Registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfage.llm import clustering, decontaminate, divergence, fingerprint, langid, minhash, mixing, pii, recompress, records, suffix, topk, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, _read(spark, sf_dir, "documents"), shingle=2, similarity=80)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_read(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(spark, _read(spark, sf_dir, "pages"), min_revisit_bytes=0) \
        .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, _read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.roundtrip(spark, _read(spark, sf_dir, "documents"), end_id=1).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spark, _read(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(spark, _read(spark, sf_dir, "documents"), length=50)


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(topk.scaled(_read(spark, sf_dir, "embeddings"), 64), F.col("vec_id") % 20 == 0, k=20)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.remove_repeats(spark, _read(spark, sf_dir, "documents"), window=13) \
        .select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), window=10) \
        .select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_report(spark, _read(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(spark, _read(spark, sf_dir, "embeddings"), k=16, rounds=3, seed=1)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(spark, _read(spark, sf_dir, "documents"), min_docs=3, top=200)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_minhash_near_dedup, op2_pii, op3_warc, op4_mixing, op5_token_records, op6_language_id, op7_suffix_dedup,
        op8_exact_topk, op9_substring_dedup, op10_decontamination, op11_document_fingerprints, op12_centroid_clustering,
        op13_source_divergence)}


_TEXT_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SHINGLES = """list_sort(list_distinct(list_filter(list_transform(range(1, greatest(len({w}) - 4, least(len({w}), 1)) + 1),
  lambda i: substr(md5(array_to_string({w}[i:i + 4], ' ')), 1, 16)), lambda h: h < '2')))"""
_ALIKE = """CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 WHEN least(len({a}), len({b})) = 0 THEN 0.0
  ELSE len(list_intersect({a}, {b})) / least(len({a}), len({b})) END"""

# sketches of each text, its edited text and the next document's text
_OP11 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT *, lead(t) OVER w AS n1, first(t) OVER w AS n0, lead(doc_id) OVER w AS i1, first(doc_id) OVER w AS i0
      FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, left(t, length(t) - length(t) // 2) || left(nt, length(t) // 2) AS edited
      FROM (SELECT doc_id, t, coalesce(n1, n0) AS nt, coalesce(i1, i0) AS next_doc_id FROM n)),
w AS (SELECT *, {', '.join(f"regexp_extract_all({_LOWER.format(c)}, '[^\x20\x09-\x0D]+') AS w{i}" for i, c in enumerate(("t", "edited", "nt")))} FROM e),
h AS (SELECT *, {', '.join(f"{_SHINGLES.format(w=f'w{i}')} AS h{i}" for i in range(3))} FROM w)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, array_to_string(h0, ',') AS fingerprint,
  array_to_string(h1, ',') AS edited_fingerprint, CAST({_ALIKE.format(a='h0', b='h1')} AS DOUBLE) AS near_edited,
  CAST({_ALIKE.format(a='h0', b='h2')} AS DOUBLE) AS near_next, next_doc_id FROM h""".replace("\x20\x09-\x0D", r"\x20\x09-\x0D")


_SPACE_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

# all pairs with a common shingle, counted; components by reachability
_OP1 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_SPACE_WORDS.format(_LOWER.format('text'))} AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS sh FROM d),
t AS (SELECT r, len(sh) AS n, unnest(sh) AS x FROM s),
c AS (SELECT a.r AS a, b.r AS b, a.n AS na, b.n AS nb, count(*) AS common FROM t a JOIN t b ON a.x = b.x AND a.r <> b.r
      WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
e AS (SELECT a, b FROM c WHERE 100 * common >= 80 * (na + nb - common)),
g AS (SELECT r, r AS q FROM s UNION SELECT g.r, e.b FROM g JOIN e ON e.a = g.q),
m AS (SELECT g.r, min(s.doc_id) AS component_id FROM g JOIN s ON s.r = g.q GROUP BY g.r)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m USING (r)"""

# base32: five hexadecimal digits are four characters
_OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
b AS (SELECT *, max(page_id) OVER (PARTITION BY t) AS best, sha1(t) AS h FROM p)
SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM best AND best IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM best THEN best END AS refers_to FROM b"""

# every 50-byte string (as hexadecimal digits, cut from chunks that overlap), and the smallest document that starts it
_OP7 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT r, doc_id, b, substr(x, 2 * b + 1, 1122) AS y FROM (SELECT r, doc_id, x, unnest(range(0, len(x) // 2, 512)) AS b FROM d)),
o AS (SELECT r, doc_id, b + unnest(range(0, l)) AS i, unnest(list_transform(range(0, l), lambda j: substr(y, 2 * j + 1, 100))) AS s
      FROM (SELECT *, least(512, len(y) // 2 - 49) AS l FROM c) WHERE l > 0),
m AS (SELECT s, min(doc_id) AS least FROM o GROUP BY s),
h AS (SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 50, true) AS fresh FROM o JOIN m USING (s) WHERE doc_id > m.least),
u AS (SELECT r, min(i) AS a, max(i) + 50 AS z FROM (SELECT r, i, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY r ORDER BY i) AS run FROM h) GROUP BY r, run),
q AS (SELECT r, a, z, a AS upto, lag(z, 1, 0) OVER (PARTITION BY r ORDER BY a) AS since FROM u
      UNION ALL SELECT d.r, NULL, NULL, any_value(len(x)) // 2, coalesce(max(z), 0) FROM d LEFT JOIN u ON u.r = d.r GROUP BY d.r),
k AS (SELECT q.r, string_agg(substr(x, 2 * since + 1, 2 * (upto - since)), '' ORDER BY since) AS kept, coalesce(sum(z - a), 0) AS gone, count(a) AS spans
      FROM q JOIN d ON d.r = q.r GROUP BY q.r)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(gone AS BIGINT) AS n_removed, CAST(spans AS BIGINT) AS n_spans,
  sha256(unhex(kept)) AS kept_sha256 FROM d JOIN k ON k.r = d.r"""

# every window's words as one string, and the smallest document that starts it
_OP9 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SPACE_WORDS.format("coalesce(text, '')")} AS w FROM documents),
o AS (SELECT r, doc_id, unnest(range(1, len(w) - 11)) AS i, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS s
      FROM d WHERE len(w) >= 13),
m AS (SELECT s, min(doc_id) AS least FROM o GROUP BY s),
g AS (SELECT DISTINCT r, j FROM (SELECT r, unnest(range(i, i + 13)) AS j FROM o JOIN m USING (s) WHERE doc_id > least)),
p AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d),
k AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY j) AS kept FROM p ANTI JOIN g USING (r, j) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)"""


def _op12() -> str:
    """Every vector against every centroid, three rounds spelled out."""
    def assigned(r: int) -> str:
        return f"""a{r} AS (SELECT rid, cluster, d FROM (SELECT rid, cluster, d, row_number() OVER (PARTITION BY rid ORDER BY d, cluster) AS o
  FROM (SELECT v.rid, c.cluster, CAST(list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i]))) AS BIGINT) AS d
        FROM v, c{r} c)) WHERE o = 1)"""
    rounds = []
    for r in range(3):
        rounds.append(assigned(r))
        rounds.append(f"""m{r} AS (SELECT cluster, list((s - (((s % n) + n) % n)) // n ORDER BY i) AS q
  FROM (SELECT cluster, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
        FROM (SELECT a.cluster, unnest(v.q) AS x, unnest(range(1, 65)) AS i FROM a{r} a JOIN v USING (rid)) GROUP BY cluster, i) GROUP BY cluster),
c{r + 1} AS (SELECT c.cluster, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN m{r} m USING (cluster))""")
    return f"""
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
           WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY h, q) AS INTEGER) - 1 AS cluster, q
       FROM (SELECT q, sha256('1:' || vec_id) AS h FROM v WHERE vec_id IS NOT NULL ORDER BY h, q LIMIT 16)),
{", ".join(rounds)},
{assigned(3)},
s AS (SELECT cluster, sum(d) AS si FROM a3 GROUP BY cluster)
SELECT v.vec_id, CAST(a3.cluster AS INTEGER) AS cluster, a3.d AS distance, CAST(si AS BIGINT) AS cluster_inertia,
  CAST((SELECT sum(d) FROM a3) AS BIGINT) AS inertia, sha256(array_to_string(c3.q, ',')) AS centroid_sha256
FROM a3 JOIN v USING (rid) JOIN c3 USING (cluster) JOIN s USING (cluster)"""


# every kept term for every pair of sources of a language
_OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT o.lang, o.source, o.term, count(*) AS c FROM o JOIN k ON o.lang = k.lang AND o.term = k.term GROUP BY ALL),
n AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS (SELECT n.lang, n.source, k.term, coalesce(c.c, 0) AS c,
        1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.c, 0) + 1)) // CAST(n.n + v.v AS HUGEINT) AS p
      FROM n JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
q AS (SELECT k.lang, k.term, 1 + (CAST(1000000000 AS HUGEINT) * (k.n + 1)) // CAST(v.n + v.v AS HUGEINT) AS q FROM k JOIN v USING (lang)),
t AS (SELECT p.lang, p.source, p.term AS item, ((p.p - q.q) * (p.p - q.q)) // q.q AS value
      FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.c > 0 AND p.p > q.q),
r AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
      UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM t)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 200"""


def oracle_sql() -> dict[str, str]:
    return {
        # every vector against every query, by the plain definition
        "op8_exact_topk": """
WITH v AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""",
        # windows of the benchmark looked up at every place of every document
        "op10_decontamination": f"""
WITH b AS (SELECT item_id, {_TEXT_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS phrase
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT n FROM p),
d AS (SELECT doc_id, {_TEXT_WORDS} AS w FROM documents),
o AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, k WHERE len(w) >= n)),
h AS (SELECT o.doc_id, o.i, o.n, p.item_id FROM o JOIN p ON o.n = p.n AND o.phrase = p.phrase),
hw AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)""",
        "op1_minhash_near_dedup": _OP1,
        "op3_warc": _OP3,
        "op7_suffix_dedup": _OP7,
        "op9_substring_dedup": _OP9,
        "op11_document_fingerprints": _OP11,
        "op12_centroid_clustering": _op12(),
        "op13_source_divergence": _OP13,
    }
