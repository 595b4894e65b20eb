"""The registered queries of this subpackage: each operator over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dynofleet.llm import boosting, chunking, hosts, licences, neighbours, packing, phrases, repair, rules, setjoin, subword, suffixes, whitening
from dynofleet.llm.common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subword.round_trip_digests(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op2_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.removal_digests(table(spark, sf_dir, "documents"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.deduplicated(table(spark, sf_dir, "documents"), length=100)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


URL_RULES = [
    hosts.UrlRule("com/", "allow"),
    hosts.UrlRule("example.com/en/", "block"),
    hosts.UrlRule("www.example.com/en/", "allow"),
    hosts.UrlRule("net/es/", "block"),
    hosts.UrlRule("net/fr/", "block"),
]


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.judged(table(spark, sf_dir, "pages"), URL_RULES)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = boosting.learn(docs, table(spark, sf_dir, "labels"))
    return boosting.score(docs, model).select("doc_id", boosting.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.near_duplicates(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rules.judged(docs, rules.learn(docs, table(spark, sf_dir, "labels")))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whitened(table(spark, sf_dir, "embeddings"), most=8)
    return found.withColumn("deviation", F.col("deviation").cast("long"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(table(spark, sf_dir, "conversations"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.fingerprinted(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


#: Every 100-byte string with its first place, and the bytes that no later one covers.
OP4_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pos AS (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS p FROM d),
s AS (SELECT doc_id, p, substr(h, 2 * p + 1, 2) AS byte, CASE WHEN 2 * p + 200 <= length(h) THEN md5(substr(h, 2 * p + 1, 200)) END AS string FROM pos),
k AS (SELECT *, row_number() OVER (PARTITION BY string ORDER BY doc_id, p) AS n FROM s),
c AS (SELECT *, coalesce(max(CASE WHEN string IS NOT NULL AND n > 1 THEN p END) OVER (PARTITION BY doc_id ORDER BY p) >= p - 99, FALSE) AS gone FROM k),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), FALSE) AS begins FROM c),
r AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, coalesce(string_agg(byte, '' ORDER BY p) FILTER (NOT gone), '') AS kept FROM e GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""

#: All pairs that share a shingle, and what links reach.
OP7_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS l FROM documents),
g AS (SELECT doc_id, unnest(range(1, greatest(len(l) - 2, 1) + 1)) AS i, l FROM w WHERE len(l) > 0),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(l[i:i + 2], chr(1))) AS h FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 90 * (x.n + y.n - both_)),
t AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS id, b AS seen FROM t UNION SELECT r.id, t.b FROM r JOIN t ON t.a = r.seen)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.low, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT id AS doc_id, min(seen) AS low FROM r GROUP BY id) m USING (doc_id)
"""

#: The checksum bit by bit, faults by windows, then edits row by row: each step keeps the best of every state.
OP12_SQL = r"""
WITH RECURSIVE w AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
crc AS (SELECT *, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), range(0, 8 * length(key))), lambda c, k:
  xor(CASE WHEN k % 8 = 0 THEN xor(c, ascii(substr(key, CAST(k // 8 + 1 AS INTEGER), 1))) ELSE c END >> 1,
    CASE WHEN (CASE WHEN k % 8 = 0 THEN xor(c, ascii(substr(key, CAST(k // 8 + 1 AS INTEGER), 1))) ELSE c END) % 2 = 1 THEN 3988292384 ELSE 0 END))) % 20 AS kind FROM w),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM crc),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text)) AS i,
  right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last FROM d),
f AS (SELECT *, substr(role, 1, 1) AS initial, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM n),
g AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM f),
counts AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id),
moves(p, initial, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
inserts(p, q, cost, edits) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 3, 'I'), (1, 2, 3, 'I'), (2, 3, 3, 'I'), (3, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 3, 6, 'II')),
edits AS (SELECT conv_id, i, p, p AS q, 4 AS cost, 'D' AS edit FROM f, (VALUES (0), (1), (2), (3)) s(p)
  UNION ALL SELECT conv_id, i, p, q, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END, 'K' FROM f JOIN moves USING (initial) WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL SELECT conv_id, i, p, q, CASE fault WHEN 'truncated' THEN 6 ELSE 3 END, 'R' FROM f JOIN moves m ON m.initial <> 's' WHERE fault NOT IN ('blank', 'duplicate')),
steps AS (SELECT coalesce(CAST(conv_id AS VARCHAR), '') AS c, i, n.p, e.q, min(struct_pack(cost := n.cost + e.cost, audit := n.edits || e.edit)) AS w FROM edits e JOIN inserts n ON n.q = e.p GROUP BY ALL),
walk AS (SELECT DISTINCT coalesce(CAST(conv_id AS VARCHAR), '') AS c, CAST(0 AS BIGINT) AS i, 0 AS q, struct_pack(cost := 0, audit := '') AS w FROM conversations
  UNION ALL SELECT k.c, k.i + 1, s.q, min(struct_pack(cost := k.w.cost + s.w.cost, audit := k.w.audit || s.w.audit)) FROM walk k JOIN steps s ON s.c = k.c AND s.i = k.i + 1 AND s.p = k.q GROUP BY k.c, k.i, s.q),
ends AS (SELECT c, min(struct_pack(cost := w.cost + n.cost, audit := w.audit || n.edits)) AS w FROM walk JOIN inserts n ON n.p = walk.q AND n.q IN (0, 3) WHERE i = (SELECT max(i) FROM walk x WHERE x.c = walk.c) GROUP BY c),
letters AS (SELECT c, w.audit AS audit, unnest(range(1, length(w.audit) + 1)) AS j FROM ends),
placed AS (SELECT c, j, substr(audit, CAST(j AS INTEGER), 1) AS edit, length(regexp_replace(substr(audit, 1, CAST(j AS INTEGER)), 'I', '', 'g')) AS i,
  length(regexp_replace(substr(audit, 1, CAST(j AS INTEGER)), 'D', '', 'g')) - 1 + length(regexp_replace(audit, 'D', '', 'g')) % 2 AS place FROM letters),
lines AS (SELECT p.c, j, CASE WHEN edit = 'K' THEN role WHEN place % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END AS line
  FROM placed p LEFT JOIN f ON coalesce(CAST(f.conv_id AS VARCHAR), '') = p.c AND f.i = p.i WHERE edit <> 'D'),
texts AS (SELECT c, string_agg(line, chr(10) ORDER BY j) AS text FROM lines GROUP BY c)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(e.w.cost AS BIGINT) AS cost, e.w.audit AS audit, sha256(coalesce(t.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts k ON k.conv_id IS NOT DISTINCT FROM o.conv_id
  JOIN ends e ON e.c = coalesce(CAST(o.conv_id AS VARCHAR), '') LEFT JOIN texts t ON t.c = e.c
"""


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that it can express: the others learn, search or tokenise, and are tested by brute force."""
    return {"op4_suffixes": OP4_SQL, "op7_jaccard": OP7_SQL, "op12_repair": OP12_SQL}
