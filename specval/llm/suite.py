"""The registered queries of this package and their SQL counterparts. Each reads its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specval.llm import caps, collocations, exact, html, licenses, mixing, ngram_join, packing, quality, rules, sharding, substring, whitening
from specval.llm.common import join_checked


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    rows, plan = mixing.mix_sources(table(spark, folder, "documents"))
    return join_checked(rows, plan, ["__source"], "inner").select(
        F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__total").alias("source_size"),
        F.col("__target").alias("target"), (F.col("__size") * mixing.times_taken()).cast("long").alias("taken"))


def op2_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    scored = quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.select("doc_id", F.col("__held_out").alias("held_out"), F.col("__score").alias("score"), F.col("__predicted").alias("predicted"))


def op3_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, folder, "documents")).select(
        F.col("__id").alias("doc_id"), F.col("__class.id").alias("class_id"), F.col("__group.id").alias("group_id"), F.col("__n_links").alias("n_links"))


def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.quality_rules(table(spark, folder, "documents"))


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_copies(table(spark, folder, "documents"), digest=True).select(
        "doc_id", F.col("__keep_id").alias("keep_id"), F.col("__group_size").alias("group_size"), F.col("__kept").alias("kept"),
        F.col("__sha").alias("text_sha256"))


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents")).drop("ids")


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring.drop_repeats(table(spark, folder, "documents"))


def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(table(spark, folder, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(table(spark, folder, "pages"), carry=["page_id", "url"]).select(
        "page_id", "url", F.col("__text").alias("text"), F.length("__text").cast("long").alias("n_chars"))


def op11_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return caps.similar_vectors(table(spark, folder, "embeddings")).select(
        F.col("__id").alias("vec_id"), F.col("__n_links").alias("n_links"), F.col("__component").alias("component_id"),
        F.col("__id").eqNullSafe(F.col("__component")).alias("kept"))


def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings")).select(
        F.col("__id").alias("vec_id"), F.col("__component").alias("component"), F.col("__n").alias("n"), F.col("__deviation").cast("long").alias("deviation"),
        F.col("__whitened").alias("whitened"), F.col("__explained").alias("explained"), F.col("__identity_error").alias("identity_error"))


def op13_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_ngram_join": op3_ngram_join,
    "op4_license_scan": op4_license_scan,
    "op5_quality_rules": op5_quality_rules,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_packing": op7_packing,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_sharding": op9_sharding,
    "op10_html_extraction": op10_html_extraction,
    "op11_embedding_near_dedup": op11_embedding_near_dedup,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_phrase_collocations": op13_phrase_collocations,
}

OP1 = r"""
WITH RECURSIVE rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h
  FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS total, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM rows GROUP BY source
), rounds AS (
  SELECT 0 AS turn, CAST(sum(total) AS DOUBLE) AS rest, CAST(sum(weight) AS DOUBLE) AS weights, -1 AS over_before, 0 AS over_now FROM totals
  UNION ALL
  SELECT r.turn + 1,
         (SELECT CAST(sum(t.total) AS DOUBLE) - coalesce(sum(CASE WHEN CAST(t.weight AS DOUBLE) * r.rest / r.weights > 3 * t.total THEN 3 * t.total END), 0) FROM totals t),
         (SELECT CAST(sum(CASE WHEN CAST(t.weight AS DOUBLE) * r.rest / r.weights > 3 * t.total THEN 0 ELSE t.weight END) AS DOUBLE) FROM totals t),
         r.over_now,
         (SELECT CAST(count(CASE WHEN CAST(t.weight AS DOUBLE) * r.rest / r.weights > 3 * t.total THEN 1 END) AS INTEGER) FROM totals t)
  FROM rounds r WHERE r.over_before <> r.over_now
), last AS (
  SELECT rest, weights FROM rounds ORDER BY turn DESC LIMIT 1
), targets AS (
  SELECT source, total, CASE WHEN weights = 0 OR CAST(weight AS DOUBLE) * rest / weights > 3 * total THEN CAST(3 * total AS DOUBLE)
                             ELSE CAST(weight AS DOUBLE) * rest / weights END AS target
  FROM totals, last
), plan AS (
  SELECT source, total, target, CASE WHEN total > 0 THEN CAST(floor(target / total) AS BIGINT) ELSE 0 END AS times FROM targets
), hashes AS (
  SELECT source, h, sum(size) AS s FROM rows GROUP BY source, h
), running AS (
  SELECT source, h, s, sum(s) OVER (PARTITION BY source ORDER BY h) AS upto FROM hashes
), edges AS (
  SELECT r.source, CASE WHEN r.upto - (p.target - p.times * p.total) < (p.target - p.times * p.total) - (r.upto - r.s) THEN r.h ELSE r.h - 1 END AS edge
  FROM running r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source
  WHERE r.upto > p.target - p.times * p.total AND r.upto - r.s <= p.target - p.times * p.total
)
SELECT d.doc_id, d.size, p.total AS source_size, p.target,
       CAST(d.size * (p.times + CASE WHEN d.h <= coalesce(e.edge, -1) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rows d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN edges e ON d.source IS NOT DISTINCT FROM e.source
"""

OP6 = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""

OP3 = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p, len(w) AS n FROM texts
), runs AS (
  SELECT doc_id, p, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s FROM words
), shingles AS (
  SELECT DISTINCT doc_id, md5(s) AS s FROM runs WHERE p + 5 <= n OR (n < 5 AND p = 0)
), sets AS (
  SELECT t.doc_id, count(s.s) AS n, coalesce(string_agg(s.s, '' ORDER BY s.s), '') AS members
  FROM texts t LEFT JOIN shingles s ON t.doc_id = s.doc_id GROUP BY t.doc_id
), classes AS (
  SELECT doc_id, n, min(doc_id) OVER (PARTITION BY md5(members)) AS class_id, count(*) OVER (PARTITION BY md5(members)) AS size FROM sets
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT c.a, c.b FROM common c JOIN classes x ON c.a = x.doc_id JOIN classes y ON c.b = y.doc_id WHERE 5 * c.c >= 4 * (x.n + y.n - c.c)
  UNION
  SELECT doc_id, class_id FROM classes
), reached AS (
  SELECT a AS doc_id, b AS other FROM links
  UNION
  SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a
), groups AS (
  SELECT doc_id, min(other) AS group_id FROM reached GROUP BY doc_id
), counted AS (
  SELECT a AS doc_id, count(*) AS n FROM links WHERE a <> b AND a IN (SELECT doc_id FROM shingles) GROUP BY a
)
SELECT c.doc_id, c.class_id, g.group_id, CASE WHEN c.n = 0 THEN c.size - 1 ELSE coalesce(k.n, 0) END AS n_links
FROM classes c JOIN groups g ON c.doc_id = g.doc_id LEFT JOIN counted k ON c.doc_id = k.doc_id
"""

OP8 = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p, len(w) AS n FROM texts
), runs AS (
  SELECT doc_id, p, n, word, CASE WHEN p + 50 <= n THEN
    md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) END AS h
  FROM words
), firsts AS (
  SELECT h, min(doc_id) AS first FROM runs WHERE h IS NOT NULL GROUP BY h
), marked AS (
  SELECT r.doc_id, r.p, r.word, max(CASE WHEN f.first < r.doc_id THEN 1 ELSE 0 END)
    OVER (PARTITION BY r.doc_id ORDER BY r.p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
  FROM runs r LEFT JOIN firsts f ON r.h = f.h
), kept AS (
  SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (gone = 0) AS kept FROM marked GROUP BY doc_id
)
SELECT t.doc_id, CAST(coalesce(k.n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k ON t.doc_id = k.doc_id
"""

OP11 = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), sized AS (
  SELECT *, sqrt(list_dot_product(v, v)) AS norm FROM good
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sized a JOIN sized b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.93
), reached AS (
  SELECT vec_id, vec_id AS other FROM embeddings
  UNION
  SELECT r.vec_id, l.b FROM reached r JOIN links l ON r.other = l.a
), parts AS (
  SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id
), counted AS (
  SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT p.vec_id, coalesce(c.n, 0) AS n_links, p.component_id, p.vec_id = p.component_id AS kept FROM parts p LEFT JOIN counted c ON p.vec_id = c.vec_id
"""

OP13 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d,
         string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p
  FROM documents
), numbered AS (
  SELECT lang, d, unnest(range(len(p))) AS k, unnest(p) AS piece FROM pieces
), split AS (
  SELECT lang, d, k, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM numbered
), words AS (
  SELECT lang, d, k, unnest(range(len(w))) AS pos, unnest(w) AS w0 FROM split
), next AS (
  SELECT lang, w0, lead(w0) OVER here AS w1, lead(w0, 2) OVER here AS w2 FROM words WINDOW here AS (PARTITION BY d, k ORDER BY pos)
), one AS (
  SELECT lang, w0, count(*) AS a FROM next GROUP BY ALL
), two AS (
  SELECT lang, w0, w1, count(*) AS a FROM next WHERE w1 IS NOT NULL GROUP BY ALL
), three AS (
  SELECT lang, w0, w1, w2, count(*) AS a FROM next WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), pairs AS (
  SELECT t.lang, t.w0, t.w1, t.a, x.a AS l, y.a AS r, CAST(1000000 * CAST(t.a AS HUGEINT) * t.a // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM two t JOIN one x ON t.lang = x.lang AND t.w0 = x.w0 JOIN one y ON t.lang = y.lang AND t.w1 = y.w0 WHERE t.a >= 10
), cuts AS (
  SELECT t.lang, t.w0, t.w1, t.w2, t.a, x.a AS l1, yz.a AS r1, xy.a AS l2, z.a AS r2,
         CAST(1000000 * CAST(t.a AS HUGEINT) * t.a // (CAST(x.a AS HUGEINT) * yz.a) AS BIGINT) AS s1,
         CAST(1000000 * CAST(t.a AS HUGEINT) * t.a // (CAST(xy.a AS HUGEINT) * z.a) AS BIGINT) AS s2
  FROM three t JOIN one x ON t.lang = x.lang AND t.w0 = x.w0 JOIN two yz ON t.lang = yz.lang AND t.w1 = yz.w0 AND t.w2 = yz.w1
  JOIN two xy ON t.lang = xy.lang AND t.w0 = xy.w0 AND t.w1 = xy.w1 JOIN one z ON t.lang = z.lang AND t.w2 = z.w0
), held AS (
  SELECT lang, u, v, max(a) AS most FROM (SELECT lang, w0 AS u, w1 AS v, a FROM three UNION ALL SELECT lang, w1, w2, a FROM three) GROUP BY ALL
), kept AS (
  SELECT p.lang, p.w0 || ' ' || p.w1 AS phrase, p.a, p.l, p.r, p.score FROM pairs p LEFT JOIN held h ON p.lang = h.lang AND p.w0 = h.u AND p.w1 = h.v
  WHERE h.most IS NULL OR 100 * h.most < 50 * p.a
  UNION ALL
  SELECT lang, w0 || ' ' || w1 || ' ' || w2, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM cuts
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
), sizes AS (
  SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM one GROUP BY lang
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, s.n, r.score FROM ranked r JOIN sizes s ON r.lang = s.lang WHERE r.rank <= 2000
"""

ORACLES = {"op1_mixing": OP1, "op3_ngram_join": OP3, "op4_license_scan": licenses.scan_sql(), "op6_exact_dedup": OP6, "op8_substring_dedup": OP8,
           "op11_embedding_near_dedup": OP11, "op13_phrase_collocations": OP13}
