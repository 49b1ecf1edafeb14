"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    conversation_repair,
    conversation_trie,
    exact_dedup,
    language_id,
    license_scan,
    mixing,
    near_dedup,
    packing,
    simhash,
    substring_dedup,
    suffix_dedup,
    tokens,
    topk,
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"), F.col("n_references").alias("n_factors"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))
    total = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return out.select("doc_id", "n_bytes", total("spans").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), total("passages").alias("n_repeated"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = language_id.is_held_out()
    model = language_id.train(docs.filter(~held))
    return language_id.identify(docs, model).withColumn("held_out", language_id.is_held_out()).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k_of_every(table(spark, sf_dir, "embeddings"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "row_no")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "group_id", "kept")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_conversations(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_substring_dedup, op3_suffix_dedup, op4_license_scan, op5_token_counts, op6_language_id, op7_mixing, op8_exact_top_k,
        op9_best_fit_packing, op10_near_dedup, op11_prefix_trie, op12_simhash, op13_conversation_repair,
    )
}

#: The CRC-32 of an ASCII string in DuckDB, bit by bit.
CRC = """xor(list_reduce(list_concat([4294967295], [ascii(substr({0}, i, 1)) FOR i IN range(1, length({0}) + 1)]),
            lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

SQL: dict[str, str] = {
    "op1_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM d""",
    "op2_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
             p AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
             g AS (SELECT p.doc_id, i, array_to_string(w[i:i + 12], ' ') AS t FROM p JOIN d USING (doc_id)),
             f AS (SELECT t, min(doc_id) AS first FROM g GROUP BY 1),
             c AS (SELECT doc_id, i FROM g JOIN f USING (t) WHERE first < doc_id),
             r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM c),
             l AS (SELECT doc_id, list(k) AS gone FROM r GROUP BY 1),
             e AS (SELECT doc_id, i, CASE WHEN lag(i) OVER v = i - 1 AND lag(first) OVER v = first THEN 0 ELSE 1 END AS new FROM g JOIN f USING (t) WHERE first < doc_id WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
             n AS (SELECT doc_id, CAST(sum(new) AS BIGINT) AS n_factors FROM e GROUP BY 1),
             k AS (SELECT d.doc_id, string_agg(w[k], ' ' ORDER BY k) AS kept FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d) d LEFT JOIN r USING (doc_id, k) WHERE r.k IS NULL GROUP BY 1)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_factors, 0) AS n_factors
        FROM d LEFT JOIN l USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op3_suffix_dedup": r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
             p AS (SELECT doc_id, h, unnest(range(CAST(length(h) // 2 - 399 AS BIGINT))) AS i FROM d WHERE length(h) >= 800),
             g AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS m FROM p),
             c AS (SELECT m FROM g GROUP BY 1 HAVING count(*) > 1),
             x AS (SELECT doc_id, i, max(i + 400) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM g SEMI JOIN c USING (m)),
             y AS (SELECT doc_id, i, sum(CASE WHEN upto IS NULL OR i > upto THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM x),
             s AS (SELECT doc_id, k, min(i) AS a, max(i) + 400 AS b FROM y GROUP BY 1, 2),
             t AS (SELECT doc_id, a, b, coalesce(lag(b) OVER v, 0) AS from_byte, row_number() OVER v = count(*) OVER (PARTITION BY doc_id) AS is_last FROM s WINDOW v AS (PARTITION BY doc_id ORDER BY a)),
             r AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed,
                     string_agg(substr(h, 2 * from_byte + 1, 2 * (a - from_byte)) || CASE WHEN is_last THEN substr(h, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS kept FROM t JOIN d USING (doc_id) GROUP BY 1),
             p2 AS (SELECT doc_id, h, unnest(range(CAST(length(h) // 2 - 249 AS BIGINT))) AS i FROM d WHERE length(h) >= 500),
             g2 AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 500)) AS m FROM p2),
             x2 AS (SELECT doc_id, i, max(i + 250) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM g2 SEMI JOIN (SELECT m FROM g2 GROUP BY 1 HAVING count(*) > 1) c2 USING (m)),
             r2 AS (SELECT doc_id, CAST(sum(i + 250 - greatest(i, coalesce(upto, 0))) AS BIGINT) AS n_repeated FROM x2 GROUP BY 1)
        SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256, coalesce(n_repeated, 0) AS n_repeated
        FROM d LEFT JOIN r USING (doc_id) LEFT JOIN r2 USING (doc_id)""",
    "op7_mixing": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                     CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) * pow(2.0, -52) AS u FROM documents),
             s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
             w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
             o AS (SELECT *, 2 * source_size / weight AS ratio, sum(source_size) OVER () * 1.5::DOUBLE AS total, sum(weight) OVER () AS all_weight,
                     coalesce(sum(source_size) OVER v, 0) AS held, coalesce(sum(weight) OVER v, 0) AS held_weight
                   FROM w WINDOW v AS (ORDER BY 2 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
             -- The level is that of the first source, in order of ratio, that it leaves unclamped with all before it clamped.
             l AS (SELECT (total - 2 * held) / (all_weight - held_weight) AS level FROM o WHERE ratio >= (total - 2 * held) / (all_weight - held_weight) ORDER BY ratio, source LIMIT 1),
             t AS (SELECT source, source_size, least(2.0 * source_size, weight * coalesce((SELECT level FROM l), 1e300)) AS target FROM w),
             r AS (SELECT doc_id, t.source, u, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
             g AS (SELECT *, CASE WHEN whole < 2 THEN target - whole * source_size ELSE -1 END AS part FROM r),
             -- The fraction is filled in order twice; a document larger than what is to be filled is passed over.
             a AS (SELECT *, sum(CASE WHEN size <= part THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY u, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM g),
             a1 AS (SELECT *, size <= part AND upto <= part AS one FROM a),
             a2 AS (SELECT *, part - coalesce(max(upto) FILTER (one) OVER (PARTITION BY source), 0) AS gap1 FROM a1),
             b AS (SELECT *, sum(CASE WHEN NOT one AND size <= gap1 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY u, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto2 FROM a2),
             b1 AS (SELECT *, NOT one AND size <= gap1 AND upto2 <= gap1 AS two FROM b),
             q AS (SELECT *, one OR two AS more, gap1 - coalesce(max(upto2) FILTER (two) OVER (PARTITION BY source), 0) AS gap FROM b1),
             x AS (SELECT *, row_number() OVER (PARTITION BY source, NOT more AND abs(size - gap) < gap ORDER BY abs(size - gap), u, doc_id) = 1 AND NOT more AND abs(size - gap) < gap AS last FROM q)
        SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN more OR last THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM x""",
    "op8_exact_top_k": r"""
        WITH v AS (SELECT vec_id, [CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(q.v, c.v)]) AS BIGINT) AS score
                   FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
             r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op10_near_dedup": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
             c AS (SELECT doc_id, w, min(doc_id) OVER (PARTITION BY w) AS class_id FROM d),
             r AS (SELECT class_id, w FROM c WHERE doc_id = class_id AND len(w) > 0),
             g AS (SELECT class_id, unnest(CASE WHEN len(w) < 5 THEN [w] ELSE [w[i:i + 4] FOR i IN range(1, len(w) - 3)] END) AS t FROM r),
             n AS (SELECT class_id, t, count(*) AS n FROM g GROUP BY 1, 2),
             s AS (SELECT class_id, sum(n) AS total FROM n GROUP BY 1),
             o AS (SELECT a.class_id AS x, b.class_id AS y, sum(least(a.n, b.n)) AS overlap FROM n a JOIN n b ON a.t = b.t AND a.class_id < b.class_id GROUP BY 1, 2),
             l AS (SELECT x, y FROM o JOIN s a ON a.class_id = x JOIN s b ON b.class_id = y WHERE overlap >= 0.8 * (a.total + b.total - overlap) - 1e-9),
             e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
             p AS (SELECT x, y FROM e UNION SELECT p.x, e.y FROM p JOIN e ON p.y = e.x),
             m AS (SELECT x AS class_id, least(x, min(y)) AS group_id FROM p GROUP BY 1)
        SELECT doc_id, CASE WHEN len(w) = 0 THEN doc_id ELSE class_id END AS class_id, CASE WHEN len(w) = 0 THEN doc_id ELSE coalesce(group_id, class_id) END AS group_id,
               len(w) = 0 OR doc_id = coalesce(group_id, class_id) AS kept
        FROM c LEFT JOIN m USING (class_id)""",
    "op11_prefix_trie": rf"""
        WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
             c AS (SELECT conv_id, {CRC.format("CAST(conv_id AS VARCHAR)")} % 6 AS h,
                     list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, sha256(concat(strlen(role), ':', role, text))) AS ts FROM m GROUP BY 1),
             r AS (SELECT c.conv_id, list_concat(coalesce(b.ts[1:c.h], []), c.ts[c.h + 1:]) AS ts FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 100),
             e AS (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS depth FROM r),
             n AS (SELECT ts[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                     coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(ts) = depth), '') AS ends FROM e GROUP BY 1, 2),
             k AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
             f AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * CASE WHEN depth = 0 THEN 0 ELSE length(path[depth].text) END AS saved FROM n LEFT JOIN k USING (path, depth)),
             a AS (SELECT path[1:up] AS path, up AS depth, CASE WHEN n_children = 0 THEN 1 ELSE 0 END AS leaf, saved FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM f)),
             s AS (SELECT path, depth, CAST(sum(leaf) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM a GROUP BY 1, 2)
        SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, sha256(f.ends) AS ends_sha256
        FROM f JOIN s ON s.path = f.path AND s.depth = f.depth LEFT JOIN n p ON f.depth > 0 AND p.depth = f.depth - 1 AND p.path = f.path[1:f.depth - 1]""",
    "op13_conversation_repair": rf"""
        WITH RECURSIVE
             o AS (SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS name, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                     coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
             c AS (SELECT *, {CRC.format("key")} % 20 AS code, sha256(concat(strlen(role), ':', role, text)) AS mark FROM o),
             d AS (SELECT name, turn, mark, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
                     CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS again
                   FROM c WHERE code <> 0),
             p AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY turn NULLS FIRST, mark, again) AS i FROM d),
             q AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY name, role, text ORDER BY i) > 1 AS met,
                     substr(role, 1, 1) AS ini, lag(substr(role, 1, 1)) OVER (PARTITION BY name ORDER BY i) AS before,
                     NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS open FROM p),
             r AS (SELECT *, blank OR met AS must_go, open AND NOT blank AND NOT met AS truncated FROM q),
             g AS (SELECT name, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (met AND NOT blank) AS duplicate,
                     count(*) FILTER (truncated) AS truncated, count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY 1),
             steps(s, ini, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
             puts AS (SELECT s, t, 2 AS cost, 'I' AS letters FROM steps WHERE ini <> 's'),
             gap AS (SELECT s, s AS t, 0 AS cost, '' AS letters FROM range(4) AS x(s) UNION ALL SELECT * FROM puts
                     UNION ALL SELECT a.s, b.t, 4, 'II' FROM puts a JOIN puts b ON a.t = b.s UNION ALL SELECT a.s, c.t, 6, 'III' FROM puts a JOIN puts b ON a.t = b.s JOIN puts c ON b.t = c.s),
             moves AS (SELECT s, NULL AS ini, s AS t, 3 AS cost, 'D' AS letter FROM range(4) AS x(s) UNION ALL SELECT s, ini, t, 0, 'K' FROM steps UNION ALL SELECT s, NULL, t, 2, 'R' FROM steps WHERE ini <> 's'),
             edits AS (SELECT gap.s, m.t, m.ini, letter <> 'D' AS stays, CAST(gap.cost + m.cost AS BIGINT) AS cost, letters || letter AS letters FROM gap JOIN moves m ON gap.t = m.s),
             walk AS (SELECT name, CAST(0 AS BIGINT) AS i, 0 AS state, {{'cost': CAST(0 AS BIGINT), 'audit': ''}} AS best FROM g
                      UNION ALL
                      SELECT w.name, r.i, e.t, min({{'cost': w.best.cost + e.cost + CASE WHEN stays AND truncated THEN 1 ELSE 0 END, 'audit': w.best.audit || e.letters}})
                      FROM walk w JOIN r ON r.name = w.name AND r.i = w.i + 1 JOIN edits e ON e.s = w.state WHERE (e.ini IS NULL OR e.ini = r.ini) AND NOT (stays AND must_go) GROUP BY ALL),
             ends AS (SELECT w.name, min({{'cost': best.cost + gap.cost, 'audit': best.audit || letters}}) AS best FROM walk w JOIN g ON g.name = w.name AND g.n = w.i JOIN gap ON gap.s = w.state WHERE gap.t IN (0, 3) GROUP BY 1),
             l AS (SELECT name, best.audit AS audit, unnest(range(1, length(best.audit) + 1)) AS j FROM ends),
             v AS (SELECT *, substr(audit, j, 1) AS letter, j - length(replace(substr(audit, 1, j), 'D', '')) AS gone, length(replace(substr(audit, 1, j), 'I', '')) AS i FROM l),
             y AS (SELECT v.name, j, letter, r.role, r.text, j - gone AS place, first(r.ini = 's' AND letter = 'K') OVER (PARTITION BY v.name ORDER BY j) AS system FROM v LEFT JOIN r ON r.name = v.name AND r.i = v.i WHERE letter <> 'D'),
             z AS (SELECT name, string_agg(CASE letter WHEN 'K' THEN role || ':' || text ELSE CASE WHEN (place - CASE WHEN coalesce(system, false) THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END
                     || ':' || CASE letter WHEN 'R' THEN text ELSE '' END END, chr(10) ORDER BY j) AS said FROM y GROUP BY 1)
        SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), ' ') AS name FROM conversations) k LEFT JOIN g USING (name) LEFT JOIN ends USING (name) LEFT JOIN z USING (name)""",
}
