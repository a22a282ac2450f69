"""The registered query of each corpus operator, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import bitpack, debruijn, decontaminate, hash_tree, line_crf, line_runs, near_duplicates, packing, rank_bpe, secrets, vafile, warc, whitening
from webloom.llm.registry import ORACLES, QUERIES, query, table  # noqa: F401
from webloom.session import scratch_path


@query("op9_bit_packed_ids")
def op9(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "packed")
    bitpack.write_packed(table(spark, d, "documents"), path)
    return bitpack.read_documents(spark, path)


@query("op10_best_fit_packing")
def op10(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"))


@query("op3_hash_tree_shards")
def op3(spark: SparkSession, d: str) -> DataFrame:
    return hash_tree.shard_documents(table(spark, d, "documents"), shards=40)


_ITEM_WORDS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
               r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

OP5_SQL = f"""
WITH dw AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
iw AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
         FROM iw, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS t(i) WHERE len(w) > 0),
dwin AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
         FROM dw, (SELECT DISTINCT n FROM wins) AS l, unnest(range(1, greatest(len(w) - n + 2, 1))) AS t(i)),
hits AS (SELECT doc_id, i, n, item_id FROM dwin JOIN wins USING (n, win)),
spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS items
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w)) AS contaminated
FROM dw LEFT JOIN spots USING (doc_id) LEFT JOIN found USING (doc_id)
"""


@query("op5_benchmark_automaton", OP5_SQL)
def op5(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))


_BASE32 = ", ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, {5 * g + 1}, 5))::INTEGER >> {s}) & 31) + 1, 1)"
                    for g in range(8) for s in (15, 10, 5, 0))

OP6_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT x, min(page_id) AS m FROM p GROUP BY x)
SELECT page_id, n::BIGINT AS payload_bytes, concat({_BASE32}) AS payload_digest,
       CASE WHEN page_id > m THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > m THEN m END AS refers_to
FROM p JOIN f USING (x)
"""


@query("op6_warc_boundary_chain", OP6_SQL)
def op6(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, d, "pages"), path)
    return warc.read_archives(spark, path)


_SCALES = [1, 2, 3, *(2**k for k in range(2, 16))]
OP2_SQL = r"""
WITH raw AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
lines AS (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS word,
                 sum(regexp_matches(line, '[^\x20\x09-\x0D]')::INT) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM raw),
ids AS (SELECT doc_id, list(md5(line) ORDER BY k) AS w, list(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) ORDER BY k) AS c
        FROM lines WHERE word GROUP BY doc_id),
wins AS (SELECT doc_id, i - 1 AS k, n, md5(array_to_string(w[i:i + n - 1], ',')) AS win,
                n >= 3 OR list_sum(c[i:i + n - 1]) >= 5 AS counts
         FROM ids, (SELECT unnest(SCALES) AS n) AS s, unnest(range(1, greatest(len(w) - n + 2, 1))) AS t(i)),
firsts AS (SELECT n, win, min((doc_id, k)) AS f FROM wins GROUP BY n, win),
later AS (SELECT doc_id, k, n FROM wins JOIN firsts USING (n, win) WHERE counts AND (doc_id, k) <> f),
gone AS (SELECT DISTINCT doc_id, p AS k FROM later, unnest(range(k, k + n)) AS t(p) WHERE n <= 3),
scale AS (SELECT doc_id, max(n) AS run_scale FROM later GROUP BY doc_id)
SELECT l.doc_id, count(*) FILTER (word)::BIGINT AS n_lines, count(*) FILTER (word AND g.k IS NOT NULL)::BIGINT AS n_removed,
       coalesce(any_value(run_scale), 0)::INT AS run_scale,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (g.k IS NULL), '')) AS kept_sha256
FROM lines AS l LEFT JOIN gone AS g ON l.doc_id = g.doc_id AND l.k = g.k LEFT JOIN scale AS s ON l.doc_id = s.doc_id
GROUP BY l.doc_id
""".replace("SCALES", str(_SCALES))


@query("op2_line_run_suffixes", OP2_SQL)
def op2(spark: SparkSession, d: str) -> DataFrame:
    kept = line_runs.delete_later_runs(table(spark, d, "documents"))
    return kept.select("row.doc_id", "n_lines", "n_removed", "run_scale", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query("op8_secret_randomness_battery")
def op8(spark: SparkSession, d: str) -> DataFrame:
    return secrets.find_secrets(table(spark, d, "documents"))


_SPACED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

OP7_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_SPACED} AS w FROM documents),
sets AS (SELECT doc_id, list_sort(list_distinct([hash(array_to_string(w[i:i + 4], ' ')) for i in range(1, greatest(len(w) - 4, 1) + 1)])) AS s
         FROM w WHERE len(w) > 0),
classes AS (SELECT s, min(doc_id) AS c FROM sets GROUP BY s),
items AS (SELECT c, len(s) AS n, unnest(s) AS x FROM classes),
pairs AS (SELECT a.c AS a, b.c AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM items a JOIN items b ON a.x = b.x AND a.c < b.c GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * k >= 85 * (na + nb - k)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT c AS node, c AS seen FROM classes UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.seen = e.a),
parts AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
SELECT w.doc_id, coalesce(len(sets.s), 0)::BIGINT AS n_shingles, coalesce(component, w.doc_id) AS component_id,
       coalesce(component, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN sets USING (doc_id) LEFT JOIN classes ON sets.s = classes.s LEFT JOIN parts ON classes.c = parts.node
"""


@query("op7_hamming_near_duplicates", OP7_SQL)
def op7(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, d, "documents")).drop("text_key")


OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS win FROM w, unnest(range(1, greatest(len(w) - 33, 1))) AS t(i)),
twice AS (SELECT win FROM wins GROUP BY win HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, p FROM wins JOIN twice USING (win), unnest(range(i, i + 35)) AS t(p)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w),
left_over AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN left_over USING (doc_id)
"""


@query("op4_debruijn_spans", OP4_SQL)
def op4(spark: SparkSession, d: str) -> DataFrame:
    return debruijn.remove_repeats(table(spark, d, "documents"))


@query("op1_line_crf_quality")
def op1(spark: SparkSession, d: str) -> DataFrame:
    return line_crf.label_documents(table(spark, d, "documents"), table(spark, d, "labels"))


@query("op11_polar_whitening")
def op11(spark: SparkSession, d: str) -> DataFrame:
    return whitening.whiten(table(spark, d, "embeddings"))


@query("op12_rank_bpe_matrices")
def op12(spark: SparkSession, d: str) -> DataFrame:
    coded = rank_bpe.encode_texts(table(spark, d, "documents").select("doc_id", "text"), spelled=True)
    return coded.select("row.doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op13_va_file_clusters")
def op13(spark: SparkSession, d: str) -> DataFrame:
    return vafile.cluster(table(spark, d, "embeddings"))
