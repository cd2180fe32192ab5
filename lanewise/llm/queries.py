"""One registered query per operator, with production parameters, over its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lanewise.llm.common import table
from lanewise.llm.decontamination import find_leaks
from lanewise.llm.embedding_join import near_duplicates
from lanewise.llm.filter_audit import audit_filters
from lanewise.llm.heap_kmeans import cluster_vectors
from lanewise.llm.html_text import extract_text
from lanewise.llm.language import identify
from lanewise.llm.licenses import scan_licenses
from lanewise.llm.line_dedup import dedup_lines
from lanewise.llm.ngram_join import jaccard_components
from lanewise.llm.packing import pack
from lanewise.llm.pii import find_pii
from lanewise.llm.quality import score_quality
from lanewise.llm.warc import read_records, write_archives
from lanewise.session import stage_path


def op8_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), digest=True)


def op10_license_diagonal_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op9_adaptive_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op6_block_max_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_minhash_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_positive_unlabelled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_partial_matching_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op1_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op2_grid_order_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_layout_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_indexed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = stage_path(spark, f"warc-{uuid.uuid4().hex[:8]}")
    return read_records(write_archives(table(spark, sf_dir, "pages"), folder), folder, payloads=False).drop("target_uri", "payload")


def op13_heap_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def _clustering_sql(rounds: int = 5) -> str:
    """Assignments and centroid updates in turn, each a pair of common table expressions."""
    near = """a{0} AS MATERIALIZED (SELECT id, any_value(vec_id) AS vec_id, any_value(x) AS x, min(struct_pack(
        d := list_sum(list_transform(list_zip(x, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c := c)) AS b FROM v, c{0} GROUP BY id)"""
    move = """s{0} AS (SELECT b.c AS c, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{0}),
        t{0} AS (SELECT c, i, CAST(sum(y) AS BIGINT) AS s, count(*) AS n FROM s{0} GROUP BY ALL),
        u{0} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM t{0} GROUP BY c),
        c{1} AS MATERIALIZED (SELECT c, coalesce(u{0}.m, c{0}.m) AS m FROM c{0} LEFT JOIN u{0} USING (c))"""
    steps = [x for r in range(rounds) for x in (near.format(r), move.format(r, r + 1))] + [near.format(rounds)]
    return f"""
        WITH v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda y: CAST(floor(256 * CAST(y AS DOUBLE)) AS BIGINT)) AS x
              FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: isfinite(y))) = 64),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, x AS m FROM v ORDER BY c LIMIT 40),
        {", ".join(steps)}
        SELECT vec_id, CAST(b.c AS INT) AS cluster, CAST(b.d AS BIGINT) AS distance, CAST(sum(b.d) OVER (PARTITION BY b.c) AS BIGINT) AS cluster_inertia,
          CAST(sum(b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} ON b.c = c"""


QUERIES = {
    "op13_heap_centroid_clustering": op13_heap_centroid_clustering,
    "op12_indexed_warc": op12_indexed_warc,
    "op11_filter_interaction_audit": op11_filter_interaction_audit,
    "op5_layout_html_text": op5_layout_html_text,
    "op2_grid_order_embeddings": op2_grid_order_embeddings,
    "op1_bootstrapped_pii": op1_bootstrapped_pii,
    "op7_partial_matching_language": op7_partial_matching_language,
    "op4_positive_unlabelled_quality": op4_positive_unlabelled_quality,
    "op3_minhash_line_dedup": op3_minhash_line_dedup,
    "op6_block_max_decontamination": op6_block_max_decontamination,
    "op9_adaptive_prefix_join": op9_adaptive_prefix_join,
    "op8_power_of_two_packing": op8_power_of_two_packing,
    "op10_license_diagonal_voting": op10_license_diagonal_voting,
}

ORACLES: dict[str, str] = {
    "op11_filter_interaction_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
        w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
        l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
        f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
              (CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END)
              || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END)
              || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN doc_id > least THEN 'E' ELSE '' END) AS fails
              FROM w LEFT JOIN l USING (doc_id)),
        c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
        x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
        o AS (SELECT a.k || b.k || c.k || d.k || e.k AS filter_order FROM x a, x b, x c, x d, x e
              WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
        s AS (SELECT filter_order, step, filter_order[step] AS own, filter_order[1:step - 1] AS earlier FROM o, range(1, 6) r(step)),
        g AS (SELECT part, filter_order, step, own, fails, n, good, toxic, contains(fails, own) AS now,
              translate(fails, earlier, '') <> fails AS gone FROM c, s),
        r AS (SELECT part, filter_order, CAST(step AS INT) AS step, own,
              coalesce(sum(n) FILTER (NOT now AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (now AND NOT gone), 0) AS removed,
              coalesce(sum(n) FILTER (now AND gone), 0) AS redundant, coalesce(sum(n) FILTER (fails = own), 0) AS unique_fails,
              coalesce(sum(good) FILTER (now AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (now AND NOT gone), 0) AS toxic_lost
              FROM g GROUP BY ALL)
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
          CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
          CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r""",
    "op12_indexed_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        h AS (SELECT page_id, octet_length(b) AS payload_bytes, CAST(CAST(from_hex(sha1(b)) AS BIT) AS VARCHAR) AS bits, max(page_id) OVER (PARTITION BY b) AS keeper FROM p)
        SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + CAST(('0b' || bits[5 * i + 1:5 * i + 5]) AS INT)]), '') AS payload_digest,
          CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM h""",
    "op13_heap_centroid_clustering": _clustering_sql(),
    "op2_grid_order_embeddings": """
        WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
        u AS MATERIALIZED (SELECT id, vec_id, x FROM v WHERE len(x) > 0 AND len(list_filter(x, lambda y: isfinite(y))) = len(x) AND len(list_filter(x, lambda y: y <> 0)) > 0),
        l AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.id <> b.id AND len(a.x) = len(b.x)
              WHERE CASE WHEN len(a.x) = len(b.x) THEN list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x)) >= 0.95 ELSE false END),
        reach AS (SELECT id, id AS r FROM v UNION SELECT reach.id, l.b FROM reach JOIN l ON l.a = reach.r),
        c AS (SELECT reach.id, min(w.vec_id) AS component_id FROM reach JOIN v w ON w.id = reach.r GROUP BY 1),
        n AS (SELECT a AS id, count(*) AS n_links FROM l GROUP BY 1)
        SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
        FROM v JOIN c USING (id) LEFT JOIN n USING (id)""",
    "op9_adaptive_prefix_join": r"""
        WITH RECURSIVE w AS (SELECT row_number() OVER () AS id, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        d AS MATERIALIZED (SELECT id, doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
              ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w),
        g AS MATERIALIZED (SELECT id, len(s) AS n, unnest(s) AS k FROM d),
        l AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM g a JOIN g b ON a.k = b.k AND a.id <> b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
              GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        reach AS (SELECT id, id AS r FROM d UNION SELECT reach.id, l.b FROM reach JOIN l ON l.a = reach.r),
        c AS (SELECT reach.id, min(x.doc_id) AS component_id FROM reach JOIN d x ON x.id = reach.r GROUP BY 1)
        SELECT doc_id, len(s) AS n_shingles, component_id FROM d JOIN c USING (id)""",
}
