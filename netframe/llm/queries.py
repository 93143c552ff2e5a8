"""The subpackage's queries and, where SQL can express one, the DuckDB SQL of its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netframe.llm import byte_bpe, centroids, decontaminate, hard_negatives, jaccard, line_dedup, pii, quality, sstable, toxicity, warc, webp, wordpiece
from netframe.llm.common import documents


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(documents(spark, sf_dir), with_text=False)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op3_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.tokenize_to_shards(documents(spark, sf_dir))


def op4_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.media_columns(documents(spark, sf_dir), with_media=False)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.count_tokens(documents(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(documents(spark, sf_dir))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_decode(documents(spark, sf_dir), with_ids=False)


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, sf_dir))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"), with_spans=False)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label in seven is moved by one, so that labels and vectors disagree in places."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives.mine_hard_negatives(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label")))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(_table(spark, sf_dir, "embeddings"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_quality, op3_sstable, op4_lossless_webp, op5_token_counts, op6_toxicity, op7_pii, op8_byte_bpe, op9_ngram_jaccard, op10_decontamination,
        op11_hard_negatives, op12_centroids, op13_warc,
    )
}

_LOWER = "translate(COALESCE({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REACH = "ways AS (SELECT a AS u, b AS v FROM links UNION SELECT b, a FROM links), reach AS (SELECT u, u AS v FROM ways UNION SELECT r.u, w.v FROM reach r JOIN ways w ON r.v = w.u)"
_TEST_WORDS = f"regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"
_WHOLE = "list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE)))"


def _clusters_sql(k: int = 40, rounds: int = 5, width: int = 64) -> str:
    """Each round is two tables: the vectors' nearest centroids, and the centroids' means."""
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, {_WHOLE} AS q FROM embeddings WHERE len(embedding) = {width} AND {_FINITE})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q FROM (SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS h, q FROM v WHERE vec_id IS NOT NULL ORDER BY h, q LIMIT {k}))",
    ]
    for n in range(rounds + 1):
        apart = "list_inner_product(v.q, v.q) - 2 * list_inner_product(v.q, c.q) + list_inner_product(c.q, c.q)"
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, vec_id, q, arg_min(c, (d, c)) AS c, MIN(d) AS d FROM (SELECT v.*, c.c, CAST({apart} AS BIGINT) AS d FROM v, c{n} c) GROUP BY r, vec_id, q)")
        if n < rounds:
            parts.append(
                f"m{n} AS MATERIALIZED (SELECT c, list(CAST(floor(s / n) AS DOUBLE) ORDER BY i) AS q FROM (SELECT c, i, SUM(x) AS s, COUNT(*) AS n FROM "
                f"(SELECT c, unnest(q) AS x, unnest(range(1, {width + 1})) AS i FROM a{n}) GROUP BY c, i) GROUP BY c)"
            )
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT c.c, COALESCE(m.q, c.q) AS q FROM c{n} c LEFT JOIN m{n} m ON m.c = c.c)")
    last = rounds
    return f"""
        WITH {", ".join(parts)}
        SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(SUM(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(SUM(d) OVER () AS BIGINT) AS inertia,
            sha256(array_to_string(list_transform(c.q, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
        FROM a{last} a JOIN c{last} c ON c.c = a.c"""


ORACLES: dict[str, str] = {
    "op11_hard_negatives": f"""
        WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_WHOLE} AS q
            FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_FINITE}),
        s AS MATERIALIZED (SELECT a.r, a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS alike, CAST(list_inner_product(a.q, v.q) AS BIGINT) AS score FROM v a, v WHERE a.vec_id % 50 = 0 AND v.vec_id <> a.vec_id),
        p AS (SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score, k FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS k FROM s WHERE alike) WHERE k <= 5),
        n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.r, p.k ORDER BY s.score DESC, s.vec_id) AS rank
            FROM p JOIN s ON s.r = p.r AND NOT s.alike AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
    "op12_centroids": _clusters_sql(),
    "op13_warc": """
        WITH p AS (SELECT page_id, COALESCE(html, '') AS t, strlen(COALESCE(html, '')) AS n FROM pages),
        k AS (SELECT t, MAX(page_id) AS last FROM p WHERE n >= 1000 AND page_id IS NOT NULL GROUP BY t HAVING COUNT(*) > 1)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(t) AS payload_digest, CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN last <> page_id THEN last END AS refers_to
        FROM p LEFT JOIN k USING (t)""",
    "op1_line_dedup": f"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(COALESCE(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM d),
        k AS (SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
        heavy AS (SELECT key, MAX(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING COUNT(DISTINCT doc_id) >= 3),
        m AS (SELECT r, doc_id, i, line, keeper IS NOT NULL AND keeper IS DISTINCT FROM doc_id AS gone FROM k LEFT JOIN heavy USING (key))
        SELECT doc_id, COUNT(*) AS n_lines, COUNT(*) FILTER (gone) AS n_dropped, sha256(COALESCE(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM m GROUP BY r, doc_id""",
    "op9_ngram_jaccard": f"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex({_LOWER.format("text")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM d),
        n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
        both_have AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM both_have JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)), {_REACH},
        part AS (SELECT u AS doc_id, MIN(v) AS part FROM reach GROUP BY u)
        SELECT d.doc_id, COALESCE(n.n, 0) AS n_shingles, COALESCE(part, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN part USING (doc_id)""",
    "op10_decontamination": f"""
        WITH d AS (SELECT doc_id, {_TEST_WORDS} AS w FROM documents), b AS (SELECT item_id, {_TEST_WORDS} AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, LEAST(len(w), 10) AS n, unnest(list_transform(range(1, GREATEST(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + LEAST(len(w), 10) - 1], ' '))) AS t FROM b WHERE len(w) > 0),
        sizes AS (SELECT DISTINCT n FROM win),
        own AS (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS t, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
        hit AS (SELECT doc_id, item_id, i, own.n FROM own JOIN win ON own.n = win.n AND own.t = win.t),
        h AS (SELECT doc_id, COUNT(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
        t AS (SELECT doc_id, COUNT(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items, sha256(COALESCE(ids, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
}
