"""The operators' queries as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

QUALITY_RULES = r"""
WITH texts AS (
    SELECT row_number() OVER () AS row_id, doc_id, source AS host, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), starts AS (
    SELECT row_id, unnest(range(1, len(words) - 6)) AS i, words FROM texts WHERE len(words) >= 8
), windows AS (
    SELECT row_id, i, count(*) OVER (PARTITION BY row_id, array_to_string(words[i:i + 7], ' ')) AS copies FROM starts
), covered AS (
    SELECT row_id, count(DISTINCT place) AS n_repeat_words
    FROM (SELECT row_id, unnest(range(i, i + 8)) AS place FROM windows WHERE copies > 1) GROUP BY row_id
), measured AS (
    SELECT row_id, doc_id, host, CAST(len(words) AS BIGINT) AS n_words,
           CAST(coalesce(length(array_to_string(words, '')), 0) AS BIGINT) AS word_chars,
           CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
           coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM texts)
    LEFT JOIN covered USING (row_id)
), failed AS (
    SELECT host, rule, CAST(fails AS DOUBLE) AS fails
    FROM (SELECT host, n_words < 20 AS short, 100 * n_repeat_words > 30 * n_words AS repeats,
                 10 * n_symbols > 3 * word_chars AS symbols, 10 * n_dup_lines > n_words AS lines FROM measured)
    UNPIVOT (fails FOR rule IN (short, repeats, symbols, lines))
), hosts AS (
    SELECT host, rule, count(*) AS docs, sum(fails) AS fails FROM failed GROUP BY ALL
), prior AS (
    SELECT rule, sum(fails) / sum(docs) AS mean, sum((fails / docs) * (fails / docs) * docs) / sum(docs) AS square
    FROM hosts GROUP BY rule
), strength AS (
    SELECT rule, mean, CASE WHEN square - mean * mean > 0
        THEN greatest(1, least(1000, mean * (1 - mean) / (square - mean * mean) - 1)) ELSE 1000 END AS s FROM prior
), rates AS (
    SELECT host, max((fails + s * mean) / (docs + s)) AS rate FROM hosts JOIN strength USING (rule) GROUP BY host
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND rate <= 0.5 AS kept
FROM measured JOIN rates ON measured.host IS NOT DISTINCT FROM rates.host
"""



def centroid_clustering(k: int = 8, rounds: int = 10, seed: int = 3, size: int = 64) -> str:
    """Rounds written out one after the other; every vector is compared with every centroid."""
    steps = [
        f"""kept AS MATERIALIZED (
    SELECT row_number() OVER () AS row_id, vec_id,
           list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings
    WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"""c0 AS MATERIALIZED (
    SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), q) - 1 AS INTEGER) AS cluster, q AS c
    FROM kept ORDER BY cluster LIMIT {k}
)""",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (
    SELECT row_id, vec_id, q, cluster, distance
    FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY distance, cluster) AS place
          FROM (SELECT row_id, vec_id, q, cluster,
                       CAST(list_sum(list_transform(list_zip(q, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance
                FROM kept, c{i}))
    WHERE place = 1
)"""
        )
        if i < rounds:
            steps.append(
                f"""c{i + 1} AS MATERIALIZED (
    SELECT cluster, coalesce(moved, c) AS c
    FROM c{i} LEFT JOIN (
        SELECT cluster, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY place) AS moved
        FROM (SELECT cluster, place, sum(x) AS total, count(*) AS n
              FROM (SELECT cluster, unnest(q) AS x, unnest(range({size})) AS place FROM a{i}) GROUP BY ALL)
        GROUP BY cluster) USING (cluster)
)"""
            )
    return f"""WITH {", ".join(steps)}
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)"""


SQL: dict[str, str] = {"op1_quality_rules": QUALITY_RULES, "op11_centroid_clustering": centroid_clustering()}
