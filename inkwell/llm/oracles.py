"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

from inkwell.llm.secrets import BASE_RULES

#: Word sizes, sources, targets by water-filling, and the Pareto order with its closing document.
OP5 = r"""
WITH sized AS (
    SELECT doc_id, coalesce('=' || source, '') AS key,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           (CAST('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 13) AS BIGINT)::DOUBLE
            + 0.5) / 4503599627370496.0 AS u
    FROM documents
), per AS (
    SELECT key, sum(size)::BIGINT AS source_size,
           CASE (row_number() OVER (ORDER BY (key = '')::INT, encode(key)) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
    FROM sized GROUP BY key
), filled AS (
    SELECT *, source_size * 2.0::DOUBLE AS most,
           (sum(source_size) OVER () * 1.5::DOUBLE
            - coalesce(sum(source_size * 2.0::DOUBLE) OVER (ORDER BY source_size * 2.0::DOUBLE / w, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(w) OVER (ORDER BY source_size * 2.0::DOUBLE / w, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM per
), water AS (
    SELECT level FROM filled WHERE level * w <= most ORDER BY most / w, key LIMIT 1
), goal AS (
    SELECT key, source_size, least(most, coalesce((SELECT level FROM water) * w, most)) AS target FROM filled
), parts AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM goal
), lacking AS (
    SELECT *, target - whole * source_size AS lack, CASE WHEN source_size > 0 THEN (target - whole * source_size) / source_size ELSE 0 END AS chance FROM parts
), units AS (
    SELECT key, u, sum(size) AS size FROM sized WHERE size > 0 GROUP BY key, u
), ranked AS (
    SELECT key, size, lack, (u / (1 - u)) / (chance / (1 - chance)) AS rank FROM units JOIN lacking USING (key) WHERE chance > 0
), ordered AS (
    SELECT *, sum(size) OVER (PARTITION BY key ORDER BY rank ROWS UNBOUNDED PRECEDING) AS upto FROM ranked
), fronts AS (
    SELECT key, max(rank) FILTER (upto <= lack) AS last, any_value(lack) - coalesce(max(upto) FILTER (upto <= lack), 0) AS gap
    FROM ordered GROUP BY key
), closings AS (
    SELECT key, arg_min(rank, (abs(size - gap), rank)) AS closing, min(abs(size - gap)) AS off, any_value(gap) AS gap
    FROM ranked JOIN fronts USING (key) WHERE last IS NULL OR rank > last GROUP BY key
)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN chance > 0 AND ((u / (1 - u)) / (chance / (1 - chance)) <= coalesce(last, -1)
                             OR (off < closings.gap AND (u / (1 - u)) / (chance / (1 - chance)) = closing)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized JOIN lacking USING (key) LEFT JOIN fronts USING (key) LEFT JOIN closings USING (key)
"""

def _op4() -> str:
    """Every rule's matches with the text before them summed up, from the patterns as they stand."""
    sides = []
    for rank, rule in enumerate(BASE_RULES):
        pattern = "'" + rule.pattern.replace("'", "''") + "'"
        sides.append(f"""
SELECT id, {rank} AS rank, '{rule.kind}' AS kind, len(counted) >= {rule.least} AS good,
       sum(len(gap) + len(whole)) OVER (PARTITION BY id ORDER BY i)::BIGINT AS stop, len(whole) AS size
FROM (SELECT id, unnest(range(1, len(w) + 1)) AS i, unnest(g[1:len(w)]) AS gap, unnest(w) AS whole, unnest(c) AS counted
      FROM (SELECT id, string_split_regex(text, {pattern}) AS g, regexp_extract_all(text, {pattern}) AS w,
                   regexp_extract_all(text, {pattern}, {rule.group}) AS c FROM docs))""")
    return f"""
WITH docs AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({' UNION ALL '.join(sides)}),
listed AS (
    SELECT id, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS k, count(*) FILTER (rank = 2) AS h,
           string_agg(kind || ':' || (stop - size) || ':' || stop, ',' ORDER BY stop - size, rank) AS spans
    FROM found WHERE good GROUP BY id
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN listed USING (id)
"""


OP9 = r"""
WITH split AS (
    SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
    FROM pages
), rules(rhost, rpath, verdict) AS (
    VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fitting AS (
    SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
    FROM (SELECT DISTINCT host, path FROM split) JOIN rules
         ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
    GROUP BY host, path
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM split LEFT JOIN fitting USING (host, path)
"""

OP13 = r"""
WITH lines AS (
    SELECT doc_id, unnest(split) AS line, unnest(range(len(split))) AS pos
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS split FROM documents)
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), repeated AS (
    SELECT key, min(doc_id) AS first_id FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (coalesce(first_id <> doc_id, false))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT coalesce(first_id <> doc_id, false)), '')) AS kept_sha256
FROM keyed LEFT JOIN repeated USING (key) GROUP BY doc_id
"""

#: All phrases counted as they stand, then cuts and longer phrases by joins.
OP11 = r"""
WITH pieces AS (
    SELECT lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM (SELECT coalesce(lang, 'und') AS lang, coalesce(text, '') AS text FROM documents)
), worded AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), starts AS (
    SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded
), spans AS (
    SELECT lang, w, i, unnest(range(1, 5)) AS words FROM starts
), phrases AS (
    SELECT lang, array_to_string(w[i:i + words - 1], ' ') AS phrase, words, count(*) AS f FROM spans
    WHERE i + words - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 30
), totals AS (
    SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang
), candidates AS (
    SELECT lang, phrase, string_split(phrase, ' ') AS w, words, f AS a FROM phrases WHERE words > 1
), cuts AS (
    SELECT lang, phrase, w, words, a, unnest(range(1, words)) AS k FROM candidates
), scored AS (
    SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f + y.f))::BIGINT AS score
    FROM cuts c JOIN phrases x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
                JOIN phrases y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')
), lowest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), kept AS (
    SELECT * FROM lowest s WHERE NOT EXISTS (
        SELECT 1 FROM candidates d WHERE d.lang = s.lang AND d.phrase <> s.phrase
        AND contains(' ' || d.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * d.a >= 80 * s.a)
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

ORACLES = {"op11_collocations": OP11, "op13_line_dedup": OP13, "op4_secrets": _op4(), "op5_pareto_mix": OP5, "op9_url_filter": OP9}
