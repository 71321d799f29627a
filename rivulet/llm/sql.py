"""DuckDB SQL of the queries that SQL can express: sharding, preference formatting, repeated passages, web archives, vector codes, hard negatives.

The others need XXH64, a tokenizer, Matroska files, trained models or an approximate search; tests hold those against brute force.
"""

SHARDING = """
WITH bits AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i)),
tab AS (SELECT list(c ORDER BY i) AS tab FROM bits),
bytes AS (SELECT doc_id, source, h, list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) AS b FROM (SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS h FROM documents)),
d AS (SELECT doc_id, source, length(h) // 2 + 8 AS size, md5('mixture-1:' || doc_id) AS draw,
  xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]))) AS crc FROM bytes, tab),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY draw, doc_id, crc) - 1 AS rank, count(*) OVER (PARTITION BY source) AS n FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY (2 * rank + 1) / (2 * n), source, draw, doc_id, crc) - 1 AS position, count(*) OVER () AS total FROM r),
s AS (SELECT *, position * 24 // total AS shard FROM p)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, position - (shard * total + 23) // 24 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""

_TEXT = "'<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10)"

PREFERENCE = f"""
WITH u AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS idx, role, text FROM u),
a AS (SELECT pair_id, idx, role, text FROM t WHERE side = 0), b AS (SELECT pair_id, idx, role, text FROM t WHERE side = 1),
c AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.idx, b.idx) AS idx, a.role AS ar, b.role AS br, a.role IS NOT DISTINCT FROM b.role AND a.text IS NOT DISTINCT FROM b.text AS same FROM a FULL JOIN b ON a.pair_id = b.pair_id AND a.idx = b.idx),
k AS (SELECT pair_id, coalesce(min(idx) FILTER (NOT same), count(*)) AS common, count(ar) AS chosen_turns, count(br) AS rejected_turns FROM c GROUP BY 1),
l AS (SELECT t.*, common, {_TEXT} AS shown, length({_TEXT}) AS n FROM t JOIN k USING (pair_id)),
o AS (SELECT *, sum(n) OVER (PARTITION BY pair_id, side, idx >= common ORDER BY idx) - n + length(role) + 13 AS start, sum(n) OVER (PARTITION BY pair_id, side, idx >= common ORDER BY idx) - 1 AS stop FROM l),
g AS (SELECT pair_id, coalesce(string_agg(shown, '' ORDER BY idx) FILTER (side = 0 AND idx < common), '') AS prompt,
  coalesce(string_agg(shown, '' ORDER BY idx) FILTER (side = 0 AND idx >= common), '') AS chosen, coalesce(string_agg(shown, '' ORDER BY idx) FILTER (side = 1 AND idx >= common), '') AS rejected,
  coalesce(string_agg(start || '-' || stop, ',' ORDER BY idx) FILTER (side = 0 AND idx >= common AND role = 'assistant'), '') AS chosen_spans, coalesce(string_agg(start || '-' || stop, ',' ORDER BY idx) FILTER (side = 1 AND idx >= common AND role = 'assistant'), '') AS rejected_spans,
  CAST(coalesce(sum(stop - start) FILTER (side = 0 AND idx >= common AND role = 'assistant'), 0) AS BIGINT) AS chosen_trained, CAST(coalesce(sum(stop - start) FILTER (side = 1 AND idx >= common AND role = 'assistant'), 0) AS BIGINT) AS rejected_trained FROM o GROUP BY 1)
SELECT pair_id, chosen_turns > 0 AND rejected_turns > 0 AS complete, common AS common_turns, chosen_turns, rejected_turns, prompt, chosen, rejected, chosen_spans, rejected_spans, chosen_trained, rejected_trained FROM k JOIN g USING (pair_id)
"""

REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(greatest(0, length(h) // 2 - 99))) AS s FROM d)),
f AS (SELECT k, min({'d': doc_id, 's': s}) AS first, count(*) AS n FROM w GROUP BY 1 HAVING n > 1),
r AS (SELECT doc_id, s, coalesce(s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100, true) AS fresh FROM w JOIN f USING (k) WHERE (doc_id, s) > (first.d, first.s)),
i AS (SELECT doc_id, s, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM r),
g AS (SELECT doc_id, island, min(s) AS lo, max(s) + 100 AS hi FROM i GROUP BY 1, 2),
q AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM g),
m AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) || substr(first(h), 2 * max(hi) + 1) AS kept FROM q JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN m USING (doc_id)
"""

ARCHIVES = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
k AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS keep FROM p),
u AS (SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1) AS host, lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)) AS path, list_sort(list_filter(string_split(lower(regexp_extract(url, '[?]([^#]*)', 1)), '&'), lambda x: x <> '')) AS query FROM pages),
h AS (SELECT page_id, array_to_string(list_reverse(string_split(regexp_replace(lower(host), '^www[.]', ''), '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END AS urlkey FROM u)
SELECT page_id, urlkey, row_number() OVER (PARTITION BY urlkey ORDER BY page_id) - 1 AS capture_no, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN page_id < keep THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < keep THEN keep END AS refers_to FROM k JOIN h USING (page_id)
"""

#: Op 12: integer scores of all pairs with an anchor.
NEGATIVES = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_dot_product(a.q, r.q)::BIGINT AS score
  FROM rows a JOIN rows r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""


def vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Op 11: the assignments and codebooks of each round, one after another."""
    steps = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS q, len(embedding) // {parts} AS width
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cut AS MATERIALIZED (
  SELECT vec_id, label, p, list_slice(q, p * width + 1, (p + 1) * width) AS v FROM kept, range({parts}) AS r(p)
), books0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v AS c FROM cut
  QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= {entries}
)"""
    for r in range(rounds + 1):
        steps += f""", near{r} AS MATERIALIZED (
  SELECT vec_id, p, any_value(label) AS label, any_value(v) AS v,
         min((list_dot_product(v, v) - 2 * list_dot_product(v, c) + list_dot_product(c, c))::BIGINT * {entries} + e) AS best
  FROM cut JOIN books{r} USING (p) GROUP BY vec_id, p
)"""
        if r < rounds:
            steps += f""", means{r} AS (
  SELECT p, e, list(m ORDER BY i) AS c FROM (
    SELECT p, best % {entries} AS e, i, floor(sum(v[i]) / count(*)) AS m FROM near{r}, LATERAL (SELECT unnest(range(1, len(v) + 1)) AS i) GROUP BY ALL
  ) GROUP BY p, e
), books{r + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM books{r} b LEFT JOIN means{r} m ON m.p = b.p AND m.e = b.e
)"""
    return f"""{steps}, coded AS (
  SELECT vec_id, any_value(label) AS label, string_agg(lower(lpad(to_hex(best % {entries}), 2, '0')), '' ORDER BY p) AS code, sum(best // {entries})::BIGINT AS error
  FROM near{rounds} GROUP BY vec_id
), digest AS (
  SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM books{rounds}
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, digest
"""
