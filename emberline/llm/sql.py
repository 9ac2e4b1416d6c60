"""DuckDB SQL for the queries that SQL can express."""

URL_REPUTATION = r"""
WITH placed AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(site, verdict) AS (
  VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'),
         ('com/fr/', 'allow'), ('com/de/', 'block')
), cut AS (
  SELECT site, verdict, split_part(site, '/', 1) AS name, substr(site, strpos(site, '/')) AS start FROM rules
), fitting AS (
  SELECT page_id, max_by(site, length(site)) AS rule, max_by(verdict, length(site)) AS rule_verdict
  FROM placed JOIN cut ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start)
  GROUP BY page_id
), ruled AS (
  SELECT placed.*, rule, rule_verdict,
         CASE WHEN array_to_string(list_slice(string_split(host, '.'), -2, NULL), '.') IN
           ('ac.uk','co.uk','gov.uk','org.uk','co.jp','ne.jp','com.au','net.au','org.au','com.br','co.in','co.nz',
            'co.za','com.cn','com.mx','com.tr') THEN 2 ELSE 1 END AS depth
  FROM placed LEFT JOIN fitting USING (page_id)
), named AS (
  SELECT *, array_to_string(list_slice(string_split(host, '.'), -depth, NULL), '.') AS suffix,
         array_to_string(list_slice(string_split(host, '.'), -depth - 1, NULL), '.') AS domain
  FROM ruled
), totals AS (
  SELECT host, any_value(domain) AS domain, any_value(suffix) AS suffix, count(*)::DOUBLE AS n,
         sum((rule_verdict = 'block')::INT)::DOUBLE AS k
  FROM named WHERE rule IS NOT NULL GROUP BY host
), units AS (
  SELECT 'host' AS level, host AS unit, n, k FROM totals
  UNION ALL SELECT 'domain', domain, sum(n), sum(k) FROM totals GROUP BY domain
  UNION ALL SELECT 'suffix', suffix, sum(n), sum(k) FROM totals GROUP BY suffix
), sums AS (
  SELECT level, sum(n) AS n, sum(k) AS k, sum(k * k / n) AS s, sum(n * n) AS n2, count(*)::DOUBLE AS i
  FROM units GROUP BY level
), parts AS (
  SELECT level, k / n AS rate, (k / n) * (1 - k / n) AS inside, s - k * k / n AS within, n - n2 / n - (i - 1) AS room, i
  FROM sums
), strength AS (
  SELECT level, rate,
         CASE WHEN NOT (inside > 0 AND room > 0) THEN 1.0
              WHEN within - inside * (i - 1) <= 0 THEN 1000.0
              ELSE greatest(1.0, least(1000.0, 1 / ((within - inside * (i - 1)) / (inside * room)) - 1)) END AS s
  FROM parts
), prior AS (
  SELECT coalesce(max(s) FILTER (level = 'host'), 1.0) AS host, coalesce(max(s) FILTER (level = 'domain'), 1.0) AS domain,
         coalesce(max(s) FILTER (level = 'suffix'), 1.0) AS suffix, coalesce(max(rate) FILTER (level = 'host'), 0.0) AS rate
  FROM strength
), rated AS (
  SELECT h.host, coalesce(t.n, 0) + p.host AS size,
         (coalesce(t.k, 0) + p.host * ((coalesce(d.k, 0) + p.domain * ((coalesce(x.k, 0) + p.suffix * p.rate)
           / (coalesce(x.n, 0) + p.suffix))) / (coalesce(d.n, 0) + p.domain))) / (coalesce(t.n, 0) + p.host) AS rate
  FROM (SELECT DISTINCT host, domain, suffix FROM named) h
  CROSS JOIN prior p
  LEFT JOIN totals t ON t.host = h.host
  LEFT JOIN units d ON d.level = 'domain' AND d.unit = h.domain
  LEFT JOIN units x ON x.level = 'suffix' AND x.unit = h.suffix
)
SELECT page_id, named.host, path, rule,
       coalesce(rule_verdict, CASE WHEN rate - sqrt(rate * (1 - rate) / (size + 1)) > 0.5 THEN 'block' ELSE 'allow' END)
         AS verdict
FROM named JOIN rated ON rated.host = named.host
"""

SOURCE_DIVERGENCE = r"""
WITH read AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), uses AS (
  SELECT doc, lang, source, unnest(terms) AS term FROM read
), kept AS (
  SELECT lang, term, count(*)::HUGEINT AS uses FROM uses GROUP BY lang, term HAVING count(DISTINCT doc) >= 3
), groups AS (
  SELECT DISTINCT lang, source FROM read
), counts AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n FROM uses JOIN kept USING (lang, term) GROUP BY ALL
), sizes AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(uses)::HUGEINT AS total FROM kept GROUP BY lang
), whole AS (
  SELECT groups.lang, groups.source, coalesce(sum(n), 0)::HUGEINT AS total
  FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL
), shares AS (
  SELECT whole.lang, whole.source, kept.term, coalesce(n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (whole.total + v) AS p,
         1 + (1000000000::HUGEINT * (uses + 1)) // (sizes.total + v) AS q
  FROM whole JOIN kept USING (lang) JOIN sizes USING (lang) LEFT JOIN counts USING (lang, source, term)
), valued AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN valued ON valued.lang = a.lang AND valued.source = a.source AND valued.item = b.source
), above AS (
  SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value
  FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM above)
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""

HARD_NEGATIVES = """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS codes
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, a.vec_id = r.vec_id AS own,
         list_inner_product(a.codes, r.codes)::BIGINT AS score
  FROM whole a, whole r WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same AND NOT own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
  SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank
  FROM positives JOIN scored USING (anchor_id)
  WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""
