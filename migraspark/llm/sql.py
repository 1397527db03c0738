"""DuckDB statements that compute the queries' results in other ways."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"

NEAR_DEDUP = f"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM split
), shingles AS (
  SELECT doc_id, unnest(s) AS shingle FROM sets
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
  FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id < y.doc_id
  GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b
  WHERE 100 * common >= 75 * (len(p.s) + len(q.s) - common)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS other FROM sets
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.other
), smallest AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN smallest USING (doc_id)
"""

QUALITY_RULES = f"""
WITH parts AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, unnest(range(0, len(words) - 7)) AS i, words FROM parts WHERE len(words) >= 8
), texts AS (
  SELECT doc_id, i, array_to_string(words[i + 1:i + 8], ' ') AS win FROM windows
), repeated AS (
  SELECT doc_id, i FROM texts QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n FROM repeated, range(8) r(k) GROUP BY doc_id
), counts AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words, len(lines)::BIGINT AS n_lines,
    len(list_filter(words, lambda w: list_contains([{{stops}}], lower(w))))::BIGINT AS n_stop_words,
    len(list_filter(words, lambda w: upper(w) = w AND lower(w) <> w AND length(w) > 1))::BIGINT AS n_capital_words,
    len(list_filter(words, lambda w, i: w = words[i - 1]))::BIGINT AS n_echo_words,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[\\x20\\x09-\\x0D]*[-*•]')))::BIGINT AS n_bullet_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$')))::BIGINT AS n_ellipsis_lines
  FROM parts LEFT JOIN covered USING (doc_id)
), base AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts
)
SELECT *, NOT base_failed AND word_chars BETWEEN 2 * n_words AND 14 * n_words
  AND n_symbols <= 0.1 * n_words AND n_stop_words >= 0.05 * n_words AND n_capital_words <= 0.3 * n_words
  AND n_dup_lines <= 0.5 * n_lines AND n_echo_words <= 0.2 * n_words AND n_bullet_lines <= 0.9 * n_lines
  AND n_ellipsis_lines <= 0.3 * n_lines AS kept
FROM base
"""

MIXING = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size FROM documents
), per_source AS (
  SELECT source, sum(size)::BIGINT AS n,
    [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY n / w, source NULLS LAST) AS r FROM per_source
), left_over AS (
  SELECT *, (SELECT sum(n) * 150 / 100 FROM per_source)
      - 2 * coalesce(sum(n) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight
  FROM ranked
), free AS (
  SELECT r, rest::DOUBLE / weight::DOUBLE AS level FROM left_over WHERE 2 * n * weight > rest * w ORDER BY r LIMIT 1
), plan AS (
  SELECT source, n, CASE WHEN p.r >= f.r THEN w * f.level ELSE (2 * n)::DOUBLE END AS target
  FROM left_over p LEFT JOIN free f ON true
), placed AS (
  SELECT doc_id, s.source, size, n, target,
    row_number() OVER (PARTITION BY s.source ORDER BY size, doc_id) AS k,
    ('0x' || substr(md5('mix:' || coalesce(s.source, '')), 1, 5))::INT / 1048576.0::DOUBLE AS u,
    CASE WHEN n > 0 THEN target / n::DOUBLE ELSE 0 END AS rate
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, n AS source_size, target,
  ((floor(rate * k + u) - floor(rate * (k - 1) + u)) * size)::BIGINT AS taken
FROM placed
"""

URL_FILTER = """
WITH parsed AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), rules(verdict, rule_host, rule_path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
    ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fitting AS (
  SELECT page_id, host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    arg_max(verdict, length(rule_host || rule_path)) AS rule_verdict
  FROM parsed LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY ALL
), labelled AS (
  SELECT doc_id, max((quality = 0 OR toxic = 1)::INT) AS bad FROM labels
  WHERE (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY doc_id
), hosts AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS bad,
    CASE WHEN array_to_string(string_split(host, '.')[-2:], '.') IN ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br')
      THEN 2 ELSE 1 END AS labels, string_split(host, '.') AS p
  FROM parsed LEFT JOIN labelled ON page_id = doc_id GROUP BY host
), named AS (
  SELECT host, n, bad, array_to_string(p[-(labels + 1):], '.') AS domain, array_to_string(p[-labels:], '.') AS suffix FROM hosts
), s0 AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + 0.5) / (sum(n) + 1.0) FROM named)::DOUBLE AS prior
  FROM named GROUP BY suffix
), s1 AS (
  SELECT 1 / least(greatest((sum((bad - n * prior) ** 2) - sum(n * prior * (1 - prior)))
    / nullif(sum(n * n * prior * (1 - prior)) - sum(n * prior * (1 - prior)), 0), 0.001), 0.999) - 1 AS m FROM s0
), d0 AS (
  SELECT domain, sum(x.n) AS n, sum(x.bad) AS bad, any_value((s0.bad + m * prior) / (s0.n + m)) AS prior
  FROM named x JOIN s0 USING (suffix), s1 GROUP BY domain
), d1 AS (
  SELECT 1 / least(greatest((sum((bad - n * prior) ** 2) - sum(n * prior * (1 - prior)))
    / nullif(sum(n * n * prior * (1 - prior)) - sum(n * prior * (1 - prior)), 0), 0.001), 0.999) - 1 AS m FROM d0
), h0 AS (
  SELECT host, x.n, x.bad, (d0.bad + m * prior) / (d0.n + m) AS prior FROM named x JOIN d0 USING (domain), d1
), h1 AS (
  SELECT 1 / least(greatest((sum((bad - n * prior) ** 2) - sum(n * prior * (1 - prior)))
    / nullif(sum(n * n * prior * (1 - prior)) - sum(n * prior * (1 - prior)), 0), 0.001), 0.999) - 1 AS m FROM h0
), judged AS (
  SELECT host, n, bad, bad + m * prior AS a, n - bad + m * (1 - prior) AS b FROM h0, h1
)
SELECT page_id, f.host, path, rule, coalesce(rule_verdict, CASE
    WHEN a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
  n AS host_labelled, bad AS host_bad
FROM fitting f JOIN judged USING (host)
"""

SHARDING = """
WITH RECURSIVE shards AS (
  SELECT list(('0x' || substr(md5('offset:' || s), 1, 15))::BIGINT % 4099 ORDER BY s) AS place,
    list(('0x' || substr(md5('skip:' || s), 1, 15))::BIGINT % 4098 + 1 ORDER BY s) AS skip
  FROM range(32) t(s)
), turns AS (
  SELECT 0 AS turn, -1::BIGINT AS slot, []::BIGINT[] AS taken
  UNION ALL
  SELECT turn + 1, claimed, list_append(taken, claimed) FROM (
    SELECT turn, taken, list_extract(list_filter(list_transform(range(4099),
        lambda j: (place[(turn % 32 + 1)::INT] + j * skip[(turn % 32 + 1)::INT]) % 4099),
        lambda c: NOT list_contains(taken, c)), 1) AS claimed
    FROM turns, shards WHERE turn < 4099)
), slots AS (
  SELECT slot, ((turn - 1) % 32)::INT AS shard FROM turns WHERE turn > 0
)
SELECT doc_id, slot, shard FROM (
  SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 15))::BIGINT % 4099 AS slot FROM documents
) JOIN slots USING (slot)
"""

_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
# Five hex digits are four base-32 digits.
_BASE32 = " || ".join(
    f"substr('{_DIGITS}', (('0x' || substr(sha, {5 * i + 1}, 5))::INT >> {shift}) % 32 + 1, 1)"
    for i in range(8)
    for shift in (15, 10, 5, 0)
)

WARC = f"""
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM payloads
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM firsts
"""

LINE_DEDUP = """
WITH RECURSIVE numbered AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM documents
), lines AS (
  SELECT doc_id, line_no, line FROM numbered WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
), distinct_lines AS (
  SELECT line, row_number() OVER (ORDER BY line) AS id, hex(encode(line)) AS h FROM (SELECT DISTINCT line FROM lines)
), sets AS (
  SELECT id, list_distinct(list_transform(range(0, greatest(len(h) // 2 - 7, 1)), lambda i: substr(h, (2 * i + 1)::BIGINT, 16))) AS s
  FROM distinct_lines
), shingles AS (
  SELECT id, unnest(s) AS shingle FROM sets
), shared AS (
  SELECT x.id AS a, y.id AS b, count(*) AS common
  FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.id < y.id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sets p ON p.id = a JOIN sets q ON q.id = b
  WHERE 100 * common >= 80 * (len(p.s) + len(q.s) - common)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT a AS id, a AS other FROM both_ways
  UNION
  SELECT r.id, e.b FROM reach r JOIN both_ways e ON e.a = r.other
), classes AS (
  SELECT id, min(other) AS class FROM reach GROUP BY id
), judged AS (
  SELECT doc_id, line_no, row_number() OVER (PARTITION BY coalesce(class, id) ORDER BY doc_id, line_no) > 1 AS removed
  FROM lines JOIN distinct_lines USING (line) LEFT JOIN classes USING (id)
), per_doc AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (removed) AS n_removed,
    coalesce(list(line_no::INT ORDER BY line_no) FILTER (removed), []::INT[]) AS removed
  FROM judged GROUP BY doc_id
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  coalesce(removed, []::INT[]) AS removed
FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN per_doc USING (doc_id)
"""
