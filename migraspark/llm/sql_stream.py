"""DuckDB statements for the operators that read texts and conversations from front to back."""

_WORD = r"[^\x20\x09-\x0D]+"

# The checksum of a text of ASCII characters, byte by byte over a table made by rule.
CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce([i] || list_transform(range(8), lambda x: 0::BIGINT), lambda c, x:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
)"""


def crc32(text: str) -> str:
    """An expression for the CRC-32 of ``text``; ``t`` of crc_table must be in reach."""
    return (
        f"xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split({text}, ''), "
        "lambda ch: ascii(ch)::BIGINT), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])))"
    )


def _later(key: str, cost: str, letter: str) -> str:
    """A key (six digits of cost, then the edits) after one more edit; keys compare as wanted."""
    return f"(lpad((substr({key}, 1, 6)::BIGINT + {cost})::VARCHAR, 6, '0') || substr({key}, 7) || '{letter}')"


_KEPT = "CASE WHEN NOT bad AND initial = '{}' THEN " + _later("{}", "extra", "K") + " END"
_REROLED = "CASE WHEN NOT bad THEN " + _later("{}", "3 + extra", "R") + " END"

CONVERSATIONS = f"""
WITH RECURSIVE {CRC_TABLE}, keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
  FROM conversations, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM keyed WHERE kind <> 0
), numbered AS (
  SELECT *, row_number() OVER w AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
    lag(left(role, 1)) OVER w || left(role, 1) AS pair
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
), faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '{_WORD}') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault
  FROM numbered
), steps AS (
  SELECT conv_id, n, role, text, left(role, 1) AS initial, fault IN ('blank', 'duplicate') AS bad,
    CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS extra
  FROM faults
), best AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS n, '000000' AS e, NULL::VARCHAR AS s, '000003I' AS u, '000006II' AS a
  FROM steps
  UNION ALL
  SELECT conv_id, n, e, s, least(u, {_later("a", "3", "I")}) AS u, a
  FROM (
    SELECT conv_id, n, e, s, u, least(a, {_later("u", "3", "I")}) AS a
    FROM (
      SELECT conv_id, n, e, s, a, least(u, {_later("e", "3", "I")}, {_later("s", "3", "I")}, {_later("a", "3", "I")}) AS u
      FROM (
        SELECT b.conv_id, r.n,
          {_later("e", "4", "D")} AS e,
          least({_later("s", "4", "D")}, {_KEPT.format("s", "e", "e")}) AS s,
          least({_later("u", "4", "D")}, {", ".join(_KEPT.format("u", x, x) + ", " + _REROLED.format(x, x) for x in "esa")}) AS u,
          least({_later("a", "4", "D")}, {_KEPT.format("a", "u", "u")}, {_REROLED.format("u", "u")}) AS a
        FROM best b JOIN steps r ON b.conv_id IS NOT DISTINCT FROM r.conv_id AND r.n = b.n + 1
      )
    )
  )
), chosen AS (
  SELECT conv_id, least(e, a) AS k FROM best QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1
), replay AS (
  SELECT conv_id, substr(k, 7) AS audit, 0 AS i, 0::BIGINT AS n, '' AS state, []::VARCHAR[] AS lines FROM chosen
  UNION ALL
  SELECT p.conv_id, audit, i + 1, CASE WHEN letter = 'I' THEN p.n ELSE p.n + 1 END,
    CASE WHEN letter = 'D' THEN state WHEN letter = 'K' THEN initial WHEN state = 'u' THEN 'a' ELSE 'u' END,
    CASE WHEN letter = 'D' THEN lines ELSE list_append(lines,
      CASE WHEN letter = 'K' THEN r.role WHEN state = 'u' THEN 'assistant' ELSE 'user' END
      || ':' || CASE WHEN letter = 'I' THEN '' ELSE r.text END) END
  FROM (SELECT *, substr(audit, i + 1, 1) AS letter FROM replay WHERE i < length(audit)) p
  JOIN steps r ON p.conv_id IS NOT DISTINCT FROM r.conv_id AND r.n = greatest(1, least(p.n + 1, (SELECT max(n) FROM steps x WHERE x.conv_id IS NOT DISTINCT FROM p.conv_id)))
), ended AS (
  SELECT conv_id, audit, array_to_string(lines, chr(10)) AS body FROM replay WHERE i = length(audit)
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id
), ids AS (
  SELECT DISTINCT conv_id FROM conversations
)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
  coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(substr(k, 1, 6)::BIGINT, 0) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM ids i
LEFT JOIN counted c ON i.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN chosen h ON i.conv_id IS NOT DISTINCT FROM h.conv_id
LEFT JOIN ended d ON i.conv_id IS NOT DISTINCT FROM d.conv_id
"""

PERIODIC_RUNS = f"""
WITH {CRC_TABLE}, split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w, {crc32("doc_id::VARCHAR")} AS h
  FROM documents, crc_table
), looped AS (
  SELECT doc_id, w, (h // 10) % greatest(len(w), 1) AS a, h // 10 AS g, coalesce(h % 10 = 0, FALSE) AND len(w) > 0 AS loops FROM split
), texts AS (
  SELECT doc_id, CASE WHEN loops THEN list_transform(range(len(w)), lambda i:
    w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (len(w) - a) // (3 + g % 8)) END]) ELSE w END AS w
  FROM looped
), periods AS (
  SELECT doc_id, w, unnest(range(1, len(w) // 4 + 1)) AS p FROM texts
), equal AS (
  SELECT doc_id, p, len(w) AS n, unnest(list_filter(range(len(w) - p), lambda i: w[i + 1] = w[i + p + 1])) AS i FROM periods
), islands AS (
  SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM equal
), stretches AS (
  SELECT doc_id, p, min(i) AS start, max(i) + 1 + p AS stop FROM islands GROUP BY doc_id, p, island
  HAVING count(*) + p >= greatest(6, 4 * p)
), runs AS (
  SELECT doc_id, start, stop - start AS length, min(p) AS period FROM stretches GROUP BY doc_id, start, stop
), per_doc AS (
  SELECT doc_id, count(*) AS n_runs,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    arg_min(struct_pack(s := start, l := length, p := period), (-length, start, period)) AS best
  FROM runs GROUP BY doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS body
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM texts) t
  ANTI JOIN gone g USING (doc_id, i) GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length,
  best.p::BIGINT AS period, (1000 * best.l // best.p)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
FROM texts t LEFT JOIN per_doc USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

SUBSTRING_DEDUP = f"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM split WHERE len(w) >= 50)
), repeated AS (
  SELECT doc_id, i FROM windows QUALIFY min(doc_id) OVER (PARTITION BY h) < doc_id
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM repeated, range(50) r(k)
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM split
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS body, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT s.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(body, '')) AS kept_sha256
FROM split s LEFT JOIN kept USING (doc_id)
"""
