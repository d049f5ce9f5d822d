"""SQL that must give the same rows as the queries, for DuckDB."""

WORD = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Every pair that shares a shingle is counted, the linked pairs are closed by recursion.
NEAR_DEDUP = f"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(coalesce({LOWER}, ''), '{WORD}') AS w FROM documents),
items AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w]
         ELSE list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3]) END) AS s FROM t),
sets AS (SELECT DISTINCT doc_id, s FROM items),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * shared.n >= 80 * (p.n + q.n - shared.n)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least ON x = d.doc_id LEFT JOIN sizes USING (doc_id)
"""

#: The same closure for the Jaccard join: other threshold, no kept column.
JACCARD_JOIN = NEAR_DEDUP.replace(">= 80 *", ">= 85 *").replace(", d.doc_id = component_id AS kept", "")

#: Every window of 50 words, grouped by its words.
SUFFIX_DEDUP = f"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
wins AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM t)),
origins AS (SELECT h, min((doc_id, i)) AS o FROM wins GROUP BY h HAVING count(*) > 1),
found AS (SELECT w.doc_id, i, o[1] AS origin, o <> (w.doc_id, i) AS removed FROM wins w JOIN origins USING (h)),
marked AS (
  SELECT *, CASE WHEN i <= max(i + 50) OVER (PARTITION BY doc_id, removed ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens
  FROM found),
spans AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, removed ORDER BY i) AS island FROM marked)
SELECT doc_id, min(i)::INT AS "begin", (max(i) + 50)::INT AS "end", removed, list_sort(list(DISTINCT origin)) AS first_doc_ids
FROM spans GROUP BY doc_id, removed, island
"""

#: Every run of words of every window length, joined with the windows.
DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce({LOWER}, ''), '{ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(coalesce({LOWER}, ''), '{ALNUM}') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda i: w[i:i + least(13, len(w)) - 1])) AS win
  FROM b WHERE len(w) > 0),
starts AS (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM wins)),
occ AS (SELECT DISTINCT r, i, s.k, item_id FROM starts s JOIN wins ON wins.k = s.k AND win = w[i:i + s.k - 1]),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM occ) GROUP BY r),
named AS (SELECT r, list(DISTINCT item_id::VARCHAR) AS ids FROM occ WHERE item_id IS NOT NULL GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(list_sort(ids), ','), '')) AS items_sha256, coalesce(n, 0) > 0 AND 20 * coalesce(n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

#: Water level by the sorted caps; the sampled repetition by one running sum per source.
MIXING = f"""
WITH t AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
         ('0x' || md5('20:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, ''))[1:13])::BIGINT AS place FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM t GROUP BY source),
named AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM sizes),
caps AS (SELECT *, [5, 2, 1][(nth - 1) % 3 + 1] AS weight, 3 * source_size AS cap FROM named),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM caps),
closed AS (SELECT *, cap / weight <= level AS capped FROM levels),
shares AS (
  SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE
         ELSE weight * (SELECT arg_min(level, (cap / weight, nth)) FROM closed WHERE NOT capped) END AS target FROM closed),
whole AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size)) ELSE 0 END::BIGINT AS whole FROM shares),
parts AS (SELECT *, greatest(0, round(target)::BIGINT - whole * source_size) AS part FROM whole),
places AS (SELECT source, place, sum(size) AS words, count(*) AS n FROM t WHERE size > 0 GROUP BY ALL),
running AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM places)
SELECT doc_id, size::BIGINT AS size, p.source_size, target,
       (whole * size + CASE WHEN size = 0 OR before >= part THEN 0 WHEN before + words < part THEN size
                            WHEN before + words = part AND n = 1 THEN size ELSE (part - before) // n END)::BIGINT AS taken
FROM t JOIN parts p ON t.source IS NOT DISTINCT FROM p.source
LEFT JOIN running r ON t.source IS NOT DISTINCT FROM r.source AND t.place = r.place
"""

#: formatted_chars follows from the template: 12 characters around role and text, one more per escaped mark.
CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, 4 + length(role) + 2 + length(text) + len(regexp_extract_all(text, '\\|###|</turn>')) + 9 AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
running AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM sized)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(CASE WHEN role = 'assistant' OR i = n THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM running GROUP BY conv_id
"""

#: Holds for the layout of the given pages: one article of headings and paragraphs, with b and br inside.
HTML_TEXT = r"""
WITH a AS (SELECT page_id, url, coalesce(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '') AS body FROM pages),
b AS (SELECT page_id, url, unnest(list_concat([''], string_split_regex(body, '</?(?:p|h1)>'))) AS part, unnest(range(0, len(string_split_regex(body, '</?(?:p|h1)>')) + 1)) AS i FROM a),
c AS (
  SELECT page_id, url, i, trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(part, '<br>', ' ', 'g'), '</?b>', '', 'g'),
         '&quot;', '"'), '&amp;', '&'), '&amp', '&'), '[\s\x0B]+', ' ', 'g')) AS t FROM b)
SELECT page_id, url, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY i) FILTER (t <> ''), '') AS text,
       length(coalesce(string_agg(t, chr(10) || chr(10) ORDER BY i) FILTER (t <> ''), ''))::BIGINT AS n_chars
FROM c GROUP BY page_id, url
"""

ORACLE = {
    "op9_html_text": HTML_TEXT,
    "op8_chat": CHAT,
    "op1_suffix_dedup": SUFFIX_DEDUP,
    "op5_decontamination": DECONTAMINATION,
    "op10_mixing": MIXING,
    "op7_near_dedup": NEAR_DEDUP,
    "op11_jaccard_join": JACCARD_JOIN,
}
