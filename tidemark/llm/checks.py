"""Independent SQL for the queries that SQL can express over whole tables."""

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = f"regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
g AS (SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 9), ' '))) AS gram,
             least(len(w), 10) AS n FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM g),
dg AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram FROM dg
        WHERE array_to_string(list_slice(w, i, i + n - 1), ' ') IN (SELECT gram FROM g)),
words_hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) AS x GROUP BY doc_id),
items AS (SELECT DISTINCT h.doc_id, CAST(g.item_id AS VARCHAR) AS item FROM hit AS h JOIN g ON g.gram = h.gram),
item_list AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM items GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words_hit USING (doc_id) LEFT JOIN item_list USING (doc_id)
"""

SHARDS, SLOTS = 64, 6553

SHARDING = f"""
WITH RECURSIVE shard AS (SELECT list(('0x' || substr(md5('shard-' || lpad(CAST(i AS VARCHAR), 2, '0') || '/offset'), 1, 15))::BIGINT % {SLOTS} ORDER BY i) AS wish,
       list(1 + ('0x' || substr(md5('shard-' || lpad(CAST(i AS VARCHAR), 2, '0') || '/stride'), 1, 15))::BIGINT % ({SLOTS} - 1) ORDER BY i) AS stride
  FROM range({SHARDS}) AS r(i)),
turn AS (
  SELECT 0 AS t, CAST(NULL AS BIGINT) AS slot, list_transform(range({SLOTS}), lambda i: true) AS free
  UNION ALL
  SELECT t + 1, pick, list_transform(free, lambda f, i: f AND i <> pick + 1) FROM (
    SELECT t, free, list_filter(list_transform(range({SLOTS}), lambda j: (wish[t % {SHARDS} + 1] + j * stride[t % {SHARDS} + 1]) % {SLOTS}),
                                lambda s: free[s + 1])[1] AS pick
    FROM turn, shard WHERE t < {SLOTS}) AS x),
owner AS (SELECT slot, 'shard-' || lpad(CAST((t - 1) % {SHARDS} AS VARCHAR), 2, '0') AS shard FROM turn WHERE t > 0),
d AS (SELECT doc_id, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT % {SLOTS} AS slot FROM documents)
SELECT doc_id, d.slot, shard FROM d JOIN owner USING (slot)
"""

TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {TERMS} AS w FROM documents),
sizes AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
q AS (SELECT i, item_id, unnest(list_distinct(w)) AS term FROM (SELECT row_number() OVER () AS i, item_id, {TERMS} AS w FROM benchmark) AS b),
counts AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) AS u WHERE term IN (SELECT term FROM q) GROUP BY r, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, total GROUP BY term),
parts AS (SELECT r, term, tf, doc_id, 100 - 50 + ((50 * n * docs) // terms) AS m FROM counts JOIN sizes USING (r), total),
scored AS (SELECT i, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
           FROM q JOIN weights USING (term) JOIN parts USING (term) GROUP BY i, item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) AS x WHERE rank <= 50
"""
