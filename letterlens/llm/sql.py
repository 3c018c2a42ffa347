"""SQL for comparison, for the queries that SQL can express."""

_FIELDS = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", "{text}")


def _leaf(text: str) -> str:
    values = [field.format(text=text) for field in _FIELDS]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


def _levels(name: str, count: int) -> str:
    """Levels of all trees of a table name0 (tree, place, node), and for its members name_at0 (id, tree, place, folded, proof)."""
    return ", ".join(
        f"""
{name}_runs{i} AS MATERIALIZED (
  SELECT tree, place // 16 AS place, any_value(n) AS n, list(node ORDER BY place) AS nodes
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}{i - 1}) GROUP BY tree, place // 16
), {name}{i} AS MATERIALIZED (
  SELECT tree, place, CASE WHEN n = 1 THEN nodes[1] ELSE sha256(array_to_string(nodes, '')) END AS node FROM {name}_runs{i}
), {name}_sides{i} AS MATERIALIZED (
  SELECT m.id, m.tree, r.place, m.folded, m.proof, r.n, array_to_string(r.nodes[1:m.place % 16], '') AS l,
    array_to_string(r.nodes[m.place % 16 + 2:], '') AS r
  FROM {name}_at{i - 1} m JOIN {name}_runs{i} r ON m.tree = r.tree AND m.place // 16 = r.place
), {name}_at{i} AS MATERIALIZED (
  SELECT id, tree, place, CASE WHEN n = 1 THEN folded ELSE sha256(l || folded || r) END AS folded, proof || l || r AS proof FROM {name}_sides{i}
)"""
        for i in range(1, count + 1)
    )


# Five levels hold a million rows of a source, three hold 4,096 sources.
MERKLE_MANIFEST = f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS table_
), d AS MATERIALIZED (
  SELECT row_number() OVER () AS id, doc_id, coalesce('=' || source, '') AS tree, {_leaf("text")} AS leaf,
    {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS small,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
      lambda c, b: xor(c >> 8, table_[(xor(c, b) & 255) + 1])), 4294967295) % 5 = 0 AS hit
  FROM documents, crc
), placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, coalesce(hit, false) AS tampered FROM d
), s0 AS MATERIALIZED (SELECT tree, place, leaf AS node FROM placed),
s_at0 AS MATERIALIZED (SELECT id, tree, place, CASE WHEN tampered THEN small ELSE leaf END AS folded, '' AS proof FROM placed),
{_levels("s", 5)},
t0 AS MATERIALIZED (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS place, node, tree AS source FROM s5),
t_at0 AS MATERIALIZED (SELECT m.id, '' AS tree, t.place, m.folded, m.proof FROM s_at5 m JOIN t0 t ON m.tree = t.source),
{_levels("t", 3)}
SELECT p.doc_id, p.leaf, t0.node AS subroot, t3.node AS root, sha256(m.proof) AS proof_sha256, m.folded AS folded_root,
  m.folded = t3.node AS verified, p.tampered, CAST(CASE WHEN p.tampered AND p.small <> p.leaf THEN h.levels ELSE 0 END AS INTEGER) AS n_copied
FROM placed p JOIN t_at3 m ON p.id = m.id JOIN t0 ON t0.source = p.tree JOIN t3 ON true
JOIN (SELECT a.tree, CAST(ceil(round(log(a.n) / log(16), 9)) + ceil(round(log(b.n) / log(16), 9)) AS INTEGER) AS levels
  FROM (SELECT tree, count(*) AS n FROM s0 GROUP BY tree) a, (SELECT count(*) AS n FROM t0) b) h ON h.tree = p.tree
"""

FILTER_AUDIT = r"""
WITH known AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), texts AS (
  SELECT d.doc_id, coalesce(d.lang, '') AS part, coalesce(d.text, '') AS t, coalesce(k.good, 0) AS good, coalesce(k.toxic, 0) AS toxic,
    regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents d LEFT JOIN known k ON d.doc_id = k.doc_id
), masks AS (
  SELECT part, good, toxic,
    (CASE WHEN len(w) < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS mask
  FROM texts
), cells AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask
), f AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS f(name, bit)
), orders AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
), steps AS (
  SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS BIGINT) AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), counted AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, bit,
    sum(CASE WHEN mask & (before + bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counted
"""


RULE_LEDGER = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), runs AS (
  SELECT id, i, array_to_string(w[i:i + 4], ' ') AS run FROM d, unnest(range(1, len(w) - 3)) AS _(i)
), twice AS (
  SELECT id, i, count(*) OVER (PARTITION BY id, run) > 1 AS again FROM runs
), repeated AS (
  SELECT id, count(DISTINCT i + k) AS n FROM twice, range(0, 5) AS _(k) WHERE again GROUP BY id
), lines AS (
  SELECT id, line FROM d, unnest(string_split(text, chr(10))) AS _(line) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), line_counts AS (
  SELECT id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM lines GROUP BY id
), m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(l.dup, 0) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS n_lines, CAST(len(regexp_extract_all(text, '[A-Z]')) AS BIGINT) AS n_upper,
    CAST(len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&|<>!]$'))) AS BIGINT) AS n_marked_words
  FROM d LEFT JOIN repeated r USING (id) LEFT JOIN line_counts l USING (id)
), bits AS (
  SELECT *, CAST((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (100 * n_symbols > 10 * word_chars)::INT
    + 8 * (100 * n_dup_lines > 30 * n_lines)::INT + 16 * (n_words >= 10 AND 100 * n_upper > 50 * word_chars)::INT
    + 32 * (n_words >= 10 AND 100 * n_marked_words > 30 * n_words)::INT + 64 * (word_chars > 40 * n_words)::INT AS BIGINT) AS failed_bits
  FROM m
), judged AS (
  SELECT *, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits & 3 = 0 AS kept_v1, failed_bits & 15 = 0 AS kept_v2,
    CASE failed_bits WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_words' WHEN 4 THEN 'symbols' WHEN 8 THEN 'duplicate_lines'
      WHEN 16 THEN 'capitals' WHEN 32 THEN 'marked_words' WHEN 64 THEN 'long_words' END AS deciding_rule
  FROM bits
)
SELECT *, CASE WHEN deciding_rule IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY deciding_rule) END AS gained_without FROM judged"""

_TEST_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
DECONTAMINATE = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, {_TEST_WORDS} AS w FROM documents
), items AS (SELECT item_id, {_TEST_WORDS} AS w FROM benchmark
), phrases AS MATERIALIZED (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS phrase
  FROM items, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS _(i) WHERE len(w) > 0
), lengths AS (SELECT DISTINCT n FROM phrases
), runs AS (
  SELECT id, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths)
), hits AS MATERIALIZED (SELECT r.id, r.i, r.n, p.item_id FROM runs r JOIN phrases p ON r.phrase = p.phrase AND r.n = p.n
), covered AS (SELECT id, count(DISTINCT j) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY id
), named AS (SELECT DISTINCT id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL
), found AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM named GROUP BY id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (id) LEFT JOIN found USING (id)"""

JACCARD_JOIN = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS _(i) WHERE len(w) > 0
), sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL) p
  JOIN sizes a ON a.doc_id = p.x JOIN sizes b ON b.doc_id = p.y WHERE 100 * common >= 80 * (a.n + b.n - common)
), reach AS (
  SELECT doc_id AS start, doc_id AS node FROM d UNION SELECT r.start, l.y FROM reach r JOIN links l ON r.node = l.x
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT start AS doc_id, min(node) AS component_id FROM reach GROUP BY start) c USING (doc_id)"""
