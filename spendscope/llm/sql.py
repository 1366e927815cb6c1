"""DuckDB SQL of the queries of this subpackage that SQL can express."""

from __future__ import annotations

#: Each benchmark item's 50 best documents by integer scores.
LEXICAL_SEARCH = r"""
WITH words AS (
  SELECT doc_id, rid, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT doc_id, text, row_number() OVER () AS rid FROM documents)),
tf AS (SELECT doc_id, rid, term, count(*)::BIGINT AS tf FROM words GROUP BY ALL),
len AS (SELECT rid, sum(tf)::BIGINT AS n FROM tf GROUP BY rid),
total AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS l FROM len),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE item_id IS NOT NULL),
weight AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, total),
scored AS (
  SELECT item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * nn) // l)))))::BIGINT AS score
  FROM asked JOIN weight USING (term) JOIN tf USING (term) JOIN len USING (rid), total
  WHERE doc_id IS NOT NULL GROUP BY item_id, rid, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 50
"""


#: Near words through the texts that are left when one letter is taken away; the checksum's table follows from its polynomial.
SPELLING_VARIANTS = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256))::BIGINT AS i)),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS hashed, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
hashes AS (
  SELECT run, n, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(hex(hashed)) + 1, 2), lambda i: ('0x' || substr(hex(hashed), i::BIGINT, 2))::BIGINT),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h
  FROM runs, crc),
words AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashes)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
rests AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM rests a JOIN rests b USING (rest, i) WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM words a JOIN rests b ON a.word = b.rest
  UNION SELECT b.word, a.word, a.n FROM words a JOIN rests b ON a.word = b.rest),
best AS (
  SELECT word, count(*) AS n_near, (list(struct_pack(other := other, n := other_n) ORDER BY other_n DESC, other))[1] AS b FROM near GROUP BY word),
found AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN b.n >= 10 * n THEN b.other END AS form, CASE WHEN b.n >= 10 * n THEN b.n END AS form_n
  FROM words LEFT JOIN best USING (word)),
way AS (
  SELECT word, word AS at FROM found
  UNION ALL SELECT way.word, found.form FROM way JOIN found ON way.at = found.word WHERE found.form IS NOT NULL)
SELECT f.word, f.form, way.at AS root, f.n, f.n_near, f.form_n
FROM found f JOIN way ON f.word = way.word JOIN found l ON way.at = l.word WHERE l.form IS NULL
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_lexical_search": LEXICAL_SEARCH, "op13_spelling_variants": SPELLING_VARIANTS}
