"""SQL that must give the same rows as the queries, where SQL can say the same."""

from __future__ import annotations

#: CRC-32 over byte lists: the table by its rule, then one step a byte.
CRC = """crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k:
        CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t)"""


def crc32(text: str) -> str:
    """The unsigned CRC-32 of a string of Latin-1 code points in UTF-8; `crc` has to be joined."""
    data = (f"flatten(list_transform(string_split({text}, ''), lambda s: CASE WHEN unicode(s) < 128 THEN [unicode(s)::BIGINT]"
            " ELSE [192 + (unicode(s)::BIGINT >> 6), 128 + (unicode(s)::BIGINT & 63)] END))")
    return f"xor(list_reduce({data}, lambda c, b: xor(c >> 8, crc.t[xor(c & 255, b) + 1]), 4294967295), 4294967295)"


TRIE = f"""
WITH {CRC},
turns AS (SELECT conv_id, turn, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY said NULLS FIRST, turn) AS rank
    FROM (SELECT conv_id, turn AS said, octet_length(encode(coalesce(text, ''))) AS bytes,
            sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn
        FROM conversations WHERE conv_id IS NOT NULL)),
ids AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {crc32("conv_id::VARCHAR")} % 9 AS h
    FROM (SELECT DISTINCT conv_id FROM turns), crc),
kept AS (
    SELECT i.conv_id, 0 AS own, t.rank, t.turn, t.bytes FROM ids i JOIN turns t ON t.conv_id = i.base AND t.rank <= i.h
    UNION ALL SELECT i.conv_id, 1, t.rank, t.turn, t.bytes FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND t.rank > i.h),
named AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, rank) AS depth, turn, bytes FROM kept),
members AS (
    SELECT conv_id, 0 AS depth, '' AS name, 0 AS bytes FROM ids
    UNION ALL SELECT conv_id, depth, string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY depth), bytes FROM named),
ended AS (SELECT conv_id, max(depth) AS depth FROM members GROUP BY conv_id),
nodes AS (SELECT name, any_value(m.depth) AS depth, min(m.conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
        sha256(coalesce(string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id) FILTER (m.depth = e.depth), '')) AS ends_sha256
    FROM members m JOIN ended e ON e.conv_id = m.conv_id GROUP BY name),
children AS (SELECT left(name, 64 * (depth - 1)) AS name, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
valued AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c USING (name)),
above AS (SELECT left(name, 64 * unnest(range(depth + 1))) AS name, n_children, (n_convs - 1) * bytes AS saved FROM valued),
sums AS (SELECT name, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM above GROUP BY name)
SELECT v.conv_id, v.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, s.saved_tokens, v.ends_sha256
FROM valued v JOIN sums s ON s.name = v.name LEFT JOIN nodes p ON v.depth > 0 AND p.name = left(v.name, 64 * (v.depth - 1))
"""

VARIANTS = f"""
WITH RECURSIVE {CRC},
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
hashed AS (SELECT run, n, {crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM (
        SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run), crc),
words AS (SELECT word, sum(n)::BIGINT AS n FROM (
        SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n
        FROM hashed) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS (SELECT word, n, i, left(word, i::INT - 1) || substr(word, i::INT + 1) AS rest
        FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
    SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT l.word, w.word, w.n FROM less l JOIN words w ON w.word = l.rest
    UNION SELECT w.word, l.word, l.n FROM less l JOIN words w ON w.word = l.rest),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
named AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= 10 * w.n THEN b.other END AS form,
        CASE WHEN b.other_n >= 10 * w.n THEN b.other_n END AS form_n FROM words w LEFT JOIN best b USING (word)),
chain AS (SELECT word, word AS at FROM named
    UNION ALL SELECT c.word, f.form FROM chain c JOIN named f ON f.word = c.at WHERE f.form IS NOT NULL),
roots AS (SELECT c.word, c.at AS root FROM chain c JOIN named f ON f.word = c.at WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM named JOIN roots USING (word)
"""

SQL: dict[str, str] = {"op11_prefix_trie": TRIE, "op12_variants": VARIANTS}
