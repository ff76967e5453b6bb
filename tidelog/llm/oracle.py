"""DuckDB twins of the queries that SQL can express, over whole tables."""

SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP6 = f"""
WITH lines AS (
  SELECT doc_id, line_no, line, translate(trim(line, {SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no FROM documents)
), common AS (
  SELECT k, max(doc_id) AS last_doc FROM lines WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.doc_id, line_no, line, c.k IS NOT NULL AND l.doc_id <> c.last_doc AS dropped
  FROM lines l LEFT JOIN common c ON l.k = c.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP1 = """
WITH digested AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), originals AS (
  SELECT payload_digest, min(page_id) AS original FROM digested WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, d.payload_digest,
       CASE WHEN page_id > original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > original THEN original END AS refers_to
FROM digested d LEFT JOIN originals o ON d.payload_digest = o.payload_digest
"""

def _leaf(text: str) -> str:
    fields = ["doc_id", "source", "lang", "n_chars", text]
    return "sha256(" + " || ".join(
        f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')" for f in fields) + ")"


_ROUND = "xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)"
CRC32 = f"""xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
  list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: {_ROUND})))"""


def _tree(name: str, leaves: str) -> str:
    """(gid, level, idx, digest, n): all nodes of some trees, n being the number of nodes on the level."""
    return f"""{name}(gid, level, idx, digest, n) AS (
  SELECT gid, 0, idx, digest, count(*) OVER (PARTITION BY gid) FROM {leaves}
  UNION ALL
  SELECT gid, level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3
  FROM {name} WHERE n > 1 GROUP BY gid, level, idx // 3, n
)"""


def _siblings(tree: str, rows: str, after: str) -> str:
    return f"""SELECT r.pos, {after} t.level AS step, coalesce(string_agg(t.digest, '' ORDER BY t.idx) FILTER (WHERE t.idx < r.idx // CAST(pow(3, t.level) AS BIGINT)), '') AS l,
       coalesce(string_agg(t.digest, '' ORDER BY t.idx) FILTER (WHERE t.idx > r.idx // CAST(pow(3, t.level) AS BIGINT)), '') AS r
  FROM {rows} r JOIN {tree} t ON t.gid = r.gid AND t.n > 1 AND t.idx // 3 = r.idx // CAST(pow(3, t.level + 1) AS BIGINT)
  GROUP BY r.pos, t.level"""


OP11 = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, {_leaf("text")} AS digest,
         CASE WHEN {CRC32} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS tampered FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY gid ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx,
         row_number() OVER (ORDER BY gid, doc_id NULLS FIRST, digest) AS pos
  FROM (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS gid FROM docs)
), {_tree("lower_tree", "leaves")}, subroots AS (
  SELECT 0 AS gid, gid AS idx, gid AS pos, digest FROM lower_tree WHERE n = 1
), {_tree("upper_tree", "subroots")}, lower_steps AS (
  {_siblings("lower_tree", "leaves", "")}
), upper_steps AS (
  {_siblings("upper_tree", "subroots", "1000 +")}
), steps AS (
  SELECT pos, row_number() OVER (PARTITION BY pos ORDER BY step) AS step, l, r FROM (
    SELECT * FROM lower_steps UNION ALL
    SELECT v.pos, step, l, r FROM leaves v JOIN upper_steps u ON u.pos = v.gid)
), climb(pos, step, digest) AS (
  SELECT pos, 0, tampered FROM leaves
  UNION ALL
  SELECT c.pos, c.step + 1, sha256(s.l || c.digest || s.r) FROM climb c JOIN steps s ON s.pos = c.pos AND s.step = c.step + 1
), tops AS (
  SELECT pos, arg_max(digest, step) AS folded_root FROM climb GROUP BY pos
), proofs AS (
  SELECT pos, sha256(string_agg(l || r, '' ORDER BY step)) AS proof FROM steps GROUP BY pos
)
SELECT v.doc_id, v.digest AS leaf, s.digest AS subroot, u.digest AS root, coalesce(proof, sha256('')) AS proof_sha256,
       folded_root, folded_root = u.digest AS verified
FROM leaves v JOIN subroots s ON s.pos = v.gid JOIN upper_tree u ON u.n = 1 JOIN tops t ON t.pos = v.pos
LEFT JOIN proofs p ON p.pos = v.pos
"""

SQL = {"op1_warc": OP1, "op6_line_dedup": OP6, "op11_merkle": OP11}
