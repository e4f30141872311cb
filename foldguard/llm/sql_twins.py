"""SQL of the operators that need more than a few lines of it."""

from __future__ import annotations

from .merkle import FANOUT, FIELDS


def crc32_sql(digits: str) -> str:
    """crc32 of ASCII text, bit by bit."""
    bit = "list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, _: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END))"
    byte = f"lambda x, y: list_reduce(list_transform([xor(x, y)], lambda c: {bit}), lambda p, q: p)"
    codes = f"list_transform(string_split({digits}, ''), lambda d: CAST(ascii(d) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), {byte}), 4294967295)"


def manifest_sql(group_levels: int = 6, root_levels: int = 5) -> str:
    """Level by level, as the definition reads; up to ``16 ** group_levels`` rows a group."""

    def leaf(text: str = "text") -> str:
        parts = [f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in [*FIELDS[:-1], text]]
        return f"sha256({' || '.join(parts)})"

    def level(k: int, key: str, prefix: str) -> str:
        run = f"PARTITION BY {key}, pos // {FANOUT} ORDER BY pos ROWS BETWEEN"
        return f"""{prefix}f{k} AS (
  SELECT *, CASE WHEN n > 1 THEN coalesce(string_agg(node, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS l,
         CASE WHEN n > 1 THEN coalesce(string_agg(node, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS r
  FROM {prefix}{k}
), {prefix}{k + 1} AS (
  SELECT {key}, pos // {FANOUT} AS pos, (any_value(n) + {FANOUT - 1}) // {FANOUT} AS n,
         CASE WHEN any_value(n) = 1 THEN any_value(node) ELSE sha256(string_agg(node, '' ORDER BY pos)) END AS node
  FROM {prefix}{k} GROUP BY {key}, pos // {FANOUT}
)"""

    ctes = [
        f"""leaves AS (
  SELECT doc_id, source, {leaf()} AS leaf,
         CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {leaf()} END AS changed
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM leaves
), g0 AS (SELECT source AS k, place AS pos, n, leaf AS node FROM placed)"""
    ]
    ctes += [level(k, "k", "g") for k in range(group_levels)]
    ctes.append(
        f"t0 AS (SELECT 0 AS k, row_number() OVER (ORDER BY k NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, node, k AS source FROM g{group_levels})"
    )
    ctes += [level(k, "k", "t") for k in range(root_levels)]
    joins, proof, fold = [], [], "changed"
    for k in range(group_levels):
        joins.append(f"JOIN gf{k} ON gf{k}.k IS NOT DISTINCT FROM p.source AND gf{k}.pos = p.place // {FANOUT**k}")
        proof.append(f"gf{k}.l || gf{k}.r")
        fold = f"CASE WHEN gf{k}.n > 1 THEN sha256(gf{k}.l || {fold} || gf{k}.r) ELSE {fold} END"
    joins.append("JOIN t0 ON t0.source IS NOT DISTINCT FROM p.source")
    steps = []
    for k in range(root_levels):
        joins.append(f"JOIN tf{k} ON tf{k}.pos = t0.pos // {FANOUT**k}")
        proof.append(f"tf{k}.l || tf{k}.r")
        steps.append(f"tf{k}.n AS n{k}, tf{k}.l AS l{k}, tf{k}.r AS r{k}")
    ctes.append(f"""paths AS (
  SELECT p.doc_id, p.leaf, t0.node AS subroot, t{root_levels}.node AS root, sha256({' || '.join(proof)}) AS proof_sha256, {fold} AS folded, {', '.join(steps)}
  FROM placed p {' '.join(joins)} CROSS JOIN t{root_levels}
)""")
    fold = "folded"
    for k in range(root_levels):
        ctes.append(f"w{k} AS (SELECT * REPLACE (CASE WHEN n{k} > 1 THEN sha256(l{k} || folded || r{k}) ELSE folded END AS folded) FROM {'paths' if k == 0 else f'w{k - 1}'})")
    return f"""WITH {', '.join(ctes)}
SELECT doc_id, leaf, subroot, root, proof_sha256, folded AS folded_root, folded = root AS verified FROM w{root_levels - 1}"""


def trie_sql() -> str:
    """Every pair of a beginning and one that goes on from it, counted; for small tables."""
    return f"""WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
         sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
  FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 32), digest) - 1 AS place FROM t
), ids AS (SELECT conv_id, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)
), rebuilt AS (
  SELECT conv_id, place, digest, n_bytes FROM placed JOIN ids USING (conv_id) WHERE place >= h
  UNION ALL SELECT i.conv_id, p.place, p.digest, p.n_bytes FROM ids i JOIN placed p ON p.conv_id = i.conv_id - i.conv_id % 5 WHERE p.place < i.h
), paths AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(digest, '') OVER w AS path, n_bytes
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, '', 0 FROM ids
), sized AS (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS last FROM paths
), nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n_bytes) AS n_bytes,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = last), '')) AS ends_sha256
  FROM sized GROUP BY path, depth
), kids AS (SELECT left(path, length(path) - 64) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), below AS (SELECT DISTINCT a.path, b.path AS other FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND b.depth >= a.depth
), sums AS (
  SELECT below.path, CAST(sum((n.n_convs - 1) * n.n_bytes) AS BIGINT) AS saved_tokens, count(*) FILTER (k.path IS NULL) AS n_leaves
  FROM below JOIN nodes n ON n.path = below.other LEFT JOIN kids k ON k.path = below.other GROUP BY below.path
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s USING (path) LEFT JOIN kids k USING (path) LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, length(n.path) - 64)"""
