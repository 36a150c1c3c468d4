"""The manifest of the documents in SQL, for comparison."""


def _field(name: str) -> str:
    return f"coalesce(octet_length(encode({name}::VARCHAR))::VARCHAR || ':' || {name}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


# One step of CRC-32 is a byte xored in and eight shifts; 3988292384 is its reflected polynomial.
CRC = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ord(ch)::UBIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda z: z::UBIGINT)),
      lambda x, z: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))), 4294967295::UBIGINT)"""

SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || source, '') AS src, {_leaf("text")} AS leaf,
    {_leaf("CASE WHEN " + CRC + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS now FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
tree AS (
  SELECT src, 0 AS k, i, leaf AS d FROM placed
  UNION ALL
  SELECT src, k + 1, i // 3, sha256(string_agg(d, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER (PARTITION BY src) AS n FROM tree) WHERE n > 1 GROUP BY src, k, i // 3),
subroots AS (SELECT src, max(k) AS top, arg_max(d, k) AS subroot, row_number() OVER (ORDER BY encode(src)) - 1 AS place FROM tree GROUP BY src),
over_all AS (
  SELECT 0 AS k, place AS i, subroot AS d FROM subroots
  UNION ALL
  SELECT k + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS n FROM over_all) WHERE n > 1 GROUP BY k, i // 3),
root AS (SELECT max(k) AS top, arg_max(d, k) AS root FROM over_all),
inner_way AS (
  SELECT src, p.i AS leaf_at, t.k, (p.i // (3 ** t.k)::BIGINT) AS own, t.i AS other, t.d
  FROM placed p JOIN tree t USING (src) WHERE t.i // 3 = p.i // (3 ** t.k)::BIGINT // 3 AND t.k < (SELECT top FROM subroots s WHERE s.src = p.src)),
outer_way AS (
  SELECT s.src, o.k, s.place // (3 ** o.k)::BIGINT AS own, o.i AS other, o.d
  FROM subroots s, over_all o WHERE o.i // 3 = s.place // (3 ** o.k)::BIGINT // 3 AND o.k < (SELECT top FROM root)),
up AS (
  SELECT src, i AS leaf_at, 0 AS k, now AS d FROM placed
  UNION ALL
  SELECT up.src, up.leaf_at, up.k + 1, sha256(string_agg(CASE WHEN w.other = w.own THEN up.d ELSE w.d END, '' ORDER BY w.other))
  FROM up JOIN inner_way w ON w.src = up.src AND w.leaf_at = up.leaf_at AND w.k = up.k GROUP BY up.src, up.leaf_at, up.k),
subs AS (SELECT src, leaf_at, arg_max(d, k) AS d FROM up GROUP BY src, leaf_at),
further AS (
  SELECT src, leaf_at, 0 AS k, d FROM subs
  UNION ALL
  SELECT f.src, f.leaf_at, f.k + 1, sha256(string_agg(CASE WHEN w.other = w.own THEN f.d ELSE w.d END, '' ORDER BY w.other))
  FROM further f JOIN outer_way w ON w.src = f.src AND w.k = f.k GROUP BY f.src, f.leaf_at, f.k),
ends AS (SELECT src, leaf_at, arg_max(d, k) AS folded_root FROM further GROUP BY src, leaf_at),
inner_proof AS (SELECT src, leaf_at, string_agg(d, '' ORDER BY k, other) AS p FROM inner_way WHERE other <> own GROUP BY src, leaf_at),
outer_proof AS (SELECT src, string_agg(d, '' ORDER BY k, other) AS p FROM outer_way WHERE other <> own GROUP BY src)
SELECT p.doc_id, p.leaf, s.subroot, r.root, sha256(coalesce(a.p, '') || coalesce(b.p, '')) AS proof_sha256, e.folded_root, e.folded_root = r.root AS verified
FROM placed p JOIN subroots s USING (src) CROSS JOIN root r JOIN ends e ON e.src = p.src AND e.leaf_at = p.i
LEFT JOIN inner_proof a ON a.src = p.src AND a.leaf_at = p.i LEFT JOIN outer_proof b ON b.src = p.src"""
