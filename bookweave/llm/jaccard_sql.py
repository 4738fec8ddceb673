"""SQL of the near-duplicate queries: all pairs of documents that share a shingle, and the closure of their links."""

from __future__ import annotations

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def links_sql(n: int, percent: int) -> str:
    """CTEs up to own (doc_id, n_shingles) and least (doc_id, component_id, n_links)."""
    return f"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^ \\t-\\r]+') AS w FROM documents),
 sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
   ELSE list_distinct(list_transform(range(1, len(w) - {n} + 2), lambda k: array_to_string(w[k:k + {n - 1}], ' '))) END AS s FROM words),
 own AS (SELECT doc_id, len(s)::BIGINT AS n_shingles FROM sets),
 each AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
 half AS (SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
   GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
 links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
 reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
 least AS (SELECT o.doc_id, least(o.doc_id, min(r.b)) AS component_id, (SELECT count(*) FROM links l WHERE l.a = o.doc_id) AS n_links FROM own o LEFT JOIN reach r ON r.a = o.doc_id GROUP BY 1) """


OP4_SQL = links_sql(4, 85) + "SELECT doc_id, n_shingles, component_id, n_links FROM own JOIN least USING (doc_id)"
OP11_SQL = links_sql(3, 85) + "SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM own JOIN least USING (doc_id)"
