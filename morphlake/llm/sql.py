"""SQL of the audit and of the clustering."""

AUDIT = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(l.toxic, false) AS toxic,
        [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
         regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(w.doc_id) OVER (PARTITION BY t), false)] AS fails
      FROM w LEFT JOIN l USING (doc_id)),
g AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
n AS (SELECT k, chr(64 + k::INT) AS letter FROM generate_series(1, 5) s(k)),
o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS fs, a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order FROM n a, n b, n c, n d, n e
      WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT fs, filter_order, step::INT AS step, fs[step] AS f FROM o, generate_series(1, 5) q(step)),
r AS (SELECT g.*, s.*, fails[f] AS failing, len(list_filter(fs[1:step - 1], lambda x: fails[x])) > 0 AS gone, len(list_filter(fails, lambda x: x)) AS many FROM g, s),
p AS (SELECT part, f, sum(CASE WHEN failing AND NOT gone THEN n ELSE 0 END) AS shapley FROM r GROUP BY ALL)
SELECT part, filter_order, step, sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN failing AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN failing AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN failing AND many = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN failing AND NOT gone AND good THEN n ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN failing AND NOT gone AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost,
  shapley::BIGINT AS shapley
FROM r JOIN p USING (part, f) GROUP BY part, filter_order, step, shapley
"""


def clusters(rounds: int, k: int, dimensions: int, seed: int) -> str:
    """Vectors as rows of one component each; each round joins them with the
    centroids it has and moves these by floored means."""
    parts = [
        f"""v0 AS (SELECT row_number() OVER () AS r, vec_id, embedding AS e FROM embeddings WHERE len(embedding) = {dimensions}
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT r, vec_id, i, floor(256 * e[i]::DOUBLE)::BIGINT AS q FROM v0, generate_series(1, {dimensions}) g(i)),
h AS MATERIALIZED (SELECT r, row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')), list_transform(e, lambda x: floor(256 * x::DOUBLE))) - 1 AS c FROM v0 QUALIFY c < {k}),
c0 AS MATERIALIZED (SELECT c, i, q FROM h JOIN v USING (r))"""
    ]
    for n in range(rounds + 1):
        parts.append(
            f"""d{n} AS (SELECT r, c, sum((v.q - c{n}.q) * (v.q - c{n}.q))::BIGINT AS d FROM v JOIN c{n} USING (i) GROUP BY ALL),
a{n} AS MATERIALIZED (SELECT r, min(d) AS d, arg_min(c, (d, c)) AS c FROM d{n} GROUP BY 1)"""
        )
        if n < rounds:
            parts.append(
                f"""m{n} AS (SELECT c, i, sum(q) AS s, count(*) AS n FROM a{n} JOIN v USING (r) GROUP BY ALL),
c{n + 1} AS MATERIALIZED (SELECT c, i, coalesce(((s - ((s % n) + n) % n) // n)::BIGINT, c{n}.q) AS q FROM c{n} LEFT JOIN m{n} USING (c, i))"""
            )
    return (
        "WITH "
        + ",\n".join(parts)
        + f""",
x AS (SELECT c, sha256(string_agg(q::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY 1)
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN v0 USING (r) JOIN x USING (c)"""
    )
