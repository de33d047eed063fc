"""The two clusterings of vectors as SQL, round by round, comparing every vector with every centroid."""

from __future__ import annotations

KEPT = """
SELECT vec_id, {columns} list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}"""


def squares(width: int) -> str:
    """Squared distance of p.v and c.v."""
    terms = f"list_transform(range(1, {width + 1}), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i]))"
    return f"CAST(list_sum({terms}) AS BIGINT)"


def means(name: str, groups: str, nearest: str, before: str, width: int) -> str:
    """A round's centroids; those without members stay."""
    keys = f"{groups}, c" if groups else "c"
    part = f"{groups}, " if groups else ""
    return f"""
{name} AS (SELECT {keys}, coalesce(m.v, b.v) AS v FROM {before} b LEFT JOIN (
  SELECT {keys}, list(x ORDER BY d) AS v FROM (
    SELECT {keys}, d, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS x
    FROM (SELECT {part}c, unnest(v) AS x, unnest(range({width})) AS d FROM {nearest}) GROUP BY {keys}, d) GROUP BY {keys}
) m USING ({keys}))"""


def clusters(scale: int = 64, dims: int = 64, k: int = 16, rounds: int = 3) -> str:
    steps = [f"kept AS ({KEPT.format(columns='', scale=scale, dims=dims)})",
             f"""
points AS (SELECT *, row_number() OVER (ORDER BY vec_id, v) AS r FROM kept)""", f"""
c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v
       FROM (SELECT sha256('1:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT {k}))"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min_by(c, (d, c)) AS c, min(d) AS d
         FROM (SELECT p.r, p.vec_id, p.v, c.c, {squares(dims)} AS d FROM points p, c{i} c) GROUP BY r)""")
        if i < rounds:
            steps.append(means(f"c{i + 1}", "", f"a{i}", f"c{i}", dims))
    return f"""
WITH {",".join(steps)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (c)"""


def codes(scale: int = 256, dims: int = 64, parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    size = dims // parts
    steps = [f"kept AS ({KEPT.format(columns='label,', scale=scale, dims=dims)})", f"""
whole AS (SELECT vec_id, label, v, row_number() OVER (ORDER BY vec_id, v) AS r FROM kept)""", f"""
points AS (SELECT r, part, list_slice(v, part * {size} + 1, part * {size} + {size}) AS v
           FROM (SELECT r, v, unnest(range({parts})) AS part FROM whole))""", f"""
c0 AS (SELECT part, r - 1 AS c, v FROM points WHERE r <= {entries})"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS (SELECT r, part, any_value(v) AS v, min_by(c, (d, c)) AS c, min(d) AS d
         FROM (SELECT p.r, p.part, p.v, c.c, {squares(size)} AS d FROM points p JOIN c{i} c USING (part)) GROUP BY r, part)""")
        if i < rounds:
            steps.append(means(f"c{i + 1}", "part", f"a{i}", f"c{i}", size))
    return f"""
WITH {",".join(steps)},
coded AS (SELECT r, string_agg(printf('%02x', c), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
          FROM a{rounds} GROUP BY r),
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, c)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN whole USING (r) CROSS JOIN books"""
