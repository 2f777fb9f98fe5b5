"""Density clustering as a query."""

from __future__ import annotations

from tessera.operators import density as D
from tessera.plans.registry import query
from tessera.sources.tables import table

EPS, MIN_SAMPLES, SMALL = 1.2, 2, 5


@query("new_issue_clusters", f"""
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
near AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON list_distance(a.v, b.v) <= {EPS}),
deg AS MATERIALIZED (SELECT a AS vec_id, count(*) AS n FROM near GROUP BY a),
core AS MATERIALIZED (SELECT a, b FROM near JOIN deg da ON da.vec_id = a JOIN deg db ON db.vec_id = b WHERE da.n >= {MIN_SAMPLES} AND db.n >= {MIN_SAMPLES}),
reach AS (SELECT a, b FROM core UNION SELECT r.a, c.b FROM reach r JOIN core c ON c.a = r.b),
root AS (SELECT a AS vec_id, min(b) AS root FROM reach GROUP BY a),
named AS (SELECT d.vec_id, d.n, d.n >= {MIN_SAMPLES} AS is_core, CASE WHEN d.n >= {MIN_SAMPLES} THEN r.root
  ELSE (SELECT min(x.root) FROM near JOIN root x ON x.vec_id = near.b WHERE near.a = d.vec_id) END AS cluster_id FROM deg d LEFT JOIN root r USING (vec_id)),
sized AS (SELECT cluster_id, count(*) AS size FROM named WHERE cluster_id IS NOT NULL GROUP BY cluster_id)
SELECT vec_id, n AS n_neighbours, is_core, named.cluster_id, coalesce(size, 0) AS cluster_size, named.cluster_id IS NULL OR size < {SMALL} AS is_candidate
FROM named LEFT JOIN sized ON sized.cluster_id = named.cluster_id""")
def new_issue_clusters(spark, sf):
    """Density clusters of the text embeddings; noise and small clusters are candidates for new issue types.
    eps fits these vectors (none are within the reference's .5)."""
    return D.density_clusters(table(spark, sf, "embeddings"), "vec_id", "embedding", EPS, MIN_SAMPLES, SMALL)
