"""The jobs as registered queries, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import contact_cohort, link_graph
from tessera.plans.registry import D2, P, P2, RADIUS
from tessera.session import checkpoint_root

QUERIES, ORACLES = {}, {}


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; what a job writes there stays."""
    return f"{checkpoint_root(spark).rstrip('/')}/jobs/{name}-{uuid.uuid4().hex}"


def job1_contact_cohort(spark: SparkSession, sf: str) -> DataFrame:
    config = {"input": f"{sf}/embeddings.parquet", "output": _folder(spark, "contact-cohort"), "radius": RADIUS}
    contact_cohort.run(spark, config)
    return contact_cohort.run(spark, config)


def job2_link_graph(spark: SparkSession, sf: str) -> DataFrame:
    at = _folder(spark, "link-graph")
    config = {"input": f"{sf}/pages.parquet", "output": f"{at}/output", "checkpoint": f"{at}/checkpoint"}
    link_graph.run(spark, config)
    return link_graph.run(spark, config).select("site", "dst", "n_links", "degree")


QUERIES["job1_contact_cohort"] = job1_contact_cohort
QUERIES["job2_link_graph"] = job2_link_graph

#: Ranks share their mean among equals: 1 + rows below + half of the equals beside.
ORACLES["job1_contact_cohort"] = f"""WITH RECURSIVE {P}, {P2},
e AS (SELECT a.entity, a.id AS src, b.id AS dst FROM p a JOIN p b ON a.id <> b.id AND a.entity = b.entity WHERE {D2} <= CAST({RADIUS} AS DOUBLE)*CAST({RADIUS} AS DOUBLE)),
g AS (SELECT entity, src AS id, count(*) AS degree FROM e GROUP BY entity, src),
s AS (SELECT entity, id FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY degree DESC, id) AS rn FROM g) t WHERE rn = 1),
w(entity, id, frame) AS (SELECT entity, id, 0 FROM s UNION SELECT e.entity, e.dst, w.frame + 1 FROM w JOIN e ON e.src = w.id AND e.entity = w.entity WHERE w.frame < 40),
f AS (SELECT entity, id, min(frame) AS frame FROM w GROUP BY entity, id),
n AS (SELECT p.entity, p.id, coalesce(g.degree, 0) AS degree, coalesce(f.frame, -1) AS frame, round(sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z)), 6) AS disp
      FROM p JOIN q ON p.id = q.id AND p.entity = q.entity LEFT JOIN g ON g.id = p.id AND g.entity = p.entity LEFT JOIN f ON f.id = p.id AND f.entity = p.entity),
k AS (SELECT *, rank() OVER (PARTITION BY entity ORDER BY frame) + (count(*) OVER (PARTITION BY entity, frame) - 1) / 2.0 AS rf, rank() OVER (PARTITION BY entity ORDER BY disp) + (count(*) OVER (PARTITION BY entity, disp) - 1) / 2.0 AS rd FROM n WHERE frame >= 0),
c AS (SELECT entity, count(*) AS n, round(CASE WHEN stddev_pop(rf) * stddev_pop(rd) > 0 THEN covar_pop(rf, rd) / (stddev_pop(rf) * stddev_pop(rd)) END, 6) AS rho, max(frame) AS max_frame, min(id) FILTER (WHERE frame = 0) AS seed FROM k GROUP BY entity),
r AS (SELECT entity, count(*) AS n_nodes, CAST(sum(degree) AS BIGINT) AS n_edges, round(avg(disp), 6) AS mean_disp FROM n GROUP BY entity)
SELECT n.entity AS system, n.id, n.degree, n.frame, n.disp, r.n_nodes, r.n_edges, c.seed, coalesce(c.n, 0) AS reached, coalesce(c.max_frame, -1) AS max_frame, r.mean_disp, coalesce(c.n, 0) AS n, c.rho,
       CASE WHEN abs(rho) >= 0.3 THEN 'SIGNAL' WHEN abs(rho) >= 0.15 THEN 'WEAK SIGNAL' WHEN abs(rho) < 0.15 THEN 'NO SIGNAL' END AS verdict
FROM n JOIN r ON r.entity = n.entity LEFT JOIN c ON c.entity = n.entity"""

ORACLES["job2_link_graph"] = r"""WITH h AS (SELECT page_id, regexp_extract(url, '^[^?#]*') AS src, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*') AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*:') AS scheme, unnest(regexp_extract_all(html, 'href="([^"#]+)', 1)) AS h FROM pages),
l AS (SELECT src, CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h WHEN starts_with(h, '//') THEN scheme || h WHEN starts_with(h, '/') THEN host || h ELSE host || '/' || h END AS dst FROM h WHERE host <> ''),
k AS (SELECT src, dst FROM l WHERE regexp_matches(dst, '^https?://[^/]'))
SELECT regexp_extract(dst, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*') AS site, dst, count(*) AS n_links, count(DISTINCT src) AS degree FROM k GROUP BY dst"""
