"""Registered queries and their SQL counterparts, keyed by name.

The test tables stand in for structures: ``embeddings`` gives points (ten times the first three
dimensions; dimensions four to six are a second conformer), its label the group, ``lineitem`` edge
lists, chains and positions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import conflict, hamming_prefix, next_state, node_gradient, residue_code, segment_distance, squared_distance
from tessera.operators import align, contacts, evaluate, graph, neighbours, points, spectral, stats, systems, traverse, walks
from tessera.session import checkpoint

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

K, RADIUS, A, B = 12, 0.8, 0, 100


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cloud(spark: SparkSession, sf: str, at: int = 0) -> DataFrame:
    e = _table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), *[(10 * F.col("embedding")[at + i].cast("double")).alias(a) for i, a in enumerate("xyz")], F.col("label").alias("entity"))


def knn_graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return checkpoint(graph.symmetrize(graph.knn_edges(cloud(spark, sf), K)))


def radius_graph_edges(spark: SparkSession, sf: str, keys=()) -> DataFrame:
    return checkpoint(graph.radius_edges(cloud(spark, sf), RADIUS, keys).select(*keys, "src", "dst"))


def _contact_frames(spark: SparkSession, sf: str, seeds: list[int]) -> DataFrame:
    """(seed, id, frame) in the radius graph, whose edges grow with the square of the points and are not made."""
    return checkpoint(contacts.bfs(cloud(spark, sf), spark.createDataFrame([(s,) for s in seeds], "seed long"), RADIUS))


P = """p AS (SELECT vec_id AS id, 10*CAST(embedding[1] AS DOUBLE) AS x, 10*CAST(embedding[2] AS DOUBLE) AS y, 10*CAST(embedding[3] AS DOUBLE) AS z, label AS entity FROM embeddings)"""
P2 = """q AS (SELECT vec_id AS id, 10*CAST(embedding[4] AS DOUBLE) AS x, 10*CAST(embedding[5] AS DOUBLE) AS y, 10*CAST(embedding[6] AS DOUBLE) AS z, label AS entity FROM embeddings)"""
D2 = "(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)"
KNN = f"""{P}, near AS (SELECT a.id AS src, b.id AS dst, row_number() OVER (PARTITION BY a.id ORDER BY {D2}, b.id) AS rn FROM p a JOIN p b ON a.id <> b.id),
k AS (SELECT src, dst FROM near WHERE rn <= {K}), e AS (SELECT src, dst FROM k UNION SELECT dst, src FROM k)"""
RAD = f"""{P}, e AS (SELECT a.id AS src, b.id AS dst, a.entity AS ea, b.entity AS eb FROM p a JOIN p b ON a.id <> b.id WHERE {D2} <= CAST({RADIUS} AS DOUBLE)*CAST({RADIUS} AS DOUBLE))"""


def bfs_sql(name: str, seed: int, depth: int = 40) -> str:
    return f"""w_{name}(id, frame) AS (SELECT CAST({seed} AS BIGINT), 0 UNION SELECT e.dst, w_{name}.frame + 1 FROM w_{name} JOIN e ON e.src = w_{name}.id WHERE w_{name}.frame < {depth}),
{name} AS (SELECT id, min(frame) AS frame FROM w_{name} GROUP BY id)"""


# ---- scans, seeds and point tables


@query(f"WITH {P}, c AS (SELECT avg(x) cx, avg(y) cy, avg(z) cz FROM p), d AS (SELECT id, (x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz) AS d2 FROM p, c) SELECT id, round(d2, 6) AS d2 FROM d ORDER BY d.d2, id LIMIT 1")
def seed_nearest_com(spark, sf):
    return points.nearest_to_centroid(cloud(spark, sf)).select("id", F.round("d2", 6).alias("d2"))


@query("""WITH pr AS (SELECT DISTINCT l_partkey AS s, l_suppkey + 10000000 AS t FROM lineitem), e AS (SELECT s AS id FROM pr UNION ALL SELECT t FROM pr), d AS (SELECT id, count(*) AS degree FROM e GROUP BY id)
SELECT min(id) AS id FROM d WHERE degree >= (SELECT quantile_cont(degree, 0.99) FROM d)""")
def seed_high_degree(spark, sf):
    return points.seed_high_degree(graph.degrees(_supply_edges(spark, sf)))


def _supply_edges(spark, sf):
    pairs = _table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 10_000_000).alias("dst"))
    return graph.symmetrize(pairs)


def _cases(frames: dict[str, DataFrame]) -> DataFrame:
    """One table of what an operator gives in several cases."""
    out = None
    for name, df in frames.items():
        part = df.withColumn("case", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH {RAD}, d AS (SELECT src AS id, count(*) AS degree FROM e GROUP BY src), n AS (SELECT p.id, p.entity, coalesce(degree, 0) AS degree FROM p LEFT JOIN d ON p.id = d.id)
SELECT 'state' AS "case", min(id) AS id FROM n WHERE entity = 3 UNION ALL SELECT 'edge', min(id) FROM n WHERE degree > 0 UNION ALL SELECT 'none', id FROM n WHERE id < 0""")
def seed_by_state(spark, sf):
    """A node in state 1; without one the first node with an edge; without an edge none."""
    nodes = checkpoint(cloud(spark, sf).join(graph.degrees(radius_graph_edges(spark, sf)), "id", "left").select("id", "entity", F.coalesce("degree", F.lit(0)).alias("degree")))
    pick = lambda state, degree: points.seed_by_state(nodes.select("id", state.alias("state"), degree.alias("degree")))
    none = F.lit(0)
    return _cases({"state": pick((F.col("entity") == 3).cast("int"), F.col("degree")), "edge": pick(none, F.col("degree")), "none": pick(none, none)})


@query(f"""WITH {P}, own AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS seq FROM p WHERE entity = 2), c AS (SELECT avg(x) cx, avg(y) cy, avg(z) cz FROM own), d AS (SELECT id, seq, (x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz) AS d2 FROM own, c)
SELECT 'preferred' AS "case", id FROM d WHERE seq = 3 UNION ALL SELECT 'other', min(id) FROM d WHERE seq IN (9, 7) UNION ALL SELECT 'centre', id FROM (SELECT id FROM d ORDER BY d2, id LIMIT 1) t""")
def seed_cascade(spark, sf):
    """The preferred residue; without it the first of others; without those the point nearest to the centre."""
    at = F.row_number().over(Window.partitionBy("entity").orderBy("id")) - 1
    p = checkpoint(cloud(spark, sf).select("id", "x", "y", "z", F.col("entity").alias("subchain"), at.alias("seq_id")))
    return _cases({"preferred": points.seed_cascade(p, 2, 3, [9, 7]), "other": points.seed_cascade(p, 2, -3, [-1, 9, 7]), "centre": points.seed_cascade(p, 2, -3, [-1, -2])})


@query(f"WITH {P}, r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY id) AS rn FROM p) SELECT entity, id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM r WHERE rn = 1")
def first_point_per_group(spark, sf):
    p = cloud(spark, sf)
    return points.first_per_key(p, ["entity"], "id").select("entity", "id", *[F.round(a, 6).alias(a) for a in "xyz"])


@query(f"WITH {P} SELECT entity, count(*) AS n, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz FROM p GROUP BY entity")
def group_centroids(spark, sf):
    p = cloud(spark, sf)
    n = p.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    return points.centroid(p, ["entity"]).join(n, "entity").select("entity", "n", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "cz")])


@query(f"""WITH {P}, c AS (SELECT entity, avg(x) cx, avg(y) cy, avg(z) cz FROM p GROUP BY entity), a AS (SELECT cx ax, cy ay, cz az FROM c WHERE entity = 0)
SELECT entity, round((cx-ax)*(cx-ax)+(cy-ay)*(cy-ay)+(cz-az)*(cz-az), 6) AS d2 FROM c, a WHERE entity <> 0 ORDER BY (cx-ax)*(cx-ax)+(cy-ay)*(cy-ay)+(cz-az)*(cz-az), entity LIMIT 1""")
def nearest_centroid_pick(spark, sf):
    p = cloud(spark, sf)
    anchor = points.centroid(p.where("entity = 0")).select(*[F.col(f"c{a}").alias(f"a{a}") for a in "xyz"])
    return points.nearest_group(p.where("entity <> 0"), "entity", anchor).select("entity", F.round("d2", 6).alias("d2"))


@query("SELECT vec_id AS id, row_number() OVER (ORDER BY label, vec_id) - 1 AS node FROM embeddings")
def canonical_node_ids(spark, sf):
    return points.canonical_ids(cloud(spark, sf).select("id", "entity"), ["entity", "id"]).select("id", "node")


@query("SELECT n_nationkey AS id, CASE upper(substr(n_name, 1, 3)) WHEN 'ALA' THEN 'A' WHEN 'ARG' THEN 'R' WHEN 'ASN' THEN 'N' WHEN 'ASP' THEN 'D' WHEN 'CYS' THEN 'C' WHEN 'GLN' THEN 'Q' WHEN 'GLU' THEN 'E' WHEN 'GLY' THEN 'G' WHEN 'HIS' THEN 'H' WHEN 'ILE' THEN 'I' WHEN 'LEU' THEN 'L' WHEN 'LYS' THEN 'K' WHEN 'MET' THEN 'M' WHEN 'PHE' THEN 'F' WHEN 'PRO' THEN 'P' WHEN 'SER' THEN 'S' WHEN 'THR' THEN 'T' WHEN 'TRP' THEN 'W' WHEN 'TYR' THEN 'Y' WHEN 'VAL' THEN 'V' ELSE 'X' END AS code FROM nation")
def residue_codes(spark, sf):
    return _table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), residue_code(F.substring("n_name", 1, 3)).alias("code"))


@query("SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark, sf):
    e = _table(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), F.from_json("props", "k long")["k"].alias("k"))


@query(f"""WITH {P}, c AS (SELECT entity, count(*) AS n FROM p GROUP BY entity), pick AS (SELECT 'named' AS k, 3 AS entity UNION ALL SELECT 'first', min(entity) FROM c WHERE n >= 30 UNION ALL SELECT 'none', entity FROM c WHERE n >= 1000000000)
SELECT k AS "case", p.entity, p.id FROM p JOIN pick ON p.entity = pick.entity""")
def chain_with_fallback(spark, sf):
    """The named chain; without it the first with enough points; without one no points."""
    p = cloud(spark, sf).select("id", F.lpad(F.col("entity").cast("string"), 4, "0").alias("chain"), "entity", F.struct("entity", "id").alias("position"))
    pick = lambda name, least: points.chain_or_first(p, name, least).select("entity", "id")
    return _cases({"named": pick("0003", 30), "first": pick("none such", 30), "none": pick("none such", 1_000_000_000)})


@query("SELECT l_partkey AS part, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS n_suppliers FROM lineitem GROUP BY l_partkey")
def distinct_counts(spark, sf):
    return _table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_suppkey").alias("n_suppliers"))


# ---- graph builders


@query(f"WITH {KNN} SELECT src, dst FROM e")
def knn_graph(spark, sf):
    return knn_graph_edges(spark, sf)


@query(f"WITH {P}, near AS (SELECT a.id AS src, b.id AS dst, {D2} AS d2, row_number() OVER (PARTITION BY a.id ORDER BY {D2}, b.id) AS rn FROM p a JOIN p b ON a.id <> b.id) SELECT src, dst, round(d2, 6) AS d2 FROM near WHERE rn <= {K}")
def knn_growing_grid(spark, sf):
    return graph.knn_grid(cloud(spark, sf), K).select("src", "dst", F.round("d2", 6).alias("d2"))


@query(f"""WITH v AS (SELECT vec_id AS id, embedding AS e FROM embeddings), near AS (SELECT a.id AS src, b.id AS dst, row_number() OVER (PARTITION BY a.id ORDER BY list_sum(list_transform(range(1, 65), lambda i: (CAST(a.e[i] AS DOUBLE) - CAST(b.e[i] AS DOUBLE)) * (CAST(a.e[i] AS DOUBLE) - CAST(b.e[i] AS DOUBLE)))), b.id) AS rn FROM v a JOIN v b ON a.id <> b.id)
SELECT src, dst FROM near WHERE rn <= {K}""")
def knn_wide_vectors(spark, sf):
    e = _table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return neighbours.knn_metric(e, K)[0].select("src", "dst")


@query(f"WITH {RAD} SELECT src, dst FROM e")
def radius_graph_voxel(spark, sf):
    return graph.radius_edges(cloud(spark, sf), RADIUS).select("src", "dst")


@query(f"WITH {RAD}, d AS (SELECT p.id, count(e.src) AS degree FROM p LEFT JOIN e ON e.src = p.id GROUP BY p.id) SELECT count(*) AS n_nodes, CAST(sum(degree) AS BIGINT) AS n_edges, min(degree) AS min_degree, max(degree) AS max_degree, CAST(count(*) FILTER (WHERE degree = 0) AS BIGINT) AS n_isolated, round(avg(degree), 6) AS mean_degree FROM d")
def degree_stats(spark, sf):
    d = graph.degrees(radius_graph_edges(spark, sf), cloud(spark, sf))
    return graph.degree_stats(d).withColumn("mean_degree", F.round("mean_degree", 6))


@query(f"WITH {KNN}, d AS (SELECT p.id, count(e.src) AS degree FROM p LEFT JOIN e ON e.src = p.id GROUP BY p.id) SELECT id, degree, CAST(sum(degree) OVER (ORDER BY id) - degree AS BIGINT) AS \"offset\" FROM d")
def csr_offsets(spark, sf):
    return graph.csr_offsets(knn_graph_edges(spark, sf), cloud(spark, sf))


@query(f"WITH {KNN} SELECT src AS id, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS neighbours FROM e GROUP BY src")
def adjacency_lists(spark, sf):
    return graph.adjacency(knn_graph_edges(spark, sf)).select("id", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours"))


@query(f"WITH {KNN} SELECT src, dst FROM e")
def csr_decode(spark, sf):
    return graph.csr_decode(graph.adjacency(knn_graph_edges(spark, sf)))


@query("WITH pr AS (SELECT l_partkey AS s, l_suppkey + 10000000 AS t FROM lineitem) SELECT s AS src, t AS dst FROM pr UNION SELECT t, s FROM pr")
def edge_list_symmetrize(spark, sf):
    return _supply_edges(spark, sf)


@query(f"WITH {KNN} SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e")
def undirected_edges(spark, sf):
    return graph.undirected(knn_graph_edges(spark, sf))


@query(f"WITH {RAD} SELECT src AS i, dst AS j, CAST(-1 AS DOUBLE) AS v FROM e UNION ALL SELECT p.id, p.id, CAST(count(e.src) AS DOUBLE) FROM p LEFT JOIN e ON e.src = p.id GROUP BY p.id")
def laplacian_triples(spark, sf):
    return graph.laplacian(radius_graph_edges(spark, sf), cloud(spark, sf))


# ---- traversals


@query(f"WITH RECURSIVE {KNN}, {bfs_sql('f', A)} SELECT p.id, coalesce(f.frame, -1) AS frame FROM p LEFT JOIN f ON p.id = f.id")
def bfs_levels(spark, sf):
    return traverse.with_unreached(traverse.bfs(knn_graph_edges(spark, sf), A, places=cloud(spark, sf)), cloud(spark, sf))


@query(f"WITH RECURSIVE {RAD}, {bfs_sql('f', A)} SELECT p.id, coalesce(f.frame, -1) AS frame FROM p LEFT JOIN f ON p.id = f.id")
def bfs_join_loop(spark, sf):
    """Contacts, level by level: points that aren't reached yet meet those of the last level."""
    return traverse.with_unreached(_contact_frames(spark, sf, [A]).select("id", "frame"), cloud(spark, sf))


@query(f"WITH RECURSIVE {KNN.replace('UNION SELECT dst, src FROM k', '')}, {bfs_sql('f', A)} SELECT p.id, coalesce(f.frame, -1) AS frame FROM p LEFT JOIN f ON p.id = f.id")
def bfs_directed(spark, sf):
    """Each point's nearest neighbours as one-way edges."""
    return traverse.with_unreached(traverse.bfs(checkpoint(graph.knn_edges(cloud(spark, sf), K)), A, places=cloud(spark, sf)), cloud(spark, sf))


@query(f"WITH RECURSIVE {KNN}, {bfs_sql('f', A)} SELECT frame, count(*) AS n FROM f GROUP BY frame")
def bfs_level_histogram(spark, sf):
    return traverse.level_histogram(traverse.bfs(knn_graph_edges(spark, sf), A, places=cloud(spark, sf)))


@query(f"WITH RECURSIVE {RAD}, {bfs_sql('f', A)} SELECT count(*) AS reached, max(frame) AS max_frame, max(frame) + 1 AS n_frames FROM f")
def bfs_reach(spark, sf):
    return traverse.reach(_contact_frames(spark, sf, [A]))


@query(f"WITH RECURSIVE {KNN}, {bfs_sql('f', A)} SELECT p.entity, count(*) AS n, round(avg(frame), 6) AS mean_frame, round(median(frame), 6) AS median_frame, max(frame) AS max_frame FROM f JOIN p ON p.id = f.id GROUP BY p.entity")
def bfs_group_summary(spark, sf):
    f = traverse.bfs(knn_graph_edges(spark, sf), A, places=cloud(spark, sf)).join(cloud(spark, sf).select("id", "entity"), "id")
    f = checkpoint(f)
    own = f.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("frame"), 6).alias("mean_frame"), F.max("frame").alias("max_frame"))
    middle = stats.quantiles(f, "frame", {"median_frame": 0.5}, ["entity"])
    return own.join(middle, "entity").select("entity", "n", "mean_frame", F.round("median_frame", 6).alias("median_frame"), "max_frame")


@query(f"WITH RECURSIVE {KNN}, {bfs_sql('fa', A)}, {bfs_sql('fb', B)}, {bfs_sql('fc', 7)} SELECT CAST({A} AS BIGINT) AS seed, id, frame FROM fa UNION ALL SELECT CAST({B} AS BIGINT), id, frame FROM fb UNION ALL SELECT CAST(7 AS BIGINT), id, frame FROM fc")
def bfs_multi_seed(spark, sf):
    return traverse.bfs_multi(knn_graph_edges(spark, sf), [A, B, 7], places=cloud(spark, sf))


SUPPLY = "pr AS (SELECT DISTINCT l_partkey AS s, l_suppkey + 10000000 AS t FROM lineitem), e AS (SELECT s AS src, t AS dst FROM pr UNION ALL SELECT t, s FROM pr)"


@query(f"WITH RECURSIVE {SUPPLY}, {bfs_sql('f', 10_000_001)} SELECT id, frame FROM f")
def bfs_supply_graph(spark, sf):
    """Parts and suppliers, joined by every line of an order, from the first supplier: more than a million edges at sf0.1, by joins."""
    return traverse.bfs(_supply_edges(spark, sf), 10_000_001, plan="loop", symmetric=True)


@query(f"""WITH RECURSIVE {SUPPLY}, w(seed, id, frame) AS (SELECT seed, seed, 0 FROM (SELECT unnest(range(10000001, 10000065)) AS seed) x UNION SELECT w.seed, e.dst, w.frame + 1 FROM w JOIN e ON e.src = w.id WHERE w.frame < 12)
SELECT seed, id, min(frame) AS frame FROM w GROUP BY seed, id""")
def bfs_many_seeds(spark, sf):
    """The same graph from 64 suppliers at once, which share every expansion."""
    return traverse.bfs_multi(_supply_edges(spark, sf), range(10_000_001, 10_000_065), plan="loop")


@query(f"WITH RECURSIVE {KNN}, {bfs_sql('f', 5, 2)} SELECT id, frame FROM f")
def k_hop(spark, sf):
    return traverse.k_hop(knn_graph_edges(spark, sf), 5, 2)


@query(f"WITH RECURSIVE {KNN}, {bfs_sql('f', 5, 2)} SELECT e.src, e.dst FROM e JOIN f a ON a.id = e.src JOIN f b ON b.id = e.dst")
def k_hop_subgraph(spark, sf):
    e = knn_graph_edges(spark, sf)
    return traverse.induced(e, traverse.k_hop(e, 5, 2))


TUBE = f"""{KNN}, {bfs_sql('fa', A)}, {bfs_sql('fb', B)}, len AS (SELECT frame AS l FROM fa WHERE id = {B}),
tube AS (SELECT fa.id, fa.frame AS d_a, fb.frame AS d_b, l AS length FROM fa JOIN fb ON fa.id = fb.id, len WHERE fa.frame + fb.frame <= l + 1 AND fa.id NOT IN ({A}, {B}))"""
SEG = f"""ends AS (SELECT a.x ax, a.y ay, a.z az, b.x bx, b.y by_, b.z bz FROM p a, p b WHERE a.id = {A} AND b.id = {B}),
tt AS (SELECT p.id, x, y, z, ax, ay, az, bx, by_, bz, greatest(0.0, least(1.0, ((x-ax)*(bx-ax)+(y-ay)*(by_-ay)+(z-az)*(bz-az)) / ((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)+(bz-az)*(bz-az)))) AS t FROM p, ends WHERE p.id NOT IN ({A}, {B})),
seg AS (SELECT id, sqrt((x-(ax+t*(bx-ax)))*(x-(ax+t*(bx-ax)))+(y-(ay+t*(by_-ay)))*(y-(ay+t*(by_-ay)))+(z-(az+t*(bz-az)))*(z-(az+t*(bz-az)))) AS dist FROM tt)"""
CYL = f"{TUBE}, {SEG}, cyl AS (SELECT id, dist FROM (SELECT id, dist, row_number() OVER (ORDER BY dist, id) AS rn FROM seg) s WHERE rn <= (SELECT count(*) FROM tube))"


@query(f"WITH RECURSIVE {TUBE} SELECT id, d_a, d_b, length FROM tube")
def tube(spark, sf):
    return traverse.tube(knn_graph_edges(spark, sf), A, B, places=cloud(spark, sf))


def _tube_status_sql(case: str, e: str, a: str, b: str, slack: int) -> str:
    """Statement for one case, whose edges are table ``e``; a and b are SQL for the seeds."""
    walk = lambda n, seed: f"{n}_{case}(id, frame) AS (SELECT CAST({seed} AS BIGINT), 0 UNION SELECT x.dst, {n}_{case}.frame + 1 FROM {n}_{case} JOIN {e} x ON x.src = {n}_{case}.id WHERE {n}_{case}.frame < 40), m{n}_{case} AS (SELECT id, min(frame) AS frame FROM {n}_{case} GROUP BY id)"
    return f"""{walk('u', a)}, {walk('v', b)}, l_{case} AS (SELECT max(frame) AS l FROM mu_{case} WHERE id = {b}),
s_{case} AS (SELECT count(*) AS size FROM mu_{case} x JOIN mv_{case} y ON x.id = y.id, l_{case} WHERE x.frame + y.frame <= l + {slack} AND x.id NOT IN ({a}, {b})),
o_{case} AS (SELECT '{case}' AS "case", CASE WHEN l IS NULL OR size = 0 THEN 'PIPELINE_FAILURE' ELSE 'OK' END AS status, CASE WHEN l IS NULL THEN 'seeds are disconnected' WHEN size = 0 THEN 'tube is empty' END AS reason, coalesce(l, -1) AS length, size FROM l_{case}, s_{case})"""


@query(f"""WITH RECURSIVE {KNN}, r AS (SELECT a.id AS src, b.id AS dst FROM p a JOIN p b ON a.id <> b.id WHERE a.entity = b.entity AND {D2} <= CAST({RADIUS} AS DOUBLE)*CAST({RADIUS} AS DOUBLE)),
{_tube_status_sql('far', 'e', A, B, 1)}, {_tube_status_sql('near', 'e', A, f'(SELECT min(dst) FROM e WHERE src = {A})', 0)}, {_tube_status_sql('apart', 'r', A, f'(SELECT min(id) FROM p WHERE entity <> (SELECT entity FROM p WHERE id = {A}))', 1)}
SELECT * FROM o_far UNION ALL SELECT * FROM o_near UNION ALL SELECT * FROM o_apart""")
def tube_status(spark, sf):
    """Seeds some way apart, neighbours without slack (nothing between them), and seeds of different groups."""
    p, e = cloud(spark, sf), knn_graph_edges(spark, sf)
    near = e.where(F.col("src") == A).agg(F.min("dst")).first()[0]
    own = p.where(F.col("id") == A).select(F.col("entity").alias("own"))
    apart = p.join(F.broadcast(own)).where("entity <> own").agg(F.min("id")).first()[0]
    own_entity = p.where(F.col("id").isin(A, apart)).select("entity", F.col("id").alias("seed"))
    both, r = checkpoint(traverse.bfs_multi(e, [A, B, near], places=p)), checkpoint(contacts.bfs(p, own_entity, RADIUS, ["entity"]).select("seed", "id", "frame"))
    return _cases({"far": traverse.status_of(both, A, B), "near": traverse.status_of(both, A, near, slack=0), "apart": traverse.status_of(r, A, apart)})


def _tube_and_cylinder(spark, sf):
    p = cloud(spark, sf)
    t = checkpoint(traverse.tube(knn_graph_edges(spark, sf), A, B, places=cloud(spark, sf)))
    m = t.agg(F.count(F.lit(1)).alias("m"))
    return t, evaluate.cylinder(p, evaluate.ends_of(p, A, B), m)


@query(f"WITH {P}, {SEG} SELECT id, round(dist, 6) AS dist FROM seg")
def segment_distances(spark, sf):
    p = cloud(spark, sf)
    one = p.where(~F.col("id").isin(A, B)).join(F.broadcast(evaluate.ends_of(p, A, B)))
    return one.select("id", F.round(segment_distance(*[[F.col(f"{s}{a}") for a in "xyz"] for s in ("", "a", "b")]), 6).alias("dist"))


@query(f"WITH RECURSIVE {CYL} SELECT id, round(dist, 6) AS dist FROM cyl")
def cylinder_top_m(spark, sf):
    return _tube_and_cylinder(spark, sf)[1].select("id", F.round("dist", 6).alias("dist"))


@query(f"WITH RECURSIVE {CYL} SELECT coalesce(t.id, c.id) AS id, CASE WHEN c.id IS NULL THEN 'TUBE_ONLY' WHEN t.id IS NULL THEN 'CYLINDER_ONLY' ELSE 'BOTH' END AS part FROM tube t FULL OUTER JOIN cyl c ON t.id = c.id")
def tube_cylinder_partition(spark, sf):
    return evaluate.partition_sets(*_tube_and_cylinder(spark, sf), names=("TUBE_ONLY", "CYLINDER_ONLY", "BOTH"))


PRF = """CAST(CASE WHEN n_pred = 0 AND n_truth = 0 THEN 1 WHEN n_pred = 0 OR n_truth = 0 THEN 0 ELSE pred_hits / CAST(n_pred AS DOUBLE) END AS DOUBLE) AS precision, CAST(CASE WHEN n_pred = 0 AND n_truth = 0 THEN 1 WHEN n_pred = 0 OR n_truth = 0 THEN 0 ELSE truth_hits / CAST(n_truth AS DOUBLE) END AS DOUBLE) AS recall"""


@query(f"""WITH pred AS (SELECT DISTINCT l_orderkey % 50 AS chain, CAST(l_partkey AS BIGINT) AS seq FROM lineitem WHERE l_linenumber = 1), truth AS (SELECT DISTINCT l_orderkey % 50 AS chain, CAST(l_partkey AS BIGINT) AS seq FROM lineitem WHERE l_linenumber = 2),
h AS (SELECT (SELECT count(*) FROM pred) AS n_pred, (SELECT count(*) FROM truth) AS n_truth, (SELECT count(*) FROM pred a WHERE EXISTS (SELECT 1 FROM truth b WHERE a.chain = b.chain AND abs(a.seq - b.seq) <= 2)) AS pred_hits, (SELECT count(*) FROM truth a WHERE EXISTS (SELECT 1 FROM pred b WHERE a.chain = b.chain AND abs(a.seq - b.seq) <= 2)) AS truth_hits),
s AS (SELECT *, {PRF} FROM h)
SELECT n_pred, n_truth, pred_hits, truth_hits, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2*precision*recall/(precision+recall) ELSE 0 END, 6) AS f1 FROM s""")
def windowed_prf1(spark, sf):
    rows = _table(spark, sf, "lineitem").select("l_linenumber", (F.col("l_orderkey") % 50).alias("chain"), F.col("l_partkey").alias("seq"))
    hits = evaluate.windowed_hits(rows.where("l_linenumber = 1"), rows.where("l_linenumber = 2"))
    return evaluate.score(hits).select("n_pred", "n_truth", "pred_hits", "truth_hits", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


COHORT = """d AS (SELECT l_suppkey AS system, avg(l_discount) - avg(l_tax) AS delta FROM lineitem GROUP BY l_suppkey)"""


@query(f"""WITH {COHORT}, c AS (SELECT count(*) AS n, median(delta) AS m, count(*) FILTER (WHERE delta > 0) AS wins FROM d), w AS (SELECT *, 100.0 * wins / n AS win_pct FROM c)
SELECT n, round(m, 6) AS median_delta, wins, n - wins AS losses, round(CAST(win_pct AS DOUBLE), 6) AS win_pct, CASE WHEN m >= 0.05 AND win_pct >= 70 THEN 'ESTABLISH' WHEN m <= 0.01 OR 100 - win_pct >= 50 THEN 'REJECT' ELSE 'INCONCLUSIVE' END AS verdict FROM w""")
def cohort_verdict(spark, sf):
    d = _table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("system")).agg((F.avg("l_discount") - F.avg("l_tax")).alias("delta"))
    return evaluate.cohort(d).withColumns({c: F.round(c, 6) for c in ("median_delta", "win_pct")})


@query("""WITH r AS (SELECT l_suppkey, avg(l_quantity) / avg(l_linenumber) AS ratio FROM lineitem GROUP BY l_suppkey) SELECT count(*) AS n, round(median(ratio), 6) AS median_ratio, CASE WHEN median(ratio) > 10 THEN 'PASS' ELSE 'FAIL' END AS gate FROM r""")
def ratio_gate(spark, sf):
    r = _table(spark, sf, "lineitem").groupBy("l_suppkey").agg((F.avg("l_quantity") / F.avg("l_linenumber")).alias("ratio"))
    return evaluate.ratio_gate(r, "ratio", 10).withColumn("median_ratio", F.round("median_ratio", 6))


@query(f"WITH RECURSIVE {RAD}, {bfs_sql('fa', A)}, {bfs_sql('fb', 1)} SELECT coalesce(fa.id, fb.id) AS id, CASE WHEN fa.frame >= 0 AND fb.frame >= 0 THEN greatest(fa.frame, fb.frame) ELSE -1 END AS arrival FROM fa FULL OUTER JOIN fb ON fa.id = fb.id")
def meet_in_middle(spark, sf):
    both = _contact_frames(spark, sf, [A, 1])
    return walks.meet(*[both.where(F.col("seed") == s).select("id", "frame") for s in (A, 1)])


@query(f"WITH RECURSIVE {RAD}, w(id, c) AS (SELECT id, id FROM p UNION SELECT e.dst, w.c FROM w JOIN e ON e.src = w.id) SELECT id, min(c) AS component FROM w GROUP BY id")
def connected_components(spark, sf):
    return contacts.components(cloud(spark, sf), RADIUS)


# ---- walks and spectra


@query(f"""WITH {P}, {P2}, v AS (SELECT p.entity, p.id, p.x AS va, q.x AS vb0 FROM p JOIN q ON p.id = q.id), s AS (SELECT entity, sum(va * vb0) AS dot FROM v GROUP BY entity),
m AS (SELECT v.entity, v.id, (CASE WHEN dot < 0 THEN -vb0 ELSE vb0 END) - va AS dv FROM v JOIN s ON v.entity = s.entity), n AS (SELECT entity, count(*) FILTER (WHERE dv > 0) AS c FROM m GROUP BY entity),
r AS (SELECT m.entity, id, dv, c, CASE WHEN dv > 0 THEN row_number() OVER (PARTITION BY m.entity, dv > 0 ORDER BY dv DESC, id) ELSE -1 END AS snap_rank FROM m JOIN n ON m.entity = n.entity)
SELECT entity, id, round(dv, 6) AS dv, CAST(snap_rank AS INTEGER) AS snap_rank, CAST(CASE WHEN snap_rank > 0 THEN c + 1 - snap_rank ELSE 0 END AS BIGINT) AS pms FROM r""")
def snap_rank_pms(spark, sf):
    a, b = cloud(spark, sf), cloud(spark, sf, 3)
    v = a.select("entity", "id", F.col("x").alias("va")).join(b.select("id", F.col("x").alias("vb")), "id")
    return spectral.snap(v, "entity").select("entity", "id", F.round("dv", 6).alias("dv"), "snap_rank", "pms")


@query(f"WITH {P} SELECT entity, id FROM (SELECT entity, id, row_number() OVER (PARTITION BY entity ORDER BY abs(x) DESC, id) AS rn FROM p) t WHERE rn = 1")
def hinge_seed(spark, sf):
    return spectral.hinge(cloud(spark, sf).select("entity", "id", F.col("x").alias("va")), "entity")


@query(f"""WITH {KNN}, d AS (SELECT src AS id, count(*) AS degree FROM e GROUP BY src), s AS (SELECT id, CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END AS state FROM p),
g AS (SELECT e.src AS id, sum(d.degree * ((CASE WHEN a.state = b.state THEN 1 ELSE 0 END) - (CASE WHEN (CASE a.state WHEN -1 THEN 0 WHEN 0 THEN 1 ELSE -1 END) = b.state THEN 1 ELSE 0 END))) AS gain, count(*) FILTER (WHERE a.state = b.state) AS conflicts FROM e JOIN s a ON a.id = e.src JOIN s b ON b.id = e.dst JOIN d ON d.id = e.dst GROUP BY e.src)
SELECT id, CAST(gain AS BIGINT) AS gain, CAST(conflicts AS BIGINT) AS conflicts FROM g""")
def ratchet_gradient_step(spark, sf):
    e = knn_graph_edges(spark, sf)
    s = cloud(spark, sf).select("id", F.when(F.col("id") % 5 == 0, 1).otherwise(0).alias("state"))
    d = graph.degrees(e)
    near = e.join(s.select(F.col("id").alias("src"), F.col("state").alias("sa")), "src").join(s.join(d, "id").select(F.col("id").alias("dst"), F.col("state").alias("sb"), "degree"), "dst")
    return near.groupBy(F.col("src").alias("id")).agg(F.sum(node_gradient(F.col("sa"), F.col("sb"), F.col("degree"))).alias("gain"), F.sum(conflict(F.col("sa"), F.col("sb")).cast("long")).alias("conflicts"))


@query(f"WITH {P}, s AS (SELECT (id % 3) - 1 AS state FROM p) SELECT CAST(CASE state WHEN -1 THEN 0 WHEN 0 THEN 1 ELSE -1 END AS INTEGER) AS state, count(*) AS n FROM s GROUP BY 1")
def state_histogram(spark, sf):
    s = cloud(spark, sf).select(next_state((F.col("id") % 3 - 1).cast("int")).alias("state"))
    return walks.state_histogram(s)


@query()
def ratchet_walk(spark, sf):
    e = knn_graph_edges(spark, sf)
    return walks.ratchet_walk(e, spark.createDataFrame([(A,)], "seed long"))


@query()
def ratchet_first_flip(spark, sf):
    return walks.ratchet_walk_near(cloud(spark, sf), RADIUS, ["entity"]).groupBy("entity", "n").agg(F.min("f").alias("f"))


@query(f"""WITH {KNN}, f0 AS (SELECT CAST({A} AS BIGINT) AS id), f1 AS (SELECT DISTINCT e.dst AS id FROM f0 JOIN e ON e.src = f0.id), f2 AS (SELECT DISTINCT e.dst AS id FROM f1 JOIN e ON e.src = f1.id), f3 AS (SELECT DISTINCT e.dst AS id FROM f2 JOIN e ON e.src = f2.id)
SELECT 0 AS frame, id FROM f0 UNION ALL SELECT 1, id FROM f1 UNION ALL SELECT 2, id FROM f2 UNION ALL SELECT 3, id FROM f3""")
def excitable_wave_bounded(spark, sf):
    return walks.excitable_wave(knn_graph_edges(spark, sf), A, 3)


@query()
def fiedler(spark, sf):
    """The graph is near-complete where points crowd, so its edges are not made."""
    return spectral.fiedler_of_points(cloud(spark, sf), RADIUS, "entity", every=True).select("entity", "id", F.round("v", 6).alias("v"), F.round("eigenvalue", 6).alias("eigenvalue"), "n_components", "status", "reason")


PAIRED = ("lambda_a", "lambda_b", "rho", "p", "rho_euclid", "p_euclid", "delta_rho", "tm_score", "rmsd")


@query()
def spectral_pairs(spark, sf):
    """Per group a whole run over its two conformers: window match, alignment, both graphs, vectors, snaps, both correlations, scores."""
    a, b = (cloud(spark, sf, at).withColumnRenamed("id", "seq_id") for at in (0, 3))
    return systems.run_pairs(a, b, "entity", 4.0).withColumns({c: F.round(c, 6) for c in PAIRED})


@query()
def pair_cohort(spark, sf):
    """The reduction of the pair runs: median correlation, wins, and the correlation of snaps with 1 - TM."""
    return evaluate.pair_cohort(checkpoint(spectral_pairs(spark, sf)).where("status = 'OK'")).withColumns({c: F.round(c, 6) for c in ("median_rho", "rho_tm", "p_tm")})


# ---- alignment


def _pairs(spark, sf):
    return align.pair(cloud(spark, sf), cloud(spark, sf, 3), ["id"])


@query(f"""WITH {P}, {P2} SELECT count(*) AS n, {", ".join(f"round(covar_pop(q.{i}, p.{j}) * count(*), 4) AS h{a}{b}" for a, i in enumerate("xyz") for b, j in enumerate("xyz"))} FROM p JOIN q ON p.id = q.id""")
def kabsch_covariance(spark, sf):
    return align.covariance(_pairs(spark, sf)).select("n", *[F.round(f"h{i}{j}", 4).alias(f"h{i}{j}") for i in range(3) for j in range(3)])


@query()
def kabsch_rt(spark, sf):
    return align.kabsch(_pairs(spark, sf)).select("n", *[F.round(c, 6).alias(c) for c in align.RT])


# A rotation by a right angle about z and a shift.
FIXED = [0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.5, -0.25, 1.0]


@query(f"WITH {P}, {P2} SELECT p.id, round(sqrt((p.x-(-q.y+0.5))*(p.x-(-q.y+0.5))+(p.y-(q.x-0.25))*(p.y-(q.x-0.25))+(p.z-(q.z+1.0))*(p.z-(q.z+1.0))), 6) AS disp FROM p JOIN q ON p.id = q.id")
def displacement_fixed_transform(spark, sf):
    rt = spark.createDataFrame([FIXED], ", ".join(f"{c} double" for c in align.RT))
    return align.displacements(align.apply_transform(_pairs(spark, sf), rt)).select("id", F.round("disp", 6).alias("disp"))


@query(f"WITH {P}, {P2} SELECT p.entity, count(*) AS n, round(sqrt(avg((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z))), 6) AS rmsd FROM p JOIN q ON p.id = q.id GROUP BY p.entity")
def rmsd(spark, sf):
    p = align.pair(cloud(spark, sf), cloud(spark, sf, 3), ["entity", "id"])
    d = p.withColumn("disp", F.sqrt(squared_distance([F.col(c) for c in align.P], [F.col(c) for c in align.Q])))
    return align.rmsd(d, ["entity"]).withColumn("rmsd", F.round("rmsd", 6))


@query()
def aligned_displacement_summary(spark, sf):
    pairs = _pairs(spark, sf)
    moved = align.displacements(align.apply_transform(pairs, align.kabsch(pairs)))
    return stats.describe(moved, "disp").select("n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p90", "p95", "p99", "max")])


def _conformers(spark, sf, where="true"):
    """Both conformers (key, group, x, y, z); the key is the rank of the id in its group, so every point has its own."""
    q = [(10 * F.col("embedding")[3 + i].cast("double")).alias(f"q{c}") for i, c in enumerate("xyz")]
    p = [(10 * F.col("embedding")[i].cast("double")).alias(f"p{c}") for i, c in enumerate("xyz")]
    rows = _table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("group"), *p, *q).where(where)
    keyed = checkpoint(rows.withColumn("key", F.row_number().over(Window.partitionBy("group").orderBy("id"))))
    return tuple(keyed.select("key", "group", *[F.col(f"{s}{c}").alias(c) for c in "xyz"]) for s in "pq")


@query()
def all_pairs_rmsd(spark, sf):
    return align.all_pairs_rmsd(*_conformers(spark, sf), ["key"], least=5).withColumn("rmsd", F.round("rmsd", 6))


@query("""WITH a AS (SELECT l_orderkey AS k1, l_linenumber AS k2, max(l_partkey) AS pa FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY 1, 2), b AS (SELECT l_orderkey AS k1, l_linenumber AS k2, max(l_partkey) AS pb FROM lineitem WHERE l_suppkey % 2 = 1 GROUP BY 1, 2) SELECT a.k1, a.k2, a.pa, b.pb FROM a JOIN b ON a.k1 = b.k1 AND a.k2 = b.k2""")
def key_alignment_join(spark, sf):
    rows = _table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"), F.col("l_partkey").alias("part"), "l_suppkey")
    side = lambda rest, n: points.last_per_key(rows.where(F.col("l_suppkey") % 2 == rest).drop("l_suppkey").withColumn("at", F.col("part")), ["k1", "k2"], "at").select("k1", "k2", F.col("part").alias(n))
    return side(0, "pa").join(side(1, "pb"), ["k1", "k2"])


@query("SELECT l.l_orderkey AS k1, l.l_linenumber AS k2, l.l_partkey AS part, o.o_totalprice AS price FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey AND o.o_orderstatus = 'F'")
def lookup_left_join(spark, sf):
    o = _table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k1"), F.col("o_totalprice").alias("price"))
    rows = _table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"), F.col("l_partkey").alias("part"))
    return rows.join(o, "k1", "left").select("k1", "k2", "part", "price")


def _entities(spark, sf, low, high):
    d = _table(spark, sf, "documents").where(F.col("text").isNotNull())
    d = d.select(F.col("doc_id").alias("entity"), F.substring("text", 1, 80).alias("seq"), F.length("text").alias("length"))  # 80 codes are compared
    return d.where((F.col("entity") % 4 >= low) & (F.col("entity") % 4 < high))


@query("""WITH d AS (SELECT doc_id, text AS t FROM documents WHERE text IS NOT NULL), c AS (SELECT a.doc_id AS ea, b.doc_id AS eb, a.t AS sa, b.t AS sb FROM d a JOIN d b ON a.doc_id + 1 = b.doc_id)
SELECT ea, eb, CAST(list_sum(list_transform(range(1, least(80, length(sa), length(sb)) + 1), lambda i: CASE WHEN substr(sa, i, 1) <> substr(sb, i, 1) THEN 1 ELSE 0 END)) AS INTEGER) AS mismatches FROM c""")
def hamming_prefix_codes(spark, sf):
    d = _table(spark, sf, "documents").where(F.col("text").isNotNull()).select(F.col("doc_id").alias("ea"), F.split(F.substring("text", 1, 80), "").alias("sa"))  # 80 codes are compared
    b = d.select((F.col("ea") - 1).alias("ea"), F.col("ea").alias("eb"), F.col("sa").alias("sb"))
    return d.join(b, "ea").select("ea", "eb", hamming_prefix(F.col("sa"), F.col("sb")).alias("mismatches"))


GREEDY = "list_reduce(c, lambda x, y: list_concat(x, list_filter(y, lambda i: NOT list_contains(list_transform(x, lambda j: j.b), i.b))[1:1]), [])"


@query(f"""WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0), a AS (SELECT * FROM d WHERE doc_id % 4 < 2), b AS (SELECT * FROM d WHERE doc_id % 4 >= 2),
j AS (SELECT a.doc_id AS a, b.doc_id AS b, abs(a.n - b.n) * 2 - CASE WHEN b.n < a.n THEN 1 ELSE 0 END AS rank, greatest(8, least(a.n, 80) // 5) AS most,
list_sum(list_transform(range(1, least(80, a.n, b.n) + 1), lambda i: CASE WHEN substr(a.text, i, 1) <> substr(b.text, i, 1) THEN 1 ELSE 0 END)) AS m FROM a JOIN b ON b.n BETWEEN a.n - 2 AND a.n + 2),
o AS (SELECT a, list({{'a': a, 'b': b, 'm': m}} ORDER BY m, rank, b) AS c FROM j WHERE m <= most GROUP BY a), g AS (SELECT list(c ORDER BY a) AS c FROM o), r AS (SELECT unnest({GREEDY}) AS x FROM g WHERE c IS NOT NULL)
SELECT x.a AS ea, x.b AS eb, CAST(x.m AS INTEGER) AS mismatches FROM r""")
def entity_match(spark, sf):
    return align.entity_match(_entities(spark, sf, 0, 2), _entities(spark, sf, 2, 4))


@query(f"""WITH d AS (SELECT DISTINCT l_orderkey % 97 AS chain, CAST(l_partkey AS BIGINT) AS s, l_linenumber AS side FROM lineitem), j AS (SELECT x.chain, x.s AS a, y.s AS b, CASE y.s - x.s WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN -1 THEN 2 WHEN 2 THEN 3 ELSE 4 END AS rank FROM d x JOIN d y ON x.chain = y.chain AND x.side = 1 AND y.side = 2 AND abs(x.s - y.s) <= 2),
o AS (SELECT chain, a, list({{'a': a, 'b': b}} ORDER BY rank) AS c FROM j GROUP BY chain, a), g AS (SELECT chain, list(c ORDER BY a) AS c FROM o GROUP BY chain), r AS (SELECT chain, unnest({GREEDY}) AS x FROM g)
SELECT chain, x.a AS seq_a, x.b AS seq_b FROM r""")
def window_match_greedy(spark, sf):
    rows = _table(spark, sf, "lineitem").select((F.col("l_orderkey") % 97).alias("chain"), F.col("l_partkey").alias("seq_id"), "l_linenumber").distinct()
    return align.window_match(rows.where("l_linenumber = 1"), rows.where("l_linenumber = 2"), "chain")


@query()
def assign_two_copies(spark, sf):
    a, b = _conformers(spark, sf, "group < 2")
    return align.assign_two(align.all_pairs_rmsd(a, b, ["key"], least=5)).withColumn("rmsd", F.round("rmsd", 6))


@query(f"""WITH {P}, {P2}, a AS (SELECT entity AS ga, avg(x) x, avg(y) y, avg(z) z FROM p GROUP BY entity), b AS (SELECT entity AS gb, avg(x) x, avg(y) y, avg(z) z FROM q GROUP BY entity),
j AS (SELECT ga, gb, round(sqrt({D2}), 9) AS m FROM a JOIN b ON true), o AS (SELECT ga, list({{'a': ga, 'b': gb, 'm': m}} ORDER BY m, gb) AS c FROM j WHERE m < 3 GROUP BY ga), g AS (SELECT list(c ORDER BY ga) AS c FROM o), r AS (SELECT unnest({GREEDY}) AS x FROM g)
SELECT x.a AS ga, x.b AS gb, round(x.m, 6) AS rmsd FROM r""")
def assign_greedy(spark, sf):
    """Groups of one conformer in order take the nearest group of the other that is left, below a limit."""
    a = points.centroid(cloud(spark, sf), ["entity"]).select(F.col("entity").alias("ga"), "cx", "cy", "cz")
    b = points.centroid(cloud(spark, sf, 3), ["entity"]).select(F.col("entity").alias("gb"), *[F.col(f"c{c}").alias(f"d{c}") for c in "xyz"])
    far = F.sqrt(squared_distance([F.col(f"c{c}") for c in "xyz"], [F.col(f"d{c}") for c in "xyz"]))
    pairs = a.join(F.broadcast(b)).select("ga", "gb", F.round(far, 9).alias("rmsd"))  # a row for every two groups is the input asked for
    return align.assign_greedy(pairs, limit=3.0).withColumn("rmsd", F.round("rmsd", 6))


@query(f"WITH {P}, {P2}, d AS (SELECT p.entity, {D2.replace('a.', 'p.').replace('b.', 'q.')} AS d2 FROM p JOIN q ON p.id = q.id), n AS (SELECT entity, count(*) AS n FROM d GROUP BY entity), s AS (SELECT d.entity, n, d2, CASE WHEN n > 15 THEN greatest(0.5, 1.24 * cbrt(n - 15) - 1.8) ELSE 0.5 END AS d0 FROM d JOIN n ON d.entity = n.entity) SELECT entity, round(sum(1 / (1 + d2 / (d0 * d0))) / max(n), 6) AS tm_score FROM s GROUP BY entity")
def tm_score_fixed(spark, sf):
    """TM-score of both conformers as they lie, per group and normalised by its size."""
    p = align.pair(cloud(spark, sf), cloud(spark, sf, 3), ["entity", "id"])
    d = p.withColumn("disp", F.sqrt(squared_distance([F.col(c) for c in align.P], [F.col(c) for c in align.Q])))
    n = d.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    return align.tm_score(d.join(n, "entity"), "n", keys=["entity"]).withColumn("tm_score", F.round("tm_score", 6))


# ---- statistics


@query("SELECT count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(median(l_extendedprice), 4) AS median, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99, round(max(l_extendedprice), 4) AS max FROM lineitem")
def percentile_summary(spark, sf):
    return stats.describe(_table(spark, sf, "lineitem"), "l_extendedprice").select("n", *[F.round(c, 4).alias(c) for c in ("mean", "median", "p90", "p95", "p99", "max")])


@query("SELECT l_suppkey AS entity, count(*) AS n, round(median(l_linenumber), 6) AS median_frame, round(median(l_discount), 6) AS median_disp, round(avg(l_discount), 6) AS mean_disp FROM lineitem GROUP BY l_suppkey HAVING count(*) >= 5 ORDER BY avg(l_discount) DESC, l_suppkey LIMIT 15")
def group_summary_having(spark, sf):
    rows = _table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "entity")
    return stats.group_summary(rows, "entity", "l_linenumber", "l_discount").select("entity", "n", *[F.round(c, 6).alias(c) for c in ("median_frame", "median_disp", "mean_disp")])


@query("WITH c AS (SELECT quantile_cont(l_extendedprice, 0.95) AS cut FROM lineitem) SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem, c WHERE l_extendedprice >= cut GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 15")
def top5pct_contributors(spark, sf):
    return stats.top_contributors(_table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag", "l_linestatus"])


@query("SELECT count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def pearson(spark, sf):
    return stats.pearson(_table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice").withColumn("r", F.round("r", 6))


@query("""WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem) SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r""")
def spearman(spark, sf):
    return stats.spearman(_table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice").withColumn("rho", F.round("rho", 6))


@query("""WITH c AS (SELECT l_suppkey AS system, corr(l_quantity, l_extendedprice) / 3 + corr(l_discount, l_tax) AS rho FROM lineitem GROUP BY l_suppkey)
SELECT system, CASE WHEN abs(rho) >= 0.3 THEN 'SIGNAL' WHEN abs(rho) >= 0.15 THEN 'WEAK SIGNAL' ELSE 'NO SIGNAL' END AS verdict FROM c WHERE rho IS NOT NULL""")
def correlation_verdict(spark, sf):
    rows = _table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "system")
    a, b = (stats.pearson(rows, x, y, ["system"]).select("system", F.col("r").alias(n)) for x, y, n in (("l_quantity", "l_extendedprice", "ra"), ("l_discount", "l_tax", "rb")))
    return a.join(b, "system").withColumn("rho", F.col("ra") / 3 + F.col("rb")).where("rho is not null").select("system", evaluate.correlation_verdict(F.col("rho")).alias("verdict"))


@query()
def correlation_p_values(spark, sf):
    rows = _table(spark, sf, "lineitem")
    return stats.with_p_value(stats.pearson(rows, "l_discount", "l_tax", ["l_returnflag"])).withColumns({c: F.round(c, 6) for c in ("r", "p")})


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice, 4) AS price FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 30")
def top_movers(spark, sf):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return stats.top_movers(_table(spark, sf, "lineitem"), "l_extendedprice", keys).select(*keys, F.round("l_extendedprice", 4).alias("price"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(o.o_orderkey) AS BIGINT) AS matched, CAST(count(*) FILTER (WHERE o.o_totalprice > 100000) AS BIGINT) AS large FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey")
def coverage_counts(spark, sf):
    o = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    return _table(spark, sf, "lineitem").select("l_orderkey").join(o, "l_orderkey", "left").agg(F.count(F.lit(1)).alias("n"), F.count("o_totalprice").alias("matched"), F.count_if(F.col("o_totalprice") > 100000).alias("large"))


@query("SELECT count(*) AS n FROM (SELECT l_partkey AS k FROM lineitem WHERE l_suppkey % 2 = 0 INTERSECT SELECT l_partkey FROM lineitem WHERE l_suppkey % 2 = 1) t")
def key_intersection(spark, sf):
    rows = _table(spark, sf, "lineitem")
    side = lambda r: rows.where(F.col("l_suppkey") % 2 == r).select("l_partkey")
    return side(0).intersect(side(1)).agg(F.count(F.lit(1)).alias("n"))


# ---- whole pipelines


SYSTEM_RADIUS = 4.0
CODES = "ACDEFGHIKLMNPQRSTVWY"
SYSTEMS = f"""{P}, pt AS (SELECT entity AS system, id, 'A' AS chain, id AS seq, substr('{CODES}', CAST(id % 20 AS INTEGER) + 1, 1) AS code, x, y, z FROM p),
lim AS (SELECT system, min(id) AS lo, max(id) AS hi FROM pt GROUP BY system),
sd AS (SELECT system, CASE WHEN system = 8 THEN -1 ELSE lo END AS sa, hi AS sb, substr('{CODES}', CAST(lo % 20 AS INTEGER) + 1, 1) AS ca, CASE WHEN system = 9 THEN 'X' ELSE substr('{CODES}', CAST(hi % 20 AS INTEGER) + 1, 1) END AS cb FROM lim),
en AS (SELECT sd.system, a.id AS a, b.id AS b FROM sd LEFT JOIN pt a ON a.system = sd.system AND a.seq = sa AND a.code = ca LEFT JOIN pt b ON b.system = sd.system AND b.seq = sb AND b.code = cb),
kn AS (SELECT * FROM en WHERE a IS NOT NULL AND b IS NOT NULL),
tr AS (SELECT system, chain, seq FROM pt WHERE x > 0 AND y > 0),
ow AS (SELECT pt.* FROM pt JOIN kn ON pt.system = kn.system),
ed AS (SELECT a.system, a.id AS src, b.id AS dst FROM ow a JOIN ow b ON a.system = b.system AND a.id <> b.id WHERE {D2} <= CAST({SYSTEM_RADIUS} AS DOUBLE)*CAST({SYSTEM_RADIUS} AS DOUBLE)),
wa(system, id, frame) AS (SELECT system, a, 0 FROM kn UNION SELECT ed.system, ed.dst, wa.frame + 1 FROM wa JOIN ed ON ed.system = wa.system AND ed.src = wa.id WHERE wa.frame < 40),
wb(system, id, frame) AS (SELECT system, b, 0 FROM kn UNION SELECT ed.system, ed.dst, wb.frame + 1 FROM wb JOIN ed ON ed.system = wb.system AND ed.src = wb.id WHERE wb.frame < 40),
fa AS (SELECT system, id, min(frame) AS f FROM wa GROUP BY 1, 2), fb AS (SELECT system, id, min(frame) AS f FROM wb GROUP BY 1, 2),
le AS (SELECT fa.system, f AS length FROM fa JOIN kn ON kn.system = fa.system AND kn.b = fa.id),
tu AS (SELECT fa.system, fa.id FROM fa JOIN fb ON fa.system = fb.system AND fa.id = fb.id JOIN le ON le.system = fa.system JOIN kn ON kn.system = fa.system WHERE fa.f + fb.f <= length + 1 AND fa.id NOT IN (a, b)),
si AS (SELECT system, count(*) AS m FROM tu GROUP BY system),
lc AS (SELECT o.system, o.id, o.x, o.y, o.z, a.x AS ax, a.y AS ay, a.z AS az, b.x - a.x AS ux, b.y - a.y AS uy, b.z - a.z AS uz FROM ow o JOIN kn ON kn.system = o.system JOIN ow a ON a.system = kn.system AND a.id = kn.a JOIN ow b ON b.system = kn.system AND b.id = kn.b WHERE o.id NOT IN (kn.a, kn.b)),
lt AS (SELECT *, greatest(0.0, least(1.0, ((x-ax)*ux+(y-ay)*uy+(z-az)*uz) / (ux*ux+uy*uy+uz*uz))) AS t FROM lc),
ld AS (SELECT system, id, sqrt((x-(ax+t*ux))*(x-(ax+t*ux))+(y-(ay+t*uy))*(y-(ay+t*uy))+(z-(az+t*uz))*(z-(az+t*uz))) AS dist FROM lt),
cy AS (SELECT d.system, d.id FROM (SELECT *, row_number() OVER (PARTITION BY system ORDER BY dist, id) AS rn FROM ld) d JOIN si ON si.system = d.system WHERE rn <= m),
pr AS (SELECT 'tube' AS kind, tu.system, pt.chain, pt.seq FROM tu JOIN pt ON pt.system = tu.system AND pt.id = tu.id UNION ALL SELECT 'cylinder', cy.system, pt.chain, pt.seq FROM cy JOIN pt ON pt.system = cy.system AND pt.id = cy.id),
hi AS (SELECT kind, si.system, (SELECT count(*) FROM pr WHERE pr.kind = k.kind AND pr.system = si.system) AS n_pred, (SELECT count(*) FROM tr WHERE tr.system = si.system) AS n_truth,
(SELECT count(*) FROM pr WHERE pr.kind = k.kind AND pr.system = si.system AND EXISTS (SELECT 1 FROM tr WHERE tr.system = pr.system AND tr.chain = pr.chain AND abs(tr.seq - pr.seq) <= 2)) AS pred_hits,
(SELECT count(*) FROM tr WHERE tr.system = si.system AND EXISTS (SELECT 1 FROM pr WHERE pr.kind = k.kind AND tr.system = pr.system AND tr.chain = pr.chain AND abs(tr.seq - pr.seq) <= 2)) AS truth_hits FROM si, (SELECT 'tube' AS kind UNION ALL SELECT 'cylinder') k),
sc AS (SELECT *, {PRF} FROM hi), f1 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2*precision*recall/(precision+recall) ELSE 0 END AS f1 FROM sc),
nn AS (SELECT system, count(*) AS n FROM ow GROUP BY system), ne AS (SELECT system, count(*) AS n_edges FROM ed GROUP BY system),
ou AS (SELECT en.system, CASE WHEN en.a IS NULL OR en.b IS NULL THEN 'seed not found or name mismatch' WHEN length IS NULL THEN 'seed A and B in different components' WHEN m IS NULL THEN 'empty tube' END AS reason, n, coalesce(n_edges, 0) AS n_edges, length, m,
t.precision AS tube_precision, t.recall AS tube_recall, t.f1 AS tube_f1, c.precision AS cylinder_precision, c.recall AS cylinder_recall, c.f1 AS cylinder_f1, t.f1 - c.f1 AS delta
FROM en LEFT JOIN nn ON nn.system = en.system LEFT JOIN ne ON ne.system = en.system LEFT JOIN le ON le.system = en.system LEFT JOIN si ON si.system = en.system LEFT JOIN f1 t ON t.system = en.system AND t.kind = 'tube' LEFT JOIN f1 c ON c.system = en.system AND c.kind = 'cylinder')"""
SCORES = ("tube_precision", "tube_recall", "tube_f1", "cylinder_precision", "cylinder_recall", "cylinder_f1", "delta")


def _systems(spark, sf) -> DataFrame:
    """Ten systems by label; one names a seed that isn't there and one a seed of another code."""
    code = lambda i: F.substring(F.lit(CODES), (i % 20).cast("int") + 1, F.lit(1))
    p = checkpoint(cloud(spark, sf).select(F.col("entity").alias("system"), "id", F.lit("A").alias("chain"), F.col("id").alias("seq_id"), code(F.col("id")).alias("code"), "x", "y", "z"))
    ends = p.groupBy("system").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    seeds = ends.select(
        "system", F.lit("A").alias("chain_a"), F.when(F.col("system") == 8, -1).otherwise(F.col("lo")).alias("seq_id_a"), code(F.col("lo")).alias("code_a"),
        F.lit("A").alias("chain_b"), F.col("hi").alias("seq_id_b"), F.when(F.col("system") == 9, "X").otherwise(code(F.col("hi"))).alias("code_b"),
    )
    return systems.run_systems(p, seeds, p.where("x > 0 and y > 0").select("system", "chain", "seq_id"), SYSTEM_RADIUS)


@query(f"WITH RECURSIVE {SYSTEMS} SELECT system, CASE WHEN reason IS NULL THEN 'OK' ELSE 'PIPELINE_FAILURE' END AS status, reason, {', '.join(f'CASE WHEN reason IS NULL THEN {c} END AS {c}' for c in ('n', 'n_edges', 'length', 'm'))}, {', '.join(f'CASE WHEN reason IS NULL THEN round({c}, 6) END AS {c}' for c in SCORES)} FROM ou")
def system_cohort(spark, sf):
    """Per system a whole run: radius graph, seeds with their check, tube and cylinder, both scores."""
    return _systems(spark, sf).withColumns({c: F.round(c, 6) for c in SCORES})


@query(f"""WITH RECURSIVE {SYSTEMS}, c AS (SELECT count(*) AS n, median(delta) AS m, count(*) FILTER (WHERE delta > 0) AS wins FROM ou WHERE reason IS NULL), w AS (SELECT *, 100.0 * wins / n AS win_pct FROM c)
SELECT n, round(m, 6) AS median_delta, wins, n - wins AS losses, round(CAST(win_pct AS DOUBLE), 6) AS win_pct, CASE WHEN m >= 0.05 AND win_pct >= 70 THEN 'ESTABLISH' WHEN m <= 0.01 OR 100 - win_pct >= 50 THEN 'REJECT' ELSE 'INCONCLUSIVE' END AS verdict FROM w""")
def system_cohort_verdict(spark, sf):
    return evaluate.cohort(_systems(spark, sf)).withColumns({c: F.round(c, 6) for c in ("median_delta", "win_pct")})
