"""The registered queries as ANSI SQL over the raw test tables (DuckDB oracle).

Written independently of the DataFrame code: connected components by a
recursive closure (every vertex reaches every vertex of its component; the
label is the smallest one reached), DenGraph from its definition. Closure is
quadratic in component size, which is fine for the correctness scale.
"""

from __future__ import annotations

# The rules below are written out as SQL on purpose: nothing is taken from the
# code under test, so a wrong threshold, radius or id there shows as a difference.

def _det(col: str) -> str:
    digits = f"CAST({col} AS VARCHAR)"
    return f"('D' || CASE WHEN length({digits}) < 10 THEN lpad({digits}, 10, '0') ELSE {digits} END)"


_CLASS = """CAST(CASE WHEN vFreeflowMin - averageSpeed IS NULL THEN NULL
  WHEN vFreeflowMin - averageSpeed <= 0 THEN 0 WHEN vFreeflowMin - averageSpeed < 5 THEN 1
  WHEN vFreeflowMin - averageSpeed < 10 THEN 2 WHEN vFreeflowMin - averageSpeed < 15 THEN 3
  WHEN vFreeflowMin - averageSpeed < 20 THEN 4 WHEN vFreeflowMin - averageSpeed < 25 THEN 5
  WHEN vFreeflowMin - averageSpeed < 30 THEN 6 WHEN vFreeflowMin - averageSpeed < 35 THEN 7
  WHEN vFreeflowMin - averageSpeed < 40 THEN 8 WHEN vFreeflowMin - averageSpeed < 45 THEN 9
  WHEN vFreeflowMin - averageSpeed < 50 THEN 10 ELSE 11 END AS INTEGER)"""

_DISTANCE = """CASE WHEN src = dst THEN 0.0 WHEN weight = 0.0 THEN CAST('inf' AS DOUBLE)
  ELSE 1.0 - (1.0 - 1.0 / weight) END"""


def _edge_select(step: int, extra: str = "") -> str:
    return (f"SELECT {_det('a.u')} AS src, {_det('b.u')} AS dst, CAST(a.u AS DOUBLE) AS src_X, "
            f"CAST(0.0 AS DOUBLE) AS src_Y, CAST(b.u AS DOUBLE) AS dst_X, CAST(0.0 AS DOUBLE) AS dst_Y, "
            f"(b.u = a.u + 1) AS same_road, false AS is_dummy "
            f"FROM users a JOIN users b ON b.u = a.u + {step}{extra}")


def _ctes(bucket: str = "day") -> str:
    cls, dist = _CLASS, _DISTANCE
    return f"""
users AS (SELECT DISTINCT user_id AS u FROM events WHERE user_id IS NOT NULL),
road_edges AS (
  {_edge_select(1)}
  UNION ALL
  {_edge_select(10, " WHERE a.u % 10 = 0")}),
measurements AS (
  SELECT CAST(date_trunc('{bucket}', ts) AS TIMESTAMP) AS eventTime, {_det('user_id')} AS detectorId,
         'R1' AS road, 0 AS kmRef, 1 AS detectorNumber, 0 AS flowIn,
         CAST(floor(value) AS INTEGER) AS averageSpeed, CAST(value AS DOUBLE) AS density,
         CAST(70.0 AS DOUBLE) AS vFreeflowMin, 0 AS congestionClass
  FROM events),
valid AS (SELECT * FROM measurements WHERE eventTime IS NOT NULL AND detectorId IS NOT NULL),
road_vertices AS (SELECT src AS id FROM road_edges UNION SELECT dst FROM road_edges),
vertex_ids AS (SELECT CAST(row_number() OVER (ORDER BY id) AS INTEGER) AS numericId, id FROM road_vertices),
edges_encoded AS (
  SELECT e.*, s.numericId AS srcNumericId, d.numericId AS dstNumericId
  FROM road_edges e JOIN vertex_ids s ON e.src = s.id JOIN vertex_ids d ON e.dst = d.id),
classed AS (SELECT *, {cls} AS congestionClassStreaming FROM measurements),
on_edges AS (
  SELECT c.*, e.* FROM classed c JOIN edges_encoded e ON c.detectorId = e.dst
  WHERE c.eventTime IS NOT NULL AND c.detectorId IS NOT NULL),
congested_edges AS (
  SELECT eventTime, srcNumericId AS src, dstNumericId AS dst FROM on_edges
  WHERE congestionClassStreaming >= 5),
cc_und AS (SELECT eventTime, src AS a, dst AS b FROM congested_edges
           UNION SELECT eventTime, dst, src FROM congested_edges),
cc_reach(eventTime, v, r) AS (
  SELECT eventTime, a, a FROM cc_und
  UNION
  SELECT x.eventTime, x.v, y.b FROM cc_reach x JOIN cc_und y ON x.eventTime = y.eventTime AND x.r = y.a),
cc AS (SELECT CAST(min(r) AS INTEGER) AS componentId, eventTime, true AS final, CAST(v AS INTEGER) AS vertexId
       FROM cc_reach GROUP BY eventTime, v),
cc_decoded AS (SELECT cc.*, i.id FROM cc JOIN vertex_ids i ON cc.vertexId = i.numericId),
weighted AS (
  SELECT v.eventTime, e.src, e.dst, CAST(v.density AS DOUBLE) AS weight
  FROM valid v JOIN road_edges e ON v.detectorId = e.dst),
weighted_d AS (SELECT *, {dist} AS distance FROM weighted),
pair_dist AS (SELECT eventTime, src, dst, min(distance) AS distance FROM weighted_d GROUP BY eventTime, src, dst),
eps_edges AS (SELECT * FROM pair_dist WHERE distance <= 0.035),
nb AS (SELECT eventTime, src AS vertexId, dst AS neighbourId FROM eps_edges
       UNION ALL SELECT eventTime, dst, src FROM eps_edges WHERE src <> dst),
nb_size AS (SELECT eventTime, vertexId, CAST(count(*) AS INTEGER) AS neighbourhoodSize
            FROM nb GROUP BY eventTime, vertexId),
core AS (SELECT * FROM nb_size WHERE neighbourhoodSize >= 2),
core_und AS (
  SELECT nb.eventTime, nb.vertexId AS a, nb.neighbourId AS b FROM nb
  JOIN core c1 ON nb.eventTime = c1.eventTime AND nb.vertexId = c1.vertexId
  JOIN core c2 ON nb.eventTime = c2.eventTime AND nb.neighbourId = c2.vertexId),
core_reach(eventTime, v, r) AS (
  SELECT eventTime, vertexId, vertexId FROM core
  UNION
  SELECT x.eventTime, x.v, y.b FROM core_reach x JOIN core_und y ON x.eventTime = y.eventTime AND x.r = y.a),
core_label AS (SELECT eventTime, v AS vertexId, min(r) AS minCore FROM core_reach GROUP BY eventTime, v),
border AS (
  SELECT nb.eventTime, nb.vertexId, min(cl.minCore) AS borderOf FROM nb
  JOIN core_label cl ON nb.eventTime = cl.eventTime AND nb.neighbourId = cl.vertexId
  WHERE NOT EXISTS (SELECT 1 FROM core c WHERE c.eventTime = nb.eventTime AND c.vertexId = nb.vertexId)
  GROUP BY nb.eventTime, nb.vertexId),
ends AS (SELECT eventTime, src AS vertexId FROM weighted UNION SELECT eventTime, dst FROM weighted),
cluster_rank AS (
  SELECT eventTime, minCore,
         CAST(dense_rank() OVER (PARTITION BY eventTime ORDER BY minCore) - 1 AS INTEGER) AS clusterId
  FROM (SELECT DISTINCT eventTime, minCore FROM core_label) q),
clusters AS (
  SELECT COALESCE(r.clusterId, -1) AS clusterId, en.eventTime, true AS final, en.vertexId,
         CASE WHEN cl.minCore IS NOT NULL THEN 'CORE' WHEN b.borderOf IS NOT NULL THEN 'BORDER'
              ELSE 'NOISE' END AS vertexType
  FROM ends en
  LEFT JOIN core_label cl ON cl.eventTime = en.eventTime AND cl.vertexId = en.vertexId
  LEFT JOIN border b ON b.eventTime = en.eventTime AND b.vertexId = en.vertexId
  LEFT JOIN cluster_rank r ON r.eventTime = en.eventTime AND r.minCore = COALESCE(cl.minCore, b.borderOf))
"""


# Every class at once: the closure of the edges that reach a class, class by class.
_BY_CLASS = """,
edge_class AS (SELECT eventTime, srcNumericId AS src, dstNumericId AS dst,
                      max(congestionClassStreaming) AS c
               FROM on_edges WHERE congestionClassStreaming IS NOT NULL GROUP BY ALL),
class_und AS (SELECT k, eventTime, src AS a, dst AS b FROM edge_class, (SELECT unnest(range(1, 12)) AS k)
              WHERE c >= k
              UNION SELECT k, eventTime, dst, src FROM edge_class, (SELECT unnest(range(1, 12)) AS k)
              WHERE c >= k),
class_reach(k, eventTime, v, r) AS (
  SELECT k, eventTime, a, a FROM class_und
  UNION
  SELECT x.k, x.eventTime, x.v, y.b FROM class_reach x
  JOIN class_und y ON x.k = y.k AND x.eventTime = y.eventTime AND x.r = y.a),
by_class AS (SELECT CAST(k AS INTEGER) AS congestionClass, eventTime, CAST(v AS INTEGER) AS vertexId,
                    CAST(min(r) AS INTEGER) AS componentId
             FROM class_reach GROUP BY k, eventTime, v)
"""

# Vertices of the network among the users seen so far, numbered version by version.
_DICTIONARY = f""",
first_seen AS (SELECT user_id AS u, min(ts) AS ts FROM events WHERE user_id IS NOT NULL GROUP BY user_id),
stage AS (SELECT u, CASE WHEN ts < d + INTERVAL 1 DAY THEN 1 WHEN ts < d + INTERVAL 2 DAY THEN 2 ELSE 3 END AS v
          FROM first_seen, (SELECT date_trunc('day', min(ts)) AS d FROM events)),
dict_edges AS (SELECT a.u AS a, b.u AS b, greatest(a.v, b.v) AS v FROM stage a JOIN stage b
               ON b.u = a.u + 1 OR (b.u = a.u + 10 AND a.u % 10 = 0)),
dict AS (SELECT u, min(v) AS version FROM (SELECT a AS u, v FROM dict_edges UNION ALL SELECT b, v FROM dict_edges)
         GROUP BY u)
"""

_TRACKS = """,
member AS (SELECT eventTime, clusterId, vertexId, dense_rank() OVER (ORDER BY eventTime) AS step
           FROM clusters WHERE clusterId >= 0),
shared AS (SELECT a.step, a.clusterId AS c, b.clusterId AS n, count(*) AS s
           FROM member a JOIN member b ON b.step = a.step + 1 AND a.vertexId = b.vertexId GROUP BY ALL),
succ AS (SELECT step, c, n FROM shared QUALIFY row_number() OVER (PARTITION BY step, c ORDER BY s DESC, n) = 1),
pred AS (SELECT step, n, c FROM shared QUALIFY row_number() OVER (PARTITION BY step, n ORDER BY s DESC, c) = 1),
kept AS (SELECT step, c, n FROM succ JOIN pred USING (step, c, n)),
node AS (SELECT eventTime, step, clusterId, count(*) AS vertices FROM member GROUP BY ALL),
track(step, c, step0, c0) AS (
  SELECT step, clusterId, step, clusterId FROM node o
  WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.step + 1 = o.step AND k.n = o.clusterId)
  UNION ALL
  SELECT k.step + 1, k.n, t.step0, t.c0 FROM track t JOIN kept k ON k.step = t.step AND k.c = t.c)
"""


def _json_ts(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%dT%H:%M:%S.%g')"


_FINAL_SELECTS = {
    "road_edges": "SELECT * FROM road_edges",
    "road_vertices": "SELECT id FROM road_vertices",
    "vertex_numeric_ids": "SELECT numericId, id FROM vertex_ids",
    "edges_encoded": "SELECT * FROM edges_encoded",
    "measurements": "SELECT * FROM measurements",
    "congestion_class": "SELECT * FROM classed",
    "measurements_on_edges": "SELECT * FROM on_edges",
    "congested_edges": "SELECT * FROM congested_edges",
    "weighted_edges": "SELECT * FROM weighted_d",
    "epsilon_edges": "SELECT * FROM eps_edges",
    "congested_components": "SELECT eventTime, vertexId, componentId FROM cc",
    "components_decoded": "SELECT * FROM cc_decoded",
    "components_by_sql": """
SELECT eventTime, componentId, count(*) AS vertices, min(id) AS firstId, max(id) AS lastId
FROM cc_decoded GROUP BY eventTime, componentId""",
    "component_map_exploded": "SELECT componentId, eventTime, final, vertexId FROM cc",
    "dengraph_neighborhood": "SELECT * FROM nb_size",
    "dengraph_core": "SELECT * FROM core",
    "dengraph_clusters": "SELECT clusterId, eventTime, vertexId, vertexType FROM clusters",
    "dengraph_map_exploded": "SELECT * FROM clusters",
    "components_by_class": "SELECT * FROM by_class",
    "component_nesting": """
SELECT a.congestionClass, a.eventTime, a.componentId, count(*) AS vertices, coalesce(any_value(p.componentId), -1) AS parentId
FROM by_class a LEFT JOIN by_class p ON p.congestionClass = a.congestionClass - 1
     AND p.eventTime = a.eventTime AND p.vertexId = a.componentId
GROUP BY a.congestionClass, a.eventTime, a.componentId""",
    "vertex_dictionary": f"""
SELECT row_number() OVER (ORDER BY version, {_det('u')}) AS numericId, {_det('u')} AS id,
       CAST(version AS INTEGER) AS version FROM dict""",
    "cluster_tracks": """
SELECT o.eventTime, o.clusterId, format('{:010d}.{:010d}', t.step0, t.c0) AS trackId,
       CASE WHEN EXISTS (SELECT 1 FROM kept k WHERE k.step + 1 = o.step AND k.n = o.clusterId) THEN 'CONTINUE'
            WHEN EXISTS (SELECT 1 FROM pred p WHERE p.step + 1 = o.step AND p.n = o.clusterId) THEN 'SPLIT'
            ELSE 'START' END AS origin,
       (SELECT count(*) FROM succ u WHERE u.step + 1 = o.step AND u.n = o.clusterId
        AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.step = u.step AND k.c = u.c AND k.n = u.n)) AS merged,
       o.vertices
FROM node o JOIN track t ON t.step = o.step AND t.c = o.clusterId""",
    "component_updates_kv": f"""
SELECT key, json_object('componentId', componentId, 'eventTime', {_json_ts('eventTime')},
                        'final', final, 'vertexId', vertexId, 'id', id, 'key', key)::VARCHAR AS value
FROM (SELECT *, CAST(eventTime AS VARCHAR) || '_' || id || '_' || CAST(final AS VARCHAR) AS key
      FROM cc_decoded) q""",
    "dengraph_updates_kv": f"""
SELECT key, json_object('clusterId', clusterId, 'eventTime', {_json_ts('eventTime')},
                        'final', final, 'vertexId', vertexId, 'vertexType', vertexType,
                        'key', key)::VARCHAR AS value
FROM (SELECT *, CAST(eventTime AS VARCHAR) || '_' || vertexId || '_' || CAST(final AS VARCHAR) AS key
      FROM clusters) q""",
}


def oracle_queries(bucket: str = "day") -> dict[str, str]:
    ctes = _ctes(bucket)
    more = {"components_by_class": _BY_CLASS, "component_nesting": _BY_CLASS,
            "vertex_dictionary": _DICTIONARY, "cluster_tracks": _TRACKS}
    return {name: f"WITH RECURSIVE {ctes}{more.get(name, '')}\n{sel}"
            for name, sel in _FINAL_SELECTS.items()}
