"""DuckDB SQL for the queries that SQL can express."""

CHAT = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), turns AS (
    SELECT *, regexp_replace(text, '([<\[])(\\*/?(?:s>|(?:INST|SYS|ROLE)\]))', '\1\\\2', 'g') AS safe,
           regexp_replace(role, '([<\[])(\\*/?(?:s>|(?:INST|SYS|ROLE)\]))', '\1\\\2', 'g') AS safe_role
    FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))
           AS loss_sha256,
       CAST(sum(length(safe) + 7 + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13
                WHEN 'assistant' THEN 0 ELSE 13 + length(safe_role) END) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

_COMPONENTS = """
, reach AS (
    SELECT {id} AS a, {id} AS b FROM nodes
    UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), parts AS (SELECT a AS {id}, min(b) AS component_id FROM reach GROUP BY a)
"""

MINHASH = r"""
WITH RECURSIVE texts AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ')
                                 ELSE array_to_string(w[i:i + 4], ' ') END AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM texts WHERE len(w) > 0)
), nodes AS (
    SELECT t.doc_id, coalesce(c.n, 0) AS n
    FROM documents t LEFT JOIN (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id) c USING (doc_id)
), links AS (
    SELECT p.a, p.b
    FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both
          FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
    JOIN nodes na ON na.doc_id = p.a JOIN nodes nb ON nb.doc_id = p.b
    WHERE 100 * p.both >= 85 * (na.n + nb.n - p.both)
)""" + _COMPONENTS.format(id="doc_id") + """
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept
FROM nodes JOIN parts USING (doc_id)
"""

EMBEDDINGS = """
WITH RECURSIVE nodes AS (SELECT vec_id FROM embeddings),
usable AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y
    ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
    WHERE list_cosine_similarity(x.v, y.v) >= 0.93
)""" + _COMPONENTS.format(id="vec_id") + """
SELECT p.vec_id, coalesce(c.n, 0) AS n_links, p.component_id, p.vec_id = p.component_id AS kept
FROM parts p LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) c USING (vec_id)
"""

_WHOLE = ("list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT))")
_FINITE = ("embedding IS NOT NULL "
           "AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0")


def _clustering(rounds: int = 3, k: int = 16) -> str:
    """Assignment and floor of the mean, one pair of steps per round."""
    parts = [f"""
kept AS (SELECT vec_id, {_WHOLE.format(scale=64)} AS v FROM embeddings WHERE {_FINITE} AND len(embedding) = 64),
cent0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v FROM kept
          QUALIFY c < {k})"""]
    for r in range(rounds + 1):
        parts.append(f"""
near{r} AS (SELECT vec_id, v, min(d * {k} + c) % {k} AS c, min(d * {k} + c) // {k} AS d FROM (
              SELECT e.vec_id, e.v, q.c, CAST(list_sum(list_transform(list_zip(e.v, q.v),
                     lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
              FROM kept e, cent{r} q) GROUP BY vec_id, v)""")
        if r < rounds:
            parts.append(f"""
mean{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
              SELECT c, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n
              FROM near{r}, (SELECT unnest(range(1, 65)) AS i) GROUP BY c, i) GROUP BY c),
cent{r + 1} AS (SELECT q.c, coalesce(m.v, q.v) AS v FROM cent{r} q LEFT JOIN mean{r} m USING (c))""")
    return "WITH " + ",".join(parts) + f"""
SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance,
       CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(q.v, ',')) AS centroid_sha256
FROM near{rounds} a JOIN cent{rounds} q USING (c)
"""


MINING = f"""
WITH kept AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           {_WHOLE.format(scale=256)} AS v
    FROM embeddings WHERE label IS NOT NULL AND {_FINITE}
), scores AS (
    SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same,
           CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS s
    FROM kept a JOIN kept b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
), positives AS (
    SELECT a, b, s FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5
)
SELECT p.a AS anchor_id, p.b AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) AS INTEGER) AS rank,
       n.b AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM positives p JOIN scores n ON p.a = n.a AND NOT n.same
WHERE 30 * p.s <= 100 * n.s AND 100 * n.s <= 90 * p.s
QUALIFY rank <= 10
"""

ORACLE: dict[str, str] = {
    "op11_clustering": _clustering(),
    "op12_hard_negatives": MINING,
    "op4_embeddings": EMBEDDINGS,
    "op6_chat_formatting": CHAT,
    "op9_minhash": MINHASH,
}
