"""The tables of sources.star_schema as SQL common table expressions, from the same description."""

from __future__ import annotations

from girder.sources.star_schema import RELATIONS, TABLES


def _lid(key: str, tag: int) -> str:
    return f"CAST({key} AS BIGINT) * 8 + {tag}"


ITEMS = "items AS (" + " UNION ALL ".join(f"SELECT {_lid(k, t)} AS local_id, '{n.upper()}' AS category, '{n.upper()}:' || {k} AS guid FROM {n}" for n, t, k, _ in TABLES) + ")"


def _attribute(table: str, tag: int, key: str, ord_: int, column: str, kind: str) -> str:
    text = f"strftime({column}, '%Y-%m-%d')" if kind == "date" else column
    v_str, v_num = ("NULL", f"CAST({column} AS DOUBLE)") if kind == "number" else (text, "NULL")
    type_ = {"number": "IFCREAL", "string": "IFCLABEL", "date": "IFCDATE"}[kind]
    return (
        f"SELECT {_lid(key, tag)} AS local_id, {ord_} AS ord, '{column}' AS name, '{'number' if kind == 'number' else 'string'}' AS value_kind, "
        f"CAST({v_str} AS VARCHAR) AS v_str, CAST({v_num} AS DOUBLE) AS v_num, '{type_}' AS type FROM {table}"
    )


ATTRIBUTES = "attributes AS (" + " UNION ALL ".join(_attribute(n, t, k, o, c, kind) for n, t, k, cs in TABLES for o, (c, kind) in enumerate(cs)) + ")"


def _pairs() -> list[str]:
    out = []
    for name, inverse, table, (s, st), (d, dt) in RELATIONS:
        some = f"SELECT DISTINCT {_lid(s, st)} AS a, {_lid(d, dt)} AS b FROM {table}"
        out += [f"SELECT a AS src_id, '{name}' AS name, b AS dst_id FROM ({some})", f"SELECT b AS src_id, '{inverse}' AS name, a AS dst_id FROM ({some})"]
    return out


EDGES = "edges AS (" + " UNION ALL ".join(_pairs()) + ")"
SAMPLES = (
    "samples AS (SELECT l_orderkey AS item_id, l_partkey AS repr_id, l_returnflag || l_linestatus AS material, "
    "l_quantity AS lx, l_discount * 100 AS ly, l_tax * 100 AS lz FROM lineitem)"
)
TRANSFORMS = (
    "transforms AS (SELECT o_orderkey AS item_id, CAST(o_orderkey % 100 AS DOUBLE) AS gx, CAST(c_nationkey AS DOUBLE) AS gy, CAST(0 AS DOUBLE) AS gz "
    "FROM orders JOIN customer ON o_custkey = c_custkey)"
)
BOXES = (
    f"{SAMPLES}, {TRANSFORMS}, boxes AS (SELECT s.item_id, s.repr_id, s.material, gx + lx AS minx, gy + ly AS miny, gz + lz AS minz, "
    "gx + lx + p_size AS maxx, gy + ly + p_size / 2.0 AS maxy, gz + lz + 1 AS maxz "
    "FROM samples s JOIN transforms t ON s.item_id = t.item_id JOIN part ON p_partkey = s.repr_id)"
)
LOG = (
    "log AS (SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN 'CREATE_ITEM' WHEN 'error' THEN 'DELETE_ITEM' "
    "WHEN 'view' THEN 'UPDATE_RELATION' ELSE 'UPDATE_ITEM' END AS type, CAST(user_id AS BIGINT) * 8 + 3 AS local_id, value FROM events)"
)
PLACED = (
    f"{TRANSFORMS}, lines AS (SELECT l_orderkey AS item_id, l_linenumber AS ln, min(l_partkey) AS repr_id, min(l_quantity) AS lx FROM lineitem GROUP BY ALL), "
    "turns AS (SELECT l.*, l_ln.lc, l_ln.ls, CASE l.item_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 ELSE 0.8 END AS gc, CASE l.item_id % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 ELSE -0.6 END AS gs "
    "FROM lines l, LATERAL (SELECT CASE WHEN ln % 2 = 1 THEN 0.6 ELSE 1.0 END AS lc, CASE WHEN ln % 2 = 1 THEN 0.8 ELSE 0.0 END AS ls) l_ln), "
    "placed AS (SELECT item_id * 8 + ln AS sample_id, t.item_id, repr_id, CAST(gc * lc - gs * ls AS DOUBLE) AS c, CAST(gs * lc + gc * ls AS DOUBLE) AS s, "
    "CAST(gx + gc * lx - gs * (ln * 2.0) AS DOUBLE) AS tx, CAST(gy + gs * lx + gc * (ln * 2.0) AS DOUBLE) AS ty, CAST(p_size AS DOUBLE) AS size "
    "FROM turns t JOIN transforms USING (item_id) JOIN part ON p_partkey = repr_id)"
)
RAYS = (
    "rays AS (SELECT CAST(n_nationkey AS BIGINT) AS ray_id, CAST(-60 AS DOUBLE) AS ox, CAST(0.37 + n_nationkey % 25 AS DOUBLE) AS oy, CAST(0.11 - ((n_nationkey * 7) % 100 + 60) * 2.0 AS DOUBLE) AS oz, CAST(1 AS DOUBLE) AS dx, "
    "CAST((n_nationkey % 11) * 0.0137 - 0.05 AS DOUBLE) AS dy, CAST((n_nationkey % 13) * 0.0002 + 2.0 AS DOUBLE) AS dz FROM nation)"
)
#: Rays in the frame of each sample, where its box is parallel to the axes.
HITS = (
    f"{PLACED}, {RAYS}, own AS (SELECT ray_id, sample_id, item_id, size, c * (ox - tx) + s * (oy - ty) AS px, c * (oy - ty) - s * (ox - tx) AS py, oz AS pz, c * dx + s * dy AS qx, c * dy - s * dx AS qy, dz AS qz FROM rays, placed), "
    "slabs AS (SELECT *, greatest(least(-px / qx, (size - px) / qx), least(-py / qy, (size / 2 - py) / qy), least(-pz / qz, (1 - pz) / qz)) AS near, "
    "least(greatest(-px / qx, (size - px) / qx), greatest(-py / qy, (size / 2 - py) / qy), greatest(-pz / qz, (1 - pz) / qz)) AS far FROM own), "
    "hits AS (SELECT ray_id, sample_id, item_id, CASE WHEN near >= 0 THEN near ELSE far END AS distance FROM slabs WHERE near <= far AND far >= 0)"
)
