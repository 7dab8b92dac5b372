"""The queries' rows in SQL, for DuckDB over the same tables. Queries that are not here are tested against Python."""

from __future__ import annotations

from .contracts import SQL as CONTRACTS


def pad(c: str) -> str:
    return f"lpad(CAST({c} AS VARCHAR), 2, '0')"


def r6(c: str, name: str) -> str:
    return f"round({c}, 6) + 0e0 AS {name}"


NODES = f"""nodes AS (
    SELECT 'N' || {pad("n_nationkey")} AS node_id, 'C' || {pad("n_nationkey")} AS camera_id, 1e1 * (n_nationkey // 5) AS x, 0e0 AS y, 4e0 * n_regionkey AS z,
           'F' || n_regionkey AS floor_id, 'Z' || (n_nationkey // 5) AS zone_id, n_nationkey AS k, n_regionkey AS fl FROM nation)"""
EDGES = f"""{NODES}, edges AS (
    SELECT 'E' || {pad("a.k")} || '_' || {pad("b.k")} AS edge_id, a.k AS a, b.k AS b, sqrt((b.x - a.x) ** 2 + (b.z - a.z) ** 2) AS len,
           CASE WHEN a.fl = b.fl THEN 'WALK' WHEN b.fl > a.fl THEN 'STAIR_UP' ELSE 'STAIR_DOWN' END AS kind
    FROM nodes a JOIN nodes b ON abs(a.k - b.k) = 5 OR abs(a.k - b.k) = 1 AND abs(a.fl - b.fl) = 1)"""
GAPS = """obs AS (
    SELECT user_id AS target_id, event_id, CAST(event_id % 25 AS INT) AS camera, epoch_us(ts) / 1e9 AS t FROM events WHERE event_type <> 'error'
), gaps AS (
    SELECT target_id, p_event_id AS start_id, event_id AS end_id, p_camera AS start_camera, camera AS end_camera, t - p_t AS gap_s, t AS end_t
    FROM (SELECT *, lag(event_id) OVER w AS p_event_id, lag(camera) OVER w AS p_camera, lag(t) OVER w AS p_t FROM obs WINDOW w AS (PARTITION BY target_id ORDER BY t, event_id))
    WHERE t > p_t)"""
GAP_PAIRS = f"WITH {GAPS} SELECT target_id, start_id, end_id, start_camera, end_camera, {r6('gap_s', 'gap_s')} FROM gaps"


def walks(most: float) -> str:
    """All walks from each node of at most this length; plen and ppath are the walk without its last edge."""
    return f"""walks AS (
    SELECT k AS s, k AS e, 0e0 AS len, CAST([] AS VARCHAR[]) AS path, -1e0 AS plen, CAST([] AS VARCHAR[]) AS ppath FROM nodes
    UNION ALL
    SELECT w.s, d.b, w.len + d.len, list_append(w.path, d.edge_id), w.len, w.path FROM walks w JOIN edges d ON d.a = w.e WHERE w.len + d.len <= {most})"""


SEARCH = f"""WITH RECURSIVE {EDGES}, {GAPS}, {walks(14.0)}, st AS (
    SELECT g.start_id || '-' || g.end_id AS request_id, g.gap_s, g.end_camera, w.* FROM gaps g JOIN walks w ON w.s = g.start_camera WHERE NOT w.len - 15e-1 * g.gap_s > 1e-12
), one AS (
    SELECT request_id, min({{'len': len, 'path': path}}) AS g FROM st WHERE e = end_camera GROUP BY request_id
), marked AS (
    SELECT st.*, e = end_camera AS is_goal, one.g, one.g IS NOT NULL AND len - (CASE WHEN one.g.len = 0 THEN 14e0 ELSE 2 * one.g.len END) > 1e-12 AS above
    FROM st LEFT JOIN one USING (request_id)
), over_ AS (
    SELECT DISTINCT request_id FROM marked WHERE above AND {{'len': plen, 'path': ppath}} < g
), ranked AS (
    SELECT *, row_number() OVER w AS rank, CASE WHEN is_goal THEN sum(CAST(is_goal AS INT)) OVER w END AS nth FROM marked WHERE NOT above WINDOW w AS (PARTITION BY request_id ORDER BY len, path)
), ends AS (
    SELECT request_id, count(*) + max(CASE WHEN o.request_id IS NULL THEN 0 ELSE 1 END) AS total, min(CASE WHEN nth > 3 THEN rank END) AS stop, count(CASE WHEN nth <= 3 THEN 1 END) AS n
    FROM ranked LEFT JOIN over_ o USING (request_id) GROUP BY request_id
)"""
WALKED = f"""WITH RECURSIVE {EDGES}, pairs AS (
    SELECT a.k AS s, b.k AS g, a.x AS sx, a.z AS sz, b.x AS gx, b.z AS gz FROM nodes a, nodes b
), steps AS (
    SELECT s, g, gx, gz, s AS here, sx AS x, sz AS z, CAST([] AS VARCHAR[]) AS path, 0e0 AS len FROM pairs
    UNION ALL
    SELECT w.s, w.g, w.gx, w.gz, d.b, n.x, n.z, list_append(w.path, d.edge_id), w.len + d.len FROM steps w JOIN edges d ON d.a = w.here JOIN nodes n ON n.k = d.b
    WHERE abs(w.gx - n.x) + abs(w.gz - n.z) < abs(w.gx - w.x) + abs(w.gz - w.z)
), best AS (SELECT s, g, min(path) AS path, min(len) AS len FROM steps WHERE here = g GROUP BY s, g)"""
PROPOSED = f"""{NODES}, pe AS (
    SELECT 'X' || CASE WHEN s_suppkey % 20 = 19 THEN s_suppkey - 1 ELSE s_suppkey END AS edge_id, s_nationkey AS a, s_suppkey % 27 AS b, ['WALK', 'STAIR_UP', 'STAIR_DOWN'][s_suppkey % 3 + 1] AS kind, s_suppkey % 4 AS q FROM supplier)"""
TRANSITIONS = f"""tr AS (
    SELECT 'Y' || s_suppkey AS transition_id, s_nationkey AS a, s_suppkey % 26 AS b, ['ADJACENT', 'SAME_ZONE', 'STAIR_UP', 'STAIR_DOWN'][s_suppkey % 4 + 1] AS kind FROM supplier)"""
KEYS = """keys AS (
    SELECT *, lead(x) OVER w AS ax, lead(y) OVER w AS ay, lead(z) OVER w AS az, lag(x) OVER w AS bx, lag(y) OVER w AS by_, lag(z) OVER w AS bz FROM (
        SELECT o_custkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS no, count(*) OVER (PARTITION BY o_custkey) AS n,
               CAST(o_orderkey % 101 AS DOUBLE) AS x, CAST(o_orderkey % 97 AS DOUBLE) AS y, CAST(o_orderkey % 7 AS DOUBLE) AS z, 'F' || (o_orderkey % 5) AS floor_id, 'Z' || (o_orderkey % 3) AS zone_id, o_orderpriority AS region
        FROM orders) WHERE n > 1 WINDOW w AS (PARTITION BY id ORDER BY no)
), ticks AS (
    SELECT id, no * 1400000 AS tick FROM keys
    UNION
    SELECT id, unnest(range(0, (n - 1) * 1400000 + 1, 1000000)) FROM (SELECT id, any_value(n) AS n FROM keys GROUP BY id)
), samples AS (
    SELECT t.id, row_number() OVER (PARTITION BY t.id ORDER BY tick) - 1 AS sample_no, tick / 2e6 AS ts,
           CASE WHEN tick = no * 1400000 THEN x ELSE x + ((tick - no * 1400000) / 14e5) * (ax - x) END AS x, CASE WHEN tick = no * 1400000 THEN y ELSE y + ((tick - no * 1400000) / 14e5) * (ay - y) END AS y,
           CASE WHEN tick = no * 1400000 THEN z ELSE z + ((tick - no * 1400000) / 14e5) * (az - z) END AS z,
           coalesce(ax - x, x - bx) / 7e-1 AS vx, coalesce(ay - y, y - by_) / 7e-1 AS vy, coalesce(az - z, z - bz) / 7e-1 AS vz, floor_id, zone_id, region
    FROM ticks t JOIN keys k ON k.id = t.id AND k.no = t.tick // 1400000)"""
PROJECTED = f"""{KEYS}, placed AS (
    SELECT CAST(id AS VARCHAR) AS target_id, sample_no AS frame_id, 'R' || r_regionkey AS camera_id, 2e1 * r_regionkey AS ox, 5e1 AS oy, 9e1 AS oz, x AS tx, y AS ty, z AS tz, 9e1 - z AS depth,
           CASE WHEN 9e1 - z BETWEEN 85 AND 200 THEN 64 * (x - 2e1 * r_regionkey) / (9e1 - z) + 50 END AS u, CASE WHEN 9e1 - z BETWEEN 85 AND 200 THEN 50 - 64 * (y - 5e1) / (9e1 - z) END AS v
    FROM samples, region
), projected AS (
    SELECT *, CASE WHEN depth <= 0 THEN 'BEHIND_CAMERA' WHEN depth < 85 THEN 'NEAR_CLIPPED' WHEN depth > 200 THEN 'FAR_CLIPPED' WHEN NOT (u >= 0 AND u < 100 AND v >= 0 AND v < 100) THEN 'OUTSIDE_FOV' ELSE 'IN_FRUSTUM' END AS reason FROM placed)"""
INVERSE = """planes AS (
    SELECT * FROM (VALUES ('P0', 0e0, 0e0, 0e0, 0e0, 0e0, 1e0), ('P1', 0e0, 0e0, 1e1, 6e-1, 0e0, 8e-1), ('P2', 0e0, 0e0, 1e2, 0e0, 0e0, 1e0), ('P3', 1e1, 0e0, 0e0, 1e0, 0e0, 0e0)) t(plane_id, px, py, pz, nx, ny, nz)
), px AS (
    SELECT event_id AS frame_id, 'R' || (event_id % 6) AS camera_id, 'P' || (event_id % 4) AS plane_id, event_type <> 'error' AS seen, (event_id * 37 % 1010) / 1e1 AS u, (event_id * 91 % 1010) / 1e1 AS v FROM events
), ray AS (
    SELECT px.*, r_regionkey, 2e1 * r_regionkey AS tx, (u - 50) / 64e0 AS dx, (50 - v) / 64e0 AS dy, -1e0 AS dz, px, py, pz, nx, ny, nz
    FROM px JOIN planes USING (plane_id) LEFT JOIN region ON camera_id = 'R' || r_regionkey
), met AS (
    SELECT *, nx * dx + ny * dy + nz * dz AS facing, (nx * (px - tx) + ny * (py - 5e1) + nz * (pz - 9e1)) AS off_ FROM ray
), deep AS (
    SELECT *, CASE WHEN abs(facing) > 1e-12 THEN off_ / facing END AS depth, least(1e0, abs(facing) / sqrt(dx * dx + dy * dy + dz * dz)) AS quality FROM met
), inv AS (
    SELECT *, CASE WHEN NOT seen THEN 'FRAME_NOT_OBSERVED' WHEN r_regionkey IS NULL THEN 'CAMERA_MISMATCH' WHEN NOT (u >= 0 AND u < 100 AND v >= 0 AND v < 100) THEN 'PIXEL_OUTSIDE_IMAGE' WHEN abs(facing) <= 1e-12 THEN 'RAY_PARALLEL_TO_PLANE'
                   WHEN depth <= 0 THEN 'INTERSECTION_BEHIND_CAMERA' WHEN depth < 85 THEN 'NEAR_CLIPPED' WHEN depth > 200 THEN 'FAR_CLIPPED' END AS failure, tx + depth * dx AS x, 5e1 + depth * dy AS y, 9e1 + depth * dz AS z FROM deep)"""


def _slab(a: str, d: str) -> str:
    return f"CASE WHEN {d} = 0 THEN NULL ELSE least((lo{a} - o{a}) / {d}, (hi{a} - o{a}) / {d}) END AS n{a}, CASE WHEN {d} = 0 THEN NULL ELSE greatest((lo{a} - o{a}) / {d}, (hi{a} - o{a}) / {d}) END AS f{a}"


BOXES = """boxes AS (
    SELECT name, x - s AS lox, y - s AS loy, 5e0 - s AS loz, x + s AS hix, y + s AS hiy, 5e0 + s AS hiz FROM (SELECT 'M' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS name, p_partkey * 37 % 1000 AS x, p_partkey * 71 % 1000 AS y, p_size / 1e1 AS s FROM part)
)"""


def _hits(*key: str) -> str:
    """near_, hits and first_hit of rays and boxes, for rays known by key."""
    k = ", ".join(key)
    return f"""near_ AS (
    SELECT {k}, name, len, {_slab("x", "((tx - ox) / len)")}, {_slab("y", "((ty - oy) / len)")}, {_slab("z", "((tz - oz) / len)")}
    FROM rays JOIN boxes ON len > 0 AND hix >= least(ox, tx) AND lox <= greatest(ox, tx) AND hiy >= least(oy, ty) AND loy <= greatest(oy, ty) AND hiz >= least(oz, tz) AND loz <= greatest(oz, tz)
), hits AS (
    SELECT {k}, name, len, greatest(0e0, nx, ny, nz) AS entry FROM near_ WHERE greatest(0e0, nx, ny, nz) <= least(len, fx, fy, fz)
), first_hit AS (
    SELECT {k}, min({{'entry': entry, 'name': name}}) AS h FROM hits WHERE entry > 0 AND entry < len - 1e-6 GROUP BY {k}
)"""


HITS = f"""rays AS (
    SELECT *, sqrt((tx - ox) ** 2 + (ty - oy) ** 2 + (tz - oz) ** 2) AS len FROM (
        SELECT CAST(c_custkey AS VARCHAR) AS ray_id, c_custkey * 13 % 1000 + 25e-2 AS ox, c_custkey * 29 % 1000 + 25e-2 AS oy, 5e0 AS oz,
               CASE WHEN c_custkey % 50 = 0 THEN c_custkey * 13 % 1000 + 25e-2 ELSE c_custkey * 17 % 1000 + 5e-1 END AS tx, CASE WHEN c_custkey % 50 = 0 THEN c_custkey * 29 % 1000 + 25e-2 ELSE c_custkey * 43 % 1000 + 5e-1 END AS ty, CASE WHEN c_custkey % 50 = 0 THEN 5e0 ELSE 6e0 END AS tz
        FROM customer)
), {BOXES}, {_hits("ray_id")}"""
def _spread(a: str, u: str, b: str, v: str, least: str) -> str:
    return f"{least}({a} * {u}lo, {a} * {u}hi) + {least}({b} * {v}lo, {b} * {v}hi)"


INSTANCED = f"""WITH rays AS (
    SELECT *, sqrt((tx - ox) ** 2 + (ty - oy) ** 2 + (tz - oz) ** 2) AS len FROM (
        SELECT CAST(c_custkey AS VARCHAR) AS ray_id, c_custkey * 13 % 1000 + 25e-2 AS ox, c_custkey * 29 % 1000 + 25e-2 AS oy, 5e0 AS oz,
               CASE WHEN c_custkey % 50 = 0 THEN c_custkey * 13 % 1000 + 25e-2 ELSE c_custkey * 17 % 1000 + 5e-1 END AS tx, CASE WHEN c_custkey % 50 = 0 THEN c_custkey * 29 % 1000 + 25e-2 ELSE c_custkey * 43 % 1000 + 5e-1 END AS ty, CASE WHEN c_custkey % 50 = 0 THEN 5e0 ELSE 6e0 END AS tz
        FROM customer)
), corners AS (
    SELECT * FROM (VALUES (0, -1e0, -1e0, -1e0), (1, -1e0, -1e0, 1e0), (2, -1e0, 1e0, -1e0), (3, -1e0, 1e0, 1e0), (4, 1e0, -1e0, -1e0), (5, 1e0, -1e0, 1e0), (6, 1e0, 1e0, -1e0), (7, 1e0, 1e0, 1e0), (8, -1e0, 25e-2, -1e0), (9, 1e0, 25e-2, -1e0), (10, 1e0, 25e-2, 1e0), (11, -1e0, 25e-2, 1e0)) t(v, x, y, z)
), faces AS (
    SELECT * FROM (VALUES (0, 0, 1, 3), (0, 0, 3, 2), (0, 4, 5, 7), (0, 4, 7, 6), (0, 0, 1, 5), (0, 0, 5, 4), (0, 2, 3, 7), (0, 2, 7, 6), (0, 0, 2, 6), (0, 0, 6, 4), (0, 1, 3, 7), (0, 1, 7, 5), (1, 7, 1, 2), (1, 7, 1, 4), (1, 7, 2, 4), (1, 1, 2, 4), (2, 8, 9, 10), (2, 8, 10, 11)) t(mesh, a, b, c)
), sides AS (
    SELECT mesh, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz FROM faces f JOIN corners a ON a.v = f.a JOIN corners b ON b.v = f.b JOIN corners c ON c.v = f.c
), parts AS (
    SELECT 'I' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS name, p_partkey % 3 AS mesh, p_partkey % 97 = 0 AS flat, CAST(p_partkey * 37 % 1000 AS DOUBLE) AS x, CAST(p_partkey * 71 % 1000 AS DOUBLE) AS y,
           CASE WHEN p_partkey % 97 = 0 THEN 0e0 ELSE p_size / 1e1 END AS sx, p_size / 1e1 * (1 + p_partkey % 2) AS sy, p_size / 1e1 AS sz, [1e0, 6e-1, 8e-1, 0e0, -6e-1][p_partkey % 5 + 1] AS c, [0e0, 8e-1, -6e-1, 1e0, 8e-1][p_partkey % 5 + 1] AS s,
           -1e0 AS ulo, 1e0 AS uhi, CASE WHEN p_partkey % 3 = 2 THEN 25e-2 ELSE -1e0 END AS vlo, CASE WHEN p_partkey % 3 = 2 THEN 25e-2 ELSE 1e0 END AS vhi
    FROM part WHERE p_partkey % 13 <> 5 AND p_partkey % 17 <> 0 AND p_partkey % 29 <> 0 AND p_partkey <> 7
), bare AS (
    SELECT *, {_spread("c * sx", "u", "-s * sy", "v", "least")} + x AS x0, {_spread("c * sx", "u", "-s * sy", "v", "greatest")} + x AS x1, {_spread("s * sx", "u", "c * sy", "v", "least")} + y AS y0, {_spread("s * sx", "u", "c * sy", "v", "greatest")} + y AS y1, 5e0 - sz AS z0, 5e0 + sz AS z1 FROM parts
), padded AS (
    SELECT *, greatest(1e-6, 2e-6 * greatest(abs(x0), abs(x1), abs(y0), abs(y1), abs(z0), abs(z1))) AS pad FROM bare
), boxes AS (
    SELECT *, x0 - pad AS lox, x1 + pad AS hix, y0 - pad AS loy, y1 + pad AS hiy, z0 - pad AS loz, z1 + pad AS hiz FROM padded
), near_ AS (
    SELECT rays.ray_id, ox, oy, oz, (tx - ox) / len AS dx, (ty - oy) / len AS dy, (tz - oz) / len AS dz, boxes.*, len, {_slab("x", "((tx - ox) / len)")}, {_slab("y", "((ty - oy) / len)")}, {_slab("z", "((tz - oz) / len)")}
    FROM rays JOIN boxes ON len > 0 AND hix >= least(ox, tx) AND lox <= greatest(ox, tx) AND hiy >= least(oy, ty) AND loy <= greatest(oy, ty) AND hiz >= least(oz, tz) AND loz <= greatest(oz, tz)
), met AS (
    SELECT *, greatest(0e0, nx, ny, nz) AS entry FROM near_ WHERE greatest(0e0, nx, ny, nz) <= least(len, fx, fy, fz)
), unsure AS (
    SELECT ray_id, min({{'entry': entry, 'name': name}}) AS u FROM met WHERE flat GROUP BY ray_id
), turned AS (
    SELECT ray_id, name, entry, len, ax, ay, az, bx - ax AS px, by_ - ay AS py, bz - az AS pz, cx - ax AS qx, cy - ay AS qy, cz - az AS qz,
           (c * (ox - x) + s * (oy - y)) / sx AS ox, (c * (oy - y) - s * (ox - x)) / sy AS oy, (oz - 5e0) / sz AS oz, (c * dx + s * dy) / sx AS dx, (c * dy - s * dx) / sy AS dy, dz / sz AS dz
    FROM met JOIN sides USING (mesh) WHERE NOT flat
), crossed AS (
    SELECT *, dy * qz - dz * qy AS hx, dz * qx - dx * qz AS hy, dx * qy - dy * qx AS hz, ox - ax AS wx, oy - ay AS wy, oz - az AS wz FROM turned
), solved AS (
    SELECT *, px * hx + py * hy + pz * hz AS det, wy * pz - wz * py AS kx, wz * px - wx * pz AS ky, wx * py - wy * px AS kz FROM crossed
), struck AS (
    SELECT ray_id, name, entry, len, (wx * hx + wy * hy + wz * hz) / det AS u, (dx * kx + dy * ky + dz * kz) / det AS v, (qx * kx + qy * ky + qz * kz) / det AS t FROM solved WHERE det <> 0
), nearest AS (
    SELECT ray_id, min({{'hit': t, 'entry': entry, 'name': name}}) AS h FROM struck WHERE u >= 0 AND v >= 0 AND u + v <= 1 AND t >= 0 AND t < len - 1e-3 GROUP BY ray_id
)
SELECT ray_id, len > 0 AND u IS NULL AND h IS NOT NULL AS occluded, CASE WHEN len = 0 OR u IS NOT NULL THEN 'GEOMETRY_UNCERTAIN' WHEN h IS NOT NULL THEN 'OCCLUDED' ELSE 'CLEAR' END AS reason, CASE WHEN len > 0 THEN coalesce(u.name, h.name) END AS occluder_id
FROM rays LEFT JOIN unsure USING (ray_id) LEFT JOIN nearest USING (ray_id)"""
NEAREST = "SELECT ray_id, len > 0 AND h IS NOT NULL AS occluded, CASE WHEN len = 0 THEN 'GEOMETRY_UNCERTAIN' WHEN h IS NOT NULL THEN 'OCCLUDED' ELSE 'CLEAR' END AS reason, CASE WHEN len > 0 THEN h.name END AS occluder_id FROM rays LEFT JOIN first_hit USING (ray_id)"
LOCATED = f"""WITH {NODES}, e AS (
    SELECT *, epoch_us(ts) / 1e9 AS t, event_id % 25 AS node, 'O' || event_id AS observation_id, CASE WHEN event_id % 37 = 3 THEN 'C99' ELSE 'C' || {pad("event_id % 25")} END AS camera, CASE WHEN event_id % 41 = 7 THEN 'nobody' ELSE CAST(user_id AS VARCHAR) END AS target FROM events
), heads AS (
    SELECT observation_id, target, camera, t - 1 AS start_time, CASE WHEN event_id % 83 = 4 THEN t - 2 ELSE t END AS end_time, CASE event_id % 29 WHEN 5 THEN 'F9' WHEN 6 THEN NULL WHEN 7 THEN '' ELSE 'F' || (node % 5) END AS floor_id, event_type <> 'error' AS projected FROM e
), frames AS (
    SELECT observation_id, t AS moment, event_id % 43 <> 9 AS seen, camera, target FROM e
), points AS (
    SELECT observation_id, 'P' || event_id || '-' || CASE WHEN event_id % 79 = 8 THEN 0 ELSE k END AS point_id, CASE WHEN event_id % 47 = 11 THEN t ELSE t - 1 + k END AS moment, camera, CASE WHEN event_id % 89 = 3 THEN 'another' ELSE observation_id END AS owner,
           CASE event_id % 29 WHEN 5 THEN NULL WHEN 6 THEN NULL WHEN 7 THEN NULL WHEN 8 THEN 'F8' ELSE 'F' || (node % 5) END AS floor_id, 1e1 * (node // 5) + CASE WHEN event_id % 53 = 2 THEN 5e-1 ELSE 0 END AS x, 4e0 * (node % 5) AS z
    FROM e, (VALUES (0), (1)) v(k)
), framed AS (
    SELECT h.observation_id, bool_and(seen AND f.camera = h.camera AND f.target = h.target AND moment >= start_time AND moment <= end_time) AND count(*) = count(DISTINCT moment) AS ok FROM frames f JOIN heads h USING (observation_id) GROUP BY 1
), pathed AS (
    SELECT h.observation_id, bool_and(p.camera = h.camera AND moment >= start_time AND moment <= end_time AND owner = h.observation_id) AND count(*) = count(DISTINCT moment) AND count(*) = count(DISTINCT point_id) AS ok, min(moment) AS first_t, max(moment) AS last_t, max(p.floor_id) AS point_floor, max(x) AS x, max(z) AS z
    FROM points p JOIN heads h USING (observation_id) GROUP BY 1
), obs AS (
    SELECT h.observation_id, h.target, h.camera, nullif(h.floor_id, '') AS own_floor, point_floor, first_t, last_t, p.x, p.z, end_time >= start_time AND projected AND f.ok AND p.ok AS valid, n.floor_id AS camera_floor
    FROM heads h JOIN framed f USING (observation_id) JOIN pathed p USING (observation_id) LEFT JOIN nodes n ON n.camera_id = h.camera
), placed AS (
    SELECT *, CASE WHEN own_floor <> point_floor THEN 'ENDPOINT_FLOOR_MISMATCH' WHEN own_floor IS NULL AND point_floor IS NULL THEN 'ENDPOINT_FLOOR_REQUIRED' WHEN camera_floor IS NULL THEN 'UNKNOWN_CAMERA' WHEN camera_floor <> coalesce(point_floor, own_floor) THEN 'ENDPOINT_FLOOR_MISMATCH' END AS broken,
           (SELECT min(node_id) FROM nodes n WHERE n.floor_id = coalesce(point_floor, own_floor) AND sqrt((n.x - obs.x) ** 2 + (n.z - obs.z) ** 2) <= 1e-6) AS node_id
    FROM obs
), asked AS (
    SELECT before || '-' || event_id AS request_id, 'O' || CASE WHEN event_id % 67 = 5 THEN event_id ELSE before END AS s, 'O' || CASE WHEN event_id % 67 = 5 OR event_id % 61 = 0 THEN before WHEN event_id % 73 = 1 THEN -1 ELSE event_id END AS g, event_id % 59 <> 1 AS some_paths, event_id % 71 <> 3 AS slow
    FROM (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NOT NULL
), judged AS (
    SELECT request_id, a.node_id AS start_node, b.node_id AS end_node, b.first_t - a.last_t AS gap_s,
           CASE WHEN NOT some_paths THEN 'INVALID_MAX_PATHS' WHEN NOT coalesce(a.valid AND b.valid, false) THEN 'INVALID_OBSERVATION' WHEN a.target <> b.target THEN 'TARGET_MISMATCH' WHEN s = g THEN 'DUPLICATE_OBSERVATION' WHEN b.first_t - a.last_t <= 0 THEN 'INVALID_TIME_GAP'
                WHEN a.broken IS NOT NULL THEN a.broken WHEN a.node_id IS NULL THEN 'ENDPOINT_OFF_NETWORK' WHEN b.broken IS NOT NULL THEN b.broken WHEN b.node_id IS NULL THEN 'ENDPOINT_OFF_NETWORK' WHEN NOT slow THEN 'NUMERICAL_FAILURE' END AS failure
    FROM asked LEFT JOIN placed a ON a.observation_id = s LEFT JOIN placed b ON b.observation_id = g
)
SELECT request_id, failure, CASE WHEN failure IS NULL THEN start_node END AS start_node, CASE WHEN failure IS NULL THEN end_node END AS end_node, CASE WHEN failure IS NULL THEN round(gap_s, 6) + 0e0 END AS gap_s FROM judged"""
OBJECTS = """objects AS (
    SELECT ['Hall floor', 'Wall lamp', 'On-wall clock', 'Stair step', 'NavMesh path', 'AREA box', 'Front door', 'Chair'][p_partkey % 8 + 1] || ' ' || (p_partkey // 16) || CASE WHEN p_partkey % 16 > 7 THEN '.001' ELSE '' END AS name,
           p_type AS collections, CASE WHEN p_partkey % 10 = 9 THEN 'EMPTY' ELSE 'MESH' END AS type, p_size * 1500 AS polygons, p_size * 700 AS vertices, p_size * 4e0 AS dx, p_size * 5e0 AS dy,
           CASE WHEN p_partkey % 3 = 0 THEN 5e-3 WHEN p_partkey % 7 = 0 THEN 6e1 ELSE 3e0 END AS dz, p_brand FROM part)"""


def duplicates(key: str, where: str = "true", names: bool = True) -> str:
    shown = "array_to_string(list_sort(list(name ORDER BY name))[:100], ',') AS names, " if names else ""
    return f"WITH {OBJECTS} SELECT {key} AS key, count(*) AS n, {shown}count(*) > 100 AS truncated FROM objects WHERE {where} GROUP BY 1 HAVING count(*) > 1"


_TAGS = {"floor": "floor|ground|slab|deck", "wall": "wall", "stair": "stair|stairs|staircase|step", "walkable": "walkable|walkway|navmesh|navigation|corridor|hallway|path", "semantic_area": "area", "portal": "portal|door|entrance|exit"}
_NAMED = " UNION ALL ".join(
    f"SELECT name, '{c}' AS category, 'name_or_collection' AS basis, 'review_required' AS confidence FROM texts WHERE regexp_matches(t, '(^|[^a-z])({words})($|[^a-z])')" + (" AND NOT regexp_matches(t, 'wall lamp|wall clock|on-wall|speaker')" if c == "wall" else "")
    for c, words in _TAGS.items()
)
TAGS = f"""{OBJECTS}, texts AS (SELECT *, lower(concat_ws(' ', name, collections)) AS t FROM objects), tags AS (
    {_NAMED}
    UNION ALL SELECT name, 'large_horizontal_surface', 'dimensions_only', 'low' FROM texts WHERE type = 'MESH' AND dz <= greatest(1e-2, least(dx, dy) * 5e-2) AND dx * dy >= 10000
    UNION ALL SELECT name, 'vertical_barrier', 'dimensions_only', 'low' FROM texts WHERE type = 'MESH' AND dz >= 50 AND least(dx, dy) <= greatest(1e0, greatest(dx, dy) * 5e-2))"""
PORTALS = """shared_places AS (
    SELECT string_agg(name, ',' ORDER BY name) AS names, x, y, 0e0 AS z FROM (
        SELECT 'PORTAL_' || CASE WHEN s_suppkey % 2 = 0 THEN '1F_' ELSE '2F_' END || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS name, CAST(s_nationkey AS DOUBLE) AS x, CAST(s_suppkey % 3 AS DOUBLE) AS y FROM supplier)
    GROUP BY x, y HAVING bool_or(name LIKE 'PORTAL_1F%') AND bool_or(name LIKE 'PORTAL_2F%'))"""
SURFACES = """tri AS (
    SELECT p_brand AS name, CAST(p_partkey AS INT) AS polygon_index, CAST(p_size AS DOUBLE) AS s, CAST(p_partkey * 37 % 1000 AS DOUBLE) AS x, CAST(p_partkey * 71 % 1000 AS DOUBLE) AS y, (p_partkey % 40) * 1e-1 AS z, CASE WHEN p_partkey % 4 = 0 THEN 1e0 ELSE 0e0 END AS up FROM part
), surf AS (
    SELECT *, sqrt((s * up) ** 2 + (2 * s) ** 2) / 2 AS area, 2 * s / sqrt((s * up) ** 2 + (2 * s) ** 2) AS nz, (z + z + (z + up)) / 3 AS z_mean FROM tri WHERE s > 0
)"""


def _above(t: str) -> str:
    """Area, over x from a to b, of a right triangle's part above the line t: 2 high at its corner, 0 high s away."""
    e = f"greatest(a, least(b, s * (1 - ({t}) / 2)))"
    return f"((2 - ({t})) * ({e} - a) - ({e} * {e} - a * a) / s)"


OVERLAPS = f"""{SURFACES}, areas AS (
    SELECT 'AREA_' || {pad("n_nationkey")} AS area_, 2e2 * (n_nationkey // 5) AS xlo, 2e2 * (n_nationkey // 5) + 150 AS xhi, 2e2 * n_regionkey AS ylo, 2e2 * n_regionkey + 150 AS yhi, 4e-1 * n_regionkey AS zlo FROM nation
), sides AS (
    SELECT *, greatest(0e0, xlo - x) AS a, least(s, xhi - x) AS b, greatest(0e0, ylo - y) AS c, least(2e0, yhi - y) AS d FROM areas JOIN surf ON x + s >= xlo AND x <= xhi AND y + 2 >= ylo AND y <= yhi
), cut AS (SELECT *, {_above("c")} - {_above("d")} AS clipped FROM sides WHERE a < b AND c < d)"""

FRAMES = f"""{PROJECTED}, rays AS (
    SELECT *, sqrt((tx - ox) ** 2 + (ty - oy) ** 2 + (tz - oz) ** 2) AS len FROM projected WHERE reason = 'IN_FRUSTUM'
), {BOXES}, {_hits("target_id", "frame_id", "camera_id")}, frames AS (
    SELECT p.*, h.name AS occluder_id, CASE WHEN reason <> 'IN_FRUSTUM' THEN reason WHEN h IS NOT NULL THEN 'OCCLUDED' END AS gap_reason FROM projected p LEFT JOIN first_hit USING (target_id, frame_id, camera_id))"""

ORACLE_SQL: dict[str, str] = {
    "gap_pairs": GAP_PAIRS,
    # the frames of the last hour still wait for the watermark
    "stream_gap_pairs": f"{GAP_PAIRS} WHERE end_t <= (SELECT max(t) FROM obs) - 36e-1",
    "gap_topk": f"""WITH RECURSIVE {EDGES}, {GAPS}, {walks(30.0)}, top AS (
            SELECT * FROM (SELECT s, e, len, path, row_number() OVER (PARTITION BY s, e ORDER BY len, path) AS rank FROM walks) WHERE rank <= 3)
        SELECT target_id, start_id, end_id, CAST(rank AS INT) AS rank, array_to_string(path, '>') AS corridor, len AS length, {r6("least(len / 15e-1, gap_s)", "min_time")}, {r6("greatest(0e0, gap_s - least(len / 15e-1, gap_s))", "slack")}
        FROM gaps JOIN top ON s = start_camera AND e = end_camera WHERE NOT len - 15e-1 * gap_s > 1e-12""",
    "gap_termination_short": f"""{SEARCH}, flags AS (
            SELECT request_id, bool_or(st.len + d.len - 14e0 > 1e-12) AS too_long, bool_or(st.len + d.len - 14e0 <= 1e-12 AND st.len + d.len - 15e-1 * gap_s > 1e-12) AS too_fast FROM st JOIN edges d ON d.a = st.e GROUP BY request_id)
        SELECT request_id, CASE WHEN stop IS NOT NULL THEN 'MAX_PATHS_REACHED' WHEN n = 0 THEN 'NO_FEASIBLE_PATH' ELSE 'COMPLETE' END AS termination_reason, CAST(coalesce(stop, total) AS BIGINT) AS expanded_nodes, stop IS NULL AS complete, n AS n_candidates,
               CASE WHEN stop IS NULL AND n = 0 THEN concat_ws(',', 'NO_FEASIBLE_AUTHORIZED_ROUTE', CASE WHEN too_fast THEN 'PHYSICALLY_IMPOSSIBLE_SPEED' END, CASE WHEN too_long THEN 'MAX_PATH_LENGTH_EXCEEDED' END) ELSE '' END AS rejections
        FROM ends LEFT JOIN flags USING (request_id)""",
    "gap_candidates_short": f"""{SEARCH} SELECT request_id, CAST(nth AS INT) AS rank, array_to_string(path, ',') AS corridor, len AS path_length, {r6("least(len / 15e-1, gap_s)", "minimum_travel_time")}, {r6("greatest(0e0, gap_s - least(len / 15e-1, gap_s))", "temporal_cost")},
               'CAMERA_REACHABLE,TOPOLOGY_AUTHORIZED,WALKABLE,WITHIN_MAX_SPEED' AS feasibility_flags, 'INFERRED_GAP' AS provenance FROM ranked WHERE nth <= 3""",
    "shortest_routes": f"{WALKED} SELECT 'N' || {pad('s')} || '>N' || {pad('g')} AS request_id, len AS distance, array_to_string(path, ',') AS edge_ids FROM best",
    "min_hops": f"{WALKED} SELECT 'C' || {pad('s')} || '>C' || {pad('g')} AS request_id, CAST(len(path) AS INT) AS hops, replace(array_to_string(path, ','), 'E', 'T') AS transition_ids FROM best",
    "route_polylines": f"""WITH {EDGES}, c AS (
            SELECT c_custkey AS k, c_nationkey AS a, c_nationkey + [5, -1, 1][c_custkey % 3 + 1] AS b, c_nationkey + [5, -1, 1][c_custkey % 3 + 1] + [5, -1, 1][(c_custkey // 3) % 3 + 1] AS c FROM customer
        ), j AS (
            SELECT c.*, CASE WHEN c.k % 11 = 0 THEN c.b + 1 ELSE c.b END AS b2, p.len AS l1 FROM c LEFT JOIN edges p ON p.a = c.a AND p.b = c.b
        ), f AS (
            SELECT j.k, j.a, j.b, j.c, l1, q.len AS l2, CASE WHEN j.k % 13 = 0 THEN NULL WHEN l1 IS NULL OR q.len IS NULL THEN 'UNKNOWN_EDGE' WHEN j.b <> j.b2 THEN 'NOT_CONTIGUOUS' END AS failure FROM j LEFT JOIN edges q ON q.a = j.b2 AND q.b = j.c
        )
        SELECT CAST(f.k AS VARCHAR) AS route_id, CASE WHEN failure IS NOT NULL THEN NULL WHEN f.k % 13 = 0 THEN CAST(m.x AS INT) || '/' || CAST(m.z AS INT) ELSE concat_ws(' ', CAST(m.x AS INT) || '/' || CAST(m.z AS INT), CAST(n.x AS INT) || '/' || CAST(n.z AS INT), CAST(o.x AS INT) || '/' || CAST(o.z AS INT)) END AS line,
               CASE WHEN failure IS NOT NULL THEN NULL WHEN f.k % 13 = 0 THEN 0e0 ELSE l1 + l2 END AS distance, failure
        FROM f LEFT JOIN nodes m ON m.k = f.a LEFT JOIN nodes n ON n.k = f.b LEFT JOIN nodes o ON o.k = f.c""",
    "edge_violations": f"""WITH {PROPOSED}, v AS (SELECT edge_id, unnest(['self_edge', 'repeated_point', 'walk_without_stair', 'stair_id', 'ascends', 'descends']) AS "constraint",
            unnest([a = b, a = b AND q <> 3, kind = 'WALK' AND q <> 0, kind <> 'WALK' AND q = 0, kind = 'STAIR_UP' AND b % 5 <= a % 5, kind = 'STAIR_DOWN' AND b % 5 >= a % 5]) AS broken FROM pe)
        SELECT edge_id, "constraint" FROM v WHERE broken""",
    "nav_graph_violations": f"""WITH {PROPOSED}, v AS (SELECT edge_id AS id, unnest(['endpoint', 'joins_nodes', 'walk_floor', 'stair_floor']) AS "constraint",
            unnest([n.k IS NULL, n.k IS NOT NULL AND q = 3, n.k IS NOT NULL AND kind = 'WALK' AND a % 5 <> b % 5, n.k IS NOT NULL AND kind <> 'WALK' AND a % 5 = b % 5]) AS broken FROM pe LEFT JOIN nodes n ON n.k = b)
        SELECT id, "constraint" FROM v WHERE broken UNION ALL SELECT edge_id, 'repeated_edge' FROM pe GROUP BY edge_id HAVING count(*) > 1""",
    "topology_violations": f"""WITH {NODES}, {TRANSITIONS}, v AS (SELECT transition_id AS id, unnest(['endpoint', 'stairs_cross_floors', 'same_zone']) AS "constraint",
            unnest([q.k IS NULL, q.k IS NOT NULL AND (kind LIKE 'STAIR%') <> (p.floor_id <> q.floor_id), kind = 'SAME_ZONE' AND NOT coalesce(p.zone_id = q.zone_id, false)]) AS broken FROM tr JOIN nodes p ON p.k = tr.a LEFT JOIN nodes q ON q.k = tr.b)
        SELECT id, "constraint" FROM v WHERE broken""",
    "network_violations": f"""WITH {EDGES}, {TRANSITIONS}, v AS (SELECT transition_id AS id, unnest(['anchors_exist', 'anchor_floor', 'edges_exist', 'contiguous', 'reaches_anchor', 'stair_up', 'stair_down', 'no_stairs']) AS "constraint",
            unnest([q.k IS NULL, q.k IS NULL, e.edge_id IS NULL, e.edge_id IS NULL, e.edge_id IS NULL, tr.kind = 'STAIR_UP' AND coalesce(e.kind <> 'STAIR_UP', true), tr.kind = 'STAIR_DOWN' AND coalesce(e.kind <> 'STAIR_DOWN', true), tr.kind IN ('ADJACENT', 'SAME_ZONE') AND coalesce(e.kind <> 'WALK', false)]) AS broken
            FROM tr LEFT JOIN nodes q ON q.k = tr.b LEFT JOIN edges e ON e.a = tr.a AND e.b = tr.b)
        SELECT id, "constraint" FROM v WHERE broken""",
    "locate_nodes": f"""WITH {NODES}, both_ AS (SELECT node_id, floor_id, x, y, z FROM nodes UNION ALL SELECT node_id || 'b', floor_id, x, y, z FROM nodes WHERE k % 5 = 3), p AS (
            SELECT CAST(s_suppkey AS VARCHAR) AS request_id, 1e1 * (s_nationkey // 5) + (s_suppkey % 4) * 4e-7 AS x, 4e0 * (s_nationkey % 5) AS z, 'F' || CASE WHEN s_suppkey % 9 = 8 THEN 7 ELSE s_nationkey % 5 END AS floor_id FROM supplier)
        SELECT request_id, CASE WHEN count(n.node_id) = 1 THEN min(n.node_id) END AS node_id, CASE WHEN count(n.node_id) > 1 THEN 'AMBIGUOUS_POSITION' END AS failure
        FROM p LEFT JOIN both_ n ON n.floor_id = p.floor_id AND sqrt((n.x - p.x) ** 2 + (n.z - p.z) ** 2) <= 1e-6 GROUP BY request_id""",
    "trajectory_samples": f"WITH {KEYS} SELECT id AS trajectory_id, sample_no, {r6('ts', 'timestamp')}, {', '.join(r6(c, c) for c in ('x', 'y', 'z', 'vx', 'vy', 'vz'))}, floor_id, zone_id, region AS semantic_region FROM samples",
    "sample_counts": f"WITH {KEYS} SELECT id AS trajectory_id, count(*) AS samples, any_value((n - 1) * 1400000 // 1000000 + 1) AS grid_samples FROM samples JOIN (SELECT DISTINCT id, n FROM keys) USING (id) GROUP BY id",
    "unordered_keyframes": "SELECT o_orderkey, previous FROM (SELECT o_orderkey, o_totalprice, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous FROM orders) WHERE previous >= o_totalprice",
    "samples_x_cameras_projection": f"WITH {PROJECTED} SELECT target_id, frame_id, camera_id, {r6('depth', 'depth')}, {r6('u', 'u')}, {r6('v', 'v')}, reason FROM projected",
    "gap_reason_counts": f"WITH {FRAMES} SELECT camera_id, CASE WHEN gap_reason IS NULL THEN 'OBSERVED' ELSE 'GAP' END AS status, coalesce(gap_reason, '-') AS gap_reason, count(*) AS n FROM frames GROUP BY ALL",
    "visible_frames": f"WITH {FRAMES} SELECT target_id, frame_id, camera_id, {r6('u', 'u')}, {r6('v', 'v')}, 'OBSERVED' AS provenance FROM frames WHERE gap_reason IS NULL",
    "occluded_frames": f"WITH {FRAMES} SELECT target_id, frame_id, camera_id, occluder_id FROM frames WHERE gap_reason = 'OCCLUDED'",
    "frame_violations": """WITH f AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'GAP' WHEN event_id % 50 = 0 THEN 'SEEN' ELSE 'OBSERVED' END AS status, NOT (event_type = 'error' AND event_id % 3 > 0 OR event_id % 7 = 0) AS pixel, event_type = 'error' AND event_id % 5 > 0 AS reason FROM events),
            v AS (SELECT event_id, unnest(['status', 'observed', 'gap']) AS "constraint", unnest([status = 'SEEN', status = 'OBSERVED' AND NOT pixel, status = 'GAP' AND (pixel OR NOT reason)]) AS broken FROM f)
        SELECT event_id, "constraint" FROM v WHERE broken""",
    "inverse_projection": f"WITH {INVERSE} SELECT frame_id, plane_id, {', '.join(r6(f'CASE WHEN failure IS NULL THEN {c} END', n) for c, n in (('x', 'x'), ('y', 'y'), ('z', 'z'), ('quality', 'quality')))}, failure FROM inv",
    "stream_projection": f"WITH {INVERSE} SELECT frame_id, plane_id, {', '.join(r6(f'CASE WHEN failure IS NULL THEN {c} END', n) for c, n in (('x', 'x'), ('y', 'y'), ('z', 'z'), ('quality', 'quality')))}, failure FROM inv",
    "projection_rejects": f"WITH {INVERSE} SELECT camera_id, failure, count(*) AS n FROM inv WHERE failure IS NOT NULL GROUP BY ALL",
    "segment_box_hits": f"WITH {HITS} SELECT ray_id, name, {r6('entry', 'entry')} FROM hits",
    "ray_nearest_hit": f"WITH {HITS} {NEAREST}",
    "ray_triangle_hit": f"WITH {HITS} {NEAREST} WHERE ray_id NOT IN (SELECT ray_id FROM hits WHERE entry <= 0)",
    "instanced_ray_hit": INSTANCED,
    "ray_budget": f"WITH {HITS}, n AS (SELECT ray_id, count(*) AS n FROM hits GROUP BY ray_id), r AS ({NEAREST}) SELECT CASE WHEN n > 4 THEN 'RAYCAST_LIMIT' ELSE reason END AS reason, count(*) AS n FROM r LEFT JOIN n USING (ray_id) GROUP BY 1",
    "object_counts": f"WITH {OBJECTS} SELECT type, count(*) AS n, CAST(sum(vertices) AS BIGINT) AS vertices, CAST(sum(polygons) AS BIGINT) AS polygons FROM objects GROUP BY type",
    "duplicate_groups": duplicates(r"lower(regexp_replace(name, '\.\d{3}$', ''))"),
    "shared_data_groups": duplicates("concat_ws('/', type, p_brand)"),
    "geometry_signature_groups": duplicates("concat_ws('/', vertices, polygons, collections)", "type = 'MESH'", names=False),
    "high_poly_objects": f"WITH {OBJECTS} SELECT name, polygons, vertices FROM objects WHERE type = 'MESH' AND polygons >= 50000",
    "top_meshes": f"WITH {OBJECTS} SELECT name, polygons FROM objects WHERE type = 'MESH' ORDER BY polygons DESC, name LIMIT 30",
    "semantic_tags": f"WITH {TAGS} SELECT name, category, basis, confidence FROM tags",
    "portal_overlap": f"WITH {PORTALS} SELECT names, x, y, z FROM shared_places",
    "collection_parents": "SELECT 'S' || (s_suppkey % 7) AS child, array_to_string(list_sort(list(DISTINCT 'N' || s_nationkey)), ',') AS parents FROM supplier GROUP BY 1",
    "z_layer_histogram": f"WITH {SURFACES} SELECT round_even(z_mean / 25e-2, 0) * 25e-2 + 0e0 AS z, {r6('sum(area)', 'area')}, count(*) AS triangles, count(DISTINCT name) AS objects FROM surf WHERE up = 0 GROUP BY 1",
    "layer_top5": f"WITH {SURFACES} SELECT z, CAST(rank AS INT) AS rank, name, polygon_index, {r6('area', 'area')} FROM (SELECT round_even(z_mean / 25e-2, 0) * 25e-2 + 0e0 AS z, name, polygon_index, area, row_number() OVER (PARTITION BY round_even(z_mean / 25e-2, 0) ORDER BY area DESC, name DESC, polygon_index DESC) AS rank FROM surf WHERE up = 0) WHERE rank <= 5",
    "slope_summary": f"WITH {SURFACES}, t AS (SELECT *, degrees(acos(least(1e0, nz))) AS slope FROM surf WHERE up = 1) SELECT name, {r6('sum(area * nz)', 'clipped_xy_area')}, {r6('min(slope)', 'slope_min')}, {r6('median(slope)', 'slope_median')}, {r6('max(slope)', 'slope_max')}, {r6('min(z)', 'z_min')}, {r6('max(z + up)', 'z_max')} FROM t GROUP BY name",
    "polygon_measures": f"WITH {SURFACES} SELECT name, polygon_index, {r6('area', 'area')}, {r6('area * nz', 'xy_area')}, {r6('z_mean', 'z')}, x AS xmin, x + s AS xmax, y AS ymin, y + 2 AS ymax, {r6('nz', 'normal_z')} FROM surf",
    "connected_patches": f"""WITH p AS (SELECT p_partkey AS k, p_partkey // 50 AS o, CAST(p_size AS DOUBLE) AS area, (p_partkey // 7 % 3) * 2e-1 AS z FROM part), m AS (
            SELECT *, CASE WHEN abs(z - lag(z) OVER w) <= 25e-2 AND k = lag(k) OVER w + 1 THEN 0 ELSE 1 END AS starts FROM p WINDOW w AS (PARTITION BY o ORDER BY k)
        ), g AS (SELECT *, sum(starts) OVER (PARTITION BY o ORDER BY k) AS patch FROM m)
        SELECT 'OBJ' || o AS name, count(*) AS polygons, {r6("sum(area)", "area")}, {r6("sum(area * z) / sum(area)", "z")}, CAST(min(k) AS DOUBLE) AS xmin, max(k) + 1e0 AS xmax FROM g GROUP BY o, patch HAVING sum(area) >= 5e-2""",
    "area_overlap": f"WITH {OVERLAPS} SELECT area_ AS area, round(z_mean, 2) AS z, {r6('sum(clipped)', 'clipped_xy_area')}, {r6('sum(clipped) / 225e2', 'coverage')} FROM cut WHERE up = 0 AND clipped > 1e-9 AND abs(z_mean - zlo) <= 5e-1 GROUP BY 1, 2",
    "area_layer_tops": f"""WITH {OVERLAPS}, faces AS (
            SELECT area_ AS area, round(z_mean, 2) AS z, name, polygon_index, round(clipped, 9) AS clipped FROM cut WHERE up = 0 AND clipped > 1e-9 AND abs(z_mean - zlo) <= 5e-1
        ), objects AS (
            SELECT area, z, name, round(sum(clipped), 9) AS clipped FROM faces GROUP BY ALL
        )
        SELECT area, z, 'object' AS kind, rank, name, NULL AS polygon_index, {r6('clipped', 'clipped_xy_area')} FROM (SELECT *, row_number() OVER (PARTITION BY area, z ORDER BY clipped DESC, name) AS rank FROM objects) WHERE rank <= 8
        UNION ALL
        SELECT area, z, 'face', rank, name, polygon_index, {r6('clipped', 'clipped_xy_area')} FROM (SELECT *, row_number() OVER (PARTITION BY area, z ORDER BY clipped DESC, name, polygon_index) AS rank FROM faces) WHERE rank <= 5""",
    "stair_levels": f"WITH {OVERLAPS} SELECT area_ AS area, {r6('round_even(z_mean / 5e-2, 0) * 5e-2', 'z')}, {r6('sum(clipped)', 'clipped_xy_area')}, count(*) AS up, CAST(0 AS BIGINT) AS down FROM cut WHERE up = 0 AND clipped > 1e-7 AND z_mean >= zlo - 2 AND z_mean <= zlo + 13 GROUP BY 1, 2 HAVING sum(clipped) >= 1e-2",
    "scene_bounds": f"WITH {HITS} SELECT 'scene' AS what, min(lox) AS xmin, max(hix) AS xmax, min(loy) AS ymin, max(hiy) AS ymax, min(loz) AS zmin, max(hiz) AS zmax FROM boxes",
    "camera_height_summary": f"""WITH c AS (SELECT 'CAM_' || (s_suppkey % 3 + 1) || 'F_' AS floor, s_acctbal / 100 AS z FROM supplier WHERE s_suppkey % 3 < 2), h AS (SELECT floor, CASE WHEN floor = 'CAM_1F_' THEN 15e0 ELSE 160e0 END AS base, count(*) AS n, min(z) AS lo, median(z) AS mid, max(z) AS hi FROM c GROUP BY floor)
        SELECT floor, n, {r6("lo", "z_min")}, {r6("mid", "z_median")}, {r6("hi", "z_max")}, {r6("lo - base", "above_min")}, {r6("mid - base", "above_median")}, {r6("hi - base", "above_max")} FROM h""",
    "camera_floor_zone": """SELECT CASE WHEN s_suppkey % 5 = 4 THEN 'SKP_' ELSE 'CAM_' END || (s_nationkey % 3) || 'F_HALL_' || CASE WHEN s_suppkey % 2 = 0 THEN 'WEST' ELSE 'EAST' END || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '_' || s_suppkey END AS name,
            CASE WHEN s_suppkey % 5 <> 4 THEN (s_nationkey % 3) || 'F' END AS floor_id, CASE WHEN s_suppkey % 5 <> 4 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'HALL_WEST' ELSE 'HALL_EAST' END END AS zone_id FROM supplier""",
    "camera_intrinsics": f"""WITH v AS (SELECT p_partkey, 1920 / (p_size / 8e0 + p_size / 1e1) AS fx, 1080 / (25e-2 + p_size / 1e2 + 5e-1) AS fy, p_size / 1e1 AS l, 25e-2 + p_size / 1e2 AS t FROM part)
        SELECT p_partkey, {r6("fx", "fx")}, {r6("fy", "fy")}, {r6("l * fx", "cx")}, {r6("t * fy", "cy")} FROM v""",
    "findings": f"""WITH {TAGS}, {PORTALS}, f AS (
            SELECT 'UNIT_SCALE_REVIEW_REQUIRED' AS code, 'blocking_for_metric_evaluation' AS severity, (SELECT count(*) FROM supplier WHERE s_suppkey % 3 < 2) AS n
            UNION ALL SELECT 'IMPORTED_CAMERA_REVIEW_CANDIDATE', 'review', (SELECT count(*) FROM supplier WHERE s_suppkey % 3 = 2)
            UNION ALL SELECT 'NONFINITE_CAMERA_INTRINSICS', 'blocking_for_camera_allowlist', (SELECT count(*) FROM supplier WHERE s_suppkey % 97 = 1)
            UNION ALL SELECT 'OUTER_LIGHT_GRID_NOT_REQUIRED_FOR_GEOMETRY', 'review', (SELECT count(*) FROM customer WHERE c_custkey % 50 = 7)
            UNION ALL SELECT 'MISSING_EXTERNAL_IMAGES', 'render_review', (SELECT count(*) FROM part WHERE p_partkey % 400 = 2)
            UNION ALL SELECT 'AREA_PORTAL_BOXES_ARE_NOT_WALKABLE_GEOMETRY', 'blocking_for_automatic_navmesh', (SELECT count(*) FROM objects WHERE name LIKE 'AREA %') + (SELECT count(*) FROM supplier)
            UNION ALL SELECT 'STAIR_TRANSITION_METADATA_MISSING', 'blocking_for_cross_floor_topology', (SELECT count(*) FROM objects WHERE name LIKE 'Stair%')
            UNION ALL SELECT 'CROSS_FLOOR_PORTAL_TRANSFORM_OVERLAP', 'scene_data_review', (SELECT count(*) FROM shared_places)
            UNION ALL SELECT 'NO_EXPLICIT_NAVMESH_OBJECT', 'blocking_for_automatic_navmesh', (SELECT CASE WHEN count(*) > 0 THEN 0 ELSE (SELECT count(*) FROM tags WHERE category = 'walkable') END FROM objects WHERE lower(name) LIKE '%navmesh%')
            UNION ALL SELECT 'HIGH_POLY_OBJECTS', 'performance_review', (SELECT count(*) FROM objects WHERE type = 'MESH' AND polygons >= 50000)
            UNION ALL SELECT 'LARGE_APPEARANCE_ASSET_SET', 'performance_review', (SELECT CASE WHEN count(DISTINCT p_brand) >= 100 OR count_if(p_partkey % 2 = 0) >= 100 THEN count(DISTINCT p_brand) + count_if(p_partkey % 2 = 0) ELSE 0 END FROM part))
        SELECT code, severity, n, 'manual_review_only' AS recommended_action FROM f WHERE n > 0""",
    "closed_schema_check": "SELECT event_id, 'extra' AS unknown FROM events WHERE event_id % 10 = 0",
    "missing_endpoints": f"WITH {PROPOSED} SELECT DISTINCT edge_id, 'N' || {pad('b')} AS node_id FROM pe WHERE b > 24",
    "observation_windows": f"WITH {GAPS} SELECT target_id, {r6('min(t)', 'start_time')}, {r6('max(t)', 'end_time')} FROM obs WHERE camera = 7 GROUP BY target_id HAVING min(t) <= 1705500 AND max(t) >= 1704500",
    "located_requests": LOCATED,
    "observation_violations": """WITH o AS (SELECT user_id, event_id % 25 AS camera, count(*) AS n, count(DISTINCT floor(epoch_us(ts) / 1e9 / 60)) AS times, bool_or(event_type = 'error') AS bad, count(DISTINCT event_id % 1000) AS points FROM events GROUP BY 1, 2),
            v AS (SELECT unnest(['provenance', 'frame_order', 'frames', 'path_order', 'point_ids']) AS "constraint", unnest([n % 2 = 1, times < n, bad, times < n, points < n]) AS broken FROM o)
        SELECT "constraint", count(*) AS n FROM v WHERE broken GROUP BY 1""",
}

ORACLE_SQL |= CONTRACTS
