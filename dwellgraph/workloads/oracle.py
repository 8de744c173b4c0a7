"""The same results in SQL, written from the definitions: recursive where the definition is a moving pointer."""

from __future__ import annotations

import math

from . import tables as T

# Fixed values, stated here again so that the SQL does not follow the code: radii and pi of the two distances, characters that an encoded request
# keeps, and the columns of place details.
RADIUS_ROUNDED_KM = 6371.0
RADIUS_RAW_KM = 6370.99681
PI_RAW = 3.1415926
KEPT = "/:=&?#+!$,;'@()*[]"
DETAIL_COLUMNS = [
    "uid", "name", "lng", "lat", "city", "area", "tag", "overall_rating", "shop_hours", "price", "level", "scope_grade", "telephone", "content_tag",
]

def _with(ctes: list[str], select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select


def _km4(lon1, lat1, lon2, lat2) -> str:
    r = repr(math.pi / 180) + "::DOUBLE"
    cosine = (f"sin({r}*{lat1})*sin({r}*{lat2}) + cos({r}*{lat1})*cos({r}*{lat2})*cos({r}*{lon2} - {r}*{lon1})")
    return (f"CASE WHEN {lat1} = {lat2} AND {lon1} = {lon2} THEN 0.0::DOUBLE ELSE "
            f"round(acos(least(1.0::DOUBLE, greatest(-1.0::DOUBLE, {cosine}))) * {RADIUS_ROUNDED_KM}::DOUBLE, 4) END")


def _kmraw(lon1, lat1, lon2, lat2) -> str:
    a, x, b, y = (f"({c}*{PI_RAW}::DOUBLE/180.0::DOUBLE)" for c in (lat1, lon1, lat2, lon2))
    cosine = f"cos({a})*cos({x})*cos({b})*cos({y}) + cos({a})*sin({x})*cos({b})*sin({y}) + sin({a})*sin({b})"
    return (f"CASE WHEN {lat1} = {lat2} AND {lon1} = {lon2} THEN 0.0::DOUBLE ELSE "
            f"acos(least(1.0::DOUBLE, greatest(-1.0::DOUBLE, {cosine}))) * {RADIUS_RAW_KM}::DOUBLE END")


ORDER = "start_s, end_s, cid, lon, lat"
OUT = '"user", cid, round(lon, 6) AS lon, round(lat, 6) AS lat, start_s, end_s, stay_s'

RAW = """raw AS (
  SELECT user_id::VARCHAR AS "user", epoch(date_trunc('second', ts))::BIGINT AS s,
         (json_extract_string(props, '$.k')::BIGINT % 24)::VARCHAR AS cid FROM events)"""
CELLS = """cells AS (
  SELECT c::VARCHAR AS cid,
         110.3::DOUBLE + 0.015::DOUBLE * (c % 4) + (CASE WHEN c >= 8 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS lon,
         20.0::DOUBLE + 0.015::DOUBLE * ((c // 4) % 2) AS lat
  FROM (SELECT n_nationkey::BIGINT AS c FROM nation))"""
RECORDS = """rec AS (
  SELECT r."user", r.s, c.cid, c.lon, c.lat FROM raw r JOIN cells c ON c.cid = (r.cid::BIGINT % 12)::VARCHAR)"""
BASE = [RAW, CELLS, RECORDS]


def _stays(gap: int = T.STAY_GAP, keep_last: bool = False, src: str = "rec", out: str = "stays") -> list[str]:
    last = "" if keep_last else "WHERE run < last_run"
    return [
        f"""{out}_b AS (
  SELECT *, CASE WHEN lag(s) OVER w IS NULL OR cid <> lag(cid) OVER w OR s - lag(s) OVER w >= {gap} THEN 1 ELSE 0 END AS b
  FROM {src} WINDOW w AS (PARTITION BY "user" ORDER BY s, cid, lon, lat))""",
        f"""{out}_r AS (
  SELECT *, sum(b) OVER (PARTITION BY "user" ORDER BY s, cid, lon, lat ROWS UNBOUNDED PRECEDING) AS run FROM {out}_b)""",
        f"""{out}_a AS (
  SELECT "user", cid, min(lon) AS lon, min(lat) AS lat, min(s) AS start_s, max(s) AS end_s, max(s) - min(s) AS stay_s, run,
         max(run) OVER (PARTITION BY "user") AS last_run
  FROM {out}_r GROUP BY "user", run, cid)""",
        f'{out} AS (SELECT "user", cid, lon, lat, start_s, end_s, stay_s FROM {out}_a {last})',
    ]


def _segments(gap: int, src: str, out: str) -> list[str]:
    return [
        f"""{out}_b AS (
  SELECT *, CASE WHEN lag(end_s) OVER w IS NULL OR start_s - lag(end_s) OVER w >= {gap} THEN 1 ELSE 0 END AS b
  FROM {src} WINDOW w AS (PARTITION BY "user" ORDER BY {ORDER}))""",
        f"""{out} AS (
  SELECT * EXCLUDE (b), sum(b) OVER (PARTITION BY "user" ORDER BY {ORDER} ROWS UNBOUNDED PRECEDING)::BIGINT AS seg_id
  FROM {out}_b)""",
    ]


def _drift(src: str = "stays", out: str = "calm", adjacency: bool = False, isolated: float | None = None,
           true_share: bool = False) -> list[str]:
    o = T.DRIFT
    near = ("EXISTS (SELECT 1 FROM listed l WHERE l.cid = k.cid1 AND l.nbr_cid = k.cid)" if adjacency else "false")
    rule = (f"WHEN d01 / d02 > {isolated} AND v01 * v12 > {o['max_speed']} * {o['max_speed']} THEN 'bounce'" if isolated else "")
    share = "AND (ce - cb)::DOUBLE / n < 0.34" if true_share else ""
    cluster_s = 40_000 if true_share else o["cluster_s"]
    speed = "CASE WHEN {t} = 0 OR {d} = 0 THEN 0.0::DOUBLE ELSE {d} * 1000 / {t} END"
    listed = ["listed AS (SELECT cid, (cid::BIGINT - 8)::VARCHAR AS nbr_cid FROM cells WHERE cid::BIGINT >= 8)"] if adjacency else []
    p = out
    return listed + _segments(o["gap_s"], src, f"{p}_s") + [
        f"""{p}_p AS (
  SELECT *, row_number() OVER (PARTITION BY "user", seg_id ORDER BY {ORDER}) - 1 AS pos,
         count(*) OVER (PARTITION BY "user", seg_id) AS n FROM {p}_s)""",
        f"""{p}_k AS (
  SELECT *, lead(cid) OVER w AS cid1, lead(lon) OVER w AS lon1, lead(lat) OVER w AS lat1, lead(start_s) OVER w AS start1,
         lead(end_s) OVER w AS end1, lead(lon, 2) OVER w AS lon2, lead(lat, 2) OVER w AS lat2, lead(start_s, 2) OVER w AS start2
  FROM {p}_p WINDOW w AS (PARTITION BY "user", seg_id ORDER BY pos))""",
        f"""{p}_d AS (
  SELECT k.*, {near} AS adj, {_km4('lon1', 'lat1', 'lon', 'lat')} AS d01, {_km4('lon1', 'lat1', 'lon2', 'lat2')} AS d12,
         {_km4('lon2', 'lat2', 'lon', 'lat')} AS d02, start1 - end_s AS t01, start2 - end1 AS t12 FROM {p}_k k)""",
        f"""{p}_v AS (
  SELECT *, {speed.format(t='t01', d='d01')} AS v01, {speed.format(t='t12', d='d12')} AS v12 FROM {p}_d)""",
        f"""{p}_m AS (
  SELECT "user", seg_id, pos, CASE WHEN adj OR NOT d01 > 4 THEN 'go'
         WHEN pos + 2 = n THEN (CASE WHEN v01 < {o['max_speed']} THEN 'go' ELSE 'tail' END)
         WHEN d02 = 0 THEN 'bounce' {rule}
         WHEN (d12 = 0 OR d02 / d12 > 3) AND d12 < 4 THEN 'cut' ELSE 'skip' END AS move
  FROM {p}_v WHERE pos < n - 1)""",
        f"""{p}_w AS (
  SELECT "user", seg_id, n, 0::BIGINT AS b, 0::BIGINT AS e, false AS done, NULL::BIGINT AS cb, NULL::BIGINT AS ce, NULL::BIGINT AS dr
  FROM {p}_p WHERE pos = 0 AND n >= 3
  UNION ALL
  SELECT w."user", w.seg_id, w.n,
         CASE m.move WHEN 'cut' THEN w.e + 1 WHEN 'skip' THEN w.e + 2 ELSE w.b END,
         CASE WHEN m.move IS NULL OR m.move = 'tail' THEN w.e WHEN m.move = 'go' THEN w.e + 1 ELSE w.e + 2 END,
         m.move IS NULL OR m.move = 'tail',
         CASE WHEN m.move IS NULL OR m.move IN ('tail', 'cut', 'skip') THEN w.b END,
         CASE WHEN m.move IS NULL OR m.move IN ('tail', 'cut', 'skip') THEN w.e END,
         CASE WHEN m.move = 'bounce' THEN w.e + 1 END
  FROM {p}_w w LEFT JOIN {p}_m m ON m."user" = w."user" AND m.seg_id = w.seg_id AND m.pos = w.e
  WHERE NOT w.done)""",
        f'{p}_drifting AS (SELECT "user", seg_id, dr AS pos FROM {p}_w WHERE dr IS NOT NULL)',
        f"""{p}_c AS (
  SELECT r.*, w.cb, w.ce FROM {p}_w w
  JOIN {p}_p r ON r."user" = w."user" AND r.seg_id = w.seg_id AND r.pos BETWEEN w.cb AND w.ce
  LEFT JOIN {p}_drifting x ON x."user" = r."user" AND x.seg_id = r.seg_id AND x.pos = r.pos
  WHERE w.cb IS NOT NULL AND x.pos IS NULL)""",
        f"""{p}_bad AS (
  SELECT "user", seg_id, cb FROM {p}_c GROUP BY "user", seg_id, cb, ce, n
  HAVING max(CASE WHEN pos = ce THEN end_s END) - max(CASE WHEN pos = cb THEN start_s END) < {cluster_s}
         AND count(DISTINCT cid) < 3 {share})""",
        f"""{out} AS (
  SELECT "user", cid, lon, lat, start_s, end_s, stay_s FROM {p}_p WHERE n < 3
  UNION ALL
  SELECT c."user", c.cid, c.lon, c.lat, c.start_s, c.end_s, c.stay_s FROM {p}_c c
  LEFT JOIN {p}_bad x ON x."user" = c."user" AND x.seg_id = c.seg_id AND x.cb = c.cb WHERE x.cb IS NULL)""",
    ]


def _scores(src: str = "stays", p: str = "pp") -> list[str]:
    return _segments(T.PINGPONG_GAP, src, f"{p}_s") + [
        f"""{p}_g AS (
  SELECT *, count(*) OVER (PARTITION BY "user", seg_id) AS n, row_number() OVER (PARTITION BY "user", seg_id ORDER BY {ORDER}) AS pos
  FROM {p}_s)""",
        f'{p}_rep AS (SELECT "user", seg_id FROM {p}_g GROUP BY "user", seg_id HAVING count(*) > count(DISTINCT cid))',
        f'{p}_rows AS (SELECT g.* FROM {p}_g g SEMI JOIN {p}_rep r ON r."user" = g."user" AND r.seg_id = g.seg_id)',
        f"""{p}_cand AS (
  SELECT "user", seg_id, cid, arg_min(lon, pos) AS lon, arg_min(lat, pos) AS lat, min(pos) AS seen, count(*) AS freq, max(n) AS n
  FROM {p}_rows GROUP BY "user", seg_id, cid)""",
        f"""{p}_sum AS (
  SELECT c."user", c.seg_id, c.cid, c.lon, c.lat, c.seen, c.freq, c.n,
         sum(CASE WHEN r.cid <> c.cid THEN {_kmraw('c.lon', 'c.lat', 'r.lon', 'r.lat')} END) AS km
  FROM {p}_cand c JOIN {p}_rows r ON r."user" = c."user" AND r.seg_id = c.seg_id GROUP BY ALL)""",
        f"""{p}_score AS (
  SELECT *, CASE WHEN n = freq THEN NULL WHEN km = 0 THEN 'infinity'::DOUBLE ELSE freq / (km / (n - freq)) END AS score FROM {p}_sum)""",
    ]


def _pingpong(src: str = "stays", out: str = "steady", p: str = "pp") -> list[str]:
    return _scores(src, p) + [
        f"""{p}_best AS (
  SELECT *, row_number() OVER (PARTITION BY "user", seg_id ORDER BY round(score, 9) DESC NULLS FIRST, seen) AS k FROM {p}_score)""",
        f'{p}_users AS (SELECT "user" FROM {src} GROUP BY "user" HAVING count(*) > 1)',
        f"""{out} AS (
  SELECT g."user", g.cid, g.lon, g.lat, g.start_s, g.end_s, g.stay_s FROM {p}_g g
  ANTI JOIN {p}_rep r ON r."user" = g."user" AND r.seg_id = g.seg_id WHERE g."user" IN (SELECT "user" FROM {p}_users)
  UNION ALL
  SELECT b."user", b.cid, b.lon, b.lat, x.s, x.e, x.e - x.s FROM {p}_best b
  JOIN (SELECT "user", seg_id, arg_min(start_s, pos) AS s, arg_max(end_s, pos) AS e FROM {p}_rows GROUP BY 1, 2) x
    ON x."user" = b."user" AND x.seg_id = b.seg_id WHERE b.k = 1)""",
    ]


def _merge(src: str = "stays", out: str = "merged", exact: bool = False) -> list[str]:
    short = "0" if exact else "CASE WHEN run = last_run AND n >= 2 THEN 1 ELSE 0 END"
    return [
        f"""{out}_b AS (
  SELECT *, CASE WHEN lag(end_s) OVER w IS NULL OR cid <> lag(cid) OVER w OR start_s - lag(end_s) OVER w > {T.MERGE_GAP}
         THEN 1 ELSE 0 END AS b, count(*) OVER (PARTITION BY "user") AS total
  FROM {src} WINDOW w AS (PARTITION BY "user" ORDER BY {ORDER}))""",
        f"""{out}_r AS (
  SELECT *, sum(b) OVER (PARTITION BY "user" ORDER BY {ORDER} ROWS UNBOUNDED PRECEDING) AS run FROM {out}_b WHERE total > 1)""",
        f"""{out}_a AS (
  SELECT "user", cid, min(lon) AS lon, min(lat) AS lat, min(start_s) AS start_s, max(end_s) AS end_s, count(*) AS n, run,
         max(run) OVER (PARTITION BY "user") AS last_run FROM {out}_r GROUP BY "user", run, cid)""",
        f"""{out} AS (
  SELECT "user", cid, lon, lat, start_s, end_s, end_s - start_s AS stay_s, n - {short} AS n_records FROM {out}_a)""",
    ]


def _regions(src: str = "merged") -> list[str]:
    return _segments(T.REGION_GAP, src, "rg_s") + [
        f"""rg_p AS (
  SELECT *, row_number() OVER (PARTITION BY "user", seg_id ORDER BY {ORDER}) AS pos,
         count(*) OVER (PARTITION BY "user", seg_id) AS n FROM rg_s)""",
        """rg_l AS (
  SELECT "user", seg_id, max(n) AS n, list(cid ORDER BY pos) AS c, list(cid || ',' || lon || ',' || lat ORDER BY pos) AS k
  FROM rg_p WHERE n >= 3 GROUP BY 1, 2)""",
        # t = 0 while looking for a loop at b; else the stay that may extend the region b..e.
        """rg_w AS (
  SELECT "user", seg_id, n, 1::BIGINT AS b, 3::BIGINT AS e, 0::BIGINT AS t, NULL::BIGINT AS rb, NULL::BIGINT AS re FROM rg_l
  UNION ALL
  SELECT w."user", w.seg_id, w.n,
         CASE WHEN w.t = 0 THEN (CASE WHEN l.c[w.b] = l.c[w.e] THEN w.b ELSE w.b + 1 END)
              WHEN w.t <= w.n AND (hit OR w.t - w.e < 2) THEN w.b ELSE w.e + 1 END,
         CASE WHEN w.t = 0 THEN (CASE WHEN l.c[w.b] = l.c[w.e] THEN w.e ELSE w.e + 1 END)
              WHEN w.t <= w.n AND hit THEN w.t WHEN w.t <= w.n AND w.t - w.e < 2 THEN w.e ELSE w.e + 3 END,
         CASE WHEN w.t = 0 THEN (CASE WHEN l.c[w.b] = l.c[w.e] THEN w.e + 1 ELSE 0 END)
              WHEN w.t <= w.n AND (hit OR w.t - w.e < 2) THEN w.t + 1 ELSE 0 END,
         CASE WHEN w.t > 0 AND NOT (w.t <= w.n AND (hit OR w.t - w.e < 2)) THEN w.b END,
         CASE WHEN w.t > 0 AND NOT (w.t <= w.n AND (hit OR w.t - w.e < 2)) THEN w.e END
  FROM (SELECT w.*, coalesce(w.t > 0 AND w.t <= w.n AND list_contains(l.k[w.b:w.e], l.k[w.t]), false) AS hit
        FROM rg_w w JOIN rg_l l ON l."user" = w."user" AND l.seg_id = w.seg_id WHERE w.t > 0 OR w.e <= w.n) w
  JOIN rg_l l ON l."user" = w."user" AND l.seg_id = w.seg_id)""",
        'rg_r AS (SELECT "user", seg_id, rb, re FROM rg_w WHERE rb IS NOT NULL)',
        """rg_m AS (
  SELECT p.*, coalesce(r.rb, p.pos) AS unit, r.rb IS NOT NULL AS is_region FROM rg_p p
  LEFT JOIN rg_r r ON r."user" = p."user" AND r.seg_id = p.seg_id AND p.pos BETWEEN r.rb AND r.re)""",
        """rg_c AS (
  SELECT "user", seg_id, unit, is_region, cid, lon, lat, sum(n_records)::BIGINT AS n, min(pos) AS seen
  FROM rg_m GROUP BY ALL)""",
        """rg_u AS (
  SELECT "user", seg_id, unit, is_region, arg_min(start_s, pos) AS start_s, arg_max(end_s, pos) AS end_s,
         CASE WHEN is_region THEN arg_max(end_s, pos) - arg_min(start_s, pos) ELSE max(stay_s) END AS stay_s
  FROM rg_m GROUP BY "user", seg_id, unit, is_region)""",
    ]


STAYS = BASE + _stays()
MERGED = STAYS + _merge()
REGIONS = MERGED + _regions()
GRAPH_ROWS = [
    """lines AS (
  SELECT l_partkey AS src, l_suppkey AS dst, l_quantity AS weight, l_orderkey, l_linenumber FROM lineitem)""",
    """arcs AS (
  SELECT src, dst, weight FROM (SELECT *, row_number() OVER (
    PARTITION BY src, dst ORDER BY l_orderkey DESC, l_linenumber DESC, weight DESC) AS k FROM lines) WHERE k = 1)""",
]
GRAPH = GRAPH_ROWS + [
    """und AS (
  SELECT a, b, arg_max(weight, src) AS weight FROM (SELECT least(src, dst) AS a, greatest(src, dst) AS b, * FROM arcs) GROUP BY a, b)""",
    "g AS (SELECT a AS src, b AS dst, weight FROM und UNION SELECT b, a, weight FROM und)",
]
DIRECTED = GRAPH_ROWS + ["g AS (SELECT src, dst, weight FROM arcs)"]
THRESHOLDS = "ts AS (SELECT * FROM (VALUES (0, -1.0), " + ", ".join(f"({i}, {t})" for i, t in enumerate(T.THRESHOLDS, 1)) + ") v(graph, t))"


def _transitions(p: float, q: float) -> str:
    return f"""
w AS (SELECT e.src, e.dst, n.dst AS nbr, n.weight, n.dst = e.src AS back, c.src IS NOT NULL AS known
      FROM g e JOIN g n ON n.src = e.dst LEFT JOIN g c ON c.src = n.dst AND c.dst = e.src),
z AS (SELECT src, dst, sum(CASE WHEN back THEN weight / {p} WHEN known THEN weight ELSE weight / {q} END) AS norm FROM w GROUP BY src, dst)
SELECT w.src, w.dst, w.nbr, round((CASE WHEN back THEN weight / {p} ELSE weight END) / z.norm, 10) AS prob
FROM w JOIN z ON z.src = w.src AND z.dst = w.dst WHERE back OR known
UNION ALL SELECT src, dst, NULL, round(1.0 / {q} / norm, 10) FROM z"""


def _every_step(p: float, q: float) -> str:
    return f"""
w AS (SELECT e.src, e.dst, n.dst AS nbr, CASE WHEN n.dst = e.src THEN n.weight / {p} WHEN c.src IS NOT NULL THEN n.weight ELSE n.weight / {q} END AS mass
      FROM g e JOIN g n ON n.src = e.dst LEFT JOIN g c ON c.src = n.dst AND c.dst = e.src),
y AS (SELECT src, dst, mass / sum(mass) OVER (PARTITION BY src, dst) AS prob FROM w)
SELECT src, dst, count(*) AS n, round(sum(prob * prob), 10) AS squares, round(max(prob), 10) AS largest FROM y GROUP BY src, dst"""


def _u(seed: int) -> str:
    key = f"concat_ws('|', '{seed}', w.graph, w.start, w.walk, w.step, 0, 'move')"
    return f"(('0x' || substr(md5({key}), 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0::DOUBLE)"


def _walks(num: int, length: int, p: float = 1.0, q: float = 1.0, seed: int = 7) -> str:
    """Over graphs gs(graph, src, dst, weight). A biased step takes the neighbour at which the masses, those back first, then of common neighbours, then of
    the others, each by id, pass the drawn part of their sum."""
    start = f"""
ends AS (SELECT DISTINCT graph, unnest([src, dst]) AS start FROM gs),
w AS (
  SELECT graph, start, r.walk, 1 AS step, NULL::BIGINT AS prev, start AS cur FROM ends, (SELECT unnest(range({num})) AS walk) r
  UNION ALL"""
    end = """)
SELECT graph, start, walk, string_agg(cur::VARCHAR, ' ' ORDER BY step) AS path FROM w GROUP BY graph, start, walk"""
    if p == 1 and q == 1:
        return f"""
n1 AS (SELECT *, sum(weight) OVER (PARTITION BY graph, src ORDER BY dst ROWS UNBOUNDED PRECEDING) AS cum,
       sum(weight) OVER (PARTITION BY graph, src) AS total,
       row_number() OVER (PARTITION BY graph, src ORDER BY dst DESC) AS from_last FROM gs),
n2 AS (SELECT graph, src, dst, CASE WHEN from_last = 1 THEN 1.0::DOUBLE ELSE cum / total END AS hi FROM n1),
n3 AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY graph, src ORDER BY dst), 0.0) AS lo FROM n2),{start}
  SELECT w.graph, w.start, w.walk, w.step + 1, w.cur, n3.dst
  FROM (SELECT w.*, {_u(seed)} AS u FROM w WHERE w.step < {length}) w
  JOIN n3 ON n3.graph = w.graph AND n3.src = w.cur AND n3.lo <= w.u AND w.u < n3.hi{end}"""
    common = "k.src IS NOT NULL" if q != 1 else "false"
    return f"""{start}
  SELECT graph, start, walk, step + 1, cur, dst FROM (
    SELECT *, row_number() OVER (PARTITION BY graph, start, walk ORDER BY kind, dst) AS place FROM (
      SELECT *, sum(mass) OVER (PARTITION BY graph, start, walk ORDER BY kind, dst ROWS UNBOUNDED PRECEDING) AS cum,
        sum(mass) OVER (PARTITION BY graph, start, walk) AS total, row_number() OVER (PARTITION BY graph, start, walk ORDER BY kind DESC, dst DESC) AS from_last FROM (
        SELECT w.*, n.dst, CASE WHEN w.prev IS NULL THEN 2 WHEN n.dst = w.prev THEN 0 WHEN {common} THEN 1 ELSE 2 END AS kind,
          n.weight * CASE WHEN w.prev IS NULL THEN 1.0::DOUBLE WHEN n.dst = w.prev THEN {1 / p}::DOUBLE WHEN {common} THEN 1.0::DOUBLE ELSE {1 / q}::DOUBLE END AS mass
        FROM (SELECT w.*, {_u(seed)} AS u FROM w WHERE w.step < {length}) w JOIN gs n ON n.graph = w.graph AND n.src = w.cur
        LEFT JOIN gs k ON k.graph = w.graph AND k.src = n.dst AND k.dst = w.prev))
    WHERE cum > u * total OR from_last = 1)
  WHERE place = 1{end}"""


ONE_GRAPH = "gs AS (SELECT 0 AS graph, src, dst, weight FROM g)"
MANY_GRAPHS = [THRESHOLDS, "gs AS (SELECT ts.graph, g.src, g.dst, g.weight FROM g JOIN ts ON g.weight > ts.t)"]

POIS = """pois AS (
  SELECT o_orderkey::VARCHAR AS location_key, o_orderpriority AS city, o_orderstatus AS district,
         l_suppkey::VARCHAR AS uid, l_linestatus AS tag, 'part ' || l_partkey AS name, l_returnflag AS direction,
         l_quantity::BIGINT::VARCHAR AS distance,
         CASE WHEN l_orderkey IS NULL THEN NULL WHEN l_returnflag = 'R' THEN 'region' ELSE 'poi' END AS source
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
  QUALIFY row_number() OVER (PARTITION BY o_orderkey, l_suppkey ORDER BY l_returnflag = 'R',
                             l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1)"""
DETAILS = """details AS (
  SELECT p_partkey::VARCHAR AS uid, p_name AS name, 110.0::DOUBLE + 0.001::DOUBLE * (p_partkey % 1000) AS lng,
         20.0::DOUBLE + 0.001::DOUBLE * (p_partkey % 777) AS lat, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS city,
         '' AS area, p_type AS tag, CASE WHEN p_size > 25 THEN p_size::VARCHAR ELSE '' END AS overall_rating,
         CASE WHEN p_partkey % 3 = 0 THEN '09:00-17:00' ELSE '' END AS shop_hours, floor(p_retailprice)::BIGINT::VARCHAR AS price,
         CASE WHEN p_partkey % 5 = 0 THEN 'AAA' ELSE '' END AS level, '' AS scope_grade, '' AS telephone, '' AS content_tag
  FROM part WHERE p_size <> 13)"""
SPOTS = """spots AS (
  SELECT c_custkey::VARCHAR AS uid, 110.0::DOUBLE + 0.0011::DOUBLE * (c_custkey % 331) AS lon,
         20.0::DOUBLE + 0.0013::DOUBLE * (c_custkey % 157) AS lat FROM customer)"""
STATIONS = """stations AS (
  SELECT s_suppkey::VARCHAR AS cid, 110.0::DOUBLE + 0.0037::DOUBLE * (s_suppkey % 97) AS lon,
         20.0::DOUBLE + 0.0023::DOUBLE * (s_suppkey % 89) AS lat FROM supplier)"""
KEYED = "printf('%.6f', lat) || ',' || printf('%.6f', lon)"
STAMPED = "strftime(make_timestamp({} * 1000000), '%Y%m%d%H%M%S')"


def _kept(text: str) -> str:
    out = f"url_encode({text})"
    for ch in KEPT:
        quoted = "''" if ch == "'" else ch
        out = f"replace({out}, '%{ord(ch):02X}', '{quoted}')"
    return out


def _signed(ctes: list[str], key: str, source: str, request: str) -> str:
    return _with(ctes + [
        f"q AS (SELECT {key}, {request} AS req FROM {source})",
        f"s AS (SELECT *, md5(replace(url_encode({_kept('req')} || 'secret'), '%20', '+')) AS sn FROM q)",
    ], f"SELECT {key}, sn, {_kept(chr(39) + 'http://example.org' + chr(39) + ' || req || ' + chr(39) + '&sn=' + chr(39) + ' || sn')} AS url FROM s")


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    q["cdr_lines"] = _with([RAW], 'SELECT "user", s, cid FROM raw WHERE cid::BIGINT % 2 = 0')
    q["user_lines"] = _with([RAW], 'SELECT DISTINCT "user" FROM raw')
    q["alias_lines"] = "SELECT n_nationkey::VARCHAR AS cid, (n_nationkey % 12)::VARCHAR AS canon_cid FROM nation"
    q["cell_lines"] = _with([STATIONS], "SELECT cid, 's' || cid AS name, round(lon, 6) AS lon, round(lat, 6) AS lat FROM stations")
    q["adjacency_lines"] = """SELECT n.n_regionkey::VARCHAR AS cid, s.s_suppkey::VARCHAR AS nbr_cid FROM supplier s
JOIN nation n ON n.n_nationkey = s.s_nationkey
JOIN (SELECT n_regionkey, max(n_nationkey) AS k FROM nation SEMI JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1) m ON m.k = n.n_nationkey"""
    q["stay_file_lines"] = _with(MERGED, f"SELECT {OUT}, n_records FROM merged")
    q["stay_file_default_count"] = _with(STAYS, f"SELECT {OUT}, 1::BIGINT AS n_records FROM stays")
    q["edge_lines"] = "SELECT l_partkey AS src, l_suppkey AS dst, l_quantity AS weight FROM lineitem"
    q["location_keys"] = _with([SPOTS], f"SELECT {KEYED} AS location_key FROM spots")

    q["cdr_located"] = _with(BASE, 'SELECT "user", s, cid, round(lon, 6) AS lon, round(lat, 6) AS lat FROM rec')
    q["users_semi"] = _with([RAW], """SELECT "user", s, cid FROM raw
WHERE "user" IN (SELECT user_id::VARCHAR FROM events WHERE event_type = 'error' AND value > 100)""")
    q["alias_join"] = _with([RAW], 'SELECT "user", s, (cid::BIGINT % 12)::VARCHAR AS cid FROM raw')
    q["min_rows"] = _with(BASE, f"""SELECT "user", s, cid, round(lon, 6) AS lon, round(lat, 6) AS lat FROM rec
WHERE "user" IN (SELECT "user" FROM rec GROUP BY 1 HAVING count(*) > {T.MIN_RECORDS})""")
    q["ordered_trace"] = _with(BASE, """SELECT "user", s, cid, round(lon, 6) AS lon, round(lat, 6) AS lat,
row_number() OVER (PARTITION BY "user" ORDER BY s, cid, lon, lat) AS position FROM rec""")
    q["time_sorted"] = _with([RAW], 'SELECT "user", s, cid, TRUE AS in_order FROM raw')

    q["stay_runs"] = _with(STAYS, f"SELECT {OUT} FROM stays")
    q["stay_runs_keep_last"] = _with(BASE + _stays(keep_last=True), f"SELECT {OUT} FROM stays")
    q["segments"] = _with(STAYS + _segments(T.DRIFT["gap_s"], "stays", "sg"), f"SELECT {OUT}, seg_id FROM sg")
    q["drift_removed"] = _with(STAYS + _drift(), f"SELECT {OUT} FROM calm")
    q["drift_adjacent"] = _with(STAYS + _drift(adjacency=True), f"SELECT {OUT} FROM calm")
    q["drift_isolated_rule"] = _with(STAYS + _drift(isolated=0.9), f"SELECT {OUT} FROM calm")
    q["drift_true_share"] = _with(STAYS + _drift(true_share=True), f"SELECT {OUT} FROM calm")
    q["station_scores"] = _with(STAYS + _scores(), 'SELECT "user", seg_id AS group_id, cid, freq, round(score, 6) AS score FROM pp_score')
    q["pingpong_collapsed"] = _with(STAYS + _pingpong(), f"SELECT {OUT} FROM steady")
    q["merge_stays"] = _with(MERGED, f"SELECT {OUT}, n_records FROM merged")
    q["merge_stays_exact"] = _with(STAYS + _merge(exact=True), f"SELECT {OUT}, n_records FROM merged")
    q["residence_points"] = _with(STAYS + [
        f"""rp_b AS (
  SELECT *, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0, count(*) OVER (PARTITION BY "user") AS total
  FROM stays WINDOW w AS (PARTITION BY "user" ORDER BY {ORDER}))""",
        f"""rp_f AS (
  SELECT *, CASE WHEN lon0 IS NULL OR NOT ({_kmraw('lon', 'lat', 'lon0', 'lat0')}) < 0.5 THEN 1 ELSE 0 END AS b
  FROM rp_b WHERE total > 1)""",
        f'rp_r AS (SELECT *, sum(b) OVER (PARTITION BY "user" ORDER BY {ORDER} ROWS UNBOUNDED PRECEDING) AS run FROM rp_f)',
        """rp_q AS (
  SELECT "user", run, max(end_s) - min(start_s) > 3600 AS long FROM rp_r GROUP BY 1, 2)""",
        """rp_n AS (
  SELECT *, CASE WHEN long THEN sum(long::INT) OVER (PARTITION BY "user" ORDER BY run) ELSE -1 END AS residence_id FROM rp_q)""",
    ], f'SELECT {OUT}, residence_id::INT AS residence_id FROM rp_r JOIN rp_n USING ("user", run)')
    cells = "string_agg(cid || ':' || n, ',' ORDER BY seen)"
    q["region_merge"] = _with(REGIONS, f"""SELECT u."user", u.start_s, u.end_s, u.stay_s, u.is_region, c.cells FROM rg_u u
JOIN (SELECT "user", seg_id, unit, {cells} AS cells FROM rg_c GROUP BY 1, 2, 3) c USING ("user", seg_id, unit)""")
    q["region_cells"] = _with(REGIONS, """SELECT "user", u.start_s, u.end_s, u.is_region,
  (row_number() OVER (PARTITION BY "user", seg_id, unit ORDER BY seen) - 1)::INT AS position, cid,
  round(lon, 6) AS lon, round(lat, 6) AS lat, n FROM rg_c c JOIN rg_u u USING ("user", seg_id, unit)""")
    tab = "chr(9)"
    q["region_lines"] = _with(REGIONS, f"""SELECT concat_ws(',', c.c, c.x, c.y, {STAMPED.format('u.start_s')},
  {STAMPED.format('u.end_s')}, u.stay_s, c.n) AS value FROM rg_u u
JOIN (SELECT "user", seg_id, unit, string_agg(cid, {tab} ORDER BY seen) AS c, string_agg(lon::VARCHAR, {tab} ORDER BY seen) AS x,
  string_agg(lat::VARCHAR, {tab} ORDER BY seen) AS y, string_agg(n::VARCHAR, {tab} ORDER BY seen) AS n
  FROM rg_c GROUP BY 1, 2, 3) c USING ("user", seg_id, unit)""")

    def gate(src: str, out: str, n: int) -> str:
        return f'{out} AS (SELECT * FROM {src} WHERE "user" IN (SELECT "user" FROM {src} GROUP BY 1 HAVING count(*) > {n}))'

    c = T.CLEANING
    q["clean_traces"] = _with(
        BASE + ["""listed_rec AS (
  SELECT * FROM rec WHERE "user" IN (SELECT user_id::VARCHAR FROM events WHERE event_type = 'error' AND value > 100))""",
                gate("listed_rec", "enough", c.min_records)]
        + _stays(src="enough", out="runs") + [gate("runs", "runs_1", c.min_runs)]
        + _drift(src="runs_1", adjacency=True) + [gate("calm", "calm_1", c.min_stays)]
        + _pingpong(src="calm_1") + _merge(src="steady") + [gate("merged", "final", c.min_merged)],
        f"SELECT {OUT}, n_records FROM final")
    q["trajectory_lines"] = _with(STAYS, f"""SELECT concat_ws(',', cid, lon, lat, "user", {STAMPED.format('start_s')},
  {STAMPED.format('end_s')}, stay_s) AS value FROM stays""")

    q["graph_undirected"] = _with(GRAPH, "SELECT src, dst, weight FROM g")
    q["graph_directed"] = _with(DIRECTED, "SELECT src, dst, weight FROM g")
    q["graph_unweighted_nodes"] = "SELECT l_partkey AS node FROM lineitem UNION SELECT l_suppkey FROM lineitem"
    q["threshold_edges"] = _with(GRAPH, "SELECT src, dst, weight FROM g WHERE weight > 40")
    q["threshold_graphs"] = _with(GRAPH + MANY_GRAPHS, "SELECT graph, src, dst, weight FROM gs")
    q["weight_quartiles"] = _with(GRAPH, " UNION ALL ".join(
        f"SELECT {p}::DOUBLE AS probability, round(quantile_cont(weight, {p}), 10) AS weight FROM g" for p in (0.25, 0.5, 0.75)))
    q["adjacency"] = _with(GRAPH, """SELECT src AS node, block, string_agg(dst || ':' || weight::BIGINT, ',' ORDER BY dst) AS nbrs
FROM (SELECT *, ((row_number() OVER (PARTITION BY src ORDER BY dst) - 1) // 1024)::INT AS block FROM g) GROUP BY src, block""")
    q["node_transitions"] = _with(GRAPH, """SELECT src, dst, weight, round(weight / sum(weight) OVER (PARTITION BY src), 10) AS prob FROM g""")
    q["edge_transitions"] = _with(GRAPH, "").rstrip() + "," + _transitions(0.5, 2.0)
    q["step_probabilities"] = _with(GRAPH, "").rstrip() + "," + _every_step(0.5, 2.0)
    q["edge_transitions_directed"] = _with(DIRECTED, "").rstrip() + "," + _transitions(0.25, 4.0)
    q["walks_first_order"] = _with(GRAPH + [ONE_GRAPH], "").rstrip() + "," + _walks(2, 20)
    q["walks_default"] = _with(GRAPH + [ONE_GRAPH], "").rstrip() + "," + _walks(10, 80, seed=11)
    q["walks_second_order"] = _with(GRAPH + [ONE_GRAPH], "").rstrip() + "," + _walks(1, 10, 0.5, 2.0)
    q["walks_directed"] = _with(DIRECTED + [ONE_GRAPH], "").rstrip() + "," + _walks(2, 10, 2.0, 0.5, seed=3)
    q["walks_thresholds"] = _with(GRAPH + MANY_GRAPHS, "").rstrip() + "," + _walks(1, 10)
    for name, size in (("embeddings", 32), ("embed_graph", 128)):
        q[name] = _with(GRAPH, f"SELECT DISTINCT unnest([src, dst]) AS node, {size} AS dimensions, true AS finite, true AS nonzero, true AS neighbours_closer FROM g")
    q["location_keys_exact"] = """SELECT c_custkey, printf('%.6f', ((c_custkey * 104729 % 400000) * 10 + 5)::DOUBLE / 1e7::DOUBLE - 0.02::DOUBLE) || ',' ||
printf('%.6f', 110.0::DOUBLE + (c_custkey * 7919 % 20000000)::DOUBLE / 1e7::DOUBLE) AS location_key FROM customer"""
    q["embedding_lines"] = """SELECT vec_id || ' ' || array_to_string(list_transform(embedding, lambda x: printf('%.6f', x::DOUBLE)), ' ') AS value
FROM embeddings UNION ALL SELECT count(*) || ' ' || max(len(embedding)) FROM embeddings"""

    q["poi_flatten"] = _with([POIS], "SELECT location_key, city, district, uid, tag, name, direction, distance, source FROM pois")
    q["poi_descriptions"] = _with([POIS], """SELECT location_key, uid, concat_ws(',', tag, name, direction, distance) AS description
FROM pois WHERE uid IS NOT NULL""")
    q["poi_distinct"] = "SELECT DISTINCT l_suppkey::VARCHAR AS uid FROM lineitem SEMI JOIN orders ON o_orderkey = l_orderkey"
    cols = ", ".join(f"round({c}, 6) AS {c}" if c in ("lng", "lat") else c for c in DETAIL_COLUMNS)
    q["place_details"] = _with([DETAILS], f"SELECT {cols} FROM details")
    cols = ", ".join(f"printf('%.6f', {c})" if c in ("lng", "lat") else c for c in DETAIL_COLUMNS)
    q["place_detail_lines"] = _with([DETAILS], f"SELECT concat_ws(chr(9), {cols}) AS value FROM details")
    q["pois_within"] = _with([STATIONS, SPOTS, f"""m AS (
  SELECT s.cid, p.uid, round(({_km4('s.lon', 's.lat', 'p.lon', 'p.lat')}) * 1000, 1) AS distance_m FROM stations s, spots p)"""],
        "SELECT cid, uid, distance_m FROM m WHERE distance_m <= 400")
    q["signed_requests"] = _signed([], "item_id", "benchmark",
                                   "'/place/v2/detail?uid=' || text || '&output=json&scope=2&ak=key'")
    q["signed_locations"] = _signed([SPOTS], "uid", "spots",
                                    f"'/geocoder/v2/?location=' || {KEYED} || '&output=json&pois=1&radius=100&latest_admin=1&ak=key'")
    q["user_meetings"] = _with(STAYS, """SELECT least(a."user", b."user") AS src, greatest(a."user", b."user") AS dst, count(*) AS weight
FROM stays a JOIN stays b ON a.cid = b.cid AND a."user" < b."user" AND least(a.end_s, b.end_s) >= greatest(a.start_s, b.start_s)
GROUP BY 1, 2""")
    q["user_meetings_gap"] = _with(STAYS, """SELECT least(a."user", b."user") AS src, greatest(a."user", b."user") AS dst, count(*) AS weight
FROM stays a JOIN stays b ON a.cid = b.cid AND a."user" < b."user" AND greatest(a.start_s, b.start_s) - CASE WHEN (a.start_s, a."user") < (b.start_s, b."user") THEN a.end_s ELSE b.end_s END <= 172800
GROUP BY 1, 2""")
    q["corpus_order"] = _with(GRAPH + MANY_GRAPHS + ["""starts AS (
  SELECT graph, start, walk, ('0x' || substr(md5(concat_ws('|', '7', graph, walk, start, 'order')), 1, 13))::UBIGINT AS u
  FROM (SELECT DISTINCT graph, unnest([src, dst]) AS start FROM gs), (SELECT unnest(range(10)) AS walk))"""],
        "SELECT graph, start, walk, row_number() OVER (ORDER BY graph, walk, u, start) - 1 AS position FROM starts")
    q["stored_responses"] = q["place_details"]
    return q
