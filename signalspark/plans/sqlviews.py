"""The test views of ``views.py`` as ANSI SQL common table expressions."""

from __future__ import annotations

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (needs, body.strip())


def with_views(body: str, *names: str) -> str:
    """``body`` prefixed by the named views and everything they need."""
    done: list[str] = []

    def visit(n: str) -> None:
        if n in done:
            return
        for dep in CTES[n][0]:
            visit(dep)
        done.append(n)

    for n in names:
        visit(n)
    if not done:
        return body
    # a body may start with a comma and go on with expressions of its own
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in done) + "\n" + body.strip()


cte("bus_o", """
SELECT l_suppkey, CAST(l_quantity AS INT) AS q, CAST(ROUND(l_discount*100) AS INT) AS d, l_returnflag,
  l_extendedprice, l_linenumber, l_orderkey,
  ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS rn
FROM lineitem""")

cte("bus_w", """
SELECT *,
  CAST(SUM(q) OVER (PARTITION BY l_suppkey ORDER BY rn ROWS BETWEEN 31 PRECEDING AND CURRENT ROW) AS BIGINT)*10 AS raw,
  CAST(SUM(d-5) OVER (PARTITION BY l_suppkey ORDER BY rn ROWS BETWEEN 31 PRECEDING AND CURRENT ROW) AS BIGINT) AS sg
FROM bus_o""", "bus_o")

cte("fl_b", """
SELECT CAST(l_suppkey % 5 AS VARCHAR) AS session_id, 256+l_suppkey AS arb_id, rn, raw,
  (rn-1)*CAST(0.02 AS DOUBLE) AS t,
  CAST((rn-1)%256 AS INT) AS b0, CAST(raw//256 AS INT) AS b1, CAST(raw%256 AS INT) AS b2, 85 AS b3,
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS b4,
  CAST((sg+65536)%256 AS INT) AS b5, CAST(((sg+65536)%65536)//256 AS INT) AS b6
FROM bus_w""", "bus_w")

cte("fl", """
SELECT *, [b0,b1,b2,b3,b4,b5,b6,b7] AS p,
  LOWER(printf('%02x%02x%02x%02x%02x%02x%02x%02x',b0,b1,b2,b3,b4,b5,b6,b7)) AS hx
FROM (SELECT *, (b0+b1+b2+b3+b4+b5+b6)%256 AS b7 FROM fl_b)""", "fl_b")

cte("refs_l", """
SELECT session_id, 'ref_' || arb_id AS name, t + CAST(-0.7 AS DOUBLE) AS t, raw*CAST(0.01 AS DOUBLE) AS v FROM fl""", "fl")

cte("fmux", """
SELECT CAST(l_suppkey % 5 AS VARCHAR) AS session_id, 256+l_suppkey AS arb_id, rn,
  (rn-1)*CAST(0.02 AS DOUBLE) AS t, [CAST(rn%3 AS INT), CAST((rn%3)*80+q AS INT), q, d] AS p
FROM bus_w""", "bus_w")

cte("series_e", """
SELECT CAST(user_id AS VARCHAR) AS session_id, event_type AS name, epoch_us(ts)/CAST(1e6 AS DOUBLE) AS t, value AS v, event_id
FROM events""")

cte("fe0", """
SELECT user_id, event_id, epoch_us(ts)/CAST(1e6 AS DOUBLE) AS t, CAST(round(value*100) AS INT) AS vi,
  CAST(json_extract_string(props,'$.k') AS INT) AS k FROM events""")

cte("fe", """
SELECT CAST(user_id%7 AS VARCHAR) AS session_id, user_id+256 AS arb_id, t,
  [CAST(event_id%256 AS INT), CAST((vi//256)%256 AS INT), CAST(vi%256 AS INT), k] AS p,
  printf('%02x%02x%02x%02x', CAST(event_id%256 AS INT), CAST((vi//256)%256 AS INT), CAST(vi%256 AS INT), k) AS hx,
  CASE WHEN event_id%10=0 THEN 'tx' ELSE 'rx' END AS direction, event_id AS rn, (user_id%2=1) AS is_extended
FROM fe0""", "fe0")

cte("sens", """
SELECT CAST(user_id%7 AS VARCHAR) AS session_id, event_id, event_type, t, k,
  ((vi%71)-35)/CAST(100 AS DOUBLE) AS acc_x, ((vi%53)-26)/CAST(100 AS DOUBLE) AS acc_y, ((vi%37)-18)/CAST(100 AS DOUBLE) AS acc_z,
  ((k%41)-20)/CAST(50 AS DOUBLE) AS rot_z,
  CASE WHEN event_id%20=0 THEN -1.0::DOUBLE ELSE (vi%4000)/CAST(100 AS DOUBLE) END AS speed
FROM (SELECT f.*, event_type FROM fe0 f JOIN events USING (event_id))""", "fe0")

cte("samp", """
SELECT session_id, arb_id*10000000+rn AS pos, CASE arb_id%4 WHEN 0 THEN 'vehicle_speed' WHEN 1 THEN 'engine_rpm' WHEN 2 THEN '' ELSE 'SOC' END AS name,
  printf('0x%02X', arb_id%256) AS pid, t, CASE WHEN (rn-1)%50=0 THEN 'n/a' ELSE CAST(raw AS VARCHAR) END AS value,
  CASE arb_id%4 WHEN 0 THEN 'km/h' WHEN 1 THEN 'rpm' END AS unit, arb_id, raw
FROM fl""", "fl")

cte("lab", """
SELECT session_id, event_id, t, event_type AS field, event_type AS name, CASE WHEN event_id%17=0 THEN NULL ELSE speed END AS value,
  CAST(event_id%2 AS INT) AS state, CASE WHEN event_id%13=0 THEN NULL ELSE CAST(k%7 AS DOUBLE) END AS gear FROM sens""", "sens")

cte("carhw", """
SELECT session_id, event_id, t, ['energy','mileage','speed','model','compass'][CAST(event_id%5+1 AS INT)] AS kind,
  ['success','unavailable','unimplemented','error'][CAST((event_id//5)%4+1 AS INT)] AS status,
  CASE WHEN event_id%5=0 THEN k::DOUBLE END AS battery_percent, CASE WHEN event_id%10=5 THEN (k+2)::DOUBLE END AS fuel_percent, CASE WHEN event_id%5=1 THEN event_id::DOUBLE END AS odometer_meters,
  CASE WHEN event_id%5=2 THEN (k+1)::DOUBLE END AS raw_mps, CASE WHEN event_id%5=2 THEN k+2.5::DOUBLE END AS display_mps FROM sens""", "sens")

cte("motl", "SELECT session_id, (rn-1)//5 AS step, MIN(t) AS t, AVG(raw)*CAST(0.01 AS DOUBLE) AS v FROM fl GROUP BY session_id, (rn-1)//5", "fl")
cte("espd", "SELECT session_id, t, v FROM motl WHERE step%10<>0", "motl")
cte("gspd", """
SELECT session_id, t+CAST(-0.7 AS DOUBLE) AS t, CASE WHEN step%20=0 THEN NULL ELSE v/CAST(3.6 AS DOUBLE)*CAST(3.6 AS DOUBLE) END AS v FROM motl""", "motl")
cte("prior_n", """
SELECT session_id, COALESCE(MAX_BY(o, pos) FILTER (role='companion'),0) - COALESCE(MAX_BY(o, pos) FILTER (role='edge'),0) AS prior FROM (
 SELECT CAST(n_nationkey%5 AS VARCHAR) AS session_id, n_nationkey AS pos, CASE WHEN n_nationkey%2=0 THEN 'edge' ELSE 'companion' END AS role, (n_nationkey%3)*CAST(0.1 AS DOUBLE) AS o FROM nation) GROUP BY 1""")


def resample_sql(src: str, grid: str, keys: str, grid_keys: str, hz: str, gap: str, order: str = "t") -> str:
    """Linear interpolation of ``src(keys, t, v)`` on ``grid(grid_keys, t0, n_grid)``."""
    return f"""SELECT {keys}, gi, vp + (g-tp)/(t-tp)*(v-vp) AS v FROM (
  SELECT iv.*, t0, i AS gi, t0+i/({hz}) AS g FROM (
    SELECT {keys}, t, v, LAG(t) OVER w AS tp, LAG(v) OVER w AS vp, LAG(t,2) OVER w AS tpp FROM {src} WINDOW w AS (PARTITION BY {keys} ORDER BY {order})) iv
  JOIN {grid} USING ({grid_keys}), LATERAL (SELECT UNNEST(range(GREATEST(CAST(FLOOR((tp-t0)*({hz})) AS BIGINT)-2,0), LEAST(CAST(FLOOR((t-t0)*({hz})) AS BIGINT)+3, n_grid))) AS i)
  WHERE tp IS NOT NULL AND t-tp <= {gap})
WHERE g<=t AND (g>tp OR (tpp IS NULL AND g>=tp)) AND v IS NOT NULL AND vp IS NOT NULL"""


PEARSON = """CASE WHEN COUNT(*)>=3 AND STDDEV_POP({x})>=1e-12 AND STDDEV_POP({y})>=1e-12 THEN COVAR_POP({x},{y})/(STDDEV_POP({x})*STDDEV_POP({y})) ELSE 0 END"""


def pearson_sql(x: str, y: str) -> str:
    return PEARSON.format(x=x, y=y)
