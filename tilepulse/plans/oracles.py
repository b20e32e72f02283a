"""DuckDB SQL with the answers of the registered queries.

Written apart from the Spark code: the state machine numbers a device's lives
instead of looking up the latest activation, tiles are made by direct division at
every zoom, and joins compare all pairs.
"""

from __future__ import annotations

from . import queries as q

_ROW18 = "((dev * 104729 + 7) % 294912)"
_COL18 = "((dev * 1299709 + 11 + dev // 294912) % 589824)"
_SIZE18 = "(2e1 / 32768)"

CMDS = """cmds AS (
  SELECT event_id, ts, user_id AS dev,
    CASE event_type WHEN 'signup' THEN 'create' WHEN 'view' THEN 'ping' WHEN 'click' THEN 'happy'
      WHEN 'error' THEN 'sad' WHEN 'purchase' THEN 'delete' END AS action
  FROM events)"""

FLEET = (
    CMDS
    + """, fleet AS (
  SELECT -2 * c_custkey - 2 AS event_id, TIMESTAMP '2023-01-01' AS ts, c_custkey AS dev,
    'create' AS action FROM customer
  UNION ALL
  SELECT -2 * c_custkey - 1, TIMESTAMP '2023-01-01', c_custkey, 'sad' FROM customer
  WHERE c_acctbal < 0
  UNION ALL SELECT event_id, ts, dev, action FROM cmds)"""
)


def _life(source: str, own: str = "") -> str:
    """The state machine over a table of commands; ``own`` prefixes all names."""
    return f"""{own}h0 AS (
  SELECT *, coalesce(sum((action = 'delete')::INT) OVER (PARTITION BY dev ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS life FROM {source}),
{own}h1 AS (
  SELECT *, sum((action IN ('create', 'ping'))::INT) OVER (PARTITION BY dev, life
    ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n_act FROM {own}h0),
{own}h2 AS (
  SELECT *, CASE WHEN action IN ('create', 'ping') AND n_act = 1 THEN 'H'
    WHEN action = 'happy' AND n_act > 0 THEN 'H' WHEN action = 'sad' AND n_act > 0 THEN 'S'
    END AS mark FROM {own}h1),
{own}h3 AS (
  SELECT *, CASE WHEN action = 'delete' OR n_act = 0 THEN 'I' ELSE last_value(mark IGNORE NULLS)
    OVER (PARTITION BY dev, life ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) END AS state
  FROM {own}h2),
{own}h AS (
  SELECT *, lag(state, 1, 'I') OVER (PARTITION BY dev ORDER BY ts, event_id) AS prev
  FROM {own}h3),
{own}ev AS (
  SELECT *, {_ROW18} AS r18, {_COL18} AS c18,
    CASE prev || state WHEN 'IH' THEN 'DeviceActivated' WHEN 'HI' THEN 'DeviceDeactivatedHappy'
      WHEN 'SI' THEN 'DeviceDeactivatedSad' WHEN 'SH' THEN 'DeviceMadeHappy'
      WHEN 'HS' THEN 'DeviceMadeSad' END AS event_type,
    (state <> 'I')::INT - (prev <> 'I')::INT AS dd,
    (state = 'H')::INT - (prev = 'H')::INT AS hd,
    (state = 'S')::INT - (prev = 'S')::INT AS sd
  FROM {own}h WHERE prev <> state)"""


def _tiles(events: str = "ev", name: str = "tiles") -> str:
    return f"""{name} AS (
  SELECT z::INT AS zoom, (r18 // (1 << (18 - z)))::INT AS r, (c18 // (1 << (18 - z)))::INT AS c,
    sum(dd)::BIGINT AS device_count, sum(hd)::BIGINT AS happy_count, sum(sd)::BIGINT AS sad_count
  FROM {events}, range(3, 19) t(z) GROUP BY ALL)"""


EV = CMDS + ", " + _life("cmds")
FLEET_EV = FLEET + ", " + _life("fleet")
TILES = FLEET_EV + ", " + _tiles()
COUNTS = "device_count, happy_count, sad_count"


def _edges(zoom: str = "zoom", row: str = "r", col: str = "c") -> str:
    size = f"(2e1 / (1 << ({zoom} - 3)))"
    return (
        f"9e1 - {row} * {size} AS top_left_lat, -18e1 + {col} * {size} AS top_left_lng, "
        f"9e1 - ({row} + 1) * {size} AS bot_right_lat, "
        f"-18e1 + ({col} + 1) * {size} AS bot_right_lng"
    )


def _shown(source: str = "tiles") -> str:
    return f"SELECT zoom, {_edges()}, {COUNTS} FROM {source}"


PLACED = f"placed AS (SELECT *, {_edges()} FROM tiles)"
_KEY = (
    "printf('%d:%.13f:%.13f:%.13f:%.13f', 18, "
    f"9e1 - {_ROW18} * {_SIZE18}, -18e1 + {_COL18} * {_SIZE18}, "
    f"9e1 - ({_ROW18} + 1) * {_SIZE18}, -18e1 + ({_COL18} + 1) * {_SIZE18})"
)


def _hash(key: str) -> str:
    return (
        "(SELECT CASE WHEN v >= 2147483648 THEN v - 4294967296 ELSE v END FROM (SELECT "
        f"list_reduce(list_transform(string_split({key}, ''), lambda ch: ord(ch)::BIGINT), "
        "lambda a, b: (a * 31 + b) % 4294967296) AS v))"
    )


def _tag(key: str) -> str:
    return f"(abs({_hash(key)}) % {q.TAG_COUNT})::VARCHAR"


JOURNAL = (
    EV
    + f""", keyed AS (SELECT *, {_KEY} AS persistence_id FROM ev),
journal AS (
  SELECT 1099511627775 + row_number() OVER (ORDER BY ts, event_id) AS ordering, persistence_id,
    row_number() OVER (PARTITION BY dev ORDER BY ts, event_id)::BIGINT AS sequence_number, epoch_us(ts)::BIGINT AS write_timestamp,
    event_type, {_tag("persistence_id")} AS tag, dd, hd, sd, ts, event_id FROM keyed)"""
)

_BROKEN = f"""bad AS (
  SELECT event_id, CASE WHEN event_id % 50 = 3 THEN 'Create' ELSE action END AS action,
    CASE WHEN event_id % 50 = 0 THEN 19 ELSE 18 END AS zoom,
    9e1 - ({_ROW18} + CASE WHEN event_id % 50 = 1 THEN 1 ELSE 0 END) * {_SIZE18} AS top_left_lat,
    CASE event_id % 50 WHEN 0 THEN 'zoom_range' WHEN 1 THEN 'lat_order' WHEN 2 THEN 'lng_order'
      WHEN 3 THEN 'unknown_action' END AS reject_reason
  FROM cmds)"""


def _at_zoom(zoom: str, key: str = "s_suppkey", table: str = "supplier") -> str:
    """Tile of an id at a zoom that may depend on the id."""
    row, col = _ROW18.replace("dev", key), _COL18.replace("dev", key)
    return (
        f"SELECT *, ({zoom})::INT AS zoom, ({row} >> (18 - ({zoom})))::INT AS r, "
        f"({col} >> (18 - ({zoom})))::INT AS c FROM {table}"
    )


def _areas(height: float, width: float, zoom: int) -> str:
    top = f"(9e1 - {_ROW18} * {_SIZE18})".replace("dev", "s_suppkey")
    left = f"(-18e1 + {_COL18} * {_SIZE18})".replace("dev", "s_suppkey")
    return f"""areas AS (
  SELECT s_suppkey AS area_id, {zoom} AS zoom, least({top} + {height}::DOUBLE, 9e1) AS top_left_lat,
    greatest({left} - {width}::DOUBLE, -18e1) AS top_left_lng,
    greatest({top} - {height}::DOUBLE, -9e1) AS bot_right_lat,
    least({left} + {width}::DOUBLE, 18e1) AS bot_right_lng FROM supplier)"""


AREAS = _areas(q.HALF_HEIGHT, q.HALF_WIDTH, 8)
_OVERLAP = (
    "a.bot_right_lat < b.top_left_lat AND a.top_left_lat > b.bot_right_lat "
    "AND a.bot_right_lng > b.top_left_lng AND a.top_left_lng < b.bot_right_lng"
)
_WITHIN = (
    "b.top_left_lat <= a.top_left_lat AND b.bot_right_lat >= a.bot_right_lat "
    "AND b.top_left_lng >= a.top_left_lng AND b.bot_right_lng <= a.bot_right_lng"
)


def _grid_lines(zoom: int) -> str:
    """All rows and columns of a zoom with their edges."""
    rows, cols = [(1, 1), (1, 2), (3, 6)][zoom] if zoom < 3 else (9 << (zoom - 3), 18 << (zoom - 3))
    high, wide = f"(18e1 / {rows})", f"(36e1 / {cols})"
    return f"""rows_{zoom} AS (SELECT r::INT AS r, 9e1 - r * {high} AS top, 9e1 - (r + 1) * {high} AS bot
  FROM range(0, {rows}) t(r)),
cols_{zoom} AS (SELECT c::INT AS c, -18e1 + c * {wide} AS lft, -18e1 + (c + 1) * {wide} AS rgt
  FROM range(0, {cols}) t(c))"""


def _cover(areas: str, zoom: int) -> str:
    return (
        f"FROM {areas} a JOIN rows_{zoom} y ON y.bot < a.top_left_lat AND y.top > a.bot_right_lat "
        f"JOIN cols_{zoom} x ON x.rgt > a.top_left_lng AND x.lft < a.bot_right_lng"
    )


def _in_view(view, source: str = "placed") -> str:
    zoom, top, left, bot, right = view
    return (
        f"FROM {source} WHERE zoom = {zoom} AND top_left_lat <= {top}::DOUBLE "
        f"AND top_left_lng >= {left}::DOUBLE AND bot_right_lat >= {bot}::DOUBLE "
        f"AND bot_right_lng <= {right}::DOUBLE AND device_count > 0"
    )


def _lookup() -> list[str]:
    return [f"zoom = {z} AND r = {r} AND c = {c}" for z, r, c in q.lookup_keys()]


_SUMS = (
    "coalesce(sum(device_count), 0)::BIGINT AS device_count, "
    "coalesce(sum(happy_count), 0)::BIGINT AS happy_count, "
    "coalesce(sum(sad_count), 0)::BIGINT AS sad_count"
)
_DELTA_SUMS = (
    "sum(dd)::BIGINT AS device_count, sum(hd)::BIGINT AS happy_count, sum(sd)::BIGINT AS sad_count"
)

_TRAVERSE = " UNION ALL ".join(
    f"SELECT a.*, {z}::INT AS z, y.*, x.* {_cover('areas', z)}" for z in range(0, 19)
)

# A tile's path from the world down, as digits; its devices' keys begin with it.
_TREE = " UNION ALL ".join(
    f"SELECT area_id, {z}::INT AS z, r, c, top_left_lat >= top AND bot_right_lat <= bot "
    f"AND top_left_lng <= lft AND bot_right_lng >= rgt AS whole {_cover('areas', z)}"
    for z in range(q.TREE_ZOOM + 1)
)
_TREE_KEY = (
    "(CASE WHEN z = 0 THEN 0 WHEN z = 1 THEN c WHEN z = 2 THEN c // 3 * 9 + r * 3 + c % 3 "
    "ELSE ((c >> (z - 3)) // 9 * 9 + (r >> (z - 3)) // 3 * 3 + (c >> (z - 3)) // 3 % 3) * 9 "
    "+ (r >> (z - 3)) % 3 * 3 + (c >> (z - 3)) % 3 END)::BIGINT"
)
_TREE_STEPS = (
    "coalesce(list_sum([((((r >> (z - 3 - k)) & 1) * 2 + ((c >> (z - 3 - k)) & 1))::BIGINT "
    "<< (2 * (15 - k))) FOR k IN range(1, z - 2)]), 0)::BIGINT"
)
_TREE_WIDTH = (
    "(CASE z WHEN 0 THEN 162 WHEN 1 THEN 81 WHEN 2 THEN 9 ELSE 1 END * (1::BIGINT << 30) "
    "// (CASE WHEN z > 3 THEN 1::BIGINT << (2 * (z - 3)) ELSE 1 END))::BIGINT"
)

_SAMPLES = f"""steps AS (
  SELECT epoch_us(ts) // {q.STEP_SECONDS * 1_000_000} AS step, sum(dd)::BIGINT AS dd,
    sum(hd)::BIGINT AS hd, sum(sd)::BIGINT AS sd FROM ev GROUP BY 1),
dense AS (
  SELECT t.step, coalesce(s.dd, 0) AS dd, coalesce(s.hd, 0) AS hd, coalesce(s.sd, 0) AS sd
  FROM (SELECT unnest(generate_series(min(step), max(step))) AS step FROM steps) t
  LEFT JOIN steps s USING (step)),
running AS (
  SELECT step, sum(dd) OVER w AS device_count, sum(hd) OVER w AS happy_count,
    sum(sd) OVER w AS sad_count, row_number() OVER w AS nth,
    row_number() OVER (ORDER BY step DESC) AS age
  FROM dense WINDOW w AS (ORDER BY step ROWS UNBOUNDED PRECEDING)),
changes AS (
  SELECT *, coalesce(device_count - lag(device_count) OVER w, 0) AS device_delta,
    coalesce(happy_count - lag(happy_count) OVER w, 0) AS happy_delta,
    coalesce(sad_count - lag(sad_count) OVER w, 0) AS sad_delta
  FROM running WINDOW w AS (ORDER BY step)),
samples AS (
  SELECT (step * {q.STEP_SECONDS})::BIGINT AS sample_epoch, device_count::BIGINT AS device_count,
    happy_count::BIGINT AS happy_count, sad_count::BIGINT AS sad_count,
    device_delta::BIGINT AS device_delta, happy_delta::BIGINT AS happy_delta,
    sad_delta::BIGINT AS sad_delta FROM changes WHERE age <= 180)"""

_USER_KEY = f"{_KEY} AS device_key"
_RECT18 = f"18 AS zoom, {_edges('18', _ROW18, _COL18)}"
_FIRST = _tiles("(SELECT * FROM ev WHERE event_id < 0)", "first_tiles")


# Customers' tiles with the events' own tiles written over them.
_REPLACED = f"""WITH {FLEET_EV}, {_FIRST}, {_life("cmds", "own_")}, {_tiles("own_ev", "own_tiles")}
SELECT zoom, {_edges()}, {COUNTS} FROM (
  SELECT zoom, r, c, coalesce(n.device_count, o.device_count) AS device_count,
    coalesce(n.happy_count, o.happy_count) AS happy_count,
    coalesce(n.sad_count, o.sad_count) AS sad_count
  FROM first_tiles o FULL JOIN own_tiles n USING (zoom, r, c))"""


def _bound(delta: str, sign: int) -> str:
    """Axis bound by trying the units one after the other."""
    unit = f"{sign} * min(u)"
    fits = f"(SELECT {unit} FROM (SELECT 10 ** k AS u FROM range(1, 15) t(k)) WHERE {delta} * {sign} <= 10 * u)"
    return f"(floor({delta} / {fits}) * {fits} + {fits})::BIGINT"


def _stateful_sql(source: str) -> str:
    return f"""SELECT {_RECT18}, state FROM (
  SELECT dev, arg_max(state, (ts, event_id)) AS state FROM {source} GROUP BY dev)"""


_DEVICE_EVENTS = f"WITH {EV} SELECT event_id, {_USER_KEY}, event_type FROM ev"
_SUMMARY = f"WITH {EV}, {_tiles()} {_shown()}"
_EVENT_DELTAS = (
    f"WITH {EV} SELECT event_type, count(*) AS event_total, {_DELTA_SUMS} FROM ev GROUP BY event_type"
)
_DUE = f"""due AS (
  SELECT j.*, p.current_offset FROM journal j JOIN (
    SELECT tag, (min(ordering) + max(ordering)) // 2 AS current_offset FROM journal GROUP BY tag) p
    USING (tag)
  WHERE j.ordering > p.current_offset)"""
_DUE_SUMS = f"tag, count(*) AS event_total, {_DELTA_SUMS}"

_OVERLAPS = f"""WITH {TILES}, {PLACED}, {AREAS}
SELECT area_id, b.zoom, r AS "row", c AS "col" FROM areas a JOIN placed b ON {_OVERLAP}"""

_POINTS = f"""WITH {AREAS}, p AS (
  SELECT dev AS point_id, 9e1 - ({_ROW18} + 0.5::DOUBLE) * {_SIZE18} AS lat,
    -18e1 + ({_COL18} + 0.5::DOUBLE) * {_SIZE18} AS lng FROM (SELECT o_orderkey AS dev FROM orders))
SELECT point_id, area_id FROM p JOIN areas ON lat BETWEEN bot_right_lat AND top_left_lat
AND lng BETWEEN top_left_lng AND bot_right_lng"""

SQL: dict[str, str] = {
    "telemetry_scan": f"WITH {CMDS} SELECT event_id, action, {_RECT18} FROM cmds",
    "telemetry_rejects": f"""WITH {CMDS}, {_BROKEN}
SELECT event_id, reject_reason FROM bad WHERE reject_reason IS NOT NULL""",
    "telemetry_acks": f"""WITH {CMDS}, {_BROKEN}
SELECT event_id, CASE reject_reason
    WHEN 'zoom_range' THEN 'The zoom has to lie between 0 and 18.'
    WHEN 'lat_order' THEN 'The northern edge has to lie north of the southern one.'
    WHEN 'lng_order' THEN 'The western edge has to lie west of the eastern one.'
    WHEN 'unknown_action' THEN 'Action ''' || action
      || ''' is unknown; known are create, ping, delete, happy and sad.'
    ELSE 'Accepted' END AS message,
  CASE WHEN reject_reason IS NULL THEN 200 WHEN reject_reason = 'unknown_action' THEN 500
    ELSE 400 END AS http_status_code, action, zoom, top_left_lat FROM bad""",
    "selection_scan": f"""WITH s AS ({_at_zoom("13")})
SELECT s_suppkey, ['create', 'delete', 'happy', 'sad'][1 + s_suppkey % 4] AS action,
  (100 * (1 + s_suppkey % 10))::INT AS rate, zoom, {_edges()} FROM s""",
    "selection_acks": f"""WITH s AS ({_at_zoom("13")})
SELECT s_suppkey, 'Accepted' AS message, 200 AS http_status_code,
  ['create', 'delete', 'happy', 'sad'][1 + s_suppkey % 4] AS action,
  (100 * (1 + s_suppkey % 10))::INT AS rate, -18e1 + (c + 1) * (2e1 / 1024) AS bot_right_lng FROM s""",
    "event_journal": f"""WITH {JOURNAL}
SELECT ordering, persistence_id, sequence_number, write_timestamp, event_type, tag FROM journal""",
    "event_journal_two_loads": f"""WITH {JOURNAL}, loads AS (
  SELECT *, CASE WHEN ts < TIMESTAMP '{q.SPLIT_TIME}' THEN 1 ELSE 2 END AS load FROM journal)
SELECT load * 1099511627776 + row_number() OVER (PARTITION BY load ORDER BY ts, event_id) - 1 AS ordering,
  persistence_id, sequence_number, write_timestamp, event_type, tag FROM loads""",
    "events_by_tag": f"""WITH {JOURNAL} SELECT ordering, persistence_id, event_type FROM journal
WHERE tag = '{q.TAG}' AND ordering > {q.TAG_OFFSET}""",
    "stream_events_by_tag": f"""WITH {JOURNAL} SELECT ordering, persistence_id, event_type FROM journal
WHERE tag = '{q.TAG}' AND ordering > {q.TAG_OFFSET}""",
    "journal_tag_join": f"WITH {JOURNAL} SELECT ordering, sequence_number, event_type, tag FROM journal",
    "tile_summary_scan": f"WITH {TILES} {_shown()}",
    "tile_upsert_additive": f"WITH {TILES} {_shown()}",
    "tile_upsert_replace": _REPLACED,
    "tile_replace_stored": _REPLACED,
    "tile_bulk_load": f"WITH {TILES} {_shown()}",
    "assign_tile": f"""WITH p AS ({_at_zoom("12", "o_orderkey", "orders")})
SELECT o_orderkey AS point_id, zoom, r AS "row", c AS "col" FROM p""",
    "assign_all_zooms": f"""SELECT dev AS c_custkey, z::INT AS zoom, ({_ROW18} // (1 << (18 - z)))::INT AS "row",
  ({_COL18} // (1 << (18 - z)))::INT AS "col"
FROM (SELECT c_custkey AS dev FROM customer), range(3, 19) t(z)""",
    "assign_by_centre": f"""WITH {AREAS}, {_grid_lines(9)}, mid AS (
  SELECT area_id, top_left_lat - (top_left_lat - bot_right_lat) / 2 AS lat,
    top_left_lng + (bot_right_lng - top_left_lng) / 2 AS lng FROM areas)
SELECT area_id, 9 AS zoom, min(r) AS "row", min(c) AS "col" FROM mid
JOIN rows_9 ON lat BETWEEN bot AND top JOIN cols_9 ON lng BETWEEN lft AND rgt GROUP BY area_id""",
    "device_key_counts": f"""WITH {CMDS} SELECT {_USER_KEY}, count(*) AS command_count FROM cmds GROUP BY 1""",
    "device_key_decode": f"""WITH {TILES}
SELECT {_USER_KEY}, {_RECT18}, {COUNTS} FROM (SELECT DISTINCT dev FROM cmds)
JOIN (SELECT r, c, {COUNTS} FROM tiles WHERE zoom = 18) ON r = {_ROW18} AND c = {_COL18}""",
    "expand_children": f"""WITH s AS ({_at_zoom("3 + s_suppkey % 16")})
SELECT s_suppkey, zoom + 1 AS zoom, (r * 2 + i)::INT AS "row", (c * 2 + j)::INT AS "col"
FROM s, range(0, 2) a(i), range(0, 2) b(j) WHERE zoom < 18
UNION ALL SELECT -1, 1, 0, j FROM range(0, 2) b(j)
UNION ALL SELECT -2 - c, 2, i, c * 3 + j FROM range(0, 2) t(c), range(0, 3) a(i), range(0, 3) b(j)
UNION ALL SELECT -4 - 6 * r - c, 3, r * 3 + i, c * 3 + j
FROM range(0, 3) u(r), range(0, 6) t(c), range(0, 3) a(i), range(0, 3) b(j)""",
    "expand_to_devices": f"""WITH s AS ({_at_zoom("14")})
SELECT s_suppkey, 18 AS zoom, (r * 16 + i)::INT AS "row", (c * 16 + j)::INT AS "col"
FROM s, range(0, 16) a(i), range(0, 16) b(j)""",
    "selection_commands": f"""WITH s AS ({_at_zoom("14")}), cmds AS (
  SELECT s_suppkey AS event_id, s_suppkey AS ts, (r * 16 + i) * 589824 + c * 16 + j AS dev,
    ['create', 'delete', 'happy', 'sad'][1 + s_suppkey % 4] AS action
  FROM s, range(0, 16) a(i), range(0, 16) b(j)),
{_life("cmds").replace(_ROW18, "dev // 589824").replace(_COL18, "dev % 589824")}, {_tiles()} {_shown()}""",
    "cover_area": f"""WITH {AREAS}, {_grid_lines(8)},
grid_areas AS (SELECT * FROM ({_areas(q.GRID_HEIGHT, q.GRID_WIDTH, 8).removeprefix("areas AS ")})),
mid AS (
  SELECT area_id, top_left_lat - (top_left_lat - bot_right_lat) / 2 AS lat,
    top_left_lng + (bot_right_lng - top_left_lng) / 2 AS lng FROM grid_areas)
SELECT area_id, false AS aligned, 8 AS zoom, y.r AS "row", x.c AS "col" {_cover("areas", 8)}
UNION ALL
SELECT area_id, true, 8, min(r), min(c) FROM mid
JOIN rows_8 ON lat BETWEEN bot AND top JOIN cols_8 ON lng BETWEEN lft AND rgt GROUP BY area_id""",
    "neighbour_tiles": f"""WITH {TILES}
SELECT t.zoom, t.r AS "row", t.c AS "col", t.device_count, t.happy_count, t.sad_count,
  n.device_count AS next_device_count, n.happy_count AS next_happy_count,
  n.sad_count AS next_sad_count, d.direction
FROM tiles t, (VALUES ('right', 0, 1), ('below', 1, 0)) d(direction, dr, dc)
JOIN tiles n ON n.zoom = t.zoom AND n.r = t.r + dr AND n.c = t.c + dc""",
    "zoom_levels": f"""WITH {TILES}, lv AS (
  SELECT z::INT AS zoom, CASE WHEN z < 2 THEN 18e1 WHEN z = 2 THEN 6e1 ELSE 2e1 / 2 ** (z - 3) END
    AS lat_degrees, CASE WHEN z = 0 THEN 36e1 WHEN z = 1 THEN 18e1 WHEN z = 2 THEN 6e1
    ELSE 2e1 / 2 ** (z - 3) END AS lng_degrees FROM range(0, 19) t(z))
SELECT lv.*, (180 / lat_degrees * 360 / lng_degrees)::BIGINT AS tile_count,
  ((lat_degrees / {_SIZE18}) * (lng_degrees / {_SIZE18}))::BIGINT AS max_devices,
  tile_total, device_total
FROM lv LEFT JOIN (SELECT zoom, count(*) AS tile_total, sum(device_count)::BIGINT AS device_total
  FROM tiles GROUP BY zoom) USING (zoom)""",
    "selection_traversal": f"""WITH {_areas(q.TRAVERSED_HEIGHT, q.TRAVERSED_WIDTH, 8)},
{", ".join(_grid_lines(z) for z in range(0, 19))},
hit AS ({_TRAVERSE})
SELECT area_id, z AS zoom, r AS "row", c AS "col",
  CASE WHEN top_left_lat >= top AND bot_right_lat <= bot AND top_left_lng <= lft
    AND bot_right_lng >= rgt THEN 'full' ELSE 'partial' END AS overlap,
  least(top_left_lat, top) AS trim_top_lat, greatest(top_left_lng, lft) AS trim_left_lng,
  greatest(bot_right_lat, bot) AS trim_bot_lat, least(bot_right_lng, rgt) AS trim_right_lng
FROM hit""",
    "selection_tree": f"""WITH {_areas(q.TREE_HEIGHT, q.TREE_WIDTH, 8)},
{", ".join(_grid_lines(z) for z in range(q.TREE_ZOOM + 1))},
hit AS ({_TREE}),
node AS (
  SELECT * FROM hit h WHERE (whole OR z = {q.TREE_ZOOM}) AND NOT EXISTS (
    SELECT 1 FROM hit p WHERE p.whole AND p.area_id = h.area_id AND p.z = h.z - 1
      AND p.r = h.r // CASE h.z WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 3 ELSE 2 END
      AND p.c = h.c // CASE h.z WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 3 ELSE 2 END)),
keyed AS (
  SELECT *, {_TREE_KEY} * CASE WHEN z < 3 THEN {_TREE_WIDTH} ELSE 1::BIGINT << 30 END
    + CASE WHEN z > 3 THEN {_TREE_STEPS} ELSE 0 END AS first_key FROM node)
SELECT area_id, z AS zoom, r AS "row", c AS "col", CASE WHEN whole THEN 'full' ELSE 'partial' END
  AS overlap, first_key, first_key + {_TREE_WIDTH} - 1 AS last_key FROM keyed""",
    "selection_totals": f"""WITH {TILES}, {PLACED}, {_areas(q.TREE_HEIGHT, q.TREE_WIDTH, 8)}
SELECT area_id, {", ".join(f"sum({n})::BIGINT AS {n}" for n in COUNTS.split(", "))}
FROM placed b JOIN areas a ON {_OVERLAP} WHERE b.zoom = 18 GROUP BY area_id""",
    "viewport_tiles": f"""WITH {TILES}, {PLACED}
SELECT zoom, top_left_lat, top_left_lng, bot_right_lat, bot_right_lng, {COUNTS} {_in_view(q.VIEW)}""",
    "viewport_join": f"""WITH {TILES}, {PLACED}, {_areas(q.HALF_HEIGHT, q.HALF_WIDTH, 10)}
SELECT area_id, b.zoom, r AS "row", c AS "col", {COUNTS} FROM areas a JOIN placed b
ON b.zoom = a.zoom AND device_count > 0 AND {_WITHIN}""",
    "non_empty_tiles": f"WITH {TILES} {_shown()} WHERE device_count > 0",
    "tiles_or_lookup": f"WITH {TILES} {_shown()} WHERE {' OR '.join(f'({k})' for k in _lookup())}",
    "only_devices": f"""WITH s AS ({_at_zoom("15 + s_suppkey % 4")})
SELECT s_suppkey, zoom, {_edges()} FROM s WHERE zoom = 18""",
    "cover_semi_join": f"""WITH {TILES}, {PLACED}, {AREAS}
SELECT zoom, top_left_lat, top_left_lng, bot_right_lat, bot_right_lng, {COUNTS} FROM placed b
WHERE zoom = 6 AND EXISTS (SELECT 1 FROM areas a WHERE {_OVERLAP})""",
    "overlap_join": _OVERLAPS,
    "overlap_join_large": _OVERLAPS,
    "contains_join": f"""WITH {TILES}, {PLACED}, {AREAS}
SELECT area_id, b.zoom, r AS "row", c AS "col" FROM areas a JOIN placed b ON {_WITHIN}""",
    "points_in_regions": _POINTS,
    "points_in_regions_large": _POINTS,
    "event_deltas": _EVENT_DELTAS,
    "summary_zoom": f"WITH {TILES} {_shown()} WHERE zoom = 12",
    "summary_all_zooms": f"WITH {TILES} {_shown()}",
    "summary_rollup": _SUMMARY,
    "summary_sharded": f"""WITH {TILES}, keyed AS (
  SELECT *, printf('%d:%.13f:%.13f:%.13f:%.13f', 12, 9e1 - r * (2e1 / 512), -18e1 + c * (2e1 / 512),
    9e1 - (r + 1) * (2e1 / 512), -18e1 + (c + 1) * (2e1 / 512)) AS k FROM tiles WHERE zoom = 12)
SELECT zoom, r AS "row", c AS "col", {COUNTS},
  ((({_hash("k")} % {q.SHARDS}) + {q.SHARDS}) % {q.SHARDS})::INT AS shard FROM keyed""",
    "tag_histogram": f"""WITH {FLEET}, keyed AS (
  SELECT {_KEY} AS k FROM (SELECT DISTINCT dev FROM fleet)),
used AS (SELECT {_tag("k")} AS tag, count(*) AS device_total FROM keyed GROUP BY 1)
SELECT i::VARCHAR AS tag, coalesce(device_total, 0) AS device_total
FROM range(0, {q.TAG_COUNT}) t(i) LEFT JOIN used ON tag = i::VARCHAR""",
    "world_totals": f"WITH {TILES} SELECT {_SUMS} FROM tiles WHERE zoom = 3",
    "view_totals": f"WITH {TILES}, {PLACED} SELECT {_SUMS} {_in_view(q.VIEW)}",
    "cell_counts": f"""WITH {TILES}, {PLACED}, cells AS (
  SELECT s_suppkey, {_edges()} FROM ({_at_zoom(str(q.CELL_ZOOM))})),
seen AS (SELECT * {_in_view(q.PAGE_VIEW)})
SELECT s_suppkey, {_SUMS} FROM cells a JOIN seen b ON {_OVERLAP} GROUP BY s_suppkey""",
    "per_zoom_counts": f"""WITH {TILES}
SELECT zoom, count(*) AS tile_total, sum(device_count)::BIGINT AS device_total FROM tiles GROUP BY zoom""",
    "fill_region": f"""WITH s AS ({_at_zoom("13 + s_suppkey % 4")}), devices AS (
  SELECT DISTINCT r * (1 << (18 - zoom)) + i AS r18, c * (1 << (18 - zoom)) + j AS c18
  FROM s, range(0, 32) a(i), range(0, 32) b(j)
  WHERE i < (1 << (18 - zoom)) AND j < (1 << (18 - zoom))),
filled AS (SELECT r18, c18, 1 AS dd, 1 AS hd, 0 AS sd FROM devices), {_tiles("filled")} {_shown()}""",
    "query_response": f"""WITH {TILES}, {PLACED},
seen AS (SELECT * {_in_view(q.PAGE_VIEW)}),
total AS (SELECT {_SUMS} FROM tiles WHERE zoom = 3),
pages AS (
  SELECT DISTINCT r >> 4 AS page_row, c >> 4 AS page_col FROM seen UNION
  SELECT min(r) >> 4, min(c) >> 4 FROM (
    SELECT r, c FROM range(0, 144) y(r), range(0, 288) x(c)
    WHERE 9e1 - r * 1.25::DOUBLE <= {q.PAGE_VIEW.top_left_lat}::DOUBLE
      AND -18e1 + c * 1.25::DOUBLE >= {q.PAGE_VIEW.top_left_lng}::DOUBLE)
  HAVING (SELECT count(*) FROM seen) = 0)
SELECT page_row::INT AS page_row, page_col::INT AS page_col, t.device_count, t.happy_count, t.sad_count,
  s.zoom, s.top_left_lat, s.top_left_lng, s.bot_right_lat, s.bot_right_lng,
  s.device_count AS tile_device_count, s.happy_count AS tile_happy_count,
  s.sad_count AS tile_sad_count
FROM pages CROSS JOIN total t LEFT JOIN seen s ON r >> 4 = page_row AND c >> 4 = page_col""",
    "device_events": _DEVICE_EVENTS,
    "device_events_resumed": _DEVICE_EVENTS,
    "command_outcomes": f"""WITH {CMDS}, {_life("cmds")}
SELECT action, prev <> state AS effective, count(*) AS command_count FROM h GROUP BY 1, 2""",
    "device_state": f"WITH {EV} {_stateful_sql('h')}",
    "replay_state": f"WITH {EV} {_stateful_sql('ev')}",
    "activity_monitor": f"WITH {EV}, {_SAMPLES} SELECT * FROM samples",
    "activity_scale": f"""WITH {EV}, {_SAMPLES}, e AS (
  SELECT min(least(device_delta, happy_delta, sad_delta)) AS lo,
    max(greatest(device_delta, happy_delta, sad_delta)) AS hi FROM samples)
SELECT lo AS min_delta, hi AS max_delta, {_bound("lo", -1)} AS scale_neg,
  {_bound("hi", 1)} AS scale_pos FROM e""",
    "mood_classes": f"""WITH {TILES}
SELECT zoom, CASE WHEN sad_count = 0 THEN 'happy' WHEN happy_count = 0 THEN 'sad' ELSE 'mixed' END
  AS mood, count(*) AS tile_total FROM tiles WHERE device_count > 0 GROUP BY 1, 2""",
    "tile_density": f"""WITH {TILES}
SELECT zoom, r AS "row", c AS "col", device_count, device_count / 4.0::DOUBLE ** (18 - zoom) AS fill_ratio,
  device_count * 2 < 4 ** (18 - zoom) AS partial FROM tiles""",
    "selection_cost": f"""WITH s AS ({_at_zoom("6 + s_suppkey % 7")})
SELECT s_suppkey, zoom, (100 * (1 + s_suppkey % 10))::INT AS rate,
  (4 ** (18 - zoom))::BIGINT AS device_total,
  floor(4 ** (18 - zoom) / (100 * (1 + s_suppkey % 10)) + 0.5)::BIGINT AS duration_sec,
  zoom >= 8 AS allowed FROM s""",
    "tiles_union_lookup": f"WITH {TILES} "
    + " UNION ALL ".join(f"{_shown()} WHERE {k}" for k in [*_lookup(), _lookup()[0]]),
    "incremental_projection": f"""WITH {JOURNAL}, {_DUE}
SELECT p.tag, event_total, {COUNTS}, p.current_offset FROM (
  SELECT tag, max(ordering) AS current_offset FROM journal GROUP BY tag) p
LEFT JOIN (SELECT {_DUE_SUMS} FROM due GROUP BY tag) USING (tag)""",
    "incremental_two_loads": f"WITH {TILES} {_shown()}",
    "incremental_many_loads": f"WITH {TILES} {_shown()}",
    "paused_projections": f"""WITH {JOURNAL}, {_DUE}
SELECT {_DUE_SUMS} FROM due WHERE tag::INT % 2 = 0 GROUP BY tag""",
    "stream_device_events": _DEVICE_EVENTS,
    "stream_device_state": f"WITH {EV} {_stateful_sql('ev')}",
    "stream_into_journal": f"""WITH {JOURNAL}
SELECT persistence_id, sequence_number, write_timestamp, event_type, tag FROM journal""",
    "stream_grouped": _EVENT_DELTAS,
    "stream_tile_summary": _SUMMARY,
    "stream_two_projections": _SUMMARY,
    "stream_tile_counts": _SUMMARY,
    "stream_activity": f"WITH {EV}, {_SAMPLES} SELECT * FROM samples",
}
