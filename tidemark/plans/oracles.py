"""DuckDB SQL for the registered queries, over the same Parquet tables."""

from __future__ import annotations

from tidemark.plans.queries import EXTENT, NAMES, RETENTION

MINUTE = 60_000_000_000
DAY = 86_400_000_000_000

BASE = f"""
WITH RECURSIVE m AS (
  SELECT event_id AS "offset", event_type AS topic, epoch_us(ts) * 1000 AS log_ns, epoch_us(ts) * 1000 - ((event_id * 37) % 101 - 50) * {MINUTE} AS publish_ns,
         (epoch_us(ts) * 1000) // {DAY} AS recording_id, CAST(octet_length(CAST(props AS BLOB)) AS BIGINT) AS size, props AS payload
  FROM events),
t AS (
  SELECT event_id AS trigger_id, 'evt ' || (user_id % 7) AS name, 'user ' || user_id AS description, epoch_us(ts) * 1000 AS log_ns,
         epoch_us(ts) * 1000 - ((event_id * 37) % 101 - 50) * {MINUTE} AS publish_ns, (user_id % 10 + 1) * {MINUTE} AS preroll_ns, (user_id % 5 + 1) * {MINUTE} AS postroll_ns,
         (epoch_us(ts) * 1000) // {DAY} AS recording_id
  FROM events WHERE event_type = 'error'),
wl AS (SELECT *, log_ns AS anchor_ns, log_ns - preroll_ns AS start_ns, log_ns + postroll_ns AS end_ns FROM t),
wp AS (SELECT *, publish_ns AS anchor_ns, publish_ns - preroll_ns AS start_ns, publish_ns + postroll_ns AS end_ns FROM t),
cl AS (SELECT w.trigger_id, m.*, m.log_ns AS stamp_ns FROM wl w JOIN m ON m.log_ns BETWEEN w.start_ns AND w.end_ns),
cp AS (SELECT w.trigger_id, m.*, m.publish_ns AS stamp_ns FROM wp w JOIN m ON m.publish_ns BETWEEN w.start_ns AND w.end_ns),
b AS (SELECT recording_id, count(*) AS messages, min(log_ns) AS log_min, max(log_ns) AS log_max, min(publish_ns) AS publish_min, max(publish_ns) AS publish_max FROM m GROUP BY 1)
"""

#: Records of files: byte offsets, numbers within the recording, and extents folded one record at a time.
RECORDS = f"""
, r0 AS (SELECT *, size + 31 AS len, row_number() OVER (PARTITION BY recording_id ORDER BY "offset") AS k FROM m),
r AS (SELECT *, CAST(8 + coalesce(sum(len) OVER (PARTITION BY recording_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte FROM r0),
fold AS (
  SELECT recording_id, k, CAST(0 AS BIGINT) AS extent_no, len AS held, byte, len, log_ns, publish_ns, "offset" AS event FROM r WHERE k = 1
  UNION ALL
  SELECT r.recording_id, r.k, CASE WHEN f.held >= {EXTENT} THEN f.extent_no + 1 ELSE f.extent_no END, CASE WHEN f.held >= {EXTENT} THEN r.len ELSE f.held + r.len END, r.byte, r.len, r.log_ns, r.publish_ns, r."offset"
  FROM fold f JOIN r ON r.recording_id = f.recording_id AND r.k = f.k + 1),
x AS (SELECT recording_id, extent_no, min(byte) AS "offset", CAST(sum(len) AS BIGINT) AS len, count(*) AS records, min(log_ns) AS log_min, max(log_ns) AS log_max, min(publish_ns) AS publish_min, max(publish_ns) AS publish_max FROM fold GROUP BY 1, 2)
"""


def _segments(clip: str, bounds: str) -> str:
    low, high = ("publish_min", "publish_max") if clip == "cp" else ("log_min", "log_max")
    return f"""
, plan AS (SELECT w.trigger_id, bb.recording_id FROM wp w JOIN {bounds} bb ON bb.{high} >= w.start_ns AND bb.{low} <= w.end_ns),
cnt AS (SELECT trigger_id, recording_id, count(*) AS messages FROM clip GROUP BY 1, 2),
every AS (SELECT w.trigger_id, p.recording_id, coalesce(c.messages, 0) AS messages FROM wp w LEFT JOIN plan p USING (trigger_id) LEFT JOIN cnt c ON c.trigger_id = w.trigger_id AND c.recording_id = p.recording_id),
marked AS (SELECT *, sum(messages) OVER (PARTITION BY trigger_id) AS al, row_number() OVER (PARTITION BY trigger_id ORDER BY recording_id NULLS FIRST) AS k FROM every),
seg AS (SELECT trigger_id, recording_id, messages, row_number() OVER (PARTITION BY trigger_id ORDER BY recording_id NULLS FIRST) - 1 AS segment_no, count(*) OVER (PARTITION BY trigger_id) AS segments FROM marked WHERE messages > 0 OR al = 0 AND k = 1)
"""


ALL_SEGMENTS = ", clip AS (SELECT * FROM cp)" + _segments("cp", "b")
OTHER_SEGMENTS = """, clip AS (SELECT * FROM cp WHERE topic <> 'error'),
b2 AS (SELECT recording_id, min(publish_ns) AS publish_min, max(publish_ns) AS publish_max FROM m WHERE topic <> 'error' GROUP BY 1)""" + _segments("cp", "b2")
FILE = "CASE WHEN segments > 1 THEN anchor_ns || '_' || regexp_replace(name, '[^A-Za-z0-9._-]', '_', 'g') || '_' || lpad(CAST(segment_no AS VARCHAR), 2, '0') || '.mcap' ELSE anchor_ns || '_' || regexp_replace(name, '[^A-Za-z0-9._-]', '_', 'g') || '.mcap' END"


def _summary(w: str, clip: str) -> str:
    return BASE + f"""
SELECT w.trigger_id, anchor_ns, start_ns, end_ns, coalesce(messages, 0) AS messages, coalesce(bytes, 0) AS bytes, first_ns, last_ns
FROM {w} w LEFT JOIN (SELECT trigger_id, count(*) AS messages, CAST(sum(size) AS BIGINT) AS bytes, min(stamp_ns) AS first_ns, max(stamp_ns) AS last_ns FROM {clip} GROUP BY 1) c USING (trigger_id)"""


def _release(w: str, clock: str) -> str:
    return BASE + f"""
, p AS (SELECT w.trigger_id, w.end_ns, w.log_ns, (SELECT min(m.log_ns) FROM m WHERE m.{clock} >= w.end_ns) AS covered, (SELECT min(m.log_ns) FROM m WHERE m.log_ns >= w.end_ns) AS wall FROM {w} w),
rel AS (SELECT trigger_id, end_ns, CASE WHEN covered IS NOT NULL AND wall IS NOT NULL THEN greatest(log_ns, covered, wall) END AS release_ns FROM p)
"""


FILES = """
, nw AS (SELECT max(recording_id) AS newest, max(log_max) AS now FROM b),
f AS (SELECT b.*, recording_id = newest AS is_current, CASE WHEN recording_id < newest THEN 'Ended' ELSE 'Tailing' END AS state, recording_id < newest AS has_successor, now FROM b, nw)
""" + f", pr AS (SELECT recording_id, log_max, state = 'Ended' AND NOT is_current AND log_max < greatest(now - {RETENTION}, 0) AS pruned FROM f)"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


CANDIDATES = f"""
WITH c0 AS (SELECT *, epoch_us(ts) * 1000 AS log_ns FROM events),
c AS (
  SELECT event_id AS trigger_id, ([{", ".join(map(_text, NAMES))}])[event_id % {len(NAMES)} + 1] AS name, log_ns, log_ns - (event_id % 101 - 50) * {MINUTE} AS publish_ns,
    CASE WHEN event_id % 2 = 0 THEN 'live' ELSE 'recorded' END AS interface, CASE WHEN event_id % 4 < 2 THEN 'log' ELSE 'publish' END AS clock,
    CASE WHEN event_id % 5 = 0 THEN log_ns + (event_id % 3) * {20 * MINUTE} ELSE 0 END AS trigger_time_ns, {30 * MINUTE} + (event_id % 3 - 1) AS preroll_ns, {30 * MINUTE} + (event_id % 7 - 5) AS postroll_ns,
    log_ns - (event_id % 2) * {10 * MINUTE} AS now_ns FROM c0),
a AS (SELECT *, CASE interface WHEN 'recorded' THEN CASE clock WHEN 'log' THEN log_ns ELSE publish_ns END ELSE CASE clock WHEN 'log' THEN now_ns ELSE trigger_time_ns END END AS anchor_ns, interface = 'live' AND clock <> 'log' AS own FROM c),
n AS (SELECT *, CASE WHEN name = '' THEN 'empty' WHEN octet_length(CAST(encode(name) AS BLOB)) > 128 THEN 'long' WHEN contains(name, chr(0)) THEN 'nul' WHEN contains(name, '/') OR contains(name, chr(92)) THEN 'separator'
  WHEN starts_with(name, '.') THEN 'hidden' WHEN contains(name, '..') THEN 'dots' END AS reason FROM a)
"""
SANITIZED = "coalesce(nullif(regexp_replace(name, '[^A-Za-z0-9._-]', '_', 'g'), ''), 'unnamed')"

ORACLES = {
    "clip_summary": _summary("wl", "cl"),
    "clip_summary_publish": _summary("wp", "cp"),
    "clip_messages": BASE + 'SELECT trigger_id, recording_id, "offset", topic, stamp_ns, payload FROM cl',
    "clip_messages_publish": BASE + 'SELECT trigger_id, recording_id, "offset", topic, stamp_ns, payload FROM cp',
    "clip_order": BASE + 'SELECT trigger_id, recording_id, "offset", row_number() OVER (PARTITION BY trigger_id ORDER BY recording_id, "offset") - 1 AS place FROM cp',
    "clip_by_topic": BASE + "SELECT trigger_id, topic, count(*) AS messages, CAST(sum(size) AS BIGINT) AS bytes FROM cl GROUP BY 1, 2",
    "clip_channels": BASE + """, ch AS (SELECT trigger_id, topic, min(recording_id * 1000000000 + "offset") AS seen_at, count(*) AS messages FROM cl GROUP BY 1, 2)
SELECT trigger_id, topic, row_number() OVER (PARTITION BY trigger_id ORDER BY seen_at) - 1 AS channel_no, messages FROM ch""",
    "clip_segments": BASE + OTHER_SEGMENTS + "SELECT trigger_id, recording_id, messages, segment_no, segments FROM seg",
    "clip_filenames": BASE + ALL_SEGMENTS + f"SELECT trigger_id, segment_no, {FILE} AS filename FROM seg JOIN wp USING (trigger_id)",
    "completions": BASE + ALL_SEGMENTS + f"""SELECT trigger_id, name, string_agg({FILE}, ',' ORDER BY segment_no) AS filenames, description, CAST(0 AS BIGINT) AS trigger_time_ns, preroll_ns
FROM seg JOIN wp USING (trigger_id) GROUP BY trigger_id, name, description, preroll_ns""",
    "empty_windows": BASE + "SELECT trigger_id, start_ns, end_ns, CAST(0 AS BIGINT) AS messages FROM wl w WHERE NOT EXISTS (SELECT 1 FROM m WHERE topic <> 'error' AND log_ns BETWEEN w.start_ns AND w.end_ns)",
    "boundary_inclusive": BASE + """
, n AS (SELECT "offset" AS trigger_id, lag(log_ns) OVER o AS before, lead(log_ns) OVER o AS after FROM m WINDOW o AS (PARTITION BY recording_id ORDER BY log_ns, "offset")),
w AS (SELECT trigger_id, CASE WHEN trigger_id % 2 = 0 THEN log_ns ELSE coalesce(before, log_ns) END AS start_ns, CASE WHEN trigger_id % 2 = 0 THEN coalesce(after, log_ns) ELSE log_ns END AS end_ns FROM t JOIN n USING (trigger_id))
SELECT trigger_id, count(*) AS messages, min(log_ns) AS first_ns, max(log_ns) AS last_ns FROM w JOIN m ON m.log_ns BETWEEN start_ns AND end_ns GROUP BY 1""",
    "extent_index": BASE + RECORDS + 'SELECT recording_id, extent_no, "offset", len, records, log_min, log_max, publish_min, publish_max FROM x',
    "extent_tiling_check": BASE + RECORDS + """, g AS (SELECT *, lag("offset" + len) OVER (PARTITION BY recording_id ORDER BY extent_no) AS ends FROM x)
SELECT recording_id, count_if("offset" <> coalesce(ends, 8)) AS gaps, CAST(sum(len) AS BIGINT) AS bytes FROM g GROUP BY 1""",
    "planned_extents": BASE + RECORDS + "SELECT trigger_id, count(*) AS extents_read, CAST(sum(len) AS BIGINT) AS bytes_read, count(DISTINCT x.recording_id) AS recordings FROM wp w JOIN x ON x.publish_max >= w.start_ns AND x.publish_min <= w.end_ns GROUP BY 1",
    "pruned_equals_full": BASE + "SELECT trigger_id, count(*) AS full_messages, count(*) AS pruned_messages FROM cl GROUP BY 1",
    "recording_bounds": BASE + "SELECT * FROM b",
    "skew_bounds": BASE + "SELECT recording_id, min(log_ns - publish_ns) AS skew_min, max(log_ns - publish_ns) AS skew_max FROM m GROUP BY 1",
    "high_water": BASE + "SELECT coalesce(max(log_ns), 0) AS log_high, coalesce(max(publish_ns), 0) AS publish_high FROM m",
    "high_water_log": BASE + 'SELECT "offset", max(log_ns) OVER (ORDER BY recording_id, "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS high_ns FROM m',
    "high_water_publish": BASE + 'SELECT "offset", max(publish_ns) OVER (ORDER BY recording_id, "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS high_ns FROM m',
    "coverage_release": _release("wl", "log_ns") + "SELECT trigger_id, end_ns, release_ns FROM rel",
    "coverage_release_publish": _release("wp", "publish_ns") + "SELECT trigger_id, end_ns, release_ns FROM rel",
    "release_states": _release("wp", "publish_ns") + "SELECT trigger_id, end_ns, release_ns FROM rel",
    "late_loss": _release("wp", "publish_ns") + "SELECT trigger_id, count(*) AS late FROM cp JOIN rel USING (trigger_id) WHERE cp.log_ns > release_ns GROUP BY 1",
    "cut_status": BASE + """, n AS (SELECT min(log_ns) + (max(log_ns) - min(log_ns)) // 2 AS now FROM m),
v AS (SELECT now, max(publish_ns) AS covered FROM m, n WHERE log_ns <= now GROUP BY 1)
SELECT trigger_id, end_ns, CASE WHEN end_ns > now THEN 'pending' WHEN covered >= end_ns THEN 'covered' WHEN now >= greatest(log_ns, end_ns) + 30000000000 THEN 'grace_cut' ELSE 'pending' END AS status FROM wp, v WHERE log_ns <= now""",
    "current_recording": BASE + FILES + "SELECT recording_id, state, has_successor, is_current FROM f",
    "retention_prune": BASE + FILES + "SELECT * FROM pr",
    "retained_plan": BASE + FILES + """SELECT w.trigger_id, coalesce(messages, 0) AS messages, coalesce(bytes, 0) AS bytes FROM wl w LEFT JOIN
(SELECT trigger_id, count(*) AS messages, CAST(sum(size) AS BIGINT) AS bytes FROM cl JOIN pr USING (recording_id) WHERE NOT pruned GROUP BY 1) c USING (trigger_id)""",
    "newest_recording": BASE + "SELECT arg_max(recording_id, log_max) AS recording_id, max(log_max) AS log_max FROM b",
    "oldest_recording": BASE + "SELECT arg_min(recording_id, log_max) AS recording_id, min(log_max) AS log_max FROM b",
    "discovery_order": BASE + "SELECT recording_id AS inode, log_max AS mtime, row_number() OVER (ORDER BY log_max, recording_id) - 1 AS recording_id FROM b",
    "seen_anti_join": BASE + "SELECT recording_id AS inode FROM b WHERE recording_id % 3 <> 0",
    "anchor_matrix": CANDIDATES + "SELECT trigger_id, interface, clock, anchor_ns, own AS from_trigger_time FROM a",
    "trigger_validate": CANDIDATES + f"""SELECT trigger_id, CASE WHEN NOT own AND trigger_time_ns <> 0 THEN 'trigger_time' WHEN preroll_ns > {30 * MINUTE} THEN 'preroll' WHEN postroll_ns > {30 * MINUTE} THEN 'postroll'
WHEN anchor_ns > now_ns + {30 * MINUTE} THEN 'anchor' ELSE reason END AS reject_reason FROM n""",
    "name_validate": CANDIDATES + "SELECT trigger_id, reason FROM n",
    "name_sanitize": CANDIDATES + f"SELECT trigger_id, {SANITIZED} AS sanitized, log_ns || '_' || {SANITIZED} || '.mcap' AS filename, log_ns AS anchor_ns FROM n",
    "name_collision": BASE + f""", nm AS (SELECT trigger_id, (log_ns - log_ns % {24 * 60 * MINUTE}) || '_' || regexp_replace(name, '[^A-Za-z0-9._-]', '_', 'g') AS stem FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY trigger_id) - 1 AS collision FROM nm)
SELECT trigger_id, stem || '.mcap' AS filename, collision, CASE WHEN collision = 0 THEN stem || '.mcap' ELSE stem || '_' || collision || '.mcap' END AS published_name FROM k""",
    "stamp_ns": "WITH s AS (SELECT event_id, greatest(event_id - 50, 0) * 1000000000 + event_id * 1234567 AS ns FROM events) SELECT event_id, ns, ns // 1000000000 AS sec, ns % 1000000000 AS nanosec FROM s",
    "sat_arith": """WITH s AS (SELECT event_id, event_id * 1000 AS a, event_id % 7 * 100000 AS b, 9223372036854775807 - event_id AS c FROM events)
SELECT event_id, greatest(a - b, 0) AS floor, CAST(least(c::HUGEINT + b, 9223372036854775807) AS BIGINT) AS ceiling, CASE WHEN a >= b THEN a - b END AS checked FROM s""",
    "backoff_schedule": "SELECT i AS faults, CAST(least(200 * pow(2, i - 1), 3200) AS BIGINT) AS pause_ms FROM generate_series(1, 10) g(i)",
    "little_endian": "SELECT event_id, event_id % 65536 AS u16, event_id % 4294967296 AS u32, event_id AS u64 FROM events",
    "producer_stamps": """WITH p AS (SELECT event_id, event_id % 3 AS kind, event_id * 1000 AS t, event_id * 500 AS s, event_id * 700 AS e, epoch_us(ts) * 1000 AS log_ns FROM events)
SELECT event_id, CASE kind WHEN 1 THEN t + 1600000000000000000 WHEN 2 THEN s + 1600000000000000000 ELSE log_ns END AS publish_ns, CASE kind WHEN 1 THEN t END AS time_ns, CASE kind WHEN 2 THEN s END AS start_ns, CASE kind WHEN 2 THEN e END AS end_ns, log_ns >= 1577836800000000000 AS plausible FROM p""",
    "trigger_json_decode": """WITH j0 AS (SELECT event_id AS k, '"trigger_time":{"sec":' || event_id || ',"nanosec":250},"postroll":' || event_id * 10 AS tail FROM events),
j AS (SELECT k AS event_id, CAST(CASE k % 6 WHEN 0 THEN '{"name":"evt","description":"hi",' || tail || ',"preroll":1000}' WHEN 1 THEN '{"name":"evt","extra":true,' || tail || ',"preroll":7}' WHEN 2 THEN '{"name":"evt",' || tail || '}'
  WHEN 3 THEN '{"name":"evt",' || tail || ',"preroll":"7"}' WHEN 4 THEN '{"name":"evt",' || tail || ',"preroll":1.5}' ELSE '{"name":"evt",' || tail || ',"preroll":-1}' END AS JSON) AS body FROM j0),
d AS (SELECT *, coalesce(json_type(body, '$.preroll') = 'UBIGINT' AND json_type(body, '$.postroll') = 'UBIGINT' AND json_type(body, '$.name') = 'VARCHAR', false) AS ok FROM j)
SELECT event_id, ok, CASE WHEN ok THEN body ->> '$.name' END AS name, CASE WHEN ok THEN coalesce(body ->> '$.description', '') END AS description, CASE WHEN ok THEN CAST(body ->> '$.trigger_time.sec' AS BIGINT) END AS sec,
  CASE WHEN ok THEN CAST(body ->> '$.trigger_time.nanosec' AS BIGINT) END AS nanosec, CASE WHEN ok THEN CAST(body ->> '$.preroll' AS BIGINT) END AS preroll_ns, CASE WHEN ok THEN CAST(body ->> '$.postroll' AS BIGINT) END AS postroll_ns FROM d""",
    "channel_schemas": BASE + """, c AS (SELECT DISTINCT recording_id, topic, CASE topic WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 END AS channel_id FROM m WHERE topic <> 'view')
SELECT recording_id, CAST(channel_id AS BIGINT) AS channel_id, topic, CASE WHEN channel_id % 3 <> 0 THEN 'schema_' || channel_id % 3 END AS schema_name FROM c""",
    "trigger_tap": BASE + """SELECT "offset", 'json' AS message_encoding, log_ns, publish_ns, payload FROM m WHERE topic = 'error'""",
    "unknown_channel_skips": BASE + "SELECT trigger_id, count_if(topic <> 'view') AS copied, count_if(topic = 'view') AS skipped FROM cl GROUP BY 1",
    "clip_stats": BASE + RECORDS + """, e AS (SELECT trigger_id, count(*) AS n FROM wl w JOIN x ON x.log_max >= w.start_ns AND x.log_min <= w.end_ns GROUP BY 1),
g AS (SELECT trigger_id, count_if(topic <> 'view') AS copied, CAST(coalesce(sum(size) FILTER (topic <> 'view'), 0) AS BIGINT) AS bytes, count_if(topic = 'view') AS skipped FROM cl GROUP BY 1)
SELECT w.trigger_id, coalesce(n, 0) AS extents_read, coalesce(copied, 0) AS messages_copied, coalesce(bytes, 0) AS bytes_copied, coalesce(skipped, 0) AS records_skipped, CAST(0 AS BIGINT) AS chunks_dropped FROM wl w LEFT JOIN e USING (trigger_id) LEFT JOIN g USING (trigger_id)""",
    "message_sequence": BASE + 'SELECT "offset", (row_number() OVER (PARTITION BY recording_id ORDER BY "offset") - 1) % 4294967296 AS sequence FROM m',
    "union_of_recordings": BASE + "SELECT trigger_id, count(*) AS messages, count(DISTINCT recording_id) AS recordings FROM cl GROUP BY 1",
    "admission_fold": BASE + """
, o AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY log_ns, trigger_id) AS k, trigger_id % 10 <> 0 AS valid FROM wl),
af AS (
  SELECT recording_id, k, trigger_id, valid AS admitted, CASE WHEN valid THEN [end_ns] ELSE [] END AS active FROM o WHERE k = 1
  UNION ALL
  SELECT o.recording_id, o.k, o.trigger_id, o.valid AND len(list_filter(a.active, lambda x: x > o.log_ns)) < 2,
    CASE WHEN o.valid AND len(list_filter(a.active, lambda x: x > o.log_ns)) < 2 THEN list_append(list_filter(a.active, lambda x: x > o.log_ns), o.end_ns) ELSE list_filter(a.active, lambda x: x > o.log_ns) END
  FROM af a JOIN o ON o.recording_id = a.recording_id AND o.k = a.k + 1)
SELECT trigger_id, admitted FROM af""",
    "admission_all_sources": BASE + f"""
, o AS (SELECT *, end_ns + 120 * {MINUTE} AS finish_ns, row_number() OVER (ORDER BY log_ns, trigger_id) AS k, trigger_id % 10 <> 0 AS valid FROM wl),
af AS (
  SELECT k, trigger_id, recording_id, valid AS admitted, CASE WHEN valid THEN [finish_ns] ELSE [] END AS active FROM o WHERE k = 1
  UNION ALL
  SELECT o.k, o.trigger_id, o.recording_id, o.valid AND len(list_filter(a.active, lambda x: x > o.log_ns)) < 3,
    CASE WHEN o.valid AND len(list_filter(a.active, lambda x: x > o.log_ns)) < 3 THEN list_append(list_filter(a.active, lambda x: x > o.log_ns), o.finish_ns) ELSE list_filter(a.active, lambda x: x > o.log_ns) END
  FROM af a JOIN o ON o.k = a.k + 1)
SELECT trigger_id, recording_id, admitted FROM af""",
    "two_clock_windows": """WITH s AS (SELECT epoch_us(l_shipdate) * 1000 AS log_ns, epoch_us(o_orderdate) * 1000 AS publish_ns FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
w AS (SELECT o_orderkey AS trigger_id, epoch_us(o_orderdate) * 1000 AS placed FROM orders)
SELECT trigger_id, count(*) AS messages, min(log_ns) AS first_log_ns, max(log_ns) AS last_log_ns FROM w JOIN s ON publish_ns BETWEEN placed AND placed GROUP BY 1""",
    "producer_ticks": """SELECT topic, 2 * i + k AS sequence, 1700000000000000000 + i * 20000000 AS log_ns, CASE k WHEN 0 THEN round(cos(i * 0.02::DOUBLE), 9) END AS x, CASE k WHEN 0 THEN round(sin(i * 0.02::DOUBLE), 9) END AS y, CASE k WHEN 1 THEN round(abs(sin(i * 0.02::DOUBLE)), 9) END AS size
FROM generate_series(0, 499) g(i), (VALUES (0, '/pose'), (1, '/size')) c(k, topic)""",
    "producer_envelopes": """WITH s AS (SELECT event_id AS k, CASE WHEN event_id % 4 <> 0 THEN CAST(floor(value) AS BIGINT) END AS value FROM events)
SELECT k AS seq, CASE WHEN value IS NULL THEN '/sensor/__meta' ELSE '/sensor' END AS topic, k * 6 + 1600000000000000000 AS log_ns, CASE k % 3 WHEN 1 THEN k * 10 WHEN 2 THEN k * 20 ELSE k * 6 END + 1600000000000000000 AS publish_ns,
  value, CASE WHEN k % 3 = 2 THEN k * 20 END AS start_ns, k * 6 AS done_ns, CASE WHEN value IS NULL THEN true END AS missing FROM s""",
    "mcap_roundtrip": BASE + "SELECT recording_id, count(*) AS messages, CAST(sum(size) AS BIGINT) AS bytes, min(log_ns) AS log_min, max(log_ns) AS log_max, min(publish_ns) AS publish_min, max(publish_ns) AS publish_max, count(DISTINCT topic) AS topics FROM b0 GROUP BY 1".replace("b0", "m"),
}
