"""SQL over the same tables that gives the core queries' rows another way."""

#: Fixed values of the SQL's own: what the tables' abbreviations and month names mean, and where months come first.
ABBREVIATIONS = {"Z": 0, "UTC": 0, "GMT": 0, "CET": 60, "CEST": 120, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420}
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}
MONTH_FIRST = "('en-US', 'en-PH')"

_OPEN = """CASE WHEN json_type({v}) = 'VARCHAR' AND json_valid({v} ->> '$') AND json_type({v} ->> '$') IN ('OBJECT', 'ARRAY') THEN ({v} ->> '$')::JSON ELSE {v} END"""
_OBJECTS = f"""
docs AS (SELECT 'kg_nodes' AS tbl, 'properties' AS col, pos, properties::JSON AS v FROM kg_nodes WHERE json_valid(properties)
  UNION ALL SELECT 'kg_nodes', 'metadata', pos, metadata::JSON FROM kg_nodes WHERE json_valid(metadata) UNION ALL SELECT 'kg_edges', 'properties', pos, properties::JSON FROM kg_edges WHERE json_valid(properties)),
t AS (SELECT tbl, col, pos, '$' AS path, '$' AS parent_path, false AS elem, {_OPEN.format(v="v")} AS v FROM docs
  UNION ALL SELECT tbl, col, pos, t.path || CASE WHEN json_type(v) = 'ARRAY' THEN '[' || e.key || ']' ELSE '.' || e.key END, CASE WHEN elem AND json_type(v) = 'OBJECT' THEN t.path ELSE parent_path END,
    json_type(v) = 'ARRAY', {_OPEN.format(v="e.value")} FROM t, json_each(v) e WHERE json_type(v) IN ('ARRAY', 'OBJECT'))
"""

_DANGLING = """
ends AS (SELECT pos, type, written_at, 'source_id' AS endpoint, source_id AS id FROM kg_edges UNION ALL SELECT pos, type, written_at, 'target_id', target_id FROM kg_edges),
direct AS (SELECT e.pos, e.endpoint, any_value(e.id) AS id, any_value(e.written_at) AS written_at FROM ends e LEFT JOIN kg_nodes n ON n.id = e.id AND n.written_at <= e.written_at
  WHERE e.id <> '' AND e.id NOT IN (SELECT id FROM kg_catalog) GROUP BY e.pos, e.endpoint
  HAVING coalesce(arg_max(coalesce(n.status, ''), (n.written_at, n.pos)) FILTER (WHERE n.id IS NOT NULL), 'archived') = 'archived')
"""


_SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def _clean(x: str) -> str:
    return f"nullif(regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g'), '')"


def _tags(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '^\\s*\\[') THEN from_json({x}, '[\"VARCHAR\"]') WHEN {x} IS NOT NULL THEN [{x}] END"


_ISO = "^[0-9]{4}-[0-9]{2}-[0-9]{2}(T[0-9]{2}:[0-9]{2}(:[0-9]{2}(\\.[0-9]{1,9})?)?(Z|[+-][0-9]{2}:[0-9]{2})?)?$"


def _iso_ms(x: str) -> str:
    zone = f"regexp_extract({x}, 'T.*([+-])([0-9]{{2}}):([0-9]{{2}})$', ['s', 'h', 'm'])"
    local = f"try_cast(replace(regexp_replace(regexp_replace({x}, '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$', ''), '(\\.[0-9]{{6}})[0-9]+', '\\1'), 'T', ' ') || CASE WHEN regexp_matches({x}, 'T[0-9]{{2}}:[0-9]{{2}}(Z|[+-]|$)') THEN ':00' ELSE '' END AS TIMESTAMP)"
    date = f"try_cast({x} AS TIMESTAMP)"
    shift = f"coalesce(CASE WHEN ({zone}).s = '-' THEN -1 ELSE 1 END * (try_cast(({zone}).h AS INT) * 60 + try_cast(({zone}).m AS INT)) * 60000, 0)"
    return f"CASE WHEN regexp_matches({x}, '{_ISO}') THEN CASE WHEN contains({x}, 'T') THEN floor(epoch_us({local}) / 1000)::BIGINT - {shift} ELSE epoch_ms({date}) END END"


_GRAPH = f"""
lw AS (SELECT * FROM kg_nodes WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM kg_catalog) QUALIFY row_number() OVER (PARTITION BY id ORDER BY written_at DESC NULLS LAST, pos DESC) = 1),
dw AS (SELECT * FROM kg_decisions WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos DESC) = 1),
ms AS (SELECT *, CASE WHEN regexp_matches(timestamp, '^[0-9]{{1,15}}(\\.[0-9]{{1,6}})?$') THEN CASE WHEN timestamp::DECIMAL(21,6) > 100000000000 THEN timestamp::DECIMAL(21,6)::DOUBLE ELSE (timestamp::DECIMAL(21,6) * 1000)::DOUBLE END END AS stamp FROM dw),
nodes AS (
  SELECT pos, id, type, coalesce({_clean("coalesce(label, CASE WHEN json_valid(properties) THEN coalesce(properties ->> '$.name', properties ->> '$.content') END, id)")}, id) AS label, status, {_tags("conversation")} AS tags,
    NULL::VARCHAR AS category, NULL::VARCHAR AS outcome, NULL::VARCHAR AS scenario, NULL::VARCHAR AS reasoning, NULL::DOUBLE AS confidence, NULL::VARCHAR AS decision_maker, NULL::DOUBLE AS at_ms FROM lw
  UNION ALL SELECT pos + 1000000000000, id, 'decision', id, NULL, NULL, category, outcome, scenario, reasoning, confidence, decision_maker,
    coalesce(CASE WHEN stamp <= 253402300799999.0 THEN stamp END, {_iso_ms("recorded_at")}, {_iso_ms("valid_from")}) FROM ms
  UNION ALL SELECT min(pos) + 2000000000000, 'category:' || category, 'category', category, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM dw WHERE {_clean("category")} IS NOT NULL GROUP BY category
  UNION ALL SELECT min(pos) + 3000000000000, 'maker:' || decision_maker, 'decision_maker', decision_maker, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM dw WHERE {_clean("decision_maker")} IS NOT NULL GROUP BY decision_maker
  UNION ALL SELECT row_number() OVER (ORDER BY id) + 4000000000000, id, type, coalesce({_clean("coalesce(label, id)")}, id), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM kg_catalog),
wide AS (SELECT coalesce(max(len(entities)), 0) + 2 AS w FROM kg_decisions),
de AS (SELECT pos, id, {_clean("unnest(entities)")} AS entity, unnest(range(len(entities))) AS k FROM dw),
edges AS (
  SELECT pos, source_id, target_id, type, weight, {_tags("conversation")} AS tags FROM kg_edges
  UNION ALL SELECT pos * w + k + 1000000000000, id, entity, 'involves', NULL, NULL FROM de, wide WHERE entity IS NOT NULL
  UNION ALL SELECT pos * w + w - 2 + 1000000000000, id, 'category:' || category, 'belongs_to', NULL, NULL FROM dw, wide WHERE {_clean("category")} IS NOT NULL
  UNION ALL SELECT pos * w + w - 1 + 1000000000000, id, 'maker:' || decision_maker, 'made_by', NULL, NULL FROM dw, wide WHERE {_clean("decision_maker")} IS NOT NULL),
live AS (SELECT *, coalesce(type, '') NOT IN ('decision', 'category', 'decision_maker') AS semantic, coalesce(list_bool_or(list_transform(tags, lambda t: {_clean("t")} IS NOT NULL)), false) AS any_tag FROM nodes WHERE status IS DISTINCT FROM 'archived')
"""


def _clean_edges(name: str, nodes: str) -> str:
    return f"""{name} AS (SELECT pos, source_id, target_id, type, coalesce(weight, 1.0) AS weight FROM edges WHERE source_id <> '' AND target_id <> '' AND source_id <> target_id
  AND source_id IN (SELECT id FROM {nodes}) AND target_id IN (SELECT id FROM {nodes}) QUALIFY row_number() OVER (PARTITION BY source_id, target_id, type ORDER BY pos) = 1)"""


_CLEAN = f"{_GRAPH}, {_clean_edges('clean', 'live')}"
_NUMBERED = f"{_CLEAN}, ab AS (SELECT a.pos AS a, b.pos AS b FROM clean JOIN live a ON a.id = source_id JOIN live b ON b.id = target_id), around AS (SELECT a, b FROM ab UNION SELECT b, a FROM ab), deg AS (SELECT l.*, coalesce(d, 0) AS degree FROM live l LEFT JOIN (SELECT a, count(*) AS d FROM around GROUP BY a) ON a = pos)"
_SESSION = "main AS (SELECT t AS s FROM (SELECT unnest(tags) AS t FROM edges) WHERE t IS NOT NULL GROUP BY t ORDER BY count(*) DESC, t LIMIT 1)"
_SCOPE = f"""{_GRAPH}, {_SESSION},
tagged AS (SELECT id FROM live, main WHERE list_contains(tags, s)),
by_edge AS (SELECT DISTINCT id FROM (SELECT unnest([source_id, target_id]) AS id FROM edges, main WHERE list_contains(tags, s)) WHERE id IN (SELECT id FROM live) AND id NOT IN (SELECT id FROM tagged)),
k1 AS (SELECT id FROM tagged UNION SELECT id FROM by_edge),
by_entity AS (SELECT DISTINCT source_id AS id FROM edges WHERE type = 'involves' AND target_id IN (SELECT id FROM k1) AND source_id IN (SELECT id FROM live WHERE type = 'decision') AND source_id NOT IN (SELECT id FROM k1)),
k2 AS (SELECT id FROM k1 UNION SELECT id FROM by_entity),
steps AS (SELECT pos, source_id, target_id FROM edges WHERE target_id IN (SELECT id FROM live WHERE NOT semantic) AND target_id NOT IN (SELECT id FROM k2)),
reach AS (SELECT target_id AS id, pos AS at FROM steps WHERE source_id IN (SELECT id FROM k2) UNION SELECT s.target_id, s.pos FROM reach r JOIN steps s ON s.source_id = r.id AND s.pos > r.at),
satellites AS (SELECT DISTINCT id FROM reach),
kept AS (SELECT id FROM k2 UNION SELECT id FROM satellites),
viewed AS (SELECT * FROM live WHERE id IN (SELECT id FROM kept)), {_clean_edges('view_edges', 'viewed')}"""

_RANK = f"""{_NUMBERED}, outs AS MATERIALIZED (SELECT a, count(*) AS o FROM ab GROUP BY a), size AS MATERIALIZED (SELECT count(*) AS n FROM live), walk AS MATERIALIZED (SELECT a, b FROM ab),
r0 AS MATERIALIZED (SELECT pos AS i, 1.0::DOUBLE / n AS r FROM live, size)""" + "".join(
    f""", r{k} AS MATERIALIZED (SELECT p.i, 0.15 / n + 0.85 * (SELECT coalesce(sum(r), 0) FROM r{k - 1} WHERE i NOT IN (SELECT a FROM outs)) / n + coalesce(g, 0) AS r FROM r{k - 1} p
  LEFT JOIN (SELECT b, sum(0.85 * r / o) AS g FROM walk JOIN r{k - 1} ON i = walk.a JOIN outs ON outs.a = walk.a GROUP BY b) ON b = p.i, size)"""
    for k in range(1, 21)
)

#: Ordered propagation, a level of the order a step: nodes of one level have no links among themselves. Row -1 counts the steps.
_COMMUNITIES = f"""{_NUMBERED}, lv(n, k) USING KEY (n) AS (SELECT pos, 0 FROM live UNION SELECT x.b, max(lv.k + 1) FROM lv JOIN around x ON x.a = lv.n AND x.b > x.a JOIN recurring.lv AS old ON old.n = x.b WHERE lv.k + 1 > old.k GROUP BY x.b),
top AS MATERIALIZED (SELECT max(k) + 1 AS most FROM lv), turn AS MATERIALIZED (SELECT n, k, b FROM lv JOIN around ON a = n),
st(n, label) USING KEY (n) AS (SELECT pos, pos FROM live UNION ALL SELECT -1, 0 UNION (
  SELECT n, label FROM (SELECT n, label, c, coalesce(max(c) FILTER (WHERE label = own) OVER (PARTITION BY n), 0) AS mine, row_number() OVER (PARTITION BY n ORDER BY c DESC, label) AS r
    FROM (SELECT turn.n, me.label AS own, o.label, count(*) AS c FROM st w, top JOIN turn ON k = w.label % most JOIN recurring.st AS o ON o.n = turn.b JOIN recurring.st AS me ON me.n = turn.n WHERE w.n = -1 AND w.label < 10 * most GROUP BY ALL)) WHERE r = 1 AND c > mine
  UNION ALL SELECT -1, label + 1 FROM st, top WHERE n = -1 AND label < 10 * most)),
grouped AS (SELECT label AS community, count(*) AS size, min(n) AS first FROM st WHERE n >= 0 GROUP BY label),
largest AS (SELECT * FROM grouped WHERE size > 1 ORDER BY size DESC, first LIMIT 12)"""

_LOGGED = f"""
adds AS (SELECT id, pos * 4 AS seq, CASE WHEN json_valid(metadata) AND json_type(metadata) = 'OBJECT' AND json_type(metadata, '$.conversation') = 'VARCHAR' THEN {_clean("metadata ->> '$.conversation'")} END AS owner FROM kg_nodes WHERE status IS DISTINCT FROM 'archived'),
gone AS (SELECT id, pos * 4 AS seq FROM kg_nodes WHERE status = 'archived'),
routed AS (
  SELECT seq, 'add_entity' AS tool, owner AS given, NULL AS owned FROM adds WHERE owner IS NOT NULL
  UNION ALL SELECT seq, 'add_entity', NULL, NULL FROM adds WHERE owner IS NULL
  UNION ALL SELECT g.seq, 'delete_node', NULL, (SELECT arg_max(coalesce(a.owner, ''), a.seq) FROM adds a WHERE a.id = g.id AND a.seq < g.seq) FROM gone g
  UNION ALL SELECT pos * 4 + 1, 'add_relationship', {_clean("conversation")}, NULL FROM kg_edges
  UNION ALL SELECT pos * 4 + 2, 'record_decision', CASE WHEN pos % 2 = 0 THEN {_clean("conversation")} END,
    (SELECT arg_min(o, k) FROM (SELECT k, (SELECT arg_max(coalesce(a.owner, ''), a.seq) FROM adds a WHERE a.id = e AND a.seq < d.pos * 4 + 2) AS o FROM (SELECT unnest(d.entities) AS e, unnest(range(len(d.entities))) AS k)) WHERE o <> '') FROM kg_decisions d),
routes AS (SELECT seq, tool, coalesce(given, nullif(owned, '')) AS session, CASE WHEN given IS NOT NULL THEN 'given' WHEN owned <> '' THEN 'owner' ELSE 'merged only' END AS how FROM routed)
"""


def _stem(x: str) -> str:
    return f"nullif(substr(regexp_replace(regexp_replace({x}, '[^A-Za-z0-9_-]', '_', 'g'), '^_+|_+$', '', 'g'), 1, 120), '')"


def _meta_tags(doc: str) -> str:
    of = "CASE json_type(m, '$.{f}') WHEN 'ARRAY' THEN list_transform(list_filter(from_json(m -> '$.{f}', '[\"JSON\"]'), lambda x: json_type(x) = 'VARCHAR'), lambda x: x ->> '$') WHEN 'VARCHAR' THEN [m ->> '$.{f}'] WHEN 'NULL' THEN NULL ELSE CASE WHEN json_type(m, '$.{f}') IS NOT NULL THEN []::VARCHAR[] END END"
    return f"SELECT pos, unnest(coalesce({of.format(f='conversation')}, {of.format(f='session')})) AS tag FROM (SELECT pos, {doc} AS m FROM {{t}} WHERE json_valid({doc}))"


_SETTINGS = """settings AS (SELECT session_id AS profile, coalesce(auto_on, false) AS has_plugin, CASE WHEN profile IS NULL THEN NULL WHEN locale = 'en-US' THEN '/home/x/' || session_id || '.json' ELSE '/srv/' || session_id || '.json' END AS path FROM kg_sessions)"""

_CLOCK = r"(?:(?:T|,?\s+)(\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?\s*(?:([AaPp][Mm])\b)?)?"
_PLACE = r"\s*\[?([+-]\d{1,2}:?\d{2}|[A-Za-z][A-Za-z0-9_+-]*(?:/[A-Za-z0-9_+-]+)*)?\]?"
_FORMS = [
    (rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}}){_CLOCK}{_PLACE}$", r"\1|\2|\3|\4|\5|\6|\7|\8|\9"),
    (r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})(Z?)$", r"\1|\2|\3|\4|\5|\6|||\7"),
    (r"^(\d{4})(\d{2})(\d{2})$", r"\1|\2|\3||||||"),
    (rf"^(?:\p{{L}}{{2,9}},?\s+)?(\d{{1,2}})\s+(\p{{L}}{{3}})\p{{L}}*\s+(\d{{4}}){_CLOCK}{_PLACE}$", r"\3|\2|\1|\4|\5|\6|\7|\8|\9"),
    (r"^(\d{4})年(\d{1,2})月(\d{1,2})日(?:\s*(上午|下午)?\s*(\d{1,2}):(\d{2})(?::(\d{2}))?)?$", r"\1|\2|\3|\5|\6|\7||\4|"),
    *((rf"^(\d{{4}}){k}(\d{{1,2}}){k}(\d{{1,2}}){_CLOCK}{_PLACE}$", r"\1|\2|\3|\4|\5|\6|\7|\8|\9") for k in ("/", r"\.")),
]
_NUMBERS = [rf"^(\d{{1,2}}){k}(\d{{1,2}}){k}(\d{{4}}){_CLOCK}{_PLACE}$" for k in ("/", r"\.")]
_READ = "CASE " + " ".join(f"WHEN regexp_matches(x, '{p}') THEN regexp_replace(x, '{p}', '{to}')" for p, to in _FORMS)
_READ += " ".join(f" WHEN regexp_matches(x, '{p}') THEN CASE WHEN locale IN {MONTH_FIRST} THEN regexp_replace(x, '{p}', '\\3|\\1|\\2|\\4|\\5|\\6|\\7|\\8|\\9') ELSE regexp_replace(x, '{p}', '\\3|\\2|\\1|\\4|\\5|\\6|\\7|\\8|\\9') END" for p in _NUMBERS) + " END"
_MONTH = "CASE lower(p[2]) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in MONTHS.items()) + " ELSE try_cast(p[2] AS INT) END"
_SHORT = "CASE upper(p[9]) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ABBREVIATIONS.items()) + " ELSE CASE WHEN regexp_matches(p[9], '^[+-]') THEN CASE WHEN p[9][1] = '-' THEN -1 ELSE 1 END * (replace(p[9], ':', '')[2:-3]::INT * 60 + replace(p[9], ':', '')[-2:]::INT) END END"


def _offset(us: str) -> str:
    return f"(epoch_us(timezone(region, make_timestamptz({us}))) - ({us}))"


def _moments(us: str, name: str) -> str:
    early, late = _offset(f"{us} - 86400000000"), _offset(f"{us} + 86400000000")
    a, b = f"({us} - {early})", f"({us} - {late})"
    return f"CASE WHEN fixed IS NOT NULL THEN {us} - fixed WHEN {_offset(a)} = {early} THEN {a} END AS {name}_a, CASE WHEN fixed IS NULL AND {_offset(b)} = {late} THEN {b} END AS {name}_b, CASE WHEN fixed IS NULL THEN {a} END AS {name}_skip"


def _parsed(source: str, out: str) -> str:
    """Steps from (x, zone, locale) to local micros, offset, region."""
    return f"""{out}1 AS (SELECT *, string_split({_READ}, '|') AS p FROM {source}),
{out}2 AS (SELECT *, try_cast(p[1] || '-' || ({_MONTH}) || '-' || p[3] AS DATE) AS day, try_cast(p[4] AS INT) AS hour, lower(p[8]) AS half, ({_SHORT})::BIGINT * 60000000 AS fixed,
  CASE WHEN p[9] <> '' THEN CASE WHEN p[9] IN (SELECT name FROM pg_timezone_names()) AND (contains(p[9], '/') OR p[9] = 'UTC') THEN p[9] END WHEN zone IN (SELECT name FROM pg_timezone_names()) THEN zone END AS region FROM {out}1),
{out} AS (SELECT *, p IS NOT NULL AND (fixed IS NOT NULL OR region IS NOT NULL OR p[9] = '') AND ({_MONTH}) IS NOT NULL AS dated, p[4] = '' AS day_only,
  epoch_us(day::TIMESTAMP) + CASE WHEN p[4] = '' THEN 0 WHEN p[5]::INT < 60 AND coalesce(try_cast(p[6] AS INT), 0) < 60 AND CASE WHEN half = '' THEN hour < 24 ELSE hour <= 12 END
    THEN ((CASE WHEN half = '' THEN hour ELSE hour % 12 + CASE WHEN half IN ('pm', '下午') THEN 12 ELSE 0 END END * 60 + p[5]::INT) * 60 + coalesce(try_cast(p[6] AS INT), 0))::BIGINT * 1000000 + rpad(p[7][1:6], 6, '0')::INT END AS us FROM {out}2)"""


_MOMENTS = f"""
w0 AS (SELECT d.pos, d.recorded_at, d.valid_from, s.zone, s.locale, d.timestamp AS stamp, regexp_replace(d.timestamp, '^{_SPACE}+|{_SPACE}+$', '', 'g') AS x FROM kg_decisions d LEFT JOIN kg_sessions s ON s.session_id = d.conversation),
{_parsed("w0", "w")},
w3 AS (SELECT *, {_moments("us", "m")} FROM w),
r AS (SELECT pos, recorded_at, valid_from, zone, locale, CASE WHEN regexp_matches(x, '^[0-9]{{1,19}}(\\.[0-9]{{1,12}})?$') THEN floor(x::DECIMAL(32, 12) * CASE WHEN x::DECIMAL(32, 12) < 100000000000 THEN 1000000 WHEN x::DECIMAL(32, 12) < 100000000000000 THEN 1000 ELSE 1 END)::BIGINT
  WHEN dated AND NOT day_only THEN least(m_a, m_b) END AS ref FROM w3),
v0 AS (SELECT pos, 'recorded_at' AS field, recorded_at AS text, zone, locale, ref FROM r UNION ALL SELECT pos, 'valid_from', valid_from, zone, locale, ref FROM r),
v00 AS (SELECT *, regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g') AS x FROM v0),
{_parsed("v00", "v")},
v3 AS (SELECT *, {_moments("us", "m")}, {_moments("us + 86400000000", "n")} FROM v),
v4 AS (SELECT *, least(m_a, m_b) AS one, greatest(m_a, m_b) AS two, CASE WHEN NOT coalesce(dated, false) THEN 'none' WHEN fixed IS NULL AND region IS NULL THEN 'no zone' WHEN us IS NULL THEN 'impossible' WHEN day_only THEN 'day' WHEN m_a IS NULL AND m_b IS NULL THEN 'impossible' WHEN m_a <> m_b THEN 'twice' ELSE 'moment' END AS status FROM v3),
moments AS (SELECT pos, field, text, status, ref, one, two, coalesce(one, m_skip) AS begin_, coalesce(greatest(n_a, n_b), n_skip) AS end_,
  CASE WHEN ref IS NULL OR status IN ('none', 'no zone') THEN NULL WHEN status = 'impossible' THEN true WHEN status = 'day' THEN NOT (ref >= coalesce(one, m_skip) AND ref < coalesce(greatest(n_a, n_b), n_skip)) ELSE least(abs(one - ref), abs(two - ref)) >= 60000000 END AS disagrees FROM v4)
"""

ORACLES = {
    "p2_found": f"WITH {_MOMENTS} SELECT pos, field FROM moments WHERE disagrees",
    "p2_moments": f"""WITH {_MOMENTS} SELECT pos, field, text, status, make_timestamp(CASE WHEN status = 'day' THEN begin_ WHEN status IN ('moment', 'twice') THEN one END) AS utc,
  make_timestamp(CASE WHEN status = 'day' THEN end_ WHEN status = 'twice' THEN two END) AS utc_other, make_timestamp(ref) AS ref, disagrees FROM moments""",
    "p3_found": f"WITH {_DANGLING} SELECT pos, endpoint FROM direct",
    "p3_report": f"""WITH RECURSIVE {_DANGLING},
links AS (SELECT pos, source_id, target_id FROM kg_edges WHERE type IN ('belongs_to', 'part_of') AND source_id <> '' AND target_id <> '' AND source_id <> target_id),
bad AS (SELECT DISTINCT source_id AS id FROM links WHERE pos IN (SELECT pos FROM direct WHERE endpoint = 'target_id')
  UNION SELECT l.source_id FROM links l JOIN bad b ON l.target_id = b.id WHERE l.target_id NOT IN (SELECT id FROM kg_catalog)),
every AS (SELECT endpoint, id, written_at, 1 AS d FROM direct UNION ALL SELECT e.endpoint, e.id, e.written_at, 0 FROM ends e JOIN bad b ON b.id = e.id WHERE NOT EXISTS (SELECT 1 FROM direct x WHERE x.pos = e.pos AND x.endpoint = e.endpoint))
SELECT 'kg_edges' AS tbl, endpoint, strftime(date_trunc('month', written_at), '%Y-%m-%d') AS period, sum(d)::BIGINT AS direct, sum(1 - d)::BIGINT AS inherited, count(DISTINCT id) AS missing_ids FROM every GROUP BY ALL""",
    "p6_found": f"WITH RECURSIVE {_OBJECTS} SELECT tbl, col, pos, parent_path, path FROM t WHERE elem AND json_type(v) = 'OBJECT'",
    "p6_tables": f"WITH RECURSIVE {_OBJECTS} SELECT tbl, col, regexp_replace(path, '\\[\\d+\\]', '[]', 'g') AS name, count(*) AS objects, count(DISTINCT pos) AS rows FROM t WHERE elem AND json_type(v) = 'OBJECT' GROUP BY ALL",
    "graph_scan": f"WITH {_GRAPH} SELECT 'nodes' AS part, count(*) AS n, bit_xor(pos) AS xor_pos FROM nodes UNION ALL SELECT 'edges', count(*), bit_xor(pos) FROM edges",
    "live_nodes": f"WITH {_GRAPH} SELECT id, type, status FROM live",
    "tagged_nodes": f"WITH {_GRAPH}, {_SESSION} SELECT id FROM live, main WHERE list_contains(tags, s)",
    "untagged_nodes": f"WITH {_GRAPH} SELECT id FROM live WHERE semantic AND NOT any_tag",
    "semantic_nodes": f"WITH {_GRAPH} SELECT id, type FROM live WHERE semantic",
    "relation_edges": f"WITH {_GRAPH} SELECT pos, type FROM edges WHERE coalesce(type, '') NOT IN ('involves', 'belongs_to', 'made_by')",
    "clean_edges": f"WITH {_CLEAN} SELECT pos, source_id, target_id, type, weight FROM clean",
    "dropped_edges": f"WITH {_CLEAN} SELECT pos FROM edges WHERE pos NOT IN (SELECT pos FROM clean)",
    "node_tags": _meta_tags("metadata").format(t="kg_nodes"),
    "edge_tags": "WITH e AS (SELECT pos, CASE WHEN json_valid(properties) THEN properties -> '$.metadata' END AS meta FROM kg_edges) " + _meta_tags("meta").format(t="e"),
    "node_labels": f"WITH {_GRAPH} SELECT id, label FROM nodes",
    "write_tools": f"WITH {_LOGGED} SELECT tool, count(*) AS n FROM routes GROUP BY tool",
    "status_counts": f"WITH {_GRAPH} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM live) AS live, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) > 0 FROM nodes) AS present",
    "claim_by_edge": f"WITH RECURSIVE {_SCOPE} SELECT id FROM by_edge",
    "claim_by_entity": f"WITH RECURSIVE {_SCOPE} SELECT id FROM by_entity",
    "claim_satellites": f"WITH RECURSIVE {_SCOPE} SELECT id FROM satellites",
    "scope_conversation": f"WITH RECURSIVE {_SCOPE} SELECT id, type FROM viewed",
    "scope_conversation_edges": f"WITH RECURSIVE {_SCOPE} SELECT pos, source_id, target_id, type, weight FROM view_edges",
    "claim_conversation": f"""WITH RECURSIVE {_SCOPE} SELECT (SELECT count(*) FROM tagged) AS tagged, (SELECT count(*) FROM by_edge) AS by_edge, (SELECT count(*) FROM by_entity) AS by_entity,
  (SELECT count(*) FROM live WHERE type = 'decision' AND id NOT IN (SELECT id FROM kept)) AS untagged_decisions, (SELECT count(*) FROM live WHERE semantic AND NOT any_tag) AS untagged, (SELECT count(*) FROM live WHERE semantic) AS total_semantic""",
    "untagged_decisions": f"WITH RECURSIVE {_SCOPE} SELECT id FROM live WHERE type = 'decision' AND id NOT IN (SELECT id FROM kept)",
    "scope_all": f"WITH {_GRAPH} SELECT id, type FROM live",
    "claim_all": f"WITH {_GRAPH} SELECT count(*) FILTER (WHERE any_tag) AS tagged, 0::BIGINT AS by_edge, 0::BIGINT AS by_entity, count(*) FILTER (WHERE NOT any_tag) AS untagged, count(*) AS total_semantic FROM live WHERE semantic",
    "scope_own": f"WITH {_CLEAN} SELECT type, count(*) AS n FROM clean GROUP BY type",
    "claim_own": f"WITH {_CLEAN} SELECT (SELECT count(*) FROM live WHERE semantic) AS tagged, (SELECT count(*) FROM live WHERE semantic) AS total_semantic, (SELECT count(*) FROM edges) - (SELECT count(*) FROM clean) AS dropped_edges, 'session-file' AS source",
    "graph_summary": f"WITH {_CLEAN} SELECT (SELECT count(*) FROM live) AS nodes, (SELECT count(*) FROM clean) AS edges, (SELECT count(*) FROM live WHERE semantic) AS entities, (SELECT count(*) FROM clean WHERE coalesce(type, '') NOT IN ('involves', 'belongs_to', 'made_by')) AS relations, (SELECT count(*) FROM live WHERE type = 'decision') AS decisions",
    "nodes_by_type": f"WITH {_GRAPH} SELECT coalesce(type, 'Unknown') AS type, count(*) AS n FROM live GROUP BY 1",
    "bar_percent": f"WITH {_GRAPH}, t AS (SELECT coalesce(type, 'Unknown') AS type, count(*) AS n, min(pos) AS first FROM live GROUP BY 1 ORDER BY n DESC, first LIMIT 12) SELECT type, n, greatest(3, floor(n * 100 / (SELECT max(n) FROM t) + 0.5)::INT) AS percent FROM t",
    "adjacency": f"WITH {_NUMBERED} SELECT a, b FROM around",
    "degree": f"WITH {_NUMBERED} SELECT id, degree FROM deg",
    "out_degree": f"WITH {_NUMBERED} SELECT l.id, count(*) AS out_degree FROM ab JOIN live l ON l.pos = a GROUP BY l.id",
    "isolated_nodes": f"WITH {_NUMBERED} SELECT id FROM deg WHERE degree = 0 AND semantic",
    "hubs_by_degree": f"WITH {_NUMBERED} SELECT id, label, coalesce(type, '') AS type, degree, degree::DOUBLE AS score FROM deg WHERE semantic ORDER BY degree DESC, label, pos LIMIT 15",
    "pagerank": f"WITH {_RANK} SELECT id, round(r, 9) AS rank FROM r20 JOIN live ON pos = i",
    "hubs_by_rank": f"WITH {_RANK} SELECT id, label, coalesce(type, '') AS type, degree, round(r, 6) AS score FROM r20 JOIN deg ON pos = i WHERE semantic ORDER BY round(r, 12) DESC, label, pos LIMIT 15",
    "connected_components": f"WITH RECURSIVE {_NUMBERED}, cc(n, c) USING KEY (n) AS (SELECT pos, pos FROM live UNION SELECT x.b, min(cc.c) FROM cc JOIN around x ON x.a = cc.n JOIN recurring.cc AS old ON old.n = x.b WHERE cc.c < old.c GROUP BY x.b) SELECT n AS pos, c AS component FROM cc",
    "component_sizes": f"WITH RECURSIVE {_NUMBERED}, cc(n, c) USING KEY (n) AS (SELECT pos, pos FROM live UNION SELECT x.b, min(cc.c) FROM cc JOIN around x ON x.a = cc.n JOIN recurring.cc AS old ON old.n = x.b WHERE cc.c < old.c GROUP BY x.b) SELECT size, count(*) AS components FROM (SELECT c, count(*) AS size FROM cc GROUP BY c) GROUP BY size",
    "communities": f"WITH RECURSIVE {_COMMUNITIES} SELECT n AS pos, label AS community FROM st WHERE n >= 0",
    "top_communities": f"WITH RECURSIVE {_COMMUNITIES} SELECT community, size FROM largest",
    "community_members": f"""WITH RECURSIVE {_COMMUNITIES} SELECT label AS community, place, id, name AS label, type, degree FROM (SELECT st.label, d.id, d.label AS name, coalesce(d.type, '') AS type, degree, row_number() OVER (PARTITION BY st.label ORDER BY degree DESC, pos) AS place
  FROM st JOIN deg d ON d.pos = st.n JOIN largest ON largest.community = st.label WHERE semantic) WHERE place <= 10""",
    "overview": f"""WITH RECURSIVE {_COMMUNITIES}, cc(n, c) USING KEY (n) AS (SELECT pos, pos FROM live UNION SELECT x.b, min(cc.c) FROM cc JOIN around x ON x.a = cc.n JOIN recurring.cc AS old ON old.n = x.b WHERE cc.c < old.c GROUP BY x.b), sizes AS (SELECT c, count(*) AS size FROM cc GROUP BY c)
SELECT (SELECT count(*) FROM grouped WHERE size > 1) AS communities, (SELECT count(*) FROM live) AS nodes, (SELECT count(*) FROM clean) AS edges, (SELECT count(*) FROM live WHERE semantic) AS entities, (SELECT count(*) FROM clean WHERE coalesce(type, '') NOT IN ('involves', 'belongs_to', 'made_by')) AS relations, (SELECT count(*) FROM live WHERE type = 'decision') AS decisions,
  (SELECT count(*) FROM sizes) AS components, (SELECT max(size) FROM sizes) AS largest_component, (SELECT count(*) FROM deg WHERE degree = 0 AND semantic) AS isolated""",
    "decision_time": f"WITH {_GRAPH} SELECT id, floor(at_ms)::BIGINT AS at_ms FROM nodes WHERE type = 'decision'",
    "decision_list": f"""WITH {_GRAPH} SELECT id, coalesce(category, '未分类') AS category, coalesce(outcome, '') AS outcome, coalesce(scenario, '') AS scenario, coalesce(reasoning, '') AS reasoning, confidence, coalesce(decision_maker, '') AS maker,
  strftime(make_timestamp(floor(at_ms)::BIGINT * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS at FROM nodes WHERE type = 'decision'""",
    "decision_records": f"""WITH {_CLEAN}, held AS (SELECT source_id, string_agg(target_id, chr(10) ORDER BY c.pos) AS ids, string_agg(t.label, chr(10) ORDER BY c.pos) AS labels FROM clean c JOIN live t ON t.id = target_id WHERE c.type = 'involves' GROUP BY source_id)
SELECT id, coalesce(category, '未分类') AS category, coalesce(outcome, '') AS outcome, strftime(make_timestamp(floor(at_ms)::BIGINT * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS at, coalesce(ids, '') AS entity_ids, coalesce(labels, '') AS entity_labels
FROM nodes LEFT JOIN held ON source_id = id WHERE type = 'decision'""",
    "decision_entities": f"WITH {_CLEAN} SELECT source_id AS decision_id, c.pos AS place, target_id AS entity_id, t.label, coalesce(t.type, '') AS type FROM clean c JOIN live d ON d.id = source_id AND d.type = 'decision' JOIN live t ON t.id = target_id WHERE c.type = 'involves'",
    "decision_timeline": f"WITH {_GRAPH} SELECT strftime(make_timestamp(floor(at_ms)::BIGINT * 1000), '%Y-%m-%d') AS day, count(*) AS decisions FROM nodes WHERE type = 'decision' AND at_ms IS NOT NULL GROUP BY 1",
    "write_route": f"WITH {_LOGGED} SELECT seq, tool, session, coalesce({_stem('session')}, 'unknown') AS file, how FROM routes",
    "upsert_last_wins": "SELECT pos, id, type FROM kg_nodes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY written_at DESC NULLS LAST, pos DESC) = 1",
    "soft_delete": "SELECT id, pos FROM (SELECT * FROM kg_nodes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY written_at DESC NULLS LAST, pos DESC) = 1) WHERE status = 'archived'",
    "replay_nodes": f"""WITH {_LOGGED}, st AS (SELECT seq, tool, NULL AS session FROM routes UNION ALL SELECT seq, tool, session FROM routes WHERE session IS NOT NULL),
n AS (SELECT session, id, max(seq) AS since FROM st JOIN adds USING (seq) GROUP BY ALL), d AS (SELECT session, id, seq FROM st JOIN gone USING (seq))
SELECT session, status, count(*) AS nodes FROM (SELECT n.session, n.id, CASE WHEN EXISTS (SELECT 1 FROM d WHERE d.id = n.id AND d.session IS NOT DISTINCT FROM n.session AND d.seq > n.since) THEN 'archived' END AS status FROM n) GROUP BY ALL""",
    "replay_edges": f"WITH {_LOGGED}, st AS (SELECT seq, tool, NULL AS session FROM routes UNION ALL SELECT seq, tool, session FROM routes WHERE session IS NOT NULL) SELECT session, count(*) AS edges FROM st WHERE tool = 'add_relationship' GROUP BY session",
    "decision_expand": f"WITH {_GRAPH} SELECT source_id, type, target_id FROM edges WHERE pos >= 1000000000000 UNION ALL SELECT id, type, NULL FROM nodes WHERE pos >= 2000000000000 AND pos < 4000000000000",
    "node_owner": f"SELECT id, CASE WHEN json_valid(metadata) AND json_type(metadata) = 'OBJECT' AND json_type(metadata, '$.conversation') = 'VARCHAR' THEN {_clean("metadata ->> '$.conversation'")} END AS owner FROM (SELECT id, arg_min_null(metadata, pos) AS metadata FROM kg_nodes WHERE id IS NOT NULL GROUP BY id)",
    "toggle_resolve": "SELECT DISTINCT conversation AS session_id, coalesce(auto_on, true) AS \"on\", auto_on IS NOT NULL AS explicit FROM kg_edges LEFT JOIN kg_sessions ON session_id = conversation WHERE conversation IS NOT NULL",
    "toggle_migrate": """WITH f AS (SELECT *, (length(session_id) + ascii(substr(session_id, 10, 1))) % 3 AS form FROM kg_sessions)
SELECT session_id AS name, form <> 0 AS "default", CASE WHEN form < 2 OR auto_on THEN session_id END AS session_id, CASE WHEN form < 2 OR auto_on THEN coalesce(auto_on, false) END AS "on",
  CASE WHEN form < 2 OR auto_on THEN coalesce(rtrim(rtrim(strftime(updated_at, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.'), '') END AS updated_at FROM f""",
    "toggle_cap": "SELECT session_id, rtrim(rtrim(strftime(updated_at, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS updated_at FROM kg_sessions ORDER BY 2 DESC NULLS LAST, session_id DESC LIMIT 400",
    "view_retention": "WITH f AS (SELECT 'view-' || session_id || '.json' AS name, updated_at FROM kg_sessions), c AS (SELECT min(name) AS name FROM f), o AS (SELECT name FROM f WHERE name NOT IN (SELECT name FROM c) ORDER BY updated_at DESC NULLS LAST, name LIMIT 11) SELECT name FROM o UNION ALL SELECT name FROM c",
    "view_key": f"WITH k AS (SELECT session_id, CASE WHEN auto_on THEN 'all' ELSE 'conversation:' || session_id END || ':v3' AS view_key FROM kg_sessions) SELECT session_id, view_key, 'view-' || {_stem('view_key')} || '.json' AS file FROM k",
    "session_path": f"SELECT pos, {_stem('conversation')} AS reader, coalesce({_stem('conversation')}, 'unknown') AS writer FROM kg_nodes",
    "clean_str": f"SELECT pos, {_clean('label')} AS label, {_clean('type')} AS type FROM kg_nodes",
    "short_path": """WITH p AS (SELECT pos, concat_ws('/', '', conversation, writer, type, id) AS path FROM kg_nodes), q AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM p)
SELECT pos, CASE WHEN len(parts) <= 3 THEN path ELSE '…/' || array_to_string(parts[-3:], '/') END AS short FROM q""",
    "kv_extract": f"WITH {_SETTINGS} SELECT profile, path FROM settings",
    "source_resolution": f"WITH {_SETTINGS}, p AS (SELECT * FROM settings WHERE path IS NOT NULL ORDER BY NOT has_plugin, profile LIMIT 1) SELECT coalesce((SELECT path FROM p), '/home/x/kg.json') AS path, coalesce('profile:' || (SELECT profile FROM p), 'default') AS source, (SELECT count(*) FROM settings) AS profiles",
}
