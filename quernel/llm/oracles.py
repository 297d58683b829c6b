"""SQL over the same tables that gives the queries' rows another way."""

_SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

_PAIRS = """
, {k}_n AS (SELECT count(DISTINCT basket) AS n FROM {k}_m)
, {k}_s AS (SELECT item, count(*) AS c FROM {k}_m GROUP BY item)
, {k}_k AS (SELECT m.* FROM {k}_m m JOIN {k}_s s USING (item), {k}_n WHERE s.c >= 5 AND 2000 * s.c >= n AND 3 * s.c <= n)
, {k}_p AS (SELECT a.item AS id_a, b.item AS id_b, count(*) AS c FROM {k}_k a JOIN {k}_k b ON a.basket = b.basket AND a.item < b.item GROUP BY ALL)
, {k}_f AS (SELECT id_a, id_b, p.c AS together, a.c AS count_a, b.c AS count_b, n FROM {k}_p p JOIN {k}_s a ON a.item = id_a JOIN {k}_s b ON b.item = id_b, {k}_n
  WHERE p.c >= 5 AND 2000 * p.c >= n AND p.c::HUGEINT * n >= 3::HUGEINT * a.c * b.c)
"""
_DECISION = f"d_m AS (SELECT DISTINCT id AS basket, item FROM (SELECT id, regexp_replace(unnest(entities), '^{_SPACE}+|{_SPACE}+$', '', 'g') AS item FROM kg_decisions WHERE id IS NOT NULL) WHERE item <> '')"
_CONVERSATION = f"""c_m AS (SELECT DISTINCT basket, item FROM (SELECT id AS item, unnest(CASE WHEN regexp_matches(conversation, '^\\s*\\[') THEN from_json(conversation, '["VARCHAR"]') ELSE [conversation] END) AS basket
  FROM kg_nodes WHERE id IS NOT NULL AND conversation IS NOT NULL) WHERE regexp_replace(basket, '{_SPACE}+', '', 'g') <> '')"""

_KEYED = r"""
texts AS (SELECT DISTINCT properties AS p FROM kg_nodes WHERE json_valid(properties)),
trees AS (SELECT p, md5(string_agg(fullkey || ' ' || type || ' ' || coalesce(CASE WHEN type = 'DOUBLE' THEN (atom::DOUBLE)::VARCHAR ELSE atom::VARCHAR END, ''), chr(10) ORDER BY fullkey)) AS canon FROM texts, json_tree(texts.p) GROUP BY p),
keyed AS (SELECT n.pos, n.id, n.label, regexp_replace(lower(coalesce(id, '')), '[^\p{L}\p{N}]', '', 'g') AS k1, regexp_replace(lower(coalesce(label, '')), '[^\p{L}\p{N}]', '', 'g') AS k2,
  CASE WHEN properties IS NULL THEN 'n' ELSE coalesce('j' || canon, 't' || properties) END AS k3 FROM kg_nodes n LEFT JOIN trees ON trees.p = n.properties)
"""

_UNKNOWN = "('null', 'none', 'n/a', 'na', 'n.a.', '?', '??', '???', '-', '--', 'unknown', 'not known', 'undefined', 'nil', 'nan', 'tbd', 'unbekannt', '未知', '不详', '无')"
_TRUSTED = f"""
op AS (SELECT pos, metadata AS m FROM kg_nodes WHERE json_valid(metadata) UNION ALL SELECT pos, m::JSON ->> '$' FROM op WHERE json_type(m) = 'VARCHAR' AND json_valid(m::JSON ->> '$')),
r AS (SELECT n.*, coalesce(w.trust, 0) AS trust,
  regexp_replace(coalesce(type, ''), '^{_SPACE}+|{_SPACE}+$', '', 'g') <> '' AND lower(regexp_replace(type, '^{_SPACE}+|{_SPACE}+$', '', 'g')) NOT IN {_UNKNOWN} AS has_type,
  regexp_replace(coalesce(label, ''), '{_SPACE}+', '', 'g') <> '' AS has_label,
  m1 FROM kg_nodes n LEFT JOIN kg_writers w USING (writer) LEFT JOIN (SELECT pos, m AS m1 FROM op WHERE json_type(m) <> 'VARCHAR') USING (pos) WHERE id IS NOT NULL)
"""



def _full(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '{_SPACE}+', '', 'g') <> ''"


_BUNDLES = f"""
q AS (SELECT *, m1 ->> '$.user_city' AS city, m1 ->> '$.note' AS note, m1 ->> '$.extraction.model' AS model, m1 -> '$.extraction.passes' AS passes FROM r),
u AS (SELECT id, pos, trust, written_at, CASE WHEN has_type AND has_label THEN type || chr(1) || label END AS n, CASE WHEN {_full("city")} OR {_full("note")} THEN concat(coalesce(city, chr(2)), chr(1), coalesce(note, chr(2))) END AS p,
  CASE WHEN {_full("model")} AND passes IS NOT NULL THEN model || chr(1) || passes::VARCHAR END AS e FROM q),
""" + "".join(
    f"{k}v AS (SELECT id, {k}, max(trust) AS trust, arg_max(pos, (trust, written_at, pos)) AS pos, max((trust, written_at, pos)) AS rank FROM u WHERE {k} IS NOT NULL GROUP BY ALL), {k}b AS (SELECT id, arg_max({k}, rank) AS v, arg_max(pos, rank) AS pos, arg_max(pos, (trust, pos)) AS free, max(trust) AS most FROM {k}v GROUP BY id),\n"
    for k in "npe"
) + """
g AS (SELECT id, nb.v AS n, nb.pos AS np, pb.pos AS pp, eb.pos AS ep, nb.v IS NOT NULL AND (pb.v IS NOT NULL AND NOT EXISTS (SELECT 1 FROM u WHERE u.id = o.id AND u.n = nb.v AND u.p = pb.v) OR eb.v IS NOT NULL AND NOT EXISTS (SELECT 1 FROM u WHERE u.id = o.id AND u.n = nb.v AND u.e = eb.v)) AS open,
  pb.free AS pf, pb.most AS pm, eb.free AS ef, eb.most AS em FROM (SELECT id FROM u GROUP BY id HAVING count(*) >= 2) o LEFT JOIN nb USING (id) LEFT JOIN pb USING (id) LEFT JOIN eb USING (id)),
np AS (SELECT u.id, u.n, arg_max(pv.pos, (pv.trust, pv.pos)) AS pos, max(pv.trust) AS trust FROM u JOIN pv USING (id, p) WHERE n IS NOT NULL GROUP BY ALL), ne AS (SELECT u.id, u.n, arg_max(ev.pos, (ev.trust, ev.pos)) AS pos, max(ev.trust) AS trust FROM u JOIN ev USING (id, e) WHERE n IS NOT NULL GROUP BY ALL),
c AS (SELECT nv.id, 1 + (np.pos IS NOT NULL)::INT + (ne.pos IS NOT NULL)::INT AS many, nv.trust + coalesce(np.trust, 0) + coalesce(ne.trust, 0) AS total, nv.pos AS a, coalesce(ne.pos, -1) AS b, coalesce(np.pos, -1) AS d FROM nv LEFT JOIN np USING (id, n) LEFT JOIN ne USING (id, n)
  UNION ALL SELECT id, (pf IS NOT NULL)::INT + (ef IS NOT NULL)::INT, coalesce(pm, 0) + coalesce(em, 0), -1, coalesce(ef, -1), coalesce(pf, -1) FROM g)
SELECT id, CASE WHEN open THEN nullif((SELECT arg_max(a, (many, total, a, b, d)) FROM c WHERE c.id = g.id), -1) ELSE np END AS name_pos, CASE WHEN open THEN nullif((SELECT arg_max(d, (many, total, a, b, d)) FROM c WHERE c.id = g.id), -1) ELSE pp END AS place_pos,
  CASE WHEN open THEN nullif((SELECT arg_max(b, (many, total, a, b, d)) FROM c WHERE c.id = g.id), -1) ELSE ep END AS extraction_pos FROM g"""

ORACLES = {
    "p1_found": f"WITH {_DECISION} {_PAIRS.format(k='d')}, {_CONVERSATION} {_PAIRS.format(k='c')} SELECT 'decision' AS basket, id_a, id_b FROM d_f UNION ALL SELECT 'conversation', id_a, id_b FROM c_f",
    "p1_decision_pairs": f"""WITH {_DECISION} {_PAIRS.format(k='d')} SELECT id_a, id_b, together, count_a, count_b, n AS baskets, round(together::DOUBLE * n / (count_a::DOUBLE * count_b), 6) AS lift,
  round(CASE WHEN together < count_a THEN (1 - count_b / n::DOUBLE) / (1 - together / count_a::DOUBLE) END, 6) AS conviction FROM d_f""",
    "p4_found": f"WITH {_KEYED}, g AS (SELECT *, min(pos) OVER (PARTITION BY k1, k2, k3) AS first_pos FROM keyed) SELECT first_pos, pos FROM g WHERE pos > first_pos",
    "p4_entities": f"WITH {_KEYED}, g AS (SELECT *, min(pos) OVER w AS first_pos, count(*) OVER w AS copies_held FROM keyed WINDOW w AS (PARTITION BY k1, k2, k3)) SELECT pos, id, label, copies_held FROM g WHERE pos = first_pos",
    "p5_found": f"""WITH RECURSIVE {_TRUSTED}, o AS (SELECT pos, m1::JSON AS m FROM r WHERE json_valid(m1) AND json_type(m1) = 'OBJECT'),
f AS (SELECT o.pos, count(*) FILTER (WHERE e.type <> 'NULL' AND NOT regexp_matches(coalesce(e.value ->> '$', ''), '^{_SPACE}*(\\[\\s*\\]|\\{{\\s*\\}})?{_SPACE}*$')) AS filled FROM o, json_each(o.m) e GROUP BY 1),
b AS (SELECT id, count(*) AS n, arg_max(pos, (trust, written_at, pos)) FILTER (WHERE has_type) AS type, arg_max(pos, (written_at, pos)) FILTER (WHERE has_label) AS label,
  arg_max(pos, (filled, trust, written_at, pos)) FILTER (WHERE filled > 0) AS metadata FROM r LEFT JOIN f USING (pos) GROUP BY id)
SELECT id, field, pos FROM (SELECT id, 'type' AS field, type AS pos FROM b WHERE n >= 2 UNION ALL SELECT id, 'label', label FROM b WHERE n >= 2 UNION ALL SELECT id, 'metadata', metadata FROM b WHERE n >= 2) WHERE pos IS NOT NULL""",
    "p5_bundles": f"""WITH RECURSIVE {_TRUSTED}, {_BUNDLES}""",
    "p5_consistent": f"""WITH RECURSIVE {_TRUSTED}, u AS (SELECT id, pos, trust, written_at, CASE WHEN has_type THEN type END AS t, CASE WHEN has_label THEN label END AS l FROM r),
tv AS (SELECT id, t, max(trust) AS trust, arg_max(pos, (trust, written_at, pos)) AS pos, max((trust, written_at, pos)) AS rank FROM u WHERE t IS NOT NULL GROUP BY ALL), lv AS (SELECT id, l, max(trust) AS trust, arg_max(pos, (trust, written_at, pos)) AS pos, max((trust, written_at, pos)) AS rank FROM u WHERE l IS NOT NULL GROUP BY ALL),
best AS (SELECT n.id, (SELECT arg_max({{'v': t, 'pos': pos}}, rank) FROM tv WHERE tv.id = n.id) AS t, (SELECT arg_max({{'v': l, 'pos': pos}}, rank) FROM lv WHERE lv.id = n.id) AS l FROM (SELECT id FROM u GROUP BY id HAVING count(*) >= 2) n),
pairs AS (SELECT DISTINCT id, t, l FROM u WHERE t IS NOT NULL AND l IS NOT NULL),
found AS (SELECT p.id, arg_max({{'t': tv.pos, 'l': lv.pos}}, (tv.trust + lv.trust, tv.pos, lv.pos)) AS c FROM pairs p JOIN tv USING (id, t) JOIN lv USING (id, l) GROUP BY p.id),
alone AS (SELECT id, max({{'trust': trust, 'pos': pos}}) AS t FROM tv GROUP BY id), alone_l AS (SELECT id, max({{'trust': trust, 'pos': pos}}) AS l FROM lv GROUP BY id)
SELECT id, CASE WHEN NOT open THEN best.t.pos WHEN c IS NOT NULL THEN c.t WHEN alone.t.trust >= alone_l.l.trust THEN alone.t.pos END AS type_pos,
  CASE WHEN NOT open THEN best.l.pos WHEN c IS NOT NULL THEN c.l WHEN alone.t.trust < alone_l.l.trust THEN alone_l.l.pos END AS label_pos
FROM (SELECT *, t IS NOT NULL AND l IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.id = best.id AND p.t = best.t.v AND p.l = best.l.v) AS open FROM best) best LEFT JOIN found USING (id) LEFT JOIN alone USING (id) LEFT JOIN alone_l USING (id)""",
}
