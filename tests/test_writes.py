"""Replay of a log of writes, as one batch and as a stream; decisions; toggles; scalar rules; documents."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from quernel.functions import scalars as S
from quernel.operators import decisions, mutations, toggles
from quernel.sources import documents
from quernel.streaming import writes
from tests.conftest import rows

SESSIONS = ["k1", "k2", "k3"]


def generated(seed: int, n: int = 160) -> list[tuple[str, dict]]:
    """Random writes over a few ids and sessions; sessions are given outside, in the metadata, padded, blank, of a wrong type or not at all."""
    rnd = random.Random(seed)
    ids = [f"n{k}" for k in range(9)]

    def place(args: dict) -> dict:
        how = rnd.randrange(7)
        tag = rnd.choice(SESSIONS)
        if how == 0:
            args["conversation"] = rnd.choice([tag, f"  {tag}\t", "", 7])
        if how in (1, 2):
            args["metadata"] = {"conversation": rnd.choice([tag, f" {tag} ", " ", None]), "more": how}
        return args

    made: list[tuple[str, dict]] = []
    for k in range(n):
        pick = rnd.choice(ids)
        made.append(rnd.choice([
            ("add_entity", place({"id": pick, "label": f"l{k}", "type": rnd.choice("XYZ")})),
            ("add_relationship", place({"source": pick, "target": rnd.choice(ids), "type": "near"})),
            ("record_decision", place({"category": f"c{k}", "entities": rnd.choice([[], [pick], [" ", "none", pick], [rnd.choice(ids), pick], pick]), "confidence": k / n})),
            ("update_node", place({"node_id": pick, "properties": rnd.choice([{"status": f"s{k}"}, {"other": 1}])})),
            ("delete_node", place({"node_id": pick})), ("read_back", place({"id": pick})),
        ]))
    return made


def text(v):
    return v.strip() or None if isinstance(v, str) else None


def model(items):
    """The same in plain Python: seq -> (session, how), and each store's nodes, edges and decisions."""
    owner, routes, stores = {}, {}, {}
    for seq, (tool, args) in enumerate(items):
        if tool not in mutations.WRITE_TOOLS:
            continue
        inner = text((args.get("metadata") or {}).get("conversation"))
        if tool == "add_entity":
            owner[args["id"]] = inner or text(args.get("conversation"))
        session, how = text(args.get("conversation")) or inner, "given"
        if not session:
            named = args["entities"] if isinstance(args.get("entities"), list) else []
            session, how = next((owner[i] for i in [*named, args.get("node_id"), args.get("id")] if owner.get(i)), None), "owner"
        routes[seq] = session, how if session else "merged only"
        for store in {None, session}:
            nodes, edges, decided = stores.setdefault(store, ({}, [], []))
            if tool == "add_entity":
                nodes[args["id"]] = [args["type"], args["label"], None]
            elif tool == "add_relationship":
                edges.append(seq)
            elif tool == "record_decision":
                decided.append(seq)
            elif args["node_id"] in nodes:
                status = "archived" if tool == "delete_node" else args["properties"].get("status")
                nodes[args["node_id"]][2] = status or nodes[args["node_id"]][2]
    return routes, stores


def log(spark, items):
    return spark.createDataFrame([(k, t, json.dumps(a)) for k, (t, a) in enumerate(items)], "seq bigint, tool string, args string")


@pytest.mark.parametrize("seed", [3, 8])
def test_replay(spark, seed):
    items = generated(seed)
    routes, stores = model(items)
    df = log(spark, items)
    assert {r.seq: (r.session, r.how) for r in mutations.route(df).collect()} == routes
    got = {(r.session, r.id): [r.type, r.label, r.status] for r in mutations.replay_nodes(df).collect()}
    assert got == {(s, i): n for s, (nodes, _, _) in stores.items() for i, n in nodes.items()}
    for k, replay in ((1, mutations.replay_edges), (2, mutations.replay_decisions)):
        assert sorted(((r.session, r.seq) for r in replay(df).collect()), key=repr) == sorted(((s, q) for s, held in stores.items() for q in held[k]), key=repr)
    assert mutations.route(log(spark, [])).count() == 0


def test_stream_gives_the_same(spark, tmp_path):
    items = generated(5)
    routes, _ = model(items)
    (tmp_path / "in").mkdir()
    for k, part in enumerate((range(40), range(40, 41), range(41, 100), range(100, len(items)))):
        (tmp_path / f"in/{k}.json").write_text("\n".join(json.dumps({"seq": i, "tool": items[i][0], "args": json.dumps(items[i][1])}) for i in part))
        q = writes.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"))
        q.awaitTermination(120)
        assert q.exception() is None
    got = {r.seq: r.session for r in spark.read.option("mergeSchema", True).parquet(str(tmp_path / "out/sessions")).collect()}
    assert got == {seq: s for seq, (s, _) in routes.items() if s}
    assert spark.read.parquet(str(tmp_path / "out/merged")).count() == len(routes)


def test_upsert(spark):
    df = spark.createDataFrame([(1, "a", 5, "x"), (2, "a", None, "y"), (3, "a", 5, "z"), (4, None, 1, "n"), (5, "b", None, "w")], "pos bigint, id string, written_at int, v string")
    assert rows(mutations.upsert(df).select("id", "v")) == [("a", "z"), ("b", "w")]
    own = spark.createDataFrame([(2, "a", '{"conversation": "late"}'), (1, "a", '{"metadata": {"conversation": " x "}, "conversation": "y"}'), (1, "b", '["c"]'), (1, "c", None), (1, "d", '{"conversation": 5}')], "pos bigint, id string, metadata string")
    assert rows(mutations.node_owner(own)) == [("a", "x"), ("b", None), ("c", None), ("d", None)]


def test_decisions(spark):
    d = spark.createDataFrame([(1, "d", "c", "m", ["a", " b", "", None]), (2, "d", "c2", None, ["a"]), (3, "e", " ", "m", None)], "pos bigint, id string, category string, decision_maker string, entities array<string>")
    last, satellites, links = decisions.expand(d)
    assert rows(links.select("source_id", "type", "target_id")) == sorted([("d", "involves", "a"), ("d", "belongs_to", "category:c2"), ("e", "made_by", "maker:m")], key=repr)
    assert last.count() == 2 and rows(satellites.select("id")) == [("category:c2",), ("maker:m",)]


def test_times(spark):
    cases = [("1741426200.5", None, None), ("1741426200500", None, None), ("", "2025-03-08", None), (None, "soon", "2025-03-08T09:30:00+01:00"), (None, "2025-03-08T09:30:00", None), ("99999999999999999", None, None), ("x", "2025-13-01", None)]
    df = spark.createDataFrame(cases, "t string, r string, v string").select(S.iso_utc(S.decision_ms(F.col("t"), F.col("r"), F.col("v"))))
    assert [r[0] for r in df.collect()] == ["2025-03-08T09:30:00.500Z", "2025-03-08T09:30:00.500Z", "2025-03-08T00:00:00.000Z", "2025-03-08T08:30:00.000Z", "2025-03-08T09:30:00.000Z", None, None]


def test_names(spark):
    df = spark.createDataFrame([("~/.. box:7/", "/a/b/c/d"), ("", "a/b"), ("a😀b" + "x" * 200, "/x//y/z/w/")], "s string, p string")
    got = df.select(S.file_stem(F.col("s")), S.file_stem(F.col("s"), "unknown"), S.short_path(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("box_7", "box_7", "…/b/c/d"), (None, "unknown", "a/b"), ("a_b" + "x" * 117, "a_b" + "x" * 117, "…/y/z/w")]
    df = spark.createDataFrame([("a: 1\n  KEY: '~/g.json'  \nKEY: second",), ("KEY:   ",), ("XKEY: 1",), (None,)], "t string")
    assert [r[0] for r in df.select(S.key_value(F.col("t"), "KEY", "/home/u")).collect()] == ["/home/u/g.json", None, None, None]
    df = spark.createDataFrame([('{"conversation": "", "session": "s"}',), ('{"session": ["a", 5, "b"]}',), ('{"conversation": null, "session": "s"}',), ('{"conversation": 7}',), ("[1]",), (None,)], "m string")
    assert [r[0] for r in df.select(S.metadata_tags(F.col("m"))).collect()] == [[""], ["a", "b"], ["s"], [], None, None]
    df = spark.createDataFrame([(0, 0), (1, 1000), (500, 1000), (1000, 1000)], "v int, m int")
    assert [r[0] for r in df.select(S.bar_percent(F.col("v"), F.col("m"))).collect()] == [0, 3, 50, 100]


def test_toggles(spark):
    files = [("v1", '{"v": 1, "default": false, "sessions": {"a": {"on": false, "updatedAt": "t"}}}'), ("old", '{"default": false, "sessions": {"a": {"on": true}, "b": {"on": "yes"}}}'), ("first", '{"a": {"on": true}, "b": {"on": false}, "c": 1}'), ("broken", "{"), ("gone", None)]
    got = toggles.migrate(spark.createDataFrame(files, "name string, text string"))
    assert rows(got.select("name", "default", "session_id", "on")) == sorted([("v1", False, "a", False), ("old", True, "a", True), ("old", True, "b", False), ("first", True, "a", True), ("broken", True, None, None), ("gone", True, None, None)], key=repr)
    w = spark.createDataFrame([("a", "1", 1, True), ("a", "2", 2, None), ("", "3", 3, True), ("b", "1", 4, True)], "session_id string, updated_at string, seq int, on boolean")
    stored = toggles.last_set(w)
    assert rows(stored) == [("a", False, "2"), ("b", True, "1")]
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "session_id string")
    assert rows(toggles.resolve(asked, stored, True)) == [("a", False, True), ("b", True, True), ("c", True, False)]
    assert rows(toggles.newest(stored, 1)) == [("a", False, "2")]
    kept = toggles.stored_form(stored, False, 1).select(F.lit("f").alias("name"), "text")
    assert rows(toggles.migrate(kept)) == [("f", False, "a", False, "2")]
    assert rows(toggles.migrate(toggles.stored_form(stored.limit(0), True).select(F.lit("f").alias("name"), "text"))) == [("f", True, None, None, None)]


def test_documents(spark, tmp_path):
    doc = {
        "nodes": [
            {"id": "a", "type": "ORG", "properties": {"label": " A ", "metadata": {"conversation": "s"}}}, {"id": 2, "type": "X", "properties": {"label": "", "name": "n"}}, {"id": "c", "properties": {"label": 5, "name": "n", "status": "archived"}},
            {"id": "d", "type": "decision", "properties": {"content": "C", "timestamp": 1741426200.5, "confidence": "high", "metadata": {"session": ["s", "t"]}}}, {"id": "e", "type": "decision", "properties": {"timestamp": "1741426200", "recorded_at": "2025-03-08T09:30:00Z", "confidence": 0.5}},
        ],
        "edges": [{"source_id": "a", "target_id": 2, "type": "uses", "properties": {"metadata": {"conversation": "s"}}}, {"source_id": "a", "target_id": "d", "weight": 2}],
    }
    (tmp_path / "sessions").mkdir()
    (tmp_path / "kg.json").write_text(json.dumps(doc))
    path = f"file://{tmp_path}/kg.json"
    docs = documents.scan(spark, path)
    assert docs.select("graph_id", "bytes").first() == ("kg", len(json.dumps(doc)))
    n = documents.nodes_of(docs).orderBy("pos").collect()
    assert [(r.id, r.label, r.tags, r.status) for r in n] == [("a", "A", ["s"], None), ("2", "2", None, None), ("c", "c", None, "archived"), ("d", "C", ["s", "t"], None), ("e", "e", None, None)]
    assert [(r.at_ms, r.confidence) for r in n[3:]] == [(1741426200500.0, None), (1741426200000.0, 0.5)]
    e = documents.edges_of(docs).orderBy("pos").collect()
    assert [(r.source_id, r.target_id, r.weight, r.tags, r.properties) for r in e] == [("a", "2", 1.0, ["s"], '{"metadata":{"conversation":"s"}}'), ("a", "d", 2.0, None, "{}")]
    assert documents.scan(spark, f"file://{tmp_path}/none.json") is None
    assert documents.choose(spark, path, "s", "conversation")[1] == "merged-scope"
    (tmp_path / "sessions/s.json").write_text(json.dumps({"graph_id": "own", "nodes": doc["nodes"][:1], "edges": []}))
    own, source = documents.choose(spark, path, "s", "conversation")
    assert source == "session-file" and own.first().graph_id == "own" and documents.choose(spark, path, "s", "all")[1] == "merged-scope"
    (tmp_path / "bad.json").write_text('{"nodes": []}')
    with pytest.raises(documents.NotAGraph):
        documents.scan(spark, f"file://{tmp_path}/bad.json")
    nodes, edges = documents.nodes_of(docs).drop("path"), documents.edges_of(docs).drop("path")
    size = documents.write_document(nodes, edges, f"file://{tmp_path}/one.json", "g")
    back = json.loads((tmp_path / "one.json").read_text())
    assert (tmp_path / "one.json").stat().st_size == size and (back["graph_id"], back["links"], len(back["nodes"]), len(back["edges"])) == ("g", [], 5, 2)
    assert rows(documents.edges_of(documents.scan(spark, f"file://{tmp_path}/one.json")).select("source_id", "target_id")) == [("a", "2"), ("a", "d")]
    with pytest.raises(ValueError):
        documents.write_document(nodes, edges, f"file://{tmp_path}/two.json", most=6)
    documents.write_lines(nodes, edges, str(tmp_path / "lines"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "lines")).collect()]
    assert sorted(x["kind"] for x in lines) == ["edge"] * 2 + ["node"] * 5
    documents.write_tables(nodes, edges, str(tmp_path / "tables"))
    assert rows(spark.read.parquet(str(tmp_path / "tables/nodes"))) == rows(nodes)
    for p, text in (("web", "mark\nenv:\n  KG: '/data/g.json'\n"), ("cli", "KG: /x\n")):
        (tmp_path / f"profiles/{p}").mkdir(parents=True)
        (tmp_path / f"profiles/{p}/settings.yml").write_text(text)
    held = documents.scan_profiles(spark, f"file://{tmp_path}", "settings.yml", "KG", ("mark",))
    assert rows(held) == [("web", "/data/g.json")]
    held = held.withColumn("has_plugin", F.lit(False))
    assert rows(documents.resolve_source(held, None, "/d")) == [("/data/g.json", "profile:web", 1)]
    assert rows(documents.resolve_source(held.limit(0), " /e ", "/d")) == [("/e", "env", 0)] and rows(documents.resolve_source(held.limit(0), None, "/d")) == [("/d", "default", 0)]


def test_files(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"view-{k}.json").write_text("{}")
        os.utime(tmp_path / f"view-{k}.json", (1000 + k, 1000 + k))
    (tmp_path / "other.json").write_text("{}")
    assert documents.prune_views(spark, f"file://{tmp_path}", "view-0.json", 3) == ["view-1.json", "view-2.json"]
    assert sorted(f.name for f in tmp_path.glob("*.json")) == ["other.json", "view-0.json", "view-3.json", "view-4.json"]
    assert documents.prune_views(spark, f"file://{tmp_path}/none", "x") == [] and not documents.remove(spark, f"file://{tmp_path}/none")
    (tmp_path / "sessions").mkdir()
    (tmp_path / "sessions/bad.json").write_text("[")
    (tmp_path / "sessions/ok.json").write_text('{"nodes": [{"id": "a"}], "edges": []}')
    held = documents.SessionGraphs(spark, f"file://{tmp_path}/kg.json", 2)
    assert held.get("bad") is None and held.get("none") is None and held.get("ok")[0].count() == 1 and list(held.held) == ["none", "ok"]
    assert documents.home_folder({"GRAPH_HOME": "/g"}, "m", lambda p: True) == "/g" and documents.home_folder({"HOME": "/h", "GRAPH_HOME": " "}, "m", lambda p: True) == "/h/m"
    assert documents.home_folder({"HOME": "/h"}, "m", lambda p: False) == "/h/.graph"
    assert [documents.sessions_folder(e, m) for e, m in (({"GRAPH_SESSIONS": "~/s", "HOME": "/h"}, "/d/g.json"), ({}, "/d/g.json"), ({"HOME": "/h"}, ""))] == ["/h/s", "/d/sessions", "/h/.graph/sessions"]


def test_requests(spark):
    bodies = [(1, '{"sessionId": "s", "mode": "all"}'), (2, '{"sessionId": "s", "mode": 5}'), (3, " "), (4, "{"), (5, '{"sessionId": "' + "x" * 200 + '"}'), (6, None)]
    got = documents.parse_bodies(spark.createDataFrame(bodies, "id int, body string"), 100)
    assert rows(got) == [(1, "s", "all", None), (2, "s", "conversation", None), (3, None, None, "no session"), (4, None, None, "no JSON"), (5, None, None, "too large"), (6, None, None, "no session")]
    out = documents.responses(got.where("id = 1").select("id", "mode", F.lit("é").alias("x"))).first()
    assert (out.body, out.bytes) == ('{"mode":"all","x":"é"}', 23)
    df = spark.createDataFrame([("2025-03-08T09:30:00.500Z",), (None,)], "t string")
    assert [r[0] for r in df.select(S.minute(F.col("t"))).collect()] == ["2025-03-08 09:30", None]
